import random
import re

import pytest

from . import brute
from .brute import SMALL, prose
from pawledger.llm import personal_data as module, queries
from pawledger.llm.personal_data import personal_data

COLUMNS = "doc_id long, text string, kind string, start string, spans string, found string, votes string"
NAMES = ("email", "ip", "card", "phone")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    """All base spans as kind:start:end, by the patterns as they are stated."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return [f"{NAMES[k]}:{s}:{e}" for s, k, e in sorted(out)]


def check(row, text):
    found = [f"{s.kind}:{s.start}:{s.end}" for s in row.spans if s.base]
    assert found == base(text or ""), text
    assert [s.start for s in row.spans] == sorted(s.start for s in row.spans)


def build(spark, texts):
    return spark.createDataFrame([(k, t, "a", "b", "c", "d", "e") for k, t in enumerate(texts)], COLUMNS)


def test_query_equals_brute_force(spark, small):
    texts = {r.doc_id: r.text or "" for r in small("documents").collect()}
    found = queries.op11_personal_data(spark, SMALL).collect()
    assert len(found) == len(texts)
    for r in found:
        want = base(texts[r.doc_id])
        kinds = [s.split(":")[0] for s in want]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds.count(k) for k in NAMES)
        assert r.base_sha256 == brute.sha(",".join(want))
        assert [s for s in r.spans.split(",") if s.split(":")[0] in NAMES] == want
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in found) > 5


ODD = [
    None, "", "a@b", "a@b.c", "a@b.com_x@y.z", "a@b.c@d.e", "..a.b@-.-..x@y", "é a@b.c.d. ñ@x.y", "%@%.a a@a.a",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "0001.2.3.0255", "256.1.1.1", "1.2.3.400.5", "12345678901234567890.1.1.1", "9.9.9.9@x.y",
    "4111 1111-1111 1111", "4111  1111-1111 1111", "0000000000000", "4111111111111111 4111111111111111", "1 2 3 4 5 6 7 8 9 0 1 2",
    "+1 (509) 555-6973", "+12345678", "+123456789", "+1234567890123456", "+1 ((", "++1 234 567 890+", "+1                    5 ....  2 3 4 5 6 7 8",
    "+1 (826) 555-4081 190.137.223.204 du", "\x03+1 234 567 890\x03a@b.c\x01\x02", "𝄞 a@b.c 𝄞 1.1.1.1", "x\r\n+1 234\n567 890",
]


def test_odd_texts(spark):
    table = build(spark, [*ODD, ODD[16], ODD[16]])
    for r in personal_data(table).collect():
        check(r, [*ODD, ODD[16], ODD[16]][r.doc_id])
    assert personal_data(table.limit(0)).collect() == []
    nulls = table.where("doc_id = 3").selectExpr("cast(null as long) doc_id", "text")
    assert [s.kind for s in personal_data(nulls).first().spans] == ["email"]


def test_random_texts(spark):
    rng = random.Random(4)
    letters = ["@", ".", "-", "+", " ", "(", ")", "1", "2", "25", "0", "a", "é", "_", "\n", "4111111111111111"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(1500)]
    for r in personal_data(build(spark, texts)).collect():
        check(r, texts[r.doc_id])


def test_very_long_texts(spark):
    """Time in proportion, and no recursion as deep as a text is long."""
    address, mixed = "a." * 200_000 + "b@c" + ".d" * 100_000, "+1 (509) 555-6973 a@b.c 1.2.3.4 " * 3000
    long = {
        "a" * 400_000: [], "1" * 400_000: [], "1 " * 200_000: [], "+1" + " " * 300_000: [], address: [f"email:0:{len(address)}"],
        "1." * 200_000: [f"ip:{8 * k}:{8 * k + 7}" for k in range(50_000)], mixed: base(mixed), prose(20_000): [],
    }
    found = personal_data(build(spark, list(long))).collect()
    assert len(found) == len(long)
    for r, want in zip(sorted(found, key=lambda r: r.doc_id), long.values()):
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.base] == want


def test_classifier_adds_and_rejects(spark, small):
    """Forms that the base misses are added beside real documents; numbers that only look like them are not."""
    rows = [r.text or "" for r in small("documents").collect()]
    add = {
        "reach me: jane.doe (at) mail (dot) com today": "written",
        "Phone +1 (826) 555-4081 190.137.223.204 du": "number",
        "cards 4104321470856409 4111111111111111 there": None,
        "call (826) 555-4081 now": "number",
    }
    reject = ["order 0810992847249405 of it", "isbn 4787556152378722", "100 200 300 400 500", "the year 2020 2021 2022", "item 1111 1111 1111 1112"]
    texts = [*rows, *add, *reject]
    found = {r.doc_id: r.spans for r in personal_data(build(spark, texts)).collect()}
    for k, kind in enumerate(add.values(), len(rows)):
        assert kind is None or kind in [s.kind for s in found[k]], texts[k]
    for k in range(len(texts) - len(reject), len(texts)):
        assert found[k] == [], texts[k]
    assert sum(len([s for s in found[k] if not s.base]) for k in range(len(rows))) <= 5


def test_native_plan(spark, small):
    plan = module.proposed(small("documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("patterns", [[], [((0, (1, 2, 1, 2, 2, 1), 0, 0), 5)]])
def test_few_patterns(patterns):
    weights = module.trained(patterns)
    assert len(weights) == module.WIDTH and all(abs(w) < 50 for w in weights)
