from . import brute
from .brute import SMALL, prose
from pawledger.llm import queries
from pawledger.llm.licenses import NOTICES, found_licenses

ORDER = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]


def expected(doc, text):
    n, found = brute.phrase_places(text)
    places = [at for at, _ in found]
    return doc, n, len(found), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in found}))


def test_query_equals_brute_force(spark, small):
    found = queries.op8_licenses(spark, SMALL).collect()
    assert sorted(tuple(r[c] for c in ORDER) for r in found) == sorted(expected(r.doc_id, r.text) for r in small("documents").collect())
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels for r in found)
    assert all(0 <= r.score <= 1 for r in found) and any(r.n_base for r in found)


def test_odd_rows(table):
    rows = [(1, None), (2, ""), (3, "CC-BY"), (4, "cc by cc by, MIT\nlicense"), (5, "gnu general gnu general public license license"), (6, "the Apache Licenses"),
            (7, prose(30_000) + " mit license"), (None, "mit license"), (8, "mit license"), (8, "mit license"), (9, "écc by cc byé"), (10, "cc"), (11, "GNU General Public License")]
    found = found_licenses(table(rows)).collect()
    assert sorted((tuple(r[c] for c in ORDER) for r in found), key=str) == sorted((expected(*row) for row in rows), key=str)
    assert found_licenses(table([])).count() == 0


def test_notices_with_changes(table):
    text = NOTICES[0].text
    words = text.split()
    changed = " ".join([*words[:6], "really", *words[6:12], *words[13:]])
    rows = [(1, prose(50) + " " + text + " " + prose(50)), (2, changed), (3, " ".join(words[:6])), (4, " ".join(reversed(words))), (5, "of this software and"), (6, NOTICES[3].text)]
    found = {r.doc_id: (r.labels, r.n_base, r.score) for r in found_licenses(table(rows)).collect()}
    assert found[1] == ("mit", 0, 1.0) and found[2][:2] == ("mit", 0) and 0.5 <= found[2][2] < 1
    assert found[3][0] == found[4][0] == found[5][0] == "" and found[6][0] == "bsd"


def test_no_python_in_the_plan(table):
    plan = found_licenses(table([(1, "a b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
