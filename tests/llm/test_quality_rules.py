from . import brute
from .brute import SMALL, prose
from pawledger.llm import quality_rules, queries
from pawledger.llm.quality_rules import RULES, estimate, good_documents, posterior, rated


def test_counts_equal_brute_force(spark, small):
    texts = {r.doc_id: r.text for r in small("documents").collect()}
    found = queries.op7_quality_rules(spark, SMALL).collect()
    assert len(found) == len(texts)
    for r in found:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute.rule_counts(texts[r.doc_id]), r.doc_id
        assert not (r.kept and r.base_failed) and r.kept == (not r.base_failed and r.posterior >= 0.5)


def test_verdicts_agree_with_labels(spark, small):
    found = {r.doc_id: r for r in queries.op7_quality_rules(spark, SMALL).collect()}
    labels = [r for r in small("labels").collect() if not found[r.doc_id].base_failed or r.quality == 0]
    assert sum(found[r.doc_id].kept == (r.quality == 1) for r in labels) >= 0.95 * len(labels)


def test_odd_rows(table):
    again = " ".join(["a b c d"] * 30)
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, again), (5, "x y x y x y"), (6, "a b c a b c"), (7, "é é é\né é é\n\n# $"), (8, prose(20_000, 1)),
            (None, prose(100, 2)), (9, prose(60, 3)), (9, prose(60, 3)), (10, "\x0bword\x0cother\r\n"), (11, "line\nline \nline\n line")]
    df = rated(table(rows))
    assert df.columns[: len(table([]).columns) - 1] == [c for c in table([]).columns if c != "__q"]
    got = sorted(((r.doc_id, r.text, r.n_words, *[r["__q"][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]) for r in df.collect()), key=str)
    assert got == sorted(((doc, text, "a", *brute.rule_counts(text)) for doc, text in rows), key=str)
    assert good_documents(table(rows)).columns == table(rows).columns
    assert rated(table([])).count() == 0 and good_documents(table([])).count() == 0


def test_very_long_clean_texts_are_kept(table):
    import random

    rng = random.Random(4)

    def clean(n):
        return "".join(f"{'x' * (k % 7)}w{rng.randrange(3000)}" + (".\n" if k % 12 == 11 else " ") for k in range(n)) + "End."

    def salad(k):
        return " ".join(rng.choice("abcdefghijklmnop") for _ in range(200)) + "."

    bad = [lambda k: prose(200, k).replace(" ", " $ "), lambda k: prose(200, k).upper() + "!" * 80, salad]
    rows = [(k, clean(150)) for k in range(150)] + [(200 + k, bad[k % 3](k)) for k in range(30)] + [(900, clean(200_000)), (901, clean(500_000))]
    found = {r.doc_id: r["__q"] for r in rated(table(rows)).where("doc_id < 1 or doc_id >= 200").collect()}
    assert found[0].kept and not any(found[200 + k].kept for k in range(30))
    assert found[900].kept and found[901].kept
    assert all(2 * found[k].n_part_distinct > found[k].n_words for k in (900, 901))


def test_em_recovers_rates():
    import random

    rng = random.Random(3)
    # Outcomes bad, good, abstains: of three rules on bad and on good texts.
    truth = [[[0.7, 0.1, 0.2], [0.02, 0.9, 0.08]], [[0.6, 0.0, 0.4], [0.03, 0.0, 0.97]], [[0.1, 0.2, 0.7], [0.05, 0.8, 0.15]]]
    counts = {}
    for _ in range(20_000):
        side = int(rng.random() < 0.8)
        votes = tuple(rng.choices((0, 1, 2), rule[side])[0] for rule in truth)
        counts[votes] = counts.get(votes, 0) + 1
    share, table = estimate(sorted(counts.items()), 3, 300)
    assert abs(share - 0.8) < 0.03
    assert all(abs(a - b) < 0.05 for rule, real in zip(table, truth) for x, y in zip(rule, real) for a, b in zip(x, y))
    assert posterior((0, 0, 2), share, table) < 0.05 < 0.95 < posterior((1, 2, 1), share, table)


def test_em_on_no_texts_and_on_one_kind():
    share, table = estimate([], 2)
    assert share == 0.5 and posterior((2, 2), share, table) == 0.5
    share, table = estimate([((1, 2), 1000)], 2)
    assert posterior((1, 2), share, table) > 0.99


def test_no_python_in_the_plan(table):
    plan = rated(table([(1, "a b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and len(RULES) == len(set(r.name for r in RULES))
    assert quality_rules.LEAST_WORDS == 50
