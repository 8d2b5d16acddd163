"""Weak supervision of text quality: rules vote or abstain, EM weighs them, a posterior decides.

Each rule looks at figures of a text and votes good, bad, or not at all. Expectation-maximisation
over the counts of vote patterns (at most 3 ** rules of them, whatever the corpus) estimates how
often good and bad texts occur and how each rule votes on either, abstentions included; the
posterior of a text follows from its votes. Everything that touches rows is a built-in function.

The share of distinct words falls and that of repeated ones rises with the length of any text, so
the rules look at both inside windows of PART words, over the whole text.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .columns import BLANKS, count_of, let, upto, words
from .store import stored

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
#: Words of a window of the rules on distinct and repeated words; a shorter text is one window.
PART = 500
SENTENCE_END = "[.!?\\u2026][\"')]*\\s*$"


BAD, GOOD, ABSTAINS = 0, 1, 2


@dataclass(frozen=True)
class Rule:
    """Conditions on the counts; a rule whose conditions are false or null abstains."""

    name: str
    bad: str = "false"
    good: str = "false"


RULES = (
    Rule("symbols", bad="try_divide(n_symbols, n_words) >= 0.1"),
    Rule("shouting", bad="try_divide(n_upper, word_chars) >= 0.4"),
    Rule("marks", bad="try_divide(n_marks, n_words) >= 0.4"),
    Rule("repeated words", bad="try_divide(n_part_repeat, n_words) >= 0.4"),
    Rule("repeated lines", bad="try_divide(n_dup_lines, n_lines) >= 0.5"),
    Rule("few words", bad="try_divide(n_part_distinct, n_words) <= 0.2"),
    Rule("no sentences", bad="n_words >= 50 and n_sentences = 0"),
    # One rule for each kind of figure: single figures of one kind agree too often for EM, which
    # takes rules as independent, and many good votes would outweigh the one bad vote of a text.
    Rule("plain letters", good="20 * n_symbols <= n_words and 5 * n_upper <= word_chars and 10 * n_marks <= n_words"),
    Rule("varied words", good="4 * n_part_repeat <= n_words and 3 * n_part_distinct >= n_words"),
    Rule("varied lines", good="2 * n_dup_lines <= n_lines"),
)
ROUNDS = 60


def repeated_words(parts: Column) -> Column:
    """Words inside three-word windows that occur twice or more."""

    def window(i: Column) -> Column:
        code = F.xxhash64(F.get(parts, i), F.get(parts, i + 1), F.get(parts, i + 2))
        return F.struct(code.alias("code"), i.alias("at"))

    def repeats(found: Column) -> Column:
        def place(k: Column) -> Column:
            here = F.get(found, k)
            before, after = F.get(found, k - 1)["code"], F.get(found, k + 1)["code"]
            again = F.coalesce(here["code"] == before, F.lit(False)) | F.coalesce(here["code"] == after, F.lit(False))
            return F.when(again, here["at"])

        at = F.array_compact(F.transform(upto(F.size(found)), place))
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

    return let(F.sort_array(F.transform(upto(F.size(parts) - 2), window)), repeats)


def in_parts(parts: Column, figure: Callable[[Column], Column]) -> Column:
    """The sum of a figure of words over windows of PART words."""

    windows = upto(F.ceil(F.size(parts) / PART).cast("int"))
    found = F.transform(windows, lambda k: let(F.slice(parts, k * PART + 1, PART), figure))
    return F.aggregate(found, F.lit(0), lambda a, b: a + b)


def text_figures(text: Column) -> Column:
    """A struct of a text's counts; a null text counts as an empty one."""
    text = F.coalesce(text, F.lit(""))

    def of_words(parts: Column) -> Column:
        def counted(repeats: Column) -> Column:
            short = F.size(parts) <= PART
            return F.struct(
                F.size(parts).cast("long").alias("n_words"),
                in_parts(parts, lambda part: F.size(F.array_distinct(part))).cast("long").alias("n_part_distinct"),
                repeats.cast("long").alias("n_repeat_words"),
                F.when(short, repeats).otherwise(in_parts(parts, repeated_words)).cast("long").alias("n_part_repeat"),
            )

        return let(repeated_words(parts), counted)

    def of_lines(parts: Column) -> Column:
        return F.struct(
            F.size(parts).cast("long").alias("n_lines"),
            (F.size(parts) - F.size(F.array_distinct(parts))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(parts, lambda line: line.rlike(SENTENCE_END))).cast("long").alias("n_sentences"),
        )

    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    return F.struct(
        let(words(text, BLANKS), of_words).alias("by_word"),
        let(lines, of_lines).alias("by_line"),
        (F.length(text) - count_of(text, " \t\n\x0b\f\r")).cast("long").alias("word_chars"),
        count_of(text, SYMBOLS).alias("n_symbols"),
        count_of(text, string.ascii_uppercase).alias("n_upper"),
        count_of(text, "!?").alias("n_marks"),
    )


def vote(rule: Rule) -> Column:
    return F.when(F.expr(rule.bad), BAD).when(F.expr(rule.good), GOOD).otherwise(ABSTAINS)


def figures(documents: DataFrame) -> DataFrame:
    """All columns of documents and `__q`, a struct of the text's counts."""
    others = [c for c in documents.columns if c != "__q"]
    found = documents.select(F.struct(*others).alias("row"), text_figures(F.col("text").cast("string")).alias("t"))
    flat = F.struct("t.by_word.*", "t.by_line.*", "t.word_chars", "t.n_symbols", "t.n_upper", "t.n_marks")
    return found.select("row.*", flat.alias("__q"))


def votes_of(rules: tuple[Rule, ...]) -> Column:
    """The votes, from the columns of the counts."""
    return F.array(*[vote(rule) for rule in rules])


def estimate(patterns: list[tuple[tuple, int]], n_rules: int, rounds: int = ROUNDS) -> tuple[float, list]:
    """The share of good texts, and for each rule the shares of its three outcomes among bad and
    among good texts.

    `patterns` are the outcomes of all rules and how many texts have them. The first guess is bad
    where any rule votes so, as bad texts are bad in few ways at once; half a text of each kind is added, to keep shares inside (0, 1).
    """
    guess = []
    for votes, _ in patterns:
        guess.append(0.05 if BAD in votes else 0.95 if GOOD in votes else 0.5)
    share, table = 0.5, []
    for _ in range(rounds):
        weight = [0.5, 0.5]
        tally = [[[0.5] * 3, [0.5] * 3] for _ in range(n_rules)]
        for (votes, n), p in zip(patterns, guess):
            for side, part in ((0, (1 - p) * n), (1, p * n)):
                weight[side] += part
                for k, value in enumerate(votes):
                    tally[k][side][value] += part
        share = weight[1] / sum(weight)
        table = [[[x / sum(side) for x in side] for side in rule] for rule in tally]
        guess = [posterior(votes, share, table) for votes, _ in patterns]
    return share, table


def evidence(rule: list, value: int) -> float:
    """How much an outcome speaks for a good text, as log odds."""
    return math.log(rule[1][value] / rule[0][value])


def posterior(votes: tuple, share: float, table: list) -> float:
    odds = math.log(share / (1 - share)) + sum(evidence(rule, value) for rule, value in zip(table, votes))
    return 1 / (1 + math.exp(-max(min(odds, 700), -700)))


def rated(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of documents and `__q`: counts, `base_failed`, `posterior` (of being good) and `kept`.

    base_failed: fewer than 50 words, or more than half of them in repeated windows. kept: not so,
    and a posterior of at least one half. Null and empty texts have no words and fail. Repeated
    rows are rated each; ids play no part. A column called __q is replaced. An empty table gives
    no rows.
    """
    rows = stored(figures(documents), "figures")
    counts = rows.select("__q.*").select(votes_of(rules).alias("votes")).groupBy("votes").count()
    patterns = [(tuple(r["votes"]), r["count"]) for r in counts.collect()]  # at most 3 ** len(rules)
    share, table = estimate(sorted(patterns), len(rules))
    odds = F.lit(math.log(share / (1 - share)))
    for k, rule in enumerate(table):
        weights = F.array(*[F.lit(evidence(rule, value)) for value in (BAD, GOOD, ABSTAINS)])
        odds = odds + F.get(weights, F.get("votes", F.lit(k)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    others = [c for c in rows.columns if c != "__q"]
    names = rows.schema["__q"].dataType.names
    box = F.struct(*[F.col(c) for c in others]) if others else F.lit(None)
    judged = rows.select(box.alias("__row"), "__q.*").withColumn("votes", votes_of(rules))
    judged = judged.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(-odds)))
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
    return judged.select("__row.*", F.struct(*names, "base_failed", "posterior", "kept").alias("__q"))


def good_documents(documents: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns, whatever their names.

    Null, empty and very short texts go (see rated); a very long text is judged whole. Repeated rows are
    judged alike and each stays or goes. An empty table gives no rows.
    """
    others = [c for c in documents.columns if c != "text"]
    rows = documents.select(F.struct(F.lit(0).alias("text"), *others).alias("row"), "text")
    kept = rated(rows).where("__q.kept")
    return kept.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in documents.columns])
