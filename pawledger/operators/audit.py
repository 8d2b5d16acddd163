"""Bulk audits of the query log.

A request's steps sit in one array, so every check is a column expression on
the log row; only the final counts are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pawledger.functions import rules

# Words before a relation's name, and verbs of a statement.
RELATION_WORDS = ("from", "join", "update", "into", "table", "desc", "describe")
READING_VERBS = ("select", "values", "table")
WRITING_VERBS = ("insert", "update", "delete", "replace", "merge")
# The date columns.
DATE_COLUMN = r"(?:performed_date|invoice_date)"

# Strings and comments in one pass from left to right, so that neither is taken
# for the other; an open one ends with the text. The loops are possessive, so
# that long strings do not deepen Java's stack.
LITERAL = "|".join(
    [rf"({q})(?:[^{q}\\]++|\\.|{q}{q})*+(?:{q}|\\?\z)" for q in ("'", '"')]
    + [r"/\*.*?(?:\*/|\z)", r"(?:--|#)[^\r\n]*"]
)
TOKEN = r"`[^`]*`|\w+|[^\s\w]"


def _explode_steps(log: DataFrame) -> DataFrame:
    return log.select("request_id", F.explode("sql_steps").alias("step")).select(
        "request_id", "step.step_id", "step.sql"
    )


def strip_literals(sql: Column) -> Column:
    """SQL text with empty strings in place of full ones, and without comments."""
    return F.regexp_replace(sql, f"(?s){LITERAL}", "$1$1$2$2 ")


def tokens(code: Column) -> Column:
    """Names, words and signs of a stripped text in lower case; backticks are dropped."""
    found = F.regexp_extract_all(F.lower(code), F.lit(f"({TOKEN})"), F.lit(1))
    return F.transform(found, lambda t: F.replace(t, F.lit("`"), F.lit("")))


def main_verb(words: Column) -> Column:
    """The first verb outside parentheses: that of the statement, also after a list of CTEs."""
    verbs = list(READING_VERBS + WRITING_VERBS)
    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("verb"))

    def step(state: Column, word: Column) -> Column:
        depth = state["depth"] + F.when(word == "(", 1).when(word == ")", -1).otherwise(0)
        hit = state["verb"].isNull() & (state["depth"] == 0) & word.isin(verbs)
        return F.struct(depth.alias("depth"), F.when(hit, word).otherwise(state["verb"]).alias("verb"))

    return F.upper(F.aggregate(words, start, step)["verb"])


def audit_statement_type(
    log: DataFrame, allowed: Sequence[str] = rules.READ_ONLY_STATEMENTS
) -> DataFrame:
    """First word of every step, its verb, and whether it may run.

    A step that begins with WITH may run only if what follows the CTEs reads.
    """
    steps = _explode_steps(log)
    sql = F.btrim(F.coalesce(F.col("sql"), F.lit("")), F.lit(" \t\r\n"))
    word = F.upper(F.regexp_extract(sql, r"^(\S*)", 1))
    verb = main_verb(tokens(strip_literals(sql)))
    named = steps.select("request_id", "step_id", word.alias("first_word"), verb.alias("verb"))
    writes = F.upper(F.col("first_word")) == "WITH"
    writes = writes & F.coalesce(F.lower("verb").isin(list(WRITING_VERBS)), F.lit(False))
    return named.withColumn("is_allowed", F.col("first_word").isin(list(allowed)) & ~writes)


def _uses(words: Column, alias: Column) -> Column:
    """True if the tokens use ``alias`` as a table, view or CTE name.

    Names may be qualified (``db.alias``). An alias that is no single word is
    looked up as the run of its own tokens.
    """
    name = tokens(alias)
    size = F.size(name)

    def at(place: Column) -> Column:
        return F.get(words, place)

    def hit(i: Column) -> Column:
        same = F.slice(words, i + 1, size) == name
        before = at(i - 1).isin(list(RELATION_WORDS))
        qualified = (at(i - 1) == ".") & at(i - 3).isin(list(RELATION_WORDS))
        head = (at(i + size) == "as") & (at(i + size + 1) == "(")
        with_at = F.array_position(words, "with")
        cte = head & (with_at > 0) & (with_at <= i)
        return same & (
            F.coalesce(before, F.lit(False)) | F.coalesce(qualified, F.lit(False)) | F.coalesce(cte, F.lit(False))
        )

    return (size > 0) & F.exists(F.sequence(F.lit(0), F.size(words)), hit)


def audit_alias_refs(log: DataFrame) -> DataFrame:
    """Steps that read a result alias of their request as if it were a table."""
    aliases = F.array_distinct(
        F.filter(
            F.transform("sql_steps", lambda s: s["result_alias"]),
            lambda a: a.isNotNull() & (a != ""),
        )
    )
    steps = log.select(
        "request_id", aliases.alias("aliases"), F.explode("sql_steps").alias("step")
    ).select("request_id", "step.step_id", "aliases", strip_literals(F.col("step.sql")).alias("text"))
    # A plain search comes first: few texts hold a name at all.
    text = F.lower("text")
    named = F.filter("aliases", lambda a: text.contains(F.lower(a)))
    # One binding of the tokens serves all names of a step.
    found = F.get(
        F.transform(
            F.array(tokens(F.col("text"))),
            lambda words: F.filter(named, lambda a: _uses(words, a)),
        ),
        F.lit(0),
    )
    found = F.when(F.size(named) > 0, found)
    # Exploding the zero or one hits keeps Catalyst from moving a filter on
    # them below the stripping, where it would be done once per use.
    hit = F.explode(F.filter(F.array(found), lambda names: F.size(names) > 0))
    steps = steps.select("request_id", "step_id", hit.alias("found"))
    return steps.select(
        "request_id", "step_id", F.array_join("found", ", ").alias("offending_aliases")
    )


def rule_checks(
    code: Column, banned_tables: Sequence[str]
) -> dict[str, Column]:
    """Named checks of one stripped SQL text; true where the rule is broken.

    ``banned_tables`` are the full names of tables no step may read.
    """
    banned = F.array(*[F.lit(t.lower()) for t in banned_tables]).cast("array<string>")
    text = F.lower(code)
    mentioned = F.exists(banned, text.contains)
    reads = F.exists(banned, lambda t: F.exists(F.array(tokens(code)), lambda words: _uses(words, t)))

    def hit(word: str, pattern: str) -> Column:
        # A plain search for the word spares most texts the pattern.
        return text.contains(word) & F.regexp_like(code, F.lit("(?i)" + pattern))

    date_part = rf"\s*\(\s*(?:\w+\.)?{DATE_COLUMN}\s*\)\s*="
    has_month = hit("month", rf"\bMONTH{date_part}")
    return {
        "banned_table": mentioned & reads,
        "between_on_date": hit("between", rf"\b{DATE_COLUMN}\s+BETWEEN\b"),
        "sum_invoice_amount": hit("invoice_amount", r"\bSUM\s*\(\s*(?:\w+\.)?invoice_amount\b"),
        "text_cancelled_filter": hit(
            "cancelled", r"\bcancelled\b[^=<>]{0,20}=\s*(?:''|FALSE\b|TRUE\b)"
        ),
        "reserved_alias": hit("year_month", r"\bAS\s+`?year_month`?\b"),
        "year_without_month": hit("year", rf"\bYEAR{date_part}") & ~has_month,
    }


def broken_rules(log: DataFrame, banned_tables: Sequence[str]) -> DataFrame:
    """One row per step and broken rule."""
    steps = _explode_steps(log).filter(F.col("sql").isNotNull())
    steps = steps.withColumn("code", strip_literals(F.col("sql")))
    checks = rule_checks(F.col("code"), banned_tables)
    checked = steps.withColumns(checks)
    names = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in checks]))
    return checked.select("request_id", "step_id", F.explode(names).alias("rule"))


def audit_rules(log: DataFrame, banned_tables: Sequence[str]) -> DataFrame:
    """Broken rules with the number of steps and requests."""
    report = broken_rules(log, banned_tables).groupBy("rule").agg(
        F.count(F.lit(1)).alias("step_count"),
        F.countDistinct("request_id").alias("request_count"),
    )
    return report.orderBy("rule")


def error_class(
    error: Column,
    messages: Sequence[tuple[str, str]] = rules.ERROR_MESSAGES,
    default: str = rules.DEFAULT_ERROR_MESSAGE,
) -> Column:
    """Message shown for a raw error; NULL stays NULL."""
    text = F.lower(error)
    result = F.when(error.isNull(), F.lit(None).cast("string"))
    for pattern, message in messages:
        result = result.when(text.contains(pattern), message)
    return result.otherwise(default)


def sanitize_errors(log: DataFrame) -> DataFrame:
    """Failed requests with the message shown, which names the request."""
    shown = F.concat(
        error_class(F.col("error")), F.lit(" (Reference ID: "), F.col("request_id"), F.lit(")")
    )
    failed = log.filter(F.col("error").isNotNull())
    return failed.select("request_id", shown.alias("message"))


def classify_errors(log: DataFrame) -> DataFrame:
    """Failed requests per message."""
    failed = log.filter(F.col("error").isNotNull())
    report = failed.groupBy(error_class(F.col("error")).alias("message")).agg(
        F.count(F.lit(1)).alias("error_count")
    )
    return report.orderBy(F.desc("error_count"), "message")
