"""One registered query for each operator, over whole tables, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline

from . import (
    chat,
    licenses,
    near_documents,
    near_lines,
    packing,
    periodic_runs,
    personal_data,
    quality_model,
    quality_rules,
    secrets,
    suffix_arrays,
    token_ids,
    vector_codes,
)
from .columns import BLANKS, let, words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ranked ids in files, and what is read back."""
    return token_ids.token_ids(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences in token-budget batches of length buckets."""
    return packing.packed(packing.token_counts(table(spark, sf_dir, "documents")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents, and the longest verbatim match of each."""
    found = suffix_arrays.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model", "top_score")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share 85 % of their five-word shingles."""
    return near_documents.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels that are not held out."""
    return quality_model.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the weighed rules for all documents."""
    rows = quality_rules.rated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"]
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), *[f"__q.{name}" for name in names])


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in all documents."""
    return licenses.found_licenses(table(spark, sf_dir, "documents"))


#: Texts that hold the marks of other templates.
MARKED = "\\### Assistant: </turn> ok"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one with marks in its texts, rendered and read back."""
    marked = F.lit(MARKED)
    turns = [F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role")) for k, role in enumerate(("user", "assistant"))]
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.inline(F.array(*turns)), marked.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return chat.digest(chat.rendered(chat.folded(chat.as_events(rows))))


OP9_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{MARKED}'
  UNION ALL SELECT -7, 1, 'assistant', '{MARKED}'
), turns AS (
  SELECT conv_id, turn, text AS sorted_text, role AS sorted_role, coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows
), marked AS (
  SELECT *,
    replace(replace(replace(role, '~', '~0'), '<', '~1'), '>', '~2') AS shown_role,
    replace(replace(replace(text, '~', '~0'), '<', '~1'), '>', '~2') AS shown_text
  FROM turns
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, sorted_role NULLS FIRST, sorted_text NULLS FIRST) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, sorted_role NULLS FIRST, sorted_text NULLS FIRST)
      FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length('<' || shown_role || '>' || shown_text || '</turn>' || chr(10))) AS formatted_chars
  FROM marked GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM joined
"""


def op10_near_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that repeat, with counts and a digest of the text left."""
    rows = near_lines.deduplicated(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        F.col("__lines").cast("long").alias("n_lines"),
        F.col("__removed").cast("long").alias("n_removed"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and a digest of the base spans, and all spans."""
    rows = personal_data.personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def shown(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(name):
        return F.size(F.filter(base, lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    counts = [count(kind.name) for kind in personal_data.BASE]
    return rows.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown("spans").alias("spans"))


def with_cycles(documents: DataFrame) -> DataFrame:
    """The documents of op12: with h = crc32(doc_id) and g = h // 10, a text of n words with h % 10 = 0
    repeats its words from a = g % n on with a period of 1 + (n - a) // (3 + g % 8)."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def cycled(parts):
        def word(a, p):
            at = F.sequence(F.lit(0), F.size(parts) - 1)
            return F.transform(at, lambda i: F.get(parts, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))

        def from_a(a):
            period = 1 + F.floor((F.size(parts) - a) / (3 + g % 8))
            return let(period, lambda p: F.array_join(word(a, p), " "))

        return F.when(F.size(parts) > 0, let(g % F.size(parts), from_a))

    text = F.when(h % 10 == 0, let(words(F.col("text"), BLANKS), cycled)).otherwise(F.col("text"))
    return documents.select("doc_id", text.alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, and digests of them and of the collapsed texts."""
    rows = periodic_runs.periodic_runs(with_cycles(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    shown = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = rows.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.col3")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.col2")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(shown, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as product codes, with their errors and a digest of the codebooks."""
    rows = vector_codes.compressed(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SOLID = r"[^\x20\x09-\x0D]+"


def words_sql(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), {UPPER_LOWER}), '{pattern}')"


OP3_SQL = f"""
WITH d AS (SELECT doc_id, {words_sql("text", ALNUM)} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words_sql("text", ALNUM)} AS w FROM benchmark),
bp AS (
  SELECT item, n, i AS j, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), bw AS (SELECT DISTINCT item, n, g FROM bp
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM bw) k ON len(w) >= n)
), hits AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, g)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
), diagonals AS (
  SELECT doc_id, item, n, i - j AS shift, i - row_number() OVER (PARTITION BY doc_id, item, n, i - j ORDER BY i) AS run
  FROM (SELECT DISTINCT doc_id, item, n, i, j FROM dw JOIN bp USING (n, g))
), longest AS (
  SELECT doc_id, max(size) AS longest
  FROM (SELECT doc_id, count(*) + n - 1 AS size FROM diagonals GROUP BY doc_id, item, n, shift, run) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0) AS longest
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

OP5_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {words_sql("text", SOLID)} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], chr(31)) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach(x, root) AS (SELECT x, x FROM links UNION SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.x
), roots AS (SELECT x, min(root) AS root FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id,
  d.doc_id = coalesce(root, d.doc_id) AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN roots ON x = d.doc_id
"""


OP10_SQL = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, i AS no, parts[i] AS line, trim(regexp_replace(translate(parts[i], {UPPER_LOWER}), '[ \\t-\\r]+', ' ', 'g')) AS n
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
        FROM documents WHERE text IS NOT NULL)
), t AS (SELECT n, row_number() OVER () AS id, min({{'d': doc_id, 'no': no}}) AS owner FROM l WHERE n <> '' GROUP BY n
), s AS (
  SELECT DISTINCT id, substring(n, i, 10) AS g FROM (SELECT id, n, unnest(range(1, greatest(length(n) - 9, 1) + 1)) AS i FROM t)
), sizes AS (SELECT id, count(*) AS c FROM s GROUP BY id
), common AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.id <> b.id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.id = x JOIN sizes q ON q.id = y WHERE 100 * common.c >= 80 * (p.c + q.c - common.c)
), reach(x, root) AS (SELECT x, x FROM links UNION SELECT k.y, r.root FROM reach r JOIN links k ON k.x = r.x
), roots AS (SELECT x, min(root) AS root FROM reach GROUP BY x
), named AS (SELECT id, n, coalesce(root, id) AS root, owner FROM t LEFT JOIN roots ON x = id
), firsts AS (SELECT root, min(owner) AS first FROM named GROUP BY root
), marked AS (
  SELECT l.doc_id, l.no, l.line, first IS NULL OR first = {{'d': l.doc_id, 'no': l.no}} AS stays
  FROM l LEFT JOIN named USING (n) LEFT JOIN firsts USING (root)
), told AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (stays), '')) AS text_sha256
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, text_sha256
FROM documents d LEFT JOIN told ON told.doc_id = d.doc_id
"""

OP13_START = """
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding, len(embedding) // 16 AS width FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), x AS (
  SELECT r, (i - 1) // width AS part, (i - 1) % width AS j, CAST(floor(256 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT r, width, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM kept)
), first AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64
), book0 AS (SELECT part, entry, j, x AS c FROM x JOIN first USING (r))"""


def op13_near(k: int) -> str:
    """The nearest entry of each part, by the codebooks of a round."""
    return f""", far{k} AS (
  SELECT r, part, entry, sum((x - c) * (x - c)) AS d FROM x JOIN book{k} USING (part, j) GROUP BY r, part, entry
), near{k} AS (SELECT r, part, min({{'d': d, 'entry': entry}}) AS best FROM far{k} GROUP BY r, part)"""


def op13_moved(k: int) -> str:
    """The codebooks after a round."""
    return f""", mean{k} AS (
  SELECT part, best.entry AS entry, j, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS c
  FROM x JOIN near{k} USING (r, part) GROUP BY part, best.entry, j
), book{k + 1} AS (
  SELECT part, entry, j, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (part, entry, j))"""


OP13_SQL = f"""{OP13_START}{op13_near(0)}{op13_moved(0)}{op13_near(1)}{op13_moved(1)}{op13_near(2)}
, codes AS (
  SELECT r, string_agg(lpad(lower(hex(best.entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near2 GROUP BY r
), coded AS (SELECT vec_id, label, code, error FROM kept JOIN codes USING (r)
), sums AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded GROUP BY label
), digest AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM coded c JOIN sums s ON c.label IS NOT DISTINCT FROM s.label, digest
"""


QUERIES = (
    op1_token_ids,
    op2_packing,
    op3_decontamination,
    op4_secrets,
    op5_near_duplicates,
    op6_quality_model,
    op7_quality_rules,
    op8_licenses,
    op9_chat,
    op10_near_lines,
    op11_personal_data,
    op12_periodic_runs,
    op13_vector_codes,
)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in QUERIES} | {"pipeline": corpus_pipeline.run}


def statements() -> dict[str, str]:
    return {
        "op3_decontamination": OP3_SQL,
        "op5_near_duplicates": OP5_SQL,
        "op9_chat": OP9_SQL,
        "op10_near_lines": OP10_SQL,
        "op13_vector_codes": OP13_SQL,
    }
