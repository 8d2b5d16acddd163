import json
import random

import pytest
from pyspark.sql import functions as F

from pawledger.functions import periods as P
from pawledger.functions import rules
from pawledger.operators import audit
from pawledger.sources import scans, sinks, tables, views

from conftest import rows


def log(make, *sqls, error=None, aliases=None):
    steps = [
        (i, "", s, (aliases or {}).get(i, f"step_{i}"), True, 0, None, None, None)
        for i, s in enumerate(sqls, 1)
    ]
    return make("query_log", [{"request_id": "R1", "sql_steps": steps, "error": error}])


def test_statement_type(make):
    data = log(make, "select 1", " \n With x as (select 1) select 1", "DELETE FROM t", "", None)
    got = rows(audit.audit_statement_type(data))
    assert [(g[2], g[4]) for g in got] == [
        ("SELECT", True),
        ("WITH", True),
        ("DELETE", False),
        ("", False),
        ("", False),
    ]


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("SELECT * FROM step_1", "step_1"),
        ("select * from a join db.step_1 b", "step_1"),
        ("WITH step_1 AS (SELECT 1) SELECT 1", "step_1"),
        ("SELECT step_1 FROM t", None),
        ("SELECT 'FROM step_1' FROM t", None),
        ("SELECT 'it''s FROM step_1', \"FROM step_1\" FROM t", None),
        ("SELECT 1 -- FROM step_1\n FROM t", None),
        ("SELECT 1 # FROM step_1", None),
        ("SELECT 1 /* FROM \n step_1 */ FROM t", None),
        ("SELECT * FROM step_10", None),
        ("DESCRIBE step_1", "step_1"),
    ],
)
def test_alias_references(make, sql, expected):
    got = rows(audit.audit_alias_refs(log(make, sql)))
    assert [g[2] for g in got] == ([expected] if expected else [])


def test_alias_with_special_characters(make):
    for alias in ("b(c", "a\\Eb(c", "é+b"):
        data = log(make, f"SELECT * FROM db.{alias} x", "SELECT 1", aliases={1: alias})
        assert [g[2] for g in rows(audit.audit_alias_refs(data))] == [alias]
    assert rows(audit.audit_alias_refs(log(make, "SELECT 1", None, aliases={2: ""}))) == []


def stripped(text):
    """What ``strip_literals`` gives, one character after the other."""
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if c in "'\"":
            i += 1
            while i < len(text) and (text[i] != c or text[i + 1 : i + 2] == c):
                i += 2 if text[i] in (c, "\\") else 1
            out, i = out + c + c + " ", i + 1
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            out, i = out + " ", len(text) if end < 0 else end + 2
        elif c == "#" or text.startswith("--", i):
            while i < len(text) and text[i] not in "\r\n":
                i += 1
            out += " "
        else:
            out, i = out + c, i + 1
    return out


def test_stripping_equals_a_state_machine(spark):
    rng = random.Random(1)
    letters = "''\"\"\\ab-#/*\n "
    texts = ["".join(rng.choices(letters, k=rng.randrange(14))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, sql string")
    got = [r[1] for r in df.select("i", audit.strip_literals(F.col("sql"))).orderBy("i").collect()]
    for text, code in zip(texts, got):
        assert code == stripped(text), repr(text)


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("SELECT 'a -- b' AS n, x FROM step_1", "step_1"),
        ("SELECT '/* ' AS a FROM step_1 WHERE b = ' */'", "step_1"),
        ("SELECT 1 /* it's */ FROM step_1 -- don't", "step_1"),
        ("SELECT '# ' AS a FROM `step_1`", "step_1"),
        ("SELECT \"-- '\" AS a, ' FROM step_1", None),
        ("WITH a AS (SELECT 1), step_1 AS (SELECT 2) SELECT 1", "step_1"),
        ("SELECT step_1 AS (x) FROM t", None),
    ],
)
def test_quotes_and_comments(make, sql, expected):
    got = rows(audit.audit_alias_refs(log(make, sql)))
    assert [g[2] for g in got] == ([expected] if expected else [])


@pytest.mark.parametrize(
    "sql, verb, allowed",
    [
        ("WITH q AS (SELECT 1 AS a) INSERT INTO t SELECT a FROM q", "INSERT", False),
        ("WITH q AS (SELECT ')' AS a), r AS (SELECT 1) DELETE FROM t", "DELETE", False),
        ("with q as (select 1) select 'delete'", "SELECT", True),
        ("EXPLAIN DELETE FROM t", "DELETE", True),
        ("SHOW TABLES", None, True),
    ],
)
def test_verb_after_ctes(make, sql, verb, allowed):
    got = rows(audit.audit_statement_type(log(make, sql)))
    assert [(g[3], g[4]) for g in got] == [(verb, allowed)]


def test_very_long_literals(make):
    text = "x''y" * 20_000
    data = log(make, f"SELECT '{text}' FROM step_1")
    assert [g[2] for g in rows(audit.audit_alias_refs(data))] == ["step_1"]


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("SELECT * FROM db.`old_clients`", "banned_table"),
        ("SELECT 1 FROM t WHERE i.performed_date BETWEEN '2024-01-01' AND '2024-02-01'", "between_on_date"),
        ("SELECT SUM( i.invoice_amount ) FROM t", "sum_invoice_amount"),
        ("SELECT 1 FROM t WHERE cancelled = 'FALSE'", "text_cancelled_filter"),
        ("SELECT 1 FROM t WHERE UPPER(COALESCE(cancelled, 'FALSE')) = 'FALSE'", "text_cancelled_filter"),
        ("SELECT 1 AS year_month", "reserved_alias"),
        ("SELECT 1 FROM t WHERE YEAR(performed_date) = 2024", "year_without_month"),
        ("SELECT 1 FROM t WHERE YEAR(d.performed_date) = 2024 AND MONTH(d.performed_date) = 1", None),
        ("SELECT 1 FROM t WHERE cancelled = 0 AND name = 'FALSE'", None),
        ("SELECT 'FROM old_clients BETWEEN' FROM t", None),
    ],
)
def test_rules(make, sql, expected):
    got = [g[2] for g in rows(audit.broken_rules(log(make, sql), ["old_clients"]))]
    assert got == ([expected] if expected else [])


def test_error_classes(make):
    for raw, pattern in (
        ("HTTP 429 timeout", "429"),
        ("Unknown column 'x'", "unknown column"),
        ("Request TIMED OUT", "timed out"),
    ):
        message = dict(rules.ERROR_MESSAGES)[pattern]
        data = log(make, error=raw)
        assert rows(audit.classify_errors(data)) == [(message, 1)]
        assert rows(audit.sanitize_errors(data)) == [("R1", f"{message} (Reference ID: R1)")]
    assert rows(audit.classify_errors(log(make, error="odd"))) == [(rules.DEFAULT_ERROR_MESSAGE, 1)]
    assert rows(audit.classify_errors(log(make, error=None))) == []


def test_run_log_round_trip(spark, make, tmp_path):
    result = spark.range(120).select("id", F.lit(None).cast("string").alias("note"))
    step = sinks.result_step(result, 1, "ids", "SELECT id", "ids")
    record = step.select(
        F.lit("2024-01-01T00:00:00").alias("timestamp"),
        F.lit("R1").alias("request_id"),
        F.array(F.struct(*[F.col(f.name) for f in tables.SQL_STEP.fields])).alias("sql_steps"),
    )
    log_df = make("query_log", []).unionByName(record, allowMissingColumns=True)
    for fmt in ("json", "parquet"):
        path = str(tmp_path / fmt)
        sinks.append_run_log(log_df, path, fmt)
        sinks.append_run_log(log_df, path, fmt)
        back = tables.read_table(spark, "query_log", {"format": fmt, "path": path})
        first = back.first()["sql_steps"][0]
        assert back.count() == 2
        assert (first["row_count"], first["columns"]) == (120, ["id", "note"])
        assert len(first["data_preview"]) == sinks.PREVIEW_ROWS
        assert json.loads(first["data_preview"][0])["note"] is None


def test_long_previews_are_cut(make):
    steps = [(1, "", "SELECT 1", "a", True, 90, ["x"], None, [str(i) for i in range(90)])]
    data = make("query_log", [{"request_id": "R1", "sql_steps": steps}])
    cut = sinks.shorten_previews(data).first()["sql_steps"][0]
    assert cut["data_preview"] == [str(i) for i in range(50)] and cut["row_count"] == 90


def test_tidy_export(spark, make, tmp_path):
    frame = spark.createDataFrame([("Revenue", "Total", 1.0)], "section string, label string, this_week double")
    for fmt in ("csv", "parquet", "json"):
        path = str(tmp_path / fmt)
        sinks.write_tidy(frame, path, fmt)
        reader = spark.read.format(fmt)
        back = (reader.option("header", True) if fmt == "csv" else reader).load(path)
        assert back.count() == 1 and set(back.columns) == set(frame.columns)


def test_read_table(spark, make, tmp_path):
    inv = make("invoices", [{"invoice_id": "1", "total": 5, "performed_date": "2024-01-01"}])
    inv.write.parquet(str(tmp_path / "p"))
    back = tables.read_table(spark, "invoices", {"path": str(tmp_path / "p")})
    assert back.schema == tables.INVOICES and back.count() == 1
    inv.write.option("header", True).csv(str(tmp_path / "c"))
    csv = tables.read_table(spark, "invoices", {"format": "csv", "header": "true", "path": str(tmp_path / "c")})
    assert rows(csv.select("total", "performed_date")) == rows(inv.select("total", "performed_date"))


def test_jdbc_options():
    cfg = {"format": "jdbc", "url": "jdbc:mysql://host/db"}
    given = {"url": cfg["url"], "dbtable": "stocks", "fetchsize": "10000", "preferTimestampNTZ": "true"}
    assert tables.reader_options("stocks", {**cfg, "single_connection": "true"}) == ("jdbc", given)
    split = {"partitionColumn": "id", "lowerBound": "0", "upperBound": "9", "numPartitions": "3"}
    assert tables.reader_options("stocks", {**cfg, **split}) == ("jdbc", {**given, **split})
    with pytest.raises(ValueError):
        tables.reader_options("stocks", cfg)
    with pytest.raises(ValueError):
        tables.reader_options("stocks", {**cfg, "partitionColumn": "clinic_id"})
    with pytest.raises(ValueError):
        tables.reader_options("stocks", {"format": "parquet"})


def test_ad_hoc_sql(spark, make):
    data = {
        "invoices": make("invoices", [{"plan_category_name": "Pet  Shop", "patient_id": "p"}]),
        "patients": make("patients", []),
    }
    views.register_views(spark, data, prefix="t_")
    got = views.ask(spark, "SELECT logical_category, SUM(total) AS revenue FROM t_category_normalized GROUP BY 1")
    assert rows(got) == [("Pet  Shop", 0)]
    assert views.ask(spark, "select life_stage from t_invoice_life_stage").count() == 1
    for bad in ("DROP VIEW t_invoices", "", "  insert into t_invoices values (1)"):
        with pytest.raises(ValueError):
            views.ask(spark, bad)


def test_ad_hoc_sql_never_writes(spark):
    spark.sql("CREATE TABLE kept_rows (a INT) USING parquet")
    try:
        with pytest.raises(ValueError):
            views.ask(spark, "WITH q AS (SELECT 1 AS a) INSERT INTO kept_rows SELECT a FROM q")
        with pytest.raises(ValueError):
            views.ask(spark, "with q as (select 1 as a) from q insert into kept_rows select a")
        assert views.ask(spark, "SELECT * FROM kept_rows").count() == 0
        assert views.ask(spark, "WITH q AS (SELECT 1 AS a) SELECT a FROM q WHERE a IN (SELECT 1)").count() == 1
        assert views.ask(spark, "SHOW TABLES").count() > 0
        assert views.ask(spark, "DESCRIBE kept_rows").count() == 1
    finally:
        spark.sql("DROP TABLE kept_rows")


def test_unknown_columns_are_kept(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("SELECT '1' AS invoice_id, 5 AS total, 7 AS colour, 1.5D AS Discount").write.parquet(path)
    back = tables.read_table(spark, "invoices", {"path": path})
    assert set(tables.INVOICES.names) <= set(back.columns) and back.columns[-1] == "colour"
    row = back.first()
    assert (str(row.total), row.colour, str(row.discount), row.tax_amount) == ("5.00", 7, "1.50", None)
    spark.sql("SELECT 'c' AS clinic_id, 'n' AS clinic_name, 'x' AS clinic_city, 's' AS clinic_state, 'r' AS currency, 3 AS beds").write.csv(str(tmp_path / "c"))
    more = tables.read_table(spark, "clinic", {"format": "csv", "path": str(tmp_path / "c"), "more_columns": "beds INT"})
    assert tuple(more.first()) == ("c", "n", "x", "s", "r", 3)


def test_preview_and_count_in_one_pass(spark):
    result = spark.range(0, 1000, 1, 7).orderBy(F.desc("id"))
    step = sinks.result_step(result, 1, "", "", "a")
    row = step.first()
    assert row.row_count == 1000
    assert [json.loads(r)["id"] for r in row.data_preview] == list(range(999, 949, -1))
    assert sinks.result_step(spark.range(0), 1, "", "", "a").first().data_preview == []


def test_scans(spark, make):
    assert rows(scans.unavailable(spark, "staff")) == [("Data not available: staff",)]
    empty = scans.data_coverage(make("invoices", []), P.month(2024, 1))
    assert rows(empty) == [(None, None, False)]
    inv = make("invoices", [{"patient_species": s} for s in ("Canine", None, "Canine")])
    assert rows(scans.distinct_values(inv, "patient_species")) == [("Canine",)]
    paid = make("payments", [{"payment_id": d, "payment_date": d} for d in ("2024-01-31", "2024-02-01")])
    found = scans.payments_scan(paid, P.month(2024, 1)).select("payment_id")
    assert rows(found) == [("2024-01-31",)] and scans.payments_scan(paid).count() == 2


def test_no_merge_of_previews_grows_with_the_tasks(spark):
    """10,000 tasks: every merge reads a few lists, the last one only those of the last groups."""
    tasks = 10_000
    first = sinks.first_rows(spark.range(0, 3 * tasks, 1, tasks), F.col("id"))
    row = first.first()
    assert (row["row_count"], row["first"]) == (3 * tasks, list(range(50)))
    # Each task has up to 50 rows, so a merge of MERGED lists reads a few thousand.
    assert sinks.MERGED * sinks.PREVIEW_ROWS <= 4000 and sinks.MERGED**sinks.LEVELS > 10**7
    tree = first._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("Aggregate [") == sinks.LEVELS


def test_previews_follow_the_order_of_tasks(spark):
    sparse = spark.range(0, 40_000, 1, 300).where("id % 700 = 3")
    step = sinks.result_step(sparse, 1, "", "", "a").first()
    assert step.row_count == 58
    assert [json.loads(r)["id"] for r in step.data_preview] == [3 + 700 * k for k in range(50)]
