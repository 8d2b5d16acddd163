"""Stored state: months of the fact, runs written twice, client state, bitmaps."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from pawledger.functions import periods as P
from pawledger.operators import history, trends
from pawledger.sources import sinks, tables, views
from test_plans import plan


def lines(make, n=400, seed=1):
    rng = random.Random(seed)
    return make(
        "invoices",
        [
            {
                "invoice_id": str(k),
                "client_id": rng.choice([None, rules_client, *[f"c{i}" for i in range(40)]]),
                "patient_species": rng.choice(["Canine", "Feline", None]),
                "cancelled": int(rng.random() < 0.1),
                "total": rng.randrange(100),
                "performed_date": rng.choice([None, str(date(2024, 1, 1) + timedelta(days=rng.randrange(120)))]),
            }
            for k in range(n)
        ],
    )


rules_client = history.PHANTOM_CLIENT


def test_a_stored_fact_reads_only_its_months(spark, make, tmp_path):
    path, data = str(tmp_path / "fact"), lines(make)
    sinks.write_fact(data, path)
    fact = tables.read_table(spark, "invoices", {"path": path})
    assert fact.count() == data.count()
    february = trends.species_for_month(fact, 2024, 2)
    assert "PartitionFilters: [isnotnull(performed_month" in plan(february)
    assert sorted(map(str, rows(february))) == sorted(map(str, rows(trends.species_for_month(data, 2024, 2))))
    folders = {f.split("performed_month=")[1].split("/")[0] for f in P.period_rows(fact, P.month(2024, 2)).select("invoice_id").inputFiles()}
    assert "202402" in folders
    weekly = trends.weekly_species_trend(fact, date(2024, 4, 10), n=3)
    assert "(performed_month" in plan(weekly)
    assert sorted(map(str, rows(weekly))) == sorted(map(str, rows(trends.weekly_species_trend(data, date(2024, 4, 10), n=3))))
    # A month that is written again is replaced, the others stay.
    sinks.write_fact(P.period_rows(data, P.month(2024, 2), active_only=False).limit(3), path)
    again = spark.read.parquet(path)
    assert again.filter("performed_month = 202402").count() == 3
    others = P.in_period(P.SERVICE_DATE, P.month(2024, 2))
    assert again.filter("performed_month IS NULL OR performed_month <> 202402").count() == data.filter(~F.coalesce(others, F.lit(False))).count()


def test_a_run_written_twice_has_its_rows_once(spark, tmp_path):
    for fmt in ("parquet", "json", "csv"):
        path = str(tmp_path / fmt)
        sinks.write_run(spark.range(5), path, "2024-01-01.a", fmt)
        sinks.write_run(spark.range(7), path, "b", fmt)
        sinks.write_run(spark.range(3), path, "2024-01-01.a", fmt)
        back = lambda: dict(map(tuple, spark.read.format(fmt).schema("id long, run_id string").option("header", True).load(path).groupBy("run_id").count().collect()))
        assert back() == {"2024-01-01.a": 3, "b": 7}
        sinks.write_run(spark.range(0), path, "b", fmt)
        assert back() == {"2024-01-01.a": 3}
    with pytest.raises(ValueError):
        sinks.write_run(spark.range(1), str(tmp_path / "x"), "a/b")


def test_client_state_day_by_day_equals_the_full_scan(spark, make, tmp_path):
    data, path = lines(make), str(tmp_path / "state")
    last = date(2024, 2, 20)
    history.advance(data, path, last)
    for _ in range(5):
        day = last + timedelta(days=1)
        state = history.advance(data, path, day, since=last)
        last = day
    found = sorted(rows(state))
    assert found == sorted(rows(history.client_days(data, P.up_to(last))))
    again = history.advance(data, path, last, since=last - timedelta(days=1))
    assert sorted(rows(again)) == found
    with pytest.raises(ValueError):
        history.advance(data, path, last, since=last)
    clients = make("clients", [{"client_id": "new", "first_activity": "2024-01-05"}, {"client_id": "late", "first_activity": "2024-03-05"}])
    known = {r[0] for r in rows(history.known_clients(again, clients, last + timedelta(days=1)))}
    assert known == {r[0] for r in found} | {"new"}
    assert history.client_days(make("invoices", [])).count() == 0


def test_a_day_reads_the_state_and_that_day(make, tmp_path):
    day = history.client_days(lines(make), P.day(date(2024, 2, 3)))
    assert {(r.first_day, r.last_day, r.visit_days) for r in day.collect()} == {(date(2024, 2, 3), date(2024, 2, 3), 1)}


def test_bitmaps_count_like_count_distinct(spark, make, tmp_path):
    data = lines(make, 900)
    first = P.exclude_phantom(P.period_rows(data, P.month(2024, 1)))
    known = history.numbered(first, str(tmp_path / "a"))
    known.write.parquet(str(tmp_path / "known"))
    known = spark.read.parquet(str(tmp_path / "known"))
    numbers = history.numbered(P.exclude_phantom(data), str(tmp_path / "b"), known)
    got = sorted(r.number for r in numbers.collect())
    assert got == list(range(1, len(got) + 1)) and known.join(numbers, ["client_id", "number"]).count() == known.count()
    days = history.day_bitmaps(data, numbers, dims={"species": "patient_species"})
    clients = P.exclude_phantom(P.period_rows(data))
    for period in (None, P.month(2024, 2), P.Period(date(2024, 1, 10), date(2024, 3, 3)), P.month(2030, 1)):
        want = clients.filter(P.in_period(P.SERVICE_DATE, period))
        exact = want.groupBy(F.col("patient_species").alias("species")).agg(F.countDistinct("client_id"))
        found = history.distinct_counts(days, {"species": "species"}, period)
        assert sorted(map(str, rows(found))) == sorted(map(str, rows(exact)))
        total = history.distinct_counts(days, period=period).first()[0]
        assert total == want.agg(F.countDistinct("client_id")).first()[0]


def test_numbers_beyond_one_bucket(spark):
    ids = spark.range(1, 100_001).select(F.col("id").cast("string").alias("client_id"), F.col("id").alias("number"))
    bucket = F.bitmap_bucket_number("number").alias("bucket")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    days = [ids.filter(f"number % {k} = 0").groupBy(F.lit(date(2024, 1, k)).alias("day"), bucket).agg(bits) for k in (2, 3)]
    found = history.distinct_counts(days[0].unionByName(days[1])).first()[0]
    assert found == 50_000 + 33_333 - 16_666


def test_parameters_are_values(spark, make):
    data = make("invoices", [{"invoice_id": "1", "patient_species": "Canine"}, {"invoice_id": "2", "patient_species": "x' OR '1'='1"}])
    views.register_views(spark, {"invoices": data}, prefix="p_")
    ask = lambda sql, args: [r[0] for r in views.ask(spark, sql, args).collect()]
    assert ask("SELECT invoice_id FROM p_invoices WHERE patient_species = :s", {"s": "Canine"}) == ["1"]
    assert ask("SELECT invoice_id FROM p_invoices WHERE patient_species = ?", ["x' OR '1'='1"]) == ["2"]
    assert ask("WITH q AS (SELECT * FROM p_invoices) SELECT invoice_id FROM q WHERE invoice_id = :i ;", {"i": "2"}) == ["2"]
    assert ask("with q as (select 1 as a) select a from q -- a remark", None) == [1]
    with pytest.raises(ValueError):
        views.ask(spark, "WITH q AS (SELECT 1) SELEC 1")
