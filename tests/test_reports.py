"""Reports, filters, text functions, event logs; every query against DuckDB."""

import json
import os
from datetime import date

import duckdb
import numpy as np
import pandas as pd
import pytest
from parcelyze.functions import text as t
from parcelyze.operators.components import components
from parcelyze.operators.spatial_join import box_pairs
from parcelyze.plans import catalogue, reports
from parcelyze.streaming import events as ev
from parcelyze.tables import numbered
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def _same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    order = sorted(a.columns)
    a, b = (x[order].sort_values(order, na_position="first").reset_index(drop=True) for x in (a, b))
    for c in order:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True), c
        else:
            assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_against_duckdb(spark, small, duck, name):
    _same(catalogue.QUERIES[name](spark, small).toPandas(), duck.sql(catalogue.SQL[name]).df())


def test_entry_works_without_the_training_data_folder(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if not os.environ.get("SKIP_ENTRY"):
        assert e.entry(spark).count() > 0


def test_box_pairs_of_all_sizes(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        x, y = rng.uniform(0, 10, 2)
        w, h = (10.0 if i % 40 == 0 else float(rng.choice([0.0, 0.01, 0.5, 3.0])) for _ in range(2))
        rows.append((i, None if i % 3 else "a", float(x), float(y), float(x + w), float(y + h)))
    df = spark.createDataFrame(rows, "i long, layer string, minx double, miny double, maxx double, maxy double")
    right = df.select(F.col("i").alias("j"), "layer", "minx", "miny", "maxx", "maxy")
    got = [(r.i, r.j) for r in box_pairs(df, right, ["layer"]).collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]}
    assert len(got) == len(set(got)) and set(got) == want
    plan = box_pairs(df, right, ["layer"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_numbered(spark):
    df = numbered(spark.range(1000).withColumn("k", -F.col("id")), ["k"], "n")
    assert all(r.n == 999 - r.id for r in df.collect())


def test_parameters():
    today = date(2024, 3, 1)
    assert reports.report_range(None, None, today) == (date(2024, 2, 1), date(2024, 3, 2))
    assert reports.report_range("2024-01-01", "2024-01-01", today) == (date(2024, 1, 1), date(2024, 1, 2))
    for bad in (("2024-01-02", "2024-01-01"), ("2024-1-1", "2024-01-02"), ("2024-01-01", None), ("2023-01-01", "2024-01-02")):
        with pytest.raises(ValueError):
            reports.report_range(*bad, today)
    for skip, limit in ((-1, 10), (0, 0), (0, 51)):
        with pytest.raises(ValueError):
            reports.page_parameters(skip, limit)
    with pytest.raises(ValueError):
        reports.file_filters(file_type="exe")


def test_filters_take_wildcards_literally(spark):
    df = spark.createDataFrame([("100%", "a.GeoJSON", 0), ("1000", "b.kml", 2)], "name string, original_name string, identified_issues long").withColumn("created_at", F.current_timestamp())
    assert [r.name for r in df.where(reports.file_filters("0%")).collect()] == ["100%"]
    assert [r.name for r in df.where(reports.file_filters(file_type="geojson", has_issues=False)).collect()] == ["100%"]


def test_relations(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    users = spark.createDataFrame([("u", "advanced"), ("v", "free"), ("w", "free")], "user_id string, plan_code string")
    companies = spark.createDataFrame([("c", "u"), ("e", "v")], "company_id string, owner_id string")
    members = spark.createDataFrame([("c", "w"), ("e", "u")], "company_id string, user_id string")
    invitations = spark.createDataFrame([("c", "pending", "2025-01-01"), ("c", "pending", "2023-01-01"), ("c", "accepted", "2025-01-01")], "company_id string, status string, expires string").withColumn("expires_at", F.col("expires").cast("timestamp"))
    assert {r.user_id: r.company_id for r in reports.attributed_company(users, companies, members).collect()} == {"u": "c", "v": None, "w": "c"}
    assert [(r.members, r.invitations) for r in reports.seats(members, invitations, now).where("company_id = 'c'").collect()] == [(1, 1)]
    images = spark.createDataFrame([("c", "ready", None), ("c", "uploading", "2023-01-01"), ("e", "ready", None)], "company_id string, status string, x string").withColumn("expires_at", F.col("x").cast("timestamp"))
    assert reports.visible_images(images, companies, members, "w", now).count() == 1
    done = reports.repairs_applied(spark.createDataFrame([(1, None)], "gapsClosed long, spikesRemoved long")).first()
    assert done.repairs_applied == 1


def test_text_functions(spark):
    df = spark.createDataFrame([("  كتابي ", "A@B.co ", "2024-01-31T00:00:00.000Z", "2024-02-30")], "a string, b string, c string, e string")
    got = df.select(t.normalize_keyword(F.col("a")), t.normalize_email(F.col("b")), t.strict_timestamp(F.col("c")).isNotNull(), t.strict_day(F.col("e")), t.clean_text(F.lit("  a \t b ")), t.slug(F.lit("!!")), t.clamp(F.lit(float("nan")), 0.0, 1.0), t.is_uuid(F.lit("123e4567-e89b-42d3-a456-426614174000")), t.keywords(F.array(F.lit("B"), F.lit("b "), F.lit("")))).first()
    assert tuple(got) == ("کتابی", "a@b.co", True, None, "a b", "article", 0.0, True, ["b"])
    bad = spark.createDataFrame([("%%%",), ("bm90IGpzb24",)], "c string").select(t.parse_cursor(F.col("c")).alias("p")).collect()
    assert all(r.p is None or r.p.id is None for r in bad)


def test_status_machine():
    assert ev.next_status("dry-run-complete", "queued") == "queued" and ev.next_status("processing", "queued") == "processing"
    assert ev.next_status("completed", "failed") == "completed" and ev.next_status("cancelled", "completed") == "cancelled" and ev.next_status("failed", "progress") == "failed"
    assert ev.next_status("failed", "processing") == "processing" and ev.next_status("failed", "reset") == "dry-run-complete"
    with pytest.raises(ValueError):
        ev.next_status("queued", "nonsense")


def test_stream_equals_batch_and_plain_fold(spark, small, tmp_path):
    jobs = catalogue._job_events(spark, small).where("job < 40").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = {r.job: (r.status, r.progress, r.events) for r in ev.folded(jobs, "job", "ts", "event_id", "event", "value").collect()}
    for job in batch:
        status, progress, n = "dry-run-complete", 0.0, 0
        for r in sorted(jobs.where(F.col("job") == job).collect(), key=lambda r: (r.ts, r.event_id)) if job < 5 else ():
            progress, status, n = ev.next_progress(progress, status, r.event, r.value), ev.next_status(status, r.event), n + 1
        assert job >= 5 or batch[job] == (status, progress, n)
    jobs.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(jobs.schema).parquet(str(tmp_path / "in"))
    query = ev.status_stream(stream, "job", "ts", "event_id", "event", "value").writeStream.format("memory").queryName("jobs").outputMode("update").trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    assert {r.job: (r.status, r.progress, r.events) for r in spark.table("jobs").collect()} == batch


def test_issue_page(spark):
    issues = spark.createDataFrame([(i, "A" if i % 2 else "B", json.dumps({})) for i in range(20)], "issue_index long, code string, details string")
    assert [r.issue_index for r in reports.issue_page(issues, "A", 2, 3).collect()] == [5, 7, 9]
