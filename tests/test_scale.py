"""What only larger tables show: ties, halves, joins that must not be broadcast, signals that must not be shuffled."""

import duckdb
import numpy as np
import pytest

from pulseframe.plans.catalog import QUERIES, SQL


def _both(spark, name, table, rows, folder):
    """Sorted rows of a query and of its SQL on a table of its own."""
    rows.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    df = QUERIES[name](spark, str(folder))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall()
    return sorted(map(tuple, df.collect())), sorted(map(tuple, want))


def test_means_of_halves(spark, tmp_path):
    """A mean that ends in .05 rounds up in both, whatever order the prices are added in."""
    cents = [[1_000_000 + c * 7919 * j % 9_973_777 for j in (1, 2, 3)] for c in range(2000)]
    cents = [c + [8_000_000 + (20 - sum(c)) % 40] for c in cents]
    rows = spark.createDataFrame([(i * 4 + j, i, x / 100) for i, c in enumerate(cents) for j, x in enumerate(c)], "o_orderkey long, o_custkey long, o_totalprice double")
    got, want = _both(spark, "report_lines", "orders", rows, tmp_path)
    said = {i: f"{(sum(c) + 20) // 40 / 10:,.1f}" for i, c in enumerate(cents)}
    assert got == want and all(text == f"Mean value {said[i]}, usual." for i, no, text in got if no == 2)


def test_equal_stretches(spark, tmp_path):
    """Stretches that are equal but for their ids stay in one run."""
    rows = spark.range(300_000).selectExpr("id AS event_id", "id % 5 AS user_id", "element_at(array('click', 'error', 'purchase'), cast(1 + hash(id DIV 15000, id % 7) % 2 + 1 AS int)) AS event_type")
    got, want = _both(spark, "expanded_stretches", "events", rows, tmp_path)
    assert got == want and sum(r[4] for r in got) == 300_000


def test_plans(spark):
    """Sheets are drawn once; rows of exploded cases, and leads of pages, meet by aggregates and windows, as their planned size is too small."""
    plan = lambda name: QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan("sheet_to_measurements") and "Join" not in plan("lead_order_mismatch")
    assert all(plan(name).count("Join LeftOuter") == 1 and plan(name).count("Join ") == 1 for name in ("conclusion_rows", "result_rows", "results_tsv", "deviations"))


def test_samples_stay_in_their_task(spark):
    """Drawn samples and images are not shuffled: one pass a page from its beats on, in several tasks a core."""
    from pyspark.sql import functions as F

    for name in ("detect_beats", "delineate_beats", "page_measurements", "sheet_to_measurements", "trace_sheets"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("InArrow") == 1 and "gray" not in plan and (name == "trace_sheets" or "mv" not in plan), name
    tasks = QUERIES["trace_sheets"](spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > spark.sparkContext.defaultParallelism / 2


def test_samples_of_cases_are_read_once(spark, monkeypatch):
    """Drawing pages, finding beats and all that needs every lead is one pass: samples of all leads are not written, and only one table comes from a kernel."""
    from pulseframe.operators import analysis
    from pulseframe.plans import case_queries

    class Seen(Exception):
        pass

    plans, write = {}, analysis.cut

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        if name == "features":
            raise Seen
        return write(df, name)

    for module in (analysis, case_queries):
        monkeypatch.setattr(module, "cut", watched)
    with pytest.raises(Seen):
        QUERIES["analyzed_cases"](spark, "/root/testdata/sf0.001")
    assert sum(p.count("InArrow") for p in plans.values()) == 1 and all("mv" not in p.replace("ii_mv", "").replace("mv_per_px", "") for p in plans.values())


def test_means_of_likeness_are_taken_once(spark):
    """Correlation of long windows is linear in their length, and sorts of a median are not repeated."""
    import time

    from pyspark.sql import functions as F

    from pulseframe.operators.analysis import likeness

    n = 6000
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: (k * 37 % 101).cast("double")).alias("a"), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: (k * 53 % 97 + k % 7).cast("double")).alias("b"))
    began = time.time()
    a, b, r = df.select("a", "b", likeness(F.col("a"), F.col("b"))).first()
    assert time.time() - began < 8 and abs(r - np.corrcoef(a, b)[0, 1]) < 1e-9
