"""Operators on stretches of a page: page, span_id, kind, start_ms, end_ms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def merged(spans: DataFrame, key: list[str], gap_ms: float = 0.0) -> DataFrame:
    """Stretches of the same key that overlap, touch, or lie at most gap_ms apart, as one."""
    order = W.partitionBy(*key).orderBy("start_ms", "end_ms")
    s = spans.withColumn("_reach", F.max("end_ms").over(order.rowsBetween(W.unboundedPreceding, -1)))
    s = s.withColumn("_no", F.sum((F.coalesce(F.col("_reach") < F.col("start_ms") - gap_ms, F.lit(True))).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy(*key, "_no").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n")).drop("_no")


def buckets(start: Column, end: Column, width_ms: float) -> Column:
    """Numbers of the time buckets that a stretch touches: range joins become equi-joins on them."""
    return F.sequence(F.floor(start / width_ms), F.floor(end / width_ms))


def covered(points: DataFrame, spans: DataFrame, width_ms: float, how: str = "left_semi") -> DataFrame:
    """Points (page, t_ms) inside some stretch (left_semi), or in none (left_anti). Stretches should be merged; they meet points by bucket."""
    s = spans.select(F.col("page").alias("_page"), "start_ms", "end_ms", F.explode(buckets(F.col("start_ms"), F.col("end_ms"), width_ms)).alias("_bucket"))
    on = (F.col("page") == F.col("_page")) & (F.floor(F.col("t_ms") / width_ms) == F.col("_bucket")) & (F.col("t_ms") >= F.col("start_ms")) & (F.col("t_ms") <= F.col("end_ms"))
    return points.join(s, on, how)


def overlaps(spans: DataFrame, least_ms: float, width_ms: float) -> DataFrame:
    """Pairs of stretches of a page that share least_ms or more, each once, from the bucket in which both are for the first time."""
    b = spans.select("page", "span_id", "start_ms", "end_ms", F.explode(buckets(F.col("start_ms"), F.col("end_ms"), width_ms)).alias("bucket"))
    l, r = b.alias("l"), b.alias("r")
    start, end = F.greatest(F.col("l.start_ms"), F.col("r.start_ms")), F.least(F.col("l.end_ms"), F.col("r.end_ms"))
    on = (F.col("l.page") == F.col("r.page")) & (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.span_id") < F.col("r.span_id"))
    on &= (end - start >= least_ms) & (F.floor(start / width_ms) == F.col("l.bucket"))
    return l.join(r, on).select(F.col("l.page").alias("page"), F.col("l.span_id").alias("a"), F.col("r.span_id").alias("b"), (end - start).alias("shared_ms"))


def greedy(spans: DataFrame, least_ms: float) -> DataFrame:
    """Stretches in order of start, each kept unless it shares least_ms or more with one kept before; page, span_id, kept.

    What is kept depends on what was kept before, so a page is one fold in order; a page's stretches are one recording's sheets, a short list."""
    kind = "array<struct<start_ms:double,span_id:bigint,end_ms:double>>"

    def step(kept: Column, x: Column) -> Column:
        hit = F.exists(kept, lambda k: F.least(k["end_ms"], x["end_ms"]) - F.greatest(k["start_ms"], x["start_ms"]) >= least_ms)
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(x)))

    g = spans.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("start_ms", "span_id", "end_ms"))).alias("items"))
    g = g.withColumn("kept", F.aggregate(F.col("items").cast(kind), F.array().cast(kind), step))
    g = g.select("page", F.explode("items").alias("x"), F.transform("kept", lambda k: k["span_id"]).alias("ids"))
    return g.select("page", F.col("x.span_id").alias("span_id"), F.array_contains("ids", F.col("x.span_id")).alias("kept"))


def islands(rows: DataFrame, key: list[str], at: str, gap: float) -> DataFrame:
    """Rows of a key joined while the next is at most `gap` after the last: key, first, last, n."""
    w = W.partitionBy(*key).orderBy(at)
    r = rows.withColumn("_no", F.coalesce(F.col(at) - F.lag(at).over(w) > gap, F.lit(True)).cast("int")).withColumn("_no", F.sum("_no").over(w.rangeBetween(W.unboundedPreceding, 0)))
    return r.groupBy(*key, "_no").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n")).drop("_no")
