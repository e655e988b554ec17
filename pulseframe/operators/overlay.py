"""Geometry over a sheet: curves and bridges, heights on a curve, time and pixels, grid lines, bounds of markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Marks of a beat in order of time; the least gap between them (ms).
MARKS = ("p_on", "p_off", "q_on", "r_peak", "s_peak", "s_off", "t_peak", "t_off")
MARK_GAP_MS = 2.0


def px_per_ms(px_mm_x: Column, mm_s: Column) -> Column:
    v = px_mm_x * mm_s / 1000
    return F.when(v > 0, v).otherwise(0.0)


def time_to_x(origin: Column, scale: Column, t_ms: Column) -> Column:
    return origin + t_ms * scale


def x_to_time(origin: Column, scale: Column, x: Column) -> Column:
    """0 without a scale."""
    return F.when(scale > 0, (x - origin) / scale).otherwise(0.0)


def px_per_mm(ax: Column, ay: Column, bx: Column, by: Column, mm: Column) -> Column:
    """Pixels a millimetre from two clicks that many millimetres apart; 0 without a distance."""
    return F.when(mm > 0, F.hypot(bx - ax, by - ay) / mm).otherwise(0.0)


def lattice(phase: Column, step: Column, first: Column, last: Column, least: int | None = None) -> Column:
    """phase + k step inside [first, last], for whole k (from `least`); none without a step."""
    k0 = F.ceil((first - phase) / step)
    k0 = k0 if least is None else F.greatest(k0, F.lit(least))
    k1 = F.floor((last - phase) / step)
    return F.when((step > 0) & phase.isNotNull() & (k1 >= k0), F.transform(F.sequence(k0, k1), lambda k: phase + k * step)).otherwise(F.array().cast("array<double>"))


def grid_lines(sheets: DataFrame) -> DataFrame:
    """sheet and xs5, ys5, xs1, ys1: lines every five and one millimetres inside the frame; five-millimetre lines start at the phase. sheets: sheet, x, y, width, height,
    phase_x, phase_y, px_mm_x, px_mm_y."""
    x1, y1 = F.col("x") + F.col("width") - 1, F.col("y") + F.col("height") - 1
    line = lambda axis, end, mm, least: lattice(F.col(f"phase_{axis}"), mm * F.col(f"px_mm_{axis}"), F.col(axis), end, least)
    return sheets.select("sheet", line("x", x1, 5, 0).alias("xs5"), line("y", y1, 5, 0).alias("ys5"), line("x", x1, 1, None).alias("xs1"), line("y", y1, 1, None).alias("ys1"))


def on_trace(points: DataFrame, places: DataFrame) -> DataFrame:
    """trace, x, y: the height of each trace at the places (trace, x), between its neighbouring points (trace, x, y), and that of the end points beyond them.

    An as-of match in both directions: points and places are merged in one sorted pass a trace."""
    p = points.select("trace", "x", F.struct("x", "y").alias("p"), F.lit(0).alias("asked"))
    q = places.select("trace", "x", F.lit(None).cast(p.schema["p"].dataType).alias("p"), F.lit(1).alias("asked"))
    w = W.partitionBy("trace").orderBy("x", "asked")
    m = p.union(q).withColumn("a", F.last("p", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("b", F.first("p", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)))
    wide = F.col("b.x") > F.col("a.x")
    between = F.when(wide, F.col("a.y") + (F.col("b.y") - F.col("a.y")) * (F.col("x") - F.col("a.x")) / (F.col("b.x") - F.col("a.x"))).otherwise(F.col("b.y"))
    y = F.when(F.col("a").isNull(), F.col("b.y")).when(F.col("b").isNull(), F.col("a.y")).otherwise(between)
    return m.filter("asked = 1").select("trace", "x", y.alias("y"))


def segments(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Points (trace, x, y) with piece, the number of the drawn piece that they belong to, and bridge, the kind of the stretch crossed from the point before (clipped before
    gap; null if drawn through). spans: trace, kind, x0, x1; ambiguous ones are drawn through."""
    w = W.partitionBy("trace").orderBy("x")
    p = points.withColumn("_x0", F.lag("x").over(w))
    s = spans.filter("kind <> 'ambiguous'").groupBy("trace").agg(F.collect_list(F.struct("kind", "x0", "x1")).alias("_spans"))  # a trace has a few
    hit = F.filter("_spans", lambda s: (s["x0"] < F.col("x")) & (s["x1"] > F.col("_x0")))
    p = p.join(s, "trace", "left").withColumn("_hit", F.when(F.col("_x0").isNotNull(), hit))
    kind = F.when(F.exists("_hit", lambda s: s["kind"] == "clipped"), "clipped").when(F.size("_hit") > 0, "gap")
    p = p.withColumn("bridge", kind)
    return p.withColumn("piece", F.sum(F.col("bridge").isNotNull().cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_x0", "_spans", "_hit")


def ambiguous(points: DataFrame, spans: DataFrame) -> DataFrame:
    """trace, span and n: ambiguous stretches (trace, span, kind, x0, x1) with two points or more within half a pixel."""
    s = spans.filter("kind = 'ambiguous'").select("trace", "span", "x0", "x1")
    return points.join(s, "trace").filter((F.col("x") >= F.col("x0") - 0.5) & (F.col("x") <= F.col("x1") + 0.5)).groupBy("trace", "span").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


def marker_bounds(field: str, before: Column, after: Column) -> tuple[Column, Column]:
    """Least and greatest time of a mark: between the marks before and after it and the neighbouring beats (null: none), MARK_GAP_MS apart."""
    i = MARKS.index(field)
    inf = F.lit(float("inf"))
    low = F.greatest(F.coalesce(before, -inf), *[F.coalesce(F.col(m), -inf) for m in MARKS[:i]], -inf)
    high = F.least(F.coalesce(after, inf), *[F.coalesce(F.col(m), inf) for m in MARKS[i + 1 :]], inf)
    return low + MARK_GAP_MS, high - MARK_GAP_MS


def positions(beats: DataFrame, found: DataFrame) -> DataFrame:
    """page, position (of the beat on its page) and kind of ectopic beats. beats: case_id, page, beat_index, global_index; found: case_id, beat (global), kind."""
    return found.join(beats.select("case_id", "page", F.col("beat_index").alias("position"), F.col("global_index").alias("beat")), ["case_id", "beat"]).select("case_id", "page", "position", "kind")


def separators(drawn: DataFrame, leads: DataFrame) -> DataFrame:
    """sheet, x0, x1, y, above and below: a drawn line (sheet, line, ax, ay, bx) of a pixel at least separates the leads (sheet, lead, baseline_y) nearest above and below its height."""
    d = drawn.select("sheet", "line", F.least("ax", "bx").alias("x0"), F.greatest("ax", "bx").alias("x1"), F.col("ay").alias("y")).filter("x1 - x0 >= 1")
    j = d.join(leads, "sheet").groupBy("sheet", "line", "x0", "x1", "y").agg(
        F.max_by("lead", F.when(F.col("baseline_y") <= F.col("y"), F.col("baseline_y"))).alias("above"), F.min_by("lead", F.when(F.col("baseline_y") > F.col("y"), F.col("baseline_y"))).alias("below")
    )
    return j.filter("above IS NOT NULL AND below IS NOT NULL")
