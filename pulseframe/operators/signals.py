"""Operators on short signals held as arrays. A signal has page, lead and mv (array of doubles at HZ samples a second)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.exprs import correlation, median_of, sum_of


def _at(xs: Column, i: Column) -> Column:
    """The sample at i (from 0), the first or last sample beyond the edges."""
    return F.get(xs, F.greatest(F.lit(0), F.least(F.size(xs) - 1, i)).cast("int"))


def _places(xs: Column) -> Column:
    return F.sequence(F.lit(0), F.size(xs) - 1)


def argmax(mv: Column) -> Column:
    """The first place of the greatest value."""
    return (F.array_position(mv, F.array_max(mv)) - 1).cast("long")


def local_maxima(mv: Column, floor: float = 0.02) -> Column:
    """Inner places greater than the left and not less than the right neighbour, above `floor` of the maximum."""
    inner = F.sequence(F.lit(1), F.size(mv) - 2)
    return F.filter(inner, lambda i: (F.get(mv, i) > F.get(mv, i - 1)) & (F.get(mv, i) >= F.get(mv, i + 1)) & (F.get(mv, i) > floor * F.array_max(mv)))


def moving_average(mv: Column, half: int) -> Column:
    """Centred mean of 2 half + 1 samples, zeros beyond the edges."""
    def mean(i: Column) -> Column:
        start = F.greatest(F.lit(0), i - half)
        return sum_of(F.slice(mv, (start + 1).cast("int"), (F.least(F.size(mv) - 1, i + half) - start + 1).cast("int"))) / F.lit(2.0 * half + 1)

    return F.transform(_places(mv), mean)


def derivative(mv: Column) -> Column:
    """Five-point derivative: (2 x[i+2] + x[i+1] - x[i-1] - 2 x[i-2]) / 8, edges repeated."""
    return F.transform(_places(mv), lambda i: (2 * _at(mv, i + 2) + _at(mv, i + 1) - _at(mv, i - 1) - 2 * _at(mv, i - 2)) / F.lit(8.0))


def energy(mv: Column, half: int = 2) -> Column:
    """Moving average of the squared derivative."""
    return moving_average(F.transform(derivative(mv), lambda x: x * x), half)


def order_statistic(mv: Column, share: float = 0.99) -> Column:
    """The value at place floor(share n) of the sorted values."""
    return F.get(F.array_sort(mv), F.least(F.size(mv) - 1, F.floor(F.size(mv) * share)).cast("int"))


def noise(mv: Column) -> Column:
    """1.4826 MAD(second differences) / sqrt 6; 0 for fewer than four differences."""
    d = F.transform(F.sequence(F.lit(2), F.size(mv) - 1), lambda i: F.get(mv, i) - 2 * F.get(mv, i - 1) + F.get(mv, i - 2))
    sigma = F.element_at(F.transform(F.array(d), lambda d: F.element_at(F.transform(F.array(median_of(d)), lambda m: median_of(F.transform(d, lambda x: F.abs(x - m)))), 1)), 1)
    return F.when(F.size(mv) < 6, 0.0).otherwise(1.4826 * sigma / F.sqrt(F.lit(6.0)))


def window_of(mv: Column, centre: Column, half: int) -> Column:
    """2 half + 1 samples around centre, edges repeated."""
    return F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda k: _at(mv, centre + k))


def net_area(mv: Column, first: int, last: int, base: Column, step_ms: float = 2.0) -> Column:
    """Sum of (mv - base) over places first to last, times the step."""
    return sum_of(F.transform(F.slice(mv, first + 1, last - first + 1), lambda x: x - base)) * F.lit(step_ms)


def level(mv: Column, first: int, last: int) -> Column:
    """Median of places first to last."""
    return median_of(F.slice(mv, first + 1, last - first + 1))


def slope(mv: Column) -> Column:
    """Least-squares slope a sample."""
    n = F.size(mv).cast("double")
    sy, si = sum_of(mv), n * (n - 1) / 2
    sxy = F.aggregate(F.zip_with(mv, _places(mv), lambda y, i: y * i), F.lit(0.0), lambda a, x: a + x)
    sxx = n * (n - 1) * (2 * n - 1) / 6
    return F.when(n > 1, (n * sxy - si * sy) / (n * sxx - si * si))


def tangent_crossing(i: Column, value: Column, line: Column, target: Column) -> Column:
    """Where the tangent through (i, value) with slope `line` meets the level; i itself for a flat tangent."""
    return F.when(line == 0, i).otherwise(i + (target - value) / line)


def interpolated(t: Column, t0: Column, v0: Column, t1: Column, v1: Column) -> Column:
    """A baseline between two levels; the first where they coincide or the second is missing."""
    return F.when(t1.isNull() | (t1 == t0), v0).otherwise(v0 + (v1 - v0) * (t - t0) / (t1 - t0))


def template(signals: DataFrame, least: int = 3) -> DataFrame:
    """Per page the element-wise median of its signals (pages with `least` signals at least): page, k, level."""
    e = signals.select("page", "lead", F.posexplode("mv").alias("k", "v"))
    return e.groupBy("page", "k").agg(F.median("v").alias("level"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("n")


def likeness(signals: DataFrame, least: int = 3) -> DataFrame:
    """Each signal's correlation with its page's template (0 where one does not vary)."""
    e = signals.select("page", "lead", F.posexplode("mv").alias("k", "v")).join(template(signals, least), ["page", "k"])
    x, y = F.col("v"), F.col("level")
    s = e.groupBy("page", "lead").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    return s.select("page", "lead", correlation(*(F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))).alias("rho"))


def axis(areas: DataFrame) -> DataFrame:
    """Electrical axis a page from beats' net areas in leads I and aVF: degrees of atan2(median aVF, median I), to one decimal."""
    m = areas.groupBy("page").agg(F.median("area_i").alias("i"), F.median("area_avf").alias("f"))
    return m.select("page", (F.floor(F.degrees(F.atan2("f", "i")) * 10 + 0.5) / 10).alias("axis"))
