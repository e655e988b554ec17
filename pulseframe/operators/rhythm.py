"""Intervals between beats and what follows from them. Beats have case_id, page, beat_id, t_ms, and for some operators lead and value.

Intervals never cross a page; medians, spreads and limits are the case's. A case is one animal's few sheets, so a window over a case is small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulseframe.plans import constants as C


def limit(species: str | Column, key: str) -> Column:
    """A species' threshold, for one species by name or for each row's."""
    if isinstance(species, str):
        return F.lit(C.THRESHOLDS[species][key])
    return F.when(species == "cat", C.THRESHOLDS["cat"][key]).otherwise(C.THRESHOLDS["dog"][key])


def by_page():
    """A page's beats in order of time."""
    return W.partitionBy("case_id", "page").orderBy("t_ms", "beat_id")


def whole_case():
    return W.partitionBy("case_id")


def rr(beats: DataFrame) -> DataFrame:
    """Add beat_index (from 0 in the page) and rr_ms, the time since the beat before on the same page."""
    return beats.withColumn("beat_index", (F.row_number().over(by_page()) - 1).cast("long")).withColumn("rr_ms", F.col("t_ms") - F.lag("t_ms").over(by_page()))


def global_index(beats: DataFrame, width: int = 1024) -> DataFrame:
    """Number beats over all pages, pages in order. Page counts are summed in stretches of `width` pages first, so no task gets all beats or pages."""
    per = beats.groupBy("page").agg(F.count(F.lit(1)).alias("n")).withColumn("stretch", F.floor(F.col("page") / width))
    ahead = W.orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    stretches = per.groupBy("stretch").agg(F.sum("n").alias("n")).select("stretch", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inside = W.partitionBy("stretch").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    base = per.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(stretches, "stretch").select("page", (F.col("base") + F.col("within")).alias("base"))
    return rr(beats).join(base, "page").withColumn("global_index", F.col("base") + F.col("beat_index")).drop("base")


def heart_rate(beats: DataFrame) -> DataFrame:
    """Mean, least and greatest rate a page (beats a minute)."""
    return rr(beats).groupBy("page").agg(
        F.count("rr_ms").alias("n_rr"), (60_000 / F.avg("rr_ms")).alias("hr_mean"), (60_000 / F.max("rr_ms")).alias("hr_min"), (60_000 / F.min("rr_ms")).alias("hr_max")
    )


def with_median(beats: DataFrame) -> DataFrame:
    """rr, and the case's median interval (null for fewer than LEAST_RR intervals)."""
    b = rr(beats)
    return b.withColumn("median_rr", F.when(F.count("rr_ms").over(whole_case()) >= C.LEAST_RR, F.median("rr_ms").over(whole_case())))


def premature(beats: DataFrame) -> DataFrame:
    """with_median, and premature: an interval shorter than EARLY of the median."""
    return with_median(beats).withColumn("premature", F.coalesce(F.col("rr_ms") < C.EARLY * F.col("median_rr"), F.lit(False)))


def counted(flagged: DataFrame, flag: str = "premature") -> DataFrame:
    """Add _rr, the interval if neither of its ends is flagged, and _change, its difference to such an interval just before it."""
    b = flagged.withColumn("_ok", F.col("rr_ms").isNotNull() & ~F.col(flag) & ~F.coalesce(F.lag(flag).over(by_page()), F.lit(False)))
    b = b.withColumn("_rr", F.when(F.col("_ok"), F.col("rr_ms")))
    return b.withColumn("_change", F.when(F.col("_ok") & F.lag("_ok").over(by_page()), F.abs(F.col("rr_ms") - F.lag("rr_ms").over(by_page()))))


def spread(over=lambda c: c) -> tuple[Column, Column]:
    """cv (sample deviation over mean, 0 without intervals) and greatest change of counted's intervals, as aggregates or over a window."""
    mean = over(F.avg("_rr"))
    cv = F.when(mean > 0, F.coalesce(over(F.stddev_samp("_rr")), F.lit(0.0)) / mean).otherwise(0.0)
    return cv, F.coalesce(over(F.max("_change")), F.lit(0.0))


def variation(flagged: DataFrame, flag: str = "premature") -> DataFrame:
    """By case: cv (sample deviation over mean) and max_change (ms) over intervals with no flagged end; a change counts between neighbouring such intervals."""
    cv, change = spread()
    return counted(flagged, flag).groupBy("case_id").agg(cv.alias("cv"), change.alias("max_change"), F.count("_rr").alias("n"))


def arrhythmic(cv: Column, max_change: Column, species: str | Column = "dog") -> Column:
    """Sinus arrhythmia by the spread of intervals."""
    return (cv > limit(species, "variation")) | (max_change >= limit(species, "change_ms"))


def premature_corrected(beats: DataFrame, pq: str = "value", species: str | Column = "dog") -> DataFrame:
    """premature, corrected for sinus arrhythmia: where the case's remaining intervals vary that much, a candidate stays
    only without a P wave (null pq) or with a pq beyond PQ_TOLERANCE of the case's median pq of other beats; without such a median candidates stay.

    All sums of a case are windows over it, so beats are shuffled once by case."""
    b = counted(premature(beats), "premature")
    cv, change = spread(lambda c: c.over(whole_case()))
    b = b.withColumn("_arrhythmia", arrhythmic(cv, change, species))
    ref = F.median(F.when(~F.col("premature"), F.col(pq))).over(whole_case())
    b = b.withColumn("_odd", F.col(pq).isNull() | ref.isNull() | (F.abs(F.col(pq) - ref) > C.PQ_TOLERANCE * ref))
    b = b.withColumn("candidate", F.col("premature")).withColumn("premature", F.col("candidate") & (~F.col("_arrhythmia") | F.col("_odd")))
    return b.drop("_ok", "_rr", "_change", "_arrhythmia", "_odd")


def pause_marks(beats: DataFrame) -> DataFrame:
    """Add is_pause: an interval of at least PAUSE medians of all the case's intervals (two at least) whose earlier beat is not premature."""
    after = F.coalesce(F.lag("premature").over(by_page()), F.lit(False))
    limit_ms = F.when(F.count("rr_ms").over(whole_case()) >= C.PAUSE_RR, C.PAUSE * F.median("rr_ms").over(whole_case()))
    b = beats.withColumn("_limit", limit_ms).withColumn("_after", after)
    return b.withColumn("is_pause", F.coalesce((F.col("rr_ms") >= F.col("_limit")) & ~F.col("_after"), F.lit(False))).drop("_after", "_limit")


def pauses(beats: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """The beats that end a pause; see pause_marks."""
    return pause_marks(premature(beats) if flagged is None else flagged).filter("is_pause").drop("is_pause")


def stretches(flagged: DataFrame, flag: str, least: int = C.RUN) -> DataFrame:
    """Beats in runs of at least `least` neighbouring flagged beats of a page, with _island, the run's number on the page, and _size."""
    b = flagged.filter(flag)
    b = b.withColumn("_island", F.col("beat_index") - F.row_number().over(W.partitionBy("case_id", "page").orderBy("beat_index")))
    return b.withColumn("_size", F.count(F.lit(1)).over(W.partitionBy("case_id", "page", "_island"))).filter(F.col("_size") >= least)


def _lasting(first: Column, last: Column, n: Column, end: Column) -> Column:
    """From a run's first to its last beat and one mean interval within it more, to the end of the recording at most."""
    return F.least(last - first + (last - first) / (n - 1), F.greatest(F.lit(0.0), end - first))


def runs(flagged: DataFrame, ends: DataFrame, flag: str = "premature", least: int = C.RUN) -> DataFrame:
    """Runs of at least `least` neighbouring flagged beats: page, first_index, n, start_ms, end_ms, kind (the most frequent lead, first seen on ties),
    duration_ms. ends: case_id and end_ms, the end of the case's recording."""
    b = stretches(flagged, flag, least)
    kinds = b.groupBy("page", "_island", "lead").agg(F.count(F.lit(1)).alias("c"), F.min("beat_index").alias("seen"))
    kinds = kinds.groupBy("page", "_island").agg(F.max_by("lead", F.struct("c", -F.col("seen"))).alias("kind"))
    r = b.groupBy("case_id", "page", "_island").agg(F.min("beat_index").alias("first_index"), F.count(F.lit(1)).alias("n"), F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"))
    r = r.join(kinds, ["page", "_island"]).join(ends.withColumnRenamed("end_ms", "_end"), "case_id")
    return r.withColumn("duration_ms", _lasting(F.col("start_ms"), F.col("end_ms"), F.col("n"), F.col("_end"))).drop("_island", "_end")


def coupling(beats: DataFrame) -> DataFrame:
    """Premature beats, with the time since the last beat on the page that is not premature (the interval, if there is none)."""
    before = by_page().rowsBetween(W.unboundedPreceding, -1)
    b = premature(beats).withColumn("_t", F.last(F.when(~F.col("premature"), F.col("t_ms")), ignorenulls=True).over(before))
    return b.filter("premature").withColumn("coupling_ms", F.coalesce(F.col("t_ms") - F.col("_t"), F.col("rr_ms"))).drop("_t")


def measurement_beats(beats: DataFrame, confidence) -> DataFrame:
    """Beats fit for measuring: reliable, not premature, and neither neighbour on the page premature."""
    b = premature(beats).withColumn("confidence", confidence)
    near = F.coalesce(F.lag("premature").over(by_page()), F.lit(False)) | F.coalesce(F.lead("premature").over(by_page()), F.lit(False))
    b = b.withColumn("_near", near)
    return b.filter((F.col("confidence") >= C.RELIABLE) & ~F.col("premature") & ~F.col("_near")).drop("_near")


def consensus(marks: DataFrame, key: list[str], tolerance_ms: float) -> DataFrame:
    """Marks of several leads (key, lead, t_ms) as one: median time, leads, spread and confidence (1 within the tolerance, then falling to .2)."""
    m = marks.groupBy(*key).agg(F.median("t_ms").alias("t_ms"), F.count_distinct("lead").alias("n_leads"), (F.max("t_ms") - F.min("t_ms")).alias("spread_ms"))
    over = (F.col("spread_ms") - tolerance_ms) / (3 * tolerance_ms)
    return m.withColumn("confidence", F.when(F.col("spread_ms") <= tolerance_ms, 1.0).otherwise(F.greatest(F.lit(0.2), 1 - over)))


def nearest_interval(digits: DataFrame, beats: DataFrame) -> DataFrame:
    """For each printed digit (page, digit_id, t_ms): the beat that ends the interval whose middle is nearest (the earlier on ties), and the distance.

    An as-of join in both directions: digits and middles are merged in one sorted pass a page, and each digit looks at the last middle before and the first after."""
    mid = rr(beats).filter("rr_ms IS NOT NULL").select("page", (F.col("t_ms") - F.col("rr_ms") / 2).alias("t"), F.lit(None).cast("long").alias("digit_id"), F.struct((F.col("t_ms") - F.col("rr_ms") / 2).alias("t"), "beat_id").alias("m"))
    d = digits.select("page", F.col("t_ms").alias("t"), "digit_id", F.lit(None).cast(mid.schema["m"].dataType).alias("m"))
    order = W.partitionBy("page").orderBy("t", F.col("digit_id").isNotNull(), F.col("m.beat_id"))
    both = d.union(mid).withColumn("before", F.last("m", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    both = both.withColumn("after", F.first("m", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))).filter("digit_id IS NOT NULL")
    x, y = F.col("t") - F.col("before.t"), F.col("after.t") - F.col("t")
    near = F.when(F.col("after").isNull() | (x <= y), F.col("before")).otherwise(F.col("after"))
    return both.select("page", "digit_id", near["beat_id"].alias("beat_id"), F.abs(near["t"] - F.col("t")).alias("distance_ms")).filter("beat_id IS NOT NULL")
