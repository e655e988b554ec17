"""What a case's beats say: gates, prematurity, ectopic beats, episodes, pauses, type of rhythm, axis, heart rate.

Marked beats have case_id, page, beat_id, t_ms, t_ii_ms (lead II's time, null where lead II can't be used), confidence, reasons, ii_confidence, and the marks of
lead II: q_on, s_off, p_found, p_on (ms), d_confidence, d_reasons; some operators name more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulseframe.functions.exprs import half_up
from pulseframe.operators import rhythm
from pulseframe.plans import constants as C


def _has(reasons: Column, codes: tuple[str, ...]) -> Column:
    return F.arrays_overlap(reasons, F.array(*[F.lit(c) for c in codes]))


def _or_false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def gated(marks: DataFrame) -> DataFrame:
    """Add reliable (fit for measuring as a beat), usable (its marks in lead II can be used), p_assessed and p_absent, and pq (ms, null without both ends)."""
    usable = (F.col("ii_confidence") >= C.RELIABLE) & F.col("t_ii_ms").isNotNull() & F.col("q_on").isNotNull() & F.col("s_off").isNotNull()
    usable = _or_false(usable & (F.col("d_confidence") >= C.RELIABLE) & ~F.array_contains("d_reasons", "unreliable_segment"))
    b = marks.withColumn("reliable", _or_false(F.col("confidence") >= C.RELIABLE) & ~_has(F.col("reasons"), C.EXCLUDING)).withColumn("usable", usable)
    b = b.withColumn("p_assessed", F.col("p_found") | ~_has(F.col("d_reasons"), C.NOT_ASSESSABLE)).withColumn("p_absent", ~F.col("p_found") & F.col("p_assessed"))
    return b.withColumn("pq", F.when(F.col("usable") & F.col("p_found"), F.col("q_on") - F.col("p_on")))


def merged(marks: DataFrame, pages: DataFrame) -> DataFrame:
    """Beats of a case in order: global_index (from 0 in the case), at_ms (on the case's time scale), rr_ms and rr_ii_ms within a page.
    pages: case_id, page, offset_ms; page_no, their order."""
    b = rhythm.rr(marks).join(pages.select("case_id", "page", "page_no", "offset_ms"), ["case_id", "page"])
    b = b.withColumn("rr_ii_ms", F.col("t_ii_ms") - F.lag("t_ii_ms").over(rhythm.by_page())).withColumn("at_ms", F.col("offset_ms") + F.col("t_ms"))
    return b.withColumn("global_index", (F.row_number().over(W.partitionBy("case_id").orderBy("page_no", "t_ms", "beat_id")) - 1).cast("long"))


def flagged(marks: DataFrame, species: str | Column = "dog") -> DataFrame:
    """gated, with candidate and premature by the case's median, spread and PQ."""
    return rhythm.premature_corrected(gated(marks), "pq", species)


def recording_end(pages: DataFrame) -> DataFrame:
    """case_id and end_ms: the end of the latest signal. pages: case_id, offset_ms, n_samples."""
    return pages.groupBy("case_id").agg(F.max(F.col("offset_ms") + F.col("n_samples") * 1000 / C.HZ).alias("end_ms"))


def ventricular_focus(area_i: Column, area_f: Column) -> Column:
    """The ventricle by the sign of the QRS area in I; in aVF where that of I is missing or small."""
    side = lambda a: F.when(a > 0, "right_ventricle").otherwise("left_ventricle")
    decides = area_i.isNotNull() & (area_f.isNull() | (F.abs(area_i) > C.SMALL_AREA * F.abs(area_f)))
    return F.when(decides, side(area_i)).when(area_f.isNull() | (area_f == 0), "unknown").otherwise(side(area_f))


def ectopics(beats: DataFrame, species: str | Column = "dog") -> DataFrame:
    """Premature beats with kind (VE: wide or of another shape, else SVE), focus, width_s and coupling_ms, whole, from the last beat of the page that is not premature.
    beats: flagged, with rr_ms, rho (likeness to the page's template, null without one), area_i and area_f."""
    limit = lambda key: rhythm.limit(species, key)
    before = F.last(F.when(~F.col("premature"), F.col("t_ms")), ignorenulls=True).over(rhythm.by_page().rowsBetween(W.unboundedPreceding, -1))
    b = beats.withColumn("_before", before).filter(F.col("premature") & F.col("rr_ms").isNotNull())
    width = F.when(F.col("usable"), F.greatest(F.lit(0.0), F.col("s_off") - F.col("q_on") - limit("widen_on_ms") - limit("widen_off_ms")) / 1000)
    b = b.withColumn("width_s", width)
    ve = _or_false(F.col("width_s") > limit("wide_s")) | _or_false(F.col("rho") < C.SAME_SHAPE)
    b = b.withColumn("kind", F.when(ve, "VE").otherwise("SVE"))
    above = F.when(F.col("usable"), F.when(F.col("p_found"), "atrial").otherwise("junctional")).otherwise("unknown")
    b = b.withColumn("focus", F.when(F.col("kind") == "VE", ventricular_focus(F.col("area_i"), F.col("area_f"))).otherwise(above))
    return b.withColumn("coupling_ms", half_up(F.coalesce(F.col("t_ms") - F.col("_before"), F.col("rr_ms")))).drop("_before")


def episodes(beats: DataFrame, found: DataFrame, ends: DataFrame) -> DataFrame:
    """Episodes of a case: case_id, page, first_index, n, kind (ve_run, sve_run, no_p), focus, coupling_ms, start_ms, duration_ms.

    Runs of premature beats go by the kind of half their ectopic beats or more, the focus seen most (the first on ties) and the first one's coupling; runs of
    other usable beats without a P wave have no focus. beats: flagged, with beat_index, rr_ms and at_ms; found: ectopics; ends: case_id, end_ms."""
    key = ["case_id", "page", "_island"]
    e = found.select("case_id", "page", "beat_id", "kind", "focus", "coupling_ms")
    r = rhythm.stretches(beats, "premature").join(e, ["case_id", "page", "beat_id"], "left")
    foci = r.filter("focus IS NOT NULL").groupBy(*key, "focus").agg(F.count(F.lit(1)).alias("c"), F.min("beat_index").alias("seen"))
    foci = foci.groupBy(*key).agg(F.max_by("focus", F.struct("c", -F.col("seen"))).alias("focus"))
    span = [F.min("beat_index").alias("first_index"), F.count(F.lit(1)).alias("n"), F.min("at_ms").alias("start_ms"), F.max("at_ms").alias("last_ms")]
    early = r.groupBy(*key).agg(
        *span,
        F.when(2 * F.count_if(F.col("kind") == "VE") >= F.count("kind"), "ve_run").otherwise("sve_run").alias("kind"),
        F.coalesce(F.min_by("coupling_ms", F.when(F.col("kind").isNotNull(), F.col("beat_index"))), F.min_by("rr_ms", "beat_index"), F.lit(0.0)).alias("coupling_ms"),
    )
    early = early.join(foci, key, "left").withColumn("focus", F.coalesce("focus", F.lit("unknown")))
    plain = rhythm.stretches(beats.withColumn("_no_p", ~F.col("premature") & F.col("usable") & F.col("p_absent")), "_no_p")
    first_two = F.array_sort(F.collect_list(F.struct("beat_index", "rr_ms")))
    plain = plain.groupBy(*key).agg(*span, F.lit("no_p").alias("kind"), F.coalesce(first_two[0]["rr_ms"], first_two[1]["rr_ms"], F.lit(0.0)).alias("coupling_ms"), F.lit("unknown").alias("focus"))
    both = early.unionByName(plain).join(ends.select("case_id", F.col("end_ms").alias("_end")), "case_id")
    lasts = half_up(rhythm._lasting(F.col("start_ms"), F.col("last_ms"), F.col("n"), F.col("_end")))
    return both.withColumn("duration_ms", lasts).withColumn("coupling_ms", half_up(F.col("coupling_ms"))).drop("_island", "_end", "last_ms")


def _type_marks(beats: DataFrame) -> DataFrame:
    """Add what rhythm_type counts: _ok, _seen, _p (PQ) and _odd (PQ beyond the tolerance of the case's median)."""
    ok = F.col("usable") & ~F.col("premature")
    seen = ok & F.col("p_assessed")
    with_p = seen & F.col("p_found") & F.col("p_on").isNotNull()
    px = F.when(F.col("ms_per_px") > 0, F.col("ms_per_px")).otherwise(C.MS_PER_PX)
    b = beats.withColumns({"_ok": ok, "_seen": seen, "_p": F.when(with_p, F.col("q_on") - F.col("p_on")), "_px": F.when(with_p, px)})
    w = rhythm.whole_case()
    b = b.withColumn("_mid", F.median("_p").over(w)).withColumn("_tol", F.greatest(C.PQ_TOLERANCE * F.col("_mid"), C.PQ_PX * F.median("_px").over(w)))
    return b.withColumn("_odd", F.abs(F.col("_p") - F.col("_mid")) > F.col("_tol")).drop("_px", "_mid", "_tol")


_TYPE_COUNTS = {"ii": lambda: F.count_if(F.col("ii_confidence") >= C.RELIABLE), "usable": lambda: F.count_if("_ok"), "seen": lambda: F.count_if("_seen"), "p": lambda: F.count("_p"), "odd": lambda: F.count_if("_odd")}


def _type() -> tuple[Column, Column]:
    """type and reasons from _TYPE_COUNTS."""
    few = F.when(F.col("usable") < C.TYPE_BEATS, "too_few_beats").when(F.col("seen") < C.TYPE_BEATS, "p_not_found")
    few = F.when(few.isNotNull() & (F.col("ii") == 0), "lead_ii_unreliable").otherwise(few)
    absent = F.col("seen") - F.col("p")
    no_p = (absent >= C.DEVIANTS) & (F.col("p") / F.col("seen") < C.P_SHARE)
    no_p = F.when(no_p, F.when(F.col("p") > 0, F.concat(F.lit("p_not_all:"), F.col("p"), F.lit("/"), F.col("seen"))).otherwise("p_not_found"))
    unstable = F.when((F.col("odd") >= C.DEVIANTS) & ((F.col("p") - F.col("odd")) / F.col("p") < C.P_SHARE), "pq_unstable")
    reasons = F.array_compact(F.when(few.isNotNull(), F.array(few)).otherwise(F.array(no_p, unstable)))
    return F.when(few.isNotNull(), "undetermined").when(F.size(reasons) > 0, "non_sinus").otherwise("sinus"), reasons


def rhythm_type(beats: DataFrame) -> DataFrame:
    """case_id, type (sinus, non_sinus, undetermined) and reasons. beats: flagged, with ms_per_px."""
    s = _type_marks(beats).groupBy("case_id").agg(*[f().alias(k) for k, f in _TYPE_COUNTS.items()])
    kind, reasons = _type()
    return s.select("case_id", kind.alias("type"), reasons.alias("reasons"))


def measurement_beats(beats: DataFrame) -> DataFrame:
    """Beats fit for measuring: reliable, usable, not premature, and neither neighbour on the page premature. beats: flagged."""
    near = _or_false(F.lag("premature").over(rhythm.by_page())) | _or_false(F.lead("premature").over(rhythm.by_page()))
    return beats.withColumn("_near", near).filter(F.col("reliable") & F.col("usable") & ~F.col("premature") & ~F.col("_near")).drop("_near")


def _axis_marks(beats: DataFrame) -> DataFrame:
    """Add what axis sums: _chosen (the beats fit for measuring; where the case has none, reliable beats that are not premature) and _both (with both areas)."""
    near = _or_false(F.lag("premature").over(rhythm.by_page())) | _or_false(F.lead("premature").over(rhythm.by_page()))
    b = beats.withColumn("_second", F.col("reliable") & ~F.col("premature")).withColumn("_first", F.col("_second") & F.col("usable") & ~near)
    b = b.withColumn("_chosen", F.when(F.max("_first").over(rhythm.whole_case()), F.col("_first")).otherwise(F.col("_second")))
    return b.withColumn("_both", F.col("_chosen") & F.col("leads_reliable") & F.col("area_i").isNotNull() & F.col("area_f").isNotNull()).drop("_first", "_second")


_AXIS_SUMS = {
    "chosen": lambda: F.count_if("_chosen"), "missing": lambda: F.count_if(F.col("_chosen") & ~F.col("leads_reliable")),
    "i": lambda: F.median(F.when(F.col("_both"), F.col("area_i"))), "f": lambda: F.median(F.when(F.col("_both"), F.col("area_f"))),
}


def _axis() -> tuple[Column, Column]:
    """axis and reason from _AXIS_SUMS."""
    reason = F.when(F.col("chosen") == 0, "too_few_beats").when(F.col("i").isNull(), F.when(F.col("missing") > 0, "axis_leads_unreliable").otherwise("too_few_beats"))
    return half_up(F.degrees(F.atan2("f", "i")), 1), reason


def axis(beats: DataFrame) -> DataFrame:
    """case_id, axis (degrees, one decimal) and reason. beats: flagged, with area_i, area_f (null beside unreliable stretches) and leads_reliable (both leads are)."""
    a = _axis_marks(beats).groupBy("case_id").agg(*[f().alias(k) for k, f in _AXIS_SUMS.items()])
    degrees, reason = _axis()
    return a.select("case_id", degrees.alias("axis"), reason.alias("reason"))


def heart_rate(beats: DataFrame) -> DataFrame:
    """case_id, hr_mean, hr_min, hr_max, source (lead_ii if every interval is by lead II), confidence of each, and participants, the places of the beats used.
    An interval is lead II's where it has both ends. beats: merged, with confidence."""
    w = rhythm.by_page()
    b = beats.withColumn("_prev", F.lag("confidence").over(w)).withColumn("_before", F.lag("global_index").over(w))
    b = b.filter("rr_ms IS NOT NULL").withColumn("_rr", F.coalesce("rr_ii_ms", "rr_ms")).withColumn("_c", (F.col("_prev") + F.col("confidence")) / 2)
    top = lambda c: F.max_by("_c", F.struct(c, -F.col("global_index")))
    one = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return b.groupBy("case_id").agg(
        (60_000 / F.avg("_rr")).alias("hr_mean"), (60_000 / F.max("_rr")).alias("hr_min"), (60_000 / F.min("_rr")).alias("hr_max"),
        F.when(F.count("rr_ii_ms") == F.count(F.lit(1)), "lead_ii").otherwise("all_leads").alias("source"),
        one(F.avg("_c")).alias("mean_confidence"), one(top(F.col("_rr"))).alias("min_confidence"), one(top(-F.col("_rr"))).alias("max_confidence"),
        F.array_sort(F.array_union(F.collect_set("global_index"), F.collect_set("_before"))).alias("participants"),
    )


def empty_reason(beats: DataFrame) -> DataFrame:
    """case_id and reason: why no beat of a case can be measured, or too_few_beats. beats: gated. A case without beats has no row here."""
    ii, fit = F.max(F.col("ii_confidence") >= C.RELIABLE), F.max(F.col("reliable") & F.col("usable"))
    return beats.groupBy("case_id").agg(F.when(~ii, "lead_ii_unreliable").when(~fit, "low_confidence").otherwise("too_few_beats").alias("reason"))


def template_half(beats: DataFrame, species: str | Column = "dog") -> DataFrame:
    """page and half_ms: half the template's window, half the median QRS width of the page's usable beats that are not premature (three at least), else half a surely wide QRS."""
    width = F.when(F.col("usable") & ~F.col("premature"), F.col("s_off") - F.col("q_on"))
    sure = F.first(rhythm.limit(species, "sure_wide_s") * 1000)
    return beats.groupBy("case_id", "page").agg((F.when(F.count(width) >= C.TEMPLATE_BEATS, F.median(width)).otherwise(sure) / 2).alias("half_ms"))


def reference_lead(leads: DataFrame) -> DataFrame:
    """page and lead: II if it is reliable and not empty, else the most confident lead that is not empty (the first listed on ties). leads: page, lead, position, n, confidence."""
    ok = leads.filter((F.col("n") > 0) & (F.col("confidence") > 0))
    first = (F.col("lead") == "II") & (F.col("confidence") >= C.RELIABLE)
    return ok.groupBy("page").agg(F.max_by("lead", F.struct(first, "confidence", -F.col("position"))).alias("lead"))


def report(beats: DataFrame, species: str | Column = "dog") -> DataFrame:
    """case_id, type, reasons (the axis' among them), axis, sinus_arrhythmia, n_pauses. A pause cancels sinus arrhythmia. beats: flagged, with rr_ms and what
    rhythm_type and axis need. Beats are dealt by case once; all windows and the one aggregate need no other exchange."""
    b = rhythm.counted(rhythm.pause_marks(_axis_marks(_type_marks(beats.repartition("case_id").withColumn("_species", F.lit(species) if isinstance(species, str) else species)))))
    cv, change = rhythm.spread()
    sums = {**_TYPE_COUNTS, **_AXIS_SUMS}
    r = b.groupBy("case_id").agg(*[f().alias(k) for k, f in sums.items()], cv.alias("cv"), change.alias("max_change"), F.count_if("is_pause").alias("n_pauses"), F.first("_species").alias("_species"))
    kind, reasons = _type()
    degrees, reason = _axis()
    r = r.select("case_id", "n_pauses", kind.alias("type"), reasons.alias("_reasons"), degrees.alias("axis"), reason.alias("_reason"), rhythm.arrhythmic(F.col("cv"), F.col("max_change"), F.col("_species")).alias("_varies"))
    calm = (F.col("type") == "sinus") & (F.col("n_pauses") == 0) & F.col("_varies")
    return r.select("case_id", "type", F.array_distinct(F.concat("_reasons", F.array_compact(F.array("_reason")))).alias("reasons"), "axis", calm.alias("sinus_arrhythmia"), F.col("n_pauses").cast("long").alias("n_pauses"))
