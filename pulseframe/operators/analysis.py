"""A whole case: from its sheets and their signals to beats, findings, measured values and the text of the conclusion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.exprs import median_of, sum_of
from pulseframe.functions.shared import cut
from pulseframe.kernels import bridge
from pulseframe.operators import conclusion, findings, measure, order, rhythm, views
from pulseframe.operators.measure import place
from pulseframe.plans import constants as C

@dataclass
class Case:
    """What analyze finds, a table each; case_id in all. beats: one row a beat with marks, flags and features. report: one row a case, with the text."""

    order: DataFrame
    pages: DataFrame
    beats: DataFrame
    ectopics: DataFrame
    episodes: DataFrame
    pauses: DataFrame
    measured: DataFrame
    rates: DataFrame
    report: DataFrame


def likeness(a: Column, b: Column) -> Column:
    """Pearson's correlation of two arrays of the same length, 0 if one doesn't vary."""
    n = F.size(a)
    sums = lambda m: F.aggregate(
        F.zip_with(a, b, lambda x, y: F.struct((x - m["a"]).alias("x"), (y - m["b"]).alias("y"))), F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy")),
        lambda t, p: F.struct((t["xy"] + p["x"] * p["y"]).alias("xy"), (t["xx"] + p["x"] * p["x"]).alias("xx"), (t["yy"] + p["y"] * p["y"]).alias("yy")),
    )
    means = F.struct((sum_of(a) / n).alias("a"), (sum_of(b) / n).alias("b"))
    s = F.transform(F.array(means), sums)  # as an array of one, so that means are taken once and not for each element
    return F.transform(s, lambda t: F.when((t["xx"] > 0) & (t["yy"] > 0), t["xy"] / F.sqrt(t["xx"] * t["yy"])).otherwise(0.0))[0]


def featured(beats: DataFrame, windows: DataFrame) -> DataFrame:
    """beats (flagged, with species) with rho, the likeness to the median of the page's usual beats in the reference lead (null for fewer than three). windows: page, beat_id, wide (bridge.read_pages)."""
    half = findings.template_half(beats, F.col("species")).withColumn("half", F.greatest(F.lit(1), place(F.col("half_ms")))).select("page", "half")
    middle = F.floor(F.size("wide") / F.lit(2)).cast("int")
    j = beats.join(windows, ["page", "beat_id"]).join(half, "page").withColumn("window", F.when(F.col("wide").isNotNull(), F.slice("wide", middle - F.col("half") + 1, 2 * F.col("half") + 1))).drop("wide", "half")
    j = cut(j, "features")
    w = j.filter(~F.col("premature") & F.col("window").isNotNull()).groupBy("page").agg(F.collect_list("window").alias("all"))
    w = w.filter(F.size("all") >= C.TEMPLATE_BEATS).withColumn("_k", F.sequence(F.lit(0), F.size(F.col("all")[0]) - 1))
    w = w.select("page", F.transform("_k", lambda k: median_of(F.transform("all", lambda x: F.get(x, k)))).alias("template"))
    return j.join(w, "page", "left").withColumn("rho", F.when(F.col("window").isNotNull() & F.col("template").isNotNull(), likeness(F.col("window"), F.col("template")))).drop("window", "template")


def facts(sheets: DataFrame, settings: DataFrame) -> DataFrame:
    """What finding a page's beats needs of its sheet and case: page, species, rates, left_px, px_per_ms, mv_per_px."""
    s = sheets.join(settings.select("case_id", "species"), "case_id")
    return s.select("page", "species", "rates", "left_px", (F.col("px_per_mm") * F.col("mm_per_s") / 1000).alias("px_per_ms"), "mv_per_px")


def beats_of(pages: DataFrame, sheets: DataFrame, read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The case's beats in order, flagged, with area_i and area_f; and the issues of pages whose beats failed. pages: order.offsets'; sheets: with species; read: bridge.read_pages'."""
    bad = read.filter("issue IS NOT NULL").select("page", "issue").join(pages.select("case_id", "page"), "page").select("case_id", "page", "issue")
    at = pages.select("case_id", "page", "page_no", "offset_ms").join(sheets.select("page", "species", "mv_per_px", "ms_per_px"), "page")
    found = read.select("page", "ii_confidence", "leads_reliable", F.explode("beats").alias("b")).select("page", "ii_confidence", "leads_reliable", "b.*").drop("wide")
    b = found.withColumnRenamed("beat_index", "beat_id").join(at, "page")
    b = findings.flagged(b, F.col("species"))
    areas = {f"area_{k}": F.when(F.col("usable"), F.col(f"area_{k}_marked")).otherwise(F.col(f"area_{k}_around")) for k in bridge.AREA_LEADS}
    b = b.withColumns(areas).drop(*[f"{a}_{how}" for a in areas for how in ("marked", "around")])
    b = b.withColumn("rr_ii_ms", F.col("t_ii_ms") - F.lag("t_ii_ms").over(rhythm.by_page())).withColumn("at_ms", F.col("offset_ms") + F.col("t_ms"))
    case = rhythm.whole_case().orderBy("page_no", "t_ms", "beat_id")
    return cut(b.withColumn("global_index", (F.row_number().over(case) - 1).cast("long")), "flagged"), bad


def values(beats: DataFrame, leads: DataFrame, cases: DataFrame, shifts: DataFrame | None = None) -> DataFrame:
    """measure.measured of the beats fit for it, with species and size. leads: page, ii_mv, ii_bad; cases: case_id, species, size; shifts: page, shift_mv of a baseline drawn by hand."""
    fit = findings.measurement_beats(beats)
    fit = fit.withColumn("next_q_on", F.lead("q_on").over(rhythm.by_page()))
    n = fit.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_selected"))
    x = fit.withColumnRenamed("global_index", "beat").withColumn("beat_confidence", F.col("confidence"))
    x = x.join(leads.select("page", F.col("ii_mv").alias("mv"), F.col("ii_bad").alias("bad")), "page")
    x = x.join(shifts.select("page", "shift_mv"), "page", "left") if shifts is not None else x.withColumn("shift_mv", F.lit(0.0))
    samples = measure.sampled(x, F.col("species"))
    why = cases.join(n, "case_id", "left").join(findings.empty_reason(beats).withColumnRenamed("reason", "_why"), "case_id", "left")
    why = why.select("case_id", "species", F.coalesce("n_selected", F.lit(0)).alias("n_selected"), F.coalesce("_why", "no_beats_reason").alias("empty_reason"))
    return measure.measured(why, samples).join(cases.select("case_id", "size"), "case_id")


def analyze(sheets: DataFrame, signals: DataFrame, settings: DataFrame, shifts: DataFrame | None = None) -> Case:
    """Analyze every case of `settings` (case_id, species, size, drugs, minutes, together).

    sheets: case_id, page (unique), upload, digest, date, width, crop, labels, rates, left_px, plot_px, px_per_second, px_per_mm, mm_per_s, mv_per_px, ms_per_px, confidence; signals: page, lead, position,
    confidence, mv, bad. Copies, repeated stretches and other animals' sheets don't count (other animals do where together is set). Beats are found page by page; flags, findings and values are
    windows and sums over a case. A page whose beats fail gives an issue; a case without sheets, signals or beats gets a text that says so.

    All leads' samples are read once, page by page (bridge.read_pages), lead II's once more for values; what is written between is one row a page and one row a beat."""
    return analyze_pages(sheets, bridge.read_pages(signals.select("page", "lead", "position", "confidence", "mv", "bad").join(facts(sheets, settings), "page")), settings, shifts)


def analyze_pages(sheets: DataFrame, read: DataFrame, settings: DataFrame, shifts: DataFrame | None = None) -> Case:
    """analyze from pages whose samples are read already: bridge.read_pages' rows, made with facts' columns."""
    read = cut(read, "read")
    case_key = settings.select("case_id", "species", "size", "drugs", "minutes", F.coalesce("together", F.lit(False)).alias("together"))
    s = sheets.join(case_key.select("case_id", "species"), "case_id")
    n = read.select("page", "n_samples")
    s = cut(order.with_spans(s.drop("n_samples").join(n, "page", "left").withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))), "sheets")
    o = cut(order.ordered(s), "order")
    pages = cut(order.offsets(s, o, case_key.filter("together")), "pages")
    flagged, failed = beats_of(pages, s, read)
    beats = cut(featured(flagged, read.select("page", F.explode("beats").alias("b")).select("page", F.col("b.beat_index").alias("beat_id"), "b.wide")), "case-beats")
    ends = pages.groupBy("case_id").agg(F.max(F.col("offset_ms") + F.col("duration_s") * 1000).alias("end_ms"))
    ect = findings.ectopics(beats, F.col("species"))
    epi = findings.episodes(beats, ect, ends)
    pauses = rhythm.pauses(beats, beats).select("case_id", "page", "beat_id", F.floor(F.col("at_ms") - F.col("rr_ms") + 0.5).cast("double").alias("start_ms"), F.floor(F.col("rr_ms") + 0.5).cast("double").alias("duration_ms"))
    counted = pages.join(s.select("page", "confidence", "mv_per_px", "ms_per_px"), "page").join(read.select("page", "n_leads", "n_reliable"), "page", "left").join(o.select("page", "ordered"), "page")
    per = counted.groupBy("case_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_pages"), F.sum("duration_s").alias("seconds"), F.first("covered_ms").alias("covered_ms"), F.max("mv_per_px").alias("mv_per_px"), F.max("ms_per_px").alias("ms_per_px"),
        F.coalesce(F.sum("n_leads"), F.lit(0)).cast("int").alias("n_leads"), F.coalesce(F.sum("n_reliable"), F.lit(0)).cast("int").alias("n_reliable"),
    )
    issues = o.groupBy("case_id").agg(F.first("issues").alias("_issues"), F.transform(F.array_sort(F.collect_list(F.when(~F.col("primary") & (F.col("page") == F.col("original")), F.col("page")))), lambda p: F.concat(F.lit("pages_excluded:"), p)).alias("_other"))
    bad = failed.groupBy("case_id").agg(F.array_sort(F.collect_set("issue")).alias("_failed"))
    c = case_key.join(per, "case_id", "left").join(issues, "case_id", "left").join(bad, "case_id", "left")
    none = F.array().cast("array<string>")
    c = c.withColumn("n_pages", F.coalesce("n_pages", F.lit(0))).withColumn("no_beats_reason", F.when(F.col("n_pages") == 0, "no_pages").otherwise("no_beats"))
    c = c.withColumn("issues", F.concat(F.coalesce("_issues", none), F.when(F.col("together"), none).otherwise(F.coalesce("_other", none)), F.coalesce("_failed", none)))
    c = cut(c.drop("_failed", "_issues"), "cases")
    m = cut(values(beats, read, c, shifts), "values")
    hr = findings.heart_rate(beats)
    known = c.select("case_id", "species", "size", "no_beats_reason", "n_pages").join(beats.groupBy("case_id").agg(F.count(F.lit(1)).cast("int").alias("n_beats")), "case_id", "left")
    rates = known.join(hr, "case_id", "left").select(
        "case_id", "species", "size", F.coalesce("n_beats", F.lit(0)).alias("n_beats"), "hr_mean", "hr_min", "hr_max", "source", *[F.coalesce(f"{x}_confidence", F.lit(0.0)).alias(f"c_{x}") for x in ("mean", "min", "max")],
        F.when(F.col("hr_mean").isNull(), F.when(F.col("n_beats").isNull(), F.col("no_beats_reason")).otherwise("too_few_beats")).alias("reason"),
    )
    rates = cut(rates, "rates")
    return Case(o, pages, beats, ect, epi, pauses, m, rates, report(c, counted, beats, ect, epi, pauses, m, rates))


def report(cases: DataFrame, counted: DataFrame, beats: DataFrame, ect: DataFrame, epi: DataFrame, pauses: DataFrame, measured: DataFrame, rates: DataFrame) -> DataFrame:
    """One row a case: confidence, issues, flags, counts, type, reasons, axis, sinus_arrhythmia, hr_mean and text."""
    spark = cases.sparkSession
    found = findings.report(beats, F.col("species")).drop("n_pauses")
    lists = pauses.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "duration_ms"))).alias("pauses"))
    numbers = [x.groupBy("case_id").agg(F.count(F.lit(1)).cast("int").alias(name)) for x, name in ((ect, "n_ectopics"), (epi, "n_episodes"))]
    ceiling = views.precision_ceiling(measured.join(cases.select("case_id", "mv_per_px"), "case_id"))
    trust = views.case_confidence(counted.withColumn("order_known", F.col("ordered")))
    c = cases
    for x in (found, lists, *numbers, ceiling, trust, rates.select("case_id", "n_beats", "hr_mean", F.col("reason").alias("_rate_reason"))):
        c = c.join(x, "case_id", "left")
    empty = F.array().cast("array<struct<start_ms:double,duration_ms:double>>")
    first = measured.withColumn("_no", F.array_position(F.array(*[F.lit(k) for k in measure.WAVES]), F.col("key"))).groupBy("case_id").agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("_no"))).alias("_reason"))
    c = c.join(first, "case_id", "left").withColumns({
        "type": F.coalesce("type", F.lit("undetermined")), "reasons": F.coalesce("reasons", F.array(F.lit("no_beats"))), "sinus_arrhythmia": F.coalesce("sinus_arrhythmia", F.lit(False)), "pauses": F.coalesce("pauses", empty),
        "n_ectopics": F.coalesce("n_ectopics", F.lit(0)), "n_episodes": F.coalesce("n_episodes", F.lit(0)), "confidence": F.coalesce("confidence", F.lit(0.0)), "seconds": F.coalesce("seconds", F.lit(0.0)),
        "n_leads": F.coalesce("n_leads", F.lit(0)), "n_reliable": F.coalesce("n_reliable", F.lit(0)), "first_reason": F.coalesce("_rate_reason", "_reason", F.get("reasons", 0)),
        "flags": F.array_compact(F.array(F.when(F.col("together") & F.array_contains("issues", "multiple_animals"), "analyze_together_forced"), F.when(F.coalesce("ceiling", F.lit(False)), "precision_ceiling"))),
    })
    c = cut(c, "facts")
    places = ect.select("case_id", F.col("global_index").alias("beat"), "kind", "focus", "coupling_ms")
    axes = c.select("case_id", "species", "size", "axis")
    text = conclusion.compose(c.drop("axis", "n_ectopics", "n_episodes", "hr_mean"), cut(conclusion.parameter_rows(measured, spark), "rows"), cut(conclusion.rate_rows(rates, spark), "rate-rows"), cut(conclusion.axis_rows(axes, spark), "axis-rows"), conclusion.ectopic_items(places), conclusion.episode_items(epi))
    keep = ["case_id", "species", "confidence", "issues", "flags", "n_pages", "n_beats", "n_ectopics", "n_episodes", F.size("pauses").alias("n_pauses"), "type", "reasons", "axis", "sinus_arrhythmia", "hr_mean", "covered_ms"]
    return c.select(*keep).join(text, "case_id")
