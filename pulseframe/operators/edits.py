"""A log of manual edits folded onto pages: routing, calibration and scale, baselines, markers, labels.

edits: case_id, seq, kind (calibration, separator, baseline, leadLabel, marker), page (null: all pages), and what the kind names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What prefix of reasons a marker of each field clears.
CLEARED = {"p_on": "p_", "p_off": "p_", "q_on": "qrs_", "s_off": "qrs_", "t_off": "t_"}


def routed(edits: DataFrame, pages: DataFrame) -> DataFrame:
    """Edits with the page that each applies to; a calibration without a page goes to every page of its case. Edits of pages that don't exist are left out (see skipped)."""
    p = pages.select("case_id", F.col("page").alias("_page"))
    hits = (F.col("page") == F.col("_page")) | ((F.col("kind") == "calibration") & F.col("page").isNull())
    return edits.join(p, "case_id").filter(hits).withColumn("page", F.col("_page")).drop("_page")


def skipped(edits: DataFrame, pages: DataFrame) -> DataFrame:
    """case_id and code (edit_skipped:kind:page) for edits of a page that the case lacks."""
    p = pages.select("case_id", "page").distinct()
    lost = edits.filter("page IS NOT NULL").join(p, ["case_id", "page"], "left_anti")
    return lost.select("case_id", "seq", F.concat_ws(":", F.lit("edit_skipped"), "kind", F.col("page").cast("string")).alias("code"))


def valid_scale(x: Column, y: Column) -> Column:
    """Both missing, or both positive numbers."""
    ok = (x > 0) & (y > 0) & ~F.isnan(x) & ~F.isnan(y)
    return (x.isNull() & y.isNull()) | F.coalesce(ok, F.lit(False))


def precision(px_mm_x: Column, px_mm_y: Column, mm_s: Column, mm_mv: Column) -> tuple[Column, Column]:
    """mV and ms a pixel; 0 without a grid."""
    grid = F.coalesce((px_mm_x > 0) & (px_mm_y > 0), F.lit(False))
    return F.when(grid, 1 / (px_mm_y * mm_mv)).otherwise(0.0), F.when(grid, 1000 / (px_mm_x * mm_s)).otherwise(0.0)


def calibrated(pages: DataFrame, own: DataFrame) -> DataFrame:
    """Pages (case_id, page, mm_s, mm_mv, source, footer_mm_s, footer_mm_mv, px_mm_x, px_mm_y) with their calibration edits applied, in order of seq: mm_s, mm_mv, source, px_mm_x, px_mm_y, mv_per_px, ms_per_px,
    grid_manual and overrides_footer. own: routed edits with mm_s, mm_mv, x, y. The last valid edit wins, but one that brings a scale and repeats the page's calibration only sets the scale."""
    k = own.filter("kind = 'calibration'").select("case_id", "page", "seq", F.col("mm_s").alias("_s"), F.col("mm_mv").alias("_m"), "x", "y")
    k = k.filter(F.coalesce((F.col("_s") > 0) & (F.col("_m") > 0), F.lit(False)) & valid_scale(F.col("x"), F.col("y")))
    j = k.join(pages.select("case_id", "page", "mm_s", "mm_mv"), ["case_id", "page"])
    only_scale = F.col("x").isNotNull() & (F.col("_s") == F.col("mm_s")) & (F.col("_m") == F.col("mm_mv"))
    last = j.groupBy("case_id", "page").agg(
        F.max_by(F.struct("_s", "_m"), F.when(~only_scale, F.col("seq"))).alias("c"), F.max(F.when(~only_scale, F.col("seq"))).alias("cs"),
        F.max_by(F.struct("x", "y"), F.when(F.col("x").isNotNull(), F.col("seq"))).alias("g"), F.max(F.when(F.col("x").isNotNull(), F.col("seq"))).alias("gs"),
    )
    p = pages.join(last, ["case_id", "page"], "left")
    by_hand, scaled = F.col("cs").isNotNull(), F.col("gs").isNotNull()
    s, m = (F.when(by_hand, F.col(f"c.{e}")).otherwise(F.col(c)) for e, c in (("_s", "mm_s"), ("_m", "mm_mv")))
    x, y = (F.when(scaled, F.col(f"g.{e}")).otherwise(F.col(c)) for e, c in (("x", "px_mm_x"), ("y", "px_mm_y")))
    p = p.select("case_id", "page", s.alias("mm_s"), m.alias("mm_mv"), F.when(by_hand, "manual").otherwise(F.col("source")).alias("source"), x.alias("px_mm_x"), y.alias("px_mm_y"), scaled.alias("grid_manual"), "footer_mm_s", "footer_mm_mv")
    mv, ms = precision(F.col("px_mm_x"), F.col("px_mm_y"), F.col("mm_s"), F.col("mm_mv"))
    over = (F.col("source") == "manual") & (F.col("footer_mm_s") > 0) & (F.col("footer_mm_mv") > 0) & ((F.col("footer_mm_s") != F.col("mm_s")) | (F.col("footer_mm_mv") != F.col("mm_mv")))
    return p.withColumn("mv_per_px", mv).withColumn("ms_per_px", ms).withColumn("overrides_footer", F.coalesce(over, F.lit(False))).drop("footer_mm_s", "footer_mm_mv")


def baselines(leads: DataFrame, own: DataFrame) -> DataFrame:
    """Leads (case_id, page, lead, baseline_y, mv_per_px) with the last baseline edit of each (lead, y) and shift_mv, how much higher the signal then is."""
    last = own.filter((F.col("kind") == "baseline") & F.col("y").isNotNull() & ~F.isnan("y")).groupBy("case_id", "page", "lead").agg(F.max_by("y", "seq").alias("_y"))
    j = leads.join(last, ["case_id", "page", "lead"], "left")
    return j.select("case_id", "page", "lead", F.coalesce("_y", "baseline_y").alias("baseline_y"), ((F.col("_y") - F.col("baseline_y")) * F.col("mv_per_px")).alias("shift_mv"))


def marked_beats(beats: DataFrame, own: DataFrame) -> DataFrame:
    """Beats (case_id, page, position, p_on, p_off, q_on, s_off, t_off, p_found, confidence, reasons) with the last marker of each field (position, field, t_ms): the beat's
    confidence is then 1, a P marker means P was found, and reasons of the marked wave go; others, such as unreliable_segment, stay."""
    k = own.filter((F.col("kind") == "marker") & F.col("t_ms").isNotNull() & F.col("field").isin(*CLEARED)).groupBy("case_id", "page", "position", "field").agg(F.max_by("t_ms", "seq").alias("t"))
    k = k.groupBy("case_id", "page", "position").agg(F.map_from_entries(F.collect_list(F.struct("field", "t"))).alias("m"))
    j = beats.join(k, ["case_id", "page", "position"], "left")
    fields = F.coalesce(F.map_keys("m"), F.array().cast("array<string>"))
    gone = F.transform(fields, lambda f: F.create_map(*[F.lit(x) for kv in CLEARED.items() for x in kv])[f])
    out = {c: F.coalesce(F.col("m")[c], F.col(c)) for c in CLEARED}
    return j.select(
        "case_id", "page", "position", *[v.alias(c) for c, v in out.items()], (F.col("p_found") | F.arrays_overlap(fields, F.array(F.lit("p_on"), F.lit("p_off")))).alias("p_found"),
        F.when(F.size(fields) > 0, 1.0).otherwise(F.col("confidence")).alias("confidence"), F.filter("reasons", lambda r: ~F.exists(gone, lambda g: r.startswith(g))).alias("reasons"),
    )


def automatic_label(edits: DataFrame, leads: tuple[str, ...]) -> DataFrame:
    """key, slot, lead: the automatic label of the trace that stands in each slot after its page's label edits (key, seq, lead, target): the latest edit wins, else the trace
    itself; a slot that none takes is null."""
    last = edits.groupBy("key", "lead").agg(F.max_by(F.struct("target"), "seq")["target"].alias("target"), F.max("seq").alias("rank"))
    keys = edits.select("key").distinct()
    each = keys.select("key", F.posexplode(F.array(*[F.lit(x) for x in leads])).alias("position", "lead"))
    at = each.join(last, ["key", "lead"], "left").select("key", "lead", "position", F.when(F.col("rank").isNull(), F.col("lead")).otherwise(F.col("target")).alias("slot"), F.coalesce("rank", F.lit(-1)).alias("rank"))
    best = at.filter("slot IS NOT NULL").groupBy("key", "slot").agg(F.max_by("lead", F.struct("rank", "position")).alias("found"))
    return each.select("key", F.col("lead").alias("slot")).join(best, ["key", "slot"], "left").select("key", "slot", F.col("found").alias("lead"))


def swap(labels: DataFrame, swaps: DataFrame) -> DataFrame:
    """The label edits (key, lead, target) that exchange two slots. labels: automatic_label's; swaps: key, a, b. A trace that already has the label needs none."""
    s = swaps.filter("a <> b").select("key", F.explode(F.array(F.struct(F.col("a").alias("slot"), F.col("b").alias("target")), F.struct(F.col("b").alias("slot"), F.col("a").alias("target")))).alias("x")).select("key", "x.*")
    return s.join(labels, ["key", "slot"]).filter("lead IS NOT NULL AND lead <> target").select("key", "lead", "target")
