"""A sheet put together from its parts: variant, grid confidence, baselines, calibration, read words, issues, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulseframe.functions.exprs import clamp01, half_up
from pulseframe.operators import spans
from pulseframe.operators.views import DEFAULT_CALIBRATION

#: Weights of the votes for a variant; factor of a sheet whose labels contradict its traces; slack of explained coverage; least width of a sheet (px).
VOTES = {"rrRow": 1.5, "header": 1.5, "frame": 1.0, "height": 1.0}
MISMATCH, COVER_SLACK, LEAST_WIDTH = 0.5, 0.002, 800
#: Ink and glyphs that a digit row needs at least, and ink above it at most (a share).
ROW_INK, ROW_GLYPHS, ROW_ABOVE = 150, 15, 0.15
LEADS = ("I", "II", "III", "aVR", "aVL", "aVF")


def saturated(x: Column, zero: float, one: float) -> Column:
    """0 at `zero`, 1 at `one`, linear between."""
    return clamp01((x - zero) / (one - zero))


def grid_confidence(x_period: Column, y_period: Column, contrast: Column, rms: Column, peaks: Column, px_s: Column) -> Column:
    """The least of five factors: contrast, fit, isotropy, number of peaks, and the measured second (0.85 without one)."""
    period = (x_period + y_period) / 2
    seconds = F.when(px_s.isNull(), 0.85).otherwise(saturated(F.abs(px_s - 50 * x_period), 3.0, 1.0))
    return F.least(saturated(contrast, 1.2, 1.8), saturated(rms, 0.5, 0.2), saturated(F.abs(x_period - y_period) / period, 0.03, 0.01), saturated(peaks, 3.0, 8.0), seconds)


def grid_baselines(grid_row_y: Column, dy: Column, phase_y: Column, px_mm_y: Column, offset_mm: Column, step_mm: Column) -> Column:
    """Six baselines from the five-millimetre row that is nearest to where the profile expects it."""
    step = 5 * px_mm_y
    row = phase_y + half_up((grid_row_y + dy - phase_y) / step) * step
    return F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: row + (offset_mm + k * step_mm) * px_mm_y)


def profile_baselines(first_y: Column, dy: Column, step_px: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: first_y + dy + k * step_px)


def nearest_variant(heights: DataFrame, variants: DataFrame, tolerance: float) -> DataFrame:
    """sheet and variant: the variant (variant, expected) with the least relative error of height, the first by name on ties, null beyond the tolerance. There are a few variants."""
    j = heights.crossJoin(F.broadcast(variants)).withColumn("_e", F.abs(F.col("height") - F.col("expected")) / F.col("expected"))
    b = j.groupBy("sheet").agg(F.min(F.struct("_e", "variant")).alias("b"))
    return b.select("sheet", F.when(F.col("b._e") <= tolerance, F.col("b.variant")).alias("variant"))


def has_digit_row(dark: Column, transitions: Column, above: Column) -> Column:
    """A row of digits has enough ink, many separate glyphs, and almost nothing above."""
    return (dark >= ROW_INK) & (transitions >= ROW_GLYPHS) & (above <= ROW_ABOVE * dark)


def choose_calibration(pages: DataFrame) -> DataFrame:
    """mm_s, mm_mv, source and overridden ("speed/gain" of a footer that a manual calibration contradicts). pages: page, hand_s, hand_mv, foot_s, foot_mv."""
    valid = lambda s, m: F.coalesce((F.col(s) > 0) & (F.col(m) > 0), F.lit(False))
    hand, foot = valid("hand_s", "hand_mv"), valid("foot_s", "foot_mv")
    pick = lambda h, f, d: F.when(hand, F.col(h)).when(foot, F.col(f)).otherwise(d)
    differs = hand & foot & ((F.col("hand_s") != F.col("foot_s")) | (F.col("hand_mv") != F.col("foot_mv")))
    text = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    return pages.select(
        "page", pick("hand_s", "foot_s", DEFAULT_CALIBRATION[0]).alias("mm_s"), pick("hand_mv", "foot_mv", DEFAULT_CALIBRATION[1]).alias("mm_mv"),
        F.when(hand, "manual").when(foot, "footer").otherwise("default").alias("source"), F.when(differs, F.concat_ws("/", text("foot_s"), text("foot_mv"))).alias("overridden"),
    )


def order_mismatch(labels: DataFrame, leads: DataFrame) -> DataFrame:
    """page and mismatch: some label (page, lead, y) is nearest to another lead's baseline (page, lead, position, baseline_y), the first on ties."""
    return mismatch_of_pages(labels.groupBy("page").agg(F.collect_list(F.struct("lead", "y")).alias("labels")).join(leads.groupBy("page").agg(F.collect_list(F.struct("lead", "position", "baseline_y")).alias("leads")), "page"))


def mismatch_of_pages(pages: DataFrame) -> DataFrame:
    """order_mismatch for pages with their labels (array of lead, y) and leads (array of lead, position, baseline_y), a few each: a row a page, where pairs would be a row each."""
    nearest = lambda y: F.array_min(F.transform("leads", lambda l: F.struct(F.abs(l["baseline_y"] - y).alias("d"), l["position"].alias("position"), l["lead"].alias("lead"))))["lead"]
    return pages.select("page", F.exists("labels", lambda x: nearest(x["y"]) != x["lead"]).alias("mismatch"))


def header_unanchored(crop_w: Column, crop_h: Column, zone_w: Column) -> Column:
    """The name's crop is empty or still the whole zone."""
    return (crop_w == 0) | (crop_h == 0) | F.coalesce(crop_w >= zone_w, F.lit(False))


def coverage_explained(coverage: Column, marked: Column, columns: Column) -> Column:
    """What a trace lacks is what its gaps and clipped stretches take."""
    return 1 - coverage <= marked / columns + COVER_SLACK


def collected_issues(codes: DataFrame) -> DataFrame:
    """page and issues: exceptions first, then the rest, each once, as they came. codes: page, place, code."""
    first = codes.groupBy("page", "code").agg(F.min("place").alias("place"))
    g = first.groupBy("page").agg(F.array_sort(F.collect_list(F.struct((~F.col("code").startswith("exception:")).alias("later"), "place", "code"))).alias("xs"))
    return g.select("page", F.transform("xs", lambda x: x["code"]).alias("issues"))


def sheet_confidence(layout: Column, lead_mean: Column, n_leads: Column, failures: Column, mismatch: Column) -> Column:
    c = F.least(layout, lead_mean) * F.when(mismatch, MISMATCH).otherwise(1.0)
    return F.when((failures > 0) | (n_leads == 0), 0.0).otherwise(clamp01(c))


def error_code(message: Column) -> Column:
    """An exception as a stable code."""
    return F.concat(F.lit("exception:"), F.substring_index(F.coalesce(message, F.lit("unknown")), "\n", 1))


def number_row(words: DataFrame, prefix: str) -> DataFrame:
    """page, numbers (value and x of the middle, by x), issues and confidence: the share of words read, times their mean score. words: page, word, x, width, text (digits; null or ? unread), score.
    A page without words has no row."""
    read = F.col("text").isNotNull() & ~F.col("text").contains("?")
    w = words.select("page", "x", "score", read.alias("ok"), F.struct(F.when(read, F.col("text").try_cast("long")).alias("value"), (F.col("x") + (F.col("width") - 1) / 2).alias("x")).alias("n"))
    by_x = lambda test, what: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("x", what.alias("v"))))), lambda s: s["v"])
    return w.groupBy("page").agg(
        by_x(F.col("ok"), F.col("n")).alias("numbers"), by_x(~F.col("ok"), F.concat(F.lit(f"{prefix}_number_unread:"), F.col("x"))).alias("issues"),
        (F.count_if("ok") / F.count(F.lit(1)) * F.coalesce(F.avg(F.when(F.col("ok"), F.col("score"))), F.lit(0.0))).alias("confidence"),
    )


def time_seconds(digits: Column, colon: Column, gap: Column) -> Column:
    """Seconds of a time label: four digits with a colon (or a gap of two pixels) after the second are minutes and seconds; a colon elsewhere is unread; else whole seconds."""
    parted = (F.length(digits) == 4) & (colon | (gap >= 2))
    clock = F.substring(digits, 1, 2).cast("long") * 60 + F.substring(digits, 3, 2).cast("long")
    return F.when(parted, clock).when(~colon, digits.cast("long"))


def label_issues(found: Column) -> Column:
    """Codes of missing lead labels, and of six in the wrong order."""
    names = F.array(*[F.lit(x) for x in LEADS])
    missing = F.transform(F.array_except(names, found), lambda x: F.concat(F.lit("lead_label_missing:"), x))
    return F.concat(missing, F.when((F.size(found) == len(LEADS)) & (found != names), F.array(F.lit("lead_labels_order"))).otherwise(F.array().cast("array<string>")))


def beside(words: DataFrame, anchors: DataFrame, gap: float, before: bool) -> DataFrame:
    """page, anchor and word: the word nearest to each anchor on one side, within `gap` pixels. words: page, word, x, width; anchors: page, anchor, x, width."""
    a = anchors.select("page", "anchor", F.col("x").alias("_x"), F.col("width").alias("_w"))
    distance = (F.col("_x") - (F.col("x") + F.col("width"))) if before else (F.col("x") - (F.col("_x") + F.col("_w")))
    j = words.join(a, "page").withColumn("_d", distance).filter((F.col("_d") >= 0) & (F.col("_d") <= gap))
    return j.groupBy("page", "anchor").agg(F.min_by("word", F.struct("_d", "word")).alias("word"))


def header_time(date: Column, time: Column) -> Column:
    """A timestamp from eight digits of date (day, month, year) and six of time; null if either is not complete."""
    ok = date.rlike("^[0-9]{8}$") & time.rlike("^[0-9]{6}$")
    return F.when(ok, F.try_to_timestamp(F.concat(date, time), F.lit("ddMMyyyyHHmmss")))


def lines(boxes: DataFrame, slack: float = 0.0) -> DataFrame:
    """page, line (from 0 downwards), box, place (from 0 rightwards): boxes (page, box, x, y, width, height) whose rows overlap or touch, `slack` rows apart at most, are one line."""
    w = W.partitionBy("page").orderBy("y", "x", "box")
    b = boxes.withColumn("_reach", F.max(F.col("y") + F.col("height") - 1).over(w.rowsBetween(W.unboundedPreceding, -1)))
    b = b.withColumn("line", F.sum(F.coalesce(F.col("y") > F.col("_reach") + 1 + slack, F.lit(False)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return b.select("page", "line", "box", (F.row_number().over(W.partitionBy("page", "line").orderBy("x", "y", "box")) - 1).alias("place"))


def words(boxes: DataFrame, gap: float) -> DataFrame:
    """page, word (from 0) and box: boxes by x, with a new word after `gap` empty columns."""
    w = W.partitionBy("page").orderBy("x", "box")
    b = boxes.withColumn("_reach", F.max(F.col("x") + F.col("width") - 1).over(w.rowsBetween(W.unboundedPreceding, -1)))
    return b.select("page", F.sum(F.coalesce(F.col("x") - F.col("_reach") - 1 >= gap, F.lit(False)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("word"), "box")


def box_union(boxes: DataFrame, key: list[str]) -> DataFrame:
    """The rectangle around a key's boxes, with the sum of their areas."""
    x1, y1 = F.max(F.col("x") + F.col("width")), F.max(F.col("y") + F.col("height"))
    u = boxes.groupBy(*key).agg(F.min("x").alias("x"), F.min("y").alias("y"), x1.alias("_x1"), y1.alias("_y1"), F.sum("area").alias("area"))
    return u.select(*key, "x", "y", (F.col("_x1") - F.col("x")).alias("width"), (F.col("_y1") - F.col("y")).alias("height"), "area")


def in_zone(components: DataFrame, zones: DataFrame, slack: float = 2.0) -> DataFrame:
    """Components (page, component, x, y, width, height) with the zones (page, zone, zx, zy, zwidth, zheight) that hold their centre, within `slack` pixels. A page has a few zones."""
    cx, cy = F.col("x") + (F.col("width") - 1) / 2, F.col("y") + (F.col("height") - 1) / 2
    inside = cx.between(F.col("zx") - slack, F.col("zx") + F.col("zwidth") - 1 + slack) & cy.between(F.col("zy") - slack, F.col("zy") + F.col("zheight") - 1 + slack)
    return components.join(zones, "page").filter(inside).select("page", "component", "zone")


def expanded(stretches: DataFrame, pad: int) -> DataFrame:
    """Unreliable stretches (page, kind, start_ms, end_ms, length; places in samples) widened by the filter's reach, but for ambiguous ones, and merged where neighbours of one kind then touch."""
    wide = F.col("kind") != "ambiguous"
    s = stretches.withColumn("start_ms", F.when(wide, F.greatest(F.lit(0), F.col("start_ms") - pad)).otherwise(F.col("start_ms"))).withColumn("end_ms", F.when(wide, F.least(F.col("length") - 1, F.col("end_ms") + pad)).otherwise(F.col("end_ms")))
    w = W.partitionBy("page").orderBy("start_ms", "end_ms", "kind")
    s = s.withColumn("run", F.sum((F.coalesce(F.lag("kind").over(w) != F.col("kind"), F.lit(False))).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return spans.merged(s, ["page", "kind", "run"], 1.0).drop("run")
