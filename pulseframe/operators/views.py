"""A case as it is shown: result rows, tab-separated text, notes, hints from sheets, settings, order and badges of sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulseframe.functions.exprs import half_up
from pulseframe.operators import conclusion
from pulseframe.plans import constants as C
from pulseframe.plans import phrases as P

#: Calibration without a footer (mm a second, mm a mV).
DEFAULT_CALIBRATION = (50.0, 10.0)


def status(n_sheets: Column, has_result: Column, n_waiting: Column) -> Column:
    """empty, ready, pending (sheets are still queued or analysed) or failed."""
    return F.when(n_sheets == 0, "empty").when(has_result, "ready").when(n_waiting > 0, "pending").otherwise("failed")


def joined_notes(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array_compact(F.array(*parts)), lambda p: p != ""), "; ")


def result_rows(rows: DataFrame) -> DataFrame:
    """rows (case_id, key, label, value, norm, verdict, note, and the measured value m_value, m_reason, m_source) as shown: tone and notes added. An unreliable
    row shows no verdict; a reliable one says where it comes from and whether a wave is too small."""
    unsure = F.col("value") == P.TABLE["unreliable"]
    source = F.when(F.col("m_source") == "all_leads", "from all leads")
    small = F.when((F.col("m_value") == 0) & F.col("m_reason").isin("q_absent", "r_absent", "s_absent"), conclusion.lookup(P.REASONS, F.col("m_reason")))
    tone = F.when(unsure, "unreliable").when(F.col("verdict") == "n/a", "none").otherwise(F.col("verdict"))
    return rows.select("case_id", "key", "label", "value", "norm", F.when(unsure, "n/a").otherwise(F.col("verdict")).alias("verdict"), tone.alias("tone"), F.when(unsure, F.col("note")).otherwise(joined_notes(source, small, F.col("note"))).alias("note"))


def rhythm_row(kind: Column, reasons: Column, arrhythmia: Column, pauses: Column, species: Column) -> Column:
    """value, tone and note of the rhythm. A pause cancels sinus arrhythmia and is borderline; in cats sinus arrhythmia is a deviation."""
    calm = arrhythmia & (F.size(pauses) == 0)
    said = F.array_join(conclusion.known_reasons(reasons), ", ")
    pause = F.transform(pauses, lambda p: F.concat(F.lit("pause "), conclusion.measured_text(p["duration_ms"], F.lit("ms")), F.lit(" ms at "), conclusion.measured_text(p["start_ms"] / 1000, F.lit("s")), F.lit(" s")))
    tone = F.when(kind == "sinus", F.when(calm & (species == "cat"), "abnormal").when(F.size(pauses) > 0, "border").otherwise("norm")).when(kind == "non_sinus", "abnormal").otherwise("unreliable")
    note = joined_notes(said, F.when(calm, F.when(species == "cat", "sinus arrhythmia (unusual)").otherwise("sinus arrhythmia (usual)")), F.array_join(pause, "; "))
    return F.struct(conclusion.lookup(P.RHYTHM, kind, F.lit(P.RHYTHM["undetermined"])).alias("value"), tone.alias("tone"), note.alias("note"))


def verdict_text(tone: Column, norm: Column) -> Column:
    """The verdict in words; a dash for a row whose species has no verdict, nothing for rows without a range."""
    return F.when(tone == "none", F.when(norm != "", "—").otherwise("")).otherwise(conclusion.lookup(P.TONES, tone, F.lit("")))


def tsv_cell(text: Column) -> Column:
    """Tabs and line ends as one space."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t\r\n]+", " "))


def tsv_line(*cells: Column) -> Column:
    return F.concat_ws("\t", *[tsv_cell(c) for c in cells])


def tsv(rows: DataFrame) -> DataFrame:
    """case_id and tsv: header and rows in order. rows: case_id, place, label, value, norm, tone, note."""
    line = tsv_line(F.col("label"), F.col("value"), F.col("norm"), verdict_text(F.col("tone"), F.col("norm")), F.col("note"))
    g = rows.select("case_id", F.struct("place", line.alias("line")).alias("x")).groupBy("case_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return g.select("case_id", F.array_join(F.concat(F.array(F.lit("\t".join(P.TSV_HEADER))), F.transform("xs", lambda x: x["line"])), "\n").alias("tsv"))


def clipboard_text(tsv_: Column, notes: Column, text: Column) -> Column:
    """Table, notes and text with empty lines between; empty parts are left out."""
    return F.array_join(F.filter(F.array(tsv_, F.array_join(notes, "\n"), F.coalesce(text, F.lit(""))), lambda p: p != ""), "\n\n")


def species_hint(sheets: DataFrame) -> DataFrame:
    """case_id, species (of the first sheet with a known header letter) and mixed (several). sheets: case_id, place, letter (D or C)."""
    s = sheets.withColumn("s", conclusion.lookup({"D": "dog", "C": "cat"}, F.col("letter")))
    return s.groupBy("case_id").agg(F.min_by("s", F.when(F.col("s").isNotNull(), F.col("place"))).alias("species"), (F.count_distinct("s") > 1).alias("mixed"))


def footer_hint(sheets: DataFrame) -> DataFrame:
    """case_id, mm_s and mm_mv of the first sheet with a valid footer, and mismatch. sheets: case_id, place, mm_s, mm_mv."""
    ok = F.coalesce((F.col("mm_s") > 0) & (F.col("mm_mv") > 0), F.lit(False))
    first = F.min_by(F.struct("mm_s", "mm_mv"), F.when(ok, F.col("place")))
    h = sheets.groupBy("case_id").agg(first.alias("f"), F.count_distinct(F.when(ok, F.concat_ws("/", "mm_s", "mm_mv"))).alias("n"))
    return h.select("case_id", F.when(F.col("n") > 0, F.col("f.mm_s")).alias("mm_s"), F.when(F.col("n") > 0, F.col("f.mm_mv")).alias("mm_mv"), (F.col("n") > 1).alias("mismatch"))


def settings(cases: DataFrame) -> DataFrame:
    """Effective settings and where they come from: by hand, else from headers and footers, else the default. cases: case_id, hand_species, hint_species, hand_mm_s, hand_mm_mv,
    hint_mm_s, hint_mm_mv, hand_minutes, covered_ms."""
    source = lambda hand, hint, name: F.when(hand.isNotNull(), "manual").when(hint.isNotNull(), name).otherwise("default")
    speed, gain = DEFAULT_CALIBRATION
    return cases.select(
        "case_id", F.coalesce("hand_species", "hint_species", F.lit("dog")).alias("species"), source(F.col("hand_species"), F.col("hint_species"), "header").alias("species_source"),
        F.coalesce("hand_mm_s", "hint_mm_s", F.lit(speed)).alias("mm_s"), F.coalesce("hand_mm_mv", "hint_mm_mv", F.lit(gain)).alias("mm_mv"), source(F.col("hand_mm_s"), F.col("hint_mm_s"), "footer").alias("calib_source"),
        F.coalesce("hand_minutes", half_up(F.col("covered_ms") / 60_000, 1)).alias("minutes"), F.when(F.col("hand_minutes").isNotNull(), "manual").otherwise("pages").alias("minutes_source"),
    )


def promoted(sheets: DataFrame) -> DataFrame:
    """sheet_id, original and inherits: after removals, the first remaining sheet with a digest is the original of the rest, which inherit its result.
    sheets: case_id, sheet_id, digest (null: never a copy), removed."""
    left = sheets.filter(~F.col("removed"))
    first = left.filter("digest IS NOT NULL").groupBy("case_id", "digest").agg(F.min("sheet_id").alias("original"))
    p = left.join(first, ["case_id", "digest"], "left").select("case_id", "sheet_id", F.coalesce("original", "sheet_id").alias("original"))
    return p.withColumn("inherits", F.col("original") != F.col("sheet_id"))


def display_order(sheets: DataFrame) -> DataFrame:
    """sheet_id and place (from 0 in the case): analysed sheets in the case's order, each followed by its copies, then the rest as uploaded.
    sheets: case_id, sheet_id, upload, case_place (null if not analysed), original (null if not a copy)."""
    own = sheets.select("case_id", F.col("sheet_id").alias("original"), F.col("case_place").alias("_of"))
    s = sheets.join(own, ["case_id", "original"], "left").withColumn("_at", F.coalesce("case_place", "_of"))
    w = W.partitionBy("case_id").orderBy(F.col("_at").isNull(), "_at", F.col("case_place").isNull(), "upload")
    return s.select("case_id", "sheet_id", (F.row_number().over(w) - 1).cast("long").alias("place"))


def badges(sheets: DataFrame, issues: DataFrame) -> DataFrame:
    """sheet_id and badges in fixed order. sheets: case_id, sheet_id, place, copy; issues: case_id, code ("overlap:3" names the sheet at place 3)."""
    names = {"duplicate": "copy", "overlap": "repeated stretch", "pages_excluded": "other animal", "animal_unverified": "header unread"}
    i = issues.select("case_id", F.substring_index("code", ":", 1).alias("kind"), F.substring_index("code", ":", -1).cast("long").alias("place")).groupBy("case_id", "place").agg(F.collect_set("kind").alias("kinds"))
    j = sheets.join(i, ["case_id", "place"], "left")
    has = lambda k: F.coalesce(F.array_contains("kinds", k), F.lit(False))
    shown = [F.when((has(k) | F.col("copy")) if k == "duplicate" else has(k), v) for k, v in names.items()]
    return j.select("case_id", "sheet_id", F.array_compact(F.array(*shown)).alias("badges"))


def clock(seconds: Column) -> Column:
    total = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    return F.format_string("%02d:%02d", F.floor(total / 60).cast("long"), total % 60)


def groups_key(groups: DataFrame) -> DataFrame:
    """case_id and key: sheets of a group joined by commas, groups by bars, in order. groups: case_id, group_no, place, sheet_id."""
    g = groups.groupBy("case_id", "group_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "sheet_id"))), lambda x: x["sheet_id"].cast("string")), ",").alias("k"))
    return g.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_no", "k"))), lambda x: x["k"]), "|").alias("key"))


def precision_ceiling(measured: DataFrame) -> DataFrame:
    """case_id and ceiling: some amplitude is within two pixels, or a wave is too small to show. measured: case_id, key, value, confidence, reason, mv_per_px (the coarsest sheet's)."""
    m = measured.filter(F.col("key").isin("pAmplitude", "q", "r", "s", "t"))
    near = conclusion.available(F.col("value"), F.col("confidence")) & (F.abs("value") <= C.WAVE_PX * F.col("mv_per_px"))
    hit = (F.col("mv_per_px") > 0) & (F.coalesce(F.col("reason").endswith("_absent"), F.lit(False)) | near)
    return m.groupBy("case_id").agg(F.max(F.coalesce(hit, F.lit(False))).alias("ceiling"))


def case_confidence(pages: DataFrame) -> DataFrame:
    """case_id and confidence: the mean of the counted sheets, less a tenth if their order is unknown. pages: case_id, confidence, order_known."""
    c = pages.groupBy("case_id").agg(F.avg("confidence").alias("c"), F.min("order_known").alias("known"))
    return c.select("case_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c") * F.when(F.col("known"), 1.0).otherwise(0.9))).alias("confidence"))
