"""Sheets of a case: copies, animals, order, offsets; edits; report lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulseframe.functions.exprs import fill, plural
from pulseframe.functions.graph import components
from pulseframe.operators.rhythm import by_page


def canonical(sheets: DataFrame) -> DataFrame:
    """sheet_id, original: the first sheet with the same digest (itself, if null) and whether this one is a copy. The first is an aggregate joined
    back, so a digest that many sheets share is no single task's work."""
    first = sheets.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("sheet_id").alias("original"))
    j = sheets.join(first, "digest", "left").select("sheet_id", F.coalesce("original", "sheet_id").alias("original"))
    return j.withColumn("copy", F.col("sheet_id") != F.col("original"))


def largest_group(sheets: DataFrame) -> DataFrame:
    """Groups of sheets by size: group, n, first, and primary for the largest (the first seen on ties). Groups are compared by an aggregate, not a global sort."""
    g = sheets.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("sheet_id").alias("first"))
    top = g.agg(F.max(F.struct("n", -F.col("first"))).alias("top"))  # one row
    return g.crossJoin(F.broadcast(top)).select("group", "n", "first", ((F.col("n") == F.col("top.n")) & (F.col("first") == -F.col("top")["col2"])).alias("primary"))


def offsets(pages: DataFrame) -> DataFrame:
    """Where each page's recording begins in its group, pages end to end: group, page_no, offset_s, end_s."""
    w = W.partitionBy("group").orderBy("page_no").rowsBetween(W.unboundedPreceding, -1)
    return pages.withColumn("offset_s", F.coalesce(F.sum("duration_s").over(w), F.lit(0.0))).withColumn("end_s", F.col("offset_s") + F.col("duration_s"))


def last_wins(edits: DataFrame, key: list[str]) -> DataFrame:
    """For each key the edit with the greatest seq, and how many there were."""
    return edits.groupBy(*key).agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"), F.count(F.lit(1)).alias("n_edits"))


def relabelled(slots: DataFrame, edits: DataFrame) -> DataFrame:
    """slot, trace, conflict: traces move to the label of their last edit, or keep their own; of several for one slot the latest edit wins, of equal
    ones the last listed; a slot that none takes is empty. slots: key, slot, position; edits: key, slot, target, seq."""
    last = edits.groupBy("key", "slot").agg(F.max_by("target", "seq").alias("target"), F.max("seq").alias("rank"))
    t = slots.join(last, ["key", "slot"], "left").select("key", F.col("slot").alias("trace"), F.coalesce("target", "slot").alias("slot"), F.coalesce("rank", F.lit(-1)).alias("rank"), "position")
    best = t.groupBy("key", "slot").agg(F.max_by("trace", F.struct("rank", "position")).alias("trace"), (F.count(F.lit(1)) > 1).alias("conflict"))
    return slots.select("key", "slot").join(best, ["key", "slot"], "left").select("key", "slot", "trace", F.coalesce("conflict", F.lit(False)).alias("conflict"))


def report_lines(cases: DataFrame) -> DataFrame:
    """cases (case_id, n_beats, rate, verdict) as numbered lines of text."""
    head = F.struct(F.lit(1).alias("no"), fill(F.lit("Case {id}: {n} {word}."), {"id": F.col("case_id"), "n": F.col("n_beats"), "word": plural(F.col("n_beats"), "interval", "intervals", "intervals")}).alias("text"))
    rate = F.struct(F.lit(2).alias("no"), fill(F.lit("Mean value {rate}, {verdict}."), {"rate": F.format_number("rate", 1), "verdict": F.col("verdict")}).alias("text"))
    return cases.select("case_id", F.explode(F.array(head, rate)).alias("line")).select("case_id", F.col("line.no").alias("line_no"), F.col("line.text").alias("text"))


def vote(votes: DataFrame) -> DataFrame:
    """sheet, variant, confidence, ambiguous: the variant with the greatest weight (the first by name on ties), its share, and whether others tie."""
    s = votes.groupBy("sheet").agg(F.sum("w").alias("total"), F.max("w").alias("top"))
    t = votes.join(s, "sheet").filter("w = top").groupBy("sheet").agg(F.min("variant").alias("variant"), F.max(F.col("top") / F.col("total")).alias("confidence"), (F.count(F.lit(1)) > 1).alias("ambiguous"))
    return t


def marked(auto: DataFrame, edits: DataFrame) -> DataFrame:
    """Automatic marks (key, position, mark, confidence) overlaid by the last edit of each (key, position, value, seq), which is certain."""
    last = edits.groupBy("key", "position").agg(F.max_by("value", "seq").alias("value"))
    j = auto.join(last, ["key", "position"], "left")
    return j.select("key", "position", F.coalesce("value", "mark").alias("mark"), F.when(F.col("value").isNull(), F.col("confidence")).otherwise(1.0).alias("confidence"))


def animals(sheets: DataFrame, keys: list[str]) -> DataFrame:
    """sheet_id, animal: sheets that agree in one of the keys are of one animal, and so on; an animal goes by its first sheet. A key's sheets are
    linked to its first, so a shared key costs a row a sheet; null keys link nothing."""
    links = None
    for k in keys:
        first = sheets.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min("sheet_id").alias("_first"))
        e = sheets.join(first, k).select(F.col("sheet_id").alias("a"), F.col("_first").alias("b"))
        links = e if links is None else links.union(e)
    c = components(links).select(F.col("node").alias("sheet_id"), "component")
    return sheets.select("sheet_id").join(c, "sheet_id", "left").select("sheet_id", F.coalesce("component", "sheet_id").alias("animal"))


def stale(beats: DataFrame) -> DataFrame:
    """Beats whose moved mark (mark_ms) no longer lies strictly between the neighbouring beats of the page."""
    b = beats.withColumn("_before", F.lag("t_ms").over(by_page())).withColumn("_after", F.lead("t_ms").over(by_page()))
    return b.filter(F.coalesce(F.col("mark_ms") <= F.col("_before"), F.lit(False)) | F.coalesce(F.col("mark_ms") >= F.col("_after"), F.lit(False))).drop("_before", "_after")
