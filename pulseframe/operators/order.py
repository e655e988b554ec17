"""Sheets of a case: copies, animals by header, order in time, repeated stretches, and where each sheet lies on the case's time scale.

sheets: case_id, page, upload (place among the case's files), digest, date, width and crop (bytes of the header's crop; null if it was not found), and with_spans' columns.

Comparisons are joins and windows over a case's sheets; the only pairs made are of different crops of one case that can still be alike by their ink."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulseframe.functions.exprs import median_of
from pulseframe.functions.graph import components
from pulseframe.functions.shared import cut
from pulseframe.kernels.layout import ALIKE, NAME_INK, SHIFT, distance
from pulseframe.plans import constants as C

#: Seconds from which two sheets of one recording count as a repeated stretch.
OVERLAP_S = 1.0


def second_scale(labels: Column, px_per_second: Column, px_per_mm: Column, mm_per_s: Column) -> Column:
    """Pixels a second: the median slope between neighbouring time labels that rise in place and time, else the sheet's marks, else its grid. labels: array of x, seconds."""
    s = F.array_sort(labels)
    slope = lambda i: F.struct((F.get(s, i)["seconds"] - F.get(s, i - 1)["seconds"]).alias("ds"), (F.get(s, i)["x"] - F.get(s, i - 1)["x"]).alias("dx"))
    steps = F.when(F.size(s) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(s) - 1)), slope)).otherwise(F.array().cast("array<struct<ds:double,dx:double>>"))
    rising = F.transform(F.filter(steps, lambda p: (p["ds"] > 0) & (p["dx"] > 0)), lambda p: p["dx"] / p["ds"])
    return F.when(F.size(rising) > 0, median_of(rising)).when(px_per_second > 0, px_per_second).otherwise(px_per_mm * mm_per_s)


def with_spans(sheets: DataFrame) -> DataFrame:
    """Add duration_s, start_s and end_s (seconds of the recording; null without labels or scale). The start is the median of what each label says of the plot's left edge, so one misread
    digit moves nothing. sheets: labels (array of x, seconds), left_px, plot_px, px_per_second, px_per_mm, mm_per_s, n_samples (0 without signals)."""
    known = F.filter("labels", lambda x: x["x"].isNotNull() & x["seconds"].isNotNull() & ~F.isnan(x["x"]) & ~F.isnan(x["seconds"]))
    d = sheets.withColumn("_labels", F.transform(F.coalesce(known, F.array().cast("array<struct<x:double,seconds:double>>")), lambda x: F.struct(x["x"].cast("double").alias("x"), x["seconds"].cast("double").alias("seconds"))))
    d = d.withColumn("_scale", second_scale(F.col("_labels"), F.col("px_per_second"), F.col("px_per_mm"), F.col("mm_per_s")))
    d = d.withColumn("duration_s", F.when(F.col("n_samples") > 0, F.col("n_samples") / C.HZ).when(F.col("_scale") > 0, F.col("plot_px") / F.col("_scale")).otherwise(0.0))
    start = median_of(F.transform("_labels", lambda x: x["seconds"] - (x["x"] - F.col("left_px")) / F.col("_scale")))
    d = d.withColumn("start_s", F.when((F.size("_labels") > 0) & (F.col("_scale") > 0), start))
    return d.withColumn("end_s", F.col("start_s") + F.col("duration_s")).drop("_labels", "_scale")


def originals(sheets: DataFrame) -> DataFrame:
    """Add original: the case's first sheet with the same digest, itself without a digest."""
    first = sheets.filter("digest IS NOT NULL").groupBy("case_id", "digest").agg(F.min_by("page", "upload").alias("original"))
    return sheets.join(first, ["case_id", "digest"], "left").withColumn("original", F.coalesce("original", "page"))


def alike(sheets: DataFrame) -> DataFrame:
    """Links (a, b) between sheets of a case whose headers are alike and whose dates don't differ.

    Sheets with the same crop and date are one node. Crops that are alike share most of their ink, so only those in the same or the next class of ink are
    compared; pixel work is done for those pairs alone. A date matches itself or an unread one."""
    kind = ["case_id", "date", "width", "crop"]
    nodes = sheets.filter("crop IS NOT NULL AND width > 0").groupBy(*kind).agg(F.min("page").alias("node"))
    same = sheets.join(nodes.hint("merge"), (sheets["case_id"] == nodes["case_id"]) & sheets["date"].eqNullSafe(nodes["date"]) & (sheets["width"] == nodes["width"]) & (sheets["crop"] == nodes["crop"]))
    links = same.select(sheets["page"].alias("a"), F.col("node").alias("b"))

    def inked(batches):
        for b in batches:
            ink = [int((np.frombuffer(x, np.uint8) < NAME_INK).sum()) for x in b.column(4).to_pylist()]
            level = [0 if not n else 1 + math.floor(math.log(n, 1 / (1 - ALIKE))) for n in ink]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(level, pa.int32())], [*b.schema.names, "level"])

    n = nodes.select("case_id", "node", "date", "width", "crop").mapInArrow(inked, "case_id long, node long, date string, width int, crop binary, level int")
    left = n.select(*[F.col(c).alias(f"l_{c}") for c in n.columns])
    right = n.withColumn("near", F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1)))
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    on = (F.col("l_case_id") == F.col("r_case_id")) & (F.col("l_level") == F.col("r_near")) & (F.col("l_node") < F.col("r_node"))
    on &= F.col("l_date").isNull() | F.col("r_date").isNull() | (F.col("l_date") == F.col("r_date"))
    pairs = left.join(right, on).select("l_node", "r_node", "l_width", "l_crop", "r_width", "r_crop")

    def compared(batches):
        shape = lambda crop, width: np.frombuffer(crop, np.uint8)[: len(crop) // width * width].reshape(-1, width) < NAME_INK
        for b in batches:
            ok = [distance(shape(x, w), shape(y, v), SHIFT) < ALIKE for w, x, v, y in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return links.union(pairs.mapInArrow(compared, "a long, b long"))


def attached(sheets: DataFrame) -> DataFrame:
    """Links (a, b) of sheets whose header can't be compared: to the nearest comparable sheet uploaded before, else after; where the case has none that fits by date, to the first other such
    sheet of the same date and to the first without a date. sheets: originals only, with comparable."""
    before, after = (W.unboundedPreceding, -1), (1, W.unboundedFollowing)
    place = F.struct("upload", F.col("page").alias("to"))

    def near(keys: list[str], of: Column, rows: tuple[int, int]) -> Column:
        w = W.partitionBy(*keys).orderBy("upload", "page").rowsBetween(*rows)
        return (F.last if rows == before else F.first)(F.when(F.col("comparable") & of, place), ignorenulls=True).over(w)

    undated, any_ = F.col("date").isNull(), F.lit(True)
    d = sheets
    for name, rows in (("before", before), ("after", after)):
        d = d.withColumn(f"_{name}_date", near(["case_id", "date"], any_, rows)).withColumn(f"_{name}_none", near(["case_id"], undated, rows)).withColumn(f"_{name}_any", near(["case_id"], any_, rows))
    pick = F.coalesce(
        F.when(undated, F.col("_before_any")).otherwise(F.greatest("_before_date", "_before_none")),
        F.when(undated, F.col("_after_any")).otherwise(F.least("_after_date", "_after_none")),
    )["to"]
    d = d.filter(~F.col("comparable")).withColumn("_to", pick)

    d = d.withColumn("_rank_date", F.row_number().over(W.partitionBy("case_id", "date").orderBy("upload", "page"))).withColumn("_rank_none", F.when(undated, F.row_number().over(W.partitionBy("case_id", undated).orderBy("upload", "page"))))
    d = d.withColumn("_rank_all", F.row_number().over(W.partitionBy("case_id").orderBy("upload", "page")))
    firsts = lambda keys, rank: F.array(*[F.min(F.when(F.col(rank) == k, F.col("page"))).over(W.partitionBy(*keys)) for k in (1, 2)])
    others = F.array(
        F.get(F.filter(firsts(["case_id", "date"], "_rank_date"), lambda p: p != F.col("page")), 0),
        F.get(F.filter(firsts(["case_id"], "_rank_none"), lambda p: p != F.col("page")), 0),
        F.when(undated, F.get(F.filter(firsts(["case_id"], "_rank_all"), lambda p: p != F.col("page")), 0)),
    )
    d = d.withColumn("_others", others)
    to = F.when(F.col("_to").isNotNull(), F.array("_to")).otherwise(F.array_compact("_others"))
    return d.select(F.col("page").alias("a"), F.explode(to).alias("b"))


def grouped(sheets: DataFrame) -> DataFrame:
    """Originals with comparable, group (its smallest page), group_no and place: groups in order of their first upload, sheets by start where all of a group's starts are known, else by upload."""
    own = originals(sheets).filter("page = original").withColumn("comparable", F.coalesce(F.col("crop").isNotNull() & (F.col("width") > 0) & (F.length("crop") > 0), F.lit(False)))
    own = cut(own.drop("original"), "originals")
    c = components(alike(own.filter("comparable")).union(attached(own)).filter("a <> b"))
    g = own.join(c.withColumnRenamed("node", "page"), "page", "left").withColumn("group", F.coalesce("component", "page")).drop("component")
    whole = W.partitionBy("case_id", "group")
    g = g.withColumn("_first", F.min("upload").over(whole)).withColumn("ordered", F.min(F.col("start_s").isNotNull()).over(whole)).withColumn("group_size", F.count(F.lit(1)).over(whole))
    g = g.withColumn("group_no", (F.dense_rank().over(W.partitionBy("case_id").orderBy("_first", "group")) - 1).cast("int"))
    by = [F.when(F.col("ordered"), F.col("start_s")), "upload", "page"]
    return g.withColumn("place", (F.row_number().over(whole.orderBy(*by)) - 1).cast("int")).drop("_first")


def repeated(groups: DataFrame) -> DataFrame:
    """page and repeats: sheets that share OVERLAP_S or more with a counted sheet before them in their ordered group, and the first such sheet.

    Counted sheets lie in order of start, so one that shares most with a sheet is that with the latest end: a fold keeps it and decides who counts. A group is one recording's sheets."""
    item = F.struct("place", "page", "start_s", "end_s")
    kind = "array<struct<page:bigint,start_s:double,end_s:double>>"
    shared = lambda k, x: F.least(k["end_s"], x["end_s"]) - F.greatest(k["start_s"], x["start_s"])

    def step(acc: Column, x: Column) -> Column:
        counts = acc["last"].isNull() | (shared(acc["last"], x) < OVERLAP_S)
        me = F.struct(x["page"].alias("page"), x["start_s"].alias("start_s"), x["end_s"].alias("end_s"))
        last = F.when(acc["last"].isNull() | (counts & (x["end_s"] > acc["last"]["end_s"])), me).otherwise(acc["last"])
        return F.struct(last.alias("last"), F.when(counts, F.concat(acc["kept"], F.array(me))).otherwise(acc["kept"]).alias("kept"), F.when(counts, acc["out"]).otherwise(F.concat(acc["out"], F.array(me))).alias("out"))

    empty = F.array().cast(kind)
    start = F.struct(F.lit(None).cast("struct<page:bigint,start_s:double,end_s:double>").alias("last"), empty.alias("kept"), empty.alias("out"))
    g = groups.filter("ordered AND group_size > 1").groupBy("case_id", "group").agg(F.array_sort(F.collect_list(item)).alias("items"))
    g = g.withColumn("_r", F.aggregate("items", start, step)).select(F.explode("_r.out").alias("x"), F.col("_r.kept").alias("kept"))
    hit = F.filter("kept", lambda k: shared(k, F.col("x")) >= OVERLAP_S)
    return g.select(F.col("x.page").alias("page"), F.get(hit, 0)["page"].alias("repeats"))


def ordered(sheets: DataFrame) -> DataFrame:
    """A row for each sheet: case_id, page, original (itself, if it is no copy), group_no, place, repeats (the counted sheet whose stretch it repeats, or null), primary (its group has the most sheets, the first of such) and
    the case's issues: multiple_animals, order_unknown, then by page duplicate, overlap and animal_unverified. sheets need start_s and end_s."""
    g = cut(grouped(sheets), "groups")
    g = g.join(repeated(g), "page", "left")
    g = g.withColumn("primary", F.col("group_no") == F.max_by("group_no", F.struct("group_size", -F.col("group_no"))).over(W.partitionBy("case_id")))
    all_ = originals(sheets).select("case_id", "page", "upload", "original").join(
        g.select(F.col("page").alias("original"), "group_no", "place", "repeats", "primary", "ordered", "group_size", "comparable"), "original"
    )
    own = F.col("page") == F.col("original")
    listed = lambda test, code: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("upload", "page")))), lambda x: F.concat(F.lit(f"{code}:"), x["page"]))
    issues = all_.groupBy("case_id").agg(
        F.array_compact(F.array(F.when(F.max("group_no") > 0, "multiple_animals"), F.when(F.max((F.col("group_size") > 1) & ~F.col("ordered")), "order_unknown"))).alias("_head"),
        listed(~own, "duplicate").alias("_d"), listed(own & F.col("repeats").isNotNull(), "overlap").alias("_o"), listed(own & ~F.col("comparable"), "animal_unverified").alias("_u"),
    )
    issues = issues.select("case_id", F.concat("_head", "_d", "_o", "_u").alias("issues"))
    return all_.join(issues, "case_id").select("case_id", "page", "original", "group_no", "place", F.when(own, F.col("repeats")).alias("repeats"), "primary", "ordered", "issues")


def offsets(sheets: DataFrame, order: DataFrame, together: DataFrame) -> DataFrame:
    """The sheets that count, on the case's time scale: case_id, page, page_no (place in the case), offset_ms, duration_s and covered_ms (of the case: from first to last of each group).

    Within a group whose starts are known, sheets lie as recorded, gaps included; else end to end. Groups follow each other. Copies and repeated stretches don't count, nor do sheets of
    other than the largest group unless the case is in `together` (case_id)."""
    t = together.select("case_id", F.lit(True).alias("_all")).distinct()
    o = order.join(t, "case_id", "left").filter((F.col("page") == F.col("original")) & F.col("repeats").isNull() & (F.col("primary") | F.coalesce("_all", F.lit(False))))
    d = o.join(sheets.select("page", "start_s", "duration_s"), "page")
    group = W.partitionBy("case_id", "group_no")
    before = F.coalesce(F.sum("duration_s").over(group.orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    known = F.min(F.col("start_s").isNotNull()).over(group)
    d = d.withColumn("_at", F.when(known, F.col("start_s") - F.first("start_s").over(group.orderBy("place"))).otherwise(before))
    d = d.withColumn("_length", F.max(F.col("_at") + F.col("duration_s")).over(group))
    # a group's length counts once, with its first sheet
    first = F.row_number().over(group.orderBy("place")) == 1
    d = d.withColumn("_once", F.when(first, F.col("_length")).otherwise(0.0)).withColumn("_first", first)
    case = W.partitionBy("case_id").orderBy("group_no", "place")
    base = F.sum("_once").over(case) - F.col("_length")
    return d.select(
        "case_id", "page", (F.row_number().over(case) - 1).cast("int").alias("page_no"), ((base + F.col("_at")) * 1000).alias("offset_ms"), "duration_s", (F.sum("_once").over(W.partitionBy("case_id")) * 1000).alias("covered_ms"),
    )
