"""events and suppliers as leads of sheets: each row draws a beat, or a sheet of beats, whose times, sizes and shapes are its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulseframe.kernels import bridge, dsp, sheet
from pulseframe.plans import constants as C
from pulseframe.sources import tables as T

#: The cut-off (Hz) of what a device prints.
PRINT_HZ = 35.0
#: Sheets that are read at once.
SHEETS = 32
#: Events a page; milliseconds before the first and after the last beat of a page.
PAGE, LEAD_IN, LEAD_OUT = 8, 320.0, 420.0
#: mV of P, Q, R, S, T and their durations (ms): P, P to QRS, QRS, QRS to the end of T, T; by kind of beat.
BEATS = {"plain": (0.25, 0.2, 1.5, 0.4, 0.35, 40, 100, 56, 200, 100), "no_p": (0.0, 0.2, 1.5, 0.4, 0.35, 40, 100, 56, 200, 100), "wide": (0.0, 0.0, 1.3, 0.6, -0.5, 40, 100, 110, 280, 110)}
#: What of lead II each lead shows, for usual and for wide beats.
LEADS = {"I": (0.6, -0.7), "II": (1.0, 1.0), "III": (0.7, 1.0), "aVR": (-0.8, 0.5), "aVL": (0.3, -0.3), "aVF": (0.85, -0.6)}


def page_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as beats to draw: case_id (the user), page, page_no (PAGE events each), i, at_ms on the page, kind and size. The interval follows from the event's value, a
    purchase is wide and early, an error has no P wave."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = T.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", F.coalesce("value", F.lit(0.0)).alias("value"))
    e = e.withColumn("n", F.row_number().over(w) - 1).withColumn("page_no", F.floor(F.col("n") / PAGE).cast("int")).withColumn("i", (F.col("n") % PAGE).cast("int"))
    wide = (F.col("event_type") == "purchase") & (F.col("value") % 4 < 1)
    step = F.when(wide, 330.0).otherwise(480.0 + F.col("value") % 60)
    kind = F.when(wide, "wide").when((F.col("event_type") == "error") & (F.col("value") % 3 < 1), "no_p").otherwise("plain")
    page = W.partitionBy("user_id", "page_no").orderBy("i")
    at = F.when(F.col("i") == 0, LEAD_IN).otherwise(step)
    e = e.withColumn("at_ms", F.sum(at).over(page.rowsBetween(W.unboundedPreceding, 0)))
    return e.select(F.col("user_id").alias("case_id"), (F.col("user_id") * 100_000 + F.col("page_no")).alias("page"), "page_no", "i", "at_ms", kind.alias("kind"), (0.8 + F.col("value") % 5 / 10).alias("size"))


def sheet_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suppliers as sheets of PAGE beats, each with a rate and size of its own: columns as page_beats'."""
    t = T.table(spark, sf_dir, "supplier").select("s_suppkey", F.coalesce("s_acctbal", F.lit(0.0)).alias("a"))
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.lit(PAGE - 1))).alias("i"))
    step = 470.0 + F.floor(F.abs("a")) % 80
    return t.select(
        F.col("s_suppkey").alias("case_id"), F.col("s_suppkey").alias("page"), F.lit(0).alias("page_no"), "i", (LEAD_IN + F.col("i") * step).alias("at_ms"), F.when(F.col("s_suppkey") % 5 == 0, "no_p").otherwise("plain").alias("kind"),
        (0.8 + F.floor(F.abs("a")) % 7 / 10).alias("size"),
    )


def beat(t: np.ndarray, q_on: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Beats of a kind (one a row of t, at q_on) in a lead, upright and turned, where R is a deep S: half a sine for P and R, straight limbs of Q, S and the end of T."""
    p, q, r, s, top, p_ms, pq, qrs, qt, t_ms = BEATS[kind]
    since = t - q_on[:, None]

    def over(u: np.ndarray, last: float, f: Callable) -> np.ndarray:
        out, on = np.zeros_like(u), (u > 0) & (u < last)
        out[on] = f(u[on])
        return out

    hump = lambda u: over(u, 1.0, lambda v: np.sin(np.pi * v))
    u, v = since / qrs, (since - qt + t_ms) / t_ms
    first, main = hump((since + pq) / p_ms), hump((u - 0.2) / 0.6)
    end = over(v, 1.0, lambda v: np.where(v <= 0.6, (1 - np.cos(np.pi * np.minimum(v / 0.6, 1))) / 2, (1 - v) / 0.4))
    limbs = lambda q, s: over(u, 1.0, lambda v: np.interp(v, [0, 0.1, 0.2, 0.8, 0.9, 1], [0, -q, 0, 0, -s, 0]))
    return p * first + limbs(q, s) + r * main + top * end, p * first + limbs(0.0, r) + s * main - top * end


#: Columns of a lead.
LEAD = "case_id long, page long, page_no int, species string, lead string, position int, confidence double, mv array<double>, bad array<struct<i0:int,i1:int,kind:string>>"


#: What a lead shows of a usual beat, upright or turned (times the first), and of a wide one.
_USUAL, _WIDE = (np.array([[abs(v[i])] for v in LEADS.values()]) * (1 if i == 0 else np.sign([[v[i]] for v in LEADS.values()])) for i in (0, 1))
_TURNED = np.array([v[0] < 0 for v in LEADS.values()])


def _species(case: int) -> str:
    return "cat" if case % 3 == 2 else "dog"


def drawn(t: pa.Table) -> Iterator[list[list[dict]]]:
    """Pages of beats (page_beats' or sheet_beats', page by page and in their order) as the rows of their six leads (signals'), some pages of a species and of like length at a time."""
    g = {c: t[c].to_numpy() for c in ("case_id", "page", "page_no", "at_ms", "size")}
    kind = np.array(t["kind"].to_pylist(), object)
    begin = np.append(0, np.flatnonzero(g["page"][1:] != g["page"][:-1]) + 1)
    end = np.append(begin[1:], len(kind))
    n = ((g["at_ms"][end - 1] + LEAD_OUT) * C.HZ / 1000).astype(int)
    own = [c for c in t.schema.names if c not in (*g, "kind", "i")]
    facts = t.select(own).take(begin).to_pylist() if own else [{}] * len(begin)
    species = [f.get("species") or _species(int(c)) for f, c in zip(facts, g["case_id"][begin], strict=True)]
    for those in bridge.alike(range(len(begin)), lambda i: (species[i], int(n[i]))):
        curves = _drawn(g["at_ms"], g["size"], kind, begin[those], end[those], n[those], g["page"][begin[those]])
        yield [_leads(int(g["case_id"][begin[i]]), int(g["page"][begin[i]]), int(g["page_no"][begin[i]]), species[i], c[:, : n[i]], facts[i]) for i, c in zip(those, curves, strict=True)]


def _drawn(at_ms: np.ndarray, size: np.ndarray, kind: np.ndarray, begin: np.ndarray, end: np.ndarray, n: np.ndarray, page: np.ndarray) -> np.ndarray:
    """The six curves of some pages, each with its beats begin to end."""
    m, longest = len(LEADS), int(n.max())
    t = np.arange(longest) * 1000 / C.HZ
    curves = np.repeat(0.003 * np.sin(t * 1.7 + (page % 17)[:, None]), m, 0).reshape(len(page), m, longest)
    of = np.repeat(np.arange(len(page)), end - begin)
    beats = np.concatenate([np.arange(a, b) for a, b in zip(begin, end, strict=True)])
    at = at_ms[beats]
    first, last = np.searchsorted(t, at - 150), np.minimum(np.searchsorted(t, at + 300), n[of])
    k = first[:, None] + np.arange(max(1, int((last - first).max())))
    shapes = np.zeros((2, *k.shape))
    for name in BEATS:
        i = np.flatnonzero(kind[beats] == name)
        if len(i):
            shapes[:, i] = size[beats[i], None] * np.array(beat(k[i] * 1000 / C.HZ, at[i], name))
    for i, (p, a, b, wide) in enumerate(zip(of.tolist(), first.tolist(), last.tolist(), (kind[beats] == "wide").tolist(), strict=True)):
        up, turned = shapes[:, i, : b - a]  # a beat is drawn where it lies
        part = (_WIDE if wide else _USUAL) * up
        if not wide:
            part[_TURNED] = _USUAL[_TURNED] * turned
        curves[p, :, a:b] += part
    return dsp.zero_phase(curves.reshape(-1, longest), dsp.butterworth(PRINT_HZ, C.HZ, 2, False), np.repeat(n, m)).astype(float).reshape(len(page), m, longest)


def _leads(case: int, page: int, page_no: int, species: str, curves: np.ndarray, facts: dict) -> list[dict]:
    """One page's curves as rows of its leads."""
    clipped = [{"i0": curves.shape[1] // 2, "i1": curves.shape[1] // 2 + 30, "kind": "clipped"}]
    return [
        facts | {"case_id": case, "page": page, "page_no": page_no, "species": species, "lead": lead, "position": k, "confidence": 0.3 if lead == "II" and page % 29 == 5 else 0.95, "mv": mv, "bad": clipped if lead == "II" and page % 13 == 4 else []}
        for k, (lead, mv) in enumerate(zip(LEADS, curves, strict=True))
    ]


_LEAD = pa.schema([("case_id", pa.int64()), ("page", pa.int64()), ("page_no", pa.int32()), ("species", pa.string()), ("lead", pa.string()), ("position", pa.int32()), ("confidence", pa.float64()), ("mv", pa.list_(pa.float64())), ("bad", pa.list_(pa.struct([("i0", pa.int32()), ("i1", pa.int32()), ("kind", pa.string())])))])


def leads_of(group: pa.Table) -> pa.Table:
    """One page's beats (page_beats' or sheet_beats') as its six leads, signals' rows."""
    (rows,) = next(drawn(group.sort_by("i")))
    return pa.Table.from_pylist(rows, _LEAD)


def signals(beats: DataFrame) -> DataFrame:
    """Six leads a page of beats (page_beats' or sheet_beats'): case_id, page, page_no, species, lead, position, confidence, mv, bad. Every 29th page has lead II unreliable, every 13th a
    clipped stretch in it; every third case is a cat. A page has PAGE beats at most and is drawn where they lie."""
    return bridge.each_page(beats, [leads_of], LEAD)


def pages(beats: DataFrame, facts: DataFrame) -> DataFrame:
    """bridge.read_pages of the leads of beats (page_beats'), read where they are drawn. facts: what reading needs of a page (analysis.facts); a page without them is left out."""
    return bridge.each_batch(beats.join(facts, "page"), "i", lambda t: map(bridge.pages_table, drawn(t)), bridge.PAGE)


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands on the pages of page_beats besides the curves: case_id, page, upload, digest, date, width, crop, labels, rates, left_px, plot_px, px_per_second, px_per_mm, mm_per_s, mv_per_px,
    ms_per_px, confidence, n_samples. Pages are uploaded latest first; labels say when a page was recorded, with a gap of half a second between pages; a few have none. The header's crop
    is the case's, unreadable on every 23rd page; every 31st page is there twice."""
    px, left = 4.305, 60.0
    b = page_beats(spark, sf_dir)
    p = b.groupBy("case_id", "page", "page_no").agg(F.max("at_ms").alias("last"), F.array_sort(F.collect_list("at_ms")).alias("at"))
    p = p.withColumn("n_samples", F.floor((F.col("last") + LEAD_OUT) * C.HZ / 1000)).withColumn("s", F.col("n_samples") / C.HZ)
    w = W.partitionBy("case_id").orderBy("page_no").rowsBetween(W.unboundedPreceding, -1)
    p = p.withColumn("begin", F.coalesce(F.sum(F.col("s") + 0.5).over(w), F.lit(0.0)))
    scale = px * 50.0
    labels = F.when(F.col("page") % 37 != 7, F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.struct((left + k * scale).alias("x"), (F.col("begin") + k).alias("seconds"))))
    beat_no = F.sequence(F.lit(1), F.size("at") - 1)
    rate = lambda i: F.struct((left + (F.get("at", i - 1) + F.get("at", i) + 56) / 2 * scale / 1000).alias("x"), F.round(60_000 / (F.get("at", i) - F.get("at", i - 1)) + F.when(F.col("page") % 19 == 3, 40).otherwise(0), 0).alias("value"))
    rates = F.when((F.col("page") % 4 == 1) & (F.size("at") > 1), F.transform(beat_no, rate))
    crop = F.when(F.col("page") % 23 != 6, F.concat(*[F.unhex(F.md5(F.concat_ws(":", F.col("case_id").cast("string"), F.lit(str(k))).cast("binary"))) for k in range(12)]))
    p = p.select(
        "case_id", "page", (1000 - F.col("page_no")).alias("upload"), F.md5(F.col("page").cast("string").cast("binary")).alias("digest"), F.concat(F.lit("day-"), F.col("case_id").cast("string")).alias("date"), F.lit(24).alias("width"), crop.alias("crop"),
        labels.alias("labels"), rates.alias("rates"), F.lit(left).alias("left_px"), (F.col("s") * scale).alias("plot_px"), F.lit(None).cast("double").alias("px_per_second"), F.lit(px).alias("px_per_mm"), F.lit(50.0).alias("mm_per_s"),
        F.lit(1 / (px * 10)).alias("mv_per_px"), F.lit(1000 / scale).alias("ms_per_px"), (0.7 + F.col("page") % 4 / 10).alias("confidence"), "n_samples",
    )
    copies = p.filter("page % 31 = 9").withColumn("page", -F.col("page") - 1).withColumn("upload", F.col("upload") + 10_000)
    return p.unionByName(copies)


def draw(signals: dict[str, np.ndarray], variant: str = "A", grid: bool = True, marks: bool = False) -> np.ndarray:
    """Signals as a sheet's image: frame, millimetre grid, six polylines; with marks, bolder lines every five millimetres, and plus marks on every tenth of them in every other row."""
    height, (x0, y0, x1, y1), px, first, step = sheet.VARIANTS[variant]
    img = np.full((height, sheet.WIDTH), 255, np.uint8)
    if grid:
        for k in range(int((x1 - x0) / px) + 1):
            img[y0 : y1 + 1, int(round(x0 + k * px))] = 210
        for k in range(int((y1 - y0) / px) + 1):
            img[int(round(y0 + k * px)), x0 : x1 + 1] = 210
    if marks:
        across, down = (np.round(o + np.arange(int((e - o) / px / 5) + 1) * 5 * px).astype(int) for o, e in ((x0, x1), (y0, y1)))
        img[y0 : y1 + 1, across] = img[down, x0 : x1 + 1] = 185
        for x in across[3::10]:
            for y in down[2:-1:2]:
                img[y, x - 2 : x + 3] = img[y - 2 : y + 3, x] = 60
    for i, lead in enumerate(sheet.LEADS):
        base = y0 + (first + step * i) * px
        x = x0 + 3 + np.arange(len(signals[lead])) / sheet.HZ * sheet.MM_S * px
        fine = np.arange(x0 + 3, min(x1 - 3, x[-1]), 0.2)
        y = base - np.interp(fine, x, signals[lead]) * sheet.MM_MV * px
        yy, xx = np.round(y).astype(int), np.round(fine).astype(int)
        ok = (yy > y0 + 2) & (yy < y1 - 2)
        top, bottom = np.minimum(yy[:-1], yy[1:]), np.minimum(np.maximum(yy[:-1], yy[1:]), height - 1)
        top, bottom, at = (v[ok[:-1] & (top >= 0)] for v in (top, bottom, xx[:-1]))
        tall = bottom - top + 1
        down = np.arange(tall.sum()) - np.repeat(np.cumsum(tall) - tall, tall)
        img[np.repeat(top, tall) + down, np.repeat(at, tall)] = 40
    img[y0 - 1 : y0 + 1, x0 - 1 : x1 + 2] = img[y1 : y1 + 2, x0 - 1 : x1 + 2] = 0
    img[y0 - 1 : y1 + 2, x0 - 1 : x0 + 1] = img[y0 - 1 : y1 + 2, x1 : x1 + 2] = 0
    return img


def image(leads: list[dict]) -> np.ndarray:
    """One page's leads as its image; every other one in variant B, every third one with plus marks."""
    page = leads[0]["page"]
    return draw({r["lead"]: r["mv"] for r in leads}, "AB"[page % 2], marks=page % 3 == 0)


def image_of(group: pa.Table) -> pa.Table:
    """One page's leads as its image's row: page, species, width, height, gray."""
    leads = bridge.leads_rows(group)
    img = image(leads)
    return pa.table({"page": [leads[0]["page"]], "species": group["species"][:1], "width": pa.array([img.shape[1]], pa.int32()), "height": pa.array([img.shape[0]], pa.int32()), "gray": pa.array([img.tobytes()], pa.binary())})


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheets of sheet_beats as images (image_of's rows)."""
    return bridge.each_page(sheet_beats(spark, sf_dir), [leads_of, image_of], "page long, species string, width int, height int, gray binary")


def beats_on_pages(spark: SparkSession, sf_dir: str, marks: bool = True) -> DataFrame:
    """bridge.page_beats of the leads of page_beats, drawn where they are read; without marks those columns are null, and the work for them is not done."""
    return bridge.each_batch(page_beats(spark, sf_dir), "i", lambda t: (bridge.beats_table(pages, marks=marks) for pages in drawn(t)), bridge.BEAT)


def _read(t: pa.Table) -> Iterator[list[list[dict]]]:
    """Sheets of beats drawn and read back, some at a time: the rows of their leads (bridge.sheets_of)."""
    every = sorted((leads for pages in drawn(t) for leads in pages), key=lambda leads: leads[0]["page"] % 2)  # sheets of a variant are as wide
    for k in range(0, len(every), SHEETS):
        pages = every[k : k + SHEETS]
        pictures = [image(leads) for leads in pages]
        yield bridge.sheets_of([leads[0]["page"] for leads in pages], [x.shape[1] for x in pictures], [x.shape[0] for x in pictures], pictures, [{"species": leads[0]["species"]} for leads in pages])


def signals_on_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bridge.read_sheets of images, each read where it is drawn."""
    return bridge.each_batch(sheet_beats(spark, sf_dir), "i", lambda t: (bridge.signals_table(pages, ["species"]) for pages in _read(t)), bridge.SIGNAL + ", species string")


def beats_on_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bridge.page_beats of signals_on_sheets, found where they are read."""
    return bridge.each_batch(sheet_beats(spark, sf_dir), "i", lambda t: map(bridge.beats_table, _read(t)), bridge.BEAT)
