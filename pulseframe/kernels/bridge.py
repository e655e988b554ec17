"""Kernels as DataFrame operators: one page (its leads) a call, errors as issues."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.kernels import delineate as D
from pulseframe.kernels import detect as K
from pulseframe.kernels import dsp, printed
from pulseframe.plans import constants as C

cloudpickle.register_pickle_by_value(sys.modules["pulseframe"])

#: Columns of page_beats: times in ms on the page; lead_ms by lead; of lead II t_ii_ms and all marks; bad: lead II's stretches after its filter.
_MS = ("p_on", "p_off", "q_on", "r_peak", "s_peak", "s_off", "t_peak", "t_off")
BEAT = "page long, beat_index int, t_ms double, confidence double, n_leads int, lead_ms map<string,double>, t_ii_ms double, " + ", ".join(f"{c} double" for c in _MS) + ", p_found boolean, d_confidence double, reasons array<string>, d_reasons array<string>, issue string"
_BEAT = pa.schema([
    ("page", pa.int64()), ("beat_index", pa.int32()), ("t_ms", pa.float64()), ("confidence", pa.float64()), ("n_leads", pa.int32()), ("lead_ms", pa.map_(pa.string(), pa.float64())), ("t_ii_ms", pa.float64()),
    *((c, pa.float64()) for c in _MS), ("p_found", pa.bool_()), ("d_confidence", pa.float64()), ("reasons", pa.list_(pa.string())), ("d_reasons", pa.list_(pa.string())), ("issue", pa.string()),
])


def filtered(signals: DataFrame, species: str, hz: float = 500.0) -> DataFrame:
    """page, lead, mv filtered without phase shift; a stage that can't be built at this sampling rate is left out (dsp.skipped names it)."""

    def run(batches):
        for b in batches:
            out = [dsp.clean(np.array(x), species, hz)[0].tolist() if x else x for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.float32()))], ["page", "lead", "mv"])

    return signals.select("page", "lead", "mv").mapInArrow(run, "page long, lead string, mv array<float>")


def _spans(bad: list[dict] | None) -> list[tuple[int, int, str]]:
    return [(u["i0"], u["i1"], u["kind"]) for u in bad or []]


#: Pages that are drawn, filtered and searched at once, those of a species and of like length together.
TOGETHER = 16


def _length(leads: list[dict]) -> int:
    return max((len(r["mv"]) for r in leads), default=0)


def alike(pages: list, key: Callable) -> Iterator[list[int]]:
    """Numbers of pages that go together, by their species and length (key)."""
    keys = [key(p) for p in pages]
    order = sorted(range(len(pages)), key=keys.__getitem__)
    for _, same in groupby(order, lambda i: keys[i][0]):
        those = list(same)
        yield from (those[k : k + TOGETHER] for k in range(0, len(those), TOGETHER))


def _beats_together(pages: list[list[dict]], hz: float, marks: bool) -> list[list[dict]]:
    """pages: rows of the leads of each, all of one species. Beats over all leads, checked against the printed rates; marks in lead II, filtered. Without lead II's signal beats have no marks."""
    species = pages[0][0]["species"]
    trust = [{r["lead"]: 1.0 if r["confidence"] is None else r["confidence"] for r in leads} for leads in pages]
    spans = [{r["lead"]: _spans(r.get("bad")) for r in leads} for leads in pages]
    x = [{r["lead"]: np.asarray(r["mv"], float) for r in leads if len(r["mv"])} for leads in pages]
    found = K.detect_pages([K.Page(*p) for p in zip(x, trust, spans, strict=True)], species, hz)
    for leads, beats in zip(pages, found, strict=True):
        if rates := [(r["x"], r["value"]) for r in leads[0].get("rates") or []]:
            printed.check(beats, rates, leads[0]["left_px"] or 0.0, leads[0]["px_per_ms"] or 0.0)
    out = []
    for i, (leads, beats) in enumerate(zip(pages, found, strict=True)):
        sure = trust[i].get("II", 0.0) >= C.RELIABLE and "II" in x[i]
        own = [b.leads.get("II") if sure and "lead_ii_unreliable" not in b.reasons else None for b in beats]
        out.append([{"page": leads[0]["page"], "beat_index": k, "t_ms": b.t_ms, "confidence": min(1.0, max(0.0, b.confidence)), "n_leads": len(b.leads), "lead_ms": list(b.leads.items()), "t_ii_ms": t, "reasons": b.reasons, "issue": None} for k, (b, t) in enumerate(zip(beats, own, strict=True))])
    if marks:
        _add_marks(pages, x, spans, found, species, hz, out)
    return out


def _add_marks(pages: list[list[dict]], x: list[dict], spans: list[dict], found: list[list[K.Beat]], species: str, hz: float, out: list[list[dict]]) -> None:
    rows = [x[i]["II"] if "II" in x[i] and beats else np.zeros(0) for i, beats in enumerate(found)]
    lengths = np.array([len(v) for v in rows], int)
    clean = dsp.clean(K.stacked(rows, lengths), species, hz, lengths)
    ii = D.Leads([v[:n] for v, n in zip(clean, lengths.tolist(), strict=True)])
    bad = [dsp.widened(s["II"], n, species, hz) if n else [] for s, n in zip(spans, lengths.tolist(), strict=True)]
    at = [[b.t_ms for b in beats] for beats in found]
    row, where, before, after = [], [], [], []
    for i, (beats, t) in enumerate(zip(found, at, strict=True)):
        row += [i] * len(t)
        where += [b.leads.get("II", b.t_ms) for b in beats]
        before += [None, *t[:-1]] if t else []
        after += [*t[1:], None] if t else []
    marks = D.delineate_all(ii, row, where, species, hz, [leads[0].get("mv_per_px") for leads in pages], before, after, bad)
    for r, m in zip([r for beats in out for r in beats], marks, strict=True):
        r["d_confidence"], r["d_reasons"] = m.pop("confidence"), m.pop("reasons")
        r.update(m)


def _beats_of_pages(pages: list[list[dict]], hz: float, marks: bool = True) -> list[list[dict] | str]:
    """The beats of each page (rows of its leads), or the issue of one that fails: where pages that go together fail, each is tried alone."""
    out: list = [None] * len(pages)
    for those in alike(pages, lambda leads: (str(leads[0]["species"]), _length(leads))):
        try:
            found = _beats_together([pages[i] for i in those], hz, marks)
        except Exception as e:  # one bad page must not stop a case
            found = [_failed(e)] if len(those) == 1 else [_beats_of_pages([pages[i]], hz, marks)[0] for i in those]
        for i, beats in zip(those, found, strict=True):
            out[i] = beats
    return out


def leads_rows(group: pa.Table) -> list[dict]:
    """The rows of a page's leads, with their samples as an array each."""
    mv = group["mv"].combine_chunks()
    samples, at = mv.values.to_numpy(zero_copy_only=False), mv.offsets.to_numpy()
    leads = group.drop_columns(["mv"]).to_pylist()
    for i, (r, known) in enumerate(zip(leads, mv.is_valid().to_pylist(), strict=True)):
        r["mv"] = samples[at[i] : at[i + 1]] if known else samples[:0]
    return leads


def beats_of(group: pa.Table, hz: float = C.HZ) -> pa.Table:
    """One page's leads (page_beats' columns, or signals_of's) to its beats. A page that fails here, or whose sheet could not be read, is one row with an issue."""
    return beats_table([leads_rows(group)], hz)


def beats_table(pages: list[list[dict]], hz: float = C.HZ, marks: bool = True) -> pa.Table:
    """page_beats' rows of pages, each given as the rows of its leads; without marks those columns are null."""
    rows, unread = [], [_unread(leads) for leads in pages]
    found = iter(_beats_of_pages([leads for leads, why in zip(pages, unread, strict=True) if why is None], hz, marks))
    for leads, why in zip(pages, unread, strict=True):
        beats = why or next(found)
        rows += [{"page": leads[0]["page"], "issue": beats}] if isinstance(beats, str) else beats
    return _table(rows, _BEAT)


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    """Rows as a table; a column that none has is null."""
    known = set().union(*rows)
    return pa.Table.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) if f.name in known else pa.nulls(len(rows), f.type) for f in schema], schema=schema)


def _unread(leads: list[dict]) -> str | None:
    """Why a sheet has no lead at all, as sheets_of writes it."""
    return ",".join(leads[0].get("issues") or ["no_leads"]) if all(r["lead"] is None for r in leads) else None


def _failed(e: Exception) -> str:
    """A page's failure as its issue; what says nothing about the page (memory) is raised, so that the task fails and runs again."""
    if isinstance(e, MemoryError):
        raise e
    return f"exception:beats:{type(e).__name__}:{e}"


#: The leads whose QRS areas give the axis.
AREA_LEADS = {"i": "I", "f": "aVF"}
_SPAN = pa.struct([("i0", pa.int32()), ("i1", pa.int32()), ("kind", pa.string())])
_AREA = {f"area_{k}_{how}": pa.float64() for k in AREA_LEADS for how in ("marked", "around")}
_PAGE = pa.schema([
    ("page", pa.int64()), ("n_samples", pa.int32()), ("n_leads", pa.int32()), ("n_reliable", pa.int32()), ("ii_confidence", pa.float64()), ("leads_reliable", pa.bool_()), ("ii_mv", pa.list_(pa.float64())), ("ii_bad", pa.list_(_SPAN)), ("issue", pa.string()),
    ("beats", pa.list_(pa.struct([f for f in _BEAT if f.name not in ("page", "issue")] + [pa.field(k, v) for k, v in _AREA.items()] + [pa.field("wide", pa.list_(pa.float64()))]))),
])
#: Columns of read_pages.
PAGE = "page long, n_samples int, n_leads int, n_reliable int, ii_confidence double, leads_reliable boolean, ii_mv array<double>, ii_bad array<struct<i0:int,i1:int,kind:string>>, issue string, beats array<struct<" + ", ".join(
    c.strip().replace(" ", ": ", 1) for c in [*BEAT.removeprefix("page long, ").removesuffix(", issue string").replace("map<string,double>", "map<string;double>").split(","), *(f"{k} double" for k in _AREA), "wide array<double>"]
).replace(";", ",") + ">>"


def place(ms: float) -> int:
    """The sample nearest to a time."""
    return math.floor(ms * C.HZ / 1000 + 0.5)


def areas(x: np.ndarray, n: np.ndarray, bad: list[list[dict]], row: np.ndarray, a: np.ndarray, b: np.ndarray, onset: np.ndarray) -> np.ndarray:
    """The net area (mV ms) of samples a to b of rows of x (n samples each), as far as there are any, over the PQ level before a (onset) or the median around them. NaN without samples or beside one of the
    row's unreliable stretches (bad)."""
    a, b = np.maximum(0, a), np.minimum(n[row] - 1, b)
    ok = b > a
    for i in np.flatnonzero(np.array([bool(u) for u in bad])[row]).tolist():
        ok[i] &= not any(u["kind"] != "ambiguous" and u["i0"] <= b[i] and u["i1"] >= a[i] for u in bad[row[i]])
    out = np.full(len(row), np.nan)
    row, a, b, onset = row[ok], a[ok], b[ok], onset[ok]
    if not len(row):
        return out
    base = np.empty(len(row))
    i = np.flatnonzero(onset)
    level = dsp.medians(x, row[i], a[i] - place(C.PQ_FROM), a[i] - place(C.PQ_TO), n[row[i]])
    base[i] = np.where(np.isnan(level), x[row[i], a[i]], level)
    i = np.flatnonzero(~onset)
    reach = 2 * (b - a)[i]
    base[i] = dsp.medians(x, row[i], a[i] - reach, b[i] + reach, n[row[i]])
    size = b - a
    window = x.ravel()[(row * x.shape[1])[:, None] + np.minimum(a[:, None] + np.arange(int(size.max()) + 1), (n[row] - 1)[:, None])]
    out[ok] = (np.cumsum(window, 1)[np.arange(len(row)), size] - (size + 1) * base) * (1000 / C.HZ)
    return out


def _sure_wide(species: str) -> float:
    return C.THRESHOLDS["cat" if species == "cat" else "dog"]["sure_wide_s"] * 1000


def _sure(leads: list[dict]) -> list[bool]:
    return [(1.0 if r["confidence"] is None else r["confidence"]) >= C.RELIABLE and len(r["mv"]) > 0 for r in leads]


def _add_areas(pages: list[list[dict]], found: list[list[dict] | str]) -> None:
    """The areas of every beat in the reliable ones of AREA_LEADS, of all pages at once."""
    rows, bad, wanted = [], [], []
    for leads, beats in zip(pages, found, strict=True):
        if isinstance(beats, str) or not beats:
            continue
        sure, wide = _sure(leads), _sure_wide(leads[0]["species"])
        for key, lead in AREA_LEADS.items():
            i = next((i for i, r in enumerate(leads) if r["lead"] == lead), None)
            if i is None or not sure[i]:
                continue
            for b in beats:
                if b["q_on"] is not None and b["s_off"] is not None:
                    wanted.append((b, f"area_{key}_marked", len(rows), place(b["q_on"]), place(b["s_off"]), True))
                centre = place(dict(b["lead_ms"]).get(lead, b["t_ms"]))
                wanted.append((b, f"area_{key}_around", len(rows), centre - place(wide), centre + place(wide), False))
            rows.append(np.asarray(leads[i]["mv"], float))
            bad.append(leads[i].get("bad") or [])
    if not wanted:
        return
    n = np.array([len(v) for v in rows], int)
    row, a, b, onset = (np.array(v) for v in list(zip(*wanted, strict=True))[2:])
    for (beat, key, *_), v in zip(wanted, areas(K.stacked(rows, n), n, bad, row, a, b, onset).tolist(), strict=True):
        if v == v:
            beat[key] = v


def page_of(group: pa.Table) -> pa.Table:
    """One page's leads (page_beats' columns and position) as read_pages' row."""
    return pages_table([leads_rows(group)])


def pages_table(pages: list[list[dict]]) -> pa.Table:
    """read_pages' rows of pages, each given as the rows of its leads."""
    found = _beats_of_pages(pages, C.HZ)
    _add_areas(pages, found)
    rows = [_page(leads, beats) for leads, beats in zip(pages, found, strict=True)]
    return _table(rows, _PAGE)


def _page(leads: list[dict], beats: list[dict] | str) -> dict:
    trust = [1.0 if r["confidence"] is None else r["confidence"] for r in leads]
    first: dict[str, int] = {}
    for i, r in enumerate(leads):
        first.setdefault(r["lead"], i)
    sure = _sure(leads)
    ok = [i for i, r in enumerate(leads) if len(r["mv"]) and trust[i] > 0]
    ref = max(ok, key=lambda i: (leads[i]["lead"] == "II" and sure[i], trust[i], -math.inf if leads[i]["position"] is None else -leads[i]["position"]), default=None)
    ii = first.get("II")
    row = {
        "page": leads[0]["page"], "n_samples": max(len(r["mv"]) for r in leads), "n_leads": len(leads), "n_reliable": sum(sure), "ii_confidence": trust[ii] if ii is not None and len(leads[ii]["mv"]) else 0.0,
        "leads_reliable": all(x in first and sure[first[x]] for x in AREA_LEADS.values()), "ii_bad": [u for u in leads[ii].get("bad") or [] if u["kind"] != "ambiguous"] if ii is not None else [], "issue": None,
    }
    if isinstance(beats, str):
        beats, row["issue"] = [], beats
    sure_ms = _sure_wide(leads[0]["species"])
    # a template's window is half a median of QRS widths or half a surely wide QRS, so no wider than the greatest of them
    half = max(1, place(max([sure_ms, *(b["s_off"] - b["q_on"] for b in beats if b["q_on"] is not None and b["s_off"] is not None)]) / 2))
    if ref is not None:
        mv, own = np.asarray(leads[ref]["mv"], float), [(b, t) for b in beats if (t := dict(b["lead_ms"]).get(leads[ref]["lead"])) is not None]
        where = np.array([place(t) for _, t in own], int)[:, None] + np.arange(-half, half + 1)
        for (b, _), wide in zip(own, mv[np.clip(where, 0, len(mv) - 1)], strict=True):
            b["wide"] = wide
    return row | {"ii_mv": None if ii is None else leads[ii]["mv"], "beats": beats}


def read_pages(signals: DataFrame) -> DataFrame:
    """One row a page, all that a case needs of its samples, which are read once (columns as page_beats', and position): n_samples, n_leads, n_reliable; of lead II its confidence (0 without samples), samples and
    clipped stretches and gaps; leads_reliable (I and aVF are); issue, if beats could not be found; beats, page_beats' columns and

    * area_i_marked, area_f_marked: the net area (mV ms) of the QRS between its marks, over the PQ level; area_i_around, area_f_around: of a window as wide as a surely wide QRS on both sides of the peak, over the
      median around it. Null in a lead that isn't reliable or beside an unreliable stretch.
    * wide: samples of the reference lead around its peak (edges repeated), an odd number, at least as many as the page's template has; null without a peak there. The reference lead is II if it is reliable,
      else the most confident lead."""
    wanted = ["page", "lead", "position", "species", "confidence", "mv", "bad", "rates", "left_px", "px_per_ms", "mv_per_px"]
    return signals.select(*[c for c in wanted if c in signals.columns]).groupBy("page").applyInArrow(page_of, PAGE)


def each_page(df: DataFrame, steps: list, schema: str) -> DataFrame:
    """df's rows of a page through functions from table to table, one after the other in one task: what only lies between two steps (samples, images) is neither shuffled nor
    written. The number of tasks goes by the cores, as few rows here mean much work."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    def run(group: pa.Table) -> pa.Table:
        for step in steps:
            group = step(group)
        return group

    return df.repartition(tasks, "page").groupBy("page").applyInArrow(run, schema)


def each_batch(df: DataFrame, order: str, run: Callable[[pa.Table], Iterator[pa.Table]], schema: str, pages: int = 16 * TOGETHER) -> DataFrame:
    """As each_page, with some whole pages at a time: run takes a table of them, page by page and each in `order`."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for got in run(t):
            yield from got.to_batches()

    def over(batches):
        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            page = held["page"].to_numpy()
            begin = np.append(0, np.flatnonzero(page[1:] != page[:-1]) + 1)  # the last page may go on in the next batch
            at = begin[::pages].tolist()
            for i, j in zip(at, at[1:], strict=False):
                yield from out(held.slice(i, j - i))
            held = held.slice(at[-1])
        if held is not None and held.num_rows:
            yield from out(held)

    return df.repartition(tasks, "page").sortWithinPartitions("page", order).mapInArrow(over, schema)


def page_beats(signals: DataFrame, hz: float = C.HZ) -> DataFrame:
    """Beats with wave marks from signals: page, lead, species, confidence, mv; and, where there are such columns, bad (array of i0, i1, kind: unreliable stretches), rates (array of
    x, value: printed above the page), left_px and px_per_ms (where they stand), mv_per_px.

    A page is a few leads of a few seconds, so a group is small; pages are dealt over tasks. A page that fails has one row with an issue and no beat, others go on."""
    wanted = ["page", "lead", "species", "confidence", "mv", "bad", "rates", "left_px", "px_per_ms", "mv_per_px"]
    return signals.select(*[c for c in wanted if c in signals.columns]).groupBy("page").applyInArrow(lambda group: beats_of(group, hz), BEAT)


def measurements(beats: DataFrame) -> DataFrame:
    """Per page: its beats, medians of PQ, QRS, QT and P duration (ms) over those with marks, and the issue of a page that failed (it has no beats)."""
    return beats.groupBy("page").agg(
        F.count(F.when(F.col("issue").isNull(), 1)).alias("n_beats"), F.median(F.col("q_on") - F.col("p_on")).alias("pq"), F.median(F.col("s_off") - F.col("q_on")).alias("qrs"),
        F.median(F.col("t_off") - F.col("q_on")).alias("qt"), F.median(F.col("p_off") - F.col("p_on")).alias("p_duration"), F.max("issue").alias("issue"),
    )


SIGNAL = "page long, lead string, mv array<double>, confidence double, variant string, px_per_mm double, bad array<struct<i0:int,i1:int,kind:string>>, explained double, issues array<string>, px_per_second double, n_marks int"
_SIGNAL = [
    ("page", pa.int64()), ("lead", pa.string()), ("mv", pa.list_(pa.float64())), ("confidence", pa.float64()), ("variant", pa.string()), ("px_per_mm", pa.float64()), ("bad", pa.list_(pa.struct([("i0", pa.int32()), ("i1", pa.int32()), ("kind", pa.string())]))),
    ("explained", pa.float64()), ("issues", pa.list_(pa.string())), ("px_per_second", pa.float64()), ("n_marks", pa.int32()),
]


def signals_of(images: pa.Table | pa.RecordBatch) -> pa.Table:
    """read_sheets' rows of a few sheets."""
    own = [c for c in images.schema.names if c == "species"]
    pages = sheets_of(*(images[c].to_pylist() for c in ("page", "width", "height", "gray")), [dict(zip(own, rest, strict=True)) for rest in zip(*(images[c].to_pylist() for c in own), strict=True)] if own else None)
    return signals_table(pages, own)


def sheets_of(page: list, width: list, height: list, gray: list, own: list[dict] | None = None) -> list[list[dict]]:
    """For each sheet the rows of its leads, or one row with an issue if it can't be read; own: what all rows of a sheet carry."""
    from pulseframe.kernels import sheet

    images = [sheet._tried(lambda g, h, w: np.frombuffer(g, np.uint8).reshape(h, w), *x) for x in zip(gray, height, width, strict=True)]
    good = [i for i, x in enumerate(images) if not isinstance(x, Exception)]
    read = images
    for i, r in zip(good, sheet.read_together([images[i] for i in good]), strict=True):
        read[i] = r
    out = []
    for p, r, o in zip(page, read, own or [{}] * len(page), strict=True):
        if isinstance(r, Exception):  # one bad sheet must not stop a case
            out.append([{"page": p, "lead": None, "mv": None, "issues": [f"exception:{type(r).__name__}:{r}"]} | o])
            continue
        out.append([{"page": p, "lead": k, "mv": mv, "confidence": float(c), "variant": r["variant"], "px_per_mm": float(r["px_per_mm"][0]), "bad": [dict(zip(("i0", "i1", "kind"), u, strict=True)) for u in r["bad"][k]], "explained": r["traces"][k].explained, "issues": r["issues"] + [f"{k}:{x}" for x in r["traces"][k].reasons], "px_per_second": float(r["px_per_second"]), "n_marks": len(r["marks"])} | o for k, (mv, c) in r["leads"].items()])
    return out


def signals_table(pages: list[list[dict]], own: list[str]) -> pa.Table:
    """Rows of sheets' leads as read_sheets'."""
    schema = pa.schema([*_SIGNAL, *((c, pa.string()) for c in own)])
    return _table([r for rows in pages for r in rows], schema) if pages else schema.empty_table()


def read_sheets(images: DataFrame) -> DataFrame:
    """Sheets (page, width, height, gray) as signals: page, lead, mv, confidence, variant, px_per_mm, bad (stretches that are no signal), explained (share of the lead's ink), issues, px_per_second, n_marks (plus marks taken out of the ink). A sheet that can't be read gives
    one row with an issue and no signal. A species column, if there is one, is carried along."""
    own = ["species"] if "species" in images.columns else []

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, TOGETHER):  # some sheets' samples go on before the next are read
                yield from signals_of(b.slice(i, TOGETHER)).to_batches()

    return images.select("page", "width", "height", "gray", *own).mapInArrow(run, SIGNAL + "".join(f", {c} string" for c in own))
