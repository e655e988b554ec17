"""Onsets, peaks and ends of the waves of one beat in one lead."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from pulseframe.kernels.dsp import medians


@dataclass(frozen=True)
class Windows:
    """Fixed values (ms): nearest and furthest place of P before the QRS onset, its shortest and longest duration; T from the QRS end and to the QRS onset; longest region
    of steep samples before a higher threshold is tried; half the window around the beat; longest plausible QRS."""

    p: tuple[float, float]
    p_ms: tuple[float, float]
    t: tuple[float, float]
    region: float
    half: float
    longest: float


#: Fixed values by species.
WINDOWS = {"dog": Windows((15, 163), (12, 90), (20, 313), 105, 80, 140), "cat": Windows((13, 113), (12, 72), (20, 225), 75, 60, 100)}
#: Shares of the steepest slope, tried in turn; bridged and least samples; level windows before and after the QRS (ms); half-widths of tangents.
SHARES, GAP, LEAST, BEFORE, AFTER, STEEP_HALF, FLAT_HALF = (0.06, 0.12, 0.2, 0.3), 4, 4, (16, 4), (10, 30), 2, 4
#: Least wave in pixels and in noise; a next QRS by its slope and the margin before it (ms); default mV a pixel.
PIXELS, SIGMAS, NEXT_SHARE, NEXT_MS, MV_PER_PX = 2, 3, 0.5, 16, 1 / (4.305 * 10)
#: Factors of confidence.
WIDE, NO_T, NO_P, UNRELIABLE = 0.7, 0.85, 0.9, 0.3
MARKS = ("p_on", "p_off", "q_on", "r_peak", "s_peak", "s_off", "t_peak", "t_off")


def slopes(x: np.ndarray) -> np.ndarray:
    """Central difference, then a three-point mean; edges repeated."""
    p = np.pad(x, 1, mode="edge")
    d = np.pad((p[2:] - p[:-2]) / 2, 1, mode="edge")
    return (d[2:] + d[1:-1] + d[:-2]) / 3


def _middle(x: np.ndarray) -> float:
    n = len(x)
    s = np.partition(x, [(n - 1) // 2, n // 2])
    return float(s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2)


def noise(x: np.ndarray) -> float:
    """Spread of noise from second differences: waves bend little, noise much."""
    d = x[1:] - x[:-1]
    d = np.abs(d[1:] - d[:-1])
    return 0.0 if len(d) < 4 else float(1.4826 * _middle(np.abs(d - _middle(d))) / np.sqrt(6))


class Leads:
    """Filtered leads, a row each, with what all their beats need: slopes, and the noise of both. Behind a lead's end are zeros."""

    def __init__(self, rows: Sequence[np.ndarray]):
        self.n = np.array([len(v) for v in rows], int)
        self.x, self.slope = np.zeros((2, len(rows), max(1, int(self.n.max(initial=0)))))
        self.noise, self.slope_noise = np.zeros((2, len(rows)))
        for i, v in enumerate(rows):
            if len(v):
                x = np.asarray(v, float)
                d = slopes(x)
                self.x[i, : len(v)], self.slope[i, : len(v)], self.noise[i], self.slope_noise[i] = x, d, noise(x), noise(d)


def Lead(x: np.ndarray) -> Leads:  # noqa: N802
    """One lead as Leads. x: its samples, or a row of them."""
    return Leads([np.asarray(x, float).ravel()])


class _Beats:
    """Samples (x, rows as far as n) around places, one place a beat: row is the beat's row of x."""

    def __init__(self, x: np.ndarray, row: np.ndarray, n: np.ndarray):
        self.x, self.row, self.n = x, row, n
        self.flat, self.begin = x.ravel(), row * x.shape[1]

    def of(self, i: np.ndarray) -> _Beats:
        return _Beats(self.x, self.row[i], self.n[i])

    def at(self, i: np.ndarray) -> np.ndarray:
        return self.flat[self.begin + i]

    def window(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Samples a to b of each beat, side by side, and which of them are such (the others lie behind b or outside the row)."""
        k = a[:, None] + np.arange(max(0, int((b - a).max(initial=-1)) + 1))
        return self.flat[self.begin[:, None] + np.clip(k, 0, (self.n - 1)[:, None])], (k <= b[:, None]) & (k >= 0) & (k < self.n[:, None])

    def top(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first place of the greatest sample of a to b; a if there is none."""
        v, ok = self.window(a, b)
        return a + np.where(ok, v, -np.inf).argmax(1) if v.shape[1] else a

    def level(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Median of samples a to b, as far as there are any, else NaN."""
        return medians(self.x, self.row, np.maximum(0, np.minimum(a, b)), np.maximum(0, np.maximum(a, b)), self.n)

    def line(self, i: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
        """Slope and value at i of the least-squares line around it."""
        a, b = np.maximum(0, i - half), np.minimum(self.n, i + half + 1)
        y, ok = self.window(a, b - 1)
        n, y = b - a, np.where(ok, y, 0.0)
        lean = np.where(ok, np.arange(y.shape[1]) - ((n - 1) / 2)[:, None], 0.0)
        slope = np.where(n > 1, (lean * y).sum(1) / np.maximum(1, n * (n * n - 1) / 12), 0.0)
        return slope, y.sum(1) / np.maximum(1, n) - slope * ((a + b - 1) / 2 - i)

    def meets(self, i: np.ndarray, half: int, level: np.ndarray | float) -> np.ndarray:
        """Where the tangent at i meets a level; i itself if it is flat."""
        slope, value = self.line(i, half)
        return np.where(slope != 0, i + (level - value) / np.where(slope != 0, slope, 1.0), i)

    def half_down(self, peak: np.ndarray, limit: np.ndarray, level: np.ndarray | float) -> np.ndarray:
        """From the peak towards limit, all ways the same, the first sample at half its height over level or less; limit if there is none."""
        step = np.where(limit < peak, -1, 1)
        path = peak[:, None] + step[:, None] * np.arange(int(np.abs(limit - peak).max(initial=0)) + 1)
        level = np.broadcast_to(level, peak.shape)
        v = self.flat[self.begin[:, None] + np.clip(path, 0, (self.n - 1)[:, None])]
        low = (np.abs(v - level[:, None]) <= (np.abs(self.at(peak) - level) / 2)[:, None]) & ((limit[:, None] - path) * step[:, None] >= 0)
        return np.where(low.any(1), peak + step * low.argmax(1), limit)


def _region(steep: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The steep samples of each row around top, with at most GAP others between neighbours."""
    k, last = np.arange(steep.shape[1]), steep.shape[1] - 1

    def reach(steep: np.ndarray, top: np.ndarray) -> np.ndarray:
        seen = np.maximum.accumulate(np.where(steep & (k > top[:, None]), k, top[:, None]), 1)
        apart = k[1:] - seen[:, :-1] > GAP + 1
        return np.where(apart.any(1), seen[np.arange(len(top)), apart.argmax(1)], seen[:, -1])

    return last - reach(steep[:, ::-1], last - top), reach(steep, top)


def _turns(d: np.ndarray, ok: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last sample between lo and hi where the slope (d: lo to hi) changes its sign; hi and lo if there is none."""
    if d.shape[1] < 3:
        return hi, lo
    mid, inner = d[:, 1:-1], ok[:, 2:]  # a sample lies between if the one after it is within hi
    ahead, behind = (inner & (mid != 0) & (mid * beside <= 0) for beside in (d[:, 2:], d[:, :-2]))
    return np.where(ahead.any(1), lo + 1 + ahead.argmax(1), hi), np.where(behind.any(1), lo + mid.shape[1] - behind[:, ::-1].argmax(1), lo)


def _p_waves(beats: _Beats, first: np.ndarray, last: np.ndarray, least: np.ndarray, w: Windows, ms: float) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """Onset and end (samples) of P between two samples, and why there is none. A line between the window's edges is taken away first; P must be larger than the window's own noise."""
    on, off = np.full((2, len(first)), np.nan)
    why = np.full(len(first), "p_window_too_short", object)
    i = np.flatnonzero(last - first >= 2 * GAP + 2)
    if not len(i):
        return on, off, why.tolist()
    mine, first, last, least = beats.of(i), first[i], last[i], least[i]
    n = last - first
    edge = np.maximum(2, n // 10)
    left, right = mine.level(first, first + edge), mine.level(last - edge, last)
    v, ok = mine.window(first, last)
    k = np.arange(v.shape[1])
    line = left[:, None] + k * ((right - left) / n)[:, None]
    line[np.arange(len(n)), n] = right
    d = np.where(ok, v - line, 0.0)
    size = np.abs(d)
    peak = np.where((k >= 2) & (k < (n - 1)[:, None]), size, -1.0).argmax(1)
    own = _Beats(d, np.arange(len(n)), n + 1)
    low = ~(own_size := size[np.arange(len(n)), peak] >= np.maximum(least, SIGMAS * np.array([noise(u[: m + 1]) for u, m in zip(d, n.tolist(), strict=True)])))
    a = own.meets(own.half_down(peak, np.zeros_like(n), 0.0), STEEP_HALF, 0.0)
    b = own.meets(own.half_down(peak, n, 0.0), STEEP_HALF, 0.0)
    outside = ~((a >= 0) & (a < peak) & (peak < b) & (b <= n))
    odd = ~((w.p_ms[0] <= (b - a) / ms) & ((b - a) / ms <= w.p_ms[1]))
    good = own_size & ~outside & ~odd
    why[i] = np.select([low, outside, odd], ["p_low_amplitude", "p_lobe_outside_window", "p_duration_out_of_range"], "").astype(object)
    why[i[good]] = None
    on[i[good]], off[i[good]] = (first + a)[good], (first + b)[good]
    return on, off, why.tolist()


def _t_waves(beats: _Beats, first: np.ndarray, last: np.ndarray, base: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Peak and end (samples; NaN if there is none) of T between two samples, and whether the window cuts it. The end is where the tangent at half height of the falling limb meets the base."""
    peaks, ends, cut = np.full(len(first), np.nan), np.full(len(first), np.nan), np.zeros(len(first), bool)
    i = np.flatnonzero(last - first >= LEAST)
    if not len(i):
        return peaks, ends, cut
    mine, first, last, base = beats.of(i), first[i], last[i], base[i]
    v, ok = mine.window(first, last)
    peak = first + np.where(ok, np.abs(v - base[:, None]), -1.0).argmax(1)
    height = mine.at(peak) - base
    there = np.abs(height) >= least[i]
    late = peak >= last - 1
    limb = mine.half_down(peak, last, base)
    falls = (limb > peak) & (-np.sign(height) * mine.line(limb, FLAT_HALF)[0] > 0)
    end = mine.meets(limb, FLAT_HALF, base)
    whole = there & ~late & falls & (peak < end) & (end <= last + GAP)
    peaks[i[there]], ends[i[whole]], cut[i] = peak[there], end[whole], there & late
    return peaks, ends, cut


def delineate(
    lead: np.ndarray | Leads, t_ms: float, species: str, hz: float = 500.0, mv_per_px: float | None = None, before_ms: float | None = None, after_ms: float | None = None, spans: list[tuple[int, int, str]] | None = None
) -> dict:
    """delineate_all of one beat of one lead: its filtered samples (or Leads of one row)."""
    lead = lead if isinstance(lead, Leads) else Lead(lead)
    return delineate_all(lead, [0], [t_ms], species, hz, [mv_per_px], [before_ms], [after_ms], [spans])[0]


def delineate_all(
    leads: Leads, row: Sequence[int], t_ms: Sequence[float], species: str, hz: float = 500.0, mv_per_px: Sequence[float | None] | None = None, before_ms: Sequence[float | None] | None = None,
    after_ms: Sequence[float | None] | None = None, spans: Sequence[list[tuple[int, int, str]] | None] | None = None,
) -> list[dict]:
    """For each beat (a row of leads and a time; beats don't touch each other) marks p_on, p_off, q_on, r_peak, s_peak, s_off, t_peak, t_off (ms; None if not found), p_found, confidence and reasons.

    mv_per_px, by row of leads; before_ms and after_ms: a beat's neighbours; spans: by row of leads, unreliable stretches (first, last, kind). A beat outside the signal has
    no_signal, one without steep samples qrs_not_found, both with confidence 0. A missing P has p_not_found and why: p_window_too_short, p_low_amplitude,
    p_lobe_outside_window or p_duration_out_of_range. A mark in a clipped stretch or a gap gives unreliable_segment."""
    w, ms = WINDOWS[species], hz / 1000
    wide = lambda v: int(np.floor(v * ms + 0.5))
    nothing = lambda why: dict.fromkeys(MARKS) | {"p_found": False, "confidence": 0.0, "reasons": [why]}
    row, t = np.asarray(row, int), np.asarray(t_ms, float)
    out: list[dict] = [nothing("no_signal") for _ in row]
    n = leads.n[row] if len(row) else row
    c = np.floor(t * ms + 0.5).astype(int)
    i = np.flatnonzero((n >= 8) & (c >= 0) & (c < n))
    if not len(i):
        return out
    row, n, c = row[i], n[i], c[i]
    x, d, steep = (_Beats(v, row, n) for v in (leads.x, leads.slope, np.abs(leads.slope)))
    # the QRS: steep samples around the steepest one, with a higher threshold while they reach too far
    a, b = np.maximum(0, c - wide(w.half)), np.minimum(n - 1, c + wide(w.half))
    v, ok = steep.window(a, b)
    v = np.where(ok, v, -1.0)
    top = v.argmax(1)
    steepest, floor = v.max(1), SIGMAS * leads.slope_noise[row]
    lo, hi, open_ = np.zeros_like(a), np.zeros_like(a), np.arange(len(a))
    for share in SHARES:
        lo[open_], hi[open_] = _region(ok[open_] & (v[open_] >= np.maximum(share * steepest[open_], floor[open_])[:, None]), top[open_])
        open_ = open_[(hi - lo)[open_] > wide(w.region)]
        if not len(open_):
            break
    seen = (steepest > 0) & (hi - lo >= LEAST)
    for k in i[~seen].tolist():
        out[k] = nothing("qrs_not_found")
    i, row, n, c, a, b, lo, hi, steepest = (u[seen] for u in (i, row, n, c, a, b, a + lo, a + hi, steepest))
    if not len(i):
        return out
    x, d, steep = (u.of(seen) for u in (x, d, steep))
    after, before = (np.array([np.nan if u is None else u for u in times], float)[i] if times is not None else np.full(len(i), np.nan) for times in (after_ms, before_ms))
    base = x.level(lo - wide(BEFORE[0]), lo - wide(BEFORE[1]))
    base = np.where(np.isnan(base), x.level(a, b), base)
    behind = x.level(hi + wide(AFTER[0]), hi + wide(AFTER[1]))
    pixel = np.array([u if u and u > 0 else MV_PER_PX for u in mv_per_px or [None] * len(leads.n)])[row]
    least = np.maximum(PIXELS * pixel, SIGMAS * leads.noise[row])
    first, last = _turns(*d.window(lo, hi), lo, hi)
    q_on = np.minimum(first, np.maximum(lo - GAP, x.meets(steep.top(lo, np.maximum(lo, first)), STEEP_HALF, base)))
    s_off = np.maximum(last, np.minimum(hi + GAP, x.meets(steep.top(np.minimum(hi, last), hi), STEEP_HALF, np.where(np.isnan(behind), base, behind))))
    qa, qb = np.maximum(0, np.floor(q_on)).astype(int), np.minimum(n - 1, np.ceil(s_off)).astype(int)
    r = x.top(qa, np.maximum(qa, qb))
    has_r = x.at(r) - base >= least
    deep, ok = x.window(np.where(has_r, r, qa), np.maximum(qb, np.where(has_r, r, qa)))
    s = np.where(has_r, r, qa) + np.where(ok, deep, np.inf).argmin(1)
    has_s = base - x.at(s) >= least
    # T, up to the next QRS
    begin, end = np.minimum(n - 1, qb + wide(w.t[0])), np.minimum(n - 1, qa + wide(w.t[1]))
    v, ok = steep.window(begin, end)
    front = ok & (v >= (NEXT_SHARE * steepest)[:, None])
    whole = lambda u: np.floor(np.nan_to_num(u) * ms + 0.5).astype(int)
    until = np.minimum(end, whole(after) - (np.where(has_r, r, c) - qa) - wide(NEXT_MS))
    end = np.where(~np.isnan(after), until, np.where(front.any(1), begin + (front.argmax(1) if front.shape[1] else 0) - wide(NEXT_MS), end))
    t_peak, t_off, cut = _t_waves(x, begin, end, base, least)
    # P, from the beat before
    begin = np.maximum(np.maximum(0, qa - wide(w.p[1])), np.where(np.isnan(before), 0, whole(before) + wide(w.half)))
    p_on, p_off, why = _p_waves(x, begin, np.maximum(0, qa - wide(w.p[0])), least, w, ms)
    p_off = np.minimum(p_off, q_on)
    confidence = np.where(np.isnan(t_off), NO_T, 1.0) * np.where(np.isnan(p_on), NO_P, 1.0)
    too_wide = (s_off - q_on) / ms > w.longest
    confidence = np.where(too_wide, confidence * WIDE, confidence)
    marks = np.stack([p_on, p_off, q_on, np.where(has_r, r, np.nan), np.where(has_s, s, np.nan), s_off, t_peak, t_off], 1)
    hit = np.zeros(len(i), bool)
    for k in np.flatnonzero(np.array([bool(u) for u in spans])[row] if spans is not None else hit).tolist():
        at = np.floor(marks[k] + 0.5)
        hit[k] = any(((u <= at) & (at <= v)).any() for u, v, kind in spans[row[k]] if kind != "ambiguous")
    confidence = np.where(hit, confidence * UNRELIABLE, confidence)
    found = [[None if u != u else u for u in line] for line in (marks / ms).tolist()]
    for k, line, sure, p_why, no_t, short, broad, bad in zip(i.tolist(), found, confidence.tolist(), why, np.isnan(t_off).tolist(), cut.tolist(), too_wide.tolist(), hit.tolist(), strict=True):
        reasons = ["t_window_truncated"] if short else ["t_not_found"] if no_t else []
        reasons += ["p_not_found", p_why] if p_why else []
        reasons += ["qrs_too_wide"] if broad else []
        reasons += ["unreliable_segment"] if bad else []
        out[k] = dict(zip(MARKS, line, strict=True)) | {"p_found": p_why is None, "confidence": sure, "reasons": reasons}
    return out
