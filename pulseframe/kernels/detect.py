"""Beats of one page: an adaptive threshold detector over the summed features of its leads."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np

from pulseframe.kernels import dsp


@dataclass(frozen=True)
class Species:
    """Band (Hz), feature window, refractory time and search half-window (ms), longest plausible QRS region (ms)."""

    band: tuple[float, float]
    feature_ms: float
    refractory_ms: float
    half_ms: float
    region_ms: float


#: Fixed values by species.
SPECIES = {"dog": Species((5.0, 25.0), 80, 150, 80, 105), "cat": Species((8.0, 35.0), 50, 100, 60, 75)}
#: Threshold share; search-back factor and gap; learning rates; history; edge; floor; quantile; replacement and tie; prematurity.
SHARE, BACK, GAP, LEARN, LEARN_BACK, HISTORY, FLOOR, QUANTILE = 0.25, 0.5, 1.66, 0.125, 0.25, 8, 0.02, 0.99
REPLACE, TIE, EARLY, EARLY_SHARE, EDGE_SHARE, EDGE = 1.25, 0.8, 0.9, 0.5, 0.5, 2
#: Share of a lead's feature that bounds its QRS region; how much larger a wave against the lead's usual direction must be; beats for a template.
REGION, AGAINST, TEMPLATE = 0.3, 2, 3
#: Agreement of leads (ms), plausible rate, morphology and weakness limits and their factors.
AGREE_MS, RATE, ALIKE, WEAK, FACTOR = 10.0, (30.0, 320.0), 0.7, 0.5, 0.8


@dataclass
class Beat:
    """t_ms and confidence of a beat; by lead its peak (ms) and how well the lead agrees (0.2 to 1)."""

    t_ms: float
    confidence: float
    leads: dict[str, float]
    trust: dict[str, float] = field(default_factory=dict)
    reasons: list[str] = field(default_factory=list)


def _middle(x: list[int]) -> float:
    s, n = sorted(x), len(x)
    return s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2


class _Levels:
    """Running signal and noise levels, accepted peaks and the last HISTORY intervals between them. f: the feature at candidates, c: their places; a peak is a candidate's number."""

    def __init__(self, f: list[float], c: list[int], n: int, signal: float, noise: float, refractory: int):
        self.f, self.c, self.n, self.signal, self.noise, self.refractory = f, c, n, signal, noise, refractory
        self.peaks: list[int] = []
        self.noises: list[float] = []
        self.rr: list[int] = []

    @property
    def threshold(self) -> float:
        return self.noise + SHARE * (self.signal - self.noise)

    def accept(self, k: int, rate: float = LEARN) -> None:
        if self.peaks:
            self.rr = [*self.rr, self.c[k] - self.c[self.peaks[-1]]][-HISTORY:]
        self.peaks.append(k)
        self.signal += rate * (self.f[k] - self.signal)

    def reject(self, k: int) -> None:
        self.noises.append(self.f[k])
        self.noise += LEARN * (self.f[k] - self.noise)

    def look_back(self, until: int) -> None:
        """Where the gap is long, take the largest candidate within it above a share of the threshold: once."""
        last = self.c[self.peaks[-1]]
        if not self.rr or until - last <= GAP * _middle(self.rr):
            return
        i, j = bisect_right(self.c, last + self.refractory), bisect_right(self.c, until - self.refractory)
        if i < j and self.f[best := max(range(i, j), key=self.f.__getitem__)] > BACK * self.threshold:
            self.accept(best, LEARN_BACK)

    def replace(self, k: int) -> None:
        """Inside the refractory time a clearly larger candidate, or one about as large that fits the rhythm better, replaces the last peak."""
        last, f, c = self.peaks[-1], self.f, self.c
        nearer = False
        if len(self.peaks) > 1 and self.rr:
            due = c[self.peaks[-2]] + _middle(self.rr)
            nearer = abs(c[k] - due) < abs(c[last] - due)
        if f[k] > REPLACE * f[last] or (f[k] > TIE * f[last] and nearer):
            self.peaks[-1] = k
            if self.rr:
                self.rr[-1] += c[k] - c[last]
            self.signal += LEARN * (f[k] - self.signal)

    def run(self) -> None:
        for k, c in enumerate(self.c):
            if self.peaks and c - self.c[self.peaks[-1]] < self.refractory:
                self.replace(k)
                continue
            if self.peaks:
                self.look_back(c)
                if c - self.c[self.peaks[-1]] < self.refractory:
                    continue
            early = len(self.rr) >= 3 and c - self.c[self.peaks[-1]] < EARLY * _middle(self.rr) and self.f[k] < EARLY_SHARE * self.signal
            if early or self.f[k] <= self.threshold:
                self.reject(k)
            else:
                self.accept(k)
        if self.peaks:
            self.look_back(self.n - 1 + self.refractory)


#: A stretch of samples, first and last, and its kind: clipped, gap or ambiguous. Samples of the first two are no signal.
Span = tuple[int, int, str]


def usable(n: int, spans: Iterable[Span], pad: int = 0) -> np.ndarray:
    """Which of n samples are signal: those further than `pad` from clipped stretches and gaps."""
    ok = np.ones(n, bool)
    for first, last, kind in spans:
        if kind != "ambiguous":
            ok[max(0, first - pad) : max(0, last + pad + 1)] = False
    return ok


def features(x: np.ndarray, lengths: np.ndarray, spans: Sequence[Iterable[Span]], sp: Species, hz: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row (a lead's samples, 8 at least) its energy over the energy of its own QRS peaks (a high quantile of usable samples), 0 where it is not usable and behind its end; and whether it has any."""
    pad, has = math.ceil(sp.feature_ms * hz / 2000), np.zeros(len(x), bool)
    out = dsp.energy(x, sp.band, sp.feature_ms, hz, lengths)
    for i, (n, f, bad) in enumerate(zip(lengths.tolist(), out, spans, strict=True)):
        bad = list(bad)
        ok = usable(n, bad, pad) if bad else None
        v = f[:n] if ok is None else f[:n][ok]
        if len(v) and (top := np.partition(v, k := min(len(v) - 1, int(len(v) * QUANTILE)))[k]) > 0:
            f[:n] /= top
            if ok is not None:
                f[:n][~ok] = 0.0
            f[n:], has[i] = 0.0, True
    return out, has


def stacked(rows: Sequence[np.ndarray], lengths: np.ndarray) -> np.ndarray:
    """Rows of different lengths as one array, zeros behind their ends."""
    out = np.zeros((len(rows), int(lengths.max(initial=0))))
    for to, x in zip(out, rows, strict=True):
        to[: len(x)] = x
    return out


def peaks(feature: np.ndarray, lengths: np.ndarray, hz: float, sp: Species) -> list[tuple[list[int], float]]:
    """For each row of a feature (zeros behind its end) the places of beats and its level at beats: local maxima through two adaptive passes, without those cut by the page's ends."""
    most, refractory = feature.max(1, initial=0.0), round(sp.refractory_ms * hz / 1000)
    mid = feature[:, 1:-1]
    high = (mid > feature[:, :-2]) & (mid >= feature[:, 2:]) & (mid > FLOOR * most[:, None]) & (np.arange(1, mid.shape[1] + 1) < lengths[:, None] - 1)
    row, at = np.nonzero(high)
    at += 1
    cuts = np.searchsorted(row, np.arange(len(feature) + 1)).tolist()
    at, value = at.tolist(), feature[row, at].tolist()
    out: list[tuple[list[int], float]] = []
    for f, n, m, a, b in zip(feature, lengths.tolist(), most.tolist(), cuts, cuts[1:], strict=False):
        if n < 3 or m <= 0:
            out.append(([], 0.0))
            continue
        c, v, start = at[a:b], value[a:b], f[: min(n, int(2 * hz))]
        level = _Levels(v, c, n, float(start.max()), dsp.median(start), refractory)
        level.run()
        signal = dsp.median(np.array([v[k] for k in level.peaks])) if level.peaks else level.signal
        level = _Levels(v, c, n, signal, dsp.median(np.array(level.noises)) if level.noises else level.noise, refractory)
        level.run()
        # the lobe lies strictly between its neighbours that are low, further than EDGE from the ends
        whole = [c[k] for k in level.peaks if (f[EDGE : c[k]] < EDGE_SHARE * v[k]).any() and (f[c[k] + 1 : n - EDGE] < EDGE_SHARE * v[k]).any()]
        out.append((whole, level.signal))
    return out


def _places(x: np.ndarray, f: np.ndarray, n: np.ndarray, row: np.ndarray, at: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of a lead (row of x and its feature f, as far as n) and a beat's place: the place of its main wave, the centre of its energy, and whether the lead has signal there.

    The wave lies where the feature, around its maximum near the beat, stays above a share of it; it points the way that most of the lead's
    beats do, unless the other way is much larger."""
    k, flat = np.arange(2 * half + 1), (row * x.shape[1])[:, None]
    where = np.clip(at[:, None] + k - half, 0, (n[row] - 1)[:, None])
    near = f.ravel()[flat + where]
    top = near.argmax(1)
    pair = np.arange(len(at))
    best = near[pair, top]
    low = near < REGION * best[:, None]
    first = np.max(np.where(low & (k < top[:, None]), k + 1, 0), 1, initial=0)
    last = np.min(np.where(low & (k > top[:, None]), k - 1, 2 * half), 1, initial=2 * half)
    inside = (k >= first[:, None]) & (k <= last[:, None])
    v = x.ravel()[flat + where]
    base = dsp.medians(x, row, at - 2 * half, at + 2 * half, n[row])
    up, down = np.where(inside, v, -np.inf).argmax(1), np.where(inside, v, np.inf).argmin(1)
    rise, fall = np.maximum(0, v[pair, up] - base), np.maximum(0, base - v[pair, down])
    there = best > 0
    mostly_up = np.bincount(row[there], np.where(rise >= fall, 1, -1)[there], len(x))[row] >= 0
    upward = np.where(mostly_up, rise * AGAINST >= fall, rise > AGAINST * fall)
    return where[pair, np.where(upward, up, down)], where[pair, top], there


def _alike(windows: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Correlation of each window with the template, 0 for flat ones."""
    a, b = windows - windows.mean(1, keepdims=True), template - template.mean()
    size = np.sqrt((a * a).sum(1) * (b @ b))
    return np.where(size > 0, a @ b / np.where(size > 0, size, 1), 0.0)


@dataclass
class Page:
    """A page to find beats on: equally sampled signals by name, their confidence and unreliable stretches."""

    leads: Mapping[str, np.ndarray]
    confidence: Mapping[str, float] = field(default_factory=dict)
    spans: Mapping[str, Iterable[Span]] = field(default_factory=dict)


def detect(leads: Mapping[str, np.ndarray], confidence: Mapping[str, float], species: str, hz: float = 500.0, spans: Mapping[str, Iterable[Span]] | None = None) -> list[Beat]:
    """Beats of a page. leads: equally sampled signals by name; unreliable ones (confidence under 0.6) are used only if all are. spans: unreliable stretches by lead; in clipped ones
    and gaps a lead says nothing, so a beat that lies in such stretches of all leads is not found."""
    return detect_pages([Page(leads, confidence, spans or {})], species, hz)[0]


def detect_pages(pages: Sequence[Page], species: str, hz: float = 500.0) -> list[list[Beat]]:
    """detect for several pages at once, each on its own; best for pages that are about as long."""
    sp, out = SPECIES[species], [[] for _ in pages]
    of, names, rows, spans, shortest = [], [], [], [], np.zeros(len(pages), int)
    for i, page in enumerate(pages):
        full = {x: np.asarray(v, float) for x, v in page.leads.items() if len(v)}
        full = {x: v for x, v in full.items() if page.confidence.get(x, 1.0) >= 0.6} or full
        shortest[i] = min((len(v) for v in full.values()), default=0)
        for name, v in full.items():
            if len(v) >= 8:
                of.append(i)
                names.append(name)
                rows.append(v)
                spans.append(page.spans.get(name, ()))
    if not rows:
        return out
    lengths = np.array([len(v) for v in rows], int)
    x = stacked(rows, lengths)
    f, has = features(x, lengths, spans, sp, hz)
    of = np.array(of)
    if not has.all():
        of, names, f, x, lengths = of[has], [name for name, ok in zip(names, has, strict=True) if ok], f[has], x[has], lengths[has]
    n = shortest[of]
    for i in np.flatnonzero(lengths > n).tolist():
        f[i, n[i] :] = 0.0
    total = np.zeros((len(pages), f.shape[1]))
    for i, row in zip(of.tolist(), f, strict=True):
        total[i] += row
    found = peaks(total, shortest, hz, sp)
    page = np.repeat(np.arange(len(pages)), [len(at) for at, _ in found])
    at = np.array([p for places, _ in found for p in places], int)
    if not len(at):
        return out
    half, near = round(sp.half_ms * hz / 1000), round(AGREE_MS * hz / 1000)
    # pairs of a beat and a lead of its page, beat by beat
    begin, count = np.searchsorted(of, np.arange(len(pages))), np.bincount(of, minlength=len(pages))
    beat = np.repeat(np.arange(len(at)), count[page])
    place_no = np.arange(len(beat)) - np.repeat(np.cumsum(count[page]) - count[page], count[page])
    row = begin[page[beat]] + place_no
    place, centre, there = _places(x, f, n, row, at[beat], half)
    away = np.abs(centre - at[beat])
    said = np.bincount(beat[there], minlength=len(at))
    agree = np.bincount(beat[there & (away <= near)], minlength=len(at))
    share = np.where(said > 0, agree / np.maximum(1, said), 0.0)
    each = np.full((len(at), int(count.max())), np.inf)
    each[beat[there], place_no[there]] = place[there]
    each.sort(1)
    some, b = np.maximum(1, said), np.arange(len(at))
    t = np.where(said > 0, np.floor((each[b, (some - 1) // 2] + each[b, some // 2]) / 2 + 0.5), at).astype(int)
    trust = np.where(away <= near, 1.0, np.maximum(0.2, 1 - (away - near) / (3 * near)))
    weak = total[page, at] < WEAK * np.array([signal for _, signal in found])[page]
    values = list(zip((place * 1000 / hz).tolist(), trust.tolist(), there.tolist(), [names[r] for r in row], strict=True))
    ends = np.searchsorted(beat, np.arange(len(at) + 1)).tolist()
    for i, (p, t_ms, sure, feeble) in enumerate(zip(page.tolist(), (t * 1000 / hz).tolist(), share.tolist(), weak.tolist(), strict=True)):
        mine = [v for v in values[ends[i] : ends[i + 1]] if v[2]]
        beat_of = Beat(t_ms, 0.5 + 0.5 * sure, {v[3]: v[0] for v in mine}, {v[3]: v[1] for v in mine})
        if mine and sure < 0.5:
            beat_of.reasons.append("lead_disagreement")
        if feeble:
            beat_of.reasons.append("weak_peak")
            beat_of.confidence *= FACTOR
        if "II" not in beat_of.leads:
            beat_of.reasons.append("lead_ii_unreliable")
        out[p].append(beat_of)
    ii = {int(p): i for i, (p, name) in enumerate(zip(of, names, strict=True)) if name == "II"}
    _outliers([(beats, x[ii[p]], n[ii[p]]) for p, beats in enumerate(out) if p in ii and len(beats) >= TEMPLATE], half, hz)
    for beats in out:
        bad = [not 60_000 / RATE[1] <= v.t_ms - u.t_ms <= 60_000 / RATE[0] for u, v in zip(beats, beats[1:], strict=False)]
        for v, before, after in zip(beats, [False, *bad], [*bad, False], strict=False):
            if before or after:
                v.reasons.append("hr_implausible")
                v.confidence *= FACTOR
    return out


def _outliers(pages: list[tuple[list[Beat], np.ndarray, int]], half: int, hz: float) -> None:
    """Beats whose window in lead II is unlike the median of their page's. pages: beats, lead II, its length; edges are repeated. Pages with as many beats go together."""
    for size in {len(beats) for beats, _, _ in pages}:
        those = [p for p in pages if len(p[0]) == size]
        at = np.array([[round(b.leads.get("II", b.t_ms) * hz / 1000) for b in beats] for beats, _, _ in those])
        where = np.clip(at[:, :, None] + np.arange(-half, half + 1), 0, np.array([n for _, _, n in those])[:, None, None] - 1)
        windows = np.stack([x[w] for (_, x, _), w in zip(those, where, strict=True)])
        for (beats, _, _), window, template in zip(those, windows, np.median(windows, 1), strict=True):
            for b, rho in zip(beats, _alike(window, template).tolist(), strict=True):
                if rho < ALIKE:
                    b.reasons.append("morphology_outlier")
                    b.confidence *= FACTOR
