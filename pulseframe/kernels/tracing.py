"""Which ink belongs to which lead, and each lead's curve from its runs: points that keep apexes, stretches that are no signal, samples.

A column's runs are (top, bottom) arrays as sheet.runs makes them; a lead's way has one run's number a column, or -1."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Tallest flat run, least part of a run beyond the path that is an apex, longest gap that is joined without a mark, height from which a shared run is ambiguous (px).
FLAT, APEX, JOINED, TALL = 3, 2, 3, 6
#: Least coverage and share of ink explained without a reason; window of the baseline needs so many points.
COVERED, EXPLAINED, WINDOW_POINTS = 0.98, 0.97, 10


@dataclass
class Trace:
    """x and y of the curve (px), its baseline, stretches (first and last column, kind), coverage, share of ink explained, confidence and reasons."""

    x: np.ndarray
    y: np.ndarray
    baseline: float = 0.0
    spans: list[tuple[int, int, str]] = field(default_factory=list)
    coverage: float = 0.0
    explained: float = 1.0
    confidence: float = 0.0
    reasons: list[str] = field(default_factory=list)


def stretches(on: np.ndarray) -> list[tuple[int, int]]:
    """Neighbouring true places as (first, last)."""
    e = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(e[::2], e[1::2], strict=True)]


def touching(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of the run graph: numbers of runs in neighbouring columns whose ranges touch (corners included). Also where each column's numbers begin."""
    at = np.append(0, np.cumsum([len(r) for r in columns]))
    flat = np.concatenate([*columns, np.zeros((0, 2))]).astype(int)
    column = np.repeat(np.arange(len(columns)), np.diff(at))
    left, right = neighbours(column, flat[:, 0], flat[:, 1])
    return left, right, at


def neighbours(line: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of runs in neighbouring lines (rows or columns) whose ranges touch, corners included. Runs are listed line by line, in order and apart."""
    wide = int(last.max(initial=0)) + 4  # a line's places are told from the next one's
    begin, end = line * wide + first, line * wide + last
    i = np.searchsorted(end, begin - wide - 1)
    n = np.maximum(0, np.searchsorted(begin, end - wide + 1, "right") - i)
    right = np.repeat(np.arange(len(line)), n)
    return np.repeat(i, n) + np.arange(len(right)) - np.repeat(np.cumsum(n) - n, n), right


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n runs the smallest run that it hangs together with: of two labels that an edge joins the larger takes the smaller, and labels are followed to their ends, until no edge joins two."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while ((on := label[label]) != label).any():
            label = on


def owners(columns: list[np.ndarray], ways: np.ndarray) -> np.ndarray:
    """For each run the lead that it belongs to, or -1: a lead's own runs, then, ring by ring over the graph, runs that touch one that has an owner. Of several leads the first wins."""
    a, b, at = touching(columns)
    owner = np.full(at[-1], -1)
    for k in range(len(ways) - 1, -1, -1):
        c = np.flatnonzero(ways[k] >= 0)
        owner[at[c] + ways[k][c]] = k
    ends, starts = np.concatenate([a, b]), np.concatenate([b, a])
    while True:
        free = (owner[ends] < 0) & (owner[starts] >= 0)
        if not free.any():
            return owner
        best = np.full(len(owner), len(ways))
        np.minimum.at(best, ends[free], owner[starts[free]])
        owner = np.where((owner < 0) & (best < len(ways)), best, owner)


def pixels(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each true place, row by row."""
    i = np.flatnonzero(mask)
    y = i // mask.shape[1]
    return y, i - y * mask.shape[1]


class Ink:
    """The ink's pixels, column by column: how many lie in stretches of columns, and with gray values their darkness and that times the row. All sums are of whole numbers, so exact."""

    def __init__(self, mask: np.ndarray, gray: np.ndarray | None = None):
        y, x = pixels(mask)
        order = np.argsort(x.astype(np.uint16) if mask.shape[1] < 65_536 else x, kind="stable")
        self.y, self.x, self.height = y[order], x[order], len(mask) + 1
        self.key = self.x * self.height + self.y
        if gray is not None:
            dark = 255.0 - gray[self.y, self.x]
            self.weight, self.moment = (np.append(0.0, np.cumsum(v)) for v in (dark, dark * self.y))

    def between(self, top: np.ndarray, bottom: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pixels of rows top to bottom of columns begin and end in the list."""
        a, b, c = (np.asarray(v).astype(int) for v in (top, bottom, column))
        return np.searchsorted(self.key, c * self.height + a), np.searchsorted(self.key, c * self.height + b + 1)


def explained(columns: list[np.ndarray], ways: np.ndarray, anchors: np.ndarray, mask: np.ndarray | Ink) -> np.ndarray:
    """For each lead the share of its ink that its runs, or runs that hang on them, explain; other ink counts against the lead with the nearest anchor."""
    owner = owners(columns, ways)
    flat = np.concatenate([*columns, np.zeros((0, 2))])
    column = np.repeat(np.arange(len(columns)), [len(r) for r in columns])
    first, end = (mask if isinstance(mask, Ink) else Ink(mask)).between(flat[:, 0], flat[:, 1], column)
    pixels = end - first
    nearest = np.abs(flat.mean(1)[:, None] - np.asarray(anchors)[None]).argmin(1) if len(flat) else np.zeros(0, int)
    m = len(ways)
    good = np.bincount(owner[owner >= 0], pixels[owner >= 0], m)
    bad = np.bincount(nearest[owner < 0], pixels[owner < 0], m)
    return np.where(good + bad > 0, good / np.maximum(1e-9, good + bad), 1.0)


def boundary(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where a path goes from one run to the next: the middle of what they share, or of the gap between them."""
    return (np.maximum(a[..., 0], b[..., 0]) + np.minimum(a[..., 1], b[..., 1])) / 2


def split(columns: list[np.ndarray], breaks: list[list[list[tuple[float, float]]]], ways: np.ndarray) -> list[dict[int, np.ndarray]]:
    """Runs of two neighbouring leads' shared stretches parted at a white gap inside: by lead, column to its own part.

    A gap parts a run if it lies between where the upper and the lower lead come in from their own runs, from the left or from the right; so parting goes on along a stretch while
    there are gaps. breaks: for each run of a column the gaps that were bridged."""
    own: list[dict[int, np.ndarray]] = [{} for _ in ways]
    n = len(columns)
    part = lambda k, c: own[k].get(c) if c in own[k] else columns[c][ways[k][c]] if 0 <= c < n and ways[k][c] >= 0 else None
    for up in range(len(ways) - 1):
        low = up + 1
        shared = (ways[up] >= 0) & (ways[up] == ways[low])
        for first, last in stretches(shared):
            for order, step in ((range(first, last + 1), -1), (range(last, first - 1, -1), 1)):
                for c in order:
                    if not shared[c]:
                        continue
                    run, u, v = columns[c][ways[up][c]], part(up, c + step), part(low, c + step)
                    if u is None or v is None or (0 <= c + step < n and shared[c + step]):
                        break
                    a, b = float(boundary(u, run)), float(boundary(v, run))
                    gaps = [g for g in breaks[c][ways[up][c]] if a < g[0] and g[1] < b]
                    if not gaps:
                        break
                    g = min(gaps, key=lambda g: abs((g[0] + g[1]) / 2 - (a + b) / 2))
                    own[up][c], own[low][c] = np.array([run[0], g[0] - 1]), np.array([g[1] + 1, run[1]])
                    shared[c] = False
    return own


def claims(way_runs: list[dict[int, np.ndarray]] | dict[int, dict[int, np.ndarray]], shared: np.ndarray, pair: tuple[int, int]) -> list[dict[int, tuple[bool, bool]]]:
    """For both leads of a pair, by shared column, whether its top and its bottom may be their apex.

    Of a shared stretch only the highest and the lowest point can be an apex. It is nobody's if a run of either lead's own, next to the stretch, reaches it: it is then a stroke that goes on. Else it belongs
    to the lead whose ways in and out lie further from it."""
    out: list[dict[int, tuple[bool, bool]]] = [{}, {}]
    for first, last in stretches(shared):
        runs = np.array([way_runs[pair[0]][c] for c in range(first, last + 1)])
        for mine in out:
            mine.update({c: (False, False) for c in range(first, last + 1)})
        beside = [[way_runs[k].get(first - 1), way_runs[k].get(last + 1)] for k in pair]
        for side, sign in ((0, 1.0), (1, -1.0)):  # the top is small, the bottom large
            c = int((sign * runs[:, side]).argmin())
            extreme = runs[c, side]
            if any(r is not None and sign * (r[side] - extreme) < APEX for ends in beside for r in ends):
                continue
            margins = []
            for before, after in beside:
                ways_in = [sign * (float(boundary(r, edge)) - extreme) for r, edge in ((before, runs[0]), (after, runs[-1])) if r is not None]
                margins.append(min(ways_in, default=-np.inf))
            who = int(np.argmax(margins))
            if margins[who] >= APEX:
                top, bottom = out[who][first + c]
                out[who][first + c] = (True, bottom) if side == 0 else (top, True)
    return out


def curve(x: np.ndarray, runs: np.ndarray, dark: np.ndarray | Ink | None = None, claimed: dict[int, tuple[bool, bool]] | None = None, thin: int = FLAT, least: float = APEX) -> tuple[np.ndarray, np.ndarray]:
    """Points of a way: x its columns, runs (top, bottom) there. A flat run is one point, at its darkness' centre (dark: rows x columns, or an Ink with gray values) or its middle. A steep run is entered half a column before and
    left half a column after; where the path turns inside it and it sticks out beyond its neighbours, the apex is a point of its own. claimed: columns whose top and bottom are apexes only if allowed; thin: the tallest flat run; least: how far an apex goes beyond the way."""
    n = len(x)
    if not n:
        return np.zeros(0), np.zeros(0)
    top, bottom = runs[:, 0], runs[:, 1]
    flat = bottom - top + 1 <= thin
    y = (top + bottom) / 2
    if dark is not None:
        ink = dark if isinstance(dark, Ink) else Ink(dark > 0, 255.0 - dark)
        a, b = ink.between(top, bottom, x)
        w = ink.weight[b] - ink.weight[a]
        y = np.where(w > 0, (ink.moment[b] - ink.moment[a]) / np.where(w > 0, w, 1), y)
    joined = np.append(False, np.diff(x) == 1)  # to the column before
    after = np.append(joined[1:], False)
    edge = np.append(np.nan, boundary(runs[:-1], runs[1:]))  # with the one before
    mid_next = np.append(y[1:], np.nan)
    leave = np.where(after, np.append(edge[1:], np.nan), np.clip((np.append(top[1:], np.nan) + np.append(bottom[1:], np.nan)) / 2, top, bottom))
    came = np.append(np.nan, np.where(flat, y, leave)[:-1])
    enter = np.where(joined, edge, np.where(np.isnan(came), (top + bottom) / 2, np.clip(came, top, bottom)))
    leave = np.where(np.isnan(mid_next), enter, leave)
    low, high = np.minimum(enter, leave), np.maximum(enter, leave)
    before_, next_ = np.roll(runs, 1, 0), np.roll(runs, -1, 0)
    allowed = np.ones((n, 2), bool)
    for i, c in enumerate(x.tolist() if claimed else []):
        if c in claimed:
            allowed[i] = claimed[c]
    rises = ~flat & (low - top >= least) & (~joined | (top < before_[:, 0])) & (~after | (top <= next_[:, 0])) & allowed[:, 0]
    falls = ~flat & (bottom - high >= least) & (~joined | (bottom > before_[:, 1])) & (~after | (bottom >= next_[:, 1])) & allowed[:, 1]
    first_top = np.abs(top - enter) <= np.abs(bottom - enter)
    one = np.where(rises & (first_top | ~falls), top, np.where(falls, bottom, np.nan))
    two = np.where(rises & falls, np.where(first_top, bottom, top), np.nan)
    steep_before = joined & ~np.append(True, flat[:-1])
    flat_after = ~after | np.append(flat[1:], True)
    px = np.stack([x - 0.5, x, x, x + 0.5], 1)
    py = np.stack([np.where(~flat, enter, np.where(steep_before, edge, np.nan)), np.where(flat, y, one), two, np.where(~flat & flat_after, leave, np.nan)], 1)
    ok = ~np.isnan(py)
    return px[ok], py[ok]


def mode(y: np.ndarray) -> float:
    """The most frequent height (lowest on ties), refined by the mean within one pixel."""
    k = np.floor(y + 0.5).astype(int)
    m = k.min() + np.bincount(k - k.min()).argmax()
    near = np.abs(y - m) <= 1
    return float(y[near].mean()) if near.any() else float(m)


def baseline(x: np.ndarray, y: np.ndarray, second_px: float) -> float:
    """The median of the most frequent heights in windows of a second, half a second apart: with drift the level of the middle. Points of flat runs count, if there are enough."""
    flat = x == np.floor(x)
    if flat.sum() >= WINDOW_POINTS:
        x, y = x[flat], y[flat]
    starts = np.arange(x[0], x[-1], second_px / 2)
    i, j = np.searchsorted(x, starts), np.searchsorted(x, starts + second_px)
    found = [mode(y[a:b]) for a, b in zip(i, j, strict=True) if b - a >= WINDOW_POINTS]
    return float(np.median(found)) if found else mode(y)


def digitize(t: Trace, left: float, right: float, px_per_sample: float, mv_per_px: float, frame: tuple[float, float]) -> tuple[np.ndarray, list[tuple[int, int, str]]]:
    """Samples of a curve from `left` to `right`, and its stretches as samples. A sample is the curve's height at its place; an apex between two samples that is beyond both is
    written to the nearest, and a second apex for the same sample to the one beside it. A clipped stretch has the level of the frame's edge that the curve went to: frame is (top, bottom)."""
    if not len(t.x) or px_per_sample <= 0:
        return np.zeros(0), []
    n = int((right - left) / px_per_sample) + 1
    to_mv = lambda y: (t.baseline - y) * mv_per_px
    mv = to_mv(np.interp(left + np.arange(n) * px_per_sample, t.x, t.y))
    at, v = (t.x - left) / px_per_sample, to_mv(t.y)
    cell = np.floor(at).astype(int)
    begin = np.flatnonzero(np.append(True, np.diff(cell) != 0))
    wanted = []
    stop, of = np.append(begin[1:], len(cell)), cell[begin]
    here = np.clip(of, 0, max(0, n - 2))
    beside = np.stack([mv[here], mv[np.minimum(n - 1, here + 1)]])
    some = (of >= 0) & (of < n - 1) & ((np.maximum.reduceat(v, begin) > beside.max(0)) | (np.minimum.reduceat(v, begin) < beside.min(0)))
    for a, b in zip(begin[some].tolist(), stop[some].tolist(), strict=True):
        c = cell[a]
        hi, lo = a + int(v[a:b].argmax()), a + int(v[a:b].argmin())
        wanted += sorted({i for i, beyond in ((hi, v[hi] > max(mv[c], mv[c + 1])), (lo, v[lo] < min(mv[c], mv[c + 1]))) if beyond})
    taken: dict[int, int] = {}
    for i in wanted:
        j = int(np.floor(at[i] + 0.5))
        if j in taken and v[taken[j]] != v[i]:
            beside = j + (1 if t.x[i] >= t.x[taken[j]] else -1)
            if 0 <= beside < n and beside not in taken:
                taken[beside] = i
                continue
            if abs(v[i] - mv[j]) <= abs(v[taken[j]] - mv[j]):
                continue
        taken[min(n - 1, j)] = i
    for j, i in taken.items():
        mv[j] = v[i]
    spans = []
    for a, b, kind in t.spans:
        i, j = max(0, int(np.ceil((a - 0.5 - left) / px_per_sample))), min(n - 1, int(np.floor((b + 0.5 - left) / px_per_sample)))
        if i > j:
            continue
        if kind == "clipped":
            edges = t.y[((t.x >= a - 2) & (t.x < a)) | ((t.x > b) & (t.x <= b + 2))]
            if len(edges):
                mv[i : j + 1] = to_mv(min(frame[::-1], key=lambda f: np.abs(edges - f).min()))
        spans.append((i, j, kind))
    return mv, sorted(spans)


def trace(columns: list[np.ndarray], breaks: list[list[list[tuple[float, float]]]], ways: np.ndarray, anchors: np.ndarray, mask: np.ndarray, gray: np.ndarray, second_px: float) -> list[Trace]:
    """The curves of all leads. Columns are the frame's; a lead's gaps lie between the first and the last column with any lead's ink."""
    ink, own = Ink(mask, gray), split(columns, breaks, ways)
    n, m = len(columns), len(ways)
    begin, flat = np.append(0, np.cumsum([len(r) for r in columns])), np.concatenate([*columns, np.zeros((0, 2))])
    places = [np.flatnonzero(way >= 0) for way in ways]
    runs_of = [flat[begin[x] + way[x]] for x, way in zip(places, ways, strict=True)]
    for x, r, mine in zip(places, runs_of, own, strict=True):
        for c, part in mine.items():
            r[np.searchsorted(x, c)] = part
    claimed: list[dict[int, tuple[bool, bool]]] = [{} for _ in range(m)]
    shared = np.zeros((m, n), bool)
    for k in range(m - 1):
        both = (ways[k] >= 0) & (ways[k] == ways[k + 1]) & ~np.isin(np.arange(n), list(own[k]))
        if both.any():
            shared[k] |= both
            shared[k + 1] |= both
            runs = {j: dict(zip(places[j].tolist(), runs_of[j], strict=True)) for j in (k, k + 1)}
            for j, mine in enumerate(claims(runs, both, (k, k + 1))):
                claimed[k + j].update(mine)
    good = explained(columns, ways, anchors, ink)
    used = np.flatnonzero((ways >= 0).any(0))
    out = []
    for k in range(m):
        x, r = places[k].astype(float), runs_of[k]
        if not len(x):
            out.append(Trace(x, x, float(anchors[k]), [], 0.0, float(good[k]), 0.0, ["no_ink"]))
            continue
        pen = int(np.bincount((r[:, 1] - r[:, 0] + 1).astype(int)).argmax())  # with a fine pen a run of three already climbs, and one pixel more is no blot
        px, py = curve(x, r, ink, claimed[k], min(FLAT, pen + 1), min(APEX, pen))
        covered = ways[k][used[0] : used[-1] + 1] >= 0
        spans = []
        for a, b in stretches(~covered):
            a, b = a + used[0], b + used[0]
            ends = r[np.isin(places[k], (a - 1, b + 1))]
            clipped = bool((ends[:, 0] <= 0).any() or (ends[:, 1] >= len(mask) - 1).any())
            if clipped or b - a + 1 > JOINED:
                spans.append((int(a), int(b), "clipped" if clipped else "gap"))
        tall = np.zeros(n, bool)
        tall[places[k]] = shared[k][places[k]] & (r[:, 1] - r[:, 0] + 1 >= TALL)
        spans = sorted(spans + [(a, b, "ambiguous") for a, b in stretches(tall)])
        reasons, confidence = [], 1.0
        if (cover := float(covered.mean())) < COVERED:
            reasons.append("low_coverage")
            confidence *= cover
        if good[k] < EXPLAINED:
            reasons.append("ink_unexplained")
            confidence *= float(good[k])
        for kind in ("gap", "clipped", "ambiguous"):
            if share := sum(b - a + 1 for a, b, c in spans if c == kind) / len(covered):
                reasons.append(kind)
                confidence *= max(0.5, 1 - 3 * share)
        out.append(Trace(px, py, baseline(px, py, second_px), spans, cover, float(good[k]), confidence, reasons))
    return out
