"""From a gray sheet to six signals: frame, grid, ink, one path of runs a lead, samples."""

from __future__ import annotations

import numpy as np

from pulseframe.kernels import tracing

#: Sheet variants by name: height, frame (x0, y0, x1, y1), px a mm, first baseline and step (mm).
VARIANTS = {"A": (905, (45, 45, 1189, 814), 4.305, 20.0, 30.0), "B": (883, (47, 47, 1187, 789), 4.41, 18.4, 28.5)}
WIDTH, MM_S, MM_MV, HZ = 1280, 50.0, 10.0, 500.0
#: Gray limits of frame, grid and ink (core and edge), smallest ink component, gaps bridged in a run, path costs.
FRAME, FRAME_SHARE, GRID, CORE, EDGE, SMALL, BRIDGE = 200, 0.7, (180, 235), 130, 170, 6, 2
BASELINE, SKIP, REENTRY, SHARED, NESTED, NEST = 0.5, 1.5, 3.0, 0.1, 0.5, 3
#: Share of columns in which two neighbouring leads took the same run, from which they are traced together.
MEET = 0.01
#: Relative error up to which a height speaks for a variant.
TOLERANCE = 0.02
LEADS = ("I", "II", "III", "aVR", "aVL", "aVF")


def _stretches(on: np.ndarray) -> list[tuple[int, int]]:
    """Neighbouring true places as (first, last)."""
    e = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(e[::2], e[1::2], strict=True)]


def _runs(line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where neighbouring places begin in places that are listed line by line."""
    return np.flatnonzero(np.append(True, (np.diff(line) != 0) | (np.diff(at) != 1))) if len(line) else np.zeros(0, int)


def _sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of each column and of each row of small whole numbers: 32-bit floats hold them exactly up to 2**24."""
    v = x.astype(np.float32)
    return (np.ones(v.shape[0], np.float32) @ v).astype(float), (v @ np.ones(v.shape[1], np.float32)).astype(float)


def frame(img: np.ndarray) -> tuple[int, int, int, int] | None:
    """Inner rectangle of the outermost lines, if it takes up half the sheet at least in each direction."""
    out = []
    for on, size, across in zip(_sums(img < FRAME), img.shape[::-1], img.shape, strict=True):
        lines = _stretches(on / across >= FRAME_SHARE)
        if len(lines) < 2 or lines[-1][0] - lines[0][1] < size / 2:
            return None
        out.append((lines[0][1] + 2, lines[-1][0] - 2))
    (x0, x1), (y0, y1) = out
    return x0, y0, x1, y1


def period(profile: np.ndarray) -> float | None:
    """Spacing of a periodic profile: first peak of the autocorrelation, refined by a line through the origin over its multiples."""
    p = profile - profile.mean()
    n = min(140, len(p) // 3)
    if len(p) < 32 or not (p @ p) > 0:
        return None
    ac = np.array([p[: len(p) - k] @ p[k:] for k in range(n)]) / (p @ p)
    peaks = [k for k in range(3, n - 1) if ac[k] > 0.05 and ac[k] > ac[k - 1] and ac[k] >= ac[k + 1]]
    if not peaks:
        return None
    num = den = 0.0
    first = float(peaks[0])
    for k in peaks[:25]:
        a, b, c = ac[k - 1 : k + 2]
        at = k + float(np.clip(0.5 * (a - c) / (a - 2 * b + c), -0.5, 0.5)) if a - 2 * b + c else float(k)
        m = round(at / first)
        if m and abs(at / m - first) < 0.5:
            num, den = num + m * at, den + m * m
            first = num / den
    return first


def ink(img: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    """Pixels darker than EDGE that hang together (8 neighbours) with one darker than CORE, in components of SMALL pixels at least."""
    x0, y0, x1, y1 = box
    g = img[y0 : y1 + 1, x0 : x1 + 1]
    soft = g < EDGE
    row, column = tracing.pixels(soft)
    begin = _runs(row, column)
    n = np.diff(np.append(begin, len(row)))
    y, a = row[begin], column[begin]
    core = np.add.reduceat((g[row, column] < CORE).astype(int), begin) if len(begin) else begin
    of = tracing.components(len(y), *tracing.neighbours(y, a, a + n - 1))
    size, held = (np.bincount(of, v, len(y))[of] for v in (n, core))
    gone = np.repeat(~((held > 0) & (size >= SMALL)), n)
    soft[row[gone], column[gone]] = False
    return soft


def runs(column: np.ndarray) -> np.ndarray:
    """Vertical runs (top, bottom), bridging up to BRIDGE white pixels."""
    s = _stretches(column)
    out: list[list[int]] = []
    for a, b in s:
        if out and a - out[-1][1] - 1 <= BRIDGE:
            out[-1][1] = b
        else:
            out.append([a, b])
    return np.array(out, float).reshape(-1, 2)


def bridged(column: np.ndarray, found: np.ndarray) -> list[list[tuple[float, float]]]:
    """For each run of a column the white stretches inside it."""
    return [[(top + a, top + b) for a, b in _stretches(~column[int(top) : int(bottom) + 1])] for top, bottom in found.tolist()]


def column_runs(mask: np.ndarray) -> tuple[list[np.ndarray], list[list[list[tuple[float, float]]]]]:
    """runs and bridged of every column."""
    pixels = tracing.Ink(mask)
    first = _runs(pixels.x, pixels.y)
    at, top, bottom = pixels.x[first], pixels.y[first], pixels.y[np.append(first[1:], len(pixels.y))[: len(first)] - 1]
    gap = np.append(True, (at[1:] != at[:-1]) | (top[1:] - bottom[:-1] - 1 > BRIDGE)) if len(at) else np.zeros(0, bool)
    begin = np.flatnonzero(gap)
    found = np.stack([top[begin], bottom[np.append(begin[1:], len(at))[: len(begin)] - 1]], 1).astype(float)
    edges = np.searchsorted(at[begin], np.arange(mask.shape[1] + 1)).tolist()
    columns = [found[i:j] for i, j in zip(edges, edges[1:], strict=False)]
    breaks = [[[] for _ in range(j - i)] for i, j in zip(edges, edges[1:], strict=False)]
    first = np.searchsorted(at[begin], np.arange(mask.shape[1]))
    own = np.cumsum(gap) - 1
    i = np.flatnonzero(~gap)
    for column, run, white in zip(at[i].tolist(), (own[i] - first[at[i]]).tolist(), np.stack([bottom[i - 1] + 1, top[i] - 1], 1).astype(float).tolist(), strict=True):
        breaks[column][run].append(tuple(white))
    return columns, breaks


def paths(columns: list[np.ndarray], anchors: np.ndarray, step: float) -> np.ndarray:
    """For each anchor the cheapest way through the columns' runs, one run or none (-1) a column: distance to the anchor (steeper beyond one step), white
    gap to the last run, a price for skipping and for coming back. A skip remembers where it left."""
    return paths_together([(columns, anchors, step)])[0]


def paths_together(sheets: list[tuple[list[np.ndarray], np.ndarray, float]]) -> list[np.ndarray]:
    """paths of several sheets with as many columns and anchors: all anchors of all sheets go through a column together. Where a sheet has fewer runs than another, the others cost infinitely much."""
    count = np.array([[len(r) for r in columns] for columns, _, _ in sheets], int).reshape(len(sheets), -1).T
    anchors = np.array([a for _, a, _ in sheets], float).T
    (width, each), m = count.shape, len(anchors)
    most = count.max(1, initial=0).tolist()
    real = np.arange(max(most, default=0))[:, None] < count[:, None]  # column, run, sheet
    runs = np.zeros((*real.shape, 2))
    runs.transpose(2, 0, 1, 3)[real.transpose(2, 0, 1)] = np.concatenate([np.zeros((0, 2)), *(r for columns, _, _ in sheets for r in columns)])
    away = np.abs(runs.mean(3)[:, :, None] - anchors) / np.array([step for _, _, step in sheets])
    price = np.where(real[:, :, None], BASELINE * np.where(away <= 1, away, 1 + 3 * (away - 1)), np.inf)
    upper, lower = runs[..., 0].copy(), runs[..., 1].copy()
    sheet, every = np.arange(each), np.arange(m)[:, None]
    best = np.zeros((1, m, each))  # states: the last column's runs, then the skip
    last_top, last_bottom = np.zeros((2, 0, each))
    held_top = held_bottom = anchors
    choice = []
    for i, n in enumerate(most):
        top, bottom = upper[i, :n], lower[i, :n]
        before = len(last_top)
        come = np.empty((before + 1, n, m, each))
        gap = np.maximum(0, np.maximum(top - last_bottom[:, None], last_top[:, None] - bottom) - 1)
        np.add(best[:-1, None], gap[:, :, None], out=come[:-1])
        come[-1] = best[-1] + np.maximum(0, np.maximum(top[:, None] - held_bottom, held_top - bottom[:, None]) - 1) + (REENTRY if i else 0.0)
        leave = best.argmin(0)
        choice.append((come, leave))
        if before:
            run, of = leave < before, np.minimum(leave, before - 1)
            held_top, held_bottom = np.where(run, last_top[of, sheet], held_top), np.where(run, last_bottom[of, sheet], held_bottom)
        skipped, best = best, np.empty((n + 1, m, each))
        best[:n], best[n] = np.minimum.reduce(come, 0) + price[i, :n], np.minimum.reduce(skipped, 0) + SKIP
        last_top, last_bottom = top, bottom
    out, at = np.full((each, m, width), -1), best.argmin(0)
    for i in range(width - 1, -1, -1):
        (come, leave), run = choice[i], at < most[i]
        out[:, :, i] = np.where(run, at, -1).T
        at = np.where(run, come[:, np.minimum(at, most[i] - 1), every, sheet].argmin(0), leave) if most[i] else leave
    return list(out)


def path_pair(columns: list[np.ndarray], anchors: tuple[float, float], step: float) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest pair of ways through the columns' runs, for two leads whose curves meet: as paths, but a run may serve both at a small price, and skipping has no memory, so
    coming back costs half the distance to the anchor more.

    The least over pairs of states before is taken for one lead, then for the other, as their steps don't depend on each other."""
    best = np.zeros((1, 1))
    last = np.zeros((0, 2))
    steps = []
    for r in columns:
        mid = r.mean(1) if len(r) else np.zeros(0)
        gap = np.maximum(0, np.maximum(r[None, :, 0] - last[:, None, 1], last[:, None, 0] - r[None, :, 1]) - 1)
        inside = ((r[None, :, 0] - last[:, None, 0] >= NEST) & (last[:, None, 1] - r[None, :, 1] >= NEST)) | ((last[:, None, 0] - r[None, :, 0] >= NEST) & (r[None, :, 1] - last[:, None, 1] >= NEST))
        gap = np.where(inside, NESTED, gap)
        moves, unary = [], []
        for anchor in anchors:
            d = np.abs(mid - anchor) / step
            unary.append(np.append(BASELINE * np.where(d <= 1, d, 1 + 3 * (d - 1)), 0.0))
            move = np.full((len(last) + 1, len(r) + 1), SKIP)
            move[:-1, :-1] = gap
            move[-1, :-1] = REENTRY + 0.5 * np.abs(mid - anchor) if steps else 0.0
            moves.append(move)
        one = best[:, :, None] + moves[0][:, None, :]  # before of the first, of the second, now of the first
        from_first = one.argmin(0)
        half = one.min(0)
        two = half[:, :, None] + moves[1][:, None, :]
        from_second = two.argmin(0)
        best = two.min(0) + unary[0][:, None] + unary[1][None, :]
        k = np.arange(len(r))
        best[k, k] += SHARED
        steps.append((from_first, from_second))
        last = r
    out = np.full((2, len(columns)), -1)
    a, b = np.unravel_index(int(best.argmin()), best.shape)
    for i in range(len(columns) - 1, -1, -1):
        n = len(columns[i])
        out[:, i] = a if a < n else -1, b if b < n else -1
        from_first, from_second = steps[i]
        before_b = int(from_second[a, b])
        a, b = int(from_first[before_b, a]), before_b
    return out[0], out[1]


def vote(height: int, box: tuple[int, int, int, int] | None) -> tuple[str, bool]:
    """The variant that the heights of the sheet and of its frame speak for, each if it is within TOLERANCE, and whether they differ; without any vote the one nearest in height."""
    from pulseframe.kernels.layout import decide

    near = lambda x, of: min(VARIANTS, key=lambda v: abs(x - of(v)) / of(v))
    sizes = {"height": (height, lambda v: VARIANTS[v][0])}
    if box:
        sizes["frame"] = (box[3] - box[1], lambda v: VARIANTS[v][1][3] - VARIANTS[v][1][1])
    votes = {k: v for k, (x, of) in sizes.items() if abs(x - of(v := near(x, of))) <= TOLERANCE * of(v)}
    variant, _, ambiguous = decide(votes)
    return variant or near(height, sizes["height"][1]), ambiguous


def read(img: np.ndarray) -> dict:
    """What read_together has of one sheet; its failure is raised."""
    (r,) = read_together([img])
    if isinstance(r, Exception):
        raise r
    return r


def read_together(images: list[np.ndarray]) -> list[dict | Exception]:
    """Sheets, each on its own but for the ways through their runs, which are found together; a sheet that fails gives its failure. Of each
    frame, px_per_mm, variant, issues, confidence, leads: name to (mv, confidence); bad: name to stretches that are no signal (first and last sample, kind); traces; grid: its two axes (x, y); px_per_second, by the plus marks where there are some; and marks, their centres. A sheet without frame or grid falls back to the variant nearest in height."""
    out: list = [_tried(_ink_of, img) for img in images]
    for width in sorted({len(p["columns"]) for p in out if isinstance(p, dict)}):
        those = [i for i, p in enumerate(out) if isinstance(p, dict) and len(p["columns"]) == width]
        ways = _tried(paths_together, [(out[i]["columns"], out[i]["anchors"], out[i]["step"]) for i in those])
        for k, i in enumerate(those):
            out[i] |= {"ways": ways[k] if isinstance(ways, list) else _tried(paths, out[i]["columns"], out[i]["anchors"], out[i]["step"])}
    return [_tried(_curves_of, **p) if isinstance(p, dict) else p for p in out]


def _tried(f, *args, **named):
    """f's result, or how it failed; a lack of memory is raised."""
    try:
        return f(*args, **named)
    except MemoryError:
        raise
    except Exception as e:
        return e


def _ink_of(img: np.ndarray) -> dict:
    """A sheet's runs, and what its curves need besides."""
    from pulseframe.kernels import marks

    issues: list[str] = []
    box = frame(img)
    variant, ambiguous = vote(img.shape[0], box)
    _, default, px, first, step = VARIANTS[variant]
    if ambiguous:
        issues.append("variant_ambiguous")
    if box is None:
        issues.append("no_frame")
        box = default
    x0, y0, x1, y1 = box
    crop = img[y0 : y1 + 1, x0 : x1 + 1]
    grid = (crop >= GRID[0]) & (crop <= GRID[1])
    spacing = [period(v) for v in _sums(grid[: y1 - y0, : x1 - x0])]
    faint = np.where(grid, 255 - crop, np.uint8(0))
    lines = None
    if None in spacing or abs(spacing[0] / px - 1) > 0.02 or abs(spacing[1] / px - 1) > 0.02:
        issues.append("no_grid" if None in spacing else "grid_off_profile")
        spacing = [px, px]
    else:
        lines = tuple(marks.axis(v, px) for v, px in zip(_sums(faint), spacing, strict=True))
    mask = ink(img, box)
    second, places = marks.lattice(crop, *lines, CORE) if lines else (None, [])
    if second is None or abs(second / (MM_S * spacing[0]) - 1) > TOLERANCE:
        second, places = MM_S * spacing[0], []
    mask, found = marks.erase(mask, crop < CORE, places)
    columns, breaks = column_runs(mask)
    anchors = np.array([(first + step * i) * spacing[1] + default[1] - y0 for i in range(len(LEADS))])
    return {"issues": issues, "box": box, "variant": variant, "spacing": spacing, "lines": lines, "mask": mask, "crop": crop, "second": second, "found": found, "columns": columns, "breaks": breaks, "anchors": anchors, "step": step * spacing[1]}


def _curves_of(issues: list[str], box: tuple, variant: str, spacing: list[float], lines: tuple | None, mask: np.ndarray, crop: np.ndarray, second: float, found: list, columns: list, breaks: list, anchors: np.ndarray, step: float, ways: np.ndarray | Exception) -> dict:
    """What read_together has of a sheet, from the ways through its runs."""
    if isinstance(ways, Exception):
        raise ways
    for i in range(len(LEADS) - 1):
        if ((ways[i] >= 0) & (ways[i] == ways[i + 1])).mean() >= MEET:
            issues.append(f"leads_meet:{LEADS[i]}:{LEADS[i + 1]}")
            ways[i], ways[i + 1] = path_pair(columns, (anchors[i], anchors[i + 1]), step)
    traces = tracing.trace(columns, breaks, ways, anchors, mask, crop, second)
    ends = [(t.x[0], t.x[-1]) for t in traces if len(t.x)]
    left, right = (min(e[0] for e in ends), max(e[1] for e in ends)) if ends else (0.0, 0.0)  # all leads have one axis of time
    leads, bad = {}, {}
    for lead, t in zip(LEADS, traces, strict=True):
        if len(t.x) < 10:
            issues.append(f"lead_empty:{lead}")
            leads[lead], bad[lead] = (np.zeros(0), 0.0), []
            continue
        mv, bad[lead] = tracing.digitize(t, np.ceil(left), right, MM_S * spacing[0] / HZ, 1 / (MM_MV * spacing[1]), (0, len(mask) - 1))
        leads[lead] = (mv, t.confidence)
    confidence = float(np.mean([c for _, c in leads.values()])) * (0.5 if "no_frame" in issues else 1.0)
    return {"frame": box, "px_per_mm": tuple(spacing), "variant": variant, "issues": issues, "confidence": confidence, "leads": leads, "bad": bad, "traces": dict(zip(LEADS, traces, strict=True)), "grid": lines, "px_per_second": second, "marks": found}
