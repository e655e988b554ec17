"""Zero-phase Butterworth filtering and detector features. Arrays are (leads, samples)."""

from __future__ import annotations

import math

import numpy as np

Section = tuple[float, float, float, float, float]  # b0, b1, b2, a1, a2


def butterworth(cut_hz: float, hz: float, order: int, high: bool) -> list[Section]:
    """Second-order sections of an even-order Butterworth filter by the bilinear transform. Sections that would not be stable, or a
    cut outside (0, hz / 2), give none."""
    if order < 2 or order % 2:
        raise ValueError("order must be even and 2 at least")
    if not 0 < cut_hz < hz / 2:
        return []
    k, out = math.tan(math.pi * cut_hz / hz), []
    for i in range(1, order // 2 + 1):
        q = 1 / (2 * math.sin((2 * i - 1) * math.pi / (2 * order)))
        norm = 1 / (1 + k / q + k * k)
        a1, a2 = 2 * (k * k - 1) * norm, (1 - k / q + k * k) * norm
        b0 = norm if high else k * k * norm
        out.append((b0, -2 * b0 if high else 2 * b0, b0, a1, a2))
        if not (abs(a2) < 1 and abs(a1) < 1 + a2):
            return []
    return out


#: Samples that a filter takes at once, and such blocks; what _steps gave for a section, kept by the worker.
BLOCK, GROUP = 32, 8
_known: dict[Section, tuple] = {}
#: A response under this share of its start is within the rounding of 64-bit sums, far under that of a 32-bit result.
GONE = 1e-16


def _steps(s: Section) -> tuple[np.ndarray, ...]:
    """What a section does to BLOCK samples and its two states: samples to samples, states to samples, samples to states; and to the states of GROUP blocks: what blocks add to the states
    before each, the states before the first to those before each, what blocks add to the states after the last, and states to states."""
    b0, b1, b2, a1, a2 = s
    a, b = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(BLOCK * GROUP):
        powers.append(a @ powers[-1])
    response = np.array([b0] + [(m @ b)[0] for m in powers[: BLOCK - 1]])
    i = np.arange(BLOCK)
    lag = i[:, None] - i[None, :]
    between = np.zeros((GROUP, 2, GROUP, 2))  # from block, its state, to block, its state
    for k in range(GROUP):
        for j in range(k + 1, GROUP):
            between[k, :, j] = powers[(j - 1 - k) * BLOCK].T
    on, off = ([powers[f(k) * BLOCK].T for k in range(GROUP)] for f in (lambda k: k, lambda k: GROUP - 1 - k))
    return (
        np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0).T.copy(), np.array([m[0] for m in powers[:BLOCK]]).T.copy(), np.array([powers[BLOCK - 1 - j] @ b for j in i]),
        between.reshape(2 * GROUP, 2 * GROUP), np.hstack(on), np.vstack(off), powers[BLOCK * GROUP].T,
    )


def _whole(n: int) -> int:
    """n samples as whole groups of blocks."""
    return -(-n // (BLOCK * GROUP)) * BLOCK * GROUP


def _forward(x: np.ndarray, s: Section) -> np.ndarray:
    """One section over all rows at once, from the steady state of the first sample. Blocks of samples are one matrix product, and so are the states of a group of blocks; only two states go from group to group."""
    b0, b1, b2, a1, a2 = s
    gain = (b0 + b1 + b2) / (1 + a1 + a2)
    z2 = (b2 - a2 * gain) * x[:, 0]
    z = np.stack([(b1 - a1 * gain) * x[:, 0] + z2, z2], 1)
    if s not in _known:
        if len(_known) > 64:
            _known.clear()
        _known[s] = _steps(s)
    through, seen, into, between, before, added, on = _known[s]
    rows, n = x.shape
    if n % (BLOCK * GROUP) or not x.flags.c_contiguous:
        whole = np.zeros((rows, _whole(n)))
        whole[:, :n] = x
        x = whole
    blocks = x.reshape(-1, BLOCK)
    gained = (blocks @ into).reshape(rows, -1, 2 * GROUP)
    states, gone = gained @ between, gained @ added
    for k in range(gained.shape[1]):
        states[:, k] += z @ before
        z = gone[:, k] + z @ on
    out = blocks @ through
    out += states.reshape(-1, 2) @ seen
    return out.reshape(rows, -1)[:, :n]


def _memory(sections: list[Section]) -> int:
    """Samples after which the slowest response of the sections is GONE."""
    radius = max(math.sqrt(a2) if a1 * a1 < 4 * a2 else (abs(a1) + math.sqrt(a1 * a1 - 4 * a2)) / 2 for _, _, _, a1, a2 in sections)
    return math.ceil(1.1 * math.log(GONE) / math.log(radius)) if 0 < radius < 1 else 0


def same(lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """Stretches of rows of one length: first, end, length."""
    e = np.flatnonzero(np.diff(lengths)) + 1
    return [(int(a), int(b), int(lengths[a])) for a, b in zip(np.append(0, e), np.append(e, len(lengths)), strict=True) if b > a]


def zero_phase(x: np.ndarray, sections: list[Section], lengths: np.ndarray | None = None) -> np.ndarray:
    """Filter forwards and backwards, with an odd reflection of n - 1 samples at each end (as many of them as the filter remembers); as 32-bit floats. lengths: how many samples of each row count, all if
    not given; what lies behind them in the result means nothing."""
    x = np.atleast_2d(np.asarray(x, float))
    rows, n = x.shape
    if n < 2 or not sections:
        return x.astype(np.float32)
    runs = [(0, rows, n)] if lengths is None else same(lengths)
    left = min(n - 1, max(1, _memory(sections)))
    ext = np.empty((rows, _whole(2 * left + n)))
    ends = []
    for a, b, m in runs:
        k = min(left, max(0, m - 1))  # a row goes on with its first and last value, from which filters start steady
        at, own = ext[a:b], x[a:b]
        if m:
            at[:, left : left + m] = own[:, :m]
            np.subtract(2 * own[:, :1], own[:, k:0:-1], out=at[:, left - k : left])
            np.subtract(2 * own[:, m - 1 : m], own[:, m - 2 :: -1][:, :k] if m > 1 else own[:, :0], out=at[:, left + m : left + m + k])
        else:
            at[:, left : left + 1] = 0.0
        at[:, : left - k] = at[:, left - k : left - k + 1]
        end = left + max(1, m) + k
        at[:, end:] = at[:, end - 1 : end]
        ends.append(end)
    for s in sections:
        ext = _forward(ext, s)
    for (a, b, _), end in zip(runs, ends, strict=True):
        ext[a:b, end:] = ext[a:b, end - 1 : end]
    ext = np.ascontiguousarray(ext[:, ::-1])
    for s in sections:
        ext = _forward(ext, s)
    out = ext[:, ::-1][:, left : left + n].astype(np.float32)
    for a, b, m in runs:
        if m < 2:
            out[a:b] = x[a:b]
    return out


def median(x: np.ndarray) -> float:
    """np.median of a line of values, without what that does for other shapes; NaN if there is one."""
    s = np.sort(x)
    n = len(s)
    return float("nan") if s[-1] != s[-1] else float(s[n // 2]) if n % 2 else float((s[n // 2 - 1] + s[n // 2]) / 2)


def medians(x: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For places first to last of rows of x, as far as they lie within its n samples, their median; NaN if there are none."""
    a, b = np.maximum(0, first), np.minimum(n - 1, last)
    size = np.maximum(0, b - a + 1)
    out = np.full(len(row), np.nan)
    for k in np.unique(size[size > 0]).tolist():
        i = np.flatnonzero(size == k)
        v = x.ravel()[(row[i] * x.shape[1] + a[i])[:, None] + np.arange(k)]
        if k <= 16:
            v.sort(1)
        else:
            v.partition([(k - 1) // 2, k // 2], 1)
        out[i] = v[:, k // 2] if k % 2 else (v[:, k // 2 - 1] + v[:, k // 2]) / 2
    return out


#: Band of the display filter and its order by species.
BANDS, DISPLAY_ORDER = {"dog": (0.5, 40.0), "cat": (0.5, 60.0)}, 4


def clean(x: np.ndarray, species: str, hz: float, lengths: np.ndarray | None = None) -> np.ndarray:
    low, high = BANDS[species]
    return zero_phase(zero_phase(x, butterworth(low, hz, DISPLAY_ORDER, True), lengths), butterworth(high, hz, DISPLAY_ORDER, False), lengths)


def skipped(species: str, hz: float) -> list[str]:
    """The stages of `clean` that can't be built at this sampling rate, and are left out there."""
    stages = zip(("highpass", "lowpass"), BANDS[species], (True, False), strict=True)
    return [f"filter_skipped:{name}" for name, cut, high in stages if not butterworth(cut, hz, DISPLAY_ORDER, high)]


def widened(spans: list[tuple[int, int, str]], n: int, species: str, hz: float) -> list[tuple[int, int, str]]:
    """Unreliable stretches after `clean`: clipped ones and gaps wider by the filter's length on both sides; those of a kind that touch are one."""
    pad = math.ceil(hz / BANDS[species][1])
    wide = sorted((i, j, kind) if kind == "ambiguous" else (max(0, i - pad), min(n - 1, j + pad), kind) for i, j, kind in spans)
    out: list[tuple[int, int, str]] = []
    for i, j, kind in wide:
        if out and out[-1][2] == kind and i <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], j), kind)
        else:
            out.append((i, j, kind))
    return out


def moving_average(x: np.ndarray, width: int) -> np.ndarray:
    """Centred sum of `width` samples (zeros beyond the ends) over width."""
    h, n = width // 2, x.shape[1]
    s = np.zeros((len(x), n + 2 * h + 1))
    np.cumsum(x, 1, out=s[:, h + 1 : h + 1 + n])
    s[:, h + 1 + n :] = s[:, h + n : h + n + 1]
    out = s[:, width:] - s[:, :-width]
    out /= width
    return out


def energy(x: np.ndarray, band: tuple[float, float], window_ms: float, hz: float, lengths: np.ndarray | None = None) -> np.ndarray:
    """Band-pass, five-point derivative, square, moving average; lengths as zero_phase's."""
    y = zero_phase(zero_phase(x, butterworth(band[0], hz, 2, True), lengths), butterworth(band[1], hz, 2, False), lengths)
    n = y.shape[1]
    p = np.empty((len(y), n + 4))
    p[:, 2 : n + 2] = y
    p[:, :2] = p[:, 2:3]
    for a, b, m in [(0, len(y), n)] if lengths is None else same(lengths):
        p[a:b, m + 2 :] = p[a:b, m + 1 : m + 2]
    d = 2 * p[:, 3:-1]
    d += p[:, 4:]
    d -= 2 * p[:, 1:-3]
    d -= p[:, :-4]
    d /= 8
    d *= d
    for a, b, m in [] if lengths is None else same(lengths):
        d[a:b, m:] = 0.0
    return moving_average(d, max(3, round(window_ms * hz / 1000) | 1))
