"""Evidence on a sheet: digit rows, binary crops and their distance, crosses that mark seconds, votes for a variant."""

from __future__ import annotations

import numpy as np

from pulseframe.kernels.sheet import CORE
from pulseframe.operators.pages import ROW_ABOVE, ROW_GLYPHS, ROW_INK, VOTES

#: Distance up to which headers match and crops are of one animal, shift of crops (px), ink of headers and of name crops.
ALIKE, SHIFT, HEADER_INK, NAME_INK = 0.3, 2, 170, 128
#: A plus mark's arms and dark share, places off a five-millimetre line (share), least hits (share of rows, and number).
ARM, ARM_SHARE, OFF_LINE, HITS, LEAST_HITS = 2, 3, 0.15, 0.25, 4


def cut_out(img: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    """A rectangle of the sheet, white beyond its edges."""
    out = np.full((max(0, h), max(0, w)), 255, np.uint8)
    x0, y0, x1, y1 = max(0, x), max(0, y), min(img.shape[1], x + w), min(img.shape[0], y + h)
    if x1 > x0 and y1 > y0:
        out[y0 - y : y1 - y, x0 - x : x1 - x] = img[y0:y1, x0:x1]
    return out


def row_evidence(img: np.ndarray, x: int, y: int, w: int, h: int, dark: int = CORE) -> tuple[int, int, int]:
    """Dark pixels of a band, columns where ink begins, dark pixels in the three rows above."""
    band = cut_out(img, x, y, w, h) < dark
    ink = band.any(0)
    return int(band.sum()), int((ink & ~np.append(False, ink[:-1])).sum()), int((cut_out(img, x, y - 3, w, 3) < dark).sum())


def has_digit_row(img: np.ndarray, x: int, y: int, w: int, h: int) -> bool:
    """Whether the zone's glyph rows (without three above and two below) hold digits."""
    dark, glyphs, above = row_evidence(img, x, y + 3, w, h - 5)
    return dark >= ROW_INK and glyphs >= ROW_GLYPHS and above <= ROW_ABOVE * dark


def distance(a: np.ndarray, b: np.ndarray, shift: int = 0, offset: tuple[int, int] = (0, 0)) -> float:
    """Jaccard distance of two binary crops, the least over shifts of b by up to `shift` pixels; offset is where b lies against a (x, y). 0 if both are empty, 1 if one is."""
    na, nb = int(a.sum()), int(b.sum())
    if not na or not nb:
        return float(na != nb)
    pad = shift + 1
    height, width = (max(a.shape[i], b.shape[i] + abs(offset[1 - i])) + 2 * pad for i in (0, 1))
    ox, oy = max(0, -offset[0]), max(0, -offset[1])
    base = np.zeros((height, width), bool)
    base[pad + oy : pad + oy + a.shape[0], pad + ox : pad + ox + a.shape[1]] = a
    best = 1.0
    for dy in range(-shift, shift + 1):
        for dx in range(-shift, shift + 1):
            y, x = pad + oy + offset[1] + dy, pad + ox + offset[0] + dx
            both = int((base[y : y + b.shape[0], x : x + b.shape[1]] & b.astype(bool)[: height - y, : width - x]).sum())
            best = min(best, 1 - both / (na + nb - both))
    return best


def crosses(gray: np.ndarray, dark: int) -> np.ndarray:
    """Where a plus mark's centre may be: three of five pixels at least are dark both across and down."""
    d = (gray < dark).astype(np.int32)
    p = np.pad(d, ARM)
    h, w = d.shape
    across = sum(p[ARM : ARM + h, k : k + w] for k in range(2 * ARM + 1))
    down = sum(p[k : k + h, ARM : ARM + w] for k in range(2 * ARM + 1))
    return (across >= ARM_SHARE) & (down >= ARM_SHARE) & (d > 0)


def plus_lattice(gray: np.ndarray, phase_x: float, phase_y: float, px_mm: float, dark: int = CORE) -> tuple[float | None, list[tuple[int, float]], list[int]]:
    """Pixels a second, the columns (number of the five-millimetre line, x) and the rows (y) of plus marks, which stand on every tenth line, in every other five-millimetre row.

    Both parities of rows are tried and the better one counts; of the lines' residues modulo ten, the one with the most hits; the second is the slope of x over them."""
    step = 5 * px_mm
    rows = phase_y + np.arange(int((gray.shape[0] - phase_y) / step) + 1) * step
    hit = crosses(gray, dark)
    near = np.zeros_like(hit)
    for k in (-1, 0, 1):  # one row off counts
        near |= np.roll(hit, k, 0)
    best: list[tuple[int, float, int]] = []
    stand: list[int] = []
    for parity in (0, 1):
        ys = np.round(rows[parity::2]).astype(int)
        ys = ys[(ys >= ARM) & (ys < gray.shape[0] - ARM)]
        score = near[ys].sum(0)
        least = max(LEAST_HITS, int(np.ceil(HITS * len(ys))))
        found = []
        for x in np.flatnonzero(score >= least):
            around = score[max(0, x - 2) : x + 3]
            line = (x - phase_x) / step
            if score[x] == around.max() and (x == 0 or score[x] > score[x - 1]) and abs(line - round(line)) <= OFF_LINE:
                w = 255.0 - gray[np.ix_(ys, range(max(0, x - ARM), min(gray.shape[1], x + ARM + 1)))].astype(float)
                found.append((round(line), float((w.sum(0) * np.arange(max(0, x - ARM), max(0, x - ARM) + w.shape[1])).sum() / max(1e-9, w.sum())), int(score[x])))
        if sum(f[2] for f in found) > sum(f[2] for f in best):
            best, stand = found, ys.tolist()
    if not best:
        return None, [], []
    weight = np.bincount([f[0] % 10 for f in best], [f[2] for f in best], 10)
    chosen = [(n, x) for n, x, _ in best if n % 10 == int(weight.argmax())]
    if len(chosen) < 2:
        return None, chosen, stand
    k, x = np.array([n // 10 for n, _ in chosen], float), np.array([x for _, x in chosen])
    return float(((k - k.mean()) * (x - x.mean())).sum() / ((k - k.mean()) ** 2).sum()), chosen, stand


def plus_marks(gray: np.ndarray, phase_x: float, phase_y: float, px_mm: float, dark: int = CORE) -> tuple[float | None, list[tuple[int, float]]]:
    """Pixels a second and the columns of plus marks."""
    return plus_lattice(gray, phase_x, phase_y, px_mm, dark)[:2]


def decide(votes: dict[str, str]) -> tuple[str | None, float, bool]:
    """The variant with the greatest weight of votes (the first by name on ties), its share, and whether others have votes."""
    weight: dict[str, float] = {}
    for name, variant in votes.items():
        weight[variant] = weight.get(variant, 0.0) + VOTES[name]
    if not weight:
        return None, 0.0, False
    top = min(weight, key=lambda v: (-weight[v], v))
    return top, weight[top] / sum(weight.values()), len(weight) > 1
