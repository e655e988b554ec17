"""Where the grid's lines lie, and the plus marks that count seconds taken out of the ink with the curves left whole."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from pulseframe.kernels import layout

#: Step of phases tried (px), how far a mark may lie off its place (px), pixels of a mark that must be ink, and darkness of a curve's own pixels.
FINE, OFF, COVERED, CORE = 0.25, 2, 8, 130
#: Lines of five millimetres count as drawn bolder if they stand out from the profile by this factor over the lines of one.
BOLDER = 1.15
#: The pixels of a mark around its centre (y, x).
PLUS = np.array([(0, x) for x in range(-layout.ARM, layout.ARM + 1)] + [(y, 0) for y in range(-layout.ARM, layout.ARM + 1) if y])


def phase(profile: np.ndarray, period: float) -> tuple[float, float]:
    """Where in a period a profile is greatest on average (sub-pixel), and by what factor over its mean."""
    tried = np.arange(0, period, FINE)
    whole = int((len(profile) - 1 - period) // period) + 1
    at = tried[:, None] + period * np.arange(max(1, whole))[None]
    means = np.interp(at, np.arange(len(profile)), profile).mean(1)
    k = int(means.argmax())
    # lines have a width: the centre of what stands out around the maximum is surer than the maximum itself
    near = np.arange(-round(1.5 / FINE), round(1.5 / FINE) + 1)
    weight = np.maximum(0, means[(k + near) % len(tried)] - (means[k] + means.mean()) / 2)
    shift = float((weight * near).sum() / weight.sum()) * FINE if weight.sum() > 0 else 0.0
    mean = float(profile.mean())
    return float((tried[k] + shift) % period), float(means[k] / mean) if mean > 0 else 0.0


@dataclass(frozen=True)
class Axis:
    """One direction of the grid: spacing of its millimetre lines, where the first one lies, where the first bold one (None if none are bolder), and how much they stand out."""

    px_mm: float
    first: float
    bold: float | None
    contrast: float


def axis(profile: np.ndarray, px_mm: float) -> Axis:
    first, contrast = phase(profile, px_mm)
    bold, bolder = phase(profile, 5 * px_mm)
    return Axis(px_mm, first, bold if bolder >= BOLDER * contrast else None, contrast)


def lattice(gray: np.ndarray, x: Axis, y: Axis, dark: int = CORE) -> tuple[float | None, list[tuple[float, float]]]:
    """Pixels a second and the places (x, y) where marks stand; nothing where the grid has no bold lines in both directions."""
    if x.bold is None or y.bold is None:
        return None, []
    second, columns, rows = layout.plus_lattice(gray, x.bold, y.bold, (x.px_mm + y.px_mm) / 2, dark)
    return second, [(c, r) for _, c in columns for r in rows] if second is not None else []


def hanging(ink: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The ink that hangs together with the seed (8 neighbours) inside a small window."""
    grown = seed
    while True:
        tall = grown.copy()
        tall[1:] |= grown[:-1]
        tall[:-1] |= grown[1:]
        wider = tall.copy()
        wider[:, 1:] |= tall[:, :-1]
        wider[:, :-1] |= tall[:, 1:]
        wider &= ink
        if np.array_equal(wider, grown):
            return grown
        grown = wider


def erase(mask: np.ndarray, core: np.ndarray, places: list[tuple[float, float]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The ink without the marks at these places, and the marks' centres (x, y) as found.

    A mark lies where most of its pixels are ink, up to OFF from its place, the nearest on ties; with fewer than COVERED it is none (a steep stroke, or nothing).
    One that hangs on nothing goes whole, with its soft edge. On a curve only the mark's own pixels go: an arm's line stays if ink goes on at both of its ends,
    and so does a pixel beside the curve's own dark pixels. mask: ink; core: its dark pixels."""
    arm, wide = layout.ARM, layout.ARM + OFF + 2
    ink = np.pad(mask, 2 * wide)
    own = np.pad(core & mask, 2 * wide)
    found = []
    tries = np.array(sorted((abs(i) + abs(j), i, j) for i in range(-OFF, OFF + 1) for j in range(-OFF, OFF + 1)))
    tried = tuple(tries[:, 1 + k, None] + PLUS[None, :, k] for k in (0, 1))
    for px, py in places:
        cx, cy = int(np.floor(px + 0.5)) + 2 * wide, int(np.floor(py + 0.5)) + 2 * wide
        if not (2 * wide <= cx < ink.shape[1] - 2 * wide and 2 * wide <= cy < ink.shape[0] - 2 * wide):
            continue
        held = ink[cy + tried[0], cx + tried[1]].sum(1)
        best = int(held.argmax())
        if held[best] < COVERED:
            continue
        cy, cx = cy + int(tries[best, 1]), cx + int(tries[best, 2])
        found.append((cx - 2 * wide, cy - 2 * wide))
        window = np.s_[cy - wide : cy + wide + 1, cx - wide : cx + wide + 1]
        seed = np.zeros((2 * wide + 1, 2 * wide + 1), bool)
        seed[wide + PLUS[:, 0], wide + PLUS[:, 1]] = True
        seed &= ink[window]
        all_of_it = hanging(ink[window], seed)
        if not (all_of_it[[0, -1]].any() or all_of_it[:, [0, -1]].any()):
            ink[window] &= ~all_of_it
            continue
        end = arm + 1
        along = {"down": all(ink[cy + s * end, cx - 1 : cx + 2].any() for s in (-1, 1)), "across": all(ink[cy - 1 : cy + 2, cx + s * end].any() for s in (-1, 1))}
        rest = own[window] & ~seed
        beside = np.pad(rest, 1)
        beside = beside[:-2, 1:-1] | beside[2:, 1:-1] | beside[1:-1, :-2] | beside[1:-1, 2:]
        stays = seed & beside
        stays[:, wide] |= seed[:, wide] & along["down"]
        stays[wide] |= seed[wide] & along["across"]
        ink[window] &= ~(seed & ~stays)
    return ink[2 * wide : -2 * wide, 2 * wide : -2 * wide], found
