"""Beats of a page against the rates printed above them."""

from __future__ import annotations

import numpy as np

from pulseframe.kernels.detect import Beat

#: How far (px) a number may stand from the middle of its interval, also as a share of it; tolerance of the rate, and of the interval in columns.
AWAY_PX, AWAY_SHARE, RATE_BPM, COLUMNS = 12.0, 0.3, 3.0, 2
#: Factors of confidence of beats beside a number that differs, and of beats that no number confirms.
MISMATCH, UNVERIFIED = 0.7, 0.9


def verdicts(t_ms: np.ndarray, rates: list[tuple[float, float]], left_px: float, px_per_ms: float) -> tuple[np.ndarray, list[tuple[int, float, float]], list[int]]:
    """For each interval between neighbouring beats 1 (a number confirms it), -1 (one differs) or 0; the numbers that differ (place, printed, measured); those without an interval.

    rates: (x, beats a minute). A number belongs to the interval with the nearest middle, if that is near enough: an interval short by a
    missed beat keeps its number away. The tolerance of the rate grows with what two columns of the sheet mean at that interval."""
    rr = np.diff(t_ms)
    out, differ, alone = np.zeros(len(rr), int), [], []
    if not len(rr) or not px_per_ms > 0:
        return out, differ, list(range(len(rates)))
    middle, width = left_px + (t_ms[:-1] + t_ms[1:]) / 2 * px_per_ms, rr * px_per_ms
    with np.errstate(divide="ignore"):
        bpm = np.where(rr > 0, 60_000 / rr, np.inf)
        slack = np.maximum(RATE_BPM, COLUMNS * np.where(rr > 0, 60_000 / px_per_ms / rr**2, np.inf))
    for k, (x, printed) in enumerate(rates):
        i = int(np.abs(middle - x).argmin())
        if abs(middle[i] - x) > min(AWAY_PX, AWAY_SHARE * width[i]):
            alone.append(k)
            continue
        measured = float(np.floor(bpm[i] * 10 + 0.5) / 10) if np.isfinite(bpm[i]) else float("inf")
        if abs(measured - printed) <= slack[i]:
            out[i] = out[i] or 1
        else:
            out[i] = -1
            differ.append((k, printed, measured))
    return out, differ, alone


def check(beats: list[Beat], rates: list[tuple[float, float]], left_px: float, px_per_ms: float) -> tuple[list[tuple[int, float, float]], list[int]]:
    """Lower the confidence of beats, in order of time, beside an interval whose number differs, or beside none that a number confirms; both get a reason."""
    v, differ, alone = verdicts(np.array([b.t_ms for b in beats]), rates, left_px, px_per_ms)
    around = np.stack([np.append(0, v), np.append(v, 0)]) if len(beats) else np.zeros((2, 0), int)
    for b, bad, good in zip(beats, (around < 0).any(0), (around > 0).any(0), strict=True):
        if bad:
            b.reasons.append("printed_hr_mismatch")
            b.confidence *= MISMATCH
        elif rates and not good:
            b.reasons.append("printed_hr_unverified")
            b.confidence *= UNVERIFIED
    return differ, alone
