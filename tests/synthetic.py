"""Synthetic signals with known marks: half-sine P, straight-limbed QRS, skewed T."""

from __future__ import annotations

import numpy as np

from pulseframe.kernels import dsp

#: Beat shapes (mV, ms) and rates by species; scale of each lead.
SHAPES = {
    "dog": {"p": 0.25, "q": 0.2, "r": 1.5, "s": 0.4, "t": 0.35, "p_ms": 40, "pq_ms": 100, "qrs_ms": 56, "qt_ms": 200, "t_ms": 100, "bpm": 120},
    "cat": {"p": 0.1, "q": 0.1, "r": 0.6, "s": 0.25, "t": 0.15, "p_ms": 30, "pq_ms": 60, "qrs_ms": 40, "qt_ms": 140, "t_ms": 70, "bpm": 200},
}
LEADS = {"I": 0.6, "II": 1.0, "III": 0.7, "aVR": -0.8, "aVL": 0.3, "aVF": 0.85}


def signal(species: str, rr_ms: list[float] | None = None, duration_ms: float = 5000, first_ms: float = 400, noise: float = 0.003, seed: int = 1, hz: float = 500.0, **shape) -> tuple[np.ndarray, list[dict]]:
    """Lead II and for each beat its marks (ms)."""
    s = SHAPES[species] | shape
    n = int(duration_ms * hz / 1000)
    t, y, truth = np.arange(n) * 1000 / hz, np.zeros(n), []
    q_on, k = first_ms, 0
    while q_on + s["qt_ms"] < duration_ms:
        p_on, w = q_on - s["pq_ms"], s["qrs_ms"]
        u = (t - p_on) / s["p_ms"]
        y += np.where((u > 0) & (u < 1), s["p"] * np.sin(np.pi * np.clip(u, 0, 1)), 0)
        u = (t - q_on) / w
        y += np.interp(u, [0, 0.1, 0.2, 0.8, 0.9, 1], [0, -s["q"], 0, 0, -s["s"], 0]) + np.where((u > 0.2) & (u < 0.8), s["r"] * np.sin(np.pi * np.clip((u - 0.2) / 0.6, 0, 1)), 0)
        on = q_on + s["qt_ms"] - s["t_ms"]
        u = (t - on) / s["t_ms"]
        y += s["t"] * np.where((u > 0) & (u <= 0.6), (1 - np.cos(np.pi * np.clip(u / 0.6, 0, 1))) / 2, np.where((u > 0.6) & (u < 1), (1 - u) / 0.4, 0))
        truth.append({"p_on": p_on, "p_off": p_on + s["p_ms"], "q_on": q_on, "r": q_on + w / 2, "s_off": q_on + w, "t_off": q_on + s["qt_ms"]})
        q_on += rr_ms[k % len(rr_ms)] if rr_ms else 60_000 / s["bpm"]
        k += 1
    return y + np.random.default_rng(seed).normal(0, noise, n), truth


def six(species: str, scales: dict[str, float] | None = None, noise: float = 0.003, seed: int = 1, smooth_hz: float = 35.0, hz: float = 500.0, **spec) -> tuple[dict[str, np.ndarray], list[dict]]:
    """Six leads of one rhythm and lead II's marks, each smoothed as a device prints it. A negative scale turns R into a deep S."""
    out, truth = {}, []
    for k, (lead, scale) in enumerate((LEADS | (scales or {})).items()):
        s = SHAPES[species] | {k: v for k, v in spec.items() if k in SHAPES[species]}
        m = abs(scale)
        turned = {"p": s["p"] * m, "q": s["q"] * m, "r": s["r"] * m, "s": s["s"] * m, "t": s["t"] * m} if scale > 0 else {"p": s["p"] * m, "q": 0.0, "r": s["s"] * m, "s": s["r"] * m, "t": -s["t"] * m}
        y, marks = signal(species, noise=0.0, **(spec | turned))
        y = dsp.zero_phase(y, dsp.butterworth(smooth_hz, hz, 2, False))[0].astype(float) if smooth_hz else y
        out[lead] = y + np.random.default_rng(seed + k).normal(0, noise, len(y))
        truth = marks if lead == "II" else truth
    return out, truth


def leads(ii: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v * ii for k, v in LEADS.items()}
