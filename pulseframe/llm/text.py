"""Batches of texts as arrays: code points, words and hashes, without a Python step a character."""

from __future__ import annotations

import sys
import types

import numpy as np

#: Odd 64-bit multipliers (fractional parts of square roots and of the golden ratio).
MIX_A, MIX_B, BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def remembered(name: str, make):
    """make(), once a worker process."""
    kept = sys.modules.setdefault("_pulseframe_kept", types.ModuleType("_pulseframe_kept")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finishing steps of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return remembered("letters", lambda: np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), bool, 0x110000))


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and where each text starts (with the end as last entry)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), at


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 to n - 1, modulo 2**64."""
    p = remembered("powers", lambda: np.ones(1, np.uint64))
    if len(p) < n:
        p = np.full(2 * n, BASE, np.uint64)
        p[0] = 1
        p = np.cumprod(p, dtype=np.uint64)
        sys.modules["_pulseframe_kept"].__dict__["powers"] = p
    return p[:n]


def word_hashes(units: np.ndarray, inside: np.ndarray, starts: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Words are the runs where `inside` is true, and end where a text starts. Gives each word's first place and 64-bit hash; for
    each entry of prefixes, also the hash of the word's first so many units, or of all if it has no more."""
    n = len(units)
    if not n:
        return (np.zeros(0, np.int64), *(np.zeros(0, np.uint64) for _ in range(len(prefixes) + 1)))
    fresh = np.zeros(n + 1, bool)
    fresh[starts] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = np.flatnonzero(inside & (~before | fresh[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    # hash of a word: sum of its units' mixed values times powers of its places from the left
    length = last - first
    place = np.arange(n, dtype=np.int64)
    owner = np.repeat(np.arange(len(first)), length)
    where = np.flatnonzero(inside)
    value = mix(units[where].astype(np.uint64) + BASE) * powers(int(length.max(initial=0)))[place[where] - first[owner]]
    sums = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value, out=sums[1:])
    at = np.zeros(len(first) + 1, np.int64)
    np.cumsum(length, out=at[1:])
    short = [np.minimum(length, k) for k in prefixes]
    return first, mix(sums[at[1:]] - sums[at[:-1]] + length.astype(np.uint64)), *(mix(sums[at[:-1] + k] - sums[at[:-1]] + k.astype(np.uint64)) for k in short)
