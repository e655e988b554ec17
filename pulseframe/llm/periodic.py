"""Stretches of words that repeat with a period, by bit-parallel comparison of a text's words with themselves some words on."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import small_batches

#: A run has at least so many words, and at least so many times its period.
LEAST, TIMES = 24, 3


def word_ids(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for the same word."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def lags(ids: np.ndarray, times: int = TIMES) -> list[int]:
    """All lags that can be the smallest period of a run; few others.

    Within a run of smallest period q and length >= 3 q, a sequence of K words (q <= K < 2 q) comes back after q words and not before: else the run had a smaller
    period. So each q in (K / 2, K] is the distance of two neighbouring places of one such sequence. K doubles; sequences of 2 K words are numbered
    by the pairs of their halves, so the numbers are exact. It ends where no sequence occurs twice."""
    n, k, out = len(ids), 1, set()
    key = ids
    while len(key) and times * (k // 2 + 1) <= n:
        order = np.argsort(key, kind="stable")
        same = np.diff(key[order]) == 0
        if not same.any():
            break
        apart = np.diff(order)[same]
        out.update(np.unique(apart[(2 * apart > k) & (apart <= k)]).tolist())
        rank = np.empty(len(key), np.int64)
        rank[order] = np.append(0, np.cumsum(~same))
        key = rank[: max(0, len(rank) - k)] * (len(rank) + 1) + rank[k:]
        k *= 2
    return sorted(q for q in out if times * q <= n)


def planes(ids: np.ndarray) -> list[int]:
    """One big integer a bit of the word numbers: bit i belongs to word i."""
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(int(ids.max(initial=0)).bit_length())]


def ones(x: int, n: int) -> np.ndarray:
    """Places of the bits that are set."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little"))


def runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period.

    For a lag q, planes XOR planes shifted by q, joined by OR, have a bit wherever word i differs from word i + q. AND of the complement with itself, shifted by
    1, 2, 4, ... keeps the places from which enough words agree. A stretch found at a smaller lag as well has that smaller period: lags rise."""
    n, found = len(ids), {}
    if n < least:
        return []
    p = None
    for q in lags(ids, times):
        need = max(least, times * q) - q
        if need + q > n:
            continue
        p = planes(ids) if p is None else p
        differ = 0
        for x in p:
            differ |= x ^ (x >> q)
        agree, have = ~differ & ((1 << (n - q)) - 1), 1
        while have < need and agree:
            step = min(have, need - have)
            agree &= agree >> step
            have += step
        if agree:
            for i, j in zip(ones(agree & ~(agree << 1), n).tolist(), ones(agree & ~(agree >> 1), n).tolist(), strict=True):
                found.setdefault((i, j - i + need + q), q)
    return sorted((start, length, q) for (start, length), q in found.items())


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that stay, joined by one space: of each run, its first period."""
    keep = np.ones(len(words), bool)
    for start, length, q in found:
        keep[start + q : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()]) if found else b" ".join(words)


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period (exact); ties by start, then period."""
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None


def periodic_runs(df: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row for each row of df: doc_id, n_words, runs (array of start, length, period), strongest (one of them, null without runs) and collapsed (text).

    Words are runs of characters other than white space ([\\x20\\x09-\\x0D]), counted from 0. A run is a stretch of words with smallest period q and at
    least max(least, times * q) words (times: 3 or more) that can't be extended. Runs may overlap. Whole texts are read, at every length. A null or
    empty text has no words, no runs and an empty collapsed text. Repeated rows each give a row; doc_id may be null. Only the two columns are read.
    """
    if times < 3:
        raise ValueError("times must be 3 at least: candidate lags are complete from there")
    small_batches(df.sparkSession)
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    as_row = lambda r: None if r is None else dict(zip(("start", "length", "period"), r, strict=True))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, all_runs, best, left = [], [], [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                words = (t or b"").split()  # of bytes: exactly the white space above
                found = runs(word_ids(words), least, times)
                counts.append(len(words))
                all_runs.append([as_row(r) for r in found])
                best.append(as_row(strongest(found)))
                left.append(collapsed(words, found))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(all_runs, pa.list_(run)), pa.array(best, run), pa.array(left, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "strongest", "collapsed"])

    one = "struct<start:long,length:long,period:long>"
    d = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(work, f"doc_id long, n_words long, runs array<{one}>, strongest {one}, collapsed string")


def with_cycles(df: DataFrame) -> DataFrame:
    """doc_id and text, where of about a tenth of the documents (crc32 of doc_id divisible by 10) the words from one place on repeat with a period, as
    op13's contract describes; all other texts are as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words, g = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1), F.floor(h / 10)
    d = df.select("doc_id", "text", g.alias("_g"), F.when(h % 10 == 0, words).alias("_w")).withColumn("_n", F.size("_w"))
    d = d.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    d = d.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    cycle = F.transform(F.sequence("_a", F.col("_n") - 1), lambda i: F.get("_w", F.col("_a") + (i - F.col("_a")) % F.col("_p")))
    new = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), cycle), " ")
    return d.select("doc_id", F.when(F.col("_a").isNotNull(), new).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """op13's columns from periodic_runs'."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    s = [F.col(f"strongest.{c}").alias(c) for c in ("start", "length", "period")]
    listed = F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    milli = F.expr("strongest.length * 1000 DIV strongest.period")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *s, milli.alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
