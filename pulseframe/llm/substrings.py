"""Passages that repeat across documents, by content-defined chunking with a gear rolling hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulseframe.llm.common import cut, small_batches
from pulseframe.llm.text import BASE, codes, mix

#: Mean characters of a chunk, the rolling hash's window, and the least distance to the mark before.
MEAN, WINDOW, APART = 16, 8, 4
#: Rounds that digests are compared in, so that a part of the chunks lies on disk at a time.
PARTS = 4
#: A run of repeated chunks is reported from this many words: about half of a passage of 51, as the chunks at its two edges are lost; or, for scripts
#: without white space, from this many characters.
LEAST, LONG = 26, 400


def cuts(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where chunks end, for texts that start at `at`: every text's end, and each place after which the hash of the last WINDOW
    characters is small, if that is not so for any of the APART - 1 places before.

    The hash doubles and adds a random value a character (gear hash), in 16 bits, over the last WINDOW
    characters. A cut depends on the characters just before it alone: texts that share a passage share its inner cuts wherever the
    passage stands, and insertions move none but those next to them."""
    h = (mix(cp.astype(np.uint64) + BASE) >> np.uint64(48)).astype(np.uint16)
    for s in (1, 2, 4):  # the hash of the last 2 s characters from two of s
        h[s:] = h[s:] + (h[:-s] << np.uint16(s))
    low = h < np.uint16(65536 // MEAN)
    fresh = np.zeros(len(cp) + WINDOW, bool)
    for i in range(WINDOW - 1):  # the window must lie in the text
        fresh[at[:-1] + i] = True
    low &= ~fresh[: len(cp)]
    marks = np.flatnonzero(low)
    marks = marks[np.diff(marks, prepend=-APART) >= APART] + 1
    return np.union1d(marks, at[1:][np.diff(at) > 0])


def chunks(df: DataFrame, text: str = "text", doc_id: str = "doc_id", part: int | None = None) -> DataFrame:
    """One row a chunk, of all or of the part of PARTS that its length and three of its characters put it in (equal chunks in the same): digest (two numbers), doc_id, start, length, words (that begin in it)."""
    small_batches(df.sparkSession)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for b in batches:
            cp, at = codes(b.column(1).to_pylist())
            ends = cuts(cp, at)
            starts = np.append(0, ends[:-1])[: len(ends)]
            if part is not None:  # by length, first, middle and last character, so that only this part's chunks are hashed
                look = (cp[i].astype(np.uint64) << np.uint64(21 * k) for k, i in enumerate((starts, (starts + ends) // 2, ends - 1)))
                mine = mix(sum(look, (ends - starts).astype(np.uint64) * BASE)) % np.uint64(PARTS) == part
                starts, ends = starts[mine], ends[mine]
            raw = memoryview(cp.tobytes())
            d = np.frombuffer(b"".join([digest(raw[i:j]) for i, j in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)]), ">i8").astype(np.int64).reshape(-1, 2)
            own = np.searchsorted(at, starts, "right") - 1
            inside = (cp != 32) & ((cp < 9) | (cp > 13))
            begins = inside & ~np.append(False, inside[:-1])[: len(cp)]
            begins[at[:-1][np.diff(at) > 0]] = inside[at[:-1][np.diff(at) > 0]]
            so_far = np.append(0, np.cumsum(begins))
            words = (so_far[ends] - so_far[starts]).astype(np.int32)
            ids = b.column(0).to_numpy()[own]
            yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array((d[:, 1] >> 32).astype(np.int32)), pa.array(ids, pa.int64()), pa.array((starts - at[own]).astype(np.int32)), pa.array((ends - starts).astype(np.int32)), pa.array(words)], ["hi", "lo", "doc_id", "start", "length", "words"])

    d = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text <> ''")
    return d.mapInArrow(split, "hi long, lo int, doc_id long, start int, length int, words int")


def repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, long: int = LONG) -> DataFrame:
    """One row for each stretch of a document that repeats in another: doc_id, span_start, span_end (code points, end exclusive), n_chunks,
    n_words, first_doc_id and removed_chars. Documents that repeat nothing have no row.

    A stretch is a run of neighbouring chunks whose digests (96 bits) occur in two documents at least; it is reported from `least`
    words that begin in it, or `long` characters.
    first_doc_id is the smallest document with one of its chunks; removed_chars are the characters of chunks that a document with a
    smaller doc_id holds as well, which deduplication takes out. Rows with the same doc_id are one document, a repeat within one document
    doesn't count. Null and empty texts have no chunks, and rows without a doc_id can't be named, so neither is reported. An empty table
    gives no rows. Only the two named columns are read.

    A digest meets its copies by aggregation (one entry a map task), and its occurrences by a join whose hot keys can be split.
    """
    parts = []
    for part in range(PARTS):
        c = chunks(df, text, doc_id, part)
        shared = c.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
        # the chunks are made twice: cheaper than storing them
        met = chunks(df, text, doc_id, part).join(shared, ["hi", "lo"]).select("doc_id", "start", "length", "words", "first")
        parts.append(cut(met, "found"))
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    found = found.groupBy("doc_id", "start", "length").agg(F.min("first").alias("first"), F.max("words").alias("words"))
    w = W.partitionBy("doc_id").orderBy("start")
    found = found.withColumn("_new", (F.coalesce(F.lag(F.col("start") + F.col("length")).over(w), F.lit(-1)) != F.col("start")).cast("int"))
    found = found.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = found.groupBy("doc_id", "_run").agg(
        F.min("start").cast("long").alias("span_start"),
        F.max(F.col("start") + F.col("length")).cast("long").alias("span_end"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum("words").alias("n_words"),
        F.min("first").alias("first_doc_id"),
        F.sum(F.when(F.col("first") < F.col("doc_id"), F.col("length")).otherwise(0)).cast("long").alias("removed_chars"),
    )
    return runs.filter((F.col("n_words") >= least) | (F.col("span_end") - F.col("span_start") >= long)).drop("_run")
