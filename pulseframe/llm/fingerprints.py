"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import small_batches, tasks
from pulseframe.llm.text import BASE, codes, mix, remembered, word_hashes

#: Samples in a fingerprint; each is kept as 16 bits, four hexadecimal digits.
SLOTS = 64
#: Texts that are sampled at once, and their characters: fewer texts if they are long, one at least.
CHUNK, CHUNK_CHARS = 96, 1_000_000
#: Terms whose samples are drawn at once, terms of texts that are looked at in one go, and terms whose samples a worker remembers (32 MB).
TERMS, BLOCK, KNOWN = 512, 16_384, 1 << 16


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted terms of all texts: text number, term hash, weight, by text.

    A term is a word (a run without white space, lower case); it weighs its count times its length, as short words say little.
    A text without words has one term of its own kind."""
    cp, at = codes([t.lower() for t in texts])
    inside = (cp != 32) & ((cp < 9) | (cp > 13))
    first, h = word_hashes(cp, inside, at)
    step = np.flatnonzero(np.diff(np.append(inside, False).astype(np.int8)) == -1) + 1
    # a word ends at the next white space or where its text ends
    owner = np.searchsorted(at, first, "right") - 1
    ends = np.minimum(step[np.searchsorted(step, first, "right")] if len(first) else first, at[owner + 1])
    order = np.lexsort((h, owner))
    owner, h, length = owner[order], h[order], (ends - first)[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    lead = np.flatnonzero(new)
    count = np.diff(np.append(lead, len(h)))
    owner, h, weight = owner[lead], h[lead], count * length[lead].astype(np.float64)
    none = np.setdiff1d(np.arange(len(texts)), owner)
    owner, h, weight = np.append(owner, none), np.append(h, np.zeros(len(none), np.uint64)), np.append(weight, np.ones(len(none)))
    order = np.argsort(owner, kind="stable")
    return owner[order], h[order], weight[order]


def _uniform(h: np.ndarray) -> list[np.ndarray]:
    """Five (terms x SLOTS) arrays of numbers in (0, 1), the same for a term wherever it occurs: 24 bits each, cut from two hashes."""
    salt = mix(np.arange(2 * SLOTS, dtype=np.uint64) * np.uint64(8) + BASE)
    x, y = (mix(h[:, None] ^ s[None, :]) for s in (salt[:SLOTS], salt[SLOTS:]))
    low, some = np.uint64(0xFFFFFF), np.uint64(16)
    parts = [x >> np.uint64(40), (x >> some) & low, y >> np.uint64(40), (y >> some) & low, ((x & np.uint64(0xFFFF)) << np.uint64(8)) | (y & np.uint64(0xFF))]
    # numbers of 24 bits are the same by way of 32-bit integers, whose casts are quick
    return [(p.astype(np.int32).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24) for p in parts]


def sample(h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each weighted term and slot: the log of its arrival, and its level.

    With r and c gamma distributed (shape 2) and b uniform, the level is t = floor(ln w / r + b), and the term with the
    least ln c - r (t - b + 1) is drawn: two texts draw the same (term, level) with the probability of their generalised Jaccard similarity."""
    u = _uniform(h)
    r, b = -np.log(u[0] * u[1]), u[4]
    t = np.floor(np.log(weight).astype(np.float32)[:, None] / r + b)
    return np.log(-np.log(u[2] * u[3])) - r * (t - b + 1), t


def drawn(key: np.ndarray, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each weighted term (key: of term and weight) and slot one number: the smallest of a text's is its sample. From above: what orders arrivals (32 bits), the key (16, for
    arrivals that are equal), and the sample (16), which stands for (term, level)."""
    out = np.empty((len(h), SLOTS), np.uint64)
    for a in range(0, len(h), TERMS):
        some = slice(a, a + TERMS)
        arrival, level = sample(h[some], weight[some])
        sign = h[some][:, None] + level.astype(np.int64).astype(np.uint64) * BASE + np.arange(SLOTS, dtype=np.uint64)
        bits = arrival.view(np.int32)
        order = np.where(bits < 0, ~bits, bits ^ np.int32(-(1 << 31))).view(np.uint32).astype(np.uint64)
        out[some] = order << np.uint64(32) | (key[some] >> np.uint64(48) << np.uint64(16))[:, None] | mix(sign) >> np.uint64(48)
    return out


def known(key: np.ndarray, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """drawn, with what the worker remembers: texts share most of their terms. A term has one place in a table of KNOWN, where it replaces the one before it."""
    keys, rows = remembered("drawn", lambda: (np.arange(KNOWN, dtype=np.uint64) ^ np.uint64(1), np.zeros((KNOWN, SLOTS), np.uint64)))  # a place never fits its first key
    at = (key & np.uint64(KNOWN - 1)).astype(np.int64)
    out, new = rows[at], np.flatnonzero(keys[at] != key)
    out[new] = drawn(key[new], h[new], weight[new])
    places, first = np.unique(at[new], return_index=True)
    keys[places], rows[places] = key[new[first]], out[new[first]]
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of SLOTS 16-bit samples a text. Terms are sampled BLOCK at a time; each text keeps what has arrived first so far, so memory does not grow with its vocabulary but for the terms themselves."""
    owner, h, weight = terms(texts)
    # terms that several texts share with one weight are sampled once
    key, some, which = np.unique(mix(h) ^ mix(weight.astype(np.uint64)), return_index=True, return_inverse=True)
    first = np.full((len(texts), SLOTS), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(some), BLOCK):
        mine = some[a : a + BLOCK]
        here = known(key[a : a + BLOCK], h[mine], weight[mine])
        inside = np.flatnonzero((which >= a) & (which < a + BLOCK))
        kinds, texts_here = which[inside] - a, owner[inside]
        at = np.flatnonzero(np.append(True, np.diff(texts_here) > 0))
        for t, b, e in zip(texts_here[at].tolist(), at.tolist(), [*at[1:].tolist(), len(kinds)], strict=True):
            np.minimum(first[t], here[kinds[b:e]].min(0), out=first[t])
    return (first & np.uint64(0xFFFF)).astype(np.uint16)


def portions(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """texts in order, in lists of at most so many characters, or of one text."""
    part, held = [], 0
    for t in texts:
        if part and held + len(t) > most:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    yield part


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal samples, an estimate of the generalised Jaccard similarity."""
    return (a == b).mean(1)


def _range(bounds: list[int]) -> Column:
    """The number of bounds (falling) above `_id`, looked up in two steps: first among every STEP-th, then between those. Where several bounds equal `_id`, its
    rows are dealt over as many ranges by `hash`."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    blocks = F.lit([bounds[i : i + step] for i in range(0, len(bounds), step)])
    whole = F.size(F.filter(F.lit(bounds[step - 1 :: step]), lambda b: b > F.col("_id")))
    # blocks whose last bound is above count whole; the next is looked into
    rest = F.coalesce(F.size(F.filter(F.get(blocks, whole), lambda b: b > F.col("_id"))), F.lit(0))
    at = whole * step + F.greatest(rest, F.lit(0))
    hot = {b: k for b, k in Counter(bounds).items() if k > 1}
    if hot:
        share = (F.col("hash").cast("double") + 2.0**63) / 2.0**64
        times = F.create_map(*[F.lit(x) for b, k in hot.items() for x in (b, k)])[F.col("_id")]
        at = F.when(F.col("_id").isin(list(hot)), at + F.least(F.floor(share * times), times - 1)).otherwise(at)
    return at.cast("int")


def fingerprint_with_next(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of df: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A row's next is the row after it by descending doc_id, ties by a hash of the text, then the text; a null doc_id comes last; after the last comes the
    first. The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next. A null text counts as
    empty; texts without words are all alike and unlike any other. Rows that repeat follow each other; an empty table gives no rows.
    Only the two named columns are read.

    The order is kept without a global sort: doc_id is cut into as many ranges as there are shuffle partitions, each range is one partition, and the first
    row of each is sent along to the one before it; the driver sees one doc_id a range. A doc_id with so many rows that several bounds fall on it is dealt over
    as many ranges by the hash of its texts.
    """
    spark = df.sparkSession
    small_batches(spark)
    lowest = -(1 << 63)
    t = F.coalesce(F.col(text), F.lit(""))
    d = df.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("hash"))
    d = d.withColumn("_id", F.coalesce("doc_id", F.lit(lowest).cast("long")))
    n = tasks(spark)
    bounds = sorted((int(x) for x in d.approxQuantile("_id", [i / n for i in range(1, n)], 0.25 / n)), reverse=True) if n > 1 else []
    d = d.withColumn("range", _range(bounds))
    # the first row of each range, and the range before it
    heads = [(r["range"], r["head"]["_id"], -r["head"]["less"]) for r in d.groupBy("range").agg(F.max(F.struct("_id", (-F.col("hash").cast("decimal(20,0)")).alias("less"))).alias("head")).collect()]
    heads.sort()
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    before = {f"{head}:{h}": heads[i - 1][0] for i, (_, head, h) in enumerate(heads)}
    own = F.struct(F.col("range"), F.lit(0).alias("extra"))
    to = F.array(own)
    if before:
        sent = F.create_map(*[F.lit(x) for head, at in before.items() for x in (head, at)])[F.concat_ws(":", "_id", "hash")]
        also = F.struct(sent.cast("int").alias("range"), F.lit(1).alias("extra"))
        to = F.when(F.col("_id").isin([h[1] for h in heads]) & F.col("hash").isin([int(h[2]) for h in heads]), F.filter(F.array(own, also), lambda x: x["range"].isNotNull())).otherwise(to)
    d = d.withColumn("_to", F.explode(to)).select("doc_id", "_id", "text", "hash", F.col("_to.range").alias("range"), F.col("_to.extra").alias("extra"))
    d = d.repartitionById(n, "range").sortWithinPartitions("range", "extra", F.desc("_id"), "hash", "text")

    def work(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """rows: consecutive (doc_id, text, range, extra); the last is only the next of the one before it."""
        pairs = [i for i in range(len(rows) - 1) if not rows[i][3]]
        if not pairs:
            return
        texts, edits = [r[1] for r in rows], []
        for i in pairs:
            m = len(texts[i]) // 3
            edits.append(texts[i][: len(texts[i]) - m] + texts[i + 1][:m])
        f = np.concatenate([fingerprints(part) for part in portions(texts + edits)])
        a, e, b = f[pairs], f[len(texts) :], f[[i + 1 for i in pairs]]
        hexed = lambda x: pa.array([row.astype(">u2").tobytes().hex() for row in x])
        sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edits]
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows[i][0] for i in pairs], pa.int64()), pa.array([len(texts[i]) for i in pairs], pa.int64()), pa.array(sha), hexed(a), hexed(e), pa.array(likeness(a, e)), pa.array(likeness(a, b))],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        held = 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if waiting and held + len(row[1]) > CHUNK_CHARS and len(waiting) > 1:
                    yield from work(waiting)
                    waiting, held = waiting[-1:], len(waiting[-1][1])
                waiting.append(row)
                held += len(row[1])
                if len(waiting) > CHUNK:
                    yield from work(waiting)
                    waiting, held = waiting[-1:], len(row[1])
        yield from work(waiting)

    return d.select("doc_id", "text", "range", "extra").mapInArrow(run, schema)
