"""Best-fit packing by bin completion over the histogram of lengths."""

from __future__ import annotations

import itertools
import operator
import os
import sys
import types
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import cut, digits, prefix_sums, small_batches

#: Entries of a worker's cache of words, in two halves: when the younger is full it becomes the older, whose words are forgotten but for those that a later batch used. Memory is bounded.
CACHE = 400_000
#: Marks; those after a word's last letter or digit are read apart from it by the tokenizer, together.
MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
#: Words that are encoded at once.
JOINED = 500
#: Words with a letter from this on go through the whole tokenizer: below (Latin, Greek, Cyrillic), Python and the tokenizer agree on what letters are.
BEYOND = "\u0530"
#: Steps that branch-and-bound may take after its first descent.
STEPS = 8_000


def encoder(path: str):
    """A function from text to its ids as little-endian 32-bit bytes, equal to Tokenizer.encode's without special tokens.

    No token crosses ASCII white space, so texts are encoded word by word, and words are remembered by the worker. What the tokenizer does before its merges (NFC, lower case, splits
    by kind of character) changes nothing in lower-case words of letters, so those go to its merges alone."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of the tokenizer's own only take memory
    from tokenizers import Tokenizer, pre_tokenizers

    kept = sys.modules.setdefault("_pulseframe_words", types.ModuleType("_pulseframe_words")).__dict__
    cache: dict[bytes, bytes] = kept.setdefault(path, {})
    older: dict[bytes, bytes] = kept.setdefault(path + "/older", {})
    if path + "/tokenizer" not in kept:
        tok = Tokenizer.from_file(path)
        merges = Tokenizer(tok.model)
        merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = tok.get_vocab(with_added_tokens=True)
        ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        kept[path + "/tokenizer"] = tok, merges, ends_word
    tok, merges, ends_word = kept[path + "/tokenizer"]

    def apart(w: bytes, base: bytes) -> bool:
        """True if the tokenizer reads the marks after base apart from it: it ends in a letter or digit, also in lower case, and neither is part of a special token."""
        if not base or b"<|" in w:
            return False
        return base[-1:].isalnum() if base[-1] < 128 else (c := base.decode()[-1]) < BEYOND and c.lower().isalpha()

    def learn(words: set[bytes]) -> None:
        ends = {w: base for w in words if len(base := w.rstrip(MARKS)) < len(w) and apart(w, base)}
        plain = words.difference(ends)
        plain.update({*ends.values(), *(w[len(base) :] for w, base in ends.items())}.difference(cache))
        plain = list(plain)
        # a word of letters gives one token that ends a word, its last: many such words are encoded at once and told apart
        read = b" ".join(plain).decode().split(" ") if plain else []
        letters = list(map(str.isalpha, read))
        easy = [a and (t.isascii() and t.islower() or max(t) < BEYOND and t == t.lower() and is_normalized("NFC", t)) for a, t in zip(letters, read, strict=True)]
        rest = [w for w, a in zip(plain, letters, strict=True) if not a]
        for by, which in ((merges, easy), (tok, list(map(operator.gt, letters, easy)))):
            runs, said = list(itertools.compress(plain, which)), list(itertools.compress(read, which))
            for at in range(0, len(runs), JOINED):
                some = runs[at : at + JOINED]
                ids = np.array(by.encode_batch_fast([" ".join(said[at : at + JOINED])], add_special_tokens=False)[0].ids, "<u4")
                stops = np.flatnonzero(ends_word[ids]) + 1
                if len(stops) == len(some):
                    packed, stops = ids.tobytes(), (4 * stops).tolist()
                    cache.update(zip(some, [packed[i:j] for i, j in zip([0, *stops], stops)], strict=True))
                else:
                    rest += some
        for w, e in zip(rest, tok.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
            cache[w] = np.array(e.ids, "<u4").tobytes()
        for w, base in ends.items():
            cache[w] = cache[base] + cache[w[len(base) :]]

    def encode(texts: list[str | None]) -> list[bytes]:
        split = []
        for t in texts:
            b = (t or "").encode("utf-8", "replace")
            # the tokenizer ignores case; only its special tokens' marks do not
            split.append((b if b"<|" in b else b.lower()).split())
        if len(cache) > CACHE // 2:
            older.clear()
            older.update(cache)
            cache.clear()
        if new := set().union(*split).difference(cache):
            if known := [w for w in new if w in older]:
                cache.update(zip(known, map(older.__getitem__, known), strict=True))
                new.difference_update(known)
            learn(new)
        get = cache.__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    return encode


def pieces(df: DataFrame, path: str, limit: int, end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32."""
    small_batches(df.sparkSession)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            out = ([], [], [], [], [])
            for d, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, limit)):
                    for to, v in zip(out, (d, k, at, min(limit, n - at), zlib.crc32(ids[4 * at : 4 * (at + limit)])), strict=True):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    d = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first


def _uses(fill: list[int]) -> Pattern:
    return tuple((x, fill.count(x)) for x in sorted(set(fill), reverse=True))


class _Search:
    """Bin completion: which lengths share a bin, and how many bins share that filling."""

    def __init__(self, counts: np.ndarray, size: int):
        self.c, self.size = counts.astype(np.int64).copy(), size
        self.total = int((self.c * np.arange(len(self.c))).sum())
        self.bits = sum(1 << int(x) for x in np.flatnonzero(self.c))

    def change(self, p: Pattern, times: int) -> None:
        for x, k in p:
            self.c[x] -= k * times
            self.bits = self.bits | (1 << x) if self.c[x] else self.bits & ~(1 << x)

    def times(self, p: Pattern) -> int:
        return min(int(self.c[x]) // k for x, k in p)

    def best_fit(self, first: int) -> Pattern:
        """The longest that still fits, again and again."""
        fill, room = [first], self.size - first
        while room and (below := self.bits & ((2 << room) - 1)):
            while below:
                x = below.bit_length() - 1
                if self.c[x] > fill.count(x):
                    break
                below &= ~(1 << x)
            if not below:
                break
            fill.append(x)
            room -= x
        return _uses(fill)

    def quick(self, first: int, most: int = 4) -> list[Pattern]:
        """A few good fillings around the longest length, least waste first: for each number of added pieces up to `most` one of
        the greatest sum, and best fit. They only come first: completions() goes on to all others."""
        room, out, waste = self.size - first, [], self.size
        base = self.bits & ((2 << room) - 1) if room else 0
        sums = [1, base]
        for k in range(1, most + 1):
            if k > 1:
                exact = None
                if k == 2:  # two that fill the room exactly are found without all sums
                    a = self.c[: room + 1] > 0
                    hit = np.flatnonzero(a & a[::-1])
                    exact = next((int(x) for x in hit[::-1] if x and x < room and (x != room - x or self.c[x] > 1 + (x == first))), None)
                if exact is not None:
                    p = _uses([first, exact, room - exact])
                    if self.times(p):
                        out.append(p)
                        break
                s, rest = 0, base
                while rest:
                    x = rest.bit_length() - 1
                    rest &= ~(1 << x)
                    s |= sums[k - 1] << x
                sums.append(s & ((2 << room) - 1))
            if not sums[k]:
                break
            best = sums[k].bit_length() - 1
            if room - best >= waste:
                continue
            fill, left = [first], best
            for j in range(k, 0, -1):
                can = base & ((2 << left) - 1)
                while can:
                    x = can.bit_length() - 1
                    if sums[j - 1] >> (left - x) & 1 and self.c[x] > fill.count(x):
                        break
                    can &= ~(1 << x)
                if not can:
                    break
                fill.append(x)
                left -= x
            if left == 0:
                out.append(_uses(fill))
                waste = room - best
                if not waste:
                    break
        p = self.best_fit(first)
        if p not in out:
            out.append(p)
        return sorted(out, key=lambda p: self.size - sum(x * k for x, k in p))

    def dominated(self, added: list[int], free: int, room: int) -> bool:
        """True if a free length does at least as well in the place of one or two added ones (a filling is only completed where nothing
        more fits). Each exchange makes the sum larger, or as large with fewer pieces, so some filling is left undominated."""
        within = (1 << room) - 1
        if any(free >> (x + 1) & within for x in set(added)):
            return True
        return any(free >> (x + y) & (within << 1 | 1) for x, y in set(itertools.combinations(sorted(added), 2)))

    def completions(self, first: int, spare: int) -> Iterator[Pattern | None]:
        """All undominated fillings around the longest length that waste at most `spare`; None stands for a step without one.

        Quick fillings come first. The rest are found depth first, pieces in falling order of length. c must be the same again whenever the next is asked for."""
        opening = self.quick(first)
        yield from opening
        lengths = [x for x in range(min(self.size - first, len(self.c) - 1), 0, -1) if self.c[x] > (x == first)]
        left = {x: int(self.c[x]) - (x == first) for x in lengths}
        free = sum(1 << x for x in lengths)
        # what all pieces up to this length could add, to see where too much waste is certain
        most = np.append(np.cumsum([x * left[x] for x in reversed(lengths)])[::-1], 0).tolist()
        added: list[int] = []
        room, at = self.size - first, 0
        while True:
            yield None
            while at < len(lengths) and (lengths[at] > room or not left[lengths[at]]):
                at += 1
            if at < len(lengths) and room - most[at] <= spare:
                x = lengths[at]
                added.append(x)
                left[x] -= 1
                free = free & ~(1 << x) if not left[x] else free
                room -= x
                continue
            if at == len(lengths) and room <= spare and not free & ((2 << room) - 1) & ~1 and not self.dominated(added, free, room):
                p = _uses([first, *added])
                if p not in opening:
                    yield p
            if not added:
                return
            x = added.pop()
            left[x] += 1
            free |= 1 << x
            room += x
            at = lengths.index(x) + 1


def lower_bound(counts: np.ndarray, size: int) -> int:
    """At least this many bins: for each k, pieces over size - k fill a bin alone, those over half of it need one each, and pieces of k or more
    go into what these leave."""
    x = np.arange(size + 1)
    n, tokens = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(counts * x))
    half = size // 2
    k = np.arange(0, half + 1)
    large = n[size + 1] - n[half + 1]
    middle = n[size - k + 1] - n[half + 1]
    left = middle * size - (tokens[size - k + 1] - tokens[half + 1])
    small = tokens[half + 1] - tokens[np.maximum(k, 0)]
    return int(max(-(-int(tokens[-1]) // size), (large + np.maximum(0, -(-(small - left) // size))).max()))


def bins(counts: np.ndarray, size: int, steps: int = STEPS) -> list[tuple[Pattern, int]]:
    """Fillings and how many bins each gets, for counts[x] pieces of length x <= size.

    The incumbent is best fit by decreasing length. Branch and bound completes the bin of the longest remaining length with each
    undominated filling, for as many bins as it goes, then for fewer, and turns back where the waste so far already needs as many bins as the incumbent.
    It ends when it meets the lower bound or has tried all, and then the number of bins is the least there is; or after `steps` steps
    (choices of a filling and steps of their enumeration, those of the first descent apart), and then the best found so far is returned.
    """
    found: list[tuple[Pattern, int]] = []
    s = _Search(counts, size)
    total = s.total
    while s.bits:
        p = s.best_fit(s.bits.bit_length() - 1)
        found.append((p, m := s.times(p)))
        s.change(p, m)
    best = sum(m for _, m in found)
    least = lower_bound(np.asarray(counts, np.int64), size)
    s = _Search(counts, size)
    path: list[tuple[Iterator, Pattern, int, int]] = []  # fillings to come, what was done, how often, its waste
    waste = taken = 0

    def spare() -> int:
        return (best - 1) * size - total - waste

    def choices() -> Iterator[tuple[Pattern, int] | None]:
        for p in s.completions(s.bits.bit_length() - 1, spare()):
            yield from ((p, m) for m in range(s.times(p), 0, -1)) if p else (None,)

    options = choices() if s.bits else iter(())
    first_descent = True
    while best > least and (taken < steps or first_descent):
        taken += not first_descent
        choice = next(options, "none") if spare() >= 0 else "none"
        if choice is None:
            continue
        if choice != "none":
            p, m = choice
            w = m * (size - sum(x * k for x, k in p))
            if w > spare() and not first_descent:
                continue
            s.change(p, m)
            path.append((options, p, m, w))
            waste += w
            if s.bits:
                options = choices()
                continue
            if (n := sum(x[2] for x in path)) < best:
                best, found = n, [(x[1], x[2]) for x in path]
            options = iter(())
        first_descent = False
        if not path:
            break
        options, p, m, w = path.pop()
        s.change(p, -m)
        waste -= w
    return found


def pack(df: DataFrame, path: str, limit: int = 4096, end_id: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pack documents into sequences of at most `limit` tokens: one row a piece, with doc_id, piece, start, length, ids_crc32,
    sequence_id and offset.

    A document is its ids and then end_id; only a document longer than limit is cut, into pieces of limit tokens and a rest. A null
    text counts as empty (one token). Repeated rows and rows without a doc_id are packed like others; an empty table
    gives no rows. Only the two named columns are read.

    What is planned on the driver is the histogram of lengths, of `limit` entries at most whatever the input; pieces of one
    length are interchangeable, so a piece's place follows from its rank among the pieces of its length.
    """
    spark = df.sparkSession
    rows = cut(pieces(df, path, limit, end_id, text, doc_id), "pieces")
    counts = np.zeros(limit + 1, np.int64)
    for r in rows.groupBy("length").count().collect():  # limit rows at most
        counts[r["length"]] = r["count"]
    plan: dict[int, list[tuple[int, int, int, int]]] = {}  # length: first rank, uses a bin, first bin, offset
    ranks, first = np.zeros(limit + 1, np.int64), 0
    for p, m in bins(counts, limit):
        at = 0
        for x, k in p:
            plan.setdefault(x, []).append((int(ranks[x]), k, first, at))
            ranks[x] += k * m
            at += x * k
        first += m
    # a few entries a filling: bounded by limit, not by the input
    table = spark.sparkContext.broadcast({x: np.array(v, np.int64) for x, v in plan.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            length, rank = t["length"].to_numpy(), t["rank"].to_numpy()
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                here, rows_of = np.flatnonzero(length == x), table.value[int(x)]
                e = rows_of[np.searchsorted(rows_of[:, 0], rank[here], "right") - 1]
                q = rank[here] - e[:, 0]
                seq[here], off[here] = e[:, 2] + q // e[:, 1], e[:, 3] + q % e[:, 1] * x
            t = t.drop(["rank"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))
            yield from t.to_batches()

    keyed = rows.withColumn("_key", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "piece", "ids_crc32"))).withColumn("_one", F.lit(1))
    ranked = prefix_sums(keyed, ["length"], ["_key"], "_one", "rank", digits(int(counts.max())))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
