"""Cross-entropy difference: a target and a background model of word pairs over the corpus' own vocabulary score each document.

Counts cover all documents and grow with the corpus: documents are packed, each pack's distinct words and pairs are dealt by hash to the tasks that count
them, and the counts go back to the packs that asked. Every entry is as likely to go to any task, however often it occurs."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import cut, held_out, small_batches, tasks
from pulseframe.llm.text import codes, mix, remembered, word_hashes

#: What stands before a text's first word and after its last.
START = np.uint64(0x5851F42D4C957F2D)
#: Characters of a pack, and of the packs whose entries one task counts.
PACK, PART = 2_000_000, 50_000_000
#: Smoothing: the weight of single words in a pair's probability (in tokens), and of equal shares in a word's (in tokens a word).
PRIOR, ALPHA = 10.0, 0.1


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: 0 white space, 1 part of a word (letter, mark or digit), 2 a word of its own (ideographs, kana, all else);
    and its lower case, where that is one code point."""
    kind, lower = np.full(0x110000, 2, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if ch.isspace():
            kind[c] = 0
        elif (ch.isalnum() or unicodedata.category(ch)[0] == "M") and not (0x2E80 <= c < 0xA000 or 0xF900 <= c < 0xFB00 or c >= 0x20000):
            kind[c] = 1
        low = ch.lower()
        if len(low) == 1:
            lower[c] = ord(low)
    return kind, lower


def pairs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's 64-bit hash, that of the word before it in its text (START for the first), and the number of its text.

    The vocabulary is open: any word of any script is its own entry."""
    cp, at = codes([t or "" for t in texts])
    kind, lower = remembered("word kinds", _kinds)
    k = kind[cp]
    alone = np.flatnonzero(k == 2)
    first, w = word_hashes(lower[cp], k > 0, np.concatenate([at, alone, alone + 1]))
    own = np.searchsorted(at, first, "right") - 1
    before = np.full(len(w), START, np.uint64)
    before[1:] = np.where(own[1:] == own[:-1], w[:-1], START)
    return before.view(np.int64), w.view(np.int64), own


@dataclass
class Entries:
    """The distinct words and pairs of some texts: keys, ordered by part then key; where each part's begin; and for each word of the texts the
    number of its text, and the positions of its pair, its word and the word before it among the keys (`ends`: the position of START, or -1)."""

    keys: np.ndarray
    bounds: np.ndarray
    own: np.ndarray
    pair: np.ndarray
    word: np.ndarray
    before: np.ndarray
    ends: int

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        """How often each entry occurs in the chosen texts (a mask). START occurs once a text that has words."""
        here = chosen[self.own]
        out = np.bincount(self.pair[here], minlength=len(self.keys)) + np.bincount(self.word[here], minlength=len(self.keys))
        if self.ends >= 0:
            out[self.ends] += len(np.unique(self.own[here]))
        return out


def entries(texts: list[str | None], parts: int) -> Entries:
    """Words have odd keys, pairs even ones."""
    before, word, own = (x if i == 2 else x.view(np.uint64) for i, x in enumerate(pairs(texts)))
    words, w = np.unique(np.append(word, START) if len(word) else word, return_inverse=True)
    w = w[: len(word)]
    first = before == START
    v = np.append(0, w[:-1])[: len(w)]
    v[first] = np.searchsorted(words, START)
    both, p = np.unique(mix(mix(before) + word) & ~np.uint64(1), return_inverse=True)
    keys = np.concatenate([mix(words) | np.uint64(1), both])
    part = ((keys >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((keys, part))
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    return Entries(keys[order], bounds, own, place[len(words) + p], place[w], place[v], int(place[np.searchsorted(words, START)]) if len(word) else -1)


def packed(marked: DataFrame) -> DataFrame:
    """Rows (doc_id, text, target) in packs of about PACK characters: pack, chars, and the rows as a compressed Arrow stream."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, chars, number = [], 0, TaskContext.get().partitionId() << 32

        def emit() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            t = pa.Table.from_batches(waiting)
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(t)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([chars], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["pack", "chars", "rows"])

        for b in batches:
            lengths, at = pc.fill_null(pc.utf8_length(b.column(1)), 0).to_pylist(), 0
            for i, n in enumerate(lengths):
                chars += n
                if chars >= PACK:
                    waiting.append(b.slice(at, i + 1 - at))
                    yield emit()
                    waiting, chars, number, at = [], 0, number + 1, i + 1
            if at < b.num_rows:
                waiting.append(b.slice(at))
        if waiting:
            yield emit()

    return marked.select("doc_id", "text", "target").mapInArrow(pack, "pack long, chars long, rows binary")


def unpack(rows: bytes) -> tuple[pa.ChunkedArray, list[str | None], np.ndarray]:
    t = pa.ipc.open_stream(rows).read_all()
    return t["doc_id"], t["text"].to_pylist(), t["target"].to_numpy()


def counted(packs: DataFrame, parts: int) -> DataFrame:
    """For each pack and part, the background and target counts over all packs of the pack's entries of that part, in their order; and once for each
    part its number of distinct words, and their occurrences: pack, part, counts, words, background, target."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, rows in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                _, texts, target = unpack(rows.as_py())
                e = entries(texts, parts)
                n = np.stack([e.counts(np.ones(len(texts), bool)), e.counts(target)])
                some = [k for k in range(parts) if e.bounds[k] < e.bounds[k + 1]]
                slices = [slice(e.bounds[k], e.bounds[k + 1]) for k in some]
                arrays = [[number] * len(some), some, [e.keys[s].tobytes() for s in slices], [pa.compress(n[:, s].tobytes(), "zstd", asbytes=True) for s in slices]]
                yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["pack", "part", "keys", "counts"])

    def count(group: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint64) for k in group["keys"].to_pylist()]
        sizes = [len(k) for k in keys]
        n = [np.frombuffer(pa.decompress(c, 16 * k, "zstd"), np.int64).reshape(2, -1) for c, k in zip(group["counts"].to_pylist(), sizes, strict=True)]
        kinds, which = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate(n, 1)
        sums = np.zeros((2, len(kinds)), np.int64)
        for m in (0, 1):
            np.add.at(sums[m], which, n[m])
        word = kinds & np.uint64(1) == 1
        at = np.append(0, np.cumsum(sizes))
        back = [pa.compress(sums[:, which[i:j]].tobytes(), "zstd", asbytes=True) for i, j in zip(at[:-1], at[1:], strict=True)]
        once = lambda x: pa.array([int(x)] + [0] * (len(sizes) - 1), pa.int64())
        return pa.table([group["pack"], group["part"], pa.array(back, pa.binary()), once(word.sum()), once(sums[0][word].sum()), once(sums[1][word].sum())], ["pack", "part", "counts", "words", "background", "target"])

    asked = packs.select("pack", "rows").mapInArrow(ask, "pack long, part int, keys binary, counts binary")
    return asked.groupBy("part").applyInArrow(count, "pack long, part int, counts binary, words long, background long, target long")


def bits(e: Entries, counts: np.ndarray, total: float, scale: float, words: int) -> np.ndarray:
    """Bits of surprise of each word after the one before it. A pair's probability is its share of the pairs that begin alike, with PRIOR pairs more that
    follow single words; a word's is its share, with ALPHA occurrences more of each word. counts and total are scaled."""
    c = counts * scale
    single = (c[e.word] + ALPHA) / (total * scale + ALPHA * words)
    return -np.log2((c[e.pair] + PRIOR * single) / (c[e.before] + PRIOR))


def score(df: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of df: doc_id, n_tokens, target_loss, background_loss (bits a token) and score, their difference; a low score is near the target.

    target holds the doc_id of the documents that the target model is counted from; the background model is counted from all of df. A token is a word:
    a run of letters, marks and digits without case, or one ideograph, kana or other mark. Both models are pairs of words, smoothed by single
    words and those by equal shares of the corpus' distinct words (and the mark that begins and ends texts). They are matched: same vocabulary, order and
    smoothing, and background counts are scaled to the target's number of tokens. A target document is scored by the target model without its own
    counts. Counts cover every whole text. A null or empty text has no tokens and losses 0; without any target token both models are the
    background's. Rows that repeat count as often, and each has its own row; ids that repeat in target count once; an empty table gives no rows; doc_id
    may be of any integer type. Other columns are not read.
    """
    spark = df.sparkSession
    small_batches(spark)
    d = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chosen = target.select(F.col("doc_id").cast("long").alias("_id")).dropna().distinct()
    # a merge join whatever the size: the targets have no bound that would let them be broadcast
    marked = d.join(chosen.hint("merge"), d["doc_id"] == chosen["_id"], "left").select("doc_id", "text", F.col("_id").isNotNull().alias("target"))
    packs = cut(packed(marked), "packs")
    parts = max(tasks(spark), -(-int(packs.agg(F.sum("chars")).first()[0] or 0) // PART))
    answers = cut(counted(packs, parts), "counts")
    words, background, wanted = (int(x or 0) for x in answers.agg(F.sum("words"), F.sum("background"), F.sum("target")).first())
    scale = wanted / background if wanted else 1.0

    def judge(pack: pa.Table, answer: pa.Table) -> pa.Table:
        ids, texts, is_target = unpack(pack["rows"][0].as_py())
        e = entries(texts, parts)
        sizes = np.diff(e.bounds)
        n = [np.zeros((2, 0), np.int64)]
        for part, c in sorted(zip(answer["part"].to_pylist(), answer["counts"].to_pylist(), strict=True)):
            n.append(np.frombuffer(pa.decompress(c, 16 * int(sizes[part]), "zstd"), np.int64).reshape(2, -1))
        n = np.concatenate(n, 1)
        of_background = bits(e, n[0], background, scale, words)
        of_target = bits(e, n[1], wanted, 1.0, words) if wanted else of_background.copy()
        at = np.searchsorted(e.own, np.arange(len(texts) + 1))
        for i in np.flatnonzero(is_target) if wanted else []:
            a, b = at[i], at[i + 1]
            if a == b:
                continue
            own = Entries(e.keys, e.bounds, e.own[a:b], *(x[a:b] for x in (e.pair, e.word, e.before)), e.ends)
            some, which = np.unique(np.concatenate([own.pair, own.word, own.before, [e.ends]]), return_inverse=True)
            less = n[1][some] - np.bincount(which[: 2 * (b - a)], minlength=len(some))
            less[which[-1]] -= 1
            small = Entries(some, e.bounds, own.own, *np.split(which[:-1], 3), -1)
            of_target[a:b] = bits(small, less, wanted - (b - a) - 1, 1.0, words)
        tokens = np.diff(at)
        mean = [np.bincount(e.own, x, len(texts)) / np.maximum(1, tokens) for x in (of_target, of_background)]
        return pa.table([ids.combine_chunks(), pa.array(tokens), pa.array(mean[0]), pa.array(mean[1]), pa.array(mean[0] - mean[1])], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    both = packs.select("pack", "rows").groupBy("pack").cogroup(answers.select("pack", "part", "counts").groupBy("pack"))
    return both.applyInArrow(judge, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def good(labels: DataFrame) -> DataFrame:
    """The target documents of the query: those labelled good that are not held out."""
    return labels.filter((F.col("quality") == 1) & ~held_out(F.col("doc_id"))).select("doc_id")
