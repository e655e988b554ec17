"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import flat_lists, held_out, learning_rows, small_batches
from pulseframe.llm.text import codes, letters, mix, word_hashes

#: A sentence's features are its words and their beginnings of these lengths, hashed to 2**BITS weights.
PREFIXES, BITS = (4, 5, 6), 18
#: The bounded sample that weights are fitted on: texts a class and their characters.
ROWS, CHARS = 2500, 8_000_000
#: Passes over the sample, step, the pull of weights to zero, and documents a step.
PASSES, STEP, PULL, BATCH = 25, 0.5, 1e-4, 50
#: A feature has a weight if it is commoner in toxic documents by a likelihood ratio statistic of at least TELLING. The bias is moved by at most REACH,
#: to where the folds' scores agree best with the labels.
TELLING, FOLDS, REACH = 4.0, 3, 3.0
#: A document is toxic from this score; a sentence is named as offending from SENTENCE.
TOXIC, SENTENCE = 0.7, 0.5


def lowered(text: str) -> str:
    """The text in lower case, of the same length: a character whose lower case is longer stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def sentences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features as numbers; for each feature its sentence; for each sentence its text, and its place (start, end) in code points of the text.

    Words are runs of letters. A sentence ends with a full stop, exclamation or question mark, or line end; those without words don't count."""
    cp, at = codes([lowered(t or "") for t in texts])
    first, *h = word_hashes(cp, letters()[cp], at, PREFIXES)
    stop = (cp == 46) | (cp == 33) | (cp == 63) | (cp == 10)
    fresh = np.zeros(len(cp) + 1, bool)
    fresh[at] = True
    begins = fresh[: len(cp)].copy()
    begins[1:] |= stop[:-1]
    starts = np.flatnonzero(begins)
    number = np.searchsorted(starts, first, "right") - 1
    used, own = np.unique(number, return_inverse=True)
    text = np.searchsorted(at, starts[used], "right") - 1
    ends = np.append(starts[1:], len(cp))[used] if len(starts) else starts[used]
    # a beginning counts as another feature than a word that is spelt so
    h = np.stack([mix(x + np.uint64(i)) for i, x in enumerate(h)], 1).ravel() >> np.uint64(64 - BITS)
    return h.astype(np.int32), np.repeat(own, 1 + len(PREFIXES)), text, np.stack([starts[used] - at[text], ends - at[text]], 1)


def telling(docs: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> np.ndarray:
    """Which features speak for a toxic document: more of the toxic documents have them than their share, by a likelihood ratio statistic of TELLING at least."""
    seen = np.zeros((2, 1 << BITS))
    for (words, _), label in zip(docs, toxic.tolist(), strict=True):
        seen[label, np.unique(words)] += 1
    share = np.bincount(toxic, minlength=2) / max(1, len(toxic))
    expected = np.maximum(seen.sum(0) * share[:, None], 1e-300)
    ratio = 2 * (seen * np.log(np.maximum(seen, 1e-300) / expected)).sum(0)
    return (ratio >= TELLING) & (seen[1] > expected[1])


def only(docs: list[tuple[np.ndarray, np.ndarray]], kept: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The documents with the kept features alone; sentences stay, if empty."""
    out = []
    for words, sizes in docs:
        on = kept[words]
        out.append((words[on], np.bincount(np.repeat(np.arange(len(sizes)), sizes)[on], minlength=len(sizes))))
    return out


def fit(docs: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias from documents (a document's features, and how many each of its sentences has) and their labels.

    Only telling features get weights. The bias is then moved to where, at TOXIC, documents scored by models of the other folds have the best F1, so that few labels
    don't make scores too small; folds are dealt in the given order. Ties: the least move. With fewer than FOLDS documents of a class it isn't moved."""
    w, bias = descend(only(docs, telling(docs, toxic)), toxic, seed)
    if np.bincount(toxic, minlength=2).min() < FOLDS:
        return w, bias
    fold = np.empty(len(docs), np.int64)
    for label in (0, 1):
        rows = np.flatnonzero(toxic == label)
        fold[rows] = np.arange(len(rows)) % FOLDS
    z, of = [], []
    for k in range(FOLDS):
        rest = np.flatnonzero(fold != k)
        known = [docs[i] for i in rest]
        fw, fb = descend(only(known, telling(known, toxic[rest])), toxic[rest], seed)
        for i in np.flatnonzero(fold == k):
            words, sizes = docs[i]
            z.append(np.bincount(np.repeat(np.arange(len(sizes)), sizes), fw[words], len(sizes)) + fb)
            of.append(np.full(len(sizes), i))
    z, of = np.concatenate(z), np.concatenate(of)
    moves = np.linspace(-REACH, REACH, 49)

    def f1(move: float) -> float:
        found = -np.expm1(-np.bincount(of, np.logaddexp(0, z + move), len(docs))) >= TOXIC
        return 2 * (found & (toxic == 1)).sum() / (found.sum() + toxic.sum())

    return w, bias + float(min(moves, key=lambda move: (-f1(move), abs(move))))


def descend(docs: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the likelihood of the documents' labels under noisy-or, by AdaGrad over shuffled batches.

    With z a sentence's sum of weights plus bias, the document is clean with probability exp(-sum log(1 + exp z)). Words seen in fewer than three
    documents keep weight 0."""
    df = np.zeros(1 << BITS, np.int32)
    for words, _ in docs:
        df[np.unique(words)] += 1
    w, bias = np.zeros(1 << BITS), -6.0
    gw, gb = np.full(1 << BITS, 1e-2), 1e-2
    rng = np.random.default_rng(seed)
    weight = np.where(toxic == 1, len(toxic) / max(1, 2 * toxic.sum()), len(toxic) / max(1, 2 * (1 - toxic).sum()))
    for _ in range(PASSES):
        order = rng.permutation(len(docs))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            words = np.concatenate([docs[i][0] for i in rows])
            sizes = np.concatenate([docs[i][1] for i in rows])
            if not len(sizes):
                continue
            sent = np.repeat(np.arange(len(sizes)), sizes)
            doc = np.repeat(np.arange(len(rows)), [len(docs[i][1]) for i in rows])
            z = np.bincount(sent, w[words], len(sizes)) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            s = np.maximum(np.bincount(doc, np.logaddexp(0, z), len(rows)), 1e-9)
            slope = np.where(toxic[rows] == 1, -1 / np.expm1(np.minimum(s, 500)), 1.0) * weight[rows] / len(rows)
            g = p * slope[doc]
            grad = np.bincount(words, g[sent], 1 << BITS)
            here = np.unique(words)
            here = here[df[here] >= 3]
            gw[here] += grad[here] ** 2
            w[here] -= STEP * grad[here] / np.sqrt(gw[here])
            w[here] = np.sign(w[here]) * np.maximum(0, np.abs(w[here]) - PULL * STEP / np.sqrt(gw[here]))
            gb += g.sum() ** 2
            bias -= STEP * g.sum() / np.sqrt(gb)
    return w.astype(np.float32), float(bias)


def train(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = ROWS, chars: int = CHARS):
    """Weights (broadcast) and bias, learned from a bounded sample of the labelled documents that are not held out: of each class the `rows` texts with the
    smallest hashes, each text once, up to `chars` characters. If a class has none, every score is 0."""
    spark = df.sparkSession
    small_batches(spark)
    d = df.filter(F.col(text).isNotNull() & ~held_out(F.col(doc_id))).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").dropna().filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, own, of, _ = sentences(b.column(2).to_pylist())
            sizes = np.bincount(own, minlength=len(of))
            per_doc, per_word = np.searchsorted(of, np.arange(b.num_rows + 1)), np.append(0, np.cumsum(sizes))
            ws = [words[per_word[i] : per_word[j]].tolist() for i, j in zip(per_doc[:-1], per_doc[1:], strict=True)]
            ss = [sizes[i:j].tolist() for i, j in zip(per_doc[:-1], per_doc[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ws, pa.list_(pa.int32())), pa.array(ss, pa.list_(pa.int32()))], ["label", "key", "words", "sizes"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        sample = pa.Table.from_batches(got).sort_by([("key", "ascending"), ("label", "ascending")])
        (words, w_at), (sizes, s_at) = flat_lists(sample["words"]), flat_lists(sample["sizes"])
        docs = [(words[a:b], sizes[c:d].astype(np.int64)) for (a, b), (c, d) in zip(itertools.pairwise(w_at.tolist()), itertools.pairwise(s_at.tolist()), strict=True)]
        y = np.array(sample["label"].to_pylist(), np.int64)
        if len(set(y.tolist())) == 2:
            w, bias = fit(docs, y)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])

    sample = learning_rows(d, known, rows, chars, 2).mapInArrow(parts, "label int, key long, words array<int>, sizes array<int>")
    # the sample is bounded: one task learns from it, and the driver gets the weights alone
    model = sample.repartition(1).mapInArrow(learn, "weights binary, bias double").first()
    if model is None:
        return spark.sparkContext.broadcast(np.zeros(1 << BITS, np.float32)), -np.inf
    return spark.sparkContext.broadcast(np.frombuffer(model["weights"], np.float32)), model["bias"]


def score(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = ROWS, chars: int = CHARS) -> DataFrame:
    """One row for each row of df: doc_id, held_out, score, predicted, and offending, an array of (start, end, score) of sentences.

    labels has doc_id and toxic; a document with several labels is toxic if one says so, rows with a null are left out. The model learns
    from a bounded sample of the labelled documents that are not held out: of each class the `rows` texts with the smallest hashes, each once, up to `chars`
    characters. doc_id may be of any integer type.
    A text that is null or has no words has score 0, and so has every text if a class has no rows. Whole texts are read. Repeated rows each give a row; an
    empty table gives none. Places of sentences count code points of the text. Other columns are not read.
    """
    model, bias = train(df, labels, text, doc_id, rows, chars)
    d = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out(F.col(doc_id)).alias("held_out"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for b in batches:
            words, own, of, where = sentences(b.column(2).to_pylist())
            z = np.bincount(own, model.value[words], len(of)) + bias
            p = -np.expm1(-np.bincount(of, np.logaddexp(0, z), b.num_rows))
            bad: list[list] = [[] for _ in range(b.num_rows)]
            for i in np.flatnonzero(z >= np.log(SENTENCE / (1 - SENTENCE))):
                bad[of[i]].append({"start": int(where[i, 0]), "end": int(where[i, 1]), "score": float(1 / (1 + np.exp(-z[i])))})
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.clip(p, 0, 1)), pa.array((p >= TOXIC).astype(np.int32)), pa.array(bad, kind)], ["doc_id", "held_out", "score", "predicted", "offending"])

    return d.select("doc_id", "held_out", "text").mapInArrow(predict, "doc_id long, held_out boolean, score double, predicted int, offending array<struct<start:long,end:long,score:double>>")


def keep_clean(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = ROWS, chars: int = CHARS) -> DataFrame:
    """The rows of df whose score is below TOXIC, as they are; the model is train's."""
    model, bias = train(df, labels, text, doc_id, rows, chars)
    at = df.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, own, of, _ = sentences(b.column(at).to_pylist())
            z = np.bincount(own, model.value[words], len(of)) + bias
            p = -np.expm1(-np.bincount(of, np.logaddexp(0, z), b.num_rows))
            yield b.filter(pa.array(p < TOXIC))

    return df.mapInArrow(clean, df.schema)
