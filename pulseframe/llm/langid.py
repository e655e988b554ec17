"""Language identification with a blended-spectrum string kernel, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import flat_lists, held_out, learning_rows, small_batches
from pulseframe.llm.text import MIX_A, codes, letters

#: n-grams of 1 to LONGEST letters (all else is a gap), hashed to one of 2**BITS features.
LONGEST, BITS = 4, 18
#: The bounded sample that the classifier is fitted on: texts a language and their characters, languages (those with the most rows).
ROWS, CHARS, LANGUAGES = 400, 4_000_000, 256
#: Landmarks a language among the sample, and the ridge.
LANDMARKS, RIDGE = 64, 1e-3
#: Columns of a batch's presence matrix that are multiplied at once.
COLUMNS = 8192


def features(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the features present in it, ascending; empty for a text without letters."""
    lower = [(t or "").lower() for t in texts]
    cp, at = codes(lower)
    letter = letters()[cp]
    c = np.where(letter, cp, 32).astype(np.uint64)
    grams, h = [], np.zeros(len(c), np.uint64)
    for n in range(1, LONGEST + 1):
        h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :] + np.uint64(n)
        grams.append(((h * MIX_A) >> np.uint64(64 - BITS)).astype(np.int32))
    some = np.add.reduceat(np.append(letter, False), at[:-1]) if len(cp) else np.zeros(len(texts))
    mark, out = np.zeros(1 << BITS, bool), []
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if a == b or not some[i]:
            out.append(np.zeros(0, np.int32))
            continue
        for n, g in enumerate(grams):
            mark[g[a : max(a, b - n)]] = True
        present = np.flatnonzero(mark)
        mark[present] = False
        out.append(present.astype(np.int32))
    return out


def fit(sets: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """Languages, and a matrix (features x languages) that gives one-versus-rest scores for a presence vector of norm 1.

    The kernel of two texts is the number of n-grams present in both over the root of the product of their numbers. With landmarks m
    and rows n, the coefficients solve (Knm' Knm + ridge n Kmm) a = Knm' Y. As the kernel is linear in presence vectors, landmark
    vectors times coefficients are one matrix (features x languages), and a batch is scored by the product of its presence matrix with it."""
    langs = sorted(set(labels))
    chosen = [i for lang in langs for i in [j for j, x in enumerate(labels) if x == lang][:landmarks]]
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int32)
    at = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=at[1:])
    norm = np.sqrt(np.maximum(1, np.diff(at)))
    k = np.zeros((len(sets), len(chosen)))
    mark = np.zeros((1 << BITS) + 1)
    for j, i in enumerate(chosen):
        mark[sets[i]] = 1
        k[:, j] = np.add.reduceat(np.append(mark[flat], 0.0), at[:-1]) * (np.diff(at) > 0) / norm / norm[i]
        mark[sets[i]] = 0
    y = np.array([[x == lang for lang in langs] for x in labels], float)
    kmm = k[chosen]
    a = np.linalg.solve(k.T @ k + ridge * len(sets) * kmm + 1e-8 * np.eye(len(chosen)), k.T @ y)
    w = np.zeros((1 << BITS, len(langs)), np.float32)
    for j, i in enumerate(chosen):
        w[sets[i]] += (a[j] / norm[i]).astype(np.float32)
    return langs, w


def scores(sets: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    """One-versus-rest scores of texts (rows) for languages (columns): the texts' presence matrix, each row of norm 1, times w, some columns at a time."""
    n = np.array([len(s) for s in sets], np.int64)
    row, col = np.repeat(np.arange(len(sets)), n), np.concatenate([*sets, np.zeros(0, np.int32)])
    used = np.zeros(len(w), bool)
    used[col] = True
    features_, place = np.flatnonzero(used), np.cumsum(used) - 1
    col = place[col]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(sets), w.shape[1]))
    for c in range(0, len(features_), COLUMNS):
        i, j = np.searchsorted(col, (c, c + COLUMNS))
        m = np.zeros((len(sets), min(COLUMNS, len(features_) - c)), np.float32)
        m[row[i:j], col[i:j] - c] = 1
        out += m @ w[features_[c : c + COLUMNS]]
    return out / np.sqrt(np.maximum(1, n))[:, None]


def learn(df: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", rows: int = ROWS, chars: int = CHARS, languages: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """fit's languages and weights, from the bounded sample. The driver holds `rows` sets of features a language, of `chars` characters and one text more."""
    d = df.filter(~held_out(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("label"), F.col(text).alias("text"))

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = features(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tolist() for x in sets], pa.list_(pa.int32()))], ["label", "key", "set"])

    sample = learning_rows(d, None, rows, chars, languages)
    sample = sample.mapInArrow(presence, "label string, key long, set array<int>").toArrow().sort_by([("label", "ascending"), ("key", "ascending")])
    if not sample.num_rows:
        return [], np.zeros((1 << BITS, 0), np.float32)
    flat, at = flat_lists(sample["set"])
    sets, labels = [flat[i:j] for i, j in itertools.pairwise(at.tolist())], sample["label"].to_pylist()
    good = [i for i, s in enumerate(sets) if len(s)]
    return fit([sets[i] for i in good], [labels[i] for i in good]) if good else ([], np.zeros((1 << BITS, 0), np.float32))


def identify(df: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", rows: int = ROWS, chars: int = CHARS, languages: int = LANGUAGES) -> DataFrame:
    """One row for each row of df: doc_id, held_out, lang_pred, score (0 to 1).

    The classifier learns from a bounded sample of the documents that are not held out and have a language: of the `languages` with the most
    rows, the `rows` texts with the smallest hashes, each text once however often it occurs, up to `chars` characters. A text that is null or has no letter
    is `und` with score 0; so is every text if nothing could be learned. Whole texts are read. Repeated rows each give a row; an empty table gives none.
    doc_id may be of any integer type. Other columns than the three named are not read, and lang is never an input of a prediction.
    """
    spark = df.sparkSession
    small_batches(spark)
    langs, w = learn(df, text, doc_id, lang, rows, chars, languages)
    model = spark.sparkContext.broadcast(w)
    d = df.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*langs, "und"]
        for b in batches:
            sets = features(b.column(2).to_pylist())
            f = scores(sets, model.value) if langs else np.zeros((len(sets), 1))
            n = np.array([len(s) for s in sets])
            best = np.where((n > 0) & bool(langs), f.argmax(1), len(langs))
            p = np.clip(f, 0, 1) + 1e-9
            score = np.where(best < len(langs), np.clip(p.max(1) / p.sum(1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([names[i] for i in best], pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return d.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
