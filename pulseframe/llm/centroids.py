"""Lloyd's clustering of integer vectors, exact in every step."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import cut, small_batches

#: Components of a vector, and what they are multiplied by before the floor.
SIZE, SCALE = 64, 256
#: Clusters, rounds, and what is hashed before a vec_id to choose the first centroids.
CLUSTERS, ROUNDS, SALT = 40, 5, "2:"
#: Integers beyond this (half a million before scaling) count as it: squared distances then fit 64 bits.
LARGEST = 2**27


def integers(cells: pd.Series, size: int = SIZE, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which cells are vectors of `size` components, none null or not finite; and those as integers floor(scale * x)."""
    fits = np.array([x is not None and len(x) == size for x in cells], bool)
    x = np.array([np.asarray(v, np.float64) for v in cells[fits]], np.float64).reshape(-1, size)
    finite = np.isfinite(x).all(1)
    fits[np.flatnonzero(fits)[~finite]] = False
    with np.errstate(over="ignore"):
        return fits, np.clip(np.floor(x[finite] * scale), -LARGEST, LARGEST).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the nearest centroid (ties: the lowest number) and the squared distance."""
    d = np.empty((len(centroids), len(x)), np.int64)
    for c, centroid in enumerate(centroids):
        away = x - centroid
        d[c] = (away * away).sum(1)
    best = d.argmin(0)
    return best, d[best, np.arange(len(x))]


def first_centroids(df: DataFrame, clusters: int = CLUSTERS, salt: str = SALT, size: int = SIZE, scale: int = SCALE) -> np.ndarray:
    """The kept vectors of df (vec_id, vector) with the smallest SHA-256 of salt and vec_id, in that order; ties by their components, null ids last."""

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fits, x = integers(b["vector"], size, scale)
            if len(x):
                yield pd.DataFrame({"vec_id": b["vec_id"][fits].astype("Int64"), "x": list(x)})

    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = df.mapInPandas(kept, "vec_id long, x array<long>").orderBy(key.asc_nulls_last(), "x").limit(clusters).collect()
    return np.array([r["x"] for r in rows], np.int64).reshape(-1, size)


def moved(df: DataFrame, centroids: np.ndarray, size: int = SIZE, scale: int = SCALE) -> np.ndarray:
    """The centroids after one round: the floor of the mean of each one's vectors, or itself if it has none.

    Each task sends one row a centroid, its count and sums; they meet by a groupBy, and the driver gets one row a centroid."""
    model = df.sparkSession.sparkContext.broadcast(centroids)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = np.zeros(len(model.value), np.int64), np.zeros(model.value.shape, np.int64)
        for b in batches:
            _, x = integers(b["vector"], size, scale)
            best, _ = nearest(x, model.value)
            n += np.bincount(best, minlength=len(n))
            np.add.at(s, best, x)
        if len(some := np.flatnonzero(n)):
            yield pd.DataFrame({"cluster": some, "n": n[some], "sums": list(s[some])})

    parts = df.mapInPandas(sums, "cluster int, n long, sums array<long>")
    wide = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")) for i in range(size)]).alias("sums"))
    out = centroids.copy()
    for r in wide.collect():
        out[r["cluster"]] = [int(s) // r["n"] for s in r["sums"]]
    model.unpersist()
    return out


def cluster(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", clusters: int = CLUSTERS, rounds: int = ROUNDS, salt: str = SALT, size: int = SIZE, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Each kept vector's vec_id, cluster and (squared) distance; and the last centroids.

    Kept are vectors of `size` components, none null or not finite; each component x becomes floor(scale * x), beyond +-2**27 that bound. The first centroids are
    the kept vectors with the smallest SHA-256 of salt and vec_id; each of `rounds` rounds assigns every vector to the nearest centroid (ties: the smaller
    number) and moves every centroid that has vectors to the floor of their mean; then vectors are assigned once more. All arithmetic is in integers, so the result
    doesn't depend on how rows are dealt. Fewer kept vectors than clusters give fewer centroids; none give an empty table. Repeated rows each give a row, a null
    vec_id stays null. Only the two columns are read, again in each round: what is broadcast is clusters x size integers.
    """
    small_batches(df.sparkSession)
    d = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    c = first_centroids(d, clusters, salt, size, scale)
    for _ in range(rounds if len(c) else 0):
        c = moved(d, c, size, scale)
    model = df.sparkSession.sparkContext.broadcast(c)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fits, x = integers(b["vector"], size, scale)
            if len(x):
                best, distance = nearest(x, model.value)
                yield pd.DataFrame({"vec_id": b["vec_id"][fits].astype("Int64"), "cluster": best, "distance": distance})

    return d.mapInPandas(assign, "vec_id long, cluster int, distance long"), c


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with cluster_inertia, inertia (distances summed; 2**63 - 1 if they exceed it) and centroid_sha256. One row a cluster is joined by broadcast."""
    most = 2**63 - 1
    assigned = cut(assigned, "assigned")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    of = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(total.alias("d")).collect()}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, min(most, d), min(most, sum(of.values())), sha[c]) for c, d in of.items()]
    facts = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
