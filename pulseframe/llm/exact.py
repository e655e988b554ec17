"""Exact deduplication by a tree-merge of sorted digest runs (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulseframe.llm.common import SPACES, cut

#: Runs at the leaves of the merge tree, and how many of them meet in one merge.
RUNS, FAN_IN = 256, 4
#: What tells texts apart, and the order in which rows of one text are kept.
KEY, ORDER = ["text_sha256", "check", "bytes"], ["neg", "none", "doc_id", "tie", "row_no"]


def _digests(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, tie, row_no) as written entries: no texts any more, and the run that each belongs to."""
    n = F.translate("text", SPACES, "")
    return cut(
        rows.select(
            "doc_id",
            (-F.length("text")).cast("long").alias("neg"),
            F.col("doc_id").isNull().alias("none"),
            "tie",
            "row_no",
            F.sha2(n.cast("binary"), 256).alias("text_sha256"),
            F.xxhash64(n).alias("check"),
            F.octet_length(n).alias("bytes"),
            F.pmod(F.spark_partition_id(), F.lit(RUNS)).cast("int").alias("run"),
        ),
        "digests",
    )


def merge(runs: DataFrame) -> DataFrame:
    """Each FAN_IN neighbouring runs become one: slices of their digests' range are exchanged and sorted, and where the same digest of several runs
    comes side by side, the smallest entry stays with the sum of their sizes. The second hash and the length must agree as well."""
    at = ["run", "slice", *KEY]
    runs = runs.withColumn("run", F.floor(F.col("run") / FAN_IN).cast("int"))
    runs = runs.repartition("run", "slice").sortWithinPartitions(*at, *ORDER)
    w = W.partitionBy(*at).orderBy(*ORDER)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = runs.withColumn("_place", F.row_number().over(w)).withColumn("size", F.sum("size").over(whole))
    return first.filter("_place = 1").drop("_place")


def _merged(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves (one entry a run and digest), and the root: one entry a digest, the row that stays with the group's size."""
    at = ["run", *KEY]
    # a run holds one entry a digest, sorted; its rows come from few tasks, so most meet before they are exchanged
    leaves = d.groupBy(*at).agg(F.min(F.struct(*ORDER)).alias("best"), F.count(F.lit(1)).alias("size"))
    leaves = cut(leaves.select(*at, F.substring("text_sha256", 1, 4).alias("slice"), "best.*", "size"), "runs")
    merged, width = leaves, RUNS
    while width > 1:
        merged, width = merge(merged), -(-width // FAN_IN)
    return leaves, merged


def _outcome(d: DataFrame) -> DataFrame:
    """d with the row number that stays (best_no), its doc_id (keep_id) and the group's size."""
    at = ["run", *KEY]
    leaves, merged = _merged(d)
    down = leaves.select(*at).join(merged.select(*KEY, F.col("doc_id").alias("keep_id"), F.col("row_no").alias("best_no"), F.col("size").alias("group_size")), KEY)
    return d.join(down, at)


def exact_dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of df: doc_id, keep_id, group_size, kept, text_sha256 and n_chars.

    Texts are equal when they are identical after every white-space character is deleted; a null text counts as empty,
    and all empty texts are one group. The row with the most characters stays, of those the smallest doc_id (a null
    doc_id comes last), of those the smallest hash of the text; of rows that are equal in all that, one stays. Empty tables give no rows. Columns besides
    the two are not read, whatever their names.

    Each partition's rows are a run, sorted by digest, with one entry a digest: the smallest of (-length, doc_id, ...) and a
    count, so a group of any size enters the tree with RUNS entries at most. In each round FAN_IN neighbouring runs (a binomial tree of that radix)
    are exchanged by slices of the digests' range and merged. An entry is verified at every level: it merges only where SHA-256, a second 64-bit hash
    and the length of the normalised text all agree. The outcome goes back down the tree by (run, digest), so that no join has a hot key.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = _digests(df.select(F.col(doc_id).alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("tie"), F.monotonically_increasing_id().alias("row_no")))
    out = _outcome(d)
    return out.select("doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("best_no")).alias("kept"), "text_sha256", (-F.col("neg")).alias("n_chars"))


def drop_copies(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """df without the rows that exact_dedup drops, but for ties: of rows that share doc_id and length, the one with the smallest hash of all columns (maps apart) stays, so
    the outcome does not depend on how the rows are dealt; of wholly equal rows, one stays.

    Texts are shuffled once and never written: the rows that stay are known by two hashes of all their columns, 128 bits."""
    plain = [F.col(f"`{f.name}`") for f in df.schema if "map" not in f.dataType.simpleString()]
    tie, second = F.xxhash64(*plain), F.xxhash64(F.lit(1), *plain, *[c.isNull() for c in plain])
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    merged = _merged(_digests(df.select(F.col(f"`{doc_id}`").alias("doc_id"), t.alias("text"), tie.alias("tie"), second.alias("row_no"))))[1]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), tie.alias("tie"), second.alias("row_no"))
    kept = rows.join(merged.select("tie", "row_no").hint("merge"), ["tie", "row_no"], "left_semi")
    return kept.withColumn("_copy", F.row_number().over(W.partitionBy("tie", "row_no").orderBy("tie"))).filter("_copy = 1").select("row.*")
