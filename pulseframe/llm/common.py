"""What the corpus operators share: tables, batch sizes, and sums within hot keys."""

from __future__ import annotations

import math
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions.shared import cut, drop, shared_dir  # noqa: F401

#: White space as the operators' contracts define it: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"

# Functions travel to the executors by value: they need no copy of this package there.
cloudpickle.register_pickle_by_value(sys.modules["pulseframe"])


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 256 rows and 16 MB (or one row): a batch of very long texts then still fits a Python worker. Every operator sets the same."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame) -> DataFrame:
    """df's rows as a struct `row`, each with a number of its own, `row_no`, and `tie`, a hash of all its columns (maps apart) that orders rows which an
    operator can't tell apart; written, so that the numbers hold."""
    plain = [F.col(f"`{f.name}`") for f in df.schema if "map" not in f.dataType.simpleString()]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return cut(df.select(row.alias("row"), F.xxhash64(*plain).alias("tie"), F.monotonically_increasing_id().alias("row_no")), "numbered")


def digits(rows: int, a_task: int = 500_000) -> int:
    """How many hexadecimal digits deal so many rows into slices of about `a_task` rows or fewer; two at least."""
    return max(2, math.ceil(math.log(max(1, rows / a_task), 16)))


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents that no classifier may learn from; a null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def learning_keys(df: DataFrame, rows: int, chars: int, classes: int) -> DataFrame:
    """Which texts to learn from: label and key, of df's rows (label, key, chars: a text's hash and length; label not null). Equal texts of a label count
    once, so repeated rows and copies take no other text's place. Of the `classes` labels with the most rows (ties by label), it takes the texts with the
    smallest keys: `rows` a label at most, and no text more once they have `chars` characters together.

    Keys below a bound that leaves a little more than `rows` texts go on, from all tasks, before they are ranked: no task sees more of a label."""
    from pyspark.sql import Window as W

    found = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("key", 0.02).alias("texts")).orderBy(F.desc("n"), "label").limit(classes).collect()
    bound = F.lit(None).cast("double")
    for r in found:
        share = min(1.0, 1.1 * (rows + 5 * rows**0.5 + 20) / max(1, r["texts"]))
        bound = F.when(F.col("label") == F.lit(r["label"]), F.lit(share * 2.0**64 - 2.0**63)).otherwise(bound)
    some = df.filter(F.col("key").cast("double") <= bound).groupBy("label", "key").agg(F.max("chars").alias("chars"))
    w = W.partitionBy("label").orderBy("key")
    some = some.withColumn("_no", F.row_number().over(w)).withColumn("_before", F.coalesce(F.sum("chars").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return some.filter((F.col("_no") <= rows) & (F.col("_before") < chars)).select("label", "key")


def learning_rows(df: DataFrame, labels: DataFrame | None, rows: int, chars: int, classes: int) -> DataFrame:
    """The texts that learning_keys chooses: label, key, text. df has text, and label or, with labels (doc_id, label), doc_id. Texts are not shuffled: ids and hashes
    choose the keys, at most `rows` a class, and those are broadcast to a second reading of the texts."""
    d = df.withColumn("key", F.xxhash64("text")).withColumn("chars", F.length("text").cast("long"))
    named = d.select("label", "key", "chars") if labels is None else d.select("doc_id", "key", "chars").join(labels.hint("merge"), "doc_id").select("label", "key", "chars")
    chosen = learning_keys(named, rows, chars, classes)
    texts = d.select(*(["label"] if labels is None else []), "key", "text")
    return texts.join(F.broadcast(chosen), ["label", "key"] if labels is None else ["key"]).dropDuplicates(["label", "key"]).select("label", "key", "text")


def flat_lists(column) -> tuple:
    """A column of lists as NumPy: all values, and where each list begins (with the end as last entry)."""
    column = column.combine_chunks()
    at = column.offsets.to_numpy()
    return column.values.to_numpy(), at


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def prefix_sums(df: DataFrame, group: list[str], order: list[str], amount: str, into: str, bits: int = 2) -> DataFrame:
    """Add `into`, the sum of `amount` over the rows of the same group that come before in `order`, with no group
    held in one task: order[0] must be a column of lowercase hexadecimal text, evenly spread, whose first `bits` characters
    deal a group's rows into 16**bits ordered slices; slices are summed apart and then offset."""
    from pyspark.sql import Window as W

    s = df.withColumn("_slice", F.substring(order[0], 1, bits))
    # one row a (group, slice): 16**bits rows a group at most
    sums = s.groupBy(*group, "_slice").agg(F.sum(amount).alias("_sum"))
    before = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("_off", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    offsets = offsets.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_slice").alias("_s"), "_off")
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_slice") == F.col("_s")]
    inside = W.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inner = s.withColumn("_in", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    on = same[0]
    for c in same[1:]:
        on = on & c
    out = inner.join(offsets, on, "inner")
    return out.withColumn(into, F.col("_in") + F.col("_off")).drop("_slice", "_s", "_in", "_off", *[f"_g{i}" for i in range(len(group))])


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
