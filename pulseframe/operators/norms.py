"""Reference ranges: lookup, classification, number formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.plans import constants as C


def norms(spark: SparkSession) -> DataFrame:
    """The norm table (a few rows)."""
    return spark.createDataFrame(C.NORMS, C.NORM_SCHEMA)


def profile_of(species: Column, size: Column) -> Column:
    """cat, dog-small or dog-large; a dog of unknown size counts as large."""
    return F.when(species == "cat", "cat").when(species == "dog", F.when(size == "small", "dog-small").otherwise("dog-large"))


def verdict(value: Column, low: Column, high: Column, border_low: Column, border_high: Column, rule: Column, r: Column) -> Column:
    """norm, border or abnormal; n/a without a value or a rule. A bound without an explicit border has one OUTWARD of it."""
    x = F.when(rule == "range", value).otherwise(F.abs(value))
    top = F.when((rule == "abs_fraction") & r.isNotNull(), F.least(high, C.T_OF_R * r)).otherwise(high)
    under, over = x < low - C.EPS, x > top + C.EPS
    far_low = F.coalesce(border_low, low - F.abs(low) * C.OUTWARD)
    far_high = F.coalesce(border_high, top + F.abs(top) * C.OUTWARD)
    out = F.coalesce(under & (x < far_low - C.EPS), F.lit(False)) | F.coalesce(over & (x > far_high + C.EPS), F.lit(False))
    off = F.coalesce(under, F.lit(False)) | F.coalesce(over, F.lit(False)) | ((rule == "abs_sign") & (value < 0))
    worst = F.when(out, F.when(rule == "border", "border").otherwise("abnormal"))
    return F.when(value.isNull() | rule.isNull(), "n/a").otherwise(F.coalesce(worst, F.when(off, F.lit("border")).otherwise("norm")))


def classify(measured: DataFrame, spark: SparkSession, keep: bool = False, table: DataFrame | None = None) -> DataFrame:
    """measured (profile, key, value, r) with verdict, and with keep=True the norm's bounds (and other columns of `table`, norms with more columns); keys without a norm are n/a. The norm
    table is a constant of a few rows, so it is broadcast."""
    n = F.broadcast((norms(spark) if table is None else table).drop("unit"))
    m = measured.join(n, ["profile", "key"], "left")
    v = verdict(F.col("value"), F.col("low"), F.col("high"), F.col("border_low"), F.col("border_high"), F.col("rule"), F.col("r"))
    m = m.withColumn("verdict", v)
    return m if keep else m.drop("low", "high", "border_low", "border_high", "rule")


def severity(verdict: Column) -> Column:
    return F.when(verdict == "abnormal", 2).when(verdict == "border", 1).when(verdict == "norm", 0).otherwise(-1)


def worst(classified: DataFrame, key: list[str]) -> DataFrame:
    """The most severe verdict a key."""
    s = classified.groupBy(*key).agg(F.max(severity(F.col("verdict"))).alias("severity"))
    return s.withColumn("verdict", F.when(F.col("severity") == 2, "abnormal").when(F.col("severity") == 1, "border").when(F.col("severity") == 0, "norm").otherwise("n/a"))
