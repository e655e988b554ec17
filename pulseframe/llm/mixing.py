"""Mixing sources to target weights by temperature (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulseframe.llm.common import SPACES, cut, digits, numbered, prefix_sums

#: The exponent is searched on the grid k / GRID; LEVELS halvings are made in one look at the sources.
GRID, LEVELS = 1 << 16, 4


def tokens(text: Column) -> Column:
    """A document's length for mixing: its words `[^\\x20\\x09-\\x0D]+`, and one for its end."""
    words = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(words == "", 1).otherwise(F.size(F.split(words, "[\\x20\\x09-\\x0D]+", -1)) + 1).cast("long")


def weights(sizes: DataFrame, entropy: float, repeats: float, budget: float = 1.0) -> DataFrame:
    """Weights of the sources: sizes' columns source and n, and exponent, weight, quota (tokens; budget is in units of all tokens).

    A source's weight is its share of the tokens to the power of an exponent, divided by their sum. The exponent is the largest
    k / GRID in [0, 1] whose weights have an entropy of at least `entropy` times the entropy of equal weights (0 if none has);
    where a source would then be repeated more than `repeats` times, it is the smallest above that at which none is (1 if none).
    Both conditions are monotone in the exponent, so it is found by bisection; each look evaluates the
    2**LEVELS - 1 exponents that LEVELS halvings may meet, and the driver sees these sums only.
    """
    top = sizes.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count(F.lit(1)).alias("k")).first()
    if not top["k"]:
        return sizes.select("source", "n", F.lit(0.0).alias("exponent"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"))
    total, target = float(top["n"]), entropy * math.log(top["k"]) - 1e-12
    share = F.log(F.col("n") / total)

    def look(ks: list[int]) -> dict[int, tuple[float, float, float]]:
        """For each k: the sum of powers, their entropy, and the most that a source is repeated."""
        cols = []
        for k in ks:
            a = k / GRID
            p = F.exp(share * a)
            cols += [F.sum(p).alias(f"z{k}"), F.sum(p * share * a).alias(f"e{k}"), F.max(p / F.col("n")).alias(f"r{k}")]
        r = sizes.agg(*cols).first()
        return {k: (r[f"z{k}"], math.log(r[f"z{k}"]) - r[f"e{k}"] / r[f"z{k}"], r[f"r{k}"] / r[f"z{k}"] * total * budget) for k in ks}

    def bisect(low: int, high: int, right) -> int:
        """The largest k in [low, high] that is right, if all below it are; low if none is."""
        high += 1
        while high - low > 1:
            points = sorted({low + (high - low) * i // (1 << LEVELS) for i in range(1, 1 << LEVELS)} - {low})
            ok = look(points)
            good = [k for k in points if right(ok[k])]
            low, high = max([low, *good]), min([k for k in points if k not in good] + [high])
        return low

    k = bisect(0, GRID, lambda x: x[1] >= target)
    if look([k])[k][2] > repeats + 1e-9:
        # repetition falls as the exponent rises: the last exponent that repeats too much, and one up
        k = min(GRID, bisect(k, GRID, lambda x: x[2] > repeats + 1e-9) + 1)
    z = look([k])[k][0]
    w = F.exp(share * (k / GRID)) / z
    # beyond the repetition limit even at exponent 1 (a budget above `repeats`), a source still gives no more than that
    quota = F.least(F.round(w * total * budget), F.floor(F.col("n") * repeats)).cast("long")
    return sizes.select("source", "n", F.lit(k / GRID).alias("exponent"), w.alias("weight"), quota.alias("quota"))


def mix(df: DataFrame, entropy: float = 0.9, repeats: float = 4.0, budget: float = 1.0, block: int = 1 << 16, seed: str = "mix", text: str = "text", doc_id: str = "doc_id", source: str = "source", keep: bool = False) -> DataFrame:
    """The mixture, one row for each use of a document: doc_id, source, pass, tokens, block, block_pos (and with keep=True, df's row as a struct `row`).

    A source goes through its documents in passes, each a fresh permutation by keyed digest, until its quota of tokens is reached: the
    document at which that happens is the last. A use's place in the whole mixture is its place in its source's quota
    as a fraction; the mixture is cut into blocks of `block` tokens, so each block holds every source at its weight, and a block's uses are
    permuted again (block_pos, from 0). Sums over a source are made in slices of its permutation, so a source of any size is dealt
    over many tasks. A null source is a source of its own, a null text has no words but an end. Rows that repeat in all of
    doc_id, source and text are each used; their order goes by a hash of all columns, so the mixture does not depend on how rows are dealt. An empty table gives an empty mixture. Other columns are not read.
    """
    if keep:
        rows = numbered(df)
        d = rows.select(F.col(f"row.`{doc_id}`").alias("doc_id"), F.col(f"row.`{source}`").alias("source"), F.col(f"row.`{text}`").alias("text"), "tie", "row_no")
    else:
        d = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"), F.lit(0).alias("tie"), F.lit(0).alias("row_no"))
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    row_id = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.col("source"), F.lit("-")), sha))
    d = cut(d.select("doc_id", "source", tokens(F.col("text")).alias("tokens"), row_id.alias("row_id"), "tie", "row_no"), "lengths")
    sizes = cut(d.groupBy("source").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("rows")), "sources")
    w = weights(sizes, entropy, repeats, budget).select(F.col("source").alias("_source"), "n", "quota")
    total, most = (x or 0 for x in sizes.agg(F.sum("n"), F.max("rows")).first())
    blocks = max(1, math.ceil(total * budget / block))
    uses = d.join(w, F.col("source").eqNullSafe(F.col("_source"))).filter("quota > 0")
    uses = uses.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / F.col("n")).cast("long"))))
    uses = uses.withColumn("_key", F.md5(F.concat_ws("|", F.lit(seed), "pass", "row_id")))
    uses = prefix_sums(uses, ["source", "pass"], ["_key", "tie", "row_no"], "tokens", "_before", digits(most))
    uses = uses.withColumn("_at", F.col("pass") * F.col("n") + F.col("_before")).filter("_at < quota")
    uses = uses.withColumn("block", F.least(F.floor(F.col("_at") / F.col("quota") * blocks), F.lit(blocks - 1)).cast("long"))
    inside = W.partitionBy("block").orderBy(F.md5(F.concat_ws("|", "_key", "block")), "_key", "tie", "row_no")
    out = uses.withColumn("block_pos", (F.row_number().over(inside) - 1).cast("long"))
    out = out.select("doc_id", "source", "pass", "tokens", "block", "block_pos", "row_no")
    if not keep:
        return out.drop("row_no")
    return out.join(rows.select("row_no", "row").hint("merge"), "row_no").drop("row_no")
