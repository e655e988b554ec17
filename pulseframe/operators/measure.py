"""Eleven values of a beat from lead II, and their summary by case.

beats: case_id, beat (place in the case), mv (the page's samples), marks in ms on the page: q_on, s_off, p_on, p_off, t_peak, t_off, p_found, next_q_on (of the next measured beat
of the page, or null), rr_ms, rr_ii_ms, beat_confidence, d_confidence, mv_per_px, shift_mv (of a manual baseline), bad (array of first and last sample of clipped stretches and gaps)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.exprs import clamp01, half_up, median_of
from pulseframe.operators import rhythm
from pulseframe.operators.conclusion import lookup
from pulseframe.plans import constants as C

#: Units by key.
UNITS = {"hrMean": "bpm", "hrMin": "bpm", "hrMax": "bpm", "pDuration": "s", "pAmplitude": "mV", "pq": "s", "q": "mV", "qrs": "s", "r": "mV", "s": "mV", "qt": "s", "qtc": "s", "t": "mV", "st": "mV"}
WAVES = ("pDuration", "pAmplitude", "pq", "q", "qrs", "r", "s", "qt", "qtc", "t", "st")


def place(ms: Column) -> Column:
    """The sample nearest to a time."""
    return half_up(ms * C.HZ / 1000).cast("int")


def _clipped(mv: Column, a: Column, b: Column) -> Column:
    """Samples a to b (from 0), as far as there are any."""
    a, b = F.greatest(F.lit(0), a), F.least(F.size(mv) - 1, b)
    return F.when(b >= a, F.slice(mv, a + 1, F.greatest(F.lit(0), b - a + 1))).otherwise(F.array().cast("array<double>"))


def pq_level(mv: Column, onset: Column) -> Column:
    """The median of the samples just before a QRS onset (a place); the onset's own sample without any."""
    before = _clipped(mv, onset - place(F.lit(C.PQ_FROM)), onset - place(F.lit(C.PQ_TO)))
    return F.when(F.size(before) > 0, median_of(before)).otherwise(F.get(mv, F.greatest(F.lit(0), onset)))


def sampled(beats: DataFrame, species: str | Column = "dog") -> DataFrame:
    """case_id, beat, key, value, reason (of a wave too small to show) and confidence, a row for each value that the beat has.

    R is the greatest sample of the QRS above the PQ level, Q and S the depths before and after it; less than two pixels count as 0. Durations are corrected for the width of
    print. T and ST stand over a level that goes in a line from this to the next PQ level. QTc is for dogs."""
    limit = lambda key: rhythm.limit(species, key)
    dog = F.lit(species == "dog") if isinstance(species, str) else species == "dog"
    mv, n = F.col("mv"), F.size("mv")
    b = beats.withColumn("_q", F.greatest(F.lit(0), place(F.col("q_on")))).withColumn("_s", F.least(n - 1, place(F.col("s_off")))).filter("_s > _q")
    shift = F.coalesce("shift_mv", F.lit(0.0))
    middle = (C.PQ_FROM + C.PQ_TO) / 2 * C.HZ / 1000
    nq = F.greatest(F.lit(0), place(F.col("next_q_on")))
    b = b.withColumns({
        "_base": pq_level(mv, F.col("_q")) - shift, "_at": F.col("_q") - middle, "_next": F.when(F.col("next_q_on").isNotNull(), pq_level(mv, nq) - shift), "_next_at": nq - middle,
        "_least": C.WAVE_PX * F.when(F.col("mv_per_px") > 0, F.col("mv_per_px")).otherwise(C.MV_PER_PX), "_on": F.col("q_on") + limit("widen_on_ms"), "_off": F.col("s_off") - limit("widen_off_ms"),
        "_qrs": F.slice(mv, F.col("_q") + 1, F.col("_s") - F.col("_q") + 1), "confidence": clamp01(F.col("beat_confidence") * F.col("d_confidence")),
    })
    b = b.withColumn("_r", F.array_position("_qrs", F.array_max("_qrs")).cast("int"))  # from 1, the first of equal ones

    def level(i: Column) -> Column:
        w = clamp01((i - F.col("_at")) / (F.col("_next_at") - F.col("_at")))
        return F.when(F.col("_next").isNull() | (F.col("_next_at") <= F.col("_at")), F.col("_base")).otherwise(F.col("_base") + w * (F.col("_next") - F.col("_base")))

    depth = lambda xs: F.col("_base") - F.array_min(xs)
    r, q, s = F.array_max("_qrs") - F.col("_base"), depth(F.slice("_qrs", 1, F.col("_r"))), depth(F.slice("_qrs", F.col("_r"), F.size("_qrs") - F.col("_r") + 1))
    p = _clipped(mv, place(F.col("p_on")), place(F.col("p_off")))
    peak = F.array_position(F.transform(p, lambda x: F.abs(x - F.col("_base"))), F.array_max(F.transform(p, lambda x: F.abs(x - F.col("_base"))))).cast("int")
    found = F.col("p_found") & F.col("p_on").isNotNull() & F.col("p_off").isNotNull()
    qt = (F.col("t_off") - F.col("_on")) / 1000
    ti = F.least(n - 1, F.greatest(F.lit(0), place(F.col("t_peak"))))
    ji = place(F.col("_off") + limit("st_ms"))
    clear = ~F.exists("bad", lambda u: ji.between(u["i0"], u["i1"]))
    big = lambda x: x >= F.col("_least")
    value = {
        "r": F.when(big(r), r).otherwise(0.0), "q": F.when(big(q), -q).otherwise(0.0), "s": F.when(big(s), -s).otherwise(0.0),
        "qrs": F.greatest(F.lit(0.0), F.col("_off") - F.col("_on")) / 1000, "pDuration": F.when(found, (F.col("p_off") - F.col("p_on")) / 1000),
        "pq": F.when(found, F.greatest(F.lit(0.0), F.col("_on") - F.col("p_on")) / 1000), "pAmplitude": F.when(found & (F.size(p) > 1), F.get(p, peak - 1) - F.col("_base")), "qt": qt,
        "qtc": F.when(dog, qt - C.QTC_SLOPE * (F.coalesce("rr_ii_ms", "rr_ms") / 1000 - 1)),
        "t": F.when(F.col("t_peak").isNotNull(), F.get(mv, ti) - level(ti)), "st": F.when((ji > F.col("_s")) & (ji < n) & clear, F.get(mv, ji) - level(ji)),
    }
    absent = {k: F.when(~big(x), f"{k}_absent") for k, x in (("r", r), ("q", q), ("s", s))}
    rows = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value"), absent.get(k, F.lit(None)).cast("string").alias("reason")) for k, v in value.items()])
    return b.select("case_id", "beat", "confidence", F.explode(rows).alias("x")).select("case_id", "beat", "x.*", "confidence").filter("value IS NOT NULL")


def summary(samples: DataFrame) -> DataFrame:
    """case_id, key, value (median), unit, confidence (mean), beats (in order), and the first beat's reason if more than half have one."""
    s = samples.groupBy("case_id", "key").agg(
        F.median("value").alias("value"), clamp01(F.avg("confidence")).alias("confidence"), F.array_sort(F.collect_list("beat")).alias("beats"),
        F.when(2 * F.count("reason") > F.count(F.lit(1)), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("beat")))).alias("reason"),
    )
    return s.withColumn("unit", lookup(UNITS, F.col("key")))


def measured(cases: DataFrame, samples: DataFrame) -> DataFrame:
    """A row for each case and wave: summary's, or without a value and with a reason. cases: case_id, species, n_selected (beats measured), empty_reason (of findings.empty_reason, or no_beats)."""
    each = cases.select("*", F.explode(F.array(*[F.lit(k) for k in WAVES])).alias("key"))
    j = each.join(summary(samples), ["case_id", "key"], "left")
    why = F.when(F.col("n_selected") == 0, F.col("empty_reason")).when(F.col("key").isin("pDuration", "pAmplitude", "pq"), "p_not_found").when(F.col("key").isin("qt", "qtc", "t"), "t_not_found").otherwise("low_confidence")
    cat = (F.col("key") == "qtc") & (F.col("species") == "cat")
    none = F.col("beats").isNull() | cat
    return j.select(
        "case_id", "species", "key", F.when(~cat, F.col("value")).alias("value"), lookup(UNITS, F.col("key")).alias("unit"), F.when(none, 0.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(none, F.array().cast("array<bigint>")).otherwise(F.col("beats")).alias("beats"), F.when(cat, "species_not_applicable").when(F.col("beats").isNull(), why).otherwise(F.col("reason")).alias("reason"),
    )
