"""From measured values and findings to table rows and sentences. Wording is plans/phrases.py.

measured: case_id, species, size, key, value (null if there is none), unit, confidence, reason, source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulseframe.functions.exprs import fill, half_up, significant
from pulseframe.operators import norms
from pulseframe.plans import constants as C
from pulseframe.plans import phrases as P

#: Keys whose sign is shown, and the order of the table's rows between rate and axis.
SIGNED = ("axis", "st")
ORDER = ("pDuration", "pAmplitude", "pq", "q", "qrs", "r", "s", "qt", "qtc", "t", "st")


def lookup(table: dict[str, str], code: Column, otherwise: Column | None = None) -> Column:
    """The table's entry for code, else `otherwise`. The tables are constants of a few entries."""
    found = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[code]
    return found if otherwise is None else F.coalesce(found, otherwise)


def num(x: Column, signed: Column | bool = False) -> Column:
    """At most three decimals without trailing zeros, a true minus, and a plus on positive values if signed."""
    text = F.replace(F.regexp_replace(F.format_string("%.3f", x), r"\.?0+$", ""), F.lit("-"), F.lit("−"))
    signed = F.lit(signed) if isinstance(signed, bool) else signed
    return F.when(x.isNotNull(), F.concat(F.when(signed & (x > 0), "+").otherwise(""), text))


def for_unit(x: Column, unit: Column) -> Column:
    """Rounded to what a sheet can show: whole rates, ms and degrees, else two decimals; no negative zero."""
    return F.when(unit.isin("bpm", "ms", "deg"), half_up(x)).otherwise(half_up(x, 2)) + 0.0


def measured_text(x: Column, unit: Column, signed: Column | bool = False) -> Column:
    return num(for_unit(x, unit), signed)


def with_unit(text: Column, unit: Column) -> Column:
    return F.concat_ws("", text, F.when(unit == "deg", "°").otherwise(F.concat(F.lit(" "), unit)))


def core_range(low: Column, high: Column, rule: Column, signed: Column) -> Column:
    """low–high (low…high if signed), ≤ high, ≥ low, or "open"; absolute values and shares of R are named."""
    both = low.isNotNull() & high.isNotNull()
    only = F.when(high.isNotNull(), "≤ ").when(low.isNotNull(), "≥ ").otherwise("open")
    named = F.when(rule == "abs_fraction", f"≤ {C.T_OF_R * 100:g} % of R and absolute ").when(rule.isin("border", "abs_sign"), "absolute ").otherwise("")
    # a missing bound has no text, and concat_ws leaves it out
    return F.concat_ws("", named, F.when(~both, only), num(low, signed), F.when(both, F.when(signed, "…").otherwise("–")), num(high, signed))


def border_range(low: Column, high: Column, rule: Column, signed: Column) -> Column:
    """The explicit borderline zone, or an empty text."""
    parts = F.array_join(F.array_compact(F.array(F.when(low.isNotNull(), F.concat(F.lit("from "), num(low, signed))), F.when(high.isNotNull(), F.concat(F.lit("to "), num(high, signed))))), " and ")
    text = F.when(parts != "", F.concat(F.lit("borderline "), parts)).otherwise("")
    only = F.lit("beyond only borderline")
    return F.when(rule == "border", F.when(text != "", F.concat_ws("; ", text, only)).otherwise(only)).otherwise(text)


def range_text(n: DataFrame) -> DataFrame:
    """The norm table with core, border and text of each range."""
    signed = F.col("key").isin(*SIGNED)
    core, border = core_range(F.col("low"), F.col("high"), F.col("rule"), signed), border_range(F.col("border_low"), F.col("border_high"), F.col("rule"), signed)
    return n.withColumn("core", core).withColumn("border", border).withColumn("text", F.when(F.col("border") != "", F.concat_ws("; ", "core", "border")).otherwise(F.col("core")))


def norms_document(spark: SparkSession) -> str:
    """The ranges as a table in Markdown, a row a parameter and a column a profile. The norm table is a constant of a few rows."""
    rows = {(r["profile"], r["key"]): f"{r['text']} {r['unit']}" for r in range_text(norms.norms(spark)).collect()}
    profiles, keys = (list(dict.fromkeys(k[i] for k in rows)) for i in (0, 1))
    line = lambda cells: "| " + " | ".join(cells) + " |"
    body = [line([P.LABELS.get(k, k), *(rows.get((p, k), P.TABLE["no_norm"]) for p in profiles)]) for k in keys]
    return "\n".join([line(["parameter", *profiles]), line(["---"] * (1 + len(profiles))), *body])


def phrases_document() -> str:
    """The wording as Markdown, a section a table."""
    out = []
    for name, table in vars(P).items():
        if name.isupper():
            items = table.items() if isinstance(table, dict) else enumerate(table) if isinstance(table, tuple) else [("text", table)]
            out += [f"## {name}", *(f"* `{k}`: {v if isinstance(v, str) else ' / '.join(v)}" for k, v in items)]
    return "\n".join(out)


def available(value: Column, confidence: Column) -> Column:
    return F.coalesce(value.isNotNull() & ~F.isnan(value) & (confidence >= C.RELIABLE), F.lit(False))


def reason_text(code: Column) -> Column:
    """A reason in words, by the whole code, then by its part before a colon."""
    return F.coalesce(lookup(P.REASONS, code), lookup(P.REASONS, F.substring_index(code, ":", 1)), F.lit(P.NO_REASON))


def known_reasons(codes: Column) -> Column:
    """The codes that have words, in words."""
    return F.array_compact(F.transform(codes, lambda c: F.coalesce(lookup(P.REASONS, c), lookup(P.REASONS, F.substring_index(c, ":", 1)))))


def side(value: Column, low: Column, high: Column, rule: Column, r: Column) -> Column:
    """above, below, deep (beyond an absolute bound on the negative side), sign (negative where that counts), or inside."""
    absolute = rule.isin("border", "abs_fraction", "abs_sign")
    v = F.when(absolute, F.abs(value)).otherwise(value)
    beyond = F.when(absolute & (value < 0), "deep").otherwise("above")
    yes = lambda c: F.coalesce(c, F.lit(False))
    s = F.when(yes(v > high), beyond).when(yes(v < low), "below").when(yes((rule == "abs_fraction") & (r > 0) & (F.abs(value) > C.T_OF_R * r)), beyond)
    return s.when(yes((rule == "abs_sign") & (value < 0)), "sign").otherwise("inside")


def direction(key: Column, verdict: Column, side_: Column) -> Column:
    """The parameter's own wording, then the common one, then that for inside, then the verdict."""
    code = F.concat_ws("_", verdict, side_)
    own = [F.concat(key, F.lit(":"), code), F.concat(F.lit("default:"), code), F.concat(F.lit("default:"), verdict, F.lit("_inside"))]
    return F.coalesce(*[lookup(P.DIRECTIONS, c) for c in own], verdict)


def parameter_rows(measured: DataFrame, spark: SparkSession, keep: tuple[str, ...] = ()) -> DataFrame:
    """case_id, key, label, value, norm, verdict, note, side and text_value (with the share of R), for keys of any kind but the rate's, and the columns of `keep` as they came. A cat has no qtc row.

    A case's R comes by a window over its rows, not by a join: planned sizes don't count the rows of an exploded case, so a join would be broadcast. What only the norm says is worded in the norm table."""
    m = measured.filter(~((F.col("key") == "qtc") & (F.col("species") == "cat"))).withColumn("profile", norms.profile_of(F.col("species"), F.col("size")))
    ok = available(F.col("value"), F.col("confidence"))
    m = m.withColumn("r", F.max(F.when((F.col("key") == "r") & ok, F.col("value"))).over(W.partitionBy("case_id"))).withColumn("_ok", ok)
    m = norms.classify(m, spark, keep=True, table=range_text(norms.norms(spark)).drop("border", "text"))
    signed, unit = F.col("key").isin(*SIGNED), F.col("unit")
    m = m.withColumn("_norm", F.when(F.col("rule").isNull(), P.TABLE["no_norm"]).otherwise(with_unit(F.col("core"), unit)))
    m = m.withColumn("_side", F.when(F.col("rule").isNull(), "inside").otherwise(side(F.col("value"), F.col("low"), F.col("high"), F.col("rule"), F.col("r"))))
    m = m.withColumn("_shown", with_unit(num(for_unit(F.col("value"), unit), signed), unit))
    m = m.withColumn("_pct", F.when((F.col("rule") == "abs_fraction") & (F.col("r") > 0), fill(F.lit(P.TABLE["share"]), {"pct": half_up(F.abs("value") / F.col("r") * 100).cast("long")})))
    unsure = F.when(F.col("reason").isNotNull(), reason_text(F.col("reason"))).otherwise(fill(F.lit(P.TABLE["confidence"]), {"confidence": num(half_up(F.coalesce("confidence", F.lit(0.0)), 2))}))
    ok = F.col("_ok")
    return m.select(
        "case_id", "key", lookup(P.LABELS, F.col("key"), F.col("key")).alias("label"), F.when(ok, F.col("_shown")).otherwise(P.TABLE["unreliable"]).alias("value"), F.col("_norm").alias("norm"),
        F.when(ok, F.col("verdict")).otherwise("n/a").alias("verdict"), F.when(ok, F.coalesce("_pct", F.lit(""))).otherwise(unsure).alias("note"), F.when(ok, F.col("_side")).otherwise("inside").alias("side"),
        F.when(ok, F.when(F.col("_pct").isNotNull(), F.concat("_shown", F.lit(" ("), "_pct", F.lit(")"))).otherwise(F.col("_shown"))).otherwise("").alias("text_value"), *keep,
    )


def rate_rows(rates: DataFrame, spark: SparkSession) -> DataFrame:
    """case_id, value, norm, verdict, note and sentence of the heart rate. rates: case_id, species, size, hr_mean, hr_min, hr_max with their confidences c_mean, c_min, c_max, and reason."""
    m = rates.withColumn("profile", norms.profile_of(F.col("species"), F.col("size"))).withColumn("key", F.lit("hrMean")).withColumn("value", F.col("hr_mean")).withColumn("r", F.lit(None).cast("double"))
    m = norms.classify(m, spark, keep=True)
    bpm = F.lit("bpm")
    ok = available(F.col("hr_mean"), F.col("c_mean"))
    both = available(F.col("hr_min"), F.col("c_min")) & available(F.col("hr_max"), F.col("c_max"))
    mean, low, high = (measured_text(F.col(c), bpm) for c in ("hr_mean", "hr_min", "hr_max"))
    span = F.concat(low, F.lit("–"), high)
    norm = F.when(F.col("rule").isNull(), P.TABLE["no_norm"]).otherwise(with_unit(core_range(F.col("low"), F.col("high"), F.col("rule"), F.lit(False)), bpm))
    kind = F.when(F.col("verdict") == "abnormal", F.concat(F.lit("abnormal_"), side(F.col("hr_mean"), F.col("low"), F.col("high"), F.col("rule"), F.lit(None).cast("double")))).otherwise(F.col("verdict"))
    words = {"mean": mean, "min": low, "max": high, "norm": norm, "verdict": lookup(P.HR, kind, F.lit("")), "range": F.when(both, F.concat(F.lit(" ("), span, F.lit(")"))).otherwise("")}
    text = F.when(~ok, P.HR["unreliable"]).when(F.col("rule").isNull(), fill(F.lit(P.HR["no_norm"]), words)).otherwise(fill(F.when(both, P.HR["range"]).otherwise(P.HR["mean"]), words))
    unsure = F.when(F.col("reason").isNotNull(), reason_text(F.col("reason"))).otherwise(fill(F.lit(P.TABLE["confidence"]), {"confidence": num(half_up(F.coalesce("c_mean", F.lit(0.0)), 2))}))
    return m.select(
        "case_id", F.when(ok, with_unit(F.when(both, F.concat(mean, F.lit(" ("), span, F.lit(")"))).otherwise(mean), bpm)).otherwise(P.TABLE["unreliable"]).alias("value"), norm.alias("norm"),
        F.when(ok, F.col("verdict")).otherwise("n/a").alias("verdict"), F.when(ok, "").otherwise(unsure).alias("note"), text.alias("sentence"),
    )


def axis_rows(axes: DataFrame, spark: SparkSession) -> DataFrame:
    """case_id, value, norm, verdict, note and sentence of the axis. axes: case_id, species, size, axis (null if undefined)."""
    m = axes.withColumn("profile", norms.profile_of(F.col("species"), F.col("size"))).withColumn("key", F.lit("axis")).withColumn("value", F.col("axis")).withColumn("r", F.lit(None).cast("double"))
    m = norms.classify(m, spark, keep=True)
    deg = F.lit("deg")
    norm = F.when(F.col("rule").isNull(), P.TABLE["no_norm"]).otherwise(with_unit(core_range(F.col("low"), F.col("high"), F.col("rule"), F.lit(True)), deg))
    ok = F.col("axis").isNotNull() & ~F.isnan("axis")
    shown = with_unit(measured_text(F.col("axis"), deg, True), deg)
    kind = F.when(F.col("verdict") == "abnormal", F.concat(F.lit("abnormal_"), side(F.col("axis"), F.col("low"), F.col("high"), F.col("rule"), F.lit(None).cast("double")))).otherwise(F.col("verdict"))
    text = F.when(ok, fill(lookup(P.AXIS, kind, F.lit(P.AXIS["n/a"])), {"value": shown, "norm": norm})).otherwise(P.AXIS["none"])
    return m.select(
        "case_id", F.when(ok, shown).otherwise(P.TABLE["unreliable"]).alias("value"), norm.alias("norm"), F.when(ok, F.col("verdict")).otherwise("n/a").alias("verdict"),
        F.when(ok, "").otherwise(P.TABLE["no_axis"]).alias("note"), text.alias("sentence"),
    )


def coupling_text(least: Column, most: Column, mean: Column) -> Column:
    ms = F.lit("ms")
    words = {"value": measured_text(least, ms), "min": measured_text(least, ms), "max": measured_text(most, ms), "mean": measured_text(mean, ms)}
    return fill(F.when(least == most, P.ECTOPICS["single"]).otherwise(P.ECTOPICS["many"]), words)


def ectopic_items(found: DataFrame) -> DataFrame:
    """case_id and text: kinds (SVE, VE, others by first beat), each with its count, foci (counted if there are several, in order of first beat) and coupling.
    found: case_id, beat (place in the case), kind, focus, coupling_ms."""
    f = found.withColumn("focus", lookup(P.FOCI, F.col("focus"), F.lit(P.FOCI["unknown"])))
    foci = f.groupBy("case_id", "kind", "focus").agg(F.count(F.lit(1)).alias("c"), F.min("beat").alias("seen"))
    foci = foci.groupBy("case_id", "kind").agg(F.array_sort(F.collect_list(F.struct("seen", "focus", "c"))).alias("all"))
    named = F.when(F.size("all") == 1, F.col("all")[0]["focus"]).otherwise(F.array_join(F.transform("all", lambda x: F.concat_ws(" ", x["c"].cast("string"), x["focus"])), ", "))
    k = f.groupBy("case_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("beat").alias("seen"), F.min("coupling_ms").alias("lo"), F.max("coupling_ms").alias("hi"), F.avg("coupling_ms").alias("mean"))
    k = k.join(foci.select("case_id", "kind", named.alias("foci")), ["case_id", "kind"])
    one, many = (lookup({c: v[i] for c, v in P.KINDS.items()}, F.col("kind"), F.col("kind")) for i in (0, 1))
    words = {"count": F.col("n"), "kind": F.when(F.col("n") == 1, one).otherwise(many), "foci": F.col("foci"), "coupling": F.coalesce(coupling_text(F.col("lo"), F.col("hi"), F.col("mean")), F.lit(P.NO_REASON))}
    place = F.when(F.col("kind") == "SVE", 0).when(F.col("kind") == "VE", 1).otherwise(2)
    k = k.select("case_id", F.struct(place.alias("place"), "seen", fill(F.lit(P.ECTOPICS["item"]), words).alias("text")).alias("item"))
    return k.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["text"]), "; ").alias("text"))


def episode_items(found: DataFrame) -> DataFrame:
    """case_id, n and text of a case's episodes in order of start. found: case_id, start_ms, duration_ms, n, kind, focus, coupling_ms."""
    s, ms = F.lit("s"), F.lit("ms")
    words = {
        "kind": lookup(P.EPISODE_KINDS, F.col("kind"), F.lit("episode")), "start": measured_text(F.col("start_ms") / 1000, s), "duration": measured_text(F.col("duration_ms") / 1000, s),
        "beats": F.concat(F.col("n"), F.when(F.col("n") == 1, " beat").otherwise(" beats")), "focus": lookup(P.FOCI, F.col("focus"), F.lit(P.FOCI["unknown"])), "coupling": measured_text(F.col("coupling_ms"), ms),
    }
    e = found.select("case_id", F.struct("start_ms", "n", fill(F.lit(P.EPISODES["item"]), words).alias("text")).alias("item"))
    return e.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["text"]), "; ").alias("text"))


def precision_sentence(mv: Column, ms: Column) -> Column:
    """From the coarsest sheet's mV and ms a pixel (null or 0: unknown): two significant digits, and their double."""
    short = lambda x: F.regexp_replace(x.cast("decimal(18,9)").cast("string"), r"\.?0+$", "")
    two = lambda x: significant(x).cast("decimal(18,9)")
    known = fill(F.lit(P.PRECISION["known"]), {"mv": short(two(mv)), "ms": short(two(ms)), "mv2": short(two(mv) * 2), "ms2": short(two(ms) * 2)})
    return F.when((mv > 0) & (ms > 0), known).otherwise(P.PRECISION["unknown"])


def rhythm_sentence(kind: Column, reasons: Column) -> Column:
    """The type of rhythm, with its known reasons unless it is sinus rhythm; counted P waves keep their numbers."""
    base = lookup(P.RHYTHM, kind, F.lit(P.RHYTHM["undetermined"]))
    pattern = r"^p_not_all:(\d+)/(\d+)$"
    word = lambda c: F.when(c.rlike(pattern), fill(F.lit(P.P_COUNTED), {"found": F.regexp_extract(c, pattern, 1), "total": F.regexp_extract(c, pattern, 2)})).otherwise(F.get(known_reasons(F.array(c)), 0))
    said = F.array_compact(F.transform(reasons, word))
    return F.when((kind == "sinus") | (F.size(said) == 0), base).otherwise(F.concat(base, F.lit(" ("), F.array_join(said, ", "), F.lit(")")))


def beats_unreliable(n_beats: Column, n_leads: Column, n_reliable: Column, reasons: Column) -> Column:
    """Why a case without ectopic beats can't be called free of them, or null."""
    own = F.get(F.filter(reasons, lambda c: c.isin("no_beats", "no_signals")), 0)
    return F.coalesce(own, F.when(n_beats == 0, "no_beats").when(n_leads == 0, "no_signals").when(n_reliable == 0, "all_leads_unreliable"))


def compose(cases: DataFrame, rows: DataFrame, rates: DataFrame, axes: DataFrame, ectopics: DataFrame, episodes: DataFrame) -> DataFrame:
    """case_id and text: a case's lines in order, joined by line ends.

    cases: case_id, species, type, reasons, sinus_arrhythmia, pauses (array of start_ms, duration_ms), n_beats, n_leads, n_reliable, n_pages, seconds, minutes, drugs, flags, mv_per_px, ms_per_px, first_reason.
    rows, rates, axes: of parameter_rows, rate_rows, axis_rows; ectopics and episodes: of ectopic_items and episode_items."""
    item = fill(F.lit(P.DEVIATIONS["item"]), {"label": F.col("label"), "value": F.col("text_value"), "direction": direction(F.col("key"), F.col("verdict"), F.col("side")), "norm": F.col("norm")})
    place = F.array_position(F.array(*[F.lit(k) for k in ORDER]), F.col("key"))
    said = lambda test, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct(place.alias("no"), text.alias("t"))))), lambda x: x["t"]), "; ")
    unsure = F.col("value") == P.TABLE["unreliable"]
    d = rows.groupBy("case_id").agg(
        said(F.col("verdict") == "abnormal", item).alias("abnormal"), said(F.col("verdict") == "border", item).alias("border"),
        said(unsure, F.col("label")).alias("unsure"), F.count_if(~unsure).alias("sure"),
    )
    c = cases.join(d, "case_id", "left").join(rates.select("case_id", F.col("sentence").alias("rate"), F.col("value").alias("rate_value")), "case_id").join(axes.select("case_id", F.col("sentence").alias("axis")), "case_id")
    c = c.join(ectopics.select("case_id", F.col("text").alias("ectopics")), "case_id", "left").join(episodes.select("case_id", F.col("n").alias("n_episodes"), F.col("text").alias("episodes")), "case_id", "left")
    bad = beats_unreliable(F.col("n_beats"), F.col("n_leads"), F.col("n_reliable"), F.col("reasons"))
    s, ms = F.lit("s"), F.lit("ms")
    none_measured = (F.coalesce("sure", F.lit(0)) == 0) & (F.col("rate_value") == P.TABLE["unreliable"])
    pages = F.concat(F.col("n_pages"), F.when(F.col("n_pages") == 1, " sheet").otherwise(" sheets"))
    words = {"pages": pages, "seconds": measured_text(F.col("seconds"), s), "minutes": measured_text(F.col("minutes"), F.lit("min"))}
    flags = F.array_compact(F.transform("flags", lambda f: lookup(P.FLAGS, f)))
    drugs = F.trim(F.coalesce("drugs", F.lit("")))
    tail = F.array(
        F.when(drugs == "", P.DRUGS["none"]).otherwise(fill(F.lit(P.DRUGS["given"]), {"drugs": drugs})),
        F.when(F.col("minutes").isNull(), fill(F.lit(P.RECORD["plain"]), words)).otherwise(fill(F.lit(P.RECORD["minutes"]), words)),
        F.when(F.size(flags) > 0, fill(F.lit(P.FLAG_LIST), {"items": F.array_join(flags, "; ")})),
        precision_sentence(F.col("mv_per_px"), F.col("ms_per_px")), F.lit(P.VERIFY),
    )
    pauses = F.transform("pauses", lambda p: fill(F.lit(P.PAUSE), {"duration": measured_text(p["duration_ms"], ms), "start": measured_text(p["start_ms"] / 1000, s)}))
    why = {"reason": reason_text(bad)}
    main = F.concat(
        F.array(F.concat(rhythm_sentence(F.col("type"), F.col("reasons")), F.lit(". "), F.col("rate")), F.when(F.col("sinus_arrhythmia") & (F.size("pauses") == 0), lookup(P.ARRHYTHMIA, F.col("species")))), pauses,
        F.array(
            F.col("axis"),
            F.when(F.coalesce("abnormal", F.lit("")) == "", P.DEVIATIONS["none"]).otherwise(fill(F.lit(P.DEVIATIONS["list"]), {"items": F.col("abnormal")})),
            F.when(F.col("border") != "", fill(F.lit(P.DEVIATIONS["border"]), {"items": F.col("border")})),
            F.when(bad.isNotNull(), fill(F.lit(P.ECTOPICS["unreliable"]), why)).when(F.col("ectopics").isNull(), P.ECTOPICS["none"]).otherwise(fill(F.lit(P.ECTOPICS["list"]), {"items": F.col("ectopics")})),
            F.when(bad.isNotNull(), fill(F.lit(P.EPISODES["unreliable"]), why)).when(F.col("episodes").isNull(), P.EPISODES["none"]).otherwise(fill(F.lit(P.EPISODES["list"]), {"count": F.col("n_episodes"), "items": F.col("episodes")})),
            F.when((F.col("unsure") != "") | (F.col("rate_value") == P.TABLE["unreliable"]), fill(F.lit(P.UNRELIABLE), {"items": F.array_join(F.array_compact(F.array(F.when(F.col("rate_value") == P.TABLE["unreliable"], P.LABELS["hr"]), F.when(F.col("unsure") != "", F.replace("unsure", F.lit("; "), F.lit(", "))))), ", ")})),
        ),
    )
    nothing = F.array(fill(F.lit(P.IMPOSSIBLE), {"reason": F.coalesce(reason_text(F.col("first_reason")), F.lit(P.NO_REASON))}))
    return c.select("case_id", F.array_join(F.array_compact(F.concat(F.when(none_measured, nothing).otherwise(main), tail)), "\n").alias("text"))
