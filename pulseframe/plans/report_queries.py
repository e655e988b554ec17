"""Registered queries on conclusions, views and edits, bound to customers, conversations, orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.operators import conclusion, edits, norms, views
from pulseframe.plans import constants as C
from pulseframe.plans import phrases as P
from pulseframe.plans.registry import query
from pulseframe.sources import tables as T


def _case(values: dict[str, str], code: str, other: str = "NULL") -> str:
    """A dictionary in SQL."""
    quote = lambda x: x.replace("'", "''")
    return f"(CASE {code} " + " ".join(f"WHEN '{quote(k)}' THEN '{quote(v)}'" for k, v in values.items()) + f" ELSE {other} END)"


def _num(x: str, signed: str = "false") -> str:
    return f"(CASE WHEN {signed} AND {x} > 0 THEN '+' ELSE '' END || replace(regexp_replace(printf('%.3f', {x}), '\\.?0+$', ''), '-', '−'))"


def _shown(x: str, unit: str, signed: str = "false") -> str:
    return _num(f"(CASE WHEN {unit} IN ('bpm', 'ms', 'deg') THEN floor({x} + 0.5) ELSE floor({x} * 100 + 0.5) / 100 END + 0.0::DOUBLE)", signed)


def _core(signed: str) -> str:
    lo, hi = _num("lo", signed), _num("hi", signed)
    return f"""(CASE WHEN rule = 'abs_fraction' THEN '≤ 25 % of R and ' ELSE '' END || CASE WHEN rule IN ('border', 'abs_fraction', 'abs_sign') THEN 'absolute ' ELSE '' END
|| CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN {lo} || CASE WHEN {signed} THEN '…' ELSE '–' END || {hi} WHEN hi IS NOT NULL THEN '≤ ' || {hi} WHEN lo IS NOT NULL THEN '≥ ' || {lo} ELSE 'open' END)"""


NORMS = "n AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in r) + ")" for r in C.NORMS) + ") AS n(profile, key, nunit, lo, hi, bl, bh, rule))"
WAVES = [("pDuration", 1, 0.04, 0.002, "s"), ("pAmplitude", 2, 0.2, 0.03, "mV"), ("pq", 3, 0.1, 0.006, "s"), ("q", 4, -0.3, 0.06, "mV"), ("qrs", 5, 0.05, 0.003, "s"), ("r", 6, 1.5, 0.15, "mV"), ("s", 7, -0.2, 0.02, "mV"), ("qt", 8, 0.19, 0.01, "s"), ("qtc", 9, 0.2, 0.01, "s"), ("t", 10, 0.1, 0.09, "mV"), ("st", 11, 0.01, 0.02, "mV")]
CASES = """WITH c AS (SELECT c_custkey AS case_id, CASE WHEN c_custkey % 3 = 0 THEN 'cat' ELSE 'dog' END AS species, CASE WHEN c_custkey % 4 = 1 THEN 'small' ELSE 'large' END AS size FROM customer),
p AS (SELECT *, CASE WHEN species = 'cat' THEN 'cat' WHEN size = 'small' THEN 'dog-small' ELSE 'dog-large' END AS profile FROM c),
k AS (SELECT * FROM (VALUES """ + ", ".join(f"('{k}', {no}, {base}::DOUBLE, {step}::DOUBLE, '{unit}')" for k, no, base, step, unit in WAVES) + f""") AS k(key, no, base, step, unit)),
m AS (SELECT p.*, key, no, unit, CASE WHEN (case_id + no) % 13 <> 0 THEN base + ((case_id * (no + 3)) % 17 - 8) * step END AS value, 1 - ((case_id * 2 + no) % 8) / 10.0::DOUBLE AS confidence,
  CASE WHEN (case_id + no) % 5 = 0 THEN 'low_confidence' WHEN (case_id + no) % 11 = 0 THEN 'odd:code' END AS reason FROM p, k),
{NORMS}
"""
VERDICT = """CASE WHEN value IS NULL OR rule IS NULL THEN 'n/a'
  WHEN (x < lo - 1e-9 AND x < coalesce(bl, lo - abs(lo) * 0.1) - 1e-9) OR (x > top + 1e-9 AND x > coalesce(bh, top + abs(top) * 0.1) + 1e-9) THEN CASE WHEN rule = 'border' THEN 'border' ELSE 'abnormal' END
  WHEN x < lo - 1e-9 OR x > top + 1e-9 OR (rule = 'abs_sign' AND value < 0) THEN 'border' ELSE 'norm' END"""


def _cases(spark, sf):
    c = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"))
    return c.withColumn("species", F.when(F.col("case_id") % 3 == 0, "cat").otherwise("dog")).withColumn("size", F.when(F.col("case_id") % 4 == 1, "small").otherwise("large"))


def _measured(spark, sf):
    i = F.col("case_id")
    each = [F.struct(F.lit(k).alias("key"), F.lit(no).alias("no"), F.when((i + no) % 13 != 0, base + ((i * (no + 3)) % 17 - 8) * step).alias("value"), F.lit(unit).alias("unit"), (1 - ((i * 2 + no) % 8) / 10.0).alias("confidence"), F.when((i + no) % 5 == 0, "low_confidence").when((i + no) % 11 == 0, "odd:code").alias("reason")) for k, no, base, step, unit in WAVES]
    return _cases(spark, sf).select("case_id", "species", "size", F.explode(F.array(*each)).alias("x")).select("case_id", "species", "size", "x.*")


ROWS = CASES + f""", r AS (SELECT case_id, value AS r FROM m WHERE key = 'r' AND value IS NOT NULL AND confidence >= 0.6),
a AS (SELECT m.*, n.lo, n.hi, n.bl, n.bh, n.rule, r.r, m.value IS NOT NULL AND confidence >= 0.6 AS ok, key = 'st' AS signed, CASE WHEN rule = 'range' THEN value ELSE abs(value) END AS x,
  CASE WHEN rule = 'abs_fraction' AND r.r IS NOT NULL THEN least(hi, 0.25 * r.r) ELSE hi END AS top FROM m LEFT JOIN n USING (profile, key) LEFT JOIN r USING (case_id) WHERE NOT (key = 'qtc' AND species = 'cat')),
b AS (SELECT *, {VERDICT} AS v, {_shown('value', 'unit', 'signed')} || ' ' || unit AS shown, CASE WHEN rule = 'abs_fraction' AND r > 0 THEN (floor(abs(value) / r * 100 + 0.5)::BIGINT)::VARCHAR || ' % of R' END AS pct FROM a),
rows AS (SELECT case_id, key, no, {_case(P.LABELS, 'key')} AS label, CASE WHEN ok THEN shown ELSE 'unreliable' END AS value, CASE WHEN rule IS NULL THEN 'no range' ELSE {_core('signed')} || ' ' || unit END AS norm,
  CASE WHEN ok THEN v ELSE 'n/a' END AS verdict,
  CASE WHEN ok THEN coalesce(pct, '') WHEN reason IS NOT NULL THEN coalesce({_case(P.REASONS, "reason")}, {_case(P.REASONS, "split_part(reason, ':', 1)")}, 'reason unknown') ELSE 'confidence ' || {_num('floor(confidence * 100 + 0.5) / 100')} END AS note,
  CASE WHEN NOT ok OR rule IS NULL THEN 'inside' WHEN CASE WHEN rule IN ('border', 'abs_fraction', 'abs_sign') THEN abs(b.value) ELSE b.value END > hi OR (rule = 'abs_fraction' AND r > 0 AND abs(b.value) > 0.25 * r) THEN CASE WHEN rule <> 'range' AND b.value < 0 THEN 'deep' ELSE 'above' END
    WHEN b.value < lo THEN 'below' WHEN rule = 'abs_sign' AND b.value < 0 THEN 'sign' ELSE 'inside' END AS side,
  CASE WHEN NOT ok THEN '' WHEN pct IS NULL THEN shown ELSE shown || ' (' || pct || ')' END AS text_value FROM b)"""


@query(f"WITH {NORMS}, x AS (SELECT *, key IN ('axis', 'st') AS signed FROM n), y AS (SELECT *, {_core('signed')} AS core, array_to_string(list_filter([CASE WHEN bl IS NOT NULL THEN 'from ' || {_num('bl', 'signed')} END, CASE WHEN bh IS NOT NULL THEN 'to ' || {_num('bh', 'signed')} END], lambda v: v IS NOT NULL), ' and ') AS z FROM x), w AS (SELECT *, CASE WHEN rule = 'border' THEN 'beyond only borderline' WHEN z <> '' THEN 'borderline ' || z ELSE '' END AS border FROM y) SELECT profile, key, core, border, CASE WHEN border <> '' THEN core || '; ' || border ELSE core END AS text FROM w")
def norm_texts(spark, sf):
    return conclusion.range_text(norms.norms(spark)).select("profile", "key", "core", "border", "text")


@query(ROWS + " SELECT case_id, key, label, value, norm, verdict, note, side, text_value FROM rows")
def conclusion_rows(spark, sf):
    return conclusion.parameter_rows(_measured(spark, sf), spark)


DIRECTION = f"""coalesce({_case(P.DIRECTIONS, "key || ':' || verdict || '_' || side")}, {_case(P.DIRECTIONS, "'default:' || verdict || '_' || side")}, {_case(P.DIRECTIONS, "'default:' || verdict || '_inside'")}, verdict)"""


@query(ROWS + f""" SELECT case_id, string_agg(label || ' ' || text_value || ', ' || {DIRECTION} || ' (range ' || norm || ')', '; ' ORDER BY no) AS deviations FROM rows WHERE verdict IN ('abnormal', 'border') GROUP BY case_id""")
def deviations(spark, sf):
    r = conclusion.parameter_rows(_measured(spark, sf), spark).filter("verdict IN ('abnormal', 'border')")
    place = F.array_position(F.array(*[F.lit(k) for k in conclusion.ORDER]), F.col("key"))
    item = F.concat(F.col("label"), F.lit(" "), F.col("text_value"), F.lit(", "), conclusion.direction(F.col("key"), F.col("verdict"), F.col("side")), F.lit(" (range "), F.col("norm"), F.lit(")"))
    g = r.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("no"), item.alias("t")))).alias("xs"))
    return g.select("case_id", F.array_join(F.transform("xs", lambda x: x["t"]), "; ").alias("deviations"))


@query(CASES + f""", h AS (SELECT *, CASE WHEN case_id % 9 = 0 THEN NULL ELSE 50 + case_id % 200 + 0.25::DOUBLE END AS mean, 1 - case_id % 6 / 10.0::DOUBLE AS c, case_id % 5 <> 0 AS ranged FROM p),
x AS (SELECT h.*, lo, hi, bl, bh, rule, mean AS value, mean AS x, hi AS top, mean IS NOT NULL AND c >= 0.6 AS ok, mean - 10 AS mn, mean + 15 AS mx FROM h LEFT JOIN n ON n.profile = h.profile AND n.key = 'hrMean'),
y AS (SELECT *, {VERDICT} AS v, {_core('false')} || ' bpm' AS norm, {_shown('mean', "'bpm'")} AS tm, {_shown('mn', "'bpm'")} AS tn, {_shown('mx', "'bpm'")} AS tx FROM x)
SELECT case_id, norm, CASE WHEN ok THEN v ELSE 'n/a' END AS verdict, CASE WHEN NOT ok THEN 'unreliable' WHEN ranged THEN tm || ' (' || tn || '–' || tx || ') bpm' ELSE tm || ' bpm' END AS value,
CASE WHEN ok THEN '' ELSE 'no beats found' END AS note,
CASE WHEN NOT ok THEN 'Rate not determined.' ELSE 'Rate ' || tm || ' bpm' || CASE WHEN ranged THEN ' (' || tn || ' to ' || tx || ')' ELSE '' END || ', range ' || norm || CASE WHEN v = 'border' THEN ', borderline' WHEN v = 'abnormal' AND mean > hi THEN ', too fast' WHEN v = 'abnormal' THEN ', too slow' ELSE '' END || '.' END AS sentence FROM y""")
def rate_rows(spark, sf):
    i = F.col("case_id")
    h = _cases(spark, sf).withColumn("hr_mean", F.when(i % 9 != 0, 50 + i % 200 + 0.25)).withColumn("hr_min", F.col("hr_mean") - 10).withColumn("hr_max", F.col("hr_mean") + 15)
    h = h.withColumn("c_mean", 1 - i % 6 / 10.0).withColumn("c_min", F.when(i % 5 != 0, 1.0).otherwise(0.0)).withColumn("c_max", F.lit(1.0)).withColumn("reason", F.lit("no_beats"))
    return conclusion.rate_rows(h, spark)


@query(CASES + f""", h AS (SELECT *, CASE WHEN case_id % 10 <> 0 THEN case_id % 360 - 180 + 0.5::DOUBLE END AS axis FROM p),
x AS (SELECT h.*, lo, hi, bl, bh, rule, axis AS value, axis AS x, hi AS top FROM h LEFT JOIN n ON n.profile = h.profile AND n.key = 'axis'),
y AS (SELECT *, {VERDICT} AS v, {_core('true')} || '°' AS norm, {_shown('axis', "'deg'", 'true')} || '°' AS shown FROM x)
SELECT case_id, norm, CASE WHEN axis IS NULL THEN 'n/a' ELSE v END AS verdict, coalesce(shown, 'unreliable') AS value, CASE WHEN axis IS NULL THEN 'no axis' ELSE '' END AS note,
CASE WHEN axis IS NULL THEN 'Axis not determined.' WHEN v = 'norm' THEN 'Axis ' || shown || ', within ' || norm || '.' WHEN v = 'border' THEN 'Axis ' || shown || ', borderline (' || norm || ').' WHEN axis < lo THEN 'Axis ' || shown || ', left of ' || norm || '.' ELSE 'Axis ' || shown || ', right of ' || norm || '.' END AS sentence FROM y""")
def axis_rows(spark, sf):
    i = F.col("case_id")
    return conclusion.axis_rows(_cases(spark, sf).withColumn("axis", F.when(i % 10 != 0, i % 360 - 180 + 0.5)), spark)


FOUND = f"""WITH e AS (SELECT o_custkey AS case_id, o_orderkey AS beat, CASE WHEN o_orderkey % 3 = 0 THEN 'VE' ELSE 'SVE' END AS kind, ['atrial', 'junctional', 'left_ventricle', 'strange'][1 + (o_orderkey % 4)::INTEGER] AS code, (200 + o_orderkey % 300)::DOUBLE AS coupling FROM orders),
f AS (SELECT *, {_case(P.FOCI, 'code', "'unknown focus'")} AS focus FROM e)"""


@query(FOUND + f""", g AS (SELECT case_id, kind, focus, count(*) AS c, min(beat) AS seen FROM f GROUP BY ALL),
h AS (SELECT case_id, kind, CASE WHEN count(*) = 1 THEN min(focus) ELSE string_agg(c || ' ' || focus, ', ' ORDER BY seen) END AS foci FROM g GROUP BY ALL),
k AS (SELECT case_id, kind, count(*) AS n, min(coupling) AS lo, max(coupling) AS hi, avg(coupling) AS mean FROM f GROUP BY ALL),
t AS (SELECT case_id, kind, n || ' ' || CASE kind WHEN 'VE' THEN 'ventricular beat' ELSE 'supraventricular beat' END || CASE WHEN n = 1 THEN '' ELSE 's' END || ' (' || foci || '; coupling ' ||
  CASE WHEN lo = hi THEN {_shown('lo', "'ms'")} || ' ms' ELSE {_shown('lo', "'ms'")} || ' to ' || {_shown('hi', "'ms'")} || ' ms, mean ' || {_shown('mean', "'ms'")} END || ')' AS text FROM k JOIN h USING (case_id, kind))
SELECT case_id, string_agg(text, '; ' ORDER BY kind) AS text FROM t GROUP BY case_id""")
def ectopic_sentences(spark, sf):
    k = F.col("o_orderkey")
    e = T.table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), k.alias("beat"), F.when(k % 3 == 0, "VE").otherwise("SVE").alias("kind"), F.element_at(F.array(*[F.lit(x) for x in ("atrial", "junctional", "left_ventricle", "strange")]), (1 + k % 4).cast("int")).alias("focus"), (200 + k % 300).cast("double").alias("coupling_ms"))
    return conclusion.ectopic_items(e)


@query(f"""WITH e AS (SELECT o_custkey AS case_id, o_orderkey * 10.0::DOUBLE AS a, (o_orderkey % 5000)::DOUBLE AS d, 1 + o_orderkey % 7 AS n, ['ve_run', 'sve_run', 'no_p', 'other'][1 + (o_orderkey % 4)::INTEGER] AS kind, (o_orderkey % 400)::DOUBLE AS cp FROM orders)
SELECT case_id, count(*) AS n, string_agg({_case(P.EPISODE_KINDS, 'kind', "'episode'")} || ' at ' || {_shown('a / 1000', "'s'")} || ' s for ' || {_shown('d / 1000', "'s'")} || ' s, ' || n || CASE WHEN n = 1 THEN ' beat' ELSE ' beats' END || ', atria, coupling ' || {_shown('cp', "'ms'")} || ' ms', '; ' ORDER BY a) AS text FROM e GROUP BY case_id""")
def episode_sentences(spark, sf):
    k = F.col("o_orderkey")
    e = T.table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), (k * 10.0).alias("start_ms"), (k % 5000).cast("double").alias("duration_ms"), (1 + k % 7).alias("n"), F.element_at(F.array(*[F.lit(x) for x in ("ve_run", "sve_run", "no_p", "other")]), (1 + k % 4).cast("int")).alias("kind"), F.lit("atrial").alias("focus"), (k % 400).cast("double").alias("coupling_ms"))
    return conclusion.episode_items(e)


@query(f"""WITH c AS (SELECT c_custkey AS case_id, ['sinus', 'non_sinus', 'undetermined', 'odd'][1 + (c_custkey % 4)::INTEGER] AS type, list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'p_not_all:' || c_custkey % 9 || '/12' END, CASE WHEN c_custkey % 3 = 0 THEN 'pq_unstable' END, CASE WHEN c_custkey % 5 = 0 THEN 'unheard_of' END], lambda x: x IS NOT NULL) AS codes FROM customer),
d AS (SELECT *, array_to_string(list_filter(list_transform(codes, lambda c: CASE WHEN regexp_matches(c, '^p_not_all:') THEN 'P before ' || split_part(split_part(c, ':', 2), '/', 1) || ' of 12 beats' ELSE {_case(P.REASONS, 'c')} END), lambda x: x IS NOT NULL), ', ') AS said, {_case(P.RHYTHM, 'type', "'Rhythm undetermined'")} AS base FROM c)
SELECT case_id, CASE WHEN type = 'sinus' OR said = '' THEN base ELSE base || ' (' || said || ')' END AS text FROM d""")
def rhythm_sentences(spark, sf):
    k = F.col("case_id")
    codes = F.array_compact(F.array(F.when(k % 2 == 0, F.concat(F.lit("p_not_all:"), k % 9, F.lit("/12"))), F.when(k % 3 == 0, "pq_unstable"), F.when(k % 5 == 0, "unheard_of")))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("sinus", "non_sinus", "undetermined", "odd")]), (1 + k % 4).cast("int"))
    return _cases(spark, sf).select("case_id", conclusion.rhythm_sentence(kind, codes).alias("text"))


TWO = "(floor({0} * pow(10.0::DOUBLE, 1 - floor(log10({0}))) + 0.5) / pow(10.0::DOUBLE, 1 - floor(log10({0}))))::DECIMAL(18, 9)"


@query("WITH x AS (SELECT o_orderkey, o_totalprice / 10000000 AS mv, o_totalprice / 40000 AS ms FROM orders), y AS (SELECT o_orderkey, " + TWO.format("mv") + " AS a, " + TWO.format("ms") + r""" AS b FROM x),
z AS (SELECT o_orderkey, list_transform([a, b, a * 2, b * 2], lambda v: regexp_replace(v::DECIMAL(18, 9)::VARCHAR, '\.?0+$', '')) AS t FROM y) SELECT o_orderkey, 'One pixel is ' || t[1] || ' mV and ' || t[2] || ' ms; two are ' || t[3] || ' mV and ' || t[4] || ' ms.' AS text FROM z""".replace("\\\\", "\\"))
def precision_sentences(spark, sf):
    o = T.table(spark, sf, "orders")
    return o.select("o_orderkey", conclusion.precision_sentence(F.col("o_totalprice") / 10_000_000, F.col("o_totalprice") / 40_000).alias("text"))


@query()
def conclusions(spark, sf):
    """The whole text of each case; its parts have SQL of their own."""
    k = F.col("case_id")
    c = _cases(spark, sf)
    h = c.withColumn("hr_mean", F.when(k % 9 != 0, 50 + k % 200 + 0.25)).withColumn("hr_min", F.col("hr_mean") - 10).withColumn("hr_max", F.col("hr_mean") + 15)
    h = h.withColumn("c_mean", F.lit(0.9)).withColumn("c_min", F.lit(0.9)).withColumn("c_max", F.lit(0.9)).withColumn("reason", F.lit("no_beats"))
    axes = c.withColumn("axis", F.when(k % 10 != 0, k % 360 - 180 + 0.5))
    facts = c.select(
        "case_id", "species", F.when(k % 3 == 0, "sinus").otherwise("non_sinus").alias("type"), F.array(F.lit("pq_unstable")).alias("reasons"), (k % 6 == 0).alias("sinus_arrhythmia"),
        F.when(k % 7 == 0, F.array(F.struct((k * 10.0).alias("start_ms"), (k + 900.0).alias("duration_ms")))).otherwise(F.array().cast("array<struct<start_ms:double,duration_ms:double>>")).alias("pauses"),
        (k % 20).alias("n_beats"), F.lit(6).alias("n_leads"), F.lit(4).alias("n_reliable"), (1 + k % 3).alias("n_pages"), (k % 60 * 1.5).alias("seconds"), F.when(k % 2 == 0, k % 30 / 2).alias("minutes"),
        F.when(k % 4 == 0, "some drug ").alias("drugs"), F.array(F.lit("manual_correction"), F.lit("precision_ceiling")).alias("flags"), F.lit(0.0232).alias("mv_per_px"), F.lit(4.646).alias("ms_per_px"), F.lit("no_beats").alias("first_reason"),
    )
    return conclusion.compose(facts, conclusion.parameter_rows(_measured(spark, sf), spark), conclusion.rate_rows(h, spark), conclusion.axis_rows(axes, spark), ectopic_sentences(spark, sf), episode_sentences(spark, sf))


SHOWN = ROWS + """, sh AS (SELECT rows.case_id, rows.key, rows.no, rows.label, rows.value, norm, CASE WHEN rows.value = 'unreliable' THEN 'n/a' ELSE verdict END AS verdict, CASE WHEN rows.value = 'unreliable' THEN 'unreliable' WHEN verdict = 'n/a' THEN 'none' ELSE verdict END AS tone,
  CASE WHEN rows.value = 'unreliable' THEN note ELSE array_to_string(list_filter([CASE WHEN rows.no % 2 = 0 THEN 'from all leads' ELSE '' END, note], lambda x: x <> ''), '; ') END AS note FROM rows)"""


def _shown_rows(spark, sf):
    m = _measured(spark, sf).select("*", F.col("value").alias("m_value"), F.col("reason").alias("m_reason"), F.when(F.col("no") % 2 == 0, "all_leads").alias("m_source"))
    return views.result_rows(conclusion.parameter_rows(m, spark, ("m_value", "m_reason", "m_source")))


@query(SHOWN + " SELECT case_id, key, label, value, norm, verdict, tone, note FROM sh")
def result_rows(spark, sf):
    return _shown_rows(spark, sf)


@query(SHOWN + f""" SELECT case_id, '{chr(9).join(P.TSV_HEADER)}' || chr(10) || string_agg(concat_ws(chr(9), label, value, norm, CASE WHEN tone = 'none' THEN CASE WHEN norm <> '' THEN '—' ELSE '' END ELSE {_case(P.TONES, 'tone')} END, note), chr(10) ORDER BY no) AS tsv FROM sh GROUP BY case_id""")
def results_tsv(spark, sf):
    return views.tsv(_shown_rows(spark, sf).withColumn("place", F.array_position(F.array(*[F.lit(k) for k in conclusion.ORDER]), F.col("key"))))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[\t\r\n]+', ' ', 'g')) AS cell, array_to_string(list_filter(['table', CASE WHEN n_chars % 2 = 0 THEN 'a' || chr(10) || 'b' ELSE '' END, CASE WHEN n_chars % 3 = 0 THEN lang ELSE '' END], lambda x: x <> ''), chr(10) || chr(10)) AS clip FROM documents")
def clipboard(spark, sf):
    d = T.table(spark, sf, "documents")
    notes = F.when(F.col("n_chars") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return d.select("doc_id", views.tsv_cell(F.col("text")).alias("cell"), views.clipboard_text(F.lit("table"), notes, F.when(F.col("n_chars") % 3 == 0, F.col("lang"))).alias("clip"))


SHEETS = """WITH s AS (SELECT o_custkey AS case_id, o_orderkey AS sheet_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, ['D', 'C', 'X', NULL, 'D'][1 + (o_orderkey % 5)::INTEGER] AS letter,
CASE WHEN o_orderkey % 3 > 0 THEN 25.0::DOUBLE * (o_orderkey % 3) END AS mm_s, CASE WHEN o_orderkey % 7 > 0 THEN 10.0::DOUBLE END AS mm_mv, o_orderkey % 4 AS part, o_totalprice FROM orders)"""


def _sheets(spark, sf):
    from pyspark.sql import Window as W

    k = F.col("o_orderkey")
    letters = F.array(F.lit("D"), F.lit("C"), F.lit("X"), F.lit(None), F.lit("D"))
    return T.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("case_id"), k.alias("sheet_id"), (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long").alias("place"), F.get(letters, (k % 5).cast("int")).alias("letter"),
        F.when(k % 3 > 0, 25.0 * (k % 3)).alias("mm_s"), F.when(k % 7 > 0, 10.0).alias("mm_mv"), (k % 4).alias("part"), "o_totalprice",
    )


@query(SHEETS + " SELECT case_id, first(CASE letter WHEN 'D' THEN 'dog' WHEN 'C' THEN 'cat' END ORDER BY place) FILTER (letter IN ('D', 'C')) AS species, count(DISTINCT letter) FILTER (letter IN ('D', 'C')) > 1 AS mixed FROM s GROUP BY case_id")
def species_hints(spark, sf):
    return views.species_hint(_sheets(spark, sf))


@query(SHEETS + ", x AS (SELECT case_id, first(mm_s ORDER BY place) FILTER (mm_s > 0 AND mm_mv > 0) AS mm_s, first(mm_mv ORDER BY place) FILTER (mm_s > 0 AND mm_mv > 0) AS mm_mv, count(DISTINCT mm_s || '/' || mm_mv) FILTER (mm_s > 0 AND mm_mv > 0) > 1 AS mismatch FROM s GROUP BY case_id) SELECT * FROM x")
def footer_hints(spark, sf):
    return views.footer_hint(_sheets(spark, sf))


@query("""SELECT c_custkey AS case_id, CASE WHEN c_custkey % 5 = 0 THEN 'cat' WHEN c_custkey % 3 = 0 THEN 'cat' ELSE 'dog' END AS species, CASE WHEN c_custkey % 5 = 0 THEN 'manual' WHEN c_custkey % 3 = 0 THEN 'header' ELSE 'default' END AS species_source,
CASE WHEN c_custkey % 4 = 0 THEN 25.0 ELSE 50.0 END::DOUBLE AS mm_s, CASE WHEN c_custkey % 4 = 0 THEN 20.0 ELSE 10.0 END::DOUBLE AS mm_mv, CASE WHEN c_custkey % 4 = 0 THEN 'footer' ELSE 'default' END AS calib_source,
CASE WHEN c_custkey % 6 = 0 THEN 7.0 ELSE floor(c_acctbal * 100 / 60000 * 10 + 0.5) / 10 END::DOUBLE AS minutes, CASE WHEN c_custkey % 6 = 0 THEN 'manual' ELSE 'pages' END AS minutes_source FROM customer""")
def case_settings(spark, sf):
    k, none = F.col("c_custkey"), F.lit(None).cast("double")
    c = T.table(spark, sf, "customer").select(
        k.alias("case_id"), F.when(k % 5 == 0, "cat").alias("hand_species"), F.when(k % 3 == 0, "cat").alias("hint_species"), none.alias("hand_mm_s"), none.alias("hand_mm_mv"),
        F.when(k % 4 == 0, 25.0).alias("hint_mm_s"), F.when(k % 4 == 0, 20.0).alias("hint_mm_mv"), F.when(k % 6 == 0, 7.0).alias("hand_minutes"), (F.col("c_acctbal") * 100).alias("covered_ms"),
    )
    return views.settings(c)


@query(SHEETS + ", l AS (SELECT * FROM s WHERE place % 5 <> 0), x AS (SELECT case_id, sheet_id, CASE WHEN part = 3 THEN sheet_id ELSE min(sheet_id) OVER (PARTITION BY case_id, part) END AS original FROM l) SELECT *, original <> sheet_id AS inherits FROM x")
def promoted_sheets(spark, sf):
    s = _sheets(spark, sf).withColumn("digest", F.when(F.col("part") != 3, F.col("part").cast("string"))).withColumn("removed", F.col("place") % 5 == 0)
    return views.promoted(s)


@query(SHEETS + """, a AS (SELECT *, CASE WHEN place % 3 <> 2 THEN (place * 7) % 11 * 100 + place END AS spot, CASE WHEN place % 3 = 2 AND place % 2 = 0 THEN lag(sheet_id) OVER (PARTITION BY case_id ORDER BY place) END AS original FROM s),
b AS (SELECT a.*, coalesce(a.spot, o.spot) AS host FROM a LEFT JOIN a o ON a.case_id = o.case_id AND a.original = o.sheet_id) SELECT case_id, sheet_id, row_number() OVER (PARTITION BY case_id ORDER BY host IS NULL, host, spot IS NULL, place) - 1 AS place FROM b""")
def sheet_display_order(spark, sf):
    from pyspark.sql import Window as W

    s = _sheets(spark, sf)
    p = F.col("place")
    s = s.withColumn("case_place", F.when(p % 3 != 2, p * 7 % 11 * 100 + p)).withColumn("original", F.when((p % 3 == 2) & (p % 2 == 0), F.lag("sheet_id").over(W.partitionBy("case_id").orderBy("place"))))
    return views.display_order(s.withColumn("upload", F.col("place")).drop("place"))


@query(SHEETS + """, x AS (SELECT *, part = 0 AS dup, part = 1 AS ov, part = 2 AS ex, place % 6 = 0 AS un FROM s)
SELECT case_id, sheet_id, array_to_string(list_filter([CASE WHEN dup OR place % 9 = 4 THEN 'copy' END, CASE WHEN ov THEN 'repeated stretch' END, CASE WHEN ex THEN 'other animal' END, CASE WHEN un THEN 'header unread' END], lambda v: v IS NOT NULL), ',') AS badges, printf('%02d:%02d', floor(o_totalprice / 100)::BIGINT // 60, floor(o_totalprice / 100)::BIGINT % 60) AS at FROM x""")
def sheet_badges(spark, sf):
    s = _sheets(spark, sf)
    kinds = F.array_compact(F.array(F.get(F.array(F.lit("duplicate"), F.lit("overlap"), F.lit("pages_excluded"), F.lit(None)), F.col("part").cast("int")), F.when(F.col("place") % 6 == 0, "animal_unverified")))
    issues = s.select("case_id", F.explode(kinds).alias("kind"), "place").select("case_id", F.concat_ws(":", "kind", F.col("place").cast("string")).alias("code"))
    b = views.badges(s.withColumn("copy", F.col("place") % 9 == 4), issues)
    return b.join(s.select("case_id", "sheet_id", "o_totalprice"), ["case_id", "sheet_id"]).select("case_id", "sheet_id", F.array_join("badges", ",").alias("badges"), views.clock(F.col("o_totalprice") / 100).alias("at"))


@query(SHEETS + ", g AS (SELECT case_id, part, string_agg(sheet_id::VARCHAR, ',' ORDER BY place) AS k FROM s GROUP BY ALL) SELECT case_id, string_agg(k, '|' ORDER BY part) AS key FROM g GROUP BY case_id")
def groups_key(spark, sf):
    return views.groups_key(_sheets(spark, sf).withColumn("group_no", F.col("part")))


@query(CASES + " SELECT case_id, bool_or(coalesce(reason LIKE '%\\_absent' ESCAPE '\\', false) OR coalesce(value IS NOT NULL AND confidence >= 0.6 AND abs(value) <= 2 * 0.03, false)) AS ceiling FROM m WHERE key IN ('pAmplitude', 'q', 'r', 's', 't') GROUP BY case_id")
def precision_ceilings(spark, sf):
    return views.precision_ceiling(_measured(spark, sf).withColumn("mv_per_px", F.lit(0.03)))


@query(SHEETS + " SELECT case_id, round(greatest(0, least(1, avg(1 - part / 8.0::DOUBLE) * CASE WHEN bool_and(place % 7 <> 6) THEN 1 ELSE 0.9::DOUBLE END)), 9) AS confidence FROM s GROUP BY case_id")
def case_confidence(spark, sf):
    c = views.case_confidence(_sheets(spark, sf).select("case_id", (1 - F.col("part") / 8.0).alias("confidence"), (F.col("place") % 7 != 6).alias("order_known")))
    return c.select("case_id", F.round("confidence", 9).alias("confidence"))


LOG = """WITH g AS (SELECT conv_id AS case_id, turn AS seq, ['calibration', 'baseline', 'marker', 'leadLabel'][1 + (turn % 4)::INTEGER] AS kind, CASE WHEN turn % 4 = 0 AND length(text) % 3 = 0 THEN NULL ELSE length(text) % 5 END AS page, length(text) AS n FROM conversations),
pg AS (SELECT k.case_id, p AS page FROM (SELECT DISTINCT case_id FROM g) k, generate_series(0, 2) AS t(p)),
ro AS (SELECT g.* EXCLUDE (page), pg.page FROM g JOIN pg ON g.case_id = pg.case_id AND (g.page = pg.page OR (g.kind = 'calibration' AND g.page IS NULL)))"""


def _log(spark, sf):
    n = F.length("text").cast("long")
    g = T.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("case_id"), F.col("turn").alias("seq"), F.element_at(F.array(*[F.lit(x) for x in ("calibration", "baseline", "marker", "leadLabel")]), (1 + F.col("turn") % 4).cast("int")).alias("kind"),
        F.when(~((F.col("turn") % 4 == 0) & (n % 3 == 0)), n % 5).alias("page"), n.alias("n"),
    )
    return g, g.select("case_id").distinct().select("case_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("page"))


@query(LOG + " SELECT case_id, seq, kind, page FROM ro")
def edits_routed(spark, sf):
    return edits.routed(*_log(spark, sf)).select("case_id", "seq", "kind", "page")


@query(LOG + " SELECT case_id, seq, 'edit_skipped:' || kind || ':' || page AS code FROM g WHERE page IS NOT NULL AND page > 2")
def edits_skipped(spark, sf):
    return edits.skipped(*_log(spark, sf))


@query(LOG + """, k AS (SELECT *, CASE n % 4 WHEN 0 THEN 25.0 WHEN 1 THEN 100.0 WHEN 2 THEN 50.0 ELSE -1.0 END::DOUBLE AS s, 10.0::DOUBLE AS m, CASE WHEN n % 2 = 0 THEN 4.0 + n % 3 END::DOUBLE AS x FROM ro WHERE kind = 'calibration'),
v AS (SELECT *, x IS NOT NULL AND s = 50 AS only_scale FROM k WHERE s > 0),
l AS (SELECT case_id, page, max_by(s, seq) FILTER (NOT only_scale) AS s, max_by(x, seq) FILTER (x IS NOT NULL) AS x FROM v GROUP BY ALL),
j AS (SELECT pg.case_id, pg.page, coalesce(s, 50) AS mm_s, CASE WHEN s IS NULL THEN 'footer' ELSE 'manual' END AS source, coalesce(x, 4.3) AS px_mm_x, x IS NOT NULL AS grid_manual, s IS NOT NULL AND s <> 50 AS overrides_footer FROM pg LEFT JOIN l USING (case_id, page))
SELECT case_id, page, mm_s, source, px_mm_x, grid_manual, round(1 / (px_mm_x * 10), 9) AS mv_per_px, round(1000 / (px_mm_x * mm_s), 9) AS ms_per_px, overrides_footer FROM j""")
def edits_calibration(spark, sf):
    g, p = _log(spark, sf)
    speed = F.when(F.col("n") % 4 == 0, 25.0).when(F.col("n") % 4 == 1, 100.0).when(F.col("n") % 4 == 2, 50.0).otherwise(-1.0)
    scale = F.when(F.col("n") % 2 == 0, 4.0 + F.col("n") % 3)
    own = edits.routed(g, p).withColumn("mm_s", speed).withColumn("mm_mv", F.lit(10.0)).withColumn("x", scale).withColumn("y", scale)
    pages = p.select("case_id", "page", F.lit(50.0).alias("mm_s"), F.lit(10.0).alias("mm_mv"), F.lit("footer").alias("source"), F.lit(50.0).alias("footer_mm_s"), F.lit(10.0).alias("footer_mm_mv"), F.lit(4.3).alias("px_mm_x"), F.lit(4.3).alias("px_mm_y"))
    c = edits.calibrated(pages, own)
    return c.select("case_id", "page", "mm_s", "source", "px_mm_x", "grid_manual", F.round("mv_per_px", 9).alias("mv_per_px"), F.round("ms_per_px", 9).alias("ms_per_px"), "overrides_footer")


@query(LOG + """, l AS (SELECT case_id, page, max_by((100 + n % 50)::DOUBLE, seq) AS y FROM ro WHERE kind = 'baseline' GROUP BY ALL)
SELECT pg.case_id, pg.page, 'II' AS lead, coalesce(y, 110.0::DOUBLE) AS baseline_y, round((y - 110) * 0.023, 9) AS shift_mv FROM pg LEFT JOIN l USING (case_id, page)""")
def edits_baseline(spark, sf):
    g, p = _log(spark, sf)
    own = edits.routed(g, p).withColumn("lead", F.lit("II")).withColumn("y", (100 + F.col("n") % 50).cast("double"))
    leads = p.select("case_id", "page", F.lit("II").alias("lead"), F.lit(110.0).alias("baseline_y"), F.lit(0.023).alias("mv_per_px"))
    b = edits.baselines(leads, own)
    return b.select("case_id", "page", "lead", "baseline_y", F.round("shift_mv", 9).alias("shift_mv"))


@query(LOG + """, k AS (SELECT case_id, page, ['p_on', 'q_on', 't_off'][1 + (n % 3)::INTEGER] AS field, max_by(n::DOUBLE, seq) AS t FROM ro WHERE kind = 'marker' GROUP BY ALL),
w AS (SELECT pg.case_id, pg.page, max(t) FILTER (field = 'p_on') AS p, max(t) FILTER (field = 'q_on') AS q, max(t) FILTER (field = 't_off') AS o FROM pg LEFT JOIN k USING (case_id, page) GROUP BY ALL)
SELECT case_id, page, coalesce(p, 1) AS p_on, coalesce(q, 2) AS q_on, coalesce(o, 3) AS t_off, p IS NOT NULL AS p_found, CASE WHEN p IS NULL AND q IS NULL AND o IS NULL THEN 0.5 ELSE 1 END::DOUBLE AS confidence,
array_to_string(list_filter([CASE WHEN p IS NULL THEN 'p_not_found' END, CASE WHEN q IS NULL THEN 'qrs_wide' END, 'unreliable_segment'], lambda x: x IS NOT NULL), ',') AS reasons FROM w""")
def edits_markers(spark, sf):
    g, p = _log(spark, sf)
    own = edits.routed(g, p).withColumn("position", F.lit(0)).withColumn("field", F.element_at(F.array(F.lit("p_on"), F.lit("q_on"), F.lit("t_off")), (1 + F.col("n") % 3).cast("int"))).withColumn("t_ms", F.col("n").cast("double"))
    beats = p.select("case_id", "page", F.lit(0).alias("position"), F.lit(1.0).alias("p_on"), F.lit(1.5).alias("p_off"), F.lit(2.0).alias("q_on"), F.lit(2.5).alias("s_off"), F.lit(3.0).alias("t_off"), F.lit(False).alias("p_found"), F.lit(0.5).alias("confidence"), F.array(F.lit("p_not_found"), F.lit("qrs_wide"), F.lit("unreliable_segment")).alias("reasons"))
    m = edits.marked_beats(beats, own)
    return m.select("case_id", "page", "p_on", "q_on", "t_off", "p_found", "confidence", F.array_join("reasons", ",").alias("reasons"))


LEADS = ("I", "II", "III", "aVR", "aVL", "aVF")
LABELS = """WITH e AS (SELECT conv_id AS key, turn AS seq, ['I', 'II', 'III', 'aVR', 'aVL', 'aVF'][1 + (turn % 6)::INTEGER] AS lead, CASE WHEN length(text) % 9 < 6 THEN ['I', 'II', 'III', 'aVR', 'aVL', 'aVF'][1 + (length(text) % 9)::INTEGER] END AS target FROM conversations),
l AS (SELECT key, lead, first(target ORDER BY seq DESC) AS target, max(seq) AS rank FROM e GROUP BY ALL),
a AS (SELECT key, x.lead, x.no FROM (SELECT DISTINCT key FROM e), (VALUES ('I', 0), ('II', 1), ('III', 2), ('aVR', 3), ('aVL', 4), ('aVF', 5)) AS x(lead, no)),
t AS (SELECT a.*, CASE WHEN rank IS NULL THEN a.lead ELSE target END AS slot, coalesce(rank, -1) AS rank FROM a LEFT JOIN l USING (key, lead)),
f AS (SELECT key, slot, first(lead ORDER BY rank DESC, no DESC) AS lead FROM t WHERE slot IS NOT NULL GROUP BY ALL),
au AS (SELECT a.key, a.lead AS slot, f.lead FROM a LEFT JOIN f ON a.key = f.key AND a.lead = f.slot)"""


def _labels(spark, sf):
    names = F.array(*[F.lit(x) for x in LEADS])
    n = F.length("text")
    e = T.table(spark, sf, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.element_at(names, (1 + F.col("turn") % 6).cast("int")).alias("lead"), F.when(n % 9 < 6, F.get(names, n % 9)).alias("target"))
    return edits.automatic_label(e, LEADS)


@query(LABELS + " SELECT key, slot, lead FROM au")
def automatic_labels(spark, sf):
    return _labels(spark, sf)


@query(LABELS + " SELECT key, lead, 'aVF' AS target FROM au WHERE slot = 'II' AND lead <> 'aVF' UNION ALL SELECT key, lead, 'II' FROM au WHERE slot = 'aVF' AND lead <> 'II'")
def swapped_labels(spark, sf):
    l = _labels(spark, sf)
    return edits.swap(l, l.select("key").distinct().select("key", F.lit("II").alias("a"), F.lit("aVF").alias("b")))
