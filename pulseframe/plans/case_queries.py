"""Registered queries on cases: several sheets of an animal, bound to marked beats made from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.functions.shared import cut
from pulseframe.operators import analysis, case, findings, measure, order, rhythm
from pulseframe.plans.registry import query
from pulseframe.sources import tables as T
from pulseframe.sources import waves

#: The marked beats, gates and flags in SQL: u has the gates, f the intervals and flags, o the pages' places.
FACTS = """WITH s AS (SELECT user_id // 4 AS case_id, user_id AS page, event_id AS beat_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
g AS (SELECT *, (CASE WHEN i % 40 BETWEEN 20 AND 23 THEN 300 WHEN beat_id % 17 = 0 THEN 380 WHEN beat_id % 31 = 0 THEN 1400 ELSE 600 + (beat_id % 40) * (1 + case_id % 3 * 3) END)::DOUBLE AS step FROM s),
e AS (SELECT *, sum(step) OVER (PARTITION BY page ORDER BY i) AS t FROM g),
k AS (SELECT *, 1 - 1 / (1 + value) AS confidence, 1 - (page % 6) / 10.0::DOUBLE AS ii_confidence, CASE WHEN page % 6 <= 4 AND beat_id % 13 <> 0 THEN t + beat_id % 3 END AS t_ii,
  CASE WHEN beat_id % 19 <> 0 THEN t - 20 - beat_id % 15 END AS q_on, CASE WHEN beat_id % 19 <> 0 THEN t + 25 + beat_id % 17 END AS s_off,
  beat_id % 5 <> 0 AND i % 40 NOT BETWEEN 30 AND 34 AS p_found, 1 - (beat_id % 10) / 20.0::DOUBLE AS d_confidence, 1 - (beat_id % 7) / 10.0::DOUBLE AS rho,
  CASE WHEN beat_id % 29 <> 0 THEN (beat_id % 9 - 4) * 10.0::DOUBLE END AS area_i, CASE WHEN beat_id % 37 <> 0 THEN (beat_id % 8 - 3) * 12.0::DOUBLE END AS area_f FROM e),
u AS (SELECT *, CASE WHEN p_found THEN q_on - 60 - beat_id % (CASE WHEN case_id % 2 = 0 THEN 10 ELSE 50 END) END AS p_on, confidence >= 0.6 AND beat_id % 11 <> 0 AS reliable,
  ii_confidence >= 0.6 AND t_ii IS NOT NULL AND q_on IS NOT NULL AND d_confidence >= 0.6 AND beat_id % 23 <> 0 AS usable, p_found OR beat_id % 10 <> 5 AS p_assessed, NOT p_found AND beat_id % 10 <> 5 AS p_absent FROM k),
r AS (SELECT *, t - lag(t) OVER w AS rr, t_ii - lag(t_ii) OVER w AS rr_ii, CASE WHEN usable AND p_found THEN q_on - p_on END AS pq FROM u WINDOW w AS (PARTITION BY page ORDER BY i)),
m AS (SELECT *, coalesce(rr < 0.8 * CASE WHEN count(rr) OVER c >= 3 THEN median(rr) OVER c END, false) AS candidate FROM r WINDOW c AS (PARTITION BY case_id)),
q AS (SELECT *, rr IS NOT NULL AND NOT candidate AND NOT coalesce(lag(candidate) OVER w, false) AS ok FROM m WINDOW w AS (PARTITION BY page ORDER BY i)),
d AS (SELECT *, CASE WHEN ok AND lag(ok) OVER w THEN abs(rr - lag(rr) OVER w) END AS change FROM q WINDOW w AS (PARTITION BY page ORDER BY i)),
v AS (SELECT case_id, coalesce(stddev_samp(rr) FILTER (ok) / avg(rr) FILTER (ok), 0) > 0.1 OR coalesce(max(change), 0) >= 120 AS varies, median(pq) FILTER (NOT candidate) AS ref FROM d GROUP BY case_id),
f AS (SELECT d.*, candidate AND (NOT varies OR pq IS NULL OR ref IS NULL OR abs(pq - ref) > 0.2 * ref) AS premature FROM d JOIN v USING (case_id)),
n AS (SELECT case_id, page, floor((max(t) + 500) / 2) AS samples FROM e GROUP BY ALL),
o AS (SELECT *, coalesce(sum(samples * 2) OVER (PARTITION BY case_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM n),
z AS (SELECT case_id, max(place + samples * 2) AS stop FROM o GROUP BY case_id)
"""


def facts(sql):
    return query(sql, FACTS)


def pages(spark, sf):
    """The cases' pages end to end: case_id, page, page_no, n_samples, offset_ms, ms_per_px."""
    p = T.marks(spark, sf).groupBy("case_id", "page").agg(F.floor((F.max("t_ms") + 500) / 2).cast("double").alias("n_samples"))
    p = p.select(F.col("case_id").alias("group"), F.col("page").alias("page_no"), "page", "n_samples", (F.col("n_samples") / 500).alias("duration_s"))
    return case.offsets(p).select(F.col("group").alias("case_id"), "page", "page_no", "n_samples", (F.col("offset_s") * 1000).alias("offset_ms"), (4.6 + F.col("page") % 3 / 10.0).alias("ms_per_px"))


def flagged(spark, sf):
    return findings.flagged(T.marks(spark, sf))


def placed(spark, sf):
    """Flagged beats with at_ms and ms_per_px."""
    p = pages(spark, sf).select("case_id", "page", "offset_ms", "ms_per_px")
    return flagged(spark, sf).join(p, ["case_id", "page"]).withColumn("at_ms", F.col("offset_ms") + F.col("t_ms"))


@facts("SELECT beat_id, reliable, usable, p_assessed, p_absent, pq FROM r")
def beat_gates(spark, sf):
    return findings.gated(T.marks(spark, sf)).select("beat_id", "reliable", "usable", "p_assessed", "p_absent", "pq")


@facts(", x AS (SELECT beat_id, row_number() OVER (PARTITION BY case_id ORDER BY page, i) - 1 AS global_index, rr, rr_ii, place + t AS at_ms FROM r JOIN o USING (case_id, page)) SELECT beat_id, global_index, rr AS rr_ms, rr_ii AS rr_ii_ms, round(at_ms, 3) AS at_ms FROM x")
def merged_beats(spark, sf):
    m = findings.merged(T.marks(spark, sf), pages(spark, sf))
    return m.select("beat_id", "global_index", "rr_ms", "rr_ii_ms", F.round("at_ms", 3).alias("at_ms"))


@facts("SELECT beat_id, candidate, premature FROM f")
def case_premature(spark, sf):
    return flagged(spark, sf).select("beat_id", "candidate", "premature")


@facts(", x AS (SELECT *, median(rr) OVER (PARTITION BY case_id) AS mid, coalesce(lag(premature) OVER (PARTITION BY page ORDER BY i), false) AS after FROM f) SELECT beat_id, rr AS rr_ms FROM x WHERE rr >= 2 * mid AND NOT after")
def case_pauses(spark, sf):
    b = flagged(spark, sf)
    return rhythm.pauses(b, b).select("beat_id", "rr_ms")


ECTOPICS = """, b1 AS (SELECT *, last_value(CASE WHEN NOT premature THEN t END IGNORE NULLS) OVER (PARTITION BY page ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f),
b2 AS (SELECT *, CASE WHEN usable THEN greatest(0, s_off - q_on - 9.3 - 7.7) / 1000 END AS width FROM b1 WHERE premature AND rr IS NOT NULL),
b3 AS (SELECT *, CASE WHEN coalesce(width > 0.07, false) OR rho < 0.8 THEN 'VE' ELSE 'SVE' END AS kind FROM b2),
x AS (SELECT case_id, page, beat_id, i, kind, CASE WHEN kind = 'SVE' THEN CASE WHEN NOT usable THEN 'unknown' WHEN p_found THEN 'atrial' ELSE 'junctional' END
  WHEN area_i IS NOT NULL AND (area_f IS NULL OR abs(area_i) > 0.2 * abs(area_f)) THEN CASE WHEN area_i > 0 THEN 'right_ventricle' ELSE 'left_ventricle' END
  WHEN area_f IS NULL OR area_f = 0 THEN 'unknown' WHEN area_f > 0 THEN 'right_ventricle' ELSE 'left_ventricle' END AS focus, floor(coalesce(t - before, rr) + 0.5)::DOUBLE AS coupling_ms FROM b3)"""


@facts(ECTOPICS + " SELECT beat_id, kind, focus, coupling_ms FROM x")
def case_ectopics(spark, sf):
    return findings.ectopics(flagged(spark, sf)).select("beat_id", "kind", "focus", "coupling_ms")


@facts(ECTOPICS + """, y AS (SELECT f.*, place + t AS at_ms, x.kind, x.focus, x.coupling_ms, usable AND NOT premature AND p_absent AS no_p FROM f JOIN o USING (case_id, page) LEFT JOIN x USING (case_id, page, beat_id)),
i1 AS (SELECT *, i - row_number() OVER (PARTITION BY page ORDER BY i) AS island FROM y WHERE premature), i2 AS (SELECT *, i - row_number() OVER (PARTITION BY page ORDER BY i) AS island FROM y WHERE no_p),
h AS (SELECT page, island, focus, count(*) AS c, min(i) AS seen FROM i1 WHERE focus IS NOT NULL GROUP BY ALL), h2 AS (SELECT page, island, first(focus ORDER BY c DESC, seen) AS focus FROM h GROUP BY ALL),
a1 AS (SELECT case_id, page, island, min(i) AS first_index, count(*) AS n, min(at_ms) AS a, max(at_ms) AS b, CASE WHEN 2 * count(*) FILTER (kind = 'VE') >= count(kind) THEN 've_run' ELSE 'sve_run' END AS kind,
  coalesce(first(coupling_ms ORDER BY i) FILTER (kind IS NOT NULL), first(rr ORDER BY i), 0) AS coupling FROM i1 GROUP BY ALL HAVING count(*) >= 3),
a2 AS (SELECT case_id, page, island, min(i) AS first_index, count(*) AS n, min(at_ms) AS a, max(at_ms) AS b, 'no_p' AS kind, coalesce(list(rr ORDER BY i)[1], list(rr ORDER BY i)[2], 0) AS coupling FROM i2 GROUP BY ALL HAVING count(*) >= 3),
w AS (SELECT a1.*, coalesce(h2.focus, 'unknown') AS focus FROM a1 LEFT JOIN h2 USING (page, island) UNION ALL SELECT *, 'unknown' FROM a2)
SELECT case_id, page, first_index, n, kind, focus, floor(coupling + 0.5)::DOUBLE AS coupling_ms, round(a, 3) AS start_ms, floor(least(b - a + (b - a) / (n - 1), greatest(0, stop - a)) + 0.5)::DOUBLE AS duration_ms FROM w JOIN z USING (case_id)""")
def case_episodes(spark, sf):
    b = cut(placed(spark, sf), "flagged")  # four branches read it
    e = findings.episodes(b, findings.ectopics(b), findings.recording_end(pages(spark, sf)))
    return e.select("case_id", "page", "first_index", "n", "kind", "focus", "coupling_ms", F.round("start_ms", 3).alias("start_ms"), "duration_ms")


TYPE = """, t1 AS (SELECT *, usable AND NOT premature AS sinus_ok, CASE WHEN usable AND NOT premature AND p_assessed AND p_found AND p_on IS NOT NULL THEN q_on - p_on END AS p, 4.6 + page % 3 / 10.0::DOUBLE AS px FROM f),
t2 AS (SELECT *, median(p) OVER c AS mid, median(CASE WHEN p IS NOT NULL THEN px END) OVER c AS mpx FROM t1 WINDOW c AS (PARTITION BY case_id)),
t3 AS (SELECT case_id, count(*) FILTER (ii_confidence >= 0.6) AS ii, count(*) FILTER (sinus_ok) AS usable, count(*) FILTER (sinus_ok AND p_assessed) AS seen, count(p) AS p, count(*) FILTER (abs(p - mid) > greatest(0.2 * mid, 4 * mpx)) AS odd FROM t2 GROUP BY case_id),
t4 AS (SELECT *, CASE WHEN usable < 3 OR seen < 3 THEN CASE WHEN ii = 0 THEN 'lead_ii_unreliable' WHEN usable < 3 THEN 'too_few_beats' WHEN seen < 3 THEN 'p_not_found' END END AS few,
  CASE WHEN seen - p >= 2 AND p / seen < 0.9 THEN CASE WHEN p > 0 THEN 'p_not_all:' || p || '/' || seen ELSE 'p_not_found' END END AS no_p, CASE WHEN odd >= 2 AND (p - odd) / p < 0.9 THEN 'pq_unstable' END AS unstable FROM t3),
ty AS (SELECT case_id, CASE WHEN few IS NOT NULL THEN 'undetermined' WHEN no_p IS NULL AND unstable IS NULL THEN 'sinus' ELSE 'non_sinus' END AS type,
  list_filter(CASE WHEN few IS NOT NULL THEN [few] ELSE [no_p, unstable] END, lambda x: x IS NOT NULL) AS reasons FROM t4)"""


@facts(TYPE + " SELECT case_id, type, array_to_string(reasons, ',') AS reasons FROM ty")
def rhythm_type(spark, sf):
    return findings.rhythm_type(placed(spark, sf)).select("case_id", "type", F.array_join("reasons", ",").alias("reasons"))


FIT = """, c1 AS (SELECT *, reliable AND NOT premature AS second, reliable AND usable AND NOT premature AND NOT coalesce(lag(premature) OVER w, false) AND NOT coalesce(lead(premature) OVER w, false) AS first FROM f WINDOW w AS (PARTITION BY page ORDER BY i))"""
AXIS = """, c2 AS (SELECT *, CASE WHEN bool_or(first) OVER (PARTITION BY case_id) THEN first ELSE second END AS chosen, page % 5 <> 0 AS leads FROM c1),
c3 AS (SELECT case_id, count(*) FILTER (chosen) AS n, count(*) FILTER (chosen AND NOT leads) AS missing, median(area_i) FILTER (chosen AND leads AND area_f IS NOT NULL) AS mi, median(area_f) FILTER (chosen AND leads AND area_i IS NOT NULL) AS mf FROM c2 GROUP BY case_id),
ax AS (SELECT case_id, floor(degrees(atan2(mf, mi)) * 10 + 0.5) / 10 AS axis, CASE WHEN n = 0 THEN 'too_few_beats' WHEN mi IS NULL THEN CASE WHEN missing > 0 THEN 'axis_leads_unreliable' ELSE 'too_few_beats' END END AS reason FROM c3)"""


@facts(FIT + " SELECT beat_id FROM c1 WHERE first")
def case_measurement_beats(spark, sf):
    return findings.measurement_beats(flagged(spark, sf)).select("beat_id")


def _with_leads(spark, sf):
    return placed(spark, sf).withColumn("leads_reliable", F.col("page") % 5 != 0)


@facts(FIT + AXIS + " SELECT case_id, axis, reason FROM ax")
def case_axis(spark, sf):
    return findings.axis(_with_leads(spark, sf))


@facts(TYPE + FIT + AXIS + """, pa AS (SELECT case_id, count(*) AS c FROM (SELECT *, median(rr) OVER (PARTITION BY case_id) AS mid, coalesce(lag(premature) OVER (PARTITION BY page ORDER BY i), false) AS after FROM f) WHERE rr >= 2 * mid AND NOT after GROUP BY case_id),
w1 AS (SELECT *, rr IS NOT NULL AND NOT premature AND NOT coalesce(lag(premature) OVER w, false) AS ok2 FROM f WINDOW w AS (PARTITION BY page ORDER BY i)), w2 AS (SELECT *, CASE WHEN ok2 AND lag(ok2) OVER w THEN abs(rr - lag(rr) OVER w) END AS ch FROM w1 WINDOW w AS (PARTITION BY page ORDER BY i)),
w3 AS (SELECT case_id, coalesce(stddev_samp(rr) FILTER (ok2) / avg(rr) FILTER (ok2), 0) > 0.1 OR coalesce(max(ch), 0) >= 120 AS varies FROM w2 GROUP BY case_id)
SELECT case_id, type, array_to_string(list_sort(list_distinct(list_filter(list_append(reasons, reason), lambda x: x IS NOT NULL))), ',') AS reasons, axis, type = 'sinus' AND pa.c IS NULL AND w3.varies AS sinus_arrhythmia, coalesce(pa.c, 0) AS n_pauses
FROM ty JOIN ax USING (case_id) JOIN w3 USING (case_id) LEFT JOIN pa USING (case_id)""")
def rhythm_report(spark, sf):
    r = findings.report(_with_leads(spark, sf))
    return r.withColumn("reasons", F.array_join(F.array_sort("reasons"), ","))


@facts(""", h1 AS (SELECT r.*, row_number() OVER (PARTITION BY case_id ORDER BY page, i) - 1 AS g, lag(confidence) OVER (PARTITION BY page ORDER BY i) AS pc FROM r),
h2 AS (SELECT *, coalesce(rr_ii, rr) AS ms, (confidence + pc) / 2 AS c FROM h1 WHERE rr IS NOT NULL)
SELECT case_id, round(60000 / avg(ms), 9) AS hr_mean, round(60000 / max(ms), 9) AS hr_min, round(60000 / min(ms), 9) AS hr_max, CASE WHEN count(rr_ii) = count(*) THEN 'lead_ii' ELSE 'all_leads' END AS source,
round(avg(c), 9) AS mean_confidence, round(first(c ORDER BY ms DESC, g), 9) AS min_confidence, round(first(c ORDER BY ms, g), 9) AS max_confidence, len(list_distinct(list_concat(list(g), list(g - 1)))) AS n_participants FROM h2 GROUP BY case_id""")
def case_heart_rate(spark, sf):
    h = findings.heart_rate(findings.merged(T.marks(spark, sf), pages(spark, sf)))
    return h.select("case_id", *[F.round(c, 9).alias(c) for c in ("hr_mean", "hr_min", "hr_max")], "source", *[F.round(c, 9).alias(c) for c in ("mean_confidence", "min_confidence", "max_confidence")], F.size("participants").cast("long").alias("n_participants"))


@facts("SELECT case_id, CASE WHEN NOT bool_or(ii_confidence >= 0.6) THEN 'lead_ii_unreliable' WHEN NOT bool_or(reliable AND usable) THEN 'low_confidence' ELSE 'too_few_beats' END AS reason FROM u GROUP BY case_id")
def wave_empty_reason(spark, sf):
    return findings.empty_reason(findings.gated(T.marks(spark, sf)))


@facts("SELECT case_id, stop AS end_ms FROM z")
def recording_end(spark, sf):
    return findings.recording_end(pages(spark, sf))


@facts("SELECT case_id, page, CASE WHEN count(*) FILTER (usable AND NOT premature) >= 3 THEN median(s_off - q_on) FILTER (usable AND NOT premature) ELSE 80 END / 2 AS half_ms FROM f GROUP BY ALL")
def template_half_width(spark, sf):
    return findings.template_half(flagged(spark, sf))


@query("""WITH l AS (SELECT user_id AS page, CASE event_type WHEN 'view' THEN 'II' ELSE event_type END AS lead, min(event_id) AS position, count(*) % 4 AS n, round(avg(value) / 40, 6) AS confidence FROM events GROUP BY ALL)
SELECT page, first(lead ORDER BY (lead = 'II' AND confidence >= 0.6) DESC, confidence DESC, position) AS lead FROM l WHERE n > 0 AND confidence > 0 GROUP BY page""")
def reference_lead(spark, sf):
    e = T.table(spark, sf, "events").withColumn("lead", F.when(F.col("event_type") == "view", "II").otherwise(F.col("event_type")))
    l = e.groupBy(F.col("user_id").alias("page"), "lead").agg(F.min("event_id").alias("position"), (F.count(F.lit(1)) % 4).alias("n"), F.round(F.avg("value") / 40, 6).alias("confidence"))
    return findings.reference_lead(l)


#: Vectors as beats of 64 samples (126 ms): QRS from 30 to 62 ms, P from 4 to 14, T at 90 to 100; every third has no P, every fifth no T.
BEATS = """WITH x AS (SELECT vec_id AS beat, label AS case_id, embedding::DOUBLE[] AS mv, 30.0::DOUBLE + vec_id % 7 AS q_on, 62.0::DOUBLE + vec_id % 5 AS s_off, vec_id % 3 <> 0 AS pf, 4.0::DOUBLE AS p_on, 14.0::DOUBLE + vec_id % 4 AS p_off,
  CASE WHEN vec_id % 5 <> 0 THEN 90.0::DOUBLE + vec_id % 6 END AS t_peak, CASE WHEN vec_id % 5 <> 0 THEN 105.0::DOUBLE END AS t_off, CASE WHEN vec_id % 4 <> 0 THEN 118.0::DOUBLE END AS nq, 480.0::DOUBLE + vec_id % 90 AS rr, CASE WHEN vec_id % 2 = 0 THEN 500.0::DOUBLE END AS rr_ii,
  1 - vec_id % 8 / 20.0::DOUBLE AS c FROM embeddings),
i AS (SELECT *, floor(q_on / 2 + 0.5)::INTEGER AS q, floor(s_off / 2 + 0.5)::INTEGER AS s, CASE WHEN nq IS NOT NULL THEN floor(nq / 2 + 0.5)::INTEGER END AS n FROM x),
l AS (SELECT *, list_median(mv[q - 8 + 1 : q - 2 + 1]) AS base, list_median(mv[n - 8 + 1 : n - 2 + 1]) AS nbase, mv[q + 1 : s + 1] AS qrs FROM i),
r AS (SELECT *, list_position(qrs, list_max(qrs)) AS rp FROM l),
w AS (SELECT *, list_max(qrs) - base AS r, base - list_min(qrs[1 : rp]) AS qd, base - list_min(qrs[rp : len(qrs)]) AS sd, mv[floor(p_on / 2 + 0.5)::INTEGER + 1 : floor(p_off / 2 + 0.5)::INTEGER + 1] AS p,
  floor(t_peak / 2 + 0.5)::INTEGER AS ti, floor((s_off - 7.7 + 60) / 2 + 0.5)::INTEGER AS ji, 2 * 0.023::DOUBLE AS least_mv FROM r),
y AS (SELECT *, base + CASE WHEN nbase IS NULL THEN 0 ELSE greatest(0, least(1, (ti - (q - 5.0::DOUBLE)) / (n - q))) * (nbase - base) END AS tl, base + CASE WHEN nbase IS NULL THEN 0 ELSE greatest(0, least(1, (ji - (q - 5.0::DOUBLE)) / (n - q))) * (nbase - base) END AS jl FROM w),
v AS (SELECT case_id, beat, c, 'r' AS key, CASE WHEN r >= least_mv THEN r ELSE 0 END AS value, CASE WHEN r < least_mv THEN 'r_absent' END AS reason FROM y
UNION ALL SELECT case_id, beat, c, 'q', CASE WHEN qd >= least_mv THEN -qd ELSE 0 END, CASE WHEN qd < least_mv THEN 'q_absent' END FROM y UNION ALL SELECT case_id, beat, c, 's', CASE WHEN sd >= least_mv THEN -sd ELSE 0 END, CASE WHEN sd < least_mv THEN 's_absent' END FROM y
UNION ALL SELECT case_id, beat, c, 'qrs', greatest(0, s_off - 7.7 - (q_on + 9.3)) / 1000, NULL FROM y UNION ALL SELECT case_id, beat, c, 'pDuration', (p_off - p_on) / 1000, NULL FROM y WHERE pf UNION ALL SELECT case_id, beat, c, 'pq', (q_on + 9.3 - p_on) / 1000, NULL FROM y WHERE pf
UNION ALL SELECT case_id, beat, c, 'pAmplitude', p[list_position(list_transform(p, lambda a: abs(a - base)), list_max(list_transform(p, lambda a: abs(a - base))))] - base, NULL FROM y WHERE pf
UNION ALL SELECT case_id, beat, c, 'qt', (t_off - (q_on + 9.3)) / 1000, NULL FROM y WHERE t_off IS NOT NULL UNION ALL SELECT case_id, beat, c, 'qtc', (t_off - (q_on + 9.3)) / 1000 - 0.087 * (coalesce(rr_ii, rr) / 1000 - 1), NULL FROM y WHERE t_off IS NOT NULL
UNION ALL SELECT case_id, beat, c, 't', mv[ti + 1] - tl, NULL FROM y WHERE ti IS NOT NULL UNION ALL SELECT case_id, beat, c, 'st', mv[ji + 1] - jl, NULL FROM y WHERE ji > s AND ji < 64 AND NOT (beat % 10 = 1 AND ji BETWEEN 50 AND 63))
"""


def _measured_beats(spark, sf):
    v = F.col("beat")
    e = T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("beat"), F.col("label").cast("long").alias("case_id"), F.transform("embedding", lambda x: x.cast("double")).alias("mv"))
    return e.withColumns({
        "q_on": 30.0 + v % 7, "s_off": 62.0 + v % 5, "p_found": v % 3 != 0, "p_on": F.lit(4.0), "p_off": 14.0 + v % 4, "t_peak": F.when(v % 5 != 0, 90.0 + v % 6), "t_off": F.when(v % 5 != 0, 105.0), "next_q_on": F.when(v % 4 != 0, 118.0),
        "rr_ms": 480.0 + v % 90, "rr_ii_ms": F.when(v % 2 == 0, 500.0), "beat_confidence": 1 - v % 8 / 20.0, "d_confidence": F.lit(1.0), "mv_per_px": F.lit(0.023), "shift_mv": F.lit(0.0),
        "bad": F.when(v % 10 == 1, F.array(F.struct(F.lit(50).alias("i0"), F.lit(63).alias("i1")))).otherwise(F.array().cast("array<struct<i0:int,i1:int>>")),
    })


@query("SELECT case_id, beat, key, round(value, 6) AS value, reason, round(c, 6) AS confidence FROM v", BEATS)
def beat_values(spark, sf):
    s = measure.sampled(_measured_beats(spark, sf))
    return s.select("case_id", "beat", "key", F.round("value", 6).alias("value"), "reason", F.round("confidence", 6).alias("confidence"))


@query("""SELECT case_id, key, round(median(value), 6) AS value, CASE WHEN key IN ('r', 'q', 's', 't', 'st', 'pAmplitude') THEN 'mV' ELSE 's' END AS unit, round(avg(c), 6) AS confidence, count(*) AS n,
CASE WHEN 2 * count(reason) > count(*) THEN first(reason ORDER BY beat) FILTER (reason IS NOT NULL) END AS reason FROM v GROUP BY ALL""", BEATS)
def case_values(spark, sf):
    s = measure.summary(measure.sampled(_measured_beats(spark, sf)))
    return s.select("case_id", "key", F.round("value", 6).alias("value"), "unit", F.round("confidence", 6).alias("confidence"), F.size("beats").cast("long").alias("n"), "reason")


@query("""SELECT k.case_id, k.key, CASE WHEN k.key = 'qtc' AND k.case_id % 2 = 1 THEN 'species_not_applicable' WHEN g.n IS NOT NULL THEN CASE WHEN 2 * g.m > g.n THEN g.reason END WHEN k.case_id % 5 = 4 THEN 'lead_ii_unreliable' WHEN k.key IN ('pDuration', 'pAmplitude', 'pq') THEN 'p_not_found' WHEN k.key IN ('qt', 'qtc', 't') THEN 't_not_found' ELSE 'low_confidence' END AS reason
FROM (SELECT DISTINCT label AS case_id, unnest(['pDuration', 'pAmplitude', 'pq', 'q', 'qrs', 'r', 's', 'qt', 'qtc', 't', 'st']) AS key FROM embeddings) k
LEFT JOIN (SELECT case_id, key, count(*) AS n, count(reason) AS m, first(reason ORDER BY beat) FILTER (reason IS NOT NULL) AS reason FROM v WHERE case_id % 5 <> 4 GROUP BY ALL) g USING (case_id, key)""", BEATS)
def measured_reasons(spark, sf):
    b = _measured_beats(spark, sf)
    cases = b.select("case_id").distinct().select("case_id", F.when(F.col("case_id") % 2 == 1, "cat").otherwise("dog").alias("species"), F.when(F.col("case_id") % 5 == 4, 0).otherwise(3).alias("n_selected"), F.lit("lead_ii_unreliable").alias("empty_reason"))
    return measure.measured(cases, measure.sampled(b).filter("case_id % 5 <> 4")).select("case_id", "key", "reason")


ORDER = """WITH RECURSIVE s AS (SELECT doc_id // 8 AS case_id, doc_id AS page, md5(text) AS digest, CASE WHEN doc_id % 5 <> 0 THEN lang END AS date, CASE WHEN doc_id % 6 <> 0 THEN concat_ws('|', source, lang) END AS head, (n_chars / 50)::DOUBLE AS a, (n_chars / 50 + 5)::DOUBLE AS b FROM documents),
o AS (SELECT *, CASE WHEN digest IS NULL THEN page ELSE min(page) OVER (PARTITION BY case_id, digest) END AS original FROM s),
own AS (SELECT * FROM o WHERE page = original), clear AS (SELECT * FROM own WHERE head IS NOT NULL), unclear AS (SELECT * FROM own WHERE head IS NULL),
near AS (SELECT u.case_id, u.page, u.date, max(c.page) FILTER (c.page < u.page) AS before, min(c.page) FILTER (c.page > u.page) AS after FROM unclear u LEFT JOIN clear c ON c.case_id = u.case_id AND (c.date IS NULL OR u.date IS NULL OR c.date = u.date) GROUP BY ALL),
lone AS (SELECT * FROM near WHERE before IS NULL AND after IS NULL),
link AS (SELECT x.page AS a, y.page AS b FROM clear x JOIN clear y ON x.case_id = y.case_id AND x.head = y.head
  UNION ALL SELECT page, coalesce(before, after) FROM near WHERE before IS NOT NULL OR after IS NOT NULL
  UNION ALL SELECT l.page, min(u.page) FROM lone l JOIN unclear u ON u.case_id = l.case_id AND u.date IS NOT DISTINCT FROM l.date AND u.page <> l.page GROUP BY l.page
  UNION ALL SELECT l.page, min(u.page) FROM lone l JOIN unclear u ON u.case_id = l.case_id AND u.date IS NULL AND u.page <> l.page GROUP BY l.page
  UNION ALL SELECT l.page, min(u.page) FROM lone l JOIN unclear u ON u.case_id = l.case_id AND l.date IS NULL AND u.page <> l.page GROUP BY l.page),
e AS (SELECT a, b FROM link UNION SELECT b, a FROM link), reach AS (SELECT page AS a, page AS b FROM own UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
g AS (SELECT own.*, head IS NOT NULL AS comparable, (SELECT min(b) FROM reach WHERE reach.a = own.page) AS grp FROM own),
n AS (SELECT *, dense_rank() OVER (PARTITION BY case_id ORDER BY grp) - 1 AS group_no, row_number() OVER (PARTITION BY grp ORDER BY a, page) - 1 AS place, count(*) OVER (PARTITION BY grp) AS size FROM g),
f AS (SELECT grp, page, place, b AS last, true AS counts FROM n WHERE place = 0
  UNION ALL SELECT n.grp, n.page, n.place, CASE WHEN least(f.last, n.b) - n.a < 1 THEN greatest(f.last, n.b) ELSE f.last END, least(f.last, n.b) - n.a < 1 FROM f JOIN n ON n.grp = f.grp AND n.place = f.place + 1),
h AS (SELECT n.*, f.counts, CASE WHEN NOT f.counts THEN (SELECT first(m.page ORDER BY m.place) FROM n m JOIN f k ON k.page = m.page WHERE m.grp = n.grp AND k.counts AND m.place < n.place AND least(m.b, n.b) - greatest(m.a, n.a) >= 1) END AS repeats FROM n JOIN f USING (page)),
p AS (SELECT case_id, first(group_no ORDER BY size DESC, group_no) AS top FROM h GROUP BY case_id),
r AS (SELECT o.case_id, o.page, o.original, h.group_no, h.place, CASE WHEN o.page = o.original THEN h.repeats END AS repeats, h.group_no = p.top AS "primary", h.comparable FROM o JOIN h ON h.page = o.original JOIN p ON p.case_id = o.case_id),
i AS (SELECT case_id, list_concat(list_concat(CASE WHEN max(group_no) > 0 THEN ['multiple_animals'] ELSE []::VARCHAR[] END, coalesce(list('duplicate:' || page ORDER BY page) FILTER (page <> original), [])),
  list_concat(coalesce(list('overlap:' || page ORDER BY page) FILTER (repeats IS NOT NULL), []), coalesce(list('animal_unverified:' || page ORDER BY page) FILTER (page = original AND NOT comparable), []))) AS issues FROM r GROUP BY case_id)
SELECT r.case_id, page, original, group_no::INTEGER AS group_no, place::INTEGER AS place, repeats, "primary", array_to_string(issues, ',') AS issues FROM r JOIN i USING (case_id)"""


@query(ORDER)
def case_sheet_order(spark, sf):
    """Documents as sheets, eight a case: the header's crop comes from source and language, the recording begins at a time from the length."""
    i = F.col("doc_id")
    crop = F.concat(*[F.unhex(F.md5(F.concat_ws("|", "source", "lang", F.lit(str(k))).cast("binary"))) for k in range(12)])
    d = T.table(spark, sf, "documents").select(
        F.floor(i / 8).alias("case_id"), i.alias("page"), i.alias("upload"), F.md5(F.col("text").cast("binary")).alias("digest"), F.when(i % 5 != 0, F.col("lang")).alias("date"), F.lit(24).alias("width"),
        F.when(i % 6 != 0, crop).alias("crop"), (F.col("n_chars") / 50.0).alias("start_s"), (F.col("n_chars") / 50.0 + 5).alias("end_s"),
    )
    return order.ordered(d).select("case_id", "page", "original", "group_no", "place", "repeats", "primary", F.array_join("issues", ",").alias("issues"))


@query()
def analyzed_cases(spark, sf):
    """Whole cases, from the pages that events draw to the text of the conclusion: every beat and mark comes from the signals, every finding and value from those."""
    sheets = cut(waves.sheets(spark, sf), "sheets")
    k = F.col("case_id")
    settings = sheets.select("case_id").distinct().select(
        "case_id", F.when(k % 3 == 2, "cat").otherwise("dog").alias("species"), F.when(k % 2 == 0, "small").otherwise("large").alias("size"), F.when(k % 4 == 0, "atenolol").alias("drugs"), F.when(k % 6 == 0, 5.0).alias("minutes"), (k % 7 == 0).alias("together"),
    )
    r = analysis.analyze_pages(sheets, waves.pages(waves.page_beats(spark, sf), analysis.facts(sheets, settings)), settings).report
    rounded = {"confidence": F.round("confidence", 6), "hr_mean": F.round("hr_mean", 6), "covered_ms": F.round("covered_ms", 3), "issues": F.array_join("issues", ","), "flags": F.array_join("flags", ","), "reasons": F.array_join("reasons", ",")}
    return r.withColumns(rounded)
