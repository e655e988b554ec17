"""Registered queries of the sheet engine, bound to the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulseframe.functions.exprs import half_up, mean_of_cents, plural, significant
from pulseframe.kernels import bridge
from pulseframe.operators import case, norms, rhythm, signals, spans
from pulseframe.plans import registry
from pulseframe.sources import tables as T
from pulseframe.sources import waves
from pulseframe.streaming import rates

def query(sql: str | None = None):
    return registry.query(sql, WITH if sql and sql.lstrip().startswith(",") else "")


def r6(c: str, name: str | None = None):
    return F.round(F.col(c), 6).alias(name or c)


#: What the rhythm queries' SQL starts from.
WITH = """WITH b AS (SELECT user_id // 4 AS case_id, user_id AS page, event_id AS beat_id, epoch_us(ts) / 1000.0::DOUBLE AS t, event_type AS lead, value FROM events),
rr AS (SELECT *, row_number() OVER w - 1 AS i, t - lag(t) OVER w AS rr FROM b WINDOW w AS (PARTITION BY page ORDER BY t, beat_id)),
m AS (SELECT *, CASE WHEN count(rr) OVER (PARTITION BY case_id) >= 3 THEN median(rr) OVER (PARTITION BY case_id) END AS med FROM rr),
p AS (SELECT *, coalesce(rr < 0.8 * med, false) AS early FROM m)
"""


@query(", x AS (SELECT page, beat_id, i AS beat_index, round(rr, 3) AS rr_ms FROM rr) SELECT * FROM x")
def rr_intervals(spark, sf):
    return rhythm.rr(T.beats(spark, sf)).select("page", "beat_id", "beat_index", F.round("rr_ms", 3).alias("rr_ms"))


@query(", x AS (SELECT beat_id, row_number() OVER (ORDER BY page, t, beat_id) - 1 AS global_index FROM b) SELECT * FROM x")
def beat_global_index(spark, sf):
    return rhythm.global_index(T.beats(spark, sf)).select("beat_id", "global_index")


@query(", x AS (SELECT page, count(rr) AS n_rr, round(60000 / avg(rr), 9) AS hr_mean, round(60000 / max(rr), 9) AS hr_min, round(60000 / min(rr), 9) AS hr_max FROM rr GROUP BY page) SELECT * FROM x")
def hr_summary(spark, sf):
    h = rhythm.heart_rate(T.beats(spark, sf))
    return h.select("page", "n_rr", *[F.round(c, 9).alias(c) for c in ("hr_mean", "hr_min", "hr_max")])


@query(", x AS (SELECT DISTINCT case_id, round(med, 6) AS median_rr FROM m) SELECT * FROM x")
def rr_median_gate(spark, sf):
    return rhythm.with_median(T.beats(spark, sf)).groupBy("case_id").agg(F.round(F.max("median_rr"), 6).alias("median_rr"))


@query(", x AS (SELECT page, beat_id, early AS premature FROM p) SELECT * FROM x")
def premature_flags(spark, sf):
    return rhythm.premature(T.beats(spark, sf)).select("page", "beat_id", "premature")


COUNTED = """, k AS (SELECT *, rr IS NOT NULL AND NOT early AND NOT coalesce(lag(early) OVER w, false) AS ok FROM p WINDOW w AS (PARTITION BY page ORDER BY t, beat_id)),
d AS (SELECT *, CASE WHEN ok AND lag(ok) OVER w THEN abs(rr - lag(rr) OVER w) END AS change FROM k WINDOW w AS (PARTITION BY page ORDER BY t, beat_id)),
v AS (SELECT case_id, coalesce(coalesce(stddev_samp(rr) FILTER (ok), 0) / avg(rr) FILTER (ok), 0) AS cv, coalesce(max(change), 0) AS max_change, count(*) FILTER (ok) AS n FROM d GROUP BY case_id)"""


@query(COUNTED + " SELECT case_id, round(cv, 6) AS cv, round(max_change, 6) AS max_change, n FROM v")
def rr_variation(spark, sf):
    return rhythm.variation(rhythm.premature(T.beats(spark, sf))).select("case_id", r6("cv"), r6("max_change"), "n")


@query(COUNTED + """, q AS (SELECT case_id, median(value) FILTER (NOT early) AS ref FROM p GROUP BY case_id)
SELECT p.page, beat_id, early AS candidate,
       early AND (NOT (coalesce(cv, 0) > 0.1 OR max_change >= 120) OR value IS NULL OR ref IS NULL OR abs(value - ref) > 0.2 * ref) AS premature
FROM p JOIN v USING (case_id) JOIN q USING (case_id)""")
def premature_corrected(spark, sf):
    return rhythm.premature_corrected(T.beats(spark, sf)).select("page", "beat_id", "candidate", "premature")


@query(""", x AS (SELECT *, coalesce(lag(early) OVER (PARTITION BY page ORDER BY t, beat_id), false) AS after, median(rr) OVER (PARTITION BY case_id) AS m2, count(rr) OVER (PARTITION BY case_id) AS n FROM p)
SELECT page, beat_id, round(rr, 3) AS rr_ms FROM x WHERE n >= 2 AND rr >= 2 * m2 AND NOT after""")
def pauses(spark, sf):
    return rhythm.pauses(T.beats(spark, sf)).select("page", "beat_id", F.round("rr_ms", 3).alias("rr_ms"))


@query(""", x AS (SELECT *, i - row_number() OVER (PARTITION BY page ORDER BY i) AS g FROM p WHERE early),
c AS (SELECT page, g, lead, count(*) AS c, min(i) AS s FROM x GROUP BY ALL),
k AS (SELECT page, g, first(lead ORDER BY c DESC, s) AS kind FROM c GROUP BY page, g),
e AS (SELECT case_id, max(t) + 600000 AS last FROM b GROUP BY case_id),
r AS (SELECT case_id, page, g, min(i) AS first_index, count(*) AS n, min(t) AS a, max(t) AS z FROM x GROUP BY case_id, page, g HAVING count(*) >= 3)
SELECT page, first_index, n, kind, round(least((z - a) + (z - a) / (n - 1), last - a), 6) AS duration_ms FROM r JOIN k USING (page, g) JOIN e USING (case_id)""")
def ectopic_runs(spark, sf):
    b = T.beats(spark, sf)
    ends = b.groupBy("case_id").agg((F.max("t_ms") + 600_000).alias("end_ms"))
    return rhythm.runs(rhythm.premature(b), ends).select("page", "first_index", "n", "kind", r6("duration_ms"))


@query(""", x AS (SELECT *, last_value(CASE WHEN NOT early THEN t END IGNORE NULLS) OVER (PARTITION BY page ORDER BY t, beat_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p)
SELECT page, beat_id, round(coalesce(t - before, rr), 6) AS coupling_ms FROM x WHERE early""")
def coupling_asof(spark, sf):
    return rhythm.coupling(T.beats(spark, sf)).select("page", "beat_id", r6("coupling_ms"))


@query(""", x AS (SELECT *, coalesce(lag(early) OVER w, false) OR coalesce(lead(early) OVER w, false) AS near FROM p WINDOW w AS (PARTITION BY page ORDER BY t, beat_id))
SELECT page, beat_id, round(1 - 1 / (1 + value), 6) AS confidence FROM x WHERE 1 - 1 / (1 + value) >= 0.6 AND NOT early AND NOT near""")
def measurement_beats(spark, sf):
    b = rhythm.measurement_beats(T.beats(spark, sf), 1 - 1 / (1 + F.col("value")))
    return b.select("page", "beat_id", r6("confidence"))


@query("""WITH b AS (SELECT user_id AS page, epoch_us(ts) AS t, event_type AS lead FROM events),
x AS (SELECT page, t // 86400000000 AS beat, median(t) AS t_us, count(DISTINCT lead) AS n_leads, max(t) - min(t) AS spread_us FROM b GROUP BY ALL)
SELECT page, beat, t_us, n_leads, spread_us,
       round(CASE WHEN spread_us <= 3600000000 THEN 1.0 ELSE greatest(0.2, 1 - (spread_us - 3600000000) / 10800000000::DOUBLE) END, 6) AS confidence FROM x""")
def lead_consensus(spark, sf):
    us = F.round(F.col("t_ms") * 1000).cast("long")
    m = T.beats(spark, sf).withColumn("beat", F.floor(us / 86_400_000_000)).withColumn("t_ms", us)
    c = rhythm.consensus(m, ["page", "beat"], 3_600_000_000.0)
    return c.select("page", "beat", F.col("t_ms").alias("t_us"), "n_leads", F.col("spread_ms").alias("spread_us"), r6("confidence"))


@query(""", mid AS (SELECT page, beat_id, t - rr / 2 AS mt FROM rr WHERE rr IS NOT NULL), d AS (SELECT page, beat_id AS digit_id, t FROM b WHERE lead = 'purchase'),
x AS (SELECT d.page, digit_id, mid.beat_id, abs(mt - d.t) AS distance, row_number() OVER (PARTITION BY d.page, digit_id ORDER BY abs(mt - d.t), mt, mid.beat_id) AS no FROM d JOIN mid USING (page))
SELECT page, digit_id, beat_id, round(distance, 3) AS distance_ms FROM x WHERE no = 1""")
def nearest_interval_match(spark, sf):
    b = T.beats(spark, sf)
    d = b.filter("lead = 'purchase'").select("page", F.col("beat_id").alias("digit_id"), "t_ms")
    return rhythm.nearest_interval(d, b).select("page", "digit_id", "beat_id", F.round("distance_ms", 3).alias("distance_ms"))


@query(""", x AS (SELECT page, beat_id, 60000 / rr AS hr, 60000 / med AS printed, greatest(3, 2 * 60000 * 4.6 / (rr * rr)) AS tol FROM p WHERE rr > 0 AND med > 0)
SELECT page, beat_id, CASE WHEN abs(hr - printed) <= tol THEN 'ok' ELSE 'bad' END AS verdict FROM x""")
def hr_tolerance_verdict(spark, sf):
    b = rhythm.with_median(T.beats(spark, sf)).filter("rr_ms > 0 AND median_rr > 0")
    tol = F.greatest(F.lit(3.0), 2 * 60_000 * 4.6 / (F.col("rr_ms") * F.col("rr_ms")))
    return b.select("page", "beat_id", F.when(F.abs(60_000 / F.col("rr_ms") - 60_000 / F.col("median_rr")) <= tol, "ok").otherwise("bad").alias("verdict"))


@query("""WITH x AS (SELECT l_suppkey AS key, l_returnflag AS reason, count(*) AS c FROM lineitem GROUP BY ALL),
y AS (SELECT key, max(reason) FILTER (2 * c > n) AS reason FROM (SELECT *, sum(c) OVER (PARTITION BY key) AS n FROM x) GROUP BY key)
SELECT l_suppkey AS key, round(median(l_extendedprice), 6) AS value, round(avg(l_discount), 6) AS confidence, count(*) AS n, any_value(y.reason) AS reason
FROM lineitem JOIN y ON key = l_suppkey GROUP BY l_suppkey""")
def measurement_aggregate(spark, sf):
    l = T.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"), "l_returnflag", "l_extendedprice", "l_discount")
    a = l.groupBy("key").agg(F.round(F.median("l_extendedprice"), 6).alias("value"), F.round(F.avg("l_discount"), 6).alias("confidence"), F.count(F.lit(1)).alias("n"))
    c = l.groupBy("key", "l_returnflag").agg(F.count(F.lit(1)).alias("c")).join(a.select("key", "n"), "key").filter("2 * c > n").select("key", F.col("l_returnflag").alias("reason"))
    return a.join(c, "key", "left").select("key", "value", "confidence", "n", "reason")


MEASURED = """WITH x AS (SELECT l_orderkey AS case_id, l_linenumber AS no, ['dog-small', 'dog-large', 'cat'][1 + (l_partkey % 3)::INTEGER] AS profile,
['hrMean', 'pq', 'st', 'axis', 'q', 't', 'qtc'][1 + (l_suppkey % 7)::INTEGER] AS key, l_quantity * 6 AS raw, l_discount * 20 AS r FROM lineitem),
v AS (SELECT *, CASE key WHEN 'hrMean' THEN raw WHEN 'axis' THEN raw - 30 WHEN 'pq' THEN raw / 1500 WHEN 'st' THEN raw / 750 - 0.2 ELSE raw / 150 - 1 END AS value FROM x),
n AS (SELECT * FROM (VALUES ('dog-small','hrMean',70.0::DOUBLE,180.0::DOUBLE,60.0::DOUBLE,NULL::DOUBLE,'range'),('dog-large','hrMean',70,160,60,NULL,'range'),('cat','hrMean',140,220,120,240,'range'),
('dog-small','pq',.06,.13,NULL,NULL,'range'),('dog-large','pq',.06,.13,NULL,NULL,'range'),('cat','pq',.05,.09,NULL,NULL,'range'),
('dog-small','st',-.1,.1,-.2,.15,'range'),('dog-large','st',-.1,.1,-.2,.15,'range'),('cat','st',-.05,.05,-.1,.1,'range'),
('dog-small','axis',40,100,30,110,'range'),('dog-large','axis',40,100,30,110,'range'),('cat','axis',0,160,-10,170,'range'),
('dog-small','q',NULL,.5,NULL,NULL,'border'),('dog-large','q',NULL,.5,NULL,NULL,'border'),
('dog-small','t',NULL,1.0,NULL,NULL,'fraction'),('dog-large','t',NULL,1.0,NULL,NULL,'fraction'),('cat','t',NULL,.3,NULL,NULL,'sign')) AS n(profile, key, lo, hi, bl, bh, rule)),
w AS (SELECT v.*, rule, CASE WHEN rule = 'range' THEN value ELSE abs(value) END AS a, lo, CASE WHEN rule = 'fraction' THEN least(hi, 0.25 * r) ELSE hi END AS hi, bl, bh FROM v LEFT JOIN n USING (profile, key)),
c AS (SELECT *, CASE WHEN rule IS NULL THEN 'n/a'
  WHEN a < coalesce(bl, lo - abs(lo) * 0.1) - 1e-9 AND a < lo - 1e-9 OR a > coalesce(bh, hi + abs(hi) * 0.1) + 1e-9 AND a > hi + 1e-9 THEN CASE WHEN rule = 'border' THEN 'border' ELSE 'abnormal' END
  WHEN a < lo - 1e-9 OR a > hi + 1e-9 OR rule = 'sign' AND value < 0 THEN 'border' ELSE 'norm' END AS verdict FROM w)
"""


def _measured(spark, sf):
    l = T.table(spark, sf, "lineitem")
    pick = lambda names, c: F.element_at(F.array(*[F.lit(x) for x in names]), (c + 1).cast("int"))
    raw, key = F.col("l_quantity") * 6, pick(["hrMean", "pq", "st", "axis", "q", "t", "qtc"], F.col("l_suppkey") % 7)
    value = F.when(key == "hrMean", raw).when(key == "axis", raw - 30).when(key == "pq", raw / 1500).when(key == "st", raw / 750 - 0.2).otherwise(raw / 150 - 1)
    m = l.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("no"), pick(["dog-small", "dog-large", "cat"], F.col("l_partkey") % 3).alias("profile"), key.alias("key"), value.alias("value"), (F.col("l_discount") * 20).alias("r"))
    return norms.classify(m, spark)


@query(MEASURED + "SELECT case_id, no, profile, key, verdict, count(*) AS n FROM c GROUP BY ALL")
def classify_norms(spark, sf):
    return _measured(spark, sf).groupBy("case_id", "no", "profile", "key", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(MEASURED + "SELECT case_id, max(CASE verdict WHEN 'abnormal' THEN 2 WHEN 'border' THEN 1 WHEN 'norm' THEN 0 ELSE -1 END) AS severity FROM c GROUP BY case_id")
def worst_verdict(spark, sf):
    return norms.worst(_measured(spark, sf), ["case_id"]).select("case_id", "severity")


@query("""WITH x AS (SELECT c_custkey AS case_id, CASE c_custkey % 3 WHEN 0 THEN 'cat' ELSE 'dog' END AS species, CASE c_custkey % 4 WHEN 1 THEN 'small' WHEN 2 THEN 'large' END AS size FROM customer)
SELECT case_id, CASE WHEN species = 'cat' THEN 'cat' WHEN size = 'small' THEN 'dog-small' ELSE 'dog-large' END AS profile FROM x""")
def norm_lookup_default(spark, sf):
    c = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"))
    species = F.when(F.col("case_id") % 3 == 0, "cat").otherwise("dog")
    size = F.when(F.col("case_id") % 4 == 1, "small").when(F.col("case_id") % 4 == 2, "large")
    return c.select("case_id", norms.profile_of(species, size).alias("profile"))


@query(""", x AS (SELECT *, lead(t) OVER w AS t1, lead(value) OVER w AS v1 FROM b WINDOW w AS (PARTITION BY page ORDER BY t, beat_id))
SELECT page, beat_id, round(CASE WHEN t1 IS NULL OR t1 = t THEN value ELSE value + (v1 - value) * 0.25 END, 6) AS level FROM x""")
def baseline_interpolation(spark, sf):
    b = T.beats(spark, sf).withColumn("t1", F.lead("t_ms").over(rhythm.by_page())).withColumn("v1", F.lead("value").over(rhythm.by_page()))
    t = F.col("t_ms") + (F.col("t1") - F.col("t_ms")) * 0.25
    return b.select("page", "beat_id", F.round(signals.interpolated(t, F.col("t_ms"), F.col("value"), F.col("t1"), F.col("v1")), 6).alias("level"))


SIGNAL = "WITH s AS (SELECT vec_id AS lead, label AS page, embedding::DOUBLE[] AS mv FROM embeddings), e AS (SELECT lead, page, unnest(mv) AS v, generate_subscripts(mv, 1) - 1 AS k FROM s)\n"


@query(SIGNAL + "SELECT lead, (list_position(mv, list_max(mv)) - 1)::BIGINT AS place FROM s")
def signal_argmax(spark, sf):
    return T.signals(spark, sf).select("lead", signals.argmax(F.col("mv")).alias("place"))


@query(SIGNAL + ", x AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS z, max(v) OVER (PARTITION BY e.lead) AS top FROM e WINDOW w AS (PARTITION BY e.lead ORDER BY k)) SELECT lead, count(*) AS n, sum(k)::BIGINT AS places FROM x WHERE v > a AND v >= z AND v > 0.02 * top GROUP BY lead")
def signal_local_maxima(spark, sf):
    s = T.signals(spark, sf).select("lead", F.explode(signals.local_maxima(F.col("mv"))).alias("k"))
    return s.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("places"))


@query(SIGNAL + ", x AS (SELECT e.lead, k, sum(v) OVER (PARTITION BY e.lead ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS v FROM e) SELECT lead, k, round(v, 6) AS v FROM x")
def moving_average(spark, sf):
    return T.signals(spark, sf).select("lead", F.posexplode(signals.moving_average(F.col("mv"), 2)).alias("k", "v")).select("lead", F.col("k").cast("long").alias("k"), r6("v"))


DERIVED = SIGNAL + """, d AS (SELECT e.lead, k, (2 * coalesce(lead(v, 2) OVER w, last_value(v) OVER z) + coalesce(lead(v) OVER w, v) - coalesce(lag(v) OVER w, v) - 2 * coalesce(lag(v, 2) OVER w, first_value(v) OVER z)) / 8 AS d FROM e
WINDOW w AS (PARTITION BY e.lead ORDER BY k), z AS (PARTITION BY e.lead ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query(DERIVED + " SELECT lead, k, round(d, 6) AS d FROM d")
def five_point_derivative(spark, sf):
    return T.signals(spark, sf).select("lead", F.posexplode(signals.derivative(F.col("mv"))).alias("k", "d")).select("lead", F.col("k").cast("long").alias("k"), r6("d"))


@query(DERIVED + ", x AS (SELECT d.lead, sum(d * d) OVER (PARTITION BY d.lead ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS e FROM d) SELECT lead, round(max(e), 6) AS peak, round(sum(e), 6) AS total FROM x GROUP BY lead")
def energy_feature(spark, sf):
    e = T.signals(spark, sf).select("lead", F.explode(signals.energy(F.col("mv"))).alias("e"))
    return e.groupBy("lead").agg(F.round(F.max("e"), 6).alias("peak"), F.round(F.sum("e"), 6).alias("total"))


@query(SIGNAL + "SELECT lead, round(list_sort(mv)[1 + least(len(mv) - 1, floor(len(mv) * 0.99)::INTEGER)], 6) AS value FROM s")
def order_statistic_99(spark, sf):
    return T.signals(spark, sf).select("lead", F.round(signals.order_statistic(F.col("mv")), 6).alias("value"))


@query(SIGNAL + "SELECT page, k, round(median(v), 6) AS level FROM e GROUP BY page, k HAVING count(*) >= 3")
def median_template(spark, sf):
    return signals.template(T.signals(spark, sf)).select("page", F.col("k").cast("long").alias("k"), r6("level"))


@query(SIGNAL + ", t AS (SELECT page, k, median(v) AS m FROM e GROUP BY page, k HAVING count(*) >= 3) SELECT e.lead, e.page, round(corr(v, m), 6) AS rho, corr(v, m) < 0.8 AS outlier FROM e JOIN t USING (page, k) GROUP BY e.lead, e.page")
def template_correlation(spark, sf):
    c = signals.likeness(T.signals(spark, sf))
    return c.select("lead", "page", r6("rho"), (F.col("rho") < 0.8).alias("outlier"))


@query(SIGNAL + "SELECT lead, round(2 * (list_sum(mv[11:31]) - 21 * (list_sort(mv[3:9])[4])), 6) AS area, round(list_sort(mv[3:9])[4], 6) AS base FROM s")
def net_area(spark, sf):
    base = signals.level(F.col("mv"), 2, 8)
    return T.signals(spark, sf).select("lead", F.round(signals.net_area(F.col("mv"), 10, 30, base), 6).alias("area"), F.round(base, 6).alias("base"))


@query(SIGNAL + "SELECT lead, x, round(mv[1 + greatest(0, least(len(mv) - 1, list_position(mv, list_max(mv)) - 1 + x))], 6) AS v FROM s, (SELECT unnest(generate_series(-5, 5)) AS x)")
def clamp_window(spark, sf):
    w = T.signals(spark, sf).withColumn("peak", signals.argmax(F.col("mv"))).select("lead", F.posexplode(signals.window_of(F.col("mv"), F.col("peak"), 5)).alias("k", "v"))
    return w.select("lead", (F.col("k").cast("long") - 5).alias("x"), r6("v"))


@query(SIGNAL + """, d AS (SELECT e.lead, v - 2 * lag(v) OVER w + lag(v, 2) OVER w AS d FROM e WINDOW w AS (PARTITION BY e.lead ORDER BY k)),
m AS (SELECT lead, median(d) AS m FROM d GROUP BY lead) SELECT d.lead, round(1.4826 * median(abs(d - m)) / sqrt(6.0::DOUBLE), 6) AS sigma FROM d JOIN m USING (lead) WHERE d IS NOT NULL GROUP BY d.lead""")
def noise_mad(spark, sf):
    return T.signals(spark, sf).select("lead", F.round(signals.noise(F.col("mv")), 6).alias("sigma"))


@query(SIGNAL + "SELECT lead, round(regr_slope(v, k), 9) AS slope, round(10 + (0.5 - any_value(v) FILTER (k = 10)) / regr_slope(v, k), 3) AS crossing FROM e GROUP BY lead")
def ols_slope(spark, sf):
    s = T.signals(spark, sf).withColumn("slope", signals.slope(F.col("mv")))
    x = signals.tangent_crossing(F.lit(10.0), F.get("mv", 10), F.col("slope"), F.lit(0.5))
    return s.select("lead", F.round("slope", 9).alias("slope"), F.round(x, 3).alias("crossing"))


@query(SIGNAL + ", a AS (SELECT page, lead, list_sum(mv[1:32]) AS i, list_sum(mv[33:64]) AS f FROM s) SELECT page, floor(degrees(atan2(median(f), median(i))) * 10 + 0.5) / 10 AS axis FROM a GROUP BY page")
def axis_angle(spark, sf):
    a = T.signals(spark, sf).select("page", signals.sum_of(F.slice("mv", 1, 32)).alias("area_i"), signals.sum_of(F.slice("mv", 33, 32)).alias("area_avf"))
    return signals.axis(a)


SPAN = "WITH s AS (SELECT user_id AS page, event_id AS span_id, event_type AS kind, epoch_us(ts) / 1000.0::DOUBLE AS a, epoch_us(ts) / 1000.0::DOUBLE + value * 60000 AS z FROM events)\n"
MERGED = """, g AS (SELECT *, max(z) OVER (PARTITION BY page, kind ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
h AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach < a THEN 1 ELSE 0 END) OVER (PARTITION BY page, kind ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS no FROM g),
u AS (SELECT page, kind, no, min(a) AS a, max(z) AS z, count(*) AS n FROM h GROUP BY ALL)"""


@query(SPAN + MERGED + " SELECT page, kind, round(a, 3) AS start_ms, round(z, 3) AS end_ms, n FROM u")
def interval_merge(spark, sf):
    m = spans.merged(T.spans(spark, sf), ["page", "kind"])
    return m.select("page", "kind", F.round("start_ms", 3).alias("start_ms"), F.round("end_ms", 3).alias("end_ms"), "n")


def _clean(spark, sf, how):
    errors = spans.merged(T.spans(spark, sf).filter("kind = 'error'"), ["page"])
    return spans.covered(T.beats(spark, sf).filter("lead = 'click'"), errors, 3_600_000.0, how).select("page", "beat_id")


@query(SPAN + "SELECT page, span_id AS beat_id FROM s c WHERE kind = 'click' AND EXISTS (SELECT 1 FROM s e WHERE e.kind = 'error' AND e.page = c.page AND c.a BETWEEN e.a AND e.z)")
def span_contains(spark, sf):
    return _clean(spark, sf, "left_semi")


@query(SPAN + "SELECT page, span_id AS beat_id FROM s c WHERE kind = 'click' AND NOT EXISTS (SELECT 1 FROM s e WHERE e.kind = 'error' AND e.page = c.page AND c.a BETWEEN e.a AND e.z)")
def span_anti(spark, sf):
    return _clean(spark, sf, "left_anti")


@query(SPAN + "SELECT x.page, x.span_id AS a, y.span_id AS b, round(least(x.z, y.z) - greatest(x.a, y.a), 3) AS shared_ms FROM s x JOIN s y ON x.page = y.page AND x.span_id < y.span_id AND least(x.z, y.z) - greatest(x.a, y.a) >= 1000")
def overlap_pairs(spark, sf):
    return spans.overlaps(T.spans(spark, sf), 1000.0, 3_600_000.0).select("page", "a", "b", F.round("shared_ms", 3).alias("shared_ms"))


@query(SPAN.replace("WITH", "WITH RECURSIVE") + """, o AS (SELECT page, list({'a': a, 'id': span_id, 'z': z} ORDER BY a, span_id) AS xs FROM s GROUP BY page),
f AS (SELECT page, xs, 1 AS i, []::STRUCT(a DOUBLE, id BIGINT, z DOUBLE)[] AS kept FROM o UNION ALL
SELECT page, xs, i + 1, CASE WHEN len(list_filter(kept, lambda k: least(k.z, xs[i].z) - greatest(k.a, xs[i].a) >= 1000)) > 0 THEN kept ELSE list_append(kept, xs[i]) END FROM f WHERE i <= len(xs))
SELECT f.page, s.span_id, list_contains(list_transform(kept, lambda k: k.id), s.span_id) AS kept FROM f JOIN s USING (page) WHERE i = len(xs) + 1""")
def overlap_greedy(spark, sf):
    return spans.greedy(T.spans(spark, sf), 1000.0)


@query(""", x AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY page, lead ORDER BY t) <= 86400000 THEN 0 ELSE 1 END AS s FROM b),
y AS (SELECT *, sum(s) OVER (PARTITION BY page, lead ORDER BY t) AS no FROM x)
SELECT page, lead, round(min(t), 3) AS first, round(max(t), 3) AS last, count(*) AS n FROM y GROUP BY page, lead, no""")
def mask_islands(spark, sf):
    i = spans.islands(T.beats(spark, sf), ["page", "lead"], "t_ms", 86_400_000.0)
    return i.select("page", "lead", F.round("first", 3).alias("first"), F.round("last", 3).alias("last"), "n")


@query("SELECT doc_id AS sheet_id, min(doc_id) OVER (PARTITION BY md5(text)) AS original, min(doc_id) OVER (PARTITION BY md5(text)) <> doc_id AS copy FROM documents")
def byte_duplicates(spark, sf):
    d = T.table(spark, sf, "documents").select(F.col("doc_id").alias("sheet_id"), F.md5(F.col("text").cast("binary")).alias("digest"))
    return case.canonical(d)


@query("""WITH g AS (SELECT source AS "group", count(*) AS n, min(doc_id) AS first FROM documents GROUP BY source)
SELECT "group", n, first, row_number() OVER (ORDER BY n DESC, first) = 1 AS "primary" FROM g""")
def primary_group(spark, sf):
    return case.largest_group(T.table(spark, sf, "documents").select(F.col("doc_id").alias("sheet_id"), F.col("source").alias("group")))


@query("""WITH x AS (SELECT o_custkey AS "group", o_orderkey AS page_no, round(o_totalprice / 1000, 3) AS d FROM orders)
SELECT "group", page_no, round(coalesce(sum(d) OVER w, 0), 3) AS offset_s, round(coalesce(sum(d) OVER w, 0) + d, 3) AS end_s FROM x
WINDOW w AS (PARTITION BY "group" ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def page_offsets(spark, sf):
    p = T.table(spark, sf, "orders").select(F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("page_no"), F.round(F.col("o_totalprice") / 1000, 3).alias("duration_s"))
    return case.offsets(p).select("group", "page_no", F.round("offset_s", 3).alias("offset_s"), F.round("end_s", 3).alias("end_s"))


@query("SELECT conv_id AS key, role AS kind, max_by(text, turn) AS value, max(turn) AS seq, count(*) AS n_edits FROM conversations GROUP BY ALL")
def edits_last_wins(spark, sf):
    e = T.table(spark, sf, "conversations").select(F.col("conv_id").alias("key"), F.col("role").alias("kind"), F.col("turn").alias("seq"), F.col("text").alias("value"))
    return case.last_wins(e, ["key", "kind"])


@query("""WITH s AS (SELECT k.conv_id AS key, 'L' || p AS slot, p AS position FROM (SELECT DISTINCT conv_id FROM conversations) k, generate_series(0, 5) AS g(p)),
e AS (SELECT conv_id AS key, 'L' || (turn % 6) AS slot, 'L' || (length(text) % 6) AS target, turn AS seq FROM conversations),
l AS (SELECT key, slot, max_by(target, seq) AS target, max(seq) AS rank FROM e GROUP BY ALL),
t AS (SELECT s.key, s.slot AS trace, coalesce(target, s.slot) AS slot, coalesce(rank, -1) AS rank, position FROM s LEFT JOIN l USING (key, slot)),
r AS (SELECT *, row_number() OVER (PARTITION BY key, slot ORDER BY rank DESC, position DESC) AS no, count(*) OVER (PARTITION BY key, slot) AS c FROM t)
SELECT s.key, s.slot, r.trace, coalesce(c > 1, false) AS conflict FROM s LEFT JOIN r ON s.key = r.key AND s.slot = r.slot AND no = 1""")
def relabel_conflict(spark, sf):
    c = T.table(spark, sf, "conversations")
    name = lambda x: F.concat(F.lit("L"), x.cast("string"))
    slots = c.select(F.col("conv_id").alias("key")).distinct().select("key", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("position")).withColumn("slot", name(F.col("position")))
    edits = c.select(F.col("conv_id").alias("key"), name(F.col("turn") % 6).alias("slot"), name(F.length("text") % 6).alias("target"), F.col("turn").alias("seq"))
    return case.relabelled(slots, edits)


@query("SELECT page_id, CASE WHEN starts_with(html, '%PDF') OR lower(split_part(url, '?', 1)) LIKE '%.pdf' THEN 'pdf' ELSE 'unknown' END AS kind FROM pages")
def file_kind(spark, sf):
    """Pages of HTML: none is an image, whatever its name says."""
    return T.table(spark, sf, "pages").select("page_id", T.file_kind(F.substring_index("url", "?", 1), F.lit(None).cast("string"), F.col("html").cast("binary")).alias("kind"))


@query(r"""WITH x AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS w FROM documents) SELECT doc_id, len(w) AS n, coalesce(list_max(list_transform(w, lambda v: length(v))), 0) AS longest FROM x""")
def number_words(spark, sf):
    w = T.table(spark, sf, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.coalesce(F.array_max(F.transform("w", lambda v: F.length(v))), F.lit(0)).cast("long").alias("longest"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y %H:%M:%S') AS header, (o_orderkey % 100)::VARCHAR || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') AS label, (o_orderkey % 100) * 60 + o_orderkey % 60 AS seconds FROM orders")
def time_label_parse(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy HH:mm:ss").alias("header"), F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit(":"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0")).alias("label"))
    return o.withColumn("seconds", F.regexp_extract("label", r"^(\d+):(\d\d)$", 1).cast("long") * 60 + F.regexp_extract("label", r"^(\d+):(\d\d)$", 2).cast("long"))


@query("""WITH c AS (SELECT l_suppkey, l_quantity, count(*) AS c, min(l_orderkey * 10 + l_linenumber) AS seen FROM lineitem GROUP BY ALL)
SELECT l_suppkey, first(l_quantity ORDER BY c DESC, seen) AS mode FROM c GROUP BY l_suppkey""")
def mode_with_tiebreak(spark, sf):
    c = T.table(spark, sf, "lineitem").groupBy("l_suppkey", "l_quantity").agg(F.count(F.lit(1)).alias("c"), F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seen"))
    return c.groupBy("l_suppkey").agg(F.max_by("l_quantity", F.struct("c", -F.col("seen"), -F.col("l_quantity"))).alias("mode"))


@query(", x AS (SELECT lead, floor(((t % 86400000) / 86400000) * 24)::BIGINT AS bin, count(*) AS n FROM b GROUP BY ALL) SELECT * FROM x")
def phase_fold(spark, sf):
    return T.beats(spark, sf).groupBy("lead", F.floor(F.col("t_ms") % 86_400_000 / 86_400_000 * 24).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 100 BETWEEN 11 AND 14 THEN 'many' WHEN o_orderkey % 10 = 1 THEN 'one' WHEN o_orderkey % 10 BETWEEN 2 AND 4 THEN 'few' ELSE 'many' END AS form,
floor(o_totalprice * 10 + 0.5) / 10 AS rounded, CASE WHEN o_totalprice = 0 THEN 0 ELSE floor(o_totalprice / pow(10.0::DOUBLE, floor(log10(o_totalprice)) - 1) + 0.5) * pow(10.0::DOUBLE, floor(log10(o_totalprice)) - 1) END AS two_digits FROM orders""")
def number_format(spark, sf):
    o = T.table(spark, sf, "orders")
    return o.select("o_orderkey", plural(F.col("o_orderkey"), "one", "few", "many").alias("form"), half_up(F.col("o_totalprice"), 1).alias("rounded"), F.round(significant(F.col("o_totalprice"), 2), 3).alias("two_digits"))


@query("""WITH s AS (SELECT o_custkey AS case_id, count(*) AS n, count(o_totalprice) AS m, (sum(o_totalprice::DECIMAL(18, 2)) * 100)::BIGINT AS cents FROM orders GROUP BY o_custkey),
x AS (SELECT case_id, n, sign(cents) * ((abs(cents) + 5 * m) // (10 * m)) / 10.0::DOUBLE AS rate FROM s)
SELECT case_id, 1 AS line_no, 'Case ' || case_id || ': ' || n || CASE WHEN n % 10 = 1 AND n % 100 <> 11 THEN ' interval.' ELSE ' intervals.' END AS text FROM x
UNION ALL SELECT case_id, 2, 'Mean value ' || coalesce(format('{:,.1f}', rate), '-') || ', ' || CASE WHEN rate > 250000 THEN 'high' ELSE 'usual' END || '.' FROM x""")
def report_lines(spark, sf):
    cents = (F.sum(F.col("o_totalprice").cast("decimal(18,2)")) * 100).cast("long")
    c = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(F.count(F.lit(1)).alias("n_beats"), mean_of_cents(cents, F.count("o_totalprice")).alias("rate"))
    return case.report_lines(c.withColumn("verdict", F.when(F.col("rate") > 250_000, "high").otherwise("usual")))


@query("""SELECT o_custkey AS case_id, string_agg(o_orderpriority || chr(9) || round(o_totalprice, 2)::DECIMAL(18, 2)::VARCHAR, chr(10) ORDER BY o_orderkey) AS tsv FROM orders GROUP BY o_custkey""")
def tsv_rows(spark, sf):
    o = T.table(spark, sf, "orders")
    line = F.concat_ws("\t", "o_orderpriority", F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string"))
    return o.groupBy(F.col("o_custkey").alias("case_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("tsv"))


@query("""SELECT d.doc_id, array_to_string(list_sort(list_distinct(list_filter(['copy:' || CASE WHEN c > 1 THEN 'yes' ELSE '' END, CASE WHEN n_chars < 100 THEN 'too_short' END, CASE WHEN l.toxic = 1 THEN 'flagged' END, CASE WHEN l.doc_id IS NULL THEN 'unverified' END], lambda x: x IS NOT NULL AND x <> 'copy:'))), ',') AS issues
FROM (SELECT *, count(*) OVER (PARTITION BY text) AS c FROM documents) d LEFT JOIN labels l USING (doc_id)""")
def issue_codes(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", "n_chars", F.md5(F.col("text").cast("binary")).alias("digest"))
    many = d.groupBy("digest").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    l = T.table(spark, sf, "labels").select("doc_id", "toxic")
    j = d.join(many, "digest", "left").join(l, "doc_id", "left")
    codes = F.array(F.when(F.col("c") > 1, "copy:yes"), F.when(F.col("n_chars") < 100, "too_short"), F.when(F.col("toxic") == 1, "flagged"), F.when(F.col("toxic").isNull(), "unverified"))
    return j.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.array_compact(codes))), ",").alias("issues"))


@query("""WITH d AS (SELECT source, doc_id, n_chars FROM documents), r AS (SELECT *, doc_id - n_chars / 100.0::DOUBLE AS start FROM d)
SELECT source, round(median(start), 6) AS start_s, round(median(start) + max(n_chars) / 500.0::DOUBLE, 6) AS end_s FROM r GROUP BY source""")
def record_start_median(spark, sf):
    d = T.table(spark, sf, "documents").groupBy("source").agg(F.median(F.col("doc_id") - F.col("n_chars") / 100.0).alias("start"), F.max("n_chars").alias("n"))
    return d.select("source", r6("start", "start_s"), F.round(F.col("start") + F.col("n") / 500.0, 6).alias("end_s"))


@query(""", x AS (SELECT page, lead, t, lag(t) OVER (PARTITION BY page, lead ORDER BY t, beat_id) AS t0, value, lag(value) OVER (PARTITION BY page, lead ORDER BY t, beat_id) AS v0 FROM b)
SELECT page, round(median((value - v0) / (t - t0)) FILTER (value > v0 AND t > t0), 12) AS scale FROM x GROUP BY page""")
def second_scale(spark, sf):
    w = W.partitionBy("page", "lead").orderBy("t_ms", "beat_id")
    b = T.beats(spark, sf).withColumn("dt", F.col("t_ms") - F.lag("t_ms").over(w)).withColumn("dv", F.col("value") - F.lag("value").over(w))
    return b.groupBy("page").agg(F.round(F.median(F.when((F.col("dv") > 0) & (F.col("dt") > 0), F.col("dv") / F.col("dt"))), 12).alias("scale"))


@query("""SELECT user_id AS page, date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def windowed_rates(spark, sf):
    e = T.table(spark, sf, "events").select(F.col("user_id").alias("page"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return rates.windowed(e).select("page", F.col("start").cast("timestamp_ntz").alias("start"), "n", r6("total"))


@query()
def filtfilt_signal(spark, sf):
    """Page-long signals: forty vectors end to end, so a page has 2560 samples whatever the table's size."""
    e = T.table(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / 40).alias("page")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"])).alias("mv"))
    return bridge.filtered(e.select("page", F.lit("II").alias("lead"), F.transform("mv", lambda x: x.cast("double")).alias("mv")), "dog")


def _page_beats(spark, sf):
    """Beats of all pages that events draw."""
    return waves.beats_on_pages(spark, sf)


@query()
def detect_beats(spark, sf):
    """Beats without wave marks, which no column shows."""
    b = waves.beats_on_pages(spark, sf, marks=False)
    return b.select("page", "beat_index", "t_ms", r6("confidence"), "n_leads", F.array_join("reasons", ",").alias("reasons"), "issue")


@query()
def delineate_beats(spark, sf):
    marks = ("p_on", "p_off", "q_on", "r_peak", "s_peak", "s_off", "t_peak", "t_off")
    return _page_beats(spark, sf).select("page", "beat_index", *[F.round(c, 3).alias(c) for c in marks], "p_found", r6("d_confidence"), F.array_join("d_reasons", ",").alias("reasons"), "issue")


@query()
def page_measurements(spark, sf):
    return bridge.measurements(_page_beats(spark, sf))


@query()
def trace_sheets(spark, sf):
    """Drawn sheets of all suppliers read back: samples, confidence and extremes a lead."""
    r = waves.signals_on_sheets(spark, sf)
    return r.select("page", "lead", "variant", F.round("px_per_mm", 3).alias("px_per_mm"), F.size("mv").alias("n"), r6("confidence"), F.round(F.array_max("mv"), 3).alias("top"), F.array_join("issues", ",").alias("issues"), F.round("px_per_second", 2).alias("px_per_second"), "n_marks")


@query()
def sheet_to_measurements(spark, sf):
    """From drawn sheets to beats and measurements: both seams in one plan."""
    return bridge.measurements(waves.beats_on_sheets(spark, sf))


@query("""WITH v AS (SELECT l_suppkey AS sheet, l_returnflag AS variant, sum(CASE l_linestatus WHEN 'F' THEN 1.5 ELSE 1.0 END)::DOUBLE AS w FROM lineitem GROUP BY ALL),
t AS (SELECT *, sum(w) OVER (PARTITION BY sheet) AS total, max(w) OVER (PARTITION BY sheet) AS top FROM v)
SELECT sheet, min(variant) FILTER (w = top) AS variant, round(max(top / total), 6) AS confidence, count(*) FILTER (w = top) > 1 AS ambiguous FROM t GROUP BY sheet""")
def vote_variant(spark, sf):
    weight = F.when(F.col("l_linestatus") == "F", 1.5).otherwise(1.0)
    v = T.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("sheet"), F.col("l_returnflag").alias("variant")).agg(F.sum(weight).alias("w"))
    return case.vote(v).select("sheet", "variant", r6("confidence"), "ambiguous")


@query(SPAN + MERGED.replace("page, kind", "page") + " SELECT page, round(sum(z - a), 3) AS covered_ms, count(*) AS n FROM u GROUP BY page")
def covered_span(spark, sf):
    m = spans.merged(T.spans(spark, sf), ["page"])
    return m.groupBy("page").agg(F.round(F.sum(F.col("end_ms") - F.col("start_ms")), 3).alias("covered_ms"), F.count(F.lit(1)).alias("n"))


@query(SPAN + MERGED.replace("reach < a", "reach < a - 7200000") + " SELECT page, kind, round(a, 3) AS start_ms, round(z, 3) AS end_ms, n FROM u")
def word_sessions(spark, sf):
    m = spans.merged(T.spans(spark, sf), ["page", "kind"], 7_200_000.0)
    return m.select("page", "kind", F.round("start_ms", 3).alias("start_ms"), F.round("end_ms", 3).alias("end_ms"), "n")


@query("""WITH g AS (SELECT source, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY source), p AS (SELECT source FROM g ORDER BY n DESC, first LIMIT 1)
SELECT doc_id AS sheet_id FROM documents WHERE source NOT IN (SELECT source FROM p)""")
def excluded_pages(spark, sf):
    d = T.table(spark, sf, "documents").select(F.col("doc_id").alias("sheet_id"), F.col("source").alias("group"))
    out = case.largest_group(d).filter("NOT primary").select("group")
    return d.join(out, "group", "left_semi").select("sheet_id")


@query("""WITH a AS (SELECT conv_id AS key, turn AS position, length(text) AS auto FROM conversations WHERE role = 'user'),
e AS (SELECT conv_id AS key, turn - 1 AS position, length(text) * 2 AS edit FROM conversations WHERE role = 'assistant' AND turn % 4 = 1)
SELECT key, position, coalesce(edit, auto) AS mark, CASE WHEN edit IS NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM a LEFT JOIN e USING (key, position)""")
def marker_overlay(spark, sf):
    c = T.table(spark, sf, "conversations").select(F.col("conv_id").alias("key"), "turn", "role", F.length("text").cast("long").alias("n"))
    auto = c.filter("role = 'user'").select("key", F.col("turn").alias("position"), F.col("n").alias("mark"), F.lit(0.5).alias("confidence"))
    edits = c.filter("role = 'assistant' AND turn % 4 = 1").select("key", (F.col("turn") - 1).alias("position"), (F.col("n") * 2).alias("value"), F.col("turn").alias("seq"))
    return case.marked(auto, edits)


@query("""WITH RECURSIVE d AS (SELECT doc_id, md5(text) AS a, source || ':' || n_chars AS b FROM documents),
e AS (SELECT x.doc_id AS u, y.doc_id AS v FROM d x JOIN d y ON x.doc_id <> y.doc_id AND (x.a = y.a OR x.b = y.b)),
r(u, v) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT u AS sheet_id, min(v) AS animal FROM r GROUP BY u""")
def animal_groups(spark, sf):
    d = T.table(spark, sf, "documents").select(F.col("doc_id").alias("sheet_id"), F.md5(F.col("text").cast("binary")).alias("a"), F.concat_ws(":", "source", F.col("n_chars").cast("string")).alias("b"))
    return case.animals(d, ["a", "b"])


@query(SIGNAL + """, r AS (SELECT lead, k, v > 0.1 AS clipped FROM e), i AS (SELECT *, k - row_number() OVER (PARTITION BY r.lead, clipped ORDER BY k) AS g FROM r)
SELECT lead, clipped, min(k) AS x0, max(k) AS x1 FROM i GROUP BY lead, clipped, g""")
def trace_segments(spark, sf):
    e = T.signals(spark, sf).select("lead", F.posexplode("mv").alias("k", "v")).select("lead", F.col("k").cast("long").alias("k"), (F.col("v") > 0.1).alias("clipped"))
    i = spans.islands(e, ["lead", "clipped"], "k", 1)
    return i.select("lead", "clipped", F.col("first").alias("x0"), F.col("last").alias("x1"))


@query(""", x AS (SELECT page, beat_id, t, lag(t) OVER w AS before, lead(t) OVER w AS after, t + (value - 50) * 3600000 AS mark FROM b WINDOW w AS (PARTITION BY page ORDER BY t, beat_id))
SELECT page, beat_id FROM x WHERE mark <= coalesce(before, '-infinity'::DOUBLE) OR mark >= coalesce(after, 'infinity'::DOUBLE)""")
def stale_markers(spark, sf):
    b = T.beats(spark, sf).withColumn("mark_ms", F.col("t_ms") + (F.col("value") - 50) * 3_600_000)
    return case.stale(b).select("page", "beat_id")
