"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm.common import documents, tokenizer
from pulseframe.llm.exact import exact_dedup
from pulseframe.llm import centroids, langid, licenses, lmscore, periodic, substrings, toxicity
from pulseframe.llm.fingerprints import fingerprint_with_next
from pulseframe.llm.mixing import mix
from pulseframe.llm.njoin import near_groups
from pulseframe.llm.packing import pack
from pulseframe.llm.pii import digest, find_pii


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_pii(documents(spark, sf_dir).select("doc_id", "text")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir).select("doc_id", "text"), tokenizer("word_bpe_49k.json"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir).select("doc_id", "source", "text"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir).select("doc_id", "text"), words=3, percent=90, count=True)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    places = F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", "held_out", "score", "predicted", places.alias("offending"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(documents(spark, sf_dir).select("doc_id", "text"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(documents(spark, sf_dir).select("doc_id", "text"), lmscore.good(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(documents(spark, sf_dir).select("doc_id", "text"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan_licenses(documents(spark, sf_dir).select("doc_id", "text")))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.periodic_runs(periodic.with_cycles(documents(spark, sf_dir))))


def lloyd_sql(clusters: int = centroids.CLUSTERS, rounds: int = centroids.ROUNDS) -> str:
    """Lloyd's rounds, each two common table expressions: aN assigns to the centroids cN, of which the next are made."""
    sql = f"""
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM e QUALIFY c < {clusters})"""
    for i in range(rounds + 1):
        sql += f""",
        a{i} AS (SELECT e.vec_id, e.v, min((list_sum(list_transform(list_zip(e.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, c)) AS best FROM e, c{i} GROUP BY e.vec_id, e.v)"""
        if i < rounds:
            sql += f""",
        s{i} AS (SELECT c, d, floor_div(sum(x), count(*)) AS m FROM (SELECT best[2] AS c, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM a{i}) GROUP BY c, d),
        c{i + 1} AS (SELECT c{i}.c, coalesce(n.v, c{i}.v) AS v FROM c{i} LEFT JOIN (SELECT c, list(m ORDER BY d) AS v FROM s{i} GROUP BY c) AS n USING (c))"""
    last = f"a{rounds}"
    sql += f"""
        SELECT vec_id, best[2]::INTEGER AS cluster, best[1] AS distance, sum(best[1]) OVER (PARTITION BY best[2])::BIGINT AS cluster_inertia, sum(best[1]) OVER ()::BIGINT AS inertia,
               sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
        FROM {last} JOIN c{rounds} ON c = best[2]"""
    # sums fit 64 bits here; the floor of a quotient, also below zero
    return sql.replace("floor_div(sum(x), count(*))", "((sum(x)::BIGINT - ((sum(x)::BIGINT % count(*)) + count(*)) % count(*)) // count(*))")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_language_id": op2_language_id,
    "op3_pii": op3_pii,
    "op4_lm_scores": op4_lm_scores,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_fingerprints": op8_fingerprints,
    "op9_packing": op9_packing,
    "op10_mixing": op10_mixing,
    "op11_license_scan": op11_license_scan,
    "op12_centroids": op12_centroids,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL: dict[str, str] = {
    "op6_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        g AS (
            SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
            FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op10_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, 1 + len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens,
                   md5(concat_ws('|', coalesce(doc_id::VARCHAR, '-'), coalesce(source, '-'), sha256(coalesce(text, '')))) AS row_id
            FROM documents),
        s AS (SELECT source, sum(tokens)::BIGINT AS n FROM d GROUP BY source),
        t AS (SELECT sum(n)::DOUBLE AS total, count(*) AS k FROM s),
        p AS (SELECT g.k, n, ln(n / total) * (g.k / 65536.0::DOUBLE) AS lp, total FROM s, t, generate_series(0, 65536) AS g(k)),
        e AS (SELECT k, sum(exp(lp)) AS z, ln(sum(exp(lp))) - sum(exp(lp) * lp) / sum(exp(lp)) AS h,
                     max(exp(lp) / n) / sum(exp(lp)) * any_value(total) AS r FROM p GROUP BY k),
        k0 AS (SELECT coalesce(max(e.k), 0) AS k FROM e, t WHERE h >= 0.9 * ln(t.k) - 1e-12),
        k1 AS (SELECT CASE WHEN (SELECT r FROM e WHERE e.k = k0.k) <= 4 + 1e-9 THEN k0.k
                      ELSE coalesce((SELECT min(e.k) FROM e WHERE e.k > k0.k AND r <= 4 + 1e-9), 65536) END AS k FROM k0),
        w AS (SELECT source, n, least(round(exp(ln(n / total) * (k1.k / 65536.0::DOUBLE)) / z * total)::BIGINT, 4 * n) AS quota
              FROM s, t, k1, e WHERE e.k = k1.k),
        u AS (SELECT d.*, n, quota, unnest(generate_series(0, (quota - 1) // n)) AS pass
              FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source WHERE quota > 0),
        o AS (SELECT *, md5('mix|' || pass || '|' || row_id) AS key FROM u),
        a AS (SELECT *, pass * n + coalesce(sum(tokens) OVER (PARTITION BY source, pass ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM o),
        b AS (SELECT *, least(floor(place::DOUBLE / quota * nb), nb - 1)::BIGINT AS block
              FROM a, (SELECT greatest(1, ceil(total / 65536)) AS nb FROM t) WHERE place < quota)
        SELECT doc_id, source, pass, tokens, block,
               row_number() OVER (PARTITION BY block ORDER BY md5(key || '|' || block), key) - 1 AS block_pos
        FROM b""",
    "op12_centroids": lloyd_sql(),
}
