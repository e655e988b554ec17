"""Tables of the driver as tables of the domain; readers of sheet images and signal files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions.exprs import fill
from pulseframe.plans import phrases as P


#: Weights of blue, green and red in 256ths; least width of a sheet (px).
LUMA, LEAST_WIDTH = (29, 150, 77), 800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts) -> F.Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1000.0)


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as beats: case_id (four pages a case), page, beat_id, t_ms, lead, value."""
    return table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 4).alias("case_id"), F.col("user_id").alias("page"), F.col("event_id").alias("beat_id"), millis("ts").alias("t_ms"), F.col("event_type").alias("lead"), "value")


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as marked beats of sheets at about 600 ms, with early beats, bursts and pauses: case_id, page, beat_id, i (place in the page), t_ms, t_ii_ms, confidence, reasons,
    ii_confidence, q_on, s_off, p_found, p_on, d_confidence, d_reasons, rho, area_i, area_f. All follow from the ids."""
    from pyspark.sql import Window as W

    w = W.partitionBy("page").orderBy("ts", "beat_id")
    e = table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 4).alias("case_id"), F.col("user_id").alias("page"), F.col("event_id").alias("beat_id"), "ts", "value")
    e = e.withColumn("i", (F.row_number().over(w) - 1).cast("long"))
    k, burst = F.col("beat_id"), (F.col("i") % 40).between(20, 23)
    step = F.when(burst, 300).when(k % 17 == 0, 380).when(k % 31 == 0, 1400).otherwise(600 + (k % 40) * (1 + F.col("case_id") % 3 * 3)).cast("double")
    e = e.withColumn("_step", step).withColumn("t_ms", F.sum("_step").over(w.rowsBetween(W.unboundedPreceding, 0)))
    none = F.lit(None).cast("double")
    q_on = F.when(k % 19 != 0, F.col("t_ms") - 20 - k % 15)
    return e.select(
        "case_id", "page", "beat_id", "i", "t_ms", "value",
        F.when((F.col("page") % 6 <= 4) & (k % 13 != 0), F.col("t_ms") + k % 3).otherwise(none).alias("t_ii_ms"),
        (1 - 1 / (1 + F.col("value"))).alias("confidence"),
        F.array_compact(F.array(F.when(k % 11 == 0, "hr_implausible"), F.when(k % 13 == 0, "lead_ii_unreliable"))).alias("reasons"),
        (1 - F.col("page") % 6 / 10.0).alias("ii_confidence"),
        q_on.alias("q_on"), F.when(k % 19 != 0, F.col("t_ms") + 25 + k % 17).alias("s_off"),
        ((k % 5 != 0) & ~(F.col("i") % 40).between(30, 34)).alias("p_found"),
        F.when((k % 5 != 0) & ~(F.col("i") % 40).between(30, 34), q_on - 60 - k % F.when(F.col("case_id") % 2 == 0, 10).otherwise(50)).alias("p_on"),
        (1 - k % 10 / 20.0).alias("d_confidence"),
        F.array_compact(F.array(F.when(k % 10 == 5, "p_window_too_short"), F.when(k % 23 == 0, "unreliable_segment"))).alias("d_reasons"),
        (1 - k % 7 / 10.0).alias("rho"),
        F.when(k % 29 != 0, (k % 9 - 4) * 10.0).alias("area_i"), F.when(k % 37 != 0, (k % 8 - 3) * 12.0).alias("area_f"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as one-lead signals: page (label), lead (vec_id), mv."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("lead"), F.col("label").alias("page"), F.transform("embedding", lambda x: x.cast("double")).alias("mv"))


def spans(spark: SparkSession, sf_dir: str, scale_ms: float = 60_000.0) -> DataFrame:
    """events as stretches of a page: page, span_id, kind, start_ms, end_ms (as long as `value` minutes)."""
    b = beats(spark, sf_dir)
    return b.select("page", F.col("beat_id").alias("span_id"), F.col("lead").alias("kind"), F.col("t_ms").alias("start_ms"), (F.col("t_ms") + F.col("value") * scale_ms).alias("end_ms"))


def sheet_images(spark: SparkSession, path: str) -> DataFrame:
    """Sheets from JPEG and PNG files: file, width, height, gray (one byte a pixel). A colour file counts by luma (BT.601 in whole numbers), alpha is ignored; files that
    can't be read give null sizes."""
    i = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")

    def gray(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            out = []
            for n, h, w, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                a = np.frombuffer(data or b"", np.uint8)
                if n and n >= 3 and a.size == h * w * n:
                    c = a.reshape(-1, n)[:, :3].astype(np.uint32)  # blue, green, red
                    a = ((c @ np.array(LUMA, np.uint32) + 128) >> 8).astype(np.uint8)
                out.append(a.tobytes() if n and n > 0 else None)
            yield pa.RecordBatch.from_arrays([b.column(4), pa.array([w if w and w > 0 else None for w in b.column(2).to_pylist()], pa.int32()), pa.array([h if h and h > 0 else None for h in b.column(1).to_pylist()], pa.int32()), pa.array(out, pa.binary())], ["file", "width", "height", "gray"])

    return i.select("nChannels", "height", "width", "data", "origin").mapInArrow(gray, "file string, width int, height int, gray binary")


def file_kind(name, mime, head) -> F.Column:
    """pdf by its first bytes, MIME type or name; jpeg and png by their first bytes alone; else unknown."""
    h = F.hex(F.substring(head, 1, 4))
    yes = lambda c: F.coalesce(c, F.lit(False))
    pdf = yes(h == "25504446") | yes(mime == "application/pdf") | yes(F.lower(name).endswith(".pdf"))
    return F.when(pdf, "pdf").when(h.startswith("FFD8FF"), "jpeg").when(h == "89504E47", "png").otherwise("unknown")


def file_problem(kind, decoded, width) -> F.Column:
    """Why a file is no sheet: pdf, not_image, unreadable (nothing was read), corrupt, too_narrow; null for a sheet. decoded: whether the image could be read, null if its bytes could not."""
    return F.when(decoded.isNull(), "unreadable").when(kind == "pdf", "pdf").when(kind == "unknown", "not_image").when(~decoded, "corrupt").when(width < LEAST_WIDTH, "too_narrow")


def problem_message(problem, width) -> F.Column:
    """The problem in words, or null."""
    text = F.create_map(*[F.lit(x) for kv in P.PROBLEMS.items() for x in kv])[problem]
    return fill(text, {"width": width, "least": F.lit(LEAST_WIDTH)})


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path as sheets or their problems, one row a file whatever fails: file, key (length and digest of the bytes), kind, width, height, gray, problem, message.

    Bytes and pixels are read by two sources and meet by name; a file that the image source can't read keeps its row with a problem."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), "content", "length")
    i = sheet_images(spark, path).select("file", "width", "height", "gray")
    b, i = (x.withColumn("file", F.regexp_replace("file", "^([a-z0-9]+):/+", "$1:/")) for x in (b, i))  # the sources write a path with one slash or three
    j = b.join(i, "file", "left").withColumn("kind", file_kind(F.col("file"), F.lit(None).cast("string"), F.col("content")))
    problem = file_problem(F.col("kind"), F.when(F.col("content").isNotNull(), F.col("gray").isNotNull()), F.col("width"))
    key = F.concat_ws(":", F.col("length").cast("string"), F.sha2("content", 256))
    return j.select("file", key.alias("key"), "kind", "width", "height", F.when(problem.isNull(), F.col("gray")).alias("gray"), problem.alias("problem"), problem_message(problem, F.col("width")).alias("message"))


def page_fingerprint(header, labels, rates, date, signals) -> F.Column:
    """One key for pages of equal content: header crop, time labels, printed rates, date and samples."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return F.concat(F.lit("fp:"), F.sha2(F.concat_ws("|", F.base64(header), F.to_json(labels), F.to_json(rates), text(date), F.to_json(signals)), 256))
