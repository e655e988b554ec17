"""Whole conclusions from small cases, written out; documents made from the tables."""

from pulseframe.operators import conclusion, views

MEASURED = "case_id long, species string, size string, key string, value double, unit string, confidence double, reason string"


def test_conclusion(spark):
    rows = [
        (1, "dog", "large", "pDuration", 0.04, "s", 0.9, None), (1, "dog", "large", "q", -0.6, "mV", 0.9, None), (1, "dog", "large", "r", 3.6, "mV", 0.9, None), (1, "dog", "large", "t", -1.05, "mV", 0.9, None),
        (1, "dog", "large", "st", 0.05, "mV", 0.2, None), (1, "dog", "large", "qt", None, "s", 0.0, "t_not_found"), (1, "dog", "large", "qtc", 0.2, "s", 0.9, None),
        (2, "cat", None, "r", None, "mV", 0.0, "no_beats"), (2, "cat", None, "qtc", 0.2, "s", 0.9, None),
    ]
    table = conclusion.parameter_rows(spark.createDataFrame(rows, MEASURED), spark)
    got = {(r.case_id, r.key): (r.value, r.norm, r.verdict, r.note) for r in table.collect()}
    assert got[1, "q"] == ("−0.6 mV", "absolute ≤ 0.5 mV", "border", "") and got[1, "t"] == ("−1.05 mV", "≤ 25 % of R and absolute ≤ 1 mV", "abnormal", "29 % of R")
    assert got[1, "r"] == ("3.6 mV", "≤ 3 mV", "abnormal", "") and got[1, "st"] == ("unreliable", "−0.1…+0.1 mV", "n/a", "confidence 0.2") and got[1, "qt"][3] == "no T wave found"
    assert got[1, "qtc"] == ("0.2 s", "no range", "n/a", "") and (2, "qtc") not in got
    case = "case_id long, species string, size string, hr_mean double, hr_min double, hr_max double, c_mean double, c_min double, c_max double, reason string"
    rates = conclusion.rate_rows(spark.createDataFrame([(1, "dog", "large", 171.6, 90.0, 201.2, 0.9, 0.9, 0.9, None), (2, "cat", None, None, None, None, 0.0, 0.0, 0.0, "no_beats")], case), spark)
    axes = conclusion.axis_rows(spark.createDataFrame([(1, "dog", "large", 65.4), (2, "cat", None, None)], "case_id long, species string, size string, axis double"), spark)
    found = conclusion.ectopic_items(spark.createDataFrame([(1, 9, "VE", "left_ventricle", 300.0), (1, 4, "SVE", "atrial", 280.0), (1, 5, "SVE", "junctional", 320.0), (1, 6, "SVE", "atrial", 300.0)], "case_id long, beat long, kind string, focus string, coupling_ms double"))
    runs = conclusion.episode_items(spark.createDataFrame([(1, 2500.0, 1230.0, 3, "sve_run", "atrial", 280.0)], "case_id long, start_ms double, duration_ms double, n long, kind string, focus string, coupling_ms double"))
    kind = """case_id long, species string, type string, reasons array<string>, sinus_arrhythmia boolean, pauses array<struct<start_ms:double,duration_ms:double>>, n_beats int, n_leads int, n_reliable int, n_pages int, seconds double, minutes double,
        drugs string, flags array<string>, mv_per_px double, ms_per_px double, first_reason string"""
    cases = spark.createDataFrame(
        [(1, "dog", "non_sinus", ["p_not_all:14/18", "odd"], True, [(4000.0, 1290.0)], 20, 6, 5, 2, 10.5, 3.25, " atenolol ", ["manual_correction"], 0.02323, 4.646, None), (2, "cat", "undetermined", ["no_beats"], False, [], 0, 6, 0, 1, 5.0, None, None, [], None, None, "no_beats")], kind
    )
    text = {r.case_id: r.text.split("\n") for r in conclusion.compose(cases, table, rates, axes, found, runs).collect()}
    assert text[1] == [
        "Rhythm other than sinus (P before 14 of 18 beats). Rate 172 bpm (90 to 201), range 70–160 bpm, borderline.",
        "Pause of 1290 ms at 4 s, to be looked at.",
        "Axis +65°, within +40…+100°.",
        "Outside the range: R amplitude 3.6 mV, above (range ≤ 3 mV); T amplitude −1.05 mV (29 % of R), deep negative T (range ≤ 25 % of R and absolute ≤ 1 mV).",
        "Borderline: Q amplitude −0.6 mV, deep Q (range absolute ≤ 0.5 mV).",
        "Ectopic beats: 3 supraventricular beats (2 atria, 1 junction; coupling 280 to 320 ms, mean 300); 1 ventricular beat (left ventricle; coupling 300 ms).",
        "Episodes (1): supraventricular run at 2.5 s for 1.23 s, 3 beats, atria, coupling 280 ms.",
        "Not reliable: QT interval, ST segment.",
        "Drugs: atenolol.",
        "Recorded: 2 sheets, 10.5 s of 3.25 min watched.",
        "Note: marks were corrected by hand.",
        "One pixel is 0.023 mV and 4.6 ms; two are 0.046 mV and 9.2 ms.",
        "To be confirmed by a specialist.",
    ]
    assert text[2] == ["No analysis: no beats found.", "No drugs named.", "Recorded: 1 sheet, 5 s.", "Precision unknown.", "To be confirmed by a specialist."]


def test_rows_and_documents(spark):
    F = views.F
    kind = "kind string, reasons array<string>, arrhythmia boolean, pauses array<struct<start_ms:double,duration_ms:double>>, species string"
    data = [("sinus", [], True, [], "cat"), ("sinus", [], True, [(1000.0, 900.0)], "dog"), ("non_sinus", ["pq_unstable", "odd"], False, [], "dog"), ("undetermined", ["no_beats"], False, [], "dog")]
    rows = spark.createDataFrame(data, kind).coalesce(1).select(views.rhythm_row(*(F.col(c) for c in ("kind", "reasons", "arrhythmia", "pauses", "species"))).alias("r")).collect()
    assert [(x.r.tone, x.r.note) for x in rows] == [("abnormal", "sinus arrhythmia (unusual)"), ("border", "pause 900 ms at 1 s"), ("abnormal", "PQ varies"), ("unreliable", "no beats found")]
    s = spark.createDataFrame([(0, False, 0), (2, False, 1), (2, False, 0), (2, True, 0)], "n int, done boolean, waiting int").coalesce(1)
    assert [r.s for r in s.select(views.status(F.col("n"), F.col("done"), F.col("waiting")).alias("s")).collect()] == ["empty", "pending", "failed", "ready"]
    lines = conclusion.norms_document(spark).split("\n")
    assert lines[0] == "| parameter | dog-small | dog-large | cat |" and "| Heart rate |" not in lines[2] and any("70–180; borderline from 60" in x for x in lines)
    assert "## REASONS" in conclusion.phrases_document()
