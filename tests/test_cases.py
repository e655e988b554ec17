"""Beats with unreliable stretches, marks with reasons, printed rates, the order of sheets, and whole cases from signals to text."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests import synthetic as synth

from pulseframe.kernels import delineate, detect, dsp, printed
from pulseframe.operators import analysis, order

SIX = list(synth.LEADS)


# detector and filter


def test_clipped_stretches_give_no_beats():
    x, truth = synth.six("dog")
    t = truth[3]["r"]
    span = [(round(t / 2) - 40, round(t / 2) + 40, "clipped")]
    everywhere = detect.detect(x, {}, "dog", spans=dict.fromkeys(SIX, span))
    assert [b.t_ms for b in everywhere] == [d["r"] for d in truth if d["r"] != t]
    one = detect.detect(x, {}, "dog", spans={"II": span})
    assert [b.t_ms for b in one] == [d["r"] for d in truth]
    assert "II" not in one[3].leads and "lead_ii_unreliable" in one[3].reasons and all("II" in b.leads for b in one if b.t_ms != t)
    vague = detect.detect(x, {}, "dog", spans={"II": [(i, j, "ambiguous") for i, j, _ in span]})
    assert all("II" in b.leads for b in vague)
    gone = detect.detect(x, {}, "dog", spans=dict.fromkeys(SIX, [(0, 10_000, "gap")]))
    assert gone == []


def test_reasons_of_beats():
    for rr, pair in (([500, 500, 165, 700, 500], (2, 3)), ([500, 500, 2200, 500], (2, 3))):
        x, truth = synth.six("cat" if rr[2] == 165 else "dog", rr_ms=rr, duration_ms=6000)
        beats = detect.detect(x, {}, "cat" if rr[2] == 165 else "dog")
        assert [i for i, b in enumerate(beats) if "hr_implausible" in b.reasons][:2] == list(pair)
    x, truth = synth.six("dog")
    x["II"] = x["II"] * np.where(np.abs(np.arange(2500) * 2 - truth[4]["r"]) < 60, -1, 1)
    odd = detect.detect(x, {}, "dog")
    assert [i for i, b in enumerate(odd) if "morphology_outlier" in b.reasons] == [4]


def test_stages_that_can_not_be_built():
    assert dsp.skipped("cat", 100.0) == ["filter_skipped:lowpass"] and dsp.skipped("dog", 500.0) == [] and dsp.skipped("dog", 0.5) == ["filter_skipped:highpass", "filter_skipped:lowpass"]
    x = np.sin(np.arange(400) / 7) + 3
    assert abs(dsp.clean(x, "cat", 100.0)[0].mean()) < 0.1  # the other stage still works
    spans = [(10, 20, "clipped"), (30, 40, "clipped"), (60, 61, "gap"), (62, 70, "ambiguous"), (395, 399, "gap")]
    assert dsp.widened(spans, 400, "dog", 500.0) == [(0, 53, "clipped"), (47, 74, "gap"), (62, 70, "ambiguous"), (382, 399, "gap")]


# marks


@pytest.mark.parametrize("species", ["dog", "cat"])
def test_marks(species):
    x, truth = synth.six(species, noise=0.004)
    ii = delineate.Lead(dsp.clean(x["II"], species, 500.0)[0])
    at = [t["r"] for t in truth]
    for i in range(1, len(truth) - 1):
        m, t = delineate.delineate(ii, at[i], species, before_ms=at[i - 1], after_ms=at[i + 1]), truth[i]
        assert abs(m["r_peak"] - t["r"]) <= 2 and -16 <= m["q_on"] - t["q_on"] <= 2 and -2 <= m["s_off"] - t["s_off"] <= 16 and abs(m["t_off"] - t["t_off"]) <= 6
        assert m["p_found"] and abs(m["p_on"] - t["p_on"]) <= 6 and abs(m["p_off"] - t["p_off"]) <= 6 and m["q_on"] < m["r_peak"] < m["s_peak"] < m["s_off"] < m["t_peak"] < m["t_off"]
        assert m["confidence"] >= 0.8 and m["reasons"] == []
        span = [(round(t["r"] / 2) - 2, round(t["r"] / 2) + 2, "clipped")]
        hit = delineate.delineate(ii, at[i], species, before_ms=at[i - 1], after_ms=at[i + 1], spans=span)
        assert hit["reasons"] == ["unreliable_segment"] and hit["confidence"] == pytest.approx(0.3)


def test_why_p_is_missing():
    bare, truth = synth.signal("dog", p=0, noise=0.0)
    t = np.arange(len(bare)) * 2.0
    r = truth[3]["r"]
    q_on = truth[3]["q_on"]
    bump = lambda a, ms, size=0.25: bare + size * np.where((t > a) & (t < a + ms), np.sin(np.pi * np.clip((t - a) / ms, 0, 1)), 0)
    why = lambda x, **k: delineate.delineate(x, r, "dog", **k)["reasons"]
    assert why(bump(q_on - 100, 40)) == []
    assert why(bare) == ["p_not_found", "p_low_amplitude"]
    assert why(bump(q_on - 100, 40), before_ms=q_on - 100) == ["p_not_found", "p_window_too_short"]
    assert why(bump(q_on - 150, 130)) == ["p_not_found", "p_duration_out_of_range"]
    assert why(bump(q_on - 180, 40, 0.5)) == ["p_not_found", "p_lobe_outside_window"]
    short = delineate.delineate(bare, r, "dog", after_ms=r + 150)
    assert "t_window_truncated" in short["reasons"] or "t_not_found" in short["reasons"]
    none = delineate.delineate(bare, 50_000, "dog")
    assert none["reasons"] == ["no_signal"] and none["confidence"] == 0 and all(none[k] is None for k in delineate.MARKS) and not none["p_found"]
    assert delineate.delineate(np.zeros(0), 100, "cat")["reasons"] == ["no_signal"] and delineate.delineate(np.zeros(2000), 1000, "cat")["reasons"] == ["qrs_not_found"]


def test_printed_rates():
    px = 4.305 * 50 / 1000
    beats = lambda: [detect.Beat(float(t), 1.0, {}) for t in (500, 1000, 1500, 2300, 2800)]
    at = lambda a, b: 60 + (a + b) / 2 * px
    b = beats()
    assert printed.check(b, [(at(500, 1000), 120), (at(1000, 1500) + 3, 122), (at(1500, 2300), 110), (at(2300, 2800) + 40, 120)], 60, px) == ([(2, 110, 75.0)], [3])
    assert [x.reasons for x in b] == [[], [], ["printed_hr_mismatch"], ["printed_hr_mismatch"], ["printed_hr_unverified"]]
    assert [round(x.confidence, 3) for x in b] == [1, 1, 0.7, 0.7, 0.9]
    b = beats()
    assert printed.check(b, [], 60, px) == ([], []) and all(not x.reasons for x in b)
    assert printed.check(beats()[:1], [(100, 120)], 60, px) == ([], [0]) and printed.check([], [(100, 120)], 60, px) == ([], [0]) and printed.check(beats(), [(100, 120)], 60, 0.0) == ([], [0])


# order


SHEET = "case_id long, page long, upload int, digest string, date string, width int, crop binary, labels array<struct<x:double,seconds:double>>, left_px double, plot_px double, px_per_second double, px_per_mm double, mm_per_s double, n_samples int"


def sheet_rows(items, case=1):
    """items: digest, date, crop (boolean array or None), start (or None); five seconds each."""
    px = 4.305 * 50
    labels = lambda start: None if start is None else [(60 + k * px, start + k) for k in range(4)]
    raw = lambda c: None if c is None else bytearray(np.where(c, 0, 255).astype(np.uint8).tobytes())
    return [(case, 100 * case + i, i, d, date, 20, raw(crop), labels(s), 60.0, 1000.0, None, 4.305, 50.0, 2500) for i, (d, date, crop, s) in enumerate(items)]


def test_sheets_of_a_case(spark):
    rng = np.random.default_rng(6)
    a, b = ((rng.random((8, 20)) < 0.4) for _ in range(2))
    near = np.roll(a, 1, 1)
    one = [("x", "1.1", a, 10.0), ("y", "1.1", near, 4.9), ("x", "1.1", a, 10.0), ("z", "2.1", b, 0.0), (None, "2.1", None, 5.2), ("w", "1.1", a, 11.0), (None, "9.9", None, None), (None, "1.1", a, 15.2)]
    two = [("p", "1.1", a, None), ("q", "1.1", a, 3.0)]
    three = [(None, "1.1", None, 1.0), (None, None, None, 9.0), (None, "2.2", None, 20.0), (None, "1.1", None, 30.0)]  # none can be compared
    four = [("m", "1.1", a, 0.0), ("n", "2.2", a, 5.0), (None, "2.2", None, 10.0)]  # one animal on two days
    five = [("g", "1.1", a, 0.0), ("h", None, near, 5.0), (None, "7.7", None, 10.0)]
    s = order.with_spans(spark.createDataFrame([r for i, x in enumerate((one, two, three, four, five)) for r in sheet_rows(x, i + 1)], SHEET))
    rows = order.ordered(s).collect()
    got = {r.page: r for r in rows}
    groups = lambda case: sorted([r.group_no, r.place, r.page % 100] for r in rows if r.case_id == case and r.page == r.original)
    assert got[102].original == 100 and groups(1) == [[0, 0, 1], [0, 1, 0], [0, 2, 5], [0, 3, 7], [1, 0, 3], [1, 1, 4], [2, 0, 6]]
    assert {p: r.repeats for p, r in got.items() if r.repeats is not None} == {105: 100} and {p for p, r in got.items() if r.case_id == 1 and not r.primary} == {103, 104, 106}
    assert got[100].issues == ["multiple_animals", "duplicate:102", "overlap:105", "animal_unverified:104", "animal_unverified:106"]
    assert groups(5) == [[0, 0, 0], [0, 1, 1], [0, 2, 2]]  # an unread date fits any, and an unread header goes to the sheet before
    assert got[200].issues == ["order_unknown"] and groups(2) == [[0, 0, 0], [0, 1, 1]]
    assert groups(3) == [[0, 0, 0], [0, 1, 1], [0, 2, 2], [0, 3, 3]]
    assert groups(4) == [[0, 0, 0], [1, 0, 1], [1, 1, 2]] and got[401].primary and not got[400].primary
    assert order.ordered(s.limit(0)).count() == 0


def test_times_of_sheets(spark):
    px = 4.305 * 50
    rows = sheet_rows([("a", "d", None, 2.0)])
    base = list(rows[0])
    cases = {
        "labels": base, "misread": [*base[:7], [(60.0, 2.0), (60 + px, 3.0), (60 + 2 * px, 9.0)], *base[8:]], "marks": [*base[:7], [(60 + 100.0, 3.0)], 60.0, 1000.0, 100.0, 4.305, 50.0, 0], "grid": [*base[:7], [(60 + px, 3.0)], *base[8:]],
        "none": [*base[:7], None, *base[8:]], "no scale": [*base[:7], [(60.0, 1.0)], 60.0, 1000.0, None, 0.0, 50.0, 0],
    }
    got = {r.digest: (r.start_s, r.end_s, r.duration_s) for r in order.with_spans(spark.createDataFrame([(*v[:3], k, *v[4:]) for k, v in cases.items()], SHEET)).collect()}
    assert got["labels"] == pytest.approx((2.0, 7.0, 5.0)) and got["grid"] == pytest.approx((2.0, 7.0, 5.0)) and got["marks"] == pytest.approx((2.0, 12.0, 10.0))
    assert got["misread"][0] == pytest.approx(2.0) and got["none"] == (None, None, 5.0) and got["no scale"] == (None, None, 0.0)


def test_places_in_time(spark):
    rng = np.random.default_rng(1)
    a, b = ((rng.random((8, 20)) < 0.4) for _ in range(2))
    gap = [("x", "d", a, 6.5), ("y", "d", a, 0.0), ("z", "e", b, 0.0)]  # the later first, a gap of a second and a half, another animal
    blind = [("p", "d", a, None), ("q", "d", a, 3.0)]
    s = order.with_spans(spark.createDataFrame(sheet_rows(gap) + sheet_rows(blind, 2) + sheet_rows(gap, 3), SHEET))
    o = order.ordered(s)
    got = {r.page: (r.page_no, r.offset_ms, r.covered_ms) for r in order.offsets(s, o, spark.createDataFrame([(3,)], "case_id long")).collect()}
    near = lambda *x: pytest.approx(x)
    assert set(got) == {101, 100, 200, 201, 300, 301, 302}
    assert got[101] == near(0, 0.0, 11_500.0) and got[100] == near(1, 6500.0, 11_500.0)
    assert got[200] == near(0, 0.0, 10_000.0) and got[201] == near(1, 5000.0, 10_000.0)
    assert got[301] == near(0, 0.0, 16_500.0) and got[300] == near(1, 6500.0, 16_500.0) and got[302] == near(2, 11_500.0, 16_500.0)


# whole cases


VE = {"p": 0.0, "q": 0.0, "r": 1.3, "s": 0.6, "t": -0.5, "qrs_ms": 110, "qt_ms": 280, "t_ms": 110}
VE_SCALES = {"I": -0.7, "II": 1.0, "III": 1.0, "aVR": 0.5, "aVL": -0.3, "aVF": -0.6}


def with_wide(base, onsets, duration=5000):
    for on in onsets:
        y = synth.signal("dog", rr_ms=[10**6], duration_ms=duration, first_ms=on, noise=0.0, **VE)[0]
        y = dsp.zero_phase(y, dsp.butterworth(35.0, 500.0, 2, False))[0].astype(float)
        base = {k: v + VE_SCALES[k] * y for k, v in base.items()}
    return base


EARLY = {"first_ms": 300, "rr_ms": [500, 500, 500, 320, 680, 500, 500, 500]}
BREATH = {"first_ms": 300, "duration_ms": 6000, "rr_ms": [460, 520, 580, 620, 580, 520, 460, 440, 480, 540]}
PAUSE = {"first_ms": 300, "duration_ms": 6000, "rr_ms": [500, 500, 500, 1100, 500, 500, 500, 500]}
#: name: species, signals, confidences that differ
SCENES = {
    "down-left": ("dog", synth.six("dog", noise=0.0)[0], {}),
    "right": ("dog", synth.six("dog", {"I": -0.5, "aVF": 0.85}, noise=0.0)[0], {}),
    "left-up": ("dog", synth.six("dog", {"I": 0.7, "aVF": -0.4}, noise=0.0)[0], {}),
    "I weak": ("dog", synth.six("dog")[0], {"I": 0.3}),
    "dog": ("dog", synth.six("dog")[0], {}),
    "cat": ("cat", synth.six("cat")[0], {}),
    "no P": ("dog", synth.six("dog", p=0.0)[0], {}),
    "breath dog": ("dog", synth.six("dog", **BREATH)[0], {}),
    "breath cat": ("cat", synth.six("cat", **BREATH)[0], {}),
    "early": ("dog", synth.six("dog", **EARLY)[0], {}),
    "early, II weak": ("dog", synth.six("dog", **EARLY)[0], {"II": 0.3}),
    "wide": ("dog", with_wide(synth.six("dog", first_ms=300, rr_ms=[500, 500, 500, 1000, 500, 500, 500])[0], [2110]), {}),
    "run": ("dog", with_wide(synth.six("dog", first_ms=300, rr_ms=[500, 500, 500, 2000, 500, 500])[0], [2100, 2400, 2700, 3000]), {}),
    "pause dog": ("dog", synth.six("dog", **PAUSE)[0], {}),
    "pause cat": ("cat", synth.six("cat", **PAUSE)[0], {}),
    "flat": ("dog", {k: np.zeros(2500) for k in SIX}, {}),
}


@pytest.fixture(scope="module")
def scenes(spark):
    names = list(SCENES)
    rows, leads = [], []
    for i, (species, x, trust) in enumerate(SCENES.values()):
        rows += [(*r, None, 1000 / (4.305 * 10 * 1000), 1000 / (4.305 * 50), 0.9) for r in sheet_rows([(f"d{i}", "day", np.ones((4, 20), bool), 0.0)], i + 1)]
        leads += [(100 * (i + 1), k, j, trust.get(k, 1.0), v.tolist(), []) for j, (k, v) in enumerate(x.items())]
    extra = len(names) + 1  # a case of two sheets in reverse order, one that fails, one without sheets
    two, _ = synth.six("dog", seed=5)
    rows += [(*r, [(60 + 680 * 4.305 * 50 / 1000, 60.0)] if j else None, 1 / 43.05, 1000 / (4.305 * 50), 0.7) for j, r in enumerate(sheet_rows([("s", "day", np.ones((4, 20), bool), 5.0), ("t", "day", np.ones((4, 20), bool), 0.0)], extra))]
    leads += [(100 * extra + j, k, i, 1.0, v.tolist(), []) for j in (0, 1) for i, (k, v) in enumerate(two.items())]
    sheets = spark.createDataFrame(rows, SHEET + ", rates array<struct<x:double,value:double>>, mv_per_px double, ms_per_px double, confidence double")
    signals = spark.createDataFrame(leads, "page long, lead string, position int, confidence double, mv array<double>, bad array<struct<i0:int,i1:int,kind:string>>")
    settings = [(i + 1, s[0], "large", None, None, False) for i, s in enumerate(SCENES.values())] + [(extra, "dog", "large", "atenolol", 3.0, False), (extra + 1, "cat", None, None, None, False)]
    c = analysis.analyze(sheets, signals, spark.createDataFrame(settings, "case_id long, species string, size string, drugs string, minutes double, together boolean"))
    name = {i + 1: n for i, n in enumerate(names)} | {extra: "two", extra + 1: "nothing"}
    table = lambda df: [r.asDict() | {"name": name[r.case_id]} for r in df.collect()]
    return {"report": {r["name"]: r for r in table(c.report)}, "ectopics": table(c.ectopics), "episodes": table(c.episodes), "pauses": table(c.pauses), "measured": {(r["name"], r["key"]): r for r in table(c.measured)}, "rates": {r["name"]: r for r in table(c.rates)}, "beats": table(c.beats)}


def test_axes(scenes):
    for name, i, f in (("down-left", 0.6, 0.85), ("right", -0.5, 0.85), ("left-up", 0.7, -0.4)):
        x, truth = SCENES[name][1], synth.six("dog", noise=0.0)[1][1]
        area = lambda k: x[k][round(truth["q_on"] / 2) : round(truth["s_off"] / 2) + 1].sum()  # noqa: E731, B023
        want = np.degrees(np.arctan2(area("aVF"), area("I")))
        assert abs((scenes["report"][name]["axis"] - want + 540) % 360 - 180) <= 5, name
    r = scenes["report"]["I weak"]
    assert r["axis"] is None and "axis_leads_unreliable" in r["reasons"] and r["type"] == "sinus" and r["n_ectopics"] == r["n_episodes"] == 0


def test_types_of_rhythm(scenes):
    for name in ("dog", "cat"):
        r = scenes["report"][name]
        assert (r["type"], r["reasons"], r["sinus_arrhythmia"], r["n_ectopics"], r["n_episodes"]) == ("sinus", [], False, 0, 0)
    r = scenes["report"]["no P"]
    assert r["type"] == "non_sinus" and "p_not_found" in r["reasons"] and not r["sinus_arrhythmia"]
    assert [(e["kind"], e["n"] >= 3) for e in scenes["episodes"] if e["name"] == "no P"] == [("no_p", True)]
    for name in ("breath dog", "breath cat"):
        r = scenes["report"][name]
        assert r["type"] == "sinus" and r["sinus_arrhythmia"] and r["n_ectopics"] == 0, name


def test_ectopic_beats(scenes):
    of = lambda kind, name: [e for e in scenes[kind] if e["name"] == name]
    (e,) = of("ectopics", "early")
    assert (e["kind"], e["focus"]) == ("SVE", "atrial") and abs(e["coupling_ms"] - 320) <= 10 and not of("episodes", "early") and scenes["report"]["early"]["type"] == "sinus"
    (e,) = of("ectopics", "early, II weak")
    r = scenes["report"]["early, II weak"]
    assert e["kind"] == "SVE" and abs(e["coupling_ms"] - 320) <= 10 and r["type"] == "undetermined" and "lead_ii_unreliable" in r["reasons"] and r["axis"] is not None
    assert scenes["rates"]["early, II weak"]["source"] == "all_leads" and scenes["rates"]["early"]["source"] == "lead_ii"
    assert {scenes["measured"]["early, II weak", k]["reason"] for k in ("pq", "qrs", "r", "t")} == {"lead_ii_unreliable"}
    (e,) = of("ectopics", "wide")
    assert (e["kind"], e["focus"]) == ("VE", "left_ventricle") and abs(e["coupling_ms"] - 337) <= 12 and not of("episodes", "wide")
    assert [e["kind"] for e in of("ectopics", "run")] == ["VE"] * 4
    (e,) = of("episodes", "run")
    assert (e["kind"], e["n"], e["focus"]) == ("ve_run", 4, "left_ventricle") and abs(e["start_ms"] - 2155) <= 12 and abs(e["duration_ms"] - 1200) <= 60
    for name in ("pause dog", "pause cat"):
        (p,) = of("pauses", name)
        assert abs(p["duration_ms"] - 1100) <= 10 and not scenes["report"][name]["sinus_arrhythmia"] and not of("ectopics", name)


@pytest.mark.parametrize("species", ["dog", "cat"])
def test_measured_values(scenes, species):
    x, truth = SCENES[species][1], synth.six(species)[1]
    m, t = {k: scenes["measured"][species, k] for k in ("pDuration", "pq", "qrs", "qt", "qtc", "r", "s", "t", "pAmplitude")}, truth[2]
    ms = lambda k: m[k]["value"] * 1000
    assert abs(ms("qrs") - (t["s_off"] - t["q_on"])) <= 4 and abs(ms("pq") - (t["q_on"] - t["p_on"])) <= 4 and abs(ms("qt") - (t["t_off"] - t["q_on"])) <= 6 and abs(ms("pDuration") - (t["p_off"] - t["p_on"])) <= 5
    top = x["II"][round(t["q_on"] / 2) : round(t["s_off"] / 2)].max()
    assert abs(m["r"]["value"] - top) <= 0.02 and m["s"]["value"] < 0 and all(m[k]["confidence"] >= 0.8 for k in ("qrs", "r", "pq"))
    assert (m["qtc"]["value"] is None and m["qtc"]["reason"] == "species_not_applicable") if species == "cat" else abs(m["qtc"]["value"] - (m["qt"]["value"] + 0.087 * 0.5)) <= 0.003
    assert scenes["rates"][species]["hr_mean"] == pytest.approx(synth.SHAPES[species]["bpm"], abs=1)


def test_texts(scenes):
    r = scenes["report"]["two"]
    assert r["n_pages"] == 2 and r["covered_ms"] == pytest.approx(10_000) and r["confidence"] == pytest.approx(0.7) and "Recorded: 2 sheets, 10 s of 3 min watched." in r["text"] and "Drugs: atenolol." in r["text"]
    one = sum(b["name"] == "dog" for b in scenes["beats"])
    mine = sorted((b["global_index"], b["at_ms"], b["page"] % 100) for b in scenes["beats"] if b["name"] == "two")
    assert len(mine) == 2 * one and [p for _, _, p in mine] == [1] * one + [0] * one and [i for i, _, _ in mine] == list(range(2 * one)) and mine == sorted(mine, key=lambda x: x[1])
    assert {x for b in scenes["beats"] if b["name"] == "two" and b["page"] % 100 == 1 for x in b["reasons"]} == {"printed_hr_mismatch", "printed_hr_unverified"}
    for name, reason in (("flat", "no_beats"), ("nothing", "no_pages")):
        r = scenes["report"][name]
        assert r["type"] == "undetermined" and r["reasons"] == ["no_beats"] and r["n_beats"] == 0 and r["text"].startswith("No analysis: ") and scenes["measured"][name, "r"]["reason"] == reason, name
    text = scenes["report"]["run"]["text"]
    assert "Ectopic beats: 4 ventricular beats (left ventricle" in text and "Episodes (1): ventricular run" in text and text.endswith("To be confirmed by a specialist.")


def test_no_cases(spark):
    none = analysis.analyze(
        spark.createDataFrame([], SHEET + ", rates array<struct<x:double,value:double>>, mv_per_px double, ms_per_px double, confidence double"),
        spark.createDataFrame([], "page long, lead string, position int, confidence double, mv array<double>, bad array<struct<i0:int,i1:int,kind:string>>"),
        spark.createDataFrame([], "case_id long, species string, size string, drugs string, minutes double, together boolean"),
    )
    assert none.report.count() == 0 and none.beats.withColumn("x", F.lit(1)).count() == 0
