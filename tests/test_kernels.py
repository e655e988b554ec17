import numpy as np
import pytest

from pulseframe.kernels import bridge, delineate, detect, dsp, glyphs, layout, sheet
from pulseframe.operators import norms, rhythm
from pulseframe.sources import waves
from tests import synthetic as synth

#: Mean rate, premature beats and pauses that follow from printed rates.
ROWS = {
    "even": ([120.0] * 8, [], []),
    "early": ([120, 120, 120, 187.5, 88.2, 120, 120], [3], []),
    "pause": ([120, 120, 120, 55, 120, 120], [], [3]),
}


def test_blocks_filter_like_single_samples():
    x = np.random.default_rng(1).normal(size=(3, 700))
    for s in dsp.butterworth(5, 500, 4, True) + dsp.butterworth(40, 500, 4, False):
        b0, b1, b2, a1, a2 = s
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        want = np.empty_like(x)
        for r, row in enumerate(x):
            past, before = [row[0]] * 2, [gain * row[0]] * 2  # steady at the first sample
            for i, v in enumerate(row):
                y = b0 * v + b1 * past[0] + b2 * past[1] - a1 * before[0] - a2 * before[1]
                past, before, want[r, i] = [v, past[0]], [y, before[0]], y
        assert np.allclose(dsp._forward(x, s), want)


def test_filter_keeps_the_band_and_drops_drift():
    t = np.arange(2600) / 500
    drift, wave = 0.5 * np.sin(2 * np.pi * 0.1 * t), np.sin(2 * np.pi * 8 * t)
    y = dsp.clean(wave + drift, "dog", 500.0)[0]
    assert np.abs(y - wave)[800:-800].max() < 0.05  # the ends carry the transients of a 0.5 Hz cut
    assert dsp.butterworth(300, 500, 4, True) == []
    with pytest.raises(ValueError):
        dsp.butterworth(10, 500, 3, True)
    assert dsp.clean(np.ones(1), "cat", 500.0).shape == (1, 1)


@pytest.mark.parametrize("species", ["dog", "cat"])
@pytest.mark.parametrize("rr", [None, [500, 500, 500, 330, 660], [460, 540, 620, 540]])
def test_detector(species, rr):
    ii, truth = synth.signal(species, rr_ms=rr)
    beats = detect.detect(synth.leads(ii), {}, species)
    assert [abs(b.t_ms - t["r"]) <= 4 for b, t in zip(beats, truth, strict=True)] == [True] * len(truth)
    assert detect.detect({}, {}, species) == [] and detect.detect({"II": np.zeros(2000)}, {}, species) == []


@pytest.mark.parametrize("species", ["dog", "cat"])
def test_delineation(species):
    ii, truth = synth.signal(species)
    y = dsp.clean(ii, species, 500.0)[0].astype(float)
    for t in truth[1:-1]:
        m = delineate.delineate(y, t["r"], species)
        assert all(m[k] is not None and abs(m[k] - t[k]) <= 14 for k in ("p_on", "p_off", "q_on", "s_off", "t_off")), (m, t)
    flat, truth = synth.signal(species, p=0)
    assert "p_not_found" in delineate.delineate(dsp.clean(flat, species, 500.0)[0].astype(float), truth[2]["r"], species)["reasons"]


def pages(spark, n):
    rows = [{"page": i, "lead": k, "position": j, "species": ("dog", "cat")[i % 2], "confidence": 1.0, "mv": v.tolist()} for i in range(n) for j, (k, v) in enumerate(synth.six(("dog", "cat")[i % 2], seed=i)[0].items())]
    return spark.createDataFrame(rows, "page long, lead string, position int, species string, confidence double, mv array<double>")


def test_pages(spark):
    s = pages(spark, 4)
    b = bridge.page_beats(s).collect()
    assert {r.page for r in b} == {0, 1, 2, 3} and all(r.issue is None and r.n_leads == 6 and r.lead_ms["II"] == r.t_ii_ms for r in b)
    bad = s.withColumn("species", bridge.F.lit("horse"))
    assert {r.issue for r in bridge.page_beats(bad).collect()} == {"exception:beats:KeyError:'horse'"}


def test_a_failed_page_says_so(spark, monkeypatch):
    """A page or sheet that fails is told from a result in every query, and a lack of memory is no page's issue."""
    from pulseframe.plans.catalog import QUERIES

    bad = pages(spark, 2).withColumn("species", bridge.F.when(bridge.F.col("page") == 1, "horse").otherwise(bridge.F.col("species")))
    monkeypatch.setattr(waves, "beats_on_pages", lambda *_: bridge.page_beats(bad))
    failed = "exception:beats:KeyError:'horse'"
    assert {(r.page, r.issue) for r in QUERIES["delineate_beats"](spark, "").collect()} == {(0, None), (1, failed)}
    assert [(r.page, r.n_beats > 0, r.issue) for r in QUERIES["page_measurements"](spark, "").orderBy("page").collect()] == [(0, True, None), (1, False, failed)]
    sheet_of = bridge.pa.table({"page": [7], "species": ["dog"], "width": [9], "height": [9], "gray": [b"12345"]})
    assert bridge.beats_of(bridge.signals_of(sheet_of))["issue"][0].as_py().startswith("exception:ValueError")

    def no_memory(*_):
        raise MemoryError

    monkeypatch.setattr(bridge, "_beats_together", no_memory)
    with pytest.raises(MemoryError):
        bridge.beats_of(bridge.pa.table({"page": [1], "lead": ["II"], "species": ["dog"], "confidence": [1.0], "mv": [[0.0]]}))


def drawn_pages(n):
    """n pages' beats as page_beats gives them, of one to eight beats each."""
    rows = [{"case_id": p // 5, "page": p, "page_no": p % 5, "i": i, "at_ms": 320.0 + 490 * i + p % 7, "kind": ("plain", "plain", "wide", "no_p")[(p + i) % 4], "size": 0.8 + i / 20} for p in range(n) for i in range(8 if p % 6 else 1 + p % 8)]
    return bridge.pa.Table.from_pylist(rows, bridge.pa.schema([("case_id", "int64"), ("page", "int64"), ("page_no", "int32"), ("i", "int32"), ("at_ms", "float64"), ("kind", "string"), ("size", "float64")]))


def test_pages_together_are_pages_alone():
    """Pages that are drawn, filtered and searched together have the beats and marks that each has alone; one that fails takes no other with it."""
    t = drawn_pages(40)
    together = [leads for pages in waves.drawn(t) for leads in pages]
    alone = {p: next(waves.drawn(t.filter(bridge.pa.compute.equal(t["page"], p))))[0] for p in range(40)}
    assert len(together) == 40 and all(np.allclose(a["mv"], b["mv"], atol=1e-6) for leads in together for a, b in zip(leads, alone[leads[0]["page"]], strict=True))
    got = {p: [r for r in bridge.beats_table(together).to_pylist() if r["page"] == p] for p in range(40)}
    for p, leads in alone.items():
        want = bridge.beats_table([leads]).to_pylist()
        assert len(got[p]) == len(want)
        for a, b in zip(got[p], want, strict=True):
            assert all(a[k] == pytest.approx(b[k], abs=1e-5) if isinstance(b[k], float) else a[k] == b[k] for k in b), (p, a, b)
    unmarked = bridge.beats_table(together, marks=False).to_pylist()
    assert [(r["page"], r["t_ms"], r["reasons"]) for r in unmarked] == [(r["page"], r["t_ms"], r["reasons"]) for r in bridge.beats_table(together).to_pylist()] and not any(r["q_on"] for r in unmarked)
    together[3][0]["bad"] = [{"i0": None, "i1": 4, "kind": "gap"}]
    failed = bridge.beats_table(together).to_pylist()
    assert {r["page"] for r in failed if r["issue"]} == {together[3][0]["page"]} and {r["page"] for r in failed if not r["issue"]} == {leads[0]["page"] for i, leads in enumerate(together) if i != 3}


def test_pages_are_cheap():
    """Drawing a page and finding its beats with all marks takes some milliseconds (30 and more, page by page)."""
    import time

    t = drawn_pages(96)
    run = lambda: [bridge.beats_table(pages) for pages in waves.drawn(t)]
    run()
    began = time.thread_time()
    run()
    assert time.thread_time() - began < 96 * 0.02


@pytest.mark.parametrize("name", sorted(ROWS))
def test_rhythm_from_rates(spark, name):
    rates, early, pauses = ROWS[name]
    t = np.cumsum([0.0, *[60_000 / r for r in rates]])
    df = spark.createDataFrame([(1, i, float(x), "II", 1.0) for i, x in enumerate(t)], "page long, beat_id long, t_ms double, lead string, value double").withColumn("case_id", rhythm.F.lit(7))
    assert abs(rhythm.heart_rate(df).first().hr_mean - 60_000 / np.mean(np.diff(t))) < 1e-6
    assert sorted(r.beat_index - 1 for r in rhythm.premature(df).filter("premature").collect()) == early
    assert sorted(r.beat_index - 1 for r in rhythm.pauses(df).collect()) == pauses


@pytest.mark.parametrize(
    "profile, key, value, r, want",
    [
        ("dog-large", "t", 0.65, 2.5, "border"), ("dog-large", "t", 0.7, 2.5, "abnormal"), ("cat", "t", -0.25, None, "border"), ("cat", "t", 0.34, None, "abnormal"),
        ("dog-small", "q", -1.9, None, "border"), ("cat", "hrMean", 130.0, None, "border"), ("cat", "hrMean", 119.0, None, "abnormal"), ("cat", "qtc", 0.3, None, "n/a"), ("dog-small", "hrMean", None, None, "n/a"),
    ],
)
def test_norms(spark, profile, key, value, r, want):
    df = spark.createDataFrame([(profile, key, value, r)], "profile string, key string, value double, r double")
    assert norms.classify(df, spark).first().verdict == want


@pytest.mark.parametrize("species, variant", [("dog", "A"), ("cat", "B")])
def test_sheet_read_back(species, variant):
    ii, truth = synth.signal(species, noise=0.002)
    leads = synth.leads(ii)
    r = sheet.read(waves.draw(leads, variant))
    assert r["variant"] == variant and r["issues"] == [] and abs(r["px_per_mm"][0] - sheet.VARIANTS[variant][2]) < 0.02
    for k, (mv, _) in r["leads"].items():
        assert np.corrcoef(mv[:2400], leads[k][:2400])[0, 1] > 0.98 and abs(mv.max() - leads[k].max()) < 0.06
    beats = detect.detect({k: m for k, (m, _) in r["leads"].items()}, {}, species)
    assert len(beats) == len(truth)
    assert "no_frame" in sheet.read(np.full((905, 1280), 255, np.uint8))["issues"]


def test_sheets(spark):
    drawn = [waves.draw(synth.leads(synth.signal(x, noise=0.002)[0]), v) for x, v in (("dog", "A"), ("cat", "B"))]
    s = spark.createDataFrame([(i, "dog", d.shape[1], d.shape[0], bytearray(d.tobytes())) for i, d in enumerate(drawn)], "page long, species string, width int, height int, gray binary")
    rows = bridge.read_sheets(s.union(s.selectExpr("page + 10", "species", "width", "height", "substring(gray, 1, 5)"))).collect()
    assert len(rows) == 14 and {r.issues[0].split(":")[1] for r in rows if r.page >= 10} == {"ValueError"}


def test_two_leads_that_meet():
    """Two curves that touch for a while keep to their own sides."""
    up, down = np.full(120, 20.0), np.full(120, 60.0)
    up[40:60], down[40:60] = 40, 40
    columns = [np.array([[a - 1, a + 1]] if a == b else [[a - 1, a + 1], [b - 1, b + 1]]) for a, b in zip(up, down, strict=True)]
    a, b = sheet.path_pair(columns, (20.0, 60.0), 40.0)
    mid = lambda way: np.array([columns[i][k].mean() if k >= 0 else np.nan for i, k in enumerate(way)])
    assert (mid(a)[:40] == 20).all() and (mid(a)[60:] == 20).all() and (mid(b)[:40] == 60).all() and (mid(b)[60:] == 60).all()
    assert (np.nan_to_num(mid(a)[41:59], nan=40) == 40).all()


def test_layout_evidence():
    img = np.full((60, 200), 255, np.uint8)
    assert not layout.has_digit_row(img, 0, 20, 200, 20)
    for k in range(20):
        img[24:32, 5 + 9 * k : 8 + 9 * k] = 20
    assert layout.row_evidence(img, 0, 23, 200, 15) == (20 * 24, 20, 0) and layout.has_digit_row(img, 0, 20, 200, 20)
    img[0:23, :] = 20
    assert not layout.has_digit_row(img, 0, 20, 200, 20)
    rng = np.random.default_rng(2)
    a = rng.random((12, 30)) < 0.3
    moved = np.roll(a, (1, -2), (0, 1))
    want = min(1 - (m := (np.pad(a, 3) & np.pad(moved, ((3 + y, 3 - y), (3 + x, 3 - x)))).sum()) / (a.sum() + moved.sum() - m) for y in range(-2, 3) for x in range(-2, 3))
    assert np.isclose(layout.distance(a, moved, 2), want) and layout.distance(a, a) == 0
    assert layout.distance(a, np.zeros_like(a)) == 1 and layout.distance(np.zeros_like(a), np.zeros_like(a)) == 0
    assert layout.decide({"rrRow": "B", "height": "A", "frame": "A"}) == ("A", 2 / 3.5, True) and layout.decide({}) == (None, 0.0, False)


def test_votes_for_a_variant():
    a, b = (sheet.VARIANTS[v] for v in "AB")
    assert sheet.vote(a[0], a[1]) == ("A", False) and sheet.vote(b[0], b[1]) == ("B", False) and sheet.vote(b[0], None) == ("B", False)
    assert sheet.vote(a[0], b[1]) == ("A", True) and sheet.vote(400, None) == ("B", False)


def test_plus_marks():
    px, phase = 4.3, 3.0
    img = np.full((400, 1100), 255, np.uint8)
    for row in range(0, 18, 2):
        for line in range(3, 50, 10):
            x, y = round(phase + line * 5 * px), round(phase + row * 5 * px)
            if 2 <= y < 398 and 2 <= x < 1098:
                img[y, x - 2 : x + 3] = img[y - 2 : y + 3, x] = 30
    second, columns = layout.plus_marks(img, phase, phase, px)
    assert abs(second - 50 * px) < 0.6 and [n for n, _ in columns] == [3, 13, 23, 33, 43]
    assert layout.plus_marks(np.full((100, 100), 255, np.uint8), 0, 0, px) == (None, [])


def test_glyphs():
    rng = np.random.default_rng(4)
    shapes = {c: np.where(rng.random((8, 5)) < 0.5, 220.0, 0.0) for c in "0123456789"}
    for t in shapes.values():
        t[:, 0] = t[0] = 220.0  # the box is the whole template
        t[-1, -1] = 220.0
    word, ink = "40719", np.zeros((8, 33))
    for k, c in enumerate(word):
        ink[:, 1 + 6 * k : 6 + 6 * k] = shapes[c] * 0.9
    templates = list(shapes.items())
    assert "".join(t for t, _ in glyphs.decode(ink, templates)) == word
    assert [glyphs.match(ink, (1 + 6 * k, 0, 5, 8), templates)[0] for k in range(5)] == list(word)
    assert glyphs.match(np.zeros((8, 8)), (1, 0, 5, 8), templates)[0] == "?"
    x, y, score = glyphs.fragment(ink, shapes["7"])
    assert (x, y) == (13, 0) and score > 0.99 and glyphs.fragment(np.zeros((8, 9)), shapes["7"]) is None
    dots = np.zeros((9, 12), bool)
    dots[1:3, 2:4] = dots[6:8, 2:4] = dots[1:8, 7:9] = True
    found = glyphs.components(dots)
    assert len(found) == 3 and glyphs.glyphs(found) == [(2, 1, 2, 7, 8), (7, 1, 2, 7, 14)]
    assert len(glyphs.dissimilar([shapes["1"], shapes["1"] * 0.5, shapes["2"]])) == 2


def test_areas_of_many_beats():
    """Areas of all pages at once are those of each stretch by its definition, also at a row's ends, beside unreliable stretches and without samples before."""
    rng = np.random.default_rng(5)
    n = np.array([400, 90])
    x = rng.normal(size=(2, 400))
    x[1, 90:] = 0
    bad = [[{"i0": 200, "i1": 210, "kind": "clipped"}, {"i0": 30, "i1": 40, "kind": "ambiguous"}], []]
    cases = [(r, a, a + w, onset) for r in (0, 1) for a in (-5, 0, 1, 3, 20, 60, 85, 190, 205, 390) for w in (0, 1, 25) for onset in (True, False)]
    row, a, b, onset = (np.array(v) for v in zip(*cases, strict=True))
    for (r, a, b, onset), got in zip(cases, bridge.areas(x, n, bad, row, a, b, onset), strict=True):
        mv, a, b = x[r, : n[r]], max(0, a), min(n[r] - 1, b)
        if b <= a or (r == 0 and a <= 210 and b >= 200):
            assert np.isnan(got)
            continue
        before = mv[max(0, a - bridge.place(bridge.C.PQ_FROM)) : max(0, a - bridge.place(bridge.C.PQ_TO) + 1)]
        around = mv[max(0, a - 2 * (b - a)) : b + 2 * (b - a) + 1]
        base = np.median(around) if not onset else np.median(before) if len(before) else mv[a]
        assert got == pytest.approx((mv[a : b + 1] - base).sum() * 2, abs=1e-9)
