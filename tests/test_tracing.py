"""Ink and its owners, curves with their apexes, samples: on small runs by hand, and on drawn sheets read back."""

import numpy as np
import pytest
from tests import synthetic as synth

from pulseframe.kernels import marks, sheet, tracing
from pulseframe.sources import waves

PX = sheet.VARIANTS["A"][2]


def columns_of(mask):
    return [sheet.runs(mask[:, i]) for i in range(mask.shape[1])]


def test_components_and_owners():
    rng = np.random.default_rng(3)
    for _ in range(30):
        mask = rng.random((30, 25)) < 0.35
        columns = [np.array(tracing.stretches(mask[:, i]), float).reshape(-1, 2) for i in range(25)]
        a, b, at = tracing.touching(columns)
        label = tracing.components(at[-1], a, b)
        # plain flood fill over runs
        edges = {i: set() for i in range(at[-1])}
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            edges[i].add(j)
            edges[j].add(i)
        want = np.full(at[-1], -1)
        for i in range(at[-1]):
            todo = [i] if want[i] < 0 else []
            while todo:
                k = todo.pop()
                if want[k] < 0:
                    want[k] = i
                    todo += edges[k]
        assert (label == want).all()
        ways = np.array([[0 if len(r) else -1 for r in columns]])
        owner = tracing.owners(columns, ways)
        touched = {label[at[c]] for c in range(25) if ways[0, c] == 0}
        assert ((owner == 0) == np.isin(label, list(touched))).all()
        share = tracing.explained(columns, ways, np.array([15.0]), mask)
        pixels = np.concatenate([r[:, 1] - r[:, 0] + 1 for r in columns])
        assert share[0] == pytest.approx(pixels[owner == 0].sum() / mask.sum())
    assert tracing.components(0, np.zeros(0, int), np.zeros(0, int)).size == 0


def test_curve_of_an_apex():
    runs = np.array([[50, 52], [20, 51], [18, 21], [20, 60], [58, 60]], float)
    x, y = tracing.curve(np.arange(10, 15, dtype=float), runs)
    assert (10, 51) in zip(x, y, strict=True) and y.min() == 18 and (np.diff(x) >= 0).all()
    lone = np.array([[50, 52], [10, 51], [50, 52]], float)
    x, y = tracing.curve(np.array([0.0, 1.0, 2.0]), lone)
    assert list(zip(x, y, strict=True)) == [(0, 51), (0.5, 50.5), (1, 10), (1.5, 50.5), (1.5, 50.5), (2, 51)]
    x, y = tracing.curve(np.array([0.0, 1.0, 2.0]), lone, claimed={1: (False, True)})
    assert y.min() == 50.5  # the top belongs to another lead
    both = np.array([[50, 52], [10, 90], [50, 52]], float)
    assert {10, 90} <= set(tracing.curve(np.array([0.0, 1.0, 2.0]), both)[1].tolist())
    dark = np.zeros((100, 3))
    dark[50:53, 0] = (10, 10, 80)
    assert tracing.curve(np.array([0.0]), runs[:1], dark)[1][0] == pytest.approx(51.7)
    assert tracing.curve(np.zeros(0), np.zeros((0, 2)))[0].size == 0


def test_samples_keep_apexes():
    t = tracing.Trace(np.array([0.0, 10.0, 10.4, 10.7, 30.0]), np.array([100.0, 100.0, 60.0, 140.0, 100.0]), 100.0, [(20, 23, "gap")])
    mv, spans = tracing.digitize(t, 0.0, 30.0, 0.9, 0.02, (0.0, 200.0))
    assert mv.max() == pytest.approx(0.8) and mv.min() == pytest.approx(-0.8) and abs(int(mv.argmax()) - int(mv.argmin())) == 1
    assert spans == [(22, 26, "gap")] and len(mv) == 34
    clipped = tracing.Trace(np.array([0.0, 9.0, 10.0, 20.0, 21.0, 30.0]), np.array([100.0, 100.0, 2.0, 2.0, 100.0, 100.0]), 100.0, [(11, 19, "clipped")])
    mv, spans = tracing.digitize(clipped, 0.0, 30.0, 1.0, 0.02, (0.0, 200.0))
    assert (mv[11:19] == 2.0).all() and spans == [(11, 19, "clipped")]
    assert tracing.digitize(tracing.Trace(np.zeros(0), np.zeros(0)), 0, 10, 1.0, 1.0, (0, 1)) [0].size == 0


def test_baseline_with_drift():
    x = np.arange(1000.0)
    assert tracing.baseline(x, np.where(x % 200 < 20, 40.0, 100.0), 215.0) == 100.0
    drift = 100 + 10 * (x - 500) / 500
    assert abs(tracing.baseline(x, drift, 215.0) - 100) < 2


@pytest.mark.parametrize(("species", "variant"), [("dog", "A"), ("cat", "B")])
def test_amplitudes_of_drawn_sheets(species, variant):
    leads, truth = synth.six(species, noise=0.0)
    r = sheet.read(waves.draw(leads, variant))
    off = []
    for k, (mv, confidence) in r["leads"].items():
        t = r["traces"][k]
        assert t.explained >= 0.97 and t.coverage >= 0.98 and confidence >= 0.98 and t.reasons == [] and r["bad"][k] == []
        for b in truth[1:-1]:
            i, j = round(b["q_on"] / 2) - 10, round(b["s_off"] / 2) + 10
            off += [abs(mv[i:j].max() - leads[k][i:j].max()), abs(mv[i:j].min() - leads[k][i:j].min())]
        lag = [np.abs(mv[10 + s : 2300 + s] - leads[k][10:2300]).mean() for s in range(-4, 5)]
        assert abs(int(np.argmin(lag)) - 4) <= 2  # all leads lie on one axis of time
    assert np.mean(off) <= 0.01 and max(off) <= 0.03  # a pixel is 0.023 mV


def test_gaps_and_ink_of_none():
    leads, _ = synth.six("dog", noise=0.0)
    img = waves.draw(leads)
    x0, y0 = 47, 45
    base = y0 + (20 + 30) * PX
    img[round(base - 10 * PX) : round(base + 10 * PX), x0 + 400 : x0 + 430] = 255
    img[round(base + 2 * 30 * PX - 45) : round(base + 2 * 30 * PX - 30), x0 + 600 : x0 + 760] = 40  # a block of ink that hangs on nothing
    r = sheet.read(img)
    assert [(a, b, kind) for a, b, kind in r["traces"]["II"].spans] == [(400, 429, "gap")] and "gap" in r["traces"]["II"].reasons and 0.5 <= r["leads"]["II"][1] < 1
    (i0, i1, kind), = r["bad"]["II"]
    assert kind == "gap" and abs((i1 - i0 + 1) - 30 / (50 * PX / 500)) <= 2
    hurt = [k for k, t in r["traces"].items() if t.explained < 0.97]
    assert len(hurt) <= 2 and all("ink_unexplained" in r["traces"][k].reasons for k in hurt)


def test_leads_that_cross():
    """Lead II's R reaches over the baseline of lead I and beyond; both keep their own extremes."""
    t = np.arange(2500) * 2.0
    quiet = 0.01 * np.sin(t / 120)
    leads = {k: quiet.copy() for k in sheet.LEADS}
    for on in (700, 1700, 2700, 3700):
        leads["II"] += 3.3 * np.clip(1 - np.abs(t - on) / 18, 0, None)
        leads["I"] += 0.8 * np.clip(1 - np.abs(t - on - 400) / 18, 0, None)
    r = sheet.read(waves.draw(leads))
    one, two = r["leads"]["I"][0], r["leads"]["II"][0]
    for on in (700, 1700, 2700, 3700):
        near = slice(on // 2 - 15, on // 2 + 15)
        away = slice(on // 2 + 185, on // 2 + 215)
        assert abs(two[near].max() - leads["II"][near].max()) <= 0.09, on  # the drawn tip itself is up to three pixels short
        assert abs(one[near].max() - leads["I"][near].max()) <= 0.07 and one[near].min() >= leads["I"][near].min() - 0.15, on
        assert abs(one[away].max() - leads["I"][away].max()) <= 0.025
    assert all(t.explained >= 0.97 for t in r["traces"].values())


def test_parting_of_shared_runs():
    """Two curves whose runs were bridged into one are parted at the white gap between them."""
    upper, lower = [np.array([[10, 12], [20, 22]], float)] * 2, np.array([[9, 22]], float)
    columns = [*upper, lower, lower, *upper]
    breaks = [[[], []], [[], []], [[(15, 16)]], [[(15, 16)]], [[], []], [[], []]]
    ways = np.array([[0, 0, 0, 0, 0, 0], [1, 1, 0, 0, 1, 1]])
    own = tracing.split(columns, breaks, ways)
    assert {c: r.tolist() for c, r in own[0].items()} == {2: [9, 14], 3: [9, 14]} and {c: r.tolist() for c, r in own[1].items()} == {2: [17, 22], 3: [17, 22]}
    assert tracing.split(columns, [[[], []], [[], []], [[]], [[]], [[], []], [[], []]], ways) == [{}, {}]


def test_claims_on_extremes():
    """A stroke of the upper lead turns inside a shared stretch: its lowest point is the upper lead's, not a dip of the flat lower lead."""
    runs = [{0: np.array([10.0, 12]), 1: np.array([12.0, 60]), 2: np.array([10.0, 12])}, {0: np.array([40.0, 42]), 1: np.array([12.0, 60]), 2: np.array([40.0, 42])}]
    one, two = tracing.claims(runs, np.array([False, True, False]), (0, 1))
    assert one == {1: (False, True)} and two == {1: (False, False)}


@pytest.mark.parametrize("variant", ["A", "B"])
def test_grid_phase_of_drawn_sheets(variant):
    px = sheet.VARIANTS[variant][2]
    for drawn in (False, True):
        r = sheet.read(waves.draw(synth.six("dog", noise=0.0)[0], variant, marks=drawn))
        for axis, origin, start in zip(r["grid"], r["frame"][:2], sheet.VARIANTS[variant][1][:2], strict=True):
            off = (axis.first + origin - start) % px
            assert min(off, px - off) <= 0.25 and axis.contrast > 1.5
            assert (axis.bold is not None) == drawn  # lines that are all alike don't say which are the fifth ones
            if drawn:
                off = (axis.bold + origin - start) % (5 * px)
                assert min(off, 5 * px - off) <= 0.25
        assert abs(r["px_per_second"] / (50 * px) - 1) <= 0.001


@pytest.mark.parametrize(("species", "variant"), [("dog", "A"), ("cat", "B")])
def test_marks_leave_traces_alone(species, variant):
    leads = synth.six(species, noise=0.0)[0]
    plain, marked = (sheet.read(waves.draw(leads, variant, marks=m)) for m in (False, True))
    assert plain["marks"] == [] and len(marked["marks"]) >= 50 and marked["issues"] == []
    for k in sheet.LEADS:
        a, b = plain["traces"][k], marked["traces"][k]
        assert b.explained >= 0.999 and b.reasons == [] and marked["bad"][k] == []
        x = np.arange(max(a.x[0], b.x[0]), min(a.x[-1], b.x[-1]) + 1)
        assert np.abs(np.interp(x, a.x, a.y) - np.interp(x, b.x, b.y)).max() <= 1
        one, two = plain["leads"][k][0], marked["leads"][k][0]
        assert len(one) == len(two) and np.abs(one - two).max() <= 0.03


def test_erasing_a_mark():
    """Hung on nothing, a mark goes with its soft edge; on a curve its arms go and the curve stays; what is no mark stays."""
    cross = np.zeros((31, 31), bool)
    cross[15, 13:18] = cross[13:18, 15] = True

    def left(curve, soft=None, place=(15.4, 14.0)):
        mask = cross | curve | (soft if soft is not None else False)
        out, found = marks.erase(mask, cross | curve, [place])
        assert found == [(15, 15)]
        return out

    none = np.zeros_like(cross)
    edge = none.copy()
    edge[16, 17] = edge[12, 15] = True
    assert not left(none, edge).any()
    for thick in (1, 2):
        across = none.copy()
        across[15 : 15 + thick] = True
        assert (left(across) == across).all()
        assert (left(across.T.copy()) == across.T).all()
    assert (left(across | across.T) == (across | across.T)).all()
    below = none.copy()
    below[18:20] = True  # an arm's end touches the curve
    assert (left(below)[18:20] == below[18:20]).all() and not left(below)[13:17].any()
    steep = none.copy()
    steep[5:25, 14:16] = True
    out, found = marks.erase(steep, steep, [(15.0, 15.0)])
    assert (out == steep).all() and found == []
    assert marks.erase(none, none, [(15.0, 15.0), (-3.0, 200.0)])[1] == []
    assert marks.erase(cross, cross, [(22.0, 15.0)])[1] == []  # too far off
    corner = none.copy()
    corner[0, :3] = corner[:3, 0] = True
    assert (marks.erase(corner, corner, [(0.0, 0.0)])[0] == corner).all()


def test_lines_at_once():
    """All columns' runs and gaps at once are those of each column; labels join a chain, whatever its order."""
    rng = np.random.default_rng(3)
    for share in (0.0, 0.1, 0.5, 0.9, 1.0):
        mask = rng.random((40, 60)) < share
        columns, breaks = sheet.column_runs(mask)
        each = [sheet.runs(c) for c in mask.T]
        assert all((a == b).all() and a.shape == b.shape for a, b in zip(columns, each, strict=True))
        assert breaks == [sheet.bridged(c, r) for c, r in zip(mask.T, each, strict=True)]
    chain = rng.permutation(2000)
    assert (tracing.components(2000, chain[:-1], chain[1:]) == 0).all()


def test_sheets_together_are_sheets_alone():
    """Sheets of both variants, with and without marks, have the same signals together as alone, and one that fails takes no other with it."""
    images = [waves.draw(synth.six("dog", noise=0.0, seed=i)[0], "AB"[i % 2], marks=i % 3 == 0) for i in range(4)]
    images.insert(2, np.zeros((3, 0), np.uint8))
    found = sheet.read_together(images)
    assert isinstance(found[2], Exception)
    for r, img in [(r, img) for r, img in zip(found, images, strict=True) if img.size]:
        alone = sheet.read(img)
        assert r["issues"] == alone["issues"] and r["bad"] == alone["bad"] and r["marks"] == alone["marks"] and all((r["leads"][k][0] == mv).all() for k, (mv, _) in alone["leads"].items())


def test_ways_of_sheets_with_unlike_runs():
    """Ways found together are those found alone where sheets have more, fewer or no runs in a column."""
    rng = np.random.default_rng(3)
    sheets = []
    for most in (1, 3, 6):
        columns = [np.sort(rng.choice(200, 2 * int(rng.integers(0, most + 1)), replace=False)).reshape(-1, 2).astype(float) for _ in range(60)]
        sheets.append((columns, np.array([40.0, 90.0, 140.0]), 50.0))
    for ways, one in zip(sheet.paths_together(sheets), sheets, strict=True):
        assert (ways == sheet.paths(*one)).all() and (ways.max(0) < [max(1, len(r)) for r in one[0]]).all()


def test_sheets_are_cheap():
    """A sheet is read in about a tenth of a second (three tenths, sheet by sheet)."""
    import time

    images = [waves.draw(synth.six("dog", noise=0.0)[0], "A", marks=i % 3 == 0) for i in range(16)]
    sheet.read_together(images[:2])
    began = time.thread_time()
    sheet.read_together(images)
    assert time.thread_time() - began < 16 * 0.2
