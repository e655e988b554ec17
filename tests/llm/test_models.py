import os
import random
import re
import zlib

import numpy as np

from pulseframe.llm import langid, lmscore, toxicity
from pulseframe.llm.common import learning_rows
from tests.llm.helpers import frame

POOLS = {"en": ["the", "and", "house", "with", "river", "green"], "de": ["der", "und", "haus", "nicht", "schön", "fluss"], "fr": ["le", "et", "maison", "avec", "être", "été"]}


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def talk(seed=4, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(POOLS))
        t = ". ".join(" ".join(rng.choice(POOLS[lang]) + rng.choice(["", "", "er", "s"]) for _ in range(8)) for _ in range(5))
        out.append([i, t, lang, "s", None, None, None])
    return out


def test_language(spark):
    data = talk() + [[1000, None, "en", "s", None, None, None], [1001, "12 !?", "en", "s", None, None, None], [1002, "", None, None, None, None, None], [None, "the house", None, None, None, None, None]]
    got = langid.identify(frame(spark, data)).collect()
    want = {r[0]: r[2] for r in data}
    assert len(got) == len(data)
    assert all(g.held_out == held(g.doc_id) for g in got if g.doc_id is not None)
    tested = [g for g in got if g.held_out and g.doc_id is not None and g.doc_id < 1000]
    assert np.mean([g.lang_pred == want[g.doc_id] for g in tested]) > 0.98
    assert {g.lang_pred for g in got if g.doc_id in (1000, 1001, 1002)} == {"und"}
    assert all(0 <= g.score <= 1 for g in got)
    assert langid.identify(frame(spark, [])).count() == 0
    none = [[1, "some text", None, None, None, None, None]]
    assert langid.identify(frame(spark, none)).first().lang_pred == "und"


def test_kernel_matches_definition():
    texts = ["abc abd", "abd", "xyz xyz", ""]
    s = [set(x.tolist()) for x in langid.features(texts)]
    assert len(s[3]) == 0 and s[1] & s[0] and len(s[2]) == len(langid.features(["xyz xyz xyz xyz"])[0])
    langs, w = langid.fit(langid.features(texts[:3] * 5), ["a", "a", "b"] * 5, landmarks=3)
    for t, want in zip(texts[:3], "aab", strict=True):
        f = langid.features([t])[0]
        assert langs[int((w[f].sum(0) / np.sqrt(len(f))).argmax())] == want


def test_kernel_ridge_solves_its_equations():
    """fit and scores against the kernel written out: presence kernels with landmarks, and the normal equations of ridge regression."""
    texts = [r[1][:120] for r in talk(8, 40)]
    labels = [r[2] for r in talk(8, 40)]
    sets = langid.features(texts)
    langs, w = langid.fit(sets, labels, landmarks=5)
    kernel = lambda a, b: len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b))
    marks = [i for lang in langs for i in [j for j, x in enumerate(labels) if x == lang][:5]]
    k = np.array([[kernel(a, sets[j]) for j in marks] for a in sets])
    y = np.array([[x == lang for lang in langs] for x in labels], float)
    a = np.linalg.solve(k.T @ k + langid.RIDGE * len(sets) * k[marks] + 1e-8 * np.eye(len(marks)), k.T @ y)
    new = langid.features(["der fluss und the river", "été maison", "", texts[0]])
    want = np.array([[kernel(x, sets[j]) if len(x) else 0 for j in marks] for x in new]) @ a
    assert np.allclose(langid.scores(new, w), want, atol=1e-4)


def test_samples_hold_on_repeated_rows(spark):
    """A document repeated ten thousand times takes no other text's place, and the sample stays within its bounds."""
    data = talk(3, 200) + [[4, talk(3, 200)[4][1], "en", "s", None, None, None]] * 10_000
    d = frame(spark, data).selectExpr("lang AS label", "text")
    kinds = {lang: {r[1] for r in data if r[2] == lang} for lang in POOLS}
    got = [tuple(r) for r in learning_rows(d, None, 1000, 10**9, 10).select("label", "text").collect()]
    assert len(got) == len(set(got)) and {lang: {t for x, t in got if x == lang} for lang in POOLS} == kinds
    few = learning_rows(d, None, 20, 10**9, 2).collect()
    assert len(few) == 40 and len({r.label for r in few}) == 2
    assert all(sum(len(r.text) for r in learning_rows(d, None, 1000, 2000, 9).collect() if r.label == lang) < 2000 + max(map(len, kinds[lang])) for lang in POOLS)
    assert learning_rows(d.limit(0), None, 5, 5, 5).count() == 0


def test_int_ids_and_noisy_or(spark):
    """doc_id of another integer type; and the score of a document written out from its sentences' weights."""
    data = talk(5, 300)
    for r in data[::3]:
        r[1] += ". vilewort here"
    small = frame(spark, data).withColumn("doc_id", lmscore.F.col("doc_id").cast("int"))
    lab = spark.createDataFrame([(r[0], int(i % 3 == 0)) for i, r in enumerate(data)], "doc_id int, toxic int")
    assert langid.identify(small).count() == 300
    model, bias = toxicity.train(small, lab)
    got = {r.doc_id: r.score for r in toxicity.score(small, lab).collect()}
    for r in data[:20]:
        clean = 1.0
        for sentence in re.split("[.!?\n]", r[1]):
            words, _, _, _ = toxicity.sentences([sentence])
            if len(words):
                clean *= 1 - 1 / (1 + np.exp(-(model.value[words].astype(float).sum() + bias)))
        assert np.isclose(got[r[0]], 1 - clean, atol=1e-5)


def test_toxicity(spark):
    rng = random.Random(9)
    data, labels = talk(5, 600), []
    for r in data:
        bad = rng.random() < 0.3
        if bad:
            w = r[1].split(" ")
            w[rng.randrange(len(w))] = rng.choice(["vilewort", "vileworten", "nastig"])
            r[1] = " ".join(w)
        labels.append((r[0], int(bad)))
    y = dict(labels)
    data += [[1000, None, None, None, None, None, None], [1001, "", None, None, None, None, None], [None, "x", None, None, None, None, None]]
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score(frame(spark, data), lab).collect()
    assert len(got) == len(data) and all(0 <= g.score <= 1 for g in got)
    tested = [g for g in got if g.held_out and g.doc_id in y]
    assert np.mean([g.predicted == y[g.doc_id] for g in tested]) > 0.95
    texts = {r[0]: r[1] for r in data}
    for g in tested:
        if g.predicted and y[g.doc_id] and g.offending:
            assert any(v in texts[g.doc_id][s.start : s.end] for s in g.offending for v in ("vile", "nastig"))
    assert {g.score for g in got if g.doc_id in (1000, 1001)} == {0.0}
    clean = toxicity.keep_clean(frame(spark, data), lab)
    assert {r.doc_id for r in clean.collect()} == {g.doc_id for g in got if not g.predicted}
    assert toxicity.score(frame(spark, []), lab).count() == 0
    assert toxicity.score(frame(spark, data[:5]), lab.filter("false")).agg({"score": "max"}).first()[0] == 0


def test_lm(spark):
    data = talk(6, 60)
    data += [[1000, None, None, None, None, None, None], [1001, "", None, None, None, None, None]]
    target = spark.createDataFrame([(r[0],) for r in data if r[2] == "de"] + [(None,)] * 2, "doc_id long")
    got = {g.doc_id: g for g in lmscore.score(frame(spark, data), target).collect()}
    lang = {r[0]: r[2] for r in data}
    assert max(g.score for i, g in got.items() if lang[i] == "de") < min(g.score for i, g in got.items() if lang[i] in ("en", "fr"))
    assert got[1000].n_tokens == 0 and got[1000].score == 0
    assert lmscore.score(frame(spark, []), target).count() == 0


def test_lm_learns_words_of_any_script(spark):
    """Texts that differ by words alone, in scripts without Latin letters, score apart; losses against plain Python."""
    ru, zh = ("дом стоит около реки", "кот лежит рядом моря"), ("山高水深", "天青日白")
    data = [[i, x, "x", "s", None, None, None] for i, x in enumerate([ru[0], ru[1], zh[0], zh[1], ru[0], zh[0], "", None, ru[1]])]
    target = spark.createDataFrame([(0,), (2,)], "doc_id long")
    got = {g.doc_id: g for g in lmscore.score(frame(spark, data + [data[4]]), target).collect()}
    assert got[4].score < got[1].score - 0.5 and got[5].score < got[3].score - 0.5
    assert (got[4].n_tokens, got[5].n_tokens, got[6].n_tokens, got[7].n_tokens) == (4, 4, 0, 0)
    # losses in plain Python: a target document's own counts are taken out of the target's
    rows = [list(r[1]) if r[0] in (2, 3, 5) else (r[1] or "").split() for r in data + [data[4]]]
    chosen, words = (0, 2), {"^"}.union(*rows)

    def loss(i, texts, scale):
        single = [w for t in texts if t for w in [*t, "^"]]
        pair = [p for t in texts if t for p in zip(["^"] + t, t, strict=False)]
        total = 0
        for v, w in zip(["^"] + rows[i], rows[i], strict=False):
            p = (scale * single.count(w) + lmscore.ALPHA) / (scale * len(single) + lmscore.ALPHA * len(words))
            total -= np.log2((scale * pair.count((v, w)) + lmscore.PRIOR * p) / (scale * single.count(v) + lmscore.PRIOR))
        return total / len(rows[i])

    size = lambda texts: sum(len(t) + 1 for t in texts if t)
    for i in (0, 1, 2, 3, 4, 8):
        assert np.isclose(got[i].target_loss, loss(i, [rows[k] for k in chosen if k != i], 1.0)), i
        assert np.isclose(got[i].background_loss, loss(i, rows, size([rows[k] for k in chosen]) / size(rows))), i


def test_lm_in_many_packs(spark, monkeypatch):
    """Packs and parts change no score; repeated rows each have one, and an int doc_id will do."""
    data = talk(7, 200) + [[5, "the house", "en", "s", None, None, None]] * 50
    target = spark.createDataFrame([(i,) for i in range(0, 100, 3)], "doc_id int")
    d = frame(spark, data).repartition(3).withColumn("doc_id", lmscore.F.col("doc_id").cast("int"))
    one = sorted(map(tuple, lmscore.score(d, target).collect()))
    monkeypatch.setattr(lmscore, "PACK", 1000)
    monkeypatch.setattr(lmscore, "PART", 1500)
    many = sorted(map(tuple, lmscore.score(d.repartition(5), target).collect()))
    assert len(one) == len(many) == 250 and np.allclose(np.array(one), np.array(many))


def test_fingerprints_of_very_long_texts():
    """600,000 different words: the same samples as in slices, in bounded memory."""
    import subprocess
    import sys

    code = """
import resource
from pulseframe.llm import fingerprints as f
long = " ".join(f"word{i}" for i in range(600_000))
a = f.fingerprints([long])
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
f.TERMS = 7
short = ["a b c d e f g h i j k l m", "a b c x y z " * 9, "", "m l k"]
few = f.fingerprints(short)
f.TERMS = 4096
assert (few == f.fingerprints(short)).all() and [len(x) for x in f.portions(["aa", "b", "cccc", "", "d"], 3)] == [2, 1, 2]
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 1000


def test_toxicity_learns_in_a_task(spark, monkeypatch):
    """The driver gets weights, not the texts to learn from."""
    monkeypatch.setattr(toxicity, "fit", lambda docs, y: (np.full(1 << toxicity.BITS, len(docs), np.float32), float(os.getpid())))
    d = spark.createDataFrame([(i, f"text number {i}") for i in range(60) if not held(i)], "doc_id long, text string")
    w, pid = toxicity.train(d, d.selectExpr("doc_id", "int(doc_id % 2) AS toxic"))
    assert pid != os.getpid() and (w.value == d.count()).all()
