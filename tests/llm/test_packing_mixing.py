import hashlib
import random
import re
import sys
import zlib

import duckdb
import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from pulseframe.llm import fingerprints, mixing, packing, queries
from pulseframe.llm.common import tokenizer
from tests.llm.helpers import frame, rows, words

PATH = tokenizer("word_bpe_49k.json")


def test_encoder():
    odd = ["it's don't.", "<|endoftext|> A<|startoftext|>b", "\xe9 x́. b\x1cc", "İ \xdf ς.", "a.b,c... 12.5!", "x'll. 's.", "", "漢字 \U0001f600", "1. ab, AB,"]
    t = Tokenizer.from_file(PATH)
    for x in odd + [r[1] for r in rows()]:
        assert np.frombuffer(packing.encoder(PATH)([x])[0], "<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids, repr(x)[:50]


def test_pack(spark):
    got = packing.pack(frame(spark), PATH, limit=512).toPandas()
    t = Tokenizer.from_file(PATH)
    want = []
    for r in rows():
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(k, at, min(512, len(ids) - at), zlib.crc32(ids[at : at + 512].tobytes())) for k, at in enumerate(range(0, len(ids), 512))]
    assert sorted(want) == sorted(zip(got.piece, got.start, got.length, got.ids_crc32, strict=True))
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 512
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 512) + 1
    assert packing.pack(frame(spark, []), PATH).count() == 0


def test_bins():
    rng = np.random.default_rng(2)
    for size in (10, 50, 4096):
        for _ in range(8):
            c = np.bincount(rng.integers(1, size + 1, 200), minlength=size + 1)
            b = packing.bins(c, size)
            used = np.zeros_like(c)
            for p, m in b:
                assert sum(x * k for x, k in p) <= size
                for x, k in p:
                    used[x] += k * m
            assert (used == c).all()
    c = np.zeros(11, int)
    c[[6, 4, 5, 3, 2]] = [2, 2, 2, 2, 2]  # 40 tokens: four full bins
    assert sum(m for _, m in packing.bins(c, 10)) == 4
    assert packing.bins(np.zeros(11, int), 10) == []


def fewest(items, size):
    """The least number of bins, by trying every place for every item."""
    items, best = sorted(items, reverse=True), len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            go(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, size - items[i]])

    go(0, [])
    return best


def test_bins_meet_the_optimum():
    rng = random.Random(5)
    for items, size in [([16, 18, 26, 30, 39, 43, 43, 56, 59, 62], 100)] + [([rng.randrange(1, 1 + rng.choice([s // 2, s])) for _ in range(rng.randrange(8, 14))], s) for s in (30, 100, 100, 1000) for _ in range(130)]:
        c = np.bincount(items, minlength=size + 1)
        got, want = sum(m for _, m in packing.bins(c, size)), fewest(items, size)
        assert got == want and packing.lower_bound(c, size) <= want, (items, size)


def test_mixing_against_sql(spark, tmp_path):
    """Sources of very different sizes, so that the exponent, repeats and cuts all matter."""
    rng = random.Random(4)
    data = [(i, words(rng, rng.randrange(0, 60)), None, rng.choices(["big", "mid", "low", None], [60, 25, 10, 5])[0], None, None, None) for i in range(600)]
    data += [(1000, None, None, "tiny", None, None, None), (1001, "", None, "tiny", None, None, None)]
    frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_mixing(spark, str(tmp_path)).collect()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = ["doc_id", "source", "pass", "tokens", "block", "block_pos"]
    want = c.execute(f"SELECT {', '.join(names)} FROM ({queries.SQL['op10_mixing']})").fetchall()
    assert sorted((tuple(g[n] for n in names) for g in got), key=str) == sorted(want, key=str)
    uses = {}
    for g in got:
        uses.setdefault(g.doc_id, []).append(g["pass"])
    assert max(map(len, uses.values())) > 1 and all(sorted(v) == list(range(len(v))) for v in uses.values())
    assert mixing.mix(frame(spark, []), keep=True).count() == 0
    assert mixing.mix(frame(spark), keep=True).select("row.*").columns == frame(spark).columns


def test_mixing_keeps_each_row(spark):
    """Rows equal in doc_id, source and text but not in other columns are each used, and the mixture does not depend on how they are dealt."""
    data = [(i % 7, f"word {i % 7}", "en", "a" if i % 3 else "b", f"n{i}", "y", "z") for i in range(60)]
    got = [sorted(tuple(r.row) + (r["pass"], r.block_pos) for r in mixing.mix(frame(spark, data).repartition(n), keep=True).collect()) for n in (1, 5)]
    assert got[0] == got[1] and {g[4] for g in got[0]} == {r[4] for r in data}


def test_fingerprints(spark):
    data = [r for r in rows() if r[0] is not None]
    got = fingerprints.fingerprint_with_next(frame(spark, data)).collect()
    hashes = {r.t: r.h for r in frame(spark, data).selectExpr("coalesce(text, '') t", "xxhash64(coalesce(text, '')) h").collect()}
    order = sorted(data, key=lambda r: (-r[0], hashes[r[1] or ""], r[1] or ""))
    want = {}
    for r, nxt in zip(order, order[1:] + order[:1], strict=True):
        t, x = r[1] or "", nxt[1] or ""
        m = len(t) // 3
        want.setdefault(r[0], set()).add(hashlib.sha256((t[: len(t) - m] + x[:m]).encode()).hexdigest())
    assert len(got) == len(data)
    for g in got:
        assert g.edited_sha256 in want[g.doc_id]
    by = {g.doc_id: g for g in got}
    assert by[4].fingerprint == by[5].fingerprint == by[6].fingerprint and by[1].fingerprint == by[2].fingerprint == by[12].fingerprint
    assert fingerprints.fingerprint_with_next(frame(spark, [])).count() == 0
    one = fingerprints.fingerprint_with_next(frame(spark, data[:1])).collect()
    assert one[0].near_next == 1


def test_fingerprints_with_a_hot_doc_id(spark):
    """A doc_id with half of all rows is dealt over several ranges; every row still has one next, and likenesses are those of the texts named."""
    rng = random.Random(6)
    data = [(5, words(rng, 30, 60), None, None, None, None, None) for _ in range(120)] + [(i, words(rng, 30, 60), None, None, None, None, None) for i in range(1000, 1100)] + [(None, "x y", *[None] * 5)]
    d = frame(spark, data)
    n = [r.asDict() for r in d.select("doc_id", "text", fingerprints.F.xxhash64("text").alias("hash")).collect()]
    n.sort(key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["hash"], r["text"]))
    got = fingerprints.fingerprint_with_next(d).collect()
    assert len(got) == len(data)
    want = []
    for r, nxt in zip(n, n[1:] + n[:1], strict=True):
        t, m = r["text"], len(r["text"]) // 3
        edited = t[: len(t) - m] + nxt["text"][:m]
        f = fingerprints.fingerprints([t, edited, nxt["text"]])
        want.append((r["doc_id"], len(t), hashlib.sha256(edited.encode()).hexdigest(), (f[0] == f[1]).mean(), (f[0] == f[2]).mean()))
    assert sorted(want, key=str) == sorted(((g.doc_id, g.n_chars, g.edited_sha256, g.near_edited, g.near_next) for g in got), key=str)


def test_collision_rate():
    rng = random.Random(1)
    errors = []
    for _ in range(60):
        a, b = words(rng, 200, 150), words(rng, 100, 150)
        b = a[: rng.randrange(len(a))] + " " + b
        o, h, w = fingerprints.terms([a, b])
        x, y = (dict(zip(h[o == i].tolist(), w[o == i], strict=True)) for i in (0, 1))
        k = x.keys() | y.keys()
        truth = sum(min(x.get(i, 0), y.get(i, 0)) for i in k) / sum(max(x.get(i, 0), y.get(i, 0)) for i in k)
        f = fingerprints.fingerprints([a, b])
        errors.append(fingerprints.likeness(f[:1], f[1:])[0] - truth)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1


def corpus(seed=11):
    """Documents of three sources: toxic ones (a vile word in a sentence), exact copies, near copies, and clean ones."""
    rng = random.Random(seed)
    line = lambda n: " ".join(f"w{rng.randrange(3000)}x" for _ in range(n))
    docs, toxic = [], {}
    for i in range(260):
        bad = i % 3 == 0
        t = f"{line(9)}. {line(4)} {'vilewort nastig' if bad else 'kindword nicer'} {line(4)}. {line(7)}."
        docs.append((i, t, "en", "abc"[i % 7 % 3]))
        toxic[i] = int(bad)
    for k in range(12):  # copies that differ in white space, near copies that differ in one word of forty
        t = line(40)
        w = t.split()
        w[38] = "changed"
        docs += [(1000 + 10 * k, t, "en", "a"), (1001 + 10 * k, t.replace(" ", "  "), "en", "b"), (1002 + 10 * k, " ".join(w), "en", "c")]
    docs += [(2000, None, None, None), (2001, "", "en", "a"), (2002, "one", "en", "b")]
    return docs, toxic


def near_kept(docs):
    """Which of the documents stay when one of each group of near copies does: links by five words and 0.8, the smallest doc_id of a component."""
    grams = {}
    for r in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        grams[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    head = {i: i for i in grams}
    for a in sorted(grams):
        for b in sorted(grams):
            if a < b and grams[a] and 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b]):
                x, y = head[a], head[b]
                head = {k: min(x, y) if v in (x, y) else v for k, v in head.items()}
    return [r for r in docs if head[r[0]] == r[0]]


def test_pipeline(spark, tmp_path):
    """Each stage and run() against plain Python (mixing against SQL), by full rows."""
    docs, toxic = corpus()
    kind = "doc_id long, text string, lang string, source string"
    spark.createDataFrame(docs, kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages, where = dict(corpus_pipeline.STAGES), str(tmp_path)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    order = lambda x: sorted(x, key=str)
    make = lambda x: spark.createDataFrame(x, kind)

    clean = [r for r in docs if not toxic.get(r[0])]
    assert rows(stages["toxicity"](spark, make(docs), where)) == order(clean)
    groups = {}
    for r in clean:
        groups.setdefault("".join((r[1] or "").split()), []).append(r)
    unique = [min(g, key=lambda r: (-len(r[1] or ""), r[0])) for g in groups.values()]
    assert rows(stages["exact dedup"](spark, make(clean), where)) == order(unique) and len(unique) < len(clean)
    far = near_kept(unique)
    assert rows(stages["n-gram Jaccard join"](spark, make(unique), where)) == order(far) and len(far) < len(unique)
    make(far).write.parquet(f"{tmp_path}/far.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/far.parquet/*.parquet'")
    by = {r[0]: r for r in far}
    mixed = [by[i] for (i,) in c.execute(f"SELECT doc_id FROM ({queries.SQL['op10_mixing']})").fetchall()]
    assert rows(stages["mixing"](spark, make(far), where)) == order(mixed) and len(mixed) > len(set(mixed))
    t = Tokenizer.from_file(PATH)
    pieces = []
    for r in mixed:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        pieces += [(r[0], k, at, min(4096, len(ids) - at), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    for out in (stages["packing"](spark, make(mixed), where), corpus_pipeline.run(spark, where)):
        got = out.toPandas()
        assert sorted(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32, strict=True)) == sorted(pieces)
        for _, s in got.groupby("sequence_id"):
            s = s.sort_values("offset")
            assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 4096
        assert got.sequence_id.nunique() == -(-int(got.length.sum()) // 4096)


def test_words_in_use_stay_in_the_cache(monkeypatch):
    """A full cache forgets the words that later batches did not use, holds no more than its bound and a batch, and changes no ids."""
    import sys

    path = tokenizer("word_bpe_49k.json")
    monkeypatch.setattr(packing, "CACHE", 200)
    encode, taught = packing.encoder(path), 0
    halves = [sys.modules["_pulseframe_words"].__dict__[k] for k in (path, path + "/older")]
    for h in halves:
        h.clear()
    want = encode(["the common word"])
    for i in range(40):
        taught += b"common" not in halves[0] and b"common" not in halves[1]
        assert encode([f"the common word {' '.join(f'x{i}y{j}' for j in range(30))}", "the common word"])[1:] == want
        assert sum(map(len, halves)) <= packing.CACHE + 2 * 40
    assert taught == 0


def test_plain_words_go_to_the_merges_alone(monkeypatch):
    """Lower-case words of letters don't go through the whole tokenizer, and get its ids."""
    rng = random.Random(8)
    plain = ["".join(rng.choice("abcdefghijzäßéøłžσςцщїѓ") for _ in range(rng.randrange(1, 15))) for _ in range(3000)]
    odd = ["e\u0301t\xe9", "\u01c6\u01c5", "\u0374a", "\u1e9e", "It's", "\u0130x", "ﬁn", "\u10d0\u1c90", "a\u0345", "\u2126", "x\u02b9"]
    t = Tokenizer.from_file(PATH)
    for x in [" ".join(plain), " ".join(odd), "<|x ÉTÉ Abc", *odd]:
        assert np.frombuffer(packing.encoder(PATH)([x])[0], "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x[:50]
    kept = sys.modules["_pulseframe_words"].__dict__

    class Whole:
        def encode_batch_fast(self, words, add_special_tokens):
            assert not words
            return []

    for k in (PATH, PATH + "/older"):
        monkeypatch.setitem(kept, k, {})
    monkeypatch.setitem(kept, PATH + "/tokenizer", (Whole(), *kept[PATH + "/tokenizer"][1:]))
    packing.encoder(PATH)([" ".join(plain)])


def test_marks_after_a_word_are_read_apart(monkeypatch):
    """Words with any run of marks behind them get the tokenizer's ids, and only the marks go through the whole tokenizer, once for all words."""
    rng = random.Random(10)
    marks = ["".join(rng.choice(packing.MARKS.decode()) for _ in range(rng.randrange(1, 5))) for _ in range(300)] + [".", ",***", "'s", "'", "'re!", "$$$"]
    bases = ["haes", "ré", "слово", "it's", "x-y", "7", "a1", "\u0130", "x\u0130", "e\u0301", "\u0345", "a\u0345", "\u10d0", "½", "٣", "☃", "a☃", "\x01", "don't", "<|endoftext", "<|startoftext|>", "ÀB", "\u01c5", "\u0374", "", "'", "ﬁ"]
    t = Tokenizer.from_file(PATH)
    for base in bases:
        for x in [base + m for m in marks] + [m + base for m in marks[:60]] + [" ".join(base + m for m in marks)]:
            assert np.frombuffer(packing.encoder(PATH)([x])[0], "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x[:50]
    kept = sys.modules["_pulseframe_words"].__dict__
    seen, (whole, *others) = [], kept[PATH + "/tokenizer"]

    class Whole:
        def encode_batch_fast(self, words, add_special_tokens):
            seen.extend(words)
            return whole.encode_batch_fast(words, add_special_tokens=add_special_tokens)

    for k in (PATH, PATH + "/older"):
        monkeypatch.setitem(kept, k, {})
    monkeypatch.setitem(kept, PATH + "/tokenizer", (Whole(), *others))
    packing.encoder(PATH)([" ".join(b + m for b in ("haes", "ré", "слово") for m in ("!!", ".***", "$$$"))])
    assert sorted(seen) == ["!!", "$$$", ".***"]


def test_terms_are_sampled_once_a_worker(monkeypatch):
    rng = random.Random(9)
    texts = [words(rng, rng.randrange(1, 300), 2000) for _ in range(60)] + ["", "one"]
    drawn, plain = [], fingerprints.sample
    monkeypatch.setattr(fingerprints, "sample", lambda h, w: drawn.append(len(h)) or plain(h, w))
    first = fingerprints.fingerprints(texts)
    once = sum(drawn)
    assert (fingerprints.fingerprints(texts) == first).all() and (np.concatenate([fingerprints.fingerprints([t]) for t in texts]) == first).all()
    assert sum(drawn) - once < once / 2
    monkeypatch.setattr(fingerprints, "known", fingerprints.drawn)
    monkeypatch.setattr(fingerprints, "BLOCK", 7)
    assert (fingerprints.fingerprints(texts) == first).all()
