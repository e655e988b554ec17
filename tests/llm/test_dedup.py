import itertools
import os
import random
import re

import numpy as np

from pulseframe.functions.graph import components
from pulseframe.functions.shared import shared_dir
from pulseframe.llm import exact, njoin, substrings
from tests.llm.helpers import frame, rows, words


def plain(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


def test_exact_dedup(spark):
    got = exact.exact_dedup(frame(spark)).collect()
    data = rows()
    assert len(got) == len(data)
    groups = {}
    for r in data:
        groups.setdefault(plain(r[1]), []).append(r)
    for key, rs in groups.items():
        best = min(rs, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        ids = {r[0] for r in rs}
        mine = [g for g in got if g.doc_id in ids]
        assert all(g.keep_id == best[0] and g.group_size == len(rs) for g in mine), key[:30]
        assert sum(g.kept for g in mine) == 1
    assert all(g.n_chars == len({r[0]: r[1] for r in data}[g.doc_id] or "") for g in got)
    out = exact.drop_copies(frame(spark))
    assert out.count() == len(groups) and out.columns == frame(spark).columns
    assert exact.exact_dedup(frame(spark, [])).count() == 0


def test_ties_do_not_depend_on_partitions(spark):
    """Rows that share doc_id and text but not their other columns; and a row that repeats."""
    text = "same text " * 3
    data = [(7, text, "en", f"s{i}", "x", "y", "z") for i in range(9)] + [(8, text + "  ", "en", "s", "x", "y", "z")] * 40 + [(9, f"t{i % 5}", "en", f"s{i % 3}", "x", "y", "z") for i in range(90)]
    one = [sorted(map(tuple, exact.drop_copies(frame(spark, data).repartition(n)).collect()), key=str) for n in (1, 3, 7)]
    assert one[0] == one[1] == one[2] and len(one[0]) == 6


def sets(data, n):
    out = {}
    for r in data:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        out[r[0]] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    return out


def family(seed):
    """Near copies at all distances, in groups large enough for frequent classes and many blocks."""
    rng = random.Random(seed)
    out, k = [], 0
    for size, length in ((60, 40), (40, 150), (12, 12), (5, 400)):
        base = words(rng, length, 100_000).split()
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            out.append((k, " ".join(w), None, None, None, None, None))
            k += 1
    return out


def brute(data, n, percent):
    s = sets(data, n)
    parent, links = {i: i for i in s}, dict.fromkeys(s, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations([i for i in s if i is not None], 2):
        both = len(s[a] & s[b])
        if both and 100 * both >= percent * len(s[a] | s[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
            links[a] += 1
            links[b] += 1
    return {i: (len(s[i]), find(i) if i is not None else None, links[i]) for i in s}


def test_near_groups(spark, monkeypatch):
    repeated = sum(r[0] == 1 for r in rows()) - 1
    for data, n, percent, team, block in ((rows(), 3, 90, 64, 1024), (family(1), 3, 90, 16, 20), (family(2), 5, 80, 64, 1024)):
        monkeypatch.setattr(njoin, "TEAM", team)
        monkeypatch.setattr(njoin, "TEAM_BLOCK", block)
        got = njoin.near_groups(frame(spark, data), n, percent, count=True).collect()
        want = brute(data, n, percent)
        assert len(got) == len(data)
        for g in got:
            size, component, links = want[g.doc_id]
            if data[0] == rows()[0]:  # the row that repeats is one link more for each row of its group
                links += repeated * (component == 1)
            assert (g.n_shingles, g.component_id, g.n_links) == (size, component, links), g.doc_id
    assert njoin.near_groups(frame(spark, [])).count() == 0
    assert njoin.near_groups(frame(spark, []), count=True).count() == 0


def test_overlaps():
    rng = np.random.default_rng(3)
    a, b = ([np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(k)] for k in (9, 13))
    assert (njoin.overlaps(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()
    assert njoin.overlaps([], b).shape == (0, 13)


def test_signatures_never_miss(monkeypatch):
    rng = np.random.default_rng(5)
    for often in [(2, 6), (2, 4, 6, 8), (1, 1, 1, 5), njoin.OFTEN] * 100:
        monkeypatch.setattr(njoin, "OFTEN", often)
        n = int(rng.integers(9, 300))
        percent = int(rng.choice([80, 90]))
        a = np.unique(rng.integers(1, 2**62, n).astype(np.uint64))
        cut = int(rng.integers(0, njoin.slack(len(a), percent) + 1))
        b = a[rng.permutation(len(a))[: len(a) - cut]]
        if 100 * len(b) < percent * len(a):
            continue
        df = {int(x): int(rng.integers(2, 12)) for x in a}
        sig = [njoin.signatures(len(s), s[np.isin(s, b)], np.array([df[int(x)] for x in s[np.isin(s, b)]]), percent) for s in (a, np.sort(b))]
        assert len(np.intersect1d(*sig)), (n, percent, cut)


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 3), (9, 8), (8, 10), (10, 11), (11, 1)], "a long, b long")
    assert {r.node: r.component for r in components(e).collect()} == {5: 3, 4: 3, 3: 3, 9: 1, 8: 1, 10: 1, 11: 1, 1: 1}


def test_repeats(spark):
    rng = random.Random(8)
    passage = words(rng, 60, 10**6)
    data = [(i, words(rng, 150, 10**6), None, None, None, None, None) for i in range(60)]
    hosts = {3, 17, 40, 41}
    for i in hosts:
        t = data[i][1].split()
        at = rng.randrange(len(t))
        data[i] = (i, " ".join(t[:at]) + " " + passage + " " + " ".join(t[at:]), *data[i][2:])
    within = words(rng, 60, 10**6)
    data.append((99, within + " and " + within, None, None, None, None, None))
    data += [(None, passage, None, None, None, None, None), (100, None, None, None, None, None, None), (101, "", None, None, None, None, None)]
    got = substrings.repeats(frame(spark, data)).collect()
    assert {g.doc_id for g in got} == hosts
    texts = {r[0]: r[1] for r in data}
    for g in got:
        assert texts[g.doc_id][g.span_start : g.span_end] in passage and g.first_doc_id == 3
        assert (g.removed_chars == 0) == (g.doc_id == 3)
    assert substrings.repeats(frame(spark, [])).count() == 0
    assert substrings.repeats(frame(spark)).filter("doc_id in (1, 2, 3)").count() >= 3


def test_repeats_finds_passages_of_51_words(spark):
    """Passages of 51 words of about four letters, planted at other places in two documents each."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([3, 4, 4, 5])))
    line = lambda n: " ".join(word() for _ in range(n))
    data = []
    for i in range(600):
        passage = line(51)
        for k in (0, 1):
            data.append((2 * i + k, f"{line(rng.randrange(5, 60))} {passage} {line(rng.randrange(5, 60))}", None, None, None, None, None))
    got = {g.doc_id for g in substrings.repeats(frame(spark, data)).collect()}
    missed = sum(2 * i not in got or 2 * i + 1 not in got for i in range(600))
    assert missed <= 6, missed


def test_repeats_against_chunks_written_out(spark):
    """Chunks, shared digests and runs by plain Python, from the rule in words."""
    rng = random.Random(21)
    passages = [words(rng, n, 10**6) for n in (60, 30, 90)]
    data = [(i, f"{words(rng, rng.randrange(5, 60), 10**6)} {rng.choice(passages)} {words(rng, 20, 10**6)}", *[None] * 5) for i in range(30)]

    def split(text):
        cp = np.array([ord(c) for c in text], np.uint32)
        value = [int(v) >> 48 for v in njoin.mix(cp.astype(np.uint64) + njoin.BASE)]
        ends, last = [], None
        for i in range(substrings.WINDOW - 1, len(cp)):
            h = 0
            for k in range(i - substrings.WINDOW + 1, i + 1):
                h = (2 * h + value[k]) % 65536
            if h < 65536 // substrings.MEAN:
                if last is None or i - last >= substrings.APART:
                    ends.append(i + 1)
                last = i
        ends = sorted({*ends, len(cp)})
        return [(a, text[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    parts = {r[0]: split(r[1]) for r in data}
    owners = {}
    for i, cs in parts.items():
        for _, c in cs:
            owners.setdefault(c, set()).add(i)
    want = []
    for i, cs in parts.items():
        run = []
        for a, c in [*cs, (0, None)]:
            if c is not None and len(owners[c]) > 1:
                run.append((a, c))
            elif run:
                start, end = run[0][0], run[-1][0] + len(run[-1][1])
                text = dict((r[0], r[1]) for r in data)[i]
                begun = sum(text[p] != " " and (p == 0 or text[p - 1] == " ") for p in range(start, end))
                if begun >= substrings.LEAST or end - start >= substrings.LONG:
                    want.append((i, start, end, len(run), begun, min(min(owners[c]) for _, c in run), sum(len(c) for _, c in run if min(owners[c]) < i)))
                run = []
    got = [(g.doc_id, g.span_start, g.span_end, g.n_chunks, g.n_words, g.first_doc_id, g.removed_chars) for g in substrings.repeats(frame(spark, data)).collect()]
    assert sorted(got) == sorted(want) and len(want) >= 20


def test_passages_of_one_word(spark):
    """A chunk may have more words than 16 bits count."""
    got = substrings.repeats(spark.createDataFrame([(i, "ab " * 40_000) for i in (1, 2)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_words, r.span_start, r.span_end) for r in got] == [(1, 40_000, 0, 120_000), (2, 40_000, 0, 120_000)]


def test_drop_copies_writes_no_texts(spark):
    """Of wholly equal rows one stays, of copies the smallest doc_id; what is written between is ids and digests."""
    rng = random.Random(6)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(8000)) for _ in range(40)]
    data = [(i, texts[i % 40], None if i % 3 else "en", "en" if i % 3 else None, "x", "y", "z") for i in range(100)]
    data += [data[7]] * 3 + [(None, texts[3], "en", "a", "x", "y", "z")] * 2 + [(200 + i, t, "en", "a", "x", "y", "z") for i, t in enumerate([None, "", " "])]
    top = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    got = sorted(tuple(r) for r in exact.drop_copies(frame(spark, data).repartition(5)).collect())
    assert got == sorted([*data[:40], (202, " ", "en", "a", "x", "y", "z")])
    new = [os.path.join(d, f) for x in set(os.listdir(top)) - before for d, _, fs in os.walk(os.path.join(top, x)) for f in fs]
    assert new and sum(map(os.path.getsize, new)) < sum(len(t.encode()) for t in texts) / 2
