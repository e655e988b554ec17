"""Licence scans, centroid clustering and periodic runs against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from tests.llm.helpers import frame, rows

from pulseframe.llm import centroids, licenses, periodic


# licences


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    hits = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


TEXTS = [
    None, "", " .\n", "CC BY", "cc-by", "ccby cc by\n\nCC  (BY) x", "cc cc by by", "GNU General Public\n License, all rights -- RESERVED.", "generäl public license", "all rights reserveda", "é all rights reserved é",
    "all rights reserved " * 400, "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0", "x\x00all\x7frights{reserved", "Ⅷ cc by ſ K", "MIT License. CC BY-NC-SA 4.0, ALL RIGHTS RESERVED",
]


def test_base_of_licences(spark):
    rng = random.Random(4)
    pool = "cc by general public license all rights reserved mit é , - . \n CC By spdx".split(" ")
    texts = TEXTS + [" ".join(rng.choices(pool, k=rng.randrange(60))) for _ in range(300)]
    data = [(i, t, None, None, "n", "r", "s") for i, t in enumerate(texts)] + rows() + rows()[:2]
    got = licenses.digest(licenses.scan_licenses(frame(spark, data))).collect()
    want = sorted([(r[0], *plain_base(r[1])) for r in data], key=str)
    assert sorted([tuple(r)[:6] for r in got], key=str) == want
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licenses.scan_licenses(frame(spark, [])).count() == 0


def test_places_of_licences():
    text = "Ünder the\tMIT  License:\n# SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 OR Apache-2.0 */\nlicense = \"BSD-3-Clause\"\nlicense: see below"
    _, found = licenses.scan(text.encode())
    assert [(text[x["start"] : x["end"]], x["kind"], x["labels"]) for x in found] == [
        ("MIT  License", "notice", ["mit"]), ("GPL-2.0-or-later WITH Classpath-exception-2.0 OR Apache-2.0", "expression", ["apache"]), ("BSD-3-Clause", "expression", ["bsd"]),
    ]
    assert [x["word"] for x in found] == [2, 4, 21]


def test_expressions():
    """Random expressions, evaluated by Python's own parser."""

    class Value:
        def __init__(self, r, names):
            self.r, self.names = r, frozenset(names)

        def __or__(self, o):
            return o if o.r < self.r else self

        def __and__(self, o):
            return Value(max(self.r, o.r), self.names | o.names)

    rng = random.Random(5)
    known = ["MIT", "GPL-3.0", "Apache-2.0", "LGPL-2.1+", "CC-BY-NC-4.0", "CC0-1.0"]

    def make(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(known)
        return f"{'(' if (b := rng.random() < 0.5) else ''}{make(depth - 1)} {rng.choice(['AND', 'or'])} {make(depth - 1)}{')' if b else ''}"

    for _ in range(500):
        e = make(4)
        tokens = re.findall(r"[()]|[^\s()]+", e)
        py = " ".join({"and": "&", "or": "|"}.get(t.lower(), t if t in "()" else f"V[{t!r}]") for t in tokens)
        want = eval(py, {"V": {k: Value(licenses.RESTRICTION[x := licenses.label_of(k)], [x]) for k in known}})  # noqa: S307
        assert licenses.evaluate(tokens) == (want.r, want.names, len(tokens)), e
    deep = ["("] * 50_000 + ["MIT"] + [")"] * 50_000
    assert licenses.evaluate(deep)[1:] == ({"mit"}, 100_001)
    assert licenses.scan(b"spdx license identifier " * 50_000)[1] == []
    for text, want in {"": None, "and MIT": None, "foo": None, "( MIT": None, ") MIT": None, "MIT OR": ({"mit"}, 1), "MIT see": ({"mit"}, 1), "MIT )": ({"mit"}, 1), "( MIT OR GPL-2.0 ) AND ISC x": ({"mit", "isc"}, 7),
                       "GPL-2.0 with Classpath-exception-2.0": ({"gpl-with-classpath-exception-2.0"}, 3), "( GPL-2.0 ) WITH x": ({"gpl"}, 3), "LicenseRef-own": ({"proprietary"}, 1), "GPL-2.0 WITH": ({"gpl"}, 1)}.items():
        got = licenses.evaluate(text.split())
        assert (got and (set(got[1]), got[2])) == want, text


# clusters


def plain_lloyd(data, k, rounds):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in data if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    got = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    sums = {j: sum(d for _, o, d in got if o == j) for j in range(len(c))}
    return sorted([(i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in got], key=str)


def vectors(n, seed=1):
    rng = np.random.default_rng(seed)
    out = [(i, rng.normal(size=64).round(2).tolist()) for i in range(n)]
    out += [(1000 + i, out[0][1]) for i in range(30)] + [(5, out[5][1]), (None, out[7][1]), (5, out[6][1])]
    bad = list(out[0][1])
    return out + [(2000, None), (2001, bad[:63]), (2002, bad + [1.0]), (2003, bad[:63] + [None]), (2004, bad[:63] + [float("nan")]), (2005, bad[:63] + [float("-inf")]), (2006, [])]


@pytest.mark.parametrize(("n", "parts"), [(150, 7), (12, 1), (0, 2)])
def test_clusters(spark, n, parts):
    data = vectors(n) if n else vectors(10)[-7:]
    df = spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id long, embedding array<double>, cluster int").repartition(parts)
    assigned, c = centroids.cluster(df)
    got = sorted((tuple(r) for r in centroids.with_inertia(assigned, c).collect()), key=str)
    assert got == plain_lloyd(data, 40, 5)
    assert centroids.cluster(df.limit(0))[0].count() == 0


def test_clusters_of_huge_values(spark):
    df = spark.createDataFrame([(i, [x] * 64) for i, x in enumerate([1e308, -1e308, 1e5, 0.0])], "vec_id long, embedding array<double>")
    got = centroids.with_inertia(*centroids.cluster(df, clusters=1)).collect()
    assert all(0 <= r["distance"] <= r["cluster_inertia"] <= 2**63 - 1 for r in got) and len(got) == 4


# periodic runs


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s = words[i : j + q]
            if len(s) >= max(24, 3 * q) and not any(all(s[k] == s[k + p] for k in range(len(s) - p)) for p in range(1, q)):
                out.append((i, len(s), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else None
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(found), *tail, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_runs_of_words():
    rng = random.Random(2)
    for trial in range(400):
        alphabet = "abcdefg"[: rng.randrange(1, 7)]
        words = []
        while len(words) < 150:
            part = rng.choices(alphabet, k=rng.randrange(1, 30))
            words += (part * rng.randrange(1, 6))[: rng.randrange(1, 120)]
        words = [w.encode() for w in words[: rng.randrange(20, 150)]]
        assert periodic.runs(periodic.word_ids(words)) == plain_runs(words), trial
    fib = ["a", "ab"]
    while len(fib[-1]) < 800:
        fib.append(fib[-1] + fib[-2])
    for text in (fib[-1], "a" * 300, "ab" * 200 + "c" + "ab" * 100, "".join("ab"[bin(i).count("1") % 2] for i in range(512))):
        words = [c.encode() for c in text]
        assert periodic.runs(periodic.word_ids(words)) == plain_runs(words)


def test_runs_of_documents(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(6)}" for _ in range(rng.randrange(0, 120))) for _ in range(150)]
    texts += [None, "", "x", "a\x1cb c d e \x85 f", " \t".join(["Ä", "b"] * 30), "a " * 23, "a " * 24, "a b " * 12, "漢字 \r\n" * 40]
    data = [(i, t, None, None, "n", "r", "s") for i, t in enumerate(texts)] + [(None, "a " * 50, None, None, None, None, None), (3, texts[3], "x", "y", "z", "z", "z")]
    data += [r for r in rows() if len(r[1] or "") < 5000]
    got = periodic.digest(periodic.periodic_runs(periodic.with_cycles(frame(spark, data)))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain_row(r[0], r[1]) for r in data), key=str)
    assert periodic.periodic_runs(frame(spark, [])).count() == 0


def test_runs_of_a_very_long_text():
    """200,000 words with planted runs, found by place; the rest has none."""
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 5000, 200_000)
    planted = [(1000, 90, 7), (50_000, 36_000, 9_001), (150_000, 24, 1)]
    for s, m, q in planted:
        ids[s : s + m] = np.resize(np.arange(q) + 10_000 + s, m)
    assert periodic.runs(ids) == planted
    words = [str(i).encode() for i in ids.tolist()]
    left = periodic.collapsed(words, planted).split()
    gone = set(itertools.chain.from_iterable(range(s + q, s + m) for s, m, q in planted))
    assert left == [w for i, w in enumerate(words) if i not in gone]
