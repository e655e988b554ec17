"""Licence statements in texts: an Aho-Corasick automaton finds tags and notices, a shunting-yard parser evaluates the expressions after tags."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import small_batches
from pulseframe.llm.text import remembered

#: The contract's phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further phrases of notices, by words, and their labels.
NOTICES = {
    "affero general public license": "agpl", "apache license": "apache", "apache software license": "apache", "artistic license": "artistic", "boost software license": "bsl", "bsd license": "bsd",
    "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by sa": "cc-by-sa", "cc by nc nd": "cc-by-nc-nd", "cc by nc sa": "cc-by-nc-sa", "cc0": "cc0", "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution sharealike": "cc-by-sa", "creative commons zero": "cc0", "eclipse public license": "epl", "isc license": "isc",
    "lesser general public license": "lgpl", "mit license": "mit", "mozilla public license": "mpl", "no derivatives": "cc-by-nd", "open font license": "ofl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit", "proprietary and confidential": "proprietary", "public domain": "public-domain",
    "python software foundation license": "psf", "redistribution and use in source and binary forms": "bsd", "released under gpl": "gpl", "the unlicense": "unlicense", "zlib license": "zlib",
}
#: Phrases after which a licence expression may stand, and whether a colon or equals sign must follow.
TAGS = {"spdx license identifier": False, "license": True, "licence": True, "license expression": True, "licenses": True}
#: How far each licence restricts use, 0 to 1: dedications, permissive, weak and strong copyleft, non-commercial or no derivatives, no licence at all.
RESTRICTION = {
    "0bsd": 0.1, "agpl": 0.75, "apache": 0.25, "artistic": 0.25, "bsd": 0.25, "bsl": 0.25, "cc-by": 0.25, "cc-by-nc": 0.9, "cc-by-nc-nd": 0.9, "cc-by-nc-sa": 0.9, "cc-by-nd": 0.9, "cc-by-sa": 0.5, "cc0": 0.1,
    "epl": 0.5, "gpl": 0.75, "isc": 0.25, "lgpl": 0.5, "mit": 0.25, "mpl": 0.5, "ofl": 0.25, "proprietary": 1.0, "psf": 0.25, "public-domain": 0.1, "reserved": 1.0, "unlicense": 0.1, "wtfpl": 0.1, "zlib": 0.25,
}
#: An exception lowers what it is granted from to weak copyleft at most.
WITH_EXCEPTION = 0.5
#: What an expression is made of: brackets, and identifiers with an optional plus.
TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.-]*\+?)")
AFTER_TAG = re.compile(rb"[\"']?[ \t]*([:=]?)[ \t]*[\"']?")
#: How tightly operators bind.
BINDS = {"or": 1, "and": 2, "with": 3}

_FLAT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def label_of(identifier: str) -> str | None:
    """The label of a licence identifier: the longest known name that it begins with, before a hyphen, a plus or its end; names of one's own
    (licenseref-...) count as proprietary. None if unknown."""
    name = identifier.lower().rstrip("+")
    if name.startswith("licenseref-"):
        return "proprietary"
    parts = name.split("-")
    return next((known for k in range(len(parts), 0, -1) if (known := "-".join(parts[:k])) in RESTRICTION), None)


def evaluate(tokens: Iterable[str]) -> tuple[float, frozenset[str], int] | None:
    """(restriction, labels, tokens used) of the longest expression that tokens begin with; None if there is none.

    Shunting-yard with the operators with, and, or (in falling order of strength) and brackets. or takes its less restrictive side (the left one if equal), and
    joins both sides and restricts as the stricter one, with names an exception. A token that can't follow ends the expression, and none is read after it; so does
    an unknown identifier. An operator left open at its end is left out; an expression needs all its brackets."""
    best, values, ops, operand, brackets, last = None, [], [], True, 0, ""

    def apply(values: list, op: str) -> None:
        right = values.pop()
        left = values.pop()
        if op == "with":
            values.append((min(left[0], WITH_EXCEPTION), frozenset(f"{x}-with-{right}" for x in left[1])))
        elif op == "and":
            values.append((max(left[0], right[0]), left[1] | right[1]))
        else:
            values.append(right if right[0] < left[0] else left)

    for k, token in enumerate(tokens):
        word, before, last = token.lower(), last, token
        if operand and word == "(" and ops[-1:] != ["with"]:
            ops.append("(")
            brackets += 1
            continue
        if operand:
            if word in BINDS or word in ("(", ")"):
                break
            if ops and ops[-1] == "with":
                values.append(word)
                apply(values, ops.pop())
            elif label := label_of(word):
                values.append((RESTRICTION[label], frozenset([label])))
            else:
                break
            operand = False
        elif word == ")" and brackets:
            while ops[-1] != "(":
                apply(values, ops.pop())
            ops.pop()
            brackets -= 1
        elif word in BINDS and not (word == "with" and before == ")"):  # an exception belongs to one licence
            while ops and ops[-1] != "(" and BINDS[ops[-1]] >= BINDS[word]:
                apply(values, ops.pop())
            ops.append(word)
            operand = True
            continue
        else:
            break
        if not brackets:  # complete up to here
            rest = list(values)
            for op in reversed(ops):
                apply(rest, op)
            best = (*rest[0], k + 1)
    return best


def automaton() -> ahocorasick.Automaton:
    """All phrases between blanks; each with its words, kind (base, notice or tag) and label."""
    a = ahocorasick.Automaton()
    of: dict[str, list] = {}
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", TAGS)):
        for phrase, label in phrases.items():
            of.setdefault(phrase, []).append((phrase.count(" ") + 1, kind, label))
    for phrase, meanings in of.items():
        a.add_word(f" {phrase} ", meanings)
    a.make_automaton()
    return a


def tokens(raw: bytes, at: int, stop: int, places: list[tuple[int, int]]) -> Iterator[str]:
    """The tokens from `at`, one by one; their places are added to `places`."""
    while t := TOKEN.match(raw, at, stop):
        places.append(t.span(1))
        at = t.end()
        yield t.group(1).decode()


def scan(raw: bytes) -> tuple[int, list[dict]]:
    """Number of words of a text (UTF-8), and what was found: start, end (code points), word, kind, labels, restriction, by place."""
    flat = raw.translate(_FLAT)  # letters lowered, all that parts words blank; as long as raw
    line = re.sub(rb"  +", b" ", flat).strip()
    if not line:
        return 0, []
    text = f" {line.decode('latin-1')} "
    hits, words, before = [], 0, 0
    for end, meanings in remembered("licences", automaton).iter(text):
        words += text.count(" ", before, end)  # words that end before this blank
        before = end
        hits += [(words - n, words, kind, label) for n, kind, label in meanings]
    n_words = text.count(" ") - 1
    if not hits:
        return n_words, []
    inside = np.frombuffer(flat, np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    points = np.append(0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))
    out = []
    for first, last, kind, label in hits:
        a, b = int(starts[first]), int(ends[last - 1])
        if kind == "tag":
            m = AFTER_TAG.match(raw, b)
            if label and not m.group(1):
                continue
            stop = raw.find(b"\n", m.end())
            places: list[tuple[int, int]] = []
            value = evaluate(tokens(raw, m.end(), len(raw) if stop < 0 else stop, places))
            if not value:
                continue
            restriction, labels, used = value
            a, b = places[0][0], places[used - 1][1]
            out.append({"start": int(points[a]), "end": int(points[b]), "word": first, "kind": "expression", "labels": sorted(labels), "restriction": restriction})
        else:
            out.append({"start": int(points[a]), "end": int(points[b]), "word": first, "kind": kind, "labels": [label], "restriction": RESTRICTION[label]})
    return n_words, sorted(out, key=lambda x: (x["start"], x["end"], x["kind"]))


def scan_licenses(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of df: doc_id, n_words, found and score.

    found lists every place of a notice (kind base or notice) and every licence expression after a tag (kind expression), with start and end in code points, the
    first word (of the phrase or the tag), labels and restriction. score is the greatest restriction found (0 without any): from 0.1 for dedications to 1
    for reserved rights. Words are runs of letters and digits after A-Z is lowered, other scripts count as letters; a phrase matches whole
    words, whatever stands between them. An expression stands on the tag's line. Whole texts are read; a null text is empty: no words, nothing found.
    Repeated rows each give a row, doc_id may be null. Only the two columns are read.
    """
    small_batches(df.sparkSession)
    one = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("word", pa.int64()), ("kind", pa.string()), ("labels", pa.list_(pa.string())), ("restriction", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [scan(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            score = [max((x["restriction"] for x in found), default=0.0) for _, found in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([f for _, f in got], pa.list_(one)), pa.array(score, pa.float64())], ["doc_id", "n_words", "found", "score"])

    d = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = "array<struct<start:long,end:long,word:long,kind:string,labels:array<string>,restriction:double>>"
    return d.mapInArrow(work, f"doc_id long, n_words long, found {kind}, score double")


def digest(found: DataFrame) -> DataFrame:
    """op11's columns from scan_licenses'."""
    base = F.filter("found", lambda x: x["kind"] == "base")
    words = F.transform(base, lambda x: x["word"])
    named = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(xs, lambda x: x["labels"])))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        named(base).alias("base_labels"), named(F.col("found")).alias("labels"), "score",
    )
