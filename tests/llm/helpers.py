"""Small tables that hold the odd cases."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n string, row string, run string"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}x" for _ in range(n))


def rows(seed=3):
    """Nulls in every column, empty and very long texts, exact and near copies, repeated rows, clashing column names."""
    rng = random.Random(seed)
    base = words(rng, 120, 5000)
    near = base.split()
    near[5] = "changed"
    out = [
        (1, base, "en", "a", "x", "y", "z"), (2, base + " ", "en", "a", None, None, None), (3, " ".join(near), "en", "b", "x", "y", "z"),
        (4, None, None, None, None, None, None), (5, "", "de", "b", "x", "y", "z"), (6, " \t\n", "de", "b", "x", "y", "z"),
        (7, "One two", "en", "a", "x", "y", "z"), (8, "one TWO", "en", "c", "x", "y", "z"), (9, "word", "en", None, "x", "y", "z"),
        (10, words(rng, 30_000), "en", "c", "x", "y", "z"), (11, "Ä é 漢字 \U0001f600 " * 20, "fr", "a", "x", "y", "z"),
        (12, base.upper(), "en", "a", "x", "y", "z"), (1, base, "en", "a", "x", "y", "z"), (None, words(rng, 60), "en", "a", "x", "y", "z"),
    ]
    return out + [(20 + i, words(rng, rng.randrange(1, 200)), "en", rng.choice("ab"), "x", "y", "z") for i in range(40)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
