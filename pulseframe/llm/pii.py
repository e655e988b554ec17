"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust the score
(DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds in their order. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]

#: One pattern a kind. Possessive quantifiers and the look-behinds change no match; they keep a long run
#: of letters or digits from being scanned again from each of its places.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_])(?:[0-9a-f]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9_])",
}
#: A text without a match of this can hold no span of the kind.
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+", "iban": "[0-9]", "ssn": "[0-9]", "secret": "[0-9a-f]{32}|AKIA|gh[pousr]_"}
#: Words that raise the score of a span when they stand within CONTEXT characters before or after it.
WORDS = {
    "email": ["mail", "contact", "write to"],
    "ip": ["ip", "server", "host", "address"],
    "card": ["card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"],
    "phone": ["phone", "tel", "call", "mobile", "fax"],
    "iban": ["iban", "account", "bank", "konto", "compte", "cuenta"],
    "ssn": ["ssn", "social security"],
    "secret": ["token", "key", "secret", "password", "passwd", "credential", "auth"],
}
#: A span's score before context; context adds BONUS, up to 1.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.95, "ssn": 0.4, "secret": 0.4}
BONUS, CONTEXT, LEAST = 0.3, 40, 0.6
#: Spans whose lengths are summed at once: place sums stay linear in a text's spans.
BLOCK = 256


def _let(value: Column, use) -> Column:
    """use(value), with value computed once: it is bound to a lambda's variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def _last(text: Column) -> Column:
    """The last CONTEXT characters."""
    return F.substring(text, F.greatest(F.lit(1), F.length(text) - CONTEXT + 1), F.lit(CONTEXT))


def _first(text: Column) -> Column:
    """The first CONTEXT characters."""
    return F.substring(text, 1, CONTEXT)


def _before(steps: Column) -> Column:
    """For each place in an array of lengths, the sum of those before it."""

    def with_blocks(sums: Column) -> Column:
        def with_offsets(offsets: Column) -> Column:
            def at(_: Column, i: Column) -> Column:
                block = F.floor(i / F.lit(BLOCK)).cast("int")
                return F.get(offsets, block) + _sum(F.slice(steps, block * BLOCK + 1, i - block * BLOCK))

            return F.transform(steps, at)

        return _let(F.transform(sums, lambda _, b: _sum(F.slice(sums, F.lit(1), b))), with_offsets)

    blocks = F.sequence(F.lit(0), F.floor(F.size(steps) / F.lit(BLOCK)).cast("int"))
    return _let(F.transform(blocks, lambda b: _sum(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))), with_blocks)


def _luhn(digits: Column) -> Column:
    """True if text of digits passes the Luhn check."""
    n = F.length(digits)
    places = F.sequence(F.lit(0), n - 1)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0)).cast("long")

    return (n > 0) & (_sum(F.transform(places, worth)) % 10 == 0)


def _mod97(compact: Column) -> Column:
    """True if an account number's check digits hold: moved to the end, letters as 10 to 35, the rest by 97 is 1."""
    moved = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))
    chars = F.transform(F.sequence(F.lit(1), F.length(moved)), lambda i: F.substring(moved, i, F.lit(1)))

    def step(acc: Column, c: Column) -> Column:
        v = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55).cast("long")
        return F.when(v > 9, (acc * 100 + v) % 97).otherwise((acc * 10 + v) % 97)

    return F.aggregate(chars, F.lit(0).cast("long"), step) == 1


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return hit.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind in ("card", "phone"):
        digits = F.regexp_replace(hit, "[^0-9]", "")
        if kind == "card":
            return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return _let(F.translate(hit, " ", ""), lambda c: F.when(F.length(c).between(15, 34), _mod97(c)).otherwise(False))
    if kind == "ssn":
        return ~hit.rlike("^(?:000|666|9)") & ~hit.rlike("-00-|-0000$")
    return F.lit(True)


def _of_kind(kind: str, text: Column) -> Column:
    """The kind's valid spans: structs of kind, start, end, score. The pieces between matches give the places."""
    regex = F.lit(PATTERNS[kind])
    none = F.array().cast("array<string>")
    # two looks at the text are made only where there is a match at all
    there = text.rlike(NEEDS[kind])
    hits = F.when(there, F.regexp_extract_all(text, regex, F.lit(0))).otherwise(none)
    words = "|".join(WORDS[kind])

    def placed(hits: Column) -> Column:
        def with_pieces(pieces: Column) -> Column:
            steps = F.zip_with(pieces, hits, lambda p, h: F.length(p).cast("long") + F.coalesce(F.length(h), F.lit(0)))

            def with_starts(before: Column) -> Column:
                def with_sides(sides: Column) -> Column:
                    def near(i: Column) -> Column:
                        # a match has two characters at least, so this many pieces and matches hold each window
                        earlier = F.array_join(F.slice(sides["tails"], F.greatest(F.lit(1), i + 1 - CONTEXT // 2), F.least(i, F.lit(CONTEXT // 2))), "")
                        later = F.array_join(F.slice(sides["heads"], i + 2, F.lit(CONTEXT // 2)), "")
                        # a line end keeps words of the two sides apart
                        return F.lower(F.concat(_last(F.concat(earlier, _last(F.get(pieces, i)))), F.lit("\n"), _first(later)))

                    def span(hit: Column, i: Column) -> Column:
                        start = F.get(before, i) + F.length(F.get(pieces, i))

                        def checked(ok: Column) -> Column:
                            score = F.lit(SCORES[kind]) + F.when(ok & near(i).rlike(rf"(?:^|[^a-z])(?:{words})"), BONUS).otherwise(0.0)
                            return F.struct(
                                F.lit(kind).alias("kind"),
                                start.alias("start"),
                                (start + F.length(hit)).alias("end"),
                                F.least(F.round(score, 2), F.lit(1.0)).alias("score"),
                                ok.alias("ok"),
                            )

                        return _let(_valid(kind, hit), checked)

                    return F.filter(F.transform(hits, span), lambda s: s["ok"])

                tails = F.zip_with(pieces, hits, lambda p, h: _last(F.concat(_last(p), F.coalesce(_last(h), F.lit("")))))
                heads = F.zip_with(pieces, hits, lambda p, h: _first(F.concat(_first(p), F.coalesce(_first(h), F.lit("")))))
                return _let(F.struct(tails.alias("tails"), heads.alias("heads")), with_sides)

            return _let(steps, lambda lengths: _let(_before(lengths), with_starts))

        return F.when(F.size(hits) > 0, _let(F.split(text, PATTERNS[kind], -1), with_pieces)).otherwise(F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double,ok:boolean>>"))

    return _let(hits, placed)


def find_pii(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of df: doc_id and spans, an array of (kind, start, end, score, base) by kind as in KINDS, then start.

    Places count code points, ends are exclusive. Within a kind, matches are the leftmost that do not overlap; a match that
    fails its kind's check is dropped and not tried again shorter. Spans of the base kinds (email, ip, card, phone) are
    always returned and only get a score; a span of an added kind (iban, ssn, secret) is returned when its score, raised
    by context words in the CONTEXT characters before or after it, is LEAST or more. A null or empty text has no spans; rows
    are independent, so ties and repeated rows each give their own; an empty table gives no rows. Only the two named
    columns are read.
    """
    d = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    kinds = [_of_kind(k, F.col("_t")) for k in KINDS]
    # a generator's column is computed once, however often it is used below
    found = d.select("doc_id", F.explode(F.array(F.struct(F.flatten(F.array(*kinds)).alias("all")))).alias("_s"))
    keep = F.filter(F.col("_s.all"), lambda s: s["kind"].isin(*BASE) | (s["score"] >= LEAST))
    return found.select(
        "doc_id",
        F.transform(keep, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), s["kind"].isin(*BASE).alias("base"))).alias("spans"),
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of find_pii's rows."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[of(k) for k in BASE],
        F.sha2(joined(F.filter("spans", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
