"""Jaccard join on word shingles with token-combination prefixes."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.graph import components
from pulseframe.llm.common import cut, drop, small_batches
from pulseframe.llm.text import BASE, mix, word_hashes

#: A token found in more sets than the first figure is combined by two, above the second by three, and so on.
OFTEN = (32, 1024, 32_768, 1_048_576)
#: Sets that are compared in one go, their tokens, and the columns of a product.
BLOCK, BLOCK_TOKENS, COLUMNS = 256, 200_000, 4096
#: Components from this size fill blocks of their own, which needn't be compared with each other to find components; to count links, blocks
#: of so many sets, of so many tokens, are.
TEAM, TEAM_BLOCK, TEAM_TOKENS = 64, 1024, 1_000_000


def shingles(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Each text's set: 64-bit hashes of its runs of `words` words (of all words, if fewer), ascending. A to Z count as a to z."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=at[1:])
    b = np.frombuffer(b"".join(raw).lower(), np.uint8)  # lower() of bytes changes A to Z alone
    first, h = word_hashes(b, (b != 32) & ((b < 9) | (b > 13)), at)
    own = np.searchsorted(at, first, "right") - 1
    bounds = np.searchsorted(own, np.arange(len(raw) + 1))
    run = mix(h + BASE)
    for k in range(1, words):
        run = mix((run[: len(h) - k] if k < len(h) else run[:0]) + h[k:] * np.uint64(2 * k + 1) + BASE)
    out = []
    for i, j in itertools.pairwise(bounds.tolist()):
        n = j - i
        if n >= words:
            out.append(np.unique(run[i : j - words + 1]))
        elif n:
            x = np.array([n], np.uint64)
            for v in h[i:j]:
                x = mix(x + v + BASE)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def slack(n: int, percent: int) -> int:
    """How many tokens of a set of n may be missing from a set that it links with."""
    return n - -(-percent * n // 100)


def signatures(n: int, common: np.ndarray, df: np.ndarray, percent: int) -> np.ndarray:
    """Hashes, one of which a set of n tokens shares with every set that it links with; common: its tokens found elsewhere too, with
    the number of sets that hold them. Nothing, if too few are.

    Tokens are ordered by that number, then value: the n - len(common) tokens of its own come first. The prefix grows until deleting `slack` tokens can't
    destroy all signatures: a class combined by k with m tokens in the prefix takes m - k + 1 deletions. Frequent
    classes are parted by hash into subclasses of a few tokens, more for larger sets, so that combinations stay about as many as tokens; the number of
    subclasses goes by the power of two below the smaller set's size, so a set signs for each that its partner may have."""
    missing = slack(n, percent) + 1 - (n - len(common))
    if missing <= 0:
        return np.zeros(0, np.int64)
    order = np.lexsort((common, df))
    t, k = common[order], 1 + np.searchsorted(OFTEN, df[order], "left")
    out = []
    for size in {int(n).bit_length(), int(max(1, -(-percent * n // 100))).bit_length()}:
        low = 1 << size - 1
        few = slack(low, percent)
        # about four tokens of a prefix fall into a subclass: combinations stay near the number of tokens
        # all tokens together must take `missing` deletions: the subclasses cost k - 1 each, less than the tokens that slack leaves
        parts = np.array([0, 1, *(max(1, x) for x in (min(few // 2, low // 8), min(3 * few // 4, low // 8), min(few, low // 12), min(few, low // 32)))])
        spread = (mix(t + np.uint64(size)) >> np.uint64(33)).astype(np.int64)
        cls = np.where(k == 1, -1, k * (1 << 40) + spread % parts[k])
        # a token counts once its class has k - 1 before it
        rank = np.zeros(len(t), np.int64)
        by = np.argsort(cls, kind="stable")
        starts = np.flatnonzero(np.diff(cls[by], prepend=-2))
        rank[by] = np.arange(len(t)) - np.repeat(starts, np.diff(np.append(starts, len(t))))
        counts = np.cumsum((k == 1) | (rank >= k - 1))
        end = int(np.searchsorted(counts, missing)) + 1
        here, kinds = t[:end], cls[:end]
        out.append(mix(here[kinds == -1]))
        for c in np.unique(kinds[kinds != -1]):
            members = np.sort(here[kinds == c])
            k_c = int(c >> 40)
            if len(members) >= k_c:
                combos = np.array(list(itertools.combinations(range(len(members)), k_c)))
                h = np.full(len(combos), np.uint64(c + size), np.uint64)
                for i in range(k_c):
                    h = mix(h + members[combos[:, i]])
                out.append(h)
    return np.unique(np.concatenate(out)).view(np.int64)


def hits(sets: list[np.ndarray], side: np.ndarray | None, percent: int) -> np.ndarray:
    """Which sets link (upper triangle); with side, between the two sides only. Intersections are products of presence matrices over the shared
    tokens, some columns at a time."""
    n = np.array([len(s) for s in sets], np.int64)
    kinds, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = times > 1
    column = np.cumsum(shared) - 1
    keep = shared[inverse]
    row, col = row[keep], column[inverse[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    inter = np.zeros((len(sets), len(sets)), np.float64)
    for c in range(0, int(shared.sum()), COLUMNS):
        i, j = np.searchsorted(col, (c, c + COLUMNS))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[row[i:j], col[i:j] - c] = 1
        inter += m @ m.T
    union = n[:, None] + n[None, :] - inter
    hit = np.triu((100 * inter >= percent * union) & (union > 0), 1)
    return hit if side is None else hit & (side[:, None] != side[None, :])


def forest(hit: np.ndarray) -> list[tuple[int, int]]:
    """Positions of linked sets, as a spanning forest of the links."""
    parent = list(range(len(hit)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in np.argwhere(hit).tolist():
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[ra] = rb
            out.append((a, b))
    return out


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets of a with sets of b, counted over the tokens found on both sides."""
    (ta, ra), (tb, rb) = ((np.concatenate([*x, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(x)), [len(s) for s in x])) for x in (a, b))
    common = np.intersect1d(ta, tb)
    out = np.zeros(len(a) * len(b), np.int64)
    sides = []
    for t, r in ((ta, ra), (tb, rb)):
        at = np.minimum(np.searchsorted(common, t), max(0, len(common) - 1))
        keep = common[at] == t if len(common) else np.zeros(len(t), bool)
        at, r = at[keep], r[keep]
        order = np.argsort(at, kind="stable")
        sides.append((r[order], np.bincount(at, minlength=len(common))))
    (ra, ca), (rb, cb) = sides
    starts = [np.cumsum(c) - c for c in (ca, cb)]
    ends = np.cumsum(ca * cb)
    first = 0
    while first < len(common):  # some millions of meetings at once
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + 4_000_000)))
        n = (ca * cb)[first:last]
        token = np.repeat(np.arange(first, last), n)
        within = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
        i, j = ra[starts[0][token] + within // cb[token]], rb[starts[1][token] + within % cb[token]]
        out += np.bincount(i * len(b) + j, minlength=len(out))
        first = last
    return out.reshape(len(a), len(b))


def _token_lists(column) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in column]


def _verify(percent: int, count: bool = False):
    """Links of a group of nodes: between its two sides, or among all if it has one side only. With count, also rows (node, node, weight of its links)."""

    def verify(group: pa.Table) -> pa.Table:
        nodes, side = group["node"].to_numpy(), group["side"].to_numpy()
        side = None if side.min() == side.max() else side
        rows = []
        if len(nodes) > 1:
            hit = hits(_token_lists(group["tokens"]), side, percent)
            rows = [(int(nodes[a]), int(nodes[b]), None) for a, b in forest(hit) if nodes[a] != nodes[b]]
            if count:
                w = group["w"].to_numpy()
                degree = hit @ w + w @ hit
                rows += [(int(nodes[i]), int(nodes[i]), int(degree[i])) for i in np.flatnonzero(degree)]
        return pa.table([pa.array([x[i] for x in rows], pa.int64()) for i in range(3)], ["a", "b", "degree"])

    return verify


def _team_degrees(team: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node and degree: the weight of the links between members of one team (node, team). Members are held as their difference from the team's first set, as
    |A and B| = |R| - |R without A| - |R without B| + |(A xor R) and (B xor R)|; blocks of them, a row each, meet in pairs, each pair in a task of its own."""
    first = sets.select(F.col("node").alias("team"), F.col("tokens").alias("base")).groupBy("team").agg(F.max("base").alias("base"))
    m = team.join(first.hint("merge"), "team").join(sets.hint("merge"), "node")
    lost, won = F.array_except("base", "tokens"), F.array_except("tokens", "base")
    m = m.select("team", "node", F.size("tokens").alias("n"), "w", F.size("base").alias("base"), F.size(lost).alias("lost"), F.concat(lost, won).alias("tokens"))
    m = cut(m, "differences")
    parts = m.groupBy("team").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(TEAM_BLOCK)), F.ceil(F.sum(F.size("tokens")) / F.lit(TEAM_TOKENS))).cast("int").alias("parts"))
    m = m.join(parts, "team").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))

    def pack(group: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        kept = group.select(["node", "n", "w", "base", "lost", "tokens"])
        with pa.ipc.new_stream(sink, kept.schema) as out:
            out.write_table(kept)
        return pa.table([group[c][:1] for c in ("team", "part", "parts")] + [pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["team", "part", "parts", "rows"])

    packs = m.groupBy("team", "part").applyInArrow(pack, "team long, part int, parts int, rows binary")
    other = packs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = other.select("team", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "rows")

    def meet(group: pa.Table) -> pa.Table:
        blocks = [pa.ipc.open_stream(r).read_all() for r in group["rows"].to_pylist()]
        a, b = blocks[0], blocks[-1]
        tokens = [_token_lists(t["tokens"]) for t in (a, b)]
        (na, wa, la), (nb, wb, lb) = (tuple(t[c].to_numpy().astype(np.int64) for c in ("n", "w", "lost")) for t in (a, b))
        inter = a["base"][0].as_py() - la[:, None] - lb[None, :] + overlaps(*tokens)
        hit = 100 * inter >= percent * (na[:, None] + nb[None, :] - inter)
        if len(blocks) == 1:
            np.fill_diagonal(hit, False)
            nodes, degree = a["node"].to_numpy(), hit @ wa
        else:
            nodes, degree = np.concatenate([a["node"].to_numpy(), b["node"].to_numpy()]), np.concatenate([hit @ wb, wa @ hit])
        return pa.table([pa.array(nodes), pa.array(degree)], ["node", "degree"])

    return pairs.groupBy("team", "x", "y").applyInArrow(meet, "node long, degree long")


def near_groups(df: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", count: bool = False) -> DataFrame:
    """One row for each row of df: doc_id, n_shingles and component_id, the smallest doc_id reachable by links; with count=True also n_links, the
    number of other rows that it links with.

    Two documents link when 100 * |A and B| >= percent * |A or B| for their sets of `words`-word shingles. A text with fewer words has its whole
    sequence as the one shingle; a null text or one without words has an empty set and links with nothing. Rows that share a doc_id are
    one document that has the links of each; a row without doc_id links with nothing and has no component. An empty table gives no
    rows. Only the two named columns are read. n_links counts links to copies and to different texts alike; where a doc_id has several texts, its rows
    count the links of all of them.

    1. Equal sets become one node, so copies cost nothing further.
    2. Screen: with tokens in hash order, linked sets share k tokens in their first slack + k; nodes that
       don't find k of theirs elsewhere are done. Rows are counted, no pairs are made.
    3. Of the rest, tokens are counted exactly; sets are signed by prefixes of rare tokens and combinations of frequent ones.
    4. Nodes go to blocks, by their most shared signature and size. Blocks are verified inside, then against the blocks that
       share a signature with them and fit in size; blocks of one component already found need not meet. What comes out are spanning
       forests, so rows never grow with the square of a group, and no link between different components is lost.
    5. To count links, each pair of sets meets in one pair of blocks at most: those of a team among themselves, as differences from its first set
       (see _team_degrees), all others in step 4. What comes out is a sum a set and pair of blocks, weighted by the sets' copies.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be 80 to 100: below, small sets are too small for their prefixes")
    small_batches(df.sparkSession)
    d = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            sets = shingles(b.column(1).to_pylist(), words)
            n = [len(s) for s in sets]
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            first = []
            for s in sets:
                e = slack(len(s), percent)
                # a set without slack links with larger sets only through theirs, or with its equals
                first.append(s[: e + e // 2 + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(first, pa.list_(pa.int64()))], ["doc_id", "n", "hi", "lo", "first"])

    s = cut(d.mapInArrow(describe, "doc_id long, n long, hi long, lo long, first array<long>"), "sets")
    # sets of equal size and digest are equal
    equal = s.filter("n > 0 AND doc_id IS NOT NULL").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("w"))
    copies = F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce(F.col("w") - 1, F.lit(0))).alias("copies")
    members = s.drop("first").join(equal, ["hi", "lo", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("node", "doc_id").alias("node"), copies)
    members = cut(members, "members")
    nodes = s.join(equal.select("hi", "lo", F.col("node").alias("doc_id")), ["hi", "lo", "doc_id"], "left_semi")
    # fewer than this many tokens leave no room for a link between unlike sets
    fewest = next(n for n in itertools.count(1) if slack(n, percent) > 0) - 1
    prefix = nodes.filter(F.col("n") >= max(1, fewest)).select(F.col("doc_id").alias("node"), "n", F.explode("first").alias("token"))
    twice = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("token")
    # the smallest partner may look at fewer tokens, so its k is what a node must reach
    m = F.ceil(F.col("n") * percent / F.lit(100))
    e = m - F.ceil(m * percent / F.lit(100))
    found = prefix.join(twice, "token").groupBy("node", "n").agg(F.count(F.lit(1)).alias("c"))
    suspects = found.filter(F.col("c") >= F.floor(e / F.lit(2)) + 1).select("node").distinct().join(equal.groupBy("node").agg(F.max("w").alias("w")), "node")
    suspects = suspects.join(s.groupBy(F.col("doc_id").alias("node")).agg(F.count(F.lit(1)).alias("rows")), "node")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingles(b.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int64()), b.column(2), b.column(3), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "n", "w", "rows", "tokens"])

    suspects = cut(suspects, "suspects")
    drop(s)  # what is needed of it is in members and suspects
    suspected = d.join(suspects.hint("merge"), d["doc_id"] == F.col("node")).select("doc_id", "text", "w", "rows")
    sets = cut(suspected.mapInArrow(tokens, "node long, n long, w long, rows long, tokens array<long>"), "tokens")
    # a doc_id's equal rows are one set
    again = sets.filter("rows > 1").groupBy("node", "n", "w", F.xxhash64("tokens").alias("digest")).agg(F.max("tokens").alias("tokens")).drop("digest")
    sets = sets.filter("rows = 1").drop("rows").union(cut(again, "repeated"))
    each = sets.select("node", "n", F.explode("tokens").alias("token"))
    shared = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    lists = each.join(shared, "token").groupBy("node", "n").agg(F.collect_list(F.struct("token", "df")).alias("common"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, c in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                v = c.values
                out.append(signatures(n, v.field(0).to_numpy().view(np.uint64), v.field(1).to_numpy(), percent))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], ["node", "n", "signatures"])

    signed = lists.mapInArrow(sign, "node long, n long, signatures array<long>").select("node", "n", F.explode("signatures").alias("sig"))
    signed = cut(signed, "signed")
    often = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    postings = cut(signed.join(often, "sig"), "postings")
    drop(signed)
    home = postings.groupBy("node", "n").agg(F.max(F.struct("c", "sig"))["sig"].alias("home"))
    home = cut(home.withColumn("step", F.floor(F.log(F.col("n").cast("double")) / np.log(1.05)).cast("int")), "homes")

    def blocks(keyed: DataFrame) -> DataFrame:
        """keyed with its block, by columns home, team and step; a key with many sets or tokens has several."""
        size = keyed.groupBy("home", "team", "step").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS))).alias("parts"))
        return keyed.join(size, ["home", "team", "step"]).withColumn("block", F.xxhash64("home", "team", "step", F.pmod(F.xxhash64("node"), F.col("parts"))))

    inside = blocks(home.withColumn("team", F.lit(-1).cast("long"))).select("node", "block")
    links = inside.join(sets, "node").select("block", "node", F.lit(0).alias("side"), "tokens")
    links = links.groupBy("block").applyInArrow(_verify(percent), "a long, b long, degree long").select("a", "b")
    links = cut(links, "links")
    known = components(links)
    size = known.groupBy("component").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= TEAM)
    team = home.join(known.join(size, "component").select("node", F.col("component").alias("team")), "node", "left")
    # a large component is one team wherever its members' homes are; the rest are teamless (-1)
    team = team.withColumn("home", F.when(F.col("team").isNull(), F.col("home")).otherwise(0)).withColumn("team", F.coalesce("team", F.lit(-1)))
    placed = cut(blocks(team).select("node", "n", "team", "block"), "blocks")
    range_ = placed.groupBy("block", "team").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    holds = postings.select("sig", "node").join(placed.select("node", "block"), "node").select("sig", "block").distinct().join(range_, "block")
    # signatures that lie in the same blocks give the same pairs: one of them stands for all (the sets are told apart by 128 bits of sums)
    sums = [F.sum(F.xxhash64(F.lit(seed), "block").cast("decimal(20,0)")).alias(f"sum{seed}") for seed in (1, 2)]
    alike = holds.groupBy("sig").agg(F.count(F.lit(1)).alias("c"), *sums).groupBy("c", "sum1", "sum2").agg(F.min("sig").alias("sig")).select("sig")
    holds = cut(holds.join(alike, "sig"), "holds")
    l, r = holds.alias("l"), holds.alias("r")
    fits = (F.col("l.hi") * 100 >= F.col("r.lo") * percent) & (F.col("r.hi") * 100 >= F.col("l.lo") * percent)
    apart = (F.col("l.team") != F.col("r.team")) | (F.col("l.team") == -1)
    # a teamless block meets itself as well: its members may have been in several blocks before
    pairs = l.join(r, (F.col("l.sig") == F.col("r.sig")) & (F.col("l.block") <= F.col("r.block")) & fits & apart)
    pairs = pairs.select(F.col("l.block").alias("x"), F.col("r.block").alias("y")).distinct()
    left, right = (F.struct(F.lit(i).alias("side"), F.col(c).alias("block")) for i, c in enumerate("xy"))
    sides = pairs.select("x", "y", F.explode(F.when(F.col("x") == F.col("y"), F.array(left)).otherwise(F.array(left, right))).alias("s"))
    sides = sides.select("x", "y", F.col("s.side").alias("side"), F.col("s.block").alias("block"))
    meet = sides.join(placed.select("node", "block"), "block").join(sets.select("node", "tokens", "w"), "node").select("x", "y", "side", "node", "tokens", "w")
    more = cut(meet.groupBy("x", "y").applyInArrow(_verify(percent, count), "a long, b long, degree long"), "more-links")
    final = components(links.union(more.filter("degree IS NULL").select("a", "b")))
    out = members.join(final, "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    if not count:
        return out.select("doc_id", "n_shingles", "component_id")
    degree = more.filter("degree IS NOT NULL").select(F.col("a").alias("node"), "degree")
    degree = degree.union(_team_degrees(placed.filter("team <> -1").select("node", "team"), sets, percent))
    degree = degree.groupBy("node").agg(F.sum("degree").alias("degree"))
    return out.join(degree, "node", "left").select("doc_id", "n_shingles", "component_id", (F.col("copies") + F.coalesce("degree", F.lit(0))).alias("n_links"))
