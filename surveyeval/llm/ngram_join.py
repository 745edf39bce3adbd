"""N-gram Jaccard join: exact set-similarity links between documents by a grouped prefix join, and their components.

A document is the set of its distinct k-word shingles; documents with equal sets are one *node*.  Shingles have one global
order, rare ones by hash and then the frequent ones by frequency, so a prefix holds what is peculiar to a text.  Two sets with
Jaccard similarity t or more share a shingle among their first n - ceil(t n) + 1.  Nodes with identical prefix and size
are one *group*; groups meet by the shingles of their prefix, group pairs are filtered by size and position, and the
pairs left are expanded to their members, which are verified on their whole sets.

Where many nodes meet (a crowd: over `GROUP` groups at one shingle, or a group or a pair of groups with many members), no
list of all pairs is made: every member is first verified against one leader, then the members outside the crowd's largest
component are joined with all others they are not yet connected to, in a Spark join whose hot keys AQE splits.  No pair
that could add a link is left out, so components are exact up to collisions of the 63-bit shingle hashes (48 bits of them are
compared inside a pair of sets).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, mix, ngrams, slices, sorted_chunks, utf8, word_hash, words
from .shared import Scratch, bit_filter, components, materialize, passes

#: Shingles in this many documents or more come last in the global order (at most HOT_KEYS of them, the most frequent ones).
HOT, HOT_KEYS = 8, 2_000_000
#: Groups that share a shingle are paired directly up to this many; more are a crowd and get a leader first.
GROUP = 48
#: A shingle of about this many documents or more is always a crowd, and its rows are dealt over many tasks.
SPLIT = 50_000
BITS = ["b0", "b1", "b2", "b3"]
_COUNTED = np.uint64(3 << 60)  # three eighths of the 63-bit hash space: prefixes hold the least hashes


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 63-bit shingle hashes, ascending in each text, and the n + 1 offsets of the texts."""
    data, off = utf8(texts)
    data = LOWER[data]
    starts, ends, first = words(data, off)
    h = word_hash(data, starts, ends)
    count = np.diff(first)
    of = np.repeat(np.arange(len(count)), count)
    i = np.arange(max(0, len(h) - k + 1))
    i = i[i + k <= first[of[i] + 1]]
    hashes, rows = [ngrams(h, k)[i]], [of[i]]
    for m in range(1, k):
        few = np.flatnonzero(count == m)
        if len(few):
            hashes.append(ngrams(h, m)[first[few]])
            rows.append(few)
    token, row = np.concatenate(hashes) >> np.uint64(1), np.concatenate(rows)
    if len(hashes) > 1:
        order = np.argsort(row, kind="stable")
        token, row = token[order], row[order]
    edges = np.searchsorted(row, np.arange(len(count) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a > 1:
            token[a:b].sort()
    keep = np.ones(len(token), bool)
    keep[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    return token[keep], np.append(0, np.cumsum(keep))[edges]


def set_hash(token: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A signed 64-bit identity of each set (0 for an empty one)."""
    total = np.append(np.uint64(0), np.cumsum(mix(token ^ np.uint64(0x5BF03635)), dtype=np.uint64))
    return np.where(np.diff(edges) > 0, mix((total[edges[1:]] - total[edges[:-1]]) ^ np.diff(edges).astype(np.uint64)), np.uint64(0)).view(np.int64)


def parities(token: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """256 bits per set (4 longs): is the number of members in each hash bucket odd?  Bits that differ bound the members that differ."""
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    odd = np.bincount(row * 256 + (token & np.uint64(255)).astype(np.int64), minlength=256 * (len(edges) - 1)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, 4)


def _need(n1, n2, num, den):
    """Least intersection of sets of n1 and n2 with den * i >= num * (n1 + n2 - i)."""
    return -(-num * (n1 + n2) // (den + num))


def _nodes(docs: DataFrame, k: int, ranges: int) -> DataFrame:
    """(doc, rid, s, n, parities) of every document and, beside, shingles to count, cut into hash ranges.

    Counted are all shingles of the low three eighths of the hash space (prefixes hold the least hashes) and, of the
    others, those that repeat inside a batch: a shingle of many documents does.
    """

    def local(batches):
        for batch in slices(batches, "body"):
            token, edges = shingle_sets(batch.column("body"), k)
            s, n = set_hash(token, edges), np.diff(edges)
            empty = pa.nulls(len(s), pa.binary())
            bits = [pa.array(np.ascontiguousarray(c)) for c in parities(token, edges).T]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("rid"), pa.array(s), pa.array(n.astype(np.int64)), *bits, pa.nulls(len(s), pa.int32()), empty], names)
            one = np.zeros(len(s), bool)
            one[np.unique(s, return_index=True)[1]] = True
            held = np.sort(token[np.repeat(one, n)] >> np.uint64(23))
            again = held < (_COUNTED >> np.uint64(23))
            again[1:] |= held[1:] == held[:-1]
            again[:-1] |= held[1:] == held[:-1]
            held = held[again]
            if not len(held):
                continue
            r = (held * np.uint64(ranges) >> np.uint64(40)).astype(np.int64)
            at = np.searchsorted(r, np.arange(ranges + 1))
            rows, keys = [], []
            for x in range(ranges):
                if at[x + 1] > at[x]:
                    gap = np.diff(held[at[x] : at[x + 1]], prepend=np.uint64(0))
                    rows.append(x)
                    keys.append(np.ascontiguousarray(gap.view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes())
            m = len(rows)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(m, pa.int64())] * 8, pa.array(rows, pa.int32()), pa.array(keys, pa.binary())], names)

    names = ["doc", "rid", "s", "n", *BITS, "r", "keys"]
    return docs.mapInArrow(local, "doc long, rid long, s long, n long, b0 long, b1 long, b2 long, b3 long, r int, keys binary")


def _frequent(parts: DataFrame, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles' 40-bit keys, sorted, and a class of their counts (8 to each doubling): at most HOT_KEYS, whatever the input."""

    def count(batches):
        for table in sorted_chunks(batches, "r", 2000):
            by: dict[int, list[np.ndarray]] = {}
            for r, keys in zip(table.column("r").to_pylist(), table.column("keys").to_pylist(), strict=True):
                planes = np.frombuffer(keys, np.uint8).reshape(5, -1)
                wide = np.zeros((planes.shape[1], 8), np.uint8)
                wide[:, :5] = planes.T
                by.setdefault(r, []).append(np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64))
            for held in by.values():
                key, n = np.unique(np.concatenate(held), return_counts=True)
                hot = n >= HOT
                yield pa.RecordBatch.from_arrays([pa.array(key[hot].astype(np.int64)), pa.array(n[hot])], ["key", "n"])

    hot = scratch.save(parts.repartition("r").sortWithinPartitions("r").mapInArrow(count, "key long, n long"), "frequent")
    if hot.count() > HOT_KEYS:
        hot = hot.orderBy(F.desc("n"), "key").limit(HOT_KEYS)
    found = hot.select("key", F.least(F.lit(255), F.round(8 * F.log2("n"))).cast("short").alias("c")).toPandas().sort_values("key")
    return found["key"].to_numpy(np.int64).astype(np.uint64), found["c"].to_numpy(np.uint8)


def _prefixes(docs: DataFrame, k: int, num: int, den: int, frequent) -> DataFrame:
    """(key, g, n, at, s): each group's prefix shingles (s null), dealt by shingle, and its nodes s (at = -1), dealt by group.

    A group g is a hash of prefix and size.  Rows of shingles of SPLIT documents or more are dealt by shingle and group, with at -2 - place.
    """
    split = round(8 * np.log2(SPLIT))

    def local(batches):
        hot, kind = frequent.value
        seen = np.zeros(1 << 20, bool)
        seen[hot >> np.uint64(20)] = True
        for batch in slices(batches, "body"):
            token, edges = shingle_sets(batch.column("body"), k)
            s, n = set_hash(token, edges), np.diff(edges)
            one = np.zeros(len(s), bool)
            one[np.unique(s, return_index=True)[1]] = True
            one &= n > 0
            rank = np.zeros(len(token), np.uint8)
            if len(hot):
                near = np.flatnonzero(seen[token >> np.uint64(43)])
                key = token[near] >> np.uint64(23)
                at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                rank[near] = np.where(hot[at] == key, kind[at], 0)
                row = np.repeat(np.arange(len(n)), n)
                order = np.argsort(row * 256 + rank, kind="stable")
                token, rank = token[order], rank[order]
            length = np.where(one, n - (num * n + den - 1) // den + 1, 0)
            of = np.repeat(np.arange(len(n)), length)
            first = np.cumsum(length) - length
            at = np.arange(len(of)) - np.repeat(first, length)
            place = edges[of] + at
            total = np.append(np.uint64(0), np.cumsum(mix(token[place] ^ np.uint64(0x1F83D9AB)), dtype=np.uint64))
            g = mix((total[first + length] - total[first]) ^ mix(n.astype(np.uint64))).view(np.int64)
            new = np.zeros(len(g), bool)
            new[np.flatnonzero(one)[np.unique(g[one], return_index=True)[1]]] = True
            row = new[of]
            of, at, place = of[row], at[row], place[row]
            crowd = rank[place] >= split
            key = np.where(crowd, mix(token[place] ^ g[of].view(np.uint64)), token[place]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(g[of]), pa.array(n[of].astype(np.int32)), pa.array(np.where(crowd, -2 - at, at).astype(np.int32)), pa.array(np.where(crowd, token[place].view(np.int64), 0), mask=~crowd)], names)
            x = np.flatnonzero(one)
            yield pa.RecordBatch.from_arrays([pa.array(g[x]), pa.array(g[x]), pa.array(n[x].astype(np.int32)), pa.array(np.full(len(x), -1, np.int32)), pa.array(s[x])], names)

    names = ["key", "g", "n", "at", "s"]
    return docs.select("body").mapInArrow(local, "key long, g long, n int, at int, s long")


def _fits(n1, at1, n2, at2, num, den):
    """Size and position filters for n1 <= n2: could these be the first shared shingle of two linked sets?"""
    return (den * n1 >= num * n2) & (np.minimum(n1 - at1, n2 - at2) >= _need(n1, n2, num, den))


def _candidates(prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """(token, g, h, n, at): fitting pairs of groups (token null), rows of crowds (h null), and nodes h of groups (at = -1)."""

    def rows(token, g, h, n, at):
        empty = lambda x, kind: pa.nulls(len(g), kind) if x is None else pa.array(x)
        return pa.RecordBatch.from_arrays([empty(token, pa.int64()), pa.array(g), empty(h, pa.int64()), empty(n, pa.int32()), empty(at, pa.int32())], ["token", "g", "h", "n", "at"])

    def meet(batches):
        for table in sorted_chunks(batches, "key"):
            token, g, n, at = (table.column(c).to_numpy() for c in ("key", "g", "n", "at"))
            s = table.column("s").fill_null(0).to_numpy()
            order = np.lexsort((s, g, n, at < 0, token))
            token, g, n, at, s = token[order], g[order], n[order], at[order], s[order]
            new = np.ones(len(g), bool)
            new[1:] = (token[1:] != token[:-1]) | (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (at[1:] != at[:-1])
            token, g, n, at, s = token[new], g[new], n[new], at[new], s[new]
            x = np.flatnonzero(at == -1)
            if len(x):
                yield rows(None, g[x], s[x], n[x], at[x])
            x = np.flatnonzero(at < -1)
            if len(x):
                yield rows(s[x], g[x], None, n[x], -2 - at[x])
            x = np.flatnonzero(at >= 0)
            token, g, n, at = token[x], g[x], n[x].astype(np.int64), at[x].astype(np.int64)
            group = np.cumsum(np.append(True, token[1:] != token[:-1])) - 1 if len(x) else x
            size = np.bincount(group)[group] if len(x) else x
            lo, hi = [], []
            small = np.flatnonzero((size <= GROUP) & (size > 1))
            for d in range(1, GROUP):
                i, j = small[:-d], small[d:]
                ok = group[i] == group[j]
                if not ok.any():
                    break
                i, j = i[ok], j[ok]
                ok = _fits(n[i], at[i], n[j], at[j], num, den)
                lo.append(np.minimum(g[i[ok]], g[j[ok]]))
                hi.append(np.maximum(g[i[ok]], g[j[ok]]))
            large = np.flatnonzero(size > GROUP)
            if len(large):
                yield rows(token[large], g[large], None, n[large].astype(np.int32), at[large].astype(np.int32))
            if sum(map(len, lo)):
                lo, hi = np.concatenate(lo), np.concatenate(hi)
                order = np.lexsort((hi, lo))
                lo, hi = lo[order], hi[order]
                new = np.ones(len(lo), bool)
                new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
                yield rows(None, lo[new], hi[new], None, None)

    return prefixes.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "token long, g long, h long, n int, at int")


def _expanded(found: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs of nodes (s1, s2) of the paired groups, and crowds as (token, s, n, at): those found, large groups, large pairs of groups."""
    belong = found.where("at = -1").select("g", F.col("h").alias("s"), "n").distinct()
    belong = scratch.save(belong, "belong")
    sizes = scratch.save(belong.groupBy("g").agg(F.count("*").alias("m")).where("m > 1"), "groups")
    size = lambda c: sizes.select(F.col("g").alias(c), F.col("m").alias(f"m_{c}"))
    pairs = found.where("token is null and n is null").select("g", "h").distinct().join(size("g"), "g", "left").join(size("h"), "h", "left").fillna(1, ["m_g", "m_h"])
    pairs = scratch.save(pairs.select("g", "h", (F.col("m_g") * F.col("m_h") > GROUP).alias("large")), "pairs")
    nodes = lambda c, s: belong.select(F.col("g").alias(c), F.col("s").alias(s))
    direct = pairs.where("not large").join(nodes("g", "x"), "g").join(nodes("h", "y"), "h").select(F.least("x", "y").alias("s1"), F.greatest("x", "y").alias("s2"))
    both = pairs.where("large").select(F.xxhash64("g", "h").alias("token"), F.explode(F.array("g", "h")).alias("g"))
    crowds = found.where("token is not null").select("token", "g", "at")
    crowds = crowds.unionByName(both.withColumn("at", F.lit(0))).unionByName(sizes.select(F.col("g").alias("token"), "g", F.lit(0).alias("at")))
    return direct, crowds.join(belong, "g").select("token", "s", "n", "at")


def _across(members: DataFrame, comp: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(s1, s2, apart): nodes of one crowd that fit and lie in different components, one of them outside the crowd's largest component."""
    tied = members.join(comp.withColumnRenamed("node", "s"), "s", "left").withColumn("c", F.coalesce("component", "s")).drop("component")
    kinds = tied.groupBy("token", "c").agg(F.count("*").alias("m")).groupBy("token").agg(F.max_by("c", F.struct("m", "c")).alias("most"), F.count("*").alias("kinds"))
    tied = tied.join(kinds.where("kinds > 1").select("token", "most"), "token").join(nodes.select("s", *BITS), "s")
    side = lambda i: [F.col(c).alias(f"{c}{i}") for c in ("s", "n", "at", "c", *BITS)]
    odd = tied.where("c <> most").select("token", *side(1))
    rest = tied.select("token", (F.col("c") == F.col("most")).alias("main"), *side(2))
    apart = sum((F.bit_count(F.col(f"{b}1").bitwiseXOR(F.col(f"{b}2"))) for b in BITS[1:]), F.bit_count(F.col("b01").bitwiseXOR(F.col("b02"))))
    n1, n2 = F.col("n1").cast("long"), F.col("n2").cast("long")
    need = _least_shared(n1 + n2, num, den)
    fit = (den * F.least(n1, n2) >= num * F.greatest(n1, n2)) & (F.least(n1 - F.col("at1"), n2 - F.col("at2")) >= need) & (apart <= n1 + n2 - 2 * need)
    met = odd.join(rest, (odd["token"] == rest["token"]) & (F.col("c1") != F.col("c2")) & (F.col("main") | (F.col("s1") < F.col("s2"))) & fit)
    return met.groupBy(F.least("s1", "s2").alias("s1"), F.greatest("s1", "s2").alias("s2")).agg(F.min(apart).alias("apart"))


def _least_shared(total, num: int, den: int):
    """`_need` of sets with `total` members together, as a column: an exact quotient, rounded up."""
    up = num * total + (den + num - 1)
    return (up - F.pmod(up, F.lit(den + num))) / (den + num)


def _near(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The distinct pairs (s1, s2) whose parities allow enough shared members."""
    side = lambda i: nodes.select(F.col("s").alias(f"s{i}"), F.col("n").alias(f"n{i}"), *[F.col(b).alias(f"{b}_{i}") for b in BITS])
    both = pairs.distinct().join(side(1), "s1").join(side(2), "s2")
    apart = sum((F.bit_count(F.col(f"{b}_1").bitwiseXOR(F.col(f"{b}_2"))) for b in BITS[1:]), F.bit_count(F.col("b0_1").bitwiseXOR(F.col("b0_2"))))
    total = F.col("n1") + F.col("n2")
    need = _least_shared(total, num, den)
    return both.where(apart <= total - 2 * need).select("s1", "s2")


def _sets(wanted: DataFrame, docs: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(s, held): the whole sets of the wanted nodes (s), and of a few more that share their filter bits."""
    filled = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(F.col("s").alias("x"))))

    def sets(batches):
        bits = filled.value
        for batch in slices(batches, "body"):
            token, edges = shingle_sets(batch.column("body"), k)
            s, n = set_hash(token, edges), np.diff(edges)
            one = np.zeros(len(s), bool)
            one[np.unique(s, return_index=True)[1]] = True
            take = np.flatnonzero(one & (n > 0) & passes(bits, s))
            short = (token >> np.uint64(15)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            held = [short[edges[i] : edges[i + 1]].tobytes() for i in take.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(s[take]), pa.array(held, pa.binary())], ["s", "held"])

    return scratch.save(docs.select("body").mapInArrow(sets, "s long, held binary").dropDuplicates(["s"]), "sets")


def _verified(pairs: DataFrame, held: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""

    def wide64(raw):
        out = np.zeros((len(raw) // 6, 8), np.uint8)
        out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
        return out.view("<u8").ravel()

    def compare(batches):
        for batch in batches:
            keep = []
            last, left = None, None
            for p, a, b in zip(batch.column("s1").to_pylist(), batch.column("held1").to_pylist(), batch.column("held2").to_pylist(), strict=True):
                if p != last:
                    last, left = p, wide64(a)
                right = wide64(b)
                both = np.sort(np.concatenate([left, right]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(den * shared >= num * (len(left) + len(right) - shared))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("s1").filter(keep), batch.column("s2").filter(keep)], ["s1", "s2"])

    both = pairs.join(held.select(F.col("s").alias("s2"), F.col("held").alias("held2")), "s2").join(held.select(F.col("s").alias("s1"), F.col("held").alias("held1")), "s1")
    return both.select("s1", "s2", "held1", "held2").mapInArrow(compare, "s1 long, s2 long")


def jaccard_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row of `docs`: doc_id, rid, n_shingles, component_id (smallest doc_id reachable by links of Jaccard similarity num/den or more), component.

    A-Z are lowered; words are runs of bytes other than ASCII white space; texts of fewer than k words have one shingle, their
    whole sequence; texts without words (or null) have none and link with nothing.  Equal sets always link.  A null doc_id
    never names a component: such rows take the smallest other doc_id, and null if there is none.  rid is a hash of doc_id
    and text, component a number of the component (null for a text without words); repeated rows are reported as often as they come.  A very long text is one row and one set in memory.  Other columns, of whatever names, are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    body = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit(""))).alias("rid"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    ranges = 64
    count = docs.count()
    while ranges < 4096 and ranges * 16_000 < count:
        ranges *= 2
    made = scratch.save(_nodes(body, k, ranges), "nodes")
    rows = made.where("r is null").select("doc", "rid", "s", "n")
    nodes = made.where("r is null and n > 0").groupBy("s").agg(F.min("doc").alias("least"), F.first("n").alias("n"), *[F.first(b).alias(b) for b in BITS])
    nodes = scratch.save(nodes, "distinct")
    frequent = spark.sparkContext.broadcast(_frequent(made.where("r is not null").select("r", "keys"), scratch))
    found = scratch.save(_candidates(_prefixes(body, k, num, den, frequent), num, den), "candidates")
    direct, members = _expanded(found, scratch)
    members = scratch.save(members, "members")
    leaders = members.groupBy("token").agg(F.min(F.struct("at", "s", "n")).alias("first"))  # fewest peculiar shingles before this one: the likeliest original
    led = members.join(leaders, "token").where("s <> first.s").where(den * F.least("n", "first.n") >= num * F.greatest("n", "first.n"))
    led = led.select(F.least("s", "first.s").alias("s1"), F.greatest("s", "first.s").alias("s2"))
    pairs = scratch.save(_near(direct.unionByName(led), nodes, num, den), "near")
    ends = pairs.select(F.col("s1").alias("s")).union(pairs.select("s2"))
    links = scratch.save(_verified(pairs, _sets(ends, body, k, scratch), num, den), "links")
    comp = components(links, "s1", "s2", scratch)
    for likeliest in (True, False):  # only the second pass, over all pairs, ends the search
        more = _across(members, comp, nodes, num, den).join(pairs, ["s1", "s2"], "left_anti")
        if likeliest:
            more = more.groupBy("s1").agg(F.min_by("s2", F.struct("apart", "s2")).alias("s2"))
        more = scratch.save(more.select("s1", "s2"), "more")
        if not more.limit(1).count():
            break  # nothing is left to compare
        ends = more.select(F.col("s1").alias("s")).union(more.select("s2"))
        new = scratch.save(_verified(more, _sets(ends, body, k, scratch), num, den), "links")
        pairs = pairs.unionByName(more)
        if new.limit(1).count():
            links = links.unionByName(new)
            comp = components(links, "s1", "s2", scratch)
    tied = nodes.join(comp.withColumnRenamed("node", "s"), "s", "left").select("s", "least", F.coalesce("component", "s").alias("c"))
    tied = scratch.save(tied, "tied")
    roots = tied.groupBy("c").agg(F.min("least").alias("root"))
    ids = tied.join(roots, "c").select("s", "root", "c")
    out = rows.join(ids, "s", "left").select(F.col("doc").alias("doc_id"), "rid", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc")).alias("component_id"), F.when(F.col("n") > 0, F.col("c")).alias("component"))
    out = materialize(out, "components")
    scratch.clear()
    return out


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_groups(docs, k=4, num=85, den=100).drop("rid", "component")
