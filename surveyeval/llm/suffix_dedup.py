"""Suffix-array dedup: remove every byte covered by a string of `length` bytes that also starts anywhere else in the corpus.

A suffix array of the whole corpus is cut into independent pieces by content: of the grams inside a window of `length` bytes the one of
least hash (leftmost on ties) is its anchor, so equal windows meet at equal anchors.  Consecutive windows of one anchor
are a segment, known by the hash of its anchor (a) and of its bytes (g).

1. One pass over the texts counts segments by anchor, at most two rows an anchor and batch: anchors seen once are done.  An anchor
   whose segments are all equal repeats whole segments.
2. A second pass gives the places of segments at repeated anchors, and the bytes of those whose anchor has several segments.  Distinct segments
   meet by anchor; tasks sort their suffixes in two stages (`suffix_array`: those smaller than their successors directly, the
   others induced) and compare neighbours: suffixes that share `length` bytes are repeated.
3. What is found joins the places, and the spans join the texts that have any; texts that a filter of fixed size rules out are not shuffled.

Copies inside a batch are one row before they shuffle.  An anchor with more distinct segments than a task should sort (the edge of a passage that
very many documents share) is taken window by window: equal windows are then equal segments, and counts decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices, sorted_chunks, utf8, word_hash
from .shared import bit_filter, filter_table, join_small, materialize, passes, positional, small_batches, with_passes
from .suffix_array import repeated_starts, span_hashes

LENGTH = 200
GRAM = 64
#: Segments whose suffixes a task sorts at once, about 1 MB of text.
TOGETHER = 4_000
#: An anchor with more distinct segments than this is taken window by window.
CROWD = 5_000
#: Segments that a map task settles at once before they shuffle, and bytes of text that it hashes at once.
HELD = 100_000
SLICE = 1 << 20
#: Places that are turned into spans at once.
PLACES = 500_000
#: A place of a segment: the two hashes of its text, its first window and how many neighbouring windows have the same segment.
_PLACE = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("at", "<i4"), ("times", "<i4")])
_SPANS = "array<struct<i:int,n:int>>"


def _keys(text) -> list:
    """Two 64-bit hashes that stand for a text; results depend on nothing else."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _segments(data: np.ndarray, off: np.ndarray, length: int, gram: int):
    """(anchor hash, segment hash, text number, first window, windows) of every segment of a slice of texts."""
    if len(data) < length:
        return None
    h = span_hashes(data, gram)
    low = np.uint64(0xFFFFFFFF)  # the upper half of a hash decides, then the place: the same for equal windows
    least, have, span = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1, length - gram + 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    anchor = (least & low).astype(np.int64)
    fits = np.zeros(len(anchor) + 1, np.int64)
    long = np.flatnonzero(np.diff(off) >= length)
    np.add.at(fits, off[long], 1)
    np.add.at(fits, off[long + 1] - length + 1, -1)
    fits = np.cumsum(fits[:-1]) > 0
    head = fits.copy()
    head[1:] &= (anchor[1:] != anchor[:-1]) | ~fits[:-1]
    head[off[long]] = True
    begin = np.flatnonzero(head)
    if not len(begin):
        return None
    of = np.searchsorted(off, begin, side="right") - 1
    last = off[of + 1] - length
    n = np.minimum(np.append(begin[1:], len(data)) - 1, last) - begin + 1
    g = word_hash(data, begin, begin + n + length - 1)
    return h[anchor[begin]].view(np.int64), g.view(np.int64), of, begin - off[of], n


def _new_groups(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def repeated_anchors(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Rows (a, lo, hi): anchors that stand for at least two segments, and the least and greatest segment hash; `texts` has a column body."""

    def settle(parts):
        a, g = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((g, a))
        a, g = a[order], g[order]
        new = _new_groups(a)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(a)) - 1
        rows = np.concatenate([first, last[last > first]])  # a lone one gives one row, any more give two
        return pa.RecordBatch.from_arrays([pa.array(a[rows]), pa.array(g[rows])], ["a", "g"])

    def local(batches):
        parts, held = [], 0
        for batch in slices(batches, "body", SLICE):
            found = _segments(*utf8(batch.column("body")), length, gram)
            if found is not None:
                parts.append(found[:2])
                held += len(found[0])
                if held > HELD:
                    yield settle(parts)
                    parts, held = [], 0
        if parts:
            yield settle(parts)

    met = texts.select("body").mapInArrow(local, "a long, g long").repartition("a")
    found = met.groupBy("a").agg(F.count("*").alias("n"), F.min("g").alias("lo"), F.max("g").alias("hi"))
    return found.where("n > 1").select("a", "lo", "hi")


def segment_places(texts: DataFrame, repeated: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Rows (a, g, m, n, places, body): segments at repeated anchors by batch; m windows, n places; body (bytes) where the anchor has several segments.

    Anchors are told by filters of fixed size, so a few others pass; joins with `repeated` drop them.
    """
    again = bit_filter(repeated.select(F.col("a").alias("x")))
    mixed = bit_filter(repeated.where("lo <> hi").select(F.col("a").alias("x")))

    def settle(parts):
        a, g, m, k1, k2, at = (np.concatenate([p[i] for p in parts]) for i in range(6))
        source = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        begin = np.concatenate([p[6] for p in parts])
        order = np.lexsort((at, k2, k1, g, a))
        a, g, m, k1, k2, at, source, begin = (x[order] for x in (a, g, m, k1, k2, at, source, begin))
        n = np.diff(np.append(np.flatnonzero(_new_groups(a, g)), len(a)))
        # equal texts have equal places: they count, but stand once
        own = _new_groups(a, g, k1, k2, at)
        a, g, m, k1, k2, at, source, begin = (x[own] for x in (a, g, m, k1, k2, at, source, begin))
        # one window after the other with equal bytes (text of one repeated byte) is one place
        run = np.ones(len(a), bool)
        run[1:] = ~((a[1:] == a[:-1]) & (g[1:] == g[:-1]) & (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1]) & (at[1:] == at[:-1] + 1) & (m[1:] == 1))
        starts = np.flatnonzero(run)
        place = np.zeros(len(starts), _PLACE)
        place["k1"], place["k2"], place["at"], place["times"] = k1[starts], k2[starts], at[starts], np.diff(np.append(starts, len(a)))
        head = np.flatnonzero(_new_groups(a[starts], g[starts]))
        rows, edges = starts[head], np.append(head, len(starts))
        offsets = (edges * _PLACE.itemsize).astype(np.int32)
        places = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(offsets), pa.py_buffer(place.tobytes())])
        need = passes(mixed, a[rows])
        bodies = [parts[p][7][b : b + w + length - 1].tobytes() if x else None for p, b, w, x in zip(source[rows].tolist(), begin[rows].tolist(), m[rows].tolist(), need.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(a[rows]), pa.array(g[rows]), pa.array(m[rows].astype(np.int32)), pa.array(n.astype(np.int64)), places, pa.array(bodies, pa.binary())], ["a", "g", "m", "n", "places", "body"])

    def local(batches):
        parts, held = [], 0
        for batch in slices(batches, "body", SLICE):
            data, off = utf8(batch.column("body"))
            found = _segments(data, off, length, gram)
            if found is None:
                continue
            a, g, of, at, m = found
            rows = np.flatnonzero(passes(again, a))
            k1, k2 = (batch.column(c).to_numpy()[of[rows]] for c in ("k1", "k2"))
            parts.append((a[rows], g[rows], m[rows], k1, k2, at[rows], off[of[rows]] + at[rows], data))
            held += len(rows) + len(data) // 64
            if held > HELD:
                yield settle(parts)
                parts, held = [], 0
        if parts:
            yield settle(parts)

    return texts.mapInArrow(local, "a long, g long, m int, n long, places binary, body binary")


def sorted_repeats(segments: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows (a, g, spans): of distinct segments (a, g, body), the runs of windows whose bytes another segment of their anchor has too."""

    def sort(batches):
        for table in sorted_chunks(slices(batches, "body", SLICE), "a", TOGETHER):
            kept: list[list] = [[], [], []]
            for a, g, flags in zip(table.column("a").to_pylist(), table.column("g").to_pylist(), repeated_starts(table.column("body").to_pylist(), length), strict=True):
                if flags.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                    for column, value in zip(kept, (a, g, [{"i": i, "n": j - i} for i, j in edge.reshape(-1, 2).tolist()]), strict=True):
                        column.append(value)
            spans = pa.array(kept[2], pa.list_(pa.struct([("i", pa.int32()), ("n", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(kept[0], pa.int64()), pa.array(kept[1], pa.int64()), spans], ["a", "g", "spans"])

    return segments.select("a", "g", "body").repartition("a").sortWithinPartitions("a").mapInArrow(sort, f"a long, g long, spans {_SPANS}")


def crowded_repeats(segments: DataFrame, length: int = LENGTH) -> DataFrame:
    """The same for crowded anchors: every window is a segment of its own, so those with equal bytes are counted together."""

    def cut(batches):
        for batch in slices(batches, "body"):
            data, off = utf8(batch.column("body"))
            n = np.diff(off) - length + 1
            row = np.repeat(np.arange(len(n)), n)
            i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            begin = off[row] + i
            w = word_hash(data, begin, begin + length)
            a, g = (batch.column(c).to_numpy()[row] for c in ("a", "g"))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(g), pa.array(i.astype(np.int32)), pa.array(w.view(np.int64))], ["a", "g", "i", "w"])

    windows = segments.select("a", "g", "body").mapInArrow(cut, "a long, g long, i int, w long")
    again = windows.groupBy("a", "w").agg(F.count("*").alias("n")).where("n > 1").select("a", "w")
    hits = windows.join(again, ["a", "w"])
    return hits.groupBy("a", "g").agg(F.collect_list(F.struct("i", F.lit(1).alias("n"))).alias("spans"))


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Rows (k1, k2, spans): for texts (by two hashes) the runs (at, n) of starts whose `length` bytes start anywhere else too.

    Null texts are empty; shorter texts have no starts.  Every row counts, so a repeated row or text repeats all its strings.  Ids are not
    looked at; other columns, of whatever names, are ignored; an empty table gives an empty result; a very long text is one row in memory.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(body.alias("body"), *_keys(body)).where(f"octet_length(body) >= {length}")
    with small_batches(docs.sparkSession):  # a map task holds on to the batches of what it has not settled yet
        repeated = materialize(repeated_anchors(texts, length, gram), "anchors")
        held = materialize(segment_places(texts, repeated, length, gram), "places")
    several = repeated.where("lo <> hi").select("a")
    parts = held.where("body is not null").join(several, "a", "left_semi")
    parts = materialize(parts.groupBy("a", "g").agg(F.sum("n").alias("n"), F.first("body").alias("body")), "segments")
    crowds = materialize(parts.groupBy("a").agg(F.count("*").alias("segments")).where(F.col("segments") > CROWD).select("a"), "crowds")
    none = F.lit(None).cast(_SPANS).alias("spans")
    whole = repeated.where("lo = hi").select("a", F.col("lo").alias("g"), none).unionByName(parts.where("n > 1").select("a", "g", none))
    if crowds.limit(1).count():
        found = sorted_repeats(join_small(parts, crowds, "a", "left_anti"), length).unionByName(crowded_repeats(join_small(parts, crowds, "a", "left_semi"), length))
    else:
        found = sorted_repeats(parts, length)
    # a segment of several places is found as a whole; what the sort says of it is part of that
    found = found.join(parts.where("n > 1").select("a", "g"), ["a", "g"], "left_anti")
    met = held.select("a", "g", "m", "places").join(whole.unionByName(found), ["a", "g"])

    def merged(parts):
        k1, k2, at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((n, at, k2, k1))
        k1, k2, at, n = k1[order], k2[order], at[order], n[order]
        own = _new_groups(k1, k2, at, n)
        k1, k2, at, n = k1[own], k2[own], at[own], n[own]
        joined = np.zeros(len(at), bool)  # the next run starts where this one ends
        joined[1:] = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1]) & (at[1:] == at[:-1] + n[:-1])
        head = np.flatnonzero(~joined)
        last = np.append(head[1:], len(at)) - 1
        return pa.RecordBatch.from_arrays([pa.array(k1[head]), pa.array(k2[head]), pa.array(at[head]), pa.array((at + n)[last] - at[head])], ["k1", "k2", "at", "n"])

    def expand(batches):
        for batch in batches:
            parts, size = [], 0
            for m, raw, spans in zip(batch.column("m").to_pylist(), batch.column("places"), batch.column("spans").to_pylist(), strict=True):
                place = np.frombuffer(raw.as_buffer(), _PLACE)
                for i, width in [(0, m)] if spans is None else [(s["i"], s["n"]) for s in spans]:
                    parts.append((place["k1"], place["k2"], place["at"] + np.int32(i), place["times"] + np.int32(width - 1)))
                    size += len(place)
                    if size > PLACES:
                        yield merged(parts)
                        parts, size = [], 0
            if parts:
                yield merged(parts)

    spans = met.select("m", "places", "spans").mapInArrow(expand, "k1 long, k2 long, at int, n int")
    # a text that many batches hold has its spans from each of them: a set keeps one of each
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "n")).alias("spans"))


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """The documents plus kept (binary: the bytes that are left), n_bytes, n_removed and n_spans (maximal removed runs).

    Columns of those four names are replaced; all others, of whatever names, are kept, the text only if `with_text`.  A null text counts as empty.  See `repeated_spans`.
    """
    spans = repeated_spans(docs.select(F.col(text).alias("text")), "text", length, gram)
    with small_batches(docs.sparkSession):
        spans = materialize(spans, "spans")
    made = ["kept", "n_bytes", "n_removed", "n_spans"]
    own, names = positional(docs, tuple(made))
    columns, body = own.columns, f"c{names.index(text)}"
    shown = [c for c in columns if with_text or c != body]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema.fields if f.name in shown)

    def cut(batches):
        for batch in slices(batches, body, SLICE):
            data, off = utf8(batch.column(body))
            out: list[list] = [[], [], [], []]
            for b, e, found in zip(off[:-1].tolist(), off[1:].tolist(), batch.column("spans").to_pylist(), strict=True):
                own_bytes, removed, runs = data[b:e], 0, 0
                if found:
                    edge = np.zeros(e - b + 1, np.int64)
                    at = np.array([s["at"] for s in found])
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + np.array([s["n"] for s in found]) + length - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed, runs = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    own_bytes = own_bytes[~gone]
                for column, value in zip(out, (own_bytes.tobytes(), e - b, removed, runs), strict=True):
                    column.append(value)
            arrays = [pa.array(out[0], pa.binary()), *[pa.array(x, pa.int64()) for x in out[1:]]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in shown], *arrays], [*shown, *made])

    table = materialize(filter_table(spans.select(F.col("k1").alias("x"))), "filter")
    held = own.select(*columns, *_keys(F.coalesce(F.col(body), F.lit(""))))
    held = with_passes(held, F.col("k1"), table, "may")
    whole = F.coalesce(F.col(body), F.lit("")).cast("binary")
    zero = F.lit(0).cast("long")
    rest = held.where("not may").select(*shown, whole.alias("kept"), F.octet_length(whole).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"))
    some = held.where("may").join(spans, ["k1", "k2"], "left").select(*columns, "spans")
    some = some.mapInArrow(cut, f"{schema}kept binary, n_bytes long, n_removed long, n_spans long")
    return rest.unionByName(some).toDF(*[n for n, c in zip(names, columns, strict=True) if c in shown], *made)


def op13_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
