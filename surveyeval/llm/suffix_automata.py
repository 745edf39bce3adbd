"""Substring search by broadcast suffix automata of reference shards.

The reference is cut into shards of a bounded number of words, and a task builds the suffix automaton of each.  The shards are
broadcast one after the other; every document is streamed through the automaton for its matching statistics (the length of
the longest match that ends at each word), and the maximal spans where it reaches the threshold are kept.

Its work is (words of the documents) x (number of shards).  That is right for a reference of a stated size, such as a list of
passages or an older release.  Where the corpus is its own reference the work grows with the square of the input, and the op6
query uses `substring_dedup.repeated_windows` instead, which finds the same windows; the README has the figures of both.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import runs, slices, utf8, word_hash, words
from .shared import Scratch, materialize
from .substring_dedup import WINDOW, _numbered

#: Words of a shard; one automaton takes about 45 bytes a word when broadcast and some 15 times that inside a task.
SHARD_WORDS = 200_000


def build(tokens: list[int], base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix automaton of `tokens` (each below `base`): sorted edge keys state * base + token, their targets, and each state's longest length, link and first end."""
    after: list[dict[int, int]] = [{}]
    length, link, first = [0], [-1], [-1]
    last = 0
    for end, token in enumerate(tokens):
        new = len(after)
        after.append({})
        length.append(length[last] + 1)
        first.append(end)
        link.append(0)
        at = last
        while at >= 0 and token not in after[at]:
            after[at][token] = new
            at = link[at]
        if at >= 0:
            old = after[at][token]
            if length[old] == length[at] + 1:
                link[new] = old
            else:
                split = len(after)
                after.append(dict(after[old]))
                length.append(length[at] + 1)
                link.append(link[old])
                first.append(first[old])
                while at >= 0 and after[at].get(token) == old:
                    after[at][token] = split
                    at = link[at]
                link[old] = link[new] = split
        last = new
    keys = np.array([state * base + token for state, edges in enumerate(after) for token in edges], np.int64)
    to = np.array([x for edges in after for x in edges.values()], np.int32)
    order = np.argsort(keys)
    return keys[order], to[order], np.array(length, np.int32), np.array(link, np.int32), np.array(first, np.int32)


def matches(tokens: list[int], base: int, edges: dict[int, int], length: list[int], link: list[int], first: list[int], w: int) -> list[tuple[int, int]]:
    """(end, first end in the shard) of every run of w tokens that the shard holds; tokens below 0 are not in the shard."""
    out, state, have = [], 0, 0
    for end, token in enumerate(tokens):
        if token < 0:
            state = have = 0
            continue
        to = edges.get(state * base + token)
        while to is None and state:
            state = link[state]
            have = length[state]
            to = edges.get(state * base + token)
        if to is None:
            continue
        state, have = to, have + 1
        if have >= w:
            have = w
            while length[link[state]] >= w:
                state = link[state]
            out.append((end, first[state]))
    return out


def _hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, off = utf8(batch.column("body"))
    starts, ends, first = words(data, off)
    return word_hash(data, starts, ends), first


def shards(reference: DataFrame, w: int, shard_words: int) -> DataFrame:
    """(shard, blob): a pickled automaton for each run of about `shard_words` words of rows (doc, sub, body), in order of (doc, sub)."""

    def pack(parts):
        vocabulary = np.unique(np.concatenate([h for _, _, _, h in parts]))
        base = len(vocabulary) + 1
        tokens, doc, sub, begin, at = [], [], [], [], []
        for d, s, a, h in parts:
            doc.append(d)
            sub.append(s)
            begin.append(len(tokens))
            at.append(a)
            tokens += np.searchsorted(vocabulary, h).tolist()
            tokens.append(base - 1)  # ends a part; documents never hold it
        blob = pickle.dumps((vocabulary, base, build(tokens, base), *(np.array(x, np.int64) for x in (doc, sub, begin, at))))
        return pa.RecordBatch.from_arrays([pa.array([int.from_bytes(hashlib.blake2b(blob, digest_size=7).digest(), "little")]), pa.array([blob], pa.binary())], ["shard", "blob"])

    def local(batches):
        parts, n = [], 0
        for batch in slices(batches, "body"):
            h, first = _hashed(batch)
            for i, (d, s) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("sub").to_pylist(), strict=True)):
                own = h[first[i] : first[i + 1]]
                for a in range(0, max(len(own) - w + 1, 0), shard_words):  # pieces of a long text share w - 1 words
                    piece = own[a : a + shard_words + w - 1]
                    parts.append((d, s, a, piece))
                    n += len(piece)
                    if n >= shard_words:
                        yield pack(parts)
                        parts, n = [], 0
        if parts:
            yield pack(parts)

    return reference.sortWithinPartitions("doc", "sub").mapInArrow(local, "shard long, blob binary")


def matching_windows(docs: DataFrame, reference: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", w: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Rows (doc, sub, at, n): windows of w words starting at words at .. at + n - 1 of a document occur in the reference.

    Without a reference the documents are their own, and a window counts if an equal one starts earlier, as in
    `substring_dedup.repeated_windows`, whose rules for words, nulls and shared doc_ids hold here too; the result fits
    `remove_windows`.  Words are compared by 64-bit hashes.  The driver holds one automaton at a time.  Long texts are cut into
    pieces that share w - 1 words; empty tables give empty results; other columns, of whatever names, are ignored.
    """
    spark, scratch, own = docs.sparkSession, Scratch(docs.sparkSession), reference is None

    def rows(df: DataFrame) -> DataFrame:
        return _numbered(df.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body")), "id", "body", ["body"])

    streamed = rows(docs)
    # a task that reads about one shard's text has no shorter automata than asked for, whatever the number of input files
    held = rows(docs if own else reference)
    size = held.agg(F.sum(F.length("body"))).first()[0] or 0
    table = scratch.save(shards(held.repartitionByRange(max(1, size // (6 * shard_words)), "doc", "sub"), w, shard_words), "automata")
    found = []
    for key in [r["shard"] for r in table.select("shard").collect()]:
        blob = spark.sparkContext.broadcast(table.where(F.col("shard") == key).first()["blob"])

        def stream(batches, blob=blob):
            vocabulary, base, (keys, to, *states), ref_doc, ref_sub, begin, ref_at = pickle.loads(blob.value)
            edges = dict(zip(keys.tolist(), to.tolist(), strict=True))
            length, link, first_end = (x.tolist() for x in states)
            for batch in slices(batches, "body"):
                h, first = _hashed(batch)
                if not len(h):
                    continue
                place = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                tokens = np.where(vocabulary[place] == h, place, -1)
                doc, sub = (batch.column(c).to_numpy() for c in ("doc", "sub"))
                out = []
                for i in range(batch.num_rows):
                    hits = matches(tokens[first[i] : first[i + 1]].tolist(), base, edges, length, link, first_end, w)
                    if not hits:
                        continue
                    at, seen = np.array(hits, np.int64).T - (w - 1)
                    if own:
                        part = np.searchsorted(begin, seen, side="right") - 1
                        d, s, a = ref_doc[part], ref_sub[part], ref_at[part] + seen - begin[part]
                        at = at[(d < doc[i]) | ((d == doc[i]) & ((s < sub[i]) | ((s == sub[i]) & (a < at))))]
                    if len(at):
                        begins = np.append(True, np.diff(at) > 1)
                        r, n = runs(begins, len(at))
                        out += [(doc[i], sub[i], x, y) for x, y in zip(at[r].tolist(), n.tolist(), strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["doc", "sub", "at", "n"])

        found.append(scratch.save(streamed.mapInArrow(stream, "doc long, sub int, at int, n int"), "spans"))
        blob.destroy()
    if not found:
        found = [spark.createDataFrame([], "doc long, sub int, at int, n int")]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    out = materialize(out, "spans")
    scratch.clear()
    return out
