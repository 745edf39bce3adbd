"""Substring dedup: remove every word inside a window of `w` words that also starts earlier in the corpus.

Windows are found by content-chosen anchors: of the k-grams inside a window, the one with the least hash (leftmost on
ties) is its anchor, so equal windows have equal anchors.  Map tasks emit one row per anchor with the 64-bit hashes of the
windows it stands for; rows meet by anchor hash, groups stream in sorted order, and every window that has an
earlier equal one on its anchor is flagged: both 64-bit hashes must agree.  Windows that repeat inside one batch are settled there by
the window hash alone, so a passage that many documents share reaches the shuffle once per batch.  An anchor with more rows than a task
should hold is passed on window by window and settled by an aggregation over (anchor, window).  Texts without a repeated window are not
shuffled (as far as a filter of fixed size can tell them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import later_copies, mix, ngrams, runs, slices, sorted_pieces, utf8, word_hash, words
from .shared import Scratch, filter_table, join_small, materialize, positional, with_passes

WINDOW = 20
GRAM = 10
_NO_DOC = -(1 << 63)
#: An anchor with more rows than this is not held in one task.
CROWD = 200_000
_ROWS = "a long, doc long, sub int, at int, n int, keys binary"


def _by_document(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """The batch in order of (doc, sub), and the numbers of its documents in that order."""
    doc, sub = (batch.column(c).to_numpy() for c in ("doc", "sub"))
    order = np.lexsort((sub, doc))
    if (np.diff(order) != 1).any():
        batch, doc, sub = batch.take(pa.array(order)), doc[order], sub[order]
    return batch, np.cumsum(np.append(True, (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]))[: len(doc)])


def _numbered(docs: DataFrame, doc_id: str, text: str, keep: list[str]) -> DataFrame:
    """docs with doc (doc_id, null least) and sub: 0, or a rank by text where a doc_id has several texts."""
    rows = docs.withColumn("doc", F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_DOC))).withColumn("rid", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    twins = rows.groupBy("doc").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo <> hi").select("doc")
    if not twins.limit(1).count():
        return rows.select(*keep, "doc", F.lit(0).alias("sub"))
    twins = materialize(twins, "twins")
    order = Window.partitionBy("doc").orderBy("rid")
    ranks = join_small(rows.select("doc", "rid"), twins, "doc", "left_semi").distinct().withColumn("sub", F.row_number().over(order) - 1)
    return join_small(rows, materialize(ranks, "twins"), ["doc", "rid"], "left").select(*keep, "doc", F.coalesce("sub", F.lit(0)).alias("sub"))


def least_grams(g: np.ndarray, span: int) -> np.ndarray:
    """For every run of `span` entries, the position of the least one, leftmost on ties."""
    value, at, have = g, np.arange(len(g), dtype=np.int64), 1
    while have < span:
        step = min(have, span - have)
        n = len(value) - step
        right = value[step:] < value[:n]
        value, at, have = np.where(right, value[step:], value[:n]), np.where(right, at[step:], at[:n]), have + step
    return at


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", w: int = WINDOW, k: int = GRAM) -> DataFrame:
    """Rows (doc, sub, at, n): windows starting at words at .. at + n - 1 of a document have an earlier equal window.

    Words are runs of bytes other than ASCII white space, unchanged.  Null and short texts have no windows.  A null
    doc_id counts as smaller than any other.  Rows of one doc_id and text count as one document; different texts of one doc_id
    are documents of their own (sub), in order of a hash of the text.  A very long text is one row in memory.  Other columns, of whatever
    names, are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)

    def emit(a, doc, sub, at, n, keys):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(doc), pa.array(sub), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), keys], ["a", "doc", "sub", "at", "n", "keys"])

    def local(batches):
        for batch in slices(batches, "body"):
            batch, number = _by_document(batch)
            data, off = utf8(batch.column("body"))
            starts, ends, first = words(data, off)
            h = word_hash(data, starts, ends)
            if len(h) < w:
                continue
            of = np.repeat(np.arange(len(first) - 1), np.diff(first))
            i = np.arange(len(h) - w + 1)
            i = i[i + w <= first[of[i] + 1]]
            if not len(i):
                continue
            grams = ngrams(h, k)
            anchor = least_grams(grams, w - k + 1)[i]
            key = ngrams(h, w)[i]
            row = of[i]
            at = i - first[row]
            late = later_copies(key, number[row], at)
            begins = np.ones(len(i), bool)
            begins[1:] = (i[1:] != i[:-1] + 1) | (row[1:] != row[:-1]) | (late[1:] != late[:-1]) | (~late[1:] & (anchor[1:] != anchor[:-1]))
            r, n = runs(begins, len(i))
            doc, sub, at = batch.column("doc").to_numpy()[row[r]], batch.column("sub").to_numpy()[row[r]], at[r]
            gone = late[r]
            if gone.any():
                yield emit(mix(doc[gone].view(np.uint64) + at[gone].astype(np.uint64)), doc[gone], sub[gone], at[gone], n[gone], pa.nulls(int(gone.sum()), pa.binary()))
            held = ~gone
            m = n[held]
            whole = key[~late].astype("<u8")
            keys = pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(np.append(0, np.cumsum(m) * 8).astype(np.int32)), pa.py_buffer(whole)])
            yield emit(grams[anchor[r[held]]], doc[held], sub[held], at[held], m, keys)

    def spans(doc, sub, at, n, a=None, key=None):
        none = pa.nulls(len(doc), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(sub), pa.array(at), pa.array(n), none if a is None else pa.array(a), none if key is None else pa.array(key.view(np.int64))], ["doc", "sub", "at", "n", "a", "key"])

    def merge(batches):
        for table, whole in sorted_pieces(batches, "a", CROWD):
            a, doc, sub, at, n = (table.column(c).to_numpy() for c in ("a", "doc", "sub", "at", "n"))
            keys = table.column("keys").combine_chunks()
            keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
            done = keys.is_null().to_numpy(zero_copy_only=False)
            if done.any():
                yield spans(doc[done], sub[done], at[done], n[done])
            same = np.full(len(a), not whole)
            same[1:] |= a[1:] == a[:-1]
            same[:-1] |= a[1:] == a[:-1]
            rows = np.flatnonzero(same & ~done)
            if not len(rows):
                continue
            rows = rows[np.lexsort((at[rows], sub[rows], doc[rows]))]
            key = np.frombuffer(b"".join(keys.take(pa.array(rows)).to_pylist()), "<u8")
            of = np.repeat(rows, n[rows])
            step = np.arange(len(of)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
            start = at[of] + step
            if not whole:
                yield spans(doc[of], sub[of], start.astype(np.int32), np.ones(len(of), np.int32), a[of], key)
                continue
            number = np.cumsum(np.append(True, (doc[of][1:] != doc[of][:-1]) | (sub[of][1:] != sub[of][:-1])))
            group = np.cumsum(np.append(True, a[1:] != a[:-1]))[of]
            order = np.lexsort((key, group))
            new = np.ones(len(of), bool)
            new[1:] = (group[order][1:] != group[order][:-1]) | (key[order][1:] != key[order][:-1])
            pair = np.empty(len(of), np.int64)
            pair[order] = np.cumsum(new)  # a number for each distinct (anchor, window hash)
            late = later_copies(pair, number, start)
            of, start = of[late], start[late]
            if len(of):
                begins = np.ones(len(of), bool)
                begins[1:] = (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1)
                r, m = runs(begins, len(of))
                yield spans(doc[of[r]], sub[of[r]], start[r].astype(np.int32), m.astype(np.int32))

    rows = _numbered(docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body")), "id", "body", ["body"])
    met = rows.mapInArrow(local, _ROWS).repartition("a").sortWithinPartitions("a")
    found = scratch.save(met.mapInArrow(merge, "doc long, sub int, at int, n int, a long, key long"), "windows")
    crowd, place = found.where("a is not null"), F.struct("doc", "sub", "at")
    first = crowd.groupBy("a", "key").agg(F.min(place).alias("first"), F.count("*").alias("m")).where("m > 1").select("a", "key", "first")
    crowd = crowd.join(first, ["a", "key"]).where(place > F.col("first"))
    out = materialize(found.where("a is null").select("doc", "sub", "at", "n").unionByName(crowd.select("doc", "sub", "at", "n")), "repeats")
    scratch.clear()
    return out


def remove_windows(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text", w: int = WINDOW) -> DataFrame:
    """The documents with the words of the found windows removed and the rest joined by one space, plus n_words and n_removed.

    Columns of those two names are replaced; all others, of whatever names, are kept.  A null text becomes an empty one.
    """
    own, names = positional(docs, ("n_words", "n_removed"))
    body = f"c{names.index(text)}"
    spans = materialize(found.groupBy("doc", "sub").agg(F.collect_list(F.struct("at", "n")).alias("spans")), "spans")
    held = _numbered(own, f"c{names.index(doc_id)}", body, own.columns)
    def cut(batches):
        for batch in slices(batches, body):
            kept, count, removed = [], [], []
            for words, spans in zip(batch.column(body).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                own = (words or "").encode().split()
                n = len(own)
                if spans:
                    edge = np.zeros(n + 1, np.int64)
                    at = np.array([s["at"] for s in spans])
                    to = at + np.array([s["n"] for s in spans]) + w - 1
                    np.add.at(edge, np.minimum(at, n), 1)
                    np.add.at(edge, np.minimum(to, n), -1)
                    keep = (np.cumsum(edge[:-1]) == 0).tolist()
                    own = [x for x, k in zip(own, keep, strict=True) if k]
                kept.append(b" ".join(own))
                count.append(n)
                removed.append(n - len(own))
            columns = [batch.column(c) for c in columns_in]
            columns[columns_in.index(body)] = pa.array(kept, pa.binary()).cast(batch.column(body).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count, pa.int64()), pa.array(removed, pa.int64())], [*columns_in, "n_words", "n_removed"])

    columns_in = own.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    table = materialize(filter_table(spans.select(F.xxhash64("doc", "sub").alias("x"))), "filter")
    held = with_passes(held, F.xxhash64("doc", "sub"), table, "may")
    rest = held.where("not may").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    some = held.where("may").join(spans, ["doc", "sub"], "left")
    both = [x.select(*columns_in, "spans").mapInArrow(cut, f"{schema}, n_words long, n_removed long") for x in (rest, some)]
    return both[0].unionByName(both[1]).toDF(*names, "n_words", "n_removed")


ORACLE_OP6 = r"""
WITH split AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM split WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM late) GROUP BY doc_id),
kept AS (SELECT s.doc_id, w, coalesce(ps, []) AS ps FROM split s LEFT JOIN gone g USING (doc_id)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM kept),
text AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS t FROM words x LEFT JOIN (SELECT doc_id, unnest(ps) AS p FROM gone) g ON x.doc_id = g.doc_id AND x.p = g.p WHERE g.p IS NULL GROUP BY x.doc_id)
SELECT k.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM kept k LEFT JOIN text t USING (doc_id)"""


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = remove_windows(docs, repeated_windows(docs))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
