"""Line dedup: repeated lines stay only in the first document that holds them; results are per-document keep bitmaps.

Method: lines are hashed (128 bits), hashes are range-partitioned (by fixed borders, as hashes are spread evenly, so no
sample is needed) and sorted by (hash, document, position), and one streaming pass keeps first occurrences.  Each task first settles what it can by itself: a line that a smaller document
of the same batch holds is dropped there at once, so a very common line reaches the shuffle once per batch, not once
per document.  Texts are not moved until `apply_keep_bitmaps` joins the bitmaps of texts that lose lines; other texts stay where they are.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, slices
from .shared import filter_table, materialize, positional, with_passes

MIN_CODE_POINTS = 10
STRIPPED = b" \t\n\x0b\x0c\r"
_NO_DOC = -(1 << 63)
_ROWS = "h1 long, h2 long, doc long, rid long, pos array<int>, done boolean"


def _row_id(doc_id: str, text: str):
    return F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit("")))


def _doc(doc_id: str):
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_DOC))


def _n_lines(text):
    return F.size(F.split(F.coalesce(text, F.lit("")), "\n")).cast("long")


def line_key(line: bytes, table: bytes) -> bytes:
    return line.strip(STRIPPED).translate(table)


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """One row per distinct (doc_id, text): rid, doc_id, n_lines, n_dropped, keep_bitmap (zlib of packed bits; null: keep all).

    A key is the line without ASCII white space at its ends, A-Z lowered.  A key of at least `min_code_points` code
    points keeps its lines only in the smallest doc_id that holds it.  Null text is one empty line; a null doc_id counts
    as smaller than any other; rows that share a doc_id count as one document; equal rows get equal results; other
    columns, of whatever names, are ignored; a very long text is one row in memory; an empty table gives an empty result.
    """

    def local(batches):
        import xxhash

        lower = LOWER.tobytes()
        for batch in slices(batches, "body", 8 << 20):
            holders: dict[bytes, dict] = {}
            for doc, rid, body in zip(batch.column("doc").to_pylist(), batch.column("rid").to_pylist(), batch.column("body").to_pylist(), strict=True):
                for i, line in enumerate(body.encode().split(b"\n")):
                    key = line_key(line, lower)
                    if len(key) >= min_code_points and (len(key) >= 4 * min_code_points or len(key.decode()) >= min_code_points):
                        holders.setdefault(xxhash.xxh3_128_digest(key), {}).setdefault((doc, rid), []).append(i)
            out: list[tuple] = []
            gone: dict[tuple, list] = {}
            for digest, where in holders.items():
                least = min(doc for doc, _ in where)
                h1, h2 = int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
                for (doc, rid), pos in where.items():
                    if doc == least:
                        out.append((h1, h2, doc, rid, pos, False))
                    else:
                        gone.setdefault((doc, rid), []).extend(pos)
            out += [(rid * 0x9E3779B97F4A7C1 % (1 << 63), 0, doc, rid, pos, True) for (doc, rid), pos in gone.items()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["h1", "h2", "doc", "rid", "pos", "done"])

    def stream(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc = (batch.column(c).to_numpy() for c in ("h1", "h2", "doc"))
            done = batch.column("done").to_numpy(zero_copy_only=False)
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new[0] = last is None or last[:2] != (h1[0], h2[0])
            first = np.maximum.accumulate(np.where(new, np.arange(len(h1)), -1))
            least = np.where(first >= 0, doc[np.maximum(first, 0)], last[2] if last else 0)
            last = (h1[-1], h2[-1], least[-1])
            dropped = pa.array(done | (doc != least))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(dropped) for c in ("doc", "rid", "pos")], ["doc", "rid", "pos"])

    doc = _doc(doc_id).alias("doc")
    rows = docs.select(doc, _row_id(doc_id, text).alias("rid"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    border = F.floor((F.shiftright("h1", 32) + F.lit(1 << 31)) * ranges / F.lit(float(1 << 32))).cast("int")
    ranged = rows.mapInArrow(local, _ROWS).repartitionById(ranges, border).sortWithinPartitions("h1", "h2", "doc", "rid")
    drops = (
        ranged.mapInArrow(stream, "doc long, rid long, pos array<int>")
        .groupBy("doc", "rid")
        .agg(F.array_distinct(F.flatten(F.collect_list("pos"))).alias("pos"))
    )
    lines = (
        docs.select(doc, _row_id(doc_id, text).alias("rid"), F.col(doc_id).alias("doc_id"), _n_lines(F.col(text)).alias("n_lines"))
        .groupBy("doc", "rid")
        .agg(F.first("doc_id").alias("doc_id"), F.max("n_lines").alias("n_lines"))
    )

    def bitmap(batches):
        for batch in batches:
            maps = []
            for n, pos in zip(batch.column("n_lines").to_pylist(), batch.column("pos").to_pylist(), strict=True):
                if pos is None:
                    maps.append(None)
                    continue
                keep = np.ones(n, bool)
                keep[pos] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
            gone = [0 if p is None else len(p) for p in batch.column("pos").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), batch.column("n_lines"), pa.array(gone, pa.int64()), pa.array(maps, pa.binary())], ["rid", "doc_id", "n_lines", "n_dropped", "keep_bitmap"])

    kind = dict(docs.dtypes)[doc_id]
    return lines.join(drops, ["doc", "rid"], "left").drop("doc").mapInArrow(bitmap, f"rid long, doc_id {kind}, n_lines long, n_dropped long, keep_bitmap binary")


def apply_keep_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with only the kept lines in their text, plus n_lines and n_dropped. A null text stays null.

    Columns of those two names are replaced; all others, of whatever names, are kept.  Only texts that lose lines (and, by
    chance of a filter of fixed size, a few others) are shuffled; the others pass by in one projection.
    """
    own, names = positional(docs, ("n_lines", "n_dropped"))
    columns, body, key = own.columns, f"c{names.index(text)}", f"c{names.index(doc_id)}"
    bits = bitmaps.where("keep_bitmap is not null").select(_doc("doc_id").alias("doc"), "rid", F.col("keep_bitmap").alias("bits"))
    bits = materialize(bits, "bitmaps")
    table = materialize(filter_table(bits.select(F.col("rid").alias("x"))), "filter")
    held = with_passes(own.withColumn("doc", _doc(key)).withColumn("rid", _row_id(key, body)), F.col("rid"), table, "touched")
    counted = held.withColumn("n_lines", _n_lines(F.col(body)))
    untouched = counted.where("not touched").select(*columns, "n_lines", F.lit(0).cast("long").alias("n_dropped"))
    touched = counted.where("touched").join(bits, ["doc", "rid"], "left")

    def cut(batches):
        for batch in slices(batches, body, 8 << 20):
            texts = []
            gone = []
            for words, n, bits in zip(batch.column(body).to_pylist(), batch.column("n_lines").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                gone.append(0)
                if bits is not None:
                    keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=n).tolist()
                    gone[-1] = n - sum(keep)
                    words = words if words is None else "\n".join([line for line, k in zip(words.split("\n"), keep, strict=True) if k])
                texts.append(words)
            out = [batch.column(c) for c in columns]
            out[columns.index(body)] = pa.array(texts, batch.column(body).type)
            yield pa.RecordBatch.from_arrays([*out, batch.column("n_lines"), pa.array(gone, pa.int64())], [*columns, "n_lines", "n_dropped"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    shorter = touched.select(*columns, "n_lines", "bits").mapInArrow(cut, f"{schema}, n_lines long, n_dropped long")
    return untouched.unionByName(shorter).toDF(*names, "n_lines", "n_dropped")


#: The hashes of lines and keys as in `keep_bitmaps`, without hash collisions.
ORACLE_OP9 = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), first AS (SELECT key, min(doc_id) AS holder FROM keyed WHERE length(key) >= 10 GROUP BY key),
kept AS (SELECT k.doc_id, k.no, k.line, coalesce(f.holder, k.doc_id) = k.doc_id AS stays FROM keyed k LEFT JOIN first f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (stays), '')) AS kept_sha256
FROM kept GROUP BY doc_id"""


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = apply_keep_bitmaps(docs, keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
