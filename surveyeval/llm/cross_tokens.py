"""Cross-tokenizer alignment: which tokens of vocabulary A cover the same bytes as which tokens of vocabulary B.

Both tokenisations of a text spell the same bytes, so token ends are byte offsets; offsets where both end cut the tokens into groups.
A byte-level BPE (A) and a sentence-piece model (B) spell most words alike: an array made once maps each A id to the B id
of the same bytes, and groups of one such pair are counted in vectors as long as the vocabulary, one per task.  Only
the links of irregular groups are pairs that shuffle, and they are counted per slice of texts before they do.

Texts are tokenised once; a table in the shared folder keeps each document's distinct links.  From the counts (documents that hold a
pair) three lookups of bounded size are broadcast: counts by A id of the identity map, the highest count of each A id (both as
long as vocabulary A), and pairs that hold at least a HEAVY-th of all irregular rows (at most HEAVY pairs).  What is left has no hot key
and is joined by pair, then summed by document.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import slices, utf8
from .shared import materialize, positional

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A pair in at least one of so many irregular rows is heavy; there are at most so many heavy pairs.
HEAVY = 50_000
#: B ids take the low bits of a pair's key.
B_BITS = 20
#: Irregular rows that a task counts at once.
COUNTED = 2_000_000
#: The split of the byte-level vocabulary (fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Tokens:
    """The bytes of every id of a vocabulary: `blob` cut by `off`; ids without bytes (control tokens) are empty."""

    def __init__(self, spelled: list[bytes]) -> None:
        self.spelled = spelled
        self.length = np.array([len(x) for x in spelled], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(spelled), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        at = np.repeat(self.begin[ids] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return self.blob[at].tobytes()


def a_tokens(file: bytes) -> Tokens:
    held = json.loads(file)
    letters, vocab = byte_letters(), held["model"]["vocab"]
    special = {x["content"] for x in held.get("added_tokens", [])}
    out = [b""] * (max([*vocab.values(), *[x["id"] for x in held.get("added_tokens", [])]]) + 1)
    for piece, i in vocab.items():
        if piece not in special:
            out[i] = bytes(letters[c] for c in piece)
    return Tokens(out)


def a_encoder(file: bytes, tokens: Tokens):
    """text -> ids.  Where merges stand in the order of their ids, ranks are ids and the faster encoder gives the same tokens; else the file's own."""
    held = json.loads(file)
    merges = [m if isinstance(m, list) else m.split(" ") for m in held["model"]["merges"]]
    vocab = held["model"]["vocab"]
    made = [vocab["".join(m)] for m in merges]
    plain = held.get("normalizer") is None and not held["model"].get("ignore_merges") and held.get("pre_tokenizer", {}).get("type") == "ByteLevel" and held["pre_tokenizer"].get("use_regex", True) and not held["pre_tokenizer"].get("add_prefix_space")
    if plain and made == sorted(made) and len(set(made)) == len(made) and min(made) >= 256:
        import tiktoken

        own = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={x: i for i, x in enumerate(tokens.spelled) if x}, special_tokens={})
        return own.encode_ordinary
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(file.decode())
    own.encode_special_tokens = True
    return lambda text: own.encode(text, add_special_tokens=False).ids


def b_tokens(file: bytes) -> Tokens:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=file)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else piece.replace("▁", " ").encode())
    return Tokens(out)


def identity_map(a: Tokens, b: Tokens) -> np.ndarray:
    """For each A id the B id of the same bytes, -1 where there is none; of several (a piece and a byte) the greatest."""
    ids = {x: i for i, x in enumerate(b.spelled) if x}
    return np.array([ids.get(x, -1) if x else -1 for x in a.spelled], np.int64)


def align(a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray):
    """Groups and links of two tokenisations of the same bytes, given the ends of their tokens.

    Returns (group of each A token, group of each B token, number of groups, A index of each link, B index of each link).
    Two tokens overlap in one stretch of bytes, and every end of either ends one such stretch: links are the distinct ends.
    """
    to_b, to_a = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)
    both_a, both_b = end_b[to_b] == end_a, end_a[to_a] == end_b
    group_a, group_b = np.cumsum(both_a) - both_a, np.cumsum(both_b) - both_b
    only_b = np.flatnonzero(~both_b)
    return group_a, group_b, int(both_a.sum()), np.concatenate([np.arange(len(a)), to_a[only_b]]), np.concatenate([to_b, only_b])


def spell_groups(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3;` of all groups as bytes, and the end of each group's text in them."""
    in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
    ids = np.empty(len(a) + len(b), np.int64)
    mark = np.full(len(ids), ord(","), np.uint8)
    ids[np.arange(len(a)) + (upto_b - in_b)[group_a]] = a
    ids[np.arange(len(b)) + upto_a[group_b]] = b
    last = upto_a + upto_b
    mark[last - 1] = ord(";")
    mark[last - in_b - 1] = ord("|")
    digits = 1 + (ids > 9) + (ids > 99) + (ids > 999) + (ids > 9999) + (ids > 99999)
    end = np.cumsum(digits + 1)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    out[end - 1] = mark
    rows, place, rest = np.arange(len(ids)), end - 2, ids
    while len(rows):
        tens = rest // 10
        out[place] = (rest - 10 * tens + 48).astype(np.uint8)
        more = tens > 0
        rows, place, rest = rows[more], place[more] - 1, tens[more]
    return out, end[last - 1]


def _file(spark, path: str) -> bytes:
    """A vocabulary file (a few MB at most), by the driver's own path or one that Spark reads."""
    if os.path.exists(path):
        with open(path, "rb") as held:
            return held.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").head()[0])


def _packed(values: np.ndarray, cuts: np.ndarray, kind: str) -> pa.Array:
    """One binary per row from values cut at `cuts` (one more than rows)."""
    data = values.astype(kind)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * data.itemsize).astype(np.int32)), pa.py_buffer(data.tobytes())])


def tokenised(docs: DataFrame, text: str = "text", a_path: str = f"{FOLDER}/{A_FILE}", b_path: str = f"{FOLDER}/{B_FILE}") -> DataFrame:
    """The documents without their text, with row, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct links of each.

    Links of the identity map are ids (A ids) and times; all others are pairs (A id, B id in one long) and pair_times; all four are packed arrays.
    """
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((_file(spark, a_path), _file(spark, b_path)))
    columns, body = [c for c in docs.columns if c != text], text
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name != text)

    def measure(batches):
        import sentencepiece

        a_file, b_file = files.value
        a_words, b_words = a_tokens(a_file), b_tokens(b_file)
        same, encode_a, encode_b = identity_map(a_words, b_words), a_encoder(a_file, a_words), sentencepiece.SentencePieceProcessor(model_proto=b_file).encode
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, body):
            data, off = utf8(batch.column(body))
            raw, texts = data.tobytes(), batch.column(body).to_pylist()
            some = [i for i, t in enumerate(texts) if t]
            both = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            held = []
            for i, pieces in zip(some, encode_b([texts[i] for i in some], num_threads=1) if some else [], strict=True):
                a, b = np.array(encode_a(" " + texts[i]), np.int64), np.array(pieces, np.int64)
                want = b" " + raw[off[i] : off[i + 1]]
                if a_words.join(a) == want and b_words.join(b) == want:
                    held.append(i)
                    both[0].append(a)
                    both[1].append(b)
            n = batch.num_rows
            n_a, n_b, n_groups, digests = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [""] * n
            n_a[held], n_b[held] = [len(x) for x in both[0][1:]], [len(x) for x in both[1][1:]]
            a, b = np.concatenate(both[0]), np.concatenate(both[1])
            group_a, group_b, groups, link_a, link_b = align(a, b, np.cumsum(a_words.length[a]), np.cumsum(b_words.length[b]))
            of = np.repeat(np.arange(n), n_a)
            if len(a):
                last = np.cumsum(n_a)[held] - 1
                upto = group_a[last] + 1
                n_groups[held] = np.diff(np.append(0, upto))
                letters, end = spell_groups(a, b, group_a, group_b, groups)
                spelled, begin = letters.tobytes(), 0
                for i, to in zip(held, end[upto - 1].tolist(), strict=True):
                    digests[i] = hashlib.sha256(spelled[begin : to - 1]).hexdigest()
                    begin = to
            where, x, y = of[link_a], a[link_a], b[link_b]
            plain = same[x] == y
            cuts = []
            for rows, value in ((where[plain], x[plain]), (where[~plain], x[~plain] << B_BITS | y[~plain])):
                order = np.lexsort((value, rows))
                rows, value = rows[order], value[order]
                new = np.ones(len(rows), bool)
                new[1:] = (rows[1:] != rows[:-1]) | (value[1:] != value[:-1])
                first = np.flatnonzero(new)
                edges = np.searchsorted(rows[first], np.arange(n + 1))
                cuts += [_packed(value[first], edges, "<i8" if len(cuts) else "<i4"), _packed(np.diff(np.append(first, len(rows))), edges, "<i4")]
            arrays = [pa.array(np.arange(row, row + n)), pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(n_a + n_b - n_groups), pa.array(digests), *cuts]
            row += n
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *arrays], [*columns, *MADE])

    return docs.mapInArrow(measure, f"{schema}row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, ids binary, times binary, pairs binary, pair_times binary")


MADE = ["row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "ids", "times", "pairs", "pair_times"]


def pair_counts(held: DataFrame, vocabulary: int, same: np.ndarray) -> DataFrame:
    """Rows (key, n, plain, best): documents that hold each linked pair, whether it is of the identity map, and the highest n of its A id."""

    def count(batches):
        vector = np.zeros(vocabulary, np.int64)
        keys, size = [], 0

        def flush():
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64)), pa.array(np.zeros(len(key), bool))], ["key", "n", "plain"])

        for batch in batches:
            vector += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<i4"), minlength=vocabulary)
            keys.append(np.frombuffer(b"".join(batch.column("pairs").to_pylist()), "<i8"))
            size += len(keys[-1])
            if size > COUNTED:
                yield flush()
                keys, size = [], 0
        if keys:
            yield flush()
        some = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(some << B_BITS | same[some]), pa.array(vector[some]), pa.array(np.ones(len(some), bool))], ["key", "n", "plain"])

    counts = held.select("ids", "pairs").mapInArrow(count, "key long, n long, plain boolean").groupBy("key", "plain").agg(F.sum("n").alias("n"))
    # an A id has at most as many pairs as B has ids
    return counts.withColumn("best", F.max("n").over(Window.partitionBy(F.shiftright("key", B_BITS))))


def cross_alignment(docs: DataFrame, text: str = "text", a_path: str = f"{FOLDER}/{A_FILE}", b_path: str = f"{FOLDER}/{B_FILE}") -> DataFrame:
    """The documents without their text, plus n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A text is encoded without special tokens, with one space before it.  Null and empty texts, and texts that a vocabulary does not spell byte
    by byte (normalised white space, U+2581), have no tokens: zeros and ''.  A pair's count is the number of rows of `docs` that hold it linked, so a
    repeated row counts again and repeated ids do not matter; n_best are the links whose pair has its A id's highest count, ties
    included.  Columns of those seven names are replaced, all others are kept; an empty table gives an empty result; a very long text is one row in memory.
    """
    spark = docs.sparkSession
    made = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    own, names = positional(docs, tuple(made))
    a_words, b_words = a_tokens(_file(spark, a_path)), b_tokens(_file(spark, b_path))
    same, vocabulary = identity_map(a_words, b_words), len(a_words.spelled)
    body = f"c{names.index(text)}"
    held = materialize(tokenised(own, body, a_path, b_path), "tokens")
    counts = materialize(pair_counts(held, vocabulary, same), "pairs")
    total = counts.where("not plain").agg(F.sum("n")).first()[0] or 0
    heavy = counts.where(f"not plain and n * {HEAVY} >= {total}")
    lookups = np.zeros((2, vocabulary), np.int64)
    for key, n, best in counts.where("plain").select("key", "n", "best").toPandas().itertuples(index=False):
        lookups[:, key >> B_BITS] = n, best
    top = heavy.select("key", "n", "best").toPandas().sort_values("key")
    shared = spark.sparkContext.broadcast((lookups, *[top[c].to_numpy(np.int64) for c in ("key", "n", "best")]))
    columns = [c for c in held.columns if c not in ("ids", "times", "pairs", "pair_times")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields if f.name in columns)

    def score(batches):
        (n_plain, best_plain), heavy_key, heavy_n, heavy_best = shared.value
        for batch in batches:
            rows = batch.num_rows

            def unpack(name, kind, batch=batch):
                parts = batch.column(name).to_pylist()
                return np.frombuffer(b"".join(parts), kind).astype(np.int64), np.array([len(p) for p in parts], np.int64) // np.dtype(kind).itemsize

            ids, sizes = unpack("ids", "<i4")
            times, _ = unpack("times", "<i4")
            of = np.repeat(np.arange(rows), sizes)
            sums, most = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            np.add.at(sums, of, times * n_plain[ids])
            np.add.at(most, of, times * (n_plain[ids] == best_plain[ids]))
            pairs, sizes = unpack("pairs", "<i8")
            times, _ = unpack("pair_times", "<i4")
            of = np.repeat(np.arange(rows), sizes)
            at = np.minimum(np.searchsorted(heavy_key, pairs), max(0, len(heavy_key) - 1))
            hit = heavy_key[at] == pairs if len(heavy_key) else np.zeros(len(pairs), bool)
            np.add.at(sums, of[hit], times[hit] * heavy_n[at[hit]])
            np.add.at(most, of[hit], times[hit] * (heavy_n[at[hit]] == heavy_best[at[hit]]))
            light = ~hit
            edges = np.searchsorted(of[light], np.arange(rows + 1)).astype(np.int32)
            item = pa.StructArray.from_arrays([pa.array(pairs[light]), pa.array(times[light])], ["key", "times"])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(most), pa.array(sums), pa.ListArray.from_arrays(pa.array(edges), item)], [*columns, "n_best", "count_sum", "light"])

    part = held.mapInArrow(score, f"{schema}, n_best long, count_sum long, light array<struct<key:long,times:long>>")
    rest = counts.where(f"not plain and n * {HEAVY} < {total}").select("key", "n", "best")
    light = part.select("row", F.inline("light")).join(rest, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.expr("if(n = best, times, 0)")).alias("top"))
    out = part.drop("light").join(light, "row", "left")
    out = out.withColumn("n_best", F.col("n_best") + F.coalesce("top", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more", F.lit(0)))
    return out.select(*[c for c in own.columns if c != body], *made).toDF(*[c for c in names if c != text], *made)


def op12_cross_tokens(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cross_alignment(docs)
