"""Periodic run detection: stretches of words that repeat with a small period, found by seeds on diagonals.

Every run of period q and length at least max(24, 3q) agrees with itself q words later on at least max(24 - q, 2q)
words.  Periods are therefore taken in classes, up to 8, up to 16, up to 32 and so on; a class has one seed length, the least
overlap that all its periods guarantee (16, 18, 34, ... words; never less than the period).  Per class the k-grams of every
document are indexed by hash, and each occurrence is paired with the next one in its document.  Because the seed is at least as long as the
period, the next occurrence inside a run is exactly one period away (two periods at once would force a smaller one), so neighbouring
occurrences find every run and no other pairs of a group are needed: a class makes at most one pair a word, all classes n log n.
Pairs whose distance (lag) belongs to the class lie on diagonals; a stretch of seeds is extended both ways word by word, and a table
of the furthest covered word for each document and lag skips seeds that a former extension has covered.

Texts are handled in slices inside map tasks; nothing is shuffled, and a text is never split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ODD, mix, ngrams, slices, utf8, word_hash, words
from .shared import positional

MIN_LENGTH = 24
MIN_REPEATS = 3
#: Words compared at once when a seed is extended; doubled as long as all agree.
STEP = 32


def classes(longest: int, min_length: int = MIN_LENGTH, repeats: int = MIN_REPEATS) -> list[tuple[int, int, int]]:
    """(least period, greatest period, seed length) of each class that a text of `longest` words can hold.

    A run of period q overlaps itself on at least max(min_length - q, (repeats - 1) q) words; the seed is the least of it
    over the class and no shorter than its greatest period.
    """
    out, low, high = [], 1, max(1, min_length // repeats)
    while low * repeats <= longest and low <= longest - 1:
        seed = min(max(min_length - q, (repeats - 1) * q) for q in (low, high, *range(low, min(high, min_length) + 1)))
        out.append((low, high, seed))
        low, high = high + 1, 2 * high
    return out


def _reach(h: np.ndarray, lag: int, at: int, end: int, forward: bool) -> int:
    """The furthest word (exclusive going forward, inclusive going back) that still equals the word `lag` later."""
    step = STEP
    while True:
        if forward:
            to = min(at + step, end)
            differ = np.flatnonzero(h[at:to] != h[at + lag : to + lag])
            if len(differ):
                return at + int(differ[0])
            if to == end:
                return end
        else:
            to = max(at - step, end)
            differ = np.flatnonzero(h[to:at] != h[to + lag : at + lag])
            if len(differ):
                return to + int(differ[-1]) + 1
            if to == end:
                return end
        at, step = to, 2 * step


def find_runs(h: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH, repeats: int = MIN_REPEATS) -> list[tuple[int, int, int, int]]:
    """Runs (text, start, length, period) of a slice of texts; h: word hashes of all texts, first: each text's first word."""
    sizes = np.diff(first)
    of = np.repeat(np.arange(len(sizes)), sizes)
    covered: dict[tuple[int, int], int] = {}
    found = []
    for low, high, k in classes(int(sizes.max(initial=0)), min_length, repeats):
        i = np.arange(len(h) - k + 1) if len(h) >= k else np.zeros(0, np.int64)
        i = i[(i + k <= first[of[i] + 1]) & (sizes[of[i]] >= max(min_length, repeats * low))]
        if not len(i):
            continue
        key = mix(ngrams(h, k)[i] + of[i].astype(np.uint64) * ODD)
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        left, right = i[order[:-1][same]], i[order[1:][same]]
        lag = right - left
        keep = (lag >= low) & (lag <= high) & (of[left] == of[right])
        left, lag = left[keep], lag[keep]
        if not len(left):
            continue
        order = np.lexsort((left, lag))
        left, lag = left[order], lag[order]
        new = np.append(True, (left[1:] != left[:-1] + 1) | (lag[1:] != lag[:-1]))
        for seed, q in zip(left[new].tolist(), lag[new].tolist(), strict=True):
            text = int(of[seed])
            if covered.get((text, q), -1) > seed:
                continue
            lo, hi = int(first[text]), int(first[text + 1])
            begin = _reach(h, q, seed, lo, False)
            end = _reach(h, q, seed, hi - q, True)
            covered[text, q] = end
            length = end + q - begin
            if end - seed >= k and length >= max(min_length, repeats * q):
                found.append((text, begin - lo, length, q))
    return sorted(found)


def periodic_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, repeats: int = MIN_REPEATS) -> DataFrame:
    """The documents plus n_words, runs (array of start, length, period; by start, then period) and collapsed.

    Words are runs of bytes other than ASCII white space, equal where their bytes are (by 64-bit hash).  A run is a maximal stretch of
    length >= max(min_length, repeats * period), period being its smallest.  `collapsed` holds the words that no run
    repeats, joined by one space: those in no run and the first period of each run, unless another run repeats it.  Null and empty texts have
    no words, no runs and an empty collapsed text.  Rows are judged one by one, so repeated rows and ids, null ids and
    ties give equal results; columns named n_words, runs or collapsed are replaced, all others are kept; an empty table gives an
    empty result; a very long text is one row in memory.
    """
    if repeats < 3:
        raise ValueError("the seeds need at least three repeats")
    own, names = positional(docs, ("n_words", "runs", "collapsed"))
    body = f"c{names.index(text)}"
    columns = own.columns
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def detect(batches):
        for batch in slices(batches, body):
            data, off = utf8(batch.column(body))
            starts, ends, first = words(data, off)
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for t, start, length, q in find_runs(word_hash(data, starts, ends), first, min_length, repeats):
                found[t].append({"start": start, "length": length, "period": q})
            raw, out = data.tobytes(), []
            for t, own_runs in enumerate(found):
                if not own_runs:
                    own_words = raw[off[t] : off[t + 1]].split()
                else:
                    n = int(first[t + 1] - first[t])
                    edge = np.zeros(n + 1, np.int64)
                    for r in own_runs:
                        edge[r["start"] + r["period"]] += 1
                        edge[r["start"] + r["length"]] -= 1
                    keep = np.flatnonzero(np.cumsum(edge[:n]) == 0) + int(first[t])
                    own_words = [raw[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]
                out.append(b" ".join(own_words))
            held = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*held, pa.array(np.diff(first)), pa.array(found, pa.list_(run)), pa.array(out, pa.binary()).cast(pa.string())], [*columns, "n_words", "runs", "collapsed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.mapInArrow(detect, f"{schema}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").toDF(*names, "n_words", "runs", "collapsed")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, with the periodic tails that the query's contract plants into a tenth of the documents (by crc32 of the id)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    held = docs.select("doc_id", "text", h.alias("h"), F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')").alias("w"))
    rows = held.withColumn("n", F.size("w").cast("long")).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.expr("try_mod(g, n)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.expr("concat_ws(' ', transform(sequence(0L, n - 1), i -> get(w, cast(if(i < a, i, a + (i - a) % p) as int))))")
    return rows.select("doc_id", F.when(F.expr("h % 10 = 0 and n > 0"), tail).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The digest columns of the query from the operator's rows."""
    runs = "concat(start, ',', length, ',', period, '\n')"
    text = F.expr(f"concat_ws('', transform(runs, r -> {runs.replace('start', 'r.start').replace('length', 'r.length').replace('period', 'r.period')}))")
    # length / period compared exactly, by cross products (both fit easily in 64 bits); runs come by start, then period
    best = F.expr("aggregate(slice(runs, 2, greatest(size(runs) - 1, 0)), get(runs, 0), (b, r) -> if(r.length * b.period > b.length * r.period, r, b))")
    best = F.when(F.size("runs") > 0, best)
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return run_digests(periodic_runs(planted(docs)))
