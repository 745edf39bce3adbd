"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector, ordered thresholds.  x holds 1 + log counts of terms (words and word beginnings) chosen by
association with toxic labels in a bounded labelled sample.  Training is Fisher scoring: every step is one Spark job that sums scores
and information over the labelled rows' partitions; only sums of (terms + thresholds) squared numbers reach the driver.
Grades are the labels given.  With labels 0 and 1 there is one threshold and severity is the probability of 1; with more
grades the same weights serve all thresholds.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices
from .shared import join_small, materialize

#: The model is fitted on at most about this many labelled rows, drawn by hash of doc_id, and on the MAX_TERMS terms of the largest chi-square.
MAX_LABELLED, MAX_TERMS = 20_000, 512
CHI2, MIN_DOCS, MIN_SHARE = 15.0, 3, 0.001
_TERM = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """A lower-case word and its beginnings of four and five letters (marked by a trailing hyphen)."""
    return [word, *[word[:n] + "-" for n in (4, 5) if len(word) > n]]


def terms(text: str | None) -> list[str]:
    return _TERM.findall((text or "").lower())


def hits(text: str | None, place: dict[str, int], heads: set[str]) -> dict[int, int]:
    """Counts of the chosen features in a text."""
    counts: dict[int, int] = {}
    for word in terms(text):
        if word[:4] in heads:
            for x in features(word):
                if (i := place.get(x)) is not None:
                    counts[i] = counts.get(i, 0) + 1
    return counts


def link_probabilities(eta: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x K) grade probabilities and the (n x K - 1) densities at the thresholds."""
    g = 1 / (1 + np.exp(-np.clip(theta[None, :] - eta[:, None], -30, 30)))
    edge = np.concatenate([np.zeros((len(eta), 1)), g, np.ones((len(eta), 1))], 1)
    return np.maximum(np.diff(edge, axis=1), 1e-12), g * (1 - g)


def _sums(x: np.ndarray, y: np.ndarray, theta: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Score, expected information and log-likelihood at (theta, w)."""
    p, d = link_probabilities(x @ w, theta)
    n, k, size = len(y), p.shape[1], len(theta) + len(w)
    score, info = np.zeros(size), np.zeros((size, size))
    for grade in range(k):
        up = d[:, grade] if grade < k - 1 else np.zeros(n)
        down = d[:, grade - 1] if grade else np.zeros(n)
        slope = np.zeros((n, size))
        slope[:, len(theta) :] = -(up - down)[:, None] * x
        if grade < k - 1:
            slope[:, grade] += up
        if grade:
            slope[:, grade - 1] -= down
        own = y == grade
        score += (slope[own] / p[own, grade][:, None]).sum(0)
        info += (slope / p[:, grade][:, None]).T @ slope
    return score, info, float(np.log(p[np.arange(n), y]).sum())


def _step(rows: DataFrame, n_terms: int, theta: np.ndarray, w: np.ndarray):
    def local(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                x = np.zeros((part.num_rows, n_terms))
                for i, (ids, counts) in enumerate(zip(part.column("ids").to_pylist(), part.column("counts").to_pylist(), strict=True)):
                    x[i, ids] = 1 + np.log(counts)
                own = _sums(x, part.column("grade").to_numpy().astype(int), theta, w)
                total = own if total is None else tuple(a + b for a, b in zip(total, own, strict=True))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total[0].tobytes()]), pa.array([total[1].tobytes()]), pa.array([total[2]])], ["score", "info", "like"])

    sums = rows.mapInArrow(local, "score binary, info binary, like double").collect()
    size = n_terms + len(theta)
    return sum(np.frombuffer(r["score"]) for r in sums), sum(np.frombuffer(r["info"]).reshape(size, size) for r in sums), sum(r["like"] for r in sums)


def fit_ordinal(rows: DataFrame, n_terms: int, counts: list[int], steps: int = 20, ridge: float = 0.1):
    """Thresholds and weights from rows (ids, counts, grade); `counts` are the numbers of rows by grade."""
    share = np.clip(np.cumsum(counts)[:-1] / sum(counts), 1e-3, 1 - 1e-3)
    theta, w = np.log(share / (1 - share)), np.zeros(n_terms)
    score, info, like = _step(rows, n_terms, theta, w)
    k = len(theta)
    pull = np.append(np.full(k, 1e-6), np.full(n_terms, ridge))
    damp = 0.0
    worth = lambda value, v: value - ridge / 2 * v @ v
    for _ in range(steps):
        move = np.linalg.solve(info + np.diag(pull + damp * (np.diag(info) + 1e-3)), score - pull * np.append(np.zeros(k), w))
        t, v = theta + move[:k], w + move[k:]
        new = _step(rows, n_terms, t, v) if (np.diff(t) > 1e-6).all() else None
        if new is None or worth(new[2], v) < worth(like, w):
            damp = max(0.03, damp * 4)
            continue
        gain, damp = worth(new[2], v) - worth(like, w), damp / 4
        theta, w, (score, info, like) = t, v, new
        if gain < 1e-4 * max(1.0, -like) and damp < 0.01:
            break
    return theta, w


def toxicity_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED, max_terms: int = MAX_TERMS) -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic) of every row; severity is the expected grade.

    Any integer label of 0 or more is a grade: 0 is not toxic, larger ones are severer; a label that is no whole number is refused.  Null texts count as empty and very long
    ones are read whole; where a doc_id has several labels the largest holds; if the labelled sample has one grade only, every severity
    is 0; if it has several but no term goes with the higher ones, every document has the lowest.  Features that the same labelled rows hold, as far as counts tell (a word and
    its beginnings), count once; of the rest the model takes the `max_terms` of the largest chi-square.  An
    empty table gives an empty result; other columns, of whatever names, are ignored; equal texts get equal scores.
    """
    if labels.where(F.col(label).cast("double") != F.floor(F.col(label).cast("double"))).limit(1).count():
        raise ValueError(f"{label} holds labels that are no whole numbers")
    given = labels.where(F.col(label).isNotNull() & (F.col(label) >= 0) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    rate = min(1.0, max_labelled / max(1, given.count()))
    sample = materialize(given.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) / 1e6 < rate), "labels")
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))

    def counted(batches):
        for batch in slices(batches, "body"):
            each = [sorted({x for word in terms(t) for x in features(word)}) for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(each, pa.list_(pa.string()))], ["label", "terms"])

    known = materialize(join_small(base, sample, "doc_id").select("label", "body"), "labelled")
    low, high = known.agg(F.min("label"), F.max("label")).first()
    above = F.col("label") > F.lit(low if low is not None else 0)  # what a term is associated with: any grade but the lowest
    size = known.agg(F.count("*").alias("n"), F.count_if(above).alias("t")).first()
    kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {kind}, severity double, grade int, p_toxic double, toxic boolean"
    n, t = size["n"], size["t"]
    vocabulary: list[str] = []
    if 0 < t < n:
        seen = known.mapInArrow(counted, "label int, terms array<string>").select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count_if(above).alias("a"), F.count("*").alias("df")).where(F.col("df") >= max(MIN_DOCS, MIN_SHARE * n))
        a, b = F.col("a").cast("double"), (F.col("df") - F.col("a")).cast("double")
        chi2 = n * F.pow(a * (n - t - b) - b * (t - a), F.lit(2.0)) / (F.col("df") * (n - F.col("df")) * float(t) * float(n - t))
        chosen = seen.where((a * (n - t) > b * t) & (F.col("df") < n)).withColumn("chi2", chi2).where(F.col("chi2") >= CHI2)
        alike = F.substring(F.regexp_replace("term", "-$", ""), 1, 4)
        chosen = chosen.groupBy(alike, "a", "df").agg(F.min_by("term", F.struct(F.length("term"), "term")).alias("term"), F.first("chi2").alias("chi2"))
        chosen = chosen.orderBy(F.desc("chi2"), "term").limit(max_terms)
        vocabulary = sorted(r["term"] for r in chosen.select("term").collect())
    if not vocabulary:
        grade = low if t and low != high else 0
        return base.select("doc_id", F.lit(float(grade)).alias("severity"), F.lit(grade).alias("grade"), F.lit(float(grade > 0)).alias("p_toxic"), F.lit(grade > 0).alias("toxic"))
    place = {x: i for i, x in enumerate(vocabulary)}

    heads = {x.rstrip("-")[:4] for x in vocabulary}

    def sparse(batches):
        for batch in slices(batches, "body"):
            found = [hits(t, place, heads) for t in batch.column("body").to_pylist()]
            ids = pa.array([list(c) for c in found], pa.list_(pa.int32()))
            counts = pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), ids, counts], ["label", "ids", "counts"])

    rows = materialize(known.mapInArrow(sparse, "label int, ids array<int>, counts array<int>"), "sparse")
    by_grade = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    levels = sorted(by_grade)
    rank = F.create_map(*[F.lit(x) for i, g in enumerate(levels) for x in (g, i)])
    rows = rows.select("ids", "counts", rank[F.col("label")].alias("grade")).coalesce(8).cache()
    theta, w = fit_ordinal(rows, len(vocabulary), [by_grade[g] for g in levels])
    rows.unpersist()
    worth = np.array(levels, float)

    def score(batches):
        for batch in slices(batches, "body"):
            eta = np.zeros(batch.num_rows)
            for i, body in enumerate(batch.column("body").to_pylist()):
                if body:
                    eta[i] = sum(w[j] * (1 + np.log(c)) for j, c in hits(body, place, heads).items())
            p, _ = link_probabilities(eta, theta)
            toxic = 1 - p[:, 0] if levels[0] == 0 else np.ones(len(eta))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p @ worth), pa.array(worth[p.argmax(1)].astype(np.int32)), pa.array(toxic), pa.array(toxic > 0.5)], ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return base.mapInArrow(score, schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
