"""The regression that op1 fits in tasks: its optimum, weights, rows kept out, columns that do not vary; and no job a step."""

import os

import numpy as np
import pyarrow as pa
import pytest

from surveyeval.llm import logistic, quality
from surveyeval.llm.shared import small_batches


def sparse(x: np.ndarray, parts: int = 3) -> logistic.SparseRows:
    rows = logistic.SparseRows(x.shape[1])
    for part in np.array_split(x, parts):
        at = [np.flatnonzero(r) for r in part]
        rows.add(pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([r[a] for r, a in zip(part, at, strict=True)], pa.list_(pa.float64())))
    return rows


@pytest.mark.parametrize("standardize", [False, True])
@pytest.mark.parametrize("chunk, held", [(7, 0), (1 << 20, 3_000), (1 << 20, 1 << 20)])
def test_optimum_is_that_of_newton_steps(standardize, chunk, held, monkeypatch):
    monkeypatch.setattr(logistic, "CHUNK", chunk)
    monkeypatch.setattr(logistic, "HELD", held)
    rng = np.random.default_rng(3)
    x = rng.normal(1, [0.1, 1, 5, 30], (400, 4)) * (rng.random((400, 4)) < 0.6)
    x = np.c_[x, np.full(400, 2.0), np.zeros(400)]
    x[5, :4] = 0
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 1] - 0.2 * x[:, 2])))).astype(float)
    w = np.where(np.arange(400) % 4 == 0, 0.0, 0.3 + rng.random(400))
    got, b = logistic.fit_logistic(sparse(x), y, w, 0.01, 200, standardize)
    p, wn = w > 0, w[w > 0] / w.sum()
    spread = ((x[p] - wn @ x[p]) ** 2 * wn[:, None]).sum(0) / (1 - wn @ wn)
    ridge = np.append(0.01 * spread[:4] if standardize else np.full(4, 0.01), 0.0)
    z, beta = np.c_[x[p][:, :4], np.ones(p.sum())], np.zeros(5)
    for _ in range(60):
        q = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve((z * (wn * q * (1 - q))[:, None]).T @ z + np.diag(ridge), z.T @ (wn * (q - y[p])) + ridge * beta)
    assert got[4] == got[5] == 0
    np.testing.assert_allclose(np.append(got[:4], b), beta, rtol=2e-3, atol=2e-4)
    np.testing.assert_allclose(sparse(x).margins(got, b), x @ got + b)


@pytest.mark.parametrize("held", [0, 1 << 30])
def test_few_different_values_take_two_bytes_a_number(held, monkeypatch):
    """Before, a number took twelve bytes with its place, and every batch beyond HELD two files: the fit's worker grew to 393 MB on check_s."""
    monkeypatch.setattr(logistic, "CHUNK", 1 << 12)
    monkeypatch.setattr(logistic, "HELD", held)
    rng = np.random.default_rng(5)
    few = np.where(rng.random((500, 300)) < 0.5, rng.choice(np.log1p(np.arange(1, 40)) / 7, (500, 300)), 0.0)
    before = len(os.listdir("/proc/self/fd"))
    rows = sparse(few, 10)
    assert len(os.listdir("/proc/self/fd")) - before == (held == 0)
    assert rows.bytes == 0 if not held else rows.bytes < 7 * np.count_nonzero(few)
    c = rng.normal(size=300)
    assert np.allclose(rows.margins(c, 0.0), few @ c, rtol=0, atol=1e-12)
    many = rng.random((300, 400))
    monkeypatch.setattr(logistic, "CHUNK", 1 << 17)
    assert np.array_equal(np.concatenate([x for _, _, x, _ in sparse(many, 1).chunks()]), many.ravel())


def test_python_gets_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    rows = spark.range(0, 5_000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    with small_batches(spark, 700):
        assert max(r["n"] for r in rows.collect()) == 700
    assert spark.conf.get(key) == before


def test_no_job_a_step(spark):
    """Before, every step of a regression was a job that brought vectors of 2^18 numbers to the driver: over 300 jobs."""
    rows = [(i, ("garden soil water leaf " if i % 2 else "casino bonus spin win ") * 5 + f"item{i}", f"s{i % 3}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    spark.sparkContext.setJobGroup("no-job-a-step", "")
    try:
        got = quality.quality_scores(docs, labels).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert all(r["keep"] == (r["doc_id"] % 2 == 1) for r in got)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("no-job-a-step")) < 150
