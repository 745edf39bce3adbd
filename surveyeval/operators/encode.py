"""Encoding of mixed answers into model columns, and per-item regressions evaluated on held-out folds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats as ST
from .baseline import find_columns


def encode(df: DataFrame, numeric: list[str], nominal: list[str], clip: float = 50.0, flat: float = 1e-6) -> tuple[DataFrame, list[str]]:
    """Adds model columns x0, x1, ... and returns their meanings.

    Numbers get the mean where null; each level of a nominal column, MISSING included, becomes 0/1.  Columns with a deviation up to `flat` are
    left out, the others are divided by it without centring and clipped.  Levels are collected: nominal columns of over 1,000 levels are refused.
    """
    levels = find_columns(df, [], nominal).levels
    means = df.agg(*[F.avg(c).alias(c) for c in numeric]).first() if numeric else {}
    raw: list[tuple[str, Column]] = [(c, F.coalesce(F.col(c).cast("double"), F.lit(float(means[c] if means[c] is not None else 0.0)))) for c in numeric]
    raw += [(f"{c}={v}", (F.coalesce(F.col(c).cast("string"), F.lit("MISSING")) == v).cast("double")) for c in nominal for v in levels[c]]
    sd = df.agg(*[F.stddev_pop(x).alias(f"d{i}") for i, (_, x) in enumerate(raw)]).first()
    kept = [(n, x, sd[f"d{i}"]) for i, (n, x) in enumerate(raw) if (sd[f"d{i}"] or 0.0) > flat]
    cols = [F.greatest(F.lit(-clip), F.least(F.lit(clip), x / F.lit(d))).alias(f"x{i}") for i, (_, x, d) in enumerate(kept)]
    return df.select("*", *cols), [n for n, _, _ in kept]


def ridge_by_item(df: DataFrame, x: list[str], item: str = "item", y: str = "y", fold: str = "fold", alpha: float = 1.0, least: int = 50) -> DataFrame:
    """Held-out error of a ridge regression per item: rounded, clipped to the observed range; items under `least` rows are skipped.

    One aggregation gives the Gram matrices of all items and folds; a fold's coefficients come from the item's total less the fold.
    """
    df = df.withColumn("_g", F.concat_ws("|", F.col(item), F.col(fold).cast("string")))
    k = len(x) + 1
    parts: dict[str, dict[str, tuple[np.ndarray, np.ndarray, int]]] = {}
    for key, (n, a, right, _) in ST.gram(df, x, y, "_g").items():
        name, f = key.rsplit("|", 1)
        parts.setdefault(name, {})[f] = (a, right, n)
    table = []
    ridge = np.diag([0.0] + [alpha] * (k - 1)) + 1e-9 * np.eye(k)
    for name, folds in parts.items():
        if sum(n for _, _, n in folds.values()) < least:
            continue
        total, right = sum(a for a, _, _ in folds.values()), sum(b for _, b, _ in folds.values())
        table += [(f"{name}|{f}", [float(v) for v in np.linalg.solve(total - a + ridge, right - b)]) for f, (a, b, _) in folds.items()]
    beta = df.sparkSession.createDataFrame(table, "_g string, beta array<double>")
    span = df.groupBy(item).agg(F.min(y).alias("lo"), F.max(y).alias("hi"))
    guess = F.element_at("beta", 1) + sum((F.element_at("beta", i + 2) * F.col(c) for i, c in enumerate(x)), F.lit(0.0))
    rows_ = df.join(F.broadcast(beta), "_g").join(F.broadcast(span.withColumnsRenamed({"lo": "_lo", "hi": "_hi"})), item)  # both: one row per item (and fold)
    err = F.abs(F.least(F.col("_hi"), F.greatest(F.col("_lo"), F.round(guess))) - F.col(y))
    return rows_.groupBy(item, fold).agg(F.count("*").alias("n"), F.avg(err).alias("mae"))


def logistic_folds(df: DataFrame, x: list[str], y: str = "y", fold: str = "fold", steps: int = 8, ridge: float = 1.0) -> DataFrame:
    """Held-out misclassification of a logistic regression on a 0/1 column, by Newton steps; one aggregation a step serves all folds.

    Every row takes part in the sums of all folds but its own.  Folds without training rows of both kinds stay near the intercept.
    """
    k = len(x) + 1
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    pen = np.diag([0.0] + [ridge] * (k - 1))
    betas = {f: np.zeros(k) for f in folds}
    rows = df.select(F.col(fold).cast("long").alias("own"), F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)])

    def sums(at: dict):
        def local(batches):
            h, g = {f: np.zeros((k, k)) for f in at}, {f: np.zeros(k) for f in at}
            for pdf in batches:
                a, target, own = np.c_[np.ones(len(pdf)), pdf[[f"x{i}" for i in range(k - 1)]].to_numpy(float)], pdf["y"].to_numpy(), pdf["own"].to_numpy()
                for f, b in at.items():
                    q = a[own != f]
                    p = 1 / (1 + np.exp(-np.clip(q @ b, -30, 30)))
                    h[f] += (q * (p * (1 - p))[:, None]).T @ q
                    g[f] += q.T @ (target[own != f] - p)
            for f in at:
                yield pd.DataFrame({"f": [f] * k, "i": np.arange(k, dtype=np.int32), "v": [r.tobytes() for r in np.c_[h[f], g[f]]]})

        return ST.summed(rows.mapInPandas(local, "f long, i int, v binary"), ("f",)).collect()  # one matrix for each fold

    for _ in range(steps):
        h, g = {f: np.zeros((k, k)) for f in folds}, {f: np.zeros(k) for f in folds}
        for r in sums(betas):
            v = np.frombuffer(r["v"])
            h[r["f"]][r["i"]], g[r["f"]][r["i"]] = v[:k], v[k]
        largest = 0.0
        for f in folds:
            move = np.linalg.solve(h[f] + pen + 1e-9 * np.eye(k), g[f] - pen @ betas[f])
            betas[f] = betas[f] + move
            largest = max(largest, float(np.abs(move).max()))
        if largest < 1e-6:
            break
    beta = df.sparkSession.createDataFrame([(f, [float(v) for v in b]) for f, b in betas.items()], f"{fold} long, beta array<double>")
    score = F.element_at("beta", 1) + sum((F.element_at("beta", i + 2) * F.col(c) for i, c in enumerate(x)), F.lit(0.0))
    return df.join(F.broadcast(beta), fold).groupBy(fold).agg(F.count("*").alias("n"), F.avg(((score >= 0).cast("double") != F.col(y)).cast("double")).alias("mae"))
