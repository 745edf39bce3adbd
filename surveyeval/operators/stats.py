"""Statistics: Shapley and contrast decompositions in plain DataFrames, cluster bootstraps with a vectorised helper."""

from __future__ import annotations

import math
from math import factorial, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Z = NormalDist()


def shapley(subsets: DataFrame, players: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """(player, value) from rows (mask, value) of all 2^players subsets; value is an error, so a drop counts as a gain."""
    weight = F.element_at(F.array(*[F.lit(factorial(s) * factorial(players - s - 1) / factorial(players)) for s in range(players)]), F.bit_count("mask").cast("int") + 1)
    without = subsets.select(*by, "mask", F.col("value").alias("v0"), F.explode(F.array(*map(F.lit, range(players)))).alias("player")).where(F.expr("shiftright(mask, player) % 2 = 0"))
    without = without.withColumn("w", weight).withColumn("joined", F.col("mask") + F.expr("shiftleft(1, player)"))
    more = subsets.select(*by, F.col("mask").alias("joined"), F.col("value").alias("v1"))
    return without.join(more, [*by, "joined"]).groupBy(*by, "player").agg(F.round(F.sum(F.col("w") * (F.col("v0") - F.col("v1"))), 6).alias("shapley"))


def contrasts(subsets: DataFrame, players: int = 4) -> DataFrame:
    """(term, alpha): the signed mean over all subsets for every subset of factors (a 2^players by 2^players table)."""
    terms = subsets.select(F.explode(F.sequence(F.lit(0), F.lit(2**players - 1))).alias("term"), "mask", "value")
    sign = F.when(F.bit_count(F.col("term").bitwiseAND(F.col("mask").cast("int"))) % 2 == 0, 1.0).otherwise(-1.0)
    return terms.groupBy("term").agg(F.round(F.sum(sign * F.col("value")) / 2**players, 6).alias("alpha"))


def interaction_share(alphas: DataFrame) -> DataFrame:
    a2 = F.col("alpha") * F.col("alpha")
    total = F.sum(F.when(F.bit_count("term") >= 1, a2))
    return alphas.agg(F.round(F.when(total > 0, F.sum(F.when(F.bit_count("term") >= 2, a2)) / total).otherwise(0.0), 6).alias("share"))


def poisson_weights(keys: np.ndarray, B: int, seed: int) -> np.ndarray:
    """(B, n) Poisson(1) weights that depend on key, replicate and seed alone: a mixed 64-bit counter looked up in the distribution function."""
    step, one, two = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
    x = keys.view(np.uint64)[None, :] ^ (step * (np.arange(1, B + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 20)))[:, None]
    for shift, factor in ((30, one), (27, two)):
        x = (x ^ (x >> np.uint64(shift))) * factor
    unit = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    cdf = np.cumsum([math.exp(-1) / factorial(k) for k in range(16)])
    return np.searchsorted(cdf, unit, side="right").astype(float)


def poisson_boot(df: DataFrame, cluster: str, cols: list[str], B: int = 1000, seed: int = 42) -> DataFrame:
    """(replicate, cols..., w): Poisson-weighted sums over clusters; null values count as 0.

    A cluster's weight in a replicate is a hash of the two, so rows need no shuffle or sort, one weight serves all columns (paired statistics),
    and the result does not depend on partitioning.  A partition emits B rows, not B rows per cluster.
    """
    held = df.select(F.xxhash64(cluster).alias("_k"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])

    def draw(batches):
        out = np.zeros((B, len(cols) + 1))
        for pdf in batches:
            x, keys = np.c_[pdf[cols].to_numpy(float), np.ones(len(pdf))], pdf["_k"].to_numpy(np.int64)
            for at in range(0, len(x), 1000):
                out += poisson_weights(keys[at : at + 1000], B, seed) @ x[at : at + 1000]
        yield pd.DataFrame(out, columns=[*cols, "w"]).assign(replicate=np.arange(B))[["replicate", *cols, "w"]]

    schema = "replicate long, " + ", ".join(f"{c} double" for c in [*cols, "w"])
    return held.mapInPandas(draw, schema).groupBy("replicate").agg(*[F.sum(c).alias(c) for c in [*cols, "w"]])


def bca_bounds(draws: np.ndarray, point: float, skew: float, alpha: float = 0.05) -> tuple[float, float]:
    """BCa interval from replicates, the point and the jackknife acceleration; percentile interval where it degenerates."""
    low, high = alpha / 2, 1 - alpha / 2
    share = ((draws < point).mean() + (draws <= point).mean()) / 2
    if 0 < share < 1 and np.isfinite(skew):
        z0 = Z.inv_cdf(share)
        bend = lambda q: Z.cdf(z0 + (z0 + Z.inv_cdf(q)) / (1 - skew * (z0 + Z.inv_cdf(q))))
        low, high = bend(low), bend(high)
    return tuple(float(v) for v in np.quantile(draws, [low, high]))


def ratio_intervals(clusters: DataFrame, by: list[str], total: str, count: str, cluster: str = "rid", B: int = 1000, seed: int = 42, alpha: float = 0.05, method: str = "bca", least: int = 20) -> DataFrame:
    """(by.., point, lo, hi, p, n) for each group: sum(total) / sum(count) with clusters resampled; a mean is the case count = 1.

    One pass draws all groups: a cluster has the same weight in every group, a partition emits B rows a group, and nothing reaches the driver.
    Totals and moments are broadcast: one row a group.  BCa intervals of fewer than `least` clusters are null; `method` percentile has no least.  p is two-sided, from the share of
    replicates at or below 0.  Groups without a positive count are left out; group keys are not null.
    """
    held = clusters.select(*by, F.xxhash64(cluster).alias("_k"), F.coalesce(F.col(total).cast("double"), F.lit(0.0)).alias("_t"), F.coalesce(F.col(count).cast("double"), F.lit(0.0)).alias("_c"))
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.select(*by).schema.fields)

    def draw(batches):
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                weights, x = poisson_weights(part["_k"].to_numpy(np.int64), B, seed), part[["_t", "_c"]].to_numpy(float)
                for key, rows in part.groupby(by, sort=False).indices.items():
                    key = key if isinstance(key, tuple) else (key,)
                    sums[key] = sums.get(key, 0.0) + weights[:, rows] @ x[rows]
        for key, x in sums.items():
            yield pd.DataFrame({**dict(zip(by, ([k] * B for k in key), strict=True)), "replicate": np.arange(B), "s": x[:, 0], "c": x[:, 1]})

    draws = held.mapInPandas(draw, f"{keys}, replicate long, s double, c double").groupBy(*by, "replicate").agg((F.sum("s") / F.when(F.sum("c") > 0, F.sum("c"))).alias("r"))
    whole = held.groupBy(*by).agg(F.sum("_t").alias("s"), F.sum("_c").alias("c"), F.count("*").alias("n")).where("c > 0")
    jack = F.when(F.col("_c") < F.col("c"), (F.col("s") - F.col("_t")) / (F.col("c") - F.col("_c")))
    moments = held.join(F.broadcast(whole), by).groupBy(*by).agg(F.first(F.col("s") / F.col("c")).alias("point"), F.first("n").alias("n"), F.skewness(jack).alias("skew"), F.var_pop(jack).alias("spread"), F.count(jack).alias("m"))

    def bounds(pdf: pd.DataFrame) -> pd.DataFrame:
        first, r = pdf.iloc[0], pdf["r"].dropna().to_numpy()
        point, n = float(first["point"]), int(first["n"])
        below = float((r <= 0).mean()) if len(r) else 0.5
        row = {**{k: [first[k]] for k in by}, "point": [point], "lo": [float("nan")], "hi": [float("nan")], "p": [min(1.0, 2 * min(below, 1 - below) + 1 / B)], "n": [n]}
        if len(r) and (method != "bca" or n >= least):
            accel = -first["skew"] / (6 * sqrt(first["m"])) if method == "bca" and first["spread"] > 1e-30 else float("nan")
            lo, hi = bca_bounds(r, point, accel, alpha) if method == "bca" else np.quantile(r, [alpha / 2, 1 - alpha / 2])
            row |= {"lo": [float(lo)], "hi": [float(hi)]}
        return pd.DataFrame(row)

    return draws.join(F.broadcast(moments), by).groupBy(*by).applyInPandas(bounds, f"{keys}, point double, lo double, hi double, p double, n long")


def ratio_ci(clusters: DataFrame, total: str, count: str, cluster: str = "rid", B: int = 1000, seed: int = 42, alpha: float = 0.05) -> dict:
    """The single row of `ratio_intervals` without groups, as a dict; all null for no clusters."""
    row = ratio_intervals(clusters.withColumn("_all", F.lit(0)), ["_all"], total, count, cluster, B, seed, alpha).drop("_all").first()
    return row.asDict() if row else {"point": None, "lo": None, "hi": None, "p": None, "n": 0}


def cumulative(freq: DataFrame, order: str, count: str, borders: int = 64) -> DataFrame:
    """freq plus `before`: the sum of `count` over all rows of smaller `order` (one row for each value of it).

    Values are dealt to ranges by `borders` approximate quantiles; a running sum inside a range and the totals of the ranges before
    it (at most borders + 1 rows) give the answer, so no task sorts all rows.
    """
    cuts = freq.agg(F.percentile_approx(order, [i / borders for i in range(1, borders)], 10_000)).first()[0] or []
    ranged = freq.withColumn("_range", F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>"), lambda c: c < F.col(order))))
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum(count).alias("_all"))
    offset = totals.select("_range", F.coalesce(F.sum("_all").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))  # one row for each range
    rows = ranged.withColumn("_inside", F.coalesce(F.sum(count).over(inside), F.lit(0)))
    return rows.join(F.broadcast(offset), "_range").withColumn("before", F.col("_offset") + F.col("_inside")).drop("_range", "_offset", "_inside")


def signed_ranks(diffs: DataFrame, value: str = "delta") -> DataFrame:
    """One row (n, w_plus, ties, zeros, better): sums of the signed-rank test with average ranks of equal |d|; zeros and nulls take no rank."""
    d = F.col(value).cast("double")
    freq = diffs.where(d.isNotNull() & (d != 0)).groupBy(F.abs(d).alias("d")).agg(F.count("*").alias("t"), F.count_if(d > 0).alias("pos"))
    ranked = cumulative(freq, "d", "t").withColumn("r", F.col("before") + (F.col("t") + 1) / 2)
    sums = ranked.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n"), F.sum(F.col("r") * F.col("pos")).alias("w_plus"), F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"), F.coalesce(F.sum("pos"), F.lit(0)).alias("pos"))
    return sums.join(diffs.agg(F.count_if(d == 0).alias("zeros"), F.count(d).alias("n_all"), F.avg(d).alias("mean")))


def _z(s: DataFrame) -> DataFrame:
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    return s.withColumn("z", (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(F.when(var > 0, var)))


def wilcoxon(diffs: DataFrame, value: str = "delta") -> DataFrame:
    """Signed-rank statistic and its normal score with average ties, in one row; null for no differences."""
    return _z(signed_ranks(diffs, value)).select(F.col("n").cast("long").alias("n"), F.round("w_plus", 1).alias("w_plus"), F.round("z", 6).alias("z"))


def exact_signed_rank_p(n: int, w: float) -> float:
    """Two-sided exact p of the signed-rank sum of n untied differences: the share of the 2^n sign choices that are as far out."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for r in range(1, n + 1):
        ways[r:] += ways[: len(ways) - r].copy()
    share = ways / ways.sum()
    return float(min(1.0, 2 * min(share[: int(w) + 1].sum(), share[int(np.ceil(w)) :].sum())))


def wilcoxon_test(diffs: DataFrame, value: str = "delta", cluster: str = "rid", B: int = 1000, seed: int = 42, exact: int = 50) -> DataFrame:
    """One row: n (differences that are not 0), n_zero, w_plus, z, p, method, share_better, mean, lo, hi.

    p is two-sided: exact for up to `exact` differences without ties or zeros, else from the normal approximation with the tie correction and no
    continuity correction; null where no difference is left.  share_better is the share of all differences below 0 (the first arm errs more); the mean
    difference has a percentile interval with clusters resampled.  Null differences do not count.
    """
    s = _z(signed_ranks(diffs, value)).first()  # one row
    n, zeros = int(s["n"]), int(s["zeros"])
    small = 0 < n <= exact and not zeros and not s["ties"]
    p = exact_signed_rank_p(n, s["w_plus"]) if small else normal_p(s["z"]) if s["z"] is not None else None
    ci = ratio_intervals(diffs.where(F.col(value).isNotNull()).withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1.0)), ["_all"], value, "_one", cluster, B, seed, method="percentile").first()
    row = (n, zeros, s["w_plus"], s["z"], p, ("exact" if small else "normal") if n else None, (n - int(s["pos"])) / int(s["n_all"]) if s["n_all"] else None, s["mean"], ci["lo"] if ci else None, ci["hi"] if ci else None)
    return diffs.sparkSession.createDataFrame([row], "n long, n_zero long, w_plus double, z double, p double, method string, share_better double, mean double, lo double, hi double")


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def summed(parts: DataFrame, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """(keys.., i, v): packed rows of doubles (v) added up by key and row number i.

    Tasks that hold partial matrices emit them row by row; every (key, i) is summed as it streams by, so no task holds the
    matrices of all partitions and nothing reaches the driver.
    """
    names = [*keys, "i"]

    def add(batches):
        now, total = None, None
        for batch in batches:
            done: list[list] = [[] for _ in range(len(names) + 1)]

            def put(done=done):
                for column, x in zip(done, (*now, total.tobytes()), strict=True):
                    column.append(x)

            for *key, v in zip(*[batch.column(c).to_pylist() for c in (*names, "v")], strict=True):
                a = np.frombuffer(v)
                if tuple(key) == now:
                    total = total + a
                else:
                    if now is not None:
                        put()
                    now, total = tuple(key), a
            if done[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, batch.schema.field(c).type) for c, x in zip((*names, "v"), done, strict=True)], [*names, "v"])
            schema = batch.schema
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], schema.field(c).type) for c, x in zip((*names, "v"), (*now, total.tobytes()), strict=True)], [*names, "v"])

    held = parts.select(*names, "v").repartition(*names).sortWithinPartitions(*names)
    return held.mapInArrow(add, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields))


def gram(df: DataFrame, x: list[str], y: str, by: str) -> dict:
    """{group: (n, X'X, X'y, y'y)} with an intercept first: products are summed in each partition and merged by group in Spark; one matrix a group is returned."""
    k = len(x) + 1
    held = df.select(F.col(by).alias("_by"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)], F.col(y).cast("double").alias("y"))

    def local(batches):
        sums: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby("_by", sort=False):
                a = np.c_[np.ones(len(part)), part[[*(f"x{i}" for i in range(k - 1)), "y"]].to_numpy(float)]
                sums[key] = sums.get(key, 0.0) + a.T @ a
        for key, a in sums.items():
            yield pd.DataFrame({"_by": [key] * (k + 1), "i": np.arange(k + 1, dtype=np.int32), "v": [r.tobytes() for r in a]})

    out: dict = {}
    kind = held.schema["_by"].dataType.simpleString()
    for row in summed(held.mapInPandas(local, f"_by {kind}, i int, v binary"), ("_by",)).collect():
        out.setdefault(row["_by"], np.zeros((k + 1, k + 1)))[row["i"]] = np.frombuffer(row["v"])
    return {g: (int(round(a[0, 0])), a[:k, :k], a[:k, k], float(a[k, k])) for g, a in out.items()}


def ridge_folds(df: DataFrame, x: list[str], y: str, fold: str = "fold", alpha: float = 1.0) -> dict[int, np.ndarray]:
    """Ridge coefficients (intercept first, unpenalised) for each held-out fold: the whole Gram matrix less the fold's."""
    k = len(x) + 1
    sums = gram(df, x, y, fold)
    xx, xy = {f: a for f, (_, a, _, _) in sums.items()}, {f: b for f, (_, _, b, _) in sums.items()}
    ridge = np.diag([0.0] + [alpha] * (k - 1))
    total, right = sum(xx.values()), sum(xy.values())
    return {f: np.linalg.solve(total - xx[f] + ridge + 1e-9 * np.eye(k), right - xy[f]) for f in xx}


def clustered_ols(df: DataFrame, x: list[str], y: str, cluster: str = "rid") -> list[dict]:
    """OLS with cluster-robust errors: coefficients from sums of products, the meat from per-cluster score sums; normal p-values."""
    k = len(x) + 1
    n, a, right, _ = gram(df.withColumn("_all", F.lit(0)), x, y, "_all")[0]
    bread = np.linalg.inv(a)
    beta = bread @ right
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    resid = F.col(y) - sum((float(b) * c for b, c in zip(beta[1:], cols[1:], strict=True)), F.lit(float(beta[0])))
    score = df.withColumn("_e", resid).groupBy(cluster).agg(*[F.sum(c * F.col("_e")).alias(f"u{i}") for i, c in enumerate(cols)])
    m = score.agg(F.count("*").alias("g"), *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m_{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    meat = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            meat[i, j] = meat[j, i] = m[f"m_{i}_{j}"]
    g = m["g"]
    cov = bread @ meat @ bread * (g / (g - 1) * (n - 1) / (n - k))
    out = []
    for i, name in enumerate(["intercept", *x]):
        se = sqrt(max(0.0, cov[i, i]))
        out.append({"term": name, "coef": float(beta[i]), "se": se, "lo": float(beta[i] - 1.959964 * se), "hi": float(beta[i] + 1.959964 * se), "p": normal_p(beta[i] / se) if se else float("nan"), "n": n})
    return out
