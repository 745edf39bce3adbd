"""The supervised baseline: per item a ridge or logistic regression on every answer that does not leak, evaluated on held-out folds.

One row per respondent holds the features and, per item, the true code.  Every pass adds up matrices in the tasks and merges
them by key in Spark (`stats.summed`), a matrix row at a time; systems are solved in tasks, an item at a time.  What reaches the
driver is bounded by items, folds and model columns: moments and coefficients.  An item's battery is left out by taking the principal submatrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats as ST
from .store import stored

MISSING = "MISSING"
#: Doubles that a task may hold in matrices at once (256 MB); more items than fit take further passes.
HELD = 1 << 25


@dataclass(frozen=True)
class Columns:
    """The model columns of an encoding: numbers first, then the levels of nominal variables; `of` names each column's variable."""

    numeric: list[str]
    levels: dict[str, list[str]]

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *[f"{v}={x}" for v, xs in self.levels.items() for x in xs]]

    @property
    def of(self) -> list[str]:
        return [*self.numeric, *[v for v, xs in self.levels.items() for _ in xs]]


def find_columns(people: DataFrame, numeric: list[str], nominal: list[str], most: int = 1000) -> Columns:
    """The columns of people's variables, levels from one aggregation; a nominal variable of more than `most` levels is refused: it is an id, not a code."""
    levels: dict[str, list[str]] = {v: [] for v in nominal}
    if nominal:
        long = people.select(F.explode(F.create_map(*[x for v in nominal for x in (F.lit(v), F.coalesce(F.col(v).cast("string"), F.lit(MISSING)))])).alias("var", "level"))
        found = long.groupBy("var", "level").count().groupBy("var").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("level")), 1, most).alias("levels"))
        for row in found.select("var", "n", "levels").collect():
            if row["n"] > most:
                raise ValueError(f"{row['var']} has {row['n']} levels")
            levels[row["var"]] = list(row["levels"])
    return Columns(list(numeric), levels)


def _matrix(table: pd.DataFrame, columns: Columns) -> np.ndarray:
    """Model columns before imputation: numbers with NaN where missing, 0/1 for levels."""
    parts = [table[columns.numeric].to_numpy(float)] if columns.numeric else []
    for v, levels in columns.levels.items():
        place = {x: i for i, x in enumerate(levels)}
        at = np.array([place.get(x, -1) for x in table[v]], np.int64)
        one = np.zeros((len(at), len(levels)))
        one[np.flatnonzero(at >= 0), at[at >= 0]] = 1.0
        parts.append(one)
    return np.concatenate(parts, axis=1) if parts else np.zeros((len(table), 0))


def _packed(sums: dict[str, np.ndarray]):
    """Rows (key, i, v) of the summed matrices."""
    for key, a in sums.items():
        a = np.atleast_2d(np.asarray(a, float))
        yield pa.RecordBatch.from_arrays([pa.array([key] * len(a)), pa.array(np.arange(len(a), dtype=np.int32)), pa.array([r.tobytes() for r in a], pa.binary())], ["key", "i", "v"])


_ROWS = "key string, i int, v binary"


@dataclass(frozen=True)
class Scaling:
    """Of one item: which columns the model has, and each one's mean (for missing numbers) and scale."""

    keep: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    n: int

    def apply(self, raw: np.ndarray, clip: float) -> np.ndarray:
        x = np.where(np.isnan(raw), self.mean, raw)[:, self.keep] / self.scale[self.keep]
        return np.c_[np.ones(len(x)), np.clip(x, -clip, clip)]


def _scalings(rows: DataFrame, columns: Columns, items: list[str], excluded: dict[str, list[str]], flat: float) -> dict[str, Scaling]:
    """Means and deviations over the rows that have the item's truth, from one pass for all items."""
    of = np.array(columns.of)

    def local(batches):
        sums = {i: np.zeros((4, len(of))) for i in items}
        for batch in batches:
            table = batch.to_pandas()
            raw = _matrix(table, columns)
            seen, value = ~np.isnan(raw), np.nan_to_num(raw)
            truth = ~np.isnan(table[[f"y_{i}" for i in items]].to_numpy(float))
            for j, i in enumerate(items):
                m = truth[:, j]
                sums[i] += np.stack([np.full(len(of), m.sum()), seen[m].sum(0), value[m].sum(0), (value[m] ** 2).sum(0)])
        yield from _packed(sums)

    held: dict[str, dict[int, np.ndarray]] = {}
    for r in ST.summed(rows.mapInArrow(local, _ROWS)).collect():  # four rows for each item
        held.setdefault(r["key"], {})[r["i"]] = np.frombuffer(r["v"])
    out = {}
    for i in items:
        n, seen, total, squares = (held[i][j] for j in range(4)) if i in held else np.zeros((4, len(of)))
        mean = np.divide(total, seen, out=np.zeros(len(of)), where=seen > 0)
        spread = np.sqrt(np.maximum(0.0, squares - seen * mean**2) / np.maximum(n, 1))
        numbers = np.arange(len(of)) < len(columns.numeric)
        spread[~numbers] = np.sqrt(np.maximum(0.0, mean * (1 - mean)))[~numbers]
        keep = (spread > flat) & ~np.isin(of, list(excluded.get(i, ())))
        out[i] = Scaling(np.flatnonzero(keep), mean, np.where(spread > flat, spread, 1.0), int(n[0]) if len(n) else 0)
    return out


def _groups(items: list[str], size) -> list[list[str]]:
    """Items in passes whose matrices fit a task."""
    out: list[list[str]] = [[]]
    room = HELD
    for i in items:
        if out[-1] and size(i) > room:
            out.append([])
            room = HELD
        out[-1].append(i)
        room -= size(i)
    return [g for g in out if g]


def _ridge(rows: DataFrame, columns: Columns, items: list[str], scaling: dict[str, Scaling], folds: int, alpha: float, clip: float) -> dict[tuple[str, int], np.ndarray]:
    """Coefficients by item and held-out fold: the item's whole matrix less the fold's."""

    def local(batches, mine):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            table = batch.to_pandas()
            raw, fold = _matrix(table, columns), table["fold"].to_numpy()
            for i in mine:
                y = table[f"y_{i}"].to_numpy(float)
                x = np.c_[scaling[i].apply(raw, clip), y]
                for f in range(folds):
                    part = x[(fold == f) & ~np.isnan(y)]
                    sums[f"{i}|{f}"] = sums.get(f"{i}|{f}", 0.0) + part.T @ part
        yield from _packed(sums)

    def solve(table: pd.DataFrame) -> pd.DataFrame:
        item = table["item"].iloc[0]
        k = len(scaling[item].keep) + 1
        a = {f: np.frombuffer(b"".join(g.sort_values("i")["v"])).reshape(k + 1, k + 1) for f, g in table.groupby("fold")}
        total, pen = sum(a.values()), np.diag([0.0] + [alpha] * (k - 1))
        out = []
        for f in range(folds):
            train = total - a.get(f, 0.0)
            if train[0, 0] > 0.5:
                out.append((item, f, np.linalg.lstsq(train[:k, :k] + pen, train[:k, k], rcond=None)[0].tolist()))
        return pd.DataFrame(out, columns=["item", "fold", "beta"])

    betas = {}
    for mine in _groups(items, lambda i: folds * (len(scaling[i].keep) + 2) ** 2):
        merged = ST.summed(rows.mapInArrow(lambda b, mine=mine: local(b, mine), _ROWS))
        cut = F.split("key", r"\|")
        solved = merged.select(cut[0].alias("item"), cut[1].cast("int").alias("fold"), "i", "v").groupBy("item").applyInPandas(solve, "item string, fold int, beta array<double>")
        betas |= {(r["item"], r["fold"]): np.array(r["beta"]) for r in solved.collect()}  # one vector for each item and fold
    return betas


def _softmax(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Class probabilities (rows by classes) of coefficients (classes by columns)."""
    s = x @ beta.T
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _logistic(rows: DataFrame, columns: Columns, codes: dict[str, list[float]], scaling: dict[str, Scaling], folds: int, penalty: float, clip: float, steps: int, tolerance: float = 1e-7) -> dict[tuple[str, int], np.ndarray]:
    """Coefficients (classes by columns) by item and held-out fold, by Newton steps of all items and folds at once.

    Two classes have one vector of coefficients (the other class's are 0), more have one each, all but the intercepts penalised.
    """
    items = list(codes)
    free = {i: 1 if len(codes[i]) == 2 else len(codes[i]) for i in items}
    betas = {(i, f): np.zeros((len(codes[i]), len(scaling[i].keep) + 1)) for i in items for f in range(folds)}
    open_ = set(betas)

    def local(batches, mine):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            table = batch.to_pandas()
            raw, own = _matrix(table, columns), table["fold"].to_numpy()
            for i in {i for i, _ in mine}:
                y = table[f"y_{i}"].to_numpy(float)
                there = ~np.isnan(y)
                x, target, fold = scaling[i].apply(raw[there], clip), (y[there][:, None] == np.array(codes[i])).astype(float), own[there]
                k, m = x.shape[1], free[i]
                for f in [f for j, f in mine if j == i]:
                    xf, tf = x[fold != f], target[fold != f]
                    p = _softmax(xf, betas[i, f])
                    a = np.zeros((m * k, m * k + 1))
                    for c in range(m):
                        u = len(codes[i]) - m + c  # of two classes the second has the vector
                        a[c * k : (c + 1) * k, -1] = xf.T @ (tf[:, u] - p[:, u])
                        for d in range(m):
                            v = len(codes[i]) - m + d
                            weight = p[:, u] * ((u == v) - p[:, v])
                            a[c * k : (c + 1) * k, d * k : (d + 1) * k] = (xf * weight[:, None]).T @ xf
                    sums[f"{i}|{f}"] = sums.get(f"{i}|{f}", 0.0) + a
        yield from _packed(sums)

    def solve(table: pd.DataFrame) -> pd.DataFrame:
        item, fold = table["item"].iloc[0], int(table["fold"].iloc[0])
        k, m = len(scaling[item].keep) + 1, free[item]
        a = np.frombuffer(b"".join(table.sort_values("i")["v"])).reshape(m * k, m * k + 1)
        now = betas[item, fold][len(codes[item]) - m :].ravel()
        pen = np.tile(np.r_[0.0, np.full(k - 1, penalty)], m)
        # with a vector for every class, a constant added to all intercepts changes nothing: least squares takes the shortest step
        move = np.linalg.lstsq(a[:, :-1] + np.diag(pen), a[:, -1] - pen * now, rcond=None)[0]
        return pd.DataFrame([(item, fold, move.tolist())], columns=["item", "fold", "move"])

    for _ in range(steps):
        if not open_:
            break
        moved: dict[tuple[str, int], np.ndarray] = {}
        for mine in _groups(sorted({i for i, _ in open_}), lambda i: folds * (free[i] * (len(scaling[i].keep) + 1)) ** 2):
            todo = sorted(k for k in open_ if k[0] in mine)
            merged = ST.summed(rows.mapInArrow(lambda b, todo=todo: local(b, todo), _ROWS))
            cut = F.split("key", r"\|")
            solved = merged.select(cut[0].alias("item"), cut[1].cast("int").alias("fold"), "i", "v").groupBy("item", "fold").applyInPandas(solve, "item string, fold int, move array<double>")
            moved |= {(r["item"], r["fold"]): np.array(r["move"]) for r in solved.collect()}
        for key, move in moved.items():
            m = free[key[0]]
            step = move.reshape(m, -1)
            betas[key] = betas[key].copy()
            betas[key][len(codes[key[0]]) - m :] += np.clip(step, -5.0, 5.0)
            if np.abs(step).max(initial=0.0) < tolerance:
                open_.discard(key)
        open_ &= set(moved)
    return betas


RESULT = "item string, treatment string, fold int, n long, n_train long, n_columns long, n_variables long, mae double, reason string"


def regression_baseline(
    people: DataFrame, truths: DataFrame, items: dict[str, str], numeric: list[str], nominal: list[str], excluded: dict[str, list[str]], folds: int = 5, alpha: float = 1.0, penalty: float = 1.0,
    least: int = 50, flat: float = 1e-6, clip: float = 50.0, steps: int = 25,
) -> DataFrame:
    """Held-out error per item and fold: rows (item, treatment, fold, n, n_train, n_columns, n_variables, mae, reason).

    `people` has one row per rid with the variables and `fold` (0 .. folds - 1), `truths` rows (rid, item, y) with one substantive code each, `items` the treatment of
    every item: ridge or logistic.  Numbers that are missing get the item's mean; nominal variables a column for each level, MISSING
    included; columns with a deviation up to `flat` go, the others are divided by it without centring and clipped.  All that is taken over the rows with a
    truth.  A ridge prediction is rounded and clipped to the observed codes; a logistic one is the likeliest code.  Variables of `excluded[item]` take no part.

    An item that cannot be fitted has one row with a null fold and mae and the reason: insufficient_truth (fewer than `least`), all_features_constant, or
    all_folds_singleton; a fold whose training rows have one code only has no row.  People without a truth, and truths without a person, do not matter.
    """
    spark = people.sparkSession
    names = list(items)
    columns = find_columns(people, numeric, nominal)
    wide = truths.where(F.col("item").isin(names) & F.col("y").isNotNull()).groupBy("rid").pivot("item", names).agg(F.max(F.col("y").cast("double")))
    wide = wide.select("rid", *[F.col(f"`{i}`").alias(f"y_{i}") for i in names])
    own = people.select("rid", F.col("fold").cast("int").alias("fold"), *[F.col(c).cast("double").alias(c) for c in numeric], *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in nominal])
    rows = stored(own.join(wide, "rid").drop("rid"), "people")
    variables = [v for v in [*numeric, *nominal]]
    n_variables = {i: len([v for v in variables if v not in excluded.get(i, ())]) for i in names}
    codes = {r["item"]: sorted(r["codes"]) for r in rows.select(F.explode(F.create_map(*[x for i in names for x in (F.lit(i), F.col(f"y_{i}"))])).alias("item", "y")).where("y is not null").groupBy("item").agg(F.collect_set("y").alias("codes")).collect()}
    scaling = _scalings(rows, columns, names, excluded, flat)
    reason = {i: "insufficient_truth" if scaling[i].n < least else "all_features_constant" if not len(scaling[i].keep) else "" for i in names}
    fit = [i for i in names if not reason[i]]
    betas: dict[tuple[str, int], np.ndarray] = {}
    if ridges := [i for i in fit if items[i] == "ridge"]:
        betas |= _ridge(rows, columns, ridges, scaling, folds, alpha, clip)
    if logits := {i: codes[i] for i in fit if items[i] == "logistic" and len(codes[i]) > 1}:
        betas |= _logistic(rows, columns, logits, scaling, folds, penalty, clip, steps)

    def score(batches):
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            table = batch.to_pandas()
            raw, fold = _matrix(table, columns), table["fold"].to_numpy()
            for i in fit:
                y = table[f"y_{i}"].to_numpy(float)
                for f in range(folds):
                    rest = ~np.isnan(y) & (fold != f)
                    key = sums.setdefault((i, f), np.array([0.0, 0.0, rest.sum() * 0.0, np.inf, -np.inf]))
                    if rest.any():  # the codes seen in training decide whether a fold can be fitted
                        key[2] += rest.sum()
                        key[3], key[4] = min(key[3], y[rest].min()), max(key[4], y[rest].max())
                    mine = ~np.isnan(y) & (fold == f)
                    if not mine.any() or (i, f) not in betas:
                        continue
                    x, beta = scaling[i].apply(raw[mine], clip), betas[i, f]
                    if items[i] == "ridge":
                        guess = np.clip(np.rint(x @ beta), codes[i][0], codes[i][-1])
                    else:
                        guess = np.array(codes[i])[np.argmax(x @ beta.T, axis=1)]
                    key[0] += mine.sum()
                    key[1] += np.abs(guess - y[mine]).sum()
        yield pd.DataFrame([(i, f, *v) for (i, f), v in sums.items()], columns=["item", "fold", "n", "s", "m", "lo", "hi"]).pipe(lambda t: pa.RecordBatch.from_pandas(t.astype({"fold": "int32"}), preserve_index=False))

    table = [(i, items[i], len(scaling[i].keep), n_variables[i], scaling[i].n, reason[i] or None) for i in names]
    facts = spark.createDataFrame(table, "item string, treatment string, n_columns long, n_variables long, n_truth long, reason string")
    if not fit:
        return facts.select("item", "treatment", *[F.lit(None).cast(t).alias(c) for c, t in (("fold", "int"), ("n", "long"))], F.col("n_truth").alias("n_train"), "n_columns", "n_variables", F.lit(None).cast("double").alias("mae"), "reason")
    sums = rows.mapInArrow(score, "item string, fold int, n double, s double, m double, lo double, hi double").groupBy("item", "fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("m").alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    sums = sums.join(facts.select("item", "treatment"), "item").where((F.col("n") > 0) & ((F.col("treatment") == "ridge") | (F.col("lo") < F.col("hi"))))
    out = facts.join(sums.drop("treatment"), "item", "left")
    why = F.coalesce("reason", F.when(F.col("fold").isNull(), F.lit("all_folds_singleton")))
    return out.select(
        "item", "treatment", "fold", F.col("n").cast("long").alias("n"), F.coalesce(F.col("m").cast("long"), "n_truth").alias("n_train"), "n_columns", "n_variables", (F.col("s") / F.col("n")).alias("mae"), why.alias("reason"),
    )


def item_means(folds: DataFrame) -> DataFrame:
    """(item, mae, n_folds, reason): the mean over the folds' errors; null with a reason where an item has none."""
    return folds.groupBy("item").agg(F.avg("mae").alias("mae"), F.count("mae").alias("n_folds"), F.max("reason").alias("reason"))


def versus_baseline(full: DataFrame, baseline: DataFrame, spans: DataFrame) -> DataFrame:
    """T4: (item, err, baseline, gain, n_pairs, reason): the model's error beside the baseline's on the item's span; items without a baseline abstain.

    `full` has rows (item, err) of the headline cohort, `baseline` those of `item_means` (raw scale), `spans` (item, span).  Items of either side appear once;
    a model error that is null does not count; gain is null where a side is missing and reason says which.
    """
    model = full.groupBy("item").agg(F.avg("err").alias("err"), F.count("err").alias("n_pairs"))
    base = baseline.join(spans, "item").select("item", (F.col("mae") / F.when(F.col("span") > 0, F.col("span"))).alias("baseline"), F.coalesce("reason", F.when(~(F.col("span") > 0), F.lit("no_span"))).alias("why"))
    out = model.join(base, "item", "full")
    why = F.coalesce("why", F.when(F.col("baseline").isNull(), F.lit("no_baseline")).when(F.col("err").isNull(), F.lit("no_model_rows")))
    return out.select("item", "err", "baseline", (F.col("baseline") - F.col("err")).alias("gain"), F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), why.alias("reason"))
