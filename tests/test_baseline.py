"""The regression baseline against fits on one machine, the T4 table, rank tests against brute force, and sums merged in Spark."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyeval.operators import baseline as B
from surveyeval.operators import stats as ST

rng = np.random.default_rng(4)
N, NUMBERS, CODES = 400, 6, {"region": 9, "trade": 5}


def people():
    x = rng.normal(size=(N, NUMBERS)) * [1, 5, 100, 1, 1, 1] + [0, 3, 1990, 0, 0, 7]
    x[:, 4] = 2.0  # constant
    missing = rng.random((N, NUMBERS)) < 0.1
    codes = {v: rng.integers(0, k, N) for v, k in CODES.items()}
    gone = {v: rng.random(N) < 0.07 for v in CODES}
    y = {
        "scale": np.clip(np.round(3 + x[:, 0] + 0.2 * codes["region"] + rng.normal(size=N)), 1, 7), "yes": 1.0 + (x[:, 0] + 0.1 * x[:, 1] + rng.normal(size=N) > 0.3),
        "kind": 1.0 + np.argmax(np.c_[x[:, 0], x[:, 1] - 3, np.zeros(N)] + rng.normal(size=(N, 3)), axis=1), "rare": rng.integers(1, 4, N).astype(float), "same": np.ones(N),
    }
    there = {k: rng.random(N) < (0.1 if k == "rare" else 0.8) for k in y}
    return x, missing, codes, gone, y, there


X, GONE, CODE, CODE_GONE, Y, THERE = people()
ITEMS = {"scale": "ridge", "yes": "logistic", "kind": "logistic", "rare": "ridge", "same": "logistic"}
HIDDEN = {"scale": ["x3", "trade"], "yes": ["region"]}


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, i % 5, *[None if GONE[i, j] else float(X[i, j]) for j in range(NUMBERS)], *[None if CODE_GONE[v][i] else int(CODE[v][i]) for v in CODES]) for i in range(N)]
    who = spark.createDataFrame(rows, "rid long, fold int, " + ", ".join(f"x{j} double" for j in range(NUMBERS)) + ", region int, trade int")
    truths = spark.createDataFrame([(i, k, float(Y[k][i])) for k in Y for i in range(N) if THERE[k][i]] + [(0, "other", 1.0), (9999, "scale", 1.0)], "rid long, item string, y double")
    return who.repartition(3), truths


def by_hand(item):
    """The same fit with plain numpy: {fold: error}."""
    m = THERE[item]
    cols, y, fold = [], Y[item][m], (np.arange(N) % 5)[m]
    for j in range(NUMBERS):
        if f"x{j}" not in HIDDEN.get(item, ()):
            v, g = X[m, j].copy(), GONE[m, j]
            v[g] = v[~g].mean()
            cols.append(v)
    for v, k in CODES.items():
        if v not in HIDDEN.get(item, ()):
            cols += [((CODE[v][m] == c) & ~CODE_GONE[v][m]).astype(float) for c in range(k)] + [CODE_GONE[v][m].astype(float)]
    a = np.column_stack(cols)
    a = a[:, a.std(axis=0) > 1e-6]
    a = np.c_[np.ones(len(a)), np.clip(a / a.std(axis=0), -50, 50)]
    out, codes, k = {}, np.unique(y), a.shape[1]
    for f in range(5):
        tr, te = fold != f, fold == f
        if ITEMS[item] == "ridge":
            b = np.linalg.solve(a[tr].T @ a[tr] + np.diag([0.0] + [1.0] * (k - 1)), a[tr].T @ y[tr])
            guess = np.clip(np.rint(a[te] @ b), y.min(), y.max())
        else:
            w, t = np.zeros((len(codes), k)), (y[tr][:, None] == codes).astype(float)
            pen = np.r_[0.0, np.ones(k - 1)]
            two = len(codes) == 2
            for _ in range(200):  # Newton on all classes; of two only the second moves
                p = np.exp(a[tr] @ w.T - (a[tr] @ w.T).max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                free = [1] if two else list(range(len(codes)))
                g = np.concatenate([a[tr].T @ (t[:, c] - p[:, c]) - pen * w[c] for c in free])
                h = np.block([[(a[tr] * (p[:, c] * ((c == d) - p[:, d]))[:, None]).T @ a[tr] + (c == d) * np.diag(pen) for d in free] for c in free])
                step = np.linalg.lstsq(h, g, rcond=None)[0].reshape(len(free), k)
                w[free] += step
                if np.abs(step).max() < 1e-10:
                    break
            guess = codes[np.argmax(a[te] @ w.T, axis=1)]
        out[f] = (int(te.sum()), int(tr.sum()), k - 1, float(np.abs(guess - y[te]).mean()))
    return out


def test_regression_baseline(spark, tables):
    got = {}
    for r in B.regression_baseline(*tables, ITEMS, [f"x{j}" for j in range(NUMBERS)], list(CODES), HIDDEN).collect():
        got.setdefault(r["item"], {})[r["fold"]] = r
    for item in ("scale", "yes", "kind"):
        want = by_hand(item)
        assert {f: (r["n"], r["n_train"], r["n_columns"]) for f, r in got[item].items()} == {f: w[:3] for f, w in want.items()}
        assert all(abs(got[item][f]["mae"] - w[3]) < 1e-9 for f, w in want.items()) and all(r["reason"] is None for r in got[item].values())
    assert [(r["mae"], r["reason"], r["n_train"]) for r in got["rare"].values()] == [(None, "insufficient_truth", int(THERE["rare"].sum()))]
    assert [(r["mae"], r["reason"]) for r in got["same"].values()] == [(None, "all_folds_singleton")]
    assert got["scale"][0]["n_variables"] == NUMBERS


def test_several_passes_give_the_same(spark, tables, monkeypatch):
    whole = B.item_means(B.regression_baseline(*tables, ITEMS, ["x0", "x1", "x2"], ["region"], {})).collect()
    monkeypatch.setattr(B, "HELD", 1000)
    part = B.item_means(B.regression_baseline(*[t.repartition(7) for t in tables], ITEMS, ["x0", "x1", "x2"], ["region"], {})).collect()
    assert {r["item"]: r["mae"] and round(r["mae"], 9) for r in whole} == {r["item"]: r["mae"] and round(r["mae"], 9) for r in part}


def test_baseline_edges(spark, tables):
    who, truths = tables
    none = B.regression_baseline(who.limit(0), truths, {"scale": "ridge"}, ["x0"], ["region"], {}).collect()
    assert [(r["item"], r["mae"], r["reason"]) for r in none] == [("scale", None, "insufficient_truth")]
    flat = B.regression_baseline(who, truths, {"scale": "ridge"}, ["x4"], [], {}).collect()
    assert [r["reason"] for r in flat] == ["all_features_constant"]
    with pytest.raises(ValueError, match="levels"):
        B.find_columns(who, [], ["rid"], most=50)


def test_versus_baseline(spark):
    full = spark.createDataFrame([("a", 0.2), ("a", 0.4), ("b", None), ("c", 0.5)], "item string, err double")
    base = spark.createDataFrame([("a", 0.8, 5, None), ("b", 0.5, 5, None), ("d", None, 0, "insufficient_truth")], "item string, mae double, n_folds long, reason string")
    spans = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("d", 3.0)], "item string, span double")
    got = {r["item"]: (r["err"], r["baseline"], r["gain"], r["n_pairs"], r["reason"]) for r in B.versus_baseline(full, base, spans).collect()}
    assert got["a"][:2] == (pytest.approx(0.3), 0.4) and got["a"][2] == pytest.approx(0.1) and got["a"][3:] == (2, None)
    assert got["b"] == (None, 0.5, None, 0, "no_model_rows") and got["c"] == (0.5, None, None, 1, "no_baseline") and got["d"] == (None, None, None, 0, "insufficient_truth")


def brute_ranks(d):
    d = [x for x in d if x is not None and x != 0]
    size = sorted(abs(x) for x in d)
    rank = {a: sum(i + 1 for i, s in enumerate(size) if s == a) / size.count(a) for a in set(size)}
    return sum(rank[abs(x)] for x in d if x > 0), [rank[abs(x)] for x in d]


@pytest.mark.parametrize("seed", range(4))
def test_wilcoxon(spark, seed):
    gen = np.random.default_rng(seed)
    d = [None, 0.0, *gen.integers(-6, 9, 150).astype(float).tolist()] if seed % 2 else gen.normal(0.3, 1, 9 + seed).tolist()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(d)], "rid long, delta double").repartition(5)
    w, ranks = brute_ranks(d)
    r = ST.wilcoxon_test(df).first()
    n, ties = len(ranks), sum(ranks.count(x) ** 2 - 1 for x in ranks)
    z = (w - n * (n + 1) / 4) / np.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    assert r["n"] == n and r["w_plus"] == w and r["z"] == pytest.approx(z)
    if seed % 2:
        assert r["method"] == "normal" and r["p"] == pytest.approx(ST.normal_p(z))
    else:
        sums = [sum(x for x, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product([0, 1], repeat=n)]
        want = min(1.0, 2 * min(np.mean([s <= w for s in sums]), np.mean([s >= w for s in sums])))
        assert r["method"] == "exact" and r["p"] == pytest.approx(want)
    seen = [x for x in d if x is not None]
    assert r["share_better"] == pytest.approx(np.mean([x < 0 for x in seen])) and r["mean"] == pytest.approx(np.mean(seen)) and r["lo"] <= r["mean"] <= r["hi"]


def test_wilcoxon_without_differences(spark):
    df = spark.createDataFrame([(1, 0.0), (2, None)], "rid long, delta double")
    r = ST.wilcoxon_test(df).first()
    assert (r["n"], r["n_zero"], r["p"], r["z"], r["method"], r["share_better"]) == (0, 1, None, None, None, 0.0)
    assert ST.wilcoxon_test(df.limit(0)).first()["n"] == 0


def test_cumulative_counts(spark):
    rows = [(float(v), c) for v, c in zip(np.unique(rng.integers(0, 5000, 700)), itertools.cycle([1, 2, 7]))]
    got = sorted((r["v"], r["before"]) for r in ST.cumulative(spark.createDataFrame(rows, "v double, c long").repartition(6), "v", "c").collect())
    assert got == list(zip([v for v, _ in rows], np.cumsum([0, *[c for _, c in rows]])[:-1].tolist(), strict=True))


def test_summed(spark):
    parts = [(k, i, np.full(3 + (k == "b"), float(i + 1)).tobytes()) for k in "ab" for i in range(4) for _ in range(1 + i)]
    got = {(r["key"], r["i"]): np.frombuffer(r["v"]).tolist() for r in ST.summed(spark.createDataFrame(parts, "key string, i int, v binary").repartition(5)).collect()}
    assert got == {(k, i): [float((i + 1) ** 2)] * (3 + (k == "b")) for k in "ab" for i in range(4)}
    assert ST.summed(spark.createDataFrame([], "key string, i int, v binary")).count() == 0


def test_gram_merges_in_spark(spark):
    df = spark.createDataFrame([(float(i), float(i * i % 7), float(i % 3), i % 2) for i in range(50)], "a double, b double, y double, g long").repartition(6)
    out = ST.gram(df, ["a", "b"], "y", "g")
    for g in (0, 1):
        rows = np.array([(1.0, i, i * i % 7) for i in range(50) if i % 2 == g], float)
        assert out[g][0] == 25 and np.allclose(out[g][1], rows.T @ rows) and np.allclose(out[g][2], rows.T @ np.array([i % 3 for i in range(50) if i % 2 == g]))
    assert df.where(F.lit(False)).count() == 0 and ST.gram(df.limit(0), ["a"], "y", "g") == {}
