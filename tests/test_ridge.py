"""Ridge from sums against numpy on the rows."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import ridge


def rows(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 50, 0.01] + [5, -2000, 3]
    y = 4 * x[:, 0] - 0.1 * x[:, 1] + rng.normal(size=n)
    x[rng.random((n, 3)) < 0.1] = np.nan
    y[rng.random(n) < 0.1] = np.nan
    return [("ab"[i % 2], i < n * 0.7, *[None if np.isnan(v) else float(v) for v in (*x[i], y[i])]) for i in range(n)]


def numpy_fit(data, feats, penalty):
    d = np.array([[np.nan if v is None else v for v in r[2:]] for r in data], float)
    d = d[~np.isnan(d[:, 3])]
    means = np.nanmean(d, axis=0)
    z = np.nan_to_num(d - means)
    sd = np.sqrt((z**2).mean(axis=0))
    f = list(feats)
    r = (z[:, f] / sd[f]).T @ (z[:, f] / sd[f]) / len(z) + penalty * np.eye(len(f))
    return means, f, np.linalg.solve(r, (z[:, f] / sd[f]).T @ z[:, 3] / len(z)) / sd[f]


def numpy_score(data, model):
    means, f, coef = model
    d = np.array([[np.nan if v is None else v for v in r[2:]] for r in data], float)
    d = d[~np.isnan(d[:, 3])]
    e = d[:, 3] - means[3] - np.nan_to_num(d[:, f] - means[f]) @ coef
    return np.sqrt((e**2).mean()), 1 - (e**2).sum() / ((d[:, 3] - d[:, 3].mean()) ** 2).sum(), len(d)


def test_subsets_pools_and_scores(spark):
    data, cols = rows(), ["x0", "x1", "x2", "y"]
    df = spark.createDataFrame(data, "k string, train boolean, x0 double, x1 double, x2 double, y double")
    mom = ridge.moments(df.where("y IS NOT NULL"), ["k", "train"], cols).cache()
    sets = {"one": (["x1"], "y"), "all": (["x2", "x0", "x1"], "y")}
    train, test = mom.where("train").drop("train"), mom.where("NOT train").drop("train")
    own, pooled = ridge.fit(train, ["k"], cols, sets, 0.01), ridge.fit(ridge.merged(train, []), [], cols, sets, 0.01)
    for models, on in ((own, ["k"]), (pooled, [])):
        got = {(r["k"], r["model"]): r for r in ridge.scored(test, ["k"], 4, models, on).collect()}
        for k in "ab":
            for name, feats in (("one", [1]), ("all", [2, 0, 1])):
                want = numpy_score([r for r in data if r[0] == k and not r[1]], numpy_fit([r for r in data if r[1] and (not on or r[0] == k)], feats, 0.01))
                r = got[k, name]
                assert np.allclose([r["RMSE"], r["R2"], r["n_test"]], want, rtol=1e-8)
    out = ridge.predicted(df, cols, pooled.where("model = 'all'"), [])
    means, f, coef = numpy_fit([r for r in data if r[1]], [2, 0, 1], 0.01)
    for r in out.select(*cols, "p").limit(50).collect():
        x = np.array([np.nan if v is None else v for v in r[:4]], float)
        assert np.isclose(r["p"], means[3] + np.nan_to_num(x[f] - means[f]) @ coef)


def test_edges(spark):
    df = spark.createDataFrame([("a", 1.0, None, 5.0), ("a", 1.0, None, 5.0), ("b", None, None, None)], "k string, x0 double, x1 double, y double")
    mom = ridge.moments(df, ["k"], ["x0", "x1", "y"])
    models = ridge.fit(mom, ["k"], ["x0", "x1", "y"], {"m": (["x0", "x1"], "y")})
    (r,) = ridge.scored(mom, ["k"], 3, models, ["k"]).collect()
    assert (r["k"], r["RMSE"], r["R2"], r["n_test"]) == ("a", 0.0, None, 2)
    assert ridge.fit(ridge.moments(df.limit(0), ["k"], ["x0", "y"]), ["k"], ["x0", "y"], {"m": (["x0"], "y")}).count() == 0
    assert ridge.moments(df, [], ["y"]).select(F.col("n")).first()[0] == 2


def test_sums_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(ridge, "HELD", 1)
    data = rows()
    df = spark.createDataFrame(data, "k string, train boolean, x0 double, x1 double, x2 double, y double").repartition(4)
    got = {(r["k"], r["p"]): r for r in ridge.moments(df, ["k"], ["x0", "y"]).collect()}
    for k in "ab":
        both = [(r[2], r[5]) for r in data if r[0] == k and r[2] is not None and r[5] is not None]
        r = got[k, 1]
        assert r["n"] == len(both) and np.allclose([r["a"], r["b"], r["s"]], [sum(x for x, _ in both), sum(y for _, y in both), sum(x * y for x, y in both)])
