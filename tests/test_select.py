"""Quantiles by selection against numpy, and the plan: nothing gathers a group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import select

QS = [0.0, 0.01, 0.05, 0.25, 0.5, 0.9, 0.95, 1.0]


def groups(seed=1):
    rng = np.random.default_rng(seed)
    return {"normal": rng.normal(size=3000), "ties": np.repeat([1.0, 2.0, 5.0], [2000, 7, 900]), "one": np.full(1500, 3.25), "few": rng.normal(size=5), "single": np.array([7.0]),
            "far": np.concatenate([rng.normal(size=2000), [1e12, -1e9]]), "exp": np.exp(rng.normal(size=2500) * 8), "ints": rng.integers(0, 40, 2200).astype(float)}


@pytest.mark.parametrize("gather", [10, 4096])
def test_selection(spark, gather):
    data = [(k, float(v)) for k, vs in groups().items() for v in vs] + [("null", None), ("ties", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    got = {r["k"]: r["q"] for r in select.quantiles(df, ["k"], "v", QS, gather=gather).collect()}
    assert set(got) == set(groups())
    for k, vs in groups().items():
        assert np.allclose(got[k], np.quantile(vs, QS), rtol=1e-12, atol=1e-12)


def test_without_keys_and_rows(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert select.quantiles(df, [], "v", [0.5, 0.999], gather=20).first()["q"] == pytest.approx([499.5, 998.001])
    assert select.medians(df, [], F.col("v") * 2).first()["med"] == 999
    assert select.quantiles(df.limit(0), [], "v", [0.5]).count() == 0
    assert select.quantiles(df.withColumn("k", F.lit(1)).limit(0), ["k"], "v", [0.5], gather=0).count() == 0


def test_no_plan_gathers_a_group(spark, monkeypatch):
    """Each pass groups by interval and bin; the lists that are sorted hold `gather` values at most."""
    df = spark.range(50_000).select(F.lit("a").alias("k"), F.sqrt("id").alias("v"))
    sizes = []
    real = select._meets

    def watched(rows, intervals, by):
        sizes.append(intervals.agg(F.max("n")).first()[0])
        return real(rows, intervals, by)
    monkeypatch.setattr(select, "_meets", watched)
    out = select.quantiles(df, ["k"], "v", [0.1, 0.5], gather=100)
    assert "percentile" not in out._jdf.queryExecution().toString()
    assert sizes[0] == 50_000 and sizes[-1] <= 100 and len(sizes) <= 4
    assert np.allclose(out.first()["q"], np.quantile(np.sqrt(np.arange(50_000)), [0.1, 0.5]))
