"""Arithmetic around the models: permutations, held-out rows, the hurdle."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import gaps
from tidemark.plans import models as ML
from tidemark.plans import q_series
from tidemark.sources.scratch import kept


def test_permutation_of_the_whole_table(spark):
    df = spark.range(9000).select(F.col("id").alias("row"), (F.col("id") * 2).alias("a"), (F.col("id") * 3).alias("b"), F.lit("x").alias("c")).repartition(5)
    out = ML.permuted(df, ["a", "b"], 7).collect()
    assert out[0].asDict().keys() == {"row", "a", "b", "c"} and sorted(r["row"] for r in out) == list(range(9000))
    assert sorted(r["a"] for r in out) == [2 * i for i in range(9000)] and all(3 * r["a"] == 2 * r["b"] for r in out)  # columns of a family move together
    moved = [abs(r["row"] - r["a"] // 2) for r in out]
    assert sum(m > 0 for m in moved) > 8900 and max(moved) > 8000 and sum(m > 3000 for m in moved) > 2000
    again = {(r["row"], r["a"]) for r in ML.permuted(df.repartition(3), ["a", "b"], 7).collect()}
    assert again == {(r["row"], r["a"]) for r in out} != {(r["row"], r["a"]) for r in ML.permuted(df, ["a", "b"], 8).collect()}


def test_importance_of_a_column_that_is_the_target(spark):
    df = spark.range(2000).select(F.col("id").alias("row"), F.pmod(F.xxhash64("id"), F.lit(100)).cast("double").alias("a"), F.rand(3).alias("noise")).withColumn("y", F.col("a") * 5)
    model = ML.fit("lr", df, ["a", "noise"])
    got = {(r["family"], r["rep"]): r["delta"] for r in ML.permutation_importance(model, df, {"a": ["a"], "noise": ["noise"]}, 2).collect()}
    assert len(got) == 4 and min(got["a", 0], got["a", 1]) > 100 and abs(got["noise", 0]) < 1


def test_held_out_rows(spark):
    df = spark.range(5000).select(F.col("id").cast("double").alias("a"), F.rand(1).alias("y"))
    n = df.where(ML.held_out(["a"], "y")).count()
    assert 850 < n < 1150


def test_hurdle_mixes_by_probability(spark):
    """Without a classifier the probability is 0, so the base model alone counts."""
    df = spark.range(100).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0 + 1).alias("y"))
    base, spike = ML.fit("lr", df, ["a"], regParam=0.0), ML.fit("lr", df.withColumn("y", F.col("y") + 1000), ["a"], regParam=0.0)
    row = ML.hurdle(None, spike, base, df).where("a = 10").first()
    assert row["p"] == pytest.approx(21, abs=1e-6) and row["prob"] == 0


def test_a_scenario_is_read_without_the_others(spark):
    rows = q_series.scenarios(spark, "/root/testdata/sf0.001").where("gap = 4 AND rep = 1")
    assert "PartitionFilters: [isnotnull(gap" in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() and rows.where("y IS NULL").count()


def test_starts_of_gaps_are_drawn_by_several_tasks(spark, monkeypatch):
    tasks = {}

    def watched(df, name):
        tasks[name] = df.rdd.getNumPartitions()
        return kept(df, name)

    monkeypatch.setattr(gaps, "kept", watched)
    df = spark.range(50_000).select(F.lit("a").alias("s"), F.col("id").alias("t"), F.rand(1).alias("y"))
    assert gaps.calendar_gaps(df, ["s"], "y", 32, 0).count() >= 12_500
    assert tasks["starts"] > 1
