"""Forecast baselines, backtests, thresholds and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import conformal_level
from ..operators.order import numbered, running
from ..operators.select import quantiles


def climatology(train: DataFrame, test: DataFrame, key: str, by: list[str], y: str = "y", min_rows: int = 24, name: str = "clim") -> DataFrame:
    """test with the mean of the training rows of its key and `by` cell; keys under min_rows training rows take the pooled cell. An empty cell takes the mean of the rows that it was looked for in."""
    n = train.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.avg(y).alias("__m"))
    own = train.groupBy(key, *by).agg(F.avg(y).alias("__o"))
    pooled = train.groupBy(*by).agg(F.avg(y).alias("__p"))
    total = train.agg(F.avg(y).alias("__g"))  # one row
    out = test.join(n, key, "left").join(own, [key, *by], "left").join(pooled, by, "left").join(F.broadcast(total))
    best = F.when(F.coalesce(F.col("__n"), F.lit(0)) >= min_rows, F.coalesce("__o", "__m")).otherwise(F.coalesce("__p", "__g"))
    return out.withColumn(name, best).drop("__n", "__m", "__o", "__p", "__g")


def thresholds(df: DataFrame, key: str, y: str = "y", q: float = 0.9, min_rows: int = 20) -> DataFrame:
    """(key, thr): the exact quantile of a key's rows, null under min_rows."""
    n = df.groupBy(key).agg(F.count(y).alias("__n"))
    return n.join(quantiles(df, [key], y, [q]), key, "left").select(key, F.when(F.col("__n") >= min_rows, F.get("q", F.lit(0))).alias("thr"))


def folds(df: DataFrame, cuts: list[tuple[int, int]], t: str = "t") -> DataFrame:
    """One copy of a row per fold (start, stop) that holds or precedes it: fold and role train (before start) or test."""
    rows = [F.struct(F.lit(i).alias("fold"), F.when(F.col(t) < a, "train").when(F.col(t) < b, "test").alias("role")) for i, (a, b) in enumerate(cuts)]
    out = df.withColumn("__f", F.explode(F.array(*rows))).where(F.col("__f.role").isNotNull())
    return out.select(*df.columns, F.col("__f.fold").alias("fold"), F.col("__f.role").alias("role"))


def conformal(calibration: DataFrame, test: DataFrame, by: list[str], y: str = "y", p: str = "p", alpha: float = 0.1) -> DataFrame:
    """test with lo and hi = p -+ the quantile of the absolute calibration residuals, at the split-conformal level."""
    resid = calibration.select(*by, F.abs(F.col(y) - F.col(p)).alias("__r")).where(F.col("__r").isNotNull())
    # the two order statistics around the level, from ranks over a range partition; nothing is gathered
    ranked = numbered(resid, by, [F.col("__r")], "__k", "__n").withColumn("__at", (F.col("__n") - 1) * conformal_level(F.col("__n"), alpha))
    low = F.floor("__at")
    ends = ranked.groupBy(*by).agg(F.max("__at").alias("__at"), F.max(F.when(F.col("__k") == low, F.col("__r"))).alias("__a"), F.max(F.when(F.col("__k") == low + 1, F.col("__r"))).alias("__b"))
    half = ends.select(*by, (F.col("__a") + (F.coalesce("__b", "__a") - F.col("__a")) * (F.col("__at") - F.floor("__at"))).alias("__q"))
    return test.join(half, by).withColumn("lo", F.col(p) - F.col("__q")).withColumn("hi", F.col(p) + F.col("__q")).drop("__q")


def quantile_bands(calibration: DataFrame, test: DataFrame, by: list[str], qs: tuple[float, ...] = (0.05, 0.5, 0.95), y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """test with q0, q1, ... = p + residual quantiles of its prediction bin, sorted so that they do not cross."""
    edges = quantiles(calibration, by, p, [i / bins for i in range(1, bins)], "__e")
    bin_ = F.aggregate("__e", F.lit(0), lambda a, e: a + (F.col(p) > e).cast("int"))
    cal = calibration.join(edges, by).withColumn("__b", bin_)
    resid = quantiles(cal, [*by, "__b"], F.col(y) - F.col(p), list(qs), "__q")
    out = test.join(edges, by).withColumn("__b", bin_).join(resid, [*by, "__b"])
    ordered = F.array_sort(F.transform("__q", lambda q: F.col(p) + q))
    return out.select(*test.columns, *[F.get(ordered, i).alias(f"q{i}") for i in range(len(qs))])


def pr_curve(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """(by, threshold, precision, recall) at each distinct score, from sums per score."""
    at = df.groupBy(*by, F.col(score).alias("threshold")).agg(F.count_if(F.col(label) > 0.5).alias("tp"), F.count(F.lit(1)).alias("n"))
    total = df.groupBy(*by).agg(F.count_if(F.col(label) > 0.5).alias("pos"))
    at = running(at, by, [F.col("threshold").desc()], {"ctp": F.col("tp"), "cn": F.col("n")}).join(total, by)
    return at.select(*by, "threshold", (F.col("ctp") / F.col("cn")).alias("precision"), (F.col("ctp") / F.nullif(F.col("pos"), F.lit(0))).alias("recall"))


def operating_point(curve: DataFrame, by: list[str], min_recall: float = 0.8) -> DataFrame:
    """The highest threshold with at least the recall."""
    ok = curve.where(F.col("recall") >= min_recall)
    return ok.groupBy(*by).agg(F.max("threshold").alias("threshold"), F.max_by("precision", "threshold").alias("precision"), F.max_by("recall", "threshold").alias("recall"))


def hashed(row: Column, seed: int) -> Column:
    """A seeded order of integers."""
    return F.pmod((row + seed * 7919) * 2654435761, F.lit(1000003))


def median_over_reps(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The exact median of each group; a group holds one row a repetition."""
    return df.groupBy(*by).agg(F.median(value).alias(value))
