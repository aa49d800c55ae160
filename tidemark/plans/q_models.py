"""Queries: Spark ML models on the daily panel. Forests depend on the partitioning, so these have no DuckDB text."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import metrics as M
from ..operators.grid import lags
from ..operators.qc import confusion
from ..sources.scratch import kept, scratch
from . import backtest as B
from . import models as ML
from .q_series import LENGTHS, REPS, cv_scores, scenarios, shared
from .registry import PANEL, daily, panel, query, r

c, lit = F.col, F.lit
FEATURES = ["y_lag1", "y_lag2", "y_lag7", "n_lag1", "hs", "hc", "ws", "wc"]
CUT = 10957


def matrix(spark, sf) -> DataFrame:
    """(series, d, row, y, features): the daily feature matrix; lags only, so no feature sees its own day."""
    o = daily(spark, sf)
    m = lags(lags(o, ["series"], "y", [1, 2, 7], t="d"), ["series"], "n", [1], t="d")
    doy = F.dayofyear(F.date_add(lit("1970-01-01").cast("date"), c("d").cast("int")))
    s, k = X.cyclic(doy, 365)
    ws, wc = X.cyclic(F.pmod("d", lit(7)), 7)
    code = F.pmod(F.crc32("series"), lit(97)).cast("long")
    m = m.withColumns({"hs": s, "hc": k, "ws": ws, "wc": wc}).withColumn("row", c("d") * 97 + code).withColumn("n_lag1", c("n_lag1").cast("double"))
    return m.select("series", "d", "row", "y", *FEATURES)


def halves(spark, sf):
    m = kept(matrix(spark, sf), "matrix")
    return m.where(c("d") < CUT), m.where(c("d") >= CUT)


def scored(df: DataFrame, by: list[str], model: str) -> DataFrame:
    return M.point_metrics(df, by).select(*by, lit(model).alias("model"), r("RMSE").alias("RMSE"), r("R2").alias("R2"), "n_test")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _algo(name, algo, **params):
    @query(name)
    def run(spark, sf):
        train, test = halves(spark, sf)
        return scored(ML.predict(ML.fit(algo, train, FEATURES, **params), test), ["series"], algo)
    return run


_algo("l2_random_forest", "rf")
_algo("l3_boosted_trees", "gbt")
_algo("l20_pca_forest", "rf", pca=7)


def labelled(spark, sf):
    train, test = halves(spark, sf)
    thr = B.thresholds(train, "series")
    label = lambda d: d.join(thr, "series").withColumn("label", (c("y") > c("thr")).cast("double"))
    return label(train), label(test)


def _classifier(name, algo):
    @query(name)
    def run(spark, sf):
        train, test = labelled(spark, sf)
        out = ML.probability(ML.fit_classifier(algo, train, FEATURES), test)
        m = M.event_metrics(out, ["series"])
        return m.select("series", r("precision").alias("precision"), r("recall").alias("recall"), r("f1").alias("f1"), "n_spike")
    return run


_classifier("l4_balanced_forest", "rf")
_classifier("l5_boosted_classifier", "gbt")


@query("l7_hurdle")
def l7(spark, sf):
    train, test = labelled(spark, sf)
    clf = ML.fit_classifier("rf", train, FEATURES)
    spike = ML.fit("rf", train.where("label > 0.5"), FEATURES)
    base = ML.fit("rf", train.where("label <= 0.5"), FEATURES)
    return scored(ML.hurdle(clf, spike, base, test), ["series"], "hurdle")


def hourly(spark, sf) -> DataFrame:
    """(series, t, y, features): the hourly feature matrix of track A; lags only."""
    m = lags(panel(spark, sf).select("series", "t", "y"), ["series"], "y", [1, 2, 24])
    s, k = X.cyclic(F.pmod("t", lit(24)), 24)
    return m.withColumn("hs", s).withColumn("hc", k)


def direct(m: DataFrame, t: str, cut: int, features: list[str], track: str, horizons: tuple[int, ...]) -> list[DataFrame]:
    """Scores of one model per horizon, trained on targets before the cut."""
    parts = []
    for h in horizons:
        target = m.select("series", (c(t) - h).alias(t), c("y").alias("target"))
        a = m.withColumnRenamed("y", "y_now").join(target, ["series", t]).withColumnRenamed("target", "y").withColumn("tt", c(t) + h)
        model = ML.fit("rf", a.where(c("tt") < cut), ["y_now", *features], numTrees=10)
        s = M.point_metrics(ML.predict(model, a.where(c("tt") >= cut)), ["series"], naive="y_now", least=10)
        parts.append(s.select("series", lit(track).alias("track"), lit(h).alias("h"), r("RMSE").alias("RMSE"), r("skill_persist").alias("skill_persist"), "n_test"))
    return parts


@query("l10_direct_backtest")
def l10(spark, sf):
    """Track A in hours, track B in days."""
    hours = kept(hourly(spark, sf), "hours")
    cut = hours.agg(((F.min("t") + F.max("t")) / 2).cast("long")).first()[0]
    parts = direct(hours, "t", cut, ["y_lag1", "y_lag2", "y_lag24", "hs", "hc"], "A", (1, 6, 12, 24, 48))
    return union(parts + direct(matrix(spark, sf), "d", CUT, FEATURES, "B", (1, 3, 7, 14)))


@query("l12_pooling")
def l12(spark, sf):
    train, test = halves(spark, sf)
    names = [x[0] for x in train.where("y IS NOT NULL").select("series").distinct().orderBy("series").collect()]  # one per series
    dummies = lambda d: d.select("*", *[F.when(c("series") == n, 1.0).otherwise(0.0).alias(f"is{i}") for i, n in enumerate(names)])
    solo = [ML.predict(ML.fit("rf", train.where(c("series") == n), FEATURES, numTrees=10), test.where(c("series") == n)) for n in names]
    full = ML.predict(ML.fit("rf", train, FEATURES, numTrees=10), test)
    part = ML.predict(ML.fit("rf", dummies(train), [*FEATURES, *[f"is{i}" for i in range(len(names))]], numTrees=10), dummies(test))
    return union([scored(union(solo), ["series"], "solo"), scored(full, ["series"], "full"), scored(part, ["series"], "partial")])


@query("l18_permutation")
def l18(spark, sf):
    """Families by horizon in days, three repetitions each."""
    m, parts = kept(matrix(spark, sf), "matrix"), []
    for h in (1, 7):
        target = m.select("series", (c("d") - h).alias("d"), c("y").alias("target"))
        a = m.withColumnRenamed("y", "y_now").join(target, ["series", "d"]).withColumnRenamed("target", "y")
        model = ML.fit("rf", a.where(c("d") + h < CUT), ["y_now", *FEATURES], numTrees=10)
        out = ML.permutation_importance(model, a.where(c("d") + h >= CUT), {"history": ["y_now", "y_lag1", "y_lag2", "y_lag7"], "season": ["hs", "hc"], "week": ["ws", "wc"]})
        parts.append(out.select("family", lit(h).alias("h"), "rep", r("delta").alias("delta")))
    return union(parts)


for _n in ("l19_importance", "o3_top_importances"):
    @query(_n)
    def l19(spark, sf):
        train, _ = halves(spark, sf)
        ranked = ML.importances(ML.fit("rf", train, FEATURES, numTrees=10), FEATURES)
        return spark.createDataFrame(ranked, "feature string, importance double").orderBy(c("importance").desc()).limit(5)


@query("l23_spike_diagnostics")
def l23(spark, sf):
    train, test = labelled(spark, sf)
    out = ML.probability(ML.fit_classifier("rf", train, FEATURES), test)
    return out.groupBy(confusion(c("label") > 0.5, c("prob") > 0.5).alias("cell")).agg(F.count(lit(1)).alias("n"), r(F.avg("y_lag1")).alias("y_lag1"), r(F.avg("n_lag1")).alias("n_lag1"))


def tower_frame(spark, sf):
    """(series, t, y, ta, sw, hs, hc, ds, dc): the hourly panel, its target passed by flag and plausibility, with clock and calendar; cut: middle hour."""
    h = panel(spark, sf)
    hs, hc = X.cyclic(F.pmod("t", lit(24)), 24)
    ds, dc = X.cyclic(F.dayofyear(F.date_add(lit("1970-01-01").cast("date"), F.floor(c("t") / 24).cast("int"))), 365)
    h = h.withColumn("hs", hs).withColumn("hc", hc).withColumn("ds", ds).withColumn("dc", dc)
    return h, h.agg(((F.min("t") + F.max("t")) / 2).cast("long")).first()[0]


CLOCK = ["ta", "sw", "hs", "hc", "ds", "dc"]


def reconstruct(h: DataFrame, cut: int, features: list[str], **params) -> DataFrame:
    """(series, t, y, p): one model for each series, fitted before the cut, predicting all its hours."""
    names = [x[0] for x in h.where(c("y").isNotNull() & (c("t") < cut)).select("series").distinct().orderBy("series").collect()]  # one per series
    fits = [(n, ML.fit("rf", h.where((c("series") == n) & (c("t") < cut)), features, **params)) for n in names]
    return union([ML.predict(m, h.where(c("series") == n)).select("series", "t", "y", "p") for n, m in fits])


@query("g5_reconstruction")
def g5(spark, sf):
    """Per series: observed where it passed the gates, else the reconstruction; scores on the hours after the cut, null under 20."""
    h, cut = tower_frame(spark, sf)
    path = scratch(spark, "reconstruction")
    reconstruct(h, cut, CLOCK, numTrees=10).write.parquet(path)
    out = spark.read.parquet(path)
    scores = M.point_metrics(out.where(c("t") >= cut), ["series"], least=20).select("series", r("R2").alias("test_r2"), r("RMSE").alias("test_rmse"), c("n_test").alias("test_n"))
    return out.join(F.broadcast(scores), "series", "left").select("series", "t", r(F.coalesce("y", "p")).alias("filled"), c("y").isNotNull().cast("int").alias("mask"), "test_r2", "test_rmse", "test_n")


@query("g5_reconstruction_mask", f"WITH {PANEL}, q AS (SELECT (min(t) + max(t)) // 2 AS cut FROM h) SELECT series, count(*) AS hours, count(*) FILTER (y IS NOT NULL) AS observed, round(sum(round(y, 4)), 4) AS total, CASE WHEN count(*) FILTER (y IS NOT NULL AND t >= cut) >= 20 THEN count(*) FILTER (y IS NOT NULL AND t >= cut) END AS test_n FROM h, q GROUP BY series, cut")
def g5_mask(spark, sf):
    """What of the reconstruction does not depend on the forest: every hour filled, observed values unchanged, the scored hours."""
    out = g5(spark, sf).where("filled IS NOT NULL")
    return out.groupBy("series").agg(F.count(lit(1)).alias("hours"), F.sum("mask").alias("observed"), r(F.sum(F.when(c("mask") == 1, c("filled")))).alias("total"), F.first("test_n").alias("test_n"))


def series_of(h: DataFrame) -> list[str]:
    return [x[0] for x in h.select("series").distinct().orderBy("series").collect()]  # one per series


def pooled_fill(h: DataFrame, features: list[str], names: list[str], **params) -> DataFrame:
    """(series, t, y, p): one forest on the observed rows of all series with a column that tells each series apart."""
    told = h.select("*", *[F.when(c("series") == n, 1.0).otherwise(0.0).alias(f"is{i}") for i, n in enumerate(names)])
    model = ML.fit("rf", told, [*features, *[f"is{i}" for i in range(len(names))]], **params)
    return ML.predict(model, told).select("series", "t", "y", "p")


@query("g6_pooled_fill")
def g6(spark, sf):
    h, _ = tower_frame(spark, sf)
    out = pooled_fill(h, CLOCK, series_of(h))
    return out.select("series", "t", r(F.coalesce("y", "p")).alias("filled"), c("y").isNotNull().cast("int").alias("mask"))


def forest_cv(spark, sf, ta: str) -> DataFrame:
    """Scores of the pooled forest under the gap scenarios, with the temperature `ta`: for each, fitted on the rows that are not masked and scored on those that are."""
    def make():
        hs, hc = X.cyclic(F.pmod("t", lit(24)), 24)
        rows = scenarios(spark, sf).withColumn("hs", hs).withColumn("hc", hc)
        names = series_of(rows)

        def filled(scenario):
            g, i = scenario
            out = pooled_fill(rows.where((c("gap") == g) & (c("rep") == i)), [ta, "sw", "hs", "hc"], names, numTrees=10)
            return out.where("y IS NULL").select(lit(g).alias("gap"), lit(i).alias("rep"), "series", "t", c("p").alias("filled"))
        with ThreadPoolExecutor(4) as pool:  # the fits are small jobs that leave cores idle
            return cv_scores(union(list(pool.map(filled, [(g, i) for g in (*LENGTHS, 0) for i in range(REPS)]))), rows)
    return shared(spark, sf, f"forest-cv-{ta}", make)


@query("g9_forest_cross_validation")
def g9_forest(spark, sf):
    return forest_cv(spark, sf, "ta").select(lit("RF").alias("method"), "gap", "rep", "series", r("RMSE").alias("RMSE"), "n_test")


@query("g11_forest_source_ab")
def g11_forest(spark, sf):
    """Drivers of the series against drivers of the site under the forest, medians over repetitions."""
    med = lambda ta, name: B.median_over_reps(forest_cv(spark, sf, ta), ["series", "gap"], "RMSE").select("series", "gap", c("RMSE").alias(name))
    both = med("ta", "own").join(med("sta", "site"), ["series", "gap"])
    return both.select("series", "gap", r("own").alias("own"), r("site").alias("site"), r(c("site") - c("own")).alias("delta"))


@query("streaming_hourly_means", "SELECT event_type AS series, count(*) AS hours FROM (SELECT event_type, date_trunc('hour', ts) AS h FROM events GROUP BY ALL) GROUP BY event_type")
def stream(spark, sf):
    """The hourly mean as a stream over the events table, run to its end; counts of emitted hours."""
    from ..streaming.hourly import hourly_means
    src, out = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_type", c("ts").cast("timestamp").alias("ts"), "value")
    last = e.groupBy(lit("end").alias("event_type")).agg(F.timestamp_add("DAY", lit(9), F.max("ts")).alias("ts")).withColumn("value", lit(0.0))
    e.write.parquet(src)
    means = hourly_means(spark.readStream.schema(e.schema).parquet(src), "event_type", "ts", "value")
    # a later batch moves the watermark past the last hour
    q = means.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "stream-state")).outputMode("append").start()
    try:
        q.processAllAvailable()
        last.write.mode("append").parquet(src)
        q.processAllAvailable()
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.parquet(out).groupBy(c("event_type").alias("series")).agg(F.count(lit(1)).alias("hours"))
