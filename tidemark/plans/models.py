"""Spark ML models of the backtests. Missing features are filled with training means."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from ..sources.scratch import kept


def _inputs(features: list[str]) -> list:
    filled = [f"__i_{f}" for f in features]
    return [Imputer(strategy="mean", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features")]


HELD = "__v"
#: Boosting of up to 500 rounds of depth 6 at 0.05, rows and features shared at 0.8; it stops where rounds no longer lower the held-out error by a ten-thousandth.
BOOST = {"maxIter": 500, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "validationIndicatorCol": HELD, "validationTol": 1e-4, "minInstancesPerNode": 10, "seed": 1}


def held_out(features: list[str], label: str) -> Column:
    """A fifth of the rows, by a hash of what they hold."""
    return F.pmod(F.xxhash64(*features, label), F.lit(5)) == 0


def regressor(algo: str, **params):
    if algo == "rf":
        return RandomForestRegressor(**{"numTrees": 20, "maxDepth": 5, "minInstancesPerNode": 5, "seed": 1} | params)
    if algo == "gbt":
        return GBTRegressor(**BOOST | params)
    return LinearRegression(**{"regParam": 0.1} | params)


def fit(algo: str, train: DataFrame, features: list[str], label: str = "y", pca: int = 0, scale: bool = False, **params) -> PipelineModel:
    """A pipeline of imputer, optional scaler and PCA, and regressor, fitted on the rows with a label."""
    train = train.where(F.col(label).isNotNull())
    if algo == "gbt":
        train = train.withColumn(HELD, held_out(features, label))
    stages, col = _inputs(features), "features"
    if scale or pca:
        stages.append(StandardScaler(inputCol=col, outputCol="scaled", withMean=True, withStd=True))
        col = "scaled"
    if pca:
        stages.append(PCA(k=pca, inputCol=col, outputCol="pcs"))
        col = "pcs"
    model = regressor(algo, **params).setFeaturesCol(col).setLabelCol(label).setPredictionCol("p")
    return Pipeline(stages=[*stages, model]).fit(train)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with the column p."""
    return model.transform(df).select(*df.columns, "p")


def trainable(df: DataFrame, keys: list[str], label: str = "label", least: int = 5) -> DataFrame:
    """(keys, n, pos, trains): labelled rows, those of the positive class, and whether both classes have `least`."""
    one = df.where(F.col(label).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) > 0.5).alias("pos"))
    return one.withColumn("trains", F.least(F.col("pos"), F.col("n") - F.col("pos")) >= least)


def fit_classifier(algo: str, train: DataFrame, features: list[str], label: str = "label", least: int = 5) -> PipelineModel | None:
    """A balanced classifier, or None under `least` rows of either class."""
    train = train.where(F.col(label).isNotNull())
    guard = trainable(train, [], label, least).first()
    if not guard.trains:
        return None
    n, pos = guard.n, guard.pos
    train = train.withColumn("__w", F.when(F.col(label) > 0.5, F.lit(n / (2 * pos))).otherwise(F.lit(n / (2 * (n - pos)))))
    if algo == "rf":
        clf = RandomForestClassifier(numTrees=20, maxDepth=5, seed=1)
    else:
        train = train.withColumn(HELD, held_out(features, label))
        clf = GBTClassifier(**BOOST)
    return Pipeline(stages=[*_inputs(features), clf.setFeaturesCol("features").setLabelCol(label).setWeightCol("__w")]).fit(train)


def probability(model: PipelineModel | None, df: DataFrame, name: str = "prob") -> DataFrame:
    """df with the probability of the positive class; 0 without a model."""
    if model is None:
        return df.withColumn(name, F.lit(0.0))
    return model.transform(df).select(*df.columns, vector_to_array("probability")[1].alias(name))


def hurdle(clf: PipelineModel | None, spike: PipelineModel, base: PipelineModel, df: DataFrame) -> DataFrame:
    """p = P(spike) * spike model + (1 - P) * base model."""
    out = probability(clf, df)
    out = predict(spike, out).withColumnRenamed("p", "__s")
    out = predict(base, out)
    return out.withColumn("p", F.col("prob") * F.col("__s") + (1 - F.col("prob")) * F.col("p")).drop("__s")


def permuted(df: DataFrame, cols: list[str], seed: int, row: str = "row") -> DataFrame:
    """df with `cols` of another row each: a permutation of the whole table, by two numberings, of ids and of their seeded hashes. Ids must be unique."""
    own = numbered(df.drop(*cols), [], [F.col(row)], "__n")
    other = numbered(df.select(*cols, F.xxhash64(row, F.lit(seed)).alias("__h"), F.col(row).alias("__row")), [], [F.col("__h"), F.col("__row")], "__n")
    return own.join(other.drop("__h", "__row"), "__n").select(*df.columns)


def permutation_importance(model: PipelineModel, df: DataFrame, groups: dict[str, list[str]], reps: int = 3, y: str = "y", row: str = "row") -> DataFrame:
    """(family, rep, delta): rise of the RMSE when a family's columns are taken from other rows, of the whole table."""
    rmse = F.sqrt(F.avg((F.col("p") - F.col(y)) * (F.col("p") - F.col(y))))
    df = kept(df.where(F.col(y).isNotNull()), "rows")
    base = predict(model, df).agg(rmse.alias("base"))
    out = None
    for name, cols in groups.items():
        for rep in range(reps):
            score = predict(model, permuted(df, cols, rep, row)).agg(rmse.alias("rmse"))
            part = score.join(F.broadcast(base)).select(F.lit(name).alias("family"), F.lit(rep).alias("rep"), (F.col("rmse") - F.col("base")).alias("delta"))
            out = part if out is None else out.unionByName(part)
    return out


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """(feature, importance) of a tree model, falling."""
    return sorted(zip(features, (float(x) for x in model.stages[-1].featureImportances.toArray())), key=lambda x: -x[1])
