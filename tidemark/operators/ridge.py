"""Ridge regression from sufficient statistics: one scan per table, whatever the number of groups, targets and feature sets.

moments() sums products of pairs of columns by group; groups can be merged, and every model over any of the columns is fitted,
and scored on other groups, from these sums alone. Features are standardised by training means and deviations, missing ones
take the training mean, and the penalty is on standardised coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD = 32 << 20  # bytes of sums that a task holds before it hands them on


def moments(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """(by, p, n, a, b, s): for each group and pair p = i * len(cols) + j, over the rows in which columns i and j are both
    present, their number, the sums of i and of j, and the sum of products. NaN counts as missing.

    Matrix products in Arrow batches, summed in the task; what is shuffled are pairs a group, whatever the rows.
    """
    k = len(cols)
    rows = df.select(*[F.col(f"`{c}`") for c in by], *[F.col(f"`{c}`").cast("double").alias(f"x{i}__") for i, c in enumerate(cols)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def handed() -> pa.RecordBatch:
            keys, sums = list(held), np.stack(list(held.values())).reshape(len(held), 3, k, k)
            flat = [sums[:, 0], sums[:, 1], sums[:, 1].transpose(0, 2, 1), sums[:, 2]]
            places = np.repeat(np.arange(len(keys)), k * k)
            firsts = [pa.array([key[i] for key in keys], t).take(pa.array(places)) for i, t in enumerate(types)]
            held.clear()
            return pa.RecordBatch.from_arrays([*firsts, pa.array(np.tile(np.arange(k * k, dtype=np.int32), len(keys))), *[pa.array(x.reshape(-1)) for x in flat]], names)

        for batch in batches:
            types, names = [batch.schema.field(i).type for i in range(len(by))], [*batch.schema.names[: len(by)], "p", "n", "a", "b", "s"]
            x = np.column_stack([batch.column(len(by) + i).to_numpy(zero_copy_only=False).astype(float) for i in range(k)])
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(len(by))])) if by else [()] * len(x)
            number = {key: i for i, key in enumerate(dict.fromkeys(keys))}
            group = np.fromiter((number[key] for key in keys), np.int64, len(keys))
            order = np.argsort(group, kind="stable")
            for key, at in zip(number, np.split(order, np.cumsum(np.bincount(group, minlength=len(number)))[:-1])):
                there = ~np.isnan(x[at])
                v, there = np.where(there, x[at], 0.0), there.astype(float)
                sums = np.stack([there.T @ there, v.T @ there, v.T @ v])
                held[key] = held[key] + sums if key in held else sums
            if len(held) * 24 * k * k > HELD:
                yield handed()
        if held:
            yield handed()

    schema = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by) + "p int, n double, a double, b double, s double"
    return merged(rows.mapInArrow(run, schema), by)


def merged(mom: DataFrame, by: list[str]) -> DataFrame:
    """Moments of unions of groups."""
    return mom.groupBy(*by, "p").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "s")])


def matrices(mom: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by, m): m[i][j] holds (n, a, b, s) of columns i and j."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("p", "n", "a", "b", "s"))), lambda x: F.struct(*[x[f].alias(f) for f in ("n", "a", "b", "s")]))
    return mom.groupBy(*by).agg(cells.alias("c")).select(*by, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.slice("c", i * k + 1, F.lit(k))).alias("m"))


def cell(i: int, j: int) -> Column:
    """(n, a, b, s) of a pair in matrices()."""
    return F.get(F.get("m", F.lit(i)), F.lit(j))


def _about(m: Column, means: Column) -> Column:
    """Sums of products about the given means; missing values count as the mean."""
    return F.transform(m, lambda row, i: F.transform(row, lambda e, j: e["s"] - F.get(means, i) * e["b"] - F.get(means, j) * e["a"] + e["n"] * F.get(means, i) * F.get(means, j)))


def _solved(rows: Column) -> Column:
    """Right-hand side of an augmented matrix, symmetric and positive definite but for its last column, after elimination."""
    def step(acc: Column, k: Column) -> Column:
        pivot = F.get(acc, k)
        return F.transform(acc, lambda row, i: F.when(i == k, F.transform(row, lambda x: x / F.get(pivot, k))).otherwise(F.zip_with(row, pivot, lambda x, p: x - F.get(row, k) / F.get(pivot, k) * p)))
    return F.transform(F.aggregate(F.sequence(F.lit(0), F.size(rows) - 1), rows, step), lambda row: F.element_at(row, -1))


def fit(train: DataFrame, by: list[str], cols: list[str], sets: dict[str, tuple[list[str], str]], penalty: float = 1e-3) -> DataFrame:
    """(by, model, features, target, means, coef): one row per group of moments and set name -> (features, target).

    features and target are places in cols, coef the coefficients of (feature - mean). A group without a row that has the
    target gives none. Targets must be missing only where a row is not to count: see moments().
    """
    at = {c: i for i, c in enumerate(cols)}
    which = F.array(*[F.struct(F.lit(n).alias("model"), F.array(*[F.lit(at[f]) for f in fs]).alias("features"), F.lit(at[y]).alias("target")) for n, (fs, y) in sets.items()])
    rows = matrices(train, by, len(cols)).withColumn("w", F.explode(which)).select(*by, "m", "w.*")
    rows = rows.withColumn("n", F.get(F.get("m", F.col("target")), F.col("target"))["n"]).where("n > 0")
    # means over the rows that have the target; a feature without any value has mean 0
    rows = rows.withColumn("means", F.transform("m", lambda row: F.coalesce(F.get(row, F.col("target"))["a"] / F.nullif(F.get(row, F.col("target"))["n"], F.lit(0.0)), F.lit(0.0))))
    rows = rows.withColumn("c", _about(F.col("m"), F.col("means")))
    at2 = lambda i, j: F.get(F.get("c", i), j) / F.col("n")
    rows = rows.withColumn("sd", F.transform("features", lambda i: F.when(at2(i, i) > 0, F.sqrt(at2(i, i))).otherwise(1.0)))
    system = F.transform("features", lambda i, p: F.concat(
        F.transform("features", lambda j, q: at2(i, j) / (F.get("sd", p) * F.get("sd", q)) + F.when(p == q, penalty).otherwise(0.0)), F.array(at2(i, F.col("target")) / F.get("sd", p))))
    coef = F.zip_with(_solved(system), F.col("sd"), lambda b, s: b / s)
    return rows.select(*by, "model", "features", "target", "means", coef.alias("coef"))


def scored(test: DataFrame, by: list[str], k: int, models: DataFrame, on: list[str]) -> DataFrame:
    """(by, model, RMSE, R2, n_test) of each group of moments under the models that agree in `on` (none: all models, of one row of moments).

    Missing features take the training mean. R2 is null for a constant target. A group without the target gives no row.
    """
    rows = matrices(test, by, k)
    rows = rows.join(models, on) if on else rows.join(F.broadcast(models))
    own = F.get(F.get("m", F.col("target")), F.col("target"))
    rows = rows.withColumn("n_test", own["n"].cast("long")).where("n_test > 0").withColumn("c", _about(F.col("m"), F.col("means")))
    at = lambda i, j: F.get(F.get("c", i), j)
    y = F.col("target")
    fx = F.arrays_zip("features", "coef")
    cross = F.aggregate(fx, F.lit(0.0), lambda acc, f: acc + f["coef"] * at(f["features"], y))
    square = F.aggregate(fx, F.lit(0.0), lambda acc, f: acc + F.aggregate(fx, F.lit(0.0), lambda inner, g: inner + f["coef"] * g["coef"] * at(f["features"], g["features"])))
    sse = F.greatest(at(y, y) - 2 * cross + square, F.lit(0.0))
    spread = own["s"] - own["a"] * own["a"] / own["n"]
    return rows.withColumn("__e", sse).withColumn("__v", spread).select(
        *by, "model", F.sqrt(F.col("__e") / F.col("n_test")).alias("RMSE"), F.when(F.col("__v") > 1e-9 * own["s"], 1 - F.col("__e") / F.col("__v")).alias("R2"), "n_test")


def predicted(df: DataFrame, cols: list[str], models: DataFrame, on: list[str], name: str = "p") -> DataFrame:
    """df with the prediction of each model that agrees in `on` (none: models has one row), for rows one by one."""
    rows = df.join(models, on) if on else df.join(F.broadcast(models))
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in cols])
    part = F.aggregate(F.arrays_zip("features", "coef"), F.get("means", F.col("target")), lambda acc, f: acc + f["coef"] * F.coalesce(F.get(x, f["features"]) - F.get("means", f["features"]), F.lit(0.0)))
    return rows.withColumn(name, part).drop("features", "target", "means", "coef")
