"""Numbers and running sums over a value order, without gathering a key in one task.

Rows are dealt by ranges of (keys, order) and sorted there; what a part has of each key is one summary row, and sums over
the summaries of the parts before carry the numbers on. The rows of one key may lie in any number of parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch

AT, PART = "at__", "part__"


def ranged(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """df in (keys, order), written; `at__` grows with the order and counts the rows of a part, whose number is in its upper bits."""
    sort = [*[F.col(f"`{k}`").asc_nulls_first() for k in keys], *order]
    path = scratch(df.sparkSession, "ranged")
    df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn(AT, F.monotonically_increasing_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path).withColumn(PART, F.shiftright(AT, 33))


def parts(rows: DataFrame, keys: list[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """One row per key and part of ranged(): first__ (its least at__), before__ (rows of the key in parts before), total__ (of the key).

    sums: for each name, also the sum over the key's rows in parts before. As many rows as keys and parts together, at most.
    """
    sums = sums or {}
    cells = rows.groupBy(*[F.col(f"`{k}`") for k in keys], PART).agg(F.min(AT).alias("first__"), F.count(F.lit(1)).alias("rows__"), *[F.sum(c).alias(s) for s, c in sums.items()])
    of_key = Window.partitionBy(*[F.col(f"`{k}`") for k in keys])
    before = of_key.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before__", F.coalesce(F.sum("rows__").over(before), F.lit(0))).withColumn("total__", F.sum("rows__").over(of_key))
    for s in sums:
        cells = cells.withColumn(s, F.coalesce(F.sum(s).over(before), F.lit(0)))
    return cells.drop("rows__")


def with_parts(rows: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ranged() with the other columns of their parts() row; a join whose largest key is one part."""
    right = cells.select(*[F.col(f"`{k}`").alias(f"k{i}__") for i, k in enumerate(keys)], F.col(PART).alias("p__"), *[F.col(f"`{c}`") for c in cells.columns if c not in (*keys, PART)])
    same = F.col(PART) == F.col("p__")
    for i, k in enumerate(keys):
        same &= F.col(f"`{k}`").eqNullSafe(F.col(f"k{i}__"))
    return rows.join(right, same).drop("p__", *[f"k{i}__" for i in range(len(keys))])


def place() -> Column:
    """Number of the row from 0 among the rows of its key, after with_parts()."""
    return F.col(AT) - F.col("first__") + F.col("before__")


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str = "n", total: str | None = None) -> DataFrame:
    """Adds `out`: the row's number from 0 by `order` among the rows of its keys (nulls are a key); total: also the key's number of rows.

    Rows that agree in keys and order stand in any order, fixed by what is written.
    """
    rows = ranged(df, keys, order)
    rows = with_parts(rows, parts(rows, keys), keys).withColumn(out, place())
    rows = rows.withColumn(total, F.col("total__")) if total else rows
    return rows.drop(AT, PART, "first__", "before__", "total__")


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds for each name the sum over the rows of the key up to and with the row, in `order`. A window spans one part of one key."""
    rows = ranged(df, keys, order)
    cells = parts(rows, keys, {f"{s}__": c for s, c in sums.items()})
    inside = Window.partitionBy(*[F.col(f"`{k}`") for k in keys], PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    rows = with_parts(rows, cells, keys).select("*", *[F.sum(c).over(inside).alias(f"{s}_in__") for s, c in sums.items()])
    rows = rows.withColumns({s: F.col(f"{s}__") + F.col(f"{s}_in__") for s in sums})
    return rows.drop(AT, PART, "first__", "before__", "total__", *[f"{s}__" for s in sums], *[f"{s}_in__" for s in sums])
