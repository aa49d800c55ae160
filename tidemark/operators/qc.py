"""Quality gates, coercion, coverage and event classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def qc_gate(value: Column, flag: Column, allowed: tuple) -> Column:
    """The value where the flag is one of `allowed`, else null."""
    return F.when(flag.isin(*allowed), value)


def plausible(value: Column, lo: float, hi: float) -> Column:
    """The value within [lo, hi], else null."""
    return F.when(value.between(lo, hi), value)


def sentinel_null(c: Column, *marks: str) -> Column:
    """Text marks such as NA to null, the rest to double; what is no number is null."""
    return F.when(~c.isin(*marks), c).try_cast("double")


def counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """Values that are not null, per column, in one aggregate of one row."""
    return df.agg(*[F.count(c).alias(c) for c in cols]).first().asDict()


def drop_empty(df: DataFrame, cols: list[str]) -> DataFrame:
    """Without the columns that are null throughout."""
    n = counts(df, cols)
    return df.drop(*[c for c in cols if not n[c]])


def drop_constant(df: DataFrame, cols: list[str], least: float = 1e-6) -> DataFrame:
    """Without columns that are null throughout or whose standard deviation is under `least`."""
    s = df.agg(*[F.stddev_samp(c).alias(c) for c in cols]).first().asDict()
    return df.drop(*[c for c in cols if s[c] is None or s[c] < least])


def row_mean(cols: list[str]) -> Column:
    """Mean across columns, nulls skipped; null if all are."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in cols])
    n = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in cols])
    return F.when(n > 0, total / n)


# Field operations of the cut and the cultivation channel.
CUT = ("Mow", "Rowing up", "Forage harvest", "Trailers (silage)", "Top", "Baling (silage)", "Hay turning")
CULTIVATION = ("Plough", "Power harrow", "Drill Seed", "Broadcast Seed", "Grass seeding (overseeding)", "Cambridge/Ring roll", "Sub soiling / ripping", "Chain harrow", "Cultivate / Level")


def classify(rules: list[tuple[str, Column]], other: str | None = "other") -> Column:
    """The name of the first rule whose condition holds; a null condition does not."""
    out = F.lit(other).cast("string")
    for name, holds in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out


def event_channel(application: Column, operation: Column) -> Column:
    """Channel of a field event from two texts, or null: words of the application, then sets and a prefix of the operation.

    The order decides ("inorganic" holds "organic"); fertiliser applied without a kind counts as inorganic.
    """
    used, done = F.lower(application), F.trim(operation)
    return classify([("fertN", used.contains("inorganic fertiliser")), ("manure", used.contains("organic fertiliser")), ("lime", used.contains("liming")), ("cut", done.isin(*CUT)),
                     ("cultiv", done.isin(*CULTIVATION) | done.startswith("Drilling")), ("fertN", done == "Apply Fertiliser")], None)


def confusion(label: Column, predicted: Column) -> Column:
    """TP, FP, FN or TN of two boolean columns."""
    return F.when(label & predicted, "TP").when(predicted, "FP").when(label, "FN").otherwise("TN")


def keep_first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")


def swap_driver(df: DataFrame, site: DataFrame, on: list[str], col: str, factor: float) -> DataFrame:
    """col replaced by the site's value times factor, where the site has the row."""
    other = site.select(*on, (F.col(col) * factor).alias("__s"))
    return df.join(other, on, "left").withColumn(col, F.col("__s")).drop("__s")
