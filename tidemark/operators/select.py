"""Exact quantiles of groups of any size, by selection instead of gathering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept

GATHER = 1 << 16  # values of a group, or of one interval of it, that a task may hold at once
BINS = 1024
SMALL = 8 << 20  # bytes of intervals that are broadcast


def _sent(intervals: DataFrame, by: list[str]) -> DataFrame:
    """One row a group; broadcast if their size is known to be small."""
    rows, most = intervals.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("iv__")), F.lit(0))).first()
    return F.broadcast(intervals) if rows * (most * 48 + 100) <= SMALL else intervals


def _meets(rows: DataFrame, intervals: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the one interval of their group that holds them, as iv__."""
    wide = kept(intervals.groupBy(*by).agg(F.collect_list(F.struct("lo", "hi", "below", "total")).alias("iv__")), "intervals")
    side = _sent(wide, by)
    met = rows.join(side, by) if by else rows.join(F.broadcast(wide))
    return met.withColumn("iv__", F.get(F.filter("iv__", lambda x: F.col("v__").between(x["lo"], x["hi"])), F.lit(0))).where("iv__ IS NOT NULL")


def quantiles(df: DataFrame, by: list[str], value: Column | str, qs: list[float], name: str = "q", gather: int = GATHER) -> DataFrame:
    """(by, name): the quantiles of each group as an array, linear between order statistics; nulls are skipped, a group of nulls gives no row.

    Counts in bins between the least and the largest value tell which bins hold the wanted ranks; only these are
    counted again, until an interval holds one value or `gather` rows at most, which are sorted. Groups under `gather` rows
    are gathered at once. Passes: a few for any smooth distribution; each splits every interval it looks into.
    """
    value = F.col(value) if isinstance(value, str) else value
    rows = kept(df.select(*by, value.cast("double").alias("v__")).where("v__ IS NOT NULL"), "values")
    ends = kept(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v__").alias("lo"), F.max("v__").alias("hi")).where("n > 0"), "ends")
    if (ends.agg(F.max("n")).first()[0] or 0) <= gather:
        return rows.groupBy(*by).agg(F.percentile("v__", F.array(*[F.lit(q) for q in qs])).alias(name)).where(f"`{name}` IS NOT NULL")
    at = F.array(*[F.lit(float(q)) for q in qs])
    # ranks below and above each quantile; a product that should be whole may miss it by its last bit
    ranks = lambda total: F.array_distinct(F.flatten(F.transform(at, lambda q: F.array(F.floor(q * (total - 1)), F.least(F.floor(q * (total - 1)) + 1, total - 1)))))
    wanted = lambda below, n, total: F.exists(ranks(total), lambda r: (r >= below) & (r < below + n))
    state = ends.select(*by, "lo", "hi", F.lit(0).cast("long").alias("below"), "n", F.col("n").alias("total"))
    wide = (F.col("n") > gather) & (F.col("lo") < F.col("hi"))
    while not state.where(wide).isEmpty():
        met = _meets(rows, state.where(wide), by)
        place = F.least(F.floor((F.col("v__") - F.col("iv__.lo")) / (F.col("iv__.hi") - F.col("iv__.lo")) * BINS), F.lit(BINS - 1)).cast("int")
        bins = met.groupBy(*by, F.col("iv__.lo").alias("of"), place.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("v__").alias("lo"), F.max("v__").alias("hi"), F.first("iv__.below").alias("below"), F.first("iv__.total").alias("total"))
        upto = Window.partitionBy(*by, "of").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows
        bins = bins.withColumn("below", F.col("below") + F.coalesce(F.sum("n").over(upto), F.lit(0))).where(wanted(F.col("below"), F.col("n"), F.col("total")))
        state = kept(state.where(~wide).unionByName(bins.select(*state.columns)), "intervals")
    single = state.where("lo = hi").select(*by, "total", F.explode(F.filter(ranks(F.col("total")), lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("n")))).alias("r"), F.col("lo").alias("v"))
    lists = _meets(rows, state.where("lo < hi"), by).groupBy(*by, F.col("iv__.below").alias("below"), F.col("iv__.total").alias("total")).agg(F.sort_array(F.collect_list("v__")).alias("vs"))
    inside = F.filter(ranks(F.col("total")), lambda r: (r >= F.col("below")) & (r < F.col("below") + F.size("vs")))
    many = lists.select(*by, "total", "below", "vs", F.explode(inside).alias("r")).select(*by, "total", "r", F.get("vs", (F.col("r") - F.col("below")).cast("int")).alias("v"))
    found = single.unionByName(many).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("m__"), F.first("total").alias("n__"))

    def between(q: Column) -> Column:
        pos = q * (F.col("n__") - 1)
        low, high = F.try_element_at("m__", F.floor(pos)), F.try_element_at("m__", F.least(F.floor(pos) + 1, F.col("n__") - 1))
        return low + (high - low) * (pos - F.floor(pos))
    return found.select(*by, F.transform(at, between).alias(name))


def medians(df: DataFrame, by: list[str], value: Column | str, name: str = "med") -> DataFrame:
    """(by, name): the exact median of each group."""
    return quantiles(df, by, value, [0.5], name).select(*by, F.get(name, F.lit(0)).alias(name))
