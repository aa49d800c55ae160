"""As-of and similarity joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .grid import last_known


def asof(probes: DataFrame, events: DataFrame, by: list[str], value: str, t: str = "t") -> DataFrame:
    """probes with `event_t` and `event_value` of the latest event with t <= the probe's.

    Of events at one time the largest value counts. Probes and events are united and the last event is
    carried along time, so neither side is broadcast or multiplied.
    """
    tied = events.groupBy(*by, t).agg(F.max(value).alias(value))
    side = tied.select(*by, t, F.lit(0).alias("__k"), F.struct(F.col(t).alias("t"), F.col(value).alias("v")).alias("__e"))
    both = probes.withColumn("__k", F.lit(1)).unionByName(side, allowMissingColumns=True)
    found = last_known(both, by, F.col("__e"), "__l", order=[t, "__k"], t=t)
    return found.where("__k = 1").withColumn("event_t", F.col("__l.t")).withColumn("event_value", F.col("__l.v")).drop("__k", "__e", "__l")


def recency(steps: Column, tau: float) -> Column:
    """exp(-steps / tau), 0 before the first event."""
    return F.coalesce(F.exp(-steps / F.lit(float(tau))), F.lit(0.0))


def mds(panel: DataFrame, keys: list[str], target: str, ta: str, sw: str, windows: tuple[int, ...] = (7, 14, 28, 91), t: str = "t") -> DataFrame:
    """(keys, t, filled): marginal distribution sampling for steps (hours) without target.

    A candidate has a target, lies within the window's days, within an hour of the clock (23 and 0 are
    no neighbours), TA within 2.5 and, by day (SW > 10), SW within 50; a null TA or SW on either side passes.
    The smallest window with a candidate gives the mean; else the same hours within 7 days of the year,
    whatever the drivers. Candidates are found by equi-joins on (key, hour, block of days), window by window: at one row a key
    and hour, a gap meets 72 rows for the narrowest window, and those that find none meet more for the next.
    """
    rows = panel.withColumn("__hr", F.pmod(F.col(t), F.lit(24))).withColumn("__day", F.floor(F.col(t) / 24))
    gaps = rows.where(F.col(target).isNull()).select(*keys, F.col(t).alias("gt"), F.col("__hr").alias("ghr"), F.col("__day").alias("gday"), F.col(ta).alias("gta"), F.col(sw).alias("gsw"))
    have = rows.where(F.col(target).isNotNull()).select(*keys, F.col(t).alias("ct"), F.col("__hr").alias("chr"), F.col("__day").alias("cday"), F.col(ta).alias("cta"), F.col(sw).alias("csw"), F.col(target).alias("y"))
    clock = F.filter(F.array(F.col("ghr") - 1, F.col("ghr"), F.col("ghr") + 1), lambda h: (h >= 0) & (h <= 23))
    left = kept(gaps.withColumn("chr", F.explode(clock)), "gaps")
    have = kept(have, "candidates")
    similar = (F.coalesce(F.abs(F.col("gta") - F.col("cta")) <= 2.5, F.lit(True))
               & ((F.coalesce(F.col("gsw"), F.lit(0.0)) <= 10) | F.col("csw").isNull() | (F.abs(F.col("gsw") - F.col("csw")) <= 50)))
    first = None
    for days in windows:  # from the narrowest: most gaps find a candidate there and are not joined again
        block = lambda c, n=days + 1: F.floor(F.col(c) / n)
        near = left.withColumn("b", F.explode(F.sequence(block("gday") - 1, block("gday") + 1)))
        met = near.join(have.withColumn("b", block("cday")), [*keys, "chr", "b"]).where(similar & (F.abs(F.col("gt") - F.col("ct")) <= days * 24))
        found = kept(met.groupBy(*keys, "gt").agg(F.avg("y").alias("filled")), "filled")
        first = found if first is None else first.unionByName(found)
        left = kept(left.join(found, [*keys, "gt"], "left_anti"), "gaps")
        if left.isEmpty():
            return first.withColumnRenamed("gt", t)
    doy = lambda c: F.dayofyear(F.date_add(F.lit("1970-01-01").cast("date"), c.cast("int")))
    left = left.withColumn("gdoy", doy(F.col("gday")))
    # days of the year in blocks of 8, which wrap and of which the last has 5: a gap looks into the blocks of all days within 7
    spread = F.array_distinct(F.transform(F.sequence(F.lit(-7), F.lit(7)), lambda x: F.floor(F.pmod(F.col("gdoy") + x, F.lit(365)) / 8)))
    left = left.withColumn("b", F.explode(spread))
    apart = F.least(F.abs(F.col("gdoy") - F.col("cdoy")), 365 - F.abs(F.col("gdoy") - F.col("cdoy")))
    late = have.withColumn("cdoy", doy(F.col("cday"))).withColumn("b", F.floor(F.pmod(F.col("cdoy"), F.lit(365)) / 8))
    again = left.join(late, [*keys, "chr", "b"]).where(apart <= 7).groupBy(*keys, "gt").agg(F.avg("y").alias("filled"))
    return first.unionByName(again).withColumnRenamed("gt", t)
