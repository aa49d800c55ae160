"""Gap-filling and flux composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, lloyd_taylor
from ..sources.scratch import kept
from .gaps import interpolate
from .grid import CHUNK, centred, last_known
from .order import numbered
from .select import quantiles

TREF, T0 = 10.0, -46.02


def mdc_fill(df: DataFrame, keys: list[str], col: str, name: str, windows: tuple[int, ...] = (7, 14, 28, 60), t: str = "t", chunk: int = CHUNK) -> DataFrame:
    """Interpolation over the first two steps of a gap, then the mean of the same hour over growing windows of days, the hour's mean, the mean.

    Each pass sees what the one before has filled. A window counts the key's days that have a value
    after interpolation; days without any go to the hour's mean.
    """
    df = interpolate(df, keys, col, "__x", 2, t).withColumn("__hr", F.pmod(F.col(t), F.lit(24))).withColumn("__day", F.floor(F.col(t) / 24))
    dense = df.where(F.col("__x").isNotNull()).select(*keys, "__day").distinct()
    df = kept(df.join(numbered(dense, keys, [F.col("__day")], "__n"), [*keys, "__day"], "left"), "diurnal")
    on, off = df.where("__n IS NOT NULL"), df.where("__n IS NULL")
    for w in windows:
        on = centred(on, [*keys, "__hr"], "__x", "__w", w, "__n", chunk).withColumn("__x", F.coalesce("__x", "__w")).drop("__w")
    df = kept(on.unionByName(off), "diurnal")
    hour = df.groupBy(*keys, "__hr").agg(F.avg("__x").alias("__h"))
    every = df.groupBy(*keys).agg(F.avg("__x").alias("__m"))
    df = df.join(hour, [*keys, "__hr"]).join(every, keys)
    return df.withColumn(name, F.coalesce("__x", "__h", "__m")).drop("__x", "__hr", "__day", "__n", "__h", "__m")


def ustar_threshold(df: DataFrame, keys: list[str], ta: str, ustar: str, fc: str, rg: str) -> DataFrame:
    """(keys, threshold): where the night flux levels off, by classes of temperature and bins of friction velocity.

    Of each class the 20 quantile bins between at least 6 distinct edges, both ends included; the plateau is the
    mean of the bins from half the greatest bin number on, empty bins being counted in the numbers.
    """
    night = df.where((F.col(rg) < 20) & (F.col(ustar) > 0) & F.col(fc).isNotNull() & F.col(ta).isNotNull()).select(*keys, F.col(ta).alias("ta"), F.col(ustar).alias("us"), F.col(fc).alias("fc"))
    count = df.select(*keys).distinct().join(night.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, "left")
    night = kept(night, "night")
    edges = quantiles(night, keys, "ta", [i / 6 for i in range(1, 6)], "te")
    bin_of = lambda x, e: F.aggregate(e, F.lit(0), lambda a, v: a + (x > v).cast("int"))
    rows = night.join(edges, keys).withColumn("cls", bin_of(F.col("ta"), F.col("te")))
    rows = kept(rows, "classes")
    sizes = rows.groupBy(*keys, "cls").agg(F.count(F.lit(1)).alias("m"))
    inner = quantiles(rows, [*keys, "cls"], "us", [i / 20 for i in range(21)], "ue").join(sizes, [*keys, "cls"])
    inner = inner.where((F.col("m") >= 50) & (F.size(F.array_distinct("ue")) >= 6))
    bins = rows.join(inner, [*keys, "cls"]).withColumn("bin", F.greatest(bin_of(F.col("us"), F.array_distinct("ue")) - 1, F.lit(0))).groupBy(*keys, "cls", "bin").agg(F.avg("us").alias("us"), F.avg("fc").alias("fc"))
    whole = Window.partitionBy(*keys, "cls")  # at most 20 bins
    bins = bins.withColumn("k", F.count(F.lit(1)).over(whole)).withColumn("top", F.max("bin").over(whole)).where("k >= 6")
    plateau = F.avg(F.when(F.col("bin") >= F.floor(F.col("top") / 2), F.col("fc"))).over(whole)
    bins = bins.withColumn("p", plateau).where("p > 0 AND fc >= 0.95 * p")
    per = bins.groupBy(*keys, "cls").agg(F.min_by("us", "bin").alias("us")).groupBy(*keys).agg(F.median("us").alias("us"))
    got = count.join(per, keys, "left")
    return got.select(*keys, F.when((F.coalesce(F.col("n"), F.lit(0)) >= 200) & F.col("us").isNotNull(), clip(F.col("us"), 0.01, 0.5)).otherwise(0.10).alias("threshold"))


def _g(temp: Column, e0: Column) -> Column:
    return lloyd_taylor(F.lit(1.0), e0, temp, TREF, T0)


E0_LOW, E0_HIGH = 30.0, 450.0


def _errors(night: DataFrame, keys: list[str], points: list[str]) -> DataFrame:
    """(keys, errors): the squared error at each E0 in turn, with the best Rref for it, which has a closed form.

    night: (keys, f, u), flux and exponent for an E0 of 1; points: E0 as SQL. Sums only, no row is copied.
    """
    sums = [F.expr(x) for i, e in enumerate(points) for x in (f"sum(f * exp(({e}) * u)) AS fg{i}", f"sum(exp(2 * ({e}) * u)) AS gg{i}")]
    found = night.groupBy(*keys).agg(F.expr("sum(f * f) AS ff"), *sums).selectExpr("*", *[f"greatest(0D, least(60D, fg{i} / gg{i})) AS r{i}" for i in range(len(points))])
    return found.selectExpr(*[f"`{k}`" for k in keys], "array(" + ", ".join(f"ff - 2 * r{i} * fg{i} + r{i} * r{i} * gg{i}" for i in range(len(points))) + ") AS errors")


def fit_e0(night: DataFrame, keys: list[str], fc: str, ta: str, refine: bool = False) -> DataFrame:
    """(keys, e0): the whole number between 30 and 450 with the least squared error, the lowest of equals.

    The error has one minimum: 21 points bracket it, 15 points the bracket of these, 7 the last one. refine: from there
    to the vertex of the parabola through the neighbours at a distance of 1, then of 0.1; an end of the range stays.
    """
    night = night.select(*keys, F.col(fc).cast("double").alias("f"), (F.lit(1 / (TREF - T0)) - 1 / (F.col(ta) - F.lit(T0))).alias("u"))
    low, best = str(E0_LOW), None
    for n, step in ((21, 21.0), (15, 3.0), (7, 1.0)):
        start = f"{low}D" if best is None else f"least(greatest(e0 - {(n - 1) / 2 * step}D, {low}D), {E0_HIGH - (n - 1) * step}D)"
        rows = night if best is None else night.join(best, keys)
        errors = _errors(rows, keys, [f"{start} + {i * step}D" for i in range(n)])
        found = errors if best is None else errors.join(best, keys)
        best = kept(found.select(*keys, F.expr(f"{start} + (array_position(errors, array_min(errors)) - 1) * {step}D AS e0")), "e0")  # a row a key
    for step in (1.0, 0.1) if refine else ():
        errors = _errors(night.join(best, keys), keys, [f"e0 + {d}D" for d in (-step, 0.0, step)]).join(best, keys)
        a, b, c = (F.get("errors", F.lit(i)) for i in range(3))
        bend = a - 2 * b + c
        vertex = F.col("e0") + F.when(bend > 0, F.greatest(F.lit(-step), F.least(F.lit(step), (a - c) / bend / 2 * step))).otherwise(0.0)
        inside = (F.col("e0") > E0_LOW) & (F.col("e0") < E0_HIGH)
        best = kept(errors.select(*keys, F.when(inside, F.greatest(F.lit(E0_LOW), F.least(F.lit(E0_HIGH), vertex))).otherwise(F.col("e0")).alias("e0")), "e0")
    return best


def partition_nee(df: DataFrame, keys: list[str], fc: str, ta: str, rg: str, t: str = "t", refine: bool = True) -> DataFrame:
    """Adds reco and gpp: E0 over all nights, base respiration by weeks of at least 8 night rows; null under 300 night rows.

    A week's base holds in all its hours. Across weeks without one it runs in a straight line from the last hour that has
    a base to the next one; before the first and after the last it stays. Without any, that of all nights counts.
    """
    night = df.where((F.col(rg) < 20) & F.col(fc).isNotNull() & (F.col(ta) > -43.15))
    enough = night.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n >= 300").select(*keys)
    night = night.join(kept(enough, "enough"), keys, "left_semi")
    first = kept(df.groupBy(*keys).agg(F.min(t).alias("__t0")), "first")  # a row a key
    e0 = fit_e0(night.select(*keys, fc, ta), keys, fc, ta, refine).join(first, keys)
    block = F.floor((F.col(t) - F.col("__t0")) / (7 * 24))
    g = _g(F.col(ta), F.col("e0"))
    week = night.join(e0, keys).groupBy(*keys, block.alias("blk")).agg(F.sum(F.col(fc) * g).alias("fg"), F.sum(g * g).alias("gg"), F.count(F.lit(1)).alias("n"))
    week = kept(week, "weeks")
    whole = week.groupBy(*keys).agg(clip(F.sum("fg") / F.sum("gg"), 0.0, 60.0).alias("__all"))
    fitted = kept(e0.join(whole, keys), "fitted")  # a row a key
    base = week.where("n >= 8").select(*keys, "blk", clip(F.col("fg") / F.col("gg"), 0.0, 60.0).alias("__r"))
    spans = kept(df.join(first, keys).groupBy(*keys, block.alias("blk")).agg(F.min(t).alias("lo"), F.max(t).alias("hi")).join(base, [*keys, "blk"], "left"), "spans")
    have = lambda at: F.when(F.col("__r").isNotNull(), F.struct(F.col(at).alias("t"), F.col("__r").alias("r")))
    spans = last_known(spans, keys, have("hi"), "__p", t="blk")
    spans = last_known(spans, keys, have("lo"), "__n", t="blk", forward=True).select(*keys, "blk", "__r", "__p", "__n")
    out = df.join(fitted, keys, "left").withColumn("blk", block).join(spans, [*keys, "blk"], "left")
    line = F.col("__p.r") + (F.col("__n.r") - F.col("__p.r")) * (F.col(t) - F.col("__p.t")) / (F.col("__n.t") - F.col("__p.t"))
    out = out.withColumn("reco", F.coalesce("__r", line, "__p.r", "__n.r", "__all") * _g(F.col(ta), F.col("e0")))
    day = F.when(F.col(fc).isNotNull() & F.col("reco").isNotNull(), F.greatest(F.col("reco") - F.col(fc), F.lit(0.0)))
    return out.withColumn("gpp", F.when(F.col("e0").isNotNull(), F.when(F.col(rg) < 20, 0.0).otherwise(day))).drop("__t0", "blk", "e0", "__all", "__r", "__p", "__n")
