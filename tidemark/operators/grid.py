"""Regular grids and windows on them.

Panels are long: key columns, an integer step `t` (hours or days since the epoch) and values; null is
missing. Series may be few and long, so windows are not partitioned by series alone: bounded frames run
on (series, chunk of t) with a halo of neighbouring rows, unbounded ones carry one summary row per chunk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .select import quantiles

CHUNK = 1 << 12  # steps of a series that one task windows over


def hours(ts: Column | str) -> Column:
    """Whole hours since the epoch of a timestamp without zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("HOUR", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")).cast("long")


def days(ts: Column) -> Column:
    """Whole days since the epoch."""
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")


def complete_grid(df: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Every step from the first to the last of the table, for each key."""
    span = df.agg(F.min(t).alias("lo"), F.max(t).alias("hi"))  # one row
    return df.select(*keys).distinct().join(F.broadcast(span)).select(*keys, F.explode(F.sequence("lo", "hi")).alias(t))


def resample_mean(df: DataFrame, keys: list[str], cols: list[str], t: str = "t") -> DataFrame:
    """Means per key and step, nulls skipped, steps without rows kept as null."""
    means = df.groupBy(*keys, t).agg(*[F.avg(c).alias(c) for c in cols])
    return complete_grid(df, keys, t).join(means, [*keys, t], "left")


def halo(df: DataFrame, keys: list[str], before: int, after: int = 0, t: str = "t", chunk: int = CHUNK) -> tuple[DataFrame, Window, Column]:
    """(rows, window, own): rows copied into the chunks that see them; own tells a chunk's own rows."""
    home = F.floor(F.col(t) / chunk)
    first, last = F.floor((F.col(t) - after) / chunk), F.floor((F.col(t) + before) / chunk)
    rows = df.withColumn("__c", F.explode(F.sequence(first, last)))
    return rows, Window.partitionBy(*keys, "__c").orderBy(t), F.col("__c") == home


def over_halo(df: DataFrame, keys: list[str], new: dict, before: int, after: int = 0, t: str = "t", chunk: int = CHUNK) -> DataFrame:
    """df with columns new[name](window); a frame must stay within the halo."""
    rows, w, own = halo(df, keys, before, after, t, chunk)
    return rows.select("*", *[f(w).alias(n) for n, f in new.items()]).where(own).drop("__c")


def lags(df: DataFrame, keys: list[str], col: str, ks: list[int], t: str = "t", chunk: int = CHUNK) -> DataFrame:
    """lag (k > 0) and lead (k < 0) columns `col_lagK` or `col_leadK`, on a complete grid."""
    new = {f"{col}_lag{k}" if k >= 0 else f"{col}_lead{-k}": (lambda w, k=k: F.lag(col, k).over(w)) for k in ks}
    return over_halo(df, keys, new, max(0, *ks), max(0, *[-k for k in ks]), t, chunk)


def rolling(df: DataFrame, keys: list[str], col: str, n: int, fns: dict, origin: bool, t: str = "t", chunk: int = CHUNK) -> DataFrame:
    """Trailing aggregates over n steps, the origin row included or not."""
    lo, hi = (-(n - 1), 0) if origin else (-n, -1)
    return over_halo(df, keys, {name: (lambda w, f=f: f(F.col(col)).over(w.rowsBetween(lo, hi))) for name, f in fns.items()}, n, 0, t, chunk)


def centred(df: DataFrame, keys: list[str], col: str, name: str, n: int, t: str = "t", chunk: int = CHUNK) -> DataFrame:
    """Mean of n rows before to n rows after, nulls skipped, where t counts the key's rows without gaps."""
    return over_halo(df, keys, {name: lambda w: F.avg(col).over(w.rowsBetween(-n, n))}, n, n, t, chunk)


def last_known(df: DataFrame, keys: list[str], value: Column, name: str, order: list[str] | None = None, t: str = "t", chunk: int = CHUNK, forward: bool = False) -> DataFrame:
    """Adds the last (forward: the next) value that is not null, up to and with the row itself.

    Within a chunk by a window; across chunks by one row per chunk with its last value.
    """
    sign = -1 if forward else 1
    by = [F.col(c) * sign if c == t else (F.col(c).desc() if forward else F.col(c)) for c in (order or [t])]
    rows = df.withColumn("__v", value).withColumn("__c", F.floor(F.col(t) / chunk) * sign)
    inner = Window.partitionBy(*keys, "__c").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__in", F.last("__v", True).over(inner))
    outer = Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*[b.alias(f"o{i}") if not forward or c == t else F.lit(0).alias(f"o{i}") for i, (b, c) in enumerate(zip(by, order or [t]))])
    chunks = rows.where(F.col("__v").isNotNull()).groupBy(*keys, "__c").agg(F.max_by("__v", place).alias("__l"))
    every = rows.select(*keys, "__c").distinct().join(chunks, [*keys, "__c"], "left").withColumn("__before", F.last("__l", True).over(outer)).drop("__l")
    return rows.join(every, [*keys, "__c"]).withColumn(name, F.coalesce("__in", "__before")).drop("__v", "__c", "__in", "__before")


def expand_daily(df: DataFrame, keys: list[str], cols: list[str], day: str = "d") -> DataFrame:
    """Hourly rows (keys, t) from daily ones: to the last midnight, so the last day has one; a day without row is null."""
    span = df.groupBy(*keys).agg((F.min(day) * 24).alias("lo"), (F.max(day) * 24).alias("hi"))
    grid = span.select(*keys, F.explode(F.sequence("lo", "hi")).alias("t")).withColumn(day, F.floor(F.col("t") / 24))
    return grid.join(df.select(*keys, day, *cols), [*keys, day], "left").drop(day)


def ffill_limit(df: DataFrame, keys: list[str], col: str, limit: int, t: str = "t") -> DataFrame:
    """col filled forward over at most `limit` steps, as col_ffill."""
    return over_halo(df, keys, {f"{col}_ffill": lambda w: F.last(col, True).over(w.rowsBetween(-limit, 0))}, limit, 0, t)


def align(df: DataFrame, keys: list[str], ar: list[str], fx: list[str], target: str, horizons: list[int], t: str = "t") -> DataFrame:
    """One row per origin and horizon: `ar` columns at the origin, `fx` and the target at t + h. Only fx and the target are led."""
    origins = df.select(*keys, t, *ar).withColumn("h", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("tt", F.col(t) + F.col("h"))
    future = df.select(*keys, F.col(t).alias("tt"), *[F.col(c).alias(f"fx_{c}") for c in fx], F.col(target).alias("target"))
    return origins.join(future, [*keys, "tt"])


def lookback_arrays(df: DataFrame, keys: list[str], col: str, length: int, horizon: int, stride: int = 1, t: str = "t") -> DataFrame:
    """Arrays `past` (length values up to the origin) and `future` (horizon values after it); full windows without nulls only, every stride-th t."""
    new = {"past": lambda w: F.collect_list(col).over(w.rowsBetween(-(length - 1), 0)), "future": lambda w: F.collect_list(col).over(w.rowsBetween(1, horizon))}
    out = over_halo(df, keys, new, length, horizon, t)
    return out.where((F.size("past") == length) & (F.size("future") == horizon) & (F.pmod(F.col(t), F.lit(stride)) == 0))


def quantile_bins(df: DataFrame, keys: list[str], col: str, n: int, name: str) -> DataFrame:
    """df with the number of the inner n-quantile edges of its key that lie below col, 0 to n - 1; null for null.

    An edge that falls on a value differs from it by the rounding of its interpolation; up to a billionth it counts as equal.
    """
    edges = quantiles(df, keys, col, [i / n for i in range(1, n)], "__e")
    edges = edges.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__e")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    out = df.join(edges, on, "left").drop(*[f"__k{i}" for i in range(len(keys))])
    return out.withColumn(name, F.when(F.col(col).isNotNull(), F.size(F.filter("__e", lambda x: F.col(col) - x > 1e-9 * F.abs(x))).cast("long"))).drop("__e")
