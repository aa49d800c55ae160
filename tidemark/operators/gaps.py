"""Gaps: runs, bounded filling, interpolation, spells and artificial gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .grid import CHUNK, last_known, over_halo
from .order import running


def islands(df: DataFrame, keys: list[str], flag: Column, t: str = "t") -> DataFrame:
    """(keys, start, stop, steps) of each run of consecutive steps with the flag.

    A run starts where the step before lacks the flag; its stop is the next end mark, carried over chunks.
    """
    on = over_halo(df.where(flag).select(*keys, t), keys, {"__b": lambda w: F.lag(t).over(w), "__a": lambda w: F.lead(t).over(w)}, 1, 1, t)
    end = F.when(F.coalesce(F.col("__a") != F.col(t) + 1, F.lit(True)), F.col(t))
    on = last_known(on, keys, end, "stop", t=t, forward=True)
    starts = on.where(F.coalesce(F.col("__b") != F.col(t) - 1, F.lit(True)))
    return starts.select(*keys, F.col(t).alias("start"), "stop", (F.col("stop") - F.col(t) + 1).alias("steps"))


def gap_runs(df: DataFrame, keys: list[str], col: str, t: str = "t") -> DataFrame:
    """Runs of nulls on a complete grid."""
    return islands(df, keys, F.col(col).isNull(), t)


def fill_both(df: DataFrame, keys: list[str], col: str, name: str, t: str = "t") -> DataFrame:
    """Forward, then backward, without limit."""
    df = last_known(df, keys, F.col(col), "__f", t=t)
    df = last_known(df, keys, F.col(col), "__b", t=t, forward=True)
    return df.withColumn(name, F.coalesce("__f", "__b")).drop("__f", "__b")


def interpolate(df: DataFrame, keys: list[str], col: str, name: str, limit: int | None = None, t: str = "t") -> DataFrame:
    """Straight line between neighbours, interior gaps only; with a limit only the first `limit` steps of every gap."""
    here = F.when(F.col(col).isNotNull(), F.struct(F.col(t).alias("t"), F.col(col).alias("v")))
    df = last_known(df, keys, here, "__p", t=t)
    df = last_known(df, keys, here, "__n", t=t, forward=True)
    line = F.col("__p.v") + (F.col("__n.v") - F.col("__p.v")) * (F.col(t) - F.col("__p.t")) / (F.col("__n.t") - F.col("__p.t"))
    near = F.lit(True) if limit is None else F.col(t) - F.col("__p.t") <= limit
    return df.withColumn(name, F.coalesce(F.col(col), F.when(near, line))).drop("__p", "__n")


def spell_counter(df: DataFrame, keys: list[str], flag: Column, name: str, t: str = "t") -> DataFrame:
    """Steps since the start of the current run of the flag; 0 outside."""
    df = last_known(df, keys, F.when(~flag, F.col(t)), "__off", t=t)
    df = last_known(df, keys, F.when(flag, F.col(t)), "__on", t=t)
    first = df.groupBy(*keys).agg(F.min(t).alias("__first"))
    df = df.join(first, keys)
    return df.withColumn(name, F.when(flag, F.col(t) - F.coalesce(F.col("__off") + 1, F.col("__first"))).otherwise(0)).drop("__off", "__on", "__first")


def steps_since(df: DataFrame, keys: list[str], flag: Column, name: str, none: int = 9999, t: str = "t") -> DataFrame:
    """Steps since the last row with the flag, the row itself included; `none` before the first."""
    df = last_known(df, keys, F.when(flag, F.col(t)), "__on", t=t)
    return df.withColumn(name, F.coalesce(F.col(t) - F.col("__on"), F.lit(none))).drop("__on")


def event_recency(df: DataFrame, keys: list[str], col: str, threshold: float, windows: tuple[int, ...], t: str = "t") -> DataFrame:
    """since, and per window n the count of spikes and the maximum over n steps, the origin included."""
    spike = F.coalesce(F.col(col) > threshold, F.lit(False))
    df = steps_since(df.withColumn("__s", spike.cast("int")), keys, F.col("__s") == 1, "since", t=t)
    new = {}
    for n in windows:
        new[f"spikes{n}"] = lambda w, n=n: F.sum("__s").over(w.rowsBetween(-(n - 1), 0))
        new[f"max{n}"] = lambda w, n=n: F.max(col).over(w.rowsBetween(-(n - 1), 0))
    return over_halo(df, keys, new, max(windows), 0, t).drop("__s")


def _hash(at: Column, rep: Column, part: int) -> Column:
    """32 seeded bits of a step and a repetition, the same for all keys, so that methods are compared on the same gaps."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", at.cast("string"), rep.cast("string"))), 1 + 8 * part, 8), 16, 10).cast("long")


def _highest(df: DataFrame, keys: list[str], t: str, value: Column, own: bool) -> DataFrame:
    """df with `__hi`: the greatest value so far in the key, the row itself included if `own`; one summary row per chunk is carried."""
    rows = df.withColumn("__x", value).withColumn("__ch", F.floor(F.col(t) / CHUNK))
    inside = Window.partitionBy(*keys, "__ch").orderBy(t, "__p").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    before = Window.partitionBy(*keys).orderBy("__ch").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*keys, "__ch").agg(F.max("__x").alias("__m")).withColumn("__m", F.max("__m").over(before))
    rows = rows.withColumn("__in", F.max("__x").over(inside)).join(carried, [*keys, "__ch"])
    return rows.withColumn("__hi", F.greatest("__in", "__m")).drop("__x", "__ch", "__in", "__m")


def _placed(starts: DataFrame, keys: list[str]) -> DataFrame:
    """Of candidate blocks (keys, __s, __g, __p) those that are placed when they come in the order of __p and none may overlap.

    Blocks that touch others in a chain are one cluster; only clusters, which are short at the density that is thrown, are
    worked through in order.
    """
    rows = _highest(starts, keys, "__s", F.col("__s") + F.col("__g"), own=False)
    rows = rows.withColumn("__new", F.when(F.coalesce(F.col("__s") >= F.col("__hi"), F.lit(True)), F.col("__s"))).drop("__hi")
    rows = _highest(rows, keys, "__s", F.col("__new"), own=True)
    clusters = rows.groupBy(*keys, F.col("__hi").alias("__cl")).agg(F.sort_array(F.collect_list(F.struct("__p", "__s", "__g"))).alias("__b"))
    overlap = lambda a, b: (a["__s"] < b["__s"] + b["__g"]) & (b["__s"] < a["__s"] + a["__g"])
    chosen = F.aggregate("__b", F.slice("__b", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: overlap(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return clusters.select(*keys, F.explode(chosen).alias("__c")).select(*keys, "__c.*")


def thrown_gaps(df: DataFrame, keys: list[str], col: str, lengths: DataFrame, rep: int | Column, share: float = 0.25, t: str = "t") -> DataFrame:
    """(keys, t): valid rows masked by blocks thrown at random starts, until `share` of the key's valid rows is covered.

    Every step of the key's calendar, with or without a value, is a start; starts come in a hashed order, each with a length
    drawn from `lengths` (keys, steps, n: how often), cut at the calendar's end; a block that overlaps one before is left out.
    The last block may pass the share. Reruns agree.

    Starts are thrown in batches of rising hash, about as many as the share needs and then twice as many, so a batch is
    sparse. A key without lengths or valid rows gets no mask. The distinct lengths of a key, of which a series of T
    steps has at most sqrt(2 T), are held in one array.
    """
    rep = rep if isinstance(rep, Column) else F.lit(rep)
    upto = Window.partitionBy(*keys).orderBy("steps")
    table = lengths.withColumn("__to", F.sum("n").over(upto)).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("__to", "steps"))).alias("__l"), F.max("__to").alias("__all"), (F.sum(F.col("n") * F.col("steps")) / F.sum("n")).alias("__mean"))
    span = df.groupBy(*keys).agg(F.min(t).alias("__lo"), F.max(t).alias("__end"), F.count(col).alias("__valid"), F.first(rep).alias("__rep"))
    span = kept(span.where("__valid > 0").join(table, keys).withColumn("__aim", F.greatest(F.lit(1), F.floor(F.col("__valid") * share))), "spans")
    valid = df.where(F.col(col).isNotNull()).select(*keys, t)
    hours = lambda blocks: blocks.select("*", F.explode(F.sequence(F.col("__s"), F.col("__s") + F.col("__g") - 1)).alias(t))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    open_, blocks, low, high = span, None, 0.0, 4 * share
    while not open_.isEmpty():
        chunks = open_.withColumn("__ch", F.explode(F.sequence(F.floor(F.col("__lo") / CHUNK), F.floor(F.col("__end") / CHUNK))))
        chunks = chunks.repartition(parts, *keys, "__ch")  # a few rows, each of thousands of starts
        starts = chunks.withColumn("__s", F.explode(F.sequence(F.greatest("__lo", F.col("__ch") * CHUNK), F.least("__end", (F.col("__ch") + 1) * CHUNK - 1))))
        starts = starts.withColumn("__p", _hash(F.col("__s"), F.col("__rep"), 0))
        starts = starts.where((F.col("__p") >= F.lit(low * 4294967296.0) / F.col("__mean")) & (F.col("__p") < F.lit(high * 4294967296.0) / F.col("__mean")))
        drawn = F.filter("__l", lambda x: x["__to"] > F.pmod(_hash(F.col("__s"), F.col("__rep"), 1), F.col("__all")))[0]["steps"]
        starts = starts.select(*keys, "__s", F.least(drawn, F.col("__end") + 1 - F.col("__s")).alias("__g"), "__p")
        if blocks is not None:
            # free of the blocks that stand: the last one before ends by then, and the next one starts behind
            both = starts.withColumn("__old", F.lit(False)).unionByName(blocks.join(open_.select(*keys), keys, "left_semi").select(*keys, "__s", "__g", "__p").withColumn("__old", F.lit(True)))
            both = _highest(both, keys, "__s", F.when(F.col("__old"), F.col("__s") + F.col("__g")), own=True).withColumnRenamed("__hi", "__past")
            both = _highest(both.withColumn("__back", -F.col("__s")), keys, "__back", F.when(F.col("__old"), -F.col("__s")), own=True)
            starts = both.where(~F.col("__old") & F.coalesce(F.col("__past") <= F.col("__s"), F.lit(True)) & F.coalesce(-F.col("__hi") >= F.col("__s") + F.col("__g"), F.lit(True))).select(*keys, "__s", "__g", "__p")
        new = kept(_placed(kept(starts, "starts"), keys), "blocks")
        found = hours(new).join(valid, [*keys, t]).groupBy(*keys, "__s").agg(F.count(F.lit(1)).alias("__v"))
        new = kept(new.join(found, [*keys, "__s"], "left").withColumn("__v", F.coalesce("__v", F.lit(0))), "blocks")
        blocks = new if blocks is None else blocks.unionByName(new)
        sums = blocks.groupBy(*keys).agg(F.sum("__v").alias("__got"))
        open_ = kept(span.join(sums, keys, "left").where((F.coalesce("__got", F.lit(0)) < F.col("__aim")) & (F.col("__mean") > high)).drop("__got"), "open")
        low, high = high, high * 3
    if blocks is None:
        return valid.limit(0)
    counted = running(blocks, keys, [F.col("__p"), F.col("__s")], {"__sum": F.col("__v")}).join(span.select(*keys, "__aim"), keys)
    return hours(counted.where(F.col("__sum") - F.col("__v") < F.col("__aim"))).join(valid, [*keys, t]).select(*keys, t)


def calendar_gaps(df: DataFrame, keys: list[str], col: str, length: int | Column, rep: int | Column, share: float = 0.25, t: str = "t") -> DataFrame:
    """thrown_gaps() of one length; length and repetition may be columns that the keys determine, so that one job masks many scenarios."""
    length = length if isinstance(length, Column) else F.lit(length)
    return thrown_gaps(df, keys, col, df.select(*keys, length.cast("long").alias("steps"), F.lit(1).alias("n")).distinct(), rep, share, t)


def mixed_gaps(df: DataFrame, keys: list[str], col: str, rep: int | Column, lengths: tuple[int, ...] = (1, 4, 32, 288), share: float = 0.25, t: str = "t") -> DataFrame:
    """thrown_gaps() of lengths that are equally likely."""
    each = df.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(x).cast("long") for x in lengths])).alias("steps"), F.lit(1).alias("n"))
    return thrown_gaps(df, keys, col, each, rep, share, t)


def empirical_gaps(df: DataFrame, keys: list[str], col: str, rep: int, share: float = 0.4, t: str = "t") -> DataFrame:
    """thrown_gaps() of the lengths of the gaps that the column itself has."""
    runs = gap_runs(df, keys, col, t).groupBy(*keys, "steps").agg(F.count(F.lit(1)).alias("n"))
    return thrown_gaps(df, keys, col, runs, rep, share, t)
