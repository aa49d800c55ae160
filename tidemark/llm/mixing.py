"""Mixing sources to target weights by systematic sampling, in DataFrame functions alone.

Each document of a source expects e = target / source size copies. Documents of a source stand in
order of (size, id); the prefix sum of expected copies plus one random offset of the source is cut
at the integers, and a document is emitted once for each integer boundary that it crosses. Order by
size stratifies the sample, so that the words taken come near the target.

Places come from a range partition by (source, size, id): what lies in the parts before is one number for each source
and part, so no source, size, or run of ids, hashed or not, is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import parts, place, ranged, with_parts
from .common import materialise, n_words

WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds `target` to one row (source, source_size) per source.

    Sources in code-point order, null last, weigh `weights` in turn and share `share` times all sizes;
    none gets more than `cap` times its size, what is over being shared again by weight until none is
    above. That is water filling: by rising cap per weight, the first k sources are capped, k the
    smallest number for which the next one stays below its cap. One row per source: a small table.
    """
    order = Window.orderBy(F.col(source_col).isNull(), F.col(source_col).cast("binary"))
    every = Window.partitionBy()
    ranked = sizes.withColumn("rank__", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank__") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w__", w).withColumn("cap__", F.col("source_size") * F.lit(float(cap)))
    ranked = ranked.withColumn("ratio__", F.col("cap__") / F.col("w__"))
    rising = Window.orderBy("ratio__", "rank__").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap__").over(rising), F.lit(0.0))) / (
        F.sum("w__").over(every) - F.coalesce(F.sum("w__").over(rising), F.lit(0.0)))
    ranked = ranked.withColumn("level__", level)
    # the first source, by rising cap per weight, that stays below its cap gives the level of all the rest
    fill = F.min(F.when(F.col("level__") <= F.col("ratio__"), F.struct("ratio__", "rank__", "level__"))).over(every)["level__"]
    return ranked.withColumn("target", F.least(F.col("cap__"), F.coalesce(fill, F.lit(float("inf"))) * F.col("w__"))).drop("rank__", "w__", "cap__", "ratio__", "level__")


def offset(source: Column, seed: str) -> Column:
    """The source's random offset in [0, 1), the same on every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit("\u0000")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", with_key: bool = False, **rule) -> DataFrame:
    """One row (id, source, size, source_size, target, copies, taken) per row of docs; with_key: also text_key() as `key`.

    A null text has size 0. Null is a source of its own, the last. A source without words takes
    none. Repeated rows each take their own place; rows of one source, size and id stand by the hash of their text. An empty
    table gives no rows. Other columns are not read. Ids of any type that can be ordered will do; they need not be unique.
    """
    sized = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size"), text_key(f"`{text_col}`").alias("key"))
    rows = ranged(sized, ["source"], [F.col("size"), F.col("id").asc_nulls_first(), F.col("key")])
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source", **rule).withColumnRenamed("source", "of__")
    cells = parts(rows, ["source"]).join(aims, F.col("source").eqNullSafe(F.col("of__"))).drop("of__")
    rows = with_parts(rows, materialise(cells), ["source"]).withColumn("place", place() + 1)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    cut = lambda n: F.floor(offset(F.col("source"), seed) + expected * n)
    return rows.withColumn("copies", (cut(F.col("place")) - cut(F.col("place") - 1)).cast("long")).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *["key"] * with_key)


def text_key(text_col: str) -> Column:
    """Hash of a text, null included."""
    return F.xxhash64(F.col(text_col).isNull(), F.col(text_col))


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **rule) -> DataFrame:
    """docs, all columns, each row as often as the mix takes it.

    Rows are found again by id, text hash and source, nulls included. Rows that agree in all three share their
    numbers of copies one each.
    """
    names = {id_col: "__id", source_col: "__source", "key": "__key"}
    groups = mix(docs, id_col, text_col, source_col, with_key=True, **rule).groupBy(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    groups = materialise(groups.agg(F.sort_array(F.collect_list("copies"), asc=False).alias("__c")))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & F.col(f"`{source_col}`").eqNullSafe(F.col("__source")) & (text_key(f"`{text_col}`") == F.col("__key"))
    once, often = groups.where("size(__c) = 1"), groups.where("size(__c) > 1")
    joined = docs.join(once, same).withColumn("__t", F.get("__c", F.lit(0)))
    if not often.isEmpty():
        turn = F.row_number().over(Window.partitionBy(*names.values()).orderBy(F.lit(1))) - 1
        joined = joined.unionByName(docs.join(often, same).withColumn("__t", turn).withColumn("__t", F.get("__c", F.col("__t"))))
    return joined.where("__t > 0").withColumn("__t", F.explode(F.sequence(F.lit(1), F.col("__t").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rank FROM s),
c AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST(rank % 3 + 1 AS INT)] AS w, source_size * 2.0::DOUBLE AS cap FROM r),
l AS (SELECT *, cap / w AS ratio,
  (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM c),
f AS (SELECT level AS fill FROM l WHERE level <= ratio ORDER BY ratio, rank LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT fill FROM f), 'inf'::DOUBLE) * w) AS target FROM l),
p AS (SELECT doc_id, size, source_size, target,
  CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS e,
  CAST('0x' || substr(md5('mix' || coalesce(d.source, chr(0))), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS o,
  row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(floor(o + e * place) - floor(o + e * (place - 1)) AS BIGINT) AS copies,
  CAST(floor(o + e * place) - floor(o + e * (place - 1)) AS BIGINT) * size AS taken
FROM p
"""
