"""Sharding by vector bin packing.

Groups of equal texts are packed into shards so that bytes, tokens and rows come out level
together: the largest item first, each into the shard where the dot product of its vector with
the residual capacity is highest.

What is packed on the driver is bounded by parameters, not by the data: a group with more than
1/`fine` of a shard's bytes is an item of its own (at most n_shards * fine of them), all smaller
groups are summed into `cells` items by a hash of their text, whole. A group over `whole` shards, 1 by default,
fits in none; it is split by a hash of the row's id into pieces of a quarter of a shard, so that one text with a
third of all rows does not unbalance the shards. All other groups stay together. Placement and slots are joins and windows over (shard, rank cell).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, n_words, text_or_empty

DIMS = ("bytes", "tokens", "rows")


def place(vectors: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each item (rows of bytes, tokens, rows): the greedy dot-product rule.

    The largest item first, into that shard with room for it in all three, whose residual capacity has the largest dot
    product with the item; without such a shard into the one whose fullest dimension stays least full.
    """
    capacity = np.maximum(vectors.sum(axis=0) / n_shards, 1e-9)
    v = vectors / capacity
    residual = np.ones((n_shards, vectors.shape[1]))
    out = np.zeros(len(v), int)
    for i in np.lexsort((np.arange(len(v)), -v.max(axis=1))):
        score = residual @ v[i]
        left = residual - v[i]
        fits = (left >= -1e-12).all(axis=1)
        out[i] = np.argmax(np.where(fits, score, -np.inf)) if fits.any() else np.argmax(left.min(axis=1))
        residual[out[i]] -= v[i]
    return out


def pack(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", cells: int = 8192, fine: int = 1024, whole: float = 1.0, slot_rows: int = 10_000, with_key: bool = False) -> DataFrame:
    """One row (id, size, tokens, text_crc32, shard, slot) per row of docs.

    size is the text's UTF-8 bytes plus 1. A null text counts as empty. Slots are gapless from 0 in
    each shard. Repeated rows each get a slot of their own. An empty table gives no rows. Other
    columns of docs are not read.
    """
    text = text_or_empty(text_col)
    sized = materialise(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), n_words(F.col(text_col)).alias("tokens"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key")))
    total, rows = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    share = max(1.0, total / n_shards)
    big = (sized.groupBy("key").agg(F.sum("size").alias("b")).where(F.col("b") > share / fine)
           .select("key", F.when(F.col("b") > F.lit(share * whole), F.ceil(F.col("b") / F.lit(share / 4))).otherwise(1).cast("int").alias("pieces")))
    item = F.when(F.col("pieces").isNull(), F.concat(F.lit("c"), F.pmod("key", F.lit(cells)))).otherwise(
        F.concat(F.lit("g"), F.col("key"), F.lit("."), F.pmod(F.xxhash64("id", F.lit("piece")), "pieces")))
    # at most n_shards * fine large groups, so this side is bounded
    placed = sized.join(F.broadcast(big), "key", "left").withColumn("item", item)
    items = (placed.groupBy("item").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
             .orderBy("item").collect())  # at most cells + n_shards * (fine + 8) rows
    shards = place(np.array([[float(r[d]) for d in DIMS] for r in items]).reshape(-1, 3), n_shards)
    where = sized.sparkSession.createDataFrame([(r["item"], int(s)) for r, s in zip(items, shards)], "item string, shard int")
    parts = max(1, math.ceil(rows / n_shards / slot_rows))
    placed = placed.join(F.broadcast(where), "item").withColumn("cell", F.pmod(F.xxhash64("id", "key"), F.lit(parts)).cast("int"))
    before = (placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).drop("n"))
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("id", "key"))
    return (placed.withColumn("rank", rank).join(before, ["shard", "cell"])
            .select(F.col("id").alias(id_col), "size", "tokens", "text_crc32", *["key"] * with_key, "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot")))


def assign(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """docs, all columns, with the columns shard and slot.

    Rows of equal id and text share their places one each. Columns of docs that are named shard or slot
    are replaced.
    """
    named = docs.drop("shard", "slot")
    key = [F.col(id_col).alias("__id"), F.xxhash64(text_or_empty(text_col)).alias("__key")]
    turn = lambda by: F.row_number().over(Window.partitionBy("__id", "__key").orderBy(by))
    places = pack(docs, n_shards, id_col, text_col, with_key=True, **rule)
    places = places.select(F.col(id_col).alias("__id"), F.col("key").alias("__key"), "shard", "slot").withColumn("__n", turn("slot"))
    rows = named.select("*", *key).withColumn("__n", turn(F.lit(1)))
    same = [F.col("r.__id").eqNullSafe(F.col("p.__id")), F.col("r.__key") == F.col("p.__key"), F.col("r.__n") == F.col("p.__n")]
    return rows.alias("r").join(places.alias("p"), same[0] & same[1] & same[2]).select(*[F.col(f"r.`{c}`") for c in named.columns], "p.shard", "p.slot")


def op7(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
