"""Stages on tables with null and repeated ids: verdicts hold for rows, not for all rows of one id."""

from collections import Counter

from pyspark.sql import functions as F
from test_llm_operators import DOCS, prose

from tidemark.llm import decontaminate, line_dedup, mixing, near_dedup, quality, shard


def table(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def tally(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect())


def test_quality_rejects_rows(spark):
    clean = [(i, prose(60 + i % 90, i), "en", "a") for i in range(200)]
    clean += [(None, prose(70, 500), "en", "a"), (None, prose(80, 501), "en", "a"), (3, prose(90, 502), "en", "a"), (4, prose(90, 503), None, "a"), (4, prose(90, 503), "a", None)]
    junk = [(None, "# * $ % & " * 30 + prose(80, 900), "en", "a"), (None, "too short", "en", "a"), (None, None, "en", "a"), (3, "x y " * 90, "en", "a"), (5, None, None, None)]
    assert tally(quality.keep(table(spark, clean + junk))) == Counter(clean)


def test_one_document_of_each_group(spark):
    text, near = prose(120, 1), prose(120, 1).split()
    near[60] = "changed"
    other, third = prose(100, 2), prose(90, 3)
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (1, other, "en", "a"), (2, " ".join(near), "en", "b"), (2, third, "en", "b"), (7, None, "en", "a"), (7, "", "en", "a")]
    rows += [(None, text, "en", "a"), (None, text, "en", "b"), (None, " ".join(near), "en", "a"), (None, prose(80, 4), "en", "a"), (None, None, "en", "a")]
    kept = tally(near_dedup.keep(table(spark, rows)))
    named = {(i, t): n for (i, t, *_), n in kept.items() if i is not None}
    assert named == {(1, text): 1, (1, other): 1, (2, third): 1, (7, None): 1, (7, ""): 1}
    loose = Counter(t for (i, t, *_), n in kept.items() if i is None for _ in range(n))
    assert loose.pop(text, 0) + loose.pop(" ".join(near), 0) == 1 and loose == {prose(80, 4): 1, None: 1}


def test_mix_takes_rows(spark):
    rows = [(i, prose(20 + i % 7, i), "en", f"s{i % 3}") for i in range(60)]
    rows += [(None, prose(30 + i, 100 + i), "en", "s0") for i in range(20)] + [(9, prose(25, 200 + i), "en", "s2") for i in range(11)] + [(10, prose(22, 300), "en", None)] * 7
    df = table(spark, rows)
    want = Counter()
    for r in mixing.mix(df, with_key=True).join(df.withColumn("key", mixing.text_key("text")).select("key", "text").distinct(), "key").collect():
        want[r["doc_id"], r["text"], "en", r["source"]] += r["copies"]
    got = tally(mixing.emit(df))
    assert got == +want and sum(got.values()) == mixing.mix(df).agg(F.sum("copies")).first()[0]


def test_dotted_and_map_columns(spark):
    rows = [(i, prose(60 + i, i) if i != 4 else prose(63, 3), "en", "a") for i in range(6)] + [(3, prose(70, 9), "en", "a"), (None, prose(80, 10), "en", None)]
    df = table(spark, rows).withColumn("a.b", F.lit("x")).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    leak = spark.createDataFrame([(0, prose(70, 9))], "item_id long, text string")
    for out in (quality.keep(df), near_dedup.keep(df), near_dedup.keep(df.where("doc_id != 3")), decontaminate.remove(df, leak), decontaminate.remove(df, leak, mode="span"), mixing.emit(df)):
        assert out.columns == df.columns and out.where("`a.b` = 'x'").count() == out.count() > 0
    assert shard.assign(df).columns == [*df.columns, "shard", "slot"] and line_dedup.dedup(df).where("`a.b` = 'x'").count() == len(rows)


def test_mix_of_hashed_ids_and_empty_texts(spark):
    """Most rows of a source share one size, under ids far apart and of any type."""
    df = spark.range(4000).select(F.xxhash64("id").cast("string").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.lit("one two three")).otherwise("").alias("text"), F.lit("a").alias("source"))
    out = mixing.mix(df.repartition(7))
    assert out.count() == 4000 and out.where("size = 0 AND copies > 2").count() == 0
    taken, aim = out.agg(F.sum("taken"), F.max("target")).first()
    assert abs(taken - aim) <= 3
