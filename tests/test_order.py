"""Numbers over a distributed value order against sorting in Python."""

import random

from pyspark.sql import functions as F

from tidemark.operators.order import numbered, running


def test_numbers_within_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "a", "a", "b", "c"]), rng.choice([None, *range(50)]), i) for i in range(3000)]
    got = numbered(spark.createDataFrame(rows, "k string, v int, i int").repartition(7), ["k"], [F.col("v").asc_nulls_first(), F.col("i")], "place", "of").collect()
    assert len(got) == len(rows)
    for key in (None, "a", "b", "c"):
        want = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert sorted((r["place"], r["i"], r["of"]) for r in got if r["k"] == key) == [(n, r[2], len(want)) for n, r in enumerate(want)]


def test_numbers_without_keys_and_rows(spark):
    got = numbered(spark.range(1000).repartition(5), [], [F.col("id").desc()]).collect()
    assert sorted((r["n"], r["id"]) for r in got) == [(n, 999 - n) for n in range(1000)]
    assert numbered(spark.range(0), [], [F.col("id")]).count() == 0


def test_running_sums(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b"]), i, rng.randint(-5, 9)) for i in range(2000)]
    got = running(spark.createDataFrame(rows, "k string, v int, x int").repartition(6), ["k"], [F.col("v").desc()], {"s": F.col("x"), "n": F.lit(1)}).collect()
    for key in "ab":
        total, want = 0, []
        for i, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: -r[1])):
            total += r[2]
            want.append((r[1], total, i + 1))
        assert sorted((r["v"], r["s"], r["n"]) for r in got if r["k"] == key) == sorted(want)
