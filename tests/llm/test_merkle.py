"""The manifest and its proofs against plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def grow(nodes, fan):
    levels = [nodes]
    while len(levels[-1]) > 1:
        n = levels[-1]
        levels.append([sha("".join(n[i : i + fan])) for i in range(0, len(n), fan)])
    return levels


def climb(levels, i, digest, fan):
    """(digest at the top, siblings) from node i with another digest."""
    out = []
    for level in levels[:-1]:
        a = i // fan * fan
        run = level[a : a + fan]
        out += run[: i - a] + run[i - a + 1 :]
        digest = sha("".join([*run[: i - a], digest, *run[i - a + 1 :]]))
        i //= fan
    return digest, out


def brute(rows, fan=16):
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, of = [], {}
    for s in sources:
        own = sorted(((i, leaf(i, s, g, n, t), t, g, n) for i, t, g, x, n in rows if x == s), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        of[s] = own
        trees.append(grow([r[1] for r in own], fan))
    top = grow([t[-1][0] for t in trees], fan)
    root, out = top[-1][0] if trees else None, []
    for k, s in enumerate(sources):
        for p, (i, h, t, g, n) in enumerate(of[s]):
            tampered = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
            d, left = climb(trees[k], p, leaf(i, s, g, n, t.translate(lower) if t is not None else None) if tampered else h, fan)
            d, more = climb(top, k, d, fan)
            out.append((i, h, trees[k][-1][0], root, sha("".join(left + more)), d, d == root))
    return sorted(out, key=str)


def table(n_hot, others):
    rows = [(i, f"Text {i} É" if i % 7 else None, "en" if i % 3 else None, "hot", i if i % 4 else None) for i in range(n_hot)]
    rows += [(10_000 + i, f"Other {i}", "de", s, 3) for i, s in enumerate(others)]
    return rows


def clash(df):
    return df.select("*", *[F.lit("x").alias(c) for c in ("tree", "level", "i", "n", "path", "slot", "leaf", "root", "digest", "at__", "tree__", "kids", "a.b")])


CASES = {
    "deep": table(4200, [None] * 40 + ["é"] * 17 + ["z"] + ["Z"] * 16),
    "many sources": table(5, [f"s{i}" for i in range(300)] + [f"s{i}" for i in range(0, 300, 2)]),
    "one source": table(257, []),
    "sources of one": table(0, [None, "a", "b"]),
    "one row": table(1, []),
    "ties": [(None, "A", None, None, 1), (None, "A", None, None, 1), (None, "B", None, None, None), (3, "", "", "", 0), (3, "", "", "", 0), (3, None, None, None, None), (5, "ABC " * 50_000, "en", "", 7)],
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_manifest(spark, case):
    df = clash(spark.createDataFrame(CASES[case], DOCS).repartition(5))
    assert sorted((tuple(r) for r in merkle.op13(df).collect()), key=str) == brute(CASES[case])


def test_joins_by_shuffle_and_other_fans(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST", -1)
    rows = table(300, ["b"] * 5 + ["c"])
    df = spark.createDataFrame([(r[0], r[3], leaf(r[0])) for r in rows], "id long, source string, leaf string")
    out = merkle.proofs(df, fan=2).withColumn("f", merkle.folded(F.col("leaf"), F.col("slot"), F.col("path"))).collect()
    trees = [grow([leaf(i) for i in ids], 2) for ids in ([10_000, 10_001, 10_002, 10_003, 10_004], [10_005], range(300))]
    root = grow([t[-1][0] for t in trees], 2)[-1][0]
    assert len(out) == 306 and {r["root"] for r in out} == {r["f"]["root"] for r in out} == {root}
    assert max(len(r["path"]) for r in out) == 9 + 2 and all(len(r["f"]["siblings"]) % 64 == 0 for r in out)


def test_empty(spark):
    assert merkle.op13(spark.createDataFrame([], DOCS)).count() == 0
