"""The prefix trie against plain Python; list ranking against a shuffled list."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import trie

CONVS = "conv_id long, turn long, role string, text string"


def brute(rows):
    turns = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((n is not None, n or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()), role, text))
    turns = {c: [t[1:] for t in sorted(ts)] for c, ts in turns.items()}
    nodes = defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built = turns.get(base, [])[:h] + own[h:]
        for d in range(len(built) + 1):
            nodes[tuple(built[:d])].append((c, len(built)))
    kids, out = defaultdict(int), []
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, ms in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(ms) - 1) * len(p[-1][1]) if p else 0
    least = lambda p: min(c for c, _ in nodes[p])
    for p, ms in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c, n in ms if n == len(p)))
        out.append((least(p), len(p), least(p[:-1]) if p else None, len(ms), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table():
    rng = random.Random(5)
    text = lambda: rng.choice(["", "a", "é\U0001F600", "yes", "no", None])
    rows = [(c, n, rng.choice(["user", "assistant", None]), text()) for c in [*range(-205, -195), *range(160), 305, 399, 100_000_007] for n in range(rng.randint(1, 9))]
    rows += [(c, n, "user", "same") for c in range(500, 590) for n in range(3)]  # one group of copies
    rows += [(700, None, "user", "x"), (700, None, "assistant", "x"), (700, 1, "user", "b"), (700, 1, "user", "a"), (700, 1, "user", "a"), (None, 0, "user", "lost"), (800, 0, "user", None), (801, 3, None, "long " * 20_000)]
    return rows + [(900, n, "user", f"t{n}") for n in range(60)] + [(901, n, "user", f"t{n}") for n in range(55)]


def clash(df):
    return df.select("*", *[F.lit("x").alias(c) for c in ("id", "depth", "digest", "chars", "size", "h", "base", "a", "b", "k", "rank", "a.b")])


@pytest.mark.parametrize("small", [False, True])
def test_trie(spark, monkeypatch, small):
    if small:  # sums carried over chunks, digests of many runs
        monkeypatch.setattr(trie, "CHUNK", 4)
    df = clash(spark.createDataFrame(table(), CONVS).repartition(3))
    assert sorted((tuple(r) for r in trie.op12(df).collect()), key=str) == brute(table())


def test_empty(spark):
    assert trie.op12(spark.createDataFrame([], CONVS)).count() == 0
    assert trie.op12(spark.createDataFrame([(None, 1, "user", "x")], CONVS)).count() == 0


def test_one_turnless_conversation(spark):
    rows = [(101, 0, "user", "x")]  # its first turns come from a conversation that is absent
    assert zlib.crc32(b"101") % 6 > 0
    assert [tuple(r) for r in trie.op12(spark.createDataFrame(rows, CONVS)).collect()] == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 700])
def test_list_ranking(spark, n):
    names = [(random.Random(i).randint(-50, 50), i) for i in range(n)]
    random.Random(2).shuffle(names)
    links = [(*names[i], *(names[i - 1] if i else (None, None))) for i in range(n)]
    ranks = trie.list_rank(spark.createDataFrame(links, "c long, k long, pc long, pk long").repartition(3), walk=20)
    assert {(r["c"], r["k"]): r["rank"] for r in ranks.collect()} == {x: i for i, x in enumerate(names)}
