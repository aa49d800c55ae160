"""Lines that share a SimHash with a line they are not similar to."""

import random

from test_llm_operators import DOCS, brute_lines, prose

from tidemark.llm import line_dedup


def test_reordered_lines(spark):
    rows = []
    for k in range(6):
        w = prose(40, 600 + k).split()
        a, b, f = list(w), list(w), w[20:] + w[:20]
        b[5], b[6] = b[6], b[5]
        c, e = list(b), w[20:] + w[:20]
        c[30] = "typo" + c[30]
        e[3] = "x" + e[3]
        rows += [(100 * k + j, " ".join(x) + f"\nown {k} {j} " + prose(9, 900 + 10 * k + j), "en", "a") for j, x in enumerate((f, a, b, c, e))]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    want = brute_lines(rows)
    assert all(len(want[100 * k + 2]) == 1 for k in range(6))  # b goes for a, not for f
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(df).collect()}
    assert got == {i: "\n".join(x) for i, x in want.items()}


def test_distance_of_characters():
    rng = random.Random(3)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for n in range(400):
        letters = "abé語😀" if n % 2 else "abcdefgh "
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 150)))
        b = "".join(c for c in a if rng.random() > 0.1)
        b = "".join(rng.choice(letters) if rng.random() < 0.1 else c for c in b) + rng.choice(["", "x", "ab"])
        d = distance(a, b)
        assert [line_dedup.within(a, b, k) for k in (d - 1, d, d + 1)] == [False, True, True]


def test_repeated_rows_do_not_add_up(spark):
    """The words of equal rows' lines are not summed up, which would overflow the lanes of the SimHash."""
    w = prose(100, 4)
    near = w.split()
    near[50] = "typo"
    rows = [(1, w, "en", "a")] * 7 + [(2, " ".join(near), "en", "a")]
    got = {(r["doc_id"], r["text"]) for r in line_dedup.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(1, w), (2, "")}


def test_native_verdict_is_that_of_the_distance(spark):
    """No Python on the executors: shared words left out, the words' alignment, and levenshtein() with its limit agree with within()."""
    rng, pairs = random.Random(7), [("a b", "a x b"), ("a x b", "a b"), ("a", "b"), ("ab cd", "cd ab"), ("x", "x y z w"), ("a a a b", "a a b")]
    for n in range(600):
        a = [rng.choice(("the", "of", "é語", "😀", "thing", "w%d" % rng.randint(0, 40))) for _ in range(rng.randint(1, 60))]
        b, share = [], rng.choice((0.05, 0.15, 0.3))
        for w in a:
            kind = rng.random() / share
            b += [w] if kind > 1 else [] if kind < 0.3 else [w, "new"] if kind < 0.6 else ["typo" + w]
        b = b[len(b) // 2 :] + b[: len(b) // 2] if n % 10 == 0 else b
        pairs.append((" ".join(a), " ".join(b) or "z"))
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(pairs)], "k int, ta string, tb string")
    for percent in (60, 80):
        got = line_dedup.similar_texts(df, percent)
        assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
        want = {k for k, (x, y) in enumerate(pairs) if line_dedup.within(x, y, max(len(x), len(y)) * (100 - percent) // 100)}
        assert {r["k"] for r in got.collect()} == want and 0 < len(want) < len(pairs)


def test_each_pair_of_hashes_once(spark):
    """A pair that agrees in several blocks comes under the first choice of two alone, without a distinct()."""
    rng = random.Random(11)
    hashes = [rng.getrandbits(64) for _ in range(20)]
    hashes += [h ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 11))}) for h in hashes for _ in range(8)]
    df = spark.createDataFrame([(k, h - (1 << 64) if h >> 63 else h, -1) for k, h in enumerate(hashes)], "c long, h long, p long")
    got = sorted((r["a"], r["b"]) for r in line_dedup.candidates(df, 10, 6).collect())
    edges = [64 * i // 6 for i in range(7)]
    agree = lambda x: sum(not x >> edges[i] & (1 << edges[i + 1] - edges[i]) - 1 for i in range(6))
    assert got == sorted((a, b) for a in range(len(hashes)) for b in range(a) if agree(x := hashes[a] ^ hashes[b]) >= 2 and x.bit_count() <= 10)
