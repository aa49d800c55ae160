"""BPE against the tokenizers library, text by text."""

import hashlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import bpe

DOCS = "doc_id long, text string"


@lru_cache
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_vocabulary())
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache
def codec():
    with open(bpe.default_vocabulary()) as f:
        return bpe.Codec(f.read())


def ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


def packed(text):
    return np.array(ids(text), "<u4").tobytes()


PARTS = [*map(chr, range(32, 127)), *"Σσς\u0130ıÉé\u0301\u0345‍　\xa0\x85\x1c\x1f\u2028\u2003ßſK€中文ñ١²½\U0001F600\t\n\r\x0b\x0c\x00", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "the", "ing", "tion"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join) | st.text(max_size=30))
def test_texts(text):
    text = text.encode("utf-8", "ignore").decode()
    assert codec().encode([text.encode()]) == [packed(text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aeinrstho", min_size=1, max_size=12), min_size=1, max_size=30))
def test_words_in_one_go(words):
    tokens, counts = codec().words(words)
    want = [ids(w) for w in words]
    assert counts.tolist() == [len(w) for w in want] and tokens.tolist() == [t for w in want for t in w]


def test_pairs_agree_with_exact_merging():
    c, rng = codec(), np.random.default_rng(3)
    a, b = rng.choice(c.token[c.token >= 0], (2, 4000))
    spelled = {}

    def spell(t):
        if t not in spelled:
            spelled[t] = [t] if c.rank[t] < 0 else spell(int(c.left[t])) + spell(int(c.right[t]))
        return spelled[t]

    exact = [c.merged(spell(x) + spell(y)) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert c.compatible(a, b).tolist() == exact and 0 < sum(exact) < len(exact)


def test_long_words_and_small_caches(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("etaoin"), 5000)), "a" * 3000, "ab" * 400 + " " + "é" * 300, " ".join("".join(rng.choice(list("etaoin shrdlu"), 9)) for _ in range(2000))]
    monkeypatch.setattr(bpe, "CACHE", 200)
    monkeypatch.setattr(bpe, "CHUNK", 300)
    c = codec()
    c.prepare([t.encode() for t in texts])
    assert c.encode([t.encode() for t in texts]) == [packed(t) for t in texts]


def rows():
    rng = np.random.default_rng(5)
    prose = [" ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(1, 12))) for _ in range(n)) for n in (1, 40, 400, 30000)]
    return [(0, None), (1, ""), (2, " \t\n "), (3, "Hello, World's <|endoftext|>it<|endoftext|>"), (3, "again"), (None, "no id"), (4, "x\xa0y\u3000Straße ΑΣ 12½"), *[(5 + i, t) for i, t in enumerate(prose)], (9, prose[1]), (10, "z" * 20000)]


def test_round_trip_of_rows(spark):
    df = spark.createDataFrame(rows(), DOCS).repartition(3)
    clash = df.select("*", *[F.lit("x").alias(c) for c in ("id", "ids", "n_tokens", "decoded", "c0", "a.b")])
    enc = bpe.encode(clash)
    assert enc.columns == ["doc_id", "n_tokens", "ids"]
    back = bpe.decode(enc)
    got = sorted(((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in back.collect()), key=str)
    assert got == sorted(((i, len(ids(t)), packed(t), library().decode(ids(t), skip_special_tokens=False)) for i, t in rows()), key=str)
    hashed = sorted((tuple(r) for r in bpe.op11(clash).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert hashed == sorted(((i, n, sha(b), sha(d.encode())) for i, n, b, d in got), key=str)


def test_decode_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, b"", "x"), (3, np.array([320, 10**9, 49407], "<u4").tobytes(), "x")], "a long, ids binary, `a.b` string")
    got = {r["a"]: (r["decoded"], r["a.b"]) for r in bpe.decode(df).collect()}
    assert got == {1: (None, "x"), 2: ("", "x"), 3: (library().decode([320, 49407], skip_special_tokens=False), "x")}


def test_empty_table_and_other_vocabularies(spark):
    assert bpe.op11(spark.createDataFrame([], DOCS)).count() == 0
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json")) as f, pytest.raises(ValueError):
        bpe.Codec(f.read())
