"""Benchmark decontamination with a broadcast hash set of benchmark n-grams.

The benchmark's windows (n words; an item with fewer words is one window) are hashed and broadcast;
each document's windows are looked up by hash, and each hit is verified word for word. The broadcast
is bounded: `limit` counts the bytes of the built set, arrays of 28 bytes a word beside the text; equal rows count
once. A larger benchmark is taken in slices by a hash of the row, each slice against all documents, and the
hits of the slices are merged per document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower
from .tokens import ALNUM, Words, chunks, gram_hashes, split_words

HITS = "id long, row long, n_words long, spans array<struct<start:int,stop:int>>, items array<string>"
_TABLE_BITS = 20
WORD_CHARS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_BYTES, ITEM_BYTES = 28, 200  # of the built set: arrays for each word, objects for each item


@dataclass
class Windows:
    """The distinct windows of m words of the benchmark's texts, sorted by hash: that of number k starts at word
    `first[k]` and belongs to the texts owner[ptr[k]:ptr[k + 1]]."""

    hashes: np.ndarray
    first: np.ndarray
    ptr: np.ndarray
    owner: np.ndarray


@dataclass
class GramSet:
    """Arrays alone: the texts' folded bytes with their word ends, Windows by length, item ids by text."""

    base: Words
    windows: dict[int, Windows]
    ids: list[list[str]]


def _windows(base: Words, at: np.ndarray, g: np.ndarray, doc: np.ndarray, m: int) -> Windows:
    order = np.argsort(g, kind="stable")
    at, g = at[order], g[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = g[1:] != g[:-1]
    # of one hash: the same words or, once in a great while, others; these get numbers of their own
    starts = np.flatnonzero(fresh)
    for a, b in zip(starts, np.append(starts[1:], len(g))):
        if b - a > 1:
            by: dict[bytes, list[int]] = {}
            for i in at[a:b].tolist():
                by.setdefault(base.join(i, i + m), []).append(i)
            at[a:b] = [i for same in by.values() for i in same]
            if len(by) > 1:
                fresh[a + np.cumsum([len(same) for same in by.values()])[:-1]] = True
    ptr = np.flatnonzero(fresh)
    return Windows(g[ptr], at[ptr].astype(np.int32), np.append(ptr, len(g)).astype(np.int32), doc[at].astype(np.int32))


def gram_set(items: list[tuple[str | None, str]], n: int) -> GramSet:
    """The windows of (id, text) items: of n words, or of all words of a text that has fewer."""
    ids: dict[str, set[str]] = {}
    for item, text in items:
        ids.setdefault(text, set()).add("" if item is None else item)
    base = split_words(pa.array(list(ids), pa.string()), ALNUM, fold=True)
    base = Words(base.data, base.start.astype(np.int32), base.end.astype(np.int32), base.bounds)
    h, left, doc, counts = base.hashes(), base.left(), base.doc_of(), base.counts()
    windows = {}
    for m in sorted({min(n, int(c)) for c in np.unique(counts) if c}):
        g = gram_hashes(h, m)
        at = np.flatnonzero((left[: len(g)] >= m) & ((counts[doc[: len(g)]] >= n) if m == n else (counts[doc[: len(g)]] == m)))
        windows[m] = _windows(base, at, g[at], doc, m)
    return GramSet(base, windows, [sorted(v) for v in ids.values()])


def _bits(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << _TABLE_BITS, bool)
    bits[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
    return bits


def find_hits(words: Words, known: GramSet, bits: dict[int, np.ndarray]) -> list[tuple[int, int, int]]:
    """Verified (start, length, number of the window) hits in a chunk."""
    h, left, out = words.hashes(), words.left(), []
    for m, win in known.windows.items():
        g = gram_hashes(h, m)
        at = np.flatnonzero(bits[m][(g >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        at = at[left[at] >= m]
        low, high = np.searchsorted(win.hashes, g[at], "left"), np.searchsorted(win.hashes, g[at], "right")
        for i, a, b in zip(at.tolist(), low.tolist(), high.tolist()):
            for k in range(a, b):
                f = int(win.first[k])
                if words.join(i, i + m) == known.base.join(f, f + m):
                    out.append((i, m, k))
    return out


def _scan(shared):
    def scan(batches):
        known = shared.value
        bits = {m: _bits(win.hashes) for m, win in known.windows.items()}
        for batch in batches:
            for part in chunks(batch, "text"):
                words = split_words(part.column("text"), ALNUM, fold=True)
                spans, hit, items = [[] for _ in range(words.n_docs)], [set() for _ in range(words.n_docs)], []
                for i, m, k in sorted(find_hits(words, known, bits)):
                    d = int(np.searchsorted(words.bounds, i, "right")) - 1
                    a = i - int(words.bounds[d])
                    hit[d].add((m, k))
                    if spans[d] and a <= spans[d][-1]["stop"]:
                        spans[d][-1]["stop"] = max(spans[d][-1]["stop"], a + m)
                    else:
                        spans[d].append({"start": a, "stop": a + m})
                for found in hit:
                    owners: set[int] = set()
                    for m, k in found:
                        win = known.windows[m]
                        owners.update(win.owner[win.ptr[k] : win.ptr[k + 1]].tolist())
                    items.append(sorted({x for o in owners for x in known.ids[o]}))
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), part.column("row"), pa.array(words.counts(), pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                    pa.array(items, pa.list_(pa.string()))], names=["id", "row", "n_words", "spans", "items"])
    return scan


def _merge(df: DataFrame, slices: int) -> DataFrame:
    """One row per document row from the hits of several slices: spans united, items gathered."""
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    step = lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["stop"]), F.concat(
        F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
        F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], s["stop"]).alias("stop"))))
    ).otherwise(F.concat(acc, F.array(s)))
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    merged = df.groupBy("id", "row").agg(F.first("n_words").alias("n_words"), spans.alias("spans"), items.alias("items"), (F.count(F.lit(1)) / slices).cast("int").alias("copies"))
    empty = F.expr("cast(array() as array<struct<start:int,stop:int>>)")
    merged = merged.withColumn("spans", F.aggregate("spans", empty, step))
    return merged.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", limit: int = 64 << 20) -> DataFrame:
    """One row (id, n_words, spans, items) per row of docs; spans are united word ranges [start, stop).

    Words are runs of digits, a-z (A-Z is lower-cased) and bytes beyond ASCII. A null or empty text
    has no words and no hits; a null or empty item has no windows; a null item id reads as the empty
    string; items of equal id count once. Repeated documents each get a row. Other columns are not
    read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).distinct()
    n_words = F.regexp_count(ascii_lower(F.col("text")), F.lit(WORD_CHARS))
    built = F.octet_length("text") + WORD_BYTES * n_words + F.coalesce(F.octet_length("item"), F.lit(0)) + ITEM_BYTES
    size = items.agg(F.coalesce(F.sum(built), F.lit(0))).first()[0]
    slices = max(1, math.ceil(size / limit))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    found = []
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == k) if slices > 1 else items
        shared = spark.sparkContext.broadcast(gram_set([(r[0], r[1]) for r in part.collect()], n))  # bounded by `limit`
        found.append(rows.mapInArrow(_scan(shared), HITS))
    if slices == 1:
        return found[0]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return _merge(every, slices)


def n_hit(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "document", id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """docs, all columns, without contaminated rows (mode "document") or contaminated words ("span").

    In mode "span" the words of a text that are covered by a hit are cut out bytewise; separators stay.
    """
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__row"))
    hits = scan(docs, benchmark, id_col=id_col, text_col=text_col, **rule).where(F.size("spans") > 0)
    hits = hits.groupBy(F.col("id").alias("__id"), F.col("row").alias("__row")).agg(F.first("spans").alias("__spans"))
    if mode == "document":
        return docs.join(hits, same, "left_anti")
    joined = docs.join(hits, same, "left")
    text = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(F.pandas_udf(_cut, "string")(F.col(text_col), F.col("__spans")))
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, cuts in zip(texts, spans):
        if text is None or cuts is None:
            out.append(text)
            continue
        words = split_words(pa.array([text]), ALNUM, fold=True)
        raw, at, kept = text.encode(), 0, []
        for s in cuts:
            kept.append(raw[at : words.start[s["start"]]])
            at = words.end[s["stop"] - 1]
        out.append(b"".join([*kept, raw[at:]]).decode())
    return pd.Series(out, dtype=object)


def op3(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    hits = n_hit(F.col("spans"))
    return scan(docs, benchmark).select(
        F.col("id").alias("doc_id"), "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bg AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bg),
dg AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN lens WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, dg.n, i FROM dg JOIN bg ON dg.n = bg.n AND dg.g = bg.g),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.s, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
