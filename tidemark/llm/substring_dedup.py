"""Exact substring dedup with FM-indexes of packed bit vectors; their suffixes and seed ranks are whole 64-bit numbers.

A window is n consecutive words of a document. Words covered by a window that also starts in a document
with a smaller id are removed. Each shard holds an FM-index of its texts: the Burrows-Wheeler transform
over word codes in a wavelet tree of packed bit vectors. The shard's texts are streamed against it by
backward search, which gives the matching statistics as far as they matter: whether the window ending at
a position occurs again, in which suffix interval, and so in which least document.

So that a document need not meet every shard, texts are cut at minimizers. A run of windows with one
minimizer (the least hash of the window's m-word grams) is a segment, and equal windows have equal
minimizers. Only segments whose minimizer another document has are indexed; they are dealt to shards by
minimizer, equal segments once with their least id. Three steps keep frequent passages from meeting in
one task: minimizers that are frequent in a bounded sample of documents skip the search for repeats, as
they are known to repeat; equal segments are reduced per batch on the map side; and segments of a minimizer with
more than `crowd` documents are cut into single windows, dealt by the window's own hash.

Minimizers and segment keys are hashes (48 and 128 bits). The first only select more than needed when
they collide.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import Words, chunks, gram_hashes, mix, split_words

_C1, _C2 = np.uint64(0xA0761D6478BD642F | 1), np.uint64(0xE7037ED1A0B428DB | 1)
_INV1, _INV2 = np.uint64(pow(int(_C1), -1, 1 << 64)), np.uint64(pow(int(_C2), -1, 1 << 64))


LONGEST = 24  # windows of a segment; a longer run, as in periodic text, is cut


# --- segments -------------------------------------------------------------------------------


def segments(words: Words, h: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, windows, minimizer key) of each segment of a chunk, in order."""
    empty = np.empty(0, np.int64)
    if len(h) < n:
        return empty, empty, empty, empty
    low = gram_hashes(h, m)
    span, size = 1, n - m + 1
    while span * 2 <= size:  # least of `size` consecutive grams, by doubling
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < size:
        low = np.minimum(low[: len(low) - (size - span)], low[size - span :])
    at = np.flatnonzero(words.left()[: len(low)] >= n)
    low, doc = low[at], words.doc_of()[at]
    if not len(at):
        return empty, empty, empty, empty
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    run = np.flatnonzero(new)
    new[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % LONGEST == 0] = True
    first = np.flatnonzero(new)
    return doc[first], at[first], np.diff(np.append(first, len(at))), (low[first] >> np.uint64(16)).astype(np.int64)


def segment_keys(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key of words start to stop - 1, in two halves."""
    out = []
    for c, inv in ((_C1, _INV1), (_C2, _INV2)):
        up, down = np.full(len(h) + 1, c), np.full(len(h) + 1, inv)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        acc = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[:-1], out=acc[1:])
        out.append(mix((acc[stop] - acc[start]) * down[start] + (stop - start).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _minimizers(n: int, m: int, known=None):
    """(key, id, sure) of each document's distinct minimizers; sure: known to be frequent."""
    def run(batches):
        hot = np.asarray(known.value, np.int64) if known else np.empty(0, np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                words = split_words(part.column("text"))
                doc, _, _, key = segments(words, words.hashes(), n, m)
                order = np.lexsort((key, doc))
                doc, key = doc[order], key[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                doc, key = doc[new], key[new]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part.column("id").to_numpy()[doc]), pa.array(np.isin(key, hot))], names=["key", "id", "sure"])
    return run


def _repeated(crowd: int):
    """Of rows (key, id) sorted by key: those whose key has more than one row, and whether it has over `crowd`."""
    def out(key, ids, many):
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ids, pa.int64()), pa.array(many, pa.bool_())], names=["key", "id", "crowded"])

    def closed(key, ids, crowded_key):
        """The repeated ones of complete runs."""
        if not len(key):
            return out([], [], [])
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.repeat(np.diff(np.append(edge, len(key))), np.diff(np.append(edge, len(key))))
        over = (size > crowd) | (key == crowded_key) if crowded_key is not None else size > crowd
        take = (size > 1) | over
        return out(key[take], ids[take], over[take])

    def run(batches):
        key, ids, crowded = np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in batches:
            key, ids = np.append(key, batch.column("key").to_numpy()), np.append(ids, batch.column("id").to_numpy())
            if not len(key):
                continue
            open_at = int(np.searchsorted(key, key[-1]))
            if len(key) - open_at > crowd or key[-1] == crowded:  # the open run is crowded already: nothing of it is held
                yield closed(key[:open_at], ids[:open_at], crowded)
                yield out(key[open_at:], ids[open_at:], np.ones(len(key) - open_at, bool))
                crowded, key, ids = key[-1], key[:0], ids[:0]
            else:
                yield closed(key[:open_at], ids[:open_at], crowded)
                key, ids = key[open_at:], ids[open_at:]
        yield closed(key, ids, crowded)
    return run


def _chosen(part: pa.RecordBatch, words: Words, h: np.ndarray, n: int, m: int):
    """Of a chunk's segments those with a repeated minimizer, crowded ones as single windows: (text, start, stop, what deals them)."""
    doc, first, windows, key = segments(words, h, n, m)
    plain, crowded = ([np.asarray(x, np.int64) for x in part.column(c).to_pylist()] for c in ("plain", "crowded"))
    bounds = np.searchsorted(doc, np.arange(words.n_docs + 1))
    take, single = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    for d in range(words.n_docs):
        own = slice(bounds[d], bounds[d + 1])
        single[own] = np.isin(key[own], crowded[d])
        take[own] = np.isin(key[own], plain[d]) & ~single[own]
    alone = np.repeat(np.flatnonzero(single), windows[single])
    at = first[alone] + np.arange(len(alone)) - np.repeat(np.cumsum(windows[single]) - windows[single], windows[single])
    by = np.concatenate([key[take], gram_hashes(h, n)[at].view(np.int64)]) if len(h) >= n else np.empty(0, np.int64)
    return np.concatenate([doc[take], doc[alone]]), np.concatenate([first[take], at]), np.concatenate([first[take] + windows[take] + n - 1, at + n]), by


def _texts(n: int, m: int, shards: int):
    """(shard, words, id, held) of the chosen segments; equal ones of a batch are one row with their least id."""
    def run(batches):
        for batch in batches:
            held: dict[bytes, list[int]] = {}
            for part in chunks(batch, "text"):
                words = split_words(part.column("text"))
                of, start, stop, by = _chosen(part, words, words.hashes(), n, m)
                raw, ids = words.data.tobytes(), part.column("id").to_numpy()[of]
                shard = mix(by.view(np.uint64)) % np.uint64(shards)
                for a, b, i, k in zip(words.start[start].tolist(), words.end[stop - 1].tolist(), ids.tolist(), shard.tolist()):
                    w = _spaced(raw[a:b])
                    if (e := held.get(w)) is None:
                        held[w] = [k, i, 1]
                    else:
                        e[1], e[2] = min(e[1], i), e[2] + 1
            cols = list(zip(*held.values())) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(list(held), pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["shard", "words", "id", "held"])
    return run


def _places(n: int, m: int):
    """(k1, k2, id, first) of the chosen segments."""
    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                words = split_words(part.column("text"))
                h = words.hashes()
                of, start, stop, _ = _chosen(part, words, h, n, m)
                k1, k2 = segment_keys(h, start, stop)
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(part.column("id").to_numpy()[of], pa.int64()), pa.array((start - words.bounds[of]).astype(np.int32), pa.int32())], names=["k1", "k2", "id", "first"])
    return run


def _spaced(raw: bytes) -> bytes:
    """The words of raw, which has only ASCII separators, one space apart."""
    return b" ".join(raw.split())


_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


# --- the index ------------------------------------------------------------------------------


class WaveletTree:
    """A wavelet tree in matrix form over codes: per level a packed bit vector with counts per 64 bits."""

    def __init__(self, codes: np.ndarray, alphabet: int):
        self.levels = []
        self.bits = max(1, int(alphabet - 1).bit_length())
        for level in reversed(range(self.bits)):
            bit = ((codes >> level) & 1).astype(bool)
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[: len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.zeros(len(packed), np.int64)
            np.cumsum(np.bitwise_count(packed)[:-1], out=before[1:])
            self.levels.append((level, packed, before.astype(np.int32), len(bit) - int(bit.sum())))
            codes = np.concatenate([codes[~bit], codes[bit]])

    def descend(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a prefix of length `at` ends on the lowest level on the way of `code`."""
        at = at.astype(np.int64)
        for level, packed, before, zeros in self.levels:
            word = at >> 6
            ones = before[word] + np.bitwise_count(packed[word] & _BELOW[at & 63])
            at = np.where(code & (1 << level), zeros + ones, at - ones)
        return at


class FMIndex:
    """Backward search over concatenated texts of word codes (1 and up; 0 ends each text).

    Suffixes are sorted by their first `depth` words, a power of two and enough for patterns up to it.
    The intervals of the `known` last words of a pattern (the largest power of two within n, at most 8)
    are kept, as seeds of the search.
    """

    def __init__(self, codes: np.ndarray, alphabet: int, n: int):
        rank, span = codes.astype(np.int64), 1
        self.known = max(k for k in (1, 2, 4, 8) if k <= n)
        while True:
            if span == self.known:
                self.seed = rank
            if span >= n:
                break
            nxt = np.zeros(len(codes), np.int64)
            nxt[: len(codes) - span] = rank[span:] + 1
            rank = np.unique(rank * (int(nxt.max()) + 1) + nxt, return_inverse=True)[1]
            span *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        self.tree = WaveletTree(codes[self.suffixes - 1], alphabet)
        self.seeds = np.concatenate([[0], np.cumsum(np.bincount(self.seed))])
        first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=alphabet))])
        self.shift = first[:-1] - self.tree.descend(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def step(self, code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of code + pattern from those of the patterns."""
        both = self.tree.descend(np.concatenate([code, code]), np.concatenate([lo, hi])) + np.tile(self.shift[code], 2)
        return both[: len(code)], both[len(code) :]

    def repeats(self, codes: np.ndarray, start: np.ndarray, stop: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Streams the texts [start, stop) of codes: (text, window's first word, lo, hi) of windows that occur twice or more.

        All texts advance together. Where the last words of a window occur once only, so do all windows
        that hold them, and the text goes on behind their first word.
        """
        text, at = np.arange(len(start)), start.copy()
        while len(text):
            end = at + n - 1
            seed = self.seed[end - self.known + 1]
            lo, hi = self.seeds[seed], self.seeds[seed + 1]
            back, live = np.full(len(at), self.known - 1), np.flatnonzero(hi - lo > 1)
            for k in range(self.known, n):
                if not len(live):
                    break
                lo[live], hi[live] = self.step(codes[end[live] - k], lo[live], hi[live])
                back[live] = k
                live = live[hi[live] - lo[live] > 1]
            yield text[live], at[live], lo[live], hi[live]
            after = end - back + 1
            after[live] = at[live] + 1
            go = after + n <= stop[text]
            text, at = text[go], after[go]


class RangeLeast:
    """Least of values[lo:hi], from tables of doubling spans that are made as they are needed."""

    def __init__(self, values: np.ndarray):
        self.table = [values]

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), self.table[0].dtype)
        for k in np.unique(level).tolist():
            while len(self.table) <= k:
                last, span = self.table[-1], 1 << (len(self.table) - 1)
                self.table.append(np.minimum(last[: len(last) - span], last[span:]))
            of = level == k
            out[of] = np.minimum(self.table[k][lo[of]], self.table[k][hi[of] - (1 << k)])
        return out


def _search(n: int):
    """One shard: (k1, k2, least) of each text that several documents hold or with a window that occurs elsewhere.

    least: per window the least id of a document that has it; null where that is this text's one document.
    """
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("least", pa.list_(pa.int64()))])

    def run(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        table = table.group_by("words").aggregate([("id", "min"), ("held", "sum")])
        texts, ids = table.column("words").combine_chunks(), table.column("id_min").to_numpy()
        words = split_words(texts.cast(pa.string()))
        h = words.hashes()
        code = np.unique(h, return_inverse=True)[1] + 1
        counts = words.counts()
        start = words.bounds[:-1] + np.arange(len(counts))  # one end mark after each text
        codes = np.zeros(len(h) + len(counts), np.int64)
        codes[np.arange(len(h)) + words.doc_of()] = code
        owner = np.zeros(len(codes), np.int64)
        owner[np.arange(len(h)) + words.doc_of()] = ids[words.doc_of()]
        index = FMIndex(codes, int(code.max()) + 1, n)
        least_owner = RangeLeast(owner[index.suffixes])
        found = [[x, at - start[x], least_owner(lo, hi)] for x, at, lo, hi in index.repeats(codes, start, start + counts, n) if len(x)]
        text, at, least = (np.concatenate([np.empty(0, np.int64), *[f[i] for f in found]]) for i in range(3))
        shared = table.column("held_sum").to_numpy() > 1
        hit = np.union1d(text, np.flatnonzero(shared))
        k1, k2 = segment_keys(h, words.bounds[hit], words.bounds[hit + 1])
        width = counts[hit] - n + 1
        offset = np.concatenate([[0], np.cumsum(width)])
        flat, known = np.repeat(ids[hit], width), np.repeat(shared[hit], width)
        where = offset[np.searchsorted(hit, text)] + at
        flat[where], known[where] = least, True
        lists = pa.ListArray.from_arrays(pa.array(offset, pa.int32()), pa.array(flat, pa.int64(), mask=~known))
        return pa.table([pa.array(k1), pa.array(k2), lists], schema=schema)

    return run


# --- removal --------------------------------------------------------------------------------


def _remove(n: int, with_text: bool):
    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                words = split_words(part.column("text"))
                cover = np.zeros(len(words.start) + 1, np.int64)
                for d, (spans, copy) in enumerate(zip(part.column("windows").to_pylist(), part.column("copy").to_pylist())):
                    a, b = words.bounds[d : d + 2]
                    if copy and b - a >= n:
                        cover[a] += 1
                        cover[b] -= 1
                    elif spans:
                        at = np.asarray(spans, np.int64) + a
                        at = at[at + n <= b]
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + n, -1)
                kept = np.cumsum(cover[:-1]) == 0
                doc = words.doc_of()
                w, wd = np.flatnonzero(kept), doc[kept]
                last = np.append(wd[1:] != wd[:-1], True) if len(wd) else np.empty(0, bool)
                data, edge = words.data.copy(), np.zeros(len(words.data) + 1, np.int64)
                between = words.end[w[~last]]
                data[between] = 0x20
                edge[words.start[w]] += 1
                edge[words.end[w]] -= 1
                mask = np.cumsum(edge[:-1]) > 0
                mask[between] = True
                raw = data[mask].tobytes()
                size = np.bincount(wd, (words.end - words.start)[w] + ~last, words.n_docs).astype(np.int64)
                to = np.concatenate([[0], np.cumsum(size)])
                texts = [raw[a:b] for a, b in zip(to[:-1], to[1:])]
                counts = words.counts()
                cols = [part.column("id"), pa.array(counts, pa.int64()), pa.array(counts - np.bincount(wd, minlength=words.n_docs), pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
                names = ["id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    cols, names = [*cols, pa.array([x.decode() for x in texts], pa.string())], [*names, "kept_text"]
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def repeated_minimizers(rows: DataFrame, n: int, m: int, crowd: int, sample: int, often: int) -> DataFrame:
    """(id, plain, crowded): of each document the minimizers that repeat, apart those of crowds. Written out."""
    spark = rows.sparkSession
    every = max(1, rows.count() // sample)
    few = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).mapInArrow(_minimizers(n, m), "key long, id long, sure boolean")
    # at most sample * minimizers per document / often keys
    hot = spark.sparkContext.broadcast([r[0] for r in few.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= often).select("key").collect()])
    found = rows.mapInArrow(_minimizers(n, m, hot), "key long, id long, sure boolean")
    searched = found.where(~F.col("sure")).select("key", "id").repartition("key").sortWithinPartitions("key").mapInArrow(_repeated(crowd), "key long, id long, crowded boolean")
    sure = found.where("sure").select("key", "id", F.lit(True).alias("crowded"))
    both = searched.unionByName(sure)
    return written(both.groupBy("id").agg(F.collect_list(F.when(~F.col("crowded"), F.col("key"))).alias("plain"), F.collect_list(F.when(F.col("crowded"), F.col("key"))).alias("crowded")), "minimizers")


def remove_repeats(docs: DataFrame, n: int = 13, m: int = 5, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, shard_segments: int = 40_000, crowd: int = 4096, sample: int = 10_000, often: int = 20) -> DataFrame:
    """One row (id, n_words, n_removed, kept_sha256[, kept_text]) per row of docs.

    Words are runs of bytes other than space and \\t to \\r. Each word covered by an n-word window that
    also starts in a document with a smaller id goes; windows are judged on the input. Of documents with
    equal texts only the one with the smallest id is cut and indexed; in the others every window repeats
    it. kept_text is the kept words one space apart. Ids must be unique but for repeated equal rows. Null and empty texts have no words. Rows of one id never remove words
    from one another. A row with a null id loses nothing and causes no removal. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    named = rows.where(F.col("id").isNotNull())
    alike = named.select("id", F.xxhash64("text").alias("x1"), F.xxhash64(F.lit("text"), F.col("text")).alias("x2"))
    least = alike.groupBy("x1", "x2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    copies = written(alike.join(least, ["x1", "x2"]).where("id > least").select("id").distinct(), "copies")
    keys = repeated_minimizers(named, n, m, crowd, sample, often)
    total = keys.agg(F.coalesce(F.sum(F.size("plain") + F.size("crowded")), F.lit(0))).first()[0]
    shards = max(1, math.ceil(total / shard_segments))
    joined = named.join(keys.join(copies, "id", "left_anti"), "id").select("id", "text", "plain", "crowded")
    answers = joined.mapInArrow(_texts(n, m, shards), "shard int, words binary, id long, held long").groupBy("shard").applyInArrow(_search(n), "k1 long, k2 long, least array<long>")
    places = joined.mapInArrow(_places(n, m), "k1 long, k2 long, id long, first int")
    hit = places.join(answers, ["k1", "k2"]).select("id", F.filter(F.transform("least", lambda x, i: F.when(x < F.col("id"), F.col("first") + i)), lambda x: x.isNotNull()).alias("at"))
    gone = hit.where(F.size("at") > 0).groupBy("id").agg(F.flatten(F.collect_list("at")).alias("windows"))
    gone = gone.select("id", "windows", F.lit(False).alias("copy")).unionByName(copies.select("id", F.lit(None).cast("array<int>").alias("windows"), F.lit(True).alias("copy")))
    full = named.join(gone, "id", "left").select("id", "text", "windows", "copy")
    alone = rows.where(F.col("id").isNull()).withColumn("windows", F.lit(None).cast("array<int>")).withColumn("copy", F.lit(None).cast("boolean"))
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    # the rows are united behind the scan, so that all three joins of the texts share one exchange
    return full.mapInArrow(_remove(n, with_text), schema).unionByName(alone.mapInArrow(_remove(n, with_text), schema)).withColumnRenamed("id", id_col)


def op1(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, with_text=False)


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 12], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS first FROM x GROUP BY g),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM x JOIN f USING (g) WHERE first < doc_id),
s AS (SELECT doc_id, list(p) AS p FROM r GROUP BY doc_id),
k AS (SELECT d.doc_id, w, u.i AS i, w[u.i] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
t AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.i) AS t FROM k LEFT JOIN r ON r.doc_id = k.doc_id AND r.p = k.i WHERE r.p IS NULL GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(s.p), 0) AS BIGINT) AS n_removed, sha256(coalesce(t.t, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN t USING (doc_id)
"""
