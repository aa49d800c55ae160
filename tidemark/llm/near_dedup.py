"""MinHash near-duplicate removal with SetSketch registers.

Each text's set of distinct word shingles gets a SetSketch: m registers, each the exponentially spaced,
truncated minimum floor(1 - log_b(min of Exp(a) hashes)). Registers are mergeable by maximum and
locality-sensitive: equal with a probability close to the Jaccard similarity. Bands of registers make
buckets; of two texts in a bucket the similarity is estimated jointly by maximum likelihood from the
counts of greater, smaller and equal registers and the known set sizes; what is not unlikely to reach
the threshold is verified on the full shingle sets.

Groups of any size go through without their pairs being listed:

1. Texts of equal sets form a class; only its smallest id goes on.
2. Each bucket member is paired with the bucket's smallest id, its hub (found by a map-side aggregate);
   likely pairs are verified, and components are formed.
3. Buckets whose other members still lie in several components are searched within a task: an inverted
   index over the members' shingles gives the exact intersections of each member outside the largest
   component with all others, and only a spanning forest of links between different components is
   emitted. A bucket with over `block` shingles is dealt as pairs of blocks to several tasks. Buckets with
   the same members are searched once.

So every pair of texts that shares a bucket is decided: by its hub, by a component it is in, or exactly.
Two texts at the threshold miss every bucket with a probability under 1e-6 at 0.85 and 1e-4 at 0.8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise
from .tokens import chunks, gram_hashes, mix, split_words

SHINGLE = 5
BANDS, ROWS = 24, 5
M = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65535
_RNG = np.random.default_rng(20240501)
_MUL = _RNG.integers(1, 1 << 31, M, np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, M, np.uint32)
SIG = "id long, n_shingles long, digest binary, bands array<long>, sketch binary"


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, none has none."""
    words = split_words(texts, fold=True)
    h = words.hashes()
    grams = gram_hashes(h, SHINGLE)
    out = []
    for a, b in zip(words.bounds[:-1], words.bounds[1:]):
        n = b - a
        out.append(np.unique(grams[a : b - SHINGLE + 1]) if n >= SHINGLE else gram_hashes(h[a:b], n) if n else np.empty(0, np.uint64))
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The registers of a set that is not empty."""
    h, low = (shingles >> np.uint64(32)).astype(np.uint32), np.full(M, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 4096):
        np.minimum(low, (h[i : i + 4096] * _MUL[:, None] + _ADD[:, None]).min(axis=1), out=low)
    x = -np.log1p(-(low.astype(float) + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band, the band's number included."""
    r = registers.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + r[:, j])
    return key.view(np.int64)


def likely(d_less: np.ndarray, d_more: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, threshold: float, slack: float = 20.0) -> np.ndarray:
    """Whether the joint likelihood of sets of n_u and n_v elements leaves a similarity >= threshold open.

    d_less, d_more: how many registers are smaller and greater in the first sketch. False if the sizes
    alone rule the threshold out, or if twice the log-likelihood at the threshold is more than `slack`
    below its maximum.
    """
    n_u, n_v = np.asarray(n_u, float), np.asarray(n_v, float)
    u, v = (n_u / (n_u + n_v))[:, None], (n_v / (n_u + n_v))[:, None]
    most = np.minimum(n_u, n_v) / np.maximum(n_u, n_v)
    same = M - d_less - d_more
    p = lambda x: np.maximum(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12)

    def log_likelihood(j):
        more, less = p(u - v * j), p(v - u * j)
        return d_more[:, None] * np.log(more) + d_less[:, None] * np.log(less) + same[:, None] * np.log(np.maximum(1 - more - less, 1e-12))

    grid = np.linspace(0, 1, 41)[None, :] * most[:, None]
    at = log_likelihood(grid)
    best = at.max(axis=1)
    above = np.where(grid >= threshold, at, -np.inf).max(axis=1)
    edge = log_likelihood(np.minimum(threshold, most)[:, None])[:, 0]
    return (most >= threshold - 1e-12) & (2 * (best - np.maximum(above, edge)) <= slack)


def _sign(batches):
    for batch in batches:
        for part in chunks(batch, "text"):
            sets = shingle_sets(part.column("text"))
            ids = part.column("id").to_pylist()
            full = [len(s) > 0 and i is not None for s, i in zip(sets, ids)]
            regs = [sketch(s) if ok else None for s, ok in zip(sets, full)]
            yield pa.RecordBatch.from_arrays([
                part.column("id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if ok else None for s, ok in zip(sets, full)], pa.binary()),
                pa.array([band_keys(r) if ok else None for r, ok in zip(regs, full)], pa.list_(pa.int64())),
                pa.array([r.tobytes() if ok else None for r, ok in zip(regs, full)], pa.binary())], names=["id", "n_shingles", "digest", "bands", "sketch"])


def _verify(percent: int):
    def verify(batches):
        last: tuple = (None, None)
        for batch in batches:
            linked = []
            for b, ta, tb in zip(batch.column("b").to_pylist(), batch.column("ta"), batch.column("tb")):
                one = shingle_sets(pa.array([ta.as_py()], pa.string()))[0]
                if last[0] != (b, tb):
                    last = ((b, tb), shingle_sets(pa.array([tb.as_py()], pa.string()))[0])
                both = len(np.intersect1d(one, last[1], assume_unique=True))
                linked.append(both > 0 and 100 * both >= percent * (len(one) + len(last[1]) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])
    return verify


def _screen(threshold: float):
    """Keeps pairs (a, b) whose sketches leave the threshold open."""
    def screen(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            s = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("sa", "sb")]
            ok = likely((s[0] < s[1]).sum(1), (s[0] > s[1]).sum(1), batch.column("na").to_numpy(), batch.column("nb").to_numpy(), threshold)
            yield batch.select(["a", "b"]).filter(pa.array(ok))
    return screen


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _links_in(rows: list[dict], percent: int, split: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between different components of a bucket, or between two blocks of it."""
    sets = shingle_sets(pa.array([r["text"] for r in rows], pa.string()))
    rep, side = (np.array([r[c] for r in rows], np.int64) for c in ("rep", "side"))
    label = np.unique([r["label"] for r in rows], return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    start = np.concatenate([[0], np.cumsum(size)])
    term = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(term, kind="stable")
    holder = np.repeat(np.arange(len(rows)), size)[order]
    at = np.concatenate([[0], np.cumsum(np.bincount(term))])
    parent = np.unique(label, return_index=True)[1][label]
    out = []
    for i in np.flatnonzero(label != np.bincount(label).argmax()).tolist():
        own = term[start[i] : start[i + 1]]
        n = at[own + 1] - at[own]
        shared = np.bincount(holder[np.repeat(at[own] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(rows))
        ok = (100 * shared >= percent * (size[i] + size - shared)) & (label != label[i])
        if split:
            ok &= side != side[i]
        for k in np.flatnonzero(ok).tolist():
            x, y = _find(parent, i), _find(parent, k)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(max(rep[i], rep[k])), int(min(rep[i], rep[k]))))
    return out


def _search(percent: int):
    """Over rows sorted by (key, lo, hi): the links of each bucket or pair of its blocks."""
    def search(batches):
        held, at = [], None

        def flush():
            return _links_in(held, percent, at[1] != at[2]) if len(held) > 1 else []

        def batch_of(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            found = []
            for part in chunks(batch, "text"):
                for row in part.to_pylist():
                    if (key := (row["key"], row["lo"], row["hi"])) != at:
                        found += flush()
                        held, at = [], key
                    held.append(row)
            yield batch_of(found)
        yield batch_of(flush())
    return search


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", block: int = 1 << 20) -> DataFrame:
    """One row (id, n_shingles, component_id) per row of docs.

    Linked are texts of which 100 * |intersection| >= percent * |union| holds for the sets of distinct
    5-word shingles (A-Z lower-cased; fewer words: the whole sequence). component_id is the smallest id
    reachable, the own one included. Null and wordless texts are linked with nothing. Rows with a null id
    are linked with nothing and have a null component. Repeated rows each keep a row, in one component.
    Other columns are not read.
    """
    threshold = percent / 100
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialise(rows.mapInArrow(_sign, SIG))
    classes = signed.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("id").alias("rep"))
    reps = signed.join(classes.withColumnRenamed("rep", "id"), ["digest", "id"], "left_semi").dropDuplicates(["id", "digest"])
    reps = materialise(reps.select(F.col("id").alias("rep"), F.col("n_shingles").alias("n"), "bands", "sketch"))
    bands = reps.select("rep", F.explode("bands").alias("key"))
    hubs = bands.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub < top").drop("top")
    members = materialise(bands.join(hubs, "key"))
    wanted = members.select(F.col("rep").alias("id")).distinct()
    texts = materialise(rows.join(wanted, "id", "left_semi"))
    sizes = reps.select("rep", "n")
    sketches = materialise(reps.join(wanted.withColumnRenamed("id", "rep"), "rep", "left_semi").drop("bands"))

    def verified(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        full = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
        checked = full.mapInArrow(_verify(percent), "a long, b long, linked boolean")
        return materialise(checked.groupBy("a", "b").agg(F.max("linked").alias("linked")))

    stars = members.where("rep != hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    side = lambda c: sketches.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    stars = materialise(stars.join(side("a"), "a").join(side("b"), "b").mapInArrow(_screen(threshold), "a long, b long"))
    tested = verified(stars)
    labels = components(tested.where("linked"))
    marked = members.where("rep != hub").select("key", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    marked = marked.join(sizes, "rep")
    open_ = marked.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("mark")).where("lo < hi")
    open_ = open_.groupBy("mark", "total", "m").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("total") / F.lit(block)).cast("int").alias("parts"))
    spread = marked.join(open_, "key").withColumn("side", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.select("key", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "rep", "label", "side")
    full = spread.join(texts.withColumnRenamed("id", "rep"), "rep").select("key", "lo", "hi", "rep", "label", "side", "text")
    more = full.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_search(percent), "a long, b long")
    labels = components(tested.where("linked").select("a", "b").unionByName(more))
    class_of = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("component"))
    return signed.select("id", "n_shingles", "digest").join(class_of, "digest", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))


def keep(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """docs, all columns, with one document of each component: that with the smallest id.

    If there are null or repeated ids, each (id, text) is numbered, in the order of the ids, and the numbers
    stand for ids: so rows of one id with different texts are documents of their own, and of equal ones
    one stays. Rows with a null id are compared with one another, not with those that have an id.
    """
    often = docs.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL")
    if often.isEmpty():
        gone = near_duplicates(docs, percent, id_col, text_col, **rule).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct()
        return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
    own = F.xxhash64(F.col(text_col).isNull(), F.col(text_col))
    numbers = docs.select(F.col(id_col).alias("__id"), own.alias("__key")).distinct().orderBy(F.col("__id").asc_nulls_last(), "__key")
    numbers = materialise(numbers.withColumn("__n", F.monotonically_increasing_id()))
    rows = docs.join(numbers, F.col(id_col).eqNullSafe(F.col("__id")) & (own == F.col("__key")))
    heads = None
    for part in (rows.where(F.col(id_col).isNotNull()), rows.where(F.col(id_col).isNull())):
        found = near_duplicates(part, percent, "__n", text_col, **rule).where(F.col("__n") == F.col("component_id")).select("__n")
        heads = found if heads is None else heads.unionByName(found)
    kept = rows.join(heads.distinct(), "__n", "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # of rows that differ in other columns alone, the least by its JSON text, since maps have no order
    return kept.groupBy("__n").agg(F.min_by(row, F.to_json(row)).alias("__m")).select("__m.*")


def op8(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct([array_to_string(w[i : i + least(5, len(w)) - 1], ' ') for i in range(1, len(w) - least(5, len(w)) + 2)]) AS s FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM x AS a JOIN x AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
r AS (SELECT doc_id, doc_id AS seen FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen),
m AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id, coalesce(m.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
