"""Merkle manifest of a dataset with proofs by pointer jumping.

The leaves of each source stand in order of id; every `fan` consecutive nodes of a level become their hash until one is
left, the source's subroot; the subroots, in order of source, become the root the same way. Numbers come from a range
partition, so that a source with a third of all rows is no task of its own; every later group holds `fan` nodes at most.

A proof is the list of siblings from the leaf to the root. The nodes of a run share it but for their own place, so a run
holds the segment of all: its digests, and its parent's place in the next run. At first each segment reaches the next run;
a self-join along the pointers doubles the distance and appends the segment found there, until every run reaches the
root: log2 of the depth joins. In the round over distance d at most fan^d runs meet at one ancestor. Leaves join the path of
their run last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered, parts, place, ranged, with_parts
from .common import ascii_lower, materialise

FAN = 16
TOP = -1  # the tree over the subroots
BROADCAST = 16 << 20  # bytes of ancestors' segments that are broadcast


def leaf(*fields: Column) -> Column:
    """Hash of a record: each field as its UTF-8 bytes' count, a colon and the value; a dash for null."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]), 256)


def _levels(n: int, fan: int) -> int:
    """Levels of runs above n nodes."""
    k = 0
    while n > 1:
        n, k = -(-n // fan), k + 1
    return k


def _runs(nodes: DataFrame, most: int, fan: int) -> list[DataFrame]:
    """Runs (tree, level, i, kids, digest, n) of each level above nodes (tree, i, digest, n); n: nodes of the level in the tree, most: the largest."""
    out = []
    for level in range(1, _levels(most, fan) + 1):
        kids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "digest"))), lambda x: x["digest"]), "")
        runs = nodes.where("n > 1").groupBy("tree", F.expr(f"i div {fan}").alias("i")).agg(kids.alias("kids"), F.max("n").alias("n"))
        nodes = materialise(runs.select("tree", F.lit(level).alias("level"), "i", "kids", F.sha2("kids", 256).alias("digest"), F.ceil(F.col("n") / fan).alias("n")))
        out.append(nodes)
    return out


def _jump(runs: DataFrame, depth: int, fan: int) -> DataFrame:
    """Runs (tree, level, i, path) with the path of each to the root, from runs with segments to the next one."""
    distance = 1
    while distance < depth:
        above = runs.where((F.col("tree") == TOP) | (F.col("level") > distance)).select(
            F.col("tree").alias("to_tree"), F.col("level").alias("to_level"), F.col("i").alias("to_i"), F.col("path").alias("rest"), F.col("to_tree").alias("a"), F.col("to_level").alias("b"), F.col("to_i").alias("c"))
        if above.count() * distance * (64 * fan + 100) <= BROADCAST:
            above = F.broadcast(above)
        on = runs.where("to_tree IS NOT NULL").join(above, ["to_tree", "to_level", "to_i"])
        on = on.select("tree", "level", "i", F.concat("path", "rest").alias("path"), F.col("a").alias("to_tree"), F.col("b").alias("to_level"), F.col("c").alias("to_i"))
        runs = materialise(on.unionByName(runs.where("to_tree IS NULL")))
        distance *= 2
    return runs.select("tree", "level", "i", "path")


def proofs(records: DataFrame, id_col: str = "id", source_col: str = "source", leaf_col: str = "leaf", fan: int = FAN) -> DataFrame:
    """Adds subroot, root, slot and path to each record: what proves its leaf.

    path is an array of runs (kids: the hex digests of the run, joined; slot: place of the run's parent in the next one),
    slot the leaf's own place in the first. A leaf that is the root has an empty path. Null is a source, the first; null ids
    are first in theirs; records of one id stand by leaf. An empty table gives no rows. Further columns stay.
    """
    rows = ranged(records, [source_col], [F.col(f"`{id_col}`").asc_nulls_first(), F.col(f"`{leaf_col}`")])
    cells = materialise(parts(rows, [source_col]))
    sources = numbered(cells.groupBy(F.col(f"`{source_col}`").alias("s__")).agg(F.first("total__").alias("size__")), [], [F.col("s__").asc_nulls_first()], "tree__")
    n_sources, most = sources.agg(F.count(F.lit(1)), F.coalesce(F.max("size__"), F.lit(0))).first()
    cells = cells.join(sources, F.col(f"`{source_col}`").eqNullSafe(F.col("s__"))).drop("s__", "size__")
    rows_in = lambda c: with_parts(rows, c, [source_col]).withColumn("pos__", place()).drop("at__", "part__", "first__", "before__")

    nodes = rows_in(cells).select(F.col("tree__").alias("tree"), F.col("pos__").alias("i"), F.col(f"`{leaf_col}`").alias("digest"), F.col("total__").alias("n"))
    trees = _runs(nodes, most, fan)
    subroots = nodes.where("n = 1").select("tree", "digest")
    for runs in trees:
        subroots = subroots.unionByName(runs.where("n = 1").select("tree", "digest"))
    subroots = materialise(subroots)
    top = _runs(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("i"), "digest", F.lit(n_sources).alias("n")), n_sources, fan)
    last = (top[-1] if top else subroots).select("digest").first()  # one digest

    ends, over = F.col("n") == 1, (F.col("tree") >= 0) & F.lit(n_sources > 1)
    up = lambda inner, outer: F.when(~ends, inner).when(over, outer)
    segments = None
    for runs in [*trees, *top]:
        s = runs.select("tree", "level", "i", F.array(F.struct("kids", up(F.col("i"), F.col("tree")).alias("slot"))).alias("path"),
                        up(F.col("tree"), F.lit(TOP)).cast("long").alias("to_tree"), up(F.col("level") + 1, F.lit(1)).alias("to_level"), up(F.expr(f"i div {fan}"), F.expr(f"tree div {fan}")).alias("to_i"))
        s = s.withColumn("path", F.transform("path", lambda x: F.struct(x["kids"].alias("kids"), F.pmod(x["slot"], F.lit(fan)).cast("int").alias("slot"))))
        segments = s if segments is None else segments.unionByName(s)

    cells = cells.join(subroots.select(F.col("tree").alias("tree__"), F.col("digest").alias("subroot")), "tree__")
    alone = F.col("total__") == 1
    leaves = rows_in(cells).withColumn("slot", F.pmod(F.when(alone, F.col("tree__")).otherwise(F.col("pos__")), F.lit(fan)).cast("int")).withColumn("root", F.lit(last[0] if last else None))
    leaves = leaves.withColumn("run__", F.when(alone, F.expr(f"tree__ div {fan}")).otherwise(F.expr(f"pos__ div {fan}"))).withColumn("tree__", F.when(alone, F.lit(TOP)).otherwise(F.col("tree__")))
    none = F.expr("cast(array() as array<struct<kids:string,slot:int>>)")
    if segments is None:
        out = leaves.withColumn("path", none)
    else:
        paths = _jump(segments, len(trees) + len(top), fan).where("level = 1").select(F.col("tree").alias("tree__"), F.col("i").alias("run__"), "path")
        out = leaves.join(paths, ["tree__", "run__"], "left").withColumn("path", F.coalesce("path", none))
    return out.select(*[F.col(f"`{c}`") for c in records.columns], "subroot", "root", "slot", "path")


def folded(digest: Column, slot: Column, path: Column) -> Column:
    """(root, siblings): the root recomputed from a leaf's digest along its path, and all siblings' digests joined."""
    start = F.struct(digest.alias("root"), F.lit("").alias("siblings"), slot.alias("slot"))

    def step(acc: Column, run: Column) -> Column:
        before = F.substring(run["kids"], F.lit(1), acc["slot"] * 64)
        after = F.substring(run["kids"], acc["slot"] * 64 + 65, F.length(run["kids"]))
        return F.struct(F.sha2(F.concat(before, acc["root"], after), 256).alias("root"), F.concat(acc["siblings"], before, after).alias("siblings"), run["slot"].alias("slot"))

    return F.aggregate(path, start, step, lambda acc: F.struct(acc["root"].alias("root"), acc["siblings"].alias("siblings")))


def op13(docs: DataFrame) -> DataFrame:
    """Each document a leaf; every fifth by id hash is tampered with, and all are folded to the root."""
    of = lambda text: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    picked = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    records = docs.select("doc_id", "source", of(F.col("text")).alias("leaf"), F.when(picked, of(ascii_lower(F.col("text")))).alias("tampered"))
    back = folded(F.coalesce("tampered", "leaf"), F.col("slot"), F.col("path"))
    out = proofs(records, "doc_id").withColumn("back", back)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("back")["siblings"], 256).alias("proof_sha256"), F.col("back")["root"].alias("folded_root"), (F.col("back")["root"] == F.col("root")).alias("verified"))


#: CRC-32 of a decimal string s, bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST(ascii(substr({s}, CAST(i AS INT), 1)) AS BIGINT) for i in range(1, len({s}) + 1)]),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"""
_ENC = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_ENC.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {text})"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FOLD = """SELECT f.doc_id, f.tree, f.own, f.level + 1, f.i // 16, sha256(substr(r.kids, 1, CAST(f.i % 16 * 64 AS INT)) || f.digest || substr(r.kids, CAST(f.i % 16 * 64 + 65 AS INT))),
    f.siblings || substr(r.kids, 1, CAST(f.i % 16 * 64 AS INT)) || substr(r.kids, CAST(f.i % 16 * 64 + 65 AS INT))
  FROM {0} f JOIN {1} r ON r.tree = f.tree AND r.level = f.level AND r.run = f.i // 16"""
_GROW = "SELECT tree, level + 1, i // 16, sha256(string_agg(digest, '' ORDER BY i)), (max(n) + 15) // 16 FROM {0} WHERE n > 1 GROUP BY tree, level, i // 16"
_RUNS = "SELECT tree, level, i // 16 AS run, string_agg(digest, '' ORDER BY i) AS kids FROM {0} WHERE n > 1 GROUP BY ALL"
OP13_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_LEAF.format(text=_ENC.format('text'))} AS leaf,
  CASE WHEN {CRC32.format(s='CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {_LEAF.format(text=_ENC.format(_LOWER))} END AS tampered FROM documents),
s AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree FROM d GROUP BY source),
l AS (SELECT d.*, s.tree, s.n, row_number() OVER (PARTITION BY s.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
g AS (SELECT tree, 0 AS level, i, leaf AS digest, n FROM l UNION ALL {_GROW.format('g')}),
b AS (SELECT tree, digest FROM g WHERE n = 1),
t AS (SELECT -1::BIGINT AS tree, 0 AS level, tree AS i, digest, (SELECT count(*) FROM s) AS n FROM b UNION ALL {_GROW.format('t')}),
ru AS ({_RUNS.format('g')}), tu AS ({_RUNS.format('t')}),
f AS (SELECT doc_id, tree, tree AS own, 0 AS level, i, coalesce(tampered, leaf) AS digest, '' AS siblings FROM l UNION ALL {_FOLD.format('f', 'ru')}),
m AS (SELECT DISTINCT ON (doc_id) doc_id, own, digest, siblings FROM f ORDER BY doc_id, level DESC),
h AS (SELECT doc_id, -1::BIGINT AS tree, own, 0 AS level, own AS i, digest, siblings FROM m UNION ALL {_FOLD.format('h', 'tu')}),
z AS (SELECT DISTINCT ON (doc_id) doc_id, digest, siblings FROM h ORDER BY doc_id, level DESC),
o AS (SELECT digest AS root FROM t WHERE n = 1)
SELECT l.doc_id, l.leaf, b.digest AS subroot, o.root, sha256(z.siblings) AS proof_sha256, z.digest AS folded_root, z.digest = o.root AS verified
FROM l JOIN z USING (doc_id) JOIN b ON b.tree = l.tree, o
"""
