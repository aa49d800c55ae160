"""Prefix trie of conversations by the Euler-tour technique.

Nodes are the distinct sequences of first turns. A prefix is known by its length and by running sums of hashes of its
(position, turn) pairs, 128 bits; sums run over chunks of a conversation and are carried on, so that no conversation is
gathered. A node is named by its smallest member and its depth, which no other node shares.

Each node has an arc that enters it and one that leaves it; the arc after entering is the first child's or the own exit,
the arc after leaving the next sibling's or the parent's exit. The list of arcs is ranked without following it from its
head: hashing picks every eighth arc or so as a splitter, every other arc jumps backwards, doubling its distance, until it
stands on a splitter; the list of splitters is ranked the same way until WALK of them are left, which one task walks
through. Prefix sums at the ranks then give each subtree's leaves and savings as differences between exit and entry.

Children of one parent may be a third of all nodes: they are numbered by range partition, and parents with more than a
thousandth of all nodes, a thousand of them at most, are broadcast to their children.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import numbered, parts, place, ranged, with_parts
from .common import materialise, text_or_empty
from .merkle import CRC32

CHUNK = 4096  # turns of a conversation, or ids of a list, that are one row's or window's work
SPLIT = 8
WALK = 65536


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns (id, digest, chars, ...) in order, and their parts: see operators.order.

    Turns stand by number, null first, and with one number by SHA-256 of role and text. Null roles and texts are empty.
    Repeated rows are turns of their own. Rows with a null conversation id are dropped. Ids must be integers.
    """
    role, text = text_or_empty(F.col(f"`{role_col}`")), text_or_empty(F.col(f"`{text_col}`"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("id"), F.col(f"`{turn_col}`").alias("turn"), F.unhex(digest).alias("digest"), F.length(text).cast("long").alias("chars"))
    rows = ranged(turns, ["id"], [F.col("turn").asc_nulls_first(), F.col("digest")])
    return rows, materialise(parts(rows, ["id"]))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, convs): every conversation c with the first h turns of c - c % 100 before its own turns after its first h.

    h is the CRC-32 of the decimal id, modulo 6. turns: (id, depth from 1, digest, chars, size); convs: (id, size), those
    without turns too. A conversation lends its first turns to 199 others at most.
    """
    rows, cells = ordered_turns(conversations)
    convs = cells.groupBy("id").agg(F.first("total__").alias("own")).withColumn("h", F.crc32(F.col("id").cast("string")) % 6).withColumn("base", F.col("id") - F.col("id") % 100)
    lenders = convs.select(F.col("id").alias("base"), F.col("own").alias("lent"))
    convs = convs.join(lenders, "base", "left").withColumn("lent", F.least("h", F.coalesce("lent", F.lit(0))))
    convs = materialise(convs.withColumn("size", F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    own = with_parts(rows, cells.join(convs.drop("own", "base"), "id"), ["id"]).withColumn("pos", place()).where("pos >= h")
    own = own.select("id", (F.col("pos") - F.col("h") + F.col("lent") + 1).alias("depth"), "digest", "chars", "size")
    heads = with_parts(rows.where("id % 100 = 0"), cells, ["id"]).withColumn("pos", place()).where("pos < 5").select(F.col("id").alias("base"), "pos", "digest", "chars")
    lent = heads.join(convs.where("h > 0"), "base").where("pos < h").select("id", (F.col("pos") + 1).alias("depth"), "digest", "chars", "size")
    return own.unionByName(lent), convs.select("id", "size")


def fingerprints(turns: DataFrame) -> DataFrame:
    """Adds (a, b), which stand for the first `depth` turns, and (pa, pb) for those before; turns: (id, depth, digest, ...)."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    hashes = [F.xxhash64(F.lit(i), "depth", "digest") for i in (1, 2)]
    lanes = {f"l{j}": (h if j % 2 else F.shiftrightunsigned(h, 32)).bitwiseAND(mask) for h, js in zip(hashes, ((0, 1), (2, 3))) for j in js}
    rows = turns.withColumns({**lanes, "chunk": F.expr(f"(depth - 1) div {CHUNK}")})
    upto = Window.partitionBy("id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("id", "chunk").agg(*[F.sum(n).alias(n) for n in lanes]).select("id", "chunk", *[F.sum(n).over(before).alias(f"c{n}") for n in lanes]).where("chunk > 0")
    rows = rows.withColumns({f"s{n}": F.sum(n).over(upto) for n in lanes}).join(carried, ["id", "chunk"], "left")
    rows = rows.withColumns({f"s{n}": F.col(f"s{n}") + F.coalesce(f"c{n}", F.lit(0)) for n in lanes})
    pair = lambda f: {o: F.shiftleft(f(x).bitwiseAND(mask), 32).bitwiseOR(f(y).bitwiseAND(mask)) for o, x, y in (("a", "l0", "l1"), ("b", "l2", "l3"))}
    rows = rows.withColumns(pair(lambda n: F.col(f"s{n}")) | {f"p{o}": c for o, c in pair(lambda n: F.col(f"s{n}") - F.col(n)).items()})
    return rows.drop("chunk", *lanes, *[f"s{n}" for n in lanes], *[f"c{n}" for n in lanes])


def trie(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends). nodes: (conv, depth, a, b, parent, n_convs, n_children, chars), the root at depth 0 included; ends: (depth, a, b, id), where each conversation ends.

    turns: (id, depth from 1, digest, chars, size), depths of an id without gaps; convs: (id, size), all conversations. No
    conversations give no nodes.
    """
    rows = materialise(fingerprints(turns).select("id", "depth", "a", "b", "pa", "pb", "chars", (F.col("depth") == F.col("size")).alias("last")))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("id").alias("conv")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("a"), zero.alias("b"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), "n_convs", "conv", zero.alias("chars"))
    nodes = rows.groupBy("depth", "a", "b").agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.count(F.lit(1)).alias("n_convs"), F.min("id").alias("conv"), F.max("chars").alias("chars"))
    nodes = materialise(nodes.unionByName(root))
    born = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialise(nodes.join(born, ["depth", "a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    crowded = nodes.count() / 1000
    parents = nodes.where("n_children > 0").select(F.col("depth").alias("pd"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent"), (F.col("n_children") > crowded).alias("hot"))
    kids = nodes.withColumn("pd", F.col("depth") - 1).join(F.broadcast(parents.where("hot").drop("hot")), ["pd", "pa", "pb"], "left")
    rest = kids.where("parent IS NULL AND depth > 0").drop("parent").join(parents.where("NOT hot").drop("hot"), ["pd", "pa", "pb"])
    nodes = kids.where("parent IS NOT NULL OR depth = 0").unionByName(rest).select("conv", "depth", "a", "b", "parent", "n_convs", "n_children", "chars")
    ends = rows.where("last").select("depth", "a", "b", "id").unionByName(convs.where("size = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "id"))
    return nodes, ends


def tour(nodes: DataFrame) -> DataFrame:
    """Arcs (c, k, pc, pk) with the arc before each: c is the node's conv, k twice its depth, plus one for the exit; children in order of conv."""
    kids = materialise(numbered(nodes.select("conv", "depth", "parent", "n_children"), ["parent", "depth"], [F.col("conv")], "j"))
    first = kids.where("j = 0 AND depth > 0").select(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth"), F.col("conv").alias("child"))
    after = kids.where("j > 0").select("parent", "depth", (F.col("j") - 1).alias("j"), F.col("conv").alias("sibling"))
    enter, leave = F.col("depth") * 2, F.col("depth") * 2 + 1
    down = kids.join(first, ["conv", "depth"], "left").select(
        F.coalesce("child", "conv").alias("c"), F.when(F.col("child").isNotNull(), enter + 2).otherwise(leave).alias("k"), F.col("conv").alias("pc"), enter.alias("pk"))
    up = kids.where("depth > 0").join(after, ["parent", "depth", "j"], "left").select(
        F.coalesce("sibling", "parent").alias("c"), F.when(F.col("sibling").isNotNull(), enter).otherwise(leave - 2).alias("k"), F.col("conv").alias("pc"), leave.alias("pk"))
    head = kids.where("depth = 0").select(F.col("conv").alias("c"), enter.alias("k"), F.lit(None).cast("long").alias("pc"), F.lit(None).cast("long").alias("pk"))
    return down.unionByName(up).unionByName(head)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks of a short list, followed from its head."""
    after, at = {}, None
    for batch in batches:
        for c, k, pc, pk, w in zip(*[x.to_pylist() for x in batch.columns]):
            if pc is None:
                at = c, k
            else:
                after[pc, pk] = c, k, w
    rank, out = 0, []
    while at:
        out.append((*at, rank))
        c, k, w = after.get(at, (None, None, 0))
        at, rank = (c, k) if c is not None else None, rank + w
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["c", "k", "rank"])


def list_rank(links: DataFrame, walk: int = WALK, level: int = 0) -> DataFrame:
    """(c, k, rank) of one linked list: (c, k) names an element, (pc, pk) the one before it, null for the head, w its distance (1 if absent).

    Joins are one to one but for the last, where the elements up to the next splitter, some dozens, meet it.
    """
    if "w" not in links.columns:
        links = links.withColumn("w", F.lit(1).cast("long"))
    links = materialise(links.select("c", "k", "pc", "pk", "w"))
    splits = lambda c, k: F.pmod(F.xxhash64(F.lit(level), c, k), F.lit(SPLIT)) == 0
    links = links.withColumn("stop", F.col("pc").isNull() | splits("c", "k"))
    heads = links.where("pc IS NULL").select(F.col("c").alias("hc"), F.col("k").alias("hk")).limit(1)
    on_head = (F.col("pc") == F.col("hc")) & (F.col("pk") == F.col("hk"))
    links = materialise(links.join(F.broadcast(heads), F.lit(True), "left").withColumn("there", F.coalesce(on_head | splits("pc", "pk"), F.lit(False))).drop("hc", "hk"))
    rows = links.where("NOT stop").drop("stop")
    while not rows.where("NOT there").isEmpty():
        ahead = rows.select(F.col("c").alias("pc"), F.col("k").alias("pk"), F.col("pc").alias("qc"), F.col("pk").alias("qk"), F.col("w").alias("v"), F.col("there").alias("arrived"))
        jumped = rows.where("NOT there").join(ahead, ["pc", "pk"]).select("c", "k", F.col("qc").alias("pc"), F.col("qk").alias("pk"), (F.col("w") + F.col("v")).alias("w"), F.col("arrived").alias("there"))
        rows = materialise(rows.where("there").unionByName(jumped))
    ahead = rows.select(F.col("c").alias("pc"), F.col("k").alias("pk"), F.col("pc").alias("qc"), F.col("pk").alias("qk"), F.col("w").alias("v"))
    short = materialise(links.where("stop").join(ahead, ["pc", "pk"], "left").select("c", "k", F.coalesce("qc", "pc").alias("pc"), F.coalesce("qk", "pk").alias("pk"), (F.col("w") + F.coalesce("v", F.lit(0))).alias("w")))
    if short.count() <= walk:
        ranks = materialise(short.coalesce(1).mapInArrow(_walked, "c long, k long, rank long"))
    else:
        ranks = list_rank(short, walk, level + 1)
    reached = ranks.select(F.col("c").alias("pc"), F.col("k").alias("pk"), "rank")
    return ranks.unionByName(rows.join(reached, ["pc", "pk"]).select("c", "k", (F.col("rank") + F.col("w")).alias("rank")))


def subtrees(nodes: DataFrame, walk: int = WALK) -> DataFrame:
    """(conv, depth, n_leaves, saved): of each node's subtree, its top included, the childless nodes and the sum of (n_convs - 1) * chars."""
    own = nodes.select(F.col("conv").alias("c"), (F.col("depth") * 2).alias("k"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("save"))
    arcs = list_rank(tour(nodes), walk).join(own, ["c", "k"], "left").select("c", "k", "rank", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("save", F.lit(0)).alias("save"), F.expr(f"rank div {CHUNK}").alias("chunk"))
    arcs = materialise(arcs)
    upto = Window.partitionBy("chunk").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row per CHUNK arcs
    sums = arcs.groupBy("chunk").agg(F.sum("leaf").alias("leaves"), F.sum("save").alias("saves"))
    sums = sums.select("chunk", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("leaves", "saves")])
    at = arcs.withColumns({"l": F.sum("leaf").over(upto), "s": F.sum("save").over(upto)}).join(sums, "chunk")
    sign = F.when(F.col("k") % 2 == 1, 1).otherwise(-1)
    span = lambda run, carry, one: F.sum(sign * (F.col(run) + F.col(carry)) + F.col(one))
    return at.groupBy(F.col("c").alias("conv"), F.shiftright("k", 1).alias("depth")).agg(span("l", "leaves", "leaf").alias("n_leaves"), span("s", "saves", "save").alias("saved"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of lists that come in order as runs of ids; what is held is one hash."""
    key, state = None, None
    for batch in batches:
        out = []
        for *of, text in zip(*[x.to_pylist() for x in batch.columns]):
            if of != key:
                if state:
                    out.append((*key, state.hexdigest()))
                key, state = of, hashlib.sha256(text.encode())
            else:
                state.update(("," + text).encode())
        if out:
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in list(zip(*out))[:3]], pa.array([x[3] for x in out])], ["depth", "a", "b", "sha"])
    if state:
        yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in key], pa.array([state.hexdigest()])], ["depth", "a", "b", "sha"])


def id_digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, sha): SHA-256 of the ids of each key, ascending, comma-joined.

    Ids are numbered within their key and joined in runs of CHUNK; where a key has more than one run, they stream through one
    task in order, since the hash is sequential, and are not held there.
    """
    keys = ["depth", "a", "b"]
    runs = numbered(ends, keys, [F.col("id")], "j", "n").withColumn("run", F.expr(f"j div {CHUNK}")).groupBy(*keys, "run").agg(
        F.max("n").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))
    runs = materialise(runs)
    many = runs.where(F.col("n") > CHUNK).repartition(*keys).sortWithinPartitions(*keys, "run").select(*keys, "ids")
    return runs.where(F.col("n") <= CHUNK).select(*keys, F.sha2("ids", 256).alias("sha")).unionByName(many.mapInArrow(_hashed, "depth long, a long, b long, sha string"))


def op12(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, one row per node."""
    nodes, ends = trie(*rebuilt(conversations))
    nodes = materialise(nodes)
    out = nodes.join(subtrees(nodes), ["conv", "depth"]).join(id_digests(ends), ["depth", "a", "b"], "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
                      F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


OP12_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(octet_length(encode(role)) AS VARCHAR) || ':' || role || text)) AS i, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
o AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY i) AS turns FROM t GROUP BY conv_id),
h AS (SELECT conv_id, turns, {CRC32.format(s='CAST(conv_id AS VARCHAR)')} % 6 AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN o AS b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, len(turns) AS size, unnest(range(0, len(turns) + 1)) AS depth, turns FROM r),
q AS (SELECT conv_id, size, depth, turns[1:depth] AS prefix FROM p),
n AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth), '') AS ends FROM q GROUP BY depth, prefix),
k AS (SELECT n.*, u.conv_id AS parent_conv_id, CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * length(n.prefix[n.depth].text) ELSE 0 END AS own
  FROM n LEFT JOIN n AS u ON u.depth = n.depth - 1 AND u.prefix = n.prefix[1:n.depth - 1]),
c AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM k WHERE depth > 0 GROUP BY ALL),
z AS (SELECT k.*, coalesce(c.n_children, 0) AS n_children FROM k LEFT JOIN c ON c.conv_id = k.conv_id AND c.depth = k.depth),
s AS (SELECT up.depth, up.conv_id, sum(CASE WHEN z.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(z.own) AS saved_tokens
  FROM z JOIN z AS up ON up.depth <= z.depth AND up.prefix = z.prefix[1:up.depth] GROUP BY ALL)
SELECT z.conv_id, z.depth, z.parent_conv_id, z.n_convs, z.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(z.ends) AS ends_sha256
FROM z JOIN s ON s.depth = z.depth AND s.conv_id = z.conv_id
"""
