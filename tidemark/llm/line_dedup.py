"""Fuzzy line dedup in DataFrame functions.

Lines are normalised (lower case, words one space apart). Equal normalised lines are one class. Each class
gets a 64-bit SimHash of its distinct words, so that no word repeated in a line decides the hash alone.
Classes whose SimHashes agree in two of six blocks and differ in at most 10 bits are candidates; candidates
with an edit similarity of at least 0.8 are linked, and of each connected group the first occurrence stays.

Pigeonhole: any 4 differing bits leave two of the six blocks whole, so that all pairs within 4 bits are
found; pairs of 5 to 10 bits are found as far as their bits leave two blocks whole. The join key is a
choice of two blocks with their values, 15 keys of about 21 bits for each SimHash. The difference in bits is
tested in the join.

Hubs: before all pairs are looked for, each class is compared with the least class of those of its three keys of
disjoint blocks that over `crowd` classes have. Classes of one component of over `crowd` classes are then not
paired again, so that a crowd of near copies yields links in proportion to its size.

The SimHash's 64 counters are summed within the row: of each seven words in 4 longs of sixteen 4-bit lanes, these
in lanes of 8, 16 or 32 bits as the number of words needs. Majorities are read off all lanes of a long at once,
by adding what a lane lacks to carry into its highest bit.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, components, materialise, scratch, text_or_empty, written

LANE_WORDS = 7
SPOT = ["id", "line", "t"]  # a line: its document's id, its number, and the hash of the document's text
SMALL = 32 << 20  # bytes up to which a table, counted before, is broadcast
FILTER_ROWS = 1 << 18  # rows of a filter's table, 64 bits each


def exploded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, line, raw): every \\n-split line with its number from 0; t is a hash of the whole text."""
    return docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("t"), F.posexplode(F.split(text_or_empty(text_col), "\n", -1)).alias("line", "raw"))


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).isNull(), F.col(text_col))


def normal(raw: Column) -> Column:
    """Lower case, words one space apart. The pattern runs on the few lines alone that need it."""
    odd = F.contains(raw, F.lit("  "))
    for c in "\t\r\x0b\x0c":
        odd = odd | F.contains(raw, F.lit(c))
    return F.trim(F.when(odd, F.regexp_replace(F.lower(raw), WS, " ")).otherwise(F.lower(raw)))


def _or(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def lanes(width: int, step: int) -> int:
    """A long with `width` ones at the low end of every `step` bits."""
    return sum(((1 << width) - 1) << i for i in range(0, 64, step))


def _total(x: Column, shift: int, mask: int) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + F.call_function("shiftrightunsigned", v, F.lit(shift)).bitwiseAND(F.lit(mask)))


def _nibbles(j: int):
    return lambda x: _total(x, j, lanes(1, 4))


def majority(sums: list[Column], n: Column, width: int) -> Column:
    """The bits counted over half of n times. sums: the j-th holds arrays' sums in 4-bit lanes, of bits 4 k + j; they are added up in lanes of `width` bits."""
    half = (1 << width - 1) - 1
    low, ones = lanes(width, 2 * width), lanes(1, 2 * width)  # two halves, so that no lane reaches the sign
    lack = F.lit(half) - F.floor(n / 2)  # a lane that holds over half of n words reaches its highest bit with it
    bits = []
    for j in range(width):
        total = _total(sums[j % 4], j - j % 4, lanes(4, width))
        for odd in (0, 1):
            full = F.shiftrightunsigned(total, width * odd).bitwiseAND(F.lit(low)) + lack * F.lit(ones)
            bits.append(F.shiftleft(F.shiftrightunsigned(full, width - 1).bitwiseAND(F.lit(ones)), j + width * odd))
    return _or(bits)


def simhash(lines: DataFrame, by: list[str]) -> DataFrame:
    """(*by, h): the SimHash of the distinct words of `norm`: a bit is set where most words' hashes have it."""
    hashes = F.array_distinct(F.transform(F.split("norm", " "), lambda w: F.xxhash64(w)))
    few = F.transform(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / LANE_WORDS).cast("int")), lambda i: F.slice("x", i * LANE_WORDS + 1, LANE_WORDS))
    parts = lines.select(*by, hashes.alias("x")).select(*by, F.size("x").alias("n"), few.alias("x"))
    sums = parts.select(*by, "n", *[F.transform("x", _nibbles(j)).alias(f"s{j}") for j in range(4)])
    n, s = F.col("n"), [F.col(f"s{j}") for j in range(4)]
    return sums.select(*by, F.when(n < 1 << 7, majority(s, n, 8)).when(n < 1 << 15, majority(s, n, 16)).otherwise(majority(s, n, 32)).alias("h"))


def block_values(blocks: int, chosen: tuple[int, ...]) -> list[tuple[int, int]]:
    """(first bit, width) of each chosen block of a long."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(edges[b], edges[b + 1] - edges[b]) for b in chosen]


def block_key(h: Column, k: Column, blocks: int, choices: list[tuple[int, ...]]) -> Column:
    """The k-th choice of blocks: its number and their values, as a long."""
    out = None
    for n, chosen in enumerate(choices):
        v = F.lit(n).cast("long")
        for at, width in block_values(blocks, chosen):
            v = F.shiftleft(v, width).bitwiseOR(F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << width) - 1)))
        out = F.when(k == n, v) if out is None else out.when(k == n, v)
    return out


def first_choice(x: Column, blocks: int, choices: list[tuple[int, ...]]) -> Column:
    """The first choice whose blocks are all zero in x, so that a pair is made under one of its keys alone."""
    out = None
    for n, chosen in enumerate(choices):
        mask = sum((1 << width) - 1 << at for at, width in block_values(blocks, chosen))
        none = x.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)) == 0
        out = F.when(none, n) if out is None else out.when(none, n)
    return out


def _keyed(hashes: DataFrame, n: int) -> DataFrame:
    return hashes.select("*", F.explode(F.array(*[F.lit(i).cast("tinyint") for i in range(n)])).alias("k"))


def near(h: str, g: str, bits: int) -> Column:
    return F.bit_count(F.col(h).bitwiseXOR(F.col(g))) <= bits


def hub_pairs(kinds: DataFrame, bits: int, blocks: int, crowd: int) -> DataFrame:
    """Distinct (a, b): each class, with the least class of each of its keys of disjoint blocks that over `crowd` classes have, if within `bits` of it."""
    choices = [(2 * i, 2 * i + 1) for i in range(blocks // 2)]
    rows = _keyed(kinds.select("c", "h"), len(choices)).select("c", "h", block_key(F.col("h"), F.col("k"), blocks, choices).alias("key"))
    hubs = rows.groupBy("key").agg(F.min("c").alias("hub"), F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).drop("n")
    hubs = written(hubs, "hubs")
    hubs = hubs.join(only_of(kinds.select(F.col("c").alias("hub"), F.col("h").alias("g")), hubs.select("hub").distinct(), ["hub"]), "hub")
    return only_of(rows, hubs, ["key"]).where((F.col("c") > F.col("hub")) & near("h", "g", bits)).select(F.col("c").alias("a"), F.col("hub").alias("b")).distinct()


def candidates(kinds: DataFrame, bits: int, blocks: int) -> DataFrame:
    """(a, b), each pair once, a > b, of classes (c, h, p) that share two blocks, within `bits` bits, and not in one large component p.

    Keys' groups are met by a hashed join: few rows a key, and no side to sort.
    """
    choices = list(combinations(range(blocks), 2))
    rows = _keyed(kinds.select("c", "h", "p"), len(choices))
    x, y = rows.alias("x"), rows.select(F.col("c").alias("d"), F.col("h").alias("g"), F.col("p").alias("q"), "k").alias("y")
    key = lambda h, k: block_key(F.col(h), F.col(k), blocks, choices)
    apart = (F.col("p") != F.col("q")) | (F.col("p") < 0)
    once = first_choice(F.col("h").bitwiseXOR(F.col("g")), blocks, choices) == F.col("x.k")
    met = (key("h", "x.k") == key("g", "y.k")) & (F.col("c") > F.col("d")) & near("h", "g", bits) & apart & once
    return x.join(y.hint("shuffle_hash"), met).select(F.col("c").alias("a"), F.col("d").alias("b"))


def within(a: str, b: str, allowed: int) -> bool:
    """Whether at most `allowed` insertions, deletions and substitutions of code points turn a into b: similar_texts() in plain Python, for tests.

    `up` and `down` hold, a bit for each character of a, where a column of the distance table rises or falls by one from
    row to row; `score` is the column's last entry. Time is the product of the lengths over the bits of a machine word.
    """
    if abs(len(a) - len(b)) > allowed:
        return False
    start, stop = 0, min(len(a), len(b))
    while start < stop and a[start] == b[start]:
        start += 1
    end = 0
    while end < stop - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if max(len(a), len(b)) <= allowed:
        return True
    spots: dict[str, int] = {}
    for i, c in enumerate(a):
        spots.setdefault(c, []).append(i)
    size = (len(a) + 7) // 8
    for c, at in spots.items():
        bits = bytearray(size)
        for i in at:
            bits[i >> 3] |= 1 << (i & 7)
        spots[c] = int.from_bytes(bits, "little")
    full = (1 << len(a)) - 1
    last = len(a) - 1
    up, down, score, left = full, 0, len(a), len(b)
    for c in b:
        same = spots.get(c, 0)
        level = (((same & up) + up) ^ up) | same
        rise, fall = down | (full & ~(level | up)), up & level
        score += (rise >> last & 1) - (fall >> last & 1)
        left -= 1
        if score - left > allowed:
            return False
        if score + left <= allowed:
            return True
        rise, fall, same = rise << 1 | 1, fall << 1, same | down
        up, down = (fall | ~(same | rise)) & full, rise & same & full
    return score <= allowed


def let(value: Column, body) -> Column:
    """body(value), with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def aligned(a: Column, b: Column) -> Column:
    """An upper bound of the edit distance of two arrays of words, a space behind each.

    One pass over a with a place in b: an equal word is matched, a word equal to the other side's next one is met by
    leaving out the word before it, and else both words are exchanged.
    """

    def step(s: Column, i: Column) -> Column:
        j, cost = s["j"], s["cost"]
        v, u = F.get(a, i), F.get(b, j)
        leave = lambda j, w: F.struct(j.alias("j"), (cost + F.char_length(w) + 1).alias("cost"))
        both = F.struct((j + 1).alias("j"), (cost + F.greatest(F.char_length(v), F.char_length(u))).alias("cost"))
        out = F.when(u == v, F.struct((j + 1).alias("j"), cost.alias("cost"))).when(u.isNull(), leave(j, v))
        return out.when(F.get(b, j + 1) == v, leave(j + 2, u)).when(F.get(a, i + 1) == u, leave(j, v)).otherwise(both)

    start = F.struct(F.lit(0).alias("j"), F.lit(0).alias("cost"))
    places = F.slice(F.sequence(F.lit(0), F.size(a)), F.lit(1), F.size(a))
    length = lambda x: F.aggregate(x, F.lit(0), lambda s, w: s + F.char_length(w) + 1)
    return F.aggregate(places, start, step, lambda s: s["cost"] + length(F.slice(b, s["j"] + 1, F.greatest(F.size(b) - s["j"], F.lit(0)))))


def similar_texts(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs with texts ta, tb those of 100 * (1 - edit distance / longer length) >= percent.

    Words are taken with a space behind each, so that the words that both texts begin and end with can be left out:
    the distance is that of what stands between. Pairs of which all of that can be replaced, or whose words'
    alignment is cheap enough, pass; levenshtein() with its limit decides the rest.
    """
    limit = F.floor(F.greatest(F.char_length("ta"), F.char_length("tb")) * (100 - percent) / 100).cast("int")
    same = lambda x, y: F.zip_with(x, y, lambda v, w: v.eqNullSafe(w))
    first = lambda flags: F.coalesce(F.nullif(F.array_position(flags, False), F.lit(0)), F.size(flags) + 1).cast("int") - 1

    def ends(r: Column) -> Column:
        head, tail = first(same(r["a"], r["b"])), first(same(F.reverse(r["a"]), F.reverse(r["b"])))
        return F.struct(r["a"].alias("a"), r["b"].alias("b"), head.alias("head"), F.least(tail, F.least(F.size(r["a"]), F.size(r["b"])) - head).alias("tail"))

    def middle(r: Column) -> Column:
        rest = lambda x: F.slice(x, r["head"] + 1, F.size(x) - r["head"] - r["tail"])
        return F.struct(rest(r["a"]).alias("a"), rest(r["b"]).alias("b"))

    def verdict(r: Column) -> Column:
        text = lambda x: F.concat(F.array_join(x, " "), F.when(F.size(x) > 0, " ").otherwise(""))
        ta, tb = text(r["a"]), text(r["b"])
        passes = F.when(F.greatest(F.char_length(ta), F.char_length(tb)) <= limit, True).when(aligned(r["a"], r["b"]) <= limit, True)
        return passes.otherwise(F.call_function("levenshtein", ta, tb, limit) >= 0)

    both = F.struct(F.split("ta", " ").alias("a"), F.split("tb", " ").alias("b"))
    return pairs.where(let(let(let(both, ends), middle), verdict)).drop("ta", "tb")


def only_of(rows: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """rows joined with `wanted` on `by`.

    A table of FILTER_ROWS words of 64 bits, one bit set for each wanted key, is broadcast first, so that few
    others of the rows are shuffled.
    """
    mark = F.xxhash64(*by)
    word, bit = F.pmod(mark, F.lit(FILTER_ROWS)).cast("int").alias("__w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(mark, 58).cast("int"))
    bits = wanted.select(word, bit.alias("__b")).groupBy("__w").agg(F.bit_or("__b").alias("__b"))
    passed = rows.withColumn("__w", word).join(F.broadcast(bits), "__w").where(F.col("__b").bitwiseAND(bit) != 0).drop("__w", "__b")
    return passed.join(wanted, by)


def similar(pairs: DataFrame, kinds: DataFrame, raw: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose lines pass the edit similarity. Lengths are compared before texts are read from `raw`."""
    ends = only_of(kinds.select("c", "size", *SPOT), pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), ["c"])
    ends = written(ends, "ends")
    side = lambda x: ends.select(F.col("c").alias(x), F.col("size").alias("size" + x))
    fit = written(pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("sizea", "sizeb") * 100 >= F.greatest("sizea", "sizeb") * percent).select("a", "b"), "fit")
    ends = only_of(ends.drop("size"), fit.select(F.explode(F.array("a", "b")).alias("c")).distinct(), ["c"])
    texts = only_of(raw, written(ends, "ends"), SPOT).select("c", normal(F.col("raw")).alias("norm")).dropDuplicates(["c"])
    texts = written(texts, "texts")
    full = fit.join(texts.select(F.col("c").alias("a"), F.col("norm").alias("ta")), "a").join(texts.select(F.col("c").alias("b"), F.col("norm").alias("tb")), "b")
    return written(similar_texts(full, percent), "similar")


def lines_of(text: Column) -> Column:
    """Numbers of the lines that have a word."""
    numbers = F.transform(F.split(text_or_empty(text), "\n", -1), lambda x, i: F.when(F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")), i))
    return F.array_compact(numbers)


def removed(docs: DataFrame, percent: int = 80, bits: int = 10, blocks: int = 6, crowd: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, gone): of each document that loses lines their numbers; t is text_key().

    A line stays if it is the first occurrence of its group, by (id, line number), or has no word. Null texts
    have one empty line. Rows of one id with different texts are documents of their own; of equal rows both
    keep the first occurrence. Rows with a null id are left out.

    Lines are split from `docs` anew wherever their texts are needed; what is written are hashes and numbers, and
    the texts of candidates.
    """
    docs = docs.where(F.col(id_col).isNotNull())
    raw = exploded(docs, id_col, text_col)
    lines = raw.select(*SPOT, normal(F.col("raw")).alias("norm")).where(F.col("norm") != "")
    lines = lines.select("*", F.char_length("norm").alias("size"), F.xxhash64("norm").alias("k1"), F.xxhash64(F.lit("line"), F.col("norm")).alias("k2"))
    heads = simhash(lines, [*SPOT, "size", "k1", "k2"]).groupBy("k1", "k2").agg(F.min(F.struct(*SPOT, "size", "h")).alias("s")).select("s.*")
    kinds = written(heads.withColumn("c", F.monotonically_increasing_id()), "kinds")
    linked = similar(written(hub_pairs(kinds, bits, blocks, crowd), "hubs"), kinds, raw, percent)
    labels = components(linked).select(F.col("id").alias("c"), F.col("label").alias("p"))
    large = labels.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("p")
    crowded = materialise(labels.join(large, "p"))
    parted = kinds.select("c", "h").join(crowded, "c", "left").withColumn("p", F.coalesce("p", F.lit(-1).cast("long")))
    links = similar(written(candidates(parted, bits, blocks), "pairs"), kinds, raw, percent)
    labels = components(links.unionByName(linked))
    spots = only_of(kinds.select("c", *SPOT), labels.select(F.col("id").alias("c"), "label"), ["c"])
    firsts = spots.groupBy("label").agg(F.min(F.struct(*SPOT)).alias("first"))
    later = materialise(spots.join(firsts, "label").where(F.struct(*SPOT) != F.col("first")).select("c"))
    stay = kinds.join(later, "c", "left_anti").groupBy("id", "t").agg(F.collect_list("line").alias("stay"))
    every = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("t"), lines_of(F.col(text_col)).alias("every")).dropDuplicates(["id", "t"])
    gone = F.array_except("every", F.coalesce("stay", F.array().cast("array<int>")))
    return every.join(stay, ["id", "t"], "left").select("id", "t", gone.alias("gone")).where(F.size("gone") > 0)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """docs, all columns, with the text's kept lines, and n_lines and n_removed (as __n_lines, __n_removed).

    A text of which no line goes is unchanged, null included. Rows with a null id are unchanged. The
    line numbers are broadcast if they are few, else joined.
    """
    gone = materialise(removed(docs, id_col=id_col, text_col=text_col, **rule).select(F.col("id").alias("__id"), F.col("t").alias("__t"), F.col("gone").alias("__gone")))
    size = gone.agg(F.coalesce(F.sum(F.lit(96) + 4 * F.size("__gone")), F.lit(0))).first()[0]
    joined = docs.join(F.broadcast(gone) if size <= SMALL else gone, (F.col(id_col) == F.col("__id")) & (text_key(text_col) == F.col("__t")), "left")
    lines = F.split(text_or_empty(text_col), "\n", -1)
    out = F.col("__gone")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(out, i)), "\n")
    text = F.when(out.isNull(), F.col(text_col)).otherwise(kept)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], text.alias(text_col), F.size(lines).cast("long").alias("__n_lines"), F.coalesce(F.size(out), F.lit(0)).cast("long").alias("__n_removed"))


def op10(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text")).select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(text_or_empty("text"), 256).alias("kept_sha256"))
