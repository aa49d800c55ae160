"""Preference formatting of chosen and rejected conversations.

Of each pair the longest common prefix of turns is found and rendered once, as the prompt; what
follows in either conversation is its completion, with a mask of what is to be learned: the character
spans of assistant contents and their end marks. Turns are compared by role and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed turn marks.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), turn["text"], F.lit(CLOSE))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render), "")


def mask(turns: Column) -> Column:
    """Character spans "start:stop" of assistant contents with their end marks in rendered(turns)."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(F.concat(F.lit(OPEN), t["role"], F.lit("\n")))
        stop = acc["at"] + F.length(render(t))
        span = F.concat(start.cast("string"), F.lit(":"), stop.cast("string"))
        return F.struct(stop.cast("long").alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, state, step, lambda acc: F.array_join(acc["spans"], ","))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two turn arrays."""
    differs = F.transform(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda i: ~F.coalesce(F.get(a, i) == F.get(b, i), F.lit(False)))
    return (F.array_position(differs, True) - 1).cast("int")


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Adds n_common, prompt, chosen_text, rejected_text, chosen_mask and rejected_mask to rows with two turn arrays.

    A turn is a struct (role, text). If one conversation is the start of the other its completion is
    empty; `usable` is whether both completions hold something to learn. An empty or null array has
    no turns.
    """
    none = F.expr("cast(array() as array<struct<role:string,text:string>>)")
    a, b = F.coalesce(F.col(chosen), none), F.coalesce(F.col(rejected), none)
    pairs = pairs.withColumn("n_common", common_turns(a, b))
    n = F.col("n_common")
    rest = lambda x: F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))
    out = pairs.select(*[c for c in pairs.columns if c not in (chosen, rejected)], rendered(F.slice(a, 1, n)).alias("prompt"), rest(a).alias("__a"), rest(b).alias("__b"))
    return out.select("*", rendered("__a").alias("chosen_text"), rendered("__b").alias("rejected_text"), mask(F.col("__a")).alias("chosen_mask"), mask(F.col("__b")).alias("rejected_mask")
                      ).withColumn("usable", (F.col("chosen_mask") != "") & (F.col("rejected_mask") != "")).drop("__a", "__b")


def turn_arrays(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): turns in order of number, then role and text; repeated rows count once, null roles and texts are empty. Rows with a null conversation id are dropped."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    turns = F.transform(F.array_sort(F.collect_set(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return conversations.where(F.col(conv_col).isNotNull()).groupBy(F.col(conv_col).alias("conv_id")).agg(turns.alias("turns"))


def pair_up(turns: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected): one pair per conversation of a table that has no preferences.

    chosen is the conversation; rejected is the same up to its last assistant turn, which is replaced by
    the last assistant turn of the conversation whose id differs in the lowest bit. Without an assistant
    turn, rejected is that other conversation whole; without that other one, or a reply in it, rejected
    ends before the replaced turn. An equi-join on the id: as many rows as conversations.
    """
    roles = F.transform("turns", lambda t: t["role"])
    last = F.coalesce(F.array_max(F.filter(F.transform(roles, lambda r, i: F.when(r == "assistant", i + 1)), lambda i: i.isNotNull())), F.lit(0))
    keyed = turns.withColumn("last", last)
    other = keyed.select(F.col("conv_id").bitwiseXOR(1).alias("conv_id"), F.col("turns").alias("o_turns"), F.col("last").alias("o_last"))
    none = F.expr("cast(array() as array<struct<role:string,text:string>>)")
    reply = F.when(F.coalesce(F.col("o_last"), F.lit(0)) > 0, F.array(F.get("o_turns", F.col("o_last") - 1))).otherwise(none)
    rejected = F.when(F.col("last") > 0, F.concat(F.slice("turns", 1, F.greatest(F.col("last") - 1, F.lit(0))), reply)).otherwise(F.coalesce("o_turns", none))
    return keyed.join(other, "conv_id", "left").select("conv_id", F.col("turns").alias("chosen"), rejected.alias("rejected"))


def op2(conversations: DataFrame) -> DataFrame:
    return format_pairs(pair_up(turn_arrays(conversations)))


_RENDER = "list_transform({x}, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10))"
_MASK = """array_to_string([CAST(coalesce(list_sum({l}[1:i - 1]), 0) + 13 + length({x}[i].role) AS VARCHAR) || ':' || CAST(list_sum({l}[1:i]) AS VARCHAR)
  for i in range(1, len({x}) + 1) if {x}[i].role = 'assistant'], ',')"""
OP2_SQL = f"""
WITH t AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS turns
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
k AS (SELECT *, coalesce(list_max([i for i in range(1, len(turns) + 1) if turns[i].role = 'assistant']), 0) AS last FROM t),
p AS (SELECT k.conv_id, k.turns AS a,
  CASE WHEN k.last > 0 THEN list_concat(k.turns[1:k.last - 1], CASE WHEN coalesce(o.last, 0) > 0 THEN [o.turns[o.last]] ELSE [] END) ELSE coalesce(o.turns, []) END AS b
  FROM k LEFT JOIN k AS o ON o.conv_id = xor(k.conv_id, 1)),
n AS (SELECT *, coalesce(list_min([i for i in range(1, least(len(a), len(b)) + 1) if a[i] IS DISTINCT FROM b[i]]), least(len(a), len(b)) + 1) - 1 AS n_common FROM p),
r AS (SELECT conv_id, n_common, a[1:n_common] AS c, a[n_common + 1:] AS ra, b[n_common + 1:] AS rb FROM n),
l AS (SELECT *, list_transform({_RENDER.format(x='ra')}, lambda s: length(s)) AS la, list_transform({_RENDER.format(x='rb')}, lambda s: length(s)) AS lb FROM r),
m AS (SELECT conv_id, CAST(n_common AS INT) AS n_common, array_to_string({_RENDER.format(x='c')}, '') AS prompt,
  array_to_string({_RENDER.format(x='ra')}, '') AS chosen_text, array_to_string({_RENDER.format(x='rb')}, '') AS rejected_text,
  {_MASK.format(x='ra', l='la')} AS chosen_mask, {_MASK.format(x='rb', l='lb')} AS rejected_mask FROM l)
SELECT *, chosen_mask <> '' AND rejected_mask <> '' AS usable FROM m
"""
