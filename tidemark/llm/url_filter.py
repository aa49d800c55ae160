"""URL filters: a blocked Bloom filter in front of an exact hash join.

The filter is a table of 256-bit blocks (eight 32-bit words, one bit set in each per listed URL), built
by an OR aggregate over the listed URLs' block numbers and so merged on the map side. URLs are probed
by joining the block table on the block number. Rows that the filter rules out are done with; only possible
hits reach the exact join with the list on the canonical URL, which removes the false positives. The block
table takes 5 bytes a listed URL where the list takes a URL's length, and is broadcast while its size, known
before, is within `broadcast_bytes`; then no row but the possible hits is shuffled. Beyond, Spark joins it
like any table.

Allow and block rules on (host, path prefix) come first; the longest rule that fits decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Fixed rules (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The odd multipliers of the split-block Bloom filter in the Parquet format specification, one per word of a block.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or end, A-Z lower-cased; empty for null or no ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """From the end of the host up to ?, # or end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """host without port and leading www., m. or blog., and path without .html and trailing slash; scheme, query and fragment go."""
    h = F.regexp_replace(F.regexp_replace(host(url), r":\d+$", ""), r"^(www|m|blog)\.", "")
    return F.concat(h, F.regexp_replace(F.regexp_replace(path(url), r"\.html$", ""), r"/+$", ""))


def rule_of(h: Column, p: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rh, rp in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        out = F.when(fits, F.struct(F.lit(rh + rp).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _masks(url: Column) -> list[Column]:
    """One bit for each word of the block, from a second hash."""
    h = F.xxhash64(url, F.lit("bits")).bitwiseAND(F.lit(0xFFFFFFFF))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(((h * F.lit(s & 0x7FFFFFFF)).bitwiseAND(F.lit(0xFFFFFFFF))), 27).cast("int")) for s in SALTS]


def bloom(listed: DataFrame, col: str, blocks: int) -> DataFrame:
    """(block, w0..w7): the filter of the listed URLs; blocks without a URL have no row."""
    names = [f"w{i}" for i in range(len(SALTS))]
    masks = listed.select(_block(F.col(col), blocks).alias("block"), *[m.alias(n) for m, n in zip(_masks(F.col(col)), names)])
    return masks.groupBy("block").agg(*[F.bit_or(n).alias(n) for n in names])


def match(urls: DataFrame, url_col: str, listed: DataFrame, bits_per_url: int = 16, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """urls with a column `listed`: whether the canonical URL is on the list (one column, canonical URLs).

    Repeated URLs on either side count once and keep their rows; a URL that is null or has no host or path is
    never listed and not looked up; an empty list lists nothing.
    """
    names = [f"w{i}" for i in range(len(SALTS))]
    exact = listed.toDF("__url").where(F.col("__url").isNotNull() & (F.col("__url") != "")).distinct()
    n = exact.count()
    blocks = max(1, math.ceil(n * bits_per_url / 256))
    table = bloom(exact, "__url", blocks)
    if min(n, blocks) * 80 <= broadcast_bytes:
        table = F.broadcast(table)
    probe = urls.withColumn("__c", canonical(F.col(url_col))).withColumn("block", _block(F.col("__c"), blocks))
    hit = F.lit(True)
    for m, name in zip(_masks(F.col("__c")), names):
        hit = hit & (m.bitwiseAND(F.col(name)) != 0)
    named = F.col("__c") != ""
    looked = probe.where(named).join(table, "block", "left").withColumn("__maybe", F.coalesce(hit, F.lit(False))).drop("block", *names)
    ruled_out = probe.where(~named).drop("block").unionByName(looked.where(~F.col("__maybe")).drop("__maybe")).withColumn("listed", F.lit(False)).drop("__c")
    possible = looked.where("__maybe").drop("__maybe")
    found = possible.join(exact.withColumn("__on", F.lit(True)), F.col("__c") == F.col("__url"), "left").withColumn("listed", F.coalesce("__on", F.lit(False))).drop("__c", "__url", "__on")
    return ruled_out.unionByName(found)


def judge(urls: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row (id, host, path, rule, verdict, listed) per row of urls: the rule's verdict, else block if listed and allow if not."""
    rows = match(urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), "url", listed)
    rows = rows.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    return rows.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def listed_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The query's list, as the tables hold none: the canonical URLs of every sixteenth page. Other pages with such a URL are found by it alone."""
    return pages.where(F.pmod(F.col(id_col), F.lit(16)) == 5).select(canonical(F.col(url_col)).alias("url")).distinct()


def op6(pages: DataFrame) -> DataFrame:
    return judge(pages, listed_urls(pages))


OP6_SQL = r"""
WITH p AS (SELECT page_id, url,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
c AS (SELECT *, regexp_replace(regexp_replace(host, ':\d+$', ''), '^(www|m|blog)\.', '') || regexp_replace(regexp_replace(path, '\.html$', ''), '/+$', '') AS c FROM p),
l AS (SELECT DISTINCT c FROM c WHERE page_id % 16 = 5 AND c <> ''),
rules(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM c JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT c.page_id, host, path, f.rule, coalesce(f.verdict, CASE WHEN l.c IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.c IS NOT NULL AS listed
FROM c LEFT JOIN f USING (page_id) LEFT JOIN l ON c.c = l.c
"""
