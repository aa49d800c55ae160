"""Queries: sources and sinks, projections, joins, aggregations, sort, sets, reshape, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import qc
from ..operators.grid import complete_grid, days, expand_daily, hours
from ..operators.select import medians, quantiles
from ..sources.io import manifest, scan_csv, write_layer, write_ledger
from ..sources.scratch import scratch
from .registry import DAILY, PANEL, daily, panel, query, r, readings, table

c, lit = F.col, F.lit
EPOCH = "date_diff('day', DATE '1970-01-01', CAST({} AS DATE))"

# --- sources and sinks


@query("s1_csv_union", "SELECT s_suppkey, s_name, round(CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END, 2) AS s_acctbal FROM supplier")
def s1(spark, sf):
    s, p = table(spark, sf, "supplier"), scratch(spark, "csv")
    s.where("s_suppkey % 2 = 0").select("s_suppkey", "s_name", "s_acctbal").write.option("header", True).csv(f"{p}/a")
    s.where("s_suppkey % 2 = 1").select("s_suppkey", "s_name").write.option("header", True).csv(f"{p}/b")
    df = scan_csv(spark, [f"{p}/a", f"{p}/b"])
    return df.select(c("s_suppkey").cast("long"), "s_name", r(c("s_acctbal").cast("double"), 2).alias("s_acctbal"))


@query("s2_latin1", "SELECT c_custkey, 'é' || c_name AS name FROM customer")
def s2(spark, sf):
    p = scratch(spark, "latin1")
    table(spark, sf, "customer").select("c_custkey", F.concat(lit("é"), "c_name").alias("name")).write.option("header", True).option("encoding", "ISO-8859-1").csv(p)
    return scan_csv(spark, [p], "c_custkey long, name string", "ISO-8859-1").drop("file")


@query("s3_subhourly_scan", f"WITH {PANEL} SELECT series, t, round(avg(value), 4) AS y FROM ev GROUP BY ALL")
def s3(spark, sf):
    p = scratch(spark, "readings")
    table(spark, sf, "events").select("event_type", "ts", "value").write.option("header", True).csv(p)
    df = scan_csv(spark, [p], "event_type string, ts timestamp_ntz, value double")
    return df.groupBy(c("event_type").alias("series"), hours("ts").alias("t")).agg(r(F.avg("value")).alias("y"))


@query("s4_daily_scan", f"SELECT o_orderkey, {EPOCH.format('o_orderdate')} AS d FROM orders WHERE o_orderkey % 10 <> 0")
def s4(spark, sf):
    p = scratch(spark, "daily")
    day = F.when(c("o_orderkey") % 10 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    table(spark, sf, "orders").select("o_orderkey", day.alias("day")).write.option("header", True).csv(p)
    df = scan_csv(spark, [p], "o_orderkey long, day string").withColumn("day", X.parse_time(c("day"), "yyyy-MM-dd").cast("date"))
    return df.where("day IS NOT NULL").select("o_orderkey", days(c("day")).alias("d"))


@query("s5_mixed_dates", f"SELECT o_orderkey, {EPOCH.format('o_orderdate')} AS d FROM orders")
def s5(spark, sf):
    o = table(spark, sf, "orders")
    text = F.when(c("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(c("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    return o.select("o_orderkey", days(X.parse_time(text, "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd")).alias("d"))


@query("s6_pruned_scan", "SELECT l_returnflag, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ALL")
def s6(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_quantity").groupBy("l_returnflag").agg(r(F.sum("l_quantity"), 2).alias("qty"))


@query("s7_layer_sink", f"WITH {PANEL} SELECT series, count(*) AS n, count(y) AS valid FROM h GROUP BY ALL")
def s7(spark, sf):
    p = scratch(spark, "layer")
    write_layer(panel(spark, sf), p, ["series"])
    return spark.read.parquet(p).groupBy("series").agg(F.count(lit(1)).alias("n"), F.count("y").alias("valid"))


@query("s8_ledger", "SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'a' ELSE 'b' END AS replication, n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS run FROM nation")
def s8(spark, sf):
    p = scratch(spark, "ledger")
    tag = F.when(c("n_nationkey") % 2 == 0, "a").otherwise("b")
    rows = table(spark, sf, "nation").select(c("n_nationkey").alias("k"), tag.alias("replication"))
    write_ledger(rows.withColumn("run", lit(1)), p)
    write_ledger(rows.where("replication = 'a'").withColumn("run", lit(2)), p)
    return spark.read.parquet(p).select("replication", "k", "run")


@query("s9_manifest", "SELECT 'absent' AS name, NULL::BIGINT AS rows, NULL::INT AS columns, false AS filled, 'MISSING' AS status UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), (SELECT count(*)::INT FROM information_schema.columns WHERE table_name = 'nation'), true, 'OK' UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), (SELECT count(*)::INT FROM information_schema.columns WHERE table_name = 'orders'), true, 'OK'")
def s9(spark, sf):
    m = manifest(spark, {n: f"{sf}/{n}.parquet" for n in ("nation", "orders", "absent")})
    return m.select("name", "rows", "columns", F.coalesce(c("size") > 0, lit(False)).alias("filled"), "status")


@query("s10_external_layers", "SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def s10(spark, sf):
    o, cu, n = (table(spark, sf, x) for x in ("orders", "customer", "nation"))
    return o.join(cu, c("o_custkey") == c("c_custkey"), "left").join(n, c("c_nationkey") == c("n_nationkey"), "left").select("o_orderkey", "c_mktsegment", "n_name")


# --- projections and predicates


@query("p1_coerce_drop_empty", "SELECT event_id, TRY_CAST(event_type AS DOUBLE) IS NULL AS no_number, value FROM events")
def p1(spark, sf):
    e = table(spark, sf, "events").select("event_id", c("event_type").try_cast("double").alias("bad"), c("value").cast("string").try_cast("double").alias("value"))
    kept = qc.drop_empty(e, ["bad", "value"])
    return kept.select("event_id", lit("bad" not in kept.columns).alias("no_number"), "value")


@query("p2_sentinel", "SELECT event_id, CASE WHEN user_id % 5 <> 0 THEN value END AS v FROM events")
def p2(spark, sf):
    text = F.when(c("user_id") % 5 == 0, "NA").otherwise(c("value").cast("string"))
    return table(spark, sf, "events").select("event_id", qc.sentinel_null(text, "NA").alias("v"))


@query("p3_flag_gate", "SELECT event_id, CASE WHEN user_id % 3 IN (0, 1) THEN value END AS v FROM events")
def p3(spark, sf):
    return table(spark, sf, "events").select("event_id", qc.qc_gate(c("value"), F.pmod("user_id", lit(3)), (0, 1)).alias("v"))


@query("p3_averaged_flag", "WITH e AS (SELECT event_type AS series, date_diff('hour', TIMESTAMP '1970-01-01', date_trunc('hour', ts)) AS t, avg(user_id % 3) AS f, avg(value) AS v FROM events GROUP BY ALL) SELECT series, t, round(CASE WHEN f IN (0, 1) THEN v END, 4) AS v FROM e")
def p3b(spark, sf):
    h = table(spark, sf, "events").groupBy(c("event_type").alias("series"), hours("ts").alias("t")).agg(F.avg(c("user_id") % 3).alias("f"), F.avg("value").alias("v"))
    return h.select("series", "t", r(qc.qc_gate(c("v"), c("f"), (0.0, 1.0))).alias("v"))


@query("p4_plausible", "SELECT event_id, CASE WHEN value BETWEEN 10 AND 300 THEN value END AS v FROM events")
def p4(spark, sf):
    return table(spark, sf, "events").select("event_id", qc.plausible(c("value"), 10, 300).alias("v"))


@query("p5_text_gate", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN l_quantity END AS q FROM lineitem")
def p5(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", qc.qc_gate(c("l_quantity"), c("l_returnflag"), ("N",)).alias("q"))


@query("p6_select_by_name", "SELECT p_partkey, p_brand, p_type, p_retailprice FROM part")
def p6(spark, sf):
    p = table(spark, sf, "part")
    return p.select(p.colRegex("`p_(?!name|size).*`"))


@query("p7_generic_names", "SELECT 'l' AS station, l_orderkey, l_quantity AS value FROM lineitem")
def p7(spark, sf):
    wide = table(spark, sf, "lineitem").select("l_orderkey", c("l_quantity").alias("quantity [l]"))
    long = wide.unpivot("l_orderkey", ["quantity [l]"], "variable", "value")
    return long.select(F.regexp_extract("variable", r"\[(.*)\]", 1).alias("station"), "l_orderkey", "value")


SITE = "s AS (SELECT t, avg(ta) AS ta FROM h GROUP BY t)"


@query("p8_swap_driver", f"WITH {PANEL}, {SITE} SELECT h.series, h.t, round(s.ta / 3.6, 4) AS ta FROM h LEFT JOIN s ON s.t = h.t")
def p8(spark, sf):
    h = panel(spark, sf)
    return qc.swap_driver(h, h.groupBy("t").agg(F.avg("ta").alias("ta")), ["t"], "ta", 1 / 3.6).select("series", "t", r("ta").alias("ta"))


@query("p8_coverage", f"WITH {PANEL}, {SITE} SELECT h.series, count(h.ta) AS before, count(s.ta) AS after FROM h LEFT JOIN s ON s.t = h.t GROUP BY h.series")
def p8b(spark, sf):
    """Valid rows of the driver before and after the swap."""
    h = panel(spark, sf)
    new = qc.swap_driver(h.withColumn("old", c("ta")), h.groupBy("t").agg(F.avg("ta").alias("ta")), ["t"], "ta", 1 / 3.6)
    return new.groupBy("series").agg(F.count("old").alias("before"), F.count("ta").alias("after"))


@query("p9_prefer_filled", f"WITH {PANEL}, {SITE} SELECT h.series, h.t, round(coalesce(h.ta, s.ta), 4) AS ta FROM h JOIN s ON s.t = h.t")
def p9(spark, sf):
    h = panel(spark, sf)
    return h.join(h.groupBy("t").agg(F.avg("ta").alias("f")), "t").select("series", "t", r(F.coalesce("ta", "f")).alias("ta"))


@query("p10_observed_else_model", f"WITH {PANEL}, m AS (SELECT series, avg(y) AS p FROM h GROUP BY series) SELECT h.series, t, round(coalesce(y, p), 4) AS filled, CAST(y IS NOT NULL AS INT) AS mask FROM h JOIN m ON m.series = h.series")
def p10(spark, sf):
    h = panel(spark, sf)
    return h.join(h.groupBy("series").agg(F.avg("y").alias("p")), "series").select("series", "t", r(F.coalesce("y", "p")).alias("filled"), c("y").isNotNull().cast("int").alias("mask"))


@query("p11_dummies", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_f, CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_o FROM orders")
def p11(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", *[F.when(c("o_orderstatus") == k, 1.0).otherwise(0.0).alias(f"is_{k.lower()}") for k in ("F", "O")])


@query("p12_year_split", "SELECT CASE WHEN year(o_orderdate) BETWEEN 1995 AND 1999 THEN 'train' WHEN year(o_orderdate) BETWEEN 2000 AND 2001 THEN 'test' END AS split, count(*) AS n FROM orders GROUP BY ALL")
def p12(spark, sf):
    y = F.year("o_orderdate")
    return table(spark, sf, "orders").select(F.when(y.between(1995, 1999), "train").when(y.between(2000, 2001), "test").alias("split")).groupBy("split").agg(F.count(lit(1)).alias("n"))


@query("p13_domain_mask", f"WITH {DAILY}, dom AS (SELECT series, min(d) + 100 AS a, max(d) - 100 AS b FROM o GROUP BY series) SELECT o.series, o.d FROM o JOIN dom ON dom.series = o.series AND o.d BETWEEN a AND b")
def p13(spark, sf):
    o = daily(spark, sf)
    dom = o.groupBy("series").agg((F.min("d") + 100).alias("a"), (F.max("d") - 100).alias("b"))
    return o.join(dom, "series").where(c("d").between(c("a"), c("b"))).select("series", "d")


@query("p14_listwise", f"WITH {PANEL} SELECT series, t FROM h WHERE y IS NOT NULL AND ta IS NOT NULL")
def p14(spark, sf):
    return panel(spark, sf).na.drop(subset=["y", "ta"]).select("series", "t")


@query("p15_drop_constant", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def p15(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", lit(1.0).alias("one"), lit(None).cast("double").alias("none"))
    return qc.drop_constant(df, ["l_quantity", "one", "none"])


@query("p16_classify", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'economy') THEN 'economy' WHEN contains(lower(p_type), 'standard') AND p_brand IN ('Brand#11', 'Brand#12') THEN 'standard' WHEN p_brand IN ('Brand#13', 'Brand#21') OR starts_with(p_brand, 'Brand#3') THEN 'brand' WHEN p_type = 'PROMO BURNISHED COPPER' THEN 'economy' END AS channel FROM part")
def p16(spark, sf):
    kind, brand = F.lower("p_type"), c("p_brand")
    rules = [("economy", kind.contains("economy")), ("standard", kind.contains("standard") & brand.isin("Brand#11", "Brand#12")), ("brand", brand.isin("Brand#13", "Brand#21") | brand.startswith("Brand#3")), ("economy", c("p_type") == "PROMO BURNISHED COPPER")]
    return table(spark, sf, "part").select("p_partkey", qc.classify(rules, None).alias("channel"))


_FIELD = """f AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'Inorganic Fertiliser' WHEN 1 THEN 'Organic fertiliser' WHEN 2 THEN 'Liming' WHEN 3 THEN p_name END AS application,
  CASE p_partkey % 8 WHEN 0 THEN ' Mow' WHEN 1 THEN 'Plough ' WHEN 2 THEN 'Drilling ' || p_brand WHEN 3 THEN 'Apply Fertiliser' WHEN 4 THEN 'Baling (silage)' WHEN 5 THEN 'Chain harrow' WHEN 6 THEN p_type END AS operation FROM part)"""


@query("p16_event_channel", f"""WITH {_FIELD}, g AS (SELECT p_partkey, coalesce(lower(application), '') AS a, coalesce(trim(operation), '') AS o FROM f)
SELECT p_partkey, CASE WHEN contains(a, 'inorganic fertiliser') THEN 'fertN' WHEN contains(a, 'organic fertiliser') THEN 'manure' WHEN contains(a, 'liming') THEN 'lime' WHEN o IN ('Mow', 'Baling (silage)') THEN 'cut'
  WHEN o IN ('Plough', 'Chain harrow') OR starts_with(o, 'Drilling') THEN 'cultiv' WHEN o = 'Apply Fertiliser' THEN 'fertN' END AS channel FROM g""")
def p16_events(spark, sf):
    """Channels of field events, whose texts are made of the parts' columns."""
    size, key = F.pmod("p_size", lit(6)), F.pmod("p_partkey", lit(8))
    used = F.when(size == 0, "Inorganic Fertiliser").when(size == 1, "Organic fertiliser").when(size == 2, "Liming").when(size == 3, c("p_name"))
    done = F.when(key == 0, " Mow").when(key == 1, "Plough ").when(key == 2, F.concat(lit("Drilling "), "p_brand")).when(key == 3, "Apply Fertiliser").when(key == 4, "Baling (silage)").when(key == 5, "Chain harrow").when(key == 6, c("p_type"))
    return table(spark, sf, "part").select("p_partkey", qc.event_channel(used, done).alias("channel"))


@query("p17_roles", f"WITH {PANEL} SELECT a.series, a.t, round(a.y, 4) AS ar_y, round(b.ta, 4) AS fx_ta FROM h a JOIN h b ON a.series = b.series AND b.t = a.t + 6")
def p17(spark, sf):
    from ..operators.grid import align
    out = align(panel(spark, sf), ["series"], ["y"], ["ta"], "y", [6])
    return out.select("series", "t", r("y").alias("ar_y"), r("fx_ta").alias("fx_ta"))


@query("p18_round", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def p18(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r(c("l_extendedprice") * (1 - c("l_discount")), 4).alias("net"))


THR = "th AS (SELECT series, CASE WHEN count(y) >= 20 THEN quantile_cont(y, 0.9) END AS thr FROM h GROUP BY series)"


@query("p19_label", f"WITH {PANEL}, {THR} SELECT h.series, t, CASE WHEN y IS NOT NULL THEN CAST(y > thr AS DOUBLE) END AS label FROM h JOIN th ON th.series = h.series")
def p19(spark, sf):
    from .backtest import thresholds
    h = panel(spark, sf)
    return h.join(thresholds(h, "series"), "series").select("series", "t", F.when(c("y").isNotNull(), (c("y") > c("thr")).cast("double")).alias("label"))


@query("p20_confusion", "SELECT l_returnflag, CASE WHEN l_quantity > 25 AND l_tax > 0.04 THEN 'TP' WHEN l_tax > 0.04 THEN 'FP' WHEN l_quantity > 25 THEN 'FN' ELSE 'TN' END AS cell, count(*) AS n FROM lineitem GROUP BY ALL")
def p20(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", qc.confusion(c("l_quantity") > 25, c("l_tax") > 0.04).alias("cell")).groupBy("l_returnflag", "cell").agg(F.count(lit(1)).alias("n"))


# --- joins

HL = f"{PANEL}, a AS (SELECT series, t, y FROM h WHERE t % 3 <> 0), b AS (SELECT series, t, ta FROM h WHERE t % 2 = 0)"


def halves(spark, sf):
    h = panel(spark, sf)
    return h.where(F.pmod("t", lit(3)) != 0).select("series", "t", "y"), h.where(F.pmod("t", lit(2)) == 0).select("series", "t", "ta")


@query("j1_full_outer", f"WITH {HL} SELECT coalesce(a.series, b.series) AS series, coalesce(a.t, b.t) AS t, round(y, 4) AS y, round(ta, 4) AS ta FROM a FULL JOIN b ON a.series = b.series AND a.t = b.t")
def j1(spark, sf):
    a, b = halves(spark, sf)
    return a.join(b, ["series", "t"], "full").select("series", "t", r("y").alias("y"), r("ta").alias("ta"))


@query("j2_left_layers", f"WITH {HL} SELECT a.series, a.t, round(y, 4) AS y, round(ta, 4) AS ta FROM a LEFT JOIN b ON a.series = b.series AND a.t = b.t")
def j2(spark, sf):
    a, b = halves(spark, sf)
    return a.join(b, ["series", "t"], "left").select("series", "t", r("y").alias("y"), r("ta").alias("ta"))


@query("j3_left_time_series", "SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def j3(spark, sf):
    return table(spark, sf, "lineitem").join(table(spark, sf, "orders"), c("l_orderkey") == c("o_orderkey"), "left").select("l_orderkey", "l_linenumber", "o_orderpriority")


@query("j4_three_way", f"SELECT d, a, b, n FROM (SELECT {EPOCH.format('l_shipdate')} AS d, count(*) AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) FULL JOIN (SELECT {EPOCH.format('l_shipdate')} AS d, count(*) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) USING (d) FULL JOIN (SELECT {EPOCH.format('o_orderdate')} AS d, count(*) AS n FROM orders GROUP BY 1) USING (d)")
def j4(spark, sf):
    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    part = lambda f, n: l.where(c("l_returnflag") == f).groupBy(days(c("l_shipdate")).alias("d")).agg(F.count(lit(1)).alias(n))
    return part("A", "a").join(part("R", "b"), "d", "full").join(o.groupBy(days(c("o_orderdate")).alias("d")).agg(F.count(lit(1)).alias("n")), "d", "full")


@query("j5_result_delta", "SELECT x.l_returnflag, round(x.q - y.q, 4) AS delta FROM (SELECT l_returnflag, avg(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) x JOIN (SELECT l_returnflag, avg(l_quantity) AS q FROM lineitem GROUP BY 1) y ON x.l_returnflag = y.l_returnflag")
def j5(spark, sf):
    l = table(spark, sf, "lineitem")
    a = l.where("l_linestatus = 'F'").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("q_a"))
    return a.join(l.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("q_b")), "l_returnflag").select("l_returnflag", r(c("q_a") - c("q_b")).alias("delta"))


@query("j6_outer_results", "SELECT k, a, b, n FROM (SELECT s_nationkey AS k, count(*) AS a FROM supplier GROUP BY 1) FULL JOIN (SELECT c_nationkey AS k, count(*) AS b FROM customer GROUP BY 1) USING (k) FULL JOIN (SELECT n_nationkey AS k, n_regionkey AS n FROM nation) USING (k)")
def j6(spark, sf):
    a = table(spark, sf, "supplier").groupBy(c("s_nationkey").alias("k")).agg(F.count(lit(1)).alias("a"))
    b = table(spark, sf, "customer").groupBy(c("c_nationkey").alias("k")).agg(F.count(lit(1)).alias("b"))
    return a.join(b, "k", "full").join(table(spark, sf, "nation").select(c("n_nationkey").alias("k"), c("n_regionkey").alias("n")), "k", "full")


@query("j7_theta", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND concat('Customer#', right(s_name, 9)) = c_name")
def j7(spark, sf):
    s, cu = table(spark, sf, "supplier"), table(spark, sf, "customer")
    return s.join(cu, (c("s_nationkey") == c("c_nationkey")) & (F.concat(lit("Customer#"), F.right("s_name", lit(9))) == c("c_name"))).select("s_suppkey", "c_custkey")


def probes_and_events(spark, sf):
    h = panel(spark, sf).select("series", "t")
    e = table(spark, sf, "events").where("event_type = 'error'").select(hours("ts").alias("t"), "value")
    return h, e


ASOF = "er AS (SELECT date_diff('hour', TIMESTAMP '1970-01-01', date_trunc('hour', ts)) AS t, max(value) AS value FROM events WHERE event_type = 'error' GROUP BY 1)"


@query("j8_asof", f"WITH {PANEL}, {ASOF} SELECT h.series, h.t, er.t AS event_t, round(er.value, 4) AS event_value FROM h ASOF LEFT JOIN er ON h.t >= er.t")
def j8(spark, sf):
    from ..operators.asof import asof
    h, e = probes_and_events(spark, sf)
    return h.join(asof(h.select("t", lit("error").alias("channel")).distinct(), e.withColumn("channel", lit("error")), ["channel"], "value"), "t").select("series", "t", "event_t", r("event_value").alias("event_value"))


@query("j10_day_hour_lookup", f"WITH {PANEL}, m AS (SELECT t // 24 AS d, t % 24 AS hr, avg(y) AS m FROM h GROUP BY ALL) SELECT h.series, h.t, round(m, 4) AS m FROM h LEFT JOIN m ON m.d = h.t // 24 AND m.hr = h.t % 24")
def j10(spark, sf):
    h = panel(spark, sf).withColumn("d", F.floor(c("t") / 24)).withColumn("hr", F.pmod("t", lit(24)))
    return h.join(h.groupBy("d", "hr").agg(F.avg("y").alias("m")), ["d", "hr"], "left").select("series", "t", r("m").alias("m"))


@query("j12_spread_daily", f"WITH {PANEL}, m AS (SELECT series, t // 24 AS d, avg(y) AS m FROM h GROUP BY ALL) SELECT h.series, h.t, round(m, 4) AS m FROM h JOIN m ON m.series = h.series AND m.d = h.t // 24")
def j12(spark, sf):
    h = panel(spark, sf).withColumn("d", F.floor(c("t") / 24))
    return h.join(h.groupBy("series", "d").agg(F.avg("y").alias("m")), ["series", "d"]).select("series", "t", r("m").alias("m"))


@query("j13_target_time", f"WITH {PANEL} SELECT f.series, f.t AS origin, f.t + 24 AS tt, round(a.y, 4) AS y, round(f.y, 4) AS persist FROM h f JOIN h a ON a.series = f.series AND a.t = f.t + 24")
def j13(spark, sf):
    h = panel(spark, sf)
    f = h.select("series", c("t").alias("origin"), (c("t") + 24).alias("tt"), c("y").alias("persist"))
    return f.join(h.select("series", c("t").alias("tt"), "y"), ["series", "tt"]).select("series", "origin", "tt", r("y").alias("y"), r("persist").alias("persist"))


@query("j14_anti_masked", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def j14(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "lineitem").where("l_returnflag = 'R'"), c("o_orderkey") == c("l_orderkey"), "left_anti").select("o_orderkey")


@query("j15_semi_scope", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def j15(spark, sf):
    return table(spark, sf, "supplier").join(table(spark, sf, "nation").where("n_regionkey = 1"), c("s_nationkey") == c("n_nationkey"), "left_semi").select("s_suppkey")


@query("j16_missing_steps", f"WITH {PANEL} SELECT series, t FROM gr EXCEPT SELECT series, t FROM ev")
def j16(spark, sf):
    e = readings(spark, sf).select("series", "t")
    return complete_grid(e, ["series"]).join(e, ["series", "t"], "left_anti").select("series", "t")


@query("j17_dimension", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def j17(spark, sf):
    dim = table(spark, sf, "nation").join(table(spark, sf, "region"), c("n_regionkey") == c("r_regionkey"))
    return table(spark, sf, "customer").join(dim, c("c_nationkey") == c("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("j18_block_lookup", f"WITH {PANEL}, f AS (SELECT series, min(t) AS a FROM h GROUP BY series), k AS (SELECT h.series, (t - a) // 168 AS b, avg(y) AS m FROM h JOIN f ON f.series = h.series GROUP BY ALL) SELECT h.series, h.t, round(m, 4) AS m FROM h JOIN f ON f.series = h.series JOIN k ON k.series = h.series AND k.b = (h.t - a) // 168")
def j18(spark, sf):
    h = panel(spark, sf)
    h = h.join(h.groupBy("series").agg(F.min("t").alias("a")), "series").withColumn("b", F.floor((c("t") - c("a")) / 168))
    return h.join(h.groupBy("series", "b").agg(F.avg("y").alias("m")), ["series", "b"]).select("series", "t", r("m").alias("m"))


@query("j19_column_bind", f"WITH {PANEL} SELECT a.t, round(a.y, 4) AS y_click, round(b.y, 4) AS y_error FROM h a JOIN h b ON a.t = b.t WHERE a.series = 'click' AND b.series = 'error'")
def j19(spark, sf):
    h = panel(spark, sf)
    a, b = (h.where(c("series") == s).select("t", r("y").alias(f"y_{s}")) for s in ("click", "error"))
    return a.join(b, "t")


# --- aggregations


@query("a1_hourly_mean", f"WITH {PANEL} SELECT series, t, round(y, 4) AS y, round(ta, 4) AS ta FROM h")
def a1(spark, sf):
    return panel(spark, sf).select("series", "t", r("y").alias("y"), r("ta").alias("ta"))


D24 = f"WITH {PANEL}, z AS (SELECT *, t // 24 AS d FROM h)"


def by_day(spark, sf):
    return panel(spark, sf).withColumn("d", F.floor(c("t") / 24)).groupBy("series", "d")


@query("a2_daily_mean", f"{D24} SELECT series, d, round(avg(y), 4) AS y FROM z GROUP BY ALL")
def a2(spark, sf):
    return by_day(spark, sf).agg(r(F.avg("y")).alias("y"))


@query("a3_daily_min_max_sum", f"{D24} SELECT series, d, round(min(y), 4) AS lo, round(max(y), 4) AS hi, round(coalesce(sum(y), 0), 4) AS s FROM z GROUP BY ALL")
def a3(spark, sf):
    return by_day(spark, sf).agg(r(F.min("y")).alias("lo"), r(F.max("y")).alias("hi"), r(F.coalesce(F.sum("y"), lit(0.0))).alias("s"))


@query("a4_gated_mean", f"{D24} SELECT series, d, round(CASE WHEN count(y) >= 22 THEN avg(y) END, 4) AS y FROM z GROUP BY ALL")
def a4(spark, sf):
    return by_day(spark, sf).agg(r(F.when(F.count("y") >= 22, F.avg("y"))).alias("y"))


@query("a5_circular", f"{D24} SELECT series, d, round(avg(sin(radians(y))), 4) AS s, round(avg(cos(radians(y))), 4) AS k FROM z GROUP BY ALL")
def a5(spark, sf):
    s, k = X.wind(c("y"))
    return by_day(spark, sf).agg(r(F.avg(s)).alias("s"), r(F.avg(k)).alias("k"))


@query("a6_row_mean", f"WITH {PANEL} SELECT series, t, round(list_avg(list_filter([y, ta, sw], lambda x: x IS NOT NULL)), 4) AS m FROM h")
def a6(spark, sf):
    return panel(spark, sf).select("series", "t", r(qc.row_mean(["y", "ta", "sw"])).alias("m"))


@query("a7_weighted_sum", "SELECT l_orderkey, round(sum(l_quantity * CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.1 ELSE 0.05 END), 4) AS lsu FROM lineitem GROUP BY ALL")
def a7(spark, sf):
    w = F.when(c("l_returnflag") == "A", 1.0).when(c("l_returnflag") == "N", 0.1).otherwise(0.05)
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(r(F.sum(c("l_quantity") * w)).alias("lsu"))


@query("a8_density", "SELECT l_partkey, round(sum(l_quantity) / any_value(p_size), 4) AS density, sum(l_quantity) > 0 AS grazing FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def a8(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), c("l_partkey") == c("p_partkey"))
    return j.groupBy("l_partkey").agg(r(F.sum("l_quantity") / F.any_value("p_size")).alias("density"), (F.sum("l_quantity") > 0).alias("grazing"))


@query("a9_daily_total", f"SELECT {EPOCH.format('l_shipdate')} AS d, round(sum(l_quantity), 2) AS head FROM lineitem GROUP BY ALL")
def a9(spark, sf):
    return table(spark, sf, "lineitem").groupBy(days(c("l_shipdate")).alias("d")).agg(r(F.sum("l_quantity"), 2).alias("head"))


@query("a10_ribbon", f"{D24} SELECT d, round(quantile_cont(y, 0.05), 4) AS q05, round(quantile_cont(y, 0.5), 4) AS q50, round(quantile_cont(y, 0.95), 4) AS q95 FROM z GROUP BY ALL")
def a10(spark, sf):
    p = panel(spark, sf).select(F.floor(c("t") / 24).alias("d"), "y")
    q = p.select("d").distinct().join(quantiles(p, ["d"], "y", [0.05, 0.5, 0.95]), "d", "left")
    return q.select("d", *[r(c("q")[i]).alias(n) for i, n in enumerate(("q05", "q50", "q95"))])


MONTHS = list(range(1, 13))
VALID = f"WITH {PANEL}, z AS (SELECT series, year(x) AS yr, month(x) AS mo, 100.0 * CAST(y IS NOT NULL AS INT) AS ok FROM (SELECT *, DATE '1970-01-01' + CAST(t // 24 AS INT) AS x FROM h))"


def validity(spark, sf):
    """(series, yr, mo, ok): 100 for hours with a value, else 0."""
    day = F.date_add(lit("1970-01-01").cast("date"), F.floor(c("t") / 24).cast("int"))
    return panel(spark, sf).select("series", F.year(day).alias("yr"), F.month(day).alias("mo"), (c("y").isNotNull().cast("int") * 100.0).alias("ok"))


@query("a11_availability", f"{VALID} SELECT yr, " + ", ".join(f"round(avg(ok) FILTER (mo = {m}), 4) AS m{m}" for m in MONTHS) + " FROM z GROUP BY yr")
def a11(spark, sf):
    p = validity(spark, sf).groupBy("yr").pivot("mo", MONTHS).agg(F.avg("ok"))
    return p.select("yr", *[r(c(str(m))).alias(f"m{m}") for m in MONTHS])


@query("a11_availability_by_station", f"{VALID} SELECT series, yr, round(avg(ok), 4) AS available FROM z GROUP BY ALL")
def a11b(spark, sf):
    return validity(spark, sf).groupBy("series", "yr").agg(r(F.avg("ok")).alias("available"))


@query("a12_median_by_hour", f"WITH {PANEL} SELECT t % 24 AS hr, round(median(y), 4) AS y FROM h GROUP BY ALL")
def a12(spark, sf):
    return medians(panel(spark, sf).withColumn("hr", F.pmod("t", lit(24))), ["hr"], "y", "y").select("hr", r("y").alias("y"))


@query("a13_annual", "SELECT year(o_orderdate) AS yr, round(median(o_totalprice), 2) AS med, round(stddev_samp(o_totalprice), 2) AS sd, count(*) AS n, round(stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS se FROM orders GROUP BY ALL")
def a13(spark, sf):
    v = F.stddev_samp("o_totalprice")
    o = table(spark, sf, "orders").withColumn("yr", F.year("o_orderdate").cast("long"))
    med = medians(o, ["yr"], "o_totalprice").select("yr", r("med", 2).alias("med"))
    return med.join(o.groupBy("yr").agg(r(v, 2).alias("sd"), F.count(lit(1)).alias("n"), r(v / F.sqrt(F.count(lit(1)))).alias("se")), "yr")


@query("a14_correlation", f"WITH {PANEL} SELECT series, round(corr(y, ta), 4) AS y_ta, round(corr(y, sw), 4) AS y_sw, round(corr(ta, sw), 4) AS ta_sw FROM h WHERE y IS NOT NULL AND ta IS NOT NULL GROUP BY ALL")
def a14(spark, sf):
    return panel(spark, sf).na.drop(subset=["y", "ta", "sw"]).groupBy("series").agg(r(F.corr("y", "ta")).alias("y_ta"), r(F.corr("y", "sw")).alias("y_sw"), r(F.corr("ta", "sw")).alias("ta_sw"))


@query("a15_value_counts", "SELECT p_brand, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, p_brand LIMIT 15")
def a15(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count(lit(1)).alias("n")).orderBy(c("n").desc(), "p_brand").limit(15)


@query("a16_describe", f"WITH {PANEL} SELECT series, count(y) AS n, round(avg(y), 4) AS mean, round(stddev_samp(y), 4) AS sd, round(min(y), 4) AS lo, round(quantile_cont(y, 0.25), 4) AS q25, round(quantile_cont(y, 0.5), 4) AS q50, round(quantile_cont(y, 0.75), 4) AS q75, round(max(y), 4) AS hi FROM h GROUP BY ALL")
def a16(spark, sf):
    h = panel(spark, sf)
    q = quantiles(h, ["series"], "y", [0.25, 0.5, 0.75]).select("series", *[r(c("q")[i]).alias(n) for i, n in enumerate(("q25", "q50", "q75"))])
    return h.groupBy("series").agg(F.count("y").alias("n"), r(F.avg("y")).alias("mean"), r(F.stddev_samp("y")).alias("sd"), r(F.min("y")).alias("lo"), r(F.max("y")).alias("hi")).join(q, "series", "left")


@query("a17_coverage", f"WITH {PANEL} SELECT series, count(y) AS n_y, round(100.0 * count(y) / count(*), 4) AS pct_y, count(ta) AS n_ta FROM h GROUP BY ALL")
def a17(spark, sf):
    return panel(spark, sf).groupBy("series").agg(F.count("y").alias("n_y"), r(F.count("y") * 100.0 / F.count(lit(1))).alias("pct_y"), F.count("ta").alias("n_ta"))


@query("a18_best_coverage", f"WITH {PANEL}, k AS (SELECT series, 'y' AS col, count(y) AS n FROM h GROUP BY ALL UNION ALL SELECT series, 'ta', count(ta) FROM h GROUP BY ALL) SELECT series, arg_max(col, n * 10 + CAST(col = 'y' AS INT)) AS best, max(n) AS n FROM k GROUP BY ALL")
def a18(spark, sf):
    k = panel(spark, sf).unpivot(["series", "t"], ["y", "ta"], "col", "v").groupBy("series", "col").agg(F.count("v").alias("n"))
    return k.groupBy("series").agg(F.max_by("col", c("n") * 10 + (c("col") == "y").cast("int")).alias("best"), F.max("n").alias("n"))


@query("a19_out_of_range", "SELECT event_type AS series, round(quantile_cont(value, 0.01), 4) AS q01, round(quantile_cont(value, 0.99), 4) AS q99, count(*) FILTER (value > 300 OR value < 1) AS n_out FROM events GROUP BY ALL")
def a19(spark, sf):
    v = c("value")
    e = table(spark, sf, "events").select(c("event_type").alias("series"), "value")
    q = quantiles(e, ["series"], "value", [0.01, 0.99]).select("series", r(c("q")[0]).alias("q01"), r(c("q")[1]).alias("q99"))
    return e.groupBy("series").agg(F.count_if((v > 300) | (v < 1)).alias("n_out")).join(q, "series", "left")


@query("a20_split_counts", f"WITH {DAILY} SELECT series, CASE WHEN d < 10957 THEN 'train' ELSE 'test' END AS split, count(y) AS valid, count(*) AS n FROM o GROUP BY ALL")
def a20(spark, sf):
    return daily(spark, sf).groupBy("series", F.when(c("d") < 10957, "train").otherwise("test").alias("split")).agg(F.count("y").alias("valid"), F.count(lit(1)).alias("n"))


@query("a22_thresholds", f"WITH {PANEL}, {THR} SELECT series, round(thr, 4) AS thr FROM th")
def a22(spark, sf):
    from .backtest import thresholds
    return thresholds(panel(spark, sf), "series").select("series", r("thr").alias("thr"))


@query("a25_best_row", "SELECT o_custkey, max_by(o_orderkey, {'p': o_totalprice, 'k': o_orderkey}) AS best FROM orders GROUP BY ALL")
def a25(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"))


@query("a26_best_over", "SELECT o_orderpriority, max(o_totalprice) AS top, max_by(o_orderstatus, {'p': o_totalprice, 's': o_orderstatus}) AS status FROM orders GROUP BY ALL")
def a26(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.max("o_totalprice").alias("top"), F.max_by("o_orderstatus", F.struct("o_totalprice", "o_orderstatus")).alias("status"))


@query("a28_keep_first", "SELECT series, t, event_id FROM (SELECT event_type AS series, date_diff('hour', TIMESTAMP '1970-01-01', date_trunc('hour', ts)) AS t, event_id, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def a28(spark, sf):
    e = table(spark, sf, "events").select(c("event_type").alias("series"), hours("ts").alias("t"), "ts", "event_id")
    return qc.keep_first(e, ["series", "t"], [c("ts"), c("event_id")]).drop("ts")


@query("a29_keep_last", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def a29(spark, sf):
    return qc.keep_first(table(spark, sf, "orders"), ["o_custkey"], [c("o_orderdate").desc(), c("o_orderkey").desc()]).select("o_custkey", "o_orderkey")


@query("a30_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def a30(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query("a31_entities", f"SELECT event_type AS series, count(DISTINCT user_id) AS users, min(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))) AS d0, max(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))) AS d1 FROM events GROUP BY ALL")
def a31(spark, sf):
    d = F.floor(hours("ts") / 24)
    return table(spark, sf, "events").groupBy(c("event_type").alias("series")).agg(F.countDistinct("user_id").alias("users"), F.min(d).alias("d0"), F.max(d).alias("d1"))


@query("a32_group_mean_back", f"WITH {PANEL} SELECT series, t, round(avg(y) OVER (PARTITION BY series, t % 24), 4) AS m FROM h")
def a32(spark, sf):
    h = panel(spark, sf).withColumn("hr", F.pmod("t", lit(24)))
    return h.join(h.groupBy("series", "hr").agg(F.avg("y").alias("m")), ["series", "hr"]).select("series", "t", r("m").alias("m"))


@query("a34_duplicate_steps", "SELECT event_type AS series, ts, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def a34(spark, sf):
    return table(spark, sf, "events").groupBy(c("event_type").alias("series"), "ts").agg(F.count(lit(1)).alias("n")).where("n > 1")


@query("a35_day_quality", f"{D24} SELECT series, d, round(count(y) * 1.0 / count(*), 4) AS valid, round(avg(1 - CAST(y IS NOT NULL AS INT)), 4) AS filled FROM z GROUP BY ALL")
def a35(spark, sf):
    return by_day(spark, sf).agg(r(F.count("y") / F.count(lit(1))).alias("valid"), r(F.avg(1 - c("y").isNotNull().cast("int"))).alias("filled"))


# --- sort, limit, sets


@query("o1_sort", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey")
def o1(spark, sf):
    return table(spark, sf, "orders").orderBy("o_orderdate", "o_orderkey").select("o_orderkey")


@query("o4_first_offenders", "SELECT event_id FROM events WHERE value > 300 ORDER BY event_id LIMIT 5")
def o4(spark, sf):
    return table(spark, sf, "events").where("value > 300").orderBy("event_id").limit(5).select("event_id")


@query("o5_seeded_sample", "SELECT o_orderkey FROM orders ORDER BY (o_orderkey * 48271) % 2147483647, o_orderkey LIMIT 600")
def o5(spark, sf):
    return table(spark, sf, "orders").orderBy((c("o_orderkey") * 48271) % 2147483647, "o_orderkey").limit(600).select("o_orderkey")


@query("u1_union_reconcile", "SELECT s_suppkey AS k, s_acctbal AS bal, NULL AS seg FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def u1(spark, sf):
    a = table(spark, sf, "supplier").select(c("s_suppkey").alias("k"), c("s_acctbal").alias("bal"))
    return a.unionByName(table(spark, sf, "customer").select(c("c_custkey").alias("k"), c("c_acctbal").alias("bal"), c("c_mktsegment").alias("seg")), allowMissingColumns=True)


@query("u2_pool", f"WITH {PANEL}, {DAILY} SELECT 'hourly' AS track, series, count(*) AS n FROM h GROUP BY ALL UNION ALL SELECT 'daily', series, count(*) FROM o GROUP BY ALL")
def u2(spark, sf):
    a, b = panel(spark, sf).select(lit("hourly").alias("track"), "series"), daily(spark, sf).select(lit("daily").alias("track"), "series")
    return a.unionByName(b).groupBy("track", "series").agg(F.count(lit(1)).alias("n"))


@query("u3_difference", f"WITH {PANEL} SELECT t FROM gr WHERE series = 'click' EXCEPT SELECT t FROM ev WHERE series = 'click'")
def u3(spark, sf):
    e = readings(spark, sf).select("series", "t")
    return complete_grid(e, ["series"]).where("series = 'click'").select("t").subtract(e.where("series = 'click'").select("t"))


@query("u4_replace_tag", "SELECT n_nationkey AS k, CASE WHEN n_regionkey = 1 THEN 'new' ELSE 'old' END AS v FROM nation")
def u4(spark, sf):
    n = table(spark, sf, "nation")
    old = n.select(c("n_nationkey").alias("k"), lit("old").alias("v"), "n_regionkey")
    new = n.where("n_regionkey = 1").select(c("n_nationkey").alias("k"), lit("new").alias("v"), "n_regionkey")
    return old.join(new.select("n_regionkey").distinct(), "n_regionkey", "left_anti").unionByName(new).select("k", "v")


# --- reshape


@query("h1_melt", "SELECT l_orderkey, l_linenumber, measure, value FROM (SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem) UNPIVOT (value FOR measure IN (quantity, discount, tax))")
def h1(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", c("l_quantity").alias("quantity"), c("l_discount").alias("discount"), c("l_tax").alias("tax"))
    return l.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "discount", "tax"], "measure", "value").where("value IS NOT NULL")


@query("h2_pivot", "SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS F, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS O FROM lineitem GROUP BY ALL")
def h2(spark, sf):
    p = table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity"))
    return p.select("l_returnflag", r("F", 2).alias("F"), r("O", 2).alias("O"))


@query("h3_stations", f"WITH {PANEL} SELECT series, t, variable, round(value, 4) AS value FROM (SELECT series, t, y, ta FROM h) UNPIVOT (value FOR variable IN (y, ta))")
def h3(spark, sf):
    wide = panel(spark, sf).select("series", "t", c("y").alias("y [v]"), c("ta").alias("ta [v]"))
    long = wide.unpivot(["series", "t"], ["y [v]", "ta [v]"], "name", "value").where("value IS NOT NULL")
    return long.select("series", "t", F.split("name", r" \[")[0].alias("variable"), r("value").alias("value"))


@query("h4_expand_daily", f"WITH {DAILY}, s AS (SELECT series, min(d) * 24 AS a, max(d) * 24 AS b FROM o GROUP BY series), g AS (SELECT series, unnest(generate_series(a, b)) AS t FROM s) SELECT g.series, g.t, round(o.y, 6) AS y FROM g LEFT JOIN o ON o.series = g.series AND o.d = g.t // 24")
def h4(spark, sf):
    return expand_daily(daily(spark, sf), ["series"], ["y"]).select("series", "t", r("y", 6).alias("y"))


@query("h5_species_column", "SELECT 'supplier' AS species, s_nationkey AS k, count(*) AS n FROM supplier GROUP BY ALL UNION ALL SELECT 'customer', c_nationkey, count(*) FROM customer GROUP BY ALL")
def h5(spark, sf):
    part = lambda t, k: table(spark, sf, t).groupBy(c(k).alias("k")).agg(F.count(lit(1)).alias("n")).select(lit(t).alias("species"), "k", "n")
    return part("supplier", "s_nationkey").unionByName(part("customer", "c_nationkey"))


# --- scalars


@query("x1_cyclic", f"WITH {PANEL} SELECT series, t, round(sin(2 * pi() * (t % 24) / 24), 4) AS hs, round(cos(2 * pi() * dayofyear(DATE '1970-01-01' + CAST(t // 24 AS INT)) / 365), 4) AS dc FROM h")
def x1(spark, sf):
    doy = F.dayofyear(F.date_add(lit("1970-01-01").cast("date"), F.floor(c("t") / 24).cast("int")))
    return panel(spark, sf).select("series", "t", r(X.cyclic(F.pmod("t", lit(24)), 24)[0]).alias("hs"), r(X.cyclic(doy, 365)[1]).alias("dc"))


@query("x2_wind", "SELECT event_id, round(sin(radians(value)), 4) AS s, round(cos(radians(value)), 4) AS k FROM events")
def x2(spark, sf):
    s, k = X.wind(c("value"))
    return table(spark, sf, "events").select("event_id", r(s).alias("s"), r(k).alias("k"))


@query("x3_seasons", "SELECT o_orderkey, month(o_orderdate) BETWEEN 4 AND 9 AS growing, month(o_orderdate) IN (12, 1, 2) AS winter, (o_orderkey % 24) * 20 > 10 AS daytime FROM orders")
def x3(spark, sf):
    m = F.month("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", m.between(4, 9).alias("growing"), m.isin(12, 1, 2).alias("winter"), ((c("o_orderkey") % 24) * 20 > 10).alias("daytime"))


@query("x4_recency", f"WITH {PANEL}, {ASOF} SELECT h.series, h.t, round(coalesce(exp(-(h.t - er.t) / 24.0 / 14.0), 0), 4) AS recency, round(coalesce(er.value * exp(-(h.t - er.t) / 24.0 / 14.0), 0), 4) AS rate FROM h ASOF LEFT JOIN er ON h.t >= er.t")
def x4(spark, sf):
    from ..operators.asof import asof, recency
    h, e = probes_and_events(spark, sf)
    j = h.join(asof(h.select("t", lit("error").alias("channel")).distinct(), e.withColumn("channel", lit("error")), ["channel"], "value"), "t")
    k = recency((c("t") - c("event_t")) / 24.0, 14)
    return j.select("series", "t", r(k).alias("recency"), r(F.coalesce(c("event_value") * k, lit(0.0))).alias("rate"))


@query("x5_units", "SELECT event_id, round(value / 3.6, 4) AS ms FROM events")
def x5(spark, sf):
    return table(spark, sf, "events").select("event_id", r(c("value") / 3.6).alias("ms"))


@query("x6_asinh", "SELECT event_id, round(asinh(value), 4) AS z, round(sinh(asinh(value)), 4) AS back FROM events")
def x6(spark, sf):
    z = F.asinh("value")
    return table(spark, sf, "events").select("event_id", r(z).alias("z"), r(F.sinh(z)).alias("back"))


@query("x7_smearing", f"WITH {PANEL}, m AS (SELECT series, avg(asinh(y)) AS z FROM h GROUP BY series), q AS (SELECT h.series, any_value(z) AS z, quantile_cont(asinh(y) - z, [0.01 + 0.98 * i / 20.0 for i in range(0, 21)]) AS q FROM h JOIN m ON m.series = h.series GROUP BY h.series) SELECT series, round(list_avg([sinh(z + x) for x in q]), 4) AS p FROM q")
def x7(spark, sf):
    h = panel(spark, sf).withColumn("a", F.asinh("y"))
    h = h.join(h.groupBy("series").agg(F.avg("a").alias("z")), "series")
    q = quantiles(h, ["series", "z"], c("a") - c("z"), [0.01 + 0.98 * i / 20 for i in range(21)])
    return q.select("series", r(X.smear(c("z"), c("q"))).alias("p"))


@query("x8_lloyd_taylor", f"WITH {PANEL} SELECT series, t, round(3.0 * exp(200.0 * (1 / (10.0 + 46.02) - 1 / (ta + 46.02))), 4) AS reco FROM h")
def x8(spark, sf):
    return panel(spark, sf).select("series", "t", r(X.lloyd_taylor(lit(3.0), 200.0, c("ta"))).alias("reco"))


@query("x9_gpp", f"WITH {PANEL} SELECT series, t, round(CASE WHEN sw < 20 THEN 0 WHEN y IS NOT NULL AND ta IS NOT NULL THEN greatest(ta * 20 - y, 0) END, 4) AS gpp FROM h")
def x9(spark, sf):
    return panel(spark, sf).select("series", "t", r(X.gpp(c("ta") * 20, c("y"), c("sw"))).alias("gpp"))


@query("x10_low_turbulence", f"WITH {PANEL} SELECT series, t, CAST(sw < 20 AND ta / 30 < 0.4 AS INT) AS low FROM h")
def x10(spark, sf):
    return panel(spark, sf).select("series", "t", X.low_turbulence(c("sw"), c("ta") / 30, 0.4).alias("low"))


@query("x11_product", f"WITH {PANEL} SELECT series, t, round(sw * ta, 4) AS x FROM h")
def x11(spark, sf):
    return panel(spark, sf).select("series", "t", r(c("sw") * c("ta")).alias("x"))


@query("x12_doy_distance", "SELECT o_orderkey, least(abs(dayofyear(o_orderdate) - 10), 365 - abs(dayofyear(o_orderdate) - 10)) AS dist FROM orders")
def x12(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.doy_distance(F.dayofyear("o_orderdate"), lit(10)).cast("long").alias("dist"))


@query("x13_clip", "WITH q AS (SELECT quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM events) SELECT event_id, round(greatest(a, least(b, value)), 4) AS v, greatest(10.0, least(100.0, value)) AS w FROM events, q")
def x13(spark, sf):
    e = table(spark, sf, "events")
    q = quantiles(e, [], "value", [0.05, 0.95]).select(c("q")[0].alias("a"), c("q")[1].alias("b"))  # one row
    return e.join(F.broadcast(q)).select("event_id", r(F.greatest("a", F.least("b", "value"))).alias("v"), X.clip(c("value"), 10.0, 100.0).alias("w"))


@query("x14_strings", "SELECT p_partkey, lower(p_type) AS lo, contains(p_type, 'STEEL') AS steel, starts_with(p_type, 'ECONOMY') AS eco, split_part(p_name, ' ', 1) AS first, regexp_matches(p_brand, '^Brand#[1-3]') AS low FROM part")
def x14(spark, sf):
    t = c("p_type")
    return table(spark, sf, "part").select("p_partkey", F.lower(t).alias("lo"), t.contains("STEEL").alias("steel"), t.startswith("ECONOMY").alias("eco"), F.split("p_name", " ")[0].alias("first"), c("p_brand").rlike("^Brand#[1-3]").alias("low"))


@query("x15_date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(dayofyear(o_orderdate) AS INT) AS doy FROM orders")
def x15(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.dayofyear("o_orderdate").alias("doy"))


@query("x16_day_first", f"SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN {EPOCH.format('o_orderdate')} END AS d FROM orders")
def x16(spark, sf):
    text = F.when(c("o_orderkey") % 7 == 0, "32/13/1999").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", days(X.parse_time(text, "dd/MM/yyyy")).alias("d"))


@query("x17_sort_quantiles", "SELECT l_orderkey, l_linenumber, list_sort([l_discount, l_tax, 0.05::DOUBLE])[2] AS mid FROM lineitem")
def x17(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_sort(F.array("l_discount", "l_tax", lit(0.05)))[1].alias("mid"))


@query("x18_conformal_level", f"WITH {PANEL} SELECT series, round(least(1.0, ceil((count(y) + 1) * 0.9) / count(y)), 6) AS level FROM h GROUP BY ALL")
def x18(spark, sf):
    return panel(spark, sf).groupBy("series").agg(r(X.conformal_level(F.count("y")), 6).alias("level"))


@query("x20_standardise", f"WITH {PANEL}, m AS (SELECT series, avg(y) AS a, stddev_pop(y) AS s FROM h GROUP BY series) SELECT h.series, t, round((y - a) / (s + 0.000001), 4) AS z FROM h JOIN m ON m.series = h.series")
def x20(spark, sf):
    h = panel(spark, sf)
    m = h.groupBy("series").agg(F.avg("y").alias("a"), F.stddev_pop("y").alias("s"))
    return h.join(m, "series").select("series", "t", r((c("y") - c("a")) / (c("s") + 1e-6)).alias("z"))
