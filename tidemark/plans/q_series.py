"""Queries: windows, gaps, flux composites, baselines, metrics, intervals and models."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import flux, gaps, metrics as M
from ..operators.asof import mds
from ..operators.grid import align, centred, ffill_limit, lags, lookback_arrays, quantile_bins, rolling
from ..operators.qc import confusion
from ..operators.select import medians
from ..sources.scratch import kept, scratch
from . import backtest as B
from .registry import DAILY, PANEL, daily, panel, query, r, table

c, lit = F.col, F.lit
K = ["series"]
HP = f"WITH {PANEL}"
W = "WINDOW w AS (PARTITION BY series ORDER BY t)"

# --- windows


@query("w1_lags", f"{HP} SELECT series, t, round(lag(y, 1) OVER w, 4) AS l1, round(lag(y, 24) OVER w, 4) AS l24, round(lag(y, 168) OVER w, 4) AS l168 FROM h {W}")
def w1(spark, sf):
    return lags(panel(spark, sf), K, "y", [1, 24, 168], chunk=200).select("series", "t", *[r(f"y_lag{k}").alias(f"l{k}") for k in (1, 24, 168)])


@query("w2_leads", f"{HP} SELECT series, t, round(lead(y, 1) OVER w, 4) AS y1, round(lead(y, 24) OVER w, 4) AS y24 FROM h {W}")
def w2(spark, sf):
    return lags(panel(spark, sf), K, "y", [-1, -24], chunk=200).select("series", "t", r("y_lead1").alias("y1"), r("y_lead24").alias("y24"))


@query("w3_trailing_without_origin", f"{HP} SELECT series, t, round(avg(y) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 4) AS m, round(stddev_samp(y) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 4) AS s FROM h")
def w3(spark, sf):
    return rolling(panel(spark, sf), K, "y", 24, {"m": F.avg, "s": F.stddev_samp}, False, chunk=200).select("series", "t", r("m").alias("m"), r("s").alias("s"))


@query("w4_trailing_with_origin", f"{HP} SELECT series, t, round(avg(y) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 167 PRECEDING AND CURRENT ROW), 4) AS m, round(sum(y) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 167 PRECEDING AND CURRENT ROW), 4) AS s FROM h")
def w4(spark, sf):
    return rolling(panel(spark, sf), K, "y", 168, {"m": F.avg, "s": F.sum}, True, chunk=200).select("series", "t", r("m").alias("m"), r("s").alias("s"))


REC = f"{HP}, z AS (SELECT *, CAST(coalesce(y > 100, false) AS INT) AS sp FROM h)"


@query("w5_spike_windows", f"{REC} SELECT series, t, CAST(sum(sp) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS BIGINT) AS spikes24, round(max(y) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 4) AS max24 FROM z")
def w5(spark, sf):
    return gaps.event_recency(panel(spark, sf), K, "y", 100.0, (24,)).select("series", "t", "spikes24", r("max24").alias("max24"))


@query("w6_centred", f"{HP} SELECT series, t, round(avg(y) OVER (PARTITION BY series, t % 24 ORDER BY t ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), 4) AS m FROM h")
def w6(spark, sf):
    h = panel(spark, sf).withColumn("hr", F.pmod("t", lit(24))).withColumn("day", F.floor(c("t") / 24))
    return centred(h, ["series", "hr"], "y", "m", 7, "day", chunk=10).select("series", "t", r("m").alias("m"))


@query("w7_ffill_limit", f"{HP} SELECT series, t, round(last_value(y IGNORE NULLS) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS y FROM h")
def w7(spark, sf):
    return ffill_limit(panel(spark, sf), K, "y", 2).select("series", "t", r("y_ffill").alias("y"))


@query("w8_fill_both", f"{HP} SELECT series, t, round(coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(y IGNORE NULLS) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS y FROM h")
def w8(spark, sf):
    return gaps.fill_both(panel(spark, sf), K, "y", "f").select("series", "t", r("f").alias("y"))


LINE = """nb AS (SELECT series, t, y,
  last_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pt,
  last_value(y IGNORE NULLS) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
  first_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt,
  first_value(y IGNORE NULLS) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM h),
ip AS (SELECT series, t, coalesce(y, CASE WHEN t - pt <= {limit} THEN pv + (nv - pv) * (t - pt) / (nt - pt) END) AS x FROM nb)"""


@query("w9_interpolate", f"{HP}, {LINE.format(limit=2)} SELECT series, t, round(x, 4) AS y FROM ip")
def w9(spark, sf):
    return gaps.interpolate(panel(spark, sf), K, "y", "x", 2).select("series", "t", r("x").alias("y"))


RUNS = "rn AS (SELECT series, min(t) AS start, max(t) AS stop, count(*) AS steps FROM (SELECT series, t, t - row_number() OVER (PARTITION BY series ORDER BY t) AS g FROM h WHERE y IS NULL) GROUP BY series, g)"


@query("w10_gap_runs", f"{HP}, {RUNS} SELECT series, start, stop, steps FROM rn")
def w10(spark, sf):
    return gaps.gap_runs(panel(spark, sf), K, "y")


@query("w11_spell_counter", f"{HP}, z AS (SELECT series, t, coalesce(y > 60, false) AS on_ FROM h), g AS (SELECT *, sum(CAST(NOT on_ AS INT)) OVER (PARTITION BY series ORDER BY t) AS i FROM z) SELECT series, t, CASE WHEN on_ THEN row_number() OVER (PARTITION BY series, i, on_ ORDER BY t) - 1 ELSE 0 END AS n FROM g")
def w11(spark, sf):
    h = panel(spark, sf).withColumn("f", F.coalesce(c("y") > 60, lit(False)))
    return gaps.spell_counter(h, K, c("f"), "n").select("series", "t", c("n").cast("long").alias("n"))


@query("w12_steps_since", f"{HP} SELECT series, t, coalesce(t - max(CASE WHEN y > 100 THEN t END) OVER (PARTITION BY series ORDER BY t), 9999) AS since FROM h")
def w12(spark, sf):
    return gaps.steps_since(panel(spark, sf), K, F.coalesce(c("y") > 100, lit(False)), "since").select("series", "t", c("since").cast("long").alias("since"))


@query("w13_blocks", f"{HP} SELECT series, t, (t - min(t) OVER (PARTITION BY series)) // 168 AS block FROM h")
def w13(spark, sf):
    h = panel(spark, sf)
    return h.join(h.groupBy("series").agg(F.min("t").alias("a")), "series").select("series", "t", F.floor((c("t") - c("a")) / 168).alias("block"))


@query("w14_quantile_bins", f"""{HP}, e AS (SELECT series, quantile_cont(y, [i / 6.0 for i in range(1, 6)]) AS e FROM h GROUP BY series), k AS (SELECT h.series, t, y, len(list_filter(e, lambda x: y - x > 1e-9 * abs(x))) AS cls FROM h JOIN e ON e.series = h.series WHERE y IS NOT NULL),
i AS (SELECT series, cls, quantile_cont(y, [i / 20.0 for i in range(1, 20)]) AS e FROM k GROUP BY ALL) SELECT k.series, t, k.cls, len(list_filter(e, lambda x: y - x > 1e-9 * abs(x))) AS bin FROM k JOIN i ON i.series = k.series AND i.cls = k.cls""")
def w14(spark, sf):
    out = quantile_bins(panel(spark, sf).where("y IS NOT NULL"), K, "y", 6, "cls")
    return quantile_bins(out, [*K, "cls"], "y", 20, "bin").select("series", "t", "cls", "bin")


@query("w15_causality", f"{HP}, s AS (SELECT series, t, coalesce(t - max(CASE WHEN y > 100 THEN t END) OVER (PARTITION BY series ORDER BY t), 9999) AS since FROM h), d AS (SELECT series, since, lag(since) OVER (PARTITION BY series ORDER BY t) AS b FROM s) SELECT series, count(*) FILTER (since <> 0 AND since <> 9999 AND since <> b + 1) AS broken FROM d GROUP BY series")
def w15(spark, sf):
    h = gaps.steps_since(panel(spark, sf), K, F.coalesce(c("y") > 100, lit(False)), "since")
    h = lags(h, K, "since", [1])
    return h.groupBy("series").agg(F.count_if((c("since") != 0) & (c("since") != 9999) & (c("since") != c("since_lag1") + 1)).alias("broken"))


@query("w16_persistence", f"{HP}, {LINE.format(limit=9999)} SELECT series, t + 24 AS tt, round(x, 4) AS p FROM ip")
def w16(spark, sf):
    return gaps.interpolate(panel(spark, sf), K, "y", "x").select("series", (c("t") + 24).alias("tt"), r("x").alias("p"))


@query("w17_reindex", f"{HP} SELECT series, count(*) AS n, min(t) AS lo, max(t) AS hi FROM gr GROUP BY series")
def w17(spark, sf):
    return panel(spark, sf).groupBy("series").agg(F.count(lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))


@query("w18_lookback", f"{HP}, z AS (SELECT series, t, list(y) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS p, list(y) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS f FROM h), x AS (SELECT series, t, list_filter(p, lambda v: v IS NOT NULL) AS p, list_filter(f, lambda v: v IS NOT NULL) AS f FROM z) SELECT series, t, round(list_sum(p), 4) AS past, round(list_sum(f), 4) AS future FROM x WHERE len(p) = 24 AND len(f) = 6 AND t % 6 = 0")
def w18(spark, sf):
    total = lambda a: F.aggregate(a, lit(0.0), lambda x, v: x + v)
    return lookback_arrays(panel(spark, sf), K, "y", 24, 6, 6).select("series", "t", r(total("past")).alias("past"), r(total("future")).alias("future"))


@query("x19_decompose", f"{HP}, z AS (SELECT series, t, count(y) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS n, list(y) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS p, count(y) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS m FROM h) SELECT series, t, round((p[20] + p[21] + p[22] + p[23] + p[24]) / 5, 4) AS trend22, round((p[22] + p[23] + 3 * p[24]) / 5, 4) AS trend24 FROM z WHERE n = 24 AND m = 1")
def x19(spark, sf):
    a = lookback_arrays(panel(spark, sf), K, "y", 24, 1).withColumn("tr", X.moving_average(c("past"), 5))
    return a.select("series", "t", r(F.element_at("tr", 22)).alias("trend22"), r(F.element_at("tr", 24)).alias("trend24"))


@query("a33_gap_buckets", f"{HP}, {RUNS} SELECT series, count(*) FILTER (steps = 1) AS one, count(*) FILTER (steps BETWEEN 2 AND 288) AS days12, count(*) FILTER (steps BETWEEN 289 AND 720) AS days30, count(*) FILTER (steps > 720) AS longer, max(steps) AS longest, median(steps) AS med FROM rn GROUP BY series")
def a33(spark, sf):
    n = c("steps")
    runs = gaps.gap_runs(panel(spark, sf), K, "y")
    counts = runs.groupBy("series").agg(F.count_if(n == 1).alias("one"), F.count_if(n.between(2, 288)).alias("days12"), F.count_if(n.between(289, 720)).alias("days30"), F.count_if(n > 720).alias("longer"), F.max(n).alias("longest"))
    return counts.join(medians(runs, K, "steps"), "series")


@query("o2_top_gaps", f"{HP}, {RUNS} SELECT series, start, steps FROM rn ORDER BY steps DESC, series, start LIMIT 10")
def o2(spark, sf):
    return gaps.gap_runs(panel(spark, sf), K, "y").orderBy(c("steps").desc(), "series", "start").limit(10).select("series", "start", "steps")


@query("h6_horizons", f"{HP} SELECT a.series, a.t, x.n AS h, round(b.y, 4) AS target FROM h a, (VALUES (1), (6), (24)) x(n), h b WHERE b.series = a.series AND b.t = a.t + x.n")
def h6(spark, sf):
    return align(panel(spark, sf), K, ["y"], [], "y", [1, 6, 24]).select("series", "t", "h", r("target").alias("target"))


# --- gap filling and flux

MDC = f"""{HP}, {LINE.format(limit=2)},
x0 AS (SELECT series, t, t % 24 AS hr, t // 24 AS d, x FROM ip),
dn AS (SELECT series, d, row_number() OVER (PARTITION BY series ORDER BY d) AS n FROM (SELECT DISTINCT series, d FROM x0 WHERE x IS NOT NULL)),
x1 AS (SELECT x0.*, n FROM x0 LEFT JOIN dn ON dn.series = x0.series AND dn.d = x0.d),
""" + ",\n".join(f"x{i + 2} AS (SELECT series, t, hr, d, n, coalesce(x, CASE WHEN n IS NOT NULL THEN avg(x) OVER (PARTITION BY series, hr, n IS NULL ORDER BY n ROWS BETWEEN {w} PRECEDING AND {w} FOLLOWING) END) AS x FROM x{i + 1})" for i, w in enumerate((7, 14, 28, 60)))


@query("g1_mean_diurnal_course", f"{MDC} SELECT series, t, round(coalesce(x, avg(x) OVER (PARTITION BY series, hr), avg(x) OVER (PARTITION BY series)), 4) AS y FROM x5")
def g1(spark, sf):
    return flux.mdc_fill(panel(spark, sf), K, "y", "f").select("series", "t", r("f").alias("y"))


MDS_SQL = """gp AS (SELECT series, t AS gt, t % 24 AS ghr, t // 24 AS gday, ta AS gta, sw AS gsw FROM {src} WHERE y IS NULL),
cd AS (SELECT series, t AS ct, t % 24 AS chr, t // 24 AS cday, ta AS cta, sw AS csw, y FROM {src} WHERE y IS NOT NULL),
pr AS (SELECT gp.series, gt, y, gday, cday, CASE WHEN abs(gt - ct) <= 7 * 24 THEN 0 WHEN abs(gt - ct) <= 14 * 24 THEN 1 WHEN abs(gt - ct) <= 28 * 24 THEN 2 WHEN abs(gt - ct) <= 91 * 24 THEN 3 ELSE 4 END AS k,
  (cta IS NULL OR gta IS NULL OR abs(gta - cta) <= 2.5) AND (coalesce(gsw, 0) <= 10 OR csw IS NULL OR abs(gsw - csw) <= 50) AS alike
  FROM gp JOIN cd ON gp.series = cd.series AND abs(ghr - chr) <= 1),
bk AS (SELECT series, gt, min(k) AS k FROM pr WHERE k < 4 AND alike GROUP BY ALL),
f1 AS (SELECT pr.series, pr.gt, avg(y) AS filled FROM pr JOIN bk ON bk.series = pr.series AND bk.gt = pr.gt AND bk.k = pr.k WHERE alike GROUP BY ALL),
dd AS (SELECT *, dayofyear(DATE '1970-01-01' + CAST(gday AS INT)) AS g, dayofyear(DATE '1970-01-01' + CAST(cday AS INT)) AS q FROM pr),
f2 AS (SELECT series, gt, avg(y) AS filled FROM dd WHERE least(abs(g - q), 365 - abs(g - q)) <= 7 AND NOT EXISTS (SELECT 1 FROM bk WHERE bk.series = dd.series AND bk.gt = dd.gt) GROUP BY ALL),
fl AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2)"""


@query("g2_mds_fill", f"{HP}, dr AS (SELECT series, t, y, 10 + 8 * sin(t / 24.0) AS ta, sw FROM h), {MDS_SQL.format(src='dr')} SELECT series, gt AS t, round(filled, 4) AS filled FROM fl")
def g2(spark, sf):
    h = panel(spark, sf).withColumn("ta", 10 + 8 * F.sin(c("t") / 24.0))
    return mds(h, K, "y", "ta", "sw").select("series", "t", r("filled").alias("filled"))


@query("j9_similarity_join", f"{HP}, dr AS (SELECT series, t, CASE WHEN t % 5 <> 0 THEN y END AS y, ta, sw FROM h), {MDS_SQL.format(src='dr')} SELECT series, gt AS t, round(filled, 4) AS filled FROM fl")
def j9(spark, sf):
    h = panel(spark, sf).withColumn("y", F.when(F.pmod("t", lit(5)) != 0, c("y")))
    return mds(h, K, "y", "ta", "sw").select("series", "t", r("filled").alias("filled"))


def towers(spark, sf):
    """A flux panel from line items: night and day, friction velocity, temperature and flux."""
    l = table(spark, sf, "lineitem")
    t = (c("l_orderkey") * 7 + c("l_linenumber")).alias("t")
    return l.select(c("l_returnflag").alias("series"), t, (c("l_tax") * 250 + c("l_quantity") / 97).alias("ta"), ((c("l_discount") + c("l_quantity") / 1013) * 5).alias("us"),
                    (c("l_quantity") / 11.3 + F.when(c("l_discount") > 0.02, 2.0).otherwise(0.0)).alias("fc"), F.when(c("l_linenumber") % 2 == 0, 0.0).otherwise(200.0).alias("rg"))


TOWERS = """tw AS (SELECT l_returnflag AS series, l_orderkey * 7 + l_linenumber AS t, l_tax * 250 + l_quantity / 97 AS ta, (l_discount + l_quantity / 1013) * 5 AS us,
  l_quantity / 11.3::DOUBLE + CASE WHEN l_discount > 0.02 THEN 2.0 ELSE 0.0 END AS fc, CASE WHEN l_linenumber % 2 = 0 THEN 0.0 ELSE 200.0 END AS rg FROM lineitem)"""
USTAR = f"""WITH {TOWERS}, nt AS (SELECT * FROM tw WHERE rg < 20 AND us > 0),
te AS (SELECT series, quantile_cont(ta, [i / 6.0 for i in range(1, 6)]) AS te, count(*) AS n FROM nt GROUP BY series),
cl AS (SELECT nt.*, len(list_filter(te, lambda x: ta > x)) AS cls FROM nt JOIN te ON te.series = nt.series),
ue AS (SELECT series, cls, list_distinct(quantile_cont(us, [i / 20.0 for i in range(0, 21)])) AS ue FROM cl GROUP BY ALL HAVING count(*) >= 50),
bn AS (SELECT cl.series, cl.cls, greatest(len(list_filter(ue, lambda x: us > x)) - 1, 0) AS bin, avg(us) AS us, avg(fc) AS fc FROM cl JOIN ue ON ue.series = cl.series AND ue.cls = cl.cls WHERE len(ue) >= 6 GROUP BY ALL),
rk AS (SELECT *, max(bin) OVER (PARTITION BY series, cls) AS top, count(*) OVER (PARTITION BY series, cls) AS m FROM bn),
pl AS (SELECT *, avg(CASE WHEN bin >= top // 2 THEN fc END) OVER (PARTITION BY series, cls) AS p FROM rk WHERE m >= 6),
pc AS (SELECT series, cls, arg_min(us, bin) AS us FROM pl WHERE p > 0 AND fc >= 0.95 * p GROUP BY ALL),
md AS (SELECT series, median(us) AS us FROM pc GROUP BY series)
SELECT te.series, round(CASE WHEN n >= 200 AND us IS NOT NULL THEN greatest(0.01, least(0.5, us)) ELSE 0.1 END, 4) AS threshold FROM te LEFT JOIN md ON md.series = te.series"""


@query("g3_ustar_threshold", USTAR)
def g3(spark, sf):
    return flux.ustar_threshold(towers(spark, sf), K, "ta", "us", "fc", "rg").select("series", r("threshold").alias("threshold"))


E0_SQL = f"""WITH {TOWERS}, nt AS (SELECT * FROM tw WHERE rg < 20), ok AS (SELECT series FROM nt GROUP BY series HAVING count(*) >= 300),
g AS (SELECT series, e0, sum(fc * g) AS fg, sum(g * g) AS gg, sum(fc * fc) AS ff FROM (SELECT nt.series, e0, fc, exp(e0 * (1 / (10.0 + 46.02) - 1 / (ta + 46.02))) AS g FROM nt JOIN ok ON ok.series = nt.series, (SELECT unnest(generate_series(30, 450)) AS e0)) GROUP BY ALL),
s AS (SELECT *, greatest(0.0, least(60.0, fg / gg)) AS rr FROM g)
SELECT series, arg_min(e0, ff - 2 * rr * fg + rr * rr * gg) AS e0 FROM s GROUP BY series"""


@query("g4_e0_fit", E0_SQL)
def g4a(spark, sf):
    night = towers(spark, sf).where("rg < 20")
    return flux.fit_e0(night, K, "fc", "ta").select("series", c("e0").cast("long").alias("e0"))


_LT = "exp({e} * (1 / (10.0 + 46.02) - 1 / (ta + 46.02)))"
_SSE = "(SELECT series, e0, sse[1] AS a, sse[2] AS b, sse[3] AS c FROM (SELECT series, e0, list(ff - 2 * rr * fg + rr * rr * gg ORDER BY i) AS sse FROM (SELECT *, greatest(0.0, least(60.0, fg / gg)) AS rr FROM (SELECT nt.series, e0, i, sum(fc * g) AS fg, sum(g * g) AS gg, sum(fc * fc) AS ff FROM (SELECT nt.*, e0, i, " + _LT.format(e="(e0 + i * {h})") + " AS g FROM nt JOIN {src} ON {src}.series = nt.series, (SELECT unnest([-1, 0, 1]) AS i)) nt GROUP BY ALL)) GROUP BY ALL))"
_VERTEX = "SELECT series, CASE WHEN e0 > 30 AND e0 < 450 THEN greatest(30.0, least(450.0, e0 + CASE WHEN a - 2 * b + c > 0 THEN greatest(-{h}, least({h}, (a - c) / (a - 2 * b + c) / 2 * {h})) ELSE 0 END)) ELSE e0 END AS e0 FROM "
NEE_SQL = f"""{E0_SQL.replace(chr(10) + 'SELECT series, arg_min', ',' + chr(10) + 'z0 AS (SELECT series, arg_min').replace(' FROM s GROUP BY series', ' FROM s GROUP BY series)')},
z1 AS ({(_VERTEX + _SSE).format(h='1.0', src='z0')}), z2 AS ({(_VERTEX + _SSE).format(h='0.1', src='z1')}),
f0 AS (SELECT series, min(t) AS t0 FROM tw GROUP BY series),
kw AS (SELECT nt.series, (t - t0) // 168 AS blk, sum(fc * {_LT.format(e='e0')}) AS fg, sum({_LT.format(e='e0')} ** 2) AS gg, count(*) AS n FROM nt JOIN z2 ON z2.series = nt.series JOIN f0 ON f0.series = nt.series GROUP BY ALL),
al AS (SELECT series, greatest(0.0, least(60.0, sum(fg) / sum(gg))) AS every FROM kw GROUP BY series),
h AS (SELECT tw.series, t, ta, fc, rg, e0, CASE WHEN n >= 8 THEN greatest(0.0, least(60.0, fg / gg)) END AS y FROM tw LEFT JOIN z2 ON z2.series = tw.series JOIN f0 ON f0.series = tw.series LEFT JOIN kw ON kw.series = tw.series AND kw.blk = (t - t0) // 168),
nb AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER up AS pt, last_value(y IGNORE NULLS) OVER up AS pv, first_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER dn AS nt, first_value(y IGNORE NULLS) OVER dn AS nv
  FROM h WINDOW up AS (PARTITION BY series ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), dn AS (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
rc AS (SELECT nb.series, t, fc, rg, e0, coalesce(y, pv + (nv - pv) * (t - pt) / (nt - pt), pv, nv, every) * {_LT.format(e='e0')} AS reco FROM nb LEFT JOIN al ON al.series = nb.series)
SELECT series, t, round(reco, 4) AS reco, round(CASE WHEN e0 IS NULL THEN NULL WHEN rg < 20 THEN 0.0 WHEN fc IS NOT NULL AND reco IS NOT NULL THEN greatest(reco - fc, 0.0) END, 4) AS gpp FROM rc"""


@query("g4_partition", NEE_SQL)
def g4(spark, sf):
    return flux.partition_nee(towers(spark, sf), K, "fc", "ta", "rg").select("series", "t", r("reco").alias("reco"), r("gpp").alias("gpp"))


#: Blocks thrown one after another, from dm (grp, rep, lo, hi, aim, lens) and vl (grp, t): lens is a list to draw from.
THROWN = """cu AS (SELECT dm.grp, list(v ORDER BY i) AS cum FROM (SELECT grp, i, sum(ok) OVER (PARTITION BY grp ORDER BY i) AS v FROM (SELECT q.grp, q.i, CASE WHEN vl.t IS NULL THEN 0 ELSE 1 END AS ok
  FROM (SELECT grp, unnest(range(lo, hi + 1)) AS i FROM dm) q LEFT JOIN vl ON vl.grp = q.grp AND vl.t = q.i)) w JOIN dm ON dm.grp = w.grp GROUP BY dm.grp),
sx AS (SELECT grp, lo, hi, lens, s, md5(CAST(s AS VARCHAR) || '|' || CAST(rep AS VARCHAR)) AS z FROM (SELECT *, unnest(range(lo, hi + 1)) AS s FROM dm)),
sg AS (SELECT grp, lo, s, CAST('0x' || substr(z, 1, 8) AS BIGINT) AS p, least(lens[CAST('0x' || substr(z, 9, 8) AS BIGINT) % len(lens) + 1], hi + 1 - s) AS g FROM sx),
sl AS (SELECT sg.grp, list({{'p': p, 's': s, 'g': g, 'v': cum[s - lo + g] - coalesce(cum[s - lo], 0)}} ORDER BY p, s) AS rest FROM sg JOIN cu ON cu.grp = sg.grp GROUP BY sg.grp),
th AS (SELECT sl.grp, aim, rest, CAST(0 AS HUGEINT) AS m, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS g FROM sl JOIN dm ON dm.grp = sl.grp
  UNION ALL SELECT grp, aim, list_filter(rest[2:], lambda x: x.s >= rest[1].s + rest[1].g OR x.s + x.g <= rest[1].s), m + rest[1].v, rest[1].s, rest[1].g FROM th WHERE len(rest) > 0 AND m < aim),
mk AS (SELECT vl.grp, vl.t FROM (SELECT grp, unnest(range(s, s + g)) AS t FROM th WHERE s IS NOT NULL) b JOIN vl ON vl.grp = b.grp AND vl.t = b.t)"""
_REC = HP.replace("WITH", "WITH RECURSIVE", 1)
_DOMAIN = "dm AS (SELECT h.series AS grp, 0 AS rep, min(t) AS lo, max(t) AS hi, greatest(1, floor(count(y) * {share})) AS aim, {lens} AS lens FROM h {join} GROUP BY ALL), vl AS (SELECT series AS grp, t FROM h WHERE y IS NOT NULL)"


@query("g7_calendar_gaps", f"{_REC}, {_DOMAIN.format(share=0.25, lens='[32::BIGINT]', join='')}, {THROWN.format()} SELECT grp AS series, t FROM mk")
def g7(spark, sf):
    return gaps.calendar_gaps(panel(spark, sf), K, "y", 32, 0)


EMPIRICAL = f"""{_REC}, {RUNS}, ls AS (SELECT series, list_sort(list(steps)) AS s FROM rn GROUP BY series), {_DOMAIN.format(share=0.4, lens='s', join='JOIN ls ON ls.series = h.series')}, {THROWN.format()} SELECT grp AS series, t FROM mk"""


@query("g8_empirical_gaps", EMPIRICAL)
def g8(spark, sf):
    return gaps.empirical_gaps(panel(spark, sf), K, "y", 0)


LENGTHS, REPS = (1, 4, 32, 288), 5  # gap 0 is the mix of all lengths
SK = ["gap", "rep", "series"]


_MADE: dict[tuple, str] = {}  # tables of this session that several queries share, by application, input and name


def shared(spark, sf, name: str, make, by: list[str] = ()):
    """make() as a table of the shared folder, made once a session and input, and again if its folder has been cleared; by: a folder for each value."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key in _MADE:
        try:
            return spark.read.parquet(_MADE[key])
        except AnalysisException:
            del _MADE[key]
    _MADE[key] = scratch(spark, name)
    make().write.partitionBy(*by).parquet(_MADE[key])
    return spark.read.parquet(_MADE[key])


def scenarios(spark, sf):
    """(gap, rep, series, t, obs, y, ta, sta, sw): the valid rows once per scenario, y null where masked; sta is the site's TA.

    A scenario has a folder of its own, so that what works on one does not read the others.
    """
    def make():
        h = kept(panel(spark, sf), "panel")
        h = kept(h.join(h.groupBy("t").agg(F.avg("ta").alias("sta")), "t"), "panel")
        every = F.array(*[F.struct(lit(g).alias("gap"), lit(i).alias("rep")) for g in (*LENGTHS, 0) for i in range(REPS)])
        rows = h.where("y IS NOT NULL").withColumn("z", F.explode(every)).select("z.*", "series", "t", "y", "ta", "sta", "sw")
        steps = F.when(c("gap") > 0, F.array(c("gap"))).otherwise(F.array(*[lit(g) for g in LENGTHS]))
        lengths = rows.select(*SK).distinct().select(*SK, F.explode(steps.cast("array<bigint>")).alias("steps"), lit(1).alias("n"))
        mask = gaps.thrown_gaps(rows, SK, "y", lengths, c("rep"))
        rows = rows.withColumnRenamed("y", "obs").join(mask.withColumn("m", lit(1)), [*SK, "t"], "left")
        return rows.withColumn("y", F.when(c("m").isNull(), c("obs"))).drop("m")
    return shared(spark, sf, "scenarios", make, ["gap", "rep"])


def cv_scores(filled, rows):
    """Scores of the masked rows that were filled, at least 5 a scenario."""
    test = rows.where("y IS NULL").join(filled, [*SK, "t"])
    return M.point_metrics(test.select(*SK, c("obs").alias("y"), c("filled").alias("p")), SK, least=5)


def hour_mean(rows):
    hr = F.pmod("t", lit(24)).alias("hr")
    means = rows.where("y IS NOT NULL").groupBy(*SK, hr).agg(F.avg("y").alias("filled"))
    return rows.where("y IS NULL").select(*SK, "t", hr).join(means, [*SK, "hr"]).drop("hr")


def gap_cv(spark, sf, ext: bool = False):
    """(method, gap, rep, series, RMSE, R2) of the hour's mean and of the similarity fill; drivers of the site if `ext`."""
    def make():
        rows = scenarios(spark, sf)
        parts = [("MDS", mds(rows, SK, "y", "sta" if ext else "ta", "sw"))] + ([] if ext else [("mean", hour_mean(rows))])
        out = [cv_scores(f, rows).select(lit(name).alias("method"), *SK, "RMSE", "R2", "n_test") for name, f in parts]
        return out[0] if ext else out[0].unionByName(out[1])
    return shared(spark, sf, "cv-site" if ext else "cv", make)


CV_SQL = f"""{_REC}, sc AS (SELECT g AS gap, i AS rep FROM (VALUES (1), (4), (32), (288), (0)) a(g), (VALUES (0), (1), (2), (3), (4)) b(i)),
rw AS (SELECT gap, rep, series || '|' || gap || '|' || rep AS grp, h.* FROM h, sc WHERE y IS NOT NULL),
dm AS (SELECT grp, rep, min(t) AS lo, max(t) AS hi, greatest(1, floor(count(y) * 0.25)) AS aim, CASE WHEN gap > 0 THEN [gap::BIGINT] ELSE [1, 4, 32, 288]::BIGINT[] END AS lens FROM rw GROUP BY ALL),
vl AS (SELECT grp, t FROM rw), {THROWN.format()},
si AS (SELECT t, avg(ta) AS sta FROM h GROUP BY t),
cv0 AS MATERIALIZED (SELECT gap, rep, rw.series AS own, rw.grp AS series, rw.t, y AS obs, CASE WHEN mk.t IS NOT NULL THEN NULL ELSE y END AS y, ta, sta, sw FROM rw LEFT JOIN mk ON mk.grp = rw.grp AND mk.t = rw.t JOIN si ON si.t = rw.t),
cve AS (SELECT * REPLACE (sta AS ta) FROM cv0),
hm AS (SELECT series, t % 24 AS hr, avg(y) AS filled FROM cv0 WHERE y IS NOT NULL GROUP BY ALL),
{MDS_SQL.format(src='cv0')},
{{more}}
fa AS (SELECT 'MDS' AS method, series, gt AS t, filled FROM fl UNION ALL SELECT 'mean', cv0.series, t, filled FROM cv0 JOIN hm ON hm.series = cv0.series AND hm.hr = t % 24 WHERE y IS NULL),
cv AS (SELECT method, gap, rep, own AS series, sqrt(avg((filled - obs) ** 2)) AS rmse FROM fa JOIN cv0 USING (series, t) WHERE y IS NULL GROUP BY ALL HAVING count(*) >= 5)"""
CV_EXT = MDS_SQL.format(src="cve")
for _n in ("gp", "cd", "pr", "bk", "f1", "dd", "f2", "fl"):
    CV_EXT = re.sub(rf"\b{_n}\b", f"{_n}_e", CV_EXT)
CV_EXT += ",\nex AS (SELECT gap, rep, own AS series, sqrt(avg((filled - obs) ** 2)) AS rmse FROM (SELECT series, gt AS t, filled FROM fl_e) JOIN cv0 USING (series, t) WHERE y IS NULL GROUP BY ALL HAVING count(*) >= 5),"
CV_SQL, CV_BOTH = CV_SQL.replace("{more}", ""), CV_SQL.replace("{more}", CV_EXT)


@query("g9_gap_cross_validation", f"{CV_SQL} SELECT method, gap, rep, series, round(rmse, 4) AS rmse FROM cv")
def g9(spark, sf):
    return gap_cv(spark, sf).select("method", *SK, r("RMSE").alias("rmse"))


@query("a23_median_over_reps", f"{CV_SQL} SELECT method, series, gap, round(median(rmse), 4) AS rmse FROM cv GROUP BY ALL")
def a23(spark, sf):
    return B.median_over_reps(gap_cv(spark, sf), ["method", "series", "gap"], "RMSE").select("method", "series", "gap", r("RMSE").alias("rmse"))


@query("g10_improvement", f"{CV_SQL}, md AS (SELECT method, series, gap, median(rmse) AS rmse FROM cv GROUP BY ALL) SELECT a.series, a.gap, round(b.rmse - a.rmse, 4) + 0.0 AS delta FROM md a JOIN md b ON a.series = b.series AND a.gap = b.gap AND a.method = 'MDS' AND b.method = 'mean'")
def g10(spark, sf):
    """What the similarity fill gains over the hour's mean, by series and gap length."""
    s = B.median_over_reps(gap_cv(spark, sf), ["method", "series", "gap"], "RMSE")
    a, b = (s.where(c("method") == m).select("series", "gap", c("RMSE").alias(m)) for m in ("MDS", "mean"))
    return a.join(b, ["series", "gap"]).select("series", "gap", (r(c("mean") - c("MDS")) + 0.0).alias("delta"))


@query("g11_source_ab", f"{CV_BOTH}, ma AS (SELECT series, gap, median(rmse) AS own FROM cv WHERE method = 'MDS' GROUP BY ALL), mb AS (SELECT series, gap, median(rmse) AS site FROM ex GROUP BY ALL) SELECT series, gap, round(own, 4) AS own, round(site, 4) AS site, round(site - own, 4) + 0.0 AS delta FROM ma JOIN mb USING (series, gap)")
def g11(spark, sf):
    """The similarity fill under one harness with a series' own drivers and with the site's."""
    med = lambda ext, name: B.median_over_reps(gap_cv(spark, sf, ext).where("method = 'MDS'"), ["series", "gap"], "RMSE").select("series", "gap", c("RMSE").alias(name))
    both = med(False, "own").join(med(True, "site"), ["series", "gap"])
    return both.select("series", "gap", r("own").alias("own"), r("site").alias("site"), (r(c("site") - c("own")) + 0.0).alias("delta"))


# --- forecasts: persistence and climatology of the daily panel

FC = f"""WITH {DAILY}, f AS (SELECT b.series, a.d, b.d AS tt, b.y, a.y AS persist, month(DATE '1970-01-01' + CAST(b.d AS INT)) AS m FROM o a JOIN o b ON b.series = a.series AND b.d = a.d + 1),
tr AS (SELECT * FROM f WHERE tt < 10957), te AS (SELECT * FROM f WHERE tt >= 10957),
tn AS (SELECT series, count(*) AS n, avg(y) AS own_mean FROM tr GROUP BY series), ow AS (SELECT series, m, avg(y) AS own FROM tr GROUP BY ALL), pl AS (SELECT m, avg(y) AS pooled FROM tr GROUP BY m),
fc AS (SELECT te.*, CASE WHEN coalesce(n, 0) >= 24 THEN coalesce(own, own_mean) ELSE coalesce(pooled, (SELECT avg(y) FROM tr)) END AS clim
  FROM te LEFT JOIN tn ON tn.series = te.series LEFT JOIN ow ON ow.series = te.series AND ow.m = te.m LEFT JOIN pl ON pl.m = te.m)"""


def forecasts(spark, sf):
    """(series, d, tt, y, persist, clim) of the test years, one day ahead."""
    o = daily(spark, sf)
    f = o.select("series", "d", (c("d") + 1).alias("tt"), c("y").alias("persist")).join(o.select("series", c("d").alias("tt"), "y"), ["series", "tt"])
    f = f.withColumn("m", F.month(F.date_add(lit("1970-01-01").cast("date"), c("tt").cast("int"))))
    return B.climatology(f.where("tt < 10957"), f.where("tt >= 10957"), "series", ["m"]), f.where("tt < 10957")


def scores(spark, sf):
    return M.point_metrics(forecasts(spark, sf)[0], K, p="persist", naive="persist", clim="clim")


def climatology_scores(spark, sf):
    return M.point_metrics(forecasts(spark, sf)[0], K, p="clim", naive="persist")


@query("m9_flagship", f"{HP}, f AS (SELECT b.series, b.y, a.y AS p FROM h a JOIN h b ON b.series = a.series AND b.t = a.t + 1 WHERE a.y IS NOT NULL AND b.y IS NOT NULL) SELECT series, round(sqrt(avg((p - y) ** 2)), 4) AS rmse, round(avg(abs(p - y)), 4) AS mae, round(1 - sum((p - y) ** 2) / (var_pop(y) * count(*)), 4) AS r2, round(avg(p - y), 4) AS mbe FROM f GROUP BY series")
def flagship(spark, sf):
    """Gated hourly means on a full grid, persistence one step ahead, scored per series."""
    f = align(panel(spark, sf), K, ["y"], [], "y", [1])
    m = M.point_metrics(f.select("series", c("y").alias("p"), c("target").alias("y")), K)
    return m.select("series", r("RMSE").alias("rmse"), r("MAE").alias("mae"), r("R2").alias("r2"), r("MBE").alias("mbe"))


def _metric(name, column, sql, scores=scores):
    @query(name, f"{FC} SELECT series, round({sql}, 4) AS v FROM fc GROUP BY series")
    def run(spark, sf):
        return scores(spark, sf).select("series", r(column).alias("v"))
    return run


SQ = "sqrt(avg((persist - y) ** 2))"
_metric("m1_rmse", "RMSE", SQ)
_metric("m2_mae", "MAE", "avg(abs(persist - y))")
_metric("m3_r2", "R2", "1 - sum((persist - y) ** 2) / (var_pop(y) * count(*))")
_metric("m4_mbe", "MBE", "avg(persist - y)")
_metric("m5_wape", "WAPE", "sum(abs(y - persist)) / sum(abs(y))")
_metric("m6_mase", "MASE", "avg(abs(clim - y)) / avg(abs(persist - y))", climatology_scores)
_metric("m7_smape", "sMAPE", "avg(2 * abs(y - persist) / greatest(abs(y) + abs(persist), 1e-6))")
_metric("m8_mape", "MAPE", "avg(CASE WHEN abs(y) >= 1 THEN abs(y - persist) / abs(y) END)")
_metric("m10_skill", "skill_clim", f"1 - {SQ} / sqrt(avg((clim - y) ** 2))")


@query("m15_gates", f"{FC} SELECT series, count(*) AS n FROM fc GROUP BY series HAVING count(*) >= 10")
def m15(spark, sf):
    return M.point_metrics(forecasts(spark, sf)[0], K, p="persist", least=10).select("series", c("n_test").alias("n"))


@query("l8_persistence", f"{FC} SELECT series, tt, round(persist, 4) AS p FROM fc")
def l8(spark, sf):
    return forecasts(spark, sf)[0].select("series", "tt", r("persist").alias("p"))


for _name in ("l9_climatology", "a21_climatology", "j11_climatology_lookup"):
    @query(_name, f"{FC} SELECT series, tt, round(clim, 4) AS p FROM fc")
    def _clim(spark, sf):
        return forecasts(spark, sf)[0].select("series", "tt", r("clim").alias("p"))


CUTS = [(10957, 11107), (11107, 11257)]


@query("l11_expanding_folds", f"""{FC}, k AS (SELECT * FROM (VALUES (0, 10957, 11107), (1, 11107, 11257)) v(fold, a, b)),
mm AS (SELECT fold, series, m, avg(y) AS own FROM f JOIN k ON tt < a GROUP BY ALL), dn AS (SELECT fold, m, sum(y) AS s, count(*) AS n FROM f JOIN k ON tt < a GROUP BY ALL),
ds AS (SELECT fold, series, m, sum(y) AS s, count(*) AS n FROM f JOIN k ON tt < a GROUP BY ALL),
z AS (SELECT f.series, f.y, mm.own, (dn.s - coalesce(ds.s, 0)) / nullif(dn.n - coalesce(ds.n, 0), 0) AS donors FROM f JOIN k ON tt >= a AND tt < b LEFT JOIN mm ON mm.fold = k.fold AND mm.series = f.series AND mm.m = f.m LEFT JOIN dn ON dn.fold = k.fold AND dn.m = f.m LEFT JOIN ds ON ds.fold = k.fold AND ds.m = f.m AND ds.series = f.series),
w AS (SELECT series, y, (coalesce(own, donors) + coalesce(donors, own)) / 2 AS p FROM z)
SELECT series, count(*) AS n, round(sqrt(avg((p - y) ** 2)), 4) AS rmse FROM w WHERE p IS NOT NULL GROUP BY series HAVING count(*) >= 5""")
def l11(spark, sf):
    """Means of the month in each fold's past, half from the series and half from its donors, all folds scored at once."""
    test, train = forecasts(spark, sf)
    every = train.select("series", "tt", "y", "m").unionByName(test.select("series", "tt", "y", "m"))
    rows = B.folds(every, CUTS, "tt")
    own = rows.where("role = 'train'").groupBy("fold", "series", "m").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    pool = own.groupBy("fold", "m").agg(F.sum("s").alias("ps"), F.sum("n").alias("pn"))
    both = rows.where("role = 'test'").join(own, ["fold", "series", "m"], "left").join(pool, ["fold", "m"], "left")
    mine, n = c("s") / c("n"), c("pn") - F.coalesce("n", lit(0))
    donors = F.when(n > 0, (c("ps") - F.coalesce("s", lit(0.0))) / n)
    s = M.point_metrics(both.withColumn("p", (F.coalesce(mine, donors) + F.coalesce(donors, mine)) / 2), K, least=5)
    return s.select("series", c("n_test").alias("n"), r("RMSE").alias("rmse"))


CONF = f"""{FC}, ca AS (SELECT series, abs(y - persist) AS a FROM tr WHERE tt >= 10592), ls AS (SELECT series, list_sort(list(a)) AS s, count(*) AS n, (count(*) - 1) * least(1.0, ceil((count(*) + 1) * 0.9) / count(*)) AS z FROM ca GROUP BY series),
lv AS (SELECT series, s[CAST(floor(z) AS INT) + 1] + (coalesce(s[CAST(floor(z) AS INT) + 2], s[CAST(floor(z) AS INT) + 1]) - s[CAST(floor(z) AS INT) + 1]) * (z - floor(z)) AS q FROM ls),
iv AS (SELECT fc.*, persist - q AS lo, persist + q AS hi FROM fc JOIN lv ON lv.series = fc.series)"""


def intervals(spark, sf):
    test, train = forecasts(spark, sf)
    return B.conformal(train.where("tt >= 10592"), test, K, p="persist")


@query("l16_conformal", f"{CONF} SELECT series, tt, round(lo, 4) AS lo, round(hi, 4) AS hi FROM iv")
def l16(spark, sf):
    return intervals(spark, sf).select("series", "tt", r("lo").alias("lo"), r("hi").alias("hi"))


@query("m11_picp_mpiw", f"{CONF} SELECT series, round(avg(CAST(y BETWEEN lo AND hi AS INT)), 4) AS picp, round(avg(hi - lo), 4) AS mpiw, count(*) AS n FROM iv GROUP BY series")
def m11(spark, sf):
    m = M.interval_metrics(intervals(spark, sf), K, "y", "lo", "hi", {0.05: "lo", 0.5: "persist", 0.95: "hi"})
    return m.select("series", r("PICP").alias("picp"), r("MPIW").alias("mpiw"), "n")


@query("m12_pinball", f"{CONF} SELECT series, round((avg(greatest(0.05 * (y - lo), -0.95 * (y - lo))) + avg(greatest(0.5 * (y - persist), -0.5 * (y - persist))) + avg(greatest(0.95 * (y - hi), -0.05 * (y - hi)))) / 3, 4) AS pinball FROM iv GROUP BY series")
def m12(spark, sf):
    return M.interval_metrics(intervals(spark, sf), K, "y", "lo", "hi", {0.05: "lo", 0.5: "persist", 0.95: "hi"}).select("series", r("pinball").alias("pinball"))


QB = f"""{FC}, ca AS (SELECT * FROM tr WHERE tt >= 10227), eg AS (SELECT series, quantile_cont(persist, [i / 10.0 for i in range(1, 10)]) AS e FROM ca GROUP BY series),
cb AS (SELECT ca.series, len(list_filter(e, lambda x: persist > x)) AS b, quantile_cont(y - persist, [0.05, 0.5, 0.95]) AS q FROM ca JOIN eg ON eg.series = ca.series GROUP BY ALL),
tb AS (SELECT fc.*, len(list_filter(e, lambda x: persist > x)) AS b FROM fc JOIN eg ON eg.series = fc.series)"""


@query("l17_quantile_bands", f"{QB} SELECT tb.series, tt, round(persist + q[1], 4) AS q0, round(persist + q[2], 4) AS q1, round(persist + q[3], 4) AS q2 FROM tb JOIN cb ON cb.series = tb.series AND cb.b = tb.b")
def l17(spark, sf):
    test, train = forecasts(spark, sf)
    out = B.quantile_bands(train.where("tt >= 10227"), test, K, p="persist")
    return out.select("series", "tt", *[r(f"q{i}").alias(f"q{i}") for i in range(3)])


EV = f"""{FC}, th AS (SELECT series, CASE WHEN count(y) >= 20 THEN quantile_cont(y, 0.9) END AS thr FROM tr GROUP BY series),
ev2 AS (SELECT fc.series, y, persist, CAST(y > thr AS DOUBLE) AS label, round(persist / (persist + thr), 3) AS prob FROM fc JOIN th ON th.series = fc.series)"""


def events_(spark, sf):
    test, train = forecasts(spark, sf)
    e = test.join(B.thresholds(train, "series"), "series")
    return e.withColumn("label", (c("y") > c("thr")).cast("double")).withColumn("prob", F.round(c("persist") / (c("persist") + c("thr")), 3))


@query("m13_event_scores", f"{EV}, s AS (SELECT series, count(*) FILTER (prob > 0.5 AND label > 0.5) AS tp, count(*) FILTER (prob > 0.5 AND label <= 0.5) AS fp, count(*) FILTER (prob <= 0.5 AND label > 0.5) AS fn FROM ev2 GROUP BY series) SELECT series, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM s")
def m13(spark, sf):
    return M.event_metrics(events_(spark, sf), K).select("series", r("precision").alias("precision"), r("recall").alias("recall"), r("f1").alias("f1"))


@query("m14_conditional_rmse", f"{EV} SELECT series, round(sqrt(avg((persist - y) ** 2) FILTER (label > 0.5)), 4) AS spike, round(sqrt(avg((persist - y) ** 2) FILTER (label <= 0.5)), 4) AS other, count(*) FILTER (label > 0.5) AS n_spike FROM ev2 GROUP BY series")
def m14(spark, sf):
    m = M.event_metrics(events_(spark, sf), K, y="y", p="persist")
    return m.select("series", r("rmse_spike").alias("spike"), r("rmse_nonspike").alias("other"), "n_spike")


PR = f"""{EV}, sc AS (SELECT series, prob, count(*) FILTER (label > 0.5) AS tp, count(*) AS n FROM ev2 GROUP BY ALL), ct AS (SELECT series, prob AS threshold, sum(tp) OVER (PARTITION BY series ORDER BY prob DESC) AS ctp, sum(n) OVER (PARTITION BY series ORDER BY prob DESC) AS cn, sum(tp) OVER (PARTITION BY series) AS pos FROM sc), pr AS (SELECT series, threshold, ctp / cn AS precision, ctp / nullif(pos, 0) AS recall FROM ct)"""


@query("l24_pr_curve", f"{PR} SELECT series, threshold, round(precision, 4) AS precision, round(recall, 4) AS recall FROM pr")
def l24(spark, sf):
    return B.pr_curve(events_(spark, sf), "prob", "label", K).select("series", "threshold", r("precision").alias("precision"), r("recall").alias("recall"))


@query("l24_operating_point", f"{PR} SELECT series, max(threshold) AS threshold, round(arg_max(precision, threshold), 4) AS precision FROM pr WHERE recall >= 0.8 GROUP BY series")
def l24b(spark, sf):
    return B.operating_point(B.pr_curve(events_(spark, sf), "prob", "label", K), K).select("series", "threshold", r("precision").alias("precision"))


CELL = "CASE WHEN label > 0.5 AND prob > 0.5 THEN 'TP' WHEN prob > 0.5 THEN 'FP' WHEN label > 0.5 THEN 'FN' ELSE 'TN' END"


@query("a27_confusion_context", f"{EV} SELECT {CELL} AS cell, count(*) AS n, round(avg(persist), 4) AS persist FROM ev2 GROUP BY ALL")
def a27(spark, sf):
    return events_(spark, sf).groupBy(confusion(c("label") > 0.5, c("prob") > 0.5).alias("cell")).agg(F.count(lit(1)).alias("n"), r(F.avg("persist")).alias("persist"))


@query("a27_fp_by_month", f"{EV} SELECT month(DATE '1970-01-01' + CAST(tt AS INT)) AS m, count(*) AS n, round(avg(CAST(prob > 0.5 AND label <= 0.5 AS INT)), 4) AS fp_rate FROM (SELECT fc.tt, CAST(fc.y > thr AS DOUBLE) AS label, round(persist / (persist + thr), 3) AS prob FROM fc JOIN th ON th.series = fc.series) GROUP BY ALL")
def a27b(spark, sf):
    cell = confusion(c("label") > 0.5, c("prob") > 0.5)
    return events_(spark, sf).groupBy("m").agg(F.count(lit(1)).alias("n"), r(F.avg((cell == "FP").cast("int"))).alias("fp_rate"))


@query("a24_mean_delta", f"{FC}, s AS (SELECT series, {SQ} AS a, sqrt(avg((clim - y) ** 2)) AS b FROM fc GROUP BY series) SELECT round(avg(a - b), 4) AS delta FROM s")
def a24(spark, sf):
    s = forecasts(spark, sf)[0].groupBy("series").agg(M.rmse(c("y"), c("persist")).alias("a"), M.rmse(c("y"), c("clim")).alias("b"))
    return s.agg(r(F.avg(c("a") - c("b"))).alias("delta"))


@query("l22_comparison", f"{FC} SELECT series, round({SQ}, 4) AS persistence, round(sqrt(avg((clim - y) ** 2)), 4) AS climatology FROM fc GROUP BY series")
def l22(spark, sf):
    f = forecasts(spark, sf)[0]
    long = f.select("series", "y", F.explode(F.array(F.struct(lit("persistence").alias("model"), c("persist").alias("p")), F.struct(lit("climatology").alias("model"), c("clim").alias("p")))).alias("z")).select("series", "y", "z.*")
    s = M.point_metrics(long, ["series", "model"]).groupBy("series").pivot("model", ["persistence", "climatology"]).agg(F.first("RMSE"))
    return s.select("series", r("persistence").alias("persistence"), r("climatology").alias("climatology"))


DECAY = f"""WITH {DAILY}, f AS (SELECT b.series, x.n AS hz, b.d AS tt, b.y, a.y AS persist, month(DATE '1970-01-01' + CAST(b.d AS INT)) AS m FROM o a, (VALUES (1), (3), (7), (14)) x(n), o b WHERE b.series = a.series AND b.d = a.d + x.n),
tr AS (SELECT DISTINCT series, tt, y, m FROM f WHERE tt < 10957 AND hz = 1), te AS (SELECT * FROM f WHERE tt >= 10957),
tn AS (SELECT series, count(*) AS n, avg(y) AS own_mean FROM tr GROUP BY series), ow AS (SELECT series, m, avg(y) AS own FROM tr GROUP BY ALL), pl AS (SELECT m, avg(y) AS pooled FROM tr GROUP BY m),
fc AS (SELECT te.*, CASE WHEN coalesce(n, 0) >= 24 THEN coalesce(own, own_mean) ELSE coalesce(pooled, (SELECT avg(y) FROM tr)) END AS clim
  FROM te LEFT JOIN tn ON tn.series = te.series LEFT JOIN ow ON ow.series = te.series AND ow.m = te.m LEFT JOIN pl ON pl.m = te.m),
sk AS (SELECT series, hz, 1 - sqrt(avg((clim - y) ** 2)) / sqrt(avg((persist - y) ** 2)) AS skill FROM fc GROUP BY ALL HAVING count(*) >= 10)"""


@query("l22_skill_decay", f"{DECAY} SELECT series, round(max(skill) FILTER (hz = 1), 4) AS h1, round(max(skill) FILTER (hz = 3), 4) AS h3, round(max(skill) FILTER (hz = 7), 4) AS h7, round(max(skill) FILTER (hz = 14), 4) AS h14 FROM sk GROUP BY series")
def l22b(spark, sf):
    """Skill of the climatology over persistence by horizon in days."""
    horizons = (1, 3, 7, 14)
    o = daily(spark, sf)
    ahead = o.select("series", F.explode(F.array(*[lit(h) for h in horizons])).alias("hz"), "d", c("y").alias("persist")).withColumn("tt", c("d") + c("hz"))
    f = ahead.join(o.select("series", c("d").alias("tt"), "y"), ["series", "tt"]).withColumn("m", F.month(F.date_add(lit("1970-01-01").cast("date"), c("tt").cast("int"))))
    test = B.climatology(f.where("tt < 10957 AND hz = 1"), f.where("tt >= 10957"), "series", ["m"])
    s = M.point_metrics(test, ["series", "hz"], p="clim", naive="persist", least=10)
    return s.groupBy("series").pivot("hz", list(horizons)).agg(F.first("skill_persist")).select("series", *[r(c(str(h))).alias(f"h{h}") for h in horizons])


@query("a36_hourly_to_daily", f"{HP}, f AS (SELECT b.series, b.t // 24 AS d, b.y, a.y AS p FROM h a JOIN h b ON b.series = a.series AND b.t = a.t + 24), z AS (SELECT series, d, avg(y) AS y, avg(p) AS p FROM f WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY ALL), dy AS (SELECT series, t // 24 AS d, avg(y) AS y FROM h GROUP BY ALL), w AS (SELECT z.series, z.y, z.p, dy.y AS q FROM z JOIN dy ON dy.series = z.series AND dy.d = z.d - 1 WHERE dy.y IS NOT NULL) SELECT series, count(*) AS n, round(sqrt(avg((p - y) ** 2)), 4) AS hourly, round(sqrt(avg((q - y) ** 2)), 4) AS daily FROM w GROUP BY series")
def a36(spark, sf):
    """Hourly forecasts averaged to days, and the forecast from the day before's mean, scored on the same days."""
    h = panel(spark, sf)
    f = align(h, K, ["y"], [], "y", [24]).select("series", F.floor(c("tt") / 24).alias("d"), c("y").alias("p"), c("target").alias("y")).na.drop()
    z = f.groupBy("series", "d").agg(F.avg("y").alias("y"), F.avg("p").alias("p"))
    w = z.join(h.groupBy("series", (F.floor(c("t") / 24) + 1).alias("d")).agg(F.avg("y").alias("q")), ["series", "d"]).where("q IS NOT NULL")
    a = M.point_metrics(w, K).select("series", c("n_test").alias("n"), r("RMSE").alias("hourly"))
    return a.join(M.point_metrics(w, K, p="q").select("series", r("RMSE").alias("daily")), "series")


@query("l1_mean_imputation", f"{HP} SELECT series, t, round(coalesce(y, (SELECT avg(y) FROM h)), 4) AS y FROM h")
def l1(spark, sf):
    from pyspark.ml.feature import Imputer
    h = panel(spark, sf)
    return Imputer(strategy="mean", inputCols=["y"], outputCols=["f"]).fit(h).transform(h).select("series", "t", r("f").alias("y"))


@query("l6_class_guard", f"{EV} SELECT series, least(count(*) FILTER (label > 0.5), count(*) FILTER (label <= 0.5)) >= 5 AS trains FROM ev2 GROUP BY series")
def l6(spark, sf):
    from .models import trainable
    return trainable(events_(spark, sf), K).select("series", "trains")
