"""Queries: ablations, A/B tests, transformed targets and direct forecasts by grouped ridge regression.

Each query scans its rows once for moments; all its models and scores are read from these. The DuckDB texts fit the same models
from the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import ridge
from ..operators.asof import asof, recency
from ..operators.flux import mdc_fill
from ..operators.gaps import interpolate
from ..operators.grid import complete_grid, lags, lookback_arrays
from ..operators.select import quantiles
from . import backtest as B
from .q_series import CUTS, CV_SQL, LINE, MDC, SK, scenarios
from .registry import DAILY, PANEL, daily, panel, query, r, readings

c, lit = F.col, F.lit
CUT = 10957
PENALTY = 1e-3
SEASON, WEEK, LAGS, COUNTS = ["hs", "hc"], ["ws", "wc"], ["y_lag1", "y_lag2", "y_lag7"], ["n_lag1"]
FEATURES = [*LAGS, *COUNTS, *SEASON, *WEEK]


def _vector(parts: list[str]) -> str:
    return "[" + ", ".join(parts) + "]"


def ridge_sql(k: int, sets: dict[str, list[int]]) -> str:
    """CTEs from rw (grp, series, test, y, f: k features) to pd (..., model, p): one fit for each grp and set of places in f."""
    idx = range(1, k + 1)
    values = ", ".join(f"('{n}', {[i + 1 for i in ix]})" for n, ix in sets.items())
    return f"""mu AS (SELECT grp, avg(y) AS my, {_vector([f'avg(f[{i}])' for i in idx])} AS m FROM rw WHERE y IS NOT NULL AND NOT test GROUP BY grp),
z AS (SELECT rw.*, my, [coalesce(f[i] - coalesce(m[i], 0), 0.0) for i in range(1, {k + 1})] AS dv FROM rw JOIN mu ON mu.grp = rw.grp),
cv AS (SELECT grp, {_vector([_vector([f'avg(dv[{i}] * dv[{j}])' for j in idx]) for i in idx])} AS c, {_vector([f'avg(dv[{i}] * (y - my))' for i in idx])} AS r FROM z WHERE y IS NOT NULL AND NOT test GROUP BY grp),
st AS (SELECT * FROM (VALUES {values}) v(model, ix)),
a0 AS (SELECT grp, model, ix, [CASE WHEN c[i][i] > 0 THEN sqrt(c[i][i]) ELSE 1.0 END for i in ix] AS sd, c, r FROM cv, st),
a1 AS (SELECT grp, model, ix, sd, 1 AS k, [list_append([c[ix[p]][ix[q]] / (sd[p] * sd[q]) + CASE WHEN p = q THEN {PENALTY} ELSE 0.0 END for q in range(1, len(ix) + 1)], r[ix[p]] / sd[p]) for p in range(1, len(ix) + 1)] AS a FROM a0
  UNION ALL SELECT grp, model, ix, sd, k + 1, [CASE WHEN i = k THEN [x / a[k][k] for x in a[k]] ELSE [a[i][j] - a[i][k] / a[k][k] * a[k][j] for j in range(1, len(ix) + 2)] END for i in range(1, len(ix) + 1)] FROM a1 WHERE k <= len(ix)),
cf AS (SELECT grp, model, ix, [a[i][len(ix) + 1] / sd[i] for i in range(1, len(ix) + 1)] AS b FROM a1 WHERE k = len(ix) + 1),
pd AS (SELECT z.*, model, my + list_sum([b[i] * dv[ix[i]] for i in range(1, len(ix) + 1)]) AS p FROM z JOIN cf ON cf.grp = z.grp)"""


SCORES = "round(sqrt(avg((y - p) ** 2)), 4) AS RMSE, round(1 - avg((y - p) ** 2) / nullif(var_pop(y), 0), 4) AS R2, count(*) AS n_test"
SCORED = f"SELECT series, model, {SCORES} FROM pd WHERE test AND y IS NOT NULL GROUP BY ALL"
DAYS = f"""{DAILY}, gd AS (SELECT series, unnest(generate_series(lo, hi)) AS d FROM (SELECT DISTINCT series FROM o), (SELECT min(d) AS lo, max(d) AS hi FROM o)),
dm AS (SELECT gd.series, gd.d, y, n, lag(y, 1) OVER w AS l1, lag(y, 2) OVER w AS l2, lag(y, 7) OVER w AS l7, lag(CAST(n AS DOUBLE), 1) OVER w AS nl, 2 * pi() * dayofyear(DATE '1970-01-01' + CAST(gd.d AS INT)) / 365 AS u, 2 * pi() * (gd.d % 7) / 7 AS v
  FROM gd LEFT JOIN o ON o.series = gd.series AND o.d = gd.d WINDOW w AS (PARTITION BY gd.series ORDER BY gd.d))"""
DAY_ROWS = f"rw AS (SELECT '' AS grp, series, d, d >= {CUT} AS test, y, [l1, l2, l7, nl, sin(u), cos(u), sin(v), cos(v)] AS f FROM dm)"


def grid_days(spark, sf) -> DataFrame:
    """(series, d, y, n, features): the daily matrix on a complete grid; lags by days, so no feature sees its own day."""
    o = daily(spark, sf)
    m = complete_grid(o, ["series"], "d").join(o, ["series", "d"], "left").withColumn("n", c("n").cast("double"))
    m = lags(lags(m, ["series"], "y", [1, 2, 7], t="d"), ["series"], "n", [1], t="d")
    hs, hc = X.cyclic(F.dayofyear(F.date_add(lit("1970-01-01").cast("date"), c("d").cast("int"))), 365)
    ws, wc = X.cyclic(F.pmod("d", lit(7)), 7)
    return m.withColumns({"hs": hs, "hc": hc, "ws": ws, "wc": wc})


def pooled(rows: DataFrame, test: Column, sets: dict[str, list[str]], y: str = "y") -> DataFrame:
    """Scores by series of one model per feature set, fitted on the training rows of all series."""
    cols = [*dict.fromkeys(f for fs in sets.values() for f in fs), y]
    mom = ridge.moments(rows.where(c(y).isNotNull()).withColumn("test", test), ["series", "test"], cols)
    models = ridge.fit(ridge.merged(mom.where("NOT test"), []), [], cols, {n: (fs, y) for n, fs in sets.items()}, PENALTY)
    out = ridge.scored(mom.where("test"), ["series"], len(cols), models, [])
    return out.select("series", "model", r("RMSE").alias("RMSE"), r("R2").alias("R2"), "n_test")


GROUPS = {"lags": LAGS, "counts": COUNTS, "week": WEEK}
#: Base, base with each group alone, then the groups added one by one, the last set being all.
ABLATION = {"base": SEASON} | {f"base+{g}": [*SEASON, *fs] for g, fs in GROUPS.items()} | {
    f"up to {g}": SEASON + [f for h in list(GROUPS)[: i + 1] for f in GROUPS[h]] for i, g in enumerate(GROUPS)}
_PLACES = lambda sets, order: {n: [order.index(f) for f in fs] for n, fs in sets.items()}


@query("l13_ablation", f"WITH RECURSIVE {DAYS}, {DAY_ROWS}, {ridge_sql(8, _PLACES(ABLATION, FEATURES))} {SCORED}")
def l13(spark, sf):
    """Leave one group in, and cumulative."""
    return pooled(grid_days(spark, sf), c("d") >= CUT, ABLATION)


_POOL_ROWS = f"""r0 AS (SELECT series, d >= {CUT} AS test, y, [l1, l2, l7, nl, sin(u), cos(u), sin(v), cos(v)] AS f FROM dm WHERE y IS NOT NULL),
sm AS (SELECT series, avg(y) AS sy, {_vector([f'avg(f[{i}])' for i in range(1, 9)])} AS sf FROM r0 WHERE NOT test GROUP BY series),
rw AS (SELECT 'full' AS grp, 'full' AS kind, series, test, y, f, 0.0 AS back FROM r0 UNION ALL SELECT 'solo ' || series, 'solo', series, test, y, f, 0.0 FROM r0
  UNION ALL SELECT 'partial', 'partial', series, test, y - sy, [f[i] - sf[i] for i in range(1, 9)], sy FROM r0 JOIN sm USING (series))"""


@query("l12_ridge_pooling", f"WITH RECURSIVE {DAYS}, {_POOL_ROWS}, {ridge_sql(8, {'ridge': list(range(8))})} SELECT series, kind AS model, {SCORES} FROM pd WHERE test GROUP BY ALL")
def l12(spark, sf):
    """A model of each series, one of all, and one with common slopes and a level of each series; no loop over series."""
    rows = grid_days(spark, sf).where("y IS NOT NULL").withColumn("test", c("d") >= CUT)
    own = rows.where("NOT test").groupBy("series").agg(*[F.avg(x).alias(f"m_{x}") for x in (*FEATURES, "y")])
    cols, sets = [*FEATURES, "y"], {"ridge": (FEATURES, "y")}
    mom = ridge.moments(rows, ["series", "test"], cols)
    train, test = mom.where("NOT test").drop("test"), mom.where("test").drop("test")
    solo = ridge.scored(test, ["series"], len(cols), ridge.fit(train, ["series"], cols, sets, PENALTY), ["series"])
    full = ridge.scored(test, ["series"], len(cols), ridge.fit(ridge.merged(train, []), [], cols, sets, PENALTY), [])
    level = rows.join(own, "series").select("series", "test", *[(c(x) - c(f"m_{x}")).alias(x) for x in cols])
    about = ridge.moments(level, ["series", "test"], cols)
    part = ridge.scored(about.where("test").drop("test"), ["series"], len(cols), ridge.fit(ridge.merged(about.where("NOT test"), []), [], cols, sets, PENALTY), [])
    out = solo.withColumn("model", lit("solo")).unionByName(full.withColumn("model", lit("full"))).unionByName(part.withColumn("model", lit("partial")))
    return out.select("series", "model", r("RMSE").alias("RMSE"), r("R2").alias("R2"), "n_test")


LAG_TEST = {"without": [*COUNTS, *SEASON], "with": [*LAGS, *COUNTS, *SEASON]}


@query("l14_lag_test", f"WITH RECURSIVE {DAYS}, {DAY_ROWS}, {ridge_sql(8, _PLACES(LAG_TEST, FEATURES))} {SCORED}")
def l14_lag(spark, sf):
    return pooled(grid_days(spark, sf), c("d") >= CUT, LAG_TEST)


CLOCK = ["sw", "hs", "hc", "ds", "dc"]
_CLOCK_SQL = "sw, sin(2 * pi() * (t % 24) / 24), cos(2 * pi() * (t % 24) / 24), sin(2 * pi() * dayofyear(DATE '1970-01-01' + CAST(t // 24 AS INT)) / 365), cos(2 * pi() * dayofyear(DATE '1970-01-01' + CAST(t // 24 AS INT)) / 365)"


def clocked(h: DataFrame) -> DataFrame:
    """The hourly panel with clock and calendar, and `test`: after the middle hour of the table."""
    hs, hc = X.cyclic(F.pmod("t", lit(24)), 24)
    ds, dc = X.cyclic(F.dayofyear(F.date_add(lit("1970-01-01").cast("date"), F.floor(c("t") / 24).cast("int"))), 365)
    cut = h.agg(F.expr("(min(t) + max(t)) div 2").alias("cut"))  # one row
    return h.join(F.broadcast(cut)).withColumns({"hs": hs, "hc": hc, "ds": ds, "dc": dc, "test": c("t") >= c("cut")}).drop("cut")


_TA = MDC.replace(PANEL, PANEL.replace("h AS (SELECT gr", "h0 AS (SELECT gr") + ", h AS (SELECT series, t, ta AS y FROM h0)").replace("WITH", "WITH RECURSIVE", 1)
MET_TEST = {"observed": ["ta", *CLOCK], "filled": ["ta_f", *CLOCK]}


@query("l14_met_fill_test", f"""{_TA}, tf AS (SELECT series, t, coalesce(x, avg(x) OVER (PARTITION BY series, hr), avg(x) OVER (PARTITION BY series)) AS ta_f FROM x5),
rw AS (SELECT '' AS grp, h0.series, t >= (SELECT (min(t) + max(t)) // 2 FROM h0) AS test, h0.y, [ta, ta_f, {_CLOCK_SQL}] AS f FROM h0 JOIN tf USING (series, t)),
{ridge_sql(7, _PLACES(MET_TEST, ["ta", "ta_f", *CLOCK]))} {SCORED}""")
def l14_met(spark, sf):
    """Meteorology as observed, its holes taking the training mean, against filled by the diurnal course; the same rows in both."""
    h = mdc_fill(panel(spark, sf), ["series"], "ta", "ta_f")
    return pooled(clocked(h), c("test"), MET_TEST)


MANAGED = {"without": ["ta", *CLOCK], "with": ["ta", *CLOCK, "recent"]}


@query("l14_management_test", f"""WITH RECURSIVE {PANEL}, er AS (SELECT series, t FROM ev WHERE value > 200 GROUP BY ALL),
rw AS (SELECT '' AS grp, h.series, h.t >= (SELECT (min(t) + max(t)) // 2 FROM h) AS test, y, [ta, {_CLOCK_SQL.replace('(t ', '(h.t ')}, coalesce(exp(-(h.t - er.t) / 24.0 / 14.0), 0)] AS f FROM h ASOF LEFT JOIN er ON er.series = h.series AND h.t >= er.t),
{ridge_sql(7, _PLACES(MANAGED, ["ta", *CLOCK, "recent"]))} {SCORED}""")
def l14_management(spark, sf):
    """With and without the recency of the last event (a reading over 200), on the same rows."""
    events = readings(spark, sf).where(c("value") > 200).groupBy("series", "t").agg(F.max("value").alias("value"))
    known = asof(panel(spark, sf), events, ["series"], "value")
    return pooled(clocked(known.withColumn("recent", recency((c("t") - c("event_t")) / 24.0, 14))), c("test"), MANAGED)


_PLAIN = [*LAGS, *COUNTS, *SEASON]


@query("l15_transformed_target", f"""WITH RECURSIVE {DAYS}, {DAY_ROWS.replace('test, y,', 'test, y AS y0, asinh(y) AS y,')}, {ridge_sql(8, _PLACES({'asinh': _PLAIN}, FEATURES))},
q AS (SELECT quantile_cont(y - p, [0.01 + 0.98 * i / 255.0 for i in range(0, 256)]) AS q FROM pd WHERE NOT test AND y IS NOT NULL),
b AS (SELECT series, model, test, y0 AS y, list_avg([sinh(p + x) for x in q]) AS p FROM pd, q) {SCORED.replace('FROM pd', 'FROM b')}""")
def l15(spark, sf):
    """The target fitted as asinh, back by smearing over 256 quantiles of the training residuals."""
    rows = grid_days(spark, sf).withColumn("z", F.asinh("y")).where("y IS NOT NULL")
    cols = [*_PLAIN, "z"]
    model = ridge.fit(ridge.moments(rows.where(c("d") < CUT), [], cols), [], cols, {"asinh": (_PLAIN, "z")}, PENALTY)
    out = ridge.predicted(rows, cols, model, [])
    q = quantiles(out.where(c("d") < CUT).withColumn("e", c("z") - c("p")), [], "e", [0.01 + 0.98 * i / 255 for i in range(256)])
    out = out.where(c("d") >= CUT).join(F.broadcast(q.select(c("q").alias("e")))).withColumn("p", X.smear(c("p"), c("e")))  # one row
    err = F.avg((c("y") - c("p")) ** 2)
    return out.groupBy("series", "model").agg(r(F.sqrt(err)).alias("RMSE"), r(1 - err / F.nullif(F.var_pop("y"), lit(0.0))).alias("R2"), F.count(lit(1)).alias("n_test"))


LOOK, AHEAD = 12, (1, 6, 12, 24)
_SMOOTH = [f"({' + '.join(f'p[{min(max(j, 1), LOOK)}]' for j in range(i - 2, i + 3))}) / 5" for i in range(1, LOOK + 1)]


def _l21_sql() -> str:
    filled = LINE.format(limit=1 << 40)
    look = f"""lb AS (SELECT series, t, list(x) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN {LOOK - 1} PRECEDING AND CURRENT ROW) AS p, list(x) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {AHEAD[-1]} FOLLOWING) AS f FROM (SELECT series, t, x FROM ip)),
lk AS (SELECT series, t, [v for v in p if v IS NOT NULL] AS p, [v for v in f if v IS NOT NULL] AS f FROM lb),
ok AS (SELECT *, {_vector(_SMOOTH)} AS tr FROM lk WHERE len(p) = {LOOK} AND len(f) = {AHEAD[-1]}),
ct AS (SELECT (min(t) + max(t)) // 2 AS cut FROM ok),
rw AS (SELECT CAST(hz AS VARCHAR) AS grp, hz, series, t >= cut AS test, ok.f[hz] AS y, list_concat(tr, [p[i] - tr[i] for i in range(1, {LOOK + 1})]) AS f FROM ok, ct, (SELECT unnest({list(AHEAD)}) AS hz))"""
    return f"WITH RECURSIVE {PANEL}, {filled}, {look}, {ridge_sql(2 * LOOK, {'decomposition': list(range(2 * LOOK))})} SELECT series, CAST(hz AS INT) AS h, {SCORES} FROM pd WHERE test AND y IS NOT NULL GROUP BY ALL"


@query("l21_decomposition_linear", _l21_sql())
def l21(spark, sf):
    """Trend and rest of the last 12 hours, one model for each horizon, all from one matrix."""
    h = interpolate(panel(spark, sf), ["series"], "y", "f").select("series", "t", c("f").alias("y"))
    a = lookback_arrays(h, ["series"], "y", LOOK, AHEAD[-1]).withColumn("tr", X.moving_average(c("past"), 5))
    trend, rest = [f"trend{i}" for i in range(LOOK)], [f"rest{i}" for i in range(LOOK)]
    a = a.select("series", "t", *[F.get("tr", lit(i)).alias(n) for i, n in enumerate(trend)], *[(F.get("past", lit(i)) - F.get("tr", lit(i))).alias(n) for i, n in enumerate(rest)], *[F.get("future", lit(k - 1)).alias(f"y{k}") for k in AHEAD])
    cut = a.agg(F.expr("(min(t) + max(t)) div 2").alias("cut"))  # one row
    cols = [*trend, *rest, *[f"y{k}" for k in AHEAD]]
    mom = ridge.moments(a.join(F.broadcast(cut)).withColumn("test", c("t") >= c("cut")), ["series", "test"], cols)
    models = ridge.fit(ridge.merged(mom.where("NOT test"), []), [], cols, {str(k): ([*trend, *rest], f"y{k}") for k in AHEAD}, PENALTY)
    out = ridge.scored(mom.where("test"), ["series"], len(cols), models, [])
    return out.select("series", c("model").cast("int").alias("h"), r("RMSE").alias("RMSE"), r("R2").alias("R2"), "n_test")


HOURS, DAYS_AHEAD = (1, 6, 12, 24, 48), (1, 3, 7, 14)


def direct(m: DataFrame, t: str, horizons: tuple[int, ...], features: list[str], cut: DataFrame) -> DataFrame:
    """Scores by series and horizon of one pooled model per horizon, from origins with a value, trained on targets before the cut; persist: RMSE of the origin's value."""
    future = m.select("series", c(t).alias("tt"), c("y").alias("target"), F.explode(F.array(*[lit(h) for h in horizons])).alias("h")).where("target IS NOT NULL")
    rows = m.where("y IS NOT NULL").withColumnRenamed("y", "now").join(future.withColumn(t, c("tt") - c("h")), ["series", t]).join(F.broadcast(cut)).withColumn("test", c("tt") >= c("cut"))
    cols = ["now", *features, "target"]
    k = len(cols) - 1
    mom = ridge.moments(rows, ["series", "h", "test"], cols)
    models = ridge.fit(ridge.merged(mom.where("NOT test"), ["h"]), ["h"], cols, {"ridge": (cols[:-1], "target")}, PENALTY)
    cell = ridge.cell
    naive = ridge.matrices(mom.where("test"), ["series", "h"], len(cols)).select("series", "h", F.sqrt((cell(0, 0)["s"] + cell(k, k)["s"] - 2 * cell(0, k)["s"]) / cell(0, k)["n"]).alias("persist"))
    return ridge.scored(mom.where("test"), ["series", "h"], len(cols), models, ["h"]).join(naive, ["series", "h"])


_HOURLY = f"""{PANEL}, hm AS (SELECT series, t, y, lag(y, 1) OVER w AS l1, lag(y, 2) OVER w AS l2, lag(y, 24) OVER w AS l24 FROM h WINDOW w AS (PARTITION BY series ORDER BY t)),
al AS (SELECT CAST(hz AS VARCHAR) AS grp, hz, a.series, b.t >= (SELECT (min(t) + max(t)) // 2 FROM h) AS test, b.y, a.y AS now, [a.y, a.l1, a.l2, a.l24, sin(2 * pi() * (a.t % 24) / 24), cos(2 * pi() * (a.t % 24) / 24)] AS f
  FROM hm a, (SELECT unnest({list(HOURS)}) AS hz), h b WHERE b.series = a.series AND b.t = a.t + hz AND b.y IS NOT NULL AND a.y IS NOT NULL),
rw AS (SELECT * FROM al)"""
_SKILL = "CASE WHEN sum((y - now) ** 2) > 0 THEN round(1 - sqrt(avg((y - p) ** 2)) / sqrt(avg((y - now) ** 2)), 4) END AS skill_persist"
_DIRECT = f"SELECT '{{track}}' AS track, series, CAST(hz AS INT) AS h, {SCORES}, {_SKILL} FROM pd WHERE test GROUP BY series, hz HAVING count(*) >= 10"


def tracked(scores: DataFrame, track: str) -> DataFrame:
    skill = F.when(c("persist") > 0, 1 - c("RMSE") / c("persist"))
    return scores.where("n_test >= 10").select(lit(track).alias("track"), "series", "h", r("RMSE").alias("RMSE"), r("R2").alias("R2"), "n_test", r(skill).alias("skill_persist"))


@query("l10_ridge_hours", f"WITH RECURSIVE {_HOURLY}, {ridge_sql(6, {'ridge': list(range(6))})} {_DIRECT.format(track='A')}")
def l10_hours(spark, sf):
    """Track A: hours ahead, from origins with a value."""
    m = lags(panel(spark, sf).select("series", "t", "y"), ["series"], "y", [1, 2, 24])
    hs, hc = X.cyclic(F.pmod("t", lit(24)), 24)
    cut = m.agg(F.expr("(min(t) + max(t)) div 2").alias("cut"))
    rows = m.withColumns({"hs": hs, "hc": hc})
    return tracked(direct(rows, "t", HOURS, ["y_lag1", "y_lag2", "y_lag24", "hs", "hc"], cut), "A")


_DAILY_ROWS = f"""al AS (SELECT CAST(hz AS VARCHAR) AS grp, hz, a.series, b.d >= {CUT} AS test, b.y, a.y AS now, [a.y, a.l1, a.l2, a.l7, a.nl, sin(a.u), cos(a.u), sin(a.v), cos(a.v)] AS f
  FROM dm a, (SELECT unnest({list(DAYS_AHEAD)}) AS hz), dm b WHERE b.series = a.series AND b.d = a.d + hz AND b.y IS NOT NULL AND a.y IS NOT NULL),
rw AS (SELECT * FROM al)"""


@query("l10_ridge_days", f"WITH RECURSIVE {DAYS}, {_DAILY_ROWS}, {ridge_sql(9, {'ridge': list(range(9))})} {_DIRECT.format(track='B')}")
def l10_days(spark, sf):
    """Track B: days ahead, from origins with a value."""
    cut = spark.range(1).select(lit(CUT).alias("cut"))
    return tracked(direct(grid_days(spark, sf), "d", DAYS_AHEAD, FEATURES, cut), "B")


_FOLD_VALUES = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(CUTS))
_FOLD_ROWS = f"""fr AS (SELECT fold, dm.series, dm.d >= a AS test, y, [l1, l2, l7, nl, sin(u), cos(u), sin(v), cos(v)] AS f FROM dm JOIN (VALUES {_FOLD_VALUES}) k(fold, a, b) ON dm.d < b),
rw AS (SELECT 'pool ' || CAST(fold AS VARCHAR) AS grp, 'donors' AS kind, * FROM fr UNION ALL SELECT series || ' ' || CAST(fold AS VARCHAR), 'own', * FROM fr)"""


@query("l11_ridge_folds", f"WITH RECURSIVE {DAYS}, {_FOLD_ROWS}, {ridge_sql(8, {'ridge': list(range(8))})} SELECT series, kind, round(sqrt(avg((y - p) ** 2)), 4) AS RMSE, count(*) AS n_test FROM pd WHERE test AND y IS NOT NULL GROUP BY ALL HAVING count(*) >= 5")
def l11_folds(spark, sf):
    """Expanding folds: a model of the series' own past and one with all donors' pasts merged in, the folds' errors scored at once."""
    rows = B.folds(grid_days(spark, sf).where("y IS NOT NULL"), CUTS, "d")
    cols = [*FEATURES, "y"]
    mom = ridge.moments(rows, ["fold", "series", "role"], cols)
    train, test, sets = mom.where("role = 'train'").drop("role"), mom.where("role = 'test'").drop("role"), {"ridge": (FEATURES, "y")}
    own = ridge.scored(test, ["fold", "series"], len(cols), ridge.fit(train, ["fold", "series"], cols, sets, PENALTY), ["fold", "series"]).withColumn("kind", lit("own"))
    donors = ridge.scored(test, ["fold", "series"], len(cols), ridge.fit(ridge.merged(train, ["fold"]), ["fold"], cols, sets, PENALTY), ["fold"]).withColumn("kind", lit("donors"))
    n = F.sum("n_test")
    out = own.unionByName(donors).groupBy("series", "kind").agg(r(F.sqrt(F.sum(c("n_test") * c("RMSE") ** 2) / n)).alias("RMSE"), n.alias("n_test"))
    return out.where("n_test >= 5")


SOURCES = {"own": ["ta", "sw", "hs", "hc"], "site": ["sta", "sw", "hs", "hc"]}
_SOURCE_ROWS = """rw AS (SELECT gap || '|' || rep AS grp, gap, rep, own AS series, y IS NULL AS test, obs AS y, [ta, sw, sin(2 * pi() * (t % 24) / 24), cos(2 * pi() * (t % 24) / 24), sta] AS f FROM cv0)"""


@query("g11_ridge_source_ab", f"""{CV_SQL},
e AS (SELECT gap, rep, series, model, sqrt(avg((y - p) ** 2)) AS rmse FROM (WITH RECURSIVE {_SOURCE_ROWS}, {ridge_sql(5, {'own': [0, 1, 2, 3], 'site': [4, 1, 2, 3]})} SELECT * FROM pd) WHERE test GROUP BY ALL HAVING count(*) >= 5),
b AS (SELECT gap, series, median(rmse) FILTER (model = 'own') AS own, median(rmse) FILTER (model = 'site') AS site FROM e GROUP BY ALL)
SELECT gap, series, round(own, 4) AS own, round(site, 4) AS site, round(site - own, 4) + 0.0 AS delta FROM b""")
def g11_ridge(spark, sf):
    """Drivers of the series against drivers of the site, under a pooled ridge model for each gap scenario."""
    hs, hc = X.cyclic(F.pmod("t", lit(24)), 24)
    rows = scenarios(spark, sf).withColumns({"hs": hs, "hc": hc, "test": c("y").isNull()})
    cols = ["ta", "sw", "hs", "hc", "sta", "obs"]
    mom = ridge.moments(rows, [*SK, "test"], cols)
    models = ridge.fit(ridge.merged(mom.where("NOT test"), ["gap", "rep"]), ["gap", "rep"], cols, {n: (fs, "obs") for n, fs in SOURCES.items()}, PENALTY)
    scores = ridge.scored(mom.where("test").drop("test"), SK, len(cols), models, ["gap", "rep"]).where("n_test >= 5")
    own, site = (F.median(F.when(c("model") == n, c("RMSE"))) for n in SOURCES)  # of one row a repetition
    return scores.groupBy("gap", "series").agg(r(own).alias("own"), r(site).alias("site"), r(site - own).alias("delta")).withColumn("delta", c("delta") + 0.0)
