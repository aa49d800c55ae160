"""Fixtures of a few rows with answers worked by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as X
from tidemark.operators import flux, gaps, metrics as M, qc
from tidemark.operators.asof import asof, mds
from tidemark.operators.grid import align, expand_daily, ffill_limit, lags, last_known, resample_mean, rolling

K = ["s"]


def series(spark, values, start=0):
    return spark.createDataFrame([("a", start + i, None if v is None else float(v)) for i, v in enumerate(values)], "s string, t long, y double")


def col(df, name):
    return [r[name] for r in df.orderBy("t").collect()]


def test_interpolation_fills_the_first_two_of_every_gap(spark):
    out = gaps.interpolate(series(spark, [1, None, None, None, None, 6, None]), K, "y", "x", 2)
    assert col(out, "x") == [1, 2, 3, None, None, 6, None]


def test_interpolation_without_limit_is_interior_only(spark):
    assert col(gaps.interpolate(series(spark, [None, 1, None, 3, None]), K, "y", "x"), "x") == [None, 1, 2, 3, None]


def test_diurnal_course(spark):
    rows = [v if v < 24 or v >= 96 else None for v in range(120)]
    out = flux.mdc_fill(series(spark, rows), K, "y", "f")
    f = col(out, "f")
    assert f[24 + 5] == pytest.approx(53)
    assert f[:24] == list(range(24)) and all(x is not None for x in f)


def test_day_expansion_ends_at_the_last_midnight(spark):
    d = spark.createDataFrame([("a", 0, 1.0), ("a", 2, 3.0)], "s string, d long, y double")
    out = col(expand_daily(d, K, ["y"]), "y")
    assert len(out) == 49 and out[:24] == [1.0] * 24 and out[24:48] == [None] * 24 and out[48] == 3.0


def test_spell_counter(spark):
    df = spark.createDataFrame([("a", i, bool(v)) for i, v in enumerate([0, 1, 1, 1, 0, 1])], "s string, t long, f boolean")
    assert col(gaps.spell_counter(df, K, F.col("f"), "n"), "n") == [0, 0, 1, 2, 0, 0]


def test_averaged_flags_are_rejected(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 1.0), ("a", 0, 1.0, 3.0)], "s string, t long, f double, v double")
    h = resample_mean(df, K, ["f", "v"])
    assert h.select(qc.qc_gate(F.col("v"), F.col("f"), (0.0, 1.0)).alias("v")).first()["v"] is None


def test_similarity_hours_do_not_wrap(spark):
    df = spark.createDataFrame([("a", 23, None, 10.0, 0.0), ("a", 24, 5.0, 10.0, 0.0)], "s string, t long, y double, ta double, sw double")
    assert mds(df, K, "y", "ta", "sw").count() == 0


def test_similarity_null_candidate_passes_and_smallest_window_wins(spark):
    df = spark.createDataFrame([("a", 240, None, 10.0, 0.0), ("a", 240 + 24 * 3, 5.0, None, None), ("a", 240 + 24 * 10, 50.0, 10.0, 0.0)], "s string, t long, y double, ta double, sw double")
    assert mds(df, K, "y", "ta", "sw").first()["filled"] == 5.0


def test_similarity_day_of_year_fallback(spark):
    year = 24 * 365
    df = spark.createDataFrame([("a", year * 2 + 24 * 3, None, 10.0, 0.0), ("a", year + 24, 7.0, 10.0, 0.0)], "s string, t long, y double, ta double, sw double")
    assert mds(df, K, "y", "ta", "sw").first()["filled"] == 7.0


def test_similarity_null_temperature_of_the_gap_passes(spark):
    df = spark.createDataFrame([("a", 240, None, None, 0.0), ("a", 241, 5.0, 30.0, 0.0)], "s string, t long, y double, ta double, sw double")
    assert mds(df, K, "y", "ta", "sw").first()["filled"] == 5.0


def test_similarity_fallback_ignores_the_drivers(spark):
    year = 24 * 365
    df = spark.createDataFrame([("a", year * 2 + 84, None, 10.0, 500.0), ("a", year + 36, 7.0, 30.0, 900.0), ("a", year * 2 + 85, 9.0, 30.0, 900.0)], "s string, t long, y double, ta double, sw double")
    assert mds(df, K, "y", "ta", "sw").first()["filled"] == 8.0


def test_respiration_is_the_base_at_ten_degrees(spark):
    assert spark.range(1).select(X.lloyd_taylor(F.lit(3.0), 200.0, F.lit(10.0))).first()[0] == pytest.approx(3.0)


def test_partition_without_a_full_week_takes_the_base_of_all_nights(spark):
    # 7 nights a week for 60 weeks: no week reaches 8 rows, all together pass 300
    rows = [("a", w * 168 + 24 * d, 5 + (w * 7 + d) % 15, 0.0) for w in range(60) for d in range(7)]
    df = spark.createDataFrame(rows, "s string, t long, ta long, rg double").withColumn("ta", F.col("ta").cast("double")).withColumn("fc", X.lloyd_taylor(F.lit(2.5), 180.0, F.col("ta")))
    out = flux.partition_nee(df, K, "fc", "ta", "rg")
    assert out.where("reco IS NULL").count() == 0 and out.agg(F.max(F.abs(F.col("reco") - F.col("fc")))).first()[0] < 1e-6


def test_base_respiration_runs_straight_through_a_week_without_one(spark):
    # three weeks of hours, all dark; bases 2 and 6 around a week with too few fluxes
    rows = [("a", h, 5.0 + h % 24, 0.0, 2.0 if h < 168 else 6.0 if h >= 336 else None) for h in range(504)]
    df = spark.createDataFrame(rows, "s string, t long, ta double, rg double, base double").withColumn("fc", X.lloyd_taylor(F.col("base"), 200.0, F.col("ta")))
    out = {r["t"]: r["reco"] / r["g"] for r in flux.partition_nee(df, K, "fc", "ta", "rg").withColumn("g", X.lloyd_taylor(F.lit(1.0), 200.0, F.col("ta"))).collect()}
    for h in (0, 167, 168, 200, 251, 335, 336, 503):
        assert out[h] == pytest.approx(2 + 4 * min(max(h - 167, 0), 169) / 169, rel=2e-3)


def test_base_respiration_runs_straight_over_thousands_of_weeks(spark):
    # two dark weeks of hours, one hour a week for 9000 weeks, two dark weeks; no frame may look ahead without bound
    hours = spark.range(336).select("id", F.lit(2.0).alias("base")).union(spark.range(9000).select(F.col("id") * 168 + 336, F.lit(None).cast("double"))).union(spark.range(336).select(F.col("id") + 9002 * 168, F.lit(6.0)))
    df = hours.select(F.lit("a").alias("s"), F.col("id").alias("t"), (5.0 + F.col("id") % 24).alias("ta"), F.lit(0.0).alias("rg"), "base").withColumn("fc", X.lloyd_taylor(F.col("base"), 200.0, F.col("ta")))
    out = flux.partition_nee(df, K, "fc", "ta", "rg")
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    wrong = F.abs(F.col("reco") / X.lloyd_taylor(F.lit(1.0), 200.0, F.col("ta")) / (2 + 4 * X.clip((F.col("t") - 335) / F.lit(9002 * 168 - 335.0), 0.0, 1.0)) - 1)
    assert out.count() == 9672 and out.agg(F.max(wrong)).first()[0] < 2e-3


def test_e0_is_found_to_a_fraction_of_a_step(spark):
    rows = [(k, 1.0 + (i * 7) % 29, e0) for k, e0 in (("a", 187.53), ("b", 12.0), ("c", 900.0)) for i in range(400)]
    df = spark.createDataFrame(rows, "s string, ta double, e0 double").withColumn("fc", F.lit(3.0) * F.exp(F.col("e0") * (1 / 56.02 - 1 / (F.col("ta") + 46.02))))
    got = {r["s"]: r["e0"] for r in flux.fit_e0(df, K, "fc", "ta", refine=True).collect()}
    assert got["a"] == pytest.approx(187.53, abs=1e-3) and got["b"] == 30 and got["c"] == 450


def test_friction_threshold_against_loops(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    n = 1200
    ta, us = rng.uniform(0, 30, n), np.where(rng.random(n) < 0.3, 0.05, rng.uniform(0.01, 0.9, n))  # many ties, so edges fall together
    fc = np.minimum(us * 20, 6) + rng.normal(0, 0.2, n)
    df = spark.createDataFrame([("a", float(a), float(u), float(f), 0.0) for a, u, f in zip(ta, us, fc)], "s string, ta double, us double, fc double, rg double")
    got = flux.ustar_threshold(df, K, "ta", "us", "fc", "rg").first()["threshold"]
    cls = (ta[:, None] > np.quantile(ta, [i / 6 for i in range(1, 6)])).sum(1)
    found = []
    for k in range(6):
        u, f = us[cls == k], fc[cls == k]
        edges = np.unique(np.quantile(u, np.linspace(0, 1, 21)))
        bins = np.maximum((u[:, None] > edges).sum(1) - 1, 0)
        mean = {b: f[bins == b].mean() for b in np.unique(bins)}
        level = np.mean([m for b, m in mean.items() if b >= max(mean) // 2])
        found.append(u[bins == min(b for b, m in mean.items() if m >= 0.95 * level)].mean())
    assert got == pytest.approx(min(0.5, max(0.01, float(np.median(found)))), abs=1e-6)


def test_climatology_of_an_empty_cell(spark):
    from tidemark.plans import backtest

    train = spark.createDataFrame([("a", 1, 10.0)] * 24 + [("b", 1, 40.0), ("b", 2, 80.0)], "s string, m int, y double")
    test = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3)], "s string, m int")
    got = {(r["s"], r["m"]): r["clim"] for r in backtest.climatology(train, test, "s", ["m"]).collect()}
    assert got == {("a", 1): 10.0, ("a", 2): 10.0, ("b", 2): 80.0, ("b", 3): pytest.approx(360 / 26)}


def test_hurdle_weighs_both_models(spark):
    from tidemark.plans import models

    rows = [(float(x), 100.0 if x > 5 else 1.0, 1.0 if x > 5 else 0.0) for x in range(10)] * 6
    df = spark.createDataFrame(rows, "x double, y double, label double")
    clf = models.fit_classifier("rf", df, ["x"])
    spike, base = models.fit("rf", df.where("label > 0.5"), ["x"]), models.fit("rf", df.where("label <= 0.5"), ["x"])
    for r in models.hurdle(clf, spike, base, df).collect():
        assert r["p"] == pytest.approx(100 * r["prob"] + (1 - r["prob"])) and (r["prob"] > 0.5) == (r["x"] > 5)
    assert models.fit_classifier("rf", df.where("label < 0.5 OR x = 9").limit(40), ["x"], least=50) is None


def test_permuted_columns_matter_if_used(spark):
    from tidemark.plans import models

    df = spark.createDataFrame([(i, float(i % 10), float(i * 7 % 13), 5.0 * (i % 10)) for i in range(400)], "row long, a double, b double, y double")
    out = {(r["family"], r["rep"]): r["delta"] for r in models.permutation_importance(models.fit("lr", df, ["a", "b"]), df, {"a": ["a"], "b": ["b"]}, 2).collect()}
    # y = 5 a: taking a from another row adds about 5 sd(a) sqrt(2) = 20; b has no weight
    assert all(15 < out["a", k] < 25 and abs(out["b", k]) < 0.5 for k in (0, 1))


def test_similarity_day_of_year_wraps(spark):
    # candidates on all days of 1970, gaps in the leap year 1972: too far for the windows, so all are filled by day of year
    gaps = [1, 2, 8, 180, 352, 358, 359, 360, 364, 365, 366]
    rows = [("a", 24 * (n - 1), float(n * n), 10.0, 0.0) for n in range(1, 366)] + [("a", 24 * (730 + n - 1), None, 10.0, 0.0) for n in gaps]
    df = spark.createDataFrame(rows, "s string, t long, y double, ta double, sw double")
    got = {r["t"] // 24 - 729: r["filled"] for r in mds(df, K, "y", "ta", "sw").collect()}
    assert set(got) == set(gaps)
    for g in gaps:
        near = [n * n for n in range(1, 366) if min(abs(g - n), 365 - abs(g - n)) <= 7]
        assert got[g] == pytest.approx(sum(near) / len(near))


def test_rule_order(spark):
    rows = [("Inorganic fertiliser N", "x", "fertN"), ("Organic Fertiliser", "Mow", "manure"), ("Liming", None, "lime"), (None, "Mow ", "cut"), ("", "Plough", "cultiv"), (None, "Drilling barley", "cultiv"),
            (None, "Apply Fertiliser", "fertN"), (None, "Apply fertiliser", None), (None, None, None), ("Seed", "mow", None)]
    df = spark.createDataFrame(rows, "a string, o string, want string")
    assert [r[0] for r in df.select(qc.event_channel(F.col("a"), F.col("o"))).collect()] == [w for *_, w in rows]


def test_asof_takes_the_larger_of_tied_events_and_none_before_the_first(spark):
    p = spark.createDataFrame([("c", 1), ("c", 4), ("c", 9)], "k string, t long")
    e = spark.createDataFrame([("c", 4, 5.0), ("c", 4, 9.0), ("c", 6, 1.0)], "k string, t long, v double")
    out = asof(p, e, ["k"], "v").orderBy("t").collect()
    assert [(r["event_t"], r["event_value"]) for r in out] == [(None, None), (4, 9.0), (6, 1.0)]


def test_gpp_at_night_without_flux_is_zero(spark):
    df = spark.createDataFrame([(5.0, None, 0.0), (5.0, None, 100.0), (5.0, 2.0, 100.0)], "reco double, nee double, rg double")
    assert [r[0] for r in df.select(X.gpp(F.col("reco"), F.col("nee"), F.col("rg"))).collect()] == [0.0, None, 3.0]


def test_metric_identities(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 2.0), ("a", 3.0, 3.0, 2.0), ("b", 2.0, 1.0, 1.0), ("b", 2.0, 3.0, 3.0)], "s string, y double, p double, n double")
    m = {r["s"]: r for r in M.point_metrics(df, ["s"], naive="n").collect()}
    assert m["a"]["RMSE"] == 0 and m["a"]["R2"] == 1 and m["a"]["skill_persist"] == 1
    assert m["b"]["R2"] is None and m["b"]["MASE"] == 1 and m["b"]["skill_persist"] == 0


def test_mape_excludes_small_targets(spark):
    df = spark.createDataFrame([("a", 0.5, 1.0), ("a", 2.0, 1.0)], "s string, y double, p double")
    m = M.point_metrics(df, ["s"]).first()
    assert m["MAPE_n_excluded"] == 1 and m["MAPE"] == 0.5


def test_empty_day_sums_to_zero(spark):
    df = series(spark, [None, None])
    assert df.groupBy("s").agg(F.coalesce(F.sum("y"), F.lit(0.0)).alias("x")).first()["x"] == 0


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_chunks_do_not_change_windows(spark, chunk):
    df = series(spark, [5, None, 7, 1, None, None, 2, 8, 9])
    assert col(lags(df, K, "y", [2, -1], chunk=chunk), "y_lag2") == [None, None, 5, None, 7, 1, None, None, 2]
    assert col(rolling(df, K, "y", 3, {"m": F.sum}, False, chunk=chunk), "m") == [None, 5, 5, 12, 8, 8, 1, 2, 10]
    assert col(last_known(df, K, F.col("y"), "l", chunk=chunk), "l") == [5, 5, 7, 1, 1, 1, 2, 8, 9]
    assert col(last_known(df, K, F.col("y"), "l", chunk=chunk, forward=True), "l") == [5, 7, 7, 1, 2, 2, 2, 8, 9]


def test_forward_fill_limit(spark):
    assert col(ffill_limit(series(spark, [1, None, None, None, 2]), K, "y", 2), "y_ffill") == [1, 1, 1, None, 2]


def test_gap_runs_and_steps_since(spark):
    df = series(spark, [1, None, None, 4, None, 6])
    assert [(r["start"], r["stop"], r["steps"]) for r in gaps.gap_runs(df, K, "y").orderBy("start").collect()] == [(1, 2, 2), (4, 4, 1)]
    assert col(gaps.steps_since(df, K, F.coalesce(F.col("y") > 3, F.lit(False)), "n"), "n") == [9999, 9999, 9999, 0, 1, 0]


def test_features_do_not_see_the_future(spark):
    full, cut = series(spark, range(1, 40)), series(spark, list(range(1, 20)) + [999] * 20)
    f = lambda d: {r["t"]: r["y_lag3"] for r in lags(d, K, "y", [3]).where("t < 19").collect()}
    assert f(full) == f(cut)
    a = align(full, K, ["y"], [], "y", [2]).where("t = 5").first()
    assert a["y"] == 6 and a["target"] == 8


def test_calendar_gaps_cover_the_share_and_repeat(spark):
    df = series(spark, range(400))
    one = {r["t"] for r in gaps.calendar_gaps(df, K, "y", 8, 0).collect()}
    assert one == {r["t"] for r in gaps.calendar_gaps(df, K, "y", 8, 0).collect()}
    assert 100 <= len(one) < 108 and one != {r["t"] for r in gaps.calendar_gaps(df, K, "y", 8, 1).collect()}


def test_partition_recovers_the_parameters(spark):
    rows = [("a", i, 5 + 15 * ((i * 37) % 100) / 100, 0.0) for i in range(24 * 28)]
    df = spark.createDataFrame(rows, "s string, t long, ta double, rg double").withColumn("fc", X.lloyd_taylor(F.lit(3.0), 200.0, F.col("ta")))
    out = flux.partition_nee(df, K, "fc", "ta", "rg")
    assert out.agg(F.max(F.abs(F.col("reco") - F.col("fc")))).first()[0] < 1e-6
    assert out.agg(F.max("gpp")).first()[0] == 0


def test_smearing_and_moving_average(spark):
    df = spark.createDataFrame([([1.0, 2.0, 6.0], 0.0)], "a array<double>, z double")
    row = df.select(X.moving_average(F.col("a"), 3).alias("m"), X.smear(F.col("z"), F.array(F.lit(-1.0), F.lit(1.0))).alias("s")).first()
    assert row["m"] == [pytest.approx(4 / 3), 3, pytest.approx(14 / 3)] and row["s"] == pytest.approx(0, abs=1e-12)


def test_conformal_level(spark):
    assert spark.range(1).select(X.conformal_level(F.lit(9), 0.1)).first()[0] == 1.0
    assert math.isclose(spark.range(1).select(X.conformal_level(F.lit(99), 0.1)).first()[0], 90 / 99)


def thrown(domain, valid, lengths, rep, share):
    """Blocks one after another, as they are thrown: (masked steps, blocks)."""
    import hashlib

    bits = {t: hashlib.md5(f"{t}|{rep}".encode()).hexdigest() for t in domain}
    taken, blocks, got, aim = set(), [], 0, max(1, int(len(valid) * share))
    for t in sorted(domain, key=lambda t: (int(bits[t][:8], 16), t)):
        if got >= aim:
            break
        block = range(t, min(t + lengths[int(bits[t][8:16], 16) % len(lengths)], domain[-1] + 1))
        if taken.isdisjoint(block):
            taken |= set(block)
            blocks.append(block)
            got += len(valid & set(block))
    return taken & valid, blocks


@pytest.mark.parametrize("share,lengths", [(0.25, [32]), (0.25, [1]), (0.4, [5, 5, 7, 300]), (0.95, [11]), (0.3, [20_000])])
def test_thrown_gaps_against_loops(spark, share, lengths):
    """Also shares that blocks cannot reach, so that all starts are thrown, and blocks longer than a chunk."""
    df = spark.range(9000).selectExpr("'a' AS k", "id + 77 AS t", "CASE WHEN id % 9 = 0 OR id BETWEEN 3000 AND 4000 THEN NULL ELSE 1.0 END AS y")
    df = df.unionByName(spark.range(50).selectExpr("'b' AS k", "id AS t", "2.0 AS y")).unionByName(spark.range(5).selectExpr("'none' AS k", "id AS t", "CAST(NULL AS DOUBLE) AS y"))
    drawn = df.select("k").distinct().select("k", F.explode(F.array(*[F.lit(n).cast("long") for n in sorted(set(lengths))])).alias("steps")).withColumn("n", F.lit(1))
    drawn = drawn.withColumn("n", F.when(F.col("steps") == 5, 2).otherwise(1))
    got = gaps.thrown_gaps(df.repartition(5), ["k"], "y", drawn, 3, share).collect()
    for k, domain, valid in (("a", range(77, 9077), {i + 77 for i in range(9000) if i % 9 and not 3000 <= i <= 4000}), ("b", range(50), set(range(50)))):
        want, blocks = thrown(domain, valid, sorted(lengths), 3, share)
        assert {r["t"] for r in got if r["k"] == k} == want and sum(map(len, blocks)) == len(set().union(*blocks))
    assert len(got) == len({(r["k"], r["t"]) for r in got}) and not any(r["k"] == "none" for r in got)


def test_empirical_gaps_without_runs_or_rows(spark):
    from tidemark.operators import gaps

    full = spark.range(20).selectExpr("'a' AS k", "id AS t", "1.0 AS y")
    assert gaps.empirical_gaps(full, ["k"], "y", 0).count() == 0
    assert gaps.empirical_gaps(full.limit(0), ["k"], "y", 0).count() == 0


def test_quantile_bins_in_two_levels(spark):
    from tidemark.operators.grid import quantile_bins

    df = spark.range(12).selectExpr("'a' AS k", "double(id) AS y").union(spark.sql("SELECT 'a', CAST(NULL AS DOUBLE)"))
    out = quantile_bins(quantile_bins(df, ["k"], "y", 3, "cls"), ["k", "cls"], "y", 2, "bin")
    got = {x.y: (x.cls, x.bin) for x in out.collect()}
    assert got[None] == (None, None)  # a null is a class of its own
    assert [got[float(i)] for i in range(12)] == [(i // 4, i % 4 // 2) for i in range(12)]


def test_manifest_tells_missing_from_broken(spark, tmp_path):
    import pytest
    from tidemark.sources.io import manifest

    spark.range(3).write.parquet(str(tmp_path / "ok"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no parquet")
    got = {x.name: (x.rows, x.columns, x.status) for x in manifest(spark, {"ok": str(tmp_path / "ok"), "gone": str(tmp_path / "gone")}).collect()}
    assert got == {"ok": (3, 1, "OK"), "gone": (None, None, "MISSING")}
    with pytest.raises(Exception):
        manifest(spark, {"bad": str(tmp_path / "bad")})
