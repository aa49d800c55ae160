"""Metrics, each in one aggregate pass over any grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def over(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((p - y) * (p - y)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(p - y))


def r2(y: Column, p: Column) -> Column:
    """1 - SSE / SST over the subset's own mean; null for one row or no variance."""
    sst = F.var_pop(y) * F.count(y)
    return F.when((F.count(y) > 1) & (sst > 0), 1 - F.sum((p - y) * (p - y)) / sst)


def mbe(y: Column, p: Column) -> Column:
    return F.avg(p - y)


def wape(y: Column, p: Column) -> Column:
    return over(F.sum(F.abs(y - p)), F.sum(F.abs(y)))


def mase(y: Column, p: Column, naive: Column) -> Column:
    """MAE of the model over MAE of the naive forecast, on the same rows."""
    return over(mae(y, p), mae(y, naive))


def smape(y: Column, p: Column, eps: float = 1e-6) -> Column:
    return F.avg(2 * F.abs(y - p) / F.greatest(F.abs(y) + F.abs(p), F.lit(eps)))


def mape(y: Column, p: Column, least: float = 1.0) -> Column:
    return F.avg(F.when(F.abs(y) >= least, F.abs(y - p) / F.abs(y)))


def mape_excluded(y: Column, least: float = 1.0) -> Column:
    return F.count_if(F.abs(y) < least)


def skill(y: Column, p: Column, base: Column) -> Column:
    return 1 - over(rmse(y, p), rmse(y, base))


def point_metrics(df: DataFrame, by: list[str], y: str = "y", p: str = "p", naive: str | None = None, clim: str | None = None, least: int = 1) -> DataFrame:
    """All point metrics of rows with y and p, for groups of at least `least` rows."""
    df = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    a, b = F.col(y), F.col(p)
    out = [rmse(a, b).alias("RMSE"), mae(a, b).alias("MAE"), r2(a, b).alias("R2"), mbe(a, b).alias("MBE"), wape(a, b).alias("WAPE"), smape(a, b).alias("sMAPE"),
           mape(a, b).alias("MAPE"), mape_excluded(a).alias("MAPE_n_excluded"), F.count(F.lit(1)).alias("n_test")]
    if naive:
        out += [mase(a, b, F.col(naive)).alias("MASE"), skill(a, b, F.col(naive)).alias("skill_persist")]
    if clim:
        out += [skill(a, b, F.col(clim)).alias("skill_clim")]
    return df.groupBy(*by).agg(*out).where(F.col("n_test") >= least)


def pinball(y: Column, q: Column, a: float) -> Column:
    return F.avg(F.greatest(a * (y - q), (a - 1) * (y - q)))


def interval_metrics(df: DataFrame, by: list[str], y: str, lo: str, hi: str, quantiles: dict[float, str]) -> DataFrame:
    """PICP, MPIW and the pinball loss averaged over the quantile columns."""
    c = F.col
    loss = sum((pinball(c(y), c(q), a) for a, q in quantiles.items()), F.lit(0.0)) / len(quantiles)
    return df.groupBy(*by).agg(F.avg(c(y).between(c(lo), c(hi)).cast("int")).alias("PICP"), F.avg(c(hi) - c(lo)).alias("MPIW"), loss.alias("pinball"), F.count(c(y)).alias("n"))


def event_metrics(df: DataFrame, by: list[str], label: str = "label", prob: str = "prob", y: str | None = None, p: str | None = None) -> DataFrame:
    """Precision, recall and F1 at prob > 0.5 (0 where undefined) and, with y and p, RMSE on spike and other rows."""
    said, true = F.col(prob) > 0.5, F.col(label) > 0.5
    tp, fp, fn = (F.count_if(x) for x in (said & true, said & ~true, ~said & true))
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    out = [share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), F.count_if(true).alias("n_spike")]
    if y and p:
        sq = (F.col(p) - F.col(y)) * (F.col(p) - F.col(y))
        out += [F.sqrt(F.avg(F.when(true, sq))).alias("rmse_spike"), F.sqrt(F.avg(F.when(~true, sq))).alias("rmse_nonspike")]
    return df.groupBy(*by).agg(*out)
