"""Model queries score all series and all surveyed horizons."""

import os

import pytest

from tidemark.plans import catalog
from tidemark.plans.q_models import halves

SF, DENSE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"  # the daily series of the smaller one are too thin for scores
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_pooling_scores_every_series(spark):
    train, test = halves(spark, SF)
    both = {r[0] for r in train.where("y IS NOT NULL").select("series").distinct().collect()} & {r[0] for r in test.where("y IS NOT NULL").select("series").distinct().collect()}
    got = {(r["series"], r["model"]) for r in catalog.QUERIES["l12_pooling"](spark, SF).collect()}
    assert len(both) > 1 and {(s, m) for s in both for m in ("solo", "full", "partial")} <= got


def test_backtest_has_every_horizon(spark):
    got = {(r["track"], r["h"]) for r in catalog.QUERIES["l10_direct_backtest"](spark, DENSE).select("track", "h").distinct().collect()}
    assert got == {("A", h) for h in (1, 6, 12, 24, 48)} | {("B", h) for h in (1, 3, 7, 14)}
