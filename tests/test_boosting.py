"""Many fits at once against Spark ML's own boosted trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrylens.operators import boosting, models


def _rows(spark, n=3000):
    rng = np.random.default_rng(5)
    a, b, c, d = rng.integers(0, 2, n), rng.integers(0, 9, n), rng.integers(0, 40, n) / 4, rng.integers(0, 2, n)
    y = ((a == 1) & (b > 3) | (c > 7) & (d == 0) | (rng.random(n) < 0.1)).astype(int)
    items = [(i, int(y[i]), int(a[i]), None if i % 50 == 3 else int(b[i]), float(c[i]), int(d[i])) for i in range(n)]
    return spark.createDataFrame(items, "row_id long, y int, a int, b int, c double, d int").repartition(3)


def _fits(**kw):
    kinds = {"all": ("a", "b", "c", "d"), "some": ("b", "c", "d"), "one": ("c",)}
    return [models.Fit(name, columns, split, seed, **kw) for name, columns in kinds.items() for split in ("s", "t") for seed in (1, 2)]


def _scores(rows, fits):
    trains = {"s": rows.filter("row_id % 5 > 0"), "t": rows.filter("row_id < 2250")}
    tests = {"s": rows.filter("row_id % 5 = 0"), "t": rows.filter("row_id >= 2250")}
    fitted, fills = models.fit_many(trains, fits)
    found = models.score_many(tests, fits, fitted, fills, keep=["row_id"])
    assert found.columns == ["fit", "seed", "split", "y", "score", "row_id"]
    return fitted, {(r.fit, r.seed, r.split, r.row_id): (r.y, r.score) for r in found.collect()}


@pytest.mark.parametrize("direct", [64_000_000, 0])
def test_fits_that_share_their_passes_are_those_of_spark_ml(spark, monkeypatch, direct):
    rows, fits = _rows(spark), _fits(trees=4, depth=3, bins=64, subsample=1.0)
    monkeypatch.setattr(boosting, "DIRECT_BYTES", direct)
    monkeypatch.setattr(models, "LEAST_ROWS", 500)
    monkeypatch.setattr(models, "MOST_ROWS", 700)
    fitted, got = _scores(rows, fits)
    assert all(isinstance(m, boosting.Boosted) for m in fitted) and len(got) == 6 * (600 + 750)
    want = {}
    for fit in {(f.name, f.split): f for f in fits}.values():  # a seed only draws rows, and all are drawn
        want |= _scores(rows, [fit])[1]
    for (name, seed, split, row_id), (y, score) in got.items():
        assert (y, score) == (want[name, 2, split, row_id][0], pytest.approx(want[name, 2, split, row_id][1], abs=1e-5))


def test_many_fits_take_a_job_for_each_level_not_for_each_fit(spark):
    rows = _rows(spark, 300)
    jobs = []
    for seeds in (1, 3):
        fits = [f for f in _fits(trees=3, depth=2) for f in [models.Fit(f.name, f.columns, f.split, 10 * f.seed + s, 3, 2) for s in range(seeds)]]
        spark.sparkContext.setJobGroup(f"fits{seeds}", "")
        fitted, _ = models.fit_many({k: rows for k in ("s", "t")}, fits)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fits{seeds}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        drawn = {m.leaf.tobytes() for m in fitted}
        assert len(drawn) > len(fits) // 2  # seeds draw other rows
    assert jobs[0] == jobs[1] < 60


def test_cuts_of_many_values_deal_the_weight_evenly(spark):
    rows = spark.range(10_000).select(F.col("id").cast("double").alias("a"), (F.col("id") >= 9_000).cast("int").alias("y"))
    layout = boosting.layouts(rows, {"a": F.col("a")}, [("a",)], 64, (1.0, 9.0), "y")
    cuts = layout.cuts[0]
    assert len(cuts) == 63 and abs((cuts >= 9_000).sum() - 32) <= 1
    assert cuts[0] == pytest.approx(281, abs=15) and cuts[-1] == pytest.approx(9_969, abs=5)
