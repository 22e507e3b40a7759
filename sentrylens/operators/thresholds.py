"""Threshold search: one pass over cumulative counts instead of one pass per threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylens.functions import constants as C
from sentrylens.functions import stats
from sentrylens.operators.ordered import Running, exact_quantiles, running
from sentrylens.session import staged


def score_curve(
    df: DataFrame, score: str, y: str = "y", by: Sequence[str] = (), target_rows: int = 1_000_000
) -> DataFrame:
    """Confusion counts of ``score >= threshold`` at every distinct score.

    Scores are reduced to counts first; the counts are accumulated from the top.
    """
    return _counted_curve(df, score, y, by, target_rows).drop("_a", "_b")


def auc(df: DataFrame, score: str, y: str = "y", by: Sequence[str] = (), target_rows: int = 1_000_000) -> DataFrame:
    """Area under the ROC curve per group, exact on ties; null without both classes.

    A benign row beats no attack row above its score and half of those at it, so the area is a
    sum over the distinct scores of the curve. Rows without score are left out.
    """
    curve = _counted_curve(df.filter(F.col(score).isNotNull()), score, y, by, target_rows)
    won = F.sum(F.col("_b") * (F.col("tp") - F.col("_a") / 2))
    pairs = F.max(F.col("n_attack").cast("double") * F.col("n_benign"))
    return curve.groupBy(*by).agg(
        F.max("n_attack").alias("n_attack"), F.max("n_benign").alias("n_benign"), F.try_divide(won, pairs).alias("auc")
    )


def _counted_curve(df: DataFrame, score: str, y: str, by: Sequence[str], target_rows: int) -> DataFrame:
    by = list(by)
    cells = staged(
        df.groupBy(*by, F.col(score).alias("threshold")).agg(
            F.count_if(F.col(y) == 1).alias("_a"), F.count_if(F.col(y) == 0).alias("_b")
        )
    )
    curve = running(
        cells,
        by,
        ["threshold"],
        [Running("tp", "sum", F.col("_a")), Running("fp", "sum", F.col("_b"))],
        reverse=True,
        target_rows=target_rows,
    )
    return _with_totals(curve, cells, by)


def _with_totals(curve: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    sums = [F.sum("_a").alias("n_attack"), F.sum("_b").alias("n_benign")]
    if by:
        joined = curve.join(cells.groupBy(*by).agg(*sums), by)
    else:
        joined = curve.withColumns(
            {
                "n_attack": cells.agg(F.sum("_a")).scalar(),
                "n_benign": cells.agg(F.sum("_b")).scalar(),
            }
        )
    return joined.withColumns(
        {"fn": F.col("n_attack") - F.col("tp"), "tn": F.col("n_benign") - F.col("fp")}
    )


def grid_curve(
    df: DataFrame, score: str, grid: Sequence[float], y: str = "y", by: Sequence[str] = (),
    always: Column | None = None,
) -> DataFrame:
    """THR1, THR8: confusion counts of ``score >= t`` for every grid point.

    Each score falls into its grid cell once; a cell counts for all thresholds up to
    it. Rows for which ``always`` holds are called attack at any threshold.
    """
    by, grid = list(by), [float(g) for g in grid]
    cut = Bucketizer(
        splits=[float("-inf"), *grid, float("inf")], inputCol="_s", outputCol="_cell", handleInvalid="keep"
    )
    placed = cut.transform(df.withColumn("_s", F.col(score).cast("double")))
    cell = F.when(F.isnan("_s") | F.col("_s").isNull(), 0).otherwise(F.col("_cell").cast("int"))
    if always is not None:
        cell = F.when(always, len(grid)).otherwise(cell)
    counts = placed.groupBy(*by, cell.alias("_c")).agg(
        F.count_if(F.col(y) == 1).alias("_a"), F.count_if(F.col(y) == 0).alias("_b")
    )
    # from here on at most one row per grid point and group: empty cells are added, and
    # a group's cells are summed up from the top
    zero = F.lit(0).cast("long")
    points = F.explode(F.sequence(F.lit(1), F.lit(len(grid))))
    empty = (counts.select(*by).distinct() if by else counts.limit(1).select()).select(
        *by, points.alias("_c"), zero.alias("_a"), zero.alias("_b")
    )
    cells = counts.unionByName(empty).groupBy(*by, "_c").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    above = group.orderBy(F.col("_c").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    table = cells.select(
        *by,
        F.col("_c").alias("grid_no"),
        F.sum("_a").over(above).alias("tp"),
        F.sum("_b").over(above).alias("fp"),
        F.sum("_a").over(group).alias("n_attack"),
        F.sum("_b").over(group).alias("n_benign"),
    ).filter("grid_no > 0")
    values = F.array(*[F.lit(g) for g in grid])
    return table.withColumns(
        {
            "threshold": F.element_at(values, F.col("grid_no")),
            "fn": F.col("n_attack") - F.col("tp"),
            "tn": F.col("n_benign") - F.col("fp"),
        }
    )


def linear_grid(low: float, high: float, n: int) -> list[float]:
    step = (high - low) / (n - 1)
    return [low + i * step for i in range(n - 1)] + [high]


def cost_optimal(curve: DataFrame, by: Sequence[str] = (), fn_cost: int = C.FN_COST) -> DataFrame:
    """THR1: the first threshold with the least FP + fn_cost * FN."""
    cost = F.col("fp") + fn_cost * F.col("fn")
    return curve.withColumn("cost", cost).groupBy(*by).agg(
        F.min(F.struct("cost", "threshold", "tp", "fp", "fn", "tn")).alias("_b")
    ).select(*by, "_b.*")


def zero_fn(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """THR2: the highest threshold that misses nothing, null if there is none."""
    return curve.groupBy(*by).agg(F.max(F.when(F.col("fn") == 0, F.col("threshold"))).alias("threshold"))


def max_f1(curve: DataFrame, by: Sequence[str] = (), fallback: float | None = None) -> DataFrame:
    """THR3, THR5: the lowest threshold with the largest F1; ``fallback`` if all are 0."""
    f1 = stats.f1(F.col("tp"), F.col("fp"), F.col("fn"))
    best = curve.withColumn("f1", f1).groupBy(*by).agg(
        F.max(F.struct("f1", (-F.col("threshold")).alias("_t"))).alias("_b")
    )
    return best.select(
        *by,
        F.col("_b.f1").alias("f1"),
        F.when(F.col("_b.f1") > 0, -F.col("_b._t")).otherwise(F.lit(fallback)).alias("threshold"),
    )


def f1_grid(df: DataFrame, score: str, n: int = 300) -> list[float]:
    """THR3: the grid between the extremes of the scores, moved inwards by 1e-6."""
    low, high = df.agg(F.min(score), F.max(score)).first()
    return linear_grid(float(low) + 1e-6, float(high) - 1e-6, n)


def recall_at_fpr(curve: DataFrame, target: float, by: Sequence[str] = ()) -> DataFrame:
    """THR4: recall at the lowest observed score whose false positive rate fits."""
    fits = stats.ratio(F.col("fp"), F.col("n_benign")) <= target
    picked = curve.groupBy(*by).agg(
        F.min(F.when(fits, F.struct("threshold", "tp", "fp", "n_attack", "n_benign"))).alias("_b")
    )
    return picked.select(
        *by,
        F.coalesce(stats.ratio(F.col("_b.tp"), F.col("_b.n_attack")), F.lit(0.0)).alias("recall"),
        F.coalesce(stats.ratio(F.col("_b.fp"), F.col("_b.n_benign")), F.lit(0.0)).alias("achieved_fpr"),
        F.coalesce(F.col("_b.threshold").cast("double"), F.lit(float("inf"))).alias("threshold"),
    )


def benign_percentile(
    df: DataFrame, score: str, p: float, y: str = "y", by: Sequence[str] = (), strict: bool = False
) -> DataFrame:
    """THR6: threshold at a percentile of the benign scores, and what it catches."""
    by = list(by)
    cut = exact_quantiles(df.filter(F.col(y) == 0), by, score, {"threshold": p}).drop("n")
    joined = df.join(cut, by) if by else df.withColumn("threshold", cut.scalar())
    hit = (F.col(score) > F.col("threshold")) if strict else (F.col(score) >= F.col("threshold"))
    a = F.col(y) == 1
    return joined.groupBy(*by, "threshold").agg(
        stats.ratio(F.count_if(a & hit), F.count_if(a)).alias("recall"),
        stats.ratio(F.count_if(~a & hit), F.count_if(~a)).alias("fpr"),
    )


def threshold_table(
    df: DataFrame, score: str, thresholds: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """THR7: hit rate of named thresholds per group (benign sets: the FPR)."""
    n = F.count(F.lit(1))
    one = df.groupBy(*by).agg(
        n.alias("n"), *[(F.count_if(F.col(score) >= t) / n).alias(f"fpr_{k}") for k, t in thresholds.items()]
    )
    return one


def reproduces(df: DataFrame, expected: dict[str, float], tolerance: float = 0.02) -> DataFrame:
    """THR9: whether measured values stay within ``tolerance`` of the recorded ones."""
    checks = [F.abs(F.col(k) - v) <= tolerance for k, v in expected.items()]
    ok = checks[0]
    for c in checks[1:]:
        ok = ok & c
    return df.withColumn("reproduced", F.coalesce(ok, F.lit(False)))


def target_status(df: DataFrame, f1: float = 0.95, fnr: float = 0.05, fpr: float = 0.10) -> DataFrame:
    """THR10: met or not met, per target."""

    def status(ok: Column) -> Column:
        return F.when(F.coalesce(ok, F.lit(False)), "MET").otherwise("NOT MET")

    return df.withColumns(
        {
            "f1_status": status(F.col("f1") >= f1),
            "fnr_status": status(F.col("fnr") <= fnr),
            "fpr_status": status(F.col("fpr") <= fpr),
        }
    )
