"""Boosted trees of Spark ML, many fits side by side: scores, importances, ablations, refits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylens.functions import constants as C
from sentrylens.functions import stats
from sentrylens.operators import boosting
from sentrylens.operators import thresholds as T
from sentrylens.operators.audit import stacked
from sentrylens.operators.ordered import exact_quantiles
from sentrylens.operators.splits import order_cuts, shuffle_key, up_to_cut
from sentrylens.session import staged

ABLATIONS = {
    "full": C.FEATURES,
    "no_identity": tuple(f for f in C.FEATURES if f not in C.IDENTITY_FEATURES),
    "behavioural": C.BEHAVIOURAL_FEATURES,
}
TREES, DEPTH, BINS = 50, 5, 64
RATE, SUBSAMPLE = 0.1, 0.8
#: Fits that run at the same time, at most; each is a distributed job of its own.
SIDE_BY_SIDE = 8
#: Train rows of one task: most, so that what a task holds does not grow with the table, and fewest worth one.
MOST_ROWS, LEAST_ROWS = 250_000, 10_000
GRID = T.linear_grid(0.005, 0.995, 199)


@dataclass(frozen=True)
class Fit:
    """One fit: its name, its train rows (a key of the splits), columns, seed and size."""

    name: str
    columns: tuple[str, ...]
    split: str = "split"
    seed: int = 42
    trees: int = TREES
    depth: int = DEPTH
    bins: int = BINS
    subsample: float = SUBSAMPLE


def fill_values(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """PRE1: what stands in for a null of each column: the median of the train rows.

    Trees do not depend on a column's scale, so nothing else is fitted; columns without nulls
    are counted once and cost no quantile.
    """
    nulls = train.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first().asDict()
    holed = [c for c in columns if nulls[c]]
    found = {}
    if holed:
        rows = exact_quantiles(stacked(train, holed), ["feature"], "value", {"median": 0.5}).collect()
        found = {r["feature"]: r["median"] for r in rows}
    return {c: found.get(c) or 0.0 for c in columns}


def row_sample(df: DataFrame, row_id: str, rows: int, seed: int = 42) -> DataFrame:
    """Exactly ``rows`` rows (all, if fewer), the first by a hash of the row id: equal rows are drawn one by one."""
    keyed = df.withColumn("_h", shuffle_key(seed, row_id))
    cuts = order_cuts(keyed, F.lit(0), "_h", row_id, lambda _, n: min(n, rows))
    return keyed.filter(up_to_cut(cuts, F.lit(0), "_h", row_id)).drop("_h")


def fit_parts(rows: int, cores: int, side: int) -> int:
    """Tasks that the train rows of one of ``side`` fits are dealt to."""
    return max(1, ceil(rows / MOST_ROWS), min(ceil(rows / LEAST_ROWS), ceil(cores / side)))


def _value(column: str, fill: Mapping[str, float]) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.lit(fill[column]))


def _vector(columns: Sequence[str], fill: Mapping[str, float]) -> Column:
    return array_to_vector(F.array(*[_value(c, fill) for c in columns]))


def _alike(fits: Sequence[Fit]) -> bool:
    """Whether fits are so many that they share their passes, and of one size."""
    return len(fits) > SIDE_BY_SIDE and len({(f.trees, f.depth, f.bins) for f in fits}) == 1 and fits[0].bins <= 255


def fit_many(
    trains: Mapping[str, DataFrame], fits: Sequence[Fit], y: str = "y", row_id: str = "row_id", fit_rows: int | None = None
) -> tuple[list[GBTClassificationModel] | list[boosting.Boosted], dict[str, dict]]:
    """MOD1, MOD5: one model for each fit, and the fill values of each split.

    Every train row takes part, unless ``fit_rows`` bounds them. Attack rows weigh benign / attack, the
    cost-sensitive form of upsampling. The vectors of a split are written once for each set of columns; the fits then
    run side by side from driver threads, as Spark ML's own grid searches do. Only models reach the driver.

    A fit keeps its rows in memory for all of its trees, so they are dealt evenly, up to ``MOST_ROWS`` to a task. Few rows are cut no
    finer than the fits side by side need to fill the cores; fits that fill them alone take turns.

    More than ``SIDE_BY_SIDE`` fits of one size grow together, a level of all trees in one pass (see ``boosting``).
    """
    session = next(iter(trains.values())).sparkSession
    cores, most = session.sparkContext.defaultParallelism, min(SIDE_BY_SIDE, len(fits))
    fills, tables, parts, weights, together = {}, {}, {}, {}, _alike(fits)
    for split in dict.fromkeys(f.split for f in fits):
        train = trains[split] if fit_rows is None else row_sample(trains[split], row_id, fit_rows)
        mine = [f for f in fits if f.split == split]
        every = tuple(dict.fromkeys(c for f in mine for c in f.columns))
        fills[split] = fill_values(train, every)
        n = {r["y"]: r["n"] for r in train.groupBy(F.col(y).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
        weights[split] = (1.0, n.get(0, 0) / n[1] if n.get(0) and n.get(1) else 1.0)
        if together:
            parts[split] = fit_parts(sum(n.values()), cores, len({f.split for f in fits}))
            tables[split] = train
            continue
        weight = F.when(F.col(y) == 1, weights[split][1]).otherwise(1.0)
        kinds = list(dict.fromkeys(f.columns for f in mine))
        vectors = [_vector(c, fills[split]).alias(f"x{i}") for i, c in enumerate(kinds)]
        table = staged(train.select(F.col(y).cast("double").alias("label"), weight.alias("weight"), *vectors))
        parts[split] = fit_parts(sum(n.values()), cores, most)
        tables |= {
            (split, c): table.select("label", "weight", F.col(f"x{i}").alias("x")).repartition(parts[split]) for i, c in enumerate(kinds)
        }

    if together:
        values = {s: {c: _value(c, fills[s]) for c in fills[s]} for s in tables}
        return boosting.fit_together(tables, values, fits, weights, parts, y), fills

    def fit(spec: Fit) -> GBTClassificationModel:
        trees = GBTClassifier(
            featuresCol="x", labelCol="label", weightCol="weight", maxIter=spec.trees, maxDepth=spec.depth, maxBins=spec.bins,
            stepSize=RATE, subsamplingRate=spec.subsample, seed=spec.seed,
        )
        return trees.fit(tables[spec.split, spec.columns])

    with ThreadPoolExecutor(min(most, ceil(2 * cores / max(parts.values())))) as pool:
        return list(pool.map(inheritable_thread_target(session)(fit), fits)), fills


def score_many(
    tests: Mapping[str, DataFrame], fits: Sequence[Fit], models: Sequence[GBTClassificationModel] | Sequence[boosting.Boosted],
    fills: Mapping[str, dict], y: str = "y", keep: Sequence[str] = (),
) -> DataFrame:
    """Every test row under every fit, in one pass a split: ``fit``, ``seed``, ``split``, ``y``, ``score`` and ``keep``."""
    out = []
    for split in dict.fromkeys(f.split for f in fits):
        mine = [(f, m) for f, m in zip(fits, models) if f.split == split]
        if isinstance(mine[0][1], boosting.Boosted):
            values = {c: _value(c, fills[split]) for c in fills[split]}
            out.append(boosting.score_together(tests[split], values, *zip(*mine), y, keep))
            continue
        kinds = list(dict.fromkeys(f.columns for f, _ in mine))
        rows = tests[split].select(
            F.col(y).cast("int").alias("y"), *keep, *[_vector(c, fills[split]).alias(f"x{i}") for i, c in enumerate(kinds)]
        )
        scores = []
        for i, (f, m) in enumerate(mine):
            named = {m.featuresCol: f"x{kinds.index(f.columns)}", m.probabilityCol: f"p{i}", m.rawPredictionCol: "", m.predictionCol: ""}
            rows = m.transform(rows, named)
            score = vector_to_array(f"p{i}")[1].alias("score")
            scores.append(F.struct(F.lit(f.name).alias("fit"), F.lit(f.seed).alias("seed"), F.lit(split).alias("split"), score))
        out.append(rows.select("y", *keep, F.inline(F.array(*scores))))
    return staged(reduce(DataFrame.unionByName, out).select("fit", "seed", "split", "y", "score", *keep))


def best_f1(scored: DataFrame, by: Sequence[str] = ("fit", "seed", "split")) -> DataFrame:
    """Confusion at the F1-optimal threshold of a fixed grid, per fit, with the area under the ROC curve.

    The threshold is searched on the evaluated rows themselves (optimistic, as the compared numbers are).
    """
    by = list(by)
    curve = staged(T.grid_curve(scored, "score", GRID, by=by))
    found = T.max_f1(curve, by, fallback=GRID[0])
    same = [F.col(f"_{c}") == F.col(c) for c in by]
    at = found.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("threshold").alias("_threshold"), "f1")
    rows = curve.join(at, [*same, F.col("threshold") == F.col("_threshold")]).drop(*[f"_{c}" for c in by], "_threshold")
    area = T.auc(scored, "score", by=by).select(*[F.col(c).alias(f"_{c}") for c in by], "auc")
    return rows.withColumns(
        {"recall": stats.ratio(F.col("tp"), F.col("n_attack")), "fpr": stats.ratio(F.col("fp"), F.col("n_benign"))}
    ).join(area, same).drop(*[f"_{c}" for c in by])


def importances(model: GBTClassificationModel, columns: Sequence[str]) -> list[tuple[int, str, float]]:
    """MOD3: share of the gain of every feature, zeros included, ranked (SRT3)."""
    ranked = sorted(zip(columns, model.featureImportances.toArray().tolist()), key=lambda p: (-p[1], p[0]))
    return [(i + 1, c, v) for i, (c, v) in enumerate(ranked)]
