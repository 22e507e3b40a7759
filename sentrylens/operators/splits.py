"""Deterministic splits, samples and the scaler."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylens.operators.audit import stacked
from sentrylens.operators.ordered import exact_quantiles, row_numbers

SPLIT = "split"


def shuffle_key(seed: int, *ids: str) -> Column:
    """A pseudo-random number per row that depends on its id only.

    The same on every run, partitioning and engine, so a split can be rebuilt.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def order_cuts(
    df: DataFrame, group: Column, first: str, second: str, take: Callable[[object, int], int]
) -> dict:
    """Per group value: the (first, second) of row number ``take(value, n)`` in that order.

    For few groups (label classes). A quantile sketch brackets each place and only the
    rows inside the brackets are ranked, so the data is scanned, not shuffled. A group
    of which nothing is taken has no cut; null order values are left out.
    """
    rows = df.select(group.alias("_g"), F.col(first).alias("_a"), F.col(second).alias("_b")).filter(
        F.col("_a").isNotNull()
    )
    sizes = {r["_g"]: r["n"] for r in rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = {g: min(n, take(g, n)) for g, n in sizes.items()}
    places = {g: k for g, k in places.items() if k > 0}
    if not places:
        return {}
    margin = 0.002
    mine = {g: F.col("_g").eqNullSafe(F.lit(g)) for g in places}
    brackets = rows.agg(
        *[
            F.percentile_approx(
                F.when(mine[g], F.col("_a")),
                [max(0.0, k / sizes[g] - margin), min(1.0, k / sizes[g] + margin)],
                10_000,
            )
            for g, k in places.items()
        ]
    ).first()
    low = {g: b[0] for g, b in zip(places, brackets)}
    high = {g: b[1] for g, b in zip(places, brackets)}
    below = rows.agg(*[F.count_if(mine[g] & (F.col("_a") < low[g])) for g in places]).first()
    below = dict(zip(places, below))
    near = reduce(or_, [mine[g] & F.col("_a").between(low[g], high[g]) for g in places])
    found = _at_places(rows.filter(near), {g: places[g] - below[g] for g in places})
    lost = {g: k for g, k in places.items() if g not in found}
    if lost:  # the sketch missed: rank the whole group
        everything = reduce(or_, [mine[g] for g in lost])
        found.update(_at_places(rows.filter(everything), lost))
    return found


def _at_places(rows: DataFrame, places: dict) -> dict:
    ranked = row_numbers(rows, ["_g"], ["_a", "_b"], out="_rank")
    wanted = reduce(
        or_, [F.col("_g").eqNullSafe(F.lit(g)) & (F.col("_rank") == k) for g, k in places.items()]
    )
    return {r["_g"]: (r["_a"], r["_b"]) for r in ranked.filter(wanted).collect()}


def up_to_cut(cuts: dict, group: Column, first: str, second: str) -> Column:
    """Whether a row comes no later than its group's cut."""
    hit = F.lit(False)
    for g, (a, b) in cuts.items():
        early = (F.col(first) < a) | ((F.col(first) == a) & (F.col(second) <= b))
        hit = hit | (group.eqNullSafe(F.lit(g)) & early)
    return F.coalesce(hit, F.lit(False))


def _tag(df: DataFrame, train: Column) -> DataFrame:
    return df.withColumn(SPLIT, F.when(train, "train").otherwise("test"))


def stratified_split(
    df: DataFrame, y: str, row_id: str, share: float = 0.8, seed: int = 42
) -> DataFrame:
    """SPL1: random split with the same share of every class (rounded) in train."""
    keyed = df.withColumn("_h", shuffle_key(seed, row_id))
    cuts = order_cuts(keyed, F.col(y), "_h", row_id, lambda _, n: round(share * n))
    return _tag(keyed, up_to_cut(cuts, F.col(y), "_h", row_id)).drop("_h")


def permutation_split(df: DataFrame, row_id: str, share: float = 0.7, seed: int = 42) -> DataFrame:
    """SPL6: seeded permutation, the first ``int(share * n)`` rows are train."""
    keyed = df.withColumn("_h", shuffle_key(seed, row_id))
    cuts = order_cuts(keyed, F.lit(0), "_h", row_id, lambda _, n: int(share * n))
    return _tag(keyed, up_to_cut(cuts, F.lit(0), "_h", row_id)).drop("_h")


def temporal_split(df: DataFrame, time: str, row_id: str, share: float = 0.8) -> DataFrame:
    """SPL3: train is the earliest ``int(share * n)`` rows (row id breaks ties)."""
    cuts = order_cuts(df, F.lit(0), time, row_id, lambda _, n: int(share * n))
    return _tag(df, up_to_cut(cuts, F.lit(0), time, row_id))


def class_tail_split(
    df: DataFrame, y: str, time: str, row_id: str, share: float = 0.3
) -> DataFrame:
    """SPL4: of every class the latest max(1, round(share * n)) rows are test."""
    cuts = order_cuts(df, F.col(y), time, row_id, lambda _, n: n - max(1, round(share * n)))
    return _tag(df, up_to_cut(cuts, F.col(y), time, row_id))


def round_split(df: DataFrame, y: str, round_col: str, time: str, row_id: str) -> DataFrame:
    """SPL5: attacks of the last round are test; of the benign rows the last fifth."""
    attacks = df.filter(F.col(y) == 1)
    last = attacks.agg(F.max(round_col)).scalar()
    tagged = _tag(attacks, F.col(round_col) < last)
    return tagged.unionByName(temporal_split(df.filter(F.col(y) == 0), time, row_id, 0.8))


def split_differences(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """SPL2: rows of two splits that do not match (with multiplicity); none if equal."""
    one = a.select(*columns, F.lit(1).alias("_d")).unionByName(
        b.select(*columns, F.lit(-1).alias("_d"))
    )
    return one.groupBy(*columns).agg(F.sum("_d").alias("surplus")).filter("surplus <> 0")


def cap_sample(df: DataFrame, by: Sequence[str], row_id: str, cap: int, seed: int = 42) -> DataFrame:
    """SPL7: at most ``cap`` rows per group, without replacement.

    The rank limit is applied in the map tasks too, so no group is moved whole.
    """
    order = Window.partitionBy(*by).orderBy("_h", row_id)
    return (
        df.withColumn("_h", shuffle_key(seed, row_id))
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= cap)
        .drop("_h", "_rank")
    )


def upsample(df: DataFrame, y: str, row_id: str, seed: int = 42) -> DataFrame:
    """SPL8: repeat the smaller class up to the size of the larger one.

    Every row gets the whole number of copies; a seeded choice gets one more. The
    column ``copy`` numbers the copies from 0.
    """
    sizes = {r[y]: r["n"] for r in df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) != 2:
        return df.withColumn("copy", F.lit(0))
    small, large = sorted(sizes, key=lambda c: (sizes[c], c))
    times, extra = divmod(sizes[large], sizes[small])
    keyed = df.withColumn("_h", shuffle_key(seed, row_id))
    minority = F.col(y) == small
    cuts = order_cuts(keyed.filter(minority), F.lit(0), "_h", row_id, lambda _, n: extra)
    one_more = up_to_cut(cuts, F.lit(0), "_h", row_id).cast("int")
    last = F.when(minority, F.lit(times - 1) + one_more).otherwise(0)
    return keyed.withColumn("copy", F.explode(F.sequence(F.lit(0), last))).drop("_h")


def oversample_rules(df: DataFrame, rule: str, rules: Sequence[str], times: int) -> DataFrame:
    """SPL9: repeat the rows of some rules; ``copy`` numbers the copies."""
    last = F.when(F.col(rule).isin(*rules), times - 1).otherwise(0)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), last)))


def exclude_rows(df: DataFrame, held_out: DataFrame, row_id: str) -> DataFrame:
    """JN15: everything but the held-out rows."""
    return df.join(held_out.select(row_id), row_id, "left_anti")


# --- scaler -------------------------------------------------------------------------------


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """PRE1: per feature the median, and mean and population deviation after imputing it.

    A handful of numbers per feature, the model of this step.
    """
    medians = {
        r["feature"]: r["median"]
        for r in exact_quantiles(stacked(train, columns), ["feature"], "value", {"median": 0.5}).collect()
    }
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c, 0.0))) for c in columns}
    stats = train.agg(
        *[F.avg(v).alias(f"m_{c}") for c, v in filled.items()],
        *[F.stddev_pop(v).alias(f"s_{c}") for c, v in filled.items()],
    ).first()
    return {c: (medians.get(c, 0.0), stats[f"m_{c}"], stats[f"s_{c}"]) for c in columns}


def scaled(columns: Sequence[str], scaler: dict) -> dict[str, Column]:
    """PRE1: impute and standardise; a constant feature becomes 0."""
    out = {}
    for c in columns:
        median, mean, sd = scaler[c]
        value = F.coalesce(F.col(c).cast("double"), F.lit(median))
        out[c] = (value - mean) / (sd if sd else 1.0)
    return out
