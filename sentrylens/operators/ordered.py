"""Running aggregates over long ordered groups, split into chunks.

A Spark window keeps one key in one task. A scenario, a detector or "all rows" can hold
a third of the data, so every ordered operator of the library goes through this module:

1. keys of up to ``target_rows`` rows take an ordinary window; if no input has more rows
   than that, nothing else happens;
2. for larger keys the leading order column is cut at quantiles, one for each
   ``target_rows`` rows of the input, which gives chunks of about equal size
   whatever the distribution of time or score (a value that fills chunks alone is cut
   along the tie-breaking column);
3. each (key, chunk) is reduced to one small state row (map-side combined);
4. the states are accumulated over the chunks of a key;
5. the accumulated state enters its chunk as a first row, and an ordinary window over
   (key, chunk) finishes the job, dealt to more partitions the more cuts there are.

The driver sees the quantiles only, and the result is the one of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrylens.session import staged

CHUNK = "_chunk"
ROW_FLAG = "_is_row"
TARGET_ROWS = 1_000_000
SPREAD = 1024


@dataclass(frozen=True)
class Cuts:
    """Where an ordered input is cut.

    ``edges``: cut points of the leading order column. ``heavy``: single values of it
    that fill several chunks alone (a default time stamp, say); their rows are cut
    further along the last order column, at ``tie_edges``. Keys of up to ``target_rows``
    rows are not cut.
    """

    edges: tuple[float, ...] = ()
    heavy: tuple[float, ...] = ()
    tie_edges: tuple[float, ...] = ()
    target_rows: int = TARGET_ROWS


def chunk_cuts(
    df: DataFrame, column: str, tie: str | None = None, target_rows: int = TARGET_ROWS
) -> Cuts:
    """Quantile cut points of ``column``, one for each ``target_rows`` rows; none for fewer.

    A value that fills a chunk shows up as a repeated cut point. ``tie`` is the numeric
    column that orders equal values; without it they are spread by a hash.
    """
    n = df.agg(F.count(column)).first()[0]
    wanted = -(-n // target_rows)
    if wanted <= 1:
        return Cuts(target_rows=target_rows)
    cuts = _quantile_cuts(df, column, wanted)
    heavy = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    if not heavy:
        return Cuts(tuple(sorted(set(cuts))), target_rows=target_rows)
    if tie is None:
        ties = range(1, SPREAD)
    else:
        ties = _quantile_cuts(df.filter(F.col(column).cast("double").isin(heavy)), tie, wanted)
    return Cuts(tuple(sorted(set(cuts))), tuple(heavy), tuple(sorted({float(t) for t in ties})), target_rows)


def frame_cuts(
    df: DataFrame, time: str, tie: str, ends: Sequence[Column], target_rows: int = TARGET_ROWS
) -> Cuts:
    """Cut points for a stream that holds ``time`` and each of the times ``ends`` of every row.

    A heavy time is as heavy where its rows leave a frame as where they enter it.
    """
    times = F.explode(F.array(F.col(time).cast("long"), *[e.cast("long") for e in ends]))
    return chunk_cuts(df.select(times.alias(time), tie), time, tie, target_rows)


def cut_parts(df: DataFrame, cuts: Cuts) -> int:
    """Partitions for a shuffle of a cut input: two for each cut, so that a task's share does not grow with the input."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * (len(cuts.edges) + 1))


def _quantile_cuts(df: DataFrame, column: str, chunks: int) -> list[float]:
    value = F.col(column).cast("double")
    probs = [i / chunks for i in range(1, chunks)]
    return df.agg(F.percentile_approx(value, probs, max(40_000, 4 * chunks))).first()[0] or []


def _numeric(df: DataFrame, order: Sequence[str]) -> None:
    for c in (order[0], order[-1]):
        if isinstance(df.schema[c].dataType, T.StringType):
            raise TypeError(f"order column {c} must be a number: it decides where long groups are cut")


def _cut_large_keys(body: DataFrame, keys: Sequence[str], cuts: Cuts) -> DataFrame:
    """No chunk (null) for keys that fit one task. The others are at most rows / ``target_rows`` keys."""
    if not keys:
        return body
    names = [f"_large{i}" for i in range(len(keys))]
    counts = body.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.count(F.lit(1)).alias("_rows"))
    large = counts.filter(F.col("_rows") > cuts.target_rows)
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    marked = body.join(large, same, "left")
    return marked.withColumn(CHUNK, F.when(F.col("_rows").isNotNull(), F.col(CHUNK))).drop("_rows", *names)


def spread(df: DataFrame, cuts: Cuts) -> Column:
    """Tie column for rows whose order among equals does not matter."""
    return F.pmod(F.xxhash64(*df.columns), F.lit(SPREAD)) if cuts.heavy else F.lit(0).cast("long")


def _bucket(df: DataFrame, column: str, edges: Sequence[float], out: str) -> DataFrame:
    """Number of cut points up to the value (binary search)."""
    if not edges:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *edges, float("inf")]
    value, found = f"{out}_value", f"{out}_bucket"
    cut = Bucketizer(splits=splits, inputCol=value, outputCol=found, handleInvalid="keep")
    placed = cut.transform(df.withColumn(value, F.col(column).cast("double")))
    return placed.withColumn(out, F.col(found).cast("int")).drop(value, found)


def with_chunk(df: DataFrame, order: Sequence[str], cuts: Cuts, out: str = CHUNK) -> DataFrame:
    """Add the chunk of each row; chunks sort like their rows.

    A heavy value starts its chunk, so its pieces precede the chunk's other rows.
    """
    placed = _bucket(df, order[0], cuts.edges, out)
    if not cuts.heavy or len(order) < 2:
        return placed
    hot = F.col(order[0]).cast("double").isin(list(cuts.heavy))
    pieces = [F.when(hot, F.col(c).cast("long")).otherwise(0).alias(c) for c in order[1:-1]]
    return (
        _bucket(placed, order[-1], cuts.tie_edges, "_piece")
        .withColumn(
            out,
            F.struct(
                F.col(out).alias("at"),
                F.when(hot, 0).otherwise(1).alias("rest"),
                *pieces,
                F.when(hot, F.col("_piece")).otherwise(0).alias("piece"),
            ),
        )
        .drop("_piece")
    )


@dataclass(frozen=True)
class Running:
    """One running aggregate.

    ``kind`` is ``sum``, ``max``, ``min`` or ``last`` (last non-null value);
    ``inclusive`` says whether the current row takes part.
    """

    out: str
    kind: str
    value: Column
    inclusive: bool = True


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Sequence[Running],
    reverse: bool = False,
    cuts: Cuts | None = None,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Append running aggregates of ``specs`` along ``order`` within ``keys``.

    ``order`` names non-null columns that make the order total; the first one decides
    the chunk and the last one splits heavy ties, so both are numeric, and the ones
    between are small numbers. ``reverse`` runs from the end to the start.
    """
    keys, order = list(keys), list(order)
    _numeric(df, order)
    if cuts is None:
        cuts = chunk_cuts(df, order[0], order[-1], target_rows)
    values = [f"_v{i}" for i in range(len(specs))]

    def direction(name: str) -> Column:
        return F.col(name).desc() if reverse else F.col(name).asc()

    def over(spec: Running, v: Column | str, window) -> Column:
        if spec.kind == "last":
            return F.last(v, ignorenulls=True).over(window)
        return getattr(F, spec.kind)(v).over(window)

    def upto(window, spec: Running):
        return window.rowsBetween(Window.unboundedPreceding, Window.currentRow if spec.inclusive else -1)

    if not cuts.edges:
        whole = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*[direction(c) for c in order])
        return df.withColumns({s.out: over(s, s.value, upto(whole, s)) for s in specs})
    body = _cut_large_keys(with_chunk(df, order, cuts), keys, cuts).select(
        "*", F.lit(1).alias(ROW_FLAG), *[s.value.alias(v) for s, v in zip(specs, values)]
    )
    position = F.struct(*order)
    reducers = []
    for spec, v in zip(specs, values):
        if spec.kind == "last":
            pick = F.min_by if reverse else F.max_by
            reducers.append(pick(v, F.when(F.col(v).isNotNull(), position)).alias(v))
        else:
            reducers.append(getattr(F, spec.kind)(v).alias(v))
    states = body.filter(F.col(CHUNK).isNotNull()).groupBy(*keys, CHUNK).agg(*reducers)
    before = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy(direction(CHUNK))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = states.select(
        *keys,
        CHUNK,
        F.lit(0).alias(ROW_FLAG),
        *[over(s, v, before).alias(v) for s, v in zip(specs, values)],
    )
    inside = Window.partitionBy(*keys, CHUNK).orderBy(
        ROW_FLAG, *[direction(c) for c in order]
    )
    dealt = body.unionByName(carried, allowMissingColumns=True).repartition(cut_parts(df, cuts), *keys, CHUNK)
    out = dealt.withColumns(
        {
            s.out: over(s, v, upto(inside, s))
            for s, v in zip(specs, values)
        }
    )
    return out.filter(F.col(ROW_FLAG) == 1).drop(ROW_FLAG, CHUNK, *values)


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rank", **kw
) -> DataFrame:
    """Exact 1-based rank within ``keys`` without one task per key."""
    return running(df, keys, order, [Running(out, "sum", F.lit(1))], **kw)


def previous_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    item: Column,
    n: int,
    out: str,
    cuts: Cuts | None = None,
    target_rows: int = TARGET_ROWS,
    aggregates: dict[str, Column] | None = None,
) -> DataFrame:
    """Append the array of the ``n`` preceding rows' ``item`` (oldest first).

    ``aggregates`` of ``_item`` over the same rows come along as further columns.

    The carried state of a chunk is the last ``n`` rows before it. Every non-empty
    chunk has at least one row, so the ``n`` previous chunks always hold them.
    """
    keys, order = list(keys), list(order)
    _numeric(df, order)
    if cuts is None:
        cuts = chunk_cuts(df, order[0], order[-1], target_rows)
    if not cuts.edges:
        whole = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order).rowsBetween(-n, -1)
        found = {name: a.over(whole) for name, a in (aggregates or {}).items()}
        return df.withColumn("_item", item).withColumns({out: F.collect_list("_item").over(whole), **found}).drop("_item")
    body = _cut_large_keys(with_chunk(df, order, cuts), keys, cuts).withColumn("_item", item)
    newest = Window.partitionBy(*keys, CHUNK).orderBy(*[F.col(c).desc() for c in order])
    tails = (
        body.filter(F.col(CHUNK).isNotNull())
        .select(*keys, CHUNK, *order, "_item")
        .withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= n)
        .groupBy(*keys, CHUNK)
        .agg(F.sort_array(F.collect_list(F.struct(*order, "_item"))).alias("_tail"))
    )
    before = (
        Window.partitionBy(*(keys or [F.lit(0)])).orderBy(CHUNK).rowsBetween(-n, -1)
    )
    carried = (
        tails.withColumn("_tails", F.flatten(F.collect_list("_tail").over(before)))
        .select(
            *keys,
            CHUNK,
            F.explode(
                F.slice("_tails", F.greatest(F.size("_tails") - n + 1, F.lit(1)), n)
            ).alias("_row"),
        )
        .select(*keys, CHUNK, "_row.*", F.lit(0).alias(ROW_FLAG))
    )
    frame = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(-n, -1)
    return (
        body.withColumn(ROW_FLAG, F.lit(1))
        .unionByName(carried, allowMissingColumns=True)
        .repartition(cut_parts(df, cuts), *keys, CHUNK)
        .withColumns(
            {
                out: F.collect_list("_item").over(frame),
                **{name: a.over(frame) for name, a in (aggregates or {}).items()},
            }
        )
        .filter(F.col(ROW_FLAG) == 1)
        .drop(ROW_FLAG, CHUNK, "_item")
    )


def ranked_counts(
    df: DataFrame, groups: Sequence[str], value: str, target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Distinct values with their count, the running count and the group's total.

    The basis of exact order statistics: no group is gathered in a task. Nulls are
    left out. Columns: groups, ``_value``, ``_n``, ``_upto``, ``_total``.
    """
    groups = list(groups)
    counts = staged(
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running(
        counts, groups, ["_value"], [Running("_upto", "sum", F.col("_n"))], target_rows=target_rows
    )
    if not groups:
        return ranked.withColumn("_total", counts.agg(F.sum("_n")).scalar())
    totals = counts.groupBy(*[F.col(g).alias(f"_t_{g}") for g in groups]).agg(
        F.sum("_n").alias("_total")
    )
    same = [F.col(g).eqNullSafe(F.col(f"_t_{g}")) for g in groups]
    return ranked.join(totals, same).drop(*[f"_t_{g}" for g in groups])


def exact_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probs: dict[str, float],
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group."""
    groups = list(groups)
    ranked = ranked_counts(df, groups, value, target_rows)
    at = F.col("_total").cast("double") - 1
    picks = []
    for name, p in probs.items():
        low, high = F.floor(at * p), F.ceil(at * p)
        picks += [
            F.min(F.when(F.col("_upto") > low, F.col("_value"))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_upto") > high, F.col("_value"))).alias(f"_hi_{name}"),
            F.max(at * p - low).alias(f"_w_{name}"),
        ]
    found = ranked.groupBy(*groups).agg(F.max("_total").alias("n"), *picks)
    return found.select(
        *groups,
        "n",
        *[
            (
                F.col(f"_lo_{name}")
                + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_w_{name}")
            ).alias(name)
            for name in probs
        ],
    )


def upper_median(
    df: DataFrame, groups: Sequence[str], value: str, out: str, target_rows: int = TARGET_ROWS
) -> DataFrame:
    """The element at position n div 2 of the sorted values (the upper one if n is even)."""
    ranked = ranked_counts(df, groups, value, target_rows)
    middle = F.floor(F.col("_total") / 2)
    return ranked.groupBy(*groups).agg(
        F.min(F.when(F.col("_upto") > middle, F.col("_value"))).alias(out)
    )
