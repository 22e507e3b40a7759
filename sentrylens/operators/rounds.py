"""Gaps, rounds and marker intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylens.functions import constants as C
from sentrylens.operators.ordered import Running, chunk_cuts, running

SECOND = 1_000_000


def with_gap(df: DataFrame, keys: Sequence[str], time: str, row_id: str, **kw) -> DataFrame:
    """Seconds to the previous row of the key, null on its first row."""
    linked = running(
        df, keys, [time, row_id], [Running("_prev", "last", F.col(time), inclusive=False)], **kw
    )
    return linked.withColumn(
        "gap_s", (F.col(time) - F.col("_prev")) / F.lit(float(SECOND))
    ).drop("_prev")


def rounds(
    df: DataFrame, keys: Sequence[str], time: str, row_id: str, gap_s: float = 30.0, **kw
) -> DataFrame:
    """WIN13: number the rounds of a key; a gap above ``gap_s`` opens a new one."""
    if kw.get("cuts") is None:
        kw["cuts"] = chunk_cuts(df, time, row_id)
    spaced = with_gap(df, keys, time, row_id, **kw)
    opens = F.coalesce((F.col("gap_s") > gap_s).cast("long"), F.lit(0))
    return running(spaced, keys, [time, row_id], [Running("round", "sum", opens)], **kw)


def periodicity(
    df: DataFrame, keys: Sequence[str], time: str, row_id: str,
    cv: float = C.PERIODICITY_CV, min_n: int = C.PERIODICITY_MIN_N, **kw,
) -> DataFrame:
    """WIN14: coefficient of variation of the gaps (population deviation) and a flag."""
    stats = (
        with_gap(df, keys, time, row_id, **kw)
        .groupBy(*keys)
        .agg(
            F.count("gap_s").alias("n_gaps"),
            F.avg("gap_s").alias("mean_gap_s"),
            (F.stddev_pop("gap_s") / F.nullif(F.avg("gap_s"), F.lit(0.0))).alias("gap_cv"),
        )
    )
    regular = (F.col("n_gaps") >= min_n) & (F.col("mean_gap_s") > 0) & (F.col("gap_cv") <= cv)
    return stats.withColumn("is_periodic", F.coalesce(regular, F.lit(False)))


def round_numbers(markers: DataFrame, keys: Sequence[str], order: Sequence[str], **kw) -> DataFrame:
    """WIN15: running round number; ``PHASE KNOWN...`` markers open a round."""
    opens = ((F.col("kind") == "PHASE") & F.col("rest").startswith("KNOWN")).cast("long")
    return running(markers, keys, order, [Running("round", "sum", opens)], **kw)


def baseline_windows(markers: DataFrame, time: str = "us", seconds: int = C.BASELINE_SECONDS) -> DataFrame:
    """WIN16: half-open quiet interval behind every BASELINE marker."""
    return markers.filter(F.col("kind") == "BASELINE").withColumns(
        {"start_us": F.col(time), "end_us": F.col(time) + seconds * SECOND}
    )


def buffer_windows(windows: DataFrame, seconds: int = 60, start: str = "start_us", end: str = "end_us") -> DataFrame:
    """WIN17: widen windows on both sides."""
    return windows.withColumns(
        {start: F.col(start) - seconds * SECOND, end: F.col(end) + seconds * SECOND}
    )


def pair_markers_last(markers: DataFrame, keys: Sequence[str], order: Sequence[str], **kw) -> DataFrame:
    """JN9 (last wins): an END closes the START directly before it among its key's markers."""
    both = markers.filter(F.col("kind").isin("START", "END"))
    here = F.struct("kind", "us", "round") if "round" in markers.columns else F.struct("kind", "us")
    linked = running(both, keys, order, [Running("_before", "last", here, inclusive=False)], **kw)
    return linked.filter((F.col("kind") == "END") & (F.col("_before.kind") == "START")).select(
        *keys,
        F.col("_before.us").alias("start_us"),
        F.col("us").alias("end_us"),
        *([F.col("_before.round").alias("round")] if "round" in markers.columns else []),
    )


def pair_markers_fifo(markers: DataFrame, keys: Sequence[str], order: Sequence[str], **kw) -> DataFrame:
    """JN9 (queue): the n-th END that finds a waiting START closes the n-th START.

    An END on an empty queue is one that brings the running START-minus-END balance to
    a new low below zero; the lows so far count the ignored ENDs. Intervals that do not
    end after their start are dropped.
    """
    if kw.get("cuts") is None:
        kw["cuts"] = chunk_cuts(markers, order[0], order[-1])
    both = markers.filter(F.col("kind").isin("START", "END")).withColumns(
        {
            "_s": (F.col("kind") == "START").cast("long"),
            "_e": (F.col("kind") == "END").cast("long"),
        }
    )
    counted = running(
        both,
        keys,
        order,
        [Running("_starts", "sum", F.col("_s")), Running("_ends", "sum", F.col("_e"))],
        **kw,
    ).withColumn("_balance", F.col("_starts") - F.col("_ends"))
    lows = running(
        counted, keys, order,
        [
            Running("_low", "min", F.col("_balance")),
            Running("_low_before", "min", F.col("_balance"), inclusive=False),
        ],
        **kw,
    )
    floor_now = F.least(F.col("_low"), F.lit(0))
    floor_before = F.least(F.coalesce(F.col("_low_before"), F.lit(0)), F.lit(0))
    ends = lows.filter((F.col("kind") == "END") & (floor_now == floor_before)).select(
        *keys, (F.col("_ends") + floor_now).alias("_n"), F.col("us").alias("end_us")
    )
    starts = counted.filter(F.col("kind") == "START").select(
        *keys, F.col("_starts").alias("_n"), F.col("us").alias("start_us")
    )
    return starts.join(ends, [*keys, "_n"]).filter("end_us > start_us").select(
        *keys, "start_us", "end_us"
    )
