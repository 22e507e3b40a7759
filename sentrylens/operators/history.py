"""Row-buffer histories: features of the last rows of an agent or a source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylens.functions import constants as C
from sentrylens.functions.flags import number_or_zero
from sentrylens.operators.ordered import previous_rows

SECOND = 1_000_000


def history_item(
    time: Column, level: Column, rule: Column, srcip: Column, auth: Column, scan: Column, brute: Column
) -> Column:
    """What the buffer keeps of one alert."""
    return F.struct(
        time.cast("long").alias("us"),
        number_or_zero(level).alias("level"),
        rule.cast("string").alias("rule"),
        srcip.cast("string").alias("srcip"),
        auth.cast("boolean").alias("auth"),
        scan.cast("boolean").alias("scan"),
        brute.cast("boolean").alias("brute"),
    )


def frame_aggregates() -> dict[str, Column]:
    """What the window itself can say about the buffer."""
    us, level = F.col("_item.us"), F.col("_item.level")
    return {
        "_newest": F.max(us),
        "_newest_high": F.max(F.when(level >= 10, us)),
        "_high_share": F.avg((level >= 8).cast("double")),
    }


def with_history_features(df: DataFrame, buffer: str, time: str) -> DataFrame:
    """WIN1: the eight features of a buffer as seen at ``time`` (microseconds).

    Rows with null or future time count in ``high_sev_ratio_20`` only. A null time
    or an empty buffer gives the defaults. The frame aggregates decide most rows; the
    buffer is searched only where it reaches into the last ten minutes, or where its
    newest high alert lies in the future (arrival order).
    """
    now = F.col(time)
    nothing = F.slice(buffer, 1, 0)

    def count(items: Column) -> Column:
        return F.size(items).cast("double")

    def within(seconds: int) -> Column:
        return F.filter("_recent", lambda r: r["us"] >= now - seconds * SECOND)

    def distinct(field: str) -> Column:
        values = F.transform("_recent", lambda r: r[field])
        return count(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))))

    start = now - 600 * SECOND
    recent = F.when(
        F.col("_newest") >= start, F.filter(buffer, lambda r: (r["us"] <= now) & (r["us"] >= start))
    ).otherwise(nothing)
    past_high = F.filter(buffer, lambda r: (r["us"] <= now) & (r["level"] >= 10))
    last_high = F.when(F.col("_newest_high") <= now, F.col("_newest_high")).otherwise(
        F.when(
            F.col("_newest_high").isNotNull(), F.array_max(F.transform(past_high, lambda r: r["us"]))
        )
    )
    features = {
        "alert_rate_1min": count(within(60)),
        "failed_login_5min": count(F.filter(within(300), lambda r: r["auth"])),
        "unique_src_ip_10min": distinct("srcip"),
        "high_sev_ratio_20": F.col("_high_share"),
        "rule_diversity_10min": distinct("rule"),
        "time_since_last_high": (now - last_high) / F.lit(float(SECOND)),
        "scan_preceded": F.exists("_recent", lambda r: r["scan"]).cast("double"),
        "brute_preceded": F.exists("_recent", lambda r: r["brute"]).cast("double"),
    }
    default = {"time_since_last_high": C.NO_RECENT_HIGH}
    searched = {"alert_rate_1min", "failed_login_5min", "unique_src_ip_10min", "rule_diversity_10min",
                "scan_preceded", "brute_preceded"}
    usable = now.isNotNull() & F.col("_high_share").isNotNull()
    hit = F.size("_recent") > 0
    return (
        df.withColumn("_recent", recent)
        .withColumns(
            {
                n: F.coalesce(
                    F.when(usable & hit if n in searched else usable, c), F.lit(default.get(n, 0.0))
                )
                for n, c in features.items()
            }
        )
        .drop("_recent", buffer, *frame_aggregates())
    )


def agent_history(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    time: str,
    item: Column,
    rows: int = C.HISTORY_ROWS,
    target_rows: int = 1_000_000,
) -> DataFrame:
    """WIN1: append the eight history features; the current row is not in its buffer.

    ``order`` is the arrival order (file position or event time), its first column
    numeric and non-null; ``time`` may be null.
    """
    buffered = previous_rows(
        df, keys, order, item, rows, "_buffer", target_rows=target_rows, aggregates=frame_aggregates()
    )
    return with_history_features(buffered, "_buffer", time)


def capped_rate(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    time: str,
    cap: int = C.HISTORY_ROWS,
    out: str = "rate",
    target_rows: int = 1_000_000,
) -> DataFrame:
    """WIN2: how many of the last ``cap`` rows lie in the trailing minute."""
    buffered = previous_rows(df, keys, order, F.col(time), cap, "_buffer", target_rows=target_rows)
    now = F.col(time)
    near = F.filter("_buffer", lambda t: (t <= now) & (t >= now - 60 * SECOND))
    return buffered.withColumn(out, F.size(near).cast("long")).drop("_buffer")


def source_history(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    time: str,
    target_rows: int = 1_000_000,
) -> DataFrame:
    """WIN3: rates over 60 s and 600 s and the age of the newest earlier alert.

    Rows without time neither enter the buffer nor see it.
    """
    timed = previous_rows(
        df.filter(F.col(time).isNotNull()),
        keys,
        order,
        F.col(time).cast("long"),
        C.HISTORY_ROWS,
        "_buffer",
        target_rows=target_rows,
    )
    now = F.col(time).cast("long")
    past = F.filter("_buffer", lambda t: t <= now)
    rates = {
        name: F.size(_within(past, now, seconds)).cast("double")
        for name, seconds in (("alert_rate_1min", 60), ("alerts_10min", 600))
    }
    age = (now - F.array_max(past)) / F.lit(float(SECOND))
    seen = timed.withColumns(
        {**rates, "time_since_last_alert": F.coalesce(age, F.lit(C.NO_RECENT_HIGH))}
    ).drop("_buffer")
    unseen = df.filter(F.col(time).isNull()).withColumns(
        {
            "alert_rate_1min": F.lit(0.0),
            "alerts_10min": F.lit(0.0),
            "time_since_last_alert": F.lit(C.NO_RECENT_HIGH),
        }
    )
    return seen.unionByName(unseen)


def _within(times: Column, now: Column, seconds: int) -> Column:
    return F.filter(times, lambda t: t >= now - seconds * SECOND)
