"""Trailing time frames: sums, distinct counts and extremes.

A sliding frame recomputes its aggregate for every row, which is quadratic in a burst.
Here each alert adds its value when it enters the frame and takes it away when it
leaves, so a frame is one running sum over the merged stream of both.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylens.functions import constants as C
from sentrylens.operators.ordered import Cuts, Running, cut_parts, exact_quantiles, frame_cuts, running
from sentrylens.session import staged

SECOND = 1_000_000


@dataclass(frozen=True)
class Trailing:
    """Sum of ``value`` over a trailing frame.

    ``until`` is the last time (inclusive) at which the row still counts. With
    ``through_row`` the frame ends with the current row (ties: earlier rows only);
    without, it ends strictly before the current timestamp.
    """

    out: str
    value: Column
    until: Column
    through_row: bool = False


def trailing_sums(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    row_id: str,
    frames: Sequence[Trailing],
    target_rows: int = 1_000_000,
    cuts: Cuts | None = None,
) -> DataFrame:
    """Append one running sum per frame; the frame is exact on ties."""
    keys = list(keys)
    names = [f"_d{i}" for i in range(len(frames))]
    zero = F.lit(0).cast("long")
    value = [F.coalesce(f.value.cast("long"), zero) for f in frames]

    def step(at: Column, phase: int, deltas: Sequence[Column]) -> Column:
        return F.struct(
            at.cast("long").alias("_t"),
            F.lit(phase).alias("_phase"),
            *[d.alias(n) for d, n in zip(deltas, names)],
        )

    steps = [step(F.col(time), 0, [v if f.through_row else zero for f, v in zip(frames, value)])]
    if not all(f.through_row for f in frames):
        steps.append(step(F.col(time), 1, [zero if f.through_row else v for f, v in zip(frames, value)]))
    groups: dict[str, list[int]] = {}
    for i, f in enumerate(frames):
        groups.setdefault(str(f.until), []).append(i)
    for members in groups.values():
        leave = [-value[i] if i in members else zero for i in range(len(frames))]
        steps.append(step(frames[members[0]].until, 1, leave))
    payload = [c for c in df.columns if c not in keys]
    cuts = frame_cuts(df, time, row_id, [f.until for f in frames], target_rows) if cuts is None else cuts
    stream = df.select(
        *keys, F.struct(*payload).alias("_row"), F.explode(F.array(*steps)).alias("_s")
    ).select(
        *keys,
        F.when(F.col("_s._phase") == 0, F.col("_row")).alias("_row"),
        F.col(f"_row.{row_id}").alias("_id"),
        "_s.*",
    )
    summed = running(
        stream,
        keys,
        ["_t", "_phase", "_id"],
        [Running(f.out, "sum", F.col(n)) for f, n in zip(frames, names)],
        cuts=cuts,
    )
    order = [c for c in df.columns]
    return summed.filter(F.col("_phase") == 0).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}") for c in order], *[f.out for f in frames]
    )


def trailing_count(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    row_id: str,
    seconds: int = 60,
    out: str = "rate",
    target_rows: int = 1_000_000,
    cuts: Cuts | None = None,
) -> DataFrame:
    """WIN4: uncapped count of the trailing ``seconds``, both ends and the row included."""
    frame = Trailing(out, F.lit(1), F.col(time) + seconds * SECOND, through_row=True)
    return trailing_sums(df, keys, time, row_id, [frame], target_rows, cuts)


def trailing_distinct(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    row_id: str,
    values: dict[str, str],
    seconds: int,
    target_rows: int = 1_000_000,
    cuts: Cuts | None = None,
) -> DataFrame:
    """Distinct values per trailing frame strictly before the row; ``values``: output -> column.

    A value counts from one occurrence until its next one or the end of the frame,
    whichever comes first, so every value counts once. The value columns are stacked,
    so all of them share one pass.
    """
    keys = list(keys)
    outs = list(values)
    cuts = frame_cuts(df, time, row_id, [F.col(time) + seconds * SECOND], target_rows) if cuts is None else cuts
    stacked = df.select(
        *keys,
        time,
        row_id,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("_kind"), F.col(values[o]).cast("string").alias("_value"))
                    for i, o in enumerate(outs)
                ]
            )
        ).alias("_kv"),
    ).select(*keys, time, row_id, "_kv.*")
    following = staged(
        running(
            stacked,
            [*keys, "_kind", "_value"],
            [time, row_id],
            [Running("_next", "last", F.col(time), inclusive=False)],
            reverse=True,
            cuts=cuts,
        )
    )
    until = F.least(F.coalesce(F.col("_next"), F.lit(2**62)), F.col(time) + seconds * SECOND)
    frames = [
        Trailing(o, ((F.col("_kind") == i) & F.col("_value").isNotNull()).cast("long"), until)
        for i, o in enumerate(outs)
    ]
    counted = trailing_sums(following, keys, time, row_id, frames, target_rows, cuts)
    return counted.filter("_kind = 0").select(*keys, time, row_id, *outs)


def trailing_extreme(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    row_id: str,
    value: str,
    seconds: int,
    kind: str,
    out: str,
    since: str | None = None,
    target_rows: int = 1_000_000,
    cuts: Cuts | None = None,
) -> DataFrame:
    """Max or min of ``value`` over the frame [t - seconds, t) of each row.

    Time is cut into blocks of one frame length. A frame then is the tail of one block
    and the head of the next: a backward and a forward running extreme. With ``since``
    an element belongs to the frame only if its ``since`` time does too (a gap needs
    both of its ends); the one element that crosses a block border is kept apart.
    """
    keys, span = list(keys), seconds * SECOND
    since = since or time
    pick = F.greatest if kind == "max" else F.least

    def block(t: Column) -> Column:
        return F.floor(t / F.lit(float(span)))

    base = df.withColumns(
        {
            "_at": F.col(time),
            "_own": block(F.col(time)),
            "_from": block(F.col(since)),
            "_x": F.col(value).cast("double"),
            "_a": F.col(since),
        }
    )
    cuts = frame_cuts(df, time, row_id, [F.col(time) - span], target_rows) if cuts is None else cuts
    crossing = F.when(F.col("_from") == F.col("_own") - 1, F.struct("_a", "_x"))
    internal = F.when(F.col("_from") == F.col("_own"), F.col("_x"))
    enter = base.filter(F.col("_x").isNotNull()).select(
        *keys,
        F.col("_own").alias("_block"),
        F.col("_at").alias("_t"),
        F.lit(1).alias("_phase"),
        F.col(row_id).alias("_id"),
        internal.alias("_in"),
        crossing.alias("_cross"),
    )
    reads = base.select(
        *df.columns,
        F.col("_own").alias("_block"),
        F.col("_at").alias("_t"),
        F.lit(0).alias("_phase"),
        F.col(row_id).alias("_id"),
    )
    head = running(
        reads.unionByName(enter, allowMissingColumns=True),
        [*keys, "_block"],
        ["_t", "_phase", "_id"],
        [Running("_head", kind, F.col("_in")), Running("_crossed", "last", F.col("_cross"))],
        cuts=cuts,
    ).filter(F.col("_phase") == 0)
    limit = F.col(time) - span
    head = head.withColumn(
        "_head",
        pick(F.col("_head"), F.when(F.col("_crossed._a") >= limit, F.col("_crossed._x"))),
    )
    head = staged(head.select(*df.columns, "_block", "_head"))
    probes = head.select(
        *df.columns,
        "_head",
        (F.col("_block") - 1).alias("_block"),
        limit.alias("_t"),
        F.lit(0).alias("_phase"),
        F.col(row_id).alias("_id"),
    )
    leave = base.filter(F.col("_x").isNotNull() & (F.col("_from") == F.col("_own"))).select(
        *keys,
        F.col("_own").alias("_block"),
        F.col("_a").alias("_t"),
        F.lit(1).alias("_phase"),
        F.col(row_id).alias("_id"),
        F.col("_x").alias("_in"),
    )
    tail = running(
        probes.unionByName(leave, allowMissingColumns=True),
        [*keys, "_block"],
        ["_t", "_phase", "_id"],
        [Running("_tail", kind, F.col("_in"))],
        reverse=True,
        cuts=cuts,
    ).filter(F.col("_phase") == 0)
    return tail.select(*df.columns, pick(F.col("_head"), F.col("_tail")).alias(out))


# --- rates ---------------------------------------------------------------------------


def peak_rate(
    df: DataFrame, keys: Sequence[str], time: str, row_id: str, seconds: int = 10, **kw
) -> DataFrame:
    """WIN5: highest closed sliding-window count per key, as a rate per second."""
    counted = trailing_count(df, keys, time, row_id, seconds, "_n", **kw)
    return counted.groupBy(*keys).agg((F.max("_n") / float(seconds)).alias("peak_rate"))


def mean_rate(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """WIN6: rows per second of the covered span; null when the span is empty."""
    span = (F.max(time) - F.min(time)) / F.lit(float(SECOND))
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        n.alias("n"), span.alias("span_s"), F.when(span > 0, n / span).alias("mean_rate")
    )


def bin_rates(
    df: DataFrame, keys: Sequence[str], time: str, seconds: int = 10, **kw
) -> DataFrame:
    """WIN7: bins anchored at the first row of the key; peak and median of used bins."""
    keys = list(keys)
    first = df.groupBy(*keys).agg(F.min(time).alias("_first"))
    binned = (
        df.join(first, keys)
        .groupBy(*keys, F.floor((F.col(time) - F.col("_first")) / (seconds * SECOND)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n_in_bin"))
    )
    medians = exact_quantiles(binned, keys, "n_in_bin", {"median_nonzero": 0.5}, **kw).drop("n")
    peaks = binned.groupBy(*keys).agg(
        F.max("n_in_bin").alias("peak"), F.count(F.lit(1)).alias("used_bins")
    )
    return peaks.join(medians, keys)


# --- entity windows --------------------------------------------------------------------

FIM_CLASSES = ("cron", "systemd", "shell_rc", "ssh_key", "account_mgmt", "other")


def entity_window(
    df: DataFrame,
    keys: Sequence[str],
    seconds: int,
    time: str = "us",
    row_id: str = "row_id",
    rule: str = "rule_id",
    url: str = "url",
    path_class: str = "path_class",
    fail: str = "is_auth_fail",
    success: str = "is_auth_success",
    target_rows: int = 1_000_000,
    cuts: Cuts | None = None,
) -> DataFrame:
    """WIN8 and WIN11: the trailing block of an entity, strictly before the alert.

    ``max_rate_10s`` is the largest sliding ten-second count reached at an alert of the
    frame. ``mean_gap_s`` is (last - first) / (n - 1) and, like ``min_gap_s``, 9999
    where the frame has fewer than two alerts. The needed columns are staged once; each
    group of features reads a few of them and is joined on the row number.
    """
    keys, span = list(keys), seconds * SECOND
    slim = staged(
        df.select(
            *keys, time, row_id, rule, url, path_class,
            F.col(fail).cast("long").alias(fail), F.col(success).cast("long").alias(success),
        )
    )
    until = F.col(time) + span
    ends = [until, F.col(time) - span, F.col(time) + 10 * SECOND]
    cuts = frame_cuts(slim, time, row_id, ends, target_rows) if cuts is None else cuts
    gaps = staged(
        running(
            slim,
            keys,
            [time, row_id],
            [Running("_prev", "last", F.col(time), inclusive=False)],
            cuts=cuts,
        ).withColumn("_gap", F.col(time) - F.col("_prev"))
    )

    counts = [
        Trailing("alert_count", F.lit(1), until),
        Trailing("_urls", F.col(url).isNotNull().cast("long"), until),
        Trailing("auth_failure_count", F.col(fail), until),
        *[
            Trailing(f"fim_{c}_count", (F.col(path_class) == c).cast("long"), until)
            for c in FIM_CLASSES
        ],
        # a gap counts while its older end is in the frame
        Trailing(
            "_gap_sum",
            F.when(F.col("_gap") <= span, F.col("_gap")),
            F.coalesce(F.col("_prev"), F.col(time)) + span,
        ),
    ]
    block = trailing_sums(gaps, keys, time, row_id, counts, cuts=cuts).drop(
        rule, url, path_class, fail, success, "_prev", "_gap"
    )
    min_gap = trailing_extreme(
        gaps.select(*keys, time, row_id, "_prev", "_gap"), keys, time, row_id, "_gap", seconds, "min", "_min_gap", since="_prev",
        cuts=cuts,
    ).select(row_id, "_min_gap")
    rates = staged(
        trailing_count(slim.select(*keys, time, row_id), keys, time, row_id, 10, "_r", cuts=cuts)
    )
    max_rate = trailing_extreme(
        rates, keys, time, row_id, "_r", seconds, "max", "max_rate_10s", cuts=cuts
    ).select(row_id, "max_rate_10s")
    distinct = trailing_distinct(
        slim, keys, time, row_id,
        {
            "distinct_rule_count": rule,
            "_urls_distinct": url,
            "distinct_path_class_count": path_class,
        },
        seconds,
        cuts=cuts,
    ).drop(*keys, time)
    parts = [min_gap, max_rate, distinct]
    parts.append(
        success_after_failure(slim, keys, time, row_id, fail, success, seconds, cuts=cuts).select(
            row_id, "success_after_failure"
        )
    )
    tables = [block, *parts]
    if cuts.edges:
        tables = [t.repartition(cut_parts(df, cuts), row_id) for t in tables]
    wide = reduce(lambda a, b: a.join(b, row_id), tables)
    several = F.col("alert_count") > 1
    return wide.select(
        *keys,
        row_id,
        "alert_count",
        F.coalesce("max_rate_10s", F.lit(0.0)).alias("max_rate_10s"),
        F.when(several, F.col("_gap_sum") / (F.col("alert_count") - 1) / float(SECOND))
        .otherwise(C.NEVER_SEEN)
        .alias("mean_gap_s"),
        F.when(several, F.col("_min_gap") / float(SECOND)).otherwise(C.NEVER_SEEN).alias("min_gap_s"),
        "distinct_rule_count",
        F.col("_urls_distinct").alias("distinct_url_count"),
        F.when(F.col("_urls") > 0, 1 - F.col("_urls_distinct") / F.col("_urls"))
        .otherwise(0.0)
        .alias("path_repetition_ratio"),
        "distinct_path_class_count",
        "auth_failure_count",
        "success_after_failure",
        *[f"fim_{c}_count" for c in FIM_CLASSES],
    )


def success_after_failure(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    row_id: str,
    fail: str,
    success: str,
    seconds: int,
    target_rows: int = 1_000_000,
    cuts: Cuts | None = None,
) -> DataFrame:
    """WIN11: 1 if the frame holds a failure and a later success.

    For every success the newest failure before it is known; a frame that reaches back
    to the largest of these holds such a pair.
    """
    cuts = frame_cuts(df, time, row_id, [F.col(time) - seconds * SECOND], target_rows) if cuts is None else cuts
    failed = df.filter(F.col(fail) == 1).select(
        *keys, F.col(time).alias("_t"), F.lit(2).alias("_phase"), F.col(row_id).alias("_id"),
        F.col(time).alias("_fail"),
    )
    rows = df.withColumns({"_t": F.col(time), "_phase": F.lit(1), "_id": F.col(row_id)})
    # failures of the same instant do not precede a success, so they come after the rows
    paired = running(
        rows.unionByName(failed, allowMissingColumns=True),
        keys,
        ["_t", "_phase", "_id"],
        [Running("_failed_at", "last", F.col("_fail"))],
        cuts=cuts,
    ).filter(F.col("_phase") == 1).drop("_fail", "_phase")
    pairs = paired.filter(F.col(success) == 1).select(
        *keys, "_t", F.lit(2).alias("_phase"), "_id", F.col("_failed_at").alias("_pair")
    )
    seen = running(
        paired.drop("_failed_at").withColumn("_phase", F.lit(1)).unionByName(pairs, allowMissingColumns=True),
        keys,
        ["_t", "_phase", "_id"],
        [Running("_newest", "max", F.col("_pair"))],
        cuts=cuts,
    ).filter(F.col("_phase") == 1)
    hit = F.col("_newest") >= F.col(time) - seconds * SECOND
    return seen.withColumn(
        "success_after_failure", F.coalesce(hit, F.lit(False)).cast("long")
    ).select(*df.columns, "success_after_failure")


def stage_flags(
    df: DataFrame,
    scope: Sequence[str],
    user: str,
    time: str = "us",
    row_id: str = "row_id",
    seconds: int = 3600,
    target_rows: int = 1_000_000,
    cuts: Cuts | None = None,
) -> DataFrame:
    """WIN9: the alert follows an earlier stage within the frame.

    The stage is looked for among the alerts of the same user where the alert names
    one, else among all alerts of the scope.
    """
    scope = list(scope)
    until = F.col(time) + seconds * SECOND
    cuts = frame_cuts(df, time, row_id, [until], target_rows) if cuts is None else cuts
    auth = F.col("is_auth_fail") | F.col("is_auth_success")

    def frames(prefix: str) -> list[Trailing]:
        return [
            Trailing(f"{prefix}_scan", F.col("is_web_scan").cast("long"), until),
            Trailing(f"{prefix}_login", F.col("is_auth_success").cast("long"), until),
            Trailing(f"{prefix}_auth", auth.cast("long"), until),
        ]

    every = trailing_sums(df, scope, time, row_id, frames("_all"), cuts=cuts)
    own = trailing_sums(
        df.filter(F.col(user).isNotNull()), [*scope, user], time, row_id, frames("_own"), cuts=cuts
    ).select(row_id, "_own_scan", "_own_login", "_own_auth")
    both = every.join(own, row_id, "left")

    def after(now: Column, stage: str, out: str) -> Column:
        seen = F.coalesce(f"_own_{stage}", f"_all_{stage}") > 0
        return (now & seen).cast("long").alias(out)

    return both.select(
        *df.columns,
        after(auth, "scan", "auth_after_webscan"),
        after(F.col("path_class").isNotNull(), "login", "filechange_after_login"),
        after(F.col("is_account_mgmt"), "auth", "acctmgmt_after_auth"),
    )


def entity_novelty(
    df: DataFrame, keys: Sequence[str], time: str = "us", row_id: str = "row_id", **kw
) -> DataFrame:
    """WIN10: seconds since the entity's first and latest earlier row; 9999 if new.

    By row order: an earlier row of the same instant counts.
    """
    t = F.col(time)
    seen = running(
        df,
        keys,
        [time, row_id],
        [Running("_first", "min", t, inclusive=False), Running("_last", "last", t, inclusive=False)],
        **kw,
    )

    def age(c: str) -> Column:
        return F.coalesce((t - F.col(c)) / F.lit(float(SECOND)), F.lit(C.NEVER_SEEN))

    return seen.withColumns(
        {"since_first_seen_s": age("_first"), "since_last_alert_s": age("_last")}
    ).drop("_first", "_last")


def grid_windows(df: DataFrame, keys: Sequence[str], time: str = "us", minutes: int = 10) -> DataFrame:
    """WIN12: fixed-grid window table per entity."""
    bucket = F.window(F.timestamp_micros(time), f"{minutes} minutes").start
    return df.groupBy(*keys, F.unix_seconds(bucket).alias("bucket_s")).agg(
        F.count(F.lit(1)).alias("alert_count"),
        F.countDistinct("rule_id").alias("distinct_rules"),
        F.max("level").alias("max_level"),
    )
