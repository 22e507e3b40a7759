"""Interval labelling: alerts against attack windows and marker windows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylens.operators.ordered import Running, chunk_cuts, running, spread
from sentrylens.session import cut_lineage, staged


def label_asof(
    alerts: DataFrame,
    windows: DataFrame,
    by: Sequence[str],
    time: str = "us",
    start: str = "start_us",
    end: str = "end_us",
    carry: Sequence[str] = (),
    out: str = "y",
    target_rows: int = 1_000_000,
) -> DataFrame:
    """JN1: label by the latest window that starts at or before the alert.

    1 iff the alert lies in that window (end inclusive); an earlier, longer window does
    not count. Windows with equal start: the one ending last. Null time: 0. ``carry``
    columns of the window are attached where the label is 1.

    Alerts and windows are merged into one ordered stream, so neither side is
    broadcast and a dominating scenario is spread over its chunks.
    """
    by, carry = list(by), list(carry)
    one_per_start = windows.groupBy(*by, start).agg(
        F.max_by(F.struct(end, *carry), F.struct(end, *carry)).alias("_w")
    )
    placed = alerts.filter(F.col(time).isNotNull())
    cuts = chunk_cuts(placed, time, target_rows=target_rows)
    stream = placed.withColumns(
        {"_t": F.col(time), "_tag": F.lit(1), "_spread": spread(placed, cuts)}
    ).unionByName(
        one_per_start.select(
            *by, F.col(start).alias("_t"), F.lit(0).alias("_tag"), F.lit(0).cast("long").alias("_spread"), "_w"
        ),
        allowMissingColumns=True,
    )
    merged = running(
        stream, by, ["_t", "_tag", "_spread"], [Running("_open", "last", F.col("_w"))], cuts=cuts
    ).filter(F.col("_tag") == 1)
    inside = F.coalesce(F.col("_t") <= F.col(f"_open.{end}"), F.lit(False))
    hit = merged.withColumns(
        {out: inside.cast("int"), **{c: F.when(inside, F.col(f"_open.{c}")) for c in carry}}
    ).drop("_t", "_tag", "_spread", "_w", "_open")
    missing = alerts.filter(F.col(time).isNull()).withColumn(out, F.lit(0))
    return hit.unionByName(missing, allowMissingColumns=True)


def open_windows(
    points: DataFrame,
    windows: DataFrame,
    by: Sequence[str],
    time: str = "us",
    start: str = "start_us",
    end: str = "end_us",
    half_open: bool = False,
    out: str = "n_open",
    target_rows: int = 1_000_000,
) -> DataFrame:
    """JN2 core: how many windows contain each point, by a sweep over time.

    Each window adds one at its start and takes it away after its end (at its end when
    ``half_open``). No pair of point and window is ever formed.
    """
    by = list(by)
    cuts = chunk_cuts(points, time, target_rows=target_rows)

    def marks(column: str, tag: int, delta: int) -> DataFrame:
        return windows.select(
            *by,
            F.col(column).alias("_t"),
            F.lit(tag).alias("_tag"),
            F.lit(0).cast("long").alias("_spread"),
            F.lit(delta).cast("long").alias("_d"),
        )

    # at equal times: starts (0), half-open ends (1), points (2), closed ends (3)
    stream = points.withColumns(
        {
            "_t": F.col(time),
            "_tag": F.lit(2),
            "_spread": spread(points, cuts),
            "_d": F.lit(0).cast("long"),
        }
    )
    steps = marks(start, 0, 1).unionByName(marks(end, 1 if half_open else 3, -1))
    return (
        running(
            stream.unionByName(steps, allowMissingColumns=True),
            by,
            ["_t", "_tag", "_spread"],
            [Running(out, "sum", F.col("_d"))],
            cuts=cuts,
        )
        .filter(F.col("_tag") == 2)
        .drop("_t", "_tag", "_spread", "_d")
    )


def label_contains(points: DataFrame, windows: DataFrame, by: Sequence[str], out: str = "y", **kw) -> DataFrame:
    """JN2: 1 iff some window contains the point, both ends inclusive; null time: 0."""
    time = kw.get("time", "us")
    swept = open_windows(points.filter(F.col(time).isNotNull()), windows, by, out="_open", **kw)
    hit = swept.withColumn(out, (F.col("_open") > 0).cast("int")).drop("_open")
    return hit.unionByName(points.filter(F.col(time).isNull()).withColumn(out, F.lit(0)))


def label_fixed_windows(points: DataFrame, windows: Sequence[tuple], time: str = "us", out: str = "y") -> DataFrame:
    """JN2/JN3 for a short literal list of (start_us, end_us, name): no join at all.

    ``out`` is 1 inside any window, ``<out>_name`` the first containing window's name.
    """
    inside = [F.col(time).between(s, e) for s, e, _ in windows]
    name = F.coalesce(*[F.when(c, F.lit(w[2])) for c, w in zip(inside, windows)], F.lit(""))
    return points.withColumns({out: F.coalesce(F.greatest(*[c.cast("int") for c in inside]), F.lit(0)), f"{out}_name": name})


def window_segments(
    windows: DataFrame,
    by: Sequence[str],
    carry: Sequence[str],
    start: str = "start_us",
    end: str = "end_us",
    half_open: bool = False,
) -> DataFrame:
    """Disjoint segments of possibly overlapping windows: (by, _t, _segment).

    A segment holds from ``_t`` to the next one: ``n_open`` windows contain it, and
    ``single`` describes the window where it is exactly one. A sum over the open windows'
    row numbers names that window. Only window rows take part.
    """
    by = list(by)
    numbered = windows.select(*by, start, end, *carry).withColumn(
        "_no", F.xxhash64(*by, start, end, *carry) % (1 << 40)
    )
    # equal windows are one entry that counts several times
    distinct = numbered.groupBy(*by, start, end, *carry, "_no").agg(
        F.count(F.lit(1)).alias("_times")
    )
    closes = F.col(end) if half_open else F.col(end) + 1
    deltas = (
        distinct.select(
            *by,
            F.explode(
                F.array(
                    F.struct(F.col(start).alias("_t"), F.col("_times").alias("_d"), F.col("_no").alias("_n")),
                    F.struct(closes.alias("_t"), (-F.col("_times")).alias("_d"), (-F.col("_no")).alias("_n")),
                )
            ).alias("_e"),
        )
        .groupBy(*by, "_e._t")
        .agg(F.sum("_e._d").alias("_d"), F.sum("_e._n").alias("_n"))
    )
    swept = running(
        deltas,
        by,
        ["_t"],
        [Running("n_open", "sum", F.col("_d")), Running("_number", "sum", F.col("_n"))],
    )
    single = distinct.select(
        *[F.col(b).alias(f"_w_{b}") for b in by],
        F.col("_no").alias("_number"),
        F.struct(start, end, *carry).alias("single"),
    )
    named = swept.filter("n_open = 1").join(
        single,
        reduce(
            and_,
            [F.col(b).eqNullSafe(F.col(f"_w_{b}")) for b in by],
            (swept["_number"] == single["_number"])
            & F.col("_t").between(F.col(f"single.{start}"), F.col(f"single.{end}")),
        ),
        "left",
    ).select(*by, "_t", F.struct("n_open", "single").alias("_segment"))
    empty = F.lit(None).cast(named.schema["_segment"].dataType["single"].dataType)
    rest = swept.filter("n_open <> 1").select(
        *by, "_t", F.struct("n_open", empty.alias("single")).alias("_segment")
    )
    return named.unionByName(rest)


def attach_segments(
    points: DataFrame,
    segments: dict[str, DataFrame],
    by: Sequence[str],
    time: str = "us",
    target_rows: int = 1_000_000,
) -> DataFrame:
    """Attach to each point the segment of every kind that it lies in, in one pass."""
    by, kinds = list(by), list(segments)
    cuts = chunk_cuts(points, time, target_rows=target_rows)
    stream = points.withColumns(
        {"_t": F.col(time), "_tag": F.lit(len(kinds)), "_spread": spread(points, cuts)}
    )
    for i, kind in enumerate(kinds):
        stream = stream.unionByName(
            segments[kind].select(
                *by, "_t", F.lit(i).alias("_tag"), F.lit(0).cast("long").alias("_spread"),
                F.col("_segment").alias(f"_s{i}"),
            ),
            allowMissingColumns=True,
        )
    specs = [Running(kind, "last", F.col(f"_s{i}")) for i, kind in enumerate(kinds)]
    return (
        running(stream, by, ["_t", "_tag", "_spread"], specs, cuts=cuts)
        .filter(F.col("_tag") == len(kinds))
        .select(*points.columns, *kinds)
    )


def first_window(
    points: DataFrame,
    windows: DataFrame,
    by: Sequence[str],
    order: str,
    carry: Sequence[str],
    time: str = "us",
    start: str = "start_us",
    end: str = "end_us",
    target_rows: int = 1_000_000,
) -> DataFrame:
    """JN3: attributes of the first containing window, in window order.

    Windows are first turned into segments that do not overlap: each window is broken
    into at most two aligned power-of-two intervals per size, the first window of every
    such interval is kept, and each segment start looks up the intervals around it.
    The points then take the segment that starts last before them. The work is a small
    multiple of the number of windows plus one ordered pass over the points.
    """
    by, carry = list(by), list(carry)
    longest = windows.agg(F.max(F.col(end) - F.col(start))).first()[0] or 0
    levels = F.sequence(F.lit(0), F.lit(int(longest + 1).bit_length() + 1))
    first = F.struct(F.col(order).alias("_order"), *carry)
    sized = windows.select(*by, first.alias("_w"), start, end, F.explode(levels).alias("_level"))
    low = F.expr(f"shiftright({start} + shiftleft(1L, _level) - 1, _level)")
    high = F.expr(f"shiftright({end} + 1, _level)")
    pieces = F.filter(
        F.array(
            F.when((low < high) & (low % 2 == 1), low),
            F.when((low < high) & (high % 2 == 1), high - 1),
        ),
        lambda p: p.isNotNull(),
    )
    nodes = (
        sized.select(*by, "_level", "_w", F.explode(pieces).alias("_piece"))
        .groupBy(*by, "_level", "_piece")
        .agg(F.min("_w").alias("_w"))
    )
    borders = windows.select(
        *by, F.explode(F.array(F.col(start), F.col(end) + 1)).alias("_t")
    ).distinct()
    around = borders.select(*by, "_t", F.explode(levels).alias("_level")).withColumn(
        "_piece", F.expr("shiftright(_t, _level)")
    )
    segments = (
        around.join(nodes, [*by, "_level", "_piece"], "left")
        .groupBy(*by, "_t")
        .agg(F.min("_w").alias("_w"))
    )
    found = attach_segments(
        points, {"_found": segments.select(*by, "_t", F.struct("_w").alias("_segment"))},
        by, time, target_rows,
    )
    return found.select(*points.columns, *[F.col(f"_found._w.{c}").alias(c) for c in carry])


def nearest_window_offset(
    points: DataFrame,
    windows: DataFrame,
    by: Sequence[str],
    time: str = "us",
    start: str = "start_us",
    end: str = "end_us",
    out: str = "offset_s",
    target_rows: int = 1_000_000,
) -> DataFrame:
    """JN10: signed seconds to the nearest window of the key, 0 inside, null without any.

    Positive: the window lies before the point. At equal distance the earlier window.
    """
    by = list(by)
    cuts = chunk_cuts(points, time, target_rows=target_rows)

    def marks(column: str, tag: int, delta: int) -> DataFrame:
        return windows.select(
            *by,
            F.col(column).alias("_t"),
            F.lit(tag).alias("_tag"),
            F.lit(0).cast("long").alias("_spread"),
            F.lit(delta).cast("long").alias("_d"),
            F.col(column).alias("_m"),
        )

    here = points.withColumns(
        {
            "_t": F.col(time),
            "_tag": F.lit(2),
            "_spread": spread(points, cuts),
            "_d": F.lit(0).cast("long"),
        }
    )
    starts, ends = marks(start, 0, 1), marks(end, 3, -1)
    covered = running(
        here.unionByName(starts.unionByName(ends), allowMissingColumns=True),
        by,
        ["_t", "_tag", "_spread"],
        [
            Running("_open", "sum", F.col("_d")),
            Running("_ended", "last", F.when(F.col("_tag") == 3, F.col("_m"))),
        ],
        cuts=cuts,
    ).filter(F.col("_tag") == 2).drop("_m")
    covered = staged(covered)
    near = running(
        covered.unionByName(starts, allowMissingColumns=True),
        by,
        ["_t", "_tag", "_spread"],
        [Running("_starts", "last", F.col("_m"))],
        reverse=True,
        cuts=cuts,
    ).filter(F.col("_tag") == 2).drop("_t", "_tag", "_spread", "_d", "_m")
    after = F.col(time) - F.col("_ended")
    before = F.col(time) - F.col("_starts")
    offset = (
        F.when(F.col("_open") > 0, F.lit(0))
        .when(F.coalesce(after <= -before, before.isNull()), after)
        .otherwise(before)
    )
    return near.withColumn(out, offset / F.lit(1_000_000.0)).drop("_open", "_ended", "_starts")


def classify_hits(
    points: DataFrame,
    technique_windows: DataFrame,
    baselines: DataFrame,
    by: Sequence[str],
    time: str = "us",
    **kw,
) -> DataFrame:
    """JN4: number of technique windows (closed), the one window if single, baseline hit."""
    placed = attach_segments(
        points,
        {
            "_hit": window_segments(technique_windows, by, ("window_no", "technique")),
            "_base": window_segments(baselines, by, (), half_open=True),
        },
        by,
        time,
        **kw,
    )
    return placed.select(
        *points.columns,
        F.coalesce("_hit.n_open", F.lit(0)).alias("n_hits"),
        F.col("_hit.single.technique").alias("hit_technique"),
        F.col("_hit.single.start_us").alias("window_start"),
        F.col("_hit.single.end_us").alias("window_end"),
        (F.coalesce("_base.n_open", F.lit(0)) > 0).alias("in_baseline"),
    )


def tier_linux(
    hits: DataFrame, is_artifact: Column, exact_time: Column, in_session: Column
) -> DataFrame:
    """JN5: label, technique and confidence tier without a process tree."""
    one, many = F.col("n_hits") == 1, F.col("n_hits") > 1
    base = F.col("in_baseline")
    confidence = (
        F.when(one & exact_time, "LOW-time")
        .when(one, "VLOW-time")
        .when(many, "UNCERTAIN-overlap")
        .when(is_artifact, "UNCERTAIN-artifact-teardown")
        .when(base & exact_time, "BENIGN-baseline")
        .when(base, "BENIGN-baseline-weak")
        .when(in_session, "UNCERTAIN-session-gap")
        .otherwise("UNCERTAIN-out-of-session")
    )
    return _labelled_by_tier(hits.withColumn("label_confidence", confidence))


def tier_windows(
    hits: DataFrame, in_tree: Column, before_activity: Column, after_markers: Column
) -> DataFrame:
    """JN6: label, technique and confidence tier with a process tree."""
    one, many = F.col("n_hits") == 1, F.col("n_hits") > 1
    confidence = (
        F.when(in_tree & one, "HIGH-process")
        .when(in_tree & many, "HIGH-process-overlap")
        .when(in_tree, "HIGH-process-session")
        .when(one, "LOW-time")
        .when(many, "UNCERTAIN-overlap")
        .when(before_activity, "UNCERTAIN-pre-collection")
        .when(after_markers, "UNCERTAIN-post-marker")
        .when(F.col("in_baseline"), "BENIGN-baseline")
        .otherwise("UNCERTAIN-session-gap")
    )
    return _labelled_by_tier(hits.withColumn("label_confidence", confidence))


def _labelled_by_tier(df: DataFrame) -> DataFrame:
    tier = F.col("label_confidence")
    return df.withColumns(
        {
            "label": F.when(tier.startswith("UNCERTAIN"), "uncertain")
            .when(tier.startswith("BENIGN"), "benign")
            .otherwise("attack"),
            "technique": F.when(F.col("n_hits") == 1, F.col("hit_technique"))
            .when(F.col("n_hits") > 1, "MULTI")
            .otherwise(""),
        }
    )


def in_tree(df: DataFrame, tree: DataFrame, key: str, member: str, out: str = "in_tree") -> DataFrame:
    """JN7: flag of the rows whose key is a member of the tree."""
    members = tree.select(F.col(member).alias(key)).distinct().withColumn(out, F.lit(True))
    return df.join(members, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def descendants(
    edges: DataFrame, root: DataFrame, parent: str = "parent", child: str = "child"
) -> DataFrame:
    """JN8: every node reachable from the root nodes, roots included; cycles are safe.

    A root's own parents do not matter. Where every other node has one parent, all nodes
    climb at once and twice as far in each round, so a chain of d nodes takes log2(d) rounds;
    after log2(n) rounds a node still climbing is in a cycle without a root. Nodes with several
    parents take a frontier per level instead.
    """
    roots = cut_lineage(root.select(F.col(root.columns[0]).alias("node")).filter("node IS NOT NULL").distinct())
    links = cut_lineage(
        edges.select(F.col(parent).alias("_p"), F.col(child).alias("node"))
        .filter("_p IS NOT NULL AND node IS NOT NULL AND _p <> node")
        .distinct()
        .join(roots, "node", "left_anti")
    )
    if links.groupBy("node").count().filter("count > 1").isEmpty():
        return roots.unionByName(_climb(links, roots))
    return _by_frontier(links, roots)


def _climb(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes with one parent each that have a root above them."""
    at_root = roots.withColumn("_hit", F.lit(True))
    climbing = links.join(at_root.withColumnRenamed("node", "_p"), "_p", "left").select(
        "node", F.col("_p").alias("_up"), F.coalesce("_hit", F.lit(False)).alias("_hit")
    )
    for _ in range(max(1, links.count()).bit_length() + 1):
        climbing = cut_lineage(climbing)
        if climbing.filter("NOT _hit AND _up IS NOT NULL").isEmpty():
            break
        above = climbing.select(F.col("node").alias("_n"), F.col("_up").alias("_next"), F.col("_hit").alias("_found"))
        climbing = climbing.join(above, F.col("_up") == F.col("_n"), "left").select(
            "node",
            F.when(~F.col("_hit"), F.col("_next")).alias("_up"),
            (F.col("_hit") | F.coalesce("_found", F.lit(False))).alias("_hit"),
        )
    return climbing.filter("_hit").select("node")


def _by_frontier(links: DataFrame, roots: DataFrame) -> DataFrame:
    """One frontier per round: its children that are not known yet.

    Each frontier is checkpointed (and the known parts are merged now and then), so the plan
    stays short and a lost executor costs one round.
    """
    parts = [roots]
    while True:
        known = reduce(DataFrame.unionByName, parts)
        frontier = cut_lineage(
            links.join(parts[-1].withColumnRenamed("node", "_p"), "_p")
            .select("node")
            .distinct()
            .join(known, "node", "left_anti")
        )
        if frontier.isEmpty():
            return known
        if len(parts) >= 8:
            parts = [cut_lineage(known)]
        parts.append(frontier)
