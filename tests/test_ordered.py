"""The chunked forms must equal a brute force over the whole group, also under skew."""

import random

import pytest
from pyspark.sql import functions as F

from sentrylens.operators import labels, rounds, trailing
from sentrylens.operators.history import capped_rate
from sentrylens.operators.ordered import (
    Running,
    Cuts,
    _cut_large_keys,
    chunk_cuts,
    frame_cuts,
    with_chunk,
    exact_quantiles,
    previous_rows,
    row_numbers,
    running,
    upper_median,
)

S = 1_000_000
TINY = 7  # rows per chunk: forces many chunks on small data


def events(spark, n=400, seed=1, storm=0.0):
    """One key holds most rows; with ``storm`` a share of all rows has one time stamp."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        t = 50 * S if rnd.random() < storm else rnd.randrange(0, 200) * S // 2
        rows.append((i, "hot" if rnd.random() < 0.7 else rnd.choice("abc"), t, rnd.randrange(5)))
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id long, key string, us long, v int")


@pytest.mark.parametrize("storm", [0.0, 0.4])
@pytest.mark.parametrize("reverse", [False, True])
def test_running_matches_brute_force(spark, storm, reverse):
    rows, df = events(spark, storm=storm)
    specs = [
        Running("total", "sum", F.col("v")),
        Running("top", "max", F.col("v"), inclusive=False),
        Running("prev", "last", F.when(F.col("v") > 2, F.col("id")), inclusive=False),
    ]
    got = {
        r.id: (r.total, r.top, r.prev)
        for r in running(df, ["key"], ["us", "id"], specs, reverse=reverse, target_rows=TINY).collect()
    }
    assert len(got) == len(rows)
    for i, key, us, v in rows:
        line = sorted((u, j, w) for j, k, u, w in rows if k == key)
        if reverse:
            line.reverse()
        at = line.index((us, i, v))
        before = line[:at]
        marked = [j for _, j, w in before if w > 2]
        want = (
            sum(w for _, _, w in before) + v,
            max((w for _, _, w in before), default=None),
            marked[-1] if marked else None,
        )
        assert got[i] == want


def test_heavy_value_is_split(spark):
    _, df = events(spark, n=600, storm=0.5)
    cuts = chunk_cuts(df, "us", "id", TINY)
    assert 50.0 * S in cuts.heavy and len(cuts.tie_edges) > 10


@pytest.mark.parametrize("storm", [0.0, 0.4])
def test_previous_rows_carry_over_chunks(spark, storm):
    rows, df = events(spark, storm=storm)
    out = previous_rows(df, ["key"], ["us", "id"], F.col("id"), 5, "prev", target_rows=TINY)
    for r in out.collect():
        line = [j for _, j in sorted((u, j) for j, k, u, _ in rows if k == r.key)]
        at = line.index(r.id)
        assert r.prev == line[max(0, at - 5) : at]


def test_row_numbers_without_keys_and_invariance(spark):
    rows, df = events(spark)
    want = {j: n + 1 for n, (_, j) in enumerate(sorted((u, j) for j, _, u, _ in rows))}
    for parts in (1, 5):
        got = row_numbers(df.repartition(parts), [], ["us", "id"], target_rows=TINY)
        assert {r.id: r["rank"] for r in got.collect()} == want


def test_quantiles_interpolate_and_upper_median(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (4, 1, 3, 2)] + [("b", None), ("b", 7.0)], "g string, x double")
    q = {r.g: (r.n, r.p) for r in exact_quantiles(df, ["g"], "x", {"p": 0.5}).collect()}
    assert q == {"a": (4, 2.5), "b": (1, 7.0)}
    assert {r.g: r.m for r in upper_median(df, ["g"], "x", "m").collect()} == {"a": 3.0, "b": 7.0}


@pytest.mark.parametrize("storm", [0.0, 0.4])
def test_trailing_frames_exact_on_ties(spark, storm):
    rows, df = events(spark, n=250, storm=storm)
    counted = trailing.trailing_count(df, ["key"], "us", "id", 6, "c", target_rows=TINY)
    frame = trailing.Trailing("before", F.col("v"), F.col("us") + 6 * S)
    summed = trailing.trailing_sums(df, ["key"], "us", "id", [frame], target_rows=TINY)
    distinct = trailing.trailing_distinct(df, ["key"], "us", "id", {"d": "v"}, 6, target_rows=TINY)
    biggest = trailing.trailing_extreme(df, ["key"], "us", "id", "v", 6, "max", "m", target_rows=TINY)
    c = {r.id: r.c for r in counted.collect()}
    b = {r.id: r.before for r in summed.collect()}
    d = {r.id: r.d for r in distinct.collect()}
    m = {r.id: r.m for r in biggest.collect()}
    for i, key, us, v in rows:
        same = [(u, j, w) for j, k, u, w in rows if k == key]
        assert c[i] == sum(us - 6 * S <= u <= us and (u, j) <= (us, i) for u, j, _ in same)
        frame = [w for u, _, w in same if us - 6 * S <= u < us]
        assert b[i] == sum(frame)
        assert d[i] == len(set(frame))
        assert m[i] == (max(frame) if frame else None)


def test_entity_window_matches_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(160):
        kind = rnd.randrange(4)
        rows.append(
            (
                i, rnd.choice("aab"), rnd.randrange(0, 1200) * S // 4, f"r{rnd.randrange(4)}",
                f"/u{rnd.randrange(3)}" if kind == 0 else None, "cron" if kind == 1 else None,
                kind == 2, kind == 3,
            )
        )
    df = spark.createDataFrame(
        rows,
        "row_id long, key string, us long, rule_id string, url string, path_class string, "
        "is_auth_fail boolean, is_auth_success boolean",
    )
    out = {r.row_id: r for r in trailing.entity_window(df, ["key"], 30, target_rows=TINY).collect()}
    for i, key, us, *_ in rows:
        line = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        frame = [r for r in line if us - 30 * S <= r[2] < us]
        got = out[i]
        assert got.alert_count == len(frame)
        gaps = [(b[2] - a[2]) / S for a, b in zip(frame, frame[1:])]
        assert got.mean_gap_s == pytest.approx(sum(gaps) / len(gaps) if gaps else 9999.0)
        assert got.min_gap_s == pytest.approx(min(gaps) if gaps else 9999.0)
        assert got.distinct_rule_count == len({r[3] for r in frame})
        urls = [r[4] for r in frame if r[4]]
        assert got.distinct_url_count == len(set(urls))
        assert got.path_repetition_ratio == pytest.approx(1 - len(set(urls)) / len(urls) if urls else 0.0)
        fails = [r[2] for r in frame if r[6]]
        wins = [r[2] for r in frame if r[7]]
        assert got.success_after_failure == int(bool(fails and wins and min(fails) < max(wins)))
        reached = [
            sum(1 for q in line if r[2] - 10 * S <= q[2] <= r[2] and (q[2], q[0]) <= (r[2], r[0])) for r in frame
        ]
        assert got.max_rate_10s == (max(reached) if reached else 0)


@pytest.mark.parametrize("storm", [0.0, 0.4])
def test_interval_labels_match_brute_force(spark, storm):
    rnd = random.Random(5)
    rows, df = events(spark, n=200, storm=storm)
    wins = []
    for n in range(40):
        s = rnd.randrange(0, 100) * S
        wins.append((n, rnd.choice(["hot", "a"]), s, s + rnd.randrange(0, 12) * S, f"T{n}"))
    w = spark.createDataFrame(wins, "window_no long, key string, start_us long, end_us long, technique string")
    asof = labels.label_asof(df, w, ["key"], carry=["technique"], target_rows=TINY)
    inside = labels.open_windows(df, w, ["key"], target_rows=TINY)
    first = labels.first_window(df, w, ["key"], "window_no", ["technique"], target_rows=TINY)
    hits = labels.classify_hits(df, w, w.filter("window_no < 10"), ["key"], target_rows=TINY)
    near = labels.nearest_window_offset(df, w, ["key"], target_rows=TINY)
    a = {r.id: r.y for r in asof.collect()}
    o = {r.id: r.n_open for r in inside.collect()}
    f = {r.id: r.technique for r in first.collect()}
    h = {r.id: r for r in hits.collect()}
    d = {r.id: r.offset_s for r in near.collect()}
    assert len(a) == len(o) == len(f) == len(h) == len(d) == len(rows)
    for i, key, us, _ in rows:
        mine = [x for x in wins if x[1] == key]
        started = [x for x in mine if x[2] <= us]
        latest = max(started, key=lambda x: (x[2], x[3])) if started else None
        assert a[i] == int(latest is not None and us <= latest[3])
        over = [x for x in mine if x[2] <= us <= x[3]]
        assert o[i] == len(over)
        assert f[i] == (min(over)[4] if over else None)
        assert h[i].n_hits == len(over)
        assert h[i].hit_technique == (over[0][4] if len(over) == 1 else None)
        assert h[i].in_baseline == any(x[2] <= us < x[3] for x in mine if x[0] < 10)
        offs = [0 if x[2] <= us <= x[3] else (us - x[3] if us > x[3] else us - x[2]) for x in mine]
        want = min(offs, key=lambda v: (abs(v), -v)) / S if offs else None
        assert d[i] == want


def test_marker_pairing_modes(spark):
    log = [("START", 0), ("START", 5), ("END", 9), ("END", 12), ("END", 13), ("START", 20), ("END", 20), ("START", 30)]
    df = spark.createDataFrame([(n, k, t, "T1") for n, (k, t) in enumerate(log)], "ord long, kind string, us long, technique string")
    last = {(r.start_us, r.end_us) for r in rounds.pair_markers_last(df, ["technique"], ["ord"]).collect()}
    assert last == {(5, 9), (20, 20)}
    fifo = {(r.start_us, r.end_us) for r in rounds.pair_markers_fifo(df, ["technique"], ["ord"]).collect()}
    assert fifo == {(0, 9), (5, 12)}  # the END at 13 finds nobody, 20-20 has no length


def test_closure_is_cycle_safe(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 10)], "parent long, child long")
    root = spark.createDataFrame([(1,)], "node long")
    assert sorted(r.node for r in labels.descendants(e, root).collect()) == [1, 2, 3, 4]


def test_capped_rate_twenty_first_row_falls_out(spark):
    df = spark.createDataFrame([("c", i, i * 1000) for i in range(30)], "key string, id long, us long")
    got = {r.id: r.rate for r in capped_rate(df, ["key"], ["us", "id"], "us", target_rows=TINY).collect()}
    assert got[5] == 5 and got[20] == 20 and got[29] == 20


def test_heavy_times_are_split_on_entering_and_on_leaving(spark):
    df = spark.range(4000).select(
        (F.when(F.col("id") % 2 == 0, 7).otherwise(1000 + F.col("id"))).cast("long").alias("us"), F.col("id")
    )
    cuts = frame_cuts(df, "us", "id", [F.col("us") + 60], 100)
    for shift in (0, 60):
        moved = df.withColumn("us", F.col("us") + shift)
        sizes = with_chunk(moved, ["us", "id"], cuts).groupBy("_chunk").count().agg(F.max("count")).first()[0]
        assert sizes <= 200


def test_small_keys_are_not_cut(spark):
    df = spark.range(3000).select((F.col("id") % 300).alias("key"), F.col("id").alias("us"), "id")
    out = previous_rows(df, ["key"], ["us", "id"], F.col("id"), 5, "prev", target_rows=50)
    plan = out._jdf.queryExecution().toString()
    cut = _cut_large_keys(with_chunk(df, ["us", "id"], chunk_cuts(df, "us", "id", 50)), ["key"], Cuts((1.0,), target_rows=50))
    assert cut.filter("_chunk is not null").isEmpty() and "prev" in plan
    assert {r.id: r.prev for r in out.collect()} == {i: list(range(max(i % 300, i - 1500), i, 300)) for i in range(3000)}


def test_text_cannot_decide_the_cuts(spark):
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    with pytest.raises(TypeError):
        row_numbers(df, [], ["id", "name"])


def test_closure_doubles_along_a_long_chain_with_a_cycle(spark, monkeypatch):
    rounds_taken = []
    cut = labels.cut_lineage
    monkeypatch.setattr(labels, "cut_lineage", lambda df: rounds_taken.append(1) or cut(df))
    edges = spark.range(5000).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child")).union(
        spark.createDataFrame([(9001, 9002), (9002, 9003), (9003, 9001), (40, 40)], "parent long, child long")
    )
    got = {r.node for r in labels.descendants(edges, spark.createDataFrame([(10,)], "node long")).collect()}
    assert got == set(range(10, 5001)) and len(rounds_taken) <= 20


def test_a_cut_input_is_dealt_to_more_partitions_the_more_cuts_it_has(spark):
    _, df = events(spark)
    cuts = chunk_cuts(df, "us", "id", TINY)
    want = 2 * (len(cuts.edges) + 1)
    assert want > int(spark.conf.get("spark.sql.shuffle.partitions"))
    summed = running(df, ["key"], ["us", "id"], [Running("n", "sum", F.lit(1))], cuts=cuts)
    before = previous_rows(df, ["key"], ["us", "id"], F.col("us"), 3, "last", cuts=cuts)
    assert [x.rdd.getNumPartitions() for x in (summed, before)] == [want, want]
    assert summed.count() == before.count() == df.count()
