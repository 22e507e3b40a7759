import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from sentrylens.llm import exact, licences, sharding
from sentrylens.llm.queries import CHECKS, QUERIES
from tests_llm_helpers import SF, rows_equal

ROWS = [(i, t) for i, t in enumerate([None, "", "a", "a", "a", "b", "B", "b", "long " * 9000, "c", None])] + [(None, "a"), (3, "a")]


def test_misra_gries_keeps_every_frequent_item():
    items = Counter({"a": 400, "b": 350, **{f"x{i}": 1 for i in range(240)}})
    kept = exact.misra_gries(items, 3)
    assert len(kept) <= 3 and {"a", "b"} <= kept.keys()


@pytest.mark.parametrize("counters", [1, 2, 256])
def test_exact_dedup_equals_brute_force(make, counters):
    rows = ROWS + [(100 + i, "hot") for i in range(500)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    got = exact.exact_dedup(make(rows), counters=counters).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want[i, keep, len(ids), i == keep] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want


def test_exact_dedup_of_nothing(make):
    assert exact.exact_dedup(make([])).collect() == []


def test_ring_shards_follow_the_law_and_a_simulation(make):
    rows = ROWS + [(1000 + i, "hot") for i in range(90)] + [(2000 + i, f"t{i}") for i in range(160)]
    got = sharding.ring_shards(make(rows), 7, virtual_nodes=4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in rows
    )
    loads = Counter(r.shard for r in got)
    assert set(loads) == set(range(7)) and max(loads.values()) - min(loads.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # keys walk clockwise one by one, a round at a time, as long as a shard has room
    points = sharding.ring(7, 4)
    arc_rows = Counter()
    for r in got:
        arc_rows[r.home_shard] += 1
    room = sharding.capacities(len(rows), 7)
    assert all(sum(r.shard == s for r in got) == room[s] for s in range(7))
    at_home = sum(r.shard == r.home_shard for r in got)
    assert at_home == sum(min(arc_rows[s], room[s]) for s in range(7))
    assert len(points) == 28


def test_bounded_loads_equal_one_by_one_placement():
    points, loads = sharding.ring(5, 3), {0: 9, 3: 40, 7: 2, 14: 11}
    room = sharding.capacities(62, 5)
    parts = sharding.bounded_loads(points, loads, room)
    placed = defaultdict(list)
    waiting = [(a, i) for a in sorted(loads) for i in range(loads[a])]
    left, walk = list(room), {a: list(dict.fromkeys(points[(a + i) % 15][1] for i in range(15))) for a in loads}
    for r in range(5):
        nxt = []
        for a, i in waiting:
            s = walk[a][r]
            if left[s]:
                left[s] -= 1
                placed[a, s].append(i)
            else:
                nxt.append((a, i))
        waiting = nxt
    got = {(a, s): first for a, first, s, _ in parts}
    assert got == {k: v[0] for k, v in placed.items()}


def test_ring_shards_of_nothing(make):
    assert sharding.ring_shards(make([]), 4).collect() == []


def test_licence_scan(make, spark):
    mit = dict(licences.KNOWN)["MIT"]
    whole = "Copyright (c) 2020 Somebody\n(c) 2021 Other\n" + next(t for i, t in licences.KNOWN if i == "ISC")
    rows = [
        (1, None), (2, ""), (3, "text\nReleased under the MIT Licence\n"), (4, whole.upper()), (5, mit),
        (6, "Licensed under CC BY-NC 4.0.\nlicensed under cc-by-nc 4.0\nReleased under the MIT License!"), (7, "word " * 50_000),
        (8, "Copyright 2020 me"), (None, mit),
    ]
    got = {r.doc_id: r for r in licences.licence_scan(make(rows), licences.known_licences(spark)).collect()}
    assert {i: (r.licence_id, r.notice_ids, r.n_notices) for i, r in got.items()} == {
        1: (None, "", 0), 2: (None, "", 0), 3: (None, "MIT", 1), 4: ("ISC", "", 0), 5: ("MIT", "MIT", 1) if "\n" not in mit else ("MIT", "", 0),
        6: (None, "CC-BY-NC-4.0,MIT", 3), 7: (None, "", 0), 8: (None, "", 0), None: (got[5].licence_id, got[5].notice_ids, got[5].n_notices),
    }
    empty = spark.createDataFrame([], "licence_id string, text string")
    assert all(r.licence_id is None and r.n_notices == 0 for r in licences.licence_scan(make(rows), empty).collect())
    assert licences.licence_scan(make([]), empty).collect() == []


@pytest.mark.parametrize("name", ["op2_licence_scan", "op8_exact_dedup", "op10_line_dedup"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert rows_equal(QUERIES[name](spark, SF).toPandas(), con.execute(CHECKS[name]).df())
