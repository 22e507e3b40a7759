import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sentrylens.llm import common, jaccard, lines, suffix


def brute_repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = {}
    for (doc, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def text_rows(seed):
    rng = random.Random(seed)
    words = ["é", "ab", "abc", "b", "x", "straße"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    common_part = " ".join(rng.choice(words) for _ in range(30))
    rows += [(100 + i, f"{rng.random()} {common_part} {rng.random()}") for i in range(40)]
    rows += [(200, None), (201, ""), (202, "a" * 300), (203, "ab" * 4000), (204, common_part), (205, common_part)]
    return rows


def test_collection_order_is_the_suffix_order():
    rng = random.Random(5)
    for _ in range(60):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 20))).encode() for _ in range(rng.randint(1, 6))]
        who, start, prefix = suffix.collection_order([suffix.symbols(t) for t in texts], 9)
        got = [texts[w][s:] for w, s in zip(who, start)]
        assert got == sorted(got) and len(got) == sum(map(len, texts))
        for i in range(1, len(got)):
            same = next((k for k, (a, b) in enumerate(zip(got[i - 1], got[i])) if a != b), min(len(got[i - 1]), len(got[i])))
            assert min(same, 9) == prefix[i]


@pytest.mark.parametrize("group", [500, 2])
def test_remove_repeats_equals_brute_force(make, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    rows = text_rows(group)
    got = suffix.remove_repeats(make(rows), length=40, gram=8).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_repeats(rows, 40)


def test_remove_repeats_with_repeated_and_null_ids(make):
    rng = random.Random(4)
    long, other = ("".join(rng.choice("abcd") for _ in range(700)) for _ in range(2))
    rows = [(1, long), (1, "short"), (2, long[100:400]), (3, other), (3, other), (None, other[:90]), (None, "alone"), (4, None), (4, "")]
    got = suffix.remove_repeats(make(rows), length=40, gram=8).collect()
    numbered = brute_repeats([(i, t) for i, (_, t) in enumerate(rows)], 40)
    want = sorted((repr(rows[i][0]), *v) for i, v in numbered.items())
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_remove_repeats_of_a_periodic_text_keeps_one_segment_a_phase(make):
    text = "ab" * 150_000
    got = suffix.remove_repeats(make([(1, text), (2, "x" * 199)]), length=200).collect()
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got} == {(1, 300_000, 300_000, 1), (2, 199, 0, 0)}
    once = suffix.packed(((7, 1, [i], b"same", 1, 0, b"same") for i in range(1000)), suffix.SEGMENTS)
    assert once["starts"] == [list(range(1000))] and len(once["segment"]) == 1


def test_remove_repeats_moves_texts_once_and_keeps_only_marks(make, spark, monkeypatch):
    tables, real = [], suffix.staged

    def noted(df):
        tables.append(real(df))
        return tables[-1]

    monkeypatch.setattr(suffix, "staged", noted)
    monkeypatch.setattr(suffix, "GROUP", 2)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = suffix.remove_repeats(make(text_rows(3)), length=40, gram=8)
        plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
        assert len(got.collect()) == len(text_rows(3))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    moved = [x.split("Input", 1)[1].split("\n")[0] for x in plan.split("\n\n") if ") Exchange" in x]
    assert moved and not any("text" in x for x in moved)
    there = [df.columns for df in tables if any(os.path.exists(f.removeprefix("file://")) for f in df.inputFiles())]
    assert len(there) < len(tables) and all(c == ["doc_id", "spans"] for c in there)


def test_remove_repeats_of_nothing(make):
    assert suffix.remove_repeats(make([]), length=40, gram=8).collect() == []


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[:x]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                i, j = root(a), root(b)
                up[max(i, j)] = min(i, j)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("long, block", [(200, 96), (3, 4)])
def test_jaccard_links_equal_brute_force(make, monkeypatch, long, block):
    monkeypatch.setattr(jaccard, "LONG", long)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(long)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 8, 30, 90]))] for _ in range(12)]
    rows = []
    for i in range(130):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"W{rng.randint(0, 9)}"
        rows.append((i * 3 + 1, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "é É"), (906, "long " * 9000)]
    got = jaccard.jaccard_links(make(rows), n=2, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 2, 80)


def test_jaccard_links_of_nothing_and_of_null_ids(make):
    assert jaccard.jaccard_links(make([])).collect() == []
    got = jaccard.jaccard_links(make([(None, "a b c d e"), (4, "a b c d e")])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(None, None), (4, 4)}


def test_t_occurrence_equals_counting():
    rng = random.Random(3)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randint(0, 25))) for _ in range(rng.randint(1, 12))]
        least = rng.randint(1, len(lists))
        want = {d: n for d, n in Counter(x for one in lists for x in one).items() if n >= least}
        assert dict(jaccard.t_occurrence(lists, least, lambda d: False)) == want


def test_components_of_a_chain_a_star_and_a_cycle(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 50)] + [(7, 9), (9, 8), (8, 7), (3, 3)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {i: 100 for i in range(101, 161)} | {500 + i: 500 for i in range(1, 50)} | {8: 7, 9: 7}
    assert got == want


def brute_lines(rows, window):
    filled = {d: [(i, x.strip(" \t\r")) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\r")] for d, t in rows}
    seen, gone = set(), defaultdict(set)
    for d in sorted(filled):
        for s in range(len(filled[d]) - window + 1):
            part = filled[d][s : s + window]
            run = tuple(x for _, x in part)
            if run in seen:
                gone[d] |= {i for i, _ in part}
            seen.add(run)
    return {d: (sum(1 for _ in (t or "").split("\n")), len(gone[d]), "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone[d])) for d, t in rows}


def test_line_dedup_equals_brute_force(make):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["a", "b", " a ", "", "c", "d\t"]) for _ in range(rng.randint(0, 14)))) for i in range(80)]
    rows += [(100 + i, "x\ny\nz\n" + str(i)) for i in range(60)] + [(300, None), (301, "one line"), (302, "r\n" * 3000)]
    got = lines.line_dedup(make(rows), carry=["rank", "lines"]).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in got} == brute_lines(rows, 3)
    assert all(r["rank"] == "x" and r["lines"] == "x" for r in got)
    assert lines.line_dedup(make([])).collect() == []


def test_window_minima_are_shared_by_equal_windows():
    x = np.array([5, 3, 3, 9, 5, 3, 3, 9, 1], dtype=np.int64)
    run, fingerprint, opens = lines.winnowed(x, 3)
    assert run[0] == run[4] and fingerprint[0] == fingerprint[4] and opens[0]
    assert fingerprint.tolist() == [min(x[i : i + 3]) for i in range(7)]
