"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from sentrylens.llm import variants


def words_of(rows, least=7, count=2):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= count}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :]


def expected(rows, ratio=10):
    n = words_of(rows)
    found = {}
    for w in n:
        close = [v for v in n if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        found[w] = (best if best and n[best] >= ratio * n[w] else None, len(close))
    out = set()
    for w, (form, k) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out.add((w, form, root, n[w], k, n[form] if form else None))
    return out


def crowd(seed, alphabet, sizes, words):
    """Texts full of near words, some of them much more frequent than others."""
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.choice(sizes))) for _ in range(words)]
    rows = []
    for w in base:
        variants_of = [w]
        for _ in range(6):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(alphabet) + w[i:], w[:i] + rng.choice(alphabet) + w[i + 1 :]])
            variants_of += [v, v[:-1], v + v[-1]]
        times = [rng.choice([1, 2, 3, 30, 300]) for _ in variants_of]
        rows += [(len(rows), " ".join(f"{v} " * k for v, k in zip(variants_of, times)))]
    return rows


@pytest.mark.parametrize("stride", [2, 8])
def test_equals_plain_python(make, stride):
    rows = crowd(1, "aab", (7, 8, 9, 12), 12) + crowd(2, "abcdéÿÀ", (7, 10, 16, 17), 6)
    rows += [(None, "Nothing NOTHING nothing nothin"), (900, None), (901, ""), (902, "x" * 7 + " " + "x" * 8), (902, "x" * 7 + "1" + "X" * 8), (903, "short words")]
    want = expected(rows)
    got = [tuple(r) for r in variants.variant_groups(make(rows), stride=stride).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want)


def test_long_words_enter_by_parts(make):
    sizes = (30, 62, 63, 64, 65, 66, 95, 96, 97, 128, 129, 300)
    rows = crowd(5, "ab", sizes, 14) + [(800, "q" * 50_000 + " " + "q" * 50_001 + " ")] * 2
    # a run that loses a letter differs from one that keeps it: take many ids
    want = expected(rows)
    got = {tuple(r) for r in variants.variant_groups(make(rows)).collect()}
    assert got == want and sum(len(r[0]) > 100 and r[4] > 0 for r in want) > 5


def test_parts_of_near_words_meet():
    rng = random.Random(9)
    for m in (64, 65, 95, 96, 97, 128, 161):
        w = "".join(rng.choice("ab") for _ in range(m))
        for i in range(m + 1):
            for v in (w[:i] + "c" + w[i:], w[:i] + "c" + w[i + 1 :]):
                shared = dict.fromkeys(c for c, _ in variants.long_parts(w)) & dict(variants.long_parts(v)).keys()
                cores = {c: p for c, p in variants.long_parts(w)}
                assert v == w or any(near(cores[c], p) for c, p in variants.long_parts(v) if c in shared)


def test_no_words(make):
    assert variants.variant_groups(make([])).collect() == []
    assert variants.variant_groups(make([(1, "no long word"), (2, None)])).collect() == []
    with pytest.raises(ValueError):
        variants.variant_groups(make([]), ratio=1)
