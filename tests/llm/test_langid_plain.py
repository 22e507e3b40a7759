"""Language identification against a plain version of fit and prediction, over all documents."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from sentrylens.llm.queries import QUERIES
from tests_llm_helpers import SF

SIZE = 4096


def grams(text):
    """Counts of hashed n-grams, one at a time."""
    b = f" {re.sub(r'[^A-Za-z]|[0-9_]+', lambda m: m[0] if m[0].isalpha() else ' ', text.lower())} "
    b = f" {' '.join(b.split())} ".encode()
    out = Counter()
    for n in (1, 2, 3, 4):
        for i in range(len(b) - n + 1):
            h = (int.from_bytes(b[i : i + n], "big") + n) * 0x9E3779B1 & 0xFFFFFFFF
            out[((h ^ h >> 15) * 0x85EBCA77 & 0xFFFFFFFF) >> 20] += 1
    return out


def unit(counts, idf):
    v = np.zeros(SIZE)
    for g, n in counts.items():
        v[g] = math.log1p(n) * idf[g]
    length = math.sqrt((v * v).sum())
    return v / length if length else v


def centres_of(x):
    starts = [0]
    while len(starts) < min(4, len(x)):
        starts.append(min(range(len(x)), key=lambda i: max(x[i] @ x[s] for s in starts)))
    centres = [x[s] for s in starts]
    for _ in range(12):
        groups = defaultdict(list)
        for v in x:
            groups[max(range(len(centres)), key=lambda c: (v @ centres[c], -c))].append(v)
        sums = [np.sum(groups[c], axis=0) if groups[c] else centres[c] for c in range(len(centres))]
        centres = [s / np.linalg.norm(s) for s in sums]
    return centres


def pieces(text):
    words, out, n = text.split(), [text], 1
    while n < len(words):
        out += [" ".join(words[:n]), " ".join(words[-n:])]
        n *= 2
    return [p for p in out if any(c.isalpha() for c in p)]


def test_every_column_equals_the_plain_version(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    learn = [r for r in rows if not held[r.doc_id] and r.lang is not None and r.text and r.text.strip(" ")]
    counts = {r.doc_id: grams(r.text) for r in rows}
    seen = Counter(g for r in learn for g in counts[r.doc_id])
    idf = [math.log((1 + len(learn)) / (1 + seen[g])) + 0.1 for g in range(SIZE)]
    model = []
    for lang in sorted({r.lang for r in learn}):
        mine = [r for r in learn if r.lang == lang]
        centres = centres_of([unit(counts[r.doc_id], idf) for r in mine])
        near = defaultdict(list)
        for r in mine:
            for p in pieces(r.text):
                c = grams(p)
                v = unit(c, idf)
                near[len(c).bit_length()].append(max(v @ m for m in centres))
        least = [0.0] * 20
        for k in range(1, 20):
            least[k] = 0.95 * float(np.quantile(near[k], 0.005)) if near[k] else least[k - 1]
        model.append((lang, centres, least))
    got = {r.doc_id: r for r in QUERIES["op9_language_id"](spark, SF).collect()}
    assert len(got) == len(rows)
    same = 0
    for r in rows:
        g = got[r.doc_id]
        assert g.held_out == held[r.doc_id]
        if not any(c.isalpha() for c in r.text or ""):
            assert (g.lang_pred, g.score, g.rejected) == ("und", 0.0, True)
            continue
        v = unit(counts[r.doc_id], idf)
        best = {lang: max(float(v @ c) for c in centres) for lang, centres, _ in model}
        lang = min(best, key=lambda k: (-best[k], k))
        bound = next(least for k, _, least in model if k == lang)[len(counts[r.doc_id]).bit_length()]
        assert abs(g.score - best[lang]) < 2e-3 and best[lang] - best[g.lang_pred] < 2e-3
        assert abs(best[lang] - bound) < 2e-3 or g.rejected == (best[lang] < bound)
        same += g.lang_pred == lang
    assert same >= len(rows) - 2
