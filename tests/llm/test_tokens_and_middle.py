"""Token files and fill-in-middle against the library and against plain Python."""

import hashlib
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sentrylens.llm import fim, token_files
from sentrylens.session import table_dir

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
TEXTS = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
ODD = [
    None, "", " ", "  x", "a  b   c \n d\n  e \n\n f", "<|endoftext|> x <|endoftext|>\n <|endoftext|>", "\0a \0b", "a" * 9000, " " * 700 + "\n\n x",
    "日本語 🙂 Ω é ́x", "It's 'll \x1c\x85\xa0 ²½   y", "x\xa0 y ​ z", "<P>", "a <S> b", "x<M>", "<", "é",
]


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoder_equals_the_library(monkeypatch):
    rng = random.Random(3)
    mixed = ["".join(rng.choice(["a", "word", " ", "  ", "\n", "\t", "'s", "7", "é", "字", "!", "\xa0", "\x1c"]) for _ in range(60)) for _ in range(500)]
    texts = TEXTS + [t or "" for t in ODD] + mixed
    encode = token_files.Encoder(PATH)
    texts += ["\x01 a b\x01", "\x02 \x02a"]

    def ids(encoder, part):
        return [x.tolist() for x in encoder(pa.array(part, pa.string()))]

    want = library_ids(texts)
    assert ids(encode, texts) == want and len(encode.names) and ids(encode, texts) == want
    assert ids(encode, []) == [] and ids(encode, [None, ""]) == [[], []]
    assert [x.tolist() for x in encode(pa.array(texts, pa.string())[100:])] == want[100:]
    monkeypatch.setattr(token_files, "CACHED_PIECES", 40)
    small = token_files.Encoder(PATH)
    for i in range(0, len(texts), 25):
        assert ids(small, texts[i : i + 25]) == want[i : i + 25]
    encode.by_pieces = False
    assert ids(encode, texts[:20]) == want[:20]


@pytest.mark.parametrize("layout", [token_files.Layout(), token_files.Layout(8, 4, 3)])
def test_files_give_every_document_back(make, spark, layout):
    rows = list(enumerate(TEXTS[:60] + ODD)) + [(None, "no id"), (7, "again"), (7, "again"), (-5, TEXTS[3])]
    ids = [x + [0] for x in library_ids([t for _, t in rows])]
    folder = table_dir(spark)
    index = token_files.write_token_files(make(rows), PATH, folder, layout=layout)
    got = token_files.read_documents(
        index, lambda x: {"crc": zlib.crc32(x.astype("<u4").tobytes()), "dump": x.tolist()}, "crc long, dump array<int>"
    ).collect()
    assert Counter((r.doc_id, tuple(r.dump)) for r in got) == Counter((i, tuple(x)) for (i, _), x in zip(rows, ids))
    at, last = 0, None
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.dump) and r.crc == zlib.crc32(np.array(r.dump, "<u4").tobytes())
        assert last is None or r.doc_id >= last
        at, last = at + r.n_tokens, r.doc_id
    assert sum(r.n_tokens for r in got) == sum(map(len, ids))
    # the files are sequences of one length, and the mask marks what belongs to documents
    files = [r.file for r in index.select("file").distinct().collect()]
    assert layout.roll > 3 or len(files) > 8
    total = 0
    for f in files:
        reader = token_files.SequenceReader(f)
        for k in range(reader.sequences()):
            x, mask = reader.sequence(k)
            assert len(x) == len(mask) == layout.length and not x[~np.array(mask)].any()
            assert not x.flags.owndata  # a view of the mapped file, and so is the mask
            total += mask.true_count
    assert total == at
    whole = token_files.read_sequences(index)
    assert whole.select(F.sum(F.size(F.filter("mask", lambda m: m)))).first()[0] == total
    with pytest.raises(ValueError):
        reader.ids(0, 10**9)


def test_files_of_a_lost_attempt_are_not_read(make, spark):
    folder = table_dir(spark)
    index = token_files.write_token_files(make([(1, "a b"), (2, "c")]), PATH, folder)
    first = index.first().file
    path = first.removeprefix("file:")
    with open(os.path.join(os.path.dirname(path), "part-000000-000000-lost.arrow"), "wb") as f:
        f.write(b"half a file")
    got = token_files.read_documents(index, lambda x: {"n": len(x)}, "n int").collect()
    assert sorted((r.doc_id, r.n) for r in got) == [(1, 3), (2, 2)]
    empty = token_files.token_files(make([]), PATH)
    assert empty.collect() == [] and empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def by_hand(i, t, plain=10, spm=20):
    t = t or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(t)
    if not t or any(m in t for m in fim.MARKS) or h3 % 100 >= 100 - plain:
        return i, n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = t[:a], t[a:b], t[b:]
    if h4 % 100 < spm:
        return i, n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return i, n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def test_units_rank_and_select():
    rng = random.Random(1)
    for size in (0, 1, 7, 8, 9, 64, 1001):
        text = "".join(rng.choice("aé字🙂\0") for _ in range(size))
        data = np.frombuffer(text.encode(), np.uint8)
        units = fim.Units(data)
        ends = np.cumsum([len(c.encode()) for c in text]).astype(np.int64)
        assert units.rank(np.array([len(data)])).tolist() == [size]
        if size:
            assert units.select(np.arange(1, size + 1)).tolist() == ends.tolist()
            assert units.rank(ends).tolist() == list(range(1, size + 1))


def test_middle_equals_plain_python_and_comes_back(make):
    rng = random.Random(2)
    made = ["".join(rng.choice("ab é字🙂\n<>PSM") for _ in range(rng.randrange(40))) for _ in range(600)]
    rows = list(enumerate(TEXTS + ODD + made)) + [(None, "no id here"), (3, TEXTS[3]), (3, TEXTS[3]), (-9, "é" * 100_000)]
    found = fim.fill_in_middle(make(rows)).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = Counter(by_hand(i, t) for i, t in rows)
    assert Counter(tuple(r)[:6] for r in found) == want
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert Counter((r.doc_id, r.back) for r in found) == Counter((i, t or "") for i, t in rows)
    assert fim.fill_in_middle(make([])).collect() == []


def test_middle_with_other_marks_and_shares(make):
    marks = ("[pre]", "[suf]", "[mid]")
    rows = list(enumerate(TEXTS[:40]))
    found = fim.fill_in_middle(make(rows), marks=marks, plain_percent=0, spm_percent=100)
    back = found.select("doc_id", "form", fim.restored(F.col("output"), F.col("form"), marks).alias("t")).collect()
    assert {r.form for r in back} == {"spm"} and {r.doc_id: r.t for r in back} == dict(rows)
