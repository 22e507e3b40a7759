import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrylens.llm import ann, bpe, common, langid, mixing
from sentrylens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_bpe_equals_the_library(make):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    texts += [None, "", " ", "<|endoftext|>x <|endoftext|><|endoftext|>", "a" * 4000, " " * 700 + "\n\n x", "日本語 🙂 Ω é", "It's 'll \x1c\x85\xa0 ²½"]
    rows = list(enumerate(texts)) + [(None, "null id"), (1, texts[1])]
    got = bpe.bpe_round_trip(make(rows), path, keep_ids=True).collect()
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert all(len(r.ids) == r.n_tokens for r in got)
    assert bpe.bpe_round_trip(make([]), path).collect() == []


def test_workers_let_go_of_the_encoder_when_another_operator_begins(make, spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    docs = make([(i, f"text {i}") for i in range(64)])

    def held(batch):
        return {"n": [bpe.coder.cache_info().currsize]}

    spread = docs.repartition(32)
    for _ in range(2):
        assert bpe.bpe_round_trip(spread, path).count() == 64
        left = [r.n for r in common.arrow_rows(spread.select("doc_id"), held, "n long").collect()]
        assert left and set(left) == {0}
        assert bpe.bpe_round_trip(spread, path).count() == 64
        kept = common.arrow_rows(spread.select("doc_id"), held, "n long", keeps=bpe.coder).collect()
        assert any(r.n for r in kept)


def test_words_of_a_batch_are_in_memory_a_part_at_a_time(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    code, library, parts = bpe.Coder(path), Tokenizer.from_file(path), []
    texts = ["one two three", "", "x" * 50, "four five", "six " * 30, "", "seven"]
    whole = code.encode_part
    monkeypatch.setattr(bpe, "PART_CHARS", 20)
    monkeypatch.setattr(code, "encode_part", lambda part: parts.append(part) or whole(part))
    got = [x.tolist() for x in code.encode_batch(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(parts, []) == texts and all(sum(map(len, p)) <= 20 or len(p) == 1 for p in parts)
    assert list(code.encode_batch([])) == []


def test_frequent_words_are_encoded_once_however_many_rare_ones_pass_by(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    code, library, asked = bpe.Coder(path), Tokenizer.from_file(path), Counter()
    encode = code.encode_words
    monkeypatch.setattr(bpe, "CACHED_WORDS", 40)
    monkeypatch.setattr(code, "encode_words", lambda words: asked.update(words) or encode(words))
    for i in range(60):
        text = "often met" + "".join(f" rare{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(12))
        (got,) = code.encode_batch([text])
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids
    assert asked["often"] == asked[" met"] == 1
    assert len(asked) == 2 + 60 * 12 and len(code.known) + len(code.older) <= 40 + 2 * len(code.special)
    for text in (" ".join(f"w{i}x{i}" for i in range(90)), "often met"):
        (got,) = code.encode_batch([text])
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(code.known) + len(code.older) <= 40


@pytest.mark.parametrize("short, block, bits", [(64, 1 << 14, 19), (9, 3, 1), (4, 1, 2)])
def test_words_settled_together_equal_the_library(monkeypatch, short, block, bits):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    for name, value in {"SHORT_BYTES": short, "BLOCK_WORDS": block, "RECENT_BITS": bits}.items():
        monkeypatch.setattr(bpe, name, value)
    code, library = bpe.Coder(path), Tokenizer.from_file(path)
    draw = np.random.default_rng(7)
    texts = ["".join(draw.choice([*"aeinorst -'29", "th", "ing", " the", "é", "ж", "\n"], n)) for n in (1, 30, 400, 2000)]
    texts += ["a" * n for n in (1, 63, 64, 65, 300)] + ["\U0001f642\u65e5\u672c\u03a9\xe9" * 9, "b ba bab baba abab <|endoftext|>b", ""]
    got = [x.tolist() for x in code.encode_batch(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    words = sorted({w for t in texts for w in code.split(t)} - code.special.keys())
    grown = code.encode_words(words)
    assert grown == {w: code.walk(w.encode()) for w in words}


def test_language_id_on_held_out_documents(spark):
    got = QUERIES["op9_language_id"](spark, SF).toPandas().set_index("doc_id")
    true = duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").df().set_index("doc_id").lang
    held = got[got.held_out]
    assert (held.lang_pred == true[held.index]).mean() > 0.97
    assert got.score.between(0, 1).all() and len(got) == len(true)


def test_language_id_special_cases(make, spark):
    rows = [(i, "the cat and the dog " * 5) for i in range(8)] + [(20 + i, "le chat et la souris " * 5) for i in range(8)]
    rows += [(50, None), (51, ""), (52, "123 !!"), (None, "the dog"), (54, "the cat " * 20_000), (54, "le chat " * 9)]
    df = make(rows).withColumn("lang", F.when(F.col("text").contains("the"), "en").when(F.col("text").contains("le"), "fr"))
    got = defaultdict(set)
    for r in langid.language_id(df).collect():
        got[r.doc_id].add((r.lang_pred, r.rejected, r.held_out))
    assert {got[i].copy().pop()[:2] for i in (50, 51, 52)} == {("und", True)}
    assert {x[0] for x in got[54]} == {"en", "fr"} and got[None] == {("en", False, False)}
    none = langid.language_id(df.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
    assert langid.language_id(df.limit(0)).collect() == []


FOREIGN = (
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto",
    "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền. Mọi con người đều được tạo hoá ban cho lý trí",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
    "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
    "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا",
    "qzv xkwj pfgh zzqy wvuk jxqp bvnm kqzx hjgf dzwq xvbk qpwj zkyx",
)


def test_unlearned_languages_go_and_clean_held_out_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6 + i, FOREIGN[3], "en") for i in range(2)], "doc_id long, text string, lang string")
    held = [r.text for r in docs.filter(langid.held_out(F.col("doc_id"))).select("text").collect() if r.text and any(map(str.isalpha, r.text))]
    learn = langid.learnable(docs)
    for model in (langid.fit(learn), langid.fit(learn.unionByName(odd))):
        assert np.mean(langid.classify(held, model)[2]) <= 0.01
        assert [far for t, far in zip(FOREIGN, langid.classify(list(FOREIGN), model)[2]) if t != FOREIGN[3]] == [True] * 6
    assert langid.classify([FOREIGN[3]], langid.fit(learn))[2] == [True]


def brute_rates(p, tokens, targets, rounds=40_000, lower=0):
    step = 1 / np.linalg.eigvalsh((p * tokens[:, None]).T @ p)[-1]
    rate = np.ones(len(p))
    for _ in range(rounds):
        rate = np.maximum(lower, rate - step * (p @ ((rate * tokens) @ p - targets)))
    return rate


def test_rates_reach_the_targets_like_plain_projected_gradient(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3, 0.3, 0.3], size=60)
    tokens = rng.integers(0, 200, size=60).astype(float)
    targets = np.array([0.6, 0.35, 0.05]) * tokens.sum()
    rows = spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(tokens, p)], "n_tokens long, posterior array<double>")
    rate = mixing.rates_of(p, mixing.fit_rates(rows, targets, iterations=120))
    assert (rate >= 0).all()
    best = brute_rates(p, tokens, targets)
    loss = [np.square((r * tokens) @ p - targets).sum() for r in (rate, best)]
    assert loss[0] <= loss[1] + 1e-3 * np.square(targets).sum()


def soft_posteriors(spark):
    rng = np.random.default_rng(9)
    p = rng.dirichlet([8.0, 4.0, 0.6], size=300)
    tokens = rng.integers(1, 200, size=300).astype(float)
    rows = [(int(t), [float(x) for x in q]) for t, q in zip(tokens, p)]
    return p, tokens, spark.createDataFrame(rows, "n_tokens long, posterior array<double>").coalesce(3)


def test_production_fit_meets_reachable_targets(spark):
    p, tokens, rows = soft_posteriors(spark)
    share = np.array([0.70, 0.28, 0.02])
    rate = mixing.rates_of(p, mixing.fit_rates(rows, share * tokens.sum()))
    assert (rate >= 0).all()
    assert np.abs((rate * tokens) @ p / tokens.sum() - share).max() <= 2e-4


def test_production_fit_comes_nearest_to_unreachable_targets_and_says_so(spark):
    p, tokens, rows = soft_posteriors(spark)
    targets = np.array([0.05, 0.9, 0.05]) * tokens.sum()
    with pytest.warns(UserWarning, match="no rates meet the targets"):
        rate = mixing.rates_of(p, mixing.fit_rates(rows, targets))
    loss = [np.square((r * tokens) @ p - targets).sum() for r in (rate, brute_rates(p, tokens, targets))]
    assert (rate >= 0).all() and loss[0] <= loss[1] + 1e-6 * np.square(targets).sum()
    with pytest.raises(RuntimeError):
        mixing.fit_rates(rows, targets, iterations=1)


def test_lower_bounds_are_part_of_the_fit(spark):
    p, tokens, rows = soft_posteriors(spark)
    least = np.array([1.0, 1.0, 0.0])
    lower = mixing.bounds(p, least)
    share = np.array([0.6, 0.36, 0.04])
    forced = mixing.forced(rows, least, tokens.sum())
    assert forced == pytest.approx((lower * tokens) @ p / tokens.sum())
    targets = np.maximum(share, 1.2 * forced) * tokens.sum()
    rate = mixing.rates_of(p, mixing.fit_rates(rows, targets, least), lower)
    assert (rate >= lower).all() and np.abs((rate * tokens) @ p - targets).max() <= 2e-4 * targets.sum()
    # targets below what the bounds force: the nearest totals
    low = 0.5 * tokens.sum() * share
    with pytest.warns(UserWarning, match="no rates meet the targets"):
        rate = mixing.rates_of(p, mixing.fit_rates(rows, low, least), lower)
    loss = [np.square((r * tokens) @ p - low).sum() for r in (rate, brute_rates(p, tokens, low, lower=lower))]
    assert (rate >= lower).all() and loss[0] <= loss[1] + 1e-6 * np.square(low).sum()


def test_mixture_of_labelled_domains(make, spark):
    rows = [(i, "good words here and there") for i in range(30)] + [(100 + i, "toxic clown slur") for i in range(30)]
    rows += [(500, None), (501, ""), (None, "good words"), (502, "long " * 30_000)]
    labels = spark.createDataFrame([(i, "good") for i in range(20)] + [(100 + i, "toxic") for i in range(20)] + [(3, "toxic"), (None, "good"), (7, None)], "doc_id long, domain string")
    got = mixing.mix(make(rows), labels, {"good": 1.0}).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[120].domain == "toxic" and by[120].rate < by[25].rate and by[120].copies <= 1
    assert by[500].n_tokens == 0 and by[502].n_tokens == 30_000
    nothing = mixing.mix(make(rows), labels.limit(0), {"good": 1.0}).collect()
    assert {(r.domain, r.rate, r.copies) for r in nothing} == {(None, 1.0, 1)}
    assert mixing.mix(make([]), labels, {"good": 1.0}).collect() == []


def exact_nearest(ids, x, q, k=10):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def test_multiprobe_recall_and_scores(spark):
    got = defaultdict(list)
    for r in QUERIES["op1_multiprobe_search"](spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    d = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").df()
    ids, x = d.vec_id.to_numpy(), np.stack(d.embedding).astype(float)
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        want = exact_nearest(ids, x, q)
        true = dict(exact_nearest(ids, x, q, len(ids)))
        assert all(abs(true[v] - s) < 1e-9 for v, s in got[q])
        assert got[q] == sorted(got[q], key=lambda r: (r[1], r[0]))
        hits += len({v for v, _ in got[q]} & {v for v, _ in want})
        total += len(want)
    assert hits / total >= 0.9


def test_multiprobe_serves_outliers_like_crowds(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((25, 16))
    crowd = np.concatenate([c + 0.02 * rng.standard_normal((80, 16)) for c in centres])
    lone = 30 * rng.standard_normal((150, 16))
    x = np.concatenate([crowd, lone])
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.multiprobe_search(df, F.col("vec_id") % 25 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    recall = defaultdict(list)
    for q in ids[ids % 25 == 0]:
        want = exact_nearest(ids, x, q)
        assert [r for r, _, _ in sorted(got[q])] == list(range(1, 11))
        recall[q >= len(crowd)].append(len({v for _, v, _ in got[q]} & {v for v, _ in want}) / 10)
    assert len(recall[True]) == 6 and np.mean(recall[True]) >= 0.9 and np.mean(recall[False]) >= 0.9
    few = ann.multiprobe_search(df.filter("vec_id < 4 or vec_id = 2100"), F.lit(True))
    assert {(r.query_id, r["count"]) for r in few.groupBy("query_id").count().collect()} == {(i, 4) for i in (0, 1, 2, 3, 2100)}


def test_reach_ends_where_neighbours_are_lost():
    d = [float(i) for i in range(100)]
    assert ann.reach_of(d, [True] * 100) == 99.0
    assert ann.reach_of(d, [i < 64 for i in range(100)]) == 63.0
    assert ann.reach_of(d, [False] * 100) == 0.0


def test_multiprobe_copies_and_unusable_vectors(spark):
    rows = [(i, [1.0, 0.0, 2.0]) for i in range(40)] + [(100 + i, [float(i), 1.0, 0.5]) for i in range(8)]
    rows += [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 0.0]), (203, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (3, [1.0, 0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit(1)).withColumn("ids", F.lit(2))
    got = ann.multiprobe_search(df, F.col("vec_id").isin(0, 5, 200, 201, 203)).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {0, 5}
    assert [r.vec_id for r in got if r.query_id == 5] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]
    assert all(r.score == 0 for r in got)
    assert ann.multiprobe_search(df.limit(0), F.lit(True)).collect() == []
    alone = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert ann.multiprobe_search(alone, F.lit(True)).collect() == []


def test_perturbations_come_in_order_of_cost():
    inside = np.array([0.1, 0.45, 0.8])
    cost = lambda moves: sum(inside[m] ** 2 if s < 0 else (1 - inside[m]) ** 2 for m, s in moves)
    got = ann.perturbations(inside, 27)
    assert got[0] == [] and len({tuple(sorted(m)) for m in got}) == len(got) == 27
    assert [cost(m) for m in got[1:]] == sorted(cost(m) for m in got[1:])
