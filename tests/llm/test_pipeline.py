import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from sentrylens.llm import langid
from sentrylens.llm.common import staged
from test_text_joins import brute_components, brute_lines
from tests_llm_helpers import SF

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return [tuple(r) for r in df.select(COLUMNS).collect()]


def stage(spark, k, docs):
    return staged(P.STAGES[k][1](spark, docs, SF))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_stage_drops_only_what_the_model_rejects(spark, docs):
    model = langid.fit(langid.learnable(docs))
    all_rows = rows(docs)
    far = langid.classify([r[1] for r in all_rows], model)[2]
    got = stage(spark, 0, docs)
    assert Counter(rows(got)) == Counter(r for r, gone in zip(all_rows, far) if not gone)
    assert len(rows(got)) >= 0.99 * len(all_rows)


def test_line_stage_equals_brute_force(spark, docs):
    want = brute_lines([(r[0], r[1]) for r in rows(docs)], 3)
    got = {r[0]: r for r in rows(stage(spark, 1, docs))}
    for doc, _, lang, source, n_chars in rows(docs):
        _, removed, kept = want[doc]
        if removed and not kept.strip(" "):
            assert doc not in got
        else:
            assert got[doc] == (doc, kept, lang, source, len(kept) if removed else n_chars)


def test_near_duplicate_stage_keeps_the_first_of_each_class(spark, docs):
    found = brute_components([(r[0], r[1]) for r in rows(docs)], 5, 80)
    assert Counter(rows(stage(spark, 2, docs))) == Counter(r for r in rows(docs) if found[r[0]][1] == r[0])


def test_mixture_stage_meets_its_targets_and_loses_only_toxic_documents(spark):
    from sentrylens.llm import mixing

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    named = labels.select("doc_id", mixing.domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    rates = {r.doc_id: r for r in mixing.mix(docs, named, P.MIXTURE, P.SCALE, least=P.LEAST).collect()}
    got = Counter(r[0] for r in rows(P.STAGES[3][1](spark, docs, sf)))
    assert got == Counter({d: r.copies for d, r in rates.items() if r.copies})
    # the totals of the stage's output, rounded copies and all
    total = sum(n * rates[d].n_tokens * np.array(rates[d].posterior) for d, n in got.items())
    domains = sorted(P.MIXTURE)
    assert np.abs(total / total.sum() - [P.MIXTURE[d] for d in domains]).max() <= 1e-2
    assert all(r.copies >= 1 and r.rate >= 1 for r in rates.values() if r.domain != "toxic")
    toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
    lost = set(rates) - got.keys()
    assert lost and len(lost & toxic) >= 0.6 * len(lost & {r.doc_id for r in labels.collect()})


def test_encoding_stage_equals_the_library(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r[0]: r[1] for r in rows(docs)}
    for r in stage(spark, 4, docs).collect():
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()


def test_run_chains_the_stages_and_takes_an_empty_table(spark, tmp_path, docs):
    got = P.run(spark, SF)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(got.columns) and got.count() > 100
    odd = spark.createDataFrame(
        [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the cat sat on the mat", "en", "s", 22), (3, "the cat sat on the mat", "en", "s", 22), (3, "the cat sat on the mat", "en", "s", 22)],
        docs.schema,
    )
    for name, df in (("odd", odd), ("empty", docs.limit(0))):
        folder = str(tmp_path / name)
        df.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
        out = P.run(spark, folder).collect()
        assert (name == "empty") == (out == [])
