"""The corpus pipeline: stages over ``documents``, each written and read again.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of
``documents``, with ``n_chars`` counted anew where the text changes. Nulls, empty texts and
empty tables pass as the operators' docstrings say; rows with a null id stay where a stage decides by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylens.llm import bpe, jaccard, langid, lines, mixing
from sentrylens.llm.common import staged, table

#: Shares of the domains in the mixture, its size against the documents that reach it, and the rate that
#: documents of a likeliest domain have at least.
MIXTURE = {"good": 0.86, "plain": 0.10, "toxic": 0.04}
SCALE = 1.2
LEAST = {"good": 1.0, "plain": 1.0}


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is near a learned language; texts without a letter go."""
    return langid.keep_known(docs, langid.fit(langid.learnable(docs)))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of lines that an earlier place has; documents left with nothing go."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = lines.line_dedup(docs, carry=rest).filter("n_removed = 0 or trim(kept) <> ''")
    return found.withColumnRenamed("kept", "text").withColumn(
        "n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    ).select(docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class whose five-word shingles overlap by 0.8 or more."""
    found = jaccard.jaccard_links(docs, n=5, percent=80)
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say. Only those whose likeliest domain is toxic can go
    altogether; the others' rates are fitted from one up."""
    labels = table(spark, sf_dir, "labels")
    named = labels.select("doc_id", mixing.domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    found = mixing.mix(docs, named, MIXTURE, SCALE, least=LEAST)
    times = found.select(F.col("doc_id").alias("_id"), F.col("copies").alias("_times")).dropDuplicates(["_id"])
    return (
        docs.join(times, F.col("doc_id").eqNullSafe(F.col("_id")))
        .filter("_times > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
        .select(docs.columns)
    )


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the hashes of the ids and of the text they decode to."""
    import public_tokenizers

    return bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard_join", one_of_near_duplicates),
    ("target_mixture", mixed),
    ("bpe_encoding", encoded),
]
#: SQL expresses none of the fitted stages; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
