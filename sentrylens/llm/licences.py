"""Licence scan by canonical digests of whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylens.llm.common import empty_if_null, staged
from sentrylens.llm.licence_texts import KNOWN, SPELLINGS

#: A line that begins with a copyright notice; Java's and RE2's patterns agree on it.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The words of a text without case, punctuation, copyright lines and spelling variants.

    Words are separated, and surrounded, by one space each; a text without words is one space.
    """
    plain = F.regexp_replace(F.lower(empty_if_null(text)), COPYRIGHT_LINE, "\n")
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, NOT_WORD, " ")), F.lit(" "))
    for variant, usual in SPELLINGS:
        words = F.replace(words, F.lit(f" {variant}"), F.lit(f" {usual}"))
    return words


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licences(spark: SparkSession) -> DataFrame:
    """The built-in licence texts and notices: ``licence_id, text``."""
    rows = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in KNOWN)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(licence_id, text)")


def quoted(text: str) -> str:
    return "r'" + text.replace("'", "’") + "'"


def licence_scan(
    df: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Licences of every row: ``doc_id, canon_sha256, licence_id, notice_ids, n_notices``.

    ``licence_id`` is the known licence whose canonical text is the whole text; each line is
    looked up as an entire text too, and ``notice_ids`` lists the licences so found (sorted, separated by
    commas, empty if none), ``n_notices`` the number of such lines.

    Both are equality joins of digests. No side is hinted: a short list of licences is
    broadcast by its size, a long one is shuffled, where a digest that many lines share is
    split by the skew join. Only matching lines are grouped by row.

    A null or empty text has no words and never matches, nor does a known text without words.
    Known texts with the same canonical form are one licence, the first by id. Ids may repeat
    or be null: rows that share an id have their notices counted together. Further columns of
    ``df`` are ignored. Empty tables give empty results, or no match.
    """
    no_words = F.sha2(F.lit("  "), 256)
    keys = staged(
        known.select(digest(F.col("text")).alias("known_digest"), "licence_id")
        .filter(F.col("known_digest") != no_words)
        .groupBy("known_digest")
        .agg(F.min("licence_id").alias("licence_id"))
    )
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    whole = docs.select("doc_id", digest(F.col("text")).alias("canon_sha256"))
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    notices = (
        lines.select("doc_id", digest(F.col("line")).alias("line_digest"))
        .join(keys, F.col("line_digest") == F.col("known_digest"))
        .groupBy("doc_id")
        .agg(
            F.array_join(F.array_sort(F.collect_set("licence_id")), ",").alias("notice_ids"),
            F.count(F.lit(1)).alias("n_notices"),
        )
        .withColumnRenamed("doc_id", "noticed")
    )
    return (
        whole.join(keys, F.col("canon_sha256") == F.col("known_digest"), "left")
        .join(notices, F.col("doc_id").eqNullSafe(F.col("noticed")), "left")
        .select(
            "doc_id",
            "canon_sha256",
            "licence_id",
            F.coalesce("notice_ids", F.lit("")).alias("notice_ids"),
            F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices"),
        )
    )


def oracle_sql() -> str:
    """The same scan in DuckDB."""

    def canon(x: str) -> str:
        plain = f"regexp_replace(lower(coalesce({x}, '')), '{COPYRIGHT_LINE}', chr(10), 'g')"
        words = f"' ' || trim(regexp_replace({plain}, '{NOT_WORD}', ' ', 'g')) || ' '"
        for variant, usual in SPELLINGS:
            words = f"replace({words}, ' {variant}', ' {usual}')"
        return words

    rows = ", ".join("('{}', '{}')".format(i, t.replace("'", "’")) for i, t in KNOWN)
    return f"""
WITH known AS (
  SELECT sha256({canon("text")}) AS d, min(licence_id) AS licence_id
  FROM (VALUES {rows}) AS t(licence_id, text) WHERE {canon("text")} <> '  ' GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
notices AS (
  SELECT doc_id, string_agg(DISTINCT licence_id, ',' ORDER BY licence_id) AS notice_ids, count(*) AS n_notices
  FROM (SELECT doc_id, sha256({canon("line")}) AS d FROM lines) JOIN known USING (d) GROUP BY doc_id)
SELECT w.doc_id, w.canon_sha256, k.licence_id, coalesce(n.notice_ids, '') AS notice_ids,
       coalesce(n.n_notices, 0)::BIGINT AS n_notices
FROM (SELECT doc_id, sha256({canon("text")}) AS canon_sha256 FROM documents) w
LEFT JOIN known k ON w.canon_sha256 = k.d LEFT JOIN notices n ON w.doc_id = n.doc_id"""
