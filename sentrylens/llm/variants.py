"""Spelling variants: words one edit apart, found by walking a relational trie of all words."""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylens.llm.common import arrow_rows, empty_if_null, staged

RUN = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols that a state moves in one round. Any number gives the same result; with 1 a round is one level of the trie.
STRIDE = 8
#: Words of this many code points and more enter the trie in parts, so rounds do not follow the longest word.
LONG, PART = 64, 32


def counted_words(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7, min_count: int = 2, every: int = 31
) -> DataFrame:
    """``word, n``: maximal letter runs of whole texts, A-Z lower-cased, that occur ``min_count`` times.

    With h = crc32 of ``id:run``, a run whose h is a multiple of ``every`` loses its code point
    h % length. Only runs of ``min_length`` are taken out of a text; counts are added up before the shuffle.
    """
    doc = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc")
    runs = F.regexp_extract_all(empty_if_null(F.col(text_col)), F.lit(f"{RUN}{{{min_length},}}"), F.lit(0))
    found = df.select(doc, F.explode(runs).alias("run")).select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat_ws(":", "doc", "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, lost).otherwise(F.col("run"))
    return (
        found.withColumn("h", h)
        .select(word.alias("word"))
        .filter(F.length("word") >= min_length)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_count)
    )


def long_parts(word: str) -> list[tuple[str, str]]:
    """(context, part) of a long word: a part of ``PART`` symbols, or one more, and a digest of all around it.

    Two words one edit apart have an equal context around the parts that hold the edit.
    """
    m = len(word)
    spans = sorted({(lo, min(lo + PART + extra, m)) for lo in range(0, m, PART) for extra in (0, 1)})
    heads, tails = {}, {}
    state, done = hashlib.sha256(), 0
    for lo in sorted({lo for lo, _ in spans}):
        state.update(word[done:lo].encode())
        heads[lo], done = state.hexdigest()[:32], lo
    state, done = hashlib.sha256(), m
    for hi in sorted({hi for _, hi in spans}, reverse=True):
        state.update(word[hi:done][::-1].encode())
        tails[hi], done = state.hexdigest()[:32], hi
    return [(heads[lo] + tails[hi], word[lo:hi]) for lo, hi in spans]


def trie_entries(words: DataFrame) -> DataFrame:
    """What the trie holds: ``entry, id, context, core``. The context is the root of its own trie."""
    short = words.filter(F.length("word") <= LONG).select(
        F.col("id").alias("entry"), "id", F.lit("").alias("context"), F.col("word").alias("core")
    )

    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        parts = [(i, c, p) for i, w in zip(*(x.to_pylist() for x in batch.columns)) for c, p in long_parts(w)]
        return dict(zip(("id", "context", "core"), map(list, zip(*parts))))

    cut = arrow_rows(words.filter(F.length("word") >= LONG).select("id", "word"), rows, "id long, context string, core string")
    return short.unionByName(cut.withColumn("entry", F.xxhash64("context", "core")))


def _node(at: Column) -> Column:
    """The node that the first ``at`` symbols of ``core`` lead to."""
    return F.xxhash64("context", at, F.substring("core", F.lit(1), at))


def _ahead(at: Column, stride: int) -> Column:
    """The next symbols of ``core`` from ``at`` (0-based), with the end of the word as a last symbol."""
    return F.substring(F.concat(F.col("core"), F.lit("$")), at + 1, F.lit(stride))


def _target(at: Column) -> tuple[Column, Column]:
    """Where a walk to ``at`` ends: a node, or the entry itself behind its last symbol; and which of the two."""
    ended = at > F.length("core")
    return F.when(ended, F.col("entry")).otherwise(_node(at)).alias("target"), ended.alias("ended")


def near_pairs(words: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Ids of words that may be one edit apart, each pair once: ``a, b``.

    A state is (word, position, node, edits). Without an edit a word stands on its own path, so all these
    states are known at once; a node is the hash of its prefix. Each makes its one edit by meeting the
    edge table: a replaced symbol where the node is left by another symbol as well and both go on with the
    same symbols, a dropped symbol where an edge goes on as the word does behind it. (An inserted symbol
    is the dropped one of the other word.) Then rounds of joins with the edge table move each state on by its
    word's next symbols until it reaches the end of another word.

    Join keys hash a node and up to ``stride`` symbols behind it, so the root is no hot key. An edge is one row however many
    words share it, reduced before the shuffle; states under one key stream past one edge row. A collision of two 64-bit
    hashes can add a pair, which the caller's comparison drops, or hide one.
    """
    entries = staged(trie_entries(words))
    depth, length = F.col("depth"), F.length("core")
    paths = entries.withColumn("depth", F.explode(F.sequence(F.lit(0), length)))

    def edges(rows: DataFrame) -> DataFrame:
        key = F.xxhash64(_node(depth), _ahead(depth, stride)).alias("key")
        return rows.select(key, *_target(depth + stride))

    def code(at: Column) -> Column:
        return F.ascii(F.substring("core", at + 1, F.lit(1)))

    states = paths.filter(depth < length).select(
        F.xxhash64(_node(depth), _ahead(depth + 1, stride)).alias("key"), "entry", "depth", code(depth).alias("symbol"),
        (code(depth) != code(depth + 1)).alias("drops"),
    )
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("target", "long"), ("ended", "boolean"))]
    table = (
        edges(paths).withColumn("symbol", F.lit(None).cast("int"))
        .unionByName(states.select("key", *nothing, "symbol"))
        .groupBy("key")
        .agg(F.min("target").alias("target"), F.min("ended").alias("ended"), F.min("symbol").alias("lo"), F.max("symbol").alias("hi"))
        .filter("target is not null or lo < hi")
    )
    met = (
        states.join(table, "key")
        .filter("lo < hi or (drops and target is not null)")
        .withColumns({"target": F.when(F.col("drops"), F.col("target")), "forks": F.col("lo") < F.col("hi")})
        .drop("lo", "hi", "drops")
    )
    met = staged(met).join(entries, "entry")
    rest = F.substring(F.col("core"), depth + 2 + stride, length).alias("rest")
    to, end = _target(depth + 1 + stride)
    forking = met.filter("forks")
    branches = forking.select("key", F.col("symbol").alias("other"), to.alias("to"), end.alias("end")).distinct()
    replaced = (
        forking.select("key", "entry", "symbol", rest)
        .join(branches, "key")
        .filter("symbol < other")
        .select("entry", F.col("to").alias("target"), F.col("end").alias("ended"), "rest")
    )
    dropped = met.filter("target is not null").select("entry", "target", "ended", rest)
    frontier, found = staged(replaced.unionByName(dropped)), []
    for done in range(stride, LONG + 1 + stride, stride):
        found.append(frontier.filter("ended").select("entry", "target"))
        going = frontier.filter("not ended").select("entry", "rest", F.col("target").alias("node"))
        if going.isEmpty():
            break
        ahead = F.substring(F.concat(F.col("rest"), F.lit("$")), F.lit(1), F.lit(stride))
        going = going.select("entry", F.substring("rest", F.lit(stride + 1), F.length("rest")).alias("rest"), F.xxhash64("node", ahead).alias("key"))
        onward = edges(paths.filter(depth >= done)).join(going.select("key").distinct(), "key", "left_semi")
        onward = onward.groupBy("key").agg(F.min("target").alias("target"), F.min("ended").alias("ended"))
        frontier = staged(going.join(onward, "key").select("entry", "target", "ended", "rest"))
    pairs = reduce(DataFrame.unionByName, found).distinct()
    names = entries.select("entry", "id")
    named = pairs.join(names.withColumnRenamed("id", "x"), "entry").join(
        names.select(F.col("entry").alias("target"), F.col("id").alias("y")), "target"
    )
    return named.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def variant_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = 7,
    min_count: int = 2,
    ratio: int = 10,
    every: int = 31,
    stride: int = STRIDE,
) -> DataFrame:
    """Words with their near words and the form they stand for: ``word, form, root, n, n_near, form_n``.

    Near words differ by one inserted, deleted or replaced code point. The form is the near word of
    largest n (ties: first in code-point order) if it occurs ``ratio`` times as often, else null; the
    root is the last word along the forms.

    Every word is found however long it is: from ``LONG`` code points on it enters the trie by parts.
    Words found are compared as strings. A null text has no words; a null
    id counts as an empty one in the hash that deletes a letter; repeated ids and rows each count;
    further columns are ignored; an empty table, or one without words, gives an empty result.
    """
    words = staged(counted_words(df, id_col, text_col, min_length, min_count, every).withColumn("id", F.xxhash64("word")))
    pairs = staged(near_pairs(words, stride))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("id").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = both.join(other, "b").join(words.withColumnRenamed("id", "a"), "a").filter(F.levenshtein("word", "near", 1) == 1)
    best = met.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    best = best.select("word", "n_near", (-F.col("best")["col1"]).alias("best_n"), F.col("best")["near"].alias("best"))
    stands = F.col("best_n") >= ratio * F.col("n")
    table = staged(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(stands, F.col("best")).alias("form"), F.when(stands, F.col("best_n")).alias("form_n"),
        )
    )
    return table.join(roots(table, ratio), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def roots(table: DataFrame, ratio: int) -> DataFrame:
    """``word, root`` of the words that have a form: links are followed twice as far in each round.

    Counts grow along the links (``ratio`` is 2 or more), so there is no cycle, and 64 links are the longest chain of 64-bit counts.
    """
    if ratio < 2:
        raise ValueError("forms must occur at least twice as often as their variants")
    links = staged(table.filter("form is not null").select("word", F.col("form").alias("root")))
    for _ in range(6):
        ahead = links.select(F.col("word").alias("via"), F.col("root").alias("last"))
        joined = staged(links.join(ahead, links["root"] == ahead["via"], "left").select("word", "root", "last"))
        if joined.filter("last is not null").isEmpty():
            break
        links = joined.select("word", F.coalesce("last", "root").alias("root"))
    return links


#: The check: CRC-32 byte by byte, near words by their strings without one code point, roots by recursion.
ORACLE_SQL = """
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS steps),
runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents)),
counted AS (SELECT doc_id, run, count(*) AS times FROM runs GROUP BY ALL),
bytes AS (
    SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM counted),
hashed AS (
    SELECT run, times, xor(4294967295, list_reduce(
        list_transform(range(1, length(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT)),
        lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1]), CAST(4294967295 AS BIGINT))) AS h
    FROM bytes, crc),
shortened AS (
    SELECT times, CASE WHEN h % 31 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word
    FROM hashed),
words AS (
    SELECT word, CAST(sum(times) AS BIGINT) AS n FROM shortened WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
without AS (
    SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM without a JOIN without b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.rest = b.word),
best AS (
    SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
formed AS (
    SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form,
           CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
    FROM words LEFT JOIN best USING (word)),
followed AS (
    SELECT word, word AS root FROM formed
    UNION ALL SELECT f.word, t.form FROM followed f JOIN formed t ON f.root = t.word WHERE t.form IS NOT NULL),
ends AS (SELECT f.word, f.root FROM followed f JOIN formed t ON f.root = t.word WHERE t.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""
