"""Documents linked by the overlap of their word n-grams: T-occurrence search over inverted lists."""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylens.llm.common import arrow_rows, components, let_go, mix64, staged
from sentrylens.llm.suffix import chunks

#: Lists with more documents than this are long: they are not merged across documents.
LONG = 200
#: A document hands in this many n-grams at least (all, if it has fewer) and this share of them.
LEAST_PREFIX = 64
SLACK = 0.03
#: Documents of a candidate group that are compared in one task; larger groups are cut in blocks.
BLOCK = 256
#: Weight of a probe against a merge step when lists are divided (a fixed value of the method).
MU = 0.0085

_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_POWERS["up"]) < n:
        base = 0xD1342543DE82EF95
        for name, x in (("up", base), ("down", pow(base, -1, 1 << 64))):
            out = np.full(2 * n, x, dtype=np.uint64)
            out[0] = 1
            _POWERS[name] = np.cumprod(out)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (a run without ASCII white space, A-Z lower-cased), and its start."""
    space = (b == 32) | ((b >= 9) & (b <= 13))
    low = b + np.where((b >= 65) & (b <= 90), np.uint8(32), np.uint8(0))
    edge = np.zeros(len(b) + 1, dtype=bool)
    edge[offsets] = True
    free = np.concatenate([[True], space, [True]])
    starts = np.flatnonzero(~space & (free[: len(b)] | edge[:-1]))
    ends = np.flatnonzero(~space & (free[2:] | edge[1:])) + 1
    up, down = powers(len(b) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(b)])])
    return mix64((total[ends] - total[starts]) * down[starts]), starts


def ngram_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted different n-gram hashes of each text; with fewer words, the whole sequence is one."""
    weights = mix64(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    for _, b, offsets in chunks(column):
        words, starts = word_hashes(b, offsets)
        grams = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
        for i in range(n):
            grams += words[i : len(words) - n + 1 + i] * weights[i] if len(grams) else np.uint64(0)
        grams = mix64(grams)
        at = np.searchsorted(starts, offsets)
        for lo, hi in zip(at, at[1:]):
            if hi - lo >= n:
                yield np.unique(grams[lo : hi - n + 1])
            elif hi > lo:
                few = (words[lo:hi] * weights[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
                yield mix64(np.array([few], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)


def least_overlap(size: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Members that a set of this size must share with any set it is linked with."""
    return -(-size * percent // 100)


def prefix_size(size: np.ndarray | int, percent: int) -> np.ndarray:
    needed = size - least_overlap(size, percent) + 1
    return np.minimum(size, np.maximum(LEAST_PREFIX, needed + np.ceil(SLACK * np.asarray(size)).astype(int)))


@lru_cache(maxsize=100_000)
def sure_hits(size: int, percent: int) -> int:
    """Members of the prefixes that a set of this size shares with any set it is linked with.

    A prefix that is ``h`` - 1 longer than the usual one (all but the needed overlap, plus one) meets
    ``h`` shared members; the smaller ``h`` of the two sets counts.
    """
    if not size:
        return 0
    sizes = np.arange(least_overlap(size, percent), size * 100 // percent + 1)
    return int((prefix_size(sizes, percent) - sizes + least_overlap(sizes, percent)).min())


def linked(a: int, b: int, shared: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


class Forest:
    """Union-find over 0 .. n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def t_occurrence(lists: list[list[int]], least: int, skip: Callable[[int], bool]) -> Iterator[tuple[int, int]]:
    """Documents in at least ``least`` of the sorted lists, with their count (DivideSkip).

    The longest lists are set aside; the others are merged by a heap, and a document that
    could still reach ``least`` is probed in the long ones by binary search.
    """
    lists = sorted((x for x in lists if x), key=len)
    if len(lists) < least:
        return
    longest = len(lists[-1])
    aside = min(least - 1, int(least / (MU * math.log2(longest + 1) + 1)))
    merged, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    for doc, hits in groupby(heapq.merge(*merged)):
        if skip(doc):
            continue
        count = sum(1 for _ in hits)
        if count < least - aside:
            continue
        for x in long:
            i = bisect_left(x, doc)
            count += i < len(x) and x[i] == doc
        if count >= least:
            yield doc, count


def links_within(sets: list[np.ndarray], side: list[int], percent: int) -> list[tuple[int, int]]:
    """Enough links between sets to connect all that are linked, directly or through others.

    Only pairs of different sides count if there are two sides. A pair that is connected
    already is not looked at: each set is first compared with the first one, then searched for
    among the earlier ones that it is not connected with.
    """
    forest, out, two = Forest(len(sets)), [], len(set(side)) > 1
    lists: dict[int, list[int]] = {}
    sizes = [len(x) for x in sets]
    firsts = {s: side.index(s) for s in set(side)}
    for q, own in enumerate(sets):
        pivot = firsts[side[q]] if not two else next(v for s, v in firsts.items() if s != side[q])
        if pivot != q and linked(sizes[q], sizes[pivot], len(np.intersect1d(own, sets[pivot], assume_unique=True)), percent):
            if forest.join(q, pivot):
                out.append((q, pivot))
        members = own.tolist()
        if any(forest.root(c) != forest.root(q) for c in range(q)):
            def known(c: int, q: int = q) -> bool:
                return two and side[c] == side[q] or forest.root(c) == forest.root(q)

            found = t_occurrence([lists.get(e, []) for e in members], least_overlap(sizes[q], percent), known)
            for c, shared in found:
                if linked(sizes[q], sizes[c], shared, percent) and forest.join(q, c):
                    out.append((q, c))
        for e in members:
            lists.setdefault(e, []).append(q)
    return out


def by_key(df: DataFrame, key: str, work: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``work`` on the rows of each key (first column), one key at a time; keys must be bounded."""
    spark_schema = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        let_go()
        kinds = to_arrow_schema(spark_schema)
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], f.type) for i, f in enumerate(kinds)], schema=kinds
            )

        for _, group in groupby(rows, key=lambda r: r[0]):
            out += work(list(group))
            if len(out) >= 20_000:
                yield made()
                out = []
        if out:
            yield made()

    return df.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(run, spark_schema)


def summaries(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``doc_id, size, sure, same, prefix``: set size, hits it must have, hash of the set, its smallest members."""

    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        sets = list(ngram_sets(batch.column(1), n))
        return {
            "doc_id": batch.column(0),
            "size": [len(x) for x in sets],
            "sure": [sure_hits(len(x), percent) for x in sets],
            "same": [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets],
            "prefix": [x[: int(prefix_size(len(x), percent))].view(np.int64) for x in sets],
        }

    return arrow_rows(docs, rows, "doc_id long, size int, sure int, same binary, prefix array<long>")


def candidate_links(reps: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` that connect all documents which may be linked; stars, never all pairs.

    N-grams with the same documents are one list with a weight. Two linked documents have at
    least ``sure`` n-grams of their prefixes in common (the larger of their two numbers), at most
    ``in_long`` of them in long lists, so at least ``need`` = ``sure`` - ``in_long`` of either in short ones.

    - Documents without enough hits are left out.
    - A short list that alone has the weight which all its members must share connects them.
    - Other pairs meet in the first short list that they share, rare lists before common ones: a
      document goes to its lists as long as those from there on reach its ``need``. There the
      hits that two documents share are counted over all their lists.
    - Documents whose long lists alone may be enough also meet in those: in so many, in one
      order for all, that what is left is less than ``sure``.
    """
    members = reps.select("doc_id", "size", "sure", F.explode("prefix").alias("gram"))
    lists = (
        members.groupBy("gram")
        .agg(F.count(F.lit(1)).alias("docs"), F.sum(F.xxhash64("doc_id") % (1 << 52)).alias("list"))
        .filter("docs > 1")
        .withColumnRenamed("gram", "_gram")
    )
    hits = staged(
        members.join(lists, F.col("gram") == F.col("_gram"))
        .groupBy("doc_id", "size", "sure", "list", (F.col("docs") > LONG).alias("long"))
        .agg(F.count(F.lit(1)).cast("int").alias("weight"))
    )
    in_long = F.sum(F.when(F.col("long"), F.col("weight")).otherwise(0)).cast("int").alias("in_long")
    may = staged(
        hits.groupBy(F.col("doc_id").alias("_doc"), "sure").agg(in_long, F.sum("weight").alias("in_all"))
        .filter("in_all >= sure")
        .select("_doc", "in_long", F.col("sure").alias("_sure"))
    )
    short = staged(
        hits.filter("not long").join(may.drop("_sure"), F.col("doc_id") == F.col("_doc"))
        .select("doc_id", "size", "sure", "in_long", "list", "weight", (F.col("sure") - F.col("in_long")).alias("need"))
    )
    kinds = staged(
        short.groupBy(F.col("list").alias("_list"))
        .agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first"), (F.max("weight") >= F.max("sure")).alias("direct"))
        .filter("docs > 1")
    )
    met = staged(short.join(kinds, F.col("list") == F.col("_list")).drop("_list", "in_long"))
    direct = met.filter("direct").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    rare_first = Window.partitionBy("doc_id").orderBy("docs", "list").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    visits = (
        met.withColumn("onwards", F.sum("weight").over(rare_first))
        .filter((F.col("onwards") >= F.greatest("need", F.lit(1))) & ~F.col("direct"))
        .select("doc_id", F.col("list").alias("key"))
    )
    counted = met.select("doc_id", "size", "sure", "list", "weight").unionByName(
        hits.filter("long").select("doc_id", "size", "sure", "list", "weight")
    )
    profiles = (
        counted.join(visits.select(F.col("doc_id").alias("_doc")).distinct(), F.col("doc_id") == F.col("_doc"), "left_semi")
        .groupBy(F.col("doc_id").alias("_doc"), "size", "sure")
        .agg(F.map_from_entries(F.collect_list(F.struct("list", "weight"))).alias("hits"))
    )

    def connected(rows: list[tuple]) -> list[tuple]:
        docs = sorted((doc, size, sure, dict(hits)) for _, doc, size, sure, hits in rows)
        forest, out = Forest(len(docs)), []
        for i, (doc, size, sure, hits) in enumerate(docs):
            for j, (other, size_j, sure_j, hits_j) in enumerate(docs[:i]):
                if 100 * min(size, size_j) < percent * max(size, size_j) or forest.root(i) == forest.root(j):
                    continue
                if sum(min(hits[k], hits_j[k]) for k in hits.keys() & hits_j.keys()) >= max(sure, sure_j):
                    forest.join(i, j)
                    out.append((other, doc))
        return out

    cells = visits.join(profiles, F.col("doc_id") == F.col("_doc")).select("key", "doc_id", "size", "sure", "hits")
    searched = by_key(cells, "key", connected, "a long, b long")
    starved = may.filter("in_long >= _sure").select("_doc")
    onwards = Window.partitionBy("doc_id").orderBy("list").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    in_lists = (
        hits.filter("long")
        .withColumn("onwards", F.sum("weight").over(onwards))
        .filter("onwards >= sure")
        .select("list", "doc_id")
        .join(starved, F.col("doc_id") == F.col("_doc"), "left_semi")
    )
    first = in_lists.groupBy(F.col("list").alias("_list")).agg(F.min("doc_id").alias("a"))
    long = in_lists.join(first, F.col("list") == F.col("_list")).select("a", F.col("doc_id").alias("b"))
    return direct.union(searched).union(long).filter("a <> b").distinct()


def jaccard_links(
    df: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the class of each document under overlap links.

    Two documents are linked when the Jaccard overlap of their sets of word ``n``-grams is at
    least ``percent`` / 100; ``component_id`` is the smallest id reachable by links.

    1. Equal sets are one class; its smallest id stands for it.
    2. Each class hands in its smallest n-gram hashes, so many that linked sets must share
       several. Long lists are not needed to find pairs that have hits outside them.
    3. Candidates are connected into groups (``candidate_links``), each with one n-gram set per class.
    4. Within a group, sets are searched by T-occurrence; groups over ``BLOCK`` are cut
       in blocks that meet two by two. Tasks return a forest of links, never all pairs.
    5. Links are contracted to components.

    Texts that are null or without words have no n-grams and are linked with nothing. Rows
    with a null id are returned with a null component. Rows that share an id count as one document with the links of
    each. An empty table gives an empty result; further columns are ignored.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    all_sets = staged(summaries(docs, n, percent))
    sets = all_sets.filter("size > 0 and doc_id is not null")
    reps = staged(sets.groupBy("same").agg(F.min(F.struct("doc_id", "size", "sure", "prefix")).alias("rep")))
    groups = components(candidate_links(reps.select("rep.*"), percent), "a", "b")
    nodes = staged(
        groups.select("node", F.col("component").alias("group"))
        .union(groups.select("component", "component").distinct())
    )
    counts = nodes.groupBy(F.col("group").alias("_group")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    routed = (
        nodes.join(counts, F.col("group") == F.col("_group"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .select("node", "group", "block", "blocks")
    )

    def sets_of(batch: pa.RecordBatch) -> dict[str, list]:
        found = [x.tobytes() for x in ngram_sets(batch.column(1), n)]
        return {"doc_id": batch.column(0), "group": batch.column(2), "block": batch.column(3), "blocks": batch.column(4), "members": found}

    # the documents in groups grow with the corpus: a broadcast that suits a small one is not planned
    shipped = arrow_rows(
        docs.join(routed.hint("merge"), F.col("doc_id") == F.col("node")).select("doc_id", "text", "group", "block", "blocks"),
        sets_of,
        "doc_id long, group long, block int, blocks int, members binary",
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = shipped.withColumn("other", other).select(
        F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "doc_id", "block", "members"
    )

    def search(rows: list[tuple]) -> list[tuple]:
        rows.sort(key=lambda r: (r[2], r[1]))
        ids = [r[1] for r in rows]
        found = links_within([np.frombuffer(r[3], dtype=np.uint64) for r in rows], [r[2] for r in rows], percent)
        return [(ids[a], ids[b]) for a, b in found]

    links = staged(by_key(cells, "key", search, "a long, b long"))
    classes = components(links, "a", "b")
    reached = reps.select(F.col("same").alias("_same"), F.col("rep.doc_id").alias("rep")).join(
        classes, F.col("rep") == F.col("node"), "left"
    ).select("_same", F.coalesce("component", "rep").alias("component"))
    placed = (
        sets.select("doc_id", "size", "same")
        .join(reached, F.col("same") == F.col("_same"))
        .select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))
    )
    alone = all_sets.filter("size = 0 or doc_id is null").select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")
    )
    return placed.unionByName(alone)
