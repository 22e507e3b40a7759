"""Approximate nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentrylens.llm.common import arrow_rows, staged

K = 10
TABLES = 8
#: Bounds of the fit: rows it samples, queries it solves exactly, and the recall it aims at.
SAMPLE_ROWS = 2048
CALIBRATION_QUERIES = 64
TARGET_RECALL = 0.95
SEED = 7
#: The grid of the fit: functions in a table, cell width in typical neighbour distances, probes.
FUNCTIONS = (6, 8, 12)
WIDTHS = (0.7, 1.0, 1.5, 2.2)
PROBES = (8, 16, 24, 32, 48, 64, 100, 150, 200)
#: Entries or queries of a bucket that are handled at once; larger buckets are cut in slices.
SLICE = 1000
#: Cell widths, in fitted ones, that a query goes through until its neighbours lie within reach.
NESTED = (1.0, 2.0, 4.0, 8.0)
#: Calibration neighbours that are judged together, nearest first, and the recall that ends the reach.
GROUP, LEAST_RECALL = 32, 0.85


@dataclass(frozen=True)
class Hashing:
    """``tables`` groups of functions floor((a v + b) / width), a from a normal distribution.

    ``reach`` is the distance up to which the probes were seen to find neighbours.
    """

    directions: np.ndarray  # tables x functions x dimensions
    shifts: np.ndarray  # tables x functions
    width: float
    probes: int
    reach: float = float("inf")

    def wider(self, times: float) -> Hashing:
        """The same functions in larger cells; distances scale with them."""
        return replace(self, width=self.width * times, reach=self.reach * times)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each vector in each table and function, and the place within it (0 to 1)."""
        at = np.einsum("nd,lmd->nlm", x, self.directions) / self.width + self.shifts
        cell = np.floor(at)
        return cell.astype(np.int64), at - cell


def bucket_keys(cells: np.ndarray) -> np.ndarray:
    """One 64-bit key for the cells of a table (last axis: functions); the table is part of it."""
    key = np.zeros(cells.shape[:-1], dtype=np.uint64) + np.arange(cells.shape[1], dtype=np.uint64)[None, :] + np.uint64(1)
    for m in range(cells.shape[-1]):
        key = (key ^ cells[..., m].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def perturbations(inside: np.ndarray, probes: int) -> list[list[tuple[int, int]]]:
    """The first ``probes`` sets of cell changes in order of estimated success.

    Moving function ``m`` down costs the squared distance to its lower border, moving it up
    that to its upper one; a set costs the sum, and may not move one function both ways. Sets
    come off a heap that starts with the cheapest move and grows by shifting or extending.
    """
    moves = sorted([(f * f, m, -1) for m, f in enumerate(inside)] + [((1 - f) ** 2, m, 1) for m, f in enumerate(inside)])
    out: list[list[tuple[int, int]]] = [[]]
    heap = [(moves[0][0], (0,))]
    while heap and len(out) < probes:
        cost, chosen = heapq.heappop(heap)
        if len({moves[i][1] for i in chosen}) == len(chosen):
            out.append([moves[i][1:] for i in chosen])
        last = chosen[-1]
        if last + 1 < len(moves):
            heapq.heappush(heap, (cost - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + moves[last + 1][0], (*chosen, last + 1)))
    return out


def probe_keys(h: Hashing, x: np.ndarray) -> list[np.ndarray]:
    """For each query: tables x probes keys, in the order of estimated success."""
    cells, inside = h.place(x)
    out = []
    for c, f in zip(cells, inside):
        probed = np.repeat(c[None], h.probes, axis=0)
        for t in range(c.shape[0]):
            for p, moves in enumerate(perturbations(f[t], h.probes)):
                for m, step in moves:
                    probed[p, t, m] += step
        out.append(bucket_keys(probed))
    return out


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def nearest(queries: np.ndarray, ids: np.ndarray, x: np.ndarray, own: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """Exact nearest rows of a block for each query, in blocks of queries."""
    found = []
    for q, me in zip(queries, own):
        d = np.sqrt(((x - q) ** 2).sum(axis=1))
        keep = np.flatnonzero(ids != me)
        if len(keep) > k:
            cut = np.partition(d[keep], k - 1)[k - 1]
            keep = keep[d[keep] <= cut]
        order = keep[np.lexsort((ids[keep], d[keep]))][:k]
        found.append([(float(d[i]), int(ids[i])) for i in order])
    return found


def usable(vector: Column) -> Column:
    """Vectors with components, all finite, and not all zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def fit(vectors: DataFrame, k: int = K) -> Hashing | None:
    """Choose the number of functions, the cell width and the probes from the data.

    A bounded sample of rows gives the spread of distances. For a bounded set of calibration
    queries the exact neighbours among all rows are found by one blocked pass (only
    ``CALIBRATION_QUERIES`` x ``k`` rows reach the driver). Over a grid, the setting
    that finds ``TARGET_RECALL`` of these neighbours with the fewest sampled candidates is taken.
    """
    by_hash = vectors.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(SAMPLE_ROWS).collect()
    if not by_hash:
        return None
    sample = np.array([r["embedding"] for r in by_hash], dtype=np.float64)
    ids = np.array([r["vec_id"] for r in by_hash])
    queries, own = sample[:CALIBRATION_QUERIES], ids[:CALIBRATION_QUERIES]

    def block(batch: pa.RecordBatch) -> dict[str, list]:
        x, block_ids = matrix(batch.column(1)), batch.column(0).to_numpy()
        hits = nearest(queries, block_ids, x, own, k)
        at = {int(v): i for i, v in enumerate(block_ids)}
        rows = [(q, d, v) for q, hit in enumerate(hits) for d, v in hit]
        return {
            "q": [r[0] for r in rows],
            "d": [r[1] for r in rows],
            "vec_id": [r[2] for r in rows],
            "x": [x[at[r[2]]].tolist() for r in rows],
        }

    first = Window.partitionBy("q").orderBy("d", "vec_id")
    near = (
        arrow_rows(vectors.select("vec_id", "embedding"), block, "q int, d double, vec_id long, x array<double>")
        .withColumn("at", F.row_number().over(first))
        .filter(F.col("at") <= k)
        .collect()
    )
    if not near:
        return Hashing(np.zeros((1, 1, sample.shape[1])), np.zeros((1, 1)), 1.0, 1)
    hits = np.array([r["x"] for r in near])
    typical = float(np.median([r["d"] for r in near])) or float(np.linalg.norm(sample, axis=1).mean()) or 1.0
    rng = np.random.default_rng(SEED)
    best, choice = None, None
    for functions in FUNCTIONS:
        directions = rng.standard_normal((TABLES, functions, sample.shape[1]))
        shifts = rng.random((TABLES, functions))
        for width in WIDTHS:
            widest = Hashing(directions, shifts, width * typical, max(PROBES))
            probed = probe_keys(widest, queries)
            owners = bucket_keys(widest.place(hits)[0])
            buckets = bucket_keys(widest.place(sample)[0])
            for probes in PROBES:
                recall = np.mean([np.isin(owners[i], probed[r["q"]][:probes]).any() for i, r in enumerate(near)])
                if recall < TARGET_RECALL and best is not None and best <= (True, -recall):
                    continue
                share = np.mean([np.isin(buckets, keys[:probes]).any(axis=1).mean() for keys in probed[:16]])
                mark = (recall < TARGET_RECALL, share if recall >= TARGET_RECALL else -recall)
                if best is None or mark < best:
                    hit = [bool(np.isin(owners[i], probed[r["q"]][:probes]).any()) for i, r in enumerate(near)]
                    best, choice = mark, Hashing(directions, shifts, width * typical, probes, reach_of([r["d"] for r in near], hit))
    return choice


def reach_of(distances: list[float], hit: list[bool]) -> float:
    """The distance up to which neighbours are found: the first group, by distance, of too few hits ends it."""
    order = np.argsort(distances, kind="stable")
    d, hit = np.array(distances)[order], np.array(hit)[order]
    for i in range(0, len(d), GROUP):
        if hit[i : i + GROUP].mean() < LEAST_RECALL:
            return float(d[i - 1]) if i else 0.0
    return float(d[-1])


def multiprobe_search(
    df: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest rows found for every row where ``queries`` holds, by Euclidean distance.

    Every row is indexed. Equal vectors are one entry: of a vector only its ``k`` + 1 smallest
    ids can be answers, and they are cut to that per task before they are shuffled, so a vector that a
    third of the rows share is not a hot bucket. Entries and queries meet by equality of bucket
    keys (the table is part of the key), in blocks: a bucket with many entries or queries is cut
    in slices. The candidates of all tables are measured in double precision on the original vectors, cut to
    the best of each task, and merged in the final ranking.

    The fit is to typical rows. A query that finds fewer than ``k`` rows, or whose last one is farther than
    the fitted cells reach, goes on in cells twice, four and eight times as wide, where the same probes reach as
    much farther; what is left then (rows far from all others, and tables of hardly ``k`` rows) meets all entries, in blocks.

    Result: ``query_id, rank, vec_id, score``; ties go to the smaller id; a query has fewer than ``k`` rows only
    where the table has fewer candidates. Vectors that are null, zero or hold null or
    non-finite components are neither queries nor candidates. Rows with a null id are left out; rows that repeat
    an id and vector count once. All vectors have one length. An empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = df.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    asked = rows.filter(queries).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("query")).distinct()
    same = Window.partitionBy("embedding").orderBy("vec_id")
    entries = staged(
        rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
        .withColumn("_at", F.dense_rank().over(same))
        .filter(F.col("_at") <= k + 1)
        .groupBy("embedding")
        .agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    )
    h = fit(entries.select(F.element_at("ids", 1).alias("vec_id"), "embedding"), k)
    if h is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def blocks(side: DataFrame, name: str, item: str) -> DataFrame:
        """The rows of a bucket in lists of about ``SLICE``."""
        large = side.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SLICE)
        cut = large.select(F.col("key").alias("_key"), F.ceil(F.col("n") / SLICE).alias("slices"))
        return (
            side.join(cut, F.col("key") == F.col("_key"), "left")
            .withColumn("slice", F.pmod(F.xxhash64(item), F.coalesce("slices", F.lit(1))))
            .groupBy("key", "slice")
            .agg(F.collect_list(F.struct(item, "x")).alias(name))
            .drop("slice")
        )

    def measure(batch: pa.RecordBatch) -> dict[str, list]:
        """Distances within buckets; of each query the nearest ids of the whole batch."""
        out: dict[int, list[tuple[float, int]]] = {}
        for i in range(batch.num_rows):
            asked_ids, ids = (np.array(batch.column(c)[i].as_py() if c == 0 else [x[0] for x in batch.column(c)[i].as_py()]) for c in (0, 2))
            lists = batch.column(2)[i].as_py()
            q = batch.column(1)[i].values.to_numpy().reshape(len(asked_ids), -1)
            x = batch.column(3)[i].values.to_numpy().reshape(len(ids), -1)
            for me, vector in zip(asked_ids.tolist(), q):
                d = np.sqrt(((x - vector) ** 2).sum(axis=1))
                near = np.flatnonzero(d <= np.partition(d, min(k, len(d) - 1))[min(k, len(d) - 1)])
                out.setdefault(me, []).extend((float(d[j]), v) for j in near for v in lists[j] if v != me)
        rows = [(me, d, v) for me, found in out.items() for d, v in sorted(set(found))[:k]]
        return {"query_id": [r[0] for r in rows], "score": [r[1] for r in rows], "vec_id": [r[2] for r in rows]}

    best = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def ranked(near: DataFrame) -> DataFrame:
        return near.withColumn("rank", F.dense_rank().over(best)).filter(F.col("rank") <= k).distinct()

    def meet(asking: DataFrame, indexed: DataFrame) -> DataFrame:
        """The nearest rows among those with the key of a query."""
        met = blocks(asking, "asked", "id").join(blocks(indexed, "found", "ids"), "key").select(
            F.col("asked.id").alias("id"), F.flatten("asked.x").alias("q"), F.col("found.ids").alias("ids"), F.flatten("found.x").alias("x")
        )
        return arrow_rows(met, measure, "query_id long, score double, vec_id long")

    def probed(h: Hashing, asked: DataFrame) -> DataFrame:
        def index(batch: pa.RecordBatch) -> dict[str, list]:
            keys = bucket_keys(h.place(matrix(batch.column(1)))[0])
            at = np.repeat(np.arange(len(keys)), keys.shape[1])
            return {"key": keys.ravel(), "ids": batch.column(0).take(pa.array(at)), "x": batch.column(1).take(pa.array(at))}

        def ask(batch: pa.RecordBatch) -> dict[str, list]:
            keys = [np.unique(x) for x in probe_keys(h, matrix(batch.column(1)))]
            at = pa.array(np.repeat(np.arange(len(keys)), [len(x) for x in keys]))
            return {"key": np.concatenate(keys), "id": batch.column(0).take(at), "x": batch.column(1).take(at)}

        asking = staged(arrow_rows(asked.select("query_id", "query"), ask, "key long, id long, x array<double>"))
        indexed = staged(
            arrow_rows(entries.select("ids", "embedding"), index, "key long, ids array<long>, x array<double>").join(
                asking.select("key").distinct(), "key", "left_semi"
            )
        )
        return meet(asking, indexed)

    def exact(asked: DataFrame, n: int) -> DataFrame:
        """Every entry, against blocks of the queries that are left."""
        parts = -(-n // SLICE)
        asking = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("key"), F.col("query_id").alias("id"), F.col("query").alias("x"))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
        return meet(asking, entries.select(every.alias("key"), "ids", F.col("embedding").alias("x")))

    found = None
    for times in NESTED:
        cells = h.wider(times)
        near = probed(cells, asked)
        found = staged(ranked(near if found is None else found.drop("rank").unionByName(near)))
        settled = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("last"))
        settled = settled.filter((F.col("n") >= k) & (F.col("last") <= cells.reach)).select("query_id")
        asked = staged(asked.join(settled, "query_id", "left_anti"))
        left = asked.count()
        if not left:
            break
    else:
        found = ranked(found.drop("rank").unionByName(exact(asked, left)))
    return found.select("query_id", "rank", "vec_id", "score")
