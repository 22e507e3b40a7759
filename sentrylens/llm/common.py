"""What several corpus operators share: readers, Arrow tasks, repeated keys, link classes."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sentrylens.session import bucketed as _bucketed
from sentrylens.session import cut_lineage, release
from sentrylens.session import staged as _staged

__all__ = [
    "arrow_rows",
    "bounded_sample",
    "bucketed",
    "components",
    "cut_lineage",
    "empty_if_null",
    "kept_by_workers",
    "let_go",
    "mix64",
    "release",
    "staged",
    "table",
    "utf8",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to a shared table, and let go of the shuffle files that led to it.

    Spark drops the files of a shuffle when its driver collects the plan as garbage; a driver
    with memory to spare may never do so while an operator of many steps fills the disks.
    """
    out = _staged(df)
    collect_garbage(df.sparkSession)
    return out


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``staged``, for a table that joins on ``key`` read without moving it."""
    out = _bucketed(df, key)
    collect_garbage(df.sparkSession)
    return out


def collect_garbage(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def empty_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8")


_KEPT: list[Callable] = []


def kept_by_workers(make: Callable) -> Callable:
    """``make``, whose last result a worker keeps for its next tasks, until ``let_go``."""
    _KEPT.append(found := lru_cache(maxsize=1)(make))
    return found


def let_go(but: Callable | None = None) -> None:
    """Drop what earlier tasks keep in this worker, except the results of ``but``.

    Spark hands workers from stage to stage and from job to job, so that what an operator keeps would
    stand beside the memory of all later ones.
    """
    others = [f for f in _KEPT if f is not but and f.cache_info().currsize]
    for f in others:
        f.cache_clear()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()


def arrow_rows(
    df: DataFrame,
    rows: Callable[[pa.RecordBatch], dict[str, list] | None],
    schema: str | StructType,
    keeps: Callable | None = None,
) -> DataFrame:
    """``df`` through a function from one Arrow batch to columns of ``schema``.

    ``keeps`` is what ``rows`` uses of ``kept_by_workers``; the rest is let go.

    Batches are cut by size as well as by row count, so that a run of very long texts does
    not fill a worker.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark_schema = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        let_go(keeps)
        kinds = to_arrow_schema(spark_schema)
        for batch in batches:
            if batch.num_rows and (out := rows(batch)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kinds], schema=kinds)

    return df.mapInArrow(run, spark_schema)


def bounded_sample(df: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` rows of each ``label``, the first by a hash of ``doc_id``.

    The labels are counted first (one number each reaches the driver), and rows whose hash is
    too large to be among the first are dropped where they are read; so what a task ranks
    follows ``rows``, not the table. Labels and ids that are null take no part.
    """
    usable = df.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    counts = {r[label]: r["count"] for r in usable.select(label).groupBy(label).count().collect()}
    if not counts:
        return usable.limit(0)
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    shares = [x for k, n in counts.items() for x in (F.lit(k), F.lit((2 * rows + 100) / n * (1 << 30)))]
    first = Window.partitionBy(label).orderBy(at, "doc_id", *[c for c in ("text",) if c in df.columns])
    return (
        usable.filter(at < F.create_map(*shares)[F.col(label)])
        .withColumn("_at", F.row_number().over(first))
        .filter(F.col("_at") <= rows)
        .drop("_at")
    )


def mix64(h: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest node reachable from each node of an edge list: ``node``, ``component``.

    Alternates two star contractions: every node hands its smallest neighbour to its larger
    ones, then to its smaller ones. Each round is a map-side combined minimum and a join,
    and is checkpointed; the number of rounds grows with the logarithm of the node count.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    star = cut_lineage(
        edges.select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo"))
        .filter("hi <> lo")
        .distinct()
    )

    def contract(pairs: DataFrame, larger: bool) -> DataFrame:
        """Each node hands its smallest neighbour to its larger (or all smaller) neighbours."""
        if larger:
            both = pairs.select(F.col("hi").alias("v"), F.col("lo").alias("u")).union(
                pairs.select(F.col("lo").alias("v"), F.col("hi").alias("u"))
            )
        else:
            both = pairs.select(F.col("hi").alias("v"), F.col("lo").alias("u"))
        least = both.groupBy(F.col("v").alias("w")).agg(F.min("u").alias("m"))
        met = both.join(least, F.col("v") == F.col("w"))
        m = F.least("m", "v")
        if larger:
            out = met.filter("u > v").select(F.col("u").alias("hi"), m.alias("lo"))
        else:
            out = met.select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("hi"), F.col("m").alias("lo"))
        return out.filter("hi <> lo").distinct()

    mark = None
    while True:
        star = cut_lineage(contract(contract(star, larger=True), larger=False))
        now = star.agg(
            F.count(F.lit(1)), F.countDistinct("hi"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
        ).first()
        if now == mark:
            break
        mark = now
    return star.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))

