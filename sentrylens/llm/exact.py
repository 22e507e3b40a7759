"""Exact duplicates with a heavy-hitter split."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylens.llm.common import empty_if_null, staged

COUNTERS = 256


def misra_gries(counts: Counter, counters: int) -> Counter:
    """Reduce a summary to ``counters`` entries: all lose what the first one left out has."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return Counter({k: n - cut for k, n in counts.items() if n > cut})


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` digests, among them each with over a ``counters``-th of the rows.

    Every task keeps one summary of ``counters`` entries; the summaries are added and cut
    once more, which keeps the bound of a single one.
    """

    def summary(batches):
        kept: Counter = Counter()
        for batch in batches:
            values, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            for v, k in zip(values.tolist(), n.tolist()):
                kept[v] += k
            kept = misra_gries(kept, counters)
        yield pa.RecordBatch.from_pydict(
            {"digest": pa.array(list(kept), pa.string()), "n": pa.array(list(kept.values()), pa.int64())}
        )

    merged = digests.select("digest").mapInArrow(summary, "digest string, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    return merged.filter("n > 1").orderBy(F.desc("n"), "digest").limit(counters).select("digest")


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """One row per row of ``df``: which row of its equal texts stays (the largest id).

    A summary of frequent digests names up to ``counters`` candidates. These are counted
    exactly (``winners``) and broadcast: their rows are decided where they are read and never
    shuffled. The other digests, none of which can hold more than about a ``counters``-th of
    the rows, are grouped and joined back.

    A null text counts as empty, so null and empty texts are one group. A null id is below
    every id. Rows that share id and text are repeats of one row and get the same answer. An
    empty table gives an empty result; further columns of ``df`` are ignored, whatever their
    names.
    """
    digests = staged(
        df.select(F.col(id_col).alias("doc_id"), F.sha2(empty_if_null(F.col(text_col)), 256).alias("digest"))
    )
    winners = staged(
        digests.join(F.broadcast(frequent_digests(digests, counters)), "digest")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    seen = digests.join(F.broadcast(winners), "digest", "left")
    rest = seen.filter("group_size is null").select("doc_id", "digest")
    groups = rest.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    found = seen.filter("group_size is not null").unionByName(rest.join(groups, "digest"))
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
