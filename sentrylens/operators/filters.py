"""Predicates, populations and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylens.functions import constants as C
from sentrylens.operators.labels import open_windows
from sentrylens.operators.rounds import buffer_windows

SECOND = 1_000_000


def in_range(time: Column, start: int | None, end: int | None) -> Column:
    """FLT1: closed range; without both ends everything passes."""
    if start is None or end is None:
        return F.lit(True)
    return time.between(start, end)


def outside_margin(
    df: DataFrame, windows: DataFrame, by: Sequence[str], margin_s: int = 3600, time: str = "us", **kw
) -> DataFrame:
    """FLT2: rows further than the margin from every window of their key."""
    wide = buffer_windows(windows.select(*by, "start_us", "end_us"), margin_s)
    return open_windows(df, wide, by, time, out="_near", **kw).filter("_near = 0").drop("_near")


def rule_family(rule: Column) -> Column:
    """FLT3: known, incidental, discriminative or other; fixed rule sets, no join."""
    return (
        F.when(rule.isin(*C.KNOWN_RULES), "known")
        .when(rule.isin(*C.INCIDENTAL_RULES), "incidental")
        .when(rule.isin(*C.EXPECTED_TECHNIQUES), "discriminative")
        .otherwise("other")
    )


def detector(rule: Column, embedded: str = "86601") -> Column:
    """FLT4: alerts of the embedded network detector against native ones."""
    return F.when(rule == embedded, "network").otherwise("native")


def exclude_warmup(df: DataFrame, scenario: str, time: str, hours: float = 12) -> DataFrame:
    """FLT5: drop the first hours since the scenario's first alert."""
    first = df.groupBy(scenario).agg(F.min(time).alias("_first"))
    late = F.col(time) >= F.col("_first") + int(hours * 3600 * SECOND)
    return df.join(first, scenario).filter(late).drop("_first")


def provenance(techniques: Sequence[str]) -> Column:
    """FLT6: attack alerts inside the process tree with one of the techniques."""
    return (F.col("label") == "attack") & F.col("in_tree") & F.col("technique").isin(*techniques)


def pivot_subset(pivot: Column) -> Column:
    """FLT7: rows whose pivot is present and whose label is certain."""
    return pivot.isNotNull() & (F.col("label") != "uncertain")


def rule_novelty(df: DataFrame, rule: str, seen: DataFrame, seen_in_attack: DataFrame) -> DataFrame:
    """FLT8: rules known from attacks, known at all, or novel."""
    every = seen.select(F.col("id").alias(rule), F.lit(True).alias("_all"))
    attack = seen_in_attack.select(F.col("id").alias(rule), F.lit(True).alias("_atk"))
    joined = df.join(every, rule, "left").join(attack, rule, "left")
    return joined.withColumn(
        "novelty",
        F.when(F.col("_atk"), "in_attack").when(F.col("_all"), "in_all").otherwise("novel"),
    ).drop("_all", "_atk")


def first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """FLT9: one row per key, the first in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def by_event_time(df: DataFrame, time: str, row_id: str) -> DataFrame:
    """SRT1: event-time order, row number for ties, rows without time last."""
    return df.orderBy(F.col(time).asc_nulls_last(), F.col(row_id))


def union_tagged(parts: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """SET1: collections under one another, each with its name."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [df.withColumn(tag, F.lit(name)) for name, df in parts.items()],
    )


def set_difference(found: DataFrame, published: DataFrame, key: str, volume: str = "n") -> DataFrame:
    """SET2: per key whether it is missing, extra, or equal in volume or not."""
    both = found.select(key, F.col(volume).alias("_f"), F.lit(None).cast("long").alias("_p")).unionByName(
        published.select(key, F.lit(None).cast("long").alias("_f"), F.col(volume).alias("_p"))
    )
    f, p = F.col("n_found"), F.col("n_published")
    return both.groupBy(key).agg(F.sum("_f").alias("n_found"), F.sum("_p").alias("n_published")).withColumn(
        "status",
        F.when(f.isNull(), "missing").when(p.isNull(), "extra").when(f == p, "match").otherwise("volume differs"),
    )


def inherit_verdict(
    alerts: DataFrame, windows: DataFrame, source: str, time: str = "us", minutes: int = 10
) -> DataFrame:
    """JN12: alerts take the verdict of their grid window; null without one."""
    width = minutes * 60
    bucket = (F.floor(F.col(time) / (width * SECOND)) * width).alias("bucket_s")
    return alerts.select("*", bucket).join(
        windows.select(source, "bucket_s", F.col("pred").alias("inherited")), [source, "bucket_s"], "left"
    )


def align_by_row(features: DataFrame, labels: DataFrame, row_id: str) -> DataFrame:
    """JN13: features and labels side by side by row number."""
    return features.join(labels, row_id)


def alignment_gaps(features: DataFrame, labels: DataFrame, row_id: str) -> DataFrame:
    """JN13: the check behind it: rows that only one side has, as counts."""
    sides = features.select(row_id, F.lit(1).alias("_f"), F.lit(0).alias("_l")).unionByName(
        labels.select(row_id, F.lit(0).alias("_f"), F.lit(1).alias("_l"))
    )
    per_row = sides.groupBy(row_id).agg(F.sum("_f").alias("f"), F.sum("_l").alias("l"))
    return per_row.agg(
        F.count_if((F.col("f") == 1) & (F.col("l") == 1)).alias("aligned"),
        F.count_if(F.col("f") != F.col("l")).alias("unaligned"),
    )
