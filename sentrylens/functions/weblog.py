"""HTTP access lines, URL structure and identity codes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sentrylens.functions import constants as C
from sentrylens.functions.flags import text_or_empty
from sentrylens.session import staged

ACCESS_LINE = (
    r"^(\S+) \S+ \S+ \[([^\]]+)\] \"(\S+) (\S+) ([^\"]+)\" (\d+) (\S+) \"([^\"]*)\" \"([^\"]*)\""
)
ACCESS_LINE_VHOST = (
    r"^(?:\S+\s+)?(\S+) \S+ \S+ \[([^\]]+)\] \"(\S+)(?:\s+(\S+)\s+(\S+))?\" (\d+) (\S+)"
    r" \"([^\"]*)\" \"([^\"]*)\""
)
FIELDS = ("ip", "time", "method", "path", "proto", "status", "size", "referrer", "agent")


def parse_access_line(line: Column, vhost: bool = False) -> Column:
    """PRJ23: fields of an access line as a struct, null where the line does not match."""
    pattern = ACCESS_LINE_VHOST if vhost else ACCESS_LINE
    parts = F.struct(*[F.regexp_extract(line, pattern, i + 1).alias(f) for i, f in enumerate(FIELDS)])
    return F.when(line.rlike(pattern), parts)


def char_entropy(text: Column) -> Column:
    """PRJ25: Shannon entropy (bits) of the characters of a text; 0 for empty text.

    -sum(p log2 p) = log2(n) - sum(c log2 c) / n, summed over distinct characters, which one
    pass over the text counts.
    """
    return _entropies(text_or_empty(text))


@F.pandas_udf(DoubleType())
def _entropies(texts: pd.Series) -> pd.Series:
    return texts.map(_entropy).astype(float)


def _entropy(text: str) -> float:
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    n = len(codes)
    if not n:
        return 0.0
    counts = np.bincount(codes) if codes.max() < 1 << 16 else np.unique(codes, return_counts=True)[1]
    counts = counts[counts > 0]
    return float(np.log2(n) - (counts * np.log2(counts)).sum() / n)


def extension_class(path: Column) -> Column:
    """Part of PRJ24: class of the last path element's extension."""
    base = F.element_at(F.split(path, "/"), -1)
    extension = F.lower(F.element_at(F.split(base, r"\."), -1))
    known = F.create_map(
        *[F.lit(x) for cls, members in C.EXTENSION_CLASSES.items() for m in members for x in (m, cls)]
    )
    return (
        F.when(~base.contains("."), "none")
        .when(extension == "", "none")
        .otherwise(F.coalesce(F.try_element_at(known, extension), F.lit("other")))
    )


def url_features(path: Column, status: Column, method: Column) -> dict[str, Column]:
    """PRJ24: structural tier of a request path."""
    stripped = F.regexp_replace(path, r"^/+|/+$", "")
    slashes = F.length(stripped) - F.length(F.replace(stripped, F.lit("/"), F.lit("")))
    kind = extension_class(path)
    return {
        "path_depth": F.when(stripped == "", 0).otherwise(slashes + 1).cast("long"),
        "path_length": F.length(path).cast("long"),
        "path_entropy": char_entropy(path),
        "ext_class": kind,
        "has_extension": (kind != "none").cast("long"),
        "is_dotfile": path.startswith("/.").cast("long"),
        "has_query": path.contains("?").cast("long"),
        "status_code": status.try_cast("long"),
        "is_get": (method == "GET").cast("long"),
    }


def fit_codes(train: DataFrame, column: str, code: str = "code") -> DataFrame:
    """PRJ26: value -> code, by rank of the sorted train values.

    The values are range-partitioned by the text itself; a value's rank is its rank within
    its part plus the sizes of the parts before it.
    """
    values = train.filter(F.col(column).isNotNull()).select(column).distinct()
    parts = staged(values.repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(
        F.col("_part").alias("_of"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before")
    )
    in_part = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return (
        parts.withColumn("_at", in_part)
        .join(before, F.col("_part") == F.col("_of"))
        .select(column, (F.col("_before") + F.col("_at")).alias(code))
    )


def apply_codes(df: DataFrame, codes: DataFrame, column: str, code: str = "code") -> DataFrame:
    """PRJ26: attach the code, -1 for values unseen in train."""
    return df.join(codes, column, "left").withColumn(code, F.coalesce(F.col(code), F.lit(-1)))
