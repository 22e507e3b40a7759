"""Removal of repeated runs of lines by winnowed line fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sentrylens.llm.common import arrow_rows, mix64, staged

#: Lines of the shortest run that counts as repeated; also the window of the fingerprints.
WINDOW = 3
BLANK = " \t\r"


def line_hashes(text: str) -> tuple[list[int], list[int]]:
    """Hash and number of each line that is not blank; blanks at its ends do not count."""
    hashes, at = [], []
    for i, line in enumerate(text.split("\n")):
        if line := line.strip(BLANK):
            hashes.append(int.from_bytes(hashlib.blake2b(line.encode("utf-8"), digest_size=8).digest(), "little", signed=True))
            at.append(i)
    return hashes, at


def winnowed(lines: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of lines: hash of its lines, its fingerprint (the leftmost smallest
    line hash), and whether the fingerprint's position is met for the first time."""
    n = len(lines) - window + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    views = np.lib.stride_tricks.sliding_window_view(lines, window)
    at = views.argmin(axis=1)
    place = np.arange(n) + at
    whole = np.zeros(n, dtype=np.uint64)
    for i in range(window):
        whole = mix64(whole * np.uint64(0x9E3779B97F4A7C15) + views[:, i].astype(np.uint64) + np.uint64(i))
    return whole.view(np.int64), lines[place], np.concatenate([[True], place[1:] != place[:-1]])


def line_dedup(
    df: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Remove each line of a run of ``window`` lines that occurs at an earlier place.

    ``doc_id, n_lines, n_removed, n_runs, kept``: ``kept`` is the text of the lines that stay.
    ``carry`` names columns of ``df`` to bring along (others are left out, whatever their names). Places are ordered by
    id, then line; so the first occurrence stays. Blank lines are skipped in runs and stay.

    The smallest line hash of every window is a fingerprint, so two equal runs have equal
    fingerprints. Fingerprints are counted; windows whose fingerprint occurs at several places are
    grouped by the hash of their lines, and those later than the first equal one are deleted.
    This replaces joining positions and extending matches both ways: a longer match is the union of its
    windows, so the same lines go without pairs of places. Repeats of fewer than ``window`` lines stay. A frequent fingerprint is one row on the counted side of its
    joins, and its places are split by the skew join; no pairs of places are formed. All this
    works on line hashes; the texts are read once more, to cut them.

    A null text is empty: one line, nothing removed. Rows with a null id are kept whole. Ids
    must differ: of rows that share one, both lose what either repeats. An empty table gives an
    empty result.
    """
    whole = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *[F.col(c) for c in carry],
    )
    docs = whole.select("doc_id", "text")

    def windows(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {name: [] for name in ("doc_id", "at", "run", "fingerprint", "opens")}
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            hashes, at = line_hashes(text)
            run, fingerprint, opens = winnowed(np.array(hashes, dtype=np.int64), window)
            out["doc_id"] += [doc] * len(run)
            out["at"] += [at[i : i + window] for i in range(len(run))]
            out["run"] += run.tolist()
            out["fingerprint"] += fingerprint.tolist()
            out["opens"] += opens.tolist()
        return out

    placed = staged(
        arrow_rows(
            docs.filter("doc_id is not null"), windows,
            "doc_id long, at array<int>, run long, fingerprint long, opens boolean",
        )
    )
    shared = placed.filter("opens").groupBy(F.col("fingerprint").alias("_print")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    extended = placed.join(shared, F.col("fingerprint") == F.col("_print")).select("doc_id", "at", "run")
    first = extended.groupBy(F.col("run").alias("_run")).agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
    later = extended.join(first.filter("n > 1"), F.col("run") == F.col("_run")).filter(
        F.struct("doc_id", "at") > F.col("first")
    )
    gone = later.groupBy(F.col("doc_id").alias("_doc_id")).agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("gone"))

    def cut(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {name: [] for name in ("n_lines", "n_removed", "n_runs", "kept")}
        for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            lines, lost = text.split("\n"), set(gone or ())
            kept = "\n".join(x for i, x in enumerate(lines) if i not in lost)
            row = (len(lines), len(lost), sum(i - 1 not in lost for i in lost), kept)
            for name, v in zip(out, row):
                out[name].append(v)
        return {"doc_id": batch.column(0), **out, **{c: batch.column(3 + i) for i, c in enumerate(carry)}}

    schema = StructType.fromDDL("doc_id long, n_lines long, n_removed long, n_runs long, kept string")
    for c in carry:
        schema = schema.add(c, df.schema[c].dataType)
    joined = whole.join(gone, F.col("doc_id") == F.col("_doc_id"), "left")
    return arrow_rows(joined.select("doc_id", "text", "gone", *carry), cut, schema)


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, i, line, trim(line, ' ' || chr(9) || chr(13)) AS plain FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
filled AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r, plain FROM lines WHERE plain <> ''),
runs AS (
  SELECT doc_id, r, [plain, lead(plain) OVER w, lead(plain, 2) OVER w] AS run FROM filled
  WINDOW w AS (PARTITION BY doc_id ORDER BY r) QUALIFY lead(plain, 2) OVER w IS NOT NULL),
later AS (
  SELECT doc_id, r FROM runs QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, r) > 1),
gone AS (
  SELECT DISTINCT f.doc_id, f.i FROM later l JOIN filled f ON f.doc_id = l.doc_id AND f.r BETWEEN l.r AND l.r + {WINDOW - 1}),
marked AS (
  SELECT l.doc_id, l.i, l.line, g.i IS NOT NULL AS lost FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_removed,
       count(*) FILTER (lost AND NOT before) AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM (SELECT *, coalesce(lag(lost) OVER (PARTITION BY doc_id ORDER BY i), false) AS before FROM marked) GROUP BY doc_id"""
