"""Fill-in-middle: texts cut at code points found by word-parallel byte arithmetic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylens.llm.common import arrow_rows

MARKS = ("<P>", "<S>", "<M>")
ONES = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x8080808080808080)


class Units:
    """Code points of a run of UTF-8 bytes, eight bytes at a time.

    Bit 0 of every byte of ``ends`` is set where a code point ends, that is where the next byte
    is no continuation byte; ``before`` counts the ends in front of each 8-byte word.
    """

    def __init__(self, data: np.ndarray):
        padded = np.zeros((len(data) // 8 + 2) * 8, dtype=np.uint8)
        padded[: len(data)] = data
        words = padded.view("<u8")
        first = (~(words >> np.uint64(7)) | (words >> np.uint64(6))) & ONES
        following = np.append(first[1:], ONES)
        self.ends = (first >> np.uint64(8)) | (following << np.uint64(56))
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that end in front of byte ``at``."""
        word, inside = at >> 3, (at & 7).astype(np.uint64)
        low = (np.uint64(1) << (inside * np.uint64(8))) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.ends[word] & low)

    def select(self, unit: np.ndarray) -> np.ndarray:
        """The byte behind the ``unit``-th code point, counted from 1.

        The word is found in the cumulative counts. Within it, the product with ``ONES`` turns
        marks into running counts, and one subtraction compares all eight with the count sought.
        """
        word = np.searchsorted(self.before, unit, "left") - 1
        sought = (unit - self.before[word]).astype(np.uint64)
        running = self.ends[word] * ONES
        reached = ((running | HIGH) - sought * ONES) & HIGH
        return 8 * word + 9 - np.bitwise_count(reached)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one run, and the place of each row in it."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def fill_in_middle(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: str = "1",
    marks: tuple[str, str, str] = MARKS,
    plain_percent: int = 10,
    spm_percent: int = 20,
) -> DataFrame:
    """Move a middle part of each text to its end: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    ``n`` counts code points. The first four 32-bit groups of the SHA-256 of ``seed:id`` draw the two
    cuts (remainders by n + 1, the smaller ends the prefix and the larger the middle), the ``plain_percent``
    of texts that stay as they are, and the ``spm_percent`` of the rest whose suffix comes first.
    ``marks`` stand before prefix, suffix and middle: ``psm`` is prefix, suffix, middle; ``spm`` is suffix, prefix,
    middle; ``plain`` is the text. A text that is empty or holds a mark stays plain, with null parts.

    A projection: no shuffle, memory follows the batch. A null text is empty, a null id hashes as
    nothing behind the colon; repeated ids and rows stay; further columns are ignored; an empty
    table gives an empty result.
    """
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring("drawn", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), drawn.alias("drawn"))
    prefix_mark, suffix_mark, middle_mark = (m.encode() for m in marks)

    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        h1, h2, h3, h4 = (batch.column(2 + i).to_numpy() for i in range(4))
        data, at = text_bytes(batch.column(1))
        units = Units(data)
        before = units.rank(at)
        n = np.diff(before)
        plain = (n == 0) | (h3 % 100 >= 100 - plain_percent)
        for mark in marks:
            plain |= pc.fill_null(pc.match_substring(batch.column(1), mark), False).to_numpy(zero_copy_only=False)
        spm = h4 % 100 < spm_percent
        draws = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
        cuts = [np.where(c == 0, at[:-1], units.select(np.maximum(before[:-1] + c, 1))) for c in draws]
        whole = data.tobytes()
        output = []
        for alone, first, start, a, b, end in zip(plain, spm, at[:-1].tolist(), *(c.tolist() for c in cuts), at[1:].tolist()):
            if alone:
                output.append(whole[start:end])
                continue
            prefix, suffix = prefix_mark + whole[start:a], suffix_mark + whole[b:end]
            output.append((suffix + prefix if first else prefix + suffix) + middle_mark + whole[a:b])
        gone = plain.astype(bool)
        return {
            "doc_id": batch.column(0),
            "n": n,
            "form": np.where(gone, "plain", np.where(spm, "spm", "psm")),
            "prefix_chars": pa.array(draws[0], pa.int64(), mask=gone),
            "middle_chars": pa.array(draws[1] - draws[0], pa.int64(), mask=gone),
            "output": pa.array(output, pa.binary()).cast(pa.string()),
        }

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return arrow_rows(source.select("doc_id", "text", *draws), rows, schema)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``fill_in_middle`` was given, from its output and form alone."""
    p, s, m = (f"\\Q{x}\\E" for x in marks)
    return (
        F.when(form == "psm", F.regexp_replace(output, f"(?s)\\A{p}(.*?){s}(.*?){m}(.*)\\z", "$1$3$2"))
        .when(form == "spm", F.regexp_replace(output, f"(?s)\\A{s}(.*?){p}(.*?){m}(.*)\\z", "$2$3$1"))
        .otherwise(output)
    )


ORACLE_SQL = """
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents),
numbers AS (
    SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b,
           CAST('0x' || h[17:24] AS BIGINT) % 100 AS c, CAST('0x' || h[25:32] AS BIGINT) % 100 AS d
    FROM drawn),
formed AS (
    SELECT doc_id, t, n, least(a, b) AS p, greatest(a, b) AS q,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain'
                WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
           WHEN 'psm' THEN '<P>' || substring(t, 1, p) || '<S>' || substring(t, q + 1) || '<M>' || substring(t, p + 1, q - p)
           ELSE '<S>' || substring(t, q + 1) || '<P>' || substring(t, 1, p) || '<M>' || substring(t, p + 1, q - p) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM formed"""
