"""Removal of repeated byte strings through a collection suffix order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylens.llm.common import arrow_rows, bucketed, mix64, release, staged

LENGTH = 200
#: Bytes hashed for a fingerprint; a power of two below the length.
GRAM = 64
#: Most starts in a segment, level by level. A key with more than ``GROUP`` different segments
#: goes to the next level; at the last one all segments of a key are equal.
LEVELS = (32, 4, 1)
GROUP = 500
#: Symbols of segments whose suffixes are ordered together.
BLOCK_BYTES = 96 << 10
CHUNK_BYTES = 256 << 10
#: First symbol that stands for a core; smaller ones are bytes plus 1.
CORE = 257


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of each row; a null row has no bytes."""
    if column.offset or column.null_count:
        column = pa.concat_arrays([column.fill_null("")])
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def gram_hashes(b: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` bytes from each position on, by doubling."""
    h = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    base, size = np.uint64(0xD1342543DE82EF95), 1
    with np.errstate(over="ignore"):
        while size < n:
            h = h[: len(h) - size] * base + h[size:]
            base, size = base * base, size * 2
        return mix64(h)


def fingerprints(b: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of ``length`` bytes within one row, the position of each one's fingerprint, and all hashes.

    The fingerprint of a string is the leftmost smallest hash in it, so equal strings have
    equal fingerprints at equal places.
    """
    if len(b) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = gram_hashes(b, gram)
    width = length - gram + 1
    best, at, size = hashes, np.arange(len(hashes), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        left, right = best[: len(best) - step], best[step:]
        take = right < left
        best, at = np.where(take, right, left), np.where(take, at[step:], at[: len(at) - step])
        size += step
    rows = np.diff(offsets)
    ends = np.repeat(offsets[1:], rows)[: len(at)]
    starts = np.flatnonzero(np.arange(len(at)) + length <= ends)
    return starts, at[starts].astype(np.int64), hashes


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive rows of about ``CHUNK_BYTES``: first row, bytes, offsets."""
    b, offsets = flat_bytes(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        yield row, b[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def runs(starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First start and number of starts of each run that shares one fingerprint position."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
    return starts[cut], np.diff(np.r_[cut, len(starts)])


def document_keys(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``doc_id, key, n``: the different fingerprints of each document, and how often it has them."""

    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        ids, out = batch.column(0).to_numpy(zero_copy_only=False), []
        for row, b, offsets in chunks(batch.column(1)):
            starts, at, hashes = fingerprints(b, offsets, length, gram)
            first, _ = runs(starts, at)
            if not len(first):
                continue
            doc = np.searchsorted(offsets, first, "right") - 1
            key = hashes[at[np.searchsorted(starts, first)]].view(np.int64)
            order = np.lexsort((key, doc))
            doc, key = doc[order], key[order]
            cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
            out.append((ids[row + doc[cut]], key[cut], np.diff(np.r_[cut, len(key)])))
        if not out:
            return {"doc_id": [], "key": [], "n": []}
        return {name: np.concatenate(x) for name, x in zip(("doc_id", "key", "n"), zip(*out))}

    return arrow_rows(docs, rows, "doc_id long, key long, n int")


#: Where the strings around shared fingerprints lie, and the digests of their segments.
PLACES = "doc_id long, key long, digest binary, starts array<int>, width int, anchor int"
SEGMENTS = "doc_id long, key long, digest binary, starts array<int>, width int, anchor int, segment binary"
#: Later segments: what lies left and right of the part that all segments of the key share.
CORED = "doc_id long, key long, digest binary, starts array<int>, width int, left binary, right binary"


def packed(rows: Iterable[tuple], names: str) -> dict[str, list]:
    """Rows of (doc, key, starts, content, ...) as columns, equal ones of a document put together as they come.

    ``content`` is hashed; the rest of the row follows from it.
    """
    merged: dict[tuple, list] = {}
    for doc, key, starts, content, *rest in rows:
        digest = hashlib.blake2b(content, digest_size=16).digest()
        merged.setdefault((doc, key, digest, *rest), []).extend(starts)
    columns = [x.split()[0] for x in names.split(", ")]
    out: dict[str, list] = {name: [] for name in columns}
    for (doc, key, digest, *rest), starts in merged.items():
        for name, v in zip(columns, (doc, key, digest, starts, *rest)):
            out[name].append(v)
    return out


def first_places(docs: DataFrame, shared: DataFrame, length: int, gram: int) -> DataFrame:
    """The segments of each document around fingerprints that are shared, by digest.

    A segment holds all strings of a run of starts with one fingerprint; ``anchor`` is the
    place of the fingerprint in it.
    """
    wanted = shared.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))

    def found(batch: pa.RecordBatch) -> Iterator[tuple]:
        ids = batch.column(0).to_pylist()
        for row, b, offsets in chunks(batch.column(1)):
            starts, at, hashes = fingerprints(b, offsets, length, gram)
            first, width = runs(starts, at)
            anchor = at[np.searchsorted(starts, first)] if len(first) else first
            keys = hashes[anchor].view(np.int64) if len(first) else first
            doc = np.searchsorted(offsets, first, "right") - 1
            for d in range(len(offsets) - 1):
                lo, hi = np.searchsorted(doc, (d, d + 1))
                keep = lo + np.flatnonzero(np.isin(keys[lo:hi], batch.column(2)[row + d].values.to_numpy()))
                for f, n, p, key in zip(first[keep].tolist(), width[keep].tolist(), anchor[keep].tolist(), keys[keep].tolist()):
                    yield ids[row + d], key, [f - int(offsets[d])], b[f : f + n + length - 1].tobytes(), n, p - f

    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        # equal segments of a text are one entry as soon as they are met: a periodic text has very many
        return packed(found(batch), PLACES)

    return arrow_rows(docs.join(wanted, "doc_id").select("doc_id", "text", "keys"), rows, PLACES)


def segments_at(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """The segments that start at ``places`` (``doc_id, key, start, width, anchor, n``), read from the documents.

    Segments that occur more than once (``n``) need no marks any more and lose their document.
    """
    place = F.struct("key", "start", "width", "anchor", (F.col("n") == 1).alias("single"))
    here = places.groupBy("doc_id").agg(F.collect_list(place).alias("here"))

    def found(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc, text, here in zip(*(c.to_pylist() for c in batch.columns)):
            data = text.encode("utf-8")
            for x in here:
                segment = data[x["start"] : x["start"] + x["width"] + length - 1]
                yield doc if x["single"] else None, x["key"], [x["start"]], segment, x["width"], x["anchor"], segment

    return arrow_rows(
        docs.join(here, "doc_id").select("doc_id", "text", "here"), lambda batch: packed(found(batch), SEGMENTS), SEGMENTS
    )


def new_key(*parts: int | bytes) -> int:
    text = b"/".join(x if isinstance(x, bytes) else str(x).encode() for x in parts)
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def split_segments(segments: DataFrame, block: int, length: int) -> DataFrame:
    """Cut segments into runs of at most ``block`` starts, keyed by what all their strings share.

    The cut is made at fixed distances from the fingerprint. The strings that start ``q`` to
    ``q + block - 1`` bytes before it share the core: what lies from ``q`` before it to the end
    of the farthest one. The core, with ``q``, makes the new key, so it need not be kept.
    """

    def found(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc, key, starts, width, anchor, segment in zip(*(c.to_pylist() for c in batch.columns)):
            for q in range((anchor - width + 1) // block * block, anchor + 1, block):
                lo, hi = max(0, anchor - q - block + 1), min(width - 1, anchor - q)
                if lo > hi:
                    continue
                core, end = anchor - q, anchor - q - block + 1 + length
                new = new_key(key, q, block, segment[core:end])
                left, right = segment[lo:core], segment[end : hi + length]
                content = left + b"/" + right + str((hi - lo, len(left))).encode()
                yield doc, new, [start + lo for start in starts], content, hi - lo + 1, left, right

    return arrow_rows(
        segments.select("doc_id", "key", "starts", "width", "anchor", "segment"), lambda batch: packed(found(batch), CORED), CORED
    )


def split_cored(segments: DataFrame, block: int, smaller: int) -> DataFrame:
    """Cut segments with a core into runs of at most ``smaller`` starts, with longer cores.

    Distances count from the start of the core. The new key adds what the core gains on both sides.
    """

    def found(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc, key, starts, width, left, right in zip(*(c.to_pylist() for c in batch.columns)):
            n = len(left)
            for q in range((n - width + 1) // smaller * smaller, n + 1, smaller):
                near, far = max(q, n - width + 1), min(q + smaller - 1, n)
                if near > far:
                    continue
                gained = block - q - smaller
                new = new_key(key, q, smaller, left[n - q :], right[:gained])
                new_left, new_right = left[n - far : n - q], right[gained : block - 1 - near]
                content = new_left + b"/" + new_right + str((far - near, len(new_left))).encode()
                yield doc, new, [start + n - far for start in starts], content, far - near + 1, new_left, new_right

    return arrow_rows(
        segments.select("doc_id", "key", "starts", "width", "left", "right"), lambda batch: packed(found(batch), CORED), CORED
    )


def collection_order(
    texts: list[np.ndarray], length: int, core: int = 1
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and start of all suffixes in order, and the common prefix of each with the one
    before it, up to ``length``.

    Texts are arrays of symbols from 1; symbols from ``CORE`` on stand for ``core`` bytes. Column by column: each round
    puts the next symbol of every text, from its end, in front of the text's suffix. The
    Burrows-Wheeler transform of the collection tells where the longer suffix goes; its common
    prefix with a neighbour is its first symbol plus the smallest common prefix between the two
    occurrences of that symbol. Transform and prefixes are read and rewritten front to back once in a round.
    """
    m = len(texts)
    sizes = np.array([len(t) for t in texts])
    flat = np.concatenate([*texts, [0]]).astype(np.int64)
    ends = np.cumsum(sizes)

    def symbol(who: np.ndarray, inserted: int) -> np.ndarray:
        """The symbol before the last ``inserted`` ones of a text; 0 at its start."""
        left = sizes[who] > inserted
        return np.where(left, flat[np.where(left, ends[who] - inserted - 1, 0)], 0)

    def merged(old: np.ndarray, places: np.ndarray, added: np.ndarray) -> np.ndarray:
        out = np.empty(len(old) + len(added), dtype=old.dtype)
        stays = np.ones(len(out), dtype=bool)
        stays[places] = False
        out[stays], out[places] = old, added
        return out

    low = np.int64((1 << 32) - 1)
    who = place = np.arange(m)  # texts with symbols left, and the rows of their longest suffixes
    before_it = symbol(who, 0)
    # the transform, by symbol: symbol << 32 | row, for rows that have one; entry i leads to row m + i
    transform = np.sort((before_it << 32 | place)[before_it > 0])
    at = ends.astype(np.int32)
    common = np.zeros(m + 1, dtype=np.int16)  # with one more at the end, for the spans below
    done = 0
    while True:
        alive = before_it > 0
        who = who[alive]
        if not len(who):
            break
        new = m + np.searchsorted(transform, before_it[alive] << 32 | place[alive])
        ranks = np.argsort(new)
        who, place = who[ranks], new[ranks]
        done += 1
        n = len(at) + len(who)
        changed = np.unique(np.concatenate([place, place + 1]))
        changed = changed[(changed < n) & (changed > m)]
        here, prior = transform[changed - m], transform[changed - m - 1]
        same = here >> 32 == prior >> 32
        changed, spans = changed[same], np.column_stack([prior[same] & low, here[same] & low]).ravel() + 1
        first = np.where(here[same] >> 32 >= CORE, core, 1)
        values = np.minimum(np.minimum.reduceat(common, spans)[::2] + first, length) if len(changed) else changed
        common = merged(common, place, np.zeros(len(who), dtype=np.int16))
        common[changed] = values
        at = merged(at, place, ends[who] - done)
        stays = np.ones(n, dtype=bool)
        stays[place] = False
        rows = transform & low
        transform += np.flatnonzero(stays)[rows] - rows
        before_it = symbol(who, done)
        added = np.sort((before_it << 32 | place)[before_it > 0])
        transform = merged(transform, np.searchsorted(transform, added) + np.arange(len(added)), added)
    text = np.searchsorted(ends, at[m:], "right")
    return text, at[m:] - (ends - sizes)[text], common[m:-1]


def repeated_starts(texts: list[np.ndarray], length: int, core: int = 1) -> list[np.ndarray]:
    """For each text, its starts of ``length`` bytes that also start elsewhere in the texts."""
    text, begin, common = collection_order(texts, length, core)
    long = common >= length
    hit = long | np.r_[long[1:], False]
    text, begin = text[hit], begin[hit]
    order = np.lexsort((begin, text))
    text, begin = text[order], begin[order]
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    return [begin[a:b] for a, b in zip(cut, cut[1:])]


def symbols(text: bytes) -> np.ndarray:
    return np.frombuffer(text, dtype=np.uint8).astype(np.int64) + 1


def spans_of(starts: np.ndarray) -> list[list[int]]:
    """Sorted starts as [first, last] runs."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.r_[True, np.diff(starts) > 1])
    return np.column_stack([starts[cut], starts[np.r_[cut[1:] - 1, len(starts) - 1]]]).tolist()


def ordered_groups(groups: DataFrame, length: int, core: int) -> DataFrame:
    """``key, digest, spans``: repeated starts within the segments of each key.

    The core that the segments of a key share is one symbol of their texts. Keys are dealt to
    tasks; a task orders the suffixes of several keys at once, about ``BLOCK_BYTES`` at a time,
    and never cuts a key (which has at most ``GROUP`` segments, or equal ones).
    """
    dealt = groups.repartition(F.col("key")).sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = kinds = 0

        def ordered() -> pa.RecordBatch:
            hits = repeated_starts([x[2] for x in held], length, core)
            found = [(k, d, spans_of(x)) for (k, d, _), x in zip(held, hits) if len(x)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in found], pa.int64()),
                    pa.array([x[1] for x in found], pa.binary()),
                    pa.array([x[2] for x in found], pa.list_(pa.list_(pa.int32()))),
                ],
                names=["key", "digest", "spans"],
            )

        for batch in batches:
            for key, digest, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                if held and key != held[-1][0]:
                    kinds += 1
                    if size >= BLOCK_BYTES:
                        yield ordered()
                        held, size, kinds = [], 0, 0
                text = np.concatenate([symbols(left), [CORE + kinds], symbols(right)])
                held.append((key, digest, text))
                size += len(text)
        if held:
            yield ordered()

    return dealt.select("key", "digest", "left", "right").mapInArrow(run, "key long, digest binary, spans array<array<int>>")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, spans``: for each document the first and last starts, in turn, of its runs of repeated starts.

    Every string of ``length`` bytes has a fingerprint in it. Only strings whose fingerprint
    occurs again can be repeated; they are gathered, as segments around the fingerprint. Equal
    segments of a key are merged first: all their strings are repeated. Where a key has
    several segments, one of each is cut to a few starts, with what these share as the new
    key, which leaves only the borders between equal and different text. There the suffixes of a key's segments are
    ordered together and neighbours compared. A key with too many different segments is cut
    again (``LEVELS``), until each fits one task. Texts are read where they lie; what a level
    has staged goes when its marks are written.
    """
    shared = staged(document_keys(docs, length, gram))
    counts = shared.groupBy("key").agg(F.sum("n").alias("total")).filter("total > 1").select("key")
    segments = staged(first_places(docs, shared.join(counts, "key").select("doc_id", "key"), length, gram))
    release(shared)
    marks = []
    for level, block in enumerate((*LEVELS, None)):
        places = segments.select("doc_id", "key", "digest", "starts", "width")
        one = [] if level else [F.first(F.struct("doc_id", F.col("starts")[0].alias("start"), "width", "anchor")).alias("one")]
        distinct = staged(segments.groupBy("key", "digest").agg(F.sum(F.size("starts")).alias("n"), *one))
        keys = staged(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"))
        level_tables = [segments, distinct, keys]
        # segments without a document occur again: their strings have been marked
        whole = places.filter("doc_id IS NOT NULL").join(distinct.filter("n > 1").select("key", "digest"), ["key", "digest"])
        marks.append(
            staged(
                whole.select(
                    "doc_id", F.flatten(F.transform("starts", lambda s: F.array(s, s + F.col("width") - 1))).alias("spans")
                )
            )
        )
        if level:
            fits = keys.filter(F.col("kinds") <= GROUP) if block else keys
            wanted = staged(distinct.join(fits.select("key"), "key").select("key", "digest"))
            texts = segments.select("key", "digest", "left", "right").join(wanted, ["key", "digest"])
            one_each = texts.groupBy("key", "digest").agg(F.first(F.struct("left", "right")).alias("_sides"))
            sides = one_each.select("key", "digest", "_sides.left", "_sides.right")
            found = staged(ordered_groups(sides, length, length - LEVELS[level - 1] + 1).withColumnRenamed("spans", "found"))
            level_tables += [wanted, found]
            marks.append(
                staged(
                    places.filter("doc_id IS NOT NULL")
                    .join(found, ["key", "digest"])
                    .select(
                        "doc_id",
                        F.flatten(
                            F.flatten(F.transform("starts", lambda s: F.transform("found", lambda f: F.array(s + f[0], s + f[1]))))
                        ).alias("spans"),
                    )
                )
            )
        # few keys, as a table of known size: the plan need not move all segments to find theirs
        hot = staged(keys.filter(F.col("kinds") > (GROUP if level else 1)).select("key"))
        level_tables.append(hot)
        last = block is None or hot.isEmpty()
        if not last:
            if level:
                cut = split_cored(segments.join(hot, "key"), LEVELS[level - 1], block)
            else:
                there = segments_at(docs, distinct.join(hot, "key").select("key", "n", "one.*"), length)
                cut = split_segments(there, block, length)
            segments = staged(cut)
        release(*level_tables)
        if last:
            break
    out = marks[0]
    for more in marks[1:]:
        out = out.unionByName(more)
    return out.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(
    df: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Remove every byte of a string of ``length`` bytes that starts anywhere else too.

    ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``: the last is what remains, as
    bytes. Matches never cross documents, overlapping ones count, and all strings are judged on the input. Null
    texts are empty; texts shorter than ``length`` stay whole. Ids may be null or repeat: inside, a row goes
    by a 64-bit hash of its id and text, so only rows equal in both are one, and they have the same result.
    An empty table gives an empty result; further columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    named = bucketed(
        df.select(F.col(id_col).cast("long").alias("_id"), text).withColumn("doc_id", F.xxhash64("_id", "text")), "doc_id"
    )
    joined = named.join(repeats(named.select("doc_id", "text"), length, gram), "doc_id", "left").select("_id", "text", "spans")

    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {name: [] for name in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            data = text.encode("utf-8")
            edge = np.zeros(len(data) + 1, dtype=np.int32)
            starts = np.array(spans or (), dtype=np.int64)
            np.add.at(edge, starts[::2], 1)
            np.add.at(edge, starts[1::2] + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
            n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            row = (doc, len(data), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept)
            for name, v in zip(out, row):
                out[name].append(v)
        return out

    return arrow_rows(
        joined, rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
