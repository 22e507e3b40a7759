"""Token ids in Arrow files of equal-length sequences, written in id order and read at random."""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylens.llm.common import arrow_rows, staged
from sentrylens.llm.fim import text_bytes
from sentrylens.session import table_dir

#: Distinct pieces of text whose ids a worker remembers; what goes is encoded again.
CACHED_PIECES = 500_000
#: Pieces that the library is given as one text.
JOINED = 200
#: Marks between pieces and before the first piece of a text.
CUT, FIRST = "\x01", "\x02"


class Encoder:
    """The tokenizers library over whole texts, each distinct piece of a batch encoded once.

    Byte-level vocabularies cut a text in front of every space that a visible character follows,
    whatever stands around it. So a text is the sequence of its pieces between such spaces: Arrow
    cuts and numbers the pieces of a batch, the library encodes the ones that are new, and the ids are put
    together by number. Texts with a special token (or a control character used as a mark here), and
    vocabularies that cut in another way, go to the library as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        cut = spec.get("pre_tokenizer") or {}
        self.by_pieces = (
            spec.get("normalizer") is None
            and cut.get("type") == "ByteLevel"
            and cut.get("add_prefix_space") is False
            and cut.get("use_regex", True)
        )
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        special = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.whole = "|".join([CUT, *special])
        self.widths = np.zeros(self.library.get_vocab_size(), dtype=np.int64)
        for token, i in self.library.get_vocab().items():
            self.widths[i] = len(token)  # a letter stands for a byte
        self.names = pa.array([], pa.string())
        self.lists = pa.array([], pa.list_(pa.from_numpy_dtype(self.dtype)))
        self.hits = np.zeros(0, dtype=np.int64)

    def library_ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype) for e in found]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null text has none."""
        texts = pc.fill_null(texts, "")
        if not self.by_pieces:
            return self.library_ids(texts.to_pylist())
        whole = pc.match_substring_regex(texts, self.whole)
        marked = pc.replace_substring_regex(pc.if_else(whole, "", texts), " ([!-~\u00a1-\u052f])", CUT + " \\1")
        cut = pc.split_pattern(pc.binary_join_element_wise(FIRST, marked, ""), CUT)
        numbered = cut.flatten().dictionary_encode()
        at = self.places(numbered.dictionary)[numbered.indices.to_numpy()]
        sizes = pc.list_value_length(self.lists).to_numpy()[at]
        ids = self.lists.take(pa.array(at)).flatten().to_numpy()
        self.forget()
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        out = [ids[i:j] for i, j in zip(ends, ends[1:])]
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)):
            out[i] = self.library_ids([texts[int(i)].as_py()])[0]
        return out

    def places(self, pieces: pa.Array) -> np.ndarray:
        """Where the ids of distinct pieces stand in ``lists``; those of new pieces are put there first."""
        found = pc.index_in(pieces, value_set=self.names)
        at = pc.fill_null(found, -1).to_numpy().copy()
        if found.null_count:
            names, lists = self.learned(pieces.filter(found.is_null()))
            at[at < 0] = len(self.names) + pc.index_in(pieces.filter(found.is_null()), value_set=names).to_numpy()
            self.names, self.lists = pa.concat_arrays([self.names, names]), pa.concat_arrays([self.lists, lists])
            self.hits = np.concatenate([self.hits, np.zeros(len(names), dtype=np.int64)])
        self.hits[at] += 1
        return at

    def learned(self, new: pa.Array) -> tuple[pa.Array, pa.Array]:
        """New pieces and their ids. Many pieces make one text, whose ids are cut by their widths."""
        is_first = pc.starts_with(new, FIRST)
        first, spaced = new.filter(is_first), new.filter(pc.invert(is_first))
        alone = self.library_ids([p[1:] for p in first.to_pylist()])
        data, at = text_bytes(spaced)
        ends = at[np.append(np.arange(0, len(spaced), JOINED), len(spaced))]
        joined = self.library_ids([data[i:j].tobytes().decode() for i, j in zip(ends, ends[1:])])
        ids = np.concatenate([np.zeros(0, self.dtype), *joined])
        cuts = np.searchsorted(np.cumsum(self.widths[ids]), at[1:]) + 1
        behind = len(ids) + np.cumsum([len(x) for x in alone], dtype=np.int64)
        places = np.concatenate([[0], cuts, behind]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate([ids, *alone])))
        return pa.concat_arrays([spaced, first]), lists

    def forget(self) -> None:
        """When the memory is full, keep the pieces that most batches had."""
        if len(self.names) > CACHED_PIECES:
            keep = np.sort(np.argsort(-self.hits, kind="stable")[: CACHED_PIECES // 2])
            self.names, self.lists = self.names.take(pa.array(keep)), self.lists.take(pa.array(keep))
            self.hits = self.hits[keep] // 2


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@dataclass(frozen=True)
class Layout:
    """``length`` ids in a sequence, ``batch`` sequences in a record batch, a file ends at the first
    document end behind ``roll`` batches."""

    length: int = 1024
    batch: int = 256
    roll: int = 128


def _place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a shared folder, and the path in it."""
    if re.match("file:/|/", uri):
        return pyarrow.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


class SequenceFile:
    """One file in the making: ids go in front to back, full batches go out at once."""

    def __init__(self, uri: str, dtype: np.dtype, layout: Layout):
        self.layout, self.dtype, self.uri = layout, dtype, uri
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema(
            [("ids", pa.list_(kind, layout.length)), ("mask", pa.list_(pa.bool_(), layout.length))],
            metadata={"length": str(layout.length), "batch": str(layout.batch)},
        )
        files, path = _place(uri)
        self.sink = files.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.buffer = np.zeros(layout.length * layout.batch, dtype)
        self.filled = self.ids = self.batches = 0

    def add(self, ids: np.ndarray) -> int:
        """Append ids; the place of the first one in the file."""
        at, self.ids = self.ids, self.ids + len(ids)
        while len(ids):
            part = ids[: len(self.buffer) - self.filled]
            self.buffer[self.filled : self.filled + len(part)] = part
            self.filled += len(part)
            ids = ids[len(part) :]
            if self.filled == len(self.buffer):
                self._flush()
        return at

    def _flush(self) -> None:
        rows = -(-self.filled // self.layout.length)
        width = rows * self.layout.length
        self.buffer[self.filled : width] = 0
        mask = np.arange(width) < self.filled
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.layout.length) for v in (self.buffer[:width].copy(), mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.filled, self.batches = 0, self.batches + 1

    def close(self) -> None:
        if self.filled:
            self._flush()
        self.writer.close()
        self.sink.close()


class SequenceReader:
    """Random access to one file. A local file is mapped, so sequences and masks are views of it."""

    def __init__(self, uri: str):
        files, path = _place(uri)
        source = pa.memory_map(path) if isinstance(files, pyarrow.fs.LocalFileSystem) else files.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.length = int(self.file.schema.metadata[b"length"])
        self.step = self.length * int(self.file.schema.metadata[b"batch"])

    def _flat(self, batch: int, column: str) -> pa.Array:
        return self.file.get_batch(batch).column(column).flatten()

    def sequence(self, number: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask (a bit for each id) of one sequence, without reading the others."""
        batch, at = divmod(number * self.length, self.step)
        ids, mask = (self._flat(batch, c).slice(at, self.length) for c in ("ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask

    def sequences(self) -> int:
        if not (n := self.file.num_record_batches):
            return 0
        return (n - 1) * (self.step // self.length) + self.file.get_batch(n - 1).num_rows

    def ids(self, start: int, n: int) -> list[np.ndarray]:
        """The ids from ``start`` on, as views of the batches that hold them; padding is not read."""
        views = []
        while n:
            batch, at = divmod(start, self.step)
            view = self._flat(batch, "ids").slice(at, n).to_numpy(zero_copy_only=True)
            if self._flat(batch, "mask").slice(at, n).true_count < max(len(view), 1):
                raise ValueError(f"ids {start} to {start + n} run into padding")
            views.append(view)
            start, n = start + len(view), n - len(view)
        return views


def write_token_files(
    df: DataFrame,
    path: str,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    layout: Layout = Layout(),
) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each and write all ids in ascending id order.

    Returns the index of the files: ``doc_id, file, part, number, at, n_tokens``; ``at`` is the
    place in the file, and files follow one another by ``part`` and ``number``.

    Texts are range-partitioned by id and sorted in their partitions, the one shuffle; a task then
    writes its range front to back, keeping one record batch. Rows that share an id are ordered by
    a hash of their text and are spread over ranges like others. Ranges end in a padded sequence, whose
    mask is false beyond the last id. Every attempt of a task writes files of its own name, and only those of the
    attempt that Spark commits get into the index, so a lost executor leaves files that nobody reads.

    A null text is empty: the end id alone. Null ids come first; repeated ids and rows stay; further
    columns are ignored; an empty table writes no file. ``folder`` must be shared by all machines.
    """
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    source = source.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = ["doc_id", "_hash", "_row"]
    ranged = source.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.array([end_id], dtype=encode.dtype)
        part, number, out = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            found: dict[str, list] = {k: [] for k in ("file", "number", "at", "n_tokens")}
            for ids in encode(batch.column(1)):
                if out is not None and out.batches >= layout.roll:
                    out.close()
                    out, number = None, number + 1
                if out is None:
                    name = f"{folder}/part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.arrow"
                    out = SequenceFile(name, encode.dtype, layout)
                at = out.add(ids)
                out.add(end)
                for k, v in (("file", out.uri), ("number", number), ("at", at), ("n_tokens", len(ids) + 1)):
                    found[k].append(v)
            arrays = {
                "doc_id": batch.column(0), "file": pa.array(found["file"], pa.string()),
                "part": pa.array([part] * batch.num_rows, pa.int32()), "number": pa.array(found["number"], pa.int32()),
                "at": pa.array(found["at"], pa.int64()), "n_tokens": pa.array(found["n_tokens"], pa.int64()),
            }
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(arrays)
        if out is not None:
            out.close()

    files, at = _place(folder)
    files.create_dir(at, recursive=True)
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return staged(ranged.mapInArrow(write, "doc_id long, file string, part int, number int, at long, n_tokens long"))


def read_documents(index: DataFrame, rows: Callable[[np.ndarray], dict[str, int]], schema: str) -> DataFrame:
    """Every document's ids, read back from the files by the index: ``doc_id, start, n_tokens`` and ``schema``.

    ``start`` counts the ids of all documents before it. The totals of the files (one row for each
    file) are added up in file order and joined to the index. ``rows`` turns a document's ids into further columns.
    """
    per_file = index.groupBy("part", "number", "file").agg(F.sum("n_tokens").alias("_ids"))
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_file.select(F.col("file").alias("_file"), F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_first"))
    placed = index.join(firsts, F.col("file") == F.col("_file")).select(
        "doc_id", (F.col("_first") + F.col("at")).alias("start"), "n_tokens", "file", "at"
    ).sortWithinPartitions("file", "at")
    names = [c.split()[0] for c in schema.split(",")]

    def read(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in names}
        opened: tuple[str, SequenceReader] | None = None
        for file, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "n_tokens"))):
            if opened is None or opened[0] != file:
                opened = (file, SequenceReader(file))
            views = opened[1].ids(at, n)
            for k, v in rows(views[0] if len(views) == 1 else np.concatenate(views)).items():
                out[k].append(v)
        return {"doc_id": batch.column(0), "start": batch.column(1), "n_tokens": batch.column(2)} | out

    return arrow_rows(placed, read, f"doc_id long, start long, n_tokens long, {schema}")


def read_sequences(index: DataFrame) -> DataFrame:
    """The sequences themselves, for training: ``file, sequence, ids, mask``, a task a file."""
    files = index.select("file").distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                reader, first = SequenceReader(file), 0
                for k in range(reader.file.num_record_batches):
                    b = reader.file.get_batch(k)
                    n = b.num_rows
                    yield pa.RecordBatch.from_pydict(
                        {
                            "file": pa.array([file] * n), "sequence": pa.array(range(first, first + n), pa.int64()),
                            "ids": b.column("ids").cast(pa.list_(pa.int32())), "mask": b.column("mask").cast(pa.list_(pa.bool_())),
                        }
                    )
                    first += n

    return files.mapInArrow(read, "file string, sequence long, ids array<int>, mask array<boolean>")


def token_files(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", layout: Layout = Layout()) -> DataFrame:
    """Write the files into a new shared folder and read every document back: ``doc_id, start, n_tokens, ids_crc32``.

    The checksum is that of the ids as little-endian unsigned 32-bit numbers, as read from the files.
    """
    index = write_token_files(df, path, table_dir(df.sparkSession), id_col, text_col, layout=layout)
    return read_documents(index, lambda ids: {"ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}, "ids_crc32 long")
