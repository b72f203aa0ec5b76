"""Token ids in Arrow stream files of equal-length sequences.

The documents' ids, in ascending doc_id order, form one stream. It is cut by ranges of doc_id into files. A file is an
Arrow IPC stream whose record batches all hold ``ROWS`` sequences (the last fewer) in two fixed-size-list columns:
``input_ids`` (16 bits an id where the vocabulary fits, else 32) and ``attention_mask`` (false at padding, which only
the last sequence has). As every batch but the last has the same shape, id t of a file is in batch t // (ROWS * LENGTH),
which begins at a known byte: any sequence or document is read without what stands before it, and without copying where
the file can be mapped. Beside it, ``*.index.arrow`` has doc_id, start and n_tokens of each document, counted in the file.

Files are written under a name of the attempt and then renamed, so a task that is run again, or twice, leaves one whole
file. Files are ranges of (doc_id, hash of the text, a random number), so that a doc_id or a row that a third of all rows
share is many files. Only a row for each file (its path and totals) reaches the driver; the number of files is that of range partitions.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, scratch_path
from .encoders import encoder

LENGTH, ROWS = 2048, 128
#: Files that one task reads back.
FILES = 8
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _schema(dtype: np.dtype) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(dtype), LENGTH)), ("attention_mask", pa.list_(pa.bool_(), LENGTH))])


def _batch(ids: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    rows = -(-len(ids) // LENGTH)
    flat = np.zeros(rows * LENGTH, ids.dtype)
    flat[: len(ids)] = ids
    columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), LENGTH) for x in (flat, np.arange(len(flat)) < len(ids))]
    return pa.record_batch([x.cast(f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


class _Writer:
    """One file; holds at most a batch of ids."""

    def __init__(self, folder: str, name: str, dtype: np.dtype) -> None:
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.paths = [f"{root}/{name}.arrow", f"{root}/{name}.index.arrow"]
        self.temps = [f"{p}.{uuid.uuid4().hex}" for p in self.paths]
        self.schema, self.dtype = _schema(dtype), dtype
        self.files = [self.fs.open_output_stream(p) for p in self.temps]
        self.streams = [pa.ipc.new_stream(f, s) for f, s in zip(self.files, (self.schema, INDEX), strict=True)]
        self.held, self.n_held, self.n_tokens, self.n_docs, self.first = [], 0, 0, 0, None

    def add(self, doc_ids: list, ids: list[bytes]) -> None:
        sizes = np.array([len(x) // self.dtype.itemsize for x in ids], np.int64)
        starts = self.n_tokens + np.cumsum(sizes) - sizes
        self.streams[1].write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(sizes)], schema=INDEX))
        self.n_docs += len(ids)
        self.n_tokens += int(sizes.sum())
        self.held += ids
        self.n_held += int(sizes.sum())
        full = ROWS * LENGTH
        if self.n_held >= full:
            flat = np.frombuffer(b"".join(self.held), self.dtype)
            for k in range(0, len(flat) - full + 1, full):
                self.streams[0].write_batch(_batch(flat[k : k + full], self.schema))
            rest = flat[len(flat) // full * full :]
            self.held, self.n_held = [rest.tobytes()], len(rest)

    def close(self) -> None:
        if self.n_held:
            self.streams[0].write_batch(_batch(np.frombuffer(b"".join(self.held), self.dtype), self.schema))
        for stream, file, temp, path in zip(self.streams, self.files, self.temps, self.paths, strict=True):
            stream.close()
            file.close()
            self.fs.move(temp, path)


def write(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, chunks: str = "words", id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Encodes every text and writes the files; gives (file, documents, ids) in doc_id order, a row for each file.

    Null and empty texts are one end id. Null doc_ids come first. Rows that share a doc_id are ordered by a hash of their
    text, and may be parted between files; rows alike in both are interchangeable. Other columns are left out. Without
    rows there are no files.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, chunks)
        end = np.array([end_id], enc.dtype).tobytes()
        part, writer = TaskContext.get().partitionId(), None
        for batch in batches:
            if batch.num_rows and writer is None:
                writer = _Writer(folder, f"part-{part:06d}", enc.dtype)
            doc_ids, held = batch.column(0).to_pylist(), []
            for ids in enc.batches(batch.column(1)):
                held.append(ids + end)
                if len(held) == 256:
                    writer.add(doc_ids[:256], held)
                    doc_ids, held = doc_ids[256:], []
            if held:
                writer.add(doc_ids, held)
        if writer:
            writer.close()
            yield pa.record_batch([pa.array([part]), pa.array([f"{folder}/part-{part:06d}"]), pa.array([writer.n_docs]), pa.array([writer.n_tokens])], ["part", "file", "n_docs", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # The number is drawn anew, and the same, wherever a task is run again: its seed is of the partition that is read.
    order = ("doc_id", "mark", "dice")
    ordered = rows.withColumns({"mark": F.xxhash64("text"), "dice": F.rand(3)}).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    done = mapped(ordered, run, "part long, file string, n_docs long, n_tokens long", "encoders").collect()
    return [(r.file, r.n_docs, r.n_tokens) for r in sorted(done, key=lambda r: r.part)]


class TokenFile:
    """Random access to one file, a batch at a time; a local file is mapped and its ids are views of it."""

    def __init__(self, file: str) -> None:
        fs, path = pafs.FileSystem.from_uri(file)
        opened = [pa.memory_map(p) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(p) for p in (f"{path}.arrow", f"{path}.index.arrow")]
        self.source = opened[0]
        self.schema = pa.ipc.read_schema(pa.ipc.read_message(self.source))
        self.first, self.step, self.held = self.source.tell(), None, (-1, np.zeros(0))
        self.batches = pa.ipc.open_stream(opened[1])

    def ids(self, batch: int) -> np.ndarray:
        """The ids of a batch, padding included. All batches before the last are as long as the first."""
        if self.held[0] != batch:
            if batch and self.step is None:
                self.source.seek(self.first)
                pa.ipc.read_message(self.source)
                self.step = self.source.tell() - self.first
            self.source.seek(self.first + batch * (self.step or 0))
            read = pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
            self.held = batch, read.column(0).flatten().to_numpy(zero_copy_only=True)
        return self.held[1]

    def index(self) -> Iterator[pa.RecordBatch]:
        yield from self.batches

    def slices(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The n ids from start on, as views."""
        full = ROWS * LENGTH
        while n > 0:
            view = self.ids(start // full)[start % full : start % full + n]
            yield view
            start, n = start + len(view), n - len(view)


def read(spark, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start (among all files' ids), n_tokens and ids_crc32 of every document, from the files alone."""
    rows, base = [], 0
    for file, _, n in files:
        rows.append((file, base))
        base += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = TokenFile(file)
                for index in tokens.index():
                    starts, sizes = (index.column(k).to_numpy() for k in (1, 2))
                    crcs = []
                    for start, n in zip(starts.tolist(), sizes.tolist(), strict=True):
                        crc = 0
                        for view in tokens.slices(start, n):
                            crc = zlib.crc32(view.astype("<u4"), crc)
                        crcs.append(crc)
                    yield pa.record_batch([index.column(0), pa.array(starts + first), index.column(2), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    paths = spark.createDataFrame(rows, "file string, first long")
    if rows:
        paths = paths.repartitionByRange(len(rows), "first").coalesce(-(-len(rows) // FILES))
    return mapped(paths, run, "doc_id long, start long, n_tokens long, ids_crc32 long", "encoders")
