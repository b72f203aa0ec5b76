"""Packing documents into sequences: shortest-pack-first over the histogram of lengths.

A document's ids are cut into pieces of at most ``MAX`` tokens. Only the histogram of piece lengths (at most MAX rows)
comes to the driver. There lengths are placed from the longest down; a length goes to the shortest pack that has room,
many packs of one shape at a time, so the work depends on the number of lengths and shapes, not on that of documents.
Each placement says: the pieces of this length with ranks a to b go to sequences c to d at this offset. Pieces then find
their placement by their rank among the pieces of their length.

A sequence is padded to MAX unless its length is a power of two.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, materialise
from .encoders import encoder

MAX = 2048
LEAST_TASKS, TASK_ROWS = 12, 250_000


def pieces(docs: DataFrame, vocabulary: str, end_id: int, chunks: str = "spaced", with_ids: bool = True, most: int = MAX, remembered: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids (4 bytes each).

    remembered: chunks whose ids a worker keeps (a trade of memory for time). A null or empty text is the end id alone. Rows that repeat a doc_id are packed each for itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, chunks, remembered)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            rows, held = [], 0
            for doc, ids in zip(batch.column(0).to_pylist(), enc.batches(batch.column(1)), strict=True):
                flat = np.frombuffer(ids + end, enc.dtype).astype("<u4")
                for k in range(0, len(flat), most):
                    part = flat[k : k + most]
                    rows.append((doc, k, len(part), zlib.crc32(part), len(flat), part.tobytes() if with_ids else b""))
                held += len(flat)
                if held >= 4_000_000:
                    yield _rows(rows, with_ids)
                    rows, held = [], 0
            if rows:
                yield _rows(rows, with_ids)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mapped(texts, run, schema, "encoders")


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    arrays = [pa.array(c, pa.int64()) for c in columns[:5]]
    return pa.record_batch([*arrays, pa.array(columns[5], pa.binary())] if with_ids else arrays, [*names, "ids"] if with_ids else names)


def plan(histogram: dict[int, int], most: int = MAX) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, count, first sequence, offset) of a histogram of lengths.

    Packs of one shape are runs of sequence numbers; runs split, so each is followed from its first piece on.
    """
    by_room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: runs (first sequence, count)
    out, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        rooms = sorted((r for r in by_room if r >= length and by_room[r]), reverse=True)  # shortest pack first
        while left:
            if rooms:
                room = rooms[0]
                first, n = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(0)
                take = min(n, left)
                if take < n:
                    by_room[room].append((first + take, n - take))
            else:
                # As many new packs as the rest needs when each takes as many of this length as fit.
                room, first, take = most, sequences, -(-left // (most // length))
                sequences += take
            out.append((length, rank, take, first, most - room))
            rank, left, now = rank + take, left - take, room - length
            by_room[now].append((first, take))
            if now >= length and now not in rooms:
                rooms = sorted([*rooms, now], reverse=True)
    return out


#: Sides of the die that every piece throws when it is written: it deals pieces that are alike in all else to different tasks.
SIDES = 1 << 30


def ranked(found: DataFrame, buckets: int) -> DataFrame:
    """found (with dice) with rank, from 0, among the rows of its length.

    Rows are dealt to buckets by their dice; counts of each bucket and length give where a bucket's ranks begin, so that a
    length, a doc_id or a text that a third of the pieces have is counted in all tasks.
    """
    dealt = found.withColumn("bucket", F.pmod("dice", F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("bucket", "length").orderBy("doc_id", "start", "dice")
    own = dealt.withColumn("place", F.row_number().over(inside) - 1)
    return own.join(begins, ["bucket", "length"]).withColumn("rank", F.col("begin") + F.col("place")).drop("bucket", "begin", "place", "dice")


def assign(found: DataFrame, most: int = MAX) -> DataFrame:
    """The pieces (a table that was written, with length from 1 to most, and dice), with sequence_id and offset, without dice."""
    spark = found.sparkSession
    histogram = {r.length: r["count"] for r in found.groupBy("length").count().collect()}  # at most `most` rows
    placed = np.array(sorted(plan(histogram, most)), np.int64).reshape(-1, 5)
    length_base = np.int64(1) << 48
    keys = placed[:, 0] * length_base + placed[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = placed[np.searchsorted(keys, length * length_base + rank, "right") - 1]
            keep = [i for i, name in enumerate(batch.schema.names) if name != "rank"]
            arrays = [*(batch.column(i) for i in keep), pa.array(at[:, 3] + rank - at[:, 1]), pa.array(at[:, 4])]
            yield pa.record_batch(arrays, [*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    n_rows = sum(histogram.values())
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), n_rows // TASK_ROWS)
    with_rank = ranked(found, buckets)
    schema = ", ".join(f"{n} {t}" for n, t in with_rank.dtypes if n != "rank") + ", sequence_id long, offset long"
    # Rows are short: so many fill a task, and the result isn't left in files of a few rows.
    return mapped(with_rank.coalesce(max(LEAST_TASKS, n_rows // TASK_ROWS)), run, schema, "encoders")


def pack(docs: DataFrame, vocabulary: str, end_id: int, with_ids: bool = False, **options) -> DataFrame:
    """Pieces of all rows of docs with the sequence and offset that each has.

    Null and empty texts are the end id alone. Rows that repeat, and rows of a null or repeated doc_id, are packed each
    for itself (which pieces are of one row then shows only in their numbers). Columns of docs but doc_id are left out. No
    rows give no pieces.
    """
    thrown = pieces(docs, vocabulary, end_id, with_ids=with_ids, **options).withColumn("dice", F.floor(F.rand(5) * F.lit(SIDES)).cast("int"))
    return assign(materialise(thrown, "pieces"))


def sequences(packed: DataFrame, pad_id: int = 0, most: int = MAX) -> DataFrame:
    """The padded sequences of pack(with_ids=True): sequence_id, input_ids, and segment_ids (0 at padding).

    A group is one sequence, so at most `most` ids.
    """

    def run(pieces: pa.Table) -> pa.Table:
        order = np.argsort(pieces["offset"].to_numpy())
        parts = [np.frombuffer(pieces["ids"][int(i)].as_py(), "<u4") for i in order]
        n = sum(map(len, parts))
        size = n if n & (n - 1) == 0 else most
        ids, segments = np.full(size, pad_id, np.int64), np.zeros(size, np.int32)
        ids[:n] = np.concatenate(parts)
        segments[:n] = np.repeat(np.arange(1, len(parts) + 1), [len(p) for p in parts])
        return pa.table({"sequence_id": pieces["sequence_id"][:1], "input_ids": pa.array([ids]), "segment_ids": pa.array([segments])})

    return packed.groupBy("sequence_id").applyInArrow(run, "sequence_id long, input_ids array<long>, segment_ids array<int>")
