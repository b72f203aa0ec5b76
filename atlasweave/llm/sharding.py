"""Sharding by sampled splitters, with DataFrame operations only.

Records have the key (hash of the text, doc_id, a random number), so copies of a text stand together, and rows that are
alike in all else still differ. A sample in which a record's chance grows with its bytes gives splitters at its
quantiles; they cut the records into ranges of about equal bytes. The exact bytes of each range are then counted, and a
range that got more than ``OVERFULL`` times its share gets splitters of its own from a sample of its own, until none is
overfull but for a single record. Bytes before a record are those of the ranges before its range and of the records
before it there, and say which shard it goes to: shard sizes differ by less than the two records at a shard's ends.

The driver sees at most about ``DRAWN`` keys for each of at most ``MOST_RANGES`` ranges in a round, whatever the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SHARDS = 24
#: Ranges at least and at most, and records for each range that the number of ranges follows between. Splitters stand in
#: the plan, so their number is bounded; beyond it ranges grow, and each is one sort that can spill.
RANGES, MOST_RANGES, RECORDS = 96, 2048, 20_000
#: Sampled keys for each range, and times its share that is overfull. Rounds of subdividing: each leaves an overfull range
#: with a chance far under one in a million, so that more show a fault.
DRAWN, OVERFULL, ROUNDS = 32, 2.0, 12
#: Splitters are looked up by so many leading bits of the hash.
LEAD = 12


def slim(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, hash and a random number (dice) of every row: all that sharding needs, read once.

    The number is drawn once, before the rows are written: it parts rows that are alike, of which any may take the
    other's place.
    """
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
        F.floor(F.rand(17) * F.lit(float(1 << 52))).cast("long").alias("dice"),
    )


ORDER = ("hash", "id", "dice")
Key = tuple[int, int, int]


def _id() -> Column:
    return F.coalesce("doc_id", F.lit(-(2**63)))


def _drawn(rows: DataFrame, bytes_a_draw: float, seed: int) -> DataFrame:
    """Keys of rows with the draws that each got: its bytes over those of a draw, on average. A key is one row here, however many copies there are."""
    u = F.pmod(F.xxhash64("hash", "doc_id", "dice", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    draws = F.floor(F.col("size") / F.lit(bytes_a_draw) + u)
    return rows.select("hash", _id().alias("id"), "dice", draws.alias("draws")).where("draws > 0")


def _splitters(drawn: DataFrame, parts: int) -> list[Key]:
    """Keys that cut the draws into parts; drawn is a sample of bounded size (DRAWN for each part, about)."""
    keys = sorted(((r.hash, r.id, r.dice), r.draws) for r in drawn.collect())
    total, seen, out = sum(d for _, d in keys), 0, []
    for key, draws in keys:
        if seen // (total / parts) != (seen + draws) // (total / parts) and (not out or out[-1] < key):
            out.append(key)
        seen += draws
    return out


def _range_of(splitters: list[Key]) -> Column:
    """The number of splitters at or before the key: those with smaller leading bits, and of those with its own, by comparison."""
    lead = F.shiftright(F.col("hash"), 64 - LEAD) + F.lit(1 << LEAD - 1)
    slots: list[list[Key]] = [[] for _ in range(1 << LEAD)]
    for key in splitters:
        slots[(key[0] >> 64 - LEAD) + (1 << LEAD - 1)].append(key)
    before, seen = [], 0
    for s in slots:
        before.append(seen)
        seen += len(s)
    at = lead.cast("int") + 1
    base = F.element_at(F.expr(f"array({','.join(map(str, before))})"), at)
    if not splitters:
        return F.lit(0)
    own = F.element_at(F.from_json(F.lit(str([[list(k) for k in s] for s in slots]).replace(" ", "")), "array<array<array<bigint>>>"), at)
    later = F.filter(own, lambda k: (k[0] < F.col("hash")) | ((k[0] == F.col("hash")) & ((k[1] < _id()) | ((k[1] == _id()) & (k[2] <= F.col("dice"))))))
    return base + F.size(later)


def shards(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row; other columns are left out.

    A null text has no bytes (size 8) and stands with the other null texts; a null doc_id comes first among its copies.
    Rows alike in all columns are interchangeable, and a shard may end between them. Fewer records than shards leave
    shards empty; no rows give none.
    """
    rows = materialise(slim(docs, id_col, text_col), "slim")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = min(MOST_RANGES, max(RANGES, n // RECORDS))
    share = total / ranges
    cuts = _splitters(_drawn(rows, share / DRAWN, 0), ranges)
    for seed in range(1, ROUNDS + 1):
        placed = rows.withColumn("range", _range_of(cuts))
        found = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.max("size").alias("largest"))
        over = {r.range: r.bytes for r in found.where(F.col("bytes") - F.col("largest") > OVERFULL * share).collect()}  # at most a row for each range
        if not over:
            break
        # As many parts as the bytes there are shares, and one more: together no more than there are ranges.
        parts = sum(int(b // share) + 1 for b in over.values())
        more = _drawn(placed.where(F.col("range").isin(sorted(over))), sum(over.values()) / (parts * DRAWN), seed)
        cuts = sorted({*cuts, *_splitters(more, parts)})
    else:
        raise RuntimeError("ranges stayed overfull")
    placed = rows.withColumn("range", _range_of(cuts))
    found = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    begins = found.select("range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "rows")])
    inside = Window.partitionBy("range").orderBy("hash", "doc_id", "dice").rowsBetween(Window.unboundedPreceding, -1)
    own = placed.select("*", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("own_bytes"), F.count("*").over(inside).alias("own_rows"))
    at = own.join(begins, "range")
    middle = F.col("bytes_before") + F.col("own_bytes") + F.floor(F.col("size") / 2)
    shard = F.least(F.floor(middle * n_shards / F.lit(total)), F.lit(n_shards - 1)).cast("int")
    numbered = at.select("doc_id", "size", "text_crc32", "range", shard.alias("shard"), (F.col("rows_before") + F.col("own_rows")).alias("row"))
    first = numbered.groupBy("shard").agg(F.min("row").alias("first"))
    return numbered.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))
