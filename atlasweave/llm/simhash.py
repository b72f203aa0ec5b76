"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has bit b set if more than half of its shingle hashes have it. Documents link at ``RADIUS`` = 2
or fewer differing bits; a group is a connected component of links.

Covering masks: bit i gets the vector m(i) = 1 + i mod 7 of GF(2)^3, and table v (1 to 7) keeps the bits with odd
parity of m(i) & v. Two or fewer differing bits span at most two dimensions, so some non-zero v is orthogonal to all of
them: in that table both fingerprints look the same. Every pair within the radius meets in one of seven tables, with
certainty, on keys of 36 or 37 bits.

A bucket can be large, so its pairs are never listed. Two fingerprints of one bucket are within two bits of each other
exactly if some centre is within one bit of both, and a centre has at most 65 neighbours. Each member of a bucket that
holds two or more fingerprints therefore meets the others under its centres (itself, and itself with one unmasked bit
turned), in groups of at most 65, whatever the size of the bucket.

``met`` takes the masks further, to ``NEAR`` = 11 bits: of the two halves of a fingerprint one differs in 5 bits at most,
and 63 masks cover these as 7 cover two (m(i) in GF(2)^6; as the vectors of a Reed-Muller code, each mask keeps 16 of the
32 bits). Fingerprints that share a key needn't be that near, so they are compared whole, with the bucket's leaders only.
Unlike links, these candidates await a check of their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, mapped, materialise, release

SEED = 42
SHINGLE = 3
BITS = 64
RADIUS = 2
TABLES = 2 ** (RADIUS + 1) - 1
#: Differing bits of candidates, and the tables that each half of a fingerprint takes for them.
NEAR, HALF_TABLES = 11, 63
#: Keys that one task compares.
TASK_KEYS = 1_000_000
#: Shingle hashes that are held at once, and the most in a 16-bit counter.
HELD, COUNTER = 1_000_000, 65_535
#: Tasks at least, and rows of edges that fill one.
LEAST_TASKS, TASK_ROWS = 12, 250_000
ONES = np.uint64(0x0001_0001_0001_0001)


def mask(v: int) -> int:
    """The bits that table v keeps."""
    return sum(1 << i for i in range(BITS) if ((1 + i % TABLES) & v).bit_count() % 2)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(raw: bytes, width: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle of width words of a text, repeats included."""
    words = raw.lower().split()  # bytes: A-Z only, and splits at \x20 and \x09 to \x0D only
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of documents whose hashes stand one after another; counts: how many each has."""
    out = np.zeros(len(counts), np.uint64)
    doc = np.repeat(np.arange(len(counts)), -(-counts // COUNTER))
    if not len(doc):
        return out
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    part = np.arange(len(doc)) - np.searchsorted(doc, doc)
    starts = first[doc] + part * COUNTER
    half = counts // 2
    for k in range(16):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & ONES, starts).view(np.uint16).reshape(-1, 4).astype(np.int64)
        total = np.zeros((len(counts), 4), np.int64)
        np.add.at(total, doc, lanes)
        for lane in range(4):
            out |= (total[:, lane] > half).astype(np.uint64) << np.uint64(16 * lane + k)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, hashes, counts = [], [], []
        held = 0

        def flush() -> None:
            flat = np.fromiter((h for x in hashes for h in x), np.uint64, held)
            prints.append(majority(flat, np.array(counts, np.int64)))

        for raw in batch.column(1).cast(pa.binary()):
            found = shingle_hashes(raw.as_py() or b"")
            hashes.append(found)
            counts.append(len(found))
            held += len(found)
            if held >= HELD:
                flush()
                hashes, counts, held = [], [], 0
        flush()
        yield pa.record_batch([batch.column(0), pa.array(np.concatenate(prints).view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marked: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every row, and mark, a hash of its text, if asked for; null and empty texts have fingerprint zero."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *[F.xxhash64(text).alias("mark")] * marked)
    return mapped(rows, _fingerprints, "doc_id long, fp long" + ", mark long" * marked)


def _table_keys(fp: Column) -> Column:
    return F.array(*[F.struct(F.lit(v).alias("v"), fp.bitwiseAND(F.lit(signed(mask(v)))).alias("key")) for v in range(1, TABLES + 1)])


def _turned(v: int, fp: Column) -> Column:
    """The centres of a fingerprint in table v: itself, and itself with one bit turned that the table doesn't keep."""
    free = [i for i in range(BITS) if not mask(v) >> i & 1]
    return F.array(fp, *[fp.bitwiseXOR(F.lit(signed(1 << i))) for i in free])


def links(prints: DataFrame) -> DataFrame:
    """From distinct fingerprints (fp): edges (a, b), b < a, within the radius, that connect all that links connect."""
    keyed = prints.select("fp", F.explode(_table_keys(F.col("fp"))).alias("k")).select("fp", "k.v", "k.key")
    shared = keyed.groupBy("v", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("v", "key")
    met = keyed.join(shared, ["v", "key"], "left_semi").select("v", "fp")
    turned = F.when(F.col("v") == 1, _turned(1, F.col("fp")))
    for v in range(2, TABLES + 1):
        turned = turned.when(F.col("v") == v, _turned(v, F.col("fp")))
    near = met.select("fp", F.explode(turned).alias("centre"))
    groups = near.groupBy("centre").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    return groups.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b").distinct()


def near_masks() -> np.ndarray:
    """The bits that each of the 126 tables for ``NEAR`` bits keeps: the even ones of a fingerprint, then the odd ones."""
    return np.array([sum(1 << (2 * i + half) for i in range(BITS // 2) if ((32 + i) & v).bit_count() % 2) for half in (0, 1) for v in range(1, HALF_TABLES + 1)], np.uint64)


def _spread(x: np.ndarray) -> np.ndarray:
    """A hash of whole numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E37_79B9_7F4A_7C15)
    return x ^ (x >> np.uint64(29))


def _keyed(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The fingerprints of a batch in each table, by part: what shares a key in a table has one part."""
    masks = near_masks()
    step = TASK_KEYS // len(masks)
    for batch in batches:
        whole = batch.column(0).to_numpy().view(np.uint64)
        for k in range(0, len(whole), step):
            fps = whole[k : k + step]
            part = np.concatenate([_spread(_spread(fps & m) + np.uint64(v)) % np.uint64(parts) for v, m in enumerate(masks)]).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.cumsum(np.bincount(part, minlength=parts)).tolist()
            rows = []
            for n, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                if a < b:
                    at = order[a:b]
                    rows.append((n, (at // len(fps)).astype(np.uint8).tobytes(), fps[at % len(fps)].tobytes()))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "tables", "fps"])


def nearest_leaders(tables: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints, the nearest leader of each in its buckets, and their distance, if that is ``NEAR`` or less.

    A bucket's first fingerprint leads; those near it follow it, and the first of the others leads the rest.
    """
    keys = fps & near_masks()[tables]
    order = np.lexsort((fps, keys, tables))
    tables, keys, fps = tables[order], keys[order], fps[order]
    new = np.ones(len(fps), bool)
    new[1:] = (tables[1:] != tables[:-1]) | (keys[1:] != keys[:-1])
    bucket = np.cumsum(new)
    found = []
    while len(fps):
        new = np.ones(len(fps), bool)
        new[1:] = bucket[1:] != bucket[:-1]
        first = np.flatnonzero(new)
        lead = np.repeat(fps[first], np.diff(np.append(first, len(fps))))
        bits = np.bitwise_count(fps ^ lead)
        near = bits <= NEAR
        told = near & (fps != lead)
        found.append((fps[told], lead[told], bits[told]))
        fps, bucket = fps[~near], bucket[~near]
    if not found:
        return fps, fps, np.zeros(0, np.uint8)
    a, b, bits = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((b, bits, a))
    a, b, bits = a[order], b[order], bits[order]
    first = np.ones(len(a), bool)
    first[1:] = a[1:] != a[:-1]
    return a[first], b[first], bits[first]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [(np.frombuffer(a.as_py(), np.uint8), np.frombuffer(b.as_py(), np.uint64)) for batch in batches for a, b in zip(batch.column(0), batch.column(1), strict=True)]
    if found:
        a, b, bits = nearest_leaders(*(np.concatenate(x) for x in zip(*found, strict=True)))
        yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(bits.astype(np.int32))], ["a", "b", "bits"])


def near_links(prints: DataFrame) -> DataFrame:
    """From distinct fingerprints (fp): candidates (a, b), the nearest that each meets within ``NEAR`` bits; at most one row for each."""
    parts = max(LEAST_TASKS, prints.count() * 2 * HALF_TABLES // TASK_KEYS)
    dealt = mapped(prints.select("fp").repartition(parts, "fp"), lambda batches: _keyed(batches, parts), "part long, tables binary, fps binary")
    near = mapped(dealt.repartition(parts, "part").select("tables", "fps"), _compared, "a long, b long, bits int")
    return near.groupBy("a").agg(F.min(F.struct("bits", "b")).alias("m")).select("a", F.col("m.b").alias("b"))


def met(docs_fp: DataFrame) -> DataFrame:
    """Of rows (fp, mark): pairs (a, b) of marks, texts whose fingerprints are equal or meet within ``NEAR`` bits; at most two rows for each text."""
    heads = materialise(docs_fp.groupBy("fp").agg(F.min("mark").alias("head")), "heads")
    equal = docs_fp.select("fp", "mark").distinct().join(heads, "fp").where("mark <> head").select(F.col("mark").alias("a"), F.col("head").alias("b"))
    x, y = (heads.select(F.col("fp").alias(fp), F.col("head").alias(f"head_{fp}")) for fp in "ab")
    return equal.union(near_links(heads).join(x, "a").join(y, "b").select("head_a", "head_b"))


def _star(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour or itself, joined to the edges out of it."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return edges.join(least, edges.a == least.n).select("a", "b", "m")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the smallest node that it reaches) of every node with an edge (a, b).

    Alternating large and small stars: hubs only ever appear in a map-side minimum and in a join that adaptive
    execution can split; the number of rounds grows as the logarithm of the size.
    """
    now = materialise(edges.select("a", "b"), "edges")
    before = None
    for _ in range(rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = _star(down).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        # As many files as the edges need; there are at most as many as in the round before.
        then = materialise(small.coalesce(max(LEAST_TASKS, before[0] // TASK_ROWS)) if before else small, "edges")
        digest = then.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        release(now)
        now = then
        if digest == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = digest
    raise RuntimeError("the components did not settle")


def _placed(docs_fp: DataFrame) -> DataFrame:
    """Of rows (doc_id, fp): fp, the least doc_id that has it, and root, one fingerprint for each group."""
    prints = materialise(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(prints))
    return prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id (its group's smallest doc_id).

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat a doc_id each get a row.
    A null doc_id is kept; it is a group's smallest only if the group has no other. No rows: no rows.
    """
    docs_fp = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    placed = _placed(docs_fp)
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return docs_fp.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of docs for each root of groups (doc_id, mark, root; mark: XXH64 of the text): the smallest (doc_id, mark), a null doc_id last.

    Rows of one text have one root, so a doc_id and a mark name a root; of rows that share both, any stays. Columns of
    docs come back as they are, whatever their names.
    """
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("k"))
    own_id, own_mark, kept_id, kept_mark = fresh(docs, "_id", "_mark", "_kept", "_kept_mark")
    stay = first.select(F.col("k.doc_id").alias(kept_id), F.col("k.mark").alias(kept_mark))
    rows = docs.withColumns({own_id: F.col(id_col).cast("long"), own_mark: F.xxhash64(F.col(text_col).cast("string"))})
    kept = rows.join(stay, F.col(own_id).eqNullSafe(F.col(kept_id)) & (F.col(own_mark) == F.col(kept_mark)), "left_semi")
    return kept.dropDuplicates([own_id, own_mark]).select(*docs.columns)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: exactly one of each group, one with its smallest doc_id (null only if it has no other)."""
    docs_fp = materialise(fingerprints(docs, id_col, text_col, marked=True), "fingerprints")
    rooted = docs_fp.join(_placed(docs_fp).select("fp", "root"), "fp").select("doc_id", "mark", "root")
    return one_of_each(docs, rooted, id_col, text_col)
