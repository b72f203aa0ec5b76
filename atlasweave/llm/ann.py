"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, results merged.

Rows with one vector are one node, which keeps the smallest ``k + 1`` of their ids: no more can be among a query's k
nearest, as ties go to smaller ids, so a vector that a third of the rows share neither breaks the graph nor costs
accuracy. Nodes are dealt to shards by a hash of the vector. A shard's graph is stored as a row of flat arrays: vectors,
ids, and for each layer its nodes and their neighbours (fixed width, -1 where there is none).

Graphs are built and searched in numpy for many points at once: points enter in growing batches, each batch looks for
its neighbours in the graph so far and in itself, keeps those that are nearer to the point than to each other, and is
linked back. Graphs hold 32-bit copies of vectors (scaled by a power of two where they are very large or small); what they
find is measured on the original vectors in double precision.

Every query meets every shard. A graph is shuffled once, to the task that holds its shard; blocks of ``BLOCK`` queries
then stream past it, so a task holds one graph and one block. A shard holds about ``GROWTH`` times the square root of the
number of nodes (``LEAST`` to ``MOST``), so that queries times shards grow as the power 1.5 of the rows until ``MOST``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, materialise

LEAST, MOST, GROWTH, BLOCK = 12_000, 100_000, 50, 2048
WIDTH, EF_BUILD, EF_SEARCH = 16, 64, 96
#: Candidates that a beam opens at once.
OPEN = 4
ENTER = 1024


@dataclass
class Graph:
    vectors: np.ndarray  # float32, a row for each node
    layers: list[tuple[np.ndarray, np.ndarray]]  # from the bottom: nodes, neighbours (places among these nodes)

    def _beam(self, layer: int, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        return beam(self.vectors[self.layers[layer][0]] if layer else self.vectors, self.layers[layer][1], queries, entry, ef)

    def search(self, queries: np.ndarray, ef: int = EF_SEARCH) -> np.ndarray:
        """Nodes nearest to each query, -1 where there are fewer; down the layers from the top one's first node."""
        at = np.zeros((len(queries), 1), np.int64)
        for layer in range(len(self.layers) - 1, 0, -1):
            found, _ = self._beam(layer, queries, at, 8)
            nodes, below = self.layers[layer][0], self.layers[layer - 1][0]
            own = nodes[np.maximum(found, 0)]
            at = np.where(found >= 0, np.searchsorted(below, own), -1)
        return self._beam(0, queries, at, ef)[0]


def beam(vectors: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances) of the ef best found by a best-first search from entry (-1: none), all queries at once."""
    n, width = len(queries), neighbours.shape[1]
    seen = np.zeros((n, len(vectors) + 1), bool)  # the last column stands for "no node"
    seen[:, -1] = True
    best, dist = np.full((n, ef), -1), np.full((n, ef), np.inf, np.float32)
    opened = np.ones((n, ef), bool)
    new = entry
    live = np.arange(n)
    while len(live):
        new = np.sort(new, 1)
        new = np.where(seen[live[:, None], new], -1, new)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        seen[live[:, None], new] = True
        seen[live, -1] = True
        gap = vectors[new] - queries[live, None]
        own = np.einsum("qkd,qkd->qk", gap, gap)
        own[new < 0] = np.inf
        all_nodes, all_dist = np.concatenate([best[live], new], 1), np.concatenate([dist[live], own], 1)
        all_open = np.concatenate([opened[live], new < 0], 1)
        order = np.argsort(all_dist, 1, kind="stable")[:, :ef]
        best[live], dist[live], opened[live] = (np.take_along_axis(x, order, 1) for x in (all_nodes, all_dist, all_open))
        closed = ~opened[live]
        some = closed.any(1)
        live = live[some]
        if not len(live):
            break
        closed = closed[some]
        first = np.argsort(~closed, 1, kind="stable")[:, :OPEN]  # nearest that aren't open yet; dist is sorted
        use = np.take_along_axis(closed, first, 1)
        chosen = np.where(use, np.take_along_axis(best[live], first, 1), -1)
        opened[live[:, None], first] = True
        new = np.where(chosen[..., None] >= 0, neighbours[chosen], -1).reshape(len(live), OPEN * width)
    return best, dist


def diverse(vectors: np.ndarray, points: np.ndarray, nodes: np.ndarray, dist: np.ndarray, width: int) -> np.ndarray:
    """Of each point's candidates (by distance), those that are nearer to the point than to a chosen one; then the nearest others up to width."""
    n, m = nodes.shape
    own = vectors[np.maximum(nodes, 0)]
    chosen = np.full((n, width), -1)
    count, taken = np.zeros(n, int), np.zeros((n, m), bool)
    near = np.full((n, m), np.inf, np.float32)  # distance to the nearest chosen
    for j in range(m):
        good = (nodes[:, j] >= 0) & (dist[:, j] < near[:, j]) & (count < width)
        at = np.flatnonzero(good)
        if not len(at):
            continue
        chosen[at, count[at]] = nodes[at, j]
        count[at] += 1
        taken[at, j] = True
        gap = own[at] - own[at, j][:, None]
        near[at] = np.minimum(near[at], np.einsum("pkd,pkd->pk", gap, gap))
    for j in range(m):
        at = np.flatnonzero((nodes[:, j] >= 0) & ~taken[:, j] & (count < width))
        chosen[at, count[at]] = nodes[at, j]
        count[at] += 1
    return chosen


def _insert(vectors: np.ndarray, neighbours: np.ndarray, done: int, more: int, entry: np.ndarray) -> None:
    """Links places done to done + more to those before them and to each other."""
    width = neighbours.shape[1]
    points = vectors[done : done + more]
    square = (points**2).sum(1)
    among = square[:, None] + square[None] - 2 * points @ points.T
    np.fill_diagonal(among, np.inf)
    k = min(EF_BUILD // 2, more - 1)
    near = np.argpartition(among, k - 1, 1)[:, :k] if k > 0 else np.zeros((more, 0), int)
    nodes, dist = near + done, np.take_along_axis(among, near, 1)
    if done:
        old, old_dist = beam(vectors[:done], neighbours[:done], points, entry, EF_BUILD)
        nodes, dist = np.concatenate([nodes, old], 1), np.concatenate([dist, old_dist], 1)
    order = np.argsort(dist, 1, kind="stable")[:, :EF_BUILD]
    nodes, dist = np.take_along_axis(nodes, order, 1), np.take_along_axis(dist, order, 1)
    chosen = diverse(vectors, points, nodes, dist, width // 2 if width > WIDTH else width)
    neighbours[done : done + more, : chosen.shape[1]] = chosen
    # Back links: each chosen node gets the point; a full list keeps a diverse choice of old and new.
    a, b = np.repeat(np.arange(done, done + more), chosen.shape[1]), chosen.ravel()
    a, b = a[b >= 0], b[b >= 0]
    order = np.argsort(b, kind="stable")
    a, b = a[order], b[order]
    target, start, count = np.unique(b, return_index=True, return_counts=True)
    cap = min(int(count.max(initial=0)), 4 * width)
    new = np.full((len(target), cap), -1)
    place = np.arange(len(b)) - np.repeat(start, count)
    fit = place < cap
    new[np.repeat(np.arange(len(target)), count)[fit], place[fit]] = a[fit]
    for k in range(0, len(target), ENTER):
        own = target[k : k + ENTER]
        both = np.concatenate([neighbours[own], new[k : k + ENTER]], 1)
        both.sort(1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        gap = vectors[np.maximum(both, 0)] - vectors[own][:, None]
        dist = np.einsum("pkd,pkd->pk", gap, gap)
        dist[both < 0] = np.inf
        order = np.argsort(dist, 1, kind="stable")[:, : 3 * width]
        both, dist = np.take_along_axis(both, order, 1), np.take_along_axis(dist, order, 1)
        neighbours[own] = diverse(vectors, vectors[own], np.where(np.isfinite(dist), both, -1), dist, width)


def build(vectors: np.ndarray, seed: int = 1) -> Graph:
    """The graph of all vectors (distinct, in a random order); layer l has about 1 in WIDTH**l of them."""
    n = len(vectors)
    level = np.minimum((-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(WIDTH)).astype(int), 6)
    if n:
        level[0] = max(int(level.max()), 0)
    layers: list[tuple[np.ndarray, np.ndarray]] = []
    top = int(level.max()) if n else 0
    graph = Graph(vectors, layers)
    built: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for layer in range(top, -1, -1):
        nodes = np.flatnonzero(level >= layer)
        own = vectors[nodes]
        neighbours = np.full((len(nodes), 2 * WIDTH if layer == 0 else WIDTH), -1)
        done = 0
        while done < len(nodes):
            more = min(max(32, done // 2), ENTER, len(nodes) - done)
            entry = np.zeros((more, 1), np.int64)
            if layer < top and done:
                # The layers above are whole; their nodes that are linked here already lead in.
                points = own[done : done + more]
                at = np.zeros((more, 1), np.int64)
                for upper in range(top, layer, -1):
                    up_nodes, up_neighbours = built[upper]
                    found, _ = beam(vectors[up_nodes], up_neighbours, points, at, 8)
                    below = built[upper - 1][0] if upper - 1 > layer else nodes
                    at = np.where(found >= 0, np.searchsorted(below, up_nodes[np.maximum(found, 0)]), -1)
                entry = np.concatenate([entry, np.where(at < done, at, -1)], 1)
            _insert(own, neighbours, done, more, entry)
            done += more
        built[layer] = (nodes, neighbours)
    layers += [built[layer] for layer in range(top + 1)] if n else [(np.zeros(0, int), np.zeros((0, 2 * WIDTH), int))]
    return graph


# --- the operator --------------------------------------------------------------------------------------------------

GRAPH = "n int, scale double, members binary, vectors binary, layers array<struct<nodes:binary,neighbours:binary>>"
STORED = f"dim int, shard int, place int, {GRAPH}"
#: Cells of the table of seen nodes that a search holds.
SEEN = 25_000_000


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and v of rows whose vector is not null, not zero and finite in all components; components are floats if they come so, else doubles."""
    kind = "array<float>" if dict(rows.dtypes)[vec_col] == "array<float>" else "array<double>"
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("v")).where("vec_id is not null and v is not null")
    return own.where(finite & F.exists("v", lambda x: x != 0))


def _dtype(rows: DataFrame) -> type:
    return np.float32 if dict(rows.dtypes)["v"] == "array<float>" else np.float64


def shard_size(nodes: Column) -> Column:
    return F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.sqrt(nodes) * GROWTH))


def scale_of(vectors: np.ndarray) -> float:
    """A power of two that brings very large or small components near one; else one."""
    most = float(np.abs(vectors).max(initial=0))
    return 1.0 if 1e-6 <= most <= 1e6 or not most else 2.0 ** -int(np.clip(np.log2(most), -1000, 1000))


def scaled(vectors: np.ndarray, scale: float) -> np.ndarray:
    return np.ascontiguousarray(np.clip(vectors * scale, -1e15, 1e15) if scale != 1 else vectors, np.float32)


def index(rows: DataFrame, k: int, shard: int | None = None) -> DataFrame:
    """STORED rows, one for each shard, of usable() rows: every distinct vector is a node of one of them. shard: nodes of one, about; None: by their number."""
    first, dtype = Window.partitionBy("v").orderBy("vec_id"), _dtype(rows)
    members = rows.withColumn("_n", F.dense_rank().over(first)).where(F.col("_n") <= k + 1)  # limited before the shuffle
    nodes = members.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    nodes = materialise(nodes.select("v", "ids", F.size("v").alias("dim"), F.xxhash64("v", F.lit(4)).alias("key")), "nodes")
    size = shard_size(F.col("count")) if shard is None else F.lit(shard)
    shards = nodes.groupBy("dim").count().select("dim", F.greatest(F.lit(1), F.round(F.col("count") / size)).cast("long").alias("shards"))
    before = Window.orderBy("dim").rowsBetween(Window.unboundedPreceding, -1)  # a row for each length of vector
    shards = materialise(shards.withColumn("before", F.coalesce(F.sum("shards").over(before), F.lit(0))), "shards")
    total = shards.agg(F.sum("shards")).first()[0] or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:  # one shard
            yield from built(pa.Table.from_batches(held)).to_batches()

    def built(own: pa.Table) -> pa.Table:
        dim, number, place = (own[c][0].as_py() for c in ("dim", "shard", "place"))
        order = np.argsort(own["key"].to_numpy(), kind="stable")
        vectors = own["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(dtype)[order]
        ids = np.zeros((len(order), k + 2), np.int64)  # how many, and they
        for i, j in enumerate(order.tolist()):
            one = own["ids"][j].as_py()
            ids[i, 0], ids[i, 1 : len(one) + 1] = len(one), one
        scale = scale_of(vectors)
        layers = [{"nodes": a.astype(np.int32).tobytes(), "neighbours": b.astype(np.int32).tobytes()} for a, b in build(scaled(vectors, scale)).layers]
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "shard": pa.array([number], pa.int32()), "place": pa.array([place], pa.int32()), "n": pa.array([len(order)], pa.int32()), "scale": pa.array([scale]), "members": pa.array([ids.tobytes()]),
            "vectors": pa.array([vectors.tobytes()]), "layers": pa.array([layers], pa.list_(pa.struct([("nodes", pa.binary()), ("neighbours", pa.binary())]))),
        })

    # A task for each shard: graphs are small to move and long to build, so adaptive execution must not put them together.
    dealt = nodes.join(shards, "dim").withColumn("shard", F.pmod("key", "shards").cast("int"))
    dealt = dealt.select("v", "ids", "dim", "key", "shard", (F.col("before") + F.col("shard")).cast("int").alias("place"))
    return mapped(dealt.repartitionById(total, "place"), run, STORED, "ann")


@dataclass
class Shard:
    """A stored graph; vectors (as they came) and ids are views of its bytes."""

    graph: Graph
    vectors: np.ndarray
    held: np.ndarray
    ids: np.ndarray
    scale: float

    @classmethod
    def of(cls, row: dict, dtype: type) -> Shard:
        vectors = np.frombuffer(row["vectors"], dtype).reshape(row["n"], -1)
        layers = []
        for i, layer in enumerate(row["layers"]):
            nodes = np.frombuffer(layer["nodes"], np.int32)
            layers.append((nodes, np.frombuffer(layer["neighbours"], np.int32).reshape(len(nodes), 2 * WIDTH if i == 0 else WIDTH)))
        members = np.frombuffer(row["members"], np.int64).reshape(row["n"], -1)
        return cls(Graph(scaled(vectors, row["scale"]), layers), vectors, members[:, 0], members[:, 1:], row["scale"])

    def nearest(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, distance) of the k nearest rows found for each query; ties by id."""
        found = self.graph.search(scaled(queries, self.scale))
        nodes = np.maximum(found, 0)
        gap = self.vectors[nodes].astype(np.float64) - queries.astype(np.float64)[:, None]
        with np.errstate(over="ignore"):
            dist = np.sqrt((gap * gap).sum(2))
            far = np.isinf(dist)
            if far.any():  # squares beyond a double; the scale is a power of two, so it costs no digit
                dist[far] = np.sqrt(((gap[far] * self.scale) ** 2).sum(1)) / self.scale
        dist[found < 0] = np.inf
        near = np.lexsort((self.ids[nodes, 0], dist), axis=1)[:, :k]
        nodes, dist = (np.take_along_axis(x, near, 1) for x in (nodes, dist))
        ids = self.ids[nodes]
        none = (np.arange(ids.shape[2]) >= self.held[nodes][..., None]) | np.isinf(dist)[..., None] & (np.take_along_axis(found, near, 1) < 0)[..., None]
        ids, none, dist = ids.reshape(len(ids), -1), none.reshape(len(ids), -1), np.repeat(dist, ids.shape[2], 1)
        order = np.lexsort((ids, dist, none), axis=1)[:, :k]
        ids, dist, none = (np.take_along_axis(x, order, 1) for x in (ids, dist, none))
        return np.repeat(np.arange(len(queries)), (~none).sum(1)), ids[~none], dist[~none]


def search(stored: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score and query_hash of the k nearest rows (not the query's own) of each of queries (usable() rows).

    stored: index(..., k), written. Queries with one vector are searched once.
    """
    kind, dtype = dict(queries.dtypes)["v"], _dtype(queries)
    element = pa.float32() if dtype is np.float32 else pa.float64()
    asked = queries.select("v").distinct().select("v", F.size("v").alias("dim"), F.xxhash64("v", F.lit(6)).alias("key"))
    counts = asked.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    blocks = asked.join(counts, "dim").groupBy("dim", F.pmod("key", "blocks").alias("block")).agg(F.collect_list("v").alias("asked"))  # about BLOCK
    total = stored.agg(F.count("*")).first()[0] or 1
    # The stated queries meet every shard of their length, a block of them at a time.
    sent = blocks.join(stored.select("dim", "shard", "place"), "dim")
    dealt = stored.withColumn("asked", F.lit(None).cast(f"array<{kind}>")).unionByName(sent.select("dim", "shard", "place", "asked"), allowMissingColumns=True)
    dealt = dealt.withColumn("turn", F.col("asked").isNotNull()).repartitionById(total, "place").sortWithinPartitions("dim", "shard", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = None, None
        for batch in batches:
            for k_row in range(batch.num_rows):
                row = batch.slice(k_row, 1)
                place = (row["dim"][0].as_py(), row["shard"][0].as_py())
                if not row["turn"][0].as_py():
                    own, at = Shard.of({c: row[c][0].as_py() for c in ("n", "scale", "members", "vectors", "layers")}, dtype), place
                elif at == place:
                    flat = row["asked"].flatten()
                    vectors = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(dtype)
                    step = max(16, min(256, SEEN // len(own.vectors)))
                    for start in range(0, len(vectors), step):
                        query, ids, scores = own.nearest(vectors[start : start + step], k + 1)
                        yield pa.record_batch([flat.take(pa.array(query + start)).cast(pa.list_(element)), pa.array(ids), pa.array(scores)], ["v", "vec_id", "score"])

    found = mapped(dealt, run, f"v {kind}, vec_id long, score double", "ann")
    best = Window.partitionBy("v").orderBy("score", "vec_id")
    merged = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n")
    own = queries.select(F.col("vec_id").alias("query_id"), "v").join(merged, "v").where("query_id <> vec_id or score > 0")
    rank = F.row_number().over(Window.partitionBy("query_id", "v").orderBy("score", "vec_id"))
    return own.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score", F.xxhash64("v").alias("query_hash")).where(F.col("rank") <= k)


def neighbours(rows: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", shard: int | None = None) -> DataFrame:
    """The k nearest other rows, by Euclidean distance, of each row whose vec_id satisfies is_query.

    Null, zero and non-finite vectors and null ids take no part; vectors of another length are never near. Rows are what is
    searched: repeated rows (one id, one vector) count once; an id that stands on several vectors is as many candidates,
    each at its own rank, and as many queries, told apart by query_hash, of which only the row itself is no candidate.
    Fewer candidates than k: all of them. A distance beyond a double's range is infinite. Other columns are left out; no
    rows give none.
    """
    own = usable(rows, id_col, vec_col).distinct()
    stored = materialise(index(own, k, shard), "graphs")
    return search(stored, own.where(is_query(F.col("vec_id"))), k)
