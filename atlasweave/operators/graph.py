"""Connected components of accepted match edges."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import shared_folder


def _written(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back, so that rounds don't pile up in one plan."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/edges-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path  # noqa: SLF001  for _released()
    return out


def _released(df: DataFrame) -> None:
    """Deletes a table of _written() that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch_path)  # noqa: SLF001
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001


def _starred(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return edges.join(least, edges.a == least.n).select("a", "b", "m")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (the smallest node reached) of each node of edges (a, b) but the smallest of a component itself.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest neighbour; the rounds grow as
    the logarithm of the longest path. A hub is only in minima, which are partly taken before the shuffle, and in joins
    that adaptive execution can split.
    """
    now, before = _written(edges.select("a", "b").where("a <> b").distinct()), None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _starred(both).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = _starred(large.distinct())
        linked = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        last, now = now, _written(linked.where("a <> b").distinct())
        _released(last)
        digest = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if digest == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = digest
    raise RuntimeError("the components did not settle")


def components_within(points: DataFrame, point_id: str, radius_m: float, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """node and component, as components() of all pairs of points at most radius_m apart, without listing the pairs.

    Cells are so small that any two points of one are within the radius, so a cell is a node, and points cost no edges. Two
    cells whose outermost points are near enough link; of those that still are in different components after that, all
    positions are compared. Only edges between cells are written.
    """
    from . import joins

    chord = 2 * math.sin(min(radius_m / geo.RADIUS_M, math.pi) / 2) * 0.999
    rows = math.ceil(180 / math.degrees(chord / math.sqrt(2)))
    high = 180 / rows
    row = F.least(F.floor((F.col(lat) + 90) / high), F.lit(rows - 1))
    south = F.col("_row") * high - 90
    # Of a row's latitudes the one nearest to the equator, where its cells are widest.
    least = F.when((south <= 0) & (south + high >= 0), 0.0).otherwise(F.least(F.abs(south), F.abs(south + high)))
    n = F.greatest(F.ceil(360 / F.lit(high) * F.cos(F.radians(least))), F.lit(1))
    known = points.where(geo.valid(lat, lng) & F.col(point_id).isNotNull()).select(F.col(point_id).alias("node"), F.col(lat).alias("lat"), F.col(lng).alias("lng"), row.alias("_row"))
    own = _written(known.withColumn("_col", F.least(F.floor((F.col("lng") + 180) / (F.lit(360.0) / n)), n - 1)).select("node", "lat", "lng", (F.col("_row") * 2**31 + F.col("_col")).alias("cell")))

    at = F.struct("lat", "lng")
    ends = F.array(F.min_by(at, "lat"), F.max_by(at, "lat"), F.min_by(at, "lng"), F.max_by(at, "lng"))
    cells = own.groupBy("cell").agg(F.min("node").alias("least"), ends.alias("ends"), (F.count("*") <= 2).alias("few")).withColumn("_row", F.floor(F.col("cell") / 2**31))
    cells = _written(cells.select("cell", "least", "ends", "few", (south + high / 2).alias("lat"), ((F.col("cell") % 2**31 + 0.5) * (F.lit(360.0) / n) - 180).alias("lng")))
    # A point is at most half the radius from its cell's centre.
    met = joins.spatial_join(cells.select("cell", "lat", "lng"), cells.select("cell", "lat", "lng"), 2.002 * radius_m).where("l_cell > r_cell")
    left, right = (cells.select(F.col("cell").alias(c), F.col("ends").alias(f"ends_{c}"), F.col("few").alias(f"few_{c}")) for c in "ab")
    close = lambda x, y: geo.haversine(x["lat"], x["lng"], y["lat"], y["lng"]) <= radius_m
    both = met.select(F.col("l_cell").alias("a"), F.col("r_cell").alias("b"), *[F.col(f"{p}_{c}") for p in "lr" for c in ("lat", "lng")]).join(left, "a").join(right, "b")
    pairs = _written(both.withColumn("near", F.exists("ends_a", lambda x: F.exists("ends_b", lambda y: close(x, y)))).drop("ends_a", "ends_b"))
    # The ends of two points are all there is.
    apart = pairs.where("not near and not (few_a and few_b)")
    # One point in several places joins their cells.
    often = own.groupBy("node").agg(F.min("cell").alias("b"), F.max("cell").alias("hi")).where("b <> hi").select("node", "b")
    edges = _written(pairs.where("near").select("a", "b").unionByName(own.join(often, "node").where("cell <> b").select(F.col("cell").alias("a"), "b")))
    found = components(edges)
    named = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    rest = None
    if not apart.isEmpty():
        rest = apart.join(named("a"), "a", "left").join(named("b"), "b", "left")
        rest = _written(rest.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b", "l_lat", "l_lng", "r_lat", "r_lng"))
    if rest is not None and not rest.isEmpty():
        spots = own.select("cell", "lat", "lng").distinct()
        reach = 1.502 * radius_m
        near_b = rest.join(spots, F.col("a") == F.col("cell")).where(geo.haversine("lat", "lng", "r_lat", "r_lng") <= reach).select("a", "b", F.col("lat").alias("x"), F.col("lng").alias("y"))
        near_a = rest.join(spots, F.col("b") == F.col("cell")).where(geo.haversine("lat", "lng", "l_lat", "l_lng") <= reach).select("a", "b", "lat", "lng")
        more = near_b.join(near_a, ["a", "b"]).where(geo.haversine("x", "y", "lat", "lng") <= radius_m).select("a", "b").distinct()
        found = components(edges.unionByName(more))
    roots = cells.select("cell", "least").join(found, F.col("cell") == found.node, "left").select("cell", "least", F.coalesce("component", "cell").alias("root"))
    least_of = roots.groupBy("root").agg(F.min("least").alias("component"))
    named_cells = roots.join(least_of, "root").select("cell", "component")
    return own.select("node", "cell").join(named_cells, "cell").where("node <> component").select("node", "component").distinct()


def labelled(units: DataFrame, edges: DataFrame, unit_id: str = "unit_id") -> DataFrame:
    """units with cluster_id: the component of a linked unit, else its own id."""
    found = components(edges)
    return units.join(found, units[unit_id] == found.node, "left").withColumn("cluster_id", F.coalesce("component", F.col(unit_id))).drop("node", "component")
