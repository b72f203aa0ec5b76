"""What the review of the second round found, on tables that are larger or odder than the given ones."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from atlasweave.functions import geo
from atlasweave.operators import graph, joins
from atlasweave.plans import integrate, queries


@pytest.mark.parametrize("name, rows", [("kml_layers", 32_000), ("layer_parts", 5_000)])
def test_labels_of_many_parts(spark, tmp_path, name, rows):
    """More parts of a layer than letters, and than the 256 characters of chr()."""
    table = spark.range(rows).select(F.col("id").alias("p_partkey"), F.lit("MEDIUM").alias("p_type"), F.concat(F.lit("Brand#"), F.col("id") % 7).alias("p_brand"), F.lit("n").alias("p_name"))
    table.write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(map(tuple, queries.queries()[name](spark, str(tmp_path)).select(columns).collect())) == sorted(found.fetchall())


def test_labels_equal_sql(spark):
    """Parts by the ten thousand; the SQL has no label where there is no such character."""
    n = duckdb.connect().execute(f"select range, {queries._LABEL}, case when range < 55000 then chr(cast(65 + range as int)) end from (select range, cast(range as int) as n from range(0, 1400000, 211))").fetchall()
    got = spark.createDataFrame([(x[0],) for x in n], "n long").select("n", queries._wide_letter(F.col("n")).alias("a"), F.when(F.col("n") < 55000, queries._letter(F.col("n"))).alias("b")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(n, key=str)
    assert spark.range(1).select(queries._letter(F.lit(0xD800 - 65))).first()[0]


def _points(seed, n):
    """Clusters, lone points, the antimeridian, the poles and repeated positions: id, group, lat, lng."""
    rng = random.Random(seed)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(n // 3)] + [(rng.uniform(89.2, 90), rng.uniform(-180, 180)) for _ in range(12)]
    spots += [(rng.uniform(-1, 1), 180 - rng.uniform(0, 1.2)) for _ in range(15)] + [(rng.uniform(-1, 1), -180 + rng.uniform(0, 1.2)) for _ in range(15)]
    spots += [(48 + rng.gauss(0, 1.5), 11 + rng.gauss(0, 2)) for _ in range(n)]
    spots += rng.sample(spots, 20) + [(90.0, 5.0), (-90.0, 7.0), (0.0, 180.0), (0.0, -180.0)]
    return [(k, rng.choice("xyz"), *spot) for k, spot in enumerate(spots)]


def _metres(p, q):
    a, b, c, d = map(math.radians, (*p, *q))
    return 2 * geo.RADIUS_M * math.asin(min(1.0, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def _written_rows(monkeypatch):
    """How many rows each written table has."""
    seen, write = [], graph._written

    def counted(df):
        out = write(df)
        seen.append(out.count())
        return out

    monkeypatch.setattr(graph, "_written", counted)
    return seen


@pytest.mark.parametrize("radius", [150_000.0, 25_000.0])
def test_components_without_pairs(spark, monkeypatch, radius):
    """Brute force; no written table is as long as the pairs."""
    rows = _points(3, 300)
    root, pairs = list(range(len(rows))), 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, p in enumerate(rows):
        for q in rows[i + 1 :]:
            if _metres(p[2:], q[2:]) <= radius:
                pairs += 1
                a, b = sorted((find(p[0]), find(q[0])))
                root[b] = a
    seen = _written_rows(monkeypatch)
    got = graph.components_within(spark.createDataFrame([*rows, (None, "x", 1.0, 1.0), (999, "x", None, 1.0)], "k long, g string, lat double, lng double"), "k", radius)
    assert sorted(map(tuple, got.collect())) == sorted((k, find(k)) for k, *_ in rows if find(k) != k)
    assert radius < 100_000 or max(seen) < pairs / 2


def test_components_query_lists_no_pairs(spark, small, monkeypatch):
    monkeypatch.setattr(queries, "_near", None)
    assert queries.queries()["components"](spark, small).count() > 0


def test_mutual_nearest_of_groups(spark, small, monkeypatch):
    """Brute force, nearest in millimetres; all pairs are never joined."""
    rows = _points(5, 150)
    best = {}
    for p in rows:
        for q in rows:
            d = _metres(p[2:], q[2:]) if p[1] != q[1] else math.inf
            if d <= 150_000:
                key = (p[0], q[1])
                best[key] = min(best.get(key, (math.inf, 0)), (math.floor(d * 1000 + 0.5), q[0]))
    group = {r[0]: r[1] for r in rows}
    want = sorted((a, b, mm / 1000) for (a, _), (mm, b) in best.items() if a < b and best.get((b, group[a]), (0, -1))[1] == a)
    monkeypatch.setattr(joins, "spatial_join", None)
    got = joins.mutual_nearest_of_groups(spark.createDataFrame([*rows, (None, "x", 1.0, 1.0), (999, None, 1.0, 1.0)], "k long, g string, lat double, lng double"), "k", "g", 150_000.0).collect()
    assert len(want) > 50 and [r[:2] for r in sorted(map(tuple, got))] == [r[:2] for r in want]
    assert all(abs(x[2] - y[2]) < 0.0015 for x, y in zip(sorted(map(tuple, got)), want, strict=True))
    assert queries.queries()["mutual_best_pairs"](spark, small).count() > 0


def test_joins_are_not_broadcast_by_file_size(spark, small, monkeypatch):
    """A few columns of a compressed table look small to the planner; the driver may not collect them on such a guess."""
    key, seen = "spark.sql.autoBroadcastJoinThreshold", []
    before = spark.conf.get(key)

    def stopped(units):
        seen.append((spark.conf.get(key), spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold")))
        raise InterruptedError

    monkeypatch.setattr(integrate, "prepared", stopped)
    with pytest.raises(InterruptedError):
        queries.queries()["integrated_venues"](spark, small)
    assert seen == [("-1", before)] and spark.conf.get(key) == before


def test_units_without_another_source_around_go_no_further(spark):
    rows = [(1, "a", 10.0, 20.0), (2, "b", 10.0003, 20.0), (3, "a", 50.0, 20.0), (4, "a", 50.0003, 20.0), (5, "b", -10.0, 180.0), (6, "c", -10.0, -179.9999), (7, None, 10.0, 20.0), (8, "b", None, 20.0)]
    df = spark.createDataFrame(rows, "id long, source string, lat double, lng double")
    assert sorted(r.id for r in joins.meeting(df, integrate.NEAR_M, "source").collect()) == [1, 2, 5, 6]
