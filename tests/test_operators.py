"""Functions and operators against small cases and brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from atlasweave.functions import geo, money, scripts, text
from atlasweave.operators import checks, graph, joins, search, windows
from atlasweave.plans import integrate
from atlasweave.sources import geocoders, readers, sinks
from atlasweave.streaming import facets


def metres(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * geo.RADIUS_M * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("place", [(0, 0), (45.8, 126.5), (-70, 179.99), (84.99, 10), (89.5, -100)])
def test_spatial_join_equals_brute_force(spark, place):
    rng = random.Random(str(place))
    points = [(i, max(-90.0, min(90.0, place[0] + rng.uniform(-0.02, 0.02))), (place[1] + rng.uniform(-0.05, 0.05) + 180) % 360 - 180) for i in range(150)] + [(900, None, 1.0), (901, 0.0, float("nan"))]
    df = spark.createDataFrame(points, "id int, lat double, lng double")
    got = {(r.l_id, r.r_id) for r in joins.spatial_join(df, df, 500.0).where("l_id < r_id").collect()}
    want = {(a[0], b[0]) for a, b in itertools.combinations(points[:150], 2) if metres(a[1], a[2], b[1], b[2]) <= 500}
    assert got == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000 + i) for i in range(1, 200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    want = {}
    for n in root:
        want.setdefault(find(n), set()).add(n)
    assert got == {n: min(g) for g in want.values() if len(g) > 1 for n in g if n != min(g)} | {n: n for n in got if n == got[n]}


NAMES = [("（株）ＧｉＧＯ　秋葉原３号館", "株 gigo 秋葉原3号館"), ("123 Round1 (Mall)", "round1 mall"), ("", ""), (None, ""), ("STRASSE ß", "strasse ss")]


def test_folded_names(spark):
    rows = spark.createDataFrame([(a,) for a, _ in NAMES], "name string").select(text.folded(F.coalesce("name", F.lit(""))).alias("f")).collect()
    assert [r.f for r in rows] == [b for _, b in NAMES]


def test_similarity(spark):
    pairs = [("round1 stadium", "round1 stadium"), ("round1 stadium machida", "machida round1"), ("abc", "xyz"), ("", "a"), ("a", "a b")]
    rows = text.with_similarity(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()
    assert [round(r.similarity, 3) for r in rows] == [1.0, 1.0, 0.0, 0.0, 1.0]


def test_scripts():
    assert scripts.romanized("ゲーセン") == "geesen" and scripts.romanized("っち") == "tchi" and scripts.romanized("キャッツファンタジー") == "kyattsufantajii" and scripts.romanized("ッ") == "tsu" and scripts.romanized("ー") == ""
    assert scripts.short_vowels("toukyou") == scripts.short_vowels("tookyoo") == "tokyo"
    assert scripts.read_similarity("アミパラ", "Amipara") == 1.0 and scripts.read_inside("アミパラ", "Amipara Kokoja") and not scripts.read_inside("am", "amipara")
    assert scripts.latin_skeleton("Tsuen") == scripts.jyutping_skeleton("cyun") == "cun"


PRICES = [
    ("HK$6.00 for 3 songs", "HKD", 6.0, "HKD", 3), ("NT$30.00 for 3 songs", "TWD", 30.0, "TWD", 3), ("¥100 / 3 songs (1 player)", "JPY", 100.0, "JPY", 3), ("100Y = 3 songs STANDARD MODE", "JPY", 100.0, "JPY", 3),
    ("1.00€ / 3 songs", "EUR", 1.0, "EUR", 3), ("Rp10.900 / 3 songs", "IDR", 10900.0, "IDR", 3), ("MOP$8 / 2 songs", "MOP", 8.0, "MOP", 2), ("NT$30 / Standard Start / NT$40 / Premium Start", "TWD", 30.0, "TWD", None),
    ("₩2 500", "KRW", 2500.0, "KRW", None), ("Rp10 000 / 3 songs", "IDR", 10000.0, "IDR", 3), ("30đ", "VND", 30.0, "VND", None), ("R$2 5 hearts", "BRL", 2.0, "BRL", None), ("Welcome Card $3.80 / Platinum $3.25", "NZD", 3.8, "NZD", None),
    ("HK$6 LIGHT START / HK$8 STANDARD START / HK$12 PREMIUM START", "HKD", 8.0, "HKD", None), ("SGD 1.50 for 3 songs / SGD 1.50 to continue", "SGD", 1.5, "SGD", 3), ("HK$6.00 / 3 songs (4 songs if multiplay)", "HKD", 6.0, "HKD", 3),
]
REASONS = [("", None, "empty"), (None, None, "empty"), ("Free Play", "USD", "free_play"), ("2 credits", "USD", "token_system"), ("1 TOKEN = Rp. 2500,00", "IDR", "token_system"), ("cheap", "USD", "no_currency"), ("$5 VIP", "USD", "all_tiers_rejected")]
COUNTS = [("12 machines", 12), ("Version 5.20, 4 cabinets", 4), ("x2", 2), ("2台", 2), ("10x HG and 2x normal cabinets", 12), ("2 sets of 4 linked cabinets each", 8), ("1 silver cab, 3 gold", 4), ("新筐体2台ノーマルタイプ1台", 3), ("JPN Version. 4 machines", 4), ("100 yen", None), ("Ver. 5.20", None), ("2 songs", None), ("2P", None), ("", None), (None, None), ("1-2 machines", None), ("1台目", None), ("The 1st gen cabinet", None)]


def test_prices_and_quantities(spark):
    rows = spark.createDataFrame([p[:2] for p in PRICES] + [r[:2] for r in REASONS], "t string, c string").select(money.price("t", "c").alias("p")).collect()
    assert [(r.p.amount, r.p.currency, r.p.songs) for r in rows[: len(PRICES)]] == [p[2:] for p in PRICES]
    assert [r.p.reason for r in rows[len(PRICES) :]] == [r[2] for r in REASONS]
    rows = spark.createDataFrame([(t,) for t, _ in COUNTS], "t string").select(money.quantity("t").alias("n")).collect()
    assert [r.n for r in rows] == [n for _, n in COUNTS]
    assert money.to_amount("1,320.00") == 1320 and money.to_amount("6,90") == 6.9 and money.to_amount("10.900,00") == 10900 and money.to_amount("0") is None


def test_street_signature(spark):
    rows = spark.createDataFrame([("258 Granby Street, Norfolk",), ("Suite 5, 258 Granby St Norfolk",), ("nowhere",), (None,)], "a string").select(text.street_signature(F.col("a")).alias("s")).collect()
    assert [r.s for r in rows] == ["258 granby st", "258 granby st", None, None]


def test_query_spec_round_trip():
    spec = search.QuerySpec(tags=("a", "b"), variants={"a": ("x",)}, sources=None, tiers=("1",))
    assert search.QuerySpec.parse("#" + spec.serialise()) == spec and search.QuerySpec().serialise() == ""


def test_showable_totals(spark):
    df = spark.sql("select * from values (map('a', 1, 'b', 3), map('a', 'ziv_listed', 'b', 'ziv_listed')), (map('a', 1), map('a', 'ziv_listed')), (map('a', 4), map('a', 'bemanicn_qty')) as t(n, e)")
    assert [(r.s, r.t) for r in df.select(search.showable_total("n", "e").alias("s"), search.size_tier(search.showable_total("n", "e")).alias("t")).collect()] == [(3, "2"), (None, "U"), (4, "2")]


def test_nearest_leaves_out_twins(spark):
    df = spark.createDataFrame([(1, "A", 0.0, 0.0), (2, "a", 0.00005, 0.0), (3, "B", 0.00005, 0.0), (4, "A", 1.0, 0.0), (5, "C", None, None)], "id int, name string, lat double, lng double")
    assert [r.id for r in search.nearest(df, 0.0, 0.0, 10, "name").collect()] == [1, 3, 4]


def test_opening_times(spark):
    days = [(1, d, "10:00", "22:00", d == 6) for d in range(7)] + [(2, d, "00:00", "00:00", False) for d in range(7)] + [(3, d, "09:00", "10:00", False) for d in range(6)] + [(4, d, *(("00:00", "00:00") if d == 0 else ("10:00", "22:00")), False) for d in range(7)]
    rows = windows.opening_times(spark.createDataFrame(days, "venue int, day int, opens string, closes string, closed boolean"), "venue").collect()
    assert sorted((r.venue, r.hours) for r in rows) == [(1, "Mon-Sat 10:00-22:00; Sun closed"), (3, "Mon-Sat 09:00-10:00"), (4, "Tue-Sun 10:00-22:00")]


def test_images(spark):
    rows = [(1, "u", "s", False, 1, 0.5, 0), (1, "u", "s", False, 0, 0.5, 1), (1, "v", "s", False, 2, 0.9, 2), (1, "w", None, True, 0, 0.9, 3), (2, "x", None, True, 0, 0.1, 0), (2, "y", None, True, 0, 0.4, 1)]
    got = windows.ranked_images(spark.createDataFrame(rows, "o int, url string, sha256 string, rejected boolean, tier int, score double, pos int"), "o").collect()
    assert sorted((r.o, r.url, r.tier) for r in got) == [(1, "u", 0), (2, "y", 0)]


def test_areas(spark):
    areas = spark.createDataFrame([("p1", "江苏省", None, 0), ("p2", "河北省", None, 0), ("c1", "苏州市", "p1", 1), ("c2", "南京市", "p1", 1), ("d1", "河北区", "c1", 2), ("d2", "吴中区", "c1", 2)], "area_id string, name string, parent string, depth int")
    rows = spark.createDataFrame([(1, "江苏省苏州市吴中区1号"), (2, "江苏省南京市"), (3, "苏州市"), (4, None)], "id int, t string")
    assert sorted((r.id, r.area_id, r.level) for r in joins.areas_named(rows, "t", areas, "id").collect()) == [(1, "d2", "district"), (2, "c2", "city")]


def test_invariants(spark):
    df = spark.range(5)
    assert checks.require(df, {"small": F.col("id") < 5}).count() == 5
    with pytest.raises(ValueError, match="small: 2"):
        checks.require(df, {"small": F.col("id") < 3})


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "one.json").write_text('[{"name": "A", "address": "x  y", "lat": 0, "lng": 0, "games": ["g"], "source": "s", "game_counts": {"g": 0, "h": 2}}, {"name": "A", "address": "x　y", "lat": 1, "lng": 2, "games": ["h"], "source": "s", "website": "w"}]')
    rows = readers.json_rows(spark, str(tmp_path / "one.json"), tag_pattern=r"(\w+)\.json")
    assert {r.tag for r in rows.collect()} == {"one"}
    units = readers.units(rows).collect()
    assert len(units) == 1 and (units[0].lat, units[0].lng, units[0].games, units[0].website, units[0].game_counts) == (1.0, 2.0, ["g", "h"], "w", {"h": 2})
    (tmp_path / "j.jsonl").write_text('{"k": 1, "at": 2}\n{"k": 1, "at"')
    assert readers.journal(spark, str(tmp_path / "j.jsonl"), "k int, at int").where("k is not null and at is not null").count() == 1
    bodies = spark.createDataFrame([(1, '[{"a": 1}]'), (2, '{"data": [{"a": 2}, {"a": 3}]}'), (3, "broken")], "id int, body string")
    assert sorted((r.id, r.a) for r in readers.payload_rows(bodies, "body", "struct<a:int>").collect()) == [(1, 1), (2, 2), (2, 3)]
    with pytest.raises(ValueError, match="EUR"):
        readers.filled_rates(spark.createDataFrame([("USD", 1.0)], "code string, rate double"), spark.createDataFrame([("EUR", 0.0)], "code string, rate double"), ["USD", "EUR"])
    marks = spark.createDataFrame([("L", "a<b", "q", 1.0, 2.0, 1), ("L", "c", None, 1.0, 2.0, 2), ("L", "d", "e", None, 2.0, 3)], "layer string, name string, about string, lat double, lng double, id int")
    kml = sinks.kml_parts(marks, "layer", [F.col("id")], 1).orderBy("part").collect()
    assert [(r.part, r.n) for r in kml] == [("A", 1), ("B", 1)] and "a&lt;b" in kml[0].kml and "2.0000000,1.0000000,0" in kml[0].kml
    assert sinks.kml_colour("DB4436") == "ff3644db"


def test_names_held_by_texts(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a road to Rome and Romeo"), (2, "Ro"), (3, ""), (4, None), (5, "x Rom y")], "id int, t string")
    names = spark.createDataFrame([("Rome",), ("Romeo",), ("Ro",), ("R",), ("",), ("y",)], "name string")
    want = sorted((r.id, r.name) for r in joins.holding(rows, "t", names, "name").collect())
    monkeypatch.setattr(joins, "SMALL", 0)
    assert sorted((r.id, r.name) for r in joins.holding(rows, "t", names, "name").collect()) == want and len(want) == 9


def test_part_labels(spark):
    rows = spark.range(800).select(windows.part_label(F.col("id")).alias("p")).collect()
    assert [rows[k].p for k in (0, 25, 26, 51, 52, 701, 702)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"] and len({r.p for r in rows}) == 800


def test_venues(spark):
    units = [
        (1, "allnet", "Round1 Machida", "1 A St X", 35.0, 139.0, "Japan", None, ["g"]), (2, "ziv", "ラウンドワン町田 Round1 Machida", "2", 35.0003, 139.0, "Japan", "https://zenius-i-vanisher.com/arcades/77", ["h"]),
        (3, "ziv", "Elsewhere", "3", 10.0, 10.0, "Nowhere", None, ["g"]), (4, "bemanicn", "Elsewhere", "4", 10.02, 10.0, "Nowhere", None, []), (5, "ziv", "Third Place", "9 Elm Road Y", 20.0, 20.0, "US", None, []), (6, "bemanicn", "Third Place", "9 Elm Rd Y", -20.0, 20.0, "US", None, ["g"]),
        (7, "allnet", "アミパラ", "z", 50.0, 50.0, "Japan", None, []), (8, "ziv", "Amipara", "zz", 50.0001, 50.0, "Japan", None, []), (9, "ziv", "Lonely", "", None, None, "Japan", None, []),
    ]
    df = spark.createDataFrame(units, "unit_id long, source string, name string, addr string, lat double, lng double, country string, source_url string, games array<string>")
    got = sorted((r.members, tuple(r.src), r.name) for r in integrate.venues(df).collect())
    assert got == [(1, ("ziv",), "Lonely"), (2, ("allnet", "ziv"), "Round1 Machida"), (2, ("allnet", "ziv"), "アミパラ"), (2, ("bemanicn", "ziv"), "Elsewhere"), (2, ("bemanicn", "ziv"), "Third Place")]


def test_streaming_counts(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    spark.read.parquet(f"{small}/events.parquet").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = facets.run_to_end(spark, facets.windowed_counts(stream, "ts", "event_type"), str(tmp_path / "out"), str(tmp_path / "check"))
    want = spark.read.parquet(str(tmp_path / "in")).groupBy(F.to_date("ts"), "event_type").count()
    assert got.agg(F.sum("n")).first()[0] == want.agg(F.sum("count")).first()[0] and got.count() == want.count()


def test_geocoders(spark):
    bodies = [
        ('{"status": "1", "geocodes": [{"location": "bad"}, {"location": "121.5,31.2", "level": "poi"}]}', "text", (31.2, 121.5, "poi")), ('{"status": "0"}', "text", None), ("broken", "text", None),
        ('{"status": "OK", "results": [{"geometry": {"location": {"lat": 1.5, "lng": 2.5}, "location_type": "ROOFTOP"}}]}', "object", (1.5, 2.5, "ROOFTOP")), ('{"status": "REQUEST_DENIED", "results": []}', "object", None),
        ('{"content": [{"x": 100, "y": 200, "std_tag": "道路"}, {"x": 1, "y": 2, "std_tag": "停车场"}, {"x": 300, "y": 400, "std_tag": "购物"}]}', "projected", (3.0, 4.0, "place")), ('{"content": [{"x": 100, "y": 200, "std_tag": "道路"}]}', "projected", (1.0, 2.0, "street")),
    ]
    df = spark.createDataFrame([(b,) for b, _, _ in bodies], "body string")
    rows = df.select(geocoders.text_point(F.col("body")).alias("text"), geocoders.object_point(F.col("body")).alias("object"), geocoders.projected_point(F.col("body")).alias("projected")).collect()
    assert [tuple(r[k])[:3] if r[k] else None for r, (_, k, _) in zip(rows, bodies, strict=True)] == [w for _, _, w in bodies]
    venues = spark.createDataFrame([(1, "A  St", None, None), (2, "a st", None, None), (3, "B St", None, None), (4, "C", 1.0, 1.0), (5, None, None, None)], "id int, addr string, lat double, lng double")
    cache = spark.createDataFrame([("b st", 5.0, 6.0), ("x", None, None)], "addr_key string, lat double, lng double")
    assert [(r.addr_key, r.rows) for r in geocoders.work_list(venues, cache).collect()] == [("a st", 2)]
    assert {r.id: (r.lat, r.from_cache) for r in geocoders.from_cache(venues, cache).collect()} == {1: (None, False), 2: (None, False), 3: (5.0, True), 4: (1.0, False), 5: (None, False)}


def test_ids_within_groups(spark):
    df = spark.range(500).select((F.col("id") % 3 * F.when(F.col("id") % 7 != 0, 1)).alias("g"), (F.col("id") * 37 % 101).alias("o"), "id")
    got = windows.dense_ids(df, [F.col("o"), F.col("id")], "n", ["g"]).collect()
    want = {}
    for g in {r.g for r in got}:
        for n, r in enumerate(sorted((r for r in got if r.g == g), key=lambda r: (r.o, r.id)), 1):
            want[r.id] = n
    assert len(got) == 500 and {r.id: r.n for r in got} == want
