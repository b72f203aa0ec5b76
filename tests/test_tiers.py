"""The tiers of the integration on cases that a wrong ranking, a wrong gate or a wrong guard would get wrong."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from atlasweave.functions import scripts, text
from atlasweave.operators import graph, joins
from atlasweave.plans import integrate, two_scripts

UNIT = "unit_id long, source string, name string, addr string, lat double, lng double, country string, source_url string, games array<string>"


def units(spark, rows, schema=UNIT, **more):
    df = spark.createDataFrame([(*r, *[None] * (9 - len(r))) for r in rows], schema)
    return integrate.prepared(df.withColumns({k: F.lit(v) for k, v in more.items()}))


def pairs(edges):
    return sorted((min(r.a, r.b), max(r.a, r.b)) for r in edges.collect())


def test_a_unit_ranks_all_edges_that_it_is_in(spark):
    """One unit of A between two of B on one spot: it takes one of them, whichever side of an edge it stands on."""
    rows = [(1, "B", "Game Place", "", 10.0, 10.0, "X"), (5, "A", "Game Place", "", 10.0, 10.0, "X"), (9, "B", "Game Place", "", 10.0, 10.0, "X")]
    assert pairs(integrate.near_and_alike(units(spark, rows))) == [(5, 9)]
    rows[2] = (9, "B", "Game Place", "", 10.0, 10.0005, "X")
    assert pairs(integrate.near_and_alike(units(spark, rows))) == [(1, 5)]


def test_mutual_best_equals_the_plain_rule(spark):
    rng = random.Random(5)
    edges = sorted({(*sorted(rng.sample(range(40), 2)),) for _ in range(200)})
    rows = [(a, b, a % 3, b % 3, rng.randrange(4)) for a, b in edges if a % 3 != b % 3]
    best = {}
    for a, b, ag, bg, d in rows:
        for own, other, to in ((a, b, bg), (b, a, ag)):
            best[own, to] = min(best.get((own, to), (9, 99)), (d, -other))
    want = sorted((a, b) for a, b, ag, bg, d in rows if best[a, bg][1] == -b and best[b, ag][1] == -a)
    df = spark.createDataFrame(rows, "a int, b int, ag int, bg int, d int")
    assert sorted((r.a, r.b) for r in joins.mutual_best(df, "a", "b", [F.col("d")], "ag", "bg", last=True).collect()) == want


def test_alike_names_meet_as_by_brute_force(spark):
    rng = random.Random(2)
    words = ["game", "zone", "round", "one", "taito", "station", "plaza", "mall", "東京", "新宿", "店"]
    rows = [(k, f"s{k % 3}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) + rng.choice(["", " (east)", f" {k}"]), "", 35 + rng.uniform(0, 0.002), 139 + rng.uniform(0, 0.002), "J") for k in range(120)]
    df = units(spark, rows)
    near = joins.spatial_join(df, df, integrate.NEAR_M).where("l_unit_id < r_unit_id")
    bare = text.with_similarity(near, "l_name_bare", "r_name_bare", "s1")
    want = {(r.l_unit_id, r.r_unit_id) for r in text.with_similarity(bare, "l_name_full", "r_name_full", "s2").where("greatest(s1, s2) >= 0.6 and distance_m < 120").collect()}
    got = set(pairs(integrate.alike_nearby(df)))
    assert want <= got and want


def test_many_units_on_one_spot(spark):
    """A hundred thousand units of one name on one coordinate: rows stay in proportion."""
    n = 100_000
    df = spark.range(n).select(F.col("id").alias("unit_id"), F.when(F.col("id") % 2 == 0, "ziv").otherwise("allnet").alias("source"), F.lit("one name").alias("name"), F.lit("").alias("addr"), F.lit(30.0).alias("lat"), F.lit(100.0).alias("lng"), F.lit("X").alias("country"), F.lit(None).cast("string").alias("source_url"), F.array(F.lit("g")).alias("games"))
    own = integrate.prepared(df)
    assert integrate.repeated_in_source(own).count() == n - 2 and pairs(integrate.near_and_alike(own)) == [(n - 2, n - 1)] and pairs(integrate.same_name_nearby(own)) == [(0, 1)]
    assert integrate.without_position(integrate.prepared(df.withColumns({"lat": F.lit(None).cast("double"), "lng": F.lit(None).cast("double"), "addr": F.lit("1 x st")}))).count() == n - 1


def test_branches_need_one_candidate_on_either_side(spark):
    rows = [(1, "A", "Foobar (Mall)", "", 10.0, 10.0, "X"), (2, "B", "Foobar", "", 10.0, 10.001, "X"), (3, "A", "Foobar (Tower)", "", 10.0, 10.002, "X"), (4, "A", "Second (Mall)", "", 20.0, 10.0, "X"), (5, "B", "Second", "", 20.0, 10.001, "X"), (6, "A", "Third (Mall)", "", 30.0, 10.0, "X"), (7, "B", "Third", "", 30.0, 10.001, "Y")]
    assert pairs(integrate.branch_names(units(spark, rows))) == [(4, 5)]


def test_one_name_in_two_languages(spark):
    rows = [
        (1, "allnet", "プラザゲーム新居浜店", "", 33.9, 133.2, "Japan"), (2, "ziv", "PLAZA GAME Niihama (プラザゲーム 新居浜店)", "", 33.9012, 133.2, "Japan"), (3, "eagate", "プラザゲーム新居浜店", "", 33.9, 133.201, "Japan"),
        (4, "ziv", "Timezone (Westfield)", "", 50.0, 1.0, "UK"), (5, "allnet", "Round1 (Westfield)", "", 50.0, 1.001, "UK"), (6, "ziv", "Round1 Bowling (Westfield)", "", 50.0, 1.002, "UK"),
        (7, "ziv", "Far Away Name", "", 60.0, 1.0, "UK"), (8, "allnet", "Far Away Name", "", 60.03, 1.0, "UK"), (9, "ziv", "Abroad Name", "", 61.0, 1.0, "UK"), (10, "allnet", "Abroad Name", "", 61.0, 1.001, "FR"),
    ]
    edges = integrate.same_name_nearby(units(spark, rows))
    label = graph.labelled(spark.range(1, 11).withColumnRenamed("id", "unit_id"), edges.select("a", "b"))
    groups = {}
    for r in label.collect():
        groups.setdefault(r.cluster_id, set()).add(r.unit_id)
    assert sorted(map(sorted, (g for g in groups.values() if len(g) > 1))) == [[1, 2, 3], [5, 6]]


def test_units_without_a_position(spark):
    rows = [
        (1, "A", "Lone Place", "1 x st", None, None, "X"), (2, "B", "Lone Place", "other", 1.0, 1.0, "X"), (3, "A", "Lone Place", "z", 2.0, 2.0, "Y"), (4, "B", "Pair Place", "9 Elm", None, None, "X"), (5, "A", "Pair Place", "9 elm ", None, None, None),
        (6, "C", "Pair Place", "else", None, None, "X"), (7, "A", "Bare Place", "", None, None, "X"), (8, "B", "Bare Place", None, None, None, "X"), (9, "A", "Same Place", "q", None, None, "X"), (10, "A", "Same Place", "q", 1.0, 1.0, "X"),
    ]
    got = pairs(integrate.without_position(units(spark, rows)))

    def plain(a, b):
        if a[1] == b[1] or a[2] != b[2] or None not in (a[6], b[6]) and a[6] != b[6] or None not in (a[4], b[4]):
            return False
        return True if (a[4] is None) != (b[4] is None) else bool(a[3]) and a[3].strip().lower() == (b[3] or "").strip().lower()

    assert got == sorted((a[0], b[0]) for a, b in itertools.combinations(rows, 2) if plain(a, b)) == [(1, 2), (4, 5)]


def test_one_per_group_equals_the_plain_rule(spark):
    rng = random.Random(8)
    for trial in range(1):
        edges = [(100 + k, 500 + k, a, b, rng.randrange(5), k) for k, (a, b) in enumerate(rng.sample(list(itertools.combinations(range(10), 2)), 18))]
        members = {c: {f"o{rng.randrange(3)}"} for c in range(0, 10, 2)}
        root, held, want = {}, {c: set(m) for c, m in members.items()}, []

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        for a, b, x, y, w, k in sorted(edges, key=lambda e: (e[4], e[5])):
            p, q = find(x), find(y)
            if p != q and not held.get(p, set()) & held.get(q, set()):
                want.append(k)
                root[q] = p
                held[p] = held.get(p, set()) | held.get(q, set())
        df = spark.createDataFrame(edges, "a int, b int, a_cluster int, b_cluster int, w int, k int")
        clusters = spark.createDataFrame([(c, sorted(m)) for c, m in members.items()], "cluster_id int, members array<string>")
        assert sorted(r.k for r in joins.one_per_group(df, clusters, [F.col("w"), F.col("k")]).collect()) == sorted(want), trial


#: Invented after the shapes of listings: two names, and whether they may be one venue when near.
CHINESE = [
    ("欢乐熊南京河西万达店", "欢乐熊（河西万达广场店）", "landmark_agree"), ("电玩星球苏州店", "电玩星球 Game Star（苏州工业园店）", "brand_only"), ("酷乐时代城关店", "酷乐时代电玩城", "brand_only"), ("大玩咖成都锦江一店", "大玩咖成都锦江二店", "branch_marker_conflict"),
    ("星光超乐场 南区A店", "星光超乐场 南区B店", "branch_marker_conflict"), ("大玩咖沈阳大东大悦城店", "大玩咖沈阳大东吾悦店", "landmark_conflict"), ("汤米熊武汉天河城店", "汤米熊武汉恒隆广场店", "landmark_conflict"),
    ("星辉城荆州市购物公园店", "星辉城洪湖市购物公园店", "city_conflict"), ("嘉年华（万达店）", "嘉乐华（万达店）", "brand_differs"), ("星际传奇京基店", "星际玩家海口店", "brand_differs"), ("玩里淘漳浦店", "玩里淘漳浦绥安店", "brand_only"), ("1号机长芜湖店", "1号机长（芜湖镜湖店）", "brand_only"),
]


def test_chinese_names(spark):
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(CHINESE)], "k int, a_name string, b_name string")
    for s in "ab":
        rows = scripts.with_chinese_keys(rows, f"{s}_name").withColumnsRenamed({"cn_brand": f"{s}_cn_brand", "cn_whole": f"{s}_cn_whole"})
    got = [r.reason for r in scripts.with_place_reason(rows).orderBy("k").collect()]
    assert got == [w for *_, w in CHINESE]


def test_branch_marks(spark):
    rows = spark.createDataFrame([("江北一店",), ("江北1店",), ("南风里A号店",), ("城关店",), ("第100店",), ("A店B店",)], "n string").select(scripts.branch_marks(F.col("n")).alias("m")).collect()
    assert [r.m for r in rows] == [["1"], ["1"], ["A"], [], [], ["A", "B"]]


def test_best_in_province(spark):
    rows = [(1, "bemanicn", "星际传奇松江印象城店", "", None, None, "China"), (2, "wahlap", "星际传奇上海松江印象城店", "上海市松江区", None, None, "China"), (3, "wahlap", "别的地方", "", None, None, "China"), (4, "bemanicn", "星际传奇松江印象城店", "", None, None, "China")]
    df = units(spark, rows)
    df = df.withColumns({"pref": F.when(F.col("source") == "wahlap", "上海市"), "notes": F.when(F.col("unit_id") == 1, "region: 上海市; x").when(F.col("unit_id") == 4, "region: 广东省 广州市")})
    assert pairs(integrate.best_in_province(df)) == [(1, 2)]


@pytest.mark.parametrize("addr, want", [("258 Granby St., Norfolk", "258 granby st"), ("258 Granby Street Norfolk", "258 granby st"), ("Suite 4, 12 North Elm Road", "12 n elm"), ("3rd Floor, Wanda Plaza", None), ("12 Elm", None), ("", None)])
def test_street_signatures(spark, addr, want):
    assert spark.createDataFrame([(addr,)], "a string").select(text.street_signature(F.col("a")).alias("s")).first().s == want


#: Sounds of the characters of the cases.
READINGS = {"觀": ["gun"], "塘": ["tong"], "道": ["dou"], "洗": ["sai"], "衣": ["ji"], "街": ["gaai"], "旺": ["wong"], "角": ["gok"], "沙": ["saa"], "田": ["tin"], "佐": ["zo"], "敦": ["deon"]}


def test_clusters_in_two_scripts(spark):
    rows = [
        (1, "allnet", "SAI GAME PALACE", "2/F, 39 Sai Yee Street, Mong Kok", 22.31, 114.17, "Hong Kong"), (2, "bemanicn", "洗衣街機鋪", "旺角洗衣街39號", None, None, "Hong Kong"),  # street and number
        (3, "allnet", "APM CORNER", "418 Kwun Tong Road", 22.3, 114.2, "Hong Kong"), (4, "bemanicn", "金沙", "觀塘道410號", None, None, "Hong Kong"),  # one street, other numbers: never
        (5, "ziv", "FUNTASTIC ZONE", "Sha Tin Centre", 22.38, 114.19, "Hong Kong"), (6, "bemanicn", "FUNTASTIC ZONE 遊戲", "沙田某處", None, None, "Hong Kong"),  # place and brand
        (7, "ziv", "SOLO BRAND HALL", "x", None, None, "Hong Kong"), (8, "bemanicn", "SOLO BRAND HALL", "y", None, None, "Macau"), (9, "bemanicn", "無關", "佐敦", None, None, "Hong Kong"),
    ]
    df = units(spark, rows)
    clusters = df.select("unit_id", F.col("unit_id").alias("cluster_id"))
    assert pairs(two_scripts.same_place(df, clusters, READINGS)) == [(1, 2), (5, 6)]
    kinds = {(r.a, r.b): (set(r.kinds), r.veto) for r in two_scripts.common_clues(two_scripts.with_clues(df.select(F.col("unit_id").alias("cluster_id"), "addr", "name"), READINGS)).collect()}
    assert kinds[1, 2][0] >= {"street", "number"} and kinds[3, 4][1] and {"place", "brand"} <= kinds[5, 6][0]


def test_whole_integration(spark):
    """Every tier in one table; a unit that only looks alike stays alone."""
    rows = [
        (1, "allnet", "Round1 Machida", "", 35.0, 139.0, "Japan"), (2, "ziv", "Round1 Machida (ラウンドワン町田)", "", 35.0003, 139.0, "Japan"), (3, "allnet", "アミパラ", "", 36.0, 139.0, "Japan"), (4, "ziv", "Amipara", "", 36.0001, 139.0, "Japan"),
        (5, "ziv", "Some Local Place", "", 10.0, 10.0, "X"), (6, "bemanicn", "Some Local Place", "", 10.02, 10.0, "X"), (7, "ziv", "Zoned", "", 12.0, 10.0, "X"), (8, "allnet", "Zoned (East)", "", 12.003, 10.0, "X"),
        (9, "ziv", "Twice Listed", "", 14.0, 10.0, "X"), (10, "ziv", "Twice Listed", "", 14.0001, 10.0, "X"), (11, "ziv", "Circuit Fun", "258 Granby St Norfolk", 16.0, 10.0, "X"), (12, "ziv", "Circuit Fun", "258 Granby Street Norfolk", 26.0, 10.0, "X"),
        (13, "wahlap", "欢乐熊南京河西万达店", "", 32.0, 118.0, "China"), (14, "bemanicn", "欢乐熊（河西万达广场店）", "", 32.003, 118.0, "China"), (15, "ziv", "Alone", "", -5.0, 5.0, "X"),
    ]
    df = spark.createDataFrame([(*r, None, ["g"]) for r in rows], UNIT)
    edges = integrate.linked(integrate.prepared(df))
    label = graph.labelled(df.select("unit_id"), edges.select("a", "b"))
    groups = {}
    for r in label.collect():
        groups.setdefault(r.cluster_id, set()).add(r.unit_id)
    assert sorted(map(sorted, groups.values())) == [[1, 2], [3, 4], [5, 6], [7, 8], [9, 10], [11, 12], [13, 14], [15]]
    assert integrate.venues(df).count() == 8
