"""Queries over records put together, each with the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, places, text
from ..operators import aggregates, checks, records, review, windows
from ..sources import geocoders, readers, sinks
from .queries import _at, _lat, _lng, _t, query

_LISTS = "list_filter([case when k % 3 = 0 then 'ziv' end, case when k % 4 = 0 then 'eagate' end, case when k % 5 = 0 then 'allnet' end], lambda x: x is not null) as src, list_filter([case when k % 2 = 0 then 'sdvx' end, case when k % 3 = 1 then 'iidx' end, case when k % 7 = 0 then 'jubeat' end, case when k % 5 < 3 then 'maimai_dx' end, case when k % 5 < 2 then 'chunithm' end, case when k % 5 = 0 then 'ongeki' end, case when k % 11 = 0 then 'dancerush' end], lambda x: x is not null) as games, list_filter([case when k % 6 = 0 then 'sdvx_vm' end], lambda x: x is not null) as cabs"
_TAGS = {
    "src": (("k % 3 = 0", "ziv"), ("k % 4 = 0", "eagate"), ("k % 5 = 0", "allnet")), "cabs": (("k % 6 = 0", "sdvx_vm"),),
    "games": (("k % 2 = 0", "sdvx"), ("k % 3 = 1", "iidx"), ("k % 7 = 0", "jubeat"), ("k % 5 < 3", "maimai_dx"), ("k % 5 < 2", "chunithm"), ("k % 5 = 0", "ongeki"), ("k % 11 = 0", "dancerush")),
}


def _tagged(rows):
    return rows.withColumns({c: F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(tag)) for cond, tag in tags])) for c, tags in _TAGS.items()})


_LAYERS = {
    "01_all_bemani_japan": "list_contains(src, 'eagate')", "02_sega_gekichumai": "list_contains(src, 'allnet')", "04_sdvx": "list_contains(games, 'sdvx')", "05_valk_and_lm": "list_contains(cabs, 'sdvx_vm')", "06_iidx": "list_contains(games, 'iidx')",
    "08_other_bemani": "list_contains(games, 'jubeat')", "09_other_dance": "list_contains(games, 'dancerush')", "10_all3_gekichumai": "list_has_all(games, ['maimai_dx', 'chunithm', 'ongeki'])", "11_china_optional": "n_name = 'CHINA' and k % 4 <> 0", "12_community_worldwide_optional": "list_contains(src, 'ziv')",
}


@query(f"with v as (select c_custkey as k, n_name, {_LISTS} from (select c_custkey as k, * from customer) join nation on c_nationkey = n_nationkey) " + " union all ".join(f"select '{name}' as layer, k as id from v where {cond}" for name, cond in _LAYERS.items()))
def layer_members(spark, sf):
    rows = _t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), F.initcap("n_name").alias("country"))
    rows = _at(_tagged(rows), "k").withColumn("lat", F.when(F.col("k") % 4 != 0, F.col("lat")))
    return records.layered(rows).select("layer", F.col("k").alias("id"))


@query("""with p as (select p_partkey as k, p_name as name, case when p_partkey % 3 = 0 then p_brand end as addr from part), e as (select name, coalesce(addr, '') as a, count(*) as n, min(k) as id from p group by 1, 2), o as (select name, count(*) as n, min(k) as id from p group by 1)
select k, coalesce(case when e.n = 1 then e.id end, case when o.n = 1 then o.id end) as id from p join e on e.name = p.name and e.a = coalesce(p.addr, '') join o on o.name = p.name""")
def resolved_names(spark, sf):
    rows = _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("addr"))
    return records.resolved(rows.withColumnRenamed("id", "k"), rows).select("k", "id")


@query(f"""with p as (select s_suppkey * 3 as id, 'v  ' || ((s_suppkey * 3 + case when s_suppkey % 4 = 0 then 1 else 0 end) % 70) as name, {_lat('s_suppkey')} as lat, {_lng('s_suppkey')} as lng, s_suppkey % 5 <> 0 as fine from supplier), r as (select c_custkey as id, 'V ' || (c_custkey % 70) as name from customer), n as (select lower(regexp_replace(name, '\\s+', ' ', 'g')) as name, min(id) as id from p group by 1)
select r.id, case when q.fine then q.lat end as pin_lat, case when q.fine then q.lng end as pin_lng from r left join p on p.id = r.id left join n on p.id is null and n.name = lower(r.name) left join p q on q.id = case when p.id is null then n.id when lower(regexp_replace(p.name, '\\s+', ' ', 'g')) = lower(r.name) then p.id end""")
def hand_placed_rows(spark, sf):
    pins = _at(_t(spark, sf, "supplier").select("s_suppkey"), "s_suppkey").select((F.col("s_suppkey") * 3).alias("id"), F.concat(F.lit("v  "), (F.col("s_suppkey") * 3 + F.when(F.col("s_suppkey") % 4 == 0, 1).otherwise(0)) % 70).alias("name"), "lat", "lng", F.when(F.col("s_suppkey") % 5 != 0, "https://x.example/").alias("source_url"))
    rows = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("V "), F.col("c_custkey") % 70).alias("name"))
    return records.hand_placed(rows, pins).select("id", "pin_lat", "pin_lng")


@query(f"""with raw as (select 'n' || (s_suppkey % 30) as name, 'a' || (s_suppkey % 5) as addr, round({_lat('s_suppkey % 50')}, 5) as lat, round({_lng('s_suppkey % 50')}, 5) as lng, case when s_suppkey % 4 <> 0 then 'u' || s_suppkey end as url from supplier),
 r as (select c_custkey as id, 'n' || (c_custkey % 300) as name, 'a' || (c_custkey % 7) as addr, round({_lat('c_custkey % 500')}, 5) as lat, round({_lng('c_custkey % 500')}, 5) as lng from customer),
 x as (select name, addr, min(url) as url from raw group by 1, 2), y as (select lat, lng, min(url) as url from raw group by 1, 2)
select id, coalesce(x.url, y.url) as url from r left join x on x.name = r.name and x.addr = r.addr left join y on y.lat = r.lat and y.lng = r.lng""")
def patched_rows(spark, sf):
    raw = _at(_t(spark, sf, "supplier").withColumn("p", F.col("s_suppkey") % 50), "p").select(F.concat(F.lit("n"), F.col("s_suppkey") % 30).alias("name"), F.concat(F.lit("a"), F.col("s_suppkey") % 5).alias("addr"), "lat", "lng", F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("u"), "s_suppkey")).alias("url"))
    rows = _at(_t(spark, sf, "customer").withColumn("p", F.col("c_custkey") % 500), "p").select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), F.col("c_custkey") % 300).alias("name"), F.concat(F.lit("a"), F.col("c_custkey") % 7).alias("addr"), "lat", "lng")
    return records.patched(rows, raw, "url").select("id", "url")


@query("""with r as (select o_custkey as cluster, o_orderkey as k, o_orderstatus as s from orders), u as (select cluster, k, 'ziv' as source, 'z' || (k % 50) as url from r where s <> 'P' union all select cluster, k, 'bemanicn', 'b' || (k % 40) from r where s <> 'F'),
 f as (select *, k = min(k) over (partition by cluster, source) as first from u), m as (select cluster, list_sort(list(distinct url)) as also from (select cluster, url from f where not first except select cluster, url from f where first) group by 1),
 a as (select cluster, arg_min('a' || k, k) filter (where k % 4 <> 0) as addr, list_sort(list(distinct 'g' || (k % 6))) as games, count(*) as n from r group by 1)
select a.cluster, games, addr, also, arg_min(f.url, f.k) filter (where f.source = 'ziv') as ziv from a left join m on m.cluster = a.cluster left join f on f.cluster = a.cluster group by all""")
def united_records(spark, sf):
    k = F.col("o_orderkey")
    links = F.map_from_entries(F.array_compact(F.array(F.when(F.col("o_orderstatus") != "P", F.struct(F.lit("ziv").alias("k"), F.concat(F.lit("z"), k % 50).alias("v"))), F.when(F.col("o_orderstatus") != "F", F.struct(F.lit("bemanicn").alias("k"), F.concat(F.lit("b"), k % 40).alias("v"))))))
    rows = _at(_t(spark, sf, "orders"), "o_orderkey").select(
        F.col("o_custkey").alias("cluster"), k.alias("k"), F.array(F.concat(F.lit("g"), k % 6)).alias("games"), F.array().cast("array<string>").alias("cabs"), F.array("o_orderstatus").alias("src"), links.alias("links"), F.create_map(F.concat(F.lit("g"), k % 6), (k % 9).cast("int")).alias("game_counts"),
        F.create_map(F.concat(F.lit("g"), k % 6), F.lit("ziv_listed")).alias("count_evidence"), F.when(k % 4 != 0, F.concat(F.lit("a"), k)).alias("addr"), F.lit(None).cast("string").alias("pref"), F.col("o_orderpriority").alias("notes"), "lat", "lng", (k % 2 == 0).alias("approx"),
    )
    out = records.united_rows(rows, "cluster", F.col("k"))
    return out.select("cluster", "games", "addr", "also", F.try_element_at("links", F.lit("ziv")).alias("ziv"))


@query(f"""with v as (select k, games from (select k, {_LISTS} from (select c_custkey as k from customer))), c as (select s_suppkey * 7 as id, case when s_suppkey % 2 = 0 then ['ddr', 'iidx'] end as g, case when s_suppkey % 3 = 0 then 'gone' end as why from supplier),
 m as (select k as id, case when g is null then games else g end as games, why from v left join c on c.id = k)
select id, list_sort(games) as games, why is not null as closed, list_sort(list_filter([case when list_contains(games, 'sdvx') then 'sdvx:' || (id % 4) end, case when list_contains(games, 'iidx') then 'iidx:' || case when id % 7 = 0 and exists (select 1 from c c2 where c2.id = m.id) then 9 else (id % 3) end end], lambda x: x is not null)) as counts from m""")
def corrected_rows(spark, sf):
    k = F.col("k")
    rows = _tagged(_t(spark, sf, "customer").select(F.col("c_custkey").alias("k"))).withColumn("id", k)
    rows = _at(rows, "k").withColumns({"game_counts": F.create_map(F.lit("sdvx"), (k % 4).cast("int"), F.lit("iidx"), (k % 3).cast("int")), "count_evidence": F.create_map(F.lit("sdvx"), F.lit("bemanicn_qty"))})
    s = F.col("s_suppkey")
    fixes = _t(spark, sf, "supplier").select((s * 7).alias("id"), F.when(s % 2 == 0, F.array(F.lit("iidx"), F.lit("ddr"))).alias("games"), F.when(s % 3 == 0, "gone").alias("closed_reason"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"), F.create_map(F.lit("iidx"), F.lit(9)).alias("game_counts"))
    out = records.corrected(rows, fixes)
    counts = F.array_sort(F.transform(F.map_entries("game_counts"), lambda e: F.concat_ws(":", e["key"], e["value"])))
    return out.select("id", F.array_sort("games").alias("games"), "closed", counts.alias("counts"))


@query("""with o as (select event_type as g, count(*) as n from events where user_id % 3 <> 0 group by 1), w as (select event_type as g, count(*) as n from events where user_id % 3 = 0 and event_type <> 'error' group by 1), d as (select o.g, o.n as old_n, coalesce(w.n, 0) as new_n from o left join w on o.g = w.g)
select g as what, old_n, new_n, case when new_n = 0 then 'vanished' else 'dropped' end as status from d where old_n >= 50 and (new_n = 0 or 100.0 * (old_n - new_n) / old_n > 25) union all select '*', old_n, new_n, 'total' from (select cast(sum(old_n) as bigint) as old_n, cast(sum(new_n) as bigint) as new_n from d) where 100.0 * (old_n - new_n) / old_n > 5""")
def guard_findings(spark, sf):
    events = _t(spark, sf, "events")
    return records.guarded(aggregates.snapshot_diff(events.where("user_id % 3 <> 0"), events.where("user_id % 3 = 0 and event_type <> 'error'"), "event_type"))


_SAID = ("'12 Elm St, Austin, TX 78701'", "'5 rue X, Montreal H2X 1Y4'", "'서울 강남'", "'東京都ゲーセン'", "'near Toronto, Ontario'", "'plain road'", "'Elm St, Leeds, England'")
_BOXES = [("Box A", 0.0, 20.0, 0.0, 60.0), ("Box B", -85.0, -40.0, -180.0, 180.0)]


@query(f"""with r as (select c_custkey as id, case c_custkey % 7 {' '.join(f'when {k} then {s}' for k, s in enumerate(_SAID))} end as addr, case when c_custkey % 3 <> 0 then {_lat('c_custkey')} end as lat, {_lng('c_custkey')} as lng, case when c_custkey % 13 = 0 then 'region: 香港' end as note from customer)
select id, case when note is not null then 'Hong Kong' when id % 7 = 2 then 'South Korea' when id % 7 = 1 then 'Canada' when lat between 0 and 20 and lng between 0 and 60 then 'Box A' when lat between -85 and -40 then 'Box B' when id % 7 = 4 then 'Canada' when id % 7 = 0 then 'United States' when id % 7 = 6 then 'United Kingdom' when id % 7 = 3 then 'Japan' else 'Unknown' end as country from r""")
def resolved_countries(spark, sf):
    k = F.col("c_custkey")
    rows = _at(_t(spark, sf, "customer").select("c_custkey"), "c_custkey").withColumns({"addr": F.element_at(F.array(*[F.lit(s.strip("'")) for s in _SAID]), (k % 7 + 1).cast("int")), "lat": F.when(k % 3 != 0, F.col("lat")), "note": F.when(k % 13 == 0, "region: 香港")})
    land = places.country(F.col("lat"), F.col("lng"), F.col("addr"), F.lit("Japan Village"), F.col("note"), _BOXES, [("United Kingdom", r"\bEngland\b")])
    return rows.select(k.alias("id"), land.alias("country"))


@query("""select c_custkey as id, case c_custkey % 6 when 0 then 'TX' when 1 then 'Osaka' when 2 then '東京都' when 3 then '江苏省' end as pref from customer""")
def prefectures(spark, sf):
    k = F.col("c_custkey")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (k % 6 + 1).cast("int"))
    land, addr = pick("United States", "Japan", "Japan", "China", "Japan", "Nowhere"), pick("1 Elm, Austin, TX 78701", "Namba, Osaka", "東京新宿", "江苏省苏州市", "somewhere", "TX 78701")
    return _t(spark, sf, "customer").select(k.alias("id"), places.prefecture(land, addr, [("Tokyo", "東京都"), ("Osaka", "大阪府")]).alias("pref"))


@query("""select p_partkey, case when p_partkey % 5 = 3 then null else (p_size * case when p_partkey % 5 = 2 then 1000 else 1 end)::double end as amount, case p_partkey % 5 when 0 then 'HKD' when 1 then 'USD' when 2 then 'IDR' when 4 then 'JPY' end as currency from part""")
def simple_prices(spark, sf):
    k = F.col("p_partkey")
    said = F.element_at(F.array(*[F.format_string(f, F.col("p_size")) for f in ("US$ 1 or HK$%d.00 here", "$%d / song", "Rp%d.000 / 3 songs", "$%d", "JPY %d for 3, EUR 9")]), (k % 5 + 1).cast("int"))
    local = F.element_at(F.array(F.lit("HKD"), F.lit("USD"), F.lit("IDR"), F.lit(None).cast("string"), F.lit("CNY")), (k % 5 + 1).cast("int"))
    found = records.simple_price(said, local, {"US$": "USD", "HK$": "HKD", "Rp": "IDR", "JPY": "JPY", "EUR": "EUR"})
    return _t(spark, sf, "part").select("p_partkey", found.alias("f")).select("p_partkey", "f.amount", "f.currency")


@query(r"""with t as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'))) as term, 1.0 as w from documents union all select doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(source, '')), '[\p{L}\p{N}]+'))), 3.0 from documents), b as (select term, doc_id, max(w) as w from t group by 1, 2)
select term, count(*) as n, cast(sum(w) as double) as weight from b group by 1""")
def search_index(spark, sf):
    index = records.search_entries(_t(spark, sf, "documents").select("doc_id", "text", "source"), {"text": 1.0, "source": 3.0}, "doc_id")
    return index.groupBy("term").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query("""select event_id, case when event_type = 'view' then 'bemanicn_qty' when event_type = 'click' or user_id % 2 = 0 then 'community_qty' end as evidence from events""")
def evidence_words(spark, sf):
    events = _t(spark, sf, "events").withColumns({"source": F.when(F.col("user_id") % 2 == 0, "curated").otherwise("other"), "evidence": F.when(F.col("event_type") == "view", "bemanicn_qty").otherwise(F.col("event_type"))})
    return events.select("event_id", records.normalized_evidence(F.col("source"), F.col("evidence"), ("click",), ("curated",)).alias("evidence"))


@query("""with s as (select o_custkey as id, list(distinct o_orderstatus) as a, list(distinct case when o_orderkey % 2 = 0 then o_orderstatus else o_orderpriority end) as b from orders group by 1) select id, list_sort(list_concat(list_filter(a, lambda x: not list_contains(b, x)), list_filter(b, lambda x: not list_contains(a, x)))) as only_one from s""")
def source_differences(spark, sf):
    sets = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderstatus").alias("a"), F.collect_set(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority"))).alias("b"))
    return sets.select("id", F.array_sort(records.one_sided(F.col("a"), F.col("b"))).alias("only_one"))


# --- review, labels, exports -----------------------------------------------------------------------------------------


@query(f"""with v as (select k, n_name, {_LISTS} from (select c_custkey as k, * from customer) join nation on c_nationkey = n_nationkey),
 r as (select k, case when len(src) = 1 and list_contains(src, 'allnet') and n_name <> 'JAPAN' then 0 when len(games) = 0 then 2 when len(src) = 1 then 3 else 4 end as risk from v)
select k as id, risk, cast((row_number() over (order by risk, k) - 1) % 16 as int) as shard from r""")
def review_shards(spark, sf):
    rows = _tagged(_t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), F.initcap("n_name").alias("country"))).withColumnRenamed("k", "id")
    return review.review_shards(rows, review.risk_class(F.col("src"), F.col("games"), F.col("country")), "id", 16).select("id", "risk", "shard")


@query("""with e as (select user_id, event_id, event_type = 'error' or event_type = 'click' as m, sum(case when event_type in ('error', 'click') then 0 else 1 end) over (partition by user_id order by event_id) as h from events),
 r as (select *, sum(case when m then 1 else 0 end) over (partition by user_id, h order by event_id) as run from e), s as (select user_id, min(event_id) as stop from r where m and run = 3 group by 1)
select e.user_id, count(*) as n, max(e.event_id) as last from e left join s on s.user_id = e.user_id where stop is null or event_id <= stop group by 1""")
def rows_before_abort(spark, sf):
    events = _t(spark, sf, "events").select("user_id", "event_id", "event_type")
    kept = review.before_abort(events, ["user_id"], "event_id", F.col("event_type").isin("error", "click"), 3)
    return kept.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("select o_orderkey from orders where o_orderkey % 10 = 0 or date_diff('day', cast(o_orderdate as date), date '1998-01-01') > 360")
def stale_checks(spark, sf):
    rows = _t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.to_date("o_orderdate")).alias("checked"))
    return review.stale(rows, "checked", F.lit("1998-01-01").cast("date")).select("o_orderkey")


@query("""with p as (select s_suppkey * 11 as id, case when s_suppkey % 3 = 0 then 'AUTOMOBILE' end as seg, case when s_suppkey % 2 = 0 then s_nationkey end as nat from supplier)
select p.id, case when c_custkey is null then 'add' when (seg is not null and seg <> c_mktsegment) or (nat is not null and nat <> c_nationkey) then 'change' else 'same' end as action,
 case when c_custkey is not null then list_filter([case when seg is not null and seg <> c_mktsegment then 'seg' end, case when nat is not null and nat <> c_nationkey then 'nat' end], lambda x: x is not null) end as fields from p left join customer on c_custkey = p.id""")
def changed_records(spark, sf):
    now = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nat"))
    new = _t(spark, sf, "supplier").select((F.col("s_suppkey") * 11).alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "AUTOMOBILE").alias("seg"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("nat"))
    return review.changed(now, new, "id", ["seg", "nat"])


@query(f"""with c as (select c_custkey, {_lat('c_custkey')} as lat, {_lng('c_custkey')} as lng from customer), p as (select *, cast(floor((lng + 180) / 360 * (256 * 8 / 60.0::double)) as bigint) as cell_x, sin(radians(greatest(least(lat, 85.05::double), -85.05::double))) as s from c),
 q as (select *, cast(floor((0.5::double - ln((1 + s) / (1 - s)) / (4 * pi())) * (256 * 8 / 60.0::double)) as bigint) as cell_y from p) select cell_x, cell_y, count(*) as n, round(avg(lat), 6) as lat, round(avg(lng), 6) as lng, bool_or(c_custkey % 50 = 0) as has_big from q group by 1, 2""")
def map_clusters(spark, sf):
    rows = _at(_t(spark, sf, "customer").select("c_custkey"), "c_custkey")
    return review.map_clusters(rows, 3, F.col("c_custkey") % 50 == 0).select("cell_x", "cell_y", "n", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "has_big")


@query("""select c_custkey as id, case when n_regionkey % 2 = 0 and n_nationkey < 15 then 'Salut ' || c_name when n_nationkey < 20 then 'Hello ' || c_name else 'greet' || n_nationkey end as said from customer join nation on c_nationkey = n_nationkey""")
def translated_texts(spark, sf):
    nation = _t(spark, sf, "nation")
    key = F.concat(F.lit("greet"), "n_nationkey")
    texts = nation.where("n_nationkey < 20").select(key.alias("key"), F.lit("en").alias("locale"), F.lit("Hello {who}").alias("text")).union(nation.where("n_nationkey < 15").select(key, F.lit("fr"), F.lit("Salut {who}")))
    rows = _t(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), key.alias("what"), F.when(F.col("n_regionkey") % 2 == 0, "fr").otherwise("de").alias("lang"), F.create_map(F.lit("who"), F.col("c_name")).alias("values"))
    return labels.translated(rows, texts, "what", "lang", "said", "values").select("id", "said")


@query("""select doc_id, cast(nullif(instr(lower(text), 'the'), 0) - 1 as int) as start, cast(nullif(instr(lower(text), 'the'), 0) + 2 as int) as "end" from documents""")
def highlights(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", labels.highlighted(F.col("text"), F.lit("THE")).alias("h")).select("doc_id", "h.start", "h.end")


@query("""with t as (select p_brand, list_sort(list(distinct p_type)) as tags, min(p_name) as place from part group by 1), l as (select p_brand, p_brand || ' · ' || place || ' · ' || array_to_string(tags[1:3], ', ') || case when len(tags) > 3 then ' +' || (len(tags) - 3) else '' end as line from t)
select p_brand, case when length(line) <= 40 then line else rtrim(substr(line, 1, 39)) || '…' end as said from l""")
def page_descriptions(spark, sf):
    rows = _t(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("tags"), F.min("p_name").alias("place"))
    return rows.select("p_brand", labels.page_description(F.col("p_brand"), F.col("place"), F.col("tags"), 40, 3).alias("said"))


@query("""select p_partkey, list_sort(list_distinct(list_filter([case p_size % 4 when 0 then 'lightning' when 1 then 'gold' end, case p_partkey % 3 when 0 then 'gold' when 1 then 'plain' end], lambda x: x is not null))) as tags from part""")
def model_tags(spark, sf):
    one = F.element_at(F.array(*map(F.lit, ("Lightning Model", "20th anniversary GOLD", "n/a", "unknown kind"))), (F.col("p_size") % 4 + 1).cast("int"))
    two = F.element_at(F.array(*map(F.lit, ("gold cab", "standard", ""))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return _t(spark, sf, "part").select("p_partkey", labels.translated_models(F.concat(one, F.lit(" and "), two), [("lightning", "lightning"), ("gold", "gold"), ("standard", "plain")]).alias("tags"))


@query(f"""with v as (select k, {_LISTS} from (select c_custkey as k from customer)) select k as id, case when list_contains(src, 'ziv') and not list_contains(src, 'eagate') then 'Old One' else 'One' end as label, list_filter([case when list_contains(src, 'allnet') then 'allnet' end, case when list_contains(src, 'ziv') then 'ziv' end], lambda x: x is not null) as variants from v""")
def tag_labels(spark, sf):
    rows = _tagged(_t(spark, sf, "customer").select(F.col("c_custkey").alias("k")))
    label = labels.tag_label(F.lit("one"), F.col("src"), {"one": "One"}, [("one", "ziv", "eagate", "Old One")])
    return rows.select(F.col("k").alias("id"), label.alias("label"), labels.variants_of(F.lit("one"), F.col("src"), [("one", "allnet"), ("one", "ziv"), ("two", "eagate")]).alias("variants"))


@query(f"""with v as (select k, {_LISTS} from (select c_custkey as k from customer)) select k as id, case when k % 3 = 0 then 'approximate: city' end as position_caption, case when k % 4 = 0 then 'Mon' else 'hours not recorded' end as hours_caption, case when k % 5 = 0 then null when k % 2 = 0 then 'counts not shown: no evidence' else 'never counted' end as counts_caption, case when len(src) = 1 then 'only ' || src[1] end as provenance_caption from v""")
def detail_captions(spark, sf):
    k = F.col("k")
    rows = _tagged(_t(spark, sf, "customer").select(F.col("c_custkey").alias("k")))
    said = labels.detail_captions(F.when(k % 3 == 0, "city"), F.when(k % 4 == 0, "Mon").otherwise(""), F.when(k % 5 == 0, F.create_map(F.lit("g"), F.lit(1))), k % 2 == 0, F.col("src"))
    return rows.select(k.alias("id"), *[c.alias(name) for name, c in said.items()])


@query("""select c_custkey as id, c_name as name, '' as address, case when c_custkey % 2 = 0 then printf('%.7f', c_custkey / 1000.0::double) end as lat, case when c_custkey % 2 = 0 then printf('%.7f', c_custkey / 500.0::double) end as lng, 'X' as country, 'a;b' as games, '' as cabinets, c_mktsegment as source from customer""")
def sheet_rows(spark, sf):
    k = F.col("c_custkey")
    rows = _t(spark, sf, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("addr"), F.when(k % 2 == 0, k / 1000).alias("lat"), F.when(k % 2 == 0, k / 500).alias("lng"), F.lit("X").alias("country"), F.array(F.lit("a"), F.lit("b")).alias("games"), F.array().cast("array<string>").alias("cabs"), F.array("c_mktsegment").alias("src"))
    return rows.select("id", F.struct("*").alias("r")).join(sinks.sheet(rows).withColumn("n", F.col("name")), F.col("r.name") == F.col("n")).select("id", *sinks.SHEET)


@query("""with o as (select l_orderkey as id, case l_linenumber when 1 then 'one' when 2 then 'two' else 'other' end as tag, sum(cast(l_quantity as bigint)) as n from lineitem where l_orderkey % 7 <> 0 group by 1, 2) select id, list_sort(list(tag || ':' || n)) as counts from o group by 1""")
def open_shop_counts(spark, sf):
    shops = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("title_id"), F.col("l_quantity").cast("long").alias("quantity"))).alias("games"))
    out = readers.open_shops(shops, F.col("id") % 7 == 0, {1: "one", 2: "two"})
    return out.select("id", F.array_sort(F.transform(F.map_entries("counts"), lambda e: F.concat_ws(":", e["key"], e["value"]))).alias("counts"))


@query("select n_name, row_number() over (order by n_name) as place from nation")
def listed_names(spark, sf):
    rows = windows.dense_ids(_t(spark, sf, "nation").select("n_name", "n_nationkey"), [F.collate("n_name", "zh"), F.col("n_nationkey")], "place")
    return rows.select("n_name", "place")


@query("""with i as (select page_id, url, page_id % 3 as m from pages) select page_id, '/img/' || page_id as url, 1 as rank from i where m = 0 union all select page_id, url, case when m = 0 then 2 else 1 end from i where not regexp_matches(url, '(?i)/(stock|default|placeholder)')""")
def image_lists(spark, sf):
    item = lambda url, src: F.struct(url.alias("url"), src.alias("src"), F.lit(None).cast("string").alias("thumb"), F.lit(None).cast("string").alias("credit"))
    none, own = F.lit(None).cast("string"), F.concat(F.lit("/img/"), "page_id")
    images = F.array_compact(F.array(F.when(F.col("page_id") % 3 == 0, item(own, none)), item(F.lit("/stock/x"), none), item(none, F.col("url")), item(F.col("url"), none)))
    return review.image_records(_t(spark, sf, "pages").select("page_id", images.alias("images")), "images", "page_id").select("page_id", "url", F.col("rank").cast("int").alias("rank"))


# --- checks and pickings ---------------------------------------------------------------------------------------------


@query("""select doc_id, (contains(lower(text), 'no longer open') or contains(lower(text), 'closed down')) and not contains(lower(text), 'temporar') as closed, regexp_matches(lower(text), '\\b[0-9]+\\s*(machine|cab|cabinet|unit|seat)s?\\b') as counted from (select doc_id, case doc_id % 5 when 0 then 'No longer open' when 1 then 'closed down, temporarily' when 2 then '4 cabinets' when 3 then '4 songs' else coalesce(lang, '') end as text from documents)""")
def said_states(spark, sf):
    said = F.element_at(F.array(F.lit("No longer open"), F.lit("closed down, temporarily"), F.lit("4 cabinets"), F.lit("4 songs"), F.coalesce("lang", F.lit(""))), (F.col("doc_id") % 5 + 1).cast("int"))
    return _t(spark, sf, "documents").select("doc_id", text.closed_for_good(said).alias("closed"), text.quotes_quantity(said).alias("counted"))


@query("""with e as (select o_orderkey as k, o_orderkey % 4 as m, o_orderkey % 6 as q from orders), c as (select *, m = 0 as a, q = 0 as b from e)
select 'bemanicn_qty' as class, count(*) filter (where a) as n from c union all select 'ziv_comment', count(*) filter (where b) from c union all select 'community_qty', 0 from c group by 1 union all select 'any_real', count(*) filter (where a or b) from c union all select 'ziv_listed_only', count(*) filter (where m = 1 and not b) from c union all select 'cab_models', count(*) filter (where k % 9 = 0) from c union all select 'no_source', count(*) filter (where k % 2 = 0) from c""")
def evidence_classes(spark, sf):
    k = F.col("o_orderkey")
    pairs = F.array_compact(F.array(F.when(k % 4 == 0, F.struct(F.lit("a").alias("k"), F.lit("bemanicn_qty").alias("v"))), F.when(k % 4 == 1, F.struct(F.lit("b").alias("k"), F.lit("ziv_listed").alias("v"))), F.when(k % 6 == 0, F.struct(F.lit("c").alias("k"), F.lit("ziv_comment").alias("v")))))
    rows = _t(spark, sf, "orders").select(F.map_from_entries(pairs).alias("count_evidence"), F.when(k % 2 != 0, "s").alias("counts_src"), F.when(k % 9 == 0, F.create_map(F.lit("m"), F.lit(1))).alias("cab_models"))
    return checks.evidence_distribution(rows)


@query("""select p_brand, case when p_size < 10 then 'small' when p_retailprice > 1500 then 'dear' else 'passed' end as reason, count(*) as n from part group by 1, 2""")
def gate_counters(spark, sf):
    rows = readers.rejected(_t(spark, sf, "part"), [(F.col("p_size") < 10, "small"), (F.col("p_retailprice") > 1500, "dear")])
    return checks.gate_counts(rows, "reject_reason", ["p_brand"])


@query("""select page_id from pages where regexp_extract(url, '/([0-9]+)$', 1) not in (select cast(s_suppkey as varchar) from supplier where s_suppkey % 3 = 0 union select cast(c_custkey as varchar) from customer where c_custkey % 2 = 0) or page_id % 4 = 0""")
def dangling_pages(spark, sf):
    url = F.when(F.col("page_id") % 4 != 0, F.col("url")).otherwise("https://x.example/none/0000000")
    feed = _t(spark, sf, "pages").select("page_id", url.alias("url"))
    link = lambda t, k, m: _t(spark, sf, t).where(F.col(k) % m == 0).select(F.array(F.concat(F.lit("https://y.example/a/"), k), F.lit("https://y.example/about")).alias("links"))
    return checks.dangling(feed, link("supplier", "s_suppkey", 3).union(link("customer", "c_custkey", 2)), "url", "links", r"/([0-9]+)$").select("page_id")


@query("""with c as (select l_orderkey as k, l_linenumber as id, case when l_quantity > 40 then 'high' when l_quantity > 20 then 'medium' when l_quantity > 5 then 'low' else 'reject' end as grade, l_extendedprice as d, l_discount as s from lineitem) select k, arg_min(id, (case grade when 'high' then 0 when 'medium' then 1 else 2 end, d, -s, id)) as id from c where grade <> 'reject' group by 1""")
def best_candidates(spark, sf):
    grade = F.when(F.col("l_quantity") > 40, "high").when(F.col("l_quantity") > 20, "medium").when(F.col("l_quantity") > 5, "low").otherwise("reject")
    rows = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("id"), grade.alias("grade"), F.col("l_extendedprice").alias("distance_m"), F.col("l_discount").alias("similarity"))
    return checks.best_candidates(rows, "k", "id").select("k", "id")


@query("""with p as (select user_id % 40 as listing, event_type, user_id, cast(1 + event_id % 6 as int) as page from events), f as (select listing, event_type, user_id, min(page) as page from p group by 1, 2, 3), s as (select listing, min(page) as stop from (select distinct listing, page from p except select distinct listing, page from f) group by 1)
select f.* from f left join s on s.listing = f.listing where stop is null or page < stop""")
def listing_pages(spark, sf):
    rows = _t(spark, sf, "events").select((F.col("user_id") % 40).alias("listing"), "event_type", "user_id", (1 + F.col("event_id") % 6).cast("int").alias("page"))
    return readers.pages_until_known(rows, "listing", "page", ["event_type", "user_id"])


@query(f"""with r as (select c_custkey as id, 'a' || (c_custkey % 60) as addr, case when c_custkey % 3 = 0 then 10.0::double when c_custkey % 3 = 1 then 11.0::double end as lat, c_custkey % 3 = 0 as approx from customer), c as (select 'a' || s_suppkey as addr, case when s_suppkey % 4 <> 0 then 20.0::double + s_suppkey % 30 end as lat from supplier)
select id, case when not approx and r.lat is not null then r.lat when c.lat between 20 and 40 then c.lat end as lat, coalesce((approx or r.lat is null) and c.lat between 20 and 40, false) as from_cache from r left join c on c.addr = r.addr""")
def refreshed_cache(spark, sf):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    lat = F.when(k % 3 == 0, 10.0).when(k % 3 == 1, 11.0)
    rows = _t(spark, sf, "customer").select(k.alias("id"), F.concat(F.lit(" A"), k % 60).alias("addr"), lat.alias("lat"), lat.alias("lng"), (k % 3 == 0).alias("approx"))
    answer = F.when(s % 4 != 0, 20.0 + s % 30)
    cache = _t(spark, sf, "supplier").select(F.concat(F.lit("a"), s).alias("addr_key"), answer.alias("lat"), answer.alias("lng"))
    return geocoders.refreshed(rows, cache, box=(20.0, 40.0, 0.0, 90.0)).select("id", "lat", "from_cache")


@query("""with p as (select c_custkey as id, a.n_name as want, case when c_custkey % 2 = 0 then r.r_name else b.n_name end as got, a.n_nationkey as x, b.n_nationkey as y, a.n_regionkey as xr, r.r_regionkey as r, c_custkey % 2 = 0 as up from customer join nation a on c_nationkey = a.n_nationkey join nation b on b.n_nationkey = (c_nationkey + c_custkey) % 25 join region r on r.r_regionkey = c_custkey % 5)
select id, want, got, case when up then xr = r else x = y end as related from p""")
def related_places(spark, sf):
    nation, region, c = _t(spark, sf, "nation"), _t(spark, sf, "region"), _t(spark, sf, "customer").select("c_custkey", "c_nationkey")
    areas = region.select(F.concat(F.lit("r"), "r_regionkey").alias("area_id"), F.col("r_name").alias("base"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth")).union(nation.select(F.concat(F.lit("n"), "n_nationkey"), "n_name", F.concat(F.lit("r"), "n_regionkey"), F.lit(1)))
    other = nation.select(F.col("n_nationkey").alias("other"), F.col("n_name").alias("there"))
    rows = c.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(other, F.col("other") == (F.col("c_nationkey") + F.col("c_custkey")) % 25).join(region, F.col("r_regionkey") == F.col("c_custkey") % 5)
    pairs = rows.select(F.col("c_custkey").alias("id"), F.col("n_name").alias("want"), F.when(F.col("c_custkey") % 2 == 0, F.col("r_name")).otherwise(F.col("there")).alias("got"))
    return checks.related_areas(pairs, areas).select("id", "want", "got", "related")
