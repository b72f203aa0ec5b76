"""From units to venues: matching tiers in order, components, survivorship, ids.

Units: unit_id, source, name, addr, lat, lng, country, source_url, games, and, where known, pref, cn_prov, cn_city. Each
tier gives edges (a, b, tier) and sees what the tiers before it have linked; tiers only add links. Evidence stays in the
edge table for audit. A pair stands once; which end is the better one's partner is ranked from both ends.

Many units may stand on one spot (a town's centre) or have one name (a chain): units that agree in all that a tier looks
at go in as one, and names meet on their rarest pieces, so that no tier lists all pairs of such a pile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scripts
from ..functions.identity import stable_key
from ..functions.text import bigrams, common_prefix, dice, folded, street_signature, with_name_keys, with_similarity
from ..operators import aggregates, graph, joins, windows
from ..session import measured_joins
from . import two_scripts

NEAR_M, NEAR_SIMILARITY = 120.0, 0.6
LOCAL_M, BRANCH_M, DUPLICATE_M = 3000.0, 600.0, 30.0
CLOSE_M, AROUND_M = 30.0, 60.0
PROVINCE_SIMILARITY = 0.8
CHINA_M, CHINA_ALONE_M = 500.0, 200.0
#: Characters that a name needs to be a key, that brands need to share, and that one source's own doubles need.
KEY_CHARS, BRAND_CHARS, DOUBLE_CHARS, STREET_CHARS = 5, 5, 3, 4
#: Which source's name and address win, and which sources are official.
PRIORITY = ("allnet", "eagate", "wahlap", "round1usa", "bemanicn", "ziv")
OFFICIAL = ("allnet", "eagate", "wahlap")
OPTIONAL = {"pref": "string", "cn_prov": "string", "cn_city": "string", "notes": "string"}


def priority(source: Column) -> Column:
    return windows.first_rule([(source == s, f"{k:02d}") for k, s in enumerate(PRIORITY)], "99")


def _sided(pairs: DataFrame, units: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b) with columns of their units, prefixed a_ and b_."""
    for side in "ab":
        pairs = pairs.join(units.select(F.col("unit_id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
    return pairs


def _edges(pairs: DataFrame, tier: str) -> DataFrame:
    return pairs.select("a", "b", F.lit(tier).alias("tier"))


def _apart(pairs: DataFrame, clusters: DataFrame | None) -> DataFrame:
    """Pairs whose units nothing has linked yet."""
    if clusters is None:
        return pairs
    own = clusters.select("unit_id", "cluster_id")
    return _sided(pairs, own, ["cluster_id"]).where("a_cluster_id <> b_cluster_id").select(pairs.columns)


# --- alike and near --------------------------------------------------------------------------------------------------


def alike_nearby(units: DataFrame, radius_m: float = NEAR_M) -> DataFrame:
    """Pairs (a, b, distance_m) of units closer than radius_m whose names may have a similarity of NEAR_SIMILARITY: every pair that has, and few others.

    Names meet on pieces of either form (with brackets, without). Two sets of two-character pieces with a dice of 0.6 share
    at least 3/7 of each, so one of the other 4/7 + 1 rarest of both; the words of the shorter name share 0.6 of it with
    the longer one's, so one of its rarest.
    """
    forms = F.array(*[F.struct(F.lit(f).alias("form"), F.col(f"name_{f}").alias("name")) for f in ("bare", "full")])
    named = units.select("unit_id", F.explode(forms).alias("f")).select("unit_id", "f.form", "f.name")
    spaceless = named.withColumn("grams", bigrams(F.replace(F.col("name"), F.lit(" "), F.lit(""))))
    grams = spaceless.select("unit_id", "form", F.explode("grams").alias("g")).select("unit_id", "form", F.concat_ws(":", F.lit("g"), "form", "g").alias("key"))
    words = named.select("unit_id", "form", F.explode(F.array_distinct(F.filter(F.split("name", " "), lambda w: w != ""))).alias("w")).select("unit_id", "form", F.concat_ws(":", F.lit("w"), "form", "w").alias("key"))
    spots = units.select("unit_id", "lat", "lng")
    found = None
    for pieces, shorter, share in ((grams, False, F.col("n") * 3 / 7), (words, True, F.col("n") * NEAR_SIMILARITY)):
        left = joins.rare_pieces(pieces, share, ["unit_id", "form"])
        right = joins.rare_pieces(pieces, F.lit(1), ["unit_id", "form"]) if shorter else left  # the longer one's words, all
        met = joins.spatial_join(spots.join(left, "unit_id"), spots.join(right, "unit_id"), radius_m, on=("key",)).where("l_unit_id <> r_unit_id")
        if shorter:
            met = met.where("l_n <= r_n")
        met = met.select(F.greatest("l_unit_id", "r_unit_id").alias("a"), F.least("l_unit_id", "r_unit_id").alias("b"), "distance_m")
        found = met if found is None else found.unionByName(met)
    return found.where(F.col("distance_m") < radius_m).groupBy("a", "b").agg(F.min("distance_m").alias("distance_m"))


def near_and_alike(units: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Units of different sources within NEAR_M whose names are alike, each the other's best in its source.

    Of units of one source, name and spot only the last can be anyone's best (ties go to the larger id), so only it goes in,
    and only where another source has a unit around.
    """
    one = units.where("lat is not null and lng is not null").groupBy("source", "name_full", "name_bare", "lat", "lng").agg(F.max("unit_id").alias("unit_id"))
    one = graph._written(joins.meeting(one, NEAR_M, "source"))
    pairs = _sided(alike_nearby(one), one, ["source", "name_bare", "name_full"]).where("a_source <> b_source")
    bare = with_similarity(pairs, "a_name_bare", "b_name_bare", "_s1")
    alike = with_similarity(bare, "a_name_full", "b_name_full", "_s2").withColumn("similarity", F.greatest("_s1", "_s2")).where(F.col("similarity") >= NEAR_SIMILARITY)
    return _edges(joins.mutual_best(alike, "a", "b", [-F.col("similarity"), F.col("distance_m")], "a_source", "b_source", last=True), "near_and_alike")


# --- an official and a community unit on one spot ----------------------------------------------------------------------


def proximity(units: DataFrame, clusters: DataFrame) -> DataFrame:
    """An official and a community unit of different clusters closer than CLOSE_M whose names read alike, or that are alone on a spot.

    Alone: of all clusters (each at its first unit's position) just two are within AROUND_M of either. Each is the other's
    best in its source; pairs are then taken in order of similarity, so that no cluster gets two units of one official
    source.
    """
    own = units.join(clusters.select("unit_id", "cluster_id"), "unit_id").where("lat is not null and lng is not null")
    official = own.where(F.col("source").isin(*OFFICIAL)).select("unit_id", "cluster_id", "source", "name", "lat", "lng")
    other = own.where(~F.col("source").isin(*OFFICIAL)).select("unit_id", "cluster_id", "source", "name", "lat", "lng")
    near = joins.spatial_join(official, other, CLOSE_M).where((F.col("distance_m") < CLOSE_M) & (F.col("l_cluster_id") != F.col("r_cluster_id")))
    heads = own.groupBy("cluster_id").agg(F.min_by(F.struct("lat", "lng"), "unit_id").alias("at")).select("cluster_id", "at.lat", "at.lng")
    ends = near.select(F.explode(F.array(F.struct(F.col("l_unit_id").alias("unit_id"), F.col("l_lat").alias("lat"), F.col("l_lng").alias("lng")), F.struct(F.col("r_unit_id").alias("unit_id"), F.col("r_lat").alias("lat"), F.col("r_lng").alias("lng")))).alias("e")).select("e.*").distinct()
    around = joins.spatial_join(ends, heads, AROUND_M).where(F.col("distance_m") < AROUND_M).groupBy(F.col("l_unit_id").alias("unit_id")).agg(F.slice(F.collect_set("r_cluster_id"), 1, 3).alias("near"))
    for side in "lr":
        near = near.join(around.select(F.col("unit_id").alias(f"{side}_unit_id"), F.col("near").alias(f"{side}_near")), f"{side}_unit_id", "left")
    none = F.array().cast(near.schema["l_near"].dataType)
    clusters_near = F.size(F.array_union(F.coalesce("l_near", none), F.coalesce("r_near", none)))
    read = near.withColumn("_r", scripts.read_pair("l_name", "r_name"))
    ruled = read.withColumn("rule", scripts.proximity_rule(F.col("distance_m"), F.col("_r.similarity"), F.col("_r.inside"), clusters_near)).where("rule is not null")
    pairs = ruled.select(F.col("l_unit_id").alias("a"), F.col("r_unit_id").alias("b"), F.col("l_cluster_id").alias("a_cluster"), F.col("r_cluster_id").alias("b_cluster"), F.col("l_source").alias("a_source"), F.col("r_source").alias("b_source"), F.col("_r.similarity").alias("similarity"), "distance_m")
    best = joins.mutual_best(pairs, "a", "b", [-F.col("similarity"), F.col("distance_m")], "a_source", "b_source", last=True)
    members = official.groupBy("cluster_id").agg(F.collect_set("source").alias("members"))
    return _edges(joins.one_per_group(best, members, [-F.col("similarity"), F.col("distance_m"), F.col("a"), F.col("b")]), "proximity")


# --- one name --------------------------------------------------------------------------------------------------------


def _keys() -> Column:
    """A name as a key: whole, and what stands in its brackets (as sources write two languages)."""
    return F.array_distinct(F.filter(F.array("compact_full", "compact_inner"), lambda k: F.char_length(k) >= KEY_CHARS))


def exact_names() -> Column:
    """Whether two names (a_, b_) are one: the same, one in the other's brackets, or the same in brackets after one brand."""
    long = lambda c: F.char_length(c) >= KEY_CHARS
    whole = long("a_compact_full") & (F.col("a_compact_full") == F.col("b_compact_full"))
    inner = (long("a_compact_inner") & (F.col("a_compact_inner") == F.col("b_compact_full"))) | (long("b_compact_inner") & (F.col("b_compact_inner") == F.col("a_compact_full")))
    brand = common_prefix(F.col("a_compact_bare"), F.col("b_compact_bare")) >= BRAND_CHARS
    return whole | inner | (long("a_compact_inner") & (F.col("a_compact_inner") == F.col("b_compact_inner")) & brand)


NAMES = ["compact_full", "compact_inner", "compact_bare"]


def same_name_nearby(units: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Units of different sources and one exact name within LOCAL_M in one country, each the other's nearest, until none is new.

    Units of one source, name and spot go in as their first: they become one venue as doubles anyhow.
    """
    one = units.where("lat is not null and lng is not null").groupBy("source", "country", *NAMES, "lat", "lng").agg(F.min("unit_id").alias("unit_id"))
    keyed = one.withColumn("key", F.explode(_keys()))
    near = joins.spatial_join(keyed, keyed, LOCAL_M, on=("country", "key")).where((F.col("l_source") != F.col("r_source")) & (F.col("l_unit_id") > F.col("r_unit_id")) & (F.col("distance_m") < LOCAL_M))
    pairs = near.select(F.col("l_unit_id").alias("a"), F.col("r_unit_id").alias("b"), "distance_m").distinct()
    named = _sided(pairs, one, NAMES).where(exact_names()).select("a", "b", "distance_m")
    return _edges(joins.mutual_nearest(named, clusters), "same_name_nearby")


def branch_names(units: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """A bare name and the same with a branch in brackets, of different sources within BRANCH_M in one country, where neither has another candidate."""
    base = units.where((F.char_length("compact_bare") >= KEY_CHARS) & F.col("lat").isNotNull() & F.col("lng").isNotNull()).select("unit_id", "source", "country", F.col("compact_bare").alias("key"), "lat", "lng", "name_inner")
    near = joins.spatial_join(base.where("name_inner = ''"), base.where("name_inner <> ''"), BRANCH_M, on=("country", "key")).where((F.col("l_source") != F.col("r_source")) & (F.col("distance_m") < BRANCH_M))
    pairs = near.select(F.greatest("l_unit_id", "r_unit_id").alias("a"), F.least("l_unit_id", "r_unit_id").alias("b"))
    return _edges(joins.only_candidates(_apart(pairs, clusters), "a", "b"), "branch_names")


def repeated_in_source(units: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Units of one source and whole name within DUPLICATE_M. Those on one spot are linked to their first, and only the firsts are compared."""
    named = units.where((F.char_length("compact_full") >= DOUBLE_CHARS) & F.col("lat").isNotNull() & F.col("lng").isNotNull()).select("unit_id", "source", F.col("compact_full").alias("key"), "lat", "lng")
    first = named.groupBy("source", "key", "lat", "lng").agg(F.min("unit_id").alias("unit_id"))
    near = joins.spatial_join(first, first, DUPLICATE_M, on=("source", "key")).where((F.col("l_unit_id") > F.col("r_unit_id")) & (F.col("distance_m") < DUPLICATE_M))
    pairs = near.select(F.col("l_unit_id").alias("a"), F.col("r_unit_id").alias("b"))
    return _edges(joins.star_edges(named, ["source", "key", "lat", "lng"]).unionByName(pairs), "repeated_in_source")


def without_position(units: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Units of different sources, one name and countries that don't differ, of which one or both have no position; if both, of one address too.

    Units that agree in names, country, source and position or address are a group. Groups are compared, and where two
    link, each unit of one is linked to the first of the other: as many edges as units, not pairs.
    """
    known = F.when(~F.col("country").isin("Unknown"), F.col("country"))
    place = F.when(F.col("lat").isNull() | F.col("lng").isNull(), folded(F.regexp_replace(F.coalesce("addr", F.lit("")), r"\([^)]*\)|（[^）]*）", " ")))
    rows = units.select("unit_id", "source", known.alias("land"), place.alias("at"), (F.coalesce(F.col("addr"), F.lit("")) != "").alias("told"), *NAMES)
    same = ["source", "land", "at", "told", *NAMES]
    groups = rows.groupBy(*same).agg(F.min("unit_id").alias("first"))
    keys = F.array_union(_keys(), F.filter(F.array("compact_full"), lambda k: F.char_length(k) >= DOUBLE_CHARS))
    keyed = groups.withColumn("key", F.explode(keys))
    own, other = (keyed.select("key", *[F.col(c).alias(f"{p}_{c}") for c in ("first", *same)]) for p in "ab")
    met = own.where("a_at is not null").join(other, "key").where("a_first <> b_first and a_source <> b_source and (a_land is null or b_land is null or a_land = b_land)")
    named = met.where((F.col("a_compact_full") == F.col("b_compact_full")) | exact_names())
    fits = named.where("b_at is null or (a_at = b_at and a_told and b_told)")
    linked = fits.select(F.col("a_first").alias("first"), F.col("b_first").alias("to")).unionByName(fits.select(F.col("b_first").alias("first"), F.col("a_first").alias("to"))).distinct()
    first = F.min("unit_id").over(Window.partitionBy(*same))
    return _edges(rows.withColumn("first", first).join(linked, "first").select(F.greatest("unit_id", "to").alias("a"), F.least("unit_id", "to").alias("b")).distinct(), "without_position")


def one_street_address(units: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Units of one country, name without brackets, house number and street, wherever they are placed."""
    signed = units.where(F.char_length("compact_bare") >= STREET_CHARS).withColumns({"street": street_signature(F.coalesce("addr", F.lit(""))), "_land": F.coalesce("country", F.lit(""))})
    return _edges(joins.star_edges(signed, ["_land", "compact_bare", "street"]), "one_street_address")


# --- Chinese venues --------------------------------------------------------------------------------------------------


def chinese_similarity(pairs: DataFrame, geos: Column) -> DataFrame:
    """pairs (a_, b_compact_full) with similarity: dice of the whole names, or of both without the names of places in geos (the longest first), where four characters or more are left."""
    ordered = F.array_sort(F.filter(F.array_distinct(geos), lambda g: F.char_length(F.coalesce(g, F.lit(""))) >= 2), lambda x, y: F.when(F.char_length(x) != F.char_length(y), F.char_length(y) - F.char_length(x)).when(x < y, -1).when(x > y, 1).otherwise(0))
    rows = pairs.withColumn("_g", ordered)
    for s in "ab":
        rows = rows.withColumn(f"_{s}", F.aggregate("_g", F.col(f"{s}_compact_full"), lambda text, g: F.replace(text, g, F.lit(""))))
        rows = rows.withColumns({f"_{s}1": bigrams(F.col(f"{s}_compact_full")), f"_{s}2": bigrams(F.col(f"_{s}"))})
    whole = F.when(F.col("a_compact_full") == F.col("b_compact_full"), F.when(F.col("a_compact_full") != "", 1.0).otherwise(0.0)).otherwise(dice(F.col("_a1"), F.col("_b1")))
    rest = F.when((F.char_length("_a") >= 4) & (F.char_length("_b") >= 4), F.when(F.col("_a") == F.col("_b"), 1.0).otherwise(dice(F.col("_a2"), F.col("_b2")))).otherwise(0.0)
    return rows.withColumn("similarity", F.greatest(whole, rest)).drop("_g", "_a", "_b", "_a1", "_a2", "_b1", "_b2")


def with_chinese_places(units: DataFrame) -> DataFrame:
    """units with cn_prov and cn_city where they can be told: of community units from a note "region: province city", of official ones the province from pref and the longest city of it that their name or address has."""
    words = F.split(F.trim(F.regexp_extract(F.coalesce("notes", F.lit("")), r"region:\s*([^;]+)", 1)), r"\s+")
    noted = F.when(F.get(words, F.lit(0)) != "", scripts.area_base(F.get(words, F.lit(0))))
    prov = F.coalesce("cn_prov", F.when(F.col("source") == "wahlap", scripts.area_base(F.col("pref"))), F.when(F.col("source") == "bemanicn", noted))
    rows = units.withColumn("cn_prov", F.nullif(prov, F.lit("")))
    rows = rows.withColumn("cn_city", F.coalesce("cn_city", F.when((F.col("source") == "bemanicn") & noted.isNotNull(), F.coalesce(scripts.area_base(F.get(words, F.lit(1))), noted))))
    cities = rows.where("source = 'bemanicn' and cn_prov is not null and char_length(cn_city) >= 2 and cn_city <> cn_prov").select(F.col("cn_prov").alias("_prov"), F.col("cn_city").alias("_city")).distinct()
    open_rows = rows.where("source = 'wahlap' and cn_city is null").select("unit_id", "cn_prov", F.concat_ws(" ", "name", "addr").alias("_hay"))
    named = open_rows.join(cities, (F.col("cn_prov") == F.col("_prov")) & F.contains("_hay", "_city"))
    found = named.groupBy("unit_id").agg(F.min_by("_city", F.struct(-F.char_length("_city"), "_city")).alias("_found"))
    return rows.join(found, "unit_id", "left").withColumn("cn_city", F.coalesce("cn_city", "_found")).drop("_found")


def best_in_province(units: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Each bemanicn unit and the wahlap unit of its province whose name is most like its own (the first of equals), at PROVINCE_SIMILARITY or more, where their cities don't differ."""
    placed = with_chinese_places(units).where("cn_prov is not null").select("unit_id", "source", "cn_prov", "cn_city", "compact_full")
    own, other = (placed.where(F.col("source") == s).select([F.col(c).alias(f"{p}_{c}") for c in placed.columns]) for p, s in (("a", "bemanicn"), ("b", "wahlap")))
    met = own.join(other, F.col("a_cn_prov") == F.col("b_cn_prov"))
    met = met.where("b_cn_city is null or a_cn_city is null or b_cn_city = a_cn_city or a_cn_city = a_cn_prov")
    alike = chinese_similarity(met, F.array("a_cn_prov", "a_cn_city", "b_cn_city")).where(F.col("similarity") >= PROVINCE_SIMILARITY)
    best = alike.groupBy(F.col("a_unit_id").alias("a")).agg(F.min_by("b_unit_id", F.struct(-F.col("similarity"), F.col("b_unit_id"))).alias("b"))
    return _edges(best, "best_in_province")


def same_chinese_place(units: DataFrame, clusters: DataFrame | None = None, radius_m: float = CHINA_M, alone_m: float = CHINA_ALONE_M) -> DataFrame:
    """Units in China within radius_m whose names agree on brand, branch, city and building, each the other's best in its source; without a building they must be closer."""
    own = scripts.with_chinese_keys(with_chinese_places(units.where("country = 'China' and lat is not null and lng is not null")))
    # Names that agree share BRAND characters, so they meet on them.
    keyed = own.withColumn("key", F.substring("cn_brand", 1, scripts.BRAND)).where(F.char_length("key") == scripts.BRAND).select("unit_id", "lat", "lng", "key")
    near = joins.spatial_join(keyed, keyed, radius_m, on=("key",)).where("l_unit_id > r_unit_id").select(F.col("l_unit_id").alias("a"), F.col("r_unit_id").alias("b"), "distance_m")
    pairs = _sided(_apart(near, clusters), own, ["source", "name", "cn_brand", "cn_whole", "cn_prov", "cn_city", "compact_full"])
    why = scripts.with_place_reason(pairs)
    kept = why.where((F.col("reason") == "landmark_agree") | ((F.col("reason") == "brand_only") & (F.col("distance_m") <= alone_m)))
    alike = chinese_similarity(kept, F.array("a_cn_prov", "a_cn_city", "b_cn_city"))
    return _edges(joins.mutual_best(alike, "a", "b", [-F.col("similarity"), F.col("distance_m")], "a_source", "b_source", last=True), "same_chinese_place")


# --- all tiers -------------------------------------------------------------------------------------------------------

#: Tiers that need no clusters are linked together with the next that does.
TIERS = (near_and_alike, proximity, same_name_nearby, branch_names, repeated_in_source, without_position, one_street_address, best_in_province, same_chinese_place)
BLIND = (near_and_alike, repeated_in_source, without_position, one_street_address, best_in_province)


def prepared(units: DataFrame) -> DataFrame:
    """units with all columns that tiers read, written once."""
    missing = {c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in units.columns}
    return graph._written(with_name_keys(units.withColumns(missing)))


def linked(units: DataFrame, readings: dict[str, list[str]] | None = None) -> DataFrame:
    """All edges (a, b, tier) of all tiers of prepared() units, in their order. readings: sounds of Chinese characters, for the tier of two scripts, which needs them."""
    ids = units.select("unit_id")
    found, clusters = None, ids.withColumn("cluster_id", F.col("unit_id"))
    tiers = list(TIERS)
    if readings:
        tiers.insert(tiers.index(best_in_province), lambda own, label: two_scripts.same_place(own, label, readings))
    for tier in tiers:
        if tier not in BLIND and found is not None:
            clusters = graph._written(graph.labelled(ids, found.select("a", "b")))
        own = graph._written(tier(units, clusters))
        found = own if found is None else found.unionByName(own)
    return found


def venues(units: DataFrame, readings: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each venue, with what its units say together, a stable key and a dense id."""
    with measured_joins(units.sparkSession):
        own = prepared(units)
        clustered = graph.labelled(own, linked(own, readings).select("a", "b"))
        lead = aggregates.survivors(clustered.select("cluster_id", "unit_id", "source", "name", "addr", "lat", "lng", "country", "source_url"), "cluster_id", priority(F.col("source")))
        sets = clustered.groupBy("cluster_id").agg(F.array_sort(F.collect_set("source")).alias("src"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("games")))).alias("games"))
        sid = stable_key(F.col("source_url"), [("z", r"zenius[^/]*/arcades?/(\d+)"), ("b", r"bemanicn\.[a-z]+/s/(\d+)")], [F.col("country"), F.col("name"), F.col("addr")])
        out = lead.join(sets, "cluster_id").withColumn("sid", sid).drop("unit_id", "source")
        return windows.dense_ids(out, [F.col("country"), F.lower("name"), F.col("addr"), F.col("cluster_id")])
