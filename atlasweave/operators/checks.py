"""Data quality: validation, placement, overlays, corrections, invariants, guards. Each decision is also a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def validated_positions(rows: DataFrame, boxes: DataFrame, official: Column, row_id: str = "id") -> DataFrame:
    """rows with action: an official row outside its country's boxes loses its position, another gets the country that it lies in, and one that lies in none is flagged.

    boxes: country, ordinal, south, north, west, east; a reference table (its size is checked).
    """
    if boxes.count() > 5000:
        raise ValueError("too many boxes to send to every task")
    inside = (F.col("lat") >= F.col("south")) & (F.col("lat") <= F.col("north")) & (F.col("lng") >= F.col("west")) & (F.col("lng") <= F.col("east"))
    named = boxes.select(F.col("country").alias("_box"), "ordinal", "south", "north", "west", "east")
    met = rows.join(F.broadcast(named), inside, "left").groupBy(row_id).agg(F.collect_set("_box").alias("_in"), F.min_by("_box", "ordinal").alias("_first"))
    out = rows.join(met, row_id)
    fine = F.col("lat").isNull() | F.array_contains("_in", F.col("country"))
    action = F.when(fine, "keep").when(official, "null_position").when(F.col("_first").isNotNull(), "fix_country").otherwise("flag")
    out = out.withColumn("action", action)
    moved = F.when(F.col("action") == "fix_country", F.col("_first")).otherwise(F.col("country"))
    return out.withColumns({"country": moved, **{c: F.when(F.col("action") == "null_position", None).otherwise(F.col(c)) for c in ("lat", "lng")}}).drop("_in", "_first")


def placed(rows: DataFrame, areas: DataFrame, area: str = "area_id", guarded: Column | None = None) -> DataFrame:
    """Rows without a position get their area's centre, marked with its level; others stay, and so do rows for which guarded holds (as those of territories that the areas aren't of)."""
    centre = areas.select(area, F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.col("level").alias("_level"))
    out = rows.join(centre, area, "left")
    use = F.col("lat").isNull() & F.col("_lat").isNotNull() & (~F.coalesce(guarded, F.lit(False)) if guarded is not None else F.lit(True))
    return out.withColumns({"approx": use, "approx_level": F.when(use, F.col("_level")), "lat": F.when(use, F.col("_lat")).otherwise(F.col("lat")), "lng": F.when(use, F.col("_lng")).otherwise(F.col("lng"))}).drop("_lat", "_lng", "_level")


def judged_corrections(proposals: DataFrame, rows: DataFrame, row_id: str = "id", least_gain_m: float = 2000.0) -> DataFrame:
    """Proposals (id, field, value, confidence, evidence_url, quote, lat, lng) with the reason that each is refused, or null."""
    here = rows.select(F.col(row_id), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.lit(True).alias("_known"))
    both = proposals.join(here, row_id, "left")
    gain = geo.haversine("_lat", "_lng", "lat", "lng")
    reason = (
        F.when(F.col("_known").isNull(), "unknown_row")
        .when(~F.coalesce(F.col("field").isin("name", "addr", "location", "closed", "games"), F.lit(False)), "field")
        .when(~F.coalesce(F.col("confidence") == "high", F.lit(False)), "confidence")
        .when(~F.coalesce(F.col("evidence_url").rlike("^https?://"), F.lit(False)), "evidence")
        .when(F.coalesce(F.length(F.trim("quote")), F.lit(0)) == 0, "quote")
        .when((F.col("field") == "location") & ~geo.valid("lat", "lng"), "position")
        .when((F.col("field") == "location") & F.col("_lat").isNotNull() & (gain < least_gain_m), "small_move")
    )
    return both.withColumn("reason", reason).drop("_lat", "_lng", "_known")


def attested(rows: DataFrame, overlay: DataFrame, row_id: str = "id", tags: str = "tags") -> DataFrame:
    """Owner-attested facts: excluded rows go, closed ones are marked, tags are added, then taken away."""
    facts = overlay.select(row_id, F.col("exclude").alias("_x"), F.col("closed").alias("_c"), F.col("add").alias("_a"), F.col("remove").alias("_r"))
    none = F.array().cast("array<string>")
    out = rows.join(facts, row_id, "left").where(~F.coalesce("_x", F.lit(False)))
    kept = F.array_except(F.array_union(tags, F.coalesce("_a", none)), F.coalesce("_r", none))
    return out.withColumn(tags, F.array_sort(kept)).withColumn("closed", F.coalesce("_c", F.lit(False))).drop("_x", "_c", "_a", "_r")


def violations(rows: DataFrame, invariants: dict[str, Column]) -> DataFrame:
    """How many rows break each invariant (a condition that must hold; null breaks it): name, n. One pass."""
    counts = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in invariants.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("invariant"), F.col(n).alias("n")) for n in invariants])).alias("v")).select("v.*")


def require(rows: DataFrame, invariants: dict[str, Column]) -> DataFrame:
    """rows, or an error if any breaks an invariant."""
    broken = [f"{r.invariant}: {r.n}" for r in violations(rows, invariants).where("n > 0").collect()]
    if broken:
        raise ValueError("invariants do not hold: " + "; ".join(broken))
    return rows


def decided(reports: DataFrame) -> DataFrame:
    """What to do with reports (verdict, confidence, existing): a table of cases, first match first."""
    sure, likely = F.col("confidence") == "high", F.col("confidence").isin("high", "medium")
    decision = (
        F.when(F.coalesce("existing", F.lit(False)), "keep_existing")
        .when((F.col("verdict") == "closed") & sure, "close")
        .when((F.col("verdict") == "not_a_venue") & sure, "exclude")
        .when((F.col("verdict") == "open") & likely, "confirm")
        .when((F.col("verdict") == "moved") & sure, "relocate")
        .otherwise("review")
    )
    return reports.withColumn("decision", decision)


def road_number(text: Column) -> Column:
    """Road and house number of a Chinese address; null without both."""
    found = r"(\p{IsHan}{1,8}?(?:大道|路|街|道|巷|胡同))([0-9]+(?:-[0-9]+)?)号"
    road, number = (F.regexp_extract(F.coalesce(text, F.lit("")), found, k) for k in (1, 2))
    return F.when(road != "", F.struct(road.alias("road"), number.alias("number")))


def same_road_number(addr: Column, answer: Column) -> Column:
    """Whether an answer repeats the road and the number of an address; either alone stands for nothing."""
    a, b = road_number(addr), road_number(answer)
    return F.coalesce((a["number"] == b["number"]) & (F.contains(answer, a["road"]) | F.contains(addr, b["road"])), F.lit(False))


def geocode_gate(candidates: DataFrame, slack_km: float = 60.0, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Answers (lat, lng, city, area_lat, area_lng, radius_km, area_city) with the first gate that refuses each, or null: position, box, distance, city, district.

    With columns addr, answer, district (where the row should be) and districts (all of its city): an answer that names
    another district of the city and not this one is refused, unless it repeats the address's road and number.
    """
    distance = geo.haversine("lat", "lng", "area_lat", "area_lng", geo.RADIUS_KM)
    gate = F.when(~geo.valid("lat", "lng"), "position")
    if box:
        gate = gate.when(~F.coalesce(geo.in_box("lat", "lng", *box), F.lit(False)), "box")
    gate = gate.when(F.col("area_lat").isNotNull() & (distance > F.col("radius_km") + slack_km), "distance").when(F.col("area_city").isNotNull() & F.col("city").isNotNull() & (F.instr("city", F.col("area_city")) == 0) & (F.instr("area_city", F.col("city")) == 0), "city")
    if {"answer", "district", "districts", "addr"} <= set(candidates.columns):
        named = F.exists("districts", lambda d: F.contains(F.col("answer"), d))
        own = F.contains(F.col("answer"), F.col("district"))
        gate = gate.when(F.col("district").isNotNull() & named & ~own & ~same_road_number(F.col("addr"), F.col("answer")), "district")
    return candidates.withColumn("refused_by", gate)


def related_areas(pairs: DataFrame, areas: DataFrame, want: str = "want", got: str = "got") -> DataFrame:
    """pairs of bare area names with related: whether they are one area, or an area of one name lies (at any depth) in one of the other's.

    areas: area_id, base, parent, depth. The wanted name never stands for an area of depth 0, as some provinces are named
    like one of their cities. Names that no area has are related to nothing but themselves.
    """
    own = areas.select("area_id", "base", "parent", "depth")
    up = own.select("area_id", F.col("area_id").alias("above"), F.col("parent").alias("next"))
    chain, links = up, own.select(F.col("area_id").alias("_a"), F.col("parent").alias("_p"))
    for _ in range(3):  # depths 0 to 3
        up = up.where("next is not null").join(links, F.col("next") == F.col("_a")).select("area_id", F.col("_a").alias("above"), F.col("_p").alias("next"))
        chain = chain.unionByName(up)
    named = own.select(F.col("area_id").alias("_n"), "base", "depth")
    below = chain.select("area_id", "above").distinct()
    inside = below.join(named.withColumnsRenamed({"_n": "area_id", "base": "low", "depth": "low_depth"}), "area_id").join(named.withColumnsRenamed({"_n": "above", "base": "high", "depth": "high_depth"}), "above")
    rel = inside.where("high_depth >= 1").select(F.col("high").alias(want), F.col("low").alias(got)).union(inside.where("low_depth >= 1").select(F.col("low"), F.col("high"))).distinct().withColumn("_yes", F.lit(True))
    return pairs.join(rel, [want, got], "left").withColumn("related", F.coalesce("_yes", F.col(want) == F.col(got), F.lit(False))).drop("_yes")


def gate_counts(rows: DataFrame, reason: str, group: list[str] | None = None) -> DataFrame:
    """How many rows each gate refused, and how many passed (reason "passed"); by group, if given."""
    return rows.groupBy(*(group or []), F.coalesce(F.col(reason), F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))


#: Evidence that somebody asserted a number.
ASSERTED = ("bemanicn_qty", "ziv_comment", "community_qty")


def evidence_distribution(rows: DataFrame, evidence: str = "count_evidence", source: str = "counts_src", models: str = "cab_models") -> DataFrame:
    """One pass over rows: how many have counts of each class of evidence (a row is in every class that it has, so classes overlap), in any asserted one, in listed ones alone, and models.

    evidence: a map of tag to evidence; models: a map.
    """
    has = lambda *words: F.arrays_overlap(F.map_values(F.coalesce(evidence, F.create_map().cast("map<string,string>"))), F.array(*map(F.lit, words)))
    some = F.size(F.coalesce(evidence, F.create_map().cast("map<string,string>"))) > 0
    classes = {**{w: has(w) for w in ASSERTED}, "any_real": has(*ASSERTED), "ziv_listed_only": some & ~has(*ASSERTED), "cab_models": F.size(F.coalesce(models, F.create_map().cast("map<string,int>"))) > 0, "no_source": F.col(source).isNull()}
    counts = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in classes.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("class"), F.col(n).alias("n")) for n in classes])).alias("v")).select("v.*")


def dangling(feed: DataFrame, rows: DataFrame, url: str, links: str, pattern: str) -> DataFrame:
    """Rows of feed whose page (the id that pattern finds in url) no row links to, in any of its links (an array); the report of a join that should be whole."""
    known = rows.select(F.explode(links).alias("_u")).select(F.regexp_extract("_u", pattern, 1).alias("_id")).where("_id <> ''").distinct()
    return feed.withColumn("_id", F.regexp_extract(url, pattern, 1)).join(known, "_id", "left_anti").drop("_id")


def best_candidates(candidates: DataFrame, key: str, row_id: str) -> DataFrame:
    """Of each key the best candidate (grade, distance_m, similarity): by grade (high, medium, low; a rejected one never), the nearer, the more alike, the smaller id."""
    grade = F.when(F.col("grade") == "high", 0).when(F.col("grade") == "medium", 1).when(F.col("grade") == "low", 2)
    others = [c for c in candidates.columns if c != key]
    best = candidates.where(grade.isNotNull()).groupBy(key).agg(F.min_by(F.struct(*others), F.struct(grade, F.col("distance_m"), -F.col("similarity"), F.col(row_id))).alias("_b"))
    return best.select(key, "_b.*")
