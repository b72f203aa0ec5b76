"""Rows of records put together: lossless unions, corrections, lookups that refuse to guess, layers, search entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import evidence_rank

#: Evidence that publishes a count, by strength, and the layers of an export with their tags.
EVIDENCE = ("bemanicn_qty", "ziv_comment", "community_qty", "ziv_listed")
OTHER_BEMANI = ("gitadora", "jubeat", "popn", "nostalgia", "museca", "reflec")
OTHER_DANCE = ("dancerush", "dance_around", "danceevolution")


def _has(tags: str, *any_of: str) -> Column:
    return F.arrays_overlap(F.coalesce(tags, F.array().cast("array<string>")), F.array(*map(F.lit, any_of)))


def layer_conditions(community: tuple[str, ...] = ("ziv", "round1usa", "community")) -> dict[str, Column]:
    """The twelve layers of an export and what puts a row (games, cabs, src, country, lat) on one; a row may be on several."""
    all_of = F.size(F.array_except(F.array(*map(F.lit, ("maimai_dx", "chunithm", "ongeki"))), F.coalesce("games", F.array().cast("array<string>")))) == 0
    return {
        "01_all_bemani_japan": _has("src", "eagate"), "02_sega_gekichumai": _has("src", "allnet"), "03_polaris_chord": _has("games", "polaris_chord"), "04_sdvx": _has("games", "sdvx"),
        "05_valk_and_lm": _has("cabs", "sdvx_vm", "iidx_lm"), "06_iidx": _has("games", "iidx"), "07_ddr": _has("games", "ddr"), "08_other_bemani": _has("games", *OTHER_BEMANI), "09_other_dance": _has("games", *OTHER_DANCE),
        "10_all3_gekichumai": all_of, "11_china_optional": (F.col("country") == "China") & F.col("lat").isNotNull(), "12_community_worldwide_optional": _has("src", *community),
    }


def layered(rows: DataFrame, conditions: dict[str, Column] | None = None) -> DataFrame:
    """A row for each layer that a row is on, in one pass over rows."""
    on = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in (conditions or layer_conditions()).items()]))
    return rows.withColumn("layer", F.explode(on))


def normalized_evidence(source: Column, evidence: Column, aliases: tuple[str, ...] = (), trusted: tuple[str, ...] = ()) -> Column:
    """Evidence in the words of EVIDENCE: known words stay, aliases and unmarked counts of trusted sources are community_qty, all else is null and publishes nothing."""
    return F.when(evidence.isin(*EVIDENCE), evidence).when(evidence.isin(*aliases) | source.isin(*trusted), "community_qty")


def resolved(proposals: DataFrame, rows: DataFrame, row_id: str = "id") -> DataFrame:
    """proposals (name, addr) with the id of the one row of that name and address, else of the one row of that name; null where several have it.

    Only names that are unique in rows are joined, so a common name costs a count.
    """
    plain = lambda df: df.withColumns({"_n": F.trim("name"), "_a": F.trim(F.coalesce("addr", F.lit("")))})
    own = plain(rows)
    exact = own.groupBy("_n", "_a").agg(F.count("*").alias("_k"), F.first(row_id).alias("_exact")).where("_k = 1").drop("_k")
    alone = own.groupBy("_n").agg(F.count("*").alias("_k"), F.first(row_id).alias("_alone")).where("_k = 1").drop("_k")
    return plain(proposals).join(exact, ["_n", "_a"], "left").join(alone, "_n", "left").withColumn(row_id, F.when(F.col("_n") != "", F.coalesce("_exact", "_alone"))).drop("_n", "_a", "_exact", "_alone")


def hand_placed(rows: DataFrame, pins: DataFrame, row_id: str = "id") -> DataFrame:
    """rows with pin_lat and pin_lng of the pin (id, name, lat, lng, source_url) made for them: by id if the names agree, by name if no pin has the row's id.

    Names are compared without case and outer or repeated blanks. A pin without a source or position is none; a pin whose
    id is now another venue's places nothing. Of pins of one name the smallest id counts.
    """
    key = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    own = pins.select(F.col(row_id).alias("_id"), key("name").alias("_key"), F.when((F.trim(F.coalesce("source_url", F.lit(""))) != "") & F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.struct("lat", "lng")).alias("_at"))
    by_id = own.select("_id", F.col("_key").alias("_id_key"), F.col("_at").alias("_id_at"))
    by_name = own.where("_key <> ''").groupBy("_key").agg(F.min_by("_at", "_id").alias("_name_at"))
    met = rows.withColumn("_own", key("name")).join(by_id, F.col(row_id) == F.col("_id"), "left").join(by_name, F.col("_own") == F.col("_key"), "left")
    agreed = F.when((F.col("_id_key") == "") | (F.col("_id_key") == F.col("_own")), F.col("_id_at"))
    pin = F.when(F.col("_id").isNotNull(), agreed).otherwise(F.col("_name_at"))
    return met.withColumns({"pin_lat": pin["lat"], "pin_lng": pin["lng"]}).drop("_own", "_id", "_id_key", "_id_at", "_key", "_name_at")


def patched(rows: DataFrame, raw: DataFrame, value: str, row_id: str = "id", digits: int = 5) -> DataFrame:
    """rows with value from the raw row of their name and address, else from the one on their coordinate (rounded); the smallest of several."""
    named = raw.where(F.col(value).isNotNull()).groupBy("name", "addr").agg(F.min(value).alias("_named"))
    spot = lambda c: F.round(c, digits)
    placed = raw.where(F.col(value).isNotNull() & F.col("lat").isNotNull() & F.col("lng").isNotNull()).groupBy(spot("lat").alias("_lat"), spot("lng").alias("_lng")).agg(F.min(value).alias("_placed"))
    met = rows.withColumns({"_lat": spot("lat"), "_lng": spot("lng")}).join(named, ["name", "addr"], "left").join(placed, ["_lat", "_lng"], "left")
    return met.withColumn(value, F.coalesce("_named", "_placed")).drop("_lat", "_lng", "_named", "_placed")


def one_sided(a: Column, b: Column) -> Column:
    """What only one of two sets has: empty where one adds nothing to the other and the other nothing to it."""
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


def united_rows(rows: DataFrame, cluster: str, order: Column) -> DataFrame:
    """One row for each cluster, and nothing of its rows lost: of sets the union, of links one page for each source and all others in also, of counts the best attested, of single values the first row's that has one, of positions the first exact one.

    rows: games, cabs, src (arrays), links (map by source), game_counts (map), count_evidence (map), addr, pref, notes,
    lat, lng, approx (boolean). order: which row of a cluster comes first; it must tell its rows apart.
    """
    by = Window.partitionBy(cluster)
    ranked = rows.withColumn("_o", F.struct(order.alias("o"), F.xxhash64(*[F.col(c).cast("string") for c in ("addr", "notes", "lat", "lng")]).alias("h")))
    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))).alias(c) for c in ("games", "cabs", "src")]
    first = [F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("_o"))).alias(c) for c in ("addr", "pref")]
    place = F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.struct(F.coalesce("approx", F.lit(False)).alias("approx"), F.col("_o")))
    at = F.min_by(F.struct("lat", "lng", "approx"), place).alias("_at")
    base = ranked.groupBy(cluster).agg(*sets, *first, at, F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("notes", F.lit("")) != "", F.struct("_o", "notes")))), lambda x: x["notes"])), " | ").alias("notes"))
    pages = ranked.select(cluster, "_o", F.explode("links").alias("source", "url")).where("url is not null and url <> ''")
    own = pages.where("source not in ('also', 'gmaps')").withColumn("_first", F.min("_o").over(by.partitionBy(cluster, "source")))
    kept = own.where("_o = _first").groupBy(cluster).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("source", "url")))).alias("links"))
    other = own.where("_o <> _first").select(cluster, "url").unionByName(pages.where("source = 'also'").select(cluster, "url"))
    also = other.join(own.where("_o = _first").select(cluster, "url"), [cluster, "url"], "left_anti").groupBy(cluster).agg(F.array_sort(F.collect_set("url")).alias("also"))
    counted = ranked.select(cluster, "_o", "count_evidence", F.explode("game_counts").alias("game", "n")).withColumn("evidence", F.try_element_at("count_evidence", F.col("game")))
    best = counted.groupBy(cluster, "game").agg(F.min_by(F.struct("n", "evidence"), F.struct(-F.coalesce(evidence_rank(F.col("evidence")), F.lit(0)), F.col("_o"))).alias("_c"))
    counts = best.groupBy(cluster).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("game", "_c.n")))).alias("game_counts"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("_c.evidence").isNotNull(), F.struct("game", "_c.evidence"))))).alias("count_evidence"))
    out = base.join(kept, cluster, "left").join(also, cluster, "left").join(counts, cluster, "left")
    return out.select("*", "_at.lat", "_at.lng", "_at.approx").drop("_at")


def corrected(rows: DataFrame, corrections: DataFrame, row_id: str = "id") -> DataFrame:
    """rows with accepted corrections applied: games, closed (with its reason), lat and lng, game_counts; what rests on a dropped game goes with it.

    corrections, one row for an id: games (array), closed_reason, lat, lng, game_counts (map); null where nothing is
    corrected. A count counts only for a game that the row has, and is then attested by a comment. A new position leaves
    approx as it is.
    """
    new = corrections.select(F.col(row_id).alias("_id"), F.array_sort("games").alias("_games"), F.col("closed_reason").alias("_why"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.col("game_counts").alias("_counts"))
    met = rows.join(new, F.col(row_id) == F.col("_id"), "left")
    games = F.when(F.size(F.coalesce("_games", F.array().cast("array<string>"))) > 0, F.col("_games")).otherwise(F.col("games"))
    met = met.withColumn("games", games)
    left = lambda m: F.map_filter(m, lambda k, _: F.array_contains("games", k))
    empty, none = F.create_map().cast("map<string,int>"), F.create_map().cast("map<string,string>")
    stated = left(F.coalesce("_counts", empty))
    pruned = {"game_counts": left(F.coalesce("game_counts", empty)), "count_evidence": left(F.coalesce("count_evidence", none))}
    met = met.withColumn("_stated", stated).withColumns(pruned)
    over = lambda old, add: F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key("_stated", k)), add)
    met = met.withColumns({"game_counts": over(F.col("game_counts"), F.col("_stated")), "count_evidence": over(F.col("count_evidence"), F.transform_values("_stated", lambda k, v: F.lit("ziv_comment")))})
    moved = F.col("_lat").isNotNull() & F.col("_lng").isNotNull()
    met = met.withColumns({"closed": F.col("_why").isNotNull(), "closed_reason": F.col("_why"), "lat": F.when(moved, F.col("_lat")).otherwise(F.col("lat")), "lng": F.when(moved, F.col("_lng")).otherwise(F.col("lng"))})
    return met.drop("_id", "_games", "_why", "_lat", "_lng", "_counts", "_stated")


def guarded(diff: DataFrame, total_pct: float = 5.0) -> DataFrame:
    """The findings of a snapshot_diff(): each group that vanished or fell too far, and the whole if it fell by more than total_pct; none if all is well."""
    whole = diff.agg(F.sum("old_n").alias("old_n"), F.sum("new_n").alias("new_n"))
    pct = F.when(F.col("old_n") > 0, 100.0 * (F.col("old_n") - F.col("new_n")) / F.col("old_n")).otherwise(0.0)
    group = diff.columns[0]
    fell = whole.withColumn("drop_pct", pct).where(F.col("drop_pct") > total_pct).select(F.lit("*").alias("what"), "old_n", "new_n", F.lit("total").alias("status"))
    return diff.where("status <> 'ok'").select(F.col(group).cast("string").alias("what"), "old_n", "new_n", "status").unionByName(fell)


def require_guarded(diff: DataFrame, total_pct: float = 5.0) -> None:
    """Raises if guarded() finds anything (a job that calls it then fails)."""
    found = guarded(diff, total_pct).limit(20).collect()
    if found:
        raise ValueError("; ".join(f"{r.what}: {r.status} ({r.old_n} to {r.new_n})" for r in found))


def listed(rows: DataFrame, label: str, order: list[str], locale: str = "zh") -> DataFrame:
    """rows in the order of a locale: by label as it collates, then by the columns of order."""
    return rows.orderBy(F.collate(F.col(label), locale), *order)


def search_entries(rows: DataFrame, fields: dict[str, float], row_id: str = "id") -> DataFrame:
    """An inverted index of rows: term, id and weight, the largest of the fields that have the term; terms are lower-case runs of letters and digits, and Han characters in pairs."""
    out = None
    for field, weight in fields.items():
        low = F.lower(F.coalesce(F.col(field), F.lit("")))
        words = F.regexp_extract_all(F.regexp_replace(low, r"\p{IsHan}+", " "), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
        runs = F.regexp_extract_all(low, F.lit(r"\p{IsHan}+"), F.lit(0))
        pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(r) - 1, F.lit(1))), lambda k: F.substring(r, k, F.lit(2)))))
        own = rows.select(F.explode(F.array_distinct(F.concat(words, pairs))).alias("term"), F.col(row_id), F.lit(float(weight)).alias("weight"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("term", row_id).agg(F.max("weight").alias("weight"))


#: Signs of the simple price pattern: those that stand before an amount.
_SIMPLE = r"(CN¥|JP¥|US\$|HK\$|NT\$|A\$|CA\$|S\$|R\$|Rp|RM|[A-Z]{3}|₩|£|€|₱|฿|₫)\s*([0-9][0-9,. ]*)"


def simple_price(text: Column, local: Column, codes: dict[str, str], zero_decimal: tuple[str, ...] = ("JPY", "KRW", "VND", "IDR")) -> Column:
    """amount and currency of a price by the simple grammar of a viewer, which knows no tiers: the first price in the local currency, else a bare glyph as the local one, else the first price; null if there is none, or a bare glyph without a local currency.

    codes: currency of each sign. All of it is column expressions.
    """
    of = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    signs, raws = (F.regexp_extract_all(text, F.lit(_SIMPLE), F.lit(k)) for k in (1, 2))

    def amount(raw: Column, code: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(raw, r"\s", ""), "[.,]+$", "")
        dotted = F.when(plain.rlike(r",[0-9]{1,2}$") & ~F.contains(plain, F.lit(".")), F.replace(plain, F.lit(","), F.lit("."))).otherwise(F.replace(plain, F.lit(","), F.lit("")))
        whole = F.when(code.isin(*zero_decimal) & dotted.rlike(r"\.[0-9]{3}$"), F.replace(dotted, F.lit("."), F.lit(""))).otherwise(dotted)
        value = F.try_to_number(F.regexp_extract(whole, r"^[0-9]*\.?[0-9]*", 0), F.lit("999999999999D9999")).cast("double")
        return F.when(value > 0, value)

    hits = F.filter(F.zip_with(signs, raws, lambda s, r: F.struct(F.try_element_at(of, s).alias("currency"), amount(r, F.try_element_at(of, s)).alias("amount"))), lambda h: h["currency"].isNotNull() & h["amount"].isNotNull())
    mine = F.get(F.filter(hits, lambda h: h["currency"] == local), F.lit(0))
    glyph = F.regexp_extract(text, r"(?<![A-Za-z0-9])([$¥￥])\s*([0-9][0-9,.]*)", 2)
    bare = F.struct(local.alias("currency"), amount(glyph, local).alias("amount"))
    return F.when(mine.isNotNull(), mine).when(glyph != "", F.when(local.isNotNull() & bare["amount"].isNotNull(), bare)).otherwise(F.get(hits, F.lit(0)))
