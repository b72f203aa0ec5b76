"""Readers: JSON in its several shapes, listings in HTML, journals, and their union."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..functions.text import squeezed, stripped_html
from ..operators.aggregates import EVIDENCE_RANK, strongest_counts
from .schemas import COMMUNITY, CORRUPT, OFFICIAL


def json_rows(spark: SparkSession, path: str, schema: str = COMMUNITY, tag_pattern: str | None = None) -> DataFrame:
    """Rows of JSON array files, broken ones in _corrupt_record; with a pattern, tag is its first group of the file name.

    load_at tells rows' order: by file, then by place in it. An array file is read by one task, so places don't depend on
    how files are dealt.
    """
    rows = spark.read.schema(f"{schema}, {CORRUPT}").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    rows = rows.withColumn("load_at", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place")))
    return rows.withColumn("tag", F.regexp_extract("load_at.file", tag_pattern, 1)) if tag_pattern else rows


#: The official listings by file: source, tags, models.
FAMILIES = {
    "maimai_jp": ("allnet", "maimai_dx", ""), "maimai_intl": ("allnet", "maimai_dx", ""), "chunithm_jp": ("allnet", "chunithm", ""), "chunithm_intl": ("allnet", "chunithm", ""), "ongeki": ("allnet", "ongeki", ""), "project_diva": ("allnet", "project_diva", ""),
    "polaris_chord": ("eagate", "polaris_chord", ""), "sdvx": ("eagate", "sdvx", ""), "sdvx_vm": ("eagate", "sdvx", "sdvx_vm"), "iidx": ("eagate", "iidx", ""), "iidx_lm": ("eagate", "iidx", "iidx_lm"), "ddr": ("eagate", "ddr", ""), "ddr_gold": ("eagate", "ddr", "ddr_gold"),
    "gitadora_gf": ("eagate", "gitadora", ""), "gitadora_dm": ("eagate", "gitadora", ""), "gitadora_gf_arena": ("eagate", "gitadora", "gitadora_gf_arena"), "gitadora_dm_arena": ("eagate", "gitadora", "gitadora_dm_arena"), "jubeat": ("eagate", "jubeat", ""), "popn": ("eagate", "popn", ""),
    "popn_pikapika": ("eagate", "popn", "popn_pikapika"), "nostalgia": ("eagate", "nostalgia", ""), "drs": ("eagate", "drs", ""), "dance_around": ("eagate", "dance_around", ""), "dance_evo": ("eagate", "dance_evo", ""), "museca": ("eagate", "museca", ""), "reflec": ("eagate", "reflec", ""),
    "china_wahlap_maimai_dx": ("wahlap", "maimai_dx", ""), "china_wahlap_chunithm": ("wahlap", "chunithm", ""),
}


def of_families(rows: DataFrame, families: dict[str, tuple[str, str, str]] | None = None) -> DataFrame:
    """Official rows (tag: the file) with source, games and cabs of their family; rows of unknown files are left out."""
    known = families or FAMILIES
    table = F.create_map(*[x for tag, (source, game, cab) in known.items() for x in (F.lit(tag), F.struct(F.lit(source).alias("source"), F.array(F.lit(game)).alias("games"), F.array(F.lit(cab)).alias("cabs")))])
    found = rows.withColumn("_f", F.try_element_at(table, F.col("tag"))).where("_f is not null")
    return found.withColumns({"source": F.col("_f.source"), "games": F.col("_f.games"), "cabs": F.array_remove(F.col("_f.cabs"), "")}).drop("_f")


def official_rows(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(spark, path, OFFICIAL, r"([a-z0-9_]+)\.json$")


def journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries of append-only JSON lines; a torn last line is dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def payload_rows(bodies: DataFrame, body: str, element: str) -> DataFrame:
    """Rows of bodies that are an array, or an object that has the array under data."""
    bare = F.from_json(body, f"array<{element}>")
    wrapped = F.from_json(body, f"struct<data: array<{element}>>")["data"]
    rows = F.when(F.ltrim(body).startswith("["), bare).otherwise(wrapped)
    return bodies.withColumn("_row", F.explode(rows)).select(*[c for c in bodies.columns if c != body], "_row.*")


def html_blocks(pages: DataFrame, html: str, block: str, fields: dict[str, str]) -> DataFrame:
    """A row for each match of block in a page, with fields from patterns whose first group is stripped of markup."""
    blocks = pages.withColumn("_block", F.explode(F.regexp_extract_all(html, F.lit(block), F.lit(0))))
    columns = {name: F.nullif(stripped_html(F.regexp_extract("_block", pattern, 1)), F.lit("")) for name, pattern in fields.items()}
    return blocks.withColumns(columns).drop("_block", html)


def embedded_json(pages: DataFrame, html: str, pattern: str, element: str) -> DataFrame:
    """Rows of JSON arrays in script strings (the pattern's first group), their escapes resolved."""
    text = F.explode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))
    plain = F.replace(F.replace(F.col("_text"), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    rows = pages.withColumn("_text", text).withColumn("_row", F.explode(F.from_json(plain, f"array<{element}>")))
    return rows.select(*[c for c in pages.columns if c != html], "_row.*")


def geojson_position(point: Column) -> tuple[Column, Column]:
    """(lat, lng) of a [lng, lat] array."""
    return F.try_element_at(point, F.lit(2)), F.try_element_at(point, F.lit(1))


def merged_by_id(parts: list[DataFrame], key: str, arrays: list[str], order: str | None = None) -> DataFrame:
    """One row for each key of several results: arrays united, other columns from the first result (or, with order, the latest row) that has them; within a result by a hash of the row."""
    rows = None
    for k, p in enumerate(parts):
        own = p.withColumn("_at", F.struct(F.lit(k).alias("part"), F.xxhash64(*[F.col(c).cast("string") for c in p.columns]).alias("h")) if order is None else F.col(order))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    pick = F.min_by if order is None else F.max_by
    others = [c for c in rows.columns if c not in (key, "_at", *arrays)]
    return rows.groupBy(key).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in arrays], *[pick(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in others])


def units(rows: DataFrame) -> DataFrame:
    """Rows of any family as units: one for each source, squeezed name and address, with sets united and a stable unit_id.

    (0, 0) is no position. A unit's scalars are those of its first row in load order (load_at; without it by a hash of the
    row) that has them; other pages are kept in also, notes joined in order. Counts under 1 are dropped; of several, the
    best attested stays (the larger of equals), and a counted tag is always one of games. Rows without a name are left out.
    """
    optional = {"cabs": "array<string>", "games": "array<string>", "notes": "string", "country": "string", "source_url": "string", "hours": "string", "website": "string", "game_counts": "map<string,int>", "count_evidence": "map<string,string>"}
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in rows.columns}).where("trim(coalesce(name, '')) <> ''")
    at = F.col("load_at") if "load_at" in rows.columns else F.xxhash64("name", "address", "lat", "lng", "notes", "source_url")
    keyed = rows.withColumns({"_name": squeezed("name"), "_addr": squeezed(F.coalesce("address", F.lit(""))), "_at": at})
    keyed = keyed.withColumns({"lat": geo.null_zero("lat", "lng", F.col("lat")), "lng": geo.null_zero("lat", "lng", F.col("lng"))})
    key, none = ["source", "_name", "_addr"], F.array().cast("array<string>")
    has = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("_at"))).alias(c)
    pin = F.min_by(F.struct("lat", "lng"), F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.col("_at"))).alias("_pin")
    sets = [F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, none)))).alias(c) for c in ("games", "cabs")]
    pages = F.array_sort(F.collect_set(F.when(F.coalesce("source_url", F.lit("")) != "", F.col("source_url")))).alias("_pages")
    notes = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("notes", F.lit("")) != "", F.struct("_at", "notes")))), lambda x: x["notes"]))
    out = keyed.groupBy(*key).agg(F.min_by("name", "_at").alias("name"), F.min_by("address", "_at").alias("addr"), pin, *sets, pages, F.array_join(notes, " | ").alias("notes"), *[has(c) for c in ("country", "source_url", "hours", "website")])
    each = keyed.select(*key, "count_evidence", F.explode("game_counts").alias("game", "n")).where("n > 0")
    said = F.try_element_at("count_evidence", F.col("game"))
    evidence = F.when(said.isin(*EVIDENCE_RANK), said).when(F.col("source") == "bemanicn", "bemanicn_qty").when(F.col("source") == "ziv", "ziv_listed")
    best = strongest_counts(each.withColumn("evidence", evidence), [*key, "game"])
    counts = best.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("game", "n")))).alias("game_counts"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("evidence").isNotNull(), F.struct("game", "evidence"))))).alias("count_evidence"))
    out = out.join(counts, key, "left")
    games = F.array_sort(F.array_union("games", F.coalesce(F.map_keys("game_counts"), none)))
    return out.select(F.xxhash64(*key).alias("unit_id"), "source", "name", "addr", F.col("_pin.lat").alias("lat"), F.col("_pin.lng").alias("lng"), games.alias("games"), F.array_sort("cabs").alias("cabs"), "country", "source_url", F.array_except("_pages", F.array("source_url")).alias("also"), "notes", "hours", "website", "game_counts", "count_evidence")


def filled_rates(primary: DataFrame, fallback: DataFrame, required: list[str], least: float = 1e-6, most: float = 1e6) -> DataFrame:
    """code, rate and feed: the primary feed's rate, else the fallback's, out-of-band rates dropped; an error if a required code has none."""
    good = lambda df: df.where(F.col("rate").between(least, most))
    a, b = good(primary).select("code", F.col("rate").alias("_p")), good(fallback).select("code", F.col("rate").alias("_f"))
    out = a.join(b, "code", "full").select("code", F.coalesce("_p", "_f").alias("rate"), F.when(F.col("_p").isNotNull(), "primary").otherwise("fallback").alias("feed"))
    have = {r.code for r in out.where(F.col("code").isin(required)).select("code").collect()}
    if missing := sorted(set(required) - have):
        raise ValueError(f"no rate for {', '.join(missing)}")
    return out


def rejected(rows: DataFrame, reasons: list[tuple[Column, str]]) -> DataFrame:
    """rows with reject_reason: the first that holds, else null."""
    out = F.lit(None).cast("string")
    for condition, name in reversed(reasons):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(out)
    return rows.withColumn("reject_reason", out)


def first_seen(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of repeated keys across pages the first row in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")


def open_shops(rows: DataFrame, closed: Column, tags: dict[int, str], items: str = "games", row_id: str = "id") -> DataFrame:
    """Rows that aren't closed, with their items (an array of structs: title_id, quantity) as a map of tag to summed quantity; unknown titles count as other."""
    known = F.create_map(*[F.lit(x) for pair in tags.items() for x in pair])
    each = rows.where(~F.coalesce(closed, F.lit(False))).select(row_id, F.explode_outer(items).alias("_i"))
    counted = each.groupBy(row_id, F.when(F.col("_i").isNotNull(), F.coalesce(F.try_element_at(known, F.col("_i.title_id")), F.lit("other"))).alias("tag")).agg(F.sum("_i.quantity").alias("n"))
    return counted.groupBy(row_id).agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("tag").isNotNull(), F.struct("tag", "n"))))).alias("counts"))


IMAGE_SIZE = T.StructType().add("format", "string").add("width", "integer").add("height", "integer")


def header_size(data: bytes | None) -> tuple[str, int, int] | None:
    """(format, width, height) from the first bytes of a PNG, GIF, JPEG or WebP picture; null for anything else."""
    if not data:
        return None
    big, little = (lambda a, n: int.from_bytes(data[a : a + n], "big")), (lambda a, n: int.from_bytes(data[a : a + n], "little"))
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "png", big(16, 4), big(20, 4)
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return "gif", little(6, 2), little(8, 2)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        kind = data[12:16]
        if kind == b"VP8X":
            return "webp", little(24, 3) + 1, little(27, 3) + 1
        if kind == b"VP8L":
            bits = little(21, 4)
            return "webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        return ("webp", little(26, 2) & 0x3FFF, little(28, 2) & 0x3FFF) if kind == b"VP8 " else None
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return "jpeg", big(at + 7, 2), big(at + 5, 2)
        at += 2 + (0 if marker == 0xFF or 0xD0 <= marker <= 0xD8 else big(at + 2, 2))
    return None


@F.pandas_udf(IMAGE_SIZE)
def image_size(content: pd.Series) -> pd.DataFrame:
    """format, width and height of a picture's bytes (of spark.read.format("binaryFile"), or their first kilobytes)."""
    found = [header_size(None if x is None else bytes(x)) or (None, None, None) for x in content]
    return pd.DataFrame(found, columns=["format", "width", "height"]).astype({"width": "Int32", "height": "Int32"})


def pages_until_known(pages: DataFrame, listing: str, page: str, key: list[str], declared: str | None = None) -> DataFrame:
    """Rows of each listing up to the page before the first that brings no new key, each key once at its first page; with as many as the listing declares at most, if it says.

    pages: one row for each entry of a page (numbered from 1). Listings that go round their last page end where they do.
    """
    first = pages.groupBy(listing, *key).agg(F.min(page).alias(page), *([F.max(declared).alias(declared)] if declared else []))
    fresh = first.groupBy(listing, page).agg(F.count("*").alias("_new"))
    seen = pages.select(listing, page).distinct().join(fresh, [listing, page], "left")
    stop = seen.where("_new is null").groupBy(listing).agg(F.min(page).alias("_stop"))
    kept = first.join(stop, listing, "left").where(F.col("_stop").isNull() | (F.col(page) < F.col("_stop"))).drop("_stop")
    if not declared:
        return kept
    placed = kept.withColumn("_n", F.row_number().over(Window.partitionBy(listing).orderBy(page, *key)))
    return placed.where(F.col(declared).isNull() | (F.col("_n") <= F.col(declared))).drop("_n")
