"""Answers of geocoding services, and the work list that asks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

#: Three shapes: a "lng,lat" string, an object of lat and lng, and projected metres with a kind of place.
TEXT_POINT = "struct<status:string,geocodes:array<struct<location:string,level:string,city:string,formatted_address:string>>>"
OBJECT_POINT = "struct<status:string,results:array<struct<geometry:struct<location:struct<lat:double,lng:double>,location_type:string>,formatted_address:string>>>"
PROJECTED_POINT = "struct<content:array<struct<x:double,y:double,std_tag:string,addr:string>>>"
#: Kinds that aren't the place itself, and that only name its road.
NOT_PLACES, ROADS = ("停车场", "公交车站", "地铁站", "出入口"), ("道路", "路口")


def _first(rows: Column, keep) -> Column:
    return F.try_element_at(F.filter(rows, keep), F.lit(1))


def text_point(body: Column) -> Column:
    """lat, lng, precision, address of the first answer with a "lng,lat" string; null on denial or no hit."""
    best = _first(F.from_json(body, TEXT_POINT)["geocodes"], lambda g: g["location"].rlike(r"^-?[0-9.]+,-?[0-9.]+$"))
    point = F.split(best["location"], ",")
    return F.when(best.isNotNull(), F.struct(F.get(point, F.lit(1)).try_cast("double").alias("lat"), F.get(point, F.lit(0)).try_cast("double").alias("lng"), best["level"].alias("precision"), best["formatted_address"].alias("address")))


def object_point(body: Column) -> Column:
    answer = F.from_json(body, OBJECT_POINT)
    best = _first(answer["results"], lambda r: r["geometry"]["location"]["lat"].isNotNull())
    at = best["geometry"]["location"]
    return F.when((answer["status"] == "OK") & best.isNotNull(), F.struct(at["lat"].alias("lat"), at["lng"].alias("lng"), best["geometry"]["location_type"].alias("precision"), best["formatted_address"].alias("address")))


def projected_point(body: Column, metres_per_unit: float = 0.01) -> Column:
    """x and y in parts of a metre as they are (projected coordinates); roads count as street precision, and only where nothing better is there."""
    usable = F.filter(F.from_json(body, PROJECTED_POINT)["content"], lambda c: c["x"].isNotNull() & ~F.coalesce(c["std_tag"].rlike("|".join(NOT_PLACES)), F.lit(False)))
    road = lambda c: F.coalesce(c["std_tag"].rlike("|".join(ROADS)), F.lit(False))
    best = F.coalesce(_first(usable, lambda c: ~road(c)), F.try_element_at(usable, F.lit(1)))
    return F.when(best.isNotNull(), F.struct((best["x"] * metres_per_unit).alias("x"), (best["y"] * metres_per_unit).alias("y"), F.when(road(best), "street").otherwise("place").alias("precision"), best["addr"].alias("address")))


def work_list(rows: DataFrame, asked: DataFrame, addr: str = "addr", key: str = "addr_key") -> DataFrame:
    """Distinct addresses of rows without a position that have not been asked for (hits and misses alike): key, address, rows."""
    own = rows.where(~geo.valid("lat", "lng") & (F.trim(F.coalesce(addr, F.lit(""))) != "")).withColumn(key, F.lower(F.regexp_replace(F.trim(addr), r"\s+", " ")))
    return own.join(asked.select(key), key, "left_anti").groupBy(key).agg(F.min(addr).alias("address"), F.count("*").alias("rows"))


def from_cache(rows: DataFrame, cache: DataFrame, addr: str = "addr", key: str = "addr_key", box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """rows with positions from a cache of answers (key, lat, lng; misses have none), where they had none; from_cache says which.

    Answers are checked again as they are read: one outside box (south, north, west, east) is none, whoever wrote it.
    """
    answers = cache.select(F.col(key).alias("_k"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    keyed = rows.withColumn("_key", F.lower(F.regexp_replace(F.trim(F.coalesce(addr, F.lit(""))), r"\s+", " ")))
    out = keyed.join(answers, keyed["_key"] == answers["_k"], "left")
    use = ~geo.valid("lat", "lng") & geo.valid("_lat", "_lng") & (F.coalesce(geo.in_box("_lat", "_lng", *box), F.lit(False)) if box else F.lit(True))
    return out.withColumns({"from_cache": use, "lat": F.when(use, F.col("_lat")).otherwise(F.col("lat")), "lng": F.when(use, F.col("_lng")).otherwise(F.col("lng"))}).drop("_key", "_k", "_lat", "_lng")


def refreshed(rows: DataFrame, cache: DataFrame, approx: str = "approx", **options) -> DataFrame:
    """What a fresh cache would change: rows as they would be if all approximate positions were taken away and looked up again."""
    bare = rows.withColumns({c: F.when(~F.coalesce(approx, F.lit(False)), F.col(c)) for c in ("lat", "lng")})
    return from_cache(bare, cache, **options)
