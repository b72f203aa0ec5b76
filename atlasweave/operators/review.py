"""Work on records over time: shards for review, streaks of misses, what is stale, what has changed, clusters of a map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import dense_ids


def risk_class(src: Column, games: Column, country: Column) -> Column:
    """0 (look first) to 4: one official source abroad, one counter's source, nothing but other titles, one source, the rest."""
    single, other = F.size(src) == 1, (F.size(games) == 0) | ((F.size(games) == 1) & F.array_contains(games, "other"))
    rules = [(single & F.array_contains(src, "allnet") & (F.coalesce(country, F.lit("")) != "Japan"), 0), (single & F.array_contains(src, "insert_coin"), 1), (other, 2), (single, 3)]
    out = F.lit(4)
    for condition, value in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(value)).otherwise(out)
    return out


def review_shards(rows: DataFrame, risk: Column, row_id: str = "id", shards: int = 128) -> DataFrame:
    """rows with risk and shard: in order of risk and id they are dealt round, so every shard has its part of each class."""
    placed = dense_ids(rows.withColumn("risk", risk), [F.col("risk"), F.col(row_id)], "_n")
    return placed.withColumn("shard", F.pmod(F.col("_n") - 1, F.lit(shards)).cast("int")).drop("_n")


def before_abort(rows: DataFrame, key: list[str], position: str, missed: Column, most: int = 25) -> DataFrame:
    """Rows of each key up to the one that completes the first streak of most misses in a row; all, without such a streak."""
    w = Window.partitionBy(*key).orderBy(position)
    streak = rows.withColumn("_hits", F.sum(F.when(missed, 0).otherwise(1)).over(w)).withColumn("_miss", missed)
    run = Window.partitionBy(*key, "_hits").orderBy(position)
    counted = streak.withColumn("_run", F.sum(F.when(F.col("_miss"), 1).otherwise(0)).over(run))
    end = counted.where(F.col("_miss") & (F.col("_run") == most)).groupBy(*key).agg(F.min(position).alias("_end"))
    return counted.join(end, key, "left").where(F.col("_end").isNull() | (F.col(position) <= F.col("_end"))).select(rows.columns)


def stale(rows: DataFrame, checked: str, today: Column, months: int = 12) -> DataFrame:
    """Rows never checked, or longer ago than so many months of thirty days."""
    return rows.where(F.col(checked).isNull() | (F.datediff(today, F.col(checked)) > months * 30))


def changed(current: DataFrame, proposed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """What applying proposed would do to each of its keys: add, change (with the fields that differ) or same; applied twice, the second time all is same.

    A null in proposed leaves the field as it is.
    """
    old = current.select(F.col(key), F.lit(True).alias("_there"), *[F.col(c).alias(f"_old_{c}") for c in fields])
    met = proposed.join(old, key, "left")
    differs = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_old_{c}")), F.lit(c)) for c in fields]))
    out = met.withColumn("fields", differs)
    return out.select(key, F.when(F.col("_there").isNull(), "add").when(F.size("fields") > 0, "change").otherwise("same").alias("action"), F.when(F.col("_there"), F.col("fields")).alias("fields"))


def applied(current: DataFrame, proposed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """current with the fields of proposed (one row for a key) where they say something, and its new keys."""
    new = proposed.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in fields])
    met = current.join(new, key, "full")
    return met.select(key, *[F.coalesce(f"_new_{c}", c).alias(c) for c in fields], *[c for c in current.columns if c not in (key, *fields)])


def map_clusters(rows: DataFrame, zoom: int, big: Column, pixels: int = 60) -> DataFrame:
    """Grid clusters of a map at a zoom level (cells of so many pixels of the Mercator square): cell, rows, mean position, and whether one is big."""
    cells = 256 * 2**zoom / pixels
    x = F.floor((F.col("lng") + 180) / 360 * cells)
    s = F.sin(F.radians(F.greatest(F.least(F.col("lat"), F.lit(85.05)), F.lit(-85.05))))
    y = F.floor((F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * F.pi())) * cells)
    placed = rows.where("lat is not null and lng is not null").select("*", x.cast("long").alias("cell_x"), y.cast("long").alias("cell_y"), F.coalesce(big, F.lit(False)).alias("_big"))
    return placed.groupBy("cell_x", "cell_y").agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.bool_or("_big").alias("has_big"))


def image_records(rows: DataFrame, images: str, owner: str, most: int = 3, stock: str = r"(?i)/(?:stock|default|placeholder)") -> DataFrame:
    """At most so many pictures of each owner, in order, each URL once: url, thumb, credit and pos.

    images: an array of structs (url, src, thumb, credit); a picture's address is url, else src. Addresses that fit stock
    (shared stand-in pictures) are no pictures of a place.
    """
    each = rows.select(owner, F.posexplode(images).alias("pos", "_i")).select(owner, "pos", F.trim(F.coalesce("_i.url", "_i.src")).alias("url"), F.col("_i.thumb").alias("thumb"), F.col("_i.credit").alias("credit"))
    own = each.where((F.col("url") != "") & ~F.col("url").rlike(stock))
    first = own.groupBy(owner, "url").agg(F.min_by(F.struct("pos", "thumb", "credit"), "pos").alias("_f")).select(owner, "url", "_f.*")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(owner).orderBy("pos"))).where(F.col("rank") <= most)
