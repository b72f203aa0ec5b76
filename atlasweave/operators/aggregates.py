"""Aggregations: evidence, survivorship, facets, places, prices, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How strong the evidence for a count is.
EVIDENCE_RANK = {"ziv_listed": 1, "ziv_comment": 2, "community_qty": 2, "bemanicn_qty": 3}
MEASURED, SPARSE, OVERALL_GAMES = 5, 2, 3


def evidence_rank(evidence: Column) -> Column:
    out = F.lit(0)
    for name, rank in EVIDENCE_RANK.items():
        out = F.when(evidence == name, F.lit(rank)).otherwise(out)
    return out


def strongest_counts(rows: DataFrame, keys: list[str], n: str = "n", evidence: str = "evidence") -> DataFrame:
    """Of each key the count with the strongest evidence, the larger of equals; counts under 1 don't count."""
    order = F.struct(evidence_rank(F.col(evidence)), F.col(n), F.col(evidence))
    best = rows.where(F.col(n) > 0).groupBy(*keys).agg(F.max_by(F.struct(F.col(n).alias("n"), F.col(evidence).alias("evidence")), order).alias("_b"))
    return best.select(*keys, F.col("_b.n").alias(n), F.col("_b.evidence").alias(evidence))


def survivors(rows: DataFrame, cluster: str, priority: Column, lat: str = "lat", lng: str = "lng", addr: str = "addr", unit_id: str = "unit_id") -> DataFrame:
    """The leading row of each cluster, with the position of the first that has one: by priority, position, longer address, id."""
    without = F.when(F.col(lat).isNull(), 1).otherwise(0)
    order = F.struct(priority, without, -F.coalesce(F.char_length(addr), F.lit(0)), F.col(unit_id))
    others = [c for c in rows.columns if c not in (cluster, lat, lng)]
    pin = F.min_by(F.struct(lat, lng), F.when(F.col(lat).isNotNull(), order))
    out = rows.groupBy(cluster).agg(*[F.min_by(c, order).alias(c) for c in others], pin.alias("_pin"), F.count("*").alias("members"))
    return out.select(cluster, *others, F.col("_pin")[lat].alias(lat), F.col("_pin")[lng].alias(lng), "members")


def united(rows: DataFrame, cluster: str, arrays: list[str], notes: str | None = None, most: int = 800) -> DataFrame:
    """Sorted set unions of array columns of each cluster, and its distinct notes joined, cut at a length."""
    aggs = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in arrays]
    if notes:
        aggs.append(F.substring(F.array_join(F.array_sort(F.collect_set(notes)), " | "), 1, most).alias(notes))
    return rows.groupBy(cluster).agg(*aggs)


def counts_state(published: Column, counted: Column) -> Column:
    """published, suppressed (counted, but by nothing that is trusted), or absent (never counted)."""
    return F.when(published, "published").when(counted, "suppressed").otherwise("absent")


def facet_counts(rows: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """facet, value and n for each value of several facets, in one pass; array facets count a row once for each element."""
    parts = [F.struct(F.lit(name).alias("facet"), column.cast("string").alias("value")) for name, column in facets.items()]
    return rows.select(F.explode(F.array(*parts)).alias("f")).select("f.*").where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def place_rollup(rows: DataFrame, key: list[str], alias: Column, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """n, plottable, the bounding box of what has a position, and the aliases of each place."""
    has = F.col(lat).isNotNull() & F.col(lng).isNotNull()
    at = lambda f, c: f(F.when(has, F.col(c)))
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(has).alias("plottable"), at(F.min, lat).alias("min_lat"), at(F.max, lat).alias("max_lat"), at(F.min, lng).alias("min_lng"), at(F.max, lng).alias("max_lng"), F.array_join(F.array_sort(F.collect_set(alias)), ",").alias("aliases"))


def price_cells(rows: DataFrame, key: list[str], amount: str = "amount", venue: str = "venue") -> DataFrame:
    """Robust statistics of prices of each key.

    The mode is the lowest of equals. n under SPARSE is unknown, under MEASURED sparse; a mode without a majority that
    the median contradicts demotes to sparse; one venue with over half of the prices, of fewer than three venues, makes
    the cell unknown. Two groupings, so that no value's list is held.
    """
    by_value = rows.groupBy(*key, amount).agg(F.count("*").alias("_c"))
    mode = by_value.groupBy(*key).agg(F.max_by(amount, F.struct(F.col("_c"), -F.col(amount))).alias("mode"), F.max("_c").alias("mode_n"))
    venues = rows.groupBy(*key, venue).agg(F.count("*").alias("_c")).groupBy(*key).agg(F.count("*").alias("venues"), F.max("_c").alias("venue_n"))
    base = rows.groupBy(*key).agg(F.count("*").alias("n"), F.median(amount).alias("median"), F.min(amount).alias("min"), F.max(amount).alias("max"))
    cell = base.join(mode, key).join(venues, key)
    dispersed = (F.col("n") >= 3) & (F.col("mode_n") <= 0.5 * F.col("n")) & (F.abs(F.col("median") - F.col("mode")) > 1e-9)
    dominated = (F.col("n") >= SPARSE) & (F.col("venue_n") > 0.5 * F.col("n")) & (F.col("venues") < 3)
    tier = F.when(dominated, "unknown").when(F.col("n") >= MEASURED, F.when(F.col("dispersed"), "sparse").otherwise("measured")).when(F.col("n") >= SPARSE, "sparse").otherwise("unknown")
    cell = cell.withColumn("dispersed", dispersed).withColumn("tier", tier)
    return cell.withColumns({"mode_share": F.col("mode_n") / F.col("n"), "max_venue_share": F.col("venue_n") / F.col("n"), "median_differs": F.abs(F.col("median") - F.col("mode")) > 1e-9}).drop("mode_n", "venue_n")


def overall_prices(rows: DataFrame, key: list[str], game: str = "game", amount: str = "amount", venue: str = "venue") -> DataFrame:
    """One vote for each venue (its own mode, the lowest of equals), then the cell of the votes; under OVERALL_GAMES games with two prices or more, a measured cell is sparse."""
    votes = rows.groupBy(*key, venue, amount).agg(F.count("*").alias("_c")).groupBy(*key, venue).agg(F.max_by(amount, F.struct(F.col("_c"), -F.col(amount))).alias(amount))
    games = rows.groupBy(*key, game).agg(F.count("*").alias("_c")).groupBy(*key).agg(F.count_if(F.col("_c") >= 2).alias("games"))
    cell = price_cells(votes, key, amount, venue).join(games, key)
    return cell.withColumn("tier", F.when((F.col("tier") == "measured") & (F.col("games") < OVERALL_GAMES), "sparse").otherwise(F.col("tier")))


def venue_price(rows: DataFrame, venue: str, amount: str, position: str) -> DataFrame:
    """The price most of a venue's tags share; of equals the one that reached its count first, in order of position."""
    seen = rows.groupBy(venue, amount).agg(F.count("*").alias("_c"), F.max(position).alias("_p"))
    return seen.groupBy(venue).agg(F.max_by(amount, F.struct(F.col("_c"), -F.col("_p"))).alias(amount))


def snapshot_diff(old: DataFrame, new: DataFrame, group: str, most_pct: float = 25.0, least_rows: int = 50) -> DataFrame:
    """Rows of each group in two snapshots, the drop in percent, and whether it vanished or fell too far (groups under least_rows never do)."""
    count = lambda df, name: df.groupBy(group).agg(F.count("*").alias(name))
    both = count(old, "old_n").join(count(new, "new_n"), group, "full").fillna(0, ["old_n", "new_n"])
    pct = F.when(F.col("old_n") > 0, 100.0 * (F.col("old_n") - F.col("new_n")) / F.col("old_n")).otherwise(0.0)
    status = F.when((F.col("old_n") >= least_rows) & (F.col("new_n") == 0), "vanished").when((F.col("old_n") >= least_rows) & (F.col("drop_pct") > most_pct), "dropped").otherwise("ok")
    return both.withColumn("drop_pct", pct).withColumn("status", status)


def coordinate_stats(rows: DataFrame, lat: str = "lat", lng: str = "lng", digits: int = 5) -> DataFrame:
    """Rows with a position, distinct positions, and the largest pile on one."""
    piles = rows.where(F.col(lat).isNotNull()).groupBy(F.round(lat, digits).alias("a"), F.round(lng, digits).alias("b")).agg(F.count("*").alias("c"))
    return piles.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("placed"), F.count("*").alias("distinct_positions"), F.coalesce(F.max("c"), F.lit(0)).alias("largest_pile"))


def coverage(rows: DataFrame, group: str, hit: Column) -> DataFrame:
    """n, hits and their percentage (one decimal) of each group."""
    out = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    return out.withColumn("pct", F.round(100.0 * F.col("hits") / F.col("n"), 1))


def folded_quantities(rows: DataFrame, key: list[str], quantity: str) -> DataFrame:
    """Stated quantities summed, plus one for each entry without; evidence says whether any was stated."""
    return rows.groupBy(*key).agg(F.sum(F.coalesce(quantity, F.lit(1))).alias("n"), F.when(F.count(quantity) > 0, "ziv_comment").otherwise("ziv_listed").alias("evidence"))


def tallied(entries: DataFrame, counts: DataFrame, venue: str, tag: str, title: str, n: str) -> DataFrame:
    """Whether a venue counts more machines of some tag than it lists distinct titles of it."""
    titles = entries.groupBy(venue, tag).agg(F.countDistinct(title).alias("_t"))
    return counts.join(titles, [venue, tag], "left").groupBy(venue).agg(F.bool_or(F.col(n) > F.coalesce("_t", F.lit(0))).alias("tallied"))


def area_radius(areas: DataFrame, descendants: DataFrame, distance: Column, least: float = 120.0, most: float = 1100.0) -> DataFrame:
    """For each area (area_id, lat, lng) the largest distance to its descendants (area_id, d_lat, d_lng), within bounds."""
    return areas.join(descendants, "area_id", "left").groupBy("area_id").agg(F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(F.max(distance), F.lit(0.0)))).alias("radius_km"))


def descendants(spark, areas: str) -> DataFrame:
    """(area_id, descendant) of a view of a tree (area_id, parent), by a recursive query."""
    return spark.sql(f"with recursive d(area_id, descendant) as (select parent, area_id from {areas} where parent is not null union all select a.parent, d.descendant from d join {areas} a on a.area_id = d.area_id where a.parent is not null) select * from d")


def first_wins(rows: DataFrame, key: list[str], position: str, columns: list[str]) -> DataFrame:
    """For each key and column the first value, by position, that isn't null."""
    return rows.groupBy(*key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(position))).alias(c) for c in columns])


