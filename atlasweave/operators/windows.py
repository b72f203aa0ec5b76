"""Ranking, runs and chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import _written


def dense_ids(rows: DataFrame, order: list[Column], out: str = "id", within: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """rows with ids 1, 2, ... in order (in each group of the columns within), without bringing all rows to one task.

    Rows are dealt to ranges of the order; the counts of the ranges before give each range's first id. A group of any
    size is spread over ranges like all rows.
    """
    within = within or []
    keys = [F.col(c) for c in within] + order
    sorted_rows = (rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    # The ranges stay as they are for both uses.
    placed = _written(sorted_rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    counts = placed.groupBy("_part", *within).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    begins = counts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)], "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    numbered = placed.join(begins, same).withColumn(out, F.col("_begin") + F.col("_at") - F.col("_first") + 1)
    return numbered.select(*rows.columns, out)


def top_of_group(rows: DataFrame, key: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark limits groups before the shuffle, so a hot key costs little."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(out) <= k)


def latest_settled(journal: DataFrame, key: list[str], settled: Column, at: str) -> DataFrame:
    """Of each key the latest settled entry, or the latest where none is settled."""
    others = [c for c in journal.columns if c not in key]
    best = journal.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(settled.cast("int"), F.col(at), F.xxhash64(*others))).alias("_e"))
    return best.select(*key, *[F.col(f"_e.{c}").alias(c) for c in others])


def islands(rows: DataFrame, key: list[str], position: str, same: list[str]) -> DataFrame:
    """Runs of neighbouring positions that agree in the columns ``same``: key, first, last, length and those columns."""
    w = Window.partitionBy(*key).orderBy(position)
    starts = F.col(position) != F.lag(position, 1).over(w) + 1
    for c in same:
        starts = starts | ~F.col(c).eqNullSafe(F.lag(c, 1).over(w))
    marked = rows.withColumn("_new", F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(*key, "_run").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("length"), *[F.first(c).alias(c) for c in same]).drop("_run")


def part_label(n: Column) -> Column:
    """A, B, ..., Z, AA, AB, ... for 0, 1, ...: a label of its own for every part."""
    step = lambda a, _: F.when(a["rest"] > 0, F.struct(F.floor((a["rest"] - 1) / 26).alias("rest"), F.concat(F.chr(F.pmod(a["rest"] - 1, F.lit(26)) + 65), a["label"]).alias("label"))).otherwise(a)
    begin = F.struct((n + 1).cast("long").alias("rest"), F.lit("").alias("label"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), begin, step, lambda a: a["label"])  # 26**14 is beyond a long


def character(n: Column) -> Column:
    """The character of a Unicode code point (chr() only knows the first 256); null where there is none."""
    real = n.between(0, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    return F.when(real, F.decode(F.unhex(F.lpad(F.hex(F.when(real, n).otherwise(0).cast("long")), 8, "0")), "UTF-32"))


def parts(rows: DataFrame, layer: str, order: list[Column], size: int = 1990, label: Callable[[Column], Column] = part_label) -> DataFrame:
    """rows with their place in a layer and the part (A to Z, AA, ..., or as label names the number of a part) of at most size rows that it goes to."""
    numbered = dense_ids(rows, order, "place", [layer])
    return numbered.withColumn("part", label(F.floor((F.col("place") - 1) / size)))


def first_rule(rules: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The outcome of the first of ordered rules (condition, outcome) that holds."""
    out = F.lit(default)
    for condition, outcome in reversed(rules):
        out = F.when(condition, F.lit(outcome)).otherwise(out)
    return out


DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def opening_times(days: DataFrame, venue: str) -> DataFrame:
    """One line of opening times for each venue, neighbouring days with the same times as ranges.

    days: venue, day (0 is Monday), opens, closes (HH:MM), closed; a row for each day. A day without times, or that closes
    as it opens (the source's mark for "not filled in"), is left out, and a venue without another day has no line.
    """
    said = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    times = F.when(F.col("opens") == "00:00", F.when(F.col("closes") == "24:00", "24h")).otherwise(F.lit(None))
    times = F.coalesce(times, F.when((said("opens") != "") & (said("closes") != "") & (said("opens") != said("closes")), F.concat_ws("-", said("opens"), said("closes"))))
    shown = days.where("day between 0 and 6").withColumn("times", F.when(F.coalesce("closed", F.lit(False)), "closed").otherwise(times)).where("times is not null")
    runs = islands(shown, [venue], "day", ["times"])
    label = lambda c: F.element_at(F.array(*map(F.lit, DAYS)), (F.col(c) + 1).cast("int"))
    span = F.when(F.col("first") == F.col("last"), label("first")).otherwise(F.concat(label("first"), F.lit("-"), label("last")))
    lines = runs.withColumn("_line", F.concat(span, F.lit(" "), F.col("times")))
    whole = lines.groupBy(venue).agg(F.array_sort(F.collect_list(F.struct("first", "_line"))).alias("_l"))
    return whole.select(venue, F.array_join(F.transform("_l", lambda x: x["_line"]), "; ").alias("hours"))


def ranked_images(images: DataFrame, owner: str, k: int = 3) -> DataFrame:
    """Each owner's k best pictures (url, sha256, rejected, tier, score, pos): one for each URL and content, not rejected first, then by tier, score and place; a rejected one only where there is no other."""
    order = [F.col("rejected").asc(), F.col("tier").asc(), F.col("score").desc_nulls_last(), F.col("pos").asc()]
    by_url = top_of_group(images, [owner, "url"], order, 1, "_n").drop("_n")
    content = F.coalesce("sha256", "url")
    one = top_of_group(by_url.withColumn("_content", content), [owner, "_content"], order, 1, "_n").drop("_n", "_content")
    best = one.withColumn("_good", F.max(~F.col("rejected")).over(Window.partitionBy(owner))).withColumn("rank", F.row_number().over(Window.partitionBy(owner).orderBy(*order)))
    return best.where("rank <= {0} and (not rejected or (not _good and rank = 1))".format(k)).drop("_good")
