"""What a record is called and what is said of it: labels, translations, captions, highlights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interpolated(text: Column, values: Column) -> Column:
    """text with each {name} that values (a map of strings) has replaced by it; others stay."""
    return F.aggregate(F.map_entries(F.coalesce(values, F.create_map().cast("map<string,string>"))), text, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))


def translated(rows: DataFrame, texts: DataFrame, key: str, locale: str, out: str, values: str | None = None, fallback: str = "en") -> DataFrame:
    """rows with the text of their key in their locale, else in the fallback's, else the key itself; with values put in.

    texts: key, locale, text; one row for a key and locale.
    """
    own = texts.select(F.col("key").alias("_k"), F.col("locale").alias("_l"), F.col("text").alias("_own"))
    plain = texts.where(F.col("locale") == fallback).select(F.col("key").alias("_k2"), F.col("text").alias("_plain"))
    met = rows.join(own, (F.col(key) == F.col("_k")) & (F.col(locale) == F.col("_l")), "left").join(plain, F.col(key) == F.col("_k2"), "left")
    said = F.coalesce("_own", "_plain", F.col(key))
    return met.withColumn(out, interpolated(said, F.col(values)) if values else said).drop("_k", "_l", "_own", "_k2", "_plain")


def highlighted(text: Column, term: Column) -> Column:
    """start and end (characters, from 0) of the first place where text holds term, case aside; null without one."""
    at = F.instr(F.lower(text), F.lower(term))
    return F.when((at > 0) & (term != ""), F.struct((at - 1).alias("start"), (at - 1 + F.char_length(term)).alias("end")))


def page_description(name: Column, place: Column, tags: Column, most: int = 100, most_tags: int = 8) -> Column:
    """A line for a page: name, place and at most most_tags tags, cut with an ellipsis at most characters."""
    more = F.when(F.size(tags) > most_tags, F.format_string(" +%d", F.size(tags) - most_tags)).otherwise("")
    shown = F.when(F.size(tags) > 0, F.concat(F.array_join(F.slice(tags, 1, most_tags), ", "), more))
    line = F.concat_ws(" · ", F.nullif(name, F.lit("")), F.nullif(place, F.lit("")), shown)
    return F.when(F.char_length(line) <= most, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, most - 1)), F.lit("…")))


def translated_models(prose: Column, rules: list[tuple[str, str]]) -> Column:
    """Tags of models that prose lists (parts between , ; / and "and"): of each part that of the first rule (pattern, tag) that it fits; sorted, each once."""
    def tag(part: Column) -> Column:
        out = F.lit(None).cast("string")
        for pattern, name in reversed(rules):
            out = F.when(part.rlike(f"(?i){pattern}"), F.lit(name)).otherwise(out)
        return out

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.split(F.coalesce(prose, F.lit("")), r"\s*(?:[,;/]|\band\b)\s*"), tag))))


def tag_label(tag: Column, variants: Column, labels: dict[str, str], renamed: list[tuple[str, str, str, str]]) -> Column:
    """A tag's label at one row: a rule (tag, variant that the row has, variant that it lacks, label) may rename it; else its own, else the tag."""
    out = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), tag), tag)
    for name, has, lacks, label in reversed(renamed):
        out = F.when((tag == name) & F.array_contains(variants, has) & ~F.array_contains(variants, lacks), F.lit(label)).otherwise(out)
    return out


def variants_of(tag: Column, variants: Column, known: list[tuple[str, str]]) -> Column:
    """The variants of a tag that a row has, in the order of known (tag, variant)."""
    return F.array_compact(F.array(*[F.when((tag == name) & F.array_contains(variants, v), F.lit(v)) for name, v in known]))


def detail_captions(approx_level: Column, hours: Column, counts: Column, suppressed: Column, sources: Column) -> dict[str, Column]:
    """Captions of a detail view: of an approximate position, missing hours, missing counts (held back, or never counted), and a row that one community source alone vouches for."""
    return {
        "position_caption": F.when(approx_level.isNotNull(), F.concat(F.lit("approximate: "), approx_level)),
        "hours_caption": F.coalesce(F.nullif(hours, F.lit("")), F.lit("hours not recorded")),
        "counts_caption": F.when(F.size(F.coalesce(counts, F.create_map().cast("map<string,int>"))) > 0, F.lit(None).cast("string")).when(suppressed, "counts not shown: no evidence").otherwise("never counted"),
        "provenance_caption": F.when(F.size(sources) == 1, F.concat(F.lit("only "), F.element_at(sources, 1))),
    }
