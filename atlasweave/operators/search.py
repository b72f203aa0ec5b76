"""The query layer: what is visible, facet numbers, ranked search, what is near."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

#: Size bands (id, least, most) and the sources whose counts may size a venue.
SIZE_TIERS = (("1", 1, 2), ("2", 3, 9), ("3", 10, 19), ("4", 20, 49), ("5", 50, None))
TRUSTED_COUNTS = ("bemanicn", "ziv")
TWIN_KM = 0.015


@dataclass(frozen=True)
class QuerySpec:
    """Selections; None is everything. variants: for a tag the variants of which a venue must have one."""

    tags: tuple[str, ...] | None = None
    variants: dict[str, tuple[str, ...]] = field(default_factory=dict)
    sources: tuple[str, ...] | None = None
    tiers: tuple[str, ...] | None = None

    def serialise(self) -> str:
        """As a URL fragment; a selection of everything is left out."""
        pairs = [(k, ",".join(sorted(v))) for k, v in (("tags", self.tags), ("sources", self.sources), ("tiers", self.tiers)) if v is not None]
        pairs += [(f"v.{tag}", ",".join(sorted(v))) for tag, v in sorted(self.variants.items())]
        return urlencode(pairs)

    @classmethod
    def parse(cls, text: str) -> QuerySpec:
        """The inverse; unknown keys are ignored."""
        found = {k: tuple(x for x in v.split(",") if x) for k, v in parse_qsl(text.lstrip("#"), keep_blank_values=True)}
        return cls(found.get("tags"), {k[2:]: v for k, v in found.items() if k.startswith("v.")}, found.get("sources"), found.get("tiers"))


def _strings(values) -> Column:
    return F.array(*map(F.lit, sorted(values))).cast("array<string>")


def count_showable(n: Column, evidence: Column) -> Column:
    """Whether a count may be shown: listed machines say little unless there are two or more."""
    return F.coalesce(F.when(evidence == "ziv_listed", n >= 2).otherwise(n >= 1), F.lit(False))


def showable_total(counts: str, evidence: str) -> Column:
    """The sum of the showable counts of maps from tags; null, not 0, if there are none."""
    shown = F.map_filter(counts, lambda tag, n: count_showable(n, F.coalesce(F.try_element_at(evidence, tag), F.lit("bemanicn_qty"))))
    return F.when(F.size(F.map_values(shown)) > 0, F.aggregate(F.map_values(shown), F.lit(0).cast("long"), lambda a, x: a + x))


def size_tier(total: Column, source: Column | None = None) -> Column:
    """The size band of a total; unknown (U) for null, under 1, or a source that isn't trusted."""
    out = F.lit("U")
    for name, least, most in reversed(SIZE_TIERS):
        inside = (total >= least) & (total <= most) if most else total >= least
        out = F.when(inside, F.lit(name)).otherwise(out)
    unknown = total.isNull()
    if source is not None:
        unknown = unknown | ~F.coalesce(source.isin(*TRUSTED_COUNTS), F.lit(False))
    return F.when(unknown, "U").otherwise(out)


def tag_passes(spec: QuerySpec, tag: Column, variants: str) -> Column:
    """Whether a row's tag satisfies the variants checked for that tag."""
    out = F.lit(True)
    for name, wanted in sorted(spec.variants.items()):
        out = F.when(tag == name, F.arrays_overlap(F.col(variants), _strings(wanted))).otherwise(out)
    return out


def source_enabled(spec: QuerySpec, sources: str) -> Column:
    """Rows without sources are never hidden."""
    if spec.sources is None:
        return F.lit(True)
    return (F.size(sources) == 0) | F.arrays_overlap(F.col(sources), _strings(spec.sources))


def visible(spec: QuerySpec, tags: str = "tags", variants: str = "variants", sources: str = "sources", tier: str = "tier") -> Column:
    """One predicate: source, size band, and some selected tag that passes. The cheap tests come first."""
    wanted = F.exists(tags, lambda t: (F.lit(True) if spec.tags is None else F.array_contains(_strings(spec.tags), t)) & tag_passes(spec, t, variants))
    banded = F.lit(True) if spec.tiers is None else F.col(tier).isin(*spec.tiers)
    return F.coalesce(source_enabled(spec, sources) & banded & wanted, F.lit(False))


def display_tag(spec: QuerySpec, tags: str = "tags", variants: str = "variants") -> Column:
    """The first of a row's tags that passes."""
    return F.try_element_at(F.filter(tags, lambda t: (F.lit(True) if spec.tags is None else F.array_contains(_strings(spec.tags), t)) & tag_passes(spec, t, variants)), F.lit(1))


def term_rank(term: Column, query: str) -> Column:
    """0 equal, 1 at the start, 2 inside, null not at all."""
    return F.when(term == query, 0).when(term.startswith(query), 1).when(F.instr(term, query) > 0, 2)


def ranked_terms(index: DataFrame, query: str, target: str, ordinal: str, limit: int, term: str = "term", descending: bool = False) -> DataFrame:
    """Targets by the best rank of their terms, then ordinal: target, rank."""
    hit = index.withColumn("rank", term_rank(F.lower(term), query.lower())).where("rank is not null")
    best = hit.groupBy(target).agg(F.min("rank").alias("rank"), F.min(ordinal).alias(ordinal))
    order = F.col(ordinal).desc() if descending else F.col(ordinal).asc()
    return best.orderBy("rank", order, target).limit(limit)


def containing(rows: DataFrame, haystack: str, query: str, order: str, limit: int) -> DataFrame:
    """The first rows, in order, whose text holds the query."""
    return rows.where(F.instr(F.lower(haystack), query.lower()) > 0).orderBy(order).limit(limit)


def nearest(rows: DataFrame, lat: float, lng: float, k: int = 20, name: str | None = None, row_id: str = "id") -> DataFrame:
    """The k nearest rows with km, bearing and compass point; a top-k, so nothing is sorted whole.

    With a name column, rows of one name whose distances lie within TWIN_KM of each other count once, as the nearest.
    """
    placed = rows.where(geo.valid("lat", "lng")).withColumn("km", geo.haversine(F.lit(lat), F.lit(lng), "lat", "lng", geo.RADIUS_KM))
    if name:
        w = Window.partitionBy(F.lower(name)).orderBy("km", row_id)
        placed = placed.withColumn("_before", F.lag("km", 1).over(w)).where(F.col("_before").isNull() | (F.col("km") - F.col("_before") > TWIN_KM)).drop("_before")
    turned = geo.bearing(F.lit(lat), F.lit(lng), "lat", "lng")
    return placed.orderBy("km", row_id).limit(k).withColumn("bearing", turned).withColumn("point", geo.compass(F.col("bearing")))


def canonical_order(tags: str, order: list[str]) -> Column:
    """Tags in a canonical order, unknown ones last by name."""
    rank = F.create_map(*[F.lit(x) for k, t in enumerate(order) for x in (t, k)])
    return F.transform(F.array_sort(F.transform(tags, lambda t: F.struct(F.coalesce(F.try_element_at(rank, t), F.lit(len(order))).alias("k"), t.alias("t")))), lambda x: x["t"])
