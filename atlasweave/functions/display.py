"""Notes, pictures, money and numbers as they are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = " | "


def with_note(notes: Column, note: Column) -> Column:
    """notes with a note added, unless it is there."""
    return F.when(F.coalesce(notes, F.lit("")) == "", note).when(F.contains(notes, note), notes).otherwise(F.concat(notes, F.lit(SEPARATOR), note))


def with_note_replaced(notes: Column, prefix: str, note: Column) -> Column:
    """notes without the segments that begin with prefix, and with a note added."""
    kept = F.filter(F.split(F.coalesce(notes, F.lit("")), r" \| "), lambda s: (s != "") & ~s.startswith(prefix))
    return F.array_join(F.concat(kept, F.array(note)), SEPARATOR)


def region_of(notes: Column) -> tuple[Column, Column]:
    """(province, city) of a "region: province city" segment; the city is the province where there is none."""
    words = F.split(F.trim(F.regexp_extract(notes, r"region:\s*([^;|]+)", 1)), r"\s+")
    province = F.nullif(F.try_element_at(words, F.lit(1)), F.lit(""))
    return province, F.coalesce(F.try_element_at(words, F.lit(2)), province)


#: The slot that a picture fills, and the bounds of its credits.
SLOT_W, SLOT_H, LEAST_BYTES = 416, 148, 12 * 1024
ASPECT_LIMITS, ASPECT_GOOD = (0.6, 5.0), (1.1, 2.2)
DETAIL, YEARS, WEIGHTS, BANDS = (0.04, 0.12), (3.0, 12.0), (45, 20, 25, 10), (60, 35)


def credit(value: Column, zero: float, full: float) -> Column:
    """0 at zero, 1 at full, straight between, null for null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - zero) / (full - zero))))


def image_score(width: Column, height: Column, size: Column, years: Column) -> tuple[Column, Column]:
    """(score from 0 to 100, verdict) of a picture by resolution, shape, age and detail; what can't fill the slot is rejected, what can't be measured is unknown."""
    aspect, pixels = width / height, width * height
    bytes_per_pixel = size / pixels
    resolution = F.least(credit(width, SLOT_W, 2 * SLOT_W), credit(height, SLOT_H, 2 * SLOT_H))
    shape = F.when(aspect.between(*ASPECT_GOOD), 1.0).when(aspect < ASPECT_GOOD[0], credit(aspect, ASPECT_LIMITS[0], ASPECT_GOOD[0])).otherwise(1 - credit(aspect, ASPECT_GOOD[1], ASPECT_LIMITS[1]))
    recency = F.coalesce(1 - credit(years, *YEARS), F.lit(0.5))
    detail = F.coalesce(credit(bytes_per_pixel, *DETAIL), F.lit(0.5))
    raw = sum((F.lit(float(w)) * part for w, part in zip(WEIGHTS, (resolution, shape, recency, detail), strict=True)), F.lit(0.0))
    unmeasured = width.isNull() | height.isNull() | (width <= 0) | (height <= 0)
    bad = (width < SLOT_W) | (height < SLOT_H) | F.coalesce(size < LEAST_BYTES, F.lit(False)) | ~aspect.between(*ASPECT_LIMITS)
    score = F.when(unmeasured, 40.0).when(bad, F.least(raw, F.lit(float(BANDS[1] - 1)))).otherwise(raw)
    verdict = F.when(unmeasured, "unknown").when(bad, "reject").when(raw >= BANDS[0], "good").when(raw >= BANDS[1], "ok").otherwise("weak")
    return score, verdict


def distance_text(metres: Column) -> Column:
    """Metres under a kilometre (one decimal under ten), then kilometres (one decimal under ten); empty for none."""
    km = metres / 1000
    near = F.when(metres < 10, F.format_string("%.1f m", metres)).otherwise(F.concat(F.floor(metres + 0.5).cast("string"), F.lit(" m")))
    far = F.when(km < 10, F.format_string("%.1f km", km)).otherwise(F.concat(F.format_number(F.floor(km + 0.5), 0), F.lit(" km")))
    return F.when(metres.isNull() | (metres < 0), "").when(metres < 999.5, near).otherwise(far)


def converted(amount: Column, from_rate: Column, to_rate: Column) -> Column:
    """An amount by two rates to one base; null without either rate."""
    return F.when((from_rate > 0) & (to_rate > 0), amount / from_rate * to_rate)


def total_counted(counts: Column) -> Column:
    """The sum of positive counts; null, not 0, if nobody counted."""
    own = F.filter(F.map_values(counts), lambda n: n > 0)
    return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0).cast("long"), lambda a, n: a + n))


def derived_variants(models: Column, official: Column, titles: Column, rules: list[tuple[str, str]]) -> Column:
    """Variants of a row: what an official source says, else what models say, else what titles fit, sorted."""
    none = F.array().cast("array<string>")
    by_title = F.concat(*[F.when(F.exists(titles, _fits(pattern)), F.array(F.lit(slug))).otherwise(none) for pattern, slug in rules]) if rules else none
    return F.array_sort(F.array_distinct(F.when(F.size(F.coalesce(official, none)) > 0, official).when(F.size(F.coalesce(models, none)) > 0, models).otherwise(by_title)))


def _fits(pattern: str):
    return lambda t: t.rlike(f"(?i){pattern}")
