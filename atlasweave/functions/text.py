"""Names, addresses and markup.

Unicode normalization and case folding have no SQL form, so ``folded`` is an Arrow function; what follows from it is
built from column expressions on its result.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a folded name keeps (digits, letters a to z, ampersand, kana, Han, Hangul, half-width kana), and the two kinds of brackets.
KEPT = "0-9a-z&぀-ヿ㐀-鿿가-힯ｦ-ﾟ"
_DROPPED = re.compile(f"[^{KEPT}]+")
_NUMBERED = re.compile(r"^[0-9]{2,}")
PARENTHESES = r"\([^)]*\)|（[^）]*）"


def _fold(text: str | None) -> str:
    plain = _NUMBERED.sub("", unicodedata.normalize("NFKC", text or "").casefold())
    return _DROPPED.sub(" ", plain).strip()


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """Compatibility-normalized, case-folded, without a leading number of two or more digits, runs of other characters as one space. Null: empty."""
    return text.map(_fold, na_action=None)


@F.pandas_udf(T.StringType())
def squeezed(text: pd.Series) -> pd.Series:
    """Compatibility-normalized with runs of white space as one space: the key for duplicates inside a source."""
    return text.map(lambda x: " ".join(unicodedata.normalize("NFKC", x or "").split()), na_action=None)


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """HTML entities resolved and dashes of all kinds as a hyphen."""
    dashes = dict.fromkeys(map(ord, "‐‑‒–—―−"), "-")
    return text.map(lambda x: None if x is None else html.unescape(x).translate(dashes), na_action=None)


def with_name_keys(rows: DataFrame, name: str = "name") -> DataFrame:
    """rows with name_full (brackets kept), name_bare (without them, unless nothing is left), name_inner (what stands in them), and their compact forms."""
    out = rows.withColumn("name_full", folded(F.coalesce(F.col(name), F.lit(""))))
    out = out.withColumn("_bare", folded(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), PARENTHESES, " ")))
    out = out.withColumn("name_bare", F.when(F.col("_bare") == "", F.col("name_full")).otherwise(F.col("_bare")))
    inner = F.transform(F.regexp_extract_all(F.coalesce(F.col(name), F.lit("")), F.lit(PARENTHESES), F.lit(0)), lambda x: F.substring(x, 2, F.char_length(x) - 2))
    out = out.withColumn("name_inner", folded(F.array_join(inner, " ")))
    return out.withColumns({f"compact_{k}": compact(F.col(f"name_{k}")) for k in ("full", "bare", "inner")}).drop("_bare")


def compact(folded_name: Column) -> Column:
    """Without spaces, and without a last character that only says "shop", in names of three or more."""
    return F.regexp_replace(F.replace(folded_name, F.lit(" "), F.lit("")), "(?<=..)\u5e97$", "")


def bigrams(text: Column) -> Column:
    """The set of two-character pieces; a single character is its own."""
    n = F.char_length(text)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(n >= 2, F.array_distinct(pairs)).when(n == 1, F.array(text)).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared pieces over all pieces of two sets (columns, computed before); 0 if both are empty."""
    total = F.size(a) + F.size(b)
    return F.when(total > 0, F.lit(2.0) * F.size(F.array_intersect(a, b)) / total).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """Shared words over the words of the shorter name."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def with_similarity(pairs: DataFrame, a: str, b: str, out: str = "similarity") -> DataFrame:
    """pairs with the similarity of two folded names: 1 if compact forms agree, else the larger of overlap and dice."""
    tokens = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda x: x != ""))
    plain = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    rows = pairs.withColumns({"_ca": plain(a), "_cb": plain(b)}).withColumns({"_ga": bigrams(F.col("_ca")), "_gb": bigrams(F.col("_cb")), "_ta": tokens(F.col(a)), "_tb": tokens(F.col(b))})
    score = F.when((F.col("_ca") == "") | (F.col("_cb") == ""), 0.0).when(F.col("_ca") == F.col("_cb"), 1.0).otherwise(F.greatest(overlap(F.col("_ta"), F.col("_tb")), dice(F.col("_ga"), F.col("_gb"))))
    return rows.withColumn(out, score).drop("_ca", "_cb", "_ga", "_gb", "_ta", "_tb")


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading characters two strings share."""
    n = F.least(F.char_length(a), F.char_length(b))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda k, i: F.when((k == i - 1) & (i <= n) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(k))


def stripped_html(text: Column) -> Column:
    """Text of a fragment: without scripts, styles and tags, runs of white space as one space."""
    plain = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?s)<[^>]*>", " "), r"\s+", " "))


def clipped(text: Column, most: int) -> Column:
    """At most so many characters, an ellipsis included."""
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…")))


#: Kinds of street, shortened; and parts of an address that name a unit.
STREET_KINDS = {"street": "st", "avenue": "ave", "road": "rd", "drive": "dr", "boulevard": "blvd", "highway": "hwy", "lane": "ln", "court": "ct", "parkway": "pkwy", "floor": "fl", "north": "n", "south": "s", "east": "e", "west": "w"}
UNITS = ("suite", "ste", "unit", "apt")


def street_signature(addr: Column) -> Column:
    """The first word that is a number, and the two after it, kinds of street shortened and units left out; null without them."""
    words = F.regexp_replace(F.lower(addr), "[^a-z0-9 ]", " ")
    words = F.regexp_replace(words, rf"\b({'|'.join(UNITS)})\s*[0-9]*\b", " ")
    shortened = F.create_map(*[F.lit(x) for pair in STREET_KINDS.items() for x in pair])
    each = F.transform(F.filter(F.split(words, " +"), lambda w: w != ""), lambda w: F.coalesce(F.try_element_at(shortened, w), w))
    numbers = F.filter(F.transform(each, lambda w, i: F.when(w.rlike("^[0-9]+$"), i)), lambda i: i.isNotNull())
    at = F.get(numbers, F.lit(0))
    return F.when(F.size(each) >= at + 3, F.array_join(F.slice(each, at + 1, F.lit(3)), " "))


#: Phrases that say a venue is closed for good, that it may come back (which outweighs them), and what is counted.
CLOSED = ("permanently closed", "closed down", "closed for good", "closed permanently", "no longer open", "no longer in business", "no longer in operation", "ceased trading", "out of business", "已关闭", "已停业", "停止营业")
NOT_CLOSED = ("reopen", "re-open", "renovat", "refurbish", "装修中", "筹备", "搬迁", "temporar", "network offline", "已断网", "离线", "merge_into", "duplicate")
COUNTED = ("machine", "cab", "cabinet", "unit", "seat")


def _any_phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))


def closed_for_good(text: Column) -> Column:
    """Whether a text says that a venue is closed for good; one that may reopen, moves or is only offline is not."""
    return _any_phrase(text, CLOSED) & ~_any_phrase(text, NOT_CLOSED)


def quotes_quantity(text: Column) -> Column:
    """Whether a text states a number of machines: 4 cabinets, cabs: 3, x2, 3台."""
    low = F.lower(F.coalesce(text, F.lit("")))
    things = rf"\b(?:{'|'.join(COUNTED)})s?\b"
    return low.rlike(rf"\b[0-9]+\s*{things}") | low.rlike(rf"\b(?:{'|'.join(COUNTED[:3])})s?\b\s*[:-]?\s*[0-9]+") | low.rlike(r"(?:\b|\(\s*)[x×]\s*[0-9]+\b") | low.rlike("[0-9]+\\s*(?:台|個)")
