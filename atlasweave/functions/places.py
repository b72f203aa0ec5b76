"""Which country and which part of it a record is in, from its note, its scripts, its codes, its position and its address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geo

Box = tuple[str, float, float, float, float]
#: Territories that a region note names; provinces and states as addresses write them.
TERRITORIES = (("Hong Kong", "香港"), ("Macau", "澳门|澳門"), ("Taiwan", "台湾|台灣|臺灣"))
CANADIAN = ("Ontario", "Quebec", "Québec", "British Columbia", "Alberta", "Manitoba", "Saskatchewan", "Nova Scotia", "New Brunswick", "Newfoundland", "Prince Edward Island")
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC PR"
_STATE_ZIP = rf"\b({'|'.join(STATES.split())})\.?,?\s+[0-9]{{5}}(?:-[0-9]{{4}})?\b"
_CANADIAN_CODE = r"\b[ABCEGHJ-NPRSTVXY][0-9][A-Z] ?[0-9][A-Z][0-9]\b"


def _first(rules: list[tuple[Column, Column | str]], default: str | None) -> Column:
    out = F.lit(default)
    for condition, outcome in reversed(rules):
        out = F.when(condition, outcome if isinstance(outcome, Column) else F.lit(outcome)).otherwise(out)
    return out


def country(lat: Column, lng: Column, addr: Column, name: Column, note: Column, boxes: list[Box], hints: list[tuple[str, str]]) -> Column:
    """The country of a record, by the first that tells: a note of a territory, Hangul, a Canadian code, the box that the position is in, a Canadian province, a state with ZIP, words of the address, kana; else Unknown.

    Names count for scripts and codes only: "Japan Village" may stand in Brooklyn. boxes (country, south, north, west, east)
    and hints (country, pattern) in order; the first wins.
    """
    own, said = F.coalesce(addr, F.lit("")), F.coalesce(note, F.lit(""))
    text = F.concat_ws(" ", own, F.coalesce(name, F.lit("")))
    box = F.when(lat.isNotNull() & lng.isNotNull(), geo.first_box(lat, lng, boxes))
    provinces = rf"\b(?:{'|'.join(CANADIAN)})\b"
    rules: list[tuple[Column, Column | str]] = [(said.rlike(pattern), place) for place, pattern in TERRITORIES]
    rules += [(text.rlike(r"[가-힯]"), "South Korea"), (text.rlike(_CANADIAN_CODE), "Canada"), (box.isNotNull(), box), (text.rlike(provinces), "Canada"), (own.rlike(_STATE_ZIP), "United States")]
    rules += [(own.rlike(pattern), place) for place, pattern in hints]
    return _first([*rules, (text.rlike(r"[぀-ヿ]"), "Japan")], "Unknown")


def prefecture(land: Column, addr: Column, prefectures: list[tuple[str, str]]) -> Column:
    """The state of a US address, the prefecture of a Japanese one, the province of a Chinese one; else null.

    prefectures: (English, Japanese) names in order. An English one counts as a word; a Japanese one anywhere, or without
    its ending in the first six characters.
    """
    own = F.coalesce(addr, F.lit(""))
    japanese = [(own.rlike(rf"\b{en}\b"), en) for en, _ in prefectures]
    japanese += [(F.contains(own, F.lit(ja)) | F.contains(F.substring(own, 1, 6), F.lit(ja.rstrip("県府都"))), ja) for _, ja in prefectures]
    return F.when(land == "United States", F.nullif(F.regexp_extract(own, _STATE_ZIP, 1), F.lit(""))).when(land == "Japan", _first(japanese, None)).when(land == "China", F.nullif(F.regexp_extract(own, r"(\p{IsHan}{1,8}(?:省|自治区))", 1), F.lit("")))
