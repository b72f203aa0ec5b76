"""One venue under two names that share no character: an English one with a position, a Chinese one with an address.

What a cluster's names and addresses say becomes clues: a street, a place, an operator's brand, a shared Chinese name, a
name that sounds alike. Two clusters need clues of two kinds in common. Sounds are compared within one edit, by an
equi-join: two words are one edit apart only if they share a form with at most one letter taken out, so each clue goes out
under all its forms, and what meets is tested. A street that both name at numbers that don't overlap speaks against all
the rest. A cluster joins the one it has the most kinds with, if that is true of both and of no other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..functions.scripts import latin_skeleton, spoken
from ..operators import joins

COUNTRIES, NEAR_M, KINDS = ("Hong Kong", "Macau"), 1000.0, 2
#: Words that half of all venues have in their names, as they sound and as they are written.
COMMON_SOUNDS = frozenset("hongkong honkong kaulung kowloon santkai sunkai macau mokou oumun cunkwok cungkwok kam game gamecentre gamecenter centre center plaza shop road street floor basement building hong kong".split())
COMMON_WORDS = ("遊戲機中心 游戏机中心 遊戲機 游戏机 遊戲 游戏 電子遊戲 电子游戏 娛樂城 娱乐城 遊戲城 游戏城 遊戲廣場 游戏广场 電玩 电玩 機中心 机中心 中心 廣場 广场 大廈 大厦 商場 商场 遊樂 游乐 娛樂 娱乐 樂園 乐园 天地 世界 電子 电子 機城 机城 俱樂部 俱乐部 香港 九龍 九龙 新界 澳門 澳门 特别行政区 特別行政區 地下 地庫 地库 地舖 地铺").split()
COMMON_LATIN = frozenset("GAME GAMES GAMECENTRE GAMECENTER CENTRE CENTER AMUSEMENT ARCADE PLAZA SHOP CITY CLUB LAND WORLD HOUSE ARENA ENTERTAINMENT".split())
#: Places whose English name is no reading of the Chinese one.
EXONYMS = {
    "香港仔": "aberdeen", "鴨脷洲": "apleichau", "中環": "central", "金鐘": "admiralty", "銅鑼灣": "causewaybay", "跑馬地": "happyvalley", "淺水灣": "repulsebay", "赤柱": "stanley", "太古": "taikoo", "青山": "castlepeak", "廣東道": "cantonroad", "太子": "princeedward",
    "北角": "northpoint", "上環": "sheungwan", "西環": "saiwan", "堅尼地城": "kennedytown", "深水埗": "shamshuipo", "尖沙咀": "tsimshatsui", "尖東": "tsimshatsuieast", "九龍城": "kowlooncity", "黃大仙": "wongtaisin", "鑽石山": "diamondhill", "新蒲崗": "sanpokong",
    "牛頭角": "ngautaukok", "西灣河": "saiwanho", "筲箕灣": "shaukeiwan", "柴灣": "chaiwan", "路氹": "cotai", "氹仔": "taipa", "路環": "coloane", "彌敦道": "nathanroad", "青山公路": "castlepeakroad", "太子道": "princeedwardroad", "英皇道": "kingsroad",
}
HAN_STREETS = "大馬路 公路 馬路 花園 廣場 大廈 中心 街 道 路 徑 里 巷 圍 坊 臺 台".split()
LATIN_STREETS = "STREET ROAD PATH AVENUE LANE TERRACE CIRCUIT PRAYA CRESCENT SQUARE PLAZA CENTRE CENTER BUILDING COURT GARDEN ST RD AVE LN".lower().split()

_TOKEN = re.compile(r"[一-鿿]+|[A-Za-z']+|[0-9]{1,4}(?:\s*-\s*[0-9]{1,4})?")
Clue = tuple[str, str, str, str, int | None, int | None]  # kind, side, key, word, number from, to


def _pieces(text: str) -> list[tuple[str, str]]:
    """("han" | "latin" | "number", word) of a text, in order."""
    return [("han" if "一" <= w[0] <= "鿿" else "number" if w[0].isdigit() else "latin", w) for w in _TOKEN.findall(text or "")]


def _interval(word: str) -> tuple[int, int]:
    ends = [int(x) for x in word.replace(" ", "").split("-")]
    return min(ends), max(ends)


def _sounds(token: str, readings: dict[str, list[str]]) -> set[str]:
    return {s for s in spoken(token, readings) if len(s) >= 4 and s not in COMMON_SOUNDS}


def _han_streets(pieces: list[tuple[str, str]], readings: dict) -> Iterator[Clue]:
    """Streets in Chinese: two to four characters, the word for a street, its number."""
    for k, (kind, run) in enumerate(pieces):
        if kind != "han":
            continue
        after = pieces[k + 1] if k + 1 < len(pieces) else ("", "")
        for word in HAN_STREETS:
            for at in (i for i in range(1, len(run)) if run.startswith(word, i)):
                lo, hi = _interval(after[1]) if after[0] == "number" and run.endswith(word) and at + len(word) == len(run) else (None, None)
                for n in (2, 3, 4):
                    if at >= n:
                        name = run[at - n : at]
                        yield from (("street", "any", s, name, lo, hi) for s in _sounds(name, readings))
                yield from (("street", "any", key, place, lo, hi) for place, key in EXONYMS.items() if run[: at + len(word)].endswith(place) or run[:at].endswith(place))


def _latin_streets(pieces: list[tuple[str, str]]) -> Iterator[Clue]:
    """Streets in English: a number, one to three words, the word for a street."""
    for k, (kind, word) in enumerate(pieces):
        if kind != "latin" or word.lower() not in LATIN_STREETS:
            continue
        words, lo, hi = [], None, None
        for kind_before, before in reversed(pieces[:k]):
            if kind_before == "number":
                lo, hi = _interval(before)
                break
            if kind_before == "han":
                break
            words.insert(0, before)
        for n in (1, 2, 3):
            if len(words) >= n:
                group = words[-n:]
                plain = "".join(group).lower()
                yield from (("street", "any", key, key, lo, hi) for key in EXONYMS.values() if plain in (key, key.removesuffix("road")) or plain + word.lower() == key)
                sound = latin_skeleton(" ".join(group))
                if len(sound) >= 4 and sound not in COMMON_SOUNDS:
                    yield "street", "any", sound, " ".join(group), lo, hi


def _heard(kind: str, text: str, readings: dict, longest: int) -> Iterator[Clue]:
    """What a text says in Chinese, by sound, and its groups of English words, by sound."""
    latin: list[str] = []
    for piece, word in [*_pieces(text), ("end", "")]:
        if piece == "latin":
            latin.append(word)
            continue
        for i in range(len(latin)):
            for n in (1, 2, 3):
                sound = latin_skeleton(" ".join(latin[i : i + n])) if i + n <= len(latin) else ""
                if len(sound) >= 4 and sound not in COMMON_SOUNDS:
                    yield kind, "latin", sound, " ".join(latin[i : i + n]), None, None
        latin = []
        if piece == "han":
            for n in range(2, longest + 1):
                for i in range(len(word) - n + 1):
                    token = word[i : i + n]
                    if token not in COMMON_WORDS:
                        yield from ((kind, "han", s, token, None, None) for s in _sounds(token, readings))


def clues(addr: str, name: str, readings: dict[str, list[str]]) -> list[Clue]:
    """All that an address and a name say."""
    pieces, letters = _pieces(addr), re.sub("[^a-z]", "", (addr or "").lower())
    out = {*_han_streets(pieces, readings), *_latin_streets(pieces), *_heard("place", addr, readings, 3), *_heard("sound", name, readings, 4)}
    out |= {("place", "any", key, place, None, None) for place, key in EXONYMS.items() if place in (addr or "") or key in letters}
    streets = {"".join(w) for w in HAN_STREETS}
    for k, (kind, word) in enumerate(pieces):
        before = pieces[k - 1] if k else ("", "")
        later = [w.lower() for _, w in pieces[k + 1 : k + 5]]
        if kind == "number" and ((before[0] == "han" and any(before[1].endswith(s) for s in streets)) or before[1].lower() == "no" or any(w in LATIN_STREETS for w in later)):
            out.add(("number", "any", "", "", *_interval(word)))
    for run in re.findall("[A-Za-z][A-Za-z' ]*[A-Za-z]", name or ""):
        plain = re.sub("[^A-Z]", "", run.upper())
        if len(plain) >= 6 and plain not in COMMON_LATIN:
            out.add(("brand", "any", plain, plain.lower(), None, None))
    for kind, word in _pieces(name):
        if kind == "han":
            out |= {("written", "any", word[i : i + n], word[i : i + n], None, None) for n in (2, 3, 4) for i in range(len(word) - n + 1) if not any(word[i : i + n] in w for w in COMMON_WORDS)}
    return sorted(out, key=str)


CLUE = T.StructType().add("kind", "string").add("side", "string").add("key", "string").add("word", "string").add("lo", "integer").add("hi", "integer")


def _forms(key: Column) -> Column:
    """A word and all that are left of it when one letter is taken out."""
    n = F.char_length(key)
    less = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, n)))
    return F.array_distinct(F.array_append(less, key))


def with_clues(clusters: DataFrame, readings: dict[str, list[str]]) -> DataFrame:
    """clusters (cluster_id, addr, name: of all their units) with their clues. readings: sounds of characters, a table of fixed size."""

    @F.pandas_udf(T.ArrayType(CLUE))
    def said(addr: pd.Series, name: pd.Series) -> pd.Series:
        names = CLUE.names
        return pd.Series([[dict(zip(names, c, strict=True)) for c in clues(a or "", n or "", readings)] for a, n in zip(addr, name, strict=True)])

    return clusters.withColumn("clues", said("addr", "name"))


def common_clues(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of clusters with the kinds of evidence that they have in common and whether a street speaks against them."""
    each = rows.select("cluster_id", F.explode("clues").alias("c")).select("cluster_id", "c.*")
    sharp = F.col("kind").isin("brand", "written") | (F.col("key") == "")
    sent = each.where("kind <> 'number'").withColumn("form", F.explode(F.when(sharp, F.array("key")).otherwise(_forms(F.col("key")))))
    own, other = (sent.select("kind", "form", *[F.col(c).alias(f"{p}_{c}") for c in ("cluster_id", "side", "key", "word", "lo", "hi")]) for p in "ab")
    met = own.join(other, ["kind", "form"]).where("a_cluster_id < b_cluster_id and ((a_side = 'any' and b_side = 'any') or (a_side = 'han' and b_side = 'latin') or (a_side = 'latin' and b_side = 'han'))")
    met = met.where(F.col("kind").isin("brand", "written") | (F.levenshtein("a_key", "b_key", 1) >= 0)).drop("form").distinct()
    both = F.col("a_lo").isNotNull() & F.col("b_lo").isNotNull()
    meets = both & (F.col("a_lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("a_hi"))
    word = F.when(F.col("a_side") == "latin", F.col("b_word")).otherwise(F.col("a_word"))
    of = lambda kind, c: F.collect_set(F.when(F.col("kind") == kind, c))
    street = F.col("kind") == "street"
    facts = met.groupBy(F.col("a_cluster_id").alias("a"), F.col("b_cluster_id").alias("b")).agg(
        F.array_union(of("street", F.col("a_key")), of("street", F.col("b_key"))).alias("streets"), F.coalesce(F.bool_or(street & meets), F.lit(False)).alias("numbered"), F.coalesce(F.bool_or(street & both & ~meets), F.lit(False)).alias("differs"),
        F.collect_set(F.when(F.col("kind") == "place", F.struct(F.col("a_key").alias("key"), word.alias("word")))).alias("places"), of("brand", F.lower("a_key")).alias("brands"), of("written", F.col("a_word")).alias("written"), of("sound", word).alias("sounds"),
    )
    # One fact counts once: a street isn't a place as well, a place no brand, and no name.
    near = lambda x, y: F.levenshtein(x, y, 1) >= 0
    facts = facts.withColumn("places", F.filter("places", lambda p: ~F.exists("streets", lambda s: near(p["key"], s))))
    words = F.transform("places", lambda p: p["word"])
    facts = facts.withColumns({
        "brands": F.filter("brands", lambda x: ~F.exists("places", lambda p: F.contains(x, p["key"]) | near(x, p["key"]))),
        "written": F.array_except("written", words), "sounds": F.array_except("sounds", words),
    })
    numbers = each.where("kind = 'number'").groupBy("cluster_id").agg(F.collect_set(F.struct("lo", "hi")).alias("n"))
    mine, theirs = (numbers.select(F.col("cluster_id").alias(p), F.col("n").alias(f"n_{p}")) for p in "ab")
    told = F.exists("n_a", lambda x: F.exists("n_b", lambda y: (x["lo"] <= y["hi"]) & (y["lo"] <= x["hi"]) & ((x["lo"] != x["hi"]) | (y["lo"] != y["hi"]) | (x["hi"] >= 10))))
    facts = facts.join(mine, "a", "left").join(theirs, "b", "left")
    names = {"street": F.size("streets") > 0, "place": F.size("places") > 0, "brand": F.size("brands") > 0, "written": F.size("written") > 0, "sound": F.size("sounds") > 0}
    other_facts = names["place"] | names["brand"] | names["written"] | names["sound"]
    names["number"] = F.col("numbered") | (other_facts & F.coalesce(told, F.lit(False)))
    return facts.select("a", "b", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in names.items()])).alias("kinds"), (F.col("differs") & ~F.col("numbered")).alias("veto"))


def same_place(units: DataFrame, clusters: DataFrame, readings: dict[str, list[str]]) -> DataFrame:
    """Edges (a, b, tier) of clusters in COUNTRIES with KINDS kinds of evidence, no street against them, different sources and, if both are placed, positions within NEAR_M; each the other's only best."""
    own = units.where(F.col("country").isin(*COUNTRIES)).join(clusters.select("unit_id", "cluster_id"), "unit_id")
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_id", F.coalesce(c, F.lit("")).alias("t")))), lambda x: x["t"]), " ").alias(c)
    at = F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.struct("lat", "lng"))
    rows = own.groupBy("cluster_id").agg(text("addr"), text("name"), F.array_sort(F.collect_set("country")).alias("lands"), F.array_sort(F.collect_set("source")).alias("sources"), F.collect_set(at).alias("at"), F.min("unit_id").alias("first"))
    found = common_clues(with_clues(rows, readings)).where((F.size("kinds") >= KINDS) & ~F.col("veto"))
    for side in "ab":
        found = found.join(rows.select(F.col("cluster_id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("lands", "sources", "at", "first")]), side)
    near = F.exists("a_at", lambda x: F.exists("b_at", lambda y: geo.haversine(x["lat"], x["lng"], y["lat"], y["lng"]) <= NEAR_M))
    fits = found.where((F.col("a_lands") == F.col("b_lands")) & (F.col("a_sources") != F.col("b_sources")) & ((F.size("a_at") == 0) | (F.size("b_at") == 0) | near))
    ends = fits.select(F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("other")), F.struct(F.col("b").alias("own"), F.col("a").alias("other")))).alias("e"), F.size("kinds").alias("k")).select("e.*", "k")
    best = joins.unambiguous_best(ends, "own", [F.col("k").desc()]).select("own", "other")
    back = best.select(F.col("other").alias("own"), F.col("own").alias("other"))
    mutual = best.join(back, ["own", "other"]).where("own < other")
    return fits.join(mutual, (F.col("a") == F.col("own")) & (F.col("b") == F.col("other"))).select(F.greatest("a_first", "b_first").alias("a"), F.least("a_first", "b_first").alias("b"), F.lit("two_scripts").alias("tier"))
