"""Quality rules as a short-circuit cascade, with DataFrame operations only.

Each rule says which documents it rejects, and on which statistics of the text it rests. A bounded sample of texts gives
the share that a rule rejects of what is left, and its cost: the work of its own test and of those statistics that no
earlier rule has needed. Rules stand in order of rejection per cost. A document meets them until one rejects it, and a
statistic is computed when the first rule that needs it is reached, for the documents that are still in: few rejected
documents ever pay for the dear ones. The order changes the time, never the verdict.

Work is counted, not clocked (see ``work``), and the sample is drawn by a hash of the text, so that a table always
gives one order, and with it one name of the rule that rejects.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
SYMBOLS = "#*$%&|<>"
#: Distinct texts that rules are measured on, about.
SAMPLE = 2000
#: Window hashes give this many low bits to the window's place.
PLACE = 24


def _without(text: Column, drop) -> Column:
    for c in drop:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def word_chars(text: Column) -> Column:
    return F.char_length(_without(text, BLANKS)).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(_without(text, SYMBOLS))).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def with_words(rows: DataFrame, text: str) -> DataFrame:
    """rows with _words and their number; a null text has none."""
    out = rows.withColumn("_words", F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)))
    return out.withColumn("n_words", F.coalesce(F.size("_words"), F.lit(0)).cast("long"))


def with_windows(rows: DataFrame, alive: Column) -> DataFrame:
    """rows (with_words()) with n_repeat_words: words in 3-word windows that the text has twice or more, first included; 0 where alive is false.

    Windows are hashed to 64 bits; the low ``PLACE`` bits then give way to the window's place, so that one sort of plain
    longs brings repeats together. The places of repeats, sorted again, say how many words they cover. Where windows
    that differ agree in the bits that are left, or the text has more windows than places, pairs of the whole hash and
    the place are sorted instead. Each step is a column of its own: lambdas then read it instead of computing it anew.
    """
    low = (1 << PLACE) - 1
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))
    out = rows.withColumn("_h", F.when(alive & (F.col("n_words") >= 3), windows).otherwise(F.expr("cast(array() as array<bigint>)")))
    placed = F.transform("_h", lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    out = out.withColumn("_p", F.sort_array(placed))

    def whole(x: Column) -> Column:
        return F.get("_h", x.bitwiseAND(F.lit(low)).cast("int"))

    def same(x: Column, other: Column) -> Column:
        return F.coalesce(F.shiftright(x.bitwiseXOR(other), PLACE) == 0, F.lit(False))

    def differs(i: Column) -> Column:
        """Whether the places i and i + 1 of _p agree in the bits kept but not in the whole hash."""
        return same(F.get("_p", i), F.get("_p", i + 1)) & (whole(F.get("_p", i)) != whole(F.get("_p", i + 1)))

    repeats = F.filter("_p", lambda x, i: same(x, F.get("_p", i - 1)) | same(x, F.get("_p", i + 1)))
    out = out.withColumn("_r", repeats)
    mixed = (F.size("_h") > low) | ((F.size("_r") > 0) & F.exists(F.sequence(F.lit(0), F.size("_p")), differs))
    pairs = F.when(mixed, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))).otherwise(F.expr("cast(array() as array<struct<h:bigint,i:bigint>>)"))
    out = out.withColumn("_mixed", mixed).withColumn("_pairs", pairs)
    equal = F.filter("_pairs", lambda x, i: F.coalesce(x["h"] == F.get("_pairs", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_pairs", i + 1)["h"], F.lit(False)))
    places = F.when(F.col("_mixed"), F.transform(equal, lambda x: x["i"])).otherwise(F.transform("_r", lambda x: x.bitwiseAND(F.lit(low))))
    covered = F.aggregate(
        F.sort_array(places),
        F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_h", "_p", "_r", "_mixed", "_pairs")


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics of the text alone, as columns.
PLAIN = {"word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines}


def with_statistic(rows: DataFrame, name: str, alive: Column) -> DataFrame:
    """rows (text in _text) with one more statistic, which is zero where alive is false."""
    if name == "n_words":
        return with_words(rows.withColumn("_in", F.when(alive, F.col("_text"))), "_in").drop("_in")
    if name == "n_repeat_words":
        return with_windows(rows, alive)
    return rows.withColumn(name, F.when(alive, PLAIN[name](F.col("_text"))).otherwise(F.lit(0).cast("long")))


def with_repeats(rows: DataFrame, text: str) -> DataFrame:
    """rows with n_words and n_repeat_words of a text column."""
    return with_windows(with_words(rows, text), F.lit(True)).drop("_words")


def _apart(docs: DataFrame, text_col: str) -> DataFrame:
    """_row (all columns but the text, by place), _own (the text as it is) and _text (never null): nothing that follows can meet a document's own column."""
    others = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col]
    return docs.select(F.struct(F.lit(0).alias("_"), *others).alias("_row"), F.col(f"`{text_col}`").alias("_own"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))


def _together(docs: DataFrame, text_col: str) -> list[Column]:
    """The columns of docs from _apart(), in their order."""
    return [(F.col("_own") if c == text_col else F.col("_row")[f"c{k}"]).alias(c) for k, c in enumerate(docs.columns)]


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _text and the five statistics (long) of its whole texts; null and empty texts have zeros."""
    rows = docs.withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    for name in STATISTICS:
        rows = with_statistic(rows, name, F.lit(True))
    return rows.drop("_words")


@dataclass(frozen=True)
class Rule:
    """name, what it rejects (a condition on the statistics and _text, the text, never null), the statistics that it needs, and the bytes of text that its own test scans, in texts."""

    name: str
    rejects: Callable[[], Column]
    needs: tuple[str, ...] = ()
    scans: int = 0


def _share(of: Column, n: Column) -> Column:
    return of / F.greatest(n, F.lit(1))


#: The first two are the base; the rest keep the labelled good texts of the training tables with a wide margin.
RULES = (
    Rule("few_words", lambda: F.col("n_words") < 50, ("n_words",)),
    Rule("repeated_words", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words"), ("n_words", "n_repeat_words")),
    Rule("symbols", lambda: _share(F.col("n_symbols"), F.col("n_words")) > 0.25, ("n_words", "n_symbols")),
    Rule("word_length", lambda: ~_share(F.col("word_chars"), F.col("n_words")).between(2.0, 15.0), ("n_words", "word_chars")),
    Rule("repeated_lines", lambda: F.col("n_dup_lines") * 2 > F.size(F.split("_text", "\n", -1)), ("n_dup_lines",), 1),
    Rule("capitals", lambda: _share(F.col("word_chars") - F.char_length(F.regexp_replace(F.regexp_replace("_text", SPACE, ""), r"\p{Lu}", "")), F.col("word_chars")) > 0.4, ("word_chars",), 8),
    Rule("exclamations", lambda: _share(F.octet_length("_text") - F.octet_length(F.replace(F.col("_text"), F.lit("!"), F.lit(""))), F.col("n_words")) > 0.5, ("n_words",), 1),
)
BASE = RULES[:2]


def work() -> dict[str, Column]:
    """What a statistic costs for one text, and its size, in bytes of text passed over once. Patterns pass a byte about four times as slowly as replacements; a window is hashed, sorted and looked at as long as some bytes are replaced."""
    size, words = F.octet_length("_text"), F.col("n_words")
    return {"n_words": 4 * size, "word_chars": len(BLANKS) * size, "n_symbols": len(SYMBOLS) * size, "n_dup_lines": 5 * size, "n_repeat_words": (words * (40 + 4 * F.log2(words + 2))).cast("long"), "size": size}


def sampled(docs: DataFrame, text_col: str = "text", n_rows: int | None = None) -> DataFrame:
    """About SAMPLE distinct texts (_text) of docs, by a hash of the text; fewer if there are no more."""
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text")).where("_text is not null")
    one_in = max(1, (docs.count() if n_rows is None else n_rows) // SAMPLE)
    return texts.where(F.pmod(F.xxhash64("_text", F.lit(11)), F.lit(one_in)) == 0).distinct()


def ordered_rules(texts: DataFrame, rules: tuple[Rule, ...] = RULES, known: tuple[str, ...] = ()) -> list[tuple[Rule, float, float]]:
    """(rule, work, share rejected of what earlier ones left) in order of rejection per work; known: statistics that are there anyway.

    texts: sampled(). One row for each set of rules that reject together reaches the driver, with the work of its texts.
    """
    rows = with_statistics(texts, "_text")
    hits = F.concat(*[F.when(F.coalesce(r.rejects(), F.lit(False)), "1").otherwise("0") for r in rules])
    found = rows.groupBy(hits.alias("hits")).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"w_{k}") for k, c in work().items()]).collect()
    left, have, out, todo = found, set(known), [], list(rules)
    while todo:
        n = sum(r.n for r in left)

        def rated(rule: Rule) -> tuple[float, float]:
            cost = sum(r[f"w_{s}"] for r in left for s in rule.needs if s not in have) + rule.scans * sum(r.w_size for r in left)
            return max(cost / max(n, 1), 1.0), sum(r.n for r in left if r.hits[rules.index(rule)] == "1") / max(n, 1)

        best = max(todo, key=lambda rule: (rated(rule)[1] / rated(rule)[0], -rated(rule)[0], -rules.index(rule)))
        out.append((best, *rated(best)))
        todo.remove(best)
        have |= set(best.needs)
        left = [r for r in left if r.hits[rules.index(best)] == "0"]
    return out


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule, in this order, that rejects; null if none does. Later rules are then not evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.rejects(), F.lit(False)), F.lit(rule.name)).otherwise(out)
    return out


def _settled(kept: Column) -> Column:
    """kept, for a column that counts as non-deterministic: a filter on it would else be pushed below the steps of the statistics and repeat them all."""
    return F.when(F.monotonically_increasing_id() >= 0, kept).otherwise(F.lit(False))


def judged(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the five statistics, base_failed, kept, and rejected_by (the first rule in the order that rejects, or null).

    All statistics are computed, as they are returned; of the rules that need more, the cascade spares the rejected
    documents. A null or empty text has no words, so the base rejects it. Columns of docs stay as they are; one that has
    the name of a verdict's column is returned as own_<name> (with underscores before it if that is taken, too). Rows
    that repeat, and rows of a null or repeated doc_id, each get a verdict; no rows give none.
    """
    order = [rule for rule, _, _ in ordered_rules(sampled(docs, text_col), rules, STATISTICS)]
    rows = _apart(docs, text_col)
    for name in STATISTICS:
        rows = with_statistic(rows, name, F.lit(True))
    base = F.coalesce(BASE[0].rejects() | BASE[1].rejects(), F.lit(True))
    rows = rows.withColumn("base_failed", base).withColumn("rejected_by", cascade(order))
    verdict = (*STATISTICS, "base_failed", "kept", "rejected_by")
    clash = [c for c in docs.columns if c.lower() in verdict]
    new = dict(zip(clash, fresh(docs, *[f"own_{c}" for c in clash]), strict=True))
    own = [c.alias(new.get(name, name)) for c, name in zip(_together(docs, text_col), docs.columns, strict=True)]
    kept = _settled(~F.col("base_failed") & F.col("rejected_by").isNull())
    return rows.withColumn("kept", kept).select(*own, *STATISTICS, "base_failed", "rejected_by", "kept")


def kept_rows(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that no rule rejects, with their columns as they are: the cascade with statistics on demand.

    rules must hold the base, or it isn't asked. Null and empty texts go (no words); rows that repeat stay each; no rows
    give none.
    """
    rows, alive, have = _apart(docs, text_col).withColumn("_alive", F.lit(True)), F.col("_alive"), set()
    for rule, _, _ in ordered_rules(sampled(docs, text_col), rules):
        for name in sorted(set(rule.needs) - have, key=STATISTICS.index):
            rows = with_statistic(rows, name, alive)
        have |= set(rule.needs)
        rows = rows.withColumn("_alive", alive & ~F.coalesce(rule.rejects(), F.lit(False)))
    return rows.withColumn("_kept", _settled(alive)).where("_kept").select(*_together(docs, text_col))
