"""Personal data: base patterns, and candidates judged by gradient-boosted trees.

The base kinds (email, ip, card, phone) are exact patterns with a check; what they find always stays. Beside them,
generators of high recall propose spans that may overlap: emails with spelled-out signs, telephone numbers without a
plus or beside other digits, card numbers among other numbers, IPv6, social security and bank account numbers, and
secrets (long mixed tokens, values of password-like keys). Boosted trees score each candidate by its format and context;
a kind's threshold is calibrated on examples kept apart. Of overlapping candidates the best stays, and none stays that
overlaps a base span.

No table has labelled spans, so the trees learn from generated examples: each kind's formats in sentences with and
without telling words, and look-alikes (dates, versions, prices, references, identifiers). All of it is seeded, takes
about a second on the driver, and doesn't depend on the input.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "secret")

#: As the base patterns, with what can't change the result: digits' runs begin at their first digit and give none back.
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with a domain after it, and the local part that runs up to it from the match before."""
    out, floor = [], 0
    for m in AT.finditer(text):
        start = m.start()
        while start > floor and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            floor = m.end()
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in characters, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- candidates ----------------------------------------------------------------------------------------------------

GENERATORS = (
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]{0,63}\s?(?:\(at\)|\[at\]|\{at\}|@)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\(dot\)|\[dot\]|\{dot\}|\.)\s?[A-Za-z0-9-]{2,63}){1,3}", re.I)),
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]{0,63} at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{2,63}){1,3}", re.I)),
    ("phone", re.compile(r"(?<![\w.])\+?[0-9]{0,3}[ .-]?\([0-9]{2,5}\)[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])")),
    ("phone", re.compile(r"(?<![\w.+-])\+?[0-9]{1,4}(?:[ .-][0-9]{2,4}){2,4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.+-])[+]?[0-9]{8,15}(?![\w-])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])")),
    ("ip", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])")),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![\w-])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*[0-9])[A-Za-z0-9_/+-]{16,}={0,2}")),
    ("secret", re.compile(r"(?:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s?[=:]\s?[\"']?([^\s\"',;]{6,})", re.I)),
)
CUES = {
    "email": ("mail", "email", "e-mail", "contact", "write", "reach"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "dial", "contact"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "amex", "pay"),
    "ip": ("ip", "host", "server", "address", "from", "login"),
    "ssn": ("ssn", "social", "security", "tax", "insurance"),
    "iban": ("iban", "account", "bank", "transfer"),
    "secret": ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api", "access"),
}
AGAINST = ("version", "v", "isbn", "issn", "order", "invoice", "ref", "no", "page", "pages", "section", "date", "year", "usd", "eur", "price", "commit", "sha", "doi", "serial", "model", "width", "total", "id", "ticket", "lines", "published", "updated", "size")
BEFORE = re.compile(r"[\w-]+")
CUE_OF = {w: i for i, k in enumerate(KINDS) for w in CUES[k]}


def candidates(text: str) -> list[tuple[str, int, int]]:
    # No generator matches a text without a digit, one of @=: or a spelled-out at or dot, in any case.
    if not DIGIT.search(text) and not any(c in text for c in "@=:"):
        lower = text.lower()
        if not any(c in lower for c in ("(at)", "[at]", "{at}", " dot ")):
            return []
    out = []
    for kind, pattern in GENERATORS:
        for m in pattern.finditer(text):
            out.append((kind, *m.span(pattern.groups)))
    return list(dict.fromkeys(out))


def iban_ok(text: str) -> bool:
    raw = text.replace(" ", "")
    turned = "".join(str(int(c, 36)) for c in raw[4:] + raw[:4] if c.isascii() and c.isalnum())
    return bool(turned) and int(turned) % 97 == 1


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span = text[start:end]
    n = len(span)
    counts = {c: span.count(c) for c in set(span)}
    digits = digits_of(span)
    before = [w.lower() for w in BEFORE.findall(text[max(0, start - 40) : start])[-3:]]
    after = [w.lower() for w in BEFORE.findall(text[end : end + 20])[:1]]
    groups = re.findall(r"[0-9]+", span)
    prev, follow = text[start - 1 : start], text[end : end + 1]
    near = before[-1] if before else ""
    return [
        KINDS.index(kind), n, len(digits), len(digits) / n,
        sum(c.isupper() for c in span) / n, sum(c.islower() for c in span) / n,
        sum(not c.isalnum() for c in span), len(groups), max(map(len, groups), default=0), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
        float(luhn(digits)) if len(digits) >= 13 else -1.0, float(iban_ok(span)) if kind == "iban" else -1.0,
        -sum(v / n * math.log2(v / n) for v in counts.values()), len(counts) / n,
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", span))), float(span[:1] == "+"), float("(" in span), span.count("."), span.count("-"), span.count(" "), span.count(":"), float("@" in span),
        float(any(CUE_OF.get(w, -1) == KINDS.index(kind) or w in CUES[kind] for w in before)), float(near in CUES[kind]), float(any(w in AGAINST for w in before)), float(bool(after) and after[0] in AGAINST),
        float(prev in "=:\"'"), float(prev == "" or prev.isspace()), float(prev in "#$€£§/"), float(follow == "" or follow.isspace() or follow in ".,;!?"), float(follow in "%€$/"),
        float(max((int(g[:4]) for g in groups[:4]), default=0) <= 255), float(1900 <= int(groups[0][:4] or 0) <= 2099) if groups and len(groups[0]) == 4 else 0.0,
        float(digits[:1] in ("3", "4", "5", "6")) if digits else 0.0, float(span[:4] in ("AKIA", "ASIA", "ghp_", "xoxb", "sk_l", "sk-p")),
    ]


# --- examples ------------------------------------------------------------------------------------------------------


def _card(r: random.Random) -> str:
    d = r.choice("3456") + "".join(r.choice("0123456789") for _ in range(14))
    return next(d + c for c in "0123456789" if luhn(d + c))


def _iban(r: random.Random) -> str:
    body = "".join(r.choice("0123456789") for _ in range(18))
    country = r.choice(("DE", "FR", "ES", "GB", "NL"))
    return next(x for k in range(2, 99) if iban_ok(x := f"{country}{k:02d}{body}"))


def examples(n: int = 6000, seed: int = 3) -> list[tuple[str, str, int, int, bool]]:
    """(text, kind, start, end, whether it is personal data), balanced over kinds and look-alikes."""
    r = random.Random(seed)
    syllables = ("an", "er", "on", "the", "ti", "es", "re", "la", "de", "ung", "ch", "que", "mi", "eau", "st", "ed")
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    token = lambda k, a: "".join(r.choice(a) for _ in range(k))
    name = lambda: token(r.randint(3, 9), "abcdefghilmnoprstu")
    upper, hexa, mixed = "ABCDEFGHJKLMNPQRSTUVWXYZ0123456789", "0123456789abcdef", "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789_-"
    good = {
        "email": [lambda: f"{name()} (at) {name()} (dot) com", lambda: f"{name()}[at]{name()}[dot]org", lambda: f"{name()} at {name()} dot net", lambda: f"{name()}.{name()}@{name()}.com", lambda: f"{name()}{digits(2)}@mail{digits(1)}.{name()}.org"],
        "phone": [lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"+1 ({digits(3)}) 555-{digits(4)}", lambda: f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"0{digits(2)} {digits(4)} {digits(4)}", lambda: f"+{digits(11)}"],
        "card": [lambda: _card(r), lambda: " ".join(re.findall("....", _card(r))), lambda: "-".join(re.findall("....", _card(r)))],
        "ip": [lambda: ":".join(token(4, hexa) for _ in range(8)), lambda: f"fe80::{token(4, hexa)}:{token(4, hexa)}:{token(3, hexa)}", lambda: ".".join(str(r.randint(1, 255)) for _ in range(4))],
        "ssn": [lambda: f"{r.randint(100, 899)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"],
        "iban": [lambda: _iban(r), lambda: " ".join(re.findall(".{1,4}", _iban(r)))],
        "secret": [lambda: "AKIA" + token(16, upper), lambda: token(r.choice((20, 32, 40)), hexa), lambda: "sk_live_" + token(24, mixed), lambda: "ghp_" + token(36, mixed), lambda: token(18, hexa)],
    }
    bad = [
        lambda: f"{r.randint(1900, 2099)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2099)}", lambda: f"{r.randint(1, 12)} {r.randint(1, 28)} {r.randint(1990, 2030)}",
        lambda: f"{digits(2)}.{digits(3)}.{digits(3)}", lambda: f"{r.randint(300, 999)}.{digits(3)}.{digits(3)}.{digits(2)}", lambda: f"1{digits(2)}-{digits(1)}-{digits(5)}-{digits(3)}-{digits(1)}", lambda: f"97{digits(11)}",
        lambda: digits(r.choice((8, 9, 10, 12, 13, 14, 16, 17, 18))), lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"{name()}_{name()}_{name()}_{digits(1)}", lambda: f"{name()}-{name()}-{name()}-{r.randint(1, 99)}", lambda: f"{name()}/{name()}/{name()}{r.randint(1, 2020)}",
        lambda: f"{r.randint(1, 99)} {digits(3)} {digits(3)}", lambda: f"{r.randint(1, 99)}-{r.randint(100, 199)}-{r.randint(200, 299)}", lambda: f"{name()} at {name()}. {name()}", lambda: f"AB{digits(2)} {token(4, upper)} {token(4, upper)} {token(4, upper)}", lambda: "0" * r.randint(16, 30), lambda: "=" * 10 + digits(8) + "-" * 8,
    ]
    words = lambda: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(2, 6)))
    out = []
    kinds = [k for k in KINDS for _ in range(2)]
    while len(out) < n:
        if r.random() < 0.5:
            kind = r.choice(kinds)
            span, lead = r.choice(good[kind])(), f"{r.choice(CUES[kind])}{r.choice((' ', ': ', '='))}" if r.random() < 0.4 else ""
            if kind == "secret" and span[:1] in hexa and len(span) == 18:
                lead = f"password{r.choice(('=', ': '))}"
        else:
            kind, span, lead = "", r.choice(bad)(), f"{r.choice(AGAINST)}{r.choice((' ', ': ', ' #'))}" if r.random() < 0.6 else ""
        if lead[-1:] == "#":
            lead = lead[:-1] + " "
        text = f"{words()} {lead}"
        start = len(text)
        text = f"{text}{span}{r.choice(('', ',', '.', ''))} {words()}"
        found = candidates(text)
        for k, a, b in found:
            if a >= start and b <= start + len(span) + 1:
                out.append((text, k, a, b, k == kind and a == start and b >= start + len(span)))
    return out[:n]


# --- boosted trees -------------------------------------------------------------------------------------------------


@dataclass
class Trees:
    """Trees of depth DEPTH as flat arrays: feature and threshold of inner nodes, values of leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


DEPTH, TREES, RATE, BINS = 4, 60, 0.25, 24


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic boosting with second-order leaves; splits at quantiles."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    share = y.mean()
    model = Trees(np.zeros((TREES, 2**DEPTH - 1), int), np.full((TREES, 2**DEPTH - 1), np.inf), np.zeros((TREES, 2**DEPTH)), math.log(share / (1 - share)))
    score = np.full(len(y), model.start)
    for tree in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), int)
        for node in range(2**DEPTH - 1):
            own = np.flatnonzero(at == node)
            best = (1e-6, 0, np.inf, None)
            if len(own) >= 20:
                whole_g, whole_h = g[own].sum(), h[own].sum()
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    left_g = np.cumsum(np.bincount(binned[own, j], g[own], len(e) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[own, j], h[own], len(e) + 1))[:-1]
                    gain = left_g**2 / (left_h + 1) + (whole_g - left_g) ** 2 / (whole_h - left_h + 1) - whole_g**2 / (whole_h + 1)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], j, e[k], None)
            model.feature[tree, node], model.threshold[tree, node] = best[1], best[2]
            at[own] = 2 * node + 1 + (x[own, best[1]] > best[2])
        leaves = at - (2**DEPTH - 1)
        model.leaf[tree] = RATE * np.bincount(leaves, g, 2**DEPTH) / (np.bincount(leaves, h, 2**DEPTH) + 1)
        score += model.leaf[tree][leaves]
    return model


@lru_cache(maxsize=1)
def model(precision: float = 0.99) -> Trees:
    """Trees fitted to three quarters of the examples; each kind's threshold is the least at which ``precision`` of its other examples at or above it are right (0.5 at least)."""
    rows = examples()
    x = np.array([features(t, k, a, b) for t, k, a, b, _ in rows])
    y = np.array([e[4] for e in rows], float)
    apart = np.arange(len(rows)) % 4 == 3
    trees = boost(x[~apart], y[~apart])
    p = 1 / (1 + np.exp(-trees.logits(x[apart])))
    kinds = np.array([e[1] for e in rows])[apart]
    for kind in KINDS:
        own, right = p[kinds == kind], y[apart][kinds == kind]
        order = np.argsort(-own)
        share = np.cumsum(right[order]) / np.arange(1, len(own) + 1)
        fit = own[order][share >= precision]
        trees.thresholds[kind] = max(0.5, float(fit.min())) if len(fit) else 1.0
    return trees


# --- the operator --------------------------------------------------------------------------------------------------


def merged(spans) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs that overlapping spans (start, end) make, in order."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def meets(starts: list[int], ends: list[int], a: int, b: int) -> bool:
    """Whether a to b overlaps one of disjoint runs in order."""
    k = bisect_left(starts, b)
    return k > 0 and ends[k - 1] > a


def apart(found: list[tuple[float, str, int, int]]) -> list[tuple[str, int, int]]:
    """Of candidates (-score, kind, start, end) those that stay, best first, longer before shorter: none overlaps a better one that stays.

    Candidates are taken run by run (only those of one run can overlap), and compared with the neighbours of their place alone.
    """
    out = []
    by_start = sorted(found, key=lambda c: (c[2], c[3]))
    first, end = 0, -1
    for k in range(len(by_start) + 1):
        if k < len(by_start) and (k == first or by_start[k][2] < end):
            end = max(end, by_start[k][3])
            continue
        starts: list[int] = []
        ends: list[int] = []
        for _, kind, a, b in sorted(by_start[first:k], key=lambda c: (c[0], c[2] - c[3], c[2], c[1])):
            if not meets(starts, ends, a, b):
                at = bisect_left(starts, a)
                starts.insert(at, a)
                ends.insert(at, b)
                out.append((kind, a, b))
        if k < len(by_start):
            first, end = k, by_start[k][3]
    return out


def all_spans(texts: list[str], trees: Trees) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    found = [(i, *c) for i, t in enumerate(texts) for c in candidates(t)]
    # What a base span covers is settled; only the rest is scored.
    taken = [merged((a, b) for _, a, b in s) for s in base]
    found = [c for c in found if not meets(*taken[c[0]], c[2], c[3])]
    more: list[list[tuple[float, str, int, int]]] = [[] for _ in texts]
    if found:
        x = np.array([features(texts[i], k, a, b) for i, k, a, b in found])
        p = 1 / (1 + np.exp(-trees.logits(x)))
        for (i, k, a, b), q in zip(found, p.tolist(), strict=True):
            if q >= trees.thresholds[k]:
                more[i].append((-q, k, a, b))
    out = []
    for own, extra in zip(base, more, strict=True):
        out.append((own, sorted([*own, *apart(extra)], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each run of overlapping spans becomes its first kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and, if asked for, redacted, of every row.

    Null and empty texts have no spans (redacted: null stays null). Rows that repeat, and rows of a null or repeated
    doc_id, are each searched; other columns are left out. No rows give none. Time grows with a text's length and, but for
    a logarithm, with its spans.
    """
    trees = model()
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", redacted string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                texts = part.column(1).to_pylist()
                found = all_spans([t or "" for t in texts], trees)
                counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in BASE]
                columns = [part.column(0), *counts, pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]), pa.array([written(spans) for _, spans in found])]
                if with_text:
                    columns.append(pa.array([None if t is None else redacted(t, spans) for t, (_, spans) in zip(texts, found, strict=True)], pa.string()))
                yield pa.record_batch(columns, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mapped(rows, run, schema)


def redacted_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the spans of all kinds in its texts replaced, in one pass; null texts stay null, other columns as they are."""
    trees, at = model(), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(0, batch.num_rows, 1000):
                texts = batch.column(at).slice(k, 1000).to_pylist()
                out += [None if t is None else redacted(t, spans) for t, (_, spans) in zip(texts, all_spans([t or "" for t in texts], trees), strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return mapped(docs, run, docs.schema)
