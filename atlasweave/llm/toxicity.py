"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Training takes a bounded sample of labelled rows (``SAMPLE`` of each class and ``BYTES`` of text together, the same for any
size of input). Its three chains are fitted by three tasks, none on the driver. Labels are of
documents, so tokens are labelled first: in a toxic document, words and word beginnings that many toxic and hardly any
clean documents have. A two-tag chain is fitted to those token labels; weights are of the
word, its first four to seven letters and its last three. Document scores are fitted to what forward-backward marginals
say of whole documents that their chain hasn't seen: the largest, their sum and their share.

Marginals of whole texts are exact at any length: a document's tokens go into blocks of ``BLOCK``, each block's transfer
matrix is multiplied up for all blocks at once, boundary vectors run over the blocks of a document, and forward and
backward passes run inside all blocks at once.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, materialise

SAMPLE = 3000
#: Bytes of text that the sample of either class holds at most. Rows come in their order by hash until the next doesn't fit;
#: a text that is longer than all of it is never learnt from (it is scored whole, like any other).
BYTES = 32 << 20
#: Of the sampled rows' windows, those with a toxic tag and others that the chain learns from at most.
HOT_WINDOWS, CLEAN_WINDOWS = 4000, 6000
FOLDS, HELD_OUT = 5, 0
WORD = re.compile(r"[^\W\d_]+")
SLOTS = 1 << 18
BLOCK = 128
WINDOW = 64
#: Twice the logarithm of the likelihood ratio that makes an attribute a mark of toxic documents.
MARKED = 26.0
CAP = 100_000


#: Lengths of the word beginnings that are attributes, and how many attributes a word has.
BEGINNINGS = (4, 5, 6, 7)
ATTRIBUTES = len(BEGINNINGS) + 2


def attributes(word: str) -> tuple[str, ...]:
    """The word, its beginnings, and last its end."""
    return (f"w{word}", *[f"{k}{word[:k]}" for k in BEGINNINGS], f"e{word[-3:]}")


def slots(word: str) -> list[int]:
    return [zlib.crc32(a.encode()) % SLOTS for a in attributes(word)]


@dataclass
class Model:
    weights: np.ndarray  # of attribute slots, for the toxic tag
    chain: np.ndarray  # 2 x 2, log weights of a tag after a tag
    bias: float
    final: np.ndarray  # of document features

    def word_score(self, word: str) -> float:
        return float(np.clip(self.bias + self.weights[slots(word)].sum(), -20, 20))


# --- the chain -----------------------------------------------------------------------------------------------------


def _step(a: np.ndarray, m: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Row vectors a (..., 2) after one token: times the chain, times its emission (1, e)."""
    out = np.stack([a[..., 0] * m[0, 0] + a[..., 1] * m[1, 0], (a[..., 0] * m[0, 1] + a[..., 1] * m[1, 1]) * e], -1)
    return out


def _back(b: np.ndarray, m: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Column vectors b (..., 2) before one token."""
    on = b[..., 1] * e
    return np.stack([m[0, 0] * b[..., 0] + m[0, 1] * on, m[1, 0] * b[..., 0] + m[1, 1] * on], -1)


def _unit(x: np.ndarray, axes: tuple[int, ...] = (-1,)) -> np.ndarray:
    return x / np.maximum(x.max(axis=axes, keepdims=True), 1e-300)


def block_marginals(scores: np.ndarray, real: np.ndarray, m: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """P(toxic) of each token of blocks (n, size); before, after: boundary vectors; tokens that aren't real change nothing."""
    n, size = scores.shape
    e = np.exp(scores)
    forward = np.empty((size, n, 2))
    a = before
    for t in range(size):
        a = np.where(real[:, t, None], _unit(_step(a, m, e[:, t])), a)
        forward[t] = a
    out, b = np.empty((size, n)), after
    for t in range(size - 1, -1, -1):
        p = forward[t] * b
        out[t] = p[:, 1] / np.maximum(p.sum(1), 1e-300)
        b = np.where(real[:, t, None], _unit(_back(b, m, e[:, t])), b)
    return out.T


def marginals(scores: np.ndarray, counts: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """P(toxic) of each token; documents' tokens stand one after another, counts says how many each has."""
    if not len(scores):
        return np.zeros(0)
    m = np.exp(chain)
    n_blocks = -(-counts // BLOCK)
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(scores)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.cumsum(n_blocks) - n_blocks
    row, column = first[doc] + place // BLOCK, place % BLOCK
    total = int(n_blocks.sum())
    block, real = np.zeros((total, BLOCK)), np.zeros((total, BLOCK), bool)
    block[row, column], real[row, column] = scores, True
    before, after = np.ones((total, 2)), np.ones((total, 2))
    if n_blocks.max() > 1:
        e, products = np.exp(block), np.tile(np.eye(2), (total, 1, 1))
        for t in range(BLOCK):
            products = np.where(real[:, t, None, None], _unit(_step(products, m, e[:, t, None]), (-1, -2)), products)
        longest = int(n_blocks.max())
        for k in range(longest - 1):
            at = first[n_blocks > k + 1] + k
            before[at + 1] = _unit(np.einsum("ni,nij->nj", before[at], products[at]))
            end = (first + n_blocks)[n_blocks > k + 1] - 1 - k
            after[end - 1] = _unit(np.einsum("nij,nj->ni", products[end], after[end]))
    return block_marginals(block, real, m, before, after)[row, column]


# --- training ------------------------------------------------------------------------------------------------------


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def token_labels(docs: list[list[str]], toxic: np.ndarray) -> list[np.ndarray]:
    """Tags of each document's words: attributes (word, beginnings) that mark toxic documents out."""
    often = Counter(a for words, y in zip(docs, toxic, strict=True) if y for a in {a for w in set(words) for a in attributes(w)[:-1]})
    often = {a: n for a, n in often.items() if n >= 3}
    seen = (Counter(), often)
    for words, y in zip(docs, toxic, strict=True):
        if not y:
            seen[0].update({a for w in set(words) for a in attributes(w)[:-1] if a in often})
    share = max(1, int(toxic.sum())) / max(2, len(toxic))

    def mark(a: str, n: int) -> bool:
        """Far more documents are toxic than chance would have it (a likelihood ratio test at about one in a million)."""
        clean = seen[0][a]
        total = n + clean
        ratio = 2 * (n * math.log(n / (total * share)) + (clean * math.log(clean / (total * (1 - share))) if clean else 0))
        return n * (1 - share) > 4 * (clean + 0.5) * share and ratio > MARKED

    marks = {a for a, n in seen[1].items() if mark(a, n)}
    return [np.array([y and any(a in marks for a in attributes(w)[:-1]) for w in words], bool) for words, y in zip(docs, toxic, strict=True)]


#: Windows that a step of the training holds the vectors of at once.
WINDOWS = 1000


def misses(model: Model, at: np.ndarray, real: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows (n, WINDOW): each word's tag less its marginal, and the tag pairs that there are less those expected."""
    n = len(at)
    scores = np.clip(model.bias + model.weights[at].sum(2), -20, 20)
    m, e = np.exp(model.chain), np.exp(scores)
    ones = np.ones((n, 2))
    forward, a = np.empty((WINDOW, n, 2)), ones
    for t in range(WINDOW):
        a = np.where(real[:, t, None], _unit(_step(a, m, e[:, t])), a)
        forward[t] = a
    backward, b = np.empty((WINDOW, n, 2)), ones
    for t in range(WINDOW - 1, -1, -1):
        backward[t] = b
        b = np.where(real[:, t, None], _unit(_back(b, m, e[:, t])), b)
    p = forward * backward
    miss = np.where(real, gold - (p[..., 1] / p.sum(-1)).T, 0.0)
    pairs = real[:, 1:]
    both = forward[:-1, :, :, None] * m[None, None] * (backward[1:] * np.stack([np.ones_like(e), e], -1).transpose(1, 0, 2)[1:])[:, :, None, :]
    both /= np.maximum(both.sum((2, 3), keepdims=True), 1e-300)
    expected = (both * pairs.T[:, :, None, None]).sum((0, 1))
    g = gold.astype(int)
    found = np.bincount((2 * g[:, :-1] + g[:, 1:])[pairs], minlength=4).reshape(2, 2)
    return miss, found - expected


def fit_chain(docs: list[list[str]], tags: list[np.ndarray], steps: int = 40, hot_windows: int = HOT_WINDOWS, clean_windows: int = CLEAN_WINDOWS) -> Model:
    """A chain fitted by AdaGrad to windows of words: at most hot_windows with a toxic tag, and of the others twice as many as have one (1,000 at least, clean_windows at most); both drawn at random."""
    rng = np.random.default_rng(5)
    hot, cold = [], []
    for words, own in zip(docs, tags, strict=True):
        for k in range(0, len(words), WINDOW):
            (hot if own[k : k + WINDOW].any() else cold).append((words[k : k + WINDOW], own[k : k + WINDOW]))
    rng.shuffle(hot)
    rng.shuffle(cold)
    used = hot[:hot_windows] + cold[: max(1000, min(clean_windows, 2 * len(hot)))]
    model = Model(np.zeros(SLOTS), np.zeros((2, 2)), -4.0, np.zeros(4))
    if not hot:
        return model
    known: dict[str, list[int]] = {}
    n = len(used)
    at, real, gold = np.zeros((n, WINDOW, ATTRIBUTES), np.int32), np.zeros((n, WINDOW), bool), np.zeros((n, WINDOW), bool)
    for i, (words, own) in enumerate(used):
        for w in words:
            if w not in known:
                known[w] = slots(w)
        if words:
            at[i, : len(words)] = [known[w] for w in words]
            real[i, : len(words)], gold[i, : len(words)] = True, own
    del known, used, hot, cold
    weight_sq, chain_sq, bias_sq = np.full(SLOTS, 1e-8), np.full((2, 2), 1e-8), 1e-8
    for _ in range(steps):
        grad, chain_grad, bias_grad = -0.02 * model.weights, -0.02 * model.chain, 0.0
        for k in range(0, n, WINDOWS):
            own = slice(k, k + WINDOWS)
            miss, moved = misses(model, at[own], real[own], gold[own])
            grad += np.bincount(at[own].ravel(), np.repeat(miss.ravel(), ATTRIBUTES), SLOTS)
            chain_grad += moved
            bias_grad += miss.sum()
        weight_sq += grad**2
        chain_sq += chain_grad**2
        bias_sq += bias_grad**2
        model.weights += 0.5 * grad / np.sqrt(weight_sq)
        model.chain += 0.2 * chain_grad / np.sqrt(chain_sq)
        model.bias += 0.2 * bias_grad / math.sqrt(bias_sq)
    return model


def document_features(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One, the largest marginal, the logarithm of their sum, and their share, of each document."""
    out = np.zeros((len(counts), 4))
    out[:, 0] = 1
    some = counts > 0
    if some.any():
        starts = (np.cumsum(counts) - counts)[some]
        total = np.add.reduceat(p, starts)
        out[some, 1] = np.maximum.reduceat(p, starts)
        out[some, 2] = np.log1p(total)
        out[some, 3] = np.sqrt(total / counts[some])
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 40) -> np.ndarray:
    """Newton's method with a ridge."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-4, *[0.05] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge
        w += np.linalg.solve(h, x.T @ (y - p) - ridge @ w)
    return w


#: Of a document's 3-word sequences the smallest hashes, which stand for all when copies are looked for.
SKETCH = 24


def without_copies(docs: list[list[str]]) -> list[int]:
    """Indices of documents of whose sketch at most 40 % stood in earlier ones: copies would count as evidence again and again."""
    seen: set[int] = set()
    out = []
    for i, words in enumerate(docs):
        own = set(nsmallest(SKETCH, {zlib.crc32(" ".join(words[k : k + 3]).encode()) for k in range(max(1, len(words) - 2))}))
        if 5 * len(own & seen) <= 2 * len(own):
            out.append(i)
            seen |= own
    return out


def prepared(texts: list[str | None], toxic: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
    """Words and labels of the texts that aren't copies of earlier ones."""
    one: dict[str, str] = {}
    docs = [[one.setdefault(w, w) for w in words_of(t)] for t in texts]  # a word is held once
    own = without_copies(docs)
    return [docs[i] for i in own], toxic[own]


PARTS = (0, 1, 2)


def fit_part(docs: list[list[str]], toxic: np.ndarray, part: int) -> tuple[Model, np.ndarray, np.ndarray]:
    """A chain and, of parts 0 and 1, what it says of the documents that it hasn't seen: that half of them, and their labels. Part 2 is the chain of all."""
    half = np.arange(len(docs)) % 2
    at = np.arange(len(docs)) if part == 2 else np.flatnonzero(half == part)
    own = [docs[i] for i in at]
    model = fit_chain(own, token_labels(own, toxic[at]))
    if part == 2:
        return model, np.zeros((0, 4)), np.zeros(0)
    rest = np.flatnonzero(half != part)
    return model, _features(model, [docs[i] for i in rest]), toxic[rest].astype(float)


def constant(toxic: np.ndarray) -> Model:
    """Of labels of one class, or none."""
    return Model(np.zeros(SLOTS), np.zeros((2, 2)), -4.0, np.array([6.0 if len(toxic) and toxic.all() else -6.0, 0, 0, 0]))


def train(texts: list[str | None], toxic: np.ndarray) -> Model:
    """The chain is of all rows; document scores are fitted to what chains of either half say of the other.

    Needs both classes; else scores are constant.
    """
    docs, toxic = prepared(texts, toxic)
    if not toxic.any() or toxic.all():
        return constant(toxic)
    parts = [fit_part(docs, toxic, k) for k in PARTS]
    model = parts[2][0]
    model.final = fit_logistic(np.concatenate([x for _, x, _ in parts]), np.concatenate([y for *_, y in parts]))
    return model


def _features(model: Model, docs: list[list[str]]) -> np.ndarray:
    known = {w: model.word_score(w) for d in docs for w in set(d)}
    counts = np.array([len(d) for d in docs], np.int64)
    scores = np.array([known[w] for d in docs for w in d])
    return document_features(marginals(scores, counts, model.chain), counts)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """h, mark, text and y (1: toxic) of at most ``sample`` rows and ``most_bytes`` of text of each class, by a hash of doc_id, of the labelled rows that aren't held out.

    Labels other than 0 and 1, and of null ids, don't count. Rows alike in doc_id and text are one. No column but the id and
    the text is read.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    own = own.where(~held_out(F.col("id"))).withColumn("h", F.xxhash64("id", F.lit(8))).distinct()
    first = Window.partitionBy("y").orderBy("h", "id")
    chosen = own.withColumn("place", F.row_number().over(first)).where(F.col("place") <= sample).drop("place")  # limited before the shuffle
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    found = texts.join(F.broadcast(chosen), F.col("doc") == F.col("id"))  # 2 * sample rows at most are broadcast
    # Sizes alone are ranked; of rows that share doc_id and text one is left before the shuffle.
    sizes = found.groupBy("h", "id", "mark", "y").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
    order = Window.partitionBy("y").orderBy("h", "id", "mark")
    ranked = sizes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample)
    fit = ranked.withColumn("sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("sum") <= most_bytes)
    fit = materialise(fit.select("h", F.col("id").alias("own_id"), F.col("mark").alias("own_mark"), "y").coalesce(1), "training")
    return texts.join(F.broadcast(fit), (F.col("doc") == F.col("own_id")) & (F.col("mark") == F.col("own_mark"))).select("h", "mark", "text", "y").distinct()


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT


# --- scoring -------------------------------------------------------------------------------------------------------


class Scorer:
    """Scores of words are remembered (CAP new ones, and the CAP before); texts go through in slices of bounded size."""

    def __init__(self, model: Model) -> None:
        self.model, self.known, self.old = model, {}, {}
        self.weights = model.weights.tolist()

    def word_score(self, word: str) -> float:
        """As the model's, in plain floats."""
        weights, out = self.weights, self.model.bias
        for a in attributes(word):
            out += weights[zlib.crc32(a.encode()) % SLOTS]
        return -20.0 if out < -20 else 20.0 if out > 20 else out

    def _scores(self, words: list[str]) -> list[float]:
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > CAP:
                self.known, self.old = {}, self.known
            known, old = self.known, self.old
            for k, x in enumerate(found):
                if x is None:
                    w = words[k]
                    x = known.get(w)
                    if x is None:
                        x = old.get(w)
                        known[w] = x = self.word_score(w) if x is None else x
                    found[k] = x
        return found

    def slices(self, texts: list[str | None], spans: bool = False, most: int = 150_000) -> Iterator[tuple[np.ndarray, list | None]]:
        """(document scores, offending (start, end) places of each, if asked for)."""
        held, counts, own = [], [], []
        for text in texts:
            words = WORD.findall((text or "").lower())
            if spans:
                own.append(text or "")
            held.append(self._scores(words))
            counts.append(len(words))
            if len(counts) % 16 == 0 and sum(counts) >= most:
                yield self._done(held, counts, own if spans else None)
                held, counts, own = [], [], []
        if counts:
            yield self._done(held, counts, own if spans else None)

    def _done(self, held: list, counts: list[int], texts: list[str] | None) -> tuple[np.ndarray, list | None]:
        n = np.array(counts, np.int64)
        p = marginals(np.fromiter((x for h in held for x in h), float, int(n.sum())), n, self.model.chain)
        score = 1 / (1 + np.exp(-np.clip(document_features(p, n) @ self.model.final, -30, 30)))
        if texts is None:
            return score, None
        at = np.cumsum(n) - n
        hot = [np.flatnonzero(p[a : a + c] >= 0.5) for a, c in zip(at, n, strict=True)]
        return score, [places(text, k) if len(k) else [] for text, k in zip(texts, hot, strict=True)]


def places(text: str, hot: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) in text of the words of these numbers, in characters. Words are of the lower-cased text, which may be longer than the text."""
    low = text.lower()
    found = [m.span() for m in WORD.finditer(low)]
    own = [found[k] for k in hot.tolist()]
    if len(low) == len(text):
        return own
    ends = np.cumsum([len(c.lower()) for c in text])
    return [(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b - 1, "right")) + 1) for a, b in own]


def scored(docs: DataFrame, model: Model, spans: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row, and spans (start, end of toxic words, in characters) if asked for.

    Null and empty texts have the score of a document without words. Rows that repeat, and rows of a null or repeated
    doc_id, are each scored; other columns are left out. No rows give none.
    """
    schema = "doc_id long, score double, predicted int" + ", spans array<struct<start:int,end:int>>" * spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            at = 0
            for score, own in scorer.slices(batch.column(1).to_pylist(), spans):
                columns = [batch.column(0).slice(at, len(score)), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
                if spans:
                    columns.append(pa.array([[{"start": a, "end": b} for a, b in s] for s in own], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
                at += len(score)
                yield pa.record_batch(columns, ["doc_id", "score", "predicted", "spans"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mapped(rows, run, schema)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = BYTES) -> Model:
    """A model of docs' labelled rows. Three tasks read the sample, fit a chain each and give it back (the weights that aren't zero, at most SLOTS); the driver fits four weights to what they say."""
    rows = training_rows(docs, labels, sample, most_bytes)

    def fitted(part: int, held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda r: (r[0], r[1], r[3]))
        docs, toxic = prepared([r[2] for r in held], np.array([r[3] == 1 for r in held], bool))
        if toxic.any() and not toxic.all():
            model, seen, y = fit_part(docs, toxic, part)
            at = np.flatnonzero(model.weights)
            values = [part, at.tobytes(), model.weights[at].tobytes(), model.chain.tobytes(), model.bias, seen.tobytes(), y.tobytes()]
        else:
            values = [part, b"", b"", b"", float(len(toxic) > 0 and toxic.all()), b"", b""]
        return pa.record_batch([pa.array([v]) for v in values], ["part", "at", "weights", "chain", "bias", "seen", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(list)
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[part].append(row)
        for part in sorted(held):
            yield fitted(part, held.pop(part))

    thrice = rows.select(F.explode(F.array(*map(F.lit, PARTS))).alias("part"), "h", "mark", "text", "y").repartitionById(len(PARTS), "part")
    schema = "part long, at binary, weights binary, chain binary, bias double, seen binary, y binary"
    found = {r.part: r for r in mapped(thrice, run, schema).collect()}  # three rows
    if len(found) < len(PARTS) or not found[2].chain:
        return constant(np.array([2 in found and found[2].bias == 1.0]))
    whole = found[2]
    model = Model(np.zeros(SLOTS), np.frombuffer(whole.chain).reshape(2, 2), whole.bias, np.zeros(4))
    model.weights[np.frombuffer(whole.at, np.int64)] = np.frombuffer(whole.weights)
    model.final = fit_logistic(np.concatenate([np.frombuffer(found[k].seen).reshape(-1, 4) for k in (0, 1)]), np.concatenate([np.frombuffer(found[k].y) for k in (0, 1)]))
    return model


def kept_rows(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that score less than threshold, in one pass and with all columns as they are, whatever their names."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores = [s for s, _ in scorer.slices(batch.column(at).cast(pa.string()).to_pylist())]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *scores]) < threshold))

    return mapped(docs, run, docs.schema)
