"""Encoding and decoding with a SentencePiece BPE model, by a merge-type prefix table.

For each prefix of a text the BPE encoding's last token is unique, and the encoding of the prefix before that token is
the encoding of that shorter prefix. So one pass can store the last token of every prefix: of the pieces that end there
(matches of an automaton over the vocabulary), it is the one that may follow the last token of the prefix before it. Two
tokens may stand side by side if merging their joined text gives just these two, which is found by taking both apart
again in order of rank. Ids are then read backwards from the last prefix.

Ranks are the model's scores (all pieces are merges of any pair that spells them). Characters without a piece stand
alone and fall back to bytes. No piece has a space sign after another character, so texts part before each run of space
signs, and each worker keeps the ids of parts that it has met.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, mapped

SPACE = "▁"
CAP, LONGEST = 1_000_000, 64
PART = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
TEXTS, CHARS = 512, 2_000_000


class PrefixTable:
    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.ids = {m.id_to_piece(i): i for i in plain}
        self.rank = {p: -m.get_score(i) for p, i in self.ids.items() if len(p) > 1}
        self.text = {i: p for p, i in self.ids.items()}
        self.byte = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space sign after another character")
        self.halves = self._halves()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) == 1 or p in self.halves:  # other pieces are never the result of merges
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()

    def _merged(self, text: str) -> list[str]:
        """BPE as defined: merge the pair of best rank, the leftmost of equals, until no pair spells a piece."""
        parts = list(text)
        while True:
            best = min(((self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def _halves(self) -> dict[str, tuple[str, str]]:
        """For each piece that BPE can reach, the two tokens of its last merge."""
        out = {}
        for p in self.rank:
            parts = list(p)
            while len(parts) > 2:
                best = min(((self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            if len(parts) == 2:
                out[p] = (parts[0], parts[1])
        return out

    def compatible(self, left: str, right: str) -> bool:
        """Whether left and right stay apart when BPE merges their joined characters."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > CAP:
                self.pairs.clear()
            found = self.pairs[key] = self._merged(left + right) == [left, right]
        return found

    def tokens(self, text: str) -> list[str]:
        """The tokens of a text without looking it up."""
        last: list[str] = []
        pairs, compatible = self.pairs, self.compatible
        for end, piece in self.automaton.iter(text):  # of pieces with one end the longest first
            n = len(last)
            if end < n:
                continue
            while n < end:  # no piece ends there, so the character stands alone
                last.append(text[n])
                n += 1
            before = end - len(piece)
            if before < 0:
                last.append(piece)
                continue
            key = (last[before], piece)
            if (pairs[key] if key in pairs else compatible(*key)):
                last.append(piece)
        last += text[len(last) :]
        out, i = [], len(text) - 1
        while i >= 0:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    def _ids(self, part: str) -> tuple[int, ...]:
        if part in self.halves:
            return (self.ids[part],)
        out: list[int] = []
        for token in self.tokens(part):
            own = self.ids.get(token)
            out += [own] if own is not None else [self.byte[b] for b in token.encode()]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """The ids of a text. The model's normalization is identity, with a space sign put before a text that isn't empty."""
        if not text:
            return []
        parts = PART.findall(SPACE + text.replace(" ", SPACE))
        found = list(map(self.known.get, parts))
        if None in found:
            if len(self.known) > CAP:
                self.known.clear()
            for k, own in enumerate(found):
                if own is None:
                    found[k] = self.known.get(parts[k]) or self._ids(parts[k])
                    if len(parts[k]) <= LONGEST:
                        self.known[parts[k]] = found[k]
        return list(chain.from_iterable(found))


@lru_cache(maxsize=2)
def prefix_table(model_file: str) -> PrefixTable:
    return PrefixTable(model_file)


CACHES["piece"] = prefix_table.cache_clear


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text. Null and empty texts have no ids; rows that repeat, each its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(model_file)
        for batch in batches:
            for rows in _slices(batch):
                ids = [table.encode(x or "") for x in rows.column(1).to_pylist()]
                yield pa.record_batch([rows.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return mapped(_texts(docs, id_col, text_col), run, "doc_id long, ids array<int>", "piece")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id and text of ids, by the library's decode."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = prefix_table(model_file).model
        for batch in batches:
            texts = [model.decode(x) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return mapped(encoded.select("doc_id", "ids"), run, "doc_id long, text string", "piece")


def digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text's ids and of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(model_file)
        for batch in batches:
            for rows in _slices(batch):
                sizes, hashes, decoded = [], [], []
                for x in rows.column(1).to_pylist():
                    ids = table.encode(x or "")
                    sizes.append(len(ids))
                    hashes.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256((table.model.decode(ids) if ids else "").encode()).hexdigest())
                yield pa.record_batch([rows.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(_texts(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "piece")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, few enough that their ids stay small."""
    for k in range(0, batch.num_rows, TEXTS):
        yield batch.slice(k, TEXTS)
