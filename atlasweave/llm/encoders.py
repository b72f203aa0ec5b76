"""Public tokenizers, with the ids of recent words kept in each worker.

Pre-tokenization never joins what white space parts, so a text's ids are those of its chunks, one after another. Chunks
repeat, so each worker remembers the ids of those that it has met: ``CAP`` new ones, and the ``CAP`` before. Texts whose
white space the tokenizer and Python see differently, or that spell a special token, go to the tokenizer whole.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import CACHES

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CAP = 600_000
LONGEST = 64
#: Texts that are encoded at once: so many, or so many characters.
TEXTS, CHARS = 2048, 4_000_000
ODD = re.compile(r"[\x1c-\x1f\x85]|<\|")
#: A word with the one space before it, or a run of white space, as byte-level pre-tokenization parts them.
SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")



def words(text: str) -> str | None:
    """The text with single spaces between its words, or null for an odd one."""
    if "<|" in text:
        return None
    plain = text.replace("\n", " ")
    return plain if plain.isprintable() else None if ODD.search(text) else " ".join(text.split())


def spaced(text: str) -> str | None:
    """The text with a zero character between its chunks (those of SPACED), or null for an odd one.

    Where no two white characters meet and none but spaces and line ends is there, chunks begin at each of these.
    """
    if "<|" in text:
        return None
    if "  " in text or "\n\n" in text or "\n " in text or " \n" in text or not text.replace("\n", "").isprintable():
        return None if "\0" in text or ODD.search(text) else "\0".join(SPACED.findall(text))
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0")


def lowered(word: str) -> str:
    """Lower case, for words in Latin-1, where the tokenizer's is the same."""
    try:
        word.encode("latin-1")
    except UnicodeEncodeError:
        return word
    return word.lower()


#: How texts part: the function, what it puts between chunks, and whether the tokenizer lower-cases.
CHUNKS = {"words": (words, " ", True), "spaced": (spaced, "\0", False)}
#: A mark that may follow a word of letters; pre-tokenization parts it from them.
MARKS = frozenset(",.;:!?")
#: Words of letters that are encoded as one text.
JOINED = 4000


class CachedEncoder:
    def __init__(self, path: str, chunks: str, cap: int | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.cap = Tokenizer.from_file(path), cap or CAP
        (self.chunks, self.between, self.lower), self.spaced = CHUNKS[chunks], chunks == "spaced"
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2") if len(vocabulary) <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        # Where a word of letters begins (its first token has the space) or ends (its last token says so).
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.startswith("Ġ") if self.spaced else t.endswith("</w>"))]] = True
        self.marks = dict(zip(sorted(MARKS), self.whole(sorted(MARKS)), strict=True))
        self.tokenizer.model._resize_cache(0)  # noqa: SLF001  its own cache would only be written: each chunk comes once
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, chunk: str) -> bool:
        """Whether a chunk is one pre-token of letters, in either case, after a space where the tokenizer keeps spaces."""
        if self.spaced:
            return chunk[0] == " " and chunk[1:].isalpha()
        return chunk.isalpha() and (chunk.isascii() or chunk.lower().isalpha())

    def _joined(self, words: list[str]) -> list[bytes]:
        """The ids of plain chunks, encoded as one text and parted where words begin or end."""
        text = "".join(words) if self.spaced else " ".join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        at = np.flatnonzero(self.edge[ids])
        if len(at) != len(words):
            return self.whole(words)
        cuts = ((np.append(at, len(ids)) if self.spaced else np.append(0, at + 1)) * self.dtype.itemsize).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, new: set[str]) -> None:
        """Puts the ids of chunks that aren't known into self.known."""
        known, marks, plain = self.known, self.marks, self._plain
        stems, letters, rest = [], {}, []
        for w in new:
            stem = w[:-1] if w[-1] in MARKS else w
            if not stem or not plain(stem):
                rest.append(w)
                continue
            if stem is not w:
                stems.append((w, stem))
            if stem not in known:
                letters[stem] = None
        found = list(letters)
        for k in range(0, len(found), JOINED):
            known.update(zip(found[k : k + JOINED], self._joined(found[k : k + JOINED]), strict=True))
        for w, stem in stems:
            known[w] = known[stem] + marks[w[-1]]
        if rest:
            known.update(zip(rest, self.whole(rest), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of self.dtype."""
        on = gc.isenabled()
        gc.disable()  # many lists and no cycles: looking for these would take a tenth of the time
        try:
            return self._encode(texts)
        finally:
            if on:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Chunks are parted and made distinct in Arrow; distinct ones are looked up, and ids gathered in numpy."""
        ready = list(map(self.chunks, texts))
        lists = pc.split_pattern(pa.array([x or "" for x in ready], pa.large_string()), self.between)
        offsets = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        ids = self._ids_of(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        begins, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), self.dtype)
        own = sizes[at]
        ends = np.append(0, np.cumsum(own))
        raw = flat[np.repeat(begins[at] - ends[:-1], own) + np.arange(ends[-1])].tobytes()
        cuts = (ends[offsets] * self.dtype.itemsize).tolist()
        return [raw[a:b] if x is not None else self.whole([t])[0] for t, x, a, b in zip(texts, ready, cuts, cuts[1:])]

    def _ids_of(self, chunks: list[str]) -> list[bytes]:
        if len(self.known) > self.cap:
            self.old, self.known = self.known, {"": b""}
        keys = list(map(lowered, chunks)) if self.lower else chunks
        known, old = self.known, self.old
        found = list(map(known.get, keys))
        gaps = [i for i, x in enumerate(found) if x is None]
        new = set()
        for i in gaps:
            w = keys[i]
            x = old.get(w)
            if x is None:
                new.add(w)
            else:
                known[w] = x
        self._learn(new)
        for i in gaps:
            found[i] = known[keys[i]]
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        return found

    def batches(self, texts):
        """encode() over slices of bounded size of an Arrow column of texts; null texts are empty."""
        part, size = [], 0
        for k in range(0, len(texts), 256):
            for x in texts.slice(k, 256).to_pylist():
                part.append(x or "")
                size += len(part[-1])
                if size >= CHARS or len(part) >= TEXTS:
                    yield from self.encode(part)
                    part, size = [], 0
        if part:
            yield from self.encode(part)


@lru_cache(maxsize=4)
def encoder(path: str, chunks: str, cap: int | None = None) -> CachedEncoder:
    """One for each worker process and vocabulary; workers serve many tasks."""
    return CachedEncoder(path, chunks, cap)


CACHES["encoders"] = encoder.cache_clear


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
