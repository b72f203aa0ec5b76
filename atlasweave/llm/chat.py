"""Chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Control strings begin with ``<|im_``; inside a role or text,
``<``, some backslashes and ``|im_`` get one backslash more, and reading takes it away again, so nothing in a text can
end or begin a turn. (Roles also escape backslash and newline.)

A batch of turns is put together in numpy: the lengths of all segments (fixed headers, roles, texts, ends), their
cumulative offsets, and scatter indices that copy each column's bytes to their places in one preallocated buffer, which
becomes an Arrow column of conversations without further copies. Offsets of assistant texts become the loss mask.

Turns are sorted within the tasks that conversations are dealt to, and a task holds one batch at a time: a conversation
of more than ``HELD`` bytes gets several rows (part 0, 1, ...), each formatted as it comes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

START, BETWEEN, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
LOSS_ROLE = "assistant"
HELD = 16_000_000
FORMATTED = "conv_id long, part int, n_turns long, formatted string, loss array<struct<start:long,end:long>>"
FORMATTED_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|im_", r"<\1\\|im_")


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|im_", r"<\1|im_", text)


def escaped_role(roles: pa.Array) -> pa.Array:
    plain = pc.replace_substring(roles, "\\", "\\\\")
    return escaped(pc.replace_substring(plain, "\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescaped(role))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the lengths of its values."""
    column = pa.concat_arrays([column.cast(pa.large_string())])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return flat, np.diff(offsets)


def assemble(conv: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, offsets of conversations, byte places where each turn's text begins, and ends).

    conv: for each turn the index of its conversation, rising from 0 without gaps.
    """
    columns = [(START, None), (None, _bytes(escaped_role(roles))), (BETWEEN, None), (None, _bytes(escaped(texts))), (END, None)]
    n = len(conv)
    lengths = np.stack([np.full(n, len(fixed)) if fixed else own[1] for fixed, own in columns], 1).astype(np.int64)
    ends = np.cumsum(lengths.ravel()).reshape(n, -1)
    begins = ends - lengths
    buffer = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, (fixed, own) in enumerate(columns):
        if fixed:
            buffer[(begins[:, k, None] + np.arange(len(fixed))).ravel()] = np.tile(np.frombuffer(fixed, np.uint8), n)
        else:
            flat, sizes = own
            buffer[np.arange(len(flat)) + np.repeat(begins[:, k] - (np.cumsum(sizes) - sizes), sizes)] = flat
    last = np.flatnonzero(np.append(conv[1:] != conv[:-1], True)) if n else np.zeros(0, np.int64)
    return buffer, np.concatenate([[0], ends[last, -1]]).astype(np.int64), begins[:, 3], ends[:, 3]


def _formatted(held: pa.Table, part: int) -> pa.RecordBatch:
    """held: conv_id, role, text, sorted; part: that of its first conversation (others begin at 0)."""
    ids = held["conv_id"].combine_chunks()
    roles, texts = (pc.fill_null(held[c].combine_chunks(), "") for c in ("role", "text"))
    conv = np.cumsum(np.append(False, _changes(ids)))
    buffer, offsets, begins, ends = assemble(conv, roles, texts)
    # Places in characters: bytes that begin a character, counted up to each place.
    before = np.append(0, np.cumsum((buffer & 0xC0) != 0x80))
    turns = np.bincount(conv)
    first = np.cumsum(turns) - turns
    loss = pc.equal(roles, LOSS_ROLE).to_numpy(zero_copy_only=False)
    base = before[offsets[conv]]
    spans = pa.StructArray.from_arrays([pa.array((before[x] - base)[loss]) for x in (begins, ends)], ["start", "end"])
    n_loss = np.append(0, np.cumsum(np.bincount(conv[loss], minlength=len(first)))).astype(np.int32)
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(buffer)).cast(pa.string())
    parts = np.zeros(len(first), np.int32)
    parts[0] = part
    return pa.record_batch([ids.take(pa.array(first)), pa.array(parts), pa.array(turns), formatted, pa.ListArray.from_arrays(pa.array(n_loss), spans)], schema=FORMATTED_ARROW)


def _changes(ids: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal to each other."""
    filled, none = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
    return (filled[1:] != filled[:-1]) | (none[1:] != none[:-1])


def _format_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations as they end; of one that has HELD bytes or more, what there is so far, as one part."""
    rest, part, open_id = None, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = pa.concat_tables([rest, now]) if rest is not None else now
        ids = held["conv_id"].combine_chunks()
        if open_id is None or ids[0].as_py() != open_id[0]:
            part = 0
        changes = np.flatnonzero(_changes(ids))
        if len(changes):
            yield _formatted(held.slice(0, changes[-1] + 1), part)
            held, part = held.slice(changes[-1] + 1), 0
        open_id, rest = (ids[-1].as_py(),), held
        if held.nbytes >= HELD:
            yield _formatted(held, part)
            rest, part = None, part + 1
    if rest is not None:
        yield _formatted(rest, part)


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, formatted, and loss (places in characters of formatted) of every conversation.

    turns: conv_id, turn, role, text. Null roles and texts are empty; rows with a null conv_id are one conversation; a
    null turn comes first; rows with one turn are ordered by role, then text. No rows: none. Rows of one conversation
    come in order of part, one after another.
    """
    rows = turns.select(F.col("conv_id").cast("long"), "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return mapped(ordered.select("conv_id", "role", "text"), _format_sorted, FORMATTED)


TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def turns_of(text: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted text."""
    return [(unescaped_role(m[1]), unescaped(m[2])) for m in TURN.finditer(text)]


class _Digest:
    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.n_turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, spans: list[dict]) -> None:
        self.chars += len(text)
        for role, said in turns_of(text):
            self.n_turns += 1
            self.turns.update(f"{role}\n{said}\n".encode())
        for span in spans:
            said = unescaped(text[span["start"] : span["end"]])
            self.loss_chars += len(said)
            self.loss.update(said.encode())

    def row(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def rows(done: list[_Digest]) -> pa.RecordBatch:
        columns = zip(*(d.row() for d in done), strict=True) if done else [[]] * 6
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    now: _Digest | None = None
    for batch in batches:
        done = []
        ids, parts, texts, spans = (batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "part", "formatted", "loss"))
        for k in range(batch.num_rows):
            if parts[k].as_py() == 0:
                if now:
                    done.append(now)
                now = _Digest(ids[k].as_py())
            now.add(texts[k].as_py(), spans[k].as_py())
        yield rows(done)
    if now:
        yield rows([now])


def digests(conversations: DataFrame) -> DataFrame:
    """What formatted() made, read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A conversation's parts follow each other in one task, so its digests are streams and hold no texts.
    """
    return mapped(conversations, _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
