"""Chat formatting by columnar byte assembly.

A batch of turns becomes its formatted text without a step per turn: the lengths of
all segments (control strings, roles, texts) give offsets by a cumulative sum, and
every byte is copied to its place in one buffer by an index array. The buffer is the
data of the Arrow column that is returned.

The template: ``### role<turn>text</turn>`` and a line break for each turn. Inside
roles and texts a backslash is doubled, and one is put behind the first character of
each control string, so that none occurs there; whoever reads drops one backslash
before any character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, raw_bytes, slices

OPEN, MIDDLE, CLOSE = b"### ", b"<turn>", b"</turn>\n"
#: What is broken up inside texts: control strings, without the line break that ends a turn.
CONTROLS = (OPEN, MIDDLE, CLOSE.rstrip(b"\n"))
_ESCAPE = 92
_PARTS = "part long, n_turns long, formatted string, loss array<struct<start: long, stop: long>>"
_FIGURES = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def matches(data: np.ndarray, pattern: bytes) -> np.ndarray:
    """Where the bytes of ``pattern`` start in ``data``."""
    at = np.flatnonzero(data[: max(0, len(data) - len(pattern) + 1)] == pattern[0])
    for k, byte in enumerate(pattern[1:], 1):
        at = at[data[at + k] == byte]
    return at


def escaped(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts (bytes and offsets) with backslashes put in."""
    before = [np.flatnonzero(data == _ESCAPE)]
    for control in CONTROLS:
        found = matches(data, control)
        within = found + len(control) <= at[np.searchsorted(at, found, "right")]
        before.append(found[within] + 1)
    before = np.sort(np.concatenate(before))
    if not len(before):
        return data, at
    put = np.zeros(len(data), np.int64)
    put[before] = 1
    out = np.full(len(data) + len(before), _ESCAPE, np.uint8)
    out[np.arange(len(data)) + np.cumsum(put)] = data
    return out, at + np.searchsorted(before, at)


def escapes(data: np.ndarray) -> np.ndarray:
    """Places of the backslashes that stand for nothing themselves: every other one of a run, from its first."""
    at = np.flatnonzero(data == _ESCAPE)
    first = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, at, 0))
    return at[(at - first) % 2 == 0]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then the same for the next ones."""
    return np.repeat(start - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())


def assemble(roles: tuple[np.ndarray, np.ndarray], texts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(formatted bytes, start of each turn and the end, start and end of each text in them)."""
    (role, role_at), (text, text_at) = escaped(*roles), escaped(*texts)
    role_size, text_size = np.diff(role_at), np.diff(text_at)
    size = len(OPEN) + role_size + len(MIDDLE) + text_size + len(CLOSE)
    at = np.append(0, np.cumsum(size))
    role_from = at[:-1] + len(OPEN)
    text_from = role_from + role_size + len(MIDDLE)
    out = np.empty(at[-1], np.uint8)
    for control, place in ((OPEN, at[:-1]), (MIDDLE, role_from + role_size), (CLOSE, text_from + text_size)):
        out[place[:, None] + np.arange(len(control))] = np.frombuffer(control, np.uint8)
    out[_spread(role_from, role_size)] = role
    out[_spread(text_from, text_size)] = text
    return out, at, text_from, text_from + text_size


def _chars(data: np.ndarray) -> np.ndarray:
    """The number of code points before each byte, and of all."""
    return np.append(0, np.cumsum((data & 0xC0) != 0x80))


def format_chat(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(conv_id, part, n_turns, formatted, loss): conversations as formatted text, in parts that follow each other by ``part``.

    A part holds turns of one conversation, up to about 1 MB of text or one turn, so
    that a conversation of any length passes in bounded memory and through several
    tasks; most have one part. ``loss`` has the spans, in code points of the part, of
    the texts of ``loss_role``.

    Turns are ordered by ``turn_col``, and ties by role and text. Defined cases: null
    texts and roles are empty; a null turn comes first; rows with a null conversation
    are one conversation; repeated rows are repeated turns; an empty table gives no
    rows; further columns are left out.
    """
    clean = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Ranges by a digest of the text: bounds are sampled to the driver, and texts can be long.
    keys = ("conv_id", "turn", "role", "mark")
    clean = clean.withColumn("mark", F.xxhash64("text")).repartitionByRange(*keys).sortWithinPartitions(*keys, "text").select("conv_id", "role", "text")

    def run(batches):
        part = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in slices(whole, "text"):
                conv, role = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(), batch.column(1)
                out, at, begin, end = assemble(raw_bytes(role), raw_bytes(batch.column(2)))
                chars = _chars(out)
                first = np.flatnonzero(np.diff(conv, prepend=-2))
                bound = np.append(first, len(conv))
                learn = np.flatnonzero(np.array([r == loss_role for r in role.to_pylist()], bool))
                base = np.repeat(chars[at[first]], np.diff(bound))
                spans = pa.StructArray.from_arrays([pa.array(chars[x[learn]] - base[learn]) for x in (begin, end)], names=["start", "stop"])
                loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(learn, bound), pa.int32()), spans)
                formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(at[bound].astype(np.int32)), pa.py_buffer(out))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first)), pa.array(part + np.arange(len(first))), pa.array(np.diff(bound)), formatted, loss], names=["conv_id", "part", "n_turns", "formatted", "loss"])
                part += len(first)

    return map_batches(clean, run, f"conv_id {clean.schema['conv_id'].dataType.simpleString()}, {_PARTS}")


def turns_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the roles, ends of the roles and ends of the texts of all turns in formatted bytes; ValueError if it is none."""
    start, middle, close = (matches(data, control) for control in (OPEN, MIDDLE, CLOSE))
    if not len(start) == len(middle) == len(close) or (start > middle).any() or (middle > close).any() or (start[1:] != close[:-1] + len(CLOSE)).any() or len(data) != (close[-1] + len(CLOSE) if len(close) else 0):
        raise ValueError("not formatted turns")
    return start + len(OPEN), middle, close


def read_chat(parts: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from the formatted parts alone.

    turns_sha256 is of role, line break, text and line break of each turn, and
    loss_sha256 of what lies under the loss mask, both without escapes. A task sees
    the parts of a conversation one after another and keeps two running digests.
    """
    x = parts.select("conv_id", "part", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "formatted", "loss")
    kind = x.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now, done, open_ = None, [], None
        for whole in batches:
            arrow = whole.schema.field(0).type
            for batch in slices(whole, "formatted"):
                for conv, figures, turn_bytes, loss_bytes in _parts(batch):
                    if open_ is None or conv != now:
                        if open_ is not None:
                            done.append(_closed(now, open_))
                        now, open_ = conv, [0, 0, 0, hashlib.sha256(), hashlib.sha256()]
                    for k, n in enumerate(figures):
                        open_[k] += n
                    open_[3].update(turn_bytes)
                    open_[4].update(loss_bytes)
                if len(done) >= 4096:
                    yield _rows(done, arrow)
                    done = []
        if open_ is not None:
            yield _rows([*done, _closed(now, open_)], arrow)

    return map_batches(x, run, f"conv_id {kind}, {_FIGURES}")


def _closed(conv, state) -> tuple:
    n_turns, loss_chars, chars, turns, loss = state
    return conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars


def _rows(done: list[tuple], arrow: pa.DataType) -> pa.RecordBatch:
    kinds = (arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)


def _parts(batch: pa.RecordBatch):
    """(conversation, (turns, code points under the mask, code points), bytes of the turns, bytes under the mask) of each part."""
    data, at = raw_bytes(batch.column(1))
    role, middle, close = turns_of(data, at)
    keep = np.ones(len(data), bool)
    drop = escapes(data)
    keep[drop] = False
    for place, size in ((role - len(OPEN), len(OPEN)), (middle, len(MIDDLE) - 1), (close, len(CLOSE) - 1)):
        keep[place[:, None] + np.arange(size)] = False
    lined = data.copy()
    lined[middle + len(MIDDLE) - 1] = 10
    turns, turns_at = lined[keep], np.append(0, np.cumsum(keep))[at]
    chars = _chars(data)
    byte_of = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    loss = batch.column(2)
    spans, spans_at = loss.flatten(), np.append(0, np.cumsum(loss.value_lengths().to_numpy(zero_copy_only=False)))
    base = np.repeat(chars[at[:-1]], np.diff(spans_at))
    start, stop = (byte_of[spans.field(k).to_numpy(zero_copy_only=False) + base] for k in range(2))
    # A span may be empty and start where another ends, so marks add up.
    edge = np.bincount(start, minlength=len(data) + 1) - np.bincount(stop, minlength=len(data) + 1)
    under = np.cumsum(edge)[:-1] > 0
    under[drop] = False
    learned, learned_at = data[under], np.append(0, np.cumsum(under))[at]
    learned_chars = np.append(0, np.cumsum((learned & 0xC0) != 0x80))
    n_turns = np.diff(np.searchsorted(close, at))
    for k, conv in enumerate(batch.column(0).to_pylist()):
        a, b = learned_at[k : k + 2]
        figures = int(n_turns[k]), int(learned_chars[b] - learned_chars[a]), int(chars[at[k + 1]] - chars[at[k]])
        yield conv, figures, turns[turns_at[k] : turns_at[k + 1]], learned[a:b]
