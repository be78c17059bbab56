"""SentencePiece encoding with byte offsets into the original text, and decoding.

Normalisation is done here: the longest prefix found in the compiled character map
is replaced, and each byte it writes remembers the source bytes it stands for. The
library then only merges symbols, on a copy of the model that does not normalise.
The lengths of the pieces walk through the recorded alignment, which gives every
piece its span of original bytes.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices

BLANK = "▁"
_BLANK = BLANK.encode()
#: Distinct segments that a task remembers before it starts anew; longer segments than KEY characters are not kept.
CACHE, KEY = 60_000, 48


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 and the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes read, replacement) of the longest key that starts at ``at``."""
        if not self.units:
            return None
        jump = lambda u: (u >> 10) << ((u & 512) >> 6)
        node, found = jump(self.units[0]), None
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(self.units) or (unit := self.units[node]) & 0x800000FF != text[k]:
                break
            node ^= jump(unit)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = (k + 1 - at, self.replacements[value : self.replacements.index(b"\0", value)])
        return found


class Codec:
    """A model file, opened once in each Python worker."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.eos, self.unk = proto.trainer_spec.eos_id, proto.trainer_spec.unk_id
        self.decoder = sentencepiece.SentencePieceProcessor(model_file=path)
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        if any(p.type == p.USER_DEFINED for p in proto.pieces):
            raise ValueError("models with user-defined symbols are not supported")
        self.lengths = np.array([{p.BYTE: 1, p.CONTROL: 0, p.UNKNOWN: -1}.get(p.type, len(p.piece.encode())) for p in proto.pieces], np.int64)
        # No merge crosses a place that no piece spans, so segments between such places are independent.
        normal = [p.piece for p in proto.pieces if p.type == p.NORMAL]
        if any(BLANK in p.lstrip(BLANK) for p in normal):
            self.segments = None
        elif proto.trainer_spec.byte_fallback and not any("\n" in p for p in normal):
            self.segments = re.compile(f"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+")
        else:
            self.segments = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
        self.known: dict[str, list[int]] = {}

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(normalised bytes, begin, end): output byte i stands for source bytes begin[i] to end[i]."""
        blank = _BLANK if self.escape else b" "
        if not self.map.units and not self.squeeze and not self.suffix:
            if not text:
                return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
            wide = np.ones(len(text), np.int64)
            wide[np.frombuffer(text, np.uint8) == 32] = len(blank)
            begin = np.repeat(np.arange(len(text)), wide)
            out, end = text.replace(b" ", blank), begin + 1
            if self.prefix:
                out, begin, end = blank + out, np.append(np.zeros(len(blank), np.int64), begin), np.append(np.zeros(len(blank), np.int64), end)
            return out, begin, end
        pieces, at = [], 0
        while at < len(text):
            read, put = self.map.longest(text, at) or (0, b"")
            if not read:
                read = 1
                while at + read < len(text) and text[at + read] & 0xC0 == 0x80:
                    read += 1
                put = text[at : at + read]
            pieces.append((put, at, at + read))
            at += read
        if self.squeeze:
            while pieces and not pieces[0][0].strip(b" "):
                pieces.pop(0)
        marked, after = [], self.squeeze
        for put, a, b in pieces:
            if self.squeeze and after:
                put = put.lstrip(b" ")
            if put:
                after = put.endswith(b" ")
                marked.append((put.replace(b" ", blank), a, b))
        if self.squeeze:
            while marked and marked[-1][0].endswith(blank):
                put, a, b = marked.pop()
                if put := put[: -len(blank)]:
                    marked.append((put, a, b))
        if marked and self.prefix:
            spot = marked[-1][2] if self.suffix else marked[0][1]
            marked.insert(len(marked) if self.suffix else 0, (blank, spot, spot))
        count = [len(put) for put, _, _ in marked]
        return b"".join(put for put, _, _ in marked), *(np.repeat(np.array([m[k] for m in marked], np.int64), count) for k in (1, 2))

    def merge(self, segment: str) -> list[int]:
        if (ids := self.known.get(segment)) is None:
            ids = self.merger.encode(segment, num_threads=1)
            if len(segment) <= KEY:
                if len(self.known) >= CACHE:
                    self.known.clear()
                self.known[segment] = ids
        return ids

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids with the end id, begin, end): the pieces of a text and their spans of its bytes."""
        flat, begin, end = self.normalise(text)
        parts = self.segments.findall(flat.decode()) if self.segments else [flat.decode()] * bool(flat)
        known = self.known
        ids = np.fromiter(chain.from_iterable([known.get(p) or self.merge(p) for p in parts]), np.int32)
        size = self.lengths[ids]
        if (size < 0).any():
            size = np.array([len(piece.piece.encode()) for p in parts for piece in self.merger.encode(p, out_type="immutable_proto").pieces], np.int64)
        stop = np.cumsum(size)
        if len(stop) and stop[-1] != len(flat) or not len(stop) and flat:
            raise AssertionError("pieces do not tile the normalised text")
        ids = np.append(ids, np.int32(self.eos))
        first = begin[stop - size] if len(stop) else stop
        last = end[stop - 1] if len(stop) else stop
        return ids, np.append(first, len(text)).astype(np.int32), np.append(last, len(text)).astype(np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return self.decoder.decode(ids.tolist()) if len(ids) else ""


def encode(df: DataFrame, model: str, text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """``df`` without its text, with ids, begins and ends (arrays of int) of each whole text.

    ids end with the end id. Piece k stands for the bytes begins[k] to ends[k] of
    the text in UTF-8; the end id and a dummy prefix have empty spans. A null text is empty: its only
    id is the end id. With ``decoded``, a column of that name, which may be that of
    the text, holds what the ids decode to: the same as ``decode`` gives, by the
    same Python worker. Columns of these names in ``df`` are replaced. ``model`` is
    a path that every executor can open.
    """
    made = ("ids", "begins", "ends")
    back = [decoded] if decoded else []
    rest = [f for f in df.schema if f.name != text_col and f.name not in (*made, *back)]
    df = df.select(*(f"`{f.name}`" for f in rest), f"`{text_col}`")

    def run(batches):
        codec = Codec(model)
        for whole in batches:
            for batch in slices(whole, text_col):
                found = [codec.encode((t or "").encode()) for t in batch.column(text_col).to_pylist()]
                cut = pa.array(np.append(0, np.cumsum([len(x[0]) for x in found])).astype(np.int32))
                arrays = [pa.ListArray.from_arrays(cut, pa.array(np.concatenate([x[k] for x in found]))) for k in range(3)]
                if back:
                    arrays.append(pa.array([codec.decode(x[0]) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), *arrays], names=[*(f.name for f in rest), *made, *back])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"{c} array<int>" for c in made] + [f"`{c}` string" for c in back])
    return map_batches(df, run, schema)


def decode(df: DataFrame, model: str, ids_col: str = "ids", out: str = "decoded", keep_ids: bool = False) -> DataFrame:
    """``df`` with the text that its ids decode to, and with the ids only if asked. Null ids decode to an empty text."""
    df = df.drop(out)
    rest = [f for f in df.schema if f.name != ids_col or keep_ids]

    def run(batches):
        codec = Codec(model)
        for batch in batches:
            ids = batch.column(ids_col)
            texts = [codec.decode(np.asarray(ids[k].values)) if ids[k].is_valid else "" for k in range(len(ids))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(texts, pa.string())], names=[*(f.name for f in rest), out])

    return map_batches(df, run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"`{out}` string"]))


def ids_digest(ids: str = "ids"):
    """SHA-256 of the decimal ids, joined by one space."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), " ").cast("binary"), 256)
