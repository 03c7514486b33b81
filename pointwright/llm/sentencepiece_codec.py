"""Operator 8: SentencePiece encoding and decoding that keeps offsets.

Texts are encoded whole by the sentencepiece library. Beside it, CharacterMap reads the
model's compiled character map (a double-array trie with the replacement strings behind it)
and normalises by longest prefix, recording for each normalised byte the source byte it comes
from. Pieces cover the normalised text end to end, so their lengths project every piece onto
a byte span of the original text. A map of size 0 is the identity; where spaces too stay as many
as they are, spans are the running sums of the bytes that the pieces take, without reading the text.

Each row is independent: no shuffle, memory of one step of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .words import steps

MARK = "▁"
SPACE = MARK.encode()


class CharacterMap:
    """The compiled character map of a model: longest-prefix replacement with source alignment."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if size else []
        self.strings = blob[4 + size :] if blob else b""

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that text has at this place, and its replacement."""
        units, found = self.units, None
        if not units:
            return None
        node = self._base(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units) or units[node] & 0x800000FF != text[i]:
                break
            leaf = units[node] >> 8 & 1
            node ^= self._base(units[node])
            if leaf:
                where = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.strings[where : self.strings.index(b"\0", where)]
        return found

    @staticmethod
    def _base(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The replaced text, and for each of its bytes (and its end) the source byte it comes from."""
        if not self.units:
            return text, np.arange(len(text) + 1)
        out, source, at = bytearray(), [], 0
        while at < len(text):
            n, new = self.longest(text, at) or (0, b"")
            if not n:
                n = 1
                while at + n < len(text) and text[at + n] & 0xC0 == 0x80:
                    n += 1
                new = text[at : at + n]
                source.extend(range(at, at + n))
            else:
                source.extend([at] * len(new))
            out += new
            at += n
        return bytes(out), np.array([*source, len(text)])


class Codec:
    """A loaded model. encode() gives ids and, on demand, the byte span of every piece."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.spec = model.normalizer_spec
        self.map = CharacterMap(self.spec.precompiled_charsmap)
        kinds = pb.ModelProto.SentencePiece
        self.lengths = np.array([1 if p.type == kinds.BYTE else -1 if p.type == kinds.UNKNOWN else len(p.piece.encode()) for p in model.pieces], dtype=np.int64)
        self.decimal = [str(i) for i in range(len(self.lengths))]
        self.plain = not self.map.units and not self.spec.remove_extra_whitespaces and self.spec.escape_whitespaces and self.spec.add_dummy_prefix
        #: Bytes of the text that a piece takes, where its marks are spaces; negative for unknown pieces.
        self.taken = self.lengths - np.array([0 if p.type in (kinds.BYTE, kinds.UNKNOWN) else 2 * p.piece.count(MARK) for p in model.pieces], dtype=np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, num_threads=1)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.sp.decode(x) if x else "" for x in ids]

    def aligned(self, text: str) -> tuple[bytes, np.ndarray]:
        """The text as the pieces see it, with dummy prefix and escaped spaces, and its source bytes."""
        body, source = self.map.normalise(text.encode())
        raw = np.frombuffer(body, dtype=np.uint8)
        keep = np.ones(len(raw), dtype=bool)
        if self.spec.remove_extra_whitespaces:
            space = raw == 0x20
            keep = ~(space & np.concatenate(([True], space[:-1])))
            tail = np.flatnonzero(~space)
            keep[(tail[-1] + 1 if len(tail) else 0) :] = False
        prefix = self.spec.add_dummy_prefix and keep.any()
        raw, at = raw[keep], source[:-1][keep]
        wide = np.where((raw == 0x20) & self.spec.escape_whitespaces, 3, 1)
        out = np.repeat(raw, wide)
        spaces = np.flatnonzero(np.repeat((wide == 3), wide))
        out[spaces] = np.tile(np.frombuffer(SPACE, dtype=np.uint8), len(spaces) // 3)
        head = SPACE if prefix else b""
        first = at[:1] if len(at) else source[-1:]
        return head + out.tobytes(), np.concatenate((np.repeat(first, len(head)), np.repeat(at, wide), source[-1:]))

    def bounds(self, text: str, ids: list[int]) -> np.ndarray:
        """Byte span [begin, end) of the original text for each id, a row each; an unknown piece takes one character."""
        seen, source = self.aligned(text)
        lengths = self.lengths[np.asarray(ids, dtype=np.int64)]
        at = done = 0
        for k in np.flatnonzero(lengths < 0).tolist():
            at, n, done = at + int(lengths[done:k].sum()), 1, k
            while at + n < len(seen) and seen[at + n] & 0xC0 == 0x80:
                n += 1
            lengths[k] = n
        ends = np.minimum(np.concatenate(([0], np.cumsum(lengths))), len(seen))
        begin = source[ends[:-1]]
        return np.stack((begin, np.maximum(begin, source[ends[1:]])), axis=1)

    def all_bounds(self, texts: list[str], ids: list[list[int]], flat: np.ndarray) -> Iterator[np.ndarray]:
        """bounds() of texts; flat: their ids end to end."""
        taken, end = self.taken[flat], 0
        for text, some in zip(texts, ids, strict=True):
            here = taken[end : end + len(some)]
            end += len(some)
            if not self.plain or not some or MARK in text or here.min() < 0:
                yield self.bounds(text, some)
                continue
            out = np.empty((len(some), 2), dtype=np.int64)
            np.cumsum(here, out=out[:, 1])
            out[:, 1] -= 1  # the first mark is not in the text
            out[0, 0], out[1:, 0] = 0, out[:-1, 1]
            yield out

    def spans(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """bounds() as pairs."""
        return [(b, e) for b, e in self.bounds(text, ids).tolist()]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One loaded model per worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


OUTPUTS = {
    "n_tokens": (T.LongType(), pa.int64()),
    "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "spans": (T.ArrayType(T.ArrayType(T.LongType())), pa.list_(pa.list_(pa.int64()))),
    "decoded": (T.StringType(), pa.string()),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
    "spans_sha256": (T.StringType(), pa.string()),
}


def encode(df: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("n_tokens", "ids", "spans", "decoded")) -> DataFrame:
    """Rows with the kept columns and the chosen outputs of encoding `text` with the model file.

    outputs: any of n_tokens, ids, spans (begin and end byte of each piece in the text), decoded,
    and the SHA-256 of the comma-joined decimal ids, of the decoded text and of the spans (begin,
    end, begin, .. as little-endian 64-bit integers). Null text counts as
    empty: no ids, decoded "". Repeated rows each give their row; other columns of the input are
    dropped; a kept column may not have an output's name.
    """
    if clash := set(keep) & set(outputs):
        raise ValueError(f"kept columns have names of outputs: {sorted(clash)}")
    df = df.select(*keep, df[text].alias("__text"))
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(c, OUTPUTS[c][0]) for c in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for table in steps(batch, "__text"):
                texts = [t or "" for t in table.column("__text").to_pylist()]
                ids = c.encode(texts)
                sizes = np.array([len(x) for x in ids], dtype=np.int32)
                flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(sizes.sum()))
                made = {"n_tokens": lambda: sizes, "ids": lambda: pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), flat), "spans": lambda: [c.spans(t, x) for t, x in zip(texts, ids, strict=True)]}
                if {"decoded", "decoded_sha256"} & set(outputs):
                    decoded = c.decode(ids)
                    made |= {"decoded": lambda: decoded, "decoded_sha256": lambda: [hashlib.sha256(x.encode()).hexdigest() for x in decoded]}
                made["ids_sha256"] = lambda: [hashlib.sha256(",".join([c.decimal[i] for i in x]).encode()).hexdigest() for x in ids]
                made["spans_sha256"] = lambda: [hashlib.sha256(b.astype("<i8", copy=False)).hexdigest() for b in c.all_bounds(texts, ids, flat)]
                columns = [table.column(k).combine_chunks() for k in keep] + [x if isinstance(x := made[k](), pa.Array) else pa.array(x, OUTPUTS[k][1]) for k in outputs]
                yield from pa.Table.from_arrays(columns, names=[*keep, *outputs]).to_batches()

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows with the kept columns and `decoded`, the text of the id array; null ids count as none."""
    df = df.select(*keep, df[ids].alias("__ids"))
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            texts = c.decode([x or [] for x in batch.column("__ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return df.mapInArrow(run, schema)
