"""Operator 10: document fingerprints from prefix polynomial hashes.

A text is a row of code points c_0 c_1 ...; its prefix array holds P[i] = sum of (c_j + 1) b^j
for j < i, modulo the prime 2^31 - 1, for two bases. The hash of a span is (P[e] - P[s]) b^-s,
so any two spans compare in constant time and the longest common extension of two places is a
binary search. The fingerprint is a whole-text hash and the smallest SKETCH span hashes over
all spans of SPAN code points (a bottom-k sketch): the likeness of two fingerprints estimates
the share of common spans.

Prefix arrays are made for many texts at a time; nothing crosses a shuffle but the texts that
successor() must bring together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packed import parts_for
from .ranges import first_ids, part_of
from .words import U, mix64, steps

P31 = (1 << 31) - 1
BASES = (911382323, 972663749)
SPAN, SKETCH = 16, 64
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mod(x: np.ndarray) -> np.ndarray:
    """Modulo 2^31 - 1 of numbers below 2^62."""
    x = (x & U(P31)) + (x >> U(31))
    x = (x & U(P31)) + (x >> U(31))
    return np.where(x == U(P31), U(0), x)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i < n, by doubling."""
    if base not in _tables or len(_tables[base][0]) < n:
        out = []
        for b in (base, pow(base, -1, P31)):
            a = np.ones(1, dtype=U)
            while len(a) < n:
                a = np.concatenate((a, _mod(a * U(pow(b, len(a), P31)))))
            out.append(a)
        _tables[base] = out[0], out[1]
    return _tables[base][0][:n], _tables[base][1][:n]


class PrefixHashes:
    """Prefix arrays of a row of code points (of one text, or of many end to end)."""

    def __init__(self, points: np.ndarray) -> None:
        self.n = len(points)
        self.sums, self.inverse = [], []
        values = points.astype(U) + U(1)
        for b in BASES:
            up, down = _powers(b, self.n + 1)
            sums = np.zeros(self.n + 1, dtype=U)
            np.cumsum(_mod(values * up[: self.n]), out=sums[1:])
            self.sums.append(_mod(sums))
            self.inverse.append(down)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans [start, end)."""
        a, b = (_mod(_mod(s[end] + U(P31) - s[start]) * inv[start]) for s, inv in zip(self.sums, self.inverse, strict=True))
        return a << U(31) | b

    def equal(self, i: int, j: int, length: int) -> bool:
        """Are the spans of this length at i and j the same (but for a hash collision)?"""
        h = self.spans(np.array([i, j]), np.array([i + length, j + length]))
        return bool(h[0] == h[1])

    def common_extension(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Longest common extension of each pair of places, up to `most`, by binary search."""
        low, high = np.zeros(len(i), dtype=np.int64), np.asarray(most, dtype=np.int64).copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.spans(i, i + mid) == self.spans(j, j + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points end to end, and the n+1 offsets."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    off = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
    return (np.concatenate(raw) if raw else np.zeros(0, dtype="<u4")), off


def sketches(h: PrefixHashes, off: np.ndarray, span: int = SPAN, size: int = SKETCH) -> tuple[np.ndarray, list[np.ndarray]]:
    """Whole-text hashes, and for each text its `size` smallest span hashes (all, if fewer), ascending."""
    lengths = np.diff(off)
    whole = mix64(h.spans(off[:-1], off[1:]) ^ mix64(lengths.astype(U)))
    if h.n >= span:
        at = np.arange(h.n - span + 1)
        each = mix64(h.spans(at, at + span)) >> U(2)
    out = []
    for a, b, w in zip(off[:-1].tolist(), off[1:].tolist(), whole, strict=True):
        if b - a < span:
            out.append(np.array([w >> U(2)]) if b > a else np.zeros(0, dtype=U))
            continue
        mine = each[a : b - span + 1]
        few = mine
        kth = 2 * size
        while True:  # repeated spans count once
            few = np.unique(np.partition(mine, kth)[: kth + 1] if kth < len(mine) - 1 else mine)
            if len(few) >= size or kth >= len(mine) - 1:
                break
            kth *= 8
        out.append(few[:size])
    return whole, out


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Estimated share of common spans among the spans of either: 1 for equal sketches, 0 for disjoint ones."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    both = np.concatenate((a, b))
    both.sort()
    common = both[1:][both[1:] == both[:-1]]
    union = np.unique(both)[:size]
    return float(np.count_nonzero(common <= union[-1]) / len(union))


def as_text(whole: int, sketch: np.ndarray) -> str:
    """The fingerprint as a string: the whole-text hash, a colon, and the leading 32 bits of each sketch value."""
    return f"{int(whole):016x}:" + (sketch >> U(30)).astype(">u4").tobytes().hex()


def fingerprint(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), span: int = SPAN, size: int = SKETCH) -> DataFrame:
    """Kept columns, n_chars, and `fingerprint`. Null text counts as empty; row-local, no shuffle."""
    df = df.select(*keep, df[text].alias("__text"))
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table in steps(batch, "__text", 1 << 20):
                points, off = points_of([t or "" for t in table.column("__text").to_pylist()])
                prints = [as_text(w, s) for w, s in zip(*sketches(PrefixHashes(points), off, span, size), strict=True)]
                columns = [table.column(k).combine_chunks() for k in keep] + [pa.array(np.diff(off)), pa.array(prints, pa.string())]
                yield from pa.Table.from_arrays(columns, names=[*keep, "n_chars", "fingerprint"]).to_batches()

    return df.mapInArrow(run, schema)


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text: str = "text", edit: str = "half") -> DataFrame:
    """Each text's fingerprint against that of its edited text and of the next document's text.

    The next document is the next larger id (rows of one id in the order of their text's hash),
    after the last one the first. The edited text has its last floor(n/2) code points replaced by
    the first as many (or all) of the next text. common_prefix is the longest common extension of
    the text and the edited text at their starts. Rows with a null id are not returned; null text
    counts as empty; one row per row otherwise; a lone row is its own successor.

    Texts are dealt by ranges of the id, whose bounds are taken from the id column alone; the
    first row of each range is sent to the range before it. No task holds more than its range.
    """
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = parts_for(df)
    firsts = first_ids(docs, "doc_id", n)  # a number per task
    if not firsts:
        return df.sparkSession.createDataFrame([], COMPARED)
    before = {first: (i - 1) % len(firsts) for i, first in enumerate(firsts)}
    spark = df.sparkSession
    heads = spark.createDataFrame(list(before.items()), "doc_id long, before int")
    own = docs.withColumn("part", part_of(docs, F.col("doc_id"), firsts))
    after = docs.join(F.broadcast(heads), "doc_id").select("doc_id", "text", F.col("before").alias("part"), F.lit(True).alias("after"))
    dealt = own.withColumn("after", F.lit(False)).unionByName(after).repartitionById(len(firsts), F.col("part"))
    dealt = dealt.sortWithinPartitions("after", "doc_id", F.xxhash64("text")).select("doc_id", "text", "after")

    def emit(ids: list[int], texts: list[str], following: list[str]) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, following, strict=True)]
        m = len(texts)
        points, off = points_of(texts + following[-1:] + edited)
        h = PrefixHashes(points)
        whole, sk = sketches(h, off)
        mine, theirs = sk[: m + 1], sk[m + 1 :]
        lengths = np.diff(off)
        prefix = h.common_extension(off[:m], off[m + 1 : -1], np.minimum(lengths[:m], lengths[m + 1 :]))
        columns = [
            pa.array(ids, pa.int64()), pa.array(lengths[:m]), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array([as_text(w, s) for w, s in zip(whole[:m], mine, strict=False)], pa.string()), pa.array([as_text(w, s) for w, s in zip(whole[m + 1 :], theirs, strict=True)], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(mine, theirs, strict=False)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(mine, mine[1:], strict=False)], pa.float64()), pa.array(prefix),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, str] | None = None
        for batch in batches:
            for table in steps(batch, "text", 1 << 20):
                ids, texts, tail = (table.column(c).to_pylist() for c in ("doc_id", "text", "after"))
                rows = list(zip(ids, texts, strict=True))
                own = tail.index(True) if True in tail else len(tail)
                line = ([held] if held else []) + rows[:own]
                if own < len(tail):  # the row after this range: the last own row has its successor
                    if line:
                        yield emit([i for i, _ in line], [t for _, t in line], [t for _, t in line[1:]] + [rows[own][1]])
                    return
                if len(line) > 1:
                    yield emit([i for i, _ in line[:-1]], [t for _, t in line[:-1]], [t for _, t in line[1:]])
                held = line[-1] if line else held

    return dealt.mapInArrow(run, COMPARED)
