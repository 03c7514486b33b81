"""Rows of packed NumPy arrays: many small records cross a shuffle as one binary value.

A mapper gives rows (part int, blob binary); deal() brings each part to a task of its own.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import release

SCHEMA = "part int, blob binary"
ARROW = pa.schema([("part", pa.int32()), ("blob", pa.binary())])


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    head = struct.pack("<H", len(arrays)) + b"".join(struct.pack("<3sQ", a.dtype.str[1:].encode().ljust(3), a.nbytes) for a in arrays)
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<H", raw)
    at, out = 2 + 11 * n, []
    for i in range(n):
        kind, size = struct.unpack_from("<3sQ", raw, 2 + 11 * i)
        out.append(np.frombuffer(raw, dtype=np.dtype("<" + kind.decode().strip()), count=size // int(kind[1:]), offset=at))
        at += size
    return out


def pack_table(table: pa.Table, level: int = 1) -> bytes:
    """Rows of any columns as one binary value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table.combine_chunks())
    return zstandard.ZstdCompressor(level=level).compress(sink.getvalue().to_pybytes())


def unpack_table(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()


def bundle(*blobs: bytes) -> bytes:
    return struct.pack(f"<H{len(blobs)}Q", len(blobs), *map(len, blobs)) + b"".join(blobs)


def rows(parts: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], schema=ARROW)


def split_by(part: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by part, and the n+1 bounds of the parts in it."""
    kind = np.uint8 if n <= 256 else np.uint16 if n <= 65536 else np.uint32
    part = part.astype(kind)
    return np.argsort(part, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(part, minlength=n)))).astype(np.int64)


def parts_for(df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """Tasks for a shuffle of this input: by the size that the plan states, or the session's number if more."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, -(-size // bytes_each)) if size < 1 << 60 else least


def deal(df: DataFrame, n: int) -> DataFrame:
    """Each part to the task with its number."""
    return df.repartitionById(n, F.col("part"))


def frugal(f: Callable) -> Callable:
    """A mapper that gives its memory back when its task ends."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release()

    return run
