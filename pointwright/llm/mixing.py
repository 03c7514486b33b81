"""Operator 5: a mix of sources at target weights, in blocks of words.

Sources in code-point order (null last) take the weights in turn and share SHARE of all words
by weight; no target passes CAP times its source, and what is above is shared again.

Each source is one row of words: its documents in the order of a hash of the id, with word
offsets from two-level prefix sums (over ranges of the hash, then inside a range), so a source of
any share of the rows is many tasks and the row does not depend on how many. The row is cut into
blocks of BLOCK words. Every output shard draws a multinomial count of slots per source, on the
executors, by a seed of its own. A source's drawn slots are numbered through the shards; of a
source with more than its quota those that a permutation numbers past the quota are passed on to
the sources that miss theirs, so totals meet the targets to a block. Slot t of a source is block
perm(t mod blocks) of pass t div blocks, where perm is a keyed Feistel permutation per source
and pass. Slots and blocks join on (source, block), whose keys are as even as the permutation: no
source is a hot key. The driver holds a row for each source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packed import parts_for
from .substring_dedup import join_words, ranges
from .words import U, Words, mix64, steps
from .work import written

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
BLOCK, SHARD_SLOTS, MAX_SHARDS, SEED = 32, 1 << 14, 100_000, 20240501
#: The table of sources is held by the driver; more than so many sources are refused.
MAX_SOURCES = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """Words to take from each source: shares by weight, none above cap times its size."""
    out: list[float | None] = [None] * len(sizes)
    rest = share * sum(sizes)
    while True:
        free = [i for i, t in enumerate(out) if t is None]
        total = sum(weights[i % len(weights)] for i in free)
        over = [i for i in free if rest * weights[i % len(weights)] / total > cap * sizes[i]]
        if not over:
            break
        for i in over:
            out[i] = cap * sizes[i]
        rest -= sum(cap * sizes[i] for i in over)
    return [rest * weights[i % len(weights)] / total if t is None else t for i, t in enumerate(out)]


def quotas(sizes: np.ndarray, want: np.ndarray, block: int, cap: float) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each source, and the slots whose words come nearest to its target."""
    blocks = -(-sizes // block)
    mean = np.where(blocks > 0, sizes / np.maximum(blocks, 1), 1)
    return blocks, np.minimum(np.floor(want / mean + 0.5).astype(np.int64), np.floor(cap * blocks).astype(np.int64))


def shards_of(total: int) -> tuple[int, int]:
    """How many output shards there are, and the slots of each but the last."""
    per = max(SHARD_SLOTS, -(-total // MAX_SHARDS))
    return -(-total // per), per


def drawn(shard: int, slots: np.ndarray, seed: int) -> np.ndarray:
    """A shard's multinomial draw of slots by source."""
    total = int(slots.sum())
    shards, per = shards_of(total)
    rng = np.random.Generator(np.random.PCG64([seed, shard]))
    return rng.multinomial(per if shard + 1 < shards else total - per * (shards - 1), slots / total)


class Corrected:
    """Drawn slots of sources brought to their quotas: those past a quota become slots of sources that miss theirs."""

    def __init__(self, found: np.ndarray, quota: np.ndarray, seed: int) -> None:
        self.found, self.quota, self.seed = found, quota, seed
        self.over = np.concatenate(([0], np.cumsum(np.maximum(found - quota, 0))))
        self.under = np.concatenate(([0], np.cumsum(np.maximum(quota - found, 0))))

    def place(self, sid: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The source and the slot that the drawn slots `number` of source sid come to be."""
        if self.found[sid] <= self.quota[sid]:
            return np.full(len(number), sid, dtype=np.int32), number
        t = permuted(number, int(self.found[sid]), -1 - self.seed - sid)
        out = np.full(len(number), sid, dtype=np.int32)
        past = np.flatnonzero(t >= self.quota[sid])
        u = self.over[sid] + t[past] - self.quota[sid]
        to = np.searchsorted(self.under, u, "right") - 1
        out[past], t[past] = to, self.found[to] + u - self.under[to]
        return out, t


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..size-1 at these places: four Feistel rounds, walked until inside."""
    half = max(1, (int(size - 1).bit_length() + 1) // 2)
    mask = U((1 << half) - 1)
    x = index.astype(U)
    todo = np.arange(len(x))
    while len(todo):
        a, b = x[todo] >> U(half), x[todo] & mask
        for r in range(4):
            a, b = b, a ^ (mix64(b ^ mix64(np.array([key * 4 + r], dtype=np.int64).view(U))) & mask)
        x[todo] = a << U(half) | b
        todo = todo[x[todo] >= U(size)]
    return x.astype(np.int64)


class Mix:
    """The plan of a mix: sized rows with their sources, and the table of taken pieces."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = SEED) -> None:
        spark, n = df.sparkSession, parts_for(df)
        sized = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col(text)).alias("th"))
        # the order is by 63 bits of the hash; chunks are ranges of it, so their number does not change the order
        sized = sized.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
        sized = written(sized.withColumn("chunk", F.shiftright("h", 63 - max(1, (n - 1).bit_length())).cast("int")), "sizes")
        chunks = sized.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
        found = chunks.groupBy("source").agg(F.sum("words").alias("words")).limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        found.sort(key=lambda r: (r.source is None, r.source or ""))
        sizes = [r.words for r in found]
        want = targets(sizes, weights, share, cap) if sum(sizes) else [0.0] * len(sizes)
        blocks, slots = quotas(np.array(sizes, dtype=np.int64), np.array(want), block, cap)
        table = [(r.source, i, sizes[i], float(want[i])) for i, r in enumerate(found)]
        self.sources = spark.createDataFrame(table, "source string, sid int, source_size long, target double")
        base = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        bases = chunks.withColumn("base", F.coalesce(F.sum("words").over(base), F.lit(0))).join(F.broadcast(self.sources), F.col("words").isNotNull() & chunks["source"].eqNullSafe(self.sources["source"])).select("sid", "chunk", "base", "source_size", "target")
        inside = Window.partitionBy("sid", "chunk").orderBy("h", "doc_id", "th").rowsBetween(Window.unboundedPreceding, -1)
        known = sized.join(F.broadcast(self.sources.select(F.col("source").alias("s"), "sid")), sized["source"].eqNullSafe(F.col("s"))).select("doc_id", "size", "th", "h", "chunk", "sid")
        self.rows = written(known.join(bases, ["sid", "chunk"]).withColumn("at", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))).select("doc_id", "th", "size", "sid", "source_size", "target", "at"), "rows")
        pieces = self.rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
        pieces = pieces.select("sid", "block", "at", (F.greatest(F.col("block") * block, "at") - F.col("at")).alias("start"), F.least(F.col("block") * block + block, F.col("at") + F.col("size")).alias("end")).withColumn("words", F.col("end") - F.col("at") - F.col("start")).drop("end")
        total = int(slots.sum())
        shards = shards_of(total)[0] if total else 0

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column("id").to_pylist():
                    counts = drawn(shard, slots, seed)
                    some = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), shard)), pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["shard", "sid", "count"])

        draws = spark.range(0, shards, 1, max(1, min(n, shards))).mapInArrow(draw, "shard long, sid int, count long")
        seen = np.zeros(len(sizes), dtype=np.int64)
        for r in draws.groupBy("sid").agg(F.sum("count").alias("c")).collect():
            seen[r.sid] = r.c
        corrected = Corrected(seen, slots, seed)
        before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        plan = draws.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0)))

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    sid, t = corrected.place(r["sid"], np.arange(r["first"], r["first"] + r["count"]))
                    lap, place = t // blocks[sid], np.empty(len(t), dtype=np.int64)
                    kind = np.stack((sid, lap))
                    for i, e in np.unique(kind, axis=1).T.tolist():
                        at = np.flatnonzero((sid == i) & (lap == e))
                        place[at] = permuted(t[at] % blocks[i], int(blocks[i]), seed + 1_000_003 * i + e)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), r["shard"])), pa.array(sid), pa.array(t), pa.array(lap), pa.array(place)], names=["shard", "sid", "slot", "lap", "block"])

        runs = plan.repartition(max(1, min(n, shards * len(sizes))), "shard", "sid")
        self.slots = runs.mapInArrow(number, "shard long, sid int, slot long, lap long, block long")
        self.taken = self.slots.hint("merge").join(pieces.hint("merge"), ["sid", "block"])  # both are far larger than the tables they come from


def mix(df: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words that the mix takes, repeats counted) of every row.

    A null text has size 0; a null source is a source of its own, the last; a null id is kept.
    Repeated rows each have their words. A document is taken at most ceil(cap) times over. An
    empty table gives no rows; other columns are ignored.
    """
    m = Mix(df, **options)
    words = m.taken.groupBy("sid", "at").agg(F.sum("words").alias("w"))
    filled = m.rows.where("size > 0").join(words, ["sid", "at"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("w", F.lit(0)).cast("long").alias("taken"), "sid")
    empty = m.rows.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), "sid")
    return filled.unionAll(empty).join(F.broadcast(m.sources.select("sid", "source")), "sid").select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_texts(df: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of df that the mix takes words of, with `text` replaced by those words.

    Words stand in the order of their pass and then of the document, joined by one space, so a row
    has exactly the words that mix() counts as taken. Rows without taken words are not in the mix
    and are not returned. Rows are told apart by id and text; a null id is a row like any other.
    """
    m = Mix(df, id_col, text, **options)
    per_row = m.taken.groupBy("sid", "at").agg(F.array_sort(F.collect_list(F.struct("lap", "start", "words"))).alias("__pieces"))
    placed = m.rows.where("size > 0").join(per_row, ["sid", "at"]).select(F.xxhash64("doc_id", "th").alias("__key"), "__pieces")
    order = Window.partitionBy("__key").orderBy(F.lit(1))  # equal rows are numbered, so each has its own words
    theirs = placed.withColumn("__their", F.row_number().over(order))
    ours = df.withColumn("__key", F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(F.col(text)))).withColumn("__own", F.row_number().over(order))
    met = ours.hint("merge").join(theirs, "__key").where(F.col("__own") == F.col("__their")).select(*(ours[c] for c in df.columns), F.col("__pieces.start").alias("__starts"), F.col("__pieces.words").alias("__words"))

    names = df.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table in steps(batch, text):
                w = Words(table.column(text).combine_chunks())
                starts, sizes = (table.column(c).combine_chunks() for c in ("__starts", "__words"))
                size = sizes.flatten().to_numpy()
                doc = np.repeat(np.arange(table.num_rows), np.diff(starts.offsets.to_numpy()))
                body, off = join_words(w, ranges(w.first[doc] + starts.flatten().to_numpy(), size))
                ends = off[np.cumsum(np.bincount(doc, weights=size, minlength=table.num_rows)).astype(np.int64)]
                body = np.delete(body, ends - 1)  # the space after a row's last word; every row has words
                out = pa.LargeStringArray.from_buffers(table.num_rows, pa.py_buffer(np.concatenate(([0], ends - np.arange(1, len(ends) + 1)))), pa.py_buffer(np.ascontiguousarray(body))).cast(pa.string())
                columns = [out if c == text else table.column(c).combine_chunks() for c in names]
                yield from pa.Table.from_arrays(columns, names=names).to_batches()

    return met.mapInArrow(cut, df.schema)
