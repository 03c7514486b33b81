"""Operator 4: toxicity by class-conditional Kneser-Ney models.

Two models of the bytes of lower-cased words, one of toxic and one of ordinary texts, of order
ORDER and with a word's white space as its context's start. The highest order has the counts of
its class, less DISCOUNT, and backs off (with a prior of STRENGTH counts) to a Kneser-Ney model
of both classes' counts, whose lower orders are continuation counts. An n-gram that was never
counted is scored by what its context's models leave to the shared one; where the context too is
new, both models are the shared one. Every word counts as often as it stands.

A text's evidence is its toxic less its ordinary log-likelihood, by its length in bytes; its peak
is the same of its most toxic word, so that a few expressions are not lost in a long text. A
logistic curve of the two is the score.

Each mapper counts its distinct words once and sums their n-grams (the bytes of an n-gram are
its key), packed by the hash of the n-gram. Every counted n-gram is kept, with its shared
lower-order probability, in a table dealt by the hash of its context; nothing of it is broadcast
or collected. Texts travel as their distinct words with their times, packed, in chunks by a hash
of the row; a chunk asks each part of the table for its distinct n-grams and is scored with the
answers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packed import SCHEMA, deal, frugal, pack, pack_table, rows, split_by, unpack, unpack_table
from .substring_dedup import join_words, ranges
from .words import STEP_BYTES, U, Words, mix64, release, steps
from .work import written

#: STRENGTH and the choice of FEATURES are of the tuning fold of the learning rows (classify).
ORDER, DISCOUNT, STRENGTH = 5, 0.75, 16.0
FEATURES = ("evidence", "peak")
#: Rows that the score's curve is fitted on, at most (about; chosen by a hash of the id).
FIT_ROWS = 20_000
HELD = 1 << 20
#: Bytes of text that a chunk holds, about, and of bags that a mapper packs at once.
CHUNK_BYTES, BAG_BYTES = 16 << 20, 16 << 20
#: Bytes of packed pieces of a chunk that wait to be read together.
PACKED_BYTES = 1 << 20
#: Spreads contexts (32 bits) over the parts of the table; their product has 63 bits.
SPREAD = 1640531527
#: Counts of an n-gram: by class in the rows that the first models learn from, and in the tuning fold.
COUNTS = ("toxic", "ordinary", "toxic_left", "ordinary_left")


def word_grams(w: Words, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of these words, padded by white space: numbers of ORDER bytes (the last byte lowest), and which word (by its place in `words`) each is of."""
    text, off = join_words(w, words)
    size = np.diff(off)
    pad = ORDER - 1
    out = np.full(len(text) + pad * len(words), 0x20, dtype=U)
    word = np.repeat(np.arange(len(words)), size)
    out[np.arange(len(text)) + pad * (word + 1)] = text
    keys = out.copy()
    for j in range(1, ORDER):
        keys[j:] |= out[:-j] << U(8 * j)
    return keys[np.arange(len(text)) + pad * (word + 1)], word


def bag(table: pa.Table, text: str) -> pa.Table:
    """The rows with, in place of the text, its distinct lower-cased words (a space after each, those that stand most often first) and __times, how often the words of several times stand: all that counts and evidence read of it."""
    w = Words(table.column(text).combine_chunks(), lower=True)
    n = table.num_rows
    off, body, several, times = np.zeros(n + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8), np.zeros(n, dtype=np.int64), np.zeros(0, dtype=np.int32)
    if len(w):
        _, first, where = np.unique(w.hashes(), return_index=True, return_inverse=True)
        pair, count = np.unique(w.doc * len(first) + where, return_counts=True)
        doc, word = pair // len(first), pair % len(first)
        order = np.lexsort((word, -count, doc))
        body, ends = join_words(w, first[word[order]])
        off = ends[np.searchsorted(doc, np.arange(n + 1))]
        count = count[order]
        several, times = np.bincount(doc[order][count > 1], minlength=n), count[count > 1].astype(np.int32)
    words = pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.ascontiguousarray(off)), pa.py_buffer(np.ascontiguousarray(body)))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(several))).astype(np.int32)), pa.array(times))
    return table.set_column(table.schema.get_field_index(text), text, words.cast(pa.string())).append_column("__times", lists)


def bags(df: DataFrame, n: int) -> DataFrame:
    """(part, blob): the rows of df (with __bag, a text, and __chunk, one of n) as bags, packed by chunk and brought together.

    A mapper packs BAG_BYTES at once whatever the size of its Arrow batches, so that smaller ones do not make more pieces.
    """

    def packed(made: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(made)
        order, cut = split_by(table.column("__chunk").to_numpy(), n)
        table = table.drop_columns("__chunk").take(pa.array(order))
        parts = np.flatnonzero(np.diff(cut)).tolist()
        return rows(parts, [pack_table(table.slice(cut[p], cut[p + 1] - cut[p])) for p in parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = [], 0
        for batch in batches:
            for table in steps(batch, "__bag"):
                made.append(bag(table, "__bag"))
                held += made[-1].nbytes
                if held >= BAG_BYTES:
                    yield packed(made)
                    made, held = [], 0
        if made:
            yield packed(made)

    return df.mapInArrow(frugal(run), SCHEMA).repartition(n, "part")


def joined(blobs: Iterable[bytes], most: int = 4 * STEP_BYTES) -> Iterator[pa.Table]:
    """Packed bags, as many together as come to `most` bytes, so that work done once for a table does not grow with the number of pieces."""
    held, n = [], 0
    for blob in blobs:
        table = unpack_table(blob)
        if held and n + table.nbytes > most:
            yield pa.concat_tables(held).combine_chunks()
            held, n = [], 0
        held.append(table)
        n += table.nbytes
    if held:
        yield pa.concat_tables(held).combine_chunks()


class Distinct:
    """A growing set of numbers: new ones wait until they are as many as those sorted already (or ALONE), so all sorting together is near linear."""

    ALONE = 1 << 16

    def __init__(self) -> None:
        self.sorted, self.waiting, self.n = np.zeros(0, dtype=U), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(np.unique(keys))
        self.n += len(self.waiting[-1])
        if self.n > max(self.ALONE, len(self.sorted)):
            self.keys()

    def keys(self) -> np.ndarray:
        if self.waiting:
            self.sorted, self.waiting, self.n = np.unique(np.concatenate((self.sorted, *self.waiting))), [], 0
        return self.sorted


def read_bags(bag: pa.Array, times: pa.Array) -> tuple[Words, np.ndarray]:
    """The words of bags and how often each stands."""
    w = Words(bag)
    if isinstance(times, pa.ChunkedArray):
        times = times.combine_chunks()
    out = np.ones(len(w))
    size = np.diff(times.offsets.to_numpy())
    out[ranges(w.first[:-1], size)] = times.flatten().to_numpy()
    return w, out


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and the sums of their counts, a row each."""
    keys, counts = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
    distinct, where = np.unique(keys, return_inverse=True)
    return distinct, np.stack([np.bincount(where, weights=c, minlength=len(distinct)) for c in counts.T], axis=1)


def counts_of(bags_: Iterable[pa.Table], known: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of bags (__id, __bag, __times) whose ids are known (__id, toxic, left), and their COUNTS."""
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=U), np.zeros((0, len(COUNTS))))]
    for table in bags_:
        met = pa.table({"__id": table["__id"], "at": np.arange(table.num_rows)}).join(known, "__id", join_type="inner")
        kind = np.bincount(met["at"].to_numpy() * len(COUNTS) + 2 * met["left"].to_numpy() + 1 - met["toxic"].to_numpy(), minlength=table.num_rows * len(COUNTS)).reshape(-1, len(COUNTS))
        for part, of in ((t, kind[t["__row"].to_numpy()]) for t in steps(table.append_column("__row", pa.array(np.arange(table.num_rows))).filter(pa.array(kind.any(axis=1))), "__bag")):
            w, times = read_bags(part.column("__bag").combine_chunks(), part.column("__times"))
            if not len(w):
                continue
            _, first, where = np.unique(w.hashes(), return_index=True, return_inverse=True)
            sums = np.stack([np.bincount(where, weights=times * k[w.doc], minlength=len(first)) for k in of.T], axis=1)
            keys, word = word_grams(w, first)
            held.append(_summed([(keys, sums[word])]))
            if sum(len(k) for k, _ in held) > HELD:
                held = [_summed(held)]
    return _summed(held)


def ngram_counts(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(key, COUNTS) of every n-gram of the rows (__id, text) whose ids are known, by (__id, toxic, left): the class, and 1 for the tuning fold."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the n-grams grow with the alphabet, not with the texts
    chunks = max(n, -(-_size(texts, "text") // CHUNK_BYTES))
    chunk = F.pmod(F.xxhash64("__id"), F.lit(chunks)).cast("int")
    dealt = bags(texts.select("__id", chunk.alias("__chunk"), F.col("text").alias("__bag")), chunks)

    def count(docs: pa.Table, known: pa.Table) -> pa.Table:
        keys, sums = counts_of(joined(docs["blob"].to_pylist()), known.drop_columns("part"))
        order, cut = split_by(mix64(keys) % U(n), n)
        parts = np.flatnonzero(np.diff(cut)).tolist()
        out = rows(parts, [pack(keys[at], *sums[at].T.astype(np.int64)) for at in (order[cut[p] : cut[p + 1]] for p in parts)])
        release()
        return pa.Table.from_batches([out])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                keys, *sums = unpack(blob)
                held.append((keys, np.stack(sums, axis=1)))
                if sum(len(k) for k, _ in held) > HELD:
                    held = [_summed(held)]
        if held:
            keys, sums = _summed(held)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(c.astype(np.int64)) for c in sums.T)], names=["key", *COUNTS])

    labelled = known.select(chunk.alias("part"), "__id", F.col("toxic").cast("long"), F.col("left").cast("long"))
    counted = dealt.groupBy("part").cogroup(labelled.groupBy("part")).applyInArrow(count, SCHEMA)
    return deal(counted, n).mapInArrow(frugal(add), "key long, " + ", ".join(f"{c} long" for c in COUNTS))


class KneserNey:
    """Log-likelihood ratios of n-grams by their last byte; the n-grams of a context stand together.

    `lower` has each n-gram's shared probability of the next lower order, where the n-grams are
    only a part of the model's.
    """

    def __init__(self, keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, lower: np.ndarray | None = None) -> None:
        order = np.argsort(keys)
        self.keys, counts = keys[order], (toxic[order].astype(float), ordinary[order].astype(float))
        self.context, where = np.unique(self.keys >> U(8), return_inverse=True)
        shared = self._interpolated(counts[0] + counts[1], where, self._lower() if lower is None else lower[order])
        logs, left = [], []
        for c in counts:
            total, kinds = np.bincount(where, weights=c, minlength=len(self.context)), np.bincount(where, weights=c > 0, minlength=len(self.context))
            back = (STRENGTH + DISCOUNT * kinds) / (STRENGTH + total)
            logs.append(np.log(np.maximum(c - DISCOUNT, 0) / (STRENGTH + total[where]) + back[where] * shared))
            left.append(np.log(back))
        self.ratio, self.unseen = logs[0] - logs[1], left[0] - left[1]

    @staticmethod
    def _interpolated(c: np.ndarray, where: np.ndarray, lower: np.ndarray | float) -> np.ndarray:
        """Kneser-Ney: discounted counts of a context, and the rest by the lower order."""
        total, kinds = np.bincount(where, weights=c), np.bincount(where, weights=c > 0)
        return (np.maximum(c - DISCOUNT, 0) + DISCOUNT * kinds[where] * lower) / total[where]

    def _lower(self) -> np.ndarray:
        """p(last byte | the bytes before it but the first) from continuation counts of both classes."""
        levels, g = [], self.keys
        for k in range(ORDER - 1, 0, -1):
            g, c = np.unique(g & U((1 << 8 * k) - 1), return_counts=True)  # left neighbours of each k-gram
            levels.append((k, g, c.astype(float)))
        p: np.ndarray | float = 1 / 256
        below = None
        for k, g, c in reversed(levels):
            base = p if below is None else p[np.searchsorted(below, g & U((1 << 8 * (k - 1)) - 1))]
            p, below = self._interpolated(c, np.unique(g >> U(8), return_inverse=True)[1], base), g
        return p[np.searchsorted(below, self.keys & U((1 << 8 * (ORDER - 1)) - 1))]

    def evidence(self, keys: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of each n-gram's last byte; of unseen ones, what the models of their context leave to the shared one."""
        return _looked_up(self.keys, self.ratio, keys, _looked_up(self.context, self.unseen, keys >> U(8), 0.0))


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: np.ndarray | float) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted)) + other
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


def _lower_orders(counted: DataFrame) -> DataFrame:
    """(g, lower): the shared probability of the last byte of each (ORDER - 1)-gram, from continuation counts."""
    levels, g = [], counted.select(F.col("key").alias("g"))
    for k in range(ORDER - 1, 0, -1):
        g = g.groupBy(_last("g", k).alias("g")).agg(F.count(F.lit(1)).alias("c"))  # left neighbours of each k-gram
        levels.append((k, g))
    below = None
    for k, g in reversed(levels):
        g = g.withColumn("base", F.lit(1 / 256)) if below is None else g.join(below.select(F.col("g").alias("of"), F.col("lower").alias("base")), _last("g", k - 1) == F.col("of")).drop("of")
        context = Window.partitionBy(F.shiftright("g", 8))
        p = (F.greatest(F.col("c") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.count(F.lit(1)).over(context) * F.col("base")) / F.sum("c").over(context)
        below = g.select("g", p.alias("lower"))
    return below


def _part(keys: np.ndarray, n: int) -> np.ndarray:
    """The part of the table that has these n-grams' contexts (Model says the same in columns)."""
    return ((keys >> 8) * SPREAD >> 15) % n


def _last(g: str, k: int) -> Column:
    """The last k bytes of an n-gram."""
    return F.col(g).bitwiseAND(F.lit((1 << 8 * k) - 1).cast("long"))


class Model:
    """The table of all counted n-grams (part, key, toxic, ordinary, lower) in `parts` parts by context."""

    def __init__(self, counted: DataFrame) -> None:
        self.parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        lower = _lower_orders(counted)
        part = F.pmod(F.shiftright(F.shiftright("key", 8) * F.lit(SPREAD).cast("long"), 15), F.lit(self.parts)).cast("int").alias("part")
        self.table = written(counted.join(lower, _last("key", ORDER - 1) == F.col("g")).select(part, "key", "toxic", "ordinary", "lower"), "ngrams")

    def answers(self, asked: DataFrame) -> DataFrame:
        """(__chunk, blob of keys and their evidence) for the rows (part, __chunk, blob of keys)."""

        def answer(table: pa.Table, asking: pa.Table) -> pa.Table:
            model = KneserNey(table["key"].to_numpy().view(U), table["toxic"].to_numpy(), table["ordinary"].to_numpy(), table["lower"].to_numpy())
            blobs = []
            for blob in asking["blob"].to_pylist():
                (keys,) = unpack(blob)
                blobs.append(pack(keys, model.evidence(keys).astype(np.float32)))
            out = pa.Table.from_arrays([asking["__chunk"], pa.array(blobs, pa.binary())], names=["__chunk", "blob"])
            release()
            return out

        return self.table.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(answer, "__chunk int, blob binary")


def learn(learning: DataFrame) -> Model:
    """The models of rows (__id, text, toxic 0/1), each id once."""
    known = learning.select("__id", "toxic", F.lit(0).alias("left"))
    return _model(written(ngram_counts(learning.select("__id", "text"), known), "counts"), True)


def _size(df: DataFrame, text: str) -> int:
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def _model(counts: DataFrame, whole: bool) -> Model:
    """The models of all counts, or of those without the tuning fold's."""
    two = [(F.col(c) + F.col(f"{c}_left") if whole else F.col(c)).alias(c) for c in COUNTS[:2]]
    return Model(counts.select("key", *two).where("toxic + ordinary > 0"))


def _asked(dealt: DataFrame, n: int) -> DataFrame:
    """(part, __chunk, blob): each chunk's distinct n-grams, by the part of the table (of n) that has their context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[int, Distinct] = defaultdict(Distinct)
        blobs_: defaultdict[int, list[bytes]] = defaultdict(list)
        sizes: defaultdict[int, int] = defaultdict(int)

        def add(c: int) -> None:
            for table in joined(blobs_.pop(c)):
                for step in steps(table, "__bag"):
                    w = Words(step.column("__bag").combine_chunks())
                    if len(w):
                        held[c].add(word_grams(w, np.unique(w.hashes(), return_index=True)[1])[0])
            sizes[c] = 0

        for batch in batches:
            for c, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                blobs_[c].append(blob)
                sizes[c] += len(blob)
                if sizes[c] > PACKED_BYTES:
                    add(c)
        for c in list(blobs_):
            add(c)
        for c, own in held.items():
            keys = own.keys()
            order, cut = split_by(_part(keys.view(np.int64), n), n)
            parts = np.flatnonzero(np.diff(cut)).tolist()
            blobs = [pack(keys[order[cut[p] : cut[p + 1]]]) for p in parts]  # by rising key: the order is stable
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([c] * len(parts), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "__chunk", "blob"])

    return dealt.mapInArrow(frugal(run), "part int, __chunk int, blob binary")


def curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and offset of the logistic curve of y on the columns of x (ridge-stabilised Newton steps on the scaled columns)."""
    if len(np.unique(y)) < 2:
        return np.zeros(x.shape[1]), 0.0 if not len(y) else (4.0 if y[0] else -4.0)
    scale = np.maximum(1e-9, x.std(axis=0))
    m = np.column_stack((x / scale, np.ones(len(x))))
    b = np.zeros(m.shape[1])
    ridge = np.full(len(b), 1e-2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(m @ b, -40, 40)))
        h = (m * (p * (1 - p))[:, None]).T @ m + np.diag(ridge)
        step = np.linalg.solve(h, m.T @ (y - p) - ridge * b)
        b += step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return b[:-1] / scale, float(b[-1])


def _evidence_of(bag: pa.Array, times: pa.Array, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """FEATURES of each text (as its bag) by the value of each n-gram; zeros without words."""
    w, often = read_bags(bag, times)
    n = len(w.counts)
    if not len(w):
        return np.zeros((n, len(FEATURES)))
    _, first, where = np.unique(w.hashes(), return_index=True, return_inverse=True)
    grams, word = word_grams(w, first)
    each = np.bincount(word, weights=_looked_up(keys, values, grams, 0.0), minlength=len(first))[where]
    length = np.maximum(np.bincount(w.doc, weights=(w.end - w.start + 1) * often, minlength=n), 1)
    peak = np.zeros(n)
    some = np.flatnonzero(w.counts)
    peak[some] = np.maximum.reduceat(each, w.first[some])
    return np.stack((np.bincount(w.doc, weights=each * often, minlength=n) / length, peak), axis=1)


def scored(df: DataFrame, model: Model, a: np.ndarray, b: float, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, FEATURES, score and the kept columns (as __k0, __k1 ..) of every row; null text counts as empty."""
    chunks = max(model.parts, -(-_size(df, text) // CHUNK_BYTES))
    kept = [f"__k{i}" for i in range(len(keep))]
    df = df.select(F.col(id_col).alias("doc_id"), F.pmod(F.xxhash64(F.col(id_col), F.col(text)), F.lit(chunks)).cast("int").alias("__chunk"), F.col(text).alias("__bag"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])
    fields = ", ".join(["doc_id " + df.schema["doc_id"].dataType.simpleString(), *(f"{f} double" for f in FEATURES), "score double", *(f"{k} {df.schema[k].dataType.simpleString()}" for k in kept)])

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        got = [unpack(blob) for blob in answers["blob"].to_pylist()]
        keys, values = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, dtype=U), np.zeros(0))
        order = np.argsort(keys)
        keys, values = keys[order], values[order].astype(float)
        out = []
        for table in joined(docs["blob"].to_pylist()):
            for t in steps(table, "__bag"):
                x = _evidence_of(t.column("__bag").combine_chunks(), t.column("__times"), keys, values)
                p = 1 / (1 + np.exp(-np.clip(x @ a + b, -700, 700)))
                out.append(pa.Table.from_arrays([t["doc_id"], *(pa.array(c) for c in x.T.copy()), pa.array(p), *(t[k] for k in kept)], names=["doc_id", *FEATURES, "score", *kept]))
        release()
        return pa.concat_tables(out)  # a chunk with answers has rows, and any row has a blob

    dealt = bags(df, chunks)
    answers = model.answers(_asked(dealt, model.parts)).withColumnRenamed("__chunk", "part")
    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(score, fields)


def fold(id_col, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n))


def classify(df: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.5) of every row of df, and the kept columns.

    Labels are used of rows whose fold of the id is not `held_out`. The curve is fitted on FIT_ROWS
    of the next fold (the tuning fold) by models of the others, so on texts these have not seen; the
    final models have the counts of all. Labels that are null, or of ids with a null, teach
    nothing; an id with several labels teaches each. Without labels of both kinds every score is
    0.5 or that kind's. Null and empty text have no evidence. Repeated rows each get their row.
    Other columns are ignored whatever their names; a kept one may not have an output's name.
    """
    if clash := set(keep) & {"doc_id", "held_out", "score", "predicted"}:
        raise ValueError(f"kept columns have names of outputs: {sorted(clash)}")
    tuning = (held_out + 1) % folds
    known = labels.where(F.col("toxic").isin(0, 1)).select(F.col(id_col).alias("__id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.withColumn("left", (fold(F.col("__id"), folds) == tuning).cast("int")).where(fold(F.col("__id"), folds) != held_out)
    mine = df.select(F.col(id_col).alias("__id"), F.col(text).alias("text"))
    counts = written(ngram_counts(mine.where(fold(F.col("__id"), folds) != held_out), known), "counts")
    tuned = known.where("left = 1")
    share = int((1 << 20) * min(1.0, FIT_ROWS / max(1, tuned.count())))
    chosen = F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(1 << 20)) < share
    features = scored(mine.where((fold(F.col("__id"), folds) == tuning) & chosen), _model(counts, False), np.zeros(len(FEATURES)), 0.0, "__id").select("doc_id", *FEATURES)
    fit = features.join(tuned.where(chosen), F.col("doc_id") == F.col("__id")).select(*FEATURES, "toxic").toPandas().sort_values([*FEATURES, "toxic"])
    a, b = curve(fit[list(FEATURES)].to_numpy(dtype=float), fit["toxic"].to_numpy(dtype=float))
    out = scored(df, _model(counts, True), a, b, id_col, text, keep)
    held = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)])
