"""Operator 6: token ids in binary files, one compressed frame per document.

Format. A folder holds two Parquet tables. `dictionary` has one row: the zstandard dictionary,
its SHA-256 and the width of an id in bytes. `blocks` has rows of about BLOCK_IDS ids in
ascending order of document: part, block, start_in_part (ids of the part's earlier blocks),
n_ids, dict_sha256, doc_ids (int64), lengths (int64: ids per document), index (int64: n+1 frame
offsets) and frames (each document's ids, little-endian, as a zstandard frame of its own made
with the dictionary). A document is read by its index entry alone; a reader refuses a block
whose dictionary hash is not its dictionary's.

Texts are encoded where they are scanned and only the frames cross the shuffle, dealt by
ranges of the id. Spark writes and commits the files, so a lost executor's work is redone
whole and any store that Spark can write to will do.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packed import parts_for
from .ranges import first_ids, range_of
from .words import BYTE_VALUES, IS_SPACE, U, Words, mix64, powers, steps

BLOCK_IDS = 1 << 18
#: The dictionary is trained on at most so many documents and bytes of ids.
TRAIN_DOCS, TRAIN_BYTES, DICT_BYTES = 2000, 8 << 20, 64 << 10
#: Units that a worker remembers the ids of.
MEMO = 1 << 21
_BASE, _BASE_INV = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)


class Encoder:
    """Byte-level BPE of whole texts, with the ids of frequent units remembered.

    A byte-level pre-tokenizer never joins what stands before ASCII white space that follows a
    word with what stands after, so a text is the concatenation of units: white space and the
    word behind it. Each step of texts is cut into units, the distinct ones are encoded by the
    tokenizers library, and the ids are laid out again by NumPy. New units are encoded end to end
    as one text and told apart by the bytes of their ids; those that could join a neighbour (no
    white space in front, no word, white space beyond ASCII) go one by one. A text with white
    space beyond ASCII, which can join units, is encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        added = self.tokenizer.get_added_tokens_decoder()
        self.bytes = np.zeros(self.vocabulary, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():  # a character of the vocabulary is a byte
            self.bytes[i] = len(added[i].content.encode()) if i in added else len(token)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, dtype=U)
        self.at = np.zeros(1, dtype=np.int64)  # ids of unit i: ids[at[i]:at[i + 1]]
        self.ids = np.zeros(0, dtype=np.uint32)
        self.order = np.zeros(0, dtype=np.int64)

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and the n+1 offsets."""
        w = Words(column)
        n = len(w.offsets) - 1
        if not len(w.data):
            return np.zeros(0, dtype=np.uint32), np.zeros(n + 1, dtype=np.int64)
        # units: from the end of the word before (or the text's start) to the word's end, and what white space is left
        begin = np.concatenate(([0], w.end[:-1])) if len(w) else np.zeros(0, dtype=np.int64)
        head = w.first[:-1][w.counts > 0]
        begin[head] = w.offsets[:-1][w.counts > 0]
        last = np.where(w.counts > 0, w.end[np.maximum(w.first[1:] - 1, 0)] if len(w) else 0, w.offsets[:-1])
        tails = np.flatnonzero(last < w.offsets[1:])
        begin = np.concatenate((begin, last[tails]))
        end = np.concatenate((w.end, w.offsets[1:][tails]))
        doc = np.concatenate((w.doc, tails))
        if len(tails):
            order = np.argsort(begin, kind="stable")
            begin, end, doc = begin[order], end[order], doc[order]
        hit = self._hits(w.data)
        known = self._look_up(w.data, begin, end, hit)
        sizes = self.at[known + 1] - self.at[known]
        total = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.ids[np.repeat(self.at[known] - total[:-1], sizes) + np.arange(total[-1])]
        off = total[np.searchsorted(doc, np.arange(n + 1))]
        if len(odd := np.unique(np.searchsorted(w.offsets, hit, "right") - 1)):
            texts = column.take(pa.array(odd)).to_pylist()
            new = dict(zip(odd.tolist(), self.plain(texts), strict=True))
            each = [np.array(new[i], dtype=np.uint32) if i in new else ids[off[i] : off[i + 1]] for i in range(n)]
            ids, off = np.concatenate(each), np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)
        return ids, off

    @staticmethod
    def _hits(data: np.ndarray) -> np.ndarray:
        """Where white space beyond ASCII may stand: by its first UTF-8 bytes."""
        a, b = data[:-1], data[1:]
        hit = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))
        return np.flatnonzero(hit)

    def _look_up(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """The place of each unit in the memo; new units are encoded and added."""
        sums = np.zeros(len(data) + 1, dtype=U)
        np.multiply(BYTE_VALUES[data], powers(_BASE, len(data)), out=sums[1:])
        np.add.accumulate(sums, out=sums)
        h = mix64((sums[end] - sums[begin]) * powers(_BASE_INV, len(data))[begin] + (end - begin).astype(U))
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > MEMO:
            self.forget()
        place = np.searchsorted(self.keys, distinct)
        known = np.minimum(place, max(0, len(self.keys) - 1))
        have = self.keys[known] == distinct if len(self.keys) else np.zeros(len(distinct), dtype=bool)
        if not have.all():
            new = np.flatnonzero(~have)
            a, b = begin[first[new]], end[first[new]]
            alone = ~IS_SPACE[data[a]] | IS_SPACE[data[b - 1]] | (np.searchsorted(hit, b) > np.searchsorted(hit, a))
            order = np.concatenate((np.flatnonzero(~alone), np.flatnonzero(alone)))
            a, b, new = a[order], b[order], new[order]
            together = len(a) - int(alone.sum())
            size = b - a
            ends = np.cumsum(size)
            at = np.repeat(a - ends + size, size) + np.arange(ends[-1])
            raw = data[at].tobytes()
            ids, sizes = [], []
            for i in range(0, together, 4096):  # texts of a bounded length
                j = min(i + 4096, together)
                from_byte = int(ends[i] - size[i])
                got = np.array(self.plain([raw[from_byte : int(ends[j - 1])].decode()])[0], dtype=np.uint32)
                upto = np.searchsorted(np.cumsum(self.bytes[got]), ends[i:j] - from_byte, "right")
                ids.append(got)
                sizes.append(np.diff(upto, prepend=0))
            single = self.plain([raw[int(e - n) : int(e)].decode() for e, n in zip(ends[together:], size[together:], strict=True)])
            ids.append(np.array([i for x in single for i in x], dtype=np.uint32))
            sizes.append(np.array([len(x) for x in single], dtype=np.int64))
            base = len(self.at) - 1
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(np.concatenate(sizes))))
            self.ids = np.concatenate((self.ids, *ids))
            back = np.argsort(new)
            self.keys = np.insert(self.keys, place[new[back]], distinct[new[back]])
            self.order = np.insert(self.order, place[new[back]], base + back)
            known = np.searchsorted(self.keys, distinct)
        return self.order[known][inverse]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One loaded tokenizer per worker."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def serialise(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def train_dictionary(df: DataFrame, tokenizer: str, end_id: int, width: int) -> bytes:
    """A zstandard dictionary for serialised ids, trained on a bounded sample: the TRAIN_DOCS documents with the smallest hashes of their ids, and of these at most TRAIN_BYTES."""
    chosen = df.where(F.length("text") > 0).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    found = df.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi").select("text")
    e = encoder(tokenizer)
    samples, size = [], 0
    for row in found.toLocalIterator():
        ids, _ = e.encode(pa.array([row.text]))
        samples.append(serialise(np.append(ids, end_id), width))
        size += len(samples[-1])
        if size > TRAIN_BYTES:
            break
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(256, size // 8)), samples, level=3).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b""


BLOCKS = "part int, block int, start_in_part long, n_ids long, dict_sha256 string, doc_ids binary, lengths binary, index binary, frames binary"


def write(df: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text: str = "text") -> None:
    """Encode every text of df with the tokenizer file, append end_id, and write the format to path.

    Documents stand in ascending order of id, rows of one id in the order of their ids' CRC and
    length. Rows with a null id are left out; null text counts as empty (end_id alone). Extra
    columns are ignored. An empty table gives an empty blocks table.
    """
    spark = df.sparkSession
    n = parts_for(df)
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    firsts = first_ids(docs, "doc_id", n)
    shared = spark.sparkContext.broadcast(np.array(firsts, dtype=np.int64))  # eight bytes a task
    width = 2 if max(encoder(tokenizer).vocabulary, end_id + 1) <= 1 << 16 else 4
    dictionary = train_dictionary(docs, tokenizer, end_id, width)
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(bytearray(dictionary), sha, width)], "dictionary binary, sha256 string, width int").coalesce(1).write.mode("overwrite").parquet(f"{path}/dictionary")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        z = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            for table in steps(batch, "text"):
                ids, off = e.encode(table.column("text").combine_chunks())
                frames, crcs = [], []
                for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    raw = serialise(np.append(ids[a:b], np.uint32(end_id)), width)
                    crcs.append(zlib.crc32(raw))
                    frames.append(z.compress(raw))
                part = range_of(table.column("doc_id").to_numpy(), shared.value)
                yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(np.diff(off) + 1), pa.array(crcs, pa.int64()), pa.array(frames, pa.binary()), pa.array(part)], names=["doc_id", "n", "crc", "frame", "part"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, start = 0, 0
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, start
            t = pa.Table.from_batches(held)
            lengths = t.column("n").to_numpy()
            frames = t.column("frame").to_pylist()
            index = np.concatenate(([0], np.cumsum([len(f) for f in frames])))
            row = [t.column("part")[0].as_py(), number, start, int(lengths.sum()), sha, t.column("doc_id").to_numpy().astype("<i8").tobytes(), lengths.astype("<i8").tobytes(), index.astype("<i8").tobytes(), b"".join(frames)]
            number, start = number + 1, start + row[3]
            held.clear()
            return pa.RecordBatch.from_pylist([dict(zip(NAMES, row, strict=True))], schema=ARROW)

        for batch in batches:
            ends = np.cumsum(batch.column("n").to_numpy())
            at = 0
            have = sum(int(pc.sum(b.column("n")).as_py()) for b in held)
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_IDS - have, "right")))
                held.append(batch.slice(at, to - at))
                if to < batch.num_rows or sum(b.num_rows for b in held) == 0:
                    yield flush()
                at, have = to, 0
            if held and sum(int(pc.sum(b.column("n")).as_py()) for b in held) >= BLOCK_IDS:
                yield flush()
        if held:
            yield flush()

    NAMES = [x.split()[0] for x in BLOCKS.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    ARROW = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in BLOCKS.split(", ")])
    coded = docs.mapInArrow(compress, "doc_id long, n long, crc long, frame binary, part int")
    ordered = coded.repartitionById(max(1, len(firsts)), F.col("part")).sortWithinPartitions("doc_id", "crc", "n")
    ordered.mapInArrow(block, BLOCKS).write.mode("overwrite").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Documents of a folder in the format: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and, unless ids=False, the ids."""
    d = spark.read.parquet(f"{path}/dictionary").first()
    dictionary, sha, width = bytes(d.dictionary), d.sha256, d.width
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # a row per task of the writer
    base, bases = 0, []
    for part, n in totals:
        bases.append((part, base))
        base += n
    blocks = blocks.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part").withColumn("start", F.col("base") + F.col("start_in_part"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_sha256"] != sha:
                    raise ValueError("a block was written with another dictionary")
                docs, lengths, index = (np.frombuffer(row[c], dtype="<i8") for c in ("doc_ids", "lengths", "index"))
                all_ids = [np.frombuffer(z.decompress(row["frames"][a:b]), dtype="<u2" if width == 2 else "<u4").astype("<u4") for a, b in zip(index[:-1].tolist(), index[1:].tolist(), strict=True)]
                columns = [pa.array(docs), pa.array(row["start"] + np.cumsum(lengths) - lengths), pa.array([len(x) for x in all_ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in all_ids], pa.int64())]
                if ids:
                    columns.append(pa.array([x.astype(np.int32) for x in all_ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return blocks.select("start", "dict_sha256", "doc_ids", "lengths", "index", "frames").mapInArrow(expand, schema)


def document(block: dict, doc_id: int, dictionary: bytes, width: int) -> np.ndarray:
    """The ids of one document of a block row, by its index entry: no other frame is read."""
    if hashlib.sha256(dictionary).hexdigest() != block["dict_sha256"]:
        raise ValueError("a block was written with another dictionary")
    docs, index = (np.frombuffer(block[c], dtype="<i8") for c in ("doc_ids", "index"))
    i = int(np.searchsorted(docs, doc_id))
    if i == len(docs) or docs[i] != doc_id:
        raise KeyError(doc_id)
    z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return np.frombuffer(z.decompress(block["frames"][index[i] : index[i + 1]]), dtype="<u2" if width == 2 else "<u4")
