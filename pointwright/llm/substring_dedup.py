"""Operator 1: removal of word sequences that an earlier document has.

A window is LENGTH words in a row of one document. A word goes if a window over it also stands
in a document with a smaller id. Reference shards are suffix automata; documents stream through
them for matching statistics, and spans at or above the threshold are removed.

Sharding. To broadcast the automaton of every shard to every task would cost shards x corpus,
so a shard is sent only to the text that can match it. Each window has an anchor, its smallest
hash of GRAM words (the leftmost, if several): equal windows have equal anchors at equal places.
Neighbouring windows with one anchor form a segment.

1. mark: every document's distinct anchors are counted over the corpus (packed, 6 bytes an
   anchor); those that at least two documents have return to their documents.
2. match: segments of such anchors go to the shard of their anchor, smallest ids first. Equal
   segments are one: all documents but the first lose it whole. Each distinct segment streams
   through the automaton of the segments of smaller ids and is then added to it.
3. cut: the spans return to the documents.

Hot anchors. An anchor that HOT documents share, or LOCAL_HOT of one mapper's, is hot: its
windows are routed one by one by the hash of all their words, so a shard never gathers the
contexts of a frequent phrase; equal windows are collapsed by each mapper before they move.
Nothing is capped.

Words are compared by 64-bit hashes (as are whole segments), so a false match has a chance of
about 2^-64 per pair compared. The text crosses one shuffle, used twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import SuffixAutomaton, spans_above
from .packed import SCHEMA, deal, frugal, pack, parts_for, rows, split_by, unpack
from .words import U, Words, grams, inside, mix64, powers, steps

LENGTH, GRAM = 13, 5
HOT, LOCAL_HOT = 256, 16
#: Anchors that a mapper holds before it packs them.
HELD = 1 << 19
#: Input bytes of a part: what a task holds of texts, anchors or segments is in proportion.
PART_BYTES = 4 << 20
LOW48 = U((1 << 48) - 1)
#: A reference that is broadcast whole may have so many words.
MAX_REFERENCE_WORDS, SHARD_WORDS = 2_000_000, 100_000
_R, _R_INV = 0x9FB21C651E98DF25, pow(0x9FB21C651E98DF25, -1, 1 << 64)


def prime_from(n: int) -> int:
    """The smallest prime of at least n: ids with a common step still spread over so many parts."""
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def part_of_ids(ids: np.ndarray, n: int) -> np.ndarray:
    return np.mod(ids, n)


def segments(w: Words, hashes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first word, number of windows, the anchor's hash."""
    n = len(w) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
    ok = inside(w, length)
    g = grams(hashes, gram)
    best, place = g[:n].copy(), np.zeros(n, dtype=np.int64)
    for j in range(1, length - gram + 1):
        less = g[j : j + n] < best
        np.copyto(best, g[j : j + n], where=less)
        place[less] = j
    place += np.arange(n)
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    return first, np.bincount(run[ok], minlength=len(first)).astype(np.int64), best[first]


def spans_hash(hashes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of whole spans of words, from prefix sums."""
    sums = np.zeros(len(hashes) + 1, dtype=U)
    np.add.accumulate(hashes * powers(_R, len(hashes)), out=sums[1:])
    return mix64((sums[start + length] - sums[start]) * powers(_R_INV, len(hashes) + 1)[start] + length.astype(U))


def join_words(w: Words, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of these words, a space after each, and the n+1 offsets of the words in them."""
    size = w.end[index] - w.start[index] + 1
    off = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    at = np.repeat(w.start[index] - off[:-1], size) + np.arange(off[-1])
    out = w.data[np.minimum(at, max(0, len(w.data) - 1))]
    out[off[1:] - 1] = 0x20
    return out, off


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, .. for each count, end to end."""
    off = np.concatenate(([0], np.cumsum(count))).astype(np.int64)
    return np.repeat(start - off[:-1], count) + np.arange(off[-1])


def row_keys(ids: np.ndarray, th: np.ndarray) -> np.ndarray:
    """Rows by id and text: rows that share an id but not the text are told apart."""
    return mix64(ids.astype(np.int64).view(U) + U(1)) ^ mix64(th.astype(U) + U(0x51ED270B))


def _flag_keys(ids: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    return mix64(ids.astype(np.int64).view(U) + U(1)) ^ mix64(anchors + U(7))


#: Kinds of packed rows.
COUNT, HOTS, PASS = 0, 1, 2


def _tag(kind: int) -> np.ndarray:
    return np.array([kind], dtype=np.int64)


def mark(docs: DataFrame, n: int, length: int, gram: int) -> DataFrame:
    """Packed (doc_id, anchor, hot) of the anchors that at least two documents have, by part of the document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_a: list[np.ndarray] = []
        held_d: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            a, d = np.concatenate(held_a), np.concatenate(held_d)
            held_a.clear(), held_d.clear()
            order = np.lexsort((d, a))
            a, d = a[order], d[order]
            keep = np.ones(len(a), dtype=bool)
            keep[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
            a, d = a[keep], d[keep]
            _, where, docs_of = np.unique(a, return_inverse=True, return_counts=True)
            hot = docs_of[where] >= LOCAL_HOT
            parts, blobs = [], []
            if hot.any():
                ha, hd = a[hot], d[hot]
                marks = np.unique(ha)
                order, cut = split_by(marks % U(n), n)
                for p in np.flatnonzero(np.diff(cut)).tolist():
                    parts.append(p)
                    blobs.append(pack(_tag(HOTS), marks[order[cut[p] : cut[p + 1]]]))
                order, cut = split_by(part_of_ids(hd, n), n)
                for p in np.flatnonzero(np.diff(cut)).tolist():
                    at = order[cut[p] : cut[p + 1]]
                    parts.append(p)
                    blobs.append(pack(_tag(PASS), hd[at], ha[at], np.ones(len(at), dtype=np.uint8)))
                a, d = a[~hot], d[~hot]
            order = np.argsort(d, kind="stable")
            a, d = a[order], d[order]
            order, cut = split_by(a % U(n), n)
            for p in np.flatnonzero(np.diff(cut)).tolist():
                at = order[cut[p] : cut[p + 1]]
                parts.append(p)
                blobs.append(pack(_tag(COUNT), np.diff(d[at], prepend=np.int64(0)), (a[at] >> U(32)).astype(np.uint16), (a[at] & U(0xFFFFFFFF)).astype(np.uint32)))
            if parts:
                yield rows(parts, blobs)

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            at = 0
            for table in steps(batch, "text"):
                w = Words(table.column("text").combine_chunks())
                first, _, anchor = segments(w, w.hashes(), length, gram)
                held_a.append(anchor & LOW48)
                held_d.append(ids[at + w.doc[first]])
                at += table.num_rows
                if sum(map(len, held_a)) >= HELD:
                    yield from flush()
        if held_a:
            yield from flush()

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_a, held_d, hots = [np.zeros(0, dtype=U)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=U)]
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                kind, *arrays = unpack(blob)
                if kind[0] == PASS:
                    yield rows([part], [pack(*arrays)])
                elif kind[0] == HOTS:
                    hots.append(arrays[0])
                else:
                    held_d.append(np.cumsum(arrays[0]))
                    held_a.append(arrays[1].astype(U) << U(32) | arrays[2].astype(U))
        a, d, marks = np.concatenate(held_a), np.concatenate(held_d), np.unique(np.concatenate(hots))
        held_a.clear(), held_d.clear()
        distinct, where, docs_of = np.unique(a, return_inverse=True, return_counts=True)
        marked = np.isin(distinct, marks, assume_unique=True)
        hot = marked | (docs_of >= HOT)
        keep = np.flatnonzero((hot | (docs_of > 1))[where])
        if len(keep):
            keep = keep[np.argsort(d[keep], kind="stable")]
            order, cut = split_by(part_of_ids(d[keep], n), n)
            for p in np.flatnonzero(np.diff(cut)).tolist():
                at = keep[order[cut[p] : cut[p + 1]]]
                yield rows([p], [pack(d[at], a[at], hot[where[at]].astype(np.uint8))])

    counted = docs.select("doc_id", "text").mapInArrow(frugal(count), SCHEMA)
    return deal(counted, n).mapInArrow(frugal(repeated), SCHEMA)


def _gathered(table: pa.Table, kinds: tuple) -> list[np.ndarray]:
    got = [unpack(b) for b in table.column("blob").to_pylist() if b is not None]
    return [np.concatenate([g[i] for g in got]) if got else np.zeros(0, dtype=k) for i, k in enumerate(kinds)]


def match(docs: DataFrame, flags: DataFrame, n: int, length: int, gram: int) -> DataFrame:
    """Packed (doc_id, th, start, words) of spans to remove, by part of the document."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out_parts: list[int] = []
        out_blobs: list[bytes] = []
        fd, fa, fh = _gathered(right, (np.int64, U, np.uint8))
        if not len(fd) or not left.num_rows:
            return rows([], []).schema.empty_table()
        keys = _flag_keys(fd, fa)
        order = np.argsort(keys)
        keys, fh = keys[order], fh[order]
        left = left.filter(pa.array(np.isin(left.column("doc_id").to_numpy(), fd)))
        gone: list[list[np.ndarray]] = [[], [], [], []]
        for table in steps(left, "text"):
            ids = table.column("doc_id").to_numpy()
            th = table.column("th").to_numpy().view(U) & U(0xFFFFFFFF)
            w = Words(table.column("text").combine_chunks())
            hashes = w.hashes()
            first, windows, anchor = segments(w, hashes, length, gram)
            anchor &= LOW48
            mine = _flag_keys(ids[w.doc[first]], anchor)
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            known = keys[at] == mine
            first, windows, anchor, hot = first[known], windows[known], anchor[known], fh[at[known]] > 0
            each = ranges(first[hot], windows[hot])  # a hot anchor's windows go one by one
            start = np.concatenate((first[~hot], each))
            size = np.concatenate((windows[~hot] + length - 1, np.full(len(each), length)))
            if not len(start):
                continue
            same = spans_hash(hashes, start, size)
            route = np.concatenate((anchor[~hot], same[np.count_nonzero(~hot) :]))
            doc = ids[w.doc[start]]
            # equal segments: the smallest id stands for all; the others lose theirs whole
            order = np.lexsort((doc, same))
            same, doc, start, size, route = same[order], doc[order], start[order], size[order], route[order]
            head = np.ones(len(same), dtype=bool)
            head[1:] = same[1:] != same[:-1]
            group = np.cumsum(head) - 1
            heads = np.flatnonzero(head)
            later = doc > doc[heads][group]
            row = w.doc[start]
            local = start - w.first[row]
            for held, x in zip(gone, (doc[later], th[row[later]], local[later], size[later]), strict=True):
                held.append(x)
            stays = np.flatnonzero(~later)
            each = np.bincount(group[stays], minlength=len(heads))
            at = np.concatenate(([0], np.cumsum(each)))
            order, cut = split_by(route[heads] % U(n), n)
            for p in np.flatnonzero(np.diff(cut)).tolist():
                g = order[cut[p] : cut[p + 1]]
                h = heads[g]
                places = stays[ranges(at[g], each[g])]
                text, _ = join_words(w, ranges(start[h], size[h]))
                out_parts.append(p)
                out_blobs.append(pack(_tag(COUNT), text, size[h].astype(np.uint32), route[h], doc[h], each[g].astype(np.uint32), th[row[places]].astype(np.uint32), local[places].astype(np.uint32), level=3))
        if any(map(len, gone[0])):
            d, t, s, k = (np.concatenate(x) for x in gone)
            order = np.lexsort((s, t, d))
            d, t, s, k = d[order], t[order], s[order], k[order]
            out_parts.append(int(part_of_ids(d[:1], n)[0]))
            out_blobs.append(pack(_tag(PASS), d, t, s, k))
        return pa.Table.from_batches([rows(out_parts, out_blobs)])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(7)]
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                kind, *arrays = unpack(blob)
                if kind[0] == PASS:
                    yield rows([part], [pack(*arrays)])
                else:
                    for h, x in zip(held, arrays, strict=True):
                        h.append(x)
        if held[0]:
            yield from shard(*(np.concatenate(h) for h in held), length=length, n=n)

    sent = docs.select("doc_id", "text", "th", "part").groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(send, SCHEMA)
    return deal(sent, n).mapInArrow(frugal(meet), SCHEMA)


def shard(text: np.ndarray, size: np.ndarray, route: np.ndarray, doc: np.ndarray, each: np.ndarray, th: np.ndarray, start: np.ndarray, *, length: int, n: int) -> Iterator[pa.RecordBatch]:
    """One shard: the spans that its segments lose, by matching statistics against the segments of smaller ids."""
    w = Words(pa.array([text.tobytes().decode()], pa.large_string()))
    hashes = w.hashes()
    size = size.astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    same = spans_hash(hashes, begin, size)
    first_place = np.concatenate(([0], np.cumsum(each))).astype(np.int64)
    order = np.lexsort((doc, same, route))
    head = np.ones(len(order), dtype=bool)
    head[1:] = (same[order[1:]] != same[order[:-1]]) | (route[order[1:]] != route[order[:-1]])
    heads = order[head]
    group = np.cumsum(head) - 1
    out: list[list[np.ndarray]] = [[], [], [], []]

    def lose(i: np.ndarray, offset: np.ndarray, words: np.ndarray) -> None:
        """Every place of segments i loses so many words from the offset."""
        k = each[i].astype(np.int64)
        places = ranges(first_place[i], k)
        for held, x in zip(out, (np.repeat(doc[i], k), th[places].astype(U), start[places].astype(np.int64) + np.repeat(offset, k), np.repeat(words, k)), strict=True):
            held.append(x)

    later = doc[order] > doc[heads][group]
    lose(order[later], np.zeros(np.count_nonzero(later), dtype=np.int64), size[order[later]])
    equal = np.flatnonzero(~later)  # segments of the smallest id, one per sender: they share their fate
    members = order[equal]
    member_at = np.searchsorted(group[equal], np.arange(len(heads) + 1))
    by_route = np.lexsort((doc[heads], route[heads]))
    edges = np.flatnonzero(np.concatenate(([True], route[heads][by_route][1:] != route[heads][by_route][:-1], [True])))
    _, numbers = np.unique(hashes, return_inverse=True)
    lost_i, lost_at, lost_n = [], [], []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a < 2:
            continue
        reference = SuffixAutomaton()
        waiting: list[list[int]] = []
        before = None
        for g in by_route[a:b].tolist():
            i = int(heads[g])
            if before is not None and doc[i] != before:
                for x in waiting:
                    reference.add(x)
                waiting = []
            before = doc[i]
            sequence = numbers[begin[i] : begin[i] + size[i]].tolist()
            for s, e in spans_above(reference.statistics(sequence), length):
                for m in members[member_at[g] : member_at[g + 1]].tolist():
                    lost_i.append(m), lost_at.append(s), lost_n.append(e - s)
            waiting.append(sequence)
    if lost_i:
        lose(np.array(lost_i), np.array(lost_at, dtype=np.int64), np.array(lost_n, dtype=np.int64))
    d, t, s, k = (np.concatenate(x) for x in out)
    order, cut = split_by(part_of_ids(d, n), n)
    for p in np.flatnonzero(np.diff(cut)).tolist():
        at = order[cut[p] : cut[p + 1]]
        at = at[np.lexsort((s[at], t[at], d[at]))]
        yield rows([p], [pack(d[at], t[at], s[at], k[at])])


RESULT = ["kept_text", "n_words", "n_removed", "span_starts", "span_ends"]


def cut(docs: DataFrame, spans: DataFrame, carry: list[str], untouched: str) -> DataFrame:
    """The documents without the words that the spans cover."""

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        d, t, s, k = _gathered(right, (np.int64, U, np.int64, np.int64))
        lost = row_keys(d, t)
        tables = [removed(table, lost, s, k, carry, untouched) for table in steps(left, "text")]
        return pa.concat_tables(tables or [removed(left, lost, s, k, carry, untouched)])

    fields = [docs.schema["doc_id"], *(docs.schema[c] for c in carry), T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("span_starts", T.ArrayType(T.IntegerType())), T.StructField("span_ends", T.ArrayType(T.IntegerType()))]
    return docs.select("doc_id", "text", "th", "part", *carry).groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(remove, T.StructType(fields))


def removed(table: pa.Table, lost: np.ndarray, start: np.ndarray, words: np.ndarray, carry: list[str], untouched: str) -> pa.Table:
    """A step of rows with their spans removed; lost: row keys of the spans."""
    w = Words(table.column("text").combine_chunks())
    rows_ = row_keys(table.column("doc_id").to_numpy(), table.column("th").to_numpy().view(U) & U(0xFFFFFFFF))
    order = np.argsort(rows_, kind="stable")
    low, high = np.searchsorted(rows_[order], lost, "left"), np.searchsorted(rows_[order], lost, "right")
    hit = np.repeat(np.arange(len(lost)), high - low)
    row = order[ranges(low, high - low)]
    change = np.zeros(len(w) + 1, dtype=np.int64)
    begin = w.first[row] + start[hit]
    np.add.at(change, begin, 1)
    np.add.at(change, begin + words[hit], -1)
    gone = np.cumsum(change[:-1]) > 0
    kept = np.flatnonzero(~gone)
    text, off = join_words(w, kept)
    n = table.num_rows
    per_doc = np.searchsorted(kept, w.first)
    ends = off[per_doc]  # each text ends with a space, which goes
    has = ends[1:] > ends[:-1]
    keep = np.ones(len(text), dtype=bool)
    keep[ends[1:][has] - 1] = False
    offsets = np.concatenate(([0], np.cumsum(np.diff(ends) - has))).astype(np.int32)
    kept_text = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(text[keep].tobytes())])
    if untouched == "original":
        whole = pa.array(np.diff(per_doc) == w.counts)
        kept_text = pc.if_else(whole, table.column("text").combine_chunks().cast(pa.string()), kept_text)
    edge = gone.copy()
    edge[1:] &= ~gone[:-1] | (w.doc[1:] != w.doc[:-1])
    s = np.flatnonzero(edge)
    edge = gone.copy()
    edge[:-1] &= ~gone[1:] | (w.doc[1:] != w.doc[:-1])
    e = np.flatnonzero(edge) + 1
    list_at = pa.array(np.searchsorted(s, w.first).astype(np.int32))
    made = [kept_text, pa.array(w.counts), pa.array(w.counts - np.diff(per_doc)), pa.ListArray.from_arrays(list_at, pa.array((s - w.first[w.doc[s]]).astype(np.int32))), pa.ListArray.from_arrays(list_at, pa.array((e - w.first[w.doc[s]]).astype(np.int32)))]
    return pa.Table.from_arrays([table.column("doc_id"), *(table.column(c) for c in carry), *made], names=["doc_id", *carry, *RESULT])


def remove_repeated(df: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, carry: tuple[str, ...] = (), untouched: str = "joined") -> DataFrame:
    """Each document without the words that a window shared with a smaller id covers.

    Returns doc_id (long), the carried columns, kept_text (kept words joined by one space),
    n_words, n_removed, and the removed maximal spans as span_starts and span_ends (word numbers
    from 0, ends exclusive). A carried column may not be named like one of these. With
    untouched="original", a text that loses nothing is returned as it is, white space and all.
    Null or empty text has no words: kept_text "". Rows with a null id are not returned. Rows
    that share an id never remove each other's words; each gives a row. df is read twice and
    must give the same rows each time (a table does).
    """
    if not 0 < gram <= length:
        raise ValueError("gram must be from 1 to length")
    if clash := {"doc_id", "text", "th", "part", *RESULT} & set(carry):
        raise ValueError(f"carried columns have names of results: {sorted(clash)}")
    n = prime_from(parts_for(df, PART_BYTES))
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *carry)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), F.pmod("doc_id", F.lit(n)).cast("int").alias("part"), *carry)
    flags = mark(docs, n, length, gram)
    spans = match(docs.select("doc_id", "text", "th", "part", *carry), flags, n, length, gram)
    return cut(docs, spans, list(carry), untouched)


def remove_against(df: DataFrame, reference: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_words and removed spans of df's texts that a small reference (column `text`) also has.

    The reference may have MAX_REFERENCE_WORDS words, which is checked (ValueError); it is cut into
    shards of SHARD_WORDS or one text, each task builds a shard's automaton once and streams its
    documents through every shard. Null texts have no words; null ids keep their row.
    """
    counted = reference.select(F.sum(F.length(text)).alias("n")).first().n or 0
    if counted > 8 * MAX_REFERENCE_WORDS:
        raise ValueError(f"the reference has {counted} characters; it is broadcast whole and may have {8 * MAX_REFERENCE_WORDS}")
    texts = [r[0] for r in reference.select(text).where(F.col(text).isNotNull()).collect()]
    shared = df.sparkSession.sparkContext.broadcast(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, numbers, size = [SuffixAutomaton()], {}, 0
        for t in shared.value:
            w = Words(pa.array([t]))
            if size > SHARD_WORDS:
                shards.append(SuffixAutomaton())
                size = 0
            shards[-1].add([numbers.setdefault(h, len(numbers)) for h in w.hashes().tolist()])
            size += len(w)
        for batch in batches:
            for table in steps(batch, "text"):
                w = Words(table.column("text").combine_chunks())
                known = [numbers.get(h, -1) for h in w.hashes().tolist()]
                starts, ends = [], []
                for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                    found: list[tuple[int, int]] = []
                    for s, e in sorted(x for m in shards for x in spans_above(m.statistics(known[a:b]), length)):
                        if found and s <= found[-1][1]:
                            found[-1] = found[-1][0], max(e, found[-1][1])
                        else:
                            found.append((s, e))
                    starts.append([s for s, _ in found]), ends.append([e for _, e in found])
                yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(w.counts), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=["doc_id", "n_words", "span_starts", "span_ends"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_words long, span_starts array<int>, span_ends array<int>")
