"""Operator 2: similarity join of documents on word n-grams, by grouped prefixes.

A document's set is its distinct n-grams of lower-cased words. Two documents link when the
Jaccard similarity of their sets reaches the threshold (PERCENT of 100, in integers).

1. count: every document's distinct n-grams go, packed, to the task of their hash, which counts
   their documents; those of at least two documents return with their rank (their document
   count, or HOT for those that one mapper saw in LOCAL_HOT documents: a few packed marks).
   An n-gram of one document cannot be shared, so what returns decides every intersection.
2. order: a set is ordered by rank, rarest first. Linked sets share an element of their
   prefixes (n - ceil(t n) + 1 elements each). A document whose prefix is all its own is done.
3. Documents with the same set are one node.
4. lead: nodes that share a minimum hash with more than FEW others are put in chunks; each is
   verified against its chunk's leaders and linked where it passes. Then (brief) a group that
   shares prefix elements with a larger component is verified against a few of its members.
   This finds most links of large groups of near copies without pairing them off.
5. join: nodes with identical prefix, size and component so far collapse into one group; groups
   of different components that share a prefix element, with sizes and positions that allow the
   threshold, are expanded and their members verified. Lists of over BLOCK groups are paired
   block by block. Pairs that are in one component already need no test; all others get theirs,
   so no link between components is lost.
6. The component of a document is the smallest id that links reach.

n-grams are compared by 56 bits of hash beside the task they were dealt to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .packed import SCHEMA, deal, frugal, pack, parts_for, rows, split_by, unpack
from .substring_dedup import PART_BYTES, _tag, part_of_ids, prime_from, ranges, spans_hash
from .words import U, Words, grams, inside, mix64, steps
from .work import written

WORDS, PERCENT = 5, 75
HOT, LOCAL_HOT = 65535, 64
HELD = 1 << 19
FEW, REPRESENTATIVES, CHUNK, LEADERS, BLOCK, SPREAD = 8, 2, 256, 64, 1024, 32
SALTS = mix64(np.arange(1, 4, dtype=U))
COUNT, HOTS, PASS, INFO = 0, 1, 2, 3


def least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The fewest elements that a set of n shares with any set it links to."""
    return -(-percent * n // 100)


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each row (row, hash), rows ascending; fewer than k words are one n-gram."""
    hashes = w.hashes()
    at = np.flatnonzero(inside(w, k)) if len(w) >= k else np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    row = np.concatenate((w.doc[at], short))
    h = np.concatenate((grams(hashes, k)[at] if len(at) else np.zeros(0, dtype=U), mix64(spans_hash(hashes, w.first[short], w.counts[short]) ^ U(k))))
    bits = max(1, int(len(w.counts)).bit_length())
    order = np.argsort(row.astype(U) << U(64 - bits) | h >> U(bits), kind="stable")
    row, h = row[order], h[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[keep], h[keep]


def _narrow(h: np.ndarray) -> list[np.ndarray]:
    """56 bits of a hash, 7 bytes."""
    return [(h & U(0xFFFFFFFF)).astype(np.uint32), (h >> U(32) & U(0xFFFF)).astype(np.uint16), (h >> U(48) & U(0xFF)).astype(np.uint8)]


def _wide(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return a.astype(U) | b.astype(U) << U(32) | c.astype(U) << U(48)


def shared_shingles(docs: DataFrame, n: int, k: int) -> DataFrame:
    """Packed sizes of the documents' sets, and their n-grams that others have, by part of the document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_h: list[np.ndarray] = []
        held_d: list[np.ndarray] = []
        info: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            parts, blobs = [], []

            def send(part_of: np.ndarray, make) -> None:
                order, cut = split_by(part_of, n)
                for p in np.flatnonzero(np.diff(cut)).tolist():
                    parts.append(p)
                    blobs.append(make(order[cut[p] : cut[p + 1]]))

            ids, sizes = (np.concatenate(x) for x in zip(*info, strict=True))
            info.clear()
            send(part_of_ids(ids, n), lambda at: pack(_tag(INFO), ids[at], sizes[at]))
            h, d = np.concatenate(held_h), np.concatenate(held_d)
            held_h.clear(), held_d.clear()
            if len(h):
                distinct, docs_of = np.unique(h, return_counts=True)
                marks = distinct[docs_of >= LOCAL_HOT]
                if len(marks):
                    hot = np.isin(h, marks)
                    send(marks % U(n), lambda at: pack(_tag(HOTS), *_narrow(marks[at])))
                    hh, hd = h[hot], d[hot]
                    send(part_of_ids(hd, n), lambda at: pack(_tag(PASS), np.diff(hd[at], prepend=np.int64(0)), np.full(len(at), HOT, dtype=np.uint16), *_narrow(hh[at])))
                    h, d = h[~hot], d[~hot]
                send(h % U(n), lambda at: pack(_tag(COUNT), np.diff(d[at], prepend=np.int64(0)), *_narrow(h[at])))
            yield rows(parts, blobs)

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            at = 0
            for table in steps(batch, "text"):
                row, h = shingle_sets(Words(table.column("text").combine_chunks(), lower=True), k)
                held_h.append(h)
                held_d.append(ids[at + row])
                info.append((ids[at : at + table.num_rows], np.bincount(row, minlength=table.num_rows)))
                at += table.num_rows
                if sum(map(len, held_h)) >= HELD:
                    yield from flush()
        if info:
            yield from flush()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_h, held_d, hots = [np.zeros(0, dtype=U)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=U)]
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                kind, *arrays = unpack(blob)
                if kind[0] in (PASS, INFO):
                    yield rows([part], [blob])
                elif kind[0] == HOTS:
                    hots.append(_wide(*arrays))
                else:
                    held_d.append(np.cumsum(arrays[0]))
                    held_h.append(_wide(*arrays[1:]))
        h, d, marks = np.concatenate(held_h), np.concatenate(held_d), np.unique(np.concatenate(hots))
        held_h.clear(), held_d.clear()
        distinct, where, docs_of = np.unique(h, return_inverse=True, return_counts=True)
        rank = np.minimum(docs_of, HOT - 1).astype(np.uint16)
        rank[np.isin(distinct, marks, assume_unique=True)] = HOT
        keep = np.flatnonzero((rank > 1)[where])
        if len(keep):
            keep = keep[np.argsort(d[keep], kind="stable")]
            order, cut = split_by(part_of_ids(d[keep], n), n)
            for p in np.flatnonzero(np.diff(cut)).tolist():
                at = keep[order[cut[p] : cut[p + 1]]]
                yield rows([p], [pack(_tag(PASS), np.diff(d[at], prepend=np.int64(0)), rank[where[at]], *_narrow(h[at]))])

    return deal(deal(docs.mapInArrow(frugal(count), SCHEMA), n).mapInArrow(frugal(weigh), SCHEMA), n)


SETS = "doc_id long, n long, own long, m int, node long, keys array<long>, r array<long>"


def assemble(packed: DataFrame, percent: int) -> DataFrame:
    """A row per document: n (its set's size), own (elements no other has), and for those whose prefix reaches a shared element: m (such elements of the prefix), node, minimum hashes, and the shared elements r, rarest first."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, held_d, held_k, held_h = [], [], [], [], []
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                kind, *arrays = unpack(blob)
                if kind[0] == INFO:
                    ids.append(arrays[0]), sizes.append(arrays[1])
                else:
                    held_d.append(np.cumsum(arrays[0])), held_k.append(arrays[1]), held_h.append(_wide(*arrays[2:]))
        if not ids:
            return
        doc, inverse = np.unique(np.concatenate(ids), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate(sizes)).astype(np.int64)
        if held_d:
            d, rank, h = np.searchsorted(doc, np.concatenate(held_d)), np.concatenate(held_k), np.concatenate(held_h)
        else:
            d, rank, h = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint16), np.zeros(0, dtype=U)
        order = np.lexsort((h, rank, d))
        d, rank, h = d[order], rank[order], h[order]
        keep = np.ones(len(d), dtype=bool)  # rows of one id are one set
        keep[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        n -= np.bincount(d[~keep], minlength=len(doc))
        d, h = d[keep], h[keep]
        have = np.bincount(d, minlength=len(doc))
        own = n - have
        m = np.where(n > 0, n - least_overlap(n, percent) + 1 - own, 0)
        first = np.concatenate(([0], np.cumsum(have)))
        node = np.zeros(len(doc), dtype=np.int64)
        keys = np.zeros((len(doc), len(SALTS)), dtype=np.int64)
        some = np.flatnonzero(have)
        if len(some):
            at = first[some]
            for i, salt in enumerate(SALTS):
                keys[some, i] = np.minimum.reduceat(mix64(h ^ salt), at).view(np.int64)
            both = mix64(np.add.reduceat(mix64(h), at) ^ mix64(n[some].astype(U)))
            node[some] = np.where(own[some] == 0, both, mix64(doc[some].view(U) + U(0xA5A5A5A5))).view(np.int64)
        for a in range(0, len(doc), 4096):
            b = min(a + 4096, len(doc))
            use = m[a:b] > 0
            count = np.where(use, have[a:b], 0)
            off = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32))
            values = h[ranges(first[a:b], count)].view(np.int64)
            r = pa.ListArray.from_arrays(off, pa.array(values))
            k = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * (b - a) + 1, 3, dtype=np.int32)), pa.array(keys[a:b].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(doc[a:b]), pa.array(n[a:b]), pa.array(own[a:b]), pa.array(np.maximum(m[a:b], 0).astype(np.int32)), pa.array(node[a:b], mask=~use), k, r], names=["doc_id", "n", "own", "m", "node", "keys", "r"])

    return packed.mapInArrow(frugal(build), SETS)


def passes(inter: int, a: int, b: int, percent: int) -> bool:
    return 100 * inter >= percent * (a + b - inter)


def lead(nodes: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) of nodes to leaders of their chunks, for minimum hashes that many nodes share."""
    keyed = nodes.select("node", F.pmod(F.xxhash64("node"), F.lit(SPREAD)).alias("salt"), F.posexplode("keys").alias("i", "key"))
    many = keyed.groupBy("i", "key").agg(F.count("*").alias("c")).where(F.col("c") > FEW)
    many = many.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))  # a hash that a large group shares is many join keys
    chunked = keyed.join(many, ["i", "key", "salt"]).select("node", "i", "key", F.pmod(F.xxhash64("node", "i"), F.ceil(F.col("c") / CHUNK)).alias("chunk"))
    met = chunked.join(nodes.select("node", "n", "r"), "node")
    met = met.repartition(F.col("key"), F.col("chunk")).sortWithinPartitions("i", "key", "chunk", "n", "node").select("i", "key", "chunk", "node", "n", "r")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaders = None, []
        for batch in batches:
            a, b = [], []
            nodes_, sizes = batch.column("node").to_pylist(), batch.column("n").to_pylist()
            lists = batch.column("r")
            for j, group in enumerate(zip(*(batch.column(c).to_pylist() for c in ("i", "key", "chunk")), strict=True)):
                if group != at:
                    at, leaders = group, []
                mine, n, node = set(lists[j].values.to_numpy().tolist()), sizes[j], nodes_[j]
                found = False
                for other, size, theirs in leaders:
                    if 100 * size >= percent * n and passes(len(mine & theirs), n, size, percent):
                        a.append(node), b.append(other)
                        found = True
                if not found and len(leaders) < LEADERS:
                    leaders.append((node, n, mine))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return met.mapInArrow(frugal(link), "a long, b long")


def candidates(groups: DataFrame, percent: int, brief: bool = False) -> DataFrame:
    """Pairs of groups (g, h) of different components that share a prefix element, with sizes and positions that allow a link.

    brief: not all, but for each element, of a component with at least FEW groups in its list,
    REPRESENTATIVES (by a hash of element and group) for each group of a component with fewer.
    """
    listed = groups.select("g", "label", "n", "own", F.posexplode("prefix").alias("at", "e")).select("e", "g", "label", "n", (F.col("own") + F.col("at")).alias("pos"))
    several = listed.groupBy("e").agg(F.count("*").alias("c"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("e", F.ceil(F.col("c") / BLOCK).cast("int").alias("s"))
    met = listed.hint("merge").join(several.hint("merge"), "e").withColumn("own_block", F.pmod(F.xxhash64("g"), F.col("s")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    met = met.select("e", F.least("own_block", "other").alias("lo"), F.greatest("own_block", "other").alias("hi"), "own_block", "g", "label", "n", "pos")
    met = met.repartition(F.col("e"), F.col("lo"), F.col("hi")).sortWithinPartitions("e", "lo", "hi")

    def pair(block: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
        e, lo, hi, mine, g, label, n, pos = block
        if len(g) < 2 or label.min() == label.max():
            return None
        if brief:
            return few(e[0], g, label, n) if lo[0] == hi[0] else None
        left = np.flatnonzero(mine == lo[0])
        right = np.flatnonzero(mine == hi[0])
        x, y = n[left][:, None], n[right][None, :]
        need = -(-percent * (x + y) // (100 + percent))
        ok = (label[left][:, None] != label[right][None, :]) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (np.minimum(x - pos[left][:, None], y - pos[right][None, :]) >= need)
        if lo[0] == hi[0]:
            ok &= g[left][:, None] < g[right][None, :]
        i, j = np.nonzero(ok)
        a, b = g[left[i]], g[right[j]]
        return np.minimum(a, b), np.maximum(a, b)

    def few(e: int, g: np.ndarray, label: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        kinds, where, count = np.unique(label, return_inverse=True, return_counts=True)
        rank = mix64((g ^ e).view(U))
        a, b = [], []
        for k in np.flatnonzero(count >= FEW).tolist():
            inside_ = np.flatnonzero(where == k)
            chosen = inside_[np.argsort(rank[inside_])[:REPRESENTATIVES]]
            others = np.flatnonzero((count[where] < count[k]) | (count[where] == count[k]) & (where < k))
            for c in chosen.tolist():
                fit = others[100 * np.minimum(n[others], n[c]) >= percent * np.maximum(n[others], n[c])]
                a.append(g[fit]), b.append(np.full(len(fit), g[c]))
        if not a:
            return None
        x, y = np.concatenate(a), np.concatenate(b)
        return np.minimum(x, y), np.maximum(x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def emit() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            out.clear()
            both = np.unique(np.stack((a, b)), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["g", "h"])

        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1]) | (now[2][1:] != now[2][:-1])) + 1
            edges = [0, *cut.tolist()]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if (found := pair([x[a:b] for x in now])) is not None:
                    out.append(found)
            held = [x[edges[-1] :] for x in now]
            if sum(len(x) for x, _ in out) > 1 << 20:
                yield emit()
        if held is not None and (found := pair(held)) is not None:
            out.append(found)
        if out:
            yield emit()

    return met.mapInArrow(frugal(run), "g long, h long").distinct()


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the threshold."""
    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("r").alias("ra"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("r").alias("rb"))
    both = pairs.join(one, "a").join(two, "b").withColumn("i", F.size(F.array_intersect("ra", "rb")).cast("long"))
    return both.where(F.col("i") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b")


def _sets(df: DataFrame, id_col: str, text: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of assemble(), and their nodes: one for each set, with its smallest id."""
    n = prime_from(parts_for(df, PART_BYTES))
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sets = written(assemble(shared_shingles(docs, n, words), percent), "sets")
    return sets, written(sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc"), *(F.first(c).alias(c) for c in ("n", "own", "m", "keys", "r"))), "nodes")


def links(df: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All links: (a, b) with a < b, smallest ids of two classes of documents whose sets reach the threshold; and membership, (doc_id, class_id, n_shingles) of every document.

    A class is the documents of one set (a document without n-grams is its own); within it all link
    (copies are not expanded into pairs). Every pair of groups that may link is expanded and
    verified, whatever component it is in: the work grows with the number of links, where link()
    stops at components. Rows are taken as link() takes them.
    """
    sets, nodes = _sets(df, id_col, text, words, percent)
    grouped = nodes.select("node", "n", "own", F.slice("r", 1, F.col("m")).alias("prefix")).select("*", F.xxhash64("prefix", "n").alias("g"))
    groups = grouped.groupBy("g").agg(F.first("g").alias("label"), *(F.first(c).alias(c) for c in ("n", "own", "prefix")))
    ids = grouped.select("g", "node")
    one, two = ids.withColumnRenamed("node", "a"), ids.withColumnRenamed("node", "b")
    between = candidates(groups, percent).join(one, "g").join(two.withColumnRenamed("g", "h"), "h").select("a", "b")
    within = one.join(two, "g").where("a < b").select("a", "b")
    found = verified(between.unionAll(within), nodes, percent)
    name = nodes.select("node", "doc")
    named = found.join(name.toDF("a", "x"), "a").join(name.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return named, sets.join(name, "node", "left").select("doc_id", F.coalesce("doc", "doc_id").alias("class_id"), F.col("n").alias("n_shingles"))


def count_links(df: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (documents that link with it, copies included) of every document, by links()."""
    pairs, member = links(df, id_col, text, words, percent)
    pairs, member = written(pairs, "pairs"), written(member, "member")
    size = member.groupBy("class_id").agg(F.count("*").alias("c"))
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(size.toDF("b", "c"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("c").alias("others"))
    roots = components(pairs).select(F.col("node").alias("class_id"), "root")
    each = size.join(others, "class_id", "left").join(roots, "class_id", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("c") - 1 + F.coalesce("others", F.lit(0))).otherwise(F.lit(0).cast("long"))
    return member.join(each, "class_id").select("doc_id", "n_shingles", F.coalesce("root", "class_id").alias("component_id"), own.alias("n_links"))


def link(df: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document (class of the similarity join).

    Null, empty or wordless text has no n-grams and links with nothing (its own id). Rows with a
    null id are not returned; rows that share an id are one document whose set is the union.
    Other columns are ignored. component_id is the smallest id reachable by links.
    """
    sets, nodes = _sets(df, id_col, text, words, percent)
    alone = sets.where("node is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    member = sets.where("node is not null")
    roots = written(components(lead(nodes, percent)), "led")
    for brief in (True, False):
        grouped = nodes.join(roots, "node", "left").select("node", "n", "own", F.slice("r", 1, F.col("m")).alias("prefix"), F.coalesce("root", "node").alias("label"))
        grouped = grouped.select("*", F.xxhash64("prefix", "n", "label").alias("g"))
        groups = grouped.groupBy("g").agg(*(F.first(c).alias(c) for c in ("label", "n", "own", "prefix")))
        ids = grouped.select("g", "node")
        pairs = candidates(groups, percent, brief)
        expanded = pairs.join(ids.withColumnRenamed("node", "a"), "g").join(ids.select(F.col("g").alias("h"), F.col("node").alias("b")), "h").select("a", "b")
        found = written(verified(expanded, nodes, percent), "links")
        if not found.isEmpty():
            roots = components(found.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    placed = nodes.select("node", "doc").join(roots, "node", "left").select("node", "doc", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("doc").alias("component_id"))
    where = placed.join(least, "root").select("node", "component_id")
    return member.select("doc_id", F.col("n").alias("n_shingles"), "node").join(where, "node").select("doc_id", "n_shingles", "component_id").unionAll(alone)
