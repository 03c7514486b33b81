"""Operator 9: approximate nearest neighbours by NN-descent and greedy graph search.

Nearness is the largest inner product. Equal vectors are one node (they are each other's ties),
which knows its smallest MEMBERS ids. Nodes are dealt to parts by id; a part's nodes, their
vectors in 8 bits a component and their neighbour lists are one packed row, so an iteration of
NN-descent is two shuffles of packed rows, each a join by node:

- every node sends itself to its neighbours, so that each node learns whose list it is in;
- there, the neighbours of neighbours meet: those who list a node are compared with each other
  and with its own neighbours, and each gets the best few that would enter its list;
- every node merges what it got.

Lists start with random company. Of those that list a node, at most REVERSE (by a hash) take
part in an iteration: the method is approximate, and its recall is measured against brute force.
Iterations end when lists hardly change (SETTLED), so larger tables get more of them.

Search keeps a beam for each query, wider with the root of the number of nodes, and expands the best unexpanded ones in rounds:
a round sends the query to the parts of these nodes, whose stored neighbours answer with what
would enter the beam. It starts from the query's own node, where it is one, and from ENTRIES
fixed nodes (the only vectors that are broadcast). The REFINE best are scored again on the
original vectors in double precision, and nodes give way to their ids, ties to the smaller.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .packed import SCHEMA, deal, pack, rows, split_by, unpack
from .substring_dedup import _tag, part_of_ids, prime_from
from .words import U, mix64
from .work import drop, shared_dir

NEIGHBOURS, OFFERS, REVERSE, COMPANY = 16, 4, 20, 24
#: Iterations go on until fewer than this share of all list entries are new, or so many are done.
SETTLED, ROUNDS = 0.01, 15
#: A beam is the larger of BEAM nodes and BEAM_ROOT times the root of the number of nodes.
BEAM, BEAM_ROOT, EXPAND, ENTRIES, REFINE = 600, 2.65, 100, 32, 64
#: Nodes of a part: a number of parts (PARTS) up to the larger size, as every part sends to every other; places that a task works on at once.
PART_NODES, PARTS, TOGETHER = (1024, 8192), 24, 512
STATE, MEET, OFFER, REPLY, CHANGED = 0, 1, 2, 3, 4


def _quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = (np.abs(v).max(axis=1) / 127).astype(np.float32)
    return np.rint(v / np.maximum(scale, 1e-300)[:, None].astype(float)).clip(-127, 127).astype(np.int8), scale


def _shuffled(ids: np.ndarray, salt: int) -> np.ndarray:
    return mix64(ids.view(U) ^ mix64(np.array([salt + 1], dtype=U)))


class Part:
    """The nodes of a part: ids (ascending), q, scale; lists of neighbours (-1: none), their similarities and vectors."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, scale: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None) -> None:
        m, d = len(ids), q.shape[1]
        k = NEIGHBOURS
        self.ids, self.q, self.scale = ids, q, scale
        self.near, self.sim, self.nq, self.ns = lists or (np.full((m, k), -1, dtype=np.int64), np.full((m, k), -np.inf, dtype=np.float32), np.zeros((m, k, d), dtype=np.int8), np.zeros((m, k), dtype=np.float32))

    def pack(self, kind: int = STATE) -> bytes:
        return pack(np.array([kind, self.q.shape[1], self.near.shape[1]]), self.ids, self.q.ravel(), self.scale, self.near.ravel(), self.sim.ravel(), self.nq.ravel(), self.ns.ravel())

    @classmethod
    def of(cls, head: np.ndarray, arrays: list[np.ndarray]) -> Part:
        d, k = int(head[1]), int(head[2])
        ids, q, scale, near, sim, nq, ns = arrays
        m = len(ids)
        return cls(ids, q.reshape(m, d), scale, (near.reshape(m, k), sim.reshape(m, k), nq.reshape(m, k, d), ns.reshape(m, k)))


def _send(n: int, target: np.ndarray, kind: int, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Arrays by the part of their target id; a vector array is flattened."""
    order, cut = split_by(part_of_ids(target, n), n)
    for p in np.flatnonzero(np.diff(cut)).tolist():
        at = order[cut[p] : cut[p + 1]]
        yield rows([p], [pack(_tag(kind), target[at], *(a[at].ravel() for a in arrays))])


def _collect(batches: Iterator[pa.RecordBatch]) -> tuple[list[Part], dict[int, list[list[np.ndarray]]]]:
    parts, rest = [], {}
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            head, *arrays = unpack(blob)
            if head[0] == STATE:
                parts.append(Part.of(head, arrays))
            else:
                rest.setdefault(int(head[0]), []).append(arrays)
    return parts, rest


def _joined(parts: list[Part]) -> Part | None:
    if not parts:
        return None
    if len(parts) == 1:
        return parts[0]
    ids = np.concatenate([p.ids for p in parts])
    order = np.argsort(ids)
    return Part(ids[order], *(np.concatenate([getattr(p, a) for p in parts])[order] for a in ("q", "scale")), tuple(np.concatenate([getattr(p, a) for p in parts])[order] for a in ("near", "sim", "nq", "ns")))


def _merge(part: Part, offers: list[list[np.ndarray]]) -> Part:
    """The lists with what is offered (node, other, similarity, vector, scale): the best NEIGHBOURS, each once."""
    d, k = part.q.shape[1], part.near.shape[1]
    node, other, sim, q, s = (np.concatenate([o[i] for o in offers]) if offers else np.zeros(0) for i in range(5))
    at = np.searchsorted(part.ids, node.astype(np.int64))
    have = part.near >= 0
    at = np.concatenate((np.nonzero(have)[0], at))
    other = np.concatenate((part.near[have], other.astype(np.int64)))
    sim = np.concatenate((part.sim[have], sim.astype(np.float32)))
    q = np.concatenate((part.nq[have], q.astype(np.int8).reshape(-1, d)))
    s = np.concatenate((part.ns[have], s.astype(np.float32)))
    order = np.lexsort((other, at))
    keep = np.ones(len(order), dtype=bool)
    keep[1:] = (at[order[1:]] != at[order[:-1]]) | (other[order[1:]] != other[order[:-1]])
    order = order[keep]
    order = order[np.lexsort((other[order], -sim[order], at[order]))]
    place = np.arange(len(order)) - np.searchsorted(at[order], at[order])
    order, place = order[place < k], place[place < k]
    new = Part(part.ids, part.q, part.scale)
    row = at[order]
    new.near[row, place], new.sim[row, place], new.nq[row, place], new.ns[row, place] = other[order], sim[order], q[order], s[order]
    return new


def _meet(u_ids: np.ndarray, u_q: np.ndarray, guests: list[np.ndarray], worst: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offers among candidates (ids, float vectors): for each guest (a place in them), the best few others above its worst."""
    g = guests
    m = u_q[g] @ u_q.T
    m[u_ids[g][:, None] == u_ids[None, :]] = -np.inf
    m[m <= worst[:, None]] = -np.inf
    k = min(most, m.shape[1])
    best = np.argpartition(-m, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(m, best, axis=1)
    ok = value > -np.inf
    return np.broadcast_to(np.asarray(g)[:, None], best.shape)[ok], best[ok], value[ok]


def _met(part: Part, hosts: np.ndarray, first: np.ndarray, ids: np.ndarray, worst: np.ndarray, q: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
    """_meet() at many nodes at once: candidates (ids, vectors, scales: guests and neighbours of each host, end to end) and offers (guest and other, as places in them, and similarity)."""
    count = np.diff(first)[hosts]
    g, k, d = int(count.max()), part.near.shape[1], q.shape[1]
    here = np.arange(g) < count[:, None]
    at = np.where(here, first[hosts][:, None] + np.arange(g), 0)
    i = np.concatenate((np.where(here, ids[at], -1), part.near[hosts]), axis=1)
    x = np.concatenate((q[at], part.nq[hosts]), axis=1)
    y = np.concatenate((s[at], part.ns[hosts]), axis=1)
    there = i >= 0
    there[:, g:] &= ~(i[:, g:, None] == i[:, None, :g]).any(axis=2)  # a neighbour that is a guest too is there once
    v = x.astype(np.float32) * y[:, :, None]
    m = v[:, :g] @ v.transpose(0, 2, 1)
    m[~there[:, None, :] | (i[:, :g, None] == i[:, None, :]) | (m <= np.where(here, worst[at], np.inf)[:, :, None])] = -np.inf
    most = min(OFFERS, g + k)
    best = np.argpartition(-m, most - 1, axis=2)[:, :, :most]
    value = np.take_along_axis(m, best, axis=2)
    ok = value > -np.inf
    base = (np.arange(len(hosts)) * (g + k))[:, None, None]
    return i.ravel(), x.reshape(-1, d), y.ravel(), np.broadcast_to(base + np.arange(g)[None, :, None], best.shape)[ok], (base + best)[ok], value[ok]


def _offers(n: int, out: list, ids: list, q: list, s: list) -> Iterator[pa.RecordBatch]:
    if out:
        i, j, v = (np.concatenate(x) for x in zip(*out, strict=True))
        a, b, c = np.concatenate(ids), np.concatenate(q), np.concatenate(s)
        yield from _send(n, a[i], OFFER, a[j], v.astype(np.float32), b[j], c[j])


def _random_company(df: DataFrame, n: int, buckets: int, d: int) -> DataFrame:
    """States of parts whose lists are of random company: nodes that share one of two random buckets."""

    def invite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("node").to_numpy()
            q, s = _quantised(batch.column("vec").values.to_numpy().reshape(len(ids), d))
            order, cut = split_by(part_of_ids(ids, n), n)
            for p in np.flatnonzero(np.diff(cut)).tolist():
                at = order[cut[p] : cut[p + 1]]
                at = at[np.argsort(ids[at])]
                yield rows([p], [Part(ids[at], q[at], s[at]).pack()])
            for salt in (1, 2):
                bucket = (_shuffled(ids, salt) % U(buckets)).astype(np.int64) * 2 + salt - 1
                yield from _send(n, bucket, MEET, ids, q, s)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rest = _collect(batches)
        for p in parts:
            yield rows([int(part_of_ids(p.ids[:1], n)[0])], [p.pack()])
        met = rest.get(MEET, [])
        if not met:
            return
        bucket, ids, q, s = (np.concatenate([x[i] for x in met]) for i in range(4))
        q = q.reshape(len(ids), d)
        order = np.lexsort((ids, bucket))
        cuts = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1], [True])))
        out, held = [], 0
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at = order[a:b]
            if b - a > 1:
                i, j, v = _meet(ids[at], q[at].astype(np.float32) * s[at][:, None], np.arange(len(at)), np.full(len(at), -np.inf, dtype=np.float32), NEIGHBOURS // 2)
                out.append((at[i], at[j], v))
                held += len(v)
            if held > 1 << 18:
                yield from _offers(n, out, [ids], [q], [s])
                out, held = [], 0
        yield from _offers(n, out, [ids], [q], [s])

    invited = deal(df.mapInArrow(invite, SCHEMA), n)
    return _merged(invited.mapInArrow(meet, SCHEMA), n)


def _merged(sent: DataFrame, n: int) -> DataFrame:
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rest = _collect(batches)
        part = _joined(parts)
        if part is not None:
            new = _merge(part, rest.get(OFFER, []))
            both = np.concatenate([np.where(x.near >= 0, x.near, -1 - np.arange(x.near.shape[1])) for x in (part, new)], axis=1)
            both.sort(axis=1)
            old = np.count_nonzero((both[:, 1:] == both[:, :-1]) & (both[:, 1:] >= 0))  # entries that stay
            place = int(part_of_ids(part.ids[:1], n)[0])
            yield rows([place, place], [new.pack(), pack(_tag(CHANGED), np.array([np.count_nonzero(new.near >= 0) - old]))])

    return deal(sent, n).mapInArrow(merge, SCHEMA)


def _reverse(state: DataFrame, n: int) -> DataFrame:
    """Every state, and every node sent to its neighbours with the worst similarity of its list."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _ = _collect(batches)
        for p in parts:
            yield rows([int(part_of_ids(p.ids[:1], n)[0])], [p.pack()])
            row, col = np.nonzero(p.near >= 0)
            target = p.near[row, col]
            rank = _shuffled(p.ids[row] * 31 + target, 3)  # of one part, no more than a node can use
            order = np.lexsort((rank, target))
            place = np.arange(len(order)) - np.searchsorted(target[order], target[order])
            at = order[place < REVERSE]
            row = row[at]
            worst = np.where((p.near >= 0).all(axis=1), p.sim.min(axis=1), -np.inf).astype(np.float32)
            yield from _send(n, target[at], MEET, p.ids[row], worst[row], p.q[row], p.scale[row])

    return deal(state.mapInArrow(send, SCHEMA), n)


def _guests(part: Part, met: list[list[np.ndarray]], salt: int) -> tuple[np.ndarray, ...]:
    """Those who list each node of the part, at most REVERSE each: bounds by node, ids, worst, vectors, scales."""
    d = part.q.shape[1]
    target, ids, worst, q, s = (np.concatenate([x[i] for x in met]) for i in range(5))
    at = np.searchsorted(part.ids, target)
    order = np.lexsort((_shuffled(ids * 31 + target, salt), at))
    place = np.arange(len(order)) - np.searchsorted(at[order], at[order])
    order = order[place < REVERSE]
    return np.searchsorted(at[order], np.arange(len(part.ids) + 1)), ids[order], worst[order], q.reshape(-1, d)[order], s[order]


def _descend(state: DataFrame, n: int, salt: int) -> DataFrame:
    """One iteration of NN-descent."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rest = _collect(batches)
        part = _joined(parts)
        if part is None:
            return
        yield rows([int(part_of_ids(part.ids[:1], n)[0])], [part.pack()])
        if MEET not in rest:
            return
        first, ids, worst, q, s = _guests(part, rest[MEET], salt)
        hosts = np.flatnonzero(np.diff(first))
        out, all_ids, all_q, all_s, base, held = [], [], [], [], 0, 0
        for low in range(0, len(hosts), TOGETHER):
            i, x, y, guest, other, value = _met(part, hosts[low : low + TOGETHER], first, ids, worst, q, s)
            out.append((guest + base, other + base, value))
            all_ids.append(i), all_q.append(x), all_s.append(y)
            base += len(i)
            held += len(value)
            if held > 1 << 18:
                yield from _offers(n, out, all_ids, all_q, all_s)
                out, all_ids, all_q, all_s, base, held = [], [], [], [], 0, 0
        yield from _offers(n, out, all_ids, all_q, all_s)

    return _merged(_reverse(state, n).mapInArrow(meet, SCHEMA), n)


def _stored(state: DataFrame, n: int) -> DataFrame:
    """States whose lists also have those who list the node, so that search can go either way."""

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rest = _collect(batches)
        part = _joined(parts)
        if part is None:
            return
        wide = Part(part.ids, part.q, part.scale, tuple(np.concatenate((x, f), axis=1) for x, f in zip((part.near, part.sim, part.nq, part.ns), (lambda m, d: (np.full((m, REVERSE), -1, dtype=np.int64), np.full((m, REVERSE), -np.inf, dtype=np.float32), np.zeros((m, REVERSE, d), dtype=np.int8), np.zeros((m, REVERSE), dtype=np.float32)))(*part.q.shape), strict=True)))
        if MEET in rest:
            first, ids, _, q, s = _guests(part, rest[MEET], 0)
            row = np.repeat(np.arange(len(part.ids)), np.diff(first))
            col = NEIGHBOURS + np.arange(len(ids)) - first[row]
            wide.near[row, col], wide.nq[row, col], wide.ns[row, col] = ids, q, s
        yield rows([int(part_of_ids(part.ids[:1], n)[0])], [wide.pack()])

    return _reverse(state, n).mapInArrow(widen, SCHEMA)


class Index:
    """Every usable vector of a table in a neighbour graph. nodes: node, vec, members; store: the packed parts."""

    def __init__(self, df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", members: int = 21, rounds: int = ROUNDS) -> None:
        spark = df.sparkSession
        self.spark, self.members = spark, members
        whole = usable(df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where("id is not null"))
        lengths = whole.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
        self.d = d = int(lengths.d) if lengths else 0  # the commonest length, the longer of equally common ones
        whole = whole.where(F.size("vec") == d)
        least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

        def once(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
            """Equal vectors as one row with their smallest ids, of a batch or (last) of all batches."""
            seen: dict[bytes, np.ndarray] = {}
            for batch in batches:
                x = np.ascontiguousarray(batch.column("vec").values.to_numpy().reshape(batch.num_rows, d)) + 0.0
                flat, off = batch.column("ids").values.to_numpy(), batch.column("ids").offsets.to_numpy()
                for i, v in enumerate(x):
                    key, own = v.tobytes(), flat[off[i] : off[i + 1]]
                    seen[key] = np.unique(np.concatenate((seen[key], own)))[:members] if key in seen else own
                if not last:
                    yield made(seen)
                    seen = {}
            if last and seen:
                yield made(seen)

        def made(seen: dict[bytes, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([int(v[0]) for v in seen.values()], pa.int64()), pa.array([np.frombuffer(k) for k in seen], pa.list_(pa.float64())), pa.array(list(seen.values()), pa.list_(pa.int64()))], names=["node", "vec", "ids"])

        kinds = "node long, vec array<double>, ids array<long>"
        few = whole.select("vec", F.array("id").alias("ids")).mapInArrow(lambda b: once(b, False), kinds)
        self.path = shared_dir(spark)
        few.repartition(least, F.xxhash64("vec")).select("vec", "ids").mapInArrow(lambda b: once(b, True), kinds).withColumnRenamed("ids", "members").write.parquet(f"{self.path}/nodes")
        self.nodes = spark.read.parquet(f"{self.path}/nodes")
        self.size = self.nodes.count()
        each = min(max(PART_NODES[0], self.size // PARTS), PART_NODES[1])
        self.n = prime_from(max(4, -(-self.size // each)))  # by size alone: packed rows go from every part to every part
        state = self._written(_random_company(self.nodes.select("node", "vec"), self.n, max(1, self.size // COMPANY), d), "graph0")
        self.rounds = 0
        for i in range(rounds):
            state = self._written(_descend(state, self.n, i + 5), f"graph{i + 1}")
            drop(spark, f"{self.path}/graph{i}")
            self.rounds = i + 1
            new = state.where(F.octet_length("blob") < 256).mapInArrow(_changed, "n long").agg(F.sum("n")).first()[0] or 0
            if new < SETTLED * NEIGHBOURS * self.size:
                break
        self.store = self._written(_stored(state, self.n), "store")
        drop(spark, f"{self.path}/graph{self.rounds}")
        self.width = max(BEAM, int(BEAM_ROOT * self.size**0.5))

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        _release(self.spark)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{name}")

    def search(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """(query_id, rank, vec_id, score) of queries (query_id, vec array<double>): the k nearest found but the row with the query's own id."""
        spark, n, d, width = self.spark, self.n, self.d, self.width
        hashed = self.nodes.select("node", "vec", F.xxhash64("vec").alias("h"))
        asked = usable(queries.select("query_id", "vec")).where(F.size("vec") == d).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))
        own = asked.withColumn("h", F.xxhash64("vec")).join(hashed.select("h", "node", F.col("vec").alias("v")), "h", "left").where("v is null or v = vec").select("query_id", "vec", F.coalesce("node", F.lit(-1)).alias("own"))
        own = asked.join(own.select("query_id", "own"), "query_id", "left").select("query_id", "vec", F.coalesce("own", F.lit(-1)).alias("own"))
        entries = self.nodes.orderBy(F.xxhash64("node", F.lit(9)), "node").limit(ENTRIES).select("node", "vec").collect()
        if not entries:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        e_ids, e_vec = np.array([r.node for r in entries], dtype=np.int64), np.array([r.vec for r in entries])

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = batch.column("vec").values.to_numpy().reshape(batch.num_rows, d)
                q, s = _quantised(v)
                x = q.astype(np.float32) * s[:, None]
                sims = x @ e_vec.T.astype(np.float32)
                own_, ids = batch.column("own").to_numpy(), batch.column("query_id").to_numpy()
                beams = [_Beam(width, int(i), a, b, np.append(e_ids, o) if o >= 0 and o not in e_ids else e_ids, np.append(m, np.float32(a.astype(np.float32) @ a * b * b)) if o >= 0 and o not in e_ids else m) for i, a, b, o, m in zip(ids, q, s, own_, sims, strict=True)]
                yield from _pack_beams(beams, n)

        state = self._written(own.mapInArrow(start, SCHEMA), "beam0")
        store = self.store.repartition(max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), "part").persist()  # at least the default, so that rounds keep its partitioning
        turn = 0
        while True:
            asks = state.mapInArrow(lambda b: _asks(b, n), SCHEMA)
            replies = store.groupBy("part").cogroup(asks.groupBy("part")).applyInArrow(lambda left, right: _answers(left, right, n), SCHEMA)
            new = deal(state.mapInArrow(_kept, SCHEMA).unionAll(replies), n).mapInArrow(lambda b: _updated(b, n), SCHEMA)
            new = self._written(new, f"beam{turn + 1}")
            drop(spark, f"{self.path}/beam{turn}")
            state, turn = new, turn + 1
            if state.mapInArrow(_open, "n long").agg(F.sum("n")).first()[0] in (0, None):
                break
        store.unpersist()
        found = state.mapInArrow(_best, "query_id long, node long")
        scored = found.join(self.nodes, "node").join(asked.withColumnRenamed("vec", "q"), "query_id")
        score = F.aggregate(F.zip_with("vec", "q", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
        each = scored.select("query_id", score.alias("score"), F.explode("members").alias("vec_id")).where("vec_id <> query_id")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable(df: DataFrame) -> DataFrame:
    """Rows whose `vec` is neither null nor zero and holds no null or non-finite component."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))


def _release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs whose results are written."""
    gc.collect()
    spark._jvm.System.gc()


class _Beam:
    """A query's beam: nodes with similarities, best first, and which are expanded."""

    def __init__(self, width: int, query: int, q: np.ndarray, scale: float, ids: np.ndarray, sim: np.ndarray, done: np.ndarray | None = None) -> None:
        self.width, self.query, self.q, self.scale, self.ids, self.sim = width, query, q, scale, ids, sim
        self.done = np.zeros(len(ids), dtype=bool) if done is None else done

    def add(self, ids: np.ndarray, sim: np.ndarray) -> None:
        ids, at = np.unique(np.concatenate((self.ids, ids)), return_index=True)
        sim, done = np.concatenate((self.sim, sim))[at], np.concatenate((self.done, np.zeros(len(sim), dtype=bool)))[at]
        best = np.lexsort((ids, -sim))[: self.width]
        self.ids, self.sim, self.done = ids[best], sim[best], done[best]

    def next(self) -> np.ndarray:
        return np.flatnonzero(~self.done)[:EXPAND]

    def worst(self) -> float:
        return float(self.sim.min()) if len(self.ids) >= self.width else -np.inf


def _pack_beams(beams: list[_Beam], n: int) -> Iterator[pa.RecordBatch]:
    by: dict[int, list[_Beam]] = {}
    for b in beams:
        by.setdefault(int(part_of_ids(np.array([b.query]), n)[0]), []).append(b)
    for p, some in by.items():
        yield rows([p], [pack(np.array([STATE, some[0].width]), np.array([b.query for b in some]), np.concatenate([b.q for b in some]), np.array([b.scale for b in some], dtype=np.float32), np.array([len(b.ids) for b in some]), np.concatenate([b.ids for b in some]), np.concatenate([b.sim for b in some]).astype(np.float32), np.concatenate([b.done for b in some]).astype(np.uint8))])


def _unpack_beams(head: np.ndarray, arrays: list[np.ndarray]) -> list[_Beam]:
    query, q, scale, size, ids, sim, done = arrays
    q, off = q.reshape(len(query), -1), np.concatenate(([0], np.cumsum(size)))
    return [_Beam(int(head[1]), int(query[i]), q[i], float(scale[i]), ids[off[i] : off[i + 1]], sim[off[i] : off[i + 1]], done[off[i] : off[i + 1]].astype(bool)) for i in range(len(query))]


def _beams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[_Beam]]]:
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            head, *arrays = unpack(blob)
            yield part, _unpack_beams(head, arrays)


def _asks(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """For each part, the queries that expand nodes of it: query, vector, worst similarity of the beam, nodes."""
    for _, beams in _beams(batches):
        nodes = [b.ids[b.next()] for b in beams]
        who, ids = np.repeat(np.arange(len(beams)), [len(x) for x in nodes]), np.concatenate(nodes)
        query, scale, worst = np.array([b.query for b in beams]), np.array([b.scale for b in beams], dtype=np.float32), np.array([b.worst() for b in beams], dtype=np.float32)
        q = np.stack([b.q for b in beams])
        order, cut = split_by(part_of_ids(ids, n), n)  # stable: by part, then by beam
        for p in np.flatnonzero(np.diff(cut)).tolist():
            at = order[cut[p] : cut[p + 1]]
            start = np.flatnonzero(np.diff(who[at], prepend=-1))
            b = who[at[start]]
            yield rows([p], [pack(_tag(MEET), query[b], q[b].ravel(), scale[b], worst[b], np.diff(start, append=len(at)), ids[at])])


def _answers(left: pa.Table, right: pa.Table, n: int) -> pa.Table:
    """What the neighbours of the asked nodes offer the beams: (query, node, similarity), by the query's part."""
    blobs = right.column("blob").to_pylist()
    if not blobs or not left.num_rows:
        return rows([], []).schema.empty_table()
    head, *arrays = unpack(left.column("blob")[0].as_py())
    part = Part.of(head, arrays)
    query, node, sim = [], [], []
    for blob in blobs:
        _, ids, q, scale, worst, size, nodes = unpack(blob)
        q, who, at = q.reshape(len(ids), -1), np.repeat(np.arange(len(ids)), size), np.searchsorted(part.ids, nodes)
        for low in range(0, len(at), TOGETHER):  # asked nodes with their queries
            u, w = at[low : low + TOGETHER], who[low : low + TOGETHER]
            s = np.matmul(part.nq[u].astype(np.float32), q[w].astype(np.float32)[:, :, None])[:, :, 0] * part.ns[u] * scale[w][:, None]
            row, col = np.nonzero((part.near[u] >= 0) & (s > worst[w][:, None]))
            query.append(ids[w[row]]), node.append(part.near[u[row], col]), sim.append(s[row, col])
    out = list(_send(n, np.concatenate(query), REPLY, np.concatenate(node), np.concatenate(sim).astype(np.float32))) if query else []
    return pa.Table.from_batches(out or [rows([], [])])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The beams with the asked nodes marked as expanded."""
    for part, beams in _beams(batches):
        for b in beams:
            b.done = b.done.copy()
            b.done[b.next()] = True
        yield from _pack_beams_at(part, beams)


def _pack_beams_at(part: int, beams: list[_Beam]) -> Iterator[pa.RecordBatch]:
    for batch in _pack_beams(beams, 1):
        yield rows([part], batch.column("blob").to_pylist())


def _updated(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    beams: dict[int, _Beam] = {}
    replies: list[list[np.ndarray]] = []
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            head, *arrays = unpack(blob)
            if head[0] == STATE:
                beams |= {b.query: b for b in _unpack_beams(head, arrays)}
            else:
                replies.append(arrays)
    if replies:
        query, node, sim = (np.concatenate([r[i] for r in replies]) for i in range(3))
        order = np.argsort(query, kind="stable")
        query, node, sim = query[order], node[order], sim[order]
        cuts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1], [True])))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b > a:
                beams[int(query[a])].add(node[a:b], sim[a:b])
    if beams:
        yield from _pack_beams(list(beams.values()), n)


def _changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [unpack(blob) for blob in batch.column("blob").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([int(x[1][0]) for x in found if x[0][0] == CHANGED], pa.int64())], names=["n"])


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, beams in _beams(batches):
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(b.next()) for b in beams)], pa.int64())], names=["n"])


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, beams in _beams(batches):
        for b in beams:
            best = b.ids[np.lexsort((b.ids, -b.sim))[:REFINE]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), b.query)), pa.array(best)], names=["query_id", "node"])


def nearest(df: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found of every row whose id is divisible by `every`.

    Vectors that are null, zero, of another length than the commonest (the longer of two), or that hold a null or
    non-finite component take no part, nor do rows with a null id. Rows that share an id and not
    the vector are rows of their own; the least of their usable vectors (by components, in order)
    asks; a query never finds its own id. Repeated rows count once.
    """
    index = Index(df, id_col, vector, members=k + 1)
    queries = df.where(F.pmod(F.col(id_col).cast("long"), F.lit(every)) == 0).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("vec"))
    asked = usable(queries).where(F.size("vec") == index.d).groupBy("query_id").agg(F.min("vec").alias("vec"))
    return index.search(asked, k)


