"""Invariants and edge cases of the operators on literal clouds."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointwright.functions.columns import argmax, group_softmax, row_softmax
from pointwright.operators import geometry, graph, interp, metrics, sampling, spatial, tiling

SCHEMA = "cloud string, pid long, x double, y double, z double"


def cloud(spark, points, name="a"):
    return spark.createDataFrame([(name, i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(points)], SCHEMA)


@pytest.fixture(scope="module")
def random_cloud():
    return np.random.default_rng(3).uniform(-1, 1, (200, 3)).round(3)


def brute(points, radius):
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    return {(i, j) for i, j in itertools.product(range(len(points)), repeat=2) if d[i, j] < radius}, d


def test_radius_join_is_brute_force(spark, random_cloud):
    c = cloud(spark, random_cloud)
    want, _ = brute(random_cloud, 0.3)
    assert {(r.qid, r.nid) for r in spatial.radius_join(c, c, 0.3).collect()} == want


def test_radius_join_of_copies_searches_places(spark, random_cloud, monkeypatch):
    """Places of 3 points, one of 300 and one whose point has no id: all pairs of points, of which none is made by the search."""
    points = np.concatenate([random_cloud[:40]] * 3 + [random_cloud[:1]] * 297 + [[[0.0, -0.0, 0.0]]] * 2)
    rows = [("a", i if i < len(points) - 1 else None, *map(float, p)) for i, p in enumerate(points)] + [("a", 900, None, 0.0, 0.0), ("a", 901, float("nan"), 0.0, 0.0)]
    c = spark.createDataFrame(rows, SCHEMA)
    searched, found = spatial._searched, []
    monkeypatch.setattr(spatial, "_searched", lambda *a: (found.append(searched(*a)), found[0])[1])
    got = [(r.qid, r.nid, r.dist) for r in spatial.radius_join(c, c, 0.3, digits=6).collect()]
    want, d = brute(points, 0.3)
    name = lambda i: i if i < len(points) - 1 else None
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(((name(i), name(j), float(np.round(d[i, j], 6))) for i, j in want), key=key)
    assert found[0].count() < len(want) / 50


def test_distances_round_halves_up():
    x = np.array([0.5e-6, 1.5e-6, 0.1234565, 1.0, 1e300])
    assert spatial._rounded(x, 6).tolist() == [1e-6, 2e-6, 0.123457, 1.0, 1e300]
    assert spatial._rounded(x, None) is x


@pytest.mark.parametrize("start", [None, 0.1, 5.0])
def test_knn_is_brute_force_at_any_first_size(spark, random_cloud, start):
    c = cloud(spark, random_cloud)
    _, d = brute(random_cloud, 0)
    got = {}
    for r in spatial.knn_join(c, c, 4, start).collect():
        got.setdefault(r.qid, {})[r.pos] = r.nid
    for q in range(len(random_cloud)):
        want = np.lexsort((np.arange(len(d)), d[q]))[:4]
        assert [got[q][i] for i in range(4)] == want.tolist()


def test_knn_of_far_query_and_few_points(spark):
    data, far = cloud(spark, [(0, 0, 0), (1, 0, 0)]), spark.createDataFrame([("a", 9, 100.0, 0.0, 0.0)], SCHEMA)
    assert [(r.nid, r.pos) for r in spatial.knn_join(data, far, 5).orderBy("pos").collect()] == [(1, 0), (0, 1)]


def test_empty_and_single_clouds(spark):
    none, one = cloud(spark, []), cloud(spark, [(1, 2, 3)])
    assert spatial.radius_join(none, none, 1.0).count() == 0
    assert spatial.knn_join(none, one, 3).count() == 0
    assert spatial.knn_join(one, none, 3).count() == 0
    assert [(r.nid, r.dist) for r in spatial.knn_join(one, one, 3).collect()] == [(0, 0.0)]
    assert sampling.fps(none, count=3).count() == 0 and sampling.voxels(none, 0.1).count() == 0
    assert tiling.overlap_tiles(none, 1.2, 1.0).count() == 0


def test_clouds_are_searched_apart(spark):
    c = cloud(spark, [(0, 0, 0)], "a").unionAll(cloud(spark, [(0, 0, 0)], "b"))
    assert spatial.radius_join(c, c, 1.0).where("qid <> nid").count() == 0


def test_ball_query_pads_to_k_with_the_first(spark, random_cloud):
    c = cloud(spark, random_cloud)
    rows = spatial.ball_query(c, c, 0.3, 6).orderBy("qid", "pos").collect()
    want, _ = brute(random_cloud, 0.3)
    for q, group in itertools.groupby(rows, lambda r: r.qid):
        g = list(group)
        assert len(g) == 6 and all((q, r.nid) in want for r in g)
        assert all(r.nid == g[0].nid for r in g[g[0].cnt :])
        assert g[0].cnt == min(6, sum(1 for a, _ in want if a == q))


def test_ball_knn_and_radius_or_knn(spark, random_cloud):
    c = cloud(spark, random_cloud)
    want, d = brute(random_cloud, 0.4)
    ball = {q: {j for i, j in want if i == q} for q in range(len(random_cloud))}
    got = {}
    for r in spatial.ball_knn(c, c, 0.4, 5).collect():
        got.setdefault(r.qid, set()).add(r.nid)
    for q, s in got.items():
        assert len(s) == 5 and (s <= ball[q] if len(ball[q]) >= 5 else s == set(np.argsort(d[q])[:5]))
    either = {}
    for r in spatial.radius_or_knn(c, c, 0.4, 5).collect():
        either.setdefault(r.qid, set()).add(r.nid)
    assert all(s == (ball[q] if len(ball[q]) > 5 else set(np.argsort(d[q])[:5])) for q, s in either.items())


def test_fps_is_unique_and_falls(random_cloud):
    at = sampling.farthest(random_cloud, np.arange(200), 50)
    assert len(set(at.tolist())) == 50 and at[0] == 0
    gaps = [min(np.linalg.norm(random_cloud[at[i]] - random_cloud[at[j]]) for j in range(i)) for i in range(1, 50)]
    assert all(a >= b - 1e-12 for a, b in itertools.pairwise(gaps))


@pytest.mark.parametrize("n", [3, 5, 8])
def test_block_sample_fills_every_slot(spark, n):
    c = cloud(spark, [(i, 0, 0) for i in range(n)])
    rows = sampling.block_sample(c, 5).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(5))
    assert {r.pid for r in rows} <= set(range(n)) and (n > 5 or [r.pid for r in rows][n:] == [0] * (5 - n))


def test_points_on_tile_edges(spark):
    c = cloud(spark, [(0, 0, 0), (1.0, 1.0, 0), (2.0, 2.0, 0)])
    got = {(r.pid, r.i, r.j): r.valid for r in tiling.overlap_tiles(c, 1.2, 1.0).collect()}
    assert got[1, 0, 0] and got[1, 1, 1] and (2, 1, 1) in got and (0, 1, 1) not in got
    t = {r.pid: (r.i, r.j) for r in tiling.tiles(c, 1.0, 0.5).collect()}
    assert t == {0: (0, 0), 1: (1, 1), 2: (2, 2)}


def test_eigen_features_match_numpy(spark, random_cloud):
    c = cloud(spark, random_cloud)
    pairs = spatial.knn_join(c, c, 12)
    near = {}
    for r in pairs.collect():
        near.setdefault(r.qid, []).append(r.nid)
    for r in geometry.features(pairs, c).collect():
        w, v = np.linalg.eigh(np.cov(random_cloud[near[r.qid]].T))
        e = np.abs(w[::-1]) / np.linalg.norm(w)
        assert np.allclose([r.e1, r.e2, r.e3], e, atol=1e-6)
        assert abs(r.e1**2 + r.e2**2 + r.e3**2 - 1) < 1e-9
        assert np.allclose([r.nx, r.ny, r.nz], np.abs(v[:, 0]), atol=1e-4)


@pytest.mark.parametrize("points", [[(0, 0, 0)] * 4, [(i, 0, 0) for i in range(4)], [(i, j, 0) for i in range(2) for j in range(2)], list(itertools.product((0, 1), repeat=3))])
def test_degenerate_neighbourhoods(spark, points):
    c = cloud(spark, points)
    row = geometry.features(spatial.knn_join(c, c, len(points)), c).first()
    assert all(v is not None and v == v for v in (row.e1, row.e2, row.e3))
    if len({p for p in points}) == 4 and all(p[2] == 0 for p in points) and len({p[1] for p in points}) > 1:
        assert abs(row.nz - 1) < 1e-9  # a plane has its normal
    if len(points) == 8:
        assert row.nx is None  # a cube has none


def test_gather_and_scatter_are_adjoint(spark, random_cloud):
    c = cloud(spark, random_cloud).select("*", F.col("x").alias("v"))
    e = spatial.knn_join(c, c, 4)
    y = e.select("cloud", "qid", "nid", (F.col("qid") % 7 + F.col("nid") % 3).cast("double").alias("gr"))
    left = graph.group(y, c, ["v"]).agg(F.sum(F.col("v") * F.col("gr"))).first()[0]
    right = graph.scatter_add(c, y, ["gr"]).join(c, ["cloud", "pid"]).agg(F.sum(F.col("v") * F.col("gr"))).first()[0]
    assert abs(left - right) < 1e-9


def test_softmax_weights_sum_to_one_with_coincident_points(spark):
    c = cloud(spark, [(0, 0, 0), (0, 0, 0), (1, 0, 0), (2, 0, 0)])
    w = interp.softmax_weights(spatial.knn_join(c, c, 3)).groupBy("qid").agg(F.sum("w").alias("s"), F.max("w").alias("m")).collect()
    assert all(abs(r.s - 1) < 1e-12 and r.m == r.m for r in w)


def test_row_and_group_softmax(spark):
    df = spark.createDataFrame([(1, 1000.0, 0.0), (1, 999.0, 5.0)], "k long, a double, b double")
    assert all(abs(sum(r) - 1) < 1e-12 for r in df.select(*row_softmax([F.col("a"), F.col("b")])).collect())
    g = group_softmax(df, ["k"], ["a"]).agg(F.sum("a_w")).first()[0]
    assert abs(g - 1) < 1e-12
    assert [r[0] for r in df.select(argmax([F.col("b"), F.col("a"), F.col("a")])).collect()] == [1, 1]


def test_counts_sum_to_rows_and_absent_class(spark):
    df = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "truth long, pred long")
    rows = {r.class_id: r for r in metrics.iou(metrics.class_counts(df, 5)).collect()}
    assert sum(r.gt for r in rows.values()) == sum(r.pos for r in rows.values()) == 3
    assert rows[4].iou is None and rows[1].iou == 0.5
    assert metrics.iou(metrics.class_counts(df, 5), 1e-8).where("class_id = 4").first().iou == 0
    assert metrics.overall(df.limit(0)).first().oa is None


def test_crf_with_identity_adds_messages(spark, random_cloud):
    c = cloud(spark, random_cloud[:20]).select("*", *[F.col(a).alias(b) for a, b in zip("xyz", "rgb", strict=True)], F.col("x").alias("c0"), F.col("y").alias("c1"))
    e = spatial.knn_join(c, c, 3)
    one, two = (graph.crf(c, e, ["c0", "c1"], rounds=n).join(c.select("pid", F.col("c0").alias("o")), "pid").select((F.col("c0") - F.col("o")).alias("d")).collect() for n in (1, 2))
    assert all(r.d > 0 for r in one) and sum(r.d for r in two) > sum(r.d for r in one)


def test_bad_arguments(spark):
    c = cloud(spark, [(0, 0, 0)])
    with pytest.raises(ValueError):
        graph.pool(spatial.knn_join(c, c, 1), c, ["x"], "median")
    with pytest.raises(ValueError):
        graph.attention(c, spatial.knn_join(c, c, 1), ["x"], [], [], [], [], "other")


def test_knn_with_a_stray_point_compares_few_pairs(spark, monkeypatch):
    """One far point does not make cells wide: the start follows the density, and the result is exact."""
    rng = np.random.default_rng(12)
    xyz = np.concatenate((rng.random((900, 3)), [[5000.0, 0, 0]]))
    df = spark.createDataFrame([("a", i, *map(float, p)) for i, p in enumerate(xyz)], "cloud string, pid long, x double, y double, z double")
    sizes, search = [], spatial._searched
    monkeypatch.setattr(spatial, "_searched", lambda data, queries, radius, *rest: (sizes.append(radius), search(data, queries, radius, *rest))[1])
    got = spatial.knn_join(df, df, 4).toPandas()
    assert sizes[0] < 1
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2))
    for q, g in got.groupby("qid"):
        assert g.sort_values("pos").nid.tolist() == np.lexsort((np.arange(len(xyz)), d[q]))[:4].tolist()


def test_crowded_cells_are_split(spark, monkeypatch):
    """Blocks of a few points give what whole cells give; a null place is near nothing."""
    rng = np.random.default_rng(13)
    xyz = rng.random((300, 3))
    df = spark.createDataFrame([("a", i, *map(float, p), float(i % 7)) for i, p in enumerate(xyz)] + [("a", 999, None, 0.5, 0.5, 1.0)], "cloud string, pid long, x double, y double, z double, intensity double")
    whole = {(r.qid, r.nid) for r in spatial.radius_join(df, df, 0.3).collect()}
    monkeypatch.setattr(spatial, "BLOCK", 8)
    monkeypatch.setattr(spatial, "AT_ONCE", 50)
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2))
    want = set(zip(*(x.tolist() for x in np.nonzero(d < 0.3))))
    assert {(r.qid, r.nid) for r in spatial.radius_join(df, df, 0.3).collect()} == whole == want
    for r in spatial.radius_moments(df, df, 0.3, ("intensity", "x")).collect():
        near = np.flatnonzero(d[r.qid] < 0.3)
        both = np.cov(near % 7, xyz[near, 0], bias=True) * len(near)
        assert r.n == len(near) and np.allclose([r.c_intensity_intensity, r.c_intensity_x, r.c_x_x], [both[0, 0], both[0, 1], both[1, 1]])


def test_network_against_loops(spark):
    """The whole network with given weights, point by point."""
    from pointwright.plans.graph_queries import NETWORK

    rng = np.random.default_rng(14)
    xyz, f = rng.random((40, 3)), rng.normal(size=(40, 4))
    levels = [(4, 0.5, 6), (1, 0.9, 5)]
    df = spark.createDataFrame([("a", i, *map(float, xyz[i]), *map(float, f[i])) for i in range(40)], "cloud string, pid long, x double, y double, z double, f0 double, f1 double, f2 double, f3 double")
    got = graph.network(df, ["f0", "f1", "f2", "f3"], levels, *NETWORK).toPandas().set_index("pid")

    def layers(v, maps):
        for w, b, *plain in maps:
            v = np.array(v) @ np.array(w) + np.array(b)
            if not plain:
                v = np.where(v > 0, v, np.exp(v) - 1)
        return v

    def ball(points, q, radius, k):
        near = sorted((p for p in points if np.sqrt(((xyz[p] - xyz[q]) ** 2).sum()) < radius), key=lambda p: ((p * 1103515245 + 12345) % 2147483648, p))[:k]
        return near + [near[0]] * (k - len(near))

    def attend(points, feats, radius, k, edge, feature, hidden, coefficient):
        out = {}
        mapped = {p: layers(feats[p], feature) for p in points}
        for q in points:
            values, scores = [], []
            for p in ball(points, q, radius, k):
                e = layers(xyz[p] - xyz[q], edge)
                h = layers(mapped[p] - mapped[q], hidden)
                values.append([*e, *mapped[p]])
                scores.append(layers([*e, *h], coefficient))
            s = np.exp(np.array(scores) - np.max(scores, axis=0))
            out[q] = (s / s.sum(axis=0) * np.array(values)).sum(axis=0)
        return out

    forward, upsample, head = NETWORK
    every = list(range(40))
    fine = attend(every, f, 0.5, 6, *forward[0])
    coarse = [min(every)]
    while len(coarse) < 10:
        coarse.append(max(every, key=lambda p: (min(((xyz[p] - xyz[c]) ** 2).sum() for c in coarse), -p)))
    pooled = {c: np.max([fine[p] for p in ball(every, c, 0.5, 6)], axis=0) for c in coarse}
    deep = attend(sorted(coarse), pooled, 0.9, 5, *forward[1])
    for p in every:
        three = sorted(coarse, key=lambda c: (np.sqrt(((xyz[c] - xyz[p]) ** 2).sum()), c))[:3]
        r = np.array([1 / max(np.sqrt(((xyz[c] - xyz[p]) ** 2).sum()), 1e-10) for c in three])
        w = np.exp(r - r.max())
        up = sum(x * deep[c] for x, c in zip(w / w.sum(), three))
        want = layers(layers([*fine[p], *up], upsample[0]), head)
        assert np.allclose(got.loc[p, ["c0", "c1", "c2"]].to_numpy(dtype=float), want, atol=1e-9)


@pytest.mark.parametrize("span", [2, sampling.KEY_SPAN, 30])
def test_numbering_is_brute_force_over_many_buckets(spark, monkeypatch, span):
    monkeypatch.setattr(sampling, "KEY_SPAN", span)
    monkeypatch.setattr(sampling, "ID_SPAN", span)
    ids = np.random.default_rng(4).choice(1 << 31, 700, replace=False).tolist()
    rows = [("a" if i % 3 else "b", int(p), 0.0, 0.0, 0.0) for i, p in enumerate(ids)] + [("one", 7, 0.0, 0.0, 0.0), (None, 9, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want, whole = {}, {}
    for name in {r[0] for r in rows}:
        own = sorted(r[1] for r in rows if r[0] == name)
        whole[name] = own
        want |= {(name, p): i for i, p in enumerate(sorted(own, key=lambda p: ((p * 1103515245 + 12345) % 2147483648, p)))}
    assert {(r.cloud, r.pid): r.pos for r in sampling.shuffled(df).collect()} == want
    numbered = sampling.numbered(df, F.shiftright("pid", span), [F.col("pid")], "at").collect()
    assert sorted((r.cloud or "", r["at"], r.pid) for r in numbered) == sorted((n or "", i, p) for n, own in whole.items() for i, p in enumerate(own))
    few = {(r.cloud, r.slot): r.pid for r in sampling.picked(df, 50).where("cloud is not null").collect()}
    assert few == {(n, i): whole[n][(i * 1103515245 + 12345) % 2147483648 % len(whole[n])] for n in ("a", "b") for i in range(50)} | {("one", 0): 7}


def test_numbering_of_ties_nulls_and_no_rows(spark):
    df = spark.createDataFrame([("a", None, "x"), ("a", 5, "x"), ("a", 5, "y"), ("a", -3, "z")], "cloud string, pid long, __bucket string")
    got = sampling.numbered(df.withColumnRenamed("__bucket", "begin"), F.shiftright("pid", 2), [F.col("pid"), F.col("begin")], "at")
    assert sorted((r["at"], r.pid, r.begin) for r in got.collect()) == [(0, None, "x"), (1, -3, "z"), (2, 5, "x"), (3, 5, "y")]
    assert sampling.shuffled(df.limit(0)).count() == 0


def test_neighbours_in_one_place_have_no_shape(spark, tmp_path):
    """As in the SQL: NaN eigenvalues of a point whose neighbours are all copies of it, not an error."""
    import duckdb
    from tests.compare import same

    from pointwright.plans import registry

    rows = [(4000 * i + j, 3 * i, 0.1 * i) for i in range(25) for j in (1, 2)] + [(4000 * 99 + j, 0, 1.0) for j in range(4000) if j % 2000 == 5]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = registry.QUERIES["a4_eigenvalues"](spark, str(tmp_path))
    assert got.count() == 50 and {r.e1 != r.e1 for r in got.collect()} == {True}
    same(got, duck, registry.ORACLE_SQL["a4_eigenvalues"])
    same(registry.QUERIES["a4_intensity_variance"](spark, str(tmp_path)), duck, registry.ORACLE_SQL["a4_intensity_variance"])


def test_moments_search_places_not_copies(spark, monkeypatch):
    """Copies of a place are searched once, and a flush of pairs is bounded."""
    df = spark.createDataFrame([("a", 10 * c + p, 0.1 * p, 0.0, 0.0, float(c)) for c in range(30) for p in range(5)], "cloud string, pid long, x double, y double, z double, intensity double")
    sizes, search = [], spatial._searched
    monkeypatch.setattr(spatial, "_searched", lambda data, queries, *rest: (sizes.append((data.count(), queries.count())), search(data, queries, *rest))[1])
    got = spatial.radius_moments(df, df, 0.15, ("intensity",)).collect()
    assert sizes == [(5, 5)] and len(got) == 150
    for r in got:
        n = 60 if r.qid % 10 in (0, 4) else 90
        assert r.n == n and abs(r.c_intensity_intensity - n * np.var(np.arange(30))) < 1e-6
    parts = [(np.zeros(spatial.AT_ONCE // 4),)] * 7
    assert max(sum(len(x[0]) for x in held) for held in spatial._gathered(iter(parts))) <= spatial.AT_ONCE


def test_first_points_of_crowded_cells_settle_queries(spark, monkeypatch):
    """Searches that begin with a few points of each cell give what a search of all gives, uneven cells and copies included."""
    rng = np.random.default_rng(15)
    xyz = np.concatenate((rng.random((500, 3)), 0.05 * rng.random((300, 3)), [[0.5, 0.5, 0.5]] * 40, 3 + rng.random((6, 3)), [[9.0, 9, 9]]))
    df = spark.createDataFrame([("a", i, *map(float, p)) for i, p in enumerate(xyz)], "cloud string, pid long, x double, y double, z double")
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2))
    key = (np.arange(len(xyz)) * 1103515245 + 12345) % 2147483648
    monkeypatch.setattr(spatial, "FIRST_POINTS", (2, 5))
    settled, left = spatial.settled_firsts(df, df, 0.3, 3)
    assert settled.count() + left.count() == len(xyz) and settled.count() > 300 and left.count() > 0
    got = spatial.ball_query(df, df, 0.3, 3).toPandas()
    assert len(got) == 3 * len(xyz)
    for q, g in got.groupby("qid"):
        near = np.flatnonzero(d[q] < 0.3)
        near = near[np.argsort(key[near])][:3].tolist()
        assert g.sort_values("pos").nid.tolist() == near + near[:1] * (3 - len(near)) and set(g.cnt) == {len(near)}
    some = df.where("pid % 9 = 0")
    near = {r.pid for r in spatial.near_any(df, some, 0.1).collect()}
    assert near == set(np.flatnonzero((d[:, ::9] < 0.1).any(axis=1)).tolist())


def test_covariances_without_pairs(spark, random_cloud, monkeypatch):
    """Balls of more than k points are summed; only the k nearest of the other queries are pairs."""
    c = cloud(spark, random_cloud)
    pairs, k = spatial.radius_or_knn(c, c, 0.3, 5), 5
    want = geometry.covariance(pairs, c).toPandas().set_index("qid").sort_index()
    asked, search = [], geometry.knn_join
    monkeypatch.setattr(geometry, "knn_join", lambda data, queries, k: (asked.append(queries.count()), search(data, queries, k))[1])
    got = geometry.covariance_radius_or_knn(c, c, 0.3, k).toPandas().set_index("qid").sort_index()
    assert asked == [int((want.n <= k).sum())] and got.n.equals(want.n)
    assert np.allclose(got[["xx", "xy", "xz", "yy", "yz", "zz"]], want[["xx", "xy", "xz", "yy", "yz", "zz"]])


def test_ball_knn_makes_no_row_for_each_near_point(spark, monkeypatch):
    """Queries with k points in their ball are settled by a few points of each crowded cell; kNN sees the others."""
    rng = np.random.default_rng(16)
    xyz = np.concatenate((rng.random((700, 3)), 4 + 3 * rng.random((5, 3))))
    df = spark.createDataFrame([("a", i, *map(float, p)) for i, p in enumerate(xyz)], "cloud string, pid long, x double, y double, z double")
    monkeypatch.setattr(spatial, "FIRST_POINTS", (4,))
    asked, first = [], spatial.first_in_ball
    monkeypatch.setattr(spatial, "first_in_ball", lambda data, queries, *rest: (asked.append(queries.count()), first(data, queries, *rest))[1])
    got = spatial.ball_knn(df, df, 0.5, 4).toPandas()
    assert 5 <= asked[0] < 350 and len(got) == 4 * len(xyz) and set(got.cnt) == {4}


def test_searches_deal_by_points_and_flush_small_parts(spark, monkeypatch):
    """A search begins with as many partitions as its points need, whatever the session's number; what leaves a batch is bounded even where parts are uneven."""
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    df = spark.createDataFrame([("a", i, 0.01 * i, 0.0, 0.0) for i in range(200)], "cloud string, pid long, x double, y double, z double")
    monkeypatch.setattr(spatial, "TASK_BYTES", 200 * 27 * 48 // 9)
    try:
        assert spatial.radius_join(df, df, 0.025).count() == 200 * 5 - 6
        assert int(spark.conf.get(first)) >= 9
    finally:
        spark.conf.unset(first)
    uneven = [(np.zeros(n),) for n in (spatial.AT_ONCE // 2 - 1, spatial.AT_ONCE, 7)]
    held = list(spatial._gathered(iter(uneven)))
    assert max(sum(len(x[0]) for x in part) for part in held) <= spatial.AT_ONCE <= 1 << 18
    assert sum(len(x[0]) for part in held for x in part) == spatial.AT_ONCE * 3 // 2 + 6


def test_ball_firsts_is_a_row_for_each_query(spark, monkeypatch):
    """Lists of the first k as in the ball query; nothing is searched again where the first points of each cell settle every query."""
    rng = np.random.default_rng(17)
    df = spark.createDataFrame([("a", i, *map(float, p)) for i, p in enumerate(rng.random((300, 3)))], "cloud string, pid long, x double, y double, z double")
    stray = df.unionByName(spark.createDataFrame([("a", 300, 9.0, 9.0, 9.0)], df.schema))
    monkeypatch.setattr(spatial, "FIRST_POINTS", (2, 20))
    asked, first = [], spatial.first_in_ball
    monkeypatch.setattr(spatial, "first_in_ball", lambda *given: (asked.append(1), first(*given))[1])
    for c, again in ((df, 0), (stray, 1)):
        got = {r.qid: list(r.nids) for r in spatial.ball_firsts(c, c, 0.6, 3).collect()}
        assert len(asked) == again
        asked.clear()
        edges = spatial.ball_query(c, c, 0.6, 3).where("pos < cnt").toPandas().sort_values("pos")
        assert got == {q: g.nid.tolist() for q, g in edges.groupby("qid")} and len(got) == c.count()
        asked.clear()
