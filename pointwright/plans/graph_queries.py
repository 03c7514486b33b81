"""Queries of neighbour graphs, scatter sums, interpolation and network layers with fixed weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointwright.functions.columns import elu, group_softmax, linear, mlp
from pointwright.operators import graph, interp, spatial
from pointwright.sources import tables

from .cloud_queries import BALL, FPS, LABELLED, VKNN, R
from .registry import CLOUD, VECTOR, key, query, squared

_MAP = lambda rows, columns: [[((i * 7 + o * 3) % 5 - 2) / 4 for o in range(columns)] for i in range(rows)]
#: Weights of a small network: attention of two levels, the way up, the head.
NETWORK = (
    [([(_MAP(3, 2), [0.0, 0.1])], [(_MAP(n, 2), [0.1, 0.0])], [(_MAP(2, 1), [0.0])], [(_MAP(3, 4), [0.0, 0.1, 0.2, 0.3], "plain")]) for n in (4, 4)],
    [[(_MAP(8, 3), [0.0, 0.1, -0.1])]],
    [(_MAP(3, 4), [0.1] * 4), (_MAP(4, 3), [0.0, 0.1, 0.2], "plain")],
)
KNN6 = f"{VKNN}, edges AS (SELECT cloud, qid, k - 1 AS pos, nid, dist FROM ranked WHERE k <= 6)"


def _graph(spark, sf, k: int = 6):
    v = tables.vector_cloud(spark, sf)
    return v, spatial.knn_join(v, v, k)


# Gathering and pooling (J7-J9, J13, A-6, A-8, N1, N2)


@query("j7_gather_point", f"WITH {CLOUD}, i AS (SELECT cloud, pid - pid % 4 AS pid, pid % 4 AS slot FROM cloud) SELECT i.cloud, i.pid, slot, x, y, z FROM i JOIN cloud c ON c.cloud = i.cloud AND c.pid = i.pid")
def j7(spark, sf):
    c = tables.scene_cloud(spark, sf)
    ids = c.select("cloud", (F.col("pid") - F.col("pid") % 4).alias("pid"), (F.col("pid") % 4).alias("slot"))
    return graph.gather(c.select("cloud", "pid", "x", "y", "z"), ids).select("cloud", "pid", "slot", "x", "y", "z")


@query("j8_gather_id", f"WITH {KNN6} SELECT cloud, qid, CAST(pos AS INTEGER) AS pos, nid FROM edges WHERE qid % 7 = 0")
def j8(spark, sf):
    v, e = _graph(spark, sf)
    return graph.gather_ids(e, v.where("pid % 7 = 0")).select("cloud", "qid", "pos", "nid")


@query("j9_group_point", f"WITH {KNN6} SELECT e.qid, CAST(pos AS INTEGER) AS pos, nid, x, r FROM edges e JOIN vec ON vec.pid = nid")
def j9(spark, sf):
    v, e = _graph(spark, sf)
    return graph.group(e, v, ["x", "r"]).select("qid", "pos", "nid", "x", "r")


@query("j13_sampled_coordinates", f"WITH {VECTOR}, {CLOUD} SELECT vec.pid, c.x, c.y, c.z FROM vec JOIN cloud c ON c.pid = vec.pid * 3 + 1")
def j13(spark, sf):
    ids = tables.vector_cloud(spark, sf).select("pid", (F.col("pid") * 3 + 1).alias("id"))
    c = tables.scene_cloud(spark, sf).select(F.col("pid").alias("id"), "x", "y", "z")
    return ids.join(c, "id").select("pid", "x", "y", "z")


@query("a6_max_pooling", f"WITH {KNN6} SELECT e.qid, max(r) AS r, max(g) AS g, max(b) AS b FROM edges e JOIN vec ON vec.pid = nid GROUP BY e.qid")
def a6(spark, sf):
    v, e = _graph(spark, sf)
    return graph.pool(e, v, ["r", "g", "b"]).select("qid", "r", "g", "b")


@query("a8_mean_pooling", f"WITH {KNN6} SELECT e.qid, round(avg(r), 6) AS r, round(avg(g), 6) AS g FROM edges e JOIN vec ON vec.pid = nid GROUP BY e.qid")
def a8(spark, sf):
    v, e = _graph(spark, sf)
    return graph.pool(e, v, ["r", "g"], "mean").select("qid", *R("r", "g"))


@query("a7_attention_weights", f"WITH {KNN6}, j AS (SELECT e.qid, r, g, exp(r - max(r) OVER w) AS er, exp(g - max(g) OVER w) AS eg FROM edges e JOIN vec ON vec.pid = nid WINDOW w AS (PARTITION BY e.qid)) SELECT qid, round(sum(er * r) / sum(er), 6) AS r, round(sum(eg * g) / sum(eg), 6) AS g FROM j GROUP BY qid")
def a7(spark, sf):
    v, e = _graph(spark, sf)
    met = group_softmax(graph.group(e, v, ["r", "g"]), ["cloud", "qid"], ["r", "g"])
    return met.groupBy("qid").agg(*[F.round(F.sum(F.col(f"{c}_w") * F.col(c)), 6).alias(c) for c in ("r", "g")])


@query("n1_build_graph", f"WITH {BALL}, f AS (SELECT *, row_number() OVER (PARTITION BY cloud, qid ORDER BY {key('nid')}, nid) AS k FROM ball) SELECT cloud, qid, count(*) AS n, min(nid) AS lo, max(nid) AS hi FROM f WHERE k <= 12 GROUP BY ALL")
def n1(spark, sf):
    c = tables.scene_cloud(spark, sf)
    e = spatial.ball_firsts(c, c, 0.4, 12)
    return e.select("cloud", "qid", F.size("nids").cast("long").alias("n"), F.array_min("nids").alias("lo"), F.array_max("nids").alias("hi"))


@query("n2_graph_coarse", f"WITH RECURSIVE {LABELLED}, {FPS.format(k='cloud', t='vec', m=64)}, s AS (SELECT DISTINCT f.cloud, sel AS pid FROM f JOIN n ON n.cloud = f.cloud WHERE step <= ceil(n / 4.0)), e AS (SELECT q.cloud, q.pid AS qid, d.pid AS nid FROM vec q JOIN vec d ON d.cloud = q.cloud WHERE sqrt({squared('d', 'q')}) < 0.25) SELECT e.cloud, e.qid, count(*) AS n, min(nid) AS lo FROM e JOIN s ON s.cloud = e.cloud AND s.pid = e.qid GROUP BY ALL")
def n2(spark, sf):
    v = tables.vector_cloud(spark, sf, by_label=True)
    _, e = graph.coarse_map(spatial.radius_join(v, v, 0.25), v, 4)
    return e.groupBy("cloud", "qid").agg(F.count("*").alias("n"), F.min("nid").alias("lo"))


#: Strides, radii and neighbours of the five levels.
LEVELS = [(4, 0.1, 12), (4, 0.2, 21), (4, 0.4, 21), (2, 0.8, 21), (1, 1.6, 12)]


def _pyramid_sql(levels: list[tuple[int, float, int]]) -> str:
    """A recursion for each level that thins the points of the one before it, and the balls of every level."""
    tables_, t = [LABELLED], "vec"
    picks = FPS.replace("first", "first{i}").replace("f AS", "f{i} AS").replace("FROM f WHERE", "FROM f{i} WHERE").replace("n AS (SELECT {k}, count", "n{i} AS (SELECT {k}, count").replace("JOIN first{i} USING", "JOIN first{i} USING").replace("first{i}_value", "first_value")
    out = []
    for i, (stride, radius, k) in enumerate(levels):
        out.append(f"SELECT {i} AS level, cloud, qid, count(*) AS n FROM (SELECT q.cloud, q.pid AS qid, row_number() OVER (PARTITION BY q.cloud, q.pid ORDER BY {key('d.pid')}, d.pid) AS k FROM {t} q JOIN {t} d ON d.cloud = q.cloud WHERE sqrt({squared('d', 'q')}) < {radius}) WHERE k <= {k} GROUP BY ALL")
        if stride > 1:
            tables_.append(picks.format(i=i, k="cloud", t=t, m=f"(SELECT CAST(ceil(max(c) / {stride}.0) AS BIGINT) FROM (SELECT count(*) AS c FROM {t} GROUP BY cloud))"))
            tables_.append(f"v{i} AS (SELECT p.* FROM {t} p JOIN (SELECT DISTINCT f{i}.cloud, sel AS pid FROM f{i} JOIN n{i} ON n{i}.cloud = f{i}.cloud WHERE step <= ceil(n / {stride}.0)) s ON s.cloud = p.cloud AND s.pid = p.pid)")
            t = f"v{i}"
    return f"WITH RECURSIVE {', '.join(tables_)} {' UNION ALL '.join(out)}"


@query("n3_graph_pyramid", _pyramid_sql(LEVELS))
def n3(spark, sf):
    v = tables.vector_cloud(spark, sf, by_label=True)
    e = graph.pyramid(v, LEVELS).where("pos < cnt")
    return e.groupBy("level", "cloud", "qid").agg(F.count("*").alias("n"))


@query("n10_network")
def n10(spark, sf):
    """Class scores of every point by the whole network with given weights; tests compare it with loops."""
    v = tables.vector_cloud(spark, sf, by_label=True)
    return graph.network(v, ["z", "r", "g", "b"], [(4, 0.4, 8), (1, 0.8, 8)], *NETWORK).select("cloud", "pid", *R("c0", "c1", "c2"))


# Scatter sums


def _scatter(sums: str) -> str:
    return f"WITH {KNN6}, s AS ({sums}) SELECT vec.pid, round(coalesce(s.r, 0.0), 6) + 0.0 AS r, round(coalesce(s.g, 0.0), 6) + 0.0 AS g FROM vec LEFT JOIN s ON s.pid = vec.pid"


@query("g1_gather_point_grad", _scatter("SELECT pid - pid % 4 AS pid, sum(r) AS r, sum(g) AS g FROM vec GROUP BY 1"))
def g1(spark, sf):
    v = tables.vector_cloud(spark, sf)
    grads = v.select("cloud", (F.col("pid") - F.col("pid") % 4).alias("idx"), "r", "g")
    return graph.scatter_add(v, grads, ["r", "g"], index="idx").select("pid", *R("r", "g"))


@query("g2_group_point_grad", _scatter("SELECT nid AS pid, sum(r) AS r, sum(g) AS g FROM edges JOIN vec ON vec.pid = qid GROUP BY nid"))
def g2(spark, sf):
    v, e = _graph(spark, sf)
    grads = e.join(v.select("cloud", F.col("pid").alias("qid"), "r", "g"), ["cloud", "qid"])
    return graph.scatter_add(v, grads, ["r", "g"]).select("pid", *R("r", "g"))


@query("g3_three_interpolate_grad", _scatter("SELECT nid AS pid, sum(w * r) AS r, sum(w * g) AS g FROM (SELECT qid, nid, exp(rd - max(rd) OVER (PARTITION BY qid)) / sum(exp(rd - m)) OVER (PARTITION BY qid) AS w FROM (SELECT *, 1.0 / greatest(dist, 1e-10) AS rd, max(1.0 / greatest(dist, 1e-10)) OVER (PARTITION BY qid) AS m FROM ranked WHERE k <= 3)) JOIN vec ON vec.pid = qid GROUP BY nid"))
def g3(spark, sf):
    v = tables.vector_cloud(spark, sf)
    w = interp.softmax_weights(spatial.knn_join(v, v, 3))
    grads = w.join(v.select("cloud", F.col("pid").alias("qid"), "r", "g"), ["cloud", "qid"])
    return graph.scatter_add(v, grads, ["r", "g"], weight="w").select("pid", *R("r", "g"))


@query("g4_eigenvector_grad", f"WITH {VECTOR} SELECT pid, CAST(c AS INTEGER) AS col, CASE WHEN c = pid % 3 THEN r ELSE 0.0 END AS grad FROM vec, (SELECT range AS c FROM range(3))")
def g4(spark, sf):
    v = tables.vector_cloud(spark, sf)
    return v.select("pid", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: F.when(c == F.col("pid") % 3, F.col("r")).otherwise(F.lit(0.0)))).alias("col", "grad"))


@query("g5_scatter_add_ids", f"WITH {KNN6} SELECT nid AS pid, count(*) AS n, CAST(sum(pos) AS BIGINT) AS s FROM edges GROUP BY nid")
def g5(spark, sf):
    _, e = _graph(spark, sf)
    return e.groupBy(F.col("nid").alias("pid")).agg(F.count("*").alias("n"), F.sum("pos").alias("s"))


# Interpolation (A-9 - A-11, N8, J5, J6)

KNN3 = f"""ranked AS (SELECT q.pid AS qid, d.pid AS nid, sqrt({squared('d', 'q')}) AS dist, row_number() OVER (PARTITION BY q.pid ORDER BY sqrt({squared('d', 'q')}), d.pid) AS k FROM vec q JOIN vec d ON d.pid % 5 = 0), near AS (SELECT * FROM ranked WHERE k <= 3)"""
SOFT3 = "e AS (SELECT *, exp(1.0 / greatest(dist, 1e-10) - max(1.0 / greatest(dist, 1e-10)) OVER (PARTITION BY qid)) AS ew FROM near), w AS (SELECT *, ew / sum(ew) OVER (PARTITION BY qid) AS w FROM e)"


@query("a9_three_interpolate", f"WITH {VECTOR}, {KNN3}, {SOFT3} SELECT qid, round(sum(w * r), 6) AS r, round(sum(w * g), 6) AS g, round(sum(w * b), 6) AS b FROM w JOIN vec ON vec.pid = nid GROUP BY qid")
def a9(spark, sf):
    v = tables.vector_cloud(spark, sf)
    return interp.three_nn(v.where("pid % 5 = 0"), v, ["r", "g", "b"]).select("qid", *R("r", "g", "b"))


@query("a10_label_interpolation", f"WITH {VECTOR}, {KNN3}, d AS (SELECT n.qid, n.nid, 1.0 / greatest(sqrt({squared('a', 'c', 'rgb')}), 1e-8) AS ci, 1.0 / greatest(dist * dist, 1e-8) AS si FROM near n JOIN vec a ON a.pid = n.nid JOIN vec c ON c.pid = n.qid), w AS (SELECT qid, nid, CAST(0.7 AS DOUBLE) * (ci / sum(ci) OVER q) + CAST(0.3 AS DOUBLE) * (si / sum(si) OVER q) AS w FROM d WINDOW q AS (PARTITION BY qid)) SELECT qid, label AS class_id, round(sum(w), 6) AS p FROM w JOIN vec ON vec.pid = nid GROUP BY qid, label")
def a10(spark, sf):
    v = tables.vector_cloud(spark, sf)
    coarse = v.where("pid % 5 = 0").select("*", *[(F.col("label") == i).cast("double").alias(f"p{i}") for i in range(10)])
    got = interp.colour_spatial(coarse, v, [f"p{i}" for i in range(10)])
    long = got.select("qid", F.posexplode(F.array(*[f"p{i}" for i in range(10)])).alias("class_id", "p")).where("p > 0")
    return long.select("qid", F.col("class_id").cast("long").alias("class_id"), *R("p"))


@query("a11_geometry_filter", f"WITH {VKNN}, n AS (SELECT * FROM ranked WHERE k <= 8), d AS (SELECT n.qid, n.nid, 1.0 / greatest(sqrt({squared('a', 'c', 'rgb')}), 1e-8) AS gi, 1.0 / greatest(dist * dist, 1e-8) AS si FROM n JOIN vec a ON a.pid = n.nid JOIN vec c ON c.pid = n.qid), w AS (SELECT qid, nid, 0.5 * (gi / (sum(gi) OVER q + 1e-8)) + 0.5 * (si / (sum(si) OVER q + 1e-8)) AS w FROM d WINDOW q AS (PARTITION BY qid)) SELECT qid, round(2 * sum(w * x), 6) AS x FROM w JOIN vec ON vec.pid = nid GROUP BY qid")
def a11(spark, sf):
    v = tables.vector_cloud(spark, sf)
    return interp.geometry_filter(v, ["r", "g", "b"], ["x"], 8, rounds=2).select("qid", *R("x"))


@query("j5_j6_knn_self", f"WITH {VKNN} SELECT qid, nid, CAST(k - 1 AS INTEGER) AS pos FROM ranked WHERE k <= 8")
def j5(spark, sf):
    v, e = _graph(spark, sf, 8)
    return e.select("qid", "nid", "pos")


@query("n8_point_upsample", f"WITH {VECTOR}, {KNN3}, {SOFT3}, i AS (SELECT qid, sum(w * r) AS f FROM w JOIN vec ON vec.pid = nid GROUP BY qid) SELECT qid AS pid, round(CASE WHEN f * 0.5 - x > 0 THEN f * 0.5 - x ELSE exp(f * 0.5 - x) - 1 END, 6) AS o FROM i JOIN vec ON vec.pid = qid")
def n8(spark, sf):
    v = tables.vector_cloud(spark, sf)
    up = interp.three_nn(v.where("pid % 5 = 0"), v, ["r"]).select(F.col("qid").alias("pid"), F.col("r").alias("f"))
    return up.join(v.select("pid", "x"), "pid").select("pid", F.round(mlp([F.col("f"), F.col("x")], [([[0.5], [-1.0]], [0.0])])[0], 6).alias("o"))


# Layers with fixed weights

W = [[0.5, -1.0], [1.0, 0.25], [-0.75, 0.5]]
BIAS = [0.1, -0.2]


def _lin(names: list[str], weights: list[list[float]], bias: list[float], plain: bool = False) -> list[str]:
    out = [" + ".join([f"CAST({b} AS DOUBLE)", *[f"{n} * CAST({w[o]} AS DOUBLE)" for n, w in zip(names, weights, strict=True)]]) for o, b in enumerate(bias)]
    return out if plain else [f"CASE WHEN {x} > 0 THEN {x} ELSE exp({x}) - 1 END" for x in out]


_L = _lin(["r", "g", "b"], W, BIAS, plain=True)


@query("n13_conv_elu", f"WITH {VECTOR} SELECT pid, round({_L[0]}, 6) AS o0, round({_L[1]}, 6) AS o1, round(CASE WHEN {_L[0]} > 0 THEN {_L[0]} ELSE exp({_L[0]}) - 1 END, 6) AS e0 FROM vec")
def n13(spark, sf):
    o = linear([F.col(c) for c in "rgb"], W, BIAS)
    return tables.vector_cloud(spark, sf).select("pid", F.round(o[0], 6).alias("o0"), F.round(o[1], 6).alias("o1"), F.round(elu(o[0]), 6).alias("e0"))


@query("n4_edge_mapping", f"WITH {KNN6}, d AS (SELECT e.qid, pos, a.x - c.x AS r, a.y - c.y AS g, a.z - c.z AS b FROM edges e JOIN vec a ON a.pid = e.nid JOIN vec c ON c.pid = e.qid) SELECT qid, CAST(pos AS INTEGER) AS pos, round({_lin(['r', 'g', 'b'], W, BIAS)[0]}, 6) AS e0, round({_lin(['r', 'g', 'b'], W, BIAS)[1]}, 6) AS e1 FROM d")
def n4(spark, sf):
    v, e = _graph(spark, sf)
    met = graph.group(e, v, ["x", "y", "z"]).join(v.select("cloud", F.col("pid").alias("qid"), *[F.col(c).alias(f"q{c}") for c in "xyz"]), ["cloud", "qid"])
    out = mlp([F.col(c) - F.col(f"q{c}") for c in "xyz"], [(W, BIAS)])
    return met.select("qid", "pos", F.round(out[0], 6).alias("e0"), F.round(out[1], 6).alias("e1"))


@query("n14_batch_norm", f"WITH {VECTOR} SELECT pid, round((r - avg(r) OVER ()) / sqrt(var_pop(r) OVER () + 1e-3), 6) AS r, round((g - avg(g) OVER ()) / sqrt(var_pop(g) OVER () + 1e-3), 6) AS g FROM vec")
def n14(spark, sf):
    return graph.batch_norm(tables.vector_cloud(spark, sf).select("pid", "r", "g"), ["r", "g"]).select("pid", *R("r", "g"))


@query("n15_dropout_inference", f"WITH {VECTOR} SELECT pid, r FROM vec")
def n15(spark, sf):
    return tables.vector_cloud(spark, sf).select("pid", "r")  # the identity outside training


H1 = [[1.0], [-0.5]]
C = {"with_feature": [[0.5, 1.0, -1.0, 0.25], [1.0, -0.5, 0.5, 0.75], [-1.0, 0.5, 0.25, 1.0]], "edge_only": [[0.5, 1.0, -1.0, 0.25], [1.0, -0.5, 0.5, 0.75]], "feature_only": [[-1.0, 0.5, 0.25, 1.0]]}


def _attention_sql(mode: str) -> str:
    f = _lin(["r", "g", "b"], W, BIAS)
    e = _lin(["dx", "dy", "dz"], W, BIAS)
    source = {"with_feature": ["e0", "e1", "h0"], "edge_only": ["e0", "e1"], "feature_only": ["h0"]}[mode]
    c = _lin(source, C[mode], [0.0, 0.1, 0.2, 0.3], plain=True)
    sums = ", ".join(f"round(sum(w{i} * v{i}) / sum(w{i}), 6) AS a{i}" for i in range(4))
    return f"""WITH {KNN6}, m AS (SELECT pid, x, y, z, {f[0]} AS f0, {f[1]} AS f1 FROM vec),
d AS (SELECT e.qid, a.f0, a.f1, a.f0 - c.f0 AS d0, a.f1 - c.f1 AS d1, a.x - c.x AS dx, a.y - c.y AS dy, a.z - c.z AS dz FROM edges e JOIN m a ON a.pid = e.nid JOIN m c ON c.pid = e.qid),
h AS (SELECT qid, f0, f1, {e[0]} AS e0, {e[1]} AS e1, {_lin(['d0', 'd1'], H1, [0.0])[0]} AS h0 FROM d),
s AS (SELECT qid, e0 AS v0, e1 AS v1, f0 AS v2, f1 AS v3, {', '.join(f'{x} AS c{i}' for i, x in enumerate(c))} FROM h),
w AS (SELECT *, {', '.join(f'exp(c{i} - max(c{i}) OVER (PARTITION BY qid)) AS w{i}' for i in range(4))} FROM s) SELECT qid, {sums} FROM w GROUP BY qid"""


def _attention(mode: str):
    def run(spark, sf):
        v, e = _graph(spark, sf)
        out = graph.attention(v, e, ["r", "g", "b"], [(W, BIAS)], [(W, BIAS)], [(H1, [0.0])], [(C[mode], [0.0, 0.1, 0.2, 0.3], "plain")], mode)
        return out.select("qid", *R("a0", "a1", "a2", "a3"))

    return run


query("n5_n6_graph_attention", _attention_sql("with_feature"))(_attention("with_feature"))
query("n5_attention_edge_only", _attention_sql("edge_only"))(_attention("edge_only"))
query("n7_attention_feature_only", _attention_sql("feature_only"))(_attention("feature_only"))

_P = "exp(r - greatest(r, g, b)) + exp(g - greatest(r, g, b)) + exp(b - greatest(r, g, b))"


@query("n9_crf_step", f"WITH {KNN6}, s AS (SELECT pid, {', '.join(f'exp({c} - greatest(r, g, b)) / ({_P}) AS s{c}' for c in 'rgb')} FROM vec), k AS (SELECT e.qid, e.nid, 0.5 * exp(-({squared('a', 'c')} + {squared('a', 'c', 'rgb')})) + 0.5 * exp(-({squared('a', 'c')})) AS k FROM edges e JOIN vec a ON a.pid = e.nid JOIN vec c ON c.pid = e.qid), m AS (SELECT qid, sum(k * sr) AS mr, sum(k * sg) AS mg, sum(k * sb) AS mb FROM k JOIN s ON s.pid = k.nid GROUP BY qid) SELECT pid, round(r + mr, 6) AS r, round(g + mg, 6) AS g, round(b + mb, 6) AS b FROM vec JOIN m ON m.qid = vec.pid")
def n9(spark, sf):
    v, e = _graph(spark, sf)
    return graph.crf(v.select("*", F.col("r").alias("c0"), F.col("g").alias("c1"), F.col("b").alias("c2")), e, ["c0", "c1", "c2"]).select("pid", *[F.round(f"c{i}", 6).alias(c) for i, c in enumerate("rgb")])


@query("p21_concatenated_features", f"WITH {VECTOR}, t AS (SELECT pid, x * 2 AS f FROM vec) SELECT vec.pid, x, y, z, t.f FROM vec JOIN t ON t.pid = vec.pid")
def p21(spark, sf):
    v = tables.vector_cloud(spark, sf)
    return v.select("pid", "x", "y", "z").join(v.select("pid", (F.col("x") * 2).alias("f")), "pid")


