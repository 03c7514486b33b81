"""Queries of the segmentation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointwright.functions.columns import argmax, learning_rate, norm_decay, row_softmax, soft_label
from pointwright.operators import metrics, spatial
from pointwright.operators.interp import softmax_weights, weighted_sum
from pointwright.sources import tables

from .registry import CLOUD, PRED, VECTOR, query, squared

COUNTS = """c AS (SELECT k.class_id, count(*) FILTER (truth = k.class_id) AS gt, count(*) FILTER (pred = k.class_id) AS pos, count(*) FILTER (truth = k.class_id AND pred = k.class_id) AS tp
 FROM (SELECT CAST(range AS BIGINT) AS class_id FROM range({n})) k LEFT JOIN {t} ON true GROUP BY k.class_id)"""
C13 = COUNTS.format(n=13, t="pt")


@query("a12_class_counts", f"WITH {PRED}, {C13} SELECT * FROM c")
def a12(spark, sf):
    return metrics.class_counts(tables.pred_truth(spark, sf), 13)


@query("a12_masked_class_counts", f"WITH {PRED.replace('pt AS', 'pt0 AS')}, pt AS (SELECT * FROM pt0 WHERE mask), {C13} SELECT * FROM c")
def a12_masked(spark, sf):
    return metrics.class_counts(tables.pred_truth(spark, sf), 13, F.col("mask"))


@query("a13_iou", f"WITH {PRED}, {C13} SELECT class_id, round(tp / CAST(nullif(gt + pos - tp, 0) AS DOUBLE), 6) AS iou FROM c")
def a13(spark, sf):
    return metrics.iou(metrics.class_counts(tables.pred_truth(spark, sf), 13)).select("class_id", F.round("iou", 6).alias("iou"))


@query("a13_mean_iou_absent_class", f"WITH {PRED}, {COUNTS.format(n=15, t='pt')} SELECT round(avg(tp / CAST(nullif(gt + pos - tp, 0) AS DOUBLE)), 6) AS mean_iou, count(*) FILTER (gt + pos = 0) AS absent FROM c")
def a13_absent(spark, sf):
    each = metrics.iou(metrics.class_counts(tables.pred_truth(spark, sf), 15))
    return each.agg(F.round(F.avg("iou"), 6).alias("mean_iou"), F.count(F.when(F.col("gt") + F.col("pos") == 0, 1)).alias("absent"))


@query("a14_compute_iou", f"WITH {PRED}, {C13} SELECT class_id, round(tp / (gt + pos - tp + 1e-8), 6) AS iou, (SELECT round(count(*) FILTER (truth = pred) / (count(*) + 1e-8), 6) FROM pt) AS oa FROM c")
def a14(spark, sf):
    pt = tables.pred_truth(spark, sf)
    each = metrics.iou(metrics.class_counts(pt, 13), 1e-8).select("class_id", F.round("iou", 6).alias("iou"))
    return each.crossJoin(F.broadcast(metrics.overall(pt, 1e-8).select(F.round("oa", 6).alias("oa"))))  # one row


@query("a15_compute_iou2", f"WITH {PRED}, {C13} SELECT class_id, round(tp / (gt + pos - tp + 1e-9), 6) AS iou, (SELECT round(count(*) FILTER (truth = pred) / CAST(count(*) AS DOUBLE), 6) FROM pt) AS oa FROM c")
def a15(spark, sf):
    pt = tables.pred_truth(spark, sf)
    each = metrics.iou(metrics.class_counts(pt, 13), 1e-9).select("class_id", F.round("iou", 6).alias("iou"))
    return each.crossJoin(F.broadcast(metrics.overall(pt).select(F.round("oa", 6).alias("oa"))))  # one row


@query("a16_acc_report", f"WITH {PRED}, {C13}, e AS (SELECT class_id, tp / (gt + pos - tp + 1e-8) AS iou FROM c) SELECT class_id, round(iou, 6) AS iou, (SELECT round(avg(iou), 6) FROM e) AS mean_iou, (SELECT round(count(*) FILTER (truth = pred) / (count(*) + 1e-8), 6) FROM pt) AS oa FROM e")
def a16(spark, sf):
    return metrics.report(tables.pred_truth(spark, sf), 13).select("class_id", *[F.round(c, 6).alias(c) for c in ("iou", "mean_iou", "oa")])


@query("a17_masked_accuracy", f"WITH {PRED} SELECT count(*) FILTER (mask) AS seen, count(*) FILTER (mask AND truth = pred) AS correct, round(count(*) FILTER (mask AND truth = pred) / CAST(count(*) FILTER (mask) AS DOUBLE), 6) AS accuracy FROM pt")
def a17(spark, sf):
    return metrics.masked_accuracy(tables.pred_truth(spark, sf), F.col("mask")).select("seen", "correct", F.round("accuracy", 6).alias("accuracy"))


@query("a17_class_accuracy", f"WITH {PRED} SELECT truth AS class_id, count(*) AS seen, round(avg(CASE WHEN truth = pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM pt WHERE mask GROUP BY truth")
def a17_class(spark, sf):
    return metrics.class_accuracy(tables.pred_truth(spark, sf), F.col("mask")).select("class_id", "seen", F.round("accuracy", 6).alias("accuracy"))


@query("a18_running_means", f"WITH {CLOUD}, b AS (SELECT pid // 500 AS batch, avg(x) AS loss, avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc, count(*) AS n FROM cloud WHERE label > 0 GROUP BY 1) SELECT round(sum(loss) / count(*), 6) AS mean_loss, round(avg(acc), 6) AS mean_accuracy, round(sum(loss * 500) / (sum(n) / CAST(1 AS DOUBLE)), 6) AS eval_loss FROM b")
def a18(spark, sf):
    c = tables.scene_cloud(spark, sf).where("label > 0")
    b = c.groupBy(F.floor(F.col("pid") / 500).alias("batch")).agg(F.avg("x").alias("loss"), F.avg((F.col("label") == F.col("pred")).cast("double")).alias("acc"), F.count("*").alias("n"))
    return b.agg(F.round(F.avg("loss"), 6).alias("mean_loss"), F.round(F.avg("acc"), 6).alias("mean_accuracy"), F.round(F.sum(F.col("loss") * 500) / F.sum("n"), 6).alias("eval_loss"))


@query("f4_soft_label_report", f"WITH pt AS (SELECT CAST(quality AS BIGINT) AS truth, CAST(toxic AS BIGINT) AS pred FROM labels), {COUNTS.format(n=2, t='pt')} SELECT class_id, gt, pos, tp, round(tp / (gt + pos - tp + 1e-8), 6) AS iou FROM c")
def soft(spark, sf):
    return metrics.iou(metrics.class_counts(tables.soft_labels(spark, sf), 2), 1e-8).withColumn("iou", F.round("iou", 6))


_SOFT = "greatest(r, g, b) + ln(exp(r - greatest(r, g, b)) + exp(g - greatest(r, g, b)) + exp(b - greatest(r, g, b))) - CASE label % 3 WHEN 0 THEN r WHEN 1 THEN g ELSE b END"


@query("a22_cross_entropy", f"WITH {VECTOR} SELECT round(avg({_SOFT}), 6) AS loss FROM vec")
def a22(spark, sf):
    v = tables.vector_cloud(spark, sf).withColumn("label", F.col("label") % 3)
    return metrics.cross_entropy(v, ["r", "g", "b"]).select(F.round("loss", 6).alias("loss"))


@query("a22_weighted_cross_entropy", f"WITH {VECTOR}, l AS (SELECT {_SOFT} AS loss, CAST(pid % 3 AS DOUBLE) AS w FROM vec) SELECT round(sum(loss * w) / count(*) FILTER (w <> 0), 6) AS loss FROM l")
def a22_weighted(spark, sf):
    v = tables.vector_cloud(spark, sf).select("*", (F.col("pid") % 3).cast("double").alias("w")).withColumn("label", F.col("label") % 3)
    return metrics.cross_entropy(v, ["r", "g", "b"], weight="w").select(F.round("loss", 6).alias("loss"))


@query("p15_argmax", f"WITH {VECTOR} SELECT pid, CAST(CASE WHEN r >= g AND r >= b THEN 0 WHEN g >= b THEN 1 ELSE 2 END AS INTEGER) AS class_id FROM vec")
def p15(spark, sf):
    return tables.vector_cloud(spark, sf).select("pid", argmax([F.col(c) for c in "rgb"]).alias("class_id"))


@query("n12_softmax", f"WITH {VECTOR}, e AS (SELECT pid, exp(r - greatest(r, g, b)) AS a, exp(g - greatest(r, g, b)) AS c, exp(b - greatest(r, g, b)) AS d FROM vec) SELECT pid, round(a / (a + c + d), 6) AS p0, round(c / (a + c + d), 6) AS p1, round(d / (a + c + d), 6) AS p2 FROM e")
def n12(spark, sf):
    p = row_softmax([F.col(c) for c in "rgb"])
    return tables.vector_cloud(spark, sf).select("pid", *[F.round(x, 6).alias(f"p{i}") for i, x in enumerate(p)])


@query("p20_label_probabilities", f"WITH {CLOUD} SELECT pid, class_id, CASE WHEN label = class_id THEN CAST(0.95 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END AS p FROM cloud, (SELECT CAST(range AS INTEGER) AS class_id FROM range(13))")
def p20(spark, sf):
    c = tables.scene_cloud(spark, sf)
    return c.select("pid", F.posexplode(F.array(*soft_label(F.col("label"), 13))).alias("class_id", "p"))


@query("n17_schedules", "SELECT range AS batch, round(0.001 * pow(0.7, floor(range * 15 / 3000.0)), 9) AS rate, round(greatest(0.001 * pow(0.7, floor(range * 15 / 3000.0)), 0.00001), 9) AS clipped, round(least(0.99, 1 - 0.5 * pow(0.5, floor(range * 15 / 300000.0))), 9) AS decay FROM range(0, 100000, 250)")
def n17(spark, sf):
    b = spark.range(0, 100000, 250).withColumnRenamed("id", "batch")
    rate = lambda least=None: F.round(learning_rate(F.col("batch"), 0.001, 15, 3000.0, 0.7, least), 9)
    return b.select("batch", rate().alias("rate"), rate(0.00001).alias("clipped"), F.round(norm_decay(F.col("batch"), 15), 9).alias("decay"))


_KNN5 = f"""ranked AS (SELECT q.pid AS qid, d.pid AS nid, sqrt({squared('d', 'q')}) AS dist, row_number() OVER (PARTITION BY q.pid ORDER BY sqrt({squared('d', 'q')}), d.pid) AS k FROM vec q JOIN vec d ON d.pid % 5 = 0),
near AS (SELECT *, 1.0 / greatest(dist, 1e-10) AS rd FROM ranked WHERE k <= 3), e AS (SELECT *, exp(rd - max(rd) OVER (PARTITION BY qid)) AS ew FROM near), w AS (SELECT *, ew / sum(ew) OVER (PARTITION BY qid) AS w FROM e)"""


@query("flagship_interpolated_iou", f"WITH {VECTOR}, {_KNN5}, s AS (SELECT qid, vec.label % 10 AS c, sum(w) AS p FROM w JOIN vec ON vec.pid = nid GROUP BY 1, 2), best AS (SELECT qid, c, row_number() OVER (PARTITION BY qid ORDER BY round(p, 9) DESC, c) AS k FROM s), pt AS (SELECT label % 10 AS truth, c AS pred FROM best JOIN vec ON vec.pid = qid WHERE k = 1), {COUNTS.format(n=10, t='pt')} SELECT class_id, gt, pos, tp, round(tp / (gt + pos - tp + 1e-8), 6) AS iou FROM c")
def flagship_query(spark, sf):
    v = tables.vector_cloud(spark, sf).withColumn("label", F.col("label") % 10)
    coarse = v.where("pid % 5 = 0").select("*", *[(F.col("label") == i).cast("double").alias(f"p{i}") for i in range(10)])
    p = weighted_sum(softmax_weights(spatial.knn_join(coarse, v, 3)), coarse, [f"p{i}" for i in range(10)])
    pred = p.select(F.col("qid").alias("pid"), argmax([F.round(F.col(f"p{i}"), 9) for i in range(10)]).cast("long").alias("pred"))
    return metrics.iou(metrics.class_counts(v.select("pid", F.col("label").alias("truth")).join(pred, "pid"), 10), 1e-8).withColumn("iou", F.round("iou", 6))


