"""Queries that write points in the formats of the engine and read them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointwright.sources import files, tables
from pointwright.sources.scratch import scratch_dir

from .registry import CLOUD, PRED, query

SUMS = "count(*) AS n, round(sum(x), 3) AS x, round(sum(y), 3) AS y, CAST(sum(r) AS BIGINT) AS r, CAST(sum(label) AS BIGINT) AS label"


def _sums(df, *keys):
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.round(F.sum(c), 3).alias(c) for c in ("x", "y")], *[F.sum(F.col(c).cast("long")).alias(c) for c in ("r", "label")])


@query("s1_s2_k6_ply_round_trip", f"WITH {CLOUD} SELECT cloud, {SUMS} FROM cloud GROUP BY cloud")
def ply(spark, sf):
    """PLY bytes of each scene through Parquet, parsed again."""
    path = scratch_dir(spark, "ply")
    files.ply_files(tables.scene_cloud(spark, sf)).write.parquet(path)
    return _sums(files.read_ply_files(spark, path), "cloud")


@query("s6_s7_text_clouds", f"WITH {CLOUD} SELECT {SUMS} FROM cloud")
def text(spark, sf):
    """Text points written and read by suffix."""
    path = scratch_dir(spark, "text") + ".txt"
    files.write_text(tables.scene_cloud(spark, sf), path)
    return _sums(files.read_points(spark, path))


@query("s9_s16_k1_k2_training_blocks", f"WITH {CLOUD} SELECT cloud, {SUMS} FROM cloud GROUP BY cloud")
def blocks(spark, sf):
    """Block rows in rolled, compressed files, read as one table."""
    path = scratch_dir(spark, "blocks")
    files.write_blocks(tables.scene_cloud(spark, sf), path, rows_per_file=4096)
    return _sums(spark.read.parquet(f"{path}/*.parquet"), "cloud")


LAYOUT_SQL = " UNION ALL ".join(f"SELECT '{n}' AS layout, {i} AS columns, count(*) AS n, round(sum(x), 3) AS x, CAST(sum(b) AS BIGINT) AS b, round(sum({v}), 3) AS extra FROM c" for n, i, v in (("xyzrgb", 6, "0.0"), ("xyzrgbI", 7, "intensity"), ("xyzrgbIL", 8, "intensity + label")))


@query("s3_s4_s5_layouts", f"WITH {CLOUD}, c AS (SELECT *, (pid * 3 % 100) / 4.0 AS intensity FROM cloud) {LAYOUT_SQL}")
def layouts(spark, sf):
    """PLY files of the layouts with intensity and without label, each written and parsed."""
    c = tables.scene_cloud(spark, sf).withColumn("intensity", F.col("pid") * 3 % 100 / F.lit(4.0))
    out = None
    for name, extra in (("xyzrgb", F.lit(0.0)), ("xyzrgbI", F.col("intensity")), ("xyzrgbIL", F.col("intensity") + F.col("label"))):
        path = scratch_dir(spark, name)
        files.ply_files(c, layout=name).write.parquet(path)
        got = files.read_ply_files(spark, path, layout=name)
        sums = got.agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("x"), F.sum(F.col("b").cast("long")).alias("b"), F.round(F.sum(extra), 3).alias("extra"))
        sums = sums.select(F.lit(name).alias("layout"), F.lit(len(files.LAYOUTS[name].split())).alias("columns"), "n", "x", "b", "extra")
        out = sums if out is None else out.unionByName(sums)
    return out


@query("s8_s10_s11_feature_blocks", f"WITH {CLOUD} SELECT cloud, count(*) AS n, CAST(sum(label) AS BIGINT) AS label, round(sum(x), 3) AS weight, CAST(sum(label % 4) AS BIGINT) AS catl, round(sum(z), 3) AS eig FROM cloud GROUP BY cloud")
def feature_blocks(spark, sf):
    """Blocks with labels, weights, categories and eigen-features, written and read as one table."""
    path = scratch_dir(spark, "features")
    c = tables.scene_cloud(spark, sf)
    files.write_blocks(c.select("cloud", F.array("x", "y", "z").alias("data"), "label", F.col("x").alias("spw"), (F.col("label") % 4).alias("catl"), F.array("z", "y").alias("eig")), path)
    got = spark.read.parquet(path)
    return got.groupBy("cloud").agg(F.count("*").alias("n"), F.sum("label").alias("label"), F.round(F.sum("spw"), 3).alias("weight"), F.sum("catl").alias("catl"), F.round(F.sum(F.col("eig")[0]), 3).alias("eig"))


@query("k2_whole_blocks", f"WITH {CLOUD} SELECT (pid % 97) // 10 AS file, count(DISTINCT pid % 97) AS blocks, count(*) AS points FROM cloud GROUP BY 1")
def whole_blocks(spark, sf):
    """Files of at most ten whole blocks: by file, its blocks and points; a block of two files would count twice."""
    path = scratch_dir(spark, "rolled")
    files.write_whole_blocks(tables.scene_cloud(spark, sf).withColumn("block", F.col("pid") % 97), path, "block", 10)
    got = spark.read.parquet(path).withColumn("name", F.input_file_name())
    return got.groupBy("name").agg(F.first(F.col("file").cast("long")).alias("file"), F.countDistinct("block").alias("blocks"), F.count("*").alias("points")).drop("name")


@query("s12_k3_test_blocks", f"WITH {CLOUD} SELECT cloud, {SUMS} FROM cloud WHERE cloud = 'Area_5' GROUP BY cloud")
def scenes(spark, sf):
    """Rows in a folder for each scene; one scene read by partition pruning."""
    path = scratch_dir(spark, "scenes")
    files.write_by_scene(tables.scene_cloud(spark, sf), path)
    return _sums(spark.read.parquet(path).where("cloud = 'Area_5'"), "cloud")


@query("s13_k4_probabilities", f"WITH {CLOUD} SELECT pid, CAST(label % 3 AS INTEGER) AS best FROM cloud")
def probabilities(spark, sf):
    """Class scores with point ids written, read and decided."""
    path = scratch_dir(spark, "scores")
    c = tables.scene_cloud(spark, sf).select("pid", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(F.col("label") % 3 == i, F.lit(0.9)).otherwise(F.lit(0.05))).alias("probs"))
    c.write.option("compression", "gzip").parquet(path)
    return spark.read.parquet(path).select("pid", (F.array_position("probs", F.array_max("probs")) - 1).cast("int").alias("best"))


@query("s14_k5_pred_true_text", f"WITH {PRED} SELECT truth, pred, count(*) AS n FROM pt GROUP BY truth, pred")
def pred_true(spark, sf):
    """Prediction and truth lines of several files, read by a glob."""
    path = scratch_dir(spark, "pred")
    for i in range(2):
        files.write_pred_truth(tables.pred_truth(spark, sf).where(F.col("truth") % 2 == i), f"{path}/room{i}.pred_true")
    return files.read_pred_truth(spark, f"{path}/*.pred_true").groupBy("truth", "pred").agg(F.count("*").alias("n"))


@query("s15_a14_room_manifest", "SELECT 'Area_' || (o_orderkey % 6 + 1) AS area, 'office_' || (o_orderkey % 40) AS room, count(*) AS entries FROM orders GROUP BY ALL")
def manifest(spark, sf):
    """A list of rooms read by line, with area and room."""
    path = scratch_dir(spark, "rooms")
    o = tables.table(spark, sf, "orders")
    o.select(F.format_string("Area_%d_office_%d.npy", F.col("o_orderkey") % 6 + 1, F.col("o_orderkey") % 40).alias("value")).write.text(path)
    area, room = files.room_of(F.col("entry"))
    return files.read_manifest(spark, path).select(area.alias("area"), room.alias("room")).groupBy("area", "room").agg(F.count("*").alias("entries"))


@query("p19_class_names", "SELECT CASE o_orderkey % 5 WHEN 0 THEN 'ceiling' WHEN 1 THEN 'chair' WHEN 2 THEN 'clutter' WHEN 3 THEN 'clutter' ELSE 'wall' END AS class_name, count(*) AS n FROM orders GROUP BY 1")
def class_names(spark, sf):
    """Classes by file name, unknown ones as clutter."""
    names = F.element_at(F.array(*[F.lit(n) for n in ("ceiling", "chair", "stairs", "table-top", "wall")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    path = F.concat(F.lit("Area_1/office_1/Annotations/"), names, F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(".txt"))
    o = tables.table(spark, sf, "orders").select(files.class_of_file(path, ["ceiling", "floor", "wall", "chair", "table"]).alias("class_name"))
    return o.groupBy("class_name").agg(F.count("*").alias("n"))


@query("stream_class_counts", f"WITH {PRED}, u AS (SELECT truth AS c, 1 AS g, 0 AS p, CAST(truth = pred AS INTEGER) AS t FROM pt UNION ALL SELECT pred, 0, 1, 0 FROM pt) SELECT c AS class_id, CAST(sum(g) AS BIGINT) AS gt, CAST(sum(p) AS BIGINT) AS pos, CAST(sum(t) AS BIGINT) AS tp FROM u GROUP BY c")
def streamed(spark, sf):
    """Class counters of a stream of Parquet files, as the last micro-batch leaves them."""
    from pointwright.streaming.counters import counts_to, prediction_stream

    path = scratch_dir(spark, "stream")
    tables.pred_truth(spark, sf).select("truth", "pred").repartition(4).write.parquet(f"{path}/in")
    stream = prediction_stream(spark, f"{path}/in", files_per_trigger=2)
    counts_to(stream, f"{path}/state", lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}"))
    every = spark.read.parquet(f"{path}/out")
    return every.groupBy("class_id").agg(*[F.max_by(c, "batch").alias(c) for c in ("gt", "pos", "tp")])
