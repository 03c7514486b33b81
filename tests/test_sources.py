"""File formats."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointwright.sources import files
from pointwright.streaming.counters import counts_to, prediction_stream


def test_ply_round_trip_and_ascii(spark, tmp_path):
    columns = {"x": np.array([0.5, 1.5]), "y": np.array([1.0, 2.0]), "z": np.array([0.0, -1.0]), "r": np.array([1, 255]), "g": np.array([2, 3]), "b": np.array([4, 5]), "label": np.array([7, 12])}
    data = files.format_ply(columns)
    assert all((files.parse_ply(data)[n] == columns[c]).all() for n, c in (("x", "x"), ("red", "r"), ("label", "label")))
    (tmp_path / "a.ply").write_bytes(data)
    (tmp_path / "b.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\n" + "".join(f"property float {n}\n" for n in ("x", "y", "z", "red", "green", "blue", "scalar_intensity", "scalar_label")) + "end_header\n1 2 3 4 5 6 0.5 9\n")
    assert [(r.x, r.r, r.label) for r in files.read_points(spark, f"{tmp_path}/a.ply").orderBy("row").collect()] == [(0.5, 1.0, 7.0), (1.5, 255.0, 12.0)]
    row = files.read_ply(spark, f"{tmp_path}/b.ply", "xyzrgbIL").first()
    assert (row.intensity, row.label) == (0.5, 9.0)


def test_unknown_suffix(spark):
    with pytest.raises(ValueError):
        files.read_points(spark, "room.las")


def test_annotation_text_and_names(spark, tmp_path):
    for name in ("chair_1", "sofa_2"):
        (tmp_path / f"{name}.txt").write_text("0.1 0.2 0.3 10 20 30\n\n1 2 3 4 5 6\n")
    df = files.read_text(spark, f"{tmp_path}/*.txt", "xyzrgb").select("x", files.class_of_file(F.col("file"), ["chair"]).alias("c"))
    assert sorted((r.x, r.c) for r in df.collect()) == [(0.1, "chair"), (0.1, "clutter"), (1.0, "chair"), (1.0, "clutter")]


def test_manifest_rooms(spark, tmp_path):
    (tmp_path / "m.txt").write_text("Area_1_hallway_6.npy \nArea_5/office_12/Annotations\n\n")
    area, room = files.room_of(F.col("entry"))
    assert {tuple(r) for r in files.read_manifest(spark, f"{tmp_path}/m.txt").select(area, room).collect()} == {("Area_1", "hallway_6"), ("Area_5", "office_12")}


def test_blocks_roll(spark, tmp_path):
    files.write_blocks(spark.range(100).coalesce(1), f"{tmp_path}/b", rows_per_file=30)
    assert len(list((tmp_path / "b").glob("*.parquet"))) == 4 and spark.read.parquet(f"{tmp_path}/b").count() == 100


def test_stream_takes_up_where_it_stopped(spark, tmp_path):
    got = {}

    def keep(batch, number):
        got.update({r.class_id: (r.gt, r.pos, r.tp) for r in batch.collect()})

    one = spark.createDataFrame([(0, 0), (1, 0)], "truth long, pred long")
    for expected in ((1, 2, 1), (2, 4, 2)):
        one.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        counts_to(prediction_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/state", keep)
        assert got[0] == expected
