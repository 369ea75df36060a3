import re

import pytest
from pyspark.sql import functions as F

from kvasir.operators import topology
from kvasir.plans import catalogue

#: The one row that topo_largest_faces and topo_smallest_faces broadcast.
ONE_ROW = {"topo_largest_faces": 1, "topo_smallest_faces": 1}


@pytest.mark.parametrize("name", [
    "topo_adjacent_faces",
    "topo_area",
    "topo_bounding_box",
    "topo_centroid",
    "topo_centre_of_mass",
    "topo_cluster_faces",
    "topo_complex",
    "topo_enclosing_cells",
    "topo_decompose",
    "topo_largest_faces",
    "topo_length",
    "topo_smallest_faces",
    "topo_sub_counts",
    "topo_super_counts",
    "topo_volume",
    "topo_shared",
])
def test_exploded_tables_are_not_broadcast(spark, name):
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and len(re.findall("BroadcastHashJoin", plan)) == ONE_ROW.get(name, 0)


@pytest.mark.parametrize("name, shuffles", [("topo_decompose", 2), ("topo_largest_faces", 3), ("topo_smallest_faces", 3)])
def test_faces_of_boxes_are_measured_without_joins(spark, name, shuffles):
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan and len(re.findall(r"\bExchange ", plan)) == shuffles


@pytest.mark.parametrize("name", ["topo_largest_faces", "topo_smallest_faces"])
def test_only_boxes_of_the_extreme_become_faces(spark, name):
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.index("Generate explode") < plan.index("BroadcastHashJoin")


@pytest.mark.parametrize("largest", [True, False])
def test_extreme_sides_are_the_extreme_of_all_faces(spark, largest):
    nan, rows = float("nan"), [(1, 0.0, 2.0, 0.0, 3.5, 1.0, 5.0), (7, -1.25, 0.1, 2.0, 2.7, -3.0, 9.9), (8, 0.0, 0.7, 0.0, 1.351, 0.0, 12.9), (9, 0.0, None, 0.0, 1.0, 0.0, 0.5), (-3, 0.0, 0.7, 0.0, 1.3493, 0.0, 12.9)]
    shown = lambda df: sorted(map(repr, df.collect()))
    for boxes in (rows, [*rows, (10, 0.0, nan, 0.0, 1.0, 0.0, 2.0)], []):
        boxes = spark.createDataFrame(boxes, "bid long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
        areas = topology.loop_areas(topology.boxes_as_loops(boxes), 4).withColumn("area", F.round("area", 2))
        want = shown(topology.extreme(areas, "fid", "area", largest))
        assert shown(topology.extreme_sides(boxes, 2, largest)) == want and (want or not boxes.count())


def test_loops_measure_as_incidence_tables_do(spark):
    boxes = spark.createDataFrame([(1, 0.0, 2.0, 0.0, 3.5, 1.0, 5.0), (7, -1.25, 0.1, 2.0, 2.7, -3.0, 9.9)], "bid long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    v, f, _ = topology.boxes_as_cells(boxes)
    loops = topology.boxes_as_loops(boxes)
    assert sorted(topology.loop_areas(loops, 4).collect()) == sorted(topology.face_areas(v, f).collect())
    assert sorted(topology.loop_tilts(loops, 4).collect()) == sorted(topology.tilts(v, f).collect())
