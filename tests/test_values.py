import math
import random

import pytest
from pyspark.sql import functions as F

from kvasir.functions import lists, vectors
from kvasir.operators import datasets, maps, spatial, topology
from kvasir.sources import ifc, rdf


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame([({"a": "1", "b": "", "c": "x", "d": None}, {"a": "1", "b": "2", "c": "y", "e": "5", "d": "9"})], "a map<string,string>, b map<string,string>")


@pytest.mark.parametrize("f,want", [
    (maps.union, {"a": "1", "b": "2", "c": '["x","y"]', "d": "9", "e": "5"}), (maps.intersection, {"a": "1", "b": '["","2"]', "c": '["x","y"]', "d": '[null,"9"]'}),
    (maps.difference, {}), (maps.symmetric_difference, {"e": "5"}), (maps.impose, {"a": "1", "b": "2", "c": "y", "d": "9", "e": "5"}), (maps.imprint, {"a": "1", "b": "2", "c": "y", "d": "9"}),
])
def test_maps(pair, f, want):
    assert pair.select(f(F.col("a"), F.col("b"))).first()[0] == want


def test_map_reads(pair):
    a = F.col("a")
    row = pair.select(maps.get(a, "d", "zz"), maps.get(a, "q", "zz"), maps.matches(a, "c", "equal to", "X"), maps.matches(a, "q", "contains", "1"), maps.matches(a, "q", "contains", ""),
                      maps.cluster_key(a, ["a", "d", "c"]), maps.cluster_key(F.create_map().cast("map<string,string>"), ["a"]), maps.remove_key(a, "C"), maps.one_hot(a, "c", ["x", "y"])).first()
    assert tuple(row)[:7] == (None, "zz", True, False, True, '["1","x"]', "_NONE_")
    assert row[7] == {"a": "1", "b": "", "d": None} and row[8] == {"a": "1", "b": "", "d": None, "c_0": "1", "c_1": "0"}


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    row = spark.range(1).select(vectors.cross(v(1, 0, 0), v(0, 1, 0)), vectors.angle(v(1, 0, 0), v(0, 2, 0)), vectors.compass_angle(v(1, 0, 0)), vectors.compass_angle(v(-1, 0, 0)),
                                vectors.normalize(v(0, 0, 0)), vectors.is_parallel(v(1, 2, 3), v(-2, -4, -6)), vectors.matrix_multiply(vectors.identity(2), F.array(v(1, 2), v(3, 4)))).first()
    assert tuple(row) == ([0, 0, 1], 90.0, 90.0, 270.0, None, True, [[1, 2], [3, 4]])


def test_lists(spark):
    v = F.array(*[F.lit(float(x)) for x in (1, 1.2, 5, 9)])
    row = spark.range(1).select(lists.merge_by_threshold(v, 0.5), lists.closest_index(v, F.lit(5.4)), lists.repeat_to(v, 5), lists.trim(v, 2)).first()
    assert row[0] == [1.1, 5.0, 9.0] and tuple(row)[1:] == (2, [1.0, 1.2, 5.0, 9.0, 1.0], [1.0, 1.2])


@pytest.fixture(scope="module")
def cloud(spark):
    random.seed(5)
    blobs = [(cx + random.gauss(0, 0.3), cy + random.gauss(0, 0.3), 0.0) for cx, cy in ((0, 0), (4, 0), (0, 4)) for _ in range(9)] + [(2.0, 2.0, 0.0), (9.0, 9.0, 0.0), (0.0, 0.0, 0.0)]
    pts = [(i, *map(lambda c: round(c, 6), p)) for i, p in enumerate(blobs)]
    return pts, spark.createDataFrame(pts, "pid long, x double, y double, z double")


def dist(p, q):
    return math.dist(p[1:], q[1:])


def test_nearest_and_pairs(cloud):
    pts, df = cloud
    near = {(r.a, r.b) for r in spatial.near_pairs(df, 0.5).collect()}
    assert near == {(p[0], q[0]) for p in pts for q in pts if p != q and dist(p, q) ** 2 < 0.25}
    asked = df.withColumnRenamed("pid", "qid")
    got = {(r.qid, r.rank): r.pid for r in spatial.nearest(df, asked, 3, 0.2).collect()}
    for p in pts:
        order = sorted(pts, key=lambda q: (sum((a - b) ** 2 for a, b in zip(p[1:], q[1:])), q[0]))
        assert [got[(p[0], k)] for k in (1, 2, 3)] == [q[0] for q in order[:3]]


def test_dbscan_and_fuse(cloud):
    pts, df = cloud
    eps, least = 0.6, 4
    near = {p[0]: [q[0] for q in pts if dist(p, q) < eps] for p in pts}
    label, k = {}, 0
    for p in near:
        if p in label or len(near[p]) < least:
            continue
        k += 1
        stack = [p]
        while stack:
            x = stack.pop()
            if label.get(x, 0):
                continue
            label[x] = k
            if len(near[x]) >= least:
                stack.extend(near[x])
    assert {r.pid: r.cluster for r in spatial.dbscan(df, eps, least).collect()} == {p[0]: label.get(p[0], 0) for p in pts}
    seeds, want = [], {}
    for p in pts:
        hit = [s for s in seeds if dist(p, s) <= 0.4]
        want[p[0]] = hit[0][0] if hit else p[0]
        if not hit:
            seeds.append(p)
    assert {r.pid: r.seed for r in spatial.fuse(df, 0.4).collect()} == want


def test_fuse_of_close_points_takes_few_rounds(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, *[rng.random() * 0.1 + 3 * (k % 2) for _ in "xyz"]) for k in range(60)] + [(60 + k, 0.05, 0.05, 0.05) for k in range(20)]
    odd = [(100, None, 0.0, 0.0), (101, float("nan"), 0.0, 0.0), (102, None, 0.0, 0.0), (103, float("inf"), 0.0, 0.0)]
    calls, keep = [], spatial.iterate.keep
    monkeypatch.setattr(spatial.iterate, "keep", lambda df: calls.append(1) or keep(df))
    df = spark.createDataFrame(rows + odd, "pid long, x double, y double, z double")
    got = {r.pid: r.seed for r in spatial.fuse(df, 0.4).collect()}
    assert got == {k: (k % 2 if k < 60 else 0) for k, *_ in rows} | {k: k for k, *_ in odd} and len(calls) <= 6


def test_boxes_touch(spark):
    rows = [(0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (1, 1.0, 0.0, 0.0, 2.0, 1.0, 1.0), (2, 3.0, 3.0, 3.0, 4.0, 4.0, 4.0), (3, -5.0, -5.0, -5.0, 5.0, 5.0, 5.0)]
    boxes = spark.createDataFrame(rows, "bid long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    assert sorted(map(tuple, spatial.box_pairs(boxes, 0.7).collect())) == [(0, 1), (0, 3), (1, 3), (2, 3)]
    assert [r.bid for r in spatial.ray_hits(boxes, (-1.0, 0.5, 0.5), (1.0, 0.0, 0.0)).orderBy("bid").collect()] == [0, 1, 3]


def test_cube(spark):
    boxes = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 10.0, 10.0, 10.0)], "bid long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    v, f, c = topology.boxes_as_cells(boxes)
    assert topology.face_areas(v, f).agg(F.sum("area")).first()[0] == 600 and topology.cell_volumes(v, f, c).first()["volume"] == 1000
    assert topology.boundary_faces(c).count() == 6


def test_scores(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (2, 1), (2, 2), (1, None)], "y int, g int")
    r = datasets.classification_metrics(df, "y", "g").first()
    assert (r.accuracy, round(r.precision, 6), round(r.recall, 6)) == (0.6, 0.7, 0.6)
    p = spark.createDataFrame([(1, 1, 5), (2, 2, 4), (3, 2, 4), (4, 1, 4), (5, 0, 5)], "k int, a int, b int")
    assert sorted(x.k for x in datasets.pareto_front(p, "k", ["a", "b"]).collect()) == [1, 2, 3]
    three = p.withColumn("c", F.lit(1))
    assert sorted(x.k for x in datasets.pareto_front(three, "k", ["a", "b", "c"]).collect()) == [1, 2, 3]
    cells = spark.createDataFrame([("[1, 2]",), ("3",), ("4,5",)], "c string")
    assert [x[0] for x in cells.select(datasets.resized(datasets.feature_cell(F.col("c")), 2)).collect()] == [[1, 2], [3, 0], [4, 5]]
    m = spark.createDataFrame([(True, None, None), (None, True, False), (None, None, None)], "a boolean, b boolean, c boolean")
    assert [x[0] for x in m.select(datasets.masks(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["train", "val", "none"]


STEP = ["#1=IFCSPACE('g',$,'Room (1)',$)", "#2 = IFCSPACE('h',$,'It''s',$)", "#3=IFCDOOR('d',$,$,(#1,#2),1.5E0)", "#4=IFCRELSPACEBOUNDARY('b',$,$,$,#1,#3,$)",
        "#5=IFCRELSPACEBOUNDARY('b',$,$,$,#2,#3,$)", "#6=IFCRELAGGREGATES('r',$,$,$,#1,(#2,#3))", "ENDSEC", "#7=IFCBAD((", None]


def test_building_records(spark):
    from kvasir.functions.shipping import ship

    ship(spark)
    ents = ifc.entities(spark.createDataFrame([(x,) for x in STEP], "value string"))
    assert ents.count() == 6
    t = {tuple(r) for r in ifc.triples(ents).collect()}
    assert ("inst:1", "bot:hasSubElement", "inst:3") in t and ("inst:2", "rdfs:label", '"It\'s"') in t and ("inst:3", "rdf:type", "ifc:IFCDOOR") in t
    assert [tuple(r) for r in ifc.access_graph(ents).collect()] == [(1, 2, 3)]
    assert [tuple(r) for r in ifc.connector_report(ents).collect()] == [(3, 2, "normal")]


def test_ntriples(spark, tmp_path):
    lines = ['<a> <p> <b> .', '<a> <p> "x \\" y"@en .', "# no", "<a> <p>", '<a> <p> <b> .']
    t = rdf.parse_ntriples(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert t.count() == 2
    rdf.as_ntriples(t).write.text(str(tmp_path / "o"))
    assert set(map(tuple, rdf.read_ntriples(spark, str(tmp_path / "o")).collect())) == set(map(tuple, t.collect()))
