import random

import pytest

from kvasir.operators import edits, networks, sparql, topology, triples

POINTS = [(0, 0.0, 0.0, 0.0), (1, 0.0, 10.0, 0.0), (2, 10.0, 10.0, 0.0)]


def graph(spark):
    vertices = spark.createDataFrame(POINTS, "vid long, x double, y double, z double")
    at = lambda *p: tuple(float(c) for c in p)
    ends = [(at(0, 0, 0), at(0, 10, 0)), (at(0, 0, 0), at(10, 10, 0)), (at(0, 0, 0), at(10, 0, 0)), (at(0, 0, 0), at(0, 0, 10.000001))]
    segments = spark.createDataFrame([(i, *a, *b) for i, (a, b) in enumerate(ends)], "eid long, ax double, ay double, az double, bx double, by double, bz double")
    return edits.by_vertices_edges(vertices, segments)


def test_missing_ends_are_added_and_points_welded(spark):
    v, e = graph(spark)
    assert v.count() == 5 and e.count() == 4 and {r.src for r in e.collect()} == {0}
    again = edits.add_vertices(v, spark.createDataFrame([(9, 5.0, 5.0, 5.0), (10, 0.0, 10.0, 0.00001), (11, 5.0, 5.0, 5.0)], "vid long, x double, y double, z double"))
    assert again.count() == 6 and edits.add_vertices(again, again).count() == 6
    found = edits.contains_vertices(v, spark.createDataFrame([(1, 0.0, 10.0, 0.0), (2, 9.0, 9.0, 9.0)], "pid long, x double, y double, z double"))
    assert {r.pid: r.vid for r in found.collect()} == {1: 1, 2: None}


def test_edges_change_either_way_round(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    e = pairs([(0, 1), (1, 2), (2, 3)])
    assert edits.add_edges(e, pairs([(1, 0), (3, 0)])).count() == 4
    assert {tuple(r) for r in edits.remove_edges(e, pairs([(2, 1)])).collect()} == {(0, 1), (2, 3)}
    assert [r.found for r in edits.contains_edges(e, pairs([(3, 2)])).collect()] == [True]
    assert {tuple(r) for r in edits.neighbours(e, "in").collect()} == {(1, 0), (2, 1), (3, 2)}
    assert {tuple(r) for r in edits.depth_map(e, 0).collect()} == {(0, 1), (1, 1), (2, 1), (3, 1)}


def test_places_follow_ids(spark):
    ids = random.Random(1).sample(range(10_000), 500)
    got = {r.vid: r.place for r in edits.indices(spark.createDataFrame([(i,) for i in ids], "vid long").repartition(7)).collect()}
    assert got == {v: k for k, v in enumerate(sorted(ids))}


def test_a_chain_of_forty_classes(spark):
    t = spark.createDataFrame([(f"c{i:02}", triples.SUBCLASS, f"c{i + 1:02}") for i in range(40)], "s string, p string, o string").coalesce(1)
    assert triples.superclass_path(t, "c00", "c40").first().length == 40
    loop = spark.createDataFrame([("a", triples.SUBCLASS, "b"), ("b", triples.SUBCLASS, "a")], "s string, p string, o string")
    assert triples.superclass_path(loop, "a", "none").count() == 0


@pytest.mark.parametrize("pairs", [[(0, 1)], [(0, 1), (1, 2), (2, 3)], [(i, (i + 1) % 8) for i in range(8)], [(0, i) for i in range(1, 7)]])
def test_communities_settle(spark, pairs):
    nodes = spark.createDataFrame([(i,) for i in {x for p in pairs for x in p}], "node long")
    got = networks.communities(nodes, spark.createDataFrame(pairs, "src long, dst long")).collect()
    assert len(got) == nodes.count()


def test_sparql_forms(spark):
    rows = [("a", "rdf:type", "C"), ("b", "rdf:type", "C"), ("a", "p:n", '"10"'), ("b", "p:n", '"9"'), ("b", "p:k", '"x y"@en'), ("c", "p:n", '"2"')]
    t = spark.createDataFrame([tuple(f"x:{c}" if ":" not in c and not c.startswith('"') else c for c in r) for r in rows], "s string, p string, o string")
    ask = lambda text: [tuple(r) for r in sparql.query(t, text).collect()]
    assert ask("SELECT ?s WHERE { ?s p:n ?n . FILTER(?n > 5) } ORDER BY ?n") == [("x:b",), ("x:a",)]
    assert ask("SELECT ?s ?k WHERE { ?s a x:C OPTIONAL { ?s p:k ?k } } ORDER BY ?s") == [("x:a", None), ("x:b", '"x y"@en')]
    assert ask('SELECT ?s WHERE { ?s p:k ?k . FILTER(regex(?k, "^X", "i") && isLiteral(?k)) }') == [("x:b",)]
    assert ask("SELECT (COUNT(*) AS ?n) WHERE { ?s p:n ?o }") == [(3,)] and ask("ASK { x:a p:n \"11\" }") == [(False,)]
    assert ask("SELECT DISTINCT ?s WHERE { { ?s a x:C } UNION { ?s p:n \"2\" } } ORDER BY DESC(?s) LIMIT 2 OFFSET 1") == [("x:b",), ("x:a",)]
    assert sparql.update(t, "DELETE WHERE { ?s a x:C . ?s p:n ?n }").count() == 2
    assert sparql.update(t, 'INSERT DATA { x:d a x:C ; p:n "1", "2" }').count() == 9
    for bad in ("SELECT ?s WHERE { ?s p:n", "SELECT ?s WHERE { ?s a x:C . ?t a x:C OPTIONAL { ?u p:k ?v } }", "ASK { ?s € ?o }"):
        with pytest.raises(ValueError):
            sparql.query(t, bad)


def test_enclosing_cells(spark):
    boxes = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 2.0, 2.0, 2.0), (1, 1.0, 1.0, 1.0, 9.0, 9.0, 9.0)], "bid long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    points = spark.createDataFrame([(0, 0.5, 0.5, 0.5), (1, 1.5, 1.5, 1.5), (2, 2.0, 1.5, 1.5), (3, 20.0, 0.0, 0.0)], "pid long, x double, y double, z double")
    got = {(r.pid, r.cid): r.status for r in topology.enclosing_cells(*topology.boxes_as_cells(boxes), points, 3.0).collect()}
    assert got == {(0, 0): 0, (1, 0): 0, (1, 1): 0, (2, 0): 1, (2, 1): 0}
