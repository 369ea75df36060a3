import pytest
from pyspark.sql import functions as F

from kvasir.operators import pattern
from kvasir.operators.model import Graph

SCHEMA_V = "vid long, label string, category string, ontology_class string, type string, props map<string,string>"
SCHEMA_E = "eid long, src long, dst long, label string, category string, ontology_class string, type string, props map<string,string>"


@pytest.fixture(scope="module")
def dirty(spark):
    """Dangling edge, loop, parallel edges, number-like and null properties."""
    v = [(1, "Room", None, "bot:Space", None, {"name": "a", "area": "10"}), (2, "Room", None, None, None, {"name": "b", "area": "9.5"}),
         (3, None, "Door", None, None, {"name": "c"}), (4, "top:Room", None, None, None, {"name": "d", "area": "big"})]
    e = [(1, 1, 2, "NEAR", None, None, None, {}), (2, 1, 2, "NEAR", None, None, None, {"w": "2"}), (3, 3, 3, "SELF", None, None, None, {}),
         (4, 1, 99, "NEAR", None, None, None, {}), (5, 2, 4, "NEAR", None, None, None, {}), (6, 3, 1, "OPENS", None, None, None, {})]
    return Graph(spark.createDataFrame(v, SCHEMA_V), spark.createDataFrame(e, SCHEMA_E))


def rows(graph, text):
    return [tuple(r) for r in pattern.query(graph, text).collect()]


def test_directions_keep_parallel_and_loops(dirty):
    assert sorted(rows(dirty, "MATCH (a)-[r]->(b) RETURN a.name AS a, b.name AS b")) == [("a", "b"), ("a", "b"), ("b", "d"), ("c", "a"), ("c", "c")]
    assert len(rows(dirty, "MATCH (a)-[r]-(b) RETURN a.name AS a")) == 10
    assert sorted(rows(dirty, "MATCH (a)<-[r:OPENS]-(b) RETURN a.name AS a, b.name AS b")) == [("a", "c")]
    assert len(rows(dirty, "MATCH (a)--(b) RETURN *")) == 10


def test_labels_by_local_name_and_prefix(dirty):
    assert {r[0] for r in rows(dirty, "MATCH (a)-[r]->(b:room) RETURN b.name AS b")} == {"b", "d", "a"}
    assert rows(dirty, "MATCH (a:door)-[r:OPENS]->(b:top:Room) RETURN a.name AS a") == [("c",)]
    assert rows(dirty, "MATCH (a:space)-[r]->(b:Nothing) RETURN a.name AS a") == []


@pytest.mark.parametrize("where,want", [
    ("b.area > 9", {"a", "b"}), ("b.area = '10'", {"a"}), ("b.area <> 10", {"b", "d", "c"}), ("b.area = NULL", {"c"}), ("b.area <> NULL", {"a", "b", "d"}),
    ("b.area < 'zzz'", {"d"}), ("zz.area = 1", set()), ("b.name = a OR b.name = b AND b.area > 100", {"a"}), ("(b.name = a OR b.name = b) AND b.area > 9.9", {"a"}),
])
def test_two_valued_comparison(dirty, where, want):
    assert {r[0] for r in rows(dirty, f"MATCH (a)-[r]->(b) WHERE {where} RETURN b.name AS b")} == want


def test_counts_and_first_value(dirty):
    assert rows(dirty, "MATCH (a)-[r]->(b) RETURN COUNT(*) AS n, COUNT(b.area) AS k, COUNT(DISTINCT b.area) AS d, a.name AS first") == [(5, 4, 3, "a")]
    q = pattern.query(dirty, "MATCH (a)-[r]->(b) WHERE a.name = nobody RETURN COUNT(DISTINCT b.area), a.name")
    assert q.columns == ["COUNT(DISTINCT b.area)", "a.name"] and tuple(q.first()) == (0, None)


def test_order_skip_limit(dirty):
    assert [r[0] for r in rows(dirty, "MATCH (a)-[r]->(b) RETURN b.area AS area ORDER BY area DESC")] == [None, "big", "10", "9.5", "9.5"]
    got = [r[0] for r in rows(dirty, "MATCH (a)-[r]->(b:Room) RETURN DISTINCT b.name AS n ORDER BY n SKIP 1 LIMIT 1")]
    assert got == ["b"]
    assert [r[0] for r in rows(dirty, "MATCH (a)-[r]->(b) RETURN b.name AS n ORDER BY area LIMIT 2")] == ["b", "b"]  # an unreturned key sorts nothing
    assert [r[0] for r in rows(dirty, "MATCH (a)-[r]->(b) RETURN b.area AS area ORDER BY area")][-1] is None


def test_changes(dirty):
    r = pattern.run(dirty, "CREATE (x:Room {name: 'e'})-[q:NEAR {w: 1}]->(y:Room {name: 'f'})")
    assert (r.created, r.graph.vertices.count(), r.graph.edges.count()) == (3, 6, 7)
    assert rows(r.graph, "MATCH (x)-[q]->(y) WHERE x.name = e RETURN q.w AS w, y.name AS y") == [("1", "f")]
    assert pattern.run(dirty, "MERGE (x:Room {name: 'a'})").matched == 1
    assert pattern.run(dirty, "MERGE (x:Room {name: 'a'})-[q:OPENS]->(y:Room {name: 'b'})").created == 3
    r = pattern.run(dirty, "MATCH (a)-[r:NEAR]->(b) SET a.seen = yes, b.area = 1")
    assert (r.matched, r.updated) == (3, 6)
    assert r.graph.vertices.filter(F.element_at("props", "area") == "1").count() == 2
    r = pattern.run(dirty, "MATCH (a)-[r:OPENS]->(b) DELETE b")
    assert (r.deleted, r.graph.vertices.count(), r.graph.edges.count()) == (5, 3, 2)


@pytest.mark.parametrize("text", ["MATCH (a) RETURN a", "MATCH (a)-[r]->(b)", "RETURN 1", "MATCH (a)-[r]->(b) RETURN a extra", "MATCH (a)-[r]->(b) WHERE a.x ~ 1 RETURN a"])
def test_errors(text):
    with pytest.raises(pattern.PatternError):
        pattern.parse(text)
