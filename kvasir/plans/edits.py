"""Graphs built, changed and looked up, over parts that share orders, points and the geography."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvasir.operators import edits
from kvasir.plans.analysis import _PT
from kvasir.plans.graphs import _CO, _SL, _buyers, _parts, _regional, _slices
from kvasir.sources import tables
from kvasir.sources.tables import CUSTOMER, NATION, SUPPLIER


def _points(s, d):
    return tables.points(s, d).select(F.col("pid").alias("vid"), "x", "y", "z")


def _ring(s, d):
    """Edges between successive points, and from every third to the fifth after it."""
    p = _points(s, d).select("vid")
    steps = F.when(F.col("vid") % 3 == 0, F.array(F.lit(1), F.lit(5))).otherwise(F.array(F.lit(1)))
    e = p.select(F.col("vid").alias("src"), F.explode(steps).alias("step")).select("src", (F.col("src") + F.col("step")).alias("dst"))
    return e.join(p.select(F.col("vid").alias("dst")), "dst", "left_semi").select("src", "dst")


def _moved(s, d):
    """Even points where they are, odd ones a unit to the east, under new ids."""
    return _points(s, d).withColumn("x", F.when(F.col("vid") % 2 == 0, F.col("x")).otherwise(F.col("x") + 1)).withColumn("vid", F.col("vid") + 100_000)


def _welded(s, d):
    p = _points(s, d)
    ends = edits.edge_ends(p, _ring(s, d)).withColumn("eid", F.xxhash64("src", "dst"))
    return edits.by_vertices_edges(p.filter("vid % 2 = 0"), ends)


def _by_vertices_edges(s, d):
    v, e = _welded(s, d)
    return v.agg(F.count(F.lit(1)).alias("n_vertices"), F.count_if(F.col("vid") < 0).alias("n_added"), F.round(F.sum("x"), 3).alias("sum_x")).crossJoin(e.agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.expr("src >= 0 AND dst >= 0")).alias("n_between_listed")))


def _next_parts(s, d):
    return _parts(s, d).select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst"))


def _regional_points(s, d):
    nodes, pairs = _regional(s, d)
    return nodes.select(F.col("node").alias("vid"), F.col("node").cast("double").alias("x"), F.lit(0.5).alias("y"), F.lit(0.0).alias("z")), pairs


def _region_weights(s, d):
    nodes, pairs = _regional(s, d)
    return nodes, pairs.select("src", "dst", (F.col("src") % 7 + 1).alias("weight"))


def _mesh(s, d):
    m = edits.mesh_data(*_regional_points(s, d))
    v, e = edits.by_mesh_data(m)
    return m.select(F.size("vertices").alias("n_vertices"), F.size("edges").alias("n_edges")).crossJoin(e.agg(F.sum("src").alias("src"), F.sum("dst").alias("dst"))).crossJoin(v.agg(F.sum("x").alias("x")))


def _json(s, d):
    v, e = edits.by_json_rows(edits.json_rows(_points(s, d), _ring(s, d)))
    return v.join(e.groupBy(F.col("src").alias("vid")).agg(F.sum("dst").alias("to")), "vid", "left").select("vid", "x", F.coalesce("to", F.lit(0)).alias("to"))


def _compare(s, d):
    a, b = _slices(s, d)
    nodes = lambda e: e.select(F.col("src").alias("node")).distinct()
    return edits.compare(nodes(a), a, nodes(b), b).select(*[F.round(c, 9).alias(c) for c in ("nodes", "edges", "similarity")])


def _matrix(s, d):
    return edits.adjacency_matrix(*_region_weights(s, d))


QUERIES = {
    "graph_by_vertices_edges": _by_vertices_edges,
    "graph_add_vertices": lambda s, d: edits.add_vertices(_points(s, d), _moved(s, d)).select("vid", "x"),
    "graph_contains_vertices": lambda s, d: edits.contains_vertices(_points(s, d), _moved(s, d).withColumnRenamed("vid", "pid")),
    "graph_contains_edges": lambda s, d: edits.contains_edges(tables.copurchase(s, d), _next_parts(s, d)),
    "graph_add_edges": lambda s, d: edits.add_edges(tables.copurchase(s, d), _next_parts(s, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))),
    "graph_remove_edges": lambda s, d: edits.remove_edges(tables.copurchase(s, d), _next_parts(s, d)),
    "graph_remove_isolated": lambda s, d: (lambda n, e: edits.remove_isolated(n.select(F.col("node").alias("vid")), e))(*_buyers(s, d)),
    "graph_connect": lambda s, d: (lambda n: edits.connect(n.select(F.col("n_nationkey").alias("ord"), (F.col("n_nationkey") + 0).cast("long").alias("node")), n.select((24 - F.col("n_nationkey")).alias("ord"), F.col("n_nationkey").cast("long").alias("node"))))(tables.table(s, d, "nation")),
    "graph_complete": lambda s, d: edits.complete(tables.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"))),
    "graph_counts": lambda s, d: edits.counts(_parts(s, d), tables.copurchase(s, d)),
    "graph_neighbours": lambda s, d: (lambda e: edits.neighbours(e, "in").groupBy("node").agg(F.count(F.lit(1)).alias("n_in")).join(edits.neighbours(e, "out").groupBy("node").agg(F.count(F.lit(1)).alias("n_out")), "node", "full").join(edits.neighbours(e).groupBy("node").agg(F.count(F.lit(1)).alias("n_all")), "node", "full"))(tables.copurchase(s, d)),
    "graph_edge_ends": lambda s, d: edits.edge_ends(_points(s, d), _ring(s, d)).select("src", "dst", F.round("ax", 6).alias("ax"), F.round("bz", 6).alias("bz")),
    "graph_neighbours_by_direction": lambda s, d: edits.neighbours_by_direction(_points(s, d), _ring(s, d), "northeast"),
    "graph_neighbours_by_vector": lambda s, d: edits.neighbours_by_vector(_points(s, d), _ring(s, d), (1.0, 0.0, 0.0), 50.0),
    "graph_adjacency_map": lambda s, d: edits.adjacency_map(tables.copurchase(s, d)).select("node", F.size("neighbours").alias("n"), F.aggregate(F.map_values("neighbours"), F.lit(0).cast("long"), lambda a, x: a + x).alias("weight"), F.array_max(F.map_keys("neighbours")).alias("last")),
    "graph_adjacency_matrix": lambda s, d: _matrix(s, d).select("node", F.array_join(F.col("row").cast("array<string>"), ",").alias("row")),
    "graph_by_adjacency_matrix": lambda s, d: edits.by_adjacency_matrix(_matrix(s, d)).select("src", "dst", F.col("weight").cast("long").alias("weight")),
    "graph_vertex_index": lambda s, d: edits.indices(_parts(s, d).select((F.col("node") * 3).alias("vid"))),
    "graph_mesh_data": _mesh,
    "graph_json": _json,
    "graph_compare": _compare,
    "graph_depth_map": lambda s, d: edits.depth_map(tables.geography(s, d).edges.select("src", "dst"), 0),
    "graph_path_tree": lambda s, d: edits.shortest_tree(tables.geography(s, d).edges.select("src", "dst"), 0).select("node", F.coalesce("parent", F.lit(-1)).alias("parent"), "depth"),
}

_RING = f"{_PT}, ring AS (SELECT a.pid AS src, b.pid AS dst FROM pt a JOIN pt b ON b.pid = a.pid + 1 OR (a.pid % 3 = 0 AND b.pid = a.pid + 5))"
_NEXT = "nx AS (SELECT p_partkey AS src, p_partkey + 1 AS dst FROM part)"
_BOTH = "both_ AS (SELECT e.src AS node, e.dst AS neighbour, q.x - p.x AS dx, q.y - p.y AS dy, q.z - p.z AS dz FROM (SELECT src, dst FROM ring UNION SELECT dst, src FROM ring) e JOIN pt p ON p.pid = e.src JOIN pt q ON q.pid = e.dst)"
_REG = f"nodes AS (SELECT r_regionkey::BIGINT AS node FROM region UNION ALL SELECT n_nationkey + {NATION} FROM nation), e AS (SELECT n_nationkey::BIGINT + {NATION} AS src, n_regionkey::BIGINT AS dst, (n_nationkey + {NATION}) % 7 + 1 AS w FROM nation)"
_TREE = f"""n AS (SELECT n_nationkey::BIGINT + {NATION} AS node, 0::BIGINT AS parent, 1 AS depth FROM nation WHERE n_regionkey = 0),
t AS (SELECT 0::BIGINT AS node, -1::BIGINT AS parent, 0 AS depth UNION ALL SELECT * FROM n
UNION ALL SELECT c_custkey + {CUSTOMER}, node, 2 FROM customer JOIN n ON c_nationkey + {NATION} = node UNION ALL SELECT s_suppkey + {SUPPLIER}, node, 2 FROM supplier JOIN n ON s_nationkey + {NATION} = node)"""
SQL = {
    "graph_by_vertices_edges": f"WITH {_RING}, ends AS (SELECT src AS v FROM ring UNION SELECT dst FROM ring), every_ AS (SELECT pid FROM pt WHERE pid % 2 = 0 UNION SELECT v FROM ends) SELECT count(*) AS n_vertices, count(*) FILTER (pid % 2 = 1) AS n_added, round(sum(x), 3) AS sum_x, (SELECT count(*) FROM ring) AS n_edges, (SELECT count(*) FROM ring WHERE src % 2 = 0 AND dst % 2 = 0) AS n_between_listed FROM every_ JOIN pt USING (pid)",
    "graph_add_vertices": f"WITH {_PT} SELECT pid AS vid, x FROM pt UNION ALL SELECT pid + 100000, x + 1 FROM pt WHERE pid % 2 = 1",
    "graph_contains_vertices": f"WITH {_PT} SELECT pid + 100000 AS pid, CASE WHEN pid % 2 = 0 THEN pid END AS vid FROM pt",
    "graph_contains_edges": f"WITH {_CO}, {_NEXT} SELECT nx.src, nx.dst, co.src IS NOT NULL AS found FROM nx LEFT JOIN co ON co.src = nx.src AND co.dst = nx.dst",
    "graph_add_edges": f"WITH {_CO}, {_NEXT} SELECT src, dst FROM co UNION SELECT src, dst FROM nx",
    "graph_remove_edges": f"WITH {_CO} SELECT src, dst FROM co WHERE dst <> src + 1",
    "graph_remove_isolated": "SELECT c_custkey AS vid FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "graph_connect": "SELECT n_nationkey::BIGINT AS src, (24 - n_nationkey)::BIGINT AS dst FROM nation WHERE n_nationkey <> 12",
    "graph_complete": "SELECT a.n_nationkey::BIGINT AS src, b.n_nationkey::BIGINT AS dst FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey",
    "graph_counts": f"WITH {_CO} SELECT (SELECT count(*) FROM part) AS graph_order, count(*) AS size, false AS empty FROM co",
    "graph_neighbours": f"WITH {_CO}, i AS (SELECT dst AS node, count(*) AS n_in FROM co GROUP BY 1), o AS (SELECT src AS node, count(*) AS n_out FROM co GROUP BY 1) SELECT node, n_in, n_out, coalesce(n_in, 0) + coalesce(n_out, 0) AS n_all FROM i FULL JOIN o USING (node)",
    "graph_edge_ends": f"WITH {_RING} SELECT src, dst, a.x AS ax, b.z AS bz FROM ring JOIN pt a ON a.pid = src JOIN pt b ON b.pid = dst",
    "graph_neighbours_by_direction": f"WITH {_RING}, {_BOTH} SELECT node, neighbour FROM both_ WHERE dx > 1e-4 AND dy > 1e-4",
    "graph_neighbours_by_vector": f"WITH {_RING}, {_BOTH} SELECT node, neighbour FROM both_ WHERE dx / sqrt(dx * dx + dy * dy + dz * dz) >= cos(radians(50))",
    "graph_adjacency_map": f"WITH {_CO} SELECT src AS node, count(*)::INTEGER AS n, sum(weight)::BIGINT AS weight, max(dst) AS last FROM co GROUP BY src",
    "graph_adjacency_matrix": f"WITH {_REG}, b AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e) SELECT m.node, string_agg(coalesce(w, 0)::VARCHAR, ',' ORDER BY o.node) AS row FROM nodes m CROSS JOIN nodes o LEFT JOIN b ON b.src = m.node AND b.dst = o.node GROUP BY m.node",
    "graph_by_adjacency_matrix": f"WITH {_REG} SELECT dst AS src, src - {NATION} + 5 AS dst, w::BIGINT AS weight FROM e",
    "graph_vertex_index": "SELECT p_partkey * 3 AS vid, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part",
    "graph_mesh_data": f"WITH {_REG} SELECT (SELECT count(*)::INTEGER FROM nodes) AS n_vertices, count(*)::INTEGER AS n_edges, sum(src - {NATION} + 5)::BIGINT AS src, sum(dst)::BIGINT AS dst, (SELECT sum(node)::DOUBLE FROM nodes) AS x FROM e",
    "graph_json": f"WITH {_RING}, t AS (SELECT src, sum(dst)::BIGINT AS to_ FROM ring GROUP BY src) SELECT pid AS vid, x, coalesce(to_, 0) AS \"to\" FROM pt LEFT JOIN t ON src = pid",
    "graph_compare": f"WITH {_SL}, n AS (SELECT count(*) FILTER (p AND q) / count(*)::DOUBLE AS v FROM (SELECT node, bool_or(h = 0) AS p, bool_or(h = 1) AS q FROM (SELECT DISTINCT half AS h, src AS node FROM sl) GROUP BY node)), e AS (SELECT count(*) FILTER (p AND q) / count(*)::DOUBLE AS v FROM (SELECT u, w, bool_or(h = 0) AS p, bool_or(h = 1) AS q FROM (SELECT DISTINCT half AS h, least(src, dst) AS u, greatest(src, dst) AS w FROM sl) GROUP BY u, w)) SELECT round(n.v, 9) AS nodes, round(e.v, 9) AS edges, round((n.v + e.v) / 2, 9) AS similarity FROM n, e",
    "graph_depth_map": f"WITH {_TREE} SELECT depth, count(*) AS nodes FROM t GROUP BY depth",
    "graph_path_tree": f"WITH {_TREE} SELECT * FROM t",
}
