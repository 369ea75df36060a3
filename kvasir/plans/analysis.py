"""Map, list, vector, spatial, topology, dataset and building-model queries over driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kvasir.functions import lists, vectors
from kvasir.functions.shipping import ship
from kvasir.operators import datasets, maps, spatial, topology
from kvasir.operators.model import text_map
from kvasir.sources import ifc, tables


def _event_maps(spark, d, pairs: bool = True):
    """Every event's map beside its user's next event's: ``user_id, a, b``; without ``pairs`` also the last ones, ``b`` null."""
    w = W.partitionBy("user_id").orderBy("event_id")
    e = tables.table(spark, d, "events").select("user_id", "event_id", "event_type", F.dayofmonth("ts").alias("day"))
    e = e.withColumn("after", F.lead(F.struct("event_id", "event_type", "day")).over(w))
    a = text_map(event_type=F.col("event_type"), day=F.col("day"), first=F.col("event_id"))
    b = F.when(F.col("after").isNotNull(), text_map(event_type=F.col("after.event_type"), day=F.col("after.day"), second=F.col("after.event_id")))
    return (e.filter("after IS NOT NULL") if pairs else e).select("user_id", a.alias("a"), b.alias("b"))


def _each(spark, d):
    return _event_maps(spark, d, pairs=False)


def _map(expression):
    return lambda spark, d: _event_maps(spark, d).select("user_id", maps.canonical(expression(F.col("a"), F.col("b"))).alias("m"))


_EV = """ev AS (SELECT user_id, event_id, event_type AS t, day(ts)::VARCHAR AS dd, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
p AS (SELECT a.user_id, a.t AS ta, b.t AS tb, a.dd AS da, b.dd AS db, a.event_id::VARCHAR AS ia, b.event_id::VARCHAR AS ib FROM ev a JOIN ev b ON b.user_id = a.user_id AND b.r = a.r + 1)"""
_E1 = "p AS (SELECT user_id, event_type AS ta, day(ts)::VARCHAR AS da, event_id::VARCHAR AS ia FROM events)"
_BOTH = "CASE WHEN {a} = {b} THEN {a} ELSE '[\"' || {a} || '\",\"' || {b} || '\"]' END"
_D, _TY = _BOTH.format(a="da", b="db"), _BOTH.format(a="ta", b="tb")

QUERIES = {
    "map_union": _map(maps.union),
    "map_difference": _map(maps.difference),
    "map_intersect": _map(maps.intersection),
    "map_xor": _map(maps.symmetric_difference),
    "map_impose": _map(maps.impose),
    "map_imprint": _map(maps.imprint),
    "map_remove_key": lambda s, d: _each(s, d).select("user_id", maps.canonical(maps.remove_key(F.col("a"), "DAY")).alias("m")),
    "map_get": lambda s, d: _each(s, d).select("user_id", maps.get(F.col("a"), "second", "none").alias("v")),
    "map_filter": lambda s, d: _each(s, d).filter(maps.matches(F.col("a"), "event_type", "starts with", "P")).select("user_id"),
    "map_one_hot": lambda s, d: _each(s, d).select("user_id", maps.canonical(maps.one_hot(F.col("a"), "event_type", ["click", "purchase"])).alias("m")),
    "map_cluster_by_keys": lambda s, d: _each(s, d).groupBy(maps.cluster_key(F.col("a"), ["event_type", "absent"]).alias("cluster")).agg(F.count(F.lit(1)).alias("n")),
}
SQL = {
    "map_union": f"WITH {_EV} SELECT user_id, 'day=' || {_D} || ';event_type=' || {_TY} || ';first=' || ia || ';second=' || ib AS m FROM p",
    "map_difference": f"WITH {_EV} SELECT user_id, 'first=' || ia AS m FROM p",
    "map_intersect": f"WITH {_EV} SELECT user_id, 'day=' || {_D} || ';event_type=' || {_TY} AS m FROM p",
    "map_xor": f"WITH {_EV} SELECT user_id, 'first=' || ia || ';second=' || ib AS m FROM p",
    "map_impose": f"WITH {_EV} SELECT user_id, 'day=' || db || ';event_type=' || tb || ';first=' || ia || ';second=' || ib AS m FROM p",
    "map_imprint": f"WITH {_EV} SELECT user_id, 'day=' || db || ';event_type=' || tb || ';first=' || ia AS m FROM p",
    "map_remove_key": f"WITH {_E1} SELECT user_id, 'event_type=' || ta || ';first=' || ia AS m FROM p",
    "map_get": f"WITH {_E1} SELECT user_id, 'none' AS v FROM p",
    "map_filter": f"WITH {_E1} SELECT user_id FROM p WHERE starts_with(lower(ta), 'p')",
    "map_one_hot": f"WITH {_E1} SELECT user_id, 'day=' || da || ';event_type_0=' || (ta = 'click')::INT || ';event_type_1=' || (ta = 'purchase')::INT || ';first=' || ia AS m FROM p",
    "map_cluster_by_keys": f"WITH {_E1} SELECT '[\"' || ta || '\"]' AS cluster, count(*) AS n FROM p GROUP BY 1",
}

_price = lambda s, d: tables.table(s, d, "part")
QUERIES |= {
    "list_bin_average": lambda s, d: lists.bin_average(_price(s, d), "p_brand", "p_retailprice", 2.0).withColumn("bin", F.col("bin").cast("long")),
    "list_merge_threshold": lambda s, d: _price(s, d).groupBy("p_brand").agg(F.collect_list(F.col("p_size").cast("double")).alias("v")).select("p_brand", F.size(lists.merge_by_threshold(F.col("v"), 0.5)).cast("long").alias("kept")),
    "list_normalize": lambda s, d: (lambda p: p.join(p.groupBy("p_brand").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi")), "p_brand").select("p_partkey", F.round(lists.normalize(F.col("p_size"), F.col("lo"), F.col("hi")), 6).alias("v")))(_price(s, d)),
    "list_make_unique": lambda s, d: lists.make_unique(_price(s, d).select("p_partkey", "p_type"), "p_type", "p_partkey"),
    "list_trim_repeat": lambda s, d: _price(s, d).select("p_partkey", F.array_join(lists.repeat_to(lists.trim(F.split("p_name", " "), 2), 5), "|").alias("v")),
    "list_closest": lambda s, d: _price(s, d).select("p_partkey", lists.closest_index(F.array(*[F.lit(float(x)) for x in (5, 15, 25, 35, 45)]), F.col("p_size")).cast("int").alias("i")),
}
SQL |= {
    "list_bin_average": "WITH s AS (SELECT p_brand, p_retailprice AS x, CASE WHEN lag(p_retailprice) OVER w IS NULL OR p_retailprice - lag(p_retailprice) OVER w > 2.0 THEN 1 ELSE 0 END AS f FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice)), b AS (SELECT p_brand, x, sum(f) OVER (PARTITION BY p_brand ORDER BY x ROWS UNBOUNDED PRECEDING)::BIGINT AS bin FROM s) SELECT p_brand, bin, round(avg(x), 6) AS average FROM b GROUP BY p_brand, bin",
    "list_merge_threshold": "SELECT p_brand, count(DISTINCT p_size) AS kept FROM part GROUP BY p_brand",
    "list_normalize": "SELECT p_partkey, round(CASE WHEN max(p_size) OVER w > min(p_size) OVER w THEN (p_size - min(p_size) OVER w)::DOUBLE / (max(p_size) OVER w - min(p_size) OVER w) ELSE 0.0 END, 6) AS v FROM part WINDOW w AS (PARTITION BY p_brand)",
    "list_make_unique": "WITH r AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS n FROM part) SELECT p_partkey, p_type, CASE WHEN n = 0 THEN p_type ELSE p_type || '_' || n END AS unique_name FROM r",
    "list_trim_repeat": "WITH w AS (SELECT p_partkey, string_split(p_name, ' ')[1:2] AS t FROM part) SELECT p_partkey, array_to_string([t[i % len(t) + 1] FOR i IN range(5)], '|') AS v FROM w",
    "list_closest": "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 20 THEN 1 WHEN p_size <= 30 THEN 2 WHEN p_size <= 40 THEN 3 ELSE 4 END::INTEGER AS i FROM part",
}


def _vec(spark, d):
    p = tables.points(spark, d)
    q = p.select((F.col("pid") - 1).alias("pid"), F.array("x", "y", "z").alias("v"))
    return p.select("pid", F.array("x", "y", "z").alias("u")).join(q, "pid")


_PT = "pt AS (SELECT vec_id AS pid, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y, round(embedding[3]::DOUBLE, 6) AS z FROM embeddings)"
_UV = f"{_PT}, uv AS (SELECT a.pid, a.x, a.y, a.z, b.x AS bx, b.y AS by_, b.z AS bz FROM pt a JOIN pt b ON b.pid = a.pid + 1)"
_turn = lambda: F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in ((0, -1, 0, 1), (1, 0, 0, 2), (0, 0, 1, 3), (0, 0, 0, 1))])
QUERIES |= {
    "vec_dot_cross_angle": lambda s, d: _vec(s, d).select("pid", F.round(vectors.dot(F.col("u"), F.col("v")), 6).alias("dot"), F.round(F.element_at(vectors.cross(F.col("u"), F.col("v")), 1), 6).alias("cross_x"), F.round(vectors.angle(F.col("u"), F.col("v")), 4).alias("angle")),
    "vec_normalize": lambda s, d: _vec(s, d).select("pid", F.round(F.element_at(vectors.normalize(F.col("u")), 1), 6).alias("nx"), F.round(vectors.magnitude(F.col("u")), 6).alias("m")),
    "vec_compass": lambda s, d: _vec(s, d).select("pid", F.round(vectors.compass_angle(F.col("u")), 4).alias("angle")),
    "mat_transform": lambda s, d: (lambda t: t.select("pid", *[F.round(F.element_at("t", i + 1), 6).alias(c) for i, c in enumerate("xyz")]))(_vec(s, d).select("pid", vectors.transform_point(_turn(), F.col("u")).alias("t"))),
    "mat_multiply": lambda s, d: s.range(1).select(vectors.matrix_multiply(_turn(), vectors.transpose(_turn())).alias("m")).select(F.posexplode("m").alias("i", "r")).select(F.col("i").cast("int").alias("i"), F.array_join(F.transform("r", lambda x: x.cast("int").cast("string")), ",").alias("r")),
}
SQL |= {
    "vec_dot_cross_angle": f"WITH {_UV} SELECT pid, round(x * bx + y * by_ + z * bz, 6) AS dot, round(y * bz - z * by_, 6) AS cross_x, round(degrees(acos(greatest(-1.0, least(1.0, (x * bx + y * by_ + z * bz) / (sqrt(x * x + y * y + z * z) * sqrt(bx * bx + by_ * by_ + bz * bz)))))), 4) AS angle FROM uv",
    "vec_normalize": f"WITH {_UV} SELECT pid, round(x / sqrt(x * x + y * y + z * z), 6) AS nx, round(sqrt(x * x + y * y + z * z), 6) AS m FROM uv",
    "vec_compass": f"WITH {_UV} SELECT pid, round(CASE WHEN degrees(atan2(x, y)) < 0 THEN degrees(atan2(x, y)) + 360 ELSE degrees(atan2(x, y)) END, 4) AS angle FROM uv",
    "mat_transform": f"WITH {_UV} SELECT pid, round(1 - y, 6) AS x, round(x + 2, 6) AS y, round(z + 3, 6) AS z FROM uv",
    "mat_multiply": "SELECT * FROM (VALUES (0, '2,2,3,1'), (1, '2,5,6,2'), (2, '3,6,10,3'), (3, '1,2,3,1')) t(i, r)",
}


def _boxes(spark, d, half: float = 0.02):
    """A cube around each point; coordinates rounded to six places."""
    p = tables.points(spark, d)
    return p.select(F.col("pid").alias("bid"), *[F.round(F.col(a) + k * half, 6).alias(f"{a}{(k + 1) // 2}") for a in "xyz" for k in (-1, 1)])


def _queries(spark, d):
    return tables.points(spark, d).filter("pid % 20 = 0").select(F.col("pid").alias("qid"), "x", "y", "z")


_BX = f"{_PT}, bx AS (SELECT pid AS bid, " + ", ".join(f"round({a} - 0.02, 6) AS {a}0, round({a} + 0.02, 6) AS {a}1" for a in "xyz") + " FROM pt)"
_D2 = "(q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)"
_NN = f"{_PT}, nn AS (SELECT q.pid AS qid, p.pid, {_D2} AS d2, row_number() OVER (PARTITION BY q.pid ORDER BY {_D2}, p.pid) AS rank FROM pt q, pt p WHERE q.pid % 20 = 0)"
QUERIES |= {
    "sp_aabb_clash": lambda s, d: spatial.box_pairs(_boxes(s, d), 0.05),
    "sp_knn": lambda s, d: spatial.nearest(tables.points(s, d), _queries(s, d), 5, 0.05).select("qid", "pid", F.round("d2", 9).alias("d2"), F.col("rank").cast("int").alias("rank")),
    "sp_idw": lambda s, d: spatial.interpolate(tables.points(s, d).withColumn("value", F.col("pid") * 1.0).filter("pid % 20 != 0"), _queries(s, d), 4, 0.05),
    "sp_raycast": lambda s, d: spatial.ray_hits(_boxes(s, d), (-1.0, -1.0, -1.0), (1.0, 1.0, 1.0)),
    "sp_near_pairs": lambda s, d: spatial.near_pairs(tables.points(s, d), 0.04).filter("a < b").select("a", "b"),
    "cl_dbscan": lambda s, d: spatial.dbscan(tables.points(s, d), 0.06, 4),
    "cl_kmeans_objective": lambda s, d: spatial.kmeans(tables.points(s, d), 4)[0].groupBy("cluster").agg(F.count(F.lit(1)).alias("n")),
    "cl_fuse": lambda s, d: spatial.fuse(tables.points(s, d), 0.04),
}
SQL |= {
    "sp_aabb_clash": f"WITH {_BX} SELECT l.bid AS a, r.bid AS b FROM bx l JOIN bx r ON l.bid < r.bid AND " + " AND ".join(f"l.{a}0 <= r.{a}1 AND r.{a}0 <= l.{a}1" for a in "xyz"),
    "sp_knn": f"WITH {_NN} SELECT qid, pid, round(d2, 9) AS d2, rank::INTEGER AS rank FROM nn WHERE rank <= 5",
    "sp_idw": f"WITH {_PT}, nn AS (SELECT q.pid AS qid, p.pid::DOUBLE AS value, sqrt({_D2}) AS d, row_number() OVER (PARTITION BY q.pid ORDER BY {_D2}, p.pid) AS rank FROM pt q, pt p WHERE q.pid % 20 = 0 AND p.pid % 20 <> 0) SELECT qid, round(CASE WHEN min(d) <= 0.0001 THEN arg_min(value, d) ELSE sum(value / d) / sum(1 / d) END, 6) AS value FROM nn WHERE rank <= 4 GROUP BY qid",
    "sp_raycast": f"WITH {_BX}, t AS (SELECT bid, greatest(0, x0 + 1, y0 + 1, z0 + 1) AS n, least(x1 + 1, y1 + 1, z1 + 1) AS f FROM bx) SELECT bid, round(n, 6) AS t FROM t WHERE n <= f",
    "sp_near_pairs": f"WITH {_PT} SELECT p.pid AS a, q.pid AS b FROM pt p JOIN pt q ON p.pid < q.pid AND {_D2} < 0.04::DOUBLE * 0.04::DOUBLE",
}


def _solids(spark, d):
    """A box for each part: its size, the price and the key's last digit as sides, in a row of touching pairs."""
    p = tables.table(spark, d, "part")
    w, h, l = F.col("p_size").cast("double"), F.round("p_retailprice", 2), F.col("p_partkey") % 10 + 1.0
    zero = F.lit(0.0)
    return p.select(F.col("p_partkey").alias("bid"), zero.alias("x0"), w.alias("x1"), zero.alias("y0"), h.alias("y1"), zero.alias("z0"), l.alias("z1"))


def _chain(spark, d):
    """Cells in a row: cell i has face i and i + 1 between neighbours, and four of its own."""
    p = tables.table(spark, d, "part").select(F.col("p_partkey").alias("cid"))
    own = [F.col("cid") * 4 + (1 << 40) + k for k in range(4)]
    return p.select("cid", F.explode(F.array(F.col("cid"), F.col("cid") + 1, *own)).alias("fid"))


QUERIES |= {
    "topo_area": lambda s, d: (lambda v, f, c: topology.meet(topology.face_areas(v, f), c, "fid").groupBy("cid").agg(F.round(F.sum("area"), 2).alias("area")))(*topology.boxes_as_cells(_solids(s, d))),
    "topo_volume": lambda s, d: topology.cell_volumes(*topology.boxes_as_cells(_solids(s, d))).withColumn("volume", F.round("volume", 2)),
    "topo_length": lambda s, d: topology.edge_lengths(topology.boxes_as_cells(_solids(s, d))[0], _solids(s, d).select((F.col("bid") * 8).alias("eid"), (F.col("bid") * 8).alias("a"), (F.col("bid") * 8 + 7).alias("b"))).withColumn("length", F.round("length", 4)),
    "topo_boundary": lambda s, d: topology.boundary_faces(_chain(s, d)).agg(F.count(F.lit(1)).alias("faces")),
    "topo_shared": lambda s, d: topology.shared_faces(_chain(s, d)),
}
SQL |= {
    "topo_area": "SELECT p_partkey AS cid, round(2 * (p_size * round(p_retailprice, 2) + (p_partkey % 10 + 1) * round(p_retailprice, 2) + p_size * (p_partkey % 10 + 1.0::DOUBLE)), 2) AS area FROM part",
    "topo_volume": "SELECT p_partkey AS cid, round(p_size * round(p_retailprice, 2) * (p_partkey % 10 + 1), 2) AS volume FROM part",
    "topo_length": "SELECT p_partkey * 8 AS eid, round(round(sqrt(p_size * p_size::DOUBLE + round(p_retailprice, 2) * round(p_retailprice, 2) + (p_partkey % 10 + 1) * (p_partkey % 10 + 1.0::DOUBLE)), 6), 4) AS length FROM part",
    "topo_boundary": "WITH f AS (SELECT p_partkey AS fid FROM part UNION ALL SELECT p_partkey + 1 FROM part) SELECT (4 * (SELECT count(*) FROM part) + (SELECT count(*) FROM (SELECT fid FROM f GROUP BY fid HAVING count(*) = 1)))::BIGINT AS faces",
    "topo_shared": "SELECT a.p_partkey AS a, b.p_partkey AS b, b.p_partkey AS fid FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1",
}


def _scored(spark, d):
    """Documents' labels beside a guess from their length."""
    l, t = tables.table(spark, d, "labels"), tables.table(spark, d, "documents").select("doc_id", "n_chars")
    return l.join(t, "doc_id").select("doc_id", "quality", F.when(F.col("n_chars") > 400, 1).otherwise(0).alias("guess"))


_SC = "sc AS (SELECT quality AS a, CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS g FROM labels JOIN documents USING (doc_id))"
QUERIES |= {
    "ml_confusion": lambda s, d: datasets.confusion(_scored(s, d), "quality", "guess"),
    "ml_metrics": lambda s, d: datasets.classification_metrics(_scored(s, d), "quality", "guess"),
    "ml_regression": lambda s, d: datasets.regression_metrics(tables.table(s, d, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1500).alias("guess")), "l_extendedprice", "guess").select(F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"), "r2"),
    "ml_stratified_fold_sizes": lambda s, d: datasets.stratified_folds(tables.table(s, d, "labels"), "doc_id", "quality", 5).groupBy("quality", "fold").agg(F.count(F.lit(1)).alias("n")),
    "ml_pareto": lambda s, d: datasets.pareto_front(tables.table(s, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", ["p_size", "p_retailprice"]),
    "ml_split_sizes": lambda s, d: datasets.split(tables.table(s, d, "documents"), "doc_id", (0.8, 0.1, 0.1)).groupBy("part").agg(F.count(F.lit(1)).alias("n")),
    "ml_feature_cells": lambda s, d: tables.table(s, d, "part").select("p_partkey", datasets.resized(datasets.feature_cell(F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit(", 2]"))), 3).alias("f")).select("p_partkey", F.element_at("f", 1).alias("f1"), F.element_at("f", 3).alias("f3")),
}
SQL |= {
    "ml_confusion": f"WITH {_SC} SELECT a AS actual, g AS predicted, count(*) AS n FROM sc GROUP BY ALL",
    "ml_metrics": f"""WITH {_SC}, k AS (SELECT c, (SELECT count(*) FROM sc WHERE a = c)::DOUBLE AS t, (SELECT count(*) FROM sc WHERE g = c) AS p, (SELECT count(*) FROM sc WHERE a = c AND g = c)::DOUBLE AS h FROM (SELECT DISTINCT a AS c FROM sc)),
m AS (SELECT t, h, CASE WHEN p > 0 THEN h / p ELSE 0 END AS pr, h / t AS re FROM k)
SELECT round(sum(h) / sum(t), 9) AS accuracy, round(sum(pr * t) / sum(t), 9) AS precision, round(sum(re * t) / sum(t), 9) AS recall, round(sum(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END * t) / sum(t), 9) AS f1 FROM m""",
    "ml_regression": "WITH r AS (SELECT l_extendedprice AS a, l_extendedprice - l_quantity * 1500 AS e FROM lineitem) SELECT round(avg(abs(e)), 3) AS mae, round(sqrt(avg(e * e)), 3) AS rmse, round(1 - avg(e * e) / var_pop(a), 6) AS r2 FROM r",
    "ml_stratified_fold_sizes": "WITH f AS (SELECT quality, ((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5)::INTEGER AS fold FROM labels) SELECT quality, fold, count(*) AS n FROM f GROUP BY ALL",
    "ml_pareto": "SELECT a.p_partkey, a.p_size, a.p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice >= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice > a.p_retailprice))",
    "ml_feature_cells": "SELECT p_partkey, p_size::DOUBLE AS f1, 0.0::DOUBLE AS f3 FROM part",
}


def _model(spark, d):
    """Building records made of the tables: a space for each nation, a door for each supplier, one boundary for its nation and one for the next."""
    ship(spark)
    n, s = tables.table(spark, d, "nation"), tables.table(spark, d, "supplier")
    lines = n.select(F.format_string("#%d=IFCSPACE('g%d',$,'%s',$)", F.col("n_nationkey") + 1, F.col("n_nationkey"), F.col("n_name")).alias("value"))
    door, nation = F.col("s_suppkey") + 1000, F.col("s_nationkey")
    lines = lines.union(s.select(F.format_string("#%d=IFCDOOR('d%d',$,'Door (%d)',$)", door, door, door)))
    for k in (0, 1):
        lines = lines.union(s.select(F.format_string("#%d=IFCRELSPACEBOUNDARY('b%d',$,$,$,#%d,#%d,$,.PHYSICAL.,.INTERNAL.)", door * 2 + 1_000_000 + k, door, (nation + k) % 25 + 1, door)))
    return ifc.entities(lines.union(n.limit(1).select(F.lit("not a record"))))


QUERIES |= {
    "ifc_triples": lambda s, d: ifc.triples(_model(s, d)).groupBy("p").agg(F.count(F.lit(1)).alias("n")),
    "ifc_access": lambda s, d: ifc.access_graph(_model(s, d)),
    "ifc_cardinality": lambda s, d: ifc.connector_report(_model(s, d)),
}
SQL |= {
    "ifc_triples": "SELECT 'rdf:type' AS p, (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'rdfs:label', (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'bot:adjacentElement', 2 * (SELECT count(*) FROM supplier)",
    "ifc_access": "SELECT least(s_nationkey, (s_nationkey + 1) % 25)::BIGINT + 1 AS a, greatest(s_nationkey, (s_nationkey + 1) % 25)::BIGINT + 1 AS b, s_suppkey + 1000 AS via FROM supplier",
    "ifc_cardinality": "SELECT s_suppkey + 1000 AS via, 2::BIGINT AS spaces, 'normal' AS verdict FROM supplier",
}
