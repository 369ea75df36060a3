"""Graph measures, set operations, paths, triples and inference over driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvasir.operators import iterate, networks, triples
from kvasir.operators.model import undirected
from kvasir.sources import tables
from kvasir.sources.tables import CUSTOMER, NATION


def _parts(spark, d):
    return tables.table(spark, d, "part").select(F.col("p_partkey").alias("node"))


def _regional(spark, d):
    """The whole of the region and nation tables as nodes and pairs."""
    n, r = tables.table(spark, d, "nation"), tables.table(spark, d, "region")
    nation = (F.col("n_nationkey") + NATION).cast("long")
    nodes = r.select(F.col("r_regionkey").cast("long").alias("node")).union(n.select(nation))
    return nodes, n.select(nation.alias("src"), F.col("n_regionkey").cast("long").alias("dst"))


def _buyers(spark, d):
    """Customers, and pairs of customer and order."""
    o = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + tables.ORDER).alias("dst"))
    return tables.table(spark, d, "customer").select(F.col("c_custkey").alias("node")), o


def _slices(spark, d):
    """Customer-part edges of two halves of the orders' dates, weighted by quantity."""
    o = tables.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    j = tables.table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    e = j.groupBy((F.col("y") % 2).alias("half"), F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.sum("l_quantity").cast("long").alias("weight"))
    return e.filter("half = 0").drop("half"), e.filter("half = 1").drop("half")


def _setop(kind):
    def run(spark, d):
        a, b = _slices(spark, d)
        return networks.set_operation(a, b, kind)

    return run


_CO = "items AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), co AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS weight FROM items a JOIN items b USING (l_orderkey) WHERE a.l_partkey < b.l_partkey GROUP BY ALL)"
_DEG = "deg AS (SELECT p_partkey AS node, count(o) AS degree FROM part LEFT JOIN (SELECT src AS s, dst AS o FROM co UNION SELECT dst, src FROM co) ON s = p_partkey GROUP BY p_partkey)"
_SL = "sl AS (SELECT year(o_orderdate) % 2 AS half, o_custkey AS src, l_partkey AS dst, sum(l_quantity)::BIGINT AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), a AS (SELECT src, dst, weight FROM sl WHERE half = 0), b AS (SELECT src, dst, weight FROM sl WHERE half = 1)"

QUERIES = {
    "graph_degree": lambda s, d: networks.degrees(_parts(s, d), tables.copurchase(s, d)),
    "graph_degree_sequence": lambda s, d: networks.degree_sequence(_parts(s, d), tables.copurchase(s, d)),
    "graph_density": lambda s, d: networks.density(_parts(s, d), tables.copurchase(s, d)),
    "graph_isolated": lambda s, d: networks.isolated(*_buyers(s, d)),
    "graph_adjacency": lambda s, d: tables.copurchase(s, d),
    "graph_erdos_gallai": lambda s, d: networks.erdos_gallai(_parts(s, d), tables.copurchase(s, d)),
    **{f"graph_{k}": _setop(k) for k in ("union", "intersect", "difference", "symdiff", "impose", "imprint")},
    "graph_quotient": lambda s, d: networks.quotient(tables.copurchase(s, d), tables.table(s, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("grp"))),
    "graph_dual": lambda s, d: (lambda x: x.select("l_orderkey", F.col("l_suppkey").alias("a")).join(x.select("l_orderkey", F.col("l_suppkey").alias("b")), "l_orderkey").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("orders")))(
        tables.table(s, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()),
}
SQL = {
    "graph_degree": f"WITH {_CO}, {_DEG} SELECT node, degree FROM deg",
    "graph_degree_sequence": f"WITH {_CO}, {_DEG} SELECT degree, count(*) AS nodes FROM deg GROUP BY degree",
    "graph_density": f"WITH {_CO} SELECT (SELECT count(*) FROM part) AS n, count(*) AS m, round(2.0::DOUBLE * count(*) / ((SELECT count(*) FROM part) * ((SELECT count(*) FROM part) - 1)), 9) AS density FROM co",
    "graph_isolated": "SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "graph_adjacency": f"WITH {_CO} SELECT * FROM co",
    "graph_erdos_gallai": "SELECT true AS graphical",
    "graph_union": f"WITH {_SL} SELECT src, dst, coalesce(a.weight, b.weight) AS weight FROM a FULL JOIN b USING (src, dst)",
    "graph_intersect": f"WITH {_SL} SELECT src, dst, a.weight FROM a JOIN b USING (src, dst)",
    "graph_difference": f"WITH {_SL} SELECT * FROM a ANTI JOIN b USING (src, dst)",
    "graph_symdiff": f"WITH {_SL} SELECT src, dst, coalesce(a.weight, b.weight) AS weight FROM a FULL JOIN b USING (src, dst) WHERE a.weight IS NULL OR b.weight IS NULL",
    "graph_impose": f"WITH {_SL} SELECT src, dst, coalesce(b.weight, a.weight) AS weight FROM a FULL JOIN b USING (src, dst)",
    "graph_imprint": f"WITH {_SL} SELECT src, dst, coalesce(b.weight, a.weight) AS weight FROM a LEFT JOIN b USING (src, dst)",
    "graph_quotient": f"WITH {_CO} SELECT least(x.p_brand, y.p_brand) AS a, greatest(x.p_brand, y.p_brand) AS b, count(*) AS edges FROM co JOIN part x ON x.p_partkey = src JOIN part y ON y.p_partkey = dst WHERE x.p_brand <> y.p_brand GROUP BY ALL",
    "graph_dual": "WITH x AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS orders FROM x a JOIN x b USING (l_orderkey) WHERE a.l_suppkey < b.l_suppkey GROUP BY ALL",
}


def _tree(spark, d):
    g = tables.geography(spark, d)
    return g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _region(spark, d):
    return tables.table(spark, d, "region").filter("r_name = 'EUROPE'").select(F.col("r_regionkey").cast("long").alias("node"))


def _both_ways(spark, d):
    g = tables.geography(spark, d)
    return g.edges.select("src", "dst").union(g.edges.select("dst", "src"))


def _one_customer(spark, d):
    return spark.range(1).select(F.lit(CUSTOMER + 1).cast("long").alias("node"))


_NAT = f"{NATION}"
QUERIES |= {
    "graph_bfs": lambda s, d: iterate.bfs(_tree(s, d), _region(s, d)).select("node", F.col("depth").cast("int").alias("depth")),
    "graph_khop": lambda s, d: iterate.bfs(_both_ways(s, d), _one_customer(s, d), 2).filter("depth > 0").select("node", F.col("depth").cast("int").alias("depth")),
    "graph_components": lambda s, d: iterate.components(*(lambda g: (g.vertices.select(F.col("vid").alias("node")), g.edges.select("src", "dst")))(tables.geography(s, d))),
    "graph_shortest_path": lambda s, d: iterate.bfs(_both_ways(s, d), _one_customer(s, d)).filter(f"node BETWEEN {NATION} AND {NATION + 24}").select("node", F.col("depth").cast("int").alias("distance")),
    "graph_all_paths": lambda s, d: networks.all_paths(undirected(_regional(s, d)[1]), NATION, NATION + 5, 4).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), F.col("length").cast("int").alias("length")),
    "graph_bipartite": lambda s, d: networks.is_bipartite(*(lambda g: (g.vertices.select(F.col("vid").alias("node")), g.edges.select("src", "dst")))(tables.geography(s, d))),
    "graph_closeness": lambda s, d: networks.closeness(*_regional(s, d)),
    "graph_betweenness": lambda s, d: networks.betweenness(*_regional(s, d)),
    "graph_mst": lambda s, d: iterate.spanning_forest(tables.copurchase(s, d)).agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight")),
    "graph_diameter": lambda s, d: networks.diameter(*_regional(s, d)),
}
SQL |= {
    "graph_bfs": f"""
SELECT r_regionkey::BIGINT AS node, 0 AS depth FROM region WHERE r_name = 'EUROPE'
UNION ALL SELECT n_nationkey + {NATION}, 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'
UNION ALL SELECT c_custkey + {CUSTOMER}, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'
UNION ALL SELECT s_suppkey + {1 << 33}, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'""",
    "graph_khop": f"""
WITH c AS (SELECT c_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1)
SELECT (n + {NATION})::BIGINT AS node, 1 AS depth FROM c
UNION ALL SELECT r::BIGINT, 2 FROM c
UNION ALL SELECT c_custkey + {CUSTOMER}, 2 FROM customer JOIN c ON c_nationkey = n WHERE c_custkey <> 1
UNION ALL SELECT s_suppkey + {1 << 33}, 2 FROM supplier JOIN c ON s_nationkey = n""",
    "graph_components": f"""
WITH r AS (SELECT n_nationkey, n_regionkey FROM nation)
SELECT r_regionkey::BIGINT AS node, r_regionkey::BIGINT AS component FROM region
UNION ALL SELECT n_nationkey + {NATION}, n_regionkey FROM nation
UNION ALL SELECT c_custkey + {CUSTOMER}, n_regionkey FROM customer JOIN r ON c_nationkey = n_nationkey
UNION ALL SELECT s_suppkey + {1 << 33}, n_regionkey FROM supplier JOIN r ON s_nationkey = n_nationkey""",
    "graph_shortest_path": f"""
WITH c AS (SELECT c_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1)
SELECT (n_nationkey + {NATION})::BIGINT AS node, CASE WHEN n_nationkey = n THEN 1 ELSE 3 END AS distance FROM nation JOIN c ON n_regionkey = r""",
    "graph_all_paths": f"""
SELECT concat(x.n_nationkey + {NATION}, '>', x.n_regionkey, '>', y.n_nationkey + {NATION}) AS path, 2 AS length
FROM nation x JOIN nation y USING (n_regionkey) WHERE x.n_nationkey = 0 AND y.n_nationkey = 5""",
    "graph_bipartite": "SELECT true AS bipartite",
    "graph_closeness": f"""
WITH k AS (SELECT n_regionkey AS r, count(*)::DOUBLE AS m FROM nation GROUP BY 1), t AS (SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) - 1 AS n)
SELECT r_regionkey::BIGINT AS node, coalesce(round(m / n, 9), 0) AS closeness FROM region LEFT JOIN k ON r = r_regionkey, t
UNION ALL SELECT n_nationkey + {NATION}, round(m / (2 * m - 1) * m / n, 9) FROM nation JOIN k ON r = n_regionkey, t""",
    "graph_betweenness": f"""
WITH k AS (SELECT n_regionkey AS r, count(*)::DOUBLE AS m FROM nation GROUP BY 1)
SELECT r_regionkey::BIGINT AS node, coalesce(m * (m - 1) / 2, 0) AS betweenness FROM region LEFT JOIN k ON r = r_regionkey
UNION ALL SELECT n_nationkey + {NATION}, 0.0 FROM nation""",
    "graph_diameter": "SELECT 2 AS diameter",
}


def _geo_triples(spark, d):
    """Customers typed by their nation, nations under regions, regions under World."""
    t = lambda n: tables.table(spark, d, n)
    row = lambda s, p, o: [s.alias("s"), F.lit(p).alias("p"), o.alias("o")]
    n, r = t("nation"), t("region")
    nations = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    typed = t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return (
        nations.select(*row(F.concat(F.lit("n:"), "n_name"), triples.SUBCLASS, F.concat(F.lit("r:"), "r_name")))
        .unionByName(r.select(*row(F.concat(F.lit("r:"), "r_name"), triples.SUBCLASS, F.lit("top:World"))))
        .unionByName(typed.select(*row(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")), triples.TYPE, F.concat(F.lit("n:"), "n_name"))))
        .unionByName(typed.select(*row(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")), "top:segment", F.concat(F.lit('"'), "c_mktsegment", F.lit('"')))))
    )


_T = """t AS (
  SELECT DISTINCT 'n:' || n_name AS s, 'rdfs:subClassOf' AS p, 'r:' || r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT 'r:' || r_name, 'rdfs:subClassOf', 'top:World' FROM region
  UNION SELECT 'c:' || c_custkey, 'rdf:type', 'n:' || n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT 'c:' || c_custkey, 'top:segment', '"' || c_mktsegment || '"' FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_CLOSED = f"""{_T},
sub AS (SELECT s, o FROM t WHERE p = 'rdfs:subClassOf' UNION SELECT x.s, y.o FROM t x JOIN t y ON x.o = y.s AND x.p = y.p WHERE x.p = 'rdfs:subClassOf'),
closed AS (SELECT * FROM t UNION SELECT s, 'rdfs:subClassOf', o FROM sub UNION SELECT t.s, 'rdf:type', sub.o FROM t JOIN sub ON t.o = sub.s WHERE t.p = 'rdf:type')"""

QUERIES |= {
    "kg_pattern": lambda s, d: triples.pattern(_geo_triples(s, d), p=triples.SUBCLASS),
    "kg_merge": lambda s, d: triples.summary(triples.merge(_geo_triples(s, d), _geo_triples(s, d).filter("p = 'rdf:type'"))),
    "kg_difference": lambda s, d: triples.difference(_geo_triples(s, d), _geo_triples(s, d).filter(f"p != '{triples.SUBCLASS}'")),
    "kg_diff": lambda s, d: triples.diff(_geo_triples(s, d).filter("s != 'c:1'"), _geo_triples(s, d).filter("o != 'top:World'")),
    "kg_summary": lambda s, d: triples.summary(_geo_triples(s, d)),
    "kg_bgp_join": lambda s, d: triples.bgp(_geo_triples(s, d), [("?c", triples.TYPE, "?n"), ("?n", triples.SUBCLASS, "r:ASIA"), ("?c", "top:segment", '"BUILDING"')]),
    "kg_bgp_optional": lambda s, d: triples.bgp(_geo_triples(s, d), [("?n", triples.SUBCLASS, "r:ASIA")], [("?c", triples.TYPE, "?n")]),
    "kg_ask": lambda s, d: triples.ask(_geo_triples(s, d), [("?c", triples.TYPE, "n:FRANCE")]),
    "rdfs_closure": lambda s, d: triples.rdfs_closure(_geo_triples(s, d)),
    "rdfs_types": lambda s, d: triples.rdfs_closure(_geo_triples(s, d)).filter("p = 'rdf:type'").groupBy(F.col("o").alias("class")).agg(F.count(F.lit(1)).alias("members")),
    "rdfs_proof": lambda s, d: triples.superclass_path(_geo_triples(s, d), "n:FRANCE", "top:World").select("path", F.col("length").cast("int").alias("length")),
    "ontology_validate": lambda s, d: (lambda t: t.filter("p = 'rdf:type'").join(t.filter(f"p = '{triples.SUBCLASS}'").select(F.col("s").alias("o")), "o", "left_anti").agg(F.count(F.lit(1)).alias("unknown_classes")))(_geo_triples(s, d)),
}
SQL |= {
    "kg_pattern": f"WITH {_T} SELECT * FROM t WHERE p = 'rdfs:subClassOf'",
    "kg_merge": f"WITH {_T} SELECT p, count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM t GROUP BY p",
    "kg_difference": f"WITH {_T} SELECT * FROM t WHERE p = 'rdfs:subClassOf'",
    "kg_diff": f"""WITH {_T}, b AS (SELECT * FROM t WHERE s <> 'c:1'), a AS (SELECT * FROM t WHERE o <> 'top:World')
SELECT 'added' AS change, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) HAVING count(*) > 0
UNION ALL SELECT 'removed', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) HAVING count(*) > 0
UNION ALL SELECT 'unchanged', count(*) FROM (SELECT * FROM b INTERSECT SELECT * FROM a) HAVING count(*) > 0""",
    "kg_summary": f"WITH {_T} SELECT p, count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM t GROUP BY p",
    "kg_bgp_join": f"WITH {_T} SELECT x.s AS c, x.o AS n FROM t x JOIN t y ON y.s = x.o JOIN t z ON z.s = x.s WHERE x.p = 'rdf:type' AND y.p = 'rdfs:subClassOf' AND y.o = 'r:ASIA' AND z.p = 'top:segment' AND z.o = '\"BUILDING\"'",
    "kg_bgp_optional": f"WITH {_T} SELECT y.s AS n, x.s AS c FROM t y LEFT JOIN (SELECT * FROM t WHERE p = 'rdf:type') x ON x.o = y.s WHERE y.p = 'rdfs:subClassOf' AND y.o = 'r:ASIA'",
    "kg_ask": f"WITH {_T} SELECT count(*) > 0 AS answer FROM t WHERE p = 'rdf:type' AND o = 'n:FRANCE'",
    "rdfs_closure": f"WITH {_CLOSED} SELECT * FROM closed",
    "rdfs_types": f"WITH {_CLOSED} SELECT o AS class, count(*) AS members FROM closed WHERE p = 'rdf:type' GROUP BY o",
    "rdfs_proof": "SELECT 'n:' || n_name || ' > r:' || r_name || ' > top:World' AS path, 2 AS length FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name = 'FRANCE'",
    "ontology_validate": "SELECT count(*) AS unknown_classes FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)",
}
