"""The pattern language and stored-graph queries over the geography graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvasir.operators import corpus, pattern
from kvasir.sources import tables
from kvasir.sources.tables import CUSTOMER, NATION, SUPPLIER


def _read(text: str):
    return lambda spark, d: pattern.query(tables.geography(spark, d), text)


#: The geography graph in SQL.
V = f"""
v AS (
  SELECT r_regionkey::BIGINT AS vid, 'Region' AS label, NULL::VARCHAR AS cls, r_name AS name, NULL::DOUBLE AS acctbal, NULL::VARCHAR AS segment FROM region
  UNION ALL SELECT n_nationkey + {NATION}, 'Nation', NULL, n_name, NULL, NULL FROM nation
  UNION ALL SELECT s_suppkey + {SUPPLIER}, 'Supplier', 'bot:Party', s_name, s_acctbal, NULL FROM supplier
  UNION ALL SELECT c_custkey + {CUSTOMER}, 'Customer', 'bot:Party', c_name, c_acctbal, c_mktsegment FROM customer),
e AS (
  SELECT n_nationkey::BIGINT + {NATION} AS eid, n_nationkey::BIGINT + {NATION} AS src, n_regionkey::BIGINT AS dst, 'IN_REGION' AS label FROM nation
  UNION ALL SELECT s_suppkey + {SUPPLIER}, s_suppkey + {SUPPLIER}, s_nationkey + {NATION}, 'IN_NATION' FROM supplier
  UNION ALL SELECT c_custkey + {CUSTOMER}, c_custkey + {CUSTOMER}, c_nationkey + {NATION}, 'IN_NATION' FROM customer)"""

QUERIES = {
    "gql_match_out": _read("MATCH (n:Nation)-[r:IN_REGION]->(g:Region) RETURN n.name AS nation, g.name AS region"),
    "gql_match_in": _read("MATCH (g:Region)<-[r:IN_REGION]-(n:Nation) WHERE g.name = 'ASIA' RETURN g.name AS region, n.name AS nation"),
    "gql_match_undirected": _read("MATCH (a)-[r:IN_REGION]-(b) RETURN a.name AS a_name, b.name AS b_name"),
    "gql_label_local_name": _read("MATCH (p:party)-[r:IN_NATION]->(n:Nation) WHERE n.name = 'FRANCE' RETURN p.name AS party, n.name AS nation"),
    "gql_where_and_or": _read("MATCH (c:Customer)-[r:IN_NATION]->(n:Nation) WHERE c.acctbal > 9000 AND n.name = 'CHINA' OR c.segment = 'BUILDING' AND c.acctbal < 0 RETURN c.name AS customer, n.name AS nation"),
    "gql_where_null_safe": _read("MATCH (p)-[r:IN_NATION]->(n) WHERE p.segment <> 'BUILDING' AND p.acctbal >= 5000 RETURN p.name AS party, n.name AS nation"),
    "gql_where_null_equal": _read("MATCH (p)-[r:IN_NATION]->(n) WHERE p.segment = NULL RETURN p.name AS party"),
    "gql_where_numeric_text": _read("MATCH (c:Customer)-[r]->(n) WHERE c.acctbal >= '9500' RETURN c.name AS customer"),
    "gql_return_distinct": _read("MATCH (c:Customer)-[r:IN_NATION]->(n:Nation) RETURN DISTINCT c.segment AS segment, n.name AS nation"),
    "gql_count": _read("MATCH (c:Customer)-[r:IN_NATION]->(n:Nation) RETURN COUNT(*) AS n"),
    "gql_count_key": _read("MATCH (p)-[r:IN_NATION]->(n) RETURN COUNT(p.segment) AS segments, COUNT(*) AS n"),
    "gql_count_distinct": _read("MATCH (c:Customer)-[r:IN_NATION]->(n:Nation) RETURN COUNT(DISTINCT c.segment) AS segments, COUNT(DISTINCT n.name) AS nations"),
    "gql_count_with_first_value": _read("MATCH (c:Customer)-[r:IN_NATION]->(n:Nation) RETURN c.name AS first_customer, COUNT(*) AS n"),
    "gql_order_skip_limit": _read("MATCH (c:Customer)-[r:IN_NATION]->(n:Nation) WHERE c.acctbal > 5000 RETURN n.name AS nation, c.name AS customer ORDER BY nation, customer DESC SKIP 5 LIMIT 20"),
    "gql_order_nulls": _read("MATCH (p)-[r:IN_NATION]->(n:Nation) WHERE n.name = 'PERU' RETURN p.segment AS segment, p.name AS party ORDER BY segment DESC, party LIMIT 15"),
}

_M = "FROM e JOIN v a ON a.vid = e.src JOIN v b ON b.vid = e.dst WHERE"
SQL = {
    "gql_match_out": "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
    "gql_match_in": "SELECT r_name AS region, n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
    "gql_match_undirected": "SELECT n_name AS a_name, r_name AS b_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "gql_label_local_name": f"WITH {V} SELECT a.name AS party, b.name AS nation {_M} e.label = 'IN_NATION' AND a.cls = 'bot:Party' AND b.label = 'Nation' AND b.name = 'FRANCE'",
    "gql_where_and_or": f"WITH {V} SELECT a.name AS customer, b.name AS nation {_M} a.label = 'Customer' AND ((a.acctbal > 9000 AND b.name = 'CHINA') OR (a.segment = 'BUILDING' AND a.acctbal < 0))",
    "gql_where_null_safe": f"WITH {V} SELECT a.name AS party, b.name AS nation {_M} e.label = 'IN_NATION' AND a.segment IS DISTINCT FROM 'BUILDING' AND a.acctbal >= 5000",
    "gql_where_null_equal": f"WITH {V} SELECT a.name AS party {_M} e.label = 'IN_NATION' AND a.segment IS NULL",
    "gql_where_numeric_text": "SELECT c_name AS customer FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 9500",
    "gql_return_distinct": "SELECT DISTINCT c_mktsegment AS segment, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "gql_count": "SELECT count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "gql_count_key": f"WITH {V} SELECT count(a.segment) AS segments, count(*) AS n {_M} e.label = 'IN_NATION'",
    "gql_count_distinct": "SELECT count(DISTINCT c_mktsegment) AS segments, count(DISTINCT n_name) AS nations FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "gql_count_with_first_value": "SELECT arg_min(c_name, c_custkey) AS first_customer, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "gql_order_skip_limit": "SELECT n_name AS nation, c_name AS customer FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 ORDER BY nation, customer DESC LIMIT 20 OFFSET 5",
    "gql_order_nulls": f"WITH {V} SELECT a.segment, a.name AS party {_M} e.label = 'IN_NATION' AND b.name = 'PERU' ORDER BY a.segment DESC NULLS FIRST, party LIMIT 15",
}


def _change(text: str, probe):
    """A changing statement's counters, with figures of the changed graph."""

    def run(spark, d):
        r = pattern.run(tables.geography(spark, d), text)
        counters = {"created": r.created, "matched": r.matched, "updated": r.updated, "deleted": r.deleted}
        return probe(r.graph).select(*[F.lit(v).cast("long").alias(k) for k, v in counters.items()], "*")

    return run


def _sizes(g):
    return g.vertices.agg(F.count(F.lit(1)).alias("vertices")).crossJoin(g.edges.agg(F.count(F.lit(1)).alias("edges")))


_S = f"WITH {V} SELECT {{c}}::BIGINT AS created, {{m}}::BIGINT AS matched, {{u}}::BIGINT AS updated, {{d}}::BIGINT AS deleted, {{v}} AS vertices, {{e}} AS edges"
_NV, _NE = "(SELECT count(*) FROM v)", "(SELECT count(*) FROM e)"
_ASIA = "(SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')"
QUERIES |= {
    "gql_create": _change("CREATE (a:Town {name: 'Ostia'})-[r:IN_NATION {since: 12}]->(b:Nation {name: 'LATIUM'})", _sizes),
    "gql_merge_hit": _change("MERGE (a:Region {name: 'ASIA'})", _sizes),
    "gql_merge_miss": _change("MERGE (a:Nation {name: 'FRANCE'})-[r:IN_REGION]->(b:Region {name: 'ASIA'})", _sizes),
    "gql_set": _change("MATCH (n:Nation)-[r:IN_REGION]->(g:Region) WHERE g.name = 'ASIA' SET n.tier = 1, g.seen = 'yes'",
                       lambda g: g.vertices.filter(F.element_at("props", "tier").isNotNull() | F.element_at("props", "seen").isNotNull()).agg(F.count(F.lit(1)).alias("vertices"), F.lit(0).cast("long").alias("edges"))),
    "gql_delete": _change("MATCH (n:Nation)-[r:IN_REGION]->(g:Region) WHERE g.name = 'ASIA' DELETE n", _sizes),
}
_LOST_E = "(SELECT count(*) FROM e WHERE src IN (SELECT n_nationkey + 1000 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') OR dst IN (SELECT n_nationkey + 1000 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'))"
SQL |= {
    "gql_create": _S.format(c=3, m=0, u=0, d=0, v=_NV + " + 2", e=_NE + " + 1"),
    "gql_merge_hit": _S.format(c=0, m=1, u=0, d=0, v=_NV, e=_NE),
    "gql_merge_miss": _S.format(c=3, m=0, u=0, d=0, v=_NV + " + 2", e=_NE + " + 1"),
    "gql_set": _S.format(c=0, m=_ASIA, u="2 * " + _ASIA, d=0, v=_ASIA + " + 1", e="0::BIGINT"),
    "gql_delete": _S.format(c=0, m=_ASIA, u=0, d=f"({_ASIA} + {_LOST_E})", v=f"{_NV} - {_ASIA}", e=f"{_NE} - {_LOST_E}"),
}


def _corpus(f):
    def run(spark, d):
        g = tables.geography(spark, d)
        return f(g.vertices, g.edges)

    return run


def _stored(spark, d):
    """Orders as stored graphs: a graph for each customer and status."""
    o = tables.table(spark, d, "orders")
    return o.groupBy(F.concat_ws(":", F.col("o_custkey").cast("string"), "o_orderstatus").alias("graph_id")).agg(
        F.first("o_orderstatus").alias("label"), F.count(F.lit(1)).alias("num_vertices"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _newer(spark, d):
    return _stored(spark, d).filter("label = 'O'").withColumn("num_vertices", F.col("num_vertices") + 1)


_G = "g AS (SELECT concat(o_custkey, ':', o_orderstatus) AS graph_id, o_orderstatus AS label, count(*) AS num_vertices, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL)"
QUERIES |= {
    "corpus_pairs": _corpus(corpus.label_pairs),
    "corpus_candidates": _corpus(lambda v, e: corpus.candidate_counts(v, e, ["nation"], ["Region"])),
    "corpus_max_neighbors": _corpus(lambda v, e: corpus.max_neighbors(v, e, "Nation")),
    "corpus_best_example": _corpus(lambda v, e: corpus.best_example(v, e, "Nation")),
    "corpus_class_summary": _corpus(lambda v, e: corpus.class_summary(v)),
    "corpus_list_graphs": lambda s, d: corpus.list_graphs(_stored(s, d).select("graph_id", "label", "num_vertices"), {"label": "F", "min_num_vertices": 2, "max_num_vertices": 9}, 3, 25),
    "store_upsert": lambda s, d: corpus.upsert(_stored(s, d), _newer(s, d)).groupBy("label").agg(F.count(F.lit(1)).alias("graphs"), F.sum("num_vertices").alias("vertices")),
    "store_delete": lambda s, d: corpus.delete(_stored(s, d), _newer(s, d)).groupBy("label").agg(F.count(F.lit(1)).alias("graphs"), F.sum("num_vertices").alias("vertices")),
    "store_mirrored": _corpus(lambda v, e: corpus.mirrored(e).groupBy("label").agg(F.count(F.lit(1)).alias("edges"))),
    "store_validate_duplicates": lambda s, d: corpus.duplicates(tables.table(s, d, "lineitem"), "l_partkey"),
}
_P = f"WITH {V}, j AS (SELECT a.label AS al, b.label AS bl, a.vid AS av, b.vid AS bv FROM e JOIN v a ON a.vid = e.src JOIN v b ON b.vid = e.dst)"
_DEG = "d AS (SELECT x.vid, count(DISTINCT o) AS degree FROM v x LEFT JOIN (SELECT src AS s, dst AS o FROM e UNION SELECT dst, src FROM e) ON s = x.vid WHERE x.label = 'Nation' GROUP BY x.vid)"
SQL |= {
    "corpus_pairs": f"{_P} SELECT least(al, bl) AS a_label, greatest(al, bl) AS b_label, least(al, bl) || '-' || greatest(al, bl) AS pair, count(*) AS count FROM j GROUP BY ALL",
    "corpus_candidates": f"{_P} SELECT o AS label, count(*) AS count FROM (SELECT al AS s, bl AS o FROM j UNION ALL SELECT bl, al FROM j) WHERE s = 'Nation' AND o <> 'Region' GROUP BY o",
    "corpus_max_neighbors": f"WITH {V}, {_DEG} SELECT coalesce(max(degree), 0)::BIGINT AS max_neighbors FROM d",
    "corpus_best_example": f"WITH {V}, {_DEG} SELECT vid, degree FROM d ORDER BY degree DESC, vid LIMIT 1",
    "corpus_class_summary": f"WITH {V} SELECT coalesce(cls, '') AS ontology_class, count(*) AS count FROM v GROUP BY 1",
    "corpus_list_graphs": f"WITH {_G} SELECT graph_id, label, num_vertices FROM g WHERE label = 'F' AND num_vertices BETWEEN 2 AND 9 ORDER BY graph_id LIMIT 25 OFFSET 3",
    "store_upsert": f"WITH {_G} SELECT label, count(*) AS graphs, sum(CASE WHEN label = 'O' THEN num_vertices + 1 ELSE num_vertices END)::BIGINT AS vertices FROM g GROUP BY label",
    "store_delete": f"WITH {_G} SELECT label, count(*) AS graphs, sum(num_vertices)::BIGINT AS vertices FROM g WHERE label <> 'O' GROUP BY label",
    "store_mirrored": f"WITH {V} SELECT label, 2 * count(*) AS edges FROM e GROUP BY label",
    "store_validate_duplicates": "SELECT l_partkey AS key, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1 OR l_partkey IS NULL",
}
