"""Queries in SPARQL text, and triples changed, listed, checked and written, over the geography's triples."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvasir.operators import sparql, triples
from kvasir.plans.graphs import _T, _geo_triples

_q = lambda text: lambda s, d: sparql.query(_geo_triples(s, d), text)

QUERIES = {
    "sparql_join": _q('SELECT ?c ?n WHERE { ?c a ?n ; top:segment "BUILDING" . ?n rdfs:subClassOf r:ASIA }'),
    "sparql_filter": _q('PREFIX top: <urn:x> SELECT ?c WHERE { ?c top:segment ?s . FILTER(regex(?s, "^(AUTO|MACH)") && ?s != "MACHINERY") }'),
    "sparql_number": _q("SELECT ?n (COUNT(DISTINCT ?c) AS ?k) WHERE { ?c a ?n . ?n rdfs:subClassOf ?r . FILTER(strlen(?n) > 8 || contains(str(?r), \"ASIA\")) }"),
    "sparql_optional": _q("SELECT ?n ?c WHERE { ?n rdfs:subClassOf r:EUROPE OPTIONAL { ?c a ?n FILTER(strstarts(?c, \"c:1\")) } FILTER(!bound(?c) || isIRI(?c)) }"),
    "sparql_union": _q("SELECT DISTINCT ?x WHERE { { ?x rdfs:subClassOf r:ASIA } UNION { ?x rdfs:subClassOf r:AFRICA } }"),
    "sparql_order": _q("SELECT ?n WHERE { ?n rdfs:subClassOf ?r } ORDER BY DESC(?r) ?n LIMIT 7 OFFSET 2"),
    "sparql_count": _q("SELECT (COUNT(*) AS ?n) WHERE { ?x ?p ?y }"),
    "sparql_ask": _q("ASK { ?x rdfs:subClassOf r:NOWHERE }"),
    "sparql_insert": lambda s, d: sparql.update(_geo_triples(s, d), 'INSERT DATA { n:NEW rdfs:subClassOf r:ASIA . n:NEW top:name "New" }').filter("s = 'n:NEW' OR o = 'r:ASIA'"),
    "sparql_delete": lambda s, d: triples.summary(sparql.update(_geo_triples(s, d), 'DELETE WHERE { ?c top:segment "BUILDING" }')),
    "kg_add": lambda s, d: triples.add(_geo_triples(s, d), [("x:1", "rdf:type", "n:FRANCE")]).filter("o = 'n:FRANCE'"),
    "kg_remove": lambda s, d: triples.summary(triples.remove(_geo_triples(s, d), p="top:segment")),
    "kg_resources": lambda s, d: triples.resources(_geo_triples(s, d)),
    "kg_literals": lambda s, d: triples.literals(_geo_triples(s, d)),
    "kg_instances": lambda s, d: triples.instances(_geo_triples(s, d), "r:ASIA"),
    "kg_validate": lambda s, d: triples.validate(triples.add(_geo_triples(s, d), [("z:1", "top:x", "z:2"), ("z:3", "rdfs:subClassOf", "z:3"), ('"lit"', "rdf:type", "z:1")])),
    "kg_turtle": lambda s, d: triples.as_turtle(_geo_triples(s, d)),
    "kg_json": lambda s, d: triples.by_json(triples.as_json(_geo_triples(s, d))),
}
_ALL = f"WITH {_T} SELECT DISTINCT s, p, o FROM t"
SQL = {
    "sparql_join": f"WITH {_T} SELECT x.s AS c, x.o AS n FROM t x JOIN t y ON y.s = x.o JOIN t z ON z.s = x.s WHERE x.p = 'rdf:type' AND y.p = 'rdfs:subClassOf' AND y.o = 'r:ASIA' AND z.p = 'top:segment' AND z.o = '\"BUILDING\"'",
    "sparql_filter": f"WITH {_T} SELECT s AS c FROM t WHERE p = 'top:segment' AND (o LIKE '\"AUTO%' OR o LIKE '\"MACH%') AND o <> '\"MACHINERY\"'",
    "sparql_number": f"WITH {_T} SELECT x.o AS n, count(DISTINCT x.s) AS k FROM t x JOIN t y ON y.s = x.o WHERE x.p = 'rdf:type' AND y.p = 'rdfs:subClassOf' AND (length(x.o) > 8 OR contains(y.o, 'ASIA')) GROUP BY 1",
    "sparql_optional": f"WITH {_T} SELECT y.s AS n, x.s AS c FROM t y LEFT JOIN (SELECT * FROM t WHERE p = 'rdf:type' AND starts_with(s, 'c:1')) x ON x.o = y.s WHERE y.p = 'rdfs:subClassOf' AND y.o = 'r:EUROPE'",
    "sparql_union": f"WITH {_T} SELECT DISTINCT s AS x FROM t WHERE p = 'rdfs:subClassOf' AND o IN ('r:ASIA', 'r:AFRICA')",
    "sparql_order": f"WITH {_T} SELECT s AS n FROM t WHERE p = 'rdfs:subClassOf' ORDER BY o DESC, s LIMIT 7 OFFSET 2",
    "sparql_count": f"WITH {_T} SELECT count(*) AS n FROM (SELECT DISTINCT s, p, o FROM t)",
    "sparql_ask": "SELECT false AS answer",
    "sparql_insert": f"WITH {_T} SELECT DISTINCT s, p, o FROM t WHERE o = 'r:ASIA' UNION ALL SELECT 'n:NEW', 'rdfs:subClassOf', 'r:ASIA' UNION ALL SELECT 'n:NEW', 'top:name', '\"New\"'",
    "sparql_delete": f"WITH {_T} SELECT p, count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM (SELECT DISTINCT s, p, o FROM t WHERE NOT (p = 'top:segment' AND o = '\"BUILDING\"')) GROUP BY p",
    "kg_add": f"WITH {_T} SELECT DISTINCT s, p, o FROM t WHERE o = 'n:FRANCE' UNION ALL SELECT 'x:1', 'rdf:type', 'n:FRANCE'",
    "kg_remove": f"WITH {_T} SELECT p, count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM (SELECT DISTINCT s, p, o FROM t WHERE p <> 'top:segment') GROUP BY p",
    "kg_resources": f"WITH {_T} SELECT s AS resource FROM t UNION SELECT o FROM t WHERE NOT starts_with(o, '\"')",
    "kg_literals": f"WITH {_T} SELECT DISTINCT o AS literal FROM t WHERE starts_with(o, '\"')",
    "kg_instances": f"WITH {_T} SELECT DISTINCT x.s FROM t x JOIN t y ON y.s = x.o WHERE x.p = 'rdf:type' AND y.p = 'rdfs:subClassOf' AND y.o = 'r:ASIA'",
    "kg_validate": "SELECT 'literal subject or predicate' AS rule, 1::BIGINT AS n UNION ALL SELECT 'untyped subject', 1 UNION ALL SELECT 'own superclass', 1",
    "kg_turtle": f"WITH {_T}, g AS (SELECT s, CASE WHEN p = 'rdf:type' THEN 'a' ELSE p END || ' ' || string_agg(o, ', ' ORDER BY o) AS part FROM (SELECT DISTINCT s, p, o FROM t) GROUP BY s, p) SELECT s, s || ' ' || string_agg(part, ' ; ' ORDER BY part) || ' .' AS text FROM g GROUP BY s",
    "kg_json": _ALL,
}
