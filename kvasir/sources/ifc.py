"""STEP building records: parser, triples, access graph."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: For a relationship, the places of its subject and object arguments and its predicate.
RELATIONS = {
    "IFCRELAGGREGATES": (4, 5, "bot:hasSubElement"),
    "IFCRELCONTAINEDINSPATIALSTRUCTURE": (5, 4, "bot:containsElement"),
    "IFCRELSPACEBOUNDARY": (4, 5, "bot:adjacentElement"),
    "IFCRELFILLSELEMENT": (4, 5, "top:filledBy"),
    "IFCRELVOIDSELEMENT": (4, 5, "top:hasOpening"),
    "IFCRELDEFINESBYPROPERTIES": (4, 5, "top:hasProperties"),
    "IFCRELDEFINESBYTYPE": (4, 5, "top:hasType"),
    "IFCRELASSOCIATESMATERIAL": (4, 5, "top:hasMaterial"),
    "IFCRELCONNECTSPATHELEMENTS": (5, 6, "top:connectsTo"),
}
_HEAD = re.compile(r"#(\d+)\s*=\s*([A-Za-z0-9_]+)\s*\((.*)\)\s*$", re.S)


def parse_args(text: str) -> list:
    """A record's arguments: nested lists, ``#n`` references as text, numbers, strings, ``$`` as None."""
    at = 0

    def value():
        nonlocal at
        while at < len(text) and text[at].isspace():
            at += 1
        if text[at] == "(":
            at += 1
            out = []
            while True:
                while at < len(text) and text[at] in ", \n\r\t":
                    at += 1
                if text[at] == ")":
                    at += 1
                    return out
                out.append(value())
        if text[at] == "'":
            end, out = at + 1, []
            while True:
                stop = text.index("'", end)
                out.append(text[end:stop])
                if text[stop : stop + 2] != "''":
                    at = stop + 1
                    return "'".join(out)
                end = stop + 2
        m = re.compile(r"[^,()\s]+").match(text, at)
        at = m.end()
        token = m.group()
        if token in "$*":
            return None
        if at < len(text) and text[at] == "(":  # a typed value
            inner = value()
            return inner[0] if inner else None
        try:
            return float(token) if re.fullmatch(r"-?\d+(\.\d*)?(E[+-]?\d+)?", token, re.I) and not token.startswith("#") else token
        except ValueError:
            return token

    out = []
    while at < len(text):
        while at < len(text) and text[at] in ", \n\r\t":
            at += 1
        if at < len(text):
            out.append(value())
    return out


def parse_record(record: str) -> tuple[int, str, str] | None:
    """id, type and arguments as JSON; None for what is no record."""
    m = _HEAD.match(record.strip())
    if not m:
        return None
    try:
        return int(m.group(1)), m.group(2).upper(), json.dumps(parse_args(m.group(3)))
    except (ValueError, IndexError, AttributeError):
        return None


def entities(records: DataFrame) -> DataFrame:
    """``id, type, args`` (JSON) of ``records(value)``; bad records go."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [x for x in (parse_record(v or "") for v in batch.column(0).to_pylist()) if x]
            cols = list(zip(*got)) if got else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["id", "type", "args"])

    return records.select(F.col("value").cast("string")).mapInArrow(run, "id long, type string, args string")


def read_step(spark: SparkSession, path: str) -> DataFrame:
    return entities(spark.read.option("lineSep", ";").text(path))


def _refs(position: int):
    """References at a place of the arguments, one or a list."""
    raw = F.get_json_object("args", f"$[{position}]")
    return F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r"#(\d+)"), 1)


def triples(ents: DataFrame) -> DataFrame:
    """``s, p, o`` of types, names and relationships; both ends' lists expand."""
    inst = lambda c: F.concat(F.lit("inst:"), c.cast("string"))
    things = ents.filter(~F.col("type").startswith("IFCREL"))
    out = things.select(inst(F.col("id")).alias("s"), F.lit("rdf:type").alias("p"), F.concat(F.lit("ifc:"), "type").alias("o"))
    name = F.get_json_object("args", "$[2]")
    out = out.unionByName(things.filter(name.isNotNull() & ~name.startswith("#") & ~name.startswith("[")).select(inst(F.col("id")).alias("s"), F.lit("rdfs:label").alias("p"), F.concat(F.lit('"'), name, F.lit('"')).alias("o")))
    for kind, (s, o, p) in RELATIONS.items():
        rel = ents.filter(F.col("type") == kind)
        out = out.unionByName(rel.select(F.explode(_refs(s)).alias("x"), "args").select("x", F.explode(_refs(o)).alias("y")).select(inst(F.col("x")).alias("s"), F.lit(p).alias("p"), inst(F.col("y")).alias("o")))
    return out.distinct()


def boundaries(ents: DataFrame) -> DataFrame:
    """``space, element, kind`` of space boundaries."""
    b = ents.filter(F.col("type") == "IFCRELSPACEBOUNDARY").select(F.element_at(_refs(4), 1).cast("long").alias("space"), F.element_at(_refs(5), 1).cast("long").alias("element"))
    return b.join(ents.select(F.col("id").alias("element"), F.col("type").alias("kind")), "element").select("space", "element", "kind").distinct()


def access_graph(ents: DataFrame, connectors: tuple[str, ...] = ("IFCDOOR", "IFCOPENINGELEMENT")) -> DataFrame:
    """``a, b, via``: spaces that share a connector."""
    at = boundaries(ents).filter(F.col("kind").isin(*connectors))
    x, y = at.select("element", F.col("space").alias("a")), at.select("element", F.col("space").alias("b"))
    return x.join(y, "element").filter("a < b").select("a", "b", F.col("element").alias("via"))


def connector_report(ents: DataFrame, connectors: tuple[str, ...] = ("IFCDOOR", "IFCOPENINGELEMENT")) -> DataFrame:
    """``via, spaces, verdict``: two spaces are normal, one is external or incomplete, more are flagged."""
    n = boundaries(ents).filter(F.col("kind").isin(*connectors)).groupBy(F.col("element").alias("via")).agg(F.count_distinct("space").alias("spaces"))
    return n.select("via", "spaces", F.when(F.col("spaces") == 2, "normal").when(F.col("spaces") < 2, "external or incomplete").otherwise("flagged").alias("verdict"))
