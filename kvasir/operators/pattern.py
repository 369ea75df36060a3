"""The one-hop pattern language: MATCH / WHERE / RETURN, CREATE, MERGE, SET, DELETE.

A statement is parsed into a small tree and planned as joins of the edge table with the vertex table;
label filters sit below the joins, and projection decides which attributes are read.

Comparison is two-valued: numbers if both sides look like numbers, else stripped strings; a null equals
null alone; ``<>`` of unlike kinds is true, an order of unlike kinds false.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from kvasir.operators.model import FIELDS, Graph, empty_props

_TOKEN = re.compile(
    r"""\s*(?:(?P<string>"[^"]*"|'[^']*')|(?P<number>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][\w]*(?::[A-Za-z_]\w*)?)"""
    r"""|(?P<op><-\[|\]->|-\[|\]-|<>|!=|==|<=|>=|--|[()\[\]{}:,.=<>*-]))"""
)
_KEYWORDS = {"MATCH", "WHERE", "RETURN", "CREATE", "MERGE", "SET", "DELETE", "AND", "OR", "ORDER", "BY", "ASC", "DESC", "SKIP", "LIMIT", "DISTINCT", "COUNT", "AS", "TRUE", "FALSE", "NULL"}
NUMBER = r"^\s*-?(\d+\.?\d*|\.\d+)\s*$"


class PatternError(ValueError):
    pass


@dataclass
class Node:
    var: str | None = None
    label: str | None = None
    props: dict = field(default_factory=dict)


@dataclass
class Hop:
    left: Node
    edge: Node | None = None
    right: Node | None = None
    direction: str = "out"


@dataclass
class Item:
    """A returned expression: a variable, a variable's key, or a count."""

    var: str | None
    key: str | None = None
    count: bool = False
    distinct: bool = False
    alias: str | None = None

    @property
    def name(self) -> str:
        own = "*" if self.var is None else self.var if self.key is None else f"{self.var}.{self.key}"
        return self.alias or (f"COUNT({'DISTINCT ' * self.distinct}{own})" if self.count else own)


@dataclass
class Statement:
    kind: str
    hop: Hop
    where: tuple | None = None
    items: list[Item] = field(default_factory=list)
    star: bool = False
    distinct: bool = False
    order: list[tuple[str, bool]] = field(default_factory=list)
    skip: int | None = None
    limit: int | None = None
    updates: list[tuple[str, str, object]] = field(default_factory=list)
    deletes: list[str] = field(default_factory=list)


class _Parser:
    def __init__(self, text: str):
        self.tokens, at, text = [], 0, text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise PatternError(f"cannot read {text[at:at + 20]!r}")
            kind = m.lastgroup
            value = m.group(kind)
            # a name takes one colon only as a prefix of a qualified name after another colon
            if kind == "name" and ":" in value and not (self.tokens and self.tokens[-1] == ("op", ":")):
                head, tail = value.split(":")
                self.tokens += [("name", head), ("op", ":"), ("name", tail)]
            else:
                self.tokens.append((kind, value))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        if self.at >= len(self.tokens):
            return False
        kind, value = self.tokens[self.at]
        return (value.upper() if kind == "name" else value) in values and kind != "string"

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            found = self.tokens[self.at][1] if self.at < len(self.tokens) else "the end"
            raise PatternError(f"expected {value}, found {found}")

    def next(self, kind: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise PatternError(f"expected a {kind}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def literal(self):
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return value[1:-1]
        if kind == "number":
            return float(value) if "." in value else int(value)
        return {"TRUE": True, "FALSE": False, "NULL": None}.get(value.upper(), value)

    def inner(self, close: str) -> Node:
        node = Node()
        if not self.peek(":", close, "{"):
            node.var = self.next("name")
        if self.take(":"):
            node.label = self.next("name")
        if self.take("{"):
            while not self.take("}"):
                key = self.next("name")
                self.need(":")
                node.props[key] = self.literal()
                self.take(",")
        return node

    def node(self) -> Node:
        self.need("(")
        out = self.inner(")")
        self.need(")")
        return out

    def hop(self) -> Hop:
        left = self.node()
        if self.take("--"):
            return Hop(left, Node(), self.node(), "both")
        if self.take("<-["):
            edge = self.inner("]-")
            self.need("]-")
            return Hop(left, edge, self.node(), "in")
        if self.take("-["):
            edge = self.inner("]-")
            if self.take("]->"):
                return Hop(left, edge, self.node(), "out")
            self.need("]-")
            return Hop(left, edge, self.node(), "both")
        return Hop(left)

    def condition(self) -> tuple:
        out = self.conjunction()
        while self.take("OR"):
            out = ("or", out, self.conjunction())
        return out

    def conjunction(self) -> tuple:
        out = self.atom()
        while self.take("AND"):
            out = ("and", out, self.atom())
        return out

    def atom(self) -> tuple:
        if self.take("("):
            out = self.condition()
            self.need(")")
            return out
        var = self.next("name")
        self.need(".")
        key = self.next("name")
        for op in ("<>", "!=", "==", "<=", ">=", "=", "<", ">"):
            if self.take(op):
                return ("cmp", var, key, {"!=": "<>", "==": "="}.get(op, op), self.literal())
        raise PatternError("expected a comparison")

    def item(self) -> Item:
        if self.take("COUNT"):
            self.need("(")
            distinct = self.take("DISTINCT")
            out = Item(None, None, True, distinct) if self.take("*") else self.value(Item(None, count=True, distinct=distinct))
            self.need(")")
        else:
            out = self.value(Item(None))
        if self.take("AS"):
            out.alias = self.next("name")
        return out

    def value(self, item: Item) -> Item:
        item.var = self.next("name")
        if self.take("."):
            item.key = self.next("name")
        return item

    def returning(self, s: Statement) -> None:
        s.distinct = self.take("DISTINCT")
        if self.take("*"):
            s.star = True
        else:
            s.items.append(self.item())
            while self.take(","):
                s.items.append(self.item())
        if self.take("ORDER"):
            self.need("BY")
            while True:
                name = self.next("name")
                if self.take("."):
                    name += "." + self.next("name")
                s.order.append((name, not self.take("DESC") and (self.take("ASC") or True)))
                if not self.take(","):
                    break
        if self.take("SKIP"):
            s.skip = int(self.next("number"))
        if self.take("LIMIT"):
            s.limit = int(self.next("number"))

    def statement(self) -> Statement:
        for kind in ("CREATE", "MERGE"):
            if self.take(kind):
                s = Statement(kind.lower(), self.hop())
                if self.take("RETURN"):
                    self.returning(s)
                return self.end(s)
        self.need("MATCH")
        s = Statement("match", self.hop())
        if s.hop.right is None:
            raise PatternError("MATCH takes one hop")
        if self.take("WHERE"):
            s.where = self.condition()
        if self.take("SET"):
            s.kind = "set"
            while True:
                var = self.next("name")
                self.need(".")
                key = self.next("name")
                self.need("=")
                s.updates.append((var, key, self.literal()))
                if not self.take(","):
                    break
        elif self.take("DELETE"):
            s.kind = "delete"
            s.deletes.append(self.next("name"))
            while self.take(","):
                s.deletes.append(self.next("name"))
        else:
            self.need("RETURN")
            self.returning(s)
        return self.end(s)

    def end(self, s: Statement) -> Statement:
        if self.at != len(self.tokens):
            raise PatternError(f"unexpected {self.tokens[self.at][1]}")
        return s


def parse(text: str) -> Statement:
    return _Parser(re.sub(r":top:(\w+)", r":\1", text)).statement()


def local_name(c: Column) -> Column:
    """What follows the first colon, or all."""
    return F.when(F.instr(c, ":") > 0, F.substring_index(F.concat(c, F.lit("")), ":", -1)).otherwise(c)


def has_label(label: str, prefix: str = "") -> Column:
    """A field equals the label, or its local name does without case."""
    want = label.split(":", 1)[-1].lower()
    out = F.lit(False)
    for f in FIELDS:
        c = F.col(prefix + f)
        out = out | F.coalesce((c == label) | (F.lower(local_name(c)) == want), F.lit(False))
    return out


def _as_text(value) -> str | None:
    return None if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def compare(c: Column, op: str, value) -> Column:
    text = _as_text(value)
    if text is None:
        return c.isNull() if op == "=" else c.isNotNull() if op == "<>" else F.lit(False)
    if re.match(NUMBER, text):
        number, like = float(text), F.coalesce(c.rlike(NUMBER), F.lit(False))
        n = F.when(like, F.trim(c).cast("double"))
        kinds = {"=": n == number, "<>": n != number, "<": n < number, "<=": n <= number, ">": n > number, ">=": n >= number}
        return F.coalesce(kinds[op], F.lit(op == "<>"))
    t = F.trim(c)
    text = text.strip()
    kinds = {"=": t == text, "<>": t != text, "<": t < text, "<=": t <= text, ">": t > text, ">=": t >= text}
    if op in "<=>" and op != "=":
        kinds[op] = F.when(c.rlike(NUMBER), F.lit(False)).otherwise(kinds[op])
    return F.coalesce(kinds[op], F.lit(op == "<>"))


def attribute(var: str, key: str) -> Column:
    if key in FIELDS:
        return F.col(f"{var}.{key}")
    if key in ("index", "id"):
        return F.coalesce(F.element_at(F.col(f"{var}.props"), key), F.col(f"{var}.vid").cast("string"))
    return F.element_at(F.col(f"{var}.props"), key)


def _names(hop: Hop) -> tuple[str, str, str]:
    return hop.left.var or "_a", (hop.edge.var if hop.edge else None) or "_r", (hop.right.var if hop.right else None) or "_b"


def _having(df: DataFrame, node: Node) -> DataFrame:
    if node.label:
        df = df.filter(has_label(node.label))
    for k, v in node.props.items():
        c = F.col(k) if k in FIELDS else F.element_at("props", k)
        df = df.filter(compare(c, "=", v))
    return df


def matches(graph: Graph, hop: Hop, where: tuple | None = None) -> DataFrame:
    """A row for each match: structs of the two vertices and the edge, and ``_pos``, the order of the input."""
    a, r, b = _names(hop)
    e = _having(graph.edges, hop.edge)
    edge = F.struct(F.col("eid").alias("vid"), *FIELDS, "props").alias(r)
    out = e.select(F.col("src").alias("_x"), F.col("dst").alias("_y"), edge, (F.col("eid") * 2).alias("_pos"))
    back = e.select(F.col("dst").alias("_x"), F.col("src").alias("_y"), edge, (F.col("eid") * 2 + 1).alias("_pos"))
    rows = {"out": out, "in": back, "both": out.unionByName(back)}[hop.direction]
    ends = F.struct("vid", *FIELDS, "props")
    left = _having(graph.vertices, hop.left).select(F.col("vid").alias("_x"), ends.alias(a))
    right = _having(graph.vertices, hop.right).select(F.col("vid").alias("_y"), ends.alias(b))
    rows = rows.join(left, "_x").join(right, "_y").drop("_x", "_y")
    return rows.filter(_condition(where, {a, r, b})) if where else rows


def _condition(tree: tuple, bound: set[str]) -> Column:
    if tree[0] in ("and", "or"):
        x, y = _condition(tree[1], bound), _condition(tree[2], bound)
        return x & y if tree[0] == "and" else x | y
    _, var, key, op, value = tree
    return compare(attribute(var, key), op, value) if var in bound else F.lit(False)


def _value(item: Item) -> Column:
    if item.key is not None:
        return attribute(item.var, item.key)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.col(f"{item.var}.props")))))


def _project(rows: DataFrame, s: Statement) -> DataFrame:
    a, r, b = _names(s.hop)
    items = [Item(v) for v in (a, r, b) if not v.startswith("_")] if s.star else s.items
    if any(i.count for i in items):
        cols = []
        for i in items:
            if not i.count:
                cols.append(F.min_by(_value(i), "_pos").alias(i.name))  # the first row's value
            elif i.var is None:
                every = F.struct(*[F.col(f"{v}.vid") for v in (a, r, b)])
                cols.append((F.count_distinct(every) if i.distinct else F.count(F.lit(1))).alias(i.name))
            else:
                cols.append((F.count_distinct(_value(i)) if i.distinct else F.count(_value(i))).alias(i.name))
        return rows.agg(*cols)
    out = rows.select(*[_value(i).alias(i.name) for i in items], "_pos")
    if s.distinct:
        out = out.groupBy(*[f"`{i.name}`" for i in items]).agg(F.min("_pos").alias("_pos"))
    keys, known = [], {i.name for i in items}
    for name, up in s.order:
        if name in known:  # an unreturned key sorts nothing
            c = F.col(f"`{name}`")
            number = F.when(c.rlike(NUMBER), F.trim(c).cast("double"))
            keys += [x.asc_nulls_last() if up else x.desc_nulls_first() for x in (number, c)]
    if keys or s.skip is not None or s.limit is not None:
        out = out.orderBy(*keys, "_pos")
    if s.skip:
        out = out.offset(s.skip)
    if s.limit is not None:
        out = out.limit(s.limit)
    return out.drop("_pos")


@dataclass
class Result:
    """A statement's rows, or the changed graph and its counters."""

    rows: DataFrame | None
    graph: Graph
    action: str
    created: int = 0
    matched: int = 0
    updated: int = 0
    deleted: int = 0


def query(graph: Graph, text: str) -> DataFrame:
    """The rows of a reading statement; lazy."""
    s = parse(text)
    if s.kind != "match":
        raise PatternError("not a reading statement")
    return _project(matches(graph, s.hop, s.where), s)


def _create(graph: Graph, s: Statement) -> Result:
    spark = graph.vertices.sparkSession
    hop = s.hop
    top = lambda df, c: (df.agg(F.max(c)).first()[0] or 0) + 1

    def row(ids: dict, node: Node) -> Row:
        given = {k: _as_text(v) for k, v in node.props.items() if v is not None}
        fields = {f: given.pop(f, None) for f in FIELDS}
        fields["label"] = fields["label"] or node.label
        return Row(**ids, **fields, props=given)

    v0 = top(graph.vertices, "vid")
    nodes = [row({"vid": v0}, hop.left)] + ([row({"vid": v0 + 1}, hop.right)] if hop.right else [])
    vertices = graph.vertices.unionByName(spark.createDataFrame(nodes, graph.vertices.schema))
    edges = graph.edges
    if hop.right:
        ends = (v0 + 1, v0) if hop.direction == "in" else (v0, v0 + 1)
        edges = edges.unionByName(spark.createDataFrame([row({"eid": top(edges, "eid"), "src": ends[0], "dst": ends[1]}, hop.edge)], edges.schema))
    return Result(None, graph.with_(vertices=vertices, edges=edges), "create", created=len(nodes) + bool(hop.right))


def run(graph: Graph, text: str) -> Result:
    """Run any statement.  A pattern merges as a whole: it is there, or all of it is created."""
    s = parse(text)
    if s.kind == "match":
        return Result(_project(matches(graph, s.hop, s.where), s), graph, "match")
    if s.kind == "create":
        return _create(graph, s)
    if s.kind == "merge":
        found = matches(graph, s.hop) if s.hop.right else _having(graph.vertices, s.hop.left)
        n = found.count()
        return Result(None, graph, "merge", matched=n) if n else _create(graph, s)
    rows = matches(graph, s.hop, s.where)
    a, r, b = _names(s.hop)
    n = rows.count()
    if s.kind == "set":
        vertices, edges = graph.vertices, graph.edges
        for var, key, value in s.updates:
            ids = rows.select(F.col(f"{var}.vid").alias("_id")).distinct()
            if var == r:
                edges = _updated(edges, "eid", ids, key, value)
            else:
                vertices = _updated(vertices, "vid", ids, key, value)
        return Result(None, graph.with_(vertices=vertices, edges=edges), "set", matched=n, updated=n * len(s.updates))
    vids, eids = None, None
    for var in s.deletes:
        ids = rows.select(F.col(f"{var}.vid").alias("_id"))
        if var == r:
            eids = ids if eids is None else eids.union(ids)
        else:
            vids = ids if vids is None else vids.union(ids)
    vertices, edges = graph.vertices, graph.edges
    if eids is not None:
        edges = edges.join(eids.distinct(), F.col("eid") == F.col("_id"), "left_anti")
    if vids is not None:
        vids = vids.distinct()
        vertices = vertices.join(vids, F.col("vid") == F.col("_id"), "left_anti")
        for end in ("src", "dst"):
            edges = edges.join(vids, F.col(end) == F.col("_id"), "left_anti")
    gone = graph.vertices.count() - vertices.count() + graph.edges.count() - edges.count()
    return Result(None, graph.with_(vertices=vertices, edges=edges), "delete", matched=n, deleted=gone)


def _updated(df: DataFrame, id_col: str, ids: DataFrame, key: str, value) -> DataFrame:
    text = F.lit(_as_text(value)).cast("string")
    hit = F.col("_id").isNotNull()
    joined = df.join(ids, F.col(id_col) == F.col("_id"), "left")
    if key in FIELDS:
        out = joined.withColumn(key, F.when(hit, text).otherwise(F.col(key)))
    else:
        rest = F.map_filter("props", lambda k, v: k != key)
        changed = rest if value is None else F.map_concat(rest, F.create_map(F.lit(key), text))
        out = joined.withColumn("props", F.when(hit, changed).otherwise(F.col("props")))
    return out.select(*df.columns)


__all__ = ["Graph", "PatternError", "Result", "empty_props", "parse", "query", "run"]
