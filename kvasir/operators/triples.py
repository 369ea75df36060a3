"""Triples ``s, p, o`` with set semantics, basic graph patterns, and RDFS inference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvasir.operators import iterate

TYPE, SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = "rdf:type", "rdfs:subClassOf", "rdfs:subPropertyOf", "rdfs:domain", "rdfs:range"


def pattern(t: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    for name, v in (("s", s), ("p", p), ("o", o)):
        if v is not None:
            t = t.filter(F.col(name) == v)
    return t.distinct()


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b, ["s", "p", "o"], "left_anti")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``change, n``: added, removed and unchanged triples."""
    b, a = before.distinct().withColumn("in_b", F.lit(1)), after.distinct().withColumn("in_a", F.lit(1))
    both = b.join(a, ["s", "p", "o"], "full")
    kind = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "removed").otherwise("unchanged")
    return both.groupBy(kind.alias("change")).agg(F.count(F.lit(1)).alias("n"))


def summary(t: DataFrame) -> DataFrame:
    return t.distinct().groupBy("p").agg(F.count(F.lit(1)).alias("triples"), F.count_distinct("s").alias("subjects"), F.count_distinct("o").alias("objects"))


def bgp(t: DataFrame, patterns: list[tuple[str, str, str]], optional: list[tuple[str, str, str]] = ()) -> DataFrame:
    """Joins of patterns on their shared ``?variables``; optional ones by left joins."""
    t, out = t.distinct(), None
    for k, (s, p, o) in enumerate([*patterns, *optional]):
        rows, names = t, {}
        for col, term in (("s", s), ("p", p), ("o", o)):
            if term.startswith("?"):
                if term[1:] in names:
                    rows = rows.filter(F.col(col) == F.col(names[term[1:]]))
                else:
                    names[term[1:]] = col
            else:
                rows = rows.filter(F.col(col) == term)
        rows = rows.select(*[F.col(c).alias(n) for n, c in names.items()]).distinct()
        if out is None:
            out = rows
        else:
            shared = [c for c in rows.columns if c in out.columns]
            how = "left" if k >= len(patterns) else "inner"
            out = out.join(rows, shared, how) if shared else out.crossJoin(rows)
    return out


def ask(t: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    return bgp(t, patterns).limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))


def _is_resource(c: str):
    return ~F.col(c).startswith('"')


def rdfs_closure(t: DataFrame) -> DataFrame:
    """All triples that subclass, subproperty, domain and range axioms entail."""

    def step(every: DataFrame, new: DataFrame) -> DataFrame:
        def rule(a: str, b: str, kind: str) -> DataFrame:
            """x ``a`` y, y ``b`` z entails x ``kind`` z, with a new triple on either side."""
            out = None
            for left, right in ((new, every), (every, new)):
                x = left.filter(F.col("p") == a).select("s", F.col("o").alias("m"))
                y = right.filter(F.col("p") == b).select(F.col("s").alias("m"), "o")
                j = x.join(y, "m").filter("s != o" if a == b else "true").select("s", F.lit(kind).alias("p"), "o")
                out = j if out is None else out.unionByName(j)
            return out

        def by_predicate(axiom: str, make) -> DataFrame:
            out = None
            for left, right in ((new, every), (every, new)):
                ax = right.filter(F.col("p") == axiom).select(F.col("s").alias("p"), F.col("o").alias("c"))
                j = make(left.join(ax, "p"))
                out = j if out is None else out.unionByName(j)
            return out

        typed = F.lit(TYPE).alias("p")
        parts = [
            rule(SUBCLASS, SUBCLASS, SUBCLASS), rule(TYPE, SUBCLASS, TYPE), rule(SUBPROPERTY, SUBPROPERTY, SUBPROPERTY),
            by_predicate(SUBPROPERTY, lambda j: j.select("s", F.col("c").alias("p"), "o")),
            by_predicate(DOMAIN, lambda j: j.select("s", typed, F.col("c").alias("o"))),
            by_predicate(RANGE, lambda j: j.filter(_is_resource("o")).select(F.col("o").alias("s"), typed, F.col("c").alias("o"))),
        ]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    return iterate.closure(step, t.select("s", "p", "o"))


def superclass_path(t: DataFrame, start: str, goal: str) -> DataFrame:
    """The least (shortest, then alphabetical) chain of subclass axioms from one class to another, as ``path, length``."""
    arcs = t.filter(F.col("p") == SUBCLASS).select("s", "o").distinct()
    cur = iterate.keep(t.sparkSession.range(1).select(F.array(F.lit(start)).alias("path")))
    while True:  # paths that come back to a class of theirs end
        hit = cur.filter(F.element_at("path", -1) == goal)
        if not hit.isEmpty() or cur.isEmpty():
            break
        step = cur.withColumn("s", F.element_at("path", -1)).join(arcs, "s").filter(~F.array_contains("path", F.col("o")))
        # one path to each class suffices: the alphabetically first
        cur = iterate.keep(step.groupBy("o").agg(F.min(F.array_append("path", F.col("o"))).alias("path")).select("path"))
    return cur.filter(F.element_at("path", -1) == goal).agg(F.min("path").alias("path")).filter("path IS NOT NULL").select(F.array_join("path", " > ").alias("path"), (F.size("path") - 1).alias("length"))


def add(t: DataFrame, rows: list[tuple[str, str, str]]) -> DataFrame:
    return merge(t.select("s", "p", "o"), t.sparkSession.createDataFrame(rows, "s string, p string, o string"))


def remove(t: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Without the triples that match the given parts."""
    given = [F.col(c) == v for c, v in (("s", s), ("p", p), ("o", o)) if v is not None]
    match = F.lit(True)
    for g in given:
        match = match & g
    return t.filter(~match).distinct()


def resources(t: DataFrame) -> DataFrame:
    """``resource``: every subject, and every object that is no literal."""
    return t.select(F.col("s").alias("resource")).union(t.filter(_is_resource("o")).select("o")).distinct()


def literals(t: DataFrame) -> DataFrame:
    return t.filter(~_is_resource("o")).select(F.col("o").alias("literal")).distinct()


def instances(t: DataFrame, cls: str) -> DataFrame:
    """``s`` of the class or, through subclass axioms, of one below it."""
    below = rdfs_closure(t.filter(F.col("p") == SUBCLASS)).filter((F.col("p") == SUBCLASS) & (F.col("o") == cls)).select(F.col("s").alias("o"))
    every = below.union(t.sparkSession.createDataFrame([(cls,)], "o string")).distinct()
    return t.filter(F.col("p") == TYPE).join(every, "o", "left_semi").select("s").distinct()


def validate(t: DataFrame) -> DataFrame:
    """``rule, n`` of what is wrong: empty parts, literal subjects or predicates, untyped subjects, classes that are their own superclass."""
    empty = t.filter("s IS NULL OR p IS NULL OR o IS NULL OR s = '' OR p = '' OR o = ''").select(F.lit("empty part").alias("rule"))
    literal = t.filter(~_is_resource("s") | ~_is_resource("p")).select(F.lit("literal subject or predicate"))
    untyped = t.filter(~F.col("p").isin(SUBCLASS, SUBPROPERTY, DOMAIN, RANGE)).select("s").distinct().join(t.filter(F.col("p") == TYPE).select("s"), "s", "left_anti").select(F.lit("untyped subject"))
    loop = t.filter((F.col("p") == SUBCLASS) & (F.col("s") == F.col("o"))).select(F.lit("own superclass"))
    return empty.unionAll(literal).unionAll(untyped).unionAll(loop).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def as_turtle(t: DataFrame) -> DataFrame:
    """``s, text``: one Turtle block for each subject, its predicates in order; a subject's triples bound its row."""
    rows = t.distinct().groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_list("o")), ", ").alias("o"))
    own = rows.groupBy("s").agg(F.array_sort(F.collect_list(F.concat_ws(" ", F.when(F.col("p") == TYPE, "a").otherwise(F.col("p")), "o"))).alias("parts"))
    return own.select("s", F.concat(F.col("s"), F.lit(" "), F.array_join("parts", " ; "), F.lit(" .")).alias("text"))


def as_json(t: DataFrame) -> DataFrame:
    return t.distinct().select(F.to_json(F.struct("s", "p", "o")).alias("value"))


def by_json(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("value", "s string, p string, o string").alias("r")).select("r.*").filter("s IS NOT NULL").distinct()
