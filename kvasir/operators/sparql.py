"""A subset of SPARQL text over ``s, p, o`` triples, planned as DataFrame joins.

SELECT [DISTINCT] variables, ``*`` or COUNT; ASK; INSERT DATA, DELETE DATA and DELETE WHERE; triple patterns with
``;`` and ``,``, OPTIONAL, UNION and FILTER; ORDER BY, LIMIT and OFFSET; PREFIX lines.  Terms are kept as in the
triples: prefixed names as written, literals in double quotes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvasir.operators import triples

_TOKEN = re.compile(r'\s*(?:(<[^<>\s]*>|"(?:[^"\\]|\\.)*"(?:\^\^\S+|@[\w-]+)?|\?\w+|-?\d+(?:\.\d+)?(?![\w:])|[A-Za-z_][\w.-]*:[\w.-]*\w|:[\w-]+|[A-Za-z_]\w*:?|&&|\|\||!=|<=|>=|[{}().;,=<>!*])|(#[^\n]*))')
_KEYWORDS = {"SELECT", "DISTINCT", "WHERE", "OPTIONAL", "UNION", "FILTER", "ORDER", "BY", "ASC", "DESC", "LIMIT", "OFFSET", "ASK", "PREFIX", "COUNT", "AS", "INSERT", "DELETE", "DATA"}


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at : at + 20]!r}")
        if m[1]:
            out.append(m[1].upper() if m[1].upper() in _KEYWORDS else m[1])
        at = m.end()
    return out


class _Reader:
    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    @property
    def now(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        token = self.now
        if not token or (wanted and token not in wanted):
            raise ValueError(f"expected {' or '.join(wanted) or 'more'}, found {token or 'the end'}")
        self.at += 1
        return token

    def has(self, token: str) -> bool:
        if self.now == token:
            self.at += 1
            return True
        return False

    # --- patterns: ("bgp", triples), ("optional", group), ("union", groups), ("filter", expression)

    def group(self) -> list[tuple]:
        self.take("{")
        out: list[tuple] = []
        while not self.has("}"):
            if self.has("OPTIONAL"):
                out.append(("optional", self.group()))
            elif self.has("FILTER"):
                out.append(("filter", self.either()))
            elif self.now == "{":
                parts = [self.group()]
                while self.has("UNION"):
                    parts.append(self.group())
                out.append(("union", parts))
            elif not self.has("."):
                out.append(("bgp", self.statements()))
        return out

    def statements(self) -> list[tuple[str, str, str]]:
        out, s = [], self.take()
        while True:
            p = self.take()
            p = triples.TYPE if p == "a" else p
            out.append((s, p, self.take()))
            while self.has(","):
                out.append((s, p, self.take()))
            if not self.has(";") or self.now in (".", "}"):
                return out

    # --- filters

    def either(self):
        out = self.both()
        while self.has("||"):
            out = ("or", out, self.both())
        return out

    def both(self):
        out = self.one()
        while self.has("&&"):
            out = ("and", out, self.one())
        return out

    def one(self):
        if self.has("!"):
            return ("not", self.one())
        left = self.value()
        if self.now in ("=", "!=", "<", "<=", ">", ">="):
            return (self.take(), left, self.value())
        return left

    def value(self):
        if self.has("("):
            inside = self.either()
            self.take(")")
            return inside
        token = self.take()
        if self.now == "(" and not token.startswith(("?", '"', "<")):
            self.take("(")
            given = [self.either()]
            while self.has(","):
                given.append(self.either())
            self.take(")")
            return ("call", token.lower(), *given)
        return ("term", token)


def _plain(c: Column) -> Column:
    """A literal's text, or the term itself."""
    return F.when(c.startswith('"'), F.regexp_extract(c, r'^"((?:[^"\\]|\\.)*)"', 1)).otherwise(c)


def _text(node) -> str:
    return node[1].strip('"')


def _column(node, names: list[str]) -> Column:
    kind = node[0]
    if kind == "term":
        token = node[1]
        if token.startswith("?"):
            return F.col(token[1:]) if token[1:] in names else F.lit(None).cast("string")
        return F.lit(token)
    if kind == "and":
        return _column(node[1], names) & _column(node[2], names)
    if kind == "or":
        return _column(node[1], names) | _column(node[2], names)
    if kind == "not":
        return ~_column(node[1], names)
    if kind == "call":
        name, first = node[1], _column(node[2], names)
        if name == "bound":
            return first.isNotNull()
        if name in ("isiri", "isuri"):
            return ~first.startswith('"')
        if name == "isliteral":
            return first.startswith('"')
        if name == "str":
            return _plain(first)
        if name in ("lcase", "ucase"):
            return {"lcase": F.lower, "ucase": F.upper}[name](_plain(first))
        if name == "strlen":
            return F.length(_plain(first))
        if name == "regex":
            return _plain(first).rlike(("(?i)" if len(node) > 4 and "i" in _text(node[4]) else "") + _text(node[3]))
        if name in ("contains", "strstarts", "strends"):
            return {"contains": Column.contains, "strstarts": Column.startswith, "strends": Column.endswith}[name](_plain(first), _text(node[3]))
        raise ValueError(f"unknown function {name}")
    left, right = node[1], node[2]
    a, b = _column(left, names), _column(right, names)
    number = lambda n: (n[0] == "term" and re.fullmatch(r"-?\d+(\.\d+)?", n[1])) or n[:2] == ("call", "strlen")
    if number(left) or number(right):
        a, b = (_plain(c.cast("string")).try_cast("double") for c in (a, b))
    elif kind not in ("=", "!=") or "call" in (left[0], right[0]):
        a, b = _plain(a), _plain(b)
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[kind]


def _solve(t: DataFrame, group: list[tuple]) -> DataFrame:
    patterns = [x for kind, body in group if kind == "bgp" for x in body]
    out = triples.bgp(t, patterns) if patterns else None

    def joined(left: DataFrame | None, right: DataFrame, how: str) -> DataFrame:
        if left is None:
            return right
        shared = [c for c in right.columns if c in left.columns]
        if not shared:
            raise ValueError("a group shares no variable with the others")
        return left.join(right, shared, how)

    for kind, body in group:
        if kind == "union":
            some = None
            for part in body:
                own = _solve(t, part)
                some = own if some is None else some.unionByName(own, allowMissingColumns=True)
            out = joined(out, some, "inner")
    for kind, body in group:
        if kind == "optional":
            out = joined(out, _solve(t, body), "left")
    for kind, body in group:
        if kind == "filter":
            out = out.filter(_column(body, out.columns))
    return out


def query(t: DataFrame, text: str) -> DataFrame:
    """The rows of a SELECT, a column for each variable, or of an ASK, ``answer``."""
    r = _Reader(text)
    while r.has("PREFIX"):
        r.take(), r.take()
    if r.has("ASK"):
        r.has("WHERE")
        return _solve(t, r.group()).limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
    r.take("SELECT")
    distinct, wanted, count = r.has("DISTINCT"), [], None
    while r.now not in ("WHERE", "{"):
        if r.has("("):
            r.take("COUNT")
            r.take("(")
            own = r.has("DISTINCT")
            what = r.take()
            r.take(")")
            r.take("AS")
            count = (own, what, r.take()[1:])
            r.take(")")
        else:
            wanted.append(r.take())
    r.has("WHERE")
    out = _solve(t, r.group())
    if count:
        own, what, name = count
        value = F.lit(1) if what == "*" else F.col(what[1:])
        out = (out.groupBy(*[w[1:] for w in wanted]) if wanted else out.groupBy()).agg((F.count_distinct(value) if own else F.count(value)).alias(name))
    elif wanted != ["*"]:
        order = _order(_Reader(text))
        out = out.select(*dict.fromkeys([w[1:] for w in wanted] + ([] if distinct else [n for n, _ in order])))
    out = out.distinct() if distinct else out
    if r.has("ORDER"):
        r.take("BY")
        keys = []
        while r.now in ("ASC", "DESC", "(") or r.now.startswith("?"):
            down = r.take() if r.now in ("ASC", "DESC") else "ASC"
            r.has("(")
            c = _plain(F.col(r.take()[1:]))
            r.has(")")
            numeric = c.try_cast("double")
            keys += [k.desc_nulls_last() if down == "DESC" else k.asc_nulls_first() for k in (numeric, c)]
        out = out.orderBy(*keys)
    limit = offset = None
    while r.now in ("LIMIT", "OFFSET"):
        if r.take() == "LIMIT":
            limit = int(r.take())
        else:
            offset = int(r.take())
    out = out.offset(offset) if offset else out
    out = out.limit(limit) if limit is not None else out
    return out if count or wanted == ["*"] else out.select(*[w[1:] for w in wanted])


def _order(r: _Reader) -> list[tuple[str, str]]:
    """Variables of the ORDER BY, which a projection must keep until rows are sorted."""
    if "ORDER" not in r.tokens:
        return []
    rest = r.tokens[r.tokens.index("ORDER") :]
    return [(x[1:], "") for x in rest if x.startswith("?")]


def update(t: DataFrame, text: str) -> DataFrame:
    """The triples after INSERT DATA, DELETE DATA or DELETE WHERE."""
    r = _Reader(text)
    while r.has("PREFIX"):
        r.take(), r.take()
    kind = r.take("INSERT", "DELETE")
    data = r.has("DATA")
    if not data:
        r.take("WHERE")
    rows = [x for k, body in r.group() if k == "bgp" for x in body]
    if data:
        given = t.sparkSession.createDataFrame(rows, "s string, p string, o string")
        return triples.merge(t.select("s", "p", "o"), given) if kind == "INSERT" else triples.difference(t.select("s", "p", "o"), given)
    found = triples.bgp(t, rows)
    out = t.select("s", "p", "o")
    for row in rows:
        gone = found.select(*[(F.col(x[1:]) if x.startswith("?") else F.lit(x)).alias(c) for x, c in zip(row, "spo")])
        out = triples.difference(out, gone)
    return out
