import random
from itertools import combinations

import pytest
from kvasir.operators import corpus, iterate, networks, triples


def frames(spark, n, pairs):
    return spark.createDataFrame([(i,) for i in range(n)], "node long"), spark.createDataFrame(pairs, "src long, dst long")


STAR, TRIANGLE, PATH = (4, [(0, 1), (0, 2), (0, 3)]), (3, [(0, 1), (1, 2), (2, 0)]), (5, [(0, 1), (1, 2), (2, 3), (3, 4)])


def one(df):
    return df.first()[0]


def test_small_graphs(spark):
    for (n, e), density, bipartite, diameter in ((STAR, 0.5, True, 2), (TRIANGLE, 1.0, False, 1), (PATH, 0.4, True, 4)):
        nodes, pairs = frames(spark, n, e)
        assert networks.density(nodes, pairs).first()["density"] == density
        assert one(networks.is_bipartite(nodes, pairs)) is bipartite
        assert one(networks.diameter(nodes, pairs)) == diameter
        assert one(networks.erdos_gallai(nodes, pairs)) is True
    nodes, pairs = frames(spark, *PATH)
    assert {r.node: r.betweenness for r in networks.betweenness(nodes, pairs).collect()} == {0: 0, 1: 3, 2: 4, 3: 3, 4: 0}
    assert {r.node: r.closeness for r in networks.closeness(nodes, pairs).collect()}[2] == round(4 / 6, 9)


def brute(n, e):
    dist = [[0 if i == j else 10**6 for j in range(n)] for i in range(n)]
    for a, b in e:
        dist[a][b] = dist[b][a] = 1 if a != b else 0
    for k in range(n):
        for i in range(n):
            for j in range(n):
                dist[i][j] = min(dist[i][j], dist[i][k] + dist[k][j])
    return dist


def test_random_graph(spark):
    random.seed(3)
    n, e = 24, random.sample(list(combinations(range(24), 2)), 26)
    nodes, pairs = frames(spark, n, e)
    dist = brute(n, e)
    got = {(r.source, r.node): r.depth for r in iterate.bfs(pairs.union(pairs.select("dst", "src")), nodes).collect()}
    assert got == {(i, j): dist[i][j] for i in range(n) for j in range(n) if dist[i][j] < 10**6}
    comp = {r.node: r.component for r in iterate.components(nodes, pairs).collect()}
    assert comp == {i: min(j for j in range(n) if dist[i][j] < 10**6) for i in range(n)}
    weights = [(a, b, random.randint(1, 9)) for a, b in e]
    forest = iterate.spanning_forest(spark.createDataFrame(weights, "src long, dst long, weight long")).collect()
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    total = 0
    for a, b, w in sorted(weights, key=lambda t: t[2]):
        if find(a) != find(b):
            root[find(a)] = find(b)
            total += w
    assert sum(r.weight for r in forest) == total and len(forest) == n - len(set(comp.values()))


def test_empty_graph(spark):
    nodes, pairs = frames(spark, 0, [])
    assert iterate.components(nodes, pairs).count() == 0
    assert networks.degrees(nodes, pairs).count() == 0
    assert networks.density(nodes, pairs).first()["density"] == 0.0


def test_set_operations(spark):
    a = spark.createDataFrame([(1, 2, 5), (2, 3, 6)], "src long, dst long, weight long")
    b = spark.createDataFrame([(2, 3, 7), (3, 4, 8)], "src long, dst long, weight long")
    got = {k: sorted(map(tuple, networks.set_operation(a, b, k).collect())) for k in ("union", "intersect", "difference", "symdiff", "impose", "imprint")}
    assert got == {"union": [(1, 2, 5), (2, 3, 6), (3, 4, 8)], "intersect": [(2, 3, 6)], "difference": [(1, 2, 5)], "symdiff": [(1, 2, 5), (3, 4, 8)],
                   "impose": [(1, 2, 5), (2, 3, 7), (3, 4, 8)], "imprint": [(1, 2, 5), (2, 3, 7)]}


def test_all_paths(spark):
    _, pairs = frames(spark, 4, [(0, 1), (1, 3), (0, 2), (2, 3), (1, 2)])
    got = sorted(tuple(r.path) for r in networks.all_paths(pairs, 0, 3, 3).collect())
    assert got == [(0, 1, 2, 3), (0, 1, 3), (0, 2, 3)]


KG = [("door1", "rdf:type", "Door"), ("Door", "rdfs:subClassOf", "Element"), ("Element", "rdfs:subClassOf", "Thing"), ("Thing", "rdfs:subClassOf", "Element"),
      ("leadsTo", "rdfs:subPropertyOf", "touches"), ("touches", "rdfs:domain", "Thing"), ("touches", "rdfs:range", "Space"), ("door1", "leadsTo", "room1"), ("door1", "touches", '"text"')]


def naive(facts):
    t, s, sp, d, r = "rdf:type", "rdfs:subClassOf", "rdfs:subPropertyOf", "rdfs:domain", "rdfs:range"
    facts = set(facts)
    while True:
        new = set()
        for a in facts:
            for b in facts:
                if a[1] == s == b[1] and a[2] == b[0] and a[0] != b[2]:
                    new.add((a[0], s, b[2]))
                if a[1] == sp == b[1] and a[2] == b[0] and a[0] != b[2]:
                    new.add((a[0], sp, b[2]))
                if a[1] == t and b[1] == s and a[2] == b[0]:
                    new.add((a[0], t, b[2]))
                if b[0] == a[1] and b[1] == sp:
                    new.add((a[0], b[2], a[2]))
                if b[0] == a[1] and b[1] == d:
                    new.add((a[0], t, b[2]))
                if b[0] == a[1] and b[1] == r and not a[2].startswith('"'):
                    new.add((a[2], t, b[2]))
        if new <= facts:
            return facts
        facts |= new


def test_rdfs(spark):
    t = spark.createDataFrame(KG, "s string, p string, o string")
    closed = triples.rdfs_closure(t)
    assert set(map(tuple, closed.collect())) == naive(KG)
    assert triples.rdfs_closure(closed).count() == closed.count()
    assert tuple(triples.superclass_path(t, "Door", "Thing").first()) == ("Door > Element > Thing", 2)
    assert triples.superclass_path(t, "Thing", "Door").count() == 0
    assert one(triples.ask(t, [("?x", "rdf:type", "Door"), ("?x", "leadsTo", "?y")])) is True
    assert one(triples.ask(t, [("?x", "rdf:type", "Window")])) is False


def test_store(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "graph_id string, n int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "graph_id string, n int")
    assert sorted(map(tuple, corpus.upsert(old, new).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, corpus.delete(old, new).collect())) == [("a", 1)]
    dup = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id int")
    assert sorted(map(tuple, corpus.duplicates(dup, "id").collect()), key=str) == [(1, 2), (None, 1)]


@pytest.mark.parametrize("label,want", [("Room", 2), ("none", 0)])
def test_max_neighbors(spark, label, want):
    v = spark.createDataFrame([(1, "Room"), (2, "Room"), (3, "Door")], "vid long, label string")
    e = spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "src long, dst long")
    assert one(corpus.max_neighbors(v, e, label)) == want
