import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from kvasir.llm import bwt, op6_simhash, op7_line_dedup, op8_suffix_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text):
    w = WORDS.findall((text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s, 42) for s in [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(prints, d):
    """Smallest id of each row's component, by brute force."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= d:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_simhash(spark, odd):
    rows, _, folder = odd
    prints = [fingerprint(t) for _, t, *_ in rows]
    of = grouped(prints, 2)
    least = defaultdict(list)
    for k, (d, *_) in zip(of, rows):
        if d is not None:
            least[k].append(d)
    want = Counter((d, f"{p:016x}", min(least[k], default=None)) for (d, *_), p, k in zip(rows, prints, of))
    assert Counter(map(tuple, op6_simhash.op6_simhash(spark, folder).collect())) == want


def test_simhash_of_nothing(spark, empty):
    assert op6_simhash.op6_simhash(spark, empty).collect() == []


@pytest.mark.parametrize("d,bucket", [(2, 24), (2, 2), (4, 24), (4, 2), (6, 3)])
def test_links_connect_what_brute_force_connects(spark, d, bucket, monkeypatch):
    monkeypatch.setattr(op6_simhash, "TILE", 16)
    rng = random.Random(d)
    words = {rng.getrandbits(64) for _ in range(30)}
    for center in [rng.getrandbits(64) for _ in range(3)]:
        for _ in range(40):
            words.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    words = sorted(words)
    df = spark.createDataFrame([(op6_simhash._signed(w),) for w in words], "fp long")
    pairs = op6_simhash.links(df, len(words), d, bucket).collect()
    place = {op6_simhash._signed(w): i for i, w in enumerate(words)}
    root = list(range(len(words)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in pairs:
        assert (words[place[r.a]] ^ words[place[r.b]]).bit_count() <= d
        root[find(place[r.a])] = find(place[r.b])
    mine, brute = [find(i) for i in range(len(words))], grouped(words, d)
    assert len(set(zip(mine, brute))) == len(set(mine)) == len(set(brute))


def similar(a, b, k=5):
    sets = []
    for t in (a, b):
        w = (t or "").translate(LOWER).split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    both = len(sets[0] & sets[1])
    return both >= 0.8 * (len(sets[0]) + len(sets[1]) - both)


def test_one_of_each_group_stays(spark, odd):
    rows, df, _ = odd
    kept = op6_simhash.keep_one(df).collect()
    left = [(r.doc_id, r.text) for r in kept]
    texts = [t or "" for _, t in left if (t or "").split()]
    assert len(set(texts)) == len(texts)  # no copies
    assert set(op6_simhash.keep_one(df).columns) == set(df.columns)
    ids = {d for d, _ in left}
    assert {20} <= ids and not ids & {21, 22, 23, 42}
    for d, t, *_ in rows:
        if t and len(t.split()) > 4 and (d, t) not in left:
            assert any(similar(t, u) for _, u in left)


def left_by_brute_force(rows, k=5):
    """The smallest id of each group that pairs of Jaccard similarity 0.8 or more connect."""
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {rows[find(i)][0] for i in range(len(rows))}


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.getrandbits(32)}"
    return " ".join(out)


def test_pairs_of_all_similarities(spark):
    """Copies from 0.75 upward, which fingerprints often tell apart by more than six bits."""
    rng = random.Random(5)
    rows = []
    for i in range(120):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, edited(rng, words, max(1, round(len(words) * rng.uniform(0.005, 0.03)))))]
    got = op6_simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id for r in got} == left_by_brute_force(rows) and len(got) == len({r.doc_id for r in got})


@pytest.mark.parametrize("tile", [400_000, 8_000])
def test_large_group_of_edited_copies(spark, tile, monkeypatch):
    """A group beyond a bucket, which members connect that are not similar to its first."""
    monkeypatch.setattr(op6_simhash, "TILE_SHINGLES", tile)
    rng = random.Random(9)
    words = [f"w{rng.randrange(3000)}" for _ in range(300)]
    rows = [(i, edited(rng, words, rng.randint(4, 6))) for i in range(120)]
    rows += [(500 + i, " ".join(rng.choices(words, k=50))) for i in range(10)]
    got = op6_simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id for r in got} == left_by_brute_force(rows) and len(got) < 125


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def test_lines(spark, odd):
    rows, df, folder = odd
    docs = defaultdict(set)
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(line_key(line)) >= 40:
                docs[line_key(line)].add(-(10**9) if d is None else d)
    want = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        own = -(10**9) if d is None else d
        kept = [x for x in lines if not (len(docs.get(line_key(x), ())) >= 5 and own != max(docs[line_key(x)]))]
        want.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert any(w[2] for w in want)
    assert Counter(map(tuple, op7_line_dedup.op7_line_dedup(spark, folder).collect())) == Counter(want)
    texts = Counter(hashlib.sha256((r.text or "").encode()).hexdigest() for r in op7_line_dedup.dedup_lines(df).collect())
    assert texts == Counter(w[3] for w in want)


def test_lines_over_many_batches(spark):
    """A line of thousands of documents, over batches and partitions."""
    rng = random.Random(0)
    hot = "h" * 50
    rows = [(i, "\n".join([hot, f"{rng.randint(0, 900):050d}"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r.doc_id: r.text for r in op7_line_dedup.dedup_lines(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    docs = defaultdict(set)
    for d, t in rows:
        for line in t.split("\n"):
            docs[line].add(d)
    assert got == {d: "\n".join(x for x in t.split("\n") if len(docs[x]) < 5 or d == max(docs[x])) for d, t in rows}


def test_lines_of_nothing(spark, empty):
    assert op7_line_dedup.op7_line_dedup(spark, empty).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=12).map(str.encode), min_size=1, max_size=6), st.integers(1, 5))
def test_transform_and_prefixes(texts, width):
    symbols, shared, _ = bwt.build(np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1, np.array([len(t) for t in texts]), width)
    suffixes = sorted(((t[i:] + b"\0", k, i) for k, t in enumerate(texts) for i in range(len(t) + 1)))
    assert symbols.tolist() == [texts[k][i - 1] + 1 if i else 0 for _, k, i in suffixes]

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) - 1 and a[n] == b[n] and a[n]:
            n += 1
        return min(n, width)

    assert shared.tolist()[1:-1] == [common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:])]
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    assert [x.tolist() for x in bwt.repeated_starts(texts, width)] == [[i for i in range(len(t) - width + 1) if count[t[i : i + width]] > 1] for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([2, 4, 8, 16]))
def test_words_as_symbols(seed, width):
    """Parts cut around one anchor: words of several bytes find the same strings as bytes do."""
    rng = random.Random(seed)
    base = [rng.choice(b"ab") for _ in range(60)]
    texts, places = [], []
    for _ in range(8):
        t = list(base)
        t[rng.choice([*range(20), *range(40, 60)])] = rng.choice(b"abc")
        a, b = rng.randint(0, 20), rng.randint(40, 60)
        texts.append(bytes(t[a:b]))
        places.append(20 - a)
    at = {}
    for t, p in zip(texts, places):
        for i in range(len(t) - width + 1):
            at.setdefault((i - p, t[i : i + width]), []).append(1)
    want = [[i for i in range(len(t) - width + 1) if len(at[(i - p, t[i : i + width])]) > 1] for t, p in zip(texts, places)]
    got = [x.tolist() for x in bwt.repeated_starts(texts, width, places)]
    assert all(set(w) <= set(g) for w, g in zip(want, got))
    by_bytes = [x.tolist() for x in bwt.repeated_starts(texts, width)]
    assert all(set(g) <= set(b) for g, b in zip(got, by_bytes))


def removed(rows, width=200):
    raws = [(t or "").encode() for _, t, *_ in rows]
    count = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for (d, *_), r in zip(rows, raws):
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - width + 1):
            if count[r[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(r) else 0
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((d, len(r), int(gone[: len(r)].sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_repeats(spark, odd):
    rows, df, folder = odd
    got = Counter(map(tuple, op8_suffix_dedup.op8_suffix_dedup(spark, folder).collect()))
    assert got == removed(rows) and any(k[2] for k in got)
    assert op8_suffix_dedup.remove_repeats(df).columns == df.columns


def test_repeats_of_nothing(spark, empty):
    assert op8_suffix_dedup.op8_suffix_dedup(spark, empty).collect() == []


@pytest.mark.parametrize("group", [20_000, 3, 1])
def test_repeats_of_large_groups(spark, group):
    """Groups beyond a shard are split by the bytes beside the anchor, then dealt out."""
    rng = random.Random(6)
    base = "".join(rng.choices("abcdefgh ", k=500))
    rows = []
    for i in range(14):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = "Z"
        rows.append((i, "".join(rng.choices("xyz", k=rng.randint(0, 60))) + "".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = op8_suffix_dedup.repeated_spans(df, 60, 16, group).collect()
    by_doc = defaultdict(list)
    for r in spans:
        by_doc[r.doc].append(r.asDict())
    got = Counter()
    for d, t in rows:
        kept, n = op8_suffix_dedup.cut(t.encode(), by_doc[d], 60)
        got[(d, len(t), len(t) - len(kept), n, hashlib.sha256(kept).hexdigest())] += 1
    assert got == removed(rows, 60)


def test_shards_give_memory_back(monkeypatch):
    import pandas as pd

    from kvasir.llm import op8_suffix_dedup as op8

    calls = []
    monkeypatch.setattr(op8, "give_back", lambda: calls.append(1))
    row = {"anchor": 1, "n": 1, "place": 0, "doc": 1, "tag": 1, "start": 0}
    found = op8._shard_spans(4)(pd.DataFrame([{**row, "content": 1, "raw": b"abcde"}, {**row, "content": 2, "raw": b"abcdf", "doc": 2}]))
    assert calls == [1] and found.values.tolist() == [[1, 1, 0, 1], [2, 1, 0, 1]]
