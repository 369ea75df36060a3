import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kvasir.llm import huffman, op1_token_output, op2_packing
from kvasir.llm.tokens import WordEncoder

FILES = {"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}
PATHS = {k: public_tokenizers.path(f) for k, f in FILES.items()}
ENCODERS = {k: WordEncoder(open(p, encoding="utf-8").read(), k) for k, p in PATHS.items()}
REAL = {k: Tokenizer.from_file(p) for k, p in PATHS.items()}


def ids_of(kind, text):
    return REAL[kind].encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t.,'aAbé1ß<|>endoftx_-#\r \x1c ")), st.characters(codec="utf-8")), max_size=40))
def test_words_equal_the_library(text):
    for kind, enc in ENCODERS.items():
        assert np.frombuffer(enc.encode([text])[0], enc.dtype).tolist() == ids_of(kind, text)[:-1]


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|endoftext|> b", "<|startoftext|>x", "don't  'S", " \n x", "a\n\nb", "a.\n\n"])
def test_special_strings(text):
    for kind, enc in ENCODERS.items():
        assert np.frombuffer(enc.encode([text])[0], enc.dtype).tolist() == ids_of(kind, text)[:-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=0, max_size=400), st.integers(6, 12))
def test_huffman_round_trip(ids, limit):
    ids = np.array(ids, np.uint32) ** 2 % 64
    lengths = huffman.code_lengths(np.bincount(ids, minlength=64), limit)
    assert lengths.max(initial=0) <= limit
    if len(set(ids.tolist())) > 1:
        assert sum(2.0 ** -int(n) for n in lengths if n) == 1
    stream, marks = huffman.encode(ids, huffman.canonical(lengths), lengths, 16)
    assert (huffman.decode(stream, marks, len(ids), 16, huffman.decode_table(lengths)) == ids).all()


def test_huffman_is_optimal_where_the_limit_allows():
    import heapq

    counts = np.array([50, 30, 10, 5, 3, 1, 1])
    heap, total = [int(c) for c in counts], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        total += (s := heapq.heappop(heap) + heapq.heappop(heap))
        heapq.heappush(heap, s)
    assert (huffman.code_lengths(counts, 10) * counts).sum() == total
    assert huffman.code_lengths(counts, 3).max() == 3


def test_crc_of_parts():
    a, b = b"abc" * 9, b"xyz" * 4321
    assert op1_token_output.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert op1_token_output.crc32_joined(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


@pytest.mark.parametrize("block", [1 << 18, 64])
def test_output(spark, odd, block, monkeypatch, tmp_path):
    rows, df, folder = odd
    monkeypatch.setattr(op1_token_output, "BLOCK_IDS", block)
    out = str(tmp_path / "ids")
    op1_token_output.encode_corpus(df, PATHS["byte"], out)
    got = sorted((tuple(r) for r in op1_token_output.documents_of(spark, out).collect()), key=lambda r: r[1])
    docs = sorted(((d is not None, d or 0, ids_of("byte", t)) for d, t, *_ in rows), key=lambda x: x[:2])
    assert [(r[0] is not None, r[0] or 0) for r in got] == [x[:2] for x in docs]
    assert got[0][1] == 0 and all(b[1] == a[1] + a[2] for a, b in zip(got, got[1:]))
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((d, len(ids_of("byte", t)), crc(ids_of("byte", t))) for d, t, *_ in rows)


def test_output_of_nothing(spark, empty):
    assert op1_token_output.op1_token_output(spark, empty).collect() == []


def check_packing(got, want):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins)


def test_packing(spark, odd):
    rows, _, folder = odd
    want = []
    for d, t, *_ in rows:
        ids = ids_of("word", t)
        want += [(d, k, at, len(ids[at : at + 2048]), crc(ids[at : at + 2048])) for k, at in enumerate(range(0, len(ids), 2048))]
    n = check_packing(op2_packing.op2_packing(spark, folder).collect(), want)
    assert n <= math.ceil(sum(x[3] for x in want) / 2048) + 1


def test_packing_of_nothing(spark, empty):
    assert op2_packing.op2_packing(spark, empty).collect() == []


def triplets(rng, n, capacity=1000):
    """Sizes that fill ``n`` bins to the brim, three to a bin: best fit decreasing cannot find that."""
    out = []
    for _ in range(n):
        a = int(rng.integers(380, 490))
        b = int(rng.integers(250, (capacity - a) // 2 + 1))
        out += [a, b, capacity - a - b]
    return out


def test_genetic_packing_keeps_every_item_and_beats_best_fit():
    for seed in range(3):
        rng = np.random.default_rng(seed)
        sizes = triplets(rng, 40)
        first = op2_packing.first_population(sizes, rng, 1000)
        start = len(first[0].bins)
        best = op2_packing.evolve(sizes, first, 200, rng, 1000)[0]
        assert sorted(i for b in best.bins for i in b) == list(range(len(sizes))) and max(best.fill) <= 1000
        assert 40 <= len(best.bins) <= start - 2


def test_crossover_injects_whole_bins_and_finds_the_better_packing():
    """Best fit decreasing needs three bins; a parent that holds one well-filled bin passes it on, and two are enough."""
    sizes = [4, 4, 3, 3, 3, 3]  # two bins of 4+3+3 fill a capacity of 10
    best_fit = op2_packing.Packing(sizes, 10).insert(list(range(6)))
    giver = op2_packing.Packing(sizes, 10, [[0, 2, 3], [1, 4], [5]])
    assert len(best_fit.bins) == 3
    child = op2_packing.crossover(best_fit, giver, np.random.default_rng(0))
    assert [0, 2, 3] in [sorted(b) for b in child.bins] and len(child.bins) == 2
    assert sorted(i for b in child.bins for i in b) == list(range(6))


def test_packings_share_bins_and_stay_as_they_are():
    rng = np.random.default_rng(2)
    sizes = rng.integers(500, 1200, 300).tolist()
    a, b = op2_packing.first_population(sizes, rng, 2048)[:2]
    was = [(p.assignment(), list(p.fill), p.worth()) for p in (a, b)]
    child = op2_packing.mutate(op2_packing.crossover(a, b, rng), rng)
    assert [(p.assignment(), list(p.fill), p.worth()) for p in (a, b)] == was
    assert sorted(i for x in child.bins for i in x) == list(range(300)) and child.fill == [sum(sizes[i] for i in x) for x in child.bins]
    assert child.worth() == (len(child.bins), -sum(f * f for f in child.fill)) and {id(x) for x in child.bins} & {id(x) for x in a.bins}


def test_islands_beat_best_fit(spark):
    """Over Spark: a hard shard is searched, its bins are fewer than best fit decreasing's, and the report says so."""
    rng = np.random.default_rng(5)
    sizes = triplets(rng, 30)
    df = spark.createDataFrame(list(enumerate(sizes)), "uid long, length long")
    report = []
    got = op2_packing.pack(df, 1000, report=report).collect()
    assert len(got) == len(sizes) and len({r.sequence_id for r in got}) == report[-1]["bins"]
    assert report[-1]["searched"] == 1 and report[-1]["bound"] == 30 <= report[-1]["bins"] < report[-1]["best_fit"]
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, sizes[r.uid]))
    for own in fill.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1000


def test_packing_over_shards(spark):
    rng = np.random.default_rng(1)
    items = spark.createDataFrame([(i, int(x)) for i, x in enumerate(rng.integers(1, 2049, 600))], "uid long, length long").cache()
    got = op2_packing.pack(items, shard_size=64).join(items, "uid").collect()
    assert len(got) == 600
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048
