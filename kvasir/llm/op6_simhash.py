"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then Hamming verification.

A fingerprint is cut into ``m`` blocks; two that differ in at most ``d`` bits agree in at least ``m - d``
blocks, so every choice of ``m - d`` blocks is a join key and each close pair meets under one of them.
``m`` grows with the number of distinct fingerprints, so that a key's bits exceed its logarithm; the
result is the same for any ``m``.  Copies collapse to one fingerprint before anything is joined.

A key held by more than ``BUCKET`` fingerprints emits no pairs.  Its members meet exactly in another
way.  For ``d = 2``: two words at distance 2 or less share a word within one flip of both, so each member
is dealt to the words within one flip of the bits outside the key, and whoever meets there is linked; at
most ``1 + 64`` members can meet at one word, so the work is linear in the bucket.  For larger ``d``: the
bucket is dealt to tiles of ``TILE`` members, a task compares two tiles and emits a spanning forest.

Defined results: a null or empty text has no word and the fingerprint zero, linked like any other; a
text of fewer words than a shingle is one shingle; repeated rows keep a row each; a null doc_id takes no
part in a component's smallest doc_id (null only if all its ids are); an empty table gives no rows;
other columns are ignored.

``keep_one``, the pipeline's stage, verifies proposals by the texts, and finds the pairs that fingerprints miss.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvasir.llm.common import components, drop, scratch, sliced, stage, table

SHINGLE = 3
DISTANCE = 2
BUCKET = 24
TILE = 8192
#: ``keep_one``: shingles of a tile; texts that tell the common ones, and how many of these. The cost depends on them, not the result.
TILE_SHINGLES = 400_000
SAMPLE_ROWS = 10_000
COMMON = 200_000


def _shingle_hashes(text: str | None, k: int) -> list[int]:
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return []
    if len(words) < k:
        return [xxh64_intdigest(b" ".join(words), 42)]
    return [xxh64_intdigest(s, 42) for s in map(b" ".join, zip(*(words[i:] for i in range(k))))]


def simhash(rows: list[list[int]]) -> np.ndarray:
    """Unsigned 64-bit SimHash of each row of hashes; a bit is set if over half of them have it."""
    out = np.zeros(len(rows), np.uint64)
    at = 0
    while at < len(rows):
        end, size = at, 0
        while end < len(rows) and (size < 200_000 or end == at):
            size += len(rows[end])
            end += 1
        n = np.array([len(r) for r in rows[at:end]], np.int64)
        some = np.flatnonzero(n)
        if len(some):
            held = np.concatenate([np.array(r, "<u8") for r in rows[at:end]])
            starts = np.concatenate([[0], np.cumsum(n[some])])
            ones = np.zeros((len(some), 64), np.int64)
            # a long row's hashes are unpacked a stretch at a time
            for lo in range(0, len(held), 1 << 18):
                bits = np.unpackbits(held[lo : lo + (1 << 18)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                a, b = np.searchsorted(starts, [lo, lo + len(bits) - 1], side="right") - 1
                own = np.maximum(starts[a : b + 1] - lo, 0)
                ones[a : b + 1] += np.add.reduceat(bits, own, axis=0, dtype=np.int64)
            major = 2 * ones > n[some][:, None]
            out[at + some] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
        at = end
    return out


def fingerprints_of(texts: list[str | None], k: int = SHINGLE) -> np.ndarray:
    return simhash([_shingle_hashes(t, k) for t in texts])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (signed 64 bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints_of(part.column(1).to_pylist(), k).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def _masks(m: int, d: int) -> list[int]:
    """The bits of every choice of m - d out of m even blocks."""
    cuts = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [reduce(int.__or__, c, 0) for c in combinations(blocks, m - d)]


def forest(words: np.ndarray, d: int) -> list[tuple[int, int]]:
    """Edges, one fewer than words in each component, that connect what distances of ``d`` or less connect."""
    left, out = np.arange(len(words)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(words[left] ^ words[i]) <= d
            out.extend((int(i), int(j)) for j in left[near])
            queue.extend(left[near])
            left = left[~near]
    return out


def _met_by_flips(many: DataFrame) -> DataFrame:
    flips = [0, *(_signed(1 << i) for i in range(64))]
    return (
        many.select("fp", "mask", F.explode(F.array(*[F.lit(x) for x in flips])).alias("flip"))
        .filter(F.col("flip").bitwiseAND(F.col("mask")) == 0)
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("place"))
        .groupBy("place").agg(F.collect_set("fp").alias("at")).filter(F.size("at") > 1)  # 1 + 64 at most
        .select(F.array_min("at").alias("a"), F.explode("at").alias("b")).filter("a < b")
    )


def _met_in_tiles(many: DataFrame, d: int) -> DataFrame:
    own = many.withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")).withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    dealt = own.select("mask", "key", "fp", "t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("u"))
    pairs = dealt.groupBy("mask", "key", F.least("t", "u").alias("t"), F.greatest("t", "u").alias("u")).agg(F.collect_set("fp").alias("at"))  # about two tiles

    def run(batches):
        for batch in batches:
            for at in batch.column(0):
                words = np.sort(np.array(at.as_py(), np.int64))
                found = np.array(forest(words.view(np.uint64), d), np.int64).reshape(-1, 2)
                ends = words[found]
                yield pa.RecordBatch.from_arrays([pa.array(ends.min(1)), pa.array(ends.max(1))], ["a", "b"])

    return pairs.select("at").mapInArrow(run, "a long, b long")


def links(words: DataFrame, n: int, d: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of the distinct ``fp`` words (``n`` of them) that connect all at distance ``d`` or less.

    Every pair that a small bucket holds comes out; of a large one, pairs that connect the same words.
    """
    m = next(m for m in range(d + 1, 65) if 64 * (m - d) // m >= min(math.log2(max(n, 2)) + (3 if d <= 2 else 0), 48))
    masks = [_signed(x) for x in _masks(m, d)]
    keys = words.select("fp", F.explode(F.array(*[F.lit(x) for x in masks])).alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sizes = keys.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keyed = stage(keys.join(stage(sizes, "op6-sizes"), ["mask", "key"]), "op6-keys")
    few, many = keyed.filter(F.col("n") <= bucket), keyed.filter(F.col("n") > bucket)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= d
    pairs = (
        few.select("mask", "key", F.col("fp").alias("a")).join(few.select("mask", "key", F.col("fp").alias("b")), ["mask", "key"])
        .filter((F.col("a") < F.col("b")) & near).select("a", "b")
    )
    return pairs.unionByName(_met_by_flips(many) if d == 2 else _met_in_tiles(many, d))


def cluster(prints: DataFrame, d: int = DISTANCE) -> DataFrame:
    """Adds ``component_id``, the smallest doc_id reachable, to staged ``doc_id, fp`` rows."""
    words = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "op6-words")
    roots = components(links(words.select("fp"), words.count(), d))
    named = words.join(roots, words.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = stage(named.join(lowest, "root").select("fp", "component_id"), "op6-components")
    return prints.join(of, "fp")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, d: int = DISTANCE) -> DataFrame:
    """``doc_id, fp, component_id`` of every row."""
    return cluster(stage(fingerprints(docs, k), "op6-fp"), d)


def _shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """``uid, set`` of ``uid, text``: the distinct hashes of a text's shingles."""

    def run(batches):
        for part in sliced(batches, 1):
            sets = [np.unique(np.array(_shingle_hashes(t, k), np.uint64)).view(np.int64) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["uid", "set"])

    return texts.mapInArrow(run, "uid long, set array<long>")


def _common(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``COMMON`` hashes, ascending, of shingles that three or more sampled texts hold, and their counts."""
    share = SAMPLE_ROWS / max(texts.count(), 1)
    some = texts if share >= 1 else texts.sample(share, 7)
    held = _shingle_sets(some.select(F.monotonically_increasing_id().alias("uid"), "text"), k).select(F.explode("set").alias("token"))
    rows = held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 2").orderBy(F.desc("n")).limit(COMMON).toArrow()
    tokens, counts = (rows[c].to_numpy() for c in ("token", "n"))
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def set_bits(hashes: np.ndarray) -> bytes:
    """A bitmap of a set, a bit for each hash modulo its length, which is two to four times the set's size."""
    size = max(256, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else 256
    out = np.zeros(size, np.uint8)
    out[hashes.view(np.uint64) & np.uint64(size - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _folded(rows: np.ndarray, width: int) -> np.ndarray:
    while rows.shape[1] > width:
        rows = rows[:, : rows.shape[1] // 2] | rows[:, rows.shape[1] // 2 :]
    return rows


def may_link(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these bitmaps (rows of one width) and sizes can be similar: a bit that one alone has is a member that the other lacks."""
    wide = lambda x: np.bitwise_count(np.ascontiguousarray(x).view(np.uint64)).sum(1, dtype=np.int64)
    both = np.minimum(n_a - wide(a & ~b), n_b - wide(b & ~a))
    return both >= similarity / (1 + similarity) * (n_a + n_b) - 1e-6


def _pairs_may_link(batches, similarity: float):
    """The ``a, b`` of ``a, b, na, nb, xa, xb`` rows that can be similar."""
    for part in sliced(batches, 4):
        n_a, n_b = (part.column(k).to_numpy() for k in (2, 3))
        x, y = part.column(4).to_pylist(), part.column(5).to_pylist()
        size = np.array([(len(u), len(v)) for u, v in zip(x, y)], np.int64).reshape(-1, 2)
        keep = np.minimum(n_a, n_b) >= similarity * np.maximum(n_a, n_b) - 1e-9
        for w, v in np.unique(size[keep], axis=0).tolist():
            at = np.flatnonzero(keep & (size[:, 0] == w) & (size[:, 1] == v))
            rows = [np.frombuffer(b"".join([z[i] for i in at]), np.uint8).reshape(len(at), -1) for z in (x, y)]
            rows = [_folded(r, min(w, v)) for r in rows]
            keep[at] = may_link(*rows, n_a[at].astype(np.int64), n_b[at].astype(np.int64), similarity)
        at = pa.array(np.flatnonzero(keep))
        yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at)], ["a", "b"])


def candidate_forest(sizes: np.ndarray, bits: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """Pairs that can be similar, one fewer than members in each component, that connect what all such pairs connect."""
    order = np.argsort(sizes, kind="stable")
    n = sizes[order].astype(np.int64)
    raw = [bits[i] for i in order.tolist()]
    width = np.array([len(x) for x in raw])  # ascends with the size
    group, out = np.arange(len(n)), []
    upto = np.searchsorted(n, n / similarity + 1e-6, side="right")
    folded: dict[int, tuple[int, np.ndarray]] = {}
    for i in range(len(n) - 1):
        w, end = int(width[i]), int(upto[i])
        if end <= i + 1:
            continue
        if w not in folded:
            # rows of this width and, folded, those of twice the width: no larger set can be similar
            first, mid, last = np.searchsorted(width, [w, 2 * w, 4 * w])
            own = [np.frombuffer(b"".join(raw[first:mid]), np.uint8).reshape(-1, w)]
            if last > mid:
                own.append(_folded(np.frombuffer(b"".join(raw[mid:last]), np.uint8).reshape(-1, 2 * w), w))
            folded[w] = (int(first), np.concatenate(own))
        first, rows = folded[w]
        js = np.arange(i + 1, end)
        js = js[group[js] != group[i]]
        if not len(js):
            continue
        js = js[may_link(rows[i - first][None], rows[js - first], n[i], n[js], similarity)]
        for j in js.tolist():
            if group[j] != group[i]:
                out.append((int(order[i]), int(order[j])))
                group[group == group[j]] = group[i]
    return out


def _forests(similarity: float):
    """Over rows ``token, t, v, uid, n, bits`` sorted by the first three: ``a, b`` of each group's candidate forest."""

    def run(batches):
        held, key = [], None

        def settle():
            uid = np.array([r[3] for r in held], np.int64)
            found = candidate_forest(np.array([r[4] for r in held]), [r[5] for r in held], similarity) if len(held) > 1 else []
            ends = uid[np.array(found, np.int64).reshape(-1, 2)]
            return pa.RecordBatch.from_arrays([pa.array(ends.min(1)), pa.array(ends.max(1))], ["a", "b"])

        for part in sliced(batches, 5):
            for row in zip(*(c.to_pylist() for c in part.columns)):
                if row[:3] != key:
                    if len(held) > 1:
                        yield settle()
                    held, key = [], row[:3]
                held.append(row)
        if len(held) > 1:
            yield settle()

    return run


def _signatures(texts: DataFrame, k: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``uid, id, tag, h, n, fp, bits, prefix`` of ``id, tag, text``: a row's number, hash, size and bitmap of the text's shingle set, its fingerprint and first shingles.

    Sets of similarity s share at least ``ceil(s * n)`` shingles of either, so their first
    ``n - ceil(s * n) + 1`` in any one order have one in common.  The order is common shingles last.
    Stage it: ``uid`` numbers a task's rows.
    """
    tokens, counts = common

    def run(batches):
        from xxhash import xxh64_intdigest

        uid = TaskContext.get().partitionId() << 32
        for part in sliced(batches, 2):
            rows = [_shingle_hashes(t, k) for t in part.column(2).to_pylist()]
            hashes, sizes, bits, firsts = [], [], [], []
            for row in rows:
                own = np.unique(np.array(row, np.uint64)).view(np.int64)
                n = len(own)
                upto = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
                weight = np.zeros(n, np.int64)
                if len(tokens):
                    place = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                    weight = np.where(tokens[place] == own, counts[place], 0)
                hashes.append(_signed(xxh64_intdigest(own.tobytes(), 42)))
                sizes.append(n)
                bits.append(set_bits(own))
                firsts.append(own[np.lexsort((own, weight))[:upto]])
            columns = [pa.array(np.arange(uid, uid + len(rows))), part.column(0), part.column(1), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int32()),
                       pa.array(simhash(rows).view(np.int64)), pa.array(bits, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))]
            uid += len(rows)
            yield pa.RecordBatch.from_arrays(columns, ["uid", "id", "tag", "h", "n", "fp", "bits", "prefix"])

    return texts.select("id", "tag", "text").mapInArrow(run, "uid long, id long, tag long, h long, n int, fp long, bits binary, prefix array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``(a, b)`` whose shingle sets are similar."""
    x, y = sets.select(F.col("uid").alias("a"), F.col("set").alias("x")), sets.select(F.col("uid").alias("b"), F.col("set").alias("y"))
    least, most = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    both = F.size(F.array_intersect("x", "y"))
    alike = (least >= similarity * most - 1e-9) & (both >= similarity * (F.size("x") + F.size("y") - both))
    return stage(pairs.join(x, "a").join(y, "b").filter(alike).select("a", "b"), "op6-linked")


def connect(sets: list[np.ndarray], roots: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Similar pairs, one fewer than roots in each component, that connect what all similar pairs connect."""
    sizes = np.array([len(x) for x in sets], np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(ids, kind="stable")
    holders = owner[order]
    starts = np.searchsorted(ids[order], np.arange(ids.max() + 2))
    at = np.concatenate([[0], np.cumsum(sizes)])
    group, out = np.unique(roots, return_inverse=True)[1], []
    for i in range(len(sets)):
        if group.min() == group.max():
            break
        own = ids[at[i] : at[i + 1]]
        both = np.bincount(np.concatenate([holders[starts[t] : starts[t + 1]] for t in own]), minlength=len(sets))
        for j in np.flatnonzero((both >= similarity * (sizes[i] + sizes - both)) & (group != group[i])):
            if group[j] != group[i]:
                out.append((i, int(j)))
                group[group == group[j]] = group[i]
    return out


def _linked_in_tiles(lots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links that connect all similar pairs of each lot of ``uid, lot, root``; a lot is dealt to tiles of about ``TILE_SHINGLES``, and a task compares two."""
    own = stage(sets.join(lots, "uid"), "op6-lots")
    tiles = own.groupBy("lot").agg(F.ceil(F.sum(F.size("set")) / TILE_SHINGLES).cast("int").alias("tiles"))
    own = own.join(stage(tiles, "op6-tiles"), "lot").withColumn("t", F.pmod(F.xxhash64("uid"), F.col("tiles")).cast("int"))
    dealt = own.withColumn("v", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("lot", F.least("t", "v").alias("t"), F.greatest("t", "v").alias("v"), "uid", "root", "set")

    def run(rows: pa.Table) -> pa.Table:
        uid, found = rows["uid"].to_numpy(), []
        if len(uid) > 1:
            found = connect([x.values.to_numpy() for x in rows["set"]], rows["root"].to_numpy(), similarity)
        ends = uid[np.array(found, np.int64).reshape(-1, 2)]
        return pa.table({"a": pa.array(ends.min(1), pa.int64()), "b": pa.array(ends.max(1), pa.int64())})

    return stage(dealt.groupBy("lot", "t", "v").applyInArrow(run, "a long, b long"), "op6-connected")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, its smallest doc_id.

    A pair links if the Jaccard similarity of its distinct ``shingle``-word shingles is ``similarity`` or
    more; a group is what links connect.  Texts of equal sets are copies, so are texts without a word.
    Pairs are proposed by ``links`` of the fingerprints, and by each shared prefix shingle with its first
    holder; bitmaps of the sets tell which cannot be similar, and the others are verified.  As similar texts
    can differ in more bits than blocks can bear, the rest is settled exactly: every similar pair shares a
    prefix shingle, whose holders' bitmaps are all compared, and what such candidates chain together and
    proposals did not connect is compared by the sets, in tiles.  A row that repeats another's doc_id and
    text is that row.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = (F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("doc_id", text).alias("tag"))
    texts = docs.select(*keys, text.alias("text"))
    all_rows = scratch(spark, "op6-signatures")
    signed = stage(_signatures(texts, shingle, similarity, _common(texts.select("text"), shingle)), "op6-signatures", all_rows)
    first = signed.groupBy("h", "n").agg(F.min(F.struct("id", "uid")).alias("rank")).select("rank.uid")
    live = stage(signed.join(first, "uid", "left_semi").drop("h"), "op6-live")
    drop(spark, all_rows)

    postings = live.select("uid", F.explode("prefix").alias("token"))
    # written before it is joined: Spark then splits the rows of a hot shingle among tasks
    sizes = postings.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("uid").alias("head")).filter("c > 1")
    keyed = stage(postings.join(stage(sizes, "op6-sizes"), "token"), "op6-keyed")
    marks = live.select("uid", "n", "bits")
    x, y = (marks.select(F.col("uid").alias(u), F.col("n").alias(f"n{u}"), F.col("bits").alias(f"x{u}")) for u in "ab")

    words = stage(live.groupBy("fp").agg(F.min("uid").alias("uid")), "op6-words")
    near = links(words.select("fp"), words.count())
    near = near.join(words.select(F.col("fp").alias("a"), F.col("uid").alias("p")), "a").join(words.select(F.col("fp").alias("b"), F.col("uid").alias("q")), "b").select(F.col("p").alias("a"), F.col("q").alias("b"))
    same = live.select("fp", F.col("uid").alias("b")).join(words.withColumnRenamed("uid", "a"), "fp").select("a", "b")
    stars = keyed.select(F.col("head").alias("a"), F.col("uid").alias("b"))
    met = stars.unionByName(near).unionByName(same).filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    proposed = stage(met.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(lambda batches: _pairs_may_link(batches, similarity), "a long, b long"), "op6-proposed")

    # shingles of three or more holders of which one cannot be similar to the first: all their pairs are looked at
    apart = keyed.filter("c > 2 AND uid != head").join(proposed.select(F.col("a").alias("head"), F.col("b").alias("uid")), ["head", "uid"], "left_anti").select("token").distinct()
    rest = keyed.join(stage(apart, "op6-apart"), "token", "left_semi")
    rest = rest.withColumn("tiles", F.ceil(F.col("c") / TILE).cast("int")).withColumn("t", F.pmod(F.xxhash64("uid"), F.col("tiles")).cast("int"))
    rest = rest.withColumn("v", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("token", F.least("t", "v").alias("t"), F.greatest("t", "v").alias("v"), "uid")
    rest = rest.join(marks, "uid").select("token", "t", "v", "uid", "n", "bits").repartition("token", "t", "v").sortWithinPartitions("token", "t", "v")
    candidates = proposed.unionByName(stage(rest.mapInArrow(_forests(similarity), "a long, b long").distinct(), "op6-candidates"))

    chained = components(candidates)
    lots = chained.select(F.col("node").alias("uid"), F.col("root").alias("lot")).unionByName(chained.select(F.col("root").alias("uid"), F.col("root").alias("lot")).distinct())
    lots = stage(lots, "op6-lots")
    wanted = live.select("uid", "id", "tag").join(lots.select("uid"), "uid", "left_semi")
    found = texts.join(wanted.hint("merge"), ["id", "tag"]).dropDuplicates(["id", "tag"])
    sets = stage(_shingle_sets(found.select("uid", "text"), shingle), "op6-sets")
    linked = _similar(proposed, sets, similarity)
    roots = components(linked)
    named = stage(lots.join(roots, lots.uid == roots.node, "left").select("uid", "lot", F.coalesce("root", "uid").alias("root")), "op6-named")
    mixed = named.groupBy("lot").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("lot")
    open_lots = named.join(stage(mixed, "op6-mixed"), "lot", "left_semi").select("uid", "lot", "root")
    roots = components(linked.unionByName(_linked_in_tiles(open_lots, sets, similarity)))

    groups = live.select("uid", "id", "tag").join(roots, live.uid == roots.node, "left").withColumn("root", F.coalesce("root", "uid"))
    kept = groups.groupBy("root").agg(F.min(F.struct("id", "uid", "tag")).alias("rank")).select("rank.id", "rank.tag")
    own = docs.select(*keys, "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))
    own = own.join(stage(kept, "op6-kept").hint("merge"), ["id", "tag"], "left_semi").dropDuplicates(["id", "tag"])
    return own.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash": op6_simhash}
SQL: dict[str, str] = {}
