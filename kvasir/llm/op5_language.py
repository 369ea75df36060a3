"""Language identification by interpolated Kneser-Ney character models.

Text becomes classes of lower-cased characters (any run of others is one space).  For each language, counts
of n-grams up to ``ORDER`` over the training rows give an interpolated Kneser-Ney model: the highest
order from raw counts, the lower ones from numbers of distinct left neighbours, with a discount from the
counts of counts.  The models of all languages share sorted arrays of n-gram hashes, each with a row of
log-probabilities, and of context hashes with a row of back-off weights; a look-up is a binary search.
A document goes to the language of the lowest cross-entropy per character.

The classifier is fitted on a bounded sample of labelled rows: at most ``FIT_ROWS`` whole texts of each
language of at most ``FIT_CHARS`` characters each, those of the smallest hash of their doc_id (the hash only
deals rows to the sample).  A second sample of the same bound calibrates: one temperature turns
differences of cross-entropy into probabilities (``score``), and the ``REJECT`` quantile of the true
language's cross-entropies says beyond which a text is in no learned language (``rejected``).

Defined results: a null text, or one without a letter, is ``und`` with score 0; rows that repeat a
doc_id are predicted each; a null doc_id counts as the text "" in the held-out rule; a table without
training rows gives ``und`` throughout; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kvasir.llm.common import sliced, table

ORDER = 4
FIT_ROWS = 500
SALTS = 256
FIT_CHARS = 20_000
ALPHABET = 250
REJECT = 0.999
_SPACE, _OTHER = 1, 255
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Classes:
    """Characters as bytes: 1 for a run of non-letters, 2.. for the letters of the fit, 255 for any other letter."""

    def __init__(self, letters: str):
        self.map = np.full(0x110000, _SPACE, np.uint8)
        self.letters = letters
        for k, c in enumerate(letters):
            self.map[ord(c)] = k + 2
        self.other: dict[int, bool] = {}
        self.known = np.zeros(0x110000, bool)
        self.known[: 128] = True
        for c in letters:
            self.known[ord(c)] = True

    def of(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        new = points[~self.known[points]]
        if len(new):
            for p in np.unique(new).tolist():
                self.known[p] = True
                if chr(p).isalpha():
                    self.map[p] = _OTHER
        x = self.map[points]
        x = np.concatenate([[_SPACE], x, [_SPACE]]).astype(np.uint8)
        return x[np.concatenate([[True], (x[1:] != _SPACE) | (x[:-1] != _SPACE)])]


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that ends at each place, as one integer; places before the text count as zeros."""
    out = x.astype(np.uint64)
    for k in range(1, n):
        out[k:] |= x[:-k].astype(np.uint64) << np.uint64(8 * k)
    return out


def hashed(g: np.ndarray, n: int) -> np.ndarray:
    h = (g + np.uint64(n)) * _MIX
    return h ^ (h >> np.uint64(32))


class Models:
    """Interpolated Kneser-Ney models of several languages over one alphabet."""

    def __init__(self, languages: list[str], letters: str, counts: list[dict[int, tuple[np.ndarray, np.ndarray]]]):
        self.languages, self.letters = languages, letters
        n_lang, size = len(languages), len(letters) + 3
        self.tables, self.backoffs = {}, {}
        lower = None  # of the order below: sorted grams and their probabilities by language
        for n in range(1, ORDER + 1):
            rows, contexts = [], []
            for own in counts:
                g, c = own[n] if n == ORDER else _continuations(own[n + 1][0], n)
                rows.append((g, c.astype(float)))
                contexts.append(np.unique(g >> np.uint64(8)))
            all_g = np.unique(np.concatenate([g for g, _ in rows]))
            all_c = np.unique(np.concatenate(contexts))
            prob, weight = np.zeros((len(all_g), n_lang)), np.ones((len(all_c), n_lang))
            for k, (g, c) in enumerate(rows):
                ones, twos = (c == 1).sum(), (c == 2).sum()
                d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.1
                ctx = np.searchsorted(all_c, g >> np.uint64(8))
                total, kinds = np.bincount(ctx, c, len(all_c)), np.bincount(ctx, minlength=len(all_c))
                seen = total > 0
                weight[seen, k] = d * kinds[seen] / total[seen]
                prob[np.searchsorted(all_g, g), k] = (c - d) / total[ctx]
            # g holds its last symbol in the lowest byte, so the context is g >> 8 and the shorter gram drops the highest byte
            ctx = np.searchsorted(all_c, all_g >> np.uint64(8))
            if lower is None:
                prob += weight[ctx] / size
                self.uniform = np.log(weight[0] / size).astype(np.float32)
            else:
                short = all_g & np.uint64((1 << (8 * (n - 1))) - 1)
                prob += weight[ctx] * _look_up(*lower, short)
            lower = (all_g, prob)
            self.tables[n] = _sorted(hashed(all_g, n), np.log(prob).astype(np.float32))
            if n > 1:
                self.backoffs[n] = _sorted(hashed(all_c, n - 1), np.log(weight).astype(np.float32))
        self.temperature, self.limit = 1.0, np.full(n_lang, np.inf)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """For each place its log-probability in each language."""
        out = np.zeros((len(x), len(self.languages)), np.float32)
        todo = np.arange(len(x))
        for n in range(ORDER, 0, -1):
            g = grams_at(x, todo, n)
            keys, values = self.tables[n]
            at, hit = _find(keys, hashed(g, n))
            out[todo[hit]] += values[at[hit]]
            todo, g = todo[~hit], g[~hit]
            if not len(todo):
                break
            if n > 1:
                keys, values = self.backoffs[n]
                at, hit = _find(keys, hashed(g >> np.uint64(8), n - 1))
                out[todo[hit]] += values[at[hit]]
            else:
                out[todo] += self.uniform
        return out

    def entropies(self, rows: list[np.ndarray]) -> np.ndarray:
        """Nats per character of each text in each language."""
        pad = np.zeros(ORDER - 1, np.uint8)
        x = np.concatenate([a for r in rows for a in (pad, r)])
        logs = self.log_probabilities(x).astype(np.float64)
        logs[x == 0] = 0
        starts = np.cumsum([0, *[len(r) + len(pad) for r in rows[:-1]]])
        return -np.add.reduceat(logs, starts, axis=0) / np.array([len(r) - 1 or 1 for r in rows])[:, None]

    def calibrate(self, entropy: np.ndarray, truth: np.ndarray) -> None:
        """The temperature of the highest likelihood, and each language's limit."""
        if not len(truth):
            return
        def loss(t):
            z = -entropy * t
            z -= z.max(1, keepdims=True)
            return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), truth]).mean())
        self.temperature = float(min((2.0**k for k in range(0, 9)), key=loss))
        for k in range(len(self.languages)):
            if (truth == k).any():
                self.limit[k] = np.quantile(entropy[truth == k, k], REJECT) * 1.1


def grams_at(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    if len(at) == len(x):
        return grams(x, n)
    out = x[at].astype(np.uint64)
    for k in range(1, n):
        out |= np.where(at >= k, x[np.maximum(at - k, 0)], 0).astype(np.uint64) << np.uint64(8 * k)
    return out


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], np.ascontiguousarray(values[order])


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _look_up(below: np.ndarray, prob: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Probabilities of the order below: each gram's end is among its grams, with the gram's first symbol as a left neighbour."""
    return prob[_find(below, wanted)[0]]


def _continuations(longer: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end a longer gram, and their numbers of distinct left neighbours."""
    return np.unique(longer & np.uint64((1 << (8 * n)) - 1), return_counts=True)


def _count(rows: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Counts of all n-grams that do not reach before a text's start."""
    out = {}
    for n in range(1, ORDER + 1):
        held = [grams(r, n)[n - 1 :] for r in rows]
        out[n] = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def chosen(docs: DataFrame) -> DataFrame:
    """``lang, h, text``: the rows that ``fit`` takes, at most ``2 * FIT_ROWS`` of a language, of those that are not held out."""
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL").filter(~_held_out())
    fits = labelled.filter(F.length("text").between(1, FIT_CHARS)).filter(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("doc_id", "text"))
    # rows that repeat doc_id and text count once; the least hashes of each salt, then of each language, so that no task ranks all rows of one
    narrow = fits.select("lang", "h").distinct().withColumn("salt", F.pmod(F.shiftright("h", 8), F.lit(SALTS)))
    salted = narrow.withColumn("r", F.row_number().over(W.partitionBy("lang", "salt").orderBy("h"))).filter(F.col("r") <= 2 * FIT_ROWS)
    least = salted.select("lang", "h").withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= 2 * FIT_ROWS)
    return fits.join(least.select("lang", "h"), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))


def fit(docs: DataFrame) -> Models | None:
    """Fit and calibrate on two bounded samples, each at most ``FIT_ROWS`` texts of a language."""
    first = chosen(docs).toPandas()
    first = first[first.text.map(has_letter).astype(bool)].sort_values(["lang", "h", "text"])
    first["r"] = first.groupby("lang").cumcount()
    if first.empty:
        return None
    languages = sorted(first.lang.unique())
    train, check = first[first.r % 2 == 0], first[first.r % 2 == 1]
    seen = Counter()
    for t in train.text:
        seen.update(t.lower())
    letters = "".join(sorted([c for c, _ in seen.most_common() if c.isalpha()][:ALPHABET]))
    classes = Classes(letters)
    models = Models(languages, letters, [_count([classes.of(t) for t in train.text[train.lang == k]]) for k in languages])
    if len(check):
        models.calibrate(models.entropies([classes.of(t) for t in check.text]), np.array([languages.index(k) for k in check.lang]))
    return models


def identify(docs: DataFrame, models: Models | None) -> DataFrame:
    """``doc_id, lang_pred, score, entropy, rejected`` of whole texts."""
    # four arrays by order; the fit's bound and the alphabet bound them
    fixed = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = fixed.value
        classes = Classes(m.letters) if m else None
        for part in sliced(batches, 1, 400_000):
            own = part.column(1).to_pylist()
            pred, score, entropy, rejected = ["und"] * len(own), np.zeros(len(own)), np.full(len(own), np.nan), np.ones(len(own), bool)
            some = [k for k, t in enumerate(own) if m and has_letter(t)]
            if some:
                e = m.entropies([classes.of(own[k]) for k in some])
                best = e.argmin(1)
                z = -(e - e.min(1, keepdims=True)) * m.temperature
                score[some] = 1 / np.exp(z).sum(1)
                entropy[some] = e.min(1)
                rejected[some] = e.min(1) > m.limit[best]
                for k, b in zip(some, best.tolist()):
                    pred[k] = m.languages[b]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred), pa.array(score), pa.array(entropy), pa.array(rejected)], ["doc_id", "lang_pred", "score", "entropy", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, entropy double, rejected boolean")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op5_language": op5_language}
SQL: dict[str, str] = {}
