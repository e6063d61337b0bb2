"""Quality classifier: a factorisation machine over words, structure and metadata.

A text becomes a sparse row: its hashed words (A-Z in lower case, weighted by
the square root of their share), one indicator for the bin of each structure
statistic (shares of letters, capitals, digits, marks and other bytes; words
that end in marks or are all capitals; word and line lengths; repeated words
and lines; size), and the bin of the table's n_chars as metadata. The score is
the sigmoid of

    w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum (v_if x_i)^2],

the pairwise interactions of all features through rank ``RANK`` factors, in
time linear in the row's entries.

Learning. Rows with a label whose crc32(doc_id as text) mod 5 is not 0; of
these at most ``TRAIN_ROWS`` (those with the smallest hash of doc_id), so what
the driver holds is bounded. Adagrad on the log loss, fixed seeds: reruns
agree. doc_id, lang, source and labels are never inputs of a score.

Scale. Learning reads labels, then the sampled documents' rows by a join with
the bounded sample. Scoring is one narrow pass; the model (about 1 MB) is
broadcast.

Edge cases. Null and empty texts have a row of their own (size bin zero) and
get a score. A null n_chars, or a table without that column, has its own bin.
Labels that are null are not learned from; repeated labels of a document count
once, by the smallest. Without labels, or with one class only, every score is
the smoothed share of class 1 (0.5 without any). A null doc_id has no crc32
and is not held out (held_out false). Repeated rows get equal scores. Other columns
pass through ``score_documents``; an input's own quality_score is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, per_document, raw, schema_of, sliced, table

#: Bound of the rows that are learned from.
TRAIN_ROWS = 8_000
#: From this score on a document is kept.
THRESHOLD = 0.3
WORDS = 1 << 15
BINS = 24
RANK = 8
CACHE = 150_000
EPOCHS, BATCH, RATE = 8, 64, 0.08
L2 = 1e-5

#: Byte classes: 0 other, 1 lower case, 2 capital, 3 digit, 4 white space, 5 sentence marks, 6 other ASCII marks, 7 non-ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[list(b".,;:?'\"-()")] = 5
_CLASS[[c for c in range(33, 127) if _CLASS[c] == 0]] = 6
_CLASS[128:] = 7

_KINDS = (_CLASS[:, None] == np.arange(8)).astype(np.int64)

STATISTICS = (
    "lower", "capital", "digit", "space", "sentence", "mark", "foreign", "marked_words", "capital_words",
    "word_length", "long_words", "distinct_words", "top_word", "words_per_line", "repeated_lines", "short_lines", "ended_lines", "size", "n_chars",
)
FEATURES = WORDS + len(STATISTICS) * BINS


_SENTENCE = b".,;:?'\"-()"
_words = Memo(CACHE)


def _learn_word(word: bytes) -> int:
    """A word's bucket, flags (ends in a mark, all capitals, long) and length, in one integer."""
    tail = word.rstrip(_SENTENCE)
    flags = int(_CLASS[word[-1]] == 6) | (2 if len(tail) > 1 and tail.isupper() else 0) | (4 if len(word) > 24 else 0)
    got = xxhash.xxh32_intdigest(word.lower()) % WORDS | flags << 16 | min(len(word), 255) << 20
    if len(word) < 64:
        _words.put(word, got)
    return got


def _bin(share: float) -> int:
    """Bins of a share from 0 to 1: zero, one, and finer steps towards both ends."""
    if share <= 0:
        return 0
    if share >= 1:
        return BINS - 1
    half = min(share, 1 - share)
    step = min(10, int(-2 * math.log2(2 * half)))  # 0 at a half, 10 from 1/64 of the way on
    return 11 - step if share < 0.5 else 12 + step


def _log_bin(x: float) -> int:
    return 0 if x <= 0 else min(BINS - 1, 1 + int(1.5 * math.log2(1 + x)))


def features(text: bytes, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a text's sparse row."""
    kinds = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _KINDS).tolist()
    size = max(1, len(text))
    words = text.split()
    n = len(words)
    known = list(map(_words.young.get, words))
    if None in known:
        for i, (word, k) in enumerate(zip(words, known, strict=True)):
            if k is None:
                k = _words.find(word)
                known[i] = _learn_word(word) if k is None else k
    packed = np.array(known, np.int64)
    lines = text.split(b"\n")
    shares = [kinds[k] / size for k in (1, 2, 3, 4, 5, 6, 7)]
    if n:
        buckets, counts = np.unique(packed & (WORDS - 1), return_counts=True)
        lengths = packed >> 20
        flags = [int(((packed >> (16 + k)) & 1).sum()) / n for k in range(3)]
        bins = [*(_bin(x) for x in [*shares, *flags[:2]]), _log_bin(int(lengths.sum()) / n), _bin(flags[2]), _bin(len(buckets) / n), _bin(int(counts.max()) / n)]
        values = np.sqrt(counts / n)
    else:
        buckets, values = np.zeros(0, np.int64), np.zeros(0)
        bins = [*(_bin(x) for x in shares), *[0] * 6]
    bins.append(_log_bin(n / len(lines)))
    bins.append(_bin(1 - len(set(lines)) / len(lines)))
    bins.append(_bin(sum(len(x) < 20 for x in lines) / len(lines)))
    bins.append(_bin(sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":") for x in lines) / len(lines)))
    bins.append(_log_bin(n))
    bins.append(BINS - 1 if n_chars is None or n_chars < 0 else min(BINS - 2, _log_bin(n_chars)))
    stats = WORDS + np.arange(len(bins)) * BINS + np.array(bins)
    return np.concatenate([buckets, stats]).astype(np.int32), np.concatenate([values, np.full(len(bins), 0.5)]).astype(np.float32)


class Machine:
    """A factorisation machine of order two."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        xv = x[:, None] * self.v[at]
        return float(self.bias + x @ self.w[at] + 0.5 * ((xv.sum(0) ** 2).sum() - (xv**2).sum()))

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(at, x), -30, 30))))

    @classmethod
    def constant(cls, share: float) -> Machine:
        return cls(float(np.log(share / (1 - share))), np.zeros(FEATURES, np.float32), np.zeros((FEATURES, 1), np.float32))

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, l2: float = L2, seed: int = 7) -> Machine:
        ones = int(labels.sum())
        share = (ones + 1) / (len(labels) + 2)
        if ones in (0, len(labels)):
            return cls.constant(share)
        rng = np.random.default_rng(seed)
        bias = float(np.log(share / (1 - share)))
        w, v = np.zeros(FEATURES, np.float32), rng.normal(0, 0.02, (FEATURES, rank)).astype(np.float32)
        gw, gv = np.full(FEATURES, 1e-6, np.float32), np.full((FEATURES, rank), 1e-6, np.float32)
        for epoch in range(epochs):
            step = rate / (1 + 0.3 * epoch)
            order = rng.permutation(len(rows))
            for k in range(0, len(rows), batch):
                part = [rows[i] for i in order[k : k + batch]]
                y = labels[order[k : k + batch]].astype(np.float32)
                at, x = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
                sizes = np.array([len(p[0]) for p in part])
                begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                row = np.repeat(np.arange(len(part)), sizes)
                xv = x[:, None] * v[at]
                s = np.add.reduceat(xv, begin, axis=0)
                margin = bias + np.add.reduceat(x * w[at], begin) + 0.5 * ((s**2).sum(1) - np.add.reduceat((xv**2).sum(1), begin))
                g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(part)
                bias -= step * float(g.sum())
                own, back = np.unique(at, return_inverse=True)
                dw = np.bincount(back, g[row] * x, len(own)).astype(np.float32) + l2 * w[own]
                each = (g[row] * x)[:, None] * (s[row] - xv)
                dv = np.stack([np.bincount(back, each[:, f], len(own)) for f in range(rank)], 1).astype(np.float32) + l2 * v[own]
                gw[own] += dw**2
                gv[own] += dv**2
                w[own] -= step * dw / np.sqrt(gw[own])
                v[own] -= step * dv / np.sqrt(gv[own])
        return cls(bias, w, v)


def part_of_five(doc_id: str | Column = "doc_id") -> Column:
    return F.crc32(F.col(doc_id) if isinstance(doc_id, str) else doc_id) % 5


def _inputs(docs: DataFrame) -> list[Column]:
    own = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.lit(None).cast("bigint")
    return [F.col("doc_id"), F.col("text"), own.alias("n_chars")]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Fits a machine to at most ``rows`` labelled documents outside the held-out fifth."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = known.where(part_of_five(F.col("doc_id").cast("string")) != 0)
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [features(t, n) for t, n in zip(raw(b.column(1)), b.column(2).to_pylist(), strict=True)]
        return pa.record_batch([b.column(0), b.column(3), pa.array([x.tobytes() for x, _ in got], pa.binary()), pa.array([x.tobytes() for _, x in got], pa.binary())], ["doc_id", "quality", "at", "x"])

    joined = docs.select(*_inputs(docs)).join(F.broadcast(sample), "doc_id")
    # one row for each doc_id, the smallest, so that repeated ids can't exceed the bound
    joined = joined.groupBy("doc_id").agg(F.min(F.struct("text", "n_chars", "quality")).alias("row")).select("doc_id", "row.*")
    found = per_document(joined, ["doc_id", "text", "n_chars", "quality"], "doc_id bigint, quality int, at binary, x binary", work).collect()
    found.sort(key=lambda r: (r["doc_id"], r["at"], r["x"]))
    if not found:
        return Machine.constant(0.5)
    pairs = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32)) for r in found]
    return Machine.fit(pairs, np.array([r["quality"] for r in found]))


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` with quality_score."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    docs = docs.drop("quality_score")
    names = docs.columns
    at_text, at_chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            chars = [None] * b.num_rows if at_chars is None else b.column(at_chars).to_pylist()
            got = [sent.value.score(*features(t, n)) for t, n in zip(raw(b.column(at_text)), chars, strict=True)]
            yield pa.record_batch([*b.columns, pa.array(got, pa.float64())], [*names, "quality_score"])

    return docs.mapInArrow(each, schema_of(docs, "quality_score double"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more."""
    return score_documents(docs, train(docs, labels)).where(F.col("quality_score") >= threshold).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(part_of_five(F.col("doc_id").cast("string")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
