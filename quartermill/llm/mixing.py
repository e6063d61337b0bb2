"""Mixing sources to target weights by index-mapped fixed-length blocks.

The words of a source, document after document, are cut into blocks of
``block`` words. Every source gets a target, its weight's share of all words
but at most ``most`` times its own words, the excess going to the others by
weight. Targets become slots of one block each, dealt to output shards of
``shard_slots`` slots: each shard draws its count of every source, given the
sources' totals, so noise can't move a source off its target. The j-th slot of
a source takes block perm(j mod n) of pass j div n, where perm is a keyed
pseudorandom permutation of the source's n block indices, another one for each
pass. So every block is taken as often as any other of its source, or once
more, and never over ``most`` times. Slots and blocks then join by index.

The draw. Independent multinomial counts of the shards, conditioned on each
source's total, are a multivariate hypergeometric law; it is drawn by halving
the range of shards again and again, each node with its own seed. A shard thus
finds its counts, and where its slots begin in each source, without the
others, in log2(shards) draws. The mix is the table (shard, slot, src, block):
what a document gives, where it comes and in which shard follow from it.

Scale. Documents' texts are read once for their word counts (and once more
where texts are returned). Equal rows are counted first, and positions within
a source come from a two-level prefix sum over hash buckets of (doc_id, text),
so neither a hot source nor a hot doc_id (null, say) is ordered in one task.
Block rows and slot rows are spread by (source, block). The driver holds one
row for each source; sources are the keys of the weight list, so their number
is that of the mix's configuration.

Edge cases. Null text has no words. Null source is a source, after all others.
A null doc_id is kept. Rows that repeat a doc_id are documents of their own,
equal rows too; each has a place of its own in the mix. Documents without
words get taken 0. An empty table, or one without words, gives no slots. Other
columns pass through ``mixed`` and ``mix_documents``; the names that ``mixed``
adds (shard, slot, first_word) replace an input's.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_size, fresh, materialise, schema_of, sliced, splitmix, table

BLOCK = 64
SHARD_SLOTS = 4096
MOST = 3
WEIGHTS = (5, 2, 1)
BUCKETS = 4096
SEED = 20_240_601
WORD = r"[^\x20\x09-\x0D]+"
#: Numpy draws from at most 10^9 items; the same law is inverted here for more.
NUMPY_MOST = 500_000_000


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[float]:
    """Each source's share of all words by weight; what exceeds ``most`` times its size goes to the others by weight."""
    total, capped = sum(sizes), [s == 0 for s in sizes]
    while True:
        left = total - sum(most * s for s, c in zip(sizes, capped, strict=True) if c)
        weight = sum(w for w, c in zip(weights, capped, strict=True) if not c)
        over = [not c and Fraction(left * w, weight) > most * s for s, w, c in zip(sizes, weights, capped, strict=True)]
        if not any(over):
            break
        capped = [c or o for c, o in zip(capped, over, strict=True)]
    return [float(most * s) if c else float(Fraction(left * w, weight)) for s, w, c in zip(sizes, weights, capped, strict=True)]


def slot_count(size: int, target: float, block: int) -> int:
    """Slots of a source: whole passes over its blocks, then blocks for what is left of the target."""
    if size == 0 or target <= 0:
        return 0
    n = -(-size // block)
    passes = int(target // size)
    return passes * n + min(n, round((target - passes * size) / block))


def hypergeometric(good: int, bad: int, want: int, rng: np.random.Generator) -> int:
    """How many of ``want`` items drawn from ``good`` and ``bad`` ones are good; one law at every size."""
    if not good or not want:
        return 0
    if good + bad <= NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, want))
    return inverted(good, bad, want, float(rng.random()))


def inverted(good: int, bad: int, want: int, u: float) -> int:
    """The hypergeometric quantile at u, by the ratios of neighbouring probabilities around the mode.

    Ten standard deviations to each side hold all but 1e-22 of the law.
    """
    n = good + bad
    mode = (want + 1) * (good + 1) // (n + 2)
    spread = 10 * math.ceil(math.sqrt(max(1.0, want * (good / n) * (bad / n) * ((n - want) / max(1, n - 1))))) + 30
    lo, hi = max(0, want - bad, mode - spread), min(good, want, mode + spread)
    k = np.arange(lo, hi, dtype=np.float64)
    steps = np.log(good - k) + np.log(want - k) - np.log(k + 1) - np.log(bad - want + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    law = np.cumsum(np.exp(logs - logs.max()))
    return lo + int(np.searchsorted(law, u * law[-1], side="right").clip(0, len(law) - 1))


@functools.lru_cache(maxsize=4096)
def _halves(counts: tuple[int, ...], left: int, seed: int, node: int) -> tuple[int, ...]:
    """How many slots of each source the left half of a node gets: ``left`` in all."""
    rng = np.random.default_rng([seed, node])
    out, rest, want = [], sum(counts), left
    for c in counts:
        got = hypergeometric(c, rest - c, want, rng) if rest > 0 else 0
        out.append(got)
        rest, want = rest - c, want - got
    return tuple(out)


def shard_counts(counts: tuple[int, ...], shards: int, shard_slots: int, shard: int, seed: int = SEED) -> tuple[list[int], tuple[int, ...]]:
    """Where shard's slots begin in each source, and how many it has."""
    lo, hi, node, start = 0, shards, 1, [0] * len(counts)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        total = sum(counts)
        left = min(total, (mid - lo) * shard_slots)
        got = _halves(counts, left, seed, node)
        if shard < mid:
            counts, hi, node = got, mid, 2 * node
        else:
            start = [s + g for s, g in zip(start, got, strict=True)]
            counts, lo, node = tuple(c - g for c, g in zip(counts, got, strict=True)), mid, 2 * node + 1
    return start, counts


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 to n-1: a four-round Feistel network, walked until back within n."""
    half = max(1, -(-int(n - 1).bit_length() // 2))
    mask = np.uint64(2**half - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for k in range(4):
            left, right = right, left ^ (splitmix(right, key * 4 + k) & mask)
        x = (left << np.uint64(half)) | right
        out[todo] = x
        todo = todo[x >= n]
    return out.astype(np.int64)


class Mix:
    """A mix's plan: sizes, targets and slots of each source, and its documents' places.

    ``placed`` has a row for each distinct (doc_id, source, text): doc_id,
    source, size, mark (a hash of the text), copies (equal rows), src (the
    source's number) and start (words of the source before the first copy).
    """

    def __init__(self, docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, most: int = MOST, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED):
        self.spark, self.block, self.shard_slots, self.seed = docs.sparkSession, block, shard_slots, seed
        sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), F.xxhash64("text").alias("mark"))
        sized = sized.groupBy("doc_id", "source", "size", "mark").agg(F.count(F.lit(1)).alias("copies"))
        sized = materialise(sized.withColumn("bucket", F.expr(f"cast(pmod(xxhash64(doc_id, mark, 7), {BUCKETS}) as int)")))
        by_bucket = sized.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
        found = sorted(((r[0], r[1]) for r in by_bucket.groupBy("source").agg(F.sum("words")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
        self.sources = [s for s, _ in found]
        self.sizes = [int(n) for _, n in found]
        self.targets = targets(self.sizes, [weights[k % len(weights)] for k in range(len(found))], most) if found else []
        self.slots = tuple(slot_count(s, t, block) for s, t in zip(self.sizes, self.targets, strict=True))
        self.shards = max(1, -(-sum(self.slots) // shard_slots))
        rows = [(k, s, n, t) for k, (s, n, t) in enumerate(zip(self.sources, self.sizes, self.targets, strict=True))]
        self.source_table = self.spark.createDataFrame(rows, "src int, source string, source_size bigint, target double")
        before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = by_bucket.select(F.col("source").alias("s"), F.col("bucket").alias("b"), before.alias("base"))
        place = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
        run = sized.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(place), F.lit(0)))
        run = run.join(offsets, run["source"].eqNullSafe(offsets["s"]) & (run["bucket"] == offsets["b"]))
        named = run.join(self.source_table.withColumnRenamed("source", "s2"), run["source"].eqNullSafe(F.col("s2")))
        self.placed = materialise(named.select("doc_id", "source", "size", "mark", "copies", "src", "source_size", "target", (F.col("base") + F.col("before")).alias("start")))

    def slot_rows(self) -> DataFrame:
        """The mix itself: shard, slot, src and the source's block index that fills the slot."""
        counts, shards, size, seed = self.slots, self.shards, self.shard_slots, self.seed
        blocks = [-(-s // self.block) for s in self.sizes]

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for shard in b["id"].tolist():
                    start, got = shard_counts(counts, shards, size, shard, seed)
                    src = np.repeat(np.arange(len(got)), got)
                    index = np.zeros(len(src), np.int64)
                    at = 0
                    for k, (a, g) in enumerate(zip(start, got, strict=True)):
                        j = np.arange(a, a + g)
                        for p in np.unique(j // blocks[k]) if g else ():
                            here = j // blocks[k] == p
                            index[at : at + g][here] = permuted(j[here] % blocks[k], blocks[k], seed + 1009 * k + 7919 * int(p))
                        at += g
                    order = np.random.default_rng([seed, 1, shard]).permutation(len(src))
                    yield pd.DataFrame({"shard": shard, "slot": np.arange(len(src)), "src": src[order].astype("int32"), "block": index[order]})

        if not sum(counts):
            return self.spark.createDataFrame([], "shard bigint, slot bigint, src int, block bigint")
        tasks = max(self.spark.sparkContext.defaultParallelism, self.shards // 500)
        return self.spark.range(0, self.shards, 1, min(self.shards, tasks)).mapInPandas(draw, "shard bigint, slot bigint, src int, block bigint")

    def documents(self) -> DataFrame:
        """``placed`` with a row for each copy: copy (from 0) and its own start."""
        each = self.placed.select("*", F.explode(F.expr("sequence(0, copies - 1)")).alias("copy"))
        return each.withColumn("start", F.col("start") + F.col("copy") * F.col("size"))

    def spans(self) -> DataFrame:
        """What blocks hold: src, block, the document (its key and copy), and its words first (of the document) and n in that block."""
        n = self.block
        rows = self.documents().where("size > 0").select("*", F.explode(F.expr(f"sequence(start div {n}, (start + size - 1) div {n})")).alias("block"))
        first = F.greatest(F.col("block") * n - F.col("start"), F.lit(0))
        end = F.least((F.col("block") + 1) * n - F.col("start"), F.col("size"))
        return rows.select("src", "block", "doc_id", "source", "mark", "copies", "copy", "size", first.alias("first"), (end - first).alias("n"))

    def taken_spans(self) -> DataFrame:
        """Spans with the shard and slot that take them, a row for each; blocks joined by index.

        Spark takes the slots, which come from a range of shards, for a few
        rows; the hint keeps it from broadcasting them.
        """
        return self.spans().join(self.slot_rows().hint("merge"), ["src", "block"])

    def taken(self) -> DataFrame:
        """Every document with size, source_size, target, taken (the words that the mix takes of it) and where they went.

        n_slots: slots that hold words of it; first_shard: the smallest shard
        that does; slots_hash: the exclusive-or of a hash of every (shard,
        slot, first word).
        """
        mark = F.xxhash64("shard", "slot", "first")
        got = self.taken_spans().groupBy("src", "doc_id", "mark", "copy").agg(F.sum("n").alias("got"), F.count(F.lit(1)).alias("slots"), F.min("shard").alias("shard"), F.bit_xor(mark).alias("hash"))
        own = got.select(F.col("src").alias("g_src"), F.col("doc_id").alias("g_doc"), F.col("mark").alias("g_mark"), F.col("copy").alias("g_copy"), "got", "slots", "shard", "hash").hint("merge")
        docs = self.documents()
        same = (docs["src"] == own["g_src"]) & docs["doc_id"].eqNullSafe(own["g_doc"]) & (docs["mark"] == own["g_mark"]) & (docs["copy"] == own["g_copy"])
        return docs.join(own, same, "left").select(
            "doc_id", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("bigint").alias("taken"), "source",
            F.coalesce("slots", F.lit(0)).cast("bigint").alias("n_slots"), F.col("shard").alias("first_shard"), F.col("hash").alias("slots_hash"),
        )


_WORDS = re.compile(WORD.encode())


def pieces(text: bytes, size: int, plan: list[tuple[int, int]]) -> list[bytes]:
    """The texts of the spans (first word, words) of a document of ``size`` words, with the text's own white space between the words.

    The whole document is its text as it is.
    """
    bounds = None
    out = []
    for first, n in plan:
        if n == size:
            out.append(text)
            continue
        bounds = bounds or [m.span() for m in _WORDS.finditer(text)]
        out.append(text[bounds[first][0] : bounds[first + n - 1][1]])
    return out


def mixed(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """The mix: the columns of ``docs`` with shard, slot and first_word, a row for each document's words in a slot.

    text is those words; n_chars, where there is such a column, is that of the
    new text. Slots of a shard hold blocks of the fixed length, document after
    document; partitions hold whole shards in order of shard, slot and word.

    A document meets its spans by hashes of its key, never null, so a hot
    doc_id spreads. Only where equal rows occur they are numbered, so each
    takes the spans of another copy.
    """
    mix = mix or Mix(docs)
    docs = docs.drop("shard", "slot", "first_word")
    names = docs.columns
    key = [F.xxhash64("doc_id", "source", "mark"), F.xxhash64("mark", "source", "doc_id", F.lit(1))]
    taken = mix.taken_spans().select(key[0].alias("k1"), key[1].alias("k2"), "copy", "size", F.struct("shard", "slot", "first", "n").alias("span"))
    plans = taken.groupBy("k1", "k2", "copy").agg(F.max("size").alias("size"), F.collect_list("span").alias("spans"))
    own = [fresh(names, x) for x in ("mix_k1", "mix_k2", "mix_copy", "mix_size", "mix_spans")]
    plans = plans.toDF(*own)
    mark, k1, k2, copy = (fresh(names, x) for x in ("doc_mark", "doc_k1", "doc_k2", "doc_copy"))
    keyed = docs.withColumn(mark, F.xxhash64("text"))
    keyed = keyed.withColumn(k1, F.xxhash64("doc_id", "source", mark)).withColumn(k2, F.xxhash64(mark, "source", "doc_id", F.lit(1)))
    same = (F.col(k1) == F.col(own[0])) & (F.col(k2) == F.col(own[1]))
    if not mix.placed.where("copies > 1 and size > 0").isEmpty():
        keyed = keyed.withColumn(copy, F.row_number().over(Window.partitionBy(k1, k2).orderBy(k1)) - 1)
        same = same & (F.col(copy) == F.col(own[2]))
    joined = keyed.join(plans.hint("merge"), same).select(*[docs[c] for c in names], *own[3:])
    at_text, at_chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    added = ["shard", "slot", "first_word"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows, texts, at = [], [], []
            for k, (text, size, spans) in enumerate(zip(b.column(at_text).cast(pa.binary()).to_pylist(), b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist(), strict=True)):
                texts += pieces(text or b"", size, [(x["first"], x["n"]) for x in spans])
                rows += [k] * len(spans)
                at += [(x["shard"], x["slot"], x["first"]) for x in spans]
            # a long document taken three times makes three texts of it, so the rows of a batch go out by size
            for a, z in by_size(texts):
                columns = [b.column(k).take(pa.array(rows[a:z], pa.int64())) if k != at_text else pa.array(texts[a:z], pa.binary()).cast(pa.string()) for k in range(len(names))]
                if at_chars is not None:
                    columns[at_chars] = pa.array([len(t.decode("utf-8", "replace")) for t in texts[a:z]], columns[at_chars].type)
                yield pa.record_batch([*columns, *(pa.array([x[k] for x in at[a:z]], pa.int64()) for k in range(3))], [*names, *added])

    rows = joined.mapInArrow(cut, schema_of(docs, "shard bigint, slot bigint, first_word bigint"))
    return rows.repartition("shard").sortWithinPartitions(*added)


def mix_documents(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """``mixed`` in the columns of ``docs`` only; the rows stay in the order of shards and slots."""
    return mixed(docs, mix).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, source and its places in the mix (n_slots, first_shard, slots_hash), of every document."""
    return Mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).taken()
