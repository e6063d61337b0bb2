"""Near copies by SimHash tiles, then exact similarity of the word shingles.

A text's words (A-Z in lower case, split at ASCII white space) give a set of
shingles of ``WIDTH`` words (all words where there are fewer), held as XXH64
values. Texts are linked if the Jaccard similarity of their sets is at least
4/5; a group is a connected component of links. No link is left to chance: a
pair is only passed over where its similarity can't reach 4/5.

Plan. (1) One narrow pass names each row's set by a hash of it, makes its
SimHash fingerprint (bits set in over half of the set's hashes), and counts
shingles in ``CELLS`` cells. (2) The tiles of ``simhash`` compare the distinct
fingerprints by exclusive-or; sets whose fingerprints differ in ``RADIUS`` bits
or fewer are candidates, one pair for each link of the tiles' forest and one
for each further set of a fingerprint. (3) Similarity 4/5 leaves about ten of
64 bits apart, so what the radius and the forest leave out comes in an exact
way: all sets are put into one order of shingles, those of crowded cells last;
sets of similarity 4/5 share one of their first n - ceil(4n/5) + 1 shingles, so
just these are sent out, to a bucket each. (4) Pairs of a bucket whose sizes
allow 4/5 are candidates too. A crowded bucket first compares each set to one
leader only; in a second round those of its pairs that are not yet in one group,
and whose parity sketches (a lower bound of the sets' difference) allow 4/5, are
candidates as well. (5) Candidates whose sketches allow it get the exact
similarity. (6) Components of the links.

Scale. A fingerprint is sent to a fixed number of tiles, whose comparisons grow
as ``simhash`` says. A set is sent out a fifth of its shingles times. Shingles in many texts
reach a bucket only for sets that consist of them by four fifths; there, groups
of near copies cost a few comparisons a member, and only unlike sets of so
common shingles would cost the square.

Edge cases. Null and empty texts, and texts of white space only, have one
(empty) set, of fingerprint zero. Repeated rows are copies of each other. Rows stand for themselves
whatever their doc_id, null and repeated ones too. An empty table gives an
empty result. Two shingles, or two sets, of equal 64-bit hash count as equal.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, packed, raw, runs, sliced, splitmix
from .components import components, one_of_each
from .simhash import majority, near_pairs

WIDTH, SEED = 5, 42
#: Bits in which the fingerprints of a candidate of the tiles differ at most.
RADIUS = 3
#: Cells that shingles are counted in, to put common ones last.
CELLS, CHUNK = 1 << 18, 1 << 12
#: Buckets of more pairs take two rounds.
PAIRS = 64
#: Bits of a parity sketch.
BITS = 1024
#: Cells of text hashes, by which texts that no candidate needs are left out.
WANTED = 1 << 22


def shingles(text: bytes) -> np.ndarray:
    """The sorted hashes of a UTF-8 text's shingles, once each."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(words[k:] for k in range(WIDTH)), strict=False)) if len(words) > WIDTH else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, itertools.repeat(SEED)), np.uint64))


def set_key(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes(), SEED)


def fingerprint(own: np.ndarray) -> int:
    """The SimHash fingerprint of a set, unsigned."""
    return int(majority(own)) if len(own) else 0


def sketch(own: np.ndarray, bits: int = BITS) -> bytes:
    """Parities of the hashes' counts in ``bits`` cells; two sets differ in as many members as sketches in bits, or more."""
    counts = np.bincount((own & np.uint64(bits - 1)).view(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def wide_sketch(own: np.ndarray) -> bytes:
    """A sketch of four bits a member and more, so that few differences fall on each other: a sixteenth of the set's size."""
    return sketch(own, max(BITS, 1 << (4 * len(own)).bit_length()))


def apart(x: bytes, y: bytes) -> int:
    """In how many bits two sketches differ; the longer is folded, as its cells fall together in the shorter."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def prefix(own: np.ndarray, crowded: np.ndarray) -> np.ndarray:
    """The first members, those of crowded cells last, of which every set of similarity 4/5 has one among its own first."""
    n = len(own)
    if not n:
        return own
    return own[np.lexsort((own, crowded[_cell(own)]))[: n - (4 * n + 4) // 5 + 1]]


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - (CELLS - 1).bit_length())).astype(np.int64)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's set, and at the end the task's counts by chunks of cells."""
    names, counts = ["doc_id", "text_key", "key", "n", "fp", "parity", "wide", "chunk", "counts"], np.zeros(CELLS, np.int64)
    for b in sliced(batches):
        keys, sizes, prints, parities, wide = [], [], [], [], []
        for text in raw(b.column(1)):
            own = shingles(text)
            keys.append(set_key(own))
            sizes.append(len(own))
            prints.append(fingerprint(own))
            parities.append(sketch(own))
            wide.append(wide_sketch(own))
            np.add.at(counts, _cell(own), 1)
        n = len(keys)
        yield pa.record_batch([b.column(0).cast(pa.int64()), b.column(2), _signed(keys), pa.array(sizes, pa.int32()), _signed(prints), pa.array(parities, pa.binary()), pa.array(wide, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
    if counts.any():
        n = CELLS // CHUNK
        none = pa.nulls(n, pa.int64())
        yield pa.record_batch([none, none, none, pa.nulls(n, pa.int32()), none, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32()), pa.array([x.tobytes() for x in counts.astype(np.uint32).reshape(n, CHUNK)], pa.binary())], names)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for chunk, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, np.uint32).astype(np.int64)
    yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])


def _send(crowded: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in sliced(batches):
            tokens, keys, sizes = [np.zeros(0, np.uint64)], [], []
            for text in raw(b.column(0)):
                own = shingles(text)
                key = set_key(own)
                if len(own) and key not in seen:
                    seen.add(key)
                    tokens.append(prefix(own, crowded))
                    keys.append(key)
                    sizes.append(len(own))
            each = list(map(len, tokens[1:]))
            yield pa.record_batch([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(keys, np.uint64), each).view(np.int64)), pa.array(np.repeat(np.array(sizes, np.int32), each))], ["token", "key", "n"])

    return work


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole buckets, of which the first column names each; its rows come one after the other."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        part = [np.array(c.to_pylist(), object) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in b.columns]
        held = part if held is None else [np.concatenate(x) for x in zip(held, part, strict=True)]
        if cut := int(np.searchsorted(held[0], held[0][-1])):
            yield [x[:cut] for x in held]
            held = [x[cut:] for x in held]
    if held is not None:
        yield held


def _first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, a, b, n): candidates are of kind 0; members (set, bucket, size) of buckets with a second round of kind 1."""
    for token, key, n in _buckets(batches):
        order = np.lexsort((key, n, token))
        token, key, n = token[order], key[order], n[order].astype(np.int64)
        first = np.ones(len(key), bool)
        first[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        token, key, n = token[first], key[first], n[first]
        bounds = runs(token)
        out: list[list[np.ndarray]] = []
        for k in np.flatnonzero(np.diff(bounds) > 1).tolist():
            i, j = bounds[k], bounds[k + 1]
            own, size = key[i:j], n[i:j]
            ends = np.searchsorted(4 * size, 5 * size, side="right")  # how far sizes allow 4/5
            if (np.maximum(0, ends - np.arange(j - i) - 1)).sum() <= PAIRS:
                pairs = [(own[x], own[y]) for x in range(j - i) for y in range(x + 1, ends[x])]
                if pairs:
                    a, b = np.array(pairs, np.int64).T
                    out.append([np.zeros(len(a), np.int32), a, b, np.zeros(len(a), np.int64)])
                continue
            at, draw = 0, splitmix(own.view(np.uint64) ^ token[i : i + 1].view(np.uint64), 1)
            while at < j - i:
                lead, rest = own[at + int(draw[at : ends[at]].argmin())], own[at : ends[at]]
                rest = rest[rest != lead]
                out.append([np.zeros(len(rest), np.int32), np.full(len(rest), lead), rest, np.zeros(len(rest), np.int64)])
                at = int(ends[at])
            out.append([np.ones(j - i, np.int32), own, token[i:j], size])
        if out:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["kind", "a", "b", "n"])


def _second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): pairs of a bucket in unlike groups that sizes and sketches allow."""
    for token, key, n, root, parity in _buckets(batches):
        order = np.lexsort((key, n, token))
        token, key, n, root = token[order], key[order], n[order].astype(np.int64), root[order]
        bits = np.frombuffer(b"".join(parity[order]), np.uint64).reshape(-1, BITS // 64)
        for i, j in itertools.pairwise(runs(token).tolist()):
            if (root[i:j] == root[i]).all():
                continue
            ends = i + np.searchsorted(4 * n[i:j], 5 * n[i:j], side="right")
            for x in range(i, j - 1):
                y = x + 1 + np.flatnonzero(root[x + 1 : ends[x - i]] != root[x])
                apart = np.bitwise_count(bits[y] ^ bits[x]).sum(1, dtype=np.int64)
                y = y[9 * apart <= n[x] + n[y]]
                if len(y):
                    yield pa.record_batch([pa.array(np.full(len(y), key[x])), pa.array(key[y])], ["a", "b"])


def _members(wanted: np.ndarray):
    """The sets of texts whose text_key lies in a wanted cell, once a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in sliced(batches):
            at = wanted[b.column(1).to_numpy(zero_copy_only=False) & (WANTED - 1)]
            keys, sets = [], []
            for text in raw(b.column(0).filter(pa.array(at))):
                own = shingles(text)
                if (key := set_key(own)) not in seen:
                    seen.add(key)
                    keys.append(key)
                    sets.append(own.view(np.int64))
            yield pa.record_batch([_signed(keys), pa.array(sets, pa.list_(pa.int64()))], ["key", "members"])

    return work


def print_pairs(marked: DataFrame) -> DataFrame:
    """(a, b): sets (key) whose fingerprints (fp) lie within ``RADIUS``; they connect just what all such pairs connect."""
    sets = marked.select("fp", "key").distinct()
    prints = packed(sets.groupBy("fp").agg(F.min("key").alias("lead")))
    same = sets.join(prints, "fp").where("key <> lead").select(F.col("lead").alias("a"), F.col("key").alias("b"))
    side = lambda x: prints.select(F.col("fp").alias(f"fp_{x}"), F.col("lead").alias(x))
    near = near_pairs(prints.select("fp"), RADIUS).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    return near.join(side("a"), "fp_a").join(side("b"), "fp_b").select("a", "b").unionByName(same)


def similar_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, key) of every row, text_key being xxhash64 of its text; and (node, root) of every set (key) that is linked."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    marked = materialise(texts.mapInArrow(_mark, "doc_id bigint, text_key bigint, key bigint, n int, fp bigint, parity binary, wide binary, chunk int, counts binary"))
    counts = np.zeros((CELLS // CHUNK, CHUNK), np.int64)
    for r in marked.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(_add_up, "chunk int, counts binary").collect():
        counts[r["chunk"]] += np.frombuffer(r["counts"], np.int64)
    marked = marked.where("chunk is null")
    mean = counts.mean()
    sent = texts.select("text").mapInArrow(_send(counts.ravel() > mean + 6 * mean**0.5 + 100), "token bigint, key bigint, n int")
    met = packed(sent.repartition("token").sortWithinPartitions("token").mapInArrow(_first_round, "kind int, a bigint, b bigint, n bigint").distinct())
    links = _confirmed(print_pairs(marked).unionByName(met.where("kind = 0").select("a", "b")), texts, marked)
    members = met.where("kind = 1").select(F.col("b").alias("token"), F.col("a").alias("key"), "n")
    roots = components(links, keep=packed)
    if members.isEmpty():
        return marked.select("doc_id", "text_key", "key"), roots
    parity = marked.groupBy("key").agg(F.min("parity").alias("parity"))
    again = members.join(roots.withColumnRenamed("node", "key"), "key", "left").join(parity, "key").select("token", "key", "n", F.coalesce("root", "key").alias("root"), "parity")
    more = again.repartition("token").sortWithinPartitions("token").mapInArrow(_second_round, "a bigint, b bigint").distinct()
    more = _confirmed(packed(more), texts, marked)
    return marked.select("doc_id", "text_key", "key"), components(links.unionByName(more), keep=packed)


def _confirmed(pairs: DataFrame, texts: DataFrame, marked: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets whose similarity is 4/5 at least.

    Sketches rule out most of the others; the sets of what is left are made again.
    """
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sets = marked.groupBy("key").agg(F.min("text_key").alias("text_key"), F.min("n").alias("n"), F.min("wide").alias("wide"))
    side = lambda x: sets.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"p_{x}"))
    pairs = packed(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_within, "a bigint, b bigint"))
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    wanted = np.zeros(WANTED, bool)
    wanted[[r[0] for r in sets.join(keys, "key", "left_semi").select(F.col("text_key").bitwiseAND(F.lit(WANTED - 1))).distinct().collect()]] = True
    found = texts.select("text", "text_key").mapInArrow(_members(wanted), "key bigint, members array<bigint>")
    sets = found.join(keys, "key", "left_semi").groupBy("key").agg(F.first("members").alias("members")).persist(StorageLevel.DISK_ONLY)
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("members").alias("y")), "b")
    try:
        return packed(both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b"))
    finally:
        sets.unpersist()


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sketches allow 4/5."""
    for b in batches:
        if not b.num_rows:
            continue
        named = dict(zip(b.schema.names, b.columns, strict=True))
        n = named["n_a"].to_numpy().astype(np.int64) + named["n_b"].to_numpy()
        differ = np.array([apart(x, y) for x, y in zip(named["p_a"].to_pylist(), named["p_b"].to_pylist(), strict=True)], np.int64)
        near = pa.array(9 * differ <= n)
        yield pa.record_batch([named["a"].filter(near), named["b"].filter(near)], ["a", "b"])


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of near copies; other columns pass through."""
    marked, roots = similar_groups(docs)
    groups = marked.join(roots.withColumnRenamed("node", "key"), "key", "left").select("doc_id", "text_key", F.coalesce("root", "key").alias("group"))
    return one_of_each(docs, groups)
