"""Line dedup with a sharded minimal perfect hash.

A line's key is the line without ASCII white space at its ends, A-Z in lower
case. Keys of at least ``min_chars`` code points that two or more documents
hold stay only in the smallest doc_id that holds them.

Plan. (1) One narrow pass hashes the lines (64 bits plus a 32-bit
fingerprint), sums up each Arrow batch by key and deals the sums to shards by
hash. (2) Each shard builds a minimal perfect hash over its distinct line
hashes, indexing arrays of fingerprints, document counts and owners (the
smallest doc_id). (3) Documents send their hashes, packed, to the shards and
probe the arrays there; the text stays behind. What comes back is the hashes
that a document loses. (4) Documents meet these by doc_id and drop the lines.

Scale. The first shuffle carries sums, never a row for each copy of a line.
Lines so frequent that their probes would pile up in one shard are at most
``1 / heavy_share`` in number by definition, so their owners are broadcast and
they are never sent. The index is kept in as few files as its bytes need. Shards follow the number of input partitions, so a shard
holds about a quarter of the distinct lines of one input partition.

Edge cases. Null text is one empty line. A null doc_id sorts after all others
and all null ids count as one document. Rows that repeat a doc_id count as one
document. An empty table gives an empty result. Other columns pass through; an
input's own n_lines or n_dropped is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, WHITE, binary, by_size, fresh, ids, input_partitions, packed, raw, schema_of, sliced, splitmix, table

MIN_CHARS = 10
#: A line is heavy if it makes up more than this share of all kept keys.
HEAVY_SHARE = 1 / 20_000
#: ... and more than this number of them.
HEAVY_LEAST = 100
SUM = np.dtype([("h", "<u8"), ("f", "<u4"), ("n", "<u4"), ("lo", "<i8"), ("hi", "<i8")])
PROBE = np.dtype([("h", "<u8"), ("f", "<u4"), ("doc", "<i8")])
KEY = np.dtype([("h", "<u8"), ("f", "<u4")])


# --- minimal perfect hash -------------------------------------------------


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys, built level by level.

    At each level a key takes the bit that its level hash names; keys that
    share a bit go on to the next level. A key's index is the rank of its bit
    over all levels, so the n keys get the indices 0 to n-1. About 3.7 bits a
    key with ``gamma`` 2. Keys outside the set get any index or -1; the caller
    compares fingerprints.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.words, self.sizes = words, sizes
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)))

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        words, sizes, rest, level = [], [], keys, 0
        while len(rest):
            m = max(1, -(-int(len(rest) * gamma) // 64)) * 64
            at = splitmix(rest, level) % np.uint64(m)
            alone = np.bincount(at.astype(np.int64), minlength=m)[at.astype(np.int64)] == 1
            bits = np.zeros(m, np.uint8)
            bits[at[alone].astype(np.int64)] = 1
            words.append(np.packbits(bits, bitorder="little").view("<u8"))
            sizes.append(m)
            rest, level = rest[~alone], level + 1
        return cls(np.concatenate(words) if words else np.zeros(0, "<u8"), np.array(sizes, "<i8"))

    def index(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        rest, base = np.arange(len(keys)), 0
        for level, m in enumerate(self.sizes.tolist()):
            at = (splitmix(keys[rest], level) % np.uint64(m)).astype(np.int64) + base
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[rest[hit]] = (self.before[at >> 6] + below)[hit]
            rest, base = rest[~hit], base + m
            if not len(rest):
                break
        return out


class LineIndex:
    """A shard: perfect hash, fingerprints, counts and owners of its lines.

    Two lines with equal 64-bit hashes but other fingerprints can't both have
    an entry; all but the first go to ``rest``, a sorted list searched as well.
    """

    def __init__(self, perfect: PerfectHash, prints: np.ndarray, counts: np.ndarray, owners: np.ndarray, rest: np.ndarray):
        self.perfect, self.prints, self.counts, self.owners, self.rest = perfect, prints, counts, owners, rest

    @classmethod
    def build(cls, sums: np.ndarray) -> LineIndex:
        """``sums``: SUM rows, distinct in (h, f) and sorted. counts: 1, or 2 for two or more documents."""
        first = np.ones(len(sums), bool)
        first[1:] = sums["h"][1:] != sums["h"][:-1]
        own, rest = sums[first], sums[~first]
        perfect = PerfectHash.build(own["h"])
        at = perfect.index(own["h"])
        prints, counts, owners = np.zeros(len(own), "<u4"), np.zeros(len(own), "u1"), np.zeros(len(own), "<i8")
        prints[at], owners[at] = own["f"], own["lo"]
        counts[at] = 1 + (own["lo"] != own["hi"])
        return cls(perfect, prints, counts, owners, rest)

    def to_bytes(self) -> bytes:
        parts = [self.perfect.words, self.perfect.sizes, self.prints, self.counts, self.owners, self.rest]
        return np.array([x.nbytes for x in parts], "<i8").tobytes() + b"".join(x.tobytes() for x in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> LineIndex:
        at, parts = 48, []
        for size, kind in zip(np.frombuffer(data, "<i8", 6).tolist(), ("<u8", "<i8", "<u4", "u1", "<i8", SUM), strict=True):
            parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
            at += size
        return cls(PerfectHash(parts[0], parts[1]), *parts[2:])

    def lost(self, probes: np.ndarray) -> np.ndarray:
        """Whether each probe's document loses the line."""
        at = self.perfect.index(probes["h"])
        known = at >= 0
        known[known] = self.prints[at[known]] == probes["f"][known]
        out = np.zeros(len(probes), bool)
        where = at[known]
        out[known] = (self.counts[where] > 1) & (self.owners[where] != probes["doc"][known])
        for x in self.rest:
            same = (probes["h"] == x["h"]) & (probes["f"] == x["f"])
            out |= same & (x["lo"] != x["hi"]) & (probes["doc"] != x["lo"])
        return out


# --- passes over documents ------------------------------------------------


def line_keys(text: bytes, min_chars: int) -> list[tuple[bytes, int, int]]:
    """(line, h, f) for each line; f is -1 for lines too short to count."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(WHITE.encode()).lower()
        if len(key) < min_chars or len(key.decode("utf-8", "replace")) < min_chars:
            out.append((line, 0, -1))
        else:
            x = xxhash.xxh3_128_intdigest(key)
            out.append((line, x & (2**64 - 1), (x >> 64) & (2**32 - 1)))
    return out


def _probes(b: pa.RecordBatch, min_chars: int) -> np.ndarray:
    """Distinct (document, line) pairs of a batch."""
    got = []
    for doc, text in zip(ids(b.column(0)).tolist(), raw(b.column(1)), strict=True):
        got += {(h, f, doc) for _, h, f in line_keys(text, min_chars) if f >= 0}
    return np.array(got, PROBE)


def merge_sums(rows: np.ndarray) -> np.ndarray:
    """Sums by (h, f), sorted."""
    rows = rows[np.lexsort((rows["f"], rows["h"]))]
    if not len(rows):
        return rows
    new = np.ones(len(rows), bool)
    new[1:] = (rows["h"][1:] != rows["h"][:-1]) | (rows["f"][1:] != rows["f"][:-1])
    at = np.flatnonzero(new)
    out = rows[at].copy()
    out["n"] = np.minimum(np.add.reduceat(rows["n"].astype(np.uint64), at), 2**32 - 1)
    out["lo"], out["hi"] = np.minimum.reduceat(rows["lo"], at), np.maximum.reduceat(rows["hi"], at)
    return out


def _deal(rows: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    shard = (rows["h"] % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        yield k, rows[order[cuts[k] : cuts[k + 1]]]


def build_index(docs: DataFrame, min_chars: int = MIN_CHARS, shards: int | None = None) -> DataFrame:
    """One row for each shard: shard, n_keys (copies included), index (LineIndex bytes), top (its most frequent lines)."""
    shards = shards or 4 * input_partitions(docs)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            probes = _probes(b, min_chars)
            rows = np.zeros(len(probes), SUM)
            rows["h"], rows["f"], rows["n"], rows["lo"], rows["hi"] = probes["h"], probes["f"], 1, probes["doc"], probes["doc"]
            dealt = list(_deal(merge_sums(rows), shards))
            if dealt:
                yield pa.record_batch([pa.array([k for k, _ in dealt], pa.int32()), binary([x.tobytes() for _, x in dealt])], ["shard", "sums"])

    def build(group: pa.Table) -> pa.Table:
        held, total = np.zeros(0, SUM), 0
        parts, size = [], 0
        for x in group.column("sums").to_pylist():
            parts.append(np.frombuffer(x, SUM))
            size += len(parts[-1])
            if size > len(held) + 200_000:  # so that copies never add up to more than the distinct lines
                held, parts, size = merge_sums(np.concatenate([held, *parts])), [], 0
        held = merge_sums(np.concatenate([held, *parts]))
        total = int(held["n"].sum(dtype=np.int64))
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "n_keys": pa.array([total], pa.int64()), "index": binary([LineIndex.build(held).to_bytes()]), "top": binary([held[held["n"] > max(HEAVY_LEAST, int(total * HEAVY_SHARE))].tobytes()])})

    dealt = docs.select("doc_id", "text").mapInArrow(sums, "shard int, sums binary")
    return dealt.groupBy("shard").applyInArrow(build, "shard int, n_keys bigint, index binary, top binary")


def heavy_lines(index: DataFrame, share: float = HEAVY_SHARE) -> np.ndarray:
    """SUM rows of the lines that make up over ``share`` of all keys: at most 1/share rows by definition.

    A shard has no more keys than all shards together, so the rows that shards
    have set aside by their own totals hold them all.
    """
    total = index.agg(F.sum("n_keys")).first()[0] or 0
    least = max(HEAVY_LEAST, int(total * share))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                rows = np.frombuffer(x, SUM)
                if len(rows := rows[rows["n"] > least]):
                    yield pa.record_batch([binary([rows.tobytes()])], ["top"])

    found = [np.frombuffer(x[0], SUM) for x in index.select("top").mapInArrow(pick, "top binary").collect()]
    return np.concatenate(found) if found else np.zeros(0, SUM)


def lost_lines(docs: DataFrame, index: DataFrame, heavy: set[tuple[int, int]], min_chars: int = MIN_CHARS, shards: int | None = None) -> DataFrame:
    """doc_id (NO_ID for null) and, packed, the line hashes that the document loses; heavy lines aside."""
    shards = shards or 4 * input_partitions(docs)
    known = docs.sparkSession.sparkContext.broadcast(heavy)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            probes = _probes(b, min_chars)
            if known.value:
                probes = probes[[x not in known.value for x in zip(probes["h"].tolist(), probes["f"].tolist(), strict=True)]]
            dealt = list(_deal(probes, shards))
            if dealt:
                yield pa.record_batch([pa.array([k for k, _ in dealt], pa.int32()), pa.array([1] * len(dealt), pa.int32()), binary([x.tobytes() for _, x in dealt])], ["shard", "kind", "data"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for b in batches:
            docs_, keys = [], []
            for shard, kind, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 0:
                    now, held = shard, LineIndex.from_bytes(data)
                    continue
                assert shard == now and held is not None
                probes = np.frombuffer(data, PROBE)
                probes = probes[held.lost(probes)]
                probes = probes[np.argsort(probes["doc"], kind="stable")]
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(probes["doc"])) + 1, [len(probes)])) if len(probes) else [0]
                packed = np.zeros(len(probes), KEY)
                packed["h"], packed["f"] = probes["h"], probes["f"]
                for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                    docs_.append(int(probes["doc"][a]))
                    keys.append(packed[a:z].tobytes())
            if docs_:
                yield pa.record_batch([pa.array(docs_, pa.int64()), binary(keys)], ["id", "keys"])

    probes = docs.select("doc_id", "text").mapInArrow(ask, "shard int, kind int, data binary")
    both = index.select("shard", F.lit(0).alias("kind"), F.col("index").alias("data")).unionByName(probes)
    met = both.repartition("shard").sortWithinPartitions("shard", "kind")
    return met.mapInArrow(answer, "id bigint, keys binary").groupBy("id").agg(F.collect_list("keys").alias("keys"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with its columns, text without the lines it loses, plus n_lines and n_dropped."""
    docs = docs.drop("n_lines", "n_dropped")
    shards = 4 * input_partitions(docs)
    index = packed(build_index(docs, min_chars, shards), F.length("index") + F.length("top"))
    heavy = {(int(x["h"]), int(x["f"])): (int(x["lo"]), x["lo"] != x["hi"]) for x in heavy_lines(index)}
    lost = lost_lines(docs, index, set(heavy), min_chars, shards)
    owners = docs.sparkSession.sparkContext.broadcast({k: lo for k, (lo, many) in heavy.items() if many})
    names = docs.columns

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_id, at_text, at_keys = names.index("doc_id"), names.index("text"), len(names)
        for b in sliced(batches):
            texts, lines, dropped = [], [], []
            for doc, text, keys in zip(ids(b.column(at_id)).tolist(), raw(b.column(at_text)), b.column(at_keys).to_pylist(), strict=True):
                gone = {tuple(x) for part in keys or () for x in np.frombuffer(part, KEY).tolist()}
                keyed = line_keys(text, min_chars)
                kept = [line for line, h, f in keyed if f < 0 or ((h, f) not in gone and owners.value.get((h, f), doc) == doc)]
                texts.append(b"\n".join(kept))
                lines.append(len(keyed))
                dropped.append(len(keyed) - len(kept))
            for a, z in by_size(texts):
                columns = [c.slice(a, z - a) for c in b.columns[: len(names)]]
                columns[at_text] = pa.array(texts[a:z], pa.binary()).cast(pa.string())
                yield pa.record_batch([*columns, pa.array(lines[a:z], pa.int64()), pa.array(dropped[a:z], pa.int64())], [*names, "n_lines", "n_dropped"])

    lost = lost.toDF(id_name := fresh(names, "lost_id"), key_name := fresh(names, "lost_keys"))
    joined = docs.join(lost, F.coalesce(docs["doc_id"], F.lit(int(NO_ID))) == lost[id_name], "left").select(*[docs[c] for c in names], key_name)
    return joined.mapInArrow(drop, schema_of(docs, "n_lines bigint, n_dropped bigint"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT keyed.*, shared.k IS NOT NULL AND keyed.doc_id <> shared.keeper AS gone
  FROM keyed LEFT JOIN shared ON keyed.k = shared.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
