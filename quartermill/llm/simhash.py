"""SimHash near-duplicate groups by tiled exact comparison.

A text's words (A-Z in lower case, split at ASCII white space) give shingles
of ``width`` words, repeats included; a bit of the fingerprint is set if it is
set in over half of their XXH64 values. Fingerprints that differ in at most
``radius`` bits are linked, and a group is a connected component of links.

Plan. (1) One narrow pass makes the fingerprints. (2) Equal fingerprints
become one row, so groups of exact copies cost nothing further. (3) Each
fingerprint lies in the tile that the population counts of its ``blocks``
blocks of bits name. Two fingerprints can only be within the radius if the
counts differ by the radius at most in sum, so it also visits the tiles in
that reach (half of them, as pairs are met once), and all other tile pairs are
skipped. (4) In each tile numpy compares by exclusive-or and bit counts, in
pieces of bounded size, and passes on a spanning forest of the links it found
instead of all pairs. (5) Components of the forest, then the smallest doc_id
of each.

Scale. A fingerprint is sent to a fixed number of tiles. Tiles with more than
``tile_rows`` fingerprints are split into parts, their visitors into groups of
``tile_rows``, and each part meets each group in a cell of its own; so a cell
holds about twice ``tile_rows`` values however crowded the tiles are.
Comparison is exact, so its cost grows with the square of the distinct
fingerprints over the pruning (about 1.6 % of pairs remain with four blocks,
0.03 % with eight); ``best_blocks`` weighs the rows to send against the pairs
to compare. The number of blocks never changes the result.

Edge cases. Null and empty texts, and texts of white space only, have
fingerprint zero and are linked like any other. A null doc_id takes part but
is never the smallest; a component of null ids only has a null component_id.
Repeated rows are copies of each other. An empty table gives an empty result.
Other columns are not read; ``keep_one`` passes them through, and keeps a row
of each group whatever its doc_ids are, null and repeated ones too.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, per_document, raw, table
from .components import components, one_of_each

WIDTH, RADIUS, SEED = 3, 2, 42
TILE_ROWS = 20_000
#: Comparisons that numpy holds at once.
PIECE = 2_000_000


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    words = text.lower().split()
    n = len(words) - width + 1
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if n > 1 else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(SEED)), np.uint64, max(n, 1))
    return int(majority(hashes))


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits set in over half of the values.

    Eight one-byte counters ride in each 64-bit addition; after 255 rows they
    are moved to wide counters.
    """
    n = len(hashes)
    lanes = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").view(np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 255):
        counts += lanes[k : k + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_key, fp): fp is the fingerprint as a signed long, text_key xxhash64 of the text."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, width) for t in raw(b.column(1))], np.uint64)
        return pa.record_batch([b.column(0).cast(pa.int64()), b.column(2), pa.array(fps.view(np.int64))], ["doc_id", "text_key", "fp"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return per_document(keyed, ["doc_id", "text", "text_key"], "doc_id bigint, text_key bigint, fp bigint", work)


def kept_share(blocks: int, radius: int) -> float:
    """The share of pairs of random fingerprints whose blocks' population counts allow the radius."""
    bits = 64 // blocks
    count = np.array([math.comb(bits, k) for k in range(bits + 1)]) / 2.0**bits
    apart = np.convolve(count, count[::-1])  # law of the difference of two counts
    size = np.array([apart[bits + d] + (apart[bits - d] if d else 0) for d in range(min(radius, bits) + 1)])
    law = np.ones(1)
    for _ in range(blocks):
        law = np.convolve(law, size)[: radius + 1]
    return float(law.sum())


def best_blocks(n: int, radius: int = RADIUS, row: float = 2e-6, pair: float = 2e-9) -> int:
    """The number of blocks of least cost: ``row`` seconds for each row sent, ``pair`` for each comparison of n fingerprints."""
    cost = {b: n * (1 + len(reach(b, radius))) * row + n * n / 2 * kept_share(b, radius) * pair for b in (2, 4, 8, 16)}
    return min(cost, key=lambda b: (cost[b], b))


def reach(blocks: int, radius: int) -> list[tuple[int, ...]]:
    """The count differences to visit: one of each pair +d and -d whose sum of sizes is within the radius."""
    found = set()
    for picks in itertools.chain.from_iterable(itertools.combinations_with_replacement(range(blocks), k) for k in range(1, radius + 1)):
        for signs in itertools.product((1, -1), repeat=len(picks)):
            d = [0] * blocks
            for at, sign in zip(picks, signs, strict=True):
                d[at] += sign
            if tuple(d) > (0,) * blocks:
                found.add(tuple(d))
    return sorted(found)


def links(homes: np.ndarray, guests: np.ndarray, radius: int, among: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within the radius among homes (unless not ``among``), and between homes and guests."""
    n = len(homes)
    nodes = np.concatenate([homes, guests])
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = [], []
    step = max(1, PIECE // max(1, len(nodes)))
    for at in range(0, n, step):
        piece = homes[at : at + step]
        skip = at + 1 if among else n
        near = np.bitwise_count(piece[:, None] ^ nodes[None, skip:]) <= radius  # later homes and all guests
        i, j = np.nonzero(near)
        if len(i) > len(nodes):  # a dense group: pairs that are connected already need no look
            roots = np.array([find(x) for x in range(len(nodes))])
            apart = roots[i + at] != roots[j + skip]
            i, j = i[apart], j[apart]
        for i, j in zip((i + at).tolist(), (j + skip).tolist(), strict=True):
            if i < j and (p := find(i)) != (q := find(j)):
                parent[p] = q
                a.append(i)
                b.append(j)
    return nodes[a], nodes[b]


def _compare(radius: int):
    """Links within cells; a cell's rows: homes (kind 0; 1 in cells that leave out the pairs among homes), then guests (kind 2)."""

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            cell, kind, fp = part
            order = np.lexsort((fp, kind, *cell.T[::-1]))
            cell, kind, fp = cell[order], kind[order], fp[order].view(np.uint64)
            change = np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1
            found_a, found_b = [], []
            for i, j in itertools.pairwise([0, *change.tolist(), len(cell)]):
                mid = i + int(np.searchsorted(kind[i:j], 2))
                if mid > i and j - i > 1:
                    a, b = links(fp[i:mid], fp[mid:j], radius, kind[i] == 0)
                    found_a.append(a)
                    found_b.append(b)
            if found_a and sum(map(len, found_a)):
                yield pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in (found_a, found_b)], ["a", "b"])

        held = None
        for b in batches:
            got = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            part = [np.stack(got[:3], 1), *got[3:]]
            held = part if held is None else [np.concatenate(x) for x in zip(held, part, strict=True)]
            last = (held[0] != held[0][-1]).any(1)  # a cell may go on in the next batch
            if cut := int(last.sum()):
                yield from done([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield from done(held)

    return tiles


def near_pairs(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): links between the distinct values of ``prints`` (fp) that connect just what all links connect."""
    blocks = blocks or best_blocks(prints.count(), radius)
    bits = 64 // blocks
    base = bits + 2 * radius + 1

    def tile_of(fp: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for k in range(blocks):
            out = out * base + F.bit_count(F.shiftrightunsigned(fp, k * bits).bitwiseAND(F.lit(2**bits - 1 if bits < 64 else -1).cast("bigint"))) + radius
        return out

    steps = F.array(*[F.lit(sum(d * base ** (blocks - 1 - k) for k, d in enumerate(x))).cast("bigint") for x in reach(blocks, radius)])
    homes = prints.select("fp", tile_of(F.col("fp")).alias("tile"))
    counts = materialise(homes.groupBy("tile").agg(F.count(F.lit(1)).alias("n")))
    visits = counts.select(F.explode(F.transform(steps, lambda s: F.col("tile") + s)).alias("tile"), F.col("n").alias("guests")).groupBy("tile").agg(F.sum("guests").alias("guests"))
    # parts of the homes, and groups of the guests: visitors, and homes that visit other parts
    crowded = counts.join(visits, "tile", "left").select("tile", F.ceil(F.col("n") / tile_rows).cast("int").alias("parts"), F.coalesce("guests", F.lit(0)).alias("guests"), "n")
    crowded = crowded.select("tile", "parts", F.greatest(F.lit(1), F.ceil((F.col("guests") + F.when(F.col("parts") > 1, F.col("n")).otherwise(0)) / tile_rows)).cast("int").alias("groups")).where("parts > 1 or groups > 1")
    sized = lambda df: df.join(crowded, "tile", "left").withColumns({"parts": F.coalesce("parts", F.lit(1)), "groups": F.coalesce("groups", F.lit(1))})
    homes = sized(homes).withColumn("part", F.expr("cast(pmod(xxhash64(fp), parts) as int)")).withColumn("grp", F.expr("cast(pmod(xxhash64(fp, 1), groups) as int)"))
    own = homes.select("tile", "part", F.explode(F.expr("sequence(0, groups - 1)")).alias("grp"), "fp").withColumn("kind", F.expr("cast(grp > 0 as int)"))
    across = homes.where("part < parts - 1").select("tile", F.explode(F.expr("sequence(part + 1, parts - 1)")).alias("part"), "grp", "fp", F.lit(2).alias("kind"))
    away = sized(homes.select("fp", F.explode(F.transform(steps, lambda s: F.col("tile") + s)).alias("tile")))
    away = away.select("tile", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.expr("cast(pmod(xxhash64(fp, 1), groups) as int)").alias("grp"), "fp", F.lit(2).alias("kind"))
    met = own.unionByName(across).unionByName(away).select("tile", F.col("part").cast("bigint"), F.col("grp").cast("bigint"), "kind", "fp")
    return met.repartition("tile", "part", "grp").sortWithinPartitions("tile", "part", "grp").mapInArrow(_compare(radius), "a bigint, b bigint")


def _rooted(docs: DataFrame, width: int, radius: int, blocks: int | None, tile_rows: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and of each distinct one: fp, rep (its smallest doc_id) and root (its group)."""
    marked = materialise(fingerprints(docs, width))
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(near_pairs(distinct.select("fp"), radius, blocks, tile_rows))
    return marked, distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, blocks: int | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id of its group) of every row of ``docs``."""
    marked, grouped = _rooted(docs, width, radius, blocks, tile_rows)
    least = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each group: of its smallest doc_id, null last; other columns pass through."""
    marked, grouped = _rooted(docs, width, radius, None, TILE_ROWS)
    return one_of_each(docs, marked.join(grouped, "fp").select("doc_id", "text_key", F.col("root").alias("group")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = near_groups(docs)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
