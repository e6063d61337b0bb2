"""Pieces that several operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: The six ASCII white-space characters; ``bytes.split()`` splits at just these.
WHITE = " \t\n\x0b\x0c\r"
#: Stands for a null doc_id inside arrays: it sorts after every other id.
NO_ID = np.iinfo(np.int64).max
#: Rows that a pass over documents works on at once.
ROWS = 500
#: Rows in a file of ``packed``, and bytes where the rows' sizes are given.
PACKED, PACKED_BYTES = 1 << 18, 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only where the setting is absent and Spark runs on this machine alone
    (tests) a temporary folder takes its place; a cluster must name one.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quartermill-"))
        found = sc.getCheckpointDir()
    return found


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder once and cuts its lineage."""
    ship(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def packed(df: DataFrame, size: Column | None = None) -> DataFrame:
    """``materialise`` for narrow rows: a file for each ``PACKED`` rows, however many partitions make them.

    ``size``: bytes of a row, if rows are wide; then a file for each ``PACKED_BYTES``.

    Where Hadoop's native library is missing, a file costs its writer's JVM two
    processes, and each seems as large as the JVM until it runs. The rows are
    made by as many tasks as before; only the copy is written by fewer.
    """
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        n, most = (held.count(), PACKED) if size is None else (held.agg(F.sum(size)).first()[0] or 0, PACKED_BYTES)
        return materialise(held.coalesce(max(1, -(-n // most))))
    finally:
        held.unpersist()


def input_partitions(df: DataFrame) -> int:
    """Number of partitions that a scan of ``df`` has; nothing is computed for a scan."""
    ship(df.sparkSession)
    return max(1, df.rdd.getNumPartitions())


def raw(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def ids(column: pa.Array) -> np.ndarray:
    """An integer column as int64, null as NO_ID."""
    return column.cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)


def id_or_null(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == NO_ID)


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def splitmix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit mixer (public-domain splitmix64 finaliser) under a seed."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def runs(*keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal keys in sorted arrays: first positions and the length."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    change = np.zeros(n - 1, bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1, [n]))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut to ``ROWS`` rows."""
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            yield b.slice(k, ROWS)


def by_size(texts: list[bytes], most: int = 64_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of ``texts`` of at most ``most`` bytes (or one text), so that no Arrow column overflows."""
    start = held = 0
    for k, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, k
            start, held = k, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def per_document(
    df: DataFrame, columns: list[str], schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch]
) -> DataFrame:
    """A narrow Arrow pass: ``work`` maps each batch of the named columns to a batch.

    Batches are cut to ``ROWS`` rows, so what a worker makes of one stays small.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield work(b)

    ship(df.sparkSession)
    return df.select(*columns).mapInArrow(each, schema)


def fresh(names: list[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column (whatever its case) has that name."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def schema_of(df: DataFrame, more: str = "") -> str:
    """The columns of ``df`` as a DDL string, and more of them."""
    own = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)
    return f"{own}, {more}" if more else own


class Memo:
    """A bounded table in two generations: when the young one is full it takes the old one's place.

    What is still in use is found in the old one and moves up, so frequent
    words never leave.
    """

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def find(self, key: bytes | str) -> bytes | None:
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def find_all(self, keys: Collection[bytes | str]) -> tuple[dict[bytes | str, bytes], list[bytes | str]]:
        """What is known of the keys, and those that aren't."""
        got = dict(zip(keys, map(self.young.get, keys), strict=True))
        if older := [k for k, x in got.items() if x is None]:
            found = {k: x for k, x in zip(older, map(self.old.get, older), strict=True) if x is not None}
            self.put_all(found)
            got |= found
            older = [k for k in older if k not in found] if found else older
        return got, older

    def put_all(self, found: dict[bytes | str, bytes]) -> None:
        if len(self.young) + len(found) <= self.most:
            self.young.update(found)
        else:
            for k, x in found.items():
                self.put(k, x)

    def put(self, key: bytes | str, value: bytes) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value
