"""As-of joins, top-n, worldviews, the ownership climb and other joints of the plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CLIMB_TYPES, OPEN_DATE
from ..session import checkpointed


def open_rows(df: DataFrame) -> DataFrame:
    """The open rows of a table with validity ranges."""
    return df.where(F.col("valid_to") == F.lit(OPEN_DATE).cast("date"))


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """a * scale / b as a double; null where b is zero or null."""
    return a.cast("double") * F.lit(float(scale)) / F.nullif(b.cast("double"), F.lit(0.0))


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, numbered from 1.

    Without groups a limit goes first, so only n rows meet in one task; with
    groups Spark keeps n rows a group before the shuffle.
    """
    if not by:
        df = df.orderBy(*order).limit(n)
        return df.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n).withColumn(rank, F.col(rank).cast("bigint"))


def as_of(left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str, value: str, out: str) -> DataFrame:
    """Each left row with the value of the last right row of its key at or before its date; null without one.

    The two sides are united and one window carries the last value forward, so
    the cost is a sort of both sides: no pair of rows is ever made, however
    long a key's history is.
    """
    side = right.select(F.col(key), F.col(right_date).alias("_at"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    rows = left.select(F.col(key), F.col(left_date).alias("_at"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    both = side.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)).unionByName(rows)
    w = Window.partitionBy(key).orderBy(F.col("_at").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn(out, F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    found = F.when(F.col("_at").isNotNull() & F.col(key).isNotNull(), F.col(out))
    return carried.select("_row.*", found.alias(out))


def climb(entities: DataFrame, relationships: DataFrame, most: int = 10) -> DataFrame:
    """entity_id, top_parent_entity_id and hops: the farthest ancestor by open ownership edges.

    Of ancestors equally far the smallest counts. Paths end at ``most`` hops,
    so cycles end too. Edges are composed with themselves (paths of 1, 2, 4 and
    8 hops), so a climb is a few joins that Spark plans as a whole; no job runs
    before the result is asked for.
    """
    edges = open_rows(relationships).where(F.col("control_type").isin(*CLIMB_TYPES))
    power = edges.select(F.col("child_entity_id").alias("_from"), F.col("parent_entity_id").alias("_to")).distinct()
    found = entities.select("entity_id", F.col("entity_id").alias("top"), F.lit(0).cast("bigint").alias("hops"))
    step = 1
    while step <= most:
        longer = found.where(F.col("hops") + step <= most).join(power, F.col("top") == F.col("_from"))
        found = found.unionByName(longer.select("entity_id", F.col("_to").alias("top"), (F.col("hops") + step).alias("hops")).distinct())
        step *= 2
        if step <= most:
            then = power.select(F.col("_from").alias("_mid"), F.col("_to").alias("_end"))
            power = power.join(then, F.col("_to") == F.col("_mid")).select("_from", F.col("_end").alias("_to")).distinct()
    best = found.groupBy("entity_id").agg(F.max_by("top", F.struct(F.col("hops"), -F.col("top"))).alias("top_parent_entity_id"), F.max("hops").alias("hops"))
    return best.select("entity_id", "top_parent_entity_id", "hops")


def rollup(holdings: DataFrame, history: DataFrame, worldview: str) -> DataFrame:
    """``holdings`` with rid, the rollup entity in a worldview; null where there is none."""
    view = open_rows(history).where(F.col("rollup_type") == worldview).select(F.col("entity_id").alias("_e"), F.col("rollup_entity_id").alias("rid"))
    return holdings.join(view, holdings["entity_id"] == view["_e"], "left").drop("_e")


def full_null_safe(a: DataFrame, b: DataFrame, keys: list[str], safe: list[str]) -> DataFrame:
    """Full outer join of two frames with like key columns, ``safe`` ones matching null with null.

    Keys come once; other columns must have distinct names.
    """
    right = b.withColumnsRenamed({k: f"_{k}" for k in [*keys, *safe]})
    on = F.lit(True)
    for k in keys:
        on = on & (a[k] == right[f"_{k}"])
    for k in safe:
        on = on & a[k].eqNullSafe(right[f"_{k}"])
    joined = a.join(right, on, "full")
    rest = [c for c in [*a.columns, *b.columns] if c not in {*keys, *safe}]
    return joined.select(*[F.coalesce(F.col(k), F.col(f"_{k}")).alias(k) for k in [*keys, *safe]], *rest)


def descend(roots: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """root, entity_id and its least depth of all that is within ``depth`` edges (parent, child) below each root."""
    found = frontier = roots.select(F.col("entity_id").alias("root"), "entity_id", F.lit(0).cast("bigint").alias("depth"))
    for k in range(1, depth + 1):
        frontier = frontier.join(edges, frontier["entity_id"] == edges["parent"]).select("root", F.col("child").alias("entity_id"), F.lit(k).cast("bigint").alias("depth")).distinct()
        found = found.unionByName(frontier)
    return found.groupBy("root", "entity_id").agg(F.min("depth").alias("depth"))


def closure(start: DataFrame, edges: DataFrame) -> DataFrame:
    """All entity_id that follow edges (src, dst) from ``start``, itself included, to the fixed point.

    Each round joins only what the round before found anew, and writes it to
    the shared folder; rounds end when nothing new is found, however long the
    chains are.
    """
    found = new = checkpointed(start.select("entity_id").distinct())
    while not new.isEmpty():
        new = checkpointed(new.join(edges, new["entity_id"] == edges["src"]).select(F.col("dst").alias("entity_id")).distinct().join(found, "entity_id", "left_anti"))
        found = checkpointed(found.unionByName(new))
    return found


def not_in(df: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    """Rows whose ``column`` is NOT IN ``other``'s ``key`` as SQL means it.

    A null in the list leaves no row, a null value no row unless the list is
    empty. An anti join on equality and one row of counts, so neither side has
    to fit a broadcast as in the planner's null-aware join.
    """
    counts = other.agg(F.count("*").alias("_n"), F.count_if(F.col(key).isNull()).alias("_nulls"))
    rest = df.join(other.select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_anti").crossJoin(F.broadcast(counts))
    return rest.where((F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(column).isNotNull())).select(*df.columns)
