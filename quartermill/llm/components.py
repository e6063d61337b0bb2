"""Connected components of a distributed edge list, and one row of each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise


def components(edges: DataFrame, rounds: int = 60, keep: Callable[[DataFrame], DataFrame] = materialise) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of its component.

    Alternates large-star and small-star steps until the edges no longer
    change. Each step takes the smallest neighbour of every node by a partial
    aggregate and links the neighbours to it, so a hub's neighbours are never
    gathered in one row or task. Each round's edges are checkpointed by ``keep``.

    Nulls don't occur; loops are ignored, repeated edges count once, and no
    edges give no rows. Ids are distinct, so there are no ties.
    """
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars = keep(stars)
    before = None
    for _ in range(rounds):
        # large star: every neighbour above a node goes to the node's smallest neighbour or itself
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: the neighbours below a node, and the node, go to the smallest of them
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(below.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        stars = keep(small)
        now = tuple(stars.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.expr("cast(xxhash64(b, a) as decimal(38,0))"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group: of its smallest doc_id (null last), the first by text_key and then by the columns.

    groups: doc_id, text_key (xxhash64 of the text) and group of every row.
    """
    names = docs.columns
    own, text, row = (fresh(names, x) for x in ("leader", "leader_text", "leader_row"))
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("one"))
    leaders = first.select(F.col("one.doc_id").alias(own), F.col("one.text_key").alias(text)).withColumn(row, F.xxhash64(own, text))
    keyed = docs.withColumn(text, F.xxhash64("text")).withColumn(row, F.xxhash64(F.col("doc_id").cast("bigint"), text))
    stay = keyed.join(leaders, (keyed[row] == leaders[row]) & (keyed[text] == leaders[text]), "left_semi")
    order = F.struct("text", *[c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    least = stay.groupBy(row, "doc_id", text).agg(F.min_by(F.struct(*names), order).alias("row"))  # dealt by row already
    return least.select(*[F.col("row")[c].alias(c) for c in names])
