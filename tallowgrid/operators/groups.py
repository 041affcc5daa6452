"""Groups of mixtures that share an active ingredient, directly or through others: connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallowgrid.operators import skew
from tallowgrid.session import settle


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest node that it is linked with) of every node that an edge names.

    Large-star and small-star steps: each node links its larger neighbours to the smallest node it knows, then
    its smaller ones, until nothing changes; the number of rounds is of the order of log2 of the nodes. Smallest
    neighbours come from sums within tasks, and a hub's edges are split off in the join with them
    (``join_unique``), so that no task holds a hub.
    """
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = settle(known.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    nodes = known.select(F.explode(F.array(a, b)).alias("node")).distinct()

    def mark(rows: DataFrame) -> tuple:
        found = rows.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        return tuple(found)

    before, now = None, mark(pairs)
    while before != now:
        # A round is one plan while no node can have many edges; beyond that, what joins split is written first.
        n = 2 * now[0]
        held = settle if n > skew.HEAVY_ROWS else lambda df, tag: df
        both = held(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))), "stars")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = skew.join_unique(both.where("v > u"), least, "u", "inner", n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = held(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = skew.join_unique(large, least, "u", "inner", n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        pairs = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        before, now = now, mark(pairs)
    # Every node but the smallest of a component now has one edge, to it.
    return nodes.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def active_ingredients(rows: DataFrame, by: str, ingredient: str, conc: str) -> DataFrame:
    """by, ingredient: those of the largest known concentration of each mixture; equal ones are all active."""
    top = rows.where(F.col(conc).isNotNull()).withColumn("__rank", F.rank().over(Window.partitionBy(by).orderBy(F.col(conc).desc())))
    return top.where("__rank = 1").select(by, ingredient).distinct()


def active_groups(mixtures: DataFrame, active: DataFrame, by: str, ingredient: str) -> DataFrame:
    """by, group of every mixture: mixtures that share an active ingredient, or are tied through others, are one.

    A mixture's actives are tied among themselves, to its smallest; components are made of ingredients, of
    which there are far fewer than mixtures. An ingredient of very many mixtures is split off in the last join.
    A mixture without a known active is a group of its own.
    """
    first = settle(active.groupBy(by).agg(F.min(ingredient).alias("__first")), "first-actives")
    ties = active.join(first, by).where(F.col(ingredient) != F.col("__first")).select("__first", ingredient).distinct()
    found = components(ties, "__first", ingredient).select(F.col("node").alias("__first"), "component")
    tied = skew.join_unique(first, found, "__first").select(by, F.coalesce("component", "__first").alias("__group"))
    name = F.coalesce(F.concat(F.lit("i"), F.col("__group").cast("string")), F.concat(F.lit("m"), F.col(by).cast("string")))
    return mixtures.select(by).distinct().join(tied, by, "left").select(by, name.alias("group"))
