"""Group-aware cross-validation folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallowgrid.functions.scalars import hash_class
from tallowgrid.operators.ranks import global_row_number
from tallowgrid.session import settle


def class_quotas(classes: list[tuple[int, int, int]], folds: int) -> dict[tuple[int, int], list[int]]:
    """For each (pos, neg) class of groups, how many of its groups each fold gets; classes: pos, neg, groups.

    Classes come in the order of falling difference of their counts. All folds get an equal part of a class;
    what is left over goes, group by group, to the fold that then makes the spread of class shares least,
    on ties to that of fewer rows.
    """
    totals = np.maximum([sum(p * n for p, _, n in classes), sum(q * n for _, q, n in classes)], 1.0)
    held, out = np.zeros((folds, 2)), {}
    for pos, neg, n in sorted(classes, key=lambda c: (-abs(c[0] - c[1]), -c[0], -c[1])):
        quota = [n // folds] * folds
        held += np.array([pos, neg]) * (n // folds)
        for _ in range(n % folds):
            scores = []
            for k in range(folds):
                held[k] += (pos, neg)
                scores.append((round(float((held / totals).std(axis=0).mean()), 12), quota[k], float(held[k].sum()), k))
                held[k] -= (pos, neg)
            best = min(scores)[3]
            quota[best] += 1
            held[best] += (pos, neg)
        out[(pos, neg)] = quota
    return out


#: Counts up to this are classes of their own; larger ones are classed by their three leading bits.
EXACT = 64


def coarse(count: Column) -> Column:
    """A count as it is, or its three leading bits followed by zeros: four values an octave, so there are at most
    (EXACT + 1 + 4 * 57)^2 pairs of coarse counts, whatever groups there are."""
    shift = (F.floor(F.log2(F.greatest(count, F.lit(1)).cast("double"))) - 2).cast("int")
    cut = F.call_function("shiftleft", F.call_function("shiftright", count, shift), shift)
    return F.when(count <= EXACT, count).otherwise(cut)


def stratified_group_folds(rows: DataFrame, group: str, y: str, seeds: list[int], folds: int = 5) -> DataFrame:
    """seed, group, fold: no group spans two folds, and folds have like shares of each class.

    Rows are summed to a row for each group first. Groups with the same counts are alike to the greedy
    rule, so it deals classes of groups, on a table with a row for each pair of counts (see
    ``class_quotas``); counts above EXACT are coarse for it, so that table is bounded however many sizes of
    groups there are. Which groups of a class a fold gets is decided by their rank in the order of a hash of
    group and seed, a global rank that no single task makes.
    """
    known = rows.where(F.col(y).isNotNull())
    counts = known.groupBy(F.col(group).cast("string").alias("group")).agg(F.count(F.when(F.col(y) == 1, 1)).alias("pos"), F.count(F.when(F.col(y) == 0, 1)).alias("neg"))
    counts = settle(counts.select("group", coarse(F.col("pos")).alias("pos"), coarse(F.col("neg")).alias("neg")), "fold-groups")
    # A row for each pair of coarse counts.
    classes = [tuple(r) for r in counts.groupBy("pos", "neg").agg(F.count("*").alias("n")).collect()]
    if not classes:
        return counts.select(F.lit(0).alias("seed"), "group", F.lit(0).alias("fold")).limit(0)
    quotas = class_quotas(classes, folds)
    size = {(p, q): n for p, q, n in classes}
    table, before = [], 0
    for p, q in sorted(size):
        table.append((p, q, before, np.cumsum(quotas[(p, q)]).tolist()))
        before += size[(p, q)]
    side = counts.sparkSession.createDataFrame(table, "pos long, neg long, before long, upto array<long>")
    spread = counts.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    text = F.md5(F.concat("group", F.lit(":"), F.col("seed").cast("string")))
    ranked = global_row_number(spread.withColumn("order", text), ["seed", "pos", "neg", "order", "group"], "rank")
    place = F.array(*map(F.lit, seeds))
    joined = ranked.join(F.broadcast(side), ["pos", "neg"])
    at = F.col("rank") - 1 - F.lit(before) * (F.array_position(F.sort_array(place), F.col("seed")) - 1) - F.col("before")
    return joined.select("seed", "group", F.size(F.filter("upto", lambda u: u <= at)).alias("fold"))


def hashed_folds(groups: DataFrame, group: str, seeds: list[int], folds: int = 5) -> DataFrame:
    """seed, group, fold from a hash of group and seed: needs no global step at any size."""
    spread = groups.select(group).distinct().withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    text = F.concat(F.col(group).cast("string"), F.lit(":"), F.col("seed").cast("string"))
    return spread.withColumn("fold", hash_class(text, folds))


def spanning_groups(assigned: DataFrame, group: str) -> DataFrame:
    """Groups that lie in more than one fold of a seed; no rows means none does."""
    return assigned.groupBy("seed", group).agg(F.count_distinct("fold").alias("__n")).where("__n > 1").drop("__n")
