"""Classification metrics as aggregates: confusion counts, MCC, ROC-AUC, thresholds, leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallowgrid.functions.scalars import ratio
from tallowgrid.operators.ranks import running_before

COUNTS = ["tp", "tn", "fp", "fn"]


def confusion(y: str, pred: str) -> list[Column]:
    """Aggregates tp, tn, fp, fn; rows with a missing label or prediction count in none."""
    of = lambda a, b: F.count(F.when((F.col(y) == a) & (F.col(pred) == b), 1))
    return [of(1, 1).alias("tp"), of(0, 0).alias("tn"), of(0, 1).alias("fp"), of(1, 0).alias("fn")]


def mcc_of(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    """Matthews correlation; null where a margin is empty."""
    tp, tn, fp, fn = (x.cast("double") for x in (tp, tn, fp, fn))
    return (tp * tn - fp * fn) / F.nullif(F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), F.lit(0.0))


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def mcc(df: DataFrame, y: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Confusion counts and mcc, by groups if given."""
    counts = df.groupBy(*(by or [])).agg(*confusion(y, pred))
    return counts.withColumn("mcc", mcc_of(*[F.col(c) for c in COUNTS]))


def roc_auc(df: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    """n, n_pos, auc by groups: the share of (positive, negative) pairs in order, ties half.

    Rows are summed to a row for each score first; its negatives below come from running sums.
    """
    by = by or []
    known = df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    counts = known.groupBy(*by, score).agg(F.count(F.when(F.col(y) == 1, 1)).alias("pos"), F.count(F.when(F.col(y) == 0, 1)).alias("neg"))
    placed = running_before(counts, by, score, ["neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return placed.groupBy(*by).agg((F.sum("pos") + F.sum("neg")).alias("n"), F.sum("pos").alias("n_pos"), ratio(wins, F.sum("pos") * F.sum("neg")).alias("auc"))


def corrected_auc(df: DataFrame, y: str, score: str, leaking: Column) -> DataFrame:
    """pooled: AUC over all rows; corrected: over rows whose label and features don't share a source."""
    marked = df.select(y, score, F.explode(F.array(F.lit("pooled"), F.when(~leaking, F.lit("corrected")))).alias("part")).where("part IS NOT NULL")
    found = roc_auc(marked, y, score, ["part"])
    return found.agg(F.max(F.when(F.col("part") == "pooled", F.col("auc"))).alias("pooled"), F.max(F.when(F.col("part") == "corrected", F.col("auc"))).alias("corrected"))


def leak_share(pooled: Column, corrected: Column) -> Column:
    """The part of the pooled excess over chance that the correction removes."""
    return (pooled - corrected) / F.nullif(pooled - F.lit(0.5), F.lit(0.0))


def threshold_grid(df: DataFrame, y: str, score: str, taus: list[float], by: list[str] | None = None) -> DataFrame:
    """Confusion counts and mcc at each threshold (score >= tau is positive).

    One pass: a row counts in the highest threshold it reaches, and running sums over the grid,
    a fixed number of rows a group, give the rest.
    """
    by = by or []
    grid = F.array(*[F.lit(float(t)) for t in sorted(taus)])
    reached = F.size(F.filter(grid, lambda t: F.col(score) >= t))
    known = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).withColumn("__at", reached)
    at = known.groupBy(*by, "__at").agg(F.count(F.when(F.col(y) == 1, 1)).alias("__p"), F.count(F.when(F.col(y) == 0, 1)).alias("__n"))
    levels = at.groupBy(*by).agg(F.collect_list(F.struct("__at", "__p", "__n")).alias("__all"))  # a row a threshold
    levels = levels.select(*by, "__all", F.posexplode(grid).alias("__k", "tau"))
    total = lambda name, test: F.aggregate(F.filter("__all", test), F.lit(0).cast("long"), lambda a, x: a + x[name])
    above, below = lambda x: x["__at"] > F.col("__k"), lambda x: x["__at"] <= F.col("__k")
    out = levels.select(*by, "tau", total("__p", above).alias("tp"), total("__n", below).alias("tn"), total("__n", above).alias("fp"), total("__p", below).alias("fn"))
    return out.withColumn("mcc", mcc_of(*[F.col(c) for c in COUNTS]))


def best_threshold(grid: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tau of the largest mcc, the lowest on ties, and that mcc."""
    rounded = F.round(F.col("mcc") + F.lit(1e-10), 9)
    best = F.max(F.when(F.col("mcc").isNotNull(), F.struct(rounded.alias("r"), (-F.col("tau")).alias("t"), F.col("mcc").alias("m")))).alias("best")
    return grid.groupBy(*(by or [])).agg(best).select(*(by or []), (-F.col("best.t")).alias("tau"), F.col("best.m").alias("mcc"))


def deltas(metrics: DataFrame, key: list[str], arm: str, value: str, base: str) -> DataFrame:
    """Differences of every other arm from the base arm: key, base, arm, delta."""
    reference = metrics.where(F.col(arm) == base).select(*key, F.col(value).alias("__base"))
    others = metrics.where(F.col(arm) != base)
    return others.join(reference, key).select(*key, F.lit(base).alias("base"), F.col(arm).alias("arm"), (F.col(value) - F.col("__base")).alias("delta"))


def lock_compare(new: DataFrame, stored: DataFrame, key: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """key, diff, ok for a full outer comparison; a key or value on one side only is not ok."""
    a, b = new.select(F.col(key), F.col(value).alias("__new")), stored.select(F.col(key), F.col(value).alias("__stored"))
    diff = F.abs(F.col("__new") - F.col("__stored"))
    return a.join(b, key, "full_outer").select(key, diff.alias("diff"), F.coalesce(diff <= tolerance, F.lit(False)).alias("ok"))


def threshold_sweep(counts: DataFrame, by: list[str], score: str) -> DataFrame:
    """Confusion counts and mcc at every distinct score as the threshold (score >= tau is positive).

    ``counts`` has a row for each (by, score), with pos and neg; cumulative counts come from running sums
    over ranges of scores, so no task holds a group's scores. No grid: every threshold that tells rows apart is
    tried.
    """
    placed = running_before(counts.select(*by, score, "pos", "neg"), by, score, ["pos", "neg"])
    whole = counts.groupBy(*by).agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    # A row a group: by design seeds, folds or arms.
    named = whole.select(*[F.col(c).alias(f"__by_{c}") for c in by], "__p", "__n")
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    out = placed.join(F.broadcast(named), same)
    fn, tn = F.col("pos_before"), F.col("neg_before")
    out = out.select(*by, F.col(score).alias("tau"), (F.col("__p") - fn).alias("tp"), tn.alias("tn"), (F.col("__n") - tn).alias("fp"), fn.alias("fn"))
    return out.withColumn("mcc", mcc_of(*[F.col(c) for c in COUNTS]))


def score_counts(df: DataFrame, y: str, score: str, by: list[str]) -> DataFrame:
    """A row for each (by, score): pos, neg; rows with a missing label or score are left out."""
    known = df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    return known.groupBy(*by, score).agg(F.count(F.when(F.col(y) == 1, 1)).alias("pos"), F.count(F.when(F.col(y) == 0, 1)).alias("neg"))


def exact_threshold(df: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    """tau of the largest mcc over all distinct scores, the lowest on ties, and that mcc."""
    by = by or []
    return best_threshold(threshold_sweep(score_counts(df, y, score, by), by, score), by)


def exact_fold_thresholds(df: DataFrame, y: str, score: str, seed: str, fold: str, folds: int = 5) -> DataFrame:
    """seed, fold, tau, mcc_train, mcc_held_out: for each fold the threshold that is best on the others' rows.

    A (seed, score) row with the counts of each fold is written once for each fold held out, less that fold's
    counts; only scores that others have are thresholds.
    """
    counts = score_counts(df, y, score, [seed, fold])
    of = lambda name, k: F.coalesce(F.sum(F.when(F.col(fold) == k, F.col(name))), F.lit(0))
    sums = counts.groupBy(seed, score).agg(*[F.array(*[of(n, k) for k in range(folds)]).alias(f"__{n}") for n in ("pos", "neg")])
    total = lambda name: F.aggregate(f"__{name}", F.lit(0).cast("long"), lambda a, x: a + x)
    rest = F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: F.struct(k.cast("int").alias(fold), (total("pos") - F.get("__pos", k)).alias("pos"), (total("neg") - F.get("__neg", k)).alias("neg")))
    others = sums.select(seed, score, F.explode(rest).alias("r")).select(seed, score, f"r.{fold}", "r.pos", "r.neg").where("pos + neg > 0")
    picked = best_threshold(threshold_sweep(others, [seed, fold], score), [seed, fold]).withColumnRenamed("mcc", "mcc_train")
    held = df.select(seed, fold, y, score).join(F.broadcast(picked.select(seed, fold, "tau")), [seed, fold])  # a row a fold
    found = mcc(held.withColumn("__pred", (F.col(score) >= F.col("tau")).cast("int")), y, "__pred", [seed, fold])
    return picked.join(found.select(seed, fold, F.col("mcc").alias("mcc_held_out")), [seed, fold])
