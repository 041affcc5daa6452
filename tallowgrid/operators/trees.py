"""Decision trees over binned features in which missing values choose a side of each split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallowgrid.session import settle


def bin_ranges(rows: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Least and greatest value of each feature, nulls aside; a feature without values has none."""
    found = rows.agg(*[x for c in features for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()
    return {c: (float(found[f"lo_{c}"]), float(found[f"hi_{c}"])) for c in features if found[f"lo_{c}"] is not None}


def bin_of(column: str, low: float, high: float, bins: int) -> Column:
    """The bin, 0 to bins - 1, of equal widths; null for a missing value, which is never given one."""
    if not high > low:
        return F.when(F.col(column).isNotNull(), F.lit(0))
    at = F.floor((F.col(column) - F.lit(low)) / F.lit(high - low) * bins)
    return F.when(F.col(column).isNotNull(), F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int"))  # least and greatest pass over nulls


def binned(rows: DataFrame, keep: list[str], features: list[str], bins: int, ranges: dict | None = None) -> DataFrame:
    """keep, and an array of bins, one a feature in the order of ``features``."""
    ranges = ranges if ranges is not None else bin_ranges(rows, features)
    cells = [bin_of(c, *ranges[c], bins) if c in ranges else F.lit(None).cast("int") for c in features]
    return rows.select(*keep, F.array(*cells).alias("__bins"))


def split_gains(cells: DataFrame, y: str, features: list[str], node: Column) -> DataFrame:
    """node, feature, bin, missing, gain, n of every split of every feature.

    A split sends bins up to ``bin`` left, the others right, and missing values to the side ``missing``. Cells are
    summed by (node, feature, bin), missing being a bin of its own, within tasks first: what is shuffled, and all
    that follows, is a row a bin. Gain is the fall of Gini impurity; splits with an empty side are none.
    """
    names = F.array(*map(F.lit, features))
    long = cells.select(node.alias("node"), F.col(y).alias("__y"), F.posexplode("__bins").alias("__at", "bin"))
    sums = long.groupBy("node", "__at", "bin").agg(F.count("*").alias("n"), F.sum("__y").alias("pos"))
    whole = Window.partitionBy("node", "__at")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    present = lambda c: F.when(F.col("bin").isNotNull(), F.col(c)).otherwise(0)
    missing = lambda c: F.when(F.col("bin").isNull(), F.col(c)).otherwise(0)
    placed = sums.select(
        "node", "__at", "bin", F.sum("n").over(whole).alias("N"), F.sum("pos").over(whole).alias("P"),
        F.sum(missing("n")).over(whole).alias("mn"), F.sum(missing("pos")).over(whole).alias("mp"),
        F.sum(present("n")).over(upto).alias("ln"), F.sum(present("pos")).over(upto).alias("lp"),
    ).where("bin IS NOT NULL")
    sides = F.explode(F.array(F.lit("left"), F.lit("right")))
    split = placed.withColumn("missing", sides)
    more = lambda c, m: F.col(c) + F.when(F.col("missing") == "left", F.col(m)).otherwise(0)
    split = split.withColumn("ln", more("ln", "mn")).withColumn("lp", more("lp", "mp"))
    impurity = lambda p, n: 2.0 * p / n * (1.0 - p / n)
    n, p, ln, lp = (F.col(c).cast("double") for c in ("N", "P", "ln", "lp"))
    rn, rp = n - ln, p - lp
    found = split.where((F.col("ln") > 0) & (F.col("ln") < F.col("N")))
    gain = impurity(p, n) - ln / n * impurity(lp, ln) - rn / n * impurity(rp, rn)
    return found.select("node", F.get(names, F.col("__at")).alias("feature"), "bin", "missing", gain.alias("gain"), F.col("N").alias("n"))


def best_splits(gains: DataFrame, by: list[str]) -> DataFrame:
    """The split of the largest gain, by groups; on ties the smaller feature name, the lower bin, missing left."""
    order = [(-F.round(F.col("gain") + F.lit(1e-12), 9)).alias("o"), "feature", "bin", "missing", "gain", "n", "node"]
    best = F.min(F.struct(*order)).alias("__b")
    names = [c for c in ("node", "feature", "bin", "missing", "gain", "n") if c not in by]
    return gains.groupBy(*by).agg(best).select(*by, *[F.col(f"__b.{c}") for c in names])


def fit_tree(rows: DataFrame, key: str, y: str, features: list[str], depth: int = 3, bins: int = 32, least_gain: float = 1e-9) -> dict:
    """A tree: ``splits`` {node: (feature, bin, missing)}, ``leaves`` {node: share of label 1}, and the bins' ranges.

    Node 0 is the root, 2k+1 and 2k+2 are the children of k. Rows are binned and written once; a row's node is an
    expression of its bins, so levels need no rewriting. A level is one pass; a row a node reaches the driver.
    """
    known = rows.where(F.col(y).isNotNull())
    ranges = bin_ranges(known, features)
    cells = settle(binned(known, [key, y], features, bins, ranges), "tree-cells")
    tree = {"features": features, "bins": bins, "ranges": ranges, "splits": {}, "leaves": {}}
    open_ = {0}
    for _ in range(depth):
        here = cells.withColumn("__node", node_of(tree)).where(F.col("__node").isin(*open_))
        found = best_splits(split_gains(here, y, features, F.col("__node")), ["node"]).where(F.col("gain") > least_gain).collect()
        tree["splits"] |= {r["node"]: (r["feature"], r["bin"], r["missing"]) for r in found}
        open_ = {c for r in found for c in (2 * r["node"] + 1, 2 * r["node"] + 2)}
        if not open_:
            break
    shares = cells.groupBy(node_of(tree).alias("node")).agg(F.avg(y).alias("p")).collect()
    tree["leaves"] = {r["node"]: r["p"] for r in shares}
    return tree


def node_of(tree: dict, node: int = 0) -> Column:
    """The leaf of a row, from its array of bins."""
    if node not in tree["splits"]:
        return F.lit(node)
    feature, at, missing = tree["splits"][node]
    value = F.get("__bins", F.lit(tree["features"].index(feature)))
    left = value.isNull() if missing == "left" else F.lit(False)
    return F.when(left | F.coalesce(value <= at, F.lit(False)), node_of(tree, 2 * node + 1)).otherwise(node_of(tree, 2 * node + 2))


def predict_tree(rows: DataFrame, key: str, tree: dict) -> DataFrame:
    """key, node, p of every row: no join and no Python, one expression of the row's features."""
    cells = binned(rows, [key], tree["features"], tree["bins"], tree["ranges"])
    share = F.lit(None).cast("double")
    at = node_of(tree)
    for node, p in tree["leaves"].items():
        share = F.when(at == node, p).otherwise(share)
    return cells.select(key, at.alias("node"), share.alias("p"))
