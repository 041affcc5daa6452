"""From ingredient rows to mixtures: moments, sums by role, coverage, and the additive rule."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallowgrid.functions.scalars import known_or_null, ratio


def ingredient_rows(lines: DataFrame, substances: DataFrame) -> DataFrame:
    """Ingredient rows with their substance's columns; a row without a known substance stays.

    A task holds its substances, one row each, and ingredient rows pass by: a merge would sort a task's ingredient
    rows, as many as Spark's pieces of compressed bytes unpack to. Hot substances are still split by Spark.
    """
    return lines.join(substances.hint("shuffle_hash"), "s", "left")


def moments(rows: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """n, mean, sd_pop, min, max, skew_pop, wmean of a value over a mixture's ingredients.

    The spread of one ingredient is an observed 0, and so is its skew; weights that are missing leave
    their row out of the weighted mean. One shuffle: all moments come from sums.
    """
    v = F.col(value)
    mean, second, third = F.avg(v), F.avg(v * v), F.avg(v * v * v)
    out = rows.groupBy(by).agg(
        F.count(v).alias("n"),
        mean.alias("mean"),
        F.stddev_pop(v).alias("sd_pop"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        second.alias("__2"),
        third.alias("__3"),
        ratio(F.sum(v * F.col(weight)), F.sum(F.when(v.isNotNull(), F.col(weight)))).alias("wmean"),
    )
    central = F.col("__3") - 3 * F.col("mean") * F.col("__2") + 2 * F.pow("mean", F.lit(3.0))
    flat = F.col("sd_pop") <= 1e-9 * (1 + F.abs("mean"))
    return out.withColumn("skew_pop", F.when(flat, 0.0).otherwise(central / F.pow("sd_pop", F.lit(3.0)))).drop("__2", "__3")


def role_sums(rows: DataFrame, by: str, role: str, conc: str, roles: dict[str, str]) -> DataFrame:
    """A sum of concentrations for each role (role value: column name).

    A role without an ingredient is an observed 0 if some concentration of the mixture is known; all
    are null if none is.
    """
    sums = [F.sum(F.when(F.col(role) == value, F.col(conc))).alias(f"__{name}") for value, name in roles.items()]
    out = rows.groupBy(by).agg(F.count(conc).alias("__known"), *sums)
    return out.select(by, *[known_or_null(F.col("__known") > 0, F.col(f"__{name}")).alias(name) for name in roles.values()])


def null_preserving_total(rows: DataFrame, by: str, conc: str) -> DataFrame:
    """total_correct: null where no concentration is known; total_nan0: the same frozen to 0, kept only
    as a control; differs: where freezing invented a value."""
    out = rows.groupBy(by).agg(F.sum(conc).alias("total_correct"))
    return out.withColumn("total_nan0", F.coalesce("total_correct", F.lit(0.0))).withColumn("differs", F.isnull("total_correct"))


def interaction(a: Column, b: Column) -> Column:
    """Product of two sums; null if either is."""
    return a * b


def covered(category: str) -> Column:
    """Aggregate: the share of rows with a known category."""
    return F.count(category) / F.count("*")


def coverage(rows: DataFrame, by: str, category: str) -> DataFrame:
    """Share of a mixture's ingredients with a known category."""
    return rows.groupBy(by).agg(covered(category).alias("coverage"))


def active_rank(rows: DataFrame, by: str, conc: str, keys: list[str]) -> DataFrame:
    """rank of each ingredient by falling concentration, unknown last, keys breaking ties."""
    order = [F.col(conc).desc_nulls_last(), *[F.col(k) for k in keys]]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


#: Sums of concentrations that the rules weigh, as conditions on an ingredient's eye and skin category. An
#: ingredient counts once: one that burns skin counts as of the strongest eye class, and not in the weaker one.
TERMS = {
    "skin_1": "skin = '1'",
    "skin_2": "skin = '2'",
    "eye_1_or_skin_1": "eye = '1' OR skin = '1'",
    "eye_2": "eye IN ('2', '2A', '2B') AND NOT coalesce(skin = '1', FALSE)",
}
#: The eye and skin cut-offs of the public UN GHS mixture rules (chapters 3.2, 3.3), in
#: percent: endpoint, step, term, weight, cut-off, result. A step's weighted terms are added up.
CT_RULES = [
    ("eye", 1, "eye_1_or_skin_1", 1.0, 3.0, "1"),
    ("eye", 2, "eye_1_or_skin_1", 1.0, 1.0, "2A"),
    ("eye", 3, "eye_2", 1.0, 10.0, "2A"),
    ("eye", 4, "eye_1_or_skin_1", 10.0, 10.0, "2A"),
    ("eye", 4, "eye_2", 1.0, 10.0, "2A"),
    ("skin", 1, "skin_1", 1.0, 5.0, "1"),
    ("skin", 2, "skin_1", 1.0, 1.0, "2"),
    ("skin", 3, "skin_2", 1.0, 10.0, "2"),
    ("skin", 4, "skin_1", 10.0, 10.0, "2"),
    ("skin", 4, "skin_2", 1.0, 10.0, "2"),
]
#: The stronger and the weaker term of each endpoint.
ENDPOINT_TERMS = {"eye": ("eye_1_or_skin_1", "eye_2"), "skin": ("skin_1", "skin_2")}


def term_sum(term: str, conc: str, eye: str = "cat", skin: str = "skin") -> Column:
    """Aggregate: the sum of known concentrations of a term's ingredients; 0 without one."""
    test = re.sub(r"\b(eye|skin)\b(?! *_)", lambda m: {"eye": eye, "skin": skin}[m[1]], TERMS[term])
    return F.coalesce(F.sum(F.when(F.expr(test), F.col(conc))), F.lit(0.0))


def additivity(rows: DataFrame, by: str, conc: str, endpoint: str = "eye", eye: str = "cat", skin: str = "skin", extra: dict[str, Column] | None = None) -> DataFrame:
    """s1, s2, n_missing, category: the additive mixture rule of an endpoint; ``extra`` aggregates come of the same pass.

    s1 and s2 are the sums of the endpoint's stronger and weaker term; unknown concentrations are left out
    and counted, and the category is null if none is known. The first step whose weighted sum reaches its
    cut-off gives the category, else NC. Sums are compared with a margin of 1e-9, so that the order of
    addition doesn't decide.
    """
    strong, weak = ENDPOINT_TERMS[endpoint]
    out = rows.groupBy(by).agg(
        term_sum(strong, conc, eye, skin).alias("s1"), term_sum(weak, conc, eye, skin).alias("s2"),
        F.count(F.when(F.col(conc).isNull(), 1)).alias("n_missing"), F.count(conc).alias("__known"), *[c.alias(n) for n, c in (extra or {}).items()],
    )
    result = None
    for step in sorted({r[1] for r in CT_RULES if r[0] == endpoint}):
        own = [r for r in CT_RULES if r[:2] == (endpoint, step)]
        total = sum((r[3] * F.col("s1" if r[2] == strong else "s2") for r in own), F.lit(0.0))
        test = total >= own[0][4] - 1e-9
        result = F.when(test, own[0][5]) if result is None else result.when(test, own[0][5])
    return out.select(by, "s1", "s2", "n_missing", F.when(F.col("__known") > 0, result.otherwise("NC")).alias("category"), *(extra or {}))


def ct_rules(spark: SparkSession) -> DataFrame:
    """The rules as a table: endpoint, step, term, weight, cutoff, result."""
    return spark.createDataFrame(CT_RULES, "endpoint string, step int, term string, weight double, cutoff double, result string")


def additivity_by_table(rows: DataFrame, by: str, conc: str, rules: DataFrame, eye: str = "cat", skin: str = "skin") -> DataFrame:
    """endpoint, key, step, category for every mixture and endpoint of a table of rules.

    Ingredients are summed to a row for each mixture, with a sum for each term, before they meet the rules, a
    table of a few rows. The first step whose weighted sum reaches its cut-off counts; without one the category
    is NC, and null where no concentration is known.
    """
    sums = rows.groupBy(by).agg(*[term_sum(t, conc, eye, skin).alias(f"__{t}") for t in TERMS], F.count(conc).alias("__known"))
    held = F.create_map(*[x for t in TERMS for x in (F.lit(t), F.col(f"__{t}"))])
    sums = sums.select(by, "__known", held.alias("__sums"))
    step = rules.groupBy("endpoint", "step").agg(F.collect_list(F.struct("term", "weight")).alias("weights"), F.max("cutoff").alias("cutoff"), F.max("result").alias("result"))
    steps = step.groupBy("endpoint").agg(F.array_sort(F.collect_list(F.struct("step", "weights", "cutoff", "result"))).alias("__steps"))
    total = lambda r: F.aggregate(r["weights"], F.lit(0.0), lambda acc, w: acc + w["weight"] * F.element_at("__sums", w["term"]))
    met = F.filter("__steps", lambda r: total(r) >= r["cutoff"] - 1e-9)
    joined = sums.join(F.broadcast(steps)).withColumn("__first", F.try_element_at(met, F.lit(1)))  # a row an endpoint
    return joined.select("endpoint", by, F.col("__first.step").alias("step"), F.when(F.col("__known") > 0, F.coalesce("__first.result", F.lit("NC"))).alias("category"))
