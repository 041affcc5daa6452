"""Properties of the operators, and mutated inputs that checks must catch."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallowgrid.functions import scalars
from tallowgrid.operators import bootstrap, checks, folds, labels, matrix, metrics, mixtures, models, ranks, trees

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
SCORES = st.lists(st.tuples(st.integers(0, 1), st.sampled_from([-2.5, 0.0, 0.25, 1.0, 7.0, 1e6])), min_size=2, max_size=40)


def auc_by_pairs(rows):
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@FEW
@given(SCORES)
def test_auc_is_the_share_of_pairs_in_order(spark, rows):
    df = spark.createDataFrame(rows, "y int, s double")
    got = metrics.roc_auc(df, "y", "s").first()["auc"]
    turned = metrics.roc_auc(df.withColumn("s", -F.col("s")), "y", "s").first()["auc"]
    want = auc_by_pairs(rows)
    assert (got is None) == (want is None)
    if want is not None:
        assert got == pytest.approx(want) and got + turned == pytest.approx(1.0)


def test_auc_leaves_out_missing(spark):
    df = spark.createDataFrame([(1, 2.0), (0, 1.0), (None, 5.0), (1, None)], "y int, s double")
    assert tuple(metrics.roc_auc(df, "y", "s").first()) == (2, 1, 1.0)


@FEW
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 1)), min_size=1, max_size=30))
def test_mcc_is_alike_when_classes_swap(spark, rows):
    df = spark.createDataFrame(rows, "y int, p int")
    a = metrics.mcc(df, "y", "p").first()["mcc"]
    b = metrics.mcc(df.select((1 - F.col("y")).alias("y"), (1 - F.col("p")).alias("p")), "y", "p").first()["mcc"]
    assert (a is None and b is None) or a == pytest.approx(b)


def test_threshold_grid_counts_as_direct_counting_does(spark):
    rows = [(i % 2, (i * 37 % 101) / 100) for i in range(80)]
    df = spark.createDataFrame(rows, "y int, p double")
    for r in metrics.threshold_grid(df, "y", "p", [0.0, 0.3, 0.5, 1.0]).collect():
        assert r["tp"] == sum(y == 1 and p >= r["tau"] for y, p in rows)
        assert r["tn"] == sum(y == 0 and p < r["tau"] for y, p in rows)


def test_best_threshold_takes_the_lowest_on_ties(spark):
    grid = spark.createDataFrame([(0.1, 0.5), (0.2, 0.5), (0.3, None)], "tau double, mcc double")
    assert tuple(metrics.best_threshold(grid).first()) == (0.1, 0.5)


def test_equal_bins_are_ntile(spark):
    df = spark.createDataFrame([(i, float(i * 7 % 4)) for i in range(1, 23)], "k long, v double")
    got = {r["k"]: r["b"] for r in ranks.equal_bins(df, 4, "v", "k", "b").collect()}
    want = {r["k"]: r["b"] for r in df.selectExpr("k", "ntile(4) OVER (ORDER BY v, k) AS b").collect()}
    assert got == want
    tiny = {r["k"]: r["b"] for r in ranks.equal_bins(df.where("k < 3"), 4, "v", "k", "b").collect()}
    assert sorted(tiny.values()) == [1, 2]


def test_overlay_never_changes_an_original_and_a_ledger_may(spark):
    base = spark.createDataFrame([(1, "1"), (2, None), (3, None)], "s int, cat string")
    side = spark.createDataFrame([(1, "NC"), (2, "2A")], "s int, v string")
    got = {r["s"]: (r["cat_final"], r["source"]) for r in labels.apply_overlay(base, side, "s", "cat", "v").collect()}
    assert got == {1: ("1", "original"), 2: ("2A", "survey"), 3: (None, None)}
    got = {r["s"]: (r["cat_before"], r["cat_after"]) for r in labels.apply_ledger(base, side, "s", "cat", "v").collect()}
    assert got == {1: ("1", "NC"), 2: (None, "2A"), 3: (None, None)}


def test_restoring_never_hides_a_known_zero(spark):
    built = spark.createDataFrame([(1, True, 0.0, 5.0), (2, False, 0.0, None), (3, True, 4.0, None)], "f int, known boolean, a double, b double")
    read = lambda p: {r["f"]: (r["a"], r["b"]) for r in matrix.under_protocol(built, "f", "known", p, ["a"]).collect()}
    assert read("native_restored") == {1: (0.0, 5.0), 2: (None, None), 3: (4.0, None)}
    assert read("native") == {1: (0.0, 5.0), 2: (0.0, None), 3: (4.0, None)}
    assert read("nan0") == {1: (0.0, 5.0), 2: (0.0, 0.0), 3: (4.0, 0.0)}
    with pytest.raises(ValueError):
        matrix.under_protocol(built, "f", "known", "other", [])


def test_the_audit_catches_a_frozen_zero(spark):
    built = spark.createDataFrame([(1, True, 0.0), (2, False, 0.0)], "f int, known boolean, a double")
    found = matrix.column_profile(built, "f", "known").where("n_frozen_zero > 0").select(F.col("feature").alias("item"))
    declared = spark.createDataFrame([("b",)], "item string")
    got = {(r["item"], r["side"]) for r in labels.symmetric_difference(found, declared, "item").collect()}
    assert got == {("a", "audited"), ("b", "declared")}
    raw = spark.createDataFrame([(1, 0.0), (2, None)], "f int, a double")
    assert [r["f"] for r in matrix.invented(built, raw, "f", "a").collect()] == [2]


RULED = [
    ("a", "1", None, 3.0), ("b", "1", None, 1.0), ("c", "2A", None, 10.0), ("d", "2A", "2", 9.0), ("e", "1", "2", 0.5), ("e", "2B", None, 5.0), ("f", "1", "1", None),
    ("g", "1", None, None), ("g", "NC", "NC", 50.0), ("h", None, "1", 3.0), ("i", "2A", "1", 0.5), ("i", "2A", "2", 4.9), ("j", "NC", "1", 5.0), ("k", "2A", "2", 10.0), ("l", "2A", "3", 40.0),
]


def test_additivity_steps(spark):
    df = spark.createDataFrame(RULED, "f string, cat string, skin string, conc double")
    got = {r["f"]: (r["category"], r["n_missing"]) for r in mixtures.additivity(df, "f", "conc").collect()}
    # h, i, j: what burns skin counts as eye 1, and once.
    want = {"a": ("1", 0), "b": ("2A", 0), "c": ("2A", 0), "d": ("NC", 0), "e": ("2A", 0), "f": (None, 1), "g": ("NC", 1), "h": ("1", 0), "i": ("NC", 0), "j": ("1", 0), "k": ("2A", 0), "l": ("2A", 0)}
    assert got == want
    skin = {r["f"]: r["category"] for r in mixtures.additivity(df, "f", "conc", endpoint="skin").collect()}
    assert skin == {"a": "NC", "b": "NC", "c": "NC", "d": "NC", "e": "NC", "f": None, "g": "NC", "h": "2", "i": "NC", "j": "1", "k": "2", "l": "NC"}


def test_moments_of_one_ingredient_have_zero_spread(spark):
    df = spark.createDataFrame([("a", 4.0, None), ("b", 1.0, 1.0), ("b", 2.0, 3.0), ("b", 6.0, None)], "f string, v double, c double")
    got = {r["f"]: r.asDict() for r in mixtures.moments(df, "f", "v", "c").collect()}
    assert got["a"]["sd_pop"] == 0.0 and got["a"]["skew_pop"] == 0.0 and got["a"]["wmean"] is None
    m = 3.0
    sd = math.sqrt(((1 - m) ** 2 + (2 - m) ** 2 + (6 - m) ** 2) / 3)
    assert got["b"]["skew_pop"] == pytest.approx(((1 - m) ** 3 + (2 - m) ** 3 + (6 - m) ** 3) / 3 / sd**3) and got["b"]["wmean"] == 1.75


def test_lock_fails_on_nulls_and_lone_keys(spark):
    new = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 1.0)], "k string, v double")
    old = spark.createDataFrame([("a", 1.0 + 1e-10), ("b", 1.0), ("d", 1.0)], "k string, v double")
    assert {r["k"]: r["ok"] for r in metrics.lock_compare(new, old, "k", "v").collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_stratified_folds_keep_groups_together(spark):
    rows = spark.createDataFrame([(g, int((g * 13 + i) % 3 == 0)) for g in range(60) for i in range(1 + g % 5)], "g int, y int")
    found = folds.stratified_group_folds(rows, "g", "y", [0, 1])
    assert folds.spanning_groups(found, "group").count() == 0
    assert found.groupBy("seed").agg(F.count_distinct("fold").alias("n")).where("n <> 5").count() == 0
    share = rows.withColumn("group", F.col("g").cast("string")).join(found, "group").groupBy("seed", "fold").agg(F.avg("y").alias("p")).collect()
    assert max(r["p"] for r in share) - min(r["p"] for r in share) < 0.15
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, folds.stratified_group_folds(rows, "g", "y", [0, 1]).collect()))
    torn = spark.createDataFrame([(0, "a", 1), (0, "a", 2)], "seed int, group string, fold int")
    assert folds.spanning_groups(torn, "group").count() == 1


def test_missing_may_go_to_either_side_of_a_split(spark):
    # Missing lies with the high class, or with the low one: both can be learned.
    for far in (0, 1):
        rows = [(i, i % 2, 0, 1 - (i % 2) if far else i % 2, None if i % 4 == (1 if far else 0) else float(i % 2)) for i in range(80)]
        df = spark.createDataFrame([(k, y, x) for k, _, _, y, x in rows], "k int, y int, v double")
        assigned = df.select(F.lit(0).alias("seed"), (F.col("k") / 40).cast("int").alias("fold"), "k")
        got = models.out_of_fold(df, assigned, "k", "y", ["v"], trees=5)
        right = got.join(df.select("k", "y"), "k").where((F.col("p") >= 0.5).cast("int") == F.col("y")).count()
        assert right == 80


def test_forests_are_fitted_over_all_seeds_and_stratified_folds(spark, small_dir, monkeypatch):
    import inspect

    from tallowgrid.plans import queries

    given = {}
    whole = inspect.signature(models.out_of_fold)

    def seen(*args, **options):
        given.update(whole.bind(*args, **options).arguments)
        return given["assigned"].selectExpr("seed", "fold", "f", "0.5D AS p")

    monkeypatch.setattr(models, "out_of_fold", seen)
    queries.train_predict(spark, small_dir)
    assert given.get("trees", whole.parameters["trees"].default) == 100
    basis = queries._basis_rows(spark, small_dir)
    rows = given["assigned"].join(basis.select("f", "group"), "f").select("seed", "fold", "group", "f").collect()
    assert {(r["seed"], r["fold"]) for r in rows} == {(s, f) for s in range(5) for f in range(5)}
    assert len(rows) == len({(r["seed"], r["f"]) for r in rows}) == 5 * basis.count()
    assert given["rows"].count() == basis.join(queries.fx.matrix(spark, small_dir), "f", "left_semi").count()
    want = {(r["seed"], r["group"]): r["fold"] for r in queries.group_folds(spark, small_dir).collect()}
    assert all(want[r["seed"], r["group"]] == r["fold"] for r in rows)


def test_four_models_and_their_band(spark, small_dir, monkeypatch):
    """The four models, their columns and folds; and their metric rows against SQL over the predictions."""
    import duckdb

    from tallowgrid.plans import queries

    given, written = [], []

    def seen(rows, assigned, key, y, features, trees=100, **_):
        given.append((features, trees, assigned.select("seed", "fold").distinct().count()))
        noise = F.abs(F.hash(F.col(key), F.col("seed"))) % 100 / 100.0
        return assigned.join(rows.select(key), key).select("seed", "fold", key, (0.3 * noise + 0.35).alias("p"))

    real = queries.band
    monkeypatch.setattr(models, "out_of_fold", seen)
    monkeypatch.setattr(queries, "band", lambda p: written.append(p.toArrow()) or real(p))
    got = {(r["layer"], r["endpoint"]): r.asDict() for r in queries.headline_models(spark, small_dir).collect()}
    assert set(got) == {(a, b) for a in ("substance", "formulation") for b in ("eye", "skin")} and all(t == 100 and n == 25 for _, t, n in given)
    assert given[0][0] == given[1][0] == queries.fx.STRUCTURE_ONLY and not set(given[0][0]) & {"n_mixtures", "role_promo", "has_label"}
    con = duckdb.connect()
    con.register("predictions", written[0])
    rows = queries._auc_sql("SELECT layer, endpoint, seed, y, p AS score FROM predictions", "layer, endpoint, seed")
    for layer, endpoint, n, mean, low, high in con.sql(f"SELECT layer, endpoint, max(n), avg(auc), min(auc), max(auc) FROM ({rows}) GROUP BY layer, endpoint").fetchall():
        r = got[layer, endpoint]
        assert (r["n"], r["seeds"]) == (n, 5) and (r["auc_mean"], r["auc_min"], r["auc_max"]) == pytest.approx((mean, low, high), abs=1e-6)


def gini_tree(rows, depth, bins):
    """By hand: rows of (values, y); a nested tree of (feature, bin, missing, left, right) or a share."""
    ranges = [(min(v), max(v)) if (v := [r[0][k] for r in rows if r[0][k] is not None]) else None for k in range(len(rows[0][0]))]

    def cell(x, k):
        if x is None:
            return None
        low, high = ranges[k]
        return min(int(math.floor((x - low) / (high - low) * bins)), bins - 1) if high > low else 0

    cells = [([cell(x, k) for k, x in enumerate(v)], y) for v, y in rows]

    def impurity(own):
        p = sum(y for _, y in own) / len(own)
        return 2 * p * (1 - p)

    def grow(own, left):
        best = None
        for k in range(len(ranges)) if left else []:
            for b in range(bins):
                for missing in ("left", "right"):
                    if not any(c[k] == b for c, _ in own):
                        continue
                    goes = [missing == "left" if c[k] is None else c[k] <= b for c, _ in own]
                    one, two = [r for r, g in zip(own, goes, strict=True) if g], [r for r, g in zip(own, goes, strict=True) if not g]
                    if one and two:
                        gain = impurity(own) - len(one) / len(own) * impurity(one) - len(two) / len(own) * impurity(two)
                        best = min(best or (9,), (-round(gain + 1e-12, 9), f"x{k}", b, missing, one, two), key=lambda x: x[:4])
        if not best or best[0] > -1e-9:
            return sum(y for _, y in own) / len(own)
        return (*best[1:4], grow(best[4], left - 1), grow(best[5], left - 1))

    return grow(cells, depth)


def test_trees_with_missing_values_are_those_by_hand(spark):
    import random

    rng = random.Random(5)
    rows = []
    for i in range(240):
        v = [rng.choice([None, rng.random(), rng.random()]), rng.choice([None, float(rng.randrange(4))]), rng.random(), None]
        y = int((v[0] is None) ^ ((v[1] or 3.0) > 1.5) if rng.random() < 0.9 else rng.random() < 0.5)
        rows.append((i, v, y))
    names = [f"x{k}" for k in range(4)]
    df = spark.createDataFrame([(i, y, *v) for i, v, y in rows], "k int, y int, " + ", ".join(f"{n} double" for n in names))
    tree = trees.fit_tree(df, "k", "y", names, depth=3, bins=8)

    def nested(node=0):
        if node in tree["splits"]:
            return (*tree["splits"][node], nested(2 * node + 1), nested(2 * node + 2))
        return pytest.approx(tree["leaves"][node])

    assert gini_tree([(v, y) for _, v, y in rows], 3, 8) == nested() and len(tree["leaves"]) > 4
    assert any(m == "right" for _, _, m in tree["splits"].values()) or any(m == "left" for _, _, m in tree["splits"].values())
    p = {r["k"]: r["p"] for r in trees.predict_tree(df, "k", tree).collect()}
    assert sum((p[i] >= 0.5) == bool(y) for i, _, y in rows) > 190
    assert trees.fit_tree(df.limit(0), "k", "y", names)["splits"] == {}


def test_bootstrap_pairs_arms_and_keeps_groups(spark):
    rows = [(g, arm, (g + i) % 2, ((g + i) % 2 if arm == "A" or (g * 7 + i) % 3 else 1 - (g + i) % 2)) for g in range(30) for i in range(4) for arm in "AB"]
    df = spark.createDataFrame(rows, "g int, arm string, y int, pred int")
    counts = bootstrap.replicated_counts(df, "g", "y", "pred", ["arm"], 40)
    by = {(r["arm"], r["b"]): r for r in counts.collect()}
    # Both arms drew the same rows in every replicate.
    assert all(sum(by["A", b][c] for c in metrics.COUNTS) == sum(by["B", b][c] for c in metrics.COUNTS) for b in range(41))
    assert sum(by["A", 0][c] for c in metrics.COUNTS) == 120 and len({sum(by["A", b][c] for c in metrics.COUNTS) for b in range(41)}) > 10
    got = bootstrap.verdicts(bootstrap.paired_deltas(counts, [], "arm", "A"), [], "arm").first()
    assert got["delta"] < 0 and got["low"] < got["delta"] < got["high"] < 0 and not got["inside"] and got["replicates"] == 40
    same = bootstrap.verdicts(bootstrap.paired_deltas(counts.withColumn("arm", F.lit("A")).where("b < 0").unionByName(counts.where("arm = 'A'")).unionByName(counts.where("arm = 'A'").withColumn("arm", F.lit("C"))), [], "arm", "A"), [], "arm").first()
    assert same["delta"] == 0 and same["inside"]
    draws = spark.range(20_000).select(bootstrap.poisson_weight(F.col("id").cast("string")).alias("w")).groupBy("w").count().collect()
    share = {r["w"]: r["count"] / 20_000 for r in draws}
    assert share[0] == pytest.approx(math.exp(-1), abs=0.02) and share[1] == pytest.approx(math.exp(-1), abs=0.02) and share[2] == pytest.approx(math.exp(-1) / 2, abs=0.02)


def test_an_audit_that_finds_something_stops_the_job(spark, small_dir, monkeypatch):
    from tallowgrid.plans import queries

    none, some = spark.createDataFrame([], "item string, side string"), spark.createDataFrame([("a", "audited")], "item string, side string")
    checks.require_empty(none, "nothing")
    with pytest.raises(checks.Violation, match="declared differ.*'a', 'audited'"):
        checks.require_empty(some, "columns audited and declared differ")
    monkeypatch.setattr(queries, "audit_symdiff", lambda *_: some)
    with pytest.raises(checks.Violation):
        queries.train_predict(spark, small_dir)


def test_quotas_of_classes_balance(spark):
    classes = [(3, 0, 7), (0, 2, 11), (1, 1, 103), (5, 1, 1), (0, 0, 4)]
    quotas = folds.class_quotas(classes, 5)
    for p, q, n in classes:
        assert sum(quotas[p, q]) == n and max(quotas[p, q]) - min(quotas[p, q]) <= 1
    pos = [sum(p * quotas[p, q][k] for p, q, _ in classes) for k in range(5)]
    assert max(pos) - min(pos) <= 5
    rows = spark.createDataFrame([(g, 1, k) for g in range(3000) for k in range(1)], "g int, y int, k int")
    found = folds.stratified_group_folds(rows, "g", "y", [3, 0])
    assert sorted({(r["seed"], r["fold"], r["count"]) for r in found.groupBy("seed", "fold").count().collect()}) == [(s, f, 600) for s in (0, 3) for f in range(5)]
    assert folds.stratified_group_folds(rows.limit(0), "g", "y", [0]).count() == 0


def test_the_table_of_classes_is_bounded(spark, monkeypatch):
    import random

    rng = random.Random(1)
    sizes = [(rng.randrange(1, 4000), rng.randrange(1, 4000)) for _ in range(3000)] + [(70_000, 30_000), (0, 64), (64, 65)]
    seen, whole = [], folds.class_quotas
    monkeypatch.setattr(folds, "class_quotas", lambda classes, n: seen.append(len(classes)) or whole(classes, n))
    counts = spark.createDataFrame([(g, p, q) for g, (p, q) in enumerate(sizes)], "g int, p long, q long")
    rows = counts.select("g", F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col("p").alias("n")), F.struct(F.lit(0).alias("y"), F.col("q").alias("n")))).alias("r")).select("g", "r.y", F.explode(F.sequence(F.lit(1), F.greatest("r.n", F.lit(1)))).alias("i"))
    found = folds.stratified_group_folds(rows.where("i > 0").select("g", "y"), "g", "y", [0])
    held = found.join(counts, F.col("group") == F.col("g").cast("string")).groupBy("fold").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).collect()
    total = sum(r["p"] for r in held)
    assert seen[0] <= 45 * 45 < 3000 and len(held) == 5
    assert all(abs(r["p"] / total - 0.2) < 0.03 for r in held)
    got = {r["c"]: r["k"] for r in spark.createDataFrame([(c,) for c in (0, 1, 64, 65, 127, 128, 1000, 2**40 + 5)], "c long").select("c", folds.coarse(F.col("c")).alias("k")).collect()}
    assert got == {0: 0, 1: 1, 64: 64, 65: 64, 127: 112, 128: 128, 1000: 896, 2**40 + 5: 2**40}


def test_ranks_of_values_with_an_outlier(spark):
    values = [(i, float((i * 37) % 101) if i else 1e300) for i in range(400)]
    df = spark.createDataFrame(values, "k long, v double").repartition(5)
    got = [r["k"] for r in ranks.global_row_number(df, ["v", "k"], "at").orderBy("at").collect()]
    assert got == [k for k, _ in sorted(values, key=lambda x: (x[1], x[0]))]
    before = {r["v"]: r["n_before"] for r in ranks.running_before(df.groupBy("v").agg(F.count("*").alias("n")), [], "v", ["n"]).collect()}
    assert before == {v: sum(x < v for _, x in values) for v in {x for _, x in values}}


def test_rules_from_a_table_are_the_rules(spark):
    df = spark.createDataFrame(RULED, "f string, cat string, skin string, conc double")
    got = {(r["endpoint"], r["f"]): r["category"] for r in mixtures.additivity_by_table(df, "f", "conc", mixtures.ct_rules(spark)).collect()}
    for endpoint in ("eye", "skin"):
        for r in mixtures.additivity(df, "f", "conc", endpoint=endpoint).collect():
            assert got[endpoint, r["f"]] == r["category"]


def test_jurisdictions_that_map_alike():
    """The equalities that the published text states: one pair maps both endpoints alike, three map skin alike,
    three map eye alike."""
    from tallowgrid.plans import fixtures as fx

    of = lambda rows, jur: {c: y for j, c, y in rows if j == jur}
    eye, skin = (lambda j: of(fx.PROJECTION, j)), (lambda j: of(fx.SKIN_PROJECTION, j))
    assert eye("K_REACH") == eye("US_OSHA") == eye("UN_GHS") != eye("EU_CLP") and skin("K_REACH") == skin("US_OSHA") == skin("EU_CLP") != skin("UN_GHS")
    assert skin("UN_GHS")["3"] == 1 and skin("K_REACH")["3"] == 0 and eye("EU_CLP")["2B"] == 0 and eye("EU_CLP")["2"] is None


def test_arms_train_on_active_columns_only():
    from tallowgrid.plans import fixtures as fx

    active = {m[0] for m in fx.MANIFEST if m[4] == "ACTIVE"}
    arms = {a: set(fx.columns_of(a)) for a in ("A0", "A2", "A3")}
    assert all(c <= active and not any(x.startswith("f_ct_sens_") for x in c) for c in arms.values())
    assert arms["A3"] - arms["A2"] == {"f_ct_coverage"} and not any(c.startswith("f_ct_") for c in arms["A0"]) and any(c.startswith("f_ct0_") for c in arms["A0"])


def test_components_of_shapes(spark, monkeypatch):
    import random

    from tallowgrid.operators import groups, skew

    monkeypatch.setattr(skew, "HEAVY_ROWS", 50)
    rng = random.Random(2)
    shapes = [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 200)], [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], [(5, 5), (9, 5), (None, 4)], []]
    for edges in shapes:
        parent = {}

        def root(x, parent=parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a is not None and b is not None:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
        got = {r["node"]: r["component"] for r in groups.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
        assert got == {x: root(x) for x in list(parent)}


def test_a_hub_ingredient_and_folds_on_active_groups(spark, monkeypatch):
    from tallowgrid.operators import groups, skew

    monkeypatch.setattr(skew, "HEAVY_ROWS", 500)
    # 10,000 mixtures of one active ingredient, one of which ties a second; others stand alone or know nothing.
    rows = [(f, 1, 50.0) for f in range(10_000)] + [(7, 2, 50.0), (20_000, 2, 9.0), (20_000, 3, 8.0), (20_001, 3, 1.0), (20_002, 3, None)]
    df = spark.createDataFrame(rows, "f long, s long, conc double")
    active = groups.active_ingredients(df, "f", "s", "conc")
    found = groups.active_groups(df.select("f"), active, "f", "s")
    got = {r["f"]: r["group"] for r in found.collect()}
    assert len(got) == 10_003 and {got[f] for f in [*range(10_000), 20_000]} == {"i1"} and got[20_001] == "i3" and got[20_002] == "m20002"
    labelled = found.withColumn("y", (F.col("f") % 2).cast("int"))
    assert folds.spanning_groups(folds.stratified_group_folds(labelled, "group", "y", [0]), "group").count() == 0


def test_duplicates_among_608_columns(spark):
    import time

    names = [f"c{i:03}" for i in range(608)]
    rows = spark.range(200).select(F.col("id").alias("k"), *[((F.col("id") * (i % 300 + 1)) % 97 + (i % 300) * 1000.0).cast("double").alias(n) for i, n in enumerate(names)])
    rows = rows.withColumn("c001", F.when(F.col("k") != 3, F.col("c001"))).withColumn("c301", F.when(F.col("k") != 3, F.col("c301"))).withColumn("c302", F.when(F.col("k") != 5, F.col("c302")))
    began = time.time()
    got = {(r["a"], r["b"]) for r in matrix.duplicate_columns(rows, "k").where("all_equal").collect()}
    assert time.time() - began < 60
    want = {(names[i], names[j]) for i in range(608) for j in range(i + 1, 608) if i % 300 == j % 300} - {("c001", "c601"), ("c301", "c601"), ("c002", "c302"), ("c302", "c602")}
    assert got == want


def test_equal_fingerprints_are_verified(spark, monkeypatch):
    df = spark.createDataFrame([(1, 1.0, 1.0, 2.0), (2, None, None, 0.0)], "k int, a double, b double, c double")
    monkeypatch.setattr(matrix, "column_fingerprints", lambda m, key: spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "feature string, fingerprint int"))
    assert {(r["a"], r["b"]): r["all_equal"] for r in matrix.duplicate_columns(df, "k").collect()} == {("a", "b"): True, ("a", "c"): False, ("b", "c"): False}


@FEW
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.1, 0.298, 0.3, 0.5, 0.9]), st.integers(0, 2)), min_size=2, max_size=40))
def test_exact_thresholds(spark, rows):
    def mcc(pairs):
        tp, fp = sum(y and q for y, q in pairs), sum(q and not y for y, q in pairs)
        tn, fn = sum(not q and not y for y, q in pairs), sum(y and not q for y, q in pairs)
        low = math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
        return (tp * tn - fp * fn) / low if low else None

    def best(own):
        found = [(-round(m + 1e-10, 9), t) for t in {s for _, s, _ in own} if (m := mcc([(y, s >= t) for y, s, _ in own])) is not None]
        return min(found, default=(None, None))[1]

    df = spark.createDataFrame([(0, *r) for r in rows], "seed int, y int, s double, fold int")
    got = metrics.exact_threshold(df, "y", "s").first()
    assert (got["tau"] if got else None) == best(rows)
    for r in metrics.exact_fold_thresholds(df, "y", "s", "seed", "fold", folds=3).collect():
        others, own = [x for x in rows if x[2] != r["fold"]], [x for x in rows if x[2] == r["fold"]]
        assert r["tau"] == best(others)
        if r["tau"] is not None:
            want = mcc([(y, s >= r["tau"]) for y, s, _ in own])
            assert (want is None) == (r["mcc_held_out"] is None) and (want is None or r["mcc_held_out"] == pytest.approx(want))


def test_scalars(spark):
    df = spark.createDataFrame([("AAAAAAAAAAAAAA-BBBBBBBBBB-C", 1.5, "as_supplied", True, None), ("X", 7.0, "diluted", False, 2.0), (None, None, None, None, 0.0)], "k string, ph double, b string, known boolean, x double")
    got = df.select(
        scalars.skeleton_block(F.col("k")), scalars.ph_extreme(scalars.as_supplied(F.col("ph"), F.col("b"))), scalars.known_or_null(F.col("known"), F.col("x")), scalars.is_missing(F.col("x")), scalars.classify(F.col("x"))
    ).collect()
    assert [tuple(r) for r in got] == [("AAAAAAAAAAAAAA", True, 0.0, 1, None), ("X", None, None, 0, 1), (None, None, None, 0, 0)]


def test_filters_reach_the_scan(spark, small_dir):
    from tallowgrid.plans import fixtures

    plan = fixtures.overlay(spark, small_dir).select("s")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size,40)]" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan


def test_alert_tables(spark):
    from tallowgrid.operators import alerts

    texts = [(1, "abcabc xabcdx"), (2, None), (3, ""), (4, "bcd"), (1, "q" * 5000 + "abcd")]
    words = [("abc",), ("abcd",), ("bcd",), ("",), (None,), ("abc",), ("zzz",)]
    want = sorted((k, w) for k, t in texts for w in {w for (w,) in words if w} if t and w in t)
    df = spark.createDataFrame(texts, "k int, t string")
    for block in (50_000, 2):
        got = alerts.find_patterns(df, ["k"], "t", spark.createDataFrame(words, "w string"), "w", block)
        assert sorted(map(tuple, got.collect())) == want
    assert alerts.find_patterns(df, ["k"], "t", spark.createDataFrame([], "w string"), "w").count() == 0


def test_folding_decides_conflicts_and_says_so(spark):
    rows = [(1, "a", "NC", 1.0), (2, "a", "2A", None), (3, "a", None, 4.0), (4, "b", None, None), (5, "c", "1", 2.0), (6, "c", "1", 2.0)]
    folded, ledger = labels.folded_rows(spark.createDataFrame(rows, "s int, sk string, cat string, v double"), "s", "sk", "cat", ["1", "2A", "NC"], ["v"])
    got = {r["sk"]: (r["n"], r["first_s"], r["v"], r["cat"], r["conflict"]) for r in folded.collect()}
    assert got == {"a": (3, 1, 2.5, "2A", True), "b": (1, 4, None, None, False), "c": (2, 5, 2.0, "1", False)}
    assert sorted(map(tuple, ledger.collect())) == [("a", 1, "NC", False), ("a", 2, "2A", True)]


def test_nearest_fingerprints_are_those_of_all_pairs(spark, monkeypatch):
    import random

    from tallowgrid.operators import fingerprints

    monkeypatch.setattr(fingerprints, "BLOCK", 16)
    monkeypatch.setattr(fingerprints, "QUERY_BLOCK", 4)
    rng = random.Random(6)
    sets = {k: {rng.randrange(1024) for _ in range(rng.choice([0, 1, 5, 40, 300]))} for k in range(220)}
    sets |= {300: set(sets[7]), 301: set(sets[7]), 302: set(sets[9]) | {3}}
    df = spark.createDataFrame([(k, k % 3, len(v), sorted(v)) for k, v in sets.items()], "k long, fold int, ones int, bits array<int>").withColumn("fp", fingerprints.packed(F.col("bits")))
    for r in df.select("bits", "fp").limit(20).collect():
        assert {b for b in range(1024) if r["fp"][b // 64] >> (b % 64) & 1} == set(r["bits"])
    got = fingerprints.nearest(df, df.where("k % 2 = 0 OR k > 290"), "k").collect()
    asked = [k for k in sets if (k % 2 == 0 or k > 290) and sets[k]]
    score = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = {q: min((-score(q, c), c) for c in sets if sets[c] and c % 3 != q % 3) for q in asked}
    assert {r["query"]: (-r["score"], r["neighbour"]) for r in got} == {q: (pytest.approx(s), c) for q, (s, c) in want.items()}
    pairs = sum(sum(1 for c in sets if sets[c] and c % 3 != q % 3) for q in asked)
    assert sum(r["seen"] for r in got) < pairs
    assert fingerprints.nearest(df.limit(0), df.limit(0), "k").count() == 0


def test_copies_of_fingerprints_are_compared_once(spark, monkeypatch):
    """Rows of equal fingerprints cost one comparison, in whatever batches they come; a row of no fold is no candidate."""
    import random

    from tallowgrid.operators import fingerprints

    monkeypatch.setattr(fingerprints, "BLOCK", 64)
    monkeypatch.setattr(fingerprints, "QUERY_BLOCK", 32)
    monkeypatch.setattr(fingerprints, "COLUMNS", 8, raising=False)
    rng = random.Random(4)
    texts = [{rng.randrange(1024) for _ in range(rng.choice([1, 30, 60, 200, 1000]))} for _ in range(40)]
    # Thirty copies a text: of the first ten texts in two folds, of the others in one.
    sets = {k: (texts[k % 40], k % 40 % 3 + (k % 40 < 10 and k % 7 == 0) * 3) for k in range(1200)}
    rows = [(k, fold, len(s), sorted(s)) for k, (s, fold) in sets.items()] + [(5000, None, 5, [1, 2, 3, 4, 5])]
    df = spark.createDataFrame(rows, "k long, fold int, ones int, bits array<int>").withColumn("fp", fingerprints.packed(F.col("bits")))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["query"]: r for r in fingerprints.nearest(df, df.where("k % 20 < 10"), "k").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    asked = [k for k in sets if k % 20 < 10]
    like = [[len(a & b) / len(a | b) for b in texts] for a in texts]
    want = {q: min((-like[q % 40][c % 40], c) for c in sets if sets[c][1] != sets[q][1]) for q in asked}
    assert {q: (-r["score"], r["neighbour"]) for q, r in got.items()} == {q: (pytest.approx(s), c) for q, (s, c) in want.items()}
    assert max(r["seen"] for r in got.values()) <= 32 * 50  # one row counts for a block of queries; 50 classes at most


def test_ingredient_rows_are_dealt_by_number(spark, small_dir, monkeypatch):
    """Tasks of bounded rows however rows are compressed, and one shuffle of them for shares and sums."""
    from tallowgrid import session
    from tallowgrid.plans import queries

    monkeypatch.setattr(session, "TASK_ROWS", 500)
    held = queries.fx.ingredients(spark, small_dir).groupBy(F.spark_partition_id()).count().collect()
    assert len(held) >= 10 and max(r["count"] for r in held) <= 1000
    rows = queries.fx.matrix(spark, small_dir)
    assert rows.rdd.getNumPartitions() == -(-queries.table(spark, small_dir, "lineitem").count() // 500)


def test_forests_grow_together_over_cells_of_equal_rows(spark, monkeypatch):
    """Copies of rows are counted, not multiplied; and a signal of two columns is found out of fold."""
    rows = [(c * 100 + k, int(k % 10 > 4) ^ int(k // 10 > 4), float(k % 10), None if k % 7 == 0 and k // 10 > 4 else float(k // 10)) for c in range(40) for k in range(100)]
    df = spark.createDataFrame(rows, "k int, y int, a double, b double")
    assigned = df.select(F.explode(F.array(F.lit(0), F.lit(3))).alias("seed"), (F.col("k") / 100 % 5).cast("int").alias("fold"), "k")
    written, real = {}, models.settle
    monkeypatch.setattr(models, "settle", lambda d, tag: written.setdefault(tag, real(d, tag)))
    got = models.out_of_fold(df, assigned, "k", "y", ["a", "b"], trees=10)
    assert got.count() == got.select("seed", "k").distinct().count() == 8000
    assert written["forest-cells"].count() == 2 * 5 * 100 and written["forest-cells"].agg(F.sum("n")).first()[0] == 8000
    right = got.join(df.select("k", "y"), "k").where((F.col("p") >= 0.5).cast("int") == F.col("y")).count()
    assert right >= 7600


def test_the_join_with_substances_sorts_no_ingredient_rows(spark):
    """However many rows a task gets it holds its substances alone; rows without a substance stay."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = mixtures.ingredient_rows(spark.range(700).selectExpr("id AS f", "id % 7 AS s"), spark.range(5).selectExpr("id AS s", "id * 10 AS x"))
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
        assert {(r["s"], r["x"], r["count"]) for r in found.groupBy("s", "x").count().collect()} == {(s, s * 10 if s < 5 else None, 100) for s in range(7)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_variants_grow_in_one_pass(spark, monkeypatch):
    """Models of the same rows share cells, blocks and levels; a variant is the forest that it would be alone."""
    rows = [(k, int(k % 10 > 4), float(k % 10), None if k % 7 == 0 else float(k // 10 % 10), float(k % 3)) for k in range(600)]
    df = spark.createDataFrame(rows, "k int, y int, a double, b double, c double")
    assigned = df.select(F.lit(0).alias("seed"), (F.col("k") / 10 % 5).cast("int").alias("fold"), "k")
    passes, real = [], models._sums
    monkeypatch.setattr(models, "_sums", lambda *args: passes.append(1) or real(*args))
    variants = {"all": (["a", "b", "c"], True), "filled": (["a", "c"], False), "one": (["b"], True)}
    got = models.out_of_fold_each(df, assigned, "k", "y", variants, trees=6, depth=3)
    by = {v: {r["k"]: r["p"] for r in got.where(F.col("variant") == v).collect()} for v in variants}
    assert len(passes) <= 3 and all(len(p) == 600 for p in by.values())
    alone = {r["k"]: r["p"] for r in models.out_of_fold(df, assigned, "k", "y", ["a", "b", "c"], trees=6, depth=3).collect()}
    assert by["all"] == alone
    assert all(sum((by[v][k] >= 0.5) == bool(y) for k, y, *_ in rows) > 560 for v in ("all", "filled"))


def test_arms_and_protocols_are_grown_together(spark, small_dir, monkeypatch):
    """Metrics of 3 protocols and 3 arms take one growth of forests a mapping of labels; trained arms take one."""
    from tallowgrid.plans import queries

    grown = []

    def seen(rows, assigned, key, y, variants, **options):
        grown.append((variants, options))
        names = F.explode(F.array(*map(F.lit, variants))).alias("variant")
        return assigned.join(rows.select(key, *{c for used, _ in variants.values() for c in used}), key).select(names, "seed", "fold", key, (F.abs(F.hash(F.col(key))) % 100 / 100.0).alias("p"))

    monkeypatch.setattr(models, "out_of_fold_each", seen)
    found = queries.model_metrics(spark, small_dir).collect()
    assert len(found) == len({(r["jur"], r["protocol"], r["arm"]) for r in found}) == 36 and sum(r["headline"] for r in found) == 1
    assert len(grown) == 2 and all(len(v) == 9 and o == {"trees": 20} for v, o in grown)
    for variants, _ in grown:
        assert {n: len(used) for n, (used, _) in variants.items()} == {f"{p}+{a}": len(queries.fx.columns_of(a)) for p in matrix.PROTOCOLS for a in queries.ARMS}
        assert all(native == (not n.startswith("nan0")) for n, (_, native) in variants.items())
        assert "conc_total_frozen" in variants["native+A2"][0] and "conc_total_frozen@native_restored" in variants["native_restored+A2"][0]
    grown.clear()
    assert {r["arm"] for r in queries.arm_verdicts(spark, small_dir).collect()} == {"A2", "A3"}
    assert [v for v, _ in grown] == [{a: (queries.fx.columns_of(a), True) for a in queries.ARMS}]


def test_weights_of_cells_are_poisson():
    """Looked up or not, the sum of a cell's draws has its count as mean and variance."""
    import numpy as np

    n = np.sort(np.concatenate([np.repeat([1, 2, 9, 100, 3000], 20_000), np.arange(101, 131)]))
    runs, rest = models._runs(n)
    assert [m for m, _, _ in runs] == [1, 2, 9, 100] and len(rest) == 20_030
    w = models._weights(np.random.Generator(np.random.SFC64(5)), n, runs, rest).astype(float)
    for mean in (1, 2, 9, 100, 3000):
        own = w[n == mean]
        assert own.mean() == pytest.approx(mean, abs=5 * math.sqrt(mean / len(own))) and own.var() == pytest.approx(mean, rel=0.06)
    share = [math.exp(-1) / math.factorial(k) for k in range(4)]
    assert [(w[n == 1] == k).mean() for k in range(4)] == pytest.approx(share, abs=0.02)


def test_thresholds_are_quantiles_or_all_values(spark, monkeypatch):
    df = spark.range(5000).selectExpr("CAST(id AS double) AS a", "CAST(id % 3 AS double) AS b", "CAST(NULL AS double) AS c", "if(id % 2 = 0, CAST(id AS double), NULL) AS d")
    want = [math.ceil(5000 * i / 32) - 1 for i in range(1, 32)]
    assert models.thresholds(df, ["a", "b", "c", "d"])["a"] == want
    got = models.thresholds(df, ["a", "b", "c", "d"])
    assert got["b"] == [0.0, 1.0] and got["c"] == [] and len(got["d"]) == 31 and all(v % 2 == 0 for v in got["d"])
    monkeypatch.setattr(models, "POINTS", 500)
    assert all(abs(v - w) <= 5000 / 500 for v, w in zip(models.thresholds(df, ["a"])["a"], want, strict=True))


def test_the_audited_matrix_is_built_once(spark, small_dir, monkeypatch):
    from tallowgrid.plans import queries

    built, real = [], queries.fx.matrix
    monkeypatch.setattr(queries.fx, "matrix", lambda *args: built.append(1) or real(*args))
    monkeypatch.setattr(models, "out_of_fold", lambda rows, assigned, *_, **__: assigned.selectExpr("seed", "fold", "f", "0.5D AS p"))
    queries.train_predict(spark, small_dir)
    assert len(built) == 1
