"""One query for each operator of the engine, with its SQL oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallowgrid.functions import scalars
from tallowgrid.functions.scalars import comparable as c6
from tallowgrid.operators import alerts, bootstrap, checks, fingerprints, folds, groups, labels, matrix, metrics, mixtures, models, ranks, trees
from tallowgrid.plans import fixtures as fx
from tallowgrid.session import settle, shared_root, table
from tallowgrid.sources import files, lookups, published, reports, xlsx

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SEEDS = [0, 1, 2, 3, 4]
JURISDICTIONS = ["UN_GHS", "EU_CLP", "K_REACH", "US_OSHA"]
ARMS = ["A0", "A2", "A3"]
BASIS = "K_REACH"
#: Alert patterns, within what RE2 and Java read alike.
ALERTS = {"has_digit": "[0-9]", "has_mail": "[a-z0-9.]+@[a-z0-9.]+", "has_shout": "[A-Z]{5,}", "has_table": " [|] "}


def query(sql: str | None = None, prelude: bool = True):
    """Register a query under its function's name; ``sql`` follows the views of the prelude."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (fx.PRELUDE if prelude else "") + sql
        return f

    return register


def rounded(df: DataFrame) -> DataFrame:
    """All doubles rounded for comparison."""
    return df.select(*[c6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _r(*names: str) -> str:
    return ", ".join(f"round({n} + 1e-10, 6) AS {n.split('.')[-1]}" for n in names)


# --- sources -----------------------------------------------------------------------------------


@query("SELECT (o_custkey % 4)::INTEGER AS source, count(*) AS n, round(sum(o_totalprice) + 1e-10, 6) AS total FROM orders GROUP BY 1", prelude=False)
def scan_union_sources(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    parts = [orders.where(F.col("o_custkey") % 4 == k).select("o_orderkey", "o_totalprice", F.lit(k).alias("source")) for k in range(4)]
    return rounded(labels.union_sources(parts).groupBy("source").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")))


@query("SELECT s, skeleton, role, cat, price FROM substances")
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_root(spark)}/csv-{uuid.uuid4().hex}"
    rows = fx.substances(spark, sf).select("s", "skeleton", "role", "cat", "price")
    files.write_csv(rows, path)
    return files.read_csv(spark, path, rows.schema)


@query("SELECT s AS p_partkey FROM substances WHERE cat IS NULL AND s NOT IN (SELECT s FROM overlay)")
def lookup_misses(spark: SparkSession, sf: str) -> DataFrame:
    wanted = fx.substances(spark, sf).where("cat IS NULL")
    return lookups.split_lookup(wanted, fx.overlay(spark, sf), "s")[1].select(F.col("s").alias("p_partkey"))


@query("SELECT s AS p_partkey, survey_cat FROM substances JOIN overlay USING (s) WHERE cat IS NULL")
def lookup_hits(spark: SparkSession, sf: str) -> DataFrame:
    wanted = fx.substances(spark, sf).where("cat IS NULL")
    return lookups.split_lookup(wanted, fx.overlay(spark, sf), "s")[0].select(F.col("s").alias("p_partkey"), "survey_cat")


@query("SELECT p_partkey, split_part(concat(p_brand, '-', p_name, '-', p_type), '-', 1) AS skeleton FROM part", prelude=False)
def skeleton_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", scalars.skeleton_block(F.concat_ws("-", "p_brand", "p_name", "p_type")).alias("skeleton"))


_SUBMITTED = "submitted AS (SELECT 'a' AS member, f, category FROM formulations UNION ALL SELECT 'b', f, CASE WHEN f % 3 = 0 THEN 'NC' ELSE category END FROM formulations WHERE f % 10 = 0 UNION ALL SELECT 'c', f, category FROM formulations WHERE f % 7 = 0 UNION ALL SELECT 'd', f, '1' FROM formulations WHERE f % 70 = 0)"


@query(f", {_SUBMITTED} SELECT f, count(*) AS n_submitted, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM submitted WHERE category IS NOT NULL GROUP BY f HAVING count(DISTINCT category) > 1")
def consolidation_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Formulations on which four members' submissions disagree, from one scan."""
    entry = lambda member, category, test: F.when(test, F.struct(F.lit(member).alias("member"), category.alias("category")))
    f, own = F.col("f"), F.col("category")
    parts = F.array(entry("a", own, F.lit(True)), entry("b", F.when(f % 3 == 0, "NC").otherwise(own), f % 10 == 0), entry("c", own, f % 7 == 0), entry("d", F.lit("1"), f % 70 == 0))
    rows = fx.formulations(spark, sf).select("f", F.explode(parts).alias("r")).where("r IS NOT NULL").select("f", "r.member", "r.category")
    return labels.consolidation_conflicts(rows, "f", "category")


@query()
def l0_hash_check(spark: SparkSession, sf: str) -> DataFrame:
    return files.file_hashes(spark, sf, "*.parquet")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier", prelude=False)
def xlsx_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A small table as a workbook, and read back with its schema."""
    import pyarrow.fs as pafs

    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    uri = f"{shared_root(spark)}/books-{uuid.uuid4().hex}/supplier.xlsx"
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(xlsx.write_xlsx(rows))
    spark.dataSource.register(xlsx.XlsxSource)
    return spark.read.format("tallowgrid_xlsx").schema(rows.schema).option("path", uri).load()


@query("SELECT 'job_a' AS job, s, cat FROM substances WHERE s % 2 = 0 UNION ALL SELECT 'job_b', s, cat FROM substances WHERE s % 2 = 1")
def isolated_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Two jobs write a table of one name, each below its own folder."""
    root, rows = f"{shared_root(spark)}/outputs-{uuid.uuid4().hex}", fx.substances(spark, sf).select("s", "cat")
    paths = {job: files.write_output(rows.where(F.col("s") % 2 == k), root, job, "substances") for k, job in enumerate(("job_a", "job_b"))}
    return labels.union_sources([spark.read.schema(rows.schema).parquet(p).select(F.lit(job).alias("job"), "s", "cat") for job, p in paths.items()])


@query(f"SELECT f, {_r('f_ct_sens_a', 'f_ct_sens_b')} FROM matrix")
def frozen_archive(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of a retired endpoint, kept with the key and read back."""
    root = f"{shared_root(spark)}/archive-{uuid.uuid4().hex}"
    return rounded(spark.read.parquet(files.archive(fx.matrix(spark, sf), root, "sens", "f_ct_sens_", "f")))


@query("SELECT r_regionkey + 3 AS line, '| ' || r_regionkey || ' | ' || r_name || ' |' AS text FROM region UNION ALL SELECT 1, '| r_regionkey | r_name |' UNION ALL SELECT 2, '|---|---|'", prelude=False)
def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    text = reports.markdown(table(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"))
    return spark.createDataFrame([(k, x) for k, x in enumerate(text.splitlines(), 1)], "line int, text string")


_ALL = ["n_ing", "conc_total", "conc_total_frozen", "conc_total_twin", "conc_mean", "conc_max", "size_mean", "price_mean", "f_ct0_eye_s1", "f_ct0_eye_s2", "f_ct0_skin_s1", "f_ct0_skin_s2", "f_ct_eye_s1", "f_ct_eye_s2", "f_ct_skin_s1", "f_ct_skin_s2", "f_ct_coverage", "f_ct_sens_a", "f_ct_sens_b", "unit"]


def _long(rows: str, more: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {more}'{c}' AS feature, {c} AS value FROM {rows}" for c in _ALL)


_RULES = {"negative": "conc_total < 0", "beyond": "conc_total > 100 + 1e-6", "counted": "n_ing < 1"}


def _checked(spark: SparkSession, sf: str, planted: bool) -> DataFrame:
    rows = fx.matrix(spark, sf).select("f", "n_ing", "conc_total")
    return rows.withColumn("conc_total", F.when(F.col("f") % 50 == 0, -F.col("conc_total")).otherwise(F.col("conc_total"))) if planted else rows


@query(f"SELECT f, n_ing, {_r('conc_total')} FROM matrix")
def published_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table that is checked in the pass that writes it, published, and read back through its manifest."""
    root = f"{shared_root(spark)}/published-{uuid.uuid4().hex}"
    published.publish(_checked(spark, sf, False), root, "totals", {k: F.expr(v) for k, v in _RULES.items()})
    return rounded(published.read_published(spark, root, "totals"))


@query("SELECT 'totals' AS name, count(*) FILTER (WHERE f % 50 = 0 AND -conc_total < 0) AS n_negative, 0::BIGINT AS n_versions FROM matrix")
def publish_blocked(spark: SparkSession, sf: str) -> DataFrame:
    """The same with planted negative totals: what the pass counted, and that no version came of it."""
    root = f"{shared_root(spark)}/published-{uuid.uuid4().hex}"
    try:
        published.publish(_checked(spark, sf, True), root, "totals", {k: F.expr(v) for k, v in _RULES.items()})
        raise AssertionError("a planted fault was published")
    except checks.Violation as e:
        n = e.counts["negative"]
    versions = published.versions(spark, root, "totals")
    return versions.agg(F.lit("totals").alias("name"), F.lit(n).cast("long").alias("n_negative"), F.count("*").alias("n_versions"))


_UPSERTED = (
    "u AS (SELECT s, 1::BIGINT AS stamp, cat AS found FROM substances WHERE s % 2 = 0 UNION ALL SELECT s, 2, 'NC' FROM substances WHERE s % 6 = 0 UNION ALL SELECT s, 1, '1' FROM substances WHERE s % 5 = 0)"
)


@query(f", {_UPSERTED} SELECT s, stamp, found FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY stamp DESC, found DESC NULLS LAST) AS k FROM u) WHERE k = 1")
def lookup_cache_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """Lookups put into a cache three times, the second time twice: the last of each key stays."""
    path, base = f"{shared_root(spark)}/cache-{uuid.uuid4().hex}", fx.substances(spark, sf)
    puts = [(base.where("s % 2 = 0"), 1, F.col("cat")), (base.where("s % 6 = 0"), 2, F.lit("NC")), (base.where("s % 6 = 0"), 2, F.lit("NC")), (base.where("s % 5 = 0"), 1, F.lit("1"))]
    for rows, at, value in puts:
        lookups.upsert(rows.select("s", F.lit(at).cast("long").alias("stamp"), value.alias("found")), path, "s", "stamp", buckets=8)
    return lookups.read_cache(spark, path).select("s", "stamp", "found")


_LINE = "CASE WHEN p_partkey % 97 = 0 THEN p_partkey || ',x' || p_size || ',' || p_name WHEN p_partkey % 101 = 0 THEN p_partkey || ',' || p_size || ',' || p_name || ',more' WHEN p_partkey % 89 = 0 THEN p_partkey || ',' || p_size ELSE p_partkey || ',' || p_size || ',' || p_name END"


@query(
    f"SELECT reason, count(*) AS n, string_agg(line, ';' ORDER BY line) AS lines FROM (SELECT {_LINE} AS line, CASE WHEN p_partkey % 97 = 0 THEN 'size is no int' WHEN p_partkey % 101 = 0 THEN 'fields too many' WHEN p_partkey % 89 = 0 THEN 'fields missing' ELSE 'good' END AS reason FROM part) WHERE reason <> 'good' GROUP BY reason "
    "UNION ALL SELECT 'good', count(*), NULL FROM part WHERE p_partkey % 97 <> 0 AND p_partkey % 101 <> 0 AND p_partkey % 89 <> 0",
    prelude=False,
)
def rejected_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A submission with broken lines: good rows go on, the others to a ledger by reason."""
    path = f"{shared_root(spark)}/submitted-{uuid.uuid4().hex}"
    table(spark, sf, "part").selectExpr(f"{_LINE} AS value").write.text(path)
    schema = spark.createDataFrame([], "k long, size int, name string").schema
    good, bad = files.read_csv_split(spark, path, schema, header=False)
    ledger = bad.groupBy("reason").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("line")), ";").alias("lines"))
    return ledger.unionByName(good.agg(F.lit("good").alias("reason"), F.count("*").alias("n"), F.lit(None).cast("string").alias("lines")))


@query()
def original_tree_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Originals as trees of hashes of ranges of 1 MB, by as many tasks as there are ranges."""
    return files.roots(files.tree_hashes(files.range_hashes(spark, sf, "*.parquet", 1 << 20)))


@query(
    "WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS pattern FROM benchmark) SELECT pattern, count(*) AS n_docs FROM words JOIN documents ON contains(text, pattern) GROUP BY pattern",
    prelude=False,
)
def alert_table(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents hold each word of a table of alerts, all words in one pass over each text."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("pattern"))
    found = alerts.find_patterns(table(spark, sf, "documents"), ["doc_id"], "text", words, "pattern")
    return found.groupBy("pattern").agg(F.count("*").alias("n_docs"))


# --- selection ---------------------------------------------------------------------------------

_KEPT = [c for c in _ALL if c not in fx.FEAT_DROP and not c.startswith(tuple(fx.DROP_PREFIXES))]
_LANE2 = [m[0] for m in fx.MANIFEST if m[2] == "L2" and m[4] == "ACTIVE"]


@query(f"SELECT f, known, {_r(*_KEPT)} FROM matrix")
def feature_drop(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(matrix.drop_features(fx.matrix(spark, sf), fx.FEAT_DROP, fx.DROP_PREFIXES))


@query(f"SELECT f, {_r(*[c for c in _ALL if c in _LANE2])} FROM matrix")
def lane_select(spark: SparkSession, sf: str) -> DataFrame:
    lane = fx.manifest(spark).where("lane = 'L2' AND state = 'ACTIVE' AND NOT from_label").select("feature")
    return rounded(matrix.select_features(fx.matrix(spark, sf), "f", [r["feature"] for r in lane.collect()]))


@query("SELECT doc_id, quality, toxic FROM documents JOIN labels USING (doc_id)", prelude=False)
def labelled_only(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "quality", "toxic")


@query(f"SELECT feature, count(DISTINCT round(value + 1e-10, 6)) AS n_distinct, count(DISTINCT round(value + 1e-10, 6)) <= 1 AS dead FROM ({_long('matrix')}) GROUP BY feature")
def dead_columns(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.dead_columns(rounded(fx.matrix(spark, sf).drop("known")), "f")


_PAIRS = [(a, b) for i, a in enumerate(sorted(_ALL)) for b in sorted(_ALL)[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, bool_and(round({a} + 1e-10, 6) IS NOT DISTINCT FROM round({b} + 1e-10, 6)) AS all_equal FROM matrix" for a, b in _PAIRS))
def duplicate_columns(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.duplicate_columns(rounded(fx.matrix(spark, sf).drop("known")), "f")


@query(
    "SELECT jur, count(y) AS n_kept, count(*) - count(y) AS n_excluded FROM (SELECT CASE WHEN cat = '2A' AND s % 5 = 0 THEN '2' ELSE cat END AS category FROM substances WHERE cat IS NOT NULL) JOIN projection USING (category) GROUP BY jur"
)
def ambiguous_exclude(spark: SparkSession, sf: str) -> DataFrame:
    undivided = F.when((F.col("cat") == "2A") & (F.col("s") % 5 == 0), "2").otherwise(F.col("cat"))
    found = labels.project(fx.substances(spark, sf).where("cat IS NOT NULL").select(undivided.alias("category")), fx.projection(spark))
    return found.groupBy("jur").agg(F.count("y").alias("n_kept"), (F.count("*") - F.count("y")).alias("n_excluded"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN value END AS reading FROM events", prelude=False)
def as_supplied_only(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", scalars.as_supplied(F.col("value"), F.col("event_type"), "view").alias("reading"))


@query(
    "SELECT feature, CASE WHEN from_label THEN 'label-derived' ELSE 'not structure-derived' END AS violation FROM manifest WHERE state = 'ACTIVE' AND (from_label OR (layer = 'substance' AND family NOT IN ('descriptor', 'structure')))"
)
def quarantine_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _quarantine(fx.manifest(spark))


def _quarantine(manifest: DataFrame) -> DataFrame:
    violation = F.when(F.col("from_label"), "label-derived").when((F.col("layer") == "substance") & ~F.col("family").isin("descriptor", "structure"), "not structure-derived")
    return manifest.where("state = 'ACTIVE'").select("feature", violation.alias("violation")).where("violation IS NOT NULL")


_PLANTED = "(SELECT * FROM manifest UNION ALL SELECT 'planted_label', 'label_document', 'L1', 'formulation', 'ACTIVE', TRUE UNION ALL SELECT 'planted_composition', 'composition', 'L3', 'substance', 'ACTIVE', FALSE)"


@query(
    f"SELECT feature, CASE WHEN from_label THEN 'label-derived' ELSE 'not structure-derived' END AS violation FROM {_PLANTED} WHERE state = 'ACTIVE' AND (from_label OR (layer = 'substance' AND family NOT IN ('descriptor', 'structure')))"
)
def quarantine_planted(spark: SparkSession, sf: str) -> DataFrame:
    """The quarantine check on a manifest with two faults."""
    planted = [("planted_label", "label_document", "L1", "formulation", "ACTIVE", True), ("planted_composition", "composition", "L3", "substance", "ACTIVE", False)]
    return _quarantine(fx.manifest(spark).unionByName(spark.createDataFrame(planted, fx.manifest(spark).schema)))


@query(
    "SELECT arm, feature FROM manifest, (VALUES ('A0'), ('A2'), ('A3')) a(arm) WHERE NOT from_label AND layer = 'formulation' AND state = 'ACTIVE' AND feature NOT IN ('conc_total_twin', 'unit') "
    "AND (family NOT LIKE 'additivity%' OR (family = 'additivity_original' AND arm = 'A0') OR (family = 'additivity' AND arm <> 'A0') OR (family = 'additivity_coverage' AND arm = 'A3'))"
)
def arm_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of each arm: the additive rule's sums from original categories (A0), with the survey (A2), and
    with the coverage (A3)."""
    return fx.arm_columns(spark)


@query("SELECT state, count(*) AS n, state = 'ACTIVE' AS used FROM manifest GROUP BY state")
def promotion_filter(spark: SparkSession, sf: str) -> DataFrame:
    return fx.manifest(spark).groupBy("state").agg(F.count("*").alias("n")).withColumn("used", F.col("state") == "ACTIVE")


_GRID = (
    "SELECT jur, protocol, arm, (jur = 'K_REACH' AND protocol = 'native_restored' AND arm = 'A2')::INTEGER AS headline FROM "
    f"(VALUES {fx._values([(j,) for j in JURISDICTIONS])}) a(jur), (VALUES {fx._values([(p,) for p in matrix.PROTOCOLS])}) b(protocol), (VALUES {fx._values([(x,) for x in ARMS])}) c(arm)"
)


@query(_GRID, prelude=False)
def arm_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Literal tables only: their product has a fixed size."""
    of = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    grid = of("jur", JURISDICTIONS).crossJoin(of("protocol", matrix.PROTOCOLS)).crossJoin(of("arm", ARMS))
    basis = (F.col("jur") == BASIS) & (F.col("protocol") == "native_restored") & (F.col("arm") == "A2")
    return grid.withColumn("headline", basis.cast("int"))


@query(_GRID + " ORDER BY headline DESC", prelude=False)
def headline_flag(spark: SparkSession, sf: str) -> DataFrame:
    return arm_grid(spark, sf).orderBy(F.desc("headline"), "jur", "protocol", "arm")


# --- joins and labels --------------------------------------------------------------------------


@query(f"SELECT f, s, role, {_r('conc')}, cat FROM ingredients")
def ingredient_join(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fx.ingredients(spark, sf).select("f", "s", "role", "conc", "cat"))


@query("SELECT s AS p_partkey, cat AS cat_orig, coalesce(cat, survey_cat) AS cat_final, CASE WHEN cat IS NOT NULL THEN 'original' WHEN survey_cat IS NOT NULL THEN 'survey' END AS source FROM substances LEFT JOIN overlay USING (s)")
def overlay_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    found = labels.apply_overlay(fx.substances(spark, sf), fx.overlay(spark, sf), "s", "cat", "survey_cat")
    return found.select(F.col("s").alias("p_partkey"), F.col("cat").alias("cat_orig"), "cat_final", "source")


@query("SELECT f, category AS category_before, CASE WHEN f % 100 = 0 THEN 'NC' WHEN f % 50 = 0 THEN '2A' ELSE category END AS category_after FROM formulations")
def review_overrides(spark: SparkSession, sf: str) -> DataFrame:
    base = fx.formulations(spark, sf).select("f", "category")
    ledgers = [base.where(F.col("f") % 100 == 0).select("f", F.lit("NC").alias("decision")), base.where(F.col("f") % 100 == 50).select("f", F.lit("2A").alias("decision"))]
    return labels.apply_ledger(base, labels.union_sources(ledgers), "f", "category", "decision")


@query("SELECT jur, category, y, count(*) AS n FROM formulations JOIN projection USING (category) GROUP BY ALL")
def jurisdiction_projection(spark: SparkSession, sf: str) -> DataFrame:
    # A row a category before the labels are multiplied by jurisdictions.
    counted = fx.formulations(spark, sf).groupBy("category").agg(F.count("*").alias("n"))
    return labels.project(counted, fx.projection(spark)).select("jur", "category", "y", "n")


@query("SELECT endpoint, jur, category, y, count(*) AS n FROM endpoint_labels JOIN endpoint_projection USING (endpoint, category) WHERE layer = 'formulation' GROUP BY ALL")
def endpoint_projection(spark: SparkSession, sf: str) -> DataFrame:
    counted = fx.endpoint_labels(spark, sf).where("layer = 'formulation'").groupBy("endpoint", "category").agg(F.count("*").alias("n"))
    return labels.project_endpoints(counted, fx.endpoint_projection(spark)).select("endpoint", "jur", "category", "y", "n")


@query(f"SELECT layer, endpoint, jur, n, {_r('prevalence')} FROM (SELECT layer, endpoint, jur, count(*) AS n, avg(y) AS prevalence FROM endpoint_labels JOIN endpoint_projection USING (endpoint, category) WHERE y IS NOT NULL GROUP BY ALL)")
def endpoint_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    counted = fx.endpoint_labels(spark, sf).groupBy("layer", "endpoint", "category").agg(F.count("*").alias("n"))
    found = labels.project_endpoints(counted, fx.endpoint_projection(spark)).where("y IS NOT NULL")
    return rounded(found.groupBy("layer", "endpoint", "jur").agg(F.sum("n").alias("n"), scalars.ratio(F.sum(F.col("n") * F.col("y")), F.sum("n")).alias("prevalence")))


@query(
    "SELECT mapping, string_agg(jur, '+' ORDER BY jur) AS jurisdictions FROM (SELECT jur, string_agg(category || '=' || coalesce(y::VARCHAR, 'excluded'), ';' ORDER BY category || '=' || coalesce(y::VARCHAR, 'excluded')) AS mapping FROM projection GROUP BY jur) GROUP BY mapping"
)
def jurisdiction_equivalence(spark: SparkSession, sf: str) -> DataFrame:
    return labels.equivalent_jurisdictions(fx.projection(spark))


_FOLDS = "folds AS (SELECT seed, grp, (('0x' || substring(md5(grp || ':' || seed), 1, 8))::BIGINT % 5)::INTEGER AS fold FROM (SELECT DISTINCT grp FROM formulations), (VALUES (0), (1), (2), (3), (4)) s(seed))"


@query(
    f", {_FOLDS} SELECT seed, fold, count(*) AS n, count(CASE WHEN y = 1 THEN 1 END) AS pos FROM formulations JOIN folds USING (grp) LEFT JOIN (SELECT category, y FROM projection WHERE jur = 'K_REACH') p USING (category) GROUP BY seed, fold"
)
def fold_attach(spark: SparkSession, sf: str) -> DataFrame:
    basis = fx.projection(spark).where(F.col("jur") == BASIS).select("category", "y")
    rows = fx.formulations(spark, sf).join(F.broadcast(basis), "category", "left")
    counted = rows.groupBy("grp").agg(F.count("*").alias("n"), F.count(F.when(F.col("y") == 1, 1)).alias("pos"))
    joined = counted.join(folds.hashed_folds(counted, "grp", SEEDS), "grp")
    return joined.groupBy("seed", "fold").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def _prevalence(spark: SparkSession, sf: str) -> DataFrame:
    counted = fx.formulations(spark, sf).groupBy("category").agg(F.count("*").alias("n"))
    found = labels.project(counted, fx.projection(spark)).where("y IS NOT NULL")
    return found.groupBy("jur").agg(F.sum("n").alias("n"), scalars.ratio(F.sum(F.col("n") * F.col("y")), F.sum("n")).alias("prevalence"))


_PREVALENCE = "SELECT jur, count(*) AS n, avg(y) AS prevalence FROM formulations JOIN projection USING (category) WHERE y IS NOT NULL GROUP BY jur"


@query(f"SELECT jur, n, {_r('prevalence')} FROM ({_PREVALENCE})")
def prevalence(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_prevalence(spark, sf))


@query(
    f", p AS ({_PREVALENCE}), stored AS (SELECT jur AS key, prevalence + CASE jur WHEN 'UN_GHS' THEN 1e-12::DOUBLE WHEN 'US_OSHA' THEN 1e-3::DOUBLE ELSE 0 END AS v FROM p WHERE jur <> 'EU_CLP' UNION ALL SELECT 'REMOVED', 0.5::DOUBLE) "
    "SELECT key, round(abs(prevalence - v) + 1e-10, 6) AS diff, coalesce(abs(prevalence - v) <= 1e-9, FALSE) AS ok FROM (SELECT jur AS key, prevalence FROM p) FULL JOIN stored USING (key)"
)
def lock_compare(spark: SparkSession, sf: str) -> DataFrame:
    new = _prevalence(spark, sf).select(F.col("jur").alias("key"), F.col("prevalence").alias("v"))
    shift = F.when(F.col("key") == "UN_GHS", 1e-12).when(F.col("key") == "US_OSHA", 1e-3).otherwise(0.0)
    stored = new.where("key <> 'EU_CLP'").select("key", (F.col("v") + shift).alias("v")).unionByName(spark.createDataFrame([("REMOVED", 0.5)], "key string, v double"))
    return rounded(metrics.lock_compare(new, stored, "key", "v"))


_PROFILE = "SELECT feature, count(*) AS n, count(CASE WHEN value = 0 THEN 1 END) AS n_zero, count(CASE WHEN value IS NULL THEN 1 END) AS n_null, count(CASE WHEN value = 0 AND NOT known THEN 1 END) AS n_frozen_zero FROM ({long}) GROUP BY feature".format(long=_long("matrix", "known, "))


@query(f"SELECT feature AS item, 'audited' AS side FROM ({_PROFILE}) WHERE n_frozen_zero > 0 AND feature <> 'conc_total_frozen' UNION ALL SELECT 'conc_total_frozen', 'declared' WHERE NOT EXISTS (SELECT * FROM ({_PROFILE}) WHERE n_frozen_zero > 0 AND feature = 'conc_total_frozen')")
def audit_symdiff(spark: SparkSession, sf: str, built: DataFrame | None = None) -> DataFrame:
    """Of the matrix, or of one that is written already."""
    audited = matrix.column_profile(fx.matrix(spark, sf) if built is None else built, "f", "known").where("n_frozen_zero > 0").select(F.col("feature").alias("item"))
    declared = spark.createDataFrame([(x,) for x in fx.ZERO_IS_MISSING], "item string")
    return labels.symmetric_difference(audited, declared, "item")


@query("SELECT * FROM (VALUES ('conc_total_frozen', 'audited'), ('size_mean', 'declared')) v(item, side)")
def audit_planted(spark: SparkSession, sf: str) -> DataFrame:
    """The audit against a list that leaves one column out and names another."""
    audited = matrix.column_profile(fx.matrix(spark, sf), "f", "known").where("n_frozen_zero > 0").select(F.col("feature").alias("item"))
    return labels.symmetric_difference(audited, spark.createDataFrame([("size_mean",)], "item string"), "item")


@query("SELECT o_orderkey IN (SELECT f FROM lines WHERE conc IS NOT NULL) AS known, count(*) AS n FROM orders GROUP BY 1")
def known_composition_semi(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("f")).distinct().withColumn("has", F.lit(True))
    joined = fx.formulations(spark, sf).select("f").join(known, "f", "left")
    return joined.groupBy(F.coalesce("has", F.lit(False)).alias("known")).agg(F.count("*").alias("n"))


@query("SELECT skeleton, count(*) AS n, count(DISTINCT role) AS n_type FROM substances GROUP BY skeleton")
def skeleton_fold(spark: SparkSession, sf: str) -> DataFrame:
    return labels.fold_skeletons(fx.substances(spark, sf), F.col("skeleton"), "role")


_ORDER = "CASE cat WHEN '1' THEN 1 WHEN '2A' THEN 2 WHEN '2B' THEN 3 WHEN 'NC' THEN 4 END"
_FOLDED_ROWS = f"SELECT skeleton, count(*) AS n, min(s) AS first_s, round(avg(price) + 1e-10, 6) AS price, ['1', '2A', '2B', 'NC'][min({_ORDER})] AS cat, coalesce(min({_ORDER}) < max({_ORDER}), FALSE) AS conflict FROM substances GROUP BY skeleton"


def _folded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return labels.folded_rows(fx.substances(spark, sf), "s", "skeleton", "cat", ["1", "2A", "2B", "NC"], ["price"])


@query(_FOLDED_ROWS)
def folded_substances(spark: SparkSession, sf: str) -> DataFrame:
    """Substances folded by skeleton, the most severe category where they disagree."""
    return rounded(_folded(spark, sf)[0])


@query(f"SELECT skeleton, s, s.cat, s.cat = f.cat AS decided FROM substances s JOIN ({_FOLDED_ROWS}) f USING (skeleton) WHERE f.conflict AND s.cat IS NOT NULL")
def folded_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger of what folding had to decide."""
    return _folded(spark, sf)[1]


@query("SELECT skeleton, string_agg(DISTINCT role, ',' ORDER BY role) AS categories FROM substances GROUP BY skeleton HAVING count(DISTINCT role) > 1")
def label_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return labels.conflicts(fx.substances(spark, sf), F.col("skeleton"), "role")


# --- mixtures ----------------------------------------------------------------------------------


@query(
    "SELECT f, n, " + _r("mean", "sd_pop", "min", "max") + ", round(CASE WHEN sd_pop <= 1e-9 * (1 + abs(mean)) THEN 0 ELSE m3 / pow(sd_pop, 3) END + 1e-10, 6) AS skew_pop, round(wmean + 1e-10, 6) AS wmean FROM ("
    "SELECT f, count(v) AS n, avg(v) AS mean, stddev_pop(v) AS sd_pop, min(v) AS min, max(v) AS max, avg(v * v * v) - 3 * avg(v) * avg(v * v) + 2 * pow(avg(v), 3) AS m3, sum(v * conc) / nullif(sum(CASE WHEN v IS NOT NULL THEN conc END), 0) AS wmean "
    "FROM (SELECT f, p_size::DOUBLE AS v, conc FROM ingredients) GROUP BY f)"
)
def ingredient_moments(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.ingredients(spark, sf).select("f", F.col("p_size").cast("double").alias("v"), "conc")
    return rounded(mixtures.moments(rows, "f", "v", "conc"))


_ROLES = ", ".join(f"CASE WHEN count(conc) > 0 THEN coalesce(sum(CASE WHEN role = '{v}' THEN conc END), 0) END AS {n}" for v, n in fx.ROLES.items())


@query(f", r AS (SELECT f, {_ROLES} FROM ingredients GROUP BY f) SELECT f, {_r(*fx.ROLES.values())} FROM r")
def role_conc_sums(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mixtures.role_sums(fx.ingredients(spark, sf), "f", "role", "conc", fx.ROLES))


_EYE_1, _EYE_2 = "(skin = '1' OR cat = '1')", "(cat IN ('2', '2A', '2B') AND skin IS DISTINCT FROM '1')"
_CT = (
    "SELECT f, s1, s2, n_missing, CASE WHEN known = 0 THEN NULL WHEN s1 >= 3 - 1e-9 THEN '1' WHEN s1 >= 1 - 1e-9 OR s2 >= 10 - 1e-9 OR 10 * s1 + s2 >= 10 - 1e-9 THEN '2A' ELSE 'NC' END AS category FROM ("
    f"SELECT f, coalesce(sum(CASE WHEN {_EYE_1} THEN conc END), 0) AS s1, coalesce(sum(CASE WHEN {_EYE_2} THEN conc END), 0) AS s2, count(*) - count(conc) AS n_missing, count(conc) AS known FROM ingredients GROUP BY f)"
)


@query(f"SELECT f, {_r('s1', 's2')}, n_missing, category FROM ({_CT})")
def ct_additivity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mixtures.additivity(fx.ingredients(spark, sf), "f", "conc"))


def _first_step(s1: str, s2: str, first: str, high: int, strong: str, weak: str) -> str:
    tests = [f"{s1} >= {high} - 1e-9", f"{s1} >= 1 - 1e-9", f"{s2} >= 10 - 1e-9", f"10 * {s1} + {s2} >= 10 - 1e-9"]
    steps = " ".join(f"WHEN {t} THEN {k}" for k, t in enumerate(tests, 1))
    return f"SELECT '{first}' AS endpoint, f, (CASE {steps} END)::INTEGER AS step, CASE WHEN known > 0 THEN CASE WHEN {tests[0]} THEN '{strong}' WHEN {' OR '.join(tests[1:])} THEN '{weak}' ELSE 'NC' END END AS category FROM sums"


@query(
    ", sums AS (SELECT f, count(conc) AS known, coalesce(sum(CASE WHEN skin = '1' THEN conc END), 0) AS skin1, coalesce(sum(CASE WHEN skin = '2' THEN conc END), 0) AS skin2, "
    f"coalesce(sum(CASE WHEN {_EYE_1} THEN conc END), 0) AS eye1, coalesce(sum(CASE WHEN {_EYE_2} THEN conc END), 0) AS eye2 FROM ingredients GROUP BY f) "
    f"{_first_step('eye1', 'eye2', 'eye', 3, '1', '2A')} UNION ALL {_first_step('skin1', 'skin2', 'skin', 5, '1', '2')}"
)
def endpoint_additivity(spark: SparkSession, sf: str) -> DataFrame:
    """The additive rule for eye and skin, each over its own sums, terms and cut-offs from a table."""
    return mixtures.additivity_by_table(fx.ingredients(spark, sf), "f", "conc", mixtures.ct_rules(spark))


@query("SELECT f, round(sum(conc) + 1e-10, 6) AS total_correct, round(coalesce(sum(conc), 0) + 1e-10, 6) AS total_nan0, sum(conc) IS NULL AS differs FROM ingredients GROUP BY f")
def null_preserving_sum(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mixtures.null_preserving_total(fx.lines(spark, sf), "f", "conc"))


@query(f", r AS (SELECT f, {_ROLES} FROM ingredients GROUP BY f) SELECT f, round(r_economy * r_promo + 1e-10, 6) AS a_x_b FROM r")
def interaction_terms(spark: SparkSession, sf: str) -> DataFrame:
    sums = mixtures.role_sums(fx.ingredients(spark, sf), "f", "role", "conc", {k: v for k, v in fx.ROLES.items() if v in ("r_economy", "r_promo")})
    return rounded(sums.select("f", mixtures.interaction(F.col("r_economy"), F.col("r_promo")).alias("a_x_b")))


@query("SELECT f, (count(cat) / count(*)::DOUBLE) AS coverage FROM (SELECT f, cat FROM ingredients) GROUP BY f")
def ingredient_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return mixtures.coverage(fx.ingredients(spark, sf), "f", "cat")


@query("SELECT f, s, row_number() OVER (PARTITION BY f ORDER BY conc DESC NULLS LAST, s, ln, supp, px)::INTEGER AS rank FROM lines")
def active_rank(spark: SparkSession, sf: str) -> DataFrame:
    return mixtures.active_rank(fx.lines(spark, sf), "f", "conc", ["s", "ln", "supp", "px"]).select("f", "s", "rank")


# --- zeros and missing values ------------------------------------------------------------------


@query("SELECT f, " + ", ".join(f"({c} IS NULL)::INTEGER AS {c}_isna" for c in _ALL) + " FROM matrix")
def missing_flags(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.missing_flags(fx.matrix(spark, sf).drop("known"), "f")


@query(_PROFILE)
def zero_missing_profile(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.column_profile(fx.matrix(spark, sf), "f", "known")


def _protocol_sql(cell: str) -> str:
    return "SELECT f, " + ", ".join(cell.format(c=c) if cell != "restore" else (f"CASE WHEN known THEN {c} END AS {c}" if c in fx.ZERO_IS_MISSING else c) for c in _ALL) + " FROM matrix"


_PROTOCOLS = {"nan0": _protocol_sql("coalesce({c}, 0) AS {c}"), "native": _protocol_sql("{c}"), "native_restored": _protocol_sql("restore")}


@query(
    " UNION ALL ".join(
        f"SELECT '{p}' AS protocol, round(count(CASE WHEN value = 0 THEN 1 END) / count(*)::DOUBLE + 1e-10, 6) AS zero_fraction FROM ({_long(f'({s})')})"
        for p, s in _PROTOCOLS.items()
    )
)
def matrix_zero_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(matrix.zero_fractions(fx.matrix(spark, sf), "f", "known", fx.ZERO_IS_MISSING))


@query(" UNION ALL ".join(f"SELECT '{p}' AS protocol, f, round(conc_total_frozen + 1e-10, 6) AS value FROM ({s})" for p, s in _PROTOCOLS.items()))
def protocol_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """One pass: each row is written once for each protocol."""
    cells = F.array(*[F.struct(F.lit(p).alias("protocol"), matrix.cell("conc_total_frozen", "known", p, fx.ZERO_IS_MISSING).alias("value")) for p in matrix.PROTOCOLS])
    return rounded(fx.matrix(spark, sf).select("f", F.explode(cells).alias("r")).select("r.protocol", "f", "r.value"))


@query(f"SELECT b.f FROM ({_PROTOCOLS['native_restored']}) b JOIN (SELECT f, sum(conc) AS raw FROM lines GROUP BY f) r USING (f) WHERE raw IS NULL AND b.conc_total_frozen IS NOT NULL")
def no_invented_values(spark: SparkSession, sf: str) -> DataFrame:
    built = matrix.under_protocol(fx.matrix(spark, sf), "f", "known", "native_restored", fx.ZERO_IS_MISSING)
    raw = fx.lines(spark, sf).groupBy("f").agg(F.sum("conc").alias("conc_total_frozen"))
    return matrix.invented(built, raw, "f", "conc_total_frozen")


@query("SELECT f FROM (SELECT f, sum(conc) AS raw FROM lines GROUP BY f) WHERE raw IS NULL")
def invented_planted(spark: SparkSession, sf: str) -> DataFrame:
    """The same check on the frozen matrix, in which every unknown total became a zero."""
    raw = fx.lines(spark, sf).groupBy("f").agg(F.sum("conc").alias("conc_total_frozen"))
    return matrix.invented(matrix.under_protocol(fx.matrix(spark, sf), "f", "known", "native", []), raw, "f", "conc_total_frozen")


@query("SELECT count(*) AS n, count(*) - count(conc) AS n_missing, round((count(*) - count(conc)) / count(*)::DOUBLE + 1e-10, 6) AS rate FROM lines")
def conc_missing_rate(spark: SparkSession, sf: str) -> DataFrame:
    missing = F.count(F.when(F.col("l_returnflag") == "N", 1))
    return rounded(table(spark, sf, "lineitem").agg(F.count("*").alias("n"), missing.alias("n_missing"), scalars.ratio(missing, F.count("*")).alias("rate")))


# --- metrics -----------------------------------------------------------------------------------


def _mcc_sql(prefix: str = "") -> str:
    tp, tn, fp, fn = (f"{prefix}{x}::DOUBLE" for x in metrics.COUNTS)
    return f"({tp} * {tn} - {fp} * {fn}) / nullif(sqrt(({tp} + {fp}) * ({tp} + {fn}) * ({tn} + {fp}) * ({tn} + {fn})), 0)"


_CONFUSION = "count(CASE WHEN y = 1 AND pred = 1 THEN 1 END) AS tp, count(CASE WHEN y = 0 AND pred = 0 THEN 1 END) AS tn, count(CASE WHEN y = 0 AND pred = 1 THEN 1 END) AS fp, count(CASE WHEN y = 1 AND pred = 0 THEN 1 END) AS fn"


@query(f"SELECT tp, tn, fp, fn, round({_mcc_sql()} + 1e-10, 6) AS mcc FROM (SELECT {_CONFUSION} FROM (SELECT y, 1 - quality AS pred FROM scored))")
def mcc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.mcc(fx.scored(spark, sf).withColumn("pred", 1 - F.col("quality")), "y", "pred"))


_CLASSED = "SELECT tier, y, (least(score, 10000) / 10000 >= 0.5::DOUBLE)::INTEGER AS pred FROM scored"


@query(f"SELECT tier, tp, tn, fp, fn, round({_mcc_sql()} + 1e-10, 6) AS mcc, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0) + 1e-10, 6) AS f1 FROM (SELECT tier, {_CONFUSION} FROM ({_CLASSED}) GROUP BY tier)")
def threshold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """MCC and F1 of the score at the fixed threshold of 0.5, by kind of source."""
    classed = _share(spark, sf).withColumn("pred", scalars.classify(F.col("p")))
    return rounded(metrics.mcc(classed, "y", "pred", ["tier"]).withColumn("f1", metrics.f1_of(F.col("tp"), F.col("fp"), F.col("fn"))))


def _auc_sql(rows: str, by: str = "") -> str:
    part, comma, group = (f"PARTITION BY {by} ", f"{by}, ", f" GROUP BY {by}") if by else ("", "", "")
    ranks_ = f"SELECT {comma}y, rank() OVER ({part}ORDER BY score) + (count(*) OVER (PARTITION BY {comma}score) - 1) / 2.0::DOUBLE AS r FROM ({rows})"
    return f"SELECT {comma}count(*) AS n, count(CASE WHEN y = 1 THEN 1 END) AS n_pos, (sum(CASE WHEN y = 1 THEN r END) - count(CASE WHEN y = 1 THEN 1 END) * (count(CASE WHEN y = 1 THEN 1 END) + 1) / 2.0::DOUBLE) / nullif(count(CASE WHEN y = 1 THEN 1 END) * count(CASE WHEN y = 0 THEN 1 END), 0)::DOUBLE AS auc FROM ({ranks_}){group}"


@query(f"SELECT n, n_pos, round(auc + 1e-10, 6) AS auc FROM ({_auc_sql('SELECT * FROM scored')})")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.roc_auc(fx.scored(spark, sf), "y", "score"))


@query(f"SELECT tier, n, round(auc + 1e-10, 6) AS auc FROM ({_auc_sql('SELECT * FROM scored', 'tier')})")
def auc_by_tier(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.roc_auc(fx.scored(spark, sf), "y", "score", ["tier"]).drop("n_pos"))


_CLEAN = "SELECT * FROM scored WHERE tier <> 'src0'"
_BOTH = f"SELECT (SELECT auc FROM ({_auc_sql('SELECT * FROM scored')})) AS pooled, (SELECT auc FROM ({_auc_sql(_CLEAN)})) AS corrected"


def _both(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.corrected_auc(fx.scored(spark, sf), "y", "score", F.col("tier") == "src0")


@query(f"SELECT {_r('pooled', 'corrected')} FROM ({_BOTH})")
def auc_corrected(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_both(spark, sf))


@query(f"SELECT round((pooled - corrected) / nullif(pooled - 0.5::DOUBLE, 0) + 1e-10, 6) AS leak_share FROM ({_BOTH})")
def leak_share(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_both(spark, sf).select(metrics.leak_share(F.col("pooled"), F.col("corrected")).alias("leak_share")))


@query(f"SELECT 'toxic' AS endpoint, round(corrected + 1e-10, 6) AS corrected, corrected >= 0.7::DOUBLE AS met FROM ({_BOTH})")
def gate_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_both(spark, sf).select(F.lit("toxic").alias("endpoint"), "corrected", (F.col("corrected") >= 0.7).alias("met")))


_HALVES = "SELECT seed, y, score FROM scored, (VALUES (0), (1), (2), (3), (4)) s(seed) WHERE ('0x' || substring(md5(doc_id || ':' || seed), 1, 8))::BIGINT % 2 = 0"


@query(f"SELECT count(*) AS n_seed, round(min(auc) + 1e-10, 6) AS min, round(max(auc) + 1e-10, 6) AS max, round(stddev_samp(auc) + 1e-10, 6) AS sd FROM ({_auc_sql(_HALVES, 'seed')})")
def seed_noise_band(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.scored(spark, sf).withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS))))
    text = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("seed").cast("string"))
    found = metrics.roc_auc(rows.where(scalars.hash_class(text, 2) == 0), "y", "score", ["seed"])
    return rounded(found.agg(F.count("*").alias("n_seed"), F.min("auc").alias("min"), F.max("auc").alias("max"), F.stddev_samp("auc").alias("sd")))


_CUTS = {"A0": 1000, "A2": 2000, "A3": 4000}
_ARM_SQL = "SELECT endpoint, arm, {m} AS v FROM (SELECT endpoint, arm, {c} FROM (SELECT endpoint, arm, CASE endpoint WHEN 'toxic' THEN y ELSE 1 - quality END AS y, (score >= cut)::INTEGER AS pred FROM scored, (VALUES ('toxic'), ('poor')) e(endpoint), (VALUES {v}) a(arm, cut)) GROUP BY endpoint, arm)".format(
    m=_mcc_sql(), c=_CONFUSION, v=fx._values(list(_CUTS.items()))
)


@query(f", m AS ({_ARM_SQL}) SELECT o.endpoint, 'mcc' AS metric, 'A0' AS base, o.arm, round(o.v - b.v + 1e-10, 6) AS delta FROM m o JOIN m b ON o.endpoint = b.endpoint AND b.arm = 'A0' WHERE o.arm <> 'A0'")
def ablation_delta(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.scored(spark, sf).withColumn("endpoint", F.explode(F.array(F.lit("toxic"), F.lit("poor"))))
    rows = rows.withColumn("arm", F.explode(F.array(*map(F.lit, _CUTS))))
    cut = F.coalesce(*[F.when(F.col("arm") == a, F.lit(c)) for a, c in _CUTS.items()])
    rows = rows.withColumn("label", F.when(F.col("endpoint") == "toxic", F.col("y")).otherwise(1 - F.col("quality"))).withColumn("pred", (F.col("score") >= cut).cast("int"))
    found = metrics.mcc(rows, "label", "pred", ["endpoint", "arm"]).withColumn("metric", F.lit("mcc"))
    return rounded(metrics.deltas(found, ["endpoint", "metric"], "arm", "mcc", "A0"))


_P = "least(score, 10000) / 10000"
_GRID_SQL = "SELECT {by}tau, {m} AS mcc FROM (SELECT {by}tau, {c} FROM (SELECT {by}y, tau, (p >= tau)::INTEGER AS pred FROM ({rows}), (VALUES {taus}) t(tau)) GROUP BY {by}tau)"


def _grid_sql(rows: str, by: str = "") -> str:
    return _GRID_SQL.format(by=by, m=_mcc_sql(), c=_CONFUSION, rows=rows, taus=", ".join(f"({t}::DOUBLE)" for t in fx.TAUS))


def _share(spark: SparkSession, sf: str) -> DataFrame:
    return fx.scored(spark, sf).withColumn("p", F.least("score", F.lit(10000.0)) / 10000.0)


@query(f"SELECT tau, round(mcc + 1e-10, 6) AS mcc FROM ({_grid_sql(f'SELECT y, {_P} AS p FROM scored')}) WHERE mcc IS NOT NULL ORDER BY round(mcc + 1e-10, 9) DESC, tau LIMIT 1")
def posthoc_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.best_threshold(metrics.threshold_grid(_share(spark, sf), "y", "p", fx.TAUS)))


_FOLDED = f"SELECT seed, y, {_P} AS p, (('0x' || substring(md5(doc_id || ':' || seed), 1, 8))::BIGINT % 5)::INTEGER AS fold FROM scored, (VALUES (0), (1), (2), (3), (4)) s(seed)"


@query(
    f", d AS ({_FOLDED}), counts AS (SELECT seed, fold, tau, {_CONFUSION} FROM (SELECT seed, fold, y, tau, (p >= tau)::INTEGER AS pred FROM d, (VALUES {', '.join(f'({t}::DOUBLE)' for t in fx.TAUS)}) t(tau)) GROUP BY ALL), "
    "rest AS (SELECT a.seed, a.fold, a.tau, sum(b.tp) AS tp, sum(b.tn) AS tn, sum(b.fp) AS fp, sum(b.fn) AS fn FROM counts a JOIN counts b ON a.seed = b.seed AND a.tau = b.tau AND a.fold <> b.fold GROUP BY ALL), "
    f"picked AS (SELECT seed, fold, tau FROM (SELECT *, row_number() OVER (PARTITION BY seed, fold ORDER BY round(m + 1e-10, 9) DESC NULLS LAST, tau) AS k FROM (SELECT *, {_mcc_sql()} AS m FROM rest)) WHERE k = 1) "
    f"SELECT seed, fold, tau, round({_mcc_sql('c.')} + 1e-10, 6) AS mcc_held_out FROM picked JOIN counts c USING (seed, fold, tau)"
)
def per_fold_tau(spark: SparkSession, sf: str) -> DataFrame:
    rows = _share(spark, sf).withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS))))
    rows = rows.withColumn("fold", scalars.hash_class(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("seed").cast("string")), 5))
    held = metrics.threshold_grid(rows, "y", "p", fx.TAUS, ["seed", "fold"])
    # A row for each seed, fold and threshold: the other folds' counts are the seed's less the fold's.
    whole = held.groupBy("seed", "tau").agg(*[F.sum(x).alias(f"all_{x}") for x in metrics.COUNTS])
    rest = held.join(whole, ["seed", "tau"]).select("seed", "fold", "tau", metrics.mcc_of(*[F.col(f"all_{x}") - F.col(x) for x in metrics.COUNTS]).alias("mcc"))
    picked = metrics.best_threshold(rest, ["seed", "fold"]).select("seed", "fold", "tau")
    return rounded(picked.join(held.select("seed", "fold", "tau", F.col("mcc").alias("mcc_held_out")), ["seed", "fold", "tau"]))


def _sweep_sql(rows: str, by: str = "") -> str:
    part, comma = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    return (
        f"SELECT {comma}tau, {_mcc_sql()} AS mcc FROM (SELECT {comma}score AS tau, sum(pos) OVER (g) - sum(pos) OVER (w) + pos AS tp, sum(neg) OVER (w) - neg AS tn, sum(neg) OVER (g) - sum(neg) OVER (w) + neg AS fp, sum(pos) OVER (w) - pos AS fn "
        f"FROM (SELECT {comma}score, count(CASE WHEN y = 1 THEN 1 END) AS pos, count(CASE WHEN y = 0 THEN 1 END) AS neg FROM ({rows}) GROUP BY {comma}score) WINDOW w AS ({part}ORDER BY score), g AS ({part.strip()}))"
    ).replace("OVER (g)", "OVER g").replace("OVER (w)", "OVER w")


_PICK = "SELECT {by}tau, mcc FROM (SELECT *, row_number() OVER ({part}ORDER BY round(mcc + 1e-10, 9) DESC, tau) AS k FROM ({rows}) WHERE mcc IS NOT NULL) WHERE k = 1"


@query(f"SELECT tau, round(mcc + 1e-10, 6) AS mcc FROM ({_PICK.format(by='', part='', rows=_sweep_sql(f'SELECT y, {_P} AS score FROM scored'))})")
def exact_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """The threshold of the largest MCC among all distinct scores, not a grid of them."""
    found = metrics.exact_threshold(_share(spark, sf), "y", "p")
    return found.select("tau", c6(F.col("mcc")).alias("mcc"))


_OTHERS = "SELECT d.seed, k.fold, d.y, d.p AS score FROM d JOIN (VALUES (0), (1), (2), (3), (4)) k(fold) ON d.fold <> k.fold"


@query(
    f", d AS ({_FOLDED}), picked AS ({_PICK.format(by='seed, fold, ', part='PARTITION BY seed, fold ', rows=_sweep_sql(_OTHERS, 'seed, fold'))}), "
    f"held AS (SELECT seed, fold, {_CONFUSION} FROM (SELECT d.seed, d.fold, d.y, (d.p >= picked.tau)::INTEGER AS pred FROM d JOIN picked USING (seed, fold)) GROUP BY seed, fold) "
    f"SELECT seed, fold, tau, round(picked.mcc + 1e-10, 6) AS mcc_train, round({_mcc_sql()} + 1e-10, 6) AS mcc_held_out FROM picked JOIN held USING (seed, fold)"
)
def exact_fold_tau(spark: SparkSession, sf: str) -> DataFrame:
    """For each seed and fold the best threshold of the other folds' rows, over all distinct scores."""
    rows = _share(spark, sf).withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS))))
    rows = rows.withColumn("fold", scalars.hash_class(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("seed").cast("string")), 5))
    found = metrics.exact_fold_thresholds(settle(rows.select("seed", "fold", "y", "p"), "folded-scores"), "y", "p", "seed", "fold")
    return found.select("seed", "fold", "tau", c6(F.col("mcc_train")).alias("mcc_train"), c6(F.col("mcc_held_out")).alias("mcc_held_out"))


@query("SELECT category, count(*) AS n, round(count(*) / (SELECT count(category) FROM formulations)::DOUBLE + 1e-10, 6) AS share FROM formulations WHERE category IS NOT NULL AND category NOT IN ('1', '2A', 'NC') GROUP BY category")
def unreachable_categories(spark: SparkSession, sf: str) -> DataFrame:
    reach = spark.createDataFrame([(r,) for r in sorted({x[5] for x in mixtures.CT_RULES if x[0] == "eye"} | {"NC"})], "category string")
    counted = fx.formulations(spark, sf).where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("__all"))
    out = counted.join(F.broadcast(reach), "category", "left_anti").join(F.broadcast(total))
    return rounded(out.select("category", "n", scalars.ratio(F.col("n"), F.col("__all")).alias("share")))


@query("SELECT group_size, count(*) AS n_groups FROM (SELECT grp, count(*) AS group_size FROM formulations GROUP BY grp) GROUP BY group_size")
def group_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return fx.formulations(spark, sf).groupBy("grp").agg(F.count("*").alias("group_size")).groupBy("group_size").agg(F.count("*").alias("n_groups"))


@query(
    f", ct AS ({_CT}), cov AS (SELECT f, count(cat) / count(*)::DOUBLE AS coverage FROM ingredients GROUP BY f), bins AS (SELECT f, ntile(4) OVER (ORDER BY coverage, f)::INTEGER AS bin FROM cov), "
    "pairs AS (SELECT q.jur, b.bin, q.y, r.y AS pred FROM bins b JOIN ct USING (f) JOIN formulations l USING (f) JOIN projection q ON q.category = l.category JOIN projection r ON r.category = ct.category AND r.jur = q.jur WHERE q.y IS NOT NULL AND r.y IS NOT NULL) "
    f"SELECT jur, bin, n, round({_mcc_sql()} + 1e-10, 6) AS mcc FROM (SELECT jur, bin, count(*) AS n, {_CONFUSION} FROM pairs GROUP BY jur, bin)"
)
def coverage_quartile_mcc(spark: SparkSession, sf: str) -> DataFrame:
    """The additive rule alone, by quartile of ingredient coverage and jurisdiction.

    The rule and the coverage come from one pass over ingredient rows; pairs of categories are counted
    before they are multiplied by jurisdictions.
    """
    rows = fx.ingredients(spark, sf).select("f", "cat", "skin", "conc")
    both = mixtures.additivity(rows, "f", "conc", extra={"coverage": mixtures.covered("cat")}).select("f", F.col("category").alias("rule"), "coverage")
    # Ranks read this narrow table three times; ingredient rows are read once.
    binned = ranks.equal_bins(settle(both, "rules"), 4, "coverage", "f", "bin")
    joined = binned.join(fx.formulations(spark, sf).select("f", "category"), "f").groupBy("bin", "rule", "category").agg(F.count("*").alias("n"))
    truth = labels.project(joined.where("category IS NOT NULL AND rule IS NOT NULL"), fx.projection(spark))
    rule = fx.projection(spark).select("jur", F.col("category").alias("rule"), F.col("y").alias("pred"))
    pairs = truth.join(F.broadcast(rule), ["jur", "rule"]).where("y IS NOT NULL AND pred IS NOT NULL")
    of = lambda a, b: F.coalesce(F.sum(F.when((F.col("y") == a) & (F.col("pred") == b), F.col("n"))), F.lit(0))
    counts = pairs.groupBy("jur", "bin").agg(F.sum("n").alias("n"), of(1, 1).alias("tp"), of(0, 0).alias("tn"), of(0, 1).alias("fp"), of(1, 0).alias("fn"))
    return rounded(counts.select("jur", "bin", "n", metrics.mcc_of(*[F.col(c) for c in metrics.COUNTS]).alias("mcc")))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN value / 20 <= 2 OR value / 20 >= 11.5 END AS extreme FROM events", prelude=False)
def ph_extreme_flag(spark: SparkSession, sf: str) -> DataFrame:
    reading = scalars.as_supplied(F.col("value") / 20, F.col("event_type"), "view")
    return table(spark, sf, "events").select("event_id", scalars.ph_extreme(reading).alias("extreme"))


@query(
    "SELECT 'domain' AS \"check\", count(*) AS n_violations FROM overlay WHERE survey_cat NOT IN (SELECT category FROM projection) UNION ALL "
    "SELECT 'duplicate', count(*) FROM (SELECT s FROM overlay GROUP BY s HAVING count(*) > 1) UNION ALL "
    "SELECT 'orphan', count(*) FROM overlay WHERE s NOT IN (SELECT s FROM substances) UNION ALL "
    "SELECT 'overrides_original', count(*) FROM overlay JOIN substances USING (s) WHERE cat IS NOT NULL"
)
def survey_qa(spark: SparkSession, sf: str) -> DataFrame:
    survey, known = fx.overlay(spark, sf), fx.substances(spark, sf)
    names = fx.projection(spark).select(F.col("category").alias("survey_cat")).distinct()
    checks = {
        "domain": survey.join(F.broadcast(names), "survey_cat", "left_anti"),
        "duplicate": survey.groupBy("s").count().where("count > 1"),
        "orphan": survey.join(known, "s", "left_anti"),
        "overrides_original": survey.join(known.where("cat IS NOT NULL"), "s", "left_semi"),
    }
    return labels.union_sources([v.agg(F.count("*").alias("n_violations")).select(F.lit(k).alias("check"), "n_violations") for k, v in checks.items()])


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{p}')::INTEGER AS {n}" for n, p in ALERTS.items()) + " FROM documents", prelude=False)
def alert_flags(spark: SparkSession, sf: str) -> DataFrame:
    flags = scalars.pattern_flags(F.col("text"), ALERTS)
    return table(spark, sf, "documents").select("doc_id", *[v.alias(k) for k, v in flags.items()])


@query(
    "SELECT label, pos, count(*) AS n, round(avg(v) + 1e-10, 6) AS mean, round(stddev_pop(v) + 1e-10, 6) AS sd_pop, round(min(v) + 1e-10, 6) AS min, round(max(v) + 1e-10, 6) AS max FROM (SELECT label, unnest(range(len(embedding)))::INTEGER AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label, pos",
    prelude=False,
)
def vector_moments(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).select("label", "pos", F.col("x").cast("double").alias("v"))
    return rounded(rows.groupBy("label", "pos").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd_pop"), F.min("v").alias("min"), F.max("v").alias("max")))


_PRINTS = "SELECT doc_id, (('0x' || substring(md5(doc_id || ':0'), 1, 8))::BIGINT % 5)::INTEGER AS fold, list_distinct(list_transform(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')), lambda w: ('0x' || substring(md5(w), 1, 8))::BIGINT % 1024)) AS bits FROM documents"


@query(
    f"WITH prints AS MATERIALIZED (SELECT * FROM ({_PRINTS}) WHERE len(bits) > 0), pairs AS (SELECT q.doc_id, c.doc_id AS neighbour, len(list_intersect(q.bits, c.bits)) AS both_, len(q.bits) AS a, len(c.bits) AS b FROM prints q JOIN prints c ON q.fold <> c.fold AND q.doc_id % 20 = 0) "
    "SELECT doc_id, neighbour, round(score + 1e-10, 6) AS score FROM (SELECT doc_id, neighbour, both_ / (a + b - both_)::DOUBLE AS score, row_number() OVER (PARTITION BY doc_id ORDER BY both_ / (a + b - both_)::DOUBLE DESC, neighbour) AS k FROM pairs) WHERE k = 1",
    prelude=False,
)
def fingerprint_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """For the documents whose id 20 divides, the most similar of all documents in another fold, by word fingerprints."""
    docs = table(spark, sf, "documents").select("doc_id", fingerprints.word_bits(F.col("text")).alias("bits"))
    fold = scalars.hash_class(F.concat(F.col("doc_id").cast("string"), F.lit(":0")), 5)
    rows = settle(docs.select("doc_id", fold.alias("fold"), F.size("bits").alias("ones"), fingerprints.packed(F.col("bits")).alias("fp")), "prints")
    found = fingerprints.nearest(rows, rows.where("doc_id % 20 = 0"), "doc_id")
    return rounded(found.select(F.col("query").alias("doc_id"), "neighbour", "score"))


# --- folds and models --------------------------------------------------------------------------


_ACTIVE_SQL = """, actives AS MATERIALIZED (SELECT DISTINCT f, s FROM (SELECT f, s, rank() OVER (PARTITION BY f ORDER BY conc DESC) AS r FROM lines WHERE conc IS NOT NULL) WHERE r = 1),
ties AS MATERIALIZED (SELECT DISTINCT a.s AS a, b.s AS b FROM actives a JOIN actives b USING (f)),
reach AS (SELECT DISTINCT s AS a, s AS b FROM actives UNION SELECT reach.a, ties.b FROM reach JOIN ties ON reach.b = ties.a),
grouped AS (SELECT l.f, coalesce('i' || min(r.b), 'm' || l.f) AS "group" FROM formulations l LEFT JOIN actives USING (f) LEFT JOIN reach r ON r.a = actives.s GROUP BY l.f)
"""


def _active_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.formulations(spark, sf).select("f")
    active = groups.active_ingredients(fx.lines(spark, sf).select("f", "s", "conc"), "f", "s", "conc")
    return groups.active_groups(rows, settle(active, "actives"), "f", "s")


@query(_ACTIVE_SQL + 'SELECT f, "group" FROM grouped')
def active_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The group of each formulation: those that share an active ingredient, or are tied through others."""
    return _active_groups(spark, sf)


@query(_ACTIVE_SQL + 'SELECT group_size, count(*) AS n_groups FROM (SELECT "group", count(*) AS group_size FROM grouped GROUP BY "group") GROUP BY group_size')
def active_group_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return _active_groups(spark, sf).groupBy("group").agg(F.count("*").alias("group_size")).groupBy("group_size").agg(F.count("*").alias("n_groups"))


def _labels(spark: SparkSession, sf: str, layer: str, endpoint: str, jur: str = BASIS) -> DataFrame:
    """id, y of a layer's labelled units for an endpoint in a jurisdiction."""
    own = fx.endpoint_projection(spark).where((F.col("jur") == jur) & (F.col("endpoint") == endpoint)).select("category", "y")
    rows = fx.endpoint_labels(spark, sf).where((F.col("layer") == layer) & (F.col("endpoint") == endpoint))
    return rows.join(F.broadcast(own), "category").where("y IS NOT NULL").select("id", "y")


def _basis_rows(spark: SparkSession, sf: str, endpoint: str = "eye") -> DataFrame:
    """f, group, y of labelled formulations; the group is that of a shared active ingredient."""
    return _labels(spark, sf, "formulation", endpoint).withColumnRenamed("id", "f").join(_active_groups(spark, sf), "f")


@query()
def group_folds(spark: SparkSession, sf: str) -> DataFrame:
    return folds.stratified_group_folds(_basis_rows(spark, sf), "group", "y", SEEDS)


@query(
    _ACTIVE_SQL + "SELECT seed, count(*) AS n_rows, count(DISTINCT \"group\") AS n_groups, 5::BIGINT AS n_folds, TRUE AS balanced FROM formulations JOIN grouped USING (f) JOIN projection USING (category), (VALUES (0), (1), (2), (3), (4)) s(seed) WHERE jur = 'K_REACH' AND y IS NOT NULL GROUP BY seed"
)
def fold_balance(spark: SparkSession, sf: str) -> DataFrame:
    """For each seed what the folds hold together; balanced: no fold's share of positive rows or of groups
    is further from the mean than 2 % of all rows or groups."""
    rows = settle(_basis_rows(spark, sf), "basis")
    held = rows.groupBy("group").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).join(folds.stratified_group_folds(rows, "group", "y", SEEDS), "group")
    of = held.groupBy("seed", "fold").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.count("*").alias("groups"))
    even = lambda x: (F.max(x) - F.min(x)) <= 0.04 * F.sum(x)
    return of.groupBy("seed").agg(F.sum("n").alias("n_rows"), F.sum("groups").alias("n_groups"), F.count("*").alias("n_folds"), (even("pos") & even("n") & even("groups")).alias("balanced"))


@query("SELECT seed, \"group\" FROM (VALUES (0, '')) v(seed, \"group\") WHERE FALSE", prelude=False)
def fold_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Groups whose rows lie in more than one of the folds in use; none may."""
    rows = settle(_basis_rows(spark, sf), "basis")
    return folds.spanning_groups(rows.join(folds.stratified_group_folds(rows, "group", "y", SEEDS), "group"), "group").select("seed", "group")


_TORN = "SELECT seed, grp, ((('0x' || substring(md5(grp || ':' || seed), 1, 8))::BIGINT % 5) + CASE WHEN grp % 7 = 0 THEN f % 2 ELSE 0 END) % 5 AS fold FROM formulations, (VALUES (0), (1), (2), (3), (4)) s(seed)"


@query(f"SELECT seed, grp AS \"group\" FROM ({_TORN}) GROUP BY seed, grp HAVING count(DISTINCT fold) > 1")
def fold_invariants_planted(spark: SparkSession, sf: str) -> DataFrame:
    """The same check on folds that tear every seventh group in two."""
    assigned = fx.formulations(spark, sf).select("f", "grp").join(folds.hashed_folds(fx.formulations(spark, sf), "grp", SEEDS), "grp")
    torn = assigned.withColumn("fold", (F.col("fold") + F.when(F.col("grp") % 7 == 0, F.col("f") % 2).otherwise(0)) % 5)
    return folds.spanning_groups(torn, "grp").select("seed", F.col("grp").alias("group"))


def _assigned(rows: DataFrame, key: str, seeds: list[int]) -> DataFrame:
    """seed, fold, key: folds that keep groups together."""
    found = folds.stratified_group_folds(rows, "group", "y", seeds)
    return settle(rows.select(key, "group").join(found, "group").select("seed", "fold", key), "assigned")


def _protocol(rows: DataFrame, protocol: str, used: list[str]) -> DataFrame:
    return rows.select("f", "y", *[matrix.cell(c, "known", protocol, fx.ZERO_IS_MISSING).alias(c) for c in used])


@query()
def train_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold predictions of 25 forests of 100 trees; an audit that finds anything stops it."""
    ready = settle(fx.matrix(spark, sf), "matrix")
    checks.require_empty(audit_symdiff(spark, sf, ready), "columns audited and declared differ")
    rows = settle(_basis_rows(spark, sf), "basis")
    used = fx.columns_of("A2")
    built = _protocol(rows.join(ready, "f"), "native_restored", used)
    return models.out_of_fold(built, _assigned(rows, "f", SEEDS), "f", "y", used).select("seed", "fold", F.col("f").alias("key"), "p")


def _scores(rows: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """AUC, and MCC and F1 at 0.5, of written predictions."""
    counts = metrics.mcc(rows.withColumn("pred", scalars.classify(F.col(p))), y, "pred", by)
    counts = counts.select(*by, "mcc", metrics.f1_of(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))
    return metrics.roc_auc(rows, y, p, by).join(counts, by)


@query()
def model_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metric rows of every jurisdiction, missing-value protocol and arm for formulations and eyes, flagged headline
    (1 for the basis) or supplementary: forests of 20 trees out of fold, for one seed.

    Jurisdictions that map alike share their forests; folds are those of the basis for all. Protocols and arms are grown
    together, over cells of all their columns.
    """
    basis = settle(_basis_rows(spark, sf), "basis")
    assigned = _assigned(basis, "f", SEEDS[:1])
    ready = settle(fx.matrix(spark, sf), "matrix")
    like: dict = {}
    for jur in JURISDICTIONS:
        like.setdefault(tuple((c, y) for j, c, y in fx.PROJECTION if j == jur), []).append(jur)
    # A column is named by what it holds; protocols that leave it as it is share it.
    held = {(p, c): c if p == "native" or p != "nan0" and c not in fx.ZERO_IS_MISSING else f"{c}@{p}" for p in matrix.PROTOCOLS for a in ARMS for c in fx.columns_of(a)}
    cells = [matrix.cell(c, "known", p, fx.ZERO_IS_MISSING).alias(n) for n, (p, c) in {n: k for k, n in held.items()}.items()]
    variants = {f"{p}+{a}": ([held[p, c] for c in fx.columns_of(a)], p != "nan0") for p in matrix.PROTOCOLS for a in ARMS}
    parts = []
    for jurs in like.values():
        rows = _labels(spark, sf, "formulation", "eye", jurs[0]).withColumnRenamed("id", "f")
        found = models.out_of_fold_each(rows.join(ready, "f").select("f", "y", *cells), assigned, "f", "y", variants, trees=20)
        parts.append(found.join(rows, "f").select(F.lit("+".join(jurs)).alias("jurs"), F.split_part("variant", F.lit("+"), F.lit(1)).alias("protocol"), F.split_part("variant", F.lit("+"), F.lit(2)).alias("arm"), "y", "p"))
    found = _scores(settle(labels.union_sources(parts), "scores"), "y", "p", ["jurs", "protocol", "arm"])
    out = found.select(F.explode(F.split("jurs", "[+]")).alias("jur"), "protocol", "arm", "n", "n_pos", "auc", "mcc", "f1")
    basis_row = (F.col("jur") == BASIS) & (F.col("protocol") == "native_restored") & (F.col("arm") == "A2")
    return rounded(out.withColumn("headline", basis_row.cast("int")))


@query()
def headline_models(spark: SparkSession, sf: str) -> DataFrame:
    """The four models on the basis: substances and formulations, eyes and skin; five seeds of five folds, 100 trees.

    Formulations: the columns of A2 under native_restored, grouped by active ingredient. Substances: structure-derived
    columns only, native, grouped by scaffold. Of each metric the mean over seeds, and the seeds' least and most.
    """
    ready, known = settle(fx.matrix(spark, sf), "matrix"), settle(_active_groups(spark, sf), "groups")
    single = settle(fx.substance_matrix(spark, sf), "substances")
    parts = []
    for layer in ("substance", "formulation"):
        for endpoint in ("eye", "skin"):
            own = _labels(spark, sf, layer, endpoint)
            if layer == "formulation":
                rows = settle(own.withColumnRenamed("id", "f").join(known, "f"), "basis")
                used = fx.columns_of("A2")
                built = _protocol(rows.join(ready, "f"), "native_restored", used)
            else:
                rows = settle(own.withColumnRenamed("id", "f").join(single.withColumnRenamed("s", "f"), "f").withColumn("group", F.col("scaffold")), "basis")
                used = fx.STRUCTURE_ONLY
                built = rows.select("f", "y", *used)
            found = models.out_of_fold(built, _assigned(rows, "f", SEEDS), "f", "y", used)
            parts.append(found.join(rows.select("f", "y"), "f").select(F.lit(layer).alias("layer"), F.lit(endpoint).alias("endpoint"), "seed", "f", "y", "p"))
    return rounded(band(settle(labels.union_sources(parts), "predictions")))


def band(predictions: DataFrame) -> DataFrame:
    """layer, endpoint: n, prevalence and, of AUC and MCC, mean, least and most over seeds of fits."""
    found = _scores(predictions, "y", "p", ["layer", "endpoint", "seed"])
    spread = [f(m).alias(f"{m}_{n}") for m in ("auc", "mcc") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return found.groupBy("layer", "endpoint").agg(F.count("*").alias("seeds"), F.max("n").alias("n"), F.max(F.col("n_pos") / F.col("n")).alias("prevalence"), *spread)


def _arm_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """arm, fold, group, f, y, p, tau, pred of trained arms: forests of 20 trees out of fold, for one seed, classed by
    the threshold that is best on the other folds' predictions."""
    basis = settle(_basis_rows(spark, sf), "basis")
    assigned, ready = _assigned(basis, "f", SEEDS[:1]), settle(basis.join(fx.matrix(spark, sf), "f"), "matrix")
    variants = {arm: (fx.columns_of(arm), True) for arm in ARMS}
    built = _protocol(ready, "native_restored", list(dict.fromkeys(c for used, _ in variants.values() for c in used)))
    found = models.out_of_fold_each(built, assigned, "f", "y", variants, trees=20)
    rows = settle(found.join(basis, "f").select(F.col("variant").alias("arm"), "fold", "group", "f", "y", "p"), "arms")
    taus = metrics.exact_fold_thresholds(rows, "y", "p", "arm", "fold").select("arm", "fold", "tau")
    return rows.join(F.broadcast(taus), ["arm", "fold"]).withColumn("pred", (F.col("p") >= F.col("tau")).cast("int"))  # a row a fold


@query()
def arm_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Trained arms against A0: the difference in MCC, its interval from 200 bootstrap replicates of active groups,
    paired between arms, and whether no difference lies inside it."""
    rows = settle(_arm_predictions(spark, sf), "arm-predictions")
    counts = bootstrap.replicated_counts(rows, "group", "y", "pred", ["arm"], 200)
    return rounded(bootstrap.verdicts(bootstrap.paired_deltas(counts, [], "arm", "A0"), [], "arm"))


@query()
def model_tier_report(spark: SparkSession, sf: str) -> DataFrame:
    """Of the trained arms' scores: AUC over all rows and without those whose label comes from the tier that features
    come from too, the share of the excess over chance that this takes, and the gate on the corrected one."""
    tiers = fx.formulations(spark, sf).select("f", "tier")
    rows = settle(_arm_predictions(spark, sf).join(tiers, "f").select("arm", "y", "p", "tier"), "tiered")
    parts = [metrics.corrected_auc(rows.where(F.col("arm") == a), "y", "p", F.col("tier") == "F").withColumn("arm", F.lit(a)) for a in ARMS]
    found = labels.union_sources(parts)
    share = metrics.leak_share(F.col("pooled"), F.col("corrected"))
    return rounded(found.select("arm", "pooled", "corrected", share.alias("leak_share"), (F.col("corrected") >= 0.7).alias("met")))


_BOOT = 100
_WEIGHT = "CASE WHEN b = 0 THEN 1 ELSE len(list_filter([{}], lambda c: ('0x' || substring(md5(tier || '-' || doc_id // 3 || ':' || b), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= c)) END".format(", ".join(f"{c}::DOUBLE" for c in bootstrap.poisson_cuts()))
_WEIGHTED = ", ".join(f"sum(CASE WHEN y = {a} AND pred = {p} THEN w ELSE 0 END) AS {n}" for n, a, p in (("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0)))


@query(
    f", rows AS (SELECT y, arm, (score >= cut)::INTEGER AS pred, b, {_WEIGHT} AS w FROM scored, (VALUES {fx._values(list(_CUTS.items()))}) a(arm, cut), range({_BOOT + 1}) r(b)), "
    f"m AS (SELECT arm, b, {_mcc_sql()} AS v FROM (SELECT arm, b, {_WEIGHTED} FROM rows GROUP BY arm, b)), "
    "d AS (SELECT o.arm, o.b, o.v - z.v AS delta FROM m o JOIN m z ON o.b = z.b AND z.arm = 'A0' WHERE o.arm <> 'A0'), "
    "q AS (SELECT arm, max(delta) FILTER (WHERE b = 0) AS delta, quantile_cont(delta, 0.025) FILTER (WHERE b > 0) AS low, quantile_cont(delta, 0.975) FILTER (WHERE b > 0) AS high, count(delta) FILTER (WHERE b > 0) AS replicates FROM d GROUP BY arm) "
    f"SELECT arm, {_r('delta', 'low', 'high')}, replicates, low <= 0 AND high >= 0 AS inside FROM q"
)
def bootstrap_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """The same verdicts over a given score, whose arms are cut-offs: groups of documents drawn anew 100 times."""
    rows = fx.scored(spark, sf).select("y", "score", F.concat("tier", F.lit("-"), F.floor(F.col("doc_id") / 3).cast("string")).alias("group"))
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), (F.col("score") >= c).cast("int").alias("pred")) for a, c in _CUTS.items()])
    rows = rows.select("y", "group", F.explode(arms).alias("r")).select("y", "group", "r.*")
    counts = bootstrap.replicated_counts(rows, "group", "y", "pred", ["arm"], _BOOT)
    return rounded(bootstrap.verdicts(bootstrap.paired_deltas(counts, [], "arm", "A0"), [], "arm"))


_TREE_FEATURES = ["conc_total", "conc_mean", "f_ct_eye_s1", "f_ct_eye_s2", "n_ing"]
_BINS = 16


def _bins_sql() -> str:
    cell = "SELECT f, y, '{c}' AS feature, CASE WHEN {c} IS NULL THEN NULL WHEN hi > lo THEN least(greatest(floor(({c} - lo) / (hi - lo) * " + str(_BINS) + "), 0), " + str(_BINS - 1) + ") ELSE 0 END::INTEGER AS bin FROM labelled, (SELECT min({c}) AS lo, max({c}) AS hi FROM labelled)"
    return " UNION ALL ".join(cell.format(c=c) for c in _TREE_FEATURES)


@query(
    f", labelled AS (SELECT m.*, y FROM matrix m JOIN formulations USING (f) JOIN projection USING (category) WHERE jur = 'K_REACH' AND y IS NOT NULL), cells AS ({_bins_sql()}), "
    "sums AS (SELECT feature, bin, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM cells GROUP BY feature, bin), "
    "tot AS (SELECT feature, sum(n) AS N1, sum(pos) AS P1, coalesce(sum(n) FILTER (WHERE bin IS NULL), 0) AS mn, coalesce(sum(pos) FILTER (WHERE bin IS NULL), 0) AS mp FROM sums GROUP BY feature), "
    "cum AS (SELECT feature, bin, sum(n) OVER w AS ln, sum(pos) OVER w AS lp FROM sums WHERE bin IS NOT NULL WINDOW w AS (PARTITION BY feature ORDER BY bin)), "
    "cand AS (SELECT feature, bin, missing, N1, P1, ln + CASE missing WHEN 'left' THEN mn ELSE 0 END AS ln, lp + CASE missing WHEN 'left' THEN mp ELSE 0 END AS lp FROM cum JOIN tot USING (feature), (VALUES ('left'), ('right')) s(missing)), "
    "gains AS (SELECT feature, bin, missing, N1::BIGINT AS n, 2 * P1 / N1 * (1 - P1 / N1) - ln / N1 * 2 * lp / ln * (1 - lp / ln) - (N1 - ln) / N1 * 2 * (P1 - lp) / (N1 - ln) * (1 - (P1 - lp) / (N1 - ln)) AS gain FROM cand WHERE ln > 0 AND ln < N1) "
    "SELECT feature, bin, missing, n, round(gain + 1e-10, 6) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(gain + 1e-12, 9) DESC, bin, missing) AS k FROM gains) WHERE k = 1"
)
def best_splits(spark: SparkSession, sf: str) -> DataFrame:
    """The best split of each feature at the root, missing values sent to the better side."""
    rows = _labels(spark, sf, "formulation", "eye").withColumnRenamed("id", "f").join(fx.matrix(spark, sf).select("f", *_TREE_FEATURES), "f")
    rows = settle(rows, "tree-rows")
    cells = trees.binned(rows, ["f", "y"], _TREE_FEATURES, _BINS)
    found = trees.best_splits(trees.split_gains(cells, "y", _TREE_FEATURES, F.lit(0)), ["feature"])
    return rounded(found.select("feature", "bin", "missing", "n", "gain"))


@query(f"SELECT s, {', '.join(f'{e} AS {n}' for n, e in fx._STRUCTURE.items())} FROM substances JOIN part ON p_partkey = s")
def structure_only(spark: SparkSession, sf: str) -> DataFrame:
    """The columns a model of substances may use, chosen by the manifest from all that there are."""
    allowed = fx.manifest(spark).where("layer = 'substance' AND state = 'ACTIVE' AND family = 'structure' AND NOT from_label").select("feature")
    return matrix.select_features(fx.substance_matrix(spark, sf), "s", [r["feature"] for r in allowed.collect()])
