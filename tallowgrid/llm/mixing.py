"""Mixing sources to target weights by Efraimidis-Spirakis sampling, natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallowgrid.llm.common import materialise

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: Classes of the exponential keys whose sums are taken before any row is ordered.
BUCKETS = 4096
_WORD = r"[^\x20\x09-\x0D]+"
#: ASCII that is no letter: runs of it are removed before letters are counted.
_NO_LETTERS = r"[\x00-\x40\[-`{-\x7F]+"
_SPACES = r"[\x20\x09-\x0D]+"


def quality_weight(text: Column) -> Column:
    """Letters' share of the characters in words, times the root of the share of words that are distinct;
    0.1 at least. Any character beyond ASCII counts as a letter; a text without a word weighs 0.1.

    Symbols and digits lower the first factor, repetition the second. The root spares long texts, in
    which words come again in any case.
    """
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    letters = F.length(F.regexp_replace(text, _NO_LETTERS, ""))
    characters = F.length(F.regexp_replace(text, _SPACES, ""))
    distinct = F.size(F.array_distinct(words)) / F.nullif(F.size(words), F.lit(0))
    return F.greatest(F.lit(0.1), F.coalesce(letters / F.nullif(characters, F.lit(0)) * F.sqrt(distinct), F.lit(0.1)))


def keyed(docs: DataFrame, seed: int = 17) -> DataFrame:
    """docs with the columns __source, __size, __key and __bucket.

    The key is -ln(u) / w: u is uniform, from the md5 of seed, doc_id and the text's md5, so reruns agree
    and rows without an id, or with one in common, have keys of their own; w is the document's quality
    weight (``quality_weight``). Ascending keys are a draw without replacement with chances in proportion
    to w. The bucket is a class of the key that ascends with it.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumns(
        {
            "__source": F.col("source").cast("string"),
            "__size": F.regexp_count(text, F.lit(_WORD)).cast("long"),
            "__weight": quality_weight(text),
        }
    )
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    named = F.concat(F.lit(f"{seed}:"), number, F.lit(":"), F.md5(text))
    u = (F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    rows = rows.withColumn("__key", -F.ln(u) / F.col("__weight")).drop("__weight")
    return rows.withColumn("__bucket", F.floor(BUCKETS * F.col("__key") / (1.0 + F.col("__key"))).cast("int"))


def source_targets(rows: DataFrame) -> DataFrame:
    """source, source_size, target: one row a source.

    Sources ascend by code point, null last, and take WEIGHTS in turn. Targets share SHARE of all
    sizes by weight and stop at MOST times their source; the excess is shared again. That is one level
    L with sum(least(MOST * size, L * weight)) equal to the share: with sources in order of MOST * size
    / weight, those before the first that the level, shared by it and all after it, doesn't fill are at
    their stop. The windows have a row a source.
    """
    sums = rows.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    sums = sums.withColumn("weight", weight).withColumn("stop", (MOST * F.col("source_size")).cast("double"))
    before = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(every) * F.lit(SHARE) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    level = left / F.nullif(F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)), F.lit(0.0))
    sums = sums.withColumn("level", level).withColumn("full", F.col("stop") / F.col("weight") <= F.col("level"))
    rest = F.sum("source_size").over(every) * F.lit(SHARE) - F.coalesce(F.sum(F.when(F.col("full"), F.col("stop"))).over(every), F.lit(0.0))
    free = F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(every), F.lit(0.0))
    target = F.when(F.col("full"), F.col("stop")).otherwise(F.least("stop", rest / F.nullif(free, F.lit(0.0)) * F.col("weight")))
    return sums.select("source", "source_size", target.alias("target"))


def copies(rows: DataFrame) -> DataFrame:
    """Rows with keys, and the columns __source_size, __target, __copies: how often each is taken.

    Complete epochs come first: each document is taken floor(target / source_size) times. The rest of
    the target is drawn in ascending key order: a document is taken once more if it brings the sum
    nearer to the target (sum before + size / 2 <= rest), so the sum ends within half a document of it.

    The running sums of a source are never one task's work: sums by (source, bucket) place all buckets
    but one, and only the documents of that one bucket are put in order.
    """
    targets = source_targets(rows)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = targets.select("source", "source_size", "target", epochs.cast("long").alias("epochs"))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    sums = rows.groupBy(F.col("__source").alias("source"), F.col("__bucket").alias("bucket")).agg(F.sum("__size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
    sums = sums.withColumn("upto", upto).alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")))
    # The first bucket whose sum passes the rest; all before are taken, all after are not.
    edge = F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))
    edges = sums.groupBy("p.source", "source_size", "target", "epochs", "rest").agg(F.min(F.when(F.col("upto") > F.col("rest"), edge)).alias("edge"))
    edges = edges.select(
        F.col("source").alias("__of"),
        F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"),
        F.col("epochs").alias("__epochs"),
        F.col("rest").alias("__rest"),
        F.coalesce("edge.bucket", F.lit(BUCKETS + 1)).alias("__edge"),
        F.coalesce("edge.before", F.lit(0)).alias("__before"),
    )
    edges = materialise(edges, "mix-edges")  # a row a source
    joined = rows.join(edges, rows["__source"].eqNullSafe(edges["__of"]))
    plain = joined.where(F.col("__bucket") != F.col("__edge")).withColumn("__copies", F.col("__epochs") + (F.col("__bucket") < F.col("__edge")).cast("int"))
    order = Window.partitionBy("__of").orderBy("__key", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("__before") + F.coalesce(F.sum("__size").over(order), F.lit(0))
    once = (ahead + F.col("__size") / 2.0 <= F.col("__rest")).cast("int")
    drawn = joined.where(F.col("__bucket") == F.col("__edge")).withColumn("__copies", F.col("__epochs") + once)
    return plain.unionByName(drawn)


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row.

    Whole documents are taken, however long. Null and empty texts have size 0; rows that repeat id and text
    share a key and are drawn one after another, other rows have keys of their own; a null source is a
    source; no rows, no result; further columns, whatever their names, are not read. Keys and sizes are
    written once, narrow, for the sums and the result.
    """
    rows = keyed(docs, seed).select(F.col("doc_id").cast("long").alias("doc_id"), "__source", "__size", "__key", "__bucket")
    found = copies(materialise(rows, "mix-keys"))
    return found.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
    )


def repeat_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: each document, all columns kept, as many times as it is taken.

    Documents without a word take part in no target and are left out. Rows are written once with their
    keys, so that words are counted once; sums and ranks then read the keys alone.
    """
    found = copies(materialise(keyed(docs, seed), "mix-rows")).where((F.col("__size") > 0) & (F.col("__copies") > 0))
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


#: DuckDB SQL of ``mix`` on documents.
ORACLE_SQL = f"""
WITH sized AS (
 SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
  length(regexp_replace(coalesce(text, ''), '{_NO_LETTERS}', '', 'g'))::DOUBLE / nullif(length(regexp_replace(coalesce(text, ''), '{_SPACES}', '', 'g')), 0)::DOUBLE AS letters,
  len(list_distinct(regexp_extract_all(coalesce(text, ''), '{_WORD}')))::DOUBLE / nullif(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')), 0)::DOUBLE AS distinct_words,
  (('0x' || substring(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
 FROM documents),
rows AS (SELECT *, -ln(u) / greatest(0.1::DOUBLE, coalesce(letters * sqrt(distinct_words), 0.1::DOUBLE)) AS key FROM sized),
sums AS (
 SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::DOUBLE AS stop,
  [3.0, 1.0, 2.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)]::DOUBLE AS weight
 FROM rows GROUP BY source),
levels AS (
 SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(stop) OVER earlier, 0)) / nullif(sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0), 0) AS level
 FROM sums WINDOW earlier AS (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
 SELECT source, source_size, CASE WHEN stop / weight <= level THEN stop ELSE least(stop, weight *
  (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(CASE WHEN stop / weight <= level THEN stop END) OVER (), 0))
  / nullif(coalesce(sum(CASE WHEN stop / weight <= level THEN NULL ELSE weight END) OVER (), 0), 0)) END AS target
 FROM levels),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
drawn AS (
 SELECT r.doc_id, r.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
  coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
 FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN ahead + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM drawn
"""
