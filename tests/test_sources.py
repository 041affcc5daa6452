"""Files in and out."""

import pytest
from pyspark.sql import functions as F

from tallowgrid.operators import checks
from tallowgrid.sources import files, lookups, published, reports, xlsx


def test_csv_keeps_types_of_null_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "a,b"), (2, None, None)], "`번호` long, x double, t string")
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c"), df.schema)
    assert back.schema == df.schema and sorted(map(tuple, back.collect())) == [(1, None, "a,b"), (2, None, None)]
    with pytest.raises(Exception, match="exist"):
        files.write_csv(df, str(tmp_path / "c"))


def test_xlsx_round_trip(spark, tmp_path):
    spark.dataSource.register(xlsx.XlsxSource)
    schema = "f string, x double, n long, ok boolean"
    df = spark.createDataFrame([("a & <b>", 1.5, 3, True), (None, None, None, False), (" 살충제 ", -2.0, 9_007_199_254_740_993, None)], schema)
    path = tmp_path / "d.xlsx"
    path.write_bytes(xlsx.write_xlsx(df))
    back = spark.read.format("tallowgrid_xlsx").schema(schema).option("path", str(path)).load()
    assert list(map(tuple, back.collect())) == list(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        xlsx.write_xlsx(df, most=2)
    assert [xlsx.column_number(xlsx.column_letters(i)) for i in (0, 25, 26, 701, 702)] == [0, 25, 26, 701, 702]


def test_hashes_show_changes(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.txt").write_text(n)
    before = spark.createDataFrame(files.file_hashes(spark, str(tmp_path), "*.txt").collect(), "path string, sha256 string")
    assert files.changed_files(files.file_hashes(spark, str(tmp_path), "*.txt"), before).count() == 0
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.txt").unlink()
    assert files.changed_files(files.file_hashes(spark, str(tmp_path), "*.txt"), before).count() == 2


def test_outputs_are_isolated_and_archives_frozen(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "k int, f_ct_sens_a double, x double")
    path = files.archive(df, str(tmp_path), "sens", "f_ct_sens_", "k")
    assert spark.read.parquet(path).columns == ["k", "f_ct_sens_a"]
    with pytest.raises(Exception, match="exist"):
        files.archive(df, str(tmp_path), "sens", "f_ct_sens_", "k")
    with pytest.raises(ValueError):
        files.write_output(df, str(tmp_path), "../x", "y")


def test_lookup(spark):
    wanted = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "cas string")
    cache = spark.createDataFrame([("a", 1)], "cas string, v int")
    found, missed = lookups.split_lookup(wanted, cache, "cas")
    assert [tuple(r) for r in found.collect()] == [("a", 1)] and [r["cas"] for r in missed.collect()] == ["b"]


def test_reports(spark):
    df = spark.createDataFrame([("a|b", 0.5), ("c", None)], "name string, v double")
    assert reports.markdown(df) == "| name | v |\n|---|---|\n| a\\|b | 0.5 |\n| c |  |\n"
    assert reports.bar_svg(df, "name", "v").count("<rect") == 1
    with pytest.raises(ValueError):
        reports.markdown(df.union(df), most=3)
    assert df.select(F.col("v")).count() == 2


def test_only_clean_output_is_published(spark, tmp_path):
    root, df = str(tmp_path / "out"), spark.range(100).select("id", F.when(F.col("id") != 50, F.col("id") / 2).alias("v"))
    rules = {"negative": F.col("v") < 0, "unknown": F.col("v").isNull()}
    with pytest.raises(checks.Violation, match="unknown: 1 rows"):
        published.publish(df, root, "t", rules)
    with pytest.raises(LookupError):
        published.read_published(spark, root, "t")
    assert published.publish(df.where("v IS NOT NULL"), root, "t", rules) == 1
    with pytest.raises(checks.Violation):
        published.publish(df, root, "t", rules)
    assert published.read_published(spark, root, "t").count() == 99
    assert published.publish(df.where("id < 10"), root, "t", rules) == 2
    assert published.read_published(spark, root, "t").count() == 10 and published.read_published(spark, root, "t", 1).count() == 99
    assert published.publish(df.limit(0), root, "none", rules) == 1 and published.read_published(spark, root, "none").dtypes == df.dtypes
    with pytest.raises(ValueError):
        published.publish(df, root, "../t", rules)


def test_publishing_scans_once(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "in"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.read.parquet(str(tmp_path / "in")).mapInArrow(count, "id long")
    published.publish(df, str(tmp_path / "out"), "t", {"big": F.col("id") > 5000, "small": F.col("id") < 0})
    assert seen.value == 1000


def test_a_session_that_published_can_still_fit_forests(spark, tmp_path):
    from tallowgrid.operators import models

    published.publish(spark.range(3), str(tmp_path / "out"), "t", {"negative": F.col("id") < 0})
    df = spark.range(40).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2).cast("double").alias("v"))
    assigned = df.select(F.lit(0).alias("seed"), (F.col("id") % 5).cast("int").alias("fold"), "id")
    assert models.out_of_fold(df, assigned, "id", "y", ["v"], trees=2).count() == 40


def test_a_cache_that_grows(spark, tmp_path):
    path, make = str(tmp_path / "cache"), (lambda rows: spark.createDataFrame(rows, "cas string, at long, v string"))
    assert lookups.read_cache(spark, path) is None
    first, second = [("a", 1, "x"), ("b", 1, "y"), (None, 1, "n"), ("a", 2, "z"), ("a", 2, "y")], [("b", 5, None), ("c", 1, "w"), ("a", 1, "old")]
    want = {"a": (2, "z"), "b": (5, None), "c": (1, "w")}
    for rows in (first, second, second, first, []):
        lookups.upsert(make(rows), path, "cas", "at", buckets=4)
    assert {r["cas"]: (r["at"], r["v"]) for r in lookups.read_cache(spark, path).collect()} == want
    assert lookups.read_cache(spark, path).columns == ["cas", "at", "v"]


def test_rejected_lines_come_with_their_reasons(spark, tmp_path):
    lines = {"one.csv": ["k,x,t", "1,0.5,a", "z,0.5,b", '2,,"c,d"', "3,1.5"], "two.csv": ["k,x,t", "4,1.0,e,f", "5,no,g", "6,2.0,"]}
    for name, own in lines.items():
        (tmp_path / name).write_text("\n".join(own) + "\n")
    schema = spark.createDataFrame([], "k long, x double, t string").schema
    good, bad = files.read_csv_split(spark, str(tmp_path), schema)
    assert sorted(map(tuple, good.collect())) == [(1, 0.5, "a"), (2, None, "c,d"), (6, 2.0, None)]
    want = {("one.csv", "z,0.5,b", "k is no bigint"), ("one.csv", "3,1.5", "fields missing"), ("two.csv", "4,1.0,e,f", "fields too many"), ("two.csv", "5,no,g", "x is no double")}
    assert set(map(tuple, bad.collect())) == want


def test_trees_of_hashes(spark, tmp_path):
    import hashlib

    (tmp_path / "d").mkdir()
    data = bytes(i * 7 % 251 for i in range(10_000))
    (tmp_path / "d" / "big.bin").write_bytes(data)
    (tmp_path / "d" / "empty.bin").write_bytes(b"")

    def by_hand(content, size, fan):
        level = [hashlib.sha256(content[i : i + size]).digest() for i in range(0, max(len(content), 1), size)]
        while True:
            level = [hashlib.sha256(b"".join(level[i : i + fan])).digest() for i in range(0, len(level), fan)]
            if len(level) == 1:
                return level[0].hex()

    make = lambda tasks: files.tree_hashes(files.range_hashes(spark, str(tmp_path / "d"), "*.bin", 100).repartition(tasks), 8)
    first = make(1)
    want = {"big.bin": by_hand(data, 100, 8)}  # Spark lists no empty files
    for tree in (first, make(7)):
        assert {r["path"].rpartition("/")[2]: r["sha256"] for r in files.roots(tree).collect()} == want
    stored = spark.createDataFrame(first.collect(), first.schema)
    assert files.changed_ranges(make(2), stored).count() == 0
    changed = bytearray(data)
    changed[4321] ^= 1
    (tmp_path / "d" / "big.bin").write_bytes(changed)
    assert [r["at"] for r in files.changed_ranges(make(3), stored).collect()] == [43]


def test_hashes_of_files_beyond_a_row(spark, tmp_path):
    """A file may be larger than what Spark puts into one row."""
    import hashlib

    data = bytes(i * 7 % 251 for i in range(3_000_000))
    (tmp_path / "big.bin").write_bytes(data)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        got = [tuple(r) for r in files.file_hashes(spark, str(tmp_path), "*.bin").collect()]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == [((tmp_path / "big.bin").as_uri().replace("file:///", "file:/"), hashlib.sha256(data).hexdigest())]
