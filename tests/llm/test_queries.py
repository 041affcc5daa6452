"""Registered queries on the smallest tables, and the pipeline by hand."""

import re

import pytest
from compare import connect, same

import corpus_pipeline
from tallowgrid.llm import jaccard, language, mixing, quality, queries, tokens
from tallowgrid.session import table


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, small_dir, con, name):
    same(queries.QUERIES[name](spark, small_dir), con, queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_whole_tables(spark, small_dir, name):
    got = queries.QUERIES[name](spark, small_dir)
    n = table(spark, small_dir, "documents").count()
    assert got.select("doc_id").distinct().count() == n


def test_thirteen_operators():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_against_its_parts(spark, small_dir):
    docs = table(spark, small_dir, "documents")
    marks = table(spark, small_dir, "labels")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "mixing", "packing"]
    rows = docs.collect()
    read = lambda kept: spark.createDataFrame(kept, docs.schema)

    model = quality.scorer(quality.fit(docs, marks))
    want = [r for r, s in zip(rows, model.scores([r["text"] for r in rows]), strict=True) if s >= 0.7]
    stage = dict(corpus_pipeline.STAGES)
    got = stage["quality"](spark, docs, small_dir)
    assert got.columns == columns and sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in want)

    profile = language.fit(read(want))
    want = [r for r in want if language.identify(profile, r["text"])[1] >= 0.3]
    got = stage["language"](spark, got, small_dir)
    assert got.columns == columns and sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in want)

    sets = {r["doc_id"]: set(jaccard.shingles(r["text"]).tolist()) for r in want}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0 and sets[a] & sets[b]:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    want = [r for r in want if root(r["doc_id"]) == r["doc_id"]]
    got = stage["near_duplicates"](spark, got, small_dir)
    assert got.columns == columns and sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in want)

    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(read(want)).collect() if r["size"]}
    got = stage["mixing"](spark, got, small_dir)
    counted = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(jaccard.F.count("*").alias("n")).collect()}
    assert got.columns == columns and counted == {i: n for i, n in taken.items() if n}

    pieces = stage["packing"](spark, got, small_dir).collect()
    encoder = tokens.ChunkEncoder(queries.public_tokenizers.path("byte_bpe_50k.json"), True)
    size = {r["doc_id"]: len(encoder.encode(r["text"])) // 4 + 1 for r in want}
    assert sum(r["length"] for r in pieces) == sum(size[i] * n for i, n in counted.items())
    run = corpus_pipeline.run(spark, small_dir).collect()
    total = lambda rows: sorted((r["doc_id"], r["start"] == 0, r["doc_tokens"]) for r in rows if r["start"] == 0)
    assert total(run) == total(pieces)


def test_stages_in_odd_cases(spark, small_dir, make_docs):
    docs = table(spark, small_dir, "documents")
    some = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    odd = [(None, None, None, None), (None, "", "en", None), (5001, "12 34", "en", "s"), (5002, "xqzv kjw " * 90, "en", "s"), (5003, "日本語の文章です " * 30, "en", "s")]
    odd += [(None, some[0][1], "en", "s"), (None, some[0][1], "en", "s"), (some[1][0], some[1][1], "en", "s"), (some[2][0], some[3][1], "en", "s"), (5004, some[4][1] + (" " + some[4][1]) * 40, "en", "s")]
    given = make_docs(some + odd)
    columns = given.columns
    stage = dict(corpus_pipeline.STAGES)
    for name in ("quality", "language", "near_duplicates", "mixing"):
        kept = stage[name](spark, given, small_dir)
        assert kept.columns == columns and kept.count() > 0
        none = stage[name](spark, given.limit(0), small_dir)
        assert none.columns == columns and none.count() == 0
        texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
        if name == "language":
            assert not {5001, 5002, 5003} & {i for i, _ in texts} and len(texts) == len(some) + 5
        if name == "near_duplicates":
            assert sum(t == some[0][1] for _, t in texts) <= 1 and sum(t is None or not t.strip() for _, t in texts) == 2
        if name == "mixing":
            assert all(t and t.strip() for _, t in texts)
    assert stage["packing"](spark, given.limit(0), small_dir).count() == 0
    assert stage["packing"](spark, given, small_dir).where("start = 0").count() == len(some) + len(odd)


def test_groups_without_any_id_keep_one_row(spark, make_docs):
    rows = [(None, "one two three four five six")] * 3 + [(None, "one two three four five six seven"), (None, None), (3, "other words than those before")]
    kept = [(r["doc_id"], r["text"]) for r in jaccard.keep_first(make_docs(rows)).collect()]
    # Two of six, and three shingles of which two are common: 2 of 3 is no link.
    assert sorted(map(str, kept)) == sorted(map(str, [(None, rows[0][1]), (None, rows[3][1]), (None, None), (3, rows[5][1])]))
