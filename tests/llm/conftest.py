import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, lang, source) rows, with extra columns of clashing names."""

    def make(rows, extra=True):
        filled = [(*r, "en", "s")[:4] if len(r) == 2 else r for r in rows]
        df = spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in filled], DOC)
        if extra:
            for name in ("score", "size", "uid", "key", "n", "label", "bucket"):
                df = df.withColumn(name, df["doc_id"].cast("string"))
        return df

    return make
