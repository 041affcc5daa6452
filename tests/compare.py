"""Comparison of a query's rows with its oracle's."""

import os

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _cell(v):
    if v is None or (isinstance(v, (float, np.floating)) and v != v):
        return None
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6) + 0.0
    return v.item() if isinstance(v, np.generic) else v


def rows(table):
    """Sorted rows of an Arrow table, columns by name, doubles to six places."""
    names = sorted(table.column_names)
    return names, sorted(str([_cell(r[n]) for n in names]) for r in table.select(names).to_pylist())


def same(spark_df, con, sql):
    got, want = rows(spark_df.toArrow()), rows(con.sql(sql).to_arrow_table())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
