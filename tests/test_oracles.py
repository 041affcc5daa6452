"""Every registered query of the engine against its SQL oracle, on the smallest tables."""

import pytest
from compare import connect, same

from tallowgrid.plans import registry


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, small_dir, con, name):
    same(registry.QUERIES[name](spark, small_dir), con, registry.ORACLES[name])


def test_entry(spark, small_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.ORACLES) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows_only(spark, small_dir, name, monkeypatch):
    if name == "headline_models":  # a hundred fits: here of forests of 3 trees, on two seeds
        from tallowgrid.operators import models
        from tallowgrid.plans import queries

        whole = models.out_of_fold
        monkeypatch.setattr(models, "out_of_fold", lambda *args, **more: whole(*args, **more | {"trees": 3}))
        monkeypatch.setattr(queries, "SEEDS", [0, 1])
    assert registry.QUERIES[name](spark, small_dir).count() > 0
