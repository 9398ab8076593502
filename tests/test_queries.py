"""Every registered query of the ledger operators against its SQL."""

import pytest

from basalt import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(name, same):
    same(registry.QUERIES[name], registry.SQL[name])


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_zstd_sizes(spark, sf_dir):
    rows = registry.QUERIES["zstd_size_stats"](spark, sf_dir).collect()
    assert sum(r.entries for r in rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 < r.stored_bytes < r.raw_bytes for r in rows)
