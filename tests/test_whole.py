"""Queries that look at the whole table."""

import pytest

from basalt import registry
from basalt.plans.lookups import every_key


def test_every_transaction_is_asked_for(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert every_key(spark, sf_dir).count() == n + 2006
    assert registry.QUERIES["query_list_with_absent_all"](spark, sf_dir).count() == n + 100


@pytest.mark.parametrize("name", ["two_step_outcomes_all", "stream_lookup_totals_all"])
def test_totals_count_every_transaction(spark, sf_dir, name):
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert sum(r.n for r in registry.QUERIES[name](spark, sf_dir).collect()) == n + (2006 if name.startswith("two") else 0)


def test_texts_of_all_lengths_are_formatted(spark, tmp_path):
    rows = [(1, 999), (2, 1_000_000), (3, 1_500_000_000), (4, 61_000_000_000), (5, 3_661_000_000_000), (6, None)]
    spark.createDataFrame([(k, "t", "en", "s", n) for k, n in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.ns, r.text, r.wrapped == "en") for r in registry.QUERIES["format_texts"](spark, str(tmp_path)).collect()}
    texts = ["999ns", "1.000ms", "1.500s", "1m1s", "1h1m1s", None]
    assert got == {k: (n, t, n is None) for (k, n), t in zip(rows, texts, strict=True)}


def test_ledgers_are_examined_to_the_ends_of_the_table(spark, tmp_path):
    spark.range(30_000, 60_000).selectExpr("id as o_orderkey", "timestamp_ntz '1996-01-01 00:00:00' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    missing = [r.ledger_seq for r in registry.QUERIES["missing_ledgers_all"](spark, str(tmp_path)).collect()]
    assert sorted(missing) == [k for k in range(30_002, 60_002) if k % 97 == 0]
    rows = registry.QUERIES["batch_assignment_all"](spark, str(tmp_path)).collect()
    assert len(rows) == 43 and sum(r.found for r in rows) == 30_000 - len(missing) and sum(r.skipped for r in rows) == len(missing)
    assert (min(r.first_planned for r in rows), max(r.last_planned for r in rows)) == (30_002, 60_001)
