"""The multi-index lookup of every transaction: same rows as the walk of each key, and no row for a pair of key and index."""

import pytest
from pyspark.sql import functions as F

from basalt import registry
from basalt.functions.chunks import chunk_of
from basalt.operators import lookup

N, INDEXES = 200_000, 40


@pytest.fixture(scope="module")
def long_history(spark, tmp_path_factory):
    """40 indexes of 5,000 transactions, so that a hash meets about three false positives."""
    d, day = str(tmp_path_factory.mktemp("long")), "timestamp_ntz '1996-01-01 00:00:00'"
    spark.range(N).selectExpr("id as l_orderkey", "1 as l_linenumber", "id % 7 as l_partkey", "id % 5 as l_suppkey", f"{day} as l_shipdate", "'N' as l_returnflag", "'O' as l_linestatus", "1D as l_quantity").write.parquet(f"{d}/lineitem.parquet")
    spark.range(N).selectExpr("id as o_orderkey", f"{day} as o_orderdate").write.parquet(f"{d}/orders.parquet")
    return d


def shuffled(spark, run):
    """Rows that ``run`` wrote for shuffles."""
    jvm, sc = spark._jvm, spark._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(k) for k in range(found.size()))}

    before = total()
    run()
    return sum(v for k, v in total().items() if k not in before)


@pytest.mark.parametrize("name", ["multi_index_outcomes_all", "outcome_totals_all", "error_log_lines_all", "failure_json_all", "lookup_log", "lookup_summary"])
def test_shuffles_no_pairs(spark, long_history, name):
    run = lambda: registry.QUERIES[name](spark, long_history).write.format("noop").mode("overwrite").save()
    assert shuffled(spark, run) < 7 * N


def test_same_rows_as_the_walk_of_each_key(spark):
    """One-digit slots, so that nearly every walk has false positives; hashes in several indexes, missing and doubly claimed ledgers."""
    name = F.sha2(F.concat(F.lit("tx"), F.col("k").cast("string")), 256)
    txs = spark.range(400).select((F.col("id") % 150).alias("k"), (F.col("id") * 13 % 997 + 2).alias("ledger_seq")).select(name.alias("tx_hash"), "ledger_seq")
    ledgers = spark.range(2, 999).where("id % 23 <> 0").select(F.col("id").alias("ledger_seq"), F.expr("timestamp '1996-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id)").alias("closed_at"))
    stores = spark.createDataFrame([(1, 2, 500), (2, 501, 960), (3, 300, 310), (4, 960, 960)], "store_id long, first long, last long")
    keys = spark.range(300).select((F.col("id") % 200).alias("k"), "id").select(F.when(F.col("id") % 3 == 0, F.upper(name)).otherwise(name).alias("query")).union(spark.createDataFrame([("",), ("g" * 64,)], "query string"))
    index_of = chunk_of(F.col("ledger_seq"), 100)
    members, slots = lookup.approximate_index(txs, index_of, 1)
    hashes = keys.where(F.length("query") == 64).where("query not like 'g%'").select(F.lower("query").alias("tx_hash")).distinct()
    want = lookup.classified(keys, lookup.visited(hashes, lookup.probe(hashes, members, slots, 1), stores, ledgers, txs))
    got = lookup.classified_by_slot(keys, txs, index_of, stores, ledgers, 1)
    assert len(set(r.outcome for r in want.collect())) >= 5
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    short = lookup.classified_by_slot(keys, txs, index_of, stores, ledgers, 1, paths=False)
    assert "path" not in short.columns
    assert sorted(map(repr, short.collect())) == sorted(map(repr, want.select(*short.columns).collect()))
    lines = [sorted(r.line for r in df.collect()) for df in (lookup.told(got, F.lit(1500)), lookup.log_lines(want, stores, txs, F.lit(1500)))]
    assert lines[0] == lines[1] and any(line.startswith("LEDGER_IN_MULTIPLE_DBS") for line in lines[0])
    one = lookup.classified_by_slot(keys.limit(0), txs, index_of, stores, ledgers, 1)
    assert one.count() == 0


def test_throughput_has_no_exponent(spark):
    timed = spark.range(20).select(F.lit("SUCCESS").alias("outcome"), *[F.lit(7).cast("long").alias(c) for c in (*lookup.PHASES, "tx_scanned")])
    keys = spark.createDataFrame([("",)], "query string")
    assert '"throughput_per_second":20000000.0,' in lookup.lookup_summary(timed, keys, 1000).first().summary
    assert '"throughput_per_second":20.0,' in lookup.lookup_summary(timed, keys, 1_000_000_000).first().summary
    empty = lookup.lookup_summary(timed.where("false"), keys, 1000).first().summary
    assert '"total_transactions":0,' in empty and '"invalid_inputs":1,' in empty and '"failures":{}' in empty
