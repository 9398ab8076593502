import pytest
from pyspark.sql import functions as F

from basalt.operators import derive, lookup, maintain, stats
from basalt.streaming import lookups as stream


def test_last_wins_and_merge(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k long, v string, t long")
    assert sorted(tuple(r) for r in derive.last_wins(a, ["k"], ["t"]).collect()) == [(1, "b", 2), (2, "c", 1)]
    new = spark.createDataFrame([(2, "z", 0), (3, None, 0)], "k long, v string, t long")
    assert sorted(tuple(r) for r in derive.upsert(a.where("t = 1"), new, ["k"]).collect()) == [(1, "a", 1), (2, "z", 0), (3, None, 0)]


def test_derived_tables_on_demand(spark):
    ledgers = spark.createDataFrame([(2,), (3,)], "ledger_seq long").withColumn("closed_at", F.current_timestamp())
    txs = spark.createDataFrame([("h", 2, 1, "e", "r"), ("h", 3, 1, "f", "r")], "tx_hash string, ledger_seq long, tx_index long, envelope string, result string")
    got = derive.derived(ledgers, txs, {"tx_hash_to_ledger_seq", "tx_hash_to_tx_data"})
    assert got.keys() == {"tx_hash_to_ledger_seq", "tx_hash_to_tx_data"}
    assert got["tx_hash_to_ledger_seq"].first().ledger_seq == 3 and got["tx_hash_to_tx_data"].first().envelope == "f"
    for bad in (set(), {"other"}):
        with pytest.raises(ValueError):
            derive.derived(ledgers, txs, bad)
    assert derive.count_transactions(ledgers.union(ledgers.limit(1).withColumn("ledger_seq", F.lit(9).cast("long"))), txs).orderBy("ledger_seq").collect()[-1].tx_count == 0


def test_compaction_restarts(spark):
    rows = spark.createDataFrame([(0, k, 6) for k in range(1, 8)], "stream long, batch_no long, bytes long")
    assert [r.batch_no for r in derive.compaction_triggers(rows, 10).orderBy("batch_no").collect()] == [2, 4, 6]


def test_walk_stops_early(spark):
    txs = spark.createDataFrame([("a" * 64, 3), ("b" * 64, 7)], "tx_hash string, ledger_seq long")
    keys = spark.createDataFrame([("A" * 64,), ("b" * 64,), ("c" * 64,), ("d" * 64,), ("e" * 64,), ("f" * 64,), ("bad",)], "query string")
    cand = [("a" * 64, 1, 5), ("a" * 64, 2, 3), ("a" * 64, 3, 50), ("b" * 64, 1, 7), ("c" * 64, 1, 3), ("d" * 64, 1, 3), ("d" * 64, 2, 7), ("e" * 64, 1, 20)]
    candidates = spark.createDataFrame(cand, "tx_hash string, index_idx long, ledger_seq long")
    stores = spark.createDataFrame([(1, 2, 10), (2, 20, 25), (3, 20, 30)], "store_id long, first long, last long")
    ledgers = spark.range(2, 11).select(F.col("id").alias("ledger_seq"), F.lit("2020-01-01 00:00:00").cast("timestamp").alias("closed_at"))
    walk = lookup.visited(keys, candidates, stores, ledgers, txs)
    classes = lookup.classified(keys, walk)
    got = {r.tx_hash[0]: (r.outcome, r.n_visited) for r in classes.collect()}
    assert got == {"a": ("FALSE_POSITIVE_PARTIAL", 2), "b": ("SUCCESS", 1), "c": ("FALSE_POSITIVE_NORMAL", 1), "d": ("FALSE_POSITIVE_COMPOUND", 2), "e": ("LEDGER_IN_MULTIPLE_DBS", 1), "f": ("RECSPLIT_NOT_FOUND", 0)}
    assert tuple(lookup.outcome_totals(keys, classes).first()) == (6, 2, 4, 1)
    line = {r.tx_hash[0]: r.line for r in lookup.error_lines(classes).collect()}
    assert line["a"] == f"FALSE_POSITIVE_PARTIAL|{'a' * 64}|3|(5,2020-01-01T00:00:00Z)" and "b" not in line
    gone = spark.createDataFrame([("c" * 64, "LEDGER_NOT_FOUND", 1, None, [(1, 11, None)])], "tx_hash string, outcome string, n_visited long, success_seq long, path array<struct<index_idx long, ledger_seq long, closed_at timestamp>>")
    full = classes.select(*gone.columns).where("tx_hash not like 'c%'").union(gone)
    line = {r.line.split("|")[0]: r.line.replace(r.tx_hash, r.tx_hash[0]) for r in lookup.log_lines(full, stores, txs, F.lit(1500)).collect()}
    at = "2020-01-01 00:00:00 +0000 UTC"
    assert line == {
        "FALSE_POSITIVE_PARTIAL": f"FALSE_POSITIVE_PARTIAL|a|(3,{at})|(5,{at})|1.500µs",
        "FALSE_POSITIVE_COMPOUND": f"FALSE_POSITIVE_COMPOUND|d|(3,{at}),(7,{at})|1.500µs",
        "LEDGER_IN_MULTIPLE_DBS": "LEDGER_IN_MULTIPLE_DBS|e|20|2,3|1.500µs",
        "LEDGER_NOT_FOUND": "LEDGER_NOT_FOUND|c|11|1.500µs",
        "RECSPLIT_NOT_FOUND": "RECSPLIT_NOT_FOUND|f|1.500µs",
    }
    alone = lookup.log_lines(classes.where("outcome = 'FALSE_POSITIVE_NORMAL'"), stores, txs, F.lit(7)).first().line
    assert alone == f"FALSE_POSITIVE_NORMAL|{'c' * 64}|(3,{at})|1|7ns"


def test_statistics_of_few_samples(spark):
    rows = spark.createDataFrame([("a", 5000), ("b", 1000), ("b", 4999)], "phase string, ns long")
    got = {r.phase: tuple(r)[1:] for r in stats.phase_statistics(rows, ["phase"], "ns").collect()}
    assert got == {"a": (1, 5, 0.0, 5, 5, 5), "b": (2, 2, 2.121, 2, 3, 3)}
    assert stats.phase_statistics(rows.where("false"), ["phase"], "ns").count() == 0
    rate, left = stats.estimate(F.lit(50), 200, F.lit(10.0))
    assert tuple(spark.range(1).select(rate, left).first()) == (5.0, 30.0)


@pytest.mark.parametrize(("column", "value", "severity"), [("l0_files", 20, None), ("l0_files", 21, "warning"), ("l0_files", 51, "critical"), ("obsolete_pct", 30.1, "critical"), ("space_amp", 1.5, None), ("memtable_bytes", 2 * 1024**3 + 1, "warning"), ("pending_bytes", 10 * 1024**3, None), ("files", 1001, "warning"), ("write_stopped", 1, "critical"), ("background_errors", 0, None)])
def test_health_limits(spark, column, value, severity):
    row = {"store": 1, "l0_files": 0, "obsolete_pct": 0.0, "space_amp": 1.0, "memtable_bytes": 0, "pending_bytes": 0, "files": 1, "write_stopped": 0, "background_errors": 0} | {column: value}
    got = maintain.recommendations(spark.createDataFrame([row])).collect()
    assert [r.severity for r in got] == ([severity] if severity else [])


def test_compaction_of_files(spark, tmp_path):
    spark.range(1000).repartition(8).write.parquet(str(tmp_path / "many"))
    dry = maintain.compact(spark, str(tmp_path / "many"), str(tmp_path / "few"), 1 << 20, dry_run=True).first()
    assert (dry.files_before, dry.files_after) == (8, 1) and not (tmp_path / "few").exists()
    done = maintain.compact(spark, str(tmp_path / "many"), str(tmp_path / "few"), 1 << 20).first()
    assert done.files_after == 1 and spark.read.parquet(str(tmp_path / "few")).count() == 1000


def test_commands_are_no_queries(spark):
    lines = spark.createDataFrame([("stop",), (" Stats ",), ("",), ("ab",)], "value string")
    assert [r.query for r in stream.queries_of(lines).collect()] == ["ab"]


def test_stats_and_stop(spark, tmp_path):
    import os

    seqs = spark.createDataFrame([("a" * 64, 2)], "tx_hash string, ledger_seq long")
    folder = tmp_path / "in"
    folder.mkdir()
    for k, text in enumerate(["a" * 64 + "\n" + "b" * 64, "a" * 64 + "\nSTATS", "x\n\nstop\n" + "a" * 64, "a" * 64]):
        (folder / str(k)).write_text(text)
        os.utime(folder / str(k), (1000 + k, 1000 + k))
    out = str(tmp_path / "out")
    stream.run_interactive(spark, str(folder), seqs, seqs, str(tmp_path / "progress"), out)
    got = {k: {r.outcome: r.n for r in spark.read.parquet(f"{out}/stats").where(F.col("batch") == k).collect()} for k in (1, 2)}
    assert got == {1: {"FOUND": 2, "NOT_IN_INDEX": 1}, 2: {"FOUND": 3, "NOT_IN_INDEX": 1, "INVALID_INPUT": 1}}
    assert spark.read.parquet(f"{out}/answers").count() == 5


def test_nested_ledgers_explode(spark):
    from basalt.sources import ledgers

    rows = spark.createDataFrame([(2, "x"), (3, "y")], "ledger_seq long, closed_at string")
    txs = spark.createDataFrame([("h", 2, 2, "e", "r"), ("g", 2, 1, "f", "r")], "tx_hash string, ledger_seq long, tx_index long, envelope string, result string")
    nested = ledgers.nested(rows, txs)
    assert {r.ledger_seq: [t.tx_hash for t in r.txs] for r in nested.collect()} == {2: ["g", "h"], 3: []}
    assert sorted(derive.explode_transactions(nested).select("ledger_seq", "closed_at", "tx_index", "tx_hash").collect()) == [(2, "x", 1, "g"), (2, "x", 2, "h")]


def test_progress_over_many_steps(spark):
    steps = spark.range(1, 1001).select(F.col("id").alias("step"), (F.col("id") % 3).alias("done_now"))
    want, done, percent = [], 0, 0
    for k in range(1, 1001):
        done += k % 3
        if 100 * done // 999 > percent:
            percent = 100 * done // 999
            want.append((k, done, percent))
    assert sorted(tuple(r) for r in stats.progress_marks(steps, 999).collect()) == want


def test_range_compaction(spark, tmp_path):
    from basalt.sources import ledgers

    path = str(tmp_path / "l")
    rows = spark.range(2, 30002).select(F.col("id").alias("ledger_seq"))
    ledgers.write_ledgers(rows.where("ledger_seq % 2 = 0"), path, 4)
    chunked = rows.where("ledger_seq % 2 = 1").withColumn("chunk_id", F.expr("(ledger_seq - 2) div 10000"))
    chunked.repartition(4).write.mode("append").partitionBy("chunk_id").parquet(path)
    before = len(list((tmp_path / "l" / "chunk_id=2").glob("*.parquet")))
    assert maintain.compact_chunks(spark, path, 5, 10005) == 2
    assert [len(list((tmp_path / "l" / f"chunk_id={k}").glob("*.parquet"))) for k in range(3)] == [1, 1, before]
    assert spark.read.parquet(path).count() == 30000


def test_numbers_without_a_single_task(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    assert [tuple(r) for r in derive.numbered(rows, "k").orderBy("k").collect()] == [(k, k) for k in range(1000)]
    got = derive.split_evenly(rows.where("k < 10"), 4, "k").orderBy("k").collect()
    assert [r.worker for r in got] == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]
    assert [r.worker for r in derive.split_evenly(rows.where("k < 2"), 4, "k").orderBy("k").collect()] == [0, 1]
    assert [r.worker for r in derive.split_for_verify(rows.where("k < 5"), 3, "k").orderBy("k").collect()] == [0, 0, 1, 1, 2]
