"""Scans, derived tables, batches, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.chunks import batch_of, chunk_of
from ..operators import derive as D
from ..sources import ledgers as S
from .base import query

L, T = S.SQL_LEDGERS, S.SQL_TXS


@query(f"with {L} select ledger_seq, closed_at from ledgers where ledger_seq between 500 and 1200")
def ledger_scan_range(spark, sf_dir):
    return S.ledgers(spark, sf_dir).where(F.col("ledger_seq").between(500, 1200))


@query(f"with {L} select range as ledger_seq from range(2, 20002) where range not in (select ledger_seq from ledgers where ledger_seq % 97 <> 0)")
def missing_ledgers(spark, sf_dir):
    return S.missing(S.ledgers(spark, sf_dir).where("ledger_seq % 97 <> 0"), 2, 20001)


def ends(rows):
    """The least and the greatest sequence of a ledger table; (2, 1), a range of nothing, if it is empty."""
    first, last = rows.agg(F.min("ledger_seq"), F.max("ledger_seq")).first()
    return (2, 1) if first is None else (first, last)


@query(f"with {L} select * from (select unnest(range((select min(ledger_seq) from ledgers), (select max(ledger_seq) + 1 from ledgers))) as ledger_seq) where ledger_seq not in (select ledger_seq from ledgers where ledger_seq % 97 <> 0)")
def missing_ledgers_all(spark, sf_dir):
    """The same from the first to the last ledger of the table."""
    every = S.ledgers(spark, sf_dir)
    return S.missing(every.where("ledger_seq % 97 <> 0"), *ends(every))


@query(f"with {L} select (ledger_seq - 2) // 5000 as store_id, min(ledger_seq) as first, max(ledger_seq) as last from ledgers group by 1")
def store_range_minmax(spark, sf_dir):
    return S.ledgers(spark, sf_dir).groupBy(chunk_of(F.col("ledger_seq"), 5000).alias("store_id")).agg(F.min("ledger_seq").alias("first"), F.max("ledger_seq").alias("last"))


@query(f"with {L} select min(ledger_seq) as start, max(ledger_seq) as \"end\", count(*) as n from ledgers where closed_at between timestamp '1996-03-01 00:00:00' and timestamp '1996-03-31 23:59:59'")
def time_to_ledger_range(spark, sf_dir):
    """Both bounds belong to the range."""
    asked = F.col("closed_at").between(F.lit("1996-03-01 00:00:00").cast("timestamp"), F.lit("1996-03-31 23:59:59").cast("timestamp"))
    return S.ledgers(spark, sf_dir).where(asked).agg(F.min("ledger_seq").alias("start"), F.max("ledger_seq").alias("end"), F.count(F.lit(1)).alias("n"))


@query(f"with {L} select year(closed_at)::int as year, min(ledger_seq) as start, max(ledger_seq) as \"end\" from ledgers where closed_at >= make_timestamp(1997, 1, 1, 0, 0, 0) and closed_at <= make_timestamp(1997, 12, 31, 23, 59, 59) group by 1")
def year_to_ledger_range(spark, sf_dir):
    y = lambda *a: F.make_timestamp(*[F.lit(x) for x in a])
    rows = S.ledgers(spark, sf_dir).where(F.col("closed_at").between(y(1997, 1, 1, 0, 0, 0), y(1997, 12, 31, 23, 59, 59)))
    return rows.groupBy(F.year("closed_at").alias("year")).agg(F.min("ledger_seq").alias("start"), F.max("ledger_seq").alias("end"))


@query(f"with {L}, {T} select ledger_seq, closed_at, tx_index, tx_hash from txs join ledgers using (ledger_seq)")
def explode_transactions(spark, sf_dir):
    """Transactions are rows here already, so they are joined with their ledgers and never packed into one row for each."""
    return D.tx_data(S.ledgers(spark, sf_dir), S.transactions(spark, sf_dir)).select("ledger_seq", "closed_at", "tx_index", "tx_hash")


@query(f"with {L}, {T} select ledger_seq, count(tx_hash) as tx_count from ledgers left join txs using (ledger_seq) group by 1")
def count_tx_per_ledger(spark, sf_dir):
    txs = S.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 2).alias("ledger_seq"))
    return D.count_transactions(S.ledgers(spark, sf_dir), txs)


@query(f"with {L}, {T} select tx_hash, ledger_seq, closed_at, tx_index, envelope, result from txs join ledgers using (ledger_seq)")
def txdata_projection(spark, sf_dir):
    return D.tx_data(S.ledgers(spark, sf_dir), S.transactions(spark, sf_dir))


@query(f"with {T} select tx_hash, max(ledger_seq) as ledger_seq from txs group by 1")
def hash_to_seq(spark, sf_dir):
    return D.hash_to_seq(S.transactions(spark, sf_dir))


@query(f"""with {L} select b.range as batch_no, 2 + (b.range - 1) * 700 as first_planned, least(10001, 1 + b.range * 700) as last_planned, count(ledger_seq) as found,
min(ledger_seq) as first_found, max(ledger_seq) as last_found, least(10001, 1 + b.range * 700) - (2 + (b.range - 1) * 700) + 1 - count(ledger_seq) as skipped
from range(1, 16) b left join ledgers on ledger_seq % 97 <> 0 and ledger_seq between 2 + (b.range - 1) * 700 and least(10001, 1 + b.range * 700) group by b.range""")
def batch_assignment(spark, sf_dir):
    return D.batches(S.ledgers(spark, sf_dir).where("ledger_seq % 97 <> 0"), 2, 10001, 700)


@query(f"""with {L}, ends as (select min(ledger_seq) as a, max(ledger_seq) as z from ledgers), planned as (select batch_no, a + (batch_no - 1) * 700 as first_planned, least(z, a - 1 + batch_no * 700) as last_planned from (select a, z, unnest(range(1, (z - a) // 700 + 2)) as batch_no from ends))
select batch_no, first_planned, last_planned, count(ledger_seq) as found, min(ledger_seq) as first_found, max(ledger_seq) as last_found, last_planned - first_planned + 1 - count(ledger_seq) as skipped
from planned left join ledgers on ledger_seq % 97 <> 0 and ledger_seq between first_planned and last_planned group by batch_no, first_planned, last_planned""")
def batch_assignment_all(spark, sf_dir):
    """The same from the first to the last ledger of the table."""
    every = S.ledgers(spark, sf_dir)
    return D.batches(every.where("ledger_seq % 97 <> 0"), *ends(every), 700)


@query("""with rows_ as (select o_custkey as k, o_orderkey // 2000 as batch_no, o_orderkey as ord, o_orderpriority as value from orders)
select k, batch_no, ord, value from rows_ qualify row_number() over (partition by k order by batch_no desc, ord desc) = 1""")
def upsert_last_wins(spark, sf_dir):
    rows = S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.floor(F.col("o_orderkey") / 2000).alias("batch_no"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("value"))
    return D.last_wins(rows, ["k"], ["batch_no", "ord"])


@query("""with t as (select l_orderkey // 500 + 1 as batch_no, sha256(concat_ws('|', l_orderkey, l_linenumber)) as tx_hash, strlen(concat_ws('|', l_partkey, l_suppkey)) + strlen(l_returnflag) as b from lineitem)
select batch_no, count(*) as tx_count, sum(b)::bigint as raw_bytes, count(distinct tx_hash) as hash_count from t group by 1""")
def dedup_counts(spark, sf_dir):
    """Hashes of two columns only, so that some transactions of a batch share one."""
    rows = S.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 2).alias("ledger_seq"), F.sha2(F.concat_ws("|", "l_orderkey", "l_linenumber"), 256).alias("tx_hash"), F.concat_ws("|", "l_partkey", "l_suppkey").alias("envelope"), F.col("l_returnflag").alias("result"))
    return D.dedup_counts(rows, 2, 500)


@query("""with recursive b as (select o_orderkey // 100 + 1 as batch_no, sum(cast(floor(o_totalprice) as bigint))::bigint as bytes from orders group by 1),
f as (select 0::bigint as batch_no, 0::bigint as total, false as hit union all
select b.batch_no, case when f.hit then 0 else f.total end + b.bytes, case when f.hit then 0 else f.total end + b.bytes >= 100000000 from f join b on b.batch_no = f.batch_no + 1)
select 0::bigint as stream, batch_no from f where hit""")
def compaction_trigger_fold(spark, sf_dir):
    b = S.table(spark, sf_dir, "orders").groupBy((F.floor(F.col("o_orderkey") / 100) + 1).alias("batch_no")).agg(F.sum(F.floor("o_totalprice").cast("long")).alias("bytes"))
    return D.compaction_triggers(b.withColumn("stream", F.lit(0).cast("long")), 100_000_000)


@query(f"with {L}, {T} select (ledger_seq - 2) // 2000 + 1 as batch_no, count(*) as n, sum(strlen(envelope))::bigint as envelope_bytes, sum(strlen(result))::bigint as result_bytes from txs group by rollup((ledger_seq - 2) // 2000 + 1)")
def batch_rollup(spark, sf_dir):
    from ..operators.stats import rollup_by_batch

    return rollup_by_batch(S.transactions(spark, sf_dir), batch_of(F.col("ledger_seq"), 2, 2000), envelope_bytes=F.octet_length("envelope"), result_bytes=F.octet_length("result"))


@query("""with s as (select 0 as p, c_custkey as k, c_mktsegment as v from customer union all select 1, o_custkey, min(o_orderpriority) from orders group by o_custkey union all select 2, s_suppkey, s_name from supplier)
select k, v from s qualify row_number() over (partition by k order by p desc) = 1""")
def merge_with_precedence(spark, sf_dir):
    a = S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    b = S.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderpriority").alias("v"))
    c = S.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    return D.merge([a, b, c], ["k"])


@query("select 'customer' as source, count(*) as n from customer union all select 'orders', count(*) from orders union all select 'supplier', count(*) from supplier union all select null, (select count(*) from customer) + (select count(*) from orders) + (select count(*) from supplier)")
def merge_source_counts(spark, sf_dir):
    names = ("customer", "orders", "supplier")
    rows = [S.table(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit(n)) for n in names]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return every.rollup("source").agg(F.sum("n").alias("n"))


@query(f"with {L}, {T} select 'ledger_seq_to_lcm' as store, count(*) as entries, sum(4 + 8)::bigint as bytes_written from ledgers union all select 'tx_hash_to_tx_data', count(*), sum(32 + strlen(envelope) + strlen(result))::bigint from txs union all select 'tx_hash_to_ledger_seq', count(distinct tx_hash), count(distinct tx_hash) * 36 from txs")
def write_batch_bytes(spark, sf_dir):
    """Entries and key-value bytes that each derived table gets."""
    txs = S.transactions(spark, sf_dir)
    a = S.ledgers(spark, sf_dir).agg(F.lit("ledger_seq_to_lcm").alias("store"), F.count(F.lit(1)).alias("entries"), F.sum(F.lit(12)).alias("bytes_written"))
    b = txs.agg(F.lit("tx_hash_to_tx_data").alias("store"), F.count(F.lit(1)).alias("entries"), F.sum(32 + F.octet_length("envelope") + F.octet_length("result")).alias("bytes_written"))
    c = txs.agg(F.countDistinct("tx_hash").alias("entries")).select(F.lit("tx_hash_to_ledger_seq").alias("store"), "entries", (F.col("entries") * 36).alias("bytes_written"))
    return a.unionByName(b).unionByName(c)


@query(f"""with {L}, {T}, l as (select (ledger_seq - 2) // 1000 + 1 as batch_no, count(*) as ledgers, min(ledger_seq) as first, max(ledger_seq) as last from ledgers group by 1), t as (select (ledger_seq - 2) // 1000 + 1 as batch_no, count(*) as txs, sum(strlen(envelope) + strlen(result))::bigint as bytes from txs group by 1)
select batch_no, first, last, ledgers, coalesce(txs, 0) as txs, round(coalesce(txs, 0) / ledgers, 6) as txs_per_ledger, case when txs is null then 0 else bytes // txs end as bytes_per_tx from l left join t using (batch_no)""")
def batch_summary(spark, sf_dir):
    """Range, counts and averages of each batch."""
    number = batch_of(F.col("ledger_seq"), 2, 1000).alias("batch_no")
    found = S.ledgers(spark, sf_dir).groupBy(number).agg(F.count(F.lit(1)).alias("ledgers"), F.min("ledger_seq").alias("first"), F.max("ledger_seq").alias("last"))
    txs = S.transactions(spark, sf_dir).groupBy(number).agg(F.count(F.lit(1)).alias("txs"), F.sum(F.octet_length("envelope") + F.octet_length("result")).alias("bytes"))
    out = found.join(txs, "batch_no", "left").withColumn("bytes_per_tx", F.when(F.col("txs").isNull(), 0).otherwise(F.expr("bytes div txs"))).withColumn("txs", F.coalesce("txs", F.lit(0)))
    return out.select("batch_no", "first", "last", "ledgers", "txs", F.round(F.col("txs") / F.col("ledgers"), 6).alias("txs_per_ledger"), "bytes_per_tx")


@query("with r as (select l_returnflag, l_linestatus, sum(l_linenumber)::bigint as n from lineitem group by rollup(l_returnflag, l_linestatus)) select * from r")
def grouped_totals(spark, sf_dir):
    """Counters kept for each worker and for all, as a rollup."""
    return S.table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_linenumber").alias("n"))
