"""Queries that write to the shared folder and read back: files, compaction, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import derive as D
from ..operators import maintain as M
from ..session import new_path
from ..sources import chunkstore, lists, rawfile
from ..sources import ledgers as S
from ..streaming import lookups as stream
from .base import query

L, T = S.SQL_LEDGERS, S.SQL_TXS
N = "payloads as (select ledger_seq, strftime(closed_at, '%Y-%m-%d') || coalesce('|' || (select string_agg(tx_hash, ',' order by tx_index) from txs t where t.ledger_seq = l.ledger_seq), '') as payload from ledgers l)"


def payloads(spark, sf_dir):
    """ledger_seq and the ledger's contents as bytes."""
    txs = S.transactions(spark, sf_dir).groupBy("ledger_seq").agg(F.sort_array(F.collect_list(F.struct("tx_index", "tx_hash"))).alias("t"))
    rows = S.ledgers(spark, sf_dir).join(txs, "ledger_seq", "left")
    return rows.select("ledger_seq", F.encode(F.concat_ws("|", F.date_format("closed_at", "yyyy-MM-dd"), F.concat_ws(",", F.transform("t", lambda x: x["tx_hash"]))), "UTF-8").alias("payload"), F.col("t").isNotNull().alias("filled"))


@query(f"with {T} select tx_hash, ledger_seq, count(*) as n from txs group by 1, 2")
def raw_file_roundtrip(spark, sf_dir):
    txs = S.transactions(spark, sf_dir).select("tx_hash", "ledger_seq")
    path = new_path(spark, "raw")
    rawfile.packed(txs, 20_000).write.parquet(path)
    return rawfile.split(spark.read.parquet(path)).groupBy("tx_hash", "ledger_seq").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {L}, {T}, p as (select ledger_seq, strftime(closed_at, '%Y-%m-%d') || '|' || coalesce(string_agg(tx_hash, ',' order by tx_index), '') as payload from ledgers left join txs using (ledger_seq) group by ledger_seq, closed_at) select ledger_seq, md5(payload) as digest from p where ledger_seq between 900 and 2600")
def chunk_store_range(spark, sf_dir):
    """Ledgers stored as compressed chunks of 500, then a range of them."""
    path = new_path(spark, "chunks")
    chunkstore.write(payloads(spark, sf_dir).select("ledger_seq", "payload"), path, 500)
    return chunkstore.decoded(spark.read.parquet(path), 500, 900, 2600).select("ledger_seq", F.md5("payload").alias("digest"))


@query(f"with {L}, {T}, p as (select ledger_seq, strftime(closed_at, '%Y-%m-%d') || '|' || coalesce(string_agg(tx_hash, ',' order by tx_index), '') as payload from ledgers left join txs using (ledger_seq) group by ledger_seq, closed_at) select ledger_seq, md5(payload) as digest from p")
def chunk_files_roundtrip(spark, sf_dir):
    """Every ledger stored in chunk files of 500, and read back by its two offsets."""
    path = new_path(spark, "chunkfiles")
    chunkstore.write_files(payloads(spark, sf_dir), path, 500)
    return chunkstore.read_records(S.ledgers(spark, sf_dir), path, 500).select("ledger_seq", F.md5("payload").alias("digest"))


@query(f"with {T} select tx_hash, ledger_seq, count(*) as n from txs group by 1, 2")
def raw_files_roundtrip(spark, sf_dir):
    """Every transaction as a record of a raw hash file, and read back."""
    path = new_path(spark, "rawfiles")
    rawfile.write_files(S.transactions(spark, sf_dir), path, 20_000)
    return rawfile.read(spark, path).groupBy("tx_hash", "ledger_seq").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {L} select (ledger_seq - 2) // 500 as chunk_id, count(*) as records, 1 as version, 4 as width from ledgers group by 1")
def chunk_index_header(spark, sf_dir):
    """What the index of each chunk of 500 ledgers says."""
    index = chunkstore.encoded(payloads(spark, sf_dir).select("ledger_seq", "payload"), 500)
    byte = lambda k: F.conv(F.hex(F.expr(f"substring(index, {k}, 1)")), 16, 10).cast("int")
    return index.select("chunk_id", F.expr(f"(octet_length(index) - {chunkstore.HEADER}) div 4 - 1").cast("long").alias("records"), byte(1).alias("version"), byte(2).alias("width"))


@query("select l_returnflag, count(*) as n, sum(l_linenumber)::bigint as lines from lineitem group by 1")
def compact_rewrite(spark, sf_dir):
    """A table written in many files and compacted; the rows are the same."""
    many, few = new_path(spark, "many"), new_path(spark, "few")
    S.table(spark, sf_dir, "lineitem").repartition(16).write.parquet(many)
    M.compact(spark, many, few, 16 << 20)
    return spark.read.parquet(few).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


@query("select o_custkey, count(*) as n, min(o_orderkey) as first, max(o_orderkey) as last from orders group by 1")
def copy_store(spark, sf_dir):
    path = new_path(spark, "copy")
    M.copy(S.table(spark, sf_dir, "orders"), path, "o_orderkey", "streaming")
    return spark.read.parquet(path).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query(f"with {L}, {T} select tx_hash, ledger_seq, closed_at, tx_index, envelope, result from txs join ledgers using (ledger_seq)")
def txdata_blob_roundtrip(spark, sf_dir):
    """Transactions in their stored form, and back."""
    from ..functions import txdata

    path = new_path(spark, "blobs")
    txdata.encode(D.tx_data(S.ledgers(spark, sf_dir), S.transactions(spark, sf_dir))).write.parquet(path)
    return txdata.decode(spark.read.parquet(path)).withColumn("closed_at", F.col("closed_at").cast("timestamp_ntz"))


@query()
def zstd_size_stats(spark, sf_dir):
    """Sizes of the documents before and after compression, by source."""
    import pyarrow as pa

    from ..operators.stats import sizes

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor()
        for b in batches:
            raw = [(x.as_py() or "").encode() for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("source"), pa.array([len(x) for x in raw], pa.int64()), pa.array([len(press.compress(x)) for x in raw], pa.int64())], ["source", "raw", "stored"])

    rows = S.table(spark, sf_dir, "documents").select("source", "text").mapInArrow(run, "source string, raw long, stored long")
    return sizes(rows, ["source"], "raw", "stored")


@query(f"with {L} select ledger_seq, closed_at, (ledger_seq - 2) // 10000 as chunk_id from ledgers where ledger_seq between 9000 and 10500")
def ledger_store_range(spark, sf_dir):
    """A stored ledger table, read by range with its chunks pruned."""
    path = new_path(spark, "ledgers")
    S.write_ledgers(S.ledgers(spark, sf_dir), path, 4)
    return S.read_range(spark.read.parquet(path), 9000, 10500).select("ledger_seq", "closed_at", F.col("chunk_id").cast("long").alias("chunk_id"))


@query(f"with {T} select case when k % 5 = 1 then 'NOT_IN_INDEX' else case when k % 5 = 2 then 'INVALID_INPUT' else 'FOUND' end end as outcome, count(*) as n from (select row_number() over (order by tx_hash) as k from txs where starts_with(tx_hash, '0a')) group by 1")
def stream_lookup_totals(spark, sf_dir):
    """Running totals of a stream of queries, some spoilt, with commands between them."""
    txs = S.transactions(spark, sf_dir)
    asked = D.numbered(txs.where("startswith(tx_hash, '0a')").select("tx_hash"), "tx_hash").select("tx_hash", (F.col("number") + 1).alias("k"))
    line = F.when(F.col("k") % 5 == 1, F.sha2("tx_hash", 256)).when(F.col("k") % 5 == 2, F.lit("zz")).otherwise(F.concat(F.lit("0x"), F.upper("tx_hash")))
    return totals_of(spark, asked.select(line.alias("value")), txs)


def totals_of(spark, lines, txs):
    """Running totals of a stream of ``lines(value)`` and of commands."""
    commands = spark.range(1).select(F.explode(F.array(F.lit("stats"), F.lit(""), F.lit("STOP"))).alias("value"))
    folder = new_path(spark, "stdin")
    lines.union(commands).repartition(3).write.text(folder)
    name = f"totals_{folder[-12:]}"
    stream.run_totals(spark, folder, D.hash_to_seq(txs), txs, new_path(spark, "progress"), name).awaitTermination()
    return spark.table(name)


@query(f"with {T} select case tx_hash[64] when '1' then 'NOT_IN_INDEX' when '2' then 'INVALID_INPUT' else 'FOUND' end as outcome, count(*) as n from txs group by 1")
def stream_lookup_totals_all(spark, sf_dir):
    """The same for every transaction; the last digit of its hash says which are spoilt."""
    txs = S.transactions(spark, sf_dir)
    digit = F.substring("tx_hash", 64, 1)
    line = F.when(digit == "1", F.sha2("tx_hash", 256)).when(digit == "2", F.lit("zz")).otherwise(F.concat(F.lit("0x"), F.upper("tx_hash")))
    return totals_of(spark, txs.select(line.alias("value")), txs)


@query(f"with {T} select case tx_hash[64] when '1' then 'NOT_IN_INDEX' when '2' then 'INVALID_INPUT' else 'FOUND' end as outcome, count(*) as n from txs group by 1")
def stream_interactive_stats(spark, sf_dir):
    """What STOP reports after a file that asks for every transaction; the file after it is not answered."""
    folder, stores, out = (new_path(spark, n) for n in ("stdin", "stores", "answers"))
    txs = S.transactions(spark, sf_dir)
    D.hash_to_seq(txs).write.parquet(f"{stores}/seqs")
    txs.select("tx_hash", "ledger_seq").write.parquet(f"{stores}/txs")
    digit = F.substring("tx_hash", 64, 1)
    line = F.when(digit == "1", F.sha2("tx_hash", 256)).when(digit == "2", F.lit("zz")).otherwise(F.concat(F.lit("0x"), F.upper("tx_hash")))
    txs.select(line.alias("value")).repartition(3).write.text(folder)
    for late in ("stop", "zz"):
        spark.range(1).select(F.lit(late).alias("value")).write.mode("append").text(folder)
    stream.run_interactive(spark, folder, spark.read.parquet(f"{stores}/seqs"), spark.read.parquet(f"{stores}/txs"), new_path(spark, "progress"), out)
    return spark.read.parquet(f"{out}/stats").select("outcome", "n")


@query("select o_custkey, max(o_orderkey) as o_orderkey from orders group by 1")
def stream_ingest(spark, sf_dir):
    """Micro-batches of orders upserted into a table of each customer's last order."""
    source, target = new_path(spark, "arrivals"), new_path(spark, "table")
    rows = S.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    rows.repartitionByRange(3, "o_orderkey").write.parquet(source)
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def write(batch, number):
        # one folder for each micro-batch: doing it again replaces it
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.ingest(arriving, ["o_custkey"], ["o_orderkey"], write, new_path(spark, "progress")).awaitTermination()
    return D.last_wins(spark.read.parquet(target), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query(f"with {T} select tx_hash from txs where starts_with(tx_hash, '0c') union all select sha256('absent|' || range) from range(100)")
def query_list_with_absent(spark, sf_dir):
    return lists.shuffled_with_absent(S.transactions(spark, sf_dir).where("startswith(tx_hash, '0c')"), 100, 7)


@query(f"with {T} select tx_hash from txs union all select sha256('absent|' || range) from range(100)")
def query_list_with_absent_all(spark, sf_dir):
    return lists.shuffled_with_absent(S.transactions(spark, sf_dir), 100, 7)


@query("select 50::bigint as n, 50::bigint as distinct_n, true as inside")
def sampled_ledgers(spark, sf_dir):
    """A sample without replacement; which ledgers it has depends on the seed."""
    s = lists.sampled_ledgers(spark, 2, 5000, 50, 3)
    return s.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ledger_seq").alias("distinct_n"), F.min(F.col("ledger_seq").between(2, 5000)).alias("inside"))
