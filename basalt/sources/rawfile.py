"""Raw hash files: records of 36 bytes, a 32-byte hash and a big-endian sequence number, without a header."""

from __future__ import annotations

import itertools
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import bytes_to_hex, bytes_to_uint32, uint32_to_bytes
from .files import new_file, place

RECORD = 36
AT_ONCE = 10_000


def records(hashes: DataFrame) -> DataFrame:
    """The 36 bytes of each row of ``hashes(tx_hash, ledger_seq)``; repeated rows stay."""
    return hashes.select(F.concat(F.unhex("tx_hash"), uint32_to_bytes(F.col("ledger_seq"))).alias("record"))


def packed(hashes: DataFrame, per_file: int = 100_000) -> DataFrame:
    """part, content: the records in pieces of about ``per_file``, each the content of one file."""
    rows = records(hashes)
    parts = max(1, -(-rows.count() // per_file))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("record"), F.lit(parts)))
    joined = F.unhex(F.concat_ws("", F.transform(F.sort_array(F.collect_list("record")), F.hex)))
    return dealt.groupBy("part").agg(joined.alias("content"))


def write_files(hashes: DataFrame, path: str, per_file: int = 1_000_000) -> int:
    """Write the records to files of about ``per_file`` under ``path`` and return how many there are.

    A record's file follows from its bytes, so a repeated write replaces each file by an equal one,
    and a task that is done twice does no harm. A null hash fails the job.
    """
    rows = records(hashes)
    parts = max(1, -(-rows.count() // per_file))

    def pieces(batches):
        for b in batches:
            part, column = b.column("part").to_numpy(), b.column("record")
            if column.null_count:
                raise ValueError("raw hash file: a row without a hash or a sequence number")
            raw = memoryview(column.cast(pa.binary(RECORD)).buffers()[1])
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            yield from ((int(part[lo]), raw[lo * RECORD : hi * RECORD]) for lo, hi in itertools.pairwise(cuts) if hi > lo)

    def run(batches):
        for part, group in itertools.groupby(pieces(batches), itemgetter(0)):
            with new_file(f"{path.rstrip('/')}/part-{part:06d}.raw") as out:
                size = sum(out.write(raw) for _, raw in group)
            yield pa.RecordBatch.from_arrays([pa.array([size // RECORD], pa.int64())], ["n"])

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("record"), F.lit(parts))).repartition("part").sortWithinPartitions("part", "record")
    return dealt.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def checked(size: Column) -> Column:
    """The size of a raw file; 0, or a size that is no multiple of 36 bytes, fails."""
    bad = (size == 0) | (size % RECORD != 0)
    return F.when(bad, F.raise_error(F.concat(F.lit("raw hash file of "), size.cast("string"), F.lit(" bytes"))).cast("long")).otherwise(size)


def fields(rows: DataFrame) -> DataFrame:
    return rows.select("rec_no", bytes_to_hex(F.expr("substring(record, 1, 32)")).alias("tx_hash"), bytes_to_uint32(F.expr("substring(record, 33, 4)")).alias("ledger_seq"))


def split(files: DataFrame) -> DataFrame:
    """rec_no, tx_hash, ledger_seq of ``files(content)``; an empty file, or one that is no multiple of 36 bytes, fails."""
    rows = files.select("content", checked(F.octet_length("content").cast("long")).alias("size"))
    rows = rows.select("content", F.explode(F.sequence(F.lit(0), F.expr(f"cast(size div {RECORD} - 1 as int)"))).alias("rec_no"))
    record = F.substring(F.col("content"), F.col("rec_no") * RECORD + 1, F.lit(RECORD))
    return fields(rows.select(F.col("rec_no").cast("long").alias("rec_no"), record.alias("record")))


def listed(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the files at ``path``, drafts of lost tasks left out. Spark's own listing would pass over empty files."""
    store, name = place(path)
    info = store.get_file_info(name)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else store.get_file_info(pafs.FileSelector(name))
    return sorted((f.path, f.size) for f in found if f.is_file and not f.path.endswith(".tmp"))


def read(spark: SparkSession, path: str, per_task: int = 1_000_000) -> DataFrame:
    """The same of raw files of any size: they are cut into runs of ``per_task`` records, each read in pieces by one task."""
    files = spark.createDataFrame(listed(path), "path string, size long").select("path", checked(F.col("size")).alias("size"))
    whole = files.select("path", F.expr(f"size div {RECORD}").alias("n"))
    runs = whole.select("path", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(per_task).cast("long"))).alias("first"))
    runs = runs.select("path", "first", F.least(F.col("n"), F.col("first") + per_task).alias("end")).repartition("path", "first")

    def read_runs(batches):
        store, _ = place(path)
        for b in batches:
            for name, first, end in zip(*[b.column(c).to_pylist() for c in ("path", "first", "end")], strict=True):
                with store.open_input_file(name) as source:
                    for lo in range(first, end, AT_ONCE):
                        n = min(AT_ONCE, end - lo)
                        raw = pa.py_buffer(source.read_at(n * RECORD, lo * RECORD))
                        record = pa.FixedSizeBinaryArray.from_buffers(pa.binary(RECORD), n, [None, raw]).cast(pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + n)), record], ["rec_no", "record"])

    return fields(runs.mapInArrow(read_runs, "rec_no long, record binary"))
