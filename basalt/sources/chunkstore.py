"""Chunk files: records in NNNNNN.data, their offsets in NNNNNN.index.

An index has a version byte (1), the width of an offset in bytes (4, or 8 if the last offset needs
it), six zero bytes, and one little-endian offset for each record and one for the end. A chunk is
complete only with both files; an incomplete one is written anew.

Chunks are bounded in records (10,000), not in bytes. ``write_files`` and ``read_records`` hold one
record at a time and the offsets of one chunk; the forms with a chunk in a cell (``encoded``,
``decoded``, ``read_files``) are for chunks that fit in one.
"""

from __future__ import annotations

import itertools
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.chunks import CHUNK, FIRST_LEDGER, chunk_of
from .files import new_file, place

VERSION = 1
HEADER = 8
FLUSH = 8 << 20
FILE_NAME = r"/(\d{6,})\.(data|index)$"


def offsets(sized: DataFrame, size: int = CHUNK) -> DataFrame:
    """ledger_seq, chunk_id, start_offset, end_offset of ``sized(ledger_seq, bytes)``: running sums within each chunk."""
    rows = sized.withColumn("chunk_id", chunk_of(F.col("ledger_seq"), size))
    end = F.sum("bytes").over(Window.partitionBy("chunk_id").orderBy("ledger_seq").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("ledger_seq", "chunk_id", (end - F.col("bytes")).alias("start_offset"), end.alias("end_offset"))


def encode_index(ends: list[int]) -> bytes:
    width = 8 if ends and ends[-1] > 0xFFFFFFFF else 4
    return bytes([VERSION, width, 0, 0, 0, 0, 0, 0]) + b"".join(x.to_bytes(width, "little") for x in [0, *ends])


def decode_index(raw: bytes) -> list[int]:
    if len(raw) < HEADER or raw[0] != VERSION:
        raise ValueError("chunk index: unknown version")
    width = raw[1]
    if width not in (4, 8) or (len(raw) - HEADER) % width or len(raw) == HEADER:
        raise ValueError("chunk index: bad offset width")
    return [int.from_bytes(raw[k : k + width], "little") for k in range(HEADER, len(raw), width)]


def encoded(records: DataFrame, size: int = CHUNK) -> DataFrame:
    """chunk_id, data, index: the two files of each chunk of ``records(ledger_seq, payload)``, records compressed one by one."""

    def run(table: pa.Table) -> pa.Table:
        import zstandard

        table = table.sort_by("ledger_seq")
        press = zstandard.ZstdCompressor()
        parts = [press.compress(x.as_py()) for x in table.column("payload")]
        ends, at = [], 0
        for x in parts:
            at += len(x)
            ends.append(at)
        return pa.table({"chunk_id": table.column("chunk_id")[:1].cast(pa.int64()), "data": pa.array([b"".join(parts)], pa.binary()), "index": pa.array([encode_index(ends)], pa.binary())})

    rows = records.select("ledger_seq", "payload", chunk_of(F.col("ledger_seq"), size).alias("chunk_id"))
    return rows.groupBy("chunk_id").applyInArrow(run, "chunk_id long, data binary, index binary")


def decoded(chunks: DataFrame, size: int = CHUNK, first: int | None = None, last: int | None = None) -> DataFrame:
    """ledger_seq, payload of the chunks' records, only those from ``first`` to ``last``: others are not even decompressed.

    The records of a chunk are those from its first ledger on, without gaps.
    """
    if first is not None:
        chunks = chunks.where(F.col("chunk_id") >= (first - 2) // size)
    if last is not None:
        chunks = chunks.where(F.col("chunk_id") <= (last - 2) // size)

    def run(batches):
        import zstandard

        expand = zstandard.ZstdDecompressor()
        for b in batches:
            for chunk, data, index in zip(b.column("chunk_id").to_pylist(), b.column("data"), b.column("index"), strict=True):
                at, raw = decode_index(index.as_py()), memoryview(data.as_py())
                base = chunk * size + 2
                lo = 0 if first is None else max(0, first - base)
                hi = len(at) - 1 if last is None else min(len(at) - 1, last - base + 1)
                seqs = list(range(base + lo, base + max(lo, hi)))
                yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array([expand.decompress(raw[at[k] : at[k + 1]]) for k in range(lo, max(lo, hi))], pa.binary())], ["ledger_seq", "payload"])

    return chunks.select("chunk_id", "data", "index").mapInArrow(run, "ledger_seq long, payload binary")


def write(records: DataFrame, path: str, size: int = CHUNK, force: bool = False) -> None:
    """Store the chunks of ``records`` as rows under ``path``; chunks that are there are left alone unless ``force``."""
    spark = records.sparkSession
    new = records
    if not force and exists(spark, path):
        there = spark.read.parquet(path).select("chunk_id")
        new = records.withColumn("chunk_id", chunk_of(F.col("ledger_seq"), size)).join(there, "chunk_id", "left_anti").drop("chunk_id")
    out = encoded(new, size).withColumn("folder", F.floor(F.col("chunk_id") / 1000))
    out.write.mode("overwrite" if force else "append").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def chunk_path(path: str, chunk: int) -> str:
    """The files of a chunk, without their endings: a folder for each 1,000 chunks."""
    return f"{path.rstrip('/')}/chunks/{chunk // 1000:04d}/{chunk:06d}"


def file_names(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, kind (data or index) and content of the chunk files under ``path``; content is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    n = F.regexp_extract("path", FILE_NAME, 1)
    return files.where(n != "").select(n.cast("long").alias("chunk_id"), F.regexp_extract("path", FILE_NAME, 2).alias("kind"), "content")


def whole_chunks(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id of the chunks that have both files."""
    return file_names(spark, path).groupBy("chunk_id").agg(F.count_distinct("kind").alias("kinds")).where("kinds = 2").select("chunk_id")


def write_files(records: DataFrame, path: str, size: int = CHUNK, force: bool = False) -> dict[str, int]:
    """Write ``records(ledger_seq, payload)`` as chunk files, and return how many chunks, records and bytes were written.

    Records go to their file one by one, compressed, in order; the index follows, so a chunk with
    both files is whole. Whole chunks that are there are left alone unless ``force``. A chunk that
    lacks a ledger before its last one, or has one twice, fails the job, and so does a null payload.
    """
    spark = records.sparkSession

    def rows(batches):
        for b in batches:
            yield from zip(b.column("chunk_id").to_pylist(), b.column("ledger_seq").to_pylist(), b.column("payload"), strict=True)

    def store(chunk: int, group) -> tuple[int, int]:
        import zstandard

        press, name, ends, at = zstandard.ZstdCompressor(), chunk_path(path, chunk), [], 0
        with new_file(f"{name}.data") as out:
            for expected, (_, seq, payload) in enumerate(group, chunk * size + FIRST_LEDGER):
                if seq != expected or not payload.is_valid:
                    raise ValueError(f"chunk {chunk}: ledger {expected} is missing" if seq != expected else f"ledger {seq} has no payload")
                at += out.write(press.compress(payload.as_py()))
                ends.append(at)
        with new_file(f"{name}.index") as out:
            out.write(encode_index(ends))
        return len(ends), at

    def run(batches):
        for chunk, group in itertools.groupby(rows(batches), itemgetter(0)):
            n, size_of = store(chunk, group)
            yield pa.RecordBatch.from_pydict({"records": pa.array([n], pa.int64()), "bytes": pa.array([size_of], pa.int64())})

    new = records.select("ledger_seq", "payload", chunk_of(F.col("ledger_seq"), size).alias("chunk_id"))
    if not force and exists(spark, path):
        new = new.join(whole_chunks(spark, path), "chunk_id", "left_anti")
    dealt = new.repartition("chunk_id").sortWithinPartitions("chunk_id", "ledger_seq")
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(FLUSH))
    try:
        done = dealt.mapInArrow(run, "records long, bytes long").agg(F.count(F.lit(1)), F.sum("records"), F.sum("bytes")).first()
    finally:
        spark.conf.set(limit, before)
    return {"chunks": done[0], "records": done[1] or 0, "bytes": done[2] or 0}


class OpenChunk:
    """A chunk whose two files are open: a record costs two offsets of the index and its own bytes of the data."""

    def __init__(self, path: str, chunk: int):
        store, name = place(chunk_path(path, chunk))
        self.index, self.data = store.open_input_file(f"{name}.index"), store.open_input_file(f"{name}.data")
        head = self.index.read_at(HEADER, 0)
        if len(head) < HEADER or head[0] != VERSION or head[1] not in (4, 8):
            raise ValueError(f"chunk index {name}: unknown version or width")
        self.width = head[1]
        self.records = (self.index.size() - HEADER) // self.width - 1

    def record(self, k: int) -> bytes | None:
        if k >= self.records:
            return None
        pair = self.index.read_at(2 * self.width, HEADER + k * self.width)
        start, end = int.from_bytes(pair[: self.width], "little"), int.from_bytes(pair[self.width :], "little")
        return self.data.read_at(end - start, start)

    def close(self) -> None:
        self.index.close()
        self.data.close()


def read_records(asked: DataFrame, path: str, size: int = CHUNK) -> DataFrame:
    """ledger_seq, payload for each of ``asked(ledger_seq)``; no payload where the chunk or the record is not there.

    Sorted within tasks, so ledgers of one chunk share its open files. Points and ranges
    (``spark.range``) are read alike, and nothing but the records asked for.
    """

    def run(batches):
        import zstandard

        expand, held, at = zstandard.ZstdDecompressor(), None, None
        for b in batches:
            seqs, found, weight = [], [], 0
            for seq in b.column("ledger_seq").to_pylist():
                raw = None
                if seq is not None and seq >= FIRST_LEDGER:
                    chunk, k = divmod(seq - FIRST_LEDGER, size)
                    if chunk != at:
                        if held:
                            held.close()
                        at = chunk
                        try:
                            held = OpenChunk(path, chunk)
                        except FileNotFoundError:
                            held = None
                    raw = held.record(k) if held else None
                seqs.append(seq)
                found.append(None if raw is None else expand.decompress(raw))
                weight += len(found[-1] or b"")
                if weight >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(found, pa.binary())], ["ledger_seq", "payload"])
                    seqs, found, weight = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(found, pa.binary())], ["ledger_seq", "payload"])
        if held:
            held.close()

    return asked.select(F.col("ledger_seq").cast("long").alias("ledger_seq")).sortWithinPartitions("ledger_seq").mapInArrow(run, "ledger_seq long, payload binary")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, data, index from a tree of chunk files; a chunk without both files is left out."""
    named = file_names(spark, path)
    part = lambda kind: named.where(F.col("kind") == kind).select("chunk_id", F.col("content").alias(kind))
    return part("data").join(part("index"), "chunk_id")
