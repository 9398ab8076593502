"""Helpers that several operators share: staging, text buffers, held-out folds."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete, new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str = "stage", compression: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options or {}).parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


#: For tables of rows of about a megabyte. Parquet looks at sizes every 100 rows only, so that its pages and row groups
#: reach 30 to 100 MB, which writers, codecs and readers hold whole in each task.
LONG_ROWS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "2", "parquet.block.size.row.check.max": "8", "parquet.page.size.row.check.min": "2", "parquet.page.size.row.check.max": "8"}


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    delete(df.sparkSession, df._staged_at)


#: Texts and lists are long, and each batch of rows is held several times on its way to Python and back.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20, "spark.sql.parquet.columnarReaderBatchSize": 256}


def small_batches(spark: SparkSession) -> dict[str, str]:
    """Lower the session's batch settings to BATCHES, and return those it had."""
    before = {c: spark.conf.get(c) for c in BATCHES}
    for c, most in BATCHES.items():
        now = before[c].rstrip("bB")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(c, str(most))
    return before


def in_small_batches(operator):
    """Run the jobs that ``operator`` starts with small batches. The session's settings are as before when it returns.

    What it returns is evaluated later; whoever does may call ``small_batches`` for the session, as the registered queries do.
    """

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs):
        before = small_batches(docs.sparkSession)
        try:
            return operator(docs, *args, **kwargs)
        finally:
            for c, value in before.items():
                docs.sparkSession.conf.set(c, value)

    return run


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(-1))


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string (UTF-8) or binary column and the offsets of its rows (nulls are empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    raw = pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null(b"" if raw else "")
    col = col.cast(pa.large_binary() if raw else pa.large_string())
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def spans(offsets: np.ndarray, most: int):
    """Ranges of rows of at most ``most`` bytes each, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LOWER_NP = np.frombuffer(LOWER, np.uint8)


def without(docs: DataFrame, ids: DataFrame, broadcast_rows: int = 1_000_000, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose ``key`` is not in ``ids``; ids are broadcast only if they are few."""
    ids = staged(ids.select(key).where(F.col(key).isNotNull()).distinct(), "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= broadcast_rows else ids, key, "left_anti").select(*docs.columns)


ODD_KEY = 1 << 62


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a column ``key`` that is the doc_id of rows which alone have it.

    Rows with a null doc_id and rows that share one get a number from ODD_KEY on, by a hash of doc_id and text: rows are
    judged each by its own text, and only those equal in both share a key.
    """
    again = staged(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated")
    own = F.lit(ODD_KEY) + F.xxhash64("doc_id", "text").bitwiseAND((1 << 61) - 1)
    if again.isEmpty():
        return docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), own))
    alone = docs.join(again, "doc_id", "left_anti").select(*docs.columns)
    shared = docs.join(again, "doc_id", "left_semi").select(*docs.columns)
    return alone.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), own)).unionByName(shared.withColumn(key, own))
