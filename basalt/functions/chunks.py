"""Chunk arithmetic: ledgers are numbered from 2 and stored in chunks of 10,000."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_LEDGER = 2
CHUNK = 10_000


def chunk_of(seq: Column, size: int = CHUNK) -> Column:
    return F.floor((seq - FIRST_LEDGER) / size).cast("long")


def chunk_first(chunk: Column, size: int = CHUNK) -> Column:
    return chunk * size + FIRST_LEDGER


def chunk_last(chunk: Column, size: int = CHUNK) -> Column:
    return (chunk + 1) * size + FIRST_LEDGER - 1


def local_index(seq: Column, size: int = CHUNK) -> Column:
    return (seq - FIRST_LEDGER) % size


def chunk_path(chunk: Column, suffix: str) -> Column:
    return F.concat(F.lit("chunks/"), F.lpad(F.floor(chunk / 1000).cast("string"), 4, "0"), F.lit("/"), F.lpad(chunk.cast("string"), 6, "0"), F.lit(f".{suffix}"))


def is_aligned_start(seq: Column, size: int = CHUNK) -> Column:
    return (seq >= FIRST_LEDGER) & (local_index(seq, size) == 0)


def is_aligned_end(seq: Column, size: int = CHUNK) -> Column:
    return (seq >= FIRST_LEDGER) & (local_index(seq, size) == size - 1)


def batch_of(seq: Column, start: int, size: int) -> Column:
    """Batches count from 1."""
    return F.floor((seq - start) / size).cast("long") + 1


def valid_ledger(seq: Column) -> Column:
    return seq.between(FIRST_LEDGER, 4294967295)
