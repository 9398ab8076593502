"""WARC archives: writing, and reading by boundary-chain verification.

Writing. Of records with equal payloads (SHA-256) of at least ``revisit_bytes``, that with the
smallest page_id is a response and the others are revisits of it, which hold HTTP headers only.
Records are the rows of Spark's text sink with the WARC record end as line separator, so files
are plain WARC and are rolled by size like any other output.

Reading. Files are split like text, at the start of the version line that opens a record ("magic",
WARC/1.0 or WARC/1.1); Spark cuts files into blocks, and rows of one block are pieces between magics.
A piece's offset in its file is a prefix sum of lengths within its block and over earlier blocks. Each
piece is a candidate record, whose header gives the offset of its successor. Inside a block the
candidates' chains are followed at once to where they leave the block; between blocks, pointer jumping
from the file start doubles the distance in each round. Only candidates on the chain from the file
start are records: magic inside a payload is never reached. Payloads that hold magic are put together
from their pieces in a second pass over the archive. That pass knows a piece by a digest of its bytes,
so it does not matter if Spark cuts the files into other blocks then.

Defined results: a null html is an empty payload. Pages of equal page_id and payload (ties) are each a
response if that page_id is the smallest. A null page_id is written as "null", read as null, and
never stands for equal payloads unless all their ids are null, when all are responses. A null url
is empty; line breaks in a url are percent-encoded. Long payloads are written and read whole. Other
columns, whatever their names, are ignored. An empty table gives an archive without records. A file
whose start is no record, or whose chain breaks, gives the records up to there. Records that hold
no HTTP message have their whole block as payload.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_path
from .common import staged

#: The version line of the records written, and what opens a record in any archive.
VERSION = "WARC/1.1\r\n"
MAGIC = "WARC/1."
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def to_records(pages: DataFrame, revisit_bytes: int = 100, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One WARC record (without the record end) for each row of ``pages(page_id, url, html)``, as ``value``."""
    payload = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("digest", F.sha2(F.encode("payload", "UTF-8"), 256)).withColumn("bytes", F.octet_length("payload"))
    first = payload.where(F.col("bytes") >= revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first")
    first = staged(first, "firsts")
    known = payload.join(F.broadcast(first) if first.count() <= broadcast_rows else first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    lines = [
        F.when(revisit, "WARC-Type: revisit").otherwise("WARC-Type: response"), F.concat(F.lit("WARC-Record-ID: "), urn("page_id")), F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")), F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn("first"))), F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http;msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return known.select(F.concat(F.lit(VERSION), F.concat_ws("\r\n", *lines), F.lit(END), block).alias("value"))


def write(pages: DataFrame, path: str | None = None, **options) -> str:
    """Write ``pages`` as an archive folder (default: in the shared folder) and return its path."""
    path = path or new_path(pages.sparkSession, "warc")
    to_records(pages, **options).write.option("lineSep", END).text(path)
    return path


def header(name: str, at: str = "header"):
    return F.nullif(F.regexp_extract(at, rf"(?i)(?:^|\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def pieces(spark, path: str) -> DataFrame:
    """Rows between magics: file, block, row (increasing within a block), value (after the magic), same (two hashes and the length of its bytes)."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value", F.struct(F.xxhash64("value").alias("a"), F.xxhash64(F.lit(1), "value").alias("b"), F.octet_length("value").alias("n")).alias("same"))


def parsed(df: DataFrame) -> DataFrame:
    """Adds to ``value`` its bytes, the length of the record (or null), whether value is all of it, and the record's fields."""
    df = df.withColumn("bytes", F.octet_length("value")).withColumn("header", F.substring_index("value", END, 1))
    df = df.withColumn("content", header("Content-Length").cast("string"))
    df = df.withColumn("content", F.when(F.col("value").rlike("^[01]\r\n") & F.col("content").rlike("^[0-9]{1,15}$") & (F.octet_length("header") + 4 <= F.col("bytes")), F.col("content").cast("long")))
    df = df.withColumn("length", F.octet_length("header") + 4 + F.col("content") + 4)
    df = df.withColumn("whole", F.coalesce(F.col("length") == F.col("bytes"), F.lit(False)))
    body = F.expr("substring(cast(value as binary), octet_length(header) + 5, content)")
    df = df.withColumn("body", F.when(F.col("whole"), body))
    plain = ~F.coalesce(header("Content-Type"), F.lit("application/http")).rlike("(?i)^application/http")
    df = df.withColumn("http", F.when(~plain, F.substring_index(F.col("body").cast("string"), END, 1)))
    payload = F.when(F.col("http").isNull(), F.col("body")).otherwise(F.expr("substring(body, octet_length(http) + 5)"))
    kind = header("WARC-Type")
    size = header("Content-Length", "http")
    df = df.withColumn("record_type", kind).withColumn("uri", header("WARC-Target-URI"))
    df = df.withColumn("page_id", F.regexp_extract(header("WARC-Record-ID"), "<urn:page:(.*)>", 1)).withColumn("refers_to", F.nullif(F.regexp_extract(F.coalesce(header("WARC-Refers-To"), F.lit("")), "<urn:page:(.*)>", 1), F.lit("")))
    df = df.withColumn("payload_bytes", F.when(F.col("record_type") == "revisit", F.when(size.rlike("^[0-9]{1,15}$"), size.cast("long"))).when(F.col("whole"), F.octet_length(payload).cast("long")))
    df = df.withColumn("payload_digest", F.when(F.col("record_type") == "revisit", F.regexp_replace(header("WARC-Payload-Digest"), "^sha256:", "")).when(F.col("whole"), F.sha2(payload, 256)))
    return df.drop("header", "content", "body", "http")


FIELDS = ["record_type", "uri", "page_id", "refers_to", "payload_bytes", "payload_digest"]


def candidates(spark, path: str) -> DataFrame:
    """Each magic of the archive: file, block, at (offset), next (its successor's offset, or null), whole, same, FIELDS."""
    every = parsed(pieces(spark, path)).drop("value")
    inner = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    every = staged(every.withColumn("before", F.coalesce(F.sum(F.col("bytes") + len(MAGIC)).over(inner), F.lit(0))), "pieces")
    blocks = every.groupBy("file", "block").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("total"))
    earlier = blocks.withColumn("base", F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("total")
    at = F.col("base") + F.col("before") - len(MAGIC)
    found = every.join(earlier, ["file", "block"]).withColumn("at", at).where("at >= 0")
    return found.select("file", "block", "at", (F.col("at") + len(MAGIC) + F.col("length")).alias("next"), "whole", "same", *FIELDS)


def successors(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of a block's candidates in order, their successors' offsets (-1: none), and those successors' places among them (-1: elsewhere)."""
    at = table.column("at").to_numpy()
    after = table.column("next").fill_null(-1).to_numpy()
    order = np.argsort(at)
    at, after = at[order], after[order]
    place = np.minimum(np.searchsorted(at, after), len(at) - 1)
    return at, after, np.where(at[place] == after, place, -1)


def leave(table: pa.Table) -> pa.Table:
    """For each candidate of a block, the first offset on its chain that is no candidate of the block."""
    at, after, place = successors(table)
    last = np.where(place >= 0, place, np.arange(len(at)))  # successors come later, so chains end
    while True:
        further = last[last]
        if (further == last).all():
            break
        last = further
    out = after[last]
    return pa.table({"file": pa.array([table.column("file")[0].as_py()] * len(at)), "at": pa.array(at), "exit": pa.array(out, pa.int64(), mask=out < 0)})


def follow(table: pa.Table) -> pa.Table:
    """For each candidate of a block, whether it is on the chain from the block's entry; and the record each piece is in."""
    at, after, place = successors(table)
    entry = table.column("entry")[0].as_py()
    now = -1 if entry is None else int(np.searchsorted(at, entry))
    chain = []
    while now >= 0:  # a step for each record of the block
        chain.append(now)
        now = int(place[now])
    real = np.zeros(len(at), bool)
    real[chain] = True
    inside = np.searchsorted(chain, np.arange(len(at)), side="right") - 1
    record = at[np.array(chain, np.int64)[inside]] if chain else np.zeros(len(at), np.int64)
    mask = inside < 0
    first = lambda c: [table.column(c)[0].as_py()] * len(at)
    return pa.table({"file": pa.array(first("file")), "block": pa.array(first("block")), "at": pa.array(at), "real": pa.array(real), "record": pa.array(record, pa.int64(), mask=mask)})


def entries(found: DataFrame) -> DataFrame:
    """Where the chain from the start of each file enters each block it meets: file, block, entry. Pointer jumping over blocks."""
    jump = staged(found.select("file", "block", "at", "next").groupBy("file", "block").applyInArrow(leave, "file string, at long, exit long"), "jumps")
    reached = staged(found.where("at = 0").select("file", "at").distinct(), "reached")
    n = reached.count()
    while True:
        step = reached.join(jump, ["file", "at"]).select("file", F.col("exit").alias("at")).where("at is not null")
        reached = staged(reached.unionByName(step).distinct(), "reached")
        n, before = reached.count(), n
        if n == before:
            break
        far = jump.select("file", F.col("at").alias("exit"), F.col("exit").alias("further"))
        jump = staged(jump.join(far, ["file", "exit"], "left").select("file", "at", F.when(F.col("further").isNull() & F.col("exit").isNotNull(), F.col("exit")).otherwise(F.col("further")).alias("exit")), "jumps")
    return found.select("file", "block", "at").join(reached, ["file", "at"]).select("file", "block", F.col("at").alias("entry"))


def read(spark, path: str) -> DataFrame:
    """The records of an archive folder: FIELDS and warc_file, warc_offset. Ids are strings; payload fields are of the full payload."""
    found = staged(candidates(spark, path), "candidates")
    chain = found.join(entries(found), ["file", "block"], "left").select("file", "block", "at", "next", "entry")
    marks = staged(chain.groupBy("file", "block").applyInArrow(follow, "file string, block long, at long, real boolean, record long"), "marks")
    records = found.join(marks.where("real").select("file", "at"), ["file", "at"])
    done = records.where("whole").select(*FIELDS, F.col("file").alias("warc_file"), F.col("at").alias("warc_offset"))
    cut = staged(records.where("not whole and next is not null").select("file", F.col("at").alias("record"), F.col("next").alias("stop")), "cut")
    if cut.isEmpty():
        return done
    last = marks.groupBy("file", "block").agg(F.max("record").alias("last"))
    carry = last.withColumn("carry", F.max("last").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    inside = marks.join(carry, ["file", "block"]).select("file", "at", F.coalesce("record", "carry").alias("record")).join(cut, ["file", "record"]).where("at < stop")
    where = staged(inside.join(found.select("file", "at", "same"), ["file", "at"]).select("file", "at", "record", "same"), "inside")
    wanted = where.select("same").distinct()
    parts = pieces(spark, path).select("same", "value").join(wanted, "same", "left_semi").dropDuplicates(["same"])
    parts = where.join(parts, "same")
    whole = parts.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))
    whole = whole.select("file", "record", F.concat_ws(MAGIC, F.transform("parts", lambda x: x["value"])).alias("value"))
    joined = parsed(whole).where("whole").select(*FIELDS, F.col("file").alias("warc_file"), F.col("record").alias("warc_offset"))
    return done.unionByName(joined)
