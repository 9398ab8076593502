import pytest
from pyspark.sql import functions as F

from basalt.sources import chunkstore, ledgers, lists, rawfile


def lines(spark, *values):
    return spark.createDataFrame(list(enumerate(values, 1)), "line_no long, value string")


def test_hash_list(spark):
    h = "0A" * 32
    rows = lists.hash_list(lines(spark, h, f"  {h.lower()} ", "", "0x" + h, h[1:], "g" * 64)).collect()
    assert [r.tx_hash for r in rows] == [h.lower(), h.lower(), None, None, None]


def test_ledger_list(spark):
    good = lists.ledger_list(lines(spark, "2", "# no", "", " 4294967295 ")).collect()
    assert [(r.line_no, r.ledger_seq) for r in good] == [(1, 2), (4, 4294967295)]
    for bad in ("0", "1", "abc", "4294967296", "-5"):
        with pytest.raises(Exception, match="line 2"):
            lists.ledger_list(lines(spark, "2", bad)).collect()


def test_numbered_lines(spark, tmp_path):
    (tmp_path / "a").write_text("x\n\ny")
    assert [tuple(r) for r in lists.numbered_lines(spark, str(tmp_path / "a")).orderBy("line_no").collect()] == [(1, "x"), (2, ""), (3, "y")]


def test_chunk_index():
    assert chunkstore.decode_index(chunkstore.encode_index([3, 7])) == [0, 3, 7]
    wide = chunkstore.encode_index([1, 2**32])
    assert wide[1] == 8 and chunkstore.decode_index(wide) == [0, 1, 2**32]
    for bad in (b"", b"\x02\x04" + bytes(10), b"\x01\x03" + bytes(9), chunkstore.encode_index([1])[:-1]):
        with pytest.raises(ValueError):
            chunkstore.decode_index(bad)


def test_chunk_store(spark, tmp_path):
    rows = spark.range(2, 52).select(F.col("id").alias("ledger_seq"), F.encode(F.repeat(F.col("id").cast("string"), 5), "UTF-8").alias("payload"))
    path = f"file://{tmp_path}/c"
    chunkstore.write(rows.where("ledger_seq < 32"), path, 10)
    changed = rows.withColumn("payload", F.encode(F.lit("new"), "UTF-8"))
    chunkstore.write(changed, path, 10)  # chunks that are there stay
    got = {r.ledger_seq: bytes(r.payload) for r in chunkstore.decoded(spark.read.parquet(path), 10, 5, 44).collect()}
    assert sorted(got) == list(range(5, 45))
    assert got[5] == b"55555" and got[44] == b"new"
    parts = chunkstore.encoded(rows, 10).collect()
    for r in parts[1:]:
        (tmp_path / f"{r.chunk_id:06d}.data").write_bytes(r.data)
        (tmp_path / f"{r.chunk_id:06d}.index").write_bytes(r["index"])
    (tmp_path / f"{parts[0].chunk_id:06d}.data").write_bytes(parts[0].data)  # no index: incomplete
    assert chunkstore.decoded(chunkstore.read_files(spark, str(tmp_path)), 10).count() == 40


def test_raw_file(spark, tmp_path):
    rows = spark.createDataFrame([("ab" * 32, 7), ("ab" * 32, 7), ("cd" * 32, 4294967295)], "tx_hash string, ledger_seq long")
    content = rawfile.packed(rows).first().content
    (tmp_path / "r").write_bytes(content)
    got = sorted((r.tx_hash, r.ledger_seq) for r in rawfile.read(spark, str(tmp_path / "r")).collect())
    assert len(content) == 108 and got == sorted((r.tx_hash, r.ledger_seq) for r in rows.collect())
    for bad in (b"", content[:-1]):
        with pytest.raises(Exception, match="raw hash file"):
            rawfile.split(spark.createDataFrame([(bytearray(bad),)], "content binary")).collect()


def test_range_read_prunes_chunks(spark, tmp_path):
    rows = spark.range(2, 30002).select(F.col("id").alias("ledger_seq"))
    ledgers.write_ledgers(rows, str(tmp_path / "l"), 3)
    read = ledgers.read_range(spark.read.parquet(str(tmp_path / "l")), 10005, 10010)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert read.count() == 6 and "PartitionFilters: [isnotnull(chunk_id" in plan
    assert ledgers.missing(rows.where("ledger_seq % 3 = 0"), 2, 9).count() == 5


def test_chunk_files(spark, tmp_path):
    path = f"{tmp_path}/c"
    rows = spark.range(2, 2 + 45).select(F.col("id").alias("ledger_seq"), F.encode(F.repeat(F.col("id").cast("string"), 5), "UTF-8").alias("payload"))
    assert chunkstore.write_files(rows, path, 10)["chunks"] == 5
    assert sorted(x.name for x in (tmp_path / "c/chunks/0000").iterdir()) == sorted(f"{k:06d}.{e}" for k in range(5) for e in ("data", "index"))
    (tmp_path / "c/chunks/0000/000003.index").unlink()  # incomplete, so written anew
    assert chunkstore.write_files(rows, path, 10) == {"chunks": 1, "records": 10, "bytes": (tmp_path / "c/chunks/0000/000003.data").stat().st_size}
    assert chunkstore.write_files(rows, path, 10)["records"] == 0
    asked = spark.createDataFrame([(2,), (46,), (46,), (47,), (900,), (1,), (None,)], "ledger_seq long")
    got = [(r.ledger_seq, r.payload and bytes(r.payload)) for r in chunkstore.read_records(asked, path, 10).collect()]
    assert sorted(got, key=str) == sorted([(2, b"22222"), (46, b"4646464646"), (46, b"4646464646"), (47, None), (900, None), (1, None), (None, None)], key=str)
    assert {r.ledger_seq: bytes(r.payload) for r in chunkstore.decoded(chunkstore.read_files(spark, path), 10).collect()} == {r.ledger_seq: bytes(r.payload) for r in rows.collect()}
    for bad, says in ((rows.where("ledger_seq <> 5"), "ledger 5 is missing"), (rows.union(rows.where("ledger_seq = 7")), "ledger 8 is missing")):
        with pytest.raises(Exception, match=says):
            chunkstore.write_files(bad, f"{tmp_path}/bad-{says[7]}", 10)
    assert chunkstore.write_files(rows.where("false"), f"{tmp_path}/none", 10) == {"chunks": 0, "records": 0, "bytes": 0}


def test_raw_files(spark, tmp_path):
    rows = spark.range(5000).select(F.sha2(F.floor(F.col("id") / 2).cast("string"), 256).alias("tx_hash"), (F.col("id") * 800_000).alias("ledger_seq"))
    assert rawfile.write_files(rows, f"{tmp_path}/w", 700) == 5000
    sizes = [x.stat().st_size for x in (tmp_path / "w").iterdir()]
    assert len(sizes) == 8 and sum(sizes) == 180_000 and all(x % 36 == 0 for x in sizes)
    got = rawfile.read(spark, f"{tmp_path}/w", 300)
    assert sorted((r.tx_hash, r.ledger_seq) for r in got.collect()) == sorted((r.tx_hash, r.ledger_seq) for r in rows.collect())
    assert got.agg(F.max("rec_no")).first()[0] == max(sizes) // 36 - 1
    (tmp_path / "w/part-000001.raw.x.tmp").write_bytes(b"draft of a lost task")
    assert got.count() == rawfile.read(spark, f"{tmp_path}/w").count() == 5000
    (tmp_path / "w/part-000000.raw").write_bytes(b"")
    with pytest.raises(Exception, match="raw hash file of 0 bytes"):
        rawfile.read(spark, f"{tmp_path}/w").collect()
    with pytest.raises(Exception, match="without a hash"):
        rawfile.write_files(spark.createDataFrame([(None, 3)], "tx_hash string, ledger_seq long"), f"{tmp_path}/n")
