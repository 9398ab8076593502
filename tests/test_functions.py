import pytest
from pyspark.sql import functions as F

from basalt.functions import chunks, codecs, formats


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_hex_is_strict(spark):
    x = lambda s: codecs.hex_to_bytes(F.lit(s))
    assert one(spark, x("0xAb01"), x(""), x("abc"), x("zz"), x("0x0x00")) == (b"\xab\x01", b"", None, None, None)


def test_integers_round_trip(spark):
    for n in (0, 1, 255, 65536, 4294967295):
        be, back, le = one(spark, codecs.uint32_to_bytes(F.lit(n)), codecs.bytes_to_uint32(codecs.uint32_to_bytes(F.lit(n))), codecs.little_endian(F.lit(n), 4))
        assert (be, back, le) == (n.to_bytes(4, "big"), n, n.to_bytes(4, "little"))
    assert one(spark, codecs.uint32_to_bytes(F.lit(-1)), codecs.uint32_to_bytes(F.lit(4294967296)), codecs.bytes_to_uint32(F.lit(b"abc"))) == (None, None, 0)
    n = 2**63 + 5
    wide = F.lit(str(n)).cast("decimal(20,0)")
    assert one(spark, codecs.uint64_to_bytes(wide), codecs.bytes_to_uint64(codecs.uint64_to_bytes(wide)).cast("string")) == (n.to_bytes(8, "big"), str(n))
    for n in (0, 2**32 - 1, 2**32, 2**53 + 1, 2**62 - 1, 2**63 - 1):  # longs are exact, too
        assert one(spark, codecs.uint64_to_bytes(F.lit(n).cast("long"))) == (n.to_bytes(8, "big"),)
    assert one(spark, codecs.uint64_to_bytes(F.lit(str(2**64 - 1)).cast("decimal(20,0)"))) == ((2**64 - 1).to_bytes(8, "big"),)
    assert one(spark, codecs.from_little_endian(F.lit((7).to_bytes(8, "little"))), codecs.from_little_endian(F.lit(b"12"))) == (7, None)


def test_hashes(spark):
    h = "Ab" * 32
    assert one(spark, codecs.is_hash(F.lit(h)), codecs.is_hash(F.lit("0x" + h)), codecs.is_hash(F.lit(None).cast("string"))) == (True, False, False)
    assert one(spark, codecs.normal_hash(F.lit(f" 0x{h} ")), codecs.normal_hash(F.lit(h[1:]))) == (h.lower(), None)


def test_base64_has_no_line_breaks(spark):
    import base64

    raw = bytes(range(200))
    assert one(spark, codecs.base64_line(F.lit(raw))) == (base64.b64encode(raw).decode(),)


@pytest.mark.parametrize(("n", "text"), [(0, "0 B"), (1023, "1023 B"), (1024, "1.00 KB"), (1536, "1.50 KB"), (5 * 1024**3, "5.00 GB")])
def test_human_bytes(spark, n, text):
    assert one(spark, formats.human_bytes(F.lit(n).cast("long"))) == (text,)


@pytest.mark.parametrize(("ns", "text"), [(999, "999ns"), (1500, "1.500µs"), (2_345_678, "2.345ms"), (1_500_000_000, "1.500s"), (61_000_000_000, "1m1s"), (3_661_000_000_000, "1h1m1s")])
def test_durations(spark, ns, text):
    assert one(spark, formats.human_duration(F.lit(ns).cast("long"))) == (text,)


def test_other_formats(spark):
    assert one(spark, formats.short_duration(F.lit(59.96)), formats.short_duration(F.lit(61)), formats.short_duration(F.lit(3700))) == ("60.0s", "1m 1s", "1h 1m 40s")
    assert one(spark, formats.wrapped(F.lit("abcdef"), 4), formats.wrapped(F.lit("abc"), 4)) == ("abcd\nef\n", "abc")
    assert one(spark, formats.percent(F.lit(1), F.lit(0)), formats.reduction(F.lit(4), F.lit(1)), formats.overhead(F.lit(3), F.lit(2))) == (0.0, 75.0, 50.0)
    assert one(spark, formats.rate(F.lit(2500)), formats.with_commas(F.lit(-1234567)), formats.gigabytes(F.lit(1024**3))) == ("2.50K/s", "-1,234,567", 1.0)
    rates = [formats.rate_of(F.lit(n).cast("long"), F.lit(ns).cast("long")) for n, ns in ((5, 0), (3, 2_000_000_000), (5000, 10**9), (3_000_000, 5 * 10**8))]
    assert one(spark, formats.percent_text(F.lit(12.345), 1), formats.percent_text(F.lit(7)), *rates) == ("12.3%", "7.00%", "0/s", "1.50/s", "5.00K/s", "6.00M/s")


def test_chunks(spark):
    seq = [2, 10001, 10002, 20001, 4294967295]
    rows = [one(spark, chunks.chunk_of(F.lit(s)), chunks.local_index(F.lit(s)), chunks.is_aligned_start(F.lit(s)), chunks.is_aligned_end(F.lit(s))) for s in seq]
    assert rows == [((s - 2) // 10000, (s - 2) % 10000, (s - 2) % 10000 == 0, (s - 2) % 10000 == 9999) for s in seq]
    assert one(spark, chunks.chunk_path(F.lit(12345), "index"), chunks.valid_ledger(F.lit(1))) == ("chunks/0012/012345.index", False)
