"""Packing, decontamination, WARC, URL filter, licenses and the pipeline."""

import glob
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from basalt.llm import decontamination, licenses, packing, queries, urlfilter, warc

PACK = packing.Params(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def held_to_tokenizer(rows, got):
    t = Tokenizer.from_file(PACK.tokenizer)
    places, total = defaultdict(list), 0
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        places[r.sequence_id].append((r["offset"], r.length))
    for key, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by_doc[key], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        at = 0
        for k, r in enumerate(own):
            assert r.start == at and (r.length == 1024 or k == 0) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        total += len(ids)
    for own in places.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 1024
    return len(places), total


def test_packing_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("length", F.lit("x")).withColumn("bucket", F.lit(1))
    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "日本語 текст \U0001f600 <|endoftext|>"), (10**6 + 3, "a b " * 6000), (10**6 + 4, "\x85\u2028\x1c x\u00a0y")]
    every = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True)
    n, total = held_to_tokenizer([(r.doc_id, r.text) for r in every.collect()], packing.pack(every, PACK).collect())
    assert n <= -(-total // 1024) * 1.02 + 1
    assert packing.pack(docs.where("false"), PACK).count() == 0
    twice = docs.limit(1).union(docs.limit(1))
    assert packing.pack(twice, PACK).count() == 2 * packing.pack(docs.limit(1), PACK).count()


def test_ids_are_those_of_the_tokenizer_file():
    """Random strings, with all characters for which the rank table stands in, and literal special tokens."""
    rng = random.Random(5)
    plain = [chr(c) for c in range(0x2FF) if packing.PLAIN.fullmatch(chr(c))] + list("\u2010\u2019\u2026\u20ac")
    bits = ["'s", "'ll", "  ", "\n\n", "<|", "|>", "<|endoftext|>", "\u00e9", "12", "don't", "\t x", "\u65e5\u672c", "\U0001f600", "\x85", "\u2028"]
    t, encode = Tokenizer.from_file(PACK.tokenizer), packing.Encoder(PACK)
    for _ in range(4000):
        text = "".join(rng.choice(bits) if rng.random() < 0.2 else rng.choice(plain) for _ in range(rng.randint(0, 60)))
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
    assert encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


def test_bins_are_full_and_whole():
    rng = np.random.default_rng(4)
    for n in (0, 1, 7, 3000):
        sizes = rng.integers(1, 101, n)
        slots, bins = packing.plan(np.bincount(sizes, minlength=101), 100)
        assert bins >= -(-sizes.sum() // 100) and bins <= -(-sizes.sum() // 100) * 1.02 + 1
    # 60 leaves 40; 35 fits greedily; 20 + 20 fit more tightly
    left = np.zeros(101, np.int64)
    left[[60, 35]] = 1
    left[20] = 2
    assert packing.one_bin(left, 100) == [60, 20, 20]


def brute_hits(docs, items, window):
    where, sizes = defaultdict(set), set()
    for key, text in items:
        ws = decontamination.words(text)
        size = min(window, len(ws))
        for k in range(len(ws) - size + 1 if ws else 0):
            where[tuple(ws[k : k + size])].add(str(key))
            sizes.add(size)
    out = []
    for key, text in docs:
        ws, hit, found = decontamination.words(text), set(), set()
        for size in sizes:
            for k in range(len(ws) - size + 1):
                if own := where.get(tuple(ws[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= own
        out.append((key, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out, key=str)


@pytest.mark.parametrize("p", [decontamination.Params(), decontamination.Params(window=3, block_words=40), decontamination.Params(window=4, segment_bytes=90, slice_rows=5, cache_words=3)])
def test_decontamination_equals_brute_force(spark, sf_dir, p):
    random.seed(1)
    items = [(k, " ".join(random.choices("ab cd ef Gh é9 x,y".split(), k=random.choice([0, 1, 2, 5, 13, 14, 20])))) for k in range(40)] + [(40, None), (41, "same same same same"), (42, "same same same same")]
    pick = lambda: random.choice(items)[1] or ""
    docs = [(k, " ".join(random.choice([pick(), "zz", pick()[5:], "q r", "SAME same"]) for _ in range(random.randint(0, 9)))) for k in range(80)] + [(200, None), (201, ""), (202, "same " * 30000), (202, "same " * 30000), (None, "same same same same")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("x")).withColumn("spans", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in decontamination.decontaminate(frame, bench, p).collect()), key=str) == brute_hits(docs, items, p.window)
    assert decontamination.decontaminate(frame.where("false"), bench, p).count() == 0
    assert {r.n_hit for r in decontamination.decontaminate(frame, bench.where("false"), p).collect()} == {0}


def test_decontamination_of_the_corpus(spark, sf_dir):
    got = queries.op9_decontaminate(spark, sf_dir).collect()
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert sorted((tuple(r) for r in got), key=str) == brute_hits(docs, items, 13)


def test_index_is_written_in_bounded_pieces(spark, monkeypatch):
    """Segments are long rows: no row group, and so no buffer of a writer or reader, holds a hundred of them."""
    rng, inner, made = random.Random(8), decontamination.staged, []
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(decontamination, "staged", lambda *args, **options: made.append(inner(*args, **options)) or made[-1])
    bench = spark.createDataFrame([("q", " ".join(texts[7].split()[100:113]))], "item_id string, text string")
    assert [(r.doc_id, r.n_words) for r in decontamination.decontaminate(docs, bench).where("n_hit = 13").collect()] == [(7, 60_000)]
    files = [pq.ParquetFile(f) for f in glob.glob(f"{made[0]._staged_at.removeprefix('file://')}/*.parquet")]
    groups = [f.metadata.row_group(k) for f in files for k in range(f.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 60 and max(g.total_byte_size for g in groups) < 16 << 20


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "c b a"), (2, "a x b y c"), (3, "a b x y z c"), (4, None)], "doc_id long, text string")
    got = decontamination.proximity(docs, spark.createDataFrame([(7, "a b c")], "item_id long, text string"), decontamination.Params(window=3), slop=2)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "7", 0, 3), (2, "7", 0, 5)]


@pytest.mark.parametrize("p", [decontamination.Params(window=3), decontamination.Params(window=3, segment_bytes=40, slice_rows=3, block_words=6)])
def test_proximity_equals_brute_force(spark, p):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choices("a b c d e f".split(), k=n))
    docs, items = [(k, text(rng.randint(0, 25))) for k in range(40)], [(k, text(rng.randint(1, 5))) for k in range(8)]
    expected = set()
    for d, t in docs:
        ws = t.split()
        for k, own in items:
            own = own.split()
            n = min(3, len(own))
            for s in range(len(own) - n + 1):
                need = sorted(own[s : s + n])
                holds = lambda a, e: not list((Counter(need) - Counter(ws[a:e])).elements())  # noqa: B023, E731
                expected |= {(d, str(k), a, e) for a in range(len(ws)) for e in range(a + 1, min(len(ws), a + n + 2) + 1) if holds(a, e) and not holds(a + 1, e) and not holds(a, e - 1)}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontamination.proximity(frame, spark.createDataFrame(items, "item_id long, text string"), p, slop=2)
    assert {tuple(r) for r in got.collect()} == expected


def test_one_index_serves_two_benchmarks(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x y z"), (3, None)], "doc_id long, text string")
    p = decontamination.Params(window=2)
    segments = decontamination.staged(decontamination.index(docs, ["doc_id"], p))
    for item, ids in (("b c", {1}), ("y z", {2}), ("z x", set())):
        bench = spark.createDataFrame([(5, item)], "item_id long, text string")
        got = decontamination.decontaminate(docs.where("false"), bench, p, segments=segments).collect()
        assert len(got) == 3 and {r.doc_id for r in got if r.contaminated} == ids


@pytest.mark.parametrize("block", ["128m", "3k"])
def test_warc_round_trip(spark, block):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    rows = [(1, "http://a/\r\nX: y", "x" * 150), (2, "http://b/", "x" * 150), (3, None, None), (4, "", "short"), (5, "", "short"), (6, "u", "\r\n\r\n" + fake * 20 + "tail"), (7, "u", "\r\n\r\n" + fake * 20 + "tail"), (8, "u", "WARC/1.1\r\n"), (9, "u", "é" * 60), (0, "u", "é" * 60), (10, "u", "WARC/1.1\r\nContent-Length: 99999\r\n\r\n")]
    rows += [(100 + k, "u", fake * k + str(k) * 400) for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit("x"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        got = warc.read(spark, warc.write(pages.repartition(2))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    first = {}
    for key, _, html in sorted(rows):
        first.setdefault(html or "", key)
    expected = set()
    for key, _, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= 100 and first[html or ""] != key
        expected.add((str(key), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", str(first[html or ""]) if again else None))
    assert len(got) == len(rows) and {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == expected
    assert next(r.uri for r in got if r.page_id == "1") == "http://a/%0D%0AX: y"


def test_warc_does_not_depend_on_blocks(spark):
    """Files are cut into other blocks for the second pass, as when executors come and go."""
    fake = "WARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    rows = [(k, "u", fake * (k % 7) + f"{k} " * (k % 50) + "WARC/1." * (k % 3)) for k in range(600)]
    path = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2))
    inner = warc.entries

    def moved(found):
        out = warc.staged(inner(found))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
        return out

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        warc.entries = moved
        got = warc.read(spark, path).collect()
    finally:
        warc.entries = inner
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    digest = {k: hashlib.sha256(t.encode()).hexdigest() for k, _, t in rows}
    assert len(got) == len(rows) and all(r.payload_digest == digest[int(r.page_id)] for r in got)


def test_warc_of_other_archives(spark, tmp_path):
    """Version 1.0, other record types, and blocks that are no HTTP message."""
    record = lambda version, kind, content, block: f"WARC/{version}\r\nWARC-Type: {kind}\r\nContent-Type: {content}\r\nContent-Length: {len(block)}\r\n\r\n{block}\r\n\r\n"
    http = "HTTP/1.1 200 OK\r\n\r\nhi WARC/1.1"
    (tmp_path / "a.warc").write_text(record("1.0", "warcinfo", "application/warc-fields", "a: 1\r\n\r\n") + record("1.0", "response", "application/http; msgtype=response", http) + record("1.1", "response", "application/http", http), newline="")
    got = sorted((r.record_type, r.payload_bytes, r.payload_digest) for r in warc.read(spark, str(tmp_path)).collect())
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert got == [("response", 11, sha(b"hi WARC/1.1")), ("response", 11, sha(b"hi WARC/1.1")), ("warcinfo", 8, sha(b"a: 1\r\n\r\n"))]


def test_warc_of_odd_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(spark, warc.write(empty)).count() == 0
    nulls = spark.createDataFrame([(None, "u", "y" * 200), (None, "u", "y" * 200), (4, "u", "y" * 200)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read(spark, warc.write(nulls)).collect()) == [("4", "response", None), ("null", "revisit", "4"), ("null", "revisit", "4")]


def test_broken_archive_gives_records_up_to_the_break(spark, tmp_path):
    good = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 21\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhi\r\n\r\n"
    (tmp_path / "a.warc").write_text(good + good.replace(": 21", ": 22") + good, newline="")
    assert warc.read(spark, str(tmp_path)).count() == 1


def test_license_texts(spark):
    noisy = [(k, "The Licence\n\nCopyright (c) 2020-2024 Some Body\n" + t.replace("license", "licence").upper()) for k, (n, t) in enumerate(sorted(licenses.KNOWN.items())) if "unlicense" not in t.lower()]
    rows = [*noisy, (100, None), (101, ""), (102, "..."), (103, noisy[0][1]), (104, noisy[0][1] + " and more"), (105, "w " * 200000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("license", F.lit("x")).withColumn("form", F.lit(1))
    got = {r.doc_id: (r.license, r.n_words) for r in licenses.scan(docs).collect()}
    names = sorted(licenses.KNOWN)
    assert all(got[k][0] == names[k] for k, _ in noisy)
    assert got[103][0] == got[noisy[0][0]][0] and {got[k][0] for k in (100, 101, 102, 104, 105)} == {None} and got[105][1] == 200000
    assert licenses.scan(docs.where("false")).count() == 0
    own = spark.createDataFrame([("b", "Do as you like."), ("a", "do, as you LIKE"), ("c", None)], "license string, text string")
    assert licenses.scan(spark.createDataFrame([(1, "Do as\nyou like!")], "doc_id long, text string"), own).first().license == "a"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, same):
    same(queries.QUERIES[name], queries.SQL[name])


def test_urls_equal_sql_on_a_graph(spark):
    from rows import comparable

    random.seed(3)
    hosts = [f"h{k}.example.{'org' if k % 2 else 'com' if k % 3 else 'net'}" for k in range(40)] + ["x.net"]
    rows = [(k, f"http://{random.choice(hosts)}/{random.choice(['fr', 'de', 'es', 'en'])}/{random.randint(1, 30)}?q#a", " ".join(f"<a HREF='https://{random.choice(hosts)}/x'>" for _ in range(random.randint(0, 5)))) for k in range(400)]
    rows += [(900, None, None), (901, "nourl", "<a href=http://a/>"), (902, "x://", "x"), (903, "HTTP://ExAmple.ORG/es/1", None), (904, "a\nb://example.org?x/es/", ""), (904, "http://u@notexample.org:80", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("rank", F.lit("x")).withColumn("kind", F.lit(0))
    p = urlfilter.Params(tolerance=1e-2)
    got = urlfilter.filter_urls(df, p)
    assert {"allow", "block"} == {r.verdict for r in got.where("rule is null").collect()}
    c = duckdb.connect()
    c.register("pages", df.toPandas())
    e = c.execute(urlfilter.sql(p, 40, ranks=True))
    order = [x[0] for x in e.description]
    mine, theirs = (sorted(map(tuple, rows), key=lambda r: str(r[:4])) for rows in (got.select(*order).collect(), e.fetchall()))
    for r, x in zip(mine, theirs, strict=True):
        assert r[:4] == x[:4] and r[5:] == pytest.approx(x[5:], rel=0.1, abs=1e-3)
        assert r[4] == x[4] or abs(x[6] - x[5]) < 0.1 * x[5] + 1e-3
    at = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.where("page_id between 900 and 903").collect()}
    assert at[900] == at[901] == ("", "", None, "allow") and at[903] == ("example.org", "/es/1", "example.org/es/", "block")
    assert urlfilter.filter_urls(df.where("false")).count() == 0


def test_ranks_of_a_graph_by_hand(spark):
    """Expected values from a dense linear system: hosts without links hand their rank back to the seeds."""
    links = {"a.org": ["x.net", "y.net"], "x.net": ["y.net"], "y.net": [], "z.net": ["b.example.org"], "w.net": ["z.net", "y.net"], "b.example.org": []}
    rows = [(1, "http://a.org/p"), (2, "http://x.net/p"), (3, "http://y.net/p"), (4, "http://z.net/p"), (5, "http://w.net/p"), (6, "http://b.example.org/es/p")]
    pages = [(k, u, " ".join(f"<a href='//{h}/q'>" if k % 2 else f'<a href="https://{h}/q">' for h in links[u.split("/")[2]])) for k, u in rows]
    df = spark.createDataFrame([*pages, (7, "http://lone.net/", "<a href='/own'>")], "page_id long, url string, html string").withColumn("trust", F.lit("x"))
    got = {r.host: r for r in urlfilter.filter_urls(df, urlfilter.Params(tolerance=1e-6)).collect()}
    names = sorted(links)
    m = np.array([[links[b].count(a) / max(1, len(links[b])) for b in names] for a in names])
    back = np.array([[links[a].count(b) for b in names] for a in names], float)
    back /= np.maximum(back.sum(0), 1)
    for matrix, seed, column in ((m, "a.org", "trust"), (back, "b.example.org", "distrust")):
        s = np.array([float(n == seed) for n in names])
        full = matrix + np.outer(s, matrix.sum(0) == 0)
        rank = np.linalg.solve(np.eye(len(names)) - 0.85 * full, 0.15 * s)
        assert [got[n][column] for n in names] == pytest.approx(rank.tolist(), abs=1e-5)
    assert {h: got[h].verdict for h in names} == {"a.org": "allow", "x.net": "allow", "y.net": "allow", "z.net": "block", "w.net": "block", "b.example.org": "block"}
    assert got["lone.net"].verdict == "allow"
    # ten times the seeds elsewhere of the same shares change nothing
    many = df.unionByName(df.where("page_id in (1, 6)").crossJoin(spark.range(9)).drop("id"))
    again = {r.host: (r.trust, r.distrust) for r in urlfilter.filter_urls(many, urlfilter.Params(tolerance=1e-6)).collect()}
    assert all(again[h] == pytest.approx((got[h].trust, got[h].distrust), abs=1e-5) for h in got)


def test_license_forms_of_all_scripts(spark):
    """Expected values worked out without the module's expressions."""
    from pathlib import Path

    mit = licenses.KNOWN["MIT"]
    rows = [(1, mit + " \u041e\u0434\u043d\u043e \u0434\u0440\u0443\u0433\u043e\u0435."), (2, "\u65e5\u672c\u8a9e, \u30c6\u30ad\u30b9\u30c8!"), (3, "Copyright Some Body 2020\n" + mit), (4, "Copyright [yyyy] [name]\n" + mit), (5, "The copyright holders.\nOf 12 words"), (6, "Ver 2 redistributable")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].license for k in range(1, 7)] == [None, None, "MIT", "MIT", None, None]
    form = {2: "\u65e5\u672c\u8a9e \u30c6\u30ad\u30b9\u30c8", 5: "the copyright holders of 12 words", 6: "ver 2 redistributable"}
    assert all((got[k].n_words, got[k].digest) == (len(v.split()), hashlib.sha256(v.encode()).hexdigest()) for k, v in form.items())
    assert got[1].n_words == got[3].n_words + 2
    files = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}
    whole = [(k, Path("/usr/share/common-licenses", f)) for k, f in files.items()]
    whole = [(k, f.read_text()) for k, f in whole if f.is_file()]
    if whole:
        found = licenses.scan(spark.createDataFrame([(k, "\n".join(" * " + x for x in t.upper().split("\n"))) for k, t in whole], "doc_id string, text string")).collect()
        assert {r.doc_id: r.license for r in found} == {k: k for k, _ in whole}


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.staged(stage(spark, kept, sf_dir), name)
        assert after.columns == columns and 0 < after.count() <= kept.count() and after.join(kept, "doc_id", "left_anti").isEmpty()
        if name == "near_dedup":
            from test_duplicates import expected_groups

            groups, _ = expected_groups([(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()], 2)
            assert {r.doc_id for r in after.collect()} == set(groups.values())
        if name == "decontamination":
            rows, items = ([tuple(r) for r in t.collect()] for t in (kept.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")))
            assert {r.doc_id for r in after.collect()} == {r[0] for r in brute_hits(rows, items, 13) if not r[5]}
        kept = after
    got = corpus_pipeline.run(spark, sf_dir).collect()
    held_to_tokenizer([(r.doc_id, r.text) for r in kept.collect()], got)


def test_stages_take_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    item = max((r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()), key=len)
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "same words here", "en", "s", 1), (10**6 + 2, "same words here", "en", "s", 1), (None, "w x", None, None, None), (10**6 + 3, "one text", "en", "s", 1), (10**6 + 3, "another text of it", "en", "s", 1), (None, item, None, None, None)], docs.schema)
    every = docs.unionByName(odd).withColumn("score", F.lit(1)).withColumn("kept", F.lit("k")).withColumn("count", F.lit(2))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, every, sf_dir)
        assert name == "packing" or out.columns == every.columns
        assert stage(spark, every.where("false"), sf_dir).count() == 0
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in every.collect()}
    once = corpus_pipeline.drop_near_duplicates(spark, every, sf_dir)
    assert once.where("doc_id = 1000002").count() == 1 and once.where("doc_id is null").count() == 2 and once.where("doc_id = 1000003").count() == 2
    clean = corpus_pipeline.drop_contaminated(spark, every, sf_dir)
    assert [r.text for r in clean.where("doc_id is null").collect()] == ["w x"] and clean.where("doc_id = 1000002").count() == 2
