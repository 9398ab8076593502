"""Near-duplicates of texts and vectors, and components, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.llm import embeddings, minhash
from basalt.llm.components import components


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("links", [[], [(1, 1)], [(k, k + 1) for k in range(200)], [(500, k) for k in range(300)], [(7, 3), (3, 7), (9, 8), (3, 9), (20, 21)]])
def test_components(spark, links):
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    links = [x for x in links if x[0] != x[1]]
    expected = roots({n for x in links for n in x}, links)
    assert got == expected


def shingles(text, n):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[k : k + n]) for k in range(max(1, len(ws) - n + 1))} if ws else set()


def expected_groups(rows, n):
    sets = [shingles(t, n) for _, t in rows]
    links = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    return roots({k for k, _ in rows}, links), {k: len(s) for (k, _), s in zip(rows, sets, strict=True)}


@pytest.mark.parametrize(("n", "block"), [(2, 128), (5, 128), (2, 4)])
def test_near_duplicates_equal_brute_force(spark, n, block):
    random.seed(n)
    word = lambda: "".join(random.choices("abcdefg", k=4))
    rows, k = [], 0
    for _ in range(12):  # groups of copies with more and more changes, so that links chain
        base = [word() for _ in range(60)]
        for _ in range(random.randint(1, 14)):
            base = list(base)
            for _ in range(random.randint(0, 3)):
                base[random.randrange(60)] = word()
            rows.append((k, (" " if k % 3 else "\t").join(base).upper() if k % 2 else " ".join(base)))
            k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, "  \n"), (k + 3, "one"), (k + 4, "ONE"), (k + 5, "one two"), (k + 6, "One\x0btwo"), (k + 7, "x y " * 40000), (k + 8, "é É"), (k + 9, "É é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit("r")).withColumn("key", F.lit(1))
    got = minhash.near_duplicates(docs, minhash.Params(words=n, block=block)).collect()
    groups, sizes = expected_groups(rows, n)
    assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in got} == {d: (groups[d], sizes[d], groups[d] == d) for d, _ in rows}


def test_near_duplicates_of_odd_tables(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(3, "a b c"), (3, "a b c"), (5, "a b c"), (None, "a b c"), (None, None), (8, None)], "doc_id long, text string")
    got = minhash.near_duplicates(rows).collect()
    assert len(got) == 6 and {(r.doc_id, r.component_id) for r in got} == {(3, 3), (5, 3), (None, 3), (None, None), (8, 8)}


@pytest.mark.parametrize("kind", ["int", "smallint", "string"])
def test_ids_of_other_types(spark, kind):
    rows = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x")], "doc_id int, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    assert sorted((int(r.doc_id), int(r.component_id)) for r in minhash.near_duplicates(rows).collect()) == [(1, 1), (2, 1), (3, 3)]


@pytest.mark.parametrize("crowd", [2, 4, 16])
def test_crowded_keys_lose_no_link(spark, crowd):
    """A family whose members share most keys, with chains of links at and below the threshold."""
    random.seed(crowd)
    word = lambda: "".join(random.choices("abcdefg", k=5))
    base, rows = [word() for _ in range(80)], []
    for k in range(60):
        own = list(base)
        for _ in range(random.randint(2, 9)):
            own[random.randrange(80)] = word()
        rows.append((k, " ".join(own)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash.Params(words=2, crowd=crowd)).collect()
    groups, _ = expected_groups(rows, 2)
    assert 1 < len(set(groups.values())) < 60 and {r.doc_id: r.component_id for r in got} == groups


def test_a_large_family_costs_rows_in_proportion(spark):
    """Near copies share nearly all keys. Once ties to a few of them connect a crowded key's documents, it is not refined."""
    rng, inner, made = random.Random(7), minhash.staged, {}
    base = [f"b{k}" for k in range(200)]
    texts = []
    for k in range(600):
        own = list(base)
        own[rng.randrange(200)] = f"x{k}"
        texts.append((k, " ".join(own)))
    rows = texts + [(600 + k, " ".join(rng.choice(base) for _ in range(40))) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def counted(df, name="stage", **options):
        out = inner(df, name, **options)
        made[name] = made.get(name, 0) + out.count()
        return out

    try:
        minhash.staged = counted
        got = minhash.near_duplicates(docs, minhash.Params(words=2)).collect()
    finally:
        minhash.staged = inner
    groups, _ = expected_groups(rows, 2)
    assert {r.doc_id: r.component_id for r in got} == groups and len(set(groups.values())) == 101
    assert made["finer"] == 0 and made["pairs"] < 121 * 16 * 700 // 8


def test_fifty_thousand_loosely_similar_documents(spark):
    """All share a third of their words: no giant cluster arises, rows stay in proportion, and the few true links are found."""
    n, rng = 50_000, np.random.default_rng(6)
    base = [f"b{k}" for k in range(14)]
    text = lambda k: " ".join([*base, *[f"w{x}" for x in np.random.default_rng(k).integers(0, 10**6, 26)]])
    copies = {n + k: int(x) for k, x in enumerate(rng.choice(n, 40, replace=False))}
    rows = [(k, text(k)) for k in range(n)] + [(k, text(x) + " more") for k, x in copies.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    p, seen, inner = minhash.Params(words=2), [], minhash.ties

    def watched(classes, p):
        out = minhash.staged(inner(classes, p))
        seen.append((out.count(), components(out).groupBy("component").count().agg(F.max("count")).first()[0]))
        return out

    try:
        minhash.ties = watched
        got = minhash.near_duplicates(docs, p).collect()
    finally:
        minhash.ties = inner
    assert {r.doc_id: r.component_id for r in got if r.doc_id != r.component_id} == copies
    assert seen[0][0] < n and seen[0][1] < n // 10


def test_pairs_at_the_threshold_share_a_key():
    """Recall of the banding alone: pairs with a similarity of just 0.8."""
    p, rng = minhash.Params(words=2), np.random.default_rng(5)
    f, missed = minhash.factors(p), 0
    for _ in range(300):
        s = rng.integers(0, 2**64, 120, dtype=np.uint64)
        a, b = minhash.minhashes(s[:108], f), minhash.minhashes(s[12:], f)  # 96 of 120
        same = (a == b).reshape(-1, p.half).all(1)
        missed += not (same[: p.sketches].any() and same[p.sketches :].any())
        assert np.count_nonzero(a == b) >= p.gate * p.hashes
    assert missed == 0


def brute_links(rows, cosine=0.95):
    ok = [(k, np.array(v, float)) for k, v in rows if v is not None and None not in v and len(v) and np.isfinite(np.array(v, float)).all() and np.any(v)]
    n, links = dict.fromkeys((k for k, _ in rows), 0), []
    for i, (a, x) in enumerate(ok):
        for b, y in ok[:i]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links.append((a, b))
                n[a] += 1
                n[b] += 1
    return n, roots(n, links)


@pytest.mark.parametrize("p", [embeddings.Params(), embeddings.Params(per_cell=20, row_block=7, column_block=11), embeddings.Params(per_cell=20, reach=None), embeddings.Params(per_cell=4, few_cells=0)])
def test_vectors_equal_brute_force(spark, p):
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(40):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 9)):
            base = base + rng.normal(size=16) * 0.12
            rows.append((len(rows), [float(x) for x in base.astype(np.float32)]))
    rows += [(len(rows) + k, list(rows[3][1])) for k in range(5)]
    last = len(rows)
    rows += [(last, None), (last + 1, []), (last + 2, [0.0] * 16), (last + 3, [float("nan")] * 16), (last + 4, [1.0, None] * 8), (last + 5, [float("inf")] + [0.0] * 15), (last + 6, [2 * x for x in rows[3][1]]), (last + 7, [1.0, 2.0]), (last + 8, [2.0, 4.0]), (last + 9, [1e30] * 16), (last + 10, [1e-30] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(0)).withColumn("rep", F.lit(0)).withColumn("cell", F.lit("x"))
    got = embeddings.near_duplicates(df, p).collect()
    n, groups = brute_links(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {k: (n[k], groups[k], groups[k] == k) for k, _ in rows}
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_recall_of_links_between_many_cells(spark):
    """Near copies in random directions among vectors without clusters: nearly all links are found, and from both ends."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(12_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    step = rng.normal(size=(3000, 64))
    step -= (step * x[:3000]).sum(1)[:, None] * x[:3000]
    y = x[:3000] + np.tan(np.arccos(0.9502)) * step / np.linalg.norm(step, axis=1)[:, None]  # just within the threshold
    every = np.concatenate([x, y]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(every)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
    found = [got[k] for k in range(3000)]
    assert np.mean(np.array(found) >= 1) >= 0.999 and all(got[12_000 + k] == got[k] for k in range(3000))
