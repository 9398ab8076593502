"""MinHash near-duplicate detection with tensored banding.

A document is the set of its word shingles (64-bit hashes). Two collections of ``sketches``
short sketches are drawn, each sketch of ``half`` minhashes; a table key combines one sketch of
the first collection with one of the second, so ``sketches ** 2`` tables cost only
``2 * sketches * half`` minhashes. Documents with a common key are candidates.

1. Documents with equal sets are one class; its smallest doc_id stands for it.
2. Keys are counted with partial aggregates. The documents of a key of at most ``crowd`` are paired, and a
   pair is tied only if its minhashes agree well enough. A document of more crowded keys is held to
   the smallest ``hubs`` of the documents that come first in them, and tied to those with which it agrees. A
   crowded key whose documents these ties connect is settled, as step 4 compares all of a cluster: a
   large family of near copies costs ``hubs`` ties a document. Other crowded keys are refined by a third
   sketch, the next ``further`` of either side in turn, and dealt with alike; a document that similar
   shares about as many refined keys as keys. The documents of refined keys that are still crowded agree
   in nine minhashes; they are tied to the key's smallest one.
3. Components of the ties are clusters.
4. Clusters are compared on full sets, in blocks: documents of a cluster are dealt to blocks, bounded in
   rows and bytes, and each pair of blocks is one group. Pairs already connected, and pairs whose sizes
   or minhashes rule the similarity out, need no comparison; a group reports a spanning forest of its links.
5. Components of the links, spread to all members of each class, are the result.

With the defaults a pair at the threshold of 0.8 shares a key with probability above 0.999.

Defined results: null and empty texts, and texts without words, have no shingles and link with
nothing. Texts of fewer words than a shingle are one shingle. Long texts count whole. Equal rows (ties)
and rows of one doc_id share a component. An empty table gives an empty result. Rows with a null doc_id
are judged like others but never stand for a class unless the class has no other row. Ids are integers
or strings. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import discard, in_small_batches, staged, text_buffer
from .components import components


@dataclass(frozen=True)
class Params:
    words: int = 5
    percent: int = 80
    sketches: int = 11
    half: int = 3
    gate: float = 0.55  # share of equal minhashes below which a pair is ruled out; five deviations below 0.8
    crowd: int = 16  # documents of a key that are paired with one another
    further: int = 3
    hubs: int = 3  # documents to which each one of crowded keys is held
    block: int = 128
    most_blocks: int = 32  # of a cluster, while blocks stay below largest_block
    largest_block: int = 4096
    block_bytes: int = 32 << 20  # of a block's sets, about
    key_rows: int = 5000  # documents whose keys are drawn up in one task
    broadcast_rows: int = 300_000
    cache_words: int = 100_000

    @property
    def hashes(self) -> int:
        return 2 * self.sketches * self.half


class Shingles:
    """Sorted 64-bit hashes of a text's distinct word shingles."""

    def __init__(self, p: Params):
        import xxhash

        self.p, self.digest, self.known = p, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        ws = (text or "").encode().lower().split()  # bytes: A-Z only; ASCII white space
        if len(self.known) > self.p.cache_words:
            self.known.clear()
        known, digest = self.known, self.digest
        for w in set(ws).difference(known):
            known[w] = digest(w)
        h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
        if not len(h):
            return h
        n = min(self.p.words, len(h))
        with np.errstate(over="ignore"):
            x = np.full(len(h) - n + 1, n, np.uint64)
            for k in range(n):
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(x)])
        return np.unique(x)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def minhashes(s: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least product of the set with each odd factor, modulo 2**64."""
    with np.errstate(over="ignore"):
        out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
        for a in range(0, len(s), 2048):
            np.minimum(out, (s[None, a : a + 2048] * factors[:, None]).min(1), out=out)
    return out


def factors(p: Params) -> np.ndarray:
    return np.random.default_rng(11).integers(1 << 62, 1 << 63, p.hashes, dtype=np.uint64) | np.uint64(1)


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, n_shingles, set_id (digest of the set), sig (two bytes for each minhash), left and right (the two collections)."""

    def run(batches):
        sets, f = Shingles(p), factors(p)
        for b in batches:
            n, ident, sig, left, right = [], [], [], [], []
            for x in b.column("text"):
                s = sets(x.as_py())
                n.append(len(s))
                if not len(s):
                    for c in (ident, sig, left, right):
                        c.append(None)
                    continue
                m = minhashes(s, f)
                ident.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(mix(m).astype("<u2").tobytes())
                with np.errstate(over="ignore"):
                    folded = np.zeros(2 * p.sketches, np.uint64)
                    for k in range(p.half):
                        folded = mix(folded * np.uint64(0x9E3779B97F4A7C15) + m[k :: p.half])
                left.append(folded[: p.sketches].view(np.int64))
                right.append(folded[p.sketches :].view(np.int64))
            kinds = (("n_shingles", n, pa.int64()), ("set_id", ident, pa.binary()), ("sig", sig, pa.binary()), ("left", left, pa.list_(pa.int64())), ("right", right, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(v, t) for _, v, t in kinds]], ["doc_id", *[c for c, _, _ in kinds]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, set_id binary, sig binary, left array<long>, right array<long>")


def paired(keys: DataFrame, p: Params, name: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of the documents of each key of at most ``crowd``, and the rows (with first: the key's smallest) of more crowded ones.

    ``keys``: rep, key and further columns."""
    counted = keys.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("n"))
    repeated = staged(counted.where("first <> last"), name)
    two = repeated.where("n = 2").select(F.col("first").alias("a"), F.col("last").alias("b"))
    members = staged(keys.join(repeated.where("n > 2").select("key", "first", "n"), "key"), name)
    lists = members.where(F.col("n") <= p.crowd).groupBy("key").agg(F.array_sort(F.collect_set("rep")).alias("reps"))  # at most crowd of them
    pairs = lists.select(F.explode(F.expr("flatten(transform(reps, (x, i) -> transform(slice(reps, i + 2, size(reps)), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
    return two.unionByName(pairs), members.where(F.col("n") > p.crowd)


def ties(classes: DataFrame, p: Params) -> DataFrame:
    """(a, b): documents that share a table key and whose minhashes agree, and those of crowded keys."""
    spread = classes.select("rep", "left", "right").repartition(max(1, -(-classes.count() // p.key_rows)), "rep")
    one = spread.select("rep", F.posexplode("left").alias("i", "x"), "right")
    keys = one.select("rep", "i", "x", F.posexplode("right").alias("j", "y")).select("rep", "i", "j", F.xxhash64("i", "x", "j", "y").alias("key"))
    pairs, crowded = paired(keys, p, "keys")
    sig_a, sig_b = classes.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), classes.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))
    kind = classes.schema["rep"].dataType.simpleString()

    def alike(batches):
        for b in batches:
            left, right = (text_buffer(b.column(c))[0].view("<u2").reshape(-1, p.hashes) for c in ("sa", "sb"))
            yield b.select(["a", "b"]).filter(pa.array((left == right).sum(1) >= p.gate * p.hashes))

    agreeing = lambda some: some.join(sig_a, "a").join(sig_b, "b").mapInArrow(alike, f"a {kind}, b {kind}")
    # a row for each document of crowded keys, of which it has sketches ** 2 at most
    held = staged(crowded.groupBy("rep").agg(F.slice(F.array_sort(F.collect_set("first")), 1, p.hubs).alias("hubs"), F.collect_list(F.struct("key", "i", "j")).alias("keys")), "crowded")
    hubs = staged(agreeing(held.select(F.explode("hubs").alias("a"), F.col("rep").alias("b")).where("a <> b")), "hubs")
    settled = held.join(components(hubs).withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("cluster"), F.explode("keys").alias("k")).select("rep", "cluster", "k.*")
    mixed = staged(settled.groupBy("key").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low <> high").select("key"), "mixed")
    more = settled.join(mixed, "key").groupBy("rep").agg(F.collect_list(F.struct("key", "i", "j")).alias("keys"))
    more = staged(more.join(classes.select("rep", "left", "right"), "rep"), "refined")
    after = lambda side, at: F.transform(F.array(*[F.pmod(at + d, F.lit(p.sketches)) for d in range(1, p.further + 1)]), lambda k: F.struct(F.lit(side).alias("side"), k.alias("k"), F.element_at(side, k + 1).alias("x")))
    further = lambda c: F.transform(F.concat(after("left", c["i"]), after("right", c["j"])), lambda s: F.xxhash64(c["key"], s["side"], s["k"], s["x"]))
    finer, packed = paired(more.select("rep", F.explode(F.flatten(F.transform("keys", further))).alias("key")), p, "finer")
    pairs = staged(pairs.unionByName(finer).distinct(), "pairs")
    star = packed.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    return agreeing(pairs).unionByName(hubs).unionByName(star)


def compare(rows: list[tuple], p: Params):
    """Yield (a, b), a spanning forest of the links of one group. rows: (block, rep, sig, set)."""
    size = np.array([len(r[3]) // 8 for r in rows])
    sig = np.array([np.frombuffer(r[2], "<u2") for r in rows])
    sets = [np.frombuffer(r[3], "<u8") for r in rows]
    block = np.array([r[0] for r in rows])
    across = len(set(block.tolist())) > 1
    root = np.arange(len(rows))
    for i in range(len(rows) - 1):
        small, large = np.minimum(size[i], size[i + 1 :]), np.maximum(size[i], size[i + 1 :])
        ok = (root[i + 1 :] != root[i]) & (100 * small >= p.percent * large)
        if across:
            ok &= block[i + 1 :] != block[i]
        at = np.flatnonzero(ok) + i + 1
        if len(at):
            at = at[(sig[at] == sig[i]).sum(1) >= p.gate * p.hashes]
        for j in at:
            if root[j] == root[i]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= p.percent * (size[i] + size[j] - both):
                yield rows[i][1], rows[j][1]
                root[root == root[j]] = root[i]


def links(docs: DataFrame, classes: DataFrame, clusters: DataFrame, p: Params) -> DataFrame:
    """Verified links (a, b) between classes, enough to connect all that are linked."""
    placed = staged(clusters.join(classes.select(F.col("rep").alias("node"), "sig", "n_shingles"), "node"), "members")
    sized = placed.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("shingles"))
    wide = F.greatest(F.least(F.ceil(F.col("size") / p.block), F.lit(p.most_blocks)), F.ceil(F.col("size") / p.largest_block), F.ceil(F.col("shingles") * 8 / p.block_bytes))
    placed = staged(placed.join(sized.select("component", wide.cast("int").alias("blocks")), "component"), "clusters")
    near = placed.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "blocks", "sig")
    if placed.count() <= p.broadcast_rows:
        near = F.broadcast(near)
    texts = docs.select("doc_id", "text").join(near, "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "cluster", "block", "blocks", "sig"]

    def full_sets(batches):
        sets = Shingles(p)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array([sets(x.as_py()).astype("<u8").tobytes() for x in b.column("text")], pa.binary())], [*columns, "set"])

    dealt = texts.mapInArrow(full_sets, f"doc_id {kind}, cluster {kind}, block int, blocks int, sig binary, set binary")
    dealt = dealt.select("doc_id", "cluster", "block", "sig", "set", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    dealt = dealt.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "sig", "set")
    dealt = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")

    def by_group(batches):
        key, rows = None, []
        for b in batches:
            out = []
            for *k, block, rep, sig, s in zip(*[b.column(c).to_pylist() for c in ("cluster", "i", "j", "block", "doc_id", "sig", "set")], strict=True):
                if k != key:
                    out += compare(rows, p)
                    key, rows = k, []
                rows.append((block, rep, sig, s))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa_kind) for c in (0, 1)], ["a", "b"])
        out = list(compare(rows, p))
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa_kind) for c in (0, 1)], ["a", "b"])

    pa_kind = to_arrow_type(docs.schema["doc_id"].dataType)
    return dealt.mapInArrow(by_group, f"a {kind}, b {kind}")


@in_small_batches
def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of ``docs(doc_id, text)``."""
    sigs = staged(signatures(docs, p), "signatures")
    # written first, so that Spark can split a large class in the join with its smallest member
    stands = staged(sigs.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1 and rep is not null").drop("n"), "stands")
    members = staged(sigs.select("doc_id", "n_shingles", "set_id").join(stands, "set_id", "left").select("doc_id", "n_shingles", "set_id", F.coalesce("rep", "doc_id").alias("rep")), "members")
    others = members.where("set_id is not null and (doc_id is null or doc_id <> rep)").select("doc_id", "set_id")
    if others.count() <= p.broadcast_rows:
        others = F.broadcast(others)
    classes = sigs.where("set_id is not null and doc_id is not null").join(others, ["doc_id", "set_id"], "left_anti")
    classes = staged(classes.select(F.col("doc_id").alias("rep"), "n_shingles", "sig", "left", "right"), "classes")
    discard(sigs)
    clusters = components(ties(classes, p))
    linked = components(links(docs, classes, clusters, p))
    out = members.drop("set_id").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
