"""LM scoring by context-tree weighting over bytes, beside a unigram base.

Model. A byte (of the text with A-Z lower-cased) is eight binary decisions, each at a node of a
binary tree over byte values. Every node has a context tree over the preceding bytes, up to
``depth`` of them. A context's zeros and ones give a Krichevsky-Trofimov estimate; the weighted
probability of a context is half its own block estimate and half the product of its extensions',
so a prediction mixes the estimates of all depths along its path with posterior weights. A text
starts from ``depth`` start marks and ends with an end mark (byte 255, which UTF-8 never has).
Probabilities of zeros and of ones are mixed apart, so none is one less the other.

Statistics are counts of strings of ``depth`` + 1 bytes and of words.

1. Texts are dealt to shards of at most ``shard_bytes`` bytes (or one longer text) as they are read,
   and written with their shard's number and its distinct strings and words. From there on a text
   is known by what is written, never by how its files were split.
2. Strings and words go to buckets by a hash of their three bytes before the last, or of the word;
   a bucket adds up the counts of its shards. The contexts of up to two bytes, at most 255 * 65536
   nodes whatever the corpus, are weighted on the driver.
3. Each bucket answers its shards: the log-probability of each of their strings' last bytes, and the
   count of each of their words.
4. Each shard's answers meet its texts, and every text is scored in one pass.

Every table is dealt by bucket or shard, each bounded by parameters, whatever the number of strings.

Defined results: null texts are empty; an empty text is the end token alone. Long texts are scored
whole, each in a shard of its own. Repeated rows are scored each, and equal texts (ties) alike. Without
training rows all counts are zero and each bit has probability one half. An empty table gives an empty
result. A null doc_id is never held out. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_NP, discard, fold, in_small_batches, spans, staged, text_buffer

MARK = 255
TEXT, STRING, WORD = 0, 1, 2


@dataclass(frozen=True)
class Params:
    depth: int = 5  # 3 to 5: a string and a node number share 64 bits
    folds: int = 10
    held: int = 0
    shard_bytes: int = 48 << 20
    shard_rows: int = 3_000_000  # distinct strings or words of a shard, about
    buckets: int = 4096  # of strings and of words; a bucket's distinct ones fit a task
    group_rows: int = 400_000  # strings that are weighed at once, if buckets are smaller
    cache_words: int = 100_000
    chunk_bytes: int = 1 << 21


def strings(raw: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every text and its end mark: the string of it and ``depth`` bytes before; and where each text starts."""
    n = len(off) - 1
    flat = np.full(off[-1] - off[0] + n * (depth + 1), MARK, np.uint8)
    begin = off[:-1] - off[0] + np.arange(n) * (depth + 1) + depth
    at = np.arange(off[-1] - off[0]) + np.repeat((np.arange(n) + 1) * (depth + 1) - 1, np.diff(off))
    flat[at] = LOWER_NP[raw[off[0] : off[-1]]]
    key = np.zeros(len(flat) - depth, np.int64)
    for k in range(depth + 1):
        key <<= 8
        key |= flat[k : k + len(key)]
    keep = np.ones(len(key), bool)
    for k in range(depth):  # windows that reach over the end of a text
        keep[(begin[1:] - depth - depth + k)] = False
    return key[keep], off[:-1] - off[0] + np.arange(n)


def distinct(keys: np.ndarray, weight: int) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, and ``weight`` times how often it occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))) * weight


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Words:
    """64-bit hashes of the words of a text."""

    def __init__(self, most: int):
        import xxhash

        self.most, self.digest, self.known = most, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: bytes) -> np.ndarray:
        ws = text.lower().split()
        if len(self.known) > self.most:
            self.known.clear()
        for w in set(ws).difference(self.known):
            self.known[w] = self.digest(w)
        return np.fromiter(map(self.known.__getitem__, ws), np.uint64, len(ws)).view(np.int64)


def bucket_of(keys: np.ndarray, what: int, n: int) -> np.ndarray:
    """Strings that differ in their last byte or before their last four share a bucket."""
    x = ((keys >> 8) & 0xFFFFFF if what == STRING else keys).astype(np.uint64)
    with np.errstate(over="ignore"):
        return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % n


def binaries(data: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary value for each run of ``data`` that starts at ``first``."""
    offsets = (np.append(first, len(data)) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def joined(col: pa.Array, kind: str) -> np.ndarray:
    """All values of a binary column, one after the other."""
    return text_buffer(col)[0].view(kind)


def lengths(col: pa.Array) -> np.ndarray:
    return np.diff(text_buffer(col)[1]) // 8


def by_bucket(keys: np.ndarray, n: np.ndarray, what: int, buckets: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Buckets that occur, and the keys and counts of each as binary values."""
    at = bucket_of(keys, what, buckets)
    order = np.argsort(at, kind="stable")
    at, keys, n = at[order], keys[order], n[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
    return at[first], binaries(keys, first), binaries(n.astype(np.int64), first)


SHARDS = ["what", "shard", "bucket", "keys", "n", "doc_id", "text", "learn"]


def shards(docs: DataFrame, p: Params) -> DataFrame:
    """Rows of texts (what = TEXT), and of the distinct strings and words of each shard by bucket, with training counts (which may be 0)."""

    def run(batches):
        from pyspark import TaskContext

        words, shard, size = Words(p.cache_words), TaskContext.get().partitionId() << 24, 0
        held = {STRING: [], WORD: []}

        def flush(kind):
            for what, parts in held.items():
                if parts:
                    at, keys, n = by_bucket(*merged(parts), what, p.buckets)
                    k = len(at)
                    columns = [pa.array([what] * k, pa.int32()), pa.array([shard] * k, pa.int64()), pa.array(at, pa.int32()), keys, n, pa.nulls(k, kind), pa.nulls(k, pa.string()), pa.nulls(k, pa.bool_())]
                    yield pa.RecordBatch.from_arrays(columns, SHARDS)
                parts.clear()

        kind = None
        for b in batches:
            ids, learns = b.column("doc_id"), b.column("learn")
            kind = ids.type
            texts = b.column("text").fill_null("")
            raw, off = text_buffer(texts)
            learn = learns.to_numpy(zero_copy_only=False).astype(bool)
            for i, j in spans(off, p.chunk_bytes):
                if size and size + off[j] - off[i] > p.shard_bytes:
                    yield from flush(kind)
                    shard, size = shard + 1, 0
                n = j - i
                yield pa.RecordBatch.from_arrays([pa.array([TEXT] * n, pa.int32()), pa.array([shard] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), ids.slice(i, n), texts.slice(i, n), learns.slice(i, n)], SHARDS)
                size += off[j] - off[i] + 1
                key, start = strings(raw, off[i : j + 1], p.depth)
                own = np.repeat(learn[i:j], np.diff(np.append(start, len(key))))
                held[STRING] += [distinct(key[own], 1), distinct(key[~own], 0)]
                whole = raw[off[i] : off[j]].tobytes()
                for w in (True, False):
                    found = [words(whole[off[k] - off[i] : off[k + 1] - off[i]]) for k in range(i, j) if learn[k] == w]
                    if found:
                        held[WORD].append(distinct(np.concatenate(found), int(w)))
                most = 0
                for what, parts in held.items():
                    if sum(len(x[0]) for x in parts) >= p.shard_rows:
                        held[what] = [merged(parts)]
                        most = max(most, len(held[what][0][0]))
                if most >= p.shard_rows:
                    yield from flush(kind)
                    shard, size = shard + 1, 0
        if kind is not None:
            yield from flush(kind)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", (fold(F.col("doc_id"), p.folds) != p.held).alias("learn"))
    return rows.mapInArrow(run, f"what int, shard long, bucket int, keys binary, n binary, doc_id {kind}, text string, learn boolean")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: Stirling's series at x + 8, and back."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with ``a`` zeros and ``b`` ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


class Level:
    """Contexts of one depth at the nodes of one bit: counts, estimates, weights."""

    def __init__(self, key: np.ndarray, a: np.ndarray, b: np.ndarray, deeper: np.ndarray | None):
        self.key, self.up = np.unique(key, return_inverse=True)
        n = len(self.key)
        self.a, self.b = np.bincount(self.up, a, n), np.bincount(self.up, b, n)
        self.seen = self.a + self.b > 0
        self.estimate = np.stack([self.a + 0.5, self.b + 0.5], 1) / (self.a + self.b + 1)[:, None]  # of a zero, of a one
        own = block(self.a, self.b)
        if deeper is None:
            self.log_p = own
            self.stop = np.ones(n)
        else:
            self.log_p = np.logaddexp(own, np.bincount(self.up, deeper, n)) - np.log(2)
            self.stop = np.exp(np.minimum(own - np.log(2) - self.log_p, 0))

    def mixed(self, at: np.ndarray, q: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Predictions at this depth, of contexts ``at``, from those one byte deeper (where that context was seen)."""
        stop = self.stop[at][:, None]
        return np.where(seen[:, None], stop * self.estimate[at] + (1 - stop) * q, self.estimate[at])


def predictions(levels: list[Level]) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of a zero and a one for each context of the first (deepest) level, mixed up to the last; and whether the last was seen."""
    q, seen, at = levels[0].estimate, levels[0].seen, np.arange(len(levels[0].key))
    for level in levels[1:]:
        at = level.up[at]
        q = level.mixed(at, q, seen)
        seen = level.seen[at]
    return q, seen


def backwards(context: np.ndarray, depth: int) -> np.ndarray:
    """Contexts with their bytes in reverse, so that shorter contexts are prefixes."""
    out = np.zeros_like(context)
    for k in range(depth):
        out |= ((context >> (8 * k)) & 255) << (8 * (depth - 1 - k))
    return out


def deep(key: np.ndarray, n: np.ndarray, depth: int):
    """Weigh contexts of 3 to ``depth`` bytes. Returns for each string the probabilities of its own bits from three bytes on
    (NaN: unseen), and for contexts of two bytes and nodes: key, zeros, ones, sum of log-probabilities of their extensions."""
    context, x = backwards(key >> 8, depth), key & 255
    out, nodes = np.zeros((len(key), 8)), []
    for bit in range(8):
        node, one = (1 << bit) | (x >> (8 - bit)), (x >> (7 - bit)) & 1
        level = Level((context << 8) | node, n * (1 - one), n * one, None)
        levels = [level]
        for _ in range(depth - 3):
            level = Level(shorter(level.key), level.a, level.b, level.log_p)
            levels.append(level)
        q, seen = predictions(levels)
        at = levels[0].up
        out[:, bit] = np.where(seen[at], q[at, one], np.nan)
        nodes.append((shorter(level.key), level.a, level.b, level.log_p))
    return out, tuple(np.concatenate([x[k] for x in nodes]) for k in range(4))


def shorter(key: np.ndarray) -> np.ndarray:
    """(context, node) keys with the context's oldest byte left out."""
    return ((key >> 16) << 8) | (key & 255)


def shallow(key: np.ndarray, a: np.ndarray, b: np.ndarray, deeper: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For contexts of two bytes and nodes, sorted: key; constants (of a zero, a one) and factor, so that the mixture over depths
    0 to 2 is constant + factor * q for a prediction q from three bytes on; and the mixture if three bytes were not seen together."""
    two = Level(key, a, b, deeper)
    one = Level(shorter(two.key), two.a, two.b, two.log_p)
    none = Level(shorter(one.key), one.a, one.b, one.log_p)

    def mixed(q, seen):
        at = np.arange(len(two.key))
        for level in (two, one, none):
            at = at if level is two else level.up[at]
            q, seen = level.mixed(at, q, seen), level.seen[at]
        return np.where(seen[:, None], q, 0.5)

    zero, every = np.zeros((len(two.key), 2)), np.ones(len(two.key), bool)
    factor = np.ones(len(two.key))
    at = np.arange(len(two.key))
    for level in (two, one, none):
        at = at if level is two else level.up[at]
        factor *= 1 - level.stop[at]
    return two.key, mixed(zero, every), factor, mixed(zero, ~every)


def summed(table: DataFrame, p: Params) -> DataFrame:
    """Counts of all shards: a row for each bucket (what, bucket, keys, n: distinct and sorted; total and seen: sums over its keys),
    and rows of two-byte contexts (node, a, b, log_p) to be added up."""
    names = ["what", "bucket", "keys", "n", "total", "seen", "node", "a", "b", "log_p"]

    def flush(what, keys, n):
        at, k, c = by_bucket(keys, n, what, p.buckets)
        size = len(at)
        where = np.repeat(np.arange(size), lengths(k))
        counts = joined(c, "<i8")
        none = [pa.nulls(size, t) for t in (pa.int64(), pa.float64(), pa.float64(), pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([what] * size, pa.int32()), pa.array(at, pa.int32()), k, c, pa.array(np.bincount(where, counts, size).astype(np.int64)), pa.array(np.bincount(where, counts > 0, size).astype(np.int64)), *none], names)
        if what == STRING:
            _, (node, a, b, log_p) = deep(keys, n, p.depth)
            level = Level(node, a, b, log_p)
            size = len(level.key)
            none = [pa.nulls(size, t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(level.key), pa.array(level.a), pa.array(level.b), pa.array(np.bincount(level.up, log_p, size))], names)

    def run(batches):
        held, size, now = [], 0, None
        for b in batches:
            whats, ats = b.column("what").to_numpy(), b.column("bucket").to_numpy()
            size_of = lengths(b.column("keys"))
            keys, n = joined(b.column("keys"), "<i8"), joined(b.column("n"), "<i8")
            end = np.cumsum(size_of)
            edge = np.flatnonzero((whats[1:] != whats[:-1]) | (ats[1:] != ats[:-1])) + 1
            for i, j in zip(np.append(0, edge), np.append(edge, len(whats)), strict=True):
                this = int(whats[i]), int(ats[i])
                if now is not None and this != now and (size >= p.group_rows or this[0] != now[0]):
                    yield from flush(now[0], *merged(held))
                    held, size = [], 0
                now = this
                s = slice(end[i] - size_of[i], end[j - 1])
                held.append((keys[s], n[s]))
                size += s.stop - s.start
                if len(held) > 1 and size >= 8 * p.group_rows:  # a large bucket: add up before there is more of it
                    held = [merged(held)]
                    size = len(held[0][0])
        if held:
            yield from flush(now[0], *merged(held))

    rows = table.where(F.col("what") != TEXT).select("what", "bucket", "keys", "n").repartition("what", "bucket").sortWithinPartitions("what", "bucket")
    return rows.mapInArrow(run, "what int, bucket int, keys binary, n binary, total long, seen long, node long, a double, b double, log_p double")


def log10_of(keys: np.ndarray, n: np.ndarray, depth: int, mix) -> np.ndarray:
    """log10 of the probability of each string's last byte after the others."""
    q, _ = deep(keys, n, depth)
    nodes, constant, factor, unseen = mix
    context, x, total = backwards((keys >> 8) & 0xFFFF, 2), keys & 255, np.zeros(len(keys))
    for bit in range(8):
        at = np.searchsorted(nodes, (context << 8) | (1 << bit) | (x >> (8 - bit)))
        one = (x >> (7 - bit)) & 1
        total += np.log10(np.where(np.isnan(q[:, bit]), unseen[at, one], constant[at, one] + factor[at] * q[:, bit]))
    return total


def answers(table: DataFrame, sums: DataFrame, mix, p: Params) -> DataFrame:
    """what, shard, keys, values: for each shard's strings their log-probabilities, for its words their counts (doubles)."""
    shared = table.sparkSession.sparkContext.broadcast(mix)

    def run(batches):
        known = {STRING: (np.zeros(0, np.int64),) * 2, WORD: (np.zeros(0, np.int64),) * 2}  # keys and values of the last buckets
        counts, asked, size = {STRING: [], WORD: []}, {STRING: [], WORD: []}, 0

        def flush():
            for what in counts:
                if counts[what]:
                    keys, n = (np.concatenate([x[k] for x in counts[what]]) for k in (0, 1))
                    values = log10_of(keys, n, p.depth, shared.value) if what == STRING else n.astype(np.float64)
                    last = len(keys) - len(counts[what][-1][0])
                    old = known[what]
                    known[what] = keys[last:], values[last:]  # more shards may ask for the last bucket
                    keys, values = np.concatenate([old[0], keys]), np.concatenate([old[1], values])
                    counts[what].clear()
                else:
                    keys, values = known[what]
                if asked[what]:
                    order = np.argsort(keys)
                    keys, values = keys[order], values[order]
                    shard, size_of = (np.concatenate([x[k] for x in asked[what]]) for k in (0, 1))
                    wanted = np.concatenate([x[2] for x in asked[what]])
                    first = np.cumsum(size_of) - size_of
                    got = values[np.searchsorted(keys, wanted)]
                    asked[what].clear()
                    yield pa.RecordBatch.from_arrays([pa.array([what] * len(shard), pa.int32()), pa.array(shard), binaries(wanted, first), binaries(got.astype("<f4") if what == STRING else got, first)], ["what", "shard", "keys", "values"])

        for b in batches:
            what, shard = b.column("what").to_numpy(), b.column("shard").to_numpy()
            size_of = lengths(b.column("keys"))
            keys, n = joined(b.column("keys"), "<i8"), joined(b.column("n"), "<i8")
            end = np.cumsum(size_of)
            count_at = np.append(0, np.cumsum(np.where(shard < 0, size_of, 0)))
            for k in (STRING, WORD):
                for r in np.flatnonzero((what == k) & (shard < 0)):
                    counts[k].append((keys[end[r] - size_of[r] : end[r]], n[count_at[r] : count_at[r + 1]]))
                rows = np.flatnonzero((what == k) & (shard >= 0))
                if len(rows):
                    pick = np.repeat((what == k) & (shard >= 0), size_of)
                    asked[k].append((shard[rows], size_of[rows], keys[pick]))
            size += len(keys)
            if size >= 2 * p.group_rows:
                yield from flush()
                size = 0
        yield from flush()

    ask = table.where(F.col("what") != TEXT).select("what", "bucket", "shard", "keys", F.lit(None).cast("binary").alias("n"))
    tell = sums.where("what is not null").select("what", "bucket", F.lit(-1).cast("long").alias("shard"), "keys", "n")
    rows = ask.unionByName(tell).repartition("what", "bucket").sortWithinPartitions("what", "bucket", "shard")
    return rows.mapInArrow(run, "what int, shard long, keys binary, values binary")


class Lookup:
    """Open addressing over 64-bit keys, probed for a whole array at once. Values of absent keys are 0."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.free = int(np.setdiff1d(np.arange(-1, -2 - len(keys), -1), keys)[0])  # marks empty slots
        self.keys, self.values = np.full(1 << self.bits, self.free, np.int64), np.zeros(1 << self.bits, values.dtype)
        slot, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot] == self.free
            self.keys[slot[free]] = keys[left[free]]
            placed = self.keys[slot] == keys[left]
            self.values[slot[placed]] = values[left[placed]]
            slot, left = (slot[~placed] + 1) & ((1 << self.bits) - 1), left[~placed]

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h >>= np.uint64(64 - self.bits)
            return h.view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slot(keys)
        there = self.keys[slot]
        hit = there == keys
        out = np.where(hit, self.values[slot], self.values.dtype.type(0))
        left = np.flatnonzero(~hit & (there != self.free))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (there != self.free)
            slot, left = slot[go], left[go]
        return out


@in_small_batches
def score(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row of ``docs(doc_id, text)``.

    ``bits_per_byte`` is the code length of the text and its end mark for each byte of them.
    """
    spark = docs.sparkSession
    table = staged(shards(docs, p), "shards", compression="zstd")
    sums = staged(summed(table, p), "sums")
    nodes = sums.where("node is not null").groupBy("node").agg(*[F.sum(c).alias(c) for c in ("a", "b", "log_p")]).toArrow()
    key, a, b, log_p = (nodes.column(c).to_numpy() for c in ("node", "a", "b", "log_p"))
    mix = shallow(key, a, b, log_p)
    ends = table.where(F.col("what") == TEXT).agg(F.count_if("learn")).first()[0]
    tokens, distinct = sums.where(F.col("what") == WORD).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("seen"), F.lit(0))).first()
    tokens, distinct = int(tokens + ends), int(distinct + (ends > 0))
    log_total, log_end = float(np.log10(tokens + 0.1 * (distinct + 1))), float(np.log10(ends + 0.1))

    def run(batches):
        words, now, held, value, often = Words(p.cache_words), None, {STRING: [], WORD: []}, None, None
        for b in batches:
            whats, of = b.column("what").to_numpy(), b.column("shard").to_numpy()
            edge = np.flatnonzero((whats[1:] != whats[:-1]) | (of[1:] != of[:-1])) + 1
            for i, j in zip(np.append(0, edge), np.append(edge, len(whats)), strict=True):
                part, what = b.slice(i, j - i), int(whats[i])
                if of[i] != now:
                    now, value, often = of[i], None, None
                    held = {STRING: [], WORD: []}
                if what != TEXT:
                    held[what].append((joined(part.column("keys"), "<i8"), joined(part.column("values"), "<f4" if what == STRING else "<f8")))
                    continue
                if value is None:  # a shard's texts come after its answers
                    value, often = (Lookup(*(np.concatenate([np.zeros(0, t), *[x[k] for x in held[w]]]) for k, t in ((0, np.int64), (1, v)))) for w, v in ((STRING, np.float32), (WORD, np.float64)))
                    held = {STRING: [], WORD: []}
                raw, off = text_buffer(part.column("text"))
                for s, e in spans(off, p.chunk_bytes):
                    n = e - s
                    key, start = strings(raw, off[s : e + 1], p.depth)
                    total = np.add.reduceat(value(key), start, dtype=np.float64)
                    whole = raw[off[s] : off[e]].tobytes()
                    found = [words(whole[off[k] - off[s] : off[k + 1] - off[s]]) for k in range(s, e)]
                    size = np.fromiter(map(len, found), np.int64, n)
                    c, row = often(np.concatenate(found)), np.repeat(np.arange(n), size)
                    known = np.bincount(row, c > 0, n).astype(np.int64) + int(ends > 0)
                    base = np.bincount(row, np.log10(c + 0.1), n) + log_end - (size + 1) * log_total
                    bits = -total / np.log10(2) / (off[s + 1 : e + 1] - off[s:e] + 1)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(s, n), pa.array(size + 1), pa.array(known), pa.array(base), pa.array(total), pa.array(bits)], ["doc_id", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = table.where(F.col("what") == TEXT).select("what", "shard", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("values"), "doc_id", "text")
    rows = texts.unionByName(answers(table, sums, mix, p), allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", F.desc("what"))
    out = staged(rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"), "scores")
    discard(table)
    discard(sums)
    return out.select("doc_id", (fold(F.col("doc_id"), p.folds) == p.held).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
