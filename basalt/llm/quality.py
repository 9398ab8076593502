"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text (shares of character classes, word lengths, repetition of words and
lines) are computed in Arrow batches. The trees are fitted on a bounded sample of labelled rows
(``max_rows``): features are cut into ``bins`` quantile bins, each level of a tree builds one
histogram of gradients over (node, feature, bin), and the trees are flattened into arrays that
numpy walks for a whole batch at once.

Defined results: null and empty texts have zero statistics and are scored as such. Repeated rows
are scored each; an empty table gives an empty result; without labels of both classes the score
is the constant share of positives (0.0 without labels). Labels that are null are left out; of
several labels for a doc_id the larger counts. Of several rows of a labelled doc_id (ties) one is
learned from, the least by its statistics. Long texts count whole. Other columns, whatever their
names, are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, in_small_batches, spans, text_buffer

FEATURES = [
    "log_bytes", "log_words", "log_lines", "upper", "lower", "digit", "space", "high", "symbol", "stop", "comma", "word_mean", "word_max",
    "word_sd", "distinct_words", "distinct_lines", "repeated_line_bytes", "words_ending_in_symbol", "symbol_runs", "entropy",
]


@dataclass(frozen=True)
class Params:
    bins: int = 64
    trees: int = 60
    depth: int = 4
    rate: float = 0.2
    l2: float = 1.0
    max_rows: int = 20000
    chunk_bytes: int = 1 << 20


#: 0 other (control), 1 upper, 2 lower, 3 digit, 4 space, 5 high, 6 symbol, 7 full stop, 8 comma
KIND = np.zeros(256, np.uint8)
KIND[33:127] = 6
KIND[65:91], KIND[97:123], KIND[48:58] = 1, 2, 3
KIND[[32, 9, 10, 11, 12, 13]] = 4
KIND[128:] = 5
KIND[[46, 33, 63]] = 7
KIND[[44, 59, 58]] = 8


def statistics(raw: np.ndarray, off: np.ndarray, chunk: int) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = np.zeros((len(off) - 1, len(FEATURES)))
    for i, j in spans(off, chunk):
        part, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        kind = KIND[part]
        whole = part.tobytes()
        for k in range(j - i):
            a, b = int(o[k]), int(o[k + 1])
            n = b - a
            if not n:
                continue
            own, text = kind[a:b], whole[a:b]
            c = np.bincount(own, minlength=9)[1:9] / n
            words = text.split()
            nw = len(words)
            f = out[i + k]
            f[0], f[3:11] = np.log1p(n), c
            f[1] = np.log1p(nw)
            lines = [x for x in text.split(b"\n") if x.strip()]
            f[2] = np.log1p(len(lines))
            if nw:
                length = np.fromiter(map(len, words), np.float64, nw)
                f[11], f[12], f[13] = length.mean(), np.log1p(length.max()), length.std()
                f[14] = len(set(words)) / nw
            if lines:
                once = set(lines)
                f[15] = len(once) / len(lines)
                f[16] = 1 - sum(map(len, once)) / sum(map(len, lines))
            mark = own >= 6
            pair = mark[1:] & mark[:-1]
            if nw:
                f[17] = np.count_nonzero(mark[:-1] & (own[1:] == 4)) / nw
                f[18] = np.count_nonzero(pair) / nw
            p = np.bincount(part[a:b], minlength=256)
            p = p[p > 0] / n
            f[19] = -(p * np.log2(p)).sum()
    return out


def fit(x: np.ndarray, y: np.ndarray, p: Params) -> dict:
    """Boosted trees as flat arrays: node k of tree t has children 2k+1 and 2k+2."""
    n, m = x.shape
    prior = float(np.clip(y.mean() if n else 0.0, 1e-9, 1 - 1e-9))
    inner = (1 << p.depth) - 1
    model = {"bias": float(np.log(prior / (1 - prior))), "feature": np.zeros((p.trees, inner), np.int16), "cut": np.full((p.trees, inner), np.inf), "leaf": np.zeros((p.trees, inner + 1)), "depth": p.depth}
    if n == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, p.bins + 1)[1:-1])) for f in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    cell = binned + np.arange(m) * p.bins
    z = np.full(n, model["bias"])
    for t in range(p.trees):
        q = 1 / (1 + np.exp(-z))
        grad, hess = q - y, q * (1 - q)
        node = np.zeros(n, np.int64)
        for level in range(p.depth):
            first, width = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (m * p.bins) + cell).ravel()
            shape = (width, m, p.bins)
            g = np.bincount(at, np.repeat(grad, m), width * m * p.bins).reshape(shape)
            h = np.bincount(at, np.repeat(hess, m), width * m * p.bins).reshape(shape)
            gl, hl = g.cumsum(2)[:, :, :-1], h.cumsum(2)[:, :, :-1]
            gt, ht = g.sum(2)[:, :, None], h.sum(2)[:, :, None]
            gain = gl**2 / (hl + p.l2) + (gt - gl) ** 2 / (ht - hl + p.l2) - gt**2 / (ht + p.l2)
            gain[(hl < 1) | (ht - hl < 1)] = 0
            best = gain.reshape(width, -1).argmax(1)
            top = gain.reshape(width, -1)[np.arange(width), best]
            feat, b = best // (p.bins - 1), best % (p.bins - 1)
            for w in range(width):
                e = edges[feat[w]]
                if top[w] > 1e-6 and b[w] < len(e):
                    model["feature"][t, first + w], model["cut"][t, first + w] = feat[w], e[b[w]]
            f = model["feature"][t][node]
            node = 2 * node + 1 + (x[np.arange(n), f] > model["cut"][t][node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        model["leaf"][t] = -p.rate * g / (h + p.l2)
        z += model["leaf"][t][leaf]
    return model


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Walk all trees for all rows, one level at a time."""
    n, inner = len(x), model["feature"].shape[1]
    z = np.full(n, model["bias"])
    rows = np.arange(n)
    for feature, cut, leaf in zip(model["feature"], model["cut"], model["leaf"], strict=True):
        node = np.zeros(n, np.int64)
        for _ in range(model["depth"]):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        z += leaf[node - inner]
    return 1 / (1 + np.exp(-z))


@in_small_batches
def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> dict:
    known = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg((F.max(F.col("label").cast("int")) > 0).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_rows)

    def run(batches):
        for b in batches:
            raw, off = text_buffer(b.column("text"))
            x = statistics(raw, off, p.chunk_bytes)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([r.astype("<f8").tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text").mapInArrow(run, f"doc_id {kind}, y int, x binary")
    # one row for each id of the sample, however many rows have it
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("r")).select("r.*").collect()
    rows = sorted((int(r[0]), bytes(r[1])) for r in rows)
    x = np.array([np.frombuffer(r[1], "<f8") for r in rows]).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r[0] for r in rows], float), p)


def score(docs: DataFrame, model: dict, keep: list[str], p: Params = Params(), name: str = "score") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # trees x nodes: fixed by the parameters
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)

    def run(batches):
        for b in batches:
            raw, off = text_buffer(b.column("text"))
            s = predict(shared.value, statistics(raw, off, p.chunk_bytes))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(s)], [*keep, name])

    return docs.select(*keep, *[c for c in ("text",) if c not in keep]).mapInArrow(run, f"{schema}, `{name}` double")


def quality(docs: DataFrame, labels: DataFrame, p: Params = Params(), folds: int = 3, held: int = 1, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Score every row of ``docs(doc_id, text)``; ``labels(doc_id, label)`` of fold ``held`` are never learned from."""
    learn = labels.where(fold(F.col("doc_id"), folds) != held)
    out = score(docs, train(docs, learn, p), keep or ["doc_id"], p)
    return out.withColumn("held_out", fold(F.col("doc_id"), folds) == held).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
