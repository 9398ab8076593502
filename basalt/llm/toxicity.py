"""Toxicity: averaged subword embeddings under a linear softmax.

A text is the bag of the character n-grams of its words (bytes of UTF-8, A-Z lower-cased, with
word boundaries as characters). N-grams are hashed to buckets; each bucket has an embedding, a
text is the average of its n-grams' embeddings, and a linear softmax tells two classes apart.
Embeddings and softmax are trained together, so a misspelling that training never saw still
shares most of its n-grams with the word it distorts.

The fit uses a bounded sample of labelled rows (``max_positive`` and ``max_negative``); scoring
covers whole texts and needs no shuffle.

Defined results: null and empty texts, and texts without word characters, get the score of the
bias alone. Repeated rows are scored each; an empty table gives an empty result; without labels
of both classes the score is the constant share of positives (0.0 without labels). Labels that
are null are left out; of several labels for a doc_id the larger counts. Of several rows of a labelled
doc_id (ties) one is learned from, the least by its bag. Long texts count whole. Other columns, whatever
their names, are never read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, LOWER_NP, in_small_batches, spans, text_buffer

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

SHARE = 1024  # of which a weight in a bag is a part, so that half precision holds it


@dataclass(frozen=True)
class Params:
    n_min: int = 2
    n_max: int = 4
    bits: int = 16  # at most 16: the sample's bags hold buckets in two bytes
    dim: int = 16
    epochs: int = 6
    least_steps: int = 2000  # small samples are gone through more often
    batch: int = 32
    rate: float = 0.3
    scale: float = 100.0
    prior: int = 300  # n-grams of no weight that every text has besides its own, so that short texts stay near the bias
    max_positive: int = 3000
    max_negative: int = 10000
    chunk_bytes: int = 1 << 20


def grams(raw: np.ndarray, off: np.ndarray, p: Params):
    """Yield (start row, end row, row starts, bucket of each n-gram or -1) for each n and chunk.

    Every row is laid out as a separator and its bytes; an n-gram may have separators at its ends
    only, and belongs to the row in which it starts.
    """
    for i, j in spans(off, p.chunk_bytes):
        rows = j - i
        start = off[i:j] - off[i] + np.arange(rows)
        flat = np.zeros(off[j] - off[i] + rows + 1, np.uint8)
        keep = np.ones(len(flat), bool)
        keep[start] = keep[-1] = False
        flat[keep] = LOWER_NP[raw[off[i] : off[j]]]
        sep = ~WORD[flat]
        flat[sep] = 0
        before = np.concatenate([[0], np.cumsum(sep, dtype=np.int32)])
        out = []
        h = np.zeros(len(flat), np.uint32)
        with np.errstate(over="ignore"):
            for n in range(1, p.n_max + 1):
                m = len(flat) - n + 1
                if m <= 0:
                    break
                h = h[:m] * np.uint32(0x01000193) + flat[n - 1 :] + np.uint32(n)
                if n < p.n_min:
                    continue
                ok = before[n - 1 : n - 1 + m] == before[1 : 1 + m]
                out.append(np.where(ok, ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - p.bits)).astype(np.int32), -1))
        yield i, j, start, out


def bags(p: Params):
    """mapInArrow function: (doc_id, y, text) to (doc_id, y, ids, weights), a sparse bag for each row."""

    def run(batches):
        for b in batches:
            raw, off = text_buffer(b.column("text"))
            y = b.column("y").to_pylist()
            ids, weights = [], []
            for i, j, start, parts in grams(raw, off, p):
                end = [*start[1:], None]
                for k in range(j - i):
                    own = np.concatenate([g[start[k] : end[k]] for g in parts] or [np.zeros(0, np.int32)])
                    own, n = np.unique(own[own >= 0], return_counts=True)
                    ids.append(own.astype("<u2").tobytes())
                    weights.append((SHARE * n / (n.sum() + p.prior)).astype("<f2").tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "y": pa.array(y, pa.int32()), "ids": pa.array(ids, pa.binary()), "weights": pa.array(weights, pa.binary())})

    return run


def fit(bag_rows: list, p: Params) -> tuple[np.ndarray, float]:
    """Train embeddings and softmax together on the sample's bags. Returns the logit of each bucket (scaled) and the bias.

    The softmax has a row of ``dim`` weights for each class. Its score of a text depends on the difference of the two rows only,
    so after training each bucket's embedding times that difference is one number, and texts are scored from those.
    """
    y = np.array([r[0] for r in bag_rows], np.float32)
    size = 1 << p.bits
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return np.zeros(size, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    ids = [np.frombuffer(r[1], "<u2") for r in bag_rows]
    wts = [np.frombuffer(r[2], "<f2") for r in bag_rows]
    n_ids = np.array([len(x) for x in ids])
    rng = np.random.default_rng(7)
    emb = rng.uniform(-1.0 / p.dim, 1.0 / p.dim, (size, p.dim)).astype(np.float32)
    soft = rng.uniform(-1.0, 1.0, (2, p.dim)).astype(np.float32) / np.float32(np.sqrt(p.dim))
    bias = float(np.log(y.mean() / (1 - y.mean())))
    emb_sq, soft_sq, bias_sq = np.full(size, 1e-6, np.float32), np.full(soft.shape, 1e-6, np.float32), 1e-6
    epochs = max(p.epochs, -(-p.least_steps * p.batch // len(y)))
    for epoch in range(epochs):
        rate = p.rate * (1 - epoch / epochs)
        order = rng.permutation(np.flatnonzero(n_ids))
        for s in range(0, len(order), p.batch):
            pick = order[s : s + p.batch]
            i = np.concatenate([ids[k] for k in pick])
            w = np.concatenate([wts[k] for k in pick]).astype(np.float32) * np.float32(p.scale / SHARE)
            first = np.cumsum(n_ids[pick]) - n_ids[pick]
            d = np.repeat(np.arange(len(pick)), n_ids[pick])
            h = np.add.reduceat(emb[i] * w[:, None], first)
            row = soft[1] - soft[0]
            g = ((1 / (1 + np.exp(-np.clip(h @ row + bias, -30, 30))) - y[pick]) / len(pick)).astype(np.float32)
            back = np.bincount(i, w * g[d], size)
            used = np.flatnonzero(back)
            back = back[used].astype(np.float32)  # times the difference of rows: the gradient of a bucket
            emb_sq[used] += np.square(back) * np.square(row).sum()
            emb[used] -= (rate * back / np.sqrt(emb_sq[used]))[:, None] * row
            step = np.stack([-(g @ h), g @ h])
            soft_sq += np.square(step)
            soft -= np.float32(rate) * step / np.sqrt(soft_sq)
            bias_sq += float(g.sum()) ** 2
            bias -= rate * float(g.sum()) / bias_sq**0.5
    return (emb @ (soft[1] - soft[0]) * p.scale).astype(np.float32), bias


@in_small_batches
def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> tuple[np.ndarray, float]:
    """Fit on a bounded sample: the first ids in hash order of each class."""
    known = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("y > 0").orderBy(*order).limit(p.max_positive).unionByName(known.where("y <= 0").orderBy(*order).limit(p.max_negative))
    sample = sample.withColumn("y", (F.col("y") > 0).cast("int"))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    # one row for each id of the sample, however many rows have it
    got = rows.mapInArrow(bags(p), f"doc_id {kind}, y int, ids binary, weights binary").groupBy("doc_id").agg(F.min(F.struct("y", "ids", "weights")).alias("r")).select("r.*").toArrow()
    got = [(y.as_py(), i.as_buffer(), w.as_buffer()) for y, i, w in zip(*got.columns, strict=True)]
    return fit(sorted(got, key=lambda r: (r[0], zlib.crc32(r[1]), zlib.crc32(r[2]))), p)


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str], p: Params = Params(), name: str = "score") -> DataFrame:
    """``keep`` columns of ``docs`` (with ``text`` read) and the score, as ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)

    def run(batches):
        logits, bias = shared.value
        table = np.append(logits, np.float32(0))  # -1 points here
        for b in batches:
            raw, off = text_buffer(b.column("text"))
            total = np.zeros(len(off) - 1)
            count = np.zeros(len(off) - 1)
            for i, j, start, parts in grams(raw, off, p):
                for g in parts:
                    ok = start < len(g)
                    if ok.any():
                        total[i:j][ok] += np.add.reduceat(table[g], start[ok], dtype=np.float64)
                        count[i:j][ok] += np.add.reduceat(g >= 0, start[ok], dtype=np.int64)
            z = total / (count + p.prior) + bias
            s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(s)], [*keep, name])

    picked = docs.select(*keep, *[c for c in ("text",) if c not in keep])
    return picked.mapInArrow(run, f"{schema}, `{name}` double")


def toxicity(docs: DataFrame, labels: DataFrame, p: Params = Params(), folds: int = 4, held: int = 2, threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """Score every row of ``docs(doc_id, text)``; ``labels(doc_id, label)`` of fold ``held`` are never learned from."""
    learn = labels.where(fold(F.col("doc_id"), folds) != held)
    out = score(docs, train(docs, learn, p), keep or ["doc_id"], p)
    return out.withColumn("held_out", fold(F.col("doc_id"), folds) == held).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
