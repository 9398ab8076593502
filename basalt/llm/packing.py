"""Best-fit packing: whole documents into sequences of a fixed number of tokens.

Documents are tokenised in Arrow batches, an end id is appended, and documents longer than
``capacity`` are cut into pieces (the first piece takes the remainder, all others are full).
Pieces of one length are interchangeable, so the packing is planned on the histogram of lengths,
which has at most ``capacity`` entries however large the corpus is. One bin is filled greedily
(largest piece that fits, again and again); then its smallest piece is replaced by two unpacked
pieces if a pair fits the expanded gap more tightly. The bin found is a pattern that is used as
often as the histogram allows, so the plan takes few steps. A piece is numbered within its length
(in hash buckets, whose offsets come from counts), and its number selects its pattern, sequence
and offset in a sorted table of slots; that table depends on ``capacity``, not on the corpus.

Defined results: null text is empty, and an empty document is the end id alone. Repeated rows are
packed each on their own. An empty table gives an empty result. Among equally tight pairs (ties) that
with the shortest first piece is taken. Long texts are encoded whole. Other columns, whatever their
names, are ignored. Literal special tokens in a text are
what the tokenizer file makes of them.
"""

from __future__ import annotations

import base64
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_small_batches, staged


@dataclass(frozen=True)
class Params:
    tokenizer: str  # a tokenizers file (.json)
    ranks: str | None = None  # the same vocabulary as ranks, for texts on which both agree
    end_id: int = 2
    capacity: int = 1024
    rows_per_bucket: int = 4000
    max_buckets: int = 65536


#: Characters on which the fast and the reference tokenizer split words alike: white space, printable ASCII, Latin letters.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-ʯ‐-‧‰-⁞€]*")


class Encoder:
    """Token ids of texts. Plain Latin texts go through the rank table, all others through the tokenizer file."""

    def __init__(self, p: Params):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(p.tokenizer)
        self.fast = None
        if p.ranks:
            import tiktoken

            with open(p.ranks, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the vocabulary's word pattern
            self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and "<|" not in text and PLAIN.fullmatch(text):  # the file alone knows special tokens
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: the first has the remainder."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)] if n else []


def pieces(docs: DataFrame, p: Params) -> DataFrame:
    """One row for each piece: doc_id, row key, piece, start, length, ids_crc32."""

    def run(batches):
        encode = Encoder(p)
        for b in batches:
            keys = b.column("doc_id").to_pylist()
            rows = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for key, text in zip(keys, b.column("text"), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.array([p.end_id], "<u4"))
                for k, (s, n) in enumerate(cut(len(ids), p.capacity)):
                    for c, v in zip(rows, (key, k, s, n, zlib.crc32(ids[s : s + n].tobytes())), strict=True):
                        rows[c].append(v)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(rows["doc_id"], b.column("doc_id").type), "piece": pa.array(rows["piece"], pa.int32()), **{c: pa.array(rows[c], pa.int64()) for c in ("start", "length", "ids_crc32")}})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def one_bin(left: np.ndarray, capacity: int) -> list[int]:
    """The lengths of one bin, from the counts of unpacked pieces by length."""
    left = left.copy()
    gap, taken = capacity, []
    have = np.flatnonzero(left)
    while gap and len(have):
        k = int(np.searchsorted(have, gap, side="right")) - 1
        if k < 0:
            break
        n = int(have[k])
        take = min(gap // n, int(left[n]))
        taken += [n] * take
        left[n] -= take
        gap -= n * take
        have = have[: k + (left[n] > 0)]
    if gap and len(taken) > 1:  # swap the smallest for a pair that leaves less
        least = taken[-1]
        room = gap + least
        a = np.flatnonzero(left[: room + 1])
        if len(a):
            # for each first piece, the largest second one that fits, no larger than the first
            rest = np.minimum(room - a, a)
            k = np.searchsorted(a, rest, side="right") - 1
            ok = k >= 0
            b = np.where(ok, a[np.maximum(k, 0)], 0)
            twin = ok & (b == a) & (left[a] < 2)
            b = np.where(twin, np.where(k > 0, a[np.maximum(k - 1, 0)], 0), b)
            total = np.where(b > 0, a + b, 0)
            best = int(total.argmax())
            if total[best] > least:
                taken = [*taken[:-1], int(a[best]), int(b[best])]
    return sorted(taken, reverse=True)


def plan(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Slots for all pieces, as rows (length, first number, sequence of the first, offset), sorted; and the number of sequences.

    Numbers first, first + 1, ... of a length go to consecutive sequences at the same offset.
    """
    left = counts.astype(np.int64).copy()
    used = np.zeros_like(left)
    slots, sequence = [], 0
    while left.any():
        lengths = one_bin(left, capacity)
        need = np.bincount(lengths, minlength=len(left))
        at = np.flatnonzero(need)
        times = int((left[at] // need[at]).min())
        offset = 0
        for n in lengths:
            slots.append((n, int(used[n]), sequence, offset))
            used[n] += times
            offset += n
        left -= need * times
        sequence += times
    return np.array(sorted(slots), dtype=np.int64).reshape(-1, 4), sequence


@in_small_batches
def pack(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of ``docs(doc_id, text)``."""
    cutup = staged(pieces(docs, p), "pieces")
    total = cutup.count()
    buckets = min(max(64, total // p.rows_per_bucket), p.max_buckets)
    dealt = cutup.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = dealt.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("bucket", "length", F.coalesce("before", F.lit(0)).alias("before"))
    histogram = np.zeros(p.capacity + 1, np.int64)
    for n, c in counts.groupBy("length").agg(F.sum("n")).collect():
        histogram[n] = c
    slots, _ = plan(histogram, p.capacity)
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    order = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("number", F.row_number().over(order) - 1).join(before, ["bucket", "length"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("before")).alias("number"))

    def place(batches):
        s = shared.value
        wide = np.int64(1) << np.int64(50)
        key = s[:, 0] * wide + s[:, 1]
        for b in batches:
            number = b.column("number").to_numpy()
            k = np.searchsorted(key, b.column("length").to_numpy() * wide + number, side="right") - 1
            columns = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(s[k, 2] + number - s[k, 1]), pa.array(s[k, 3])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return numbered.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
