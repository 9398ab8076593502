"""Benchmark decontamination by a distributed positional inverted index.

Indexing. The words of every document are postings (term, position) of an index in segments of at
most ``segment_bytes`` bytes of text (or one longer document). A segment holds its terms in order and
each term's positions; its documents lie one after the other with a gap between them, so no match
crosses documents. The index is written to the shared folder once and serves any benchmark.

Searching. The items of a benchmark are cut into windows of ``window`` consecutive words. In each segment
that has all terms of a window, the list of its rarest term (by postings of the whole corpus), less the
term's offset, gives the places where the window could start; that list is intersected with the
offset-adjusted lists of its other terms, from the rarest to the most common. What remains are exact
phrase matches. Proximity matches, where the words of a window fall in a stretch of the document in
any order, intersect ranges of the same lists.

A segment's lists meet only each other, so neither building nor searching the index shuffles; a word or
passage that is in a third of the corpus loads no task more than another. The benchmark is taken in
blocks of at most ``block_words`` words, each broadcast; windows are searched in slices of at most
``slice_rows`` candidates.

Defined results: null and empty documents have no words and no hits. Items without words (null
ones too) have no windows; an item of fewer than ``window`` words is one window. Repeated item
rows, and equal items (ties), each count as their item_id; equal item_ids count once. Repeated and
long documents are judged each and whole. Other columns, whatever their names, are ignored unless
``keep`` names them. Empty tables give no rows (documents) or no hits (benchmark).
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG_ROWS, in_small_batches, spans, staged, text_buffer

#: Bytes of words are kept, A-Z lower-cased; all others separate.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


@dataclass(frozen=True)
class Params:
    window: int = 13
    per_mille: int = 50  # contaminated from this share of hit words, in thousandths
    block_words: int = 500_000
    segment_bytes: int = 1 << 19
    slice_rows: int = 2_000_000
    cache_words: int = 50_000


def hashed(ws: list[bytes], known: dict, most: int) -> np.ndarray:
    """64-bit hashes of words."""
    import xxhash

    if len(known) > most:
        known.clear()
    for w in set(ws).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws)).view(np.int64)


class Windows:
    """The windows of a block of items: a row for each, with the places of its terms from the rarest to the most common."""

    def __init__(self, items: list[tuple], p: Params):
        self.ids = [k for k, _ in items]
        codes = [hashed(ws, {}, 0) for _, ws in items]
        self.terms = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
        rows, item, size = [], [], []
        for k, own in enumerate(codes):
            n = min(p.window, len(own))
            at = np.searchsorted(self.terms, own)
            for s in range(len(own) - n + 1):
                rows.append(np.append(at[s : s + n], np.full(p.window - n, -1)))
                item.append(k)
                size.append(n)
        self.words = np.array(rows, np.int64).reshape(-1, p.window)  # numbers of terms, -1 beyond the end
        self.item, self.size = np.array(item, np.int64), np.array(size, np.int64)

    def order_by(self, postings: np.ndarray) -> None:
        """``offset``: the places of each window's words from the rarest on; those beyond its end come last."""
        many = np.where(self.words >= 0, postings[self.words], np.iinfo(np.int64).max)
        self.offset = np.argsort(many, axis=1, kind="stable")
        self.word = np.take_along_axis(self.words, self.offset, 1)


def blocks(benchmark: DataFrame, p: Params):
    """Lists of (item_id, words) of at most ``block_words`` words (or one item)."""
    part, size = [], 0
    for r in benchmark.where("item_id is not null").select("item_id", "text").toLocalIterator():
        ws = words(r[1])
        if not ws:
            continue
        if part and size + len(ws) > p.block_words:
            yield part
            part, size = [], 0
        part.append((r[0], ws))
        size += len(ws)
    if part:
        yield part


def index(docs: DataFrame, keep: list[str], p: Params = Params()) -> DataFrame:
    """Segments: segment, each ``keep`` column of its documents (array), n_words (array), terms, starts and positions.

    ``positions[starts[k] : starts[k + 1]]`` are those of ``terms[k]``; a document's words lie one after the other.
    """
    schema = ", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in docs.schema if f.name in keep)

    def run(batches):
        from pyspark import TaskContext

        known: dict = {}
        segment = TaskContext.get().partitionId() << 32
        one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, t))
        for b in batches:
            raw, off = text_buffer(b.column("__text"))
            for i, j in spans(off, p.segment_bytes):
                whole = raw[off[i] : off[j]].tobytes().translate(WORDS)
                found = [whole[off[k] - off[i] : off[k + 1] - off[i]].split() for k in range(i, j)]
                n_words = np.fromiter(map(len, found), np.int64, j - i)
                codes = np.concatenate([hashed(ws, known, p.cache_words) for ws in found])
                at = np.arange(len(codes)) + np.repeat(np.arange(j - i), n_words)
                order = np.argsort(codes, kind="stable")
                codes = codes[order]
                first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
                columns = [one(b.column(c).slice(i, j - i), None) for c in keep]
                yield pa.RecordBatch.from_arrays([pa.array([segment]), *columns, one(n_words, pa.int64()), one(codes[first], pa.int64()), one(np.append(first, len(codes)), pa.int32()), one(at[order], pa.int32())], ["segment", *keep, "n_words", "terms", "starts", "positions"])
                segment += 1

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, f"segment long, {schema}, n_words array<long>, terms array<long>, starts array<int>, positions array<int>")


class Segment:
    """A segment's lists, as a search for the terms of ``windows`` sees them."""

    def __init__(self, row, windows: Windows):
        terms, self.starts = row("terms"), row("starts").astype(np.int64)
        k = np.minimum(np.searchsorted(terms, windows.terms), max(len(terms) - 1, 0))
        self.there = terms[k] == windows.terms if len(terms) else np.zeros(len(k), bool)
        self.place = np.where(self.there, k, -1)  # of each of the windows' terms

    def sizes(self) -> np.ndarray:
        """Postings of each of the windows' terms."""
        out = np.zeros(len(self.place), np.int64)
        out[self.there] = (self.starts[1:] - self.starts[:-1])[self.place[self.there]]
        return out

    def postings(self, row) -> None:
        """All lists as one sorted array: term's place in the segment, then position."""
        at = row("positions").astype(np.int64)
        self.keys = (np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)) << 32) | at
        self.at = at

    def first_lists(self, windows: Windows, p: Params):
        """(window, start) for each posting of the rarest term of each window that the segment may hold, in slices."""
        had = np.append(self.there, True)  # -1 points here
        may = np.flatnonzero(had[windows.words].all(1))
        if not len(may):
            return
        k = self.place[windows.word[may, 0]]
        n = self.starts[k + 1] - self.starts[k]
        cut = 0
        while cut < len(may):
            end = max(cut + 1, int(np.searchsorted(np.cumsum(n[cut:]), p.slice_rows, side="right")) + cut)
            w, m = may[cut:end], n[cut:end]
            which = np.repeat(self.starts[k[cut:end]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            yield np.repeat(w, m), self.at[which]
            cut = end

    def phrases(self, windows: Windows, p: Params):
        """(window, first position) of all exact matches."""
        out = [(np.zeros(0, np.int64),) * 2]
        for w, at in self.first_lists(windows, p):
            start = at - windows.offset[w, 0]
            for r in range(1, windows.word.shape[1]):
                term, offset = windows.word[w, r], windows.offset[w, r]
                key = (self.place[term] << 32) | (start + offset)
                hit = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
                keep = (hit & (start >= 0)) | (term < 0)
                w, start = w[keep], start[keep]
                if not len(w):
                    break
            out.append((w, start))
        return (np.concatenate([x[c] for x in out]) for c in (0, 1))

    def near(self, windows: Windows, p: Params, slop: int):
        """(window, position of its rarest term) where every term of the window has a posting within reach."""
        for w, at in self.first_lists(windows, p):
            reach = windows.size[w] + slop - 1
            for r in range(1, windows.word.shape[1]):
                term = windows.word[w, r]
                low = (self.place[term] << 32) | np.maximum(at - reach, 0)
                found = np.searchsorted(self.keys, low)
                keep = (term < 0) | (self.keys[np.minimum(found, len(self.keys) - 1)] <= ((self.place[term] << 32) | (at + reach))) & (found < len(self.keys))
                w, at, reach = w[keep], at[keep], reach[keep]
                if not len(w):
                    break
            yield from zip(w.tolist(), at.tolist(), strict=True)


def rows_of(b: pa.RecordBatch):
    """For each segment of a batch, a function from a list column's name to its values as an array."""
    values = {c: (b.column(c).offsets.to_numpy(), b.column(c).values.to_numpy()) for c in ("n_words", "terms", "starts", "positions") if c in b.schema.names}
    for r in range(b.num_rows):
        yield r, lambda c, r=r: values[c][1][values[c][0][r] : values[c][0][r + 1]]


def rarest_first(segments: DataFrame, windows: Windows) -> None:
    """Order each window's terms by their postings in the whole corpus."""
    shared = segments.sparkSession.sparkContext.broadcast(windows)

    def run(batches):
        total = np.zeros(len(shared.value.terms), np.int64)
        for b in batches:
            for _, row in rows_of(b):
                total += Segment(row, shared.value).sizes()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    out = np.zeros(len(windows.terms), np.int64)
    for term, n in segments.select("terms", "starts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    shared.unpersist()
    windows.order_by(out)


def search(segments: DataFrame, windows: Windows, keep: list[str], p: Params, every: bool = True) -> DataFrame:
    """Exact phrase matches: segment, number (of the document in it), ``keep``, n_words, spans (array of first and end of hit stretches, in turn), items (array).

    ``every``: documents without a match have a row too.
    """
    shared = segments.sparkSession.sparkContext.broadcast(windows)
    schema = ", ".join(f"`{f.name}` {f.dataType.elementType.simpleString()}" for f in segments.schema if f.name in keep)

    def run(batches):
        windows = shared.value
        names = np.array([str(k) for k in windows.ids], object)
        for b in batches:
            for r, row in rows_of(b):
                n_words = row("n_words")
                base = np.cumsum(n_words + 1) - n_words - 1
                seg = Segment(row, windows)
                seg.postings(row)
                w, start = seg.phrases(windows, p)
                doc = np.searchsorted(base, start, side="right") - 1
                depth = np.zeros(int((n_words + 1).sum()) + 1, np.int64)
                np.add.at(depth, start, 1)
                np.add.at(depth, start + windows.size[w], -1)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], (depth.cumsum() > 0).astype(np.int8), [0]])))
                of = np.searchsorted(base, edge[::2], side="right") - 1
                own = np.unique(np.stack([doc, windows.item[w]], 1), axis=0).reshape(-1, 2)
                show = np.arange(len(n_words)) if every else np.unique(of)
                cut = lambda x: np.append(np.searchsorted(x, show), np.searchsorted(x, show[-1], side="right") if len(show) else 0)
                places = (edge - np.repeat(base[of], 2)).astype(np.int64)
                listed = lambda x, offsets: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), x)
                columns = [b.column(c)[r].values.take(pa.array(show)) for c in keep]
                yield pa.RecordBatch.from_arrays([pa.array([b.column("segment")[r].as_py()] * len(show), pa.int64()), pa.array(show), *columns, pa.array(n_words[show]), listed(pa.array(places), 2 * cut(of)), listed(pa.array(names[own[:, 1]], pa.string()), cut(own[:, 0]))], ["segment", "number", *keep, "n_words", "spans", "items"])

    return segments.mapInArrow(run, f"segment long, number long, {schema}, n_words long, spans array<long>, items array<string>")


@in_small_batches
def proximity(docs: DataFrame, benchmark: DataFrame, p: Params = Params(), slop: int = 2, segments: DataFrame | None = None) -> DataFrame:
    """Matches in any order: (doc_id, item_id, first, end) where all words of a window, with their numbers
    of occurrences, lie within ``window + slop`` consecutive words. The shortest such stretch from each start.

    ``segments`` is an index of ``docs`` that keeps doc_id, if there is one already."""
    segments = staged(index(docs, ["doc_id"], p), "index", options=LONG_ROWS) if segments is None else segments
    kind, parts = docs.schema["doc_id"].dataType.simpleString(), []
    for block in blocks(benchmark, p):
        windows = Windows(block, p)
        rarest_first(segments, windows)
        shared = docs.sparkSession.sparkContext.broadcast(windows)

        def run(batches, shared=shared):
            windows = shared.value
            for b in batches:
                out = {"doc_id": [], "item_id": [], "first": [], "end": []}
                for r, row in rows_of(b):
                    n_words = row("n_words")
                    base = np.cumsum(n_words + 1) - n_words - 1
                    seg = Segment(row, windows)
                    seg.postings(row)
                    found = set()
                    for w, at in seg.near(windows, p, slop):
                        need = Counter(windows.words[w][: windows.size[w]].tolist())
                        most = int(windows.size[w]) + slop
                        d = int(np.searchsorted(base, at, side="right")) - 1
                        lists = []
                        for t in need:  # the postings within reach, in this document
                            k = int(seg.place[t]) << 32
                            low, high = np.searchsorted(seg.keys, [k | max(at - most, int(base[d])), k | min(at + most, int(base[d] + n_words[d]))])
                            lists += [(int(x) & 0xFFFFFFFF, t) for x in seg.keys[low:high]]
                        lists.sort()
                        found.update((d, int(windows.item[w]), a - int(base[d]), e - int(base[d])) for a, e in stretches(lists, need, most) if a <= at < e)
                    ids = b.column("doc_id")[r].values
                    for d, k, a, e in sorted(found):
                        for c, v in zip(out, (ids[d].as_py(), str(windows.ids[k]), a, e), strict=True):
                            out[c].append(v)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(out["doc_id"], b.column("doc_id").type.value_type), "item_id": pa.array(out["item_id"], pa.string()), "first": pa.array(out["first"], pa.int64()), "end": pa.array(out["end"], pa.int64())})

        parts.append(segments.mapInArrow(run, f"doc_id {kind}, item_id string, first long, end long"))
    if not parts:
        return docs.where("false").select("doc_id", F.lit("").alias("item_id"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("end"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.distinct()


def stretches(words: list[tuple[int, int]], need: Counter, most: int):
    """(first, end) of the minimal stretches that hold all of ``need`` within ``most`` words; ``words``: (position, term), in order."""
    missing, have, left, last = sum(need.values()), Counter(), 0, -1
    for at, w in words:
        have[w] += 1
        missing -= have[w] <= need[w]
        while have[words[left][1]] > need[words[left][1]]:
            have[words[left][1]] -= 1
            left += 1
        if not missing and left != last and at - words[left][0] < most:
            last = left  # what ends later from there is longer
            yield words[left][0], at + 1


@in_small_batches
def decontaminate(docs: DataFrame, benchmark: DataFrame, p: Params = Params(), keep: list[str] | None = None, segments: DataFrame | None = None) -> DataFrame:
    """``keep`` columns (doc_id), n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs(doc_id, text)``.

    ``segments`` is an index of ``docs`` that keeps those columns, if there is one already."""
    keep = keep or ["doc_id"]
    segments = staged(index(docs, keep, p), "index", options=LONG_ROWS) if segments is None else segments
    found = []
    for block in blocks(benchmark, p):
        windows = Windows(block, p)
        rarest_first(segments, windows)
        found.append(search(segments, windows, keep, p, every=not found))
    if not found:
        windows = Windows([], p)
        windows.order_by(np.zeros(0, np.int64))
        found.append(search(segments, windows, keep, p))
    out = found[0]
    if len(found) > 1:  # add up the blocks' matches of each document
        for other in found[1:]:
            out = out.unionByName(other)
        flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
        out = out.groupBy("segment", "number").agg(*[F.first(c).alias(c) for c in keep], F.first("n_words").alias("n_words"), flat("spans"), flat("items"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)

    def judge(batches):
        for b in batches:
            hit, n_items, digest = [], [], []
            for n, s, i in zip(b.column("n_words").to_pylist(), b.column("spans"), b.column("items"), strict=True):
                edge = s.values.to_numpy()
                if len(edge):
                    depth = np.zeros(n + 1, np.int64)
                    np.add.at(depth, edge[::2], 1)
                    np.add.at(depth, edge[1::2], -1)
                    hit.append(int((depth.cumsum()[:n] > 0).sum()))
                else:
                    hit.append(0)
                own = sorted(set(i.as_py()))
                n_items.append(len(own))
                digest.append(hashlib.sha256(",".join(own).encode()).hexdigest())
            bad = [h > 0 and 1000 * h >= p.per_mille * n for h, n in zip(hit, b.column("n_words").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in [*keep, "n_words"]], pa.array(hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array(bad, pa.bool_())], [*keep, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return out.select(*keep, "n_words", "spans", "items").mapInArrow(judge, f"{schema}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
