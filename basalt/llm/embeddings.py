"""Embedding near-dedup: spherical k-means cells and blocked cosine products.

1. Equal vectors are one class; its smallest vec_id stands for it and its size is a weight.
2. Spherical k-means is fitted on a bounded sample (``sample`` vectors of each length, at most
   ``most_cells`` centres); every vector is assigned.
3. A vector's home is its nearest centre. It also visits each cell whose bisecting hyperplane with
   its home is near. The distances of two linked vectors to the hyperplane between their homes add up to
   at most their chord, so within half the chord of ``cosine`` one of them always visits the other's home.
   That margin holds whatever the number of vectors or cells, so every link is found. A link is counted for a
   member in its home, and for a visitor where it meets a member that does not visit the visitor's home: both
   ends count a link, or neither. With ``reach`` = None the margin is the whole angle, and each link is seen from
   both homes; that is exact, too. ``deviations`` is for who would rather lose some links: a difference of near
   copies lies along the normal between two far centres by chance only, with a deviation of the chord over
   the root of the number of directions in which the sample varies. Between centres that are ``near`` or farther
   apart, if there are more than ``few_cells``, the margin is then half of ``deviations`` such deviations, if that is less.
4. Members of a cell and its visitors are dealt to blocks, and each pair of (members, all) blocks
   is one matrix product in double precision. A block pair reports counts and one label for each
   vector, never its pairs.
5. Components of those labels give the groups; the smallest vec_id of each is kept.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing. Vectors of different lengths do not link. Repeated rows (ties) link with each other. An
empty table gives an empty result. Other columns (labels too), whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_buffer
from .components import components


@dataclass(frozen=True)
class Params:
    cosine: float = 0.95
    reach: float | None = 0.5  # share of the chord within which cells are visited, at least a half; None: the whole angle
    deviations: float | None = None  # of a difference's part along a normal, between far centres; None: all links are found
    near: float = 1.2  # with deviations: distance of centres up to which ``reach`` holds
    few_cells: int = 0  # with deviations: up to which it holds everywhere
    per_cell: int = 128  # vectors aimed at in a cell
    most_cells: int = 8192
    sample: int = 131072
    sample_values: int = 1 << 24  # components of the sample's vectors
    rounds: int = 6
    row_block: int = 1024
    column_block: int = 4096
    slack: float = 1e-7


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(-1, keepdims=True)  # else squares may overflow or vanish
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def matrix(raw: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Unit vectors in double precision from ``size`` components each, as little-endian floats or doubles."""
    data = text_buffer(raw)[0]
    return unit(data.view("<f4" if len(data) == 4 * size * len(raw) else "<f8").reshape(-1, size).astype(np.float64))


def classified(vectors: DataFrame) -> DataFrame:
    """vec_id, size (0: links with nothing), same (digest), raw (components as bytes) of each row."""
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"

    def run(batches):
        for b in batches:
            col = b.column("embedding")
            offsets, values = col.offsets.to_numpy().astype(np.int64), col.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
            length = np.where(col.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
            size, same, raw = np.zeros(len(col), np.int32), np.full(len(col), None, object), np.full(len(col), None, object)
            for n in np.unique(length[length > 0]):
                rows = np.flatnonzero(length == n)
                x = values[offsets[rows][:, None] + np.arange(n)]
                ok = np.isfinite(x).all(1) & (x != 0).any(1)
                out = (x[ok] + 0.0).astype("<f4" if single else "<f8")  # -0.0 becomes 0.0
                size[rows[ok]] = n
                for r, v in zip(rows[ok], out, strict=True):
                    raw[r] = v.tobytes()
                    same[r] = hashlib.blake2b(raw[r], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(size), pa.array(same, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "size", "same", "raw"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, size int, same binary, raw binary")


def spherical_kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = np.concatenate([(x[s : s + 8192] @ centres.T).argmax(1) for s in range(0, len(x), 8192)])
        order = np.argsort(at, kind="stable")
        own, first = np.unique(at[order], return_index=True)
        total = np.add.reduceat(x[order], first)
        norm = np.linalg.norm(total, axis=1)
        centres[own[norm > 0]] = total[norm > 0] / norm[norm > 0][:, None]
    return centres


def centres(classes: DataFrame, p: Params) -> dict[int, tuple[np.ndarray, float]]:
    """For each length of vectors, from a bounded sample: centres, and in how many directions the sample varies."""
    out = {}
    for size, n in classes.groupBy("size").count().collect():
        k = min(max(1, n // p.per_cell), p.most_cells)
        rows = classes.where(F.col("size") == size).orderBy(F.xxhash64("rep"), "rep").limit(min(p.sample, 32 * k, max(1, p.sample_values // size))).select("raw").toArrow()
        x = matrix(rows.column("raw"), size)
        spread = x - x.mean(0)
        share = np.square(np.linalg.svd(spread.T @ spread, compute_uv=False)) if size <= 4096 else np.ones(1)
        of = np.trace(spread.T @ spread) ** 2 / max(share.sum(), 1e-300) if size <= 4096 else 1.0
        out[size] = spherical_kmeans(x, min(k, len(x)), p.rounds), max(1.0, float(of))
    return out


def margins(gap: np.ndarray, wide: float, p: Params) -> np.ndarray:
    """How far from the hyperplane between two centres, ``gap`` apart, a vector visits the other's cell (times the gap)."""
    if p.reach is None:  # as wide as the sine: reaches all linked vectors
        return np.sqrt(1 - p.cosine**2) * gap
    chord = np.sqrt(2 - 2 * p.cosine)
    close = max(0.5, p.reach) * chord
    if p.deviations is None or gap.shape[-1] <= p.few_cells:
        return close * gap
    return np.where(gap < p.near, close, min(close, p.deviations / 2 / np.sqrt(wide) * chord)) * gap


def cells(classes: DataFrame, p: Params) -> DataFrame:
    """rep, weight, raw, size, cell, own, visits: a row for the home of each vector and for each cell it visits.

    own is the cell of its home; visits has all its cells, in the row of its home only.
    """
    shared = classes.sparkSession.sparkContext.broadcast(centres(classes, p))

    def run(batches):
        gaps = lambda c, some: np.sqrt(np.maximum(2 - 2 * some @ c.T, 0))
        apart = {size: margins(gaps(c, c), wide, p) if len(c) <= 1024 else None for size, (c, wide) in shared.value.items()}
        for b in batches:
            sizes = b.column("size").to_numpy()
            at, cell, own, home, each = [], [], [], [], []
            for size in np.unique(sizes):
                (c, wide), known = shared.value[int(size)], apart[int(size)]
                every = np.flatnonzero(sizes == size)
                step = max(1, 4_000_000 // len(c))
                for rows in (every[s : s + step] for s in range(0, len(every), step)):
                    x = matrix(b.column("raw").take(pa.array(rows)), int(size))
                    dot = x @ c.T
                    near = dot.argmax(1)
                    margin = known[near] if known is not None else margins(gaps(c, c[near]), wide, p)
                    visited = dot[np.arange(len(x)), near][:, None] - dot <= margin + p.slack
                    visited[np.arange(len(x)), near] = True
                    r, v = np.nonzero(visited)
                    at.append(rows[r])
                    cell.append(v)
                    own.append(near[r])
                    home.append(near[r] == v)
                    each.append(visited.sum(1))
            if not at:
                continue
            at, cell, own, home, each = (np.concatenate(x) for x in (at, cell, own, home, each))
            took = b.select(["rep", "weight", "raw", "size"]).take(pa.array(at))
            # all cells of a vector follow one another: the row of its home has them as a list, the others have an empty one
            length = np.zeros(len(at), np.int64)
            length[home] = each
            order = np.argsort(np.where(home, 0, 1), kind="stable")  # rows of homes first, in the order of their lists
            visits = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length[order])), pa.int32()), pa.array(cell, pa.int32()))
            columns = [*took.columns, pa.array(cell, pa.int32()), pa.array(own, pa.int32())]
            yield pa.RecordBatch.from_arrays([*[x.take(pa.array(order)) for x in columns], visits], ["rep", "weight", "raw", "size", "cell", "own", "visits"])

    kind = classes.schema["rep"].dataType.simpleString()
    return classes.select("rep", "weight", "raw", "size").mapInArrow(run, f"rep {kind}, weight long, raw binary, size int, cell int, own int, visits array<int>")


def labelled(mask: np.ndarray, low: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least label that each row and column reaches through the links of one block."""
    a, b = low.copy(), other.copy()
    linked_a, linked_b = mask.any(1), mask.any(0)
    top = np.iinfo(np.int64).max
    while True:
        b2 = np.where(linked_b, np.minimum(b, np.where(mask, a[:, None], top).min(0)), b)
        a2 = np.where(linked_a, np.minimum(a, np.where(mask, b2[None, :], top).min(1)), a)
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


def products(placed: DataFrame, p: Params) -> DataFrame:
    """rep, n, label: for each block pair, the weight of the links of each member, or of a visitor that only this cell counts, and the label of each linked vector."""
    sized = placed.groupBy("size", "cell").agg(F.count(F.lit(1)).alias("everyone"), F.count_if(F.col("cell") == F.col("own")).alias("members"))
    sized = sized.select("size", "cell", F.greatest(F.lit(1), F.ceil(F.col("members") / p.row_block)).cast("int").alias("rows"), F.greatest(F.lit(1), F.ceil(F.col("everyone") / p.column_block)).cast("int").alias("columns"))
    sized = staged(sized, "sizes")
    dealt = placed.join(sized, ["size", "cell"])
    as_row = dealt.where("cell = own").select("*", F.pmod(F.xxhash64("rep"), F.col("rows")).cast("int").alias("i"), F.explode(F.expr("sequence(0, columns - 1)")).alias("j"), F.lit(True).alias("is_row"))
    as_column = dealt.withColumn("visits", F.lit(None).cast("array<int>")).select("*", F.explode(F.expr("sequence(0, rows - 1)")).alias("i"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("columns")).cast("int").alias("j"), F.lit(False).alias("is_row"))
    key = ["size", "cell", "i", "j"]
    every = as_row.unionByName(as_column).select(*key, "is_row", "rep", "weight", "raw", "own", "visits").repartition(*key).sortWithinPartitions(*key)
    kind = placed.schema["rep"].dataType.simpleString()

    def group(table: pa.Table) -> pa.RecordBatch:
        is_row = table.column("is_row").to_numpy()
        mine, all_ = table.filter(pa.array(is_row)).combine_chunks(), table.filter(pa.array(~is_row)).combine_chunks()
        found = [np.zeros(0, np.int64)] * 3
        if mine.num_rows and all_.num_rows:
            size = table.column("size")[0].as_py()
            x, y = (matrix(t.column("raw"), size) for t in (mine, all_))
            a, b, wa, wb = (t.column(c).to_numpy().astype(np.int64) for c in ("rep", "weight") for t in (mine, all_))
            mask = (x @ y.T >= p.cosine) & (a[:, None] != b[None, :])
            # links that a visitor cannot count in its own home, where this member does not come
            homes, which = np.unique(all_.column("own").to_numpy(), return_inverse=True)
            visits = mine.column("visits").combine_chunks()
            visits = visits.chunk(0) if isinstance(visits, pa.ChunkedArray) else visits
            cell, of = visits.flatten().to_numpy(), np.repeat(np.arange(len(a)), np.diff(visits.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(homes, cell), len(homes) - 1)
            comes = np.zeros((len(a), len(homes)), bool)
            comes[of[homes[at] == cell], at[homes[at] == cell]] = True
            weight, credit = mask @ wb, wa @ (mask & ~comes[:, which])
            la, lb = labelled(mask, a, b)
            i, j = np.flatnonzero(mask.any(1)), np.flatnonzero((credit > 0) | (lb != b))
            found = [np.concatenate(x) for x in ((a[i], b[j]), (weight[i], credit[j]), (la[i], lb[j]))]
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in found], ["rep", "n", "label"])

    def run(batches):
        now, parts = None, []
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in key], 1)
            edge = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for i, j in zip(np.append(0, edge), np.append(edge, len(keys)), strict=True):
                this = tuple(keys[i].tolist())
                if parts and this != now:
                    yield group(pa.Table.from_batches(parts))
                    parts = []
                now = this
                parts.append(b.slice(i, j - i))
        if parts:
            yield group(pa.Table.from_batches(parts))

    return every.mapInArrow(run, "rep long, n long, label long").select(F.col("rep").cast(kind).alias("rep"), "n", F.col("label").cast(kind).alias("label"))


def near_duplicates(vectors: DataFrame, p: Params = Params()) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of ``vectors(vec_id, embedding)``; vec_id is an integer."""
    rows = staged(classified(vectors), "vectors")
    # written first, so that Spark can split a large class in the join with its smallest member
    stands = staged(rows.where("same is not null and vec_id is not null").groupBy("same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "stands")
    members = staged(rows.select("vec_id", "same").join(stands, "same", "left").select("vec_id", F.coalesce("rep", "vec_id").alias("rep"), F.when(F.col("vec_id").isNotNull(), F.coalesce(F.col("weight"), F.lit(1)) - 1).otherwise(0).alias("copies")), "members")
    classes = staged(rows.where("same is not null").withColumn("rep", F.col("vec_id")).join(stands, ["same", "rep"]).dropDuplicates(["same", "rep"]).select("rep", "weight", "raw", "size"), "classes")
    found = staged(products(cells(classes, p), p), "products")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    linked = components(found.select(F.col("rep").alias("a"), F.col("label").alias("b")))
    out = members.join(counts, "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.select("vec_id", (F.col("copies") + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
