"""Embedding near-dedup: an epsilon grid order join.

Unit vectors within the distance epsilon = sqrt(2 - 2 * threshold) link. Vectors are sorted by their grid cells (of side
epsilon) on the leading principal dimensions and packed into blocks of BLOCK rows. The sequence is cut into intervals by
position, so how many there are does not depend on the partitions. Intervals whose bounding boxes in the principal
dimensions are provably farther apart than epsilon are skipped; each other pair of intervals is one group, which holds
the blocks of both and joins them recursively by halves under the same test. A group is bounded by two intervals.

Equal vectors are one class with a count, so copies are never paired. Single precision rules out most pairs; pairs within
its error of the threshold are decided in double precision. A group returns the number of links of each class and edges
that connect what its links connect, found on the tile of hits where it is dense; pairs are never emitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, written

THRESHOLD = 0.9
GRID_DIMS = 8
#: Principal dimensions of bounding boxes.
BOX_DIMS = 16
BLOCK = 1024
LEAF = 256
#: An interval has a fifth of all rows, but no fewer and no more than these, and no more bytes of vectors.
LEAST_INTERVAL = 2048
MOST_INTERVAL = 65_536
INTERVAL_BYTES = 32 << 20
#: Edges that a group holds before it reduces them.
HELD = 500_000
#: Slack of box distances for rounding.
SLACK = 1e-6


def _usable(x):
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))) & F.exists(x, lambda v: v != 0), F.lit(False))


def _units(vectors: np.ndarray) -> np.ndarray:
    """Rows in double precision and of length one; scaled first, so that no square overflows or vanishes."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True) if len(x) else 1.0
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _boxes_meet(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    return float(gap @ gap) <= (eps + SLACK) ** 2


def join_sequences(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """Tiles (first row, first column, hits) of unit vectors a, b with dot product >= threshold; pa_, pb are their principal coordinates.

    same: a is b, and each pair comes once. Only tiles with hits are given.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * threshold))
    fa, fb = a.astype(np.float32), b.astype(np.float32)
    error = (a.shape[1] + 16) * 1.2e-7
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, j, k, m = stack.pop()
        if j <= i or m <= k or same and m <= i:
            continue
        if not _boxes_meet(pa_[i:j], pb[k:m], eps):
            continue
        if max(j - i, m - k) > LEAF:
            x, y = (i + j + 1) // 2, (k + m + 1) // 2
            stack += [(i, x, k, y), (x, j, k, y), (i, x, y, m), (x, j, y, m)]
            continue
        dots = fa[i:j] @ fb[k:m].T
        if dots.max() < threshold - error:
            continue
        hits = dots >= threshold
        r, c = np.nonzero(np.abs(dots - threshold) <= error)
        hits[r, c] = np.einsum("ij,ij->i", a[r + i], b[c + k]) >= threshold
        if same and k < j:
            hits &= np.arange(i, j)[:, None] < np.arange(k, m)[None, :]
        if hits.any():
            yield i, k, hits


def tile_edges(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, columns, columns): edges row-column and column-column that connect what the hits connect."""
    none = np.zeros(0, np.int64)
    if np.count_nonzero(hits) <= 4 * sum(hits.shape):
        return (*np.nonzero(hits), none, none)
    far = hits.shape[1]
    label = np.arange(far)
    while True:
        by_row = np.where(hits, label, far).min(axis=1)
        new = np.minimum(label, np.where(hits, by_row[:, None], far).min(axis=0))
        if (new == label).all():
            break
        label = new
    r = np.flatnonzero(by_row < far)
    c = np.flatnonzero(label != np.arange(far))
    return r, by_row[r], c, label[c]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its component) connecting what the id pairs connect."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def joined(ids_a: np.ndarray, n_a: np.ndarray, a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links, low) of the classes with links: how many vectors they link to, and the smallest id of the component here."""
    links_a, links_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    src, dst, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for i, k, hits in join_sequences(a, b, a @ axes, b @ axes, threshold, same):
        j, m = i + hits.shape[0], k + hits.shape[1]
        links_a[i:j] += hits @ n_b[k:m]
        links_b[k:m] += n_a[i:j] @ hits
        r, c, c2, c3 = tile_edges(hits)
        src += [ids_a[r + i], ids_b[c2 + k]]
        dst += [ids_b[c + k], ids_b[c3 + k]]
        held += len(r) + len(c2)
        if held > HELD:
            node, low = _forest(np.concatenate(src), np.concatenate(dst))
            src, dst, held = [node], [low], 0
    ids, at = np.unique(np.concatenate([ids_a, ids_b]), return_inverse=True)
    total = np.zeros(len(ids), np.int64)
    np.add.at(total, at, np.concatenate([links_a, links_b]))
    node, low = _forest(np.concatenate(src), np.concatenate(dst))
    some = total > 0
    return ids[some], total[some], low[np.searchsorted(node, ids[some])] if some.any() else ids[:0]


def principal_axes(classes: DataFrame, size: int) -> np.ndarray:
    """The BOX_DIMS leading eigenvectors, as columns, of the covariance of all unit vectors of classes.

    Each task adds up one size x size matrix; its rows are summed over the tasks, and size rows reach the driver.
    """

    def sums(batches: Iterator[pa.RecordBatch]):
        gram = np.zeros((size + 1, size + 1))
        for batch in batches:
            u = _units(_matrix(batch.column("embedding"), size))
            u = np.hstack([u, np.ones((len(u), 1))])
            gram += u.T @ u
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(size + 1), pa.int32()), "row": [r.tobytes() for r in gram]})

    def total(table: pa.Table) -> pa.Table:
        row = sum(np.frombuffer(x, np.float64) for x in table.column("row").to_pylist())
        return pa.table({"at": table.column("at")[:1], "row": pa.array([row.tobytes()], pa.binary())})

    found = classes.select("embedding").mapInArrow(sums, "at int, row binary").groupBy("at").applyInArrow(total, "at int, row binary").collect()
    gram = np.stack([np.frombuffer(r["row"], np.float64) for r in sorted(found, key=lambda r: r["at"])])
    mean = gram[size, :size] / gram[size, size]
    values, vectors = np.linalg.eigh(gram[:size, :size] / gram[size, size] - np.outer(mean, mean))
    return np.ascontiguousarray(vectors[:, np.argsort(-values)[:BOX_DIMS]])


def _blocks(classes: DataFrame, axes: np.ndarray, eps: float, interval: int) -> DataFrame:
    """Packed blocks (interval, place, lo, hi, ids, counts, vectors) of classes (id, n, embedding) in grid order."""
    size, dims = axes.shape[0], min(GRID_DIMS, axes.shape[1])
    wide = classes.schema["embedding"].dataType.elementType.typeName() == "double"
    real, most = np.float64 if wide else np.float32, BLOCK

    def project(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = _matrix(batch.column("embedding"), size)
            cells = np.floor(_units(x) @ axes[:, :dims] / eps).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * (size * x.itemsize)), pa.py_buffer(np.ascontiguousarray(x).tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), raw, *(pa.array(cells[:, k]) for k in range(dims))], names=["id", "n", "vector", *(f"c{k}" for k in range(dims))])

    def cut(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        part, seq, rest = TaskContext.get().partitionId(), 0, None

        def block(rows: pa.Table):
            raw = b"".join(rows.column("vector").to_pylist())
            p = _units(np.frombuffer(raw, real).reshape(-1, size)) @ axes
            made = {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int64()), "rows": pa.array([rows.num_rows], pa.int64()), "lo": [p.min(0).tolist()], "hi": [p.max(0).tolist()]}
            return pa.RecordBatch.from_pydict(made | {"ids": [rows.column("id").to_numpy().tobytes()], "counts": [rows.column("n").to_numpy().tobytes()], "vectors": [raw]})

        for batch in batches:
            got = pa.Table.from_batches([batch])
            rest = got if rest is None else pa.concat_tables([rest, got])
            while rest.num_rows >= most:
                yield block(rest.slice(0, most))
                rest, seq = rest.slice(most), seq + 1
        if rest is not None and rest.num_rows:
            yield block(rest)

    names = [f"c{k}" for k in range(dims)]
    cells = classes.select("id", "n", F.col("embedding").cast("array<double>" if wide else "array<float>").alias("embedding"))
    cells = cells.mapInArrow(project, "id long, n long, vector binary, " + ", ".join(f"{c} int" for c in names))
    sorted_ = cells.repartitionByRange(*names, "id").sortWithinPartitions(*names, "id").select("id", "n", "vector")
    blocks = written(sorted_.mapInArrow(cut, "part int, seq long, rows long, lo array<double>, hi array<double>, ids binary, counts binary, vectors binary"), "blocks")
    # one row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = blocks.groupBy("part").agg(F.sum("rows").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("ahead"))
    place = F.col("ahead") + F.col("seq") * most
    return blocks.join(F.broadcast(ahead), "part").select(F.floor(place / interval).alias("interval"), place.alias("place"), "lo", "hi", "ids", "counts", "vectors")


def _interval_pairs(blocks: DataFrame, eps: float, dims: int) -> DataFrame:
    """Interval pairs (i, j), i <= j, whose boxes are within eps; they meet in a cell of the first dimension."""
    box = [F.array(*(f(F.col(c)[k]) for k in range(dims))).alias(c) for c, f in (("lo", F.min), ("hi", F.max))]
    wide = written(blocks.groupBy("interval").agg(*box), "boxes")

    def near(a: str, b: str):
        gap = F.zip_with(F.zip_with(f"{a}.lo", f"{b}.hi", lambda x, y: x - y), F.zip_with(f"{b}.lo", f"{a}.hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
        return F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= (eps + SLACK) ** 2

    cell = lambda v: F.floor(v / eps).cast("long")
    left = wide.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")[0]), cell(F.col("hi")[0])))).alias("l")
    right = wide.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")[0]) - 1, cell(F.col("hi")[0]) + 1))).alias("r")
    pairs = left.join(right, (F.col("l.cell") == F.col("r.cell")) & (F.col("l.interval") <= F.col("r.interval")) & near("l", "r"))
    return pairs.select(F.col("l.interval").alias("i"), F.col("r.interval").alias("j")).distinct()


def _linked(classes: DataFrame, size: int, rows: int, threshold: float) -> DataFrame:
    """(id, links, low) of classes (id, n, embedding) of one length: linked vectors, and a smaller or equal id of the same component."""
    eps = math.sqrt(max(1e-9, 2 - 2 * threshold))
    axes = principal_axes(classes, size)
    wide = classes.schema["embedding"].dataType.elementType.typeName() == "double"
    real = np.float64 if wide else np.float32
    fits = max(BLOCK, INTERVAL_BYTES // (size * np.dtype(real).itemsize))
    interval = min(fits, MOST_INTERVAL, max(LEAST_INTERVAL, -(-rows // 5)))

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        side = np.array(table.column("interval").to_pylist())

        def of(number: int):
            at = table.filter(pa.array(side == number))
            read = lambda c, t: np.frombuffer(b"".join(at.column(c).to_pylist()), t)
            return read("ids", np.int64), read("counts", np.int64), _units(read("vectors", real).reshape(-1, size))

        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        a = of(i)
        ids, links, low = joined(*a, *(a if i == j else of(j)), axes, threshold, i == j)
        return pa.table({"id": pa.array(ids, pa.int64()), "links": pa.array(links, pa.int64()), "low": pa.array(low, pa.int64())})

    blocks = _blocks(classes, axes, eps, interval)
    pairs = _interval_pairs(blocks, eps, axes.shape[1])
    asked = pairs.select(F.explode(F.array_distinct(F.array("i", "j"))).alias("interval"), "i", "j")
    sent = blocks.select("interval", "place", "ids", "counts", "vectors").join(asked, "interval")
    return sent.groupBy("i", "j").applyInArrow(search, "id long, links long, low long")


def near_duplicates(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row: vectors link at cosine >= threshold in double precision.

    Null, empty and zero vectors and those with null or non-finite components link with nothing and are kept; so do
    rows with a null id (component null). Vectors of different lengths do not link; each length is joined by itself (one
    round of jobs each). Repeated rows are vectors of their own that link with each other. Labels and other columns do not
    matter, whatever their names. An empty table gives an empty result.
    """
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"))
    rows = rows.withColumn("usable", _usable(F.col("embedding")) & F.col("id").isNotNull())
    # 128 bits of hash stand for the vector
    keyed = rows.withColumn("k1", F.when(F.col("usable"), F.xxhash64("embedding"))).withColumn("k2", F.when(F.col("usable"), F.xxhash64(F.lit(1), "embedding")))
    classes = written(keyed.where("usable").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("embedding").alias("embedding")), "classes")
    lengths = classes.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("rows")).orderBy("size").collect()
    if not lengths:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    linked = None
    for size, n in lengths:
        part = _linked(classes.where(F.size("embedding") == size).select("id", "n", "embedding"), size, n, threshold)
        linked = part if linked is None else linked.unionByName(part)
    linked = written(linked, "links")
    links = linked.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(linked.select(F.col("id").alias("src"), F.col("low").alias("dst")))
    classes = classes.select("k1", "k2", "id", "n").join(links, "id", "left").join(components.withColumnRenamed("node", "id"), "id", "left")
    classes = classes.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = keyed.select("id", "k1", "k2").join(classes, ["k1", "k2"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
