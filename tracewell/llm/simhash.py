"""SimHash near-dedup: fingerprints of word shingles, linked through sharded vantage-point trees.

Of two fingerprints within RADIUS bits, one 32-bit half differs by no more than RADIUS // 2. Each half has a tree of its
own. The inner nodes hold a vantage point and a radius; leaves are shards. The shape comes from a sample of fingerprints
in proportion to the shards, which only balances them. Every distinct fingerprint is a member of one shard of each tree.
If its ball of RADIUS // 2 crosses the boundary of a node, it is also sent as a query to the shards on the far side, as
far as the triangle inequality lets them hold a neighbour, so every pair in reach meets in a shard and the links found are
exact. A shard is searched by the same rule over all 64 bits, recursively. It returns a spanning forest of its links, not
all pairs, so a dense group of fingerprints gives as many rows as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import connected_components, written

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Members a shard should have, the least and most shards of a tree, and fingerprints sampled for a shard.
SHARD_MEMBERS = 4096
LEAST_SHARDS = 32
MOST_SHARDS = 1 << 15
SAMPLED = 16
LOW = np.uint64(0xFFFFFFFF)
#: Pairs that are compared at once, and pairs held before they are reduced to a forest.
BLOCK = 1 << 18
HELD = 1 << 20


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the shingle hashes, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        hashes = [xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :])]  # noqa: B905
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[at : at + (1 << 15)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row's whole text as a signed long; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                offsets, raw = tk.buffers(part.column("text"))
                data, at = raw.tobytes(), offsets.tolist()
                values = np.array([fingerprint(data[a:b]) for a, b in zip(at, at[1:])], dtype=np.uint64)  # noqa: B905
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(values.view(np.int64))], names=["id", "fp"])

    return documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _distance(fps: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ to)


def grow(sample: np.ndarray, most: int = SAMPLED) -> list[tuple]:
    """Nodes (vantage point, radius, inner, outer), or (None, shard, 0, 0) for leaves of at most most samples; node 0 is the root; shards count up from inner to outer."""
    nodes: list[tuple] = []
    shards = 0

    def add(fps: np.ndarray) -> int:
        nonlocal shards
        me = len(nodes)
        nodes.append(())
        if len(fps) > most:
            point = fps[0]
            d = _distance(fps, point)
            upto = np.cumsum(np.bincount(d))
            # the distance that cuts nearest to the middle
            radius = int(np.argmin(np.abs(2 * upto - len(fps))))
            if radius < d.max():
                inner = add(fps[d <= radius])
                outer = add(fps[d > radius])
                nodes[me] = (point, radius, inner, outer)
                return me
        nodes[me] = (None, shards, 0, 0)
        shards += 1
        return me

    add(sample)
    return nodes


def halves(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return fps >> np.uint64(32), fps & LOW


def route(nodes: list[tuple], fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, indices, member flags): the shard of every fingerprint, and later shards that may hold neighbours of it."""
    stack = [(0, np.arange(len(fps)), np.ones(len(fps), bool))]
    while stack:
        node, at, member = stack.pop()
        point, border, inner, outer = nodes[node]
        if point is None:
            if len(at):
                yield border, at, member
            continue
        d = _distance(fps[at], point).astype(np.int16)
        near = d <= border
        # members live on one side; an inner one also asks the outer side, never the other way round
        to_inner = np.where(member, near, d <= border + radius)
        to_outer = d > border - radius
        stack.append((inner, at[to_inner], member[to_inner]))
        stack.append((outer, at[to_outer], (member & ~near)[to_outer]))


def near_pairs(members: np.ndarray, queries: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within RADIUS: among members, and of queries with members; by recursive vantage points."""
    stack = [(members, queries, 0)]
    while stack:
        m, q, level = stack.pop()
        if not len(m) or len(m) + len(q) < 2:
            continue
        if len(m) * (len(m) + len(q)) > BLOCK // 4 and level < 40:
            point = fps[m[level % len(m)]]
            dm, dq = _distance(fps[m], point).astype(np.int16), _distance(fps[q], point).astype(np.int16)
            radius = int(np.partition(dm, (len(dm) - 1) // 2)[(len(dm) - 1) // 2])
            near = dm <= radius
            if near.any() and not near.all():
                stack.append((m[near], q[dq <= radius + RADIUS], level + 1))
                stack.append((m[~near], np.concatenate([m[near & (dm > radius - RADIUS)], q[dq > radius - RADIUS]]), level + 1))
                continue
        step = max(1, BLOCK // len(m))
        for at in range(0, len(m), step):
            hit = np.bitwise_count(fps[m[at : at + step], None] ^ fps[m][None, :]) <= RADIUS
            a, b = np.nonzero(hit)
            keep = a + at < b
            yield m[a[keep] + at], m[b[keep]]
        for at in range(0, len(q), step):
            a, b = np.nonzero(np.bitwise_count(fps[q[at : at + step], None] ^ fps[m][None, :]) <= RADIUS)
            yield q[a + at], m[b]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (index, smallest index of its component) that connect what the edges a-b connect."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def links(classes: DataFrame) -> DataFrame:
    """Edges (src, dst) between the ids of classes (fp, id; both distinct) that connect all fingerprints within RADIUS."""
    n = classes.count()
    shards = min(MOST_SHARDS, max(LEAST_SHARDS, n // SHARD_MEMBERS))
    sample = np.array([r[0] for r in classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLED * shards).collect()], dtype=np.int64).view(np.uint64)
    trees = [grow(half) for half in halves(sample)]
    reach = RADIUS // 2

    def deal(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for tree, (nodes, half) in enumerate(zip(trees, halves(fps), strict=True)):
                for shard, at, member in route(nodes, half, reach):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), 2 * shard + tree, np.int32)), batch.column("fp").take(pa.array(at)), batch.column("id").take(pa.array(at)), pa.array(member)], names=["shard", "fp", "id", "member"])

    def search(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("fp").to_numpy(), kind="stable")
        fps, ids, member = (table.column(c).to_numpy()[order] for c in ("fp", "id", "member"))
        fps = fps.view(np.uint64)
        held_a, held_b, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for a, b in near_pairs(np.flatnonzero(member), np.flatnonzero(~member), fps):
            held_a.append(a)
            held_b.append(b)
            held += len(a)
            if held > HELD:
                a, b = forest(np.concatenate(held_a), np.concatenate(held_b), len(fps))
                held_a, held_b, held = [a], [b], len(a)
        a, b = forest(np.concatenate(held_a), np.concatenate(held_b), len(fps))
        return pa.table({"src": pa.array(ids[a], pa.int64()), "dst": pa.array(ids[b], pa.int64())})

    dealt = classes.select("fp", "id").mapInArrow(deal, "shard int, fp long, id long, member boolean")
    return dealt.groupBy("shard").applyInArrow(search, "src long, dst long")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id) of every row; documents link at RADIUS or fewer differing bits.

    component_id is the smallest id reachable, itself included. Null, empty and wordless texts share fingerprint zero and
    link like any others. Repeated ids and rows keep their rows. A row with a null id links like any other, and others
    through it; component_id is null only where all rows of the component have null ids. Other columns do not matter,
    whatever their names. An empty table gives an empty result.
    """
    prints = written(fingerprints(documents, id_col, text_col), "fingerprints")
    # fingerprints are the nodes, so those without an id link too
    classes = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    found = connected_components(links(classes.select("fp", F.col("fp").alias("id"))))
    labelled = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    labelled = written(labelled, "labelled")
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    out = prints.join(labelled.select("fp", "component").join(least, "component").drop("component"), "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
