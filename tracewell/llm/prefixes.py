"""Conversation prefix trie: nodes of equal turn sequences, rolled up to all ancestors by pointer jumping.

A prefix is named by the exclusive or of 128-bit hashes of its turns, each tagged with its place. So the name of a prefix
comes from its turns in any order of adding up, and its parent's name from its own and its last turn's: the edges need no
join. Nodes are groups of equal names, aggregated before they are shuffled.

Only nodes that two or more conversations share are rolled up: below a node of one conversation there is one leaf and
nothing is saved. In round k every node points to its ancestor 2**k above and holds the sums over its descendants less than
2**k below; it adds its sums to that ancestor's and takes the ancestor's pointer, so the rounds are the logarithm of the
greatest shared depth.

Texts are never shuffled, only MD5 digests. A conversation may hold any share of the rows: ranks come from ranges of the
sorted rows, names from blocks of BLOCK turns. Rows whose key is hot are joined by broadcasting the at most HOT keys that
have over a HOT-th of the rows each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK = 4096
HOT = 1000
#: Members whose ids are joined into one text before the texts of a node are hashed in order.
PART = 1 << 16


def looked_up(rows: DataFrame, found: DataFrame, key: list[str], weight: str) -> DataFrame:
    """rows left-joined with found (one row per key, weight: how many rows have it); hot keys, HOT at most, are broadcast."""
    total = found.agg(F.sum(weight)).first()[0] or 0
    hot, found = found.where(F.col(weight) * HOT > total).drop(weight), found.drop(weight)
    cold = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(found, key, "left")
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def ranked(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((conv_id, i, role, digest, bytes) of every turn, written; (conv_id, n_turns) of every conversation).

    i counts the turns of a conversation from 0 by turn (null first), ties by role and by MD5 of the text. Null roles and
    texts are empty. Rows without a conversation id belong to none and are left out.
    """

    def number(batches: Iterator[pa.RecordBatch]):
        part, last, before = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column("conv_id").to_numpy()
            if not len(conv):
                continue
            first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            k = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv))))
            if conv[0] == last:
                k[: first[1] if len(first) > 1 else len(k)] += before
            last, before = conv[-1], int(k[-1]) + 1
            columns = [batch.column(c) for c in ("conv_id", "role", "digest", "bytes")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(k), part, np.int32)), pa.array(k)], names=["conv_id", "role", "digest", "bytes", "part", "k"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    # numbers of rows tell equal rows apart, so that a range never has to hold all of them
    thin = thin.where("conv_id is not null").withColumn("row", F.monotonically_increasing_id())
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("row")]
    rows = written(thin.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, "conv_id long, role string, digest binary, bytes long, part int, k long"), "turns")
    counts = written(rows.groupBy("conv_id", "part").agg(F.count("*").alias("n")), "counts")
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # of each range's conversations only the first can have begun in an earlier range
    begun = counts.select("conv_id", "part", earlier.alias("begun")).where("begun > 0")
    i = (F.col("k") + F.coalesce("begun", F.lit(0))).alias("i")
    return rows.join(F.broadcast(begun), ["conv_id", "part"], "left").select("conv_id", i, "role", "digest", "bytes"), counts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"))


def named(turns: DataFrame) -> DataFrame:
    """turns (conv_id, i, role, digest, ...) with n1, n2: the name of the prefix that ends with the turn, p1, p2: its parent's; written."""
    tagged = turns.withColumn("block", F.floor(F.col("i") / BLOCK))
    for k in (1, 2):
        tagged = tagged.withColumn(f"h{k}", F.xxhash64(F.lit(k), "i", "role", "digest"))
    within = Window.partitionBy("conv_id", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    made = written(tagged.select("*", *(F.bit_xor(f"h{k}").over(within).alias(f"n{k}") for k in (1, 2))).drop("role", "digest"), "prefixes")
    # what the whole blocks before a block add up to
    upto = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    ends = made.where(F.col("i") % BLOCK == BLOCK - 1).select("conv_id", (F.col("block") + 1).alias("block"), "n1", "n2")
    carried = ends.select("conv_id", "block", *(F.bit_xor(f"n{k}").over(upto).alias(f"c{k}") for k in (1, 2)))
    far = made.where("block > 0").join(carried, ["conv_id", "block"]).select(*(c for c in made.columns if c not in ("n1", "n2")), *(F.col(f"n{k}").bitwiseXOR(F.col(f"c{k}")).alias(f"n{k}") for k in (1, 2)))
    whole = made.where("block = 0").unionByName(far)
    return whole.select("*", *(F.col(f"n{k}").bitwiseXOR(F.col(f"h{k}")).alias(f"p{k}") for k in (1, 2))).drop("block", "h1", "h2")


def rolled_up(nodes: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """nodes (n1, n2, p1, p2: the parent, null at the root, depth, values) with each of values summed over the subtree of every node.

    Pointer jumping over the edges: as many rounds as the greatest depth has binary digits.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    state, reach = nodes.select("n1", "n2", "depth", F.col("p1").alias("u1"), F.col("p2").alias("u2"), *values), 1
    while reach <= deepest:
        below = state.where("u1 is not null").groupBy(F.col("u1").alias("n1"), F.col("u2").alias("n2")).agg(*(F.sum(v).alias(f"more_{v}") for v in values), F.count("*").alias("pointing"))
        added = state.join(below, ["n1", "n2"], "left").select("n1", "n2", "depth", "u1", "u2", *((F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values), F.coalesce("pointing", F.lit(0)).alias("pointing"))
        added = written(added, "added")
        # an ancestor twice as far up is there from this depth on
        far, near = added.where(F.col("depth") >= 2 * reach), added.where(F.col("depth") < 2 * reach)
        above = added.where("pointing > 0").select(F.col("n1").alias("u1"), F.col("n2").alias("u2"), F.col("u1").alias("v1"), F.col("u2").alias("v2"), "pointing")
        jumped = looked_up(far.drop("pointing"), above, ["u1", "u2"], "pointing").select("n1", "n2", "depth", F.col("v1").alias("u1"), F.col("v2").alias("u2"), *values)
        none = F.lit(None).cast("long")
        state = written(jumped.unionByName(near.select("n1", "n2", "depth", none.alias("u1"), none.alias("u2"), *values)), "jumped")
        reach *= 2
    return state.select("n1", "n2", *values)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    """(name, first row, row after the last) of rows of one name that follow each other."""
    n1, n2 = (batch.column(c).to_numpy() for c in ("n1", "n2"))
    first = np.flatnonzero(np.concatenate([[True], (n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1])])).tolist() if len(n1) else []
    for a, b in zip(first, [*first[1:], len(n1)], strict=True):
        yield (int(n1[a]), int(n2[a])), a, b


def id_digests(members: DataFrame) -> DataFrame:
    """(n1, n2, digest) of members (n1, n2, id): lowercase SHA-256 of the ids of a name in ascending order, comma-joined.

    Ids are sorted in ranges that may split a name, and joined there into texts of PART ids; the texts of a name, one after
    the other, go through its hash, which holds no more than one of them.
    """

    def joined(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids, out = batch.column("id").to_pylist(), []
            for (n1, n2), a, b in _runs(batch):
                out += [(n1, n2, ids[k], ",".join(map(str, ids[k : min(k + PART, b)]))) for k in range(a, b, PART)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["n1", "n2", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]):
        name, sha = None, None
        for batch in batches:
            out, ids = [], batch.column("ids")
            for now, a, b in _runs(batch):
                if now != name:
                    out += [(*name, sha.hexdigest())] if name else []
                    name, sha, a = now, hashlib.sha256(ids[a].as_py().encode()), a + 1
                for k in range(a, b):
                    sha.update(b"," + ids[k].as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["n1", "n2", "digest"])
        if name:
            yield pa.RecordBatch.from_arrays([pa.array([name[0]], pa.int64()), pa.array([name[1]], pa.int64()), pa.array([sha.hexdigest()])], names=["n1", "n2", "digest"])

    parts = members.select("n1", "n2", "id").repartitionByRange("n1", "n2", "id").sortWithinPartitions("n1", "n2", "id").mapInArrow(joined, "n1 long, n2 long, first long, ids string")
    return parts.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "first").mapInArrow(hashed, "n1 long, n2 long, digest string")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of turns (conv_id, i from 0 without gaps, role, digest, bytes) of conversations (conv_id, length).

    Per node: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256 (of the members that end there). The root stands for all conversations, those of length 0
    too; without any conversation there is no node.
    """
    own = named(turns)
    nodes = own.groupBy("n1", "n2").agg(F.min("conv_id").alias("conv_id"), (F.min("i") + 1).alias("depth"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("n1"), zero.alias("n2"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("bytes"), none.alias("p1"), none.alias("p2"))
    nodes = written(nodes.unionByName(root), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single"))
    nodes = written(nodes.join(children, ["n1", "n2"], "left").fillna(0, ["n_children", "single"]), "nodes")
    shared = nodes.where("n_convs > 1 or depth = 0").select("n1", "n2", "p1", "p2", "depth", (F.col("single") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    sums = rolled_up(shared, ("n_leaves", "saved_tokens"))
    ended = own.where("i + 1 = length").select("n1", "n2", F.col("conv_id").alias("id")).unionByName(conversations.where("length = 0").select(zero.alias("n1"), zero.alias("n2"), F.col("conv_id").alias("id")))
    told = nodes.join(sums, ["n1", "n2"], "left").join(id_digests(ended), ["n1", "n2"], "left")
    parents = nodes.where("n_children > 0").select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    leaves, saved = F.coalesce("n_leaves", F.lit(1).cast("long")), F.coalesce("saved_tokens", zero)
    told = written(told.select("conv_id", "depth", "p1", "p2", "n_convs", "n_children", leaves.alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")), "told")
    return looked_up(told, parents, ["p1", "p2"], "n_children").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """trie() of conversations as they are; see ranked() for order, nulls and ties. Repeated rows are turns of their own.

    Other columns do not matter, whatever their names; an empty table gives no nodes. Equality of turns and prefixes is
    decided by digests of 128 bits.
    """
    rows, sizes = ranked(turns, conv_col, turn_col, role_col, text_col)
    zero = F.lit(0).cast("long")
    return trie(*_placed(rows, written(sizes.select("conv_id", "n_turns", F.col("n_turns").alias("length"), zero.alias("skip"), zero.alias("shift")), "convs")))


def _placed(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns from skip on, moved by shift, with their conversation's length; and conversations."""
    own = looked_up(rows, convs.select("conv_id", "length", "skip", "shift", "n_turns"), ["conv_id"], "n_turns").where("i >= skip")
    return own.withColumn("i", F.col("i") + F.col("shift")).drop("skip", "shift"), convs.select("conv_id", "length")


def rebuilt_trie(turns: DataFrame, head: Column, base: Column, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """trie() of conversations whose first head turns are replaced by as many of conversation base's.

    head and base are expressions over conv_id; base's conversation is taken as it was, with fewer turns if it has fewer and
    none if it does not exist. Everything else is as in prefix_trie. The turns of a base are repeated once for each
    conversation that takes them, so few conversations should have the same base.
    """
    rows, sizes = ranked(turns, conv_col, turn_col, role_col, text_col)
    sizes = written(sizes, "sizes")
    convs = sizes.select("conv_id", "n_turns", head.cast("long").alias("head"), base.alias("base")).join(sizes.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("n_base")), "base", "left")
    taken, same = F.least("head", F.coalesce("n_base", F.lit(0).cast("long"))), F.col("base") == F.col("conv_id")
    zero = F.lit(0).cast("long")
    convs = convs.select("conv_id", "n_turns", "base", "head", F.when(same, zero).otherwise(F.col("head")).alias("skip"), F.when(same, zero).otherwise(taken).alias("taken"))
    convs = written(convs.select("*", (F.col("taken") - F.col("skip")).alias("shift"), (F.col("taken") + F.greatest(F.col("n_turns") - F.col("skip"), zero)).alias("length")), "convs")
    most = convs.agg(F.max("taken")).first()[0] or 0
    sources = rows.where(F.col("i") < most).withColumnRenamed("conv_id", "base")
    heads = convs.where("taken > 0").select("conv_id", "base", "taken", "length").join(sources, "base").where("i < taken").select("conv_id", "i", "role", "digest", "bytes", "length")
    own, lengths = _placed(rows, convs)
    return trie(own.unionByName(heads), lengths)
