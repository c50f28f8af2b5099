"""One document of every group of near-copies: five-word shingles of Jaccard similarity 0.8 or more.

Links are found in two passes. The first merges most of every group at a cost that grows with its members: candidates come
from the vantage-point trees over SimHash fingerprints of the shingles, and from band keys of the shingle sets (the LEAST
smallest hashes of each of BINS ranges of hashes). Sets that share a key are compared as a bunch, bunches of over TOGETHER
in random parts of about that many.

The second pass decides what is left, so that no link is missed. All shingles have one order, common ones last (_common).
Of two sets of similarity 0.8, each has one of its first floor(n / 5) + 1 shingles among the other's: these are its
prefix. So every pair that may link and is not merged yet shares a prefix shingle that has sets of two groups. Where few sets
share one, pairs are counted: a pair that shares c prefix shingles has at most c + the longer rest in common, which
drops chance pairs without their sets being sent. Where over LISTED sets share one, the sets that such shingles connect
are a family, which is cut into blocks, and blocks are compared with blocks, but for those within one group. The work of a
family grows with the square of its members that the first pass left apart; of a family in which nothing links, such as
pages of one template that differ in a fifth of their words, that is all of it.

Pairs of both kinds are sifted by sketches (_sketch), bitmaps of two to four bits a shingle. A bit that only one of two sets
has is a shingle that the other lacks, so no link is dropped, and few pairs below 0.72 are left. Only sets of pairs that are
left are made and sent. Pairs meet in cells (_cells), which keep those of one component together, so a sketch or a set is
sent once for each cell and not for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from . import textkernel as tk
from .common import connected_components, written

SHINGLE = 5
#: Least similarity of a link, in percent.
PERCENT = 80
BINS = 6
LEAST = 3
TOGETHER = 8
#: Rows that are sampled at least to tell common shingles (beyond that, one row in EVERY), how often these occur in the
#: sample, and how many are told at most. What the sample misses is ordered as a rare shingle: that costs time and changes no
#: result. A shingle that is missed is in some EVERY * COMMON sets, which is about LISTED.
SAMPLED = 1 << 14
EVERY = 32
COMMON = 8
MOST_COMMON = 1 << 18
#: Sets that may share a prefix shingle without being compared in blocks, and sets of a side of a cell. Blocks have sketches of
#: WIDE times as many sets.
LISTED = 256
BLOCK = 256
WIDE = 16
#: Bits for each key of a bitmap that rows are looked up in before they are shuffled, and bits at most (32 MB).
KEY_BITS = 12
MOST_BITS = 1 << 28
#: Pairs held before they are counted.
HELD = 1 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def shingle_hashes(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle, in order, ASCII case folded; all words are the only one of a shorter text."""
    offsets, raw = tk.buffers(batch.column(column))
    row, starts, ends = tk.words(offsets, raw)
    hashes = tk.span_hashes(tk.byte_values(_FOLD[raw]), starts, ends)
    first = np.searchsorted(row, np.arange(batch.num_rows + 1))
    at, h = tk.windows(hashes, row, SHINGLE)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SHINGLE))
    rows = np.concatenate([row[at], short])
    h = np.concatenate([h, tk.span_hashes(hashes, first[short], first[short + 1])])
    order = np.argsort(rows, kind="stable")
    return rows[order], h[order]


def _distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[keep], h[keep]


def _bits(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """SimHash fingerprints of n rows from the hashes of their shingles, repeats included; 0 without any."""
    counts, at = np.zeros((n, 64), np.int64), np.searchsorted(row, np.arange(n + 1))
    for lo in range(0, len(h), 1 << 17):
        hi = min(len(h), lo + (1 << 17))
        bits = np.unpackbits(h[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first, last = int(row[lo]), int(row[hi - 1])
        cuts = np.clip(at[first : last + 1], lo, hi) - lo
        some = np.flatnonzero(np.diff(np.append(cuts, hi - lo)) > 0)
        counts[first + some] += np.add.reduceat(bits, cuts[some], axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > np.diff(at)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _keys(row: np.ndarray, h: np.ndarray, n: int) -> list[np.ndarray]:
    """The band keys of n rows; row, h are distinct and sorted."""
    bins = ((h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    group = row * BINS + bins
    new = np.ones(len(h), bool)
    new[1:] = group[1:] != group[:-1]
    start = np.flatnonzero(new)
    rank = np.arange(len(h)) - start[np.cumsum(new) - 1]
    low = np.where(rank < LEAST, tk.mix(h + rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0))
    keys = tk.mix(np.add.reduceat(low, start) + bins[start].astype(np.uint64)) if len(h) else h
    return np.split(keys.view(np.int64), np.searchsorted(row[start], np.arange(1, n)))


def _prefix(row: np.ndarray, h: np.ndarray, n: int, common: np.ndarray) -> list[np.ndarray]:
    """The first floor(size / 5) + 1 hashes of each of n rows, common ones last; row, h are distinct and sorted."""
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    last = common[at] == h if len(common) else np.zeros(len(h), bool)
    h = h[np.lexsort((h, last, row))]
    first = np.searchsorted(row, np.arange(n + 1))
    size = np.diff(first)
    kept = np.where(size > 0, size - (PERCENT * size + 99) // 100 + 1, 0)
    return np.split(h[np.arange(len(h)) - first[row] < kept[row]].view(np.int64), np.cumsum(kept)[:-1])


def _common(documents: DataFrame, text_col: str) -> np.ndarray:
    """Sorted hashes of shingles that occur in COMMON or more of the sampled rows, the MOST_COMMON most frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                _, h = _distinct(*shingle_hashes(part, "text"))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    every = max(1, min(EVERY, documents.count() // SAMPLED))
    sample = documents.select(F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")).where(F.pmod(F.xxhash64("row"), F.lit(every)) == 0)
    counted = sample.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    told = counted.orderBy(F.desc("n"), "h").limit(MOST_COMMON).select("h").toArrow()
    return np.sort(told.column("h").to_numpy().view(np.uint64))


def signatures(documents: DataFrame, columns: tuple[str, ...], id_col: str, text_col: str) -> DataFrame:
    """(c0, c1, ... columns, uid, id, text_hash, k1, k2: the shingle set, n: its size, fp, keys, prefix) of every row, written."""
    names = {f"c{i}": c for i, c in enumerate(columns)}
    types = {k: documents.schema[c].dataType.simpleString() for k, c in names.items()}
    schema = ", ".join(f"{k} {t}" for k, t in types.items()) + ", uid long, id long, text_hash long, k1 long, k2 long, n int, fp long, keys array<long>, prefix array<long>"
    common = documents.sparkSession.sparkContext.broadcast(_common(documents, text_col))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in tk.slices(batch, "text"):
                size = part.num_rows
                row, h = shingle_hashes(part, "text")
                fp = _bits(row, h, size)
                row, h = _distinct(row, h)
                at = np.searchsorted(row, np.arange(size + 1))
                total = lambda x: np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])[at]  # noqa: B023, E731
                k1, k2 = (tk.mix(np.diff(total(tk.mix(h ^ np.uint64(salt)))) + np.diff(at).astype(np.uint64)) for salt in (0, 0xA5A5A5A55A5A5A5A))
                keys = pa.array(_keys(row, h, size), pa.list_(pa.int64()))
                made = [pa.array(k.view(np.int64)) for k in (k1, k2)] + [pa.array(np.diff(at).astype(np.int32)), pa.array(fp.view(np.int64)), keys, pa.array(_prefix(row, h, size, common.value), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(part.column("text" if names[k] == text_col else k) for k in names), part.column("uid"), part.column("id"), part.column("text_hash"), *made], names=[*names, "uid", "id", "text_hash", "k1", "k2", "n", "fp", "keys", "prefix"])

    sent = documents.select(F.col(text_col).alias("text"), *(F.col(c).alias(k) for k, c in names.items() if c != text_col), F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"))
    return written(sent.mapInArrow(run, schema), "signatures")


def _bunches(classes: DataFrame) -> DataFrame:
    """(bunch, uid): classes (uid, k1, k2, fp, keys) to be compared with each other, each bunch of members once.

    Parts and what stands for a fingerprint follow the sets, not the rows' numbers, so that reruns compare alike.
    """
    at = written(classes.select("uid", "k1", F.explode("keys").alias("key")), "bands")
    shared = at.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    parts = F.when(F.col("members") > TOGETHER, F.pmod(F.xxhash64("k1", "key"), F.ceil(F.col("members") / TOGETHER))).otherwise(F.lit(0).cast("long"))
    by_key = at.join(shared, "key").groupBy("key", parts.alias("part")).agg(F.array_sort(F.collect_set("uid")).alias("uids"))
    nodes = written(classes.groupBy("fp").agg(F.min_by("uid", F.struct("k1", "k2")).alias("id")), "nodes")
    by_print = simhash.links(nodes).select(F.array("dst", "src").alias("uids"))
    of_print = classes.join(nodes, "fp").where("uid <> id").select(F.array("id", "uid").alias("uids"))
    uids = by_key.select("uids").where("size(uids) > 1").unionByName(by_print).unionByName(of_print)
    # the hash names the bunch; bunches that it should confuse would be compared as one
    return written(uids.select(F.xxhash64("uids").alias("bunch"), "uids").distinct().select("bunch", F.explode("uids").alias("uid")), "bunches")


def _tester(keys: DataFrame, column: str):
    """A function of longs, for use in tasks: which of them column of keys may hold. False ones are surely not there.

    The bitmap behind it has a fixed size at most, so with more keys than that it rules out less.
    """
    mask = np.uint64(min(MOST_BITS, max(64, 1 << (KEY_BITS * keys.count()).bit_length())) - 1)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            at = tk.mix(batch.column("key").to_numpy().view(np.uint64)) & mask
            word, where = np.unique((at >> np.uint64(6)).astype(np.int64), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, where, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])

    told = keys.select(F.col(column).alias("key")).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros((int(mask) + 1) // 64, np.uint64)
    words[told.column("word").to_numpy()] = told.column("bits").to_numpy().view(np.uint64)
    words = keys.sparkSession.sparkContext.broadcast(words)

    def may_hold(x: np.ndarray) -> np.ndarray:
        at = tk.mix(x.view(np.uint64)) & mask
        return (words.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    return may_hold


def _sketch(h: np.ndarray) -> bytes:
    """A bitmap of distinct hashes: a power of two of bits, two to four a hash and 64 at least."""
    bits = np.zeros(64 << max(0, (2 * len(h) - 1).bit_length() - 6), bool)
    bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _may_link(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which sets of n and m hashes, with sketches in the rows of x and y, may be PERCENT or more alike; false ones surely are not."""
    while x.shape[1] > y.shape[1]:
        x = x[:, : x.shape[1] // 2] | x[:, x.shape[1] // 2 :]
    while y.shape[1] > x.shape[1]:
        y = y[:, : y.shape[1] // 2] | y[:, y.shape[1] // 2 :]
    bits = lambda z: np.bitwise_count(z).sum(axis=1, dtype=np.int64)
    both = bits(x & y)
    return (100 + PERCENT) * np.minimum(n - bits(x) + both, m - bits(y) + both) >= PERCENT * (n + m)


def _by_width(sketches: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """(width in words, place among those of its width) of every sketch, and the sketches of each width as rows."""
    data = [np.frombuffer(x.as_buffer(), np.uint64) for x in sketches]
    width = np.array([len(x) for x in data], np.int64)
    place, rows = np.zeros(len(data), np.int64), {}
    for w in np.unique(width).tolist():
        each = np.flatnonzero(width == w)
        place[each] = np.arange(len(each))
        rows[w] = np.stack([data[i] for i in each.tolist()])
    return width, place, rows


def _of_texts(texts: DataFrame, asked: DataFrame, form, name: str) -> DataFrame:
    """(uid, n, name: form of the n sorted distinct shingle hashes) of texts (uid, text) that asked (uid) may name; made where the texts are read."""
    named = _tester(asked, "uid")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in tk.slices(batch.filter(pa.array(named(batch.column("uid").to_numpy()))), "text"):
                row, h = _distinct(*shingle_hashes(part, "text"))
                at = np.searchsorted(row, np.arange(part.num_rows + 1))
                made = [form(h[a:b]) for a, b in zip(at.tolist(), at.tolist()[1:])]  # noqa: B905
                yield pa.RecordBatch.from_arrays([part.column("uid"), pa.array(np.diff(at)), pa.array(made, pa.binary())], names=["uid", "n", name])

    return texts.select("uid", "text").mapInArrow(run, f"uid long, n long, {name} binary")


def _sets(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(uid, hashes: the sorted distinct shingle hashes) of texts (uid, text) that asked (uid) may name."""
    return _of_texts(texts, asked, lambda h: h.tobytes(), "hashes").select("uid", "hashes")


def _confirmed(members: DataFrame) -> DataFrame:
    """Edges (src, dst) between members (bunch, uid, hashes) of a bunch that are PERCENT or more alike."""

    def compare(sets: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
        out, known = [], {uid: x for uid, x in sets}
        label = {uid: uid for uid in known}
        for a, x in known.items():
            for b, y in known.items():
                if a < b and label[a] != label[b] and 100 * min(len(x), len(y)) >= PERCENT * max(len(x), len(y)):
                    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    if (100 + PERCENT) * both >= PERCENT * (len(x) + len(y)):
                        out.append((a, b))
                        old, new = label[b], label[a]
                        label.update({u: new for u, v in label.items() if v == old})
        return out

    def run(batches: Iterator[pa.RecordBatch]):
        last, sets = None, []
        for batch in batches:
            edges = []
            data = batch.column("hashes")
            for row, (bunch, uid) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bunch", "uid")), strict=True)):
                if bunch != last:
                    edges += compare(sets)
                    last, sets = bunch, []
                # a copy, so that a bunch that goes on in the next batch does not hold this one
                sets.append((uid, np.frombuffer(data[row].as_buffer(), np.uint64).copy()))
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["src", "dst"])
        if edges := compare(sets):
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["src", "dst"])

    return members.repartition("bunch").sortWithinPartitions("bunch", "uid").mapInArrow(run, "src long, dst long")


def _left(made: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, uid, label, n, members) of prefix shingles that sets of two labels or more share, written; made: signatures, labels: (uid, label) of classes.

    Copies have one k1, so a key with two is in two sets at least. Only keys that may be such are sent to the labels.
    """
    found = made.select("k1", F.explode("prefix").alias("key")).groupBy("key").agg(F.min("k1").alias("low"), F.max("k1").alias("high"))
    known = _tester(written(found.where("low < high").select("key"), "shared"), "key")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            lists = batch.column("prefix")
            key = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            kept = np.flatnonzero(known(key))
            cuts = np.searchsorted(row[kept], np.arange(batch.num_rows + 1)).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(cuts), pa.array(key[kept]))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("n"), keys], names=["uid", "n", "keys"])

    sent = made.select("uid", "n", "prefix").mapInArrow(run, "uid long, n int, keys array<long>").where("size(keys) > 0")
    at = written(sent.join(labels, "uid").select("uid", "label", "n", "keys"), "keyed").select("uid", "label", "n", F.explode("keys").alias("key"))
    shared = at.groupBy("key").agg(F.count("*").alias("members"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return written(at.join(shared.select("key", "members").hint("merge"), "key").select("key", "uid", "label", "n", "members"), "left")


def _met(size: int, lists: np.ndarray, first: np.ndarray, uid: np.ndarray, label: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(a, b, size of a, size of b) of all pairs in lists of size members that have two labels and fitting sizes; first: where the lists begin."""
    i, j = np.triu_indices(size, 1)
    at = first[lists]
    a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
    fits = (label[a] != label[b]) & (100 * np.minimum(n[a], n[b]) >= PERCENT * np.maximum(n[a], n[b]))
    a, b = a[fits], b[fits]
    return np.stack([uid[a], uid[b], n[a], n[b]])


def _pairs(left: DataFrame) -> DataFrame:
    """(src, dst) of pairs of different labels that share prefix shingles of at most LISTED sets, and enough of them.

    Lists go to tasks by their smallest member, and come in its order, so that those of one group of texts come together and
    their pairs are counted before they are sent on.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            members = batch.column("members")
            uid, label, n = (members.flatten().field(c).to_numpy() for c in ("uid", "label", "n"))
            size = members.value_lengths().to_numpy()
            first = np.cumsum(size) - size
            made, held = [np.zeros((5, 0), np.int64)], 0
            for m in np.unique(size).tolist():
                each = np.flatnonzero(size == m)
                step = max(1, HELD // (m * (m - 1) // 2 or 1))
                for at in range(0, len(each), step):
                    found = _met(m, each[at : at + step], first, uid, label, n)
                    made.append(np.concatenate([found, np.ones((1, found.shape[1]), np.int64)]))
                    held += found.shape[1]
                    if held > HELD:
                        made = [_summed(made)]
                        held = made[0].shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(made)], names=["uida", "uidb", "na", "nb", "both"])

    few = left.where(F.col("members") <= LISTED).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("uid", "label", F.col("n").cast("long").alias("n")))).alias("members"))
    few = few.select("members", F.col("members")[0]["uid"].alias("dst")).repartition("dst").sortWithinPartitions("dst").select("members")
    counted = few.mapInArrow(run, "uida long, uidb long, na long, nb long, both long").groupBy("uida", "uidb", "na", "nb").agg(F.sum("both").alias("both"))
    # what follows the prefixes: n - floor(n / 5) - 1 shingles at most
    rest = F.floor((F.greatest("na", "nb") * PERCENT + 99) / 100) - 1
    pairs = counted.where((F.col("both") + rest) * (100 + PERCENT) >= (F.col("na") + F.col("nb")) * PERCENT)
    return pairs.select(F.col("uida").alias("src"), F.col("uidb").alias("dst"))


def _summed(made: list[np.ndarray]) -> np.ndarray:
    """Columns (a, b, size of a, size of b, count), each pair once."""
    rows = np.concatenate(made, axis=1)
    rows = rows[:, np.lexsort((rows[1], rows[0]))]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
    start = np.flatnonzero(new)
    out = rows[:, start]
    if len(start):
        out[4] = np.add.reduceat(rows[4], start)
    return out


def _families(left: DataFrame) -> DataFrame:
    """(pair, block, uid, label): members of the blocks to be compared of every family, once for each pair of blocks."""
    many = left.where(F.col("members") > LISTED)
    first = many.groupBy("key").agg(F.min("uid").alias("dst"))
    family = connected_components(many.join(first, "key").select(F.col("uid").alias("src"), "dst"))
    rows = written(many.select("uid", "label", "n").distinct().join(family.withColumnRenamed("node", "uid"), "uid", "left").select(F.coalesce("component", "uid").alias("family"), "uid", "label", "n"), "families")
    size = WIDE * BLOCK
    # a label of more than a block has blocks of its own
    sizes = rows.groupBy("family", "label").agg(F.count("*").alias("mine"))
    mixed = sizes.groupBy("family").agg(F.sum(F.when(F.col("mine") <= size, F.col("mine")).otherwise(0)).alias("others"))
    cut = lambda of, c: F.pmod(F.xxhash64(of), F.ceil(F.greatest(F.col(c), F.lit(1)) / size))
    dealt = rows.join(sizes, ["family", "label"]).join(mixed, "family")
    own = F.when(F.col("mine") > size, F.col("label"))
    dealt = written(dealt.select("family", "uid", "label", "n", own.alias("own"), F.when(own.isNotNull(), cut("uid", "mine")).otherwise(cut("label", "others")).alias("part")), "dealt")
    blocks = dealt.groupBy("family", "own", "part").agg(F.min("n").alias("least"), F.max("n").alias("most")).withColumn("block", F.xxhash64("family", F.coalesce("own", F.lit(-1)), "part"))
    a, b = (blocks.select("family", *(F.col(c).alias(c + side) for c in ("block", "own", "least", "most"))) for side in "ab")
    fits = (F.col("blocka") <= F.col("blockb")) & ~F.coalesce(F.col("owna") == F.col("ownb"), F.lit(False)) & (F.col("mosta") * 100 >= F.col("leastb") * PERCENT) & (F.col("mostb") * 100 >= F.col("leasta") * PERCENT)
    met = a.join(b, "family").where(fits).select(F.xxhash64("blocka", "blockb").alias("pair"), F.explode(F.array_distinct(F.array("blocka", "blockb"))).alias("block"))
    members = dealt.select("uid", "label", F.xxhash64("family", F.coalesce("own", F.lit(-1)), "part").alias("block"))
    return members.join(met, "block").select("pair", "block", "uid", "label")


def _sifted_blocks(members: DataFrame) -> DataFrame:
    """(src, dst) of sets of different labels in a pair of blocks that may link; members (pair, block, uid, label, n, sketch)."""

    def sift(table: pa.Table) -> pa.Table:
        uid, label, n, block = (table.column(c).to_numpy() for c in ("uid", "label", "n", "block"))
        width, place, rows = _by_width(table.column("sketch"))
        one, two = block.min(), block.max()
        src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        targets = {w: np.flatnonzero((width == w) & (block == two)) for w in rows}
        for i in np.flatnonzero(block == one).tolist():
            for w, each in targets.items():
                fits = (label[each] != label[i]) & (100 * np.minimum(n[each], n[i]) >= PERCENT * np.maximum(n[each], n[i]))
                near = each[fits & (each > i) if one == two else fits]
                if len(near):
                    near = near[_may_link(rows[width[i]][place[i] : place[i] + 1], n[i], rows[w][place[near]], n[near])]
                    src.append(np.full(len(near), uid[i]))
                    dst.append(uid[near])
        return pa.table({"src": pa.array(np.concatenate(src)), "dst": pa.array(np.concatenate(dst))})

    return members.groupBy("pair").applyInArrow(sift, "src long, dst long")


def _cells(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs (src, dst) with the cells they are decided in (cell, src, dst), and the members (cell, uid) of cells.

    Nodes are dealt to blocks of about BLOCK, those of a component together unless they are more; a cell is a pair of blocks.
    So a member is sent once, or once for each block of its component.
    """
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    # a component's smallest node is not listed
    found = nodes.join(connected_components(pairs), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    found = written(found, "components")
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    blocks = max(1, -(-found.count() // BLOCK))
    large = F.struct("component", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK)).alias("part"))
    block = F.when(F.col("size") > BLOCK, F.xxhash64(large)).otherwise(F.pmod(F.xxhash64("component"), F.lit(blocks)))
    placed = written(found.join(sizes, "component").select("node", block.alias("block")), "placed")
    a, b = (placed.select(F.col("node").alias(c), F.col("block").alias(f"of_{c}")) for c in ("src", "dst"))
    at = pairs.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").select(F.xxhash64(F.least("of_src", "of_dst"), F.greatest("of_src", "of_dst")).alias("cell"), "src", "dst")
    at = written(at, "cells")
    return at, at.select(F.col("cell").alias("cell"), F.explode(F.array("src", "dst")).alias("uid")).distinct()


def _sifted(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst) of pairs (cell, src, dst) that may link, by the sketches of members (cell, uid, n, sketch)."""

    def sift(asked: pa.Table, given: pa.Table) -> pa.Table:
        src, dst = (asked.column(c).to_numpy() for c in ("src", "dst"))
        uid, n = (given.column(c).to_numpy() for c in ("uid", "n"))
        width, place, rows = _by_width(given.column("sketch"))
        order = np.argsort(uid)
        i, j = (order[np.searchsorted(uid, x, sorter=order)] for x in (src, dst))
        kept = np.zeros(len(src), bool)
        for v in rows:
            for w in rows:
                each = np.flatnonzero((width[i] == v) & (width[j] == w))
                step = max(1, HELD // max(v, w))
                for part in (each[at : at + step] for at in range(0, len(each), step)):
                    kept[part] = _may_link(rows[v][place[i[part]]], n[i[part]], rows[w][place[j[part]]], n[j[part]])
        return pa.table({"src": pa.array(src[kept]), "dst": pa.array(dst[kept])})

    return pairs.groupBy("cell").cogroup(members.groupBy("cell")).applyInArrow(sift, "src long, dst long")


def _decided(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Edges (src, dst) that connect what those of pairs (cell, src, dst) that link do; members (cell, uid, hashes)."""

    def decide(asked: pa.Table, given: pa.Table) -> pa.Table:
        data = given.column("hashes").combine_chunks()
        sets = {u: np.frombuffer(data[i].as_buffer(), np.uint64) for i, u in enumerate(given.column("uid").to_pylist())}
        above = {u: u for u in sets}

        def top(u: int) -> int:
            while above[u] != u:
                above[u] = u = above[above[u]]
            return u

        out = []
        for a, b in zip(asked.column("src").to_pylist(), asked.column("dst").to_pylist(), strict=True):
            if top(a) != top(b):
                x, y = sets[a], sets[b]
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if (100 + PERCENT) * both >= PERCENT * (len(x) + len(y)):
                    out.append((a, b))
                    above[top(b)] = top(a)
        return pa.table({c: pa.array([e[k] for e in out], pa.int64()) for k, c in enumerate(("src", "dst"))})

    return pairs.groupBy("cell").cogroup(members.groupBy("cell")).applyInArrow(decide, "src long, dst long")


def one_of_each(documents: DataFrame, columns: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """columns of one row of every group of documents that links connect: that of the smallest id (null last), then of the least text hash.

    Rows are grouped by their shingles and not by their ids: rows that share an id may both stay, and a row with a null id
    goes only if another row of its group stays. Texts without words (null, empty) are equal. An empty table gives an empty
    result. Hashes of 64 bits stand for shingles, 128 for whole sets.
    """
    made = signatures(documents, columns, id_col, text_col)
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "uid")).alias("best")
    classes = written(made.groupBy("k1", "k2").agg(best).select("best", F.col("best.uid").alias("uid")), "classes")
    text = f"c{columns.index(text_col)}"

    texts = made.select("uid", F.col(text).alias("text"))
    near = _bunches(made.select("uid", "k1", "k2", "fp", "keys").join(classes.select("uid"), "uid"))
    edges = written(_confirmed(near.join(_sets(texts, near).hint("merge"), "uid")), "edges")
    merged = connected_components(edges).select(F.col("node").alias("uid"), "component")
    left = _left(made, written(classes.select("uid").join(merged, "uid", "left").select("uid", F.coalesce("component", "uid").alias("label")), "labels"))
    pairs, blocks = written(_pairs(left), "pairs"), written(_families(left), "blocks")
    pairs, members = _cells(pairs)
    sketches = written(_of_texts(texts, members.select("uid").unionByName(blocks.select("uid")).distinct(), _sketch, "sketch"), "sketches").hint("merge")
    sifted = _sifted(pairs, members.join(sketches, "uid")).unionByName(_sifted_blocks(blocks.join(sketches, "uid")))
    pairs, members = _cells(written(sifted.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "sifted"))
    more = written(_decided(pairs, members.join(_sets(texts, members.select("uid").distinct()).hint("merge"), "uid")), "edges")
    found = connected_components(edges.unionByName(more))
    labelled = classes.join(found, classes["uid"] == found["node"], "left").select("best", F.coalesce("component", "uid").alias("component"))
    kept = labelled.groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.uid").alias("uid"))
    gone = written(made.select("uid").join(kept, "uid", "left_anti"), "gone")
    named = _tester(gone, "uid")
    carried = made.select("uid", *(f"c{i}" for i in range(len(columns))))

    def those(gone_maybe: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                yield batch.filter(pa.array(named(batch.column("uid").to_numpy()) == gone_maybe))

        return carried.mapInArrow(run, carried.schema)

    # only texts of rows that may go are shuffled
    rows = those(False).unionByName(those(True).join(gone, "uid", "left_anti"))
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))
