"""Substring dedup: repeated-phrase automata.

Confirm. A window of WINDOW words recurs if its word sequence starts at two or more places of the whole corpus. Counting all
windows would move sixteen bytes a word, so windows are counted only where they can recur: each window has an anchor, the
smallest hash among its runs of GRAM words; equal windows have equal anchors, so a window recurs only if its anchor does.
Anchors are one place in about fourteen. Windows are told apart by 128 bits of hash.

Compile. Documents are dealt to shards of about SHARD_BYTES. Passages of recurring windows are cut into phrases of WINDOW
words that cover them. Cuts inside a passage follow its content (least hashes again, one in about eighteen words), so that
copies are cut alike whatever stands around them; of equal phrases one is kept, wherever it comes from, and it goes to
every shard that is cut so too. (Its anchor would not do to choose shards: common words are the anchor of ever more phrases in
ever more shards.) The first and last window of a passage are phrases for its own shard. In each shard the phrases are compiled into an Aho-Corasick automaton over words (two characters each).

Stream. Every document runs through the automaton of its shard, and the occurrences that it finds, of phrases from any
document, are what is removed. Each document is streamed once, and an automaton holds only phrases that its shard
has, so its size follows the shard's and work grows with the input. Words stand as 64-bit hashes in phrases.

Counts travel packed, as arrays of hashes per (bucket, shard): a hot passage is one entry per shard, whatever its copies, and
one row of phrases.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import written

WINDOW = 35
GRAM = 8
SPLIT = 4
#: Bytes of text that a shard should have, shards of a bucket of the table, and most buckets.
SHARD_BYTES = 8 << 20
SHARDS_A_BUCKET = 4
MOST_BUCKETS = 100_000
#: Hashes a bucket should hold, and the least number of buckets; the volume is estimated from bytes of text (six a word).
BUCKET = 1 << 19
LEAST_BUCKETS = 16
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_REQUEST = "bucket int, shard int, hashes binary, many binary"


class _Shard:
    """Word hashes of a shard's documents, laid end to end."""

    def __init__(self, table: pa.Table):
        self.offsets, self.raw = tk.buffers(table.column("text"))
        row, start, end = [], [], []
        hashes = []
        # in runs of rows, so that eight bytes per byte of text are held for a few MB only
        at = 0
        while at < table.num_rows:
            to = max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + (1 << 21), "right")) - 1)
            base = self.offsets[at]
            raw = self.raw[base : self.offsets[to]]
            r, s, e = tk.words(self.offsets[at : to + 1] - base, raw)
            hashes.append(tk.span_hashes(tk.byte_values(raw), s, e))
            row.append(r + at)
            start.append(s + base)
            end.append(e + base)
            at = to
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.row, self.start, self.end, self.hashes = join(row, np.int64), join(start, np.int64), join(end, np.int64), join(hashes, np.uint64)
        self.first = np.searchsorted(self.row, np.arange(table.num_rows + 1))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of the windows within a document, 4 million words at a time in memory."""
        return self._windows(self.hashes, size)

    def long_windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(first words, two hashes each) of the windows of WINDOW words."""
        at, h = self.windows(WINDOW)
        return at, np.stack([h, self._windows(tk.mix(self.hashes ^ np.uint64(0x5851F42D4C957F2D)), WINDOW)[1]], axis=1)

    def _windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        at, out, n = [], [], len(hashes)
        for lo in range(0, n, 1 << 22):
            hi = min(n, lo + (1 << 22) + size - 1)
            a, h = tk.windows(hashes[lo:hi], self.row[lo:hi], size)
            at.append(a + lo)
            out.append(h)
        return (np.concatenate(at), np.concatenate(out)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchors of all places selected, first words of windows, their anchors)."""
        n, gram = len(self.hashes), self._grams()
        width = WINDOW - GRAM + 1
        window, _ = tk.windows(np.zeros(n, np.uint64), self.row, WINDOW) if n else (np.zeros(0, np.int64), None)
        low = _sliding(gram, width, np.minimum)
        least = low[window]
        # a place is selected if it is the anchor of a window around it
        high = np.zeros(n, np.uint64)
        high[window] = least
        return gram[_selected(gram, high, width)], window, least

    def _grams(self) -> np.ndarray:
        """The hash of the run of GRAM words from each word on."""
        gram = np.full(len(self.hashes), _NONE)
        at, h = self.windows(GRAM)
        gram[at] = h
        return gram

    def cuts(self) -> np.ndarray:
        """Which words begin the least run of GRAM words among WINDOW neighbours; of WINDOW neighbouring windows at least one is so."""
        gram = self._grams()
        return _selected(gram, _sliding(gram, WINDOW, np.minimum), WINDOW)


def _selected(gram: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Which places hold the least gram of a stretch of width places around them; least: that of the stretch from each place on."""
    return (_sliding(least[::-1], width, np.maximum)[::-1] == gram) & (gram != _NONE)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over values[i : i + width], cut at the end."""
    out, size = values.copy(), 1
    while size < width:
        step = min(size, width - size)
        out[:-step] = pick(out[:-step], out[step:].copy()) if len(out) > step else out[:-step]
        size += step
    return out


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first places, group of each row, sizes) of the distinct rows of h, in order."""
    order = np.argsort(h[:, 0])
    ordered = h[order]
    same = ordered[1:, 0] == ordered[:-1, 0]
    if h.shape[1] > 1 and (same & (ordered[1:] != ordered[:-1]).any(axis=1)).any():
        # rows that share only their first word
        order = np.lexsort(h.T[::-1])
        ordered = h[order]
    new = np.ones(len(h), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group, np.bincount(group) if len(h) else np.zeros(0, np.int64)


def _requests(shard: int, hashes: np.ndarray, buckets: int) -> pa.Table:
    """The distinct hashes (rows) of a shard, packed by bucket, with a mark for those that occur there more than once."""
    first, _, n = _groups(hashes)
    h = hashes[first]
    bucket = (h[:, 0] % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    h, n, bucket = h[order], n[order], bucket[order]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    lo, hi = [0, *cut.tolist()], [*cut.tolist(), len(h)]
    if not len(h):
        lo, hi = [], []
    return pa.table({"bucket": pa.array([int(bucket[i]) for i in lo], pa.int32()), "shard": pa.array([shard] * len(lo), pa.int32()), "hashes": pa.array([h[i:j].tobytes() for i, j in zip(lo, hi, strict=True)], pa.binary()), "many": pa.array([np.packbits(n[i:j] > 1).tobytes() for i, j in zip(lo, hi, strict=True)], pa.binary())})


def _recurring(requests: DataFrame, width: int) -> DataFrame:
    """(bucket, shard, hashes): of each shard's hashes, of width words each, those that occur twice or more over all shards."""

    def count(table: pa.Table) -> pa.Table:
        packs = [np.frombuffer(x, np.uint64).reshape(-1, width) for x in table.column("hashes").to_pylist()]
        many = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)).astype(bool) for x, p in zip(table.column("many").to_pylist(), packs, strict=True)]
        _, group, n = _groups(np.concatenate(packs))
        twice = n > 1
        twice[group[np.concatenate(many)]] = True
        ends = np.cumsum([len(p) for p in packs])
        kept = [p[twice[group[e - len(p) : e]]] for p, e in zip(packs, ends, strict=True)]
        some = [i for i, k in enumerate(kept) if len(k)]
        return pa.table({"bucket": table.column("bucket").take(pa.array(some, pa.int64())), "shard": table.column("shard").take(pa.array(some, pa.int64())), "hashes": pa.array([kept[i].tobytes() for i in some], pa.binary())})

    return requests.groupBy("bucket").applyInArrow(count, "bucket int, shard int, hashes binary")


def _known(replies: pa.Table, width: int) -> np.ndarray:
    """The sorted hashes of a shard's replies, width words each."""
    packs = [np.frombuffer(x, np.uint64) for x in replies.column("hashes").to_pylist()]
    h = np.concatenate(packs).reshape(-1, width) if packs else np.zeros((0, width), np.uint64)
    return h[np.lexsort(h.T[::-1])]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which rows of values are rows of known; rows that share only the first word are stepped over."""
    out = np.zeros(len(values), bool)
    at = np.searchsorted(known[:, 0], values[:, 0]) if len(known) else np.zeros(0, np.int64)
    left = np.arange(len(at))
    while len(left):
        left = left[at[left] < len(known)]
        left = left[known[at[left], 0] == values[left, 0]]
        same = (known[at[left]] == values[left]).all(axis=1)
        out[left[same]] = True
        left = left[~same]
        at[left] += 1
    return out


def _phrases(shard: _Shard, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts at cuts, starts of passages and their ends): the windows that cover what the recurring windows at starts cover."""
    if not len(starts):
        return starts, starts
    breaks = (np.diff(starts) != 1) | (shard.row[starts[1:]] != shard.row[starts[:-1]])
    edge = np.ones(len(starts), bool)
    edge[1:-1] = breaks[1:] | breaks[:-1]
    cut = shard.cuts()[starts]
    return starts[cut], starts[edge & ~cut]


def _sent(cuts: DataFrame) -> DataFrame:
    """(shard, phrases) from cuts (shard, window: hash, phrase: word hashes): one phrase of equal ones, for all shards that have its window."""
    given = cuts.select("window", "phrase").repartition("window").distinct()
    return given.join(cuts.select("window", "shard").distinct().hint("merge"), "window").select("shard", F.col("phrase").alias("phrases"))


def _covered(shard: _Shard, phrases: np.ndarray) -> np.ndarray:
    """Which words of the shard the occurrences of phrases (rows of word hashes) cover: one automaton, through which every document runs."""
    cover = np.zeros(len(shard.hashes) + 1, np.int32)
    vocabulary, code = np.unique(shard.hashes, return_inverse=True)
    at = np.minimum(np.searchsorted(vocabulary, phrases), max(0, len(vocabulary) - 1))
    # a phrase with a word that no document here has cannot occur
    at = at[(vocabulary[at] == phrases).all(axis=1)] if len(vocabulary) else at[:0]
    if len(at):
        # a word is two characters, of different ranges: nodes have few children, which the automaton looks through one by one
        base = math.isqrt(len(vocabulary)) + 1
        spell = lambda x: np.stack([x // base + 1, x % base + base + 2], axis=-1).astype("<u4").tobytes().decode("utf-32-le")
        auto, text, whole = ahocorasick.Automaton(ahocorasick.STORE_LENGTH), spell(at), spell(code)
        for i in range(0, len(text), 2 * WINDOW):
            auto.add_word(text[i : i + 2 * WINDOW])
        auto.make_automaton()
        ends = []
        for lo, hi in zip(shard.first.tolist(), shard.first.tolist()[1:]):  # noqa: B905
            if hi - lo >= WINDOW:
                ends += [lo + (e + 1) // 2 for e, _ in auto.iter(whole[2 * lo : 2 * hi])]
        ends = np.array(ends, np.int64)
        cover[ends - WINDOW] += 1
        np.add.at(cover, ends, -1)
    return np.cumsum(cover[:-1]) > 0


def dedupe(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256[, kept_text]) of every row of documents.

    A word is removed if a recurring window covers it; windows are judged on the input. Null and empty texts have no
    words; texts under WINDOW words lose none; repeated rows repeat each other and lose all words (of WINDOW or more).
    Null ids stay. Other columns do not matter. An empty table gives an empty result.

    Documents are kept as a table bucketed by shard in the warehouse, so the passes over them shuffle no text again; it is
    dropped when the result is written. A text longer than SHARD_BYTES makes a larger shard.
    """
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(SPLIT * parts, size // SHARD_BYTES)
    table_buckets = min(MOST_BUCKETS, max(parts, shards // SHARDS_A_BUCKET))
    words = size // 6
    anchor_buckets = max(LEAST_BUCKETS, words // (WINDOW - GRAM + 1) * 2 // BUCKET)
    window_buckets = max(LEAST_BUCKETS, words // BUCKET)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int"))
    name = f"phrases_{uuid.uuid4().hex}"
    rows.repartition(table_buckets, "shard").write.format("parquet").option("compression", "zstd").bucketBy(table_buckets, "shard").saveAsTable(name)
    texts = spark.table(name)

    def ask_anchors(table: pa.Table) -> pa.Table:
        return _requests(table.column("shard")[0].as_py(), _Shard(table).anchors()[0][:, None], anchor_buckets)

    def ask_windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return _requests(0, np.zeros((0, 2), np.uint64), window_buckets)
        shard = _Shard(table)
        _, window, least = shard.anchors()
        may = window[_among(least[:, None], _known(replies, 1))]
        at, h = shard.long_windows()
        return _requests(table.column("shard")[0].as_py(), h[np.isin(at, may, assume_unique=True)], window_buckets)

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        """The shard's phrases for all shards by window, and for itself (own)."""
        own, number, windows, phrases = np.zeros(0, bool), 0, np.zeros(0, np.uint64), []
        if table.num_rows and replies.num_rows:
            shard = _Shard(table)
            at, h = shard.long_windows()
            cuts, edges = _phrases(shard, at[_among(h, _known(replies, 2))])
            cuts, edges = (x[_groups(h[np.searchsorted(at, x)])[0]] for x in (cuts, edges))
            starts = np.concatenate([cuts, edges])
            own, number = np.repeat([False, True], [len(cuts), len(edges)]), table.column("shard")[0].as_py()
            windows = h[np.searchsorted(at, starts), 0]
            words = shard.hashes[starts[:, None] + np.arange(WINDOW)].tobytes()
            phrases = [words[i : i + 8 * WINDOW] for i in range(0, len(words), 8 * WINDOW)]
        return pa.table({"shard": pa.array(np.full(len(own), number, np.int32)), "own": pa.array(own), "window": pa.array(windows.view(np.int64)), "phrase": pa.array(phrases, pa.binary())})

    columns = ["id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]

    def remove(table: pa.Table, sent: pa.Table) -> pa.Table:
        shard = _Shard(table) if table.num_rows else None
        out: list[list] = [[] for _ in columns]
        if shard:
            gone = _covered(shard, np.frombuffer(b"".join(sent.column("phrases").to_pylist()), np.uint64).reshape(-1, WINDOW))
            raw, offsets, bounds = shard.raw.tobytes(), shard.offsets.tolist(), shard.first.tolist()
            before = np.concatenate([[0], np.cumsum(gone)])[shard.first]
            lost, stays = np.diff(before).tolist(), (~gone).tobytes()
            for i, key in enumerate(table.column("id").to_pylist()):
                lo, hi = bounds[i], bounds[i + 1]
                # bytes are split at the same characters as words end
                words_ = raw[offsets[i] : offsets[i + 1]].split()
                kept = b" ".join(compress(words_, stays[lo:hi]) if lost[i] else words_)
                for column, value in zip(out, (key, hi - lo, lost[i], hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None), strict=False):
                    column.append(value)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=False)], names=columns)

    anchors = written(_recurring(texts.groupBy("shard").applyInArrow(ask_anchors, _REQUEST), 1), "anchors")
    asked = texts.groupBy("shard").cogroup(anchors.groupBy("shard")).applyInArrow(ask_windows, _REQUEST)
    recurring = written(_recurring(asked, 2), "windows")
    phrases = written(texts.groupBy("shard").cogroup(recurring.groupBy("shard")).applyInArrow(cut, "shard int, own boolean, window long, phrase binary"), "cuts")
    sent = _sent(phrases.where("not own")).unionByName(phrases.where("own").select("shard", F.col("phrase").alias("phrases")))
    done = texts.groupBy("shard").cogroup(sent.groupBy("shard")).applyInArrow(remove, "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    done = written(done, "phrases")
    spark.sql(f"DROP TABLE {name}")
    return done.withColumnRenamed("id", id_col)
