"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

The dot-product heuristic fills one sequence at a time: of the pieces that fit, it places the one whose demands have the
largest weighted dot product with what the sequence has left; weights are the mean demands of the pieces that wait. If no
piece fits and at least MIN_GAP tokens are left, the best piece is cut. Pieces of equal demands form a class, so a
choice is one vectorised look over the classes.

Each task packs its own documents: examples longer than a sequence give whole sequences at once, and the rest is packed in
groups of GROUP pieces. Nothing is shuffled and memory is bounded. At most one sequence of a group stays short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import as_ids, encoded

TOKENS = 1024
SEGMENTS = 64
LOSS = 1024
MIN_GAP = 16
GROUP = 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"


class Example:
    """Token ids with a mark per token that says whether it bears loss (None: all do)."""

    __slots__ = ("key", "ids", "sums")

    def __init__(self, key, ids: np.ndarray, mask: np.ndarray | None = None):
        self.key, self.ids = key, ids
        self.sums = None if mask is None else np.concatenate([[0], np.cumsum(mask != 0)])

    def loss(self, start: int, end: int) -> int:
        return end - start if self.sums is None else int(self.sums[end] - self.sums[start])

    def longest(self, start: int, tokens: int, loss: int) -> int:
        """The longest end of a piece from start within both limits."""
        end = min(len(self.ids), start + tokens)
        if self.sums is None:
            return min(end, start + loss)
        return min(end, int(np.searchsorted(self.sums, self.sums[start] + loss, "right")) - 1)


def place(pieces: list[tuple[Example, int, int]], tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, min_gap: int = MIN_GAP) -> Iterator[list[tuple[Example, int, int]]]:
    """Sequences, each a list of pieces (example, start, end), that hold every token of pieces once."""
    classes: dict[tuple[int, int], list] = {}
    for piece in pieces:
        classes.setdefault((piece[2] - piece[1], piece[0].loss(*piece[1:])), []).append(piece)
    demand = np.array(sorted(classes), dtype=np.float64).reshape(-1, 2)
    members = [classes[int(t), int(x)] for t, x in demand]
    alive = np.array([len(m) for m in members])

    def enter(piece):
        nonlocal demand, alive
        need = (piece[2] - piece[1], piece[0].loss(*piece[1:]))
        if need not in classes:
            classes[need] = []
            demand = np.vstack([demand, need])
            members.append(classes[need])
            alive = np.append(alive, 0)
        at = next(i for i, m in enumerate(members) if m is classes[need])
        members[at].append(piece)
        alive[at] += 1

    total = np.array([(demand[:, 0] * alive).sum(), alive.sum(), (demand[:, 1] * alive).sum()], dtype=np.float64)
    limits = np.array([tokens, segments, loss], dtype=np.float64)
    while alive.any():
        left, out = limits.copy(), []
        while left[1] >= 1 and left[0] >= 1:
            weight = total / max(1.0, total[1]) / limits**2
            score = demand[:, 0] * (weight[0] * left[0]) + weight[1] * left[1] + demand[:, 1] * (weight[2] * left[2])
            waiting = alive > 0
            fits = waiting & (demand[:, 0] <= left[0]) & (demand[:, 1] <= left[2])
            if fits.any():
                at = int(np.argmax(np.where(fits, score, -1)))
                piece = members[at].pop()
                alive[at] -= 1
            elif waiting.any() and left[0] >= min_gap:
                at = int(np.argmax(np.where(waiting, score, -1)))
                example, start, end = members[at][-1]
                cut = example.longest(start, int(left[0]), int(left[2]))
                if cut <= start:
                    break
                members[at].pop()
                alive[at] -= 1
                piece = (example, start, cut)
                total[1] += 1
                enter((example, cut, end))
            else:
                break
            used = np.array([piece[2] - piece[1], 1, piece[0].loss(*piece[1:])], dtype=np.float64)
            left -= used
            total = np.maximum(total - used, 0)
            out.append(piece)
        yield out


def packed(examples: Iterator[tuple[list, list]], part: int, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS) -> Iterator[pa.RecordBatch]:
    """Batches of PIECES. examples: slices of (keys, [Example]); part: the task's number, the high bits of sequence ids."""
    next_id, rows, waiting = part << 36, [], []

    def put(sequence):
        nonlocal next_id
        offset = 0
        for example, start, end in sequence:
            rows.append((example.key, start, end - start, zlib.crc32(example.ids[start:end].tobytes()), len(example.ids), example.loss(start, end), next_id, offset))
            offset += end - start
        next_id += 1

    def batch():
        nonlocal rows
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])
        rows = []
        return out

    for slice_ in examples:
        for example in slice_:
            start = 0
            while len(example.ids) - start >= tokens and example.longest(start, tokens, loss) == start + tokens:
                put([(example, start, start + tokens)])
                start += tokens
            while len(example.ids) - start > tokens or example.loss(start, len(example.ids)) > loss:
                end = example.longest(start, tokens, loss)
                if end <= start:
                    raise ValueError("a limit of no loss-bearing tokens leaves no room")
                waiting.append((example, start, end))
                start = end
            if start < len(example.ids):
                waiting.append((example, start, len(example.ids)))
            if len(waiting) >= GROUP:
                for sequence in place(waiting, tokens, segments, loss):
                    put(sequence)
                waiting = []
        if len(rows) >= 4096:
            yield batch()
    for sequence in place(waiting, tokens, segments, loss):
        put(sequence)
    if rows:
        yield batch()


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def pack_documents(documents: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS) -> DataFrame:
    """PIECES of the whole texts of documents; every token bears loss.

    Null text is empty and gives its end id alone. Rows that repeat an id or a text are packed each. Null ids stay null.
    Sequence ids are unique, not dense. An empty table gives an empty result. Other columns do not matter, whatever their names.
    """

    def run(batches):
        slices = ([Example(k, as_ids(d)) for k, d in zip(keys, data, strict=True)] for keys, data in encoded(batches, tokenizer, end))
        yield from packed(slices, _part(), tokens, segments, loss)

    return documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def pack_examples(examples: DataFrame, id_col: str = "id", ids_col: str = "ids", mask_col: str = "loss", tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS) -> DataFrame:
    """PIECES of instruction data: ids_col array<int> token ids, mask_col array<int>, not 0 where a token bears loss.

    Null ids give no piece; a null mask means that all tokens bear loss; a short mask is filled with 0.
    """

    def run(batches):
        def slices():
            for batch in batches:
                out = []
                for key, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("id", "ids", "mask")), strict=True):
                    ids = np.array(ids or [], "<u4")
                    marks = None if mask is None else np.array((mask + [0] * len(ids))[: len(ids)])
                    out.append(Example(key, ids, marks))
                yield out

        yield from packed(slices(), _part(), tokens, segments, loss)

    return examples.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"), F.col(mask_col).alias("mask")).mapInArrow(run, PIECES)
