"""Token ids of whole texts with a tokenizer file, memoised by pre-token.

A byte-level tokenizer splits a text by a pattern and encodes the pieces one by one, so a text may be cut at any border of
pieces and the pieces' ids kept. Cuts here are before a space, newline, comma or full stop where the character in front
makes that a border; texts where it does not are cut by the pattern itself.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

#: Fixed value: the split pattern of byte-level tokenizer files.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_NOT_A_BORDER = re.compile(r"[ \n](?<=\s.)|[.,](?<=[\W_].)|\x00", re.DOTALL)
#: Entries that a Python worker remembers; a full memory is emptied.
MEMORY = 1_000_000

_encoders: dict[str, Encoder] = {}


class Encoder:
    """encode() gives little-endian unsigned 32-bit ids; special tokens in a text are read as the file says."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if any(s in text for s in self.special):
            return [text]
        if _NOT_A_BORDER.search(text):
            return PATTERN.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").replace(",", "\0,").replace(".", "\0.").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.pieces(t) for t in texts]
        if len(self.known) > MEMORY:
            self.known.clear()
        known = self.known
        new = list(set().union(*cut).difference(known))
        for at in range(0, len(new), 1024):
            part = new[at : at + 1024]
            for piece, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[piece] = array("I", e.ids).tobytes()
        return [b"".join([known[p] for p in pieces]) for pieces in cut]


def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int, id_col: str = "id", text_col: str = "text") -> Iterator[tuple[list, list[bytes]]]:
    """(ids of rows, their token bytes with the end id) in slices of about 1 MB of text."""
    tail = array("I", [end]).tobytes()
    for batch in batches:
        for part in tk.slices(batch, text_col, 1 << 20):
            texts = [t or "" for t in part.column(text_col).to_pylist()]
            yield part.column(id_col).to_pylist(), [b + tail for b in encoder(path).encode(texts)]


def token_ids(documents: DataFrame, path: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids: little-endian unsigned 32-bit) of every row; null text is empty."""

    def run(batches):
        for keys, ids in encoded(batches, path, end):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.binary())], names=["id", "ids"])

    return documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, ids binary")


def as_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4")
