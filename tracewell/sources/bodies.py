"""Bodies read where they are used: rows carry the addresses of files, and tasks open those of the rows that are left."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Bytes of bodies that a batch holds before it is passed on.
HELD = 8 << 20


def address() -> Column:
    """The address of the file that a row was read from."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _text(path: str | None) -> str | None:
    """A file's text; None for no path and for a file that is gone."""
    if not path:
        return None
    scheme, colon, rest = path.partition(":")
    system, name = (pafs.LocalFileSystem(), "/" + rest.lstrip("/")) if colon and scheme == "file" else pafs.FileSystem.from_uri(path)
    try:
        with system.open_input_stream(name) as file:
            return file.read().decode("utf-8", "replace")
    except FileNotFoundError:
        return None


def _read(batches: Iterator[pa.RecordBatch], kept: list[str], wanted: dict[str, str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = {body: batch.column(path).to_pylist() for body, path in wanted.items()}
        first, held, texts = 0, 0, {body: [] for body in wanted}
        for row in range(batch.num_rows):
            for body in wanted:
                texts[body].append(_text(paths[body][row]))
                held += len(texts[body][-1] or "")
            if held >= HELD or row + 1 == batch.num_rows:
                part = batch.slice(first, row + 1 - first)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(t, pa.string()) for t in texts.values())], names=[*kept, *wanted])
                first, held, texts = row + 1, 0, {body: [] for body in wanted}


def fetched(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """rows with the texts of files instead of their addresses: wanted names the column of each text and that of its address.

    A null or empty address, and a file that is gone by now, give null. Only files of rows that are there are opened, each by
    the task that has the row; a batch holds some HELD bytes of them. Addresses are of pyarrow's file systems.
    """
    kept = [c for c in rows.columns if c not in wanted.values()]
    schema = StructType([*(rows.schema[c] for c in kept), *(StructField(body, StringType()) for body in wanted)])
    return rows.mapInArrow(lambda batches: _read(batches, kept, wanted), schema)
