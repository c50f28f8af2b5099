"""One JSON file per conversation: a Python data source that streams sorted pieces of documents to files.

Rows are (file, part, thread, kind, place, json), all of a file in one task and in order. A task writes to a folder of its
own and holds one row at a time, so a conversation of any length takes no memory. The job's commit moves the files of the tasks
that count to their place; an abort removes what was begun.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

PIECES = "file string, part int, thread string, kind int, place long, json string"
ORDER = ("file", "part", "thread", "kind", "place")
#: Parts of a document, and kinds of rows in threads.
HEAD, INVOCATION, MAIN, SIDE = range(4)
THREAD, TURN = range(2)
BEGUN = "_begun"


class Document:
    """Writes the pieces of one document, one after the other."""

    def __init__(self, out):
        self.out, self.part, self.first, self.thread = out, None, True, False

    def _put(self, text: str) -> None:
        self.out.write(text.encode())

    def _enter(self, part: int) -> None:
        """Closes what is open before part and opens it."""
        if self.part == part:
            return
        if self.part is None:
            self._put("{")
        elif self.part == HEAD:
            self._put(',"invocations":[' if part == INVOCATION else ',"invocations":[]')
        elif self.part == INVOCATION:
            self._put("]")
        if part in (MAIN, SIDE) and self.part in (HEAD, INVOCATION):
            self._put(',"conversation":' + ("null" if part == SIDE else ""))
        if part == SIDE:
            self._leave()
            self._put(',"sidechains":[')
        self.part, self.first = part, True

    def _leave(self) -> None:
        if self.thread:
            self._put("]}" if self.part == MAIN else "]}}")
        self.thread = False

    def add(self, part: int, kind: int, json: str) -> None:
        self._enter(part)
        if part == HEAD:
            self._put(json[1:-1])
        elif part == INVOCATION or kind == TURN:
            self._put(json if self.first else "," + json)
            self.first = False
        else:
            if part == SIDE and self.thread:
                self._leave()
                self._put(",")
            # a side thread's row is {"id": ..., "conversation": {...}}
            body = json[: -1 if part == MAIN else -2]
            self._put(body + ("" if body.endswith("{") else ",") + '"turns":[')
            self.thread, self.first = True, True

    def end(self) -> None:
        if self.part == HEAD:
            self._put(',"invocations":[],"conversation":null')
        elif self.part == INVOCATION:
            self._put('],"conversation":null')
        self._leave()
        self._put("]}\n" if self.part == SIDE else "}\n")


@dataclass
class Written(WriterCommitMessage):
    """A task's folder and how many files it holds."""

    folder: str
    files: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def _place(self) -> tuple[pafs.FileSystem, str]:
        system, base = pafs.FileSystem.from_uri(self.path)
        return system, base.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, base = self._place()
        folder = f"{base}/{BEGUN}-{self.job}/{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
        now, out, document, files = None, None, None, 0
        try:
            for batch in iterator:
                columns = [batch.column(c) for c in ("file", "part", "kind", "json")]
                for row in range(batch.num_rows):
                    file, part, kind, json = (c[row].as_py() for c in columns)
                    if file != now:
                        if document:
                            document.end()
                            out.close()
                        if not files:
                            system.create_dir(folder, recursive=True)
                        now, out, files = file, system.open_output_stream(f"{folder}/{posixpath.basename(file)}"), files + 1
                        document = Document(out)
                    document.add(part, kind, json)
            if document:
                document.end()
                out.close()
        except BaseException:
            if out:
                out.close()
            if files:
                system.delete_dir(folder)
            raise
        return Written(folder, files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = self._place()
        system.create_dir(base, recursive=True)
        for message in messages:
            if message and message.files:
                for info in system.get_file_info(pafs.FileSelector(message.folder)):
                    system.move(info.path, f"{base}/{info.base_name}")
        self._remove(system, base)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._remove(*self._place())

    def _remove(self, system: pafs.FileSystem, base: str) -> None:
        begun = f"{base}/{BEGUN}-{self.job}"
        if system.get_file_info(begun).type == pafs.FileType.Directory:
            system.delete_dir(begun)


class ConversationFiles(DataSource):
    """Writes PIECES to the folder of option path (an address that pyarrow's file systems know, shared by all executors)."""

    @classmethod
    def name(cls) -> str:
        return "conversation_files"

    def schema(self) -> str:
        return PIECES

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


def write(pieces: DataFrame, path: str) -> None:
    """Writes pieces (PIECES) as files of the folder path; a file that is there is replaced."""
    pieces.sparkSession.dataSource.register(ConversationFiles)
    dealt = pieces.select(*(c.split()[0] for c in PIECES.split(", "))).repartition("file").sortWithinPartitions(*ORDER)
    dealt.write.format("conversation_files").mode("append").option("path", path).save()
