"""Folders of transcript documents as a data source of Spark, read whole or as they arrive.

    spark.dataSource.register(TranscriptFiles)
    spark.read.format("transcripts").load(folder)
    spark.readStream.format("transcripts").load(folder)

A row is a segment as the document holds it, with times in seconds.  A stream's offset is the change time and
name of the last file that it took.  Files must not change once they are there; where a writer needs some seconds
to show all files of one moment, `settle` (seconds) leaves younger ones to the next batch.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SEGMENT = "file string, video_id bigint, segment_id bigint, start double, end double, text string, words array<struct<word:string,start:double,end:double,probability:double>>, speaker string"
#: Bytes of documents that one task reads, about.
PART_BYTES = 64 << 20
#: What opening a document counts, in bytes: many small ones are dealt to many tasks.
OPEN_BYTES = 256 << 10


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    paths: tuple[str, ...]


class _Folder:
    """What both readers share: the folder's files in order of arrival, and the rows of a file."""

    def __init__(self, options: dict):
        self.uri, self.suffix, self.settle = options["path"], options.get("suffix", ".json"), float(options.get("settle", "0"))

    def _store(self):
        from pyarrow import fs

        uri = self.uri if not self.uri.startswith("file:/") or self.uri.startswith("file://") else "file://" + self.uri[5:]
        return fs.FileSystem.from_uri(uri)

    def files(self) -> list[tuple[int, str, int]]:
        """(change time in ns, path, size) of the documents, in order."""
        from pyarrow import fs

        store, root = self._store()
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        old = time.time_ns() - int(self.settle * 1e9)
        return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.is_file and f.path.endswith(self.suffix) and not f.base_name.startswith(("_", ".")) and (f.mtime_ns or 0) <= old)

    def parts(self, files: list[tuple[int, str, int]]) -> list[Files]:
        out: list[list[str]] = []
        size = PART_BYTES
        for _, path, n in files:
            if size >= PART_BYTES:
                out.append([])
                size = 0
            out[-1].append(path)
            size += n + OPEN_BYTES
        return [Files(tuple(p)) for p in out]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = self._store()
        seconds = lambda x: None if x is None else float(x)
        for path in partition.paths:
            with store.open_input_file(path) as f:
                document = json.loads(f.read())
            for s in document.get("segments") or []:
                words = [(w.get("word"), seconds(w.get("start")), seconds(w.get("end")), seconds(w.get("probability"))) for w in s.get("words") or []]
                yield path, document.get("video_id"), s.get("id"), seconds(s.get("start")), seconds(s.get("end")), s.get("text"), words, s.get("speaker")


class _Reader(_Folder, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.parts(self.files()) or [Files(())]


class _StreamReader(_Folder, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"ns": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self.files()
        return {"ns": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        lo, hi = (start["ns"], start["path"]), (end["ns"], end["path"])
        return self.parts([f for f in self.files() if lo < f[:2] <= hi]) or [Files(())]

    def commit(self, end: dict) -> None:
        """Nothing is held, so nothing is let go."""


class TranscriptFiles(DataSource):
    """Transcript documents of a folder; options: path, suffix, settle."""

    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return SEGMENT

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)
