"""A streaming source that follows growing files.

An offset holds, for each file, the byte up to which lines were delivered and the
file's generation. Only whole lines are delivered: a half line waits for its end. New
files are found when the source is asked for its latest offset. A file that shrank, or
whose first bytes changed, gets the next generation and is read from the start again;
consumers keep state by (path, generation) and ignore older ones. The folder must be
one that driver and executors both see.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, generation int, byte long, line string"
HEAD = 128


#: Bytes that a task reads, where it has more than one file, and how many opening a file counts for.
PART, OPEN = 1 << 24, 1 << 16


class _Part(InputPartition):
    """Pieces of files: (path, generation, start, end)."""

    def __init__(self, pieces: list[tuple[str, int, int, int]]):
        self.pieces = pieces


def _head(path: str, size: int) -> str:
    with open(path, "rb") as f:
        return hashlib.sha1(f.read(min(HEAD, size))).hexdigest()


def _whole_lines(path: str, start: int) -> int:
    """The byte behind the last line feed at or after ``start``; ``start`` if there is none."""
    with open(path, "rb") as f:
        f.seek(0, os.SEEK_END)
        end = f.tell()
        while end > start:
            at = max(start, end - 65536)
            f.seek(at)
            cut = f.read(end - at).rfind(b"\n")
            if cut >= 0:
                return at + cut + 1
            end = at
    return start


class TailReader(DataSourceStreamReader):
    def __init__(self, pattern: str):
        self.pattern = pattern
        self.last: dict = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        files = {}
        for path in sorted(glob.glob(self.pattern, recursive=True)):
            try:
                size = os.path.getsize(path)
                old = self.last.get(path)
                if old is None:
                    end = _whole_lines(path, 0)
                    files[path] = [0, end, _head(path, end), min(HEAD, end)]
                    continue
                gen, byte, head, n = old
                if size < byte or (n and _head(path, n) != head):
                    gen, byte = gen + 1, 0
                end = _whole_lines(path, byte)
                n = min(HEAD, end)
                files[path] = [gen, end, _head(path, n), n]
            except OSError:
                if path in self.last:
                    files[path] = self.last[path]
        self.last = {**self.last, **files}
        return {"files": json.dumps(self.last, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = json.loads(start["files"]), json.loads(end["files"])
        self.last = {**a, **self.last}  # after a restart the offsets come from the checkpoint
        out, room = [], 0
        for path, (gen, byte, *_) in sorted(b.items()):
            old_gen, old_byte, *_ = a.get(path, [gen, 0])
            first = old_byte if gen == old_gen else 0
            if byte > first:
                cost = byte - first + OPEN
                if cost > room:
                    out.append(_Part([]))
                    room = PART
                out[-1].pieces.append((path, gen, first, byte))
                room -= cost
        return out

    def read(self, partition: _Part):
        for path, generation, start, end in partition.pieces:
            with open(path, "rb") as f:
                f.seek(start)
                at = start
                while at < end:
                    line = f.readline()
                    if not line:
                        break
                    yield path, generation, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                    at += len(line)

    def commit(self, end: dict) -> None:
        """Offsets are kept in the query's checkpoint."""


class TailSource(DataSource):
    """format("transcript_tail").option("pattern", glob)"""

    @classmethod
    def name(cls) -> str:
        return "transcript_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["pattern"].removeprefix("file://"))
