"""A streaming source of transcripts that grow: only bytes that are new are read.

An offset names each file with the bytes taken from it; a batch takes at most so many files and
bytes more.  A line is taken once its newline is there; a compressed file is taken frame by frame
as it is, from the byte where the last frame ended.  Rows are (path, format, source, position,
line) with the byte at which the line's range began and its place in the range, which order the
lines of a file.
"""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources import files, lines

NAME = "brindle_growing"
SCHEMA = "path string, format string, source string, position long, place long, line string"
#: Most files and bytes that a batch takes.
FILES, BYTES = 1000, 1 << 30


class Part(InputPartition):
    def __init__(self, path: str, kind: str, source: str, start: int, stop: int):
        super().__init__(None)
        self.path, self.kind, self.source, self.start, self.stop = path, kind, source, start, stop


def opened_by_header(path: str) -> bool:
    """The first line that is JSON is a session header."""
    try:
        for _, held in lines.batches(lines.Range(path, 0, 1 << 62)):
            for line in held:
                try:
                    value = json.loads(line)
                except ValueError:
                    continue
                return isinstance(value, dict) and value.get("type") == "session"
    except lines.Broken:
        pass
    return False


def whole_bytes(path: str, start: int) -> int:
    """Bytes up to the last newline (to the end of a compressed file), at least ``start``."""
    size = os.path.getsize(path)
    if lines.compressed(path):
        return max(size, start)
    with open(path, "rb") as f:
        at = size
        while at > start:
            step = min(1 << 16, at - start)
            f.seek(at - step)
            last = f.read(step).rfind(b"\n")
            if last >= 0:
                return at - step + last + 1
            at -= step
    return start


class Growing(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.rules = [files.Rule(**r) for r in json.loads(options["rules"])]
        self.most_files, self.most_bytes = int(options.get("files", FILES)), int(options.get("bytes", BYTES))
        self.progress = options.get("progress")
        self.kinds: dict[str, tuple[str, str]] = {}
        self.taken: dict[str, int] = {}
        if self.progress and os.path.exists(self.progress):
            with open(self.progress) as f:
                self.taken = json.load(f)

    def initialOffset(self) -> dict:
        return {}

    def listed(self) -> list[files.IndexFile]:
        out = []
        for f in files.discover(self.rules):
            if f.path not in self.kinds and f.header and not opened_by_header(f.path):
                continue
            self.kinds[f.path] = (f.format, f.source)
            out.append(f)
        return out

    def latestOffset(self) -> dict:
        n, size = 0, 0
        taken = dict(self.taken)
        for f in self.listed():
            at = taken.get(f.path, 0)
            try:
                stop = whole_bytes(f.path, at)
            except OSError:  # gone since it was listed
                continue
            if stop > at and (n == 0 or (n < self.most_files and size + stop - at <= self.most_bytes)):
                taken[f.path] = stop
                n, size = n + 1, size + stop - at
        self.taken = taken
        return taken

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.taken = {p: max(n, self.taken.get(p, 0)) for p, n in end.items()}
        if any(p not in self.kinds for p in end):
            self.listed()
        return [Part(p, *self.kinds[p], start.get(p, 0), stop) for p, stop in end.items() if stop > start.get(p, 0) and p in self.kinds]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        place = 0
        for held in self.held(part):
            n = len(held)
            columns = [pa.array([x] * n) for x in (part.path, part.kind, part.source)] + [pa.array([part.start] * n, pa.int64()), pa.array(range(place, place + n), pa.int64()), pa.array(held, pa.binary()).cast(pa.string())]
            place += n
            yield pa.RecordBatch.from_arrays(columns, names=["path", "format", "source", "position", "place", "line"])

    def held(self, part: Part) -> Iterator[list[bytes]]:
        """Lines of a part; the file's first broken line ends it."""
        if not lines.compressed(part.path):
            source = lines.batches(lines.Range(part.path, part.start, part.stop))
        else:
            source = lines.batches_of(self.frames(part), part.path)
        try:
            for _, held in source:
                yield held
        except lines.Broken:
            return

    def frames(self, part: Part) -> Iterator[bytes]:
        with open(part.path, "rb") as f:
            f.seek(part.start)
            try:
                yield from io.BufferedReader(pa.CompressedInputStream(pa.PythonFile(f), "zstd"), 1 << 20)
            except OSError as e:
                raise lines.Broken(f"cannot read {part.path}: {e}") from e

    def commit(self, end: dict) -> None:
        if self.progress:
            stage = f"{self.progress}.new"
            with open(stage, "w") as f:
                json.dump(end, f)
            os.replace(stage, self.progress)


class GrowingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Growing:
        return Growing(dict(self.options))


def options(rules: list[files.Rule], progress: str, most_files: int = FILES, most_bytes: int = BYTES) -> dict[str, str]:
    return {"rules": json.dumps([asdict(r) for r in rules]), "progress": progress, "files": str(most_files), "bytes": str(most_bytes)}
