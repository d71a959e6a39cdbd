"""A data source of text lines: plain and zstd files in ranges, with line numbers.

``spark.read.format("brindle_lines")`` gives (path, line_no, line).  A plain file is cut into
ranges of bytes and a partition has one range or several small ones; a compressed file is decoded
from its start as it is read.  No file and no range is held whole: lines leave in Arrow batches.

Line numbers of later ranges need the lines before them, so a first pass over files of several
ranges counts lines; the reader's partitions then carry their first number, and no shuffle or join
numbers the lines.

``errors`` says what bytes that cannot be decoded do: with ``fail`` the read raises, with ``skip``
the file ends there (its lines before stay) and the log has a warning.
"""

from __future__ import annotations

import io
import json
import os
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "brindle_lines"
SCHEMA = "path string, line_no int, line string"
COUNTS = "path string, start long, lines long, bad boolean"
#: Bytes of a range, and lines and bytes of an Arrow batch.
RANGE, ROWS, SIZE = 64 << 20, 4096, 4 << 20


@dataclass(frozen=True)
class Range:
    """Lines that begin in bytes start to stop - 1 of a file; the first has number ``first``."""

    path: str
    start: int
    stop: int
    first: int = 1


class Ranges(InputPartition):
    def __init__(self, own: list[Range]):
        super().__init__(None)
        self.own = own


class Broken(ValueError):
    """Bytes of a file that are no text or no compressed frame."""


def compressed(path: str) -> bool:
    return path.endswith(".zst")


def cut(path: str, size: int, step: int) -> list[Range]:
    """A compressed file is one range; an empty one is none."""
    if compressed(path):
        return [Range(path, 0, sys.maxsize)]
    return [Range(path, at, min(at + step, size)) for at in range(0, size, step)]


def opened(r: Range) -> io.BufferedReader:
    """The file at the first line that begins in the range."""
    if compressed(r.path):
        return io.BufferedReader(pa.input_stream(r.path, compression="zstd"), 1 << 20)
    f = open(r.path, "rb", buffering=1 << 20)
    if r.start:
        f.seek(r.start - 1)
        f.readline()
    return f


def raw_lines(r: Range) -> Iterator[bytes]:
    """Lines of a range with their ends; a broken frame raises."""
    try:
        with opened(r) as f:
            at = 0 if compressed(r.path) else f.tell()
            while at < r.stop and (line := f.readline()):
                at += len(line)
                yield line
    except OSError as e:
        raise Broken(f"cannot read {r.path}: {e}") from e


def bare(line: bytes) -> bytes:
    """Without a newline or a carriage return and a newline at its end."""
    if line.endswith(b"\n"):
        line = line[:-1]
        return line[:-1] if line.endswith(b"\r") else line
    return line[:-1] if line.endswith(b"\r") else line


def batches(r: Range) -> Iterator[tuple[int, list[bytes]]]:
    return batches_of(raw_lines(r), r.path, r.first)


def batches_of(lines: Iterator[bytes], path: str, number: int = 1) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, lines) in parts of bounded size; the good ones come before bad bytes raise."""
    held, size, broken = [], 0, None
    while broken is None:
        try:
            line = next(lines, None)
            if line is not None:
                line.decode()
        except Broken as e:
            broken, line = e, None
        except UnicodeDecodeError as e:
            broken, line = Broken(f"cannot read {path}: line {number + len(held)}: {e.reason}"), None
        if line is not None:
            held.append(bare(line))
            size += len(line)
        if held and (line is None or len(held) >= ROWS or size >= SIZE):
            yield number, held
            number, held, size = number + len(held), [], 0
        if line is None:
            break
    if broken is not None:
        raise broken


class LineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.ranges = [Range(*r) for r in json.loads(options["ranges"])]
        self.skip = options.get("errors", "fail") == "skip"
        self.count = options.get("mode", "lines") == "count"
        self.step = int(options.get("range_bytes", RANGE))

    def partitions(self) -> list[Ranges]:
        """Small ranges share a partition; ranges of about the full size have their own."""
        out, own, size = [], [], 0
        for r in self.ranges:
            cost = (os.path.getsize(r.path) if os.path.exists(r.path) else 0) if compressed(r.path) else r.stop - r.start
            cost += self.step // 16  # opening a file costs about as much
            if own and (size + cost > self.step or self.count):
                out.append(Ranges(own))
                own, size = [], 0
            own.append(r)
            size += cost
        return [*out, Ranges(own)] if own else out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for r in partition.own:
            yield from self.counted(r) if self.count else self.lines(r)

    def lines(self, r: Range) -> Iterator[pa.RecordBatch]:
        try:
            for number, held in batches(r):
                columns = [pa.array([r.path] * len(held)), pa.array(range(number, number + len(held)), pa.int32()), pa.array(held, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "line_no", "line"])
        except Broken as e:
            if not self.skip:
                raise
            print(f"skipped the rest: {e}", file=sys.stderr)

    def counted(self, r: Range) -> Iterator[pa.RecordBatch]:
        n, bad = 0, False
        try:
            for _, held in batches(r):
                n += len(held)
        except Broken:
            bad = True
        yield pa.RecordBatch.from_pydict({"path": [r.path], "start": pa.array([r.start], pa.int64()), "lines": pa.array([n], pa.int64()), "bad": [bad]})


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return COUNTS if self.options.get("mode") == "count" else SCHEMA

    def reader(self, schema) -> LineReader:
        return LineReader(dict(self.options))


def load(spark: SparkSession, ranges: list[Range], **options: str) -> DataFrame:
    spark.dataSource.register(LineSource)
    listed = json.dumps([[r.path, r.start, r.stop, r.first] for r in ranges])
    return spark.read.format(NAME).options(ranges=listed, **options).load()


def read(spark: SparkSession, paths: list[str], errors: str = "fail", range_bytes: int = RANGE, running: bool = False) -> DataFrame:
    """(path, line_no from 1, line) of files; ``errors`` is ``fail`` or ``skip``.

    A missing file raises, or has no lines with ``skip``; an empty one has none.  With ``running``
    the numbers go on from one file to the next.
    """
    if errors not in ("fail", "skip"):
        raise ValueError(f"errors must be fail or skip, not {errors}")
    single, several = [], []
    for path in paths:
        try:
            size = os.path.getsize(path)
        except OSError as e:
            if errors == "fail":
                raise Broken(f"cannot read {path}: {e}") from e
            continue
        own = cut(path, size, range_bytes)
        (several if len(own) > 1 or (running and len(paths) > 1) else single).extend(own)
    if several:
        counts = {(r["path"], r["start"]): (r["lines"], r["bad"]) for r in load(spark, several, mode="count", range_bytes=str(range_bytes)).collect()}
        first, ended = {}, set()
        for r in several:
            if r.path in ended:
                continue
            lines, bad = counts[r.path, r.start]
            key = None if running else r.path
            single.append(Range(r.path, r.start, r.stop, first.get(key, 1)))
            first[key] = first.get(key, 1) + lines
            if bad:
                ended.add(r.path)
    if not single:
        return spark.createDataFrame([], SCHEMA)
    return load(spark, single, errors=errors, range_bytes=str(range_bytes))
