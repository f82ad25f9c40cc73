"""Capture and transport-stream files as Spark data sources: a file is read in byte ranges by many tasks, and written by tasks
that stream, with a commit.

`spark.read.format("media_capture")` and `"media_transport_stream"` (options: path, rangeBytes) cut files into ranges. A range
owns the units that start in it. Where a unit starts is told by its neighbours only, so a range first reads some octets before
itself and follows the chain of units from every place there where one could begin. Chains from false places break or run into
the true one, which never breaks; when a single chain is left at the range's start, that is the true one. While several are
left, the range looks further back, and at last walks from the file's beginning, where the first unit is known. So any cutting
of an intact file gives the same rows. Where a file is damaged (an entry's length can't be), reading goes on at the next place
from which a chain holds for `PROOF` units. A last entry that the file cuts short is given as far as it goes.

`write_captures` and `write_units` write real binary files: a task streams the rows of its keys, in order, to files of its own
under `_temporary`; only the files of the attempts that Spark commits are then moved in place, and an abort removes them.

Files are opened by pyarrow's file systems (local paths, file://, hdfs://, s3://, gs://); paths that only Spark can open are read by
`capture.read_capture_whole` and `mpegts.read_whole`, a file a task.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RANGE_BYTES = 128 << 20
#: Octets that a range first looks back at most (two units' reach, where that is less); doubled while more than one chain is left.
LOOK_BACK, LEAST_BACK = 1 << 20, 1 << 13
#: Beyond this, a range that still can't tell walks the file's units from the first on.
FARTHEST = 64 << 20
#: Octets that tell a file's kind and the distance of its units.
HEAD = 4096
#: Octets read at a time.
CHUNK = 8 << 20
#: Units in a row that tell where to go on after damage.
PROOF = 8
SYNC, UNIT = 0x47, 188
MAGIC = b"#!rtpplay"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path within it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pafs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """Paths (of the given form) and sizes of a file, a folder's files at any depth, or what a pattern in the last part names."""
    import fnmatch

    fs, inner = opened(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    folder, last = posixpath.split(inner.rstrip("/"))
    pattern = last if any(c in last for c in "*?[") else None
    if pattern:
        found = [f for f in fs.get_file_info(pafs.FileSelector(folder)) if fnmatch.fnmatchcase(f.base_name, pattern)]
    else:
        found = [fs.get_file_info(inner)]
        if found[0].type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
    out = []
    for f in found:
        own = fs.get_file_info(pafs.FileSelector(f.path, recursive=True)) if f.type == pafs.FileType.Directory else [f]
        out += [(prefix + x.path, x.size) for x in own if x.type == pafs.FileType.File and not any(p.startswith(("_", ".")) for p in x.path[len(folder) :].split("/"))]
    return sorted(out)


# -- chains of units ---------------------------------------------------------------------------------------------------
class Captures:
    """Entries of a capture file: two octets of length (at least 8), two of the packet's length (0: control), four of time, body."""

    #: A unit starts within so many octets of any place.
    REACH = 1 << 16
    SCHEMA = "path string, start_us long, source string, port int, offset_ms long, is_rtcp boolean, file_offset long, raw binary"

    def __init__(self, head: bytes, size: int):
        """head: the file's first octets."""
        line = head.find(b"\n")
        self.size = size
        self.ok = head.startswith(MAGIC) and 0 <= line and len(head) >= line + 17
        self.first = line + 17 if self.ok else size
        if self.ok:
            seconds, micros, *octets, self.port = struct.unpack_from(">II4BH", head, line + 1)
            self.start_us, self.source = seconds * 1_000_000 + micros, ".".join(map(str, octets))

    def steps(self, data: np.ndarray, at: int) -> np.ndarray:
        """For each place of data (which lies at `at` in the file), how far the next unit is if one starts there; 0: none can."""
        d = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int32)
        size, packet = d[:-4] << 8 | d[1:-3], d[2:-2] << 8 | d[3:-1]
        good = (size >= 8) & ((packet == 0) | (packet >= size - 8))
        good[max(0, self.size - at - 7) :] = False  # no room for a head
        return np.where(good, size, 0)

    def walk(self, data: bytes, stop: int, last: bool) -> tuple[list[int], list[int], int, bool]:
        """Starts and ends within data of units that start before `stop` and end in it, the next unit's start, and whether it can't be
        one. last: data ends with the file, so that a unit may be cut short."""
        at, starts, ends, get = 0, [], [], struct.unpack_from
        while at < stop and at + 8 <= len(data):
            size, packet = get(">HH", data, at)
            if size < 8 or 0 < packet < size - 8:
                return starts, ends, at, True
            if at + size > len(data) and not last:
                break
            starts.append(at)
            at += size
            ends.append(min(at, len(data)))
        return starts, ends, at, False

    def rows(self, path: str, data: bytes, base: int, starts: list[int], ends: list[int]) -> pa.RecordBatch:
        n = len(starts)
        heads = [struct.unpack_from(">HHI", data, a) for a in starts]
        same = lambda x, t: pa.array([x], t).take(pa.array(np.zeros(n, np.int32)))
        return pa.RecordBatch.from_arrays([
            same(path, pa.string()), same(self.start_us, pa.int64()), same(self.source, pa.string()), same(self.port, pa.int32()), pa.array([h[2] for h in heads], pa.int64()),
            pa.array([h[1] == 0 for h in heads], pa.bool_()), pa.array(np.array(starts, np.int64) + base), pa.array([data[a + 8 : b] for a, b in zip(starts, ends, strict=True)], pa.binary()),
        ], ["path", "start_us", "source", "port", "offset_ms", "is_rtcp", "file_offset", "raw"])


class Units:
    """Units of a transport stream: 188 octets from a sync octet on, up to 20 octets more between them. Octets that aren't sync are passed over."""

    REACH = 212
    SCHEMA = "path string, file_offset long, raw binary"

    def __init__(self, head: bytes, size: int):
        self.size, self.ok = size, True
        sync = np.frombuffer(head, np.uint8) == SYNC
        grids = ((a, n) for a in range(min(212, len(sync))) if sync[a] for n in range(UNIT, 212, 4) if len(sync) >= a + n and sync[a : a + 8 * n : n].all())
        #: The first unit and the distance of units: the first place and distance that hold for eight units (or all there are).
        self.first, self.step = next(grids, (0, UNIT))

    def steps(self, data: np.ndarray, at: int) -> np.ndarray:
        return np.where(data == SYNC, self.step, 1)

    def walk(self, data: bytes, stop: int, last: bool) -> tuple[list[int], list[int], int, bool]:
        at, starts = 0, []
        octets = np.frombuffer(data, np.uint8)
        while at < stop:
            if octets[at] != SYNC:
                at = data.find(b"\x47", at, stop)
                if at < 0:
                    at = stop
                    break
            run = octets[at : max(at, min(stop, len(data) - UNIT + 1)) : self.step] == SYNC  # units in a row
            n = len(run) if run.all() else int(run.argmin())
            if not n:
                break
            starts += range(at, at + n * self.step, self.step)
            at += n * self.step
        return starts, [s + UNIT for s in starts], at, False

    def rows(self, path: str, data: bytes, base: int, starts: list[int], ends: list[int]) -> pa.RecordBatch:
        at = np.array(starts, np.int64)
        raw = np.frombuffer(data, np.uint8)[at[:, None] + np.arange(UNIT)]
        binary = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.arange(0, UNIT * len(at) + 1, UNIT, dtype=np.int32)), pa.py_buffer(raw)])
        return pa.RecordBatch.from_arrays([pa.array([path]).take(pa.array(np.zeros(len(at), np.int32))), pa.array(at + base), binary], ["path", "file_offset", "raw"])


def reaching(kind: Captures | Units, read, low: int, start: int) -> np.ndarray:
    """The first places at `start` or after it of all chains that may be the true one, followed from `low` on (the file's first unit, or
    any place after it); none if all break."""
    n = start - low
    steps = kind.steps(np.frombuffer(read(low, min(kind.size, start + 8)), np.uint8), low)[:n].tolist()
    passed = bytearray(n + kind.REACH)
    may = 1 if low == kind.first else min(kind.REACH, n)  # where the chain may be
    passed[:may] = b"\1" * may
    at = 0
    while 0 <= at < n:
        if steps[at]:
            passed[at + steps[at]] = 1
        at = passed.find(1, at + 1)
    return np.flatnonzero(np.frombuffer(passed, np.uint8)[n:]) + start


def least_back(kind: Captures | Units) -> int:
    return min(LOOK_BACK, max(LEAST_BACK, 2 * kind.REACH))


def first_unit(kind: Captures | Units, read, start: int) -> int:
    """The place of the first unit at `start` or after it. read(a, b) gives the file's octets from a to b."""
    back = least_back(kind)
    while start > kind.first and back <= FARTHEST:
        low = max(kind.first, start - back)
        at = reaching(kind, read, low, start)
        if len(at) == 1:
            return int(at[0])
        if low == kind.first:
            break
        back *= 2
    at = kind.first
    for _, _, _, _, at in stretches(kind, read, at, start):  # damaged, or alike everywhere: by the file's units from the first on
        pass
    return at


def onward(kind: Captures | Units, read, places: list[int], stop: int) -> dict[int, int]:
    """For chains from these places the first place at `stop` or after it; those that break are left out. Chains that meet are
    followed once from there on."""
    now = {p: p for p in places}
    low = min(places, default=stop)
    while low < stop:
        high = min(stop, low + LOOK_BACK)
        steps = kind.steps(np.frombuffer(read(low, min(kind.size, high + 8)), np.uint8), low).tolist()
        ends: list[int | None] = []
        passed: dict[int, int] = {}
        left: dict[int, int | None] = {}
        for place in sorted({p for p in now.values() if p < high}):
            at = place
            while at < high and at not in passed:
                passed[at] = len(ends)
                step = steps[at - low]
                if not step:
                    break
                at += step
            ends.append(at if at >= high else ends[passed[at]] if passed[at] < len(ends) else None)
            left[place] = ends[-1]
        now = {origin: end for origin, p in now.items() if (end := left.get(p, p)) is not None}
        low = high
    return now


def resumed(kind: Captures | Units, read, at: int) -> int:
    """The first place at `at` or after it from which PROOF units follow one another, as far as the octets at hand tell."""
    while at < kind.size:
        steps = kind.steps(np.frombuffer(read(at, min(kind.size, at + CHUNK)), np.uint8), at)
        place, alive = np.arange(len(steps), dtype=np.int64), steps > 0
        for _ in range(PROOF):
            step = np.where(place < len(steps), steps[np.minimum(place, len(steps) - 1)], -1)
            alive &= step != 0
            place += np.maximum(step, 0)
        if alive.any():
            return at + int(alive.argmax())
        at += len(steps)
    return kind.size


def stretches(kind: Captures | Units, read, at: int, stop: int) -> Iterator[tuple[int, bytes, list[int], list[int], int]]:
    """The units from the one at `at` on that start before `stop`: where some octets lie, these, the starts and ends of units in them,
    and the place of the next unit."""
    while at < stop:
        high = min(kind.size, at + CHUNK)
        data = read(at, high)
        starts, ends, next_, broken = kind.walk(data, min(stop, high) - at, high == kind.size)
        base = at
        at = resumed(kind, read, base + next_ + 1) if broken else base + next_
        if not next_ and not broken:  # what is left is no whole unit
            at = kind.size
        yield base, data, starts, ends, at


@dataclass
class Range:
    path: str
    size: int
    start: int
    stop: int
    #: The place of its first unit, where that is known.
    first: int | None = None


def ranges_of(path: str, octets: int) -> list[Range]:
    return [Range(p, size, a, min(size, a + octets)) for p, size in files(path) for a in range(0, size, octets)]


def at_range(kind: type, r: Range, ask):
    """ask(the file's kind, a function that reads from it), or none if it isn't such a file."""
    fs, inner = opened(r.path)
    with fs.open_input_file(inner) as f:
        read = lambda a, b: f.read_at(b - a, a)
        of = kind(read(0, min(r.size, HEAD)), r.size)
        return ask(of, read) if of.ok else None


def first_units(spark: SparkSession, kind: type, path: str, octets: int) -> dict[str, list[int | None]]:
    """The first units of the ranges of all files that have several, by path; none where a chain breaks before."""
    several = [r for r in ranges_of(path, octets) if r.size > octets]
    each = lambda asked, ask: spark.sparkContext.parallelize(asked, max(1, min(len(asked), 4 * spark.sparkContext.defaultParallelism))).map(ask).collect() if asked else []

    def starts(r: Range) -> list[int]:
        return at_range(kind, r, lambda of, read: [of.first] if r.start <= of.first else reaching(of, read, max(of.first, r.start - least_back(of)), r.start).tolist()) or []

    own = each(several, starts)
    # where a range's chains lead matters if the one after it can't tell by itself
    open_ = [(r, places) for r, places, after, next_ in zip(several, own, several[1:], own[1:], strict=False) if after.start and len(next_) > 1]
    ways = dict(zip(((r.path, r.stop) for r, _ in open_), each(open_, lambda x: at_range(kind, x[0], lambda of, read: onward(of, read, x[1], x[0].stop)) or {}), strict=True))
    out: dict[str, list[int | None]] = {}
    for r, places in zip(several, own, strict=True):
        known = out.setdefault(r.path, [])
        known.append(places[0] if len(places) == 1 else ways.get((r.path, r.start), {}).get(known[-1]) if known else None)
    return out


@dataclass
class Ranges(InputPartition):
    """What one task reads: a range of a large file, or several small files."""

    parts: list[Range]


class RangeReader(DataSourceReader):
    def __init__(self, options: dict, kind: type):
        self.path, self.bytes, self.kind = options["path"], int(options.get("rangebytes") or RANGE_BYTES), kind
        #: The first units of ranges, by path (first_units).
        self.first = json.loads(options.get("firstunits") or "{}")

    def partitions(self) -> list[Ranges]:
        out, octets = [], self.bytes
        for r in ranges_of(self.path, self.bytes):
            known = self.first.get(r.path, ())
            if len(known) == -(-r.size // self.bytes):
                r.first = known[r.start // self.bytes]
            own = r.stop - r.start
            if octets + own > self.bytes:
                out.append(Ranges([]))
                octets = 0
            out[-1].parts.append(r)
            octets += own
        return out

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        for r in partition.parts if partition else ():  # without files there is no partition
            fs, inner = opened(r.path)
            with fs.open_input_file(inner) as f:

                def read(a: int, b: int, f=f) -> bytes:
                    return f.read_at(b - a, a)

                kind = self.kind(read(0, min(r.size, HEAD)), r.size)
                if kind.ok:
                    first = first_unit(kind, read, r.start) if r.first is None else r.first
                    for base, data, starts, ends, _ in stretches(kind, read, first, r.stop):
                        if starts:
                            yield kind.rows(r.path, data, base, starts, ends)


class CaptureSource(DataSource):
    """Entries of capture files."""

    KIND = Captures

    @classmethod
    def name(cls) -> str:
        return "media_capture"

    def schema(self) -> str:
        return self.KIND.SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader(dict(self.options), self.KIND)

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(dict(self.options))


class UnitSource(CaptureSource):
    """Units of transport-stream files."""

    KIND = Units

    @classmethod
    def name(cls) -> str:
        return "media_transport_stream"


def read_ranges(spark: SparkSession, source: type[CaptureSource], path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(source)
    known = json.dumps(first_units(spark, source.KIND, path, range_bytes))
    return spark.read.format(source.name()).option("rangeBytes", range_bytes).option("firstUnits", known).load(path)


# -- writing -----------------------------------------------------------------------------------------------------------
@dataclass
class Written(WriterCommitMessage):
    #: (where a file is, where it goes)
    moves: list[tuple[str, str]]


def _octets(bodies: pa.Array) -> bytes | memoryview:
    """The bodies one after another, as they lie in the array."""
    bodies = (bodies.fill_null(b"") if bodies.null_count else bodies).cast(pa.large_binary())
    _, offsets, data = bodies.buffers()
    at = np.frombuffer(offsets, np.int64)[bodies.offset : bodies.offset + len(bodies) + 1]
    return memoryview(data)[at[0] : at[-1]] if data is not None else b""


class FileWriter(DataSourceArrowWriter):
    """Rows (name, head, body) in runs of one name: the first row's head and every body, in order, as one file of that name."""

    def __init__(self, options: dict):
        self.folder, self.suffix, self.job = options["path"].rstrip("/"), options.get("suffix", ""), uuid.uuid4().hex

    @property
    def temporary(self) -> str:
        return f"{self.folder}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, inner = opened(self.temporary)
        _, target = opened(self.folder)
        attempt, moves, name, out = uuid.uuid4().hex, [], None, None
        try:
            for batch in iterator:
                ran = pc.run_end_encode(batch.column(0))
                stops = ran.run_ends.to_pylist()
                for i, stop, own in zip([0, *stops], stops, ran.values.to_pylist(), strict=False):
                    if out is None or own != name:
                        if out is not None:
                            out.close()
                        name = own
                        moves.append((f"{inner}/{attempt}-{len(moves)}", f"{target}/{own}{self.suffix}"))
                        fs.create_dir(inner, recursive=True)
                        out = fs.open_output_stream(moves[-1][0])
                        out.write(batch.column(1)[i].as_py() or b"")
                    out.write(_octets(batch.column(2).slice(i, stop - i)))
        finally:
            if out is not None:
                out.close()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        fs, inner = opened(self.temporary)
        fs.create_dir(opened(self.folder)[1], recursive=True)
        for message in messages:
            for here, there in message.moves if message else []:
                fs.create_dir(posixpath.dirname(there), recursive=True)
                fs.move(here, there)
        self._clean(fs, inner)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*opened(self.temporary))

    @staticmethod
    def _clean(fs: pafs.FileSystem, inner: str) -> None:
        if fs.get_file_info(inner).type == pafs.FileType.Directory:
            fs.delete_dir(inner)
        above = posixpath.dirname(inner)
        if fs.get_file_info(above).type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(above)):
            fs.delete_dir(above)


def write_files(rows: DataFrame, folder: str, source: type[CaptureSource], name: Column, head: Column, body: Column, order: tuple[str, ...], suffix: str) -> None:
    """A file of each name: its rows meet in one task and are sorted there, and stream to the file."""
    rows.sparkSession.dataSource.register(source)
    named = rows.select(name.cast("string").alias("__name__"), head.alias("__head__"), body.alias("__body__"), *(F.col(c).alias(f"__{i}__") for i, c in enumerate(order)))
    laid = named.repartition("__name__").sortWithinPartitions("__name__", *(f"__{i}__" for i in range(len(order))))
    laid.select("__name__", "__head__", "__body__").write.format(source.name()).mode("append").option("suffix", suffix).save(folder)
