"""Walkers over variable-length byte layouts, in Arrow batches; a row for each part.

`walk_together` applies walkers that read the octets of all rows of a batch as one array: every row takes its next step at once,
so a batch costs as many steps as its longest row has parts. `walk` applies one that takes a single byte string and returns its
parts: for formats that a user registers, tables and files. `along_segments` reads connections that come in segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


class Octets:
    """The octets of a column of byte strings: row i is data[starts[i]:ends[i]]; a null row is empty, and not in `there`."""

    def __init__(self, column: pa.Array):
        column = pa.concat_arrays([column.cast(pa.binary())])
        bounds = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64) if len(column) else np.zeros(1, np.int64)
        raw = column.buffers()[2]
        #: Four zeros more, so that a number at the end can be read before its room is checked.
        self.data = np.concatenate([np.frombuffer(raw, np.uint8)[: bounds[-1]] if raw is not None else np.zeros(0, np.uint8), np.zeros(4, np.uint8)])
        self.starts, self.ends = bounds[:-1], bounds[1:]
        self.there = column.is_valid().to_numpy(zero_copy_only=False)

    def number(self, at: np.ndarray, n: int) -> np.ndarray:
        """The n-octet numbers at these places."""
        at = np.minimum(at, len(self.data) - 4)
        out = np.zeros(len(at), np.int64)
        for k in range(n):
            out = out << 8 | self.data[at + k]
        return out


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings data[starts[i]:ends[i]]."""
    sizes = np.maximum(ends - starts, 0)
    to = np.cumsum(sizes)
    at = np.arange(int(to[-1]) if len(to) else 0) + np.repeat(starts - (to - sizes), sizes)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], to]).astype(np.int32)), pa.py_buffer(data[at])])


def texts(values: pa.Array) -> pa.Array:
    """Byte strings as text; what isn't UTF-8 is replaced."""
    try:
        return values.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([v.decode("utf-8", "replace") for v in values.to_pylist()], pa.string())


def in_order(found: list[tuple[np.ndarray, ...]], n_columns: int) -> list[np.ndarray]:
    """Tuples of arrays (owner, …), one for each step, as arrays in the order of owners and, within one, of steps."""
    all_ = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * n_columns
    order = np.argsort(all_[0], kind="stable")
    return [x[order] for x in all_]


def ranks(owner: np.ndarray) -> np.ndarray:
    """The number of each row among those of its owner; owners are in order."""
    heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))[: len(owner)]
    return np.arange(len(owner)) - np.repeat(heads, np.diff(np.append(heads, len(owner))))


Together = Callable[[Octets], tuple[np.ndarray, list]]


def walk_together(df: DataFrame, walker: Together, schema: str, raw: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """`keep` and the columns of `schema`: walker(octets) gives, for all parts, the row each belongs to and the columns."""
    fields = T._parse_datatype_string(schema).fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(T.StructType(fields)).types
        for batch in batches:
            owner, columns = walker(Octets(batch.column(raw)))
            at = pa.array(owner)
            made = [c.cast(k) if isinstance(c, pa.Array) else pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep), *made], [*keep, *(f.name for f in fields)])

    return df.select(*keep, raw).mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), *fields]))


def walk(df: DataFrame, walker: Callable[[bytes], list[tuple]], schema: str, raw: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """`keep` and the columns of `schema`, a row for each tuple that walker(raw) returns. A null column has no parts."""
    fields = T._parse_datatype_string(schema).fields
    names = [f.name for f in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            owners, rows = [], []
            for i, data in enumerate(batch[raw]):
                found = walker(bytes(data)) if data is not None else []
                owners += [i] * len(found)
                rows += found
            out = batch[list(keep)].iloc[owners].reset_index(drop=True)
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            for name, values in zip(names, columns, strict=True):
                out[name] = pd.Series(values, dtype=object)
            yield out

    return df.select(*keep, raw).mapInPandas(run, T.StructType([*(df.schema[c] for c in keep), *fields]))


def rtcp_parts(x: Octets) -> tuple[np.ndarray, list]:
    """(idx, bytes) of the packets back to back in a datagram, while four octets are left; the last may be cut short."""
    row, at, found = np.flatnonzero(x.there), x.starts[x.there], []
    while len(row):
        room = x.ends[row] - at >= 4
        row, at = row[room], at[room]
        next_ = at + 4 * (x.number(at + 2, 2) + 1)
        found.append((row, at, np.minimum(next_, x.ends[row])))
        at = next_
    owner, start, end = in_order(found, 3)
    return owner, [ranks(owner), strings(x.data, start, end)]


def sdes_items(x: Octets) -> tuple[np.ndarray, list]:
    """(chunk, ssrc, type, text) of a source description's items; each chunk ends with a zero octet, on a 32-bit boundary."""
    row = np.flatnonzero(x.there & (x.ends - x.starts >= 4))
    begin = x.starts[row]
    end = np.minimum(x.ends[row], begin + 4 * (x.number(begin + 2, 2) + 1))
    chunks, at = x.number(begin, 1) & 31, begin + 4
    chunk, ssrc, inside, found = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.zeros(len(row), bool), []
    while len(row):
        on = inside | (chunk < chunks) & (end - at >= 4)
        row, begin, end, chunks, at, chunk, ssrc, inside = (v[on] for v in (row, begin, end, chunks, at, chunk, ssrc, inside))
        opens = ~inside
        ssrc = np.where(opens, x.number(at, 4), ssrc)
        kind = x.number(at, 1)
        item = inside & (at < end) & (kind > 0)
        size = np.where(item & (at + 1 < end), x.number(at + 1, 1), 0)
        i = np.flatnonzero(item)
        found.append((row[i], chunk[i], ssrc[i], kind[i], np.minimum(at[i] + 2, end[i]), np.minimum(end[i], at[i] + 2 + size[i])))
        closes = inside & ~item
        at = at + np.where(opens, 4, np.where(item, 2 + size, 4 - (at - begin) % 4))
        chunk, inside = chunk + closes, ~closes
    owner, chunk, ssrc, kind, start, stop = in_order(found, 6)
    return owner, [chunk, ssrc, kind, texts(strings(x.data, start, stop))]


def red_blocks(x: Octets) -> tuple[np.ndarray, list]:
    """(idx, pt, ts_offset, bytes) of a redundant payload: older blocks first, the primary one last with offset 0."""
    row, at, found = np.flatnonzero(x.there & (x.ends > x.starts)), x.starts[x.there & (x.ends > x.starts)], []
    primary, whole = np.zeros(len(x.starts), np.int64), np.zeros(len(x.starts), bool)
    while len(row):
        inside = at < x.ends[row]
        row, at = row[inside], at[inside]
        head = x.number(at, 1)
        last = head < 128
        primary[row[last]], whole[row[last]] = at[last], True
        more = ~last & (at + 4 <= x.ends[row])
        row, at = row[more], at[more]
        word = x.number(at, 4)
        found.append((row, word >> 24 & 127, word >> 10 & 0x3FFF, word & 0x3FF))
        at = at + 4
    done = np.flatnonzero(whole)
    found.append((done, x.number(primary[done], 1) & 127, np.zeros(len(done), np.int64), np.full(len(done), -1)))
    all_ = in_order(found, 4)
    owner, kind, offset, size = (c[whole[all_[0]]] for c in all_)  # a payload that ends within its heads has no blocks
    before = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    idx = ranks(owner)
    start = np.minimum(primary[owner] + 1 + before - before[np.arange(len(owner)) - idx], x.ends[owner])
    end = np.where(size < 0, x.ends[owner], np.minimum(start + size, x.ends[owner]))
    return owner, [idx, kind, offset, strings(x.data, start, end)]


def h264_nals(x: Octets) -> tuple[np.ndarray, list]:
    """(idx, nal_type, start, end, bytes) of an H.264 payload: single units, STAP-A/B, MTAP16/24, and pieces of FU-A/B."""
    there = np.flatnonzero(x.there & (x.ends > x.starts))
    data, kind = x.data.copy(), x.number(x.starts, 1) & 31
    yes = lambda row, v=True: np.full(len(row), v)
    single = there[(kind[there] < 24) | (kind[there] > 29)]
    found = [(single, kind[single], yes(single), yes(single), x.starts[single], x.ends[single])]
    piece = there[(kind[there] == 28) | (kind[there] == 29)]
    piece = piece[x.ends[piece] - x.starts[piece] >= 2]
    head, at = x.number(x.starts[piece] + 1, 1), np.minimum(x.starts[piece] + np.where(kind[piece] == 28, 2, 4), x.ends[piece])
    first = head & 128 > 0
    nal = np.flatnonzero(first)  # the unit's own octet stands before its first piece: put in the place of the one before it
    data[at[nal] - 1] = x.data[x.starts[piece[nal]]] & 0xE0 | head[nal] & 31
    found.append((piece, head & 31, first, head & 64 > 0, at - first, x.ends[piece]))
    row = there[(kind[there] >= 24) & (kind[there] <= 27)]
    skip, at = np.array([0, 0, 3, 4])[kind[row] - 24], x.starts[row] + np.where(kind[row] == 24, 1, 3)
    while len(row):
        room = at + 2 <= x.ends[row]
        row, at, skip = row[room], at[room], skip[room]
        next_ = at + 2 + x.number(at, 2)
        start, end = np.minimum(at + 2 + skip, x.ends[row]), np.minimum(next_, x.ends[row])
        some = end > start
        row, at, skip = row[some], next_[some], skip[some]
        found.append((row, x.number(start[some], 1) & 31, yes(row), yes(row), start[some], end[some]))
    owner, kinds, first, last, start, end = in_order(found, 6)
    return owner, [ranks(owner), kinds, first.astype(bool), last.astype(bool), strings(data, start, end)]


def aac_units(data: bytes, size_bits: int = 13, index_bits: int = 3) -> list[tuple]:
    """(idx, index, size, bytes) of the access units of an audio payload: 16 bits with the length of the headers in bits, a header of
    size and index (or distance to the next) for each unit, then the units. The last unit may be cut short: a fragment."""
    if len(data) < 2:
        return []
    bits = int.from_bytes(data[:2], "big")
    width = size_bits + index_bits
    count, at = bits // width, 2 + -(-bits // 8)
    heads = int.from_bytes(data[2:at].ljust(at - 2, b"\0"), "big") >> (8 * (at - 2) - count * width) if count else 0
    units = []
    for k in range(count):
        head = heads >> (count - 1 - k) * width & (1 << width) - 1
        size = head >> index_bits
        units.append((k, head & (1 << index_bits) - 1, size, data[at : at + size]))
        at += size
    return units


class Interleaved:
    """A connection's octets as they come: `$` frames with their channel; channel -1 for text between them.

    A `$` opens a frame only where one may start: at the beginning, after a frame, or after a message's blank line and body. What
    isn't whole yet is held: a frame, or a message up to the end of its body."""

    def __init__(self):
        self.held, self.at, self.n, self.looked = bytearray(), 0, 0, 0

    def feed(self, data: bytes, last: bool = False) -> list[tuple]:
        """(idx, channel, offset, bytes) of the parts that are whole now; with `last`, of what is left as well, as far as it goes."""
        self.held += data
        held, at, parts = self.held, 0, []
        while at < len(held):
            if held[at] == 0x24:
                stop = at + 4 + int.from_bytes(held[at + 2 : at + 4], "big")
                if at + 4 > len(held) or stop > len(held) and not last:
                    break
                parts.append((self.n, held[at + 1], self.at + at, bytes(held[at + 4 : stop])))
            else:
                head = held.find(b"\r\n\r\n", max(at, self.looked))
                stop = len(held) if head < 0 else head + 4
                if head >= 0:
                    for line in held[at:head].split(b"\r\n"):
                        name, _, value = line.partition(b":")
                        if name.strip().lower() == b"content-length" and value.strip().isdigit():
                            stop = head + 4 + int(value)
                elif not last:
                    self.looked = max(0, len(held) - 3)
                if not last and (head < 0 or stop > len(held)):
                    break
                parts.append((self.n, -1, self.at + at, bytes(held[at:stop])))
            at, self.n, self.looked = stop, self.n + 1, 0
        gone = min(at, len(held))
        del held[:gone]
        self.at, self.looked = self.at + gone, max(0, self.looked - gone)
        return parts


def interleaved(data: bytes) -> list[tuple]:
    """The parts of a connection whose octets are all there."""
    return Interleaved().feed(data, last=True)


#: Parts that along_segments holds before it gives them out.
OUT_ROWS = 10_000


def along_segments(df: DataFrame, open_: Callable[[], Interleaved], schema: str, raw: str, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """keys and the columns of `schema`: the parts of connections (keys) whose octets come in segments (rows, by order), whatever
    the cuts between them. A connection's segments are read one after another; only what isn't whole yet is in memory."""
    fields = T._parse_datatype_string(schema).fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        kinds = to_arrow_schema(T.StructType(fields)).types
        held: list[tuple] = []  # key and part, of all connections of a batch

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), [*head, *kinds], strict=True)], [*keys, *(f.name for f in fields)])
                held.clear()

        for batch in batches:
            head = [batch.schema.field(k).type for k in keys]
            names, data = zip(*(batch.column(k).to_pylist() for k in keys), strict=True), batch.column(raw)
            for i, name in enumerate(names):
                if state is None or name != key:
                    if state is not None:
                        held.extend((*key, *p) for p in state.feed(b"", last=True))
                    key, state = name, open_()
                held.extend((*key, *p) for p in state.feed(data[i].as_py() or b""))
                if len(held) >= OUT_ROWS:
                    yield from out()
            yield from out()
        if state is not None:
            held.extend((*key, *p) for p in state.feed(b"", last=True))
            yield from out()

    laid = df.select(*dict.fromkeys([*keys, *order, raw])).repartition(*keys).sortWithinPartitions(*keys, *order)
    return laid.mapInArrow(run, T.StructType([*(df.schema[c] for c in keys), *fields]))


def capture_entries(data: bytes) -> list[tuple]:
    """(start_us, source, port, offset_ms, is_rtcp, file_offset, bytes) of a binary capture file: a text line, a 16-octet head,
    then entries of length, packet length (0: control) and milliseconds since the start."""
    line = data.find(b"\n")
    if not data.startswith(b"#!rtpplay") or line < 0 or len(data) < line + 17:
        return []
    at = line + 1
    number = lambda a, n: int.from_bytes(data[at + a : at + a + n], "big")
    start, source, port = number(0, 4) * 1_000_000 + number(4, 4), ".".join(map(str, data[at + 8 : at + 12])), number(12, 2)
    at += 16
    entries = []
    while at + 8 <= len(data):
        size, packet = number(0, 2), number(2, 2)
        if size < 8:
            break
        entries.append((start, source, port, number(4, 4), packet == 0, at, data[at + 8 : at + size]))
        at += size
    return entries


def ts_units(data: bytes) -> list[tuple]:
    """(unit_idx, bytes) of the 188-octet units of a transport stream. Units may carry up to 20 octets more, in steps of 4; the first
    place and distance at which eight sync octets follow (or all there are) tell. Later octets that aren't sync are passed over."""
    grids = ((a, n) for a in range(min(212, len(data))) if data[a] == 0x47 for n in range(188, 212, 4) if len(data) >= a + n and all(data[k] == 0x47 for k in range(a, min(len(data), a + 8 * n), n)))
    at, size = next(grids, (0, 188))
    units = []
    while at + 188 <= len(data):
        if data[at] != 0x47:
            at += 1
            continue
        units.append((len(units), data[at : at + 188]))
        at += size
    return units


def pat_programs(data: bytes) -> list[tuple]:
    """(program, pid) of a program association section in a unit's payload (program 0 is the network)."""
    if not data or len(data) < data[0] + 9:
        return []
    at = 1 + data[0]
    if data[at] != 0:
        return []
    end = min(len(data), at + 3 + (int.from_bytes(data[at + 1 : at + 3], "big") & 0xFFF)) - 4
    return [(int.from_bytes(data[k : k + 2], "big"), int.from_bytes(data[k + 2 : k + 4], "big") & 0x1FFF) for k in range(at + 8, end - 3, 4)]
