"""Files read in ranges of octets, cut anywhere, against a plain walk; damage, and files of attempts that aren't committed."""

import os
import random
import tempfile

import pytest

from mediaflow.operators import mpegts, walkers
from mediaflow.sources import capture, ranges

HEAD = b"#!rtpplay1.0 10.0.0.4/5004\n" + (844525727).to_bytes(4, "big") + (800600).to_bytes(4, "big") + bytes([10, 0, 0, 4]) + (5004).to_bytes(2, "big") + bytes(2)


def entry(rng, at):
    size = rng.choice([0, 1, 12, 100, 300, 1400, 1400, 1400])
    body = rng.choice([rng.randbytes(size), bytes(size), b"\0\x10\0\x08" * (size // 4), b"text of it " * (size // 11)])
    packet = rng.choice([0, len(body), len(body), len(body) + rng.randrange(90)])
    return (len(body) + 8).to_bytes(2, "big") + packet.to_bytes(2, "big") + at.to_bytes(4, "big") + body


def by_ranges(kind, data, size):
    """(place, octets) of the units, each range read on its own."""
    out = []
    for start in range(0, len(data), size):
        stop = min(len(data), start + size)
        of = kind(data[: ranges.HEAD], len(data))
        read = lambda a, b: data[a:b]
        own = [(base + a, part[a:b]) for base, part, starts, ends, _ in ranges.stretches(of, read, ranges.first_unit(of, read, start), stop) for a, b in zip(starts, ends, strict=True)]
        assert all(start <= p < stop for p, _ in own) or start == 0
        out += own
    return out


@pytest.mark.parametrize("look_back", [1 << 17, 1 << 20])
@pytest.mark.parametrize("chunk", [1 << 17, 8 << 20])
def test_captures_cut_anywhere(monkeypatch, look_back, chunk):
    monkeypatch.setattr(ranges, "LOOK_BACK", look_back)
    monkeypatch.setattr(ranges, "CHUNK", chunk)
    rng = random.Random(look_back + chunk)
    data = HEAD + b"".join(entry(rng, i * 20) for i in range(2500))
    for content in (data, data[:-5], HEAD, HEAD + b"\0\x08\0\0\0\0\0\1"):
        want = [(e[5], content[e[5] : e[5] + 8 + len(e[6])]) for e in walkers.capture_entries(content)]
        for size in (len(content), 300_000, 70_001, 50_000):
            assert by_ranges(ranges.Captures, content, size) == want
    assert by_ranges(ranges.Captures, b"not a capture\n" * 99, 300) == []


def test_damaged_capture():
    rng = random.Random(5)
    own = [entry(rng, i * 20) for i in range(3000)]
    data = HEAD + b"".join(own[:1000]) + b"\0\3\0\0\0\0" + b"".join(own[1000:])  # a length that can't be
    want = {(i, o) for i, o in by_ranges(ranges.Captures, data, len(data))}
    assert len(want) >= 2900  # goes on after the damage
    for size in (400_000, 90_000):
        got = by_ranges(ranges.Captures, data, size)
        assert len(got) == len(set(got)) and len(set(got) ^ want) <= 20


@pytest.mark.parametrize("extra", [0, 4, 16])
def test_units_cut_anywhere(monkeypatch, extra):
    monkeypatch.setattr(ranges, "LOOK_BACK", 4096)
    monkeypatch.setattr(ranges, "CHUNK", 20_000)
    rng = random.Random(extra)
    for fill in ([0x47], [0xAB], [0x47, 0], list(range(256))):
        unit = lambda fill=fill: bytes([0x47, *(rng.choice(fill) for _ in range(187))]) + bytes(extra)
        data = b"".join(unit() for _ in range(700))
        for content in (data, data[100:], data[:60_000] + data[60_333:], data[:-40], data[: 188 * 2], b""):
            want = [u for _, u in walkers.ts_units(content)]
            for size in (len(content) or 1, 50_000, 3001):
                assert [u for _, u in by_ranges(ranges.Units, content, size)] == want, (fill, size)


def test_one_file_in_many_tasks(spark):
    rng = random.Random(1)
    folder = tempfile.mkdtemp(prefix="spark-")
    data = HEAD + b"".join(entry(rng, i * 20) for i in range(6000))
    with open(f"{folder}/x.rtp", "wb") as f:
        f.write(data)
    got = capture.read_capture(spark, folder, range_bytes=500_000)
    assert got.rdd.getNumPartitions() == -(-len(data) // 500_000) > 3
    assert sorted((r.file_offset, r.offset_ms, r.is_rtcp, bytes(r.raw)) for r in got.collect()) == [(e[5], *e[3:5], e[6]) for e in walkers.capture_entries(data)]
    units = b"".join(bytes([0x47, 0, i % 200, 16]) + rng.randbytes(184) for i in range(9000))
    with open(f"{folder}/x.ts", "wb") as f:
        f.write(units)
    rows = mpegts.numbered(mpegts.read(spark, f"file://{folder}/*.ts", range_bytes=300_000), slice_octets=250_000).orderBy("unit_idx").collect()
    assert [(r.unit_idx, r.file_offset, bytes(r.raw)) for r in rows] == [(i, i * 188, units[i * 188 : i * 188 + 188]) for i in range(9000)]
    os.mkdir(f"{folder}/none")
    assert capture.read_capture(spark, f"{folder}/none").count() == 0


def test_only_committed_files_stay(spark):
    folder = tempfile.mkdtemp(prefix="spark-") + "/out"
    bad = spark.range(200).selectExpr("cast(id % 20 as string) as path", "id as unit_idx", "if(id = 77, raise_error('bad'), encode(repeat('x', 188), 'UTF-8')) as raw")
    with pytest.raises(Exception, match="bad"):
        mpegts.write(bad, folder)
    assert not os.path.exists(folder) or os.listdir(folder) == []
    mpegts.write(spark.range(200).selectExpr("cast(id % 20 as string) as path", "id as unit_idx", "encode(lpad(cast(id as string), 188, 'x'), 'UTF-8') as raw"), folder)
    assert sorted(os.listdir(folder)) == sorted(f"{i}.ts" for i in range(20))
    with open(f"{folder}/3.ts", "rb") as f:
        assert [int(x) for x in f.read().decode().replace("x", " ").split()] == list(range(3, 200, 20))
