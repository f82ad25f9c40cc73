"""Walkers that read a batch together against plain ones, and connections in segments cut anywhere."""

import random
import struct

import pyarrow as pa
import pytest

from mediaflow.operators import payloads, walkers
from mediaflow.sources import capture
from tests import plain_walkers as plain


def octets(rng, kind):
    n = rng.choice([0, 1, 2, 3, 4, 5, 8, 30, 90])
    body = bytes(rng.choice([0, 1, 2, 3, 5, 9, 65, 128, 195, 255]) for _ in range(n))
    if kind == "rtcp_parts":
        return b"".join(bytes([128, 200]) + struct.pack(">H", w) + bytes(4 * w) for w in rng.choices(range(4), k=rng.randrange(5))) + body[: rng.randrange(9)]
    if kind == "sdes_items":
        chunks = b"".join(rng.randbytes(4) + (c := b"".join(bytes([rng.randrange(1, 9), k]) + "né".encode()[:k].ljust(k, b"x") for k in rng.choices(range(6), k=rng.randrange(4)))) + bytes(4 - len(c) % 4) for _ in range(rng.randrange(4)))
        return bytes([128 + rng.randrange(5), 202]) + struct.pack(">H", max(0, len(chunks) // 4 + rng.choice([0, 0, -1, 3]))) + chunks + rng.choice([b"", body])
    if kind == "red_blocks":
        heads = b"".join(struct.pack(">I", 1 << 31 | rng.randrange(128) << 24 | rng.randrange(1 << 14) << 10 | rng.choice([0, 3, 9, 1000])) for _ in range(rng.randrange(4)))
        return heads + rng.choice([b"", bytes([rng.randrange(128)])]) + body
    unit = lambda k: struct.pack(">H", k) + rng.randbytes(k)
    return bytes([rng.choice([1, 5, 24, 25, 26, 27, 28, 29, 30, 0]) | rng.choice([0, 96])]) + rng.choice([body, bytes(rng.randrange(3)) + b"".join(unit(k) for k in rng.choices([0, 2, 3, 4, 5, 9], k=3)), rng.randbytes(6)])


@pytest.mark.parametrize("kind", ["rtcp_parts", "sdes_items", "red_blocks", "h264_nals"])
def test_together_as_one_by_one(kind):
    rng = random.Random(kind)
    for n in (0, 1, 700):
        rows = [None if rng.random() < 0.05 else rng.choice([octets(rng, kind), octets(rng, kind)[: rng.randrange(40)]]) for _ in range(n)]
        for column in (pa.array(rows, pa.binary()), pa.array([b"x", *rows], pa.binary()).slice(1)):
            owner, columns = getattr(walkers, kind)(walkers.Octets(column))
            got = list(zip(owner.tolist(), *(c.to_pylist() if isinstance(c, pa.Array) else c.tolist() for c in columns), strict=True))
            want = [(i, *part) for i, row in enumerate(rows) if row is not None for part in getattr(plain, kind)(row)]
            assert got == want


def test_levels_of_odd_payloads(spark):
    rows = [(1, bytearray(b"\x00\xff"), 0), (1, bytearray(b""), 0), (1, None, 8), (2, bytearray(b"\xaa"), 8), (3, bytearray(b""), 8), (4, bytearray(b"x"), 5)]
    got = {r.k: (r.samples, r.peak, r.rms) for r in payloads.g711_levels(spark.createDataFrame(rows, "k int, payload binary, pt int"), ["k"]).collect()}
    assert got[1][:2] == (2, 32124) and got[2] == (1, 32256, 32256.0) and got[3][:2] == (0, 0) and 4 not in got


def connection(rng):
    out = b""
    for _ in range(rng.randrange(12)):
        n = rng.choice([0, 1, 40, 1400])
        body = rng.choice([b"$$$$", b"", b"a\r\n\r\nb"])
        out += rng.choice([b"$" + bytes([rng.randrange(4)]) + struct.pack(">H", n) + rng.randbytes(n), b"RTSP/1.0 200 OK\r\nX: $1\r\nContent-Length: %d\r\n\r\n" % len(body) + body, b"PING\r\n\r\n"])
    return out[: len(out) - rng.choice([0, 0, 3, 9])]


def test_any_cutting_gives_the_same_parts(spark):
    rng = random.Random(6)
    rows = []
    for c in range(150):
        data = connection(rng)
        want = plain.interleaved(data)
        assert walkers.interleaved(data) == want
        state, got, cuts = walkers.Interleaved(), [], sorted(rng.randrange(len(data) + 1) for _ in range(rng.choice([0, 1, 5, 60])))
        for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(data)], strict=True)):
            got += state.feed(data[a:b])
            assert len(state.held) < 1600
            rows.append((c, n, bytearray(data[a:b])))
        assert got + state.feed(b"", last=True) == want
        rows[-1:] = [(*rows[-1][:2], rows[-1][2])]
    whole = {}
    for c, _, part in rows:
        whole[c] = whole.get(c, b"") + bytes(part)
    df = spark.createDataFrame(rows, "conn int, n int, raw binary").repartition(7)
    got = {}
    for r in capture.split_interleaved(df, ("conn",), order=("n",)).collect():
        got.setdefault(r.conn, []).append((r.idx, r.channel, r["at"], bytes(r.part)))
    assert {c: sorted(p) for c, p in got.items()} == {c: p for c, d in whole.items() if (p := plain.interleaved(d))}
    assert capture.split_interleaved(df.where("false"), ("conn",), order=("n",)).count() == 0
