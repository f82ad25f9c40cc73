"""Byte and text vectors: packets, control packets, capture files, payload formats, transport streams, session texts."""

import itertools
import os
import random
import struct
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaflow.operators import messages, mpegts, payloads, rtcp, rtp, sdp, walkers
from mediaflow.operators import sequence as sq
from mediaflow.sources import capture
from mediaflow.sources.derived import encode_rtp
from tests import plain_walkers


def raw_frame(spark, *hexes):
    return spark.createDataFrame([(i, bytearray.fromhex(h.replace(" ", ""))) for i, h in enumerate(hexes)], "id int, raw binary")


def test_every_header_round_trips(spark):
    rows = [(i, 2, m, pt, s, t, x) for i, (m, pt, (s, t, x)) in enumerate(itertools.product((0, 1), range(0, 128, 7), ((0, 0, 0), (65535, 4294967295, 4294967295), (37987, 219765193, 2786267044))))]
    df = spark.createDataFrame(rows, "id int, version int, marker int, pt int, seq int, rtp_ts long, ssrc long").withColumn("payload", F.lit(b"xy"))
    got = rtp.decode_header(encode_rtp(df).select("id", "raw")).select("id", "version", "marker", "pt", "seq", "rtp_ts", "ssrc").collect()
    assert sorted(map(tuple, got)) == sorted(rows)


def test_extension_vector(spark):
    df = rtp.decode_header(raw_frame(spark, "90609463 0D1960C9 A6201344 ABAC0003 D4BB8A43 FE7AC81E 00D30000 5C819BC0", "90609463"))
    x = df.select("*", rtp.extension().alias("x"), rtp.payload().alias("p"), rtp.is_complete().alias("c")).orderBy("id").collect()
    assert (x[0].version, x[0].extension, x[0].cc, x[0].marker, x[0].pt, x[0].seq, x[0].rtp_ts, x[0].ssrc) == (2, 1, 0, 0, 96, 37987, 0x0D1960C9, 0xA6201344)
    assert (x[0].x.profile, x[0].x.words, x[0].x.size, bytes(x[0].x.data).hex()) == (0xABAC, 3, 16, "d4bb8a43fe7ac81e00d30000")
    assert bytes(x[0].p).hex() == "5c819bc0" and x[0].c
    assert x[1].rtp_ts is None and x[1].x is None and not x[1].c


@pytest.mark.parametrize("pad", [1, 4, 200, 255])
def test_padding(spark, pad):
    df = rtp.decode_header(raw_frame(spark, "a0600001" + "00" * 8 + "aabb" + "00" * (pad - 1) + f"{pad:02x}"))
    r = df.select(rtp.padding_octets().alias("n"), rtp.payload().alias("p")).first()
    assert (r.n, bytes(r.p)) == (pad, b"\xaa\xbb")


SR = "81c8000c a3368436 d4a6af65 00000000 cbf944d0 00000000 00000000 a3368436 00ffffff 00000000 00000000 00000000 00000000"
RR = "81c90007 69f27950 61379450 ffffffff 00010052 00000ebb ced4c8f5 00008428"
SDES = "81ca0004 69f27950 01064a61 792d5043 00000000"


def test_reports(spark):
    p = rtcp.split(raw_frame(spark, SR, RR + SDES), ("id",)).withColumn("b", rtcp.report_blocks()).withColumn("i", rtcp.sender_info())
    rows = {(r.id, r.idx): r for r in p.collect()}
    sr, rr = rows[0, 0], rows[1, 0]
    assert (sr.ssrc, sr.i.ntp_msw, sr.i.ntp_lsw, sr.i.rtp_ts) == (2738258998, 0xD4A6AF65, 0, 3422110928)
    assert (sr.b[0].source, sr.b[0].fraction, sr.b[0].lost) == (2738258998, 0, -1)
    b = rr.b[0]
    assert (b.source, b.fraction, b.lost, b.highest, b.jitter, b.dlsr) == (1631032400, 255, -1, 65618, 3771, 0x8428)
    items = rtcp.description_items(p, ("id",)).collect()
    assert [(r.source, r.item_type, r.text) for r in items] == [(0x69F27950, 1, "Jay-PC")]
    valid = {r.id: r.valid for r in rtcp.valid_compounds(p, rtcp.description_items(p, ("id",)), "id").collect()}
    assert valid == {0: True, 1: True}


def test_goodbye_and_application(spark):
    df = rtcp.decode_header(raw_frame(spark, "80cb0001 00000007", "81cb0002 00000007 01760000", "81cc0006 4ec87950 71747369 01020304"))
    r = df.select(rtcp.goodbye().alias("g"), rtcp.application().alias("a"), "bc").collect()
    assert r[0].g.sources == [] and r[0].g.reason is None
    assert r[1].g.sources == [7] and r[1].g.reason == "v"
    assert (r[2].a.subtype, r[2].a.name, bytes(r[2].a.data)) == (1, "qtsi", b"\x01\x02\x03\x04")
    bodies = rtcp.decode_bodies(df).collect()
    assert bodies[1].body_203.reason == "v" and bodies[1].body_204 is None and bodies[2].body_204.name == "qtsi"


def test_truncated_bytes_do_not_crash():
    rng = random.Random(4)
    for n in range(0, 60):
        for _ in range(30):
            data = bytes(rng.randrange(256) for _ in range(n))
            for walker in (walkers.aac_units, walkers.interleaved, walkers.capture_entries, walkers.ts_units, walkers.pat_programs):
                walker(data)


def test_source_state_case():
    seqs = [100, 101, 600, 1200, 1201, 1102, 1100]
    rules = sq.Validation()
    got = [rules.take(seq) for seq in seqs]
    assert got == [False, True, True, False, True, False, False]


def test_unwrap_any_partitioning(spark):
    rng = random.Random(1)
    sent = [(65530 + k) % 65536 for k in range(16)]
    order = sorted(range(16), key=lambda k: k + rng.random() * 2)
    rows = [(1, i, i, 0, sent[k]) for i, k in enumerate(order)]
    for n in (1, 5):
        got = sq.unwrap(spark.createDataFrame(rows, "ssrc int, arrival_ms int, event_id int, copy int, seq int").repartition(n)).orderBy("event_id").collect()
        assert [r.ext - 65530 for r in got] == [k + (0 if sent[order[0]] > 60000 else -65536) for k in order]


def test_red_and_h264():
    data = struct.pack(">I", 1 << 31 | 5 << 24 | 160 << 10 | 3) + bytes([96]) + b"abc" + b"primary"
    assert plain_walkers.red_blocks(data) == [(0, 5, 160, b"abc"), (1, 96, 0, b"primary")]
    stap = bytes([24]) + struct.pack(">H", 2) + b"\x65x" + struct.pack(">H", 3) + b"\x41yz"
    assert [(n, b) for _, n, _, _, b in plain_walkers.h264_nals(stap)] == [(5, b"\x65x"), (1, b"\x41yz")]
    mtap = bytes([26, 0, 0]) + struct.pack(">H", 5) + b"\x01\x00\x00" + b"\x65x"
    assert [(n, b) for _, n, _, _, b in plain_walkers.h264_nals(mtap)] == [(5, b"\x65x")]
    first, last = plain_walkers.h264_nals(b"\x7c\x85ab")[0], plain_walkers.h264_nals(b"\x7c\x45cd")[0]
    assert first[1:] == (5, True, False, b"\x65ab") and last[1:] == (5, False, True, b"cd")


def test_key_frames(spark):
    df = spark.createDataFrame([(1, bytearray(b"\x65x")), (1, bytearray(b"\x41x")), (2, bytearray(b"\x41x"))], "frame int, payload binary")
    got = {r.frame: (r.is_key, r.nal_types) for r in payloads.key_frames(payloads.depacketize(df, "h264", keep=("frame",)), ["frame"]).collect()}
    assert got == {1: (True, [1, 5]), 2: (False, [1])}


def test_registries(spark):
    payloads.register("halves", lambda d: [(0, d[: len(d) // 2]), (1, d[len(d) // 2 :])], "idx int, part binary")
    df = spark.createDataFrame([(bytearray(b"abcd"),)], "payload binary")
    assert [bytes(r.part) for r in payloads.depacketize(df, "halves").collect()] == [b"ab", b"cd"]
    rtcp.register(207, lambda raw: F.struct(F.col("bc").alias("kind")))
    try:
        assert rtcp.decode_bodies(rtcp.decode_header(raw_frame(spark, "85cf0001 00000001"))).first().body_207.kind == 5
    finally:
        del rtcp.DECODERS[207]


def test_g711():
    mu, a = payloads.g711_table("mu"), payloads.g711_table("a")
    assert (mu[0xFF], mu[0x7F], mu[0], mu[0x80]) == (0, 0, -32124, 32124)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert np.all(np.sort(mu) == np.sort(-mu.astype(int)))


def test_interleaved(spark):
    frames = b"".join(b"$\x00" + struct.pack(">H", n) + b"p" * n for n in (0, 1, 1400))
    text = b"RTSP/1.0 200 OK\r\nX: $100\r\nContent-Length: 4\r\n\r\n$$$$"
    parts = walkers.interleaved(frames + text + b"$\x01\x00\x02zz")
    assert [(c, len(d)) for _, c, _, d in parts] == [(0, 0), (0, 1), (0, 1400), (-1, len(text)), (1, 2)]
    assert parts[3][3] == text
    rows = capture.split_interleaved(spark.createDataFrame([(9, bytearray(frames + text))], "conn int, raw binary"), ("conn",)).collect()
    assert len(rows) == 4 and all(r.conn == 9 for r in rows)


def test_capture_files(spark):
    rows = [("a", 844525727800600, "10.0.0.4", 5004, i * 10, i == 2, bytearray([0x80, 0, 0, i] + [0] * 8 + [i] * i)) for i in range(4)]
    df = spark.createDataFrame(rows, "stream_id string, start_us long, source string, port int, offset_ms long, is_rtcp boolean, raw binary")
    folder = tempfile.mkdtemp(prefix="spark-")
    capture.write_captures(df, f"{folder}/all")
    assert os.listdir(f"{folder}/all") == ["a.rtp"]
    with open(f"{folder}/all/a.rtp", "rb") as f:
        content = f.read()
    got = capture.read_capture(spark, f"{folder}/all/a.rtp").orderBy("file_offset").collect()
    assert [(r.start_us, r.source, r.port, r.offset_ms, r.is_rtcp, bytes(r.raw)) for r in got] == [(s, a, p, o, c, bytes(b)) for _, s, a, p, o, c, b in rows]
    assert [(r.offset_ms, r.file_offset, bytes(r.raw)) for r in capture.read_capture_whole(spark, f"{folder}/all/a.rtp").collect()] == [(e[3], e[5], e[6]) for e in walkers.capture_entries(content)]
    for form, sizes in (("header", [12, 12, 4, 12]), ("payload", [0, 1, 14, 3])):
        capture.write_captures(df, f"{folder}/{form}", form=form)
        assert [len(r.raw) for r in capture.read_capture(spark, f"{folder}/{form}").orderBy("file_offset").collect()] == sizes
    capture.write_captures(df, f"{folder}/sliced", slice_ms=20)
    assert sorted(os.listdir(f"{folder}/sliced")) == ["a-0.rtp", "a-1.rtp"] and capture.read_capture(spark, f"{folder}/sliced/*.rtp").count() == 4
    short = spark.createDataFrame([("-844525727.800600 954849217 30667",), ("1.5 7",), ("x",)], "value string")
    assert [(r.marker, r.arrival_ms, r.rtp_ts, r.seq) for r in capture.parse_short(short).collect()] == [(1, 844525727800, 954849217, 30667), (0, 1500, 7, None)]


def test_archive(spark):
    folder = tempfile.mkdtemp(prefix="spark-") + "/a"
    capture.archive(spark.range(100).selectExpr("cast(id % 4 as string) as stream_id", "id as seq"), folder)
    assert spark.read.parquet(folder).groupBy("stream_id").count().where("count = 25").count() == 4


@pytest.mark.parametrize("extra", [0, 4, 16, 20])
def test_transport_units(spark, extra):
    unit = bytes([0x47, 0x40, 0, 0x10]) + bytes(184)
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(f"{folder}/x.ts", "wb") as f:
        f.write((unit + b"\x00" * extra) * 9)
    got = mpegts.decode(mpegts.read(spark, f"{folder}/x.ts")).collect()
    assert len(got) == 9 and all((r.pusi, r.pid, r.afc) == (1, 0, 1) for r in got)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_session_texts(spark):
    text = "v=0\r\no=root 3285 3285 IN IP4 10.0.0.4\r\ns=session\r\nc=IN IP4 10.0.0.4\r\nt=0 0\r\nm=audio 12228 RTP/AVP 0 101\r\na=rtpmap:0 PCMU/8000\r\na=rtpmap:101 telephone-event/8000\r\na=fmtp:101 0-16\r\na=ptime:20\r\na=sendrecv\r\n"
    df = spark.createDataFrame([(1, text), (2, "v=0\r\n"), (3, None)], "session_key int, sdp string")
    s = sdp.sessions(df).collect()
    assert [(r.session_key, r.user, r.origin_id, r.address, r.n_media) for r in s] == [(1, "root", 3285, "10.0.0.4", 1)]
    m = sdp.media(df).collect()
    assert [(r.media, r.port, r.n_ports, r.proto, r.pts, r.connection) for r in m] == [("audio", 12228, 1, "RTP/AVP", [0, 101], "IN IP4 10.0.0.4")]
    a = {(r.name, r.pt): r for r in sdp.attributes(sdp.media(df)).collect()}
    assert a["rtpmap", 101].encoding == "telephone-event" and a["rtpmap", 0].clock_rate == 8000 and a["ptime", None].value == "20" and a["sendrecv", None].value is None
    lit = F.lit
    c = one(spark, sdp.connection(lit("IN IP4 232.248.50.1/255/2")).alias("a"), sdp.connection(lit("IN IP4 232.248.50.1/255")).alias("b"))
    assert (c.a.host, c.a.ttl, c.a.addresses, c.b.addresses) == ("232.248.50.1", 255, 2, 1)
    z = one(spark, sdp.zone_adjustments(lit("2882844526 -1h 2898848070 0 0 -3600 0")).alias("z"))
    assert z.z == [2882844526, -3600, 2898848070, 0, 0, -3600, 0]
    r = one(spark, *(sdp.media_range(lit(x)).alias(n) for n, x in (("a", "smpte=10:12:33:20-"), ("b", "smpte-25=10:07:00-10:07:33:05.01"), ("c", "npt=123.45-125"), ("d", "npt=12:05:35.3-"), ("e", "npt=now-"))))
    assert (r.a.type, r.a.start, r.a.end) == ("smpte", 36753.0, None) and (r.b.start, r.b.end) == (36420.0, 36453.0)
    assert (r.c.start, r.c.end, r.d.start, r.e.start, r.e.start_text) == (123.45, 125.0, 43535.3, None, "now")


def test_messages(spark):
    texts = ["ANNOUNCE / RTSP/1.0\r\n\r\n", "GET_PARAMETER * RTSP/1.0\r\nTest: Value\r\n\r\n", "DESCRIBE / RTSP/1.0\r\nSession:\r\n\r\n", "RTSP/1.0 404 Not Found\r\nCSeq: 7\r\n\r\nbody", "nonsense", None]
    rows = messages.parse(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, raw string")).orderBy("id").collect()
    assert [(r.kind, r.method, r.uri, r.status) for r in rows[:5]] == [("request", "ANNOUNCE", "/", None), ("request", "GET_PARAMETER", "*", None), ("request", "DESCRIBE", "/", None), ("response", None, None, 404), ("invalid", None, None, None)]
    assert rows[1].headers == {"test": "Value"} and rows[2].headers == {"session": ""} and rows[3].body == "body" and rows[3].reason == "Not Found"
    t = one(spark, messages.transport(F.lit('RTP/AVP/UDP;unicast;client_port=10000-10001;mode="PLAY"')).alias("a"), messages.transport(F.lit("RTP/AVP;multicast;destination=232.248.50.1;source=10.0.57.24;port=18888-18889;ttl=255")).alias("b"))
    assert (t.a.multicast, t.a.client_low, t.a.client_high, t.a.mode, t.a.ttl) == (False, 10000, 10001, "play", 127)
    assert (t.b.multicast, t.b.destination, t.b.source, t.b.port_low, t.b.port_high, t.b.ttl) == (True, "232.248.50.1", "10.0.57.24", 18888, 18889, 255)


def test_whole_fan_out_and_activity_against_brute_force(spark):
    from collections import Counter

    from mediaflow.jobs import packet_queries as jobs

    sf = "/root/testdata/sf0.001"
    sent = jobs.packets(spark, sf).select("event_id", "copy", "pt").collect()
    by_type = {}
    for c in jobs.contexts(spark, sf).select("session_id", "pt").collect():
        by_type.setdefault(c.pt, []).append(c.session_id)
    want = Counter((p.event_id, p.copy, s) for p in sent for s in by_type.get(p.pt, ()))
    assert want and Counter(map(tuple, jobs.QUERIES["j5_fan_out_all"](spark, sf).collect())) == want
    own = {}
    for r in jobs.routed(spark, sf).where("session_id IS NOT NULL").select("session_id", "arrival_ms", "event_id", "copy").collect():
        own.setdefault(r.session_id, []).append(r)
    want = Counter((s, a.event_id, a.copy, b.event_id, b.copy) for s, rows in own.items() for a in rows for b in rows if 0 <= a.arrival_ms - b.arrival_ms <= 4960)
    got = jobs.QUERIES["j8_activity_all"](spark, sf).select("session_id", "event_id", "copy", "active_event", "active_copy").collect()
    assert want and Counter(map(tuple, got)) == want


def test_frame_beyond_the_cap_is_not_complete(spark):
    """1,500 packets of two octets: more than a frame may hold."""
    from mediaflow.operators import frames, sequence

    rows = [(1, i, i, 3000, int(i == 1499), 96, i, i, 0, bytearray(b"ab"), 2) for i in range(1500)] + [(2, i, i, 3000, int(i == 2), 96, i, i, 0, bytearray(b"cd"), 2) for i in range(3)]
    df = spark.createDataFrame(rows, "ssrc long, seq int, ext long, rtp_ts long, marker int, pt int, arrival_ms long, event_id long, copy int, payload binary, payload_len long")
    ranked = sequence.duplicates(df)
    assert [(r.ssrc, bytes(r.payload), r.truncated) for r in frames.assemble(ranked).collect()] == [(2, b"cdcdcd", False)]
    all_ = {r.ssrc: (len(r.payload), r.truncated) for r in frames.assemble(ranked, complete_only=False).collect()}
    assert all_ == {1: (2048, True), 2: (6, False)}


def test_long_source_in_small_batches(spark):
    """One source in Arrow batches of 100 rows gives the states and jitter of one batch."""
    from mediaflow.operators import sequence

    rows = [(7, i, (65000 + i * (1 if i % 97 else 3)) % 65536, i * 20 + i % 7, 0, i * 160, 8000) for i in range(2500)]
    df = spark.createDataFrame(rows, "ssrc long, event_id long, seq int, arrival_ms long, copy int, rtp_ts long, clock_rate int")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    found = []
    for size in (100, 10000):
        before = spark.conf.get(key)
        spark.conf.set(key, size)
        try:
            found.append((sorted(map(tuple, sequence.source_state(df).collect())), sorted((r.event_id, round(r.jitter, 9)) for r in sequence.jitter(df).collect())))
        finally:
            spark.conf.set(key, before)
    assert found[0] == found[1] and len(found[0][0]) == 2500


def test_malformed_texts_are_told_not_fatal(spark):
    """Numbers that are none or too large, and names that are there twice: nulls with reasons."""
    text = "v=x\r\no=- 0xAB 18446744073709551615 IN IP4 h\r\ns=n\r\nt=now 99999999999999999999\r\nm=audio any RTP/AVP 0 99999999999\r\nc=IN IP4 h/x\r\nb=AS:12345678901234567890\r\na=rtpmap:0 X/8k\r\na=rtpmap:99999999999 Y/8000\r\na=fmtp:0 a=1;a=2;b\r\nr=99999999999999999999d 1h"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "session_key int, sdp string")
    s = sdp.sessions(df, problems="problems").collect()
    assert [(r.version, r.origin_id, r.origin_version, r.start, r.stop, r.problems) for r in s] == [(None, None, None, None, None, ["version", "origin_id", "origin_version", "start", "stop"])]
    m = sdp.media(df, problems="problems")
    one_ = m.select("port", "pts", "problems", sdp.connection(F.col("connection")).alias("c")).first()
    assert (one_.port, one_.pts, one_.problems, one_.c.ttl, one_.c.host) == (None, [0], ["port"], None, "h")
    a = [(r.name, r.pt, r.clock_rate, r.params, r.problems) for r in sdp.attributes(m, problems="problems").orderBy("idx").collect()]
    assert a == [("rtpmap", 0, None, None, ["clock_rate"]), ("rtpmap", None, 8000, None, ["pt"]), ("fmtp", 0, None, {"a": "2", "b": None}, [])]
    assert sdp.bandwidth(m).first().AS is None
    r = spark.range(1).select(sdp.repeat_times(F.lit("99999999999999999999d 1h 0")).alias("r"), sdp.duration(F.lit("9223372036854775807d")).alias("d")).first()
    assert (r.r.interval, r.r.length, r.d) == (0, 3600, 0)
    raw = "PLAY rtsp://h RTSP/1.0\r\nCSeq: 99999999999\r\nSession: a;timeout=99999999999\r\nTransport: RTP/AVP;client_port=99999999999;ssrc=1;ssrc=2\r\nTimestamp: 1.2.3\r\nRTP-Info: url=u;seq=12345678901234567890;ssrc=123456789ab\r\n\r\n"
    p = messages.parse(spark.createDataFrame([(raw,), ("",), (None,)], "raw string"))
    h = messages.header
    got = p.select(messages.cseq().alias("cseq"), messages.session(h("session")).alias("s"), messages.transport(h("transport")).alias("t"), messages.timestamp_delay(h("timestamp")).alias("at"), messages.rtp_info(h("rtp-info")).alias("i"), messages.header_problems().alias("problems")).collect()
    assert (got[0].cseq, got[0].s.timeout, got[0].t.client_low, got[0].t.ssrc, got[0]["at"]["at"], got[0].i[0].seq, got[0].i[0].ssrc) == (None, 60, None, 2, None, None, None)
    assert got[0].problems == ["cseq", "session", "timestamp", "transport", "rtp-info"] and got[1].problems == []
    lines = spark.createDataFrame([("1.5 RTP len=99999999999 from=h seq=99999999999 ts=x ssrc=0x1",), ("99999999999999999999.5 RTP seq=1",)], "value string")
    told = capture.parse_text(lines, problems="problems").collect()
    assert [(r.seq, r.rtp_ts, r.problems) for r in told] == [(None, None, ["length", "seq", "rtp_ts"]), (1, None, ["arrival_ms"])]
    assert capture.parse_short(spark.createDataFrame([("1.5 7 99999999999",)], "value string")).first().seq is None
