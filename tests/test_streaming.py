"""Streaming operators, fed in several files, against their batch forms."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from mediaflow.operators import sequence
from mediaflow.sources.capture import PACKETS
from mediaflow.sources.derived import packets
from mediaflow.streaming import live

SF = "/root/testdata/sf0.001"
EPOCH = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    p = packets(spark, SF)
    return p.select((F.col("ssrc") % 7).cast("string").alias("stream_id"), "ssrc", "seq", "rtp_ts", "marker", "pt", F.timestamp_millis(F.col("arrival_ms") + 1704067200000).alias("arrival"), "event_id", "copy", "payload_len", "arrival_ms").cache()


def feed(spark, rows, parts=3, closing=True):
    """The rows as files in order of arrival, and a last packet long after."""
    folder = tempfile.mkdtemp(prefix="spark-")
    ordered = [r.asDict() for r in rows.orderBy("arrival", "event_id", "copy").drop("arrival_ms").collect()]
    size = -(-len(ordered) // parts)
    for i in range(parts):
        spark.createDataFrame(ordered[i * size : (i + 1) * size], PACKETS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    if closing:
        for minute in (60, 120):
            last = dict(ordered[-1], ssrc=999999, rtp_ts=1, seq=1, marker=0, arrival=ordered[-1]["arrival"] + dt.timedelta(minutes=minute))
            spark.createDataFrame([last], PACKETS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return f"{folder}/in"


def run(spark, out, name, mode="append"):
    q = out.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def source(spark, rows, closing=True):
    return live.live_packets(spark, feed(spark, rows, closing=closing), files_per_trigger=1)


def test_interval_reports(spark, rows):
    got = run(spark, live.interval_reports(source(spark, rows), late="1 hour"), "t3")
    want = rows.groupBy("ssrc", F.window("arrival", "4960 milliseconds")).agg(F.count("*").alias("packets"), F.sum("payload_len").alias("octets"))
    cols = ["ssrc", "window", "packets", "octets"]
    assert sorted(map(str, got.where("ssrc <> 999999").select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_goodbyes(spark, rows):
    got = run(spark, live.goodbyes(source(spark, rows), timeout="1500 milliseconds", late="1 hour"), "t4")
    want = rows.groupBy("ssrc", F.session_window("arrival", "1500 milliseconds")).agg(F.count("*").alias("packets"))
    assert sorted((r.ssrc, r.first, r.packets) for r in got.where("ssrc <> 999999").collect()) == sorted((r.ssrc, r.session_window.start, r.packets) for r in want.collect())


def two_open(rows):
    """(ssrc, rtp_ts, pt, packets, octets, complete) of each frame, packet by packet: at most two of a source are open."""
    out, held = [], {}
    for r in sorted(rows, key=lambda r: (r.arrival, r.event_id, r.copy)):
        open_ = held.setdefault(r.ssrc, [])
        own = next((f for f in open_ if f["key"] == (r.rtp_ts, r.pt)), None)
        if own is None:
            own = {"key": (r.rtp_ts, r.pt), "sizes": {}, "marker": 0}
            open_.append(own)
            if len(open_) > 2:
                out.append((r.ssrc, open_.pop(0)))
        own["sizes"].setdefault(r.seq, r.payload_len)
        own["marker"] |= r.marker
    out += [(ssrc, f) for ssrc, open_ in held.items() for f in open_]
    whole = lambda seqs: any({(s + i) % 65536 for i in range(len(seqs))} == set(seqs) for s in seqs)
    return sorted((ssrc, *f["key"], len(f["sizes"]), sum(f["sizes"].values()), bool(f["marker"]) and whole(f["sizes"])) for ssrc, f in out)


def test_frames_and_duplicates(spark, rows):
    got = run(spark, live.stream_frames(source(spark, rows), idle_ms=600_000, late="1 hour"), "t1")
    assert sorted((r.ssrc, r.rtp_ts, r.pt, r.packets, r.octets, r.complete) for r in got.where("ssrc <> 999999").collect()) == two_open(rows.collect())
    once = run(spark, live.without_duplicates(source(spark, rows), late="1 hour"), "t7")
    assert once.where("ssrc <> 999999").count() == rows.select("ssrc", "seq", "rtp_ts").distinct().count()


def test_frame_across_half_minutes(spark, rows):
    """With its defaults: four packets of one frame around second 30, in two files."""
    one = [r.asDict() for r in rows.where("copy = 0").orderBy("ssrc", "seq").limit(1).drop("arrival_ms").collect()][0]
    make = lambda i, s, **more: dict(one, seq=i, marker=int(i == 3), event_id=i, arrival=EPOCH + dt.timedelta(seconds=s), **more)
    folder = tempfile.mkdtemp(prefix="spark-") + "/in"
    late = dict(one, ssrc=999999, event_id=9)
    for part in ([make(0, 29), make(1, 29.9)], [make(2, 30.1), make(3, 31)], [dict(late, arrival=EPOCH + dt.timedelta(minutes=5))], [dict(late, arrival=EPOCH + dt.timedelta(minutes=10))]):
        spark.createDataFrame(part, PACKETS).coalesce(1).write.mode("append").parquet(folder)
    got = run(spark, live.stream_frames(live.live_packets(spark, folder)), "t1b").where("ssrc <> 999999").collect()
    assert [(r.packets, r.complete) for r in got] == [(4, True)]


def test_validation_matches_batch(spark, rows):
    got = run(spark, live.validated(source(spark, rows)), "t6").where("ssrc <> 999999")
    want = sequence.source_state(rows)
    assert sorted((r.ssrc, r.event_id, r.copy, r.accepted) for r in got.collect()) == sorted((r.ssrc, r.event_id, r.copy, r.accepted) for r in want.collect())


def test_validation_goes_on_from_a_batch(spark, rows):
    """The first half as a batch, whose states the stream of the second half begins with."""
    middle = rows.selectExpr("percentile(arrival_ms, 0.5)").first()[0]
    first, second = rows.where(rows.arrival_ms <= middle), rows.where(rows.arrival_ms > middle)
    states = live.validation_states(first).withColumn("last", F.col("last") + 1704067200000)
    got = run(spark, live.validated(source(spark, second), initial=states), "t6c").where("ssrc <> 999999")
    want = {(r.ssrc, r.event_id, r.copy): r.accepted for r in sequence.source_state(rows).collect() if r.arrival_ms > middle}
    assert {(r.ssrc, r.event_id, r.copy): r.accepted for r in got.collect()} == want


def test_goodbye_resets_state(spark, rows):
    one = [r.asDict() for r in rows.where("copy = 0").orderBy("ssrc", "seq").limit(1).drop("arrival_ms").collect()][0]
    make = lambda i, seq: dict(one, seq=seq, event_id=i, arrival=one["arrival"] + dt.timedelta(seconds=i))
    data = [make(0, 10), make(1, 11), make(2, 12), make(3, None), make(4, 13), make(5, 14)]
    folder = tempfile.mkdtemp(prefix="spark-") + "/in"
    closing = [dict(one, ssrc=999999, event_id=9, arrival=one["arrival"] + dt.timedelta(hours=h)) for h in (2, 4)]
    for part in (data[:3], data[3:], closing[:1], closing[1:]):
        spark.createDataFrame(part, PACKETS).coalesce(1).write.mode("append").parquet(folder)
    got = {r.event_id: r.accepted for r in run(spark, live.validated(live.live_packets(spark, folder)), "t6b").where("ssrc <> 999999").collect()}
    assert got == {0: False, 1: True, 2: True, 4: False, 5: True}


@pytest.mark.parametrize("parts", [1, 3, 10])
def test_jitter_buffer(spark, rows, parts):
    """The same frames however the packets are cut into batches."""
    stream = live.live_packets(spark, feed(spark, rows, parts=parts), files_per_trigger=1)
    got = run(spark, live.jitter_buffer(stream, timeout_ms=60_000, late="1 hour"), f"t2_{parts}")
    want, held = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.arrival, r.event_id, r.copy)):
        key = (r.ssrc, r.pt, r.rtp_ts)
        own = held.setdefault(key, {})
        if key not in want or not want[key][2]:
            own.setdefault(r.seq, (r.payload_len, r.marker))
            whole = any(m for _, m in own.values()) and any({(s + i) % 65536 for i in range(len(own))} == set(own) for s in own)
            want[key] = (len(own), sum(n for n, _ in own.values()), whole)
    assert {(r.ssrc, r.pt, r.rtp_ts): (r.packets, r.octets, r.complete) for r in got.where("ssrc <> 999999").collect()} == want


def test_match_and_expiry(spark):
    t = lambda s: EPOCH + dt.timedelta(seconds=s)
    schema = "conn_id long, cseq int, ts timestamp, method string, status int, kind string, timeout int"
    data = [(1, 1, t(0), "OPTIONS", None, "q", 5), (1, 1, t(0.5), None, 200, "a", 5), (1, 2, t(20), "PLAY", None, "q", 5), (2, 1, t(3), "PLAY", None, "q", 60), (2, 1, t(50), None, 200, "a", 60), (3, 1, t(4000), "X", None, "q", 1), (3, 1, t(8000), None, 200, "a", 1)]
    folder = tempfile.mkdtemp(prefix="spark-") + "/in"
    for row in data:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(folder)
    read = lambda: spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    got = run(spark, live.match(read().where("kind = 'q'"), read().where("kind = 'a'"), within="30 seconds", late="1 hour"), "t8").collect()
    assert [(r.conn_id, r.cseq, r.status, r.rtt_ms) for r in got] == [(1, 1, 200, 500)]
    ended = run(spark, live.session_expiry(read(), late="10 seconds"), "t5").collect()
    assert {(r.conn_id, r.first, r.messages) for r in ended} >= {(1, t(0), 2), (1, t(20), 1), (2, t(3), 2)}


def test_archive(spark, rows):
    out, check = tempfile.mkdtemp(prefix="spark-") + "/out", tempfile.mkdtemp(prefix="spark-")
    q = live.archive(source(spark, rows, closing=False), out, check)
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(out).groupBy("stream_id").count().count() == 7
    assert spark.read.parquet(out).count() == rows.count()
