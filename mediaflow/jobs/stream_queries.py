"""Streaming operators fed with the derived packets and messages. The rows are written as files in a few slices of event time; after
each, the stream runs until nothing is left and keeps its state in a checkpoint, as a job that is started again does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaflow.functions.storage import new_folder, written
from mediaflow.jobs.packet_queries import EXT, W2_SQL
from mediaflow.jobs.session_queries import MESSAGES, parsed
from mediaflow.sources import capture
from mediaflow.sources.derived import PACKETS, duck, packets
from mediaflow.streaming import live

QUERIES, SQL = {}, {}
#: The source of the packets that come long after all others and close what is open.
CLOSER = -1


def query(name: str, text: str, *parts: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = duck(text, *parts)
        return f

    return add


def replay(rows: DataFrame, at: Column, build: Callable[[DataFrame], DataFrame], slices: int = 3, closing: DataFrame | None = None) -> DataFrame:
    """What build(stream) gives, when rows arrive in slices of `at` (a timestamp), and then each row of `closing`."""
    spark = rows.sparkSession
    rows = written(rows, "arrived")  # read once for each slice
    feed, out, state = (new_folder(spark, k) for k in ("feed", "drained", "state"))
    held = rows.withColumn("__at__", at.cast("double"))
    low, high = held.agg(F.min("__at__"), F.max("__at__")).first()
    step = ((high or 0) - (low or 0)) / slices or 1.0
    number = F.least(F.floor((F.col("__at__") - F.lit(low or 0.0)) / step), F.lit(slices - 1))
    parts = [held.where(number == i).drop("__at__") for i in range(slices)]
    if closing is not None:
        parts += [closing.where(at == r[0]) for r in closing.select(at).distinct().orderBy(at).collect()]
    for part in parts:
        part.write.mode("append").parquet(feed)
        stream = build(spark.readStream.schema(rows.schema).parquet(feed))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """The derived packets with the schema of a live source."""
    p = packets(spark, sf).withColumn("arrival", F.timestamp_millis(F.col("arrival_ms") + 1704067200000)).withColumn("stream_id", (F.col("ssrc") % 7).cast("string"))
    return p.select(*(F.col(f.name).cast(f.dataType) for f in capture.PACKETS.fields))


def closers(rows: DataFrame) -> DataFrame:
    """Two packets of a source of their own, one and two days after the last."""
    last = rows.agg(F.max("arrival").alias("last")).where("last IS NOT NULL")
    days = last.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("d"), "last")
    made = {"ssrc": F.lit(CLOSER), "arrival": F.col("last") + F.make_interval(days=F.col("d")), "seq": F.lit(1), "rtp_ts": F.lit(1), "stream_id": F.lit("closer")}
    return days.select(*(made.get(f.name, F.lit(0)).cast(f.dataType).alias(f.name) for f in capture.PACKETS.fields))


def played(spark: SparkSession, sf: str, build, slices: int = 3, closed: bool = True) -> DataFrame:
    rows = arrivals(spark, sf)
    return replay(rows, F.col("arrival"), build, slices, closers(rows) if closed else None)


@query("s9_live_source", " SELECT CAST(ssrc % 7 AS VARCHAR) AS stream_id, event_id, copy, ssrc, seq, rtp_ts, marker, pt, payload_len FROM packets", PACKETS)
def s9(spark, sf):
    return played(spark, sf, lambda s: s, closed=False).select("stream_id", "event_id", "copy", "ssrc", "seq", "rtp_ts", "marker", "pt", "payload_len")


_ORDERED = ", o AS (SELECT *, row_number() OVER (PARTITION BY ssrc ORDER BY arrival_ms, event_id, copy) AS k FROM unwrapped)"


@query("t1_stream_frames", _ORDERED + """,
fr(ssrc, k, cur, cn, was, wn, own) AS (
  SELECT ssrc, CAST(k AS BIGINT), rtp_ts, 1, CAST(NULL AS BIGINT), CAST(NULL AS INT), 1 FROM o WHERE k = 1
  UNION ALL
  SELECT o.ssrc, CAST(o.k AS BIGINT), CASE WHEN o.rtp_ts = cur OR o.rtp_ts = was THEN cur ELSE o.rtp_ts END, CASE WHEN o.rtp_ts = cur OR o.rtp_ts = was THEN cn ELSE cn + 1 END,
    CASE WHEN o.rtp_ts = cur OR o.rtp_ts = was THEN was ELSE cur END, CASE WHEN o.rtp_ts = cur OR o.rtp_ts = was THEN wn ELSE cn END, CASE WHEN o.rtp_ts = cur THEN cn WHEN o.rtp_ts = was THEN wn ELSE cn + 1 END
  FROM fr JOIN o ON o.ssrc = fr.ssrc AND o.k = fr.k + 1),
one AS (SELECT ssrc, own, pt, rtp_ts, ext, max(marker) AS marker, max(payload_len) AS payload_len FROM fr JOIN o USING (ssrc, k) GROUP BY 1, 2, 3, 4, 5)
SELECT ssrc, pt, rtp_ts, CAST(count(*) AS INT) AS packets, CAST(sum(payload_len) AS BIGINT) AS octets, max(marker) = 1 AND max(ext) - min(ext) + 1 = count(*) AS complete FROM one GROUP BY ssrc, own, pt, rtp_ts""", PACKETS, EXT)
def t1(spark, sf):
    return played(spark, sf, lambda s: live.stream_frames(s, idle_ms=40_000_000, late="1 hour")).where(F.col("ssrc") != CLOSER)


@query("t2_jitter_buffer", """, f AS (SELECT *, row_number() OVER (PARTITION BY ssrc, pt, rtp_ts, ext ORDER BY arrival_ms, event_id, copy) = 1 AS fresh FROM unwrapped),
g AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER v AS n, sum(CASE WHEN fresh THEN payload_len ELSE 0 END) OVER v AS octets, max(ext) OVER v - min(ext) OVER v + 1 AS span, max(CASE WHEN fresh THEN marker END) OVER v AS m, row_number() OVER v AS k
  FROM f WINDOW v AS (PARTITION BY ssrc, pt, rtp_ts ORDER BY arrival_ms, event_id, copy)),
h AS (SELECT ssrc, pt, rtp_ts, min(k) FILTER (span = n AND m = 1) AS whole, max(k) AS last FROM g GROUP BY 1, 2, 3)
SELECT ssrc, pt, rtp_ts, CAST(n AS INT) AS packets, CAST(octets AS BIGINT) AS octets, whole IS NOT NULL AS complete FROM g JOIN h USING (ssrc, pt, rtp_ts) WHERE k = coalesce(whole, last)""", PACKETS, EXT)
def t2(spark, sf):
    got = played(spark, sf, lambda s: live.jitter_buffer(s, timeout_ms=40_000_000, late="1 hour"))
    return got.where(F.col("ssrc") != CLOSER)


@query("t6_stream_validation", W2_SQL.split("SELECT event_id, copy, ssrc, ok")[0] + "SELECT event_id, copy, ssrc, ok AS accepted FROM st", PACKETS)
def t6(spark, sf):
    return played(spark, sf, lambda s: live.validated(s, idle_ms=40_000_000, late="1 hour")).where(F.col("ssrc") != CLOSER).select("ssrc", "event_id", "copy", "accepted")


@query("t7_stream_duplicates", " SELECT DISTINCT ssrc, seq, rtp_ts FROM packets", PACKETS)
def t7(spark, sf):
    return played(spark, sf, lambda s: live.without_duplicates(s, late="1 hour"), closed=False).select("ssrc", "seq", "rtp_ts")


_KEY = "CASE WHEN ask AND conv_id % 11 = 4 THEN NULL ELSE cseq END"


@query("t8_stream_match", f""", k AS (SELECT conv_id, ask, ts_ms, method, {_KEY} AS s FROM q)
SELECT a.conv_id AS conn_id, CAST(a.s AS INT) AS cseq, a.method, 200 AS status, b.ts_ms - a.ts_ms AS rtt_ms FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.s = b.s AND b.ts_ms BETWEEN a.ts_ms AND a.ts_ms + 30000 WHERE a.ask AND NOT b.ask""", MESSAGES)
def t8(spark, sf):
    p = parsed(spark, sf).where("cseq IS NOT NULL").select("conn_id", F.col("cseq").cast("int").alias("cseq"), F.timestamp_millis(F.col("ts_ms") - F.col("conn_id") * 1000000 + 1704067200000).alias("ts"), "method", "status", "kind")
    build = lambda s: live.match(s.where("kind = 'request'"), s.where("kind = 'response'"), within="30 seconds", late="1 hour")
    return replay(p, F.col("ts"), build)  # the connections' clocks set to one time
