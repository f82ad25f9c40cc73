"""Queries over control packets. Each source and interval of the derived packets gives one datagram: a sender report with a
block, a description, and by the interval a goodbye, an application packet or feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaflow.functions.bits import be
from mediaflow.jobs.packet_queries import REPORTS
from mediaflow.operators import reports, rtcp
from mediaflow.sources.derived import PACKETS, duck, packets

QUERIES, SQL = {}, {}
C = REPORTS + ", c AS (SELECT *, ssrc * 100000 + bucket AS compound_id, 3900000000 + arrival_ms // 1000 AS msw, arrival_ms % 1000 * 4294967 AS lsw, CAST(bucket % 4 AS INT) AS k FROM sr)"


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = duck(C + sql, PACKETS)
        return f

    return add


def datagrams(spark, sf):
    """compound_id, raw."""
    r = reports.sender_reports(packets(spark, sf)).withColumn("compound_id", F.col("ssrc") * 100000 + F.col("bucket")).withColumn("k", F.col("bucket") % 4)
    b, s = F.col("bucket"), F.col("ssrc")
    head = lambda bc, pt, words: F.concat(be(128 + bc, 1), be(pt, 1), be(words, 2))
    lost = F.pmod(b % 7 - 3, F.lit(1 << 24))
    sr = F.concat(
        head(1, 200, 12), be(s, 4), be(F.floor(F.col("arrival_ms") / 1000) + 3900000000, 4), be(F.col("arrival_ms") % 1000 * 4294967, 4), be(F.col("rtp_ts"), 4), be(F.col("packets_so_far"), 4), be(F.col("octets_so_far"), 4),
        be(s + 1, 4), be(b % 256, 1), be(lost, 3), be(F.col("packets_so_far") + 65536, 4), be(b * 3, 4), be(s, 4), be(b, 4),
    )
    name = F.concat(F.lit("user"), s.cast("string"), F.lit("@host"))
    size = F.octet_length(name)
    chunk = F.concat(be(s, 4), be(1, 1), be(size, 1), F.encode(name, "UTF-8"))
    pad = 4 - (size + 2) % 4
    words = F.floor((4 + 2 + size + pad) / 4)
    sdes = F.concat(head(1, 202, words), chunk, F.unhex(F.repeat(F.lit("00"), pad)))
    bye = F.concat(head(1, 203, 3), be(s, 4), be(7, 1), F.encode(F.rpad(F.concat(F.lit("b"), b.cast("string")), 7, "."), "UTF-8"))
    app = F.concat(head(1, 204, 3), be(s, 4), F.encode(F.lit("qtsi"), "UTF-8"), be(b, 4))
    nack = F.concat(head(1, 205, 3), be(s, 4), be(s + 2, 4), be(b % 65536, 2), be(5, 2))
    pli = F.concat(head(1, 206, 2), be(s, 4), be(s + 2, 4))
    k = F.col("k")
    return r.select("compound_id", F.concat(sr, sdes, F.when(k == 0, bye).when(k == 1, app).when(k == 2, nack).otherwise(pli)).alias("raw"))


def parts(spark, sf):
    return rtcp.split(datagrams(spark, sf), ("compound_id",))


_ALL = """, a AS (SELECT compound_id, 0 AS idx, 200 AS pt, 1 AS bc, 12 AS words, ssrc FROM c
UNION ALL SELECT compound_id, 1, 202, 1, CAST((6 + 9 + length(CAST(ssrc AS VARCHAR)) + 4 - (11 + length(CAST(ssrc AS VARCHAR))) % 4) // 4 AS INT), ssrc FROM c
UNION ALL SELECT compound_id, 2, CASE k WHEN 0 THEN 203 WHEN 1 THEN 204 WHEN 2 THEN 205 ELSE 206 END, 1, CASE k WHEN 3 THEN 2 ELSE 3 END, ssrc FROM c)"""


@query("d8_split_rtcp", _ALL + " SELECT compound_id, idx, pt, 4 * (words + 1) AS octets FROM a")
def d8(spark, sf):
    return parts(spark, sf).select("compound_id", "idx", F.col("rtcp_pt").alias("pt"), F.octet_length("raw").alias("octets"))


@query("d9_rtcp_header", _ALL + " SELECT compound_id, idx, 2 AS version, 0 AS padding, bc, pt, words, ssrc FROM a")
def d9(spark, sf):
    return parts(spark, sf).select("compound_id", "idx", "version", "padding", "bc", F.col("rtcp_pt").alias("pt"), "words", "ssrc")


@query("d10_sender_info", " SELECT compound_id, ssrc, msw AS ntp_msw, lsw AS ntp_lsw, rtp_ts, packets_so_far AS packets, octets_so_far AS octets FROM c")
def d10(spark, sf):
    p = parts(spark, sf).where("rtcp_pt = 200")
    return p.select("compound_id", "ssrc", rtcp.sender_info().alias("i")).select("compound_id", "ssrc", "i.*")


@query("d11_report_blocks", " SELECT compound_id, 0 AS block, ssrc + 1 AS source, CAST(bucket % 256 AS INT) AS fraction, bucket % 7 - 3 AS lost, packets_so_far + 65536 AS highest, bucket * 3 AS jitter, ssrc AS lsr, bucket AS dlsr FROM c")
def d11(spark, sf):
    return parts(spark, sf).where("rtcp_pt in (200, 201)").select("compound_id", F.posexplode(rtcp.report_blocks()).alias("block", "b")).select("compound_id", "block", "b.*")


@query("d12_descriptions", " SELECT compound_id, 1 AS idx, 0 AS chunk, ssrc AS source, 1 AS item_type, 'user' || ssrc || '@host' AS text FROM c")
def d12(spark, sf):
    return rtcp.description_items(parts(spark, sf), ("compound_id", "idx"))


@query("d13_goodbyes", " SELECT compound_id, CAST(ssrc AS VARCHAR) AS sources, rpad('b' || bucket, 7, '.') AS reason FROM c WHERE k = 0")
def d13(spark, sf):
    p = parts(spark, sf).where("rtcp_pt = 203").select("compound_id", rtcp.goodbye().alias("g"))
    return p.select("compound_id", F.array_join(F.transform("g.sources", lambda x: x.cast("string")), ",").alias("sources"), "g.reason")


@query("d14_application", " SELECT compound_id, 1 AS subtype, 'qtsi' AS name, upper(printf('%08x', bucket)) AS data FROM c WHERE k = 1")
def d14(spark, sf):
    p = parts(spark, sf).where("rtcp_pt = 204").select("compound_id", rtcp.application().alias("a"))
    return p.select("compound_id", "a.subtype", "a.name", F.hex("a.data").alias("data"))


@query("d15_feedback", " SELECT compound_id, 1 AS fmt, ssrc + 2 AS media_ssrc, CASE k WHEN 2 THEN upper(printf('%04x', bucket % 65536)) || '0005' ELSE '' END AS fci, CASE k WHEN 2 THEN 'NACK' ELSE 'PLI' END AS kind FROM c WHERE k >= 2")
def d15(spark, sf):
    p = parts(spark, sf).where("rtcp_pt in (205, 206)").select("compound_id", rtcp.feedback().alias("f"))
    return p.select("compound_id", "f.fmt", "f.media_ssrc", F.hex("f.fci").alias("fci"), "f.kind")


@query("d16_ntp", " SELECT compound_id, (msw - 2208988800) * 1000 + CAST(floor(lsw * 1000 / 4294967296.0::DOUBLE) AS BIGINT) AS ms, msw % 65536 * 65536 + (lsw >> 16) AS middle, 3900000000 + arrival_ms // 1000 AS back_msw FROM c")
def d16(spark, sf):
    p = parts(spark, sf).where("rtcp_pt = 200").select("compound_id", rtcp.sender_info().alias("i"))
    msw, lsw = F.col("i.ntp_msw"), F.col("i.ntp_lsw")
    return p.select("compound_id", rtcp.ntp_ms(msw, lsw).alias("ms"), rtcp.ntp_middle(msw, lsw).alias("middle"), rtcp.ntp_parts(rtcp.ntp_ms(msw, lsw))["msw"].alias("back_msw"))


_SIZES = """, a AS (SELECT ssrc, 52 AS octets FROM c
UNION ALL SELECT ssrc, 4 * (1 + (6 + 9 + length(CAST(ssrc AS VARCHAR)) + 4 - (11 + length(CAST(ssrc AS VARCHAR))) % 4) // 4) FROM c
UNION ALL SELECT ssrc, CASE k WHEN 3 THEN 12 ELSE 16 END FROM c),
ctl AS (SELECT ssrc, count(*) AS rtcp_packets, CAST(sum(octets) AS BIGINT) AS rtcp_octets FROM a GROUP BY 1),
got AS (SELECT ssrc % 3 AS session_id, ssrc, count(*) AS packets, CAST(sum(payload_len) AS BIGINT) AS rfc_octets, CAST(sum(payload_len + 12 + event_id % 4 * 4) AS BIGINT) AS total_octets, min(arrival_ms) AS first_ms, max(arrival_ms) AS last_ms, count(*) FILTER (event_id % 23 = 0) AS failed FROM packets GROUP BY 1, 2),
st AS (SELECT session_id, got.ssrc, packets, rfc_octets, total_octets, first_ms, last_ms, failed, rtcp_packets, rtcp_octets FROM got JOIN ctl USING (ssrc))"""


def control_stats(spark, sf):
    p = packets(spark, sf).withColumns({"session_id": F.col("ssrc") % 3, "failed": F.col("event_id") % 23 == 0})
    got = reports.context_stats(p, octets=F.col("payload_len") + 12 + F.col("event_id") % 4 * 4, keep_failed=True)
    return reports.with_control(got, reports.control_stats(parts(spark, sf)))


@query("a1_control_stats", _SIZES + " SELECT * FROM st")
def a1(spark, sf):
    """Received packets (failed ones, too) of three sessions, with the control packets split from their sources' datagrams."""
    return control_stats(spark, sf)


@query("a3_control_bandwidth", _SIZES + ", r AS (SELECT session_id, CAST(sum(total_octets) AS BIGINT) AS received_octets, CAST(sum(rtcp_octets) AS BIGINT) AS rtcp_octets FROM st GROUP BY 1) SELECT *, received_octets > 0 AND rtcp_octets > 0 AND rtcp_octets >= received_octets / 4.96::DOUBLE AS exceeded FROM r")
def a3(spark, sf):
    per = control_stats(spark, sf).groupBy("session_id").agg(F.sum("total_octets").alias("received_octets"), F.sum("rtcp_octets").alias("rtcp_octets"))
    return reports.rtcp_exceeded(per)


@query("s4_control_text", """, t AS (SELECT compound_id, 1 AS idx, '(SDES ssrc=0x' || printf('%02X', ssrc) || ' p=0 count=1 len=' || ((6 + 9 + length(CAST(ssrc AS VARCHAR)) + 4 - (11 + length(CAST(ssrc AS VARCHAR))) % 4) // 4) || chr(10) || chr(10) || 'src=0x' || printf('%02X', ssrc) || ' CName="user' || ssrc || '@host")' AS line FROM c
UNION ALL SELECT compound_id, 2, CASE k WHEN 0 THEN '(BYE ssrc=0x' || printf('%02X', ssrc) || ' p=0 count=1 len=3' || chr(10) || 'reason="' || rpad('b' || bucket, 7, '.') || '"ssrc=0x' || printf('%X', ssrc) || chr(10) || ')'
  WHEN 1 THEN '(APP ssrc=0x' || printf('%02X', ssrc) || ' p=0 count=1 len=3' || chr(10) || ')' WHEN 2 THEN '(CD ssrc=0x' || printf('%02X', ssrc) || ' p=0 count=1 len=3' || chr(10) || ')' ELSE '(CE ssrc=0x' || printf('%02X', ssrc) || ' p=0 count=1 len=2' || chr(10) || ')' END FROM c
UNION ALL SELECT compound_id, 3, '(RR ssrc=0x' || printf('%02X', ssrc) || ' p=0 count=1 len=7' || chr(10) || ' (ssrc=0x' || printf('%02X', ssrc + 1) || ' fraction=' || (bucket % 256) || ' lost=' || (bucket % 7 - 3) || ' last_seq=' || (packets_so_far + 65536) || chr(10) || ' jit=' || (bucket * 3) || ' lsr=' || ssrc || ' dlsr=' || bucket || ')' || chr(10) || ')' FROM c) SELECT * FROM t""")
def s4(spark, sf):
    """The datagrams' parts in expression form, with a receiver report of each sender report's blocks."""
    from mediaflow.sources import capture

    p = parts(spark, sf)
    head = F.concat(be(128 + 1, 1), be(rtcp.RR, 1), be(7, 2), be(F.col("ssrc"), 4), F.substring("raw", 29, 24))
    received = rtcp.decode_header(p.where("rtcp_pt = 200").select("compound_id", F.lit(3).alias("idx"), head.alias("raw")))
    return capture.control_text(p.select(*received.columns).unionByName(received), ("compound_id", "idx"))


@query("f2_valid_rtcp", _ALL + " SELECT compound_id, idx, pt IN (200, 201) AS valid FROM a")
def f2(spark, sf):
    return parts(spark, sf).select("compound_id", "idx", rtcp.is_valid_first().alias("valid"))


@query("f3_valid_compound", " SELECT compound_id, true AS valid FROM c UNION ALL SELECT -1 - compound_id, false FROM c")
def f3(spark, sf):
    """The datagrams, and each once more without its first packet (which makes it invalid)."""
    p = parts(spark, sf)
    rest = p.where("idx > 0").withColumn("compound_id", -1 - F.col("compound_id"))
    both = p.unionByName(rest)
    return rtcp.valid_compounds(both, rtcp.description_items(both, ("compound_id",)), "compound_id")
