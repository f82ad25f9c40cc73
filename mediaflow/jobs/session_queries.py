"""Queries over session descriptions and messages, whose texts are made of orders and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaflow.functions.storage import written
from mediaflow.operators import messages as ms
from mediaflow.operators import sdp
from mediaflow.sources.derived import duck, sql

QUERIES, SQL = {}, {}


def query(name, text=None, *parts):
    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = duck(text, *parts) if parts else text
        return f

    return add


#: Orders are sessions, their lines media sections (numbered by all columns, since line numbers repeat).
MEDIA = """
ln AS (SELECT l_orderkey AS k, l_partkey AS p, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i FROM {lineitem}),
m AS (SELECT *, CASE p % 3 WHEN 0 THEN 'audio' WHEN 1 THEN 'video' ELSE 'application' END AS media, 10000 + p % 5000 * 2 AS port, CASE WHEN p % 4 = 0 THEN 2 ELSE 1 END AS n_ports,
  CASE p % 3 WHEN 0 THEN 0 WHEN 1 THEN 96 ELSE 98 END AS pt, CASE p % 3 WHEN 0 THEN 'PCMU' WHEN 1 THEN 'H264' ELSE 'L16' END AS enc, CASE p % 3 WHEN 0 THEN 8000 WHEN 1 THEN 90000 ELSE 44100 END AS clock FROM ln),
o AS (SELECT o_orderkey AS k, o_custkey AS c, 3000000000 + o_orderkey * 60 AS start, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 3000003600 + o_orderkey * 60 END AS stop FROM {orders})"""

#: MEDIA as Spark runs it: lines are numbered before they are renamed, so that Spark sees that they are dealt by k already.
DEALT = MEDIA.replace("row_number()", "i FROM (SELECT *, row_number()").replace("FROM {lineitem})", "FROM {lineitem}))")

SDP = """SELECT o.k AS session_key, concat('v=0\\r\\no=user', c, ' ', o.k, ' ', o.k + 1, ' IN IP4 10.0.', c % 256, '.1\\r\\ns=Order ', o.k, '\\r\\nc=IN IP4 232.0.', c % 256, '.1/127/3\\r\\nt=', start, ' ', stop, '\\r\\na=control:*\\r\\n', coalesce(b, '')) AS sdp
FROM o LEFT JOIN (SELECT k, array_join(transform(array_sort(collect_list(struct(i, concat('m=', media, ' ', port, CASE WHEN n_ports > 1 THEN '/2' ELSE '' END, ' RTP/AVP ', pt, ' 101\\r\\n',
  CASE WHEN p % 2 = 0 THEN concat('c=IN IP4 10.1.1.', s % 256, '\\r\\n') ELSE '' END, 'b=AS:', p % 1000, '\\r\\nb=RR:', s, '\\r\\na=rtpmap:', pt, ' ', enc, '/', clock, CASE WHEN pt = 98 THEN '/2' ELSE '' END,
  '\\r\\na=fmtp:', pt, ' mode=', p % 7, ';rate=', s, '\\r\\na=control:', CASE WHEN p % 5 = 0 THEN 'rtsp://abs/x' ELSE concat('track', i) END, '\\r\\na=sendrecv\\r\\n') AS x))), z -> z.x), '') AS b FROM m GROUP BY k) USING (k)"""


def descriptions(spark, sf):
    return sql(spark, sf, f"WITH {DEALT} {SDP}".replace("\\\\", "\\"), "lineitem", "orders")


def media(spark, sf):
    return sdp.media(descriptions(spark, sf))


@query("x1_sdp_sessions", """ SELECT k AS session_key, 0 AS version, 'user' || c AS "user", k AS origin_id, k + 1 AS origin_version, 'IN' AS net, 'IP4' AS address_type, '10.0.' || (c % 256) || '.1' AS address,
  'Order ' || k AS name, 'IN IP4 232.0.' || (c % 256) || '.1/127/3' AS connection, start, stop, CAST((SELECT count(*) FROM m WHERE m.k = o.k) AS INT) AS n_media FROM o""", MEDIA)
def x1(spark, sf):
    return sdp.sessions(descriptions(spark, sf))


_IN = " FROM m WHERE k IN (SELECT k FROM o)"


@query("x2_sdp_media", " SELECT k AS session_key, CAST(i AS INT) AS media_idx, media, CAST(port AS INT) AS port, n_ports, 'RTP/AVP' AS proto, pt || ',101' AS pts" + _IN, MEDIA)
def x2(spark, sf):
    return media(spark, sf).select("session_key", "media_idx", "media", "port", "n_ports", "proto", F.array_join(F.transform("pts", lambda x: x.cast("string")), ",").alias("pts"))


@query("x3_sdp_attributes", """, a AS (SELECT k, i, 0 AS idx, 'rtpmap' AS name, pt || ' ' || enc || '/' || clock || CASE WHEN pt = 98 THEN '/2' ELSE '' END AS value, pt, enc AS encoding, clock AS clock_rate, CASE WHEN pt = 98 THEN '2' END AS ep, NULL AS mode, NULL AS rate FROM m
UNION ALL SELECT k, i, 1, 'fmtp', pt || ' mode=' || (p % 7) || ';rate=' || s, pt, NULL, NULL, NULL, CAST(p % 7 AS VARCHAR), CAST(s AS VARCHAR) FROM m
UNION ALL SELECT k, i, 2, 'control', CASE WHEN p % 5 = 0 THEN 'rtsp://abs/x' ELSE 'track' || i END, NULL, NULL, NULL, NULL, NULL, NULL FROM m
UNION ALL SELECT k, i, 3, 'sendrecv', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM m)
SELECT k AS session_key, CAST(i AS INT) AS media_idx, idx, name, value, pt, encoding, clock_rate, ep AS encoding_params, mode, rate FROM a WHERE k IN (SELECT k FROM o)""", MEDIA)
def x3(spark, sf):
    a = sdp.attributes(media(spark, sf))
    return a.select("session_key", "media_idx", "idx", "name", "value", "pt", "encoding", "clock_rate", "encoding_params", F.col("params")["mode"].alias("mode"), F.col("params")["rate"].alias("rate"))


#: Descriptions with source, control-port, packet-time and direction attributes, and with session attributes.
SDP_MORE = SDP.replace("a=sendrecv\\r\\n'", """a=ssrc:', s, ' cname:u', p, ':x\\r\\na=ssrc:', s, ' mslabel\\r\\na=rtcp:', port + 1, CASE WHEN p % 2 = 0 THEN ' IN IP4 10.9.9.9' ELSE '' END,
  '\\r\\na=ptime:', p % 60, '.5\\r\\na=maxptime:none', CASE p % 4 WHEN 0 THEN '\\r\\na=recvonly' WHEN 1 THEN '\\r\\na=inactive' ELSE '' END, '\\r\\n'""").replace("a=control:*\\r\\n'", "a=control:*\\r\\na=tool:maker ', c, CASE WHEN c % 2 = 0 THEN '\\r\\na=sendonly' ELSE '' END, '\\r\\n'")


def descriptions_more(spark, sf):
    return sql(spark, sf, f"WITH {DEALT} {SDP_MORE}", "lineitem", "orders")


@query("x3_attribute_fields", """, a AS (SELECT k, i, 3 AS idx, 'ssrc' AS name, s AS ssrc, 'cname' AS source_attribute, 'u' || p || ':x' AS source_value, CAST(NULL AS INT) AS rtcp_port, CAST(NULL AS VARCHAR) AS rtcp_host, CAST(NULL AS DOUBLE) AS packet_ms, CAST(NULL AS VARCHAR) AS direction FROM m
UNION ALL SELECT k, i, 4, 'ssrc', s, 'mslabel', NULL, NULL, NULL, NULL, NULL FROM m
UNION ALL SELECT k, i, 5, 'rtcp', NULL, NULL, NULL, port + 1, CASE WHEN p % 2 = 0 THEN '10.9.9.9' END, NULL, NULL FROM m
UNION ALL SELECT k, i, 6, 'ptime', NULL, NULL, NULL, NULL, NULL, p % 60 + 0.5::DOUBLE, NULL FROM m
UNION ALL SELECT k, i, 7, 'maxptime', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM m
UNION ALL SELECT k, i, 8, d, NULL, NULL, NULL, NULL, NULL, NULL, d FROM (SELECT *, CASE WHEN p % 4 = 0 THEN 'recvonly' ELSE 'inactive' END AS d FROM m WHERE p % 4 < 2))
SELECT k AS session_key, CAST(i AS INT) AS media_idx, idx, name, ssrc, source_attribute, source_value, rtcp_port, rtcp_host, packet_ms, CAST(NULL AS DOUBLE) AS most_packet_ms, direction FROM a WHERE k IN (SELECT k FROM o)""", MEDIA)
def x3_fields(spark, sf):
    a = sdp.attribute_fields(sdp.attributes(sdp.media(descriptions_more(spark, sf)))).where("name NOT IN ('rtpmap', 'fmtp', 'control')")
    return a.select("session_key", "media_idx", "idx", "name", "ssrc", "source_attribute", "source_value", "rtcp_port", "rtcp_host", "packet_ms", "most_packet_ms", "direction")


@query("x3_session_attributes", """ SELECT k AS session_key, 0 AS idx, 'control' AS name, '*' AS value FROM o UNION ALL SELECT k, 1, 'tool', 'maker ' || c FROM o UNION ALL SELECT k, 2, 'sendonly', NULL FROM o WHERE c % 2 = 0""", MEDIA)
def x3_session(spark, sf):
    return sdp.session_attributes(descriptions_more(spark, sf))


@query("x3_directions", """ SELECT k AS session_key, CAST(i AS INT) AS media_idx, CASE WHEN p % 4 = 0 THEN 'recvonly' WHEN p % 4 = 1 THEN 'inactive' WHEN c % 2 = 0 THEN 'sendonly' ELSE 'sendrecv' END AS direction FROM m JOIN o USING (k)""", MEDIA)
def x3_direction(spark, sf):
    return sdp.directions(sdp.media(descriptions_more(spark, sf)))


@query("x4_connection", " SELECT m.k AS session_key, CAST(i AS INT) AS media_idx, CASE WHEN p % 2 = 0 THEN '10.1.1.' || (s % 256) ELSE '232.0.' || (c % 256) || '.1' END AS host, CASE WHEN p % 2 = 0 THEN NULL ELSE 127 END AS ttl, CASE WHEN p % 2 = 0 THEN 1 ELSE 3 END AS addresses FROM m JOIN o USING (k)", MEDIA)
def x4(spark, sf):
    return media(spark, sf).select("session_key", "media_idx", sdp.connection(F.col("connection")).alias("c")).select("session_key", "media_idx", "c.host", "c.ttl", "c.addresses")


@query("x5_control_uri", " SELECT k AS session_key, CAST(i AS INT) AS media_idx, CASE WHEN p % 5 = 0 THEN 'rtsp://abs/x' ELSE 'rtsp://host/s' || k || '/track' || i END AS uri" + _IN, MEDIA)
def x5(spark, sf):
    a = sdp.attributes(media(spark, sf)).where("name = 'control'")
    return a.select("session_key", "media_idx", sdp.control_uri(F.concat(F.lit("rtsp://host/s"), F.col("session_key").cast("string"), F.lit("/")), F.col("value")).alias("uri"))


@query("x6_range", """ SELECT k, CASE k % 4 WHEN 0 THEN 'npt' WHEN 1 THEN 'npt' WHEN 2 THEN 'smpte' ELSE 'clock' END AS type,
  CASE k % 4 WHEN 0 THEN k % 1000 + 0.5 WHEN 1 THEN 3600 * (k % 10) + 125.25 WHEN 2 THEN 36453 + k % 7 ELSE 883612800 + k % 86400 END::DOUBLE AS start, CASE k % 4 WHEN 0 THEN (k % 1000 + 10)::DOUBLE WHEN 3 THEN 915148800::DOUBLE END AS "end" FROM o""", MEDIA)
def x6(spark, sf):
    k = F.col("k")
    at = F.date_format(F.timestamp_seconds(F.lit(883612800) + k % 86400), "yyyyMMdd'T'HHmmss'Z'")
    text = F.when(k % 4 == 0, F.concat(F.lit("npt="), (k % 1000).cast("string"), F.lit(".5-"), (k % 1000 + 10).cast("string"))).when(k % 4 == 1, F.concat(F.lit("npt="), (k % 10).cast("string"), F.lit(":02:05.25-"))).when(k % 4 == 2, F.concat(F.lit("smpte=10:07:3"), (k % 7 + 3).cast("string"), F.lit(":20-"))).otherwise(F.concat(F.lit("clock="), at, F.lit("-19990101T000000.25Z")))
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    return rows.select("k", sdp.media_range(text).alias("r")).select("k", "r.type", "r.start", "r.end")


@query("x7_durations", " SELECT k, k % 8 * 86400 + 3600 - (k % 60) * 60 + 10 AS seconds, k % 5 * 3600 AS interval, 90 AS length, '0,' || (k % 3 * 60) AS offsets FROM o", MEDIA)
def x7(spark, sf):
    k = F.col("k")
    n = lambda m: (k % m).cast("string")
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    r = rows.select("k", sdp.duration(F.concat(n(8), F.lit("d 1h -"), n(60), F.lit("m 10s"))).alias("seconds"), sdp.repeat_times(F.concat(n(5), F.lit("h 90 0 "), n(3), F.lit("m"))).alias("r"))
    return r.select("k", "seconds", "r.interval", "r.length", F.array_join(F.transform("r.offsets", lambda x: x.cast("string")), ",").alias("offsets"))


@query("a14_bandwidth", ' SELECT k AS session_key, CAST(i AS INT) AS media_idx, s AS "RR", CAST(NULL AS BIGINT) AS "RS", p % 1000 AS "AS", CAST(NULL AS BIGINT) AS "TIAS"' + _IN, MEDIA)
def a14(spark, sf):
    return sdp.bandwidth(media(spark, sf))


@query("f6_playable", " SELECT k AS session_key FROM o WHERE start <= 3000300000 AND (stop = 0 OR stop >= 3000300000)", MEDIA)
def f6(spark, sf):
    s = sdp.sessions(descriptions(spark, sf))
    return s.where(sdp.playable(F.col("start"), F.col("stop"), F.lit(3000300000))).select("session_key")


@query("x1_written", """, t AS (SELECT k, i, 'm=' || media || ' ' || port || CASE WHEN n_ports > 1 THEN '/2' ELSE '' END || ' RTP/AVP ' || pt || ' 101' || e || CASE WHEN p % 2 = 0 THEN 'c=IN IP4 10.1.1.' || (s % 256) || e ELSE '' END || 'b=AS:' || (p % 1000) || e || 'b=RR:' || s || e ||
    'a=rtpmap:' || pt || ' ' || enc || '/' || clock || CASE WHEN pt = 98 THEN '/2' ELSE '' END || e || 'a=fmtp:' || pt || ' mode=' || (p % 7) || ';rate=' || s || e || 'a=control:' || CASE WHEN p % 5 = 0 THEN 'rtsp://abs/x' ELSE 'track' || i END || e || 'a=sendrecv' || e AS x FROM m, (SELECT chr(13) || chr(10) AS e)),
  b AS (SELECT k, string_agg(x, '' ORDER BY i) AS x FROM t GROUP BY k)
SELECT k AS session_key, md5('v=0' || e || 'o=user' || c || ' ' || k || ' ' || (k + CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END) || ' IN IP4 10.0.' || (c % 256) || '.1' || e || 's=Order ' || k || e || 'c=IN IP4 232.0.' || (c % 256) || '.1/127/3' || e || 't=' || start || ' ' || stop || e || 'a=control:*' || e || coalesce(x, '') ||
  CASE WHEN k % 3 = 0 THEN 'm=text 9 RTP/AVP 98' || e || 'a=rtpmap:98 t140/1000' || e ELSE '' END) AS digest FROM o LEFT JOIN b USING (k), (SELECT chr(13) || chr(10) AS e)""", MEDIA)
def x1_written(spark, sf):
    """Descriptions read and written again; every third gets one more media section and with it a new version. A description stays one
    row all the way, so nothing is shuffled but what its text is derived from."""
    read = sdp.whole(written(descriptions(spark, sf), "descriptions"))
    third = F.col("session_key") % 3 == 0
    given = {"media": F.lit("text"), "port": F.lit(9), "n_ports": F.lit(1), "proto": F.lit("RTP/AVP"), "pts": F.array(F.lit(98)), "attributes": F.array(F.struct(F.lit("rtpmap").alias("name"), F.lit("98 t140/1000").alias("value")))}
    section = read.schema["sections"].dataType.elementType
    new = F.struct(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in section))
    changed = sdp.changed(read, third).withColumn("sections", F.when(third, F.concat("sections", F.array(new))).otherwise(F.col("sections")))
    return sdp.texts(changed).select("session_key", F.md5("sdp").alias("digest"))


@query("x3_negotiation", """, a AS (SELECT k, i, 0 AS idx, CASE WHEN p % 4 = 0 THEN NULL ELSE pt END AS feedback_pt, 'nack' AS feedback, CASE WHEN p % 3 = 0 THEN 'pli' END AS feedback_parameter, NULL::BIGINT AS priority, NULL::VARCHAR AS candidate_address, NULL::VARCHAR AS candidate_kind, NULL::INT AS related_port, NULL::VARCHAR AS ice_user FROM m
UNION ALL SELECT k, i, 1, NULL, NULL, NULL, 1694498815 + s, '192.0.2.3', CASE WHEN p % 2 = 0 THEN 'srflx' ELSE 'host' END, CASE WHEN p % 2 = 0 THEN port END, NULL FROM m
UNION ALL SELECT k, i, 2, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'u' || s FROM m)
SELECT k AS session_key, CAST(i AS INT) AS media_idx, idx, feedback_pt, feedback, feedback_parameter, priority, candidate_address, candidate_kind, related_port, ice_user FROM a WHERE k IN (SELECT k FROM o)""", MEDIA)
def x3_negotiated(spark, sf):
    """Feedback and connectivity attributes of every media section."""
    text = SDP.replace("a=sendrecv\\r\\n'", "a=rtcp-fb:', CASE WHEN p % 4 = 0 THEN '*' ELSE CAST(pt AS STRING) END, ' nack', CASE WHEN p % 3 = 0 THEN ' pli' ELSE '' END, '\\r\\na=candidate:2 1 UDP ', 1694498815 + s, ' 192.0.2.3 45664 typ ', CASE WHEN p % 2 = 0 THEN concat('srflx raddr 10.0.1.1 rport ', port) ELSE 'host' END, '\\r\\na=ice-ufrag:u', s, '\\r\\n'")
    a = sdp.attributes(sdp.media(sql(spark, sf, f"WITH {DEALT} {text}", "lineitem", "orders"))).where("name IN ('rtcp-fb', 'candidate', 'ice-ufrag')")
    f = sdp.negotiation_fields(a)
    return f.select("session_key", "media_idx", (F.col("idx") - 3).alias("idx"), "feedback_pt", "feedback", "feedback_parameter", "priority", "candidate_address", "candidate_kind", "related_port", "ice_user")


# -- messages ----------------------------------------------------------------------------------------------------------
#: Turn pairs of conversations are requests and responses; some responses are missing, some numbers step back.
MESSAGES = """
c AS (SELECT conv_id, turn, role, length(text) AS n, conv_id * 1000000 + turn * 700 + length(text) % 500 AS ts_ms, CASE WHEN turn % 14 = 10 THEN turn // 2 - 3 ELSE turn // 2 END AS cseq,
  CASE turn // 2 % 5 WHEN 0 THEN 'OPTIONS' WHEN 1 THEN 'DESCRIBE' WHEN 2 THEN 'SETUP' WHEN 3 THEN 'PLAY' ELSE 'GET_PARAMETER' END AS method FROM {conversations}),
q AS (SELECT *, turn % 2 = 0 AS ask FROM c WHERE turn % 2 = 0 OR (conv_id + turn) % 7 <> 3)"""


def raw_messages(spark, sf):
    """conn_id, ts_ms, raw."""
    text = f"WITH {MESSAGES} SELECT * FROM q".replace("//", "DIV")
    q = sql(spark, sf, text, "conversations")
    s = lambda c: F.col(c).cast("string")
    common = F.concat(F.lit("\r\nCSeq: "), s("cseq"), F.lit("\r\nSession:  S"), s("conv_id"), F.when(F.col("conv_id") % 3 == 0, ";timeout=30").otherwise(""))
    ask = F.concat(F.col("method"), F.lit(" rtsp://host/live/"), s("conv_id"), F.lit(" RTSP/1.0"), F.when(F.col("conv_id") % 11 == 4, "\r\nX-No: 1").otherwise(common), F.lit("\r\nTransport: RTP/AVP/UDP;unicast;client_port="), (F.col("n") + 1000).cast("string"), F.lit("-"), (F.col("n") + 1001).cast("string"), F.lit(';ssrc=0A;mode="PLAY"\r\nX-Long: a\r\n  b\r\n\r\n'), F.when(F.col("turn") % 6 == 2, "body text").otherwise(""))
    answer = F.concat(F.lit("RTSP/1.0 200 OK"), common, F.lit("\r\nRTP-Info: url=rtsp://h/a;seq="), s("n"), F.lit(";rtptime="), s("ts_ms"), F.lit(",url=rtsp://h/b;seq=7\r\nTimestamp: 12.5 0.25\r\n\r\n"))
    return q.select(F.col("conv_id").alias("conn_id"), "ts_ms", "turn", F.when(F.col("ask"), ask).otherwise(answer).alias("raw"))


def parsed(spark, sf):
    return with_ids(ms.parse(raw_messages(spark, sf)))


def with_ids(p):
    own = ms.session(ms.header("session"))
    return p.withColumns({"cseq": ms.cseq(), "session_id": own["id"], "timeout": own["timeout"]})


@query("x8_parse_message", """ SELECT conv_id AS conn_id, turn, CASE WHEN ask THEN 'request' ELSE 'response' END AS kind, CASE WHEN ask THEN method END AS method, CASE WHEN ask THEN 'rtsp://host/live/' || conv_id END AS uri, 'RTSP/1.0' AS protocol,
  CASE WHEN NOT ask THEN 200 END AS status, CASE WHEN NOT ask THEN 'OK' END AS reason, CASE WHEN ask THEN 'a b' END AS long, CASE WHEN ask AND turn % 6 = 2 THEN 'body text' ELSE '' END AS body FROM q""", MESSAGES)
def x8(spark, sf):
    return parsed(spark, sf).select("conn_id", "turn", "kind", "method", "uri", "protocol", "status", "reason", ms.header("x-long").alias("long"), "body")


@query("x9_transport", """ SELECT conv_id AS conn_id, turn, 'RTP/AVP/UDP' AS profile, false AS multicast, CAST(n + 1000 AS INT) AS client_low, CAST(n + 1001 AS INT) AS client_high, 10 AS ssrc, 'play' AS mode, 127 AS ttl FROM q WHERE ask""", MESSAGES)
def x9(spark, sf):
    t = parsed(spark, sf).where("kind = 'request'").select("conn_id", "turn", ms.transport(ms.header("transport")).alias("t"))
    return t.select("conn_id", "turn", "t.profile", "t.multicast", "t.client_low", "t.client_high", F.col("t.ssrc").cast("int").alias("ssrc"), "t.mode", "t.ttl")


@query("x10_rtp_info", " SELECT conv_id AS conn_id, turn, 0 AS idx, 'rtsp://h/a' AS url, n AS seq, ts_ms AS rtptime FROM q WHERE NOT ask UNION ALL SELECT conv_id, turn, 1, 'rtsp://h/b', 7, NULL FROM q WHERE NOT ask", MESSAGES)
def x10(spark, sf):
    r = parsed(spark, sf).where("kind = 'response'").select("conn_id", "turn", F.posexplode(ms.rtp_info(ms.header("rtp-info"))).alias("idx", "r"))
    return r.select("conn_id", "turn", "idx", "r.url", "r.seq", "r.rtptime")


_HAS = "CASE WHEN ask AND conv_id % 11 = 4 THEN NULL ELSE {} END"


@query("x11_session_header", f" SELECT conv_id AS conn_id, turn, {_HAS.format(chr(39) + 'S' + chr(39) + ' || conv_id')} AS session_id, CASE WHEN conv_id % 3 = 0 AND NOT (ask AND conv_id % 11 = 4) THEN 30 ELSE 60 END AS timeout, CASE WHEN NOT ask THEN 0.25::DOUBLE END AS delay FROM q", MESSAGES)
def x11(spark, sf):
    stamp = ms.timestamp_delay(ms.header("timestamp"))
    return parsed(spark, sf).select("conn_id", "turn", "session_id", "timeout", F.when(ms.header("timestamp").isNotNull(), stamp["delay"]).alias("delay"))


@query("x12_cseq", f" SELECT conv_id AS conn_id, turn, {_HAS.format('CAST(cseq AS INT)')} AS cseq FROM q", MESSAGES)
def x12(spark, sf):
    return parsed(spark, sf).select("conn_id", "turn", "cseq")


PAIRS = """, g AS (SELECT conv_id, cseq, ask, min(ts_ms) AS t, arg_min(method, ts_ms) AS method FROM q WHERE NOT (ask AND conv_id % 11 = 4) GROUP BY 1, 2, 3)"""


@query("j6_request_response", PAIRS + " SELECT a.conv_id AS conn_id, CAST(a.cseq AS INT) AS cseq, a.method, a.t AS asked_ms, b.t AS answered_ms, CASE WHEN b.t IS NOT NULL THEN 200 END AS status, b.t - a.t AS rtt_ms FROM g a LEFT JOIN g b ON a.conv_id = b.conv_id AND a.cseq = b.cseq AND NOT b.ask WHERE a.ask", MESSAGES)
def j6(spark, sf):
    return ms.match(parsed(spark, sf).where("cseq IS NOT NULL")).drop("session_id")


@query("j6_unanswered", " SELECT conv_id AS conn_id, turn FROM q a WHERE ask AND NOT EXISTS (SELECT 1 FROM q b WHERE NOT b.ask AND b.conv_id = a.conv_id AND b.cseq = a.cseq AND a.conv_id % 11 <> 4)", MESSAGES)
def j6u(spark, sf):
    return ms.unanswered(parsed(spark, sf)).select("conn_id", "turn")


@query("f8_request_check", ' SELECT conv_id AS conn_id, turn, CASE WHEN conv_id % 11 = 4 OR turn % 6 = 2 THEN 400 WHEN conv_id % 5 = 2 THEN 454 WHEN conv_id % 13 = 6 THEN 505 ELSE 200 END AS "check" FROM q WHERE ask', MESSAGES)
def f8(spark, sf):
    """Some of the requests are of a later version of the protocol."""
    raw = F.when(F.col("conn_id") % 13 == 6, F.replace("raw", F.lit(" RTSP/1.0"), F.lit(" RTSP/2.0"))).otherwise(F.col("raw"))
    p = with_ids(ms.parse(raw_messages(spark, sf).withColumn("raw", raw)))
    known = p.where("conn_id % 5 <> 2 AND session_id IS NOT NULL").select("session_id")
    return ms.check(p, known).select("conn_id", "turn", "check")


@query("w11_request_order", ", a AS (SELECT conv_id, turn, CASE WHEN conv_id % 11 = 4 THEN NULL ELSE cseq END AS s, ts_ms FROM q WHERE ask) SELECT conv_id AS conn_id, turn, coalesce(s < max(s) OVER (PARTITION BY conv_id ORDER BY ts_ms, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS out_of_order FROM a", MESSAGES)
def w11(spark, sf):
    return ms.request_order(parsed(spark, sf)).select("conn_id", "turn", "out_of_order")


@query("a13_session_summary", PAIRS + """, s AS (SELECT conv_id, count(*) FILTER (ask) AS requests, count(*) FILTER (NOT ask) AS responses, max(ts_ms) AS last_ms, arg_max(method, ts_ms) FILTER (ask) AS last_method FROM q GROUP BY 1),
r AS (SELECT a.conv_id, avg(b.t - a.t) AS m FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.cseq = b.cseq AND NOT b.ask WHERE a.ask GROUP BY 1)
SELECT s.conv_id AS conn_id, requests, responses, last_ms, last_method, round(m, 6) AS mean_rtt_ms, s.conv_id * 1000000 + 62000 - last_ms AS idle_ms, s.conv_id * 1000000 + 62000 - last_ms >= 60000 AS expired FROM s LEFT JOIN r USING (conv_id)""", MESSAGES)
def a13(spark, sf):
    s = ms.summary(parsed(spark, sf), F.col("conn_id") * 1000000 + 62000)
    return s.withColumn("mean_rtt_ms", F.round("mean_rtt_ms", 6))


@query("t5_session_expiry", """, d AS (SELECT conv_id, ts_ms, turn % 4 + 1 AS gap FROM q), b AS (SELECT *, max(ts_ms + gap * 200) OVER (PARTITION BY conv_id ORDER BY ts_ms, gap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM d),
r AS (SELECT *, sum(CASE WHEN upto IS NULL OR ts_ms > upto THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY ts_ms, gap) AS run FROM b)
SELECT conv_id AS conn_id, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS messages, max(ts_ms + gap * 200) AS expires_ms FROM r GROUP BY conv_id, run""", MESSAGES)
def t5(spark, sf):
    p = parsed(spark, sf).withColumn("timeout", ((F.col("turn") % 4 + 1) * 0.2).cast("decimal(9,3)"))
    return ms.sessions(p)


# -- malformed texts ---------------------------------------------------------------------------------------------------
def odd_descriptions(spark, sf):
    """session_key, sdp: of every order a description, in which numbers are malformed now and then."""
    k, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    number = lambda n, bad, other: F.when(k % n == 0, bad).when(k % n == 1, "18446744073709551615").otherwise(other)
    lines = [
        F.lit("v=0"), F.concat(F.lit("o=u "), number(7, "0xAB", text), F.lit(" "), number(11, "-", text), F.lit(" IN IP4 h")), F.lit("s=n"), F.concat(F.lit("t="), number(5, "soon", text), F.lit(" 0")),
        F.concat(F.lit("m=audio "), number(6, "any", (k % 60000).cast("string")), F.lit(" RTP/AVP 0 99999999999")), F.concat(F.lit("c=IN IP4 h/"), number(9, "x", F.lit("127"))), F.concat(F.lit("b=AS:"), number(4, "", text)),
        F.concat(F.lit("a=rtpmap:0 X/"), number(3, "8k", F.lit("8000"))), F.concat(F.lit("a=fmtp:0 a=1;a="), text),
    ]
    return spark.read.parquet(f"{sf}/orders.parquet").select(k.alias("session_key"), F.concat_ws("\r\n", *lines).alias("sdp"))


@query("x1_malformed", """SELECT o_orderkey AS session_key, CASE WHEN o_orderkey % 7 > 1 THEN o_orderkey END AS origin_id, CASE WHEN o_orderkey % 11 > 1 THEN o_orderkey END AS origin_version, CASE WHEN o_orderkey % 5 > 1 THEN o_orderkey END AS start, 0 AS stop,
  concat_ws(',', CASE WHEN o_orderkey % 7 < 2 THEN 'origin_id' END, CASE WHEN o_orderkey % 11 < 2 THEN 'origin_version' END, CASE WHEN o_orderkey % 5 < 2 THEN 'start' END) AS problems FROM orders""")
def x1_odd(spark, sf):
    """Descriptions whose numbers can't all be read, with what can't."""
    s = sdp.sessions(odd_descriptions(spark, sf), problems="problems")
    return s.select("session_key", "origin_id", "origin_version", "start", "stop", F.array_join("problems", ",").alias("problems"))


@query("x3_malformed", """SELECT o_orderkey AS session_key, CASE WHEN o_orderkey % 6 > 1 THEN CAST(o_orderkey % 60000 AS INT) END AS port, CASE WHEN o_orderkey % 6 < 2 THEN 'port' ELSE '' END AS media_problems, '0' AS pts,
  CASE WHEN o_orderkey % 9 > 1 THEN 127 END AS ttl, CASE WHEN o_orderkey % 3 > 1 THEN 8000 END AS clock_rate, CAST(o_orderkey AS VARCHAR) AS a, CASE WHEN o_orderkey % 3 < 2 THEN 'clock_rate' ELSE '' END AS problems, CASE WHEN o_orderkey % 4 > 1 THEN o_orderkey END AS most FROM orders""")
def x3_odd(spark, sf):
    """The media sections and attributes of such descriptions; of a parameter that is there twice the last value counts."""
    m = sdp.media(odd_descriptions(spark, sf), problems="media_problems")
    a = sdp.attributes(m, problems="problems").groupBy("session_key").agg(F.max("clock_rate").alias("clock_rate"), F.max(F.try_element_at("params", F.lit("a"))).alias("a"), F.array_join(F.flatten(F.collect_list("problems")), ",").alias("problems"))
    own = m.select("session_key", "port", F.array_join("media_problems", ",").alias("media_problems"), F.array_join(F.transform("pts", lambda x: x.cast("string")), ",").alias("pts"), sdp.connection(F.col("connection"))["ttl"].alias("ttl"))
    return own.join(a, "session_key").join(sdp.bandwidth(m).select("session_key", F.col("AS").alias("most")), "session_key", "left")


@query("x8_malformed", """SELECT conv_id AS conn_id, turn, CASE WHEN turn % 5 > 0 THEN turn END AS cseq, CASE WHEN conv_id % 3 > 0 THEN 30 ELSE 60 END AS timeout, CASE WHEN conv_id % 7 > 0 THEN 1.5::DOUBLE END AS at, CASE WHEN turn % 4 > 0 THEN 4000 END AS client_low,
  CASE WHEN conv_id % 2 = 0 THEN 11 END AS ssrc, CASE WHEN turn % 3 > 0 THEN 5 END AS seq,
  concat_ws(',', CASE WHEN turn % 5 = 0 THEN 'cseq' END, CASE WHEN conv_id % 3 = 0 THEN 'session' END, CASE WHEN conv_id % 7 = 0 THEN 'timestamp' END, CASE WHEN turn % 4 = 0 OR conv_id % 2 = 1 THEN 'transport' END, CASE WHEN turn % 3 = 0 THEN 'rtp-info' END) AS problems FROM conversations""")
def x8_odd(spark, sf):
    """Messages of every turn, in whose headers numbers are malformed and names are repeated now and then."""
    c, t = F.col("conv_id"), F.col("turn")
    either = lambda ok, good, bad: F.when(ok, good).otherwise(bad)
    lines = [
        F.lit("SETUP rtsp://h/x RTSP/1.0"), F.concat(F.lit("CSeq: "), either(t % 5 > 0, t.cast("string"), "99999999999")), F.concat(F.lit("Session: a;timeout="), either(c % 3 > 0, "30", "99999999999")), F.concat(F.lit("Timestamp: "), either(c % 7 > 0, "1.5", "1.2.3")),
        F.concat(F.lit("Transport: RTP/AVP;unicast;ssrc=1;client_port="), either(t % 4 > 0, "4000-4001", "99999999999"), F.lit(";ssrc="), either(c % 2 == 0, "0b", "123456789")), F.concat(F.lit("RTP-Info: url=u;seq="), either(t % 3 > 0, "5", "12345678901234567890"), F.lit(";rtptime=7")),
    ]
    p = ms.parse(spark.read.parquet(f"{sf}/conversations.parquet").select(c.alias("conn_id"), "turn", F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")).alias("raw")))
    moved = ms.transport(ms.header("transport"))
    return p.select("conn_id", "turn", ms.cseq().alias("cseq"), ms.session(ms.header("session"))["timeout"].alias("timeout"), ms.timestamp_delay(ms.header("timestamp"))["at"].alias("at"), moved["client_low"].alias("client_low"), moved["ssrc"].cast("int").alias("ssrc"), F.get(ms.rtp_info(ms.header("rtp-info")), F.lit(0))["seq"].cast("int").alias("seq"), F.array_join(ms.header_problems(), ",").alias("problems"))
