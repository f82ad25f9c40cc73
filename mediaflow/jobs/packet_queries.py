"""Queries over the derived packets, each with the SQL that gives the same rows from the source columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaflow.functions.storage import written
from mediaflow.operators import frames as fr
from mediaflow.operators import reports, routing, rtp
from mediaflow.operators import sequence as sq
from mediaflow.sources.derived import CONTEXTS, PACKETS, contexts, duck, packets, packets_raw

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def hexed(c):
    return F.hex(c)


def joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


#: The packets' sizes and extended numbers, in SQL.
SHAPED = """
shaped AS (
  SELECT *, event_id % 4 AS cc, CASE WHEN event_id % 3 = 0 THEN event_id % 2 + 1 ELSE 0 END AS w,
         CASE WHEN event_id % 5 = 0 THEN 4 ELSE 0 END AS pad, CASE WHEN event_id % 13 = 0 THEN 9 ELSE 0 END AS cut FROM packets),
sized AS (
  SELECT *, 12 + 4 * cc + CASE WHEN w > 0 THEN 4 + 4 * w ELSE 0 END + payload_len + pad - cut AS n,
         CASE WHEN pad = 0 THEN 0 WHEN cut = 0 THEN 4 ELSE ascii(substr(props, payload_len - 5, 1)) END AS pad_octets FROM shaped),
ext_sized AS (SELECT *, CASE WHEN w > 0 AND n >= 12 + 4 * cc + 4 THEN least(4 + 4 * w, n - 12 - 4 * cc) END AS x FROM sized)"""
EXT = """
unwrapped AS (SELECT *, CAST(65500 + ssrc % 30 + send_idx AS BIGINT) AS ext FROM packets),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY ssrc, ext ORDER BY arrival_ms, event_id, copy) AS dup_rank,
         greatest(0, coalesce(max(ext) OVER (PARTITION BY ssrc ORDER BY arrival_ms, event_id, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - ext, 0)) AS late_by
  FROM unwrapped)"""
W = "(PARTITION BY ssrc ORDER BY arrival_ms, event_id, copy)"
CLOCK = "CASE pt WHEN 0 THEN 8000 WHEN 8 THEN 8000 ELSE 90000 END"


def decoded(spark, sf, plain=False) -> DataFrame:
    return rtp.decode_header(packets_raw(spark, sf, plain))


def unwrapped(spark, sf) -> DataFrame:
    return sq.unwrap(packets(spark, sf))


def ranked(spark, sf) -> DataFrame:
    return sq.duplicates(unwrapped(spark, sf))


def clocked(spark, sf) -> DataFrame:
    return rtp.describe(packets(spark, sf)).withColumn("clock_rate", F.coalesce("clock_rate", F.lit(90000)))


# -- decoding ----------------------------------------------------------------------------------------------------------
@query("d1_rtp_header", duck(" SELECT event_id, copy, 2 AS version, 0 AS padding, 0 AS extension, 0 AS cc, marker, pt, seq, rtp_ts, ssrc FROM packets", PACKETS))
def d1(spark, sf):
    return decoded(spark, sf, plain=True).drop("raw", "arrival_ms")


@query("d2_csrcs", duck(" SELECT event_id, copy, array_to_string(list_transform(range(1, least(cc, (n - 12) // 4) + 1), lambda i: CAST(ssrc * 10 + i AS VARCHAR)), ',') AS csrcs FROM sized", PACKETS, SHAPED))
def d2(spark, sf):
    return decoded(spark, sf).select("event_id", "copy", joined(rtp.csrcs()).alias("csrcs"))


@query("d3_extension", duck(" SELECT event_id, copy, CASE WHEN x IS NOT NULL THEN 43948 END AS profile, CASE WHEN x IS NOT NULL THEN w END AS words, x AS size, CASE WHEN x IS NOT NULL THEN left(repeat('D4BB8A43', w::INT), (2 * (x - 4))::INT) END AS data FROM ext_sized", PACKETS, SHAPED))
def d3(spark, sf):
    x = rtp.extension()
    return decoded(spark, sf).select("event_id", "copy", x["profile"].alias("profile"), x["words"].alias("words"), x["size"].alias("size"), hexed(x["data"]).alias("data"))


_BOUNDS = ", b AS (SELECT *, least(n, 12 + 4 * cc + coalesce(x, 0)) AS start FROM ext_sized)"


@query("d4_payload", duck(_BOUNDS + " SELECT event_id, copy, pad_octets AS padding_octets, start AS header_octets, hex(encode(substr(props, 1, greatest(0, n - start - pad_octets)::INT))) AS payload FROM b", PACKETS, SHAPED))
def d4(spark, sf):
    return decoded(spark, sf).select("event_id", "copy", rtp.padding_octets().alias("padding_octets"), rtp.header_octets().alias("header_octets"), hexed(rtp.payload()).alias("payload"))


@query("d5_complete", duck(", e AS (SELECT *, 12 + 4 * cc + CASE WHEN w > 0 AND n >= 16 + 4 * cc THEN 4 + 4 * w ELSE 0 END AS stop FROM sized) SELECT event_id, copy, n >= 12 + 4 * cc AND (w = 0 OR n >= 12 + 4 * cc + 4 + 4 * w) AND (pad = 0 OR (pad_octets > 0 AND n - stop >= pad_octets)) AS complete FROM e", PACKETS, SHAPED))
def d5(spark, sf):
    return decoded(spark, sf).select("event_id", "copy", rtp.is_complete().alias("complete"))


@query("d6_rewrite", duck(" SELECT event_id, copy, 2 AS version, 1 AS marker, 97 AS pt, (seq + 1000) % 65536 AS seq, (rtp_ts + 5) % 4294967296 AS rtp_ts, ssrc + 7 AS ssrc, hex(encode(props)) AS rest FROM packets", PACKETS))
def d6(spark, sf):
    d = decoded(spark, sf, plain=True)
    new = d.select("event_id", "copy", rtp.rewrite(pt=F.lit(97), marker=F.lit(1), seq=(F.col("seq") + 1000) % 65536, rtp_ts=(F.col("rtp_ts") + 5) % (1 << 32), ssrc=F.col("ssrc") + 7).alias("raw"))
    return rtp.decode_header(new).select("event_id", "copy", "version", "marker", "pt", "seq", "rtp_ts", "ssrc", hexed(rtp.payload()).alias("rest"))


@query("d7_payload_description", duck(" SELECT event_id, copy, pt, CASE pt WHEN 0 THEN 'PCMU' WHEN 8 THEN 'PCMA' WHEN 33 THEN 'MP2T' WHEN 26 THEN 'JPEG' ELSE 'Dynamic' END AS encoding, CASE pt WHEN 0 THEN 8000 WHEN 8 THEN 8000 WHEN 96 THEN NULL ELSE 90000 END AS clock_rate, CASE pt WHEN 0 THEN 1 WHEN 8 THEN 1 WHEN 96 THEN NULL ELSE 0 END AS channels FROM packets", PACKETS))
def d7(spark, sf):
    return rtp.describe(packets(spark, sf)).select("event_id", "copy", "pt", "encoding", "clock_rate", "channels")


@query("f1_valid_rtp", duck(""" SELECT event_id, copy, CASE WHEN pt = 26 THEN 'payload type' WHEN pad > 0 AND n > 12 AND pad_octets >= n - 12 THEN 'padding' WHEN cc > 0 AND n - 12 < 4 * cc THEN 'csrc'
  WHEN w > 0 AND (pad_octets >= n - 12 OR (CASE WHEN n >= 16 + 4 * cc THEN 4 + 4 * w ELSE 4 END) > n - 12 - pad_octets) THEN 'extension' END AS failure FROM sized""", PACKETS, SHAPED))
def f1(spark, sf):
    return decoded(spark, sf).withColumn("pts", F.array(*(F.lit(x) for x in (0, 8, 33, 96)))).select("event_id", "copy", rtp.failure("pts").alias("failure"))


# -- sequence ----------------------------------------------------------------------------------------------------------
@query("w1_unwrap_seq", duck(" SELECT event_id, copy, ssrc, ext FROM unwrapped", PACKETS, EXT))
def w1(spark, sf):
    return unwrapped(spark, sf).select("event_id", "copy", "ssrc", "ext")


@query("w1_unwrap_sliced", duck(" SELECT event_id, copy, ssrc, ext FROM unwrapped", PACKETS, EXT))
def w1s(spark, sf):
    return sq.unwrap_sliced(packets(spark, sf), slice_ms=700).select("event_id", "copy", "ssrc", "ext")


W2_SQL = """,
o AS (SELECT *, row_number() OVER (PARTITION BY ssrc ORDER BY arrival_ms, event_id, copy) AS k FROM packets),
st(ssrc, k, event_id, copy, ok, prob, top, bad, cyc) AS (
  SELECT ssrc, CAST(k AS BIGINT), event_id, copy, false, 1, seq, 65537, CAST(0 AS BIGINT) FROM o WHERE k = 1
  UNION ALL
  SELECT o.ssrc, CAST(o.k AS BIGINT), o.event_id, o.copy,
    CASE WHEN prob > 0 THEN o.seq = top + 1 WHEN (o.seq - top + 65536) % 65536 < 500 THEN true
         WHEN (o.seq - top + 65536) % 65536 <= 65436 THEN o.seq = bad ELSE false END,
    CASE WHEN prob > 0 THEN CASE WHEN o.seq = top + 1 THEN 0 ELSE 1 END ELSE 0 END,
    CASE WHEN prob > 0 OR (o.seq - top + 65536) % 65536 < 500 OR ((o.seq - top + 65536) % 65536 <= 65436 AND o.seq = bad) THEN o.seq ELSE top END,
    CASE WHEN prob > 0 THEN CASE WHEN o.seq = top + 1 THEN 65537 ELSE bad END WHEN (o.seq - top + 65536) % 65536 < 500 THEN bad
         WHEN (o.seq - top + 65536) % 65536 <= 65436 THEN CASE WHEN o.seq = bad THEN 65537 ELSE (o.seq + 1) % 65536 END ELSE bad END,
    CASE WHEN prob > 0 THEN CASE WHEN o.seq = top + 1 THEN 0 ELSE cyc END
         WHEN (o.seq - top + 65536) % 65536 < 500 THEN cyc + CASE WHEN o.seq < top THEN 65536 ELSE 0 END
         WHEN (o.seq - top + 65536) % 65536 <= 65436 AND o.seq = bad THEN 0 ELSE cyc END
  FROM st JOIN o ON o.ssrc = st.ssrc AND o.k = st.k + 1)
SELECT event_id, copy, ssrc, ok AS accepted, prob AS probation, top AS max_seq, bad AS bad_seq, cyc AS cycles FROM st"""


@query("w2_source_state", duck(W2_SQL, PACKETS))
def w2(spark, sf):
    return sq.source_state(packets(spark, sf)).drop("arrival_ms", "seq")


@query("w2_sliced_state", duck(W2_SQL, PACKETS))
def w2s(spark, sf):
    """The same, each source walked in slices of ten seconds."""
    return sq.source_state_sliced(packets(spark, sf), 10_000).drop("arrival_ms")


@query("w3_interarrival", duck(f" SELECT event_id, copy, arrival_ms - lag(arrival_ms) OVER {W} AS gap_ms FROM packets", PACKETS))
def w3(spark, sf):
    return sq.interarrival(packets(spark, sf)).select("event_id", "copy", "gap_ms")


W4_SQL = f""", d AS (SELECT *, abs((arrival_ms - lag(arrival_ms) OVER {W}) * ({CLOCK}) / 1000.0::DOUBLE - ((rtp_ts - lag(rtp_ts) OVER {W} + 6442450944) % 4294967296 - 2147483648)) AS d FROM packets)
SELECT ssrc, round(list_reduce([0.0::DOUBLE] || list(d ORDER BY arrival_ms, event_id, copy) FILTER (d IS NOT NULL), lambda a, b: a + (b - a) / 16), 4) AS jitter FROM d GROUP BY ssrc"""


@query("w4_jitter", duck(W4_SQL, PACKETS))
def w4(spark, sf):
    rows = sq.jitter(clocked(spark, sf))
    return rows.groupBy("ssrc").agg(F.round(F.max_by("jitter", F.struct("arrival_ms", "event_id", "copy")), 4).alias("jitter"))


@query("w4_sliced_jitter", duck(W4_SQL, PACKETS))
def w4s(spark, sf):
    """The same, each source walked in slices of ten seconds."""
    rows = sq.jitter_sliced(clocked(spark, sf), 10_000)
    return rows.groupBy("ssrc").agg(F.round(F.max_by("jitter", F.struct("arrival_ms", "event_id", "copy")), 4).alias("jitter"))


@query("w4_cumulative_jitter", duck(f", g AS (SELECT *, coalesce(arrival_ms - lag(arrival_ms) OVER {W}, 0) AS d FROM packets) SELECT event_id, copy, CAST(sum(d - ((d + 8) >> 4)) OVER {W} AS BIGINT) AS jitter FROM g", PACKETS))
def w4c(spark, sf):
    return sq.cumulative_jitter(packets(spark, sf)).select("event_id", "copy", "jitter")


GAPS = ", n AS (SELECT ssrc, ext, lead(ext) OVER (PARTITION BY ssrc ORDER BY ext) AS nx FROM (SELECT DISTINCT ssrc, ext FROM unwrapped)), g AS (SELECT ssrc, ext + 1 AS lo, nx - 1 AS hi FROM n WHERE nx > ext + 1)"


@query("w5_gaps", duck(GAPS + " SELECT ssrc, lo AS first_missing, hi AS last_missing, hi - lo + 1 > 500 AS restart FROM g", PACKETS, EXT))
def w5(spark, sf):
    return sq.gaps(unwrapped(spark, sf))


@query("w5_nacks", duck(GAPS + ", m AS (SELECT ssrc, unnest(range(lo, hi + 1)) AS ext FROM g WHERE hi - lo < 500), b AS (SELECT *, min(ext) OVER (PARTITION BY ssrc, ext // 17) AS pid FROM m) SELECT ssrc, CAST(pid % 65536 AS INT) AS pid, pid AS ext, CAST(sum(CASE WHEN ext > pid THEN 1 << (ext - pid - 1)::INT ELSE 0 END) AS INT) AS blp FROM b GROUP BY ssrc, b.pid", PACKETS, EXT))
def w5n(spark, sf):
    return sq.nacks(unwrapped(spark, sf))


@query("w6_duplicates", duck(" SELECT event_id, copy, CAST(dup_rank AS INT) AS dup_rank, CAST(late_by AS BIGINT) AS late_by FROM ranked", PACKETS, EXT))
def w6(spark, sf):
    return ranked(spark, sf).select("event_id", "copy", "dup_rank", "late_by")


@query("w7_source_change", duck(""", s AS (SELECT *, ssrc % 10 AS stream FROM packets), c AS (SELECT *, CASE WHEN ssrc <> lag(ssrc) OVER (PARTITION BY stream ORDER BY arrival_ms, event_id, copy) THEN 1 ELSE 0 END AS changed FROM s)
SELECT event_id, copy, changed, CAST(sum(changed) OVER (PARTITION BY stream ORDER BY arrival_ms, event_id, copy) AS BIGINT) AS epoch FROM c""", PACKETS))
def w7(spark, sf):
    return sq.source_changes(packets(spark, sf).withColumn("stream", F.col("ssrc") % 10), "stream").select("event_id", "copy", "changed", "epoch")


@query("w8_running_counters", duck(f" SELECT event_id, copy, count(*) OVER {W} AS packets_so_far, CAST(sum(payload_len) OVER {W} AS BIGINT) AS octets_so_far FROM packets", PACKETS))
def w8(spark, sf):
    return sq.running_counters(packets(spark, sf)).select("event_id", "copy", "packets_so_far", "octets_so_far")


@query("w9_latest", duck(" SELECT ssrc, event_id, seq, arrival_ms FROM (SELECT *, row_number() OVER (PARTITION BY ssrc ORDER BY arrival_ms DESC, event_id DESC, copy DESC) AS k FROM packets) WHERE k = 1", PACKETS))
def w9(spark, sf):
    return sq.latest(packets(spark, sf), ["ssrc"], sq.ORDER).select("ssrc", "event_id", "seq", "arrival_ms")


@query("a4_loss", duck(" SELECT ssrc, min(ext) AS base, max(ext) AS ext_max, max(ext) - min(ext) + 1 AS expected, count(*) AS received, max(ext) - min(ext) + 1 - count(*) AS lost FROM unwrapped GROUP BY ssrc", PACKETS, EXT))
def a4(spark, sf):
    return sq.loss(unwrapped(spark, sf))


INTERVAL = """, i AS (SELECT ssrc, arrival_ms // 4960 AS bucket, max(ext) AS hi, min(ext) AS lo, count(*) AS n FROM unwrapped GROUP BY 1, 2),
t AS (SELECT *, max(hi) OVER v - min(lo) OVER (PARTITION BY ssrc) + 1 AS expected, sum(n) OVER v AS received FROM i WINDOW v AS (PARTITION BY ssrc ORDER BY bucket)),
e AS (SELECT *, expected - coalesce(lag(expected) OVER v, 0) AS de, received - coalesce(lag(received) OVER v, 0) AS dr FROM t WINDOW v AS (PARTITION BY ssrc ORDER BY bucket)),
il AS (SELECT ssrc, bucket, hi AS bucket_max, expected, CAST(received AS BIGINT) AS received, CAST(de - dr AS BIGINT) AS lost, CAST(CASE WHEN de = 0 OR de - dr <= 0 THEN 0 ELSE floor((de - dr) * 256 / de) END AS INT) AS fraction FROM e)"""


@query("a5_interval_loss", duck(INTERVAL + " SELECT * FROM il", PACKETS, EXT))
def a5(spark, sf):
    return sq.interval_loss(unwrapped(spark, sf), 4960)


# -- frames ------------------------------------------------------------------------------------------------------------
FRAMES = """, f AS (SELECT ssrc, rtp_ts, pt, count(*) FILTER (dup_rank = 1) AS packets, CAST(coalesce(sum(marker) FILTER (dup_rank = 1), 0) AS BIGINT) AS markers, min(ext) AS low, max(ext) AS high,
  CAST(coalesce(sum(payload_len) FILTER (dup_rank = 1), 0) AS BIGINT) AS octets, min(arrival_ms) AS first_ms, max(arrival_ms) AS last_ms FROM ranked GROUP BY 1, 2, 3),
fs AS (SELECT *, high - low + 1 <> packets AS is_missing, high - low + 1 = packets AND markers > 0 AS is_complete FROM f)"""


@query("a8_frames", duck(FRAMES + " SELECT * FROM fs", PACKETS, EXT))
def a8(spark, sf):
    """Complete and incomplete frames of every source, from encoded packets on."""
    d = decoded(spark, sf, plain=True).withColumn("payload_len", F.octet_length(rtp.payload()).cast("long"))
    return fr.frames(sq.duplicates(sq.unwrap(d)))


@query("a9_assemble", duck(FRAMES + " SELECT ssrc, rtp_ts, pt, hex(encode(string_agg(props, '' ORDER BY ext))) AS payload FROM ranked JOIN fs USING (ssrc, rtp_ts, pt) WHERE dup_rank = 1 AND is_complete GROUP BY 1, 2, 3", PACKETS, EXT))
def a9(spark, sf):
    d = decoded(spark, sf, plain=True).withColumn("payload", rtp.payload()).withColumn("payload_len", F.octet_length("payload").cast("long"))
    return fr.assemble(sq.duplicates(sq.unwrap(d))).select("ssrc", "rtp_ts", "pt", hexed("payload").alias("payload"))


@query("o1_reorder", duck(" SELECT ssrc, ext, event_id, copy, row_number() OVER (PARTITION BY ssrc ORDER BY ext, arrival_ms, event_id, copy) AS place FROM unwrapped", PACKETS, EXT))
def o1(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("ssrc").orderBy("ext", *sq.ORDER)
    return fr.reorder(unwrapped(spark, sf)).select("ssrc", "ext", "event_id", "copy", F.row_number().over(w).cast("long").alias("place"))


@query("o2_cap", duck(", k AS (SELECT *, row_number() OVER v AS k, coalesce(sum(marker) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM unwrapped WINDOW v AS (PARTITION BY ssrc, rtp_ts, pt ORDER BY ext, arrival_ms, event_id, copy)) SELECT event_id, copy, ssrc, ext FROM k WHERE m = 0 AND k <= 1024", PACKETS, EXT))
def o2(spark, sf):
    return fr.cap(unwrapped(spark, sf), close_at_marker=True).select("event_id", "copy", "ssrc", "ext")


@query("a10_sources", duck(", s AS (SELECT ssrc % 10 AS stream, ssrc, cc FROM sized) SELECT stream, count(DISTINCT ssrc) AS sources FROM s GROUP BY stream", PACKETS, SHAPED))
def a10(spark, sf):
    return packets(spark, sf).groupBy((F.col("ssrc") % 10).alias("stream")).agg(F.count_distinct("ssrc").alias("sources"))


@query("a10_contributing", duck(", c AS (SELECT ssrc % 10 AS stream, ssrc * 10 + unnest(range(1, least(cc, (n - 12) // 4) + 1)) AS source FROM sized) SELECT stream, count(DISTINCT source) AS contributing FROM c GROUP BY stream", PACKETS, SHAPED))
def a10c(spark, sf):
    return decoded(spark, sf).select((F.col("ssrc") % 10).alias("stream"), F.explode(rtp.csrcs()).alias("source")).groupBy("stream").agg(F.count_distinct("source").alias("contributing"))


@query("a10_approximate", duck(" SELECT ssrc % 10 AS stream, true AS within_bound FROM packets GROUP BY 1", PACKETS))
def a10a(spark, sf):
    """Whether the sketch's count is within three of its standard errors (5% each) of the exact one."""
    counts = packets(spark, sf).groupBy((F.col("ssrc") % 10).alias("stream")).agg(F.approx_count_distinct("ssrc", 0.05).alias("sources"), F.count_distinct("ssrc").alias("exact"))
    return counts.select("stream", (F.abs(F.col("sources") - F.col("exact")) <= 0.15 * F.col("exact")).alias("within_bound"))


@query("a10_sketches", duck(""", i AS (SELECT ssrc % 10 AS stream, arrival_ms // 4960 AS bucket, count(DISTINCT ssrc) AS sources FROM packets GROUP BY 1, 2),
m AS (SELECT ssrc % 10 AS stream, arrival_ms // 4960 // 12 AS bucket, count(DISTINCT ssrc) AS sources FROM packets GROUP BY 1, 2), a AS (SELECT ssrc % 10 AS stream, NULL AS bucket, count(DISTINCT ssrc) AS sources FROM packets GROUP BY 1)
SELECT 'interval' AS level, * FROM i UNION ALL SELECT 'dozen', * FROM m UNION ALL SELECT 'all', * FROM a""", PACKETS))
def a10s(spark, sf):
    """Sources of each interval, of a dozen and of all, the longer ones from what is written of the shortest: exact sets, since sketches
    are exact for a few hundred sources only."""
    held = written(reports.source_sets(packets(spark, sf).withColumn("stream", F.col("ssrc") % 10), 4960, ("stream",)))
    levels = [("interval", reports.counted(held, "stream", "bucket")), ("dozen", reports.counted(held, "stream", F.floor(F.col("bucket") / 12).alias("bucket"))), ("all", reports.counted(held, "stream").withColumn("bucket", F.lit(None).cast("long")))]
    one, two, three = (x.select(F.lit(n).alias("level"), "stream", "bucket", "sources") for n, x in levels)
    return one.unionByName(two).unionByName(three)


# -- routing -----------------------------------------------------------------------------------------------------------
ROUTED = """,
ends AS (SELECT ssrc, max(session_id) AS s FROM (SELECT session_id, local_ssrc AS ssrc FROM contexts UNION ALL SELECT session_id, remote_ssrc FROM contexts) GROUP BY ssrc),
types AS (SELECT pt, max(session_id) AS p FROM contexts GROUP BY pt),
routed AS (SELECT packets.*, coalesce(s, p) AS session_id, CASE WHEN s IS NOT NULL THEN 'ssrc' WHEN p IS NOT NULL THEN 'pt' END AS routed_by FROM packets LEFT JOIN ends USING (ssrc) LEFT JOIN types USING (pt))"""


def routed(spark, sf):
    return routing.route(packets(spark, sf), contexts(spark, sf))


@query("j1_route_packets", duck(ROUTED + " SELECT event_id, copy, session_id, routed_by FROM routed", PACKETS, CONTEXTS))
def j1(spark, sf):
    return routed(spark, sf).select("event_id", "copy", "session_id", "routed_by")


@query("j2_unaddressed", duck(ROUTED + " SELECT event_id, copy, ssrc FROM routed WHERE session_id IS NULL", PACKETS, CONTEXTS))
def j2(spark, sf):
    return routing.unaddressed(packets(spark, sf), contexts(spark, sf)).select("event_id", "copy", "ssrc")


@query("j3_conflicts", duck(" SELECT a.session_id AS a, b.session_id AS b, 'identity' AS kind FROM contexts a JOIN contexts b ON a.remote_ssrc = b.remote_ssrc AND a.pt = b.pt AND a.session_id < b.session_id", CONTEXTS))
def j3(spark, sf):
    return routing.conflicts(contexts(spark, sf))


@query("j3_identity_classes", duck(""", k AS (SELECT session_id, pt, 'local' AS kind, 100000 + session_id % 700 AS ssrc FROM contexts UNION SELECT session_id, pt, 'remote', CASE WHEN session_id % 13 = 0 THEN 0 ELSE remote_ssrc END FROM contexts),
g AS (SELECT kind, ssrc, pt, min(session_id) AS first FROM k WHERE ssrc <> 0 GROUP BY 1, 2, 3 HAVING count(*) > 1) SELECT kind, ssrc, pt, session_id, first FROM k JOIN g USING (kind, ssrc, pt)""", CONTEXTS))
def j3i(spark, sf):
    """Contexts whose local sources repeat, and some of whose remote ones aren't known yet."""
    c = contexts(spark, sf).withColumns({"local_ssrc": 100000 + F.col("session_id") % 700, "remote_ssrc": F.when(F.col("session_id") % 13 == 0, 0).otherwise(F.col("remote_ssrc"))})
    return routing.identity_classes(c)


@query("j3_channel_clashes", duck(""", e AS (SELECT session_id % 97 AS client_id, session_id, data_ch AS channel FROM contexts UNION SELECT session_id % 97, session_id, ctrl_ch FROM contexts)
SELECT client_id, channel, count(*) AS sessions FROM e GROUP BY 1, 2 HAVING count(*) > 1""", CONTEXTS))
def j3c(spark, sf):
    return routing.channel_clashes(contexts(spark, sf).withColumn("client_id", F.col("session_id") % 97))


@query("j3_own_source", duck(", shifted AS (SELECT event_id, copy, ssrc + CASE WHEN event_id % 9 = 0 THEN 100000 ELSE 0 END AS ssrc FROM packets) SELECT * FROM shifted WHERE ssrc IN (SELECT local_ssrc FROM contexts)", PACKETS, CONTEXTS))
def j3o(spark, sf):
    p = packets(spark, sf).withColumn("ssrc", F.col("ssrc") + F.when(F.col("event_id") % 9 == 0, 100000).otherwise(0))
    return routing.own_source(p, contexts(spark, sf)).select("event_id", "copy", "ssrc")


@query("j4_channels", duck(""", ch AS (SELECT channel, max(session_id) AS session_id FROM (SELECT session_id, data_ch AS channel FROM contexts UNION ALL SELECT session_id, ctrl_ch FROM contexts) GROUP BY channel)
SELECT event_id, copy, CAST(event_id % 20 AS INT) AS channel, session_id, CASE WHEN session_id IS NULL THEN NULL WHEN event_id % 20 % 2 = 0 THEN 'data' ELSE 'control' END AS carries FROM packets LEFT JOIN ch ON ch.channel = event_id % 20""", PACKETS, CONTEXTS))
def j4(spark, sf):
    return routing.by_channel(packets(spark, sf).select("event_id", "copy", (F.col("event_id") % 20).cast("int").alias("channel")), contexts(spark, sf))


@query("j5_fan_out", duck(" SELECT event_id, copy, count(*) AS sessions, CAST(sum(session_id) AS BIGINT) AS session_sum, min(session_id) AS first_session, max(session_id) AS last_session FROM packets JOIN contexts USING (pt) GROUP BY 1, 2", PACKETS, CONTEXTS))
def j5(spark, sf):
    """Every packet to every session of its type, told by packet."""
    sent = routing.fan_out_summary(packets(spark, sf), contexts(spark, sf).select("session_id", "pt"), ["pt"])
    return sent.select("event_id", "copy", "sessions", "session_sum", "first_session", "last_session")


@query("j5_fan_out_all")
def j5_all(spark, sf):
    """Every packet to every session of its type. Tests hold it against brute force."""
    p = packets(spark, sf).select("event_id", "copy", "pt")
    return routing.fan_out(p, contexts(spark, sf).select("session_id", "pt"), ["pt"]).select("event_id", "copy", "session_id")


@query("j5_fan_out_totals", duck(" SELECT session_id, count(*) AS packets, CAST(sum(payload_len) AS BIGINT) AS octets FROM packets JOIN contexts USING (pt) GROUP BY session_id", PACKETS, CONTEXTS))
def j5t(spark, sf):
    return routing.fan_out_totals(packets(spark, sf), contexts(spark, sf).select("session_id", "pt"), ["pt"])


@query("f5_known_types", duck(ROUTED + " SELECT event_id, copy, r.session_id FROM routed r WHERE EXISTS (SELECT 1 FROM contexts c WHERE c.session_id = r.session_id AND c.pt = r.pt)", PACKETS, CONTEXTS))
def f5(spark, sf):
    return routing.known_types(routed(spark, sf), contexts(spark, sf)).select("event_id", "copy", "session_id")


STREAMS = " , st AS (SELECT s_suppkey AS stream_id, lower(s_name) AS name, ['cam' || s_suppkey, 'en-' || (s_suppkey * 3)] AS aliases FROM supplier)"
J9_SQL = """
WITH u AS (SELECT page_id AS url_id, CASE page_id % 4 WHEN 0 THEN 'rtsp://host/live/Cam' || (page_id % 130) || '/trackID=1' WHEN 1 THEN 'rtsp://host/' || (page_id % 130) || '/video'
  WHEN 2 THEN 'rtsp://host/x/SUPPLIER%23' || '?q=1' ELSE url END AS url FROM pages),
p AS (SELECT *, string_split(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '/') AS ps FROM u),
k AS (SELECT *, CASE WHEN (regexp_matches(lower(ps[-1]), '^trackid=') OR lower(ps[-1]) IN ('audio', 'video', 'text', 'application')) AND len(ps) > 1 THEN lower(ps[-2]) ELSE lower(ps[-1]) END AS word FROM p),
names AS (SELECT 1 AS rank, lower(s_name) AS word, s_suppkey AS stream_id FROM supplier UNION ALL SELECT 2, CAST(s_suppkey AS VARCHAR), s_suppkey FROM supplier UNION ALL SELECT 3, 'cam' || s_suppkey, s_suppkey FROM supplier),
best AS (SELECT word, rank, stream_id FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY rank, stream_id) AS n FROM names) WHERE n = 1)
SELECT url_id, url, word, stream_id, rank AS matched_by FROM k LEFT JOIN best USING (word)"""


@query("j9_stream_lookup", J9_SQL)
def j9(spark, sf):
    pages, suppliers = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("pages", "supplier"))
    host = lambda *x: F.concat(F.lit("rtsp://host/"), *x)
    n = (F.col("page_id") % 130).cast("string")
    kind = F.col("page_id") % 4
    urls = pages.select(F.col("page_id").alias("url_id"), F.when(kind == 0, host(F.lit("live/Cam"), n, F.lit("/trackID=1"))).when(kind == 1, host(n, F.lit("/video"))).when(kind == 2, host(F.lit("x/SUPPLIER%23?q=1"))).otherwise(F.col("url")).alias("url"))
    streams = suppliers.select(F.col("s_suppkey").alias("stream_id"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("cam"), F.col("s_suppkey").cast("string"))).alias("aliases"))
    return routing.find_stream(urls, streams)


# -- statistics and reports --------------------------------------------------------------------------------------------
STATS = ROUTED + """, stats AS (SELECT session_id, ssrc, count(*) FILTER (event_id % 23 <> 0) AS packets, CAST(coalesce(sum(payload_len) FILTER (event_id % 23 <> 0), 0) AS BIGINT) AS rfc_octets,
  CAST(coalesce(sum(payload_len + 12) FILTER (event_id % 23 <> 0), 0) AS BIGINT) AS total_octets, min(arrival_ms) AS first_ms, max(arrival_ms) AS last_ms, count(*) FILTER (event_id % 23 = 0) AS failed
  FROM routed WHERE session_id IS NOT NULL GROUP BY 1, 2)"""


def stats(spark, sf):
    return reports.context_stats(routed(spark, sf).where("session_id IS NOT NULL").withColumn("failed", F.col("event_id") % 23 == 0))


@query("a1_context_stats", duck(STATS + " SELECT * FROM stats", PACKETS, CONTEXTS))
def a1(spark, sf):
    return stats(spark, sf)


@query("a2_totals", duck(STATS + " SELECT session_id, ssrc, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(total_octets) AS BIGINT) AS octets, CAST(sum(failed) AS BIGINT) AS failed, CAST(grouping(session_id) * 2 + grouping(ssrc) AS INT) AS level FROM stats GROUP BY ROLLUP (session_id, ssrc)", PACKETS, CONTEXTS))
def a2(spark, sf):
    return reports.totals(stats(spark, sf))


@query("a3_rtcp_bandwidth", duck(STATS + ", r AS (SELECT session_id, CAST(sum(total_octets) AS BIGINT) AS received_octets, CAST(sum(packets // 5 * 60) AS BIGINT) AS rtcp_octets FROM stats GROUP BY 1) SELECT *, received_octets > 0 AND rtcp_octets > 0 AND rtcp_octets >= received_octets / 4.96::DOUBLE AS exceeded FROM r", PACKETS, CONTEXTS))
def a3(spark, sf):
    per = stats(spark, sf).groupBy("session_id").agg(F.sum("total_octets").alias("received_octets"), F.sum(F.floor(F.col("packets") / 5) * 60).alias("rtcp_octets"))
    return reports.rtcp_exceeded(per)


REPORTS = f""", rc AS (SELECT *, count(*) OVER {W} AS packets_so_far, CAST(sum(payload_len) OVER {W} AS BIGINT) AS octets_so_far, arrival_ms // 4960 AS bucket FROM packets),
sr AS (SELECT ssrc, bucket, arrival_ms, rtp_ts, packets_so_far, octets_so_far FROM (SELECT *, row_number() OVER (PARTITION BY ssrc, bucket ORDER BY arrival_ms DESC, event_id DESC, copy DESC) AS k FROM rc) WHERE k = 1)"""


@query("a7_sender_reports", duck(REPORTS + " SELECT * FROM sr", PACKETS))
def a7(spark, sf):
    return reports.sender_reports(packets(spark, sf))


@query("j7_latest_report", duck(REPORTS + f""", j AS (SELECT p.*, {CLOCK} AS clock, s.arrival_ms AS sa, s.rtp_ts AS st FROM packets p ASOF LEFT JOIN sr s ON p.ssrc = s.ssrc AND p.arrival_ms >= s.arrival_ms)
SELECT ssrc, arrival_ms, event_id, copy, rtp_ts, sa AS sr_ntp_ms, sa + (rtp_ts - st) * 1000.0::DOUBLE / clock AS wall_ms FROM j""", PACKETS))
def j7(spark, sf):
    p = clocked(spark, sf)
    return reports.latest_report(p, reports.sender_reports(p).select("ssrc", "arrival_ms", F.col("arrival_ms").alias("ntp_ms"), "rtp_ts"))


A6_SQL = INTERVAL + f""", jit AS (SELECT ssrc, arrival_ms, event_id, copy, abs((arrival_ms - lag(arrival_ms) OVER {W}) * ({CLOCK}) / 1000.0::DOUBLE - ((rtp_ts - lag(rtp_ts) OVER {W} + 6442450944) % 4294967296 - 2147483648)) AS d, row_number() OVER {W} AS k FROM packets),
jr(ssrc, k, arrival_ms, event_id, copy, j) AS (SELECT ssrc, k, arrival_ms, event_id, copy, 0.0::DOUBLE FROM jit WHERE k = 1 UNION ALL SELECT n.ssrc, n.k, n.arrival_ms, n.event_id, n.copy, r.j + (n.d - r.j) / 16 FROM jr r JOIN jit n ON n.ssrc = r.ssrc AND n.k = r.k + 1),
jl AS (SELECT ssrc, arrival_ms // 4960 AS bucket, arg_max(j, k) AS j FROM jr GROUP BY 1, 2),
rc AS (SELECT *, arrival_ms // 4960 AS bucket FROM packets), s AS (SELECT ssrc, bucket, max(arrival_ms) AS sent FROM rc GROUP BY 1, 2)
SELECT il.ssrc, il.bucket, fraction, lost, bucket_max AS highest, CAST(floor(j) AS BIGINT) AS jitter, lag(sent) OVER (PARTITION BY il.ssrc ORDER BY il.bucket) AS lsr_ms,
  CAST(floor((sent - lag(sent) OVER (PARTITION BY il.ssrc ORDER BY il.bucket)) * 65536 / 1000.0::DOUBLE) AS BIGINT) AS dlsr
FROM il JOIN jl USING (ssrc, bucket) JOIN s USING (ssrc, bucket)"""


def receiver_reports(numbered, jitter):
    """Fraction and loss of each interval, highest number, jitter, and the time of the last sender report with the delay since."""
    from pyspark.sql import Window

    part = sq.interval_loss(numbered, 4960)
    latest = jitter.withColumn("bucket", F.floor(F.col("arrival_ms") / 4960)).groupBy("ssrc", "bucket").agg(F.max_by("jitter", F.struct("arrival_ms", "event_id", "copy")).alias("jitter"), F.max("arrival_ms").alias("sent"))
    before = F.lag("sent").over(Window.partitionBy("ssrc").orderBy("bucket"))
    return part.join(latest, ["ssrc", "bucket"]).select("ssrc", "bucket", "fraction", "lost", F.col("bucket_max").alias("highest"), F.floor("jitter").alias("jitter"), before.alias("lsr_ms"), F.floor((F.col("sent") - before) * 65536 / 1000.0).alias("dlsr"))


@query("a6_receiver_reports", duck(A6_SQL, PACKETS, EXT))
def a6(spark, sf):
    p = clocked(spark, sf)
    return receiver_reports(sq.unwrap(p), sq.jitter(p))


@query("a6_sliced_reports", duck(A6_SQL, PACKETS, EXT))
def a6s(spark, sf):
    """The same, each source walked in slices of ten seconds."""
    p = clocked(spark, sf)
    return receiver_reports(sq.unwrap_sliced(p, 10_000), sq.jitter_sliced(p, 10_000))


@query("j10_reported_loss", duck(INTERVAL + """, rep AS (SELECT ssrc, bucket, lost FROM il WHERE bucket % 2 = 0), m AS (SELECT il.ssrc, il.bucket, il.lost AS measured, max(CASE WHEN rep.bucket IS NOT NULL THEN il.bucket END) OVER (PARTITION BY il.ssrc ORDER BY il.bucket) AS rb FROM il LEFT JOIN rep USING (ssrc, bucket))
SELECT m.ssrc, m.bucket, measured, rep.lost AS reported FROM m LEFT JOIN rep ON rep.ssrc = m.ssrc AND rep.bucket = m.rb""", PACKETS, EXT))
def j10(spark, sf):
    from pyspark.sql import Window

    measured = sq.interval_loss(unwrapped(spark, sf), 4960)
    reported = measured.where("bucket % 2 = 0").select("ssrc", "bucket", F.col("lost").alias("r"))
    w = Window.partitionBy("ssrc").orderBy("bucket")
    return measured.join(reported, ["ssrc", "bucket"], "left").select("ssrc", "bucket", F.col("lost").alias("measured"), F.last("r", ignorenulls=True).over(w).alias("reported"))


_ACTIVE = ROUTED + """, c AS (SELECT session_id, arrival_ms AS active_ms, event_id AS active_event, copy AS active_copy FROM routed), e AS (SELECT session_id, arrival_ms AS at_ms, event_id, copy FROM routed),
a AS (SELECT e.session_id, event_id, copy, at_ms, active_ms, active_event, active_copy FROM e JOIN c ON c.session_id = e.session_id AND at_ms >= active_ms AND at_ms - active_ms <= 4960)"""


@query("j8_activity", duck(_ACTIVE + " SELECT session_id, event_id, copy, at_ms, count(*) AS active, min(active_ms) AS since_ms, max(active_ms) AS last_ms FROM a GROUP BY 1, 2, 3, 4", PACKETS, CONTEXTS))
def j8(spark, sf):
    """By routed packet: how much of its session's activity the interval before it holds, and from when to when."""
    r = routed(spark, sf).where("session_id IS NOT NULL")
    return reports.activity_counts(r.select("session_id", F.col("arrival_ms").alias("at_ms"), "event_id", "copy"), r.select("session_id", F.col("arrival_ms").alias("active_ms")), 4960, ids=("event_id", "copy"))


@query("j8_activity_all", duck(_ACTIVE + " SELECT * FROM a", PACKETS, CONTEXTS))
def j8_all(spark, sf):
    """Every routed packet with every one of its session within the interval before. Tests hold it against brute force, too."""
    r = routed(spark, sf)
    active = r.select("session_id", F.col("arrival_ms").alias("active_ms"), F.col("event_id").alias("active_event"), F.col("copy").alias("active_copy"))
    return reports.activity(r.select("session_id", F.col("arrival_ms").alias("at_ms"), "event_id", "copy"), active, 4960)


@query("t3_interval_reports", duck(" SELECT ssrc, arrival_ms // 4960 AS bucket, count(*) AS packets, CAST(sum(payload_len) AS BIGINT) AS octets FROM packets GROUP BY 1, 2", PACKETS))
def t3(spark, sf):
    return reports.tumbling(packets(spark, sf))


@query("t4_goodbyes", duck(f""", g AS (SELECT *, CASE WHEN arrival_ms - lag(arrival_ms) OVER {W} >= 1500 THEN 1 ELSE 0 END AS nw FROM packets), r AS (SELECT *, CAST(sum(nw) OVER {W} AS BIGINT) AS run FROM g)
SELECT ssrc, run, min(arrival_ms) AS first_ms, max(arrival_ms) AS last_ms, count(*) AS packets, max(arrival_ms) + 1500 AS goodbye_ms FROM r GROUP BY 1, 2""", PACKETS))
def t4(spark, sf):
    return reports.silences(packets(spark, sf), timeout_ms=1500)
