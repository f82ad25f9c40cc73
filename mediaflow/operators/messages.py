"""Session messages (RTSP, HTTP, SIP): parsing, headers, matching of responses to requests, order, sessions.

Header values that can't be read are null, and header_problems() names their headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaflow.functions.permissive import last_of_each, parameters, unread

REQUEST = r"^([A-Z_]+) (\S+) ([A-Za-z]+/\d\.\d)$"
RESPONSE = r"^([A-Za-z]+/\d\.\d) (\d{3}) ?(.*)$"


def parse(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with kind, method, uri, protocol, status, reason, headers (lower-case names; the last of a name stays), body."""
    text = F.regexp_replace(raw, "\r\n", "\n")
    d = df.withColumn("__head__", F.substring_index(text, "\n\n", 1)).withColumn("__body__", F.when(F.instr(text, "\n\n") > 0, F.substr(text, F.instr(text, "\n\n") + 2)).otherwise(""))
    first = F.substring_index("__head__", "\n", 1)
    # a line that starts with white space goes on with the header before it
    rest = F.regexp_replace(F.when(F.instr("__head__", "\n") > 0, F.substr("__head__", F.instr("__head__", "\n") + 1)).otherwise(""), "\n[ \t]+", " ")
    fields = F.filter(F.split(rest, "\n"), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(fields, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("v")))
    request, response = first.rlike(REQUEST), first.rlike(RESPONSE)
    return d.withColumns({
        "kind": F.when(request, "request").when(response, "response").otherwise("invalid"),
        "method": F.when(request, F.regexp_extract(first, REQUEST, 1)), "uri": F.when(request, F.regexp_extract(first, REQUEST, 2)),
        "protocol": F.when(request, F.regexp_extract(first, REQUEST, 3)).when(response, F.regexp_extract(first, RESPONSE, 1)),
        "status": F.when(response, F.regexp_extract(first, RESPONSE, 2).cast("int")), "reason": F.when(response, F.regexp_extract(first, RESPONSE, 3)),
        "headers": last_of_each(pairs), "body": F.col("__body__"),
    }).drop("__head__", "__body__")


def header(name: str) -> Column:
    return F.try_element_at("headers", F.lit(name))


def cseq(headers: Column | None = None) -> Column:
    return F.nullif(F.regexp_extract(header("cseq"), r"(\d+)", 1), F.lit("")).try_cast("int")


def session(value: Column) -> Column:
    """struct(id, timeout) of a Session header; 60 s where none is given."""
    return F.struct(F.nullif(F.trim(F.split_part(value, F.lit(";"), F.lit(1))), F.lit("")).alias("id"), F.coalesce(F.nullif(F.regexp_extract(value, r"timeout *= *(\d+)", 1), F.lit("")).try_cast("int"), F.lit(60)).alias("timeout"))


def timestamp_delay(value: Column) -> Column:
    """struct(at, delay) of a Timestamp header, in seconds; no delay is 0."""
    number = lambda i: F.nullif(F.regexp_extract(value, r"^ *([0-9.]+)(?: +([0-9.]+))?", i), F.lit("")).try_cast("double")
    return F.struct(number(1).alias("at"), F.coalesce(number(2), F.lit(0.0)).alias("delay"))


def transport(value: Column) -> Column:
    """The parts of a Transport header; one port or channel stands for both of a pair."""
    m = parameters(F.lower(value))
    get = lambda k: F.regexp_replace(F.try_element_at(m, F.lit(k)), '"', "")
    low = lambda k: F.nullif(F.regexp_extract(get(k), r"^(\d+)", 1), F.lit("")).try_cast("int")
    high = lambda k: F.coalesce(F.nullif(F.regexp_extract(get(k), r"-(\d+)", 1), F.lit("")).try_cast("int"), low(k))
    pair = lambda k, n: [low(k).alias(f"{n}_low"), high(k).alias(f"{n}_high")]
    ssrc = F.conv(F.nullif(F.regexp_extract(get("ssrc"), "^([0-9a-f]{1,8})$", 1), F.lit("")), 16, 10).cast("long")
    return F.struct(F.split_part(value, F.lit(";"), F.lit(1)).alias("profile"), F.map_contains_key(m, F.lit("multicast")).alias("multicast"), *pair("client_port", "client"), *pair("server_port", "server"), *pair("port", "port"), *pair("interleaved", "channel"), ssrc.alias("ssrc"), get("mode").alias("mode"), get("source").alias("source"), get("destination").alias("destination"), F.coalesce(low("ttl"), F.lit(127)).alias("ttl"))


def rtp_info(value: Column) -> Column:
    """The entries (url, seq, rtptime, ssrc) of an RTP-Info header."""
    number = lambda x, k: F.nullif(F.regexp_extract(x, rf"(?:^|;) *{k}=(\d+)", 1), F.lit("")).try_cast("long")
    ssrc = lambda x: F.conv(F.nullif(F.regexp_extract(x, r"(?:^|;) *ssrc=([0-9A-Fa-f]{1,8})(?![0-9A-Fa-f])", 1), F.lit("")), 16, 10).cast("long")
    return F.transform(F.split(value, ", *(?=url=)"), lambda x: F.struct(F.regexp_extract(x, r"url=([^;]*)", 1).alias("url"), number(x, "seq").alias("seq"), number(x, "rtptime").alias("rtptime"), ssrc(x).alias("ssrc")))


def header_problems(headers: str = "headers") -> Column:
    """The names of the headers of parsed messages that are there, but in which a number can't be read."""
    at = timestamp_delay(header("timestamp"))
    told = lambda name, pattern: F.nullif(F.regexp_extract(F.lower(header(name)), pattern, 1), F.lit(""))
    lost = lambda ok: F.when(ok, 1)  # noqa: E731  a value stands for a readable header
    moved = transport(header("transport"))
    read = {"client_port": "client_low", "server_port": "server_low", "port": "port_low", "interleaved": "channel_low", "ssrc": "ssrc"}
    fine = F.lit(True)
    for name, field in read.items():
        fine = fine & (told("transport", rf"(?:^|;) *{name}=([^;]*)").isNull() | moved[field].isNotNull())
    info = F.coalesce(F.forall(rtp_info(header("rtp-info")), lambda x: x["seq"].isNotNull() & x["rtptime"].isNotNull()), F.lit(True))
    timeout = told("session", r"timeout *= *([^;]*)")
    return unread(
        cseq=(header("cseq"), cseq()), session=(timeout, F.regexp_extract(timeout, r"^(\d+)", 1).try_cast("int")), timestamp=(header("timestamp"), lost(at["at"].isNotNull())),
        transport=(header("transport"), lost(fine)), **{"rtp-info": (header("rtp-info"), lost(info))},
    )


KEY = ("conn_id", "session_id", "cseq")


def match(parsed: DataFrame, keys=KEY) -> DataFrame:
    """Each request with its response (null where none came) and the round-trip time; repeated numbers: the earliest of each."""
    ask = parsed.where("kind = 'request'").groupBy(*keys).agg(F.min("ts_ms").alias("asked_ms"), F.min_by("method", "ts_ms").alias("method"))
    answer = parsed.where("kind = 'response'").groupBy(*keys).agg(F.min("ts_ms").alias("answered_ms"), F.min_by("status", "ts_ms").alias("status"))
    return ask.join(answer, list(keys), "left").withColumn("rtt_ms", F.col("answered_ms") - F.col("asked_ms"))


def unanswered(parsed: DataFrame, keys=KEY) -> DataFrame:
    return parsed.where("kind = 'request'").join(parsed.where("kind = 'response'").select(*keys).distinct(), list(keys), "left_anti")


def check(parsed: DataFrame, known: DataFrame, version: float = 1.0) -> DataFrame:
    """Requests with the status a server gives them: 400 without CSeq, with an empty Session or a body without its length; 454
    for a session that `known` (session_id) lacks; 505 for a later protocol version; else 200."""
    r = parsed.where("kind = 'request'")
    ids = known.select(F.col("session_id").alias("__known__")).distinct()
    own = session(header("session"))["id"]
    r = r.withColumn("__own__", own).join(ids, F.col("__own__") == F.col("__known__"), "left")
    bad = cseq().isNull() | (F.coalesce(header("session"), F.lit("x")) == "") | ((F.col("body") != "") & header("content-length").isNull())
    late = F.split_part("protocol", F.lit("/"), F.lit(2)).cast("double") > version
    code = F.when(bad, 400).when(F.col("__own__").isNotNull() & F.col("__known__").isNull(), 454).when(late, 505).otherwise(200)
    return r.withColumn("check", code).drop("__own__", "__known__")


def request_order(parsed: DataFrame, keys=("conn_id",)) -> DataFrame:
    """Requests with out_of_order: a number below the highest one before it."""
    w = Window.partitionBy(*keys).orderBy("ts_ms", "cseq").rowsBetween(Window.unboundedPreceding, -1)
    return parsed.where("kind = 'request'").withColumn("out_of_order", F.coalesce(F.col("cseq") < F.max("cseq").over(w), F.lit(False)))


def summary(parsed: DataFrame, now_ms, timeout_s: int = 60, keys=("conn_id",)) -> DataFrame:
    """Requests and responses of each session, last request, mean round trip, idle time, and whether it has expired."""
    counts = parsed.groupBy(*keys).agg(F.count(F.when(F.col("kind") == "request", 1)).alias("requests"), F.count(F.when(F.col("kind") == "response", 1)).alias("responses"), F.max("ts_ms").alias("last_ms"), F.max_by("method", F.when(F.col("kind") == "request", F.col("ts_ms"))).alias("last_method"))
    mean = match(parsed).groupBy(*keys).agg(F.avg("rtt_ms").alias("mean_rtt_ms"))
    idle = now_ms - F.col("last_ms")
    return counts.join(mean, list(keys), "left").withColumn("idle_ms", idle).withColumn("expired", idle >= timeout_s * 1000)


def sessions(parsed: DataFrame, keys=("conn_id",), ts: str = "ts_ms", timeout_s: str = "timeout") -> DataFrame:
    """Runs of messages without a pause of their timeout (seconds, by row); each ends when it has passed."""
    at = parsed.withColumn("__at__", F.timestamp_millis(ts))
    gap = F.concat(F.col(timeout_s).cast("string"), F.lit(" seconds"))
    rows = at.groupBy(*keys, F.session_window("__at__", gap)).agg(F.count(F.lit(1)).alias("messages"), F.min(ts).alias("first_ms"), F.max(ts).alias("last_ms"))
    return rows.select(*keys, "first_ms", "last_ms", "messages", F.unix_millis(F.col("session_window.end")).alias("expires_ms"))
