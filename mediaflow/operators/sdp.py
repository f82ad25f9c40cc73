"""Session descriptions: text to sessions, media sections and attributes, by array functions within one row (no shuffle).

Malformed values are null; where a `problems` column is asked for, it names the fields whose text gave no value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaflow.functions.permissive import parameters, unread


def lines(text) -> Column:
    """The lines `x=value`, without line ends."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.rtrim(F.regexp_replace(x, "\r$", ""))), lambda x: x.rlike("^[a-z]="))


def value(of: Column, kind: str) -> Column:
    """The value of the first line of a kind, or null."""
    return F.substr(F.get(F.filter(of, lambda x: F.startswith(x, F.lit(kind + "="))), F.lit(0)), F.lit(3))


def _field(text: Column, i: int) -> Column:
    """Field i (from 0) between spaces."""
    return F.get(F.split(text, " "), F.lit(i))


def session_lines(df: DataFrame, text: str = "sdp") -> DataFrame:
    """df with all lines, those before the first media line, and the media sections (arrays of lines)."""
    # held by generators, so that no later expression reads and splits the text again
    held = df.withColumn("lines", F.explode(F.array(lines(F.col(text)))))
    opened = held.withColumn("starts", F.explode(F.array(F.filter(F.transform("lines", lambda x, i: F.when(F.startswith(x, F.lit("m=")), i + 1)), lambda x: x.isNotNull()))))
    n = F.size("lines")
    head = F.slice("lines", F.lit(1), F.coalesce(F.get("starts", F.lit(0)) - 1, n))
    ends = F.concat(F.slice("starts", F.lit(2), F.greatest(F.size("starts") - 1, F.lit(0))), F.array(n + 1))
    sections = F.when(F.size("starts") > 0, F.transform(F.arrays_zip(F.col("starts").alias("a"), ends.alias("b")), lambda z: F.slice("lines", z["a"], z["b"] - z["a"]))).otherwise(F.array().cast("array<array<string>>"))
    return opened.withColumn("head", F.explode(F.array(head))).withColumn("sections", sections)


def _with(problems: str | None, **fields: tuple[Column, Column]) -> list[Column]:
    return [unread(**fields).alias(problems)] if problems else []


def sessions(df: DataFrame, key: str = "session_key", text: str = "sdp", problems: str | None = None) -> DataFrame:
    """key and the session's own lines; descriptions of fewer than three lines are left out."""
    return _sessions(session_lines(df, text), key, problems)


def _sessions(opened: DataFrame, key: str, problems: str | None = None, more: tuple[str, ...] = (), read: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """sessions() of session_lines(), with more columns that `read` adds."""
    d = read(opened.where(F.size("lines") >= 3).withColumn("n_media", F.size("sections")))
    h = F.col("head")
    o, t = value(h, "o"), value(h, "t")
    fields = {"version": (value(h, "v"), value(h, "v").try_cast("int")), **{n: (_field(o, i), _field(o, i).try_cast("long")) for n, i in (("origin_id", 1), ("origin_version", 2))}, **{n: (_field(t, i), _field(t, i).try_cast("long")) for n, i in (("start", 0), ("stop", 1))}}
    one = lambda name: fields[name][1].alias(name)
    return d.select(
        key, one("version"), _field(o, 0).alias("user"), one("origin_id"), one("origin_version"), _field(o, 3).alias("net"), _field(o, 4).alias("address_type"), _field(o, 5).alias("address"),
        value(h, "s").alias("name"), value(h, "c").alias("connection"), one("start"), one("stop"), "n_media", *more, *_with(problems, **fields),
    )


def media(df: DataFrame, key: str = "session_key", text: str = "sdp", problems: str | None = None) -> DataFrame:
    """key, media_idx, media, port, n_ports, proto, pts, connection (the media's own or the session's), its lines."""
    # a section starts with its media line; its fields are split once, inside the generator
    opened = lambda x: F.struct(x.alias("of"), F.split(F.substr(F.get(x, F.lit(0)), F.lit(3)), " ").alias("m"), value(x, "c").alias("own"))
    d = session_lines(df, text).select(key, value(F.col("head"), "c").alias("c"), value(F.col("head"), "t").alias("t"), F.filter("head", lambda x: F.startswith(x, F.lit("a="))).alias("head_attributes"), F.posexplode(F.transform("sections", opened)).alias("media_idx", "x"))
    d = d.select("*", F.col("x.of").alias("of"), F.col("x.m").alias("m"), F.col("x.own").alias("own"))
    port = F.split_part(F.get("m", F.lit(1)), F.lit("/"), F.lit(1))
    ports = F.nullif(F.split_part(F.get("m", F.lit(1)), F.lit("/"), F.lit(2)), F.lit(""))
    pts = F.transform(F.filter(F.slice("m", F.lit(4), F.size("m")), lambda x: x.rlike("^[0-9]{1,9}$")), lambda x: x.cast("int"))
    return d.select(key, "media_idx", F.get("m", F.lit(0)).alias("media"), port.try_cast("int").alias("port"), F.coalesce(ports.try_cast("int"), F.lit(1)).alias("n_ports"), F.get("m", F.lit(2)).alias("proto"), pts.alias("pts"), F.coalesce("own", "c").alias("connection"), F.col("t").alias("times"), F.col("of").alias("lines"), "head_attributes", *_with(problems, port=(port, port.try_cast("int")), n_ports=(ports, ports.try_cast("int"))))


def attributes(media_rows: DataFrame, key: str = "session_key", problems: str | None = None) -> DataFrame:
    """key, media_idx, name, value (null for flags), and the parts of rtpmap and fmtp values."""
    a = media_rows.select(key, "media_idx", F.posexplode(F.filter("lines", lambda x: F.startswith(x, F.lit("a=")))).alias("idx", "a")).withColumn("a", F.substr("a", F.lit(3)))
    name = F.substring_index("a", ":", 1)
    val = F.when(F.instr("a", ":") > 0, F.substr("a", F.instr("a", ":") + 1))
    rows = a.select(key, "media_idx", "idx", name.alias("name"), val.alias("value"))
    # a column of its own, so that it is read once for all that use it
    rest = F.when(F.col("name").isin("rtpmap", "fmtp"), F.regexp_extract("value", r"^\d+ (.*)$", 1))
    read = rows.withColumn("__rest__", rest)
    pt_text = F.when(F.col("name").isin("rtpmap", "fmtp"), F.substring_index("value", " ", 1))
    pt = F.when(F.col("name").isin("rtpmap", "fmtp"), F.regexp_extract("value", r"^(\d+)", 1).try_cast("int"))
    params = F.when(F.col("name") == "fmtp", parameters(F.regexp_replace("__rest__", "; *", ";")))
    piece = lambda i: F.when(F.col("name") == "rtpmap", F.nullif(F.split_part("__rest__", F.lit("/"), F.lit(i)), F.lit("")))
    columns = {"pt": pt, "encoding": piece(1), "clock_rate": piece(2).try_cast("int"), "encoding_params": piece(3), "params": params}
    if problems:
        columns[problems] = unread(pt=(pt_text, pt), clock_rate=(piece(2), piece(2).try_cast("int")))
    return read.withColumns(columns).drop("__rest__")


def session_attributes(df: DataFrame, key: str = "session_key", text: str = "sdp") -> DataFrame:
    """key, idx, name, value (null for flags) of the attributes before the first media section."""
    a = session_lines(df, text).select(key, F.posexplode(F.filter("head", lambda x: F.startswith(x, F.lit("a=")))).alias("idx", "a")).withColumn("a", F.substr("a", F.lit(3)))
    return a.select(key, "idx", F.substring_index("a", ":", 1).alias("name"), F.when(F.instr("a", ":") > 0, F.substr("a", F.instr("a", ":") + 1)).alias("value"))


#: The names of the directions.
DIRECTIONS = ("sendrecv", "sendonly", "recvonly", "inactive")


def attribute_fields(rows: DataFrame) -> DataFrame:
    """Rows with name and value (of attributes() or session_attributes()), with the fields of source attributes (ssrc, its
    attribute and that one's value), of the control port (and its host, if named), packet times in ms, frame rate, and direction.
    A field is null where the attribute is another one or its value doesn't have the form."""
    of = lambda name, x: F.when(F.col("name") == name, x)
    part = lambda pattern, i: F.nullif(F.regexp_extract("value", pattern, i), F.lit(""))
    source, control = r"^(\d+) ([^:]+)(?::(.*))?$", r"^(\d+)(?: IN IP[46] (\S+))?$"
    number = lambda x: x.try_cast("double")
    return rows.withColumns({
        "ssrc": of("ssrc", part(source, 1).try_cast("long")), "source_attribute": of("ssrc", part(source, 2)), "source_value": of("ssrc", part(source, 3)),
        "rtcp_port": of("rtcp", part(control, 1).try_cast("int")), "rtcp_host": of("rtcp", part(control, 2)),
        "packet_ms": of("ptime", number(F.col("value"))), "most_packet_ms": of("maxptime", number(F.col("value"))), "frame_rate": of("framerate", number(F.col("value"))),
        "direction": F.when(F.col("name").isin(*DIRECTIONS) & F.col("value").isNull(), F.col("name")),
    })


CANDIDATE = r"^(\S+) (\d+) (\S+) (\d+) (\S+) (\d+) typ (\S+)(?: raddr (\S+))?(?: rport (\d+))?"


def negotiation_fields(rows: DataFrame) -> DataFrame:
    """Rows with name and value, with the fields of feedback attributes (rtcp-fb: the payload type, null for all of them, what is sent
    and its parameter) and of connectivity ones (candidate: foundation, component, transport, priority, address, port, kind, and what
    it relates to; ice-ufrag and ice-pwd). A field is null where the attribute is another one or its value doesn't have the form."""
    of = lambda name, x: F.when(F.col("name") == name, x)
    part = lambda pattern, i: F.nullif(F.regexp_extract("value", pattern, i), F.lit(""))
    feedback = r"^(\d+|\*) (\S+)(?: (.*))?$"
    own = lambda i, kind="string": of("candidate", part(CANDIDATE, i).try_cast(kind))
    return rows.withColumns({
        "feedback_pt": of("rtcp-fb", part(feedback, 1).try_cast("int")), "feedback": of("rtcp-fb", part(feedback, 2)), "feedback_parameter": of("rtcp-fb", part(feedback, 3)),
        "foundation": own(1), "component": own(2, "int"), "transport": own(3), "priority": own(4, "long"), "candidate_address": own(5), "candidate_port": own(6, "int"), "candidate_kind": own(7), "related_address": own(8), "related_port": own(9, "int"),
        "ice_user": of("ice-ufrag", F.col("value")), "ice_password": of("ice-pwd", F.col("value")),
    })


def changed(session_rows: DataFrame, which: Column, by: int = 1) -> DataFrame:
    """session_rows in which the version of those that `which` holds for has gone up, as it must when a description changes."""
    return session_rows.withColumn("origin_version", F.when(which, F.col("origin_version") + by).otherwise(F.col("origin_version")))


#: Lines end with it in what is written.
END = "\r\n"


def _line(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts), F.lit(END))


def _attribute(name: Column, value_: Column) -> Column:
    return _line("a=", name, F.coalesce(F.concat(F.lit(":"), value_), F.lit("")))


def whole(df: DataFrame, key: str = "session_key", text: str = "sdp") -> DataFrame:
    """What sessions(), media() and attributes() read, a row for each description: sessions()' columns, the session's own attributes
    (an array of name and value) and its sections (an array of media()'s fields, bandwidth texts and attributes). Nothing is shuffled."""
    of_kind = lambda x, kind: F.transform(F.filter(x, lambda y: F.startswith(y, F.lit(kind))), lambda y: F.substr(y, F.lit(3)))
    split = lambda x: F.transform(of_kind(x, "a="), lambda y: F.struct(F.substring_index(y, ":", 1).alias("name"), F.when(F.instr(y, ":") > 0, F.substr(y, F.instr(y, ":") + 1)).alias("value")))
    opened = lambda x: F.struct(x.alias("of"), F.split(F.substr(F.get(x, F.lit(0)), F.lit(3)), " ").alias("m"))

    def section(x: Column) -> Column:
        m, of = x["m"], x["of"]
        port = lambda i: F.nullif(F.split_part(F.get(m, F.lit(1)), F.lit("/"), F.lit(i)), F.lit("")).try_cast("int")
        pts = F.transform(F.filter(F.slice(m, F.lit(4), F.size(m)), lambda y: y.rlike("^[0-9]{1,9}$")), lambda y: y.cast("int"))
        return F.struct(F.get(m, F.lit(0)).alias("media"), port(1).alias("port"), F.coalesce(port(2), F.lit(1)).alias("n_ports"), F.get(m, F.lit(2)).alias("proto"), pts.alias("pts"), F.coalesce(value(of, "c"), value(F.col("head"), "c")).alias("connection"), of_kind(of, "b=").alias("bandwidth"), split(of).alias("attributes"))

    def read(d: DataFrame) -> DataFrame:
        return d.withColumns({"attributes": split(F.col("head")), "sections": F.transform(F.transform("sections", opened), section)})

    return _sessions(session_lines(df, text), key, more=("attributes", "sections"), read=read)


def texts(rows: DataFrame, key: str = "session_key") -> DataFrame:
    """key, sdp: the descriptions of rows as whole() gives them, lines ended by \\r\\n. Media sections hold their own lines alone: a
    connection that isn't the session's, bandwidth and attributes, in their order."""
    text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    optional = lambda mark, c: F.coalesce(_line(mark, F.col(c)), F.lit(""))
    of_attributes = lambda x: F.coalesce(F.array_join(F.transform(x, lambda y: _attribute(y["name"], y["value"])), ""), F.lit(""))

    def section(x: Column) -> Column:
        ports = F.concat(text(x["port"]), F.when(x["n_ports"] > 1, F.concat(F.lit("/"), text(x["n_ports"]))).otherwise(""))
        head = _line("m=", x["media"], " ", ports, " ", x["proto"], " ", F.array_join(F.transform(x["pts"], lambda y: y.cast("string")), " "))
        place = F.when(x["connection"].isNotNull() & ~x["connection"].eqNullSafe(F.col("connection")), _line("c=", x["connection"])).otherwise("")
        more = F.array_join(F.transform(x["bandwidth"], lambda y: _line("b=", y)), "")
        return F.concat(head, place, F.coalesce(more, F.lit("")), of_attributes(x["attributes"]))

    top = F.concat(_line("v=", text("version")), _line("o=", F.concat_ws(" ", "user", text("origin_id"), text("origin_version"), "net", "address_type", "address")), _line("s=", F.coalesce("name", F.lit(" "))), optional("c=", "connection"), _line("t=", text("start"), " ", text("stop")))
    body = F.array_join(F.transform("sections", section), "")
    return rows.select(key, F.concat(top, of_attributes(F.col("attributes")), F.coalesce(body, F.lit(""))).alias("sdp"))


def write(session_rows: DataFrame, media_rows: DataFrame, attribute_rows: DataFrame, key: str = "session_key") -> DataFrame:
    """key, sdp: the descriptions of rows as sessions(), media() and attributes() give them, as texts() writes them. Media sections are in
    the order of media_idx; `bandwidth` is an array of texts such as `AS:64`, if there is such a column; attributes (rows of a null
    media_idx are the session's) are in the order of idx."""
    values = lambda *c: F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x["of"])
    attributes_ = attribute_rows.select(key, "media_idx", "idx", F.struct("name", "value").alias("of"))
    of_media = attributes_.where("media_idx IS NOT NULL").groupBy(key, "media_idx").agg(values("idx", "of").alias("attributes"))
    of_session = attributes_.where("media_idx IS NULL").groupBy(key).agg(values("idx", "of").alias("attributes"))
    bandwidth_ = F.col("bandwidth") if "bandwidth" in media_rows.columns else F.lit(None).cast("array<string>").alias("bandwidth")
    own = media_rows.select(key, "media_idx", "media", "port", "n_ports", "proto", "pts", "connection", bandwidth_)
    each = own.join(of_media, [key, "media_idx"], "left").select(key, "media_idx", F.struct("media", "port", "n_ports", "proto", "pts", "connection", "bandwidth", "attributes").alias("of"))
    sections = each.groupBy(key).agg(values("media_idx", "of").alias("sections"))
    return texts(session_rows.join(of_session, key, "left").join(sections, key, "left"), key)


def directions(media_rows: DataFrame, key: str = "session_key") -> DataFrame:
    """key, media_idx, direction: the section's last own one, else the session's, else both ways."""
    last = lambda of: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.transform(of, lambda x: F.substr(x, F.lit(3))), lambda x: x.isin(*DIRECTIONS))), -1)
    own = F.filter("lines", lambda x: F.startswith(x, F.lit("a=")))
    return media_rows.select(key, "media_idx", F.coalesce(last(own), last(F.col("head_attributes")), F.lit("sendrecv")).alias("direction"))


def connection(c: Column) -> Column:
    """struct(net, address_type, host, ttl, addresses) of `IN IP4 host/ttl/n`."""
    at = _field(c, 2)
    number = lambda i: F.nullif(F.split_part(at, F.lit("/"), F.lit(i)), F.lit("")).try_cast("int")
    return F.struct(_field(c, 0).alias("net"), _field(c, 1).alias("address_type"), F.split_part(at, F.lit("/"), F.lit(1)).alias("host"), number(2).alias("ttl"), F.coalesce(number(3), F.lit(1)).alias("addresses"))


def control_uri(base: Column, control: Column) -> Column:
    """An absolute control stands for itself, `*` and none for the base; others are joined to it."""
    return F.when(control.isNull() | (control == "*"), base).when(control.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), control).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(control, "^/+", "")))


def _seconds(x: Column) -> Column:
    """Seconds of `1.5`, `mm:ss` or `hh:mm:ss.f`; null for anything else."""
    clock = r"^(?:(\d+):)?(\d+):(\d+(?:\.\d+)?)$"
    part = lambda i: F.regexp_extract(x, clock, i)
    return F.when(x.rlike(r"^\d+(\.\d+)?$"), x.cast("double")).when(x.rlike(clock), F.coalesce(F.nullif(part(1), F.lit("")).cast("double"), F.lit(0.0)) * 3600 + part(2).cast("double") * 60 + part(3).cast("double"))


def media_range(text: Column) -> Column:
    """struct(type, start, end, start_text, end_text) of a range; start and end are seconds for npt and smpte (frames as text
    alone) and since 1970 for clock; an open end and `now` are null."""
    kind = F.regexp_extract(text, r"^([A-Za-z0-9-]+)=", 1)
    rest = F.regexp_extract(text, r"=([^;]*)", 1)
    a = F.when(kind == "clock", F.regexp_extract(rest, r"^([0-9TZ.]+)-", 1)).otherwise(F.split_part(rest, F.lit("-"), F.lit(1)))
    b = F.when(kind == "clock", F.regexp_extract(rest, r"-([0-9TZ.]+)$", 1)).otherwise(F.split_part(rest, F.lit("-"), F.lit(2)))

    def point(x: Column) -> Column:
        smpte = F.concat_ws(":", F.slice(F.split(x, ":"), F.lit(1), F.lit(3)))
        clock = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(x, "(\\.\\d+)?Z$", ""), F.lit("yyyyMMdd'T'HHmmss"))).cast("double")
        return F.when(kind == "npt", _seconds(x)).when(F.startswith(kind, F.lit("smpte")), _seconds(smpte)).when(kind == "clock", clock)

    return F.struct(kind.alias("type"), point(a).alias("start"), point(b).alias("end"), a.alias("start_text"), F.nullif(b, F.lit("")).alias("end_text"))


def duration(text: Column) -> Column:
    """Seconds of `7d 1h -30m 10s` summed; a bare number counts seconds."""
    one = lambda x: F.regexp_extract(x, r"^(-?\d+)", 1).try_cast("long") * F.when(x.rlike("d$"), 86400).when(x.rlike("h$"), 3600).when(x.rlike("m$"), 60).otherwise(1)
    return F.aggregate(F.filter(F.split(F.trim(text), " +"), lambda x: x.rlike(r"^-?\d{1,12}[dhms]?$")), F.lit(0).cast("long"), lambda s, x: s + one(x))


def zone_adjustments(text: Column) -> Column:
    """The numbers of a zone line: times as they are, offsets in seconds."""
    return F.transform(F.split(F.trim(text), " +"), lambda x: duration(x))


def repeat_times(text: Column) -> Column:
    """struct(interval, length, offsets) of a repeat line, in seconds."""
    all_ = zone_adjustments(text)
    return F.struct(F.get(all_, F.lit(0)).alias("interval"), F.get(all_, F.lit(1)).alias("length"), F.slice(all_, F.lit(3), F.size(all_)).alias("offsets"))


def bandwidth(media_rows: DataFrame, key: str = "session_key") -> DataFrame:
    """key, media_idx and the bandwidth directives RR, RS, AS, TIAS."""
    b = media_rows.select(key, "media_idx", F.explode(F.filter("lines", lambda x: F.startswith(x, F.lit("b=")))).alias("b"))
    pair = b.select(key, "media_idx", F.regexp_extract("b", "^b=([^:]+):", 1).alias("token"), F.regexp_extract("b", r":(\d+)", 1).try_cast("long").alias("n"))
    return pair.groupBy(key, "media_idx").pivot("token", ["RR", "RS", "AS", "TIAS"]).agg(F.max("n"))


def playable(start: Column, stop: Column, at: Column) -> Column:
    """Whether a session plays at a time; 0 is open, both 0 permanent."""
    return ((start == 0) | (start <= at)) & ((stop == 0) | (at <= stop))
