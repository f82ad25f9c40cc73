"""Capture files and streams of packets: binary and text forms in and out, interleaved connections, archives, time lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaflow.functions.bits import be, part
from mediaflow.functions.permissive import unread
from mediaflow.operators.rtcp import APP, BYE, RR, SDES, SR, description_items, goodbye, report_blocks
from mediaflow.operators.walkers import Interleaved, along_segments, capture_entries, interleaved, walk
from mediaflow.sources import ranges

ENTRY = "start_us long, source string, port int, offset_ms long, is_rtcp boolean, file_offset long, raw binary"


def read_capture(spark: SparkSession, path: str, range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """One row per entry of binary capture files: path and ENTRY's columns. Files are read in ranges of octets, by many tasks."""
    return ranges.read_ranges(spark, ranges.CaptureSource, path, range_bytes)


def read_capture_whole(spark: SparkSession, path: str) -> DataFrame:
    """The same by Spark's own file systems, for paths that only they open: a file is one task's, of 2 GB at most."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("file"))
    return walk(files, capture_entries, ENTRY, "file", ("path",))


def entry_bytes(form: str = "full") -> Column:
    """The bytes of an entry (columns offset_ms, is_rtcp, raw): full, header (12 octets, 4 of control) or payload."""
    head = F.when(F.col("is_rtcp"), 4).otherwise(12)
    body = {"full": F.col("raw"), "header": part("raw", 0, head), "payload": F.when(F.col("is_rtcp"), F.col("raw")).otherwise(part("raw", 12, F.octet_length("raw")))}[form]
    return F.concat(be(F.octet_length(body) + 8, 2), be(F.when(F.col("is_rtcp"), 0).otherwise(F.octet_length("raw")), 2), be(F.col("offset_ms"), 4), body)


def file_head() -> Column:
    """What a capture file starts with (columns start_us, source, port): a line of text, then 16 octets."""
    octets = F.transform(F.split("source", r"\."), lambda x: F.lpad(F.hex(x.cast("long")), 2, "0"))
    return F.concat(F.encode(F.concat(F.lit("#!rtpplay1.0 "), F.col("source"), F.lit("/"), F.col("port").cast("string"), F.lit("\n")), "UTF-8"), be(F.floor(F.col("start_us") / 1000000), 4), be(F.col("start_us") % 1000000, 4), F.unhex(F.array_join(octets, "")), be(F.col("port"), 2), be(0, 2))


def write_captures(df: DataFrame, folder: str, key: str = "stream_id", form: str = "full", order: tuple[str, ...] = ("offset_ms",), slice_ms: int | None = None) -> None:
    """Writes each stream (columns start_us, source, port and entry_bytes') as a binary capture file `key`.rtp in the folder, entries in
    order. slice_ms: a stream's time slices are files of their own (`key`-slice.rtp), so that a hot stream is many tasks'."""
    name = F.col(key).cast("string")
    if slice_ms:
        name = F.concat_ws("-", name, F.floor(F.col("offset_ms") / slice_ms).cast("string"))
    ranges.write_files(df, folder, ranges.CaptureSource, name, file_head(), entry_bytes(form), order, ".rtp")


def text_line() -> Column:
    """The text form of an RTP packet (columns arrival_ms, source, and the decoded header, payload)."""
    n = lambda c: F.col(c).cast("string")
    return F.concat_ws(" ", F.format_string("%d.%06d", F.floor(F.col("arrival_ms") / 1000), F.col("arrival_ms") % 1000 * 1000), F.lit("RTP"), F.concat(F.lit("len="), F.octet_length("raw").cast("string")), F.concat(F.lit("from="), F.col("source")), *(F.concat(F.lit(f"{k}="), n(c)) for k, c in (("v", "version"), ("p", "padding"), ("x", "extension"), ("cc", "cc"), ("m", "marker"), ("pt", "pt"), ("seq", "seq"), ("ts", "rtp_ts"))), F.concat(F.lit("ssrc=0x"), F.lower(F.hex("ssrc"))), F.concat(F.lit("data="), F.hex("payload")))


def parse_text(lines: DataFrame, column: str = "value", problems: str | None = None) -> DataFrame:
    """The packets of text lines; comment lines and others are left out. Fields that can't be read are null, and `problems` names them."""
    v = F.col(column)
    rows = lines.where(~v.startswith("#") & v.rlike(r"^\d+\.\d+ RTP "))
    field = lambda k, p=r"\d+": F.nullif(F.regexp_extract(v, rf"(?:^| ){k}=({p})", 1), F.lit(""))
    clock = F.regexp_extract(v, r"^(\d+)\.(\d+)", 1).try_cast("long") * 1000 + F.floor(F.rpad(F.regexp_extract(v, r"^(\d+)\.(\d+)", 2), 6, "0").try_cast("long") / 1000)
    numbers = {"length": ("len", "int"), "pt": ("pt", "int"), "seq": ("seq", "int"), "rtp_ts": ("ts", "long")}
    told = [unread(arrival_ms=(v, clock), **{n: (field(k, r"\S+"), field(k, r"\d+(?= |$)").try_cast(t)) for n, (k, t) in numbers.items()}).alias(problems)] if problems else []
    return rows.select(
        clock.alias("arrival_ms"), field("from", r"\S+").alias("source"), field("len").try_cast("int").alias("length"), *(field(k).try_cast("int").alias(c) for k, c in (("v", "version"), ("p", "padding"), ("x", "extension"), ("cc", "cc"), ("m", "marker"), ("pt", "pt"), ("seq", "seq"))),
        field("ts").try_cast("long").alias("rtp_ts"), F.conv(field("ssrc", "0x[0-9a-fA-F]+").substr(3, 8), 16, 10).cast("long").alias("ssrc"), F.unhex(F.coalesce(field("data", "[0-9a-fA-F]+"), F.lit(""))).alias("payload"), *told,
    )


def read_text_capture(spark: SparkSession, path: str) -> DataFrame:
    return parse_text(spark.read.text(path))


def short_line() -> Column:
    """`[-]time ts [seq]`: a leading minus is the marker."""
    return F.concat(F.when(F.col("marker") == 1, "-").otherwise(""), F.format_string("%d.%06d", F.floor(F.col("arrival_ms") / 1000), F.col("arrival_ms") % 1000 * 1000), F.lit(" "), F.col("rtp_ts").cast("string"), F.coalesce(F.concat(F.lit(" "), F.col("seq").cast("string")), F.lit("")))


def parse_short(lines: DataFrame, column: str = "value") -> DataFrame:
    p = r"^(-?)(\d+)\.(\d+) (\d+)(?: (\d+))?$"
    x = lambda i: F.regexp_extract(column, p, i)
    return lines.where(F.col(column).rlike(p)).select((x(1) == "-").cast("int").alias("marker"), (x(2).try_cast("long") * 1000 + F.floor(F.rpad(x(3), 6, "0").try_cast("long") / 1000)).alias("arrival_ms"), x(4).try_cast("long").alias("rtp_ts"), F.nullif(x(5), F.lit("")).try_cast("int").alias("seq"))


def report_text(report: str = "i", blocks: str = "b") -> Column:
    """The text form of a sender report (columns compound_id, ssrc, sender info struct, array of blocks)."""
    one = lambda b: F.format_string("(ssrc=%d fraction=%d lost=%d last_seq=%d jit=%d lsr=%d dlsr=%d)", b["source"], b["fraction"], b["lost"], b["highest"], b["jitter"], b["lsr"], b["dlsr"])
    i = F.col(report)
    return F.format_string("SR ssrc=%d p=%d count=%d ntp=%d.%d ts=%d psent=%d osent=%d %s", F.col("ssrc"), F.col("padding"), F.col("bc"), i["ntp_msw"], i["ntp_lsw"], i["rtp_ts"], i["packets"], i["octets"], F.array_join(F.transform(blocks, one), " "))


#: What the items of a description are called.
ITEM_NAMES = ("End", "CName", "Name", "Email", "Phone", "Location", "Tool", "Note", "Private")


def _hex2(c: Column) -> Column:
    return F.concat(F.lit("0x"), F.when(F.length(F.hex(c)) < 2, F.concat(F.lit("0"), F.hex(c))).otherwise(F.hex(c)))


def description_texts(parts: DataFrame, keep: tuple[str, ...], raw: str = "raw") -> DataFrame:
    """keep, items_text: the chunks of each source description, a line for each, with their items as name="text"."""
    names = F.array(*(F.lit(n) for n in ITEM_NAMES))
    walked = description_items(parts, keep, raw).withColumn("order", F.monotonically_increasing_id())
    item = F.concat(F.coalesce(F.get(names, F.col("item_type")), F.lit("Unknown")), F.lit('="'), F.col("text"), F.lit('"'))
    chunks = walked.groupBy(*keep, "chunk", "source").agg(F.array_sort(F.collect_list(F.struct("order", item.alias("i")))).alias("x"))
    lines = chunks.select(*keep, "chunk", F.concat(F.lit("\nsrc="), _hex2(F.col("source")), F.lit(" "), F.array_join(F.transform("x", lambda x: x["i"]), " ")).alias("line"))
    return lines.groupBy(*keep).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "line"))), lambda x: x["line"]), "").alias("items_text"))


def control_text(parts: DataFrame, keep: tuple[str, ...], raw: str = "raw") -> DataFrame:
    """keep, line: the expression form of control packets other than sender reports, `(RR ssrc=0x.. p=0 count=1 len=7\\n…)`: the
    blocks of receiver reports, chunks of descriptions, reason and sources of goodbyes; application and other packets have no
    body, and the others are named by their type in hexadecimal."""
    block = lambda b: F.concat(F.lit(" (ssrc="), _hex2(b["source"]), F.format_string(" fraction=%d lost=%d last_seq=%d\n jit=%d lsr=%d dlsr=%d)\n", b["fraction"], b["lost"], b["highest"], b["jitter"], b["lsr"], b["dlsr"]))
    bye = goodbye(raw)
    left = F.concat(F.coalesce(F.concat(F.lit('reason="'), bye["reason"], F.lit('"')), F.lit("")), F.array_join(F.transform(bye["sources"], lambda x: F.concat(F.lit("ssrc=0x"), F.hex(x), F.lit("\n"))), ""))
    pt = F.col("rtcp_pt")
    name = F.when(pt == RR, "RR").when(pt == SDES, "SDES").when(pt == BYE, "BYE").when(pt == APP, "APP").otherwise(F.hex(pt))
    body = F.when(pt == RR, F.coalesce(F.array_join(F.transform(report_blocks(raw), block), ""), F.lit(""))).when(pt == SDES, F.coalesce("items_text", F.lit(""))).when(pt == BYE, left).otherwise("")
    rows = parts.where(pt != SR).join(description_texts(parts, keep, raw), list(keep), "left")
    return rows.select(*keep, F.concat(F.lit("("), name, F.lit(" ssrc="), _hex2(F.col("ssrc")), F.format_string(" p=%d count=%d len=%d\n", F.col("padding"), F.col("bc"), F.col("words")), body, F.lit(")")).alias("line"))


def split_interleaved(df: DataFrame, keep: tuple[str, ...], raw: str = "raw", order: tuple[str, ...] | None = None) -> DataFrame:
    """keep, idx, channel (-1: text between frames), at, part of each connection's bytes. order: a connection (keep) is many rows, its
    segments in this order, cut anywhere; without it, each row is a whole connection."""
    schema = "idx int, channel int, at long, part binary"
    return along_segments(df, Interleaved, schema, raw, keep, order) if order else walk(df, interleaved, schema, raw, keep)


def archive(packets: DataFrame, folder: str, key: str = "stream_id", most_rows: int = 5_000_000, spread: int = 16) -> None:
    """Packets under one directory per stream, in files of bounded size. A stream's rows are dealt by their content to `spread` tasks
    at most, so that a hot stream isn't one task's."""
    salt = F.pmod(F.xxhash64(*[c for c in packets.columns if c != key]), F.lit(spread))
    packets.repartition(F.col(key), salt).write.option("maxRecordsPerFile", most_rows).partitionBy(key).mode("append").parquet(folder)


def merge(*captures: DataFrame) -> DataFrame:
    """Several captures (start_ms, offset_ms, …) on one time line: at_ms, in order."""
    out = captures[0]
    for c in captures[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out.withColumn("at_ms", F.col("start_ms") + F.col("offset_ms")).orderBy("at_ms")


def seek(df: DataFrame, at_ms: int, key: str = "stream_id", order: tuple[str, ...] = ("offset_ms",)) -> DataFrame:
    """The first entry of each stream whose offset reaches at_ms."""
    return df.where(F.col("offset_ms") >= at_ms).groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), F.struct(*order)).alias("r")).select(key, "r.*")


def skip(df: DataFrame, n: int, key: str = "stream_id", order: tuple[str, ...] = ("offset_ms",)) -> DataFrame:
    """Each stream without its first n entries."""
    return df.withColumn("__n__", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n__") > n).drop("__n__")


_KINDS = {"stream_id": T.StringType(), "arrival": T.TimestampType(), **dict.fromkeys(("seq", "marker", "pt", "copy"), T.IntegerType())}
#: The schema of packets as a live source delivers them.
PACKETS = T.StructType([T.StructField(c, _KINDS.get(c, T.LongType())) for c in ("stream_id", "ssrc", "seq", "rtp_ts", "marker", "pt", "arrival", "event_id", "copy", "payload_len")])
