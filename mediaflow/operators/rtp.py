"""RTP packets: header, contributing sources, extension, payload bounds, completeness, rewriting, validity.

All of it is column arithmetic on one binary column, so it stays in one generated stage with the scan. Fields of packets that
are too short for them are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaflow.functions.bits import be, bits, part, u8, u16, u32

HEADER = 12

#: Static payload types (RFC 3551) with encoding, clock rate, channels.
STATIC_TYPES = [
    (0, "PCMU", 8000, 1), (3, "GSM", 8000, 1), (4, "G723", 8000, 1), (5, "DVI4", 8000, 1), (6, "DVI4", 16000, 1), (7, "LPC", 8000, 1), (8, "PCMA", 8000, 1),
    (9, "G722", 8000, 1), (10, "L16", 44100, 2), (11, "L16", 44100, 1), (12, "QCELP", 8000, 1), (13, "CN", 8000, 1), (14, "MPA", 90000, 1), (15, "G728", 8000, 1),
    (16, "DVI4", 11025, 1), (17, "DVI4", 22050, 1), (18, "G729", 8000, 1), (25, "CelB", 90000, 0), (26, "JPEG", 90000, 0), (28, "nv", 90000, 0),
    (31, "H261", 90000, 0), (32, "MPV", 90000, 0), (33, "MP2T", 90000, 0), (34, "H263", 90000, 0),
]


def decode_header(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with version, padding, extension, cc, marker, pt, seq, rtp_ts, ssrc."""
    one, two = u8(raw, 0), u8(raw, 1)
    return df.withColumns({
        "version": bits(one, 6, 2).cast("int"), "padding": bits(one, 5, 1).cast("int"), "extension": bits(one, 4, 1).cast("int"), "cc": bits(one, 0, 4).cast("int"),
        "marker": bits(two, 7, 1).cast("int"), "pt": bits(two, 0, 7).cast("int"), "seq": u16(raw, 2).cast("int"), "rtp_ts": u32(raw, 4), "ssrc": u32(raw, 8),
    })


def csrcs(raw: str = "raw", cc: str = "cc") -> Column:
    """The contributing sources that the bytes hold: at most cc, fewer if they end earlier."""
    held = F.least(F.col(cc), F.floor((F.octet_length(raw) - HEADER) / 4).cast("int"))
    return F.when(held > 0, F.transform(F.sequence(F.lit(0), held - 1), lambda i: u32(raw, i * 4 + HEADER))).otherwise(F.array().cast("array<bigint>"))


def _past_csrcs(cc: str = "cc") -> Column:
    return F.col(cc) * 4 + HEADER


def extension(raw: str = "raw") -> Column:
    """struct(profile, words, size, data) of a packet whose X bit is set; null without one or where its head is cut off."""
    start = _past_csrcs()
    size = F.least(4 + 4 * u16(raw, start + 2), (F.octet_length(raw) - start).cast("long"))
    return F.when((F.col("extension") == 1) & (F.octet_length(raw) >= start + 4), F.struct(u16(raw, start).cast("int").alias("profile"), u16(raw, start + 2).cast("int").alias("words"), size.cast("int").alias("size"), part(raw, start + 4, size - 4).alias("data")))


def padding_octets(raw: str = "raw") -> Column:
    return F.when(F.col("padding") == 1, u8(raw, F.octet_length(raw) - 1)).otherwise(0).cast("int")


def header_octets(raw: str = "raw") -> Column:
    """Octets before the payload: fixed header, CSRCs, extension."""
    return F.least(F.octet_length(raw), _past_csrcs() + F.coalesce(extension(raw)["size"], F.lit(0)))


def payload(raw: str = "raw") -> Column:
    """The payload without CSRCs, extension and padding; empty where nothing is left."""
    start = header_octets(raw)
    return part(raw, start, F.greatest(F.lit(0), F.octet_length(raw) - start - padding_octets(raw)))


def is_complete(raw: str = "raw") -> Column:
    """All that the header announces is there: header, CSRCs, extension, and padding that fits."""
    n = F.octet_length(raw)
    start = _past_csrcs()
    with_extension = F.when(F.col("extension") == 1, F.coalesce(n >= start + 4 + 4 * u16(raw, start + 2), F.lit(False))).otherwise(True)
    end = start + F.when(F.col("extension") == 1, F.coalesce(4 + 4 * u16(raw, start + 2), F.lit(0))).otherwise(0)
    return (n >= HEADER) & (n >= start) & with_extension & F.when(F.col("padding") == 1, (padding_octets(raw) > 0) & (n - end >= padding_octets(raw))).otherwise(True)


def rewrite(raw: str = "raw", **fields: Column) -> Column:
    """raw with some of pt, marker, seq, rtp_ts, ssrc replaced; the rest is kept."""
    two = u8(raw, 1)
    marker = fields.get("marker", bits(two, 7, 1))
    pt = fields.get("pt", bits(two, 0, 7))
    return F.concat(part(raw, 0, 1), be(marker * 128 + pt, 1), *(be(fields[n], k) if n in fields else part(raw, at, k) for n, at, k in (("seq", 2, 2), ("rtp_ts", 4, 4), ("ssrc", 8, 4))), part(raw, HEADER, F.octet_length(raw)))


def payload_types(spark) -> DataFrame:
    """(pt, encoding, clock_rate, channels) for 0-127; clock rate and channels are null where no standard fixes them."""
    known = spark.createDataFrame(STATIC_TYPES, "pt int, encoding string, clock_rate int, channels int")
    every = spark.range(128).select(F.col("id").cast("int").alias("pt"))
    kind = F.when(F.col("pt") >= 96, "Dynamic").when(F.col("pt").between(72, 76), "Conflict avoidance").when(F.col("pt").between(35, 95), "Unassigned").otherwise("Reserved")
    return every.join(known, "pt", "left").withColumn("encoding", F.coalesce("encoding", kind))


def describe(df: DataFrame) -> DataFrame:
    """df with encoding, clock_rate and channels of its pt (128 rows are broadcast)."""
    return df.join(F.broadcast(payload_types(df.sparkSession)), "pt", "left")


def failure(pts: str | None = None, raw: str = "raw") -> Column:
    """Why a packet isn't valid: version, payload type, padding, csrc, extension; null for valid ones. Comfort noise (13) and
    headers of compressed form (version 0 and payload type 13) aren't looked at."""
    rest = F.octet_length(raw) - HEADER
    known = F.array_contains(pts, F.col("pt")) if pts else F.lit(True)
    ext = F.coalesce(extension(raw)["size"], F.lit(4))
    announced = F.when(F.octet_length(raw) >= _past_csrcs() + 4, 4 + 4 * u16(raw, _past_csrcs() + 2)).otherwise(ext)
    return (
        F.when(F.col("pt") == 13, None)
        .when(F.coalesce(F.col("version"), F.lit(-1)) != 2, "version")
        .when(F.col("pt").isin(72, 73) | ~known, "payload type")
        .when((F.col("padding") == 1) & (rest > 0) & (padding_octets(raw) >= rest), "padding")
        .when((F.col("cc") > 0) & (rest < F.col("cc") * 4), "csrc")
        .when((F.col("extension") == 1) & ((padding_octets(raw) >= rest) | (announced > rest - padding_octets(raw))), "extension")
    )
