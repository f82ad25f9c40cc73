"""RTCP: datagrams into packets, their headers and bodies by type, validity, and times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaflow.functions.bits import bits, part, s24, u8, u16, u32
from mediaflow.operators.walkers import rtcp_parts, sdes_items, walk_together

#: Packet types, and the mask for a first packet that opens a valid compound.
SR, RR, SDES, BYE, APP, TRANSPORT_FEEDBACK, PAYLOAD_FEEDBACK = 200, 201, 202, 203, 204, 205, 206
VALID_MASK = 0xC000 | 0x2000 | 0xFE
#: Seconds between 1900 and 1970, and from 2036 (where the first bit is clear) back to 1970.
ERA_1900, ERA_2036 = 2208988800, -2085978496


def split(df: DataFrame, keep: tuple[str, ...], raw: str = "raw", types: list[int] | None = None) -> DataFrame:
    """keep, idx, raw: one row per packet of each datagram; types: only these."""
    out = decode_header(walk_together(df, rtcp_parts, "idx int, part binary", raw, keep).withColumnRenamed("part", "raw"))
    return out.where(F.col("rtcp_pt").isin(types)) if types else out


def decode_header(df: DataFrame, raw: str = "raw") -> DataFrame:
    one = u8(raw, 0)
    return df.withColumns({"version": bits(one, 6, 2).cast("int"), "padding": bits(one, 5, 1).cast("int"), "bc": bits(one, 0, 5).cast("int"), "rtcp_pt": u8(raw, 1).cast("int"), "words": u16(raw, 2).cast("int"), "ssrc": F.coalesce(u32(raw, 4), F.lit(0))})


def sender_info(raw: str = "raw") -> Column:
    return F.struct(u32(raw, 8).alias("ntp_msw"), u32(raw, 12).alias("ntp_lsw"), u32(raw, 16).alias("rtp_ts"), u32(raw, 20).alias("packets"), u32(raw, 24).alias("octets"))


def report_blocks(raw: str = "raw") -> Column:
    """The report blocks of a sender or receiver report, as far as the bytes go."""
    start = F.when(F.col("rtcp_pt") == SR, 28).otherwise(8)
    n = F.least(F.col("bc"), F.floor((F.octet_length(raw) - start) / 24).cast("int"))

    def block(i: Column) -> Column:
        at = start + i * 24
        return F.struct(u32(raw, at).alias("source"), u8(raw, at + 4).cast("int").alias("fraction"), s24(raw, at + 5).alias("lost"), u32(raw, at + 8).alias("highest"), u32(raw, at + 12).alias("jitter"), u32(raw, at + 16).alias("lsr"), u32(raw, at + 20).alias("dlsr"))

    return F.when(F.col("rtcp_pt").isin(SR, RR) & (n > 0), F.transform(F.sequence(F.lit(0), n - 1), block))


def goodbye(raw: str = "raw") -> Column:
    """The sources that leave (the header's own and bc - 1 more), and the reason."""
    more = F.greatest(F.col("bc") - 1, F.lit(0))
    at = 8 + more * 4
    sources = F.when(F.col("bc") > 0, F.transform(F.sequence(F.lit(0), more), lambda i: u32(raw, 4 + i * 4))).otherwise(F.array().cast("array<bigint>"))
    reason = F.when(F.octet_length(raw) > at, F.decode(part(raw, at + 1, u8(raw, at)), "UTF-8"))
    return F.struct(sources.alias("sources"), reason.alias("reason"))


def application(raw: str = "raw") -> Column:
    return F.struct(F.col("bc").alias("subtype"), F.decode(part(raw, 8, 4), "UTF-8").alias("name"), part(raw, 12, F.octet_length(raw)).alias("data"))


def feedback(raw: str = "raw") -> Column:
    kind = F.when((F.col("rtcp_pt") == TRANSPORT_FEEDBACK) & (F.col("bc") == 1), "NACK").when(F.col("rtcp_pt") == PAYLOAD_FEEDBACK, F.when(F.col("bc") == 1, "PLI").when(F.col("bc") == 2, "SLI").when(F.col("bc") == 3, "RPSI").when(F.col("bc") == 15, "application"))
    return F.struct(F.col("bc").alias("fmt"), u32(raw, 8).alias("media_ssrc"), part(raw, 12, F.octet_length(raw)).alias("fci"), kind.alias("kind"))


#: Payload type → decoder of the body; register() adds to it.
DECODERS: dict[int, Callable[[str], Column]] = {SR: sender_info, BYE: goodbye, APP: application, TRANSPORT_FEEDBACK: feedback, PAYLOAD_FEEDBACK: feedback}


def register(pt: int, decoder: Callable[[str], Column]) -> None:
    DECODERS[pt] = decoder


def decode_bodies(df: DataFrame, raw: str = "raw", decoders: dict[int, Callable[[str], Column]] | None = None) -> DataFrame:
    """df with one struct column body_<pt> for each type of decoders (the registered ones, unless given), null in rows of other types."""
    found = dict(DECODERS if decoders is None else decoders)
    return df.withColumns({f"body_{pt}": F.when(F.col("rtcp_pt") == pt, decoder(raw)) for pt, decoder in found.items()})


def description_items(df: DataFrame, keep: tuple[str, ...], raw: str = "raw") -> DataFrame:
    """keep, chunk, source, item_type, text of source descriptions."""
    return walk_together(df.where(F.col("rtcp_pt") == SDES), sdes_items, "chunk int, source long, item_type int, text string", raw, keep)


def is_valid_first(raw: str = "raw") -> Column:
    return F.coalesce(u16(raw, 0).bitwiseAND(F.lit(VALID_MASK)) == (2 << 14 | SR), F.lit(False))


def valid_compounds(packets: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """key, valid: the first packet opens a compound, all are of version 2, and a source description holds a CNAME (type 1)."""
    named = items.where("item_type = 1 AND text <> ''").select(key).distinct().withColumn("named", F.lit(True))
    all_ = packets.groupBy(key).agg(F.min_by(is_valid_first(), "idx").alias("opens"), F.bool_and(F.col("version") == 2).alias("v2"), F.bool_or(F.col("rtcp_pt") == SDES).alias("described"))
    return all_.join(named, key, "left").select(key, (F.col("opens") & F.col("v2") & (~F.col("described") | F.coalesce("named", F.lit(False)))).alias("valid"))


def ntp_ms(msw: Column, lsw: Column) -> Column:
    """Milliseconds since 1970 of a 64-bit time; a clear first bit means the era from 2036 on."""
    seconds = F.when(msw >= 1 << 31, msw - ERA_1900).otherwise(msw - ERA_2036)
    return seconds * 1000 + F.floor(lsw * 1000 / F.lit(4294967296.0)).cast("long")


def ntp_parts(ms: Column) -> Column:
    """struct(msw, lsw) of milliseconds since 1970."""
    seconds = F.floor(ms / 1000)
    return F.struct(F.pmod(seconds + ERA_1900, F.lit(1 << 32)).alias("msw"), F.ceil((ms - seconds * 1000) * F.lit(4294967296.0) / 1000).cast("long").alias("lsw"))


def ntp_middle(msw: Column, lsw: Column) -> Column:
    """The middle 32 bits, as reports carry them."""
    return bits(msw, 0, 16) * 65536 + bits(lsw, 16, 16)
