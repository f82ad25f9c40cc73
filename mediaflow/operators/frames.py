"""Frames: packets of one source and media time, their completeness, order and payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaflow.operators.sequence import KEYS, ORDER

MOST_PACKETS = 1024


def frames(df: DataFrame, keys=KEYS) -> DataFrame:
    """df (with ext and dup_rank) by source, media time and payload type. A frame misses packets if its numbers have a hole,
    and is complete if they have none and a marker came."""
    first = F.col("dup_rank") == 1
    grouped = df.groupBy(*keys, "rtp_ts", "pt").agg(
        F.count(F.when(first, 1)).alias("packets"), F.sum(F.when(first, F.col("marker")).otherwise(0)).alias("markers"), F.min("ext").alias("low"), F.max("ext").alias("high"),
        F.sum(F.when(first, F.col("payload_len")).otherwise(0)).alias("octets"), F.min("arrival_ms").alias("first_ms"), F.max("arrival_ms").alias("last_ms"),
    )
    missing = F.col("high") - F.col("low") + 1 != F.col("packets")
    return grouped.withColumn("is_missing", missing).withColumn("is_complete", ~missing & (F.col("markers") > 0))


def assemble(df: DataFrame, payload: str = "payload", keys=KEYS, complete_only: bool = True) -> DataFrame:
    """keys, rtp_ts, pt, the payload in sequence order, and whether packets were left out (truncated). MOST_PACKETS packets of a
    frame are put together at most, which bounds a group; a frame that has more isn't complete, and without complete_only its
    payload is that of its first ones."""
    held = frames(df, keys).select(*keys, "rtp_ts", "pt", (F.col("is_complete") & (F.col("packets") <= MOST_PACKETS)).alias("__whole__"), (F.col("packets") > MOST_PACKETS).alias("truncated"))
    if complete_only:
        held = held.where("__whole__")
    kept = cap(df.where("dup_rank = 1"), keys).join(held.drop("__whole__"), [*keys, "rtp_ts", "pt"])
    parts = kept.groupBy(*keys, "rtp_ts", "pt").agg(F.first("truncated").alias("truncated"), F.sort_array(F.collect_list(F.struct("ext", F.hex(payload).alias("h")))).alias("p"))
    return parts.select(*keys, "rtp_ts", "pt", F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("payload"), "truncated")


def cap(df: DataFrame, keys=KEYS, most: int = MOST_PACKETS, close_at_marker: bool = False) -> DataFrame:
    """At most `most` packets of a frame, by sequence; close_at_marker: none after its first marker."""
    w = Window.partitionBy(*keys, "rtp_ts", "pt").orderBy("ext", *[c for c in ORDER if c in df.columns])
    out = df.withColumn("__n__", F.row_number().over(w))
    if close_at_marker:
        before = F.coalesce(F.sum("marker").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = out.withColumn("__m__", before).where("__m__ = 0").drop("__m__")
    return out.where(F.col("__n__") <= most).drop("__n__")


def reorder(df: DataFrame, keys=KEYS) -> DataFrame:
    """Each source's packets together, in order of their extended numbers."""
    return df.repartition(*keys).sortWithinPartitions(*keys, "ext", *ORDER)
