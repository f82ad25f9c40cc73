"""Media-transport inputs derived from the star tables, by SQL that Spark and DuckDB both run, and their binary encodings.

The packet view holds lost, repeated and delayed packets, sequence numbers that wrap, frames of three packets and five payload
types. Arrival order is (arrival_ms, event_id, copy) throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaflow.functions.bits import be

#: Common table expressions; {events} and so on stand for the tables.
PACKETS = """
base AS (
  SELECT event_id, user_id AS ssrc, value, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn
  FROM {events}),
sent AS (
  SELECT event_id, ssrc, props, CAST(rn AS INT) AS send_idx,
         CAST((65500 + ssrc % 30 + rn) % 65536 AS INT) AS seq,
         (ssrc * 1000 + CAST(floor(rn / 3) AS BIGINT) * 3000) % 4294967296 AS rtp_ts,
         CAST(CASE WHEN rn % 3 = 2 THEN 1 ELSE 0 END AS INT) AS marker,
         CAST(CASE ssrc % 5 WHEN 0 THEN 0 WHEN 1 THEN 8 WHEN 2 THEN 33 WHEN 3 THEN 96 ELSE 26 END AS INT) AS pt,
         event_id * 5 + CAST(floor(value) AS BIGINT) % 40 + CASE WHEN event_id % 41 = 0 THEN 6000 ELSE 0 END AS arrival_ms,
         CAST(length(props) AS BIGINT) AS payload_len
  FROM base),
packets AS (
  SELECT *, 0 AS copy FROM sent WHERE event_id % 17 <> 3
  UNION ALL
  SELECT event_id, ssrc, props, send_idx, seq, rtp_ts, marker, pt, arrival_ms + 7, payload_len, 1
  FROM sent WHERE event_id % 17 <> 3 AND event_id % 29 = 4)"""

CONTEXTS = """
contexts AS (
  SELECT c_custkey AS session_id, CASE WHEN c_custkey % 200 % 3 = 0 THEN 500000 + c_custkey ELSE c_custkey % 200 END AS remote_ssrc, 100000 + c_custkey AS local_ssrc,
         CAST(CASE c_nationkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 8 WHEN 2 THEN 33 WHEN 3 THEN 96 ELSE 97 END AS INT) AS pt,
         CASE WHEN c_nationkey % 2 = 0 THEN 'audio' ELSE 'video' END AS media,
         CAST(c_custkey % 8 * 2 AS INT) AS data_ch, CAST(c_custkey % 8 * 2 + 1 AS INT) AS ctrl_ch
  FROM {customer})"""


def sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """Runs text with {table} standing for the Parquet tables named."""
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, f"WITH {PACKETS} SELECT * FROM packets", "events")


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, f"WITH {CONTEXTS} SELECT * FROM contexts", "customer")


def duck(text: str, *parts: str) -> str:
    """DuckDB SQL: the parts, then text (which may start with further expressions after WITH's comma)."""
    names = "events customer nation supplier orders lineitem conversations pages part region".split()
    return "WITH RECURSIVE " + ",".join(parts).format(**{n: n for n in names}) + text


# -- packets as bytes --------------------------------------------------------------------------------------------------
#: Shape of a derived packet, as SQL over packets: CSRCs, extension words (0: none), padding octets, octets cut off.
SHAPE = (
    "event_id % 4 AS cc",
    "CASE WHEN event_id % 3 = 0 THEN event_id % 2 + 1 ELSE 0 END AS ext_words",
    "CASE WHEN event_id % 5 = 0 THEN 4 ELSE 0 END AS pad",
    "CASE WHEN event_id % 13 = 0 THEN 9 ELSE 0 END AS cut",
)


def encode_rtp(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df (seq, rtp_ts, ssrc, marker, pt, payload; optionally version, csrcs, extension bytes, padding octets) with `raw`."""
    has = lambda c, other: F.col(c) if c in df.columns else other
    csrcs = has("csrcs", F.array().cast("array<bigint>"))
    extension = has("extension", F.lit(b""))
    pad = has("pad", F.lit(0))
    first = has("version", F.lit(2)) * 64 + F.when(pad > 0, 32).otherwise(0) + F.when(F.octet_length(extension) > 0, 16).otherwise(0) + F.size(csrcs)
    listed = F.unhex(F.array_join(F.transform(csrcs, lambda x: F.lpad(F.hex(x), 8, "0")), ""))
    padding = F.when(pad > 0, F.unhex(F.concat(F.repeat(F.lit("00"), (pad - 1).cast("int")), F.lpad(F.hex(pad), 2, "0")))).otherwise(F.lit(b""))
    return df.withColumn(raw, F.concat(be(first, 1), be(F.col("marker") * 128 + F.col("pt"), 1), be(F.col("seq"), 2), be(F.col("rtp_ts"), 4), be(F.col("ssrc"), 4), listed, extension, "payload", padding))


def packets_raw(spark: SparkSession, sf_dir: str, plain: bool = False) -> DataFrame:
    """event_id, copy, arrival_ms, raw: the derived packets encoded; unless plain, with CSRCs, extensions, padding and cuts."""
    p = packets(spark, sf_dir).withColumn("payload", F.encode("props", "UTF-8"))
    if not plain:
        p = p.selectExpr("*", *SHAPE)
        p = p.withColumn("csrcs", F.when(F.col("cc") > 0, F.transform(F.sequence(F.lit(1), F.col("cc").cast("int")), lambda i: F.col("ssrc") * 10 + i)).otherwise(F.array().cast("array<bigint>")))
        p = p.withColumn("extension", F.when(F.col("ext_words") > 0, F.concat(be(43948, 2), be(F.col("ext_words"), 2), F.unhex(F.repeat(F.lit("D4BB8A43"), F.col("ext_words").cast("int"))))).otherwise(F.lit(b"")))
    p = encode_rtp(p)
    if not plain:
        p = p.withColumn("raw", F.when(F.col("cut") > 0, F.substring("raw", F.lit(1), F.octet_length("raw") - F.col("cut").cast("int"))).otherwise(F.col("raw")))
    return p.select("event_id", "copy", "arrival_ms", "raw")

