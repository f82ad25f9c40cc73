"""Packets to contexts, sessions and streams.

Context tables are small beside packets; they are reduced to one row per key before any join, and Spark broadcasts them only
while they are below its size threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_added(contexts: DataFrame, key: str, value: str = "session_id") -> DataFrame:
    """One row per key: the context added last (the largest session id)."""
    return contexts.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(value).alias(value))


def route(packets: DataFrame, contexts: DataFrame) -> DataFrame:
    """packets with session_id and routed_by: context of the source (local or remote), else of the payload type."""
    ends = contexts.select("session_id", F.explode(F.array("local_ssrc", "remote_ssrc")).alias("ssrc"))
    by_ssrc = last_added(ends, "ssrc").withColumnRenamed("session_id", "__s__")
    by_pt = last_added(contexts, "pt").withColumnRenamed("session_id", "__p__")
    both = packets.join(by_ssrc, "ssrc", "left").join(by_pt, "pt", "left")
    how = F.when(F.col("__s__").isNotNull(), "ssrc").when(F.col("__p__").isNotNull(), "pt")
    return both.select(*packets.columns, F.coalesce("__s__", "__p__").alias("session_id"), how.alias("routed_by"))


def unaddressed(packets: DataFrame, contexts: DataFrame) -> DataFrame:
    ends = contexts.select(F.explode(F.array("local_ssrc", "remote_ssrc")).alias("ssrc")).distinct()
    return packets.join(ends, "ssrc", "left_anti").join(contexts.select("pt").distinct(), "pt", "left_anti").select(*packets.columns)


def known_types(packets: DataFrame, contexts: DataFrame) -> DataFrame:
    """Routed packets (session_id) whose payload type their session lists."""
    return packets.join(contexts.select("session_id", "pt").distinct(), ["session_id", "pt"], "left_semi").select(*packets.columns)


def conflicts(contexts: DataFrame) -> DataFrame:
    """(a, b, kind): every pair of contexts, the lesser session first, that share their remote source and payload type. The pairs of a
    class grow with its square; identity_classes() tells the same classes in a row for each member."""
    one = contexts.select("session_id", "remote_ssrc", "pt").distinct()
    a, b = (one.select("remote_ssrc", "pt", F.col("session_id").alias(x)) for x in ("a", "b"))
    return a.join(b, ["remote_ssrc", "pt"]).where("a < b").select("a", "b", F.lit("identity").alias("kind"))


def identity_classes(contexts: DataFrame) -> DataFrame:
    """(kind, ssrc, pt, session_id, first): the contexts that share a local source, or a known remote one, and a payload type with
    others, each with the least session of its class. A class of any size gives one row for each of its members."""
    kinds = F.array(F.struct(F.lit("local").alias("kind"), F.col("local_ssrc").alias("ssrc")), F.struct(F.lit("remote").alias("kind"), F.col("remote_ssrc").alias("ssrc")))
    each = contexts.select("session_id", "pt", F.explode(kinds).alias("x")).select("x.kind", "x.ssrc", "pt", "session_id").where("ssrc IS NOT NULL AND ssrc <> 0").distinct()
    least = each.groupBy("kind", "ssrc", "pt").agg(F.min("session_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return each.join(least, ["kind", "ssrc", "pt"])


def channel_clashes(contexts: DataFrame, client: str = "client_id") -> DataFrame:
    """(client, channel, sessions): channels that more than one of a client's contexts uses. No pairs are made."""
    each = contexts.select(client, "session_id", F.explode(F.array("data_ch", "ctrl_ch")).alias("channel")).distinct()
    return each.groupBy(client, "channel").agg(F.count(F.lit(1)).alias("sessions")).where("sessions > 1")


def own_source(packets: DataFrame, contexts: DataFrame) -> DataFrame:
    """Packets that carry a context's own (local) source: a loop, or a clash of identities."""
    return packets.join(contexts.select(F.col("local_ssrc").alias("ssrc")).distinct(), "ssrc", "left_semi").select(*packets.columns)


def by_channel(frames: DataFrame, contexts: DataFrame) -> DataFrame:
    """frames (channel) with the contexts' session_id and whether the channel carries data or control."""
    each = contexts.select("session_id", F.explode(F.array(F.struct(F.col("data_ch").alias("channel"), F.lit("data").alias("carries")), F.struct(F.col("ctrl_ch").alias("channel"), F.lit("control").alias("carries")))).alias("x"))
    last = each.groupBy("x.channel").agg(F.max(F.struct("session_id", "x.carries")).alias("m")).select("channel", "m.*")
    return frames.join(last, "channel", "left")


def fan_out(packets: DataFrame, attachments: DataFrame, keys: list[str], task_rows: int = 1 << 24, most_tasks: int = 4096, most_chunk: int = 1 << 13) -> DataFrame:
    """Every packet once for each attached session. Packets and sessions are counted by key first. A key's rows are then cut into
    cells of about as many packets as sessions, several cells a task of about task_rows rows (more, if that would be over
    most_tasks), so that neither few keys nor a small input make few tasks, and little is sent. A cell's sessions are arrays, of
    2 * most_chunk at most, that its packets are joined with and expanded by: a row is made without a lookup of its own."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    made = count(packets, "__p__").join(count(attachments, "__a__"), keys).withColumn("__made__", F.col("__p__").cast("double") * F.col("__a__"))
    rows = made.agg(F.sum("__made__")).first()[0] or 0
    least = min(4 * packets.sparkSession.sparkContext.defaultParallelism, rows // (task_rows >> 4))
    tasks = int(min(most_tasks, max(1, least, rows // task_rows)))
    if tasks == 1:
        return packets.join(attachments, keys)
    cells = 4 * tasks
    chunk = min(most_chunk, max(1, int((rows / cells) ** 0.5)))
    of_key = F.ceil(F.col("__made__") * cells / rows)
    chunks = F.least(F.ceil(F.col("__a__") / chunk), F.greatest(of_key, F.ceil(F.col("__a__") / most_chunk)))
    share = made.withColumn("__chunks__", chunks.cast("int")).select(*keys, "__chunks__", F.ceil(of_key / F.col("__chunks__")).cast("int").alias("__parts__"))
    own = [c for c in attachments.columns if c not in keys]
    numbered = attachments.join(share, keys).withColumn("__chunk__", F.pmod(F.xxhash64(*attachments.columns), F.col("__chunks__")).cast("int"))
    # equal rows have one hash: a chunk is cut by number as well
    numbered = numbered.withColumn("__n__", F.floor((F.row_number().over(Window.partitionBy(*keys, "__chunk__").orderBy(*own or keys)) - 1) / (2 * chunk)))
    held = numbered.groupBy(*keys, "__chunk__", "__n__", "__parts__").agg(F.collect_list(F.struct(*own or keys)).alias("__held__"))
    to = held.withColumn("__part__", F.explode(F.sequence(F.lit(0), F.col("__parts__") - 1))).select(*keys, "__part__", "__chunk__", "__held__")
    dealt = packets.join(share, keys).withColumn("__part__", F.pmod(F.xxhash64(*packets.columns), F.col("__parts__")).cast("int"))
    dealt = dealt.withColumn("__chunk__", F.explode(F.sequence(F.lit(0), F.col("__chunks__") - 1))).drop("__parts__", "__chunks__")
    # never a broadcast: arrays that repeat are small as files, not in memory
    met = dealt.repartition(tasks, *keys, "__part__", "__chunk__").join(to.hint("merge"), [*keys, "__part__", "__chunk__"])
    return met.select(*packets.columns, F.inline("__held__")) if own else met.select(*packets.columns, F.explode("__held__")).select(*packets.columns)


def fan_out_totals(packets: DataFrame, attachments: DataFrame, keys: list[str]) -> DataFrame:
    """Packets and octets sent to each session: packets are summed before the join, so nothing is multiplied."""
    sums = packets.groupBy(*keys).agg(F.count(F.lit(1)).alias("packets"), F.sum("payload_len").alias("octets"))
    return sums.join(attachments, keys).groupBy("session_id").agg(F.sum("packets").alias("packets"), F.sum("octets").alias("octets"))


def fan_out_summary(packets: DataFrame, attachments: DataFrame, keys: list[str]) -> DataFrame:
    """packets with how many sessions get each, their sum, least and greatest; packets that none gets are left out. Attachments are
    summed by key before the join, so a packet stays one row."""
    per = attachments.groupBy(*keys).agg(F.count(F.lit(1)).alias("sessions"), F.sum("session_id").alias("session_sum"), F.min("session_id").alias("first_session"), F.max("session_id").alias("last_session"))
    return packets.join(per, keys)


def find_stream(urls: DataFrame, streams: DataFrame) -> DataFrame:
    """urls (url_id, url) with the stream that the last path segment names (the one before it, if that is a track or a media
    type): by name, then id, then alias, without regard to case."""
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    pieces = F.split(path, "/")
    last = F.lower(F.element_at(pieces, -1))
    is_track = last.rlike("^trackid=") | last.isin("audio", "video", "text", "application")
    word = F.when(is_track & (F.size(pieces) > 1), F.lower(F.element_at(pieces, -2))).otherwise(last)
    asked = urls.withColumn("word", word)
    names = streams.select("stream_id", F.explode(F.concat(F.array(F.struct(F.lit(1).alias("rank"), F.lower("name").alias("word")), F.struct(F.lit(2).alias("rank"), F.col("stream_id").cast("string").alias("word"))), F.transform("aliases", lambda a: F.struct(F.lit(3).alias("rank"), F.lower(a).alias("word"))))).alias("x")).select("stream_id", "x.*")
    best = names.groupBy("word").agg(F.min(F.struct("rank", "stream_id")).alias("b")).select("word", "b.*")
    return asked.join(best, "word", "left").select(*urls.columns, "word", "stream_id", F.col("rank").alias("matched_by"))
