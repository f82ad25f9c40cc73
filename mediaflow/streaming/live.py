"""Streaming forms of the packet and session operators. Arrival is event time; state lives in the state store and is bounded by
watermarks or timeouts. Columns are those of sources.capture.PACKETS (and conn_id, session_id, cseq, kind, ts for messages)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mediaflow.operators.frames import MOST_PACKETS
from mediaflow.operators.sequence import MOD, ORDER, Validation, source_state
from mediaflow.sources.capture import PACKETS

FRAME = "ssrc long, pt int, rtp_ts long, packets int, octets long, complete boolean"


def live_packets(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Packets as they arrive as Parquet files in a folder (any streaming source of this schema will do)."""
    return spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _plain(value):
    """value, with tuples for rows: state takes no rows within rows."""
    return tuple(map(_plain, value)) if isinstance(value, tuple) else [_plain(v) for v in value] if isinstance(value, list) else value


class InOrder(StatefulProcessor):
    """Rows of a key in order of event time, whatever batches they come in. Rows wait in state until the watermark has passed the end
    of their bucket of event time; a timer then hands them, sorted, to a walker, which keeps a small state. What a key holds is one
    value, read and written once a batch, and it has one timer; more rows than FEW wait in a map by bucket, of which one is in memory
    at a time. Rows later than the watermark are dropped, as Spark does."""

    AT_ONCE, FEW = 5000, 100
    #: The width of a bucket; in_order() widens it with the lateness.
    bucket_ms = 1000
    #: The columns of a row, the first three of which order rows, and the state between rows, as DDL.
    COLUMNS, ROW, STATE = (), "", ""

    def open(self, key: tuple, state: tuple | None):
        """A walker: take(row) and rest(now) yield rows; state is what it keeps (None: nothing), due when rest() has something to do."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "bucket long", f"rows array<struct<{self.ROW}>>")
        self.kept = handle.getValueState("kept", f"timer long, buckets array<long>, few array<struct<{self.ROW}>>, walker struct<{self.STATE}>")

    def _kept(self) -> tuple[int | None, set[int], list[tuple], tuple | None]:
        """The time of the key's timer, the buckets in the map, the rows that aren't there, and the walker's state."""
        timer, buckets, few, state = self.kept.get() or (None, (), (), None)
        return timer, set(buckets), [tuple(r) for r in few], _plain(state)

    def _keep(self, timer: int | None, due: int | None, buckets: set[int], few: list[tuple], state: tuple | None) -> None:
        if due is None:
            self.kept.clear()
            return
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.kept.update((due, sorted(buckets), few, state))

    def _until(self, at_ms: int) -> int:
        """The end of the bucket that at_ms is in."""
        return (at_ms // self.bucket_ms + 1) * self.bucket_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        timer, buckets, few, state = self._kept()
        due = timer
        for r in rows:
            row = tuple(r[c] for c in self.COLUMNS)
            end = self._until(row[0])
            due = end if due is None or end < due else due
            few.append(row)
            if len(few) >= self.AT_ONCE:
                self._hold(buckets, few)
        if buckets or len(few) > self.FEW:
            self._hold(buckets, few)
        self._keep(timer, due, buckets, few, state)
        return iter(())

    def _hold(self, buckets: set[int], few: list[tuple]) -> None:
        parts = {}
        for row in few:
            parts.setdefault(row[0] // self.bucket_ms, []).append(row)
        for b, rows in parts.items():
            before = [tuple(r) for r in self.held.getValue((b,))[0]] if b in buckets else []
            self.held.updateValue((b,), (before + rows,))
            buckets.add(b)
        few.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() // self.bucket_ms * self.bucket_ms  # all rows before are here
        _, buckets, few, state = self._kept()
        walker = self.open(key, state)
        for b in sorted(b for b in buckets if (b + 1) * self.bucket_ms <= now):
            rows = sorted((tuple(r) for r in self.held.getValue((b,))[0]), key=lambda r: r[:3])
            self.held.removeKey((b,))
            buckets.remove(b)
            for row in rows:
                yield from walker.take(row)
        for row in sorted((r for r in few if r[0] < now), key=lambda r: r[:3]):
            yield from walker.take(row)
        yield from walker.rest(now)
        few = [r for r in few if r[0] >= now]
        state = walker.state
        ends = [(b + 1) * self.bucket_ms for b in buckets] + [self._until(r[0]) for r in few]
        if state is not None:
            ends.append(-(-walker.due // self.bucket_ms) * self.bucket_ms)
        self._keep(None, min(ends, default=None), buckets, few, state)  # the timer that has come is removed by Spark


def in_order(packets: DataFrame, keys: tuple[str, ...], processor: InOrder, schema: str, late: str, initial: DataFrame | None = None) -> DataFrame:
    """The rows that processor gives for packets (with arrival). State is kept in RocksDB, which this form of state needs. Buckets
    are a sixtieth of the lateness wide, a second at least: rows wait so much longer at most."""
    spark = packets.sparkSession
    processor.bucket_ms = max(InOrder.bucket_ms, int(pd.Timedelta(late.removeprefix("interval ")).total_seconds() * 1000) // 60)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = packets.withWatermark("arrival", late).withColumn("at_ms", F.unix_millis("arrival")).select(*dict.fromkeys([*keys, *processor.COLUMNS, "arrival"]))
    return rows.groupBy(*keys).transformWithState(processor, schema, "Append", "EventTime", initial.groupBy(*keys) if initial is not None else None)


class _Frames:
    """At most two open frames of a source."""

    def __init__(self, ssrc: int, state: tuple | None, idle_ms: int, most: int):
        self.ssrc, self.idle_ms, self.most = ssrc, idle_ms, most
        self.last, self.held = (state[0], [list(f) for f in state[1]]) if state else (None, [])

    def _ended(self, f: list) -> Row:
        pt, at, seqs, octets, marker = f
        return Row(ssrc=self.ssrc, pt=pt, rtp_ts=at, packets=len(seqs), octets=octets, complete=marker and _gapless(seqs))

    def rest(self, now: int) -> Iterator[Row]:
        if self.held and self.last + self.idle_ms <= now:
            yield from map(self._ended, self.held)
            self.held = []

    def take(self, row: tuple) -> Iterator[Row]:
        at_ms, _, _, pt, at, seq, marker, size = row
        yield from self.rest(at_ms)
        self.last = at_ms
        own = next((f for f in self.held if (f[0], f[1]) == (pt, at)), None)
        if own is None:
            own = [pt, at, [], 0, False]
            self.held.append(own)
            if len(self.held) > 2:
                yield self._ended(self.held.pop(0))
        if seq not in own[2]:
            own[2] = [*own[2], seq]
            own[3] += size
            own[4] = own[4] or marker == 1
            if len(own[2]) >= self.most:
                self.held.remove(own)
                yield self._ended(own)

    @property
    def state(self) -> tuple | None:
        return (self.last, [tuple(f) for f in self.held]) if self.held else None

    @property
    def due(self) -> int:
        return self.last + self.idle_ms


class FrameProcessor(InOrder):
    COLUMNS = ("at_ms", "event_id", "copy", "pt", "rtp_ts", "seq", "marker", "payload_len")
    ROW = "at_ms: long, event_id: long, copy: int, pt: int, rtp_ts: long, seq: int, marker: int, payload_len: long"
    STATE = "last long, open array<struct<pt:int,at:long,seqs:array<int>,octets:long,marker:boolean>>"

    def __init__(self, idle_ms: int, most: int):
        self.idle_ms, self.most = idle_ms, most

    def open(self, key, state):
        return _Frames(key[0], state, self.idle_ms, self.most)


def stream_frames(packets: DataFrame, idle_ms: int = 30_000, late: str = "10 seconds", most: int = MOST_PACKETS) -> DataFrame:
    """Frames of each source, with its payload type and media time: at most two are open, the current one and the one before.
    A packet of another media time opens a frame and ends the older of the two; `most` packets end a frame as well, and so do idle_ms
    of event time without a packet. A number counts once in a frame. Packets are taken in order of arrival. A frame is complete if its
    numbers have no hole and a marker came; a packet for a frame that has ended opens it anew."""
    return in_order(packets, ("ssrc",), FrameProcessor(idle_ms, most), FRAME, late)


def _gapless(seqs: list[int]) -> bool:
    """Numbers relative to the first, so that a wrap makes no hole."""
    near = [(s - seqs[0] + MOD // 2) % MOD for s in seqs]
    return max(near) - min(near) + 1 == len(near)


def interval_reports(packets: DataFrame, interval: str = "4960 milliseconds", late: str = "10 seconds") -> DataFrame:
    return packets.withWatermark("arrival", late).groupBy("ssrc", F.window("arrival", interval)).agg(F.count(F.lit(1)).alias("packets"), F.sum("payload_len").alias("octets"))


def goodbyes(packets: DataFrame, timeout: str = "9920 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Runs of a source without a pause of `timeout`; goodbye is the time at which the pause has lasted so long."""
    runs = packets.withWatermark("arrival", late).groupBy("ssrc", F.session_window("arrival", timeout)).agg(F.count(F.lit(1)).alias("packets"))
    return runs.select("ssrc", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("goodbye"), "packets")


def session_expiry(messages: DataFrame, late: str = "10 seconds") -> DataFrame:
    """messages (conn_id, ts, timeout seconds): runs without a pause of their own timeout."""
    gap = F.concat(F.col("timeout").cast("string"), F.lit(" seconds"))
    runs = messages.withWatermark("ts", late).groupBy("conn_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("messages"))
    return runs.select("conn_id", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("expires"), "messages")


def without_duplicates(packets: DataFrame, late: str = "10 seconds") -> DataFrame:
    return packets.withWatermark("arrival", late).dropDuplicatesWithinWatermark(["ssrc", "seq", "rtp_ts"])


def match(requests: DataFrame, responses: DataFrame, within: str = "30 seconds", late: str = "10 seconds") -> DataFrame:
    """Requests with their responses: both sides wait no longer than the time bound."""
    a = requests.select("conn_id", "cseq", F.col("ts").alias("asked"), "method").withWatermark("asked", late)
    b = responses.select(F.col("conn_id").alias("c"), F.col("cseq").alias("n"), F.col("ts").alias("answered"), "status").withWatermark("answered", late)
    on = (F.col("conn_id") == F.col("c")) & (F.col("cseq") == F.col("n")) & (F.col("answered") >= F.col("asked")) & (F.col("answered") <= F.col("asked") + F.expr(f"INTERVAL {within}"))
    return a.join(b, on).select("conn_id", "cseq", "method", "status", (F.unix_millis("answered") - F.unix_millis("asked")).alias("rtt_ms"))


class _Rules:
    """The validation of a source, between whose packets idle_ms may not pass."""

    def __init__(self, ssrc: int, state: tuple | None, idle_ms: int):
        self.ssrc, self.idle_ms = ssrc, idle_ms
        self.last, self.own = (state[4], Validation(*state[:4])) if state else (None, Validation())

    def rest(self, now: int) -> Iterator[Row]:
        if self.last is not None and self.last + self.idle_ms <= now:
            self.own = Validation()
        return iter(())

    def take(self, row: tuple) -> Iterator[Row]:
        at_ms, event, copy, seq = row
        self.rest(at_ms)
        self.last = at_ms
        if seq is None:
            self.own = Validation()
        else:
            yield Row(ssrc=self.ssrc, event_id=event, copy=copy, accepted=self.own.take(seq))

    @property
    def state(self) -> tuple | None:
        return (*self.own.state, self.last) if self.own.top is not None else None

    @property
    def due(self) -> int:
        return self.last + self.idle_ms


class ValidationProcessor(InOrder):
    COLUMNS = ("at_ms", "event_id", "copy", "seq")
    ROW = "at_ms: long, event_id: long, copy: int, seq: int"
    STATE = "top long, probation long, bad long, cycles long, last long"

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def open(self, key, state):
        return _Rules(key[0], state, self.idle_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        r = initialState
        due = -(-(r["last"] + self.idle_ms) // self.bucket_ms) * self.bucket_ms
        self._keep(None, due, set(), [], (r["top"], r["probation"], r["bad"], r["cycles"], r["last"]))


def validated(packets: DataFrame, idle_ms: int = 3_600_000, late: str = "10 seconds", initial: DataFrame | None = None) -> DataFrame:
    """ssrc, event_id, copy, accepted: the rules of sequence.source_state across micro-batches, one small state per source.
    A packet with a null seq is a goodbye and resets its source, and so do idle_ms of event time without a packet. Packets are taken in
    order of arrival. initial: states to begin with, ssrc, top, probation, bad, cycles, last (ms of the last packet), a row a source,
    such as validation_states() gives of a batch."""
    return in_order(packets, ("ssrc",), ValidationProcessor(idle_ms), "ssrc long, event_id long, copy int, accepted boolean", late, initial)


def validation_states(packets: DataFrame) -> DataFrame:
    """The validation state of each source after a batch of packets (ssrc, seq, arrival_ms, event_id, copy), for validated()."""
    at = F.struct(*ORDER)
    last = F.struct(F.col("max_seq").cast("long").alias("top"), F.col("probation").cast("long").alias("probation"), F.col("bad_seq").cast("long").alias("bad"), "cycles", F.col("arrival_ms").cast("long").alias("last"))
    return source_state(packets).groupBy(F.col("ssrc").cast("long").alias("ssrc")).agg(F.max_by(last, at).alias("s")).select("ssrc", "s.*")


class _Buffer:
    """The frames of a source in the jitter buffer, until their timeout: numbers, octets, marker, whether it was given, last packet."""

    def __init__(self, ssrc: int, state: tuple | None, timeout_ms: int):
        self.ssrc, self.timeout_ms = ssrc, timeout_ms
        self.frames = {(f[0], f[1]): [list(f[2]), *f[3:]] for f in state[0]} if state else {}

    def _frame(self, key: tuple, f: list, ok: bool) -> Row:
        return Row(ssrc=self.ssrc, pt=key[0], rtp_ts=key[1], packets=len(f[0]), octets=f[1], complete=ok)

    def _over(self, key: tuple) -> Iterator[Row]:
        f = self.frames.pop(key)
        if not f[3]:
            yield self._frame(key, f, False)

    def rest(self, now: int) -> Iterator[Row]:
        for key in [k for k, f in self.frames.items() if f[4] + self.timeout_ms <= now]:
            yield from self._over(key)

    def take(self, row: tuple) -> Iterator[Row]:
        at_ms, _, _, pt, rtp_ts, seq, marker, size = row
        key = pt, rtp_ts
        if key in self.frames and self.frames[key][4] + self.timeout_ms <= at_ms:
            yield from self._over(key)
        f = self.frames.setdefault(key, [[], 0, False, False, at_ms])
        f[4] = at_ms
        if not f[3] and seq not in f[0]:
            f[0].append(seq)
            f[1] += size
            f[2] = f[2] or marker == 1
            if f[2] and _gapless(f[0]):
                yield self._frame(key, f, True)
                f[0], f[3] = [], True  # remembered until the timeout, for late copies

    @property
    def state(self) -> tuple | None:
        return ([(*key, *f) for key, f in self.frames.items()],) if self.frames else None

    @property
    def due(self) -> int:
        return min(f[4] for f in self.frames.values()) + self.timeout_ms


class BufferProcessor(InOrder):
    COLUMNS = ("at_ms", "event_id", "copy", "pt", "rtp_ts", "seq", "marker", "payload_len")
    ROW = "at_ms: long, event_id: long, copy: int, pt: int, rtp_ts: long, seq: int, marker: int, payload_len: long"
    STATE = "frames array<struct<pt:int,at:long,seqs:array<int>,octets:long,marker:boolean,done:boolean,last:long>>"

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def open(self, key, state):
        return _Buffer(key[0], state, self.timeout_ms)


def jitter_buffer(packets: DataFrame, timeout_ms: int = 1000, late: str = "10 seconds") -> DataFrame:
    """One frame for each (ssrc, pt, rtp_ts): given as soon as its numbers, in order of arrival, have no hole and a marker came, or
    incomplete once timeout_ms of event time have passed since its last packet. The first packet opens the frame; packets for a frame
    that is complete are late copies until that time has passed. A source's frames within timeout_ms are one value in state."""
    return in_order(packets, ("ssrc",), BufferProcessor(timeout_ms), FRAME, late)


def archive(packets: DataFrame, folder: str, checkpoint: str, key: str = "stream_id"):
    """Starts writing packets under one directory per stream."""
    return packets.writeStream.format("parquet").partitionBy(key).option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").start()
