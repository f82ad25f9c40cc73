"""Sequence numbers: unwrapping, source validation, gaps, duplicates, jitter, counters.

All windows share one key (the source) and one order (arrival), so one shuffle and one sort serve them together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mediaflow.functions.storage import written

KEYS, ORDER = ("ssrc",), ("arrival_ms", "event_id", "copy")
MOD, DROPOUT, MISORDER, PROBATION = 1 << 16, 500, 100, 2


def by_source(keys=KEYS, order=ORDER):
    return Window.partitionBy(*keys).orderBy(*order)


def signed_step(now, before, bits: int = 16):
    """The step between two counters of `bits` bits, by the shorter way round."""
    return F.pmod(now - before + (1 << bits - 1), F.lit(1 << bits)) - (1 << bits - 1)


def unwrap(df: DataFrame, column: str = "seq", out: str = "ext", bits: int = 16, keys=KEYS, order=ORDER) -> DataFrame:
    """df with the extended number: the first one, plus all signed steps since. A late packet steps back and the next one forth."""
    w = by_source(keys, order)
    step = F.coalesce(signed_step(F.col(column), F.lag(column).over(w), bits), F.col(column)).cast("long")
    return df.withColumn("__step__", step).withColumn(out, F.sum("__step__").over(w)).drop("__step__")


def unwrap_sliced(df: DataFrame, slice_ms: int, column: str = "seq", out: str = "ext", bits: int = 16, keys=KEYS, order=ORDER) -> DataFrame:
    """unwrap() for hot sources: time slices of a source are ordered on their own, by as many tasks as there are slices. Of each
    slice only its first and last number and the sum of its steps are carried to the next ones, and added back."""
    parts = df.withColumn("__slice__", F.floor(F.col("arrival_ms") / slice_ms))
    own = unwrap(parts, column, "__own__", bits, (*keys, "__slice__"), order)
    at = F.struct(*order)
    ends = parts.groupBy(*keys, "__slice__").agg(F.min_by(column, at).alias("first"), F.max_by(column, at).alias("last"))
    totals = own.groupBy(*keys, "__slice__").agg(F.max_by("__own__", at).alias("end"))
    w = Window.partitionBy(*keys).orderBy("__slice__")
    small = ends.join(totals, [*keys, "__slice__"])
    # where a slice starts: the end of the one before, and the step between both
    step = F.coalesce(signed_step(F.col("first"), F.lag("last").over(w), bits), F.col("first")).cast("long")
    small = small.withColumn("step", step).withColumn("within", F.col("end") - F.col("first"))
    start = F.sum("step").over(w) + F.coalesce(F.sum("within").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = small.select(*keys, "__slice__", (start - F.col("first")).alias("__shift__"))
    return own.join(shift, [*keys, "__slice__"]).withColumn(out, F.col("__own__") + F.col("__shift__")).drop("__own__", "__shift__", "__slice__")


class Validation:
    """The sequential rules of RFC 3550 A.1 for one source; `state` is all that must be kept between packets."""

    def __init__(self, top: int | None = None, probation: int = PROBATION, bad: int = MOD + 1, cycles: int = 0):
        self.top, self.probation, self.bad, self.cycles = top, probation, bad, cycles

    @property
    def state(self) -> tuple:
        return self.top, self.probation, self.bad, self.cycles

    def take(self, seq: int) -> bool:
        """Whether the packet is accepted."""
        if self.top is None:
            self.top = seq - 1
        if self.probation > 0:
            ok = seq == self.top + 1 and self.probation == 1
            self.probation, self.top = (0 if ok else PROBATION - 1), seq
            if ok:
                self.bad, self.cycles = MOD + 1, 0
            return ok
        step = (seq - self.top) % MOD
        if step < DROPOUT:
            self.cycles += MOD if seq < self.top else 0
            self.top = seq
            return True
        if step > MOD - MISORDER:
            return False
        ok = seq == self.bad
        if ok:
            self.top, self.bad, self.cycles = seq, MOD + 1, 0
        else:
            self.bad = (seq + 1) % MOD
        return ok


STATE = "accepted boolean, probation int, max_seq int, bad_seq int, cycles long"


def along_sources(df: DataFrame, columns: list[str], keys, order, made: str, open_, step) -> DataFrame:
    """`columns` of df with the columns `made` (DDL): step(held, batch) gives them for a run of rows of one source, where `held` is
    what open_() made at the source's first row. A source's rows come in order, and only one batch and `held` are in memory; the
    runs of a batch are put together again, so that many short sources don't make many small batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            starts = [i for i, n in enumerate(names) if i == 0 or n != names[i - 1]]
            runs = []
            for a, b in zip(starts, [*starts[1:], len(names)], strict=True):
                if held is None or names[a] != source:
                    source, held = names[a], open_()
                runs.append(step(held, batch.slice(a, b - a)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.concat_arrays(c) for c in zip(*runs, strict=True))], [*columns, *added.fieldNames()])

    added = T._parse_datatype_string(made)
    schema = T.StructType([*(df.schema[c] for c in columns), *added.fields])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def source_state(df: DataFrame, keys=KEYS, order=ORDER) -> DataFrame:
    """keys, order columns and seq with the validation state after each packet. Only these columns are shuffled: join the rest
    back by the order columns."""
    columns = list(dict.fromkeys([*keys, *order, "seq"]))

    def step(rules: Validation, part: pa.RecordBatch) -> list[pa.Array]:
        rows = [(rules.take(seq), rules.probation, rules.top, rules.bad, rules.cycles) for seq in part.column("seq").to_pylist()]
        return [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)]

    return along_sources(df.select(*columns), columns, keys, order, STATE, Validation, step)


def interarrival(df: DataFrame, keys=KEYS, order=ORDER) -> DataFrame:
    return df.withColumn("gap_ms", F.col("arrival_ms") - F.lag("arrival_ms").over(by_source(keys, order)))


def jitter(df: DataFrame, clock: str = "clock_rate", keys=KEYS, order=ORDER) -> DataFrame:
    """keys, order columns, jitter after each packet, in clock units: J += (|D| - J) / 16, from 0 at a source's first packet."""
    columns = list(dict.fromkeys([*keys, *order]))

    def step(held: dict, part: pa.RecordBatch) -> list[pa.Array]:
        at, media, rate = (part.column(c).to_numpy(zero_copy_only=False) for c in ("arrival_ms", "rtp_ts", clock))
        before = held or {"at": at[0], "media": media[0], "jitter": 0.0}
        ticks = (np.diff(media, prepend=before["media"]) + (1 << 31)) % (1 << 32) - (1 << 31)
        d = np.abs(np.diff(at, prepend=before["at"]) * rate / 1000.0 - ticks)
        out = pd.Series(np.concatenate([[before["jitter"]], d])).ewm(alpha=1 / 16, adjust=False).mean().to_numpy()[1:]
        held.update(at=at[-1], media=media[-1], jitter=out[-1])
        return [pa.array(out, pa.float64())]

    return along_sources(df.select(*dict.fromkeys([*columns, "arrival_ms", "rtp_ts", clock])), columns, keys, order, "jitter double", dict, step)


# -- hot sources: the time slices of a source walked by many tasks -----------------------------------------------------
def _slices(df: DataFrame, slice_ms: int) -> DataFrame:
    return df.withColumn("__slice__", F.floor(F.col("arrival_ms") / slice_ms))


def _along_slices(df: DataFrame, starts: DataFrame, keys, order, open_, made: str, ends: bool) -> DataFrame:
    """Walks each slice of a source from the state in starts (keys, __slice__, start): a slice's state is a row before its packets.

    open_(start) gives a walker; take(*values) gives the columns `made` (DDL), a tuple a packet, for the values of open_.COLUMNS, end()
    those of a whole slice. With ends, a row for each slice (keys, __slice__ and made), else one for each packet (keys, order columns
    and made). A batch is turned into values once and gives one batch, however short its slices; the walk is dealt to as many tasks
    as shuffles have, since it needs more time than its few octets tell."""
    at = [*keys, "__slice__"]
    columns = at if ends else list(dict.fromkeys([*keys, *order]))
    none = F.lit(None)
    packets = df.withColumn("start", none.cast(starts.schema["start"].dataType)).withColumn("__packet__", F.lit(1))
    heads = starts.select(*at, *(none.cast(df.schema[c].dataType).alias(c) for c in df.columns if c not in at), "start", F.lit(0).alias("__packet__"))
    added = T._parse_datatype_string(made)
    schema = T.StructType([*(df.schema[c] for c in columns), *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema).types
        slice_, walker = None, None

        def batch_of(rows: list[tuple], own: list[pa.Array]) -> pa.RecordBatch:
            values = list(zip(*rows, strict=True)) or [()] * (len(kinds) - len(own))
            return pa.RecordBatch.from_arrays([*own, *(pa.array(x, t) for x, t in zip(values, kinds[len(own) :], strict=True))], schema.fieldNames())

        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in at), strict=True))
            values = [batch.column(c).to_pylist() for c in open_.COLUMNS]
            packet = batch.column("__packet__").to_pylist()
            state, done = batch.column("start"), []
            runs = [i for i, n in enumerate(names) if i == 0 or n != names[i - 1]]
            for a, b in zip(runs, [*runs[1:], len(names)], strict=True):
                if names[a] != slice_:
                    if ends and slice_ is not None:
                        done.append((*slice_, *walker.end()))
                    slice_, walker = names[a], open_(state[a].as_py())
                a += packet[a] == 0
                if a < b:
                    rows = walker.take(*(v[a:b] for v in values))
                    if not ends:
                        done += rows
            if ends:
                yield batch_of(done, [])
            else:
                yield batch_of(done, [c.filter(pa.array([p == 1 for p in packet])) for c in (batch.column(c) for c in columns)])
        if ends and slice_ is not None:
            yield batch_of([(*slice_, *walker.end())], [])

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packets.unionByName(heads).repartition(tasks, *at).sortWithinPartitions(*at, "__packet__", *order).mapInArrow(run, schema)


class _JitterSlice:
    """The jitter of a slice's packets, after the packet and the jitter before it."""

    COLUMNS = ("arrival_ms", "rtp_ts", "__rate__")

    def __init__(self, start: dict | None):
        self.at, self.media, self.jitter, self.n = (start["at"], start["media"], start["jitter"], 0) if start else (None, None, 0.0, 0)

    def take(self, at: list, media: list, rate: list) -> list[tuple]:
        if self.at is None:
            self.at, self.media = at[0], media[0]
        before, sent, jitter, out = self.at, self.media, self.jitter, []
        for now, ts, r in zip(at, media, rate, strict=True):
            d = abs((now - before) * r / 1000.0 - ((ts - sent + (1 << 31)) % (1 << 32) - (1 << 31)))
            jitter = jitter * (15 / 16) + d / 16
            out.append((jitter,))
            before, sent = now, ts
        self.at, self.media, self.jitter, self.n = before, sent, jitter, self.n + len(at)
        return out

    def end(self) -> tuple:
        return self.jitter, self.n


def jitter_sliced(df: DataFrame, slice_ms: int, clock: str = "clock_rate", keys=KEYS, order=ORDER) -> DataFrame:
    """jitter() for hot sources: the time slices of a source are walked by as many tasks. A slice of n packets maps the jitter before
    it, J, to (15/16)^n J + b; these maps, a row for each slice, are composed along the source, and every slice is then walked from
    its own start. Slices know the last packet before them from an aggregation."""
    at = [*keys, "__slice__"]
    rows = written(_slices(df, slice_ms).withColumn("__rate__", F.col(clock)).select(*dict.fromkeys([*at, *order, "arrival_ms", "rtp_ts", "__rate__"])))
    along = Window.partitionBy(*keys).orderBy("__slice__")
    last = rows.groupBy(*at).agg(F.max_by(F.struct("arrival_ms", "rtp_ts"), F.struct(*order)).alias("last")).withColumn("p", F.lag("last").over(along))
    state = lambda jitter: F.when(F.col("p").isNotNull(), F.struct(F.col("p.arrival_ms").cast("long").alias("at"), F.col("p.rtp_ts").cast("long").alias("media"), jitter.cast("double").alias("jitter"))).alias("start")
    before = written(last.select(*at, "p"))
    maps = written(_along_slices(rows, before.select(*at, state(F.lit(0.0))), keys, order, _JitterSlice, "b double, n long", ends=True))

    def compose(held: dict, part: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for b, n in zip(part.column("b").to_pylist(), part.column("n").to_pylist(), strict=True):
            out.append(held.setdefault("j", 0.0))
            held["j"] = (15 / 16) ** n * held["j"] + b
        return [pa.array(out, pa.float64())]

    composed = along_sources(maps, at, keys, ("__slice__",), "j double", dict, compose)
    starts = before.join(composed, at).select(*at, state(F.col("j")))
    return _along_slices(rows, starts, keys, order, _JitterSlice, "jitter double", ends=False)


class _ValidationSlice:
    """The rules over a slice's packets. Cycles never decide anything; while they count from ONWARD they go on from those before."""

    ONWARD, COLUMNS = -(1 << 48), ("seq",)

    def __init__(self, start: dict | None):
        self.begun = start
        given = (start["top"], start["probation"], start["bad"], self.ONWARD) if start else ()
        self.rules, self.cycles = Validation(*given), (start["cycles"] if start else 0)

    def _cycles(self) -> int:
        return self.rules.cycles if self.rules.cycles >= 0 else self.rules.cycles - self.ONWARD + self.cycles

    def take(self, seqs: list) -> list[tuple]:
        rules = self.rules
        return [(rules.take(seq), rules.probation, rules.top, rules.bad, self._cycles()) for seq in seqs]

    def end(self) -> tuple:
        """The state after the slice, whether its bad number and its cycles go on from those before, and the state it was walked from."""
        r, on = self.rules, self.rules.cycles < 0
        b = self.begun or {}
        return r.top, r.probation, r.bad, r.cycles - self.ONWARD if on else r.cycles, on, bool(b) and r.bad == b["bad"], b.get("top"), b.get("probation"), b.get("bad")


def source_state_sliced(df: DataFrame, slice_ms: int, keys=KEYS, order=ORDER) -> DataFrame:
    """source_state() for hot sources: the time slices of a source are walked by as many tasks, speculatively. First every slice is
    walked as if its source began there; then from the state in which the slice before it ended, until no start changes any more.
    The rules forget: two packets in sequence end a probation, so nearly always the second round's starts are the last. A row for
    each slice is what goes along the source in between."""
    at = [*keys, "__slice__"]
    rows = written(_slices(df, slice_ms).select(*dict.fromkeys([*at, *order, "seq"])))
    ends_ddl = "top int, probation int, bad int, cycles long, go_on boolean, same_bad boolean, top0 int, probation0 int, bad0 int"
    start_ddl = "top int, probation int, bad int, cycles long"
    starts = rows.select(*at).distinct().withColumn("start", F.lit(None).cast(f"struct<{start_ddl.replace(' ', ':').replace(',:', ',')}>"))

    def onward(held: dict, part: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for r in part.to_pylist():
            now = held.get("state")
            out.append((*(now or (None,) * 4), (now[:3] if now else (None,) * 3) != (r["top0"], r["probation0"], r["bad0"])))
            bad = now[2] if now and r["same_bad"] else r["bad"]
            held["state"] = (r["top"], r["probation"], bad, r["cycles"] + (now[3] if now and r["go_on"] else 0))
        return [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()), strict=True)]

    while True:
        ended = _along_slices(rows, starts, keys, order, _ValidationSlice, ends_ddl, ends=True)
        told = written(along_sources(ended, at, keys, ("__slice__",), f"{start_ddl}, changed boolean", dict, onward))
        starts = told.select(*at, F.when(F.col("probation").isNotNull(), F.struct("top", "probation", "bad", "cycles")).alias("start"))
        if told.where("changed").isEmpty():
            return _along_slices(rows, starts, keys, order, _ValidationSlice, STATE, ends=False)


def cumulative_jitter(df: DataFrame, keys=KEYS, order=ORDER) -> DataFrame:
    """The growing form: the sum of d - ((d + 8) >> 4) over arrival gaps d in milliseconds."""
    gaps = interarrival(df, keys, order)
    d = F.coalesce("gap_ms", F.lit(0))
    return gaps.withColumn("jitter", F.sum(d - F.shiftright(d + 8, 4)).over(by_source(keys, order))).drop("gap_ms")


def duplicates(df: DataFrame, keys=KEYS, order=ORDER) -> DataFrame:
    """df (with ext) with dup_rank (1: first of its number) and late_by (how far behind the highest number so far)."""
    same = Window.partitionBy(*keys, "ext").orderBy(*order)
    so_far = F.max("ext").over(by_source(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("late_by", F.greatest(F.lit(0), F.coalesce(so_far - F.col("ext"), F.lit(0))).cast("long")).withColumn("dup_rank", F.row_number().over(same))


def gaps(df: DataFrame, keys=KEYS, most: int = DROPOUT) -> DataFrame:
    """keys, first_missing, last_missing, restart: ranges between consecutive numbers; longer than `most` is a restart."""
    w = Window.partitionBy(*keys).orderBy("ext")
    after = df.select(*keys, "ext").distinct().withColumn("next", F.lead("ext").over(w)).where(F.col("next") > F.col("ext") + 1)
    return after.select(*keys, (F.col("ext") + 1).alias("first_missing"), (F.col("next") - 1).alias("last_missing"), (F.col("next") - F.col("ext") - 1 > most).alias("restart"))


def missing(df: DataFrame, keys=KEYS, most: int = DROPOUT) -> DataFrame:
    """One row per missing number; restarts are left out."""
    return gaps(df, keys, most).where("NOT restart").select(*keys, F.explode(F.sequence("first_missing", "last_missing")).alias("ext"))


def nacks(df: DataFrame, keys=KEYS, most: int = DROPOUT) -> DataFrame:
    """Missing numbers packed as packet id and 16-bit mask of the ones that follow it, within aligned runs of 17."""
    lost = missing(df, keys, most).withColumn("block", F.floor(F.col("ext") / 17))
    w = Window.partitionBy(*keys, "block")
    rows = lost.withColumn("pid", F.min("ext").over(w))
    mask = F.sum(F.when(F.col("ext") > F.col("pid"), F.expr("shiftleft(1, cast(ext - pid - 1 as int))")).otherwise(0)).cast("int")
    return rows.groupBy(*keys, "pid").agg(mask.alias("blp")).select(*keys, F.pmod("pid", F.lit(MOD)).cast("int").alias("pid"), F.col("pid").alias("ext"), "blp")


def source_changes(df: DataFrame, stream: str, order=ORDER) -> DataFrame:
    """df with changed (the source differs from the stream's packet before) and epoch (changes so far)."""
    w = Window.partitionBy(stream).orderBy(*order)
    flag = F.coalesce((F.col("ssrc") != F.lag("ssrc").over(w)).cast("int"), F.lit(0))
    return df.withColumn("changed", flag).withColumn("epoch", F.sum("changed").over(w).cast("long"))


def running_counters(df: DataFrame, keys=KEYS, order=ORDER) -> DataFrame:
    w = by_source(keys, order)
    return df.withColumn("packets_so_far", F.count(F.lit(1)).over(w)).withColumn("octets_so_far", F.sum("payload_len").over(w))


def latest(df: DataFrame, keys, order) -> DataFrame:
    """The last row of each key, without a sort of all rows: one struct per key is kept by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def loss(df: DataFrame, keys=KEYS) -> DataFrame:
    """keys, base, ext_max, expected, received, lost (negative where packets repeat)."""
    return df.groupBy(*keys).agg(F.min("ext").alias("base"), F.max("ext").alias("ext_max"), F.count(F.lit(1)).alias("received")).select(*keys, "base", "ext_max", (F.col("ext_max") - F.col("base") + 1).alias("expected"), "received", (F.col("ext_max") - F.col("base") + 1 - F.col("received")).alias("lost"))


def interval_loss(df: DataFrame, interval_ms: int, keys=KEYS) -> DataFrame:
    """keys, bucket, cumulative expected and received at its end, lost and fraction (of 256) within it."""
    slots = df.withColumn("bucket", F.floor(F.col("arrival_ms") / interval_ms)).groupBy(*keys, "bucket").agg(F.min("ext").alias("lo"), F.max("ext").alias("hi"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy("bucket")
    all_ = Window.partitionBy(*keys)
    # the base is the source's least number, so expected never steps back
    total = slots.withColumn("expected", F.max("hi").over(w) - F.min("lo").over(all_) + 1).withColumn("received", F.sum("n").over(w))
    step = lambda c: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))
    rows = total.withColumn("e", step("expected")).withColumn("lost", step("expected") - step("received"))
    fraction = F.when((F.col("e") == 0) | (F.col("lost") <= 0), 0).otherwise(F.floor(F.col("lost") * 256 / F.col("e"))).cast("int")
    return rows.select(*keys, "bucket", F.col("hi").alias("bucket_max"), "expected", "received", "lost", fraction.alias("fraction"))
