"""Transport-stream units: header, adaptation field, program tables, continuity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediaflow.functions.bits import bits, part, u8, u16, unsigned
from mediaflow.operators.walkers import pat_programs, ts_units, walk
from mediaflow.sources import ranges

UNIT = 188


def read(spark: SparkSession, path: str, range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """path, file_offset, raw of transport-stream files; files are read in ranges of octets, by many tasks. file_offset orders a file's units."""
    return ranges.read_ranges(spark, ranges.UnitSource, path, range_bytes)


def numbered(units: DataFrame, slice_octets: int = 64 << 20, stream: str = "path") -> DataFrame:
    """units of read() with unit_idx, their number in the stream from 0 on: in their file, or in all files of a stream (a column), which
    come in the order of their paths. Units are numbered within stretches of a file, to which the counts of the stretches before are
    added: no file is one task's."""
    parts = units.withColumn("__part__", F.floor(F.col("file_offset") / slice_octets))
    counts = parts.groupBy(*dict.fromkeys([stream, "path"]), "__part__").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("__before__", F.coalesce(F.sum("n").over(Window.partitionBy(stream).orderBy("path", "__part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("path", "__part__", "__before__")
    own = F.row_number().over(Window.partitionBy("path", "__part__").orderBy("file_offset"))
    return parts.withColumn("__own__", own).join(before, ["path", "__part__"]).withColumn("unit_idx", (F.col("__before__") + F.col("__own__") - 1).cast("long")).drop("__part__", "__own__", "__before__")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """path, unit_idx, raw by Spark's own file systems, for paths that only they open: a file is one task's, of 2 GB at most."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("raw"))
    return walk(files, ts_units, "unit_idx long, unit binary", "raw", ("path",)).withColumnRenamed("unit", "raw")


def write(df: DataFrame, folder: str, key: str = "path", order: tuple[str, ...] = ("unit_idx",), segment_units: int | None = None) -> None:
    """Writes the units (raw) of each key as a file `key`.ts in the folder, in order. segment_units: every so many numbers (unit_idx) of
    a key are a file of their own, `key`-segment.ts, whose names are in the order of the segments, so that a long stream is many tasks'."""
    name = F.col(key).cast("string")
    if segment_units:
        name = F.concat_ws("-", name, F.lpad(F.floor(F.col("unit_idx") / segment_units).cast("string"), 12, "0"))
    ranges.write_files(df, folder, ranges.UnitSource, name, F.lit(b""), F.col("raw"), order, ".ts")


def decode(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with tei, pusi, priority, pid, scrambling, afc, cc; a unit holds payload if afc's low bit is set."""
    two, four = u16(raw, 1), u8(raw, 3)
    return df.withColumns({
        "tei": bits(two, 15, 1).cast("int"), "pusi": bits(two, 14, 1).cast("int"), "priority": bits(two, 13, 1).cast("int"), "pid": bits(two, 0, 13).cast("int"),
        "scrambling": bits(four, 6, 2).cast("int"), "afc": bits(four, 4, 2).cast("int"), "cc": bits(four, 0, 4).cast("int"),
    })


def adaptation(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with af_length (null without the field), its flags, pcr and opcr (27 MHz), splice_countdown."""
    there = F.col("afc") >= 2
    length = F.when(there, u8(raw, 4))
    flags = F.when(length > 0, u8(raw, 5))
    flag = lambda k: bits(flags, k, 1).cast("int")

    def clock(at):
        six = unsigned(raw, at, 6)  # 33 bits of 90 kHz, six reserved, nine of 27 MHz
        return F.shiftright(six, 15) * 300 + bits(six, 0, 9)

    has = lambda k: F.coalesce(bits(flags, k, 1) == 1, F.lit(False))
    after_pcr = F.when(has(4), 12).otherwise(6)
    after = F.when(has(3), after_pcr + 6).otherwise(after_pcr)
    splice = F.when(has(2), u8(raw, after))
    return df.withColumns({
        "af_length": length.cast("int"), "discontinuity": flag(7), "random_access": flag(6), "pcr": F.when(has(4), clock(F.lit(6))), "opcr": F.when(has(3), clock(after_pcr)),
        "splice_countdown": F.when(splice >= 128, splice - 256).otherwise(splice).cast("int"), "private_data": flag(1), "af_extension": flag(0),
    })


def payload(raw: str = "raw"):
    start = F.when(F.col("afc") == 3, u8(raw, 4) + 5).otherwise(4)
    return F.when(F.col("afc").bitwiseAND(F.lit(1)) == 1, part(raw, start, UNIT)).otherwise(F.lit(b""))


def programs(df: DataFrame, key: str = "path", raw: str = "raw") -> DataFrame:
    """key, program, pid: the latest association of each program, from units of PID 0 that start a section."""
    starts = df.where("pid = 0 AND pusi = 1").select(key, "unit_idx", payload(raw).alias("p"))
    found = walk(starts, pat_programs, "program int, pid int", "p", (key, "unit_idx"))
    return found.groupBy(key, "program").agg(F.max_by("pid", "unit_idx").alias("pid"))


def pid_filter(df: DataFrame, pids: list[int]) -> DataFrame:
    return df.where(F.col("pid").isin(pids))


def pid_histogram(df: DataFrame, key: str = "path") -> DataFrame:
    """Units of each PID, and how many are scrambled or in error."""
    return df.groupBy(key, "pid").agg(F.count(F.lit(1)).alias("units"), F.count(F.when(F.col("scrambling") > 0, 1)).alias("scrambled"), F.count(F.when(F.col("tei") == 1, 1)).alias("errors"))


def continuity(df: DataFrame, key: str = "path", tasks: int | None = None) -> DataFrame:
    """Units with payload whose counter doesn't follow the one before, of their PID; a repeated counter is a duplicate. tasks: to how
    many the PIDs of all keys are dealt (the session's number of shuffle partitions, unless given)."""
    w = Window.partitionBy(key, "pid").orderBy("unit_idx")
    d = df.where(F.col("afc").bitwiseAND(F.lit(1)) == 1).select(key, "unit_idx", "pid", "cc")
    d = (d.repartition(tasks, key, "pid") if tasks else d).withColumn("before", F.lag("cc").over(w))
    step = F.pmod(F.col("cc") - F.col("before"), F.lit(16))
    return d.where(F.col("before").isNotNull() & (step != 1)).select(key, "unit_idx", "pid", "before", "cc", F.when(step == 0, "duplicate").otherwise("lost").alias("kind"))
