"""What the findings of round 3 named."""

from pyspark.sql import functions as F

from mediaflow.operators import reports, routing


def test_conflicts_are_all_pairs(spark):
    rows = [(1, 7, 0), (2, 7, 0), (3, 7, 0), (3, 7, 0), (4, 7, 8), (5, 9, 0)]
    got = routing.conflicts(spark.createDataFrame(rows, "session_id long, remote_ssrc long, pt int")).collect()
    assert sorted((r.a, r.b, r.kind) for r in got) == [(1, 2, "identity"), (1, 3, "identity"), (2, 3, "identity")]


def test_sources_of_many_are_counted_exactly(spark):
    """7,000 sources in an interval, some in the next one too: beyond what a sketch tells exactly."""
    rows = spark.range(9000).selectExpr("id % 7000 AS ssrc", "CASE WHEN id < 7000 THEN 5 ELSE 5000 END AS arrival_ms", "0 AS stream")
    held = reports.source_sets(rows, 4960, ("stream",))
    assert sorted(map(tuple, reports.counted(held, "stream", "bucket").collect())) == [(0, 0, 7000), (0, 1, 2000)]
    assert reports.counted(held, "stream").first().sources == 7000
    assert reports.estimated(reports.roll_up(reports.source_sketches(rows, 4960, ("stream",)), "stream")).where(F.abs(F.col("sources") - 7000) > 400).count() == 0


def test_units_are_numbered_in_blocks(spark):
    """Blocks of 50 order keys give what one numbering of each file gives, and no window holds a file."""
    import duckdb

    from mediaflow.jobs import media_queries as jobs

    sf = "/root/testdata/sf0.001"
    text = f"WITH {jobs.UNITS.format(lineitem=f"read_parquet('{sf}/lineitem.parquet')")} SELECT f, unit_idx, pid, k, cc FROM t"
    got = jobs.shaped(spark, sf, block_keys=50).select("f", "unit_idx", "pid", "k", "cc")
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(text).fetchall())
    plan = jobs.units(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [row_number()" in x]
    assert windows and all("block" in x for x in windows)


def test_long_streams_are_files_of_segments_and_small_files_share_a_task(spark, tmp_path):
    from mediaflow.operators import mpegts
    from mediaflow.sources import capture, ranges

    df = spark.range(700).selectExpr("id AS unit_idx", "CAST(id % 2 AS STRING) AS path", "concat(unhex('47'), unhex(lpad(hex(id), 6, '0')), unhex(repeat('AB', 184))) AS raw").repartition(5)
    folder = f"{tmp_path}/ts"
    mpegts.write(df, folder, segment_units=100)
    assert len(ranges.files(folder)) == 14 and len(ranges.RangeReader({"path": folder}, ranges.Units).partitions()) == 1
    read = mpegts.read(spark, folder).withColumn("stream", F.regexp_extract("path", r"([^/]+)-\d+\.ts$", 1))
    got = {(r.stream, r.unit_idx): bytes(r.raw) for r in mpegts.numbered(read, slice_octets=1000, stream="stream").collect()}
    assert got == {(str(i % 2), i // 2): b"\x47" + i.to_bytes(3, "big") + b"\xab" * 184 for i in range(700)}
    entries = spark.range(300).selectExpr("CAST(id % 3 AS STRING) AS stream_id", "0L AS start_us", "'10.0.0.4' AS source", "5004 AS port", "id AS offset_ms", "false AS is_rtcp", "CAST(repeat('x', CAST(id % 40 AS INT)) AS BINARY) AS raw")
    capture.write_captures(entries, f"{tmp_path}/rtp", slice_ms=10)
    assert len(ranges.files(f"{tmp_path}/rtp")) == 90 and len(ranges.RangeReader({"path": f"{tmp_path}/rtp"}, ranges.Captures).partitions()) == 1
    assert sorted((r.offset_ms, len(r.raw)) for r in capture.read_capture(spark, f"{tmp_path}/rtp").collect()) == [(i, i % 40) for i in range(300)]
