"""What the findings named that were left after round 3."""

from collections import Counter

from mediaflow.operators import routing


def test_fan_out_of_few_keys_is_many_tasks(spark):
    """Two keys, one of them with nearly all rows: every pair once, and no task makes more than a share of them."""
    packets = spark.range(3000).selectExpr("id AS packet", "CAST(IF(id % 100 = 0, 1, 0) AS INT) AS pt").coalesce(1)
    sessions = spark.range(100).selectExpr("id AS session_id", "CAST(id % 3 AS INT) AS pt").coalesce(1)
    out = routing.fan_out(packets, sessions, ["pt"], task_rows=5000)
    got = Counter((r.packet, r.pt, r.session_id) for r in out.collect())
    assert got == Counter((p, int(p % 100 == 0), s) for p in range(3000) for s in range(100) if s % 3 == int(p % 100 == 0))
    sizes = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) > 10 and max(sizes) < sum(sizes) / 4
    assert routing.fan_out(packets.limit(0), sessions, ["pt"]).count() == 0


def test_tasks_of_units_grow_with_the_lines(spark, monkeypatch):
    """A task has a bounded number of lines, however few shuffle partitions there are; a unit is put together once."""
    from mediaflow.jobs import media_queries as jobs
    from mediaflow.operators import mpegts

    sf = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert jobs.unit_tasks(spark, sf, task_rows=1000) == n // 1000 and jobs.unit_tasks(spark, sf) == 8
    monkeypatch.setattr(jobs, "unit_tasks", lambda *_: 30)
    assert jobs.shaped(spark, sf, block_keys=500).rdd.getNumPartitions() == 30
    units = jobs.decoded(spark, sf)
    got = mpegts.continuity(units, tasks=50)
    assert got.rdd.getNumPartitions() == 50
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mpegts.continuity(units).collect()))
    plan = jobs.QUERIES["w10_continuity"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("repeat(AB") == 1


def test_parts_of_connections_come_in_full_batches(spark):
    """Each connection's parts are its own, whatever the batches of segments; small connections share a batch."""
    from pyspark.sql import functions as F

    from mediaflow.operators import walkers
    from mediaflow.sources import capture

    frame = lambda i: F.concat(F.unhex(F.lit("24")), F.unhex(F.lit("01")), F.unhex(F.lit("0003")), F.encode(F.lpad(i.cast("string"), 3, "0"), "UTF-8"))
    rows = spark.range(900).select((F.col("id") % 300).alias("c"), F.floor(F.col("id") / 300).alias("s"), frame(F.col("id")).alias("raw"))
    # cut within a frame: its first four octets, then the others
    cut = rows.select("c", (F.col("s") * 2).alias("s"), F.substring("raw", 1, 4).alias("raw")).union(rows.select("c", F.col("s") * 2 + 1, F.expr("substring(raw, 5)")))
    got = capture.split_interleaved(cut, ("c",), order=("s",))
    assert sorted((r.c, r.idx, r.at, bytes(r.part)) for r in got.collect()) == [(c, k, 7 * k, b"%03d" % (c + 300 * k)) for c in range(300) for k in range(3)]

    sizes = walkers.along_segments(cut, walkers.Interleaved, "idx int, channel int, at long, part binary", "raw", ("c",), ("s",))
    batches = sizes.mapInArrow(lambda bs: (b.select([0]).slice(0, 1) for b in bs if b.num_rows), "c long").count()
    assert batches < 100


def test_a_line_is_written_once_for_all_its_fields(spark):
    from mediaflow.jobs import media_queries as jobs

    plan = jobs.QUERIES["s3_malformed"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", RTP, ") == 1


def test_signatures_mark_a_text_once(spark):
    from pyspark.sql import functions as F

    from mediaflow.llm import spotsigs

    df = spark.createDataFrame([(1, "the cat sat on the mat")], "doc_id long, text string")
    plan = df.select(spotsigs.signatures(F.col("text")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("{8}") == 1
