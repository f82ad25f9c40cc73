"""What the findings named that were left after round 6."""

from collections import Counter

from pyspark.sql import functions as F


def test_fan_out_joins_arrays_of_sessions(spark):
    """The join makes a row for a packet and many sessions; equal sessions all count."""
    from mediaflow.operators import routing

    packets = spark.range(900).selectExpr("id DIV 2 AS packet", "CAST(id % 3 AS INT) AS pt")
    sessions = spark.range(400).selectExpr("IF(id < 200, 7L, id) AS session_id", "CAST(id % 2 AS INT) AS pt", "'x' AS name")
    out = routing.fan_out(packets, sessions, ["pt"], task_rows=5000, most_chunk=8)
    by_type = {}
    for s in sessions.collect():
        by_type.setdefault(s.pt, []).append((s.session_id, s.name))
    assert out.columns == ["packet", "pt", "session_id", "name"]
    assert Counter(map(tuple, out.collect())) == Counter((p.packet, p.pt, *s) for p in packets.collect() for s in by_type.get(p.pt, ()))
    plan = out._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("Generate inline(__held__") == 1 and "rightHint=(strategy=merge)" in plan.optimizedPlan().toString()


def test_fan_out_of_keys_alone(spark):
    """Attachments without columns of their own: packets are repeated, as by a join."""
    from mediaflow.operators import routing

    packets = spark.range(300).selectExpr("id AS packet", "id % 2 AS pt")
    out = routing.fan_out(packets, spark.range(60).select((F.col("id") % 2).alias("pt")), ["pt"], task_rows=100)
    assert Counter(map(tuple, out.collect())) == Counter({(i, i % 2): 30 for i in range(300)})


def test_files_of_headers_are_told_apart_range_by_range(spark, tmp_path, monkeypatch):
    """Units of one length, whose false chains never end: starts are told without reading a file from its first unit in each range."""
    import random

    from mediaflow.operators import walkers
    from mediaflow.sources import capture, ranges
    from tests.test_ranges import HEAD

    rng = random.Random(3)
    unit = lambda i: (20).to_bytes(2, "big") + (40).to_bytes(2, "big") + (i * 3).to_bytes(4, "big") + bytes([0x80, i % 3 * 128 % 256, 255, i % 256]) + rng.randrange(200).to_bytes(4, "big") + (i % 9).to_bytes(4, "big")
    data = HEAD + b"".join(map(unit, range(40_000)))
    (tmp_path / "x.rtp").write_bytes(data)
    (tmp_path / "short.rtp").write_bytes(data[:5000])
    octets = [0]

    def read(a, b):
        octets[0] += b - a
        return data[a:b]

    of = ranges.Captures(data[: ranges.HEAD], len(data))
    places = ranges.reaching(of, read, 250_000, 400_000).tolist()
    assert len(places) > 1  # the file's last ranges can't tell by themselves
    octets[0] = 0
    led = ranges.onward(of, read, [of.first], 300_000)
    assert list(led) == [of.first] and (led[of.first] - of.first) % 20 == 0 and 300_000 <= led[of.first] < 300_020 and octets[0] < 300_100
    known = ranges.first_units(spark, ranges.Captures, str(tmp_path), 100_000)
    starts = range(0, len(data), 100_000)
    assert list(known.values()) == [[of.first + max(0, -(-(s - of.first) // 20)) * 20 for s in starts]]
    got = capture.read_capture(spark, str(tmp_path / "x.rtp"), range_bytes=100_000)
    assert sorted((r.file_offset, r.offset_ms, bytes(r.raw)) for r in got.collect()) == [(e[5], e[3], e[6]) for e in walkers.capture_entries(data)]


def test_descriptions_are_written_again_without_a_shuffle(spark):
    """What is written of rows that stay whole is what tables of sessions, media and attributes give; no exchange is made for it."""
    from mediaflow.jobs import session_queries as jobs
    from mediaflow.operators import sdp

    plan = jobs.QUERIES["x1_written"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "md5" in plan
    texts = [
        "v=0\r\no=u 7 8 IN IP4 h\r\ns=A\r\nc=IN IP4 1.2.3.4\r\nt=1 2\r\na=x\r\nm=audio 10/2 RTP/AVP 0 98 y\r\nb=AS:5\r\na=rtpmap:0 PCMU/8000\r\na=recvonly\r\nm=video 12 RTP/AVP 96\r\nc=IN IP4 9.9.9.9\r\n",
        "v=0\no=u x 8 IN IP4 h\ns=B\nt=1 2\n", "v=0\ns=C\nm=audio\n", "m=audio 1 RTP/AVP 0\nv=0\ns=D", "v=0\r\no=u\r\n", "", None,
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "session_key int, sdp string")
    m = sdp.media(d).withColumn("bandwidth", F.transform(F.filter("lines", lambda x: F.startswith(x, F.lit("b="))), lambda x: F.substr(x, F.lit(3))))
    a = sdp.attributes(m).select("session_key", "media_idx", "idx", "name", "value").unionByName(sdp.session_attributes(d).withColumn("media_idx", F.lit(None).cast("int")))
    got = {r.session_key: r.sdp for r in sdp.texts(sdp.whole(d)).collect()}
    assert got == {r.session_key: r.sdp for r in sdp.write(sdp.sessions(d), m, a).collect()}
    assert got[0] == texts[0].replace(" y\r\n", "\r\n") and sorted(got) == [0, 1, 2, 3]


def test_letters_show_no_more_than_the_distance(spark):
    """The bound is never over the edit distance, whatever the letters; lines whose letters differ give no pair, and none is lost."""
    import random

    from mediaflow.llm import line_dedup as L

    rng = random.Random(11)
    signs = "abcdefghijklmnopqrstuvwxyz0123456789 äßαж中\U0001d400"

    def edited(x):
        x = list(x)
        for _ in range(rng.randrange(30)):
            i = rng.randrange(len(x) + 1)
            x[i : i + rng.randrange(2)] = rng.choice(["", rng.choice(signs)])
        return "".join(x)

    pairs = []
    for _ in range(400):
        a = "".join(rng.choice(signs) for _ in range(rng.choice([1, 40, 100, 254, 255, 256, 300])))
        pairs.append((a, rng.choice([edited(a), "".join(rng.sample(a, len(a))), "".join(rng.choice(signs) for _ in a)])))
    df = spark.createDataFrame(pairs, "a string, b string").where("a <> '' AND b <> ''")
    of = lambda x: [F.length(x).alias(f"{x}_n"), *(c.alias(f"{x}_{n}") for c, n in zip(L.letters(x, "5"), "pq", strict=True))]
    got = df.select("a", "b", *of("a"), *of("b")).select(L.letters_apart("a_", "b_").alias("least"), F.levenshtein("a", "b").alias("d"), "a_n", "b_n").collect()
    assert all(r.least is None for r in got if r.a_n > 254 or r.b_n > 254)
    told = [r for r in got if r.least is not None]
    assert all(r.least <= r.d for r in told) and sum(r.least > 20 for r in told) > 30
    rows = spark.createDataFrame([("a" * 30 + " b",), ("c" * 30 + " b",)], "line string").select(F.length("line").alias("n"), *L.letters("line", "2")).collect()
    apart = spark.createDataFrame([(*rows[0], *rows[1])], "x_n int, x_p long, x_q long, y_n int, y_p long, y_q long")
    assert apart.select(L.letters_apart("x_", "y_")).first()[0] == 30
