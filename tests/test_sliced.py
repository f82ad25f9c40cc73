"""Hot sources in time slices against their plain walk, and the sweep of activities against pairs."""

import random

import pytest

from mediaflow.operators import reports, sequence


def packets(spark, n=6000):
    """One source of n packets that jumps, restarts, repeats and is misordered now and then, and small ones."""
    rng = random.Random(2)
    rows, at, seq, ts = [], 0, 65000, 4294960000
    for i in range(n):
        at += rng.choice([1, 5, 20, 20, 20, 90]) if rng.random() > 0.01 else 3000
        seq += 1 if rng.random() > 0.2 else rng.choice([0, -3, 7, 400, 400, 400] if rng.random() > 0.005 else [20_000, 700, -300])
        ts += rng.choice([160, 160, 3000, 0])
        rows.append((7, seq % 65536, ts % (1 << 32), at, i, 0, 8000))
        if rng.random() < 0.02:
            rows.append((7, (seq + 30_000) % 65536, ts % (1 << 32), at, i, 1, 8000))
    rows += [(s, (s + 2 * k) % 65536, k * 160, k * 700, k, 0, 90_000) for s in range(8, 12) for k in range(s)]
    return spark.createDataFrame(rows, "ssrc long, seq int, rtp_ts long, arrival_ms long, event_id long, copy int, clock_rate int")


@pytest.mark.parametrize("slice_ms", [700, 5000, 1_000_000])
def test_slices_give_the_plain_walk(spark, slice_ms):
    df = packets(spark).repartition(5)
    key = lambda r: (r.ssrc, r.arrival_ms, r.event_id, r.copy)
    state = lambda rows: {key(r): (r.accepted, r.probation, r.max_seq, r.bad_seq, r.cycles) for r in rows.collect()}
    want = state(sequence.source_state(df))
    assert len({v[4] for v in want.values()}) > 1 and not all(v[0] for v in want.values())
    assert state(sequence.source_state_sliced(df, slice_ms)) == want
    plain = {key(r): r.jitter for r in sequence.jitter(df).collect()}
    got = {key(r): r.jitter for r in sequence.jitter_sliced(df, slice_ms).collect()}
    assert got.keys() == plain.keys() and all(abs(got[k] - plain[k]) <= 1e-9 * max(1, abs(plain[k])) for k in plain)


def test_a_hot_source_is_many_tasks(spark):
    df = packets(spark, 3000).where("ssrc = 7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    counts = sequence.source_state_sliced(df, 2000).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(c > 0 for c in counts) >= 6 and max(counts) < 1500
    none = df.where("false")
    assert sequence.source_state_sliced(none, 2000).count() == 0 and sequence.jitter_sliced(none, 2000).count() == 0


@pytest.mark.parametrize("slice_ms", [500, 8000])
def test_sweep_against_pairs(spark, slice_ms):
    rng = random.Random(slice_ms)
    events = [(rng.randrange(3), rng.randrange(20_000), i) for i in range(400)]
    contexts = [(rng.randrange(3), rng.randrange(20_000)) for _ in range(300)] + [(0, 500), (0, 500), (0, 1000)]
    events += [(0, 1000, 1001), (0, 1500, 1002), (9, 5, 1003), (0, 0, 1004)]
    e, c = spark.createDataFrame(events, "session_id int, at_ms long, event_id long"), spark.createDataFrame(contexts, "session_id int, active_ms long")
    want = {}
    for s, t, i in events:
        own = [a for k, a in contexts if k == s and 0 <= t - a <= 500]
        if own:
            want[s, i, t] = (len(own), min(own), max(own))
    got = reports.activity_counts(e, c, 500, ids=("event_id",), slice_ms=slice_ms)
    assert {(r.session_id, r.event_id, r.at_ms): (r.active, r.since_ms, r.last_ms) for r in got.collect()} == want
    with pytest.raises(ValueError):
        reports.activity_counts(e, c, 500, ids=("event_id",), slice_ms=499)
