"""The perfect hash and its index, dedup against history by a plain version, and odd rows."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np

from mediaflow.llm import exact_dedup


def keys(seed, n):
    return np.random.default_rng(seed).integers(0, 1 << 64, (n, 4), dtype=np.uint64)


def test_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 63, 64, 65, 1000, 50_000):
        own, other = keys(n, n), keys(n + 1, 1000)
        made = exact_dedup.PerfectHash.unpack(exact_dedup.PerfectHash.build(own).pack())
        assert sorted(made(own).tolist()) == list(range(n))
        slots = made(other)
        assert ((slots >= -1) & (slots < max(n, 1))).all() or n == 0 and (slots == -1).all()
    alike = keys(5, 3000)
    alike[:, :3] = alike[0, :3]  # three of four numbers equal
    assert sorted(exact_dedup.PerfectHash.build(alike)(alike).tolist()) == list(range(3000))


def plain(rows, old):
    """{at: (keep_id, group_size, kept)} for rows (at, id, text)."""
    groups = defaultdict(list)
    for at, i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append((i not in old, i is None, i if i is not None else 0, at, i))
    out = {}
    for members in groups.values():
        best = min(members)
        out |= {m[3]: (best[4], len(members), m[3] == best[3]) for m in members}
    return out


def test_against_plain_version(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_ROWS", 64)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("ab \n\t ") for _ in range(rng.randrange(7)))) for i in range(900)]
    rows += [(None, None), (None, None), (5000, "only once"), (None, "only null"), (None, "only null"), (7, "tie"), (7, "tie"), (7, "x" * 400_000), (8, "x" * 400_000)] + [(3000 + i, "hot") for i in range(700)]
    rng.shuffle(rows)
    all_ = exact_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    for old in (set(range(0, 900, 2)), set(), set(range(6000))):
        is_old = all_.id.isin(*old) if old else all_.id < -1
        split = [all_.where(is_old), all_.where(~is_old | all_.id.isNull())]
        got = exact_dedup.assign(*split).collect()
        assert len(got) == len(rows)
        texts = {hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).digest(): t for _, t in rows}
        want = plain([(r["at"], r["id"], texts[bytes(r.digest)]) for r in got], old)
        assert {r["at"]: (r.keep_id, r.group_size, r.kept) for r in got} == want
        assert sum(r.kept for r in got) == len({bytes(r.digest) for r in got})


def test_batches_against_an_index(spark):
    schema = "doc_id string, text string, winner string, digest string"
    first = spark.createDataFrame([("b", "one  two", "w", "d"), ("a", "one two", "w", "d"), ("c", None, "w", "d")], schema)
    second = spark.createDataFrame([("0", "one\ntwo", "w", "d"), ("d", "three", "w", "d"), ("e", "three", "w", "d"), ("e", "three", "w", "d"), (None, "four", "w", "d"), ("f", "", "w", "d")], schema)
    index = exact_dedup.build_index(exact_dedup.distinct(exact_dedup.digests(first)), 3)
    left = exact_dedup.remove_repeats(second, index, 3)
    assert left.columns == second.columns
    assert sorted((r.doc_id or "", r.text) for r in left.collect()) == [("", "four"), ("d", "three")]
    assert sorted(r.doc_id for r in exact_dedup.remove_repeats(first).collect()) == ["a", "c"]
    assert exact_dedup.remove_repeats(first.where("false"), index, 3).count() == 0
    none = exact_dedup.digests(first.where("false"))
    assert exact_dedup.assign(none, none).count() == 0
