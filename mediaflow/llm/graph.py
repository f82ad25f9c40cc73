"""Connected components of an edge table, by alternating large and small stars, and linking within buckets by pivots.

Only edges and bucket entries move; nothing is collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaflow.llm.common import cut, drop_cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, c) for every id that has an edge: c is the smallest id it reaches. Loops and repeated edges do no harm."""
    held = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    last = None
    while True:
        # every node's greater neighbours go to its least one …
        both = held.select("u", "v").unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # … then the smaller ones, and the node itself
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        after = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        drop_cut(held)
        held, before = after, last
        last = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if last == before:
            break
    roots = held.select(F.col("v").alias("id"), F.col("v").alias("c")).distinct()
    return held.select(F.col("u").alias("id"), F.col("v").alias("c")).unionByName(roots)


def joined(state: DataFrame, links: DataFrame) -> DataFrame:
    """state (id, c) with the chains joined that links (a, b) connect; the stored `state` is given up."""
    if links.isEmpty():
        return state
    of = lambda x: state.select(F.col("id").alias(x), F.col("c").alias(f"c{x}"))
    moved = components(links.join(of("a"), "a").join(of("b"), "b"), "ca", "cb").select(F.col("id").alias("c"), F.col("c").alias("to"))
    after = cut(state.join(moved, "c", "left").select("id", F.coalesce("to", "c").alias("c")))
    drop_cut(moved, state)
    return after


#: Times as many pivots in each further round.
STEP = 256


def link(table: DataFrame, state: DataFrame, compare: Callable[[DataFrame], DataFrame], able: Callable[[str, str], Column] | None = None, rounds: int | None = None, step: int = STEP) -> DataFrame:
    """state with the chains joined that links within buckets make.

    table: (key, id, …), who meets in which bucket; state: (id, c), every id's chain so far; compare: of pairs (a, b) those
    that are linked; able: a condition on the columns that two entries must meet, by the prefixes of their names.
    In each bucket one member (the least id) is compared with all members of other chains; then members drawn by hash are, `step`
    times as many each round, until every pair of the bucket is in one chain or compared (or for `rounds` rounds). The stored
    `state` is given up: once chains are joined, its files go."""
    columns = [c for c in table.columns if c != "key"] + ["c"]
    tested: list[DataFrame] = []
    turn = 0
    while rounds is None or turn < rounds:
        now = table.join(state, "id")
        stats = now.groupBy("key").agg(F.count("*").alias("members"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("id").alias("first")).where("lo <> hi").select("key", "members", "first")
        live = cut(now.join(stats, "key"))
        most = live.agg(F.max("members")).first()[0]
        if not most:
            drop_cut(live)
            break
        place = F.shiftrightunsigned(F.xxhash64("key", "id"), 11) / float(1 << 53) * F.col("members")
        if turn == 0:
            pivot, done = F.col("id") == F.col("first"), F.lit(False)
        else:
            pivot, done = place < float(step**turn), place < float(step ** (turn - 1) if turn > 1 else 0)
        left = live.where(pivot & ~done).select("key", *(F.col(c).alias(f"l_{c}") for c in columns))
        right = live.where(~done).select("key", *(F.col(c).alias(f"r_{c}") for c in columns))
        met = left.join(right, "key").where((F.col("l_c") != F.col("r_c")) & (able("l_", "r_") if able else F.lit(True)))
        pairs = met.select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b")).distinct()
        for old in tested:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = cut(pairs)
        tested.append(pairs)
        drop_cut(live)
        if not pairs.isEmpty():
            links = cut(compare(pairs))
            state = joined(state, links)
            drop_cut(links)
        turn += 1
        if turn > 1 and step ** (turn - 1) >= most:
            break
    drop_cut(*tested)
    return state
