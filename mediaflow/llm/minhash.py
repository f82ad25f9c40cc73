"""Near-duplicates by MinHash with tensored banding, every candidate confirmed on its full shingle sets.

A document's set holds the hashes of its distinct 5-word shingles. Instead of rows * tables minhashes, 2 * `side` collections
of `rows` minhashes each are computed, and a table key is a pair of one collection from each half: side**2 tables from
2 * side * rows minhashes, so the hashing costs a square root of what the tables would. A pair of likeness J is missed with
probability at most 2 * (1 - J**rows)**side; unless given, `side` is chosen for 2.2e-5 at the threshold (12 at 0.85, 16 at 0.8).

1. Equal sets become one node. 2. Collections that no other node shares are left out, and with them their tables' keys.
3. In each bucket all members are compared with one of them. That joins the copies of most groups into chains at one
comparison a copy. 4. Members of buckets that still hold several chains are told apart exactly: two sets can only reach the
threshold if they share one of their rarest shingles (the prefix that the threshold leaves). Among these smaller buckets, some
pivots at a time are compared with the members of other chains, many times as many each round, until every pair of a bucket
is in one chain or compared. So no link between candidates is lost, and no group is expanded into all its pairs. 5. A pair to
compare must have sizes that allow the threshold and, if it only met in tables, share `agree` collections; then its whole sets
decide.

Words are runs of anything but space and \\t to \\r, A-Z lowered. A text with fewer words than `words` has its whole sequence
as the one shingle; a text without words (empty, null) has the empty set and no links. Rows with one id are one document with
several sets. Other columns stay with `keep_representatives`, whatever their names. An empty table has no groups; a text's set
is made of the whole text, however long.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaflow.llm.common import Words, cut, documents, drop_cut, ragged, slices
from mediaflow.llm.graph import link

SHINGLE, ROWS, AGREE, MISS = 5, 3, 4, 1.1e-5
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def side_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """The fewest collections on a side with which a pair at the threshold misses one side's with probability `miss` at most."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))) if percent < 100 else 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return (x ^ (x >> np.uint64(27))) * _M1


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text in turn, and each text's bounds in them."""
    words = Words(texts, lower=True)
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(words.dictionary))
    hashes = own[words.codes] if len(own) else np.zeros(0, np.uint64)
    counts, first = words.counts, words.bounds[:-1]
    # windows: as many as fit, or one shorter one
    n_windows = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = ragged(first, n_windows)
    owner = np.repeat(np.arange(len(counts)), n_windows)
    length = np.minimum(counts, size)[owner]
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        here = k < length
        if here.all():
            out = mix(out + hashes[at + k] + _M1)
        else:
            out[here] = mix(out[here] + hashes[at[here] + k] + _M1)
    sets, ends, a = [], [0], 0
    for n in n_windows.tolist():
        s = np.unique(out[a : a + n]) if n > 1 else out[a : a + n]
        a += n
        sets.append(s)
        ends.append(ends[-1] + len(s))
    return np.concatenate(sets) if sets else out, np.array(ends)


def collections(sets: np.ndarray, bounds: np.ndarray, rows: int = ROWS, side: int = 12, seed: int = 1) -> np.ndarray:
    """For each text with shingles, 2 * side hashes of `rows` minhashes each."""
    factors = np.random.default_rng(seed).integers(0, 1 << 63, 2 * side * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    starts = bounds[:-1][bounds[:-1] < bounds[1:]]
    out = np.zeros((len(starts), 2 * side), np.uint64)
    for k, factor in enumerate(factors):
        if len(starts):
            out[:, k // rows] = mix(out[:, k // rows] + np.minimum.reduceat(sets * factor, starts) + np.uint64(k))
    return out


def sketch(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, rows: int = ROWS, side: int = 12) -> DataFrame:
    """key, n_shingles, set_key (of the whole set; null if empty), bands (2 * side longs)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                sets, bounds = shingle_sets(part.column(text), size)
                n = np.diff(bounds)
                bands = np.zeros((len(n), 2 * side), np.int64)
                bands[n > 0] = collections(sets, bounds, rows, side).view(np.int64)
                keys = [xxhash.xxh3_128_digest(sets[a:b].tobytes()) if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(n.astype(np.int64)), pa.array(keys, pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), 2 * side).cast(pa.list_(pa.int64()))], [key, "n_shingles", "set_key", "bands"])

    schema = T.StructType([docs.schema[key], *T._parse_datatype_string("n_shingles long, set_key binary, bands array<long>").fields])
    return docs.select(key, text).mapInArrow(run, schema)


def full_sets(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, s): the whole shingle sets."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                sets, bounds = shingle_sets(part.column(text), size)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(sets.view(np.int64)))], ["id", "s"])

    return docs.select(key, text).mapInArrow(run, T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("s", T.ArrayType(T.LongType()))]))


def buckets(nodes: DataFrame, side: int) -> DataFrame:
    """(key, id, n, at): the table keys that two nodes or more share; n is the set's size, at is 0."""
    parts = nodes.select("id", "n_shingles", F.posexplode("bands").alias("i", "h"))
    shared = parts.groupBy("i", "h").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    kept = parts.join(shared, ["i", "h"]).groupBy("id").agg(F.first("n_shingles").alias("n"), F.collect_list(F.when(F.col("i") < side, F.struct("i", "h"))).alias("x"), F.collect_list(F.when(F.col("i") >= side, F.struct("i", "h"))).alias("y"))
    pairs = kept.select("id", "n", F.explode("x").alias("x"), "y").select("id", "n", "x", F.explode("y").alias("y"))
    keys = pairs.select(F.xxhash64("x.i", "x.h", "y.i", "y.h").alias("key"), "id", F.col("n").cast("int").alias("n"), F.lit(0).alias("at"))
    many = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key")
    return keys.join(many, "key")


def prefixes(ids: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, id, n, at): of each set (of n shingles) the n - ceil(n * percent / 100) + 1 rarest ones, those that another set
    has too, with their place in the order of rareness."""
    rows = sets.join(ids, "id", "left_semi").select("id", F.size("s").alias("n"), F.explode("s").alias("key"))
    again = rows.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    held = rows.join(again, "key").groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("k", "key"))).alias("r"))
    take = F.size("r") - F.floor((F.col("n") * percent + 99) / 100).cast("int") + 1  # its n - size(r) own shingles come first
    own = F.col("n") - F.size("r")
    return held.where(take > 0).select("id", "n", own.alias("own"), F.posexplode(F.slice("r", F.lit(1), take)).alias("at", "x")).select("x.key", "id", "n", (F.col("own") + F.col("at")).alias("at"))


def compare(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, agree: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    one = nodes.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("bands").alias("ba"))
    two = nodes.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("bands").alias("bb"))
    able = pairs.join(one, "a").join(two, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    same = F.aggregate(F.zip_with("ba", "bb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
    able = able.where(same >= agree).select("a", "b").distinct()
    met = able.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return met.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, size: int = SHINGLE, rows: int = ROWS, side: int | None = None, agree: int = AGREE) -> DataFrame:
    """key, n_shingles, component_id for every row: the smallest key that it reaches over links of likeness percent/100."""
    side = side or side_for(percent, rows)
    sketches = cut(sketch(docs, key, text, size, rows, side))
    nodes = cut(sketches.where("n_shingles > 0").groupBy("set_key").agg(F.min(key).alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")))
    table = cut(buckets(nodes, side))
    ids = table.select("id").distinct()
    joined = docs.select(key, text).join(ids.withColumnRenamed("id", key), key, "left_semi")
    sets = cut(full_sets(joined, key, text, size))
    near = cut(nodes.join(ids, "id", "left_semi").drop("set_key"))
    state = cut(ids.select("id", F.col("id").alias("c")))

    def linked(least: int):
        return lambda pairs: compare(pairs, near, sets, percent, least)

    def able(one: str, two: str):
        """At most the shingles from the shared one on are common, if it is the first that both have."""
        n, m, i, j = (F.col(f"{x}{c}") for c in ("n", "at") for x in (one, two))
        return (100 + percent) * F.least(n - i, m - j) >= percent * (n + m)

    state = link(table, state, linked(agree), able, rounds=1)
    chains = table.join(state, "id").groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    contested = table.join(chains, "key").select("id").distinct()
    rare = cut(prefixes(contested, sets, percent))
    state = link(rare, state, linked(0), able)
    owner = nodes.select("set_key", "id").join(state, "id", "left").select("set_key", F.coalesce("c", "id").alias("component_id"))
    out = cut(sketches.select(key, "n_shingles", "set_key").join(owner, "set_key", "left").select(key, "n_shingles", F.coalesce("component_id", key).alias("component_id")))
    drop_cut(sketches, nodes, table, sets, near, rare, state)
    return out


def keep_representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The documents that are the smallest of their component; of rows that repeat an id, all or none stay."""
    found = near_components(docs, key, text, percent)
    gone = found.where(F.col("component_id") != F.col(key)).select(key).distinct()
    return docs.join(gone, key, "left_anti")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component over links of likeness 0.85 or more."""
    found = near_components(documents(spark, sf_dir), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(id, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN m ON m.id = w.doc_id
"""
