"""Exact dedup against history, through a minimal perfect hash of the historical distinct digests.

Rows come down to (id, digest, at): the SHA-256 of the text with each run of ASCII white space as one space, and the row's
number in the table that is written of them. The distinct digests of history are dealt to shards, and each shard's digests
are compiled into a minimal perfect hash: levels of bits, a digest being settled on the first level on which no other digest
falls on its bit; the number of bits set before its own is its slot. A slot holds the full digest, the locator of the row that
stays (id and `at`) and the number of copies. A batch's digests are counted and then looked up in their shard, many at once:
the hash gives a slot for any digest, and only if all 32 octets are those of the slot is it a member. Members are repeats:
they go, and the slot counts them. Nonmembers are grouped among themselves.

The index is a table of one row a shard, so no task, and never the driver, holds more than a shard (`SHARD_ROWS` digests on
average, which being hashes spread evenly). Copies are counted before they are shuffled; what a row learns about its group
comes by an ordinary join on the digest, in which Spark splits groups that are too large for a task.

A null text counts as empty. Of equal texts the row in history stays, else the one of the least id (a null id is the last,
ties go to the lower `at`), so of rows repeated with their id one stays too. Ids are of any type with an order. An empty
history or batch, or both, are as good as any; very long texts are digested where they are read; columns of docs that have
one of the result's names are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaflow.llm.common import cut, documents, without

#: Distinct digests of a shard, on average.
SHARD_ROWS = 1 << 17
#: Bits of a level for each digest that has come to it.
BITS_A_DIGEST = 2
WHITE_SPACE = r"[\x20\x09-\x0D]+"


# -- the hash ----------------------------------------------------------------------------------------------------------
def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(digests: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of each digest (a row of four 64-bit numbers) on a level of so many bits. All four count, so that no two
    digests share their bits on every level."""
    x = np.full(len(digests), (level + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    for i in range(4):
        x = _mixed(x ^ digests[:, i])
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots 0 … n - 1 for n distinct digests. `sizes` are the levels' bits, each a multiple of 64; `words` those of all levels."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        self.first = np.concatenate([[0], np.cumsum(sizes // 64)]).astype(np.int64)

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        sizes, words, level = [], [], 0
        while len(digests):
            size = -(-BITS_A_DIGEST * len(digests) // 64) * 64
            at = _place(digests, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            digests = digests[~alone[at]]
            level += 1
        return cls(np.array(sizes, np.int64), np.concatenate([*words, np.zeros(0, np.uint64)]))

    def __call__(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; of one that wasn't built in, any slot, or -1."""
        out, left = np.full(len(digests), -1, np.int64), np.arange(len(digests))
        for level, size in enumerate(self.sizes.tolist()):
            at = _place(digests[left], level, size)
            word, bit = self.first[level] + (at >> 6), (at & 63).astype(np.uint64)
            here = self.words[word]
            hit = (here >> bit & np.uint64(1)).astype(bool)
            below = here[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[word[hit]] + np.bitwise_count(below)
            left = left[~hit]
            if not len(left):
                break
        return out

    def pack(self) -> bytes:
        return np.array([len(self.sizes)], "<i8").tobytes() + self.sizes.astype("<i8").tobytes() + self.words.astype("<u8").tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        return cls(np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<u8", -1, 8 + 8 * n))


def _matrix(column: pa.Array) -> np.ndarray:
    """Digests as rows of four 64-bit numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 4), np.uint64)
    return np.frombuffer(column.buffers()[2], np.uint8)[column.offset * 32 : (column.offset + len(column)) * 32].view("<u8").reshape(-1, 4)


def _binary(rows: np.ndarray) -> pa.Array:
    """The reverse of _matrix."""
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, 32 * len(rows) + 1, 32, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


# -- Spark -------------------------------------------------------------------------------------------------------------
def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest, at) of every row, written to the shared folder: `at` numbers rows, and holds once it is written."""
    return cut(docs.select(F.col(f"`{id}`").alias("id"), F.unhex(F.sha2(F.encode(normalised(F.col(f"`{text}`")), "UTF-8"), 256)).alias("digest"), F.monotonically_increasing_id().alias("at")))


def distinct(rows: DataFrame) -> DataFrame:
    """(digest, winner, size) of the distinct digests of (id, digest, at): the locator of the row of the least id, and how many rows."""
    return rows.groupBy("digest").agg(F.min(F.struct(F.when(F.col("id").isNull(), 1).alias("none"), "id", "at")).alias("winner"), F.count("*").alias("size"))


def _sharded(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def shards_for(*counts: int) -> int:
    """Shards such that each has SHARD_ROWS of the larger table's digests on average."""
    return max(1, -(-max(counts) // SHARD_ROWS))


def build_index(known: DataFrame, shards: int) -> DataFrame:
    """A row for each shard of (digest, winner, size): its hash, and in slot order the digests, the winners and the sizes."""
    locator = known.schema["winner"].dataType

    def build(table: pa.Table) -> pa.Table:
        rows = _matrix(table["digest"])
        made = PerfectHash.build(rows)
        order = np.argsort(made(rows))
        winners, sizes = (table[c].combine_chunks().take(pa.array(order)) for c in ("winner", "size"))
        whole = pa.array([0, len(rows)], pa.int32())
        return pa.table({
            "shard": table["shard"][:1], "hash": pa.array([made.pack()], pa.binary()), "digests": pa.array([rows[order].tobytes()], pa.binary()),
            "winners": pa.ListArray.from_arrays(whole, winners), "sizes": pa.ListArray.from_arrays(whole, sizes),
        })

    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("hash", T.BinaryType()), T.StructField("digests", T.BinaryType()), T.StructField("winners", T.ArrayType(locator)), T.StructField("sizes", T.ArrayType(T.LongType()))])
    return _sharded(known, shards).groupBy("shard").applyInArrow(build, schema)


def lookup(index: DataFrame, batch: DataFrame, shards: int) -> DataFrame:
    """All groups, (digest, winner, size, known): the index's slots with the batch's copies counted in, and the batch's
    nonmembers. batch is (digest, winner, size), and index was built with as many shards."""
    schema = T.StructType([*batch.select("digest", "winner", "size").schema.fields, T.StructField("known", T.BooleanType())])

    def look(slots: pa.Table, new: pa.Table) -> pa.Table:
        rows = _matrix(new["digest"])
        member = np.zeros(len(rows), bool)
        parts = []
        if slots.num_rows:
            held = np.frombuffer(slots["digests"][0].as_buffer(), "<u8").reshape(-1, 4)
            slot = PerfectHash.unpack(slots["hash"][0].as_py())(rows)
            member = (slot >= 0) & (held[slot] == rows).all(1)
            sizes = slots["sizes"].combine_chunks().flatten().to_numpy(zero_copy_only=False).copy()
            sizes[slot[member]] += new["size"].to_numpy()[member]
            parts.append([_binary(held), slots["winners"].combine_chunks().flatten(), pa.array(sizes), pa.array(np.ones(len(held), bool))])
        if not member.all():
            rest = new.filter(pa.array(~member))
            parts.append([rest["digest"].combine_chunks(), rest["winner"].combine_chunks(), rest["size"].combine_chunks(), pa.array(np.zeros(rest.num_rows, bool))])
        return pa.Table.from_arrays([pa.chunked_array([p[i].cast(parts[0][i].type) for p in parts]) for i in range(4)], schema.names)

    return index.groupBy("shard").cogroup(_sharded(batch, shards).groupBy("shard")).applyInArrow(look, schema)


def assign(history: DataFrame, batch: DataFrame) -> DataFrame:
    """Each row of history and batch, (id, digest, at) as digests() gives them, with keep_id, group_size and kept."""
    n = [df.count() for df in (history, batch)]
    shards = shards_for(*n)
    index = cut(build_index(distinct(history), shards))
    groups = lookup(index, distinct(batch), shards)
    rows = history.withColumn("new", F.lit(False)).unionByName(batch.withColumn("new", F.lit(True)))
    kept = (F.col("at") == F.col("winner.at")) & (F.col("new") != F.col("known"))
    return rows.join(groups, "digest").select("id", "digest", "at", "new", F.col("winner.id").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"))


def remove_repeats(docs: DataFrame, index: DataFrame | None = None, shards: int = 1, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose text is new: not in the index, and the first of its kind here."""
    marked = cut(without(docs, "__at__").withColumn("__at__", F.monotonically_increasing_id()))
    rows = marked.select(F.col(f"`{id}`").alias("id"), F.unhex(F.sha2(F.encode(normalised(F.col(f"`{text}`")), "UTF-8"), 256)).alias("digest"), F.col("__at__").alias("at"))
    new = distinct(rows)
    if index is None:
        index = build_index(distinct(rows.limit(0)), shards)
    stay = lookup(index, new, shards).where(~F.col("known")).select(F.col("winner.at").alias("__at__"))
    return marked.join(stay, "__at__", "left_semi").drop("__at__")


def op13_perfect_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: those in the lower half of the range of ids are history, the others a batch that is held against it."""
    rows = digests(documents(spark, sf_dir))
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    old = F.coalesce(F.col("id") <= ((low or 0) + (high or 0)) // 2, F.lit(False))
    return assign(rows.where(old), rows.where(~old)).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP13_SQL = r"""
WITH digested AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
grouped AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM digested)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM grouped
"""
