"""Shared helpers: cutting lineage in the shared folder, and splitting Arrow text columns into coded words."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaflow.functions.storage import new_folder

# memory that Arrow frees goes back to the system, so that idle Python workers stay small
pa.set_memory_pool(pa.system_memory_pool())
# and so does what numpy frees: arrays of a megabyte or more are mapped on their own (-3: the C library's name for that bound)
getattr(ctypes.CDLL(None), "mallopt", lambda *_: None)(-3, 1 << 20)

#: Words are runs of anything but these six bytes.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def cut(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_folder(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(*frames: DataFrame) -> None:
    """Removes what cut() wrote, once nothing reads it any more."""
    for df in frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def without(docs: DataFrame, *names: str) -> DataFrame:
    """docs without columns of these names (in any letter case): those that an operator is about to add take their place."""
    taken = {n.lower() for n in names}
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(column: str, n: int):
    """crc32 of the column's decimal text, modulo n (a null counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def text_or_empty(column: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    column = pc.fill_null(column, "") if column.null_count else column
    return pa.concat_arrays([column]) if column.offset else column


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20):
    """The batch in runs of rows with at most `most` bytes of text each (a longer text stands alone)."""
    sizes = np.fromiter((0 if x is None else x for x in _byte_lengths(batch.column(column))), np.int64, batch.num_rows)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _byte_lengths(column):
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


class Words:
    """The words of a column of texts: `codes` into `dictionary` (a string array), `bounds[i]:bounds[i + 1]` those of text i."""

    def __init__(self, texts: pa.Array, lower: bool):
        texts = text_or_empty(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1) if len(texts) else np.zeros(1, np.int32)
        raw = texts.buffers()[2] if len(texts) else None
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
        offsets = offsets.astype(np.int64) - offsets[0]
        self.bytes, self.text_offsets = data, offsets
        if lower:
            data = _LOWER[data]
        inside = ~_IS_SPACE[data]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        at = offsets[:-1][offsets[:-1] < offsets[1:]]
        start[at] = inside[at]  # a text's first byte starts a word whatever ends the text before
        starts = np.flatnonzero(start)
        self.starts = starts
        self.bounds = np.searchsorted(starts, offsets)
        kept = data[inside]
        rank = np.cumsum(inside, dtype=np.int64)
        ends = np.empty(len(starts) + 1, np.int32)
        ends[:-1] = rank[starts] - 1
        ends[-1] = len(kept)
        array = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(kept)))
        coded = array.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.dictionary = coded.dictionary
        self.lengths = np.diff(ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owners(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] … starts[i] + lengths[i] - 1 for all i in turn."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
