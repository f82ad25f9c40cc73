"""Payload formats: a registry of depacketizers, redundant audio, H.264 units, G.711 levels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaflow.functions.bits import be
from mediaflow.operators.walkers import Octets, Together, aac_units, h264_nals, red_blocks, walk, walk_together

#: Formats whose payloads are walked together, a batch at a time.
TOGETHER: dict[str, tuple[Together, str]] = {
    "red": (red_blocks, "idx int, block_pt int, ts_offset int, part binary"),
    "h264": (h264_nals, "idx int, nal_type int, is_start boolean, is_end boolean, part binary"),
}
#: Format → (walker over one payload, schema of its parts); register() adds to it.
FORMATS: dict[str, tuple[Callable[[bytes], list[tuple]], str]] = {
    "generic": (lambda data: [(0, data)], "idx int, part binary"),
    "aac": (aac_units, "idx int, au_index int, size int, part binary"),
}


def register(name: str, walker: Callable[[bytes], list[tuple]], schema: str) -> None:
    FORMATS[name] = (walker, schema)


def depacketize(df: DataFrame, name: str, payload: str = "payload", keep: tuple[str, ...] = (), formats: dict | None = None) -> DataFrame:
    """keep and the parts of each payload of a format: one of `formats` (the registered ones, unless given), or one of TOGETHER."""
    found = FORMATS if formats is None else formats
    if name in found:
        return walk(df, *found[name], payload, keep)
    return walk_together(df, *TOGETHER[name], payload, keep)


def red_pack(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, payload: the group's blocks (block_pt, ts_offset, part), oldest first, as one redundant payload; offset 0 is primary."""
    grouped = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("ts_offset")).alias("o"), "block_pt", F.hex("part").alias("h")))).alias("b"))
    size = lambda b: F.length(b["h"]) / 2
    older = F.filter("b", lambda b: b["o"] != 0)
    head = F.array_join(F.transform(older, lambda b: F.hex(be((b["block_pt"].cast("long") + 128) * (1 << 24) - b["o"] * 1024 + size(b), 4))), "")
    last = F.hex(be(F.element_at("b", -1)["block_pt"], 1))
    return grouped.select(*keys, F.unhex(F.concat(head, last, F.array_join(F.transform("b", lambda b: b["h"]), ""))).alias("payload"))


def key_frames(nals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, is_key (an IDR unit, type 5), nal_types of each frame."""
    return nals.groupBy(*keys).agg(F.bool_or(F.col("nal_type") == 5).alias("is_key"), F.sort_array(F.collect_set("nal_type")).alias("nal_types"))


def g711_table(law: str) -> np.ndarray:
    """The 256 linear samples of a law ("mu" or "a"), by its rule."""
    code = np.arange(256)
    if law == "mu":
        code = ~code & 0xFF
        step = ((code & 15) * 8 + 132) << (code >> 4 & 7)
        return np.where(code & 128, 132 - step, step - 132).astype(np.int16)
    code = code ^ 0x55
    exponent, mantissa = code >> 4 & 7, (code & 15) * 16
    step = np.where(exponent == 0, mantissa + 8, (mantissa + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, step, -step).astype(np.int16)


def g711_levels(df: DataFrame, keys: list[str], payload: str = "payload", pt: str = "pt") -> DataFrame:
    """keys, samples, peak, rms (null without samples) of G.711 payloads (type 0 µ-law, 8 A-law)."""
    tables = np.stack([g711_table("mu"), g711_table("a")]).astype(np.int64)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = Octets(batch.column(payload))
            n = x.ends - x.starts
            law = np.repeat((batch.column(pt).to_numpy(zero_copy_only=False) == 8).astype(np.int64), n)
            samples = tables[law, x.data[x.starts[0] : x.ends[-1]] if len(n) else x.data[:0]]
            some = n > 0  # reduceat gives an element, not nothing, for an empty run
            peak, squares = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            if some.any():
                at = (x.starts - x.starts[0])[some]
                peak[some], squares[some] = np.maximum.reduceat(np.abs(samples), at), np.add.reduceat(samples * samples, at)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(n), pa.array(peak), pa.array(squares)], [*keys, "n", "peak", "squares"])

    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(c, T.LongType()) for c in ("n", "peak", "squares"))])
    m = df.where(F.col(pt).isin(0, 8)).select(*keys, payload, pt).mapInArrow(measure, schema)
    return m.groupBy(*keys).agg(F.sum("n").alias("samples"), F.max("peak").cast("int").alias("peak"), F.sqrt(F.try_divide(F.sum("squares"), F.sum("n"))).alias("rms"))
