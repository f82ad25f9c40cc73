"""Fill-in-middle transformation: each text is cut into a prefix, a middle and a suffix, which are put in another order.

The work is a pipeline of Arrow arrays. A batch's texts become lists of units; the lists are flattened beside the index of
their parents; a unit's ordinal in its text and the text's two cuts give its role; the units of one role are filtered out and
built into lists again, which binary_join turns into the pieces of all texts of the batch. Units are code points, or lines.

Forms: `psm` is `<P>`prefix`<S>`suffix`<M>`middle, `spm` is `<S>`suffix`<P>`prefix`<M>`middle, `plain` is the text itself.

A null text counts as empty. Empty texts are plain, and so are texts that contain one of the marks; hence a mark in another
form's output is always the transformation's own, and `restore` gives back the exact text. A null id draws as an empty one.
Rows are independent: repeated rows give repeated outputs, rows of one id draw the same numbers, an empty table gives none.
Long texts: at most `SPAN` octets are taken apart at a time, a longer text's pieces being joined from those of its spans.
Columns of docs that have an output's name are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaflow.llm.common import documents, slices, text_or_empty, without

#: The marks before prefix, suffix and middle.
MARKS = P, S, M = "<P>", "<S>", "<M>"
#: Of a hundred texts, so many are transformed, and of those so many have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Octets of text that are taken apart into units at a time.
SPAN = 1 << 20
DRAWS = ["__h1__", "__h2__", "__h3__", "__h4__"]


def draws(key, seed: int = 1) -> list:
    """Four 32-bit numbers a row: the first groups of eight hex digits of the SHA-256 of `seed:key`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(name) for i, name in enumerate(DRAWS)]


def unit_starts(data: np.ndarray, unit: str) -> np.ndarray:
    """Which octets of UTF-8 text start a unit (a text's first one always does)."""
    if unit == "character":
        return (data & 0xC0) != 0x80
    if unit == "line":
        return np.concatenate([[True], data[:-1] == 10])[: len(data)]
    raise ValueError(f"no such unit: {unit}")


def spans(texts: pa.Array, unit: str, most: int | None = None):
    """(texts of one run of spans, the row each belongs to, the ordinal of its first unit), and then the units of each row.

    A span is a whole text, or a stretch of a long one that starts and ends at borders of units."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    most = most or SPAN
    starts, counts = [], []
    for row in range(len(texts)):
        at = int(offsets[row])
        end, ordinal = int(offsets[row + 1]), 0
        while end - at > most:
            own = unit_starts(data[at : at + most + 4], unit)
            own[0] = True
            last = np.flatnonzero(own[: most + 1])[-1]
            if last == 0:  # one unit longer than a span
                more = np.flatnonzero(unit_starts(data[at:end], unit)[1:])
                last = int(more[0]) + 1 if len(more) else end - at
                if last == end - at:
                    break
            starts.append((row, at, at + int(last), ordinal))
            ordinal += int(own[:last].sum())
            at += int(last)
        starts.append((row, at, end, ordinal))
        own = unit_starts(data[at:end], unit)
        counts.append(ordinal + (int(own[1:].sum()) + 1 if end > at else 0))
    return np.array(starts, np.int64).reshape(-1, 4), np.array(counts, np.int64)


def units(data: np.ndarray, unit: str, starts: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """Lists of the units of data[starts[i]:ends[i]]; these stretches follow one another."""
    low, high = int(starts[0]), int(ends[-1])
    part = data[low:high]
    mask = unit_starts(part, unit)
    mask[(starts - low)[starts < ends]] = True
    at = np.flatnonzero(mask)
    values = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, high - low).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(part)))
    bounds = np.searchsorted(at, np.append(starts, high) - low)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def pieces(texts: pa.Array, unit: str, first: np.ndarray, second: np.ndarray, cuts: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of each text: its units before `first`, from there to before `second`, and the rest."""
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    joined = [[], [], []]
    at = 0
    while at < len(cuts):
        stop = max(at + 1, int(np.searchsorted(cuts[:, 2], cuts[at, 1] + SPAN, "right")))
        rows, starts, ends, base = cuts[at:stop].T
        lists = units(data, unit, starts, ends)
        flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        ordinals = np.arange(len(flat)) - lists.offsets.to_numpy()[parents] + base[parents]
        role = (ordinals >= first[rows][parents]).astype(np.int8) + (ordinals >= second[rows][parents])
        for i in range(3):
            mine = role == i
            bounds = np.concatenate([[0], np.cumsum(np.bincount(parents[mine], minlength=len(rows)))])
            again = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat.filter(pa.array(mine)))
            joined[i].append(pc.binary_join(again, ""))
        at = stop
    of_text = pa.array(np.searchsorted(cuts[:, 0], np.arange(len(texts) + 1)), pa.int32())
    return [pc.binary_join(pa.ListArray.from_arrays(of_text, pa.concat_arrays(x)), "") for x in joined]


def transformed(texts: pa.Array, h: list[np.ndarray], unit: str, rate: int, suffix_first: int) -> list[pa.Array]:
    """n, form, prefix units, middle units and output of each text, given its four numbers."""
    cuts, n = spans(texts, unit)
    first, second = np.minimum(h[0] % (n + 1), h[1] % (n + 1)), np.maximum(h[0] % (n + 1), h[1] % (n + 1))
    marked = np.zeros(len(texts), bool)
    for mark in MARKS:
        marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (h[2] % 100 >= rate)
    form = np.where(plain, 0, np.where(h[3] % 100 < suffix_first, 2, 1))
    prefix, middle, suffix = pieces(texts, unit, first, second, cuts)
    psm = pc.binary_join_element_wise(P, prefix, S, suffix, M, middle, "")
    spm = pc.binary_join_element_wise(S, suffix, P, prefix, M, middle, "")
    output = pc.choose(pa.array(form), texts, psm, spm)
    number = lambda x: pa.array(x, pa.int64(), mask=plain)
    return [pa.array(n, pa.int64()), pa.array(["plain", "psm", "spm"]).take(pa.array(form)), number(first), number(second - first), output]


def restored(outputs: pa.Array, form: pa.Array) -> pa.Array:
    """The texts that gave these outputs: what lies between the marks, in its first order."""
    is_plain, is_spm = pc.equal(form, "plain"), pc.equal(form, "spm")
    blank = pc.if_else(is_plain, f"{P}{S}{M}", outputs)  # so that every row splits in three

    def part(column: pa.Array, mark: str, i: int) -> pa.Array:
        return pc.list_element(pc.split_pattern(column, mark, max_splits=1), i)

    inner, middle = part(blank, M, 0), part(blank, M, 1)
    a, b = part(inner, S, 0), part(inner, S, 1)  # psm: `<P>`prefix and suffix; spm: nothing, and suffix`<P>`prefix
    prefix = pc.if_else(is_spm, part(pc.if_else(is_spm, b, P), P, 1), part(pc.if_else(is_spm, P, a), P, 1))
    suffix = pc.if_else(is_spm, part(b, P, 0), b)
    return pc.if_else(is_plain, outputs, pc.binary_join_element_wise(prefix, middle, suffix, ""))


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", unit: str = "character", seed: int = 1, rate: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with n (units of `text`), form, prefix_units, middle_units (null if plain) and output."""
    docs = without(docs, "n", "form", "prefix_units", "middle_units", "output", *DRAWS)
    columns = docs.columns
    more = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_units", T.LongType()), T.StructField("middle_units", T.LongType()), T.StructField("output", T.StringType())]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                h = [part.column(x).to_numpy() for x in DRAWS]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *transformed(text_or_empty(part.column(text)), h, unit, rate, suffix_first)], [*columns, *(f.name for f in more)])

    return docs.select("*", *draws(F.col(f"`{key}`"), seed)).mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def restore(df: DataFrame, output: str = "output", form: str = "form", restored_as: str = "restored") -> DataFrame:
    """df with the exact text that `output` was made of, told from `output` and `form` alone; a null output restores to an empty text."""
    df = without(df, restored_as)
    columns = df.columns

    def run(batches):
        for batch in batches:
            for part in slices(batch, output):
                yield pa.RecordBatch.from_arrays([*part.columns, restored(text_or_empty(part.column(output)), pc.fill_null(part.column(form), "plain"))], [*columns, restored_as])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(restored_as, T.StringType())]))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed and restored, both digested."""
    made = restore(transform(documents(spark, sf_dir).select("doc_id", "text")).drop("text"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


OP12_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id::VARCHAR) AS d FROM documents
), cut AS (
  SELECT *, ('0x' || substr(d, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(d, 9, 8))::BIGINT % (n + 1) AS y,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(d, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || substr(d, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), three AS (
  SELECT *, t[1:least(x, y)] AS prefix, t[least(x, y) + 1:greatest(x, y)] AS middle, t[greatest(x, y) + 1:] AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(x, y) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(x, y) - least(x, y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM three
"""
