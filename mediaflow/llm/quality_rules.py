"""Quality rules as a short-circuit cascade.

Every rule rejects a document by one measure of its text; a document is kept if no rule rejects it, so the order of the
rules changes only the work. A sample of about `sample_rows` documents (by a hash of the text, hence the same at every run)
gives each rule's cost and selectivity; rules then run by rejections per second, dearest last, and a document that a rule
has rejected is not measured again.

Words are runs of anything but space and \\t to \\r; lines are what \\n separates. Null texts are empty: no words, and
rejected as too short. Repeated rows are judged alike; other columns pass through, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaflow.llm.common import Words, documents, slices, text_or_empty, without

SYMBOLS = b"#*$%&|<>"


class Measures:
    """Measures of a column of texts, each made when first asked for; arrays with one number per text."""

    def __init__(self, texts: pa.Array):
        self.texts = text_or_empty(texts)

    def __len__(self) -> int:
        return len(self.texts)

    @cached_property
    def words(self) -> Words:
        return Words(self.texts, lower=False)

    def _per_text(self, marks: np.ndarray) -> np.ndarray:
        """How many marked bytes each text has."""
        return self._sum(marks, self.words.text_offsets)

    @staticmethod
    def _sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return run[bounds[1:]] - run[bounds[:-1]]

    @cached_property
    def n_words(self) -> np.ndarray:
        return self.words.counts.astype(np.int64)

    @cached_property
    def word_chars(self) -> np.ndarray:
        data = self.words.bytes
        return self._per_text((data & 0xC0) != 0x80) - self._per_text(_among(data, b" \t\n\x0b\x0c\r"))

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._per_text(_among(self.words.bytes, SYMBOLS))

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self._per_text((self.words.bytes >= 65) & (self.words.bytes <= 90))

    @cached_property
    def n_lower(self) -> np.ndarray:
        return self._per_text((self.words.bytes >= 97) & (self.words.bytes <= 122))

    @cached_property
    def n_bangs(self) -> np.ndarray:
        return self._per_text(self.words.bytes == 33)

    @cached_property
    def n_bare_words(self) -> np.ndarray:
        """Words without a letter (of ASCII, or any character beyond it)."""
        data = self.words.bytes
        letters = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128), dtype=np.int64)])
        starts, ends = self.words.starts, self.words.starts + self.words.lengths
        return self._sum(letters[ends] == letters[starts], self.words.bounds)

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the lines with a word: their text's number, and a code that equal lines share."""
        data, offsets = self.words.bytes, self.words.text_offsets
        starts = np.union1d(offsets[:-1], np.flatnonzero(data == 10) + 1)
        starts = starts[starts < len(data)]
        owner = np.searchsorted(offsets, starts, "right") - 1
        kept = data != 10
        rank = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])
        n_words = np.diff(np.searchsorted(self.words.starts, np.append(starts, len(data))))
        bounds = np.append(rank[starts], rank[-1]).astype(np.int32)
        array = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[kept]))])
        codes = array.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return owner[n_words > 0], codes[n_words > 0]

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self._lines[0], minlength=len(self))

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        owner, codes = self._lines
        distinct = pc.unique(pa.array(owner * (int(codes.max(initial=0)) + 1) + codes)).to_numpy() // (int(codes.max(initial=0)) + 1)
        return self.n_lines - np.bincount(distinct, minlength=len(self))

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words that lie in a 3-word window which its text has twice or more."""
        words = self.words
        codes = words.codes.astype(np.int64)
        if len(codes) < 3:
            return np.zeros(len(self), np.int64)
        owner = words.owners()
        n = len(words.dictionary)
        pairs = pa.array(codes[:-1] * n + codes[1:]).dictionary_encode()
        pair, n_pairs = pairs.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(pairs.dictionary)
        assert n * n_pairs * len(self) < 1 << 63
        at = np.flatnonzero(owner[:-2] == owner[2:])
        key = pa.array((owner[at] * n_pairs + pair[at]) * n + codes[at + 2]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        again = at[np.bincount(key)[key] > 1] if len(key) else at
        covered = np.zeros(len(codes), bool)
        for k in range(3):
            covered[again + k] = True
        return self._sum(covered, words.bounds)


def _among(data: np.ndarray, which: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(which)] = True
    return table[data]


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], np.ndarray]


#: Fixed values of the base verdict.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

BASE_RULES = (
    Rule("few_words", lambda m: m.n_words < MIN_WORDS),
    Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > MAX_REPEAT_PERCENT * m.n_words),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda m: 100 * m.n_symbols > 25 * m.n_words),
    Rule("upper_case", lambda m: 100 * m.n_upper > 40 * (m.n_upper + m.n_lower)),
    Rule("exclamations", lambda m: 100 * m.n_bangs > 25 * m.n_words),
    Rule("bare_words", lambda m: 100 * m.n_bare_words > 30 * m.n_words),
    Rule("repeated_lines", lambda m: 100 * m.n_dup_lines > 40 * m.n_lines),
    Rule("long_words", lambda m: m.word_chars > 20 * m.n_words),
)


def profile(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = 2000) -> dict[str, tuple[float, float]]:
    """By rule: seconds for a document, and the share it rejects, on the sample."""
    n = docs.count()
    some = docs.select(text)
    if n > sample_rows:
        some = some.where(F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(n)) < sample_rows)

    def measure(batches):
        for batch in batches:
            for part in slices(batch, text):
                rows = []
                for rule in rules:
                    began = time.perf_counter()
                    rejected = int(rule.rejects(Measures(part.column(text))).sum())
                    rows.append((rule.name, part.num_rows, rejected, time.perf_counter() - began))
                yield pa.RecordBatch.from_pylist([dict(zip(("rule", "n", "rejected", "seconds"), r, strict=True)) for r in rows])

    found = some.mapInArrow(measure, "rule string, n long, rejected long, seconds double").groupBy("rule").agg(F.sum("n"), F.sum("rejected"), F.sum("seconds")).collect()
    return {r[0]: (r[3] / r[1], r[2] / r[1]) for r in found if r[1]}


def order_rules(rules: tuple[Rule, ...], figures: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """By rejections per second, most first; ties and rules without figures by their given order."""

    def worth(rule: Rule) -> float:
        cost, share = figures.get(rule.name, (1.0, 0.0))
        return -share / max(cost, 1e-9)

    return tuple(sorted(rules, key=worth))


def cascade(texts: pa.Array, rules: tuple[Rule, ...], alive: np.ndarray | None = None) -> np.ndarray:
    """True for texts that no rule rejects. Rejected ones are left out of what later rules measure."""
    alive = np.ones(len(texts), bool) if alive is None else alive.copy()
    rows = np.flatnonzero(alive)
    measures = Measures(texts.take(pa.array(rows)) if len(rows) < len(texts) else texts)
    for rule in rules:
        left = np.flatnonzero(alive[rows])
        if not len(left):
            break
        if 4 * len(left) < 3 * len(rows):  # measured anew only when that leaves out enough
            rows = rows[left]
            measures = Measures(texts.take(pa.array(rows)))
        alive[rows[rule.rejects(measures)]] = False
    return alive


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", measured: bool = False, sample_rows: int = 2000, verdict: str = "kept") -> DataFrame:
    """docs with a boolean `verdict`; with `measured`, also the base measures of every document and `base_failed`."""
    ordered = order_rules(rules, profile(docs, rules, text, sample_rows))
    docs = without(docs, verdict, *([*BASE, "base_failed"] if measured else []))
    columns = docs.columns
    base_names = {r.name for r in BASE_RULES}

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                texts = text_or_empty(part.column(text))
                more, names = [], []
                if measured:
                    m = Measures(texts)
                    failed = np.logical_or.reduce([r.rejects(m) for r in BASE_RULES])
                    more = [*(pa.array(getattr(m, c).astype(np.int64)) for c in BASE), pa.array(failed)]
                    names = [*BASE, "base_failed"]
                    kept = cascade(texts, tuple(r for r in ordered if r.name not in base_names), ~failed)
                else:
                    kept = cascade(texts, ordered)
                yield pa.RecordBatch.from_arrays([*part.columns, *more, pa.array(kept)], [*columns, *names, verdict])

    extra = [T.StructField(c, T.LongType()) for c in BASE] + [T.StructField("base_failed", T.BooleanType())] if measured else []
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *extra, T.StructField(verdict, T.BooleanType())]))


def keep_good(docs: DataFrame, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    verdict = "__kept__"
    return judge(docs, text=text, sample_rows=sample_rows, verdict=verdict).where(verdict).drop(verdict)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and the cascade's verdict for every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return judge(docs, measured=True).select("doc_id", *BASE, "base_failed", "kept")


#: The same verdict in SQL, all rules at once.
OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id, text) AS r FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d),
t AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM t) WHERE n > 1),
cover AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
l AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(ls) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT w.r, doc_id, len(ws) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
         length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs,
         len(list_filter(ws, lambda x: NOT regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) AS n_bare
  FROM w LEFT JOIN l USING (r) LEFT JOIN cover USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 25 * n_words OR 100 * n_upper > 40 * (n_upper + n_lower) OR 100 * n_bangs > 25 * n_words
            OR 100 * n_bare > 30 * n_words OR 100 * n_dup_lines > 40 * n_lines OR word_chars > 20 * n_words) AS kept
FROM b
"""
