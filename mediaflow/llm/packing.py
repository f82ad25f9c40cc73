"""Packing by the dot-product heuristic of vector bin packing.

A piece of a document weighs (tokens, 1 segment, loss-bearing tokens); a sequence holds at most `max_tokens`,
`max_segments` and `max_loss` of them. Without `max_segments` (None) only the tokens bound the segments. Which tokens bear loss a column says (`loss`): how many of the text's last tokens, the
end id among them; null or no column means all. The open sequence takes, among the waiting pieces that fit, the one whose weight has
the largest dot product with the room that is left, all as parts of the limits. When none fits and more than `slack` tokens
of room are left, the longest waiting piece is cut to fill it (`cut=False` forbids that, and then a longer document alone is
cut, at the limits). A sequence short of the limit at the end of a task is cut into runs whose lengths are powers of two,
which need no padding.

Each task packs the rows of its own partition and hands on finished sequences, holding at most `window` tokens: nothing is
shuffled, and a task that runs again over the same rows gives the same sequences. Read the documents from stored files, or
order them within partitions, where that must hold. `sequence_id` is the partition's number times 2^32 plus a count. Null
texts are empty documents: one piece that holds the end id alone. Repeated ids are packed as documents of their own; equal weights
are taken in the order in which they came, last first. An empty table gives no rows. The result has the key's column and its own,
no other of docs.
"""

from __future__ import annotations

import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from mediaflow.llm.bpe import Encoder, tokenizer_path
from mediaflow.llm.common import documents, slices

MAX_TOKENS, END_ID = 4096, 2


class Packer:
    """Packs pieces (row, start, length, loss) that arrive in any order. take() yields (sequence, [pieces])."""

    def __init__(self, max_tokens=MAX_TOKENS, max_segments=None, max_loss=MAX_TOKENS, cut=True, slack=4):
        self.limits = np.array([max_tokens, max_segments or max_tokens, max_loss], float)  # a segment has a token at least
        self.cut, self.slack = cut, slack
        self.kinds: dict[tuple[int, int], list] = {}  # (tokens, loss) → waiting pieces
        self.order: list[tuple[int, int]] = []
        self.weights = None
        self.held = self.sequences = 0

    def add(self, piece: tuple) -> None:
        kind = (piece[2], piece[3])
        if kind not in self.kinds:
            self.kinds[kind] = []
            insort(self.order, kind)
            self.weights = None
        self.kinds[kind].append(piece)
        self.held += piece[2]

    def _pop(self, at: int) -> tuple:
        kind = self.order[at]
        waiting = self.kinds[kind]
        piece = waiting.pop()
        if not waiting:
            del self.kinds[kind]
            del self.order[at]
            self.weights = np.delete(self.weights, at, 0)
        self.held -= piece[2]
        return piece

    def _table(self) -> np.ndarray:
        if self.weights is None or len(self.weights) != len(self.order):
            self.weights = np.array([(t, 1, loss) for t, loss in self.order], float).reshape(-1, 3)
        return self.weights

    def fill(self) -> list[tuple]:
        """One sequence: empty if nothing waits."""
        room, chosen = self.limits.copy(), []
        while self.order and room[0] >= 1 and room[1] >= 1:
            table = self._table()
            fits = np.flatnonzero((table <= room).all(1))
            if len(fits):
                score = (table[fits] / self.limits) @ (room / self.limits)
                at = int(fits[int(score.argmax())])
                piece = self._pop(at)
            elif self.cut and room[0] > self.slack:
                tokens, loss = self.order[-1]
                most = int(min(room[0], tokens - 1, tokens - loss + room[2]))  # cut where the loss still fits
                if most < 1:
                    break
                piece = self._pop(len(self.order) - 1)
                row, start, length, loss = piece
                first = self._loss(piece, most)
                self.add((row, start + most, length - most, loss - first))
                piece = (row, start, most, first)
            else:
                break
            chosen.append(piece)
            room -= (piece[2], 1, piece[3])
        return chosen

    @staticmethod
    def _loss(piece: tuple, head: int) -> int:
        """Loss-bearing tokens of the first `head`: documents bear loss everywhere, or at their end."""
        _, _, length, loss = piece
        return max(0, head - (length - loss))


def binary_runs(pieces: list[tuple]) -> list[list[tuple]]:
    """The pieces of one short sequence as runs whose lengths are powers of two, longest first."""
    left = sum(p[2] for p in pieces)
    runs, run, room = [], [], 0
    queue = pieces[::-1]
    while queue:
        if room == 0:
            room = 1 << (left.bit_length() - 1)
        row, start, length, loss = queue.pop()
        take = min(room, length)
        first = Packer._loss((row, start, length, loss), take)
        run.append((row, start, take, first))
        if take < length:
            queue.append((row, start + take, length - take, loss - first))
        room, left = room - take, left - take
        if room == 0:
            runs.append(run)
            run = []
    return runs


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS, max_segments: int | None = None, max_loss: int = MAX_TOKENS, end_id: int = END_ID, window: int = 6_000_000, cut: bool = True, slack: int = 4, with_ids: bool = False, loss: str | None = None) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset (and `ids`, packed)."""
    fields = [("start", T.LongType(), pa.int64()), ("length", T.LongType(), pa.int64()), ("ids_crc32", T.LongType(), pa.int64()), ("doc_tokens", T.LongType(), pa.int64()), ("loss_tokens", T.LongType(), pa.int64()), ("sequence_id", T.LongType(), pa.int64()), ("offset", T.LongType(), pa.int64())]
    if with_ids:
        fields.append(("ids", T.BinaryType(), pa.binary()))

    def run(batches):
        encoder = Encoder(tokenizer)
        base = TaskContext.get().partitionId() << 32
        packer = Packer(max_tokens, max_segments, max_loss, cut, slack)
        ids: dict[int, tuple] = {}  # row → key, its ids, tokens that wait
        rows = []
        n = 0

        def place(pieces):
            offset = 0
            for row, start, length, loss in pieces:
                name, own, left = ids[row]
                raw = own[start : start + length].tobytes()
                rows.append((name, start, length, zlib.crc32(raw), len(own), loss, base + packer.sequences, offset, *([raw] if with_ids else [])))
                offset += length
                if left == length:
                    del ids[row]
                else:
                    ids[row] = (name, own, left - length)
            packer.sequences += 1

        def out():
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, f[2]) for c, f in zip(columns[1:], fields, strict=True))], [key, *(f[0] for f in fields)])

        kind = pa.int64()
        for batch in batches:
            kind = batch.column(key).type
            for part in slices(batch, text):
                flat, bounds = encoder(part.column(text))
                flat = flat.astype("<u4")
                tails = part.column(loss).to_pylist() if loss else [None] * part.num_rows
                for name, a, b, tail in zip(part.column(key).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), tails, strict=True):
                    own = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
                    ids[n] = (name, own, len(own))
                    bare = 0 if tail is None else len(own) - max(0, min(tail, len(own)))  # tokens before the loss
                    start = 0
                    while start < len(own):
                        length = min(max_tokens, len(own) - start, max(0, bare - start) + max_loss)
                        piece = (n, start, length, max(0, start + length - max(start, bare)))
                        start += length
                        if piece[2] == max_tokens:
                            place([piece])
                        else:
                            packer.add(piece)
                    n += 1
                while packer.held > window // 2:
                    place(packer.fill())
                if len(rows) > 4096:
                    yield out()
        while packer.order:
            pieces = packer.fill()
            total = sum(p[2] for p in pieces)
            for run_ in [pieces] if packer.order or max_tokens - total <= slack else binary_runs(pieces):
                place(run_)
        if rows:
            yield out()

    schema = T.StructType([docs.schema[key], *(T.StructField(name, kind) for name, kind, _ in fields)])
    return docs.select(key, text, *([loss] if loss else [])).mapInArrow(run, schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack(documents(spark, sf_dir), tokenizer_path())
