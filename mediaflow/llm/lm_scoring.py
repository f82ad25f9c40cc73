"""Language-model scores by online logistic context mixing.

Tokens are words (runs of anything but space and \\t to \\r, A-Z lowered) and one end per text. All training texts are counted.
The frequent words, the end and an escape for all other words are symbols. A symbol's code starts with the first DEPTH binary
digits of its place in the cumulative distribution of symbols (its class), and goes on by a Huffman code among those of its class, so
that codes are whole and take few bits. All bits are predicted, in the order of the text:
  * Predictors: the symbols' own shares, and counters of both bits under hashed contexts: the previous word, the classes (codes)
    of the last three, and the word before the previous. Every token of every training text is counted.
  * Mixer: predictions are added in the logistic domain with weights from two sets, one chosen by how much the previous word's and
    the classes' counters have seen, one by the bit's place and what the third has seen. They learn online: each run of tokens is
    predicted before it is counted. Tasks learn on their shares of the texts, and their weights are averaged.
  * Refinement: an adaptive map from (bit's place, prediction) to what came true, averaged with the prediction.
After an escape, a word seen c times of the R
escaped ones has (c - D) / (R + 1), and what the discount D frees is spread by a model of the same kind that spells new words by
byte bits, learnt from all distinct training words. All parts are probabilities, so the score of a text is the log10 probability
of its tokens in their order, and bits per byte follow.

Words are joined to their probabilities: the frequent ones (at most `frequent_words`) are broadcast, rarer ones are shuffled, so
no hot word meets a single task. The tables of counters grow with the tokens, up to 2^TABLE_BITS slots a context (and 2^22 for
spelling), which bounds what is broadcast; beyond, contexts share slots. How the input is split into tasks is part of the
mixer's weights. Null and empty texts have the end alone. Repeated rows and ids count and score one by one. Without training
texts all tokens are spelled by an unlearnt model; an empty table gives an empty one. Other columns aren't returned.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaflow.llm.bpe import frequent
from mediaflow.llm.common import Words, crc_mod, cut, documents, drop_cut, ragged, slices

DISCOUNT, FREQUENT_WORDS = 0.75, 1 << 17
ORDERS = 5
SPACE, END = 0x20, 0x0A
BLOCK = 4096
#: First bits of a symbol's code (its class), slots of a context's counters (as a power of two), tokens to a step, octets of text to a task.
DEPTH, TABLE_BITS, STEP_TOKENS, TASK_OCTETS = 5, 21, 8192, 64 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _stretch(n0, n1):
    return np.log((n1 + 0.4) / (n0 + 0.4))


class Spelling:
    """The bytes of a batch of words, each with its terminator, and their contexts."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        self.data = np.frombuffer(b"".join(w + b" " for w in words), np.uint8)
        lengths = np.fromiter((len(w) + 1 for w in words), np.int64, self.n)
        self.starts = np.cumsum(lengths) - lengths
        self.pos = np.arange(len(self.data)) - np.repeat(self.starts, lengths)
        b = self.data.astype(np.uint64) + np.uint64(1)
        back = [np.zeros_like(b) for _ in range(6)]
        for k in range(1, 6):
            back[k][k:] = np.where(self.pos[k:] >= k, b[:-k], 0)
        powers = np.cumprod(np.full(int(lengths.max(initial=1)), _A, np.uint64))
        run = np.cumsum(b * powers[self.pos], dtype=np.uint64)
        before = np.concatenate([[np.uint64(0)], run[:-1]]).astype(np.uint64)
        whole = before - np.repeat(before[self.starts], lengths)
        two = back[1] | back[2] << np.uint64(9)
        three = two | back[3] << np.uint64(18)
        five = three | back[4] << np.uint64(27) | back[5] << np.uint64(36)
        place = self.pos.astype(np.uint64)
        self.contexts = [back[1], two, three, five, whole + place * _B]

    def bits(self):
        """For k from 0 to 7: the byte's first k bits (with a leading one) and its next bit."""
        for k in range(8):
            yield (self.data >> (8 - k) if k else np.zeros_like(self.data)).astype(np.int64) | 1 << k, (self.data >> (7 - k) & 1).astype(np.int64)


class Model:
    def __init__(self, bits: int, tables: np.ndarray | None = None):
        self.bits = bits
        self.tables = np.zeros((2, ORDERS, 1 << bits), np.float32) if tables is None else tables
        self.by_count = np.full((64, ORDERS), 0.15)
        self.by_place = np.full((64, ORDERS), 0.15)
        self.map = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, 33))), (256, 1))

    def slots(self, context: np.ndarray, order: int, node: np.ndarray) -> np.ndarray:
        h = (context + np.uint64(order + 1)) * _A
        h = (h ^ (h >> np.uint64(29)) ^ node.astype(np.uint64) * _B) * _A
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def count(self, spelling: Spelling) -> None:
        for node, bit in spelling.bits():
            for order, context in enumerate(spelling.contexts):
                at = self.slots(context, order, node)
                for value in (0, 1):
                    np.add.at(self.tables[value, order], at[bit == value], np.float32(1))

    def _inputs(self, spelling: Spelling, own: float):
        """own: counts to leave out of each predictor, those of the word itself."""
        for k, (node, bit) in enumerate(spelling.bits()):
            x = np.empty((ORDERS, len(node)))
            seen = []
            for order, context in enumerate(spelling.contexts):
                at = self.slots(context, order, node)
                n0, n1 = self.tables[0, order, at].astype(float), self.tables[1, order, at].astype(float)
                if own:
                    n0, n1 = np.maximum(n0 - own * (1 - bit), 0), np.maximum(n1 - own * bit, 0)
                x[order] = _stretch(n0, n1)
                seen.append(n0 + n1)
            level = lambda n: np.minimum(np.log2(n + 1).astype(np.int64), 7)
            yield node, bit, np.clip(x, -8, 8), level(seen[4]) * 8 + level(seen[3]), np.minimum(spelling.pos, 7) * 8 + k

    def _mixed(self, x, g, h):
        z = np.clip(((self.by_count[g] + self.by_place[h]).T * x).sum(0), -12, 12)
        return z, 1 / (1 + np.exp(-z))

    @staticmethod
    def _cell(z):
        return np.rint((np.clip(z, -8, 8) + 8) * 2).astype(np.int64)

    def learn(self, spelling: Spelling, rate: float, own: float = 1.0) -> None:
        """One online step on a batch of words; own: how often the tables have each of them."""
        for node, bit, x, g, h in self._inputs(spelling, own):
            z, p = self._mixed(x, g, h)
            error = bit - p
            for weights, gate in ((self.by_count, g), (self.by_place, h)):
                n = np.bincount(gate, minlength=64)
                for k in range(ORDERS):
                    weights[:, k] += rate * np.bincount(gate, error * x[k], minlength=64) / np.maximum(n, 20)
            cell = node * 33 + self._cell(z)
            n, hits = np.bincount(cell, minlength=256 * 33), np.bincount(cell, bit, minlength=256 * 33)
            flat = self.map.reshape(-1)
            flat += n / (n + 50) * (np.divide(hits, np.maximum(n, 1)) - flat) * (n > 0)

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word's spelling, its terminator included."""
        if not words:
            return np.zeros(0)
        spelling = Spelling(words)
        total = np.zeros(len(spelling.data))
        for node, bit, x, g, h in self._inputs(spelling, 0.0):
            z, p = self._mixed(x, g, h)
            p = np.clip((p + self.map[node, self._cell(z)]) / 2, 1e-5, 1 - 1e-5)
            total += np.log10(np.where(bit == 1, p, 1 - p))
        return np.add.reduceat(total, spelling.starts)


def _runs(words: list[bytes], most: int = 60_000):
    """Runs of words of about `most` bytes."""
    run, size = [], 0
    for w in words:
        run.append(w)
        size += len(w) + 1
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def token_counts(docs: DataFrame, most: int = 500_000) -> DataFrame:
    """(word, c, n): occurrences in the texts marked `train`, and in all. docs: text, train."""

    def tally(batches):
        held: dict[str, list[int]] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array([v[k] for v in held.values()], pa.int64()) for k in (0, 1))], ["word", "c", "n"])

        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), lower=True)
                train = part.column("train").to_numpy(zero_copy_only=False)[words.owners()]
                n = np.bincount(words.codes, minlength=len(words.dictionary))
                c = np.bincount(words.codes[train], minlength=len(words.dictionary))
                for word, x, y in zip(words.dictionary.to_pylist(), c.tolist(), n.tolist(), strict=True):
                    if word in held:
                        held[word][0] += x
                        held[word][1] += y
                    else:
                        held[word] = [x, y]
                if len(held) > most:
                    yield out()
                    held = {}
        yield out()

    return docs.select("text", "train").mapInArrow(tally, "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def gather(counts: DataFrame, n_types: int, words_in_task: int = 250_000) -> Model:
    """The model learnt from all distinct training words (counts with c > 0)."""
    bits = min(22, max(14, math.ceil(math.log2(n_types / 4 + 1))))
    tasks = min(64, max(1, n_types // words_in_task))
    # dealt by the word, so that what a task holds never changes
    seen = counts.where("c > 0").select("word").repartition(tasks, "word")

    def count(batches):
        model, steps = Model(bits), 0
        for batch in batches:
            for run in _runs(batch.column("word").cast(pa.binary()).to_pylist()):
                spelling = Spelling(run)
                model.learn(spelling, 0.5 / (1 + steps / 10), 0.0)
                model.count(spelling)
                steps += 1
        if steps:
            yield from blocks_of(model.tables)
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([np.concatenate([[steps], model.by_count.ravel(), model.by_place.ravel(), model.map.ravel()]).tobytes()], pa.binary())], ["block", "data"])

    # the order of words decides the weights, and must be the same when a task runs again
    tables, learnt = gathered(seen.sortWithinPartitions(F.xxhash64("word"), "word").mapInArrow(count, "block int, data binary"), (2, ORDERS, 1 << bits))
    model = Model(bits, tables)
    if learnt is not None:
        model.by_count, model.by_place, model.map = np.split(learnt[1:], [64 * ORDERS, 128 * ORDERS])
        model.by_count, model.by_place, model.map = model.by_count.reshape(64, ORDERS), model.by_place.reshape(64, ORDERS), model.map.reshape(256, 33)
    return model


def blocks_of(tables: np.ndarray):
    """Counters as rows (block, data) of BLOCK cells, two bytes each. Counts beyond two bytes are halved with their counterparts."""
    cells = tables.reshape(2, -1, BLOCK)
    for start in range(0, cells.shape[1], 256):
        part = cells[:, start : start + 256]
        times = np.maximum(1.0, part.max(0, keepdims=True) / 65000)
        packed = np.rint(part / times).astype("<u2")
        some = np.flatnonzero(packed.any((0, 2)))
        yield pa.RecordBatch.from_arrays([pa.array(some + start, pa.int32()), pa.array([packed[:, i].tobytes() for i in some], pa.binary())], ["block", "data"])


def gathered(rows: DataFrame, shape: tuple) -> tuple[np.ndarray, np.ndarray | None]:
    """The sum of the tasks' counters, and the mean of their weights (rows of block -1: steps, weights) by steps."""

    def add(key, table):
        block, found = key[0].as_py(), table.column("data").to_pylist()  # one from each task
        if block < 0:
            each = np.array(sorted(np.frombuffer(x, np.float64).tolist() for x in found))
            data = ((each * each[:, :1]).sum(0) / each[:, 0].sum()).tobytes()
        else:
            total = np.zeros(2 * BLOCK)
            for x in found:
                total += np.frombuffer(x, "<u2")
            total = total.reshape(2, BLOCK)
            data = np.rint(total / np.maximum(1.0, total.max(0) / 65000)).astype("<u2").tobytes()
        return pa.table({"block": pa.array([block], pa.int32()), "data": pa.array([data], pa.binary())})

    tables, weights = np.zeros(shape, np.float32), None
    cells = tables.reshape(2, -1, BLOCK)
    for r in rows.groupBy("block").applyInArrow(add, "block int, data binary").toLocalIterator():
        if r.block < 0:
            weights = np.frombuffer(bytes(r.data), np.float64)
        else:
            cells[:, r.block] = np.frombuffer(bytes(r.data), "<u2").reshape(2, BLOCK)
    return tables, weights


def codes_within(classes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Huffman codes of symbols among those of their class: (starts, nodes, bits, share). Symbol i's code is nodes and bits
    starts[i]:starts[i + 1], from the root on; a node's share are its upper half's odds."""
    n = len(classes)
    parent, side, share = np.full(2 * n, -1), np.zeros(2 * n, np.int8), np.zeros(n)
    made = 0
    order = np.argsort(classes, kind="stable")
    for members in np.split(order, np.flatnonzero(np.diff(classes[order])) + 1):
        heap = [(w, i) for w, i in zip(weights[members].tolist(), members.tolist(), strict=True)]
        heapq.heapify(heap)
        while len(heap) > 1:
            (low, a), (high, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[a] = parent[b] = n + made
            side[b] = 1
            share[made] = math.log((high + 1e-3) / (low + 1e-3))
            heapq.heappush(heap, (low + high, n + made))
            made += 1
    symbol, at, steps = np.arange(n), np.arange(n), []
    while True:
        up = parent[at] >= 0
        symbol, at = symbol[up], at[up]
        if not len(at):
            break
        steps.append((symbol, np.full(len(at), -len(steps)), parent[at] - n, side[at]))
        at = parent[at]
    if not steps:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8), share
    symbol, depth, nodes, bits = (np.concatenate(x) for x in zip(*steps, strict=True))
    first = np.lexsort((depth, symbol))
    return np.concatenate([[0], np.cumsum(np.bincount(symbol, minlength=n))]), nodes[first], bits[first], share


# -- words in context --------------------------------------------------------------------------------------------------
class Symbols:
    """Codes of symbols: the listed words that were counted, then the end, then the escape. counts: of the listed words (0: an
    escaped one)."""

    def __init__(self, counts: np.ndarray, ends: int, escaped: int):
        listed = np.flatnonzero(counts > 0)
        n = len(listed)
        self.of_listed = np.full(len(counts) + 1, n + 1)  # the last is for words that aren't listed
        self.of_listed[listed] = np.arange(n)
        self.end, self.escape = n, n + 1
        weights = np.concatenate([counts[listed], [max(ends, 1)], [escaped + 1]]).astype(float)
        order = np.argsort(-weights, kind="stable")
        middle = np.empty(len(weights))
        middle[order] = (np.cumsum(weights[order]) - weights[order] / 2) / weights.sum()
        self.classes = (middle * (1 << DEPTH)).astype(np.int64)
        mass = np.bincount(self.classes, weights, minlength=1 << DEPTH)
        self.rest = np.log10(weights / mass[self.classes])
        at = np.zeros(2 << DEPTH)  # mass by the first bits, with a leading one
        at[1 << DEPTH :] = mass
        for node in range((1 << DEPTH) - 1, 0, -1):
            at[node] = at[2 * node] + at[2 * node + 1]
        self.share = np.log((at[1 : 2 << DEPTH : 2] + 1e-3) / (at[0 : 2 << DEPTH : 2] + 1e-3))  # of node k: its upper half's odds
        self.starts, self.nodes, self.bits, self.odds = codes_within(self.classes, weights)


class Context:
    """The bits of a run of tokens and their contexts."""

    def __init__(self, symbols: Symbols, ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray):
        """ids and hashes of tokens in turn; starts: where texts begin (their first tokens have nothing before them)."""
        n = len(ids)
        first = np.zeros(n, np.int64)
        first[starts] = starts
        place = np.arange(n) - np.maximum.accumulate(first)
        kinds = symbols.classes[ids]

        def back(values: np.ndarray, k: int) -> np.ndarray:
            out = np.zeros(n, np.uint64)
            out[k:] = np.where(place[k:] >= k, values[:-k] if k else values, np.uint64(0))
            return out

        one, two = back(hashes, 1), back(hashes, 2)
        k = (kinds + 1).astype(np.uint64)
        three = back(k, 1) | back(k, 2) << np.uint64(10) | back(k, 3) << np.uint64(20)
        self.ids, self.kinds, self.contexts = ids, kinds, [one, three + np.uint64(1), two * _B + np.uint64(2)]

    def part(self, a: int, b: int) -> Context:
        out = object.__new__(Context)
        out.ids, out.kinds, out.contexts = self.ids[a:b], self.kinds[a:b], [c[a:b] for c in self.contexts]
        return out


class WordModel:
    """Counters of the contexts, and what mixes them: of the classes' bits; within its class a symbol has its share."""

    CONTEXTS, PLACES = 3, DEPTH + 3

    def __init__(self, symbols: Symbols, bits: int, tables: np.ndarray | None = None, weights: np.ndarray | None = None):
        self.symbols, self.bits = symbols, bits
        # both counters of a slot side by side
        self.tables = np.zeros((self.CONTEXTS, 1 << bits, 2), np.float32) if tables is None else tables
        plain = np.zeros((64, self.CONTEXTS + 1), np.float32)
        plain[:, 0] = 0.5
        self.by_count, self.by_place = plain.copy(), plain.copy()
        self.map = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, 33))), (self.PLACES, 1))
        if weights is not None:
            size = plain.size
            self.by_count, self.by_place = (weights[a : a + size].reshape(plain.shape).astype(np.float32) for a in (0, size))
            self.map = weights[2 * size :].reshape(self.PLACES, 33)

    @property
    def weights(self) -> np.ndarray:
        return np.concatenate([self.by_count.ravel(), self.by_place.ravel(), self.map.ravel()]).astype(float)

    def _read(self, share: np.ndarray, salt: np.ndarray, contexts: list[np.ndarray]):
        """The predictions of bits, their slots, and how much the contexts have seen (as a level)."""
        x, slots, level = np.empty((len(share), self.CONTEXTS + 1), np.float32), [], []
        x[:, 0] = share
        for o, context in enumerate(contexts):
            h = (context ^ salt) * _A
            at = ((h ^ (h >> np.uint64(31))) * _A >> np.uint64(64 - self.bits)).astype(np.int64)
            n = self.tables[o].take(at, 0)
            logs = np.log(n + np.float32(0.4))
            np.subtract(logs[:, 1], logs[:, 0], out=x[:, o + 1])
            slots.append(at)
            # the exponent of the count of both, plus one
            level.append(np.minimum(((n[:, 0] + n[:, 1] + np.float32(1)).view(np.int32) >> 23) - 127, 7))
        return x, slots, level

    def _inputs(self, tokens: Context):
        """Bits to predict: (their tokens, or None if one each; places in the code; bits; predictions; slots; two gates)."""
        for k in range(DEPTH):
            node, bit = 1 << k | tokens.kinds >> (DEPTH - k), tokens.kinds >> (DEPTH - 1 - k) & 1
            x, slots, level = self._read(self.symbols.share[node], (np.arange(2 << k, dtype=np.uint64) * _B)[node], tokens.contexts)
            yield None, k, bit, x, slots, level[0] * 8 + level[1], k * 8 + level[2]

    def _mixed(self, x, g, h):
        z = np.clip(np.einsum("no,no->n", self.by_count.take(g, 0) + self.by_place.take(h, 0), x), -12, 12)
        return z, 1 / (1 + np.exp(-z))

    def learn(self, tokens: Context, rate: float) -> None:
        """One online step: the tokens are predicted, the weights corrected, and then the tokens counted."""
        for _, k, bit, x, slots, g, h in list(self._inputs(tokens)):
            z, p = self._mixed(x, g, h)
            step = x * (bit - p)[:, None]
            for weights, gate in ((self.by_count, g), (self.by_place, h)):
                n = np.maximum(np.bincount(gate, minlength=64), 20)
                for o in range(self.CONTEXTS + 1):
                    weights[:, o] += rate * np.bincount(gate, step[:, o], minlength=64) / n
            cell = k * 33 + Model._cell(z)
            n, hits = np.bincount(cell, minlength=self.map.size), np.bincount(cell, bit, minlength=self.map.size)
            flat = self.map.reshape(-1)
            flat += n / (n + 50) * (np.divide(hits, np.maximum(n, 1)) - flat) * (n > 0)
            for o, at in enumerate(slots):
                np.add.at(self.tables[o].reshape(-1), 2 * at + bit, np.float32(1))

    def _known(self, ids: np.ndarray) -> np.ndarray:
        """log10 of what isn't mixed of each token."""
        return self.symbols.rest[ids].copy()

    def log10(self, tokens: Context, ids: np.ndarray) -> np.ndarray:
        """log10 probability of each token."""
        total = self._known(ids)
        for owner, k, bit, x, _, g, h in self._inputs(tokens):
            z, p = self._mixed(x, g, h)
            p = np.clip((p + self.map[k, Model._cell(z)]) / 2, 1e-5, 1 - 1e-5)
            each = np.log10(np.where(bit == 1, p, 1 - p))
            total += each if owner is None else np.bincount(owner, each, minlength=len(total))
        return total


class WholeModel(WordModel):
    """All bits of a symbol's code are mixed, those within its class too."""

    def _inputs(self, tokens: Context):
        yield from super()._inputs(tokens)
        s = self.symbols
        lengths = np.diff(s.starts)[tokens.ids]
        owner, first = np.repeat(np.arange(len(lengths)), lengths), s.starts[tokens.ids]
        at = ragged(first, lengths)
        node, place = s.nodes[at], DEPTH + np.minimum((at - first[owner]) // 3, self.PLACES - DEPTH - 1)
        salt = (node + (2 << DEPTH)).astype(np.uint64) * _B
        x, slots, level = self._read(s.odds[node], salt, [c[owner] for c in tokens.contexts])
        yield owner, place, s.bits[at], x, slots, level[0] * 8 + level[1], place * 8 + level[2]

    def _known(self, ids: np.ndarray) -> np.ndarray:
        return np.zeros(len(ids))


def tokens_of(words: Words, listed: pa.Array, symbols: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, hashes, starts of texts, place in `listed` or -1 of each distinct word): the texts' words with an end after each."""
    distinct = words.dictionary
    at = pc.index_in(distinct, listed).fill_null(-1).to_numpy(zero_copy_only=False) if len(listed) else np.full(len(distinct), -1)
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct)) | np.uint64(1)
    n = len(words.bounds) - 1
    ends = words.bounds[1:] + np.arange(n)
    inside = np.ones(len(words.codes) + n, bool)
    inside[ends] = False
    ids, hashes = np.full(len(inside), symbols.end), np.zeros(len(inside), np.uint64)
    if len(distinct):
        ids[inside], hashes[inside] = symbols.of_listed[at[words.codes]], own[words.codes]
    return ids, hashes, words.bounds[:-1] + np.arange(n), at


def gather_words(texts: DataFrame, listed, n_tokens: int, octets: int) -> WholeModel:
    """The model learnt from all texts. listed: a broadcast of (words, symbols)."""
    bits = int(min(TABLE_BITS, max(12, math.ceil(math.log2(n_tokens + 1)))))
    tasks = max(1, -(-octets // TASK_OCTETS))

    def learn(batches):
        words_, symbols = listed.value
        names, model, steps = pa.array(words_, pa.string()), WholeModel(symbols, bits), 0
        for batch in batches:
            for part in slices(batch):
                ids, hashes, starts, _ = tokens_of(Words(part.column("text"), lower=True), names, symbols)
                tokens = Context(symbols, ids, hashes, starts)
                for a in range(0, len(ids), STEP_TOKENS):
                    model.learn(tokens.part(a, a + STEP_TOKENS), 0.2 / (1 + steps / 20))
                    steps += 1
        if steps:
            yield from blocks_of(np.ascontiguousarray(np.moveaxis(model.tables, 2, 0)))
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([np.concatenate([[steps], model.weights]).tobytes()], pa.binary())], ["block", "data"])

    tables, weights = gathered(texts.coalesce(tasks).mapInArrow(learn, "block int, data binary"), (2, WordModel.CONTEXTS, 1 << bits))
    return WholeModel(listed.value[1], bits, np.ascontiguousarray(np.moveaxis(tables, 0, 2)), weights[1:] if weights is not None else None)


def score(docs: DataFrame, train, key: str = "doc_id", text: str = "text", frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score, and bits_per_byte of every row; train: a condition on docs."""
    spark = docs.sparkSession
    rows = docs.select(key, F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    counts = cut(token_counts(rows))
    sums = counts.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    ends = rows.where("train").count()
    n_words, types = sums[0] or 0, sums[1] or 0
    total, distinct = n_words + ends, types + (ends > 0)
    hot = frequent(counts, frequent_words).select("word", "c").toPandas().sort_values("word")
    names, hot_c = hot["word"].tolist(), hot["c"].to_numpy().astype(np.int64)
    escaped, rare_types = n_words - int(hot_c.sum()), types - int((hot_c > 0).sum())
    symbols = Symbols(hot_c, ends, escaped)
    listed = spark.sparkContext.broadcast((names, symbols))
    octets = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    reader = gather_words(rows.where("train").select("text"), listed, total, octets)
    model = gather(counts, types)
    free = math.log10((DISCOUNT * rare_types + 1) / (escaped + 1))
    unit = math.log10(total + distinct + 1)
    speller = spark.sparkContext.broadcast((model.bits, model.tables, model.by_count, model.by_place, model.map))

    def price(batches):
        """A word's base price, and its log10 probability after an escape."""
        bits, tables, *learnt = speller.value
        own = Model(bits, tables)
        own.by_count, own.by_place, own.map = learnt
        for batch in batches:
            words, c = batch.column("word"), batch.column("c").to_numpy()
            new = np.flatnonzero(c == 0)
            spelled = [own.log10(run) for run in _runs(words.take(pa.array(new)).cast(pa.binary()).to_pylist())]
            lp = np.log10(np.maximum(c - DISCOUNT, 1e-9) / (escaped + 1))
            lp[new] = (np.concatenate(spelled) if spelled else np.zeros(0)) + free
            yield pa.RecordBatch.from_arrays([words, batch.column("n"), batch.column("c"), pa.array(np.log10(c + 1) - unit), pa.array(lp)], ["word", "n", "c", "base", "lp"])

    priced = cut(counts.mapInArrow(price, "word string, n long, c long, base double, lp double"))
    hot = frequent(priced, frequent_words).select("word", "c", "base", "lp").toPandas().sort_values("word")
    # a listed word that was counted is a symbol; another one costs what it has after an escape
    known = spark.sparkContext.broadcast((hot["c"].to_numpy() > 0, hot["base"].to_numpy(), np.where(hot_c > 0, 0.0, hot["lp"].to_numpy())))
    read = spark.sparkContext.broadcast((reader.bits, reader.tables.astype(np.uint16), reader.weights))
    end_base = math.log10(ends + 1) - unit

    def tell(batches):
        words_, symbols = listed.value
        seen, base, lp = known.value
        bits, tables, weights = read.value
        reader, names_ = WholeModel(symbols, bits, tables.astype(np.float32), weights), pa.array(words_, pa.string())
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), lower=True)
                ids, hashes, starts, of_word = tokens_of(words, names_, symbols)
                tokens = Context(symbols, ids, hashes, starts)
                each = np.concatenate([reader.log10(tokens.part(k, k + (1 << 15)), ids[k : k + (1 << 15)]) for k in range(0, len(ids), 1 << 15)]) if len(ids) else np.zeros(0)
                told = np.bincount(np.repeat(np.arange(part.num_rows), words.counts + 1), each, minlength=part.num_rows)
                at = of_word[words.codes]
                n = part.num_rows
                owner = words.owners()
                hit = at >= 0
                own, k = owner[hit], at[hit]
                pairs = pa.array(owner[~hit] * (len(words.dictionary) + 1) + words.codes[~hit]).dictionary_encode()
                rare, times = pairs.dictionary.to_numpy(), np.bincount(pairs.indices.to_numpy(zero_copy_only=False), minlength=len(pairs.dictionary))
                m = len(rare)
                doc, code = rare // (len(words.dictionary) + 1), rare % (len(words.dictionary) + 1)
                sizes = np.diff(words.text_offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([row + np.arange(n), row + doc])),
                        pa.concat_arrays([part.column(key), pa.nulls(m, part.column(key).type)]),
                        pa.concat_arrays([part.column("train"), pa.nulls(m, pa.bool_())]),
                        pa.concat_arrays([pa.nulls(n, pa.string()), words.dictionary.take(pa.array(code))]),
                        pa.array(np.concatenate([words.counts + 1, times]).astype(np.int64)),
                        pa.array(np.concatenate([np.bincount(own, seen[k], minlength=n) + (ends > 0), np.zeros(m)]).astype(np.int64)),
                        pa.array(np.concatenate([np.bincount(own, base[k], minlength=n) + end_base, np.zeros(m)])),
                        pa.array(np.concatenate([np.bincount(own, lp[k], minlength=n) + told, np.zeros(m)])),
                        pa.array(np.concatenate([sizes, np.zeros(m)]).astype(np.int64)),
                    ],
                    ["row", key, "train", "word", "times", "known", "base", "lp", "bytes"],
                )
                row += n

    kind = docs.schema[key]
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField(key, kind.dataType), *T._parse_datatype_string("train boolean, word string, times long, known long, base double, lp double, bytes long").fields])
    told = cut(rows.mapInArrow(tell, schema))  # stored, since row numbers must not change
    whole = told.where("word is null").select("row", key, "train", F.col("times").alias("n_tokens"), "known", "base", "lp", "bytes")
    rest = told.where("word is not null").select("row", "word", "times").join(priced.select("word", "c", F.col("base").alias("b"), F.col("lp").alias("l")), "word")
    rest = rest.select("row", F.lit(None).cast(kind.dataType).alias(key), F.lit(None).cast("boolean").alias("train"), F.lit(0).cast("long").alias("n_tokens"), F.when(F.col("c") > 0, F.col("times")).otherwise(0).cast("long").alias("known"), (F.col("times") * F.col("b")).alias("base"), (F.col("times") * F.col("l")).alias("lp"), F.lit(0).cast("long").alias("bytes"))
    out = whole.unionByName(rest).groupBy("row").agg(F.max(key).alias(key), F.max("train").alias("train"), *(F.sum(c).alias(c) for c in ("n_tokens", "known", "base", "lp", "bytes")))
    done = cut(out.select(key, "train", "n_tokens", F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("lp").alias("score"), (-F.col("lp") / math.log10(2) / (F.col("bytes") + 1)).alias("bits_per_byte")))
    drop_cut(counts, priced, told)
    return done


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores, learnt from those whose crc32 mod 7 isn't 2."""
    docs = documents(spark, sf_dir)
    found = score(docs, crc_mod("doc_id", 7) != 2)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
