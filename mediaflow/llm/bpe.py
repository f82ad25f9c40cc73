"""BPE encoding and decoding through a minimal acyclic transducer of the corpus's frequent words.

The words of all documents are counted; the most frequent ones (at most `lexicon_words`) are compiled into
an acyclic automaton whose equal suffixes are shared. The outputs along a word's path sum to the word's number, and that
number points at its ids. The automaton is one flat file: it is broadcast (its size is bounded by `lexicon_words`), each
executor writes it once beside its other scratch files, and its Python workers map it into memory. Words that are not in
the lexicon are merged by the tokenizer's own merge rules (merges.py), so the ids are those of the tokenizer for every text.

A text's words are what ASCII white space separates. The tokenizer must never merge across white space, which holds for
tokenizers that drop it. Null and empty texts have no ids; a null id column decodes to the empty text. Other columns
aren't touched: `keep` names those to carry along. Rows are independent, so repeated rows get the same ids; words that are
equally frequent go into the lexicon together or stay out together; an empty table gives no rows, and an empty lexicon in which
every word is unseen. Long texts are encoded whole, a slice of rows of some megabytes at a time.
"""

from __future__ import annotations

import contextlib
import hashlib
import mmap
import os
import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaflow.llm.common import Words, cut, drop_cut, ragged, slices, without
from mediaflow.llm.merges import Merger

LEXICON_WORDS = 1 << 16


# -- the automaton -----------------------------------------------------------------------------------------------------
class Transducer:
    """Lookup in the flat form: `keys`/`target`/`output` are a hash table of (state, byte) → (state, output)."""

    MAGIC = 0x4D46_4C58

    def __init__(self, buffer):
        head = np.frombuffer(buffer, np.int64, 6)
        if head[0] != self.MAGIC:
            raise ValueError("not a lexicon file")
        _, bits, states, words, n_ids, self.root = (int(x) for x in head)
        at = 48
        self.bits, self.words = bits, words
        parts = []
        for kind, n in ((np.uint32, 1 << bits), (np.int32, 1 << bits), (np.int32, 1 << bits), (np.uint8, -(-states // 8) * 8), (np.int32, words + 1), (np.int32, n_ids)):
            parts.append(np.frombuffer(buffer, kind, n, at))
            at += -(-n * np.dtype(kind).itemsize // 8) * 8
        self.keys, self.target, self.output, self.final, self.starts, self.ids = parts

    EMPTY = np.uint32(0xFFFFFFFF)

    @staticmethod
    def slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)

    def lookup(self, words: pa.Array) -> np.ndarray:
        """Each word's number, or -1. All words walk the automaton together, a byte at a time."""
        n = len(words)
        if not n:
            return np.zeros(0, np.int64)
        offsets = np.frombuffer(words.buffers()[1], np.int32, n + 1, words.offset * 4).astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8)
        found, total, state = np.full(n, -1), np.zeros(n, np.int64), np.full(n, self.root, np.int64)
        alive, pos = np.arange(n), offsets[:-1].copy()
        while len(alive):
            ended = pos[alive] == offsets[alive + 1]
            done = alive[ended]
            ok = done[self.final[state[done]] == 1]
            found[ok] = total[ok]
            alive = alive[~ended]
            if not len(alive):
                break
            keys = (state[alive] << 8 | data[pos[alive]]).astype(np.uint32)
            at = self.slot(keys, self.bits)
            open_ = np.arange(len(alive))
            hit = np.full(len(alive), -1)
            while len(open_):
                seen = self.keys[at[open_]]
                same = seen == keys[open_]
                hit[open_[same]] = at[open_[same]]
                open_ = open_[~same & (seen != self.EMPTY)]
                at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            alive, hit = alive[hit >= 0], hit[hit >= 0]
            state[alive] = self.target[hit]
            total[alive] += self.output[hit]
            pos[alive] += 1
        return found


def compile_lexicon(words: list[str], ids: list[list[int]]) -> bytes:
    """The flat minimal acyclic transducer of distinct words; word k in byte order outputs k, and ids[k] are stored for it.

    Words arrive in byte order; once a word leaves a branch, the branch's states are final and equal ones are merged."""
    order = sorted(range(len(words)), key=lambda i: words[i].encode())
    coded = [words[i].encode() for i in order]
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []  # by state: ((byte, state), …)
    finals: list[bool] = []
    below: list[int] = []  # words that a state accepts
    path: list[tuple[list, list]] = [([], [False])]  # open states: arcs, final

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            own, final = path.pop()
            key = (final[0], tuple(own))
            state = register.get(key)
            if state is None:
                state = register[key] = len(arcs)
                arcs.append(key[1])
                finals.append(final[0])
                below.append(final[0] + sum(below[t] for _, t in own))
            own_byte = taken[len(path) - 1]
            path[-1][0].append((own_byte, state))

    taken: bytes = b""
    for word in coded:
        common = len(os.path.commonprefix([taken, word]))
        close(common)
        for _ in word[common:]:
            path.append(([], [False]))
        path[-1][1][0] = True
        taken = word
    close(0)
    own, final = path[0]
    arcs.append(tuple(own))
    finals.append(final[0])
    root = len(arcs) - 1

    keys, target, output = [], [], []
    for state, out in enumerate(arcs):
        passed = int(finals[state])
        for byte, to in out:
            keys.append(state << 8 | byte)
            target.append(to)
            output.append(passed)
            passed += below[to]
    if len(arcs) >= 1 << 24:
        raise ValueError("too many words for one lexicon")
    bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) / 0.75))))
    table = [np.full(1 << bits, Transducer.EMPTY), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)]
    keys_, target_, output_ = np.array(keys, np.int64), np.array(target, np.int32), np.array(output, np.int32)
    at, left = Transducer.slot(keys_, bits), np.arange(len(keys_))
    while len(left):
        _, first = np.unique(at[left], return_index=True)
        first = first[table[0][at[left[first]]] == Transducer.EMPTY]
        put = left[first]
        for column, values in zip(table, (keys_, target_, output_), strict=True):
            column[at[put]] = values[put]
        left = np.setdiff1d(left, put, assume_unique=True)
        at[left] = (at[left] + 1) & ((1 << bits) - 1)
    lengths = [len(ids[i]) for i in order]
    flat = [x for i in order for x in ids[i]]
    n_states = -(-len(arcs) // 8) * 8
    final_ = np.zeros(n_states, np.uint8)
    final_[: len(finals)] = finals
    parts = [np.array([Transducer.MAGIC, bits, len(arcs), len(coded), len(flat), root], np.int64), *table, final_, np.cumsum([0, *lengths], dtype=np.int32), np.array(flat, np.int32)]
    return b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)


def mapped(blob: bytes) -> Transducer:
    """The lexicon from a memory-mapped file; workers of one executor share it by its content's name. Earlier lexicons go
    (who has mapped one keeps it)."""
    path = os.path.join(tempfile.gettempdir(), f"lexicon-{hashlib.sha256(blob).hexdigest()[:32]}.bin")
    while True:
        with contextlib.suppress(FileNotFoundError), open(path, "rb") as f:  # a worker with another lexicon may remove it at any time
            return Transducer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        handle, part = tempfile.mkstemp(dir=tempfile.gettempdir())
        with os.fdopen(handle, "wb") as out:
            out.write(blob)
        os.replace(part, path)
        for name in os.listdir(tempfile.gettempdir()):
            if re.fullmatch(r"lexicon-[0-9a-f]{32}\.bin", name) and name != os.path.basename(path):
                with contextlib.suppress(FileNotFoundError):  # another worker was first
                    os.unlink(os.path.join(tempfile.gettempdir(), name))


_WORKER: dict = {}


def _kept(key, make):
    """One of a kind for each Python worker."""
    if key not in _WORKER:
        for old in [k for k in _WORKER if k[0] == key[0]]:
            del _WORKER[old]
        _WORKER[key] = make()
    return _WORKER[key]


class Encoder:
    """Encodes columns of texts; `blob` is a compiled lexicon or None."""

    def __init__(self, tokenizer: str, blob: bytes | None = None):
        self.merger = _kept(("merger", tokenizer), lambda: Merger(tokenizer))
        self.lexicon = _kept(("lexicon", hashlib.sha256(blob).hexdigest()), lambda: mapped(blob)) if blob else None

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn, and each text's bounds in them."""
        words = Words(texts, lower=False)
        dictionary, n = words.dictionary, len(words.dictionary)
        lengths, starts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        number = self.lexicon.lookup(dictionary) if self.lexicon else np.full(n, -1)
        unseen = np.flatnonzero(number < 0)
        flat, bounds = self.merger(dictionary.take(pa.array(unseen)) if len(unseen) < n else dictionary)
        starts[unseen], lengths[unseen] = bounds[:-1], np.diff(bounds)
        if self.lexicon:
            seen = np.flatnonzero(number >= 0)
            first, last = self.lexicon.starts[number[seen]], self.lexicon.starts[number[seen] + 1]
            starts[seen], lengths[seen] = first + len(flat), last - first
            flat = np.concatenate([flat, self.lexicon.ids])
        each = lengths[words.codes]
        ids = flat[ragged(starts[words.codes], each)]
        before = np.concatenate([[0], np.cumsum(each)])
        return ids, before[words.bounds]


# -- Spark -------------------------------------------------------------------------------------------------------------
def count_words(docs: DataFrame, text: str = "text", lower: bool = False, most: int = 150_000) -> DataFrame:
    """(word, n) over all texts. A task adds up its own counts and hands them on whenever it holds `most` words."""

    def tally(batches):
        held: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch, text):
                words = Words(part.column(text), lower)
                counts = np.bincount(words.codes, minlength=len(words.dictionary))
                for word, n in zip(words.dictionary.to_pylist(), counts.tolist(), strict=True):
                    held[word] = held.get(word, 0) + n
                if len(held) > most:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                    held = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    return docs.select(text).mapInArrow(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts (word, n) above the least count that at most `most` words reach, told in steps of a twelfth of an
    octave: a few hundred rows of statistics decide, and ties go or stay together."""
    level = F.floor(F.log2("n") * 12).cast("int")
    held, least = 0, 1 << 30
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        held += row["count"]
        if held > most:
            break
        least = row["level"]
    return counts.where(level >= least)


def build_lexicon(docs: DataFrame, tokenizer: str, text: str = "text", lexicon_words: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of the most frequent words of all texts; the driver holds `lexicon_words` words at most."""
    counts = cut(count_words(docs, text))
    top = sorted(r.word for r in frequent(counts, lexicon_words).select("word").collect())
    drop_cut(counts)
    ids, bounds = Merger(tokenizer)(pa.array(top, pa.string()))
    return compile_lexicon(top, [ids[a:b].tolist() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])


def encode(docs: DataFrame, tokenizer: str, blob: bytes | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """`keep`, and the ids of `text` as packed little-endian unsigned 32-bit integers in `ids`.

    blob: a lexicon from build_lexicon; without one, every word is merged (and remembered) by the workers.
    decoded: a column for the ids' text as decode() gives it, made in the same pass."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(blob) if blob else None
    columns = [c for c in keep]

    def run(batches):
        encoder = Encoder(tokenizer, shared.value if shared else None)
        for batch in batches:
            for part in slices(batch, text):
                flat, bounds = encoder(part.column(text))
                packed = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((bounds * 4).astype(np.int64)), pa.py_buffer(flat.astype("<u4"))]).cast(pa.binary())
                more = [_texts(flat, bounds, tokenizer)] if decoded else []
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), packed, *more], [*columns, ids, *([decoded] if decoded else [])])

    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField(ids, T.BinaryType()), *([T.StructField(decoded, T.StringType())] if decoded else [])])
    return docs.select(*columns, text).mapInArrow(run, schema)


def _texts(flat: np.ndarray, bounds: np.ndarray, tokenizer: str) -> pa.Array:
    """The texts of runs of ids: their tokens with one space between."""
    known = _kept(("merger", tokenizer), lambda: Merger(tokenizer)).tokenizer
    tokens = _kept(("tokens", tokenizer), lambda: pa.array([(known.id_to_token(i) or "") + " " for i in range(known.get_vocab_size())], pa.string()))
    pieces = tokens.take(pa.array(flat, pa.uint32() if flat.dtype.kind == "u" else pa.int32()))
    ends = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1) if len(pieces) else np.zeros(1, np.int32)
    data = memoryview(pieces.buffers()[2]) if len(pieces) else memoryview(b"")
    cuts = ends[bounds].tolist()
    return pa.array([bytes(data[a : b - 1]).decode() if b > a else "" for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string())


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with `text` (in place of a column of that name): the tokens of the packed `ids`, one space between them, as a tokenizer without a decoder joins them."""
    df = without(df, text)
    columns = df.columns

    def run(batches):
        for batch in batches:
            for part in slices(batch, ids):
                column = part.column(ids).fill_null(b"")
                sizes = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
                raw = column.buffers()[2]
                flat = np.frombuffer(raw, np.uint8)[sizes[0] : sizes[-1]].view("<u4") if raw is not None else np.zeros(0, "<u4")
                yield pa.RecordBatch.from_arrays([*part.columns, _texts(flat, (sizes - sizes[0]) // 4, tokenizer)], [*columns, text])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, decoded again, and both digested."""
    from mediaflow.llm.common import documents

    path, docs = tokenizer_path(), documents(spark, sf_dir)
    return encode(docs, path, build_lexicon(docs, path), decoded="decoded").select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
