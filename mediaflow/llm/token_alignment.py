"""Alignment of two tokenizations of the same texts, by anchors before space-marked tokens.

A is a byte-level BPE over space+text, B a piece BPE over text that adds that space, so the tokens of either cover the same
octets. After a text is fully tokenised both ways, the anchors are the octets before which a token of A ends and one of B
ends and after which both have a token that starts with a space; both ends are verified from the tokens' octets. Anchors cut
the text into windows of token ids. How a window's tokens fall into groups (the runs between shared ends) depends on its ids
alone, so a worker aligns each distinct pair of id tuples once and remembers it: the groups as text, and the linked pairs.

Corpus counts: a pair's count is the number of documents that hold it linked. Pairs are counted by hash aggregation (partial
sums before the shuffle). The `FREQUENT` most counted pairs at most, a bound, go to every worker, which adds up what a
document's frequent pairs give; its other pairs are joined with the table of counts. A pair that is not among the frequent has
few documents by definition, so that join has no hot key. The best count of an A id is a row an id, so bounded by the vocabulary.

Tokenising: `units` are stretches of text between single spaces at which neither tokenizer can join anything: A's fixed
pattern starts a word there, and none of B's pieces has the space mark after another character (this is checked, else a text is
one unit). Equal units of a batch are tokenised once; the ids are those of the whole text.

Texts that are null or empty, or whose tokens' octets aren't space+text (such as those with U+2581 itself), have no tokens: all
numbers are 0 and the digest is ''. Special tokens' names in a text are plain text. Very long texts are whole texts too.
Repeated rows count as documents of their own; ids may be null or repeat; an empty table gives none; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaflow.llm.bpe import _kept
from mediaflow.llm.common import cut, documents, ragged, slices, text_or_empty
from mediaflow.llm.merges import byte_letters

#: Pairs whose counts go to every worker, at most.
FREQUENT = 1 << 18
#: Windows that a worker remembers, at most; then it starts anew.
REMEMBERED = 1 << 19
#: In a window with more pairs than this (long stretches without a shared end), pairs are counted instead of listed.
LISTED = 1 << 16
#: A's split pattern, and B's space mark.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARK = "▁"

#: Octets that can follow the space between two units: printable ASCII, and first octets of characters that no tokenizer takes for white space.
_AFTER = np.zeros(256, bool)
_AFTER[[*range(0x21, 0x7F), *range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True


class Side:
    """A tokenizer's token octets: those of id i are data[starts[i]:starts[i + 1]]."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = pa.array(tokens, pa.binary())
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.spaced = np.array([t[:1] == b" " for t in tokens])

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The octets of all ids in turn."""
        taken = self.tokens.take(pa.array(ids))
        raw = taken.buffers()[2]
        return np.frombuffer(raw, np.uint8)[: int(self.sizes[ids].sum())] if raw is not None else np.zeros(0, np.uint8)


class BytePairs(Side):
    """Side A, from a tokenizer file. Where its merges are in the order of their ids, they are ranks as a rank-based encoder
    takes them, which is several times faster; else the tokenizer itself encodes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, special = made["model"], {t["content"] for t in made.get("added_tokens") or []}
        octet = {letter: b for b, letter in enumerate(byte_letters())}
        vocab = model["vocab"]
        tokens = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            tokens[i] = token.encode() if token in special else bytes(octet[c] for c in token)
        super().__init__(tokens)
        ordered = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        self.ranks = None
        if ordered == sorted(ordered) and min(ordered) == 256 and not model.get("ignore_merges"):
            import tiktoken

            self.ranks = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens) if i <= ordered[-1]}, special_tokens={})
        else:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.no_padding()
            self.tokenizer.no_truncation()
            self.tokenizer.encode_special_tokens = True

    def encode(self, text: str) -> np.ndarray:
        if self.ranks is not None:
            return self.ranks.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)

    def __call__(self, units: list[str], first: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a space and each unit, and their bounds: units that start as _AFTER says are encoded in one text, `first` alone."""
        text = "".join(" " + u for u in units)
        ids = self.encode(text) if units else np.zeros(0, np.int64)
        ends = np.cumsum(self.sizes[ids])
        unit_ends = np.cumsum(pc.binary_length(pa.array(units, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        if units and ends[-1] != unit_ends[-1]:  # a tokenizer that changes texts: its tokens can't be told apart by octets
            each = [self.encode(" " + u) for u in units]
            ids, at = np.concatenate(each), np.cumsum([len(x) for x in each])
        else:
            at = np.searchsorted(ends, unit_ends, "right")
        alone = [self.encode(" " + u) for u in first]
        return np.concatenate([ids, *alone]), np.concatenate([[0], at, len(ids) + np.cumsum([len(x) for x in alone])]).astype(np.int64)


class Pieces(Side):
    """Side B, from a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)])
        #: Whether no piece goes on past a space, so that what lies before a single one and after it are tokenised apart.
        self.separable = not any(MARK in n.lstrip(MARK) for n in names)

    def __call__(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.model.encode(units, num_threads=1)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        return np.fromiter((i for x in ids for i in x), np.int64, int(bounds[-1])), bounds


def split(texts: pa.Array, separable: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The units of all texts, each text's bounds in them, and which units start their text. The space before a unit isn't in it."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1).astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[: offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    here = np.zeros(len(data) + 2, bool)
    if separable and len(data) > 2:
        here[1 : len(data) - 1] = (data[1:-1] == 32) & (data[:-2] != 32) & _AFTER[data[2:]]
        for edge in (offsets[:-1], offsets[1:] - 1):  # a text's first and last octets aren't between two of its own
            here[np.maximum(edge, 0)] = False
    spaces = np.flatnonzero(here)
    starts = np.concatenate([offsets[:-1], spaces + 1])
    order = np.argsort(starts, kind="stable")
    opening = order < n
    starts = starts[order]
    owner = np.cumsum(opening) - 1
    ends = np.where(np.append(opening[1:], True), offsets[1:][owner], np.append(starts[1:], 0) - 1)
    sizes = ends - starts
    values = pa.py_buffer(np.ascontiguousarray(data[ragged(starts, sizes)]))
    units = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)
    return units, np.searchsorted(owner, np.arange(n + 1)), opening


class Aligner:
    """Tokenises and aligns columns of texts; remembers the alignments of windows."""

    def __init__(self, a: str, b: str):
        self.a, self.b = BytePairs(a), Pieces(b)
        self.codes = len(self.b.sizes)
        self.names_a, self.names_b = (pa.array([str(i) for i in range(len(s.sizes))], pa.string()) for s in (self.a, self.b))
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.text, self.groups, self.links = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.first, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def tokens(self, texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """ids of A and B of all texts in turn, and the texts' bounds in each."""
        units, of_text, opening = split(texts, self.b.separable)
        coded = units.filter(pa.array(~opening)).dictionary_encode()
        inner = coded.dictionary.to_pylist()
        first = units.filter(pa.array(opening)).to_pylist()
        number = np.empty(len(units), np.int64)
        number[~opening] = coded.indices.to_numpy(zero_copy_only=False)
        number[opening] = len(inner) + np.arange(len(first))
        ids, bounds = [], []
        for flat, at in (self.a(inner, first), self.b([*inner, *first])):
            sizes = np.diff(at)[number]
            ids.append(flat[ragged(at[:-1][number], sizes)])
            bounds.append(np.concatenate([[0], np.cumsum(sizes)])[of_text])
        return ids, bounds

    def __call__(self, texts: pa.Array) -> dict[str, np.ndarray | list]:
        """n_a, n_b, n_groups, n_links, digest of each text; its distinct linked pairs (bounds, pairs, times)."""
        n = len(texts)
        (ids_a, ids_b), (at_a, at_b) = self.tokens(texts)
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes + 1)
        good = sizes > 0
        end_a, end_b = np.cumsum(self.a.sizes[ids_a]), np.cumsum(self.b.sizes[ids_b])
        whole = np.frombuffer("".join(" " + t for t in texts.to_pylist()).encode(), np.uint8)
        for side, ids, at, end in ((self.a, ids_a, at_a, end_a), (self.b, ids_b, at_b, end_b)):
            data, last = side.joined(ids), np.concatenate([[0], end])[at]
            if not np.array_equal(data, whole) or not np.array_equal(last[1:], ends):  # rare: told text by text
                for i in np.flatnonzero(good).tolist():
                    good[i] = np.array_equal(data[last[i] : last[i + 1]], whole[ends[i] - sizes[i] - 1 : ends[i]])
        if not good.all():
            keep = np.flatnonzero(good)
            ids_a, ids_b = ids_a[ragged(at_a[keep], np.diff(at_a)[keep])], ids_b[ragged(at_b[keep], np.diff(at_b)[keep])]
            at_a, at_b = (np.concatenate([[0], np.cumsum(np.where(good, np.diff(x), 0))]) for x in (at_a, at_b))
            end_a, end_b = np.cumsum(self.a.sizes[ids_a]), np.cumsum(self.b.sizes[ids_b])
        # anchors: where tokens of both end, and the next ones of both start with a space (or a text starts)
        start_a, start_b = end_a - self.a.sizes[ids_a], end_b - self.b.sizes[ids_b]
        anchors = np.intersect1d(start_a[self.a.spaced[ids_a]], start_b[self.b.spaced[ids_b]], assume_unique=True)
        texts_at = np.concatenate([[0], end_a])[at_a]
        window_a, window_b = (np.append(np.searchsorted(start, anchors), len(ids)) for start, ids in ((start_a, ids_a), (start_b, ids_b)))
        rows = self.remembered(ids_a, window_a, ids_b, window_b)
        of_text = np.searchsorted(anchors, texts_at)
        owner = np.repeat(np.arange(n), np.diff(of_text))
        total = lambda x: np.bincount(owner, x[rows], minlength=n).astype(np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(of_text, pa.int32()), self.text.take(pa.array(rows))), ";")
        digests = [hashlib.sha256(t.as_buffer()).hexdigest() if g else "" for t, g in zip(joined, good.tolist(), strict=True)]
        many = np.diff(self.first)[rows]
        at = ragged(self.first[:-1][rows], many)
        width = len(self.a.sizes) * self.codes
        keys = np.repeat(owner, many) * width + self.pairs[at]
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], self.times[at][order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        keys, times = keys[heads], np.add.reduceat(times, heads) if len(heads) else times
        return {"n_a": np.diff(at_a), "n_b": np.diff(at_b), "n_groups": total(self.groups), "n_links": total(self.links), "digest": digests, "bounds": np.searchsorted(keys, np.arange(n + 1) * width), "pairs": keys % width, "times": times}

    def remembered(self, ids_a: np.ndarray, at_a: np.ndarray, ids_b: np.ndarray, at_b: np.ndarray) -> np.ndarray:
        """The row of each window in what is remembered; new pairs of id tuples are aligned first."""
        size_a, size_b = np.diff(at_a), np.diff(at_b)
        flat = np.zeros(int((size_a + size_b + 1).sum()), "<u4")  # each window: how many of A, those, those of B
        starts = np.cumsum(size_a + size_b + 1) - (size_a + size_b + 1)
        flat[starts] = size_a
        flat[ragged(starts + 1, size_a)] = ids_a[: at_a[-1]]
        flat[ragged(starts + 1 + size_a, size_b)] = ids_b[: at_b[-1]]
        keys = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((np.append(starts, len(flat)) * 4).astype(np.int32)), pa.py_buffer(flat)]).dictionary_encode()
        tuples = keys.dictionary.to_pylist()
        if len(self.known) + len(tuples) > REMEMBERED and self.known:
            self.forget()
        row = np.array([self.known.get(t, -1) for t in tuples], np.int64)
        new = np.flatnonzero(row < 0)
        if len(new):
            row[new] = len(self.known) + np.arange(len(new))
            for i in new.tolist():
                self.known[tuples[i]] = int(row[i])
            codes = keys.indices.to_numpy(zero_copy_only=False)
            place = np.empty(len(tuples), np.int64)
            place[codes[::-1]] = np.arange(len(codes))[::-1]  # the first window of each kind
            w = place[new]
            self.learn(ids_a[ragged(at_a[:-1][w], size_a[w])], size_a[w], ids_b[ragged(at_b[:-1][w], size_b[w])], size_b[w])
        return row[keys.indices.to_numpy(zero_copy_only=False)]

    def learn(self, ids_a: np.ndarray, size_a: np.ndarray, ids_b: np.ndarray, size_b: np.ndarray) -> None:
        """Aligns windows: groups end where tokens of both end."""
        n = len(size_a)
        end_a, end_b = np.cumsum(self.a.sizes[ids_a]), np.cumsum(self.b.sizes[ids_b])
        shared = np.intersect1d(end_a, end_b, assume_unique=True)  # a window's end is one
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        each_a, each_b = np.bincount(group_a, minlength=len(shared)), np.bincount(group_b, minlength=len(shared))
        bound = lambda each: pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32())
        text_a = pc.binary_join(pa.ListArray.from_arrays(bound(each_a), self.names_a.take(pa.array(ids_a))), ",")
        text_b = pc.binary_join(pa.ListArray.from_arrays(bound(each_b), self.names_b.take(pa.array(ids_b))), ",")
        window_end = np.searchsorted(shared, end_a[np.cumsum(size_a) - 1]) + 1
        groups = np.diff(np.concatenate([[0], window_end]))
        text = pc.binary_join(pa.ListArray.from_arrays(bound(groups), pc.binary_join_element_wise(text_a, text_b, "|")), ";")
        links = each_a * each_b
        of_group = np.repeat(np.arange(n), groups)
        # pairs of groups of few links: every A token beside every B token
        few = links <= LISTED
        first_a, first_b = np.cumsum(each_a) - each_a, np.cumsum(each_b) - each_b
        left = np.flatnonzero(few[group_a])
        reach = each_b[group_a[left]]
        a = np.repeat(ids_a[left], reach)
        b = ids_b[ragged(first_b[group_a[left]], reach)]
        owner, pair, times = np.repeat(of_group[group_a[left]], reach), a * self.codes + b, np.ones(len(a), np.int64)
        for g in np.flatnonzero(~few).tolist():  # of many: distinct ids with how often they occur
            (x, p), (y, q) = (np.unique(ids[f : f + e], return_counts=True) for ids, f, e in ((ids_a, first_a[g], each_a[g]), (ids_b, first_b[g], each_b[g])))
            pair = np.concatenate([pair, (x[:, None] * self.codes + y).ravel()])
            times = np.concatenate([times, np.outer(p, q).ravel()])
            owner = np.concatenate([owner, np.full(len(x) * len(y), of_group[g])])
        order = np.lexsort((pair, owner))
        owner, pair, times = owner[order], pair[order], times[order]
        heads = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])]))
        self.text = pa.concat_arrays([self.text, text])
        self.groups, self.links = np.concatenate([self.groups, groups]), np.concatenate([self.links, np.bincount(of_group, links, minlength=n).astype(np.int64)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(owner[heads], minlength=n))])
        self.pairs, self.times = np.concatenate([self.pairs, pair[heads]]), np.concatenate([self.times, np.add.reduceat(times, heads)])


# -- Spark -------------------------------------------------------------------------------------------------------------
NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def align(docs: DataFrame, a: str, b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`id`, n_a, n_b, n_groups, n_links, groups_sha256 of every row, and its distinct linked pairs: `pairs` (A id times B's
    vocabulary plus B id, ascending) and `times`, how many links are of each."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        aligner = _kept(("aligner", a, b), lambda: Aligner(a, b))
        for batch in batches:
            for part in slices(batch, text):
                got = aligner(text_or_empty(part.column(text)))
                lists = [pa.ListArray.from_arrays(pa.array(got["bounds"], pa.int32()), pa.array(got[c], t)) for c, t in (("pairs", pa.int64()), ("times", pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(id), *(pa.array(got[c], pa.int64()) for c in NUMBERS), pa.array(got["digest"], pa.string()), *lists], [id, *NUMBERS, "groups_sha256", "pairs", "times"])

    return docs.select(id, text).mapInArrow(run, f"`{id}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(aligned: DataFrame, codes: int) -> DataFrame:
    """(pair, n, best) over all rows of align(): in how many of them a pair is linked, and whether no pair of its A id has more."""
    counts = cut(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    a = F.floor(F.col("pair") / codes)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # a row an id of A
    return counts.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def most_counted(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts above the least n that at most `most` rows reach; the numbers of rows for each n, in steps, decide."""
    level = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.log2("n") * 12)).cast("int")
    held, least = 0, 1 << 30
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        held += row["count"]
        if held > most:
            break
        least = row["level"]
    return counts.where(level >= least)


def scored(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """aligned (a written table) with n_best and count_sum in place of its pairs."""
    spark = aligned.sparkSession
    counts = cut(counts)
    held = most_counted(counts, frequent).toPandas().sort_values("pair")
    shared = spark.sparkContext.broadcast(tuple(held[c].to_numpy() for c in ("pair", "n", "best")))
    columns = [c for c in aligned.columns if c not in ("pairs", "times")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name in columns)

    def run(batches):
        pair, n, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            bounds = lists.offsets.to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            pairs = lists.flatten().to_numpy()
            times = batch.column("times").flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(pair, pairs), max(0, len(pair) - 1))
            seen = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
            at, own = at[seen], owner[seen]
            sums = []
            for x in (times[seen] * best[at], times[seen] * n[at]):
                ends = np.concatenate([[0], np.cumsum(x)])
                sums.append(np.diff(ends[np.searchsorted(own, np.arange(batch.num_rows + 1))]))
            rest = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[~seen], minlength=batch.num_rows))]), pa.int32())
            more = [pa.ListArray.from_arrays(rest, pa.array(x[~seen], t)) for x, t in ((pairs, pa.int64()), (times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array(x.astype(np.int64)) for x in sums), *more], [*columns, "n_best", "count_sum", "pairs", "times"])

    part = cut(aligned.mapInArrow(run, f"{fields}, n_best long, count_sum long, pairs array<long>, times array<int>").withColumn("row", F.monotonically_increasing_id()))
    rare = part.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = rare.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    added = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(x)
    return part.join(sums, "row", "left").select(*columns, added("n_best", "more_best"), added("count_sum", "more_sum"))


def op11_space_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document aligned, with the corpus's counts of its links."""
    import public_tokenizers

    a, b = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    aligned = cut(align(documents(spark, sf_dir), a, b))
    return scored(aligned, pair_counts(aligned, len(Pieces(b).sizes)))
