"""Byte-pair merges of many words at once.

All words of a batch are merged together, a merge of each in every step: the pair of the least rank, the leftmost of equal ones,
as one word alone would be. Words that the fixed patterns below don't cover, and tokenizer files of another make, go through the
tokenizer itself, so the ids are always those that it gives.

Words aren't null and hold no white space; an empty word has no ids, repeated words have the same ones, no words give none.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from mediaflow.llm.common import ragged

#: The split pattern, and what else a tokenizer file must say for its words to be merged here.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS, SUFFIX = ["NFC", "Replace", "Lowercase"], "</w>"
#: Words of letters up to U+00FF alone, and those with marks after them; any words of these characters; their pieces.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
ONE = f"^[{LETTERS}]+$"
TWO = rf"^(?P<a>[{LETTERS}]+)(?P<b>[!-&(-/:-@\[-`{{-~]+)$"
PLAIN = re.compile(f"[!-~{LETTERS}]+")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: Longer pieces (bytes) go through the tokenizer.
LONGEST = 256
NEVER = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(other)) for b in range(256)]


class Merger:
    """ids of white-space-free words, exactly as the tokenizer gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.special = [t["content"] for t in made.get("added_tokens") or []]
        self.own = self._covers(made)
        if self.own:
            vocab, merges = made["model"]["vocab"], made["model"]["merges"]
            pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in merges]
            keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
            order = np.argsort(keys, kind="stable")
            self.keys, self.ranks = keys[order], order.astype(np.int32)
            self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
            letters = byte_letters()
            self.inner = np.array([vocab[x] for x in letters], np.int32)
            self.last = np.array([vocab[x + SUFFIX] for x in letters], np.int32)

    def _covers(self, made: dict) -> bool:
        """Whether the file splits, folds and merges as this module does."""
        model, before, fold = made["model"], made.get("pre_tokenizer") or {}, made.get("normalizer") or {}
        steps = before.get("pretokenizers") or [before]
        plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        return (
            model["type"] == "BPE" and plain and model.get("end_of_word_suffix") == SUFFIX
            and [n["type"] for n in fold.get("normalizers", [])] == NORMALIZERS
            and [s.get("type") for s in steps] == ["Split", "ByteLevel"] and (steps[0].get("pattern") or {}).get("Regex") == SPLIT
            and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
            and all(re.search(r"[^A-Za-z]", s) for s in self.special)
        )

    def merge(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in turn, and each word's bounds in them."""
        n = len(words)
        pieces, of_word, given = [], [], {}  # arrays of pieces, the words they belong to, ids of words that the tokenizer merged
        rest = np.arange(n)
        if self.own and n:
            one = pc.match_substring_regex(words, ONE).to_numpy(zero_copy_only=False)
            found = pc.extract_regex(words, TWO)
            two = found.is_valid().to_numpy(zero_copy_only=False)
            for mask, column in ((one, words), (two, found.field("a")), (two, found.field("b"))):
                pieces.append(pc.utf8_lower(column.filter(pa.array(mask))))
                of_word.append(np.flatnonzero(mask))
            rest = np.flatnonzero(~(one | two))
        split, owners = [], []
        for i, word in zip(rest.tolist(), words.take(pa.array(rest)).to_pylist(), strict=True):
            if self.own and PLAIN.fullmatch(word) and not any(s in word for s in self.special):
                parts = PIECES.findall(word.lower())
                if max(map(len, parts)) * 2 <= LONGEST:
                    split += parts
                    owners += [i] * len(parts)
                    continue
            given[i] = self.merge(word)
        pieces.append(pa.array(split, pa.string()))
        of_word.append(np.array(owners, np.int64))
        all_ = pa.concat_arrays([pa.array(p, pa.string()) if not isinstance(p, pa.Array) else p.cast(pa.string()) for p in pieces])
        owner = np.concatenate(of_word).astype(np.int64)
        flat, bounds = self.pieces(all_) if self.own else (np.zeros(0, np.int32), np.zeros(1, np.int64))
        if given:
            more = [np.array(x, np.int32) for x in given.values()]
            owner = np.concatenate([owner, np.fromiter(given, np.int64, len(given))])
            bounds = np.concatenate([bounds, bounds[-1] + np.cumsum([len(x) for x in more])]).astype(np.int64)
            flat = np.concatenate([flat, *more])
        order = np.argsort(owner, kind="stable")  # a word's pieces stay in their order
        starts, sizes = bounds[:-1][order], np.diff(bounds)[order]
        ids = flat[ragged(starts, sizes)]
        each = np.bincount(owner[order], sizes, minlength=n).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(each)])

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces (in lower case, each one a word to the merges) in turn, and their bounds."""
        n = len(texts)
        if not n:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        sizes = np.diff(offsets)
        found, rows, counts = [], [], np.zeros(n, np.int64)
        low = 0
        for high in (4, 6, 8, 10, 12, 16, 24, 32, 64, 128, LONGEST):
            at = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            if len(at):
                ids, each = self._merged(data, offsets[at], sizes[at], int(sizes[at].max()))
                found.append(ids)
                rows.append(at)
                counts[at] = each
        for i in np.flatnonzero(sizes > LONGEST).tolist():
            ids = np.array(self.merge(texts[i].as_py()), np.int32)
            found.append(ids)
            rows.append(np.array([i]))
            counts[i] = len(ids)
        flat, order = np.concatenate(found), np.concatenate(rows)
        ends = np.cumsum(counts[order])
        starts = np.zeros(n, np.int64)
        starts[order] = ends - counts[order]
        return flat[ragged(starts, counts)], np.concatenate([[0], np.cumsum(counts)])

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NEVER)

    def _merged(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(starts)
        at = np.minimum(starts[:, None] + np.arange(width), len(data) - 1)
        column = np.arange(width)
        alive = column < sizes[:, None]
        symbols = np.where(column == sizes[:, None] - 1, self.last[data[at]], self.inner[data[at]])
        after = np.tile((column + 1).astype(np.int16), (n, 1))
        before = np.tile((column - 1).astype(np.int16), (n, 1))
        ranks = np.full((n, width), NEVER)
        pair = alive[:, 1:]
        ranks[:, :-1][pair] = self._rank(symbols[:, :-1][pair], symbols[:, 1:][pair])
        rows = np.arange(n)
        while True:
            here = ranks[rows]
            j = here.argmin(1)
            rank = here[np.arange(len(rows)), j]
            some = rank < NEVER
            rows, j, rank = rows[some], j[some], rank[some]
            if not len(rows):
                break
            gone = after[rows, j].astype(np.int64)
            symbols[rows, j] = self.made[rank]
            alive[rows, gone] = False
            ranks[rows, gone] = NEVER
            ranks[rows, j] = NEVER
            next_ = after[rows, gone].astype(np.int64)
            after[rows, j] = next_
            has = next_ < sizes[rows]
            r, a, b = rows[has], j[has], next_[has]
            before[r, b] = a
            ranks[r, a] = self._rank(symbols[r, a], symbols[r, b])
            last = before[rows, j].astype(np.int64)
            has = last >= 0
            r, a, b = rows[has], last[has], j[has]
            ranks[r, a] = self._rank(symbols[r, a], symbols[r, b])
        return symbols[alive], alive.sum(1)
