"""Cross-tokenizer alignment against whole-text tokenising and a plain alignment."""

import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from mediaflow.llm import token_alignment
from mediaflow.llm.queries import QUERIES

ODD = [None, "", " ", "  ", "a", " a", "a  b", "a b ", "one two one two", "▁", "a ▁b", "<s> x </s> <|endoftext|> <unk>", "<0x41> ok", "日本 語 é́ x", "  x   y　 z", "😀 😀😀", "tab\tx \n y\r\n z", "\x00 a", "﻿x y", "it's don't 'll x's", "a" * 3000, "-" * 500 + " x", "x  " * 50, "\u0085 q", "１２ ３", "ﬁ ﬃ a"]


class Plain:
    def __init__(self):
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.paths = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
        self.a = Tokenizer.from_file(self.paths[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=self.paths[1])
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.octet = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}

    def ids(self, text):
        return self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)

    def octets(self, a, b):
        of_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in b)]
        return [bytes(self.octet[c] for c in self.a.id_to_token(i)) for i in a], of_b

    def groups(self, text):
        a, b = self.ids(text or "")
        if not text or any(b"".join(x) != (" " + text).encode() for x in self.octets(a, b)):
            return None
        ends = []
        for side in self.octets(a, b):
            at, own = 0, []
            for t in side:
                at += len(t)
                own.append(at)
            ends.append(own)
        out, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            out.append((a[i:x], b[j:y]))
            i, j = x, y
        return out

    def rows(self, docs):
        """{position: (n_a, n_b, n_groups, n_links, n_best, count_sum, digest)}"""
        found = [self.groups(t) for t in docs]
        held, best = Counter(), defaultdict(int)
        for groups in found:
            held.update({(x, y) for a, b in groups or [] for x in a for y in b})
        for (x, _), n in held.items():
            best[x] = max(best[x], n)
        for groups in found:
            if groups is None:
                yield 0, 0, 0, 0, 0, 0, ""
                continue
            links = [(x, y) for a, b in groups for x in a for y in b]
            text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
            yield (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest())


@pytest.fixture(scope="module")
def plain():
    return Plain()


def as_rows(df):
    return sorted((r.doc_id is None, r.doc_id or 0, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in df.collect())


def test_query_against_plain_version(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = sorted((False, d.doc_id, x) for d, x in zip(docs, plain.rows([d.text for d in docs]), strict=True))
    assert as_rows(QUERIES["op11_space_anchors"](spark, "/root/testdata/sf0.001")) == want


@pytest.mark.parametrize("frequent", [0, 40, 1 << 18])
def test_odd_texts(spark, plain, frequent):
    """Also with few or no pairs among the frequent ones, and a clashing column."""
    rng = random.Random(3)
    texts = [*ODD, *ODD[:9], *("".join(rng.choice("ab é日😀 \n\t'1.  ") for _ in range(rng.randrange(40))) for _ in range(400))]
    ids = [None if i % 50 == 7 else i // 2 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, [1]) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, pairs array<int>").repartition(4)
    a, b = plain.paths
    aligned = token_alignment.cut(token_alignment.align(docs, a, b))
    got = token_alignment.scored(aligned, token_alignment.pair_counts(aligned, 32000), frequent)
    assert as_rows(got) == sorted((i is None, i or 0, x) for i, x in zip(ids, plain.rows(texts), strict=True))
    none = token_alignment.cut(token_alignment.align(docs.where("false"), a, b))
    assert token_alignment.scored(none, token_alignment.pair_counts(none, 32000)).count() == 0


def test_memory_and_long_groups(monkeypatch, plain):
    """What is remembered makes no difference, nor whether pairs are listed or counted, nor a tokenizer without ranks."""
    texts = pa.array([t or "" for t in ODD] * 2, pa.string())
    seen = []
    for remembered, listed, ranks in ((1 << 19, 1 << 16, True), (1, 0, True), (40, 3, False)):
        monkeypatch.setattr(token_alignment, "REMEMBERED", remembered)
        monkeypatch.setattr(token_alignment, "LISTED", listed)
        aligner = token_alignment.Aligner(*plain.paths)
        if not ranks:
            aligner.a.ranks, aligner.a.tokenizer = None, plain.a
        parts = [aligner(texts.slice(i, 7).take(pa.array(range(min(7, len(texts) - i))))) for i in range(0, len(texts), 7)]
        seen.append([(p[k].tolist() if k != "digest" else p[k]) for p in parts for k in ("n_a", "n_b", "n_groups", "n_links", "digest", "pairs", "times")])
    assert seen[0] == seen[1] == seen[2]


def test_units_tokenise_as_whole_texts(plain):
    aligner = token_alignment.Aligner(*plain.paths)
    texts = pa.array([t or "" for t in ODD], pa.string())
    (a, b), (at_a, at_b) = aligner.tokens(texts)
    for i, t in enumerate(texts.to_pylist()):
        want = plain.ids(t)
        assert (b[at_b[i] : at_b[i + 1]].tolist()) == want[1]
        assert not t or a[at_a[i] : at_a[i + 1]].tolist() == want[0]
