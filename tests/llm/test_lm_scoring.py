"""Base scores against SQL, the model against a plain recount, and its probabilities against one."""

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from mediaflow.llm import lm_scoring as lm

SF = "/root/testdata/sf0.01"


def test_base_and_gain(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokens = {d: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [None] for d, t in texts.items()}
    c = Counter(t for d, ts in tokens.items() if crc32(str(d).encode()) % 7 != 2 for t in ts)
    n, v = sum(c.values()), len(c)
    gain = {True: [0.0, 0.0], False: [0.0, 0.0]}
    rows = lm.op10_context_mixing(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ts = tokens[r.doc_id]
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(c[t] > 0 for t in ts), n)
        assert math.isclose(r.base_score, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), rel_tol=1e-9)
        gain[r.held_out][0] += r.score
        # the base gives all unknown words one probability; spelt without a model, each byte costs eight bits more
        gain[r.held_out][1] += r.base_score - sum(8 * math.log10(2) * (len(t.encode()) + 1) for t in ts if t and not c[t])
    print(gain)
    assert gain[True][0] > gain[True][1]  # texts it has not learnt from


def test_spelling_is_a_probability():
    """Over all continuations of a prefix, the probabilities of the next byte sum to one."""
    model = lm.Model(14)
    words = [b"the", b"then", b"there", b"other", b"q"] * 3
    model.count(lm.Spelling(words))
    for step in range(5):
        model.learn(lm.Spelling(words), 0.3)
    total = 0.0
    for byte in range(256):
        spelling = lm.Spelling([b"th" + bytes([byte])])
        p = 1.0
        for node, bit, x, g, h in model._inputs(spelling, 0.0):
            z, q = model._mixed(x, g, h)
            q = np.clip((q + model.map[node, model._cell(z)]) / 2, 1e-5, 1 - 1e-5)
            p *= float(q[2] if bit[2] else 1 - q[2])
        total += p
    assert abs(total - 1) < 1e-9
    assert model.log10([b"then"])[0] > model.log10([b"zzzz"])[0]


@pytest.mark.parametrize("rows", [[], [(None, None, "x"), (1, "", "x"), (1, "a a", "x"), (1, "a a", "x"), (3, "w" * 50000, "x"), (2, "é A\x0bb", "x")]])
def test_edge_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    got = lm.score(docs, lm.crc_mod("doc_id", 7) != 2).collect()
    assert len(got) == len(rows)
    assert all(math.isfinite(r.score) and r.n_tokens >= 1 for r in got)


def small_model(n=40):
    rng = np.random.default_rng(3)
    names = [f"w{i}" for i in range(n)]
    counts = rng.integers(0, 50, n)
    symbols = lm.Symbols(counts, 9, 17)
    model = lm.WordModel(symbols, 12)
    texts = pa.array([" ".join(rng.choice([*names, "rare", "other"], 60)) for _ in range(80)])
    ids, hashes, starts, _ = lm.tokens_of(lm.Words(texts, lower=True), pa.array(names), symbols)
    tokens = lm.Context(symbols, ids, hashes, starts)
    for a in range(0, len(ids), 500):
        model.learn(tokens.part(a, a + 500), 0.1)
    return names, symbols, model


def plain_price(text, names, symbols, model):
    """The log10 probability of a text's symbols, token by token and bit by bit."""
    u = lambda x: x & ((1 << 64) - 1)
    a, b = int(lm._A), int(lm._B)
    place = {n: i for i, n in enumerate(names)}
    seen = [(int(symbols.of_listed[place.get(w, -1)]), xxhash.xxh3_64_intdigest(w.encode()) | 1) for w in text.split()] + [(symbols.end, 0)]
    total = 0.0
    for i, (symbol, _) in enumerate(seen):
        kind = int(symbols.classes[symbol])
        before = [(int(symbols.classes[s]) + 1, h) for s, h in seen[max(0, i - 3) : i][::-1]] + [(0, 0)] * 3
        contexts = [before[0][1], u((before[0][0] | before[1][0] << 10 | before[2][0] << 20) + 1), u(before[1][1] * b + 2)]
        total += float(symbols.rest[symbol])
        for k in range(lm.DEPTH):
            node, bit = 1 << k | kind >> (lm.DEPTH - k), kind >> (lm.DEPTH - 1 - k) & 1
            x, level = [float(symbols.share[node])], []
            for o, context in enumerate(contexts):
                h = u((context ^ u(node * b)) * a)
                at = u((h ^ h >> 31) * a) >> (64 - model.bits)
                n0, n1 = (float(v) for v in model.tables[o, at])
                x.append(math.log((n1 + 0.4) / (n0 + 0.4)))
                level.append(min(int(math.log2(n0 + n1 + 1)), 7))
            weights = model.by_count[level[0] * 8 + level[1]] + model.by_place[k * 8 + level[2]]
            z = min(max(sum(w * v for w, v in zip(weights, x, strict=True)), -12), 12)
            cell = round((min(max(z, -8), 8) + 8) * 2)
            p = min(max((1 / (1 + math.exp(-z)) + float(model.map[k, cell])) / 2, 1e-5), 1 - 1e-5)
            total += math.log10(p if bit else 1 - p)
    return total


def test_words_in_context_against_plain_mixing():
    names, symbols, model = small_model()
    rng = np.random.default_rng(5)
    texts = ["", "w1", *(" ".join(rng.choice([*names, "unseen"], 30)) for _ in range(6))]
    texts.append(" ".join(texts[-1].split()[::-1]))
    ids, hashes, starts, _ = lm.tokens_of(lm.Words(pa.array(texts), lower=True), pa.array(names), symbols)
    each = model.log10(lm.Context(symbols, ids, hashes, starts), ids)
    got = np.add.reduceat(each, starts)
    want = [plain_price(t, names, symbols, model) for t in texts]
    assert np.allclose(got, want, rtol=1e-4)
    assert abs(got[-1] - got[-2]) > 1e-3  # the same words in another order


def test_word_symbols_sum_to_one():
    names, symbols, model = small_model()
    tokens = np.arange(len(symbols.rest))
    texts = [f"w3 w5 {w}" for w in names] + ["w3 w5 rare"]
    ids, hashes, starts, _ = lm.tokens_of(lm.Words(pa.array(texts), lower=True), pa.array(names), symbols)
    each = model.log10(lm.Context(symbols, ids, hashes, starts), ids)[starts + 2]
    own = {int(i): 10.0**x for i, x in zip(ids[starts + 2], each, strict=True)}
    end, h, s, _ = lm.tokens_of(lm.Words(pa.array(["w3 w5"]), lower=True), pa.array(names), symbols)
    own[symbols.end] = 10.0 ** model.log10(lm.Context(symbols, end, h, s), end)[2]
    assert set(own) == set(tokens.tolist()) and abs(sum(own.values()) - 1) < 1e-3


def test_scores_depend_on_the_order_of_words(spark):
    rng = np.random.default_rng(1)
    phrase = [f"a{i} b{i} c{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(phrase, 40))) for i in range(300)]
    words = rows[0][1].split()
    rows += [(1000, " ".join(words)), (1001, " ".join(rng.permutation(words)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(docs, F.col("doc_id") < 1000).where("doc_id >= 1000").collect()}
    assert got[1000] > got[1001] + 10
