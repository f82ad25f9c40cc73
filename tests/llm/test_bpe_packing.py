"""BPE against the tokenizers library, packing against its own rules."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from mediaflow.llm import bpe, packing

ODD = ["", None, "   ", "a", "it's IT'S they'LL", "<|endoftext|>x<|startoftext|>", "<|ENDOFTEXT|>", "É é ǅ ß ẞ İ ϴΣ ΑΣ", "x y z\u0085w", "日本語 text 12345 ²³", "a\x00b \x1f c", "👩‍👩‍👧 🙂", "--- *** ''' 's 'd", "word " * 5000, "w" * 3000, "ạ́ ́x", "  ﻿", "Ａ１"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(bpe.tokenizer_path())


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "extra", "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string, n string")


@pytest.mark.parametrize("with_lexicon", [True, False])
def test_round_trip_matches_library(spark, reference, with_lexicon):
    docs = rows(spark, ODD).repartition(3)
    blob = bpe.build_lexicon(docs, bpe.tokenizer_path(), lexicon_words=20) if with_lexicon else None
    once = {r.doc_id: r.text for r in bpe.encode(docs, bpe.tokenizer_path(), blob, decoded="text").collect()}
    assert once == {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(docs, bpe.tokenizer_path(), blob), bpe.tokenizer_path()).collect()}
    got = {r.doc_id: (bytes(r.ids), r.decoded) for r in bpe.decode(bpe.encode(docs, bpe.tokenizer_path(), blob), bpe.tokenizer_path()).collect()}
    for i, text in enumerate(ODD):
        ids = reference.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (struct.pack(f"<{len(ids)}I", *ids), reference.decode(ids, skip_special_tokens=False)), repr(text)


def test_empty_table(spark):
    docs = rows(spark, []).where("false")
    assert bpe.decode(bpe.encode(docs, bpe.tokenizer_path(), bpe.build_lexicon(docs, bpe.tokenizer_path())), bpe.tokenizer_path()).count() == 0
    assert packing.pack(docs, bpe.tokenizer_path()).count() == 0


def test_transducer_is_minimal_and_exact():
    import pyarrow as pa

    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(500)})
    ids = [[rng.randrange(1000) for _ in range(rng.randint(0, 4))] for _ in words]
    machine = bpe.Transducer(bpe.compile_lexicon(words, ids))
    probe = words + [w + "b" for w in words] + ["", "zz", "é"]
    number = machine.lookup(pa.array(probe))
    known = dict(zip(words, ids, strict=True))
    for w, k in zip(probe, number, strict=True):
        assert (machine.ids[machine.starts[k] : machine.starts[k + 1]].tolist() if k >= 0 else None) == known.get(w)
    shared = bpe.Transducer(bpe.compile_lexicon(["aing", "bing", "cing"], [[1], [2], [3]]))
    assert (shared.keys != bpe.Transducer.EMPTY).sum() == 3 + 3  # the suffix is stored once


def check_packing(pieces, texts, reference, limit=4096, segments=128, loss=4096):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= limit and len(own) <= segments and sum(r.loss_tokens for r in own) <= loss
        padding += 0 if at & (at - 1) == 0 else limit - at
    return padding


def test_packing_rules(spark, reference):
    rng = random.Random(3)
    texts = [*ODD, *(" ".join("the of word zq".split()[rng.randrange(4)] for _ in range(rng.choice([0, 1, 5, 300, 2500, 9000]))) for _ in range(60))]
    pieces = packing.pack(rows(spark, texts).repartition(2), bpe.tokenizer_path()).collect()
    total = sum(r.length for r in pieces)
    assert check_packing(pieces, texts, reference) <= 0.003 * total + 40
    pieces = packing.pack(rows(spark, texts).coalesce(1), bpe.tokenizer_path(), max_segments=3, max_loss=1000, window=5000).collect()
    check_packing(pieces, texts, reference, segments=3, loss=1000)


def test_packing_loss_column(spark, reference):
    """Only replies bear loss: prompts don't fill the loss limit, and each piece's loss is its part of the reply."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the", "of", "word"]) for _ in range(rng.choice([1500, 1900, 6000]))) for _ in range(60)]
    tails = [(0, 50, 120, 900, 10**6, None)[i % 6] if i % 12 >= 6 else 90 for i in range(60)]
    docs = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(zip(texts, tails, strict=True))], "doc_id long, text string, reply long").coalesce(1)
    pieces = packing.pack(docs, bpe.tokenizer_path(), max_loss=1000, loss="reply").collect()
    check_packing(pieces, texts, reference, loss=1000)
    for r in pieces:
        bare = 0 if tails[r.doc_id] is None else max(0, r.doc_tokens - tails[r.doc_id])
        assert r.loss_tokens == max(0, r.start + r.length - max(r.start, bare))
    short = docs.where("reply = 90")
    pieces = packing.pack(short, bpe.tokenizer_path(), max_loss=1000, loss="reply").collect()
    total = sum(r.length for r in pieces)
    assert len({r.sequence_id for r in pieces}) <= total / 4096 + 12  # the last one's runs of powers of two among them
    assert sum(r.loss_tokens for r in pieces) == 90 * short.count()


def test_query_digests(spark, reference):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.op1_bpe(spark, sf).collect():
        ids = reference.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_many_tiny_texts_leave_no_room(spark):
    docs = spark.createDataFrame([(i, "the of") for i in range(3000)], "doc_id long, text string").coalesce(1)
    lengths = {}
    for r in packing.pack(docs, bpe.tokenizer_path()).collect():
        lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
    assert sum(lengths.values()) == 9000
    assert all(n >= 4092 or n & (n - 1) == 0 for n in lengths.values())


def test_three_limits_on_instruction_data(spark):
    """Conversations with their replies as loss: each of the limits binds somewhere, and none is broken."""
    from pyspark.sql import functions as F

    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"), F.max_by("text", "turn").alias("reply"))
    size = {r.conv_id: len(r.ids) // 4 for r in bpe.encode(whole.select("conv_id", F.col("reply").alias("text")), bpe.tokenizer_path(), keep=("conv_id",)).collect()}
    data = [(r.conv_id, r.text, size[r.conv_id] + 1) for r in whole.collect()] + [(-i, "a", 1) for i in range(1, 60)]
    docs = spark.createDataFrame(data, "conv_id long, text string, reply_tokens int").coalesce(1)
    most = {"length": 1024, "segments": 9, "loss_tokens": 300}
    held = {}
    for r in packing.pack(docs, bpe.tokenizer_path(), key="conv_id", max_tokens=1024, max_segments=9, max_loss=300, loss="reply_tokens").collect():
        own = held.setdefault(r.sequence_id, dict.fromkeys(most, 0))
        own["length"] += r.length
        own["segments"] += 1
        own["loss_tokens"] += r.loss_tokens
    assert all(own[k] <= most[k] for own in held.values() for k in most)
    assert all(any(own[k] >= 0.97 * most[k] for own in held.values()) for k in most)
    assert sum(own["loss_tokens"] for own in held.values()) == sum(n for _, _, n in data)
