"""The pipeline's stages, each against a plain reading of its input."""

import re
from collections import defaultdict

import corpus_pipeline
from mediaflow.llm.bpe import tokenizer_path

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut(stage(spark, docs, SF))
        if name != "packing":
            assert out.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
            after = {r.doc_id: r.text for r in out.collect()}
            assert set(after) <= set(before)
        if name == "quality_rules":
            assert all(labels.get(d) != 0 for d in after)
        elif name == "quality_classifier":
            assert len(after) >= 0.95 * len(before)
        elif name == "line_dedup":
            lines = defaultdict(int)
            for text in after.values():
                for line in (text or "").split("\n"):
                    n = " ".join(re.findall(r"[^\W_]+", line.lower()))
                    lines[n] += len(n.split()) >= 5
            assert max(lines.values()) == 1
        elif name == "minhash":
            sets = {d: shingles(t) for d, t in before.items()}
            kept = sorted(after)
            alike = lambda a, b: bool(a and b) and len(a & b) >= 0.8 * len(a | b)
            assert not any(alike(sets[a], sets[b]) for i, a in enumerate(kept) for b in kept[:i])
            assert all(any(alike(sets[d], sets[k]) for k in before if k != d) for d in set(before) - set(after))
        else:
            tokenizer = Tokenizer.from_file(tokenizer_path())
            total = {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in before.items()}
            got = defaultdict(int)
            for r in out.collect():
                got[r.doc_id] += r.length
            assert got == total
        docs, before = out, after
