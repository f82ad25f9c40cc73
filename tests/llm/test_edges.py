"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; and line dedup against a plain version."""

import math
import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from mediaflow.llm import bpe, chat, line_dedup, minhash, packing, quality_rules, spotsigs
from mediaflow.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id string, c string, n string, kept string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", "i", "c", "n", "x") for i, t in rows], SCHEMA)


def words(seed, n):
    rng = random.Random(seed)
    return [rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(60)) for _ in range(n)]


LONG = " ".join(words(1, 30000))
ROWS = [(None, None), (1, None), (2, ""), (3, "one"), (3, "one"), (4, LONG), (5, LONG), (6, "a\n\nb " * 10), (7, "\n"), (7, "other text of the same id")]


def test_empty_tables(spark):
    none = table(spark, ROWS).where("false")
    assert quality_rules.keep_good(none).count() == 0
    assert minhash.near_components(none).count() == 0 and minhash.keep_representatives(none).count() == 0
    assert line_dedup.dedup(none).count() == 0
    assert spotsigs.with_next(none.select("doc_id", "text"), "doc_id", {"s": spotsigs.signatures(F.col("text"))}).count() == 0
    lexicon = bpe.build_lexicon(none, bpe.tokenizer_path())
    assert bpe.encode(none, bpe.tokenizer_path(), lexicon).count() == 0 and packing.pack(none, bpe.tokenizer_path()).count() == 0
    assert [len(r.ids) > 0 for r in bpe.encode(table(spark, [(1, "a b"), (1, "a b"), (2, None)]), bpe.tokenizer_path(), lexicon).collect()] == [True, True, False]
    assert chat.expand(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_odd_rows(spark):
    docs = table(spark, ROWS).repartition(3)
    judged = quality_rules.judge(docs, measured=True, verdict="verdict")
    assert judged.count() == len(ROWS) and judged.where("text is null and (verdict or n_words > 0)").count() == 0
    assert quality_rules.keep_good(docs).columns == docs.columns
    found = minhash.near_components(docs).collect()
    assert len(found) == len(ROWS)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert by[2] == {(0, 2)} and by[3] == {(1, 3)} and {c for _, c in by[4] | by[5]} == {4} and by[None] == {(0, None)}
    kept = minhash.keep_representatives(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 3, 4, 6, 7, 7]
    left = line_dedup.dedup(docs)
    assert left.columns == docs.columns and sorted(r.doc_id or -1 for r in left.collect()) == [-1, 1, 2, 3, 3, 4, 6, 7, 7]
    prints = spotsigs.with_next(docs.select("doc_id", "text"), "doc_id", {"s": spotsigs.signatures(F.col("text"))})
    assert prints.count() == len(ROWS)


def test_similar_pairs_match_brute_force(spark):
    base = words(3, 200)
    texts = []
    for i in range(24):
        rng = random.Random(i)
        own = [w if rng.random() > 0.01 * (i % 6) else "zz" + str(rng.randrange(99)) for w in base]
        texts.append(" ".join(x for w in own for x in (["the", w] if len(w) % 2 else [w])))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", spotsigs.fingerprint(F.col("text")).alias("fingerprint"))
    sets = {r.doc_id: set(r.fingerprint.split()) for r in docs.collect()}
    first = {}
    for d, s in sorted(sets.items()):
        first.setdefault(frozenset(s), d)
    want = {(a, b) for a, b in combinations(sorted(first.values()), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(r.a, r.b) for r in spotsigs.similar_pairs(docs).collect()} == want and want


def test_chat_round_trip(spark):
    odd = ["", None, "<|im_end|>\n", "\\<|", "<\\|im_start|>", "a\\", "<", "|im_end|>", "line\nline", "\\\\<|<\\|"]
    roles = ["user", "assistant", "sys\ntem", None, "assistant", "<|nl|>", "assistant", "assistant", "user", "user"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(roles, odd, strict=True))] + [(None, 0, "user", "x"), (2, 5, "assistant", "b"), (2, 5, "assistant", "a"), (2, 5, "assistant", "a")]
    out = chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    examples = out.select("*", chat.parse_turns(F.col("text")).alias("t"), chat.loss_text().alias("loss")).collect()
    own = sorted((r for r in examples if r.conv_id == 1), key=lambda r: r.n_turns)
    assert [(x.role, x.text) for x in own[-1].t] == [(r or "", t or "") for r, t in zip(roles, odd, strict=True)]
    assert [r.loss for r in own if r.example] == [t or "" for r, t in zip(roles, odd, strict=True) if r == "assistant"]
    assert [r.loss for r in sorted((r for r in examples if r.conv_id == 2), key=lambda r: r.example)] == ["a", "a", "b"]
    assert [(r.example, r.loss_length) for r in examples if r.conv_id is None] == [(0, 0)]


def test_components_match_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1100)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.c for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_dedup(rows, similarity=0.9):
    """Groups of equal or alike lines, by brute force over all pairs; of each, the first occurrence stays."""
    norm = lambda line: " ".join(re.findall(r"[^\W_]+", line.lower()))
    lines = {n: n for _, text in rows for n in map(norm, text.split("\n")) if len(n.split()) >= 5}

    def root(n):
        while lines[n] != n:
            n = lines[n]
        return n

    for a, b in combinations(list(lines), 2):
        most = math.floor((1 - similarity) * max(len(a), len(b)) + 1e-9)
        if abs(len(a) - len(b)) <= most and edits(a, b) <= most:
            lines[root(b)] = root(a)
    seen, out = {}, {}
    for d, text in sorted(rows):
        kept = []
        for i, line in enumerate(text.split("\n")):
            n = norm(line)
            if n in lines and seen.setdefault(root(n), (d, i)) != (d, i):
                continue
            kept.append(line)
        out[d] = "\n".join(kept)
    return out


def test_line_dedup_exact_lines(spark):
    rng = random.Random(4)
    pool = [" ".join(words(100 + k, rng.choice([3, 8, 30]))) for k in range(40)]
    rows = [(d, "\n".join(rng.choice([str.upper, str, lambda x: x + "!"])(rng.choice(pool)) for _ in range(6)) + f"\nunique line of the document number {d} xx{d}{d * 7}") for d in range(40)]
    got = {r.doc_id: r.text for r in line_dedup.dedup(table(spark, rows), drop_emptied=False).collect()}
    assert got == plain_dedup(rows)


def test_line_dedup_fuzzy_and_emptied(spark):
    line = " ".join(words(77, 120))
    near = line.replace(line.split()[50], line.split()[50] + "x", 1)
    rows = [(1, line + "\nshort tail"), (2, near + "\nshort tail"), (3, near + "\nanother quite long line that only this document has"), (4, "short tail")]
    got = {r.doc_id: r.text for r in line_dedup.dedup(table(spark, rows)).collect()}
    assert got == {1: rows[0][1], 3: "another quite long line that only this document has", 4: "short tail"}
    assert line_dedup.dedup(table(spark, rows), drop_emptied=False).count() == 4


@pytest.mark.parametrize("n", [11, 21, 51])
def test_line_dedup_recall_at_production_values(spark, n):
    """Two rows for each line: it and a near one. Of those that brute force finds 0.9 alike, the second goes."""
    rng = random.Random(n)
    spell = lambda: "".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randrange(3, 9)))
    rows, pairs = [], []
    for k in range(240):
        one = [spell() for _ in range(n)]
        two = list(" ".join(one))
        if k % 2:
            w = one.copy()
            w[rng.randrange(n)] = spell()
            two = list(" ".join(w))
        else:
            for _ in range(1 + k // 2 % 3):
                two[rng.choice([i for i, c in enumerate(two) if c != " "])] = rng.choice("qxz")
        a, b = " ".join(one), "".join(two)
        pairs.append((a, b, 2 * k + 1))
        rows += [(2 * k, a), (2 * k + 1, b)]
    alike = F.expr("a <> b AND levenshtein(a, b) <= 0.1D * greatest(length(a), length(b))")
    wanted = {r.d for r in spark.createDataFrame(pairs, "a string, b string, d long").where(alike).collect()}
    gone = set(range(480)) - {r.doc_id for r in line_dedup.dedup(table(spark, rows)).collect()}
    print("recall", n, len(gone & wanted), len(wanted))
    assert len(wanted) > 150 and gone <= wanted and len(gone) >= 0.95 * len(wanted)


def test_pipeline_keeps_short_lines_of_emptied_documents(spark):
    import corpus_pipeline

    shared = "a licence line that several of the documents have in common"
    rows = [(1, shared), (2, shared + "\nshort verse\nof its own"), (3, shared + "\n \n"), (4, None), (5, " ")]
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, table(spark, rows), None).collect()}
    assert got == {1: shared, 2: "short verse\nof its own", 4: None, 5: " "}


def test_line_group_of_thousands(spark):
    line = " ".join(words(5, 40))
    rows = [(d, line + "\n" + " ".join(words(1000 + d, 12))) for d in range(3000)]
    left = line_dedup.dedup(table(spark, rows).repartition(8))
    assert left.where(F.col("text").contains(line.split()[0] + " " + line.split()[1])).count() == 1 and left.count() == 3000


@pytest.mark.parametrize("order", [0, 1])
def test_cascade_order_is_free(spark, order):
    import pyarrow as pa

    texts = pa.array(["a b c " * 30, " ".join(words(8, 80)), "%%% " * 60, "SHOUT " * 60, None])
    rules = quality_rules.RULES if order == 0 else quality_rules.RULES[::-1]
    assert quality_rules.cascade(texts, rules).tolist() == [False, True, False, False, False]


def test_columns_with_the_operators_own_names(spark):
    """Each new column takes the place of one of its name; the others stay."""
    from mediaflow.llm import bpe, quality_classifier, toxicity

    rows = [(1, "Some words, and more of them.", 7.5, "x", 3, "d"), (2, None, 1.0, "y", 4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score double, hits string, n_words int, decoded string")
    scored = quality_classifier.score(docs, quality_classifier.Model(None, None, 0.5))
    assert scored.columns == ["doc_id", "text", "hits", "n_words", "decoded", "score"] and [r.score for r in scored.collect()] == [0.5, 0.5]
    toxic = toxicity.score(docs, toxicity.Scorer({}, {}), spans=True)
    assert toxic.columns[-2:] == ["score", "hits"] and [(r.score, r.hits) for r in toxic.collect()] == [(0.0, []), (0.0, [])]
    judged = quality_rules.judge(docs, measured=True).select("doc_id", "n_words", "Score", "kept").collect()
    assert {(r.doc_id, r.n_words, r.Score) for r in judged} == {(1, 6, 7.5), (2, 0, 1.0)}
    path = bpe.tokenizer_path()
    coded = bpe.encode(docs, path, keep=("doc_id", "decoded"))
    assert {r.doc_id: r.decoded for r in bpe.decode(coded, path).select("doc_id", "decoded").collect()}[2] == ""


def test_next_of_text_ids_in_many_ranges(spark):
    docs = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("doc_id"), F.concat(F.lit("the text "), F.col("id").cast("string")).alias("text"))
    got = {r.doc_id: r.next_text for r in spotsigs.with_next(docs, "doc_id", {"n": F.length("text")}, rows_in_bucket=100).collect()}
    keys = sorted(got)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got == {k: texts[keys[(i + 1) % len(keys)]] for i, k in enumerate(keys)}


def test_pipeline_of_empty_and_odd_tables(spark):
    """An empty table gives no pieces; nulls, empty texts and repeated ids pass the stages that keep them."""
    import corpus_pipeline

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for docs in (table(spark, ROWS).where("false"), table(spark, ROWS)):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
        model = quality_classifier_of(docs, labels)
        kept = docs.where("text IS NOT NULL")
        for stage in (corpus_pipeline.rules, corpus_pipeline.lines, corpus_pipeline.near_duplicates):
            kept = stage(spark, docs, None)
            assert kept.columns == docs.columns and kept.count() <= docs.count()
        pieces = corpus_pipeline.pack(spark, docs, None)
        assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        assert model.prior == 0.5


def quality_classifier_of(docs, labels):
    from mediaflow.llm import quality_classifier

    return quality_classifier.train(docs, labels)


def test_merges_match_the_tokenizer():
    """Odd words of every kind, one by one and all together."""
    import pyarrow as pa

    from mediaflow.llm import bpe
    from mediaflow.llm.merges import Merger

    merger = Merger(bpe.tokenizer_path())
    rng = random.Random(8)
    odd = ["can't", "'s", "x'll", "''s", "a1b2", "ÀB!?", "<|endoftext|>", "a<|endoftext|>b", "日本語", "ﬁx", "İ", "a" * 9, "x" * 300, "éa", "--", "ß", "\x00a", "aÿ" * 80, "K", "n̈", "ab-cd", "!!!a"]
    made = ["".join(rng.choice("abcdeétß'!.1-Zz") for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    words = [*odd, *made]
    assert merger.own
    ids, bounds = merger(pa.array(words))
    for i, word in enumerate(words):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == merger.tokenizer.encode(word, add_special_tokens=False).ids, word


def test_two_lexicons_on_one_host(tmp_path, monkeypatch):
    import tempfile as tf

    import pyarrow as pa

    from mediaflow.llm import bpe

    monkeypatch.setattr(tf, "tempdir", str(tmp_path))
    one, two = (bpe.compile_lexicon([w], [[i]]) for i, w in enumerate(("one", "two")))
    held = bpe.mapped(one)
    other = bpe.mapped(two)
    again = bpe.mapped(one)  # the other one has removed its file
    assert [x.lookup(pa.array(["one", "two"])).tolist() for x in (held, other, again)] == [[0, -1], [-1, 0], [0, -1]]


def test_every_stretch_of_a_text_counts_for_its_signatures(spark):
    """Texts without one of the fixed anchor words: a change in any eighth of one changes its fingerprint."""
    own = [f"zz{w}" for w in words(11, 400)]
    texts = [" ".join(own)] + [" ".join(own[:i] + [f"yy{w}" for w in words(i, 50)] + own[i + 50 :]) for i in range(0, 400, 50)] + [" ".join(own[:3]) + " " + " ".join(f"xx{w}" for w in words(5, 500))]
    got = [r.f for r in spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(1).sortWithinPartitions("i").select(spotsigs.fingerprint(F.col("text")).alias("f")).collect()]
    assert len(set(got)) == len(texts) and all(len(f.split()) >= 45 for f in got)
    alike = [len(set(got[0].split()) & set(f.split())) / len(set(got[0].split()) | set(f.split())) for f in got[1:]]
    assert all(0.7 < x < 1 for x in alike[:-1]) and alike[-1] < 0.1
