"""Toxicity: an edit-tolerant lexicon, and context windows that tell quotation from abuse.

Terms are learnt from labelled documents: words whose document counts lean to toxic ones beyond chance. Terms of five letters
and more form a trie; its intersection with the Levenshtein automata of one edit is compiled into one deterministic
automaton, which all words of a batch walk together, so misspelled terms are found too. A misspelling that is a word of the
labelled documents itself has its own weight, which may clear it; the neighbours of the bounded lexicon bound those words.
Each hit is weighed in a window of eight words on both sides: quotation marks around it or a reporting word turn it into a
quoted hit, a second-person word raises it. A logistic model over the sums of both kinds gives the score.

Term counts are over all labelled documents given (the query gives at most `MOST_LABELLED`, those with the smallest id
hashes); the logistic model fits at most `most_rows` of them, chosen in the same way. Null and empty texts have no hits and get the model's score for that. Without toxic labels the score
is 0, and an empty table gives an empty one. Repeated rows score alike, and ids that repeat count once in the model's fit (the row
with the least features); ties between hashes go by the ids, between terms by the words. Other columns pass through; one with a
new column's name is replaced.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaflow.llm.common import Words, crc_mod, documents, slices, without
from mediaflow.llm.quality_classifier import adam, sigmoid

MOST_LABELLED, MOST_ROWS, WINDOW, FUZZY_LETTERS = 40_000, 20_000, 8, 5
EDGES = " .,;:!?\"'()[]{}*#$%&|<>«»„“”‘’…-_/\\"
QUOTES = "\"'«»„“”‘’"
#: Words that report speech, and words that address the reader.
REPORTING = "said says say wrote writes called quote quoted quotes word term slur sagte sagt schrieb nannte zitat wort dit écrit appelé mot citation dijo dice escribió llamó palabra cita".split()
ADDRESSING = "you your you're ur u du dich dein ihr sie tu te toi vous votre tú usted ustedes tus".split()


def plain(words: pa.Array) -> pa.Array:
    """Lower case, without punctuation at the edges."""
    return pc.utf8_trim(pc.utf8_lower(words), EDGES)


class FuzzyLexicon:
    """Deterministic automaton of all words within `edits` of a term (exact for terms shorter than FUZZY_LETTERS)."""

    def __init__(self, terms: list[str], edits: int = 1):
        self.terms = terms
        self.exact = {t: i for i, t in enumerate(terms)}
        children: list[dict[str, int]] = [{}]
        ends: dict[int, int] = {}
        for i, term in enumerate(terms):
            if len(term) < FUZZY_LETTERS:
                continue
            node = 0
            for c in term:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                node = children[node][c]
            ends[node] = i
        letters = sorted({c for t in terms for c in t})
        self.letter = np.zeros(0x110000, np.uint16)  # 0: any other character
        for k, c in enumerate(letters, 1):
            self.letter[ord(c)] = k
        self.width = len(letters) + 1

        def closed(items) -> frozenset:
            """With the letters that a word may leave out; a position is kept at its fewest edits."""
            best: dict[int, int] = {}
            stack = list(items)
            while stack:
                node, e = stack.pop()
                if best.get(node, edits + 1) <= e:
                    continue
                best[node] = e
                if e < edits:
                    stack += [(to, e + 1) for to in children[node].values()]
            return frozenset(best.items())

        def step(state: frozenset, c: str | None) -> frozenset:
            items = []
            for node, e in state:
                if c in children[node]:
                    items.append((children[node][c], e))
                if e < edits:
                    items.append((node, e + 1))  # a letter too many
                    items += [(to, e + 1) for to in children[node].values()]  # another letter
            return closed(items)

        start = closed([(0, 0)])
        number, queue, self.accept, rows = {start: 0}, deque([start]), [], []
        while queue:
            state = queue.popleft()
            hit = min(((e, ends[n]) for n, e in state if n in ends), default=None)
            self.accept.append(-1 if hit is None else hit[1] * (edits + 1) + hit[0])

            def go(to: frozenset) -> int:
                if not to:
                    return -1
                if to not in number:
                    number[to] = len(number)
                    queue.append(to)
                return number[to]

            other = go(step(state, None))
            row = np.full(self.width, other, np.int32)
            for c in {c for node, _ in state for c in children[node]}:
                row[self.letter[ord(c)]] = go(step(state, c))
            rows.append(row)
        self.table, self.accept, self.edits = np.array(rows), np.array(self.accept), edits

    def match(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each (plain) word: the number of a term within reach or -1, and its edits."""
        n = len(words)
        lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: 0 if not n else None]
        bounds = np.frombuffer(words.buffers()[1], np.int32, n + 1, words.offset * 4) if n else np.zeros(1, np.int32)
        points = np.frombuffer(flat[bounds[0] : bounds[-1]].tobytes().decode().encode("utf-32-le"), np.uint32)
        coded = self.letter[points]
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if n else np.zeros(0, np.int64)
        state = np.zeros(n, np.int64)
        found = np.full(n, -1)
        alive = np.arange(n)
        depth = 0
        while len(alive):
            ended = lengths[alive] == depth
            found[alive[ended]] = self.accept[state[alive[ended]]]
            alive = alive[~ended]
            to = self.table[state[alive], coded[first[alive] + depth]]
            alive, to = alive[to >= 0], to[to >= 0]
            state[alive] = to
            depth += 1
        term = np.where(found >= 0, found // (self.edits + 1), -1)
        edits = np.where(found >= 0, found % (self.edits + 1), 0)
        if any(len(t) < FUZZY_LETTERS for t in self.terms):
            short = pc.index_in(words, pa.array([t for t in self.terms if len(t) < FUZZY_LETTERS], pa.string()))
            numbers = np.array([i for i, t in enumerate(self.terms) if len(t) < FUZZY_LETTERS])
            at = short.fill_null(-1).to_numpy(zero_copy_only=False)
            term, edits = np.where(at >= 0, numbers[at], term), np.where(at >= 0, 0, edits)
        return term, edits


class Scorer:
    """Features of texts, and with `weights` their scores. own: weights of words near a term that have counts of their own."""

    NAMES = 7

    def __init__(self, terms: dict[str, float], own: dict[str, float], lexicon: FuzzyLexicon | None = None):
        self.terms, self.own, self.weights = terms, own, None
        self.lexicon = lexicon or (FuzzyLexicon(list(terms)) if terms else None)
        self.values = np.array(list(terms.values()))

    def hits(self, texts: pa.Array) -> list[tuple[int, str, float, bool, bool]]:
        """(text, word, weight, misspelled, quoted) of each hit."""
        if not self.lexicon:
            return []
        words = Words(texts, lower=True)
        bare = plain(words.dictionary)
        bare = pa.concat_arrays([bare]) if bare.offset else bare
        term, edits = self.lexicon.match(bare)
        near = np.flatnonzero(term >= 0)
        weight = np.zeros(len(term))
        for k in near:
            word = bare[int(k)].as_py()
            base = self.values[term[k]] * (1.0 if edits[k] == 0 else 0.6)
            weight[k] = self.own.get(word, base)
        out = []
        at = np.flatnonzero(weight[words.codes] > 0)
        owner = np.searchsorted(words.bounds, at, "right") - 1
        for p, text in zip(at.tolist(), owner.tolist(), strict=True):
            a, b = max(int(words.bounds[text]), p - WINDOW), min(int(words.bounds[text + 1]), p + WINDOW + 1)
            around = words.dictionary.take(pa.array(words.codes[a:b])).to_pylist()
            here = p - a
            opens = any(x[0] in QUOTES for x in around[: here + 1])
            closes = any(x.rstrip(".,;:!?")[-1:] in tuple(QUOTES) for x in around[here:])
            bare_around = {x.strip(EDGES) for x in around}
            quoted = opens and closes or bool(bare_around & _REPORTING)
            k = words.codes[p]
            out.append((text, bare[int(k)].as_py(), float(weight[k]) * (1.3 if bare_around & _ADDRESSING else 1.0), bool(edits[k]), quoted))
        return out

    def features(self, texts: pa.Array) -> np.ndarray:
        x = np.zeros((len(texts), self.NAMES))
        for text, _, weight, misspelled, quoted in self.hits(texts):
            x[text, 2 if quoted else 1 if misspelled else 0] += weight
            x[text, 3 if quoted else 4] = max(x[text, 3 if quoted else 4], weight)
            x[text, 5] += 1
        x[:, :3] = np.log1p(x[:, :3])
        x[:, 5] = np.log1p(x[:, 5])
        x[:, 6] = 1
        return x

    def score(self, texts: pa.Array) -> np.ndarray:
        return np.zeros(len(texts)) if self.weights is None else sigmoid(self.features(texts) @ self.weights)


_REPORTING, _ADDRESSING = frozenset(REPORTING), frozenset(ADDRESSING)


def word_counts(labelled: DataFrame, most: int = 200_000) -> DataFrame:
    """(word, toxic, other): documents of each kind that have the plain word. labelled: text, toxic."""

    def tally(batches):
        held: dict[str, list[int]] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], ["word", "toxic", "other"])

        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), lower=True)
                toxic = part.column("toxic").to_numpy(zero_copy_only=False) == 1
                coded = plain(words.dictionary).dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False)[words.codes].astype(np.int64)
                n = len(coded.dictionary) + 1
                pairs = pc.unique(pa.array(words.owners() * n + codes)).to_numpy()
                which = toxic[pairs // n]
                counts = [np.bincount(pairs[w] % n, minlength=n - 1).tolist() for w in (which, ~which)]
                for word, a, b in zip(coded.dictionary.to_pylist(), *counts, strict=True):
                    if word in held:
                        held[word][0] += a
                        held[word][1] += b
                    else:
                        held[word] = [a, b]
                if len(held) > most:
                    yield out()
                    held = {}
        yield out()

    return labelled.select("text", "toxic").mapInArrow(tally, "word string, toxic long, other long").where("word <> ''").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def train(labelled: DataFrame, key: str = "doc_id", most_rows: int = MOST_ROWS) -> Scorer:
    """labelled: key, text, toxic (0/1)."""
    from mediaflow.llm.common import cut, drop_cut

    totals = labelled.agg(F.sum((F.col("toxic") == 1).cast("long")), F.sum((F.col("toxic") != 1).cast("long"))).first()
    n_toxic, n_other = totals[0] or 0, totals[1] or 0
    if not n_toxic or not n_other:
        return Scorer({}, {})
    counts = cut(word_counts(labelled))
    n_words = counts.count()
    a, b = F.col("toxic").cast("double"), F.col("other").cast("double")
    lean = F.log((a + 0.5) / (n_toxic + 1)) - F.log((b + 0.5) / (n_other + 1))
    rate = n_toxic / (n_toxic + n_other)
    share = a / (a + b)
    surprise = 2 * (a * F.log(share / rate) + F.when(b > 0, b * F.log((1 - share) / (1 - rate))).otherwise(0.0))
    enough = 2 * math.log(n_words + 1) + 4
    top = counts.where((a >= 3) & (share >= 0.6)).select("word", lean.alias("lean"), surprise.alias("g")).where(F.col("g") > enough).collect()  # all of them: the labelled documents given bound them
    terms = {r.word: r.lean for r in sorted(top, key=lambda r: r.word)}
    if not terms:
        drop_cut(counts)
        return Scorer({}, {})
    # words within reach of a term, with weights of their own: at most the terms' neighbours, which the alphabet bounds
    lexicon = FuzzyLexicon(list(terms))  # compiled once; tasks get its tables
    probe = labelled.sparkSession.sparkContext.broadcast(lexicon)

    def within(batches):
        for batch in batches:
            words = batch.column("word")
            term, _ = probe.value.match(pa.concat_arrays([words]) if words.offset else words)
            yield batch.filter(pa.array(term >= 0))

    near = counts.where(a + b >= 3).select("word", lean.alias("lean")).mapInArrow(within, "word string, lean double").collect()
    own = {r.word: r.lean if r.word in terms else min(r.lean, 4.0) for r in near}
    drop_cut(counts)
    scorer = Scorer(terms, own, lexicon)
    ids = labelled.select(key).distinct().orderBy(F.xxhash64(key), key).limit(most_rows)
    shared = labelled.sparkSession.sparkContext.broadcast(scorer)

    def measure(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x = shared.value.features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("toxic").cast(pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), Scorer.NAMES).cast(pa.list_(pa.float64()))], [key, "toxic", "x"])

    schema = T.StructType([labelled.schema[key], *T._parse_datatype_string("toxic int, x array<double>").fields])
    each = labelled.join(F.broadcast(ids), key, "left_semi").select(key, "toxic", "text").mapInArrow(measure, schema)
    rows = each.groupBy(key).agg(F.min(F.struct("toxic", "x")).alias("r")).select("r.*").toPandas()
    x, y = np.array([*rows["x"]]).reshape(len(rows), -1), rows["toxic"].to_numpy().astype(float)
    order = np.lexsort([y, *x.T])
    x, y = x[order], y[order]
    scorer.weights = adam(np.zeros(Scorer.NAMES), lambda w: x.T @ (sigmoid(x @ w) - y) / len(y) + 1e-4 * w, 800)
    return scorer


def score(docs: DataFrame, scorer: Scorer, text: str = "text", column: str = "score", spans: bool = False) -> DataFrame:
    """docs with `column`, and with `spans` also `hits`: (word, weight, misspelled, quoted) of each."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    docs = without(docs, column, *(["hits"] if spans else []))
    columns = docs.columns
    hit = pa.struct([("word", pa.string()), ("weight", pa.float64()), ("misspelled", pa.bool_()), ("quoted", pa.bool_())])

    def run(batches):
        worker = shared.value
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(text)
                more = [pa.array(worker.score(texts), pa.float64())]
                if spans:
                    by = defaultdict(list)
                    for t, *rest in worker.hits(texts):
                        by[t].append(dict(zip(("word", "weight", "misspelled", "quoted"), rest, strict=True)))
                    more.append(pa.array([by[i] for i in range(len(texts))], pa.list_(hit)))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*columns, column, *(["hits"] if spans else [])])

    fields = [T.StructField(column, T.DoubleType())]
    if spans:
        fields.append(T.StructField("hits", T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("misspelled", T.BooleanType()), T.StructField("quoted", T.BooleanType())]))))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def sample_labels(labels: DataFrame, most: int = MOST_LABELLED, key: str = "doc_id") -> DataFrame:
    """At most `most` rows, those with the smallest id hashes; few more than that leave their partitions."""
    n = labels.count()
    hashed = F.xxhash64(key)
    if n > most:
        labels = labels.where(F.pmod(hashed, F.lit(n)) < int(1.1 * most) + 100)
    return labels.orderBy(F.pmod(hashed, F.lit(max(n, 1))), key).limit(most)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learnt from labels whose ids aren't held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.col("toxic").isNotNull() & (crc_mod("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    scorer = train(docs.join(F.broadcast(sample_labels(labels)), "doc_id"))
    return score(docs, scorer).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
