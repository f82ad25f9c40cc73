"""SpotSigs fingerprints, in DataFrame functions alone.

Common words are anchors, and so are the start of a text and every place after `STRETCH` words in a row that aren't, so that texts
of any language have signatures from their start to their end. An anchor's signature is the anchor with the chain of the first
`CHAIN` other words after it (looked for up to the third anchor from there). A text's fingerprint is the set of its
signatures, written as sorted 8-digit hashes with spaces between; likeness is the Jaccard likeness of two such sets.

`similar_pairs` finds the pairs over a threshold: fingerprints are partitioned by set length (sets whose lengths differ too
much can't be alike), and within neighbouring partitions meet through their rarest signatures alone (the prefix that one of
any alike pair must share), before the exact comparison.

Words are runs of letters and digits, in lower case. Null and empty texts have the empty fingerprint; two empty
fingerprints are alike (1). Repeated rows get equal results;
for the next document, rows with one id follow each other by text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mediaflow.llm.common import documents

CHAIN = 3
#: Words in a row without an anchor after which one is set.
STRETCH = 8
#: Common words of four languages.
ANCHORS = (
    "the a an and of to in is that it for on as with was be at by this are from or not "  # English
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch "  # German
    "le la les de et un une du en que qui dans au par pour sur est il "  # French
    "el y los las se del al con para lo su no es"  # Spanish
).split()


def _once(value: Column, of) -> Column:
    """of(value), with the value worked out once however often it is named (within higher-order functions Spark doesn't see repeats)."""
    return F.get(F.transform(F.array(value), of), 0)


def signatures(text: Column, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> Column:
    """The sorted distinct signatures of a text: 32-bit hashes, as integers from -2^31 on."""
    bare = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    mark = lambda w: F.when(w.isin(*anchors), F.concat(F.lit("\x01"), w, F.lit("\x02"))).otherwise(F.concat(F.lit(" "), w, F.lit(" ")))
    marked = F.concat(F.lit("\x02"), F.array_join(F.transform(F.split(bare, " "), mark), ""))
    marked = F.regexp_replace(marked, f"((?: [^ \x01\x02]+ ){{{STRETCH}}})", "$1\x01\x02")
    spots = F.array_distinct(_once(F.split(marked, "\x01"), lambda pieces: _spots(pieces, chain)))
    number = lambda s: (F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long") - F.lit(1 << 31)).cast("int")
    return F.sort_array(F.array_distinct(F.transform(F.filter(spots, lambda s: ~F.endswith(s, F.lit(" "))), number)))


def _spots(pieces: Column, chain: int) -> Column:
    """Of pieces `anchor \\2 words`: each anchor, a space, and the chain that follows (nothing, where no word does)."""
    body = lambda x: F.substring_index(x, "\x02", -1)
    joins = lambda bodies: F.zip_with(F.slice(bodies, 2, F.size(pieces)), F.slice(bodies, 3, F.size(pieces)), lambda a, b: F.concat(a, b))
    after = _once(F.concat(F.transform(pieces, body), F.array(F.lit(""), F.lit(""))), joins)

    def spot(x: Column, y: Column) -> Column:
        follows = F.trim(F.replace(F.concat(body(x), y), F.lit("  "), F.lit(" ")))
        return F.concat(F.substring_index(x, "\x02", 1), F.lit(" "), F.substring_index(follows, " ", chain))

    return F.zip_with(pieces, after, spot)


def written(signatures: Column) -> Column:
    """A fingerprint's text."""
    return F.lower(F.array_join(F.transform(signatures, lambda x: F.lpad(F.hex(x.cast("long") + F.lit(1 << 31)), 8, "0")), " "))


def fingerprint(text: Column) -> Column:
    return written(signatures(text))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of signatures."""
    both = F.size(F.array_intersect(a, b))
    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def similar_pairs(prints: DataFrame, key: str = "doc_id", column: str = "fingerprint", threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness) of distinct non-empty fingerprints with likeness >= threshold; a and b are the smallest keys that have
    them, so join back on the fingerprint for copies."""
    sets = prints.where((F.col(column) != "")).groupBy(column).agg(F.min(key).alias("id")).select("id", F.split(column, " ").alias("s")).withColumn("n", F.size("s"))
    rows = sets.select("id", "n", F.explode("s").alias("sig"))
    df = rows.groupBy("sig").agg(F.count("*").alias("df"))
    # the rarest n - ceil(t n) + 1 signatures of each set
    ranked = rows.join(df, "sig").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("r"))
    prefix = ranked.select("id", "n", F.explode(F.slice("r", F.lit(1), F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1)).alias("x")).select("id", "n", F.col("x.sig").alias("sig"), F.floor(F.log("n") / math.log(1 / threshold) + 1e-9).alias("part"))
    near = prefix.select("sig", F.col("id").alias("b"), F.col("n").alias("nb"), F.explode(F.array(F.col("part"), F.col("part") - 1, F.col("part") + 1)).alias("part"))
    met = prefix.select("sig", "part", F.col("id").alias("a"), F.col("n").alias("na")).join(near, ["sig", "part"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)).select("a", "b").distinct()
    out = met.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return out.select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("likeness")).where(F.col("likeness") >= threshold - 1e-12)


def with_next(docs: DataFrame, key: str, derived: dict[str, Column], most_buckets: int = 1024, rows_in_bucket: int = 4096) -> DataFrame:
    """docs (key, text) with the derived columns, and next_<column> of the row that follows by (key, text), the first after
    the last.

    Rows are dealt into key ranges, each ordered on its own; only the ranges' ends look across."""
    n = docs.count()
    k = max(1, min(most_buckets, n // rows_in_bucket))
    numeric = isinstance(docs.schema[key].dataType, T.NumericType)
    at = F.col(key).cast("double") if numeric else F.col(key)
    bounds = []
    if k > 1 and numeric:
        bounds = sorted(set(docs.select(at.alias("x")).approxQuantile("x", [i / k for i in range(1, k)], 0.1 / k)))
    elif k > 1:  # keys without a number: bounds are told from about 20 keys a range, chosen by their hashes
        some = docs.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(max(1, n // (20 * k)))) == 0)).select(key).distinct()
        bounds = [r[0] for r in some.orderBy(key).collect()][20::20]
    order = [F.col(key).asc_nulls_first(), F.col("text").asc_nulls_first()]
    place = F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b <= at)) if bounds else F.lit(0)
    dealt = docs.withColumn("__part__", F.when(F.col(key).isNull(), -1).otherwise(place))
    columns = ["text", *derived]
    # the first row of each range goes to the range before it
    ids = dealt.groupBy("__part__").agg(F.min(key).alias("__first__"))
    each = Window.orderBy("__part__")  # one row per range: 1025 at most
    ids = ids.select("__first__", F.col("__part__").alias("__own__"), F.lag("__part__").over(each).alias("__before__"), F.max("__part__").over(Window.partitionBy(F.lit(1))).alias("__last__"))
    heads = dealt.join(F.broadcast(ids), (F.col("__part__") == F.col("__own__")) & F.col(key).eqNullSafe(F.col("__first__")))
    heads = heads.groupBy(F.coalesce("__before__", "__last__").alias("__part__")).agg(F.min("text").alias("text"))
    heads = heads.withColumns(derived).select("__part__", F.struct(*columns).alias("__head__"))
    within = Window.partitionBy("__part__").orderBy(*order)
    after = dealt.withColumns(derived).withColumn("__next__", F.lead(F.struct(*columns)).over(within)).join(heads, "__part__", "left")
    found = F.coalesce("__next__", "__head__")
    return after.select(key, *columns, *(found[c].alias(f"next_{c}") for c in columns))


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness and the next document's."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    pairs = with_next(docs, "doc_id", {"s": signatures(F.col("text"))}).select(
        "doc_id", n.cast("long").alias("n_chars"), "s", "next_s",
        F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half)).alias("edited"),
    )
    pairs = pairs.withColumn("edited_s", signatures(F.col("edited")))
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("s")).alias("fingerprint"), written(F.col("edited_s")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("edited_s")).alias("near_edited"), likeness(F.col("s"), F.col("next_s")).alias("near_next"),
    )


_LIST = ", ".join(f"'{w}'" for w in ANCHORS)
OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS r, count(*) OVER () AS c FROM documents),
e AS (
  SELECT a.doc_id, a.r, a.n, b.r AS next_r, a.text,
         left(a.text, a.n - a.n // 2) || left(b.text, a.n // 2) AS edited
  FROM d a JOIN d b ON b.r = a.r % a.c + 1),
x AS (SELECT r, 0 AS k, text AS t FROM e UNION ALL SELECT r, 1, edited FROM e),
p AS (
  SELECT r, k, string_split(regexp_replace(chr(2) || array_to_string(list_transform(
           string_split(trim(regexp_replace(lower(t), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), ' '),
           lambda w: CASE WHEN w IN ({_LIST}) THEN chr(1) || w || chr(2) ELSE ' ' || w || ' ' END), ''), '((?: [^ \x01\x02]+ ){{{STRETCH}}})', '\1' || chr(1) || chr(2), 'g'), chr(1)) AS ps FROM x),
b AS (SELECT r, k, ps, list_transform(ps, lambda q: string_split(q, chr(2))) AS qs FROM p),
s AS (
  SELECT r, k, unnest(list_transform(range(1, len(qs) + 1), lambda i: {{
           'anchor': qs[i][1],
           'follows': array_to_string(list_slice(list_filter(string_split(
             qs[i][2] || coalesce(qs[i + 1][2], '') || coalesce(qs[i + 2][2], ''), ' '), lambda w: w <> ''), 1, {CHAIN}), ' ')}})) AS u
  FROM b),
f AS (
  SELECT r, k, list_sort(list_distinct(list(left(md5(u.anchor || ' ' || u.follows), 8)))) AS f
  FROM s WHERE u.follows <> '' GROUP BY r, k),
g AS (
  SELECT e.*, coalesce(f0.f, []) AS f0, coalesce(f1.f, []) AS f1, coalesce(f2.f, []) AS f2
  FROM e LEFT JOIN f f0 ON f0.r = e.r AND f0.k = 0 LEFT JOIN f f1 ON f1.r = e.r AND f1.k = 1
         LEFT JOIN f f2 ON f2.r = e.next_r AND f2.k = 0)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256,
       array_to_string(f0, ' ') AS fingerprint, array_to_string(f1, ' ') AS edited_fingerprint,
       CASE WHEN f0 = f1 THEN 1.0 WHEN len(f0) = 0 OR len(f1) = 0 THEN 0.0 ELSE
         CAST(len(list_intersect(f0, f1)) AS DOUBLE) / (len(f0) + len(f1) - len(list_intersect(f0, f1))) END AS near_edited,
       CASE WHEN f0 = f2 THEN 1.0 WHEN len(f0) = 0 OR len(f2) = 0 THEN 0.0 ELSE
         CAST(len(list_intersect(f0, f2)) AS DOUBLE) / (len(f0) + len(f2) - len(list_intersect(f0, f2))) END AS near_next
FROM g
"""
