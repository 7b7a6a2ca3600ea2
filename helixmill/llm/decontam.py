"""Benchmark decontamination by SimHash of item-sized windows. DataFrame functions only.

A window has as many words as a benchmark item. Windows and items get a 64-bit
SimHash of their five-word shingles, counted as often as they occur. The bits are cut into
RADIUS + 1 blocks: fingerprints within RADIUS agree in one block at least, so the
join on (item size, block, value) finds all of them. A found pair is kept if the
weighted Jaccard similarity of its shingle counts is at least `similar`.

Which windows: a similar window shares all but a seventh of its shingles with the item, so
that some shared one starts at every fourth place of the text; only texts with such
a place are read on. Sliding a window
to its first shared shingle never loses one. So the windows that start at a
shingle of an item of their size (or end with the text) and hold enough shared
positions for `similar` are fingerprinted; no other window can pass the last test.
A text shorter than an item is one window.

At similarity 0.75 two fingerprints differ in 11 bits on average with a
deviation of 3, so RADIUS is more than four deviations above.

Cases: words are lower-cased and split at ASCII white space; a null or empty text
has no windows; a null item or one under five words has no shingles and matches nothing; repeated rows of
documents or items count once; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

N = 5
SIMILAR = 0.75
BITS, RADIUS = 64, 24
#: Item shingles up to this many are sent to every executor (about 20 MB); more are joined by shuffle.
SMALL = 400_000


def words(text: str = "text") -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def stride(shingles: int, similar: float = SIMILAR) -> int:
    """The largest step up to 4 at which places of a window of at least so many shingles cannot all be misses.

    A similar window misses at most a share (1 - similar) / (1 + similar) of its places; of each `step` places in a row one is tried.
    """
    missed = (1 - similar) / (1 + similar)
    return max(k for k in (1, 2, 3, 4) if k == 1 or all(n // k > int(missed * n + 1e-9) for n in range(max(1, int(similar * shingles)), 200)))  # a text may be shorter than the item


def shingle_hashes(of: Column, every: int = 1) -> Column:
    """A hash of each run of five words that starts at a place divisible by `every`; empty under five words."""
    return F.when(F.size(of) >= N, F.transform(F.sequence(F.lit(1), F.size(of) - (N - 1), F.lit(every)), lambda i: F.xxhash64(F.slice(of, i, N)))).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: str) -> Column:
    """One bit for each place: whether it is set in more than half of the hashes."""
    bits = f"transform(sequence(0, {BITS - 1}), b -> 2 * aggregate({hashes}, 0, (n, h) -> n + cast(shiftright(h, b) & 1L as int)) > size({hashes}))"
    return F.expr(f"aggregate({bits}, 0L, (f, x) -> shiftleft(f, 1) | if(x, 1L, 0L))")


def blocks(fingerprint: str) -> Column:
    """Number and value of each block of the fingerprint."""
    edges = [BITS * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    return F.array(*[F.struct(F.lit(k).alias("block"), F.expr(f"shiftrightunsigned({fingerprint}, {a}) & {(1 << (b - a)) - 1}L").alias("value")) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def weighted_similarity(a: str, b: str) -> Column:
    """Sum of least counts over sum of greatest counts of two hash lists."""
    count = lambda of: f"size(filter({of}, y -> y = x))"
    both = f"aggregate(array_intersect({a}, {b}), 0, (n, x) -> n + least({count(a)}, {count(b)}))"
    return F.expr(f"{both} / (size({a}) + size({b}) - {both})")


def leaks(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, similarity, first_word, distance."""
    items = benchmark.select("item_id", words().alias("w")).distinct().select("item_id", F.size("w").alias("size"), shingle_hashes(F.col("w")).alias("item_hashes")).where(F.size("item_hashes") > 0)
    items = written(items.withColumn("item_print", simhash("item_hashes")), "items")
    told = items.select("item_id", "size", F.explode("item_hashes").alias("h")).distinct()
    near = F.broadcast if told.count() <= SMALL else (lambda df: df)
    # An item's blocks are RADIUS + 1 rows, and its hashes as many as its shingles.
    sent = F.broadcast if (items.agg(F.sum(F.size("item_hashes") + RADIUS + 1)).first()[0] or 0) <= SMALL else (lambda df: df)

    key = [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]
    # Texts with a shared shingle at a place divisible by `every`: no text with a similar window lacks one.
    every = stride(items.agg(F.min(F.size("item_hashes"))).first()[0] or 1)
    some = docs.select(*key, words().alias("w")).select("doc_id", "text_hash", F.explode(shingle_hashes(F.col("w"), every)).alias("h"))
    seeds = written(some.join(near(told.select("h").distinct()), "h", "left_semi").select(F.col("doc_id").alias("id_"), "text_hash").distinct(), "seeds")
    texts = docs.select(*key, "text")
    texts = texts.join(seeds, F.col("id_").eqNullSafe(F.col("doc_id")) & (seeds["text_hash"] == texts["text_hash"])).select("doc_id", texts["text_hash"], "text")
    texts = written(texts, "seeded").select("doc_id", "text_hash", words().alias("w"))
    seen = texts.select("doc_id", "text_hash", F.size("w").alias("n"), F.posexplode(shingle_hashes(F.col("w"))).alias("q", "h"))
    hits = seen.join(near(told), "h").groupBy("doc_id", "text_hash", "n", "size", "item_id").agg(F.array_sort(F.collect_set("q")).alias("at"))
    # A window from p on with `least` shared positions up to its last shingle.
    own = F.least("size", "n") - (N - 1)
    least = F.ceil(F.lit(similar / (1 + similar)) * (own + F.col("size") - (N - 1)) - 1e-9).cast("int")
    first = lambda q: F.greatest(F.lit(0), F.least(q, F.col("n") - F.col("size")))
    enough = F.filter(F.transform("at", lambda q, i: F.when(F.get("at", i + least - 1) <= first(q) + own - 1, first(q))), lambda p: p.isNotNull())
    places = hits.withColumn("p", F.explode(F.array_distinct(enough))).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("p", "size")).alias("places"))
    places = written(places, "places")

    cut = texts.join(places.withColumnRenamed("doc_id", "id_"), (F.col("id_").eqNullSafe(F.col("doc_id"))) & (places["text_hash"] == texts["text_hash"]))
    cut = cut.select("doc_id", F.explode(F.transform("places", lambda x: F.struct(x["p"].alias("p"), x["size"].alias("size"), F.slice("w", x["p"] + 1, x["size"]).alias("w")))).alias("x"))
    windows = cut.select("doc_id", "x.p", "x.size", shingle_hashes(F.col("x.w")).alias("hashes")).distinct()
    windows = written(windows.withColumn("print", simhash("hashes")).withColumn("window", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "p", "hashes")), "windows")
    by_block = items.select("item_id", "size", "item_print", F.explode(blocks("item_print")).alias("b")).select("item_id", "size", "item_print", "b.block", "b.value")
    found = windows.select("window", "p", "size", "print", F.explode(blocks("print")).alias("b")).select("window", "p", "size", "print", "b.block", "b.value")
    pairs = found.join(sent(by_block), ["size", "block", "value"]).withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))))
    # Prints within the radius meet in several blocks: a pair counts once, and only then are the shingles compared.
    pairs = pairs.where(F.col("distance") <= RADIUS).select("window", "p", "size", "item_id", "distance").distinct()
    pairs = pairs.join(windows.select("window", "p", "size", "doc_id", "hashes"), ["window", "p", "size"]).join(sent(items.select("item_id", "size", "item_hashes")), ["item_id", "size"])
    pairs = pairs.withColumn("similarity", weighted_similarity("hashes", "item_hashes")).where(F.col("similarity") >= similar)
    best = F.max_by(F.struct(F.col("p").alias("first_word"), "distance"), F.struct("similarity", -F.col("p")))
    return pairs.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), best.alias("best")).select("doc_id", "item_id", "similarity", "best.first_word", "best.distance")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every document."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "similarity")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT item_id, len(w) AS size, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)),
bc AS (SELECT item_id, size, s, count(*) AS c FROM bs GROUP BY ALL),
ds AS (SELECT doc_id, n, q, s FROM (SELECT doc_id, len(w) AS n, i - 1 AS q, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)) SEMI JOIN (SELECT DISTINCT s FROM bc) USING (s)),
hits AS (SELECT DISTINCT doc_id, n, q, s, item_id, size, c FROM ds JOIN bc USING (s)),
starts AS (SELECT DISTINCT doc_id, n, item_id, size, greatest(0, least(q, n - size)) AS p FROM hits),
inside AS (SELECT st.doc_id, st.item_id, st.p, st.size, st.n, h.s, h.c, count(*) AS dc FROM starts st JOIN hits h ON h.doc_id = st.doc_id AND h.item_id = st.item_id AND h.q >= st.p AND h.q <= st.p + least(st.size, st.n) - 5 GROUP BY ALL),
scored AS (SELECT doc_id, item_id, p, sum(least(c, dc)) / (any_value(size) - 4 + any_value(least(size, n)) - 4 - sum(least(c, dc))) AS sim FROM inside GROUP BY ALL)
SELECT doc_id, item_id, max(sim) AS similarity FROM scored WHERE sim >= 0.75 GROUP BY ALL
"""
