"""Loop features of structures, their counts and scores.

Features of one source row are exploded from one array, so that each loop, pair
or helix is read once. Records are (seq_id, seq, structure).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import canonical_feature
from ..sources.shared import stored
from .loops import base_at, helices, known_pairs, loops_of, pair_parents

#: Thresholds of pair distances, and caps of lengths.
DISTANCES = [3, 9, 12, 16, 21, 26, 34, 47, 71, 132]
MAX_HAIRPIN, MAX_HELIX, MAX_BULGE, MAX_INTERNAL, MAX_SYMMETRIC, MAX_ASYMMETRY, MAX_EXPLICIT, MAX_STRING = 30, 30, 30, 30, 15, 28, 4, 7


#: Families of lengths. A row tells the exact length, as family_exactly_n; what has a length n has one of at least k for each k up to n.
LENGTHS = {
    "base_pair_dist": len(DISTANCES) - 1, "helix_length": MAX_HELIX, "hairpin_length": MAX_HAIRPIN, "bulge_length": MAX_BULGE,
    "internal_length": MAX_INTERNAL, "internal_symmetric_length": MAX_SYMMETRIC, "internal_asymmetry": MAX_ASYMMETRY,
}


def exactly(family: str, n: Column) -> Column:
    """family_exactly_n, where longer lengths than the family's longest count as that."""
    return F.concat(F.lit(f"{family}_exactly_"), F.least(n, F.lit(LENGTHS[family])).cast("int"))


def name(family: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{family}_"), *parts)


def s(pos: Column | str) -> Column:
    """The upper-case base at a position of the row's seq."""
    return F.upper(base_at("seq", pos if isinstance(pos, Column) else F.expr(pos)))


def exploded(rows: DataFrame, names: Column, *more: Column) -> DataFrame:
    """seq_id, feature, cnt: 1 for each name of the array, and what each struct(feature, cnt) of `more` says."""
    each = F.transform(F.filter(names, lambda x: x.isNotNull()), lambda x: F.struct(x.alias("feature"), F.lit(1).cast("long").alias("cnt")))
    own = F.filter(F.array(*more), lambda x: x.isNotNull()) if more else None
    return rows.select("seq_id", F.inline(F.concat(each, own) if more else each))


def pair_names() -> Column:
    """base_pair and the distance of a pair, as the number of its last threshold."""
    passed = sum(((F.col("j") - F.col("i") >= d).cast("int") for d in DISTANCES[1:]), F.lit(0))
    return F.array(canonical_feature(name("base_pair", s("i"), s("j"))), F.when(F.col("j") - F.col("i") >= DISTANCES[0], exactly("base_pair_dist", passed)))


def stack_names() -> Column:
    return F.array(canonical_feature(name("helix_stacking", s("i"), s("j"), s("i + 1"), s("j - 1"))))


def helix_features(pairs: DataFrame) -> DataFrame:
    names = F.when(F.col("len") == 1, F.array(F.lit("isolated_base_pair"))).otherwise(F.array(exactly("helix_length", F.col("len"))))
    return exploded(helices(pairs), names)


def closing(a: str, b: str) -> Column:
    return name("helix_closing", s(a), s(b))


def mismatch(a: str, b: str, c: str, d: str) -> Column:
    return name("terminal_mismatch", s(a), s(b), s(c), s(d))


def hairpin_names() -> Column:
    n = F.col("j") - F.col("i") - 1
    text = F.when(n.between(3, MAX_STRING), name("hairpin_nucleotides", F.upper(F.substring(F.col("seq"), F.col("i") + 1, n))))
    return F.array(closing("i", "j"), mismatch("i", "j", "i + 1", "j - 1"), text, exactly("hairpin_length", n))


def single_names() -> Column:
    """Of bulges and internal loops with outer pair (i, j) and inner pair (p, q)."""
    l1, l2 = F.col("l1"), F.col("l2")
    inside = name("internal_nucleotides", F.upper(F.substring(F.col("seq"), F.col("i") + 1, l1)), F.lit("_"), F.reverse(F.upper(F.substring(F.col("seq"), F.col("q") + 1, l2))))
    both = F.array(closing("i", "j"), closing("q", "p"), mismatch("i", "j", "i + 1", "j - 1"), mismatch("q", "p", "q + 1", "p - 1"), F.when(l1 + l2 <= MAX_STRING, canonical_feature(inside)))
    bulge = F.array(exactly("bulge_length", l1 + l2))
    explicit = F.when((l1 <= MAX_EXPLICIT) & (l2 <= MAX_EXPLICIT), name("internal_explicit", F.least(l1, l2).cast("string"), F.lit("_"), F.greatest(l1, l2).cast("string")))
    internal = F.array(explicit, exactly("internal_length", l1 + l2), exactly("internal_asymmetry", F.abs(l1 - l2)), F.when(l1 == l2, exactly("internal_symmetric_length", l1)))
    return F.concat(both, F.when(F.col("kind") == "bulge", bulge).otherwise(internal))


def multi_names() -> Column:
    """Of a multi loop's closing pair; its branches are rows of their own."""
    return F.array(F.lit("multi_base"), F.lit("multi_paired"), closing("i", "j"), name("dangle_left", s("i"), s("j"), s("i + 1")), name("dangle_right", s("i"), s("j"), s("j - 1")))


def branch_names() -> Column:
    """Of a branch (i, j) of a multi loop or of the external one, as seen from outside."""
    multi = F.col("kind") == "multi branch"
    left = F.when(multi | (F.col("j") < F.length("seq")), name("dangle_left", s("j"), s("i"), s("j + 1")))
    right = F.when(multi | (F.col("i") > 1), name("dangle_right", s("j"), s("i"), s("i - 1")))
    return F.array(F.when(multi, "multi_paired").otherwise("external_paired"), closing("j", "i"), left, right)


#: The families of a loop's row, by when they apply. To add a family is to add an entry.
LOOP_FAMILIES = [
    ("i IS NOT NULL AND NOT endswith(kind, 'branch')", pair_names),
    ("kind = 'stack'", stack_names),
    ("kind = 'hairpin'", hairpin_names),
    ("kind IN ('bulge', 'internal')", single_names),
    ("kind = 'multi'", multi_names),
    ("endswith(kind, 'branch')", branch_names),
]


def feature_rows(records: DataFrame, allow_nc: bool = False) -> DataFrame:
    """seq_id, feature, cnt with repeats, and with exact lengths: one explode of the loops and their branches, one of the helices."""
    parents = stored(pair_parents(known_pairs(records, allow_nc)), "parents")  # loops, branches and helices read it
    pairs, loops = parents.select("seq_id", "i", "j"), loops_of(parents, records)
    multi = loops.where("kind = 'multi'").select("seq_id", F.col("i").alias("parent_i"), F.lit("multi branch").alias("kind"))
    outer = parents.where("parent_i IS NULL").select("seq_id", "i", "j", F.lit("external branch").alias("kind"))
    branches = outer.unionByName(parents.join(multi, ["seq_id", "parent_i"]).select("seq_id", "i", "j", "kind"))
    rows = loops.unionByName(branches, allowMissingColumns=True).join(records.select("seq_id", "seq"), "seq_id")
    none = F.array().cast("array<string>")
    names = F.concat(*[F.when(F.expr(when), family()).otherwise(none) for when, family in LOOP_FAMILIES])
    loose = F.when(F.col("kind").isin("multi", "external") & (F.col("n_unpaired") > 0), F.struct(F.concat("kind", F.lit("_unpaired")).alias("feature"), F.col("n_unpaired").cast("long").alias("cnt")))
    return exploded(rows, names, loose).unionByName(helix_features(pairs))


def exact_feature_counts(records: DataFrame, allow_nc: bool = False) -> DataFrame:
    """seq_id, feature, cnt with exact lengths. Partial sums on the map side keep common features harmless."""
    return feature_rows(records, allow_nc).groupBy("seq_id", "feature").agg(F.sum("cnt").cast("double").alias("cnt"))


def at_least(exact: DataFrame, *keys: str) -> DataFrame:
    """Counts by keys and feature with each family's exact lengths turned into those of at least k: sums from the longest one down."""
    parts = F.split("feature", "_exactly_")
    long = exact.where(F.col("feature").contains("_exactly_")).groupBy(*keys, F.get(parts, 0).alias("family")).agg(F.collect_list(F.struct(F.get(parts, 1).cast("int").alias("n"), "cnt")).alias("bins"))
    each = long.select(*keys, "family", "bins", F.explode(F.sequence(F.lit(0), F.array_max(F.transform("bins", lambda b: b["n"])))).alias("k"))
    count = F.aggregate("bins", F.lit(0.0), lambda total, b: total + F.when(b["n"] >= F.col("k"), b["cnt"]).otherwise(0.0))
    return exact.where(~F.col("feature").contains("_exactly_")).unionByName(each.select(*keys, F.concat("family", F.lit("_at_least_"), "k").alias("feature"), count.alias("cnt")))


def feature_counts(records: DataFrame, allow_nc: bool = False) -> DataFrame:
    """seq_id, feature, cnt."""
    return at_least(exact_feature_counts(records, allow_nc), "seq_id")


def corpus_counts(records: DataFrame, allow_nc: bool = False) -> DataFrame:
    """feature, cnt over all records: summed with exact lengths, which are turned into families at the end."""
    exact = feature_rows(records, allow_nc).groupBy("feature").agg(F.sum("cnt").cast("double").alias("cnt"))
    return at_least(exact).where("cnt <> 0")


def exact_weights(weights: DataFrame) -> DataFrame:
    """weights with those of at least k summed up to each exact length, so that a length takes one lookup."""
    from .lengths import length_score_table

    long = length_score_table(weights).select(F.concat("family", F.lit("_exactly_"), "len").alias("feature"), F.col("score").alias("w"))
    return weights.select("feature", "w").where(~F.col("feature").contains("_at_least_")).unionByName(long)


#: Features that a third of all rows may share; the only ones whose weights are sent to every task where all of them are too many.
COMMON = ["external_unpaired", "external_paired", "multi_unpaired", "multi_paired", "multi_base"]


def with_weights(features: DataFrame, weights: DataFrame, most: int = 1_000_000) -> DataFrame:
    """features with w, 0 where a feature has no weight.

    Weights are broadcast where, counted, they are at most `most`; beyond that, those of COMMON are, and the rest is joined by shuffle.
    """
    kind = weights.schema["w"].dataType
    none = F.struct(*[F.lit(0.0).alias(f) for f in kind.names]) if hasattr(kind, "names") else F.lit(0.0)
    zero = F.coalesce("w", none)
    if weights.count() <= most:
        return features.join(F.broadcast(weights.select("feature", "w")), "feature", "left").withColumn("w", zero)
    hot = F.col("feature").isin(COMMON)
    common = features.where(hot).join(F.broadcast(weights.where(hot).select("feature", "w")), "feature", "left")
    return common.unionByName(features.where(~hot).join(weights.where(~hot).select("feature", "w").hint("merge"), "feature", "left")).withColumn("w", zero)


def corpus_feature_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("feature").agg(F.sum("cnt").alias("cnt")).where("cnt <> 0")


def score_structures(features: DataFrame, weights: DataFrame) -> DataFrame:
    """seq_id, score. A feature without a weight counts 0."""
    return with_weights(features, weights).groupBy("seq_id").agg(F.sum(F.col("cnt") * F.col("w")).alias("score"))


def score_breakdown(features: DataFrame, weights: DataFrame, base: DataFrame) -> DataFrame:
    """seq_id, score, base_score and their difference: both weights of a feature come by one join."""
    both = weights.select("feature", F.col("w").alias("own")).join(base.select("feature", F.col("w").alias("b")), "feature", "full")
    both = both.select("feature", F.struct(F.coalesce("own", F.lit(0.0)).alias("own"), F.coalesce("b", F.lit(0.0)).alias("b")).alias("w"))
    met = with_weights(features, both)
    out = met.groupBy("seq_id").agg(F.sum(F.col("cnt") * F.col("w.own")).alias("score"), F.sum(F.col("cnt") * F.col("w.b")).alias("base_score"))
    return out.withColumn("rest", F.col("score") - F.col("base_score"))


def feature_vocabulary(features: DataFrame) -> DataFrame:
    return features.select("feature").distinct()


def unseen_features(features: DataFrame, weights: DataFrame) -> DataFrame:
    return feature_vocabulary(features).join(weights, "feature", "left_anti")
