"""Column expressions on sequences, structures and weights. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The pairs of bases that count as complementary.
PAIRS = ["AU", "UA", "CG", "GC", "GU", "UG"]


def normalize_seq(seq: Column) -> Column:
    """Gap '.' as '-', t as u, letters other than a c g u p as n, case kept. Null where seq_is_bad()."""
    out = F.translate(seq, ".tT", "-uU")
    out = F.regexp_replace(F.regexp_replace(out, "[bd-fh-oq-tv-z]", "n"), "[BD-FH-OQ-TV-Z]", "N")
    return F.when(~seq_is_bad(seq), out)


def seq_is_bad(seq: Column) -> Column:
    """Whether a sequence has a character that is neither a letter nor a gap."""
    return seq.rlike("[^A-Za-z.\\-]")


def normalize_brackets(structure: Column) -> Column:
    """'-' as '.', null where anything else than ? . ( ) stands."""
    out = F.translate(structure, "-", ".")
    return F.when(~out.rlike("[^?.()]"), out)


def is_complementary(a: Column, b: Column) -> Column:
    return F.concat(F.upper(a), F.upper(b)).isin(*PAIRS)


def remove_gaps(seq: Column) -> Column:
    return F.regexp_replace(seq, "[.\\-]", "")


def letter_positions(seq: Column) -> Column:
    """0, then the 0-based index of each letter of a string."""
    at = F.filter(F.transform(F.split(seq, ""), lambda c, i: F.when(c.rlike("[A-Za-z]"), i)), lambda i: i.isNotNull())
    return F.concat(F.array(F.lit(0)), at)


def canonical_feature(feature: Column) -> Column:
    """The smaller of a feature's name and its mirror image's."""
    body = lambda n: F.regexp_extract(feature, f"^{n}_(.*)$", 1)
    stacked = F.concat(F.lit("helix_stacking_"), F.reverse(body("helix_stacking")))
    paired = F.concat(F.lit("base_pair_"), F.reverse(body("base_pair")))
    inner = F.split(body("internal_nucleotides"), "_")
    mirrored = F.concat(F.lit("internal_nucleotides_"), F.reverse(F.get(inner, F.lit(1))), F.lit("_"), F.reverse(F.get(inner, F.lit(0))))
    other = F.when(feature.rlike("^helix_stacking_[A-Z]{4}$"), stacked).when(feature.rlike("^base_pair_[A-Z]{2}$"), paired).when(feature.rlike("^internal_nucleotides_[A-Z]*_[A-Z]*$"), mirrored)
    return F.least(feature, F.coalesce(other, feature))


def reactivity_logodds(r: Column) -> Column:
    return F.log((r + 0.01) / (1 - r + 0.01))


def soft_threshold(w: Column, c: Column) -> Column:
    return F.signum(w) * F.greatest(F.abs(w) - c, F.lit(0.0))
