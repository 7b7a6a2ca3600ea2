"""Quality rules and robust multivariate outliers.

Each text gets counts (words, word characters, symbols, repeated lines, words in
repeated 5-word windows). Fixed rules fail a document first. The others become a
vector of transformed statistics; per language and source a
minimum-covariance-determinant estimate is fitted to all of them, and a vector
whose squared Mahalanobis distance is over the cut is rejected.

The estimate: of each group's n vectors, the h = ceil(3n/4) whose covariance has the least
determinant. As most texts have no symbol or repeated line, a plain covariance of three
quarters of them is singular; so the determinant is that of covariance + target, with the
target's diagonal of least variances (the regularised form, weight a half). Deterministic
starts: medians with the target, with scaled absolute deviations, with the covariance of
tanh-transformed values, with that of spatial signs; means with the plain covariance.
A concentration step takes exactly the h vectors with the least distances, ties ordered by value, and
their mean and covariance; no step raises the determinant. After two steps the two
best starts of each group go on until no determinant falls by a millionth, and the least one is taken.
Determinants cannot fall under the target's, so the steps end.

Every group has an estimate, down to one vector, and so has every language and the whole. A vector is
judged with its group's centre and covariance, weighted by n / (n + PRIOR), beside its language's, which are
themselves weighted so beside those of all rows. The weight grows smoothly with the group's n vectors,
so that no size switches from one estimate to another.
A step is one job; how many groups there are and how large they get is counted once, before the first.

All of it runs on distinct vectors with their counts. The h-th distance is located by histograms,
narrowed until few vectors are left around it, so no group is ever gathered or sorted whole, and
sums have a map side.

Cases: a null or empty text has no words and fails; null language or source
is a value of its own; repeated rows count each; equal vectors are one with a count; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement, count
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, beside, chunks, table
from .shingles import repeated_words

AXES = ["x0", "x1", "x2", "x3", "x4"]
#: Square roots of the target's variances: log words, log mean length, symbols, repeated lines, repeated words (log of 1 + percent).
SPREAD = [0.5, 0.08, 0.3, 0.6, 0.6]
PAIRS = list(combinations_with_replacement(range(len(AXES)), 2))
KEEP = 0.75
#: Vectors at which a group's own estimate weighs as much as its language's, and a language's as much as that of all rows.
PRIOR = 60
#: Steps of all starts; starts that go on.
FIRST, BEST = 2, 2
#: Distances over this are outliers: the chi-square quantile of 1 - 1.4e-9 with 5 degrees, as lengths of texts have heavier tails than a normal vector.
CUT = 50.0
CHI2_MEDIAN = 4.351
#: Vectors around the h-th distance that one task may sort.
SORTED = 200_000
#: Groups whose estimates (five rows of about 200 bytes each) are broadcast, and inverted in one task.
FEW = 20_000
ALL = "all"
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_SPACE = "\t\n\v\f\r "
_SYMBOLS = "#*$%&|<>"


def text_counts(texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of whole texts."""
    out = []
    for text, words, repeated in zip(texts, *repeated_words([t.encode() for t in texts]), strict=True):
        chars = len(text) - sum(map(text.count, _SPACE))
        symbols = sum(map(text.count, _SYMBOLS))
        lines = [x for x in text.split("\n") if x.strip(_SPACE)]
        out.append((int(words), chars, symbols, len(lines) - len(set(lines)), int(repeated), len(lines)))
    return out


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = text_counts([t or "" for t in batch.column("text").to_pylist()])
            cols = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "lang", "source")] + cols, names=["doc_id", "lang", "source", *[c.split()[0] for c in COUNTS.split(", ")]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text").mapInArrow(run, f"doc_id long, lang string, source string, {COUNTS}")


def vectors(counts: DataFrame) -> DataFrame:
    """Rules and transformed statistics beside the counts."""
    percent = lambda a, b: F.log1p(F.lit(100.0) * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return counts.withColumns(
        {
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "x0": F.log1p(F.col("n_words").cast("double")),
            "x1": F.log1p(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))),
            "x2": percent("n_symbols", "word_chars"),
            "x3": percent("n_dup_lines", "n_lines"),
            "x4": percent("n_repeat_words", "n_words"),
        }
    )


def grouped(rows: DataFrame) -> DataFrame:
    """rows with `grp`, language and source, and `wider`, the language alone; null where a rule failed."""
    told = lambda *c: F.when(~F.col("base_failed"), F.to_json(F.struct(*map(F.col, c)), {"ignoreNullFields": "false"}))
    return rows.withColumns({"grp": told("lang", "source"), "wider": told("lang")})


def vectors_of(rows: DataFrame) -> DataFrame:
    """grp, x0.., n: the distinct vectors of each group with their counts, and those of each language and of all rows (group ALL)."""
    known = rows.where("grp IS NOT NULL").groupBy("grp", "wider", *AXES).agg(F.count("*").alias("n"))
    every = known.select(F.explode(F.array("grp", "wider", F.lit(ALL))).alias("grp"), *AXES, "n")
    return every.groupBy("grp", *AXES).agg(F.sum("n").alias("n"))


class Sizes(NamedTuple):
    """How many groups there are, the distinct vectors of the largest, and how many of them one task may sort."""

    groups: int
    largest: int
    most: int

    @property
    def few(self) -> bool:
        return self.groups <= FEW


def sizes_of(used: DataFrame, most: int = SORTED) -> Sizes:
    """Sizes of used(grp, x0.., n)."""
    groups, largest = used.groupBy("grp").count().agg(F.count("*"), F.max("count")).first()
    return Sizes(groups, largest or 0, most)


def distance() -> Column:
    """Squared Mahalanobis distance from columns m0.. and the inverse's p00.. of a joined estimate."""
    diff = [F.col(a) - F.col(f"m{i}") for i, a in enumerate(AXES)]
    terms = [diff[i] * diff[j] * F.col(f"p{i}{j}") * (1 if i == j else 2) for i, j in PAIRS]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


ESTIMATE = "grp string, start int, h long, before double, logdet double, " + ", ".join(f"m{i} double" for i in range(len(AXES))) + ", " + ", ".join(f"p{i}{j} double" for i, j in PAIRS)
ONE = ["start", "h", "logdet", *[f"m{i}" for i in range(len(AXES))], *[f"p{i}{j}" for i, j in PAIRS]]


def _inverse(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Means and covariances s00.. to means, inverses of covariance + target, and log determinants; a row a group and start."""
    k = len(AXES)
    for pdf in rows:
        cov = np.zeros((len(pdf), k, k))
        for i, j in PAIRS:
            cov[:, i, j] = cov[:, j, i] = pdf[f"s{i}{j}"]
        cov += np.diag(np.square(SPREAD))
        inv = np.linalg.inv(cov) if len(pdf) else cov
        logdet = np.linalg.slogdet(cov)[1] if len(pdf) else np.zeros(0)
        out = {c: pdf[c] for c in ("grp", "start", "h", "before")} | {"logdet": logdet} | {f"m{i}": pdf[f"m{i}"] for i in range(k)} | {f"p{i}{j}": inv[:, i, j] for i, j in PAIRS}
        yield pd.DataFrame(out)


def inverted(moments: DataFrame, sizes: Sizes) -> DataFrame:
    """ESTIMATE from means and covariances. Few rows need one Python worker, and leave one file."""
    return (moments.repartition(1) if sizes.few else moments).mapInPandas(_inverse, ESTIMATE)


def _sums(weight: Column) -> list[Column]:
    return [F.sum(weight).alias("w")] + [F.sum(weight * F.col(a)).alias(f"t{i}") for i, a in enumerate(AXES)] + [F.sum(weight * F.col(AXES[i]) * F.col(AXES[j])).alias(f"q{i}{j}") for i, j in PAIRS]


def _moments(sums: DataFrame) -> DataFrame:
    """Means m0.. and covariances s00.. from sums w, t0.., q00.. (divided by w)."""
    mean = [F.col(f"t{i}") / F.col("w") for i in range(len(AXES))]
    return sums.select("grp", "start", "h", "before", *[m.alias(f"m{i}") for i, m in enumerate(mean)], *[(F.col(f"q{i}{j}") / F.col("w") - mean[i] * mean[j]).alias(f"s{i}{j}") for i, j in PAIRS])


def starts(used: DataFrame, sizes: Sizes) -> DataFrame:
    """The first estimates of each group of used(grp, x0.., n), as ESTIMATE."""
    k = range(len(AXES))

    def medians(long: DataFrame) -> DataFrame:
        """grp and the lower median of each axis v0.., from counts of values: a window over bins, each a value rounded to 1/1024."""
        binned = long.groupBy("grp", "axis", F.round(F.col("v") * 1024).cast("long").alias("bin")).agg(F.sum("n").alias("n"))
        order = Window.partitionBy("grp", "axis").orderBy("bin")
        told = binned.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("grp", "axis")))
        return told.where("2 * upto >= all").groupBy("grp").agg(*[(F.min(F.when(F.col("axis") == i, F.col("bin"))) / 1024.0).alias(f"v{i}") for i in k])

    centre = medians(used.select("grp", "n", F.posexplode(F.array(*AXES)).alias("axis", "v"))).select("grp", *[F.col(f"v{i}").alias(f"c{i}") for i in k])
    around = beside(used, centre, "grp", known=sizes.groups)
    spread = medians(around.select("grp", "n", F.posexplode(F.array(*[F.abs(F.col(a) - F.col(f"c{i}")) for i, a in enumerate(AXES)])).alias("axis", "v")))
    spread = spread.select("grp", *[F.greatest(1.4826 * F.col(f"v{i}"), F.lit(SPREAD[i])).alias(f"d{i}") for i in k])
    rows = beside(around, spread, "grp", known=sizes.groups)
    z = [(F.col(a) - F.col(f"c{i}")) / F.col(f"d{i}") for i, a in enumerate(AXES)]
    norm = F.greatest(F.sqrt(sum((x * x for x in z[1:]), z[0] * z[0])), F.lit(1e-9))
    n, total = F.col("n"), F.sum("n")
    cross = lambda name, of: [(F.sum(n * of[i] * of[j]) / total).alias(f"{name}{i}{j}") for i, j in PAIRS]
    one = rows.groupBy("grp").agg(
        total.alias("all"), *[F.first(f"{c}{i}").alias(f"{c}{i}") for c in "cd" for i in k], *[(F.sum(n * F.col(a)) / total).alias(f"a{i}") for i, a in enumerate(AXES)],
        *cross("q", [F.col(a) for a in AXES]), *cross("t", [F.tanh(x) for x in z]), *cross("g", [x / norm for x in z]),
    )
    zero, same = F.lit(0.0), lambda i, j, x: x if i == j else F.lit(0.0)
    covs = [
        {p: zero for p in PAIRS},
        {(i, j): same(i, j, F.pow(f"d{i}", F.lit(2.0))) for i, j in PAIRS},
        {(i, j): F.col(f"t{i}{j}") * F.col(f"d{i}") * F.col(f"d{j}") for i, j in PAIRS},
        {(i, j): F.col(f"g{i}{j}") * F.col(f"d{i}") * F.col(f"d{j}") * len(AXES) for i, j in PAIRS},
        {(i, j): F.col(f"q{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}") for i, j in PAIRS},
    ]
    h = F.ceil(F.col("all") * KEEP).cast("long").alias("h")
    each = [F.struct(F.lit(s).alias("start"), h, F.lit(float("inf")).alias("before"), *[F.col(f"{'a' if s == 4 else 'c'}{i}").alias(f"m{i}") for i in k], *[c[i, j].alias(f"s{i}{j}") for i, j in PAIRS]) for s, c in enumerate(covs)]
    return inverted(one.select("grp", F.explode(F.array(*each)).alias("e")).select("grp", "e.*"), sizes)


def measured(used: DataFrame, estimate: DataFrame, sizes: Sizes) -> DataFrame:
    """used with start, h, the determinant before and the distance d under each of its group's estimates."""
    rows = beside(used, estimate, "grp", known=sizes.groups)
    return rows.select("grp", "start", "h", F.col("logdet").alias("before"), *AXES, "n", distance().alias("d"))


def cut_at(rows: DataFrame, tables: Tables, sizes: Sizes) -> DataFrame:
    """grp, start, lo, hi, need: of rows(grp, start, h, d, n), the h nearest are those under lo and `need` of those from lo to hi.

    Where even the largest group could be sorted in one task, no bin of it needs narrowing.
    """
    order = Window.partitionBy("grp", "start").orderBy("bin")
    binned = rows.withColumn("bin", F.floor(F.log2(F.col("d") + F.lit(1e-9)) * 64))
    counts = binned.groupBy("grp", "start", "h", "bin").agg(F.sum("n").alias("m"), F.count("*").alias("vectors"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    counts = counts.withColumn("need", F.col("h") - F.sum("m").over(order) + F.col("m"))
    found = counts.where("need > 0 AND need <= m").select("grp", "start", "need", "lo", "hi", "vectors")
    if sizes.largest <= sizes.most:
        return found
    found = tables.put("cut", found)
    while (found.agg(F.max(F.when(F.col("lo") < F.col("hi"), F.col("vectors")))).first()[0] or 0) > sizes.most:
        told = found.select("grp", "start", "need", "lo", "hi")
        inner = rows.drop("h").join(F.broadcast(told) if sizes.few else told, ["grp", "start"]).where("d >= lo AND d <= hi")
        inner = inner.withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("d") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 1024)).otherwise(F.lit(0)))
        counts = inner.groupBy("grp", "start", F.col("need").alias("h"), "bin").agg(F.sum("n").alias("m"), F.count("*").alias("vectors"), F.min("d").alias("lo"), F.max("d").alias("hi"))
        counts = counts.withColumn("need", F.col("h") - F.sum("m").over(order) + F.col("m"))
        found = tables.put("cut", counts.where("need > 0 AND need <= m").select("grp", "start", "need", "lo", "hi", "vectors"))
    return found


def taken(rows: DataFrame, cut: DataFrame, sizes: Sizes) -> DataFrame:
    """rows with the count w of each vector that is among the h nearest; ties are ordered by value."""
    told = cut.select(F.col("grp").alias("g_"), F.col("start").alias("s_"), "need", "lo", "hi")
    near = F.broadcast(told) if sizes.few else told
    near = rows.join(near, (F.col("grp") == F.col("g_")) & (F.col("start") == F.col("s_")) & (F.col("d") <= F.col("hi"))).drop("g_", "s_")
    order = Window.partitionBy("grp", "start").orderBy("d", *AXES)
    rest = near.where("d >= lo").withColumn("w", F.least("n", F.greatest(F.lit(0), F.col("need") - F.sum("n").over(order) + F.col("n"))))
    return near.where("d < lo").withColumn("w", F.col("n")).unionByName(rest)


def concentrated(used: DataFrame, estimate: DataFrame, tables: Tables, sizes: Sizes) -> DataFrame:
    """One concentration step of each estimate; `before` is the determinant that it had."""
    rows = measured(used, estimate, sizes)
    sums = taken(rows, cut_at(rows, tables, sizes), sizes).groupBy("grp", "start", "h", "before").agg(*_sums(F.col("w")))
    return inverted(_moments(sums), sizes)


def mcd(rows: DataFrame, tables: Tables | None = None, most: int = SORTED) -> DataFrame:
    """grp, centre m0.., inverse p00.., logdet, scale and n: the least-determinant estimate of each group of rows(grp, wider, x0..), of each language and of all rows."""
    tables = tables or Tables(rows.sparkSession)
    used = tables.put("distinct", vectors_of(rows))
    sizes = sizes_of(used, most)
    estimate = tables.put("starts", starts(used, sizes))
    for step in count():
        new = tables.put("step" if step % 2 else "steps", concentrated(used, estimate, tables, sizes))
        fell = step + 1 <= FIRST or not new.where("logdet < before - 1e-6").isEmpty()
        if step + 1 == FIRST:
            rank = Window.partitionBy("grp").orderBy("logdet", "start")
            new = tables.put("best", new.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= BEST).drop("rank"))
        estimate = new
        if not fell:
            break
    least = estimate.groupBy("grp").agg(F.min_by(F.struct(*ONE), F.struct("logdet", "start")).alias("e")).select("grp", "e.*")
    least = tables.put("least", least.repartition(1) if sizes.few else least)
    # The covariance of the near vectors is too small: scale it so that the median distance is that of a normal vector.
    total = tables.put("total", used.groupBy("grp").agg(F.sum("n").alias("n")))
    half = measured(used, least.drop("h").join(total.select("grp", F.ceil(F.col("n") / 2).alias("h")), "grp"), sizes)
    middle = taken(half, cut_at(half, tables, sizes), sizes).where("w > 0").groupBy("grp").agg(F.max("d").alias("d"))
    return tables.put("mcd", least.join(middle, "grp").join(total, "grp").withColumn("scale", F.greatest(F.col("d") / CHI2_MEDIAN, F.lit(1.0))).drop("d", "h", "start"))


WEIGHED = "grp string, " + ", ".join(f"m{i} double" for i in range(len(AXES))) + ", " + ", ".join(f"p{i}{j} double" for i, j in PAIRS)


def weighed(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """grp, centre m0.. and inverse p00.. (scaled) of each group of rows(grp, wider), from its own, its language's and the whole's of mcd()."""
    k = range(len(AXES))
    told = ["n", "scale", *[f"m{i}" for i in k], *[f"p{i}{j}" for i, j in PAIRS]]
    of_all = estimate.where(F.col("grp") == ALL).select(*told).first()
    if of_all is None:
        return rows.sparkSession.createDataFrame([], WEIGHED)
    whole = pd.DataFrame([of_all.asDict()])

    def spread(pdf: pd.DataFrame, pre: str = "") -> tuple[np.ndarray, np.ndarray]:
        inv = np.zeros((len(pdf), len(AXES), len(AXES)))
        for i, j in PAIRS:
            inv[:, i, j] = inv[:, j, i] = pdf[f"{pre}p{i}{j}"]
        return np.stack([pdf[f"{pre}m{i}"] for i in k], 1), np.linalg.inv(inv) * pdf[f"{pre}scale"].to_numpy()[:, None, None]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            centre, cov = spread(whole)
            for pre in ("l_", ""):
                m, c = spread(pdf, pre)
                w = (pdf[f"{pre}n"] / (pdf[f"{pre}n"] + PRIOR)).to_numpy()
                centre, cov = w[:, None] * m + (1 - w[:, None]) * centre, w[:, None, None] * c + (1 - w[:, None, None]) * cov
            inv = np.linalg.inv(cov)
            yield pd.DataFrame({"grp": pdf["grp"]} | {f"m{i}": centre[:, i] for i in k} | {f"p{i}{j}": inv[:, i, j] for i, j in PAIRS})

    groups = rows.where("grp IS NOT NULL").select("grp", "wider").distinct()
    wide = estimate.select(F.col("grp").alias("wider"), *[F.col(c).alias(f"l_{c}") for c in told])
    return groups.join(estimate.select("grp", *told), "grp").join(wide, "wider").mapInPandas(run, WEIGHED)


def judged(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """Counts, base_failed, distance and kept of every document."""
    with Tables(docs.sparkSession, "vectors", "weighed") as tables:
        rows = tables.put("vectors", grouped(vectors(tables.put("counts", counted(docs)))))
        tables.drop("counts")
        told = tables.put("weighed", weighed(rows, mcd(rows, tables)))
        good = beside(rows.where("grp IS NOT NULL"), told, "grp").select(*rows.columns, distance().alias("distance"))
    # Documents that a rule failed do not go through the join.
    out = good.unionByName(rows.where("grp IS NULL").withColumn("distance", F.lit(None).cast("double")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
