"""Structure tables: brackets, mappings and pairs. Records have seq_id, seq and structure; positions are 1-based.

Everything is keyed by seq_id: the windows of one record share its partition, so that one exchange serves them all.
Mapping codes: 0 unpaired, -1 unknown, -2 paired with an unknown partner, else the partner's position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import is_complementary


def letters(col: str) -> Column:
    return F.filter(F.split(F.col(col), ""), lambda c: c != "")


def bases_of(records: DataFrame) -> DataFrame:
    """seq_id, pos, base."""
    return records.select("seq_id", F.posexplode(letters("seq")).alias("p", "base")).select("seq_id", (F.col("p") + 1).alias("pos"), "base")


#: Positions of a record that one window takes at a time. Longer records are cut into blocks of so many.
BLOCK = 1 << 16


def block_of(pos: str) -> Column:
    """The block of a 1-based position."""
    return F.expr(f"cast(({pos} - 1) div {BLOCK} as int)")


def text_blocks(records: DataFrame, col: str, beside: str | None = None) -> DataFrame:
    """seq_id, block, text: a record's string in blocks, with the same places of another one as `beside`."""
    last = F.expr(f"cast(greatest(length({col}) - 1, 0) div {BLOCK} as int)")
    names = {"text": col} | ({"beside": beside} if beside else {})
    cut = records.select("seq_id", *[F.col(c).alias(f"{k}_") for k, c in names.items()], F.explode(F.sequence(F.lit(0), last)).alias("block"))
    part = lambda k: F.when(F.length(f"{k}_") <= BLOCK, F.col(f"{k}_")).otherwise(F.substring(f"{k}_", F.col("block") * BLOCK + 1, F.lit(BLOCK)))
    return cut.select("seq_id", "block", *[part(k).alias(k) for k in names])


def with_entry(rows: DataFrame) -> DataFrame:
    """rows(seq_id, block, change, ..), one a block, with entry: the changes of all blocks before."""
    before = Window.partitionBy("seq_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("entry", F.coalesce(F.sum("change").over(before), F.lit(0)))


def _levels(records: DataFrame) -> DataFrame:
    """seq_id, block, p, c, base, depth, level: each bracket (p from 0) with its letter, the depth behind it and its nesting level.

    Blocks are reduced to their change of depth, a scan over a record's blocks gives the depth on
    entry, and the windows over positions stay inside blocks, which are dealt over the tasks.
    """
    cut = text_blocks(records, "structure", "seq" if "seq" in records.columns else "structure")
    opens, closes = (F.length(F.regexp_replace("text", f"[^{c}]", "")) for c in (r"\\(", r"\\)"))
    blocks = with_entry(cut.withColumn("change", opens - closes)).where("text <> ''").repartition("seq_id", "block")
    marks = blocks.select("seq_id", "block", "entry", "beside", F.posexplode(letters("text")).alias("at", "c")).where(F.col("c").isin("(", ")"))
    marks = marks.select("seq_id", "block", "entry", "at", "c", F.substring("beside", F.col("at") + 1, F.lit(1)).alias("base"))
    within = Window.partitionBy("seq_id", "block").orderBy("at")
    marks = marks.withColumn("depth", F.col("entry") + F.sum(F.when(F.col("c") == "(", 1).otherwise(-1)).over(within))
    return marks.select("seq_id", "block", (F.col("block") * BLOCK + F.col("at")).alias("p"), "c", "base", "depth", (F.col("depth") + (F.col("c") == ")").cast("int")).alias("level"))


def unbalanced(records: DataFrame) -> DataFrame:
    """seq_id of records whose brackets do not match."""
    depth = _levels(records).groupBy("seq_id").agg(F.min("depth").alias("low"), F.max_by("depth", "p").alias("end"))
    return depth.where("low < 0 OR end <> 0").select("seq_id")


def pairs_with_bases(records: DataFrame) -> DataFrame:
    """seq_id, i, j, a, b: the pairs with the letters at their ends, which the brackets bring with them.

    On one level brackets alternate, so that a closing one is matched with the one before it. Most are matched inside
    their block. Of a level, a block leaves at most its first closing bracket and its last opening
    one, so that at most two a block and level meet across blocks; a pair matched before stays by itself there.
    """
    marks = _levels(records).where("level > 0")
    opening = F.when(F.col("c") == "(", F.struct((F.col("p") + 1).alias("i"), F.col("base").alias("a")))
    within = Window.partitionBy("seq_id", "block", "level").orderBy("p")
    told = marks.withColumns({"open": opening, "next": F.lead("c").over(within), "near": F.lag(opening).over(within)})
    rows = told.where((F.col("c") == ")") | F.coalesce(F.col("next") != ")", F.lit(True)))
    alone = F.when(F.col("near").isNotNull() & (F.col("c") == ")"), F.col("p")).otherwise(-1)
    across = Window.partitionBy("seq_id", "level", "alone").orderBy("p")
    met = rows.withColumn("alone", alone).withColumn("far", F.lag("open").over(across)).where("c = ')'").withColumn("open", F.coalesce("near", "far"))
    return met.where("open IS NOT NULL").select("seq_id", "open.i", (F.col("p") + 1).alias("j"), "open.a", F.col("base").alias("b"))


def brackets_to_pairs(records: DataFrame) -> DataFrame:
    """seq_id, i, j with i < j."""
    return pairs_with_bases(records).select("seq_id", "i", "j")


def pairs_to_mapping(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """seq_id, pos, partner for every position; '?' in the structure is unknown."""
    places = records.select("seq_id", F.posexplode(letters("structure")).alias("p", "c")).select("seq_id", (F.col("p") + 1).alias("pos"), "c")
    ends = pairs.select("seq_id", F.inline(F.array(F.struct(F.col("i").alias("pos"), F.col("j").alias("partner")), F.struct(F.col("j").alias("pos"), F.col("i").alias("partner")))))
    return places.join(ends, ["seq_id", "pos"], "left").select("seq_id", "pos", F.coalesce("partner", F.when(F.col("c") == "?", -1).otherwise(0)).alias("partner"))


def brackets_to_mapping(records: DataFrame) -> DataFrame:
    return pairs_to_mapping(records, brackets_to_pairs(records))


def mapping_to_pairs(mapping: DataFrame) -> DataFrame:
    return mapping.where("partner > pos").select("seq_id", F.col("pos").alias("i"), F.col("partner").alias("j"))


def mapping_to_brackets(mapping: DataFrame) -> DataFrame:
    """seq_id, structure. A position paired with itself makes the structure null."""
    mark = F.when(F.col("partner") > F.col("pos"), "(").when(F.col("partner") == F.col("pos"), "!").when(F.col("partner") > 0, ")").when(F.col("partner") == 0, ".").otherwise("?")
    marks = mapping.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", mark.alias("c")))).alias("m"))
    text = F.array_join(F.transform("m", lambda x: x["c"]), "")
    return marks.select("seq_id", F.when(~text.contains("!"), text).alias("structure"))


def validate_mapping(mapping: DataFrame) -> DataFrame:
    """seq_id, pos, reason of each faulty position. 0 and -1 are fine; -2 is out of range."""
    sized = mapping.withColumn("n", F.count("*").over(Window.partitionBy("seq_id")))
    back = mapping.select("seq_id", F.col("pos").alias("partner"), F.col("partner").alias("back"))
    asked = sized.where("partner NOT IN (0, -1)").join(back, ["seq_id", "partner"], "left")
    reason = (
        F.when((F.col("partner") < 1) | (F.col("partner") > F.col("n")), "out of range")
        .when(F.col("partner") == F.col("pos"), "paired with itself")
        .when(F.coalesce(F.col("back") != F.col("pos"), F.lit(True)), "not reciprocal")
    )
    return asked.select("seq_id", "pos", reason.alias("reason")).where("reason IS NOT NULL")


def depths(ends: DataFrame) -> DataFrame:
    """ends(seq_id, p, step, ..), where step is 1 at an opening and -1 at a closing end, with block, blocks and depth, the sum of steps up to p.

    The sums of blocks are scanned by record; the windows over positions stay inside blocks.
    """
    dealt = ends.withColumn("block", block_of("p")).repartition("seq_id", "block")
    sums = with_entry(dealt.groupBy("seq_id", "block").agg(F.sum("step").alias("change")))
    sums = sums.select("seq_id", "block", "entry", F.count("*").over(Window.partitionBy("seq_id")).alias("blocks"))
    met = dealt.join(sums.hint("shuffle_hash"), ["seq_id", "block"])
    return met.withColumn("depth", F.col("entry") + F.sum("step").over(Window.partitionBy("seq_id", "block").orderBy("p"))).drop("entry")


def has_pseudoknot(pairs: DataFrame) -> DataFrame:
    """seq_id, crossing. The ends are matched anew as brackets; a pair that is not matched to itself crosses."""
    ends = pairs.select("seq_id", "i", "j", F.inline(F.array(F.struct(F.col("i").alias("p"), F.lit(1).alias("step")), F.struct(F.col("j").alias("p"), F.lit(-1).alias("step")))))
    level = depths(ends).withColumn("level", F.col("depth") + (F.col("step") < 0).cast("int"))
    within = Window.partitionBy("seq_id", "block", "level").orderBy("p")
    told = level.withColumns({"before": F.lag(F.when(F.col("step") == 1, F.col("i"))).over(within), "next": F.lead("step").over(within)})
    left = told.where("(step = -1 AND before IS NULL) OR (step = 1 AND coalesce(next, 1) <> -1)").select("seq_id", "level", "p", "step", "i")
    across = Window.partitionBy("seq_id", "level").orderBy("p")
    far = left.withColumn("before", F.lag(F.when(F.col("step") == 1, F.col("i"))).over(across)).where("step = -1").select("seq_id", "i", "before")
    closed = told.where("step = -1 AND before IS NOT NULL").select("seq_id", "i", "before").unionByName(far)
    return closed.groupBy("seq_id").agg(F.max(F.coalesce(F.col("i") != F.col("before"), F.lit(True))).alias("crossing"))


def drop_noncomplementary(mapping: DataFrame, bases: DataFrame) -> DataFrame:
    """The mapping with both ends of each pair that is not complementary set to 0."""
    own = mapping.join(bases, ["seq_id", "pos"])
    other = bases.select("seq_id", F.col("pos").alias("partner"), F.col("base").alias("partner_base"))
    met = own.join(other, ["seq_id", "partner"], "left")
    bad = (F.col("partner") > 0) & ~F.coalesce(is_complementary(F.col("base"), F.col("partner_base")), F.lit(False))
    return met.select("seq_id", "pos", F.when(bad, 0).otherwise(F.col("partner")).alias("partner"))


def discretize_reactivity(reactivity: DataFrame, t_u: float = 0.0, t_p: float = 0.0) -> DataFrame:
    """Unpaired where r_unpaired >= t_u, else paired with unknown partner where 1 - r_paired >= t_p, else unknown.

    With one kind of reactivity the other column is 0 and the default t_u makes all positions unpaired.
    """
    code = F.when(F.col("r_unpaired") >= t_u, 0).when(1 - F.col("r_paired") >= t_p, -2).otherwise(-1)
    return reactivity.select("seq_id", "pos", code.alias("partner"))


def attach_structure(records: DataFrame, mapping: DataFrame) -> DataFrame:
    """Records with the structure of mapping, where it is valid; others keep theirs and get a reason."""
    bad = validate_mapping(mapping).groupBy("seq_id").agg(F.min("reason").alias("reason"))
    new = mapping_to_brackets(mapping).withColumnRenamed("structure", "new")
    out = records.join(new, "seq_id", "left").join(bad, "seq_id", "left")
    return out.withColumn("structure", F.when(F.col("reason").isNull(), F.coalesce("new", "structure")).otherwise(F.col("structure"))).drop("new")


def paired_count(mapping: DataFrame) -> DataFrame:
    """seq_id, np: 1 and the positions that are neither unpaired nor unknown."""
    return mapping.groupBy("seq_id").agg((F.lit(1) + F.count_if(~F.col("partner").isin(0, -1))).alias("np"))
