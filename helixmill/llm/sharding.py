"""Sharding on a consistent-hash ring with virtual nodes and bounded loads. DataFrame functions only.

The ring has 2**16 places. Each shard owns `vnodes` places, given by a hash of
(shard, replica); a key belongs to the arc that ends in the first owned place
clockwise from its own place. A shard takes at most its capacity; keys that
overflow it continue clockwise to the next places until one has room. The
capacities add up to the number of rows and differ by one at most, so the loads
do too: the law that holds is `rows`.

How it runs: one pass counts keys per arc, at most shards * vnodes numbers
whatever the size of the input. From these counts alone the plan is made: for
each arc, runs of ranks and the shard and first slot that each run gets. A second
pass ranks the rows inside their arcs and joins the plan. No row meets all others.

Cases: a null text has size 16 and crc 0; a null doc_id is a key like another;
rows that share a key are told apart by size and crc, and equal rows may trade
their slots; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

PLACES = 1 << 16


def ring(spark: SparkSession, shards: int, vnodes: int = 128) -> DataFrame:
    """Every place with the arc it belongs to: place, arc (number of the owned place), shard.

    A table of PLACES rows, whatever the input. Where two virtual nodes hash to
    one place, the lower shard has it.
    """
    if shards * vnodes > PLACES // 4:
        raise ValueError("too many virtual nodes for the ring")
    nodes = (
        spark.range(shards * vnodes)
        .select((F.col("id") % shards).cast("int").alias("shard"), F.expr(f"cast(id div {shards} as int)").alias("replica"))
        .withColumn("place", F.pmod(F.xxhash64(F.lit("node"), "shard", "replica"), F.lit(PLACES)))
        .groupBy("place")
        .agg(F.min("shard").alias("shard"))
    )
    back = Window.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = F.struct(F.col("place").alias("arc"), "shard")
    ahead = F.last(F.when(F.col("shard").isNotNull(), owned), ignorenulls=True).over(back)
    wrap = F.first(F.when(F.col("shard").isNotNull(), owned), ignorenulls=True).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # past the last place comes the first arc
    places = spark.range(PLACES).withColumnRenamed("id", "place").join(nodes, "place", "left")
    return places.select("place", F.coalesce(ahead, wrap).alias("own")).select("place", "own.arc", "own.shard")


def loads_plan(arcs: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) from (arc, shard, keys), bounded by the ring's size.

    Keys at home come first; then the overflow of each arc walks clockwise, one
    arc after the other from the ring's start, and takes what room it meets.
    """
    arcs = sorted(arcs)
    total = sum(n for _, _, n in arcs)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    plan, over = [], []

    def put(arc: int, first: int, n: int, shard: int) -> None:
        plan.append((arc, first, first + n, shard, filled[shard]))
        filled[shard] += n
        room[shard] -= n

    for at, (arc, shard, n) in enumerate(arcs):
        if home := min(n, room[shard]):
            put(arc, 0, home, shard)
        if n > home:
            over.append((at, home, n))
    for at, first, n in over:
        step = at
        while first < n:
            step = (step + 1) % len(arcs)
            shard = arcs[step][1]
            if took := min(n - first, room[shard]):
                put(arcs[at][0], first, took, shard)
                first += took
    return plan


def ring_shards(docs: DataFrame, key: str, order: list[str], shards: int, vnodes: int = 128) -> DataFrame:
    """docs with shard and slot. `order` names columns that settle the rank of rows with one key."""
    spark = docs.sparkSession
    places = F.broadcast(ring(spark, shards, vnodes))  # PLACES rows at most
    placed = docs.withColumn("place", F.pmod(F.xxhash64(F.lit("key"), key), F.lit(PLACES))).join(places, "place").drop("shard")
    counts = docs.select(F.pmod(F.xxhash64(F.lit("key"), key), F.lit(PLACES)).alias("place")).groupBy("place").count()
    # An arc without keys still takes overflow: every arc is listed.
    arcs = places.join(counts, "place", "left").groupBy("arc", "shard").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
    plan = loads_plan([(r.arc, r.shard, r.n) for r in arcs.collect()], shards)  # at most shards * vnodes rows
    runs = spark.createDataFrame(plan, "arc long, first long, until long, shard int, base long")
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("arc").orderBy("place", key, *order)).cast("long") - 1)
    return (
        ranked.join(F.broadcast(runs), "arc")  # two runs for each arc and shard at most
        .where("rank >= first AND rank < until")
        .withColumn("slot", F.col("base") + F.col("rank") - F.col("first"))
        .drop("place", "arc", "rank", "first", "until", "base")
    )


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39, with counts at most one apart."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    out = ring_shards(docs, "doc_id", ["size", "text_crc32"], 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
