"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute available
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark from wherever sf_dir is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local master gets a folder of its own under the
    temporary directory; a real cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-helixmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Spark removes a query's shuffle files when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again.

    It cuts the lineage and survives lost executors. Unlike checkpoint() it
    runs the plan once and keeps the columns compressed. The shuffle files of
    the write go with its end.
    """
    return _stored(df, name)[0]


class Tables:
    """Written tables by name. What a name held before goes once its new table stands, so that rounds leave one table each.

    Used in a with block, it leaves only the tables in `keep` where the block ends, by an error too.
    """

    def __init__(self, spark: SparkSession, *keep: str):
        self.spark, self.keep, self.paths = spark, keep, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        out, path = _stored(df, name)
        self.drop(name)
        self.paths[name] = path
        return out

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            if path := self.paths.pop(name, None):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, kind: object, *_: object) -> None:
        self.drop(*[n for n in self.paths if kind or n not in self.keep])


#: Rows of at most two 64-bit columns that one broadcast may hold (about 60 MB with its hash table).
BROADCAST = 1_000_000


def near(df: DataFrame, most: int = BROADCAST) -> DataFrame:
    """df marked for a broadcast if its rows, counted, are at most `most`; else df, which joins by shuffle. df is a written table or cheap to count."""
    return F.broadcast(df) if df.count() <= most else df


def beside(rows: DataFrame, told: DataFrame, key: str, most: int = 20_000, salts: int = 64, known: int | None = None) -> DataFrame:
    """rows joined with told(key, ..), a bounded number of rows a key: broadcast if counted (or known) to have few keys, else with both salted, as a key may have a third of the rows."""
    if (told.count() if known is None else known) <= most:
        return rows.join(F.broadcast(told), key)
    told = told.withColumn("salt_", F.explode(F.array(*map(F.lit, range(salts)))))
    return rows.withColumn("salt_", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).join(told, [key, "salt_"]).drop("salt_")


def picked(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """rows(doc_id, key, ..) whose doc_id and key are in ids (left_semi) or not in ids (left_anti); null doc_ids are alike."""
    ids = near(ids.select(F.col("doc_id").alias("id_"), F.col("key").alias("key_")))
    return rows.join(ids, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_")), how)


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that `column` holds about `most` bytes at a time.

    A single longer text still comes whole, as a batch of one row.
    """
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        size = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, n in enumerate(size):
            if held and held + n > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def hash_sample(rows: DataFrame, column: str, n: int) -> list:
    """The values of about n distinct rows' column at most, chosen by their hash: the same ones in every run.

    What the driver gets is bounded by n, not by n for each partition.
    """
    some = rows.select(column).where(F.col(column).isNotNull())
    total = max(1, some.count())
    share = min(1 << 30, (n << 30) // total + 1)
    found = some.where(F.pmod(F.xxhash64(column), F.lit(1 << 30)) < share).distinct().limit(2 * n).collect()
    return sorted(r[0] for r in found)[:n]
