"""Tables that a run keeps: in the folder that all executors share, named by spark.checkpoint.dir."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, one of this machine's if no other takes part, else an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="mentionweave-"))
    return context.getCheckpointDir()


def fresh(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """A table written once and read back: what a plan needs twice and is dear, with its lineage cut."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Bucketed:
    """A Parquet table at a path, dealt into buckets by some of its columns, that later sessions find by the path alone.

    Joins and groups on exactly these columns read it without an exchange. Its number of buckets is kept beside it, so that whoever
    opens it reads the buckets that were written.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, by: tuple[str, ...], buckets: int | None = None) -> None:
        self.spark, self.path, self.by = spark, path, by
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        if not there:
            n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.createDataFrame([(n,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/buckets")
        self.buckets = spark.read.schema("buckets int").parquet(f"{path}/buckets").first().buckets
        self.name = "kept_" + hashlib.sha256(path.encode()).hexdigest()[:24]
        listed = ", ".join(f"`{c}`" for c in by)
        spark.sql(f"create table if not exists {self.name} ({schema}) using parquet clustered by ({listed}) into {self.buckets} buckets location '{path}/rows'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, rows: DataFrame) -> None:
        """Further rows beside those that are there, one file a bucket."""
        rows.select(*self.rows().columns).repartition(self.buckets, *self.by).write.insertInto(self.name)
