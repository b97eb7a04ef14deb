"""Incremental runs: new files become micro-batches that are matched and merged into what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sets import upsert


def watch(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int = 64) -> DataFrame:
    """A stream of the files of a folder; a checkpoint remembers which are done."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def upserts(stream: DataFrame, target: str, checkpoint: str, keys: list[str], order: list[Column], step: Callable[[DataFrame], DataFrame] = lambda df: df, parts: int = 64):
    """Each micro-batch, after `step`, merged into what is below `target`.

    Rows are dealt into `parts` folders by a hash of their keys. A batch reads and rewrites only the folders of its own
    keys, into `batch=<n>/part=<p>`, so that a batch that is run again after a lost executor or driver writes the same
    folders anew. They count once the list `versions/v=<n>`, which names the batch that wrote each part last, is written, last of
    all, so that readers never see half of a batch; batches that neither this list nor the one before names are deleted.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = step(batch).withColumn("__part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).persist()
        before = newest(spark, target, n)
        touched = sorted(r["__part"] for r in new.select("__part").distinct().collect())  # at most `parts`
        old = _read(spark, target, {p: before[p] for p in touched if p in before}, keep=True)
        merged = upsert(new.limit(0) if old is None else old, new, [*keys, "__part"], order)
        dealt = merged.withColumn("part", F.col("__part")).drop("__part").repartition("part")
        dealt.write.mode("overwrite").partitionBy("part").parquet(f"{target}/batch={n}")
        new.unpersist()
        listed = before | {p: n for p in touched}
        spark.createDataFrame(sorted(listed.items()), "part int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{target}/versions/v={n}")
        _tidy(spark, target, n, set(listed.values()) | set(before.values()))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return hadoop, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the complete folders `<prefix><number>` of a folder."""
    hadoop, at, fs = _files(spark, path)
    if not fs.exists(at):
        return []
    return sorted(int(s.getPath().getName()[len(prefix) :]) for s in fs.listStatus(at) if s.getPath().getName().startswith(prefix) and fs.exists(hadoop.Path(s.getPath(), "_SUCCESS")))


def newest(spark: SparkSession, target: str, before: int | None = None) -> dict[int, int]:
    """The batch that wrote each part last, by the newest complete list, or the newest before a batch."""
    known = [v for v in _numbers(spark, f"{target}/versions", "v=") if before is None or v < before]
    return {r.part: r.batch for r in spark.read.parquet(f"{target}/versions/v={known[-1]}").collect()} if known else {}


def _tidy(spark: SparkSession, target: str, n: int, wanted: set[int]) -> None:
    hadoop, _, fs = _files(spark, target)
    lists = f"{target}/versions"
    for path, prefix, kept in ((target, "batch=", wanted), (lists, "v=", set(_numbers(spark, lists, "v=")[-2:]))):
        for old in _numbers(spark, path, prefix):
            if old < n and old not in kept:
                fs.delete(hadoop.Path(f"{path}/{prefix}{old}"), True)


def _read(spark: SparkSession, target: str, listed: dict[int, int], keep: bool = False) -> DataFrame | None:
    if not listed:
        return None
    paths = [f"{target}/batch={n}/part={p}" for p, n in sorted(listed.items())]
    rows = spark.read.option("basePath", target).parquet(*paths)
    return rows.withColumnRenamed("part", "__part").drop("batch") if keep else rows.drop("batch", "part")


def read(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """What the newest complete batch left, or the newest before a batch; null if there is none."""
    return _read(spark, target, newest(spark, target, before))


def running_counts(stream: DataFrame, time: str, key: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by event-time window and key; state of windows that are over by more than `late` is dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count("*").alias("n"))
