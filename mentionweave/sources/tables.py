"""Scans and sinks of tables: CSV as raw strings, many files with their stem, partitioned, appended and resumable writes."""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells that pandas reads as missing. A name that is spelled like one is lost where `na` is on.
NA_CELLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def headers(spark: SparkSession, path: str | list[str], quote: str = '"', separator: str = ",") -> DataFrame:
    """header (its columns), paths: the files of a folder, glob or list by their first line; empty files are in none.

    One scan, in which every file is one task's and ends after its first line, so a header may hold no line breaks. The driver gets a row a
    distinct header.
    """
    apart = spark.newSession()  # its own settings; files that cost more to open than a task may read are one to a task, and are not split
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        apart.conf.set(key, str(1 << 50))
    apart.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = next(csv.reader([batch["value"][0].as_py().rstrip("\r")], quotechar=quote, delimiter=separator), [])
                yield pa.RecordBatch.from_arrays([pa.array([cells], pa.list_(pa.string())), batch["path"].slice(0, 1)], ["header", "path"])
                return  # the rest of the file is not read

    found = apart.read.text(path).select("value", F.col("_metadata.file_path").alias("path")).mapInArrow(columns, "header array<string>, path string")
    return found.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str], na: bool = False, quote: str = '"', multiline: bool = False, one_header: bool = False, stem: str | None = None) -> DataFrame:
    """CSV with a header, every column a string by an explicit schema; nothing is inferred.

    Columns are taken by name from each file's own header, and wanted columns that a file lacks are null: files are grouped
    by their header, found in one scan of first lines, and read in one scan a header, so that no file's order decides another's cells. With
    `one_header` they are read in one scan, which fails at a file whose header is not the first one's. With `na`, cells that pandas reads as
    missing are null (T1); otherwise the empty string stays one. Files are split by size, but for `multiline`, where cells may hold line breaks.
    `stem` adds the stem of a row's file.
    """
    base = spark.read.option("quote", quote).option("escape", quote).option("multiLine", multiline).option("header", True).option("inferSchema", False)
    if one_header:
        groups = [(tuple(base.csv(path).columns), path)]
    else:
        groups = sorted((_distinct(r.header), list(r.paths)) for r in headers(spark, path, quote).collect())
    parts = [_by_name(base.schema(", ".join(f"`{c}` string" for c in header)).option("enforceSchema", False).csv(paths), columns, stem) for header, paths in groups if header]
    if not parts:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in [*columns, *([stem] if stem else [])]))
    out = reduce(DataFrame.unionByName, parts)
    if na:
        return out.withColumns({c: F.when(~F.col(c).isin(*NA_CELLS), F.col(c)) for c in columns})
    return out.na.fill("", columns)


def _distinct(header: list[str]) -> tuple[str, ...]:
    """Names as Spark gives them to columns: blank ones _c0, _c1 and so on, and those that occur again with their place at the end."""
    named = [c or f"_c{k}" for k, c in enumerate(header)]
    often = Counter(c.lower() for c in header)
    return tuple(f"{c}{k}" if header[k] and often[c.lower()] > 1 else c for k, c in enumerate(named))


def _by_name(given: DataFrame, columns: list[str], stem: str | None) -> DataFrame:
    have = {c.lower(): c for c in reversed(given.columns)}
    marked = with_stem(given, stem) if stem else given
    return marked.select(*[(F.col(f"`{have[c.lower()]}`") if c.lower() in have else F.lit(None).cast("string")).alias(c) for c in columns], *([stem] if stem else []))


def with_stem(df: DataFrame, name: str = "sic_file") -> DataFrame:
    """The stem of the file that a row comes from."""
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Filename, sic (the folder) and text of one UTF-8 document a file."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), F.col("value").alias("text"))
    return rows.select(F.regexp_extract("p", r"([^/]+)$", 1).alias("filename"), F.regexp_extract("p", r"([^/]+)/[^/]+$", 1).alias("sic"), "text")


#: Parallel arrays of a submissions document, and the document; further files hold the arrays alone.
RECENT = T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ("form", "filingDate", "reportDate", "accessionNumber", "primaryDocument")])
SUBMISSIONS = T.StructType().add("filings", T.StructType().add("recent", RECENT).add("files", T.ArrayType(T.StructType().add("name", T.StringType()))))
FORMS = ("10-K", "20-F")


def older_files(json_rows: DataFrame, column: str = "value") -> DataFrame:
    """Name of each further file of older filings that a document lists, with the document's other columns."""
    others = [c for c in json_rows.columns if c != column]
    doc = json_rows.withColumn("__doc", F.from_json(column, SUBMISSIONS))
    return doc.select(*others, F.explode("__doc.filings.files.name").alias("name"))


def filings(json_rows: DataFrame, column: str = "value", forms: tuple[str, ...] = FORMS, older: DataFrame | None = None) -> DataFrame:
    """One row a filing of the wanted forms from documents of parallel arrays; short arrays are padded with nulls.

    `older` has the documents' other columns and the contents of the further files that `older_files` names (fetched, or
    read from a folder); their filings follow. A document or file that does not parse has none.
    """
    others = [c for c in json_rows.columns if c != column]
    found = json_rows.select(*others, F.from_json(column, SUBMISSIONS)["filings"]["recent"].alias("__r"))
    if older is not None:
        found = found.unionByName(older.select(*others, F.from_json(column, RECENT).alias("__r")))
    arrays = [F.coalesce(f"__r.{c}", F.array().cast("array<string>")).alias(c) for c in RECENT.fieldNames()]  # a missing one is an empty one
    rows = found.select(*others, F.inline(F.arrays_zip(*arrays)))
    return rows.where(F.col("form").isin(*forms))


def links(found: DataFrame, base: str, cik: str = "cik") -> DataFrame:
    """Filings with the address of their main document, the accession number without dashes."""
    return found.withColumn("href", F.concat_ws("/", F.lit(base), F.col(cik).cast("string"), F.replace("accessionNumber", F.lit("-"), F.lit("")), "primaryDocument"))


def capped(df: DataFrame, most: int | None, *order: Column | str) -> DataFrame:
    """at most `most` rows, the first in order; None or 0 for all."""
    return df.orderBy(*order).limit(most) if most else df


def write_parts(df: DataFrame, path: str, by: str, fmt: str = "parquet", writers: int = 1, append: bool = False) -> None:
    """One folder a value of `by`, over what was there or beside it.

    Rows are dealt out by value and, with more than one writer a value, by a hash of the row, so that a value has that many files
    and a hot one as many writers.
    """
    dealt = df.repartition(by) if writers <= 1 else df.repartition(F.col(by), F.pmod(F.xxhash64(*df.columns), F.lit(writers)))
    dealt.write.mode("append" if append else "overwrite").partitionBy(by).format(fmt).save(path)


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Further rows beside those that are there; a failed write leaves them as they were."""
    df.write.mode("append").format(fmt).save(path)


def part_index(df: DataFrame, by: str, **metrics: Column) -> DataFrame:
    """Rows and metrics of each part."""
    return df.groupBy(by).agg(F.count("*").alias("n_rows"), *[c.alias(k) for k, c in metrics.items()])


def todo(rows: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key is not among what is done."""
    return rows if done is None else rows.join(done.select(key).distinct(), key, "left_anti")


def split_errors(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows without the error column, failed rows with it)."""
    return rows.where(F.col(error).isNull()).drop(error), rows.where(F.col(error).isNotNull())


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, bytes and time of every file below a folder; contents are not read. `sources.release` copies, digests and archives them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
