"""Plumbing that the operators of this subpackage share.

Three concerns live here: where intermediate tables go, how Arrow string columns become
numpy byte buffers of bounded size, and the deterministic held-out fold.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of text bytes that one numpy step works on; every temporary array is a small
#: multiple of it, so the memory of a Python worker does not depend on batch or text sizes
#: (a single longer text forms a step of its own).
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(spark: SparkSession, size: str = "1m") -> None:
    """Hand texts to Python in Arrow batches of a MB or one text, unless the session has a size of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, size)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, one of this machine's if no other has a part."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="mentionweave-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a Parquet table under the shared folder and read it back (compressed, column-pruned)."""
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    for made in _watched:
        made.append(back)
    return back


_watched: list[list[DataFrame]] = []


@contextlib.contextmanager
def tidied() -> Iterator[Callable[[DataFrame], None]]:
    """Deletes, at its end, the tables that `written` made meanwhile, but for those that the given function is told to keep."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _watched.append(made)
    try:
        yield kept.append
    finally:
        _watched.pop()
        for table in made:
            if not any(table is k for k in kept):
                discard(table)


def discard(df: DataFrame, shuffles: bool = False) -> None:
    """Delete the table that `written` gave and that nothing needs any more.

    With `shuffles`, the driver's JVM is asked to collect what nothing refers to, as Spark deletes a shuffle's files no sooner.
    """
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    if shuffles:
        sc._jvm.System.gc()


def set_apart(df: DataFrame, *needed: Column | str) -> tuple[DataFrame, dict[str, str]]:
    """(`df` with its columns under names of their own and the `needed` ones beside, the own name of each column).

    What an operator adds then clashes with no column, whatever it is called.
    """
    own = {c: f"own_{k}" for k, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], *needed), own


def own_name(own: dict[str, str], column: str) -> str:
    """The name of a column that `set_apart` put aside."""
    return next(n for c, n in own.items() if c.lower() == column.lower())


def replacing(df: DataFrame, own: dict[str, str], added: list[str]) -> DataFrame:
    """The columns that `set_apart` put aside under their names, and `added` after them; one that is called like an added one goes."""
    taken = {a.lower() for a in added}
    return df.select(*[F.col(n).alias(c) for c, n in own.items() if c.lower() not in taken], *added)


def fields_of(df: DataFrame) -> str:
    """The columns of `df` as a schema string."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def held_out(doc_id: Column | str) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; false for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def sample_ids(ids: DataFrame, key: str, bound: int, salt: int) -> DataFrame:
    """At most `bound` rows of `ids`, chosen by a hash of the key: the same rows on every run."""
    total = ids.count()
    h = F.xxhash64(F.col(key), F.lit(salt))
    if total > 2 * bound:
        ids = ids.where(F.pmod(h, F.lit(1 << 30)) < F.lit(int(1.3 * bound / total * (1 << 30)) + 1))
    return ids.orderBy(h, key).limit(bound)


def excerpt(text: Column | str, most: int, windows: int = 8) -> Column:
    """A text for a training sample: whole if it has at most `most` characters, else that many from windows spread evenly from its beginning to its end."""
    x = F.col(text) if isinstance(text, str) else text
    n, size = F.length(x), most // windows
    at = lambda k: F.floor(k * (n - size) / (windows - 1)).cast("int") + 1
    return F.when(n > most, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda k: F.substr(x, at(k), F.lit(size))), " ")).otherwise(x)


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc have no such call
        ctypes.CDLL(None).malloc_trim(0)


def task(run: Callable) -> Callable:
    """`run` for mapInArrow; at its end the worker gives freed memory back, as it may idle beside other stages."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def strings(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string array, without copying the text; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if not pa.types.is_binary(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, len(array) + 1 + array.offset)[array.offset :].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def steps(off: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most `limit` bytes together, or a single row."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
