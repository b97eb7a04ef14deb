"""Releases: files copied into sections of a folder, a manifest that says what belongs to it, and one archive of all.

Files are copied, digested and compressed in tasks, by paths that all of them see as files. What counts as the release is what its
newest manifest lists, which is written last: a run that dies leaves files that no manifest names, and the release as it was. A later run copies
only what changed. The archive's members are compressed by tasks of their own; once their sizes are known, so are their places, and
tasks write them there, so that the driver writes the central directory alone.
"""

from __future__ import annotations

import datetime
import hashlib
import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STEP = 1 << 20
MANIFEST = "section string, release_path string, bytes long, modified timestamp, sha256 string"


def _digest(path: str) -> str:
    found = hashlib.sha256()
    with open(path, "rb") as file:
        while block := file.read(_STEP):
            found.update(block)
    return found.hexdigest()


def _dealt(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A row a file, dealt out one by one."""
    return spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), 8 * spark.sparkContext.defaultParallelism)))


def _manifests(target: str) -> list[str]:
    """Complete manifests of a release, the oldest first."""
    if not os.path.isdir(f"{target}/_manifests"):
        return []
    return sorted(f"{target}/_manifests/{n}" for n in os.listdir(f"{target}/_manifests") if os.path.exists(f"{target}/_manifests/{n}/_SUCCESS"))


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """Section, release_path, bytes, modified, sha256 of the files of a release, by its newest manifest."""
    there = _manifests(target)
    return spark.read.schema(MANIFEST).parquet(there[-1]) if there else spark.createDataFrame([], MANIFEST)


def _copied(target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                to = f"{target}/{row['release_path']}"
                digest = _digest(row["source"])
                if not os.path.exists(to) or _digest(to) != digest:
                    os.makedirs(os.path.dirname(to), exist_ok=True)
                    beside = f"{to}.{uuid.uuid4().hex}.part"
                    shutil.copyfile(row["source"], beside)
                    if _digest(beside) != digest:
                        os.remove(beside)
                        raise OSError(f"{row['source']} came out differently, or changed meanwhile")
                    os.replace(beside, to)
                about = os.stat(row["source"])
                out = [row["release_path"].split("/")[0], row["release_path"], about.st_size, datetime.datetime.fromtimestamp(about.st_mtime, datetime.UTC), digest]
                kinds = (pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(out, kinds, strict=True)], [c.split()[0] for c in MANIFEST.split(", ")])

    return run


def sections(folders: dict[str, str]) -> dict[str, str]:
    """The place in a release of every file of some folders (by the section's name): {release path: source path}."""
    out = {}
    for section, folder in folders.items():
        for top, _, names in os.walk(folder):
            for name in names:
                if not name.startswith((".", "_")):
                    out[f"{section}/{os.path.relpath(os.path.join(top, name), folder)}".replace(os.sep, "/")] = os.path.join(top, name)
    return out


def publish(spark: SparkSession, files: dict[str, str], target: str) -> DataFrame:
    """The release below `target` made of `files` ({release path: source path}), which are copied where they changed; its manifest.

    Files that the manifest before named and this one doesn't are deleted once the new one is written.
    """
    before = {r.release_path for r in manifest(spark, target).select("release_path").collect()}
    bad = [p for p in files if p.startswith("/") or ".." in p.split("/") or "/" not in p]
    if bad:
        raise ValueError(f"{bad[0]!r} is no path of a section")
    rows = sorted(files.items())
    made = _dealt(spark, rows, "release_path string, source string").mapInArrow(_copied(target), MANIFEST) if rows else spark.createDataFrame([], MANIFEST)
    made.orderBy("release_path").coalesce(1).write.parquet(f"{target}/_manifests/{len(_manifests(target)):08d}-{uuid.uuid4().hex}")
    for gone in before - set(files):
        if os.path.exists(f"{target}/{gone}"):
            os.remove(f"{target}/{gone}")
    return manifest(spark, target)


def broken(spark: SparkSession, target: str) -> DataFrame:
    """release_path, fault: files of a release that are missing, or are not what the manifest says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, digest in zip(batch["release_path"].to_pylist(), batch["sha256"].to_pylist(), strict=True):
                at = f"{target}/{path}"
                found.append("missing" if not os.path.exists(at) else "different" if _digest(at) != digest else None)
            yield pa.RecordBatch.from_arrays([batch["release_path"], pa.array(found, pa.string())], ["release_path", "fault"])

    listed = manifest(spark, target).select("release_path", "sha256")
    return listed.repartition(spark.sparkContext.defaultParallelism, "release_path").mapInArrow(run, "release_path string, fault string").where(F.col("fault").isNotNull())


# The archive ------------------------------------------------------------------------------------

_MEMBER = "release_path string, file string, crc long, packed long, size long, modified long"
#: Signatures, versions and the largest plain number of the format.
_LOCAL, _CENTRAL, _END64, _AT64, _END, _VERSION, _LARGE, _DEFLATED, _UTF8 = 0x04034B50, 0x02014B50, 0x06064B50, 0x07064B50, 0x06054B50, 45, 0xFFFFFFFF, 8, 1 << 11


def _stamp(seconds: int) -> tuple[int, int]:
    """(time, date) as the format has them."""
    t = datetime.datetime.fromtimestamp(max(seconds, 315_532_800), datetime.UTC)
    return t.hour << 11 | t.minute << 5 | t.second // 2, t.year - 1980 << 9 | t.month << 5 | t.day


def _local(row) -> bytes:
    """What stands before a member; sizes are in its extra field, so that they may be large."""
    name, extra = row["release_path"].encode(), struct.pack("<HHQQ", 1, 16, row["size"], row["packed"])
    return struct.pack("<IHHHHHIIIHH", _LOCAL, _VERSION, _UTF8, _DEFLATED, *_stamp(row["modified"]), row["crc"], _LARGE, _LARGE, len(name), len(extra)) + name + extra


def _central(row, at: int) -> bytes:
    name, extra = row["release_path"].encode(), struct.pack("<HHQQQ", 1, 24, row["size"], row["packed"], at)
    head = struct.pack("<IHHHHHHIIIHHHHHII", _CENTRAL, _VERSION, _VERSION, _UTF8, _DEFLATED, *_stamp(row["modified"]), row["crc"], _LARGE, _LARGE, len(name), len(extra), 0, 0, 0, 0, _LARGE)
    return head + name + extra


def _packed(target: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, digest in zip(batch["release_path"].to_pylist(), batch["sha256"].to_pylist(), strict=True):
                file, crc, size, said = f"{folder}/{uuid.uuid4().hex}", 0, 0, hashlib.sha256()
                squeezed = zlib.compressobj(6, zlib.DEFLATED, -15)
                with open(f"{target}/{path}", "rb") as given, open(file, "wb") as out:
                    while block := given.read(_STEP):
                        crc, size = zlib.crc32(block, crc), size + len(block)
                        said.update(block)
                        out.write(squeezed.compress(block))
                    out.write(squeezed.flush())
                if said.hexdigest() != digest:
                    raise OSError(f"{path} is not what the manifest says")
                row = [path, file, crc, os.path.getsize(file), size, int(os.stat(f"{target}/{path}").st_mtime)]
                kinds = (pa.string(), pa.string(), *[pa.int64()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in _MEMBER.split(", ")])

    return run


def _placed(archive: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open(archive, "r+b") as out, open(row["file"], "rb") as given:
                    out.seek(row["at"])
                    out.write(_local(row))
                    shutil.copyfileobj(given, out, _STEP)
            yield pa.RecordBatch.from_arrays([batch["release_path"]], ["release_path"])

    return run


def archive(spark: SparkSession, target: str, path: str) -> int:
    """A zip of the files that the newest manifest names, put at `path` at once; how many members it has."""
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    os.makedirs(folder)
    made = f"{folder}/archive"
    try:
        listed = manifest(spark, target).select("release_path", "sha256")
        packed = listed.repartition(8 * spark.sparkContext.defaultParallelism, "release_path").mapInArrow(_packed(target, folder), _MEMBER)
        rows = [r.asDict() for r in packed.collect()]  # a row a file, as the central directory has one
        rows.sort(key=lambda r: r["release_path"])
        at = 0
        for row in rows:
            row["at"] = at
            at += len(_local(row)) + row["packed"]
        with open(made, "wb") as out:
            out.truncate(at)
        if rows:
            placed = [(r["release_path"], r["file"], r["crc"], r["packed"], r["size"], r["modified"], r["at"]) for r in rows]
            _dealt(spark, placed, f"{_MEMBER}, at long").mapInArrow(_placed(made), "release_path string").write.format("noop").mode("overwrite").save()
        directory = b"".join(_central(r, r["at"]) for r in rows)
        end = at + len(directory)
        with open(made, "r+b") as out:
            out.seek(at)
            out.write(directory)
            out.write(struct.pack("<IQHHIIQQQQ", _END64, 44, _VERSION, _VERSION, 0, 0, len(rows), len(rows), len(directory), at))
            out.write(struct.pack("<IIQI", _AT64, 0, end, 1))
            out.write(struct.pack("<IHHHHIIH", _END, 0, 0, min(len(rows), 0xFFFF), min(len(rows), 0xFFFF), min(len(directory), _LARGE), min(at, _LARGE), 0))
        os.replace(made, path)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return len(rows)
