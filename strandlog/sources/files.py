"""Small files and folders through Hadoop's file systems, so that a ledger may lie wherever Spark can write."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where) and system.getFileStatus(where).isDirectory()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none for a missing one."""
    system, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []


def size(spark: SparkSession, path: str) -> int:
    system, where = _at(spark, path)
    return system.getContentSummary(where).getLength()


def make_folder(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.mkdirs(where)


def delete(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, null if it is missing."""
    system, where = _at(spark, path)
    if not system.exists(where):
        return None
    stream = system.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_by(spark: SparkSession, new: str, old: str) -> None:
    """Rename new to old, which is overwritten, in one step."""
    jvm = spark._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    where = [jvm.org.apache.hadoop.fs.Path(p) for p in (new, old)]
    qualified = [p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p) for p in where]
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified[1].toUri(), spark._jsc.hadoopConfiguration()).rename(*qualified, how)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file aside and rename it: readers see the old text or the new one."""
    aside = f"{path}.{uuid.uuid4().hex}"
    system, where = _at(spark, aside)
    stream = system.create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    replace_by(spark, aside, path)


def swap(spark: SparkSession, written: str, target: str) -> None:
    """Put a folder of part files, in order, in the place of target. A target that is one file stays one: its parts are
    copied to a file aside, stream by stream, which then replaces it in one step. A folder is renamed away first and
    deleted last; after a failure between the two renames it lies beside, as ``<target>.before``."""
    system, where = _at(spark, target)
    if is_folder(spark, target):
        before = f"{target}.before"
        delete(spark, before)
        replace_by(spark, target, before)
        replace_by(spark, written, target)
        delete(spark, before)
        return
    aside = f"{target}.{uuid.uuid4().hex}"
    out = system.create(_at(spark, aside)[1], True)
    try:
        for name in names(spark, written):
            if name.startswith("part-"):
                part = system.open(_at(spark, f"{written}/{name}")[1])
                try:
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                finally:
                    part.close()
    finally:
        out.close()
    replace_by(spark, aside, target)
    delete(spark, written)
