"""Revocation as append-only events, effective flags, and what follows from them for data files.

An event is (seq, level, key, file, tokenizer, action); level is author, section, line or token. The last event of a
key decides. So revoking twice is revoking once, and restoring brings back what was there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.operators.provenance import active_records, is_revoked, revoked_records

LEVELS = {"author": ("id", None, None), "section": ("section_hash", None, None), "line": ("line_hash", "file", None), "token": ("pos", None, "tokenizer")}


def effective_flags(records: DataFrame, events: DataFrame, level: str) -> DataFrame:
    """records with revoked as the last event of their key says, else as stored."""
    key, file, tokenizer = LEVELS[level]
    last = events.where(F.col("level") == level).groupBy("key", "file", "tokenizer").agg((F.max_by("action", "seq") == "revoke").alias("__said"))
    last = last.withColumnsRenamed({"key": "__key", "file": "__file", "tokenizer": "__tokenizer"})
    on = F.col(key).cast("string") == F.col("__key")
    if file:
        on = on & F.col(file).eqNullSafe(F.col("__file"))
    if tokenizer:
        on = on & F.col(tokenizer).eqNullSafe(F.col("__tokenizer"))
    return records.join(last, on, "left").withColumn("revoked", F.coalesce("__said", is_revoked())).drop("__said", "__key", "__file", "__tokenizer")


def changes(records: DataFrame, level: str, action: str, toggle: bool = False) -> DataFrame:
    """Events (without seq) for the records whose state the action changes; with toggle, for all, flipped."""
    key, file, tokenizer = LEVELS[level]
    if not toggle:
        records = records.where(~is_revoked() if action == "revoke" else is_revoked())
    said = F.when(is_revoked(), "restore").otherwise("revoke") if toggle else F.lit(action)
    none = F.lit(None).cast("string")
    return records.select(
        F.lit(level).alias("level"),
        F.col(key).cast("string").alias("key"),
        (F.col(file) if file else none).alias("file"),
        (F.col(tokenizer) if tokenizer else none).alias("tokenizer"),
        said.alias("action"),
    ).distinct()


def purge_set(records: DataFrame, sections: DataFrame, authors: DataFrame, scope: str = "all") -> DataFrame:
    """Line hashes to purge: with a revoked source or revoked themselves; with scope 'section', those with a directly
    revoked section only."""
    if scope == "section":
        hit = records.select("line_hash", F.explode("sources").alias("section_hash")).join(sections.where(is_revoked()).select("section_hash"), "section_hash", "left_semi")
        return hit.select("line_hash").distinct()
    return revoked_records(records, sections, authors).select("line_hash").distinct()


def purge_split(lines: DataFrame, hashes: DataFrame, hash_column: str = "line_hash") -> tuple[DataFrame, DataFrame]:
    """(kept, purged) lines of a data file."""
    gone = hashes.select(F.col("line_hash").alias(hash_column)).distinct()
    return lines.join(gone, hash_column, "left_anti"), lines.join(gone, hash_column, "left_semi")


__all__ = ["active_records", "changes", "effective_flags", "purge_set", "purge_split"]
