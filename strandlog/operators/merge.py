"""Absorbing one ledger into another: key-deduplicated unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = {"authors": ["id"], "sections": ["section_hash"], "documents": ["line_hash", "file"], "tokens": ["token_count", "__sources", "tokenizer"]}


def _keyed(df: DataFrame, layer: str) -> DataFrame:
    return df.withColumn("__sources", F.to_json(F.array_sort(F.coalesce("sources", F.array().cast("array<string>"))))) if layer == "tokens" else df


def new_records(target: DataFrame, source: DataFrame, layer: str, dedupe: bool = True) -> DataFrame:
    """Records of source whose key target lacks, one for each key. Records without a whole key are skipped."""
    if not dedupe:
        return source
    keys = KEYS[layer]
    own = _keyed(source, layer).dropna(subset=keys)
    return own.join(_keyed(target, layer).select(*keys), keys, "left_anti").dropDuplicates(keys).drop("__sources").select(*source.columns)


def absorb_counts(target: DataFrame, source: DataFrame, layer: str, dedupe: bool = True) -> DataFrame:
    """One row (layer, added, skipped)."""
    added = new_records(target, source, layer, dedupe).agg(F.count("*").alias("added"))
    total = source.agg(F.count("*").alias("total"))
    return added.crossJoin(total).select(F.lit(layer).alias("layer"), "added", (F.col("total") - F.col("added")).alias("skipped"))


def absorb(target: DataFrame, source: DataFrame, layer: str, dedupe: bool = True) -> DataFrame:
    return target.unionByName(new_records(target, source, layer, dedupe), allowMissingColumns=True)
