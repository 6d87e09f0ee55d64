"""The token layer: entries at fixed positions, their totals, ranges and removal bitmasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.errors import NotFound
from strandlog.operators.provenance import is_revoked


def tokenizers(tokens: DataFrame) -> DataFrame:
    return tokens.select("tokenizer").distinct().orderBy("tokenizer")


def source_positions(tokens: DataFrame) -> DataFrame:
    """The inverted index: rows (tokenizer, source_hash, pos)."""
    return tokens.select("tokenizer", F.explode("sources").alias("source_hash"), "pos")


def entries_of_sections(tokens: DataFrame, hashes: DataFrame) -> DataFrame:
    """Entries with any source among the hashes (section_hash); an entry is (tokenizer, pos)."""
    hit = source_positions(tokens).join(hashes.select(F.col("section_hash").alias("source_hash")), "source_hash", "left_semi")
    return tokens.join(hit.select("tokenizer", "pos").distinct(), ["tokenizer", "pos"], "left_semi")


def token_show(tokens: DataFrame, hashes: DataFrame, tokenizer: str, revoked: bool = False) -> DataFrame:
    """Active (or revoked) entries of one tokenizer from these sections."""
    own = tokens.where(F.col("tokenizer") == tokenizer).where(is_revoked() if revoked else ~is_revoked())
    return entries_of_sections(own, hashes)


def token_totals(entries: DataFrame) -> DataFrame:
    """One row (total_tokens, documents)."""
    return entries.agg(F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("total_tokens"), F.count("*").alias("documents"))


def token_status(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """One row (total, active, revoked, total_tokens); tokens count over all entries."""
    return tokens.where(F.col("tokenizer") == tokenizer).agg(
        F.count("*").alias("total"),
        F.count_if(~is_revoked()).alias("active"),
        F.count_if(is_revoked()).alias("revoked"),
        F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("total_tokens"),
    )


def token_ranges(tokens: DataFrame, tokenizer: str, block: int = 100_000) -> DataFrame:
    """Rows (pos, start, end): entry i covers tokens start to end (exclusive). Prefix sums in two passes: totals of
    blocks of positions, then sums within each block, so that no task sorts a whole tokenizer."""
    own = tokens.where(F.col("tokenizer") == tokenizer).select("pos", "token_count").withColumn("b", F.floor(F.col("pos") / block))
    ahead = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    base = own.groupBy("b").agg(F.sum("token_count").alias("t")).select("b", F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("base"))
    within = Window.partitionBy("b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = own.withColumn("upto", F.sum("token_count").over(within)).join(base, "b")
    return summed.select("pos", (F.col("base") + F.col("upto") - F.col("token_count")).cast("long").alias("start"), (F.col("base") + F.col("upto")).cast("long").alias("end"))


def removal_bytes(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """Rows (byte_idx, byte): bit pos % 8 of byte pos / 8 is set for revoked entries, least bit first."""
    bit = F.when(is_revoked(), F.expr("shiftleft(1, cast(pos % 8 as int))")).otherwise(0)
    return tokens.where(F.col("tokenizer") == tokenizer).groupBy(F.floor(F.col("pos") / 8).cast("long").alias("byte_idx")).agg(F.sum(bit).cast("int").alias("byte"))


def popcount(removal: DataFrame) -> DataFrame:
    return removal.agg(F.coalesce(F.sum(F.bit_count("byte")), F.lit(0)).cast("long").alias("revoked"))


def write_removal_set(removal: DataFrame, path: str) -> int:
    """Write the bitmask, streamed in order; a byte that has no entry is zero. Returns the number of bytes."""
    written = 0
    with open(path, "wb") as out:
        for row in removal.orderBy("byte_idx").toLocalIterator():
            out.write(bytes(row["byte_idx"] - written) + bytes([row["byte"]]))
            written = row["byte_idx"] + 1
    return written


def entry_at(tokens: DataFrame, tokenizer: str, pos: int) -> DataFrame:
    """The entry at a position: no row beyond the last one; NotFound for a negative position."""
    if pos < 0:
        raise NotFound(f"position {pos}")
    return tokens.where((F.col("tokenizer") == tokenizer) & (F.col("pos") == pos))


def write_source_index(tokens: DataFrame, path: str, files: int = 64) -> None:
    """The inverted index as a table clustered by source: each source's positions lie in one range of files (more than
    one if there are many), so that a lookup reads the row groups whose bounds hold its hash."""
    source_positions(tokens).repartitionByRange(files, "source_hash", "pos").sortWithinPartitions("source_hash", "pos").write.mode("overwrite").parquet(path)


def lookup_source(index: DataFrame, tokenizer: str, source_hash: str) -> DataFrame:
    """Positions of one source, from the index."""
    return index.where((F.col("source_hash") == source_hash) & (F.col("tokenizer") == tokenizer)).select("pos")


def number_appended(entries: DataFrame, first: Column | int, order: list[str], aside: str) -> DataFrame:
    """entries with pos from first on, in the given order. Numbers are dealt in two passes (rows of each range
    partition, then places within it), so that a large batch is not sorted in one task. The bounds of the ranges are
    sampled: the ranges are written to the folder aside once, and both passes read them there."""
    parted = entries.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    parted.write.mode("overwrite").parquet(aside)
    parted = entries.sparkSession.read.parquet(aside)
    sizes = parted.groupBy("__p").count()
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    base = sizes.select("__p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    place = F.col("__m").bitwiseAND((1 << 33) - 1)
    start = first if isinstance(first, Column) else F.lit(first)
    return parted.withColumn("__at", place).join(base, "__p").withColumn("pos", (start + F.col("__base") + F.col("__at")).cast("long")).drop("__p", "__m", "__at", "__base")
