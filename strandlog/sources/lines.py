"""Line-oriented sources: JSON Lines, tracked data files, sharded layers, staged batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.functions.hashing import line_hash_column
from strandlog.sources.files import exists

#: Where a row of a file source stands: its file and the first byte of the split that holds it.
BLOCK = ("_metadata.file_path", "_metadata.file_block_start")


def _placed(df: DataFrame) -> DataFrame:
    """df of a file source with the columns __file and __block."""
    return df.select("*", *[F.col(c).alias(n) for c, n in zip(BLOCK, ("__file", "__block"), strict=True)])


def _numbered(placed: DataFrame, name: str, first: int, order: tuple[str, ...] = ("__file", "__block")) -> DataFrame:
    """Rows of _placed with their numbers from first on, in the order of files and of places in them. A task reads each
    split in order, so a row's place in its split is its id less the least one there; the rows of the splits before it
    are a running sum over one row for each split. Nothing but those sums is shuffled."""
    marked = placed.withColumn("__m", F.monotonically_increasing_id())
    ahead = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    splits = marked.groupBy(*order).agg(F.count("*").alias("__n"), F.min("__m").alias("__least"))
    base = splits.withColumn("__base", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).drop("__n")
    joined = marked.join(base, list(order))
    return joined.withColumn(name, (F.col("__base") + F.col("__m") - F.col("__least") + first).cast("long")).drop("__file", "__block", "__m", "__base", "__least")


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without a trailing carriage return, blank ones left out; none for a missing path."""
    if not exists(spark, path):
        return spark.createDataFrame([], "line string")
    lines = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("line"))
    return lines.where(F.length("line") > 0)


def numbered_lines(spark: SparkSession, path: str, text_mode: str = "raw") -> DataFrame:
    """Rows (line_no, line, line_hash) of a file, or of the files of a folder by name: physical lines from 1 on; blank
    lines count but are left out."""
    if not exists(spark, path):
        return spark.createDataFrame([], "line_no long, line string, line_hash string")
    numbered = _numbered(_placed(spark.read.text(path)), "line_no", 1)
    clean = numbered.select("line_no", F.regexp_replace("value", r"\r$", "").alias("line")).where(F.length(F.trim("line")) > 0)
    return clean.withColumn("line_hash", line_hash_column(F.col("line"), text_mode))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, keep_bad: bool = False) -> DataFrame:
    """Records of a fixed schema; malformed lines are left out, or kept in _corrupt_record with keep_bad."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    found = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return found if keep_bad else found.where("_corrupt_record is null").select(*schema.names)


def bad_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row (lines, malformed): what read_json_lines leaves out of a path."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = F.from_json("line", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    found = read_text_lines(spark, path).where(F.length(F.trim("line")) > 0).select(parsed["_corrupt_record"].alias("bad"))
    return found.agg(F.count("*").alias("lines"), F.count("bad").alias("malformed"))


def read_layer(spark: SparkSession, path: str, schema: T.StructType, all_files: bool = False) -> DataFrame:
    """A layer of two-digit shard files (or of whatever files it has), with the shard of each record."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("bucket", F.lit(None).cast("string"))
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED")
    if not all_files:
        reader = reader.option("pathGlobFilter", "[0-9a-f][0-9a-f]")
    return reader.json(path).withColumn("bucket", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def with_bucket(df: DataFrame, key: str) -> DataFrame:
    """The shard of a 64-digit hexadecimal key; an error for another key."""
    good = F.col(key).rlike("^[0-9a-f]{64}$")
    bad = F.raise_error(F.concat(F.lit("not a 64-digit key: "), F.coalesce(key, F.lit("null")))).cast("string")
    return df.withColumn("bucket", F.when(good, F.substring(key, 1, 2)).otherwise(bad))


def read_token_files(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Token entries of numbered files, in the order of file number and line, which fixes their positions from 0 on."""
    schema = T.StructType([T.StructField("token_count", T.LongType()), T.StructField("sources", T.ArrayType(T.StringType())), T.StructField("tokenizer", T.StringType()), T.StructField("revoked", T.BooleanType())])
    if not exists(spark, path):
        return spark.createDataFrame([], schema).select(F.lit(0).cast("long").alias("pos"), F.lit(0).alias("file_number"), "*")
    placed = _placed(spark.read.option("pathGlobFilter", "[0-9]*").text(path))
    lines = placed.select("__file", "__block", F.regexp_extract("__file", r"([0-9]+)$", 1).cast("int").alias("file_number"), F.from_json("value", schema).alias("r"))
    good = lines.where("r is not null and r.token_count is not null").select("__file", "__block", "file_number", "r.token_count", F.coalesce("r.sources", F.array().cast("array<string>")).alias("sources"), F.coalesce("r.tokenizer", F.lit(tokenizer)).alias("tokenizer"), F.coalesce("r.revoked", F.lit(False)).alias("revoked"))
    return _numbered(good, "pos", 0, ("file_number", "__file", "__block"))


def slice_lines(numbered: DataFrame, start: int, most: int) -> DataFrame:
    """Up to ``most`` lines after the first ``start``, by their numbers."""
    return numbered.where((F.col("line_no") > start) & (F.col("line_no") <= start + most))


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
