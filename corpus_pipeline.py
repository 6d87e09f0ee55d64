"""A corpus pipeline of five operators: from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again for the next.
All but the last return the columns of docs, with the names and types they came with (columns whose names an operator
would add are set aside and put back). Null texts go with the language stage, as they have no letter. Rows without
doc_id are judged by their text alone: they are no near duplicates and no part of repeated passages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm import language, packing, similar, substrings, toxicity
from strandlog.llm.common import materialize, table


def _aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with its own columns of these names renamed, and a function that selects docs' columns from a result."""
    lower = {n.lower() for n in names}
    renamed = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c.lower() in lower}
    out = docs.withColumnsRenamed(renamed)
    return out, lambda df: df.select(*[F.col(f"`{renamed.get(c, c)}`").alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 1 / 15) -> DataFrame:
    """Documents without letters (null and empty texts too) go, and those whose score lies less than ``least`` of the way
    from chance (1/L for L learned languages) to 1. This finds texts between languages; it is no test for languages that
    were not learned, which the network may take for one that was."""
    own, back = _aside(docs, ["lang_pred", "score"])
    learned = docs.select("doc_id", "text", "lang").where(language.split_rest() != 2)
    net = language.fit(learned)
    chance = 1 / len(net.labels) if net else 1.0
    marked = language.apply(own, net)
    return back(marked.where((F.col("lang_pred") != "und") & (F.col("score") >= chance + least * (1 - chance) - 1e-9)))


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    own, back = _aside(docs, ["score", "predicted"])
    scorer = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return back(toxicity.apply(own, scorer).where("predicted = 0"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, small: int = 300_000) -> DataFrame:
    """Of each connected group of similar documents, the one with the smallest doc_id stays (among several texts of that
    id, the one of the smallest hash; of rows that repeat both, one). Documents without words or without doc_id are in no
    group and stay, all rows of them. Up to ``small`` verdicts are broadcast to the documents."""
    inner = ["__text_hash", "__verdict"]
    own, back = _aside(docs, [*inner, "__id"])
    rows = materialize(similar.labelled(docs).where("n_shingles > 0 and doc_id is not null").select("doc_id", "text_hash", "component_id"))
    # of a group's rows with its smallest doc_id, the smallest hash; copies are one row of (doc_id, text_hash)
    texts = rows.groupBy("doc_id", "text_hash").agg(F.first("component_id").alias("component_id"), F.count("*").alias("n"))
    first = texts.where("doc_id = component_id").groupBy("component_id").agg(F.min("text_hash").alias("first"))
    judged = texts.join(first, "component_id").withColumn("__verdict", F.when((F.col("doc_id") != F.col("component_id")) | (F.col("text_hash") != F.col("first")), "goes").when(F.col("n") > 1, "once"))
    verdicts = materialize(judged.where("__verdict is not null").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text_hash"), "__verdict"))
    few = verdicts.count() <= small
    keyed = own.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__text_hash", F.xxhash64("text"))
    marked = keyed.join(F.broadcast(verdicts) if few else verdicts, ["__id", "__text_hash"], "left")
    stay = back(marked.where("__verdict is null"))
    if verdicts.where("__verdict = 'once'").isEmpty():
        return stay
    return stay.unionByName(back(marked.where("__verdict = 'once'").dropDuplicates(["__id", "__text_hash"])))


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat an earlier one leave the texts; n_chars follows. No row goes."""
    own, back = _aside(docs, ["n_words", "n_removed"])
    cut = back(substrings.remove_repeats(own))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("passages", remove_passages),
    ("packing", pack),
]

#: SQL can express neither the trained models nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
