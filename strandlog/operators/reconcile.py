"""Reconciling a changed data file with its records: by content hash, then by embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.errors import InvalidRecord
from strandlog.operators.provenance import is_revoked


def manifest(records: DataFrame, file: str) -> DataFrame:
    """Records of a file that are not revoked."""
    return records.where((F.col("file") == file) & ~is_revoked())


def line_states(lines: DataFrame, known: DataFrame) -> DataFrame:
    """lines: (line_no, line_hash); known: a manifest. Rows (line_no, line_hash, status): matched, new, or duplicate
    (a line that repeats an earlier one), and orphan for records without a line (line_no null)."""
    first = Window.partitionBy("line_hash").orderBy("line_no")
    marked = lines.select("line_no", "line_hash").withColumn("n", F.row_number().over(first))
    hashes = known.select("line_hash").distinct().withColumn("known", F.lit(True))
    joined = marked.join(hashes, "line_hash", "full_outer")
    status = F.when(F.col("line_no").isNull(), "orphan").when(F.col("n") > 1, "duplicate").when(F.col("known"), "matched").otherwise("new")
    return joined.select("line_no", "line_hash", status.alias("status"))


def state_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("status").agg(F.count("*").alias("n"))


def nearest_old(new: DataFrame, old: DataFrame, block_rows: int = 2048) -> DataFrame:
    """new, old: (id, seq, embedding). Rows (new_id, new_seq, old_id, similarity): the most similar old vector of each
    new one, the earliest of equals. Rows are normalised (a zero vector stays zero) and compared block by block as
    matrix products; each pair of blocks is one task's row, and only a best match for each row leaves it."""
    blocks = lambda df, kind: df.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-df.count() // block_rows))))).groupBy("b").agg(F.collect_list(F.struct("id", "seq", "embedding")).alias(kind)).drop("b")
    left, right = blocks(new, "n"), blocks(old, "o")

    def unit(rows: list) -> tuple[list, np.ndarray]:
        v = np.array([r["embedding"] for r in rows], float)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return rows, v / np.where(norm == 0, 1.0, norm)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n_rows, o_rows in zip(batch["n"], batch["o"], strict=True):
                n_rows, a = unit(list(n_rows))
                o_rows, b = unit(sorted(o_rows, key=lambda r: r["seq"]))
                s = a @ b.T
                at = s.argmax(1)
                yield pd.DataFrame(
                    {
                        "new_id": [r["id"] for r in n_rows],
                        "new_seq": [r["seq"] for r in n_rows],
                        "old_id": [o_rows[j]["id"] for j in at],
                        "old_seq": [o_rows[j]["seq"] for j in at],
                        "similarity": s[np.arange(len(a)), at],
                    }
                )

    kind = dict(new.dtypes)["id"]
    pairs = left.crossJoin(right)  # blocks, not rows
    found = pairs.mapInPandas(best, f"new_id {kind}, new_seq long, old_id {kind}, old_seq long, similarity double")
    order = Window.partitionBy("new_id").orderBy(F.col("similarity").desc(), "old_seq")
    return found.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r", "old_seq")


def match_moved(best: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Of each new line's best match, those at or over the threshold; an old record goes to the first line that wants
    it, and the others get none."""
    order = Window.partitionBy("old_id").orderBy("new_seq")
    return best.where(F.col("similarity") >= threshold).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def encode_lines(lines: DataFrame, encode: Callable[[list[str]], list[list[float]]], text_column: str = "line", batch: int = 64) -> DataFrame:
    """lines with an embedding column by an encoder for batches of texts."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[text_column].tolist()
            vectors: list = []
            for at in range(0, len(texts), batch):
                vectors += [[float(x) for x in v] for v in encode(texts[at : at + batch])]
            yield frame.assign(embedding=vectors)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields)
    return lines.mapInPandas(work, f"{schema}, embedding array<double>")


def lines_to_embed(lines: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """lines (line_no, line_hash, line): one for each content that the model has no embedding of, the first one."""
    done = embeddings.where((F.col("model") == model) & F.col("embedding").isNotNull()).select("line_hash")
    rest = lines.join(done, "line_hash", "left_anti")
    return rest.groupBy("line_hash").agg(F.min(F.struct("line_no", "line")).alias("r")).select("r.line_no", "line_hash", "r.line")


def http_encoder(url: str, model: str, timeout: float = 60.0, tries: int = 3, pause: float = 1.0) -> Callable[[list[str]], list[list[float]]]:
    """An encoder that asks a service with an OpenAI-compatible /embeddings route. A request that fails on the way, or
    by the service's own fault (status 429 or 5xx), is sent again after a pause that doubles; an answer that does not
    hold one vector for each text is an InvalidRecord."""

    def encode(texts: list[str]) -> list[list[float]]:
        import json
        import time
        import urllib.error
        import urllib.request

        body = json.dumps({"model": model, "input": texts}).encode()
        ask = urllib.request.Request(url.rstrip("/") + "/embeddings", body, {"Content-Type": "application/json"})
        for n in range(tries):
            try:
                with urllib.request.urlopen(ask, timeout=timeout) as answer:
                    found = json.load(answer)["data"]
                break
            except urllib.error.URLError as failed:
                status = getattr(failed, "code", 500)
                if n + 1 == tries or not (status == 429 or status >= 500):
                    raise
                time.sleep(pause * 2**n)
        if sorted(x["index"] for x in found) != list(range(len(texts))):
            raise InvalidRecord(f"{len(found)} vectors for {len(texts)} texts")
        return [x["embedding"] for x in sorted(found, key=lambda x: x["index"])]

    return encode


def local_encoder(load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[list[str]], list[list[float]]]:
    """An encoder that loads its model once for each Python worker."""
    held: list = []

    def encode(texts: list[str]) -> list[list[float]]:
        if not held:
            held.append(load())
        return held[0](texts)

    return encode


def move_provenance(records: DataFrame, matches: DataFrame, file: str) -> tuple[DataFrame, DataFrame]:
    """(records after, records replaced): a matched old record of the file gives its sources to the new line hash
    (new_id); its source_type becomes reconcile."""
    pairs = matches.select(F.col("old_id").alias("line_hash"), F.col("new_id").alias("__new"))
    own = records.where((F.col("file") == file) & ~is_revoked())
    moved = own.join(pairs, "line_hash")
    new = moved.withColumn("line_hash", F.col("__new")).withColumn("source_type", F.lit("reconcile")).withColumn("revoked", F.lit(False)).withColumn("orphan", F.lit(False)).drop("__new").select(*records.columns)
    replaced = moved.drop("__new").select(*records.columns)
    stay = records.join(pairs.select("line_hash", F.lit(file).alias("file"), F.lit(False).alias("revoked")), ["line_hash", "file", "revoked"], "left_anti").select(*records.columns)
    return stay.unionByName(new), replaced


def tag_orphans(records: DataFrame, states: DataFrame, file: str) -> DataFrame:
    """Records of the file whose line is gone get orphan = true."""
    gone = states.where("status = 'orphan'").select("line_hash").distinct().withColumn("__gone", F.lit(True))
    mark = (F.col("file") == file) & F.coalesce("__gone", F.lit(False)) & ~is_revoked()
    return records.join(gone, "line_hash", "left").withColumn("orphan", F.when(mark, True).otherwise(F.coalesce("orphan", F.lit(False)))).select(*records.columns)
