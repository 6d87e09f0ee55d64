"""Operator 1: exact top-k search by distributed histogram selection.

Vectors are whole numbers (floor(1024 * x)), a score is their inner product. The vectors lie in packed chunks, the
queries in packed blocks; every chunk meets every block once in a pass. The blocks, with the state of their queries, are
broadcast to the chunks where they lie as long as they are under ``small`` bytes; beyond that chunks and blocks meet by
a shuffle (a chunk is copied once for each block of queries, never once for each query). A pass scores everything again and keeps no scores: it counts, for each query, how
many fall into each of ``bins`` equal parts of the interval that must hold the k-th best. Spark sums the counts, the
interval becomes the part that holds the k-th, and after a few passes it is one value: the exact k-th score. A last pass
emits what is above it (fewer than k rows for a query) and of the scores equal to it the smallest vec_ids that a chunk
can contribute; ranking these breaks ties by vec_id.

Defined results: vectors that are null or empty or hold a null, NaN or infinite component take no part, nor do rows
without vec_id, nor vectors with a whole number over 2**30 / sqrt(length), whose scores might not fit 64 bits. Vectors of different lengths are compared over their common components. Rows that repeat vec_id and
vector count once; if one vec_id has several vectors, each is a candidate and the smallest is the query. Fewer than k
candidates: all are returned. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.llm.common import materialize, table

#: Sums of products below this are exact in float64.
EXACT = 1 << 53
#: The largest whole number of a vector of one component; scores and intervals stay within 2**61.
REACH = 1 << 30


def whole_numbers(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """Rows (vec_id, v array<long>) of the vectors that take part."""
    x = F.transform(F.col(vector_column), lambda c: c.cast("double"))
    most = F.lit(float(REACH)) / F.sqrt(F.size(x).cast("double"))
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) <= most - 1))
    v = F.when((F.size(x) > 0) & usable, F.transform(x, lambda c: F.floor(c * scale)))
    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")


def _pack(wide: int, kind: str):
    """Rows of one chunk or block, as one row: ids and a matrix, repeats once, sorted by vec_id."""

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        lists = rows.column("v").combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.cumsum(np.diff(lists.offsets.to_numpy()))
        matrix = np.zeros((len(lists), wide), np.int64)
        size = np.diff(np.append(0, ends))
        row = np.repeat(np.arange(len(size)), size)
        matrix[row, np.arange(len(flat)) - np.repeat(ends - size, size)] = flat
        ids = rows.column("vec_id").to_numpy()
        both = np.unique(np.column_stack([ids, matrix]), axis=0)
        if kind == "block":
            both = both[np.append(True, both[1:, 0] != both[:-1, 0])]
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([both[:, 0].tobytes()], pa.binary()), pa.array([np.ascontiguousarray(both[:, 1:]).tobytes()], pa.binary())], names=[kind, "ids", "matrix"])

    return pack


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, bins: int = 256, chunk_rows: int = 4096, block_rows: int = 512, small: int = 32 << 20) -> DataFrame:
    """vectors: (vec_id, v). Rows (query_id, rank, vec_id, score)."""
    rows = materialize(vectors.withColumn("is_query", is_query))
    n, queries, wide, most = rows.agg(F.count("*"), F.count_if("is_query"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    spark = vectors.sparkSession
    if not n or not queries:
        return spark.createDataFrame([], schema)
    chunks, blocks = 8 + n // chunk_rows, 1 + queries // block_rows
    exact = wide * most * most < EXACT
    reach = min(int(wide * most * most), REACH * REACH) + 1
    part = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count))
    packed = materialize(rows.withColumn("chunk", part(chunks)).groupBy("chunk").applyInArrow(_pack(wide, "chunk"), "chunk long, ids binary, matrix binary"))
    block = materialize(rows.where("is_query").withColumn("block", part(blocks)).groupBy("block").applyInArrow(_pack(wide, "block"), "block long, ids binary, matrix binary"))
    dealt = packed.select(F.col("chunk"), F.col("ids").alias("c_ids"), F.col("matrix").alias("c_matrix"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def score(row_ids: np.ndarray, ids: np.ndarray, q: np.ndarray, v: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Scores in slices of queries, and which candidates are the query itself."""
        q, v = q.reshape(-1, wide), v.reshape(-1, wide)
        if exact:
            q, v = q.astype(np.float64), v.astype(np.float64)
        for a in range(0, len(q), 128):
            part_ = slice(a, a + 128)
            yield part_, (q[part_] @ v.T).astype(np.int64), row_ids[part_, None] == ids[None, :]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, c_ids, c_matrix, ids, matrix, low, step, span in zip(*[batch.column(x).to_pylist() for x in ("block", "c_ids", "c_matrix", "ids", "matrix", "low", "step", "span")], strict=True):
                ids, c_ids, low = _numbers(ids), _numbers(c_ids), np.array(low)
                for at, s, own in score(ids, c_ids, _numbers(matrix), _numbers(c_matrix)):
                    over = s - low[at, None]
                    keep = (over >= 0) & (over < span) & ~own
                    place = over // step
                    row = np.nonzero(keep)[0]
                    found, times = np.unique(row * bins + place[keep], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), b)), pa.array(ids[at][found // bins]), pa.array(found % bins), pa.array(times)], ["block", "query_id", "bin", "n"])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c_ids, c_matrix, ids, matrix, low, above in zip(*[batch.column(x).to_pylist() for x in ("c_ids", "c_matrix", "ids", "matrix", "low", "above")], strict=True):
                ids, c_ids, low, above = _numbers(ids), _numbers(c_ids), np.array(low), np.array(above)
                for at, s, own in score(ids, c_ids, _numbers(matrix), _numbers(c_matrix)):
                    over, tie = (s > low[at, None]) & ~own, (s == low[at, None]) & ~own
                    tie &= np.cumsum(tie, 1) <= k - above[at, None]  # a chunk's ids ascend
                    row, column = np.nonzero(over | tie)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at][row]), pa.array(c_ids[column]), pa.array(s[row, column])], ["query_id", "vec_id", "score"])

    # state of a query: the interval from low on, bins parts of step each, and how many scores are above it
    width = 2 * reach + 1
    span, step = width, -(-width // bins)
    unpacked = F.transform(F.sequence(F.lit(1), F.expr("length(ids) div 8")), lambda i: F.lit(-reach).cast("long"))
    state = block.select("block", "ids", "matrix", unpacked.alias("low"), F.transform(unpacked, lambda x: F.lit(0).cast("long")).alias("above"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def meet(now: DataFrame) -> DataFrame:
        if queries * (wide + 3) * 8 <= small:
            return dealt.join(F.broadcast(now), "block")
        return dealt.join(now, "block").repartition(parts, "chunk", "block")

    while True:
        now = state.withColumn("step", F.lit(step).cast("long")).withColumn("span", F.lit(span).cast("long"))
        counted = materialize(meet(now).mapInArrow(count, "block long, query_id long, bin long, n long").groupBy("block", "query_id", "bin").agg(F.sum("n").alias("n")), 1)
        upward = Window.partitionBy("block", "query_id").orderBy(F.col("bin").desc())
        running = counted.withColumn("from_top", F.sum("n").over(upward)).groupBy("block", "query_id").agg(F.array_sort(F.collect_list(F.struct("from_top", "bin", "n"))).alias("h"))
        by_block = running.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "h"))).alias("found"))

        def narrow(batches: Iterator[pa.RecordBatch], step: int = step) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for ids, low, above, found in zip(*[batch.column(x).to_pylist() for x in ("ids", "low", "above", "found")], strict=True):
                    hist = dict(found or [])
                    new_low, new_above = list(low), list(above)
                    for i, q in enumerate(_numbers(ids).tolist()):
                        for x in hist.get(q, []):
                            if above[i] + x["from_top"] >= k:
                                new_low[i], new_above[i] = low[i] + x["bin"] * step, above[i] + x["from_top"] - x["n"]
                                break
                    out.append((new_low, new_above))
                yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("ids"), batch.column("matrix"), *[pa.array([o[j] for o in out], pa.list_(pa.int64())) for j in (0, 1)]], ["block", "ids", "matrix", "low", "above"])

        state = materialize(state.join(by_block, "block", "left").select("block", "ids", "matrix", "low", "above", "found").mapInArrow(narrow, "block long, ids binary, matrix binary, low array<long>, above array<long>"))
        if step == 1:
            break
        span, step = step, -(-step // bins)
    best = materialize(meet(state).mapInArrow(select, "query_id long, vec_id long, score long"), 1)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_numbers(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, F.col("vec_id") % 100 == 0, k=10)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
