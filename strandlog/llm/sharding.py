"""Operator 5: sharding by histogram sort, DataFrame functions only.

Rows are sorted by (hash of the text, doc_id), so that equal texts lie together and only a shard's edge cuts a group.
The splitters are found without sorting: in rounds, exact bytes are summed for the digits of the keys that could
still be a splitter, and every open interval is narrowed until the bytes below a boundary are within the tolerance
of its target. Then rows are exchanged once, by shard and cell (a shard is cut into ``cells`` key ranges by the same
rounds, so that no task gets a whole shard or a whole group of equal texts; more of them where a cell would hold over
``cell_rows``, up to ``MOST_CELLS``), and numbered.

Defined results: a null text counts as empty (16 bytes, crc32 0). Among equal texts, rows without doc_id come first, as
if it were the smallest; like other rows of one key they are not parted. Rows that repeat a key (same text and doc_id) are
kept, lie in one shard and get different slots. An empty table gives an empty result. Columns other than doc_id and
text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.llm.common import materialize, table

#: Bits of a key: 60 of the text's hash, then 64 of doc_id (sign flipped).
HASH_BITS, ID_BITS = 60, 64
#: Bits that a round adds: the first histogram has 2**14 bins, a later one 2**6 for each open interval.
WIDTHS = [14, *[6] * 7, 4, *[6] * 10, 4]
LEAST = -(1 << 63)
MOST_CELLS = 256


def slim_rows(docs: DataFrame) -> DataFrame:
    """What sorting needs of a document: no text travels in the rounds or the exchange."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("id"),
        (F.octet_length(text).cast("long") + F.lit(16)).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - HASH_BITS).alias("h"),
    )


def _histogram(rows: DataFrame, done: int, width: int, prefixes: list[int]) -> dict[int, dict[int, tuple[int, int]]]:
    """Bytes and rows by next digit (``width`` bits after ``done`` bits) of the keys under each prefix; at most
    len(prefixes) * 2**width rows reach the driver."""
    spark = rows.sparkSession
    u = F.col("id").bitwiseXOR(F.lit(LEAST))
    if done < HASH_BITS:
        prefix = F.shiftright("h", HASH_BITS - done)
        digit = F.shiftright("h", HASH_BITS - done - width).bitwiseAND((1 << width) - 1)
        kept = rows if done == 0 else rows.where(prefix.isin(prefixes))
        counted = kept.groupBy(prefix.alias("p"), digit.alias("d")).agg(F.sum("size").alias("n"), F.count("*").alias("c")).select(F.col("p"), F.lit(0).cast("long").alias("q"), "d", "n", "c")
    else:
        below = HASH_BITS + ID_BITS - done
        mask = (1 << (ID_BITS - below)) - 1
        open_ = spark.createDataFrame([(p >> (done - HASH_BITS), _signed(p & mask)) for p in prefixes], "h long, q long")
        q = F.shiftrightunsigned(u, below) if below < ID_BITS else F.lit(0).cast("long")
        digit = F.shiftrightunsigned(u, below - width).bitwiseAND((1 << width) - 1)
        kept = rows.withColumn("q", q).join(F.broadcast(open_), ["h", "q"], "left_semi")
        counted = kept.groupBy(F.col("h").alias("p"), "q", digit.alias("d")).agg(F.sum("size").alias("n"), F.count("*").alias("c"))
    found: dict[int, dict[int, tuple[int, int]]] = {}
    for p, q, d, n, c in counted.collect():
        key = p if done < HASH_BITS else (p << (done - HASH_BITS)) | (q % (1 << 64))
        found.setdefault(key, {})[d] = (n, c)
    return found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def find_splitters(rows: DataFrame, targets: list[tuple[int, float]]) -> list[int]:
    """For each target (bytes below, tolerance): the key (hash bits, then id bits) whose bytes below come within the
    tolerance, or as near as whole rows allow."""
    total_bits = HASH_BITS + ID_BITS
    state = {i: (0, 0) for i in range(len(targets))}  # target: (prefix, bytes below the prefix)
    found: dict[int, int] = {}
    done = 0
    for width in WIDTHS:
        if not state:
            break
        counts = _histogram(rows, done, width, sorted({p for p, _ in state.values()}))
        after, ahead = {}, done + width
        for i, (prefix, below) in state.items():
            target, tolerance = targets[i]
            for d, (n, c) in sorted(counts.get(prefix, {}).items()):
                if below + n > target:
                    break
                below += n
            else:
                found[i] = (prefix + 1) << (total_bits - done)
                continue
            here = (prefix << width) | d
            last = c == 1 or ahead == total_bits  # one row, or rows of one key: nothing left to split
            if target - below <= tolerance or (last and target - below <= below + n - target):
                found[i] = here << (total_bits - ahead)
            elif below + n - target <= tolerance or last:
                found[i] = (here + 1) << (total_bits - ahead)
            else:
                after[i] = (here, below)
        state, done = after, ahead
    return [found[i] for i in range(len(targets))]


def _bound(key: int) -> tuple[int, int]:
    """A splitter as (hash, id) in the rows' signed order."""
    return key >> ID_BITS, (key & ((1 << ID_BITS) - 1)) - (1 << 63)


def shard_documents(docs: DataFrame, shards: int = 40, cells: int = 16, tolerance: float = 0.001, cell_rows: int = 1_000_000) -> DataFrame:
    """Columns doc_id, size, text_crc32, law, shard, slot, grown_shard; shards of nearly equal bytes.

    tolerance: of a shard's bytes, for a shard's edge; a cell's inner edges may be off by a tenth of a cell.
    """
    rows = materialize(slim_rows(docs))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    cells = max(cells, min(MOST_CELLS, count // (shards * cell_rows)))
    parts = shards * cells
    targets = [(total * j // parts, tolerance * total / shards if j % cells == 0 else 0.1 * total / parts) for j in range(1, parts)]
    keys = sorted(find_splitters(rows, targets)) if total else []
    bounds = [_bound(k) for k in keys]
    edges, inner = bounds[cells - 1 :: cells], [bounds[i * cells : i * cells + cells - 1] for i in range(shards)] if bounds else []
    shard: Column = F.lit(0)
    for h, d in edges:
        shard = shard + ((F.col("h") > h) | ((F.col("h") == h) & (F.col("id") >= d))).cast("int")
    table_ = F.array(*[F.array(*[F.struct(F.lit(h).cast("long").alias("h"), F.lit(d).cast("long").alias("id")) for h, d in group]) for group in inner]) if inner else None
    key = F.struct("h", "id")
    cell = F.size(F.filter(F.element_at(table_, F.col("shard") + 1), lambda x: x <= key)) if inner else F.lit(0)
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("cell", cell.cast("int"))
    # at most shards * cells rows: the offset of each cell in its shard
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "cell").count().select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    numbered = placed.withColumn("at", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("h", "id")))
    return numbered.join(F.broadcast(offsets), ["shard", "cell"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.col("at") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_shard_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
