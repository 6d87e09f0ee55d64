"""Shared pieces: tables, the shared scratch folder, vectorised word splitting and hashing, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import glob
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space 0x09-0x0D and 0x20, as bytes. Words are maximal runs of anything else.
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: The same words as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir, from the session). Where it is
    unset, a local master gets a temporary folder; on a cluster it must be set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and the executors of {master} share")
        root = f"{tempfile.gettempdir()}/strandlog-{spark.sparkContext.applicationId}"
    return f"{root.rstrip('/')}/strandlog-{uuid.uuid4().hex}"


_written: list[str] = []


def materialize(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors, is not computed twice.
    batch_rows: rows of an Arrow batch while this is computed, for steps whose rows are large."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path, before = scratch(spark), spark.conf.get(name)
    try:
        if batch_rows:
            spark.conf.set(name, str(batch_rows))
        _written.append(path)
        df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    finally:
        if batch_rows:
            spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete what the operators of this process have written to the shared folder. Their results cannot be read after
    that, so write or collect these first."""
    jvm = spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(df: DataFrame, limit: int = 4 << 20) -> DataFrame:
    """df, in a session whose Arrow batches hold at most ``limit`` bytes (one row at least) and not just a number of rows:
    texts are long, and a batch is held several times on its way to Python."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    known = re.fullmatch(r"(\d+)b?", conf.get(name))
    if not known or not 0 < int(known[1]) <= limit:
        conf.set(name, str(limit))
    return df


def give_back() -> None:
    """Return to the system what numpy, Arrow and the allocator hold without need: a Python worker outlives its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


@contextlib.contextmanager
def one_thread() -> Iterator[None]:
    """numpy's own OpenBLAS on one thread: for many small products its threads cost ten times what they bring.
    Without that library (another BLAS) nothing changes."""
    found = glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*"))
    blas = ctypes.CDLL(found[0]) if found else None
    get, put = (getattr(blas, f"scipy_openblas_{x}_num_threads64_", None) for x in ("get", "set"))
    before = get() if get and put else 0
    if before:
        put(1)
    try:
        yield
    finally:
        if before:
            put(before)


# ---------------------------------------------------------------- words as arrays

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        size = 1 << max(18, int(n - 1).bit_length())
        known = np.full(size, base, dtype=np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if size <= 1 << 20:
            _powers[int(base)] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of several texts. data: bytes, words joined by single spaces; start, end: byte range of each word in data;
    doc: index of the word's text; first: the index of each text's first word (one more entry than texts)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def hashes(self, block: int = 1 << 17) -> np.ndarray:
        """A 64-bit hash of each word's bytes, which does not depend on its place. Worked out for ``block`` bytes at a time
        (one word at least)."""
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            low = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, low + block, "right")))
            n = int(self.end[j - 1]) - low
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data[low : low + n].astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, n), out=total[1:])
            begin = self.start[i:j] - low
            out[i:j] = mix((total[self.end[i:j] - low] - total[begin]) * _power_table(_INVERSE, n)[begin])
            i = j
        return out


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of each text; null counts as empty. lower: A-Z become a-z, nothing else."""
    raw = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
    sizes = np.fromiter((len(x) for x in raw), np.int64, len(raw))
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    white = WHITE[data]
    before = np.empty_like(white)
    before[0] = True
    before[1:] = white[:-1]
    start = np.flatnonzero(~white & before)
    end = np.flatnonzero(white & ~before)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    first = np.searchsorted(start, begins, "left")
    kept = data[~(white & before)]
    if lower:
        kept = np.where((kept >= 65) & (kept <= 90), kept | 32, kept)
    else:
        kept = kept.copy()
    lengths = end - start
    to = np.cumsum(lengths + 1)
    kept[to - 1] = 32
    doc = np.repeat(np.arange(len(raw)), np.diff(first))
    return Words(kept, to - 1 - lengths, to - 1, doc, first)


def gram_hashes(words: np.ndarray, m: int) -> np.ndarray:
    """Hash of the m words from each word on (the last m - 1 entries run over the end and mean nothing)."""
    total = np.zeros(len(words), np.uint64)
    for t in range(m):
        factor = mix(np.array([t + 1], np.uint64) * np.uint64(0xD6E8FEB86659FD93))[0] | np.uint64(1)
        total[: max(0, len(words) - t)] += words[t:] * factor
    return mix(total)


def room(words: Words) -> np.ndarray:
    """For each word, how many words its text has from it on."""
    return words.first[1:][words.doc] - np.arange(len(words.doc))


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list (a, b: long): rows (id, component), component the smallest id.

    Large-star and small-star rounds (Kiveris and others, 2014): every round is a shuffle by one end, and the edge list
    is written to the shared folder after each. Of a vertex with very many neighbours only the smallest is needed (partial
    aggregates), which is joined back to its edges: adaptive execution splits that join where one vertex has too many for
    a task. Ids may be any longs. Empty edges give no rows.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(max_rounds):
        # large star: neighbours above a vertex go to the smallest of its neighbours and itself
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a vertex and its smaller neighbours go to the smallest of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        after = materialize(small)
        mark = [F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(7), "u"))]
        same, prior = after.agg(*mark).first(), now.agg(*mark).first()
        now = after
        if same == prior:
            break
    else:
        raise RuntimeError("components did not converge")
    ids = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
