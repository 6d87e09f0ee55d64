"""Recovering provenance after the fact: exact hashes, then Jaccard similarity, and its evaluation."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.functions.similarity import character_jaccard, characters


#: Cells of the matrix of source sets that is sent to executors (4 bytes each).
MOST_CELLS = 1 << 24


#: A source text with what is known of where it comes from.
SOURCE_RECORD = "text string, title string, authors array<string>, year string, license string, section_hash string"


def source_records(sections: DataFrame, texts: DataFrame, *keep: str) -> DataFrame:
    """sections: the ledger's; texts: (path, text, and what to keep). Rows of SOURCE_RECORD with text_hash, one for each
    section of a text's path; the title is what follows ``raw/``. Texts without a section stay, without provenance."""
    known = sections.select("path", "authors", "year", "license", "section_hash")
    joined = texts.select("path", "text", *keep).join(known, "path", "left")
    title = F.regexp_replace("path", "^raw/", "")
    return joined.select("text", title.alias("title"), "authors", "year", "license", "section_hash", F.sha2("text", 256).alias("text_hash"), *keep)


def precision_recall(sweep: DataFrame) -> DataFrame:
    """Points (recall, precision, threshold) of the curve, from a threshold_sweep: by recall, then falling precision."""
    return sweep.select("recall", "precision", "threshold").orderBy("recall", F.col("precision").desc(), "threshold")


def source_index(sources: DataFrame) -> DataFrame:
    """sources: (seq, text, ...). One row for each text hash, the last one."""
    hashed = sources.withColumn("text_hash", F.sha2("text", 256))
    return hashed.groupBy("text_hash").agg(F.max_by(F.struct(*sources.columns), "seq").alias("s")).select("text_hash", "s.*")


def match_records(records: DataFrame, sources: DataFrame, least: float = 0.1, similarity: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """records: (rec_id, text); sources: (seq, text). Rows (rec_id, source_seq, confidence, exact): the source of equal
    text with confidence 1, else the most similar one over ``least`` (the first of equals), else null and 0.

    Exact matches leave before anything is compared. Under the default similarity (character sets) the rest are
    compared as distinct character sets, which texts share widely. The sources' distinct sets go to the executors as one
    matrix of sets by characters as long as it has at most ``MOST_CELLS`` cells, and a batch of sets is compared by one
    product with it; beyond that sets are joined, but for those whose sizes alone keep the ratio at or under ``least``."""
    index = source_index(sources.select("seq", "text"))
    hashed = records.select("rec_id", "text").withColumn("text_hash", F.sha2("text", 256))
    exact = hashed.join(index.select("text_hash", F.col("seq").alias("source_seq")), "text_hash").select("rec_id", "source_seq", F.lit(1.0).alias("confidence"), F.lit(True).alias("exact"))
    rest = hashed.join(index.select("text_hash"), "text_hash", "left_anti")
    if similarity is None:
        letters = lambda df, *keep: df.select(*keep, F.array_sort(characters(F.coalesce("text", F.lit("")))).alias("c"))
        own = letters(rest, "rec_id")
        known = letters(sources, "seq").groupBy("c").agg(F.min("seq").alias("seq"))
        kinds = own.select("c").distinct()
        if (matrix := _matrix(known)) is not None:
            best = kinds.mapInArrow(_closest(*matrix, least), "a array<string>, sim double, at long").select("a", F.struct("sim", "at").alias("m"))
            found = own.join(best.withColumnRenamed("a", "c"), "c", "left")
            return exact.unionByName(_scored(found))
        a, b = kinds.select(F.col("c").alias("a")), known.select(F.col("c").alias("b"), "seq")
        possible = F.least(F.size("a"), F.size("b")) > least * F.greatest(F.size("a"), F.size("b"))
        both = F.size(F.array_intersect("a", "b"))
        sim = F.when(F.size("a") + F.size("b") == 0, 1.0).otherwise(both / (F.size("a") + F.size("b") - both))
        pairs = a.join(b, possible | ((F.size("a") == 0) & (F.size("b") == 0))).withColumn("sim", sim).where(F.col("sim") > least)
        best = pairs.groupBy("a").agg(F.max(F.struct("sim", (-F.col("seq")).alias("at"))).alias("m"))
        found = own.join(best.withColumnRenamed("a", "c"), "c", "left")
    else:
        pairs = rest.join(sources.select("seq", F.col("text").alias("source_text"))).withColumn("sim", similarity(F.col("text"), F.col("source_text"))).where(F.col("sim") > least)
        best = pairs.groupBy("rec_id").agg(F.max(F.struct("sim", (-F.col("seq")).alias("at"))).alias("m"))
        found = rest.select("rec_id").join(best, "rec_id", "left")
    return exact.unionByName(_scored(found))


def _scored(found: DataFrame) -> DataFrame:
    return found.select("rec_id", (-F.col("m.at")).alias("source_seq"), F.coalesce("m.sim", F.lit(0.0)).alias("confidence"), F.lit(False).alias("exact"))


def _matrix(known: DataFrame) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
    """known: (c, seq), distinct sets. Their seqs, ascending, a 0/1 matrix of sets by characters, and the characters; None if
    it had over MOST_CELLS cells."""
    sets = known.count()
    letters = known.select(F.explode("c").alias("x")).distinct().count()
    if sets * max(1, letters) > MOST_CELLS:
        return None
    rows = known.toArrow().sort_by("seq")
    lists = rows.column("c").combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.string()))
    alphabet = lists.flatten().unique()
    out = np.zeros((sets, max(1, len(alphabet))), np.float32)
    out[np.repeat(np.arange(sets), np.diff(lists.offsets.to_numpy())), pc.index_in(lists.flatten(), value_set=alphabet).to_numpy(zero_copy_only=False)] = 1
    return rows.column("seq").to_numpy(), out, alphabet


def _closest(seqs: np.ndarray, known: np.ndarray, alphabet: pa.Array, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For sets c: the highest ratio over ``least`` and the negated seq of its first source, or nulls."""
    sizes = known.sum(1, dtype=np.float64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                lists = whole.column("c").slice(at, 1024)
                size = np.diff(lists.offsets.to_numpy())
                place = pc.index_in(lists.flatten(), value_set=alphabet).fill_null(-1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(lists)), size)[place >= 0]
                own = np.zeros((len(lists), known.shape[1]), np.float32)
                own[row, place[place >= 0]] = 1
                both = (own @ known.T).astype(np.float64)
                either = size[:, None] + sizes[None, :] - both
                sim = np.where(either == 0, 1.0, both / np.maximum(either, 1))
                best = sim.argmax(1) if len(seqs) else np.zeros(len(lists), int)
                top = sim[np.arange(len(lists)), best] if len(seqs) else np.zeros(len(lists))
                none = top <= least
                yield pa.RecordBatch.from_arrays([lists, pa.array(top, mask=none), pa.array(-seqs[best] if len(seqs) else np.zeros(len(lists), np.int64), pa.int64(), mask=none)], ["a", "sim", "at"])

    return work


def threshold_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """scored: (confidence, correct, has_truth). Rows (threshold, tp, fp, fn, precision, recall, f1)."""
    cuts = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    said = F.col("confidence") >= F.col("threshold")
    right = F.coalesce("correct", F.lit(False))
    counted = (
        scored.select("confidence", "correct", "has_truth", cuts)
        .groupBy("threshold")
        .agg(F.count_if(said & right).alias("tp"), F.count_if(said & ~right).alias("fp"), F.count_if(~said & F.col("has_truth")).alias("fn"))
    )
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counted.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of the highest f1, the lowest threshold of equals."""
    return sweep.orderBy(F.col("f1").desc(), "threshold").limit(1)


_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"


def _substituted(text: str, times: int, draw: random.Random) -> str:
    chars = list(text)
    for _ in range(times if chars else 0):
        chars[draw.randrange(len(chars))] = draw.choice(_ALPHABET)
    return "".join(chars)


def _lines_added(text: str, draw: random.Random) -> str:
    lines = text.splitlines()
    for _ in range(draw.randint(1, 3)):
        lines.insert(draw.randint(0, len(lines)), f"<!-- inserted {draw.randint(1000, 9999)} -->")
    return "\n".join(lines)


def _lines_dropped(text: str, draw: random.Random) -> str:
    lines = text.splitlines()
    gone = min(draw.randint(1, 3), max(0, len(lines) - 1))
    places = set(draw.sample(range(len(lines)), gone))
    return "\n".join(line for i, line in enumerate(lines) if i not in places)


#: Simulated edits and how many of ten texts get each.
EDITS: dict[Callable[[str, random.Random], str], int] = {
    lambda text, draw: text: 6,
    lambda text, draw: _substituted(text, draw.randint(1, 3), draw): 1,
    _lines_added: 1,
    _lines_dropped: 1,
    lambda text, draw: _substituted(text, max(1, int(0.15 * len(text))), draw): 1,
}


def edited_text(text: str, draw: random.Random) -> str:
    """One simulated edit: none, a few characters, lines added, lines dropped, or 15 % of the characters."""
    return draw.choices(list(EDITS), list(EDITS.values()))[0](text, draw)


def simulate_edits(records: DataFrame, seed: int = 42) -> DataFrame:
    """records (rec_id, text, ...) with edited texts. Each row draws from its own seed (seed and rec_id), so that the
    result does not depend on order or partitions."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(text=[None if t is None else edited_text(t, random.Random(f"{seed}:{i}")) for i, t in zip(frame["rec_id"], frame["text"], strict=True)])

    return records.mapInPandas(work, records.schema)


def write_matches(matches: DataFrame, path: str) -> None:
    """Matches as JSON, most confident first."""
    matches.orderBy(F.col("confidence").desc(), "rec_id").write.mode("overwrite").json(path)


__all__ = ["best_threshold", "character_jaccard", "edited_text", "match_records", "simulate_edits", "source_index", "threshold_sweep", "write_matches"]
