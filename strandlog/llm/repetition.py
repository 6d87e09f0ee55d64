"""Operator 4: quality rules, repetition measured on a suffix array.

The suffixes of every text's words are sorted by prefix doubling, all texts of a slice at once; only suffixes that
still tie with another are sorted again, so that the work falls fast where texts do not repeat. The ranks after 8
words give the windows of eight words that occur twice. The ranks of every doubling give the longest common prefix of
neighbours in the suffix array. A suffix whose common prefix with a neighbour is longest lies in an interval of the
array that is a maximal repeated substring; the union of the spans [suffix, suffix + prefix) of repeats of at least
``least`` words is what repetition covers. A text fails when that is over ``most_covered`` of its words, or its longest
repeat is over ``longest`` words and over a tenth of the text.

Defined results: null and empty texts have no words, fail the base rules (under 20 words) and are not kept. Repeated
rows are judged alike and kept as rows. Texts of any length are read whole; ranks need some 60 bytes a word. Columns
other than doc_id and text are ignored by the query and kept by ``judge_repetition``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandlog.llm.common import WHITE, Words, bounded_batches, slices, split_words, table

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _ranks(words: Words) -> np.ndarray:
    """First ranks: equal for equal words of one text, different otherwise (exact)."""
    text = words.data.tobytes()
    ids: dict[bytes, int] = {}
    word = np.fromiter((ids.setdefault(text[a:b], len(ids)) for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)), np.int64, len(words.start))
    return words.doc * np.int64(max(1, len(ids))) + word


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and rank of keys; a rank is the place of the first of its equals."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    return order, rank


def suffix_array(words: Words) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of all suffixes (texts apart), and their ranks by 1, 2, 4, ... words until none tie. A suffix shorter
    than that has a rank of its own."""
    n = len(words.start)
    order, rank = _dense(_ranks(words))
    levels, h = [rank], 1
    end = words.first[1:][words.doc]
    while True:
        rank = levels[-1]
        first = np.ones(n + 1, bool)
        first[1:-1] = rank[order][1:] != rank[order][:-1]
        tied = np.flatnonzero(~(first[:-1] & first[1:]))  # places in the order
        if not len(tied):
            return order, levels
        at = order[tied]
        beyond = at + h
        inside = beyond < end[at]
        follow = np.where(inside, rank[np.minimum(beyond, n - 1)] + 1, 0)
        sub = np.lexsort((follow, rank[at]))
        at, follow, own = at[sub], follow[sub], rank[at][sub]
        order = order.copy()
        order[tied] = at
        new = np.ones(len(at), bool)
        new[1:] = (own[1:] != own[:-1]) | (follow[1:] != follow[:-1]) | (follow[1:] == 0)
        rank = rank.copy()
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        levels.append(rank)
        h *= 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """Longest common prefix, in words, of each suffix in the order with the one before it (0 for the first)."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    at = np.flatnonzero(np.append(False, levels[0][order[1:]] == levels[0][order[:-1]]))
    a, b = order[at - 1], order[at]
    got = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + got, b + got
        ok = (x < end[a]) & (y < end[b])
        step = np.zeros(len(at), bool)
        step[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        got += step.astype(np.int64) << k
    lcp[at] = got
    return lcp


def _union(first: np.ndarray, reach: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """Words of each text covered by spans [i, reach[i]) over word indices i."""
    covered = np.maximum.accumulate(np.concatenate([[0], reach]))[1:] > np.arange(len(reach))
    return np.bincount(doc[covered], minlength=texts) if len(doc) else np.zeros(texts, np.int64)


def measure(texts: pa.Array, least: int = 6) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, longest_repeat."""
    words = split_words(texts)
    count = np.diff(words.first)
    total = len(texts)
    raw = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
    sizes = np.fromiter(map(len, raw), np.int64, total)
    data = np.frombuffer(b"".join(raw), np.uint8)
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[np.concatenate([[0], np.cumsum(sizes)])])
    chars = sums(~WHITE[data] & ((data & 0xC0) != 0x80))
    dup = np.zeros(total, np.int64)
    for i, x in enumerate(raw):
        lines = x.split(b"\n")
        if len(lines) > 1:
            lines = [y for y in lines if y.strip(b" \t\n\x0b\x0c\r")]
            dup[i] = len(lines) - len(set(lines))
    out = {"n_words": count, "word_chars": chars, "n_symbols": sums(SYMBOLS[data]), "n_dup_lines": dup}
    n = len(words.start)
    index = np.arange(n)
    repeat, cover, longest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(total, np.int64)
    if n:
        order, levels = suffix_array(words)
        end = words.first[1:][words.doc]
        if len(levels) > 3:
            _, many, times = np.unique(levels[3], return_inverse=True, return_counts=True)
            twice = (times[many] > 1) & (end - index >= 8)
            repeat[twice] = index[twice] + 8
        lcp = common_prefixes(order, levels, end)
        widest = np.zeros(n, np.int64)
        widest[order] = np.maximum(lcp, np.append(lcp[1:], 0))
        np.maximum.at(longest, words.doc, widest)
        wide = widest >= least
        cover[wide] = index[wide] + widest[wide]
    out["n_repeat_words"] = _union(words.first, repeat, words.doc, total)
    out["n_covered"] = _union(words.first, cover, words.doc, total)
    out["longest_repeat"] = longest
    return out


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest_repeat long, base_failed boolean, kept boolean"


def judge_repetition(docs: DataFrame, least: int = 6, most_covered: float = 0.3, longest: int = 100) -> DataFrame:
    """docs with FIELDS added (columns of these names are replaced)."""
    names = [x.split()[0] for x in FIELDS.split(", ")]
    slim = docs.drop(*names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            m = measure(batch.column("text"), least)
            n = m["n_words"]
            failed = (n < 20) | (100 * m["n_repeat_words"] > 30 * n)
            bad = (m["n_covered"] > most_covered * n) | ((m["longest_repeat"] > longest) & (10 * m["longest_repeat"] > n))
            m |= {"base_failed": failed, "kept": ~failed & ~bad}
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(m[x], pa.bool_() if x in ("base_failed", "kept") else pa.int64()) for x in names]], [*batch.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields)
    return bounded_batches(slim).mapInArrow(work, f"{schema}, {FIELDS}")


def op4_repetition_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as long) doc_id", "text")
    return judge_repetition(docs).drop("text")
