"""Operator 6: packing token sequences, online in bounded space.

A document's ids are those of its whole text and an end id. Texts are cut at single spaces between other characters,
where the tokenizer's pre-tokenisation always cuts, so that each distinct word of a Python worker is encoded once.
Whole sequences' worth of ids leave at once. What remains of a document is placed best-fit in one of a fixed number
of open windows of its partition; when none fits, the fullest window is emitted, topped up by cutting the piece if its
gap is worth a cut, and a window is opened for the rest. The windows still open at a partition's end are merged: their
pieces, with their ids, are dealt to groups of some ``merge_rows`` and joined end to end, cut where a sequence is full. So a
partition needs ``windows`` * ``length`` ids of memory beside its batch, and padding is left in emitted windows (less
than ``least_cut`` each) and in the last sequence of each merging group.

Added tokens of the file (such as its end-of-text string): texts that hold their strings go whole through the tokenizers
library with its usual settings, so that the string is the token's id; with ``added`` off it is read as ordinary text.

Defined results: null and empty texts are one end id. Rows that repeat a doc_id are documents of their own. Sequence
ids are unique, not gapless; they depend on how the input is split into partitions, as does the packing. Columns other
than doc_id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.common import bounded_batches, materialize, slices, table

_GAP = re.compile(r"(?<=\S) (?=\S)")
#: Texts in which some space is not single and between other characters.
_ODD = re.compile(r"\s | \s|^ | \Z")
#: The byte-level pre-tokenisation.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Sequence ids: 2**36 for each partition, and merged ones from 2**62 on.
PER_TASK = 1 << 36
MERGED = 1 << 62
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranked(path: str):
    """The file's byte-level BPE as a tiktoken encoding, which is faster for single words, or None if the file is
    something else. Equal ids: the merges' order is the order of the merged ids, and the file's pre-tokenisation is the
    byte-level one without a prefix space; tests hold the two against each other."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or split.get("use_regex") is False or spec.get("normalizer"):
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    letters, vocab = _byte_letters(), model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [vocab[a + b] for a, b in pairs]
    if order != sorted(order) or any(c not in letters for t in vocab if t not in special for c in t):
        return None
    import tiktoken

    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("words", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class WordEncoder:
    """Ids of whole texts as little-endian 32-bit bytes, by a tokenizers file; words are remembered. added: whether the
    strings of added tokens in a text are those tokens."""

    def __init__(self, path: str, keep: int = 300_000, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = path
        self.quick = _ranked(path)
        self.tokenizer = None if self.quick else self._library(ordinary=True)
        with open(path, encoding="utf-8") as f:
            names = [t["content"] for t in json.load(f).get("added_tokens") or []] if added else []
        self.added = re.compile("|".join(map(re.escape, names)), re.I) if names else None
        self.plain = None
        self.keep = keep
        self.cache: dict[str, bytes] = {}

    def _library(self, ordinary: bool):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        if ordinary:
            found.encode_special_tokens = True
        return found

    def _with_added(self, text: str) -> bytes:
        if self.plain is None:
            self.plain = self._library(ordinary=False)
        return array("I", self.plain.encode(text, add_special_tokens=False).ids).tobytes()

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.quick is not None:
            return [array("I", self.quick(x)).tobytes() for x in texts]
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.cache) > self.keep:
            self.cache.clear()
        cache = self.cache
        special = {}
        if self.added:
            special = {i: self._with_added(t) for i, t in enumerate(texts) if t and self.added.search(t)}
            texts = [None if i in special else t for i, t in enumerate(texts)] if special else texts
        cut = [(_GAP.split(t) if _ODD.search(t) else t.split(" ")) if t else [] for t in texts]
        new = list(set().union(*[words[1:] for words in cut]).difference(cache))
        cache.update(zip(new, self._encode([" " + w for w in new]), strict=True))
        heads = iter(self._encode([words[0] for words in cut if words]))
        get = cache.__getitem__
        return [special.get(i, b"".join([next(heads), *map(get, words[1:])]) if words else b"") for i, words in enumerate(cut)]


_encoders: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, added: bool) -> WordEncoder:
    if (path, added) not in _encoders:
        _encoders[path, added] = WordEncoder(path, added=added)
    return _encoders[path, added]


class Packer:
    """One partition's windows. Rows: (doc_id, start, length, crc, doc_tokens, sequence_id, offset, ids or None)."""

    def __init__(self, length: int, windows: int, least_cut: int, first_id: int):
        self.length, self.windows, self.least_cut, self.next_id = length, windows, least_cut, first_id
        self.open: list[list] = []  # [ids so far, pieces]
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple], keep_ids: bool = False) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next_id, at, ids if keep_ids else None))
            at += n
        self.next_id += 1

    def add(self, doc: int, ids: bytes) -> None:
        total, at, wide = len(ids) // 4, 0, 4 * self.length
        while len(ids) - at >= wide:
            self._emit([(doc, at // 4, ids[at : at + wide], total)])
            at += wide
        if at == len(ids):
            return
        n = (len(ids) - at) // 4
        fits = [w for w in self.open if w[0] + n <= self.length]
        if fits:
            best = max(fits, key=lambda w: w[0])
        elif len(self.open) < self.windows:
            self.open.append(best := [0, []])
        else:
            full = max(self.open, key=lambda w: w[0])
            self.open.remove(full)
            gap = self.length - full[0]
            if gap >= self.least_cut:
                full[1].append((doc, at // 4, ids[at : at + 4 * gap], total))
                at += 4 * gap
                n -= gap
            self._emit(full[1])
            self.open.append(best := [0, []])
        best[0] += n
        best[1].append((doc, at // 4, ids[at:], total))
        if best[0] == self.length:
            self.open.remove(best)
            self._emit(best[1])

    def finish(self) -> None:
        for _, pieces in self.open:
            self._emit(pieces, keep_ids=True)
        self.open = []

    def take(self) -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        columns = list(zip(*self.rows, strict=True)) or [[]] * 8
        self.rows = []
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:7]], pa.array(columns[7], pa.binary())], [*names, "ids"])


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, length: int = 2048, windows: int = 32, least_cut: int = 32, merge_rows: int = 500, added: bool = True) -> DataFrame:
    """Rows of PIECE: every id of every document lies in one piece, every piece in one place of one sequence."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(path, added), np.array([end_id], "<u4").tobytes()
        packer = Packer(length, windows, least_cut, TaskContext.get().partitionId() * PER_TASK)
        for batch in slices(batches, "text", 2 << 20):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), own.encode(batch.column("text").to_pylist()), strict=True):
                packer.add(doc, ids + end)
            yield packer.take()
        packer.finish()
        yield packer.take()

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["sequence_id", "offset"])
        out, fill, number = [], 0, MERGED + int(rows["g"].iloc[0]) * PER_TASK
        for doc, start, total, ids in zip(rows["doc_id"], rows["start"], rows["doc_tokens"], rows["ids"], strict=True):
            at = 0
            while at < len(ids):
                part = ids[at : at + 4 * (length - fill)]
                out.append((doc, start + at // 4, len(part) // 4, zlib.crc32(part), total, number, fill))
                at, fill = at + len(part), fill + len(part) // 4
                if fill == length:
                    fill, number = 0, number + 1
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    pieces = materialize(bounded_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text")).mapInArrow(work, PIECE + ", ids binary"))
    left = pieces.where("ids is not null")
    groups = 1 + left.count() // merge_rows
    merged = left.withColumn("g", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).cast("int")).groupBy("g").applyInPandas(merge, PIECE)
    return pieces.where("ids is null").drop("ids").unionByName(merged)


def op6_pack_bounded(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return pack_documents(table(spark, sf_dir, "documents"), path)
