"""Operator 7: SentencePiece BPE encoding by vectorised merge rounds, and decoding.

The model file's vocabulary is read through the sentencepiece library; the merging is done here. A text becomes
``▁`` + text with spaces as ``▁`` (identity normalisation, dummy prefix). No piece of the vocabulary holds ``▁``
after another character, so that a text can be cut before every ``▁`` that follows another character; each distinct
word of a batch is encoded once.

All words of a batch are one flat array of symbol ids. In a round the rank of every adjacent pair is looked up (pairs
that make no piece rank last), the minimum per word is found by a segmented reduction, the leftmost of its pairs in
each word merge at the same time, and the array is compacted; words without a pair leave the rounds. Equal ranks are
the same piece, merged from the left. One occurrence merges at a time where a merge could give a pair of better rank
than its own (such pieces are known from the vocabulary), else all that do not overlap.

Defined results: null and empty texts have no ids and decode to the empty string. Characters outside the vocabulary
become their UTF-8 bytes' pieces. Columns other than doc_id and text are ignored; repeated rows are kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandlog.llm.common import bounded_batches, slices, table

MARK = "▁"
#: Before a mark that follows another character, words begin.
_CUT = re.compile(f"(?<=[^{MARK}])(?={MARK})")
NO_RANK = np.int32(2**31 - 1)


class PieceCoder:
    """Encoder and decoder for one BPE model file."""

    def __init__(self, path: str, keep: int = 400_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = len(model)
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.kind = [2 if model.is_byte(i) else 3 if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else 0 for i in range(n)]
        score = np.array([model.get_score(i) for i in range(n)])
        self.unk = model.unk_id()
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if self.kind[i] == 2}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        usable = [i for i in range(n) if self.kind[i] == 0]
        assert not any(MARK in self.pieces[i].lstrip(MARK) for i in usable), "pieces with an inner mark need whole texts"
        self.id_of = {self.pieces[i]: i for i in usable}
        # symbols: vocabulary ids, and beyond them characters that are in no piece of their own
        self.char_symbol = {p: i for p, i in self.id_of.items() if len(p) == 1}
        self.extra: list[str] = []
        by_piece = sorted(usable, key=lambda i: (-score[i], i))
        rank = {i: r for r, i in enumerate(by_piece)}
        # equal scores rank alike
        for a, b in zip(by_piece, by_piece[1:], strict=False):
            if score[a] == score[b]:
                rank[b] = rank[a]
        self.alone = set()
        left, right, to = [], [], []
        inner = {c for p in self.id_of if len(p) > 1 for c in p} - set(self.char_symbol)
        for c in sorted(inner):
            self._symbol(c)
        known = self.id_of | {c: n + k for k, c in enumerate(self.extra)}
        for p, i in self.id_of.items():
            for k in range(1, len(p)):
                a, b = known.get(p[:k]), known.get(p[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    to.append(i)
                    for x in (a, b):
                        if x in rank and rank[x] >= rank[i]:
                            self.alone.add(x)  # merging into x can open a pair that outranks it
        self.width = np.int64(1 << 32)
        keys = np.array(left, np.int64) * self.width + np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.to = np.array(to, np.int64)[order]
        self.rank = np.array([rank[i] for i in to], np.int32)[order]
        self.is_alone = np.zeros(n, bool)
        self.is_alone[[x for x in self.alone if x < n]] = True
        self.n = n
        self.keep = keep
        self.odd = {i for i in range(n) if self.kind[i]}
        self.number = [str(i) for i in range(n)]
        self.text_of = [p.replace(MARK, " ") for p in self.pieces]
        #: word -> (ids, their decimal text, decoded text)
        self.cache: dict[str, tuple[tuple[int, ...], str, str]] = {}
        # direct table for pairs of common symbols would be large; hashed slots find most misses at once
        bits = 20
        self.slot_mask = np.int64((1 << bits) - 1)
        self.slots = np.zeros(1 << bits, bool)
        self.slots[self._slot(self.keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.int64(21)) ^ (keys >> np.int64(37))) * np.int64(0x9E3779B1) >> np.int64(7)) & self.slot_mask

    def _symbol(self, c: str) -> int:
        s = self.char_symbol.get(c)
        if s is None:
            s = self.char_symbol[c] = len(self.pieces) + len(self.extra)
            self.extra.append(c)
        return s

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair."""
        keys = left.astype(np.int64) * self.width + right
        rank = np.full(len(keys), NO_RANK, np.int32)
        to = np.zeros(len(keys), np.int64)
        maybe = np.flatnonzero(self.slots[self._slot(keys)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == keys[maybe]
            rank[maybe[hit]] = self.rank[at[hit]]
            to[maybe[hit]] = self.to[at[hit]]
        return rank, to

    def merge(self, words: list[str]) -> list[list[int]]:
        """Symbols of each word after all merges."""
        get = self.char_symbol.get
        out: list[list[int] | None] = [None] * len(words)
        sym = np.fromiter((get(c, -1) for w in words for c in w), np.int64)
        if (sym < 0).any():
            sym = np.fromiter((self._symbol(c) for w in words for c in w), np.int64, len(sym))
        size = np.fromiter(map(len, words), np.int64, len(words))
        word = np.arange(len(words))  # the word of each segment still in work
        seg = np.repeat(np.arange(len(words)), size)
        rank, to = self._pairs(sym[:-1], sym[1:]) if len(sym) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        while True:
            # rank[i], to[i]: the pair of symbol i and the next one of its segment
            rank = np.append(rank, NO_RANK)[: len(sym)]
            to = np.append(to, 0)[: len(sym)]
            if len(sym):
                rank[np.append(seg[1:] != seg[:-1], True)] = NO_RANK
            begin = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, begin) if len(sym) else rank
            over = least == NO_RANK
            if over.any():
                gone = over[seg]
                done = sym[gone].tolist()
                at = 0
                for w, k in zip(word[over].tolist(), size[over].tolist(), strict=True):
                    out[w] = done[at : at + k]
                    at += k
                left = ~gone
                sym, rank, to = sym[left], rank[left], to[left]
                word, size, least = word[~over], size[~over], least[~over]
                seg = np.repeat(np.arange(len(size)), size)
            if not len(sym):
                return out
            hit = np.flatnonzero(rank == least[seg])
            # of hits that overlap (neighbours), every second one from the left; one alone where a better pair may come
            first = np.ones(len(hit), bool)
            first[1:] = seg[hit[1:]] != seg[hit[:-1]]
            run = np.ones(len(hit), bool)
            run[1:] = (hit[1:] != hit[:-1] + 1) | first[1:]
            start = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            take = ((np.arange(len(hit)) - start) % 2 == 0) & (first | ~self.is_alone[to[hit]])
            at = hit[take]
            sym[at] = to[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            changed[np.maximum(at - 1, 0)] = True
            size = size - np.bincount(seg[at], minlength=len(size))
            sym, rank, to, seg, changed = sym[stay], rank[stay], to[stay], seg[stay], changed[stay]
            # the symbol before a merged one may have been swallowed by a merge just before it: it is that merge then
            prior = np.flatnonzero(changed)
            more = np.zeros(len(sym), bool)
            more[prior] = True
            more[np.maximum(prior - 1, 0)] = True
            redo = np.flatnonzero(more[:-1])
            rank[redo], to[redo] = self._pairs(sym[redo], sym[redo + 1])

    def _ids(self, symbols: list[int]) -> tuple[int, ...]:
        if max(symbols) < self.n:
            return tuple(symbols)
        ids: list[int] = []
        for s in symbols:
            if s < self.n:
                ids.append(s)
            else:
                ids += [self.byte_id.get(b, self.unk) for b in self.extra[s - self.n].encode()]
        return tuple(ids)

    def _word(self, symbols: list[int]) -> tuple[tuple[int, ...], str, str]:
        ids = self._ids(symbols)
        return ids, ",".join([self.number[i] for i in ids]), self._spell(ids)

    def encode_words(self, words: set[str]) -> dict[str, tuple[tuple[int, ...], str, str]]:
        """What is known of each word; a word is given without its leading mark."""
        cache = self.cache
        if len(cache) > self.keep:
            cache.clear()
        new = [w for w in words if w not in cache]
        for a in range(0, len(new), 50_000):
            part = new[a : a + 50_000]
            cache.update(zip(part, map(self._word, self.merge([MARK + w for w in part])), strict=True))
        return cache

    @staticmethod
    def cut(text: str) -> list[str]:
        """Words of a text, each without its leading mark."""
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in _CUT.split(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.cut(t or "") for t in texts]
        known = self.encode_words(set().union(*cut))
        return [[i for w in words for i in known[w][0]] for words in cut]

    def digest(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Of each text: number of ids, and the hashes of the ids in decimal and of the decoded text. A character lies
        in one word, so that words can be decoded by themselves."""
        cut = [self.cut(t or "") for t in texts]
        known = self.encode_words(set().union(*cut))
        out = []
        for words in cut:
            found = [known[w] for w in words]
            ids = ",".join([f[1] for f in found])
            decoded = "".join([f[2] for f in found]).removeprefix(" ")
            out.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        return out

    def _spell(self, ids: tuple[int, ...]) -> str:
        """The text of ids, with the first mark as a space."""
        if self.odd.isdisjoint(ids):
            return "".join([self.text_of[i] for i in ids])
        parts: list[bytes] = []
        for i in ids:
            b = self.id_byte.get(i)
            if b is not None:
                parts.append(bytes([b]))
            elif self.kind[i] == 3:
                parts.append(" ⁇ ".encode() if i == self.unk else b"")
            else:
                parts.append(self.text_of[i].encode())
        return b"".join(parts).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks become spaces, the first one is dropped, runs of byte pieces are read as UTF-8."""
        return self._spell(tuple(ids)).removeprefix(" ")


_coders: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    """One coder per Python process and model file."""
    if path not in _coders:
        _coders[path] = PieceCoder(path)
    return _coders[path]


def encode_documents(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """Rows (doc_id, ids, decoded), or with digests (doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in slices(batches, "text", 2 << 20):
            texts = batch.column("text").to_pylist()
            if digests:
                found = own.digest(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _, _ in found], pa.int64()), pa.array([x for _, x, _ in found], pa.string()), pa.array([x for _, _, x in found], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                ids = own.encode(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(own.decode, ids)), pa.string())], ["doc_id", "ids", "decoded"])

    slim = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return bounded_batches(slim).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return encode_documents(table(spark, sf_dir, "documents"), path, digests=True)
