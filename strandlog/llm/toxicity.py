"""Operator 3: toxicity through a noisy channel.

Obfuscated words are restored, then words are scored. A word that may be obfuscated (digits or signs for letters, signs
between letters, letters repeated three times or more, letters spaced out) becomes a lattice of characters: each sign
stands for the letters it resembles or for nothing, a run of a letter for one or two of it. The Viterbi path through the
lattice under a character trigram model is the restored word, at any length. Words of letters of which none is doubled are
their own single path; words of letters with doubled ones are scored as restored and as spelled, the higher score counts.
Tokens that can be fewer than two letters, and numbers (digits and the signs of numbers, no letter), are not restored.

Three or more single characters parted by blanks of any kind and number are one lattice in which each gap is nothing or
the end of a word. Its best paths at several prices of a word's end (0, less, more, and all joined) are its readings: the
model alone may take a frequent one-letter word out of a longer word. The reading with the highest word scores counts.

The character model is counted over all documents (trigrams by task, summed by Spark). Words are scored by
the log-odds of their document frequencies, of themselves and of their first 4 to 6 letters, in toxic and clean labelled
documents; a logistic model of a document's three highest word scores, fitted on leave-one-out scores with weights of 0 or more, gives its score.
A token's score cannot pass that of the features its unchanged first letters allow. Tokens are restored in the order of these
bounds, until no bound passes the third score: the three highest are those of restoring all.

Bounds: labels are learned from at most ``most_toxic`` + ``most_clean`` labelled rows (drawn by a hash of doc_id). What
these rows teach is sent whole, as are the trigrams, which grow with the distinct ones of the documents.

Defined results: null and empty texts score as texts without any listed word (low). Without labelled rows of both
kinds every score is 0. Texts are read whole; repeated rows are scored alike and kept. Rows without doc_id are scored,
never learned from, and are not held out. labels, lang, source and doc_id never enter a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.common import bounded_batches, materialize, slices, table

#: What a sign may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou"}
SPACED = re.compile(r"(?<!\S)[\"'(\[{«“‘¿¡]*\S(?:\s+\S){2,}[.,;:!?\"')\]}»”’…]*(?!\S)")
PRICES = (0.0, -4.0, -2.0, 2.0, 4.0, 8.0, math.inf)
EDGE = ".,;:!?\"'()[]{}<>…«»“”‘’-_"
PLAIN = re.compile(r"(?:([^\W\d_])(?!\1\1))*")
ALPHA = re.compile(r"[^\W\d_]+")
TWO = re.compile(r"[^\W\d_][\W\d_]*[^\W\d_]")
SINGLE = re.compile(r"(?:([^\W\d_])(?!\1))*")
NUMBER = re.compile(r"[\d.,:;/()+\-*%$€£°#=<>|~^ ]*")
LETTERS = re.compile(r"[^\W\d_]")
RUNS = re.compile(r"(.)\1*", re.S)
DOUBLED = re.compile(r"(.)\1+", re.S)
BLANK = re.compile(r"\s")
BLANK_KIND, LETTER_KIND, EDGE_KIND, OPEN_KIND, CLOSE_KIND = 1, 2, 4, 8, 16


@lru_cache(1)
def kinds() -> np.ndarray:
    """For each code point: whether it is a blank, a letter, of EDGE, or may stand before or after spaced characters."""
    every = np.arange(0x110000, dtype=np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    out = np.zeros(len(every), np.uint8)
    for pattern, bit in ((BLANK, BLANK_KIND), (LETTERS, LETTER_KIND), *((re.compile(f"[{re.escape(x)}]"), bit) for x, bit in ((EDGE, EDGE_KIND), ("\"'([{«“‘¿¡", OPEN_KIND), (".,;:!?\"')]}»”’…", CLOSE_KIND)))):
        for m in re.finditer(f"(?:{pattern.pattern})+", every):
            out[m.start() : m.end()] |= bit
    return out


def ranged(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How often mask holds in each range (0 for empty ones)."""
    total = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=total[1:])
    return np.where(end > start, total[end] - total[np.minimum(start, len(mask))], 0)


@dataclass
class Tokens:
    """Tokens of lower-case texts. text: the texts, each between two line ends; codes, kind: its code points and their kinds;
    start, end: each token; low, high: the same without EDGE (low = high: nothing is left); again: whether a code point
    repeats the one before it; letters: tokens of letters only; single: those of which none is doubled."""

    text: str
    codes: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    again: np.ndarray
    letters: np.ndarray
    single: np.ndarray

    @classmethod
    def of(cls, lows: list[str]) -> Tokens:
        text = "\n".join(["", *lows, ""])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = kinds()[codes]
        blank = (kind & BLANK_KIND) != 0
        flips = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        start, end = flips[::2], flips[1::2]
        inner = (kind & (BLANK_KIND | EDGE_KIND)) == 0
        solid = np.append(np.flatnonzero(inner), 0)
        before = np.zeros(len(codes) + 1, np.int32)
        np.cumsum(inner, out=before[1:])
        first, last = before[start], before[end]
        some = last > first
        low, high = np.where(some, solid[first], start), np.where(some, solid[last - 1] + 1, start)
        again = np.zeros(len(codes), bool)
        again[1:] = codes[1:] == codes[:-1]
        letters = some & (ranged((kind & LETTER_KIND) == 0, low, high) == 0)
        return cls(text, codes, kind, start, end, low, high, again, letters, letters & (ranged(again, low + 1, high) == 0))


def pieces(texts: list[str | None], limit: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """Lower-case texts, some at a time, with the index of the first. A text that is longer than ``limit`` comes alone, cut at
    blanks; all its pieces have its index."""
    held: list[str] = []
    size = at = 0
    for i, text in enumerate(texts):
        low = (text or "").lower()
        if held and size + len(low) > limit:
            yield at, held
            held, size, at = [], 0, i
        if len(low) <= limit:
            held.append(low)
            size += len(low)
            continue
        begin = 0
        while begin < len(low):
            cut = BLANK.search(low, begin + limit)
            end = cut.start() if cut else len(low)
            yield i, [low[begin:end]]
            begin = end
        at = i + 1
    if held:
        yield at, held


@lru_cache(100_000)
def reads(c: str, k: int, inner: bool, spaced: bool) -> list[tuple[str, float]]:
    """Readings of a run of k times a character (3: of 3 and more) and their log costs."""
    if LETTERS.match(c):
        out = [(c, 0.0)] if k == 1 else [(c * 2, 0.0), (c, -2.0)] if k == 2 else [(c, -1.0), (c * 2, -1.5)]
        if spaced and k > 1:
            out += [(f"{c} {c}", 0.0)] if k == 2 else [(f"{c} {c}", -1.5), (f"{c * 2} {c}", -1.5), (f"{c} {c * 2}", -1.5)]
        return out
    wild = c == "*"
    out = [(x, -2.5 if wild else -0.7) for x in LOOKS.get(c, "")]
    if k > 1:
        out += [(x * 2, s - 0.3) for x, s in out if not wild]
    return [*out, ("", -12.0 if c.isdigit() else -0.8 if not out or (wild and not inner) else -8.0 if inner else -4.0)]


def options(token: str, spaced: bool = False) -> list[list[tuple[str, float]]]:
    """The lattice of a token: for each run of one character, its readings and their log costs. spaced: the characters
    stood apart, so a word may end (read as a blank) between any two of them."""
    out, end = [], len(token)
    for m in RUNS.finditer(token):
        i, j = m.span()
        if spaced and i:
            out.append([("", 0.0), (" ", 0.0)])
        out.append(reads(token[i], min(j - i, 3), 0 < i and j < end, spaced))
    return out


def worded(token: str) -> bool:
    """Whether a token can be a word: two letters or more in its lattice, and no number."""
    return bool(TWO.search(token)) or not NUMBER.fullmatch(token) and sum(min(len(m.group()), 2) if LETTERS.match(m.group(1)) else m.group(1) in LOOKS for m in RUNS.finditer(token)) >= 2


class Restorer:
    """Restored words of tokens, by Viterbi paths under a character trigram model."""

    def __init__(self, grams: dict[str, int]):
        self.grams = grams
        pairs: Counter = Counter()
        for g, n in grams.items():
            pairs[g[:2]] += n
        self.pairs = dict(pairs)
        self.letters = max(2, len({g[2] for g in grams}))
        self.cache: dict[str, str] = {}
        self.costs: dict[str, float] = {}

    def cost(self, at: str, c: str) -> float:
        gram = at + c
        found = self.costs.get(gram)
        if found is None:
            if len(self.costs) > 200_000:
                self.costs.clear()
            found = self.costs[gram] = math.log((self.grams.get(gram, 0) + 0.1) / (self.pairs.get(at, 0) + 0.1 * self.letters))
        return found

    def decode(self, lattice: list[list[tuple[str, float]]], price: float = 0.0) -> str:
        """The best path. price: what the end of a word within the lattice costs besides the model's part. A state is the last
        two letters: "^^" before any word, "^^ " after one."""
        paths: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}  # the text as (text before, reading): time grows with the length only
        for reads in lattice:
            ahead: dict[str, tuple[float, tuple | None]] = {}
            for state, (score, text) in paths.items():
                for read, s in reads:
                    at, total = state, score + s
                    for c in read:
                        if c == " ":
                            if at[:2] != "^^":
                                total += self.cost(at, "$") - price
                                at = "^^ "
                            continue
                        total += self.cost(at[:2], c)
                        at = at[1] + c
                    if at not in ahead or total > ahead[at][0]:
                        ahead[at] = (total, (text, read) if read else text)
            paths = ahead
        text = max((score + (self.cost(at, "$") if at != "^^ " else 0.0), at, text) for at, (score, text) in paths.items())[2]
        parts = []
        while text:
            text, read = text
            parts.append(read)
        return "".join(reversed(parts))

    def word(self, token: str) -> str:
        """The restored word of a lower-case token."""
        known = self.cache.get(token)
        if known is not None:
            return known
        core = token.strip(EDGE)
        if SINGLE.fullmatch(core):
            return core
        if worded(core):
            core = self.decode(options(core))
        if len(self.cache) > 100_000:
            self.cache.clear()
        self.cache[token] = core
        return core

    def readings(self, token: str) -> tuple[tuple[str, ...], ...]:
        """The restored word of a lower-case token and, if it is letters only, its own spelling ("off" need not be "of")."""
        word, core = self.word(token), token.strip(EDGE)
        return ((word,), (core,)) if word != core and PLAIN.fullmatch(core) else ((word,),)

    def apart(self, run: str) -> tuple[tuple[str, ...], ...]:
        """The readings of single characters parted by blanks, each the words of a path."""
        core = "".join(run.split()).strip(EDGE)
        if not worded(core):
            return ((core,),)
        lattice = options(core, True)
        return tuple(dict.fromkeys(tuple(self.decode(lattice, price).split()) for price in PRICES))

    def found(self, text: str | None) -> set[tuple[tuple[str, ...], ...]]:
        """The readings of each distinct token of a text, and of its runs of single characters."""
        if not text:
            return set()
        low = text.lower()
        return set(map(self.readings, set(low.split()))) | {self.apart(m.group()) for m in SPACED.finditer(low)}

    def words(self, text: str | None) -> set[str]:
        """Distinct words of a text, by all their readings."""
        return {w for readings in self.found(text) for path in readings for w in path} - {""}

    def text(self, text: str | None) -> str:
        """A text with its words restored, for reading."""
        low = SPACED.sub(lambda m: " ".join(self.apart(m.group())[0]), (text or "").lower())
        return " ".join(filter(None, map(self.word, low.split())))


def features(word: str) -> list[str]:
    """A word itself (marked by its end) and its first letters."""
    return [word + "$", *[word[:k] for k in (4, 5, 6) if len(word) >= k]]


def trigrams(tokens: Tokens, dense: int = 1 << 22) -> dict[str, int]:
    """Trigrams of plain words, each as ^^word$. Up to ``dense`` possible ones are counted in a table, more by sorting."""
    thrice = tokens.again.copy()
    thrice[1:] &= tokens.again[:-1]
    plain = tokens.letters & (ranged(thrice, tokens.low + 2, tokens.high) == 0)
    low, high = tokens.low[plain], tokens.high[plain]
    if not len(low):
        return {}
    sizes = high - low
    ends = np.cumsum(sizes + 3)
    begins = ends - sizes - 3
    padded = np.empty(ends[-1], np.uint32)
    word = np.ones(len(padded), bool)
    for at, mark in ((begins, "^"), (begins + 1, "^"), (ends - 1, "$")):
        padded[at] = ord(mark)
        word[at] = False
    change = np.zeros(len(tokens.codes) + 1, np.int8)
    change[low] = 1
    change[high] -= 1
    padded[word] = tokens.codes[np.cumsum(change[:-1], dtype=np.int8).view(bool)]
    signs = np.flatnonzero(np.bincount(padded))
    index = np.zeros(signs[-1] + 1, np.int64)
    index[signs] = np.arange(len(signs))
    x, n = index[padded], len(signs)
    whole = np.ones(len(padded), bool)
    whole[ends - 1] = whole[ends - 2] = False
    keys = ((x[:-2] * n + x[1:-1]) * n + x[2:])[whole[:-2]]
    if n**3 <= dense:
        counts = np.bincount(keys)
        keys = np.flatnonzero(counts)
        counts = counts[keys]
    else:
        keys, counts = np.unique(keys, return_counts=True)
    names = [chr(c) for c in signs.tolist()]
    parts = zip((keys // (n * n)).tolist(), (keys // n % n).tolist(), (keys % n).tolist(), counts.tolist(), strict=True)
    return {names[i] + names[j] + names[k]: c for i, j, k, c in parts}


def character_model(docs: DataFrame) -> dict[str, int]:
    """Trigram counts of the plain words of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: Counter = Counter()
        for batch in slices(batches, "text"):
            for _, lows in pieces(batch.column("text").to_pylist()):
                grams.update(trigrams(Tokens.of(lows)))
        yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["gram", "n"])

    counted = bounded_batches(docs.select("text")).mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    whole = counted.toArrow()
    return dict(zip(whole.column("gram").to_pylist(), whole.column("n").to_pylist(), strict=True))


def odds(a: float, b: float, toxic: int, clean: int, prior: float = 3.0) -> float:
    """Log ratio of document frequencies, with ``prior`` documents of the usual mixture added: what only a few toxic
    documents hold stays low."""
    share = toxic / (toxic + clean)
    return math.log((a + prior * share) / toxic) - math.log((b + prior * (1 - share)) / clean)


def hinges(top: list[float]) -> list[float]:
    """What the logistic model reads: by how much the three highest word scores pass some steps (a text's usual words
    reach 2 by chance)."""
    first, second, third = top
    return [*[max(0.0, first - step) for step in (0, 1, 2, 3, 4, 5)], *[max(0.0, second - step) for step in (2, 3, 4)], max(0.0, third - 2)]


def spaced_at(tokens: Tokens, doc: np.ndarray) -> np.ndarray:
    """Tokens that may be the second of a run of single characters (SPACED finds none without such a token)."""
    size = tokens.end - tokens.start
    one = size == 1
    opens = one | ((tokens.kind[tokens.start] & OPEN_KIND) != 0)
    closes = one | ((tokens.kind[tokens.end - 1] & CLOSE_KIND) != 0)
    return np.flatnonzero(one[1:-1] & opens[:-2] & closes[2:] & (doc[:-2] == doc[2:])) + 1


class Bounds:
    """Bounds of tokens' values. The first letters of a token, up to a sign or a doubled letter, begin all its readings: the
    values of these letters' own features, and of all features that begin with them, bound its value. Of a token of single
    letters only its own features count. Features share the slots of tables by hashes, a slot holds the highest: bounds are
    never too low."""

    SLOTS = 20
    FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)

    def __init__(self, value: dict[str, float]):
        self.starts, self.begins, self.wholes = (np.zeros(1 << self.SLOTS) for _ in range(3))
        self.nothing = max(0.0, value.get("$", 0.0))
        some = {f: v for f, v in value.items() if v > 0}
        for whole, kept in ((True, {f[:-1]: v for f, v in some.items() if f[-1:] == "$"}), (False, {f: v for f, v in some.items() if 4 <= len(f) <= 6})):
            if not kept:
                continue
            worth = np.array(list(kept.values()))
            sizes = np.array([len(f) for f in kept])
            ends = np.cumsum(sizes)
            codes = np.frombuffer(("".join(kept) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
            prefixes = list(self._prefixes(codes, ends - sizes, np.minimum(sizes, 6)))
            for k, h in enumerate(prefixes):
                np.maximum.at(self.begins, self._slot(h, k)[sizes >= k], worth[sizes >= k])
                if not whole and k >= 4:
                    np.maximum.at(self.starts, self._slot(h, k)[sizes == k], worth[sizes == k])
            if whole:
                np.maximum.at(self.wholes, self._slot(self._whole(prefixes[6], codes, ends - sizes, ends), 7), worth)

    def _slot(self, h: np.ndarray, k: int | np.ndarray) -> np.ndarray:
        h = h + np.asarray(k, np.uint64) * self.FACTORS[6]
        return ((h ^ (h >> np.uint64(29))) * self.FACTORS[0] >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def _prefixes(self, codes: np.ndarray, low: np.ndarray, fixed: np.ndarray) -> Iterator[np.ndarray]:
        """Hashes of the first 0 to 6 code points, ``fixed`` at most."""
        h = np.zeros(len(low), np.uint64)
        yield h
        for j in range(6):
            h = h + np.where(fixed > j, codes[np.minimum(low + j, len(codes) - 1)], np.uint32(0)) * self.FACTORS[j]
            yield h

    def _whole(self, first: np.ndarray, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Hash of the first six code points, the size and the last three."""
        size = high - low
        h = first + size.astype(np.uint64) * self.FACTORS[6]
        for j in range(1, 4):
            h = h + np.where(size >= j, codes[np.maximum(high - j, 0)], np.uint32(0)) * self.FACTORS[6 + j]
        return h

    def of(self, tokens: Tokens) -> np.ndarray:
        low, high, codes = tokens.low, tokens.high, tokens.codes
        fixed = np.minimum(high - low, 6)
        odd = np.flatnonzero(~tokens.single)
        count, going = np.zeros(len(odd), np.int64), np.ones(len(odd), bool)
        for j in range(6):
            at = np.minimum(low[odd] + j, len(codes) - 1)
            going &= (low[odd] + j < high[odd]) & ((tokens.kind[at] & LETTER_KIND) != 0)
            if j:
                going &= ~tokens.again[at]
            count += going
        fixed[odd] = count
        bound = np.zeros(len(low))
        for k, h in enumerate(self._prefixes(codes, low, fixed)):
            if k >= 4:
                np.maximum(bound, np.where(fixed >= k, self.starts[self._slot(h, k)], 0.0), out=bound)
        whole = np.flatnonzero(tokens.single)
        bound[whole] = np.maximum(bound[whole], self.wholes[self._slot(self._whole(h[whole], codes, low[whole], high[whole]), 7)])
        bound[odd] = np.maximum(bound[odd], self.begins[self._slot(h[odd], count)])
        bound[low == high] = self.nothing
        return bound


class Scorer:
    """Scores of texts. table: feature -> (toxic documents, clean documents) that hold it."""

    def __init__(self, grams: dict[str, int], seen: dict[str, tuple[int, int]], toxic: int, clean: int, weights: list[float] | None = None):
        self.restorer = Restorer(grams)
        self.seen, self.toxic, self.clean, self.weights = seen, toxic, clean, weights
        self.value = {f: odds(a, b, toxic, clean) for f, (a, b) in seen.items() if a >= 2}
        self.best: dict[str, float] = {}
        self.shapes = {DOUBLED.sub(r"\1", f) for f, v in self.value.items() if v > 0}

    def _top(self, values: list[float]) -> list[float]:
        three = sorted((v for v in values if v > 0), reverse=True)[:3] + [0.0] * 3
        return [min(v, 8.0) for v in three[:3]]

    def _value(self, word: str) -> float:
        """The highest value of a word's features."""
        get, size = self.value.get, len(word)
        v = get(word + "$", 0.0)
        if size >= 4:
            v = max(v, get(word[:4], 0.0))
            if size >= 5:
                v = max(v, get(word[:5], 0.0))
                if size >= 6:
                    v = max(v, get(word[:6], 0.0))
        return max(v, 0.0)

    def _best(self, readings: tuple[tuple[str, ...], ...]) -> list[float]:
        """Values of the words of the reading that scores highest."""
        return max(sorted(map(self._value, path), reverse=True) for path in readings)

    def _token(self, token: str) -> float:
        """Value of a token. Readings of letters differ in repeated letters only: without these, a feature is the start (or,
        as a whole word, all) of the token, which spares decoding tokens without any."""
        core = token.strip(EDGE)
        if SINGLE.fullmatch(core):
            return self._value(core)
        if ALPHA.fullmatch(core):
            shape, shapes = DOUBLED.sub(r"\1", core), self.shapes
            if shape + "$" not in shapes and not any([shape[:k] in shapes for k in range(1, 7)]):
                return 0.0
        return self._best(self.restorer.readings(token))[0]

    @cached_property
    def bounds(self) -> Bounds:
        return Bounds(self.value)

    def top(self, text: str | None) -> list[float]:
        return self.tops([text])[0]

    def tops(self, texts: list[str | None]) -> list[list[float]]:
        """The three highest word scores of each text."""
        best = self.best
        found: list[list[dict[str, float]]] = [[] for _ in texts]
        runs = set()
        for base, lows in pieces(texts):
            tokens = Tokens.of(lows)
            bound = self.bounds.of(tokens)
            last = np.cumsum([len(x) + 1 for x in lows])  # the line end behind each text
            doc = np.searchsorted(last, tokens.start)
            if len(lows) == 1:
                runs.add(base)  # it may be a piece
            else:
                runs.update((base + np.unique(doc[spaced_at(tokens, doc)])).tolist())
            some = np.flatnonzero(bound > 0)
            order = some[np.lexsort((-bound[some], doc[some]))]
            ends = np.searchsorted(doc[order], np.arange(len(lows)), "right").tolist()
            limits, starts, stops, text = bound[order].tolist(), tokens.start[order].tolist(), tokens.end[order].tolist(), tokens.text
            begin = 0
            for i, end in enumerate(ends):
                values: dict[str, float] = {}
                least, three = 0.0, []
                for k in range(begin, end):
                    if limits[k] <= least:
                        break
                    token = text[starts[k] : stops[k]]
                    if token in values:
                        continue
                    v = best.get(token)
                    if v is None:
                        if len(best) > 200_000:
                            best.clear()
                        v = best[token] = self._token(token)
                    values[token] = v
                    if v > least:
                        three = sorted([*three, v], reverse=True)[:3]
                        least = three[2] if len(three) == 3 else 0.0
                begin = end
                found[base + i].append({t: v for t, v in values.items() if v > 0})
        out = []
        for i, parts in enumerate(found):
            distinct: dict[str, float] = {}
            for part in parts:  # a token of several pieces of a text counts once
                distinct.update(part)
            values = list(distinct.values())
            if i in runs:
                for m in SPACED.finditer((texts[i] or "").lower()):
                    values += self._best(self.restorer.apart(m.group()))
            out.append(self._top(values))
        return out

    def top_without(self, text: str | None, label: int) -> list[float]:
        """The same for a learned text, without its own part in the counts."""
        found = []

        def one(word: str) -> float:
            scores = [0.0]
            for f in features(word):
                a, b = self.seen.get(f, (0, 0))
                a, b = (a - 1, b) if label else (a, b - 1)
                if a >= 2:
                    scores.append(odds(a, max(b, 0), max(1, self.toxic - label), max(1, self.clean - 1 + label)))
            return max(scores)

        for readings in self.restorer.found(text):
            found += max(sorted(map(one, path), reverse=True) for path in readings)
        return self._top(found)

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.weights is None:
            return [0.0] * len(texts)
        z = [self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], hinges(top), strict=True)) for top in self.tops(texts)]
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in z]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 4000) -> np.ndarray:
    """Weights, the intercept first; all others are kept from falling under 0, so that no evidence lowers a score.
    Accelerated projected gradients."""
    x = np.column_stack([np.ones(len(x)), x])
    rate = 1 / (0.25 * np.linalg.eigvalsh(x.T @ x / len(x))[-1] + ridge)
    w = ahead = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - rate * (x.T @ (p - y) / len(x) + ridge * ahead)
        new[1:] = np.maximum(new[1:], 0)
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (last - 1) / t * (new - w), new
    return w


def learnable() -> Column:
    """Rows whose labels may be learned: crc32 of the id's text modulo 3 is not 1."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = 6000, most_clean: int = 10_000) -> Scorer:
    """docs: all documents (doc_id, text); labels: doc_id, toxic."""
    spark = docs.sparkSession
    grams = character_model(docs)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(learnable())
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    picked = None
    for value, most in ((1, most_toxic), (0, most_clean)):
        part = usable.where(F.col("toxic") == value).orderBy(draw, "doc_id").limit(most)  # a top-k, no full sort
        picked = part if picked is None else picked.unionByName(part)
    picked = picked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # most_toxic + most_clean rows at most
    train = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").select("text", "toxic"))
    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Scorer(grams, {}, 1, 1)
    shared = spark.sparkContext.broadcast(grams)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, a, b = Restorer(shared.value), Counter(), Counter()
        for batch in slices(batches, "text"):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                (a if label else b).update({f for w in restorer.words(text) for f in features(w)})
        names = list(a | b)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([a[f] for f in names], pa.int64()), pa.array([b[f] for f in names], pa.int64())], ["f", "a", "b"])

    ratio = (F.col("a") + 0.5) * (clean + 1) / ((F.col("b") + 0.5) * (toxic + 1))
    counted = train.mapInArrow(count, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where((F.col("a") >= 2) & (ratio > 1.5))
    seen = {r["f"]: (r["a"], r["b"]) for r in counted.collect()}
    known = spark.sparkContext.broadcast(seen)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, known.value, toxic, clean)
        for batch in slices(batches, "text"):
            y = batch.column("toxic").to_pylist()
            x = [scorer.top_without(t, k) for t, k in zip(batch.column("text").to_pylist(), y, strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in x], pa.float64()) for i in range(3)], pa.array(y, pa.int32())], ["x0", "x1", "x2", "y"])

    rows = np.array([tuple(r) for r in train.mapInArrow(learn, "x0 double, x1 double, x2 double, y int").collect()], float)
    return Scorer(grams, seen, toxic, clean, logistic(np.array([hinges(r) for r in rows[:, :3].tolist()]), rows[:, 3]).tolist())


def apply(docs: DataFrame, scorer: Scorer, threshold: float = 0.7) -> DataFrame:
    """docs with score and predicted (columns of these names are replaced)."""
    slim = docs.drop("score", "predicted")
    strong = {f: ab for f, ab in scorer.seen.items() if scorer.value.get(f, 0) > 0}
    model = docs.sparkSession.sparkContext.broadcast((scorer.restorer.grams, strong, scorer.toxic, scorer.clean, scorer.weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(*model.value)
        for batch in slices(batches, "text"):
            scores = own.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], [*batch.schema.names, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields)
    return bounded_batches(slim).mapInArrow(work, f"{schema}, score double, predicted int")


def op3_toxicity_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scorer = fit(docs, table(spark, sf_dir, "labels"))
    return apply(docs, scorer).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted")
