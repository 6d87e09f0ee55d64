"""Operator 10: language identification by a bidirectional gated recurrent network over bytes.

The network is written and trained here in numpy, by backpropagation through time: a byte's embedding feeds a gated
recurrent unit in either direction, both states label the byte's position, and a document's probabilities are the mean
over all positions of the whole text. Texts are read in windows of ``span`` bytes, each from a zero state; a text's
last window reaches back to be full, and its positions count once. Gates use x / (1 + |x|) in place of the logistic
function and tanh, which is as good here and several times faster.

It is fitted on a bounded sample: at most ``per_language`` documents of each language among the rows allowed for
learning, and of each one piece of at most ``sample_chars`` characters at a place drawn by its hash (documented
parameters, which bound what reaches the driver); it is applied to every row, whole. The sample is drawn by a hash of
doc_id and text, so that a source with a third of the rows has no more than its share.

Defined results: a text that is null or has no letter is ``und`` with score 0. With nothing to learn from, every row
is ``und``. doc_id, lang and source never reach the network. Repeated rows are scored alike and kept. Rows without
doc_id are predicted, never learned from, and are not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.common import bounded_batches, one_thread, slices, table

def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


@dataclass
class Direction:
    table: np.ndarray  # (256, 3 H): what a byte adds to the reset, update and candidate gates
    inner: np.ndarray  # (H, 3 H)


@dataclass
class Network:
    labels: list[str]
    ways: list[Direction]
    out: np.ndarray  # (2 H, labels)
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.ways[0].table, self.ways[0].inner, self.ways[1].table, self.ways[1].inner, self.out, self.bias]


def _run(way: Direction, windows: np.ndarray, back: bool, trace: list | None = None) -> np.ndarray:
    """States (span, rows, H) of one direction; windows: (span, rows) bytes. trace gets what the gradient needs."""
    span, rows = windows.shape
    size = way.inner.shape[0]
    states = np.empty((span, rows, size), np.float32)
    h = np.zeros((rows, size), np.float32)
    for t in range(span - 1, -1, -1) if back else range(span):
        x = way.table[windows[t]]
        g = h @ way.inner
        s = x[:, : 2 * size] + g[:, : 2 * size]
        s /= 1 + np.abs(s)
        gate = s * np.float32(0.5)
        gate += np.float32(0.5)
        r, z = gate[:, :size], gate[:, size:]
        n = r * g[:, 2 * size :]
        n += x[:, 2 * size :]
        n /= 1 + np.abs(n)
        if trace is not None:
            trace.append((t, h, s, r, z, n, g[:, 2 * size :]))
        h = n + z * (h - n)
        states[t] = h
    return states


def _backward(way: Direction, windows: np.ndarray, trace: list, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of table and inner weights, given those of the states (span, rows, H)."""
    size = way.inner.shape[0]
    d_table, d_inner = np.zeros_like(way.table), np.zeros_like(way.inner)
    dh = np.zeros_like(ahead[0])
    for t, h, s, r, z, n, gn in reversed(trace):
        dh = dh + ahead[t]
        dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
        dz = dh * (h - n) * 0.5 * (1 - np.abs(s[:, size:])) ** 2
        dr = dn * gn * 0.5 * (1 - np.abs(s[:, :size])) ** 2
        d_gates = np.concatenate([dr, dz, dn * r], 1)
        d_inner += h.T @ d_gates
        one = np.zeros((256, len(dn)), np.float32)
        one[windows[t], np.arange(len(dn))] = 1
        d_table += one @ np.concatenate([dr, dz, dn], 1)
        dh = dh * z + d_gates @ way.inner.T
    return d_table, d_inner


def _position_probabilities(net: Network, windows: np.ndarray) -> np.ndarray:
    """(span, rows, labels)"""
    states = np.concatenate([_run(net.ways[0], windows, False), _run(net.ways[1], windows, True)], 2)
    logits = states @ net.out + net.bias
    logits -= logits.max(2, keepdims=True)
    p = np.exp(logits)
    return p / p.sum(2, keepdims=True)


def cut_windows(texts: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows (span, rows), the text of each, and how many positions at its end count."""
    parts, owner, counted = [], [], []
    for i, x in enumerate(texts):
        n = len(x)
        if not n:
            continue
        full = n // span
        parts.append(x[: full * span])
        owner += [i] * full
        counted += [span] * full
        if n % span:
            parts.append(x[-span:] if n >= span else b" " * (span - n) + x)
            owner.append(i)
            counted.append(n % span)
    windows = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, span).T
    return np.ascontiguousarray(windows), np.array(owner, np.int64), np.array(counted, np.int64)


def train(samples: list[tuple[bytes, str]], hidden: int = 16, span: int = 64, steps: int = 260, rows: int = 256, rate: float = 0.02, seed: int = 7) -> Network:
    """Fit by Adam on windows drawn at random from the samples, languages in equal shares."""
    draw = np.random.default_rng(seed)
    labels = sorted({lang for _, lang in samples})
    by = [[x for x, lang in samples if lang == label and x] for label in labels]
    scale = 1 / np.sqrt(hidden)
    new = lambda *shape: (draw.standard_normal(shape) * scale).astype(np.float32)
    net = Network(labels, [Direction(new(256, 3 * hidden), new(hidden, 3 * hidden)) for _ in range(2)], new(2 * hidden, len(labels)), np.zeros(len(labels), np.float32))
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    for step in range(1, steps + 1 if len(labels) > 1 else 1):
        truth = draw.integers(0, len(labels), rows)
        picked = []
        for k in truth:
            x = by[k][draw.integers(len(by[k]))]
            at = int(draw.integers(max(1, len(x) - span + 1)))
            picked.append(x[at : at + span].rjust(span))
        windows = np.frombuffer(b"".join(picked), np.uint8).reshape(rows, span).T
        traces: list[list] = [[], []]
        states = [_run(net.ways[i], windows, bool(i), traces[i]) for i in range(2)]
        both = np.concatenate(states, 2)
        logits = both @ net.out + net.bias
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        d = p
        d[:, np.arange(rows), truth] -= 1
        d /= rows * span
        flat = d.reshape(-1, len(labels))
        d_states = d @ net.out.T
        grads = [*_backward(net.ways[0], windows, traces[0], d_states[:, :, :hidden]), *_backward(net.ways[1], windows, traces[1], d_states[:, :, hidden:]), both.reshape(-1, 2 * hidden).T @ flat, flat.sum(0)]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * min(1.0, 20 / step + 0.3) if step > 20 else rate
        for p_, g, m, v in zip(net.parameters(), grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p_ -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def predict(net: Network | None, texts: list[str | None], span: int = 64, rows: int = 2048) -> tuple[list[str], list[float]]:
    known = [t if t and any(map(str.isalpha, t)) else "" for t in texts]
    total = np.zeros((len(texts), len(net.labels) if net else 1))
    if net and any(known):
        windows, owner, counted = cut_windows([t.encode() for t in known], span)
        place = np.arange(span)[:, None]
        for a in range(0, len(owner), rows):
            part = slice(a, a + rows)
            p = _position_probabilities(net, windows[:, part])
            p *= (place >= span - counted[part])[:, :, None]
            np.add.at(total, owner[part], p.sum(0))
    best = total.argmax(1)
    score = total.max(1) / np.maximum(total.sum(1), 1e-12)
    return (
        [net.labels[b] if net and t else "und" for b, t in zip(best, known, strict=True)],
        [min(1.0, float(s)) if net and t else 0.0 for s, t in zip(score, known, strict=True)],
    )


def fit(docs: DataFrame, per_language: int = 400, sample_chars: int = 16_384) -> Network | None:
    """docs: the rows to learn from (doc_id, text, lang). At most per_language pieces of texts of each language reach the
    driver."""
    start = F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.length("text") - sample_chars + 1)).cast("int")
    piece = F.substring(F.col("text"), start + 1, F.lit(sample_chars))
    usable = docs.where("lang is not null and text is not null").select("lang", piece.alias("text"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("draw"), F.xxhash64("text").alias("tie"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.lit(0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, 1.5 * per_language / n) * (1 << 30)))).otherwise(share)
    found: dict[str, list] = {}
    for r in usable.where(F.col("draw") < share).orderBy("draw", "tie", "lang").limit(2 * per_language * len(counts)).collect():
        found.setdefault(r["lang"], []).append(r["text"].encode())
    samples = [(x, lang) for lang, xs in found.items() for x in xs[:per_language] if x]
    if not samples:
        return None
    with one_thread():
        return train(samples)


def apply(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs with lang_pred and score for every row (columns of these names are replaced)."""
    kept = docs.drop("lang_pred", "score")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            labels, scores = predict(net, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return bounded_batches(kept).mapInArrow(work, f"{schema}, lang_pred string, score double")


def split_rest(column: str = "doc_id") -> Column:
    """crc32 of the id's text modulo 4; rows with remainder 2 are held out."""
    return F.crc32(F.col(column).cast("string")) % 4


def op10_language_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    net = fit(docs.where(split_rest() != 2))
    return apply(docs.select("doc_id", "text"), net).select("doc_id", F.coalesce(split_rest() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
