"""Operator 2: removal of repeated passages (windows of words) by super-k-mer partitioning.

A window is ``window`` consecutive words of one text. Its minimiser is the least hashed run of ``m`` words in it.
Consecutive windows that share a minimiser form a super-k-mer, which travels as one packed string to the bucket of its
minimiser: equal windows have equal minimisers, so they meet in one bucket, where sorting their hashes finds the runs
of equal windows; each run is verified byte by byte and its earliest window (smaller doc_id, then earlier start) kept.

Size and skew. Buckets grow in number with the bytes of the input. Equal super-k-mers of a task travel once: only the
earliest can be the first of its windows, the others are known repeats (so a text with thousands of copies costs a
bucket one string for each task). Runs of words that start very many super-k-mers (a common line in a third of all
texts) are found first: a task reports those with at least 1/``heavy`` of its super-k-mers, which no value with that
share of the whole escapes, and at most ``heavy`` of them are kept. They rank last among minimisers, so that windows
around a common line are dealt by their other words.

Defined results: null and empty texts have no words. Rows that bear the same doc_id and text are one document (each
row is returned); rows that bear the same doc_id but another text stand at the same place, so that neither is earlier
than the other at equal starts. Texts with fewer words than a window keep them all, as do rows without doc_id. Other
columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.common import Words, bounded_batches, give_back, gram_hashes, mix, room, slices, split_words, table

KEYS = ["__id", "__hash"]


def minimisers(words: Words, window: int, m: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start word of each super-k-mer and its minimiser; a super-k-mer's windows end where the next begins or where
    the text has no further window. Returns (minimiser of each word's window, whether the word starts a window)."""
    valid = room(words) >= window
    grams = gram_hashes(words.hashes(), m) >> np.uint64(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
        grams = np.where(hot[at] == grams, grams | np.uint64(1 << 63), grams)
    least, have = grams, 1
    need = window - m + 1
    while have < need:  # the minimum over ``need`` places, by doubling
        step = min(have, need - have)
        longer = least.copy()
        np.minimum(least[:-step], least[step:], out=longer[:-step])
        least, have = longer, have + step
    return least, valid


def runs(words: Words, window: int, m: int, hot: np.ndarray, longest: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers: first word, number of windows, minimiser. Runs of over ``longest`` windows are cut."""
    least, valid = minimisers(words, window, m, hot)
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at, least[:0]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    if size.max() > longest:
        parts = -(-size // longest)
        owner = np.repeat(np.arange(len(begin)), parts)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, size = begin[owner] + k * longest, np.minimum(longest, size[owner] - k * longest)
    first = at[begin]
    return first, size, least[first]


def _packet(items: list[tuple[bytes, int, int, int]], known: list[tuple[int, int, int, int]], squeeze: zstandard.ZstdCompressor) -> bytes:
    """items: (string, doc, hash, start); known: (doc, hash, start, end) of windows known to repeat."""
    strings = b"".join([s + b" " for s, *_ in items])
    head = np.array([len(items), len(known)], np.int64)
    cols = np.array([(d, h, s, len(x) + 1) for x, d, h, s in items], np.int64).reshape(-1, 4)
    return squeeze.compress(b"".join([head.tobytes(), cols.T.tobytes(), np.array(known, np.int64).reshape(-1, 4).T.tobytes(), strings]))


def _unpack(packet: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packet)
    n, k = np.frombuffer(raw, np.int64, 2)
    cols = np.frombuffer(raw, np.int64, 4 * n, 16).reshape(4, n)
    known = np.frombuffer(raw, np.int64, 4 * k, 16 + 32 * n).reshape(4, k)
    return cols, known, raw[16 + 32 * (n + k) :]


def repeats_in_bucket(cols: np.ndarray, strings: bytes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, hash, start) of every window of a bucket whose words also start earlier. cols: doc, hash, start, bytes."""
    empty = np.zeros(0, np.int64)
    if not cols.shape[1]:
        return empty, empty, empty
    data = np.frombuffer(strings, np.uint8)
    end = np.flatnonzero(data == 32)
    start = np.concatenate([[0], end[:-1] + 1])
    begins = np.concatenate([[0], np.cumsum(cols[3])])
    first = np.searchsorted(start, begins, "left")
    owner = np.repeat(np.arange(cols.shape[1]), np.diff(first))
    words = Words(data, start, end, owner, first)
    at = np.flatnonzero(room(words) >= window)
    hashed = gram_hashes(words.hashes(), window)[at]
    order = np.argsort(hashed, kind="stable")
    hashed, at = hashed[order], at[order]
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = hashed[1:] == hashed[:-1]
    many = np.flatnonzero(same[:-1] | same[1:])
    if not len(many):
        return empty, empty, empty
    at, hashed = at[many], hashed[many]
    own = owner[at]
    doc, place = cols[0][own], cols[2][own] + (at - first[own])
    order = np.lexsort((place, doc, hashed))
    at, hashed, own, doc, place = at[order], hashed[order], own[order], doc[order], place[order]
    new = np.ones(len(at), bool)
    new[1:] = hashed[1:] != hashed[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    low, high = start[at].tolist(), end[at + window - 1].tolist()
    leads = lead.tolist()
    equal = all(j == i or strings[low[i] : high[i]] == strings[low[j] : high[j]] for i, j in enumerate(leads))
    if not equal:  # two texts of one hash: compare the words themselves
        seen: dict[bytes, int] = {}
        for i in np.lexsort((place, doc)).tolist():
            leads[i] = seen.setdefault(strings[low[i] : high[i]], i)
        lead = np.array(leads)
    later = (doc != doc[lead]) | (place != place[lead])
    return doc[later], cols[1][own[later]], place[later]


def merge_spans(doc: np.ndarray, hashed: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Union of spans by document: (doc, hash, int32 pairs)."""
    if not len(doc):
        return
    order = np.lexsort((start, hashed, doc))
    doc, hashed, start, end = doc[order], hashed[order], start[order], end[order]
    new_doc = np.ones(len(doc), bool)
    new_doc[1:] = (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1])
    group = np.cumsum(new_doc) - 1
    wide = np.int64(1 << 40)
    reach = np.maximum.accumulate(group * wide + end) - group * wide
    new = new_doc.copy()
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    pairs = np.stack([start[at], reach[last]], 1).astype("<i4")
    owner = group[at]
    cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    for a, b in zip(cuts, np.append(cuts[1:], len(owner)), strict=True):
        yield int(doc[at[a]]), int(hashed[at[a]]), pairs[a:b].tobytes()


def repeated_spans(docs: DataFrame, window: int = 20, m: int = 3, bucket_bytes: int = 4 << 20, heavy: int = 2000) -> DataFrame:
    """docs: __id, __hash, text. Rows (__id, __hash, spans): spans of words, int32 pairs, that repeat an earlier window."""
    none = np.zeros(0, np.uint64)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = size = 0
        seen: dict[int, int] = {}
        for batch in slices(batches, "text"):
            words = split_words(batch.column("text"))
            size += len(words.data)
            key = np.sort(runs(words, window, m, none)[2])
            total += len(key)
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
            counts = np.diff(np.append(begin, len(key))) if len(key) else key
            big = counts >= max(8, len(key) // heavy)
            for k, n in zip(key[begin[big].astype(np.int64)].tolist(), counts[big].tolist(), strict=True) if len(key) else ():
                seen[k] = seen.get(k, 0) + n
        top = [(k, n) for k, n in seen.items() if n >= max(8, total // heavy)]
        yield pa.RecordBatch.from_arrays([pa.array([None, *[k for k, _ in top]], pa.int64()), pa.array([total, *[n for _, n in top]], pa.int64()), pa.array([size, *[0] * len(top)], pa.int64())], ["k", "n", "size"])

    counted = bounded_batches(docs.select("text")).mapInArrow(survey, "k long, n long, size long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    found = counted.orderBy(F.col("k").isNull().desc(), F.col("n").desc(), "k").limit(heavy + 1).collect()
    total, size = (found[0]["n"] or 0, found[0]["size"] or 0) if found else (0, 0)
    hot = np.array(sorted(r["k"] for r in found[1:] if r["n"] * heavy >= total), np.uint64)
    buckets = max(16, (window + 10) // 10 * size // bucket_bytes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=6)
        seen: dict[bytes, tuple[int, int, int]] = {}
        home: dict[bytes, int] = {}
        known: dict[int, list] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            by: dict[int, list] = {b: [] for b in known}
            for s, (d, h, p) in seen.items():
                by.setdefault(home[s], []).append((s, d, h, p))
            out = [(b, _packet(items, known.get(b, []), squeeze)) for b, items in by.items()]
            seen.clear(), home.clear(), known.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["bucket", "packet"])

        for batch in slices(batches, "text"):
            words = split_words(batch.column("text"))
            first, count, key = runs(words, window, m, hot)
            data = words.data.tobytes()
            low, high = words.start[first].tolist(), words.end[first + count + window - 2].tolist()
            doc = words.doc[first]
            ids, hashes = batch.column("__id").to_numpy(), batch.column("__hash").to_numpy()
            bucket = (mix(key) % np.uint64(buckets)).astype(np.int64).tolist()
            places = (first - words.first[doc]).tolist()
            for a, b, k, d, h, p, n in zip(low, high, bucket, ids[doc].tolist(), hashes[doc].tolist(), places, count.tolist(), strict=True):
                s, here = data[a:b], (d, h, p)
                other = seen.setdefault(s, here)
                if other is here:
                    home[s] = k
                    held += b - a
                    continue
                if (d, p) < (other[0], other[2]):
                    seen[s], here, other = here, other, here
                if (here[0], here[2]) != (other[0], other[2]):
                    known.setdefault(k, []).append((*here, here[2] + n + window - 1))
                elif here[1] != other[1]:  # another text under the same doc_id: it has to be judged as well
                    seen[s + b" "], home[s + b" "] = here, k
            if held > 24 << 20:
                yield flush()
        yield flush()

    def judge(key: tuple, packets: pa.Table) -> pa.Table:
        unpacked = [_unpack(x) for x in packets.column("packet").to_pylist()]
        cols = np.concatenate([c for c, _, _ in unpacked], 1)
        known = np.concatenate([k for _, k, _ in unpacked], 1)
        doc, hashed, start = repeats_in_bucket(cols, b"".join([s for *_, s in unpacked]), window)
        del unpacked
        give_back()
        rows = list(merge_spans(*[np.concatenate(x) for x in ((doc, known[0]), (hashed, known[1]), (start, known[2]), (start + window, known[3]))]))
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=[*KEYS, "spans"])

    packed = docs.mapInArrow(deal, "bucket long, packet binary")
    spans = packed.groupBy("bucket").applyInArrow(judge, "__id long, __hash long, spans binary")
    return spans.groupBy(*KEYS).agg(F.collect_list("spans").alias("spans"))


def remove_repeats(docs: DataFrame, window: int = 20, **options) -> DataFrame:
    """docs with text replaced by its kept words joined by one space (untouched where no word goes), and columns
    n_words, n_removed. Needs doc_id and text; columns named n_words or n_removed are replaced."""
    kept = docs.drop("n_words", "n_removed")
    inner = {*KEYS, "spans"}
    aside = {c: f"__own_{i}" for i, c in enumerate(kept.columns) if c.lower() in inner}
    kept = kept.withColumnsRenamed(aside)
    marked = kept.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__hash", F.xxhash64("text"))
    spans = repeated_spans(marked.select(*KEYS, "text").where("__id is not null"), window, **options)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = split_words(batch.column("text"))
            data, count = words.data.tobytes(), np.diff(words.first)
            texts, removed = batch.column("text").to_pylist(), [0] * batch.num_rows
            for i, found in enumerate(batch.column("spans").to_pylist()):
                if not found:
                    continue
                gone = np.zeros(count[i] + 1, np.int32)
                for x in found:
                    pairs = np.frombuffer(x, "<i4").reshape(-1, 2)
                    np.add.at(gone, pairs[:, 0], 1)
                    np.add.at(gone, pairs[:, 1], -1)
                gone = np.cumsum(gone[:-1]) > 0
                removed[i] = int(gone.sum())
                edges = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8))).reshape(-1, 2) + words.first[i]
                texts[i] = b" ".join([data[words.start[a] : words.end[b - 1]] for a, b in edges.tolist()]).decode()
            names = [n for n in batch.schema.names if n not in (*KEYS, "spans")]
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_words", "n_removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return marked.join(spans, KEYS, "left").mapInArrow(cut, f"{schema}, n_words long, n_removed long").withColumnsRenamed({b: a for a, b in aside.items()})


def op2_substring_superkmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as long) doc_id", "text")
    tidy = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(tidy, 256).alias("kept_sha256"))


#: Words, every window of 20 as joined words, those that have an earlier equal, and the words under them.
OP2_SQL = r"""
WITH w AS MATERIALIZED (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20
), windows AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(list_slice(w, i, i + 19), ' ') ORDER BY doc_id, i) AS n FROM starts
), gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM windows WHERE n > 1)
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
