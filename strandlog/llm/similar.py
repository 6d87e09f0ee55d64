"""Operator 9: similarity join on word shingles with a count-vector R-tree.

A document is its set of hashed shingles (five lower-cased words). Two documents link when 100 * |A & B| >= 75 * |A | B|.
Only connectivity is asked for, so that groups of copies are never written as pairs. Every step but the last can only
find too many candidates, so that no link is lost; the last one compares the sets themselves.

1. Equal sets are one point; its id is the first half of the set's digest, so that copies meet without a join. A task
   describes a set once.
2. Points meet under shared keys: the first n - ceil(0.75 n) + 1 shingles of a set in one order of all shingles, all of
   them at any n. Two linked sets always share one of these. In the order, surveyed frequent shingles come last: those of
   over ``hot`` texts (or of so many that there can be ``heavy`` of them at most, 8 MB), so that a common line is a key
   only of texts which are little else. Any order is exact: the survey decides on speed alone.
3. Shingles are hashed into groups, about one group for two to four shingles; a set's group counts are its point. The
   points under a key form packed R-trees by size class (leaves of 64 points with their coordinate maxima, fan-out 16).
   Pairs of nodes, then points, are cut by size and by the bound |A & B| <= sum of the coordinate minima. What survives
   connects candidates; a key gives at most one edge for each point. Keys with the same members are judged once.
4. Keys of the frequent list, and others with over twice its limit of members, are taken together: members of like size (classes
   overlap, so that no possible pair is parted) hang together by one edge to the smallest id each, and the points of each
   set that so hangs together form trees as those of a key do.
5. Each connected set of candidates is verified with the exact shingle sets: from a document, the ones not yet reached
   are compared, so that a group of near copies costs about one comparison each. Candidates' texts are read again for
   this; up to ``small`` candidates (ids and digests, some 60 bytes each) are broadcast to them.

Sets of over ``tile_bytes`` of points (4) or ``group_tokens`` shingles (5) are cut into tiles. Every tile is compared within itself
and with ``roots`` members; what hangs together by this is settled, and only members outside the largest class so found
are compared with every tile. So memory is bounded, and a huge group of near copies costs time in proportion to it; sets
that frequent shingles hold together without likeness cost the square of their size, in tasks of bounded size.

Defined results: documents without words (null, empty) have n_shingles 0 and their own doc_id as component; a text
with fewer than five words is one shingle of them all. Rows are judged one by one; rows that repeat a doc_id with
another text are documents of their own. Rows without doc_id get a null component and link with nothing. Hashes have
64 bits, sets are compared by 128-bit digests. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.llm.common import bounded_batches, components, give_back, gram_hashes, materialize, mix, room, slices, split_words, table

LEAF, FAN = 64, 16


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted: flat hashes, and where each text's begin (one more entry)."""
    words = split_words(texts, lower=True)
    size = np.diff(words.first)
    hashes = words.hashes()
    grams = gram_hashes(hashes, width)
    keep = room(words) >= width
    short = np.flatnonzero((size > 0) & (size < width))
    doc, found = words.doc[keep], grams[keep]
    if len(short):
        whole = []
        for i in short.tolist():
            x = np.uint64(size[i])
            for h in hashes[words.first[i] : words.first[i + 1]]:
                x = mix(np.array([x ^ h], np.uint64))[0]
            whole.append(x)
        doc, found = np.concatenate([doc, short]), np.concatenate([found, np.array(whole, np.uint64)])
    order = np.lexsort((found, doc))
    doc, found = doc[order], found[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
    doc, found = doc[new], found[new]
    return found, np.searchsorted(doc, np.arange(len(texts) + 1))


def prefix(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-n * percent // 100) + 1


# ---------------------------------------------------------------- R-tree over points under one key


def group_count(size_class: int) -> int:
    """Groups for sets of 2**size_class shingles and more: two to four shingles fall into a group, so that the minima
    of unrelated sets stay well under their sizes; 64 groups at least, 4,096 at most (then the bound is looser)."""
    return min(1 << 12, max(64, 1 << max(0, size_class - 1)))


def count_vector(shingles: np.ndarray) -> bytes:
    """A set's group counts as bytes; nothing if a count is over 255 (then sizes alone bound)."""
    groups = group_count(int(len(shingles)).bit_length() - 1)
    counts = np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def _folded(points: list[bytes], groups: int, size: np.ndarray) -> np.ndarray:
    """Points over ``groups`` groups: finer ones are folded. A set without a point has its size in each group."""
    out = np.empty((len(points), groups), np.uint32)
    for i, p in enumerate(points):
        out[i] = np.frombuffer(p, np.uint8).reshape(-1, groups).sum(0) if p else size[i]
    return out


def _bounded(points: np.ndarray, size: np.ndarray, low: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether nodes i and j can hold a link: sizes (most, least of each node) and summed coordinate minima."""
    ok = (100 * size[i] >= percent * low[j]) & (100 * size[j] >= percent * low[i])
    at = np.flatnonzero(ok)
    step = max(1, (1 << 20) // points.shape[1])
    for a in range(0, len(at), step):
        part = at[a : a + step]
        over = np.minimum(points[i[part]], points[j[part]]).sum(1, dtype=np.int64)
        ok[part] = (100 + percent) * over >= percent * (low[i[part]] + low[j[part]])
    return ok


def candidate_pairs(points: np.ndarray, size: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that the bound does not exclude, in blocks. points: (rows, groups) counts; size: their sums."""
    # order by size, then by the position of the largest coordinate, to make nodes tight
    order = np.lexsort((points.argmax(1), size))
    levels = [(points[order], size[order], size[order])]
    width = LEAF
    while len(levels[-1][0]) > 1:
        p, most, least = levels[-1]
        begin = np.arange(0, len(p), width)
        levels.append((np.maximum.reduceat(p, begin, 0), np.maximum.reduceat(most, begin), np.minimum.reduceat(least, begin)))
        width = FAN

    def expand(level: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if level == 0:
            yield order[i], order[j]
            return
        fan = LEAF if level == 1 else FAN
        below = levels[level - 1]
        step = max(1, 65536 // (fan * fan))
        for a in range(0, len(i), step):
            k = np.arange(fan)
            ci = (i[a : a + step, None, None] * fan + k[None, :, None] + 0 * k[None, None, :]).ravel()
            cj = (j[a : a + step, None, None] * fan + k[None, None, :] + 0 * k[None, :, None]).ravel()
            in_range = (ci < len(below[0])) & (cj < len(below[0])) & ((ci < cj) if level == 1 else (ci <= cj))
            ci, cj = ci[in_range], cj[in_range]
            ok = _bounded(below[0], below[1], below[2], ci, cj, percent)
            if ok.any():
                yield from expand(level - 1, ci[ok], cj[ok])

    if len(levels) > 1:
        root = np.zeros(1, np.int64)
        yield from expand(len(levels) - 1, root, root)


def _labels(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row connected with each of n rows."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            if (a == b).all():
                break
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(label, high, low)
            while not (label == label[label]).all():
                label = label[label]
    return label


def _block_labels(size: np.ndarray, points: list[bytes], percent: int) -> np.ndarray:
    """Connected candidates of one key. One tree for each size class, with those of the next class that are near enough
    in size, over the class's groups; pairs within the next class are left to its own, finer tree."""
    classes = np.frexp(size.astype(float))[1] - 1

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for c in np.unique(classes).tolist():
            own = classes == c
            rows = np.flatnonzero(own | ((classes == c + 1) & (percent * size <= 100 * size[own].max())))
            if len(rows) > 1:
                folded = _folded([points[i] for i in rows], group_count(c), size[rows])
                for i, j in candidate_pairs(folded, size[rows], percent):
                    keep = own[rows[i]] | own[rows[j]]
                    yield rows[i[keep]], rows[j[keep]]

    return _labels(len(size), pairs())


def _key_edges(key: np.ndarray, ids: np.ndarray, size: np.ndarray, points: pa.ChunkedArray, percent: int, seen: set) -> Iterator[tuple[int, int]]:
    """Edges (id, id) for whole keys; rows sorted by key. seen: pairs of two-row keys that are judged already."""
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist() + [len(key)]
    for a, b in zip(cut, cut[1:], strict=False):
        if b - a < 2:
            continue
        if b - a == 2:
            x, y = (a, a + 1) if ids[a] < ids[a + 1] else (a + 1, a)
            pair = (int(ids[x]), int(ids[y]))
            if pair in seen or 100 * size[x] < percent * size[y] or 100 * size[y] < percent * size[x]:
                continue
            seen.add(pair)
            p, q = (np.frombuffer(points[i].as_py(), np.uint8) for i in (x, y))
            if len(p) and len(q):
                groups = min(len(p), len(q))
                over = int(np.minimum(p.reshape(-1, groups).sum(0), q.reshape(-1, groups).sum(0)).sum())
                if (100 + percent) * over < percent * (size[x] + size[y]):
                    continue
            yield pair
            continue
        label = _block_labels(size[a:b], points.slice(a, b - a).to_pylist(), percent)
        for i in np.flatnonzero(label != np.arange(b - a)).tolist():
            yield int(ids[a + i]), int(ids[a + label[i]])


# ---------------------------------------------------------------- exact verification


def verified_labels(sets: list[np.ndarray], percent: int, step: int = 1 << 18) -> np.ndarray:
    """Connected components of the links among these sets: the smallest row of each. Beside the sets, only ``step``
    of their shingles (one set at least) are worked on at a time."""
    n = len(sets)
    label = np.full(n, -1)
    size = np.fromiter(map(len, sets), np.int64, n)
    left = np.arange(n)
    while len(left):
        # the first of those left begins a component
        root, left = left[0], left[1:]
        label[root], front = root, [root]
        while front and len(left):
            x = sets[front.pop()]
            near = (100 * size[left] >= percent * len(x)) & (100 * len(x) >= percent * size[left])
            some = left[near]
            both = np.zeros(len(some), np.int64)
            ends = np.cumsum(size[some])
            a = 0
            while a < len(some):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + step, "right")))
                flat = np.concatenate([sets[i] for i in some[a:b].tolist()])
                at = np.searchsorted(x, flat)
                at[at == len(x)] = 0
                both[a:b] = np.add.reduceat((x[at] == flat).astype(np.int64), np.append(0, np.cumsum(size[some[a:b]])[:-1]))
                a = b
            link = 100 * both >= percent * (len(x) + size[some] - both)
            if link.any():
                found = some[link]
                label[found] = root
                front += found.tolist()
                left = left[label[left] < 0]
    return label


def _segments(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Whole groups of equal ``column`` from sorted batches (a group never spans two of what is yielded)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column(column)[batch.num_rows - 1].as_py()
        values = batch.column(column).to_numpy()
        cut = int(np.searchsorted(values, last, "left"))
        if cut or (held and held[-1].column(column)[held[-1].num_rows - 1].as_py() != last):
            ready = [*held, *([batch.slice(0, cut)] if cut else [])]
            yield pa.Table.from_batches(ready)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
    give_back()


def _merged(hashes: np.ndarray, counts: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts summed by hash; of over 2 * keep the keep most frequent."""
    hashes, place = np.unique(hashes, return_inverse=True)
    counts = np.bincount(place, counts, len(hashes)).astype(np.int64)
    if len(hashes) > 2 * keep:
        top = np.argpartition(counts, len(counts) - keep)[-keep:]
        hashes, counts = hashes[top], counts[top]
    return hashes, counts


def frequent_shingles(texts: DataFrame, width: int, heavy: int, least: int, block: int = 1 << 21, keep: int = 250_000) -> tuple[np.ndarray, int]:
    """Shingles found in over ``limit`` texts, sorted, and that limit: ``least``, or more where over ``heavy`` shingles could
    be so frequent. Counted over all texts; from each block of some ``block`` shingles only those found four times or
    more are summed up, so that counts may be a little low."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, held, size, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0, 0

        def counted() -> tuple[np.ndarray, np.ndarray]:
            found, times = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            often = times >= min(4, least)
            return _merged(np.append(hashes, found[often]), np.append(counts, times[often]), keep)

        for batch in slices(batches, "text", 1 << 20):
            held.append(shingle_sets(batch.column("text"), width)[0])
            size += len(held[-1])
            if size > block:
                hashes, counts = counted()
                total, size, held = total + size, 0, []
        hashes, counts = counted()
        yield pa.RecordBatch.from_arrays([pa.array([None]), pa.array([total + size])], schema=pa.schema([("h", pa.int64()), ("n", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], ["h", "n"])

    summed = materialize(bounded_batches(texts.select("text")).mapInArrow(survey, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("h").isNull() | (F.col("n") >= least)))
    total = summed.where("h is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(least, -(-total // heavy))
    found = summed.where(F.col("h").isNotNull() & (F.col("n") >= limit)).select("h").toArrow().column("h").to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64)), limit


def prefix_keys(flat: np.ndarray, begin: np.ndarray, wanted: np.ndarray, percent: int, frequent: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """The keys of each wanted set (flat: hashes sorted within sets that begin at ``begin``): ordinary and frequent ones."""
    n = np.diff(begin)
    doc = np.repeat(np.arange(len(n)), n)
    often = np.zeros(len(flat), bool)
    if len(frequent) and len(flat):
        often = frequent[np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)] == flat
        if often.any():
            order = np.lexsort((flat, often, doc))
            flat, often = flat[order], often[order]
    kept = (np.arange(len(flat)) - begin[doc] < prefix(n, percent)[doc]) & wanted[doc]
    lists = []
    for which in (kept & ~often, kept & often):
        sizes = np.bincount(doc[which], minlength=len(n)) if len(n) else n
        lists.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat[which].view(np.int64))))
    return lists[0], lists[1]


def shared_keys(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """From (key, id) sorted by both: (g, id, wide) for keys with two distinct ids or more; g names the set of members, or
    the key itself if there are over ``hot`` (wide)."""
    seen: set[int] = set()
    for part in _segments(batches, "key"):
        key, ids = part.column("key").to_numpy(), part.column("id").to_numpy()
        new = np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]))
        key, ids = key[new], ids[new]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(begin, len(key)))
        shared = size > 1
        begin, size = begin[shared], size[shared]
        if not len(begin):
            continue
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        total = np.append(np.uint64(0), np.cumsum(mix(ids[at].view(np.uint64))))
        ends = np.cumsum(size)
        name = mix(total[ends] - total[ends - size]).view(np.int64)
        wide = size > hot
        name = np.where(wide, key[begin], name)
        fresh = np.array([w or g not in seen for g, w in zip(name.tolist(), wide.tolist(), strict=True)])
        seen.update(name[~wide].tolist())
        if len(seen) > 1_000_000:
            seen.clear()
        rows = np.repeat(fresh, size)
        if rows.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[rows]), pa.array(ids[at][rows]), pa.array(np.repeat(wide, size)[rows])], ["g", "id", "wide"])


def wide_edges(members: DataFrame, percent: int) -> DataFrame:
    """members: (g, id, n). Edges (a, b) that connect the members of a key whose sizes may allow a link: a set stands in
    two size classes of ratio 100 / percent, so that any two sets within that ratio share one. Minima are summed up before
    the shuffle, and the join's large partitions can be split."""
    place = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) * (1 + 1e-9)))
    spread = members.distinct().select("g", "id", F.explode(F.array(place, place + 1)).alias("class"))
    least = spread.groupBy("g", "class").agg(F.min("id").alias("b"))
    return spread.join(least, ["g", "class"]).where("id <> b").select(F.col("id").alias("a"), "b").distinct()


def _once(part: pa.Table, column: str) -> pa.Table:
    """Rows sorted by column and id without those that repeat both."""
    group, ids = part.column(column).to_numpy(), part.column("id").to_numpy()
    same = (group[1:] == group[:-1]) & (ids[1:] == ids[:-1])
    return part.filter(pa.array(np.append(True, ~same))) if same.any() else part


def _comparisons(batches: Iterator[pa.RecordBatch], column: str, percent: int) -> Iterator[pa.RecordBatch]:
    """From (column, id, tokens) sorted by column and id: (id, label), the smallest linked id within the group."""
    for part in _segments(batches, column):
        part = _once(part, column)
        group, ids = part.column(column).to_numpy(), part.column("id").to_numpy()
        cut = np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist() + [len(group)]
        label = np.empty(len(ids), np.int64)
        for a, b in zip(cut, cut[1:], strict=False):
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("tokens").slice(a, b - a)]
            label[a:b] = ids[a + verified_labels(sets, percent)]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label)], ["id", "label"])


def tiled_edges(items: DataFrame, tiles: DataFrame, compare: Callable[[DataFrame], DataFrame], roots: int) -> DataFrame:
    """Edges (a, b) that connect what is linked within sets that are too large for one task. items: (component, id, ...),
    ids once; tiles: (component, tiles); compare: edges (a, b) within the groups g of rows (g, id, ...)."""
    others = [c for c in items.columns if c not in ("component", "id")]
    items = materialize(items.join(tiles, "component").withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles"))))
    grouped = lambda df: compare(df.select(F.xxhash64("component", "i", "t").alias("g"), "id", *others))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("t")
    none = F.lit(-1).cast("long").alias("i")
    order = Window.partitionBy("component").orderBy(F.xxhash64("id", F.lit(1)), "id")
    chosen = items.select("component", "id", F.row_number().over(order).alias("r")).where(F.col("r") <= roots).select("component", "id")
    spread = items.join(chosen, ["component", "id"], "left_semi").select("component", none, every, "id", *others)
    own = items.join(chosen, ["component", "id"], "left_anti").select("component", none, "t", "id", *others)
    edges = materialize(grouped(own.unionByName(spread)))
    settled = components(edges).withColumnRenamed("component", "class")
    known = items.select("component", "id").join(settled, "id", "left").select("component", "id", F.coalesce("class", "id").alias("class"))
    main = known.groupBy("component", "class").count().groupBy("component").agg(F.max_by("class", F.struct("count", "class")).alias("class"))
    rest = materialize(known.join(main, ["component", "class"], "left_anti").select("component", "id"))
    if rest.isEmpty():
        return edges
    # members outside the main class: in tiles of their own, each compared with every tile
    left = materialize(items.join(rest, ["component", "id"], "left_semi").withColumn("i", F.pmod(F.xxhash64("id", F.lit(2)), F.col("tiles"))))
    ahead = left.select("component", "i", every, "id", *others)
    met = items.join(left.select("component", "i").distinct(), "component").select("component", "i", "t", "id", *others)
    return edges.unionByName(grouped(ahead.unionByName(met)))


def labelled(docs: DataFrame, percent: int = 75, width: int = 5, hot: int = 1000, heavy: int = 1 << 20, tile_bytes: int = 4 << 20, group_tokens: int = 400_000, roots: int = 8, small: int = 300_000) -> DataFrame:
    """Rows (doc_id, text_hash, digest, n_shingles, component_id), one for each row of docs; text_hash is xxhash64."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    frequent, limit = frequent_shingles(slim, width, heavy, hot)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        for batch in slices(batches, "text", 1 << 20):
            flat, begin = shingle_sets(batch.column("text"), width)
            n, cut = np.diff(begin), begin.tolist()
            digests = [hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() for a, b in zip(cut, cut[1:], strict=False)]
            keyed = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False) & (n > 0)
            for i, d in enumerate(digests):
                if keyed[i]:
                    keyed[i] = d not in told
                    told.add(d)
            if len(told) > 500_000:
                told.clear()
            keys, often = prefix_keys(flat, begin, keyed, percent, frequent)
            points = [count_vector(flat[a:b]) if k else None for a, b, k in zip(cut, cut[1:], keyed.tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(n, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(np.frombuffer(b"".join(d[:8] for d in digests), np.int64)),
                    keys,
                    often,
                    pa.array(points, pa.binary()),
                ],
                ["doc_id", "text_hash", "n", "digest", "id", "keys", "frequent", "point"],
            )

    signed = materialize(slim.withColumn("text_hash", F.xxhash64("text")).mapInArrow(sign, "doc_id long, text_hash long, n long, digest binary, id long, keys array<long>, frequent array<long>, point binary"))
    # keys shared by two points or more
    placed = signed.select(F.explode("keys").alias("key"), "id").repartition(parts, "key").sortWithinPartitions("key", "id")
    shared = materialize(placed.mapInArrow(lambda batches: shared_keys(batches, 2 * limit), "g long, id long, wide boolean"))
    points = signed.where("point is not null").select("id", "n", "point").dropDuplicates(["id"])

    def join_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for part in _segments(batches, "g"):
            part = _once(part, "g")
            found = set(_key_edges(part.column("g").to_numpy(), part.column("id").to_numpy(), part.column("n").to_numpy(), part.column("point"), percent, seen))
            if len(seen) > 1_000_000:
                seen.clear()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    def grown(groups: DataFrame) -> DataFrame:
        """Edges by the trees of groups (g, id, n, point)."""
        return groups.repartition(parts, "g").sortWithinPartitions("g", "id").mapInArrow(join_points, "a long, b long")

    groups = shared.where("not wide").select("g", "id").distinct()
    often = signed.select(F.explode("frequent").alias("g"), "id", "n")
    wide = shared.where("wide").select("g", "id").join(points.select("id", "n"), "id").select("g", "id", "n")
    loose = materialize(wide_edges(often.unionByName(wide), percent))
    edges = None
    if not loose.isEmpty():
        loose = components(loose)
        sized = loose.join(points.select("id", F.octet_length("point").alias("bytes")), "id")
        counted = materialize(sized.groupBy("component").agg((1 + F.floor(F.sum(F.col("bytes") + 64) / tile_bytes)).cast("long").alias("tiles")))
        groups = groups.unionByName(loose.join(counted.where("tiles = 1"), "component").select(F.col("component").alias("g"), "id"))
        large = counted.where("tiles > 1")
        if not large.isEmpty():
            edges = tiled_edges(loose.join(large.select("component"), "component", "left_semi").join(points, "id").select("component", "id", "n", "point"), large, grown, roots)
    by_key = grown(groups.join(points, "id").select("g", "id", "n", "point"))
    candidates = components(by_key if edges is None else by_key.unionByName(edges))

    # exact sets of the candidates, each once
    first = signed.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("id").alias("id"), F.first("n").alias("n"))
    first = materialize(first.join(candidates, "id", "left"))
    wanted = first.where("component is not null")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            flat, begin = shingle_sets(batch.column("text"), width)
            cut = begin.tolist()
            sets = [flat[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
            right = pa.array([hashlib.blake2b(s, digest_size=16).digest() == d for s, d in zip(sets, batch.column("digest").to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("id"), pa.array(sets, pa.binary())], ["component", "id", "tokens"]).filter(right)

    sizes = materialize(wanted.groupBy("component").agg(F.sum("n").alias("n")).where(F.col("n") > group_tokens).select("component", (1 + F.floor(2 * F.col("n") / group_tokens)).cast("long").alias("tiles")))
    named = wanted.select(F.col("rep").alias("doc_id"), "component", "digest")
    # few candidates meet the texts where they lie; more of them by a shuffle of the texts
    named = F.broadcast(named) if wanted.count() <= small else named.hint("merge")
    texts = slim.join(named, "doc_id").select("component", F.col("doc_id").alias("id"), "digest", "text")
    kind = "component long, id long, tokens binary"

    def verified(groups: DataFrame, column: str) -> DataFrame:
        """Labels (id, label) within groups (column, id, tokens), without those that label themselves."""
        return groups.repartition(parts, column).sortWithinPartitions(column, "id").mapInArrow(lambda batches: _comparisons(batches, column, percent), "id long, label long").where("id <> label")

    final = verified(texts.join(sizes, "component", "left_anti").mapInArrow(exact, kind), "component")
    if not sizes.isEmpty():
        sets = texts.join(sizes, "component", "left_semi").mapInArrow(exact, kind).repartition(parts, "component", "id").dropDuplicates(["component", "id"])
        links = tiled_edges(sets, sizes, lambda groups: verified(groups, "g").toDF("a", "b"), roots)
        final = final.unionByName(components(links).select("id", F.col("component").alias("label")))
    final = final.where("id <> label").distinct()

    classes = first.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("component_id"))
    own = signed.select("doc_id", "text_hash", "digest", F.col("n").alias("n_shingles"))
    linked = own.where("n_shingles > 0 and doc_id is not null").join(classes, "digest").select(*own.columns, "component_id")
    return linked.unionByName(own.where("n_shingles = 0 or doc_id is null").withColumn("component_id", F.col("doc_id")))


def similar_components(docs: DataFrame, **options) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of docs."""
    return labelled(docs, **options).select("doc_id", "n_shingles", "component_id")


def op9_similar_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))


#: Words, shingles as joined words, all pairs of distinct sets that share one, and the closure of their links.
OP9_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), k AS MATERIALIZED (
  SELECT s, min(doc_id) AS rep, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s
), t AS MATERIALIZED (
  SELECT rep, n, unnest(s) AS g FROM k
), c AS MATERIALIZED (
  SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS o FROM t a JOIN t b ON a.g = b.g AND a.rep < b.rep AND 100 * a.n >= 75 * b.n AND 100 * b.n >= 75 * a.n GROUP BY ALL
), e AS MATERIALIZED (
  SELECT a, b FROM c WHERE 100 * o >= 75 * (na + nb - o) UNION ALL SELECT b, a FROM c WHERE 100 * o >= 75 * (na + nb - o)
), r AS (
  SELECT rep AS x, rep AS y FROM k UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a
), m AS (SELECT x, min(y) AS component FROM r GROUP BY x)
SELECT s.doc_id AS doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.component, s.doc_id) AS component_id
FROM s LEFT JOIN k ON s.s = k.s LEFT JOIN m ON k.rep = m.x
"""
