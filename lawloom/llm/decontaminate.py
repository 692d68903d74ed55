"""Documents that hold a benchmark item, whole or nearly so.

Every window of a document that has an item's number of words is a candidate where it
shares a word 5-gram with some item. It gets a SimHash of its weighted shingles. The 64
bits are cut into blocks, and items are listed by block value: fingerprints within
``radius`` differ by at most radius // blocks bits in some block, so listing the values
that near finds all of them. The candidates left are verified exactly, by the weighted
Jaccard similarity of the two bags of shingles.

A shingle weighs less the more items have it: 1 / (1 + ln df); one that no item has weighs 1.
The benchmark is dealt into parts of bounded size; documents are scanned once a part,
each time in one narrow pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, materialise, slices, text_bytes, text_of

SHINGLE = 5
BLOCKS, BITS = 8, 8
FOUND = "doc_id long, item_id long, similarity double, start int, end int"


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        words = Words(part.column("text"))
        counts = np.diff(words.bounds)
        h, first, rows = words.shingles(SHINGLE)
        ids = np.asarray(part.column("item_id"))
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(counts[rows], pa.int32()), pa.array((first - words.bounds[rows]).astype(np.int32)), pa.array(h.view(np.int64))], names=["item_id", "n_words", "place", "shingle"])


def fingerprints(shingles: np.ndarray, weights: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """SimHash of the shingles from each first to each last (exclusive)."""
    signs = ((shingles[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64) * 2 - 1
    total = np.zeros((len(shingles) + 1, 64))
    np.cumsum(signs * weights[:, None], axis=0, out=total[1:])
    # rounded, so that equal bags have equal signs whatever came before them
    bits = np.round(total[lasts] - total[firsts], 6) > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _near(value: int, flips: int) -> list[int]:
    return [value ^ sum(1 << b for b in chosen) for n in range(flips + 1) for chosen in combinations(range(BITS), n)]


@dataclass
class Index:
    """A part of the benchmark, ready to look up."""

    keys: np.ndarray  #: sorted shingles of the items
    weights: np.ndarray  #: of each key
    sizes_of_key: list[np.ndarray]  #: numbers of words of the items that have the key
    by_size: dict[int, tuple[list[int], np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]  #: words -> items, fingerprints, block lists
    bags: dict[int, tuple[np.ndarray, np.ndarray, float]]  #: item -> shingles, counts, total weight
    sieve: np.ndarray  #: whether a key has those low bits


def build_index(rows: list, radius: int) -> Index:
    """``rows``: (item_id, n_words, shingles in order, their df)."""
    df: dict[int, int] = {}
    sizes: dict[int, set[int]] = {}
    for _, n, shingles, dfs in rows:
        for s, d in zip(shingles, dfs, strict=True):
            s %= 1 << 64
            df[s] = d
            sizes.setdefault(s, set()).add(n)
    keys = np.array(sorted(df), np.uint64)
    weights = np.array([1 / (1 + np.log(df[int(k)])) for k in keys])
    sieve = np.zeros(1 << 20, bool)
    sieve[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    by_size: dict[int, tuple] = {}
    bags = {}
    groups: dict[int, list] = {}
    for item, n, shingles, _ in rows:
        groups.setdefault(n, []).append((item, np.array([s % (1 << 64) for s in shingles], np.uint64)))
    for n, items in groups.items():
        prints = []
        for item, s in items:
            w = weights[np.searchsorted(keys, s)]
            prints.append(fingerprints(s, w, np.array([0]), np.array([len(s)]))[0])
            u, c = np.unique(s, return_counts=True)
            bags[item] = (u, c, float((weights[np.searchsorted(keys, u)] * c).sum()))
        prints = np.array(prints, np.uint64)
        lists = []
        for b in range(BLOCKS):
            value = (prints >> np.uint64(b * BITS) & np.uint64(255)).astype(np.int64)
            owner = [[] for _ in range(1 << BITS)]
            for i, v in enumerate(value.tolist()):
                for x in _near(v, radius // BLOCKS):
                    owner[x].append(i)
            lists.append((np.concatenate([[0], np.cumsum([len(o) for o in owner])]), np.array([i for o in owner for i in o], np.int64)))
        by_size[n] = ([i for i, _ in items], prints, lists)
    return Index(keys, weights, [np.array(sorted(sizes[int(k)])) for k in keys], by_size, bags, sieve)


def _candidates(index: Index, size: int, prints: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """(window, item number) within the radius, by the block lists."""
    _, theirs, lists = index.by_size[size]
    met = np.zeros((len(prints), len(theirs)), bool) if len(prints) * len(theirs) <= 1 << 24 else None
    pairs = []
    for b, (ends, owners) in enumerate(lists):
        value = (prints >> np.uint64(b * BITS) & np.uint64(255)).astype(np.int64)
        n = ends[value + 1] - ends[value]
        window = np.repeat(np.arange(len(prints)), n)
        item = owners[np.repeat(ends[value] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        if met is not None:
            met[window, item] = True
        else:
            pairs.append(window * len(theirs) + item)
    if met is not None:
        window, item = np.nonzero(met)
    else:
        both = np.unique(np.concatenate(pairs))
        window, item = both // len(theirs), both % len(theirs)
    near = np.bitwise_count(prints[window] ^ theirs[item]) <= radius
    yield from zip(window[near].tolist(), item[near].tolist(), strict=True)


def _similarity(index: Index, shingles: np.ndarray, weights: np.ndarray, item: int) -> float:
    """Weighted Jaccard of two bags."""
    theirs, counts, total = index.bags[item]
    own, first, own_counts = np.unique(shingles, return_index=True, return_counts=True)
    at = np.minimum(np.searchsorted(theirs, own), len(theirs) - 1)
    both = theirs[at] == own
    w = weights[first]
    common = float((w * np.minimum(own_counts, counts[at]))[both].sum())
    return common / (float((w * own_counts).sum()) + total - common)


def _matches(texts: pa.Array, index: Index, radius: int, threshold: float) -> dict[tuple[int, int], tuple[float, int, int]]:
    """The best window of each (row, item): similarity, first byte, end."""
    longest = max(index.by_size, default=0)
    words = Words(texts)
    h, first, rows = words.shingles(SHINGLE)
    maybe = np.flatnonzero(index.sieve[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(index.keys, h[maybe]), len(index.keys) - 1)
    hit = maybe[index.keys[at] == h[maybe]]
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    if not len(hit):
        return best
    key_of = dict(zip(hit.tolist(), at[index.keys[at] == h[maybe]].tolist(), strict=True))
    cuts = np.flatnonzero((np.diff(rows[hit]) != 0) | (np.diff(hit) > longest)) + 1
    for group in np.split(hit, cuts):
        row = int(rows[group[0]])
        lo = max(int(np.searchsorted(rows, row)), int(group[0]) - longest)
        hi = min(int(np.searchsorted(rows, row, "right")), int(group[-1]) + longest + 1)
        here = h[lo:hi]
        weight = np.ones(len(here))
        for g in group.tolist():
            weight[g - lo] = index.weights[key_of[g]]
        known = np.zeros(len(here) + 1, np.int64)
        known[group - lo + 1] = 1
        known = np.cumsum(known)
        row_words = int(words.bounds[row + 1] - words.bounds[row])
        for size in np.unique(np.concatenate([index.sizes_of_key[key_of[g]] for g in group.tolist()])).tolist():
            span = min(max(1, size - SHINGLE + 1), len(here))
            starts = np.arange(len(here) - span + 1)
            starts = starts[known[starts + span] > known[starts]]
            prints = fingerprints(here, weight, starts, starts + span)
            for w, i in _candidates(index, size, prints, radius):
                a = int(starts[w])
                item = index.by_size[size][0][i]
                similarity = _similarity(index, here[a : a + span], weight[a : a + span], item)
                if similarity >= threshold - 1e-9 and similarity > best.get((row, item), (0.0, 0, 0))[0] + 1e-12:
                    a_word = int(first[lo + a])
                    b_word = min(a_word + max(size, span + SHINGLE - 1 if row_words >= SHINGLE else row_words), int(words.bounds[row + 1]))
                    best[row, item] = (similarity, int(words.starts[a_word]), int(words.ends[b_word - 1]))
    return best


def _scan(batches: Iterator[pa.RecordBatch], index: Index, radius: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        best = _matches(part.column("text"), index, radius, threshold)
        if not best:
            continue
        raw, offsets = text_bytes(part.column("text"))
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        ids = part.column("doc_id").to_pylist()
        out = [(ids[row], item, s, int(chars[a] - chars[offsets[row]]), int(chars[b] - chars[offsets[row]])) for (row, item), (s, a, b) in sorted(best.items())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "similarity", "start", "end"])


def _keep(batches: Iterator[pa.RecordBatch], index: Index, radius: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        hit = {row for row, _ in _matches(part.column("text").fill_null(""), index, radius, threshold)}
        yield part.filter(pa.array([i not in hit for i in range(part.num_rows)]))


def _indexes(benchmark: DataFrame, radius: int, part_items: int) -> Iterator[Index]:
    """The benchmark, a bounded part at a time; counts by shingle are over all of it."""
    items = benchmark.where("item_id IS NOT NULL").groupBy("item_id").agg(F.max(text_of()).alias("text"))
    shingles = items.mapInArrow(_item_shingles, "item_id long, n_words int, place int, shingle long")
    df = shingles.groupBy("shingle").agg(F.countDistinct("item_id").alias("df"))
    bags = shingles.join(df, "shingle").groupBy("item_id", "n_words").agg(F.array_sort(F.collect_list(F.struct("place", "shingle", "df"))).alias("s"))
    bags = materialise(bags.select("item_id", "n_words", F.col("s.shingle").alias("shingles"), F.col("s.df").alias("dfs")))
    parts = max(1, -(-items.count() // part_items))
    for i in range(parts):
        rows = bags.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i).collect()  # about part_items items
        if rows:
            yield build_index([tuple(r) for r in rows], radius)


def contaminated(documents: DataFrame, benchmark: DataFrame, *, threshold: float = 0.8, radius: int = 20, part_items: int = 20_000) -> DataFrame:
    """The best window of each (document, item) that are alike.

    ``documents`` (doc_id, text), ``benchmark`` (item_id, text). Returns doc_id, item_id,
    similarity, start, end (code points of the window, end exclusive). A document shorter
    than an item is one window. Items of fewer than five words are one shingle and match
    whole documents of the same words. Null and empty texts match nothing; so do items
    without item_id; repeated rows give repeated rows, null doc_ids too; of a repeated item_id
    the greatest text counts, once. Texts are read whole, however long. Of windows equally
    alike the first counts. Other columns are not read.
    ``part_items`` bounds the part of the benchmark that a task holds.
    """
    docs = documents.select("doc_id", text_of().alias("text"))
    out = documents.sparkSession.createDataFrame([], FOUND)
    for index in _indexes(benchmark, radius, part_items):
        out = out.unionByName(docs.mapInArrow(partial(_scan, index=index, radius=radius, threshold=threshold), FOUND))
    return out


def keep_uncontaminated(documents: DataFrame, benchmark: DataFrame, *, threshold: float = 0.8, radius: int = 20, part_items: int = 20_000) -> DataFrame:
    """``documents`` without those that hold an item; all columns are kept, whatever their names, and no row is shuffled.

    Null and empty texts stay, null doc_ids too; repeated rows stay or go alike.
    """
    kept = documents
    for index in _indexes(benchmark, radius, part_items):
        kept = kept.mapInArrow(partial(_keep, index=index, radius=radius, threshold=threshold), documents.schema)
    return kept
