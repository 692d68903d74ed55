"""Collocations: phrases counted exactly in depth-limited tries, merged by prefix range.

A shard is a few MB of one language's texts. Its trie is built level by level: a level's
nodes are sorted by their path, each with its parent's number, its word and its count.
Tries are written to the shared folder, cut at range bounds taken from the tries' own
keys, and each range's slices are merged, level by level, as sorted runs. A phrase has one
node a shard at most, so no phrase is frequent enough to fill a range by itself.

Two passes keep the tries small without losing a phrase. The first counts words and word
pairs. All parts of a frequent phrase are frequent, so the second counts longer phrases
only along chains of frequent pairs. These are told to the tasks by a Bloom filter of
bounded size: it never misses a pair, and what it lets through is counted exactly.

The frequent phrases are the merged trie. Left parts of a phrase are met on the walk from
the root to it, right parts on its suffix links; both are taken level by level.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _PRIME, materialise, mix, powers, slices, small_batches, text_bytes

#: Bytes that part pieces, and bytes that part words.
PIECE_END = np.zeros(256, bool)
PIECE_END[list(b".,;:!?\n\x0b\x0c\r")] = True
GAP = PIECE_END.copy()
GAP[list(b" \t")] = True

TRIE = "words binary, ends binary, parents array<binary>, labels array<binary>, counts array<binary>"
#: Nodes between two keys that are offered as range bounds.
KEY_NODES = 2048


@dataclass
class Trie:
    """Words in byte order; of each level, sorted by path: parent's number, word's number, count."""

    words: pa.Array
    parents: list[np.ndarray]
    labels: list[np.ndarray]
    counts: list[np.ndarray]

    @property
    def nodes(self) -> int:
        return sum(map(len, self.labels))

    def path(self, level: int, node: int) -> list[bytes]:
        out = []
        for d in range(level, -1, -1):
            out.append(self.words[int(self.labels[d][node])].as_py())
            node = int(self.parents[d][node])
        return out[::-1]


def tokens(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of a text's bytes: number of each word in the sorted dictionary, where it starts, the dictionary, words left in its piece."""
    low = raw.copy()
    low[(low >= 65) & (low <= 90)] += 32
    inside = ~GAP[low]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.int64), starts, pa.array([], pa.binary()), starts
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    coded = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low[inside])]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    broken = np.cumsum(PIECE_END[low], dtype=np.int32)
    first = np.flatnonzero(np.concatenate([[True], broken[starts[1:]] != broken[ends[:-1] - 1]]))
    last = np.concatenate([first[1:], [len(starts)]])
    room = np.repeat(last, last - first) - np.arange(len(starts))
    return rank[coded.indices.to_numpy()], starts, coded.dictionary.take(pa.array(order)), room


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of runs of sorted keys: distinct keys in order, each key's place among them, the order that sorts (a merge of the runs), first of each."""
    order = np.argsort(keys, kind="stable")
    by = keys[order]
    new = np.concatenate([[True], by[1:] != by[:-1]]) if len(by) else np.zeros(0, bool)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return by[first], place, order, first


def build(words: np.ndarray, dictionary: pa.Array, room: np.ndarray, at: np.ndarray, low: int, high: int) -> Trie:
    """The trie of phrases of ``low`` to ``high`` words from the places ``at``; shorter prefixes have count 0."""
    at = at[room[at] >= low]
    seen = np.bincount(words[at], minlength=len(dictionary))
    label = np.flatnonzero(seen)
    place = (np.cumsum(seen > 0) - 1)[words[at]]
    trie = Trie(dictionary, [np.zeros(len(label), np.int64)], [label], [seen[label] if low == 1 else np.zeros(len(label), np.int64)])
    for d in range(2, high + 1):
        keep = room[at] >= d
        at, place = at[keep], place[keep]
        found, place, _, first = _groups(place << 32 | words[at + d - 1])
        trie.parents.append(found >> 32)
        trie.labels.append(found & 0xFFFFFFFF)
        trie.counts.append(np.diff(np.append(first, len(place))) if d >= low else np.zeros(len(found), np.int64))
    return trie


def merge(tries: list[Trie]) -> Trie:
    """The sum of tries: each level is a merge of their sorted runs."""
    whole = pa.concat_arrays([t.words for t in tries]).dictionary_encode()
    order = pc.sort_indices(whole.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = np.split(rank[whole.indices.to_numpy()], np.cumsum([len(t.words) for t in tries])[:-1])
    out = Trie(whole.dictionary.take(pa.array(order)), [], [], [])
    places = [np.zeros(1, np.int64)] * len(tries)
    for d in range(len(tries[0].labels)):
        keys = np.concatenate([p[t.parents[d]] << 32 | c[t.labels[d]] for t, p, c in zip(tries, places, codes, strict=True)])
        found, place, order, first = _groups(keys)
        counts = np.concatenate([t.counts[d] for t in tries])[order]
        out.parents.append(found >> 32)
        out.labels.append(found & 0xFFFFFFFF)
        out.counts.append(np.add.reduceat(counts, first) if len(first) else counts)
        places = np.split(place, np.cumsum([len(t.labels[d]) for t in tries])[:-1])
    return out


def before(trie: Trie, bound: tuple[bytes, ...]) -> list[int]:
    """At each level, the number of nodes whose path is less than ``bound``."""
    out: list[int] = []
    same, at = True, 0
    for d in range(len(trie.labels)):
        if d >= len(bound):
            at = int(np.searchsorted(trie.parents[d], at))
        else:
            lo, hi = np.searchsorted(trie.parents[d], [at, at + 1 if same else at])
            same = False if hi == lo else same
            word = bisect_left(trie.words, bound[d], key=lambda w: w.as_py())
            at = int(lo + np.searchsorted(trie.labels[d][lo:hi], word))
            same = same and at < hi and word < len(trie.words) and trie.labels[d][at] == word and trie.words[word].as_py() == bound[d]
        out.append(at + (1 if same and d < len(bound) - 1 else 0))
    return out


def cut(trie: Trie, lo: list[int], hi: list[int]) -> Trie:
    """Nodes from ``lo`` to ``hi`` of each level; ancestors that other ranges own come along with count 0."""
    spans: list[tuple[int, int]] = []
    need: tuple[int, int] | None = None
    for d in reversed(range(len(lo))):
        start, end = (lo[d], hi[d]) if need is None else (min(lo[d], need[0]), max(hi[d], need[1]))
        spans.append((start, end))
        need = (int(trie.parents[d][start]), int(trie.parents[d][end - 1]) + 1) if end > start else None
    spans.reverse()
    parents, counts = [], []
    for d, (start, end) in enumerate(spans):
        parents.append(trie.parents[d][start:end] - (spans[d - 1][0] if d else 0))
        own = np.arange(start, end)
        counts.append(np.where((own >= lo[d]) & (own < hi[d]), trie.counts[d][start:end], 0))
    return Trie(trie.words, parents, [trie.labels[d][a:b] for d, (a, b) in enumerate(spans)], counts)


def pack(trie: Trie) -> tuple[bytes, bytes, list[bytes], list[bytes], list[bytes]]:
    """Columns of a row: only words that are used; parents as steps, which are mostly 0 or 1."""
    used = np.unique(np.concatenate(trie.labels))
    raw, ends = text_bytes(trie.words.take(pa.array(used)))
    parents = [np.diff(p, prepend=0).astype("<i4").tobytes() for p in trie.parents]
    labels = [np.searchsorted(used, x).astype("<i4").tobytes() for x in trie.labels]
    return raw.tobytes(), ends.astype("<i4").tobytes(), parents, labels, [c.astype("<i8").tobytes() for c in trie.counts]


def unpack(row: dict) -> Trie:
    words = pa.BinaryArray.from_buffers(pa.binary(), len(row["ends"]) // 4 - 1, [None, pa.py_buffer(row["ends"]), pa.py_buffer(row["words"])])
    ints = lambda raws, t: [np.frombuffer(r, t).astype(np.int64) for r in raws]
    return Trie(words, [np.cumsum(x) for x in ints(row["parents"], "<i4")], ints(row["labels"], "<i4"), ints(row["counts"], "<i8"))


_LIST = pa.list_(pa.binary())
_PACKED = [pa.binary(), pa.binary(), _LIST, _LIST, _LIST]
_COLUMNS = ["words", "ends", "parents", "labels", "counts"]


def _row(values: tuple, types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


# --- counting ---------------------------------------------------------------------------


def word_hashes(words: pa.Array) -> np.ndarray:
    raw, offsets = text_bytes(words)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(len(raw)), out=total[1:])
    inverse = powers(len(raw) + 1, pow(_PRIME, -1, 1 << 64))
    return mix((total[offsets[1:]] - total[offsets[:-1]]) * inverse[offsets[:-1]] + np.diff(offsets).astype(np.uint64))


def pair_bits(lang: str, left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """Two places in the filter of each word pair of a language, from its words' hashes."""
    h = mix(left * np.uint64(0x9FB21C651E98DF25) + mix(right) + word_hashes(pa.array([lang.encode()], pa.binary())))
    return np.stack([h & np.uint64((1 << bits) - 1), h >> np.uint64(64 - bits)]).astype(np.int64)


@dataclass
class Pairs:
    """A Bloom filter of word pairs: 2**bits bits."""

    bits: int
    table: np.ndarray

    def may_hold(self, lang: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at = pair_bits(lang, left, right, self.bits)
        return (self.table[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(0)


def windows(raw: np.ndarray, limit: int, ahead: int) -> Iterator[tuple[np.ndarray, int]]:
    """A text in parts of about ``limit`` bytes that end between words: (bytes, how many are its own).

    After its own bytes come ``ahead`` words of the next part, for phrases that reach into it.
    """
    at, n = 0, len(raw)
    while at < n:
        end, step = min(n, at + limit), 4096
        while end < n and not GAP[raw[end]]:
            gap = np.flatnonzero(GAP[raw[end : end + step]])
            end, step = (end + int(gap[0]) if len(gap) else min(n, end + step)), step * 2
        more, step = end, 256
        while more < n and ahead:
            more = min(n, end + step)
            inside = ~GAP[raw[end:more]]
            stops = np.flatnonzero(inside[:-1] & ~inside[1:])
            if len(stops) >= ahead:
                more = end + int(stops[ahead - 1]) + 1
                break
            step *= 2
        yield raw[at:more], end - at
        at = end


def shard_trie(lang: str, parts: list[tuple[np.ndarray, int]], low: int, high: int, pairs: Pairs | None) -> tuple[Trie, int]:
    """The trie of some texts' own places, and how many words they have."""
    newline = np.array([10], np.uint8)
    words, starts, dictionary, room = tokens(np.concatenate([x for raw, _ in parts for x in (raw, newline)]))
    begin = np.concatenate([[0], np.cumsum([len(raw) + 1 for raw, _ in parts])])[:-1]
    part = np.searchsorted(begin, starts, "right") - 1
    mine = np.flatnonzero(starts - begin[part] < np.array([own for _, own in parts])[part])
    if pairs is not None and len(words):
        hashes = word_hashes(dictionary)[words]
        linked = np.zeros(len(words), bool)
        at = np.flatnonzero(room > 1)
        linked[at] = pairs.may_hold(lang, hashes[at], hashes[at + 1])
        last = np.flatnonzero(~linked)
        room = last[np.searchsorted(last, np.arange(len(words)))] - np.arange(len(words)) + 1
    return build(words, dictionary, np.minimum(room, high), mine, low, high), len(mine)


def _tries(batches: Iterator[pa.RecordBatch], low: int, high: int, pairs: Pairs | None, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, int]]] = {}
    size: dict[str, int] = {}

    def flush(lang: str) -> pa.RecordBatch:
        trie, n = shard_trie(lang, held.pop(lang), low, high, pairs)
        del size[lang]
        keys = [b" ".join(trie.path(high - 1, i)) for i in range(0, len(trie.labels[-1]), KEY_NODES)]
        return _row((lang, n, trie.nodes, keys, *pack(trie)), [pa.string(), pa.int64(), pa.int64(), _LIST, *_PACKED], ["lang", "n", "nodes", "keys", *_COLUMNS])

    for part in slices(batches, min(1 << 20, shard_bytes)):
        raw, offsets = text_bytes(part.column("text"))
        for lang, a, b in zip(part.column("lang").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            for piece in windows(raw[a:b], shard_bytes, high - 1):
                held.setdefault(lang, []).append(piece)
                size[lang] = size.get(lang, 0) + len(piece[0])
                if size[lang] >= shard_bytes:
                    yield flush(lang)
        while sum(size.values()) > 3 * shard_bytes:
            yield flush(max(size, key=size.__getitem__))
    for lang in list(held):
        yield flush(lang)


def _cuts(batches: Iterator[pa.RecordBatch], bounds: list[tuple[str, tuple[bytes, ...]]]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        trie, lang = unpack(row), row["lang"]
        first = bisect_left(bounds, (lang, ()))
        mine = [path for at, path in bounds[first:] if at == lang]
        edges = [[0] * len(trie.labels), *(before(trie, path) for path in mine), [len(x) for x in trie.labels]]
        for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            if lo != hi:
                yield _row((first + k, lang, *pack(cut(trie, lo, hi))), [pa.int32(), pa.string(), *_PACKED], ["range", "lang", *_COLUMNS])


def _frequent(lang: str, tries: list[Trie], least: int) -> Iterator[pa.RecordBatch]:
    trie = merge(tries)
    for d, count in enumerate(trie.counts):
        keep = np.flatnonzero(count >= least)
        for a in range(0, len(keep), 8192):
            some = keep[a : a + 8192]
            paths = [b" ".join(trie.path(d, i)).decode() for i in some.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(paths, pa.string()), pa.array([d + 1] * len(some), pa.int32()), pa.array(count[some])], names=["lang", "phrase", "m", "a"])


def _merged(batches: Iterator[pa.RecordBatch], least: int, hold: int) -> Iterator[pa.RecordBatch]:
    """Slices come sorted by range and language; at most ``hold`` nodes wait beside what is merged already."""
    key: tuple[int, str] | None = None
    waiting: list[Trie] = []
    nodes = 0
    for row in _rows(batches):
        if (row["range"], row["lang"]) != key:
            if waiting:
                yield from _frequent(key[1], waiting, least)
            key, waiting, nodes = (row["range"], row["lang"]), [], 0
        waiting.append(unpack(row))
        nodes += waiting[-1].nodes
        if nodes > hold and len(waiting) > 1:
            waiting, nodes = [merge(waiting)], 0
    if waiting:
        yield from _frequent(key[1], waiting, least)


def shard_tries(texts: DataFrame, low: int, high: int, pairs: Pairs | None = None, shard_bytes: int = 8 << 20) -> DataFrame:
    """Tries of shards of ``texts`` (lang, text), in the shared folder: lang, words of the shard (n), nodes, some keys, the trie.

    A task's tries are as many as its input has shards, and each may have twice a shard's bytes: row groups hold two or so.
    """
    tries = texts.mapInArrow(partial(_tries, low=low, high=high, pairs=pairs, shard_bytes=shard_bytes), f"lang string, n long, nodes long, keys array<binary>, {TRIE}")
    return materialise(tries, group_bytes=2 * shard_bytes)


def merge_ranges(tries: DataFrame, least: int, *, range_nodes: int = 1_000_000, sample_keys: int = 50_000) -> DataFrame:
    """Phrases of ``least`` occurrences or more: lang, phrase, m (words), a (occurrences).

    Bounds of ranges come from a bounded sample of the tries' keys; they balance tasks and decide nothing.
    """
    parts = max(1, int(tries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = tries.agg(F.sum("nodes").alias("n")).collect()[0]["n"] or 0
    ranges = max(1, -(-total // range_nodes), min(2 * parts, total // 20_000))
    keys = tries.select("lang", F.explode("keys").alias("key"))
    found = keys.orderBy(F.xxhash64("lang", "key")).limit(sample_keys).collect() if ranges > 1 else []
    known = sorted((r["lang"], tuple(bytes(r["key"]).split(b" "))) for r in found)
    bounds = sorted({known[i * len(known) // ranges] for i in range(1, ranges)}) if known else []
    cut_up = tries.select("lang", *_COLUMNS).mapInArrow(partial(_cuts, bounds=bounds), f"range int, lang string, {TRIE}")
    dealt = cut_up.repartition(min(parts, len(bounds) + 1), "range").sortWithinPartitions("range", "lang")
    return dealt.mapInArrow(partial(_merged, least=least, hold=range_nodes), "lang string, phrase string, m int, a long")


def _bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        halves = pc.split_pattern(batch.column("phrase").cast(pa.binary()), b" ")
        left, right = (word_hashes(pc.list_element(halves, i)) for i in (0, 1))
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in set(langs.tolist()):
            mine = langs == lang
            at = pair_bits(lang, left[mine], right[mine], bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "value"])


def pair_filter(frequent: DataFrame, most_bits: int = 27) -> Pairs:
    """A filter of the word pairs of ``frequent``: 16 bits a pair, but 2**most_bits (16 MB) at most."""
    two = frequent.where("m = 2").select("lang", "phrase")
    bits = min(most_bits, max(16, (16 * two.count()).bit_length()))
    told = two.mapInArrow(partial(_bits, bits=bits), "word int, value long").groupBy("word").agg(F.expr("bit_or(value)").alias("value")).toArrow()
    table = np.zeros((1 << bits) // 64, "<i8")
    table[told.column("word").to_numpy()] = told.column("value").to_numpy()
    return Pairs(bits, table.view(np.uint8))


def frequent_phrases(documents: DataFrame, *, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, m, a) of the phrases of 1 to ``longest`` words with ``least`` occurrences or more, and (lang, n) of all words."""
    small_batches(documents.sparkSession)
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text != ''")
    short = shard_tries(texts, 1, min(2, longest))
    frequent = materialise(merge_ranges(short, least))
    if longest > 2:
        long = shard_tries(texts, 3, longest, pair_filter(frequent))
        frequent = frequent.unionByName(materialise(merge_ranges(long, least)))
    return frequent, short.groupBy("lang").agg(F.sum("n").alias("n"))


# --- scoring ----------------------------------------------------------------------------


def part_counts(frequent: DataFrame, longest: int) -> DataFrame:
    """Each phrase with the occurrences of its prefixes (``pre``) and suffixes (``suf``) of 1, 2, ... words.

    A phrase has its parent's prefixes and itself, and its suffix link's suffixes and
    itself; the link is the phrase without its first word.
    """
    level = frequent.where("m = 1").select("lang", "phrase", "m", "a", F.array("a").alias("pre"), F.array("a").alias("suf"))
    out = level
    for m in range(2, longest + 1):
        nodes = frequent.where(F.col("m") == m).withColumn("parent", F.substring_index("phrase", " ", m - 1)).withColumn("link", F.substring_index("phrase", " ", 1 - m))
        walk = level.select("lang", F.col("phrase").alias("parent"), "pre")
        links = level.select("lang", F.col("phrase").alias("link"), "suf")
        met = nodes.join(walk, ["lang", "parent"]).join(links, ["lang", "link"])
        level = materialise(met.select("lang", "phrase", "m", "a", F.concat("pre", F.array("a")).alias("pre"), F.concat("suf", F.array("a")).alias("suf")))
        out = out.unionByName(level)
    return out


def scored_phrases(frequent: DataFrame, words: DataFrame, longest: int) -> DataFrame:
    """lang, phrase, m, a, l, r, n, score of the lowest-scoring cut (ties: after fewer words); products are decimals of 38 digits."""
    wide = "cast({} as decimal(19,0))".format
    left, right = "element_at(pre, k)", "element_at(suf, m - k)"
    score = f"({wide('1000 * a')} * {wide('n')}) div ({wide(left)} * {wide(right)})"
    lowest = F.expr(f"array_min(transform(sequence(1, m - 1), k -> named_struct('score', {score}, 'k', k, 'l', {left}, 'r', {right})))")
    nodes = part_counts(frequent, longest).where("m > 1").join(words, "lang")
    return nodes.withColumn("cut", lowest).select("lang", "phrase", "m", "a", "cut.l", "cut.r", "n", "cut.score")


def uncovered(scored: DataFrame, percent: int = 100) -> DataFrame:
    """Without phrases inside a longer one of ``scored`` with ``percent`` % of their occurrences or more."""
    inner = "flatten(transform(sequence(2, m - 1), s -> transform(sequence(1, m - s + 1), i -> array_join(slice(w, i, s), ' '))))"
    parts = scored.where("m > 2").select("lang", "a", F.split("phrase", " ").alias("w"), "m").select("lang", F.expr(f"explode({inner})").alias("phrase"), F.col("a").alias("longer"))
    most = parts.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(most, ["lang", "phrase"], "left")
    return kept.where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent)).drop("longer")


def first_of_each(scored: DataFrame, top: int) -> DataFrame:
    """Rank of each language's first ``top`` phrases: of many small groups first, then of their best."""
    parts = max(1, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "group").orderBy(*order))).where(F.col("rank") <= top)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("group")


def collocations(documents: DataFrame, *, least: int = 100, longest: int = 5, percent: int = 100, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of each language of ``documents`` (lang, text) by score.

    A phrase of 2 to ``longest`` words with ``least`` occurrences scores floor(1000 a n / (l r))
    at its lowest cut. Null lang: ``und``; null and empty texts have no words; very long
    texts are taken whole, in parts with the words that reach over; repeated rows count
    each; ties go by occurrences, then by the phrase's bytes. An empty table gives no
    row. Other columns, of whatever name, are not read.
    Returns lang, rank, phrase, a, l, r, n, score.
    """
    frequent, words = frequent_phrases(documents, least=least, longest=longest)
    scored = materialise(scored_phrases(frequent, words, longest))
    return first_of_each(uncovered(scored, percent), top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
