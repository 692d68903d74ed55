"""Documents whose sets of word 5-grams have a Jaccard similarity of 0.8 or more.

Candidates come from an LSH forest of ``trees`` prefix tries over MinHash signatures. A
trie is the sorted list of its documents' paths, ``depth`` values each, and is cut into
subtrees by the shortest prefix that could ever be needed: the one at which a pair at the
threshold still meets in some tree with the target recall. Only subtrees with several
documents are walked. There prefixes are shortened from the full depth, value by value;
at each length, documents that share a prefix and whose whole signatures are near enough
are linked, if no longer prefix has linked them yet.

The links of all trees say how far prefixes must be shortened: a link of similarity s is
found at length L with probability p = 1 - (1 - s^L)^trees, so each stands for 1 / p of
its kind. The longest L at which links found over links estimated (and one more pair
at the very threshold, so that few links say little) reaches ``recall`` is taken, and
shorter matches are left. Components of the links taken are candidate groups; these are
verified exactly, all pairs in blocks of bounded size inside numpy.

A subtree of more than ``node_docs`` documents is not walked: at each length its
documents are tied to the least one of their prefix, which is a superset of the links.

Documents of equal word sequences form a class and take part once, by the least doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, digests, materialise, mix, slices, text_of
from .components import connected_components

SHINGLE = 5
SIGNED = "doc_id long, high long, low long, n_shingles int, sig binary"
LINK = "a long, b long, level int, similarity double"


def met(similarity: np.ndarray | float, trees: int, length: int) -> np.ndarray | float:
    """The probability that a pair shares a prefix of that length in some tree."""
    return 1 - (1 - similarity**length) ** trees


def shortest_prefix(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix, ``depth`` at most, at which a pair at ``threshold`` meets with ``recall``."""
    while depth > 1 and met(threshold, trees, depth) < recall:
        depth -= 1
    return depth


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
    return base[:n], base[n:] | np.uint64(1)


def signatures(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """(n, sets) MinHash values; ``starts`` are the sets' first shingles, none empty."""
    out = np.empty((n, len(starts)), np.uint64)
    for k, (x, m) in enumerate(zip(*_seeds(n), strict=True)):
        out[k] = np.minimum.reduceat((shingles ^ x) * m, starts)
    return out


def _sign(batches: Iterator[pa.RecordBatch], trees: int, depth: int) -> Iterator[pa.RecordBatch]:
    """A signature's values are kept in 16 bits each, tree after tree."""
    for part in slices(batches):
        words = Words(part.column("text"))
        has = np.flatnonzero(np.diff(words.bounds))
        if not len(has):
            continue
        h, _, rows = words.shingles(SHINGLE)
        starts = np.searchsorted(rows, has)
        sig = (mix(signatures(h, starts, trees * depth)) >> np.uint64(48)).astype(np.uint16).T
        high, low = digests(words.hashes, words.bounds[has], words.bounds[has + 1])
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(part.column("doc_id"))[has]), pa.array(high), pa.array(low), pa.array(np.diff(np.append(starts, len(h))), pa.int32()), pa.array([s.tobytes() for s in sig], pa.binary())], names=["doc_id", "high", "low", "n_shingles", "sig"])


def subtree_links(docs: np.ndarray, paths: np.ndarray, sig: np.ndarray, least: float, shortest: int) -> list[tuple[int, int, int, float]]:
    """(a, b, level, similarity): links of a subtree's documents, from the full depth of its paths to ``shortest``.

    At each level the groups of one prefix are joined by single links: pairs of estimated
    similarity ``least`` or more that are not connected yet.
    """
    order = np.lexsort((docs, *paths.T[::-1]))
    docs, paths, sig = docs[order], paths[order], sig[order]
    label = np.arange(len(docs))
    out: list[tuple[int, int, int, float]] = []
    for level in range(paths.shape[1], shortest - 1, -1):
        cuts = np.flatnonzero((paths[1:, :level] != paths[:-1, :level]).any(1)) + 1
        for group in np.split(np.arange(len(docs)), cuts):
            rest = group
            while len(rest) > 1:
                own = label[rest] == label[rest[0]]
                queue, rest = rest[own].tolist(), rest[~own]
                root = label[queue[0]]
                while queue and len(rest):
                    x = queue.pop()
                    near = (sig[rest] == sig[x]).mean(1)
                    hits = near >= least
                    if not hits.any():
                        continue
                    out += [(int(docs[x]), int(docs[y]), level, float(s)) for y, s in zip(rest[hits].tolist(), near[hits].tolist(), strict=True)]
                    joined = np.isin(label, label[rest[hits]])
                    label[joined] = root
                    queue += rest[label[rest] == root].tolist()
                    rest = rest[label[rest] != root]
    return out


def _walk(batches: Iterator[pa.RecordBatch], trees: int, depth: int, least: float, shortest: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by node; a node is whole in its task and holds a bounded number of documents."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("level", pa.int32()), ("similarity", pa.float64())])
    held: list[pa.RecordBatch] = []

    def close(part: pa.Table) -> Iterator[pa.RecordBatch]:
        node = part.column("node").to_numpy()
        docs = part.column("doc_id").to_numpy()
        tree = part.column("tree").to_numpy()
        sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(len(docs), trees * depth)
        cuts = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]])
        sizes = np.diff(cuts)
        at = np.arange(depth)
        # most nodes are pairs: all of these at once
        i = cuts[:-1][sizes == 2]
        for lo in range(0, len(i), 4096):
            x, y = i[lo : lo + 4096], i[lo : lo + 4096] + 1
            near = (sig[x] == sig[y]).mean(1)
            places = tree[x][:, None] * depth + at
            same = sig[x[:, None], places] == sig[y[:, None], places]
            level = np.where(same.all(1), depth, same.argmin(1))
            ok = (near >= least) & (level >= shortest)
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(docs[x], docs[y])[ok]), pa.array(np.maximum(docs[x], docs[y])[ok]), pa.array(level[ok].astype(np.int32)), pa.array(near[ok])], schema=schema)
        out: list[tuple] = []
        for a, b in zip(cuts[:-1][sizes > 2].tolist(), cuts[1:][sizes > 2].tolist(), strict=True):
            t = int(tree[a]) * depth
            out += [(min(p, q), max(p, q), n, s) for p, q, n, s in subtree_links(docs[a:b], sig[a:b, t : t + depth], sig[a:b], least, shortest)]
        for a in range(0, len(out), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[a : a + 50_000], strict=True), schema, strict=True)], schema=schema)

    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < 20_000:
            continue
        table = pa.Table.from_batches(held)
        node = table.column("node").to_numpy()
        last = int(np.searchsorted(node, node[-1]))  # the last node may go on in the next batch
        if last:
            yield from close(table.slice(0, last))
        held = table.slice(last).to_batches()
        n = table.num_rows - last
    if held:
        yield from close(pa.Table.from_batches(held))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep = ["doc_id", "cluster", "blocks", "size"]
    for part in slices(batches):
        words = Words(part.column("text"))
        h, _, rows = words.shingles(SHINGLE)
        high, low = digests(words.hashes, words.bounds[:-1], words.bounds[1:])
        same = (high == np.asarray(part.column("high"))) & (low == np.asarray(part.column("low")))
        at = np.searchsorted(rows, np.arange(part.num_rows + 1))
        sets = [np.unique(h[a:b]).tobytes() for a, b in zip(at, at[1:], strict=False)]
        out = pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(sets, pa.binary())], names=[*keep, "shingles"])
        yield out.filter(pa.array(same))


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of ``left``, those of ``right`` with that similarity (itself too, if there)."""
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    theirs = np.concatenate([ids[ends[j] - sizes[j] : ends[j]] for j in right])
    at = np.cumsum(sizes[right]) - sizes[right]
    mark = np.zeros(len(values), np.uint8)
    for i in left:
        own = ids[ends[i] - sizes[i] : ends[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[theirs], at, dtype=np.int64)
        mark[own] = 0
        yield i, right[common >= threshold * (sizes[i] + sizes[right] - common) - 1e-9]


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (cluster, low block, high block); each such group is whole in its task."""
    key, held = None, {}

    def close() -> pa.RecordBatch | None:
        docs = sorted(held)
        if len(docs) < 2:
            return None
        sets = [np.frombuffer(held[d][0], np.uint64) for d in docs]
        weight = np.array([held[d][1] for d in docs], np.int64)
        block = np.array([held[d][2] for d in docs])
        everyone = np.arange(len(docs))
        one = key[1] == key[2]
        left, right = (everyone, everyone) if one else (everyone[block == key[1]], everyone[block == key[2]])
        if not len(left) or not len(right):
            return None
        links = np.zeros(len(docs), np.int64)
        root = list(range(len(docs)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, found in _links(sets, left, right, threshold):
            found = found[found != i]
            links[i] += weight[found].sum()
            if not one:
                links[found] += weight[i]
            for j in found:
                a, b = find(int(i)), find(int(j))
                if a != b:
                    root[max(a, b)] = min(a, b)
        linked = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array([docs[i] for i in linked], pa.int64()), pa.array(links[linked]), pa.array([docs[find(int(i))] for i in linked], pa.int64())], names=["doc_id", "links", "root"])

    columns = ("cluster", "first", "second", "doc_id", "shingles", "size", "block")
    for batch in batches:
        for cluster, first, second, doc, shingles, size, block in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if (cluster, first, second) != key:
                if key is not None and (out := close()) is not None and out.num_rows:
                    yield out
                key, held = (cluster, first, second), {}
            held[doc] = (shingles, size, block)
    if key is not None and (out := close()) is not None and out.num_rows:
        yield out


def forest_links(reps: DataFrame, *, threshold: float, trees: int, depth: int, recall: float, node_docs: int, sigmas: float = 6.0) -> tuple[DataFrame, int]:
    """Links of ``reps`` (doc_id, sig) by the forest, and the shortest prefix that their target recall needs.

    A pair at the threshold has an estimated similarity of ``sigmas`` standard deviations
    below it with a chance of some 1e-9; pairs estimated lower are not linked. Pairs of
    large subtrees carry no similarity and don't enter the estimate of recall.
    """
    shortest = shortest_prefix(threshold, trees, depth, recall)
    least = threshold - sigmas * float(np.sqrt(threshold * (1 - threshold) / (trees * depth)))
    node = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.cast("short").alias("tree"), F.xxhash64(t, F.substring("sig", t * (2 * depth) + 1, F.lit(2 * shortest))).alias("node")))
    paths = reps.select("doc_id", F.explode(node).alias("p")).select("doc_id", "p.tree", "p.node")
    # written: a join with a written table can split the rows of a node that many share
    nodes = materialise(paths.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"))
    met_ = materialise(paths.join(nodes, "node"))
    small = met_.where(F.col("n") <= node_docs).select("node", "tree", "doc_id").join(reps, "doc_id")
    walked = small.repartition("node").sortWithinPartitions("node").mapInArrow(partial(_walk, trees=trees, depth=depth, least=least, shortest=shortest), LINK)
    large = materialise(met_.where(F.col("n") > node_docs).select("node", "tree", "doc_id").join(reps, "doc_id").select("doc_id", "node", F.substring("sig", F.col("tree") * (2 * depth) + 1, F.lit(2 * depth)).alias("path")))
    tied = None
    for level in range(depth, shortest - 1, -1):
        prefixed = large.select("doc_id", "node", F.substring("path", 1, 2 * level).alias("prefix"))
        first = materialise(prefixed.groupBy("node", "prefix").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n"))
        one = prefixed.join(first, ["node", "prefix"]).where("doc_id != a").select("a", F.col("doc_id").alias("b"), F.lit(level).alias("level"), F.lit(None).cast("double").alias("similarity"))
        tied = one if tied is None else tied.unionByName(one)
    links = materialise(walked.unionByName(tied).groupBy("a", "b").agg(F.max("level").alias("level"), F.max("similarity").alias("similarity")))
    sums = []
    for level in range(depth, shortest - 1, -1):
        sure = (F.col("level") >= level) & (F.col("similarity") >= threshold)
        p = 1 - F.pow(1 - F.pow(F.col("similarity"), F.lit(float(level))), F.lit(float(trees)))
        sums += [F.sum(F.when(sure, 1.0).otherwise(0.0)).alias(f"found{level}"), F.sum(F.when(sure, 1 / p).otherwise(0.0)).alias(f"all{level}")]
    told = links.agg(*sums).first()
    for level in range(depth, shortest, -1):
        p = float(met(threshold, trees, level))
        if ((told[f"found{level}"] or 0.0) + p) / ((told[f"all{level}"] or 0.0) + 1) >= recall:
            return links.where(F.col("level") >= level), level
    return links, shortest


def similar_documents(documents: DataFrame, *, threshold: float = 0.8, trees: int = 24, depth: int = 8, recall: float = 0.9999, node_docs: int = 1024, block_docs: int = 512, block_shingles: int = 400_000) -> DataFrame:
    """One row a document of ``documents`` (doc_id, text): its class, links and copy.

    Returns doc_id, class_id (least doc_id of its group: documents tied by links, copies
    included), n_links (other documents of ``threshold`` similarity or more), copy_of
    (least doc_id with the same words) and n_copies.
    Texts with fewer than five words are compared by all their words as one shingle.
    Null, empty and wordless texts are alone in their class. Repeated rows of one
    doc_id count once: of different texts one decides, the same in every run. Very long
    texts are read whole; a block holds ``block_shingles`` or one text. A similarity of
    exactly ``threshold`` is a link. Rows without doc_id are left out. Other columns are
    not read. An empty table gives no row.
    """
    docs = documents.select("doc_id", text_of().alias("text")).where("doc_id IS NOT NULL")
    signed = materialise(docs.mapInArrow(partial(_sign, trees=trees, depth=depth), SIGNED))
    once = signed.groupBy("doc_id").agg(F.min(F.struct("high", "low", "n_shingles")).alias("s")).select("doc_id", "s.*")
    classes = materialise(once.groupBy("high", "low").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.max("n_shingles").alias("n_shingles")))
    reps = materialise(signed.join(classes.select(F.col("rep").alias("doc_id"), "high", "low"), ["doc_id", "high", "low"]).select("doc_id", "sig").dropDuplicates(["doc_id"]))
    links, _ = forest_links(reps, threshold=threshold, trees=trees, depth=depth, recall=recall, node_docs=node_docs)
    groups = connected_components(links.select("a", "b")).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    members = groups.join(classes, "rep")
    blocks = F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n_shingles") / block_shingles), F.lit(1)).cast("int")
    sizes = materialise(members.groupBy("cluster").agg(blocks.alias("blocks")))
    members = materialise(members.join(sizes, "cluster").select(F.col("rep").alias("doc_id"), "high", "low", "size", "cluster", "blocks"))
    # dealt by doc_id at any size: members grow with the table, so no plan may count on sending them all about
    sets = docs.join(members.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "high", "low", "size", "cluster", "blocks").mapInArrow(_sets, "doc_id long, cluster long, blocks int, size long, shingles binary")
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    dealt = sets.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "doc_id", "shingles", "size", "block")
    at = ["cluster", "first", "second"]
    checked = dealt.repartition(*at).sortWithinPartitions(*at)
    found = materialise(checked.mapInArrow(partial(_verify, threshold=threshold), "doc_id long, links long, root long"))
    linked = found.groupBy("doc_id").agg(F.sum("links").alias("links")).withColumnRenamed("doc_id", "rep")
    final = connected_components(found.select(F.col("doc_id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), "component")
    known = classes.join(linked, "rep", "left").join(final, "rep", "left").select("high", "low", "size", "rep", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    worded = once.join(known, ["high", "low"]).select("doc_id", "class_id", "n_links", F.col("rep").alias("copy_of"), F.col("size").alias("n_copies"))
    wordless = docs.select("doc_id").distinct().join(once.select("doc_id"), "doc_id", "left_anti")
    return worded.unionByName(wordless.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("copy_of"), F.lit(1).cast("long").alias("n_copies")))


def keep_one(documents: DataFrame, **how) -> DataFrame:
    """``documents`` with the least doc_id of each class; rows without doc_id stay. All columns are kept."""
    later = similar_documents(documents, **how).where("class_id != doc_id").select("doc_id")
    return documents.join(later.hint("shuffle_hash"), "doc_id", "left_anti").select(*documents.columns)
