"""Nearest vectors by cosine: additive quantisation, lookup tables, exact reranking.

A unit vector is the sum of one word of each codebook; all codebooks are of full
dimension and fitted to what the ones before leave over. Encoding keeps a beam of the
best partial sums. The first codebook's word (of large tables, the words of the first few)
is also the vector's list: a query visits the lists nearest to it, until these hold
enough vectors. There a vector's
distance is its stored norm less looked-up products of its words with the query. Of all
that a query meets, in whatever lists, the best by these estimates are reranked by the
exact cosine in double precision: a fixed number a query, at any size of the table.

Equal vectors are indexed once with their smallest ids, as many as an answer can hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


#: Estimated distances that differ by no more count as tied: single precision tells no more.
TIED = 1e-5


@dataclass
class Codebooks:
    """Words of all codebooks in one matrix; ``starts`` has each codebook's first row (one more than codebooks)."""

    words: np.ndarray
    starts: np.ndarray
    products: np.ndarray  #: words @ words.T


def _assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - 0.5 * (c * c).sum(1), 1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    if len(c) < k:
        c = np.concatenate([c, np.zeros((k - len(c), x.shape[1]), x.dtype)])
    for _ in range(rounds):
        own = _assign(x, c)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def fit(sample: np.ndarray, lists: int, *, books: int = 24, words: int = 64, rounds: int = 1, seed: int = 3) -> Codebooks:
    """Codebooks of unit vectors: k-means of residuals, then least squares on beam-searched codes."""
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float32)
    words = min(words, max(2, len(x) // 4))
    sizes = [min(lists, max(1, len(x)))] + [words] * (books - 1)
    rest, parts = x.copy(), []
    for size in sizes:
        c = _kmeans(rest, size, rng)
        rest -= c[_assign(rest, c)]
        parts.append(c)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    book = _book(np.concatenate(parts), starts)
    for _ in range(rounds):
        codes, _ = encode(book, x)
        gram, right = np.zeros((starts[-1], starts[-1]), np.float64), np.zeros((starts[-1], x.shape[1]))
        for a in range(0, len(x), 2048):
            some = codes[a : a + 2048]
            hot = np.zeros((len(some), starts[-1]), np.float32)
            hot[np.arange(len(some))[:, None], some] = 1
            gram += hot.T @ hot
            right += hot.T @ x[a : a + 2048]
        # ridged towards the words that are there, so that seldom used words stay
        gram[np.arange(starts[-1]), np.arange(starts[-1])] += 1.0
        book = _book(np.linalg.solve(gram, right + book.words).astype(np.float32), starts)
    return book


def _book(words: np.ndarray, starts: np.ndarray) -> Codebooks:
    words = words.astype(np.float32)
    return Codebooks(words, starts, words @ words.T)


def encode(book: Codebooks, x: np.ndarray, beam: int = 8, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``words`` for each codebook, squared norm of their sum) of each vector, by beam search."""
    books = len(book.starts) - 1
    codes = np.empty((len(x), books), np.int32)
    norms = np.empty(len(x), np.float32)
    own = np.diag(book.products)
    for a in range(0, len(x), batch):
        part = x[a : a + batch].astype(np.float32)
        dots = part @ book.words.T
        n = len(part)
        kept = np.zeros((n, 1, 0), np.int32)
        cost = np.zeros((n, 1), np.float32)
        for m in range(books):
            lo, hi = int(book.starts[m]), int(book.starts[m + 1])
            step = np.broadcast_to((own[lo:hi] - 2 * dots[:, lo:hi])[:, None, :], (n, kept.shape[1], hi - lo)).copy()
            for j in range(m):
                step += 2 * book.products[kept[:, :, j], lo:hi]
            total = (cost[:, :, None] + step).reshape(n, -1)
            take = min(beam, total.shape[1])
            best = np.argpartition(total, take - 1, axis=1)[:, :take]
            from_, word = best // (hi - lo), best % (hi - lo) + lo
            rows = np.arange(n)[:, None]
            kept = np.concatenate([kept[rows, from_], word[:, :, None].astype(np.int32)], 2)
            cost = total[rows, best]
        win = cost.argmin(1)
        codes[a : a + n] = kept[np.arange(n), win]
        norms[a : a + n] = cost[np.arange(n), win] + 2 * dots[np.arange(n)[:, None], codes[a : a + n]].sum(1)
    return codes, norms


def list_count(book: Codebooks, deep: int) -> int:
    """Lists are the words of the first ``deep`` codebooks, one of each."""
    return int(np.prod(np.diff(book.starts)[:deep]))


def list_of(book: Codebooks, codes: np.ndarray, deep: int) -> np.ndarray:
    out = np.zeros(len(codes), np.int64)
    for m in range(deep):
        out = out * int(book.starts[m + 1] - book.starts[m]) + codes[:, m] - book.starts[m]
    return out


def list_order(book: Codebooks, unit: np.ndarray, deep: int = 1) -> np.ndarray:
    """The lists in the order in which each unit vector visits them: by the sums of their words."""
    centre = np.zeros((1, book.words.shape[1]))
    for m in range(deep):
        words = book.words[int(book.starts[m]) : int(book.starts[m + 1])].astype(np.float64)
        centre = (centre[:, None, :] + words[None]).reshape(-1, words.shape[1])
    return np.argsort((centre * centre).sum(1) - 2 * unit @ centre.T, axis=1, kind="stable")


def lists_to_visit(book: Codebooks, unit: np.ndarray, lists: np.ndarray, k: int, recall: float, deep: int = 1, tries: int = 256) -> int:
    """How many lists hold ``recall`` of the true ``k`` nearest in the sample, found by brute force for ``tries`` of it."""
    asked = unit[:tries]
    near = asked @ unit.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    take = min(k, len(unit) - 1)
    if take < 1:
        return 1
    top = np.argpartition(-near, take - 1, axis=1)[:, :take]
    order = list_order(book, asked, deep)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
    found = np.sort(place[np.arange(len(asked))[:, None], lists[top]].reshape(-1))
    return int(found[min(len(found) - 1, int(np.ceil(recall * len(found))) - 1)]) + 1


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


def _packed(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in _matrix(batch.column("embedding"), dim)], pa.binary())], names=["query_id", "asked"])


_ROW = pa.schema([("list", pa.int32()), ("id", pa.int64()), ("ids", pa.list_(pa.int64())), ("vector", pa.binary()), ("codes", pa.binary()), ("norm", pa.float32())])


def _index(batches: Iterator[pa.RecordBatch], book: Codebooks, dim: int, deep: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column("embedding"), dim)
        codes, norms = encode(book, x / np.linalg.norm(x, axis=1, keepdims=True))
        yield pa.RecordBatch.from_arrays([pa.array(list_of(book, codes, deep).astype(np.int32)), pa.nulls(len(x), pa.int64()), batch.column("ids"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(norms)], schema=_ROW)


def _route(batches: Iterator[pa.RecordBatch], book: Codebooks, dim: int, deep: int, sizes: np.ndarray, probes: int, least: int) -> Iterator[pa.RecordBatch]:
    """Each query once for each list it visits: ``probes`` lists, and more until they hold ``least`` vectors."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column("embedding"), dim)
        order = [o[sizes[o] > 0] for a in range(0, len(x), 64) for o in list_order(book, x[a : a + 64] / np.linalg.norm(x[a : a + 64], axis=1, keepdims=True), deep)]
        stops = [max(probes, int(np.searchsorted(np.cumsum(sizes[o]), least)) + 1) for o in order]
        rows = np.repeat(np.arange(len(x)), [min(s, len(o)) for s, o in zip(stops, order, strict=True)])
        lists = np.concatenate([o[:s] for s, o in zip(stops, order, strict=True)])
        ids = np.asarray(batch.column("vec_id"))
        raw = [r.tobytes() for r in x]
        n = len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(ids[rows]), pa.nulls(n, _ROW.field("ids").type), pa.array([raw[i] for i in rows], pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.float32())], schema=_ROW)


def _scan(batches: Iterator[pa.RecordBatch], book: Codebooks, rerank: int, together: int = 256) -> Iterator[pa.RecordBatch]:
    """(query_id, row, far): the ``rerank`` rows of each block that look nearest by codes alone, and those tied with the last.

    Rows come sorted by (list, block), vectors before queries; a block's vectors are bounded.
    """
    now, rows, codes, norms, asked = None, [], [], [], []

    def answer() -> pa.RecordBatch | None:
        if not asked or not rows:
            asked.clear()
            return None
        row = np.array(rows, np.int64)
        code = np.frombuffer(b"".join(codes), np.int32).reshape(len(rows), -1)
        q = np.frombuffer(b"".join(v for _, v in asked), np.float64).reshape(len(asked), -1)
        table = (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32) @ book.words.T
        far = np.broadcast_to(np.array(norms, np.float32), (len(q), len(rows))).copy()
        for m in range(code.shape[1]):
            far -= 2 * table[:, code[:, m]]
        take = min(rerank, len(rows))
        near, which = np.nonzero(far <= np.partition(far, take - 1, axis=1)[:, take - 1 : take] + TIED)
        ids = np.array([i for i, _ in asked], np.int64)
        asked.clear()
        return pa.RecordBatch.from_arrays([pa.array(ids[near]), pa.array(row[which]), pa.array(far[near, which])], names=["query_id", "row", "far"])

    for batch in batches:
        for list_, block, id_, own, vector, code, norm in zip(*(batch.column(c).to_pylist() for c in ("list", "block", "id", "ids", "vector", "codes", "norm")), strict=True):
            if (list_, block) != now:
                if (out := answer()) is not None:
                    yield out
                now = (list_, block)
                rows.clear(), codes.clear(), norms.clear()
            if own is not None:
                rows.append(own[0]), codes.append(code), norms.append(norm)
                continue
            asked.append((id_, vector))
            if len(asked) >= together and (out := answer()) is not None:
                yield out
    if (out := answer()) is not None:
        yield out


def _exact(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Candidates (query_id, asked, ids, vector) with their cosine, one row for each id but the query's own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        q, x = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float64).reshape(-1, dim) for c in ("asked", "vector"))
        score = (q * x).sum(1) / (np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1))
        of = np.asarray(pc.list_parent_indices(batch.column("ids")))
        found, query = np.asarray(batch.column("ids").flatten()), np.asarray(batch.column("query_id"))[of]
        other = found != query
        yield pa.RecordBatch.from_arrays([pa.array(query[other]), pa.array(found[other]), pa.array(score[of][other])], names=["query_id", "vec_id", "score"])


def candidates(scanned: DataFrame, rerank: int) -> DataFrame:
    """Of all blocks' rows the ``rerank`` that look nearest to each query, and those tied with the last."""
    mine = Window.partitionBy("query_id")
    placed = scanned.withColumn("n", F.row_number().over(mine.orderBy("far"))).withColumn("edge", F.max(F.when(F.col("n") <= rerank, F.col("far"))).over(mine))
    return placed.where(F.col("far") <= F.col("edge") + F.lit(TIED)).select("query_id", "row")


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding) of vectors that can be compared: of the commonest dimension, finite and not zero.

    A vec_id stands for one vector: of several the least counts, element by element.
    """
    v = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    fine = v.where("vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x != 0)")
    dim = fine.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    fine = fine.where(F.size("embedding") == (dim["dim"] if dim else 0))
    n, distinct = fine.agg(F.count("*"), F.count_distinct("vec_id")).first()
    return fine if n == distinct else fine.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def nearest(embeddings: DataFrame, queries: DataFrame, *, k: int = 5, sample_rows: int = 16_384, recall: float = 0.985, least: int = 50, rerank: int = 192, block: int = 4096, lists: int | None = None) -> DataFrame:
    """The ``k`` nearest rows of ``embeddings`` for each of ``queries`` (both vec_id, embedding), but itself.

    Codebooks are fitted to at most ``sample_rows`` vectors, those of the smallest hashes
    of vec_id; every row is indexed. The number of lists is about the root of the rows, at
    any size: the first codebook has a word for each as far as the sample can fit them (a
    sixteenth of it), beyond that a list is a word of the first and one of the next
    codebooks. A query visits so many that, in the sample, they hold ``recall`` of its true
    nearest, and always ``least`` distinct vectors. Then ``rerank`` distinct vectors a query,
    the best of all lists by their codes, are scored exactly. A block holds about ``block``
    vectors of a list, however long the list. Vectors null, zero, of another dimension than most, or with null or
    non-finite components take no part. A repeated vec_id counts once, with the least of its
    vectors. Other columns are not read. Ties, also of scaled copies, go to the smaller vec_id.
    No usable vector: no row. Fewer than ``k`` candidates: all of them (``least`` and
    ``rerank`` are taken as over ``k``, whatever is given).
    Returns query_id, rank, vec_id, score (cosine, double); ties go to the smaller vec_id.
    """
    spark = embeddings.sparkSession
    least, rerank = max(least, k + 1), max(rerank, k + 1)
    good = usable(embeddings)
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("embedding").collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = np.array([r[0] for r in sample])
    dim = x.shape[1]
    total = good.count()
    wanted = lists or max(1, 2 ** int(np.log2(max(1.0, total**0.5))))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book = fit(x, min(wanted, max(1, sample_rows // 16)))
    deep = 1
    while list_count(book, deep) < wanted and deep < min(3, len(book.starts) - 1):
        deep += 1
    probes = lists_to_visit(book, x, list_of(book, encode(book, x)[0], deep), k, recall, deep)
    by_id = Window.partitionBy("embedding").orderBy("vec_id")
    distinct = good.distinct().withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1).groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    indexed = materialise(distinct.mapInArrow(partial(_index, book=book, dim=dim, deep=deep), "list int, id long, ids array<long>, vector binary, codes binary, norm float"))
    counted = {r["list"]: r["n"] for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row a list
    sizes = np.array([counted.get(i, 0) for i in range(list_count(book, deep))], np.int64)
    # one row a list: joined, and broadcast only while Spark finds it small
    blocks = materialise(indexed.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    asked = usable(queries).where(F.size("embedding") == dim).distinct()
    routed = asked.mapInArrow(partial(_route, book=book, dim=dim, deep=deep, sizes=sizes, probes=probes, least=least), "list int, id long, ids array<long>, vector binary, codes binary, norm float")
    own_block = F.pmod(F.xxhash64("vector"), F.col("blocks")).cast("int")
    rows = indexed.join(blocks, "list").withColumn("block", own_block).unionByName(routed.join(blocks, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))).drop("blocks")
    scanned = rows.repartition("list", "block").sortWithinPartitions("list", "block", F.col("id").isNotNull()).mapInArrow(partial(_scan, book=book, rerank=rerank), "query_id long, row long, far float")
    # the places are few and narrow; vectors meet them once, by the row's least id
    vectors = indexed.select(F.col("ids")[0].alias("row"), "ids", "vector")
    packed = asked.mapInArrow(partial(_packed, dim=dim), "query_id long, asked binary")
    met = candidates(scanned, rerank).join(vectors, "row").join(packed, "query_id").select("query_id", "asked", "ids", "vector")
    exact = met.mapInArrow(partial(_exact, dim=dim), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
