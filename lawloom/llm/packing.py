"""Best-fit packing of documents into sequences of bounded length, in a tree of rounds.

Pieces are dealt to tasks by a hash of their place, a bounded number to each. A task packs its items
best-fit, longest first, and emits bins that are full or nearly so. No two bins of a task
fit together, so at most one of each is half full or less, and a fuller one can only be
joined with one of these. So the bins half full or less, and as many of the emptiest
others as could take them, go on as items to fewer tasks, which pack them best-fit, and
so on, until one task's share holds all that is left, or a round joins nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, text_of
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = "done boolean, fill int, doc_ids array<long>, lengths array<int>, crcs array<long>, offsets array<long>"


def _cut(batches: Iterator[pa.RecordBatch], path: str, end: int, size: int) -> Iterator[pa.RecordBatch]:
    import zlib

    for part in slices(batches):
        ids, sizes = encoder(path).encode(part.column("text").to_pylist())
        full = np.insert(ids, np.cumsum(sizes), end).astype("<u4")
        out: list[tuple[int, int, int, int, int]] = []
        at = 0
        for doc, n in zip(part.column("doc_id").to_pylist(), (sizes + 1).tolist(), strict=True):
            first = n % size or size
            bounds = [0, *range(first, n + 1, size)]
            for piece, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                out.append((doc, piece, a, b - a, zlib.crc32(full[at + a : at + b].tobytes())))
            at += n
        cols = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def best_fit(fills: list[int], size: int) -> list[list[int]]:
    """Best-fit, longest first: the items of each bin. The tightest open bin is the lowest set bit."""
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    bins: list[list[int]] = []
    open_ = 0
    for i in sorted(range(len(fills)), key=lambda i: (-fills[i], i)):
        n = fills[i]
        fit = open_ >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_ &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = size, len(bins)
            bins.append([i])
        left = room - n
        if left:
            rooms[left].append(b)
            open_ |= 1 << left
    return bins


def _pack(batches: Iterator[pa.RecordBatch], size: int, slack: int, batch_bins: int = 4096) -> Iterator[pa.RecordBatch]:
    """Items of a task into bins; each is a bin with its members already."""
    tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not tables:
        return
    items = pa.concat_tables(tables)
    items = items.take(pa.array(np.argsort(items.column("key").to_numpy(), kind="stable")))
    fills = items.column("fill").to_pylist()
    members = [items.column(c).to_pylist() for c in ("doc_ids", "lengths", "crcs")]
    bins = best_fit(fills, size)
    for k in range(0, len(bins), batch_bins):
        some = bins[k : k + batch_bins]
        total = [sum(fills[i] for i in b) for b in some]
        joined = [[[x for i in b for x in col[i]] for b in some] for col in members]
        yield pa.RecordBatch.from_arrays(
            [pa.array([t >= size - slack for t in total]), pa.array(total, pa.int32()), pa.array(joined[0], pa.list_(pa.int64())), pa.array(joined[1], pa.list_(pa.int32())), pa.array(joined[2], pa.list_(pa.int64())), pa.array([[0, *accumulate(x[:-1])] for x in joined[1]], pa.list_(pa.int64()))],
            names=["done", "fill", "doc_ids", "lengths", "crcs", "offsets"],
        )


def cut_pieces(documents: DataFrame, tokenizer: str, *, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of each document's ids with the end id: at most ``size`` ids, the first may be shorter."""
    docs = documents.select("doc_id", text_of().alias("text"))
    return docs.mapInArrow(partial(_cut, path=tokenizer, end=end_id, size=size), PIECES)


def pack_sequences(pieces: DataFrame, *, size: int = 2048, slack: int = 8, share: int = 40_000) -> DataFrame:
    """Place ``pieces`` (doc_id, piece, start, length, ids_crc32) into as few sequences as best fit can.

    A bin with ``slack`` free places or fewer is full. ``share`` items go to one task;
    it bounds memory, and the last round's underfull bins. Members of a bin are at
    most ``size``, so a row is bounded. Pieces of exactly ``size`` fill a sequence each.
    """
    whole = pieces.where(F.col("length") == size).select(F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))).alias("members"))
    left = pieces.where(F.col("length") < size).select(F.col("length").cast("int").alias("fill"), F.array("doc_id").alias("doc_ids"), F.array(F.col("length").cast("int")).alias("lengths"), F.array("ids_crc32").alias("crcs"))
    n = left.count()
    full: list[DataFrame] = []
    turn = 0
    while n:
        parts = max(1, -(-n // share))
        dealt = left.withColumn("key", F.xxhash64(F.lit(turn), F.monotonically_increasing_id()))  # by place, so equal rows spread
        out = materialise(dealt.repartition(parts, "key").mapInArrow(partial(_pack, size=size, slack=slack), BINS))
        if parts == 1:
            full.append(out)
            break
        full.append(out.where("done"))
        was, turn, open_ = n, turn + 1, out.where("NOT done").drop("done")
        # one row a fill: at most ``size``
        told = sorted((r["fill"], r["n"]) for r in open_.groupBy("fill").agg(F.count("*").alias("n")).collect())
        small = sum(k for fill, k in told if 2 * fill <= size)
        to, mates = size // 2, 0
        for fill, k in told:
            if 2 * fill > size and mates < small:
                to, mates = fill, mates + k
        left, n = open_.where(F.col("fill") <= to), small + mates
        full.append(open_.where(F.col("fill") > to))
        if small == 0 or n >= was:
            full.append(left)
            break
    bins = None
    for f in full:
        f = f.select("doc_ids", "lengths", "crcs", "offsets")
        bins = f if bins is None else bins.unionByName(f)
    if bins is not None:
        zipped = F.arrays_zip("doc_ids", "lengths", "crcs", "offsets")
        placed = bins.select(F.transform(zipped, lambda m: F.struct(m["doc_ids"].alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), m["lengths"].cast("long").alias("length"), m["crcs"].alias("ids_crc32"), m["offsets"].alias("offset"))).alias("members"))
        whole = whole.unionByName(placed)
    numbered = whole.withColumn("sequence_id", F.monotonically_increasing_id())
    return numbered.select("sequence_id", F.explode("members").alias("m")).select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")


def pack_documents(documents: DataFrame, tokenizer: str, *, size: int = 2048, end_id: int = 0, **how) -> DataFrame:
    """Tokenise ``documents`` (doc_id, text) and pack them.

    Null text: empty, one end id. Repeated rows are packed each. Rows without doc_id
    are packed too, with a null doc_id. An empty table gives no row.
    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    return pack_sequences(materialise(cut_pieces(documents, tokenizer, size=size, end_id=end_id)), size=size, **how)
