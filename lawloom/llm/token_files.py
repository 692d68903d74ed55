"""Token ids as files: frequency-ranked ids, one to four bytes each, control bytes apart.

A folder holds ``ranks.bin`` (the id of each rank, little-endian uint32, most
frequent first, ties to the smaller id) and shards ``<task>-<number>-<first>-<last>.ids``, in
ascending order: one doc_id may fill several. A shard:

    8 bytes   magic
    3 x int64 documents, ids, data bytes
    int64     doc_id of each document, ascending
    int64     ids of each document
    control   two bits an id, four ids a byte, low bits first: bytes of its rank, less one
    data      the ranks, little-endian, one to four bytes each

A reader looks a control byte up in a table of 256 rows for the lengths of its four
ranks; the sum of lengths gives every rank's place, and numpy gathers all at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, shared_dir, slices, text_of
from .tokens import encoder, vocabulary

MAGIC = b"RANKIDS1"
#: Lengths of the four ranks of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of ranks (uint32)."""
    n = len(ranks)
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-n // 4) * 4, np.uint8)
    padded[:n] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    lengths = code.astype(np.int64) + 1
    at = np.cumsum(lengths) - lengths
    data = np.empty(int(lengths.sum()), np.uint8)
    data[at] = ranks
    for k in (1, 2, 3):
        more = np.flatnonzero(code >= k)
        data[at[more] + k] = ranks[more] >> np.uint32(8 * k)
    return control, data


def unpack(control: np.ndarray, data: np.ndarray, n: int, block: int = 1 << 18) -> np.ndarray:
    """The ``n`` ranks, decoded ``block`` at a time (a multiple of four)."""
    out = np.empty(n, np.uint32)
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    here = 0
    for a in range(0, n, block):
        some = min(block, n - a)
        lengths = LENGTHS[control[a // 4 : (a + some + 3) // 4]].reshape(-1)[:some].astype(np.int64)
        at = np.cumsum(lengths) - lengths + here
        got = padded[at].astype(np.uint32)
        for k in (1, 2, 3):
            more = np.flatnonzero(lengths > k)
            got[more] |= padded[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
        out[a : a + some] = got
        here += int(lengths.sum())
    return out


def shard_bytes(doc_ids: list[int], sizes: list[int], ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    return b"".join([MAGIC, np.array([len(doc_ids), len(ranks), len(data)], "<i8").tobytes(), np.array(doc_ids, "<i8").tobytes(), np.array(sizes, "<i8").tobytes(), control.tobytes(), data.tobytes()])


def read_shard(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, ids of each and all ranks."""
    if raw[:8] != MAGIC:
        raise ValueError("not a shard of ranked ids")
    docs, n, size = (int(x) for x in np.frombuffer(raw, "<i8", 3, 8))
    at = 32
    doc_ids = np.frombuffer(raw, "<i8", docs, at)
    sizes = np.frombuffer(raw, "<i8", docs, at + 8 * docs)
    at += 16 * docs
    control = np.frombuffer(raw, np.uint8, -(-n // 4), at)
    data = np.frombuffer(raw, np.uint8, size, at + len(control))
    return doc_ids, sizes, unpack(control, data, n)


def _encode(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3)
    width = np.uint16 if max(vocabulary(path), end + 1) <= 1 << 16 else np.uint32
    for part in slices(batches):
        ids, sizes = encoder(path).encode(part.column("text").to_pylist())
        ends = np.cumsum(sizes)
        full = np.insert(ids, ends, end).astype(width)
        sizes = sizes + 1
        ends = np.cumsum(sizes)
        blobs = [squeeze.compress(full[a:b].tobytes()) for a, b in zip(ends - sizes, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "n_tokens", "blob"])


def _ids(blob: bytes, n: int) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32)


def _counts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size, np.int64)
    for batch in batches:
        held = [_ids(blob, n) for blob, n in zip(batch.column("blob").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True)]
        for a in range(0, len(held), 500):
            total += np.bincount(np.concatenate(held[a : a + 500]), minlength=size)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])


def put(uri: str, content: bytes) -> None:
    """Write a file of the shared folder whole: under another name, then moved."""
    import uuid

    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(content)
    store.move(part, path)


_SHARD = pa.schema([("shard", pa.string()), ("task", pa.int64()), ("before", pa.int64()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
#: Tasks whose ids are summed together; windows over tasks and over such groups of them stay small.
_TASKS = 2048


def _write(batches: Iterator[pa.RecordBatch], folder: str, rank: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    docs: list[int] = []
    sizes: list[int] = []
    held: list[np.ndarray] = []
    total = number = written = 0

    def flush() -> pa.RecordBatch:
        nonlocal number, written
        name = f"{task:08d}-{number:08d}-{docs[0]}-{docs[-1]}.ids"
        number += 1
        put(f"{folder}/{name}", shard_bytes(docs, sizes, np.concatenate(held)))
        row = pa.RecordBatch.from_pydict({"shard": [name], "task": [task], "before": [written], "first_doc": [docs[0]], "n_docs": [len(docs)], "n_tokens": [sum(sizes)]}, schema=_SHARD)
        written += sum(sizes)
        docs.clear(), sizes.clear(), held.clear()
        return row

    for batch in batches:
        for doc, n, blob in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "blob")), strict=True):
            docs.append(doc)
            sizes.append(n)
            held.append(rank[_ids(blob, n)])
            total += n
            if total >= limit:
                total = 0
                yield flush()
    if docs:
        yield flush()


def write_token_files(documents: DataFrame, tokenizer: str, folder: str, *, end_id: int = 1, shard_tokens: int = 2_000_000) -> DataFrame:
    """Encode ``documents`` (doc_id, text) and write shards to ``folder`` in ascending doc_id order.

    Texts are encoded once; their ids go to the shared folder, compressed. The counts
    by id that rank them are as many as the vocabulary. Documents are then dealt by
    ranges of doc_id, so that shards are in order and hold about ``shard_tokens`` ids.
    A task that runs again writes the same shards under the same names.
    Null text: empty, one end id. Repeated doc_ids stay, side by side. Rows without
    doc_id have no place in the order and are left out. An empty table writes no shard.
    Returns (shard, first_doc, n_docs, n_tokens, start); start counts ids before it.
    """
    docs = documents.select("doc_id", text_of().alias("text")).where("doc_id IS NOT NULL")
    coded = materialise(docs.mapInArrow(partial(_encode, path=tokenizer, end=end_id), "doc_id long, n_tokens long, blob binary"))
    size = max(vocabulary(tokenizer), end_id + 1)
    counted = coded.mapInArrow(partial(_counts, size=size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(size, np.int64)
    for row in counted:  # at most one row an id of the vocabulary
        count[row["id"]] = row["n"]
    by_rank = np.argsort(-count, kind="stable").astype(np.uint32)
    rank = np.empty(size, np.uint32)
    rank[by_rank] = np.arange(size, dtype=np.uint32)
    put(f"{folder}/ranks.bin", by_rank.astype("<u4").tobytes())
    parts = max(1, -(-int(count.sum()) // shard_tokens))
    dealt = coded.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "n_tokens", "blob")
    shards = materialise(dealt.mapInArrow(partial(_write, folder=folder, rank=rank, limit=shard_tokens), "shard string, task long, before long, first_doc long, n_docs long, n_tokens long"))
    # ids before a shard: those of groups of tasks before its own, of tasks of the group before its own, and its task's
    tasks = shards.groupBy("task").agg(F.sum("n_tokens").alias("n")).withColumn("some", F.floor(F.col("task") / _TASKS))
    earlier = lambda by, *part: Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.withColumn("in_some", F.coalesce(F.sum("n").over(earlier("task", "some")), F.lit(0)))
    groups = tasks.groupBy("some").agg(F.sum("n").alias("n")).withColumn("to_some", F.coalesce(F.sum("n").over(earlier("some")), F.lit(0))).drop("n")
    starts = tasks.join(groups, "some").select("task", (F.col("to_some") + F.col("in_some")).alias("at"))
    return shards.join(starts, "task").select("shard", "first_doc", "n_docs", "n_tokens", (F.col("at") + F.col("before")).alias("start"))


def _digest(batches: Iterator[pa.RecordBatch], by_rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    import zlib

    for batch in batches:
        for path, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            docs, sizes, ranks = read_shard(raw.as_buffer().to_pybytes())
            ids = by_rank[ranks].astype("<u4")
            ends = np.cumsum(sizes)
            crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends - sizes, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[1]] * len(docs)), pa.array(docs, pa.int64()), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["shard", "doc_id", "within", "n_tokens", "ids_crc32"])


def _rank_table(folder: str) -> np.ndarray:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(f"{folder}/ranks.bin")
    with store.open_input_stream(path) as f:
        return np.frombuffer(f.read(), "<u4")


def _rows(batches: Iterator[pa.RecordBatch], by_rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column("content"):
            docs, sizes, ranks = read_shard(raw.as_buffer().to_pybytes())
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(by_rank[ranks].astype(np.int64)))], names=["doc_id", "ids"])


def read_token_files(spark, folder: str) -> DataFrame:
    """The documents of a folder of shards: doc_id, ids array<long>."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("content")
    return files.mapInArrow(partial(_rows, by_rank=_rank_table(folder)), "doc_id long, ids array<long>")


def token_file_digests(documents: DataFrame, tokenizer: str, *, end_id: int = 1) -> DataFrame:
    """Write ``documents`` as token files, read these back, and say what each document holds there.

    Returns doc_id, start (ids of all documents before it), n_tokens, ids_crc32.
    """
    spark = documents.sparkSession
    folder = shared_dir(spark)
    shards = write_token_files(documents, tokenizer, folder, end_id=end_id)
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("path", "content")
    found = files.mapInArrow(partial(_digest, by_rank=_rank_table(folder)), "shard string, doc_id long, within long, n_tokens long, ids_crc32 long")
    return found.join(shards.select("shard", "start"), "shard").select("doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
