"""Harmonic packing: pieces of reciprocal-capacity classes, a fixed number of them to a bin.

Class k holds pieces that take one k-th of a sequence, so k of them fill a bin and no
search for a fit is needed. Documents may be cut freely, so a document's last tokens are
cut to lengths that divide the sequence exactly: the classes are those whose k pieces
leave no place, and every closed bin is full. A task fills the bins of its own documents
and of no other task's: no shuffle, no state between tasks, and a lost task is simply run
again. What a task has left at its end, fewer than k pieces of each class, is laid
longest first into further bins, and the very last one is cut at powers of two, which
need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slices, text_of
from .tokens import encoder

PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = [pa.int64()] * 7
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

#: A piece: doc_id, start, its ids as little-endian bytes, tokens of its document.
Piece = tuple[int | None, int, bytes, int]


def class_lengths(size: int) -> list[int]:
    """Lengths of which a whole number fills a sequence, longest first: ``size`` / k for each class k."""
    return [size // k for k in range(1, size + 1) if size % k == 0]


def class_cuts(length: int, lengths: list[int]) -> list[int]:
    """The class of each piece of ``length`` tokens: the longest that still fits, again and again."""
    out = []
    for n in lengths:
        out += [n] * (length // n)
        length %= n
    return out


def _four(piece: Piece, a: int, b: int) -> Piece:
    return piece[0], piece[1] + a, piece[2][4 * a : 4 * b], piece[3]


class Bins:
    """Bins of one task. ``add`` and ``close`` give the pieces of filled sequences with their places."""

    def __init__(self, size: int, first: int):
        self.size, self.next = size, first
        self.lengths = class_lengths(size)
        self.open: dict[int, list[Piece]] = {n: [] for n in self.lengths}

    def _sequence(self, pieces: list[Piece]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, n in pieces:
            yield doc, start, len(ids) // 4, zlib.crc32(ids), n, self.next, at
            at += len(ids) // 4
        self.next += 1

    def add(self, doc: int | None, ids: bytes) -> Iterator[tuple]:
        """A document's ids: its cuts, each in the open bin of its class; full bins come out."""
        n, at = len(ids) // 4, 0
        for length in class_cuts(n, self.lengths):
            piece = (doc, at, ids[4 * at : 4 * (at + length)], n)
            at += length
            pieces = self.open[length]
            pieces.append(piece)
            if len(pieces) * length == self.size:
                self.open[length] = []
                yield from self._sequence(pieces)

    def close(self) -> Iterator[tuple]:
        """The pieces left in open bins, longest first, in full bins; the rest in powers of two."""
        left = [p for n in self.lengths for p in self.open[n]]
        self.open = {n: [] for n in self.lengths}
        total = sum(len(p[2]) // 4 for p in left)
        room = [self.size] * (total // self.size)
        rest = total % self.size
        room += [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        left.reverse()
        for size in room:
            pieces: list[Piece] = []
            while size:
                piece = left.pop()
                n = len(piece[2]) // 4
                if n > size:
                    left.append(_four(piece, size, n))
                    piece, n = _four(piece, 0, size), size
                pieces.append(piece)
                size -= n
            yield from self._sequence(pieces)


def _pack(batches: Iterator[pa.RecordBatch], path: str, end: int, size: int, batch_rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    bins = Bins(size, (context.partitionId() if context else 0) << 40)
    rows: list[tuple] = []
    for part in slices(batches):
        ids, sizes = encoder(path).encode(part.column("text").to_pylist())
        raw = np.insert(ids, np.cumsum(sizes), end).astype("<u4").tobytes()
        at = 0
        for doc, n in zip(part.column("doc_id").to_pylist(), (4 * (sizes + 1)).tolist(), strict=True):
            rows.extend(bins.add(doc, raw[at : at + n]))
            at += n
        if len(rows) >= batch_rows:
            yield _batch(rows)
            rows = []
    rows.extend(bins.close())
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FIELDS, strict=True)], names=_NAMES)


def pack_harmonic(documents: DataFrame, tokenizer: str, *, size: int = 1024, end_id: int = 0) -> DataFrame:
    """Tokenise ``documents`` (doc_id, text) and pack them into sequences of ``size`` ids at most.

    Each id lies in one piece. Sequences are full but for up to log2(size) at the end of
    each task, whose lengths are powers of two; so nothing is padded. Null text: empty,
    one end id. Very long texts are encoded whole and cut into full sequences. Repeated rows are packed
    each; a null doc_id stays null. Other columns, of whatever name, are not read. An empty table gives no row.
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    docs = documents.select("doc_id", text_of().alias("text"))
    return docs.mapInArrow(partial(_pack, path=tokenizer, end=end_id, size=size), PLACED)
