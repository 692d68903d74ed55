"""Repeated byte strings of ``length`` bytes: a depth-limited radix sort of sampled suffixes.

Two equal windows of ``length`` bytes share the place of their least ``GRAM``-byte gram
(by hash, leftmost of equals). So only suffixes that start at such a place, an anchor,
need sorting; about one byte in sixteen is one. The digits, most significant first, are

1. the gram at the anchor: groups within one document end here;
2. all bytes of the windows around the anchor (the neighbourhood): where an earlier
   document has the same, every window around the anchor repeats one there;
3. for the rest, each window around the anchor, eight bytes a pass, until ``length``
   bytes. Windows alone in their group leave after each pass; groups that are left
   after the last are exactly the repeated windows. A group of more anchors than a
   task should hold is cut in two by how far an anchor is into a window: windows of one
   half share some bytes before the anchor, those of the other some after it. An anchor
   is two rows a cut, whatever its windows. What is still too large after the cuts is
   told apart by the whole window, as a digest; tasks settle what repeats among their
   own anchors first, so a window that every document has is sent about once a task.

Digits 1 and 2 travel as digests, 48 and 56 bits beside the bits of the bucket, in packed
blocks, and each task settles repeats within its own documents first, so a passage of
every document is sent once a block of documents. Texts travel compressed, dealt by
doc_id once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, mix, powers, ragged, slices

GRAM = 20
BASE = 0x100000001B3
#: Bytes of text that settle their repeats together before anything is sent.
BLOCK_BYTES = 2 << 20
_PLACE_BITS = 26


class Hashed:
    """Bytes end to end with hashes of any range."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(len(raw), BASE), out=self.total[1:])
        self.inverse = powers(len(raw) + 1, pow(BASE, -1, 1 << 64))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def anchors(hashed: Hashed, offsets: np.ndarray, length: int) -> np.ndarray:
    """Places of the least gram of every window that lies in one document, ascending.

    Bytes beyond what a place's bits number are taken in pieces, which overlap by a window less one byte.
    """
    n, size = len(hashed.raw), 1 << _PLACE_BITS
    if n < length:
        return np.zeros(0, np.int64)
    if size < length:
        raise ValueError(f"windows of {length} bytes exceed the places of a piece")
    pieces = [_anchors(hashed, offsets, length, begin, min(n, begin + size)) for begin in range(0, n - length + 1, size - length + 1)]
    return np.unique(np.concatenate(pieces)) if len(pieces) > 1 else pieces[0]


def _anchors(hashed: Hashed, offsets: np.ndarray, length: int, begin: int, end: int) -> np.ndarray:
    """The anchors of the windows from ``begin`` to ``end``."""
    span = length - GRAM + 1
    at = np.arange(begin, end - GRAM + 1)
    least = (hashed.of(at, at + GRAM) >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | (at - begin).astype(np.uint64)
    width = 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    inside = np.zeros(len(least) + 1, np.int32)
    sizes = np.diff(offsets)
    long = sizes >= length
    np.add.at(inside, np.clip(offsets[:-1][long] - begin, 0, len(least)), 1)
    np.add.at(inside, np.clip(offsets[1:][long] - length + 1 - begin, 0, len(least)), -1)
    picked = (least[np.cumsum(inside[:-1]) > 0] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64) + begin
    return np.unique(picked[np.concatenate([[True], picked[1:] != picked[:-1]])]) if len(picked) else picked


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3)
    for part in slices(batches):
        blobs = [squeeze.compress(x.as_buffer()) if x.is_valid else squeeze.compress(b"") for x in part.column("text")]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(blobs, pa.binary())], names=["doc_id", "blob"])


def _texts(part: pa.RecordBatch) -> list[bytes]:
    import zstandard

    expand = zstandard.ZstdDecompressor()
    return [expand.decompress(x.as_buffer()) for x in part.column("blob")]


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list[int], list[bytes], list[dict]]]:
    """doc_ids, texts and other columns, some ``limit`` bytes of text at a time, ascending doc_id."""
    docs: list[tuple] = []
    size = 0

    def close():
        docs.sort(key=lambda x: x[0])
        return [d for d, _, _ in docs], [t for _, t, _ in docs], [r for _, _, r in docs]

    for batch in batches:
        for part in slices([batch], limit // 4, "blob"):
            others = part.select([c for c in part.schema.names if c not in ("doc_id", "blob")])
            rest = others.to_pylist() if others.num_columns else [{}] * part.num_rows
            for doc, text, row in zip(part.column("doc_id").to_pylist(), _texts(part), rest, strict=True):
                if docs and size + len(text) > limit:
                    yield close()
                    docs, size = [], 0
                docs.append((doc, text, row))
                size += len(text)
    if docs:
        yield close()


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, a plane a byte: planes of zeros compress away."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplanes(raw: bytes, at: int, n: int, width: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return wide.reshape(-1).view("<u8")


#: Bytes of a gram (beside its bucket), a neighbourhood, a document of the block and a place.
_WIDTHS = (6, 7, 3, 4)
_SENT = pa.schema([("bucket", pa.int32()), ("settled", pa.bool_()), ("docs", pa.binary()), ("n", pa.int32()), ("body", pa.binary())])


def _neighbourhood(places: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before and from each place that its windows reach, within its document."""
    return np.minimum(places - begin, length - GRAM), np.minimum(end - places, length)


def _send(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Anchors by bucket of their gram; settled ones, which an earlier document of the block covers, apart."""
    alone = (b.filter(b.column("copied").is_null()).select(["doc_id", "blob"]) for b in batches)
    for ids, texts, _ in _blocks(alone, BLOCK_BYTES):
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        hashed = Hashed(np.frombuffer(b"".join(texts), np.uint8))
        at = anchors(hashed, offsets, length)
        if not len(at):
            continue
        doc = np.searchsorted(offsets, at, "right") - 1
        left, right = _neighbourhood(at, offsets[doc], offsets[doc + 1], length)
        gram = hashed.of(at, at + GRAM)
        around = mix(hashed.of(at - left, at + right) + (left * 1009 + right).astype(np.uint64))
        place = at - offsets[doc]
        order = np.lexsort((doc, around))
        first = np.concatenate([[True], around[order][1:] != around[order][:-1]])
        least = doc[order][np.flatnonzero(first)][np.cumsum(first) - 1]
        later = np.zeros(len(at), bool)
        later[order] = doc[order] > least
        table = np.array(ids, "<i8")
        bucket = (gram % np.uint64(buckets)).astype(np.int64)
        gram = gram // np.uint64(buckets)
        rows = []
        if later.any():
            where = np.flatnonzero(later)
            used, local = np.unique(doc[where], return_inverse=True)
            rows.append((int(bucket[where[0]]), True, table[used].tobytes(), len(where), _planes(local, _WIDTHS[2]) + _planes(place[where], _WIDTHS[3])))
        where = np.flatnonzero(~later)
        where = where[np.lexsort((gram[where], bucket[where]))]
        cuts = np.flatnonzero(np.diff(bucket[where])) + 1
        for some in np.split(where, cuts):
            used, local = np.unique(doc[some], return_inverse=True)
            body = b"".join(_planes(v, w) for v, w in zip((gram[some], around[some], local, place[some]), _WIDTHS, strict=True))
            rows.append((int(bucket[some[0]]), False, table[used].tobytes(), len(some), body))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)


_REPLY = pa.schema([("doc_id", pa.int64()), ("place", pa.int32()), ("group", pa.int64())])


def _sort_bucket(bucket: int, rows: list[tuple], buckets: int) -> pa.RecordBatch | None:
    cols: list[list[np.ndarray]] = [[], [], [], []]
    for docs, n, body in rows:
        at = 0
        got = []
        for w in _WIDTHS:
            got.append(_unplanes(body, at, n, w))
            at += n * w
        got[2] = np.frombuffer(docs, "<i8")[got[2].astype(np.int64)]
        for c, g in zip(cols, got, strict=True):
            c.append(g)
    gram, around, doc, place = (np.concatenate(c) for c in cols)
    order = np.lexsort((doc, around, gram))
    gram, around, doc, place = gram[order], around[order], doc[order], place[order]
    new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
    new = new_gram | np.concatenate([[True], around[1:] != around[:-1]])
    starts, firsts = np.flatnonzero(new_gram), np.flatnonzero(new)
    of_gram, of_around = np.cumsum(new_gram) - 1, np.cumsum(new) - 1
    covered = doc > doc[firsts][of_around]
    several = (np.add.reduceat(new.astype(np.int64), starts) > 1) & (np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts))
    open_ = ~covered & several[of_gram]
    if not (covered.any() or open_.any()):
        return None
    key = (gram * np.uint64(buckets) + np.uint64(bucket)).view(np.int64)
    groups = pa.array(np.concatenate([key[covered], key[open_]]), mask=np.concatenate([np.ones(int(covered.sum()), bool), np.zeros(int(open_.sum()), bool)]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([doc[covered], doc[open_]])), pa.array(np.concatenate([place[covered], place[open_]]).astype(np.int32)), groups], schema=_REPLY)


def _reply(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, place, group): covered anchors (no group), and those whose windows must be sorted. One bucket at a time."""
    now, rows = None, []
    for batch in batches:
        for bucket, settled, docs, n, body in zip(*(batch.column(c).to_pylist() for c in _SENT.names), strict=True):
            if settled:
                local = _unplanes(body, 0, n, _WIDTHS[2]).astype(np.int64)
                place = _unplanes(body, n * _WIDTHS[2], n, _WIDTHS[3]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(docs, "<i8")[local]), pa.array(place), pa.nulls(n, pa.int64())], schema=_REPLY)
                continue
            if bucket != now:
                if rows and (out := _sort_bucket(now, rows, buckets)) is not None:
                    yield out
                now, rows = bucket, []
            rows.append((docs, n, body))
    if rows and (out := _sort_bucket(now, rows, buckets)) is not None:
        yield out


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges, as ascending ranges that don't touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1]


_OPEN = pa.schema([("group", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("left", pa.int16()), ("right", pa.int16()), ("around", pa.binary())])


def _open(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Covered ranges of each document (no group), and the neighbourhoods of anchors to be sorted."""
    for ids, texts, rows in _blocks(batches, BLOCK_BYTES):
        out: list[tuple] = []
        for doc, text, row in zip(ids, texts, rows, strict=True):
            place = np.array(row["places"], np.int64)
            group = row["groups"]
            none = np.array([g is None for g in group])
            left, right = _neighbourhood(place, np.zeros_like(place), np.full_like(place, len(text)), length)
            whole = none & (left + right >= length)
            for a, b in zip(*_merged((place - left)[whole], (place + right)[whole]), strict=True):
                out.append((None, doc, int(a), int(b), None, None, None))
            for i in np.flatnonzero(~none).tolist():
                p, le, ri = int(place[i]), int(left[i]), int(right[i])
                out.append((group[i], doc, p, None, le, ri, text[p - le : p + ri]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OPEN, strict=True)], schema=_OPEN)


def radix_groups(group: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Most-significant-digit passes over rows of bytes, eight at a time, within given groups.

    Returns the number of each row's final group, or -1 for a row that is alone.
    """
    out = np.full(len(group), -1, np.int64)
    alive = np.arange(len(group))
    for at in range(0, windows.shape[1], 8):
        digit = np.zeros((len(alive), 8), np.uint8)
        piece = windows[alive, at : at + 8]
        digit[:, : piece.shape[1]] = piece
        value = digit.reshape(-1).view(">u8")
        order = np.lexsort((value, group))
        g, v = group[order], value[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
        number = np.cumsum(new) - 1
        more = np.bincount(number)[number] > 1
        alive, group = alive[order][more], number[more]
        if not len(alive):
            return out
    out[alive] = group
    return out


def _repeated(rows: list[tuple], length: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of anchors: (doc, place, left), the bytes around each from ``length - GRAM`` before it, and two tables, by how far
    an anchor is into a window: whether it has that window, and whether an earlier document of the rows has the same.
    Rows may end with the least and the greatest distance into a window that count."""
    group, doc, place, left, right = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:5])
    reach = length - GRAM
    flat = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    around = np.zeros((len(rows), reach + length), np.uint8)
    size = left + right
    around.reshape(-1)[ragged(np.arange(len(rows)) * (reach + length) + reach - left, size)] = flat
    _, group = np.unique(group, return_inverse=True)
    into = np.arange(reach + 1)
    there = (left[:, None] >= into) & (right[:, None] >= length - into)
    if len(rows[0]) > 6:
        low, high = (np.array([r[i] for r in rows])[:, None] for i in (6, 7))
        there &= (into >= low) & (into <= high)
    later = np.zeros(there.shape, bool)
    for d in range(reach + 1):
        has = np.flatnonzero(there[:, d])
        if len(has) < 2:
            continue
        found = radix_groups(group[has], around[has, reach - d : reach - d + length])
        kept = np.flatnonzero(found >= 0)
        if not len(kept):
            continue
        rows_, number = has[kept], found[kept]
        least = np.full(int(number.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, number, doc[rows_])
        later[rows_, d] = doc[rows_] > least[number]
    return [doc, place, left], around, there, later


def _union(doc: np.ndarray, place: np.ndarray, later: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered ranges (doc, start, end) of anchors: the windows of one all hold its gram, so their union is one range."""
    hit = np.flatnonzero(later.any(axis=1))
    low = later[hit].argmax(axis=1)
    high = later.shape[1] - 1 - later[hit, ::-1].argmax(axis=1)
    return doc[hit], place[hit] - high, place[hit] - low + length


def _sort_windows(rows: list[tuple], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered ranges (doc, start, end) of anchors: the union of their windows that an earlier document has."""
    (doc, place, _), _, _, later = _repeated(rows, length)
    return _union(doc, place, later, length)


def _anchors_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    names = ("group", "doc_id", "start", "left", "right", "around") + (("low", "high") if "low" in batch.schema.names else ())
    return zip(*(batch.column(c).to_pylist() for c in names), strict=True)


_CUT = pa.schema([*(f for f in _OPEN if f.name != "end"), pa.field("low", pa.int16()), pa.field("high", pa.int16())])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Each anchor once for each half of its range of distances into a window that has windows of it, grouped by
    the bytes that all windows of the half share."""
    import hashlib

    for batch in batches:
        out: list[tuple] = []
        for _, doc, start, left, right, around, low, high in _anchors_of(batch):
            middle = (low + high) // 2
            for a, b in ((low, middle), (middle + 1, high)):
                if max(a, length - right) <= min(b, left):
                    shared = hashlib.blake2b(around[left - a : left + length - b], digest_size=8, salt=bytes((a & 255, a >> 8, b & 255, b >> 8))).digest()
                    out.append((int.from_bytes(shared, "little", signed=True), doc, start, left, right, around, a, b))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _CUT, strict=True)], schema=_CUT)


def _settle(batches: Iterator[pa.RecordBatch], length: int, many: int = 40_000) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; whole groups are sorted together, some ``many`` rows at a time."""
    rows: list[tuple] = []

    def close():
        doc, start, end = _sort_windows(rows, length)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["doc_id", "start", "end"])

    for batch in batches:
        for row in _anchors_of(batch):
            # a group holds ``many`` rows at most
            if len(rows) >= many and row[0] != rows[-1][0]:
                yield close()
                rows = []
            rows.append(row)
    if rows:
        yield close()


_WINDOW = pa.schema([("group", pa.int64()), ("within", pa.int32()), ("window", pa.binary()), ("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _windows(batches: Iterator[pa.RecordBatch], length: int, many: int = 8_000) -> Iterator[pa.RecordBatch]:
    """Anchors some ``many`` at a time: ranges that an earlier document among them covers (no window), and of the other
    windows the group, how far the anchor is into it, 128 bits of it, its document and place."""
    import hashlib

    reach = length - GRAM
    rows: list[tuple] = []

    def close() -> Iterator[pa.RecordBatch]:
        (doc, place, left), around, there, later = _repeated(rows, length)
        docs, starts, ends = _union(doc, place, later, length)
        if len(docs):
            n = len(docs)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(docs), pa.array(starts.astype(np.int32)), pa.array(ends.astype(np.int32))], schema=_WINDOW)
        at, into = np.nonzero(there & ~later)
        for a in range(0, len(at), 20_000):
            i, d = at[a : a + 20_000], into[a : a + 20_000]
            start = place[i] - d
            digests = [hashlib.blake2b(around[x, reach - y : reach - y + length].tobytes(), digest_size=16).digest() for x, y in zip(i.tolist(), d.tolist(), strict=True)]
            columns = [pa.array([rows[x][0] for x in i.tolist()], pa.int64()), pa.array(d.astype(np.int32)), pa.array(digests, pa.binary()), pa.array(doc[i]), pa.array(start.astype(np.int32)), pa.array((start + length).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, schema=_WINDOW)

    for batch in batches:
        for row in _anchors_of(batch):
            if len(rows) >= many:
                yield from close()
                rows = []
            rows.append(row)
    if rows:
        yield from close()


#: Cuts of large groups: after three, windows of a group share all but three bytes of 50 at most.
_CUTS = 3


def _settle_large(opened: DataFrame, length: int, many: int) -> DataFrame:
    """(doc_id, start, end) of the windows of large groups that an earlier document has.

    Groups are cut by the bytes that halves of their windows share, until they hold ``many`` anchors at most. Of what
    is left after the cuts, tasks settle what repeats among their own anchors, so a window of every document is
    sent about once a task, and its least document is found over these rows without a join.
    """
    ranges = ["doc_id", "start", "end"]
    found = None
    rest = opened.drop("end").withColumn("low", F.lit(0).cast("short")).withColumn("high", F.lit(length - GRAM).cast("short"))
    for _ in range(_CUTS):
        cut = materialise(rest.mapInArrow(partial(_cut, length=length), "group long, doc_id long, start int, left short, right short, around binary, low short, high short"))
        # few: each stands for over ``many`` rows
        large = materialise(cut.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > many).select("group"))
        small = cut.join(F.broadcast(large), "group", "left_anti").repartition(F.xxhash64("group")).sortWithinPartitions("group")
        settled = small.mapInArrow(partial(_settle, length=length, many=many), "doc_id long, start int, end int")
        found = settled if found is None else found.unionByName(settled)
        if large.isEmpty():
            return found
        rest = cut.join(F.broadcast(large), "group", "left_semi")
    windows = materialise(rest.mapInArrow(partial(_windows, length=length), "group long, within int, window binary, doc_id long, start int, end int"))
    least = F.min("doc_id").over(Window.partitionBy("group", "within", "window"))
    later = windows.where("window IS NOT NULL").withColumn("least", least).where("doc_id > least")
    return found.unionByName(windows.where("window IS NULL").select(*ranges)).unionByName(later.select(*ranges).distinct())


def _finish(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    import hashlib

    for ids, texts, rows in _blocks(batches, BLOCK_BYTES):
        out = []
        for doc, text, row in zip(ids, texts, rows, strict=True):
            spans = [[0, len(text)]] if row["copied"] else row["spans"] or []
            starts, ends = _merged(np.array([s[0] for s in spans], np.int64), np.array([s[1] for s in spans], np.int64))
            at, kept = 0, []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                kept.append(text[at:a])
                at = b
            rest = b"".join([*kept, text[at:]])
            out.append((doc, len(text), int((ends - starts).sum()), len(starts), hashlib.sha256(rest).hexdigest(), rest if keep_text else None, [list(x) for x in zip(starts.tolist(), ends.tolist(), strict=True)] if keep_text else None))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64())))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def remove_repeats(documents: DataFrame, *, length: int = 50, keep_text: bool = False, part_bytes: int = 24 << 20, bucket_anchors: int = 400_000, group_anchors: int = 4_000) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts in a document of smaller doc_id.

    ``documents`` (doc_id, text): texts are UTF-8 bytes, null is empty. Matches don't cross
    documents and are judged on the input. Rows without doc_id have no rank and are left
    out. A doc_id stands for one document: of repeated rows the greatest text counts,
    once. Texts shorter than ``length`` keep all; longer ones are read whole. Other columns
    are not read. An empty table gives no row. A task sorts ``group_anchors`` anchors of one
    gram at most; larger groups are cut first.
    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``keep_text`` also
    kept (bytes) and removed ([start, end) byte ranges).
    """
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    n, distinct, size = docs.agg(F.count("*"), F.countDistinct("doc_id"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if n != distinct:
        docs = docs.groupBy("doc_id").agg(F.max("text").alias("text"))
    # as many parts as a join would make at least, so that joins take the texts' partitioning as it is
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    buckets = max(1, -(-2 * size // ((length - GRAM + 2) * bucket_anchors)))
    # the filter, which joins would add to some uses, makes all uses one plan: the texts are dealt once
    texts = docs.mapInArrow(_squeeze, "doc_id long, blob binary").where("doc_id IS NOT NULL").repartition(parts, "doc_id")
    copies = docs.select("doc_id", F.unhex(F.md5("text")).alias("digest"), F.octet_length("text").alias("size"))
    firsts = copies.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    copied = copies.join(firsts, "digest").where((F.col("doc_id") != F.col("first")) & (F.col("size") >= length)).select("doc_id", F.lit(True).alias("copied"))
    # an outer join: a semi join would move below the dealing, and the texts would be dealt twice
    flagged = texts.join(copied.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "blob", "copied")
    sent = flagged.mapInArrow(partial(_send, length=length, buckets=buckets), "bucket int, settled boolean, docs binary, n int, body binary")
    replies = sent.repartition(buckets, "bucket").sortWithinPartitions("settled", "bucket").mapInArrow(partial(_reply, buckets=buckets), "doc_id long, place int, group long")
    asked = replies.groupBy("doc_id").agg(F.collect_list(F.struct("place", "group")).alias("r")).select("doc_id", F.col("r.place").alias("places"), F.col("r.group").alias("groups"))
    opened = texts.join(asked.hint("shuffle_hash"), "doc_id").mapInArrow(partial(_open, length=length), "group long, doc_id long, start int, end int, left short, right short, around binary")
    opened = materialise(opened)
    ranges = opened.where("group IS NULL").select("doc_id", "start", "end")
    open_ = opened.where("group IS NOT NULL")
    large = materialise(open_.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > group_anchors).select("group"))
    sorted_ = open_.join(large, "group", "left_anti").repartition("group").sortWithinPartitions("group").mapInArrow(partial(_settle, length=length, many=group_anchors), "doc_id long, start int, end int")
    spans = ranges.unionByName(sorted_).unionByName(_settle_large(open_.join(large, "group", "left_semi"), length, group_anchors)).groupBy("doc_id").agg(F.collect_list(F.array("start", "end")).alias("spans"))
    known = copied.join(spans, "doc_id", "full")
    done = texts.join(known.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "blob", F.coalesce("copied", F.lit(False)).alias("copied"), "spans")
    out = done.mapInArrow(partial(_finish, keep_text=keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed array<array<long>>")
    return out if keep_text else out.drop("kept", "removed")
