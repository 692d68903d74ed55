"""Centroid clustering with Elkan's bounds over exact integer distances.

Each vector keeps its centroid, an upper bound of its distance to it, and one lower bound
for each centroid. After the centroids move, bounds move by as much; a distance is only
computed where the bounds and the distances between centroids leave it open. Bounds are
rounded outwards and a centroid is passed over only if it is strictly farther, so ties
still meet the exact test, and no bound ever decides a result: integers do.

Vectors and bounds lie together in rows of a few hundred vectors. Each round reads them,
assigns them, writes them to the shared folder, and sums the vectors of each centroid;
only the sums (centroids x components) reach the driver. No vector is ever shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

SCALE = 256
#: Vectors of a row of blocks.
BLOCK = 512
#: ids: int64 buffer and whether each is set; vectors: integers of ``width`` bytes (0: wide, as text); bounds as below.
STATE = "n int, has_id binary, ids binary, width int, vectors binary, cluster binary, upper binary, lower binary, computed long"
_NAMES = [c.split()[0] for c in STATE.split(", ")]
_TYPES = [pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
_LIMB = 40
LONG_MAX = (1 << 63) - 1


def _down(x: np.ndarray) -> np.ndarray:
    return x * (1 - 1e-12)


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + 1e-12)


def pack_lower(x: np.ndarray) -> bytes:
    """Lower bounds in 16 bits each: the upper half of a float32, which only ever rounds down."""
    return ((x * (1 - 1e-6)).astype("<f4").view("<u4") >> 16).astype("<u2").tobytes()


def unpack_lower(raw: bytes, n: int) -> np.ndarray:
    return (np.frombuffer(raw, "<u2").astype("<u4") << 16).view("<f4").astype(np.float64).reshape(n, -1)


def narrow_limit(dims: int) -> int:
    """The largest component with which squared distances stay within 63 bits."""
    return math.isqrt((LONG_MAX - 1) // (4 * max(dims, 1)))


@dataclass
class Centroids:
    """Exact components, how far each has moved at most, and half of all distances between them at least."""

    rows: list[list[int]]
    moved: np.ndarray
    half: np.ndarray

    @classmethod
    def of(cls, rows: list[list[int]], before: list[list[int]] | None = None) -> Centroids:
        k = len(rows)
        if not narrow(rows) or (before is not None and not narrow(before)):
            return cls(rows, np.full(k, np.inf), np.zeros((k, k)))
        c = np.array(rows, np.int64)
        moved = np.zeros(k) if before is None else _up(np.sqrt(((c - np.array(before, np.int64)) ** 2).sum(1).astype(np.float64)))
        half = _down(np.sqrt(((c[:, None] - c[None]) ** 2).sum(2).astype(np.float64))) / 2
        return cls(rows, moved, half)


def narrow(rows: list[list[int]]) -> bool:
    return not rows or max(max(map(abs, r)) for r in rows) <= narrow_limit(len(rows[0]))


def assign(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, to: Centroids) -> int:
    """Assign integer vectors to their nearest centroid, ties to the smaller number; changes the bounds in place.

    Returns how many distances were computed.
    """
    c = np.array(to.rows, np.int64)
    upper += to.moved[cluster]
    upper *= 1 + 1e-12
    np.maximum(_down(lower - to.moved), 0, out=lower)
    half = to.half.copy()
    np.fill_diagonal(half, np.inf)
    open_ = ~(upper < half.min(1)[cluster])
    exact = np.full(len(v), -1, np.int64)
    computed = 0
    for j in range(len(c)):
        at = np.flatnonzero(open_ & (cluster != j) & ~(lower[:, j] > upper) & ~(half[cluster, j] > upper))
        loose = at[exact[at] < 0]
        if len(loose):
            own = cluster[loose]
            exact[loose] = ((v[loose] - c[own]) ** 2).sum(1)
            root = np.sqrt(exact[loose].astype(np.float64))
            upper[loose], lower[loose, own] = _up(root), _down(root)
            computed += len(loose)
            at = at[~(lower[at, j] > upper[at]) & ~(half[cluster[at], j] > upper[at])]
        if not len(at):
            continue
        d = ((v[at] - c[j]) ** 2).sum(1)
        root = np.sqrt(d.astype(np.float64))
        lower[at, j] = _down(root)
        computed += len(at)
        nearer = (d < exact[at]) | ((d == exact[at]) & (j < cluster[at]))
        to_j = at[nearer]
        cluster[to_j], exact[to_j], upper[to_j] = j, d[nearer], _up(root[nearer])
    return computed


def _assign_wide(v: list[list[int]], to: Centroids) -> list[int]:
    """Components past 63-bit squares: plain integers of any size, every distance."""
    return [min(range(len(to.rows)), key=lambda j: (_square(x, to.rows[j]), j)) for x in v]


def _square(x: list[int], c: list[int]) -> int:
    return sum((a - b) ** 2 for a, b in zip(x, c, strict=True))


def components(x: np.ndarray) -> list[int]:
    """floor(256 x) of doubles of any size, exactly."""
    return [math.floor(SCALE * a) if abs(a) < 1e300 else SCALE * int(a) for a in x.tolist()]


def _block(has: np.ndarray, ids: np.ndarray, width: int, vectors: bytes, k: int) -> tuple:
    n = len(ids)
    lower = b"" if width == 0 else bytes(2 * n * k)
    return n, has.tobytes(), ids.astype("<i8").tobytes(), width, vectors, bytes(4 * n), np.full(n, np.inf, "<f4").tobytes(), lower, 0


def _out(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, k: int) -> Iterator[pa.RecordBatch]:
    limit = narrow_limit(dims)
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            ids = part.column("vec_id")
            has, ids = np.asarray(ids.is_valid()), ids.fill_null(0).to_numpy()
            x = part.column("x").flatten().to_numpy().reshape(-1, dims)
            small = np.abs(x).max(1, initial=0) <= limit // SCALE
            rows = []
            if small.any():
                v = np.floor(SCALE * x[small]).astype(np.int64)
                peak = int(np.abs(v).max(initial=0))
                width = 2 if peak < 1 << 15 else 4 if peak < 1 << 31 else 8
                rows.append(_block(has[small], ids[small], width, v.astype(f"<i{width}").tobytes(), k))
            for i in np.flatnonzero(~small):
                rows.append(_block(has[[i]], ids[[i]], 0, ",".join(map(str, components(x[i]))).encode(), k))
            if rows:
                yield _out(rows)


def _vectors(row: dict) -> np.ndarray | list[list[int]]:
    if row["width"]:
        return np.frombuffer(row["vectors"], f"<i{row['width']}").astype(np.int64).reshape(row["n"], -1)
    return [[int(a) for a in row["vectors"].decode().split(",")]]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _round(batches: Iterator[pa.RecordBatch], to: Centroids) -> Iterator[pa.RecordBatch]:
    small = narrow(to.rows)
    for row in _rows(batches):
        v = _vectors(row)
        if row["width"] and small:
            cluster = np.frombuffer(row["cluster"], "<i4").astype(np.int64)
            upper = np.frombuffer(row["upper"], "<f4").astype(np.float64)
            lower = unpack_lower(row["lower"], row["n"])
            row["computed"] = assign(v, cluster, upper, lower, to)
            with np.errstate(over="ignore"):
                row |= {"cluster": cluster.astype("<i4").tobytes(), "upper": (upper * (1 + 1e-6)).astype("<f4").tobytes(), "lower": pack_lower(lower)}
        else:
            v = v.tolist() if row["width"] else v
            row |= {"cluster": np.array(_assign_wide(v, to), "<i4").tobytes(), "upper": np.full(row["n"], np.inf, "<f4").tobytes(), "lower": bytes(len(row["lower"])), "computed": len(v) * len(to.rows)}
        yield _out([tuple(row[c] for c in _NAMES)])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task: (cluster, component, limb, value); component -1 counts. A sum is its limbs of 40 bits, the last one signed."""
    total: dict[int, list[int]] = {}
    for row in _rows(batches):
        cluster = np.frombuffer(row["cluster"], "<i4")
        v = _vectors(row)
        for j in np.unique(cluster).tolist():
            mine = np.flatnonzero(cluster == j)
            got = [len(mine), *(v[mine].sum(0).tolist() if row["width"] else v[0])]
            total[j] = [a + b for a, b in zip(total[j], got, strict=True)] if j in total else got
    out: list[tuple[int, int, int, int]] = []
    for j, values in total.items():
        for d, value in enumerate(values, -1):
            limb = 0
            while not -(1 << _LIMB) < value < 1 << _LIMB:
                out.append((j, d, limb, value & ((1 << _LIMB) - 1)))
                value >>= _LIMB
                limb += 1
            out.append((j, d, limb, value))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "component", "limb", "value"])


def _moved(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The floor of the mean of each centroid's vectors; one without vectors stays."""
    parts = state.select("n", "width", "vectors", "cluster").mapInArrow(_sums, "cluster int, component int, limb int, value long")
    told: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("cluster", "component", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():  # centroids x components
        key = (r["cluster"], r["component"])
        told[key] = told.get(key, 0) + (int(r["value"]) << (_LIMB * r["limb"]))
    return [[told[j, d] // told[j, -1] for d in range(len(c))] if (j, -1) in told else c for j, c in enumerate(centroids)]


def _told(batches: Iterator[pa.RecordBatch], rows: list[list[int]]) -> Iterator[pa.RecordBatch]:
    small = narrow(rows)
    for row in _rows(batches):
        cluster = np.frombuffer(row["cluster"], "<i4")
        v = _vectors(row)
        if row["width"] and small:
            d = ((v - np.array(rows, np.int64)[cluster]) ** 2).sum(1).tolist()
        else:
            d = [min(_square(list(map(int, x)), rows[j]), LONG_MAX) for x, j in zip(v, cluster.tolist(), strict=True)]
        ids = pa.array(np.frombuffer(row["ids"], "<i8"), mask=~np.frombuffer(row["has_id"], bool))
        yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, x array<double>): exactly ``dims`` components, none null, NaN or infinite."""
    x = F.col("embedding").cast("array<double>")
    odd = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.select("vec_id", x.alias("x")).where((F.size("x") == dims) & ~odd)


def cluster_vectors(vectors: DataFrame, *, k: int = 40, rounds: int = 5, dims: int = 64, salt: str = "2:") -> DataFrame:
    """K-means of ``vectors`` (vec_id, embedding) in integers: components are floor(256 x).

    The first centroids are the ``k`` vectors of the smallest sha256 of ``salt`` and
    vec_id; each of ``rounds`` assigns all vectors to the nearest (ties: smaller number)
    and moves every centroid to the floor of its vectors' mean, an empty one not at all.
    Then all are assigned once more. Null vectors, other lengths and null or non-finite
    components take no part. Repeated vec_ids are a vector each and may each be a seed
    (ties by the vector); a row without vec_id is assigned but is no seed. With fewer
    than ``k`` vectors there are as many centroids; without any, no row. Components of
    any size are exact; a distance or sum past 63 bits is told as 2**63 - 1. Other
    columns, of whatever name, are not read.
    Returns vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kept = usable(vectors, dims)
    hashed = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    seeds = kept.where("vec_id IS NOT NULL").withColumn("h", hashed).orderBy("h", "x").limit(k).select("x").collect()
    rows = [components(np.array(r["x"], np.float64)) for r in seeds]
    if not rows:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    state = kept.mapInArrow(partial(_blocks, dims=dims, k=len(rows)), STATE)
    to = Centroids.of(rows)
    for _ in range(rounds):
        state = materialise(state.mapInArrow(partial(_round, to=to), STATE))
        rows = _moved(state, to.rows)
        to = Centroids.of(rows, to.rows)
    state = state.mapInArrow(partial(_round, to=to), STATE)
    told = materialise(state.mapInArrow(partial(_told, rows=rows), "vec_id long, cluster int, distance long"))
    each = {r["cluster"]: int(r["d"]) for r in told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # one row a centroid
    total = min(sum(each.values()), LONG_MAX)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in rows]
    facts = spark.createDataFrame([(j, min(d, LONG_MAX), total, digest[j]) for j, d in each.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return told.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
