from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lawloom.llm.elkan import LONG_MAX, Centroids, assign, cluster_vectors, pack_lower, unpack_lower
from lawloom.llm.harmonic import Bins, class_cuts, class_lengths, pack_harmonic
from lawloom.llm.queries import vocabulary_file
from lawloom.llm.tokens import encoder

BYTE = vocabulary_file("byte_bpe_50k.json")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4000), max_size=30), st.sampled_from([1, 6, 16, 100, 1024]))
def test_bins_hold_each_id_once_and_no_padding(lengths, size):
    docs = [np.arange(n, dtype="<u4") + 7 * i for i, n in enumerate(lengths)]
    bins = Bins(size, 5)
    rows = [r for i, d in enumerate(docs) for r in bins.add(i, d.tobytes())] + list(bins.close())
    fill, spans = Counter(), defaultdict(list)
    for doc, start, length, crc, n, sequence, offset in rows:
        assert crc == zlib.crc32(docs[doc][start : start + length].tobytes()) and n == len(docs[doc])
        assert offset == fill[sequence]
        fill[sequence] += length
        spans[doc].append((start, start + length))
    for doc, found in spans.items():
        found.sort()
        assert found[0][0] == 0 and found[-1][1] == len(docs[doc]) and all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))
    assert all(f == size or f & (f - 1) == 0 for f in fill.values())
    assert sum(f != size for f in fill.values()) <= size.bit_length()


def test_classes_divide_the_sequence():
    assert class_lengths(12) == [12, 6, 4, 3, 2, 1]
    assert class_cuts(23, class_lengths(12)) == [12, 6, 4, 1]
    assert sum(class_cuts(1023, class_lengths(1024))) == 1023


def test_packing_of_odd_rows(spark):
    rows = [(1, "hello world", 1), (None, "a", 2), (2, None, 3), (3, "", 4), (3, "", 4), (4, "word " * 30000, 5)] + [(9, "same text here", 6)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)
    got = pack_harmonic(df, BYTE, size=64).collect()
    pieces, fill = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in fill.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        total = sum(n for _, n in spans)
        assert total == 64 or total & (total - 1) == 0
    for doc, text, copies in [(1, "hello world", 1), (None, "a", 1), (2, "", 1), (3, "", 2), (4, "word " * 30000, 1), (9, "same text here", 50)]:
        ids = np.array([*encoder(BYTE).whole.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert sum(r["length"] for r in pieces[doc]) == copies * len(ids)
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in pieces[doc])
    assert pack_harmonic(spark.createDataFrame([], "doc_id long, text string"), BYTE).collect() == []


# --- Elkan ------------------------------------------------------------------------------


def plain(rows, k, rounds, dims):
    """(vec_id, cluster, distance) by every distance, in Python's integers."""
    kept = [(i, [math.floor(256 * x) if abs(x) < 1e300 else 256 * int(x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = [(hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None]
    centroids = [v for _, v in sorted(named)[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda j: (square(v, centroids[j]), j))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)].append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if groups[j] else c for j, c in enumerate(centroids)]
    told = [(i, (j := nearest(v)), square(v, centroids[j])) for i, v in kept]
    sums = Counter()
    for _, j, d in told:
        sums[j] += d
    top = lambda x: min(x, LONG_MAX)
    return sorted(((i, j, top(d), top(sums[j]), top(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, j, d in told), key=repr)


def check(spark, rows, element="double", **how):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], f"vec_id long, embedding array<{element}>, distance int").repartition(3)
    got = sorted((tuple(r) for r in cluster_vectors(df, **how).collect()), key=repr)
    assert got == plain(rows, how["k"], how["rounds"], how["dims"])
    return got


def test_ties_repeats_and_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    grid = [(i, [float(i % 5), float(i // 5 % 4), -1.5]) for i in range(60)]
    odd = [(100, None), (101, [1.0, 2.0]), (102, [1.0, None, 2.0]), (103, [nan, 0.0, 0.0]), (104, [inf, 0.0, 0.0]), (None, [0.5, 0.5, 0.5]), (3, [3.0, 0.0, -1.5]), (3, [9.0, 9.0, 9.0])]
    assert len(check(spark, grid + odd, k=7, rounds=4, dims=3)) == 63
    check(spark, [(i, [1.0, 1.0]) for i in range(30)], k=4, rounds=2, dims=2)  # all alike: ties to 0
    check(spark, grid[:3], k=40, rounds=2, dims=3)  # fewer than k


def test_components_of_any_size(spark):
    rows = [(1, [1e308, 0.0]), (2, [-1e308, 1.0]), (3, [1e20, 3.0]), (4, [0.1, 0.2]), (5, [5e15, -2.0]), (6, [-0.001, 7.0])]
    check(spark, rows, k=3, rounds=3, dims=2)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cluster_vectors(empty).collect() == []
    assert cluster_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(2, 12), st.sampled_from([2, 30, 10**7]))
def test_bounds_never_change_an_assignment(seed, k, spread):
    rng = np.random.default_rng(seed)
    v = rng.integers(-spread, spread + 1, (200, 3))
    c = v[:k].tolist()
    cluster, upper, lower = np.zeros(200, np.int64), np.full(200, np.inf), np.zeros((200, k))
    to = Centroids.of(c)
    for _ in range(6):
        assign(v, cluster, upper, lower, to)
        assert cluster.tolist() == ((v[:, None] - np.array(to.rows)[None]) ** 2).sum(2).argmin(1).tolist()
        lower, upper = unpack_lower(pack_lower(lower), 200), (upper * (1 + 1e-6)).astype(np.float32).astype(np.float64)
        to = Centroids.of([[int(x) for x in v[cluster == j].sum(0) // (cluster == j).sum()] if (cluster == j).any() else r for j, r in enumerate(to.rows)], to.rows)


def test_bounds_save_distances():
    """Vectors in clear groups: later rounds compute a small part of all distances."""
    rng = np.random.default_rng(7)
    centres = rng.integers(-20000, 20000, (20, 16))
    v = centres[rng.integers(0, 20, 2000)] + rng.integers(-50, 50, (2000, 16))
    cluster, upper, lower = np.zeros(2000, np.int64), np.full(2000, np.inf), np.zeros((2000, 20))
    to, counts = Centroids.of(v[:20].tolist()), []
    for _ in range(4):
        counts.append(assign(v, cluster, upper, lower, to))
        to = Centroids.of([[int(x) for x in v[cluster == j].sum(0) // (cluster == j).sum()] if (cluster == j).any() else r for j, r in enumerate(to.rows)], to.rows)
    assert counts[-1] < 0.1 * v.shape[0] * 20


@pytest.mark.parametrize("x", [0.0, 1e-9, 3.7, 1e9])
def test_lower_bounds_round_down(x):
    got = unpack_lower(pack_lower(np.array([[x]])), 1)[0, 0]
    assert got <= x and got >= 0.99 * x - 1e-30
