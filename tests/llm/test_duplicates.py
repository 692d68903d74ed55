from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from lawloom.llm.components import connected_components
from lawloom.llm.common import materialise
from lawloom.llm.jaccard_join import SIGNED, _sign, forest_links, keep_one, shortest_prefix, similar_documents, subtree_links
from lawloom.llm.repeats import anchors, radix_groups, remove_repeats, Hashed
from lawloom.llm.unit_dedup import remove_units, repeated_units


def words(t):
    return re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", t.lower()).split()


def shingles(t):
    w = words(t)
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(2, 7))) for _ in range(300)]
    docs = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(n)]
    for i in range(n):
        w = docs[rng.randrange(n)].split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append(" ".join(w))
    return docs + ["", None, "  ", "One two three.", "one, TWO three", docs[0], docs[0].upper(), "x " * 4000]


def frame(spark, docs, extra="lang"):
    return spark.createDataFrame([(i, t, "z") for i, t in enumerate(docs)], f"doc_id long, text string, {extra} string")


def brute_links(docs, threshold=0.8):
    sets = [shingles(t or "") for t in docs]
    n, root = [0] * len(docs), list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and both >= threshold * (len(a) + len(sets[j]) - both) - 1e-9:
                n[i] += 1
                n[j] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return n, [find(i) for i in range(len(docs))]


def test_shortest_prefix():
    assert shortest_prefix(0.8, 24, 8, 0.9999) == 5 and shortest_prefix(0.8, 24, 8, 0.5) == 8 and shortest_prefix(0.8, 1, 8, 0.9999) == 1


@pytest.mark.parametrize("how", [{}, {"block_docs": 4}, {"node_docs": 2}])
def test_similar_documents(spark, how):
    docs = corpus()
    got = {r.doc_id: r for r in similar_documents(frame(spark, docs), **how).collect()}
    links, classes = brute_links(docs)
    assert len(got) == len(docs)
    assert [got[i].n_links for i in range(len(docs))] == links
    assert [got[i].class_id for i in range(len(docs))] == classes


def test_subtree_links_are_the_single_links_of_each_level():
    rng = np.random.default_rng(5)
    sig = rng.integers(0, 3, (40, 6)).astype(np.uint16)
    docs = np.arange(40)
    found = subtree_links(docs, sig[:, :3], sig, 0.5, 1)
    for level in (3, 2, 1):
        root = list(range(40))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        brute = [(i, j) for i in range(40) for j in range(i) if (sig[i, :level] == sig[j, :level]).all() and (sig[i] == sig[j]).mean() >= 0.5]
        for i, j in brute:
            root[find(i)] = find(j)
        want = [find(i) for i in range(40)]
        root = list(range(40))
        for i, j, n, s in found:
            assert s == (sig[i] == sig[j]).mean() and (sig[i, :n] == sig[j, :n]).all()
            if n >= level:
                root[find(i)] = find(j)
        got = [find(i) for i in range(40)]
        assert [[a == b for b in want] for a in want] == [[a == b for b in got] for a in got]


def edited(n, changes, seed):
    """Pairs of texts of 200 words, ``changes`` of them different."""
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        w = [f"t{i}w{j}" for j in range(200)]
        docs.append(" ".join(w))
        for j in rng.sample(range(200), changes):
            w[j] = "other"
        docs.append(" ".join(w))
    return docs


def test_prefixes_are_shortened_as_far_as_the_data_need(spark):
    def depth(docs):
        signed = materialise(frame(spark, docs).select("doc_id", "text").mapInArrow(lambda b: _sign(b, 24, 8), SIGNED))
        links, level = forest_links(signed.select("doc_id", "sig"), threshold=0.8, trees=24, depth=8, recall=0.9999, node_docs=4096)
        return level, {(r.a // 2, r.b // 2) for r in links.collect()}

    level, found = depth(edited(400, 1, 1))
    assert level > 5 and found >= {(i, i) for i in range(400)}
    level, found = depth(edited(400, 4, 2))
    assert level == 5 and found >= {(i, i) for i in range(400)}
    assert depth(["nothing alike here today", "and nothing like that there"])[0] == 5


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(90):
        w = list(base)
        w[rng.randrange(200)] = f"own{i}"
        docs.append(" ".join(w))
    got = similar_documents(frame(spark, docs), block_docs=16).collect()
    links, _ = brute_links(docs)
    assert {r.class_id for r in got} == {0} and {r.doc_id: r.n_links for r in got} == dict(enumerate(links))


def test_keep_one_keeps_columns_and_rows_without_id(spark):
    df = frame(spark, ["a b c d e f", "a b c d e f", "other text"], "class_id").unionByName(spark.createDataFrame([(None, "a b c d e f", "z")], "doc_id long, text string, class_id string"))
    kept = keep_one(df)
    assert kept.columns == ["doc_id", "text", "class_id"]
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 0, 2]
    assert similar_documents(df.where("false")).collect() == []
    twice = df.where("doc_id = 0").unionByName(df.where("doc_id = 0"))
    assert [(r.doc_id, r.n_links) for r in similar_documents(twice).collect()] == [(0, 0)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(30)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}


def brute_repeats(docs, length=50):
    texts = [(t or "").encode() for t in docs]
    first: dict[bytes, int] = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], i)
    out = {}
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_remove_repeats(spark):
    rng = random.Random(5)
    docs = corpus(4, 25)
    shared = "".join(rng.choices("abc dé\n", k=400))
    for cut in (49, 50, 51, 80, 399):
        a = rng.randrange(400 - cut)
        docs += ["head " * rng.randint(0, 9) + shared[a : a + cut] + " tail" * rng.randint(0, 9) for _ in range(3)]
    docs += ["ab" * 500, "ab" * 300, "a" * 49, "a" * 49, "a" * 120, "x" + "a" * 60, "日本語" * 30, "日本語" * 17]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(frame(spark, docs, "spans")).collect()}
    want = brute_repeats(docs)
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}
    small = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(frame(spark, docs), group_anchors=3).collect()}
    assert small == want
    texts = {r.doc_id: r for r in remove_repeats(frame(spark, docs), keep_text=True).collect()}
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(b - a for a, b in r.removed) == r.n_removed for r in texts.values())


def test_remove_repeats_of_odd_tables(spark):
    assert remove_repeats(frame(spark, [])).collect() == []
    twice = frame(spark, ["q" * 70]).unionByName(frame(spark, ["q" * 70])).unionByName(spark.createDataFrame([(None, "q" * 70, "z")], "doc_id long, text string, lang string"))
    assert [(r.doc_id, r.n_removed) for r in remove_repeats(twice).collect()] == [(0, 0)]


def test_anchors_cover_every_window():
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 100, n).astype(np.uint8) for n in (10, 49, 50, 51, 300, 0, 77)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    at = anchors(Hashed(np.concatenate(texts)), offsets, 50)
    for a, b in zip(offsets, offsets[1:], strict=False):
        for k in range(a, b - 49):
            assert ((at >= k) & (at + 20 <= k + 50)).any()


def test_radix_groups_are_the_equal_rows():
    rng = np.random.default_rng(2)
    rows, group = rng.integers(0, 2, (300, 10)).astype(np.uint8), rng.integers(0, 3, 300)
    found = radix_groups(group, rows)
    keys = [(int(g), r.tobytes()) for g, r in zip(group, rows, strict=True)]
    counts = Counter(keys)
    assert all((f >= 0) == (counts[k] > 1) for f, k in zip(found, keys, strict=True))
    assert len({(f, k) for f, k in zip(found.tolist(), keys, strict=True) if f >= 0}) == len({f for f in found.tolist() if f >= 0}) == len([k for k in counts if counts[k] > 1])


def test_anchors_beyond_the_bits_of_a_place(monkeypatch):
    from lawloom.llm import repeats

    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 99 + i % 20, n).astype(np.uint8) for i, n in enumerate([40, 3000, 50, 49, 700, 0, 128, 1])]
    offsets, hashed = np.concatenate([[0], np.cumsum([len(t) for t in texts])]), Hashed(np.concatenate(texts))
    least = lambda w, bits: min(range(w, w + 31), key=lambda g: (int(hashed.of(np.array([g]), np.array([g + 20]))[0]) >> bits, g))
    for bits in (6, 7, 10):
        monkeypatch.setattr(repeats, "_PLACE_BITS", bits)
        want = {least(w, bits) for a, b in zip(offsets[:-1], offsets[1:], strict=True) for w in range(a, b - 49)}
        assert anchors(hashed, offsets, 50).tolist() == sorted(want)


def test_units(spark):
    line, sentence = "This line is said in many documents", "And this is a sentence of nine words here."
    docs = [f"Own words of first.\n{line}\n{sentence} Rest one of the first.", f"{line.upper()}!\nOther é words 😀. {sentence}", "too short\nline", "too short\nline", None, ""]
    df = frame(spark, docs, "start")
    rows = {(r.doc_id, docs[r.doc_id][r.start : r.end], r.first_doc_id) for r in repeated_units(df).collect()}
    assert rows == {(1, line.upper() + "!", 0), (1, sentence, 0), (3, "too short", 2), (3, "line", 2)}
    assert {r.doc_id for r in repeated_units(df, line_words=5).collect()} == {1}
    cleaned = {r.doc_id: r.text for r in remove_units(df, repeated_units(df)).collect()}
    assert cleaned[1] == "\nOther é words 😀. " and cleaned[0] == docs[0] and cleaned[4] is None and cleaned[3] == "\n"
    assert remove_units(df.withColumn("removed_spans", df.start), repeated_units(df)).columns == [*df.columns, "removed_spans"]
    assert repeated_units(df.where("false")).collect() == []
    again = frame(spark, [docs[0]]).unionByName(frame(spark, [docs[0]]))
    assert repeated_units(again).collect() == []


def test_windows_of_a_passage_in_every_document_are_sent_once_a_task():
    import pyarrow as pa

    from lawloom.llm.repeats import _OPEN, _windows

    length, text = 50, bytes(range(65, 145))
    rows = [(7, doc, 30, None, 30, 50, text) for doc in range(300)] + [(7, 300, 30, None, 30, 50, text[:-1] + b"!")]
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OPEN, strict=True)], schema=_OPEN)
    got = pa.Table.from_batches(list(_windows(iter([batch]), length))).to_pylist()
    sent = [r for r in got if r["window"] is not None]
    assert [r["doc_id"] for r in sent] == [0] * 31 + [300]
    assert sorted((r["within"], r["start"], r["end"]) for r in sent if r["doc_id"] == 0) == [(d, 30 - d, 80 - d) for d in range(31)]
    assert sorted((r["doc_id"], r["start"], r["end"]) for r in got if r["window"] is None) == [(d, 0, 80) for d in range(1, 300)] + [(300, 0, 79)]


def test_anchors_of_a_large_group_are_two_rows_a_cut_whatever_their_windows():
    import pyarrow as pa

    from lawloom.llm.repeats import _CUT, _cut, _settle

    length, rng = 50, random.Random(3)
    gram = bytes(range(97, 117))
    around = [bytes(rng.choices(range(65, 91), k=30)) + gram + bytes(rng.choices(range(65, 91), k=30)) for _ in range(200)]
    around += [around[0][:9] + around[1][9:30] + gram + around[2][50:59] + around[3][59:], b"-" * 30 + gram + around[4][50:], around[5][:50] + b"+" * 30, around[6][:19] + around[1][19:30] + gram + b"?" * 30]
    around += [b"." * 11 + around[7][11:61] + b"." * 19, b"." * 12 + around[8][12:61] + b"." * 19]
    rows = [(7, doc, 30, 30, 50, text, 0, 30) for doc, text in enumerate(around)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CUT, strict=True)], schema=_CUT)
    found: set[tuple] = set()
    parts = [batch]
    for _ in range(3):
        parts = list(_cut(iter(parts), length))
        cut = pa.Table.from_batches(parts)
        settled = list(_settle(iter(cut.sort_by("group").to_batches()), length))
        found = {(r["doc_id"], r["start"], r["end"]) for r in pa.Table.from_batches(settled).to_pylist()}
        assert found >= {(201, 30, 80), (202, 0, 50), (204, 11, 61)} and {d for d, _, _ in found} == {201, 202, 204}
    assert next(_cut(iter([batch]), length)).num_rows == 2 * len(rows)
