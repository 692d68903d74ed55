from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lawloom.llm import phrases
from lawloom.llm.phrases import before, collocations, cut, frequent_phrases, merge, merge_ranges, pack, shard_trie, shard_tries, unpack, windows


def counted(texts, longest=5):
    """Occurrences of all phrases of (lang, text), plainly; words of each language."""
    f, n = Counter(), Counter()
    for lang, text in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f["und" if lang is None else lang, tuple(w[i : i + m])] += 1
    return f, n


def ranked(texts, least, longest=5, percent=100, top=2000):
    f, n = counted(texts, longest)
    some = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    longer = Counter()
    for (lang, p), a in some.items():
        for s in range(2, len(p)):
            for i in range(len(p) - s + 1):
                longer[lang, p[i : i + s]] = max(longer[lang, p[i : i + s]], a)
    rows = []
    for (lang, p), a in some.items():
        if (lang, p) in longer and longer[lang, p] * 100 >= a * percent:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        rows.append((lang, -score, -a, b" ".join(p), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    out, seen = [], Counter()
    for lang, score, a, p, left, right, words in sorted(rows):
        seen[lang] += 1
        if seen[lang] <= top:
            out.append((lang, seen[lang], p.decode(), -a, left, right, words, -score))
    return out


def found(df):
    return sorted(tuple(r) for r in df.collect())


TEXTS = [
    ("en", "Of the people, by the people; for THE people shall not perish from the earth"),
    ("en", "of the people of the people of the people of the people"),
    ("en", "a a a a a a a. a a a\na\ta  a"),
    (None, "of the people"),
    (None, None),
    ("en", ""),
    ("en", " \t\n.,;"),
    ("xx", "été Été ÉTÉ été été \x01 \x01 été"),
    ("", "of the people of the people"),
    ("en", "of the people " * 400),
    ("en", "x" * 5000),
] + [("en", "one two three four five six")] * 7


@pytest.mark.parametrize("least,percent,top", [(1, 100, 2000), (2, 100, 5), (3, 50, 2000)])
def test_ranking_is_brute_force(spark, least, percent, top):
    rows = [(i, lang, text, 9) for i, (lang, text) in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, phrase int").repartition(3)
    assert found(collocations(df, least=least, percent=percent, top=top)) == ranked(TEXTS, least, percent=percent, top=top)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert collocations(df).collect() == []
    assert collocations(spark.createDataFrame([(1, None, None)], "doc_id long, lang string, text string")).collect() == []


words = st.lists(st.sampled_from(["a", "b", "ab", "É", "x.", ",", "A"]), max_size=40).map(" ".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(words, min_size=1, max_size=6), st.integers(5, 60), st.integers(1, 3), st.data())
def test_tries_cut_and_merged_are_the_counts(texts, limit, low, data):
    """Any windows of the texts, cut at any bounds, sum to what plain counting gives."""
    high = 3
    parts = [p for t in texts for p in windows(np.frombuffer(t.encode(), np.uint8), limit, high - 1)]
    tries = [shard_trie("en", [p], low, high, None)[0] for p in parts]
    assert sum(shard_trie("en", [p], low, high, None)[1] for p in parts) == counted([("en", t) for t in texts])[1]["en"]
    f = {p: a for (_, p), a in counted([("en", t) for t in texts], high)[0].items() if len(p) >= low}
    bounds = sorted(data.draw(st.sets(st.lists(st.sampled_from([b"a", b"ab", b"b", b"c", "é".encode()]), min_size=1, max_size=4).map(tuple), max_size=3)))
    got = Counter()
    for lo, hi in zip([None, *bounds], [*bounds, None], strict=True):
        pieces = []
        for t in tries:
            a = [0] * high if lo is None else before(t, lo)
            b = [len(x) for x in t.labels] if hi is None else before(t, hi)
            words_, ends, parents, labels, counts = pack(cut(t, a, b))
            pieces.append(unpack({"words": words_, "ends": ends, "parents": parents, "labels": labels, "counts": counts}))
        whole = merge(pieces) if pieces else None
        for d in range(high if whole else 0):
            for i, n in enumerate(whole.counts[d].tolist()):
                if n:
                    path = tuple(whole.path(d, i))
                    assert (lo is None or path >= lo) and (hi is None or path < hi)
                    got[path] += n
    assert got == f


def test_small_shards_and_ranges_change_nothing(spark):
    texts = spark.createDataFrame([("und" if lang is None else lang, t) for lang, t in TEXTS if t], "lang string, text string")
    tries = shard_tries(texts, 1, 2, shard_bytes=300)
    assert tries.count() > 10
    phrases.KEY_NODES, keep = 3, phrases.KEY_NODES
    try:
        whole = found(merge_ranges(tries, 2, range_nodes=20))
    finally:
        phrases.KEY_NODES = keep
    f, _ = counted([(lang, t) for lang, t in TEXTS], 2)
    assert whole == sorted((lang, b" ".join(p).decode(), len(p), a) for (lang, p), a in f.items() if a >= 2)


def test_a_full_pair_filter_loses_nothing(spark, monkeypatch):
    """With a filter that lets everything through, counts stay exact."""
    df = spark.createDataFrame([(lang, t) for lang, t in TEXTS], "lang string, text string")
    want = found(frequent_phrases(df, least=2)[0])
    monkeypatch.setattr(phrases, "pair_filter", lambda frequent: phrases.Pairs(16, np.full(1 << 13, 255, np.uint8)))
    assert found(frequent_phrases(df, least=2)[0]) == want


def test_scores_past_64_bits(spark):
    from lawloom.llm.phrases import scored_phrases

    n = 10**13
    frequent = spark.createDataFrame([("en", "a", 1, 10**12), ("en", "b", 1, 3), ("en", "a b", 2, 10**12)], "lang string, phrase string, m int, a long")
    row = scored_phrases(frequent, spark.createDataFrame([("en", n)], "lang string, n long"), 5).collect()[0]
    assert row["score"] == 1000 * 10**12 * n // (10**12 * 3)


def test_words_are_bytes_between_gaps():
    ids, starts, dictionary, room = phrases.tokens(np.frombuffer("b A\tÉé.c\x0bb".encode(), np.uint8))
    assert [dictionary[int(i)].as_py().decode() for i in ids] == ["b", "a", "Éé", "c", "b"]
    assert room.tolist() == [3, 2, 1, 1, 1] and starts.tolist() == [0, 2, 4, 9, 11]
    assert dictionary == pa.array([b"a", b"b", b"c", "Éé".encode()])


def test_a_task_holds_few_tries_at_once(spark):
    import glob
    import random

    import pyarrow.parquet as pq

    rng = random.Random(5)
    rows = [("en", " ".join(f"w{rng.randrange(3000)}" for _ in range(3000))) for _ in range(40)]
    tries = shard_tries(spark.createDataFrame(rows, "lang string, text string").coalesce(1), 1, 2, shard_bytes=1 << 13)
    files = [pq.ParquetFile(f).metadata for f in glob.glob(tries.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0] + "/*.parquet")]
    assert sum(f.num_rows for f in files) >= 40
    assert max(f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)) <= 4
