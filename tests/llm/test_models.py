from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lawloom.llm import ann
from lawloom.llm.common import Words
from lawloom.llm.toxicity import WIDTHS, Model, fit, fused, keep_clean, parts, pooled, score_documents

STOP = ["und", "der", "wort", "satz", "noch", "mehr", "hier"]


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abdefgilmnorstu", k=rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        w = rng.choices(vocabulary, k=rng.randint(1, 80))
        bad = rng.random() < 0.3
        if bad:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w) + 1), rng.choice(["vilest", "wretch", "schuft" + rng.choice(vocabulary)]))
        rows.append((i, " ".join(w), rng.choice(["en", "de"]), int(bad)))
    return rows


def test_pooling_is_the_largest_convolution():
    rng = np.random.default_rng(1)
    model = Model(rng.normal(size=(3, 1 << 15, 4)).astype(np.float32), rng.normal(size=(4, 6 * 2)).astype(np.float32), np.ones(6), 0.0, 2)
    texts = ["one two three four", "", "solo", "a b", "five six seven eight nine ten"]
    words = Words(pa.array(texts))
    p = parts(words)
    got = pooled(fused(model), p, words.bounds, 2)
    vec = sum(model.embeddings[c][p[c]] for c in range(3))
    for d in range(len(texts)):
        v, column = vec[words.bounds[d] : words.bounds[d + 1]], 0
        for k, width in enumerate(WIDTHS):
            for f in range(2):
                best = max([0.0, *(sum(float(v[i + j] @ model.filters[:, column + j * 2 + f]) for j in range(width)) for i in range(len(v) - width + 1))])
                assert abs(got[d, k * 2 + f] - best) < 1e-3
            column += width * 2


def test_toxicity(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, lang, 0.5) for i, t, lang, _ in rows] + [(1000, None, None, 0.1), (1001, "", "en", 0.1), (1002, "x " * 20000, "en", 0.1)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, 0, y) for i, _, _, y in rows] + [(5, 0, None), (None, 0, 1), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    model = fit(df, labels)
    got = {r.doc_id: r for r in score_documents(df, model).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got.values())
    held = [(i, y) for i, _, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i].score >= 0.3) == bool(y) for i, y in held)
    assert len(held) > 60 and right / len(held) > 0.93
    kept = keep_clean(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.rejected}
    assert {1000, 1001, 1002} <= {r.doc_id for r in kept.collect()}
    clashing = df.selectExpr("*", "lang AS __score", "lang AS score_", "lang AS rejected")
    assert keep_clean(clashing, model).columns == clashing.columns and keep_clean(clashing.unionByName(clashing), model).count() == 2 * kept.count()
    nameless = df.limit(1).selectExpr("CAST(NULL AS long) AS doc_id", "text", "lang", "score")
    assert score_documents(df.unionByName(nameless), model).where("doc_id IS NULL").count() == 1
    doubled = fit(df.unionByName(df.selectExpr("doc_id", "concat('!', text) AS text", "lang", "score")), labels)
    assert np.array_equal(doubled.weights, fit(df, labels).weights)
    swapped = df.selectExpr("doc_id + 7 AS doc_id", "text", "'zz' AS lang", "score")
    again = {r.doc_id - 7: r.score for r in score_documents(swapped, model).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-12 for i in again)


def test_toxicity_trains_on_all_labelled_rows(spark):
    rows = corpus(900, seed=3)
    learnable = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    df = spark.createDataFrame([(i, t, lang, y) for i, t, lang, y in rows], "doc_id long, text string, lang string, toxic int")
    by_hash = [r.doc_id for r in df.orderBy("doc_id").selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h").collect() if r.doc_id in set(learnable)]
    # a word that tells toxic rows, in none of the first hashes
    late = set(by_hash[300:])
    words = {i: "zyxxyz " * (y and i in late) for i, _, _, y in rows}
    marked = spark.createDataFrame([(i, words[i] + t, lang, y) for i, t, lang, y in rows], "doc_id long, text string, lang string, toxic int")
    model = fit(marked, marked.select("doc_id", "toxic"), block_rows=100)
    bucket = parts(Words(pa.array(["zyxxyz"])))[0, 0]
    assert model.embeddings[0, bucket, 0] > 0.3 and np.isfinite(model.embeddings).all()
    got = {r.doc_id: r.score for r in score_documents(marked, model).collect()}
    held = [(i, y) for i, _, _, y in rows if i not in set(learnable)]
    assert sum((got[i] >= 0.3) == bool(y) for i, y in held) / len(held) > 0.93
    again = fit(marked.repartition(3), marked.select("doc_id", "toxic"), block_rows=100)
    assert np.array_equal(again.embeddings, model.embeddings) and again.thresholds == model.thresholds


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert keep_clean(df, fit(df, none)).count() == 1 and score_documents(df.where("false"), fit(df, none)).collect() == []


def brute(rows, queries, k=5):
    good = {i: np.array(e, float) for i, e in rows if e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)}
    out = {}
    for q in queries:
        if q in good:
            scored = sorted((-round(float(good[q] @ v / (np.linalg.norm(good[q]) * np.linalg.norm(v))), 12), i) for i, v in good.items() if i != q)
            out[q] = [i for _, i in scored[:k]]
    return out


@pytest.mark.parametrize("n", [3, 60, 1500])
def test_nearest(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in rng.normal(size=16)]) for i in range(n)]
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, [1.0, None, *[0.0] * 14]), (n + 4, [float("inf"), *[0.0] * 15])]
    rows += [(10_000 + i, rows[0][1]) for i in range(40)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    queries = df.where("vec_id % 50 = 0")
    got: dict[int, list] = {}
    for r in sorted(ann.nearest(df, queries, block=64).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    as_floats = [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for i, e in rows]
    want = brute(as_floats, [i for i, _ in rows if i % 50 == 0])
    assert set(got) == set(want)
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits / sum(map(len, want.values())) >= (0.9 if n > 1000 else 1.0)
    assert got[0] == [10_000, 10_001, 10_002, 10_003, 10_004]


def test_nearest_with_lists_of_several_words(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict[int, set] = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), sample_rows=256, lists=200, least=300).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(rows, range(0, 600, 50))
    assert sum(len(got[q] & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def test_repeated_ids_and_ties(spark):
    rng = np.random.default_rng(9)
    near = [1.0, 0.5, 0.25, 0.125]
    rows = [(0, near), (7, [9.0, 0.0, 0.0, 0.0]), (7, [-9.0, 0.0, 0.0, 0.0]), (0, [2.0, 1.0, 0.5, 0.25])]
    rows += [(i, [x * 2.0 ** (i % 5) for x in near]) for i in rng.permutation(np.arange(100, 300)).tolist()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id) for r in ann.nearest(df, df.where("vec_id = 0"), rerank=8).orderBy("rank").collect()]
    assert got == [(1, 100), (2, 101), (3, 102), (4, 103), (5, 104)]
    got = ann.nearest(df.where("vec_id IN (0, 7)"), df.where("vec_id = 0")).collect()
    assert [(r.vec_id, round(r.score, 3)) for r in got] == [(7, -round(1.0 / 1.328125**0.5, 3))]


def test_nearest_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert ann.nearest(df, df).collect() == []


def test_beam_search_beats_greedy():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book = ann.fit(x, 16, books=4, words=16)
    errors = []
    for beam in (1, 8):
        codes, norms = ann.encode(book, x, beam=beam)
        sums = book.words[codes].sum(1)
        assert np.allclose((sums**2).sum(1), norms, atol=1e-3)
        errors.append(float(((x - sums) ** 2).sum(1).mean()))
    assert errors[1] < errors[0] < 0.5


def test_few_vectors_are_scored_exactly(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in rng.normal(size=32)]) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    met = []
    kept = ann.candidates

    def counting(scanned, rerank):
        out = kept(scanned, rerank).persist()
        met.extend(r["count"] for r in out.groupBy("query_id").count().collect())
        return out

    monkeypatch.setattr(ann, "candidates", counting)
    got: dict[int, set] = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), block=64).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(met) == 80 and max(met) <= 0.06 * len(rows)
    want = brute(rows, range(0, 4000, 50))
    assert sum(len(got[q] & set(want[q])) for q in want) >= 0.9 * 5 * len(want)
