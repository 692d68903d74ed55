from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lawloom.llm.decontaminate import build_index, contaminated, fingerprints, keep_uncontaminated
from lawloom.llm.license_texts import NOTICES, TEXTS
from lawloom.llm.licenses import find_notices, scan_licenses, scorer
from lawloom.llm.pii import disclosing_terms, personal_data, sanitise


def words(t):
    return re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", t.lower()).split()


def shingles(w):
    return [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute_contaminated(docs, items, threshold=0.8):
    bags = {i: shingles(words(t)) for i, t in items}
    df = Counter(s for b in bags.values() for s in set(b))
    weigh = lambda s: 1 / (1 + math.log(df[s])) if s in df else 1.0
    out = {}
    for doc, text in docs:
        own = shingles(words(text or ""))
        for item, bag in bags.items():
            if not own or not bag:
                continue
            counts = Counter(bag)
            total = sum(weigh(s) * n for s, n in counts.items())
            n = min(len(bag), len(own))
            for p in range(len(own) - n + 1):
                here = Counter(own[p : p + n])
                common = sum(weigh(s) * min(k, counts[s]) for s, k in here.items())
                similarity = common / (total + sum(weigh(s) * k for s, k in here.items()) - common)
                if similarity >= threshold - 1e-9:
                    out[doc, item] = max(out.get((doc, item), 0), similarity)
    return out


def test_contaminated(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}é" for i in range(500)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 12, 20, 40, 40])))) for i in range(30)]
    items += [(30, items[5][1]), (31, " ".join(["same"] * 20)), (32, "")]
    docs = []
    for i in range(120):
        w = rng.choices(vocabulary, k=rng.randint(0, 60))
        if i % 2:
            put = items[rng.randrange(30)][1].split(" ")
            for _ in range(i % 5):
                if len(put) > 12:
                    put[rng.randrange(len(put))] = rng.choice(vocabulary)
            at = rng.randint(0, len(w))
            w[at:at] = put
        docs.append((i, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    docs += [(200, " ".join(["same"] * 25)), (201, None), (202, items[0][1]), (203, " ".join(vocabulary * 8 + items[7][1].split(" ")))]
    d = spark.createDataFrame([(*x, 1.0) for x in docs], "doc_id long, text string, similarity double")
    b = spark.createDataFrame(items + [(None, items[1][1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in contaminated(d, b).collect()}
    want = brute_contaminated(docs, items)
    assert set(got) == set(want)
    assert all(abs(got[k].similarity - want[k]) < 1e-9 for k in want)
    text = dict(docs)
    exact = next(k for k in want if want[k] == 1.0 and k[0] < 120)
    assert words(text[exact[0]][got[exact].start : got[exact].end]) == words(dict(items)[exact[1]])
    twice = spark.createDataFrame([(1, f"Head of it {items[8][1]} between the two {items[8][1]}")], "doc_id long, text string")
    first = contaminated(twice, b).where("item_id = 8").first()
    assert (first.start, first.end, first.similarity) == (11, 11 + len(items[8][1]), 1.0)
    kept = keep_uncontaminated(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    split = {(r.doc_id, r.item_id) for r in contaminated(d, b, part_items=7).collect()}
    assert split == set(want)
    again = d.unionByName(d).unionByName(spark.createDataFrame([(None, items[8][1], 1.0)], d.schema))
    found = [r.doc_id for r in contaminated(again, b).collect()]
    assert all(found.count(k) == 2 * len([1 for i, _ in want if i == k]) for k, _ in want) and None in found
    clash = d.withColumnRenamed("similarity", "item_id").selectExpr("*", "doc_id AS start", "text AS shingles")
    assert keep_uncontaminated(clash, b).columns == clash.columns and keep_uncontaminated(clash, b).count() == kept.count()
    assert contaminated(d.where("false"), b).collect() == [] == contaminated(d, b.where("false")).collect()
    assert keep_uncontaminated(d, b.where("false")).count() == len(docs)


def test_block_lists_find_all_within_the_radius():
    from lawloom.llm.decontaminate import _candidates

    rng = np.random.default_rng(3)
    rows = [(i, 20, [int(x) for x in rng.integers(0, 2**63, 16)], [1] * 16) for i in range(20)]
    index = build_index(rows, 20)
    theirs = index.by_size[20][1]
    flips = np.array([theirs[i % 20] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for i, k in enumerate(list(range(25)) * 8)], np.uint64)
    got = set(_candidates(index, 20, flips, 20))
    want = {(w, i) for w in range(len(flips)) for i in range(20) if bin(int(flips[w] ^ theirs[i])).count("1") <= 20}
    assert got == want
    assert fingerprints(np.array([5], np.uint64), np.array([1.0]), np.array([0]), np.array([1]))[0] == 5


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m[0])]


def odd_texts():
    rng = random.Random(9)
    alphabet = "a1.@+- ()é😀\n4"
    texts = ["a@b.c_d@e.f x@y.z.", "é😀 1.2.3.4 256.1.1.1 001.2.3.4", "4111 1111 1111 1111 +1 (212) 555-0100 +12 3", "+1-----", "\x01a@b.cc\x01", "", None, "1" * 3000, "a" * 20000 + "@", "99999999999999999999.1.1.1 0000000000000000001.1.1.1 0.0.0.0", "x@y.z " * 700, "(" * 500 + "+1" + "(" * 500]
    return texts + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(400)]


def test_base_spans(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in personal_data(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        spans = base(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t
        assert r.spans.startswith(joined)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in PATTERNS]
    assert personal_data(df.where("false")).collect() == []
    twice = df.where("doc_id = 0").unionByName(df.where("doc_id = 0")).unionByName(spark.createDataFrame([(None, "a@b.c", "z")], "doc_id long, text string, spans string"))
    assert sorted((r.doc_id is None, r.n_email) for r in personal_data(twice).collect()) == [(False, 3), (False, 3), (True, 1)]


def disclosure_corpus():
    docs = [f"note {i} about the chairman Quixotebury who wrote from boss@corp.example today" for i in range(5)]
    docs += [f"note {i} about the weather and the chairman of today" for i in range(60)]
    docs += ["call boss@corp.example"] * 4 + ["lonely@corp.example knows Zanzibarton"]
    return docs


def beside(text, start, end, context):
    before, after = text[max(0, start - context) : start], text[end : end + context]
    letter = lambda c: bool(re.match(r"[^\W\d_]", c))
    if start > context and letter(text[start - context - 1]):
        before = re.sub(r"^[^\W\d_]+", "", before)
    if end + context < len(text) and letter(text[end + context]):
        after = re.sub(r"[^\W\d_]+\Z", "", after)
    return before + " " + after


def brute_terms(docs, disclosure=0.8, support=1, letters=1, context=80):
    word = rf"[^\W\d_]{{{letters},}}"
    terms = [set(re.findall(word, d.lower())) for d in docs]
    n_t = Counter(t for s in terms for t in s)
    near = defaultdict(lambda: defaultdict(set))
    for i, d in enumerate(docs):
        for _, a, b in base(d):
            near[d[a:b].lower()][i] |= set(re.findall(word, beside(d, a, b, context).lower()))
    out = {}
    for e, where in near.items():
        if len({docs[i] for i in where}) < support:
            continue
        n_te = Counter(t for s in where.values() for t in s)
        texts = {t: len({docs[i] for i, s in where.items() if t in s}) for t in n_te}
        for t, n in n_te.items():
            share = math.log(n * len(docs) / (n_t[t] * len(where))) / math.log(len(docs) / len(where))
            if texts[t] >= support and share >= disclosure:
                out[e, t] = share
    return out


def test_disclosing_terms(spark):
    docs = disclosure_corpus()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for how in ({"support": 3, "letters": 4}, {}, {"context": 13}):
        got = {(r.entity, r.term): r.share for r in disclosing_terms(df, **how).collect()}
        want = brute_terms(docs, **how)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert (("boss@corp.example", "quixotebury") in got) == ("context" not in how) and ("boss@corp.example", "chairman") not in got
    spans = {r.doc_id: r for r in personal_data(df).collect()}
    at = docs[0].index("Quixotebury")
    assert f":{at}:{at + 11}" in spans[0].spans and spans[0].n_term >= 1 and spans[10].n_term == 0


def test_sanitise_keeps_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    docs = disclosure_corpus()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    names = ["finds", "terms", "row", "text_key", "term_finds", "__carrier", "__finds", "__text_key", "with.dot", "total"]
    for name in names:
        df = df.withColumn(name, F.concat(F.lit(name), "doc_id"))
    clean = {r.doc_id: r for r in sanitise(df).collect()}
    assert sanitise(df).columns == df.columns and len(clean) == len(docs)
    assert all(r[name] == f"{name}{r.doc_id}" for r in clean.values() for name in names)
    assert "[email]" in clean[0].text and "Quixotebury" not in clean[0].text and "chairman" in clean[0].text and clean[10].text == docs[10]


def test_terms_of_rare_entities(spark):
    far = "far " * 40
    docs = [f"Mr Oz Quixotebury of the mill, solo@corp.example {far} Lonesome Quixotebury", "the twin Zanzibarton Ida Wu ACME: +1 212 555 0100", "the twin Wu again +1 212 555 0100, solo2@corp.example", "Again Plainly the twin"]
    docs += [f"the weather of the mill {'again' if i % 2 else 'wu'} far" for i in range(60)]
    docs += [docs[0]] * 2
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    want = brute_terms(docs)
    assert ("solo@corp.example", "oz") in want and ("+1 212 555 0100", "zanzibarton") in want and ("solo@corp.example", "the") not in want and ("solo@corp.example", "lonesome") not in want
    got = {r.doc_id: r for r in personal_data(df).collect()}
    clean = {r.doc_id: r.text for r in sanitise(df).collect()}
    for i, d in enumerate(docs):
        inside = [(a, b) for _, a, b in base(d)]
        own = {d[a:b].lower() for a, b in inside}
        shares = defaultdict(float)
        for (e, t), share in want.items():
            if e in own:
                shares[t] = max(shares[t], share)
        spans = [("term" if shares[m[0].lower()] < 1 - 1e-9 else "term-removed", m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", d) if m[0].lower() in shares and not any(a < m.end() and m.start() < b for a, b in inside)]
        assert got[i].spans.split(",")[len(inside) :] == [f"{k}:{a}:{b}" for k, a, b in sorted(spans)] or not got[i].spans and not spans
        assert got[i].n_term == len(spans)
    assert got[0].n_term and got[0].n_term == got[64].n_term and got[1].n_term and clean[3] == docs[3]
    assert clean[0] == clean[65] and "Quixotebury" not in clean[0] and "Lonesome" in clean[0] and "mill" in clean[0] and "Zanzibarton" not in clean[1]
    assert any("[" in c and ("[name]" in c or "[word]" in c or "[acronym]" in c) for c in clean.values())


def test_sanitise_odd_texts(spark):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in sanitise(df).collect()}
    for i, t in enumerate(texts):
        if t is None or not base(t):
            assert got[i] == t
        else:
            assert not any(t[a:b] in got[i] for k, a, b in base(t) if k == "email" and b - a > 8)


def test_licenses(spark):
    files = [
        ("LICENSE", "Released under the MIT License."),
        ("a/x.py", "print(1)\n# nothing here"),
        ("a/COPYING", "Licensed under the Apache License, Version 2.0.\nand more words of no licence"),
        ("a/b/y.py", "code code code"),
        ("a/b/z.py", "some code\n#   this work is LICENSED under the gnu general public license, version 3\nmore code"),
        ("c/t.txt", "long " * 2000 + "\nAll rights reserved.\n" + "tail " * 500),
        ("d/e/f/g.py", None),
        ("d/e/n.txt", "Licensed under CC BY-NC 4.0."),
        (None, "text"),
        ("a/x.py", "print(1)\n# nothing here"),
        ("q.txt", "the general public is released from all work under this version"),
    ]
    df = spark.createDataFrame([(*f, "z") for f in files], "path string, text string, license string")
    got = [(r.path, r.license, r.origin, r.license_dir) for r in scan_licenses(df).collect()]
    assert sorted(got, key=str) == sorted(
        [
            ("LICENSE", "MIT", "own", ""), ("a/x.py", "Apache-2.0", "inherited", "a"), ("a/x.py", "Apache-2.0", "inherited", "a"), ("a/COPYING", "Apache-2.0", "own", "a"), ("a/b/y.py", "Apache-2.0", "inherited", "a"),
            ("a/b/z.py", "GPL-3.0", "own", "a/b"), ("c/t.txt", "Proprietary", "own", "c"), ("d/e/f/g.py", "CC-BY-NC-4.0", "inherited", "d/e"), ("d/e/n.txt", "CC-BY-NC-4.0", "own", "d/e"), (None, None, None, None), ("q.txt", "MIT", "inherited", ""),
        ],
        key=str,
    )
    assert scan_licenses(df.where("false")).collect() == []


def test_lines_without_cues_are_never_similar():
    rng = random.Random(4)
    by = scorer({"the": 90, "under": 60, "work": 50, "is": 80, "this": 70, "version": 20}, 100, NOTICES, TEXTS, 0.7)
    pool = sorted({w for t in NOTICES.values() for w in re.findall(r"[^\W_]+", t.lower())}) + ["other", "words"]
    for _ in range(5000):
        line = rng.choices(pool, k=rng.randint(1, 9))
        if by.cues.search(" ".join(line)) is None:
            assert by.similar(line) is None


@pytest.mark.parametrize("name", sorted(NOTICES))
def test_each_notice_is_itself(name):
    by = scorer({}, 10, NOTICES, TEXTS, 0.7)
    assert by.similar(re.findall(r"[^\W_]+", NOTICES[name].lower())) == (name, 1.0) or abs(by.similar(re.findall(r"[^\W_]+", NOTICES[name].lower()))[1] - 1) < 1e-9


def brute_cosine(words, other, weight):
    a, b = Counter(words), Counter(other)
    dot = sum(n * b[w] * weight(w) ** 2 for w, n in a.items())
    norm = lambda c: math.sqrt(sum((n * weight(w)) ** 2 for w, n in c.items()))
    return dot / (norm(a) * norm(b)) if a and b else 0.0


def brute_licenses(texts, threshold=0.7):
    """The best (licence, similarity) of each text, by all lines and all windows."""
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    df = Counter(w for t in texts for w in set(split(t)))
    known = {w for t in [*NOTICES.values(), *(t for _, t in TEXTS)] for w in split(t)}
    weight = lambda w: math.log((2 + len(texts)) / (1 + df[w])) if w in known else math.log(2 + len(texts))
    out = []
    for t in texts:
        lines = [split(x) for x in t.split("\n")]
        scored = [(brute_cosine(line, split(n), weight), name) for line in lines for name, n in NOTICES.items()]
        for name, n in TEXTS:
            size = len(split(n))
            for i in range(len(lines)):
                window = []
                for line in lines[i:]:
                    if len(window) >= size:
                        break
                    window += line
                scored.append((brute_cosine(window, split(n), weight), name))
        best = max((round(s, 9) for s, _ in scored), default=0.0)
        out.append((min(name for s, name in scored if round(s, 9) == best), min(1.0, best)) if best >= threshold else (None, None))
    return out


def wrapped(text, width, mark="# "):
    w = text.split(" ")
    return "\n".join(mark + " ".join(w[i : i + width]) for i in range(0, len(w), width))


def test_licenses_by_brute_force(spark):
    rng = random.Random(12)
    pool = sorted({w for _, t in TEXTS for w in t.split(" ")}) + [f"word{i}" for i in range(60)]
    texts = []
    for i, (_, t) in enumerate(TEXTS):
        w = t.split(" ")
        for _ in range(i * 3):
            w[rng.randrange(len(w))] = rng.choice(pool)
        texts.append("import os\n" * (i % 3) + wrapped(" ".join(w), rng.randint(4, 15), "# " if i % 2 else " * ") + "\nrest = 1\nmore of the file" * (i % 4))
    texts += ["\n".join(" ".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(20)) for _ in range(20)] + ["", "Released under the MIT License.", "\n".join([*NOTICES.values()])]
    df = spark.createDataFrame([(f"d/{i}", t) for i, t in enumerate(texts)], "path string, text string")
    got = {int(r.path[2:]): (r.license, r.similarity) if r.origin == "own" else (None, None) for r in scan_licenses(df).collect()}
    want = brute_licenses(texts)
    assert [got[i][0] for i in range(len(texts))] == [name for name, _ in want]
    assert all(w is None or abs(got[i][1] - w) < 1e-6 for i, (_, w) in enumerate(want))
    assert sum(name is not None for name, _ in want) > len(TEXTS) // 2


@pytest.mark.parametrize("name, text", TEXTS)
def test_each_text_is_found_and_licenses_its_directory(name, text):
    by = scorer({}, 50, NOTICES, TEXTS, 0.7)
    found, _ = find_notices("Copyright 2020 Somebody\n\n" + wrapped(text, 9, "// "), by)
    assert max(found, key=lambda f: (f[3], f[2]))[2] == name
    assert find_notices(wrapped(text, 9, ""), by)[1]
