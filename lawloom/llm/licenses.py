"""Licences of files: TF-IDF cosine to licence templates, then the nearest directory's licence.

A unit of text is a sparse vector of its words' counts times their IDF over all files; a
word that no template has weighs as if in no file. Units are lines, compared with notices
of a line, and windows of as many consecutive lines as hold a template's number of words,
compared with headers and licence files; a window starts at any line that has a word of
the template. Comment marks are no words. A unit's licence is that of the most similar
template, at ``threshold`` or more. A file that is nothing but such units, or has a licence
file's name, licenses its directory; a file without a licence of its own inherits from the
nearest directory above it that has one, by joins of directories.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, text_of
from .license_texts import NOTICES, TEXTS

LICENSE_NAMES = r"(?i)^(licen[sc]e|copying|copyright|notice|unlicense)([._-].*)?$"
_WORD = re.compile(r"[^\W_]+")


@dataclass
class Template:
    license: str
    vector: dict[str, float]
    size: float
    words: int


@dataclass
class Scorer:
    """IDF of the templates' words, their vectors, and the words one of which any similar unit has."""

    idf: dict[str, float]
    other: float
    notices: list[Template]
    texts: list[Template]
    cues: re.Pattern
    text_cues: frozenset[str]
    threshold: float

    def similarity(self, counts: Counter, template: Template) -> float:
        norm = math.sqrt(sum((n * self.idf.get(w, self.other)) ** 2 for w, n in counts.items()))
        dot = sum(n * self.idf[w] * template.vector[w] for w, n in counts.items() if w in template.vector)
        return dot / (norm * template.size) if norm * template.size else 0.0

    def similar(self, words: list[str]) -> tuple[str, float] | None:
        """The most similar notice of a line; ties go to the smaller identifier."""
        counts = Counter(words)
        best: tuple[float, str] | None = None
        for t in self.notices:
            score = self.similarity(counts, t)
            if score >= self.threshold - 1e-9 and (best is None or score > best[0] + 1e-12):
                best = (score, t.license)
        return (best[1], min(1.0, best[0])) if best else None

    def windows(self, lines: list[list[str]]) -> list[tuple[int, int, str, float]]:
        """(first line, end line, licence, similarity): the best window of each header or licence file that is there."""
        ends = list(accumulate((len(words) for words in lines), initial=0))
        here = {w for words in lines for w in words}
        found = []
        for t in self.texts:
            # by Cauchy's inequality no window is more similar than the template's words that the text has allow
            if sum(t.vector[w] ** 2 for w in here & t.vector.keys()) < (self.threshold * t.size) ** 2 * 0.999:
                continue
            best = None
            for i, words in enumerate(lines):
                if t.vector.keys().isdisjoint(words):
                    continue
                j = min(bisect_left(ends, ends[i] + t.words), len(lines))
                score = self.similarity(Counter(w for line in lines[i:j] for w in line), t)
                if score >= self.threshold - 1e-9 and (best is None or score > best[3] + 1e-12):
                    best = (i, j, t.license, min(1.0, score))
            if best:
                found.append(best)
        return found


def scorer(df: dict[str, int], files: int, notices: dict[str, str], texts: tuple[tuple[str, str], ...], threshold: float) -> Scorer:
    sides = [(name, Counter(_WORD.findall(text.lower()))) for name, text in [*sorted(notices.items()), *texts]]
    idf = {w: math.log((2 + files) / (1 + df.get(w, 0))) for _, c in sides for w in c}
    templates, cues = [], []
    for name, c in sides:
        vector = {w: n * idf[w] for w, n in c.items()}
        size = math.sqrt(sum(x * x for x in vector.values()))
        templates.append(Template(name, vector, size, sum(c.values())))
        # words of least weight, together too light for the threshold, are no cues: by Cauchy's
        # inequality a unit with none but these of the template's words is less similar than it
        light, own = 0.0, set()
        for w in sorted(vector, key=lambda w: (vector[w], w)):
            light += vector[w] ** 2
            if light >= (threshold * size) ** 2 * 0.999:
                own.add(w)
        cues.append(own)
    k = len(notices)
    some = set().union(*cues[:k])
    pattern = re.compile(rf"(?<![^\W_])(?:{'|'.join(sorted(map(re.escape, some), key=len, reverse=True))})(?![^\W_])" if some else r"(?!)")
    return Scorer(idf, math.log(2 + files), templates[:k], templates[k:], pattern, frozenset().union(*cues[k:]), threshold)


def find_notices(text: str, by: Scorer) -> tuple[list[tuple[int, int, str, float]], bool]:
    """(start, end, licence, similarity) of the lines and windows that are like a template, and whether they are all worded lines."""
    folded = text.lower()
    lines: dict[tuple[int, int], None] = {}
    for m in by.cues.finditer(folded):
        start = folded.rfind("\n", 0, m.start()) + 1
        end = folded.find("\n", m.end())
        lines[start, len(folded) if end < 0 else end] = None
    found = [(a, b, *hit) for a, b in lines if (hit := by.similar(_WORD.findall(folded[a:b])))]
    if not by.text_cues.isdisjoint(_WORD.findall(folded)):
        each = folded.split("\n")
        at = list(accumulate((len(line) + 1 for line in each), initial=0))
        found += [(at[i], at[j] - 1, name, score) for i, j, name, score in by.windows([_WORD.findall(line) for line in each])]
    if not found:
        return [], False
    rest, to = [], 0
    for a, b, _, _ in sorted(found):
        rest.append(folded[to:a])
        to = max(to, b)
    return found, _WORD.search("\n".join([*rest, folded[to:]])) is None


_FILE = "license string, similarity double, n_notices int, all_notices boolean"


def _files(batches: Iterator[pa.RecordBatch], by: Scorer) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        rows = []
        for text in part.column("text").to_pylist():
            found, whole = find_notices(text, by)
            best = min(found, key=lambda f: (-f[3], f[2])) if found else (0, 0, None, None)
            rows.append((best[2], best[3], len(found), whole))
        keep = [c for c in part.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.float64(), pa.int32(), pa.bool_()), strict=True))], names=[*keep, "license", "similarity", "n_notices", "all_notices"])


def scan_licenses(files: DataFrame, *, notices: dict[str, str] | None = None, texts: tuple[tuple[str, str], ...] | None = None, threshold: float = 0.7) -> DataFrame:
    """Licences of ``files`` (path, text), one row a row.

    Returns path, license, similarity, n_notices, origin ('own', 'inherited' or null) and
    license_dir (the directory that it comes from). Of a file's notices the most similar
    counts, ties to the smaller identifier; so it is for a directory with several licence
    files. Lines are those of the text, whole however long; null text is empty. A null path
    has no directory and inherits nothing. Repeated rows give repeated rows. Other columns
    are not read. An empty table gives no row.
    """
    notices = NOTICES if notices is None else notices
    templates = TEXTS if texts is None else texts
    texts = files.select("path", text_of().alias("text"))
    words = sorted({w for t in [*notices.values(), *(t for _, t in templates)] for w in _WORD.findall(t.lower())})
    held = F.array_intersect(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), F.array(*map(F.lit, words)))
    # an empty word stands for the file itself; there are at most as many sums as words
    counted = texts.select(F.explode(F.concat(F.array(F.lit("")), F.array_remove(held, ""))).alias("word")).groupBy("word").count().collect()
    df = {r["word"]: r["count"] for r in counted}
    by = scorer(df, df.get("", 0), notices, templates, threshold)
    # written once: directories, their licences and the files themselves all read it
    found = materialise(texts.mapInArrow(partial(_files, by=by), f"path string, {_FILE}"))
    parts = F.split("path", "/")
    found = found.withColumn("dir", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))
    is_license = F.col("license").isNotNull() & (F.col("all_notices") | F.element_at(parts, -1).rlike(LICENSE_NAMES))
    licensed = found.where(is_license).groupBy(F.col("dir").alias("above")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("best")).select("above", F.col("best.license").alias("dir_license"), (-F.col("best.s")).alias("dir_similarity"))
    # each directory once, then each of its ancestors: 'a/b', 'a' and ''
    dirs = found.select("dir").where("dir IS NOT NULL").distinct()
    steps = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.array_union(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/")), F.array(F.lit("")))).alias("above"))
    nearest = above.join(licensed, "above").groupBy("dir").agg(F.max_by(F.struct("above", "dir_license", "dir_similarity"), F.length("above")).alias("near"))
    joined = found.join(nearest, "dir", "left")
    own = F.col("license").isNotNull()
    return joined.select(
        "path",
        F.coalesce("license", "near.dir_license").alias("license"),
        F.coalesce("similarity", "near.dir_similarity").alias("similarity"),
        "n_notices",
        F.when(own, "own").when(F.col("near").isNotNull(), "inherited").alias("origin"),
        F.when(own, F.col("dir")).otherwise(F.col("near.above")).alias("license_dir"),
    )
