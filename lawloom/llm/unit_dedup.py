"""Repeated lines and sentences: the earliest stays, the rest go, with their offsets.

Units are the lines of a text and, in a line of several, its sentences (a unit ends
at a line feed, or at ., ! or ? before a space). They are compared by their words,
lower-cased, without punctuation and spacing, as a 128-bit digest. Digests are grouped
over all documents; the unit of the smallest (doc_id, start) is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, digests, materialise, slices, text_bytes, text_of

UNITS = "high long, low long, doc_id long, start int, end int, n_words int"


def _units(batches: Iterator[pa.RecordBatch], line_words: int, sentence_words: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        texts = part.column("text")
        raw, offsets = text_bytes(texts)
        if not len(raw):
            continue
        words = Words(texts)
        ids = np.asarray(part.column("doc_id"))
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        feeds = np.flatnonzero(raw == 10)
        lines = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], feeds + 1]))
        lines = lines[lines < len(raw)]
        stops = np.flatnonzero(((raw[:-1] == 46) | (raw[:-1] == 33) | (raw[:-1] == 63)) & (raw[1:] == 32)) + 1
        sentences = np.union1d(lines, stops)
        found = []
        line_first = np.searchsorted(words.starts, lines)
        for level, least in ((lines, line_words), (sentences, sentence_words)):
            first = np.searchsorted(words.starts, level)
            last = np.append(first[1:], len(words.starts))
            keep = last - first >= least
            if level is sentences:  # a sentence that is its line's only one is that line
                line = np.searchsorted(lines, level, "right") - 1
                line_last = np.append(line_first[1:], len(words.starts))
                keep &= (line_first[line] != first) | (line_last[line] != last)
            ends = np.append(level[1:], len(raw))
            found.append((level[keep], ends[keep], first[keep], last[keep]))
        starts, ends, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(starts):
            continue
        starts = starts + (raw[starts] == 32)
        ends = ends - (raw[ends - 1] == 10)
        rows = words.rows[first]
        high, low = digests(words.hashes, first, last)
        base = chars[offsets[rows]]
        yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(low), pa.array(ids[rows]), pa.array((chars[starts] - base).astype(np.int32)), pa.array((chars[ends] - base).astype(np.int32)), pa.array((last - first).astype(np.int32))], names=["high", "low", "doc_id", "start", "end", "n_words"])


def repeated_units(documents: DataFrame, *, line_words: int = 1, sentence_words: int = 8) -> DataFrame:
    """Units of ``documents`` (doc_id, text) that an earlier place has too: the ones to remove.

    Every line with a word is a unit (``line_words`` can ask for more). A sentence inside a
    longer line is one from ``sentence_words`` words on: shorter ones recur in any prose.
    Offsets are code points, the end exclusive. Null, empty and wordless texts have no
    units; texts are read whole however long; rows without doc_id have no rank and are
    left out; other columns are not read; an empty table gives no row. In repeated rows all
    units of the second copy repeat the first's, at the same (doc_id, start): they are one
    place and stay. Ties go to the smaller (doc_id, start).
    Returns doc_id, start, end, n_words, first_doc_id, first_start.
    """
    docs = documents.select("doc_id", text_of().alias("text")).where("doc_id IS NOT NULL")
    units = materialise(docs.mapInArrow(partial(_units, line_words=line_words, sentence_words=sentence_words), UNITS))
    # summed in each task before the shuffle, and written: the join can then split the places of a very common unit
    first = materialise(units.groupBy("high", "low").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("high", "low", "first"))
    later = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start"))
    return units.join(first, ["high", "low"]).where(later).select("doc_id", "start", "end", "n_words", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"))


def remove_units(documents: DataFrame, units: DataFrame) -> DataFrame:
    """``documents`` without the ``units`` of each, all other columns kept.

    ``removed_spans`` holds the offsets, null where nothing goes; a column of that name is
    replaced. Repeated rows of one doc_id lose the same spans. Null texts stay null.
    """
    documents = documents.drop("removed_spans")
    spans = units.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed_spans"))
    joined = documents.join(spans, "doc_id", "left")
    rest = F.expr("""
        aggregate(removed_spans, struct(0 AS at, '' AS kept),
                  (a, s) -> struct(greatest(a.at, s.end) AS at,
                                   concat(a.kept, IF(s.start > a.at, substring(text, a.at + 1, s.start - a.at), '')) AS kept),
                  a -> concat(a.kept, substring(text, a.at + 1)))""")
    return joined.withColumn("text", F.when(F.col("removed_spans").isNull(), F.col("text")).otherwise(rest))
