"""A convolutional text classifier of toxicity, trained in numpy, with thresholds by language.

A word's vector is the sum of three hashed embeddings: of the word, of its first four and
its first five bytes, so that compounds of a stem share what the stem says. Filters one,
two and three words wide slide over the vectors; each keeps its largest value over the
whole text; a logistic layer makes a score of these. Only the text enters the score. A
language decides no more than the threshold that its documents are held to.

Training takes all labelled rows. Up to a block's rows are trained on where the plan is
made; more are packed into blocks, each of which tasks train on from the same parameters,
and what they learn is averaged after every epoch. Scoring is one pass over the table:
the embeddings times the filters are one small table of each hashed part, so a
convolution is a sum of looked-up rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, fresh, materialise, mix, powers, shared_dir, slices, text_of

#: Rows of each hashed embedding; a power of two.
BUCKETS = 1 << 15
#: Widths of the filters, in words.
WIDTHS = (1, 2, 3)


@dataclass
class Model:
    """Embeddings (3, BUCKETS, size), filters (size, columns), logistic weights, and thresholds."""

    embeddings: np.ndarray
    filters: np.ndarray
    weights: np.ndarray
    bias: float
    per_width: int
    thresholds: dict[str, float] = field(default_factory=dict)
    default_threshold: float = 0.3
    held: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  #: rows that calibrated it


def parts(words: Words) -> np.ndarray:
    """(3, words) buckets: of the word, of its first four bytes, and of its first five."""
    out = np.empty((3, len(words.hashes)), np.int64)
    out[0] = words.hashes >> np.uint64(64 - 15)
    total = np.zeros(len(words.at), np.uint64)
    factor = powers(8, 0xC6A4A7935BD1E995)
    padded = np.concatenate([words.folded, np.zeros(8, np.uint8)])
    for j in range(5):
        inside = words.at + j < words.to
        total += np.where(inside, padded[words.at + j].astype(np.uint64) + np.uint64(1), np.uint64(0)) * factor[j + 1]
        if j >= 3:
            out[j - 2] = mix(total + np.uint64(j)) >> np.uint64(64 - 15)
    return out


def _responses(table: np.ndarray, buckets: np.ndarray, filters: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each width: (width, values of its filters at each word that has words enough after it)."""
    got = table[0][buckets[0]]
    got += table[1][buckets[1]]
    got += table[2][buckets[2]]
    column = 0
    for width in WIDTHS:
        n = len(got) - width + 1
        total = np.zeros((max(n, 0), filters), got.dtype)
        for j in range(width):
            if n > 0:
                total += got[j : j + n, column : column + filters]
            column += filters
        yield width, total


def pooled(table: np.ndarray, buckets: np.ndarray, bounds: np.ndarray, filters: int) -> np.ndarray:
    """(documents, widths x filters): the largest value of each filter, zero at least."""
    out = np.zeros((len(bounds) - 1, filters * len(WIDTHS)), np.float32)
    for k, (width, values) in enumerate(_responses(table, buckets, filters)):
        first, last = bounds[:-1], bounds[1:] - width + 1
        has = np.flatnonzero(last > first)
        if not len(has):
            continue
        edges = np.stack([first[has], last[has]], 1).reshape(-1)
        edges = edges[:-1] if edges[-1] >= len(values) else edges
        top = np.maximum.reduceat(values, edges, axis=0)[::2]
        out[has, k * filters : (k + 1) * filters] = np.maximum(top, 0)
    return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _seen(docs: list[np.ndarray], labels: np.ndarray, used: np.ndarray) -> np.ndarray:
    """(3, 2, BUCKETS): in how many documents of each class a bucket is."""
    seen = np.zeros((3, 2, BUCKETS))
    for channel in range(3):
        for i in used:
            seen[channel, labels[i], np.unique(docs[i][channel])] += 1
    return seen


@dataclass
class _State:
    """Parameters in training, and the sums of their squared gradients."""

    emb: np.ndarray
    filt: np.ndarray
    w: np.ndarray
    b: float
    seen_e: np.ndarray
    seen_f: np.ndarray
    seen_w: np.ndarray
    seen_b: float

    def small(self) -> np.ndarray:
        """All but the embeddings, end to end."""
        return np.concatenate([x.ravel().astype(np.float64) for x in (self.filt, self.w, np.array([self.b]), self.seen_f, self.seen_w, np.array([self.seen_b]))])

    def set_small(self, values: np.ndarray) -> None:
        at = 0
        for name in ("filt", "w", "b", "seen_f", "seen_w", "seen_b"):
            old = getattr(self, name)
            n = np.size(old)
            setattr(self, name, values[at : at + n].reshape(np.shape(old)).astype(np.float32) if np.ndim(old) else float(values[at]))
            at += n


def _begun(rng: np.random.Generator, seen: np.ndarray, rate_of: np.ndarray, size: int, per_width: int, prior: float) -> _State:
    """The first embedding column starts as the class log-odds of its bucket, which the
    first filter of each width reads, so that training starts from telling words."""
    emb = rng.normal(0, 0.05, (3, BUCKETS, size)).astype(np.float32)
    # as if each bucket had been in ``prior`` documents more of the usual mix: few sightings say little
    share = rate_of[1] / rate_of.sum()
    for channel in range(3):
        odds = np.log((seen[channel, 1] + prior * share) / (seen[channel, 0] + prior * (1 - share))) - np.log(share / (1 - share))
        emb[channel, :, 0] = np.clip(odds, -4, 4) * 0.2
    filt = rng.normal(0, 0.2, (size, sum(WIDTHS) * per_width)).astype(np.float32)
    at = 0
    for width in WIDTHS:
        for _ in range(width):
            filt[0, at] = 1.0
            at += per_width
    w, b = np.full(per_width * len(WIDTHS), 0.1, np.float32), -1.0
    return _State(emb, filt, w, b, np.full_like(emb, 1e-3), np.full_like(filt, 1e-3), np.full_like(w, 1e-3), 1e-3)


def _epoch(s: _State, docs: list[np.ndarray], labels: np.ndarray, used: np.ndarray, per_width: int, rate: float, batch: int) -> None:
    """One pass over ``used`` by Adagrad on the cross-entropy."""
    features, size = per_width * len(WIDTHS), s.emb.shape[2]
    for lo in range(0, len(used), batch):
        grad_f, grad_w, grad_b = np.zeros_like(s.filt), np.zeros_like(s.w), 0.0
        places: list[np.ndarray] = []
        grads: list[np.ndarray] = []
        for i in used[lo : lo + batch]:
            doc = docs[i]
            n = doc.shape[1]
            vec = s.emb[0][doc[0]] + s.emb[1][doc[1]] + s.emb[2][doc[2]]
            got = vec @ s.filt
            z, tops, column = np.zeros(features, np.float32), [], 0
            for k, width in enumerate(WIDTHS):
                if n >= width:
                    total = sum(got[j : n - width + 1 + j, column + j * per_width : column + (j + 1) * per_width] for j in range(width))
                    arg = total.argmax(0)
                    z[k * per_width : (k + 1) * per_width] = np.maximum(total[arg, np.arange(per_width)], 0)
                    tops.append((k, width, column, arg))
                column += width * per_width
            err = float(_logistic(np.float64(z @ s.w + s.b))) - labels[i]
            grad_w += err * z
            grad_b += err
            for k, width, column, arg in tops:
                g = err * s.w[k * per_width : (k + 1) * per_width] * (z[k * per_width : (k + 1) * per_width] > 0)
                for j in range(width):
                    cols = slice(column + j * per_width, column + (j + 1) * per_width)
                    grad_f[:, cols] += vec[arg + j].T * g
                    places.append(doc[:, arg + j])
                    grads.append(s.filt[:, cols].T * g[:, None])
        if not places:
            continue
        place, grad = np.concatenate(places, 1), np.concatenate(grads)
        for channel in range(3):
            ids, inverse = np.unique(place[channel], return_inverse=True)
            total = np.zeros((len(ids), size), np.float32)
            np.add.at(total, inverse, grad)
            s.seen_e[channel][ids] += total**2
            s.emb[channel][ids] -= rate * 0.5 * total / np.sqrt(s.seen_e[channel][ids])
        s.seen_f += grad_f**2
        s.filt -= rate * 0.2 * grad_f / np.sqrt(s.seen_f)
        s.seen_w += grad_w**2
        s.w -= rate * grad_w / np.sqrt(s.seen_w)
        s.seen_b += grad_b**2
        s.b -= rate * grad_b / np.sqrt(s.seen_b)


def train(texts: list[str], labels: np.ndarray, *, size: int = 8, per_width: int = 6, epochs: int = 6, rate: float = 0.1, batch: int = 32, prior: float = 20.0, seed: int = 7) -> Model:
    """Fit by Adagrad on the cross-entropy; a fifth of the rows calibrates the scores."""
    rng = np.random.default_rng(seed)
    docs = [parts(Words(pa.array([t], pa.string()))).astype(np.int32) for t in texts]
    order = rng.permutation(len(docs))
    held, used = order[: len(docs) // 5], order[len(docs) // 5 :]
    rate_of = np.array([max(1, int((labels[used] == c).sum())) for c in (0, 1)])
    state = _begun(rng, _seen(docs, labels, used), rate_of, size, per_width, prior)
    for _ in range(epochs):
        rng.shuffle(used)
        _epoch(state, docs, labels, used, per_width, rate, batch)
    model = Model(state.emb, state.filt, state.w, float(state.b), per_width, held=np.sort(held))
    if len(held):
        logit = np.array([score_logits(model, [docs[i]])[0] for i in held])
        _set_calibrated(model, *_calibrate(logit, labels[held]))
    return model


def _set_calibrated(model: Model, scale: float, shift: float) -> None:
    model.weights, model.bias = (model.weights * scale).astype(np.float32), float(model.bias * scale + shift)


# --- blocks: training by tasks ------------------------------------------------------------

#: Words of a block, unless one text has more.
BLOCK_WORDS = 1 << 22
#: Buckets of a channel that are averaged together.
PIECE = 1 << 12
_BLOCK = "block string, bounds binary, labels binary, langs array<string>, parts binary"


def _packed(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, text, lang, toxic) in order of their shards -> blocks of hashed words."""
    key, number, words = None, 0, 0
    docs: list[np.ndarray] = []
    labels: list[int] = []
    langs: list[str] = []

    def out() -> pa.RecordBatch:
        nonlocal number, words
        row = {
            "block": f"{key}.{number}", "bounds": np.cumsum([0, *(d.shape[1] for d in docs)]).astype("<i8").tobytes(), "labels": np.array(labels, np.int8).tobytes(),
            "langs": list(langs), "parts": np.concatenate(docs, 1).astype("<u2").tobytes(),
        }
        number, words = number + 1, 0
        for held in (docs, labels, langs):
            held.clear()
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([("block", pa.string()), ("bounds", pa.binary()), ("labels", pa.binary()), ("langs", pa.list_(pa.string())), ("parts", pa.binary())]))

    for part in slices(batches, 1 << 20):
        found = Words(part.column("text"))
        buckets = parts(found)
        for i, (shard, lang, toxic) in enumerate(zip(*(part.column(c).to_pylist() for c in ("shard", "lang", "toxic")), strict=True)):
            doc = buckets[:, found.bounds[i] : found.bounds[i + 1]].astype(np.uint16)
            if docs and (shard != key or len(docs) >= block_rows or words + doc.shape[1] > BLOCK_WORDS):
                yield out()
            if shard != key:
                key, number = shard, 0
            docs.append(doc)
            labels.append(int(toxic > 0))
            langs.append(lang or "")
            words += doc.shape[1]
    if docs:
        yield out()


@dataclass
class _Block:
    """A block's documents, and the fifth of them that nothing is learned from."""

    name: str
    docs: list[np.ndarray]
    labels: np.ndarray
    langs: list[str]
    held: np.ndarray
    used: np.ndarray


def _blocks(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[_Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            bounds = np.frombuffer(row["bounds"], "<i8")
            buckets = np.frombuffer(row["parts"], "<u2").reshape(3, -1).astype(np.int32)
            order = np.random.default_rng([seed, *row["block"].encode()]).permutation(len(bounds) - 1)
            fifth = len(order) // 5
            docs = [buckets[:, a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield _Block(row["block"], docs, np.frombuffer(row["labels"], np.int8).astype(np.int64), row["langs"], order[:fifth], order[fifth:])


_PIECES = "piece int, block string, ids binary, data binary"
_PIECE_ARROW = pa.schema([("piece", pa.int32()), ("block", pa.string()), ("ids", pa.binary()), ("data", pa.binary())])


def _pieces(block: str, table: np.ndarray, touched: np.ndarray) -> Iterator[dict]:
    """Rows of ``table`` (3 x BUCKETS, columns) that are ``touched``, cut by their place."""
    for piece in range(3 * BUCKETS // PIECE):
        ids = np.flatnonzero(touched[piece * PIECE : (piece + 1) * PIECE])
        if len(ids):
            yield {"piece": piece, "block": block, "ids": ids.astype("<i4").tobytes(), "data": table[piece * PIECE + ids].astype("<f4").tobytes()}


def _sightings(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """What each block says of the classes of its buckets; piece -1: rows of each class."""
    for block in _blocks(batches, seed):
        table = _seen(block.docs, block.labels, block.used).transpose(0, 2, 1).reshape(-1, 2)
        rates = np.bincount(block.labels[block.used], minlength=2)
        first = {"piece": -1, "block": block.name, "ids": np.zeros(1, "<i4").tobytes(), "data": rates.astype("<f4").tobytes()}
        yield pa.RecordBatch.from_pylist([first, *_pieces(block.name, table, table.any(1))], schema=_PIECE_ARROW)


def _learned(batches: Iterator[pa.RecordBatch], state: _State, epoch: int, seed: int, per_width: int, rate: float, batch: int) -> Iterator[pa.RecordBatch]:
    """The parameters after an epoch of each block; piece -1: those that all words share."""
    from copy import deepcopy

    for block in _blocks(batches, seed):
        s = deepcopy(state)
        np.random.default_rng([seed, epoch, *block.name.encode()]).shuffle(block.used)
        _epoch(s, block.docs, block.labels, block.used, per_width, rate, batch)
        table = np.concatenate([s.emb, s.seen_e], 2).reshape(3 * BUCKETS, -1)
        touched = (s.seen_e != state.seen_e).any(2).reshape(-1)
        first = {"piece": -1, "block": block.name, "ids": np.zeros(1, "<i4").tobytes(), "data": s.small().astype("<f4").tobytes()}
        yield pa.RecordBatch.from_pylist([first, *_pieces(block.name, table, touched)], schema=_PIECE_ARROW)


def _added(batches: Iterator[pa.RecordBatch], mean: bool) -> Iterator[pa.RecordBatch]:
    """Pieces in order -> one of each: the sum of its rows, or their mean over the blocks that have them."""
    piece, total, count = None, None, None

    def out() -> pa.RecordBatch:
        ids = np.flatnonzero(count)
        data = total[ids] / count[ids, None] if mean else total[ids]
        return pa.RecordBatch.from_pylist([{"piece": piece, "block": "", "ids": ids.astype("<i4").tobytes(), "data": data.astype("<f4").tobytes()}], schema=_PIECE_ARROW)

    for one in batches:
        for i in range(one.num_rows):
            row = {c: one.column(c)[i].as_py() for c in ("piece", "ids", "data")}
            ids = np.frombuffer(row["ids"], "<i4")
            data = np.frombuffer(row["data"], "<f4").reshape(len(ids), -1)
            if row["piece"] != piece:
                if piece is not None:
                    yield out()
                piece, total, count = row["piece"], np.zeros((PIECE if row["piece"] >= 0 else 1, data.shape[1])), np.zeros(PIECE if row["piece"] >= 0 else 1)
            total[ids] += data
            count[ids] += 1
    if piece is not None:
        yield out()


def _gathered(pieces: DataFrame, mean: bool) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """What all words share, and (places, rows) of each piece: blocks are added up by tasks, so a table's size is all that comes here."""
    dealt = pieces.repartition(F.xxhash64("piece")).sortWithinPartitions("piece", "block")
    rows = dealt.mapInArrow(partial(_added, mean=mean), _PIECES).collect()
    shared = next(np.frombuffer(r["data"], "<f4").astype(np.float64) for r in rows if r["piece"] < 0)
    told = ((r["piece"] * PIECE + np.frombuffer(r["ids"], "<i4"), r) for r in rows if r["piece"] >= 0)
    return shared, ((at, np.frombuffer(r["data"], "<f4").reshape(len(at), -1)) for at, r in told)


def _held_logits(batches: Iterator[pa.RecordBatch], model: Model, seed: int) -> Iterator[pa.RecordBatch]:
    table = fused(model)
    for block in _blocks(batches, seed):
        for lo in range(0, len(block.held), 256):
            some = block.held[lo : lo + 256]
            logit = score_logits(model, [block.docs[i] for i in some], table).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([block.langs[i] for i in some], pa.string()), pa.array(block.labels[some], pa.int32()), pa.array(logit)], names=["lang", "label", "logit"])


def _train_blocks(rows: DataFrame, n: int, block_rows: int, aim: float, *, size: int = 8, per_width: int = 6, epochs: int = 6, rate: float = 0.1, batch: int = 32, prior: float = 20.0, seed: int = 7) -> Model:
    """As ``train`` and the thresholds of ``fit``, on ``rows`` (doc_id, text, lang, toxic) of any number.

    Rows are dealt to shards by a hash of doc_id and cut to blocks. A block's epoch is one
    task's; a bucket's parameters are the mean of the blocks that changed them.
    """
    shards = -(-n // block_rows)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("string")).repartition(shards, "shard").sortWithinPartitions("shard", "doc_id")
    path = shared_dir(rows.sparkSession)
    packed = dealt.select("shard", "text", "lang", "toxic").mapInArrow(partial(_packed, block_rows=2 * block_rows), _BLOCK)
    # a file a block, so that any number of tasks can share them
    packed.write.option("compression", "zstd").option("maxRecordsPerFile", 1).parquet(path)
    blocks = rows.sparkSession.read.schema(_BLOCK).parquet(path)
    rates, told = _gathered(blocks.mapInArrow(partial(_sightings, seed=seed), _PIECES), mean=False)
    seen = np.zeros((3 * BUCKETS, 2))
    for at, data in told:
        seen[at] = data
    state = _begun(np.random.default_rng(seed), seen.reshape(3, BUCKETS, 2).transpose(0, 2, 1), np.maximum(rates, 1), size, per_width, prior)
    for epoch in range(epochs):
        small, told = _gathered(blocks.mapInArrow(partial(_learned, state=state, epoch=epoch, seed=seed, per_width=per_width, rate=rate, batch=batch), _PIECES), mean=True)
        for at, data in told:
            state.emb.reshape(-1, size)[at], state.seen_e.reshape(-1, size)[at] = data[:, :size], data[:, size:]
        state.set_small(small)
    model = Model(state.emb, state.filt, state.w, float(state.b), per_width)
    held = materialise(blocks.mapInArrow(partial(_held_logits, model=model, seed=seed), "lang string, label int, logit double"))
    # calibrated by means of narrow ranges, so that what comes here doesn't grow
    ranges = held.groupBy(F.floor(F.least(F.greatest("logit", F.lit(-64.0)), F.lit(64.0)) * 128).alias("r"), "label").agg(F.avg("logit").alias("logit"), F.count("*").alias("n")).orderBy("r", "label").toArrow()
    if not ranges.num_rows:
        return model
    scale, shift = _calibrate(*(ranges.column(c).to_numpy() for c in ("logit", "label")), weight=ranges.column("n").to_numpy())
    _set_calibrated(model, scale, shift)
    score = _score_of(F.col("logit") * scale + shift)
    passed = sum((F.when(score >= float(t), 1).otherwise(0) for t in _TRIES), F.lit(0))
    by_lang = materialise(held.groupBy("lang", "label", passed.alias("passed")).agg(F.count("*").alias("n")))
    whole = by_lang.groupBy("label", "passed").agg(F.sum("n").alias("n")).collect()
    if not any(r["label"] for r in whole):
        model.default_threshold = aim
        return model
    model.default_threshold = _best(*_counts(whole), aim)
    enough = by_lang.groupBy("lang").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("label")).alias("toxic")).where("all >= 50 AND toxic > 0").select("lang")
    told_of: dict[str, list] = {}
    for r in by_lang.join(enough, "lang").collect():
        told_of.setdefault(r["lang"], []).append(r)
    model.thresholds = {lang: _best(*_counts(of), aim) for lang, of in sorted(told_of.items())}
    return model


def _score_of(logit):
    return 1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-30.0)), F.lit(30.0))))


def _counts(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Of counts by (label, tries passed): for each try, toxic rows that reach it, and all that do; the last of each: all rows."""
    n = np.zeros((2, len(_TRIES) + 1))
    for r in rows:
        n[r["label"], r["passed"]] += r["n"]
    reach = n[:, ::-1].cumsum(1)[:, ::-1]
    return np.append(reach[1, 1:], reach[1, 0]), reach.sum(0)[1:]


def _calibrate(logit: np.ndarray, label: np.ndarray, steps: int = 300, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and intercept of the logits (Platt), by gradient steps kept close to the identity; ``weight``: rows that each stands for."""
    mean = np.mean if weight is None else partial(np.average, weights=weight)
    scale, shift = 1.0, 0.0
    for _ in range(steps):
        err = _logistic(scale * logit + shift) - label
        scale = max(0.2, scale - 0.1 * (float(mean(err * logit)) + 0.01 * (scale - 1)))
        shift -= 0.1 * (float(mean(err)) + 0.01 * shift)
    return scale, shift


def fused(model: Model) -> np.ndarray:
    """(3, BUCKETS, columns): embeddings times filters."""
    return model.embeddings @ model.filters


def score_logits(model: Model, docs: list[np.ndarray], table: np.ndarray | None = None) -> np.ndarray:
    table = fused(model) if table is None else table
    bounds = np.concatenate([[0], np.cumsum([d.shape[1] for d in docs])])
    return pooled(table, np.concatenate(docs, 1), bounds, model.per_width) @ model.weights + model.bias


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    table = fused(model)
    for part in slices(batches, 1 << 20):
        words = Words(part.column("text"))
        logit = pooled(table, parts(words), words.bounds, model.per_width) @ model.weights + model.bias
        keep = [c for c in part.schema.names if c != "text" or part.schema.names.count("text") > 1]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(_logistic(logit.astype(np.float64)))], names=[*keep, "score"])


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, *, block_rows: int = 6000, aim: float = 0.3, **how) -> Model:
    """Train on the labelled rows of ``documents`` (doc_id, text, lang) that are not held out, all of them.

    Up to ``block_rows`` of them go to the driver; more are trained on by tasks, in blocks of
    as many (``_train_blocks``). A threshold by language is the score that does
    best (F1) on the language's rows of the calibration fifth, which nothing was trained
    on, near ``aim`` in case of ties; a language with fewer than 50 such rows or without
    toxic ones has the threshold of all, and so has ``aim`` where none is toxic. Null labels and ids are left out. Of a repeated doc_id the
    greatest label and the greatest text count. Null text is empty; texts are read whole.
    No labelled row: every score is the base rate of none, and nothing is rejected.
    """
    picked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # texts whose labels are held out need not move, where both tables spell an id alike
    same = documents.schema["doc_id"].dataType == labels.schema["doc_id"].dataType
    own = documents.where(~held_out()) if same else documents
    told = own.select("doc_id", text_of().alias("text"), "lang").join(picked, "doc_id").groupBy("doc_id").agg(F.max(F.struct("text", "lang", "toxic")).alias("r")).select("doc_id", "r.*")
    n = documents.select("doc_id").join(picked, "doc_id").agg(F.count_distinct("doc_id"), F.max("toxic")).first()
    if n[0] > block_rows and n[1] > 0:
        return _train_blocks(told, n[0], block_rows, aim, **how)
    rows = told.orderBy("doc_id").collect() if n[0] and n[1] > 0 else []
    texts, label = [r["text"] for r in rows], np.array([int(r["toxic"] > 0) for r in rows], np.int64)
    langs = np.array([r["lang"] or "" for r in rows])
    del rows
    if not len(texts) or not label.any():
        return Model(np.zeros((3, BUCKETS, 1), np.float32), np.zeros((1, sum(WIDTHS)), np.float32), np.zeros(len(WIDTHS), np.float32), -5.0, 1)
    model = train(texts, label, **how)
    table = fused(model)
    rows = [texts[i] for i in model.held]
    label, langs = label[model.held], langs[model.held]
    if not label.any():
        model.default_threshold = aim
        return model
    scores = _logistic(np.array([score_logits(model, [parts(Words(pa.array([t], pa.string())))], table)[0] for t in rows], np.float64))
    model.default_threshold = _threshold(scores, label, aim)
    for lang in np.unique(langs):
        own = langs == lang
        if own.sum() >= 50 and label[own].any():
            model.thresholds[str(lang)] = _threshold(scores[own], label[own], aim)
    return model


_TRIES = np.arange(0.05, 0.96, 0.05)


def _threshold(scores: np.ndarray, label: np.ndarray, aim: float) -> float:
    hit = [((scores >= t) & (label == 1)).sum() for t in _TRIES]
    return _best(np.array([*hit, label.sum()]), np.array([(scores >= t).sum() for t in _TRIES]), aim)


def _best(hit: np.ndarray, reached: np.ndarray, aim: float) -> float:
    """The try of the best F1: ``hit`` toxic rows reach each (the last number: all of them), ``reached`` any."""
    best = []
    for t, good, n in zip(_TRIES, hit, reached, strict=False):
        f1 = 2 * good / max(1, n + hit[-1])
        best.append((round(float(f1), 3), -abs(t - aim), float(t)))
    return max(best)[2]


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, score, rejected): one row a row; null text: empty, which has the score of no words."""
    docs = documents.select("doc_id", text_of().alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    scored = docs.mapInArrow(partial(_score, model=model), "doc_id long, lang string, score double")
    limit = F.lit(model.default_threshold)
    for lang, value in model.thresholds.items():
        limit = F.when(F.col("lang") == lang, value).otherwise(limit)
    return scored.withColumn("rejected", F.col("score") >= limit)


def keep_clean(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` without those that the model rejects; all columns are kept, whatever their names.

    Null and empty texts are scored as no words, repeated rows each alike; null doc_ids stay.
    """
    score = fresh("score", documents.columns)
    limit = F.lit(model.default_threshold)
    for lang, value in model.thresholds.items():
        limit = F.when(F.col("lang") == lang, value).otherwise(limit)
    schema = T.StructType([*documents.schema.fields, T.StructField(score, T.DoubleType())])
    scored = documents.mapInArrow(partial(_with_score, model=model, score=score), schema)
    return scored.where(F.coalesce(F.col(score) < limit, F.lit(True))).drop(score)


def _with_score(batches: Iterator[pa.RecordBatch], model: Model, score: str) -> Iterator[pa.RecordBatch]:
    table = fused(model)
    for part in slices(batches, 1 << 20):
        texts = part.column("text")
        words = Words(texts.fill_null(""))
        logit = pooled(table, parts(words), words.bounds, model.per_width) @ model.weights + model.bias
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_logistic(logit.astype(np.float64)))], names=[*part.schema.names, score])
