"""What the operators share: tables, the shared folder, bounded text slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text a Python worker takes at once; its arrays are a few times that.
SLICE_BYTES = 1 << 20
#: Bytes of a batch between the JVM and a Python worker, where the session leaves it at Spark's 64 MB.
BATCH_BYTES = "8m"


def small_batches(spark: SparkSession) -> None:
    """Both sides of a Python worker's pipe hold small batches, unless the session says how large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "67108864", "67108864b", "64m"):
        spark.conf.set(key, BATCH_BYTES)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder, in small batches (a setting of the session)."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where the session names none (a local run), a temporary folder stands in.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if root is None:
        root = "file://" + tempfile.mkdtemp(prefix="lawloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lawloom/{uuid.uuid4().hex}"


def materialise(df: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends here, and no executor's loss undoes it.

    ``group_bytes``: for rows of many MB. Parquet counts a row group's bytes for the first time after 100 rows,
    and a task holds a whole one, written or read; with it they are counted after each row.
    """
    path = shared_dir(df.sparkSession)
    bounds = {} if group_bytes is None else {"parquet.block.size": group_bytes, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
    df.write.option("compression", "zstd").options(**bounds).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or with underscores after it, such that no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def text_of(column: str = "text"):
    """The text column, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.frombuffer(batch.column(column).buffers()[1], np.int32, n + 1, batch.column(column).offset * 4) if pa.types.is_string(batch.schema.field(column).type) or pa.types.is_binary(batch.schema.field(column).type) else None
        if sizes is None:
            yield batch
            continue
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + limit, "right")) - 1)
            yield batch.slice(at, min(to, n) - at)
            at = min(to, n)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and where each row starts (one more than rows)."""
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) else b"")
    n = len(array)
    offsets = np.frombuffer(array.buffers()[1], np.int32, n + 1, array.offset * 4).astype(np.int64)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each (start, length), end to end."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts.astype(np.int64) - (ends - lengths), lengths) + np.arange(total)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), so that every bit depends on all."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_PRIME = 0x100000001B3
_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: int = _PRIME) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64."""
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, np.uint64(base % (1 << 64)), np.uint64)
        out[0] = 1
        have = _powers[key] = np.multiply.accumulate(out)
    return have[:n]


#: Bytes that make up words: ASCII letters and digits, and all of any other letter's bytes.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of word bytes starts and ends (exclusive); no run passes a row's bounds."""
    n = len(data)
    inside = WORD_BYTE[data]
    first = inside.copy()
    first[1:] &= ~inside[: n - 1]
    at = offsets[:-1][offsets[:-1] < n]
    first[at] = inside[at]
    last = inside.copy()
    last[: n - 1] &= ~inside[1:n]
    last[at[at > 0] - 1] = inside[at[at > 0] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Words:
    """Words of a slice of texts: hash, byte range and row of each, in order.

    A word is a run of ASCII letters, digits or non-ASCII characters, lower-cased by
    Arrow letter by letter before it is hashed; punctuation and white space part words.
    ``starts`` and ``ends`` are places in the text; ``at`` and ``to`` in the folded text,
    which differ after a letter whose lower case has another number of bytes. Such a
    letter stays a word character, so both texts have the same words.
    """

    def __init__(self, array: pa.Array):
        import pyarrow.compute as pc

        raw, self.offsets = text_bytes(array)
        folded, ends = text_bytes(pc.utf8_lower(array))
        n = len(folded)
        self.at, self.to = word_runs(folded, ends)
        same = len(raw) == n and np.array_equal(raw & 0xC0 == 0x80, folded & 0xC0 == 0x80)  # each letter where it was
        self.starts, self.ends = (self.at, self.to) if same else word_runs(raw, self.offsets)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * powers(n), out=total[1:])
        inverse = powers(n + 1, pow(_PRIME, -1, 1 << 64))
        self.hashes = mix((total[self.to] - total[self.at]) * inverse[self.at] + (self.to - self.at).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        self.rows = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.folded = folded

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of ``size`` words in a row, the first word's number, and the row.

        A row with fewer words, but one at least, has one shingle of all its words.
        """
        n = len(self.hashes)
        counts = np.diff(self.bounds)
        weight = powers(size + 1, 0x9FB21C651E98DF25)
        out = np.zeros(max(0, n - size + 1), np.uint64)
        for j in range(size):
            out += self.hashes[j : n - size + 1 + j] * weight[j + 1] if n >= size else 0
        keep = np.flatnonzero(self.rows[: max(0, n - size + 1)] == self.rows[size - 1 :]) if n >= size else np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < size))
        if not len(short):
            return mix(out[keep]), keep, self.rows[keep]
        extra = np.array([int((self.hashes[a:b] * weight[1 : b - a + 1]).sum(dtype=np.uint64)) for a, b in zip(self.bounds[short], self.bounds[short + 1], strict=True)], np.uint64)
        h = np.concatenate([out[keep], extra])
        first = np.concatenate([keep, self.bounds[short]])
        order = np.argsort(first, kind="stable")
        return mix(h[order]), first[order], self.rows[first[order]]


_BASES = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)


def digests(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """128 bits, as two int64 columns, of the words from ``first`` to ``last`` (exclusive), in order."""
    out = []
    for base in _BASES:
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers(len(hashes), base), out=total[1:])
        inverse = powers(len(hashes) + 1, pow(base, -1, 1 << 64))
        out.append(mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64)).view(np.int64))
    return out


def one_hash(words: list[str]) -> list[int]:
    """Hashes of single words, for tests and small tables."""
    return [int(x) for x in Words(pa.array(words, pa.string())).hashes]
