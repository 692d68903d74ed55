"""Files below a folder, listed and read by tasks.

Spark's readers list a task a folder and send the state of every file to the driver, at each
read; over many small corpora that is most of their work. Here one task lists what lies in the
folder itself, tasks list what lies below its folders, and others read it: nothing comes to the driver.
Roots need a file system that pyarrow knows, as those that are written do; others are left to Spark's readers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fnmatch import fnmatchcase
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import CorpusError
from .sources.data_source import _store
from .tables import spread

#: Bytes read at once, and rows and bytes that a task hands over at once.
_PIECE, _BATCH_ROWS, _BATCH_BYTES = 1 << 20, 10_000, 8 << 20
_ENTRY = pa.schema([("address", pa.string()), ("size", pa.int64()), ("folder", pa.bool_())])
_LINE = pa.schema([("path", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("line", pa.binary())])
_WHOLE = pa.schema([("path", pa.string()), ("content", pa.binary())])


def _roots(spark: SparkSession, root: str) -> list[str] | None:
    """The paths that ``root``, which may be a glob, stands for; none where pyarrow does not know their file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = found.getFileSystem(spark._jsc.hadoopConfiguration())
    states = store.globStatus(found) if any(c in root for c in "{}[]*?\\") else [store.getFileStatus(found)] if store.exists(found) else None
    roots = sorted(s.getPath().toString() for s in states or [])
    if not roots:
        raise CorpusError(f"SOURCE_PATH_UNAVAILABLE: {root}")
    try:
        _store(roots[0])
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return None
    return roots


def _names(glob: str) -> list[str]:
    """Globs without braces that together are ``glob``."""
    braces = re.search(r"\{([^{}]*)\}", glob)
    return [n for part in braces[1].split(",") for n in _names(glob[: braces.start()] + part + glob[braces.end() :])] if braces else [glob]


def _entries(batches: Iterator[pa.RecordBatch], root: str, below: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    """What lies in each folder, or all files ``below`` it; names that begin with _ or . are passed over, as Spark does."""
    store = _store(root)[0]
    kept = lambda f: any(fnmatchcase(f.base_name, n) for n in names)
    for batch in batches:
        for address, folder in zip(batch.column("address").to_pylist(), batch.column("folder").to_pylist(), strict=True):
            found = store.get_file_info(fs.FileSelector(address, recursive=below)) if folder else [store.get_file_info(address)]
            seen = [f for f in found if not folder or not any(step[:1] in ("_", ".") for step in f.path[len(address.rstrip("/")) + 1 :].split("/"))]
            out = [(f.path, f.size, f.type == fs.FileType.Directory) for f in seen if (f.type == fs.FileType.File and kept(f)) or (f.type == fs.FileType.Directory and not below)]
            for i in range(0, len(out), _BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + _BATCH_ROWS], strict=True), _ENTRY.types, strict=True)], schema=_ENTRY)


def _listed(spark: SparkSession, roots: list[str], glob: str) -> DataFrame:
    """(address, size) of the files at or below ``roots`` that have a byte and whose name matches."""
    store = _store(roots[0])[0]
    tops = [(base, store.get_file_info(base).type == fs.FileType.Directory) for base in (_store(r)[1] for r in roots)]
    top = spark.createDataFrame([(base, 0, folder) for base, folder in tops], "address string, size long, folder boolean")
    entries = lambda df, below: df.mapInArrow(partial(_entries, root=roots[0], below=below, names=_names(glob)), top.schema)
    return entries(spread(entries(top, False), "address"), True).where("NOT folder AND size > 0").select("address", "size")


def _lines_of(opened: pa.NativeFile, start: int, end: int) -> Iterator[list[bytes]]:
    """The lines that begin at ``start`` or later and before ``end``, some at a time; a line feed ends a line."""
    at = max(start - 1, 0)
    rest, skip = b"", start > 0
    opened.seek(at)
    while at < end and (piece := opened.read(max(_PIECE, len(rest)))):
        data = rest + piece
        lines = data.split(b"\n")
        rest = lines.pop()
        size = len(data) - len(rest)
        if skip:
            # what began before this block is not its own
            if not lines:
                at, rest = at + len(data), b""
                continue
            at, size, skip = at + len(lines[0]) + 1, size - len(lines[0]) - 1, False
            lines = lines[1:]
        if at + size > end:
            begin, lines_in = at, []
            for line in lines:
                if begin >= end:
                    break
                lines_in.append(line)
                begin += len(line) + 1
            lines = lines_in
        at += size
        if lines:
            yield lines
    if rest and not skip and at < end:
        yield [rest]


def _read_lines(batches: Iterator[pa.RecordBatch], root: str, block_bytes: int) -> Iterator[pa.RecordBatch]:
    store, _, prefix = _store(root)
    held: list[tuple[str, int, int, bytes]] = []
    weight = 0

    def out() -> pa.RecordBatch:
        nonlocal weight
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _LINE.types, strict=True)], schema=_LINE)
        held.clear()
        weight = 0
        return made

    for batch in batches:
        for address, size, block in zip(*(batch.column(c).to_pylist() for c in ("address", "size", "block")), strict=True):
            with store.open_input_file(address) as opened:
                for lines in _lines_of(opened, block, min(block + block_bytes, size)):
                    held += [(prefix + address, block, size, line) for line in lines]
                    weight += sum(map(len, lines))
                    if len(held) >= _BATCH_ROWS or weight >= _BATCH_BYTES:
                        yield out()
    if held:
        yield out()


def _read_whole(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    store, _, prefix = _store(root)
    paths: list[str] = []
    contents: list[bytes] = []
    weight = 0
    for batch in batches:
        for address in batch.column("address").to_pylist():
            with store.open_input_file(address) as opened:
                paths.append(prefix + address)
                contents.append(opened.read())
            weight += len(contents[-1])
            if len(paths) >= _BATCH_ROWS or weight >= _BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], schema=_WHOLE)
                paths, contents, weight = [], [], 0
    if paths:
        yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], schema=_WHOLE)


def _block_bytes(spark: SparkSession) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    return int(number) << 10 * " kmgt".index(unit or " ")


def lines_below(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """(path, block, size, line) of the files below ``root`` whose name matches: a block's lines come one after the other, its file may have several."""
    roots = _roots(spark, root)
    if roots is None:
        return None
    cut = _block_bytes(spark)
    blocks = _listed(spark, roots, name).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(cut).cast("long"))))
    return spread(blocks, "address", "block").mapInArrow(partial(_read_lines, root=roots[0], block_bytes=cut), "path string, block long, size long, line binary")


def files_below(spark: SparkSession, root: str, name: str = "*") -> DataFrame:
    """(path, content) of the files below ``root`` that have a byte and whose name matches."""
    roots = _roots(spark, root)
    if roots is None:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root).select("path", "content")
    return spread(_listed(spark, roots, name), "address").mapInArrow(partial(_read_whole, root=roots[0]), "path string, content binary")
