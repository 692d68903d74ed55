"""Law XML files as provisions.

Files are read as bytes and flattened to records (``law_parser``); the rest is relational.
Locators follow a file's rows in the task that parsed it. Texts are ordered concatenations
of the pieces that a provision encloses, and flags below are hoisted to each enclosing
provision, all in one aggregate by (file, provision), without a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import content_uri
from ..functions.identity import segment
from ..profile import DEFAULT, SOURCE_AUTHORITY, SOURCE_FORMAT, Profile
from ..schema import PAIRS, SOURCE, TEMPORAL
from ..tables import materialise
from .law_parser import MAX_BYTES

RECORD = (
    "file string, sha256 string, size long, type string, diagnostic string, law_id string, input_kind string, authority string, law_number string, enveloped_date string, era array<string>, "
    f"seq int, tag string, kind string, place string, owners array<int>, ordinal int, branch array<int>, label string, heading string, attributes {PAIRS}, markup string, text string"
)
#: Eras, the year before their first, and the days on which their Gregorian dates are certain.
ERAS = (
    ("Meiji", 1867, "1873-01-01", "1912-07-30"),
    ("Taisho", 1911, "1912-07-30", "1926-12-25"),
    ("Showa", 1925, "1926-12-25", "1989-01-08"),
    ("Heisei", 1988, "1989-01-08", "2019-05-01"),
    ("Reiwa", 2018, "2019-05-01", "9999-12-31"),
)


@dataclass(frozen=True)
class Adapted:
    """What a source adapter yields: tables keyed by ``file``.

    nodes (schema.RAW_NODE), crosswalk (schema.CROSSWALK), inputs (file, role, uri, sha256),
    failures (file, diagnostic), acquisition (file and the receipt's fields) or None.
    """

    adapter: str
    nodes: DataFrame
    inputs: DataFrame
    failures: DataFrame
    crosswalk: DataFrame | None = None
    acquisition: DataFrame | None = None
    partial_hierarchy: bool = False
    version: str = "1"


def read_files(spark: SparkSession, path: str | list[str], glob: str | None = None, limit: int = MAX_BYTES) -> DataFrame:
    """(file, content, size) of the files below a path; a file is named by its path.

    Files over ``limit`` bytes are listed with their size and not read: their content is null.
    Spark's binary files leave out those of no byte at all; the formats of ``data_source`` list them with their code.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.load(path)
    named = [F.col("path").alias("file"), "content", F.col("length").alias("size")]
    large = found.where(F.col("length") > limit).select("path", F.lit(None).cast("binary").alias("content"), "length")
    return found.where(F.col("length") <= limit).select(*named).unionByName(large.select(*named))


def _records(files: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The records of one file after the other, its record of type 'file' first."""
    import hashlib

    from .law_parser import records

    for batch in files:
        for file, content, given, size in zip(*(batch.column(c) for c in ("file", "content", "given_law_id", "size")), strict=True):
            file, given, size = file.as_py(), given.as_py(), size.as_py()
            if size is not None and size > MAX_BYTES:
                yield [{"file": file, "size": size, "type": "file", "diagnostic": "EGOV_XML_INPUT_TOO_LARGE"}]
                continue
            raw = content.as_buffer().to_pybytes() if content.is_valid else b""
            facts = {"file": file, "sha256": hashlib.sha256(raw).hexdigest(), "size": len(raw)}
            yield [facts | r for r in records(raw, given)]


def parse_laws(files: DataFrame, law_ids: DataFrame | str | None = None) -> DataFrame:
    """Records (RECORD) of ``files`` (file, content, and size where it is known). ``law_ids``: one id for all, or a table (file, law_id)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if isinstance(law_ids, DataFrame):
        files = files.join(law_ids.select("file", F.col("law_id").alias("given_law_id")), "file", "left")
    else:
        files = files.withColumn("given_law_id", F.lit(law_ids).cast("string"))
    schema = to_arrow_schema(T.StructType.fromDDL(RECORD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tree import batches_of

        yield from batches_of(_records(batches), schema)

    size = F.col("size").cast("long") if "size" in files.columns else F.octet_length("content").cast("long")
    return files.select("file", "content", "given_law_id", size.alias("size")).mapInArrow(run, RECORD)


def bare_date(era: str = "era") -> F.Column:
    """The date of (era, year, month, day) texts where it is complete, possible and certain, else null."""
    rows = ", ".join(f"'{name}', named_struct('base', {base}, 'first', '{first}', 'last', '{end}')" for name, base, first, end in ERAS)
    # one binding after another, each a one-element array: fields, numbers, the date
    return F.expr(f"""
        element_at(transform(transform(transform(array(transform({era}, p -> trim(p))),
            p -> named_struct('e', map({rows})[p[0]], 'y', try_cast(p[1] AS int), 'm', try_cast(p[2] AS int), 'd', try_cast(p[3] AS int),
                              'ok', forall(slice(p, 2, 3), x -> coalesce(x rlike '^0*[1-9][0-9]{{0,3}}$', false)))),
            n -> named_struct('e', n.e, 'day', IF(n.ok AND n.e IS NOT NULL, try_to_date(concat_ws('-', lpad(CAST(n.e.base + n.y AS string), 4, '0'), lpad(CAST(n.m AS string), 2, '0'), lpad(CAST(n.d AS string), 2, '0')), 'yyyy-MM-dd'), NULL))),
            t -> IF(CAST(t.day AS string) >= t.e.first AND CAST(t.day AS string) < t.e.last, CAST(t.day AS string), NULL)), 1)""")


def _refusal() -> F.Column:
    """Why a file is not admitted, or null, of its record."""
    derived = bare_date("era")
    conflict = F.col("enveloped_date").isNotNull() & derived.isNotNull() & (F.col("enveloped_date") != derived)
    return F.coalesce("diagnostic", F.when(conflict, "EGOV_XML_PROMULGATION_CONFLICT"))


def admissions(records: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """One row a file: the report of its admission, and its promulgation date."""
    heads = records.where("type = 'file'")
    derived, diagnostic = bare_date("era"), _refusal()
    return heads.select(
        "file",
        diagnostic.isNull().alias("accepted"),
        F.when(diagnostic.isNull(), F.array().cast("array<string>")).otherwise(F.array(diagnostic)).alias("diagnostics"),
        "input_kind",
        F.col("law_id").alias("official_law_id"),
        F.lit(profile.name).alias("profile"),
        F.lit(False).alias("receipt_verified"),
        F.lit(profile.admission_schema).alias("schema"),
        F.col("size").alias("source_bytes"),
        F.col("sha256").alias("source_sha256"),
        "authority",
        "law_number",
        F.coalesce("enveloped_date", derived).alias("promulgated"),
    )


def _hoist() -> F.Column:
    """Own attributes, then each flag below under its name, or with its tag's where that is taken, or numbered."""
    return F.expr("""
        aggregate(coalesce(flags, array()), attributes, (own, f) -> concat(own, array(named_struct(
            'k', element_at(filter(
                concat(array(f.name, concat(f.tag, '_', f.name)), transform(sequence(2, size(own) + 3), n -> concat(f.tag, '_', f.name, '_', n))),
                c -> NOT exists(own, o -> o.k = c)), 1),
            'v', f.value))))""")


_PLACED = ("locator string", "official_law_id string", "of_authority string", "promulgated string")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The locator of each provision of an admitted file, and what its file's record says of all of them; a file's rows come one after the other, parents first."""
    facts, places = None, {}
    for batch in batches:
        out: list[tuple] = []
        for type, seq, owners, step, refusal, law, authority, day in zip(*(batch.column(c).to_pylist() for c in ("type", "seq", "owners", "step", "refusal", "law_id", "authority", "day")), strict=True):
            if type == "file":
                facts, places = None if refusal else (law, authority, day), {}
            if type != "node" or facts is None:
                out.append((None,) * len(_PLACED))
                continue
            places[seq] = f"{places[owners[-2]]}/{step}" if len(owners) > 1 else "/law/root"
            out.append((places[seq], *facts))
        columns = [pa.array(c, pa.string()) for c in zip(*out, strict=True)] or [pa.nulls(0, pa.string())] * len(_PLACED)
        yield pa.RecordBatch.from_arrays([*batch.select([c for c in batch.schema.names if c not in _STEPPED]).columns, *columns], names=[*(c for c in batch.schema.names if c not in _STEPPED), *(c.split()[0] for c in _PLACED)])


#: What placing needs besides RECORD, and what is of no use after it.
_STEPPED = ("step", "refusal", "day", "place")


def place_records(records: DataFrame) -> DataFrame:
    """``records`` as a reader yields them, each file's in one task and in order, with provisions' locators and their files' facts. No row is moved."""
    tag = F.when(F.col("kind") == "appendix", F.col("tag"))
    step = segment(F.col("kind"), F.col("place"), F.col("ordinal"), F.col("branch"), tag=tag, stable_key=F.col("place"), ascii_only=True)
    head, day = F.col("type") == "file", F.coalesce("enveloped_date", bare_date("era"))
    stepped = records.withColumn("step", F.when(F.col("type") == "node", step)).withColumn("refusal", F.when(head, _refusal())).withColumn("day", F.when(head, day))
    kept = T.StructType([f for f in stepped.schema.fields if f.name not in _STEPPED] + T.StructType.fromDDL(", ".join(_PLACED)).fields)
    return stepped.mapInArrow(_placed, kept)


def law_nodes(records: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Provisions (schema.RAW_NODE, without parent_id) of admitted files, of placed records: one aggregate by (file, provision)."""
    is_node = F.col("type") == "node"
    names = ("locator", "official_law_id", "of_authority", "promulgated", "sha256", "kind", "depth", "ordinal", "branch", "label", "heading", "attributes", "markup")
    rows = records.where("type IN ('node', 'text', 'flag')").withColumn("depth", F.size("owners") - 1)
    told = rows.select(
        "file", F.explode(F.when(is_node, F.array("seq")).otherwise(F.col("owners"))).alias("seq"), F.when(is_node & F.col("locator").isNotNull(), F.struct(*names)).alias("n"),
        F.when(F.col("type") == "text", F.struct(F.col("seq").alias("at"), "text")).alias("piece"),
        F.when(F.col("type") == "flag", F.struct(F.col("seq").alias("at"), F.col("label").alias("name"), "tag", F.col("text").alias("value"))).alias("flag"),
    )
    held = told.groupBy("file", "seq").agg(F.first("n", ignorenulls=True).alias("n"), F.array_sort(F.collect_list("piece")).alias("p"), F.array_sort(F.collect_list("flag")).alias("flags")).where("n IS NOT NULL")
    joined = held.select("file", "seq", "n.*", "flags", F.array_join("p.text", "").alias("text"))
    null = F.lit(None)
    return joined.select(
        "file",
        F.col("seq").cast("long").alias("pos"),
        F.lit("Japan").alias("jurisdiction"),
        F.col("of_authority").alias("authority"),
        null.cast("string").alias("law_number_key"),
        F.col("official_law_id").alias("source_law_key"),
        "locator",
        "kind",
        "depth",
        F.coalesce(F.nullif("text", F.lit("")), "markup").alias("text"),
        F.struct(null.cast("string").alias("valid_from"), null.cast("string").alias("valid_to"), F.col("promulgated"), null.cast("string").alias("repealed")).cast(TEMPORAL).alias("temporal"),
        F.struct(content_uri(F.col("sha256"), profile.content_uri_prefix).alias("uri"), F.col("sha256"), F.lit("egov_xml").alias("adapter"), F.col("official_law_id").alias("source_key"), null.cast("int").alias("page"), null.cast("long").alias("byte_start"), null.cast("long").alias("byte_end")).cast(SOURCE).alias("source"),
        null.cast("string").alias("parent_id"),
        "ordinal",
        "branch",
        "label",
        "heading",
        F.array_sort(_hoist()).cast(PAIRS).alias("attributes"),
    )


def adapt_laws(files: DataFrame, law_ids: DataFrame | str | None = None, profile: Profile = DEFAULT) -> Adapted:
    """Admit and adapt ``files`` (file, content); refused ones are in ``failures``."""
    return adapt_law_records(parse_laws(files, law_ids), profile)


def adapt_law_records(records: DataFrame, profile: Profile = DEFAULT) -> Adapted:
    """Provisions of parsed files (RECORD), as a reader yields them, each file's in one task and in order. They are read once."""
    from ..functions.identity import node_id, parent_locator, with_law_id

    records = materialise(place_records(records))
    reports = admissions(records, profile)
    nodes = law_nodes(records, profile)
    above = parent_locator(F.col("locator"))
    lawed = with_law_id(nodes, "law_id")
    nodes = materialise(lawed.withColumn("parent_id", F.when(above.isNotNull(), node_id(F.col("law_id"), above))).drop("law_id"))
    accepted = reports.where("accepted")
    inputs = accepted.select("file", F.lit("source").alias("role"), content_uri(F.col("source_sha256"), profile.content_uri_prefix).alias("uri"), F.col("source_sha256").alias("sha256"))
    failures = reports.where("NOT accepted").select("file", F.col("diagnostics")[0].alias("diagnostic"))
    null = F.lit(None).cast("string")
    acquisition = accepted.select(
        "file", F.lit(profile.acquisition_schema).alias("schema"), F.lit(SOURCE_AUTHORITY).alias("source_authority"), null.alias("source_url"), null.alias("retrieved_at"), F.lit(SOURCE_FORMAT).alias("source_format"),
        "official_law_id", "law_number", null.alias("requested_law_id"), null.alias("as_of"), F.col("source_sha256").alias("sha256"), null.alias("rights"),
    )
    return Adapted("egov_xml", nodes, inputs, failures, acquisition=acquisition)
