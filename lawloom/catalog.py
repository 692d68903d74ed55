"""The registered queries of the library's own operators, and their SQL.

The tables are no statutes, so each operator is applied to what stands for its input:
customers, orders and line items for a tree of provisions, orders for dated versions,
conversations for provisions with texts, documents for sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.canonical import canonical_json, content_uri, content_uri_digest, sha256
from .functions.identity import law_id, node_id, segment, valid_locator, version_id
from .operators import diagnostics as D
from .operators.textscan import PATTERNS, paragraphs, scan_lines
from .operators.counts import corpus_counts, differences, kind_histogram, unordered
from .operators.trees import climb
from .plans.compile import digests, identify, lines, project
from .profile import DEFAULT, ID_NAMESPACE
from .schema import CHILDREN, PAIRS, SOURCE, TEMPORAL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text(value: str | Column) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def uuid5_sql(name: str) -> str:
    """DuckDB's expression for the name-based UUID of a text expression."""
    h = f"sha1(unhex('{ID_NAMESPACE.replace('-', '')}') || encode({name}))"
    return f"concat(substr({h},1,8),'-',substr({h},9,4),'-5',substr({h},14,3),'-',translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab'),substr({h},18,3),'-',substr({h},21,12))"


NO_TIME = "named_struct('valid_from', CAST(NULL AS string), 'valid_to', CAST(NULL AS string), 'promulgated', CAST(NULL AS string), 'repealed', CAST(NULL AS string))"


def provisions(df: DataFrame, **columns: Column) -> DataFrame:
    """A table in the shape of nodes without identifiers; what is not given is empty."""
    given = {
        "file": F.lit("f"), "pos": F.lit(0).cast("long"), "jurisdiction": F.lit("Test"), "authority": F.lit("Law"), "law_number_key": F.lit(None).cast("string"), "source_law_key": F.lit("1"), "locator": F.lit("/law/root"),
        "kind": F.lit("law"), "depth": F.lit(0), "text": F.lit("x"), "temporal": F.expr(NO_TIME).cast(TEMPORAL), "parent_id": F.lit(None).cast("string"), "ordinal": F.lit(None).cast("int"), "branch": F.array().cast("array<int>"),
        "source": F.expr("named_struct('uri', 'u', 'sha256', repeat('0', 64), 'adapter', 'table', 'source_key', NULL, 'page', NULL, 'byte_start', NULL, 'byte_end', NULL)").cast(SOURCE),
        "label": F.lit(None).cast("string"), "heading": F.lit(None).cast("string"), "attributes": F.array().cast(PAIRS),
    }
    return df.select(*((given | columns)[name].alias(name) for name in given | columns))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as provisions: identified, versioned and projected."""
    return q_projection(spark, sf_dir)


@query(f"SELECT doc_id, sha256(text) AS sha256, concat('{DEFAULT.content_uri_prefix}', sha256(text)) AS uri, sha256(text) AS digest FROM documents")
def q_content_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", sha256(F.col("text")).alias("sha256"))
    d = d.withColumn("uri", content_uri(F.col("sha256"), DEFAULT.content_uri_prefix))
    return d.withColumn("digest", content_uri_digest(F.col("uri"), DEFAULT.content_uri_prefix))


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def q_dup_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.lit("f").alias("file"), F.col("doc_id").alias("pos"), sha256(F.col("text")).alias("version_id"))
    twice = D.duplicate_versions(d).select(F.col("subject").alias("version_id"))
    return d.join(twice, "version_id").groupBy(F.col("version_id").alias("sha256")).agg(F.count("*").alias("n"), F.min("pos").alias("first_doc"))


_LAW_SQL = "concat('law_', " + uuid5_sql("""sha256(concat('{"authority":"', lower(r_name), '","jurisdiction":"world","key":"', n_name, '","key_kind":"law_number"}'))""") + ")"


@query(f"SELECT n_nationkey, {_LAW_SQL} AS law_id FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_law_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", law_id(F.lit(" World"), F.col("r_name"), F.concat(F.col("n_name"), F.lit("\n")), F.lit(None).cast("string")).alias("law_id"))


_ITEM = "concat('/law/root/article/article-', l_orderkey, '/item/item-', l_linenumber)"


@query(f"SELECT l_orderkey, l_linenumber, concat('node_', {uuid5_sql('sha256(concat(' + repr('{"law_id":"law_1","locator":"') + ', ' + _ITEM + ', ' + repr('"}') + '))')}) AS node_id FROM lineitem")
def q_node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", node_id(F.lit("law_1"), F.expr(_ITEM)).alias("node_id"))


_VERSION = """sha256(concat('{"attributes":[["status","', o_orderstatus, '"]],"heading":null,"label":"', o_orderkey, '","node_id":"node_', o_custkey,
'","temporal":{"promulgated":null,"repealed":null,"valid_from":"', strftime(o_orderdate, '%Y-%m-%d'), '","valid_to":null},"text":"', o_orderpriority, '"}'))"""


@query(f"SELECT o_orderkey, concat('ver_', {uuid5_sql(_VERSION)}) AS version_id FROM orders")
def q_version_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    temporal = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"), F.lit(None).cast("string").alias("promulgated"), F.lit(None).cast("string").alias("repealed"))
    rows = o.select(
        "o_orderkey", F.concat(F.lit("node_"), text("o_custkey")).alias("node_id"), temporal.alias("temporal"), F.col("o_orderpriority").alias("text"), F.lit(None).cast("string").alias("heading"), text("o_orderkey").alias("label"),
        F.array(F.struct(F.lit("status").alias("k"), F.col("o_orderstatus").alias("v"))).cast(PAIRS).alias("attributes"),
    )
    return rows.select("o_orderkey", version_id().alias("version_id"))


@query("""SELECT p_partkey, concat('table/u-', substr(sha256(p_type), 1, 16), '-', substr(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 32)) AS step,
concat('row/row-', p_size, '-', p_partkey) AS numbered, true AS valid FROM part""")
def q_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<int>")
    p = table(spark, sf_dir, "part").select("p_partkey", segment(F.lit("table"), F.col("p_type"), F.lit(None).cast("int"), none).alias("step"), segment(F.lit("row"), F.col("p_name"), F.col("p_size"), F.array(F.col("p_partkey").cast("int"))).alias("numbered"))
    return p.withColumn("valid", valid_locator(F.concat(F.lit("/law/root/"), "step", F.lit("/"), "numbered")))


def _trade_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent): regions, nations, customers, orders and line items."""
    r, n, c, o, li = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders", "lineitem"))
    tag = lambda t, *k: F.concat_ws("-", F.lit(t), *map(text, k))
    return (
        r.select(tag("R", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
        .unionByName(n.select(tag("N", "n_nationkey").alias("node"), tag("R", "n_regionkey").alias("parent")))
        .unionByName(c.select(tag("C", "c_custkey").alias("node"), tag("N", "c_nationkey").alias("parent")))
        .unionByName(o.select(tag("O", "o_orderkey").alias("node"), tag("C", "o_custkey").alias("parent")))
        .unionByName(li.select(tag("L", "l_orderkey", "l_linenumber").alias("node"), tag("O", "l_orderkey").alias("parent")))
    )


_TREE_SQL = """tree AS (SELECT concat('R-', r_regionkey) AS node, NULL AS parent FROM region UNION ALL SELECT concat('N-', n_nationkey), concat('R-', n_regionkey) FROM nation
UNION ALL SELECT concat('C-', c_custkey), concat('N-', c_nationkey) FROM customer UNION ALL SELECT concat('O-', o_orderkey), concat('C-', o_custkey) FROM orders
UNION ALL SELECT concat('L-', l_orderkey, '-', l_linenumber), concat('O-', l_orderkey) FROM lineitem)"""


@query(f"WITH RECURSIVE {_TREE_SQL}, up AS (SELECT node, node AS root, 0 AS depth FROM tree WHERE parent IS NULL UNION ALL SELECT t.node, u.root, u.depth + 1 FROM tree t JOIN up u ON t.parent = u.node) SELECT node, root, CAST(depth AS BIGINT) AS depth FROM up")
def q_tree_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return climb(_trade_tree(spark, sf_dir))


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def q_parent_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = [F.lit("f").alias("file"), F.lit("l").alias("law_id"), F.lit(1).alias("depth"), F.lit("article").alias("kind"), F.expr(NO_TIME).alias("temporal")]
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pos"), text("l_orderkey").alias("node_id"), text("l_orderkey").alias("parent_id"), *same)
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(text("o_orderkey").alias("node_id"), *same)
    return D.parent_checks(items, o).where("code = 'PARENT_MISSING'").select(F.col("subject").cast("long").alias("l_orderkey")).distinct()


_KIND_SQL = "CASE {c} % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'paragraph' ELSE 'cell' END"
_ALLOWED_SQL = "(VALUES " + ", ".join(f"('{p}', '{c}')" for p, below in CHILDREN.items() for c in below) + ") AS allowed(p, c)"


@query(f"""WITH child AS (SELECT concat('O-', o_orderkey) AS node_id, o_custkey, o_orderkey % 4 AS depth, {_KIND_SQL.format(c='o_orderkey')} AS kind, strftime(o_orderdate, '%Y-%m-%d') AS valid_from, o_orderkey % 5 AS law FROM orders),
parent AS (SELECT c_custkey, c_custkey % 3 AS depth, {_KIND_SQL.format(c='c_custkey')} AS kind, '1995-01-01' AS valid_from, c_custkey % 5 AS law FROM customer WHERE c_custkey % 7 != 0),
met AS (SELECT node_id, bool_or(p.c_custkey IS NOT NULL) AS found, bool_or(p.law = c.law) AS law, bool_or(p.depth + 1 = c.depth) AS deep, bool_or(a.p IS NOT NULL) AS kin, bool_or(p.valid_from <= c.valid_from) AS time
FROM child c LEFT JOIN parent p ON c.o_custkey = p.c_custkey LEFT JOIN {_ALLOWED_SQL} ON a.p = p.kind AND a.c = c.kind GROUP BY node_id)
SELECT code, node_id AS subject FROM met, (VALUES ('PARENT_MISSING'), ('PARENT_LAW'), ('PARENT_DEPTH'), ('KIND_TRANSITION'), ('PARENT_TEMPORAL')) AS codes(code)
WHERE CASE code WHEN 'PARENT_MISSING' THEN NOT found ELSE found AND NOT CASE code WHEN 'PARENT_LAW' THEN law WHEN 'PARENT_DEPTH' THEN deep WHEN 'KIND_TRANSITION' THEN kin ELSE time END END""".replace("AS allowed(p, c)", "AS a(p, c)"))
def q_parent_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda c: F.when(F.col(c) % 3 == 0, "article").when(F.col(c) % 3 == 1, "paragraph").otherwise("cell")
    since = lambda v: F.expr(NO_TIME).withField("valid_from", v)
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_custkey % 7 != 0")
    children = o.select(F.lit("f").alias("file"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("O-"), text("o_orderkey")).alias("node_id"), F.concat(F.lit("C-"), text("o_custkey")).alias("parent_id"), text(F.col("o_orderkey") % 5).alias("law_id"), (F.col("o_orderkey") % 4).cast("int").alias("depth"), kind("o_orderkey").alias("kind"), since(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("temporal"))
    parents = c.select(F.lit("f").alias("file"), F.concat(F.lit("C-"), text("c_custkey")).alias("node_id"), text(F.col("c_custkey") % 5).alias("law_id"), (F.col("c_custkey") % 3).cast("int").alias("depth"), kind("c_custkey").alias("kind"), since(F.lit("1995-01-01")).alias("temporal"))
    return D.parent_checks(children, parents).select("code", "subject")


@query("""WITH v AS (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS f, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS t FROM orders),
w AS (SELECT *, lead(f) OVER x AS nf, lead(o_orderkey) OVER x AS nk FROM v WINDOW x AS (PARTITION BY o_custkey ORDER BY f, o_orderkey))
SELECT DISTINCT concat('C-', o_custkey) AS subject FROM w WHERE nk IS NOT NULL AND (t IS NULL OR nf < t)""")
def q_temporal_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    end = F.when(F.col("o_orderkey") % 11 != 0, F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"), "yyyy-MM-dd"))
    v = o.select(F.lit("f").alias("file"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("C-"), text("o_custkey")).alias("node_id"), F.expr(NO_TIME).withField("valid_from", F.date_format("o_orderdate", "yyyy-MM-dd")).withField("valid_to", end).alias("temporal"))
    return D.temporal_overlaps(v).select("subject").distinct()


@query("SELECT concat('P-', l_partkey) AS subject FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT concat(l_suppkey, '|', l_returnflag, '|', l_linenumber)) != 1")
def q_identity_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.lit("f").alias("file"), F.concat(F.lit("P-"), text("l_partkey")).alias("node_id"), text("l_suppkey").alias("parent_id"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("ordinal"), F.array().cast("array<int>").alias("branch"))
    return D.identity_drifts(rows).select("subject")


@query("SELECT concat('N-', c_nationkey) AS subject FROM customer GROUP BY c_nationkey HAVING count(DISTINCT CASE WHEN c_custkey % 50 = 0 THEN c_custkey END) != 1")
def q_root_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.lit("f").alias("file"), F.concat(F.lit("N-"), text("c_nationkey")).alias("law_id"), text("c_custkey").alias("node_id"), F.when(F.col("c_custkey") % 50 != 0, "p").alias("parent_id"), F.lit("x").alias("own_law"))
    return D.root_counts(rows).select("subject")


def _legacy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.lit("f").alias("file"), F.col("doc_id").alias("pos"), F.concat(F.lit("n"), text("doc_id")).alias("node_id"), F.concat(F.lit("v"), text("doc_id")).alias("version_id"), F.struct(sha256(F.col("text")).alias("sha256")).alias("source"))
    d = table(spark, sf_dir, "documents").select("doc_id", sha256(F.col("text")).alias("s"))
    rows = table(spark, sf_dir, "labels").join(d, "doc_id", "left")
    target = F.when(F.col("doc_id") % 10 == 0, F.col("doc_id") + 10_000_000).otherwise(F.col("doc_id"))
    crosswalk = rows.select(
        F.lit("f").alias("file"), F.col("doc_id").alias("pos"), F.concat(F.lit("old"), text(F.floor(F.col("doc_id") / 3))).alias("legacy_id"), F.concat(F.lit("n"), text(target)).alias("target_node_id"), F.concat(F.lit("v"), text(target)).alias("target_version_id"),
        F.when(F.col("quality") == 1, "ambiguous").otherwise("exact").alias("relation"), F.when(F.col("doc_id") % 4 == 0, "seen").alias("reason"), F.when(F.col("doc_id") % 7 == 0, F.upper("s")).otherwise(F.col("s")).alias("source_sha256"),
    )
    return crosswalk, docs


@query("""WITH d AS (SELECT doc_id, sha256(text) AS s FROM documents), x AS (SELECT l.doc_id, concat('old', doc_id // 3) AS legacy, CASE WHEN l.doc_id % 10 = 0 THEN l.doc_id + 10000000 ELSE l.doc_id END AS target,
CASE WHEN quality = 1 THEN 'ambiguous' ELSE 'exact' END AS relation, CASE WHEN l.doc_id % 4 = 0 THEN 'seen' END AS reason, CASE WHEN l.doc_id % 7 = 0 THEN upper(s) ELSE s END AS sha FROM labels l LEFT JOIN d USING (doc_id)),
j AS (SELECT x.*, d.s AS own FROM x LEFT JOIN d ON d.doc_id = x.target)
SELECT DISTINCT code, subject FROM (SELECT 'CROSSWALK_TARGET' AS code, legacy AS subject FROM j WHERE own IS NULL UNION ALL SELECT 'CROSSWALK_SOURCE_MISMATCH', legacy FROM j WHERE own IS NOT NULL AND sha != own
UNION ALL SELECT 'CROSSWALK_AMBIGUOUS_REASON', legacy FROM j WHERE relation = 'ambiguous' AND reason IS NULL UNION ALL SELECT 'CROSSWALK_EXACT_REASON', legacy FROM j WHERE relation = 'exact' AND reason IS NOT NULL
UNION ALL SELECT 'MALFORMED_SHA', legacy FROM j WHERE NOT regexp_full_match(sha, '[0-9a-f]{64}')
UNION ALL SELECT 'CROSSWALK_REPEATED_POLICY', legacy FROM j GROUP BY legacy HAVING count(*) > 1 AND bool_or(relation != 'ambiguous' OR reason IS NULL))""")
def q_crosswalk_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    crosswalk, docs = _legacy(spark, sf_dir)
    return D.crosswalk_checks(crosswalk, docs).select("code", "subject").distinct()


@query("""SELECT concat('projection_', substr(sha256(concat('v', conv_id, '-', turn, '|full-node-v1|', text)), 1, 32)) AS projection_id, concat('v', conv_id, '-', turn) AS version_id, role AS heading, text
FROM conversations WHERE turn > 0""")
def q_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    version = F.concat(F.lit("v"), text("conv_id"), F.lit("-"), text("turn"))
    nodes = provisions(c, kind=F.when(F.col("turn") == 0, "law").otherwise("article"), text=F.col("text"), heading=F.col("role"), law_id=F.lit("l"), node_id=F.lit("n"), version_id=version)
    return project(nodes).select("projection_id", "version_id", "heading", "text")


@query("SELECT concat('D-', conv_id) AS file, count(*) AS n, sha256(string_agg(concat('{\"role\":\"', role, '\",\"turn\":', turn, '}\n'), '' ORDER BY turn, role)) AS sha256 FROM conversations GROUP BY conv_id")
def q_ordered_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("file", F.concat(F.lit("D-"), text("conv_id")))
    return digests(lines(c, canonical_json({"role": F.col("role"), "turn": F.col("turn")}), F.struct("turn", "role")))


@query("SELECT source, count(*) AS nodes, count(DISTINCT lang) AS laws, count(DISTINCT sha256(text)) AS versions FROM documents GROUP BY source")
def q_manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("lang").alias("law_id"), sha256(F.col("text")).alias("version_id"))
    return corpus_counts(d).select(F.col("file").alias("source"), "nodes", "laws", "versions")


@query("SELECT event_id, concat('{\"event_id\":', event_id, ',\"event_type\":\"', event_type, '\",\"props\":\"', replace(replace(props, '\\', '\\\\'), '\"', '\\\"'), '\",\"user_id\":', user_id, '}') AS line FROM events")
def q_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", canonical_json({k: F.col(k) for k in ("event_id", "event_type", "props", "user_id")}).alias("line"))


@query("SELECT doc_id FROM documents WHERE source NOT IN (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def q_lineage_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    from .plans.store import foreign_sources

    inputs = d.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select(F.lit("f").alias("file"), F.lit("source").alias("role"), F.col("source").alias("uri"), F.col("source").alias("sha256")).distinct()
    nodes = d.select("doc_id", F.lit("f").alias("file"), F.struct(F.col("source").alias("uri"), F.col("source").alias("sha256")).alias("source"))
    foreign = foreign_sources(nodes, inputs).select("uri")
    return nodes.select("doc_id", F.col("source.uri").alias("uri")).join(foreign, "uri").select("doc_id")


@query(f"WITH {_TREE_SQL} SELECT substr(node, 1, 1) AS kind, count(*) AS n FROM tree GROUP BY 1")
def q_kind_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _trade_tree(spark, sf_dir).select(F.lit("f").alias("file"), F.substring("node", 1, 1).alias("kind"))
    return kind_histogram(nodes).select("kind", "n")


@query("SELECT 'missing' AS side, o_custkey AS custkey FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer) UNION ALL SELECT 'extra', c_custkey FROM (SELECT c_custkey FROM customer EXCEPT ALL SELECT o_custkey FROM orders)")
def q_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"))
    return differences(c, o)


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before >= value")
def q_input_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("pos"), "value")
    return unordered(e, "value").select(F.col("file").alias("user_id"), F.col("pos").alias("event_id"))


def _scan_sql(patterns: dict[str, str]) -> str:
    each = " UNION ALL ".join(f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, '{rule}' AS rule, unnest(regexp_extract_all(line, '{p.replace(chr(39), chr(39) * 2)}')) AS found FROM l" for rule, p in patterns.items())
    return f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents) {each}"


@query(_scan_sql(PATTERNS))
def q_line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS line_no FROM (SELECT doc_id, replace(text, '. ', concat('.', chr(10), chr(10))) AS t FROM documents)),
g AS (SELECT *, sum(CASE WHEN length(trim(line, ' ')) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS grp FROM l)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(line_no)) AS INTEGER) AS paragraph, CAST(min(line_no) AS INTEGER) AS first_line, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS text
FROM g WHERE length(trim(line, ' ')) > 0 GROUP BY doc_id, grp""")
def q_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))
    return paragraphs(d, "doc_id")


@query("SELECT url AS file, false AS accepted, 'EGOV_XML_DTD_OR_ENTITY_FORBIDDEN' AS diagnostic, CAST(octet_length(encode(html)) AS BIGINT) AS source_bytes, sha256(html) AS source_sha256 FROM pages")
def q_page_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.law_xml import admissions, parse_laws

    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("file"), F.encode("html", "UTF-8").alias("content"))
    return admissions(parse_laws(pages)).select("file", "accepted", F.col("diagnostics")[0].alias("diagnostic"), "source_bytes", "source_sha256")


@query("SELECT concat('L-', o_custkey) AS law, concat('/law/root/article/article-', o_orderkey % 3) AS locator, CAST(count(*) AS BIGINT) AS versions FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderstatus) > 1")
def q_versions_by_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.concat(F.lit("L-"), text("o_custkey")).alias("law"), F.concat(F.lit("/law/root/article/article-"), text(F.col("o_orderkey") % 3)).alias("locator"), "o_orderstatus")
    nodes = rows.select(F.lit("f").alias("file"), F.col("law").alias("law_id"), "locator", F.col("o_orderstatus").alias("node_id"), F.hash("o_orderstatus").cast("long").alias("pos"))
    shared = D.duplicate_locators(nodes.withColumn("node_id", F.concat("law_id", F.lit("|"), "node_id"))).select(F.substring_index("subject", "|", 1).alias("law"), F.col("detail").alias("locator")).distinct()
    return rows.join(shared, ["law", "locator"]).groupBy("law", "locator").agg(F.count("*").alias("versions"))


_CUSTOMER_LAW = "concat('law_', " + uuid5_sql("""sha256(concat('{"authority":"law","jurisdiction":"test","key":"', o_custkey, '","key_kind":"source_law"}'))""") + ")"


def _node_sql(locator: str) -> str:
    return "concat('node_', " + uuid5_sql(f"""sha256(concat('{{"law_id":"', law, '","locator":"', {locator}, '"}}'))""") + ")"


@query(f"""WITH a AS (SELECT o_orderkey AS k, {_CUSTOMER_LAW} AS law, concat('/law/root/article/article-', o_orderkey) AS loc FROM orders),
article AS (SELECT k, {_node_sql('loc')} AS node FROM a), item AS (SELECT k, {_node_sql("concat(loc, '/item/item-', l_linenumber)")} AS node FROM a JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON l_orderkey = k)
SELECT code, subject, '' AS detail, CASE code WHEN 'ORDINAL_POSITIVE' THEN 'syntax' ELSE 'structure' END AS layer FROM (
SELECT 'KIND_TRANSITION' AS code, node AS subject FROM article WHERE k % 97 = 0 UNION ALL SELECT 'KIND_TRANSITION', node FROM item WHERE k % 97 = 0
UNION ALL SELECT 'PARENT_DEPTH', node FROM article WHERE k % 89 = 0 UNION ALL SELECT 'PARENT_DEPTH', node FROM item WHERE k % 89 = 0 UNION ALL SELECT 'ORDINAL_POSITIVE', node FROM item WHERE k % 83 = 0)""")
def q_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All diagnostics over customers' orders as laws, articles and items, with faults by key."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    law = lambda k: text(k)
    article = F.concat(F.lit("/law/root/article/article-"), text("o_orderkey"))
    laws = provisions(o.select("o_custkey").distinct(), source_law_key=law("o_custkey"), text=law("o_custkey"))
    articles = provisions(o, pos=F.col("o_orderkey"), source_law_key=law("o_custkey"), locator=article, kind=F.when(F.col("o_orderkey") % 97 == 0, "cell").otherwise("article"), depth=F.when(F.col("o_orderkey") % 89 == 0, 3).otherwise(1), text=F.col("o_orderpriority"))
    joined = li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    items = provisions(joined, pos=F.col("l_orderkey") * 10 + F.col("l_linenumber"), source_law_key=law("o_custkey"), locator=F.concat(article, F.lit("/item/item-"), text("l_linenumber")), kind=F.lit("item"), depth=F.lit(2), ordinal=F.when(F.col("l_orderkey") % 83 == 0, 0).otherwise(F.col("l_linenumber")), text=text("l_quantity"))
    from .functions.identity import parent_locator

    nodes = identify(laws.unionByName(articles).unionByName(items))
    above = parent_locator(F.col("locator"))
    nodes = nodes.withColumn("parent_id", F.when(above.isNotNull(), node_id(F.col("law_id"), above)))
    return D.with_layer(D.diagnose(nodes)).drop("file")


from . import catalog_sources  # noqa: E402, F401  more queries, which register themselves
