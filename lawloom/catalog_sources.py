"""Registered queries over sources: files made of the trade tables, adapted, compiled, written, tampered with and verified.

A customer is a law, its orders are articles and their line items paragraphs or items. The
SQL makes what must come out from the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query, table, text, uuid5_sql
from .functions.canonical import hex_digest
from .functions.identity import valid_locator
from .operators import constraints as C
from .operators import diagnostics as D
from .profile import CANONICALIZATION, DEFAULT, SOURCE_AUTHORITY, SOURCE_FORMAT
from .schema import SOURCE, TEMPORAL
from .tables import evenly

# ---------------------------------------------------------------- files made of the tables


def _joined(df: DataFrame, by: str, order: str, piece: str, to: str) -> DataFrame:
    """The pieces of each group, in order, end to end."""
    return df.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, piece))), lambda x: x[piece]), ",").alias(to))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"))


def _content(column: str) -> Column:
    return F.encode(F.col(column), "UTF-8")


def customer_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content): a JSON tree a customer with orders."""
    items = _lines(spark, sf_dir).withColumn("piece", F.expr("""concat('{"kind":"item","locator":"l', l_linenumber, '","ordinal":', l_linenumber, ',"text":"line ', l_linenumber, '"}')"""))
    items = _joined(items, "l_orderkey", "l_linenumber", "piece", "items").withColumnRenamed("l_orderkey", "o_orderkey")
    orders = table(spark, sf_dir, "orders").join(items, "o_orderkey", "left")
    orders = orders.withColumn("piece", F.expr("""concat('{"attributes":{"status":"', o_orderstatus, '"},"children":[', coalesce(items, ''), '],"kind":"article","locator":"o', o_orderkey, '","ordinal":', o_orderkey + 1, ',"text":"', o_orderpriority, '"}')"""))
    laws = _joined(evenly(orders, "o_custkey"), "o_custkey", "o_orderkey", "piece", "articles")
    made = laws.withColumn("json", F.expr("""concat('{"authority":"Law","jurisdiction":"Test","nodes":[{"children":[', articles, '],"kind":"law","locator":"root","text":"customer ', o_custkey, '"}],"source_law_key":"', o_custkey, '"}')"""))
    return made.select(F.concat(F.lit("c"), text("o_custkey")).alias("file"), _content("json").alias("content"))


_TREES = """li AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
it AS (SELECT l_orderkey, string_agg(concat('{"kind":"item","locator":"l', l_linenumber, '","ordinal":', l_linenumber, ',"text":"line ', l_linenumber, '"}'), ',' ORDER BY l_linenumber) AS items FROM li GROUP BY 1),
ar AS (SELECT o_custkey, string_agg(concat('{"attributes":{"status":"', o_orderstatus, '"},"children":[', coalesce(items, ''), '],"kind":"article","locator":"o', o_orderkey, '","ordinal":', o_orderkey + 1, ',"text":"', o_orderpriority, '"}'), ',' ORDER BY o_orderkey) AS articles
FROM orders LEFT JOIN it ON l_orderkey = o_orderkey GROUP BY 1),
src AS (SELECT o_custkey AS c, concat('c', o_custkey) AS file, sha256(concat('{"authority":"Law","jurisdiction":"Test","nodes":[{"children":[', articles, '],"kind":"law","locator":"root","text":"customer ', o_custkey, '"}],"source_law_key":"', o_custkey, '"}')) AS sha FROM ar),
laws AS (SELECT *, concat('law_', """ + uuid5_sql("""sha256(concat('{"authority":"law","jurisdiction":"test","key":"', c, '","key_kind":"source_law"}'))""") + """) AS law FROM src),
flat AS (SELECT file, c, law, sha, CAST(NULL AS BIGINT) AS k, CAST(NULL AS BIGINT) AS n, '/law/root' AS locator, NULL AS above, 'law' AS kind, 0 AS depth, NULL AS ordinal, concat('customer ', c) AS text, NULL AS status FROM laws
UNION ALL SELECT file, c, law, sha, o_orderkey, NULL, concat('/law/root/article/article-', o_orderkey + 1), '/law/root', 'article', 1, o_orderkey + 1, o_orderpriority, o_orderstatus FROM laws JOIN orders ON o_custkey = c
UNION ALL SELECT file, c, law, sha, o_orderkey, l_linenumber, concat('/law/root/article/article-', o_orderkey + 1, '/item/item-', l_linenumber), concat('/law/root/article/article-', o_orderkey + 1), 'item', 2, l_linenumber, concat('line ', l_linenumber), NULL FROM laws JOIN orders ON o_custkey = c JOIN li ON l_orderkey = o_orderkey),
node AS (SELECT *, concat('node_', """ + uuid5_sql("""sha256(concat('{"law_id":"', law, '","locator":"', locator, '"}'))""") + """) AS node_id, CASE WHEN above IS NOT NULL THEN concat('node_', """ + uuid5_sql("""sha256(concat('{"law_id":"', law, '","locator":"', above, '"}'))""") + """) END AS parent_id FROM flat)"""


@query(f"""WITH {_TREES} SELECT file, row_number() OVER (PARTITION BY file ORDER BY k NULLS FIRST, n NULLS FIRST) - 1 AS pos, locator, kind, CAST(depth AS INTEGER) AS depth, CAST(ordinal AS INTEGER) AS ordinal, text, parent_id, sha AS sha256, status FROM node""")
def q_json_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON trees flattened: locators, depths, parents and order."""
    from .sources.tree import adapt_json

    nodes = adapt_json(customer_trees(spark, sf_dir)).nodes
    return nodes.select("file", "pos", "locator", "kind", "depth", "ordinal", "text", "parent_id", "source.sha256", F.try_element_at("attributes", F.lit(1))["v"].alias("status"))


_URI = f"concat('{DEFAULT.content_uri_prefix}', sha)"
_INPUTS = f"""concat('[{{"role":"source","sha256":"', sha, '","uri":"', {_URI}, '"}}]')"""
_RECIPE = '{"adapter":"json","mapping":null}'
_TIMES = '{"promulgated":null,"repealed":null,"valid_from":null,"valid_to":null}'
_COMPILED = f"""{_TREES},
bound AS (SELECT *, sha256(concat('{{"build_recipe":{_RECIPE},"inputs":', {_INPUTS}, '}}')) AS mark, concat('{{"adapter":"json","byte_end":null,"byte_start":null,"page":null,"sha256":"', sha, '","source_key":null,"uri":"', {_URI}, '"}}') AS source FROM node),
ver AS (SELECT *, concat('ver_', {uuid5_sql('''sha256(concat('{"attributes":[["build_provenance_sha256","', mark, '"]', CASE WHEN status IS NULL THEN '' ELSE concat(',["status","', status, '"]') END, '],"heading":null,"label":null,"node_id":"', node_id, '","temporal":''' + _TIMES + ''',"text":"', text, '"}'))''')}) AS version_id FROM bound),
line AS (SELECT *, concat('{{"attributes":{{"build_provenance_sha256":"', mark, '"', CASE WHEN status IS NULL THEN '' ELSE concat(',"status":"', status, '"') END, '}},"authority":"Law","branch":[],"depth":', depth, ',"heading":null,"jurisdiction":"Test","kind":"', kind, '","label":null,"law_id":"', law, '","law_number_key":null,"locator":"', locator, '","node_id":"', node_id,
'","ordinal":', coalesce(CAST(ordinal AS VARCHAR), 'null'), ',"parent_id":', CASE WHEN parent_id IS NULL THEN 'null' ELSE concat('"', parent_id, '"') END, ',"schema":"{DEFAULT.corpus_schema}","source":', source, ',"source_law_key":"', c, '","temporal":{_TIMES},"text":"', text, '","version_id":"', version_id, '"}}') AS corpus_line,
concat('{{"evidence":', source, ',"heading":null,"kind":"', kind, '","law_id":"', law, '","locator":"', locator, '","node_id":"', node_id, '","projection_id":"projection_', substr(sha256(concat(version_id, '|full-node-v1|', text)), 1, 32), '","projection_version":"1","schema":"{DEFAULT.projection_schema}","temporal":{_TIMES},"text":"', text, '","version_id":"', version_id, '"}}') AS projection_line FROM ver),
whole AS (SELECT file, any_value(c) AS c, any_value(sha) AS sha, count(*) AS n, sha256(string_agg(concat(corpus_line, chr(10)), '' ORDER BY node_id)) AS corpus, count(*) - 1 AS p, sha256(coalesce(string_agg(concat(projection_line, chr(10)), '' ORDER BY locator) FILTER (WHERE kind != 'law'), '')) AS projection FROM line GROUP BY 1),
opts AS (SELECT *, concat('"adapter":"json","adapter_version":"1","build_recipe":{_RECIPE},"canonicalization":"{CANONICALIZATION}","hierarchy_status":"full","inputs":', {_INPUTS}, ',"required_input_roles":["source"]') AS options FROM whole)"""
_MANIFEST = f"""concat('{{"adapter":"json","adapter_version":"1","build_options_sha256":"', sha256(concat('{{', options, '}}')), '","build_recipe":{_RECIPE},"canonicalization":"{CANONICALIZATION}","corpus_id":"', file, '","corpus_sha256":"', corpus, '","crosswalk_count":0,"crosswalk_sha256":"', sha256(''),
'","hierarchy_status":"full","inputs":', {_INPUTS}, ',"law_count":1,"node_count":', n, ',"projection_count":', p, ',"projection_sha256":"', projection, '","required_input_roles":["source"],"schema":"{DEFAULT.manifest_plain}"}}')"""


@query(f"WITH {_COMPILED} SELECT file, file AS corpus_id, {_MANIFEST} AS manifest FROM opts")
def q_compiled_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpora compiled from JSON trees: fingerprints, canonical files, their digests, options and manifests, byte by byte."""
    from .plans.compile import compile_sources
    from .sources.tree import adapt_json

    return compile_sources(adapt_json(customer_trees(spark, sf_dir)), check=False).manifest


@query(f"WITH {_COMPILED} SELECT file, 'corpus' AS artifact, corpus_line AS line FROM line UNION ALL SELECT file, 'projection', projection_line FROM line WHERE kind != 'law'")
def q_canonical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical lines of corpora and projections."""
    from .plans.compile import compile_sources
    from .sources.tree import adapt_json

    compiled = compile_sources(adapt_json(customer_trees(spark, sf_dir)), check=False)
    return compiled.corpus_lines().select("file", F.lit("corpus").alias("artifact"), "line").unionByName(compiled.projection_lines().select("file", F.lit("projection").alias("artifact"), "line"))


# ---------------------------------------------------------------- law XML

_KANJI = "translate(CAST(l_linenumber AS {t}), '1234567', '一二三四五六七')"


def customer_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, custkey, content): law XML of each customer with orders."""
    paras = _lines(spark, sf_dir).withColumn("piece", F.expr(f"concat('<Paragraph', IF(flag = 'R', ' Delete=\"true\"', ''), '><ParagraphNum>第', {_KANJI.format(t='string')}, '</ParagraphNum><ParagraphSentence><Sentence>flag ', flag, '</Sentence></ParagraphSentence></Paragraph>')"))
    paras = paras.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "piece"))), lambda x: x["piece"]), "").alias("paras")).withColumnRenamed("l_orderkey", "o_orderkey")
    orders = table(spark, sf_dir, "orders").join(paras, "o_orderkey", "left")
    orders = orders.withColumn("piece", F.expr("concat('<Article Num=\"', o_orderkey, '\"><ArticleCaption>(', o_orderpriority, ')</ArticleCaption><ArticleTitle>Article ', o_orderkey, '</ArticleTitle>', coalesce(paras, ''), '</Article>')"))
    laws = evenly(orders, "o_custkey").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "piece"))), lambda x: x["piece"]), "").alias("articles"), F.min("o_orderdate").alias("d"))
    xml = F.expr("""concat('<Law Era="Heisei" Year="', year(d) - 1988, '" PromulgateMonth="', month(d), '" PromulgateDay="', day(d), '" LawType="Act" LawId="C', o_custkey, '"><LawNum>No. ', o_custkey, '</LawNum><LawBody><LawTitle>Law ', o_custkey, '</LawTitle><MainProvision>', articles, '</MainProvision></LawBody></Law>')""")
    return laws.select(F.concat(F.lit("c"), text("o_custkey")).alias("file"), F.col("o_custkey").alias("custkey"), F.encode(xml, "UTF-8").alias("content"))


_LAWS = f"""p AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_returnflag) AS flag FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2),
pt AS (SELECT k, n, flag, concat('第', {_KANJI.format(t='VARCHAR').replace('l_linenumber', 'n')}, 'flag ', flag) AS text, CASE WHEN flag = 'R' THEN 1 ELSE 0 END AS r FROM p),
ps AS (SELECT k, string_agg(text, '' ORDER BY n) AS text, CAST(sum(r) AS INTEGER) AS r FROM pt GROUP BY 1),
a AS (SELECT o_custkey AS c, o_orderkey AS k, concat('(', o_orderpriority, ')') AS heading, concat('(', o_orderpriority, ')Article ', o_orderkey, coalesce(text, '')) AS text, coalesce(r, 0) AS r, o_orderdate AS d FROM orders LEFT JOIN ps ON ps.k = o_orderkey),
l AS (SELECT c, string_agg(text, '' ORDER BY k) AS text, CAST(sum(r) AS INTEGER) AS r, strftime(min(d), '%Y-%m-%d') AS d FROM a GROUP BY 1),
main AS (SELECT concat('/law/root/main_provision/u-', substr(sha256('LawBody[1]/MainProvision[1]'), 1, 16), '-lawbody-1-mainprovision-1') AS place),
nodes AS (SELECT c, '/law/root' AS locator, 'law' AS kind, 0 AS depth, NULL AS ordinal, concat('Law ', c) AS heading, NULL AS label, concat('No. ', c, 'Law ', c, text) AS text, 7 + r AS n_attributes FROM l
UNION ALL SELECT c, place, 'main_provision', 1, NULL, NULL, NULL, text, 1 + r FROM l, main
UNION ALL SELECT c, concat(place, '/article/article-', k), 'article', 2, k, heading, concat('Article ', k), text, 2 + r FROM a, main
UNION ALL SELECT a.c, concat(place, '/article/article-', a.k, '/paragraph/paragraph-', n), 'paragraph', 3, n, NULL, NULL, pt.text, 1 + pt.r FROM pt JOIN a ON a.k = pt.k, main)"""


@query(f"""WITH {_LAWS} SELECT concat('c', nodes.c) AS file, locator, kind, CAST(depth AS INTEGER) AS depth, CAST(ordinal AS INTEGER) AS ordinal, heading, label, nodes.text AS text, l.d AS promulgated, CAST(n_attributes AS INTEGER) AS n_attributes, concat('C', nodes.c) AS source_key FROM nodes JOIN l ON l.c = nodes.c""")
def q_law_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law XML as provisions: numbers in figures and words, headings, hoisted flags, texts of what they enclose, era dates."""
    from .sources.law_xml import adapt_laws

    nodes = adapt_laws(customer_laws(spark, sf_dir)).nodes
    return nodes.select("file", "locator", "kind", "depth", "ordinal", "heading", "label", "text", "temporal.promulgated", F.size("attributes").alias("n_attributes"), "source.source_key")


@query(f"""WITH {_LAWS} SELECT concat('c', nodes.c) AS file, locator, kind, CAST(depth AS INTEGER) AS depth, nodes.text AS text, NULL AS diagnostic, concat('c', nodes.c) AS source_key FROM nodes JOIN l ON l.c = nodes.c WHERE nodes.c % 9 != 0
UNION ALL SELECT concat('c', c), NULL, NULL, NULL, NULL, CASE WHEN c % 2 = 0 THEN 'EGOV_XML_INPUT_EMPTY' ELSE 'EGOV_XML_PARSE' END, NULL FROM l WHERE c % 9 = 0""")
def q_format_law_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laws written as files and read by their format, each one's id from its name; every ninth file is empty or cut."""
    content = F.expr("CASE WHEN custkey % 9 != 0 THEN replace(CAST(content AS string), concat(' LawId=\"C', custkey, '\"'), '') WHEN custkey % 2 = 0 THEN '' ELSE '<Law' END")
    return _by_format(customer_laws(spark, sf_dir).select(F.concat("file", F.lit(".xml")).alias("path"), F.encode(content, "UTF-8").alias("content")), "law_xml", "c", lawIdFromName=True)


@query("""SELECT concat('s', s_suppkey) AS file, CASE WHEN s_suppkey % 7 != 0 THEN '/law/root' END AS locator, CASE WHEN s_suppkey % 7 != 0 THEN 'law' END AS kind, CASE WHEN s_suppkey % 7 != 0 THEN 0 END AS depth,
CASE WHEN s_suppkey % 7 != 0 THEN s_name END AS text, CASE WHEN s_suppkey % 7 = 0 THEN 'ADAPTER_SOURCE: JSONDecodeError' END AS diagnostic, NULL::VARCHAR AS source_key FROM supplier""")
def q_format_law_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' trees written as files and read by their format; every seventh file is no JSON."""
    json = F.expr("""concat('{"authority":"Law","jurisdiction":"Test","nodes":[{"kind":"law","locator":"root","text":"', s_name, IF(s_suppkey % 7 = 0, '"}', '"}],"source_law_key":"'), s_suppkey, '"}')""")
    return _by_format(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), text("s_suppkey"), F.lit(".json")).alias("path"), F.encode(json, "UTF-8").alias("content")), "law_json", "s")


def _by_format(files: DataFrame, name: str, letter: str, **options: object) -> DataFrame:
    from .plans.store import write_files
    from .sources.data_source import read_provisions
    from .tables import shared_dir

    folder = shared_dir(files.sparkSession)
    write_files(files, folder)
    got = read_provisions(files.sparkSession, folder, name, **options)
    nodes = got.nodes.select("file", "locator", "kind", "depth", "text", F.lit(None).cast("string").alias("diagnostic"), "source.source_key")
    return nodes.unionByName(got.failures, allowMissingColumns=True).withColumn("file", F.regexp_extract("file", rf"({letter}[0-9]+)[.][a-z]+\z", 1))


_FAULTS = {
    0: ("''", "EGOV_XML_INPUT_EMPTY"), 1: ("'<x/>'", "EGOV_XML_ROOT"), 2: ("'<Law><LawBody/></Law>'", "EGOV_XML_LAW_ID_REQUIRED"), 3: ("'<!DOCTYPE Law><Law/>'", "EGOV_XML_DTD_OR_ENTITY_FORBIDDEN"),
    4: ("""'<Law LawId="A"/>'""", "EGOV_XML_LAW_BODY_MISSING"), 5: ("""'<Law LawId="A"><LawBody><NewProvision/></LawBody></Law>'""", "EGOV_XML_UNSUPPORTED_STRUCTURE:NewProvision"), 6: ("""'<Law LawId="A"><LawBody/></Law>'""", "EGOV_XML_STRUCTURE_EMPTY"),
    7: ("'<Law'", "EGOV_XML_PARSE"), 8: ("'<error_info/>'", "EGOV_XML_API_ERROR"), 9: ("'<law_data_response/>'", "EGOV_XML_LAW_FULL_TEXT"), 10: ("concat(repeat('<a>', 3000), repeat('</a>', 3000))", "EGOV_XML_TOO_DEEP"),
}


@query(f"""SELECT concat('c', c) AS file, c % 13 > 10 AS accepted, CASE c % 13 {' '.join(f"WHEN {k} THEN '{code}'" for k, (_, code) in _FAULTS.items())} END AS diagnostic, CASE WHEN c % 13 > 10 THEN 'egov_law_xml' END AS input_kind, CASE WHEN c % 13 > 10 THEN concat('C', c) END AS official_law_id, CASE WHEN c % 13 > 10 THEN concat('No. ', c) END AS law_number
FROM (SELECT DISTINCT o_custkey AS c FROM orders)""")
def q_law_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of admission over good and faulty files."""
    from .sources.law_xml import admissions, parse_laws

    content = F.expr(f"CASE custkey % 13 {' '.join(f'WHEN {k} THEN CAST({v} AS binary)' for k, (v, _) in _FAULTS.items())} ELSE content END")
    found = admissions(parse_laws(customer_laws(spark, sf_dir).withColumn("content", content)))
    return found.select("file", "accepted", F.try_element_at("diagnostics", F.lit(1)).alias("diagnostic"), "input_kind", "official_law_id", "law_number")


# ---------------------------------------------------------------- mapped XML and XHTML, and the registry

_MAPPING = {"row": "r", "fields": {"jurisdiction": "j", "authority": "a", "source_law_key": "s", "locator": "l", "kind": "k", "depth": {"path": "d", "type": "int"}, "parent_locator": "p", "ordinal": {"path": "@o", "type": "int"}, "text": "t", "valid_from": {"path": "v", "type": "date"}}}


def _supplier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content, k): flat rows of each nation's suppliers; every seventh nation has a fault of its own."""
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.expr("""concat('<r o="', s_suppkey + 1, '"><j>J</j><a>A</a><s>', s_nationkey, '</s><l>s', s_suppkey, '</l><k>', IF(s_nationkey % 7 = 3, 'thing', 'article'), '</k><d>1</d><p>', IF(s_nationkey % 7 = 4, 'nowhere', 'root'), '</p><t>supplier ', s_suppkey, '</t><v>', IF(s_nationkey % 7 = 5, '2020-13-01', '2020-01-31'), '</v></r>')""").alias("piece"))
    rows = rows.groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "piece"))), lambda x: x["piece"]), "").alias("rows"))
    xml = F.expr("""concat(IF(s_nationkey % 7 = 6, '<!DOCTYPE f [<!ENTITY b "x">]>', ''), '<f><r><j>J</j><a>A</a><s>', s_nationkey, '</s><l>root</l><k>law</k><d>0</d><t>nation ', s_nationkey, '</t></r>', rows, IF(s_nationkey % 7 = 2, '', '</f>'))""")
    return rows.select(F.concat(F.lit("n"), text("s_nationkey")).alias("file"), F.encode(xml, "UTF-8").alias("content"), F.col("s_nationkey").alias("k"))


def _mapped_sql(malformed: str) -> str:
    return f"""WITH good AS (SELECT s_nationkey AS k, s_suppkey AS s FROM supplier WHERE s_nationkey % 7 < 2)
SELECT concat('n', k) AS file, NULL AS diagnostic, concat('/law/root/article/article-', s + 1) AS locator, 1 AS depth, concat('supplier ', s) AS text, '2020-01-31' AS valid_from FROM good
UNION ALL SELECT DISTINCT concat('n', k), NULL, '/law/root', 0, concat('nation ', k), NULL FROM good
UNION ALL SELECT DISTINCT concat('n', s_nationkey), CASE s_nationkey % 7 WHEN 2 THEN '{malformed}' WHEN 3 THEN 'NODE_TYPES' WHEN 4 THEN 'ADAPTER_PARENT_UNRESOLVED' WHEN 5 THEN 'ADAPTER_MAPPING_TYPE' ELSE 'ADAPTER_DTD_OR_ENTITY_FORBIDDEN' END, NULL, CAST(NULL AS INTEGER), NULL, NULL FROM supplier WHERE s_nationkey % 7 >= 2"""


def _mapped(adapted) -> DataFrame:
    nodes = adapted.nodes.select("file", F.lit(None).cast("string").alias("diagnostic"), "locator", "depth", "text", "temporal.valid_from")
    none = F.lit(None).cast("string")
    return nodes.unionByName(adapted.failures.select("file", "diagnostic", none.alias("locator"), F.lit(None).cast("int").alias("depth"), none.alias("text"), none.alias("valid_from")))


@query(_mapped_sql("ADAPTER_XML_PARSE"))
def q_mapped_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of XML selected by a mapping, with the codes of faulty files."""
    from .sources.tree import adapt_xml

    return _mapped(adapt_xml(_supplier_rows(spark, sf_dir), _MAPPING))


@query(_mapped_sql("ADAPTER_HTML_XHTML_REQUIRED"))
def q_mapped_xhtml(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.tree import adapt_html

    return _mapped(adapt_html(_supplier_rows(spark, sf_dir), _MAPPING))


@query("""SELECT concat('c', c, CASE c % 5 WHEN 0 THEN '.xml' WHEN 1 THEN '.JSON' WHEN 2 THEN '.html' WHEN 3 THEN '.xhtml' ELSE '.txt' END) AS file, CASE WHEN c % 3 = 0 THEN 'egov_xml' ELSE CASE c % 5 WHEN 0 THEN 'xml' WHEN 1 THEN 'json' WHEN 2 THEN 'html' WHEN 3 THEN 'html' END END AS adapter,
CASE WHEN c % 3 != 0 AND c % 5 = 4 THEN 'ADAPTER_UNRECOGNIZED' END AS diagnostic FROM (SELECT DISTINCT o_custkey AS c FROM orders)""")
def q_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adapter of each file, by what it is and by its name."""
    from .sources.registry import default_registry

    ending = F.expr("CASE custkey % 5 WHEN 0 THEN '.xml' WHEN 1 THEN '.JSON' WHEN 2 THEN '.html' WHEN 3 THEN '.xhtml' ELSE '.txt' END")
    files = customer_laws(spark, sf_dir).select(F.concat("file", ending).alias("file"), F.when(F.col("custkey") % 3 == 0, F.col("content")).otherwise(F.encode(F.lit("plain"), "UTF-8")).alias("content"))
    return default_registry().resolve(files).select("file", "adapter", "diagnostic")


# ---------------------------------------------------------------- single rows


def _order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as good provisions, with k to plant faults by."""
    from .catalog import provisions
    from .functions.identity import parent_locator
    from .plans.compile import identify

    o = table(spark, sf_dir, "orders")
    made = provisions(o, pos=F.col("o_orderkey"), source_law_key=text("o_custkey"), locator=F.concat(F.lit("/law/root/article/article-"), text("o_orderkey")), kind=F.lit("article"), depth=F.lit(1), text=F.col("o_orderpriority"), label=text("o_orderkey"))
    nodes = identify(made)
    from .functions.identity import node_id

    return nodes.withColumn("parent_id", node_id(F.col("law_id"), parent_locator(F.col("locator")))).withColumn("k", F.col("pos"))


def _with(nodes: DataFrame, k: int, modulo: int, column: str, value: Column) -> DataFrame:
    if "." in column:
        outer, inner = column.split(".")
        value, column = F.col(outer).withField(inner, value), outer
    return nodes.withColumn(column, F.when(F.col("k") % modulo == k, value).otherwise(F.col(column)))


_BAD_ROWS = ("ID_LAW", "ID_NODE", "ID_VERSION", "LOCATOR_GRAMMAR", "ORDINAL_POSITIVE", "BRANCH_POSITIVE", "SOURCE_SHA256", "SOURCE_RANGE", "SOURCE_PAGE", "NUL_FORBIDDEN", "ROOT_KIND", "ROOT_DEPTH", "PARENT_DEPTH", "SOURCE_URI", "IDENTITY_NORMALIZED", "STRING_TYPE")


@query(f"""SELECT CASE WHEN code = 'IDENTITY_NORMALIZED' THEN 'jurisdiction and authority must be nonempty after normalization' ELSE '' END AS detail, code, o_orderkey AS k FROM orders, (VALUES {', '.join(f"('{code}', {i})" for i, code in enumerate(_BAD_ROWS))}) AS codes(code, i) WHERE o_orderkey % 23 = i AND code != 'LOCATOR_GRAMMAR'
UNION ALL SELECT concat('/law/Root/article-', o_orderkey), 'LOCATOR_GRAMMAR', o_orderkey FROM orders WHERE o_orderkey % 23 = 3
UNION ALL SELECT '', 'ROOT_DEPTH', o_orderkey FROM orders WHERE o_orderkey % 23 = 10""")
def q_row_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of single rows, each planted by key."""
    from .functions.identity import node_id, version_id, with_law_id

    n = _order_nodes(spark, sf_dir)
    i = {code: k for k, code in enumerate(_BAD_ROWS)}
    planted = {
        "ORDINAL_POSITIVE": ("ordinal", F.lit(0)), "BRANCH_POSITIVE": ("branch", F.array(F.lit(1), F.lit(0))), "SOURCE_SHA256": ("source.sha256", F.lit("F" * 64)), "SOURCE_RANGE": ("source.byte_start", F.lit(5).cast("long")),
        "SOURCE_PAGE": ("source.page", F.lit(0)), "NUL_FORBIDDEN": ("heading", F.lit("a\0b")), "ROOT_KIND": ("parent_id", F.lit(None).cast("string")), "ROOT_DEPTH": ("parent_id", F.lit(None).cast("string")),
        "PARENT_DEPTH": ("depth", F.lit(0)), "SOURCE_URI": ("source.uri", F.lit("")), "LOCATOR_GRAMMAR": ("locator", F.concat(F.lit("/law/Root/article-"), text("k"))), "STRING_TYPE": ("source.adapter", F.lit(None).cast("string")),
    }
    for code, (column, value) in planted.items():
        n = _with(n, i[code], 23, column, value)
    n = _with(n, i["ROOT_DEPTH"], 23, "kind", F.lit("law"))
    # identifiers of what was changed, so that nothing else speaks against the row
    n = with_law_id(n, "law_id").withColumn("node_id", node_id(F.col("law_id"), F.col("locator"))).withColumn("version_id", version_id())
    n = _with(n, i["ID_LAW"], 23, "law_id", F.lit("law_x"))
    n = n.withColumn("node_id", node_id(F.col("law_id"), F.col("locator")))
    n = _with(n, i["ID_NODE"], 23, "node_id", F.lit("node_x")).withColumn("version_id", version_id())
    n = _with(n, i["ID_VERSION"], 23, "version_id", F.lit("ver_x"))
    n = _with(n, i["IDENTITY_NORMALIZED"], 23, "authority", F.lit(" 　"))
    n = with_law_id(n, "own_law")
    # the diagnostics name nodes; the key of a row stands in its place here
    found = D.row_checks(n.withColumn("file", text("k")))
    return found.where("NOT (code = 'SOURCE_URI' AND file % 23 = 15)").select("code", "detail", F.col("file").cast("long").alias("k"))


_BAD_FIELDS = (
    ("TEMPORAL_DATE", "temporal.promulgated", "'2020-02-30'"), ("TEMPORAL_ORDER", "temporal.valid_to", "'1999-01-01'"), ("SOURCE_STRING", "source.uri", "''"), ("SOURCE_SHA256", "source.sha256", "'x'"), ("SOURCE_PAGE", "source.page", "0"),
    ("SOURCE_RANGE_PAIR", "source.byte_end", "7L"), ("NODE_STRING", "text", "CAST(NULL AS string)"), ("NODE_TEXT_EMPTY", "text", "''"), ("NODE_TYPES", "kind", "'thing'"), ("NODE_DEPTH", "depth", "-1"), ("NODE_ORDINAL", "ordinal", "0"), ("NODE_BRANCH", "branch", "array(0)"),
    ("NODE_ATTRIBUTES", "attributes", "array(named_struct('k', 'a', 'v', CAST(NULL AS string)))"), ("NODE_ATTRIBUTES_DUPLICATE", "attributes", "array(named_struct('k', 'a', 'v', '1'), named_struct('k', 'a', 'v', '2'))"),
)


@query(f"""SELECT o_orderkey AS pos, code FROM orders, (VALUES {', '.join(f"('{code}', {i})" for i, (code, _, _) in enumerate(_BAD_FIELDS))}) AS codes(code, i) WHERE o_orderkey % 17 = i""")
def q_refused_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints of nodes, their sources and dates, each broken by key."""
    n = _order_nodes(spark, sf_dir).withColumn("temporal", F.col("temporal").withField("valid_from", F.lit("2000-01-01")))
    for i, (_, column, value) in enumerate(_BAD_FIELDS):
        n = _with(n, i, 17, column, F.expr(value))
    return C.refused_nodes(n).select("pos", "code")


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'CROSSWALK_FIELDS' WHEN 1 THEN 'CROSSWALK_FIELDS' WHEN 2 THEN 'CROSSWALK_SOURCE_SHA256' END AS crosswalk, CASE doc_id % 5 WHEN 0 THEN 'PROJECTION_FIELDS' WHEN 1 THEN 'PROJECTION_FIELDS' WHEN 2 THEN 'PROJECTION_FIELDS' END AS projection,
CASE doc_id % 4 WHEN 0 THEN 'MANIFEST_INPUT_ORDER' WHEN 1 THEN 'MANIFEST_INPUT_URI_CONFLICT' END AS inputs, doc_id % 3 = 0 AS digest, doc_id % 7 > 2 AS locator FROM documents""")
def q_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints of crosswalk, projection and inputs, and the predicates of digests and locators, true and false."""
    good = F.repeat(F.lit("0a"), 32)
    d = table(spark, sf_dir, "documents").select("doc_id")
    k = F.col("doc_id")
    rows = d.select(
        "doc_id", F.when(k % 6 == 0, "").otherwise("old").alias("legacy_id"), F.lit("n").alias("target_node_id"), F.lit("v").alias("target_version_id"), F.when(k % 6 == 1, "like").otherwise("exact").alias("relation"), F.when(k % 6 == 2, F.upper(good)).otherwise(good).alias("source_sha256"),
        F.lit("p").alias("projection_id"), F.lit("1").alias("projection_version"), F.lit("n").alias("node_id"), F.when(k % 5 == 0, "").otherwise("v").alias("version_id"), F.lit("l").alias("law_id"), F.when(k % 5 == 1, "law/root").otherwise("/law/root").alias("locator"), F.lit("t").alias("text"), F.when(k % 5 == 2, "thing").otherwise("article").alias("kind"),
        F.expr("""CASE doc_id % 4 WHEN 0 THEN array(named_struct('role', 'source', 'uri', 'u', 'sha256', '1'), named_struct('role', 'mapping', 'uri', 'w', 'sha256', '2')) WHEN 1 THEN array(named_struct('role', 'a', 'uri', 'u', 'sha256', '1'), named_struct('role', 'b', 'uri', 'u', 'sha256', '2'), named_struct('role', 'a', 'uri', 'x', 'sha256', '2'))
                  WHEN 2 THEN array(named_struct('role', 'a', 'uri', 'u', 'sha256', '1'), named_struct('role', 'b', 'uri', 'u', 'sha256', '1')) ELSE array(named_struct('role', 'a', 'uri', 'u', 'sha256', '1')) END""").alias("inputs"),
        F.when(k % 3 == 0, good).when(k % 3 == 1, F.upper(good)).otherwise("0a").alias("digest"),
        F.expr("CASE doc_id % 7 WHEN 0 THEN '/law' WHEN 1 THEN '/law/Root' WHEN 2 THEN '/law/root/' WHEN 3 THEN '/law/root/article/article-1' WHEN 4 THEN '/law/a_b-2' ELSE '/law/root' END").alias("place"),
    )
    return rows.select("doc_id", C.crosswalk_problem().alias("crosswalk"), C.projection_problem().alias("projection"), C.inputs_problem().alias("inputs"), hex_digest(F.col("digest")).alias("digest"), valid_locator(F.col("place")).alias("locator"))


# ---------------------------------------------------------------- rows across a corpus


@query("""SELECT 'DUPLICATE_VERSION' AS code, concat('v', doc_id // 2) AS subject, '' AS detail FROM documents WHERE doc_id // 2 % 5 = 0 GROUP BY doc_id // 2 HAVING count(*) > 1
UNION ALL SELECT 'LOCATOR_DUPLICATE', concat('n', doc_id), concat('/law/root/article/article-', doc_id // 3) FROM documents d WHERE EXISTS (SELECT 1 FROM documents e WHERE e.doc_id // 3 = d.doc_id // 3 AND e.doc_id < d.doc_id)""")
def q_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions and locators that stand there twice."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        F.lit("f").alias("file"), k.alias("pos"), F.lit("l").alias("law_id"), F.concat(F.lit("n"), text("doc_id")).alias("node_id"), F.concat(F.lit("/law/root/article/article-"), text(F.floor(k / 3))).alias("locator"),
        F.when(F.floor(k / 2) % 5 == 0, F.concat(F.lit("v"), text(F.floor(k / 2)))).otherwise(F.concat(F.lit("own"), text("doc_id"))).alias("version_id"),
    )
    return D.duplicate_versions(rows).unionByName(D.duplicate_locators(rows)).drop("file")


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 50 = 1 THEN NULL WHEN c_custkey % 50 = 2 THEN c_custkey + 3 WHEN c_custkey % 50 = 30 THEN -1 ELSE c_custkey - 1 END AS p FROM customer),
up AS (SELECT k AS s, p, 1 AS n FROM e WHERE p IS NOT NULL UNION ALL SELECT s, e.p, n + 1 FROM up JOIN e ON e.k = up.p WHERE e.p IS NOT NULL AND n < 60),
last AS (SELECT s, max(n) AS n, max_by(p, n) AS p FROM up GROUP BY 1), fate AS (SELECT s, CASE WHEN n >= 60 THEN 'cycle' WHEN EXISTS (SELECT 1 FROM e WHERE e.k = last.p) THEN 'root' ELSE 'gap' END AS f FROM last)
SELECT 'TREE_UNREACHABLE' AS code, concat('C', s) AS subject FROM fate WHERE f != 'root' UNION ALL SELECT 'TREE_CYCLE', concat('C', s) FROM fate WHERE f = 'cycle'""")
def q_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of parents that end at a root, in a cycle, or nowhere."""
    k = F.col("c_custkey")
    above = F.when(k % 50 == 2, k + 3).when(k % 50 == 30, F.lit(-1)).when(k % 50 != 1, k - 1)
    rows = table(spark, sf_dir, "customer").select(F.lit("f").alias("file"), k.alias("pos"), F.concat(F.lit("C"), text("c_custkey")).alias("node_id"), F.when(above.isNotNull(), F.concat(F.lit("C"), text(above))).alias("parent_id"), F.expr("named_struct('valid_from', CAST(NULL AS string))").alias("temporal"))
    return D.ancestry(rows, rows).select("code", "subject")


@query("""SELECT 'CORPUS_EMPTY' AS code, concat('r', r_regionkey) AS file, 'corpus' AS subject FROM region WHERE r_regionkey % 2 = 1
UNION ALL SELECT DISTINCT 'CROSSWALK_FIELDS', concat('r', r_regionkey), 'old' FROM region WHERE r_regionkey % 2 = 0
UNION ALL SELECT DISTINCT 'CROSSWALK_DUPLICATE_TARGET', concat('r', r_regionkey), 'old' FROM region WHERE r_regionkey % 2 = 0
UNION ALL SELECT DISTINCT 'CROSSWALK_TARGET', concat('r', r_regionkey), 'old' FROM region WHERE r_regionkey % 2 = 0
UNION ALL SELECT DISTINCT 'CROSSWALK_REPEATED_POLICY', concat('r', r_regionkey), 'old' FROM region WHERE r_regionkey % 2 = 0""")
def q_corpus_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All diagnostics of small corpora: empty ones, and crosswalks with a repeated and malformed target."""
    from .catalog import provisions
    from .plans.compile import identify

    r = table(spark, sf_dir, "region").withColumn("file", F.concat(F.lit("r"), text("r_regionkey")))
    nodes = identify(provisions(r.where("r_regionkey % 2 = 0"), file=F.col("file"), source_law_key=text("r_regionkey"), text=F.col("r_name")))
    crosswalk = r.where("r_regionkey % 2 = 0").select("file", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("pos"), F.lit("old").alias("legacy_id"), F.lit("n").alias("target_node_id"), F.lit("v").alias("target_version_id"), F.lit("like").alias("relation"), F.lit(None).cast("string").alias("reason"), F.repeat(F.lit("0"), 64).alias("source_sha256"))
    return D.diagnose(nodes, crosswalk, r.select("file")).select("code", "file", "subject")


# ---------------------------------------------------------------- written corpora

_TAMPERS = (
    (None, None, "''"), ("MANIFEST_CORPUS_TAMPERED", "corpus.jsonl", "concat(t, ' ')"), ("MANIFEST_PROJECTION_TAMPERED", "projection.jsonl", "replace(t, 'customer', 'Customer')"), ("MANIFEST_CROSSWALK_TAMPERED", "crosswalk.jsonl", "'{}'"),
    ("MANIFEST_JSON", "manifest.json", "'{'"), ("MANIFEST_KEYS", "manifest.json", "replace(t, '\"law_count\"', '\"laws\"')"), ("MANIFEST_TYPES", "manifest.json", "replace(t, '\"law_count\":1', '\"law_count\":\"1\"')"), ("MANIFEST_OPTIONS", "manifest.json", "replace(t, '\"hierarchy_status\":\"full\"', '\"hierarchy_status\":\"half\"')"),
    ("MANIFEST_RECIPE", "manifest.json", "replace(t, '{\"adapter\":\"json\",\"mapping\"', '{\"adapter\":\"xml\",\"mapping\"')"), ("MANIFEST_COUNT_TAMPERED", "manifest.json", "replace(t, '\"law_count\":1', '\"law_count\":2')"), ("MANIFEST_INPUTS_REQUIRED", "manifest.json", "regexp_replace(t, '\"inputs\":.*?]', '\"inputs\":[]')"),
    ("MANIFEST_INPUT_ROLES", "manifest.json", "replace(t, '\"required_input_roles\":[\"source\"]', '\"required_input_roles\":[\"mapping\"]')"), ("MANIFEST_INPUT_SYNTAX", "manifest.json", "replace(t, '\"uri\":\"lawloom:source:', '\"uri\":\"other:source:')"), ("MANIFEST_OPTIONS_TAMPERED", "manifest.json", "replace(t, '\"hierarchy_status\":\"full\"', '\"hierarchy_status\":\"partial\"')"),
)


def _nation_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    json = F.expr("""concat('{"authority":"Law","jurisdiction":"Test","nodes":[{"children":[{"kind":"article","locator":"a","ordinal":1,"text":"customer"}],"kind":"law","locator":"root","text":"', n_name, '"}],"source_law_key":"', n_nationkey, '"}')""")
    return n.select(F.concat(F.lit("n"), text("n_nationkey")).alias("file"), F.encode(json, "UTF-8").alias("content"))


def _tampered(spark: SparkSession, sf_dir: str) -> str:
    """A folder of the nations' corpora, each changed as its key says."""
    from .plans.compile import compile_sources
    from .plans.store import corpus_files, write_files
    from .sources.tree import adapt_json
    from .tables import shared_dir

    files = corpus_files(compile_sources(adapt_json(_nation_trees(spark, sf_dir))))
    k, name = F.regexp_extract("path", "^n(\\d+)/", 1).cast("int"), F.substring_index("path", "/", -1)
    changed = F.col("content")
    for i, (_, file, value) in enumerate(_TAMPERS):
        if file is not None:
            changed = F.when((k % len(_TAMPERS) == i) & (name == file), F.expr(value.replace("(t,", "(content,"))).otherwise(changed)
    out = shared_dir(spark)
    write_files(files.withColumn("content", changed), out)
    return out


@query(f"""SELECT concat('n', n_nationkey) AS corpus, CASE n_nationkey % {len(_TAMPERS)} {' '.join(f"WHEN {i} THEN '{code}'" for i, (code, _, _) in enumerate(_TAMPERS) if code)} END AS code FROM nation""")
def q_tampered_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpora written, changed by key and verified: the first code that speaks against each, or null."""
    from .plans.store import verify_corpora

    found = verify_corpora(spark, _tampered(spark, sf_dir))
    return found.select(F.substring_index("file", "/", -1).alias("corpus"), "code")


_REPLAYED = "CASE WHEN n_nationkey % 3 = 0 THEN 'MANIFEST_INPUT_UNAVAILABLE' WHEN n_nationkey % 4 = 1 THEN 'MANIFEST_REBUILD_CORPUS' WHEN n_nationkey % 4 = 2 THEN 'MANIFEST_REBUILD_PROJECTION' WHEN n_nationkey % 4 = 3 THEN 'MANIFEST_REBUILD_OPTIONS' END"


@query(f"SELECT concat('n', n_nationkey) AS corpus, {_REPLAYED} AS code FROM nation")
def q_replayed_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpora compiled anew from their sources, with digests in the manifests changed by key, and every third source gone."""
    from .plans.compile import compile_sources
    from .plans.store import corpus_files, replay, write_files
    from .sources.tree import adapt_json
    from .tables import shared_dir

    sources = _nation_trees(spark, sf_dir)
    files = corpus_files(compile_sources(adapt_json(sources)))
    k, is_manifest = F.regexp_extract("path", "^n(\\d+)/", 1).cast("int"), F.substring_index("path", "/", -1) == "manifest.json"
    changed = F.when(k % 4 == 1, F.regexp_replace("content", '"corpus_sha256":"[0-9a-f]{64}"', f'"corpus_sha256":"{"0" * 64}"')).when(k % 4 == 2, F.regexp_replace("content", '"projection_sha256":"[0-9a-f]{64}"', f'"projection_sha256":"{"0" * 64}"'))
    changed = changed.when(k % 4 == 3, F.replace("content", F.lit('"hierarchy_status":"full"'), F.lit('"hierarchy_status":"partial"'))).otherwise(F.col("content"))
    out = shared_dir(spark)
    write_files(files.withColumn("content", F.when(is_manifest, changed).otherwise(F.col("content"))), out)
    found = replay(spark, out, sources.where("CAST(substring(file, 2) AS int) % 3 != 0"))
    return found.select(F.substring_index("file", "/", -1).alias("corpus"), "code")


_LINE_FAULTS = (
    ("corpus.jsonl", "regexp_replace(content, '\"depth\":0', '\"depths\":0')", "JSONL_LINE_{root}: NODE_KEYS"), ("corpus.jsonl", "replace(content, '\"branch\":[]', '\"branch\":[\"a\"]')", "JSONL_LINE_1: BRANCH_TYPE"),
    ("corpus.jsonl", "replace(content, '\"repealed\":null,', '')", "JSONL_LINE_1: TEMPORAL_KEYS"), ("corpus.jsonl", "replace(content, '\"page\":null,', '')", "JSONL_LINE_1: SOURCE_KEYS"), ("corpus.jsonl", "concat('nothing\n', content)", "JSONL_LINE_1: NODE_KEYS"),
    ("corpus.jsonl", "replace(content, '\"text\":\"customer\"', '\"text\":\"Customer\"')", "JSONL_LINE_{article}: RECOMPUTED_VERSION_ID"), ("crosswalk.jsonl", "'\n{}\n'", "CROSSWALK_BLANK_LINE"), ("crosswalk.jsonl", "'{}\n'", "CROSSWALK_LINE_1: CROSSWALK_KEYS"),
    ("crosswalk.json", "'{\"legacy_id\":\"a\"}\n'", "CROSSWALK_LINE_1: CROSSWALK_KEYS"), ("projection.jsonl", "concat('\n', content)", "PROJECTION_BLANK_LINE"), ("projection.jsonl", "replace(content, '\"kind\":\"article\"', '\"kind\":\"thing\"')", "PROJECTION_LINE_1: PROJECTION_FIELDS"), (None, None, None),
)
_NATION_ROOT = "concat('node_', " + uuid5_sql("""sha256(concat('{"law_id":"', law, '","locator":"/law/root"}'))""") + ")"
_NATION_ARTICLE = "concat('node_', " + uuid5_sql("""sha256(concat('{"law_id":"', law, '","locator":"/law/root/article/article-1"}'))""") + ")"


def _line_code(template: str) -> str:
    root = "CASE WHEN root < article THEN '1' ELSE '2' END"
    article = "CASE WHEN root < article THEN '2' ELSE '1' END"
    pieces = template.replace("{root}", "', " + root + ", '").replace("{article}", "', " + article + ", '")
    return f"concat('{pieces}')"


@query(f"""WITH l AS (SELECT n_nationkey, concat('law_', {uuid5_sql('''sha256(concat('{"authority":"law","jurisdiction":"test","key":"', n_nationkey, '","key_kind":"source_law"}'))''')}) AS law FROM nation), i AS (SELECT n_nationkey, {_NATION_ROOT} AS root, {_NATION_ARTICLE} AS article FROM l)
SELECT concat('n', n_nationkey) AS corpus, CASE n_nationkey % {len(_LINE_FAULTS)} {' '.join(f"WHEN {i} THEN {_line_code(code)}" for i, (_, _, code) in enumerate(_LINE_FAULTS) if code)} END AS problem FROM i WHERE n_nationkey % {len(_LINE_FAULTS)} != {len(_LINE_FAULTS) - 1}""")
def q_faulty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of canonical files that are blank, malformed or of other keys, with their numbers."""
    from .plans.compile import compile_sources
    from .plans.store import corpus_files, first_problems, read_crosswalk, read_nodes, read_projection, write_files
    from .sources.tree import adapt_json
    from .tables import shared_dir

    files = corpus_files(compile_sources(adapt_json(_nation_trees(spark, sf_dir))))
    files = files.unionByName(table(spark, sf_dir, "nation").where(f"n_nationkey % {len(_LINE_FAULTS)} = 8").select(F.concat(F.lit("n"), text("n_nationkey"), F.lit("/crosswalk.json")).alias("path"), F.lit("").alias("content")), allowMissingColumns=True)
    k, name = F.regexp_extract("path", "^n(\\d+)/", 1).cast("int"), F.substring_index("path", "/", -1)
    changed = F.col("content")
    for i, (file, value, _) in enumerate(_LINE_FAULTS):
        if file is not None:
            changed = F.when((k % len(_LINE_FAULTS) == i) & (name == file), F.expr(value)).otherwise(changed)
    out = shared_dir(spark)
    write_files(files.withColumn("content", changed), out)
    found = first_problems(read_nodes(spark, out), read_crosswalk(spark, out), read_projection(spark, out))
    return found.select(F.substring_index("file", "/", -1).alias("corpus"), "problem")


@query(f"""WITH {_COMPILED} SELECT DISTINCT file, CASE WHEN c % 4 = 1 THEN 'source' WHEN c % 4 = 3 THEN 'crosswalk' WHEN c % 4 = 2 THEN 'projection' END AS wrong FROM line WHERE c % 4 != 0 AND (c % 4 != 2 OR kind != 'law')""")
def q_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and crosswalk rows whose sources no input declares, and repeated projections."""
    from .plans.compile import identify, project
    from .plans.store import foreign_sources, repeated_projections, strange_crosswalk
    from .sources.tree import adapt_json

    adapted = adapt_json(customer_trees(spark, sf_dir))
    k = F.substring("file", 2, 20).cast("long")
    inputs = adapted.inputs.withColumn("role", F.when(k % 4 == 1, "mapping").otherwise(F.col("role")))
    crosswalk = inputs.select("file", F.when(k % 4 == 3, F.lit("x")).otherwise(F.col("sha256")).alias("source_sha256"))
    projection = project(identify(adapted.nodes)).withColumn("n", F.explode(F.when(k % 4 == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    out = foreign_sources(adapted.nodes, inputs).select("file", F.lit("source").alias("wrong"))
    out = out.unionByName(strange_crosswalk(crosswalk, inputs).select("file", F.lit("crosswalk").alias("wrong"))).unionByName(repeated_projections(projection).select("file", F.lit("projection").alias("wrong")))
    return out.distinct()


# ---------------------------------------------------------------- receipts


@query("""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'ACQUISITION_CONFLICT' WHEN 1 THEN 'ACQUISITION_RETRIEVAL_PAIR' WHEN 2 THEN 'ACQUISITION_RETRIEVAL' WHEN 3 THEN 'ACQUISITION_AS_OF' WHEN 4 THEN 'ACQUISITION_URL' WHEN 6 THEN 'ACQUISITION_VALUES' END AS problem FROM documents""")
def q_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of fetched sources held against what the source says, each fault planted by key."""
    from .plans.compile import RECEIPT, receipt_problem

    k = F.col("doc_id")
    known = {"schema": DEFAULT.acquisition_schema, "source_authority": SOURCE_AUTHORITY, "source_format": SOURCE_FORMAT, "official_law_id": "L 1", "law_number": "1", "sha256": "0" * 64}
    base = F.struct(*(F.lit(known.get(c)).cast("string").alias(c) for c in RECEIPT)).withField("rights", F.when(k % 8 == 6, "stated"))
    url = "https://laws.e-gov.go.jp/api/2/law_data/L%201?law_full_text_format=xml&response_format=xml"
    given = base.withField("requested_law_id", F.lit("L 1")).withField("retrieved_at", F.when(k % 8 == 1, F.lit(None).cast("string")).when(k % 8 == 2, "2020-01-01").otherwise("2020-01-01T00:00:00Z"))
    given = given.withField("source_url", F.when(k % 8 == 4, "https://example.org/").when(k % 8 == 5, url + "&asof=2020-01-31").otherwise(url)).withField("as_of", F.when(k % 8 == 3, "2020-02-30").when(k % 8 == 5, "2020-01-31"))
    given = given.withField("law_number", F.when(k % 8 == 0, "other").otherwise("1"))
    return table(spark, sf_dir, "documents").select("doc_id", base.alias("base"), given.alias("given")).select("doc_id", receipt_problem().alias("problem"))


# ---------------------------------------------------------------- scans


@query(r"""WITH f AS (SELECT url AS path, html FROM pages), p AS (SELECT *, regexp_replace(path, '^https?://', '') AS q FROM f)
SELECT CASE WHEN length(q) % 4 = 0 THEN concat('/', q) WHEN length(q) % 4 = 1 THEN concat('../', q) WHEN length(q) % 4 = 2 THEN replace(q, '/', '\') ELSE q END AS path, rule, '' AS found FROM p,
(VALUES ('absolute', 0), ('parent', 1), ('backslash', 2)) AS r(rule, i) WHERE length(q) % 4 = i AND (rule != 'backslash' OR contains(q, '/'))
UNION ALL SELECT CASE WHEN length(q) % 4 = 0 THEN concat('/', q) WHEN length(q) % 4 = 1 THEN concat('../', q) WHEN length(q) % 4 = 2 THEN replace(q, '/', '\') ELSE q END, 'marker', 'example' FROM p WHERE contains(lower(q), 'example')""")
def q_path_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with markers, absolute ones, and those that climb or have backslashes."""
    from .operators.textscan import scan_paths

    q = F.regexp_replace("url", "^https?://", "")
    n = F.length(q) % 4
    path = F.when(n == 0, F.concat(F.lit("/"), q)).when(n == 1, F.concat(F.lit("../"), q)).when(n == 2, F.replace(q, F.lit("/"), F.lit("\\"))).otherwise(q)
    return scan_paths(table(spark, sf_dir, "pages").select(path.alias("path")), "path", ("example",))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents WHERE doc_id % 10 < 8),
m AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, 'email' AS rule, unnest(regexp_extract_all(line, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS found FROM l WHERE doc_id % 10 != 7
UNION ALL SELECT doc_id, CAST(line_no AS INTEGER), 'aws_access_key', unnest(regexp_extract_all(line, 'AKIA[0-9A-Z]{16}')) FROM l WHERE doc_id % 10 != 7
UNION ALL SELECT doc_id, CAST(line_no AS INTEGER), 'assigned_secret', unnest(regexp_extract_all(line, '(?i)\b(?:password|secret|api[_-]?key|access[_-]?token|client[_-]?secret)\s*[:=]\s*[''"][^''"]{6,}[''"]')) FROM l WHERE doc_id % 10 != 7
UNION ALL SELECT doc_id, CAST(line_no AS INTEGER), 'github_token', unnest(regexp_extract_all(line, 'gh[pousr]_[A-Za-z0-9]{20,}')) FROM l WHERE doc_id % 10 != 7)
SELECT concat('d/', doc_id, CASE WHEN doc_id % 10 = 7 THEN '.PNG' ELSE '.txt' END) AS path, line_no, rule, found FROM m WHERE rule != 'email' OR NOT regexp_matches(found, '(?i)@.*example\.(com|org|net)$')
UNION ALL SELECT concat('d/', doc_id, '.txt'), NULL, 'not_utf8', '' FROM documents WHERE doc_id % 10 >= 8""")
def q_tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files scanned by path, encoding and line, binary ones and addresses of examples left out."""
    from .operators.textscan import scan_tree

    k = F.col("doc_id")
    path = F.concat(F.lit("d/"), text("doc_id"), F.when(k % 10 == 7, ".PNG").otherwise(".txt"))
    content = F.when(k % 10 >= 8, F.unhex(F.lit("FF41"))).otherwise(F.encode("text", "UTF-8"))
    return scan_tree(table(spark, sf_dir, "documents").select(path.alias("path"), content.alias("content")))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS line_no FROM (SELECT doc_id, replace(text, '. ', concat('.', chr(10), chr(10))) AS t FROM documents)),
g AS (SELECT *, sum(CASE WHEN length(trim(line, ' ')) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS grp FROM l),
p AS (SELECT doc_id, CAST(min(line_no) AS INTEGER) AS first_line, string_agg(line, chr(10) ORDER BY line_no) AS text FROM g WHERE length(trim(line, ' ')) > 0 GROUP BY doc_id, grp),
r AS (SELECT doc_id, first_line, CASE WHEN regexp_matches(text, 'thein') OR regexp_matches(regexp_replace(text, '\s+', '', 'g'), 'thein') THEN 'joined' WHEN regexp_matches(text, '[0-9]{3}') OR regexp_matches(regexp_replace(text, '\s+', '', 'g'), '[0-9]{3}') THEN 'number' END AS rule FROM p)
SELECT doc_id, first_line, rule FROM r WHERE rule IS NOT NULL""")
def q_paragraph_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that match a pattern as they are or without white space."""
    from .operators.textscan import scan_paragraphs

    d = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))
    return scan_paragraphs(d, "doc_id", {"joined": "thein", "number": "[0-9]{3}"})


# ---------------------------------------------------------------- the bundle


@query("""SELECT * FROM (VALUES ('canonical', 3), ('derived', 1), ('index.md', 1), ('manifest.json', 1), ('references', 1)) AS t(part, n) UNION ALL SELECT 'source', 2 + count(*) FROM region UNION ALL SELECT 'verified', 2 + count(*) FROM region UNION ALL SELECT 'linked', 1 + count(*) FROM region""")
def q_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle of one law of the regions, written, verified, and its pages read back: files by part. The crosswalk is empty, and Spark lists no empty file."""
    from .plans.bundle import export_bundle, lost_parents, read_pages, verify_bundle
    from .plans.compile import compile_sources
    from .plans.store import write_corpora, write_files
    from .sources.law_xml import adapt_laws
    from .tables import shared_dir

    piece = F.expr("""concat('<Article Num="', r_regionkey + 1, '"><ArticleTitle>Article ', r_regionkey + 1, '</ArticleTitle><Paragraph Num="', 1, '"><ParagraphSentence><Sentence>', r_name, '</Sentence></ParagraphSentence></Paragraph></Article>')""")
    piece = F.regexp_replace(piece, "<Paragraph Num.*</Paragraph>", "")
    articles = table(spark, sf_dir, "region").agg(F.array_join(F.array_sort(F.collect_list(piece)), "").alias("a"))
    law = articles.select(F.lit("law").alias("file"), F.encode(F.concat(F.lit('<Law LawId="L" LawType="Act"><LawNum>1</LawNum><LawBody><LawTitle>T</LawTitle><MainProvision>'), "a", F.lit("</MainProvision></LawBody></Law>")), "UTF-8").alias("content"))
    corpus, sources, bundle = (shared_dir(spark) for _ in range(3))
    write_files(law.select(F.lit("law.xml").alias("path"), "content"), sources)
    write_corpora(compile_sources(adapt_laws(law), converted_at="2026-01-01T00:00:00Z"), corpus, single=True)
    export_bundle(spark, corpus, bundle, f"{sources}/law.xml", verify=False)
    told = verify_bundle(spark, bundle)
    pages = read_pages(spark, bundle)
    linked = pages.where("parent_id IS NOT NULL").count() - lost_parents(pages).count()
    at = F.regexp_extract("path", r"/((?:(?:canonical|derived|references|source)/)?[^/]+)\z", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(bundle).select(at.alias("at"))
    parts = files.groupBy(F.regexp_extract("at", "^([^/]+)", 1).alias("part")).agg(F.count("*").alias("n"))
    return parts.unionByName(spark.createDataFrame([("verified", told["nodes"]), ("linked", linked)], "part string, n long"))


_STRANGER = "x"
_BUNDLE_FAULTS = (
    (None, None, None), ("BUNDLE_MANIFEST", "manifest.json", "'{'"), ("BUNDLE_MANIFEST_SHAPE", "manifest.json", "replace(t, '\"profile\":', '\"profiles\":')"), ("BUNDLE_MANIFEST_TAMPERED", "index.md", "concat(t, ' ')"),
    ("BUNDLE_CANONICAL_TAMPERED", "manifest.json", "regexp_replace(t, '\"canonical_corpus_sha256\":\"[0-9a-f]+', concat('\"canonical_corpus_sha256\":\"', repeat('0', 64)))"),
    ("BUNDLE_RIGHTS_MISMATCH", "manifest.json", "replace(t, '\"schema\":\"lawloom-bundle/v1\"', '\"rights\":{\"source_license\":\"x\"},\"schema\":\"lawloom-bundle/v2\"')"),
    ("BUNDLE_FILE_SET: extra source/stranger.md", "manifest.json", f"replace(t, '],\"profile\"', concat(',{{\"path\":\"source/stranger.md\",\"sha256\":\"', sha2('{_STRANGER}', 256), '\"}}],\"profile\"'))"),
)


def nation_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content): a law of each nation that has suppliers, with an article for each."""
    piece = F.expr("""concat('<Article Num="', s_suppkey + 1, '"><ArticleTitle>', s_name, '</ArticleTitle></Article>')""")
    rows = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", piece.alias("piece")))), lambda x: x["piece"]), "").alias("articles"))
    law = F.concat(F.lit('<Law LawId="L'), text("s_nationkey"), F.lit('" LawType="Act"><LawNum>1</LawNum><LawBody><LawTitle>T</LawTitle><MainProvision>'), "articles", F.lit("</MainProvision></LawBody></Law>"))
    return rows.select(F.concat(F.lit("n"), text("s_nationkey")).alias("file"), F.encode(law, "UTF-8").alias("content"))


@query(f"""SELECT concat('n', s_nationkey) AS bundle, 2 + count(*) AS pages, CASE s_nationkey % {len(_BUNDLE_FAULTS)} {' '.join(f"WHEN {i} THEN '{code}'" for i, (code, _, _) in enumerate(_BUNDLE_FAULTS) if code)} END AS code FROM supplier GROUP BY s_nationkey""")
def q_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of all nations' laws made in one plan, changed by key, written and verified: pages, and the first code that speaks against each, or null."""
    from .plans.bundle import bundle_files, verify_bundles
    from .plans.compile import compile_sources
    from .plans.store import write_corpora, write_files
    from .sources.law_xml import adapt_laws
    from .tables import materialise, shared_dir, spread

    laws = materialise(spread(nation_laws(spark, sf_dir), "file"))
    corpora, out = shared_dir(spark), shared_dir(spark)
    write_corpora(compile_sources(adapt_laws(laws), converted_at="2026-01-01T00:00:00Z"), corpora)
    files, _ = bundle_files(spark, corpora, laws)
    k = F.regexp_extract("file", "n(\\d+)\\z", 1).cast("int")
    changed = F.col("content")
    for i, (_, path, value) in enumerate(_BUNDLE_FAULTS):
        if path is not None:
            new = F.expr(value.replace("(t,", "(cast(content as string),"))
            changed = F.when((k % len(_BUNDLE_FAULTS) == i) & (F.col("path") == path), new.cast("binary")).otherwise(changed)
    name = F.concat(F.lit("n"), k.cast("string"))
    made = files.select(F.concat(name, F.lit("/"), "path").alias("path"), "part", changed.alias("content"))
    strange = files.where((k % len(_BUNDLE_FAULTS) == len(_BUNDLE_FAULTS) - 1) & (F.col("path") == "index.md")).select(F.concat(name, F.lit("/source/stranger.md")).alias("path"), F.lit(_STRANGER).cast("binary").alias("content")).distinct()
    write_files(made.unionByName(strange, allowMissingColumns=True), out)
    pages = files.where("path LIKE 'source/%'").groupBy(name.alias("bundle")).agg(F.count("*").alias("pages"))
    return pages.join(verify_bundles(spark, out).select(F.substring_index("file", "/", -1).alias("bundle"), "code"), "bundle")


# ---------------------------------------------------------------- recipes, crosswalks and manifests of every version


def _own_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content, mapping, k): a file of XML rows of each supplier, in words of its own that only its own mapping knows."""
    xml = F.expr("""concat('<f><r', s_suppkey, '><j>J</j><a>A</a><s>S', s_suppkey, '</s><l>root</l><k>law</k><d>0</d><t', s_suppkey, '>', s_name, '</t', s_suppkey, '></r', s_suppkey, '></f>')""")
    fields = F.expr("""concat('{"fields":{"authority":"a","depth":{"path":"d","type":"int"},"jurisdiction":"j","kind":"k","locator":"l","source_law_key":"s","text":"t', s_suppkey, '"},"row":"r', s_suppkey, '"}')""")
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), text("s_suppkey")).alias("file"), F.encode(xml, "UTF-8").alias("content"), fields.alias("mapping"), F.col("s_suppkey").alias("k"))


@query("""SELECT concat('s', s_suppkey) AS corpus, CASE s_suppkey % 5 WHEN 1 THEN 'MANIFEST_REPLAY_SOURCE_MISMATCH' WHEN 2 THEN 'MANIFEST_INPUT_UNAVAILABLE' WHEN 3 THEN 'MANIFEST_REBUILD_FAILED' WHEN 4 THEN 'MANIFEST_JSON' END AS code FROM supplier""")
def q_replayed_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpora of as many mappings as suppliers, compiled, written and compiled anew in one plan: other bytes, no source, a mapping that finds nothing, and no manifest, by key."""
    from .plans.compile import compile_sources
    from .plans.store import corpus_files, replay, write_files
    from .sources.tree import adapt_xml
    from .tables import materialise, shared_dir, spread

    rows = materialise(spread(_own_rows(spark, sf_dir), "file"))
    files = corpus_files(compile_sources(adapt_xml(rows), mapping=rows.select("file", "mapping"), check=False))
    k = F.regexp_extract("path", "^s(\\d+)/", 1).cast("long")
    here = F.substring_index("path", "/", -1) == "manifest.json"
    changed = F.when(here & (k % 5 == 3), F.regexp_replace("content", '"path":"d","type":"int"', '"path":"d","type":"date"')).when(here & (k % 5 == 4), "[").otherwise(F.col("content"))
    out = shared_dir(spark)
    write_files(files.withColumn("content", changed), out)
    given = rows.where("k % 5 != 2").select(F.col("file").alias("corpus"), F.when(F.col("k") % 5 == 1, F.lit(b"<f/>")).otherwise(F.col("content")).alias("content"))
    return replay(spark, out, given).select(F.substring_index("file", "/", -1).alias("corpus"), "code")


@query("""SELECT concat('s', s_suppkey) AS corpus, CASE s_suppkey % 4 WHEN 1 THEN 'ARTIFACT_NOT_CANONICAL' WHEN 2 THEN 'PROJECTION_DERIVATION_MISMATCH' WHEN 3 THEN 'ARTIFACT_NOT_CANONICAL' END AS code FROM supplier""")
def q_noncanonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpora whose digests agree with their manifests but whose lines are spaced otherwise, reordered, or projected from another text."""
    from .plans.compile import compile_sources
    from .plans.store import corpus_files, verify_corpora, write_files
    from .sources.tree import adapt_json
    from .tables import materialise, shared_dir

    json = F.expr("""concat('{"authority":"Law","jurisdiction":"Test","nodes":[{"children":[{"kind":"article","locator":"a","ordinal":1,"text":"customer"}],"kind":"law","locator":"root","text":"', s_name, '"}],"source_law_key":"', s_suppkey, '"}')""")
    trees = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), text("s_suppkey")).alias("file"), F.encode(json, "UTF-8").alias("content"))
    files = corpus_files(compile_sources(adapt_json(trees), check=False))
    k, name = F.regexp_extract("path", "^s(\\d+)/", 1).cast("long"), F.substring_index("path", "/", -1)
    turned = F.concat(F.array_join(F.reverse(F.split(F.rtrim("content"), "\n")), "\n"), F.lit("\n"))
    changed = F.when((k % 4 == 1) & (name == "corpus.jsonl"), F.replace("content", F.lit(',"branch"'), F.lit(', "branch"'))).when((k % 4 == 2) & (name == "projection.jsonl"), F.replace("content", F.lit("customer"), F.lit("Customer")))
    changed = materialise(files.withColumn("content", changed.when((k % 4 == 3) & (name == "corpus.jsonl"), turned).otherwise(F.col("content"))))
    sums = changed.where(name.isin("corpus.jsonl", "projection.jsonl")).groupBy(k.alias("k")).agg(*(F.max(F.when(name == f"{n}.jsonl", F.sha2("content", 256))).alias(n) for n in ("corpus", "projection")))
    told = changed.withColumn("k", k).join(sums, "k")
    stated = F.regexp_replace(F.regexp_replace("content", F.lit('"corpus_sha256":"[0-9a-f]+"'), F.concat(F.lit('"corpus_sha256":"'), "corpus", F.lit('"'))), F.lit('"projection_sha256":"[0-9a-f]+"'), F.concat(F.lit('"projection_sha256":"'), "projection", F.lit('"')))
    out = shared_dir(spark)
    write_files(told.select("path", "part", F.when(name == "manifest.json", stated).otherwise(F.col("content")).alias("content")), out)
    return verify_corpora(spark, out).select(F.substring_index("file", "/", -1).alias("corpus"), "code")


@query(f"""WITH {_COMPILED}, x AS (SELECT file, locator, concat('{{"legacy_id":"old', locator, '","reason":"moved","relation":"exact","source_sha256":"', sha, '","target_node_id":"', node_id, '","target_version_id":"', version_id, '"}}') AS line FROM ver WHERE kind IN ('law', 'article')),
g AS (SELECT file, count(*) AS n, sha256(string_agg(concat(line, chr(10)), '' ORDER BY locator)) AS sha FROM x GROUP BY 1)
SELECT x.file, line, CAST(n AS BIGINT) AS n, g.sha AS crosswalk_sha256 FROM x JOIN g ON g.file = x.file""")
def q_crosswalk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crosswalks to laws and articles, moved to the versions that carry the build's fingerprint: canonical lines, their number and digest."""
    from dataclasses import replace

    from .plans.compile import compile_sources, identify
    from .sources.tree import adapt_json

    adapted = adapt_json(customer_trees(spark, sf_dir))
    old = identify(adapted.nodes).where("kind IN ('law', 'article')")
    crosswalk = old.select("file", "pos", F.concat(F.lit("old"), "locator").alias("legacy_id"), F.col("node_id").alias("target_node_id"), F.col("version_id").alias("target_version_id"), F.lit("exact").alias("relation"), F.lit("moved").alias("reason"), F.col("source.sha256").alias("source_sha256"))
    compiled = compile_sources(replace(adapted, crosswalk=crosswalk), check=False)
    told = compiled.manifest.select("file", F.get_json_object("manifest", "$.crosswalk_count").cast("long").alias("n"), F.get_json_object("manifest", "$.crosswalk_sha256").alias("crosswalk_sha256"))
    return compiled.crosswalk_lines().select("file", "line").join(told, "file")


_RIGHTS = {"bundle_license": None, "commercial_use_allowed": False, "redistribution_allowed": True, "source_license": "terms"}
_RIGHTS_JSON = '{"bundle_license":null,"commercial_use_allowed":false,"redistribution_allowed":true,"source_license":"terms"}'
_CONVERSION_JSON = '{"name":"lawloom","profile":"lawloom/0.1","version":"0.1"}'


@query(f"""WITH s AS (SELECT s_nationkey AS k, concat('<Law LawId="L', s_nationkey, '" LawType="Act"><LawNum>1</LawNum><LawBody><LawTitle>T</LawTitle><MainProvision>', string_agg(concat('<Article Num="', s_suppkey + 1, '"><ArticleTitle>', s_name, '</ArticleTitle></Article>'), '' ORDER BY s_suppkey), '</MainProvision></LawBody></Law>') AS xml, count(*) AS n FROM supplier GROUP BY 1),
h AS (SELECT *, sha256(xml) AS sha FROM s),
p AS (SELECT *, concat('{{"as_of":null,"law_number":"1","official_law_id":"L', k, '","requested_law_id":null,"retrieved_at":null,"rights":null,"schema":"{DEFAULT.acquisition_schema}","sha256":"', sha, '","source_authority":"{SOURCE_AUTHORITY}","source_format":"{SOURCE_FORMAT}","source_url":null}}') AS acquisition, {_INPUTS} AS inputs FROM h),
o AS (SELECT *, concat('{{"acquisition":', acquisition, ',"adapter":"egov_xml","adapter_version":"1","build_recipe":{{"adapter":"egov_xml","mapping":null}},"canonicalization":"{CANONICALIZATION}","conversion":{_CONVERSION_JSON},"hierarchy_status":"full","inputs":', inputs, ',"required_input_roles":["source"]', CASE WHEN k % 2 = 1 THEN ',"rights":{_RIGHTS_JSON}' ELSE '' END, '}}') AS options FROM p)
SELECT concat('n', k) AS file, CASE WHEN k % 2 = 1 THEN '{DEFAULT.manifest_rights}' ELSE '{DEFAULT.manifest_acquired}' END AS schema, acquisition, '{_CONVERSION_JSON}' AS conversion, '2026-01-01T00:00:00Z' AS converted_at, CASE WHEN k % 2 = 1 THEN '{_RIGHTS_JSON}' END AS rights, inputs, 2 + n AS nodes, sha256(options) AS build_options_sha256 FROM o""")
def q_acquired_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of laws with receipts, every second one with rights: both versions, and the digest of their options."""
    from .plans.compile import compile_sources
    from .sources.law_xml import adapt_laws
    from .tables import materialise

    laws = materialise(nation_laws(spark, sf_dir))
    out = None
    for odd, rights in ((0, None), (1, _RIGHTS)):
        some = laws.where(f"cast(substring(file, 2) as int) % 2 = {odd}")
        m = compile_sources(adapt_laws(some), converted_at="2026-01-01T00:00:00Z", rights=rights, check=False).manifest
        part = lambda k: F.get_json_object("manifest", f"$.{k}").alias(k)
        told = m.select("file", *map(part, ("schema", "acquisition", "conversion", "converted_at", "rights", "inputs")), F.get_json_object("manifest", "$.node_count").cast("long").alias("nodes"), part("build_options_sha256"))
        out = told if out is None else out.unionByName(told)
    return out


# ---------------------------------------------------------------- citations and pattern tables


@query(r"""WITH d AS (SELECT concat('d', doc_id, '.md') AS path, concat(coalesce(text, ''), chr(10), 'see `src/m', doc_id % 9, '.py` `f', doc_id % 5, CASE WHEN doc_id % 2 = 0 THEN '()' ELSE '' END, '` and `src/../m.py` `x`', CASE WHEN doc_id % 4 = 0 THEN ' and a/m.py:12-14' ELSE '' END) AS t FROM documents),
l AS (SELECT path, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS line_no FROM d),
c AS (SELECT path, line_no, unnest(regexp_extract_all(line, '`((?:src|tests)/[A-Za-z0-9_./-]+\.py)` `([A-Za-z_][A-Za-z0-9_]*)(?:\(\))?`', 1)) AS cited, unnest(regexp_extract_all(line, '`((?:src|tests)/[A-Za-z0-9_./-]+\.py)` `([A-Za-z_][A-Za-z0-9_]*)(?:\(\))?`', 2)) AS symbol FROM l)
SELECT path, CAST(line_no AS INTEGER) AS line_no, cited, symbol, problem FROM (SELECT *, CASE WHEN contains(cited, '/../') THEN 'CITED_PARENT' WHEN NOT regexp_matches(cited, '^src/m[0-7]\.py$') THEN 'CITED_MISSING' WHEN cited = 'src/m3.py' THEN 'CITED_UNPARSED' WHEN cited = 'src/m7.py' THEN 'CITED_NOT_UTF8' WHEN symbol NOT IN ('f0', 'f1', 'f2', 'f3') THEN 'CITED_UNDEFINED' END AS problem FROM c) WHERE problem IS NOT NULL
UNION ALL SELECT path, CAST(line_no AS INTEGER), unnest(regexp_extract_all(line, '[A-Za-z0-9_./-]*[A-Za-z0-9_-]\.py:\d+(?:-\d+)?')), NULL, 'CITED_BY_LINE' FROM l""")
def q_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in all documents against modules, of which some are missing, do not parse or lack the symbol."""
    from .operators.citations import check_citations

    k = F.col("doc_id")
    cite = F.concat(F.lit("\nsee `src/m"), text(k % 9), F.lit(".py` `f"), text(k % 5), F.when(k % 2 == 0, "()").otherwise(""), F.lit("` and `src/../m.py` `x`"), F.when(k % 4 == 0, " and a/m.py:12-14").otherwise(""))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), text("doc_id"), F.lit(".md")).alias("path"), F.concat(F.coalesce("text", F.lit("")), cite).alias("text"))
    n = table(spark, sf_dir, "nation").where("n_nationkey < 8")
    source = F.when(F.col("n_nationkey") == 3, F.lit(b"def (")).when(F.col("n_nationkey") == 7, F.lit(b"\xff")).otherwise(F.lit(b"def f0():\n    f4 = 1\nclass f1: pass\nf2 = 0\nf3: int = 1\n"))
    return check_citations(docs, n.select(F.concat(F.lit("src/m"), text("n_nationkey"), F.lit(".py")).alias("path"), source.alias("content")))


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{5,}')) AS word FROM benchmark)
SELECT doc_id, word AS label FROM documents JOIN w ON contains(text, word) WHERE regexp_matches(text, concat(word, '[a-z]'))""")
def q_pattern_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of the benchmark as a pattern of its own, followed by a letter: the documents that each matches, in one pass."""
    from .operators.patterns import search_patterns

    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{5,}"), F.lit(0))).alias("label")).distinct()
    return search_patterns(table(spark, sf_dir, "documents"), "doc_id", words.select("label", F.concat("label", F.lit("[a-z]")).alias("pattern")))


# ---------------------------------------------------------------- compiling what arrives


@query("""SELECT concat(CASE WHEN s_suppkey % 2 = 0 THEN 'first' ELSE 'later' END, '/s', s_suppkey, '.json') AS file, CASE WHEN s_suppkey % 7 = 0 THEN 'ADAPTER_SOURCE: JSONDecodeError' END AS diagnostic,
CAST(s_suppkey % 7 != 0 AS INTEGER) AS corpora, NULL::VARCHAR AS code FROM supplier""")
def q_stream_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' trees that arrive in two lots, the later one with copies of all of the first, compiled by a stream that is started three times."""
    from .plans.store import verify_corpora, write_files
    from .sources.tree import adapt_json
    from .streaming.admission import arriving_files
    from .streaming.compiling import committed, compile_log, compile_stream
    from .tables import shared_dir

    inbox, out, state = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    json = F.expr("""concat('{"authority":"Law","jurisdiction":"Test","nodes":[{"kind":"law","locator":"root","text":"', s_name, IF(s_suppkey % 7 = 0, '"}', '"}],"source_law_key":"'), s_suppkey, '"}')""")
    even = F.col("s_suppkey") % 2 == 0
    made = table(spark, sf_dir, "supplier").select(even.alias("even"), F.concat(F.lit("s"), text("s_suppkey"), F.lit(".json")).alias("path"), F.encode(json, "UTF-8").alias("content"))
    copies = made.where("even").withColumn("path", F.concat(F.lit("copy-"), "path"))
    for lot, arriving in (("first", made.where("even")), ("later", made.where("NOT even").unionByName(copies)), ("none", None)):
        if arriving is not None:
            write_files(arriving.drop("even"), f"{inbox}/{lot}")
        compile_stream(arriving_files(spark, f"{inbox}/*", glob="*.json", files_per_trigger=10_000), out, state, adapt_json, check=False).awaitTermination()
    stem = F.regexp_extract("file", "(s[0-9]+[.]json)-[0-9a-f]{16}\\z", 1)
    verified = verify_corpora(spark, committed(out)).groupBy(stem.alias("name")).agg(F.count("*").cast("int").alias("corpora"), F.max("code").alias("code"))
    log = compile_log(spark, out).select(F.regexp_extract("file", "([^/]+/[^/]+)\\z", 1).alias("file"), "diagnostic", F.substring_index("file", "/", -1).alias("name"))
    return log.join(verified, "name", "left").select("file", "diagnostic", F.coalesce("corpora", F.lit(0)).alias("corpora"), "code")


# ---------------------------------------------------------------- members of packages

_MEMBERS = "SELECT concat('p', o_custkey % 40) AS package, o_orderkey AS o, concat('data/', o_orderstatus, '/', o_orderkey % 3, '/', o_orderkey, '.txt') AS path, o_orderkey % 13 AS k FROM orders"


@query(f"""WITH m AS ({_MEMBERS}), held AS (SELECT * FROM m WHERE k NOT IN (1, 6, 7)),
found AS (SELECT package, path, 'MEMBER_MISSING' AS code FROM m WHERE k IN (1, 5, 6, 7) UNION ALL SELECT package, path, 'MEMBER_DUPLICATE' FROM m WHERE k = 2 UNION ALL SELECT package, path, 'MEMBER_SIZE' FROM m WHERE k = 3
UNION ALL SELECT package, path, 'MEMBER_DIGEST' FROM m WHERE k = 4 UNION ALL SELECT package, path, 'MEMBER_NOT_REGULAR' FROM m WHERE k = 5
UNION ALL SELECT package, concat('../', path), 'MEMBER_PATH_PARENT' FROM m WHERE k = 6 UNION ALL SELECT package, concat('/', path), 'MEMBER_PATH_ABSOLUTE' FROM m WHERE k = 7 UNION ALL SELECT package, concat('/', path), 'MEMBER_PATH_EMPTY_STEP' FROM m WHERE k = 7
UNION ALL SELECT package, concat(path, '.new'), 'MEMBER_UNEXPECTED' FROM m WHERE k = 8 UNION ALL SELECT DISTINCT package, concat('spare/', o), 'MEMBER_FOLDER_UNEXPECTED' FROM m WHERE k = 9
UNION ALL SELECT package, path, 'MEMBER_DENIED' FROM held WHERE path LIKE 'data/F/%' AND path NOT LIKE 'data/F/1/%' UNION ALL SELECT package, concat(path, '.new'), 'MEMBER_DENIED' FROM m WHERE k = 8 AND path LIKE 'data/F/%' AND path NOT LIKE 'data/F/1/%')
SELECT * FROM found""")
def q_member_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as members of packages, faults planted by key; a folder is denied, one below it allowed again."""
    from .operators.members import audit_members

    o = table(spark, sf_dir, "orders")
    path = F.concat_ws("/", F.lit("data"), "o_orderstatus", text(F.col("o_orderkey") % 3), F.concat(text("o_orderkey"), F.lit(".txt")))
    m = o.select(F.concat(F.lit("p"), text(F.col("o_custkey") % 40)).alias("package"), path.alias("path"), F.lit("file").alias("kind"), F.col("o_orderkey").alias("size"), F.sha2(text("o_orderkey"), 256).alias("sha256"), (F.col("o_orderkey") % 13).alias("k"))
    made = m.where("k != 1").withColumn("path", F.expr("CASE k WHEN 6 THEN concat('../', path) WHEN 7 THEN concat('/', path) ELSE path END"))
    made = made.withColumn("size", F.expr("IF(k = 3, size + 1, size)")).withColumn("sha256", F.expr("IF(k = 4, reverse(sha256), sha256)")).withColumn("kind", F.expr("IF(k = 5, 'link', kind)"))
    folders = m.where("k = 9").select("package", F.concat(F.lit("spare/"), text("size"), F.lit("/")).alias("path"), F.lit("folder").alias("kind"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("sha256"), "k")
    above = m.select("package", F.lit("data").alias("path"), F.lit("folder").alias("kind"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("sha256"), F.lit(0).alias("k")).distinct()
    made = made.unionByName(m.where("k = 2")).unionByName(m.where("k = 8").withColumn("path", F.concat("path", F.lit(".new")))).unionByName(folders).unionByName(above)
    rules = table(spark, sf_dir, "orders").select(F.concat(F.lit("data/"), "o_orderstatus").alias("prefix"), (F.col("o_orderstatus") != "F").alias("allowed")).distinct()
    again = rules.where("NOT allowed").select(F.concat("prefix", F.lit("/1")).alias("prefix"), F.lit(True).alias("allowed"))
    return audit_members(made, m, rules.unionByName(again))
