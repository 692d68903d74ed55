"""The registered queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_file_digests

    return token_file_digests(read_table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"), end_id=1)


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"), size=2048, end_id=0)


@query
def op5_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .unit_dedup import repeated_units

    return repeated_units(read_table(spark, sf_dir, "documents"))


@query
def unit_dedup_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the documents of which units go."""
    from pyspark.sql import functions as F

    from .unit_dedup import remove_units, repeated_units

    documents = read_table(spark, sf_dir, "documents")
    left = remove_units(documents, repeated_units(documents)).where("removed_spans IS NOT NULL")
    return left.select("doc_id", "text", F.size("removed_spans").alias("n_spans"))


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(read_table(spark, sf_dir, "documents"))


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import similar_documents

    return similar_documents(read_table(spark, sf_dir, "documents"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .toxicity import fit, held_out, score_documents

    documents = read_table(spark, sf_dir, "documents")
    scored = score_documents(documents, fit(documents, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "rejected")


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .decontaminate import contaminated

    found = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.round("similarity", 9))  # sums of another order differ in the last digits


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents"))


@query
def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    embeddings = read_table(spark, sf_dir, "embeddings")
    return nearest(embeddings, embeddings.where("vec_id % 50 = 0"))


@query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a thousand and a hundred ids are directories, and each tenth id is the name of a licence file."""
    from pyspark.sql import functions as F

    from .licenses import scan_licenses

    name = F.when(F.col("doc_id") % 10 == 0, "COPYING").otherwise("text")
    path = F.concat_ws("/", F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 100).cast("string"), F.concat_ws(".", name, F.col("doc_id").cast("string")))
    scanned = scan_licenses(read_table(spark, sf_dir, "documents").select(path.alias("path"), "text"))
    scanned = scanned.withColumn("similarity", F.round("similarity", 9))  # sums of another order differ in the last digits
    return scanned.withColumn("doc_id", F.substring_index("path", ".", -1).cast("long"))


#: Runs of what parts words, for DuckDB.
_GAP = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"


def _words(text: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({text}), '{_GAP}', ' ', 'g'), ' '), lambda x: x != '')"


ORACLES["op2_jaccard_join"] = f"""WITH RECURSIVE w AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
half AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
e AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM reach r JOIN e ON r.y = e.a),
same AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY w) END AS copy_of, CASE WHEN len(w) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY w) END AS n_copies FROM w)
SELECT doc_id, (SELECT min(y) FROM reach WHERE x = doc_id) AS class_id, (SELECT count(*) FROM e WHERE a = doc_id) AS n_links, copy_of, n_copies FROM same"""

_UNITS = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents WHERE text != ''),
lo AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1 AS s0, len({_words("line")}) AS line_words FROM l),
s AS (SELECT doc_id, k, s0, line_words, unnest(string_split(regexp_replace(line, '([.!?]) ', concat('\\1', chr(1)), 'g'), chr(1))) AS u, unnest(range(1, len(string_split(regexp_replace(line, '([.!?]) ', concat('\\1', chr(1)), 'g'), chr(1))) + 1)) AS j FROM lo),
so AS (SELECT *, s0 + sum(length(u) + 1) OVER (PARTITION BY doc_id, k ORDER BY j) - length(u) - 1 AS a, len({_words("u")}) AS n FROM s),
units AS (SELECT doc_id, line AS u, s0 + CASE WHEN line[1:1] = ' ' THEN 1 ELSE 0 END AS a, s0 + length(line) AS b, line_words AS n FROM lo WHERE line_words >= 1
UNION ALL SELECT doc_id, u, a + CASE WHEN j = 1 AND u[1:1] = ' ' THEN 1 ELSE 0 END, a + length(u), n FROM so WHERE n >= 8 AND n != line_words),
d AS (SELECT doc_id, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(n AS INTEGER) AS n, array_to_string({_words("u")}, ' ') AS key FROM units),
f AS (SELECT *, min({{'doc': doc_id, 'at': a}}) OVER (PARTITION BY key) AS first FROM d)"""

ORACLES["op5_unit_dedup"] = f"""WITH {_UNITS}
SELECT doc_id, a AS start, b AS "end", n AS n_words, first.doc AS first_doc_id, first.at AS first_start FROM f WHERE doc_id != first.doc OR a != first.at"""

ORACLES["unit_dedup_texts"] = f"""WITH {_UNITS},
gone AS (SELECT DISTINCT doc_id, a, b FROM f WHERE doc_id != first.doc OR a != first.at),
c AS (SELECT doc_id, text, unnest(range(0, length(text))) AS i FROM documents WHERE doc_id IN (SELECT doc_id FROM gone)),
keep AS (SELECT doc_id, i, text[i + 1:i + 1] AS x FROM c WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = c.doc_id AND c.i >= g.a AND c.i < g.b))
SELECT d.doc_id, coalesce((SELECT string_agg(x, '' ORDER BY i) FROM keep k WHERE k.doc_id = d.doc_id), '') AS text, CAST((SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS INTEGER) AS n_spans
FROM (SELECT DISTINCT doc_id FROM gone) d"""

ORACLES["op7_suffix_dedup"] = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, n, k, substr(h, 2 * k + 1, 2 * 549) AS h FROM (SELECT doc_id, h, length(h) // 2 AS n, unnest(range(0, length(h) // 2, 500)) AS k FROM t)),
w AS (SELECT doc_id, k + j AS i, substr(h, 2 * j + 1, 2) AS byte, CASE WHEN k + j <= n - 50 THEN substr(h, 2 * j + 1, 100) END AS string FROM (SELECT doc_id, n, k, h, unnest(range(0, least(500, n - k))) AS j FROM b)),
f AS (SELECT string, min(doc_id) AS least FROM w WHERE string IS NOT NULL GROUP BY 1),
c AS (SELECT w.doc_id, w.i, w.byte, coalesce(max(CASE WHEN w.doc_id > f.least THEN w.i END) OVER (PARTITION BY w.doc_id ORDER BY w.i), -50) >= w.i - 49 AS gone FROM w LEFT JOIN f ON f.string = w.string),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
s AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM r GROUP BY 1)
SELECT t.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM t LEFT JOIN s ON s.doc_id = t.doc_id"""

_L = r"\p{L}"
_BASE_SQL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _found_sql(kind: str, rank: int) -> str:
    marked = f"string_split(regexp_replace(text, '{_BASE_SQL[kind]}', concat(chr(1), '\\0', chr(1)), 'g'), chr(1))"
    return f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, unnest({marked}) AS v, unnest(range(0, len({marked}))) AS i FROM d"


_DIGITS_SQL = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(0, length({_DIGITS_SQL})), lambda i: CASE WHEN i % 2 = 0 THEN TRY_CAST(reverse({_DIGITS_SQL})[i + 1:i + 1] AS INTEGER) ELSE TRY_CAST(reverse({_DIGITS_SQL})[i + 1:i + 1] AS INTEGER) * 2 - 9 * CAST(TRY_CAST(reverse({_DIGITS_SQL})[i + 1:i + 1] AS INTEGER) > 4 AS INTEGER) END)) % 10 = 0"


def _split_sql(text: str) -> str:
    return f"list_distinct(list_filter(string_split(regexp_replace(lower({text}), '[^{_L}]+', ' ', 'g'), ' '), lambda w: w != ''))"


ORACLES["op10_pii"] = f"""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), chr(1), chr(2)) AS text FROM documents),
pieces AS ({' UNION ALL '.join(_found_sql(kind, rank) for rank, kind in enumerate(_BASE_SQL))}),
placed AS (SELECT *, sum(length(v)) OVER (PARTITION BY doc_id, rank ORDER BY i) - length(v) AS a FROM pieces),
base AS (SELECT doc_id, rank, kind, v, CAST(a AS BIGINT) AS a, CAST(a + length(v) AS BIGINT) AS b FROM placed WHERE i % 2 = 1 AND CASE kind WHEN 'email' THEN true WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda p: coalesce(TRY_CAST(p AS HUGEINT), 256) > 255)) = 0
WHEN 'card' THEN length({_DIGITS_SQL}) BETWEEN 13 AND 19 AND {_LUHN} ELSE length({_DIGITS_SQL}) BETWEEN 9 AND 15 END),
ctx AS (SELECT base.doc_id, lower(v) AS entity, substr(text, CAST(greatest(a - 80, 0) AS BIGINT) + 1, CAST(least(a, 80) AS BIGINT)) AS l, a > 80 AND regexp_full_match(substr(text, a - 80, 1), '{_L}') AS lcut, substr(text, b + 1, 80) AS r, regexp_full_match(substr(text, b + 81, 1), '{_L}') AS rcut FROM base JOIN d ON d.doc_id = base.doc_id),
beside AS (SELECT doc_id, entity, {_split_sql(f"concat(CASE WHEN lcut THEN regexp_replace(l, '^{_L}+', '') ELSE l END, ' ', CASE WHEN rcut THEN regexp_replace(r, '{_L}+$', '') ELSE r END)")} AS terms FROM ctx),
pair AS (SELECT DISTINCT doc_id, entity, term FROM (SELECT doc_id, entity, unnest(terms) AS term FROM beside)),
n AS (SELECT count(*) AS total FROM d), ne AS (SELECT entity, count(DISTINCT doc_id) AS n_e FROM ctx GROUP BY 1),
nt AS (SELECT term, count(*) AS n_t FROM (SELECT unnest({_split_sql("text")}) AS term FROM d) GROUP BY 1),
share AS (SELECT entity, term, CASE WHEN n_e < total THEN ln(count(*) * total / (n_t * n_e)) / ln(total / n_e) ELSE 0 END AS share FROM pair JOIN ne USING (entity) JOIN nt USING (term), n GROUP BY entity, term, n_e, n_t, total),
flag AS (SELECT doc_id, term, bool_or(share >= 1 - 1e-9) AS gone FROM pair JOIN share USING (entity, term) WHERE share >= 0.8 - 1e-12 GROUP BY 1, 2),
marked AS (SELECT doc_id, string_split(regexp_replace(text, '{_L}+', concat(chr(1), '\\0', chr(1)), 'g'), chr(1)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM flag)),
word AS (SELECT *, sum(length(v)) OVER (PARTITION BY doc_id ORDER BY i) - length(v) AS a FROM (SELECT doc_id, unnest(p) AS v, unnest(range(0, len(p))) AS i FROM marked)),
term AS (SELECT word.doc_id, CASE WHEN gone THEN 5 ELSE 4 END AS rank, CASE WHEN gone THEN 'term-removed' ELSE 'term' END AS kind, CAST(a AS BIGINT) AS a, CAST(a + length(v) AS BIGINT) AS b FROM word JOIN flag ON flag.doc_id = word.doc_id AND flag.term = lower(v)
WHERE i % 2 = 1 AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = word.doc_id AND base.a < word.a + length(word.v) AND word.a < base.b)),
spans AS (SELECT doc_id, rank, kind, a, b FROM base UNION ALL SELECT doc_id, rank, kind, a, b FROM term),
told AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_email, count(*) FILTER (WHERE rank = 1) AS n_ip, count(*) FILTER (WHERE rank = 2) AS n_card, count(*) FILTER (WHERE rank = 3) AS n_phone, count(*) FILTER (WHERE rank > 3) AS n_term,
string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY rank, a) FILTER (WHERE rank < 4) AS base, string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY rank, a) AS spans FROM spans GROUP BY 1)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_term, 0) AS n_term FROM d LEFT JOIN told ON told.doc_id = d.doc_id"""


def _licenses_sql() -> str:
    from .license_texts import NOTICES, TEXTS

    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    sides = [("line", name, t) for name, t in sorted(NOTICES.items())] + [("text", name, t) for name, t in TEXTS]
    values = ", ".join(f"({k}, '{kind}', '{name}', {quoted(t)})" for k, (kind, name, t) in enumerate(sides))
    words = lambda t: f"list_filter(string_split(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w != '')"
    return f"""WITH d AS (SELECT doc_id, concat(doc_id // 1000, '/', doc_id // 100) AS dir, doc_id % 10 = 0 AS named, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, {words("line")} AS w FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS i FROM d)),
tok AS (SELECT doc_id, i, unnest(w) AS word FROM l),
t AS (SELECT * FROM (VALUES {values}) AS t(k, kind, license, text)),
tw AS (SELECT k, word, count(*) AS m FROM (SELECT k, unnest({words("text")}) AS word FROM t) GROUP BY 1, 2),
n AS (SELECT count(*) AS files FROM d),
idf AS (SELECT a.word, ln((2 + files) / (1 + coalesce(df, 0))) AS idf FROM (SELECT DISTINCT word FROM tw) a LEFT JOIN (SELECT word, count(DISTINCT doc_id) AS df FROM tok GROUP BY 1) b ON a.word = b.word, n),
tv AS (SELECT k, tw.word, m * idf AS x FROM tw JOIN idf ON idf.word = tw.word),
tn AS (SELECT t.k, kind, license, sqrt((SELECT sum(x * x) FROM tv WHERE tv.k = t.k)) AS size, (SELECT sum(m) FROM tw WHERE tw.k = t.k) AS words FROM t),
cum AS (SELECT doc_id, i, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY i) - len(w) AS before, count(*) OVER (PARTITION BY doc_id) AS n_lines FROM l),
maybe AS (SELECT doc_id, tv.k FROM (SELECT DISTINCT doc_id, word FROM tok) a JOIN tv ON tv.word = a.word JOIN tn ON tn.k = tv.k GROUP BY doc_id, tv.k, size HAVING sum(x * x) >= 0.49 * size * size * 0.999),
starts AS (SELECT DISTINCT tok.doc_id, tok.i, maybe.k FROM tok JOIN maybe ON maybe.doc_id = tok.doc_id JOIN tv ON tv.k = maybe.k AND tv.word = tok.word),
u AS (SELECT s.doc_id, s.i, s.k, s.i + 1 AS j FROM starts s JOIN tn ON tn.k = s.k AND kind = 'line'
UNION ALL SELECT s.doc_id, s.i, s.k, coalesce(min(e.i), any_value(c.n_lines)) FROM starts s JOIN tn ON tn.k = s.k AND kind = 'text' JOIN cum c ON c.doc_id = s.doc_id AND c.i = s.i LEFT JOIN cum e ON e.doc_id = s.doc_id AND e.before >= c.before + words GROUP BY s.doc_id, s.i, s.k),
uw AS (SELECT u.doc_id, u.i, u.k, u.j, word, count(*) AS c FROM u JOIN tok ON tok.doc_id = u.doc_id AND tok.i >= u.i AND tok.i < u.j GROUP BY 1, 2, 3, 4, 5),
scored AS (SELECT uw.doc_id, uw.i, uw.j, uw.k, round(sum(c * coalesce(idf, 0) * coalesce(x, 0)) / (sqrt(sum((c * coalesce(idf, ln(2 + files))) ** 2)) * any_value(size)), 9) AS score, any_value(license) AS license, any_value(kind) AS kind
FROM uw JOIN tn ON tn.k = uw.k LEFT JOIN idf ON idf.word = uw.word LEFT JOIN tv ON tv.k = uw.k AND tv.word = uw.word, n GROUP BY 1, 2, 3, 4),
hit AS (SELECT * FROM scored WHERE score >= 0.7), found AS (SELECT doc_id, i, j, license, score FROM hit WHERE kind = 'line' QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY score DESC, license) = 1
UNION ALL SELECT doc_id, i, j, license, score FROM hit WHERE kind = 'text' QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY score DESC, i) = 1),
best AS (SELECT doc_id, count(*) AS n_notices, arg_min(license, {{'s': -score, 'l': license}}) AS license, max(score) AS similarity FROM found GROUP BY 1),
bare AS (SELECT DISTINCT doc_id FROM l WHERE len(w) > 0 AND NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = l.doc_id AND l.i >= f.i AND l.i < f.j)),
file AS (SELECT d.doc_id, dir, named, license, similarity, coalesce(n_notices, 0) AS n_notices, license IS NOT NULL AND (named OR d.doc_id NOT IN (SELECT doc_id FROM bare)) AS gives FROM d LEFT JOIN best ON best.doc_id = d.doc_id),
lic AS (SELECT dir AS above, arg_min(license, {{'s': -similarity, 'l': license}}) AS dir_license, max(similarity) AS dir_similarity FROM file WHERE gives GROUP BY 1)
SELECT doc_id, concat(dir, '/', CASE WHEN named THEN 'COPYING' ELSE 'text' END, '.', doc_id) AS path, coalesce(license, dir_license) AS license, coalesce(similarity, dir_similarity) AS similarity, CAST(n_notices AS INTEGER) AS n_notices,
CASE WHEN license IS NOT NULL THEN 'own' WHEN dir_license IS NOT NULL THEN 'inherited' END AS origin, CASE WHEN license IS NOT NULL THEN dir ELSE above END AS license_dir FROM file LEFT JOIN lic ON above = dir"""


ORACLES["op3_licenses"] = _licenses_sql()


def _placed_words(table: str, key: str) -> str:
    """(key, word, j, a, b): the words of each text with their places in code points, for DuckDB."""
    marked = "string_split(regexp_replace(text, '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+', concat(chr(1), '\\0', chr(1)), 'g'), chr(1))"
    pieces = f"SELECT {key}, unnest({marked}) AS v, unnest(range(0, len({marked}))) AS i FROM (SELECT {key}, translate(coalesce(text, ''), chr(1), chr(2)) AS text FROM {table})"
    placed = f"SELECT {key}, i, v, sum(length(v)) OVER (PARTITION BY {key} ORDER BY i) AS b FROM ({pieces})"
    return f"SELECT {key}, lower(v) AS word, i // 2 AS j, CAST(b - length(v) AS INTEGER) AS a, CAST(b AS INTEGER) AS b FROM ({placed}) WHERE i % 2 = 1"


def _shingled(words: str, key: str) -> str:
    """(key, j, shingle, n): five words in a row, or all of a text of fewer."""
    lists = f"SELECT {key}, list(word ORDER BY j) AS w FROM {words} GROUP BY 1"
    return f"SELECT {key}, j, array_to_string(w[j + 1:j + 5], ' ') AS shingle, len(w) AS n FROM (SELECT {key}, w, unnest(range(0, greatest(len(w) - 4, 1))) AS j FROM ({lists}))"


ORACLES["op1_decontamination"] = f"""WITH dw AS ({_placed_words("documents", "doc_id")}), iw AS ({_placed_words("benchmark", "item_id")}),
ds AS ({_shingled("dw", "doc_id")}), si AS ({_shingled("iw", "item_id")}),
bag AS (SELECT item_id, shingle, count(*) AS m, any_value(n) AS n FROM si GROUP BY 1, 2),
weigh AS (SELECT shingle, 1 / (1 + ln(count(*))) AS w FROM bag GROUP BY 1),
item AS (SELECT item_id, sum(w * m) AS total, any_value(n) AS n FROM bag JOIN weigh USING (shingle) GROUP BY 1),
doc AS (SELECT doc_id, count(*) AS n_shingles, any_value(n) AS n FROM ds GROUP BY 1),
hit AS (SELECT ds.doc_id, bag.item_id, ds.j, least(greatest(bag.n - 4, 1), n_shingles) AS span, n_shingles FROM ds JOIN bag ON bag.shingle = ds.shingle JOIN doc ON doc.doc_id = ds.doc_id),
win AS (SELECT DISTINCT doc_id, item_id, span, p FROM (SELECT doc_id, item_id, span, unnest(range(greatest(j - span + 1, 0), least(j, n_shingles - span) + 1)) AS p FROM hit)),
own AS (SELECT win.doc_id, item_id, p, shingle, count(*) AS c FROM win JOIN ds ON ds.doc_id = win.doc_id AND ds.j >= p AND ds.j < p + span GROUP BY 1, 2, 3, 4),
sums AS (SELECT own.doc_id, own.item_id, p, sum(coalesce(w, 1) * c) AS here, sum(coalesce(w, 0) * least(c, coalesce(m, 0))) AS common FROM own LEFT JOIN weigh ON weigh.shingle = own.shingle LEFT JOIN bag ON bag.item_id = own.item_id AND bag.shingle = own.shingle GROUP BY 1, 2, 3),
scored AS (SELECT doc_id, item_id, p, round(common / (here + total - common), 9) AS similarity, item.n AS size FROM sums JOIN item USING (item_id)),
best AS (SELECT * FROM scored WHERE similarity >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, p) = 1)
SELECT best.doc_id, best.item_id, similarity, f.a AS start, l.b AS "end" FROM best JOIN doc ON doc.doc_id = best.doc_id JOIN dw f ON f.doc_id = best.doc_id AND f.j = p JOIN dw l ON l.doc_id = best.doc_id AND l.j = least(p + size, doc.n) - 1"""


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(read_table(spark, sf_dir, "documents"), least=100, longest=5, percent=100, top=2000)


@query
def op12_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .harmonic import pack_harmonic

    return pack_harmonic(read_table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"), size=1024, end_id=0)


@query
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .elkan import cluster_vectors

    return cluster_vectors(read_table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64)


def _collocations_sql(least: int = 100, longest: int = 5, top: int = 2000) -> str:
    grams = " UNION ALL ".join(f"SELECT lang, {m} AS m, unnest(list_transform(range(1, len(w) - {m} + 2), lambda i: array_to_string(w[i:i + {m - 1}], ' '))) AS phrase FROM w WHERE len(w) >= {m}" for m in range(1, longest + 1))
    inner = " UNION ALL ".join(f"SELECT lang, a, array_to_string(p[i:i + {s - 1}], ' ') AS phrase FROM (SELECT *, unnest(range(1, m - {s} + 2)) AS i FROM cand WHERE m > {s})" for s in range(2, longest))
    return f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY 1),
f AS (SELECT lang, m, phrase, count(*) AS a FROM ({grams}) GROUP BY 1, 2, 3 HAVING count(*) >= {least}),
cand AS (SELECT *, string_split(phrase, ' ') AS p FROM f WHERE m > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, CAST((1000 * CAST(c.a AS HUGEINT) * CAST(n AS HUGEINT)) // (CAST(x.a AS HUGEINT) * CAST(y.a AS HUGEINT)) AS BIGINT) AS score, CAST(n AS BIGINT) AS n
FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) c JOIN n ON n.lang = c.lang JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(p[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(p[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, phrase, max(a) AS longer FROM ({inner}) GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.phrase = best.phrase WHERE longer IS NULL OR 100 * longer < 100 * best.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept QUALIFY rank <= {top}"""


ORACLES["op11_collocations"] = _collocations_sql()


def _centroids_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS MATERIALIZED (SELECT vec_id, v, j, list_sum(list_transform(range(1, {dims + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS d FROM e, c{r}),
a{r} AS MATERIALIZED (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, j) = 1)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, unnest(range(1, {dims + 1})) AS i FROM a{r}) GROUP BY 1, 2),
m{r} AS (SELECT j, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY 1),
c{r + 1} AS MATERIALIZED (SELECT c{r}.j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON m{r}.j = c{r}.j)""")
    return f"""WITH e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = {dims} AND len(embedding) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('2:', vec_id))) - 1 AS j, v AS c FROM e QUALIFY j < {k}),
{", ".join(steps)}
SELECT vec_id, CAST(a{rounds}.j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.j = a{rounds}.j"""


ORACLES["op13_centroids"] = _centroids_sql()
