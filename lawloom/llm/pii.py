"""Personal data: patterns, and terms of the text that give protected values away.

Values found by pattern are the protected entities. A term goes together with an entity
where it stands within ``context`` characters of it. It discloses the entity by their
pointwise mutual information over the corpus,

    PMI(t; e) = log(n_te * N / (n_t * n_e)),   IC(e) = log(N / n_e)

in document counts: n_te documents have the term beside the entity, n_t have it anywhere.
A term whose PMI reaches ``disclosure`` of the entity's information content IC(e) is masked
wherever it stands in documents that hold the entity: it is generalised to what its form
says (a name, an acronym, a word), or removed where it discloses all (PMI = IC).
Everything is DataFrame expressions; counts by term and by (entity, term) are summed before
they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of

_MARK = chr(1)
#: The patterns by kind, in the order of the output. The lookbehind and
#: possessive quantifiers spare restarts within a run; they match the same.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
_DIGITS = "regexp_replace(v, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": "forall(split(v, '[.]'), x -> length(trim(LEADING '0' FROM x)) <= 3 AND coalesce(try_cast(right(x, 9) AS int), 999) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND aggregate(transform(split(reverse({_DIGITS}), ''), (c, i) -> coalesce(try_cast(c AS int), 0) * IF(i % 2 = 1, 2, 1)), 0, (a, x) -> a + IF(x > 9, x - 9, x)) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}
_NONE = "CAST(array() AS array<struct<kind:string,start:int,end:int,value:string>>)"


def _finds(kind: str, pieces: str, sizes: str, sums: str, valid: str) -> Column:
    """Spans of the odd pieces. A place is the sum of sizes before it, by blocks of 256 pieces."""
    start = f"element_at({sums}, shiftright(i, 8) + 1) + aggregate(slice({sizes}, shiftright(i, 8) * 256 + 1, i % 256), 0, (a, x) -> a + x)"
    each = f"transform(filter(sequence(1, size({pieces}) - 1, 2), i -> exists(array({pieces}[i]), v -> {valid})), i -> struct('{kind}' AS kind, {start} AS start, {start} + {sizes}[i] AS end, {pieces}[i] AS value))"
    return F.expr(f"IF(size({pieces}) > 1, {each}, {_NONE})")


def _with_pieces(df: DataFrame, name: str, marked: Column) -> DataFrame:
    sums = f"IF(size({name}) > 1, transform(sequence(0, shiftright(size({name}) - 1, 8)), b -> aggregate(slice({name}_n, 1, b * 256), 0, (a, x) -> a + x)), CAST(array() AS array<int>))"
    df = df.withColumn(name, F.split(marked, _MARK))
    df = df.withColumn(f"{name}_n", F.expr(f"IF(size({name}) > 1, transform({name}, x -> length(x)), CAST(array() AS array<int>))"))
    return df.withColumn(f"{name}_s", F.expr(sums))


def find_base(documents: DataFrame, text: str = "text", to: str = "__finds") -> DataFrame:
    """``documents`` with the column ``to``: array of (kind, start, end, value), by kind, then start."""
    columns = documents.columns
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), _MARK, chr(2))
    df = documents.withColumn("__clean", clean)
    for kind in KINDS:
        marked = F.regexp_replace("__clean", PATTERNS[kind], f"{_MARK}$0{_MARK}")
        needs = {"email": "@", "phone": "+"}.get(kind)
        df = _with_pieces(df, f"__{kind}", F.when(F.col("__clean").contains(needs), marked).otherwise("") if needs else marked)
    found = F.concat(*(_finds(kind, f"__{kind}", f"__{kind}_n", f"__{kind}_s", _VALID[kind]) for kind in KINDS))
    return df.withColumn(to, found).select(*[c for c in columns if c != to], to)


def _terms(text: Column, least: int) -> Column:
    """Distinct words of ``least`` letters or more, lower-cased."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), lambda w: F.length(w) >= least)


def _beside(context: int, least: int) -> Column:
    """(entity, terms) of each find; words that the edge of the context cuts are left."""
    before = f"substring(text, greatest(f.start - {context}, 0) + 1, least(f.start, {context}))"
    before = f"IF(f.start > {context} AND substring(text, f.start - {context}, 1) rlike '\\\\p{{L}}', regexp_replace({before}, '^\\\\p{{L}}+', ''), {before})"
    after = f"substring(text, f.end + 1, {context})"
    after = f"IF(substring(text, f.end + {context} + 1, 1) rlike '\\\\p{{L}}', regexp_replace({after}, '\\\\p{{L}}+\\\\z', ''), {after})"
    words = f"filter(array_distinct(split(lower(concat({before}, ' ', {after})), '[^\\\\p{{L}}]+')), w -> length(w) >= {least})"
    return F.expr(f"transform(finds, f -> struct(lower(f.value) AS entity, {words} AS terms))")


#: A term in more than one of this many documents has its count broadcast: there are at most as many
#: of them as documents have distinct terms on average, times this.
_COMMON = 1000


def _ties(carriers: DataFrame, documents: DataFrame, disclosure: float, support: int, letters: int, context: int, total: int) -> DataFrame:
    """(text_key, copies, entity, n_e, term, n_t) of each text's entities and the terms beside them that may disclose them.

    As n_te <= n_e, PMI reaches the share of IC only where n_t <= n_e (N / n_e)^(1 - share);
    other terms are left before they are counted.
    """
    by_text = carriers.groupBy("text_key").agg(F.count("*").alias("copies"), F.first("text").alias("text"), F.first("finds").alias("finds"))
    beside = materialise(by_text.select("text_key", "copies", F.explode(_beside(context, letters)).alias("b")).select("text_key", "copies", "b.entity", F.col("b.terms").alias("terms")))
    held = beside.select("text_key", "copies", "entity").distinct()
    # written, so that the join can split the texts of a very common entity
    entities = materialise(held.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count("*").alias("texts")).where(F.col("texts") >= support).select("entity", "n_e"))
    terms = beside.join(entities, "entity").select("text_key", "copies", "entity", "n_e", F.explode("terms").alias("term")).distinct().withColumn("term_hash", F.xxhash64("term"))
    words = documents.select(F.explode(_terms(F.col("text"), letters)).alias("term")).select(F.xxhash64("term").alias("term_hash")).groupBy("term_hash").agg(F.count("*").alias("n_t"))
    common = F.broadcast(words.where(F.col("n_t") > total / _COMMON))
    met = terms.join(common, "term_hash", "left_anti").join(words, "term_hash").unionByName(terms.join(common, "term_hash"))
    within = F.col("n_t") <= F.pow(F.col("n_e"), F.lit(disclosure)) * float(total) ** (1 - disclosure) * (1 + 1e-9)
    return met.where(within).select("text_key", "copies", "entity", "n_e", "term", "n_t")


def _disclosing(ties: DataFrame, disclosure: float, support: int, total: int) -> DataFrame:
    pairs = ties.groupBy("entity", "term").agg(F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"), F.sum("copies").alias("n_te"), F.count("*").alias("texts")).where(F.col("texts") >= support)
    pmi = F.log(F.col("n_te") * F.lit(float(total)) / (F.col("n_t") * F.col("n_e")))
    content = F.log(F.lit(float(total)) / F.col("n_e"))
    share = F.when(content > 0, pmi / content).otherwise(F.lit(0.0))
    return pairs.withColumn("share", share).where(F.col("share") >= disclosure).select("entity", "term", "share")


def disclosing_terms(documents: DataFrame, *, disclosure: float = 0.8, support: int = 1, letters: int = 1, context: int = 80) -> DataFrame:
    """(entity, term, share) of terms of ``documents`` (text) that disclose an entity; share is PMI / IC.

    ``support`` is the different texts that an entity and a pair need, ``letters`` the least
    of a term: with 1 and 1 no entity and no term is left out.
    """
    rows = _found(documents.select(text_of().alias("text")))
    total = documents.count()
    ties = _ties(rows.where("text IS NOT NULL"), documents.select(text_of().alias("text")), disclosure, support, letters, context, total)
    return _disclosing(ties, disclosure, support, total)


def _found(documents: DataFrame, *keep: str) -> DataFrame:
    """A written table of ``row`` (a struct of the columns to keep, whatever their names), finds, and, where there are any, text and text_key."""
    row = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(None).cast("string")
    found = find_base(documents.select(row.alias("row"), text_of().alias("text")), to="finds")
    some = F.size("finds") > 0
    return materialise(found.select("row", "finds", F.when(some, F.col("text")).alias("text"), F.when(some, F.md5("text")).alias("text_key")))


def find_all(documents: DataFrame, *keep: str, disclosure: float = 0.8, support: int = 1, letters: int = 1, context: int = 80) -> DataFrame:
    """row (a struct of the columns ``keep``), text, finds (base spans) and terms (spans of terms) of each document; text is null where there are no spans."""
    rows = _found(documents, *keep)
    carriers = rows.where("text IS NOT NULL")
    total = rows.count()
    ties = materialise(_ties(carriers, documents.select(text_of().alias("text")), disclosure, support, letters, context, total))
    # a text meets only the terms of its own entities
    flagged = ties.join(_disclosing(ties, disclosure, support, total), ["entity", "term"]).groupBy("text_key").agg(F.collect_set(F.struct("term", (F.col("share") >= 1 - 1e-9).alias("all"))).alias("found"))
    texts = carriers.select("text_key", "text", "finds").dropDuplicates(["text_key"]).join(flagged, "text_key")
    # a term in one pair may go and in another be generalised: it goes
    texts = texts.withColumn("plain", F.transform("found", lambda t: t["term"])).withColumn("gone", F.transform(F.filter("found", lambda t: t["all"]), lambda t: t["term"]))
    marked = F.regexp_replace(F.translate("text", _MARK, chr(2)), rf"\p{{L}}{{{letters},}}", f"{_MARK}$0{_MARK}")
    texts = _with_pieces(texts, "w", marked)
    spans = texts.withColumn("terms", _finds("term", "w", "w_n", "w_s", "array_contains(plain, lower(v))"))
    # the words of a protected value go with it
    spans = spans.withColumn("terms", F.expr("filter(terms, f -> NOT exists(finds, b -> b.start < f.end AND f.start < b.end))"))
    spans = spans.withColumn("terms", F.expr("transform(terms, f -> struct(IF(array_contains(gone, lower(f.value)), 'term-removed', 'term') AS kind, f.start AS start, f.end AS end, f.value AS value))"))
    spans = materialise(spans.select("text_key", F.expr("concat(filter(terms, f -> f.kind = 'term'), filter(terms, f -> f.kind != 'term'))").alias("terms")))
    none = F.expr(_NONE)
    with_terms = carriers.join(spans, "text_key", "left").select("row", "text", "finds", F.coalesce("terms", none).alias("terms"))
    return rows.where("text IS NULL").select("row", "text", "finds", none.alias("terms")).unionByName(with_terms)


def _joined(finds: str) -> Column:
    return F.expr(f"array_join(transform({finds}, f -> concat(f.kind, ':', f.start, ':', f.end)), ',')")


def personal_data(documents: DataFrame, **how) -> DataFrame:
    """Spans of ``documents`` (doc_id, text), one row a row.

    Null text: empty. Texts are read whole, however long. Repeated rows give repeated rows.
    Columns of other names are not read. An empty table gives no row. Spans: the base ones by
    kind and start, then terms that are generalised, then those removed, by start; code points.
    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term.
    """
    rows = find_all(documents, "doc_id", **how)
    counts = [F.expr(f"CAST(size(filter(finds, f -> f.kind = '{kind}')) AS long)").alias(f"n_{kind}") for kind in KINDS]
    return rows.select("row.doc_id", *counts, F.sha2(_joined("finds"), 256).alias("base_sha256"), _joined("concat(finds, terms)").alias("spans"), F.size("terms").cast("long").alias("n_term"))


def sanitise(documents: DataFrame, **how) -> DataFrame:
    """``documents`` with personal data masked in the text, all columns kept, whatever their names.

    A base span becomes its kind in brackets; a disclosing term becomes [name], [acronym] or
    [word] by its form, and one that discloses all goes. Overlapping spans are masked as one,
    by the first's kind. Texts without spans stay as they are, null included; no row goes.
    """
    rows = find_all(documents, *documents.columns, **how)
    masked = F.expr("""
        aggregate(array_sort(transform(concat(finds, terms), f -> struct(f.start AS start, f.end AS end, CASE f.kind
                      WHEN 'term-removed' THEN '' WHEN 'term' THEN CASE
                          WHEN length(f.value) > 1 AND f.value = upper(f.value) AND f.value != lower(f.value) THEN '[acronym]'
                          WHEN left(f.value, 1) != lower(left(f.value, 1)) THEN '[name]' ELSE '[word]' END
                      ELSE concat('[', f.kind, ']') END AS mask))), struct(0 AS at, '' AS kept),
                  (a, s) -> IF(s.start >= a.at,
                               struct(s.end AS at, concat(a.kept, substring(text, a.at + 1, s.start - a.at), s.mask) AS kept),
                               struct(greatest(a.at, s.end) AS at, a.kept AS kept)),
                  a -> concat(a.kept, substring(text, a.at + 1)))""")
    columns = [F.col(f"row.`{c}`").alias(c) if c.lower() != "text" else F.when(F.col("text").isNull(), F.col(f"row.`{c}`")).otherwise(masked).alias(c) for c in documents.columns]
    return rows.select(*columns)
