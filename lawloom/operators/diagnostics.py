"""The diagnostics of a corpus as DataFrame plans.

Checks of one row are one projection. Checks across rows are joins, aggregates and
windows, each over all corpora at once: ``file`` is part of every key, so corpora never
see each other. A parent and its children meet once, and all conditions on them are
tested in that join. Rows move as little as can be: what only several rows of a key can
break is looked for where a hash of the key stands twice, joins move keys of 16 bytes in
place of ids, and ids are looked up again for the rows that failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import hex_digest
from ..functions.identity import blank, node_id, valid_locator, version_id, with_law_id
from ..schema import CHILDREN, LAYER_OF, RELATIONS

_COLUMNS = ("file", "code", "subject", "detail")


def _rows(df: DataFrame, code: str | Column, subject: str = "node_id", detail: Column | None = None) -> DataFrame:
    return df.select("file", (F.lit(code) if isinstance(code, str) else code).alias("code"), F.col(subject).alias("subject"), (F.lit("") if detail is None else detail).alias("detail"))


def _key(of: str, *more: str) -> Column:
    """16 bytes of SHA-256 that stand for a corpus, an id and other numbers, nulls included: a third of what the id takes in a shuffle."""
    numbers = F.concat_ws(":", *(F.coalesce(n.cast("string"), F.lit("-")) for n in (F.length("file"), *map(F.col, more))))
    tagged = F.concat(numbers, F.lit(":"), F.coalesce("file", F.lit("")), F.when(F.col(of).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(of))))
    return F.unhex(F.substring(F.sha2(tagged, 256), 1, 32))


def _single_and_several(rows: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose keys stand once, and the rest. Only hashes of eight bytes are counted: rows that share one by chance are among the rest."""
    from ..tables import materialise

    hashed = rows.withColumn("__hash", F.xxhash64(*keys))
    many = materialise(hashed.groupBy("__hash").agg(F.count("*").alias("n")).where("n > 1").select("__hash"))
    return hashed.join(many, "__hash", "left_anti").drop("__hash"), hashed.join(many, "__hash", "left_semi").drop("__hash")


def _positive(value: Column) -> Column:
    return value.isNull() | (value > 0)


def row_checks(nodes: DataFrame) -> DataFrame:
    """Checks that need one node only. ``nodes`` has own_law: the recomputed law_id, null where identity fails."""
    s = lambda k: F.col(f"source.{k}")
    recomputed = nodes.withColumn("__node", node_id(F.col("law_id"), F.col("locator"))).withColumn("__version", version_id())
    missing = F.lit(False)
    for c in (F.col("jurisdiction"), F.col("authority"), F.col("locator"), F.col("text"), s("uri"), s("adapter")):
        missing = missing | c.isNull()
    strings = F.array(*(F.coalesce(c, F.lit("")) for c in (F.col("jurisdiction"), F.col("authority"), F.col("locator"), F.col("text"), s("uri"), s("adapter"), s("source_key"), F.col("label"), F.col("heading"))))
    begins, ends = s("byte_start"), s("byte_end")
    root = F.col("parent_id").isNull()
    checks = {
        "ID_LAW": ~F.col("law_id").eqNullSafe(F.col("own_law")),
        "ID_NODE": ~F.col("node_id").eqNullSafe(F.col("__node")),
        "ID_VERSION": ~F.col("version_id").eqNullSafe(F.col("__version")),
        "LOCATOR_GRAMMAR": ~valid_locator(F.col("locator")),
        "ORDINAL_POSITIVE": ~_positive(F.col("ordinal")),
        "BRANCH_POSITIVE": F.exists("branch", lambda b: b.isNull() | (b <= 0)),
        "SOURCE_SHA256": ~hex_digest(s("sha256")),
        "SOURCE_RANGE": (begins.isNull() != ends.isNull()) | F.coalesce((begins < 0) | (begins > ends), F.lit(False)),
        "SOURCE_PAGE": ~_positive(s("page")),
        "STRING_TYPE": missing,
        "NUL_FORBIDDEN": ~missing & F.exists(strings, lambda t: F.contains(t, F.lit("\0"))),
        "ROOT_KIND": root & (F.col("kind") != "law"),
        "ROOT_DEPTH": root & (F.col("depth") != 0),
        "PARENT_DEPTH": ~root & (F.col("depth") <= 0),
        "SOURCE_URI": (F.length(F.coalesce(s("uri"), F.lit(""))) == 0) | (F.length(F.coalesce(s("adapter"), F.lit(""))) == 0),
    }
    codes = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), code) for code, c in checks.items())))
    found = recomputed.where("own_law IS NOT NULL").select("file", "node_id", "locator", F.explode(codes).alias("code"))
    detail = F.when(F.col("code") == "LOCATOR_GRAMMAR", F.col("locator")).otherwise("")
    failed = nodes.where("own_law IS NULL")
    empty_place = F.coalesce(blank(F.col("jurisdiction")), F.lit(True)) | F.coalesce(blank(F.col("authority")), F.lit(True))
    reason = F.when(empty_place, "jurisdiction and authority must be nonempty after normalization").when(F.col("law_number_key").isNotNull(), "law_number_key is supplied but empty after normalization").otherwise("source_law_key is required and nonempty after normalization")
    return found.select("file", "code", F.col("node_id").alias("subject"), detail.alias("detail")).unionByName(_rows(failed, "IDENTITY_NORMALIZED", detail=reason))


def duplicate_versions(nodes: DataFrame) -> DataFrame:
    _, nodes = _single_and_several(nodes.select("file", "version_id"), "file", "version_id")
    return _rows(nodes.groupBy("file", "version_id").agg(F.count("*").alias("n")).where("n > 1"), "DUPLICATE_VERSION", "version_id")


def duplicate_locators(nodes: DataFrame) -> DataFrame:
    """Nodes that are not the first at their law's locator; the first is found by aggregation, not by a window."""
    _, nodes = _single_and_several(nodes, "file", "law_id", "locator")
    first = nodes.groupBy("file", "law_id", "locator").agg(F.min_by("node_id", "pos").alias("first"), F.count_distinct("node_id").alias("n")).where("n > 1")
    return _rows(nodes.join(first, ["file", "law_id", "locator"]).where("node_id != first"), "LOCATOR_DUPLICATE", detail=F.col("locator"))


def version_order(nodes: DataFrame) -> Window:
    start = F.col("temporal.valid_from")
    return Window.partitionBy("file", "node_id").orderBy(start.isNotNull(), F.coalesce(start, F.lit("")), "pos")


def temporal_overlaps(nodes: DataFrame) -> DataFrame:
    """Versions of a node, in order of their start, of which one does not end before the next starts."""
    by = version_order(nodes)
    pairs = nodes.select("file", "node_id", "pos", "temporal", F.lead("pos").over(by).alias("next_pos"), F.lead("temporal.valid_from").over(by).alias("next_from")).where("next_pos IS NOT NULL")
    return _rows(pairs.where("temporal.valid_to IS NULL OR next_from IS NULL OR next_from < temporal.valid_to"), "TEMPORAL_OVERLAP")


def identity_drifts(nodes: DataFrame) -> DataFrame:
    kinds = nodes.groupBy("file", "node_id").agg(F.count_distinct(F.struct("parent_id", "kind", "ordinal", "branch")).alias("n"))
    return _rows(kinds.where("n != 1"), "SEMANTIC_IDENTITY_DRIFT")


def allowed(parent: Column, child: Column) -> Column:
    """Whether the kinds may stand one below the other: a constant relation of 18 kinds."""
    table = F.create_map(*(x for k, below in CHILDREN.items() for x in (F.lit(k), F.array(*map(F.lit, below)) if below else F.array().cast("array<string>"))))
    return F.coalesce(F.array_contains(table[parent], child), F.lit(False))


def contains(outer: str, inner: str) -> Column:
    """Whether one half-open validity lies in another; an open end of the outer admits all."""
    start = F.col(f"{outer}.valid_from").isNull() | F.coalesce(F.col(f"{outer}.valid_from") <= F.col(f"{inner}.valid_from"), F.lit(False))
    end = F.col(f"{outer}.valid_to").isNull() | F.coalesce(F.col(f"{inner}.valid_to") <= F.col(f"{outer}.valid_to"), F.lit(False))
    return start & end


def parent_checks(nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Children and all versions of their parents, in one join; any version may satisfy a condition."""
    return _children_checks(nodes, candidates).where(f"code != '{_GONE}'")


#: Beside the codes: no candidate has the parent's id.
_GONE = "gone"


def _children_checks(nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    from ..tables import materialise

    parents = candidates.select(_key("node_id").alias("above"), _key("law_id").alias("p_law"), F.col("depth").alias("p_depth"), F.col("kind").alias("p_kind"), F.col("temporal").alias("p_temporal"), F.lit(True).alias("there"))
    children = nodes.where("parent_id IS NOT NULL").select(_key("parent_id").alias("above"), _key("node_id", "pos").alias("child"), _key("law_id").alias("law"), "depth", "kind", "temporal")
    joined = children.join(parents, "above", "left")
    # the join's key is among the groups', so no row moves again
    some = joined.groupBy(*children.columns).agg(
        F.bool_or(F.col("there")).alias("there"),
        F.bool_or(F.col("p_kind").isNotNull()).alias("found"),
        F.bool_or(F.col("p_law") == F.col("law")).alias("same"),
        F.bool_or(F.col("p_depth") + 1 == F.col("depth")).alias("deep"),
        F.bool_or(allowed(F.col("p_kind"), F.col("kind"))).alias("kin"),
        F.bool_or(contains("p_temporal", "temporal")).alias("time"),
    )
    missing = ~F.col("found")
    failed = lambda c: ~missing & ~F.coalesce(F.col(c), F.lit(False))
    codes = F.array_compact(F.array(F.when(F.col("there").isNull(), _GONE), F.when(missing, "PARENT_MISSING"), F.when(failed("same"), "PARENT_LAW"), F.when(failed("deep"), "PARENT_DEPTH"), F.when(failed("kin"), "KIND_TRANSITION"), F.when(failed("time"), "PARENT_TEMPORAL")))
    told = materialise(some.select("child", F.explode(codes).alias("code")).distinct())
    return _rows(nodes.select("file", "pos", "node_id", _key("node_id", "pos").alias("child")).join(told, "child").distinct(), F.col("code"))


def root_counts(nodes: DataFrame) -> DataFrame:
    """Laws whose roots are not exactly one node."""
    roots = nodes.where("parent_id IS NULL AND own_law IS NOT NULL AND node_id IS NOT NULL").select("file", "law_id", "node_id").distinct().withColumn("one", F.lit(1))
    # laws and roots are each brought to one row where they lie, so that provisions do not move
    laws = nodes.select("file", "law_id").distinct().withColumn("one", F.lit(0))
    n = laws.unionByName(roots.drop("node_id")).groupBy("file", "law_id").agg(F.sum("one").alias("n"))
    return _rows(n.where("n != 1"), "LAW_ROOT_COUNT", "law_id")


def ancestry(nodes: DataFrame, candidates: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Nodes whose chain of parents ends in a cycle or short of a root.

    A node steps to the first version of its parent. Each round doubles the length of all
    chains, so the rounds are as many as the logarithm of the depth, whatever its size: what
    is left when a round ends no chain is on or below a cycle. ``gone``: (file, subject) of the nodes
    whose parent no candidate is, where that is known.
    """
    from ..tables import materialise
    from .trees import follow

    single, several = _single_and_several(candidates.select("file", "node_id", "parent_id", "temporal", "pos"), "file", "node_id")
    several = several.withColumn("rank", F.row_number().over(version_order(several))).where("rank = 1").drop("rank")
    first = single.unionByName(several).select(_key("node_id").alias("at"), F.when(F.col("parent_id").isNotNull(), _key("parent_id")).alias("next"))
    # end: null while it climbs; 'root', 'gap' (a missing parent)
    known = first.select(F.col("at").alias("next"), F.lit(True).alias("there"), F.col("next").isNull().alias("top"))
    step = follow(first, known, ["next"]).select("at", F.when(F.col("there"), F.col("next")).alias("next"), F.when(F.col("next").isNull() | F.col("top"), "root").when(F.col("there").isNull(), "gap").alias("end"))
    step = materialise(step)
    done, open_ = step.where("end IS NOT NULL"), step.where("end IS NULL")
    ended = open_
    while not ended.isEmpty():
        # only what still climbs is joined and written again
        far = done.unionByName(open_).select(F.col("at").alias("next"), F.col("next").alias("far"), F.col("end").alias("far_end"))
        moved = materialise(follow(open_, far, ["next"]).select("at", F.col("far").alias("next"), F.col("far_end").alias("end")))
        ended, open_ = moved.where("end IS NOT NULL"), moved.where("end IS NULL")
        done = done.unionByName(ended)
    lost = materialise(done.unionByName(open_).withColumn("end", F.coalesce("end", F.lit("cycle"))).where("end != 'root'").select(F.col("at").alias("above"), "end"))
    # a node's own row starts the walk: it may differ from the first version of its node
    own = nodes.where("parent_id IS NOT NULL").select("file", "node_id", _key("parent_id").alias("above"))
    below = own.join(lost, "above")
    if gone is None:
        absent = materialise(own.select("above").distinct().join(known.select(F.col("next").alias("above")), "above", "left_anti"))
        gone = own.join(absent, "above").select("file", F.col("node_id").alias("subject"))
    unreachable = _rows(below, "TREE_UNREACHABLE").unionByName(_rows(gone, "TREE_UNREACHABLE", "subject"))
    return unreachable.unionByName(_rows(below.where("end = 'cycle'"), "TREE_CYCLE"))


def crosswalk_checks(crosswalk: DataFrame, nodes: DataFrame) -> DataFrame:
    subject = F.coalesce("legacy_id", F.lit("<malformed-legacy-id>"))
    rows = crosswalk.withColumn("legacy_id", subject)
    malformed = crosswalk["legacy_id"].isNull() | F.col("target_node_id").isNull() | F.col("target_version_id").isNull() | ~F.coalesce(F.col("relation").isin(*RELATIONS), F.lit(False))
    targets = nodes.groupBy("file", F.col("version_id").alias("target_version_id")).agg(F.max_by(F.struct("node_id", "source.sha256"), "pos").alias("target"))
    joined = crosswalk.withColumn("malformed", malformed).withColumn("legacy_id", subject).join(targets, ["file", "target_version_id"], "left")
    lost = F.col("target").isNull() | ~F.col("target.node_id").eqNullSafe(F.col("target_node_id"))
    no_reason = F.length(F.coalesce("reason", F.lit(""))) == 0
    codes = F.array_compact(
        F.array(
            F.when(F.col("malformed"), "CROSSWALK_FIELDS"),
            F.when(lost, "CROSSWALK_TARGET").when(~F.col("source_sha256").eqNullSafe(F.col("target.sha256")), "CROSSWALK_SOURCE_MISMATCH"),
            F.when((F.col("relation") == "ambiguous") & no_reason, "CROSSWALK_AMBIGUOUS_REASON"),
            F.when((F.col("relation") == "exact") & ~no_reason, "CROSSWALK_EXACT_REASON"),
            F.when(~hex_digest(F.col("source_sha256")), "MALFORMED_SHA"),
        )
    )
    single = joined.select("file", F.explode(codes).alias("code"), F.col("legacy_id").alias("subject"), F.lit("").alias("detail"))
    twice = rows.groupBy("file", "legacy_id", "target_version_id").agg(F.count("*").alias("n")).where("n > 1")
    sure = ~F.coalesce(F.col("relation") == "ambiguous", F.lit(False)) | no_reason
    policy = rows.groupBy("file", "legacy_id").agg(F.count("*").alias("n"), F.bool_or(sure).alias("sure"), F.count_distinct(F.coalesce("target_version_id", F.lit("None"))).alias("targets")).where("n > 1 AND (sure OR targets != n)")
    return single.unionByName(_rows(twice, "CROSSWALK_DUPLICATE_TARGET", "legacy_id")).unionByName(_rows(policy, "CROSSWALK_REPEATED_POLICY", "legacy_id"))


def diagnose(nodes: DataFrame, crosswalk: DataFrame | None = None, corpora: DataFrame | None = None) -> DataFrame:
    """All diagnostics (file, code, subject, detail), each once.

    ``nodes``: schema.NODE; ``crosswalk``: schema.CROSSWALK; ``corpora``: (file) of corpora
    that must not be empty.
    """
    from ..tables import materialise

    # nine plans read the nodes: what they are made from, and their recomputed law, is computed once
    nodes = materialise(with_law_id(nodes, "own_law"))
    fine = nodes.where("own_law IS NOT NULL")
    _, several = _single_and_several(fine, "file", "node_id")
    children = _children_checks(nodes, fine)
    gone = children.where(f"code = '{_GONE}'")
    found = [row_checks(nodes), duplicate_versions(fine), duplicate_locators(fine), temporal_overlaps(several), identity_drifts(several), children.where(f"code != '{_GONE}'"), root_counts(nodes), ancestry(nodes, fine, gone)]
    if crosswalk is not None:
        found.append(crosswalk_checks(crosswalk, nodes))
    if corpora is not None:
        found.append(corpora.join(nodes.select("file").distinct(), "file", "left_anti").select("file", F.lit("CORPUS_EMPTY").alias("code"), F.lit("corpus").alias("subject"), F.lit("").alias("detail")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(*_COLUMNS).distinct()


def with_layer(diagnostics: DataFrame) -> DataFrame:
    table = F.create_map(*(F.lit(x) for pair in LAYER_OF.items() for x in pair))
    return diagnostics.withColumn("layer", table[F.col("code")])
