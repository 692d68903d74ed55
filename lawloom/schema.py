"""Tables of a corpus, and the fixed relations between kinds of provisions."""

from __future__ import annotations

TEMPORAL = "struct<valid_from:string,valid_to:string,promulgated:string,repealed:string>"
SOURCE = "struct<uri:string,sha256:string,adapter:string,source_key:string,page:int,byte_start:bigint,byte_end:bigint>"
PAIRS = "array<struct<k:string,v:string>>"

#: What a source yields; ``file`` names the source, ``pos`` is the input order within it.
RAW_NODE = (
    "file string, pos long, jurisdiction string, authority string, law_number_key string, source_law_key string, locator string, kind string, depth int, "
    f"text string, temporal {TEMPORAL}, source {SOURCE}, parent_id string, ordinal int, branch array<int>, label string, heading string, attributes {PAIRS}"
)
NODE = RAW_NODE + ", law_id string, node_id string, version_id string"
CROSSWALK = "file string, pos long, legacy_id string, target_node_id string, target_version_id string, relation string, reason string, source_sha256 string"
DIAGNOSTIC = "file string, code string, subject string, detail string"

#: Which kinds may stand below which.
CHILDREN = {
    "law": ("preamble", "main_provision", "part", "chapter", "section", "subsection", "division", "article", "appendix", "supplementary_provision", "table"),
    "preamble": ("paragraph",),
    "main_provision": ("part", "chapter", "section", "subsection", "division", "article", "paragraph", "appendix", "table"),
    "part": ("chapter", "section", "subsection", "division", "article"),
    "chapter": ("section", "subsection", "division", "article"),
    "section": ("subsection", "division", "article"),
    "subsection": ("division", "article"),
    "division": ("article",),
    "article": ("paragraph", "item", "table"),
    "paragraph": ("item", "table", "amendment_provision"),
    "item": ("subitem", "table"),
    "subitem": ("subitem", "table"),
    "appendix": ("table", "row", "cell"),
    "supplementary_provision": ("chapter", "article", "paragraph", "item", "subitem", "appendix", "table"),
    "amendment_provision": (),
    "table": ("row",),
    "row": ("cell",),
    "cell": (),
}
KINDS = tuple(CHILDREN)
RELATIONS = ("exact", "derived", "ambiguous")

#: The layer of each diagnostic.
LAYERS = {
    "syntax": ("STRING_TYPE", "NUL_FORBIDDEN", "ORDINAL_POSITIVE", "BRANCH_POSITIVE", "CROSSWALK_FIELDS"),
    "structure": (
        "CORPUS_EMPTY", "IDENTITY_NORMALIZED", "ID_LAW", "ID_NODE", "ID_VERSION", "DUPLICATE_VERSION", "LOCATOR_DUPLICATE", "LOCATOR_GRAMMAR", "ROOT_KIND",
        "ROOT_DEPTH", "PARENT_DEPTH", "PARENT_MISSING", "PARENT_LAW", "KIND_TRANSITION", "LAW_ROOT_COUNT", "TREE_CYCLE", "TREE_UNREACHABLE",
        "CROSSWALK_DUPLICATE_TARGET", "CROSSWALK_TARGET",
    ),
    "source_fidelity": ("SOURCE_SHA256", "SOURCE_RANGE", "SOURCE_PAGE", "SOURCE_URI", "CROSSWALK_SOURCE_MISMATCH", "MALFORMED_SHA"),
    "semantic_temporal": ("TEMPORAL_OVERLAP", "SEMANTIC_IDENTITY_DRIFT", "PARENT_TEMPORAL", "CROSSWALK_AMBIGUOUS_REASON", "CROSSWALK_EXACT_REASON", "CROSSWALK_REPEATED_POLICY"),
}
LAYER_OF = {code: layer for layer, codes in LAYERS.items() for code in codes}
