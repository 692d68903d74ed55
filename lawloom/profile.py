"""Names that a corpus carries on the wire.

Identifiers do not depend on them, but for the source URIs that enter the build
fingerprint. A reader of corpora made under other names passes its own profile.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Profile:
    corpus_schema: str = "lawloom-corpus/v1"
    projection_schema: str = "lawloom-projection/v1"
    manifest_plain: str = "lawloom-manifest/v3"
    manifest_acquired: str = "lawloom-manifest/v5"
    manifest_rights: str = "lawloom-manifest/v6"
    content_uri_prefix: str = "lawloom:source:sha256:"
    acquisition_schema: str = "lawloom-acquisition/v1"
    admission_schema: str = "lawloom-admission/v1"
    name: str = "lawloom/0.1"
    converter: dict = field(default_factory=lambda: {"name": "lawloom", "version": "0.1", "profile": "lawloom/0.1"})
    bundle_schema: str = "lawloom-bundle/v1"
    bundle_schema_rights: str = "lawloom-bundle/v2"
    bundle_ledger: str = "lawloom-source-references/v1"
    bundle_extension: str = "lawloom"
    bundle_heading: str = "Lawloom legal knowledge bundle"
    bundle_corpus_title: str = "Canonical corpus"
    bundle_exporter: str = "lawloom-exporter/0.1"

    @classmethod
    def from_json(cls, path: str) -> Profile:
        with open(path, encoding="utf-8") as f:
            return cls(**json.load(f))


DEFAULT = Profile()

#: The namespace of identifiers, and names of the public law service.
ID_NAMESPACE = "9b7b7100-8305-5e41-b8d4-e541ce517491"
SOURCE_AUTHORITY = "e-Gov 法令API Version 2"
SOURCE_FORMAT = "e-Gov Law API v2 XML full-text response"
CANONICALIZATION = "json-sort-keys-utf8-compact-jsonl-final-lf"
INLINE_MAPPING_URI = "inline:canonical-json-v1"
