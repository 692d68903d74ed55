"""Identifiers of laws, provisions and their versions, and canonical locators."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..profile import ID_NAMESPACE
from .canonical import canonical_json, sha256, uuid5

_SPACE = uuid.UUID(ID_NAMESPACE).bytes
_VARIANT = dict(zip("0123456789abcdef", "89ab89ab89ab89ab", strict=True))
_ESCAPED = re.compile(r'[\x00-\x1f"\\]').search
_WHITE = re.compile(r"[\t-\r\x1c- ]").search
_ENDS = re.compile(r"^[\t-\r\x1c- ]+|[\t-\r\x1c- ]+\Z").sub
_BLANKS = re.compile(r"[\t\n\r\f\x0b ]+").sub
_SLUG = re.compile("[^a-z0-9_-]+").sub
LOCATOR_GRAMMAR = r"^/law(?:/[a-z][a-z0-9_-]*)+\z"


def compatible(value: str) -> str:
    """NFKC, stripped."""
    import unicodedata

    return (value if value.isascii() else unicodedata.normalize("NFKC", value)).strip()


def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else compatible(v))


def _compatible(value: Column) -> Column:
    return F.pandas_udf(_nfkc, T.StringType())(value)


def normalized(value: Column, *, fold: bool = False, ascii_only: bool = False) -> Column:
    """NFKC, stripped, runs of ASCII white space as one space; ``fold`` lower-cases.

    Spark has no NFKC, so values pass an Arrow UDF unless they are known to be ASCII.
    """
    base = F.regexp_replace(value, r"^[\t-\r\x1c- ]+|[\t-\r\x1c- ]+\z", "") if ascii_only else _compatible(value)
    result = F.regexp_replace(base, r"[\t\n\r\f\x0b ]+", " ")
    return F.lower(result) if fold else result


def law_id(jurisdiction: Column, authority: Column, number_key: Column, source_key: Column) -> Column:
    """Null where a part that identity needs is empty. A number key wins over a source key, even an empty one."""
    place, body = normalized(jurisdiction, fold=True), normalized(authority, fold=True)
    kind = F.when(number_key.isNotNull(), "law_number").otherwise("source_law")
    key = normalized(F.coalesce(number_key, source_key, F.lit("")))
    payload = canonical_json({"jurisdiction": place, "authority": body, "key_kind": kind, "key": key})
    whole = (F.length(place) > 0) & (F.length(body) > 0) & (F.length(key) > 0)
    return F.when(whole, F.concat(F.lit("law_"), uuid5(sha256(payload), ID_NAMESPACE)))


def law_id_of(jurisdiction: str | None, authority: str | None, number_key: str | None, source_key: str | None) -> str | None:
    """law_id() of one law."""
    plain = lambda v: re.sub(r"[\t\n\r\f\x0b ]+", " ", compatible(v or ""))
    parts = {"jurisdiction": plain(jurisdiction).lower(), "authority": plain(authority).lower(), "key_kind": "source_law" if number_key is None else "law_number", "key": plain(source_key if number_key is None else number_key)}
    if not all(parts.values()):
        return None
    payload = json.dumps(parts, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return "law_" + str(uuid.uuid5(uuid.UUID(ID_NAMESPACE), hashlib.sha256(payload.encode()).hexdigest()))


def _laws(*parts: pa.Array) -> pa.Array:
    rows = list(zip(*(p.to_pylist() for p in parts), strict=True))
    known = {r: law_id_of(*r) for r in set(rows)}
    return pa.array([known[r] for r in rows], pa.string())


def with_law_id(df: DataFrame, to: str) -> DataFrame:
    """``df`` with law_id() of its columns in ``to``: made once for each law of a batch, where its rows lie, so that no row is moved."""
    return df.withColumn(to, F.arrow_udf(_laws, T.StringType())("jurisdiction", "authority", "law_number_key", "source_law_key"))


def blank(value: Column) -> Column:
    """Whether nothing is left of a text after normalization: it is all white space."""
    return value.rlike(r"^[\p{Z}\t-\r\x1c-\x1f\x{85}]*\z")


def _quoted(text: str | None) -> str:
    """A JSON string, or null."""
    if text is None:
        return "null"
    return json.dumps(text, ensure_ascii=False) if _ESCAPED(text) else f'"{text}"'


def _named(prefix: str, payload: str) -> str:
    """An identifier: the name-based UUID of a payload's digest."""
    h = hashlib.sha1(_SPACE + hashlib.sha256(payload.encode()).hexdigest().encode()).hexdigest()
    return f"{prefix}{h[:8]}-{h[8:12]}-5{h[13:16]}-{_VARIANT[h[16]]}{h[17:20]}-{h[20:32]}"


def normalized_ascii(text: str) -> str:
    """normalized(..., ascii_only=True) of one text."""
    return _BLANKS(" ", _ENDS("", text)) if _WHITE(text) else text


def node_id_of(law: str | None, locator: str | None) -> str:
    """node_id() of one node."""
    return _named("node_", f'{{"law_id":{_quoted(law)},"locator":{_quoted(None if locator is None else normalized_ascii(locator))}}}')


def segment_of(kind: str | None, name: str | None, ordinal: int | None, branch: list[int] | None, stable_key: str | None) -> str | None:
    """segment() of one provision without a tag, its key another than its name, with ASCII white space only."""
    if kind is None:
        return None
    if ordinal is not None:
        return f"{kind}/{kind}-{ordinal}" + "".join(f"-{b}" for b in branch or ())
    if name is None:
        return None
    plain = normalized_ascii(name)
    folded = _SLUG("-", plain.lower()).strip("-")
    if folded:
        return f"{kind}/u-{hashlib.sha256(plain.encode()).hexdigest()[:16]}-{folded[:32]}"
    return f"{kind}/u-{hashlib.sha256(normalized_ascii(stable_key).encode()).hexdigest()[:16]}" if stable_key else None


def _nodes(law: pa.Array, locator: pa.Array) -> pa.Array:
    return pa.array([node_id_of(*r) for r in zip(law.to_pylist(), locator.to_pylist(), strict=True)], pa.string())


def node_id(law: Column, locator: Column) -> Column:
    """``law`` as law_id() makes it, and an ASCII ``locator``."""
    return F.arrow_udf(_nodes, T.StringType())(law, locator)


def sorted_struct(column: str, *names: str) -> Column:
    """A struct's fields in code point order, as canonical JSON has them."""
    return F.struct(*(F.col(f"{column}.{k}").alias(k) for k in sorted(names)))


def temporal_fields(temporal: str = "temporal") -> Column:
    return sorted_struct(temporal, "valid_from", "valid_to", "promulgated", "repealed")


def source_fields(source: str = "source") -> Column:
    return sorted_struct(source, "uri", "sha256", "adapter", "source_key", "page", "byte_start", "byte_end")


def _pairs(keys: pa.Array, values: pa.Array) -> list[str]:
    """The JSON of each row's attributes."""
    known: dict[tuple, str] = {}
    k, v = ([_quoted(x) for x in a.flatten().to_pylist()] for a in (keys, values))
    ends = np.cumsum(pc.fill_null(pc.list_value_length(keys), 0).to_numpy(zero_copy_only=False)).tolist()
    out, at = [], 0
    for end, there in zip(ends, keys.is_valid().to_pylist(), strict=True):
        one = tuple(k[at:end]), tuple(v[at:end])
        if one not in known:
            known[one] = "[" + ",".join(f"[{a},{b}]" for a, b in zip(*one, strict=True)) + "]"
        out.append(known[one] if there else "null")
        at = end
    return out


def _versions(node: pa.Array, text: pa.Array, heading: pa.Array, label: pa.Array, valid_from: pa.Array, valid_to: pa.Array, promulgated: pa.Array, repealed: pa.Array, keys: pa.Array, values: pa.Array) -> pa.Array:
    plain = ([_quoted(x) for x in a.to_pylist()] for a in (heading, label, node, promulgated, repealed, valid_from, valid_to, text))
    out = []
    for pairs, h, lab, n, p, r, f, t, body in zip(_pairs(keys, values), *plain, strict=True):
        times = f'{{"promulgated":{p},"repealed":{r},"valid_from":{f},"valid_to":{t}}}'
        out.append(_named("ver_", f'{{"attributes":{pairs},"heading":{h},"label":{lab},"node_id":{n},"temporal":{times},"text":{body}}}'))
    return pa.array(out, pa.string())


def version_id(node: str = "node_id") -> Column:
    """Of the row's node, temporal, text, heading, label and attributes (sorted pairs)."""
    dates = [F.col(f"temporal.{k}") for k in ("valid_from", "valid_to", "promulgated", "repealed")]
    keys, values = F.transform("attributes", lambda e: e["k"]), F.transform("attributes", lambda e: e["v"])
    return F.arrow_udf(_versions, T.StringType())(node, "text", "heading", "label", *dates, keys, values)


def valid_locator(locator: Column) -> Column:
    return F.coalesce(locator.rlike(LOCATOR_GRAMMAR), F.lit(False))


def slug(value: Column) -> Column:
    """Lower case, all but a-z, 0-9, _ and - as one -, none at the ends."""
    return F.regexp_replace(F.regexp_replace(value, "[^a-z0-9_-]+", "-"), "^-+|-+\\z", "")


def segment(kind: Column, name: Column, ordinal: Column, branch: Column, *, tag: Column | None = None, stable_key: Column | None = None, ascii_only: bool = False) -> Column:
    """A provision's last two steps, ``kind/name``; null where nothing stable names it, a blank tag included."""
    folded = slug(normalized(name, fold=True, ascii_only=ascii_only))
    tail = F.when(F.size(branch) > 0, F.concat(F.lit("-"), F.array_join(F.transform(branch, lambda b: b.cast("string")), "-"))).otherwise("")
    number = F.concat(ordinal.cast("string"), tail)
    tagged = plain = F.concat(kind, F.lit("-"), number)
    if tag is not None:
        tag_slug = slug(normalized(tag, fold=True, ascii_only=ascii_only))
        tagged = F.when(tag.isNull(), plain).when(F.length(tag_slug) > 0, F.concat(kind, F.lit("-"), tag_slug, F.lit("-"), number))
    hashed = F.concat(F.lit("u-"), F.substring(sha256(normalized(name, ascii_only=ascii_only)), 1, 16), F.lit("-"), F.substring(folded, 1, 32))
    key = stable_key if stable_key is not None else name
    keyed = F.when(F.length(key) > 0, F.concat(F.lit("u-"), F.substring(sha256(normalized(key, ascii_only=ascii_only)), 1, 16)))
    safe = F.when(ordinal.isNotNull(), tagged).when(F.length(folded) == 0, keyed).otherwise(hashed)
    return F.concat(kind, F.lit("/"), safe)


def segment_problem(step: Column, ordinal: Column) -> Column:
    """Why ``segment`` gave no step, or null: a numbered one lacks its source's tag, another a stable key."""
    return F.when(step.isNull(), F.when(ordinal.isNotNull(), "LOCATOR_SOURCE_TAG_REQUIRED").otherwise("LOCATOR_STABLE_SOURCE_KEY_REQUIRED"))


def parent_locator(locator: Column) -> Column:
    """The locator of the provision above, or null for a root."""
    return F.when(locator != "/law/root", F.regexp_replace(locator, "/[^/]+/[^/]+\\z", ""))


def node_json(schema: str) -> Column:
    """The canonical line of a node."""
    plain = ("jurisdiction", "authority", "law_number_key", "source_law_key", "law_id", "node_id", "version_id", "parent_id", "kind", "locator", "depth", "ordinal", "branch", "label", "heading", "text")
    pairs = F.map_from_entries(F.transform("attributes", lambda e: F.struct(e["k"], e["v"])))
    return canonical_json({k: F.col(k) for k in plain} | {"schema": F.lit(schema), "attributes": pairs, "temporal": temporal_fields(), "source": source_fields()})


def crosswalk_json() -> Column:
    return canonical_json({k: F.col(k) for k in ("legacy_id", "target_node_id", "target_version_id", "relation", "reason", "source_sha256")})


def projection_json(schema: str) -> Column:
    plain = ("projection_id", "projection_version", "node_id", "version_id", "law_id", "locator", "heading", "text", "kind")
    return canonical_json({k: F.col(k) for k in plain} | {"schema": F.lit(schema), "temporal": temporal_fields(), "evidence": source_fields("evidence")})
