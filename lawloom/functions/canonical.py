"""Canonical JSON, digests and name-based UUIDs as column expressions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_KEEP_NULLS = {"ignoreNullFields": "false"}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, however often it is used; it also keeps generated code small."""
    return F.transform(F.array(value), use)[0]


def _fixed(text: Column) -> Column:
    out = text
    for digit in "ABCDEF":
        out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}")
    return F.when(text.rlike(r"\\u00[01][A-F]"), out).otherwise(text)


def _lower_hex(text: Column) -> Column:
    """JSON with the digits of its control character escapes in lower case; escaped backslashes before them are left."""
    return bound(text, _fixed)


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """The object of the columns, keys in code point order, nulls kept: as compact as JSON can be."""
    return _lower_hex(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), _KEEP_NULLS))


def json_string(text: Column) -> Column:
    """A JSON string; null as null."""
    return bound(_lower_hex(F.to_json(F.array(text), _KEEP_NULLS)), lambda whole: F.substring(whole, F.lit(2), F.length(whole) - 2))


def json_number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def json_array(items: Column) -> Column:
    """An array of JSON texts."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def json_object(fields: Mapping[str, Column]) -> Column:
    """An object of JSON texts, keys in code point order."""
    parts: list[Column] = []
    for key in sorted(fields):
        parts += [F.lit(f'{"," if parts else ""}"{key}":'), fields[key]]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def uuid5(name: Column, namespace: str) -> Column:
    """The name-based (SHA-1) UUID of a text in ``namespace``."""
    space = F.unhex(F.lit(uuid.UUID(namespace).hex))

    def spelled(h: Column) -> Column:
        variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
        return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))

    return bound(F.sha1(F.concat(space, F.encode(name, "UTF-8"))), spelled)


def hex_digest(value: Column) -> Column:
    """Whether a text is 64 lower-case hexadecimal digits."""
    return F.coalesce(value.rlike("^[0-9a-f]{64}\\z"), F.lit(False))


def content_uri(digest: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), digest)


def content_uri_digest(uri: Column, prefix: str) -> Column:
    """The digest in a content URI, or null."""
    rest = F.substring(uri, len(prefix) + 1, 1 << 20)
    return F.when(uri.startswith(prefix) & hex_digest(rest), rest)
