"""Adapters by name, and by what a file looks like."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InputError
from ..profile import DEFAULT, Profile
from .law_xml import Adapted, adapt_laws
from .tree import adapt_html, adapt_json, adapt_xml


@dataclass(frozen=True)
class Adapter:
    """``adapt`` takes (files, mapping, profile); ``sniff`` says by columns file and content whether a file is its own."""

    adapt: Callable[[DataFrame, dict | None, Profile], Adapted]
    sniff: Callable[[], Column]
    priority: int


class Registry:
    """The adapter of a file is the one of highest priority whose sniff says yes; ties and none are refused."""

    def __init__(self) -> None:
        self._adapters: dict[str, Adapter] = {}

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(sorted(self._adapters))

    def register(self, name: str, adapt: Callable, *, sniff: Callable[[], Column], priority: int) -> None:
        if name in self._adapters:
            raise InputError(f"ADAPTER_DUPLICATE: {name}")
        self._adapters[name] = Adapter(adapt, sniff, priority)

    def resolve(self, files: DataFrame) -> DataFrame:
        """``files`` with adapter, or with the diagnostic that speaks against one."""
        claims = F.array_compact(F.array(*(F.when(a.sniff(), F.struct(F.lit(a.priority).alias("priority"), F.lit(name).alias("name"))) for name, a in sorted(self._adapters.items()))))
        out = files.withColumn("__claims", claims)
        out = out.withColumn("__best", F.filter("__claims", lambda c: c["priority"] == F.array_max(F.col("__claims.priority"))))
        one = F.size("__best") == 1
        refusal = F.when(F.size("__best") == 0, "ADAPTER_UNRECOGNIZED").otherwise(F.concat(F.lit("ADAPTER_AMBIGUOUS: "), F.array_join("__best.name", ",")))
        return out.withColumn("adapter", F.when(one, F.try_element_at("__best.name", F.lit(1)))).withColumn("diagnostic", F.when(~one, refusal)).drop("__claims", "__best")

    def adapt(self, files: DataFrame, *, name: str, mapping: dict | None = None, profile: Profile = DEFAULT) -> Adapted:
        if name not in self._adapters:
            raise InputError(f"ADAPTER_UNKNOWN: {name}")
        return self._adapters[name].adapt(files, mapping, profile)


def suffix(*endings: str) -> Callable[[], Column]:
    return lambda: F.lower("file").rlike("(" + "|".join(e.replace(".", "[.]") for e in endings) + r")\z")


def _admitted(contents: pd.Series) -> pd.Series:
    from .law_parser import Refused, admit

    def one(raw: bytes | None) -> bool:
        try:
            admit(raw or b"")
        except Refused:
            return False
        return True

    return contents.map(one)


def _laws(files: DataFrame, mapping: dict | None, profile: Profile) -> Adapted:
    if mapping is not None and (set(mapping) != {"law_id"} or not isinstance(mapping["law_id"], str) or not mapping["law_id"].strip()):
        raise InputError("EGOV_XML_MAPPING")
    return adapt_laws(files, mapping and mapping["law_id"], profile)


def default_registry() -> Registry:
    registry = Registry()
    registry.register("json", adapt_json, sniff=suffix(".json"), priority=10)
    registry.register("xml", adapt_xml, sniff=suffix(".xml"), priority=10)
    registry.register("html", adapt_html, sniff=suffix(".html", ".xhtml"), priority=10)
    registry.register("egov_xml", _laws, sniff=lambda: F.pandas_udf(_admitted, T.BooleanType())("content"), priority=20)
    return registry
