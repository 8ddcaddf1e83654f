"""Source and adapter registries, and scans of several sources in a declared order (SRC01-06, PRJ01)."""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession

Loader = Callable[[SparkSession, str, list[str], str | None], list[DataFrame]]
Adapter = Callable[[DataFrame], DataFrame]


class Registry(dict):
    """Names and prefixes; the exact name is found first, then the longest prefix."""

    def __init__(self, kind: str):
        super().__init__()
        self.kind = kind

    def register(self, name: str, value, *, replace: bool = False):
        if name in self and not replace and self[name] is not value:
            raise ValueError(f"{self.kind} {name!r} is registered already")
        self[name] = value
        return value

    def resolve(self, name: str, default=None):
        if name in self:
            return self[name]
        found = [p for p in self if name.startswith(p)]
        return self[max(found, key=len)] if found else default

    def find(self, name: str):
        got = self.resolve(name)
        if got is None:
            raise KeyError(f"no {self.kind} is registered for {name!r}")
        return got


SOURCES, ADAPTERS = Registry("source"), Registry("adapter")


def register_source(prefix: str, loader: Loader, *, replace: bool = False) -> Loader:
    """SRC03: an error if the prefix has another loader already."""
    return SOURCES.register(prefix, loader, replace=replace)


def register_adapter(name: str, adapter: Adapter, *, replace: bool = False) -> Adapter:
    """PRJ01"""
    return ADAPTERS.register(name, adapter, replace=replace)


def adapter_for(name: str, required: bool = False) -> Adapter:
    """PRJ01: identity without one, unless it is required."""
    return ADAPTERS.find(name) if required else ADAPTERS.resolve(name, lambda df: df)


def parquet_tables(spark: SparkSession, name: str, splits: list[str], data_dir: str | None) -> list[DataFrame]:
    """SRC04: the default: a Parquet table by name, its rows of each split if it has a column of that name."""
    df = spark.read.parquet(f"{data_dir}/{name}.parquet")
    return [df.filter(df["split"] == s) for s in splits] if "split" in df.columns else [df]


def cache_dir(data_dir: str | None, *parts: str) -> Path:
    """SRC06"""
    return Path(data_dir or os.path.expanduser("~/.cache/tidemill"), *parts)


def from_records(spark: SparkSession, records: list[dict], schema: str) -> DataFrame:
    """SRC05, SRC09: a finite list of records, its types checked as declared."""
    return spark.createDataFrame([tuple(r.get(f.split()[0]) for f in schema.split(", ")) for r in records], schema, verifySchema=True)


def fetch(spark: SparkSession, names: list[str], splits: list[str] | dict[str, list[str]], data_dir: str | None = None, *, source_filter: Column | None = None) -> DataFrame | None:
    """SRC01: the datasets' splits one after the other; ``_source`` and ``_split`` keep the order.

    A dataset that fails to load is left out with a warning; a dataset without splits is too. None if nothing loads.
    """
    parts = []
    for i, name in enumerate(names):
        wanted = splits.get(name) if isinstance(splits, dict) else splits
        if not wanted:
            warnings.warn(f"no splits are asked of {name}", stacklevel=2)
            continue
        try:
            loaded = SOURCES.resolve(name, parquet_tables)(spark, name, list(wanted), data_dir)
        except Exception as e:  # noqa: BLE001  one source's failure leaves the others
            warnings.warn(f"{name} is left out: {e}", stacklevel=2)
            continue
        adapt = adapter_for(name)
        for j, df in enumerate(loaded):
            df = df if source_filter is None else df.filter(source_filter)
            parts.append(adapt(df).selectExpr("*", f"{i} as _source", f"{j} as _split"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None
