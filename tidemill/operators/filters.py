"""Predicates on metadata and splits, groups of rows, the guard against leaking splits (FLT01-09, AGG04, PRJ08)."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.positions import POS

#: Splits that statistics may be fitted on.
FITTED_SPLITS = {"dev_train_25": True, "dev_test": False, "eval": False}
TRAINING_SPLIT = "dev_train_25"


class SplitLeakage(ValueError):
    """Statistics were asked for on a split that must stay unseen."""


def metadata_column(schema: T.StructType, key: str) -> tuple[Column, T.DataType] | None:
    """PRJ08: ``metadata.key`` if there is one, else the column ``key``, else None."""
    if "metadata" in schema.names and isinstance(schema["metadata"].dataType, T.StructType) and key in schema["metadata"].dataType.names:
        return F.col("metadata").getField(key), schema["metadata"].dataType[key].dataType
    return (F.col(f"`{key}`"), schema[key].dataType) if key in schema.names else None


def metadata_predicate(schema: T.StructType, **criteria) -> Column:
    """FLT01: all of ``key=value`` and ``key_in=[values]``.

    A missing field, a null and an empty list match nothing; no criteria match everything. What a text column is
    compared with becomes text. A field whose own name ends in ``_in`` can only be asked for membership.
    """
    checks = []
    for name, wanted in criteria.items():
        key, several = (name[:-3], True) if name.endswith("_in") else (name, False)
        found = metadata_column(schema, key)
        options = list(wanted) if several else [wanted]
        if found is None or not options:
            checks.append(F.lit(False))
            continue
        column, kind = found
        if isinstance(kind, T.StringType):
            options = [o if isinstance(o, str) else str(o) for o in options]
        checks.append(F.coalesce(column.isin(options), F.lit(False)))
    return reduce(lambda a, b: a & b, checks, F.lit(True)) if checks else F.lit(True)


def filter_by_metadata(df: DataFrame, **criteria) -> DataFrame:
    """FLT02; before an adapter it is a source filter (FLT03), after preprocessing a late one (FLT04)."""
    return df.filter(metadata_predicate(df.schema, **criteria))


def domain_filter(df: DataFrame, domain: dict | None, extra: Column | None = None) -> DataFrame:
    """FLT05: rows of a domain that also pass the caller's own predicate."""
    out = filter_by_metadata(df, **(domain or {}))
    return out if extra is None else out.filter(extra)


def dataset_type_of(split: str, is_source: bool) -> str:
    """FLT05: only the source domain's training split is for training."""
    return "train" if is_source and split == TRAINING_SPLIT else "validation"


def assert_stats_allowed(split: str, *, override: bool = False) -> None:
    """FLT06"""
    if split not in FITTED_SPLITS:
        raise ValueError(f"unknown split {split!r}")
    if not FITTED_SPLITS[split]:
        if not override:
            raise SplitLeakage(f"statistics on {split!r} would leak what is held out")
        warnings.warn(f"statistics are fitted on {split!r}", stacklevel=2)


def selected(df: DataFrame, keep: Column, record_id: str) -> DataFrame:
    """FLT07: a named selection; a row for which it is null is an error, not an exclusion."""
    failed = F.raise_error(F.concat(F.lit("selection_failed: "), F.col(record_id).cast("string")))
    return df.filter(F.when(keep.isNull(), failed.cast("boolean")).otherwise(keep))


def split_predicate(df: DataFrame, wanted: str) -> Column:
    """FLT08: the first of split, subset and partition that is filled; rows without any belong to the wanted one."""
    named = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("split", "subset", "partition") if c in df.columns]
    return F.coalesce(*named, F.lit(wanted)) == wanted


def is_unlabeled_split(split: Column) -> Column:
    """FLT09"""
    return split.endswith("_unlabeled")


def group_sizes(df: DataFrame, keys: list[str], position: str = POS) -> DataFrame:
    """AGG04: each distinct key tuple, its rows and its first position; ``first`` gives the order they are met in."""
    columns = {k: metadata_column(df.schema, k) for k in keys}
    missing = [k for k, c in columns.items() if c is None]
    if missing:
        raise ValueError(f"no such field: {missing}")
    return df.groupBy(*[c[0].alias(k) for k, c in columns.items()]).agg(F.count("*").alias("rows"), F.min(position).alias("first"))


def groups(df: DataFrame, keys: list[str], position: str = POS, most: int = 10_000) -> dict:
    """AGG04: key (or tuple) -> its rows, in the order the keys are met. One lazy DataFrame for each of at most ``most`` keys."""
    found = group_sizes(df, keys, position).orderBy("first").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} groups; use group_sizes")
    own = {k: metadata_column(df.schema, k)[0] for k in keys}
    pick = lambda row: df.filter(reduce(lambda a, b: a & b, [own[k].eqNullSafe(F.lit(row[k])) for k in keys]))
    return {row[keys[0]] if len(keys) == 1 else tuple(row[k] for k in keys): pick(row) for row in found}
