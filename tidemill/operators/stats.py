"""Grouped moments of feature arrays (AGG01-03, PRJ06, PRJ07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.filters import assert_stats_allowed, metadata_column

AXES = {"time": 0, "frequency": 1, "freq": 1, "channel": -1}


def axis_numbers(axes: tuple, rank: int) -> set[int]:
    """The array's dimensions that are reduced; a name that a vector lacks means its only one."""
    out = set()
    for a in axes:
        if isinstance(a, str):
            if a not in AXES:
                raise ValueError(f"unknown feature axis {a!r}")
            a = min(AXES[a], rank - 1)
        a += rank if a < 0 else 0
        if not 0 <= a < rank:
            raise ValueError(f"axis {a} of an array of {rank} dimensions")
        out.add(a)
    return out


def rank_of(kind: T.DataType) -> int:
    n = 0
    while isinstance(kind, T.ArrayType):
        kind, n = kind.elementType, n + 1
    return n


def feature_stats(df: DataFrame, feature: str, *, by: list[str] | str | None, axes: tuple = ("time",)) -> DataFrame:
    """AGG01: for each group and each place of the axes that stay: count, mean, std (population), in double precision.

    ``axes`` that are reduced; () reduces rows only. ``count`` is of observations, not rows. Place columns are
    ``axis0``, ``axis1`` and so on for the array's dimensions that stay. Partial moments are formed before the shuffle.
    """
    by = [by] if isinstance(by, str) else list(by or [])
    rank = rank_of(df.schema[feature].dataType)
    gone = axis_numbers(axes, rank)
    keys = []
    for k in by:
        found = metadata_column(df.schema, k)
        if found is None:
            raise ValueError(f"no such field: {k}")
        keys.append(found[0].alias(k))
    out = df.select(*(keys or [F.lit("all").alias("all")]), F.col(feature).alias("_x"))
    names, places = out.columns[:-1], []
    for d in range(rank):
        out = out.select(*names, *places, F.posexplode("_x").alias(f"axis{d}", "_x"))
        if d in gone:
            out = out.drop(f"axis{d}")
        else:
            places.append(f"axis{d}")
    x = F.col("_x").cast("double")
    return out.groupBy(*names, *places).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))


def checked_feature_stats(df: DataFrame, feature: str, *, split: str, override: bool = False, **options) -> DataFrame:
    """AGG02: AGG01 on a split that may be fitted on."""
    assert_stats_allowed(split, override=override)
    return feature_stats(df, feature, **options)


def _kept(kind: T.StructType, column: Column, keep: set[str]) -> Column | None:
    fields = []
    for f in kind.fields:
        own = column.getField(f.name)
        if isinstance(f.dataType, T.StructType):
            inner = _kept(f.dataType, own, set())
            if inner is not None:
                fields.append(inner.alias(f.name))
        elif f.name in keep or not isinstance(f.dataType, (T.StringType, T.BinaryType)):
            fields.append(own.alias(f.name))
    return F.struct(*fields) if fields else None


def with_metadata_mode(df: DataFrame, mode: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """PRJ06: ``full``, ``none``, or ``numeric_only``: no text at any depth and no empty structs; PRJ07: but ``keep``."""
    if mode not in ("full", "none", "numeric_only"):
        raise ValueError("metadata mode must be full, none or numeric_only")
    if mode == "full" or "metadata" not in df.columns:
        return df
    if mode == "none":
        return df.drop("metadata")
    left = _kept(df.schema["metadata"].dataType, F.col("metadata"), set(keep))
    return df.drop("metadata") if left is None else df.withColumn("metadata", left)


def flattened(df: DataFrame, field: str = "metadata", separator: str = "__") -> DataFrame:
    """PRJ09: each leaf of a nested struct as a column of its own."""

    def leaves(kind, column, path):
        for f in kind.fields:
            own, name = column.getField(f.name), [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, own, name)
            else:
                yield own.alias(separator.join(name))

    return df.select(*[c for c in df.columns if c != field], *leaves(df.schema[field].dataType, F.col(field), [field]))


def nested(df: DataFrame, field: str = "metadata", separator: str = "__") -> DataFrame:
    """PRJ09: back from what ``flattened`` made."""
    tree: dict = {}
    for c in df.columns:
        if c.startswith(field + separator):
            at = tree
            *path, last = c.split(separator)[1:]
            for p in path:
                at = at.setdefault(p, {})
            at[last] = F.col(f"`{c}`")
    build = lambda t: F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in t.items()])
    return df.select(*[c for c in df.columns if not c.startswith(field + separator)], build(tree).alias(field))


def stats_batches(df: DataFrame, *, batch_size: int, by: list[str] | str | None = None, mode: str = "numeric_only"):
    """AGG03: Arrow batches of ``batch_size`` rows, never augmented; text is only kept where it is a group key."""
    keep = (by,) if isinstance(by, str) else tuple(by or ())
    rows = with_metadata_mode(df, mode, keep)
    held: list = []
    for row in rows.toLocalIterator(prefetchPartitions=True):
        held.append(row.asDict(recursive=True))
        if len(held) == batch_size:
            yield held
            held = []
    if held:
        yield held
