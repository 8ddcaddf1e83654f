"""What must hold of identities, dense samples and class declarations (SET02, SET03, GEO06, TGT06).

Checks of rows are DataFrames of issues, empty where all is well; checks of declarations raise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identity_difference(requested: DataFrame, reported: DataFrame, key: str) -> DataFrame:
    """SET02: (key, issue): identities that were requested and are not reported (missing), or the other way (unknown).

    One exchange: both sides are counted by key together.
    """
    both = requested.select(F.col(key).alias("key"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(reported.select(F.col(key), F.lit(0), F.lit(1)))
    sides = both.groupBy("key").agg(F.max("a").alias("a"), F.max("b").alias("b")).filter("a <> b")
    return sides.select(F.col("key").alias(key), F.when(F.col("a") == 1, "missing").otherwise("unknown").alias("issue"))


def same_identities(a: DataFrame, b: DataFrame, key: str) -> bool:
    """SET02: equal as sets."""
    return identity_difference(a, b, key).isEmpty()


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """SET03: the keys that more than one row has, and how many have it."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def assert_unique(values: Sequence, what: str) -> None:
    """SET03, of a declaration."""
    if len(set(values)) != len(values):
        raise ValueError(f"{what} repeats {sorted({v for v in values if list(values).count(v) > 1}, key=str)}")


def dense_issue(image_height: Column, image_width: Column, mask: Column, classes: Sequence[int], ignore: int) -> Column:
    """GEO06: why a mask (array of rows of labels) is not one of the image's; null for a good one.

    shape_differs: not the image's rows and columns; undeclared_label: a value that is no class and not ignored.
    """
    wide = F.exists(mask, lambda row: F.size(row) != image_width)
    known = F.array(*[F.lit(int(v)) for v in [*classes, ignore]])
    odd = F.exists(mask, lambda row: F.exists(row, lambda v: v.isNull() | ~F.array_contains(known, v.cast("int"))))
    return F.when(mask.isNull(), "no_mask").when((F.size(mask) != image_height) | wide, "shape_differs").when(odd, "undeclared_label")


def validate_dense(df: DataFrame, *, height: str, width: str, mask: str, classes: Sequence[int], ignore: int = 255) -> DataFrame:
    """GEO06: the rows with an issue, as column ``issue``."""
    return df.withColumn("issue", dense_issue(F.col(height), F.col(width), F.col(mask), classes, ignore)).filter("issue is not null")


def validate_categorical(field: str, kind: str, fill: int, classes: Sequence[int]) -> None:
    """GEO06: a categorical field is whole numbers, and what fills it is none of the classes."""
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{field}: labels are whole numbers, not {kind}")
    low, high = {"tinyint": (-128, 127), "smallint": (-(1 << 15), (1 << 15) - 1), "int": (-(1 << 31), (1 << 31) - 1), "bigint": (-(1 << 63), (1 << 63) - 1)}[kind]
    if not low <= fill <= high:
        raise ValueError(f"{field}: {fill} is not a {kind}")
    if fill in classes:
        raise ValueError(f"{field}: {fill} fills and is a class")


def validate_classes(classes: Sequence[int], things: Sequence[int], *, void: int = 0, capacity: int | None = None, ignore: int | None = None) -> None:
    """TGT06: class values are whole, not negative, each there once; things are classes; void and ignored are none."""
    for name, values in (("classes", classes), ("things", things)):
        if any(isinstance(v, bool) or not isinstance(v, int) or v < 0 for v in values):
            raise ValueError(f"{name} must be whole numbers that are not negative")
        assert_unique(values, name)
    if not classes:
        raise ValueError("there must be a class")
    if set(things) - set(classes):
        raise ValueError(f"{sorted(set(things) - set(classes))} are things but no classes")
    if isinstance(void, bool) or not isinstance(void, int) or void < 0:
        raise ValueError("void must be a whole number that is not negative")
    if ignore is not None and ignore in classes:
        raise ValueError(f"{ignore} is ignored and a class")
    if capacity is not None and (isinstance(capacity, bool) or not isinstance(capacity, int) or capacity < len(set(classes) - set(things))):
        raise ValueError("the capacity must hold every class that is no thing")
