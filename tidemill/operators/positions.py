"""Explicit order: a bigint column ``_pos``, as a DataFrame has no order of its own (PRJ13, SRC02, SET01)."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

POS = "_pos"


#: Ranges for each shuffle partition, and sampled keys for each range. Ranges are dealt by a hash, so a partition gets
#: several of them.
RANGES, SAMPLED = 4, 16


def range_bounds(keyed: DataFrame, names: list[str], ranges: int) -> DataFrame | None:
    """One row, ``_bounds``: keys that cut ``keyed`` into about ``ranges`` even ranges; None where one range will do.

    Taken from a sample of SAMPLED keys a range, the least by a hash. As they are values, every use of them cuts
    the same way, however its own plan is partitioned.
    """
    got = keyed.select(*names).orderBy(F.xxhash64(*names)).limit(ranges * SAMPLED)
    taken = got.select(F.struct(*names).alias("_bound")).toArrow().column(0)
    if len(taken) < ranges * SAMPLED:
        return None  # the sample is the whole table
    spark = keyed.sparkSession
    sample = spark.createDataFrame(pa.table({"_bound": taken}), StructType([StructField("_bound", StructType([keyed.schema[n] for n in names]))]))
    every = F.array_sort(F.collect_list("_bound"))
    cuts = F.sequence(F.lit(SAMPLED), F.lit(len(taken) - 1), F.lit(SAMPLED))
    bounds = sample.agg(every.alias("_all")).select(F.transform(cuts, lambda i: F.get("_all", i)).alias("_bounds"))
    return bounds


def range_of(key: Column, bounds: Column, ranges: int) -> Column:
    """How many of the sorted ``bounds`` (fewer than ``ranges``) are not above ``key``: a binary search."""
    steps = [1 << k for k in reversed(range(ranges.bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: at + F.when(F.get(bounds, at + step - 1) <= key, step).otherwise(0))


def enumerate_rows(df: DataFrame, *order: str | Column, name: str = POS) -> DataFrame:
    """PRJ13: 0-based positions by ``order`` (unique together), without one task that sees all rows.

    Rows are numbered within ranges of the order, and a count for each range gives where its positions start. The
    ranges' bounds are fixed values when this returns, so counts and rows agree on them.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    names = [f"_key{i}" for i in range(len(keys))]
    keyed = df.withColumns(dict(zip(names, keys, strict=True)))
    ranges = RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(keyed, names, ranges)
    if bounds is None:
        alone = Window.partitionBy(F.lit(0)).orderBy(*names)
        return keyed.select(*[F.col(f"`{c}`") for c in df.columns], (F.row_number().over(alone) - 1).cast("long").alias(name))

    ranged = keyed.select("*", bounds.scalar().alias("_bounds"))
    ranged = ranged.withColumn("_range", range_of(F.struct(*names), F.col("_bounds"), ranges)).drop("_bounds")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = counts.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbered = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_range").orderBy(*names)) - 1)
    out = numbered.join(F.broadcast(before), "_range")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_row")).cast("long").alias(name))


def concatenate(*parts: DataFrame) -> DataFrame | None:
    """SRC02, SET01: one after the other: ``_part`` tells which; None for nothing. Missing columns are null."""
    if not parts:
        return None
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def shuffled(df: DataFrame, seed: int, epoch: int = 0, position: str = POS) -> DataFrame:
    """WIN01: every row in a seeded order that differs between epochs, as a new ``position``."""
    return enumerate_rows(df.withColumnRenamed(position, "_was"), F.xxhash64(F.lit(seed), F.lit(epoch), F.col("_was")), F.col("_was"), name=position).drop("_was")
