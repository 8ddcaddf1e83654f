"""Ordered batches with padding masks, and where to resume them (WIN02-05, BA01, BA02, JOIN08)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.hashing import draw
from tidemill.functions.labels import blend
from tidemill.operators.positions import POS


def batch(df: DataFrame, size: int, columns: list[str], *, drop_remainder: bool = False, position: str = POS) -> DataFrame:
    """WIN02: batch_id and ``rows``, the structs of ``size`` consecutive rows in order. A group is one batch."""
    if size < 1:
        raise ValueError("a batch needs a positive size")
    rows = F.array_sort(F.collect_list(F.struct(position, *columns)))
    out = df.groupBy(F.floor(F.col(position) / size).alias("batch_id")).agg(rows.alias("rows"))
    out = out.withColumn("rows", F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in columns])))
    return out.filter(F.size("rows") == size) if drop_remainder else out


def zero_of(kind) -> Column:
    """What pads a field: 0, "", false, or a struct of those."""
    name = kind.typeName()
    if name == "struct":
        return F.struct(*[zero_of(f.dataType).alias(f.name) for f in kind.fields])
    if name == "array":
        return F.array().cast(kind)
    return F.lit({"string": "", "boolean": False, "binary": ""}.get(name, 0)).cast(kind)


def padded(batches: DataFrame, size: int) -> DataFrame:
    """WIN03: every batch with ``size`` rows and ``padding_mask``, true where a row is real."""
    zero = zero_of(batches.schema["rows"].dataType.elementType)
    n = F.size("rows")
    mask = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: k < n)
    return batches.withColumn("padding_mask", mask).withColumn("rows", F.concat("rows", F.array_repeat(zero, F.greatest(F.lit(size) - n, F.lit(0)))))


def resumed(batches: DataFrame, cursor: int) -> DataFrame:
    """WIN04: what follows the first ``cursor`` batches."""
    return batches.filter(F.col("batch_id") >= cursor)


def remaining(rows: int, size: int, cursor: int, drop_remainder: bool = False) -> tuple[int, int]:
    """WIN05: batches and rows that are left."""
    total = rows // size if drop_remainder else -(-rows // size)
    if not 0 <= cursor <= total:
        raise ValueError(f"cursor {cursor} is not in 0..{total}")
    return total - cursor, (total * size if drop_remainder else rows) - min(cursor * size, rows)


def partners(df: DataFrame, size: int, seed: int, position: str = POS) -> DataFrame:
    """JOIN08: adds ``_partner``, a row of the same batch: a seeded shuffle, moved on by one where it changes nothing."""
    by = Window.partitionBy("_batch")
    order = F.xxhash64(F.lit(seed), F.col(position))
    t = df.withColumn("_batch", F.floor(F.col(position) / size))
    t = t.withColumn("_place", F.row_number().over(by.orderBy(position)) - 1).withColumn("_drawn", F.row_number().over(by.orderBy(order, position)) - 1)
    t = t.withColumn("_same", F.min((F.col("_place") == F.col("_drawn")).cast("int")).over(by)).withColumn("_n", F.count("*").over(by))
    drawn = F.when(F.col("_same") == 1, (F.col("_place") + 1) % F.col("_n")).otherwise(F.col("_drawn"))
    t = t.withColumn("_drawn", drawn)
    given = t.select("_batch", F.col("_place").alias("_drawn"), F.col(position).alias("_partner"))
    return t.join(given, ["_batch", "_drawn"]).select(*df.columns, "_partner")


def batch_share(seed: int, batch_id: int, alpha: float, keep_larger: bool = True) -> float:
    """BA01: the share of a batch, from a symmetric beta distribution; by default the larger side."""
    share = float(np.random.Generator(np.random.Philox(key=[seed & (2**63 - 1), batch_id])).beta(alpha, alpha)) if alpha > 0 else 1.0
    return max(share, 1 - share) if keep_larger else share


def mixup(df: DataFrame, size: int, inputs: str, labels: str | None, *, seed: int, share: float | None = None, probability: float = 1.0, either: bool = False, position: str = POS) -> DataFrame:
    """BA01, BA02: each row mixed with its partner by one share for a batch. Labels are vectors already (LAB06).

    ``share`` None: a share for each batch, uniform on 0.5..1 (a beta distribution with alpha 1, its larger side).
    """
    other = df.select(F.col(position).alias("_partner"), F.col(inputs).alias("_x"), *([F.col(labels).alias("_y")] if labels else []))
    t = partners(df, size, seed, position).join(other, "_partner")
    batch_id = F.floor(F.col(position) / size)
    given = F.lit(float(share)) if share is not None else 0.5 + 0.5 * draw(seed, batch_id, "share")
    on = draw(seed, batch_id, "gate") < probability
    mixed = {inputs: F.when(on, blend(F.col(inputs), F.col("_x"), given)).otherwise(F.transform(inputs, lambda v: v.cast("double")))}
    if labels:
        mixed[labels] = F.when(on, blend(F.col(labels), F.col("_y"), given, either)).otherwise(F.transform(labels, lambda v: v.cast("double")))
    return t.withColumns(mixed).select(*df.columns)
