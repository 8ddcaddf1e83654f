"""Evaluation metrics and vocabularies (AGG05-10, AGG13, LAB09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.positions import POS


def class_recall(df: DataFrame, true: str, predicted: str, classes: int) -> DataFrame:
    hit = (F.col(true) == F.col(predicted)).cast("int")
    return df.filter((F.col(true) >= 0) & (F.col(true) < classes)).groupBy(F.col(true).alias("class_id")).agg(F.avg(F.coalesce(hit, F.lit(0))).alias("recall"), F.count("*").alias("rows"))


def macro_accuracy(df: DataFrame, true: str, predicted: str, classes: int = 10) -> DataFrame:
    """AGG05: mean recall of the classes that occur; 0 without any."""
    return class_recall(df, true, predicted, classes).agg(F.coalesce(F.avg("recall"), F.lit(0.0)).alias("macro_accuracy"))


def group_accuracy(df: DataFrame, true: str, predicted: str, group: str) -> DataFrame:
    """AGG06: share of right predictions for each device, scene or other group."""
    hit = F.coalesce((F.col(true) == F.col(predicted)).cast("int"), F.lit(0))
    return df.groupBy(group).agg(F.avg(hit).alias("accuracy"), F.count("*").alias("rows"))


def confusion_matrix(df: DataFrame, true: str, predicted: str, classes: int = 10) -> DataFrame:
    """AGG07: counts of every (true, predicted) pair; what is out of range is left out."""
    inside = [(F.col(c) >= 0) & (F.col(c) < classes) for c in (true, predicted)]
    counts = df.filter(inside[0] & inside[1]).groupBy(F.col(true).cast("int").alias("y_true"), F.col(predicted).cast("int").alias("y_pred")).agg(F.count("*").alias("n"))
    cells = df.sparkSession.range(classes * classes).select(F.floor(F.col("id") / classes).cast("int").alias("y_true"), (F.col("id") % classes).cast("int").alias("y_pred"))
    return cells.join(counts, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def real_rows(mask: Column) -> Column:
    """AGG08: how many entries of a padding mask are rows."""
    return F.size(F.filter(mask, lambda m: m))


def vocabulary(df: DataFrame, field: Column, position: str = POS) -> DataFrame:
    """AGG09: distinct values, numbered in the order they are met; null is no value. (value, id)"""
    seen = df.groupBy(field.cast("string").alias("value")).agg(F.min(position).alias("first")).filter("value is not null")
    return seen.select("value", (F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("id"))


def encode(df: DataFrame, field: str, words: DataFrame, name: str) -> DataFrame:
    """LAB09: adds ``name``: the id of ``field``, -1 for what the vocabulary lacks."""
    known = words.select(F.col("value").alias("_value"), F.col("id").alias("_id"))
    return df.join(known, F.col(field).cast("string") == F.col("_value"), "left").select(*df.columns, F.coalesce("_id", F.lit(-1)).cast("long").alias(name))


def decode(df: DataFrame, field: str, words: DataFrame, name: str) -> DataFrame:
    """LAB09: the inverse; null for -1."""
    known = words.select(F.col("value").alias(name), F.col("id").alias("_id"))
    return df.join(known, F.col(field) == F.col("_id"), "left").select(*df.columns, name)


def inventory_counts(df: DataFrame, keep: Column) -> DataFrame:
    """AGG10: requested, retained and excluded for each (source, split) and in total (nulls)."""
    return df.rollup("source", "split").agg(F.count("*").alias("requested"), F.sum(keep.cast("int")).alias("retained"), F.sum((~keep).cast("int")).alias("excluded")).filter("(source is null) = (split is null)")


def batch_count(rows: int, batch_size: int, drop_remainder: bool = False) -> int:
    """AGG13"""
    return rows // batch_size if drop_remainder else -(-rows // batch_size)
