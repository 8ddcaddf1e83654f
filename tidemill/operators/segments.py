"""Segment tables and pixel tables: lookups, visible area, targets under a capacity (JOIN06, 07, 10, 11, AGG11, WIN08, TGT03, 04).

Pixels are rows (image, row, column, segment_id); segments are rows (image, segment_id, category_id, is_crowd).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("error", "exclude_supervision", "merge_by_category")


def with_categories(pixels: DataFrame, segments: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """JOIN06: each pixel with its segment's fields; null for void."""
    return pixels.join(segments.select(*keys, *fields), keys, "left")


def semantic_labels(pixels: DataFrame, segments: DataFrame, keys: list[str], *, category: str, values: dict[int, int], ignore: int = 255, crowd: str | None = None, valid: Column | None = None) -> DataFrame:
    """TGT03: adds ``semantic``: the value of the pixel's category; void, invalid and (with ``crowd``) crowds are ignored."""
    t = with_categories(pixels, segments, keys, [category, *([crowd] if crowd else [])])
    label = F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(category))
    ok = valid if valid is not None else F.lit(True)
    if crowd:
        ok = ok & ~F.coalesce(F.col(crowd), F.lit(False))
    return t.withColumn("semantic", F.when(ok, F.coalesce(label, F.lit(ignore))).otherwise(F.lit(ignore)))


def extents(pixels: DataFrame, keys: list[str], row: str, column: str) -> DataFrame:
    """AGG11: area and bounding box (x, y, width, height) of each segment."""
    agg = pixels.groupBy(*keys).agg(F.count("*").alias("area"), F.min(row).alias("y"), F.min(column).alias("x"), F.max(row).alias("_y1"), F.max(column).alias("_x1"))
    return agg.select(*keys, "area", "x", "y", (F.col("_x1") - F.col("x") + 1).alias("width"), (F.col("_y1") - F.col("y") + 1).alias("height"))


def visible(segments: DataFrame, pixels: DataFrame, keys: list[str], row: str, column: str) -> DataFrame:
    """JOIN10: the segments that still have pixels, with what of them is seen."""
    return segments.join(extents(pixels, keys, row, column), keys)


def disagreements(pixels: DataFrame, segments: DataFrame, keys: list[str], *, void: int, number: str = "segment_id", category: str | None = None, classes: tuple[int, ...] = (), capacity: int | None = None) -> DataFrame:
    """JOIN11: what a map and its table do not agree on: (keys, issue); empty for good ones."""
    seen = pixels.filter(F.col(number) != void).select(*keys).distinct()
    ids = segments.select(*keys)
    out = seen.join(ids, keys, "left_anti").withColumn("issue", F.lit("not_in_table"))
    out = out.union(ids.join(seen, keys, "left_anti").withColumn("issue", F.lit("not_in_map")))
    out = out.union(ids.groupBy(*keys).count().filter("count > 1").select(*keys).withColumn("issue", F.lit("duplicate")))
    out = out.union(ids.filter(F.col(number) == void).withColumn("issue", F.lit("void_segment")))
    if category:
        out = out.union(segments.filter(~F.col(category).isin(*classes)).select(*keys).withColumn("issue", F.lit("undeclared_category")))
    if capacity is not None:
        image = [k for k in keys if k != number]
        full = segments.groupBy(*image).count().filter(F.col("count") > capacity)
        out = out.union(full.select(*[F.col(k) if k in image else F.lit(None).cast("long").alias(k) for k in keys]).withColumn("issue", F.lit("over_capacity")))
    return out


def things_with_targets(things: DataFrame, image: str, *, capacity: Column, policy: str, area: str = "area", category: str = "category_id", order: str = "segment_id") -> DataFrame:
    """WIN08: adds ``own``: whether a thing keeps a target of its own when ``capacity`` targets are left.

    The largest are kept, ties in order. Merging also needs a target for each category with things left over; one
    that leaves a single thing keeps it, as that takes its target either way. ``_issue`` where nothing fits.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy is none of {POLICIES}")
    by_area = Window.partitionBy(image).orderBy(F.desc(area), order)
    t = things.withColumn("_rank", F.row_number().over(by_area) - 1).withColumn("_room", capacity)
    everyone, kind = Window.partitionBy(image), Window.partitionBy(image, category)
    t = t.withColumn("_n", F.count("*").over(everyone))
    if policy == "error":
        over = F.col("_n") > F.col("_room")
        return t.withColumn("own", F.lit(True)).withColumn("_issue", F.when(over, F.lit("capacity_exceeded"))).drop("_rank", "_room", "_n")
    if policy == "merge_by_category":
        # keeping k things needs k targets and one for each category whose last thing has rank k or more
        t = t.withColumn("_last", (F.max("_rank").over(kind) == F.col("_rank")).cast("int"))
        earlier = F.sum("_last").over(by_area.rowsBetween(Window.unboundedPreceding, -1))  # a running sum is linear
        t = t.withColumn("_needed", F.col("_rank") + F.sum("_last").over(everyone) - F.coalesce(earlier, F.lit(0)))
        fits = F.sum((F.col("_needed") <= F.col("_room")).cast("int")).over(everyone) + (F.col("_n") <= F.col("_room")).cast("int") - 1
    else:
        fits = F.least(F.col("_n"), F.col("_room"))
    t = t.withColumn("_fits", fits).withColumn("own", F.col("_rank") < F.col("_fits"))
    if policy == "merge_by_category":
        t = t.withColumn("own", F.col("own") | (F.sum((~F.col("own")).cast("int")).over(kind) == 1))
    t = t.withColumn("_issue", F.when(F.col("_fits") < 0, F.lit("capacity_exceeded")))
    return t.drop(*[c for c in ("_rank", "_room", "_n", "_last", "_needed", "_fits") if c in t.columns])


def panoptic_targets(pixels: DataFrame, segments: DataFrame, image: str, *, classes: tuple[int, ...], things: tuple[int, ...], capacity: int, void: int | None = 0, policy: str = "error", valid: str | None = None) -> DataFrame:
    """TGT04: one row a target: image, target, class_id, segment_id (void for stuff and merged), is_thing, pixels.

    Stuff classes that are seen come first, in class order, then things by class and number, then merged rests.
    Crowds, void and invalid pixels give none. Without a number for void (None) every number is a segment's, and null is void.
    """
    keys = [image, "segment_id"]
    seen = pixels.filter("segment_id is not null" if void is None else F.col("segment_id") != void)
    if valid:
        seen = seen.filter(valid)
    counted = seen.groupBy(*keys).agg(F.count("*").alias("area"))
    t = segments.filter("not is_crowd").join(counted, keys)
    place = F.array_position(F.array(*map(F.lit, classes)), F.col("category_id")) - 1
    stuff = t.filter(~F.col("category_id").isin(*things)).groupBy(image, "category_id").agg(F.sum("area").alias("pixels"))
    room = stuff.groupBy(image).agg(F.count("*").alias("_stuff"))
    own = t.filter(F.col("category_id").isin(*things)).join(room, image, "left")
    own = own.withColumn("_at", place)
    own = things_with_targets(own, image, capacity=F.lit(capacity) - F.coalesce("_stuff", F.lit(0)), policy=policy)
    out = stuff.select(image, F.col("category_id").alias("class_id"), F.lit(void).cast("long").alias("segment_id"), F.lit(False).alias("is_thing"), "pixels", F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("_issue"))
    out = out.union(own.filter("own").select(image, "category_id", F.col("segment_id").cast("long"), F.lit(True), "area", F.lit(1), "_issue"))
    if policy == "merge_by_category":
        out = out.union(own.filter("not own").groupBy(image, "category_id").agg(F.sum("area").alias("pixels"), F.max("_issue").alias("_issue")).select(image, "category_id", F.lit(void).cast("long"), F.lit(False), "pixels", F.lit(2), "_issue"))
    out = out.withColumn("_at", F.array_position(F.array(*map(F.lit, classes)), F.col("class_id")))
    target = F.row_number().over(Window.partitionBy(image).orderBy("_kind", "_at", "segment_id")) - 1
    return out.select(image, target.alias("target"), "class_id", "segment_id", "is_thing", "pixels", "_issue")


def gathered(index: DataFrame, raw: DataFrame, *, public: str, number: str, row: str) -> DataFrame:
    """JOIN07: the raw row of each public index."""
    return index.select(public, number).join(raw, index[number] == raw[row]).drop(row)


def index_problems(index: DataFrame, raw_rows: int, *, public: str, number: str) -> DataFrame:
    """JOIN07: why an index map is not one: repeated public or raw numbers, or raw ones out of range."""
    out = index.groupBy(public).count().filter("count > 1").select(F.col(public).cast("long").alias("value"), F.lit("duplicate_public").alias("issue"))
    out = out.union(index.groupBy(number).count().filter("count > 1").select(F.col(number).cast("long"), F.lit("duplicate_raw")))
    bad = F.col(number).isNull() | (F.col(number) < 0) | (F.col(number) >= raw_rows)
    return out.union(index.filter(bad).select(F.col(number).cast("long"), F.lit("out_of_range")))
