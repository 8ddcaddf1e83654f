"""Side-cars: text metadata kept beside the rows, found again by stable numbers (JOIN01-05, SNK14-17, PRJ12, PRJ14).

A side-car is a DataFrame (row_id, identity, metadata), both texts canonical JSON; views add (row_id, view_id,
metadata). Ids and fingerprints follow from the texts, so any process gives a row the same ones.
"""

from __future__ import annotations

import json
import os
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.hashing import fingerprint, stable_hash, view_key

RESERVED = {"row_id", "row_fingerprint", "view_id", "view_fingerprint"}
SCHEMA = "row_id long, identity string, metadata string"
VIEWS = "row_id long, view_id long, metadata string"


class SidecarError(ValueError):
    """A side-car and its rows, or two of its records, do not agree."""


def sorted_json(columns: dict[str, Column]) -> Column:
    """PRJ14: JSON of text, integer and boolean fields by name, nulls kept."""
    pairs = []
    for name in sorted(columns):
        value = F.to_json(F.array(columns[name]))
        pairs.append(F.concat(F.lit(json.dumps(name) + ":"), F.coalesce(F.regexp_replace(value, r"^\[|\]$", ""), F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def identity_of(names: list[str], get) -> tuple[Column, Column]:
    """HASH02: the text that is hashed to a row's id, and the identity as JSON."""
    whole = [n for n in ("dataset", "split", "clip_id") if n in names]
    own = get("example_id") if "example_id" in names else F.lit(None).cast("string")
    if len(whole) == 3:
        there = reduce(lambda a, b: a & b, [get(n).isNotNull() for n in whole])
        return F.when(there, F.concat_ws("::", *[get(n) for n in whole])).otherwise(own.cast("string")), F.when(there, sorted_json({n: get(n) for n in whole})).otherwise(sorted_json({"example_id": own}))
    return own.cast("string"), sorted_json({"example_id": own})


def build(df: DataFrame, metadata: str = "metadata") -> DataFrame:
    """JOIN04: the side-car of a table's metadata struct; equal records are one."""
    kind = df.schema[metadata].dataType
    clash = RESERVED & set(kind.names)
    if clash:
        raise SidecarError(f"reserved names: {sorted(clash)}")
    get = lambda n: F.col(metadata).getField(n)
    text, identity = identity_of(kind.names, get)
    number = "example_id" in kind.names and isinstance(kind["example_id"].dataType, (T.LongType, T.IntegerType)) and not {"dataset", "split", "clip_id"} <= set(kind.names)
    row_id = get("example_id").cast("long") if number else F.when(text.isNotNull(), stable_hash(text))
    return df.select(row_id.alias("row_id"), identity.alias("identity"), sorted_json({n: get(n) for n in kind.names}).alias("metadata")).distinct()


def conflicts(sidecar: DataFrame) -> DataFrame:
    """JOIN04: ids with more than one record, and records without an id."""
    return sidecar.groupBy("row_id").agg(F.count("*").alias("records")).filter("records > 1 or row_id is null")


def assert_consistent(sidecar: DataFrame) -> None:
    bad = conflicts(sidecar).limit(5).collect()
    if bad:
        raise SidecarError(f"conflicting or missing ids: {[r['row_id'] for r in bad]}")


def with_fingerprint(sidecar: DataFrame, name: str = "row_fingerprint") -> DataFrame:
    """JOIN05: SHA-256 of the record and its identity as four numbers."""
    text = F.concat(F.lit('{"identity":'), F.coalesce("identity", F.lit("null")), F.lit(',"metadata":'), F.col("metadata"), F.lit("}"))
    return sidecar.withColumn(name, F.array(*fingerprint(text)))


def attach(df: DataFrame, sidecar: DataFrame, row_id: Column, supplied: dict[str, Column] | None = None) -> DataFrame:
    """JOIN01: adds row_id, row_fingerprint and ``_issue``: unknown id, or a supplied field that differs.

    Only supplied fields are compared; the side-car may hold more. Errors are rows, so that one deterministic one
    is raised on the driver (see ``raise_first``).
    """
    known = with_fingerprint(sidecar).select(F.col("row_id").alias("_id"), F.col("metadata").alias("_record"), "row_fingerprint")
    t = df.withColumn("row_id", row_id).join(known, F.col("row_id") == F.col("_id"), "left")
    issue = F.when(F.col("_id").isNull(), F.concat(F.lit("unknown_id: "), F.coalesce(F.col("row_id").cast("string"), F.lit("null"))))
    for name, value in (supplied or {}).items():
        issue = issue.when(~F.get_json_object("_record", f"$.{name}").eqNullSafe(value.cast("string")), F.concat(F.lit(f"field_differs: {name} of "), F.col("row_id").cast("string")))
    return t.withColumn("_issue", issue).drop("_id", "_record")


def raise_first(df: DataFrame, order: str) -> DataFrame:
    """The rows without ``_issue``; the issue of the least ``order`` is raised if there is any."""
    bad = df.filter("_issue is not null").agg(F.min_by("_issue", order).alias("issue")).first()["issue"]
    if bad is not None:
        raise SidecarError(bad)
    return df.drop("_issue")


def view_ids(df: DataFrame, dynamic: dict[str, Column], some_text: Column | None = None) -> DataFrame:
    """JOIN02: adds view_id and view_json of what a stage added or changed; 0 and null where it holds no text."""
    text = sorted_json(dynamic)
    wanted = some_text if some_text is not None else F.lit(True)
    return df.withColumn("view_json", F.when(wanted, text)).withColumn("view_id", F.when(wanted, view_key(text)).otherwise(F.lit(0)).cast("long"))


def views_of(df: DataFrame) -> DataFrame:
    """JOIN02: (row_id, view_id, metadata) of the rows that have a view."""
    return df.filter("view_id <> 0").select("row_id", "view_id", F.col("view_json").alias("metadata")).distinct()


def unverified(df: DataFrame, sidecar: DataFrame, views: DataFrame | None = None) -> DataFrame:
    """JOIN03: rows whose id, fingerprint or view the side-car does not hold; should be empty."""
    known = with_fingerprint(sidecar).select("row_id", F.col("row_fingerprint").alias("_f"))
    bad = df.join(known, "row_id", "left").filter(~F.coalesce(F.col("_f") == F.col("row_fingerprint"), F.lit(False))).drop("_f")
    if views is not None:
        lost = df.filter("view_id <> 0").join(views, ["row_id", "view_id"], "left_anti")
        bad = bad.unionByName(lost, allowMissingColumns=True)
    return bad


def orphans(sidecar: DataFrame, views: DataFrame) -> DataFrame:
    """SNK15: views of unknown rows."""
    return views.join(sidecar, "row_id", "left_anti")


def digest(sidecar: DataFrame) -> Column:
    """SNK16, as an aggregate: equal for equal side-cars whatever their order.

    Digests of records are added up, so that no task holds all of them.
    """
    parts = [F.conv(F.substring(F.sha2(F.concat_ws("\u0001", F.col("row_id").cast("string"), "identity", "metadata"), 256), 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)") for k in range(8)]
    return F.sha2(F.concat_ws(":", *[(F.sum(p) % 4294967296).cast("string") for p in parts]), 256)


def lines(sidecar: DataFrame, views: DataFrame | None = None) -> DataFrame:
    """SNK14: JSON lines by id, then view; ``row_id`` and ``view_id`` give the order."""
    own = sidecar.select("row_id", F.lit(0).cast("long").alias("view_id"), F.concat(F.lit('{"id":'), F.col("row_id").cast("string"), F.lit(',"identity":'), F.coalesce("identity", F.lit("null")), F.lit(',"metadata":'), F.col("metadata"), F.lit("}")).alias("line"))
    if views is None:
        return own
    more = views.select("row_id", "view_id", F.concat(F.lit('{"id":'), F.col("row_id").cast("string"), F.lit(',"metadata":'), F.col("metadata"), F.lit(',"view":'), F.col("view_id").cast("string"), F.lit("}")).alias("line"))
    return own.union(more)


def read_lines(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """SNK15: side-car and views; blank lines are skipped, views of unknown rows are an error."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    get = lambda k: F.get_json_object("value", f"$.{k}")
    t = raw.select(get("id").cast("long").alias("row_id"), get("view").cast("long").alias("view_id"), get("identity").alias("identity"), get("metadata").alias("metadata"))
    sidecar, views = t.filter("view_id is null").select("row_id", "identity", "metadata"), t.filter("view_id is not null").select("row_id", "view_id", "metadata")
    if not orphans(sidecar, views).isEmpty():
        raise SidecarError("a view of an unknown row")
    return sidecar, views


def write_lines(sidecar: DataFrame, path: str, *, policy: str = "resume", views: DataFrame | None = None) -> bool:
    """SNK14: one local file, replaced at once; False where it is already the same.

    ``create`` refuses an existing file, ``overwrite`` replaces it, ``resume`` adds to it unless records conflict.
    For a side-car too large for one file write ``lines`` as text with any number of files.
    """
    if policy not in ("resume", "create", "overwrite"):
        raise ValueError("policy must be resume, create or overwrite")
    there = os.path.exists(path)
    if there and policy == "create":
        raise FileExistsError(path)
    if there and policy == "resume":
        old, old_views = read_lines(sidecar.sparkSession, path)
        sidecar, views = sidecar.union(old).distinct(), (views.union(old_views) if views is not None else old_views).distinct()
    assert_consistent(sidecar)
    if views is not None and not views.groupBy("row_id", "view_id").count().filter("count > 1").isEmpty():
        raise SidecarError("conflicting views")
    ordered = lines(sidecar, views).orderBy("row_id", "view_id").select("line")
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as out:
        for row in ordered.toLocalIterator(prefetchPartitions=True):
            out.write(row["line"] + "\n")
        out.flush()
        os.fsync(out.fileno())
    if there and open(path, encoding="utf-8").read() == open(out.name, encoding="utf-8").read():
        os.unlink(out.name)
        return False
    os.replace(out.name, path)
    return True


def with_record_id(df: DataFrame, record_id: str) -> DataFrame:
    """PRJ12: sets metadata.example_id to the record's id; ``_issue`` where another one was given."""
    given = F.col("metadata").getField("example_id") if "example_id" in df.schema["metadata"].dataType.names else F.lit(None).cast("string")
    issue = F.when(given.isNotNull() & (given.cast("string") != F.col(record_id)), F.concat(F.lit("identity_conflict: "), F.col(record_id)))
    return df.withColumn("_issue", issue).withColumn("metadata", F.col("metadata").withField("example_id", F.col(record_id)))
