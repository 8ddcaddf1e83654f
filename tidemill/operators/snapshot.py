"""Admitted snapshots and protected caches: Parquet with a manifest that is published last (SNK01-13).

Validation gives issues as rows, and the driver raises the one of the first record, so an error code and its record
do not depend on how tasks were run. A folder without its manifest is not a snapshot.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.hashing import canonical_json, digest_of
from tidemill.operators import storage
from tidemill.operators.positions import POS

CACHE_STATES = ("missing", "incomplete", "corrupt", "complete")


class AdmissionError(ValueError):
    """SNK03: a record was refused; ``code`` and ``record_id`` tell why and which."""

    def __init__(self, code: str, record_id: str | None = None, detail: str = ""):
        super().__init__(f"{code}: {record_id or '-'} {detail}".rstrip())
        self.code, self.record_id, self.detail = code, record_id, detail


class CacheError(ValueError):
    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}")
        self.code = code


@dataclass(frozen=True)
class Source:
    """SNK03: a named source: its records (record_id, split, path, sha256, metadata), how they are read and checked.

    ``adapt``: DataFrame -> DataFrame on (record_id, split, content, metadata). ``validate``: a Column, true for good
    rows of what ``adapt`` returns.
    """

    name: str
    records: DataFrame
    splits: tuple[str, ...]
    adapt: object = None
    validate: Column | None = None


@dataclass(frozen=True)
class Admitted:
    """SNK03: an open snapshot."""

    path: str
    data: DataFrame
    manifest: dict = field(repr=False)

    @property
    def digest(self) -> str:
        return self.manifest["digest"]


def preflight(sources: list[Source], requested: dict[str, tuple[str, ...]]) -> DataFrame | None:
    """SNK02: checks declarations (raises) and records: rows (source, record_id, issue), empty if all is well."""
    names = [s.name for s in sources]
    if len(set(names)) != len(names):
        raise AdmissionError("invalid_declaration", detail="a source is declared twice")
    for name in requested:
        if name not in names:
            raise AdmissionError("missing_source", detail=name)
    out, every = None, None
    for s in sources:
        wanted = requested.get(s.name, ())
        if len(set(wanted)) != len(wanted):
            raise AdmissionError("invalid_splits", detail=s.name)
        if set(wanted) - set(s.splits):
            raise AdmissionError("missing_split", detail=f"{s.name}: {sorted(set(wanted) - set(s.splits))}")
        rows = s.records.filter(F.col("split").isin(*wanted) if wanted else F.lit(False)).select(F.lit(s.name).alias("source"), "record_id", "split", "path", "sha256")
        bad = rows.filter((F.coalesce("record_id", F.lit("")) == "") | F.col("path").isNull() | ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)))
        bad = bad.select("source", "record_id", F.lit("invalid_record").alias("issue"))
        out = bad if out is None else out.union(bad)
        every = rows if every is None else every.union(rows)
    if every is None:
        return None
    twice = every.groupBy("record_id").agg(F.min("source").alias("source"), F.count("*").alias("n")).filter("n > 1")
    return out.union(twice.select("source", "record_id", F.lit("duplicate_id").alias("issue")))


def reconciliation(report: DataFrame) -> DataFrame:
    """SNK04: for (record_id, disposition): what does not add up, as (record_id, issue)."""
    odd = report.filter(~F.coalesce(F.col("disposition").isin("retained", "excluded"), F.lit(False))).select("record_id", F.lit("unknown_disposition").alias("issue"))
    return odd.union(report.groupBy("record_id").count().filter("count > 1").select("record_id", F.lit("duplicate_id")))


def misplaced(data: DataFrame, report: DataFrame, position: str = POS) -> DataFrame:
    """SNK05: positions where the rows and the retained records of the report differ."""
    a = data.select(F.col(position).alias("p"), F.col("record_id").alias("a"))
    b = report.filter("disposition = 'retained'").select(F.col(position).alias("p"), F.col("record_id").alias("b"))
    return a.join(b, "p", "full").filter(~F.col("a").eqNullSafe(F.col("b")))


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    """SNK13: SHA-256 of a row's JSON, fields by name."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def table_digest(df: DataFrame, columns: list[str]) -> str:
    """Equal for equal rows in any order: sums of row digests."""
    d = row_digest(df, columns)
    parts = [F.sum(F.conv(F.substring(d, 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")) for k in range(8)]
    return digest_of([str(x) for x in df.agg(*[p.alias(f"p{k}") for k, p in enumerate(parts)]).first()])


def schema_problems(df: DataFrame, wanted) -> list[str]:
    """SNK08: fields whose type is not exactly the declared one; no casts are made."""
    have = {f.name: f.dataType for f in df.schema.fields}
    out = [f"{f.name}: {have.get(f.name)} is not {f.dataType}" for f in wanted.fields if have.get(f.name) != f.dataType]
    return out + [f"{name}: not declared" for name in have if name not in wanted.names]


def admit(spark, sources: list[Source], requested: dict[str, tuple[str, ...]], *, inventory_id: str, path: str, schema, selection: tuple[str, Column] | None = None) -> Admitted:
    """SNK01: read, check and store the requested records, or store nothing and raise for the first bad one.

    Codes: those of ``preflight``, asset_missing, digest_mismatch, schema_mismatch, validation_failed,
    selection_failed. Assets are read by Spark, so any store that it reads will do.
    """
    if storage.exists(path):
        raise AdmissionError("path_exists", detail=path)
    issues = preflight(sources, requested)
    if issues is not None and (bad := issues.orderBy("source", "record_id", "issue").first()):
        raise AdmissionError(bad["issue"], bad["record_id"], bad["source"])
    parts = []
    for order, s in enumerate(sources):
        wanted = requested.get(s.name, ())
        if not wanted:
            continue
        rank = F.array_position(F.array(*map(F.lit, wanted)), F.col("split"))
        rows = s.records.filter(F.col("split").isin(*wanted)).withColumn("_source", F.lit(order)).withColumn("_split", rank)
        # folders, not files, are listed on the driver
        folders = [r[0] for r in rows.select(F.regexp_replace("path", "/[^/]*$", "")).distinct().collect()]
        there = sorted(f for f in folders if storage.exists(f))
        if not folders:
            continue
        if not there:
            raise AdmissionError("asset_missing", rows.orderBy("_split", "record_id").first()["record_id"], s.name)
        files = spark.read.format("binaryFile").load(there)
        files = files.select(F.regexp_replace("path", "^file:(//)?", "").alias("_path"), "content")
        rows = rows.join(files, F.col("path") == F.col("_path"), "left").drop("_path")
        issue = F.when(F.col("content").isNull(), "asset_missing").when(F.sha2("content", 256) != F.col("sha256"), "digest_mismatch")
        rows = rows.withColumn("_issue", issue)
        if bad := rows.filter("_issue is not null").orderBy("_split", "record_id").select("_issue", "record_id").first():
            raise AdmissionError(bad["_issue"], bad["record_id"], s.name)
        got = s.adapt(rows) if s.adapt else rows
        keep = [f.name for f in schema.fields]
        if wrong := schema_problems(got.select(*[c for c in got.columns if c in keep]), schema):
            raise AdmissionError("schema_mismatch", detail="; ".join(wrong))
        if s.validate is not None and (bad := got.filter(~F.coalesce(s.validate, F.lit(False))).orderBy("_split", "record_id").first()):
            raise AdmissionError("validation_failed", bad["record_id"], s.name)
        parts.append(got.select("_source", "_split", "record_id", "split", *[c for c in keep if c not in ("record_id", "split")]))
    if not parts:
        raise AdmissionError("invalid_splits", detail="nothing was requested")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    keep = F.lit(True)
    if selection:
        keep = selection[1]
        if bad := rows.filter(keep.isNull()).orderBy("_source", "_split", "record_id").first():
            raise AdmissionError("selection_failed", bad["record_id"], selection[0])
    from tidemill.operators.positions import enumerate_rows

    try:
        enumerate_rows(rows.withColumn("_keep", keep), "_source", "_split", "record_id").write.parquet(f"{path}/admitted")
        rows = spark.read.parquet(f"{path}/admitted")
        asked = sum(s.records.filter(F.col("split").isin(*requested[s.name])).count() for s in sources if requested.get(s.name))
        if rows.count() != asked:
            raise AdmissionError("reconciliation_failed", detail=f"{asked} records were asked for")
        report = rows.select(POS, "record_id", "split", "_source", F.when(F.col("_keep"), "retained").otherwise("excluded").alias("disposition"))
        report.write.parquet(f"{path}/report")
        rows.filter("_keep").drop("_keep", "_source", "_split").write.parquet(f"{path}/data")
        data, report = spark.read.parquet(f"{path}/data"), spark.read.parquet(f"{path}/report")
        if not reconciliation(report).isEmpty() or not misplaced(data, report).isEmpty():
            raise AdmissionError("reconciliation_failed")
        counts = {r["disposition"]: r["n"] for r in report.groupBy("disposition").agg(F.count("*").alias("n")).collect()}
        body = {"inventory": inventory_id, "schema": json.loads(schema.json()), "retained": counts.get("retained", 0), "excluded": counts.get("excluded", 0), "selection": selection[0] if selection else None, "rows": table_digest(data, data.columns), "report": table_digest(report, report.columns)}
        storage.remove(f"{path}/admitted")
        publish(path, body | {"digest": digest_of(body)})
    except BaseException:
        storage.remove(path)
        raise
    return open_snapshot(spark, path)


def publish(path: str, manifest: dict) -> None:
    """The manifest under its final name, at once."""
    storage.write_text(f"{path}/manifest.json", canonical_json(manifest))


def open_snapshot(spark, path: str) -> Admitted:
    """SNK06: check the manifest, the digests, the report and the rows; no source is needed."""
    try:
        manifest = json.loads(storage.read_text(f"{path}/manifest.json"))
    except storage.Damaged as e:
        raise AdmissionError("corrupt", detail=str(e)) from None
    except (OSError, ValueError) as e:
        raise AdmissionError("incomplete", detail=str(e)) from None
    body = {k: v for k, v in manifest.items() if k != "digest"}
    if digest_of(body) != manifest.get("digest"):
        raise AdmissionError("corrupt", detail="manifest")
    data, report = spark.read.parquet(f"{path}/data"), spark.read.parquet(f"{path}/report")
    if table_digest(data, data.columns) != body["rows"] or table_digest(report, report.columns) != body["report"]:
        raise AdmissionError("corrupt", detail="rows")
    if not misplaced(data, report).isEmpty():
        raise AdmissionError("corrupt", detail="order")
    return Admitted(path, data, manifest)


@dataclass(frozen=True)
class CachePolicy:
    """SNK09: what a cache may take."""

    most_rows: int | None = None
    most_bytes: int | None = None


def fingerprint(**parts) -> str:
    """SNK12: of everything that decides a cache's content."""
    return digest_of(parts)


def inspect_cache(path: str) -> str:
    """SNK10: missing, incomplete, corrupt or complete, from its files alone."""
    if not storage.exists(path):
        return "missing"
    if not storage.exists(f"{path}/manifest.json"):
        return "incomplete"
    try:
        manifest = json.loads(storage.read_text(f"{path}/manifest.json"))
        return "complete" if _digests(path) == manifest["files"] else "corrupt"
    except (ValueError, KeyError, PySparkException, Py4JError):  # a store that keeps check sums refuses to read a changed file
        return "corrupt"


def _digests(path: str) -> dict[str, str]:
    return {name: digest for name, (digest, _) in storage.data_files(f"{path}/data").items()}


def protected_cache(df: DataFrame, path: str, *, stage: str, policy: CachePolicy, fingerprint: str) -> DataFrame:
    """SNK09: the rows from a complete cache of the same fingerprint, else stored and read again.

    Codes: incompatible, corrupt, incomplete, quota_exceeded.
    """
    spark, state = df.sparkSession, inspect_cache(path)
    if state == "complete":
        manifest = json.loads(storage.read_text(f"{path}/manifest.json"))
        if manifest["fingerprint"] != fingerprint or manifest["stage"] != stage or manifest["schema"] != df.schema.jsonValue():
            raise CacheError("incompatible", path)
        return spark.read.schema(df.schema).parquet(f"{path}/data")
    if state != "missing":
        raise CacheError(state, path)
    storage.make_folder(path)
    rows = df if policy.most_rows is None else df.limit(policy.most_rows + 1)
    rows.write.parquet(f"{path}/data")
    stored = spark.read.schema(df.schema).parquet(f"{path}/data")
    n, kept = stored.count(), storage.data_files(f"{path}/data")
    size = sum(length for _, length in kept.values())
    over = policy.most_rows is not None and n > policy.most_rows or policy.most_bytes is not None and size > policy.most_bytes
    if over:
        storage.write_text(f"{path}/failure.json", canonical_json({"code": "quota_exceeded", "rows": n, "bytes": size, "policy": asdict(policy)}))
        raise CacheError("quota_exceeded", f"{n} rows, {size} bytes")
    publish(path, {"fingerprint": fingerprint, "stage": stage, "schema": df.schema.jsonValue(), "rows": n, "bytes": size, "files": {name: digest for name, (digest, _) in kept.items()}})
    return stored
