"""Audio manifests as tables: local and scene-recording ones, adapters to canonical columns (SRC07-12, PRJ02-05, PRJ10, PRJ11)."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import strings as S
from tidemill.functions.hashing import stable_hash

REQUIRED = ("path", "label", "split", "clip_id", "source_id", "start_time", "end_time")
#: Where a scene manifest is looked for, in this order.
SCENE_FILES = ("manifest.csv", "metadata.csv", "dcase2025_task1.csv", "manifest.tsv", "metadata.tsv", "manifest.jsonl", "metadata.jsonl")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC08: CSV, TSV or JSON lines; every value as text, nulls as empty text."""
    low = path.lower()
    if low.endswith((".jsonl", ".json")):
        raw = spark.read.option("primitivesAsString", True).json(path)
        df = raw.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in raw.columns if c != "_corrupt_record"])
    else:
        sep = "\t" if low.endswith((".tsv", ".tab")) else ","
        df = spark.read.options(header=True, sep=sep, escape='"', multiLine=True, inferSchema=False).csv(path)
    return df.na.fill("")


def all_ints(df: DataFrame, column: str) -> bool:
    """SRC07: whether every label is a whole number; decides the label's type for the whole source."""
    return bool(df.agg(F.coalesce(F.bool_and(S.looks_int(F.col(column))), F.lit(True)).alias("x")).first()["x"])


def absolute(path: Column, folder: str, data_dir: str | None) -> Column:
    """SRC07: absolute paths as they are, others below the data folder, or beside the manifest without one."""
    return F.when(path.startswith("/") | path.contains("://"), path).otherwise(F.concat(F.lit((data_dir or folder).rstrip("/") + "/"), path))


def local_audio(spark: SparkSession, manifest: str, split: str, data_dir: str | None = None, dataset: str = "local_audio") -> DataFrame:
    """SRC07, SRC09: the records of one split in ten typed columns."""
    m = read_manifest(spark, manifest)
    missing = [c for c in REQUIRED if c not in m.columns]
    if missing:
        raise ValueError(f"{manifest} lacks {missing}")
    m = m.filter(F.col("split") == split)
    get = lambda *names: S.first_filled(*[F.col(n) for n in names if n in m.columns])
    label = F.regexp_replace(F.trim("label"), "_", "").cast("long") if all_ints(m, "label") else F.col("label")
    path = absolute(F.col("path"), os.path.dirname(manifest), data_dir)
    return m.select(
        path.alias("path"),
        label.alias("label"),
        "split",
        "clip_id",
        "source_id",
        S.float_or(F.col("start_time")).alias("start_time"),
        S.float_or(F.col("end_time")).alias("end_time"),
        F.coalesce(F.nullif(get("dataset"), F.lit("")), F.lit(dataset)).alias("dataset"),
        get("example_id", "clip_id").alias("example_id"),
        F.coalesce(F.nullif(get("filename"), F.lit("")), S.basename(F.col("path"))).alias("filename"),
    )


def scene_manifest_path(folder: str) -> str:
    """SRC10"""
    for name in SCENE_FILES:
        if os.path.exists(f"{folder}/{name}"):
            return f"{folder}/{name}"
    raise FileNotFoundError(f"no scene manifest in {folder}: {', '.join(SCENE_FILES)}")


def scene_records(m: DataFrame, split: str) -> DataFrame:
    """SRC10, PRJ05: the split's rows with what is stated or can be read from file names."""
    get = lambda *names: S.first_present(m.columns, *names)
    own = F.coalesce(get("split", "subset", "partition"), F.lit(split))
    t = m.select("*", own.alias("_split")).filter(F.col("_split") == split)
    name = S.posix_name(F.coalesce(get("filename", "file", "audio_filename"), get("path", "audio_path", "filepath", "file_path")))
    t = t.withColumn("_name", name)
    n = F.col("_name")
    label = F.coalesce(get("scene_label", "scene", "scene_name", "class_name"), get("label", "target"))
    t = t.withColumn("scene_label", S.scene(label, n)).withColumn("device", S.device(get("device", "device_id", "recording_device", "source_device", "domain"), n, F.col("_split")))
    scene, segment = F.col("scene_label"), F.coalesce(get("segment_id", "segment", "clip_id"), S.segment_in_name(n))
    return t.select(
        F.coalesce(get("path", "audio_path", "filepath", "file_path"), n).alias("path"),
        F.col("_split").alias("split"),
        F.coalesce(scene, F.lit("")).alias("scene_label"),
        S.scene_id(scene).alias("label"),
        "device",
        S.device_type(F.col("device")).alias("device_type"),
        S.is_training_device(F.col("device")).alias("is_known_device"),
        F.coalesce(get("city", "recording_city", "location_city"), S.city_in_name(n, scene), F.lit("")).alias("city"),
        F.coalesce(get("location_id", "location", "recording_location"), S.location_in_name(n, scene), F.lit("")).alias("location_id"),
        F.coalesce(segment, F.lit("")).alias("segment_id"),
        F.coalesce(get("source_recording_id", "original_recording_id", "recording_id", "source_id"), S.recording_in_name(n, segment), F.lit("")).alias("source_recording_id"),
        n.alias("filename"),
    )


def load_scenes(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """SRC10"""
    return scene_records(read_manifest(spark, scene_manifest_path(folder)), split)


def audio_table(df: DataFrame, *, audio: str = "audio", label: str = "label", mode: str = "native") -> DataFrame:
    """SRC11: a table with an audio struct (bytes, path, array, sampling_rate) -> waveform, sample_rate, label.

    ``native`` takes the decoded array; ``own`` decodes the bytes as WAV.
    """
    for c in (audio, label):
        if c not in df.columns:
            raise ValueError(f"no column {c!r}")
    names = df.schema[audio].dataType.names
    if mode == "native":
        if not {"array", "sampling_rate"} <= set(names):
            raise ValueError("the audio struct holds no decoded array")
        return df.select(F.col(audio)["array"].cast("array<float>").alias("waveform"), F.col(audio)["sampling_rate"].cast("int").alias("sample_rate"), F.col(label).alias("label"))
    from tidemill.sources.files import wav_columns

    t = df.withColumn("_wav", wav_columns(F.col(audio)["bytes"]))
    return t.select(F.col("_wav.waveform").alias("waveform"), F.col("_wav.sample_rate").alias("sample_rate"), F.col(label).alias("label"))


def image_table(df: DataFrame, *, dataset: str, split: str, metadata: bool = False) -> DataFrame:
    """SRC12: image and label, on demand with dataset, split and the running number as example_id."""
    for c in ("image", "label"):
        if c not in df.columns:
            raise ValueError(f"no column {c!r}")
    if not metadata:
        return df.select("image", "label")
    from tidemill.operators.positions import enumerate_rows

    t = enumerate_rows(df.withColumn("_id", F.monotonically_increasing_id()), "_id", name="_n")
    return t.select("image", "label", F.struct(F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), F.col("_n").cast("string").alias("example_id")).alias("metadata"))


def canonical(df: DataFrame, *, dataset: str | None = None, default_rate: int | None = None) -> DataFrame:
    """PRJ02-04: waveform, sample_rate, label and a metadata struct; missing ids and names come from what is there."""
    have = lambda *names: F.coalesce(*[F.col(n) for n in names if n in df.columns] or [F.lit(None)])
    rate = F.coalesce(have("sample_rate", "sampling_rate").cast("int"), F.lit(default_rate).cast("int"))
    fields = {
        "dataset": F.coalesce(have("dataset").cast("string"), F.lit(dataset)),
        "split": have("split").cast("string"),
        "example_id": have("example_id", "clip_id").cast("string"),
        "filename": F.coalesce(have("filename").cast("string"), S.basename(have("path").cast("string"))),
        "path": have("path").cast("string"),
        "clip_id": have("clip_id").cast("string"),
        "source_id": have("source_id").cast("string"),
    }
    if "waveform" in df.columns:
        fields["duration"] = F.size("waveform") / rate
    meta = F.struct(*[v.alias(k) for k, v in fields.items()])
    keep = [c for c in ("waveform", "path", "label") if c in df.columns]
    return df.select(*keep, rate.alias("sample_rate"), meta.alias("metadata"))


def with_hard_label(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """PRJ11: metadata.hard_label and, with names, metadata.class_name."""
    meta = F.col("metadata").withField("hard_label", F.col("label").cast("long"))
    if names:
        meta = meta.withField("class_name", F.get(F.array(*map(F.lit, names)), F.col("label").cast("int")))
    return df.withColumn("metadata", meta)


def with_corruption(df: DataFrame, name: str, version: str, identity: str, severity: int, domain: str = "image") -> DataFrame:
    """PRJ10"""
    meta = F.col("metadata")
    for key, value in (("corruption", F.lit(name)), ("corruption_version", F.lit(version)), ("corruption_identity", F.lit(identity)), ("corruption_identity_hash", stable_hash(F.lit(identity))), ("corruption_severity", F.lit(severity)), ("corruption_domain", F.lit(domain))):
        meta = meta.withField(key, value)
    return df.withColumn("metadata", meta)
