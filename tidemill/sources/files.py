"""Files as tables: WAV and image folders, checked archives, dense views (ARR01, SRC13-17, SRC20, WILDS specs SRC18)."""

from __future__ import annotations

import hashlib
import os
import shutil
import tarfile
import tempfile
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.strings import archive_stem, source_name, yes_or_no
from tidemill.kernels import images, signal

IMAGE_SUFFIXES = ("bmp", "gif", "jpeg", "jpg", "png", "webp")
#: What an archive may hold.
MOST_MEMBERS, MOST_BYTES = 100_000, 100 << 30


def wav_columns(content: Column) -> Column:
    """ARR01: waveform (channels interleaved), channels and sample_rate of WAV bytes."""

    def run(raw: pd.Series) -> pd.DataFrame:
        rows = [signal.decode_wav(b) if b is not None else (None, None) for b in raw]
        return pd.DataFrame({"waveform": [None if x is None else x.reshape(-1) for x, _ in rows], "channels": [None if x is None else x.shape[1] for x, _ in rows], "sample_rate": [r for _, r in rows]})

    run.__annotations__ = {"raw": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "waveform array<float>, channels int, sample_rate int")(content)


def wav_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, waveform, channels, sample_rate of every WAV file below a folder."""
    raw = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.wav").load(folder)
    return raw.select("path", wav_columns(F.col("content")).alias("w")).select("path", "w.*")


def image_folder(spark: SparkSession, root: str, split: str, *, content: bool = True) -> DataFrame:
    """SRC13: root/split/class/file -> path, class_name, label, example_id (and content), labels by class name.

    The vocabulary is that of all splits, so a class has one number everywhere. Hidden folders are skipped.
    """
    paths = spark.read.format("binaryFile").options(recursiveFileLookup=True).load(root).select("path", *(["content"] if content else []))
    base = root.rstrip("/").removeprefix("file:").lstrip("/")
    tail = F.regexp_replace(F.regexp_replace("path", "^file:/*", ""), f"^{base}/", "")
    t = paths.withColumn("_parts", F.split(tail, "/"))
    t = t.filter((F.size("_parts") >= 3) & ~F.exists("_parts", lambda p: p.startswith(".")) & F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*IMAGE_SUFFIXES))
    t = t.withColumn("class_name", F.get("_parts", F.lit(1)))
    names = [r[0] for r in t.select("class_name").distinct().orderBy("class_name").collect()]  # as many as classes
    out = t.filter(F.get("_parts", F.lit(0)) == split)
    label = F.array_position(F.array(*map(F.lit, names)), F.col("class_name")) - 1 if names else F.lit(None).cast("long")
    if out.isEmpty():
        raise ValueError(f"split {split!r} of {root} holds no image")
    return out.select("path", *(["content"] if content else []), "class_name", label.cast("long").alias("label"), F.array_join(F.slice("_parts", 2, 1000), "/").alias("example_id"))


def file_matches(path: str, checksum: str) -> bool:
    """SRC16: ``algorithm:hex``, or MD5 without an algorithm."""
    kind, _, value = checksum.rpartition(":")
    with open(path, "rb") as f:
        return hashlib.file_digest(f, kind or "md5").hexdigest() == value.lower()


def _safe(name: str) -> bool:
    parts = name.split("/")
    return bool(name) and not name.startswith("/") and "\\" not in name and ".." not in parts and not (len(name) > 1 and name[1] == ":")


def extract(archive: str, target: str, *, most_members: int = MOST_MEMBERS, most_bytes: int = MOST_BYTES) -> str:
    """SRC15: a ZIP or TAR into a new folder, at once or not at all.

    Refused: names that leave the folder, links and special files, a name twice, too many members or bytes.
    """
    parent = os.path.dirname(os.path.abspath(target))
    os.makedirs(parent, exist_ok=True)
    seen, size = set(), 0

    def admit(name: str, n: int) -> None:
        nonlocal size
        if not _safe(name.rstrip("/")):
            raise ValueError(f"unsafe member {name!r}")
        if name in seen:
            raise ValueError(f"member {name!r} is there twice")
        seen.add(name)
        size += n
        if len(seen) > most_members or size > most_bytes or size > shutil.disk_usage(parent).free:
            raise ValueError("the archive is too large")

    work = tempfile.mkdtemp(dir=parent)
    try:
        if zipfile.is_zipfile(archive):
            with zipfile.ZipFile(archive) as z:
                for m in z.infolist():
                    if (m.external_attr >> 16) & 0o170000 not in (0, 0o100000, 0o040000):
                        raise ValueError(f"{m.filename!r} is no plain file")
                    admit(m.filename, m.file_size)
                z.extractall(work)
        else:
            with tarfile.open(archive) as t:
                for m in t.getmembers():
                    if not (m.isfile() or m.isdir()):
                        raise ValueError(f"{m.name!r} is no plain file")
                    admit(m.name, m.size)
                t.extractall(work, filter="data")
        if os.path.exists(target):
            raise FileExistsError(target)
        os.replace(work, target)
    except BaseException:
        shutil.rmtree(work, ignore_errors=True)
        raise
    return target


def archive_source(spark: SparkSession, archive: str, checksum: str, folder: str, split: str) -> DataFrame:
    """SRC14, without the network: a file that is there already, checked, unpacked once, scanned."""
    if not file_matches(archive, checksum):
        raise ValueError(f"{archive} does not have the checksum {checksum}")
    stem = spark.range(1).select(archive_stem(F.lit(os.path.basename(archive)))).first()[0]
    target = f"{folder}/{stem}"
    if not os.path.isdir(target):
        extract(archive, target)
    return image_folder(spark, target, split)


WILDS = ("camelyon17", "fmow", "iwildcam", "rxrx1")
WILDS_OPTIONS = ("split_scheme", "version", "download", "unlabeled", "source_metadata")


def wilds_spec(spec: str) -> tuple[str, dict]:
    """SRC18: dataset and options of ``wilds:name?option=value``."""
    name, options = source_name(spec, "wilds", WILDS_OPTIONS)
    if name not in WILDS:
        raise ValueError(f"{name!r} is none of {WILDS}")
    return name, {k: yes_or_no(v) if k in ("download", "unlabeled", "source_metadata") else v for k, v in options.items()}


def wilds_table(spark: SparkSession, spec: str, splits: list[str], data_dir: str | None) -> list[DataFrame]:
    """SRC18: from Parquet that stands in for the package; labelled and unlabelled splits don't mix."""
    name, _ = wilds_spec(spec)
    kinds = {s.endswith("_unlabeled") for s in splits}
    if len(kinds) > 1:
        raise ValueError("labelled and unlabelled splits cannot be mixed")
    path = f"{data_dir}/{name}.parquet"
    if not os.path.exists(path):
        raise ImportError(f"the wilds package is not installed, and {path} is not there")
    df = spark.read.parquet(path)
    return [df.filter(F.col("split") == s) for s in splits]


def dense_views(spark: SparkSession, pairs: DataFrame, record: Column, *, depth: int = 8) -> DataFrame:
    """SRC20: (position, image, mask paths) -> the replayed view of each, in the order of ``position``.

    ``record``: the geometry struct of each pair. Pixels come flat, with the view's height and width.
    """
    files = spark.read.format("binaryFile")
    every = pairs.withColumn("record", record)
    load = lambda c: files.load([r[0] for r in pairs.select(c).distinct().toLocalIterator()]).select(F.regexp_replace("path", "^file:(//)?", "").alias(c), F.col("content").alias(f"{c}_content"))
    every = every.join(load("image"), "image").join(load("mask"), "mask")

    def run(pdfs):
        for pdf in pdfs:
            rows = []
            for r in pdf.itertuples():
                rec = r.record if isinstance(r.record, dict) else r.record.asDict(recursive=True)
                v = images.replay(images.as_rgb(images.decode_png(r.image_content)), rec, images.decode_mask(r.mask_content, depth))
                rows.append((r.position, *v["image"].shape[:2], v["image"].reshape(-1).astype("float64"), v["mask"].reshape(-1).astype("int64"), v["pixel_valid_mask"].reshape(-1)))
            yield pd.DataFrame(rows, columns=["position", "height", "width", "image", "mask", "valid"])

    return every.select("position", "record", "image_content", "mask_content").mapInPandas(run, "position long, height int, width int, image array<double>, mask array<long>, valid array<boolean>")
