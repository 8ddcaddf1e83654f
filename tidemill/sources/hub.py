"""Datasets on disk as their hub lays them out: Parquet files of each split (SRC11, SRC12), and WILDS by name (SRC18)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.strings import source_name, yes_or_no
from tidemill.sources.files import wilds_table
from tidemill.sources.manifests import audio_table, image_table
from tidemill.sources.registry import register_source

AUDIO_OPTIONS, IMAGE_OPTIONS = ("decode", "audio", "label"), ("metadata",)


def split_files(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """The files ``split-*.parquet`` anywhere below the folder, else those in its folder ``split``."""
    reader = spark.read.option("recursiveFileLookup", True)
    try:
        return reader.option("pathGlobFilter", f"{split}-*.parquet").parquet(folder)
    except AnalysisException:  # no such file
        return spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/{split}")


def hub_audio(spark: SparkSession, name: str, splits: list[str], data_dir: str | None) -> list[DataFrame]:
    """SRC11: ``hf_audio:dataset?decode=native|own&audio=column&label=column`` below ``data_dir``."""
    dataset, options = source_name(name, "hf_audio", AUDIO_OPTIONS)
    more = {"audio": options.get("audio", "audio"), "label": options.get("label", "label"), "mode": options.get("decode", "native")}
    return [audio_table(split_files(spark, f"{data_dir}/{dataset}", s), **more) for s in splits]


def hub_images(spark: SparkSession, name: str, splits: list[str], data_dir: str | None) -> list[DataFrame]:
    """SRC12: ``hf:dataset?metadata=yes`` below ``data_dir``; images are bytes, or structs that hold them."""
    dataset, options = source_name(name, "hf", IMAGE_OPTIONS)
    out = []
    for s in splits:
        df = split_files(spark, f"{data_dir}/{dataset}", s)
        if "image" in df.columns and isinstance(df.schema["image"].dataType, T.StructType):
            df = df.withColumn("image", F.col("image")["bytes"])
        out.append(image_table(df, dataset=dataset, split=s, metadata=yes_or_no(options.get("metadata", "no"))))
    return out


for _prefix, _loader in (("hf_audio:", hub_audio), ("hf:", hub_images), ("wilds:", wilds_table)):
    register_source(_prefix, _loader)
