"""Sources, snapshots, caches, epochs and declarations as queries: small tables go through files and come back.

Files lie in the shared folder of ``spark.checkpoint.dir``, or in one of our own where that is unset (local runs).
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import warnings
import zipfile

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.kernels import images
from tidemill.operators import filters, metrics, sidecar, snapshot
from tidemill.operators.positions import POS, enumerate_rows
from tidemill.plans import pipeline, presets
from tidemill.queries._registry import query, table
from tidemill.sources import files, hub, manifests, registry  # noqa: F401  hub registers its loaders


def _folder(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    path = f"{base.removeprefix('file:').rstrip('/')}/tidemill-query-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def _nations(spark, d) -> list:
    return table(spark, d, "nation").orderBy("n_nationkey").collect()


# --- sources


@query("SELECT c_custkey, 'a' AS split FROM customer WHERE c_custkey % 3 = 0")
def src04_split_table(spark, d):
    folder = _folder(spark)
    table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "a").otherwise("b").alias("split")).write.parquet(f"{folder}/customers.parquet")
    (got,) = registry.parquet_tables(spark, "customers", ["a"], folder)
    return got


@query("SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation")
def src05_records(spark, d):
    return registry.from_records(spark, [{"key": r["n_nationkey"], "name": r["n_name"]} for r in _nations(spark, d)], "key long, name string")


@query("SELECT * FROM (VALUES ('exact', 'a:x', 2), ('prefix', 'a:y', 1), ('none', 'b', 0)) t(wanted, name, value)")
def src03_registry(spark, d):
    r = registry.Registry("query")
    r.register("a:", 1)
    r.register("a:x", 2)
    return spark.createDataFrame([(k, n, r.resolve(n, 0)) for k, n in (("exact", "a:x"), ("prefix", "a:y"), ("none", "b"))], "wanted string, name string, value int")


def _manifest(spark, d, sep: str, name: str) -> str:
    path = f"{_folder(spark)}/{name}"
    with open(path, "w", encoding="utf-8") as out:
        out.write(sep.join(manifests.REQUIRED) + "\n")
        for r in _nations(spark, d):
            k = r["n_nationkey"]
            out.write(sep.join([f"{'/data/' if k % 2 else ''}{k}.wav", str(r["n_regionkey"]), "train" if k % 5 else "test", f"c{k}", "s", "0", str(k / 4) if k % 3 else ""]) + "\n")
    return path


@query("SELECT n_nationkey::VARCHAR AS id, n_regionkey::VARCHAR AS label, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE (n_nationkey / 4.0)::DOUBLE::VARCHAR END AS ends FROM nation")
def src08_manifest(spark, d):
    m = manifests.read_manifest(spark, _manifest(spark, d, "\t", "m.tsv"))
    return m.select(F.regexp_extract("clip_id", r"\d+", 0).alias("id"), "label", F.col("end_time").alias("ends"))


@query("SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS label, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE n_nationkey / 4.0 END::DOUBLE AS ends, n_nationkey::VARCHAR || '.wav' AS filename, (CASE WHEN n_nationkey % 2 = 1 THEN '/data/' ELSE '/base/' END) || n_nationkey::VARCHAR || '.wav' AS path FROM nation WHERE n_nationkey % 5 > 0")
def src07_local_audio(spark, d):
    got = manifests.local_audio(spark, _manifest(spark, d, ",", "m.csv"), "train", "/base")
    return got.select(F.regexp_extract("clip_id", r"\d+", 0).cast("long").alias("id"), "label", F.col("end_time").alias("ends"), "filename", "path")


def _pictures(spark, d) -> str:
    folder = f"{_folder(spark)}/pictures"
    for r in _nations(spark, d):
        k = r["n_nationkey"]
        path = f"{folder}/{'train' if k % 4 else 'test'}/region{r['n_regionkey']}"
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{k}.png", "wb") as out:
            out.write(images.encode_png(np.full((3, 5, 3), k, np.uint8)))
    return folder


@query("SELECT 'region' || n_regionkey::VARCHAR AS class_name, n_regionkey::BIGINT AS label, 'region' || n_regionkey::VARCHAR || '/' || n_nationkey::VARCHAR || '.png' AS example_id FROM nation WHERE n_nationkey % 4 > 0")
def src13_image_folder(spark, d):
    return files.image_folder(spark, _pictures(spark, d), "train", content=False).drop("path")


@query("SELECT n_regionkey::BIGINT AS label, count(*)::BIGINT AS n FROM nation WHERE n_nationkey % 4 = 0 GROUP BY 1")
def src14_archive(spark, d):
    folder = _pictures(spark, d)
    archive = f"{os.path.dirname(folder)}/pictures.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for root, _, names in os.walk(folder):
            for n in names:
                out.write(f"{root}/{n}", os.path.relpath(f"{root}/{n}", folder))
    with open(archive, "rb") as f:
        checksum = "sha256:" + hashlib.file_digest(f, "sha256").hexdigest()
    return files.archive_source(spark, archive, checksum, f"{os.path.dirname(folder)}/unpacked", "test").groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('up', true), ('absolute', true), ('twice', true), ('good', false)) t(archive, refused)")
def src15_unsafe_archives(spark, d):
    folder, out = _folder(spark), []
    for name, members in (("up", ["../x"]), ("absolute", ["/x"]), ("twice", ["x", "x"]), ("good", ["a/x", "a/y"])):
        with warnings.catch_warnings(), zipfile.ZipFile(f"{folder}/{name}.zip", "w") as z:
            warnings.simplefilter("ignore")
            for m in members:
                z.writestr(m, "text")
        try:
            files.extract(f"{folder}/{name}.zip", f"{folder}/{name}")
            refused = False
        except ValueError:
            refused = True
        out.append((name, refused))
    return spark.createDataFrame(out, "archive string, refused boolean")


# --- snapshots, side-cars, caches


def _admitted(spark, d):
    folder = _folder(spark)
    records = []
    for r in _nations(spark, d):
        path = f"{folder}/{r['n_nationkey']}.txt"
        data = r["n_name"].encode()
        with open(path, "wb") as out:
            out.write(data)
        records.append((f"r{r['n_nationkey']:02d}", "train" if r["n_regionkey"] else "test", path, hashlib.sha256(data).hexdigest()))
    df = spark.createDataFrame(records, "record_id string, split string, path string, sha256 string")
    source = snapshot.Source("nations", df, ("train", "test"), adapt=lambda t: t.withColumn("name", F.col("content").cast("string")))
    schema = T.StructType([T.StructField("name", T.StringType())])
    return snapshot.admit(spark, [source], {"nations": ("test", "train")}, inventory_id="i", path=f"{folder}/snapshot", schema=schema, selection=("none that ends in 3", ~F.col("name").endswith("3")))


_ADMITTED = "(SELECT n_name AS name, row_number() OVER (ORDER BY n_regionkey <> 0, n_nationkey) - 1 AS pos FROM nation)"


@query(f"SELECT pos::BIGINT AS position, name FROM {_ADMITTED} WHERE name NOT LIKE '%3'")
def snk01_admission(spark, d):
    return _admitted(spark, d).data.select(F.col(POS).alias("position"), "name")


@query("SELECT count(*)::BIGINT AS retained, ((SELECT count(*) FROM nation) - count(*))::BIGINT AS excluded, true AS same FROM nation WHERE n_name NOT LIKE '%3'")
def snk06_reopened(spark, d):
    first = _admitted(spark, d)
    again = snapshot.open_snapshot(spark, first.path)
    return spark.createDataFrame([(again.manifest["retained"], again.manifest["excluded"], again.digest == first.digest)], "retained long, excluded long, same boolean")


@query(f"SELECT batch::BIGINT AS batch, count(*)::BIGINT AS real, min(name) AS least FROM (SELECT name, (row_number() OVER (ORDER BY pos) - 1) // 4 AS batch FROM {_ADMITTED} WHERE name NOT LIKE '%3') WHERE batch >= 2 GROUP BY 1")
def life04_replayed(spark, d):
    """An evaluation epoch of a snapshot, from a saved state on."""
    admitted = _admitted(spark, d)
    run = lambda **o: pipeline.replay(admitted, stages=pipeline.Stages(), dataset_type="test", batch_size=4, seed=1, epoch=0, stateless=True, **o)
    state = pipeline.ReplayState.from_json(run().advanced(2).to_json())
    got = run(state=state).batches
    least = F.array_min(F.transform(F.filter("rows", lambda r: r["name"] != ""), lambda r: r["name"]))
    return got.select(F.col("batch_id").alias("batch"), metrics.real_rows(F.col("padding_mask")).cast("long").alias("real"), least.alias("least"))


@query("SELECT epoch::BIGINT AS epoch, (SELECT count(*) FROM documents)::BIGINT AS n, (SELECT count(*) FROM documents)::BIGINT AS ids FROM range(2) t(epoch)")
def life03_epochs(spark, d):
    """Every epoch holds every row once, and no two are in the same order."""
    rows = enumerate_rows(table(spark, d, "documents").select("doc_id"), "doc_id")
    options = pipeline.Options(("documents",), ("all",), "train", 50, 3, ("doc_id",))
    out = None
    for epoch in range(2):
        b = pipeline.finalized(rows, options, pipeline.Stages(), seed=100 + epoch)
        each = b.select(F.lit(epoch).cast("long").alias("epoch"), F.explode(F.arrays_zip("rows", "padding_mask")).alias("r")).filter("r.padding_mask")
        out = each if out is None else out.union(each)
    return out.groupBy("epoch").agg(F.count("*").alias("n"), F.countDistinct("r.rows.doc_id").alias("ids"))


@query("SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation WHERE n_regionkey <> 1")
def snk09_cached(spark, d):
    folder = _folder(spark)
    rows = table(spark, d, "nation").filter("n_regionkey <> 1").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    keep = lambda: snapshot.protected_cache(rows, f"{folder}/cache", stage="pre", policy=snapshot.CachePolicy(100), fingerprint="f")
    keep()
    return keep()


@query("SELECT * FROM (VALUES ('before', 'missing'), ('stored', 'complete'), ('without its manifest', 'incomplete'), ('changed', 'corrupt')) t(moment, state)")
def snk10_inspected(spark, d):
    path = f"{_folder(spark)}/cache"
    seen = [("before", snapshot.inspect_cache(path))]
    snapshot.protected_cache(table(spark, d, "region"), path, stage="pre", policy=snapshot.CachePolicy(), fingerprint="f")
    seen.append(("stored", snapshot.inspect_cache(path)))
    os.rename(f"{path}/manifest.json", f"{path}/aside")
    seen.append(("without its manifest", snapshot.inspect_cache(path)))
    os.rename(f"{path}/aside", f"{path}/manifest.json")
    part = next(n for n in sorted(os.listdir(f"{path}/data")) if n.endswith(".parquet"))
    with open(f"{path}/data/{part}", "ab") as out:
        out.write(b"x")
    return spark.createDataFrame([*seen, ("changed", snapshot.inspect_cache(path))], "moment string, state string")


def _nation_sidecar(spark, d):
    m = F.struct(F.lit("nations").alias("dataset"), F.lit("all").alias("split"), F.col("n_nationkey").cast("string").alias("clip_id"), F.col("n_name").alias("name"))
    return sidecar.build(table(spark, d, "nation").select(m.alias("metadata")))


@query("""SELECT '{"clip_id":"' || n_nationkey::VARCHAR || '","dataset":"nations","name":"' || n_name || '","split":"all"}' AS metadata, '{"clip_id":"' || n_nationkey::VARCHAR || '","dataset":"nations","split":"all"}' AS identity FROM nation""")
def snk15_lines_read(spark, d):
    path = f"{_folder(spark)}/sidecar.jsonl"
    sidecar.write_lines(_nation_sidecar(spark, d), path)
    return sidecar.read_lines(spark, path)[0].select("metadata", "identity")


@query("SELECT true AS equal, true AS differs")
def snk16_digests(spark, d):
    """Equal for any order of the rows, another one for other rows."""
    s = _nation_sidecar(spark, d)
    a, b, c = (t.agg(sidecar.digest(t).alias("x")).first()["x"] for t in (s, s.repartition(7, "metadata"), s.filter("metadata not like '%NATION_7%'")))
    return spark.createDataFrame([(a == b, a != c)], "equal boolean, differs boolean")


@query("SELECT i::BIGINT AS batch, least(8, (SELECT count(*) FROM nation) - 8 * i)::BIGINT AS real, 8::BIGINT AS n FROM range(4) t(i)")
def snk18_numpy(spark, d):
    rows = enumerate_rows(table(spark, d, "nation"), "n_nationkey")
    options = pipeline.Options(("nation",), ("all",), "test", 8, 3, ("n_nationkey",))
    got = pipeline.numpy_batches(pipeline.finalized(rows, options, pipeline.Stages()))
    return spark.createDataFrame([(k, int(b["padding_mask"].sum()), len(b["n_nationkey"])) for k, b in enumerate(got)], "batch long, real long, n long")


@query("""SELECT '{"augment_eval":false,"batch_size":8,"dataset_type":"test","drop_remainder":false,"extra":{},"metadata_mode":"full","names":["a"],"order":["k"],"seed":3,"shuffle":true,"splits":["x"]}' AS configuration""")
def snk19_configuration(spark, d):
    return spark.createDataFrame([(pipeline.Options(("a",), ("x",), "test", 8, 3, ("k",)).to_json(),)], "configuration string")


# --- declarations


def _refused(f) -> bool:
    try:
        f()
    except (ValueError, KeyError):
        return True
    return False


@query("SELECT * FROM (VALUES ('good', false), ('type', true), ('batch', true), ('metadata', true), ('order', true)) t(option, refused)")
def life05_options(spark, d):
    make = lambda **o: lambda: pipeline.Options(**{"names": ("a",), "splits": ("x",), "dataset_type": "train", "batch_size": 2, "seed": 1, "order": ("k",), **o})
    cases = {"good": {}, "type": {"dataset_type": "no such"}, "batch": {"batch_size": 0}, "metadata": {"metadata_mode": "no such"}, "order": {"order": ()}}
    return spark.createDataFrame([(k, _refused(make(**o))) for k, o in cases.items()], "option string, refused boolean")


@query("SELECT * FROM (VALUES ('dev_train_25', true), ('eval', false)) t(split, fitted)")
def flt06_leakage(spark, d):
    def allowed(split: str) -> bool:
        try:
            filters.assert_stats_allowed(split)
        except filters.SplitLeakage:
            return False
        return True

    return spark.createDataFrame([(s, allowed(s)) for s in ("dev_train_25", "eval")], "split string, fitted boolean")


@query("SELECT * FROM (VALUES ('not given', 5, 2), ('given', 3, 2), ('as the default', 5, 2), ('overridden', 9, 2)) t(user_value, a, b)")
def ctl03_merge(spark, d):
    merge = lambda user, more=None: presets.merged(user, {"a": 5}, {"a": 1, "b": 2}, more)
    cases = (("not given", merge({})), ("given", merge({"a": 3})), ("as the default", merge({"a": 1})), ("overridden", merge({"a": 3}, {"a": 9})))
    return spark.createDataFrame([(k, m["a"], m["b"]) for k, m in cases], "user_value string, a int, b int")


@query("SELECT * FROM (VALUES ('cifar10', 32), ('unseen', 224), ('wilds:iwildcam', 448), ('imagenet_a3', 160)) t(preset, image_size)")
def ctl09_vision_presets(spark, d):
    return spark.createDataFrame([(n, presets.find_preset(n, "vision")["augment"]["image_size"]) for n in ("cifar10", "unseen", "wilds:iwildcam", "imagenet_a3")], "preset string, image_size int")


@query("SELECT * FROM (VALUES ('ast_esc50_16k_5s_fbank128', 16000, 128, 498), ('panns_cnn14_32k_10s_logmel64', 32000, 64, 1001)) t(preset, rate, bins, frames)")
def ctl08_acoustic_presets(spark, d):
    found = [(n, presets.find_preset(n, "acoustic")) for n in ("ast_esc50_16k_5s_fbank128", "panns_cnn14_32k_10s_logmel64")]
    return spark.createDataFrame([(n, p.rate, p.mel.bins, p.frames()) for n, p in found], "preset string, rate int, bins int, frames int")


# --- records of one kind in another's columns


@query("SELECT n_nationkey::VARCHAR AS example_id, n_name || '.wav' AS filename, 'nations' AS dataset, 8000 AS sample_rate FROM nation")
def prj02_canonical(spark, d):
    t = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("clip_id"), F.concat(F.lit("/a/b/"), "n_name", F.lit(".wav")).alias("path"), F.col("n_regionkey").alias("label"))
    c = manifests.canonical(t, dataset="nations", default_rate=8000)
    return c.select("metadata.example_id", "metadata.filename", "metadata.dataset", "sample_rate")


@query("SELECT n_name AS name, n_regionkey::BIGINT AS hard_label, ['A', 'B', 'C'][n_regionkey + 1] AS class_name FROM nation")
def prj11_hard_label(spark, d):
    t = table(spark, d, "nation").select(F.col("n_regionkey").alias("label"), F.struct(F.col("n_name").alias("name")).alias("metadata"))
    m = manifests.with_hard_label(t, ["A", "B", "C"])
    return m.select("metadata.name", "metadata.hard_label", "metadata.class_name")


@query("SELECT n_name AS name, 'haze' AS corruption, '1.0.0' AS corruption_version FROM nation")
def prj10_provenance(spark, d):
    t = table(spark, d, "nation").select(F.struct(F.col("n_name").alias("name")).alias("metadata"))
    return manifests.with_corruption(t, "haze", "1.0.0", "haze@1.0.0:x", 3).select("metadata.name", "metadata.corruption", "metadata.corruption_version")


@query("SELECT n_nationkey::VARCHAR AS id, CASE WHEN n_nationkey % 6 = 1 THEN 'identity_conflict: ' || n_nationkey::VARCHAR END AS issue FROM nation")
def prj12_record_ids(spark, d):
    given = F.when(F.col("n_nationkey") % 6 == 1, "other").when(F.col("n_nationkey") % 6 == 2, F.col("n_nationkey").cast("string"))
    t = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("record_id"), F.struct(given.alias("example_id")).alias("metadata"))
    got = sidecar.with_record_id(t, "record_id")
    return got.select(F.col("metadata.example_id").alias("id"), F.col("_issue").alias("issue"))


@query("""SELECT n_nationkey AS key, '{"a":' || n_nationkey::VARCHAR || ',"b":"' || n_name || '","c":null,"d":' || (n_nationkey % 2 = 0)::VARCHAR || '}' AS text FROM nation""")
def prj14_json(spark, d):
    t = table(spark, d, "nation")
    made = sidecar.sorted_json({"b": F.col("n_name"), "a": F.col("n_nationkey"), "d": F.col("n_nationkey") % 2 == 0, "c": F.lit(None).cast("string")})
    return t.select(F.col("n_nationkey").alias("key"), made.alias("text"))


@query("SELECT quality, count(*)::BIGINT AS n FROM labels WHERE toxic = 0 GROUP BY 1")
def flt04_after_cache(spark, d):
    folder = _folder(spark)
    rows = snapshot.protected_cache(table(spark, d, "labels"), f"{folder}/cache", stage="pre", policy=snapshot.CachePolicy(), fingerprint="f")
    return filters.filter_by_metadata(rows, toxic=0).groupBy("quality").agg(F.count("*").alias("n"))


# --- datasets as a hub lays them out


@query("SELECT vec_id % 3 AS label, count(*)::BIGINT AS n, 16000 AS sample_rate, sum(len(embedding))::BIGINT AS samples FROM embeddings WHERE vec_id % 4 > 0 GROUP BY 1")
def src11_hub_audio(spark, d):
    folder = _folder(spark)
    t = table(spark, d, "embeddings")
    audio = F.struct(F.lit(None).cast("binary").alias("bytes"), F.lit("x.wav").alias("path"), F.col("embedding").alias("array"), F.lit(16000).alias("sampling_rate"))
    t = t.select(audio.alias("audio"), (F.col("vec_id") % 3).alias("label"), "vec_id")
    for split, rows in (("train", t.filter("vec_id % 4 > 0")), ("test", t.filter("vec_id % 4 = 0"))):
        rows.drop("vec_id").coalesce(1).write.parquet(f"{folder}/{split}")
        os.makedirs(f"{folder}/clips/data", exist_ok=True)
        part = next(n for n in os.listdir(f"{folder}/{split}") if n.endswith(".parquet"))
        os.rename(f"{folder}/{split}/{part}", f"{folder}/clips/data/{split}-00000-of-00001.parquet")
    got = registry.fetch(spark, ["hf_audio:clips"], ["train"], folder)
    return got.groupBy("label").agg(F.count("*").alias("n"), F.max("sample_rate").alias("sample_rate"), F.sum(F.size("waveform")).alias("samples"))


@query("SELECT n_regionkey AS label, n_name AS image FROM nation WHERE n_nationkey % 2 = 0")
def src12_hub_images(spark, d):
    folder = _folder(spark)
    t = table(spark, d, "nation").filter("n_nationkey % 2 = 0")
    t.select(F.struct(F.col("n_name").cast("binary").alias("bytes"), F.lit("x.png").alias("path")).alias("image"), F.col("n_regionkey").alias("label")).write.parquet(f"{folder}/flags/train")
    got = registry.fetch(spark, ["hf:flags"], ["train"], folder)
    return got.select("label", F.col("image").cast("string").alias("image"))
