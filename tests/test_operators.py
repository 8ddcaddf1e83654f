"""Relational operators, sources and the lifecycle."""

from __future__ import annotations

import hashlib
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.kernels import images, signal
from tidemill.operators import batching, filters, metrics, segments, sidecar, snapshot, stats
from tidemill.operators.positions import POS, concatenate, enumerate_rows, shuffled
from tidemill.plans import pipeline, presets
from tidemill.sources import files, manifests, registry


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, ["A", "B", "S1", "A"][i % 4], {"x": i}, [float(i), float(i + 1)]) for i in range(10)]
    df = spark.createDataFrame([(i, d, x) for i, d, _, x in data], "id long, device string, inputs array<double>")
    return enumerate_rows(df.withColumn("metadata", F.struct("device", (F.col("id") % 2 == 0).alias("known"), F.lit("city").alias("city"))).drop("device"), "id")


def test_positions_and_shuffles(spark):
    df = spark.range(1000).repartition(7)
    got = enumerate_rows(df, -F.col("id")).collect()
    assert all(r[POS] == 999 - r["id"] for r in got)
    base = enumerate_rows(df, "id")
    a, b, c = ({r["id"]: r[POS] for r in shuffled(base.repartition(k), 3, e).collect()} for k, e in ((2, 0), (5, 0), (2, 1)))
    assert a == b != c and sorted(a.values()) == list(range(1000))
    assert concatenate() is None


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_positions_of_wide_rows_are_each_given_once(spark, tmp_path, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        wide = spark.range(30_000).select(F.col("id"), (F.col("id") % 7).alias("a.b"), F.repeat(F.sha2(F.col("id").cast("string"), 256), F.pmod(F.hash("id"), F.lit(60))).alias("text"))
        got = enumerate_rows(wide.repartition(9, F.rand(3)), (F.col("id") % 11).alias("k"), F.when(F.col("id") > 9, F.col("id")).alias("n"), F.col("id"))
        got.write.parquet(str(tmp_path / "rows"))
        stored = spark.read.parquet(str(tmp_path / "rows"))
        assert stored.agg(F.count("*"), F.countDistinct(POS), F.min(POS), F.max(POS)).first()[:] == (30_000, 30_000, 0, 29_999)
        order = [r["id"] for r in stored.orderBy(POS).select("id").collect()]
        assert order == sorted(range(30_000), key=lambda i: (i % 11, i if i > 9 else -1, i))
        assert enumerate_rows(wide.limit(0), "id").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_predicates(rows):
    ids = lambda **c: sorted(r["id"] for r in filters.filter_by_metadata(rows, **c).collect())
    assert ids(device="A") == [0, 3, 4, 7, 8] and ids(device_in=["B", "S1"]) == [1, 2, 5, 6, 9]
    assert ids(device="A", known=True) == [0, 4, 8] and ids(missing=1) == [] and ids(device_in=[]) == [] and len(ids()) == 10
    assert ids(id_in=[3, 4]) == [3, 4] and ids(city=5) == []
    assert list(filters.groups(rows, ["device"])) == ["A", "B", "S1"]
    assert filters.groups(rows, ["device", "known"])[("A", True)].count() == 3
    with pytest.raises(filters.SplitLeakage):
        filters.assert_stats_allowed("eval")
    with pytest.warns(UserWarning):
        filters.assert_stats_allowed("eval", override=True)
    with pytest.raises(ValueError, match="unknown"):
        filters.assert_stats_allowed("x")
    with pytest.raises(Exception, match="selection_failed"):
        filters.selected(rows, F.when(F.col("id") < 5, True), "id").collect()


def test_moments_by_axes(spark):
    x = np.arange(2 * 4 * 3 * 2, dtype=float).reshape(2, 4, 3, 2)
    df = spark.createDataFrame([(v.tolist(), "g") for v in x], "f array<array<array<double>>>, g string")
    for axes, reduce in ((("time",), (0, 1)), (("time", "channel"), (0, 1, 3)), ((), (0,)), ((-1, "freq"), (0, 2, 3))):
        got = stats.feature_stats(df, "f", by="g", axes=axes)
        places = sorted(c for c in got.columns if c.startswith("axis"))
        t = got.orderBy(*places).toPandas()
        assert np.allclose(t["mean"], x.mean(reduce).reshape(-1)) and np.allclose(t["std"], x.std(reduce).reshape(-1))
        assert set(t["count"]) == {x.size // x.mean(reduce).size}
    hard = spark.createDataFrame([([1e6 + 0.5, 1e6 - 0.5],)], "f array<double>")
    assert stats.feature_stats(hard, "f", by=None).first()["std"] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        stats.axis_numbers(("no such",), 2)


def test_metadata_modes(rows):
    assert stats.with_metadata_mode(rows, "numeric_only").schema["metadata"].dataType.names == ["known"]
    assert stats.with_metadata_mode(rows, "numeric_only", ("device",)).schema["metadata"].dataType.names == ["device", "known"]
    assert "metadata" not in stats.with_metadata_mode(rows, "none").columns
    assert stats.nested(stats.flattened(rows)).select("metadata").collect() == rows.select("metadata").collect()
    assert [len(b) for b in stats.stats_batches(rows, batch_size=4)] == [4, 4, 2]


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0, "a"), (0, 1, "a"), (1, 1, "b"), (5, 1, "b")], "y int, p int, d string")
    assert metrics.macro_accuracy(df, "y", "p", 3).first()[0] == pytest.approx(0.75)
    assert {r["d"]: r["accuracy"] for r in metrics.group_accuracy(df, "y", "p", "d").collect()} == {"a": 0.5, "b": 0.5}
    assert {(r["y_true"], r["y_pred"]): r["n"] for r in metrics.confusion_matrix(df, "y", "p", 2).collect()} == {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 1}
    assert metrics.macro_accuracy(df.limit(0), "y", "p").first()[0] == 0.0
    assert metrics.batch_count(10, 4) == 3 and metrics.batch_count(10, 4, True) == 2


def test_batches_padding_and_resuming(rows):
    b = batching.batch(rows, 4, ["id", "metadata"])
    p = batching.padded(b, 4).orderBy("batch_id").collect()
    assert [[r["id"] for r in x["rows"]] for x in p] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 0, 0]]
    assert [sum(x["padding_mask"]) for x in p] == [4, 4, 2] and p[2]["rows"][3]["metadata"]["city"] == ""
    assert batching.resumed(b, 2).count() == 1 and batching.remaining(10, 4, 2) == (1, 2)
    with pytest.raises(ValueError):
        batching.remaining(10, 4, 4)
    q = batching.partners(rows, 5, 3).collect()
    assert all(r[POS] // 5 == r["_partner"] // 5 for r in q) and len({r["_partner"] for r in q}) == 10
    m = {r["id"]: r["inputs"] for r in batching.mixup(rows, 5, "inputs", None, seed=3, share=0.75).collect()}
    of = {r[POS]: r["_partner"] for r in q}
    assert all(m[i][0] == pytest.approx(0.75 * i + 0.25 * of[i]) for i in range(10))


def test_sidecars(spark, tmp_path):
    df = spark.createDataFrame([(i, f"c{i}", i * 2) for i in range(6)], "id long, clip_id string, n long")
    df = df.select("id", F.struct(F.lit("d").alias("dataset"), F.lit("s").alias("split"), "clip_id", "n").alias("metadata"))
    side = sidecar.build(df)
    path = f"{tmp_path}/side.jsonl"
    assert sidecar.write_lines(side, path) and not sidecar.write_lines(side, path)
    again, _ = sidecar.read_lines(spark, path)
    assert again.agg(sidecar.digest(again)).first() == side.agg(sidecar.digest(side)).first()
    with pytest.raises(FileExistsError):
        sidecar.write_lines(side, path, policy="create")
    changed = sidecar.build(df.withColumn("metadata", F.col("metadata").withField("n", F.lit(0))))
    with pytest.raises(sidecar.SidecarError):
        sidecar.write_lines(changed, path)
    from tidemill.functions.hashing import stable_hash

    own = stable_hash(F.concat_ws("::", F.lit("d"), F.lit("s"), F.col("metadata.clip_id")))
    good = sidecar.raise_first(sidecar.attach(df, side, own, {"n": F.col("metadata.n")}), "id")
    assert good.count() == 6 and sidecar.unverified(good, side).count() == 0 and sidecar.unverified(good, changed).count() == 5
    with pytest.raises(sidecar.SidecarError, match="unknown_id"):
        sidecar.raise_first(sidecar.attach(df, side, F.col("id")), "id")
    with pytest.raises(sidecar.SidecarError, match="field_differs"):
        sidecar.raise_first(sidecar.attach(df, side, own, {"n": F.lit(3)}), "id")
    views = sidecar.view_ids(good, {"text": F.lit("x")}, F.col("id") > 2)
    assert sidecar.views_of(views).count() == 3 and sidecar.unverified(views, side, sidecar.views_of(views)).count() == 0
    assert sidecar.orphans(side, spark.createDataFrame([(1, 2, "{}")], sidecar.VIEWS)).count() == 1


def test_segments_over_capacity(spark):
    areas = [(1, 10, 1, 50), (1, 11, 1, 40), (1, 12, 2, 30), (1, 13, 2, 20), (1, 14, 3, 10)]
    df = spark.createDataFrame(areas, "image long, segment_id long, category_id int, area long")
    own = lambda k, policy: {r["segment_id"] for r in segments.things_with_targets(df, "image", capacity=F.lit(k), policy=policy).filter("own").collect()}
    assert own(3, "exclude_supervision") == {10, 11, 12} and own(3, "merge_by_category") == {14} and own(4, "merge_by_category") == {10, 11, 14}
    assert own(5, "merge_by_category") == {10, 11, 12, 13, 14}
    bad = segments.things_with_targets(df, "image", capacity=F.lit(2), policy="merge_by_category").filter("_issue is not null")
    assert bad.count() == 5
    assert segments.things_with_targets(df, "image", capacity=F.lit(4), policy="error").filter("_issue is not null").count() == 5
    index = spark.createDataFrame([(0, 1), (1, 1), (1, 9)], "p long, r long")
    assert {r["issue"] for r in segments.index_problems(index, 5, public="p", number="r").collect()} == {"duplicate_public", "duplicate_raw", "out_of_range"}


def test_targets_keep_segment_zero_where_no_number_is_void(spark, tmp_path):
    pixels = spark.createDataFrame([(1, 0), (1, 0), (1, 4), (1, 6), (1, None)], "image long, segment_id long")
    table = spark.createDataFrame([(1, 0, 2, False), (1, 4, 0, False), (1, 6, 0, False)], "image long, segment_id long, category_id int, is_crowd boolean")
    of = lambda **void: {tuple(r) for r in segments.panoptic_targets(pixels, table, "image", classes=(0, 2), things=(2,), capacity=5, **void).select("target", "class_id", "segment_id", "pixels").collect()}
    assert of(void=None) == {(0, 0, None, 2), (1, 2, 0, 2)} and of() == {(0, 0, 0, 2)}
    # the query: order 0 is a thing of image 2, orders 1 and 2 are stuff of image 0, order 3 is a crowd
    orders = [(0, 2, "O"), (1, 0, "F"), (2, 100, "O"), (3, 2, "P")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, 7, n) for k in range(4) for n in range(3)], "l_orderkey long, l_partkey long, l_linenumber long").write.parquet(f"{tmp_path}/lineitem.parquet")
    from tidemill.queries import QUERIES

    assert sorted(map(tuple, QUERIES["tgt04_targets"](spark, str(tmp_path)).collect())) == [(0, 0, 0, 6), (2, 2, 0, 3)]


def _source(spark, folder, n=6, **change):
    recs = []
    for i in range(n):
        data = f"content {i}".encode()
        (folder / f"{i}.bin").write_bytes(data)
        recs.append((f"r{i}", "train" if i % 2 else "test", str(folder / f"{i}.bin"), hashlib.sha256(data).hexdigest(), "{}"))
    df = spark.createDataFrame(recs, "record_id string, split string, path string, sha256 string, metadata string")
    for k, v in change.items():
        df = df.withColumn(k, v)
    adapt = lambda d: d.withColumn("size", F.length("content").cast("long"))
    return snapshot.Source("s", df, ("train", "test"), adapt, F.col("size") > 0)


SIZE = T.StructType([T.StructField("size", T.LongType())])


def test_admission_and_its_failures(spark, tmp_path):
    admit = lambda s, p, **o: snapshot.admit(spark, [s], {"s": ("test", "train")}, inventory_id="i", path=f"{tmp_path}/{p}", schema=SIZE, **o)
    got = admit(_source(spark, tmp_path), "a")
    assert [r["record_id"] for r in got.data.orderBy(POS).collect()] == ["r0", "r2", "r4", "r1", "r3", "r5"]
    assert snapshot.open_snapshot(spark, f"{tmp_path}/a").digest == got.digest
    some = admit(_source(spark, tmp_path), "b", selection=("odd", F.col("record_id") > "r2"))
    assert some.manifest["retained"] == 3 and some.manifest["excluded"] == 3
    cases = {
        "digest_mismatch": {"sha256": F.sha2(F.col("record_id"), 256)},
        "invalid_record": {"sha256": F.lit("x")},
        "duplicate_id": {"record_id": F.lit("same")},
    }
    for code, change in cases.items():
        with pytest.raises(snapshot.AdmissionError) as e:
            admit(_source(spark, tmp_path, **change), code)
        assert e.value.code == code and not (tmp_path / code).exists()
    with pytest.raises(snapshot.AdmissionError, match="missing_split"):
        snapshot.preflight([_source(spark, tmp_path)], {"s": ("nope",)})
    with pytest.raises(snapshot.AdmissionError, match="missing_source"):
        snapshot.preflight([], {"s": ("test",)})
    with pytest.raises(snapshot.AdmissionError, match="selection_failed"):
        admit(_source(spark, tmp_path), "c", selection=("n", F.lit(None).cast("boolean")))
    (tmp_path / "a" / "manifest.json").write_text("{}")
    with pytest.raises(snapshot.AdmissionError, match="corrupt"):
        snapshot.open_snapshot(spark, f"{tmp_path}/a")


def test_replay_goes_on_where_it_was(spark, tmp_path):
    admitted = snapshot.admit(spark, [_source(spark, tmp_path)], {"s": ("test", "train")}, inventory_id="i", path=f"{tmp_path}/r", schema=SIZE)
    run = lambda **o: pipeline.replay(admitted, stages=pipeline.Stages(), dataset_type="train", batch_size=4, seed=1, stateless=True, **{"epoch": 0, **o})
    ids = lambda r: [[x["record_id"] for x in b["rows"]] for b in r.batches.orderBy("batch_id").collect()]
    a = run()
    assert ids(a) == ids(run()) and len(ids(a)) == 2 and a.remaining_batches == 2
    state = pipeline.ReplayState.from_json(a.advanced().to_json())
    b = run(state=state)
    assert ids(b) == ids(a)[1:] and (b.remaining_batches, b.remaining_rows) == (1, 2)
    with pytest.raises(ValueError, match="epoch"):
        run(state=state, epoch=1)
    some = snapshot.admit(spark, [_source(spark, tmp_path)], {"s": ("test", "train")}, inventory_id="i", path=f"{tmp_path}/some", schema=SIZE, selection=("not r2", F.col("record_id") != "r2"))
    kept = pipeline.replay(some, stages=pipeline.Stages(), dataset_type="test", batch_size=2, seed=1, epoch=0, stateless=True)
    sizes = [sum(r["padding_mask"]) for r in kept.batches.orderBy("batch_id").collect()]
    assert len(sizes) == kept.remaining_batches and sum(sizes) == kept.remaining_rows and all(n == 2 for n in sizes[:-1])
    with pytest.raises(ValueError, match="stateless"):
        pipeline.replay(admitted, stages=pipeline.Stages(), dataset_type="train", batch_size=4, seed=1, epoch=0)


def test_caches(spark, tmp_path):
    df, path = spark.range(50), f"{tmp_path}/cache"
    keep = lambda p, **o: snapshot.protected_cache(df, p, stage="pre", policy=snapshot.CachePolicy(**o), fingerprint="f")
    assert snapshot.inspect_cache(path) == "missing" and keep(path).count() == 50 and snapshot.inspect_cache(path) == "complete"
    with pytest.raises(snapshot.CacheError, match="incompatible"):
        snapshot.protected_cache(df, path, stage="pre", policy=snapshot.CachePolicy(), fingerprint="g")
    with pytest.raises(snapshot.CacheError, match="quota_exceeded"):
        keep(f"{tmp_path}/small", most_rows=10)
    assert snapshot.inspect_cache(f"{tmp_path}/small") == "incomplete"
    part = next((tmp_path / "cache" / "data").glob("*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    assert snapshot.inspect_cache(path) == "corrupt"


def test_sources_and_lifecycle(spark, tmp_path):
    registry.register_source("unit:", lambda s, name, splits, d: [s.createDataFrame([(i, x) for i in range(5)], "id long, split string") for x in splits], replace=True)
    registry.register_source("broken:", lambda *a: 1 / 0, replace=True)
    with pytest.raises(ValueError):
        registry.register_source("unit:", lambda *a: [])
    with pytest.warns(UserWarning, match="left out"):
        got = registry.fetch(spark, ["broken:x", "unit:a", "unit:b"], ["p", "q"])
    assert got.count() == 20 and registry.fetch(spark, [], ["p"]) is None
    stages = pipeline.Stages(preprocess=lambda df: df.select("id", "split"), augment=lambda df, seed: df.withColumn("id", F.col("id") + 100))
    run = lambda kind, seed=1: pipeline.load(spark, ["unit:a"], ["p", "q"], kind, 4, seed, order=["id"], stages=stages, count=True)
    batches, n = run("validation")
    assert n == 3 and [r["id"] for b in pipeline.numpy_rows(batches) for r in b][:6] == [0, 1, 2, 3, 4, 0]
    train = [r["id"] for b in pipeline.numpy_rows(run("train")[0]) for r in b]
    assert train == [r["id"] for b in pipeline.numpy_rows(run("train")[0]) for r in b] and set(train[:10]) == set(range(100, 105))
    assert train != [r["id"] for b in pipeline.numpy_rows(run("train", 2)[0]) for r in b]
    assert list(pipeline.numpy_batches(batches))[2]["padding_mask"].tolist() == [True, True, False, False]
    with pytest.raises(ValueError):
        pipeline.Options(("a",), ("b",), "no such", 1, 1, ("id",))


def test_manifests(spark, tmp_path):
    head = "path,label,split,clip_id,source_id,start_time,end_time\n"
    (tmp_path / "m.csv").write_text(head + "a.wav,1,train,c1,s,0,1.5\n/b.wav,2,train,c2,s,,\nc.wav,3,test,c3,s,0,1\n")
    got = manifests.local_audio(spark, f"{tmp_path}/m.csv", "train").orderBy("clip_id").collect()
    assert [(r["path"], r["label"], r["end_time"]) for r in got] == [(f"{tmp_path}/a.wav", 1, 1.5), ("/b.wav", 2, 0.0)]
    (tmp_path / "t.tsv").write_text((head + "a.wav,x,train,c1,s,0,1\n").replace(",", "\t"))
    assert manifests.local_audio(spark, f"{tmp_path}/t.tsv", "train").first()["label"] == "x"
    (tmp_path / "metadata.csv").write_text("filename,split\nbus-paris-1-22-a.wav,dev_train_25\nshopping_mall-lisbon-3-44-s4.wav,dev_train_25\n")
    scenes = manifests.load_scenes(spark, str(tmp_path), "dev_train_25").orderBy("filename").collect()
    assert [(r["scene_label"], r["label"], r["device"], r["device_type"], r["is_known_device"]) for r in scenes] == [("bus", 7, "A", "real", True), ("shopping_mall", 1, "S4", "simulated", False)]
    with pytest.raises(ValueError, match="lacks"):
        manifests.local_audio(spark, f"{tmp_path}/metadata.csv", "train")


def test_files_and_archives(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.wav").write_bytes(signal.encode_wav(np.linspace(-0.5, 0.5, 100), 8000))
    r = files.wav_files(spark, f"{tmp_path}/w").first()
    assert (r["sample_rate"], r["channels"], len(r["waveform"])) == (8000, 1, 100)
    for split, name in (("train", "cat"), ("train", "dog"), ("test", "dog")):
        d = tmp_path / "img" / split / name
        d.mkdir(parents=True)
        (d / "x.png").write_bytes(images.encode_png(np.zeros((4, 4, 3), np.uint8)))
    got = files.image_folder(spark, f"{tmp_path}/img", "test").collect()
    assert [(x["class_name"], x["label"], x["example_id"]) for x in got] == [("dog", 1, "dog/x.png")]
    with pytest.raises(ValueError):
        files.image_folder(spark, f"{tmp_path}/img", "none")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../x", "y")
    with pytest.raises(ValueError, match="unsafe"):
        files.extract(f"{tmp_path}/bad.zip", f"{tmp_path}/out")
    with tarfile.open(tmp_path / "ok.tar.gz", "w:gz") as t:
        t.add(tmp_path / "img", arcname="img")
    assert not (tmp_path / "out").exists()
    files.extract(f"{tmp_path}/ok.tar.gz", f"{tmp_path}/out")
    assert (tmp_path / "out" / "img" / "test" / "dog" / "x.png").exists()
    digest = hashlib.md5((tmp_path / "ok.tar.gz").read_bytes()).hexdigest()
    assert files.file_matches(f"{tmp_path}/ok.tar.gz", digest) and not files.file_matches(f"{tmp_path}/ok.tar.gz", "sha256:00")
    assert files.wilds_spec("wilds:fmow?unlabeled=yes") == ("fmow", {"unlabeled": True})
    with pytest.raises(ValueError):
        files.wilds_spec("wilds:fmow?x=1")


def test_presets_and_their_merge():
    assert presets.merged({"a": 1}, {"a": 5}, {"a": 1, "b": 2}) == {"a": 5, "b": 2}
    assert presets.merged({"a": 3}, {"a": 5}, {"a": 1}) == {"a": 3} and presets.merged({"a": 1}, {"a": 5}, {"a": 1}, {"a": 1}) == {"a": 1}
    assert presets.find_preset("cifar10", "vision")["augment"]["image_size"] == 32 and presets.find_preset("unseen", "vision")["augment"]["image_size"] == 224
    assert presets.find_preset("ast_esc50_16k_5s_fbank128", "acoustic").frames() == 498
    with pytest.raises(ValueError):
        presets.resolve_config(lambda a, b=1: 0, {"c": 1}, "stage")


def test_streaming(spark, tmp_path):
    from tidemill import streaming

    df = spark.createDataFrame([(i, f"c{i % 4}") for i in range(8)], "id long, clip_id string")
    df = df.select("id", F.struct(F.lit("d").alias("dataset"), F.lit("s").alias("split"), "clip_id").alias("metadata"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = streaming.write_sidecar_stream(stream, f"{tmp_path}/side", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.schema(sidecar.SCHEMA).parquet(*[str(p) for p in (tmp_path / "side").glob("batch=*")]).distinct()
    assert got.count() == 4 and sidecar.conflicts(got).count() == 0


def test_entry_and_registered_queries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
