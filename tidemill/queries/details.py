"""Further operators one by one: labels, views, signals, pictures, tables of declarations, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemill.functions import arrays, hashing, labels, views
from tidemill.functions import images as image_columns
from tidemill.kernels import corruptions, images, scene, signal
from tidemill.operators import batching, contracts, filters, metrics, snapshot, stats
from tidemill.operators.arrow import column_kernel, stacked_kernel
from tidemill.operators.positions import POS, concatenate, enumerate_rows, shuffled
from tidemill.plans import stages
from tidemill.queries._registry import query, table
from tidemill.queries.arrays import _spread, _sql, _vectors
from tidemill.queries.kernels import _BANK, _EDGES, _FRAMED, _HERTZ_BANK, _PICTURE, _SAMPLES, BANDS, SPECTRUM, _digest, _digested, _image, _RESIZED
from tidemill.queries.kernels import _vectors as _embeddings


def _docs(spark, d):
    return table(spark, d, "documents")


def _kernel(f, returns: str = "array<double>"):
    return column_kernel(f, returns)


def _f32(x) -> np.ndarray:
    return np.asarray(x, np.float32)


# --- order, sets, filters, metadata


@query("SELECT kind, count(*)::BIGINT AS n, count(extra)::BIGINT AS with_extra FROM (SELECT 'nation' AS kind, n_regionkey AS extra FROM nation UNION ALL SELECT 'region', NULL FROM region) GROUP BY 1")
def set01_union(spark, d):
    both = concatenate(table(spark, d, "nation").select(F.lit("nation").alias("kind"), F.col("n_regionkey").alias("extra")), table(spark, d, "region").select(F.lit("region").alias("kind")))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.count("extra").alias("with_extra"))


@query("SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS places, 0::BIGINT AS first, (count(*) - 1)::BIGINT AS last, sum(doc_id)::BIGINT AS ids, true AS moved FROM documents")
def win01_permutation(spark, d):
    """A shuffle is a permutation: every row once, every place once, and not the order before."""
    rows = enumerate_rows(_docs(spark, d).select("doc_id"), "doc_id")
    t = shuffled(rows, seed=5, epoch=1).join(rows.select("doc_id", F.col(POS).alias("was")), "doc_id")
    return t.agg(F.count("*").alias("n"), F.countDistinct(POS).alias("places"), F.min(POS).alias("first"), F.max(POS).alias("last"), F.sum("doc_id").alias("ids"), F.max(F.col(POS) != F.col("was")).alias("moved"))


@query("SELECT pos // 16 AS batch, count(*)::BIGINT AS n, count(*)::BIGINT AS partners, sum(vec_id)::BIGINT AS ids FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings) GROUP BY 1")
def join08_partners(spark, d):
    """Partners are a permutation of each batch."""
    rows = enumerate_rows(table(spark, d, "embeddings").select("vec_id"), "vec_id")
    t = batching.partners(rows, 16, 3).join(rows.select(F.col(POS).alias("_partner"), F.col("vec_id").alias("other")), "_partner")
    return t.groupBy(F.floor(F.col(POS) / 16).alias("batch")).agg(F.count("*").alias("n"), F.countDistinct("other").alias("partners"), F.sum("other").alias("ids"))


def _nested(spark, d):
    return _docs(spark, d).select("doc_id", F.struct("lang", "source", "n_chars", (F.col("doc_id") % 4).alias("fold")).alias("metadata"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id % 4 IN (1, 2)")
def flt02_metadata(spark, d):
    return filters.filter_by_metadata(_nested(spark, d), lang="en", fold_in=[1, 2]).select("doc_id")


@query("SELECT doc_id, lang AS wanted FROM documents")
def prj08_lookup(spark, d):
    t = _nested(spark, d).withColumn("lang", F.lit("a column of the same name"))
    return t.select("doc_id", filters.metadata_column(t.schema, "lang")[0].alias("wanted"))


@query("SELECT doc_id, lang, n_chars, (doc_id % 4)::BIGINT AS fold, 3::INT AS fields FROM documents")
def prj07_stats_metadata(spark, d):
    t = stats.with_metadata_mode(_nested(spark, d), "numeric_only", ("lang",))
    return t.select("doc_id", "metadata.lang", "metadata.n_chars", "metadata.fold", F.lit(len(t.schema["metadata"].dataType.fields)).alias("fields"))


@query("SELECT i::BIGINT AS batch, least(10, (SELECT count(*) FROM nation) - 10 * i)::BIGINT AS n FROM range(3) t(i)")
def agg03_stats_batches(spark, d):
    sizes = [len(b) for b in stats.stats_batches(table(spark, d, "nation").select("n_nationkey"), batch_size=10)]
    return spark.createDataFrame(list(enumerate(sizes)), "batch long, n long")


@query("SELECT (SELECT count(*) FROM documents)::BIGINT AS n, ceil((SELECT count(*) FROM documents) / 48.0)::BIGINT AS batches, floor((SELECT count(*) FROM documents) / 48.0)::BIGINT AS whole")
def agg13_cardinality(spark, d):
    n = _docs(spark, d).count()
    return spark.createDataFrame([(n, metrics.batch_count(n, 48), metrics.batch_count(n, 48, True))], "n long, batches long, whole long")


@query("SELECT conv_id, count(*)::BIGINT AS real FROM conversations GROUP BY 1")
def agg08_real_rows(spark, d):
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    mask = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: k < F.col("n"))
    return t.select("conv_id", metrics.real_rows(mask).cast("long").alias("real"))


# --- labels


@query("SELECT doc_id, quality::BIGINT AS by_index, quality::VARCHAR AS by_text, (quality = 1)::INT::DOUBLE AS second FROM labels")
def lab01_transforms(spark, d):
    t, y = table(spark, d, "labels"), F.col("quality")
    hot = labels.transform_label(y, "one_hot", classes=3)
    return t.select("doc_id", labels.transform_label(y, "index").alias("by_index"), labels.transform_label(y, "text").alias("by_text"), hot[1].cast("double").alias("second"))


@query("SELECT doc_id, round(CASE WHEN quality = 0 THEN 0.9 ELSE 0 END + 0.1 / 4, 6) AS first, [toxic, quality]::INT[]::VARCHAR AS kept FROM labels")
def lab06_for_mixing(spark, d):
    t = table(spark, d, "labels")
    vector = labels.for_mixing(F.col("quality"), "single_label", 4, 0.1)
    kept = labels.for_mixing(F.array(F.col("toxic").cast("int"), F.col("quality").cast("int")), "multi_label", 2)
    return t.select("doc_id", F.round(vector[0].cast("double"), 6).alias("first"), F.concat(F.lit("["), F.array_join(kept.cast("array<string>"), ", "), F.lit("]")).alias("kept"))


@query("SELECT doc_id, quality::BIGINT AS number, (toxic = 1)::INT::DOUBLE AS hot FROM labels")
def lab08_classification(spark, d):
    t = table(spark, d, "labels")
    return t.select("doc_id", labels.classification_label(F.col("quality"), one_hot_labels=False, classes=None).alias("number"), labels.classification_label(F.col("toxic"), one_hot_labels=True, classes=2)[1].cast("double").alias("hot"))


# --- hashes


@query("""SELECT sha256('{"a":[1,2.5,null],"b":{"x":true,"é":"ü"}}') AS digest, 'haze@2:sha256:' || sha256('{"p":[1]}') AS identity, sha256('[["x",1.5],["y",2]]') AS stack""")
def hash04_digests(spark, d):
    made = (hashing.digest_of({"b": {"é": "ü", "x": True}, "a": [1, 2.5, None]}), hashing.identity("haze", "2", {"p": [1]}), hashing.stack_identity([("x", 1.5), ("y", 2)]))
    return spark.createDataFrame([made], "digest string, identity string, stack string")


@query("SELECT doc_id, true AS inside, true AS again FROM documents")
def hash08_draws(spark, d):
    """In [0, 1), the same whenever asked for, and not that of another purpose."""
    x, y = hashing.draw(3, F.col("doc_id"), "a"), hashing.draw(3, F.col("doc_id"), "b")
    return _docs(spark, d).repartition(5).select("doc_id", ((x >= 0) & (x < 1)).alias("inside"), ((x == hashing.draw(3, F.col("doc_id"), "a")) & (x != y)).alias("again"))


# --- views


@query("SELECT doc_id, greatest(round_even(0.37 * n_chars, 0)::INT, 1) AS samples, len(list_distinct(list_concat(range(0, greatest(n_chars::INT - 40, 0) + 1, 25), [greatest(n_chars::INT - 40, 0)])))::INT AS starts FROM documents")
def seg03_sliding_starts(spark, d):
    n = F.col("n_chars").cast("int")
    return _docs(spark, d).select("doc_id", views.samples_of(0.37, F.col("n_chars")).alias("samples"), F.size(views.sliding_starts(n, F.lit(40), F.lit(25))).alias("starts"))


@query("SELECT doc_id, true AS fits, true AS again FROM documents")
def seg05_random_starts(spark, d):
    """Every start leaves room for the view, and is the same for the same seed."""
    n = F.col("n_chars").cast("int")
    s = views.random_start(n, F.lit(40), 9, F.col("doc_id"))
    return _docs(spark, d).select("doc_id", ((s >= 0) & (s <= F.greatest(n - 40, F.lit(0)))).alias("fits"), (s == views.random_start(n, F.lit(40), 9, F.col("doc_id"))).alias("again"))


# --- signals


@query(_digested(_SAMPLES, "x", 2, 2))
def fe01_raw(spark, d):
    return _digest(_embeddings(spark, d), _kernel(lambda x: signal.frontend(_f32(x), "raw_waveform"))(F.col("embedding")), 2, 2)


@query(_digested(_FRAMED, "(SELECT vec_id, sqrt(v) AS v FROM p)", 1, 2))
def fe03_magnitude(spark, d):
    s = signal.Stft(n_fft=32, window=32, hop=8, rate=64, power=1.0)
    return _digest(_embeddings(spark, d), stacked_kernel(lambda x: signal.frontend(x, "stft_magnitude", s))(F.col("embedding")), 1, 2)


@query(f"WITH {_EDGES}, {_BANK} SELECT 'htk' AS bank, m, round(sum(round(w, 4)), 3) AS total FROM w GROUP BY ALL UNION ALL (WITH {_EDGES}, {_HERTZ_BANK} SELECT 'no_nyquist', m, round(sum(round(w, 4)), 3) FROM w GROUP BY ALL)")
def fe04_mel_banks(spark, d):
    rows = [(name, m, round(float(sum(round(float(v), 4) for v in bank[:, m])), 3)) for name in ("htk", "no_nyquist") for bank in [signal.mel_bank(SPECTRUM, signal.Mel(8, bank=name))] for m in range(8)]
    return spark.createDataFrame(rows, "bank string, m long, total double")


@query(_digested(f"{_FRAMED}, {_EDGES}, {_BANK}", "(SELECT vec_id, t, m, sum(v * w) AS v FROM p JOIN w USING (f) GROUP BY ALL)", 1, 1))
def fe05_mel_power(spark, d):
    return _digest(_embeddings(spark, d), stacked_kernel(lambda x: signal.frontend(x, "mel_power", SPECTRUM, BANDS))(F.col("embedding")), 1, 1)


#: The triangles in Hz that also weigh the last bin.
_ALL_HERTZ = _HERTZ_BANK.replace("range(16) b(f)", "range(17) b(f)")


@query(_digested(f"{_FRAMED}, {_EDGES}, {_ALL_HERTZ}", "(SELECT vec_id, ln(greatest(v, 1e-10)) AS v FROM (SELECT vec_id, t, m, sum(v * w) AS v FROM p JOIN w USING (f) GROUP BY ALL))", 1, 1))
def fe09_fbank(spark, d):
    return _digest(_embeddings(spark, d), stacked_kernel(lambda x: signal.frontend(x, "kaldi_fbank", SPECTRUM, BANDS))(F.col("embedding")), 1, 1)


@query("WITH x AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), h(j, h) AS (VALUES (0, 0.5), (1, 0.25), (2, -0.125), (3, 0.0625)), y AS (SELECT vec_id, i + j - 1 AS o, sum(v * h) AS v FROM x, h GROUP BY ALL) SELECT vec_id, count(*)::INT AS n, round(sum(v), 2) + 0.0 AS total, round(max(v), 2) + 0.0 AS most FROM y WHERE o BETWEEN 0 AND 63 GROUP BY 1")
def arr12_convolved(spark, d):
    return _digest(_embeddings(spark, d), _kernel(lambda x: signal.convolve(signal.tc(_f32(x)), np.array([0.5, 0.25, -0.125, 0.0625])))(F.col("embedding")), 2, 2)


@query(_sql("list_transform(e, lambda v: least(greatest(v, -0.05), 0.05))"))
def wa06_clipped(spark, d):
    return _spread(_vectors(spark, d), arrays.clipped(F.col("e"), F.lit(0.05)))


@query(_sql("list_concat(e[60:64], e[1:59])"))
def sa02_time_roll(spark, d):
    return _spread(_vectors(spark, d), arrays.rolled(F.col("e"), F.lit(5)))


@query(f"WITH {_SAMPLES} SELECT vec_id, 64::INT AS n, round(sum(CASE WHEN i % 8 < 6 THEN v ELSE 0 END), 2) + 0.0 AS total, round(greatest(max(CASE WHEN i % 8 < 6 THEN v ELSE 0 END), 0), 2) + 0.0 AS most FROM x GROUP BY 1")
def sa03_mel_shift(spark, d):
    f = _kernel(lambda x: signal.SPECTROGRAM_AUGMENTS["mel_bin_shift"][0](_f32(x).reshape(8, 8, 1), signal.rng_of(1), shift=2))
    return _digest(_embeddings(spark, d), f(F.col("embedding")), 2, 2)


@query(_digested(f"{_SAMPLES}, w AS (SELECT o, i, greatest(0, 1 - abs(i - ((o + 0.5) * 64 / 71.0 - 0.5))) AS w FROM range(64) a(o), range(64) b(i))", "(SELECT vec_id, o, sum(v * w) / sum(w) AS v FROM x JOIN w USING (i) WHERE w > 0 GROUP BY ALL)", 2, 2))
def wa09_speed(spark, d):
    f = _kernel(lambda x: signal.WAVEFORM_AUGMENTS["speed_perturb"][0](signal.tc(_f32(x)), 64, signal.rng_of(1), rates=(0.9,)))
    return _digest(_embeddings(spark, d), f(F.col("embedding")), 2, 2)


@query("SELECT vec_id, list_sort(list_transform(embedding, lambda v: v::DOUBLE), 'DESC')[6] AS value FROM embeddings")
def win09_threshold(spark, d):
    f = _kernel(lambda x: scene.reached_by(np.asarray(x, np.float64), 0.1), "double")
    return _embeddings(spark, d).select("vec_id", f(F.col("embedding")).alias("value"))


# --- pictures


@query(f"WITH {_RESIZED} SELECT vec_id, round(sum(v * (0.5 + y + 0.37 * x)), 0) + 0.0 AS total FROM (SELECT vec_id, y - 2 AS y, x - 5 AS x, v FROM q) GROUP BY 1")
def im02_eval_image(spark, d):
    weights = (0.5 + np.arange(16)[:, None, None] + 0.37 * np.arange(16)[:, None])
    f = _kernel(lambda x: float((images.eval_image(_image(x), 16, 20).astype(np.float64) * weights).sum()), "double")
    return _embeddings(spark, d).select("vec_id", (F.round(f(F.col("embedding")), 0) + 0.0).alias("total"))


@query(f"WITH {_PICTURE} SELECT vec_id, sum(v * ((c * 768 + y * 32 + x) % 97))::BIGINT AS digest FROM px GROUP BY 1")
def im05_channels_first(spark, d):
    f = _kernel(lambda x: float((images.channels_first(_image(x)).astype(np.int64).reshape(-1) * (np.arange(2304) % 97)).sum()), "double")
    return _embeddings(spark, d).select("vec_id", f(F.col("embedding")).cast("long").alias("digest"))


@query(f"WITH {_PICTURE} SELECT vec_id, sum(v * ((y * 96 + (31 - x) * 3 + c) % 89))::BIGINT AS across, sum(v * (((23 - y) * 96 + x * 3 + c) % 89))::BIGINT AS down FROM px GROUP BY 1")
def im10_flips(spark, d):
    def f(vertical):
        def run(x):
            y = images.flipped(_image(x), vertical=vertical)
            return float(((y[0] if isinstance(y, tuple) else y).astype(np.int64).reshape(-1) * (np.arange(2304) % 89)).sum())

        return _kernel(run, "double")

    return _embeddings(spark, d).select("vec_id", f(False)(F.col("embedding")).cast("long").alias("across"), f(True)(F.col("embedding")).cast("long").alias("down"))


#: Taps of a Gaussian of deviation 1 to three deviations, and a picture blurred by them along both sides, mirrored.
_TAPS = "k AS (SELECT j, exp(-j * j / 2.0) / (SELECT sum(exp(-i * i / 2.0)) FROM range(-3, 4) u(i)) AS w FROM range(-3, 4) t(j))"


def _mirror(size: int, name: str) -> str:
    """Places o and the taps' sources i of a line of ``size``, with weights."""
    return f"{name} AS (SELECT o, CASE WHEN o + j < 0 THEN -(o + j) WHEN o + j > {size - 1} THEN {2 * (size - 1)} - (o + j) ELSE o + j END AS i, w FROM range({size}) a(o), k)"


_SMOOTH = f"{_PICTURE}, {_TAPS}, {_mirror(24, 'ky')}, {_mirror(32, 'kx')}, v1 AS (SELECT vec_id, o AS y, x, c, sum(v * w) AS v FROM px JOIN ky ON ky.i = px.y GROUP BY ALL), v2 AS (SELECT vec_id, y, o AS x, c, sum(v * w) AS v FROM v1 JOIN kx ON kx.i = v1.x GROUP BY ALL)"


@query(_digested(_SMOOTH, "v2", 2, 4))
def im24_blur(spark, d):
    return _digest(_embeddings(spark, d), _kernel(lambda x: images.blur(_image(x), 1.0))(F.col("embedding")), 2, 4)


@query(f"WITH {_SMOOTH} SELECT vec_id, sum(round_even(v, 0))::BIGINT AS total FROM v2 GROUP BY 1")
def vc05_gaussian_blur(spark, d):
    f = _kernel(lambda x: float(corruptions.apply_corruption(_image(x), name="gaussian_blur", severity=2, seed=(1, 1)).astype(np.int64).sum()), "double")
    return _embeddings(spark, d).select("vec_id", f(F.col("embedding")).cast("long").alias("total"))


@query(f"WITH {_PICTURE} SELECT vec_id, sum(round_even(least(255, v * CASE c WHEN 0 THEN 0.5919 / 0.4372 * (0.4604 / 0.4816) WHEN 1 THEN 1 ELSE 0.2513 / 0.4372 * (0.4604 / 0.4782) END), 0))::BIGINT AS total FROM px GROUP BY 1")
def vc09_warm(spark, d):
    f = _kernel(lambda x: float(corruptions.apply_corruption(_image(x), name="white_balance_warm", severity=3, seed=(1, 1)).astype(np.int64).sum()), "double")
    return _embeddings(spark, d).select("vec_id", f(F.col("embedding")).cast("long").alias("total"))


@query(_sql("list_transform(list_transform(e, lambda v: floor(abs(v) * 2000)), lambda v: least(1.0, v / 255))"))
def vc17b_unit(spark, d):
    return _spread(_vectors(spark, d), image_columns.unit(F.transform("e", lambda v: F.floor(F.abs(v) * 2000))))


@query("SELECT parameter, severity, value::DOUBLE AS value FROM (VALUES ('attenuation_per_m', 1, 0.003), ('attenuation_per_m', 5, 0.04), ('homogeneous_transmission', 1, 0.85), ('homogeneous_transmission', 5, 0.25), ('patchiness', 1, 0.3), ('patchiness', 5, 0.3)) t(parameter, severity, value)")
def vc18_registry(spark, d):
    got = corruptions.find("haze")
    return spark.createDataFrame([(k, s, float(v[s - 1])) for k, v in got.parameters.items() for s in (1, 5)], "parameter string, severity int, value double")


# --- segment tables and declarations


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN '[7, 9, 0, 0]' ELSE '[9, 0, 0, 0]' END AS numbers FROM embeddings")
def tgt05_padded_table(spark, d):
    row = lambda n, ok: F.struct(F.lit(n).alias("segment_id"), ok.alias("valid"))
    t = F.array(row(9, F.lit(True)), row(7, F.col("vec_id") % 3 == 0), row(8, F.lit(False)))
    padded = image_columns.padded_table(image_columns.sorted_segments(t), 4, row(0, F.lit(False)))
    return table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("["), F.array_join(F.transform(padded, lambda s: s["segment_id"].cast("string")), ", "), F.lit("]")).alias("numbers"))


@query("SELECT vec_id, list_sort(list_distinct(list_transform(embedding[1:10], lambda v: floor(v::DOUBLE * 1000)::BIGINT)))::VARCHAR AS ordered FROM embeddings")
def win07_sorted_segments(spark, d):
    numbers = F.array_distinct(F.transform(F.slice("embedding", 1, 10), lambda v: F.floor(v.cast("double") * 1000).cast("long")))
    t = F.transform(numbers, lambda n: F.struct(n.alias("segment_id"), F.lit(True).alias("valid")))
    ordered = F.transform(image_columns.sorted_segments(t), lambda s: s["segment_id"].cast("string"))
    return table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("["), F.array_join(ordered, ", "), F.lit("]")).alias("ordered"))


def _refused(f) -> bool:
    try:
        f()
    except ValueError:
        return True
    return False


@query("SELECT * FROM (VALUES ('good', false), ('repeated', true), ('negative', true), ('thing_is_no_class', true), ('ignored_class', true), ('no_room', true)) t(declaration, refused)")
def tgt06_class_contracts(spark, d):
    cases = {"good": ([0, 1, 2], [2], {"capacity": 2, "ignore": 255}), "repeated": ([0, 0], [], {}), "negative": ([0, -1], [], {}), "thing_is_no_class": ([0], [1], {}), "ignored_class": ([0], [], {"ignore": 0}), "no_room": ([0, 1], [], {"capacity": 1})}
    return spark.createDataFrame([(k, _refused(lambda c=c, t=t, o=o: contracts.validate_classes(c, t, **o))) for k, (c, t, o) in cases.items()], "declaration string, refused boolean")


@query("SELECT * FROM (VALUES ('logmel', 'features', 'features'), ('raw_waveform', 'waveform', 'audio'), ('mfcc', 'features', 'features')) t(frontend, kind, output)")
def fe19_output_kinds(spark, d):
    return spark.createDataFrame([(n, stages.output_kind(n), stages.output_key(n)) for n in ("logmel", "raw_waveform", "mfcc")], "frontend string, kind string, output string")


@query("SELECT * FROM (VALUES ('doc_id: bigint', 0), ('doc_id: int', 1), ('more', 1)) t(declared, problems)")
def snk08_schema(spark, d):
    from pyspark.sql import types as T

    t, field = _docs(spark, d).select("doc_id"), lambda n, k: T.StructField(n, k)
    declared = {"doc_id: bigint": T.StructType([field("doc_id", T.LongType())]), "doc_id: int": T.StructType([field("doc_id", T.IntegerType())]), "more": T.StructType([field("doc_id", T.LongType()), field("x", T.StringType())])}
    return spark.createDataFrame([(k, len(snapshot.schema_problems(t, s))) for k, s in declared.items()], "declared string, problems int")


@query("""SELECT sha256('{"options":{"seed":3},"stage":"preprocess"}') AS cache""")
def snk12_fingerprint(spark, d):
    return spark.createDataFrame([(snapshot.fingerprint(stage="preprocess", options={"seed": 3}),)], "cache string")
