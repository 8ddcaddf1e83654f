"""Array columns over `embeddings` (ARR, SEG, FE, WIN, WA, AC, SA) and images as arrays (IM, VC, TGT, GEO)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import arrays, geometry, images, views
from tidemill.queries._registry import query, table

VEC = "(SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
#: Bytes of a small RGB image for each vector: 0..255, whole numbers.
PIX = "(SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda v: (floor(abs(v) * 1000)::BIGINT % 256)::INT)[1:60] AS e FROM embeddings)"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("e"))


def _pixels(spark, d):
    v = _vectors(spark, d)
    return v.withColumn("e", F.slice(F.transform("e", lambda x: (F.floor(F.abs(x) * 1000) % 256).cast("int")), 1, 60))


def _spread(df, x, digits: int | None = 6):
    y = F.transform(x, lambda v: F.round(v, digits) + 0.0) if digits is not None else x
    return df.select("vec_id", F.posexplode(y).alias("pos", "v")).withColumn("pos", F.col("pos").cast("long"))


def _sql(x: str, of: str = VEC, digits: int | None = 6, kind: str = "DOUBLE") -> str:
    y = f"list_transform(x, lambda v: round(v, {digits}) + 0.0)" if digits is not None else "x"
    return f"SELECT vec_id, unnest(range(len(x)))::BIGINT AS pos, unnest({y})::{kind} AS v FROM (SELECT vec_id, {x} AS x FROM {of})"


@query(_sql("list_transform(e, lambda v: round(v * 1000)::INT / 32768.0)"))
def arr02_from_integer(spark, d):
    v = _vectors(spark, d)
    return _spread(v, arrays.from_integer(F.transform("e", lambda x: F.round(x * 1000).cast("int")), "int16"))


@query(_sql("e[17:48]"))
def arr04_window(spark, d):
    v = _vectors(spark, d)
    return _spread(v, arrays.window_of(F.col("e"), F.lit(1.0), F.lit(3.0), 16))


@query("SELECT vec_id, round(len(e) / 16.0, 6)::DOUBLE AS seconds FROM " + VEC)
def arr05_duration(spark, d):
    return _vectors(spark, d).select("vec_id", F.round(arrays.duration(F.size("e"), F.lit(16)), 6).alias("seconds"))


@query(_sql("list_transform(range(1, 33), lambda i: (e[i] + e[i + 32]) / 2)"))
def arr06_mono(spark, d):
    return _spread(_vectors(spark, d), arrays.mono(F.slice("e", 1, 32), F.slice("e", 33, 32), "mono_mean"))


@query(_sql("list_transform(e, lambda v: v - list_sum(e) / len(e))"))
def arr07_without_offset(spark, d):
    return _spread(_vectors(spark, d), arrays.without_offset(F.col("e")))


@query(_sql("list_transform(e, lambda v: v / greatest(sqrt(list_sum(list_transform(e, lambda w: w * w)) / len(e)), 1e-8))"))
def arr08_rms(spark, d):
    return _spread(_vectors(spark, d), arrays.leveled(F.col("e"), "rms"))


@query(_sql("list_transform(e, lambda v: v / greatest(list_max(list_transform(e, lambda w: abs(w))), 1e-8))"))
def arr08_peak(spark, d):
    return _spread(_vectors(spark, d), arrays.leveled(F.col("e"), "peak"))


@query(_sql("list_concat(e[1:len(e) - vec_id % 9], list_transform(range(80 - len(e) + vec_id % 9), lambda i: 0.0))"))
def arr11_fitted(spark, d):
    v = _vectors(spark, d).withColumn("e", F.expr("slice(e, 1, cast(size(e) - vec_id % 9 as int))"))
    return _spread(v, arrays.fitted(F.col("e"), 80))


@query("SELECT p_partkey, CASE WHEN p_size * 10 + 8 - 25 < 0 THEN 0 ELSE 1 + (p_size * 10 + 8 - 25) // 7 END::BIGINT AS n FROM part")
def arr14_frame_count(spark, d):
    return table(spark, d, "part").select("p_partkey", arrays.frame_count(F.col("p_size") * 10, 25, 7, 8, True).cast("long").alias("n"))


@query(_sql("list_concat(e, list_transform(range((24 - len(e) % 24) % 24), lambda i: 0.0))"))
def arr15_to_multiple(spark, d):
    return _spread(_vectors(spark, d), arrays.to_multiple(F.col("e"), 24))


@query("SELECT vec_id, f::BIGINT AS frame, round(list_sum(e[f * 10 + 1:f * 10 + 16]), 6)::DOUBLE AS s FROM " + VEC + ", range(5) t(f)")
def win12_framed(spark, d):
    v = _vectors(spark, d).select("vec_id", F.posexplode(arrays.framed(F.col("e"), 16, 10)).alias("frame", "x"))
    return v.select("vec_id", F.col("frame").cast("long").alias("frame"), F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 6).alias("s"))


@query("""WITH RECURSIVE t AS (SELECT vec_id, e, 1 AS i, e[1] AS m FROM """ + VEC + """ UNION ALL SELECT vec_id, e, i + 1, 0.9 * m + 0.1 * e[i + 1] FROM t WHERE i < 64)
SELECT vec_id, (i - 1)::BIGINT AS pos, round(m, 6)::DOUBLE + 0.0 AS v FROM t""")
def win10_smoothed(spark, d):
    return _spread(_vectors(spark, d), arrays.smoothed(F.col("e"), 0.1))


@query(_sql("list_transform(e, lambda v: ln(greatest(v, 0.001) + 0.5))"))
def fe06_log(spark, d):
    return _spread(_vectors(spark, d), arrays.log_compressed(F.col("e"), "log", amin=0.001, offset=0.5))


@query(_sql("list_transform(e, lambda v: greatest(10 * log10(greatest(v, 0.001) / list_max(e)), -20))"))
def fe06_db(spark, d):
    return _spread(_vectors(spark, d), arrays.log_compressed(F.col("e"), "db", amin=0.001, ref="max", top_db=20.0))


@query("""WITH RECURSIVE f AS (SELECT vec_id, list_transform(e, lambda v: greatest(v, 0.001)) AS e FROM """ + VEC + """), t AS (SELECT vec_id, e, 1 AS i, e[1] AS m FROM f UNION ALL SELECT vec_id, e, i + 1, 0.975 * m + 0.025 * e[i + 1] FROM t WHERE i < 64)
SELECT vec_id, (i - 1)::BIGINT AS pos, round(greatest(pow(e[i] / pow(1e-6 + m, 0.98) + 2, 0.5) - pow(2, 0.5), 0), 6)::DOUBLE + 0.0 AS v FROM t""")
def fe07_pcen(spark, d):
    return _spread(_vectors(spark, d), arrays.pcen(F.col("e"), amin=0.001))


@query(_sql("list_transform(e, lambda v: (v - list_sum(e) / len(e)) / sqrt(list_sum(list_transform(e, lambda w: pow(w - list_sum(e) / len(e), 2))) / len(e) + 1e-5))"))
def fe13_per_clip(spark, d):
    return _spread(_vectors(spark, d), arrays.normalised(F.col("e"), "per_clip_mean_std"))


@query(_sql("list_transform(e, lambda v: (v - 0.1) / (0.5 + 1e-5))"))
def fe13_dataset(spark, d):
    return _spread(_vectors(spark, d), arrays.normalised(F.col("e"), "dataset_mean_std", mean_value=0.1, std=0.5))


@query("SELECT p_partkey, round(1127 * ln(1 + p_retailprice / 700), 6)::DOUBLE AS mel, round(700 * (exp(1127 * ln(1 + p_retailprice / 700) / 1127) - 1), 4)::DOUBLE AS hz FROM part")
def fe14_mel(spark, d):
    mel = arrays.hz_to_mel(F.col("p_retailprice"))
    return table(spark, d, "part").select("p_partkey", F.round(mel, 6).alias("mel"), F.round(arrays.mel_to_hz(mel), 4).alias("hz"))


@query(_sql("list_transform(e, lambda v: v * pow(10, 6 / 20.0))"))
def wa01_gain(spark, d):
    return _spread(_vectors(spark, d), arrays.gain(F.col("e"), 6.0))


@query(_sql("list_concat(e[60:64], e[1:59])"))
def wa02_rolled(spark, d):
    return _spread(_vectors(spark, d), arrays.rolled(F.col("e"), F.lit(5)))


@query(_sql("list_concat(e[8:64], list_transform(range(7), lambda i: 0.0))"))
def wa02_shifted(spark, d):
    return _spread(_vectors(spark, d), arrays.shifted(F.col("e"), F.lit(-7)))


@query(_sql("list_transform(e, lambda v: -v)"))
def wa05_inverted(spark, d):
    return _spread(_vectors(spark, d), arrays.inverted(F.col("e")))


@query(_sql("list_transform(e, lambda v: v * pow(10, (CASE WHEN 20 * log10(abs(v) + 1e-8) + 12 > 0 THEN (20 * log10(abs(v) + 1e-8) + 12) / 4 - (20 * log10(abs(v) + 1e-8) + 12) ELSE 0 END) / 20))"))
def wa07_compressed(spark, d):
    return _spread(_vectors(spark, d), arrays.compressed(F.col("e"), -12.0, 4.0))


_STEP = "round_even((c + 1) * 0.5 * {n}, 0) / {n} * 2 - 1"


def _companded(levels: int, mu: float) -> str:
    c = f"sign(w) * ln(1 + {mu} * abs(w)) / ln(1 + {mu})"
    q = f"(round_even(({c} + 1) * 0.5 * {levels - 1}, 0) / {levels - 1} * 2 - 1)"
    return f"list_transform(list_transform(e, lambda v: greatest(least(v, 1.0), -1.0)), lambda w: sign({q}) * (exp(abs({q}) * ln(1 + {mu})) - 1) / {mu})"


@query(_sql(_companded(256, 255.0)))
def wa10_mu_law(spark, d):
    return _spread(_vectors(spark, d), arrays.mu_law(F.col("e"), 256, 255.0))


@query(_sql(_companded(64, 63.0)))
def ac03_codec(spark, d):
    return _spread(_vectors(spark, d), arrays.mu_law(F.col("e"), arrays.by_severity(arrays.MU_LAW_LEVELS, 3)))


@query(_sql("list_transform(range(1, 65), lambda i: coalesce(CASE WHEN i > 2 THEN e[i - 2] END, 0) * 0.08 + coalesce(CASE WHEN i > 1 THEN e[i - 1] END, 0) * 0.16 + e[i] * 0.52 + coalesce(e[i + 1], 0) * 0.16 + coalesce(e[i + 2], 0) * 0.08)"))
def ac05_device_ir(spark, d):
    return _spread(_vectors(spark, d), arrays.fir(F.col("e"), arrays.by_severity(arrays.DEVICE_TAPS, 3)))


@query(_sql("list_transform(e, lambda v: greatest(least(v, 0.6), -0.6))"))
def ac06_clipping(spark, d):
    return _spread(_vectors(spark, d), arrays.clipped(F.col("e"), arrays.by_severity(arrays.CLIP_THRESHOLDS, 3)))


@query(_sql("list_transform(e, lambda v: v * pow(10, (CASE WHEN 20 * log10(abs(v) + 1e-8) + 6 > 0 THEN (20 * log10(abs(v) + 1e-8) + 6) / 2 - (20 * log10(abs(v) + 1e-8) + 6) ELSE 0 END) / 20))"))
def ac07_compression(spark, d):
    return _spread(_vectors(spark, d), arrays.compressed(F.col("e"), arrays.by_severity(arrays.COMPRESSION_DB, 2), arrays.by_severity(arrays.COMPRESSION_RATIOS, 2)))


_VIEW = "round(list_sum(x), 6)::DOUBLE AS s, round(x[1], 6)::DOUBLE + 0.0 AS first, len(x)::BIGINT AS n"


def _views(df):
    s = F.aggregate("view", F.lit(0.0), lambda a, b: a + b)
    return df.select("vec_id", F.col("view_index").cast("long").alias("view_index"), F.round("view_start_time", 6).alias("t0"), F.round("view_end_time", 6).alias("t1"), F.round(s, 6).alias("s"), (F.round(F.get("view", F.lit(0)), 6) + 0.0).alias("first"), F.size("view").cast("long").alias("n"))


def _segmented(spark, d, v):
    return _views(views.segment(_vectors(spark, d).withColumn("rate", F.lit(16)), v, signal="e", rate="rate", position="vec_id"))


@query(f"""SELECT vec_id, i::BIGINT AS view_index, round(a / 16.0, 6)::DOUBLE AS t0, round((a + 20) / 16.0, 6)::DOUBLE AS t1, {_VIEW} FROM (SELECT vec_id, i, a, e[a + 1:a + 20] AS x FROM {VEC}, (VALUES (0, 0), (1, 12), (2, 24), (3, 36), (4, 44)) t(i, a))""")
def seg01_sliding(spark, d):
    return _segmented(spark, d, views.Views(1.25, eval_mode="sliding", hop=0.75))


@query(f"""SELECT vec_id, i::BIGINT AS view_index, round(a / 16.0, 6)::DOUBLE AS t0, round((a + 20) / 16.0, 6)::DOUBLE AS t1, {_VIEW} FROM (SELECT vec_id, i, a, e[a + 1:a + 20] AS x FROM {VEC}, (VALUES (0, 0), (1, 15), (2, 29), (3, 44)) t(i, a))""")
def seg04_multi_crop(spark, d):
    return _segmented(spark, d, views.Views(1.25, eval_mode="multi_crop", count=4))


@query(f"""SELECT vec_id, 0::BIGINT AS view_index, 0.0::DOUBLE AS t0, 6.25::DOUBLE AS t1, {_VIEW} FROM (SELECT vec_id, list_transform(range(100), lambda k: e[((k - 18 + 64) % 64) + 1]) AS x FROM {VEC})""")
def seg06_repeat(spark, d):
    return _segmented(spark, d, views.Views(6.25, pad="repeat", pad_side="center"))


@query(f"""SELECT vec_id, 0::BIGINT AS view_index, 0.0::DOUBLE AS t0, 6.25::DOUBLE AS t1, {_VIEW} FROM (SELECT vec_id, list_transform(range(100), lambda k: e[CASE WHEN k < 64 THEN k ELSE 126 - k END + 1]) AS x FROM {VEC})""")
def seg06_reflect(spark, d):
    return _segmented(spark, d, views.Views(6.25, pad="reflect"))


@query(f"""SELECT vec_id, 0::BIGINT AS view_index, 1.375::DOUBLE AS t0, 2.625::DOUBLE AS t1, {_VIEW} FROM (SELECT vec_id, e[23:42] AS x FROM {VEC})""")
def seg07_center(spark, d):
    return _segmented(spark, d, views.Views(1.25))


@query(_sql("list_transform(e, lambda v, i: (v / 255.0 - ([0.485, 0.456, 0.406])[(i - 1) % 3 + 1]) / (([0.229, 0.224, 0.225])[(i - 1) % 3 + 1] + 1e-8))", PIX))
def im03_normalised(spark, d):
    return _spread(_pixels(spark, d), images.normalised(F.col("e")))


@query("""WITH p AS (SELECT vec_id, unnest(range(60)) AS pos, unnest(e)::DOUBLE AS v FROM """ + PIX + """), m AS (SELECT vec_id, pos % 3 AS c, avg(v) AS m, stddev_pop(v) AS s FROM p GROUP BY ALL)
SELECT vec_id, pos::BIGINT AS pos, round(CASE WHEN s > 1e-6 THEN (v - m) / s ELSE 0 END, 6)::DOUBLE + 0.0 AS v FROM p JOIN m USING (vec_id) WHERE pos % 3 = c""")
def im04_standardised(spark, d):
    return _spread(_pixels(spark, d), images.standardised(F.col("e")))


@query("SELECT p_partkey, ((14 - p_size % 14) % 14)::BIGINT AS pad FROM part")
def im06_patch_padding(spark, d):
    return table(spark, d, "part").select("p_partkey", images.patch_padding(F.col("p_size"), 14).cast("long").alias("pad"))


@query("SELECT m::BIGINT AS m, round(m / 30.0 * 30, 6)::DOUBLE AS rotate, round(1 + m / 30.0 * 0.9, 6)::DOUBLE AS enhance, (8 - round_even(m / 30.0 * 4, 0))::DOUBLE AS posterize, round(255 * (1 - m / 30.0), 6)::DOUBLE AS solarize FROM (SELECT DISTINCT event_id % 31 AS m FROM events)")
def im17_arguments(spark, d):
    m = table(spark, d, "events").select((F.col("event_id") % 31).alias("m")).distinct()
    return m.select("m", *[F.round(images.operation_argument(n, F.col("m")), 6).alias(n) for n in ("rotate", "enhance", "posterize", "solarize")])


@query(_sql("list_transform(e, lambda v: CASE WHEN v < 128 THEN v ELSE 255 - v END)", PIX, None, "INT"))
def im18_solarized(spark, d):
    return _spread(_pixels(spark, d), images.solarized(F.col("e")), None)


@query(_sql("list_transform(e, lambda v: (v // 16) * 16)", PIX, None, "INT"))
def im18_posterized(spark, d):
    return _spread(_pixels(spark, d), images.posterized(F.col("e"), 4), None)


@query(_sql("list_transform(range(20), lambda k: e[3 * k + 1] * 0.2989 + e[3 * k + 2] * 0.587 + e[3 * k + 3] * 0.114)", PIX))
def im18_gray(spark, d):
    return _spread(_pixels(spark, d), images.gray(F.col("e")))


@query("""SELECT p_partkey, round(y0, 6)::DOUBLE AS y0, round(CASE WHEN y1 - y0 < 0.05 THEN y0 + 0.05 ELSE y1 END, 6)::DOUBLE AS y1 FROM (SELECT p_partkey, CASE WHEN b - a < 0.05 THEN least(a, 0.95) ELSE a END AS y0, b AS y1
FROM (SELECT p_partkey, greatest(least(p_size / 40.0 - 0.1, 1), 0) AS a, greatest(least(p_size / 40.0 + 0.2, 1), 0) AS b FROM part))""")
def im20_boxes(spark, d):
    b = F.array(F.struct((F.col("p_size") / 40 - 0.1).alias("y0"), F.lit(0.1).alias("x0"), (F.col("p_size") / 40 + 0.2).alias("y1"), F.lit(0.9).alias("x1")))
    c = F.get(images.clipped_boxes(b), F.lit(0))
    return table(spark, d, "part").select("p_partkey", F.round(c["y0"], 6).alias("y0"), F.round(c["y1"], 6).alias("y1"))


_LIN = "(CASE WHEN v / 255.0 <= 0.04045 THEN v / 255.0 / 12.92 ELSE pow((v / 255.0 + 0.055) / 1.055, 2.4) END)"


@query(_sql(f"list_transform(e, lambda v: {_LIN})", PIX))
def im22_linear(spark, d):
    return _spread(_pixels(spark, d), F.transform("e", lambda v: images.to_linear(v / 255.0)))


@query("SELECT p_partkey, round((p_size - (10 + 0.5 * (p_partkey % 20))) / sqrt(1.25), 6)::DOUBLE AS below FROM part")
def im25_horizon(spark, d):
    below = images.below_horizon(F.col("p_size"), F.col("p_partkey") % 20, F.lit(10.0), F.lit(20.0), F.lit(21.0))
    return table(spark, d, "part").select("p_partkey", F.round(below, 6).alias("below"))


@query(_sql("list_transform(list_transform(e, lambda v: greatest(least(abs(v), 1.0), 0.1)), lambda w: (w - greatest(least(list_min(list_transform(e, lambda u: abs(u))), 1.0), 0.1)) / (greatest(least(list_max(list_transform(e, lambda u: abs(u))), 1.0), 0.1) - greatest(least(list_min(list_transform(e, lambda u: abs(u))), 1.0), 0.1)))"))
def im26_depth(spark, d):
    return _spread(_vectors(spark, d), images.prepared_depth(F.transform("e", F.abs), 0.1, 1.0))


@query(_sql("list_transform(range(24), lambda k: e[least(floor((k + 0.5) * 64 / 24), 63)::INT + 1])"))
def geo05_nearest(spark, d):
    return _spread(_vectors(spark, d), images.resampled(F.col("e"), 24))


@query(_sql("list_transform(range(60), lambda i: e[least(floor((least(floor((i + 0.5) * 24 / 60), 23) + 0.5) * 60 / 24), 59)::INT + 1])", PIX, None, "INT"))
def vc03_pixelated(spark, d):
    return _spread(_pixels(spark, d), images.pixelated(F.col("e"), 0.4), None)


@query(_sql("list_transform(e, lambda v: round_even(greatest(least((v - 127.5) * 0.6 + 127.5, 255), 0), 0))", PIX, None, "INT"))
def vc07_contrast(spark, d):
    return _spread(_pixels(spark, d), images.less_contrast(F.col("e"), 0.6), None)


@query(_sql("list_transform(e, lambda v: round_even(v * 0.7::DOUBLE, 0))", PIX, None, "INT"))
def vc07_brightness(spark, d):
    return _spread(_pixels(spark, d), images.less_bright(F.col("e"), 0.7), None)


@query(_sql(f"list_transform(list_transform(e, lambda v: least({_LIN} * 2.0, 1.0)), lambda l: round_even(255 * (CASE WHEN l <= 0.0031308 THEN l * 12.92 ELSE 1.055 * pow(l, 1 / 2.4) - 0.055 END), 0))", PIX, None, "INT"))
def vc08_overexposed(spark, d):
    return _spread(_pixels(spark, d), images.overexposed(F.col("e"), 2.0), None)


@query("""SELECT p_partkey, round(CASE WHEN s < 1 THEN 1 + (0.9 - 1) * s WHEN s < 2 THEN 0.9 + (0.75 - 0.9) * (s - 1) WHEN s < 3 THEN 0.75 + (0.6 - 0.75) * (s - 2) WHEN s < 4 THEN 0.6 + (0.45 - 0.6) * (s - 3) ELSE 0.45 + (0.3 - 0.45) * (s - 4) END, 6)::DOUBLE AS f
FROM (SELECT p_partkey, p_size / 10.0 AS s FROM part)""")
def vc16_strength(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(images.at_strength(images.CONTRAST, F.col("p_size") / 10, neutral=1.0), 6).alias("f"))


@query("SELECT l_orderkey, l_linenumber, (l_linenumber + 256 * (l_partkey % 256) + 65536 * (l_suppkey % 256))::BIGINT AS id FROM lineitem")
def tgt01_rgb(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", images.segment_number(F.col("l_linenumber"), F.col("l_partkey") % 256, F.col("l_suppkey") % 256).alias("id"))


@query("""SELECT vec_id, c::BIGINT AS class_id, list_sum(list_transform(e, lambda v, i: (v % 5 = c AND v % 5 <> 4 AND i % 7 <> 1)::INT))::BIGINT AS n FROM """ + PIX + """, range(3) t(c)""")
def tgt02_class_masks(spark, d):
    p = _pixels(spark, d).withColumn("m", F.transform("e", lambda v: v % 5)).withColumn("ok", F.transform("e", lambda v, i: i % 7 != 0))
    m = p.select("vec_id", F.posexplode(images.class_masks(F.col("m"), (0, 1, 2), 4, F.col("ok"))).alias("class_id", "mask"))
    return m.select("vec_id", F.col("class_id").cast("long").alias("class_id"), F.size(F.filter("mask", lambda x: x)).cast("long").alias("n"))


@query("SELECT vec_id, len(list_filter(list_distinct(e), lambda v: v >= 200))::BIGINT AS bad FROM " + PIX)
def agg12_undeclared(spark, d):
    return _pixels(spark, d).select("vec_id", F.size(images.undeclared(F.col("e"), tuple(range(200)), 0)).cast("long").alias("bad"))


@query("""SELECT p_partkey, h, w, (h + (16 - h % 16) % 16)::BIGINT AS ih, (w + (16 - w % 16) % 16)::BIGINT AS iw FROM (SELECT p_partkey, greatest(1, floor(a * s + 0.5))::BIGINT AS h, greatest(1, floor(b * s + 0.5))::BIGINT AS w
FROM (SELECT p_partkey, a, b, least(1, 100.0 / greatest(a, b)) AS s FROM (SELECT p_partkey, p_size * 7 AS a, p_partkey % 300 + 1 AS b FROM part)))""")
def geo01_eval_geometry(spark, d):
    g = geometry.Geometry(long_side=100, classes=(0, 1))
    r = geometry.sample(F.col("p_size") * 7, F.col("p_partkey") % 300 + 1, g, training=False)
    t = table(spark, d, "part").select("p_partkey", r.alias("r"))
    at = lambda name, i: F.get(F.col("r")[name], F.lit(i)).cast("long")
    return t.select("p_partkey", at("resized_size", 0).alias("h"), at("resized_size", 1).alias("w"), at("model_input_size", 0).alias("ih"), at("model_input_size", 1).alias("iw"))


@query("SELECT p_partkey, 0::BIGINT AS problems FROM part")
def geo03_record_checks(spark, d):
    g = geometry.Geometry(crop=64, resize_range=(32, 128))
    r = geometry.sample(F.col("p_size") * 7, F.col("p_partkey") % 300 + 1, g, training=True, seed=3, position=F.col("p_partkey"))
    t = table(spark, d, "part").select("p_partkey", geometry.centered(r, F.lit(5.0), F.lit(9.0)).alias("r"))
    return t.select("p_partkey", F.size(geometry.problems(F.col("r"))).cast("long").alias("problems"))
