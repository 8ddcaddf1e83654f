"""Strings, hashes, labels (STR, HASH, LAB) and source scans (SRC)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import hashing, labels, strings
from tidemill.queries._registry import query, table

MISSING = "('', 'none', 'null', 'nan', 'n/a', 'na')"
HASH = "((('0x' || substr(sha256({}), 1, 16))::UBIGINT) & 9223372036854775807)::BIGINT"

#: File names as a scene-recording manifest has them, made from pages: scene-city-location-segment-device.wav
NAME_SQL = """(['airport','shopping_mall','metro_station','street_pedestrian','public_square','street_traffic','tram','bus','metro','park'])[(page_id % 10 + 1)::INT]
  || '-' || (['barcelona','lisbon','paris'])[(page_id % 3 + 1)::INT] || '-' || (page_id % 17)::VARCHAR || '-' || (page_id % 29)::VARCHAR || '-'
  || (['a','b','c','s1','s2','S10','unknown'])[(page_id % 7 + 1)::INT] || '.wav'"""


def _names(spark, d):
    pages = table(spark, d, "pages").select("page_id")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("page_id") % len(values)).cast("int"))
    name = F.concat_ws("-", pick(strings.SCENES), pick(("barcelona", "lisbon", "paris")), (F.col("page_id") % 17).cast("string"), (F.col("page_id") % 29).cast("string"), pick(("a", "b", "c", "s1", "s2", "S10", "unknown")))
    return pages.withColumn("name", F.concat(name, F.lit(".wav")))


@query(f"""SELECT event_id, CASE WHEN lower(trim(p)) IN {MISSING} THEN NULL ELSE trim(p) END AS txt
FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN ' NaN ' WHEN event_id % 5 = 1 THEN '' ELSE ' ' || event_type || ' ' END AS p FROM events)""")
def str01_text(spark, d):
    e = table(spark, d, "events")
    p = F.when(F.col("event_id") % 5 == 0, " NaN ").when(F.col("event_id") % 5 == 1, "").otherwise(F.concat(F.lit(" "), "event_type", F.lit(" ")))
    return e.select("event_id", strings.text(p).alias("txt"))


@query(f"""SELECT doc_id, coalesce(CASE WHEN lower(trim(a)) IN {MISSING} THEN NULL ELSE trim(a) END, lang) AS val
FROM (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE source END AS a FROM documents)""")
def str02_first_present(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("LANG_B"), F.when(F.col("doc_id") % 3 == 0, "none").otherwise(F.col("source")).alias("a"))
    return docs.select("doc_id", strings.first_present(docs.columns, "a", "missing", "lang_b").alias("val"))


@query(f"SELECT page_id, array_to_string(list_filter(string_split_regex(regexp_replace(name, '\\.[^.]+$', ''), '[._\\-/]+'), lambda t: t <> ''), '|') AS tokens FROM (SELECT page_id, {NAME_SQL} AS name FROM pages)")
def str03_stem_tokens(spark, d):
    return _names(spark, d).select("page_id", F.array_join(strings.stem_tokens(F.col("name")), "|").alias("tokens"))


@query(f"""SELECT page_id, CASE WHEN lower(x) = 'unknown' THEN 'unknown' ELSE upper(x) END AS device
FROM (SELECT page_id, regexp_extract({NAME_SQL}, '-([^-]+)\\.wav$', 1) AS x FROM pages)""")
def str04_device(spark, d):
    n = _names(spark, d)
    return n.select("page_id", strings.device(F.lit(None).cast("string"), F.col("name"), F.lit("train")).alias("device"))


@query("SELECT page_id, (['airport','shopping_mall','metro_station','street_pedestrian','public_square','street_traffic','tram','bus','metro','park'])[(page_id % 10 + 1)::INT] AS scene, (page_id % 10)::BIGINT AS scene_id FROM pages")
def str05_scene(spark, d):
    n = _names(spark, d)
    given = F.when(F.col("page_id") % 4 == 0, (F.col("page_id") % 10).cast("string")).when(F.col("page_id") % 4 == 1, F.upper(F.regexp_replace(strings.scene_in_name(F.regexp_replace("name", "-.*", ".wav")), "_", " ")))
    scene = strings.scene(given, F.regexp_replace("name", "-.*", ".wav"))
    return n.select("page_id", scene.alias("scene"), strings.scene_id(scene).alias("scene_id"))


@query(f"""SELECT page_id, split_part(name, '-', 2) AS city, split_part(name, '-', 3) AS location, split_part(name, '-', 4) AS segment,
  split_part(name, '-', 1) || '-' || split_part(name, '-', 2) || '-' || split_part(name, '-', 3) AS recording FROM (SELECT page_id, {NAME_SQL} AS name FROM pages)""")
def str06_name_parts(spark, d):
    n = _names(spark, d)
    name, scene = F.col("name"), strings.scene_in_name(F.regexp_replace("name", "-.*", ".wav"))
    segment = strings.segment_in_name(name)
    recording = F.regexp_replace(strings.recording_in_name(name, segment), r"^(shopping|metro|street|public)-(mall|station|pedestrian|square|traffic)-", "$1_$2-")
    return n.select("page_id", strings.city_in_name(name, scene).alias("city"), strings.location_in_name(name, scene).alias("location"), segment.alias("segment"), recording.alias("recording"))


@query("""SELECT doc_id, source, CASE WHEN s IN ('A','B','C','D') THEN 'real' WHEN s IN ('S1','S2','S3','S4','S5','S6','S7','S8','S9','S10') THEN 'simulated' ELSE 'unknown' END AS kind,
  s IN ('A','B','C','S1','S2','S3') AS known FROM (SELECT doc_id, source, (['A','D','S1','S4','S10','x'])[(doc_id % 6 + 1)::INT] AS s FROM documents)""")
def str08_device_type(spark, d):
    s = F.get(F.array(*map(F.lit, ("A", "D", "S1", "S4", "S10", "x"))), (F.col("doc_id") % 6).cast("int"))
    return table(spark, d, "documents").select("doc_id", "source", strings.device_type(s).alias("kind"), strings.is_training_device(s).alias("known"))


@query("SELECT page_id, regexp_replace(url, '^.*[\\\\/]', '') AS base FROM pages")
def str09_basename(spark, d):
    return table(spark, d, "pages").select("page_id", strings.basename(F.col("url")).alias("base"))


@query("SELECT page_id, CASE WHEN url LIKE '%?%page=%' THEN regexp_extract(url, '[?&]page=([^&#]*)', 1) END AS page FROM pages")
def str10_query_option(spark, d):
    return table(spark, d, "pages").select("page_id", strings.query_option(F.col("url"), "page").alias("page"))


@query("SELECT event_id, regexp_full_match(v, '\\s*[+-]?[0-9]+(_[0-9]+)*\\s*') AS is_int FROM (SELECT event_id, (['12',' +3 ','4.0','x','1_000','_1',''])[(event_id % 7 + 1)::INT] AS v FROM events)")
def str11_looks_int(spark, d):
    v = F.get(F.array(*map(F.lit, ("12", " +3 ", "4.0", "x", "1_000", "_1", ""))), (F.col("event_id") % 7).cast("int"))
    return table(spark, d, "events").select("event_id", strings.looks_int(v).alias("is_int"))


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END, ''), nullif(source, ''), '') AS val FROM documents")
def str12_first_filled(spark, d):
    return table(spark, d, "documents").select("doc_id", strings.first_filled(F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")), F.col("source")).alias("val"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE event_id / 4.0 END::DOUBLE AS x FROM events")
def str13_float_or(spark, d):
    v = F.when(F.col("event_id") % 3 == 0, "").otherwise((F.col("event_id") / 4).cast("string"))
    return table(spark, d, "events").select("event_id", strings.float_or(v, 0.5).cast("double").alias("x"))


@query("""SELECT event_id, event_id % 4 IN (0, 1) AS ok FROM events""")
def str14_offset_time(spark, d):
    v = F.get(F.array(*map(F.lit, ("2024-02-03T04:05:06Z", "2024-02-03T04:05:06+02:00", "2024-02-03T04:05:06", "2024-13-03T04:05:06Z"))), (F.col("event_id") % 4).cast("int"))
    return table(spark, d, "events").select("event_id", strings.has_offset_time(v).alias("ok"))


@query("SELECT page_id, list_extract(string_split_regex(url, '[\\\\/]'), -2) AS parent FROM pages")
def str15_parent(spark, d):
    return table(spark, d, "pages").select("page_id", strings.parent_name(F.col("url")).alias("parent"))


@query("SELECT p_partkey, (['a','a.b','c','x'])[(p_partkey % 4 + 1)::INT] AS stem FROM part")
def str16_archive_stem(spark, d):
    v = F.get(F.array(*map(F.lit, ("a.tar.gz", "a.b.zip", "c.TAR.BZ2", "x"))), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, d, "part").select("p_partkey", strings.archive_stem(v).alias("stem"))


@query("SELECT p_partkey, p_partkey % 7 = 0 AS safe FROM part")
def str17_safe_member(spark, d):
    v = F.get(F.array(*map(F.lit, ("a/b.txt", "/a", "../a", "a/../b", "C:/a", "a\\b", ""))), (F.col("p_partkey") % 7).cast("int"))
    return table(spark, d, "part").select("p_partkey", strings.is_safe_member(v).alias("safe"))


@query(f"SELECT doc_id, {HASH.format('text')} AS h FROM documents")
def hash01_stable(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.stable_hash(F.col("text")).alias("h"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {HASH.format(chr(39) + 'documents::' + chr(39) + ' || lang || ' + chr(39) + '::' + chr(39) + ' || source')} ELSE {HASH.format('doc_id::VARCHAR')} END AS example_id FROM documents")
def hash02_example_id(spark, d):
    split = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    return table(spark, d, "documents").select("doc_id", hashing.example_id(F.lit("documents"), split, F.col("source"), F.col("doc_id").cast("string")).alias("example_id"))


@query(f"SELECT event_id, {HASH.format('props')} AS view_id FROM events")
def hash03_view_key(spark, d):
    return table(spark, d, "events").select("event_id", hashing.view_key(F.col("props")).alias("view_id"))


@query("""SELECT doc_id, (7 % 2147483647)::BIGINT AS s0, ((7::BIGINT * 1103515245 + doc_id + 1000003) % 2147483647)::BIGINT AS s1, ((5 + doc_id) % 2147483647)::BIGINT AS a1 FROM documents""")
def hash06_seeds(spark, d):
    (s0, s1), (_, a1) = hashing.image_seed(7, F.col("doc_id"), 1000003), hashing.audio_seed(3, 5, F.col("doc_id"))
    return table(spark, d, "documents").select("doc_id", s0.alias("s0"), s1.alias("s1"), a1.alias("a1"))


@query(f"""SELECT e AS epoch, {HASH.format("'[' || chr(34) || 'replay-1' || chr(34) || ',42,' || e::VARCHAR || ',0]'")} AS seed FROM (SELECT DISTINCT (event_id % 10)::BIGINT AS e FROM events)""")
def hash07_epoch_seed(spark, d):
    epochs = table(spark, d, "events").select((F.col("event_id") % 10).alias("epoch")).distinct()
    text = F.concat(F.lit('["replay-1",42,'), F.col("epoch").cast("string"), F.lit(",0]"))
    return epochs.select("epoch", hashing.stable_hash(text).alias("seed"))


@query("SELECT vec_id, pos::BIGINT AS pos, CASE WHEN pos = label THEN 0.91 ELSE 0.01 END::DOUBLE AS y FROM embeddings, range(10) t(pos)")
def lab02_one_hot(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(F.transform(labels.one_hot(F.col("label"), 10, 0.1), lambda v: F.round(v, 6))).alias("pos", "y")).select("vec_id", F.col("pos").cast("long").alias("pos"), "y")


@query("SELECT c_custkey, pos::BIGINT AS pos, CASE WHEN pos IN (c_nationkey % 5, c_custkey % 5) THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM customer, range(5) t(pos)")
def lab03_multi_hot(spark, d):
    y = labels.multi_hot(F.array((F.col("c_nationkey") % 5).cast("int"), (F.col("c_custkey") % 5).cast("int")), 5)
    return table(spark, d, "customer").select("c_custkey", F.posexplode(y).alias("pos", "y")).select("c_custkey", F.col("pos").cast("long").alias("pos"), "y")


@query("""SELECT user_id, f::BIGINT AS frame, k::BIGINT AS class_id, max(CASE WHEN f >= floor(s / 0.5) AND f < greatest(least(ceil(t / 0.5), 8), least(floor(s / 0.5) + 1, 8)) AND l = k THEN 1.0 ELSE 0.0 END)::DOUBLE AS y
FROM (SELECT user_id, (event_id % 7) / 2.0 AS s, (event_id % 7) / 2.0 + (event_id % 3) / 4.0 AS t, event_id % 4 AS l FROM events), range(8) a(f), range(4) b(k) GROUP BY ALL""")
def lab04_event_frames(spark, d):
    e = table(spark, d, "events").select("user_id", F.struct(((F.col("event_id") % 7) / 2).alias("start"), ((F.col("event_id") % 7) / 2 + (F.col("event_id") % 3) / 4).alias("end"), (F.col("event_id") % 4).alias("label")).alias("e"))
    y = e.groupBy("user_id").agg(F.collect_list("e").alias("es")).select("user_id", labels.event_frames(F.col("es"), 4, 8, 0.5).alias("y"))
    y = y.select("user_id", F.posexplode("y").alias("frame", "r")).select("user_id", F.col("frame").cast("long").alias("frame"), F.posexplode("r").alias("class_id", "y"))
    return y.withColumn("class_id", F.col("class_id").cast("long"))


@query("SELECT vec_id, pos::BIGINT AS pos, round(CASE WHEN pos = label THEN 1.0 ELSE 0.0 END * 0.8 + 0.2 / 10, 6)::DOUBLE AS y FROM embeddings, range(10) t(pos)")
def lab05_smooth(spark, d):
    y = labels.smooth(labels.one_hot(F.col("label"), 10), 10, 0.2)
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(F.transform(y, lambda v: F.round(v, 6))).alias("pos", "y")).withColumn("pos", F.col("pos").cast("long"))


@query("""SELECT vec_id, pos::BIGINT AS pos, round(0.7 * (CASE WHEN pos = label THEN 1.0 ELSE 0.0 END) + 0.3 * (CASE WHEN pos = (label + 1) % 10 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS y FROM embeddings, range(10) t(pos)""")
def lab07_blend(spark, d):
    a, b = labels.one_hot(F.col("label"), 10), labels.one_hot((F.col("label") + 1) % 10, 10)
    y = labels.blend(a, b, F.lit(0.7))
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(F.transform(y, lambda v: F.round(v, 6))).alias("pos", "y")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS best FROM embeddings")
def lab10_argmax(spark, d):
    return table(spark, d, "embeddings").select("vec_id", labels.argmax(F.col("embedding")).alias("best"))


@query("SELECT doc_id, (['bad','good'])[quality + 1] AS name FROM labels")
def join09_class_name(spark, d):
    return table(spark, d, "labels").select("doc_id", labels.class_name(F.col("quality"), ["bad", "good"]).alias("name"))


@query("SELECT page_id, md5(html) AS md5, sha256(html) AS sha FROM pages")
def src16_checksum(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5("html").alias("md5"), F.sha2("html", 256).alias("sha"))
