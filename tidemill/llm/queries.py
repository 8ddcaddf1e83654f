"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._shared import table
from tidemill.llm.ann import nearest_neighbours
from tidemill.llm.jaccard_join import jaccard_components
from tidemill.llm.mixing import pfair_mix
from tidemill.llm.near_vectors import near_vectors
from tidemill.llm.piece_sampling import sample_pieces
from tidemill.llm.pii import find_pii
from tidemill.llm.quality import fit, quality_scores
from tidemill.llm.substring_dedup import substring_dedup
from tidemill.llm.token_output import token_output
from tidemill.llm.warc import warc_round_trip


def op1_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit(docs, table(spark, sf_dir, "labels")))


def op3_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sample_pieces(table(spark, sf_dir, "documents"), model=public_tokenizers.path("piece_bpe_32k.model"), ids=True)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pfair_mix,
        op2_quality_classifier,
        op3_piece_sampling,
        op4_pii,
        op5_substring_dedup,
        op6_nearest_neighbours,
        op7_warc,
        op8_near_vectors,
        op9_jaccard_join,
        op10_token_output,
    )
}
_WORDS = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

_SUBSTRINGS = f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
starts AS (SELECT doc_id, unnest(range(len(ws) - 34)) AS k, ws FROM d WHERE len(ws) >= 35),
keyed AS (SELECT doc_id, k, md5(array_to_string(ws[k + 1:k + 35], ' ')) AS h FROM starts),
twice AS (SELECT h FROM keyed GROUP BY h HAVING count(*) > 1),
hot AS (SELECT DISTINCT doc_id, k FROM keyed SEMI JOIN twice USING (h)),
places AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM d),
marked AS (SELECT places.doc_id, i, w, max(CASE WHEN hot.k IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY places.doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM places LEFT JOIN hot ON hot.doc_id = places.doc_id AND hot.k = places.i),
kept AS (SELECT doc_id, count(*) AS n, sum(gone) AS r, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS t FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {i + 1}, 5))::INT >> {b}) & 31) + 1, 1)" for i in range(0, 40, 5) for b in (15, 10, 5, 0))

_PAGES = f"""SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)"""

#: Least node reachable over links (a, b), both directions, from every node.
_REACH = """reach AS (SELECT id AS node, id AS seen FROM nodes UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)"""

_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id WHERE list_cosine_similarity(p.e, q.e) >= 0.93),
nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH}
SELECT node AS vec_id, (SELECT count(*) FROM links WHERE a = node)::BIGINT AS n_links, component_id, node = component_id AS kept FROM least"""

_JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 4 THEN ws ELSE ws[k + 1:k + 4] END, ' ') AS g FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 3, 1))) AS k FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
pairs AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * pairs.c >= 85 * (x.c + y.c - pairs.c)),
nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT node AS doc_id, coalesce(c, 0)::BIGINT AS n_shingles, component_id FROM least LEFT JOIN n ON n.doc_id = node"""

#: Where SQL can express an operator; it is held against these on the driver's tables, and all against brute force.
ORACLES: dict[str, str] = {
    "op5_substring_dedup": _SUBSTRINGS,
    "op7_warc": _PAGES,
    "op8_near_vectors": _VECTORS,
    "op9_jaccard_join": _JACCARD,
}
