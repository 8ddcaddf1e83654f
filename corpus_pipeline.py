"""documents -> a training corpus: STAGES in order, each written and read again before the next.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of documents: the quality classifier and the near-duplicate join drop rows, the search for personal data
rewrites texts, mixing sets the order of the files. The last gives sampled segmentations of every text, each with
the place of its document in that order (``mix_position``): the mixture is read by it, its start holds the targets.
"""

from __future__ import annotations

import itertools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._shared import shared_dir, stage, table
from tidemill.llm.jaccard_join import jaccard_components
from tidemill.llm.mixing import in_mixed_order, with_file_order
from tidemill.llm.piece_sampling import sample_pieces
from tidemill.llm.pii import without_pii
from tidemill.llm.quality import fit, keep_good


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.7 or more, by a network fitted on the labelled ones among ``docs``.

    A null text is scored as an empty one. Without labels of both kinds nothing can be learned and nothing is dropped.
    """
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the least doc_id.

    A key that repeats with different texts is as many documents, each told by a hash of key and text; of rows that
    are equal in both, one stays. Rows without a key take no part and stay. An empty table stays empty.
    """
    node = next(n for n in (f"_node{k}" for k in itertools.count()) if n not in docs.columns)
    keyed = docs.filter("doc_id is not null").select("*", F.xxhash64("doc_id", "text").alias(node))
    found = jaccard_components(keyed, key=node).select(F.col("doc_id").alias(node), "component_id").distinct()
    least = keyed.select("doc_id", node).join(found, node).groupBy("component_id").agg(F.min(F.struct("doc_id", node))[node].alias(node))
    kept = keyed.join(least.select(node), node, "left_semi").dropDuplicates([node])
    return kept.select(*docs.columns).union(docs.filter("doc_id is null"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind; n_chars follows. A null text stays null."""
    return without_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in files that follow the mixture of sources to their target weights.

    Null sources are one source, null keys and texts rows like others; an empty table stays empty.
    """
    return in_mixed_order(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every text, with their piece ids and the document's place in the mixture.

    A null or empty text has one, of no pieces; an empty table gives no rows.
    """
    return sample_pieces(with_file_order(docs), model=public_tokenizers.path("piece_bpe_32k.model"), ids=True, carry="mix_position")


STAGES = [
    ("quality_classifier", keep_quality),
    ("jaccard_join", keep_distinct),
    ("pii", mask_pii),
    ("mixing", mix_sources),
    ("piece_sampling", encode_pieces),
]

#: A network, a component search and sampling are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), shared_dir(spark, "pipeline")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"{path}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
