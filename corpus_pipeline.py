"""The corpus pipeline: quality filter, exact dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in
the shared folder and hands the reread table to the next stage. All but the last return the columns of
documents. The decisions: documents scored under 0.7 go; of equal texts the smallest doc_id stays; of
near-duplicates the smallest doc_id stays; the rows are put into the order of the mixture; every text is
encoded, its ids are decoded, and the digests of both keep the text's position in the mixture. Null texts count as empty, null ids keep their rows, an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import bpe, exact_dedup, mixing, quality, simhash
from orrery.llm.queries import tokenizer_path
from orrery.llm.shared import table, without_ids, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier does not reject; it learns from labels outside the held-out rows.

    Rows that share an id are one document, which goes if any of them is rejected.
    """
    scores = quality.quality_scores(docs, table(spark, sf_dir, "labels"))
    return without_ids(docs, "doc_id", written(scores.where("predicted = 0").select("doc_id").distinct(), "rejected"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of texts that share 0.8 or more of their five-word shingles."""
    return simhash.without_near_copies(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_order(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of each text, in the order of the mixture and with its position there.

    The same documents have the same mixture (rows without an id may swap places), so it is found anew over
    the digests, and no text is moved again.
    """
    digests = written(bpe.encoded_digests(docs, tokenizer_path("word_bpe_49k.json"), also=("source",)), "encoded")
    return mixing.mixed(digests).drop("source", "lane", "slot").orderBy("position")


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_tokens),
]
#: SQL has no quality model and no BPE; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
