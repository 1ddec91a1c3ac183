"""A pipeline that makes tokens for training from raw documents.

``STAGES`` run in order; each reads what the stage before it kept, from Parquet. Toxic documents
and all but one of each class of near-duplicates go, personal data gives way to its kind, the
sources are mixed to their weights, and texts become token ids.

Defined results: null and empty texts are kept as documents without words, one of them at most, as
they are copies of each other, and a mix has no use for them; rows without id are kept by all stages
that remove rows but the mix; repeated rows count once behind the near-duplicate stage; very long texts
are read whole; an empty table goes through all stages; further columns of documents, whatever their
names, are kept up to the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm import bpe, mixing, pii, shingles, toxicity
from alphaloom.llm.common import read, stored
from alphaloom.llm.queries import vocabulary

#: SQL can't state the trained classifier, the fingerprints or the vocabulary's merges.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity classifier, trained on the labels, doesn't reject."""
    return toxicity.reject(docs, read(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each class of near-duplicates.

    Documents are linked from a similarity of 0.8 of their sets of five-word shingles on. The trie
    join of SimHash fingerprints proposes pairs up to five bits apart; pairs at 0.8 differ in up to
    fourteen, so MinHash bands propose the rest. Every pair is checked on the sets.
    """
    return shingles.deduplicate(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, identifiers in their texts replaced by their kind in brackets."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is used, in queue order."""
    return mixing.mixture(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_tokens, round_trip): token ids, and whether they decode to the text."""
    path = vocabulary()
    back = bpe.round_trip(docs, path)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return back.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_copies),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("bpe", tokenized),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
