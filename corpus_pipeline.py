"""From raw documents to encoded training text: language identification, near duplicates, benchmark leaks, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which ``run`` writes as Parquet and reads as the next one's
``docs``. All but the last keep the columns of ``documents``. A stage only leaves rows out for what it decides about them: no
rows are lost to null texts elsewhere, the language stage decides by text, whatever the row's id; the next two decide by id, so rows without an id pass them; repeated rows stay unless the
near-duplicate stage sees them as one document's copies, and an empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameline.llm.common import scratch_path, table
from frameline.llm.decontaminate import find_leaks
from frameline.llm.language_id import UNDETERMINED, fit_profiles, predict_language
from frameline.llm.ngram_join import jaccard_components
from frameline.llm.piece_codec import text_digests

LEAST_LIKENESS = 0.35  # of a learned language's own texts, 1 on average; see the README for what was measured on either side
SMALL_SIDE = 500_000  # ids or digests that may be broadcast (about 50 MB); more are joined by shuffle
WORDS = 120_000  # that a worker remembers while it encodes, beside what the stages before have left of an executor's memory


def without(docs: DataFrame, key: str, rejected: DataFrame) -> DataFrame:
    few = rejected.limit(SMALL_SIDE + 1).count() <= SMALL_SIDE
    return docs.join(F.broadcast(rejected) if few else rejected, key, "left_anti").select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out texts without a letter and texts that are like no learned language."""
    profile = fit_profiles(docs, "text", "lang")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)  # the decision is about a text, whatever its row's id
    found = predict_language(docs.select("text", digest.alias("digest")), "text", profile, keep=["digest"], likeness=True)
    rejected = found.filter((F.col("lang_pred") == UNDETERMINED) | (F.col("likeness") < LEAST_LIKENESS)).select("digest").distinct()
    path = scratch_path(spark, "no-language")
    rejected.write.parquet(path)
    return without(docs.withColumn("digest", digest), "digest", spark.read.schema(rejected.schema).parquet(path)).select(*docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of texts linked at a Jaccard of 0.8 of five-word shingles."""
    found = jaccard_components(docs, "doc_id", "text", n=5, num=80, den=100)
    extra = found.filter("doc_id <> component_id").select("doc_id").distinct()
    path = scratch_path(spark, "near-duplicates")
    extra.write.parquet(path)
    return without(docs, "doc_id", spark.read.schema(extra.schema).parquet(path))


def free_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a benchmark item."""
    leaks = find_leaks(docs, "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    path = scratch_path(spark, "leaked")
    leaks.select("doc_id").distinct().write.parquet(path)
    return without(docs, "doc_id", spark.read.schema("doc_id long").parquet(path))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text by the SentencePiece vocabulary, as counts and digests of ids and decoded text."""
    return text_digests(docs, "text", public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"], WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language identification", known_language),
    ("near duplicates", one_of_near_duplicates),
    ("benchmark decontamination", free_of_benchmarks),
    ("sentencepiece encoding", encoded),
]

# The stages cannot be written in SQL; they are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch_path(spark, "stage")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
