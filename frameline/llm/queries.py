"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameline.llm.ann_index import nearest
from frameline.llm.common import ascii_lower, doc_mod, scratch_path, table
from frameline.llm.decontaminate import find_leaks
from frameline.llm.html_extract import extract_main_text
from frameline.llm.language_id import fit_profiles, predict_language
from frameline.llm.lm_mixing import score_texts
from frameline.llm.merkle import fold_proof, leaf_digest, merkle_proofs, proof_digest
from frameline.llm.ngram_join import jaccard_components
from frameline.llm.oracles import ORACLE_SQL as ORACLE_SQL
from frameline.llm.piece_codec import text_digests
from frameline.llm.preference_format import clean_turns, format_preferences, pairs_by_opening, whole_pairs
from frameline.llm.prefix_trie import numbered_turns, prefix_trie, rebuilt_turns
from frameline.llm.token_counts import count_tokens
from frameline.llm.toxicity import fit_machine, score_toxicity
from frameline.llm.warc import archive_pages


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (doc_mod("doc_id", 5) != 1).alias("in_training"))
    scores = score_texts(docs, "text", "in_training", ["doc_id"])
    return scores.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"), "html", keep=["page_id", "url"])


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = clean_turns(table(spark, sf_dir, "conversations"))
    rows = whole_pairs(format_preferences(turns, pairs_by_opening(turns)))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.format_string("%d-%d", s["start"], s["stop"])), ",")
    return rows.withColumns({c: F.when(F.col(c).isNotNull(), spans(c)) for c in ("chosen_spans", "rejected_spans")})


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"), "text", public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), "doc_id", "text", n=3, num=90, den=100)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive_pages(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (doc_mod("doc_id", 4) == 2).alias("held_out"))
    profile = fit_profiles(docs.filter(~F.col("held_out")), "text", "lang")
    return predict_language(docs, "text", profile, keep=["doc_id", "held_out"])


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_digests(table(spark, sf_dir, "documents"), "text", public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])


def op10_ann_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaf = lambda text: leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])
    changed = F.when(doc_mod("doc_id", 5) == 0, leaf(ascii_lower(F.col("text"))))
    leaves = docs.select("doc_id", "source", leaf(F.col("text")).alias("digest"), changed.alias("changed"))
    found = merkle_proofs(leaves, "source", "doc_id", "digest", ["doc_id", "changed"])
    folded = fold_proof(F.coalesce("changed", "leaf"), F.col("lefts"), F.col("rights"))
    found = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("lefts"), F.col("rights")).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", (doc_mod("doc_id", 5) == 0).alias("held_out")), table(spark, sf_dir, "labels")
    machine = fit_machine(docs, "doc_id", "text", labels.filter(doc_mod("doc_id", 5) != 0), "toxic")
    return score_toxicity(docs, "text", machine, ["doc_id", "held_out"])


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = numbered_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie(rebuilt_turns(turns), turns.filter("place = 0").select("conv_id"))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_html_extract": op2_html_extract,
    "op3_preference_format": op3_preference_format,
    "op4_token_counts": op4_token_counts,
    "op5_ngram_join": op5_ngram_join,
    "op6_warc": op6_warc,
    "op7_decontamination": op7_decontamination,
    "op8_language_id": op8_language_id,
    "op9_piece_codec": op9_piece_codec,
    "op10_ann_index": op10_ann_index,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_toxicity": op12_toxicity,
    "op13_prefix_trie": op13_prefix_trie,
}
