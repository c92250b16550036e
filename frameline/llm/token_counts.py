"""Exact token counts with a cache keyed by content and tokenizer-version digests.

``count_tokens`` joins each row's content digest to a stored table of counts, encodes only the distinct digests
that the table lacks, appends them, and joins the counts back. The cache is a Parquet table that may be kept
between runs and shared by jobs: a digest that two jobs append at once is read once.

Edge cases: a null text counts as the empty text (0 bytes, 0 tokens); repeated rows each get a row; texts of any length are
encoded whole; equal texts, which are the only ties, share one count; an empty table gives an empty result; other columns
pass through only if asked for in ``keep``, and one that is named like a result is called ``<name>_kept``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameline.llm.common import kept, scratch_path, written

CACHE_SCHEMA = "content binary, version string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the library that reads it."""
    import sentencepiece
    import tokenizers

    with open(path, "rb") as f:
        body = f.read()
    lib = sentencepiece.__version__ if path.endswith(".model") else tokenizers.__version__
    return hashlib.sha256(body + lib.encode()).hexdigest()


def _counter(path: str, body: bytes):
    """A function from a list of texts to their token counts."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=body)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(body.decode("utf-8"))
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: [len(x) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]


def encode_misses(misses: DataFrame, path: str, version: str, slice_bytes: int = 4 << 20) -> DataFrame:
    """``misses(content, body)`` to ``CACHE_SCHEMA``. Texts are encoded in slices of ``slice_bytes``, which bounds memory."""
    with open(path, "rb") as f:
        vocabulary = misses.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path, vocabulary.value)
        for batch in batches:
            texts, counts, part, size = batch.column("body"), [], [], 0
            for t in texts:
                part.append(t.as_py())
                size += len(part[-1])
                if size >= slice_bytes:
                    counts += count(part)
                    part, size = [], 0
            counts += count(part) if part else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())],
                names=["content", "version", "n_tokens"],
            )

    return misses.select("content", "body").mapInArrow(run, CACHE_SCHEMA)


def stored_counts(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """The cache's rows of one tokenizer version, one for each digest; a cache that does not exist yet is empty."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], CACHE_SCHEMA).select("content", "n_tokens")
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("version") == version)
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, text: str, tokenizer_path: str, cache_path: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns, ``n_bytes`` and ``n_tokens`` for each row of ``docs``.

    Byte-level vocabularies change nothing in a text, so the normalised content is the text with null as empty.
    Texts are counted whole. ``cache_path=None`` starts a cache of its own in the shared folder.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    cache_path = cache_path or scratch_path(spark, "token-counts")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    columns = kept(keep, ["n_bytes", "n_tokens", "__content", "__body"])
    keyed = docs.select(*columns, F.octet_length(body).cast("long").alias("n_bytes"), F.unhex(F.sha2(body, 256)).alias("__content"), body.alias("__body"))
    keep = keyed.columns[: len(columns)]
    known = stored_counts(spark, cache_path, version)
    misses = keyed.select(F.col("__content").alias("content"), F.col("__body").alias("body")).join(known, "content", "left_anti").dropDuplicates(["content"])
    encode_misses(misses, tokenizer_path, version).write.mode("append").parquet(cache_path)
    # Written, so that the join below is one of two plain shuffles, in which Spark splits a digest that many rows share.
    counts = written(stored_counts(spark, cache_path, version), "token-counts-read")
    return keyed.drop("__body").join(counts.select(F.col("content").alias("__content"), "n_tokens"), "__content", "left").select(*(F.col(f"`{k}`") for k in keep), "n_bytes", "n_tokens")
