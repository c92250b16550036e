"""Items that fail keep their place in a batch: a result or an error for each, from one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameline.storage import written


def parsed(rows: DataFrame, text: str, schema: str, out: str = "value", error: str = "error") -> DataFrame:
    """Adds ``out``, the JSON text as a struct, and ``error``: null, or why there is no value. A row that can't be read does not end the query."""
    read = F.from_json(F.col(text), f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    rows = rows.withColumn("__read", read)
    why = F.when(F.col(text).isNull(), F.lit("TypeError: no text")).when(F.trim(text) == "", F.lit("JSONDecodeError: empty text"))
    why = why.when(F.col("__read").isNull() | F.col("__read.__bad").isNotNull(), F.concat(F.lit("JSONDecodeError: "), F.substring(text, 1, 80)))
    return rows.withColumn(error, why).withColumn(out, F.when(F.col(error).isNull(), F.col("__read").dropFields("__bad"))).drop("__read")


def first_error(checks: list[tuple[Column, Column | str]]) -> Column:
    """The message of the first check that fails; null if none does. A check that is null counts as failed."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(said) if isinstance(said, str) else said) for ok, said in checks], F.lit(None).cast("string"))


def outcomes(rows: DataFrame, keys: list[str], checks: list[tuple[Column, Column | str]], results: dict[str, Column]) -> DataFrame:
    """(keys, results, error): the results of rows that pass all checks, and the first message of the others."""
    marked = rows.withColumn("error", first_error(checks))
    return marked.select(*keys, *[F.when(F.col("error").isNull(), value).alias(name) for name, value in results.items()], "error")


def split_outcomes(found: DataFrame, label: str = "outcomes") -> tuple[DataFrame, DataFrame]:
    """(results, errors): what succeeded without the error column, and what failed with it. The batch runs once; both read what it wrote."""
    kept = written(found, label)
    return kept.filter("error IS NULL").drop("error"), kept.filter("error IS NOT NULL")
