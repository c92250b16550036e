"""Filters by lists of names and lookups that prefer one candidate over another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameline.operators.fits import relative_error


def included(rows: DataFrame, lists: dict[str, Sequence[str]]) -> DataFrame:
    """Rows whose columns have one of the names listed for them; an empty list takes all."""
    for name, values in lists.items():
        rows = rows.filter(F.col(name).isin(list(values))) if values else rows
    return rows


def truth_errors(fits: DataFrame, keys: list[str], fitted: str, hidden: str) -> DataFrame:
    """(keys, parameter, estimate, truth, abs_error, rel_error) of a map of fitted parameters against a map of hidden ones.
    Parameters without a truth are left out; the relative error is null where the truth is next to nothing."""
    rows = fits.select(*keys, hidden, F.explode(fitted).alias("parameter", "estimate"))
    rows = rows.withColumn("truth", F.try_element_at(F.col(hidden), F.col("parameter"))).filter(F.col("truth").isNotNull())
    gap = F.abs(F.col("estimate") - F.col("truth"))
    return rows.select(*keys, "parameter", "estimate", "truth", gap.alias("abs_error"), relative_error(F.col("estimate"), F.col("truth")).alias("rel_error"))


def segment_of(rows: DataFrame, segments: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Adds ``place``, ``t0`` and ``t1`` of the first segment, by place, that holds the row's time, else of the last one.

    Segments are (keys, place, t0, t1), as many as one motion has phases: they travel as one array for each of the keys, and rows are neither
    multiplied nor ordered. Rows of keys without segments have nulls."""
    lists = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "t0", "t1"))).alias("__all"))
    met = rows.join(lists, keys, "left")
    t = F.col(time)
    held = F.get(F.filter("__all", lambda s: (s["t0"] <= t) & (t <= s["t1"])), F.lit(0))
    chosen = F.coalesce(held, F.try_element_at("__all", F.lit(-1)))
    return met.withColumn("__s", chosen).select(*rows.columns, "__s.place", "__s.t0", "__s.t1")


def preferred(jobs: DataFrame, files: DataFrame, candidates: Sequence[Column], path: str) -> DataFrame:
    """Adds ``path``: the first of the candidates, expressions over a job, that is among the files (path); null if none is."""
    rows, found = jobs, []
    for i, candidate in enumerate(candidates):
        there = files.select(F.col("path").alias(f"__c{i}")).distinct()
        rows = rows.join(there, there[f"__c{i}"] == candidate, "left")
        found.append(F.col(f"__c{i}"))
    return rows.withColumn(path, F.coalesce(*found)).drop(*[f"__c{i}" for i in range(len(found))])


def video_of_job(jobs: DataFrame, key: str, files: DataFrame, root: str) -> DataFrame:
    """Adds ``path`` and ``error``: a job's video in the folder of videos, else at the root, else the first by path anywhere below;
    a job without one has an error, and the others go on."""
    name = F.concat(F.col(key).cast("string"), F.lit(".mp4"))
    direct = preferred(jobs, files, [F.concat(F.lit(f"{root}/videos/"), name), F.concat(F.lit(f"{root}/"), name)], "__direct")
    mine = files.filter(F.startswith("path", F.lit(f"{root}/")))
    first = mine.groupBy(F.element_at(F.split("path", "/"), -1).alias("__name")).agg(F.min("path").alias("__first"))
    rows = direct.join(first, first["__name"] == name, "left").withColumn("path", F.coalesce("__direct", "__first"))
    error = F.when(F.col("path").isNull(), F.concat(F.lit("FileNotFoundError: missing video for job id: "), F.col(key).cast("string")))
    return rows.withColumn("error", error).drop("__direct", "__name", "__first")


def model_source(jobs: DataFrame, model: str, folders: DataFrame, root: str) -> DataFrame:
    """Adds ``source``: the folder of the model's last name below the root if it exists, the root if it exists and is that folder, else the model."""
    leaf = F.element_at(F.split(model, "/"), -1)
    own = F.when(leaf == root.rsplit("/", 1)[-1], F.lit(root))
    out = preferred(jobs, folders, [F.concat(F.lit(f"{root}/"), leaf), own], "__found")
    return out.withColumn("source", F.coalesce("__found", model)).drop("__found")
