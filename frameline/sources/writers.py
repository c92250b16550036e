"""Writers of trajectories, documents, tables and logs. Every writer gives a folder of files, one for each task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameline.operators.summaries import ranking_lines


def write_trajectories(rows: DataFrame, path: str) -> None:
    """CSV with eight decimals, in order of frame and object across files."""
    numbers = ["time_s", "x", "y", "z", "rot_x", "rot_y", "rot_z"]
    held = [F.round(c, 8).alias(c) if c in rows.columns else F.lit(0.0).alias(c) for c in numbers]
    rows.select("frame", held[0], "object", *held[1:]).orderBy("frame", "object").write.mode("overwrite").option("header", True).csv(path)


def params_documents(rows: DataFrame, hidden: list[str], known: list[str]) -> DataFrame:
    """(experiment_id, document): JSON text; hidden and known parameters are picked by name, absent names are left out."""
    pick = lambda names: F.map_filter("all_physics", lambda k, _: k.isin(names))
    return rows.select("experiment_id", F.to_json(F.struct("experiment_id", "fps", "frame_end", pick(hidden).alias("hidden_params"), pick(known).alias("known_params"), "all_physics")).alias("document"))


def write_table(rows: DataFrame, path: str, empty: bool = False) -> None:
    """CSV with a header. Without rows nothing is written, and what is there stays; or (``empty``) a table without rows is."""
    if not empty and rows.isEmpty():
        return
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_documents(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """JSON lines added to a log that other jobs may add to."""
    rows.write.mode("append").json(path)


def write_ranking(rows: DataFrame, name: str, score: str, path: str) -> None:
    ranking_lines(rows, name, score).orderBy("rank").select("line").write.mode("overwrite").text(path)
