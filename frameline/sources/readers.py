"""Readers of trajectory files, parameter documents, manifests and inventories, with declared schemas.

Missing columns are null; rows that can't be read as the schema keep what can be read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameline.functions.text import below, experiment_of_path, posix_path, variant_of_path
from frameline.operators.lookups import included

TRAJECTORY = "frame int, time_s double, object string, x double, y double, z double, rot_x double, rot_y double, rot_z double"
PARAMS = (
    "experiment_id string, level string, fps int, frame_end int, variant struct<variant_id: string, overrides: map<string, double>>, "
    "hidden_params map<string, double>, known_params map<string, double>, all_physics map<string, double>, "
    "cameras array<struct<name: string, location: array<double>, rotation_euler: array<double>, lens: double>>"
)
INVENTORY = "version string, experiment string, variant string, camera string, file string, bytes string"
CONFIG = "id string, task string, parameters map<string, string>, sweeps map<string, array<double>>"


def trajectories(spark: SparkSession, paths: str | list[str], rotations: bool = False) -> DataFrame:
    """(path, frame, time_s, object, x, y, z) of CSV files with a header; rotations only if asked for, so that they are not read otherwise."""
    rows = spark.read.schema(TRAJECTORY).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(paths)
    rows = rows.withColumn("path", F.col("_metadata.file_path"))
    return rows if rotations else rows.drop("rot_x", "rot_y", "rot_z")


def params(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Whole-file JSON documents, with their paths."""
    rows = spark.read.schema(PARAMS).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(paths)
    return rows.withColumn("path", F.col("_metadata.file_path"))


def manifest(spark: SparkSession, path: str, schema: str, most: int | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped. ``most`` keeps the first jobs in file order."""
    rows = spark.read.schema(schema).json(path)
    if most is None:
        return rows
    place = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"))
    return place.orderBy("__file", "__block", "__row").limit(most).drop("__file", "__block", "__row")


def configs(spark: SparkSession, path: str, task: str | None = None) -> DataFrame:
    """Entries of a JSON list; of entries with equal ids the last counts. Something else than a list gives rows without ids, which raise."""
    rows = spark.read.schema(CONFIG).option("multiLine", True).json(path).withColumn("place", F.monotonically_increasing_id())
    rows = rows if task is None else rows.filter(F.col("task") == task)
    last = rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), "place").alias("r"))
    checked = F.when(F.col("id").isNull(), F.raise_error(F.lit("a configuration is a list of entries with ids"))).otherwise(F.col("id"))
    return last.select(checked.alias("id"), "r.task", "r.parameters", "r.sweeps")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Quoted CSV of rendered files, with POSIX paths and sizes as numbers."""
    rows = spark.read.schema(INVENTORY).option("header", True).csv(path)
    return rows.withColumns({"file": posix_path(F.col("file")), "bytes": F.col("bytes").try_cast("long")})


def listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, modified, size) of files below a folder; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def paired_files(files: DataFrame, folder: str = "folder") -> DataFrame:
    """(folder, trajectory, params): the first file of each kind of every folder that has both."""
    by = files.withColumn(folder, F.regexp_replace("path", "/[^/]*$", "")).groupBy(folder)
    kinds = {"trajectory": "_trajectory.csv", "params": "_params.json"}
    first = by.agg(*[F.min(F.when(F.endswith("path", F.lit(end)), F.col("path"))).alias(k) for k, end in kinds.items()])
    return first.dropna(subset=list(kinds))


def truth_files(files: DataFrame, root: str, versions: list[str], experiments: list[str] = (), variants: list[str] = ()) -> DataFrame:
    """(version, experiment, variant, trajectory, params) of variants with both files at ``root/version/experiment/variant``. Empty filters of experiments and variants take all."""
    parts = F.split(below(F.col("path"), root), "/")
    placed = files.filter(F.size(parts) == 4).withColumns({n: F.get(parts, F.lit(k)) for k, n in enumerate(("version", "experiment", "variant"))})
    chosen = included(placed.filter(F.col("version").isin(list(versions))), {"experiment": experiments, "variant": variants})
    pairs = paired_files(chosen.select("path"))
    parts = F.split(below(F.col("folder"), root), "/")
    return pairs.select(*[F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(("version", "experiment", "variant"))], "trajectory", "params")


def preferred_file(files: DataFrame, exact: str = "trajectory.csv", never: str = "prompt.csv") -> DataFrame:
    """(folder, path): the exact name if a folder has it, else the first CSV by name other than ``never``."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.withColumns({"folder": F.regexp_replace("path", "/[^/]*$", ""), "name": name}).filter(F.endswith("path", F.lit(".csv")) & (F.col("name") != never))
    return rows.groupBy("folder").agg(F.min_by("path", F.struct(F.col("name") != exact, "name")).alias("path"))


def newest_file(files: DataFrame) -> DataFrame:
    """(folder, path): the last changed file of each folder, ties by name."""
    return files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def scene_files(files: DataFrame, root: str, versions: list[str], experiments: list[str] = (), variants: list[str] = (), baseline: bool = True) -> DataFrame:
    """(path, version, experiment, variant) of scenes: those of variants, and those directly in a version's folder. Empty filters take all."""
    path = below(F.col("path"), root)
    parts = F.split(path, "/")
    varied = (F.get(parts, F.lit(0)) == "variants") & (F.size(parts) > 2)
    rows = files.withColumns({"version": F.when(varied, F.get(parts, F.lit(1))).when(F.lit(baseline) & (F.size(parts) == 2), F.get(parts, F.lit(0))), "name": F.element_at(parts, -1)})
    rows = rows.filter(F.col("name").rlike(r"^baseline.*\.blend$")).withColumns({"experiment": experiment_of_path(F.col("path")), "variant": variant_of_path(path)})
    return included(rows.filter(F.col("version").isin(list(versions))), {"experiment": experiments, "variant": variants}).select("path", "version", "experiment", "variant")


def first_rows(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("__r") <= n).drop("__r")
