"""Job lists. The lists of models, styles, seeds and cameras are parameters and short; experiments are a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameline.functions.text import command_line, job_id, number_token, overridden
from frameline.operators.ordering import in_order

AXES = ("g", "v0", "h0")


def _each(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def job_manifest(exps: DataFrame, exp: str, place: str, models: list[str], styles: list[str], seeds: list[int]) -> DataFrame:
    """A job for every experiment, model, style and seed, with the places of each in its list."""
    jobs = exps.select(exp, place, F.posexplode(_each(models)).alias("model_at", "model"))
    jobs = jobs.select("*", F.posexplode(_each(styles)).alias("style_at", "style"))
    jobs = jobs.select("*", F.posexplode(_each(seeds)).alias("seed_at", "seed"))
    return jobs.withColumn("id", job_id(F.col(exp), F.col("model"), F.col("style"), F.concat(F.lit("s"), F.col("seed"))))


def allowed_jobs(exps: DataFrame, models: list[str], styles: list[str], repeats: int, first: int) -> DataFrame:
    """(id, exp, model, style, seed) of experiments (exp, place, models, styles, seed), whose lists and seed may be null.

    A list of an experiment's own is taken in its order, without what is not offered. An own seed counts for all jobs of its experiment. The
    others are numbered on from ``first`` over the jobs before them, and never below one more than a seed used before. Job numbers come from the sizes
    of the experiments before, so only the list of experiments, one document, is put in order as a whole."""

    def chosen(own: str, offered: list[str]) -> Column:
        return F.coalesce(F.filter(own, lambda v: v.isin(offered)), _each(offered))

    picked = exps.select("exp", "place", F.col("seed").alias("own"), chosen("models", models).alias("models"), chosen("styles", styles).alias("styles"))
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sized = picked.withColumn("n", F.size("models") * F.size("styles") * repeats)
    sized = sized.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    raised = F.when(F.col("n") > 0, F.col("own") - F.col("start"))  # what an own seed adds to the numbers after its first job
    base = F.greatest(F.lit(first), F.max(raised).over(before)) + F.col("start")
    jobs = sized.select("exp", "place", "own", base.alias("base"), "styles", F.posexplode("models").alias("m", "model"))
    jobs = jobs.select("*", F.size("styles").alias("n_styles"), F.posexplode("styles").alias("s", "style"))
    jobs = jobs.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("r"))
    number = F.col("base") + (F.col("m") * F.col("n_styles") + F.col("s")) * repeats + F.col("r")
    jobs = jobs.withColumn("seed", F.coalesce("own", number).cast("long"))
    return jobs.select(job_id(F.col("exp"), F.col("style"), F.col("model"), F.concat(F.lit("s"), F.col("seed"))).alias("id"), "exp", "model", "style", "seed")


def requested_variants(offered: DataFrame, requests: DataFrame) -> DataFrame:
    """(exp, place, variant): of requests (exp, variants) the variants in the order asked for, repeated ones too, or all that are offered (exp, place, variant), in
    their order, where the list is null or empty. A variant that its experiment does not offer ends the query."""
    none = F.coalesce(F.size("variants"), F.lit(0)) <= 0
    asked = requests.filter(~none).select("exp", F.posexplode("variants").alias("place", "variant"))
    known = asked.join(offered.select("exp", "variant", F.lit(True).alias("__known")).distinct(), ["exp", "variant"], "left")
    unknown = F.raise_error(F.concat(F.lit("unknown variant of "), F.coalesce(F.col("exp"), F.lit("null")), F.lit(": "), F.coalesce(F.col("variant"), F.lit("null"))))
    named = known.select("exp", F.col("place").cast("long").alias("place"), F.when(F.col("__known"), F.col("variant")).otherwise(unknown).alias("variant"))
    return named.unionByName(requests.filter(none).select("exp").join(offered, "exp").select("exp", F.col("place").cast("long").alias("place"), "variant"))


def with_variant(jobs: DataFrame, variants: DataFrame, base: str, variant: str, default: str = "default") -> DataFrame:
    """Adds ``parameters``: the map ``base`` with the values of the job's variant, from variants (exp, variant, values), over it. The default has none; another name that its experiment does not have ends the query."""
    named = variants.select("exp", F.col("variant").alias(variant), F.col("values").alias("__values"))
    unknown = F.raise_error(F.concat(F.lit("unknown variant: "), F.coalesce(F.col(variant), F.lit("null"))))
    chosen = F.when(F.col(variant) == default, F.col(base)).when(F.col("__values").isNull(), unknown).otherwise(overridden(F.col(base), F.col("__values")))
    return jobs.join(named, ["exp", variant], "left").withColumn("parameters", chosen).drop("__values")


def prompt_files(jobs: DataFrame, names: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Adds ``prompt_file``: the path below ``root`` of the file that names (exp, file) gives for the job's experiment, if files (path) has it; else null."""
    there = files.select(F.col("path").alias("prompt_file")).distinct()
    path = names.select("exp", F.concat(F.lit(f"{root}/"), "file").alias("prompt_file"))
    return jobs.join(path.join(there, "prompt_file"), "exp", "left")


def image_manifest(variants: DataFrame, files: DataFrame, folder: Column, image: str, model: str, first: int, repeats: int) -> DataFrame:
    """Jobs of every variant (exp, variant, target) and seed from a starting image; ``folder`` is the variant's and ``files`` has (path).
    A video and a prompt beside the image are named if they are there. A variant without its image gives one row with an error instead."""
    rows = variants.withColumn("folder", folder)
    for name, file in (("image", image), ("video", "seed_10frames.mp4"), ("prompt", "prompt.md")):
        there = files.select(F.col("path").alias(name)).distinct()
        rows = rows.join(there, there[name] == F.concat("folder", F.lit(f"/{file}")), "left")
    missing = F.col("image").isNull()
    seeds = F.when(missing, F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(first), F.lit(first + repeats - 1)))
    rows = rows.select("*", F.explode(seeds).alias("seed"))
    job = F.when(~missing, F.concat_ws("_", "exp", "variant", F.lit(model), F.concat(F.lit("s"), F.col("seed"))))
    error = F.when(missing, F.concat(F.lit("FileNotFoundError: "), F.col("folder"), F.lit(f"/{image}")))
    return rows.select("exp", "variant", "target", job.alias("job_id"), "seed", "image", "video", "prompt", error.alias("error"))


def build_commands(scripts: DataFrame, program: str, out: str) -> DataFrame:
    """(exp, variant, command): of scripts (exp, version, script, stem, variants), a command for every variant, whose map's keys are their names."""
    rows = scripts.select("*", F.explode(F.map_keys("variants")).alias("variant"))
    file = F.concat(F.concat_ws("/", F.lit(out), "version", "exp", "variant", "stem"), F.lit("_"), F.col("variant"), F.lit(".blend"))
    parts = [F.lit(program), F.lit("-b"), F.lit("--python"), F.concat_ws("/", "version", "script"), F.lit("--"), F.lit("--variant-id"), F.col("variant"), F.lit("--output-file"), file]
    return rows.select("exp", "variant", command_line(F.array(*parts)).alias("command"))


def with_counter(jobs: DataFrame, order: list[str], name: str, first: int) -> DataFrame:
    """Numbers all rows in order, by written ranges and their ends, so no task sees all rows."""
    return in_order(jobs, [], order, label="counter").withColumn(name, F.col("row_at") + first).drop("group_at", "row_at")


def sweep_manifest(base: DataFrame, sweeps: dict[str, list[float]]) -> DataFrame:
    """(id, job, axis, value, parameters): one parameter changed at a time; axes that can't be swept are left out."""
    points = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(float(v)).alias("value")) for a, vs in sweeps.items() if a in AXES for v in vs])
    rows = base.select("id", "base", F.explode(points).alias("p")).select("id", "base", "p.*")
    return rows.select("id", job_id(F.col("id"), F.col("axis"), number_token(F.col("value"))).alias("job"), "axis", "value", overridden(F.col("base"), F.create_map("axis", "value")).alias("parameters"))


def render_plan(scenes: DataFrame, cameras: list[str], done: DataFrame, key: str) -> DataFrame:
    """(key, camera) that are not done yet."""
    return scenes.select(key, F.explode(_each(cameras)).alias("camera")).join(done.select(key, "camera"), [key, "camera"], "left_anti")
