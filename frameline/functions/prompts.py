"""Prompts as columns: texts of a task and case, put into the frame of a style, with the job's numbers in their places.

Texts are a table (task, case, part, text) and frames a table (style, frame); both may be a caller's own. ``{name}`` is a place: frames have places for parts,
texts for values. A task, style or experiment that is not offered, and a place that nothing fills, end the query with an error rather than with a wrong prompt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameline.functions.text import cycles_text, first_present, short_number

SIDE, FRONT = "A still camera looks at the scene from the side.", "A still camera looks at the scene from the front."
# Texts of each task; a null case holds for all cases of its task.
TEXTS: list[tuple[str, str | None, str, str]] = [
    ("free_fall", None, "camera", SIDE),
    ("free_fall", None, "subject", "one {colour} {object}"),
    ("free_fall", None, "start", "The {object} hangs at {h0} m above the floor and touches nothing."),
    ("free_fall", "rest", "motion", "It is let go from rest and drops straight down, faster and faster."),
    ("free_fall", "thrown", "motion", "It sets out vertically at {fall_v0} m/s and keeps to one vertical line."),
    ("free_fall", None, "quantities", "Gravity is {g} m/s^2, the height {h0} m, the first vertical speed {fall_v0} m/s; there is no air."),
    ("free_fall", None, "limits", "There is no bounce and no sideways motion."),
    ("projectile", None, "camera", SIDE),
    ("projectile", None, "subject", "one {colour} {object}"),
    ("projectile", "level", "start", "The {object} rolls along a flat table at {y0} m and comes to its edge."),
    ("projectile", "level", "motion", "It leaves the edge level at {vx} m/s and falls along a parabola."),
    ("projectile", "upward", "start", "The {object} starts at ({x0}, {y0}) m at {speed} m/s, {degrees} degrees above level."),
    ("projectile", "upward", "motion", "It rises to one highest point and falls again, {vx} m/s sideways all the way and {vy} m/s upwards at first."),
    ("projectile", None, "quantities", "Gravity is {g} m/s^2, the speeds at first {vx} m/s along and {vy} m/s up; there is no air."),
    ("projectile", None, "limits", "It does not bounce and touches nothing on its way."),
    ("spring", None, "camera", FRONT),
    ("spring", None, "subject", "one {colour} {object} on a level spring"),
    ("spring", None, "start", "The {object} is held {amplitude} m from its place of rest."),
    ("spring", None, "motion", "It swings to and fro on a line, {spring_cycles} times, at {omega} rad/s."),
    ("spring", None, "quantities", "The spring has {k} N/m, the mass is {m} kg, the phase {phi} rad."),
    ("spring", None, "limits", "Nothing rubs and nothing pushes; the amplitude stays."),
    ("pendulum", None, "camera", FRONT),
    ("pendulum", None, "subject", "one {colour} {object} on a thin dark string"),
    ("pendulum", None, "start", "The string of {length} m is held at {theta} degrees."),
    ("pendulum", None, "motion", "The {object} swings through its lowest point, {pendulum_cycles} times."),
    ("pendulum", None, "quantities", "Gravity is {g} m/s^2, the string {length} m, the phase {phi} rad."),
    ("pendulum", None, "limits", "The pivot stays, the string keeps its length, nothing damps the swing."),
    ("rotation", None, "camera", FRONT),
    ("rotation", None, "subject", "one {colour} {object} with a black mark from its middle to its rim"),
    ("rotation", None, "start", "The mark points to {theta0} degrees."),
    ("rotation", "steady", "motion", "It turns about its middle at {omega0} degrees per second throughout."),
    ("rotation", "faster", "motion", "It turns about its middle, at {omega0} degrees per second at first and faster all the time."),
    ("rotation", "slower", "motion", "It turns about its middle, at {omega0} degrees per second at first and slower all the time."),
    ("rotation", None, "quantities", "The angular speed is {omega0} degrees/s, the angular acceleration {alpha} degrees/s^2."),
    ("rotation", None, "limits", "Its middle stays where it is and its shape does not change."),
]
FRAMES = [
    ("short_raw", "{subject}. {camera} {start} {motion} {limits}"),
    ("structured_raw", "Subject: {subject}. Camera: {camera} Start: {start} Motion: {motion} Quantities: {quantities} Limits: {limits}"),
    ("structured_detailed", "Subject: {subject}, easy to follow in every frame. Camera: {camera} Start: {start} Motion: {motion} Quantities: {quantities} Limits: {limits} Nothing else moves, and no writing is shown."),
]
# What a task's object is, where a job does not say.
LOOKS = {"free_fall": ("bright red", "matte ball"), "projectile": ("bright blue", "matte ball"), "spring": ("bright yellow", "rectangular block"), "pendulum": ("bright green", "pendulum bob"), "rotation": ("white", "flat circular disk")}
# Parameters where a job does not say.
DEFAULTS = {"g": 9.8, "h0": 3.0, "fall_v0": 0.0, "x0": 0.0, "y0": 1.2, "throw_v0": 3.0, "throw_vx": 2.0, "throw_vy": 0.0, "k": 8.0, "m": 1.0, "A": 0.2, "phi": 0.0, "L": 1.0, "theta_max": 10.0, "theta0": 0.0, "omega0": 90.0, "alpha": 0.0}


def filled(text: Column, values: Column) -> Column:
    """The text with each ``{name}`` that the map has replaced by its value, all at once for every row."""
    return F.aggregate(F.map_entries(values), text, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit("null"))))


def checked(text: Column, label: str = "prompt") -> Column:
    """The text, unless a place in it is still open, which ends the query."""
    return F.when(text.rlike(r"\{[A-Za-z0-9_]+\}"), F.raise_error(F.concat(F.lit(f"unfilled {label}: "), text))).otherwise(text)


def throw_of(params: Column) -> dict[str, Column]:
    """Speed, angle and both parts of a throw, which a job gives by either; a part alone takes the other's default."""
    value = lambda keys, default: first_present(params, keys, DEFAULTS[default])
    by_parts = F.map_contains_key(params, "v0x") | F.map_contains_key(params, "v0y")
    x, y, speed, degrees = value(["v0x"], "throw_vx"), value(["v0y"], "throw_vy"), value(["v0"], "throw_v0"), first_present(params, ["theta_deg", "theta"], 0.0)
    size = F.sqrt(x * x + y * y)
    return {
        "speed": F.when(by_parts, size).otherwise(speed), "degrees": F.when(by_parts, F.when(size > 1e-9, F.degrees(F.atan2(y, x))).otherwise(0.0)).otherwise(degrees),
        "vx": F.when(by_parts, x).otherwise(speed * F.cos(F.radians(degrees))), "vy": F.when(by_parts, y).otherwise(speed * F.sin(F.radians(degrees))),
    }


def task_case(task: Column, params: Column) -> Column:
    """Which of a task's cases the parameters are: from rest or thrown, level or upward, steady, faster or slower."""
    throw, alpha = throw_of(params), first_present(params, ["alpha_deg_s2", "alpha"], DEFAULTS["alpha"])
    fall = F.when(F.abs(first_present(params, ["v0"], DEFAULTS["fall_v0"])) < 1e-9, "rest").otherwise("thrown")
    thrown = F.when((F.abs(throw["vy"]) < 1e-6) | (F.abs(throw["degrees"]) < 1e-6), "level").otherwise("upward")
    turn = F.when(F.abs(alpha) < 1e-9, "steady").when(alpha > 0, "faster").otherwise("slower")
    return F.when(task == "free_fall", fall).when(task == "projectile", thrown).when(task == "rotation", turn).otherwise("any")


def prompt_numbers(params: Column) -> dict[str, Column]:
    """The numbers that fill the places of the texts: the job's own, and what follows from them."""
    value = lambda keys, default: first_present(params, keys, DEFAULTS[default])
    return {
        "g": value(["g"], "g"), "h0": value(["h0"], "h0"), "fall_v0": value(["v0"], "fall_v0"), "x0": value(["x0"], "x0"), "y0": value(["y0"], "y0"), **throw_of(params),
        "k": value(["k"], "k"), "m": value(["m"], "m"), "amplitude": value(["A"], "A"), "phi": value(["phi"], "phi"), "omega": F.sqrt(value(["k"], "k") / value(["m"], "m")), "length": value(["L"], "L"),
        "theta": value(["theta_max_deg", "Theta"], "theta_max"), "theta0": value(["theta0_deg"], "theta0"), "omega0": value(["omega0_deg_s", "omega0"], "omega0"), "alpha": value(["alpha_deg_s2", "alpha"], "alpha"),
    }


def prompt_words(task: Column, params: Column, words: Column) -> dict[str, Column]:
    """The words that fill the places of the texts."""
    value = lambda key: first_present(params, [key], DEFAULTS[key])
    seconds = F.try_element_at(params, F.lit("duration_s"))
    colour, thing = (F.coalesce(*[F.try_element_at(words, F.lit(k)), *[F.when(task == t, look[n]) for t, look in LOOKS.items()], F.lit("object")]) for n, k in enumerate(("color", "object_name")))
    cycles = {"spring_cycles": F.sqrt(value("k") / value("m")), "pendulum_cycles": F.sqrt(value("g") / value("L"))}
    return {"colour": colour, "object": thing, **{n: cycles_text(omega, seconds) for n, omega in cycles.items()}}


def template_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(TEXTS, "task string, case string, part string, text string"), spark.createDataFrame(FRAMES, "style string, frame string")


def build_prompts(jobs: DataFrame, texts: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds ``case`` and ``prompt`` to jobs (task, style, params: numbers by name, words: texts by name). Templates are documents, and so few that they are broadcast,
    each frame with the parts of each case in it. Jobs are small and their prompts are not, so they are spread over all tasks first; values are made once a job."""
    own = texts.filter("case IS NOT NULL").select("task", "case").distinct()
    cases = own.union(texts.select("task", F.lit("any").alias("case")).distinct())
    entry = F.struct(F.col("part"), F.col("text"))
    by_case = cases.join(F.broadcast(texts.withColumnRenamed("case", "only")), "task").filter("only IS NULL OR only = case").groupBy("task", "case").agg(F.map_from_entries(F.collect_list(entry)).alias("__parts"))
    whole = by_case.crossJoin(F.broadcast(frames)).select("task", "case", "style", filled(F.col("frame"), F.col("__parts")).alias("__text"))
    tasks = int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = jobs.repartition(tasks).withColumn("case", task_case(F.col("task"), F.col("params")))
    met = spread.join(F.broadcast(by_case.select("task", "case", F.lit(True).alias("__known"))), ["task", "case"], "left").join(F.broadcast(whole), ["task", "case", "style"], "left")
    words, numbers = prompt_words(F.col("task"), F.col("params"), F.col("words")), prompt_numbers(F.col("params"))
    kept = [*jobs.columns, "case", "__known", "__text"]
    valued = met.select(*kept, F.array(*words.values()).alias("__words"), F.array(*numbers.values()).alias("__numbers"))
    said = valued.select(*kept, F.concat("__words", F.transform("__numbers", short_number)).alias("__values"))
    text = F.col("__text")
    for at, name in enumerate([*words, *numbers]):
        text = F.replace(text, F.lit(f"{{{name}}}"), F.coalesce(F.get("__values", at), F.lit("null")))
    made = said.select(*jobs.columns, "case", "__known", text.alias("__text"))
    unknown = lambda what: F.raise_error(F.concat(F.lit(f"unsupported {what}: "), F.coalesce(F.col(what), F.lit("null"))))
    prompt = F.when(F.col("__known").isNull(), unknown("task")).when(F.col("__text").isNull(), unknown("style")).otherwise(checked(F.col("__text")))
    return made.select(*jobs.columns, "case", prompt.alias("prompt"))


def image_prompt(experiment: Column, hidden: Column, told: Column, supported: str = "v1_A", parameter: str = "g_hidden") -> Column:
    """A prompt that continues an image: gravity is named or has to be seen. Only free fall with a known gravity is supported; anything else ends the query."""
    start = "Go on from the given picture: the same ball, camera, background and light. The ball is already falling. It keeps to one smooth vertical line, without a bounce. "
    g = F.try_element_at(hidden, F.lit(parameter))
    said = F.when(told, F.concat(F.lit("Gravity is "), short_number(g), F.lit(" m/s^2, and the fall should show it."))).otherwise("Gravity is not told; it follows from the picture.")
    return F.when((experiment != supported) | experiment.isNull() | g.isNull(), F.raise_error(F.concat(F.lit("unsupported experiment: "), F.coalesce(experiment, F.lit("null"))))).otherwise(F.concat(F.lit(start), said))
