"""Scalar functions and lookups over parts, pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameline.functions import prompts as P
from frameline.functions import text as T
from frameline.views import r6, table

# Configuration names for the longest-prefix join.
PREFIXES = ("S", "STANDARD", "PROMO", "PROMO B", "ECONOMY", "SMALL", "SMALL PLATED", "MEDIUM", "LARGE")


def _part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part")


def token_format(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d).select("p_partkey", T.number_token((F.col("p_size") - 25) / 2.0).alias("token"))


def token_parse(spark: SparkSession, d: str) -> DataFrame:
    token = F.when(F.col("p_partkey") % 7 == 0, "bad").otherwise(T.number_token((F.col("p_size") - 25) / 2.0))
    return _part(spark, d).select("p_partkey", T.parse_number_token(token).alias("value"))


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    url = F.regexp_replace("url", "^https?://", "")
    return table(spark, d, "pages").select("page_id", F.size(F.split(url, "/")).alias("n_parts"), F.element_at(F.split(url, "/"), 1).alias("host"), T.stem(url).alias("stem"))


def color_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d).select("p_partkey", F.coalesce(T.colour_name(F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 3 == 0, "Dark BLUE").when(F.col("p_size") % 3 == 1, "white-red").otherwise(""))), F.lit("none")).alias("colour"))


def fmt_number(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d).select("p_partkey", T.short_number(F.col("p_size") / 8.0).alias("shown"))


def area_parse(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size"), F.lit("*"), F.col("p_size") + 3)).otherwise(F.col("p_size").cast("string"))
    return _part(spark, d).select("p_partkey", T.area_of(text).alias("area"))


def longest_prefix_join(spark: SparkSession, d: str) -> DataFrame:
    """The longest configuration name that a type starts with: an equality join on prefixes, not a pair of every two."""
    configs = spark.createDataFrame([(p, len(p)) for p in PREFIXES], "config string, size int")
    sizes = sorted({len(p) for p in PREFIXES})
    rows = _part(spark, d).select("p_partkey", "p_type", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size")).filter(F.length("p_type") >= F.col("size"))
    met = rows.withColumn("config", F.substring("p_type", F.lit(1), F.col("size"))).join(F.broadcast(configs), ["config", "size"])
    return met.groupBy("p_partkey").agg(F.max_by("config", "size").alias("config"))


def param_override(spark: SparkSession, d: str) -> DataFrame:
    base = F.create_map(F.lit("g"), F.lit(9.81), F.lit("e"), F.lit(0.5))
    own = F.create_map(F.lit("g"), F.col("p_size") / 2.0, F.lit("mu"), F.lit(0.1))
    m = T.overridden(base, own)
    return _part(spark, d).select("p_partkey", F.element_at(m, "g").alias("g"), F.element_at(m, "e").alias("e"), F.element_at(m, "mu").alias("mu"))


def projectile_parts(spark: SparkSession, d: str) -> DataFrame:
    vx, vz = T.polar_parts(F.col("p_size").cast("double"), F.col("p_partkey") % 90)
    return _part(spark, d).select("p_partkey", r6(vx).alias("vx"), r6(vz).alias("vz"), r6(F.degrees(F.atan2(vz, vx))).alias("angle"))


def command_lines(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d).select("p_partkey", T.command_line(F.array(F.lit("run"), F.lit("--name"), F.col("p_name"), F.lit("--size"), F.col("p_size").cast("string"))).alias("command"))


def prompt_build(spark: SparkSession, d: str) -> DataFrame:
    """Every part is a job of one of five tasks and three styles, with parameters from its size; odd sizes say how long the clip is."""
    size = F.col("p_size").cast("double")
    given = {"g": size / 5, "v0": F.col("p_size") % 3 * 1.5, "theta_deg": F.col("p_size") % 4 * 15.0, "k": size + 3, "L": size / 10, "alpha": F.col("p_size") % 3 - 1.0}
    params = F.create_map(*[c for n, v in given.items() for c in (F.lit(n), v.cast("double"))])
    clip = F.map_from_arrays(F.array(F.lit("duration_s")), F.array(size / 4))
    params = F.when(F.col("p_size") % 2 == 1, F.map_concat(params, clip)).otherwise(params)
    tasks, styles = list(P.LOOKS), [f for f, _ in P.FRAMES]
    jobs = _part(spark, d).select(
        "p_partkey", F.element_at(F.array(*[F.lit(t) for t in tasks]), (F.col("p_partkey") % 5 + 1).cast("int")).alias("task"),
        F.element_at(F.array(*[F.lit(t) for t in styles]), (F.expr("p_partkey div 5") % 3 + 1).cast("int")).alias("style"), params.alias("params"),
        F.when(F.col("p_size") % 7 == 0, F.create_map(F.lit("color"), F.lit("dark grey"))).otherwise(F.create_map().cast("map<string,string>")).alias("words"),
    )
    return P.build_prompts(jobs, *P.template_tables(spark)).select("p_partkey", "task", "style", "case", "prompt")


def image_prompts(spark: SparkSession, d: str) -> DataFrame:
    hidden = F.create_map(F.lit("g_hidden"), F.col("p_size") / 4.0)
    return _part(spark, d).select("p_partkey", P.image_prompt(F.lit("v1_A"), hidden, F.col("p_partkey") % 2 == 0).alias("prompt"))


def resize_area(spark: SparkSession, d: str) -> DataFrame:
    h, w = T.resized(F.lit(480 * 832), 0.5 + F.col("p_size") / 50.0, 16)
    return _part(spark, d).select("p_partkey", h.alias("height"), w.alias("width"))


QUERIES = {f.__name__: f for f in (token_format, token_parse, path_parts, color_normalize, fmt_number, area_parse, longest_prefix_join, param_override, projectile_parts, command_lines, prompt_build, image_prompts, resize_area)}
_SHORT = "CASE WHEN {v} = floor({v}) THEN CAST(CAST(floor({v}) AS BIGINT) AS VARCHAR) ELSE regexp_replace(regexp_replace(printf('%.3f', {v}), '0+$', ''), '[.]$', '') END"
_S8 = _SHORT.format(v="(p_size / 8.0::DOUBLE)")


def _replaced(text: str, values: dict[str, str]) -> str:
    for name, value in values.items():
        text = f"replace({text}, '{{{name}}}', coalesce({value}, ''))"
    return text


_CYCLES = "CASE WHEN sec > 0 THEN CASE WHEN {w} * sec / (2 * pi()) < 1.5 THEN 'about 1' WHEN {w} * sec / (2 * pi()) < 2.5 THEN 'about 2' WHEN {w} * sec / (2 * pi()) < 3.5 THEN 'about 3' ELSE 'about ' || CAST(CAST(round_even({w} * sec / (2 * pi()), 0) AS BIGINT) AS VARCHAR) END ELSE 'several' END"
_LOOK = lambda n: "CASE task " + " ".join(f"WHEN '{t}' THEN '{look[n]}'" for t, look in P.LOOKS.items()) + " END"
_PLACES = {"colour": f"CASE WHEN p_size % 7 = 0 THEN 'dark grey' ELSE {_LOOK(0)} END", "object": _LOOK(1), "h0": "'3'", "x0": "'0'", "y0": "'1.2'", "m": "'1'", "amplitude": "'0.2'", "phi": "'0'", "theta": "'10'", "theta0": "'0'", "omega0": "'90'"}
_PLACES |= {n: _SHORT.format(v=f"({v})") for n, v in {"g": "g", "fall_v0": "v0", "speed": "v0", "degrees": "deg", "vx": "v0 * cos(radians(deg))", "vy": "v0 * sin(radians(deg))", "k": "k", "length": "len", "alpha": "alpha", "omega": "sqrt(k)"}.items()}
_PLACES |= {"spring_cycles": _CYCLES.format(w="sqrt(k)"), "pendulum_cycles": _CYCLES.format(w="sqrt(g / len)")}
ORACLE_SQL = {
    "token_format": "SELECT p_partkey, replace(replace(CAST((p_size - 25) / 2.0::DOUBLE AS VARCHAR), '-', 'm'), '.', 'p') AS token FROM part",
    "token_parse": "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN (p_size - 25) / 2.0::DOUBLE END AS value FROM part",
    "path_parts": "WITH u AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS u FROM pages) SELECT page_id, CAST(len(string_split(u, '/')) AS INTEGER) AS n_parts, string_split(u, '/')[1] AS host, regexp_replace(string_split(u, '/')[-1], '[.][^.]*$', '') AS stem FROM u",
    "color_normalize": "WITH c AS (SELECT p_partkey, lower(p_name || ' ' || CASE p_size % 3 WHEN 0 THEN 'Dark BLUE' WHEN 1 THEN 'white-red' ELSE '' END) AS t FROM part) SELECT p_partkey, CASE WHEN contains(t, 'red') THEN 'red' WHEN contains(t, 'blue') THEN 'blue' WHEN contains(t, 'green') THEN 'green' WHEN contains(t, 'yellow') THEN 'yellow' WHEN contains(t, 'white') THEN 'white' ELSE 'none' END AS colour FROM c",
    "fmt_number": f"SELECT p_partkey, {_S8} AS shown FROM part",
    "area_parse": "SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 0 THEN p_size * (p_size + 3) ELSE p_size END AS BIGINT) AS area FROM part",
    "longest_prefix_join": "WITH c AS (SELECT unnest([" + ", ".join(f"'{p}'" for p in PREFIXES) + "]) AS config) SELECT p_partkey, arg_max(config, length(config)) AS config FROM part JOIN c ON starts_with(p_type, config) GROUP BY p_partkey",
    "param_override": "SELECT p_partkey, p_size / 2.0::DOUBLE AS g, 0.5::DOUBLE AS e, 0.1::DOUBLE AS mu FROM part",
    "projectile_parts": "WITH v AS (SELECT p_partkey, p_size * cos(radians(p_partkey % 90)) AS vx, p_size * sin(radians(p_partkey % 90)) AS vz FROM part) SELECT p_partkey, round(vx, 6) AS vx, round(vz, 6) AS vz, round(degrees(atan2(vz, vx)), 6) AS angle FROM v",
    "command_lines": "SELECT p_partkey, 'run --name ' || CASE WHEN contains(p_name, ' ') THEN '\"' || p_name || '\"' ELSE p_name END || ' --size ' || CAST(p_size AS VARCHAR) AS command FROM part",
    "prompt_build": f"""WITH j AS (SELECT p_partkey, p_size, [{", ".join(f"'{t}'" for t in P.LOOKS)}][p_partkey % 5 + 1] AS task, [{", ".join(f"'{f}'" for f, _ in P.FRAMES)}][p_partkey // 5 % 3 + 1] AS style,
            p_size / 5.0::DOUBLE AS g, p_size % 3 * 1.5::DOUBLE AS v0, p_size % 4 * 15.0::DOUBLE AS deg, p_size + 3.0::DOUBLE AS k, p_size / 10.0::DOUBLE AS len, p_size % 3 - 1.0::DOUBLE AS alpha, CASE WHEN p_size % 2 = 1 THEN p_size / 4.0::DOUBLE END AS sec FROM part),
        c AS (SELECT *, CASE task WHEN 'free_fall' THEN CASE WHEN v0 = 0 THEN 'rest' ELSE 'thrown' END WHEN 'projectile' THEN CASE WHEN abs(v0 * sin(radians(deg))) < 1e-6 OR deg = 0 THEN 'level' ELSE 'upward' END WHEN 'rotation' THEN CASE WHEN alpha = 0 THEN 'steady' WHEN alpha > 0 THEN 'faster' ELSE 'slower' END ELSE 'any' END AS kind FROM j),
        f AS (SELECT *, CASE style {" ".join(f"WHEN '{n}' THEN '{t}'" for n, t in P.FRAMES)} END AS frame FROM c),
        t AS (SELECT *, {_replaced("frame", {part: "CASE " + " ".join(f"WHEN task = '{task}'{f" AND kind = '{case}'" if case else ''} THEN '{text}'" for task, case, q, text in P.TEXTS if q == part) + " END" for part in dict.fromkeys(q for _, _, q, _ in P.TEXTS)})} AS body FROM f)
        SELECT p_partkey, task, style, kind AS "case", {_replaced("body", _PLACES)} AS prompt FROM t""",
    "image_prompts": f"""SELECT p_partkey, 'Go on from the given picture: the same ball, camera, background and light. The ball is already falling. It keeps to one smooth vertical line, without a bounce. ' ||
        CASE WHEN p_partkey % 2 = 0 THEN 'Gravity is ' || {_SHORT.format(v="(p_size / 4.0::DOUBLE)")} || ' m/s^2, and the fall should show it.' ELSE 'Gravity is not told; it follows from the picture.' END AS prompt FROM part""",
    "resize_area": "WITH a AS (SELECT p_partkey, 0.5::DOUBLE + p_size / 50.0::DOUBLE AS aspect FROM part) SELECT p_partkey, CAST(floor(round_even(sqrt(399360 * aspect), 0) / 16) * 16 AS BIGINT) AS height, CAST(floor(round_even(sqrt(399360 / aspect), 0) / 16) * 16 AS BIGINT) AS width FROM a",
}
