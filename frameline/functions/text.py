"""Scalar functions over tokens, paths, colours and numbers, as column expressions. Null in, null out unless said otherwise."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colours in order of priority.
COLOURS = ("red", "blue", "green", "yellow", "white")


def parse_number_token(token: Column) -> Column:
    """``9p8`` is 9.8, ``m1p5`` and ``neg1p5`` are -1.5; anything else is null."""
    body = F.regexp_replace(F.lower(token), "^(neg|m)", "-")
    text = F.replace(body, F.lit("p"), F.lit("."))
    return F.when(text.rlike(r"^-?[0-9]*\.?[0-9]+$|^-?[0-9]+\.$"), text.try_cast("double"))


def number_token(value: Column) -> Column:
    """The token of a number: ``-`` becomes m and ``.`` p."""
    return F.translate(value.cast("string"), "-.", "mp")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def path_style(path: Column, model: str) -> Column:
    """The part before the model's first place other than the first part; ``unknown`` if there is none."""
    parts = F.split(path, "/")
    at = F.array_position(F.slice(parts, 2, F.size(parts)), model)
    return F.when(at > 0, F.get(parts, (at - 1).cast("int"))).otherwise("unknown")


def variant_of_path(path: Column) -> Column:
    """Name of the folder a file is in if any part is ``variants``, else ``baseline``."""
    parts = F.split(path, "/")
    return F.when(F.array_contains(parts, "variants"), F.get(parts, F.size(parts) - 2)).otherwise("baseline")


def experiment_of_path(path: Column) -> Column:
    """The first part that is an experiment's name, else the first such name in the stem, else ``unknown``."""
    whole = F.get(F.filter(F.split(path, "/"), lambda p: p.rlike("^v[123]_[A-G]$")), F.lit(0))
    return F.coalesce(whole, F.nullif(F.regexp_extract(stem(path), "v[123]_[A-G]", 0), F.lit("")), F.lit("unknown"))


def of_model(path: Column, model: str, in_stem: bool = False) -> Column:
    """Whether a part of the path is the model, or (``in_stem``) the file's stem contains it."""
    part = F.array_contains(F.split(path, "/"), model)
    return part | F.contains(stem(path), F.lit(model)) if in_stem else part


def expected_of_stem(name: Column) -> dict[str, Column]:
    """Gravity, height and speed that a free-fall file's name asks for; null where the name does not have all three."""
    token = "([A-Za-z0-9]+)"
    pattern = f"freefall_g{token}_h{token}_v0_{token}"
    return {c: parse_number_token(F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))) for i, c in enumerate(("g", "h0", "v0"), 1)}


def resolved(path: Column, root: str) -> Column:
    """An absolute path as it is, a relative one below the root."""
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(f"{root}/"), path))


def below(path: Column, root: str) -> Column:
    """The path relative to the root; null if it is not below it."""
    return F.when(F.startswith(path, F.lit(f"{root}/")), F.substring(path, F.lit(len(root) + 2), F.length(path)))


def cycles_text(omega: Column, seconds: Column) -> Column:
    """How many cycles a clip shows, in words; ``several`` without a positive duration."""
    cycles = omega * seconds / F.lit(2 * math.pi)
    words = F.when(cycles < 1.5, "about 1").when(cycles < 2.5, "about 2").when(cycles < 3.5, "about 3")
    return F.when(seconds > 0, words.otherwise(F.concat(F.lit("about "), F.rint(cycles).cast("long").cast("string")))).otherwise("several")


def posix_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def colour_name(text: Column) -> Column:
    """The first colour by priority that the text contains; null if none."""
    low = F.lower(text)
    return reduce(lambda out, c: out.when(F.contains(low, F.lit(c)), c), COLOURS[1:], F.when(F.contains(low, F.lit(COLOURS[0])), COLOURS[0]))


def short_number(value: Column) -> Column:
    """Whole numbers bare, others with up to three decimals."""
    plain = F.rtrim(F.rtrim(F.format_string("%.3f", value), F.lit("0")), F.lit("."))
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(plain)


def area_of(text: Column) -> Column:
    """``480*832`` is the product; a single number is itself."""
    parts = F.split(text, r"\*")
    return F.when(F.size(parts) == 2, F.get(parts, 0).try_cast("long") * F.get(parts, 1).try_cast("long")).otherwise(text.try_cast("long"))


def resized(area: Column, aspect: Column, multiple: int) -> tuple[Column, Column]:
    """(height, width) of the area at the aspect (height over width), each rounded and cut to the multiple."""
    cut = lambda v: (F.floor(F.rint(v) / multiple) * multiple).cast("long")
    return cut(F.sqrt(area * aspect)), cut(F.sqrt(area / aspect))


def odd(value: Column) -> Column:
    return F.when(value % 2 == 0, value + 1).otherwise(value)


def job_id(*parts: Column) -> Column:
    return F.concat_ws("__", *parts)


def command_line(parts: Column) -> Column:
    """Arguments joined by spaces, quoted where they hold one."""
    return F.array_join(F.transform(parts, lambda p: F.when(F.contains(p, F.lit(" ")), F.concat(F.lit('"'), p, F.lit('"'))).otherwise(p)), " ")


def first_present(values: Column, keys: list[str], default: float) -> Column:
    """The value, null or not, of the first key that a map has, else the default."""
    return reduce(lambda out, k: F.when(F.map_contains_key(values, k), F.try_element_at(values, F.lit(k))).otherwise(out), reversed(keys), F.lit(default))


def overridden(*maps: Column) -> Column:
    """Maps from left to right; the right one wins. Built from entries, so that no session setting is needed."""
    keys = reduce(F.array_union, [F.map_keys(m) for m in maps])
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(*[F.try_element_at(m, k) for m in reversed(maps)])))


def polar_parts(speed: Column, degrees: Column) -> tuple[Column, Column]:
    return speed * F.cos(F.radians(degrees)), speed * F.sin(F.radians(degrees))


def frame_time(frame: Column, fps: float) -> Column:
    return (frame - 1) / fps
