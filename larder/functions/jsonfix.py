"""JSON from model replies and loosely typed files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The meal target used where a reply gives none.
DEFAULT_TARGETS = {"protein_g": 25.0, "fat_g": 20.0, "carb_g": 50.0, "energy_kcal": 500.0}


def _object_text(x: Column) -> Column:
    return F.when(F.try_parse_json(x).isNotNull(), x)


def repair_json(reply: Column | str) -> Column:
    """The reply's JSON as text: whole, else fenced, else from the first to the last brace, else with braces closed; else null."""
    reply = F.col(reply) if isinstance(reply, str) else reply
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1)
    braces = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    fragment = F.substring(reply, F.instr(reply, "{"), F.length(reply))
    depth = F.length(F.regexp_replace(fragment, r"[^{]", "")) - F.length(F.regexp_replace(fragment, r"[^}]", ""))
    closed = F.when((F.instr(reply, "{") > 0) & (depth > 0), F.concat(fragment, F.repeat(F.lit("}"), depth)))
    return F.coalesce(_object_text(reply), F.when(fenced != "", _object_text(fenced)), F.when(braces != "", _object_text(braces)), _object_text(closed))


def repair_list(reply: Column) -> Column:
    """A list of strings: a JSON array, whole or inside the reply, else all quoted strings."""
    kind = "array<string>"
    inner = F.regexp_extract(reply, r"(?s)\[.*\]", 0)
    quoted = F.regexp_extract_all(reply, F.lit('"([^"]+)"'), 1)
    parsed = lambda x: F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, kind))
    return F.coalesce(parsed(F.trim(reply)), F.when(inner != "", parsed(inner)), quoted)


def json_objects(reply: Column, kind: str) -> Column:
    """A list of objects (`kind`, a struct): a JSON array without its fences, else every line that is an object."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(reply, r"```json\s*", ""), r"```\s*", ""))
    whole = F.when(F.try_parse_json(plain).isNotNull() & plain.startswith("["), F.from_json(plain, f"array<{kind}>"))
    lines = F.transform(F.split(plain, "\n"), lambda x: F.rtrim(F.trim(x), F.lit(",")))
    good = F.filter(lines, lambda x: x.startswith("{") & F.try_parse_json(x).isNotNull())
    return F.coalesce(whole, F.transform(good, lambda x: F.from_json(x, kind)))


def targets(reply_json: Column) -> Column:
    """Struct of the four targets; what is missing or no number gets its default."""
    v = F.try_parse_json(reply_json)
    get = lambda k: F.coalesce(F.try_variant_get(v, f"$.targets.{k}", "double"), F.try_variant_get(v, f"$.{k}", "double"), F.lit(d))
    out = []
    for k, d in DEFAULT_TARGETS.items():
        out.append(get(k).alias(k))
    return F.struct(*out)


def lenient_double(value: Column) -> Column:
    """A number from a scalar or from the first element of a list; null if neither."""
    first = F.get(F.from_json(F.when(value.startswith("["), value), "array<string>"), F.lit(0))
    return F.coalesce(value.try_cast("double"), first.try_cast("double"))


def first_name(value: Column) -> Column:
    """A name from a scalar or from the first element of a list."""
    return F.coalesce(F.get(F.from_json(F.when(value.startswith("["), value), "array<string>"), F.lit(0)), value)
