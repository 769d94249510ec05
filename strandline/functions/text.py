"""Column expressions over text: routes, slugs, rendering, chat formats, clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def route(template: str, **values: Column) -> Column:
    """Fill a template of {name} and {name:0Nd} fields."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)(?::0(\d+)d)?\}", template):
        parts.append(F.lit(template[at : m.start()]))
        text = values[m.group(1)].cast("string")
        if m.group(2):
            text = F.lpad(text, F.greatest(F.lit(int(m.group(2))), F.length(text)), F.lit("0"))
        parts.append(text)
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def slug(x: Column) -> Column:
    """Lower case, every run of other characters than letters and digits one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-|-$", "")


def debug_slug(x: Column) -> Column:
    """Keeps case and ``_ . -``."""
    return F.regexp_replace(x, "[^A-Za-z0-9_.-]+", "-")


def non_blank(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"^\s+|\s+$", "")) > 0


def lines(*parts: tuple[str, Column]) -> Column:
    """``label: text`` lines."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), F.coalesce(value, F.lit(""))) for label, value in parts])


def without_prefix(x: Column, *prefixes: str) -> Column:
    for p in prefixes:
        x = F.when(x.startswith(p), F.substring(x, len(p) + 1, 1 << 30)).otherwise(x)
    return x


def cleaned(x: Column, replacements: dict[str, str]) -> Column:
    for pattern, to in replacements.items():
        x = F.regexp_replace(x, pattern, to)
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def numbers(x: Column, places: int = 2) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: F.format_string(f"%.{places}f", v)), ", "), F.lit("]"))


def chat(messages: Column, roles: dict[str, str], start: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """One text of an array of (role, content); unknown roles keep their name; ``<image>`` marks become tokens."""
    names = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])
    one = lambda m: F.concat(F.lit(start), F.coalesce(F.element_at(names, m["role"]), m["role"]), F.lit("\n"), F.regexp_replace(F.coalesce(m["content"], F.lit("")), "<image>", "<|image|>"), F.lit(end + "\n"))
    return F.array_join(F.transform(messages, one), "")


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def canonical_json(**fields: Column) -> Column:
    """Object with sorted keys, nulls kept; values are JSON texts already."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null"))) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_string(x: Column) -> Column:
    """A JSON string literal of simple text (quotes and backslashes escaped)."""
    return F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"'))
