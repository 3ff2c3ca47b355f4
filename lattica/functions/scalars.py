"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def brief(text: Column, most: int = 240) -> Column:
    """White space collapsed; over ``most`` characters, cut at the last blank before and marked with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.regexp_extract(F.left(flat, F.lit(most)), r"^(.*) ", 1)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.when(cut == "", F.left(flat, F.lit(most))).otherwise(cut), F.lit("…")))


def capped_detail(text: Column, most: int = 4000) -> Column:
    """Text up to ``most`` characters, with a note of how many follow."""
    more = F.length(text) - most
    return F.when(more > 0, F.concat(F.left(text, F.lit(most)), F.lit(" [+"), more.cast("string"), F.lit(" characters]"))).otherwise(text)


def define_name(*parts: Column) -> Column:
    """Parts in upper case without separators, joined by underscores."""
    return F.concat_ws("_", *[F.upper(F.regexp_replace(p, r"[\s_#-]+", "")) for p in parts])


def without_prefix(name: Column, prefixes: tuple[str, ...]) -> Column:
    """The rest after the first prefix that matches and leaves something."""
    rest = name
    for p in reversed(prefixes):
        rest = F.when(F.startswith(name, F.lit(p)) & (F.length(name) > len(p)), F.substring(name, len(p) + 1, 1 << 30)).otherwise(rest)
    return rest


def looks_like_test(name: Column, path: Column) -> Column:
    return F.startswith(F.lower(name), F.lit("test_")) | F.contains(F.lower(path), F.lit("test"))


def slug(path: Column) -> Column:
    """Six hexadecimal digits of a path's SHA-1."""
    return F.left(F.sha1(path), F.lit(6))


def redacted(text: Column) -> Column:
    """Absolute home and temporary paths replaced by their kind."""
    return F.regexp_replace(F.regexp_replace(text, r"/(home|Users)/[^/\s]+", "<home>"), r"/tmp/\S+", "<tmp>")


def layered(explicit: Column, declared: Column, found: Column, facts: Column) -> Column:
    """Facts, then the first of explicit, declared and found options that states anything, without repeats."""
    stated = F.when(F.size(explicit) > 0, explicit).when(F.size(declared) > 0, declared).otherwise(found)
    return F.array_distinct(F.concat(facts, stated))


def carried(new: Column, old: Column) -> Column:
    """A restated list: absent inherits the old one, empty withdraws it, anything else replaces it."""
    return F.when(new.isNull(), old).when(F.size(new) == 0, None).otherwise(new)


def extract_version(detail: Column) -> Column:
    """The first word of a version section's paragraph, empty where there is none."""
    return F.coalesce(F.regexp_extract(detail, r'<simplesect kind="version"><para>\s*([^\s<]+)', 1), F.lit(""))


def report_line(*cells: Column) -> Column:
    """A row of a Markdown table; bars within cells are escaped, nulls are empty."""
    shown = [F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |"))
