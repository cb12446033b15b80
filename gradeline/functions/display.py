"""Texts for people and for file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def currency(value: Column) -> Column:
    """Dollars with grouping and two places; the sign stands after the currency mark."""
    return F.concat(F.lit("$"), F.format_number(value, 2))


def project_name(file_name: Column) -> Column:
    """A project's name from its drawing file: without the first ``.pdf``, dashes and underscores as spaces."""
    at = F.locate(".pdf", file_name)
    cut = F.when(at > 0, F.concat(F.left(file_name, at - 1), F.substr(file_name, at + 4))).otherwise(file_name)
    return F.translate(cut, "-_", "  ")


def safe_name(name: Column) -> Column:
    """A name with nothing but letters, digits, dashes, underscores and spaces."""
    return F.regexp_replace(name, "[^a-zA-Z0-9\\-_ ]", "")


def scoreboard_date(file_name: Column) -> Column:
    """The day in a scoreboard's file name; empty where there is none."""
    return F.regexp_extract(file_name, r"evaluation_scoreboard_(\d{4}-\d{2}-\d{2})", 1)


def confidence_band(value: Column) -> Column:
    return F.when(value >= 0.8, "high").when(value >= 0.6, "medium").otherwise("low")


def structure_label(kind: Column) -> Column:
    """STD for structure type 1, LRG for any other; a dash without one."""
    return F.when(kind.isNull() | (kind == ""), "-").when(kind.try_cast("double") == 1, "STD").otherwise("LRG")


def yes_no(flag: Column) -> Column:
    return F.when(F.coalesce(flag, F.lit(0.0)) != 0, "Y").otherwise("N")


def or_dash(value: Column) -> Column:
    """The number, or a dash for nothing and zero."""
    return F.coalesce(F.nullif(value, F.lit(0.0)).cast("string"), F.lit("-"))


def first_warnings(warnings: Column, count: int = 3) -> Column:
    return F.array_join(F.slice(warnings, 1, count), "; ")


def padded(name: Column, width: int = 50) -> Column:
    return F.rpad(F.substring(name, 1, width), width, " ")


def numbered_rules(rules: Column) -> Column:
    """A numbered list, one rule on each line."""
    return F.array_join(F.transform(rules, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r)), "\n")


def page_focus(pages: Column) -> Column:
    """The sentence that directs a reader to some pages; empty without pages."""
    return F.when(F.size(pages) > 0, F.concat(F.lit("Focus on pages "), F.array_join(pages.cast("array<string>"), ", "), F.lit("."))).otherwise("")
