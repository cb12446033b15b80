"""Leaves of parsed JSON (VARIANT) as typed columns, by the rules of loosely typed records.

A response is parsed once and its leaves keep their JSON type, so the text "false" and the value false differ. In words: a
missing leaf and null are nothing; a number stays; a text counts as the number that it spells out, an empty one as 0; true
is 1 and false 0; a list counts as its entries joined by commas, and an object is no number. Where a text is asked for, a
leaf that counts as false (nothing, empty text, 0, false) gives the default, and any other number or flag gives its text.

A leaf is looked at as a pair of its kind and its text, which are columns of their own where many leaves are read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeline.functions.values import number


def leaf(parent: Column, path: str) -> Column:
    """What is at a dotted path below a VARIANT; NULL or a VARIANT null for nothing."""
    return F.try_variant_get(parent, "$." + path, "variant")


def children(parent: Column, path: str) -> Column:
    """The entries of a list below a VARIANT, NULL if there is no list."""
    return F.try_variant_get(parent, "$." + path, "array<variant>")


def kind(value: Column) -> Column:
    """S for a text, B for a flag, A for a list, O for an object, N for a number; NULL for nothing."""
    name = F.schema_of_variant(value)
    first = F.substring(name, 1, 1)
    return F.when(first.isin("S", "A", "O") | (name == "BOOLEAN"), first).when(name != "VOID", "N")


def shown(value: Column) -> Column:
    """The leaf as JSON, texts without quotes."""
    return F.try_variant_get(value, "$", "string")


def _listed(text: Column) -> Column:
    """A JSON list of plain values as its entries joined by commas."""
    inside = F.regexp_replace(text, r'^\[|\]$|"', "")
    return F.regexp_replace(inside, r"(?<=^|,)null(?=,|$)", "")


def text_of(k: Column, t: Column) -> Column:
    """The text of a leaf: numbers without zeros at the end of a fraction."""
    short = F.regexp_replace(F.regexp_replace(t, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(k == "S", t).when((k == "N") & t.rlike(r"^-?[0-9]+\.[0-9]+$"), short).when(k == "A", _listed(t)).when(k == "O", "[object Object]").otherwise(t)


def number_of(k: Column, t: Column) -> Column:
    """The number of a leaf, NULL for nothing and for what is no number."""
    return F.when(k == "N", t.try_cast("double")).when(k == "S", number(t)).when(k == "B", (t == "true").cast("double")).when(k == "A", number(_listed(t)))


def truth_of(k: Column, t: Column) -> Column:
    """Whether a leaf counts as true."""
    return F.coalesce(F.when(k == "B", t == "true").when(k == "N", t.try_cast("double") != 0).when(k == "S", t != "").otherwise(k.isNotNull()), F.lit(False))


def text_or(k: Column, t: Column, default: Column | str | None = "") -> Column:
    """The text of a leaf, the default where it counts as false."""
    other = default if isinstance(default, Column) else F.lit(default)
    return F.when(truth_of(k, t), text_of(k, t)).otherwise(other)
