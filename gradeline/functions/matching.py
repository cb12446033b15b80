"""Comparison of keys and of cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeline.functions.values import bound, number_prefix, trimmed

#: Numbers match below this relative difference.
TOLERANCE = 0.05


def plain_key(key: Column) -> Column:
    """A row key in lower case without notes in parentheses."""
    return F.lower(trimmed(F.regexp_replace(key, r"\(.*?\)", "")))


def key_parts(key: Column) -> Column:
    """What the comparison of keys looks at: the plain key, its letters and digits, its digits."""
    plain = plain_key(key)
    bare = F.regexp_replace(plain, "[^a-z0-9]", "")
    return F.struct(plain.alias("plain"), bare.alias("bare"), F.regexp_replace(bare, "[^0-9]", "").alias("digits"))


def parts_match(a: Column, b: Column) -> Column:
    """Whether two keys, given by their parts, name the same thing."""
    within = F.contains(a["bare"], b["bare"]) | F.contains(b["bare"], a["bare"])
    found = (a["plain"] == b["plain"]) | (a["bare"] == b["bare"]) | (within & (a["digits"] == b["digits"]))
    return F.coalesce(found, F.lit(False))


def keys_match(a: Column, b: Column) -> Column:
    """Whether two row keys name the same thing.

    Equal without notes, case and punctuation, or one within the other with the same digits. A key
    of which nothing is left matches every key without digits.
    """
    return parts_match(key_parts(a), key_parts(b))


def values_match(num_a: Column, text_a: Column, num_b: Column, text_b: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether two cells agree: as numbers within the tolerance where both begin with one, else as text without case.

    A cell is a number (``num``) or a text; both NULL means that it is empty.
    """
    empty_a, empty_b = num_a.isNull() & text_a.isNull(), num_b.isNull() & text_b.isNull()

    def near(a: Column, b: Column) -> Column:
        largest = F.greatest(F.abs(a), F.abs(b))
        return F.coalesce((largest == 0) | (F.try_divide(F.abs(a - b), largest) < tolerance), F.lit(False))

    def texts(x: Column) -> Column:  # at least one is a text, and they are not the same one
        shown = lambda n, t: F.lower(trimmed(F.coalesce(t, n.cast("string"))))
        same = F.coalesce(shown(x["num_a"], x["text_a"]) == shown(x["num_b"], x["text_b"]), F.lit(False))
        numbers = F.struct(F.coalesce(x["num_a"], number_prefix(x["text_a"])).alias("a"), F.coalesce(x["num_b"], number_prefix(x["text_b"])).alias("b"))
        return bound(numbers, lambda n: F.when(n["a"].isNotNull() & n["b"].isNotNull(), near(n["a"], n["b"])).otherwise(same))

    # Cells of numbers stay in code that is small enough to be compiled; texts, which take much more of it, are looked at apart.
    return (
        F.when(empty_a & empty_b, True)
        .when(empty_a | empty_b, False)
        .when(text_a.isNull() & text_b.isNull(), near(num_a, num_b))
        .when(F.coalesce(text_a == text_b, F.lit(False)), True)
        .otherwise(bound(F.struct(num_a.alias("num_a"), text_a.alias("text_a"), num_b.alias("num_b"), text_b.alias("text_b")), texts))
    )


def percent_error(truth: Column, found: Column) -> Column:
    """Percentage by which a number is off; NULL without two numbers or for a true zero."""
    return F.when(truth != 0, F.abs((found - truth) / truth) * 100)
