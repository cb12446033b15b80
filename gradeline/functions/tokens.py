"""Word sets of short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_set(text: Column, longer_than: int) -> Column:
    """Distinct lower-case words of ASCII letters, digits and underscores with more than so many characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\W+"), lambda w: F.length(w) > longer_than))


def shared_words(a: Column, b: Column) -> Column:
    """Number of words that two sets share."""
    return F.size(F.array_intersect(a, b))


def overlap(a: Column, b: Column) -> Column:
    """Shared words over the size of the larger set; NULL for two empty sets."""
    return F.try_divide(shared_words(a, b), F.greatest(F.size(a), F.size(b)))
