"""Coercion of loosely typed text values to typed columns.

Raw records are read with string leaves, so a number that arrives as text and one that arrives as a
number look alike. Not-a-number never reaches a column: it becomes NULL, since Spark would sort it
above every number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_PREFIX = r"^\s*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))"
_PLAIN = r"^-?\d+(\.\d+)?$"
#: All white space, byte order marks and line separators included, at either end of a text.
ENDS = r"^[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+|[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+$"


def trimmed(text: Column) -> Column:
    """A text without white space of any kind at its ends."""
    # Nearly all are plain, at once or without usual white space; the search for white space of any kind is slow.
    plain = lambda t: t.rlike(r"(?s)\A[!-~](?:.*[!-~])?\z")
    usual = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(plain(usual), usual).otherwise(F.regexp_replace(text, ENDS, ""))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it; its code is not generated, so it stays small."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _odd_number(text: Column) -> Column:
    """A text that is not plainly a number."""
    hexadecimal = lambda bare: F.conv(F.substring(bare, 3, 16), 16, 10).try_cast("double")
    return bound(trimmed(text), lambda bare: (
        F.when(bare == "", 0.0)
        .when(bare.rlike("^0[xX][0-9a-fA-F]+$"), hexadecimal(bare))
        .when(bare.rlike(r"^[+-]?(\d|\.\d|Infinity$)") & ~bare.rlike("[dDfF]$"), bare.try_cast("double"))
    ))


def number(text: Column) -> Column:
    """A whole text as a number: empty text is 0, hexadecimal integers are read, anything else that is no number is NULL."""
    plain = text.rlike(_PLAIN)  # nearly all; the rest is looked at closely
    return F.when(text.isNull(), None).when(plain, text.try_cast("double")).otherwise(bound(text, _odd_number))


def number_prefix(text: Column) -> Column:
    """The number that a text begins with, or NULL."""
    return F.nullif(F.regexp_extract(text, _PREFIX, 1), F.lit("")).try_cast("double")


def or_default(value: Column, default: float) -> Column:
    """The number, where NULL and zero mean that it is missing."""
    return F.coalesce(F.nullif(value, F.lit(0.0)), F.lit(float(default)))


def text_or(value: Column, default: Column | str = "") -> Column:
    """The text, where NULL and empty mean that it is missing."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(value, F.lit("")), fallback)


def truthy(text: Column, quoted: Column | None = None) -> Column:
    """Whether a raw JSON leaf counts as true.

    ``text`` is the leaf without quotes. ``quoted`` tells whether it was a JSON string: the string
    "false" counts as true, the value false does not. Without it, an unquoted value is assumed.
    """
    off = text.isNull() | (text == "")
    bare = text.isin("false", "null", "NaN") | F.coalesce(text.try_cast("double") == 0, F.lit(False))
    if quoted is None:
        return ~(off | bare)
    return ~(off | (bare & ~F.coalesce(quoted, F.lit(False))))


def blank(num: Column, text: Column) -> Column:
    """A cell without content: no value, empty text or zero."""
    return (num.isNull() & (text.isNull() | (text == ""))) | F.coalesce(num == 0, F.lit(False))
