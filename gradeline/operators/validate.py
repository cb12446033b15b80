"""Warnings about implausible values; they come before fee rows are appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.functions.pipes import DIAMETERS


#: The fields that the rules look at.
FIELDS = {
    "sewers": ("runLabel", "isLineItem", "length", "pipeDiameter", "slope", "depth"), "watermain": ("sizeAndType", "length", "avgCover"), "groups": ("type", "quantity"),
}


def shown(value: Column) -> Column:
    """A number as short text, without a fraction of zero."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def sewer_warnings(s: Column) -> Column:
    """Messages for one sewer run, NULL for each rule that holds; fee rows have none."""
    name = F.concat(F.lit("Sewer "), s["runLabel"], F.lit(": "))
    depth, size, slope = s["depth"], s["pipeDiameter"], s["slope"]
    return F.when(~s["isLineItem"], F.array(
        F.when(s["length"] <= 0, F.concat(name, F.lit("zero or negative length"))),
        F.when((depth > 0) & ((depth < 0.5) | (depth > 10)), F.concat(name, F.lit("unusual depth "), shown(depth), F.lit("m (outside 0.5-10m range)"))),
        F.when((size > 0) & ~size.isin([float(d) for d in DIAMETERS]), F.concat(name, F.lit("non-standard diameter "), shown(size), F.lit("mm"))),
        F.when(slope > 10, F.concat(name, F.lit("slope "), shown(slope), F.lit("% seems too high — may be ‰ not %"))),
    ))


def watermain_warnings(w: Column) -> Column:
    name = F.concat(F.lit("Watermain "), w["sizeAndType"], F.lit(": "))
    cover = w["avgCover"]
    return F.array(
        F.when(w["length"] <= 0, F.concat(name, F.lit("zero or negative length"))),
        F.when((cover < 1.0) | (cover > 4.0), F.concat(name, F.lit("unusual cover "), shown(cover), F.lit("m (outside 1.0-4.0m)"))),
    )


def catchbasin_warnings(g: Column) -> Column:
    return F.array(F.when(g["quantity"] <= 0, F.concat(F.lit("Catchbasin group "), g["type"], F.lit(": zero quantity"))))


def with_warnings(records: DataFrame) -> DataFrame:
    """Append the warnings in the order sewers, watermain, catchbasins."""
    none = F.array().cast("array<string>")

    def messages(items: Column, rule) -> Column:
        return F.flatten(F.transform(items, lambda x: F.coalesce(rule(x), none)))

    found = [
        messages(F.col("sewers"), sewer_warnings),
        messages(F.col("watermain"), watermain_warnings),
        messages(F.col("catchbasins.groups"), catchbasin_warnings),
    ]
    return records.withColumn("warnings", F.filter(F.concat("warnings", *found), lambda w: w.isNotNull()))
