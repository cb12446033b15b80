"""Choice of each project's drawing and true workbook among the files of its folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FileRule:
    """Which file of a folder is taken: an ending, words that exclude, words that add or take points, and the order."""

    ending: str
    excluded: tuple[str, ...] = ()
    plus: tuple[str, ...] = ()
    minus: tuple[str, ...] = ()
    largest: bool = True
    all_files: bool = False
    #: Words that exclude in this case only; endings count in any case unless this is False.
    excluded_exactly: tuple[str, ...] = ()
    any_case: bool = True


# Words in names of files that are no drawings, or no true workbooks, and words that count for or against a drawing.
NOT_DRAWINGS = (
    "quote", "quotation", "schedule", "bid", "geotechnical", "geotech", "appendix 4", "report", "proposal", "estimate", "pricing",
    "breakdown", "budget", "letter", "backup", "specifications", "specs", "rpt", "contracting", "invoice", "addendum", "tender_form",
)
NOT_TRUTH = ("quote", "budget", "backup", "sand", "appendix", "estimate", "additional")
GOOD_DRAWING = ("civil", "servicing", "drainage", "plan")
POOR_DRAWING = ("structural", "detail", "spec", "det-")

DRAWING = FileRule(".pdf", NOT_DRAWINGS, GOOD_DRAWING, POOR_DRAWING)
TRUTH = FileRule(".xlsx", NOT_TRUTH, largest=False)

# The (drawing, truth) rules of the runners, with the words that each of them excludes.
RULES = {
    "batch": (DRAWING, TRUTH),
    "cloud": (
        FileRule(".pdf", ("quote", "quotation", "schedule", "bid", "geotechnical", "appendix 4", "report", "structural", "architectural")),
        FileRule(".xlsx", NOT_TRUTH, largest=False, excluded_exactly=("eval_",)),
    ),
    "golden": (
        FileRule(".pdf", ("quote", "quotation", "schedule", "bid", "geotechnical", "report", "granular", "structural", "architectural")),
        FileRule(".xlsx", largest=False, excluded_exactly=("eval_run_",)),
    ),
    "single": (FileRule(".pdf", ("quote", "schedule", "bid", "structural", "architectural"), largest=False), FileRule(".xlsx", largest=False)),
    "extract": (FileRule(".pdf", ("quote", "quotation", "schedule", "bid", "geotechnical", "appendix 4", "report")), None),
    "analysis": (None, FileRule(".xlsx", ("quote",), largest=False, excluded_exactly=("eval_",), any_case=False)),
    "dataset": (
        FileRule(".pdf", ("quote", "breakdown"), all_files=True),
        FileRule(".xlsx", ("quote", "sand", "appendix", "estimate moe", "budget", "additional"), all_files=True),
    ),
    "profile": (
        FileRule(".pdf", ("quote", "schedule", "bid"), largest=False, any_case=False),
        FileRule(".xlsx", ("quote", "budget", "backup", "sand", "appendix", "estimate"), largest=False, any_case=False),
    ),
}


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def file_score(name: Column, plus: tuple[str, ...] = GOOD_DRAWING, minus: tuple[str, ...] = POOR_DRAWING) -> Column:
    """1000 points for any good word and -500 for any poor one, each once."""
    low = F.lower(name)
    return F.when(_any(low, plus), 1000).otherwise(0) + F.when(_any(low, minus), -500).otherwise(0)


def eligible(name: Column, rule: FileRule) -> Column:
    low = F.lower(name)
    return (low if rule.any_case else name).endswith(rule.ending) & ~_any(low, rule.excluded) & ~_any(name, rule.excluded_exactly)


def picked(files: DataFrame, rule: FileRule, by: str = "project") -> DataFrame:
    """The file of each project: best score, then the largest (or none of the two), then the first name."""
    found = files.where(eligible(F.col("name"), rule)).withColumn("score", file_score(F.col("name"), rule.plus, rule.minus))
    if rule.all_files:
        return found
    order = [F.desc("score"), F.desc("size"), F.asc("name")] if rule.largest else [F.asc("name")]
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return found.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def projects(files: DataFrame, overrides: DataFrame | None = None, drawing: FileRule = DRAWING, truth: FileRule = TRUTH) -> DataFrame:
    """(project, drawing, truth) of projects with both; an override (project, name) wins over the rules for drawings."""
    chosen = picked(files, drawing).select("project", F.col("name").alias("drawing"))
    if overrides is not None:
        forced = overrides.select("project", F.col("name").alias("_forced"))
        chosen = chosen.join(forced, "project", "full").select("project", F.coalesce("_forced", "drawing").alias("drawing"))
    return chosen.join(picked(files, truth).select("project", F.col("name").alias("truth")), "project")


def latest_output(files: DataFrame, by: str = "project") -> DataFrame:
    """The generated workbook with the largest name, which is not always the newest."""
    made = files.where(F.col("name").startswith("eval_") & F.col("name").endswith(".xlsx"))
    return made.groupBy(by).agg(F.max("name").alias("generated"))


def without_output(manifest: DataFrame, files: DataFrame, by: str = "project") -> DataFrame:
    """Projects that have no generated workbook yet."""
    return manifest.join(files.where(F.col("name").startswith("eval_")).select(by).distinct(), by, "left_anti")


def only_named(manifest: DataFrame, names: DataFrame, by: str = "project") -> DataFrame:
    return manifest.join(names.select(by).distinct(), by, "left_semi")


def folders(paths: DataFrame, path: str = "path") -> DataFrame:
    """Distinct first parts of object names; names without a folder have none."""
    first = F.split_part(path, F.lit("/"), F.lit(1))
    return paths.where(F.contains(F.col(path), F.lit("/")) & (first != "")).select(first.alias("project")).distinct()


def named_like(rows: DataFrame, text: str, name: str = "project", any_case: bool = False) -> DataFrame:
    """Rows whose name contains a text, in its case or in any."""
    given = F.lower(name) if any_case else F.col(name)
    return rows.where(F.contains(given, F.lit(text.lower() if any_case else text)))
