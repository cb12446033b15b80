"""What leaves the engine: quote lines, printed scoreboards, examples and datasets from workbooks, versioned state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeline.functions.display import currency, padded
from gradeline.functions.values import number, or_default
from gradeline.operators.learning import Rules, is_standard_fee
from gradeline.operators.ordinals import numbered
from gradeline.operators.statistics import REQUIRED_SHEETS
from gradeline.operators.validate import shown
from gradeline.sources.constants import CATCHBASIN_ROWS


# What every quote says it includes and excludes, and how long it holds.
SCOPE = (
    "Excavation, backfill, and compaction", "Granular and crushed stone bedding", "Trucking of excess material", "All fittings and connections as shown on drawings",
)
EXCLUSIONS = ("Rock excavation", "Dewatering (if required)", "Asphalt and curb restoration", "Permits and inspection fees", "HST")
VALIDITY = "This quotation is valid for 30 days from the date above."


def quote_lines(quotes: DataFrame) -> DataFrame:
    """(project, line, part, quantity, description, amount) of each quote, in order.

    Three items, subtotal, markup and total; then what it includes and excludes, notes where ``quotes`` has any, and
    how long it holds.
    """
    percent = F.concat(F.lit("MARKUP ("), F.round(F.col("markup") * 100).cast("int").cast("string"), F.lit("%)"))
    none, metres = F.lit(None).cast("string"), lambda c: F.concat(shown(F.col(c)), F.lit("m"))
    count = F.col("manhole_count").cast("string")
    notes = F.nullif(F.col("notes"), F.lit("")) if "notes" in quotes.columns else none
    long = lambda c: F.concat(shown(F.col(c)), F.lit(" m"))
    rows = [
        ("item", long("sewer_length"), F.lit("Sewer Installation"), F.col("sewer_total")),
        ("item", F.concat(count, F.lit(" ea")), F.lit("Manholes & Catchbasins"), F.col("manhole_total")),
        ("item", long("watermain_length"), F.lit("Watermain Installation"), F.col("watermain_total")),
        ("total", none, F.lit("SUB TOTAL"), F.col("subtotal")),
        ("total", none, percent, F.col("subtotal") * F.col("markup")),
        ("total", none, F.lit("GRAND TOTAL"), F.col("grand_total")),
        ("scope", none, F.concat(F.lit("Supply and install "), metres("sewer_length"), F.lit(" of storm/sanitary sewer")), None),
        ("scope", none, F.concat(F.lit("Supply and install "), count, F.lit(" manholes/catchbasins")), None),
        ("scope", none, F.concat(F.lit("Supply and install "), metres("watermain_length"), F.lit(" of watermain")), None),
        *[("scope", none, F.lit(t), None) for t in SCOPE],
        *[("exclusion", none, F.lit(t), None) for t in EXCLUSIONS],
        ("note", none, notes, None),
        ("validity", none, F.lit(VALIDITY), None),
    ]
    made = [
        F.struct(F.lit(i).alias("line"), F.lit(k).alias("part"), q.alias("quantity"), d.alias("description"), (none if a is None else currency(a)).alias("amount"))
        for i, (k, q, d, a) in enumerate(rows, 1)
    ]
    return quotes.select("project", F.inline(F.array(*made))).where("description is not null")


def printed(rows: DataFrame, width: int = 50) -> DataFrame:
    """One text line for each project, best first."""
    place = lambda c: F.coalesce(F.concat(F.format_number(c, 1), F.lit("%")), F.lit("N/A"))
    line = F.concat_ws(" ", padded(F.col("project"), width), F.lpad(place(F.col("overall")), 7, " "), F.format_string("(%d/%d)", "matching_cells", "total_cells"))
    return rows.orderBy(F.desc("overall"), F.asc("project")).select(line.alias("line"))


SECTIONS = ("mh_structures", "mh_catchbasins", "sewers", "watermain")
_BAR = " │ "


def fixed(value: Column, places: int) -> Column:
    """A number from 0 on as text with 0 or 1 places, by its exact binary value; a number right between two texts gives the larger one."""
    units = value * (20 if places else 2)
    tie = (value * 4 == F.floor(value * 4)) & (units % 2 == 1)
    return F.call_function("format_number", F.when(tie, value + 0.25 * 10**-places).otherwise(value), F.lit("0.0" if places else "0"))


def _percent(value: Column, places: int) -> Column:
    return F.when(value.isNull(), "N/A").otherwise(F.concat(fixed(value, places), F.lit("%")))


def _left(text: Column, width: int) -> Column:
    """A text filled up on the left; longer ones stay whole."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, " "))


def _right(text: Column, width: int) -> Column:
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, " "))


def board_lines(rows: DataFrame, width: int = 50) -> DataFrame:
    """The table of a run: one line for each project with its sections, overall accuracy and cells, best first."""
    columns = [padded(F.col("project"), width), *[_left(_percent(F.col(c), 0), 8) for c in SECTIONS], _left(_percent(F.col("overall"), 1), 8), _left(F.col("total_cells").cast("string"), 6)]
    return rows.orderBy(F.desc("overall"), F.asc("project")).select(F.concat_ws(_BAR, *columns).alias("line"))


def golden_lines(rows: DataFrame, width: int = 50) -> DataFrame:
    """The table of chosen projects: sections with one place, or errors where the project failed (``failed``)."""
    found = F.concat_ws(_BAR, *[_right(_percent(F.col(c), 1), 6) for c in SECTIONS], _percent(F.col("overall"), 1))
    errors = F.lit(_BAR.join(["ERROR "] * len(SECTIONS) + ["ERROR"]))
    return rows.select(F.concat(_right(F.col("project"), width), F.lit("│ "), F.when(F.col("failed"), errors).otherwise(found)).alias("line"))


def comparison_lines(reports: DataFrame, diffs: DataFrame, most: int = 15) -> DataFrame:
    """(project, section, place, line): what a comparison shows of each section.

    ``reports`` has project, section, total_cells, matching_cells, missing_rows and extra_rows; ``diffs`` has project, section, ord,
    row, column_name, truth, found and pct_error. After the first ``most`` differences comes how many more there are.
    """
    by = ["project", "section"]
    share = F.when(F.col("total_cells") > 0, fixed(F.try_divide(F.col("matching_cells") * 100.0, F.col("total_cells")), 1)).otherwise("N/A")
    head = F.array(
        F.concat(F.lit("  "), "section"), F.concat(F.lit("     Accuracy: "), share, F.format_string("%% (%d/%d)", "matching_cells", "total_cells")),
        F.format_string("     Missing rows: %d | Extra rows: %d", "missing_rows", "extra_rows"),
    )
    ranked = diffs.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("ord", "column_name")))
    shown_error = F.when(F.col("pct_error").isNull(), "").otherwise(F.concat(F.lit(" ("), fixed(F.col("pct_error"), 1), F.lit("% err)")))
    one = F.concat(F.format_string('        Row %d [%s]: truth="%s" vs gen="%s"', "row", "column_name", "truth", "found"), shown_error)
    counts = diffs.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    heads = reports.join(counts, by, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    count = F.when(F.col("_n") > 0, F.format_string("     %d mismatches:", "_n"))
    rest = F.when(F.col("_n") > most, F.format_string("        ... and %d more", F.col("_n") - most))
    top = heads.select(*by, F.posexplode(F.concat(head, F.array(count))).alias("place", "line"))
    lines = ranked.where(F.col("_rank") <= most).select(*by, (F.col("_rank") + 9).alias("place"), one.alias("line"))
    end = heads.select(*by, F.lit(most + 10).alias("place"), rest.alias("line"))
    return top.unionByName(lines).unionByName(end).where("line is not null")


def _sheet_rows(cells: DataFrame, by: str, blocks: list[tuple[str, int, int]], columns: str) -> DataFrame:
    """(by, sheet, row, and a struct<num, text> for each column): the rows within blocks (sheet, first, last).

    What lies outside of them comes as one row of its sheet without a number, so no workbook is lost. A workbook's cells are
    dealt to one task, which makes its rows and then its lists of them.
    """
    inside = reduce(lambda a, b: a | b, [(F.col("sheet") == s) & F.col("row").between(first, last) for s, first, last in blocks])
    at = lambda c: F.max(F.when(F.col("col") == c, F.struct("num", "text")))
    return cells.repartition(by).groupBy(by, "sheet", F.when(inside, F.col("row")).alias("row")).agg(*[at(c).alias(c) for c in columns])


def _filled(cell: Column) -> Column:
    """Whether a cell holds something: a number but zero, or a text."""
    return F.coalesce(F.nullif(cell["num"], F.lit(0.0)).isNotNull(), F.lit(False)) | F.coalesce(cell["text"] != "", F.lit(False))


def _as_text(cell: Column) -> Column:
    return F.coalesce(cell["text"], shown(F.nullif(cell["num"], F.lit(0.0))), F.lit(""))


def _as_number(cell: Column, default: float | None = 0.0) -> Column:
    """The number of a cell, a text with a number included; without a default, NULL where the cell is empty."""
    value = F.coalesce(cell["num"], number(cell["text"]))
    return value if default is None else or_default(value, default)


def _within(sheet: str, first: int, last: int) -> Column:
    return (F.col("sheet") == sheet) & F.col("row").between(first, last)


def _listed(on: Column, row: Column) -> Column:
    """The rows of a group for which ``on`` holds, in their order; an empty list for none."""
    return F.sort_array(F.collect_list(F.when(on, row)))


def dataset_records(cells: DataFrame, by: str = "path") -> DataFrame:
    """(by, manholes, sewers, watermain): the ground-truth dataset of workbooks, rows in sheet order.

    A row counts if it has a label or a top elevation (manholes) or length (others). Manhole rows go from 11 to 60, so
    catchbasins are counted as well. Empty numbers are 0, but structure type 1, class 1.1 and cover 1.8.
    """
    lists, blocks = [], []
    for name, sheet, first, last, columns, needs, defaults in (
        ("manholes", "MANHOLES (1)", 11, 60, {"description": "B", "topElevation": "C", "lowInvert": "D", "highInvert": "E", "pipeOutDiameter": "F", "structureType": "G"}, "C", {"structureType": 1.0}),
        ("sewers", "SEWERS (1)", 14, 55, {"runLabel": "B", "length": "C", "pipeDiameter": "D", "typeClass": "E", "slope": "F", "depth": "G"}, "C", {}),
        ("watermain", "WATERMAIN (1)", 13, 19, {"sizeAndType": "B", "length": "C", "pipeDiameter": "D", "ocSc": "F", "avgCover": "J"}, "C", {"ocSc": 1.1, "avgCover": 1.8}),
    ):
        label, *numbers = columns
        row = F.struct("row", _as_text(F.col(columns[label])).alias(label), *[_as_number(F.col(columns[n]), defaults.get(n, 0.0)).alias(n) for n in numbers])
        lists.append(_listed(_within(sheet, first, last) & (_filled(F.col(columns[label])) | _filled(F.col(needs))), row).alias(name))
        blocks.append((sheet, first, last))
    return _sheet_rows(cells, by, blocks, "BCDEFGJ").groupBy(by).agg(*lists)


def is_line_item(length: Column, diameter: Column) -> Column:
    """A sewer row without length and diameter is a fee or a divider."""
    return (F.coalesce(length, F.lit(0.0)) == 0) & (F.coalesce(diameter, F.lit(0.0)) == 0)


def example_records(cells: DataFrame, by: str = "path") -> DataFrame:
    """What an example holds of each workbook that has both sheets: header, manholes, catchbasins and rates, sewers without
    standard fees; watermain lists are empty."""
    texts = {"B2": "projectName", "B3": "jobNumber", "B5": "date"}
    rates = {"C59": ("scbLabor", 200.0), "C60": ("dcbLabor", 250.0), "F59": ("dicbFC", 465.0), "F60": ("ddicbFC", 715.0)}
    manholes, basins, sewers = ("MANHOLES (1)", 11, 50), ("MANHOLES (1)", 53, 56), ("SEWERS (1)", 14, 55)
    rows = _sheet_rows(cells, by, [manholes, basins, sewers, ("MANHOLES (1)", 2, 5), ("MANHOLES (1)", 59, 60)], "BCDEFGHIJ")
    head = [F.max(F.when((F.col("sheet") == "MANHOLES (1)") & (F.col("row") == int(r[1:])), F.col(r[0]))).alias(r) for r in (*texts, *rates)]
    values = lambda columns: [_as_number(F.col(c), d).alias(n) for c, (n, d) in columns.items()]
    more = {"H": ("addMaterials", 0.0), "I": ("addLE", 0.0)}
    one = F.struct("row", _as_text(F.col("B")).alias("description"), *values({"J": ("depth", None), **more}))
    kind = F.try_element_at(F.create_map(*[x for k, v in CATCHBASIN_ROWS.items() for x in (F.lit(v), F.lit(k))]), F.col("row"))
    group = F.struct("row", kind.alias("type"), *values({"C": ("quantity", 0.0), "D": ("wallThickness", 4.0), "E": ("depth", 2.2), "F": ("grateEach", 0.0), "G": ("addMaterials", 0.0)}))
    item = ~_filled(F.col("C")) & ~_filled(F.col("D"))
    numbers = {"C": "length", "D": "pipeDiameter", "E": "typeClass", "F": "slope", "G": "depth"}
    run = F.struct("row", _as_text(F.col("B")).alias("runLabel"), item.alias("isLineItem"), *values({**{c: (n, None) for c, n in numbers.items()}, **more}))
    both = rows.groupBy(by).agg(
        *[F.max(F.col("sheet") == s).alias(f"_has{i}") for i, s in enumerate(REQUIRED_SHEETS)], *head,
        _listed(_within(*manholes) & _filled(F.col("B")), one).alias("manholes"), _listed(_within(*basins) & _filled(F.col("C")), group).alias("groups"),
        _listed(_within(*sewers) & _filled(F.col("B")) & ~(item & is_standard_fee(_as_text(F.col("B")))), run).alias("sewers"),
    ).where(" and ".join(f"_has{i}" for i in range(len(REQUIRED_SHEETS))))
    name = F.when(_filled(F.col("B2")), _as_text(F.col("B2"))).otherwise(F.col(by).cast("string"))
    return both.select(
        by, name.alias("projectName"), *[_as_text(F.col(r)).alias(n) for r, n in texts.items() if r != "B2"], "manholes",
        F.struct("groups", F.struct(*[_as_number(F.col(r), d).alias(n) for r, (n, d) in rates.items()]).alias("laborRates")).alias("catchbasins"), "sewers",
    )


def learned_state(rules: Rules, examples: DataFrame) -> DataFrame:
    """(kind, place, text): what has been learned, as rows: prompt rules, heuristics and names of examples in their order."""
    spark = examples.sparkSession
    listed = [(k, i, r["rule"]) for k, rs in (("prompt", rules.prompt), ("heuristic", rules.heuristics)) for i, r in enumerate(rs, 1)]
    rows = spark.createDataFrame(listed, "kind string, place long, text string")
    return rows.unionByName(numbered(examples.select("ord", "projectName"), [], "ord", "place").select(F.lit("example").alias("kind"), "place", F.col("projectName").alias("text")))


def state_counts(state: DataFrame) -> DataFrame:
    """(kind, n) of a learned state."""
    return state.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
