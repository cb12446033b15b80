"""Cells that a record writes into a template workbook.

The result is a table (project, sheet, ref, num, text, force): a cell without ``force`` is left
alone where the template has a formula.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.functions.pipes import percent_slope, standard_diameter
from gradeline.functions.values import bound, number, text_or
from gradeline.operators.sections import FIELDS
from gradeline.sources.constants import CATCHBASIN_ROWS, LABOR_RATES, PARAM_CELLS

# Columns of each block's fields as (column, field, forced, zero is written), with the rows of the block.
BLOCKS = {
    "manholes": ("MANHOLES (1)", 11, 50, (
        ("B", "description", False, True), ("C", "topElevation", False, False), ("D", "lowInvert", False, False), ("E", "highInvert", False, False),
        ("F", "pipeOutDiameter", False, False), ("G", "structureType", False, True), ("H", "addMaterials", False, False), ("I", "addLE", False, False),
        ("J", "depth", True, True), ("K", "drop", True, True), ("L", "diameter", True, True),
    )),
    "sewers": ("SEWERS (1)", 14, 55, (
        ("B", "runLabel", False, True), ("C", "length", False, False), ("D", "pipeDiameter", False, False), ("E", "typeClass", False, False),
        ("F", "slope", False, False), ("G", "depth", True, False), ("H", "addMaterials", False, False), ("I", "addLE", False, False),
    )),
    "watermain": ("WATERMAIN (1)", 13, 19, (
        ("B", "sizeAndType", False, True), ("C", "length", False, False), ("D", "pipeDiameter", False, False), ("F", "ocSc", False, True),
        ("G", "addMaterials", False, False), ("H", "addLE", False, False), ("J", "avgCover", True, True),
    )),
    "watermainSpecials": ("WATERMAIN (1)", 24, 40, (
        ("B", "specialName", False, True), ("C", "quantity", False, False), ("D", "costEach", False, False), ("E", "thrustBlock", False, True),
        ("F", "anodeCost", False, False), ("G", "laborEach", False, False),
    )),
    "watermainValves": ("WATERMAIN (1)", 24, 40, (
        ("O", "valveSize", False, True), ("P", "quantity", False, False), ("Q", "valveCost", False, False), ("R", "boxCost", False, False),
        ("S", "anodeCost", False, False), ("T", "laborPerValve", False, False),
    )),
}
CATCHBASIN_COLUMNS = (("C", "quantity"), ("D", "wallThickness"), ("E", "depth"), ("F", "grateEach"), ("G", "addMaterials"))
RATE_CELLS = (("C59", "scbLabor"), ("C60", "dcbLabor"), ("F59", "dicbFC"), ("F60", "ddicbFC"))
HEADER_CELLS = (("B2", "project"), ("B3", "jobNumber"), ("B5", "date"))
_TEXT = {"description", "structureType", "runLabel", "sizeAndType", "specialName", "valveSize"}


def _cell(sheet: str, ref: Column, num: Column | None, text: Column | None, force: bool = False) -> Column:
    return F.struct(
        F.lit(sheet).alias("sheet"), ref.alias("ref"),
        (F.lit(None).cast("double") if num is None else num.cast("double")).alias("num"),
        (F.lit(None).cast("string") if text is None else F.nullif(text, F.lit(""))).alias("text"),
        F.lit(force).alias("force"),
    )


def rows_to_cells(rows: Column, sheet: str, first: int, last: int, columns) -> Column:
    """Cells of an array of structs, one sheet row each; rows beyond the block are dropped."""

    def one(x: Column, i: Column) -> Column:
        row = (i + first).cast("string")
        made = []
        for column, name, force, zero in columns:
            ref = F.concat(F.lit(column), row)
            if name in _TEXT:
                made.append(_cell(sheet, ref, None, x[name], force))
            else:
                made.append(_cell(sheet, ref, x[name] if zero else F.nullif(x[name], F.lit(0.0)), None, force))
        return F.array(*made)

    return F.flatten(F.transform(F.slice(rows, 1, last - first + 1), one))


def cell_writes(records: DataFrame) -> DataFrame:
    """The cells of normalised records with their params. Catchbasin groups of one type write the same cells."""
    parts = [F.array(*[_cell(sheet, F.lit(ref), None, F.col(name)) for sheet in ("MANHOLES (1)",) for ref, name in HEADER_CELLS])]
    for section, (sheet, cells) in PARAM_CELLS.items():
        parts.append(F.array(*[_cell(sheet, F.lit(ref), F.col(f"params.{section}.{name}"), None) for ref, name in cells.items()]))
    for name, (sheet, first, last, columns) in BLOCKS.items():
        parts.append(rows_to_cells(F.col(name), sheet, first, last, columns))
    at = F.create_map(*[x for k, v in CATCHBASIN_ROWS.items() for x in (F.lit(k), F.lit(str(v)))])
    groups = F.filter("catchbasins.groups", lambda g: F.try_element_at(at, g["type"]).isNotNull())
    parts.append(F.flatten(F.transform(groups, lambda g: F.array(*[
        _cell("MANHOLES (1)", F.concat(F.lit(c), F.try_element_at(at, g["type"])), F.nullif(g[n], F.lit(0.0)), None) for c, n in CATCHBASIN_COLUMNS
    ]))))
    rates = F.col("catchbasins.laborRates")
    parts.append(F.array(*[_cell("MANHOLES (1)", F.lit(ref), F.nullif(rates[n], F.lit(0.0)), None) for ref, n in RATE_CELLS]))
    return records.select("project", F.inline(F.concat(*parts))).where("num is not null or text is not null")


def _places() -> dict[str, list[tuple]]:
    """The cells of a row of each block as (column, field, how, default, zero is written, forced), and the single cells, whose column is a whole reference."""
    rows = {name: [(c, f, *(FIELDS[name][f] + (None,))[:2], zero, force) for c, f, force, zero in columns] for name, (_, _, _, columns) in BLOCKS.items()}
    rows["groups"] = [(c, f, *FIELDS["catchbasins.groups"][f], False, False) for c, f in CATCHBASIN_COLUMNS]
    rows["head"] = [(ref, f, "text", None, True, False) for ref, f in HEADER_CELLS]
    rows["rates"] = [(ref, f, "number", LABOR_RATES[f], False, False) for ref, f in RATE_CELLS]
    return rows | {f"params.{section}": [(ref, f, "kept", None, True, False) for ref, f in cells.items()] for section, (_, cells) in PARAM_CELLS.items()}


def raw_writes(records: DataFrame, as_of: str, name: str = "project") -> DataFrame:
    """The cells of raw records (column ``raw``) with their params: those that ``cell_writes`` makes of the records once ``normalize`` has typed them.

    No typed record is made: the leaves go to their cells as they came, one row each, and all are coerced in one flat column.
    """
    r, places = F.col("raw"), _places()
    sheets = {n: sheet for n, (sheet, *_) in BLOCKS.items()} | {f"params.{n}": sheet for n, (sheet, _) in PARAM_CELLS.items()}
    first = dict(zip(places, [sum(map(len, list(places.values())[:i])) for i in range(len(places))], strict=True))
    spec = F.array(*[
        F.struct(F.lit(sheets.get(n, "MANHOLES (1)")).alias("sheet"), F.lit(c).alias("column"), F.lit(how).alias("how"), F.lit(default if how == "number" else None).cast("double").alias("default"), F.lit(zero).alias("zero"), F.lit(force).alias("force"))
        for n, cells in places.items() for c, _, how, default, zero, force in cells
    ])

    def line(n: str, row: Column, leaves: list[Column]) -> Column:
        """A sheet row of leaves, which go to the places from the list's first one on."""
        return F.struct(F.lit(first[n]).alias("first"), row.alias("row"), F.array(*[x.cast("string") for x in leaves]).alias("leaves"))

    def lines(n: str, rows: Column, row, last: int) -> Column:
        made = F.transform(F.slice(rows, 1, last), lambda x, i: line(n, row(x, i), [x[f] for _, f, *_ in places[n]]))
        return F.coalesce(made, F.array().cast("array<struct<first:int,row:string,leaves:array<string>>>"))

    single = F.lit("")
    head = {"project": F.col("project"), "jobNumber": text_or(r["jobNumber"]), "date": text_or(r["date"], as_of)}
    at = F.create_map(*[x for k, v in CATCHBASIN_ROWS.items() for x in (F.lit(k), F.lit(str(v)))])
    basins = F.filter(r["catchbasins"]["groups"], lambda g: F.try_element_at(at, text_or(g["type"], FIELDS["catchbasins.groups"]["type"][1])).isNotNull())
    made = [F.array(
        line("head", single, [head[f] for _, f, *_ in places["head"]]), line("rates", single, [r["catchbasins"]["laborRates"][f] for _, f, *_ in places["rates"]]),
        *[line(f"params.{n}", single, [F.col(f"params.{n}.{f}") for _, f, *_ in places[f"params.{n}"]]) for n in PARAM_CELLS],
    )]
    made += [lines(n, r[n], lambda x, i, top=top: (i + top).cast("string"), last - top + 1) for n, (_, top, last, _) in BLOCKS.items()]
    made.append(lines("groups", basins, lambda x, i: F.try_element_at(at, text_or(x["type"], FIELDS["catchbasins.groups"]["type"][1])), 2**31 - 1))
    named = records.withColumn("project", text_or(r["projectName"], F.col(name)))
    # Each project has lines and each line has leaves; said so by "outer", or Spark would make all lines once more to find out.
    rows = named.select("project", F.concat(*made).alias("_lines")).select("project", F.inline_outer("_lines"))
    cells = rows.select("project", "first", "row", F.posexplode_outer("leaves").alias("_at", "_leaf"))
    cells = cells.select("project", "row", "_leaf", (F.col("first") + F.col("_at")).alias("_place"))
    # A leaf that is missing is gone at once, unless its place has a default that is written.
    default = F.array(*[F.lit((how in ("number", "sized") and zero) or (how == "number" and default != 0)) for named in places.values() for _, _, how, default, zero, _ in named])
    cells = cells.where(F.col("_leaf").isNotNull() | F.get(default, F.col("_place")))
    to, n = F.get(spec, F.col("_place")), F.col("_n")
    how = to["how"]
    cells = cells.withColumn("_n", F.when(how != "text", number(F.col("_leaf"))))  # texts are most often no numbers, which is costly to find out
    # The many sizes are bound, as generated code that holds them all is too long to be compiled.
    num = (
        F.when(how == "kept", n).when(how == "number", F.coalesce(F.nullif(n, F.lit(0.0)), to["default"])).when(how == "slope", percent_slope(n))
        .when((how == "size") & F.col("_leaf").isNotNull(), bound(n, standard_diameter)).when(how == "sized", bound(F.coalesce(n, F.lit(0.0)), standard_diameter))
    )
    cells = cells.select("project", "row", "_leaf", "_place", num.alias("_n"))
    cell = F.struct(
        to["sheet"].alias("sheet"), F.concat(to["column"], "row").alias("ref"), F.when(to["zero"] | (n != 0), n).alias("num"),
        F.when(how == "text", F.nullif("_leaf", F.lit(""))).alias("text"), to["force"].alias("force"),
    )
    return _filled(cells.select("project", F.inline(F.array(cell))))  # as a list of one, so that numbers are not read again to filter


def _filled(cells: DataFrame) -> DataFrame:
    return cells.where("num is not null or text is not null")


def section_writes(rows: DataFrame, name: str) -> DataFrame:
    """The cells of a section's typed rows (project, item, fields); rows beyond the block are dropped."""
    sheet, first, last, columns = BLOCKS[name]
    row = (F.col("item") + (first - 1)).cast("string")
    cells = [
        _cell(sheet, F.concat(F.lit(c), row), None if f in _TEXT else F.col(f) if zero else F.nullif(F.col(f), F.lit(0.0)), F.col(f) if f in _TEXT else None, force) for c, f, force, zero in columns
    ]
    return _filled(rows.where(F.col("item") <= last - first + 1).select("project", F.inline(F.array(*cells))))


def basin_writes(rows: DataFrame) -> DataFrame:
    """The cells of catchbasin groups (project, item, type, fields); of groups of one type the last value but zero of each field is there."""
    named = rows.where(F.col("type").isin(*CATCHBASIN_ROWS))
    last = named.groupBy("project", "type").agg(*[F.max_by(F.col(n), F.when(F.col(n) != 0, F.col("item"))).alias(n) for _, n in CATCHBASIN_COLUMNS])
    at = F.element_at(F.create_map(*[x for k, v in CATCHBASIN_ROWS.items() for x in (F.lit(k), F.lit(str(v)))]), F.col("type"))
    return _filled(last.select("project", F.inline(F.array(*[_cell("MANHOLES (1)", F.concat(F.lit(c), at), F.col(n), None) for c, n in CATCHBASIN_COLUMNS]))))


def head_writes(heads: DataFrame) -> DataFrame:
    """The cells of the header, the parameters (a struct ``params``) and the labour rates of each project."""
    cells = [_cell("MANHOLES (1)", F.lit(ref), None, F.col(name)) for ref, name in HEADER_CELLS]
    cells += [_cell(sheet, F.lit(ref), F.col(f"params.{section}.{name}"), None) for section, (sheet, refs) in PARAM_CELLS.items() for ref, name in refs.items()]
    cells += [_cell("MANHOLES (1)", F.lit(ref), F.nullif(F.col(n), F.lit(0.0)), None) for ref, n in RATE_CELLS]
    return _filled(heads.select("project", F.inline(F.array(*cells))))


def guarded(writes: DataFrame, formulas: DataFrame) -> DataFrame:
    """The writes that don't meet a formula of the template (sheet, ref), or are forced."""
    held = F.broadcast(formulas.select("sheet", "ref", F.lit(True).alias("_formula")).distinct())
    return writes.join(held, ["sheet", "ref"], "left").where("force or _formula is null").select(writes.columns)  # one pass over the writes


_REFERENCE = re.compile(r"([A-Z]+)(\$?)(\d+)")


def shifted_formula(formula: str, rows: int) -> str:
    """A formula moved down by some rows; absolute rows stay. Digits of function names move too, as the pattern can't tell them apart."""
    return _REFERENCE.sub(lambda m: m[0] if m[2] or not rows else f"{m[1]}{int(m[3]) + rows}", formula)


def expanded_formulas(cells: dict[str, dict], columns: tuple[str, ...] = ("J", "K", "L"), first: int = 11, last: int = 50) -> dict[str, str]:
    """Own formulas for the cells of shared ones.

    ``cells`` maps a reference to {"formula"} of a master or {"shared": master's reference} of a member.
    """
    out = {}
    for column in columns:
        for row in range(first, last + 1):
            ref = f"{column}{row}"
            cell = cells.get(ref) or {}
            if "formula" in cell:
                out[ref] = cell["formula"]
            elif "shared" in cell and "formula" in cells.get(cell["shared"], {}):
                out[ref] = shifted_formula(cells[cell["shared"]]["formula"], row - int(re.sub(r"\D", "", cell["shared"])))
    return out


def shifted(formula: Column, rows: Column) -> Column:
    """A formula moved down by some rows, as ``shifted_formula`` does it: the text is cut around its references, each is moved, and the pieces are joined."""
    pieces = F.split(F.regexp_replace(formula, r"([A-Z]+\$?)([0-9]+)", "\x01$1\x02$2\x01"), "\x01")
    head, digits = (lambda x: F.split_part(x, F.lit("\x02"), F.lit(1))), (lambda x: F.split_part(x, F.lit("\x02"), F.lit(2)))
    moved = lambda x: F.concat(head(x), (digits(x).cast("bigint") + rows).cast("string"))
    one = lambda x: F.when(~F.contains(x, F.lit("\x02")), x).when(head(x).endswith("$"), F.concat(head(x), digits(x))).otherwise(moved(x))
    return F.when(rows == 0, formula).otherwise(F.array_join(F.transform(pieces, one), ""))


def own_formulas(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, col, row, formula): a formula of its own for each formula cell (by, col, row, formula, shared).

    ``shared`` is the index of a shared formula within ``by`` (a sheet of a workbook), NULL for other formulas. Its master
    has the text, and a member takes it moved by their distance in rows; a member without a master has none.
    """
    masters = cells.where("shared is not null and formula is not null").select(*by, "shared", F.col("row").alias("_row"), F.col("formula").alias("_text"))
    own = cells.where("formula is not null").select(*by, "col", "row", "formula")
    members = cells.where("shared is not null and formula is null").drop("formula").join(masters, [*by, "shared"])
    return own.unionByName(members.select(*by, "col", "row", shifted(F.col("_text"), F.col("row") - F.col("_row")).alias("formula")))
