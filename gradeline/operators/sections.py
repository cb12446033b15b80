"""Typed rows of the sections of raw responses, one row for each entry.

Each response is parsed once, as VARIANT; its lists are exploded before anything is coerced, so coercions are those of flat
columns. ``normalize`` makes whole nested records of the same content, where text and value of a leaf look alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.functions.leaves import children, kind, leaf, number_of, shown, text_or, truth_of
from gradeline.functions.pipes import percent_slope, standard_diameter
from gradeline.functions.values import bound, or_default
from gradeline.operators.normalize import SHORT_TEMPLATE_SEWERS
from gradeline.sources.constants import LABOR_RATES

# How each field is read: a text with its default, a flag, a number that may be missing ("kept"), one with a default,
# a diameter that may be missing ("size") or not ("sized"), a slope.
FIELDS: dict[str, dict[str, tuple]] = {
    "manholes": {
        "description": ("text", ""), "topElevation": ("kept",), "lowInvert": ("kept",), "highInvert": ("kept",), "pipeOutDiameter": ("kept",), "structureType": ("text", None),
        "addMaterials": ("number", 0), "addLE": ("number", 0), "depth": ("kept",), "drop": ("kept",), "diameter": ("size",),
    },
    "catchbasins.groups": {
        "type": ("text", "SINGLE_CB"), "quantity": ("number", 0), "wallThickness": ("number", 4), "depth": ("number", 2.2), "grateEach": ("number", 0), "addMaterials": ("number", 0),
    },
    "sewers": {
        "runLabel": ("text", ""), "isLineItem": ("flag",), "lineItemType": ("text", None), "length": ("kept",), "pipeDiameter": ("size",), "typeClass": ("kept",), "slope": ("slope",),
        "depth": ("kept",), "addMaterials": ("number", 0), "addLE": ("number", 0),
    },
    "watermain": {
        "sizeAndType": ("text", ""), "length": ("number", 0), "pipeDiameter": ("sized",), "ocSc": ("number", 1.1), "addMaterials": ("number", 0), "addLE": ("number", 0), "avgCover": ("number", 1.8),
    },
    "watermainSpecials": {
        "specialName": ("text", ""), "quantity": ("number", 0), "costEach": ("number", 0), "thrustBlock": ("number", 0), "anodeCost": ("number", 100), "laborEach": ("number", 0),
    },
    "watermainValves": {
        "valveSize": ("text", ""), "quantity": ("number", 0), "valveCost": ("number", 0), "boxCost": ("number", 285), "anodeCost": ("number", 150), "laborPerValve": ("number", 150),
    },
}


def read_as(k: Column, t: Column, n: Column, how: str, default=None) -> Column:
    """A leaf, given by kind, text and number, as the column that its field asks for."""
    if how == "text":
        return text_or(k, t, default)
    if how == "flag":
        return truth_of(k, t)
    if how == "number":
        return or_default(n, default)
    if how == "size":
        return F.when(k.isNotNull(), standard_diameter(n))
    if how == "sized":
        return standard_diameter(or_default(n, 0))
    return percent_slope(n) if how == "slope" else n


def typed(rows: DataFrame, by: list[Column | str], fields: dict[str, tuple]) -> DataFrame:
    """(by, fields) of VARIANT leaves, where fields are leaves by name with how they are read.

    Each leaf is taken out once and looked at once, and numbers are read of those fields only that ask for them.
    """
    names = list(fields)
    out = rows.select(*by, *[fields[f][0].alias(f"_v{i}") for i, f in enumerate(names)])
    held = [c for c in out.columns if not c.startswith("_v")]
    out = out.select(*held, *[c.alias(f"_{n}{i}") for i in range(len(names)) for n, c in (("k", kind(F.col(f"_v{i}"))), ("t", shown(F.col(f"_v{i}"))))])
    words = ("text", "flag")
    read = lambda i, f: read_as(F.col(f"_k{i}"), F.col(f"_t{i}"), F.col(f"_n{i}"), *fields[f][1:])
    looked = [(read(i, f) if fields[f][1] in words else number_of(F.col(f"_k{i}"), F.col(f"_t{i}"))).alias(f"_n{i}") for i, f in enumerate(names)]
    out = out.select(*held, *[f"_k{i}" for i, f in enumerate(names) if fields[f][1] == "size"], *looked)
    return out.select(*held, *[(F.col(f"_n{i}") if fields[f][1] in words else read(i, f)).alias(f) for i, f in enumerate(names)])


def parsed(responses: DataFrame, column: str = "response_json", into: str = "response") -> DataFrame:
    """Add the response as VARIANT; NULL for what is no JSON."""
    return responses.withColumn(into, F.try_parse_json(F.col(column)))


def leaf_rows(responses: DataFrame, as_of: str, by: list[str], name: str = "project", column: str = "response") -> DataFrame:
    """(by, section, item, field, num, text) of each field of the head (item 0) and of each entry of all sections: what ``heads`` and ``section`` read, one row each.

    All leaves of a response come out of it in one pass and are coerced in one flat column.
    """
    fields = {"head": {"projectName": ("text", None), "jobNumber": ("text", ""), "date": ("text", as_of), "confidence": ("number", 0.5), **{k: ("number", v) for k, v in LABOR_RATES.items()}}, **FIELDS}
    flat = [(s, f, *(how + (None,))[:2]) for s, named in fields.items() for f, how in named.items()]
    first = {s: sum(len(x) for x in list(fields.values())[:i]) for i, s in enumerate(fields)}
    spec = F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(f).alias("field"), F.lit(how).alias("how"), F.lit(d if how == "number" else None).cast("double").alias("num"), F.lit(d if how == "text" else None).cast("string").alias("text"))
        for s, f, how, d in flat
    ])
    line = lambda s, item, leaves: F.struct(F.lit(first[s]).alias("first"), item.cast("int").alias("item"), F.array(*leaves).alias("leaves"))

    def lines(s: str) -> Column:
        entries = F.try_variant_get(F.col(column), f"$.{s}", f"array<struct<{','.join(f'{f}:variant' for f in fields[s])}>>")
        return F.coalesce(F.transform(entries, lambda x, i: line(s, i + 1, [x[f] for f in fields[s]])), F.array().cast("array<struct<first:int,item:int,leaves:array<variant>>>"))

    path = lambda f: f"catchbasins.laborRates.{f}" if f in LABOR_RATES else f
    head = F.array(line("head", F.lit(0), [leaf(F.col(column), path(f)) for f in fields["head"]]))
    # Each response has a head and each line has leaves; said so by "outer", or Spark would make all lines once more to find out.
    rows = responses.select(*by, F.col(name).alias("_name"), F.concat(head, *[lines(s) for s in FIELDS]).alias("_lines"))
    rows = rows.select(*by, "_name", F.inline_outer("_lines")).select(*by, "_name", "first", "item", F.posexplode_outer("leaves").alias("_at", "_v"))
    rows = rows.select(*by, "_name", "item", (F.col("first") + F.col("_at")).alias("_place"), kind(F.col("_v")).alias("_k"), shown(F.col("_v")).alias("_t"))
    k, t, n, to = F.col("_k"), F.col("_t"), F.col("_n"), F.get(spec, F.col("_place"))
    how = to["how"]
    rows = rows.withColumn("_n", F.when(~how.isin("text", "flag"), number_of(k, t)))
    # The many sizes are bound, as generated code that holds them all is too long to be compiled.
    num = (
        F.when(how == "kept", n).when(how == "number", F.coalesce(F.nullif(n, F.lit(0.0)), to["num"])).when(how == "slope", percent_slope(n))
        .when((how == "size") & k.isNotNull(), bound(n, standard_diameter)).when(how == "sized", bound(or_default(n, 0), standard_diameter))
    )
    default = F.when(to["field"] == "projectName", F.col("_name")).otherwise(to["text"])
    text = F.when(how == "text", text_or(k, t, default)).when(how == "flag", truth_of(k, t).cast("string"))
    return rows.select(*by, to["section"].alias("section"), "item", to["field"].alias("field"), num.alias("num"), text.alias("text"))


def heads(responses: DataFrame, as_of: str, name: str = "project", column: str = "response", keep: list[str] | None = None) -> DataFrame:
    """Columns to keep, (project, jobNumber, date, templateType, confidence) and the labour rates of each response."""
    sewers = F.coalesce(F.size(children(F.col(column), "sewers")), F.lit(0))
    template = F.when(sewers > SHORT_TEMPLATE_SEWERS, "LONG").otherwise("SHORT")
    fields = {
        "project": ("projectName", "text", F.col("_name")), "jobNumber": ("jobNumber", "text", ""), "date": ("date", "text", as_of), "confidence": ("confidence", "number", 0.5),
        **{k: (f"catchbasins.laborRates.{k}", "number", v) for k, v in LABOR_RATES.items()},
    }
    leaves = {f: (leaf(F.col(column), path), *how) for f, (path, *how) in fields.items()}
    return typed(responses.withColumn("_name", F.col(name)), [*(keep or []), "_name", template.alias("templateType")], leaves).drop("_name")


def section(responses: DataFrame, name: str, by: list[str], column: str = "response", only: list[str] | None = None) -> DataFrame:
    """(by, item, fields) of each entry of a section; ``only`` names the fields that are asked for, the others are not looked at."""
    fields = {f: how for f, how in FIELDS[name].items() if only is None or f in only}
    entries = F.try_variant_get(F.col(column), f"$.{name}", f"array<struct<{','.join(f'{f}:variant' for f in fields)}>>")
    rows = responses.select(*by, F.posexplode(entries).alias("_at", "_entry"))
    return typed(rows, [*by, (F.col("_at") + 1).alias("item")], {f: (F.col("_entry")[f], *how) for f, how in fields.items()})
