"""From raw records to typed ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.functions.pipes import percent_slope, standard_diameter
from gradeline.functions.values import bound, number, or_default, text_or, truthy
from gradeline.sources.constants import LABOR_RATES
from gradeline.sources.records import CATCHBASIN, SEWER, WATERMAIN

#: More sewer rows than this ask for the long template.
SHORT_TEMPLATE_SEWERS = 40


def _num(x: Column, name: str, default: float = 0.0) -> Column:
    return bound(number(x[name]), lambda n: or_default(n, default)).alias(name)


def _kept(x: Column, name: str) -> Column:
    """A nullable number: zero stays, text that is no number is NULL."""
    return number(x[name]).alias(name)


def _size(x: Column, name: str) -> Column:
    """A nullable diameter; anything that is there is brought to a standard size."""
    return F.when(x[name].isNotNull(), bound(number(x[name]), standard_diameter)).alias(name)


def _item(i: Column) -> Column:
    return (i + 1).alias("item")


def _rows(column: Column, make) -> Column:
    """The transformed array; no array gives an empty one."""
    made = F.transform(column, make)
    return F.coalesce(made, F.slice(F.transform(F.array(F.element_at(column, 1)), lambda x: make(x, F.lit(0))), 1, 0))


def normalized(records: DataFrame, as_of: str, name: Column | str = "project", only: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Typed record of each raw one (column ``raw``); ``as_of`` is the date where a record has none.

    ``only`` names the fields of sewers, watermain and groups that are asked for; then nothing else of the lists is looked at.
    """
    r = F.col("raw")
    entry = lambda section, names, *made: F.struct(*[c for n, c in zip(names, made, strict=True) if only is None or n in only[section]])
    fallback = F.col(name) if isinstance(name, str) else name
    groups = _rows(r["catchbasins"]["groups"], lambda g, i: entry("groups", CATCHBASIN,
        text_or(g["type"], "SINGLE_CB").alias("type"), _num(g, "quantity"), _num(g, "wallThickness", 4), _num(g, "depth", 2.2), _num(g, "grateEach"), _num(g, "addMaterials"),
    ))
    rates = F.struct(*[_num(r["catchbasins"]["laborRates"], k, v) for k, v in LABOR_RATES.items()])
    manholes = _rows(r["manholes"], lambda m, i: F.struct(
        _item(i), text_or(m["description"]).alias("description"), _kept(m, "topElevation"), _kept(m, "lowInvert"), _kept(m, "highInvert"), _kept(m, "pipeOutDiameter"),
        F.nullif(m["structureType"], F.lit("")).alias("structureType"), _num(m, "addMaterials"), _num(m, "addLE"), _kept(m, "depth"), _kept(m, "drop"), _size(m, "diameter"),
    ))
    sewers = _rows(r["sewers"], lambda s, i: entry("sewers", ("item", *SEWER),
        _item(i), text_or(s["runLabel"]).alias("runLabel"), truthy(s["isLineItem"]).alias("isLineItem"), F.nullif(s["lineItemType"], F.lit("")).alias("lineItemType"),
        _kept(s, "length"), _size(s, "pipeDiameter"), _kept(s, "typeClass"), bound(number(s["slope"]), percent_slope).alias("slope"), _kept(s, "depth"), _num(s, "addMaterials"), _num(s, "addLE"),
    ))
    watermain = _rows(r["watermain"], lambda w, i: entry("watermain", ("item", *WATERMAIN),
        _item(i), text_or(w["sizeAndType"]).alias("sizeAndType"), _num(w, "length"), bound(bound(number(w["pipeDiameter"]), lambda n: or_default(n, 0)), standard_diameter).alias("pipeDiameter"),
        _num(w, "ocSc", 1.1), _num(w, "addMaterials"), _num(w, "addLE"), _num(w, "avgCover", 1.8),
    ))
    specials = _rows(r["watermainSpecials"], lambda s, i: F.struct(
        _item(i), text_or(s["specialName"]).alias("specialName"), _num(s, "quantity"), _num(s, "costEach"), _num(s, "thrustBlock"), _num(s, "anodeCost", 100), _num(s, "laborEach"),
    ))
    valves = _rows(r["watermainValves"], lambda v, i: F.struct(
        _item(i), text_or(v["valveSize"]).alias("valveSize"), _num(v, "quantity"), _num(v, "valveCost"), _num(v, "boxCost", 285), _num(v, "anodeCost", 150), _num(v, "laborPerValve", 150),
    ))
    lists = [F.struct(groups.alias("groups")).alias("catchbasins"), sewers.alias("sewers"), watermain.alias("watermain")]
    if only is None:
        lists = [manholes.alias("manholes"), F.struct(groups.alias("groups"), rates.alias("laborRates")).alias("catchbasins"), *lists[1:], specials.alias("watermainSpecials"), valves.alias("watermainValves")]
    return records.select(
        text_or(r["projectName"], fallback).alias("project"),
        text_or(r["jobNumber"]).alias("jobNumber"),
        text_or(r["date"], as_of).alias("date"),
        F.when(F.coalesce(F.size(r["sewers"]), F.lit(0)) > SHORT_TEMPLATE_SEWERS, "LONG").otherwise("SHORT").alias("templateType"),
        *lists,
        or_default(number(r["confidence"]), 0.5).alias("confidence"),
        F.coalesce(r["warnings"], F.array().cast("array<string>")).alias("warnings"),
    )


def listed(records: DataFrame, name: Column | str = "project") -> DataFrame:
    """Name and lists of each raw record as ``normalized`` has them in number and order, with leaves as they came: for what only counts entries."""
    r = F.col("raw")
    fallback = F.col(name) if isinstance(name, str) else name
    kinds = dict(records.select("raw.*", "raw.catchbasins.groups").dtypes)
    rows = lambda column, n: F.coalesce(column, F.array().cast(kinds[n])).alias(n)
    whole = [rows(r[n], n) for n in ("manholes", "sewers", "watermain", "watermainSpecials", "watermainValves")]
    return records.select(text_or(r["projectName"], fallback).alias("project"), F.struct(rows(r["catchbasins"]["groups"], "groups")).alias("catchbasins"), *whole)


def combined(responses: DataFrame, as_of: str) -> DataFrame:
    """One raw record for each project from its three section responses (project, stage, raw); a missing one counts as empty.

    The confidence is the manhole stage's, or else 0.9 plus the sewer stage's, over three: the sum
    binds closer than the defaults in this formula, and the usual value is 0.3.
    """
    stage = lambda s: F.first(F.when(F.col("stage") == s, F.col("raw")), ignorenulls=True)
    wide = responses.groupBy("project").agg(*[stage(s).alias(s) for s in ("manholes", "sewers", "watermain")])
    m, s, w = (F.col(c) for c in ("manholes", "sewers", "watermain"))
    sure = lambda x: number(x["confidence"])
    chosen = F.coalesce(F.nullif(sure(m), F.lit(0.0)), F.nullif(sure(s) + 0.9, F.lit(0.0)), F.nullif(sure(w) + 0.9, F.lit(0.0)), F.lit(0.9)) / 3
    none = F.array().cast("array<string>")
    record = F.struct(
        text_or(m["projectName"], text_or(s["projectName"], F.col("project"))).alias("projectName"),
        text_or(m["jobNumber"], text_or(s["jobNumber"])).alias("jobNumber"),
        text_or(m["date"], text_or(s["date"], as_of)).alias("date"),
        m["manholes"].alias("manholes"), m["catchbasins"].alias("catchbasins"), s["sewers"].alias("sewers"),
        w["watermain"].alias("watermain"), w["watermainSpecials"].alias("watermainSpecials"), w["watermainValves"].alias("watermainValves"),
        chosen.cast("string").alias("confidence"),
        F.concat(*[F.coalesce(x["warnings"], none) for x in (m, s, w)]).alias("warnings"),
    )
    return wide.select("project", record.alias("raw"))


def with_fees(records: DataFrame) -> DataFrame:
    """Append the standard fee rows to records with at least one sewer row; item numbers go n+1, n+3, n+5."""
    length = F.aggregate(F.filter("sewers", lambda s: ~s["isLineItem"]), F.lit(0.0), lambda a, s: a + F.coalesce(s["length"], F.lit(0.0)))
    none = F.lit(None).cast("double")

    def fee(offset: int, label: str, amount: Column) -> Column:
        return F.struct(
            (F.size("sewers") + offset).alias("item"), F.lit(label).alias("runLabel"), F.lit(True).alias("isLineItem"), F.lit(None).cast("string").alias("lineItemType"),
            *[none.alias(c) for c in ("length", "pipeDiameter", "typeClass", "slope", "depth")], amount.alias("addMaterials"), F.lit(0.0).alias("addLE"),
        )

    fees = F.array(fee(1, "VIDEO ($25/m)", length * 25), fee(3, "LAYOUT", F.lit(5000.0)), fee(5, "AS BUILT", F.lit(5000.0)))
    return records.withColumn("sewers", F.when(F.size("sewers") > 0, F.concat("sewers", fees)).otherwise(F.col("sewers")))
