"""Cost roll-up of normalised records, and fee rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.sources.constants import OTHER_SEWER_PRICE, OTHER_WATERMAIN_PRICE, SEWER_PRICES, WATERMAIN_PRICES


def _looked_up(prices: dict[int, Column], diameter: Column, other: float) -> Column:
    """The price of a diameter; zero counts as none."""
    table = F.create_map(*[x for d, p in prices.items() for x in (F.lit(float(d)), p)])
    return F.coalesce(F.nullif(F.try_element_at(table, diameter.cast("double")), F.lit(0.0)), F.lit(other))


def sewer_price(diameter: Column) -> Column:
    return _looked_up({d: F.lit(p) for d, p in SEWER_PRICES.items()}, diameter, OTHER_SEWER_PRICE)


def watermain_price(diameter: Column, params: Column) -> Column:
    return _looked_up({d: params[name].cast("double") for d, name in WATERMAIN_PRICES.items()}, diameter, OTHER_WATERMAIN_PRICE)


def sewer_cost(length: Column, diameter: Column, depth: Column, params: Column) -> Column:
    """Labour by days, pipe by metre and trucking by trench volume; NULL counts as 0."""
    length, diameter, depth = (F.coalesce(c, F.lit(0.0)) for c in (length, diameter, depth))
    labour = (params["dayCostPerDay"] + params["extraPerDay"]) * F.try_divide(length, params["productionMPerDay"])
    width = F.greatest(params["minTrenchWidth"], diameter * 0.0025 + 0.6)
    volume = width * (depth + 0.1 + diameter * 0.00125) * length
    return labour + length * sewer_price(diameter) + volume * params["truckingPerCM"]


def manhole_cost(top: Column, low: Column, materials: Column, labour: Column, params: Column) -> Column:
    """By depth between the elevations, or 2 m unless both are positive."""
    top, low = F.coalesce(top, F.lit(0.0)), F.coalesce(low, F.lit(0.0))
    depth = F.when((top > 0) & (low > 0), top - low).otherwise(2.0)
    own = depth * 500 + 400 + params["laborPerHr"] * (depth * 5 + 15) + depth * 0.5 * params["truckingPerCM"]
    return own + materials + labour


def watermain_cost(length: Column, diameter: Column, params: Column) -> Column:
    labour = (params["dayCostPerDay"] + params["extraPerDay"]) * F.try_divide(length, params["productionMPerDay"])
    return labour + length * watermain_price(diameter, params)


def _summed(items: Column, each) -> Column:
    return F.aggregate(F.transform(F.coalesce(items, F.array()), lambda x: F.coalesce(each(x), F.lit(0.0))), F.lit(0.0).cast("double"), lambda a, b: a + b)


def quote(records: DataFrame) -> DataFrame:
    """Amounts and quantities of each record's quote.

    ``records`` has project, params and the arrays of the normalised record, and may have
    total_override, of which an explicit 0 is kept. Every record is one row, so nothing is shuffled.
    """
    p = F.col("params")
    no_fee = F.filter("sewers", lambda s: ~s["isLineItem"])
    sewers = F.aggregate(F.transform(no_fee, lambda s: sewer_cost(s["length"], s["pipeDiameter"], s["depth"], p["sewers"])), F.lit(0.0), lambda a, b: a + b)
    manholes = _summed(F.col("manholes"), lambda m: manhole_cost(m["topElevation"], m["lowInvert"], m["addMaterials"], m["addLE"], p["manholes"]))
    runs = _summed(F.col("watermain"), lambda w: watermain_cost(w["length"], w["pipeDiameter"], p["watermain"]))
    specials = _summed(F.col("watermainSpecials"), lambda s: s["quantity"] * (s["costEach"] + s["anodeCost"] + s["laborEach"]))
    valves = _summed(F.col("watermainValves"), lambda v: v["quantity"] * (v["valveCost"] + v["boxCost"] + v["anodeCost"] + v["laborPerValve"]))
    override = F.col("total_override").cast("double") if "total_override" in records.columns else F.lit(None).cast("double")
    amounts = records.select(
        "project",
        sewers.alias("sewer_total"), manholes.alias("manhole_total"), (runs + specials + valves).alias("watermain_total"),
        _summed(no_fee, lambda s: s["length"]).alias("sewer_length"),
        F.size("manholes").alias("manhole_count"),
        _summed(F.col("watermain"), lambda w: w["length"]).alias("watermain_length"),
        (p["sewers"]["marginFactor"] - 1).alias("markup"), override.alias("_override"),
    )
    with_sum = amounts.withColumn("subtotal", F.col("sewer_total") + F.col("manhole_total") + F.col("watermain_total"))
    return with_sum.withColumn("grand_total", F.coalesce("_override", F.col("subtotal") * (F.col("markup") + 1))).drop("_override")


def fee_rows(runs: DataFrame, by: str, length: str, is_fee: Column) -> DataFrame:
    """Three fee rows for each group with at least one row: item numbers go up by two, as each row is added before the next is numbered."""
    totals = runs.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum(F.when(~is_fee, F.col(length))), F.lit(0.0)).alias("_length"))
    fees = F.array(
        F.struct((F.col("_n") + 1).alias("item"), F.lit("VIDEO ($25/m)").alias("runLabel"), (F.col("_length") * 25).alias("addMaterials")),
        F.struct((F.col("_n") + 3).alias("item"), F.lit("LAYOUT").alias("runLabel"), F.lit(5000.0).alias("addMaterials")),
        F.struct((F.col("_n") + 5).alias("item"), F.lit("AS BUILT").alias("runLabel"), F.lit(5000.0).alias("addMaterials")),
    )
    return totals.select(by, F.inline(fees))


def merged_params(default: dict[str, float], override: Column) -> Column:
    """A section's parameters: each field from the override (a map of numbers) where it has one."""
    return F.struct(*[F.coalesce(F.try_element_at(override, F.lit(k)), F.lit(v)).alias(k) for k, v in default.items()])
