"""Prices, parameters and layouts that results depend on."""

from __future__ import annotations

# Default parameters of the three sections.
DEFAULT_PARAMS = {
    "manholes": {
        "truckingPerCM": 10.0, "concretePerCM": 250.0, "discount": 0.35, "marginFactor": 1.1, "fstFactor": 1.0, "pstFactor": 1.0,
        "modPerM": 718.0, "mhFC": 375.0, "cbFC": 500.0, "laborPerHr": 110.0, "frameCoverM": 0.3, "metric": 1.0,
    },
    "sewers": {
        "minTrenchWidth": 1.2, "pipeCover": 0.3, "mFinGrade": 0.0, "dayCostPerDay": 9000.0, "extraPerDay": 300.0, "productionMPerDay": 65.0,
        "stoneImpT": 22.0, "stoneMt": 35.0, "granImpTn": 10.0, "granMt": 30.0, "truckingPerCM": 10.0, "efficiency": 100.0, "metric": 1.0,
        "marginFactor": 1.1, "openCutFactor": 0.9, "dualTrSep": 0.8, "trenchClear": 0.3, "concPipePct": 25.0, "provTax": 1.0, "fedTax": 1.0,
    },
    "watermain": {
        "minTrenchWidth": 1.2, "pipeCover": 0.3, "mFinGrade": 0.0, "dayCostPerDay": 9000.0, "extraPerDay": 300.0, "productionMPerDay": 65.0,
        "stoneImpTon": 22.0, "stoneMtne": 35.0, "granImpTon": 10.0, "granMtne": 30.0, "truckingPerCM": 10.0, "efficiency": 100.0, "metric": 1.0,
        "marginFactor": 1.1, "openCutFactor": 0.9, "dualTrSep": 1.0, "trenchClear": 0.15, "peelRegionCover": 0.0, "precastPct": 5.0,
        "provTax": 1.0, "fedTax": 1.0, "modulocPerM": 620.0,
        "c900_100": 32.0, "c900_150": 51.0, "c900_200": 84.0, "c900_250": 156.0, "c900_300": 194.0, "concPerCM": 250.0,
    },
}

# Sewer pipe prices per metre by diameter; any other diameter.
SEWER_PRICES = {150: 25.0, 200: 35.0, 250: 55.0, 300: 75.0, 375: 105.0, 450: 140.0, 525: 180.0, 600: 230.0, 675: 290.0, 750: 350.0, 900: 500.0}
OTHER_SEWER_PRICE = 50.0

# Parameter that holds the watermain price of each diameter; any other diameter.
WATERMAIN_PRICES = {100: "c900_100", 150: "c900_150", 200: "c900_200", 250: "c900_250", 300: "c900_300"}
OTHER_WATERMAIN_PRICE = 84.0

# Compared sections as (section, sheet, first row, last row, key column, columns with their names).
SECTIONS = (
    ("MANHOLES - Structures", "MANHOLES (1)", 11, 50, "B", {"B": "Description", "H": "Add Mtrls", "I": "Add L&E"}),
    ("MANHOLES - Catchbasins", "MANHOLES (1)", 53, 56, "B", {"B": "CB Type", "C": "QNTY", "E": "DPTHm", "F": "$GT ea", "G": "$/ADDMAT"}),
    ("SEWERS", "SEWERS (1)", 14, 55, "B", {
        "B": "Run Label", "C": "Length", "D": "Pipe Dia", "E": "Type/Class", "F": "Slope", "G": "Depth", "H": "Add Mtrls", "I": "Add L&E",
    }),
    ("WATERMAIN", "WATERMAIN (1)", 13, 19, "B", {"B": "Size & Type", "C": "Length", "D": "Pipe Dia", "F": "OC/SC", "J": "Avg Cover"}),
)

# Cells of the parameters in each sheet.
PARAM_CELLS = {
    "manholes": ("MANHOLES (1)", {
        "F3": "truckingPerCM", "F4": "concretePerCM", "F5": "discount", "F6": "marginFactor", "F7": "metric", "I3": "fstFactor",
        "I4": "pstFactor", "I5": "modPerM", "I6": "mhFC", "I7": "cbFC", "L4": "laborPerHr", "L7": "frameCoverM",
    }),
    "sewers": ("SEWERS (1)", {
        "F3": "minTrenchWidth", "F4": "pipeCover", "F5": "mFinGrade", "F6": "dayCostPerDay", "F7": "extraPerDay", "F8": "productionMPerDay",
        "I3": "stoneImpT", "I4": "stoneMt", "I5": "granImpTn", "I6": "granMt", "I7": "truckingPerCM", "P3": "efficiency", "P4": "metric",
        "P5": "marginFactor", "P6": "openCutFactor", "P7": "dualTrSep", "P8": "concPipePct", "P9": "trenchClear", "V3": "provTax", "V4": "fedTax",
    }),
    "watermain": ("WATERMAIN (1)", {
        "F3": "minTrenchWidth", "F4": "pipeCover", "F5": "mFinGrade", "F6": "dayCostPerDay", "F7": "extraPerDay", "F8": "productionMPerDay",
        "I3": "stoneImpTon", "I4": "stoneMtne", "I5": "granImpTon", "I6": "granMtne", "I7": "truckingPerCM", "I8": "peelRegionCover",
        "O3": "efficiency", "O4": "metric", "O6": "openCutFactor", "O7": "dualTrSep", "O8": "trenchClear", "R4": "precastPct",
        "R7": "modulocPerM", "L3": "c900_100", "L4": "c900_150", "L5": "c900_200", "L6": "c900_250", "L7": "c900_300", "L8": "concPerCM",
        "U3": "provTax", "U4": "fedTax",
    }),
}

# Rows of the catchbasin types, and defaults of the labour rates.
CATCHBASIN_ROWS = {"SINGLE_CB": 53, "DOUBLE_CB": 54, "DITCH_INLET_CB": 55, "DOUBLE_DITCH_INLET_CB": 56}
LABOR_RATES = {"scbLabor": 200.0, "dcbLabor": 250.0, "dicbFC": 465.0, "ddicbFC": 715.0}
