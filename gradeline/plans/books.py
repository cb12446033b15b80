"""Queries that write workbooks and read them back, and formulas of shared cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeline.operators import layout
from gradeline.plans import records
from gradeline.plans.registry import query, read
from gradeline.sources import store, workbooks
from gradeline.sources.constants import CATCHBASIN_ROWS
from gradeline.stages import new_folder

#: A template with the types of the catchbasins and a column of shared formulas, which writes leave alone.
TEMPLATE = {
    "MANHOLES (1)": {
        **{f"B{row}": kind for kind, row in CATCHBASIN_ROWS.items()}, "H11": ("shared", 0, "H11:H50", "I11*$F$6"), **{f"H{i}": ("shared", 0, None, None) for i in range(12, 51)},
        "J11": ("formula", "C11-D11"),
    },
    "SEWERS (1)": {"A1": " Sewers & drains "},
    "WATERMAIN (1)": {},
}


@query(f"""
    WITH {records._RECORDS}, {records._SHEETS}
    SELECT path, sheet, row, col, num, text FROM c WHERE NOT (sheet = 'MANHOLES (1)' AND col = 'H' AND row BETWEEN 11 AND 50)
    UNION ALL SELECT project::VARCHAR, 'SEWERS (1)', 1, 'A', NULL, ' Sewers & drains ' FROM projects
""")
def workbook_round_trip(spark, sf_dir):
    """Every record written into a workbook, and all cells of these workbooks read back."""
    writes = records._writes(spark, sf_dir)  # each record's cells come out of its row, so they needn't be dealt
    made = workbooks.write_workbooks(writes, workbooks.new_workbook(TEMPLATE), together=True).withColumnRenamed("project", "path")
    return workbooks.decoded(workbooks.contents_cells(made))


_FORMULA = "'$AB$' || p_size || '*C' || n || '-D$7+SUM(E' || n || ':E' || (n + 1) || ')+LOG' || ({log}) || '(Z' || {z} || ')/\"x\"&F' || n"


@query(f"""
    WITH k AS (SELECT p_partkey, p_brand, p_size, p_name, min(p_partkey) OVER (PARTITION BY p_brand) AS first FROM part),
    m AS (SELECT k.*, f.p_size AS size, 11 + k.p_partkey - first AS n FROM k JOIN part f ON f.p_partkey = k.first)
    SELECT p_brand AS sheet, 'J' AS col, (p_partkey + 11)::INTEGER AS row, {_FORMULA.replace('p_size', 'size').format(log='10 + p_partkey - first', z='(size + p_partkey - first)')} AS formula FROM m
    UNION ALL SELECT p_brand, 'K', (p_partkey + 11)::INTEGER, 'A1+' || p_name FROM k WHERE p_size % 3 = 0
""")
def formulas_shifted(spark, sf_dir):
    """Shared formulas of parts, one for each brand, as own formulas of all members, and other formulas, which stay."""
    part = read(spark, sf_dir, "part")
    firsts = part.groupBy("p_brand").agg(F.min("p_partkey").alias("_first"))
    k = part.join(firsts, "p_brand")
    size, text = F.col("p_size").cast("string"), F.lit
    master = F.concat(text("$AB$"), size, text("*C11-D$7+SUM(E11:E12)+LOG10(Z"), size, text(')/"x"&F11'))
    row = (F.col("p_partkey") + 11).cast("int").alias("row")
    shared = k.select(F.col("p_brand").alias("sheet"), F.lit("J").alias("col"), row, F.when(F.col("p_partkey") == F.col("_first"), master).alias("formula"), F.lit(0).alias("shared"))
    other = k.where("p_size % 3 = 0").select(F.col("p_brand").alias("sheet"), F.lit("K").alias("col"), row, F.concat(F.lit("A1+"), "p_name").alias("formula"), F.lit(None).cast("int").alias("shared"))
    return layout.own_formulas(shared.unionByName(other), ["sheet"])


@query("SELECT DISTINCT sha256(coalesce(text, '')) AS sha256, octet_length(encode(coalesce(text, ''))) AS size, true AS same FROM documents")
def stored_contents(spark, sf_dir):
    """All texts put twice into a store of contents and read again: each is there once, with its own bytes."""
    texts = read(spark, sf_dir, "documents").select(F.col("text").cast("binary").alias("content"))
    kept = store.ContentStore(spark, new_folder(spark, "store"))
    for _ in range(2):
        kept.put(texts)
    return kept.contents().select("sha256", "size", (F.sha2("content", 256) == F.col("sha256")).alias("same"))
