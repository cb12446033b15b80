"""Queries over raw responses whose leaves keep their JSON type."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeline.functions import pipes
from gradeline.operators import sections
from gradeline.plans.registry import query, read
from gradeline.sources.constants import LABOR_RATES

_AS_OF = "2024-01-01"
# A leaf as JSON (none: left out), as a number, as a text, and whether it counts as true.
_LEAVES = [
    ("12.5", 12.5, "12.5", True), ('"12.5"', 12.5, "12.5", True), ('"abc"', None, "abc", True), ('""', 0, "", False), ("true", 1, "true", True), ("false", 0, "false", False),
    ('"false"', None, "false", True), ("null", None, None, False), ("", None, None, False), ("0", 0, "0", False), ('"0"', 0, "0", True), ('"0x10"', 16, "0x10", True),
    ("450", 450, "450", True), ("1e2", 100, "100", True), ('{"a": 1}', None, "[object Object]", True), ("[]", 0, "", True), ("[7]", 7, "7", True), ('"  -8.50 "', -8.5, "  -8.50 ", True), ("-0.250", -0.25, "-0.25", True),
]
_HEAD = {"projectName": ("text", None), "jobNumber": ("text", ""), "date": ("text", _AS_OF), "confidence": ("number", 0.5), **{k: ("number", v) for k, v in LABOR_RATES.items()}}
_ALL = [(s, f, *how) for s, fields in {"head": _HEAD, **sections.FIELDS}.items() for f, how in fields.items()]


def _fields_sql() -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'"
    leaves = ", ".join(f"({i}, {'NULL' if n is None else n}::DOUBLE, {text(t)}, {t is not None}, {yes})" for i, (_, n, t, yes) in enumerate(_LEAVES))
    fields = []
    for j, (section, field, how, *default) in enumerate(_ALL):
        d = default[0] if default else None
        fields.append(f"({j}, '{section}', '{field}', '{how}', {text(d) if how == 'text' else 'NULL'}, {d if how == 'number' else 'NULL'}::DOUBLE)")
    return f"l(i, num, text, there, truth) AS (VALUES {leaves}), f(j, section, field, how, default_text, default_num) AS (VALUES {', '.join(fields)})"


def _snap(n: str) -> str:
    return f"CASE WHEN {n} IS NULL THEN 100 WHEN {n} <= 0 THEN 0 ELSE list_sort(list_transform({[float(d) for d in pipes.DIAMETERS]}, lambda d: {{'off': abs({n} - d), 'size': d}}))[1].size END"


@query(f"""
    WITH {_fields_sql()},
    x AS (SELECT c_custkey, f.*, l.num AS n, l.text AS t, l.there, l.truth FROM customer, f JOIN l ON l.i = (c_custkey + 5 * f.j) % {len(_LEAVES)})
    SELECT c_custkey, section, field,
           CASE how WHEN 'kept' THEN n WHEN 'slope' THEN CASE WHEN n > 10 THEN n / 10 ELSE n END WHEN 'number' THEN coalesce(nullif(n, 0), default_num)
                    WHEN 'size' THEN CASE WHEN there THEN {_snap('n')} END WHEN 'sized' THEN {_snap('coalesce(n, 0)')} END::DOUBLE AS num,
           CASE how WHEN 'flag' THEN truth::VARCHAR WHEN 'text' THEN CASE WHEN truth THEN t WHEN field = 'projectName' THEN c_custkey::VARCHAR ELSE default_text END END AS text
    FROM x
""")
def typed_leaves(spark, sf_dir):
    """Every field of a raw record as number, text, quoted and bare flag, null, missing, list or object: one response for each customer."""
    key, n = F.col("c_custkey"), len(_LEAVES)
    place = {(s, f): j for j, (s, f, *_) in enumerate(_ALL)}

    def entry(section: str, names) -> F.Column:
        """The fields of an entry; which leaf a field has depends on the key's remainder, so each remainder's text is written once."""
        made = lambda k: [(f, _LEAVES[(k + 5 * place[section, f]) % n][0]) for f in names]
        texts = [", ".join(f'"{f}": {v}' for f, v in made(k) if v) for k in range(n)]
        return F.get(F.array(*[F.lit(x) for x in texts]), (key % n).cast("int"))

    lists = {s: F.concat(F.lit("[{"), entry(s, fields), F.lit("}]")) for s, fields in sections.FIELDS.items()}
    named = [F.concat(F.lit(f'"{s}": '), v) for s, v in lists.items() if "." not in s]
    basins = F.concat(F.lit('"catchbasins": {"groups": '), lists["catchbasins.groups"], F.lit(', "laborRates": {'), entry("head", LABOR_RATES), F.lit("}}"))
    top = entry("head", [f for f in _HEAD if f not in LABOR_RATES])
    # Customers are few bytes and much work each, so their partitions go by number and not by size.
    customers = read(spark, sf_dir, "customer").select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = customers.select("c_custkey", key.cast("string").alias("project"), F.concat(F.lit("{"), F.concat_ws(", ", F.nullif(top, F.lit("")), basins, *named), F.lit("}")).alias("response_json"))
    return sections.leaf_rows(sections.parsed(made), _AS_OF, ["c_custkey"]).drop("item")
