"""Rule packs stored as JSON, with the built-in pack where there is no file.

A pack has a handful of rows. It is read on the driver and compiled into literals, so patterns are
compiled once per task rather than once per row. A pack of more than ``MAX_RULES`` rows is refused whole.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.rules.packs import AREA_BANDS, BUILTIN_RULES, QUANTITY_BANDS, Band, Rule

MAX_RULES = 500
RULE_SCHEMA = (
    "mandatory_declarations array<struct<field_name string, mandatory boolean, severity_if_missing string, "
    "format_pattern string, rule_reference string, category string>>"
)
BAND_SCHEMA = (
    "net_quantity_rules array<struct<min_net_quantity_g double, max_net_quantity_g double, min_font_height_mm double>>, "
    "general_declaration_rules array<struct<min_panel_area_cm2 double, max_panel_area_cm2 double, min_font_height_mm double>>"
)


def _rows(spark: SparkSession, path: str, schema: str, column: str) -> list:
    try:
        pack = spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    rows = pack.select(F.explode(column).alias("r")).select("r.*").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"a rule pack holds at most {MAX_RULES} rows")
    return rows


def store_rules(spark: SparkSession, path: str, rules: list[Rule]) -> None:
    """Write a pack as JSON, in the form that ``load_rules`` reads."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"a rule pack holds at most {MAX_RULES} rows")
    rows = [(r.field_name, r.mandatory, r.severity_if_missing, r.format_pattern, r.rule_reference, r.category) for r in rules]
    spark.createDataFrame([(rows,)], RULE_SCHEMA).coalesce(1).write.json(path)


def load_rules(spark: SparkSession, path: str | None = None) -> list[Rule]:
    rows = [r for r in _rows(spark, path, RULE_SCHEMA, "mandatory_declarations") if r.field_name] if path else []
    return [
        Rule(
            r.field_name,
            r.severity_if_missing or "high",
            r.rule_reference or "",
            r.format_pattern,
            True if r.mandatory is None else r.mandatory,
            r.category or "declaration",
        )
        for r in rows
    ] or BUILTIN_RULES


def load_bands(spark: SparkSession, path: str | None = None) -> tuple[list[Band], list[Band]]:
    """Quantity bands and area bands."""
    sets = []
    for column, default in (("net_quantity_rules", QUANTITY_BANDS), ("general_declaration_rules", AREA_BANDS)):
        rows = _rows(spark, path, BAND_SCHEMA, column) if path else []
        sets.append([Band(r[0] or 0.0, r[1], r[2]) for r in rows if r[2] is not None] or default)
    return sets[0], sets[1]


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The pack as a table, for listing and for joins by field."""
    rows = [(r.field_name, r.mandatory, r.severity_if_missing, r.rule_reference, r.category) for r in rules]
    return spark.createDataFrame(
        rows, "field_name string, mandatory boolean, severity_if_missing string, rule_reference string, category string"
    )


def list_rules(table: DataFrame, category: str | None = None) -> DataFrame:
    return table.where(F.col("category") == category) if category and category != "all" else table
