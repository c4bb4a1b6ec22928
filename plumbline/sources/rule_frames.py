"""Rules from DataFrames and from rows. Rule tables are small; they are read row by row on the driver."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import RuleError
from ..functions.predicates import named
from ..rules import Rule, from_map
from .rule_text import from_json

NEEDED = ("field", "check_type")


def _rule(cells: dict[str, str | None]) -> Rule:
    return from_map({k: "" if v is None else v for k, v in cells.items()})


def from_frame(df: DataFrame) -> list[Rule]:
    """One rule for each row; every cell is read as text, columns beyond the known ones are metadata."""
    missing = [c for c in NEEDED if c not in df.columns]
    if missing:
        raise RuleError(f"the rule table lacks columns: {', '.join(missing)}")
    text = df.select(*[named(c).cast("string").alias(c) for c in df.columns])
    return [_rule(row.asDict()) for row in text.toLocalIterator()]


def from_json_column(df: DataFrame, column: str = "config") -> list[Rule]:
    """Each cell holds an object or an array of objects; empty and malformed cells are left out."""
    if column not in df.columns:
        raise RuleError(f"no column '{column}'")
    cells = df.select(named(column).cast("string").alias("c")).where(F.col("c").isNotNull())
    return [r for row in cells.toLocalIterator() for r in from_json(row.c)]


def from_rows(rows: Iterable, names: list[str]) -> list[Rule]:
    """Rows (of any sequence type) whose cells stand in the order of ``names``."""
    missing = [c for c in NEEDED if c not in names]
    if missing:
        raise RuleError(f"the rows lack columns: {', '.join(missing)}")
    return [_rule({n: None if v is None else str(v) for n, v in zip(names, row)}) for row in rows]
