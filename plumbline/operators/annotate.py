"""The error column: one struct for each violated rule of a row."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..results import Result
from ..rules import decimal_text

ERRORS, SKIPPED = "_dq_errors", "_dq_skipped"
FIELDS = ("rule_id", "check_type", "field", "category", "expected", "actual", "message", "timestamp")
ENTRY_TYPE = "struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">"
ERRORS_TYPE = f"array<{ENTRY_TYPE}>"


def error_struct(result: Result) -> Column:
    """The entry as one literal (JSON that the optimizer folds): few calls for many rules."""
    number = lambda v: None if v is None else decimal_text(v)
    values = (result.id, result.check_type, result.field, result.category, number(result.expected), number(result.actual), result.message, result.timestamp.isoformat())
    return F.from_json(F.lit(json.dumps(dict(zip(FIELDS, values)))), ENTRY_TYPE)


def error_array(entries: list[tuple[Column, Column]]) -> Column:
    """``entries``: (violation, struct), in the order of the rules."""
    if not entries:
        return F.array().cast(ERRORS_TYPE)
    return F.array_compact(F.array(*[F.when(v, s) for v, s in entries])).cast(ERRORS_TYPE)


def any_violation(violations: list[Column]) -> Column:
    """True where a rule is violated, never NULL; simple predicates in it can reach the scan."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(v, F.lit(False)) for v in violations]), F.lit(False)) if violations else F.lit(False)


def skip_text(skips: list[tuple[str, str]]) -> Column:
    return F.lit("|".join(f"{check}:{reason}" for check, reason in skips))


def has_errors(df: DataFrame, column: str = ERRORS) -> Column:
    return F.coalesce(F.size(F.when(df[column].isNotNull(), df[column])), F.lit(0)) > 0
