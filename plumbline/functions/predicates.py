"""Violation predicates: for each row check, a boolean column that is true where a row violates the rule.

NULL counts as no violation unless the check is about presence. Only built-in expressions are used, so predicates stay
in whole-stage code generation and simple ones reach the Parquet scan.
"""

from __future__ import annotations

import operator
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import RuleError
from ..rules import Rule

#: check -> (the comparison that a violation satisfies, fixed right side or None for the rule's value)
COMPARES = {
    "is_equal": (operator.ne, None),
    "is_greater_than": (operator.le, None),
    "is_less_than": (operator.ge, None),
    "is_greater_or_equal_than": (operator.lt, None),
    "is_less_or_equal_than": (operator.gt, None),
    "is_positive": (operator.le, 0),
    "is_negative": (operator.ge, 0),
    "is_in_millions": (operator.lt, 1_000_000),
    "is_in_billions": (operator.lt, 1_000_000_000),
}
_DAYS_AGO = {"is_today": 0, "is_t_minus_1": 1, "is_t_minus_2": 2, "is_t_minus_3": 3}
#: Sunday is 1.
_DAY_OF_WEEK = {"is_on_sunday": 1, "is_on_monday": 2, "is_on_tuesday": 3, "is_on_wednesday": 4, "is_on_thursday": 5, "is_on_friday": 6, "is_on_saturday": 7}
WEEKEND = (1, 7)


def named(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_date(c: Column) -> Column:
    """The date in a column of any type, NULL where there is none."""
    return F.to_date(F.try_to_timestamp(c))


def need_text(rule: Rule, what: str) -> str:
    if not isinstance(rule.value, str):
        raise RuleError(f"{rule.check_type} requires {what}")
    return rule.value


def need_list(rule: Rule) -> list:
    if not isinstance(rule.value, (list, tuple)):
        raise RuleError(f"{rule.check_type} requires a list of values")
    return list(rule.value)


def need_pair(rule: Rule) -> tuple:
    if not isinstance(rule.value, (list, tuple)) or len(rule.value) != 2:
        raise RuleError(f"{rule.check_type} requires a list of two values")
    return tuple(rule.value)


def date_text(v) -> str:
    if isinstance(v, datetime):
        return v.date().isoformat()
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, str):
        return v
    raise RuleError("a date is required")


def violation(rule: Rule) -> Column:
    """The predicate; RuleError if the rule has no usable value or isn't a row check with one."""
    check, c = rule.canonical, named(rule.columns[0])
    if check in ("is_complete", "are_complete"):
        return reduce(operator.or_, [named(f).isNull() for f in rule.columns])
    if check in COMPARES:
        compare, fixed = COMPARES[check]
        if fixed is None and (rule.value is None or isinstance(rule.value, (list, tuple, dict))):
            raise RuleError(f"{rule.check_type} requires a value")
        return compare(c, F.lit(rule.value if fixed is None else fixed))
    if check == "is_equal_than":
        return c != named(need_text(rule, "a column name as value"))
    if check == "is_between":
        low, high = need_pair(rule)
        return (c < F.lit(low)) | (c > F.lit(high))
    if check in ("is_contained_in", "not_contained_in"):
        inside = c.isin(*need_list(rule))
        return ~inside if check == "is_contained_in" else inside
    if check == "has_pattern":
        return ~c.rlike(need_text(rule, "a regex pattern"))
    if check == "is_legit":
        return c.isNull() | (F.trim(c) == "")
    if check == "validate_date_format":
        return F.try_to_timestamp(c, F.lit(need_text(rule, "a format string"))).isNull() & c.isNotNull()
    if check == "satisfies":
        return ~F.expr(need_text(rule, "a SQL condition"))
    return date_violation(rule, c, as_date(c))


def date_violation(rule: Rule, c: Column, d: Column) -> Column:
    """Of date checks: ``c`` is the column as it is, ``d`` its date."""
    check, today = rule.canonical, F.current_date()
    if check in _DAYS_AGO:
        return d != F.date_sub(today, _DAYS_AGO[check])
    if check in _DAY_OF_WEEK:
        return F.dayofweek(d) != _DAY_OF_WEEK[check]
    if check in ("is_on_weekday", "is_on_weekend"):
        free = F.dayofweek(d).isin(*WEEKEND)
        return free if check == "is_on_weekday" else ~free
    if check == "all_date_checks":
        return c.isNotNull() & d.isNull()
    if check == "is_past_date":
        return d >= today
    if check == "is_future_date":
        return d <= today
    if check == "is_date_between":
        low, high = (F.to_date(F.lit(date_text(v))) for v in need_pair(rule))
        return (d < low) | (d > high)
    if check in ("is_date_after", "is_date_before"):
        target = F.to_date(F.lit(date_text(rule.value)))
        return d <= target if check == "is_date_after" else d >= target
    raise RuleError(f"'{rule.check_type}' has no row predicate")
