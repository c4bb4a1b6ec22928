"""The catalog of checks: what exists, at which level, in which category, and on which engines it runs."""

from __future__ import annotations

from dataclasses import dataclass

ROW, TABLE = "ROW", "TABLE"
BATCH_ONLY = frozenset({"spark"})
ANY_ENGINE = frozenset({"spark", "spark-streaming", "flink", "flink-streaming"})


class RuleError(ValueError):
    """A rule, its value or its text can't be used."""


@dataclass(frozen=True)
class Check:
    name: str
    level: str
    category: str
    description: str
    engines: frozenset[str]
    alias_of: str | None = None


# Names, categories and aliases of the checks, in the catalog's order.
_ROWS = (
    ("is_complete", "completeness", None),
    ("are_complete", "completeness", None),
    ("is_unique", "uniqueness", None),
    ("are_unique", "uniqueness", None),
    ("is_primary_key", "uniqueness", "is_unique"),
    ("is_composite_key", "uniqueness", "are_unique"),
    ("is_equal", "comparison", None),
    ("is_equal_than", "comparison", None),
    ("is_between", "comparison", None),
    ("is_greater_than", "comparison", None),
    ("is_less_than", "comparison", None),
    ("is_greater_or_equal_than", "comparison", None),
    ("is_less_or_equal_than", "comparison", None),
    ("is_positive", "comparison", None),
    ("is_negative", "comparison", None),
    ("is_in_millions", "comparison", None),
    ("is_in_billions", "comparison", None),
    ("is_contained_in", "membership", None),
    ("not_contained_in", "membership", None),
    ("is_in", "membership", "is_contained_in"),
    ("not_in", "membership", "not_contained_in"),
    ("has_pattern", "pattern", None),
    ("is_legit", "pattern", None),
    ("is_today", "date", None),
    ("is_t_minus_1", "date", None),
    ("is_t_minus_2", "date", None),
    ("is_t_minus_3", "date", None),
    ("is_yesterday", "date", "is_t_minus_1"),
    ("is_past_date", "date", None),
    ("is_future_date", "date", None),
    ("is_date_between", "date", None),
    ("is_date_after", "date", None),
    ("is_date_before", "date", None),
    ("is_on_weekday", "date", None),
    ("is_on_weekend", "date", None),
    ("is_on_monday", "date", None),
    ("is_on_tuesday", "date", None),
    ("is_on_wednesday", "date", None),
    ("is_on_thursday", "date", None),
    ("is_on_friday", "date", None),
    ("is_on_saturday", "date", None),
    ("is_on_sunday", "date", None),
    ("validate_date_format", "date", None),
    ("all_date_checks", "date", None),
    ("satisfies", "sql", None),
    ("has_min", "aggregation", None),
    ("has_max", "aggregation", None),
    ("has_sum", "aggregation", None),
    ("has_mean", "aggregation", None),
    ("has_std", "aggregation", None),
    ("has_cardinality", "aggregation", None),
    ("has_entropy", "aggregation", None),
    ("has_infogain", "aggregation", None),
    ("validate_schema", "schema", None),
)
_TELLS = {
    "completeness": "values are present",
    "uniqueness": "values do not repeat",
    "comparison": "values compare as stated",
    "membership": "values are in (or out of) a list",
    "pattern": "strings have the stated form",
    "date": "dates satisfy the stated condition",
    "sql": "a SQL condition holds",
    "aggregation": "an aggregate of the column has the stated value",
    "schema": "the schema matches a contract",
}


def _declared() -> dict[str, Check]:
    out = {}
    for name, category, target in _ROWS:
        table = category in ("aggregation", "schema")
        batch = table or category in ("uniqueness", "sql")
        out[name] = Check(name, TABLE if table else ROW, category, f"{name}: {_TELLS[category]}", BATCH_ONLY if batch else ANY_ENGINE, target)
    return out


CHECKS: dict[str, Check] = _declared()


def get(name: str) -> Check | None:
    return CHECKS.get(name)


def names() -> list[str]:
    return list(CHECKS)


def canonical(name: str) -> str:
    check = CHECKS.get(name)
    return check.alias_of if check and check.alias_of else name


def is_supported(name: str, engine: str) -> bool:
    return name in CHECKS and engine in CHECKS[name].engines


def by_category(category: str) -> list[Check]:
    return [c for c in CHECKS.values() if c.category == category.lower()]


def by_level(level: str) -> list[Check]:
    return [c for c in CHECKS.values() if c.level == level.upper()]
