"""Outcomes: a metric becomes a result, results become a report."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame

from . import messages
from .catalog import TABLE, RuleError
from .rules import Rule, decimal_text

PASS, FAIL, ERROR, SKIPPED = "PASS", "FAIL", "ERROR", "SKIPPED"
#: Where a result's number of failing rows stands.
COUNT_KEYS = ("fail_count", "null_count", "incomplete_count", "duplicate_count")


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


@dataclass(frozen=True)
class Metric:
    kind: str
    field: str
    value: float
    total_rows: int
    affected_row_ids: tuple = ()
    metadata: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Result:
    check_type: str
    field: str
    status: str
    level: str = "ROW"
    category: str = "unknown"
    pass_rate: float | None = None
    expected: float | None = None
    actual: float | None = None
    message: str | None = None
    metadata: dict[str, Any] = field(default_factory=dict)
    id: str = field(default_factory=lambda: str(uuid.uuid4()))
    timestamp: datetime = field(default_factory=utc_now)

    @property
    def fail_count(self) -> int:
        found = next((self.metadata[k] for k in COUNT_KEYS if k in self.metadata), 0)
        try:
            return int(float(found))
        except (TypeError, ValueError):
            return 0


def _about(rule: Rule, **more) -> dict[str, Any]:
    return {"check_type": rule.check_type, "field": rule.field_name, "level": rule.level, "category": rule.category} | more


def skipped(rule: Rule, reason: str) -> Result:
    return Result(**_about(rule, status=SKIPPED, message=messages.SKIPPED.format(reason=reason)))


def error(rule: Rule, why: str) -> Result:
    return Result(**_about(rule, status=ERROR, message=messages.ERROR.format(why=why)))


def judged_rate(rule: Rule, metric: Metric) -> Result:
    """ROW rules: the share of passing rows against the threshold."""
    rate, ok = metric.value, metric.value >= rule.threshold
    name = messages.RATE_NAMES.get(rule.category) or messages.RATE_OF.format(check=rule.check_type)
    message = None if ok else messages.RATE_BELOW.format(name=name, rate=100 * rate, threshold=100 * rule.threshold)
    return Result(**_about(rule, status=PASS if ok else FAIL, pass_rate=rate, expected=rule.threshold, actual=rate, message=message, metadata=metric.metadata))


def judged_value(rule: Rule, metric: Metric) -> Result:
    """Aggregates: equal within a relative tolerance (absolute if 0 is expected, exact if the tolerance isn't positive)."""
    want, got = rule.value, metric.value
    if isinstance(want, bool) or not isinstance(want, (int, float)):
        return error(rule, f"{rule.check_type} requires a numeric expected value")
    want = float(want)
    if rule.tolerance <= 0:
        ok = got == want
    else:
        ok = abs(got - want) <= rule.tolerance * (abs(want) if want else 1.0)
    message = None if ok else messages.VALUE_DIFFERS.format(check=rule.check_type, want=decimal_text(want), got=decimal_text(got))
    return Result(**_about(rule, level=TABLE, status=PASS if ok else FAIL, expected=want, actual=got, message=message, metadata=metric.metadata))


def judged_schema(rule: Rule, metric: Metric) -> Result:
    ok = metric.metadata.get("passed") is True
    message = None if ok else messages.SCHEMA_DIFFERS.format(issues=metric.metadata.get("total_issues", 0))
    return Result(**_about(rule, level=TABLE, field="*", status=PASS if ok else FAIL, actual=1.0 if ok else 0.0, message=message, metadata=metric.metadata))


class Validated:
    """A dataset with its error and skip columns, made when it is first asked for."""

    def __init__(self, make: DataFrame | Callable[[], tuple[DataFrame, Column | None]], keep_errors_in_good: bool = False, is_bad: Column | None = None, held: tuple[DataFrame, ...] = ()):
        self._make = make if callable(make) else lambda: (make, is_bad)
        self._keep, self._held = keep_errors_in_good, held

    @cached_property
    def _made(self) -> tuple[DataFrame, Column | None]:
        return self._make()

    @property
    def df(self) -> DataFrame:
        return self._made[0]

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def count(self) -> int:
        return self.df.count()

    def show(self, n: int = 20) -> None:
        self.df.show(n)

    def split(self, error_column: str = "_dq_errors") -> tuple[DataFrame, DataFrame]:
        """(good, bad): rows without and with errors; a null error column counts as none."""
        from .operators.annotate import has_errors

        df, bad = self._made
        if error_column not in df.columns:
            raise RuleError(f"no column '{error_column}' to split by")
        if bad is None:
            bad = has_errors(df, error_column)
        good = df.where(~bad)
        return (good if self._keep else good.drop(error_column)), df.where(bad)

    def release(self) -> None:
        """Let go of the repeated keys that uniqueness rules keep for the dataset; it can still be read."""
        for df in self._held:
            df.unpersist()


@dataclass(frozen=True)
class Report:
    results: list[Result]
    total_rows: int
    execution_time_ms: float
    engine: str
    validated: Validated | None = None
    error_message: str | None = None
    generated_sql: str | None = None
    timestamp: datetime = field(default_factory=utc_now)

    def with_status(self, status: str) -> list[Result]:
        return [r for r in self.results if r.status == status]

    passed = property(lambda self: self.with_status(PASS))
    failed = property(lambda self: self.with_status(FAIL))
    errors = property(lambda self: self.with_status(ERROR))
    skipped = property(lambda self: self.with_status(SKIPPED))

    @property
    def pass_rate(self) -> float:
        ran = len(self.results) - len(self.skipped)
        return len(self.passed) / ran if ran else 1.0

    def split(self) -> tuple[DataFrame, DataFrame]:
        if self.validated is None:
            raise RuntimeError("the report has no dataset")
        return self.validated.split()

    good = property(lambda self: self.split()[0])
    bad = property(lambda self: self.split()[1])

    def summary(self) -> dict[str, Any]:
        own = {"timestamp": self.timestamp.isoformat(), "engine": self.engine, "total_rows": self.total_rows, "execution_time_ms": self.execution_time_ms}
        counts = {"total_validations": len(self.results), "passed": len(self.passed), "failed": len(self.failed), "errors": len(self.errors), "skipped": len(self.skipped), "pass_rate": self.pass_rate}
        return own | counts | {"validations": [self.row(r) for r in self.results]}

    @staticmethod
    def row(r: Result) -> dict[str, Any]:
        return {"rule_id": r.id, "check_type": r.check_type, "field": r.field, "category": r.category, "level": r.level, "status": r.status, "pass_rate": r.pass_rate, "expected": r.expected, "actual": r.actual, "message": r.message, "fail_count": r.fail_count}

    def to_frame(self, spark) -> DataFrame:
        """One row for each result."""
        schema = "rule_id string, check_type string, field string, category string, level string, status string, pass_rate double, expected double, actual double, message string, fail_count long"
        return spark.createDataFrame([tuple(self.row(r).values()) for r in self.results], schema)

    def __len__(self) -> int:
        return len(self.results)

    def __str__(self) -> str:
        return f"ValidationReport({len(self)} rules, {len(self.failed)} failed, pass_rate={self.pass_rate:.2f})"
