"""Validation of a dataset against rules: a report, the annotated dataset, and its good and bad halves.

Batch: rules are bound to columns together, or one by one if that fails (what fails there is an ERROR result and harms no
other rule), all of them are measured together, and the annotated dataset is one projection over the input, with one join
for each distinct set of uniqueness keys. ``analyze`` and ``check`` do the two steps for one rule. Streams: the same projection, without measuring; see ``streaming``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..catalog import ROW, TABLE, RuleError
from ..functions.predicates import need_text, violation
from ..results import Metric, Report, Result, Validated, error, judged_rate, judged_schema, judged_value, skipped
from ..rules import Rule, level_name
from . import measure
from .annotate import ERRORS, SKIPPED, any_violation, error_array, error_struct, skip_text
from .contract import SchemaContract, check_schema

BATCH = "spark"
UNIQUE = ("is_unique", "are_unique")
FAILURES = (RuleError, PySparkException, Py4JError)

# The names of the metrics.
METRIC_KINDS = {
    "is_complete": "completeness", "are_complete": "multi_field_completeness", "is_equal_than": "column_comparison", "is_between": "between", "is_legit": "legit",
    "is_date_between": "date_between", "is_date_after": "date_comparison", "is_date_before": "date_comparison", "validate_date_format": "date_format",
}
_CATEGORY_KINDS = {"sql": "satisfies"}


def metric_kind(rule: Rule) -> str:
    check = catalog.get(rule.canonical)
    return METRIC_KINDS.get(rule.canonical) or _CATEGORY_KINDS.get(check.category, check.category)


def why(e: Exception) -> str:
    return str(e).strip().split("\n")[0][:500] or type(e).__name__


def require_fields(df: DataFrame, rule: Rule) -> None:
    """Every column the rule names exists, in any case of letters; SQL conditions and contracts name their own."""
    if rule.canonical in ("satisfies", "validate_schema"):
        return
    known = {c.lower() for c in df.columns}
    wanted = list(rule.columns) + ([need_text(rule, "a column name as value")] if rule.canonical == "is_equal_than" else [])
    missing = [f for f in wanted if f.lower() not in known]
    if missing:
        raise RuleError(f"Field '{missing[0]}' not found")


def reject_reserved(df: DataFrame) -> None:
    taken = {c.lower() for c in df.columns} & {ERRORS, SKIPPED}
    if taken:
        raise RuleError(f"the input has reserved columns: {', '.join(sorted(taken))}")


def bound(df: DataFrame, rule: Rule) -> Column:
    """The rule's predicate, resolved against the schema (no job); raises if it doesn't fit."""
    require_fields(df, rule)
    v = violation(rule)
    kind = df.select(v.alias("v")).schema["v"].dataType.typeName()
    if kind != "boolean":
        raise RuleError(f"the condition is of type {kind}, not boolean")
    return v


def bound_together(df: DataFrame, rules: list[Rule]) -> list[Column] | None:
    """The predicates of all rules, resolved in one analysis; None if one of them doesn't fit."""
    try:
        for r in rules:
            require_fields(df, r)
        found = [violation(r) for r in rules]
        kinds = {f.dataType.typeName() for f in df.select(*[v.alias(f"v{i}") for i, v in enumerate(found)]).schema.fields}
    except FAILURES:
        return None
    return found if kinds <= {"boolean"} else None


def details(rule: Rule, fails: int, total: int) -> dict:
    """A row metric's metadata."""
    check, v = rule.canonical, rule.value
    if check == "is_complete":
        return {"null_count": fails, "total_count": total}
    if check == "are_complete":
        return {"incomplete_count": fails, "total_count": total, "fields": list(rule.columns)}
    if check in UNIQUE:
        return {"duplicate_count": fails, "total_count": total, "fields": list(rule.columns)}
    own = {
        "is_between": lambda: {"min": v[0], "max": v[1]},
        "is_equal_than": lambda: {"compared_to": v},
        "is_contained_in": lambda: {"values": list(v)},
        "not_contained_in": lambda: {"values": list(v)},
        "has_pattern": lambda: {"pattern": v},
        "is_legit": dict,
        "is_date_between": lambda: {"start": str(v[0]), "end": str(v[1])},
        "is_date_after": lambda: {"target": str(v)},
        "is_date_before": lambda: {"target": str(v)},
        "validate_date_format": lambda: {"format": v},
        "satisfies": lambda: {"condition": v},
    }
    if check in own:
        return {"fail_count": fails} | own[check]()
    if catalog.CHECKS[check].category == "date":
        return {"fail_count": fails, "check_type": rule.check_type}
    return {"fail_count": fails, "total_count": total, "threshold": v}


def rate_metric(rule: Rule, fails: int, total: int) -> Metric:
    return Metric(metric_kind(rule), rule.field_name, (total - fails) / total if total else 1.0, total, metadata=details(rule, fails, total))


def validate(df: DataFrame, rules: list[Rule]) -> Report:
    """Batch or stream, by what ``df`` is."""
    if df.isStreaming:
        from ..streaming.engine import validate_stream

        return validate_stream(df, rules)
    return _Batch(df, rules).report()


class _Batch:
    def __init__(self, df: DataFrame, rules: list[Rule]):
        reject_reserved(df)
        self.df, self.rules, self.began = df, rules, time.time()
        self.results: dict[int, Result] = {}
        self.skips: list[tuple[str, str]] = []
        self.total: int | None = None
        self.violations: dict[int, Column] = {}
        self.repeated: dict[tuple[str, ...], tuple[DataFrame, int]] = {}  # keys -> those of more than one row, and these rows

    def skip(self, i: int, reason: str) -> None:
        self.skips.append((self.rules[i].check_type, reason))
        self.results[i] = skipped(self.rules[i], reason)

    def guarded(self, i: int, step):
        try:
            return step()
        except FAILURES as e:
            self.results[i] = error(self.rules[i], why(e))
            return None

    def report(self) -> Report:
        simple, unique, table = [], [], []
        for i, r in enumerate(self.rules):
            level = level_name(r.level)
            group = table if level == TABLE else unique if r.canonical in UNIQUE else simple
            group.append(i)
            if level not in (ROW, TABLE):
                self.skip(i, f"Wrong level: expected 'ROW', got '{r.level}'")
            elif (reason := r.skip_reason(level, BATCH)) is not None:
                self.skip(i, reason)
        live = lambda group: [i for i in group if i not in self.results]
        # a row check that is told to be a table rule is measured, but marks no rows
        measured = [i for i in live(simple) + live(table) if i in simple or catalog.CHECKS[self.rules[i].canonical].level == ROW and self.rules[i].canonical not in UNIQUE]
        together = bound_together(self.df, [self.rules[i] for i in measured])
        for k, i in enumerate(measured):
            v = together[k] if together else self.guarded(i, lambda i=i: bound(self.df, self.rules[i]))
            if v is not None:
                self.violations[i] = v
        self.measure(live(table))
        for i in live(unique) + [i for i in live(table) if self.rules[i].canonical in UNIQUE]:
            self.guarded(i, lambda i=i: self.unique(i))
        for i in live(table):
            if self.rules[i].canonical == "validate_schema":
                self.guarded(i, lambda i=i: self.schema(i))
        order = simple + unique + table
        marks = [i for i in simple if i in self.violations and self.results[i].status in ("PASS", "FAIL")]
        uniques = [i for i in unique if self.results[i].status in ("PASS", "FAIL")]
        return Report([self.results[i] for i in order], self.rows(), (time.time() - self.began) * 1000, BATCH, Validated(lambda: self.annotated(marks, uniques), held=tuple(dup for dup, _ in self.repeated.values())))

    def measure(self, table: list[int]) -> None:
        scalars: list[int] = []
        for i in table:
            r = self.rules[i]
            if r.canonical in measure.SCALARS or r.canonical in measure.GROUPED:
                if self.guarded(i, lambda r=r: require_fields(self.df, r) or self.numeric_value(r) or True) and r.canonical in measure.SCALARS:
                    if self.guarded(i, lambda r=r: self.df.agg(measure.SCALARS[r.canonical](F.col("`" + r.columns[0].replace("`", "``") + "`"))).schema) is not None:
                        scalars.append(i)
        rows = list(self.violations)
        ask = lambda rs, ss: measure.fused(self.df, [self.violations[i] for i in rs], [(self.rules[i].canonical, self.rules[i].columns[0]) for i in ss])
        if rows or scalars:
            found = self.asked(rows + scalars, ask)
            for i, got in found.items():
                self.results[i] = judged_rate(self.rules[i], rate_metric(self.rules[i], got, self.total)) if i in self.violations else self.aggregate(self.rules[i], got)
        grouped: dict[str, dict] = {}
        for i in [i for i in table if i not in self.results and self.rules[i].canonical in measure.GROUPED]:
            r = self.rules[i]
            key = r.columns[0].lower()
            if key not in grouped:
                got = self.guarded(i, lambda r=r: measure.spread(self.df, r.columns[0]))
                if got is None:
                    continue
                grouped[key] = got
            self.results[i] = self.aggregate(r, grouped[key][r.canonical])

    def asked(self, some: list[int], ask) -> dict[int, Any]:
        """What one aggregation says of each of these rules. If one breaks it at run time, halves are asked, so that a few
        broken rules cost a few more passes."""
        rows, scalars = [i for i in some if i in self.violations], [i for i in some if i not in self.violations]
        try:
            self.total, fails, values = ask(rows, scalars)
            return {**dict(zip(rows, fails)), **dict(zip(scalars, values))}
        except FAILURES as e:
            if len(some) == 1:
                self.results[some[0]] = error(self.rules[some[0]], why(e))
                return {}
        half = len(some) // 2
        return self.asked(some[:half], ask) | self.asked(some[half:], ask)

    @staticmethod
    def numeric_value(r: Rule) -> None:
        if isinstance(r.value, bool) or not isinstance(r.value, (int, float)):
            raise RuleError(f"{r.check_type} requires a numeric expected value")

    @staticmethod
    def aggregate_metric(r: Rule, got) -> Metric:
        if got is None:
            raise RuleError(f"{r.check_type}: aggregation returned null")
        try:
            if isinstance(got, (bool, str)):
                raise TypeError
            value = float(got)
        except (TypeError, ValueError):
            raise RuleError(f"{r.check_type}: non-numeric result") from None
        return Metric("aggregation", r.field_name, value, -1, metadata={"metric": r.check_type, "value": value})

    def aggregate(self, r: Rule, got) -> Result:
        try:
            return judged_value(r, self.aggregate_metric(r, got))
        except RuleError as e:
            return error(r, why(e))

    def rows(self) -> int:
        if self.total is None:
            self.total = self.df.count()
        return self.total

    def unique(self, i: int) -> None:
        r = self.rules[i]
        require_fields(self.df, r)
        keys = self.keys(r)
        if keys not in self.repeated:
            # kept for the annotated dataset, which joins with it: one shuffle for a set of keys (lost blocks are made anew)
            dup = measure.duplicate_keys(self.df, keys).persist()
            self.repeated[keys] = dup, dup.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        fails = self.repeated[keys][1]
        metric = Metric("uniqueness" if r.canonical == "is_unique" else "multi_field_uniqueness", r.field_name, (self.rows() - fails) / self.rows() if self.rows() else 1.0, self.rows(), metadata=details(r, fails, self.rows()))
        self.results[i] = judged_rate(r, metric)

    @staticmethod
    def keys(r: Rule) -> tuple[str, ...]:
        """The set of key columns: their order doesn't matter."""
        return tuple(sorted({c.lower() for c in (r.columns[:1] if r.canonical == "is_unique" else r.columns)}))

    def schema_metric(self, r: Rule) -> Metric:
        if not isinstance(r.value, (str, dict)):
            raise RuleError("validate_schema requires a contract as value")
        report = check_schema(self.df, SchemaContract.of(r.value, bool(r.metadata.get("strict", False))))
        return Metric("schema", "*", float(report.passed), self.rows(), metadata=report.to_map())

    def schema(self, i: int) -> None:
        self.results[i] = judged_schema(self.rules[i], self.schema_metric(self.rules[i]))

    def annotated(self, marks: list[int], uniques: list[int]) -> tuple[DataFrame, Column | None]:
        df, flags = self.df, {}
        for i in uniques:
            keys = self.keys(self.rules[i])
            if keys not in flags:
                flags[keys] = f"_dq_dup{len(flags)}"
                df = measure.marked_duplicates(df, keys, self.repeated[keys][0], flags[keys])
        entries = [(self.violations[i], error_struct(self.results[i])) for i in marks]
        entries += [(F.col(flags[self.keys(self.rules[i])]), error_struct(self.results[i])) for i in uniques]
        out = df.withColumns({ERRORS: error_array(entries), SKIPPED: skip_text(self.skips)}).drop(*flags.values())
        # without uniqueness rules the halves are cut by the predicates themselves, which reach the scan
        cut = None if flags or not entries else any_violation([v for v, _ in entries])
        return out, cut if cut is not None and _cuttable(out, cut) else None


def _cuttable(df: DataFrame, cut: Column) -> bool:
    try:
        return bool(df.where(cut).schema)
    except FAILURES:
        return False


# ---- one rule at a time --------------------------------------------------------------------------------------------


def analyze(df: DataFrame, rule: Rule) -> Metric:
    """The metric of one rule, whatever its level, threshold and engine; raises what makes it unusable."""
    one = _Batch(df, [rule])
    check = rule.canonical
    if check not in catalog.CHECKS:
        raise RuleError(f"'{rule.check_type}' is not implemented; there are: {', '.join(implemented())}")
    if check in UNIQUE:
        require_fields(df, rule)
        fails = measure.duplicate_keys(df, one.keys(rule)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return Metric("uniqueness" if check == "is_unique" else "multi_field_uniqueness", rule.field_name, (one.rows() - fails) / one.rows() if one.rows() else 1.0, one.rows(), metadata=details(rule, fails, one.rows()))
    if check == "validate_schema":
        return one.schema_metric(rule)
    if check in measure.SCALARS or check in measure.GROUPED:
        require_fields(df, rule)
        got = measure.fused(df, [], [(check, rule.columns[0])])[2][0] if check in measure.SCALARS else measure.spread(df, rule.columns[0])[check]
        return one.aggregate_metric(rule, got)
    total, fails, _ = measure.fused(df, [bound(df, rule)], [])
    return rate_metric(rule, fails[0], total)


def implemented() -> list[str]:
    """The canonical names of all checks that batches can run, sorted."""
    return sorted({c.alias_of or c.name for c in catalog.CHECKS.values() if BATCH in c.engines})


def analyzer(check_type: str) -> Callable[[DataFrame, Rule], Metric]:
    """What measures a check (an alias is its target); RuleError for one that isn't implemented."""
    if catalog.canonical(check_type) not in implemented():
        raise RuleError(f"'{check_type}' is not implemented; there are: {', '.join(implemented())}")
    return analyze


def constraint(check_type: str) -> Callable[[Rule, Metric], Result]:
    """What judges a check's metric; RuleError for one that isn't implemented."""
    analyzer(check_type)
    return {"aggregation": judged_value, "schema": judged_schema}.get(catalog.CHECKS[check_type].category, judged_rate)


def check(metric: Metric, rule: Rule) -> Result:
    """The verdict on a metric of one rule."""
    return constraint(rule.check_type)(rule, metric)
