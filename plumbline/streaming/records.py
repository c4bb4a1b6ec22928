"""The strict dialect for record streams: rules are checked before anything runs, errors are a JSON string, and what
can't be read as the rule needs it is an error of its row, not a pass.

Differences from the other dialect: names of columns match exactly; an unreadable date or number violates
(``ERROR[check]: ...`` in the message); equality compares numbers; membership compares the printed forms; a NULL on
the other side of a column comparison violates; white space that ``is_legit`` trims is any up to U+0020; both halves
of the split keep both columns.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..catalog import ROW, TABLE, RuleError
from ..functions.predicates import COMPARES, as_date, date_violation, named, need_list, need_pair, need_text, violation
from ..messages import RECORDS_TABLE
from ..operators.annotate import ERRORS, SKIPPED, skip_text
from ..results import PASS, Report, Result, Validated, skipped
from ..rules import Rule, level_name, tagged

ENGINE = "flink-streaming"
_ISO = r"^\d{4}-\d\d-\d\d$"
_TYPE = "array<struct<rule_id:string,check_type:string,field:string,category:string,expected:string,actual:string,message:string,timestamp:string>>"


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _day(df: DataFrame, name: str) -> Column:
    """Dates and ISO text only."""
    c = named(name)
    if df.schema[name].dataType.typeName() == "date":
        return c
    return F.when(c.cast("string").rlike(_ISO), as_date(c.cast("string")))


def _outcome(df: DataFrame, rule: Rule) -> tuple[Column, Column]:
    """(violated, unreadable), both never true for the same row."""
    check, name = rule.canonical, rule.columns[0]
    c, never = named(name), F.lit(False)
    present = c.isNotNull()
    if check in COMPARES or check == "is_between":
        x = _number(c)
        bad = present & x.isNull()
        if check == "is_between":
            low, high = map(float, need_pair(rule))
            return present & ((x < low) | (x > high)), bad
        compare, fixed = COMPARES[check]
        want = rule.value if fixed is None else fixed
        if isinstance(want, bool) or not isinstance(want, (int, float)):
            raise RuleError(f"{rule.check_type} requires a number")
        return present & compare(x, F.lit(float(want))), bad
    if check in ("is_contained_in", "not_contained_in"):
        inside = c.cast("string").isin(*[str(v).lower() if isinstance(v, bool) else str(v) for v in need_list(rule)])
        return present & (~inside if check == "is_contained_in" else inside), never
    if check == "is_equal_than":
        other = F.coalesce(named(need_text(rule, "a column name as value")).cast("string"), F.lit(""))
        return present & (c.cast("string") != other), never
    if check == "has_pattern":
        return present & ~c.cast("string").rlike(need_text(rule, "a regex pattern")), never
    if check == "is_legit":
        return ~present | (F.regexp_replace(c.cast("string"), r"^[\x00-\x20]+|[\x00-\x20]+$", "") == ""), never
    if check in ("is_complete", "are_complete"):
        return violation(rule), never
    if check == "validate_date_format":
        return present & F.to_date(F.try_to_timestamp(c.cast("string"), F.lit(need_text(rule, "a format string")))).isNull(), never
    day = _day(df, name)
    if check == "all_date_checks":
        return present & day.isNull(), never
    return F.coalesce(date_violation(rule, day, day), F.lit(False)), present & day.isNull()


def validate_records(df: DataFrame, rules: list[Rule]) -> Report:
    """RuleError at once for reserved or missing columns, malformed values and bad patterns."""
    began = time.time()
    if taken := {ERRORS, SKIPPED} & set(df.columns):
        raise RuleError(f"the input has reserved columns: {', '.join(sorted(taken))}")
    results, skips, entries = [], [], []
    for r in rules:
        if catalog.get(r.check_type) is None:
            raise RuleError(f"Unknown check type '{r.check_type}'")
        reason = "execute=false" if not r.execute else RECORDS_TABLE if level_name(r.level) == TABLE else r.skip_reason(ROW, ENGINE)
        if reason is not None:
            skips.append((r.check_type, reason))
            results.append(skipped(r, reason))
            continue
        missing = [f for f in (*r.columns, *([r.value] if r.canonical == "is_equal_than" else [])) if f not in df.columns]
        if missing:
            raise RuleError(f"Field '{missing[0]}' not found")
        if r.canonical == "has_pattern":
            try:
                df.sparkSession._jvm.java.util.regex.Pattern.compile(need_text(r, "a regex pattern"))
            except Exception as e:
                raise RuleError(f"has_pattern: bad regex '{r.value}'") from e
        violated, unreadable = _outcome(df, r)
        result = Result(r.check_type, r.field_name, PASS, r.level, r.category)
        results.append(result)
        message = F.when(unreadable, F.lit(f"ERROR[{r.check_type}]: the value can't be read")).otherwise(F.lit(f"{r.check_type}:{r.field_name}"))
        texts = {"check_type": r.check_type, "field": r.field_name, "category": r.category, "expected": tagged(r.value) or None, "actual": None}
        entry = F.struct(F.expr("uuid()").alias("rule_id"), *[F.lit(v).cast("string").alias(k) for k, v in texts.items()], message.alias("message"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("timestamp"))
        entries.append(F.when(F.coalesce(violated, F.lit(False)) | F.coalesce(unreadable, F.lit(False)), entry))
    errors = F.array_compact(F.array(*entries)).cast(_TYPE) if entries else F.array().cast(_TYPE)
    out = df.withColumns({ERRORS: F.to_json(errors, {"ignoreNullFields": "false"}), SKIPPED: skip_text(skips)})
    bad = F.coalesce(F.col(ERRORS), F.lit("[]")) != "[]"
    return Report(results, -1, (time.time() - began) * 1000, ENGINE, Validated(out, keep_errors_in_good=True, is_bad=bad))
