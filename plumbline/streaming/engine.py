"""Validation of Structured Streaming frames: a stateless projection, in append mode, with no job of its own.

Rates can't be known, so rules that run are reported as passed without one; rules that need the whole dataset are
skipped with a reason, in the report and in ``_dq_skipped``.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..catalog import ROW, TABLE
from ..messages import STREAM_NOTE
from ..operators.annotate import ERRORS, SKIPPED, error_array, error_struct, skip_text
from ..operators.validate import FAILURES, bound, reject_reserved, why
from ..results import PASS, Report, Result, Validated, error, skipped
from ..rules import Rule, level_name

STREAM = "spark-streaming"


def validate_stream(df: DataFrame, rules: list[Rule]) -> Report:
    reject_reserved(df)
    began, results, entries, skips = time.time(), [], [], []
    for r in sorted(rules, key=lambda r: level_name(r.level) == TABLE):  # row rules first, else in their order
        level = level_name(r.level)
        reason = r.skip_reason(level if level in (ROW, TABLE) else ROW, STREAM)
        if reason is not None:
            skips.append((r.check_type, reason))
            results.append(skipped(r, reason))
            continue
        try:
            v = bound(df, r)
        except FAILURES as e:
            results.append(error(r, why(e)))
            continue
        result = Result(r.check_type, r.field_name, PASS, r.level, r.category, expected=r.threshold, message=STREAM_NOTE, metadata={"note": STREAM_NOTE})
        results.append(result)
        entries.append((v, error_struct(result)))
    out = df.withColumns({ERRORS: error_array(entries), SKIPPED: skip_text(skips)})
    return Report(results, -1, (time.time() - began) * 1000, STREAM, Validated(out))


def write_split(report: Report, good: Callable[[DataFrame, int], None], bad: Callable[[DataFrame, int], None]):
    """A stream writer that reads its source once: each micro-batch is kept while both halves are written."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            halves = Validated(batch).split()
            good(halves[0], number)
            bad(halves[1], number)
        finally:
            batch.unpersist()

    return report.validated.df.writeStream.foreachBatch(each)
