"""Queries over the test tables, one or more for each check and operator, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog
from ..catalog import CHECKS, RuleError
from ..operators.contract import SchemaContract, check_schema, extract_schema
from ..operators.profile import profile
from ..operators.validate import analyze, check, constraint, implemented, validate
from ..results import Report
from ..rules import Rule, parse_field
from ..sources import rule_frames, rule_text
from ..streaming.engine import write_split
from ..streaming.records import validate_records
from .workspace import scratch

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- inputs: a frame and the same in SQL --------------------------------------------------------------------------


def _doclab(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")


def _odd_dates(id_: Column, ts: Column) -> Column:
    return F.when(id_ % 7 == 0, "not-a-date").when(id_ % 11 == 0, "2024-02-30").when(id_ % 13 == 0, None).otherwise(F.date_format(ts, "yyyy-MM-dd"))


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").withColumn("dt", _odd_dates(F.col("event_id"), F.col("ts")))


def _near_today(s: SparkSession, d: str) -> DataFrame:
    day = F.date_sub(F.current_date(), (F.col("event_id") % 5 - 1).cast("int"))
    return table(s, d, "events").select("event_id", F.date_format(day, "yyyy-MM-dd").alias("dt"))


def _lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").withColumn("net", F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity") - 25))


_DT = "CASE WHEN event_id%7=0 THEN 'not-a-date' WHEN event_id%11=0 THEN '2024-02-30' WHEN event_id%13=0 THEN NULL ELSE strftime(ts,'%Y-%m-%d') END"
INPUTS: dict[str, tuple[Query, str, str]] = {
    "doclab": (_doclab, "(SELECT documents.*, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))", "doc_id"),
    "events": (_events, f"(SELECT *, {_DT} AS dt FROM events)", "event_id"),
    "today": (_near_today, "(SELECT event_id, strftime(current_date - CAST(event_id % 5 - 1 AS INT), '%Y-%m-%d') AS dt FROM events)", "event_id"),
    "lines": (_lines, "(SELECT *, CASE WHEN l_linenumber % 5 <> 0 THEN l_quantity - 25 END AS net FROM lineitem)", "l_orderkey"),
    "orders": (lambda s, d: table(s, d, "orders"), "orders", "o_orderkey"),
    "customer": (lambda s, d: table(s, d, "customer"), "customer", "c_custkey"),
    "pages": (lambda s, d: table(s, d, "pages"), "pages", "page_id"),
    "words": (lambda s, d: table(s, d, "part").withColumn("brand", F.when(F.col("p_size") % 4 == 0, F.lit("  ")).otherwise(F.col("p_brand"))), "(SELECT *, CASE WHEN p_size % 4 = 0 THEN '  ' ELSE p_brand END AS brand FROM part)", "p_partkey"),
}
_D = "try_cast(dt AS DATE)"


@dataclass(frozen=True)
class Case:
    check: str
    input: str
    field: str | tuple[str, ...]
    value: object
    violated: str

    @property
    def rule(self) -> Rule:
        return Rule.of(self.field, self.check, self.value)

    @property
    def field_name(self) -> str:
        return self.rule.field_name


def _dup(*keys: str) -> str:
    return f"count(*) OVER (PARTITION BY {', '.join(keys)}) > 1"


CASES: list[Case] = [
    Case("is_complete", "doclab", "quality", None, "quality IS NULL"),
    Case("are_complete", "doclab", ("lang", "toxic"), None, "lang IS NULL OR toxic IS NULL"),
    Case("is_unique", "doclab", "text", None, _dup("text")),
    Case("are_unique", "doclab", ("lang", "source", "quality"), None, _dup("lang", "source", "quality")),
    Case("is_primary_key", "orders", "o_custkey", None, _dup("o_custkey")),
    Case("is_composite_key", "lines", ("l_orderkey", "l_linenumber"), None, _dup("l_orderkey", "l_linenumber")),
    Case("is_equal", "orders", "o_orderstatus", "F", "o_orderstatus <> 'F'"),
    Case("is_equal_than", "lines", "l_linenumber", "l_quantity", "l_linenumber <> l_quantity"),
    Case("is_between", "lines", "l_quantity", [1, 40], "l_quantity < 1 OR l_quantity > 40"),
    Case("is_greater_than", "lines", "net", 10, "net <= 10"),
    Case("is_less_than", "lines", "l_discount", 0.05, "l_discount >= 0.05"),
    Case("is_greater_or_equal_than", "customer", "c_acctbal", 0, "c_acctbal < 0"),
    Case("is_less_or_equal_than", "orders", "o_totalprice", 200000.0, "o_totalprice > 200000.0"),
    Case("is_positive", "lines", "net", None, "net <= 0"),
    Case("is_negative", "lines", "net", None, "net >= 0"),
    Case("is_in_millions", "orders", "o_totalprice", None, "o_totalprice < 1000000"),
    Case("is_in_billions", "orders", "o_totalprice", None, "o_totalprice < 1000000000"),
    Case("is_contained_in", "lines", "l_returnflag", ["A", "N"], "l_returnflag NOT IN ('A', 'N')"),
    Case("not_contained_in", "customer", "c_mktsegment", ["BUILDING"], "c_mktsegment IN ('BUILDING')"),
    Case("is_in", "events", "event_type", ["click", "view"], "event_type NOT IN ('click', 'view')"),
    Case("not_in", "orders", "o_orderstatus", ["O"], "o_orderstatus IN ('O')"),
    Case("has_pattern", "pages", "url", "^https://[a-z.-]+/en/", "NOT regexp_matches(url, '^https://[a-z.-]+/en/')"),
    Case("is_legit", "words", "brand", None, "brand IS NULL OR trim(brand) = ''"),
    Case("is_today", "today", "dt", None, f"{_D} <> current_date"),
    Case("is_t_minus_1", "today", "dt", None, f"{_D} <> current_date - 1"),
    Case("is_t_minus_2", "today", "dt", None, f"{_D} <> current_date - 2"),
    Case("is_t_minus_3", "today", "dt", None, f"{_D} <> current_date - 3"),
    Case("is_yesterday", "today", "dt", None, f"{_D} <> current_date - 1"),
    Case("is_past_date", "today", "dt", None, f"{_D} >= current_date"),
    Case("is_future_date", "today", "dt", None, f"{_D} <= current_date"),
    Case("is_date_between", "events", "dt", ["2024-01-05", "2024-01-20"], f"{_D} < DATE '2024-01-05' OR {_D} > DATE '2024-01-20'"),
    Case("is_date_after", "events", "dt", "2024-01-10", f"{_D} <= DATE '2024-01-10'"),
    Case("is_date_before", "events", "dt", "2024-01-10", f"{_D} >= DATE '2024-01-10'"),
    Case("is_on_weekday", "events", "dt", None, f"isodow({_D}) IN (6, 7)"),
    Case("is_on_weekend", "events", "dt", None, f"isodow({_D}) NOT IN (6, 7)"),
    *[Case(f"is_on_{day}", "events", "dt", None, f"isodow({_D}) <> {n}") for n, day in enumerate("monday tuesday wednesday thursday friday saturday sunday".split(), 1)],
    Case("validate_date_format", "events", "dt", "yyyy-MM-dd", "dt IS NOT NULL AND try_strptime(dt, '%Y-%m-%d') IS NULL"),
    Case("all_date_checks", "events", "dt", None, f"dt IS NOT NULL AND {_D} IS NULL"),
    Case("satisfies", "lines", "l_quantity", "l_quantity * 2 > l_linenumber * 10 AND l_tax < 0.07", "NOT (l_quantity * 2 > l_linenumber * 10 AND l_tax < 0.07)"),
]
TABLE_CASES = {
    "has_min": ("l_quantity", "min(l_quantity)"),
    "has_max": ("l_extendedprice", "max(l_extendedprice)"),
    "has_sum": ("l_quantity", "sum(l_quantity)"),
    "has_mean": ("l_quantity", "avg(l_quantity)"),
    "has_std": ("l_quantity", "stddev_samp(l_quantity)"),
    "has_cardinality": ("l_partkey", "count(DISTINCT l_partkey)"),
    "has_entropy": ("l_returnflag", "entropy(l_returnflag)"),
    "has_infogain": ("l_shipdate", "entropy(l_shipdate) / log2(count(DISTINCT l_shipdate))"),
}


# ---- queries ------------------------------------------------------------------------------------------------------


def _exploded(bad: DataFrame, key: str) -> DataFrame:
    """The errors of rows: all of the entry but its id and time, which only have to be there."""
    e = bad.select(key, F.explode("_dq_errors").alias("e"))
    known = F.col("e.rule_id").isNotNull() & F.to_timestamp("e.timestamp").isNotNull()
    return e.select(key, "e.check_type", "e.field", "e.category", "e.expected", F.round(F.col("e.actual").cast("double"), 9).alias("actual"), "e.message", known.alias("marked"))


#: What a verdict of a pass rate says, of n rows of which f fail, against the threshold 1.
_RATE = "CASE WHEN f > 0 THEN printf('{name} %.2f%% below threshold 100.00%%', 100 * ((n - f)::DOUBLE / n)) END"


def _message(check_type: str) -> str:
    category = CHECKS[check_type].category
    return _RATE.format(name={"completeness": "Completeness", "uniqueness": "Uniqueness"}.get(category, f"{check_type} pass rate"))


def _row(case: Case) -> tuple[Query, str]:
    make, source, key = INPUTS[case.input]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _exploded(validate(make(spark, sf_dir), [case.rule]).bad, key)

    labels = f"'{case.check}' AS check_type, '{case.field_name}' AS field, '{CHECKS[case.check].category}' AS category"
    verdict = f"'1.0' AS expected, round((n - f)::DOUBLE / n, 9) AS actual, {_message(case.check)} AS message, true AS marked"
    return run, (
        f"SELECT {key}, {labels}, {verdict} FROM (SELECT {key}, coalesce(v, false) AS v, count(*) OVER () AS n, count(*) FILTER (WHERE coalesce(v, false)) OVER () AS f "
        f"FROM (SELECT {key}, {case.violated} AS v FROM {source} AS t) AS q) AS r WHERE v"
    )


def _report(category: str) -> tuple[Query, str]:
    cases = [c for c in CASES if CHECKS[c.check].category == category]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = None
        for name in dict.fromkeys(c.input for c in cases):
            rules = [c.rule for c in cases if c.input == name]
            part = validate(INPUTS[name][0](spark, sf_dir), rules).to_frame(spark)
            out = part if out is None else out.unionByName(part)
        return out.select("check_type", "field", "level", "category", "status", "pass_rate", "expected", "actual", "message", "fail_count")

    one = (
        "SELECT '{c}' AS check_type, '{f}' AS field, 'ROW' AS level, '{g}' AS category, CASE WHEN f = 0 THEN 'PASS' ELSE 'FAIL' END AS status, (n - f)::DOUBLE / n AS pass_rate, 1.0::DOUBLE AS expected, "
        "(n - f)::DOUBLE / n AS actual, {m} AS message, f::BIGINT AS fail_count FROM (SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(v, false)) AS f FROM (SELECT {v} AS v FROM {s} AS t) AS q) AS r"
    )
    return run, " UNION ALL ".join(one.format(c=c.check, f=c.field_name, g=category, m=_message(c.check), v=c.violated, s=INPUTS[c.input][1]) for c in cases)


def _tables(checks: list[str], expected: dict[str, tuple[float, float]] | None = None) -> tuple[Query, str]:
    """``expected``: value and tolerance of each check; 1.0 within 1e-9 otherwise."""
    wanted = {c: (expected or {}).get(c, (1.0, 1e-9)) for c in checks}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = [Rule.of(TABLE_CASES[c][0], c, wanted[c][0], tolerance=wanted[c][1]) for c in checks]
        out = validate(table(spark, sf_dir, "lineitem"), rules).to_frame(spark)
        return out.select("check_type", "field", "level", "category", "status", "expected", F.round("actual", 6).alias("actual"), F.col("message").isNull().alias("silent"))

    one = (
        "SELECT '{c}' AS check_type, '{f}' AS field, 'TABLE' AS level, 'aggregation' AS category, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status, {w}::DOUBLE AS expected, round(x, 6) AS actual, ok AS silent "
        "FROM (SELECT x, abs(x - {w}) <= {t} * CASE WHEN {w} = 0 THEN 1 ELSE abs({w}) END AS ok FROM (SELECT ({e})::DOUBLE AS x FROM lineitem) AS q) AS r"
    )
    return run, " UNION ALL ".join(one.format(c=c, f=TABLE_CASES[c][0], e=TABLE_CASES[c][1], w=repr(wanted[c][0]), t=repr(wanted[c][1])) for c in checks)


#: Values that some sizes of the table meet within the tolerance, and some checks don't.
TOLERANT = {"has_min": (1.0, 1e-9), "has_max": (100_000.0, 0.5), "has_mean": (25.5, 0.02), "has_std": (14.4, 0.05), "has_entropy": (0.0, 2.0), "has_infogain": (1.0, 0.1), "has_cardinality": (5.0, 0.5), "has_sum": (0.0, 10.0)}


SPLIT_RULES = [
    Rule.of("l_orderkey", "is_complete"),
    Rule.of("l_quantity", "is_between", [1, 40]),
    Rule.of("l_returnflag", "is_contained_in", ["A", "N"]),
    Rule.of("l_shipdate", "is_past_date"),
]
_SPLIT = ("l_orderkey IS NULL", "l_quantity < 1 OR l_quantity > 40", "l_returnflag NOT IN ('A', 'N')", "l_shipdate::DATE >= current_date")
_FLAGS = " + ".join(f"CASE WHEN coalesce({p}, false) THEN 1 ELSE 0 END" for p in _SPLIT)
_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def split_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: lines that violate any of four rules, and how many of them."""
    bad = validate(table(spark, sf_dir, "lineitem"), SPLIT_RULES).bad
    return bad.select(*_KEYS, F.size("_dq_errors").cast("long").alias("n_errors"))


def split_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(table(spark, sf_dir, "lineitem"), SPLIT_RULES).good.select(*_KEYS, "_dq_skipped")


def errors_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [*SPLIT_RULES, Rule.of(["l_orderkey", "l_linenumber"], "are_unique")]
    df = validate(table(spark, sf_dir, "lineitem"), rules).validated.df
    return df.groupBy(F.size("_dq_errors").cast("long").alias("n_errors")).agg(F.count(F.lit(1)).alias("n_rows"))


def skipped_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [Rule.of("c_custkey", "is_complete"), Rule.of("c_name", "is_legit", execute=False), Rule.of("c_acctbal", "is_positive", level="COLUMN")]
    return validate(table(spark, sf_dir, "customer"), rules).validated.df.groupBy("_dq_skipped").agg(F.count(F.lit(1)).alias("n_rows"))


def broken_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that can't run are errors of their own; the others are measured."""
    rules = [Rule.of("nope", "is_complete"), Rule.of("c_name", "is_positive"), Rule.of("c_name", "has_pattern", "[unterminated"), Rule.of("c_name", "has_min", 0), Rule.of("c_custkey", "is_complete"), Rule.of("c_acctbal", "is_between", 3)]
    return validate(table(spark, sf_dir, "customer"), rules).to_frame(spark).select("check_type", "field", "status")


def _profiled(name: str) -> tuple[Query, str]:
    columns = {"part": ("p_partkey long 1,p_name string 0,p_brand string 0,p_type string 0,p_size integer 1,p_retailprice double 1"), "customer": "c_custkey long 1,c_name string 0,c_nationkey integer 1,c_acctbal double 1,c_mktsegment string 0"}[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = profile(table(spark, sf_dir, name)).to_frame(spark)
        for c in ("min", "max", "mean", "std_dev", "sum"):
            out = out.withColumn(c, F.round(c, 3))
        return out.drop("nullable")

    def one(spec: str) -> str:
        c, kind, numeric = spec.split()
        stats = [("min", f"min({c})"), ("max", f"max({c})"), ("mean", f"avg({c})"), ("std_dev", f"stddev_samp({c})"), ("sum", f"sum({c})")]
        more = ", ".join(f"round(({e})::DOUBLE, 3) AS \"{n}\"" if numeric == "1" else f"NULL::DOUBLE AS \"{n}\"" for n, e in stats)
        return f"SELECT '{c}' AS \"column\", '{kind}' AS type, count(*) AS row_count, count({c})::DOUBLE / count(*) AS completeness, count(DISTINCT {c}) AS distinct_count, count(*) - count({c}) AS null_count, count(DISTINCT {c})::DOUBLE / count(*) AS uniqueness, {more} FROM {name}"

    return run, " UNION ALL ".join(map(one, columns.split(",")))


def schema_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    contract = SchemaContract.of({"o_orderkey": "bigint", "o_orderstatus": "integer", "o_orderdate": "datetime", "o_totalprice": {"type": "decimal(10,2)", "nullable": False}, "o_comment": "string", "o_note": {"type": "string", "is_optional": True}}, strict=True)
    r = check_schema(table(spark, sf_dir, "orders"), contract)
    rows = [("missing", c, "") for c in r.missing_columns] + [("type", c, m) for c, m in r.type_errors.items()] + [("metadata", c, m) for c, m in r.metadata_errors.items()] + [("extra", c, "") for c in r.extra_columns]
    return spark.createDataFrame(rows, "kind string, path string, message string")


def schema_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [Rule.of("*", "validate_schema", '{"r_regionkey":"integer","r_name":"string"}'), Rule.of("*", "validate_schema", '{"r_name":"integer"}')]
    return validate(table(spark, sf_dir, "region"), rules).to_frame(spark).select("check_type", "field", "level", "status", "actual")


def loader_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [Rule.of("a", "is_between", [1, 2.5]), Rule.of(("a", "b"), "are_unique", threshold=0.5), Rule.of("c", "has_pattern", "[0-9]+, x"), Rule.of("d", "is_equal", "one\u2028two")]
    rules = rule_text.from_json(rule_text.to_json(rule_text.from_csv(rule_text.to_csv(made))))
    return spark.createDataFrame([(r.field_name, r.check_type, str(r.value), r.threshold, r.level, r.category) for r in rules], "field string, check_type string, value string, threshold double, level string, category string")


def field_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field lists as texts, and the names that they mean."""
    texts = ["a", " a , b ", "[a,b]", '"[a,b]"', '["a,b",c]', "'a'", "[]", "", "a,"]
    names = [parse_field(t) for t in texts]
    return spark.createDataFrame([(k, "|".join([n] if isinstance(n, str) else n)) for k, n in enumerate(names)], "n int, names string")


RULE_TABLE = [("c_custkey", "is_complete", None, "1.0"), ("c_acctbal", "is_between", "[0, 9000]", "0.5"), ("c_name", "has_pattern", "^Customer", "1.0"), ("[c_custkey,c_name]", "are_unique", None, "1.0"), ("c_mktsegment", "is_in", "[BUILDING,MACHINERY]", "0.1")]
_RULE_NAMES = ["field", "check_type", "value", "threshold"]
_RULE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS check_type, '{f}' AS field, CASE WHEN (n - f)::DOUBLE / n >= {t} THEN 'PASS' ELSE 'FAIL' END AS status, f::BIGINT AS fail_count FROM (SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(v, false)) AS f FROM (SELECT {v} AS v FROM customer) AS q) AS r"
    for c, f, t, v in [
        ("is_complete", "c_custkey", 1.0, "c_custkey IS NULL"),
        ("is_between", "c_acctbal", 0.5, "c_acctbal < 0 OR c_acctbal > 9000"),
        ("has_pattern", "c_name", 1.0, "NOT regexp_matches(c_name, '^Customer')"),
        ("is_in", "c_mktsegment", 0.1, "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
        ("are_unique", "c_custkey,c_name", 1.0, "count(*) OVER (PARTITION BY c_custkey, c_name) > 1"),
    ]
)


def _verdicts(spark: SparkSession, sf_dir: str, rules: list[Rule]) -> DataFrame:
    return validate(table(spark, sf_dir, "customer"), rules).to_frame(spark).select("check_type", "field", "status", "fail_count")


def rules_from_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir, rule_frames.from_frame(spark.createDataFrame(RULE_TABLE, ", ".join(f"{n} string" for n in _RULE_NAMES))))


def rules_from_json_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with an object, with an array, empty and malformed ones."""
    item = lambda r: "{" + ", ".join(f'"{k}": "{v}"' for k, v in zip(_RULE_NAMES, r) if v is not None) + "}"
    cells = [(item(RULE_TABLE[0]),), ("[" + ", ".join(map(item, RULE_TABLE[1:])) + "]",), (None,), ("",), ("{not json",)]
    return _verdicts(spark, sf_dir, rule_frames.from_json_column(spark.createDataFrame(cells, "config string")))


def rules_from_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir, rule_frames.from_rows(RULE_TABLE, _RULE_NAMES))


SUMMARY_RULES = [Rule.of("c_custkey", "is_complete"), Rule.of("c_acctbal", "is_positive"), Rule.of("c_name", "is_legit"), Rule.of("nope", "is_complete"), Rule.of("c_name", "is_legit", execute=False), Rule.of("c_acctbal", "is_less_than", 5000, threshold=0.3)]


def _counted(spark: SparkSession, sf_dir: str) -> Report:
    return validate(table(spark, sf_dir, "customer"), SUMMARY_RULES)


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat map of a report: counts by status, and the share of passed ones among those that ran."""
    found = _counted(spark, sf_dir).summary()
    names = ("engine", "total_rows", "total_validations", "passed", "failed", "errors", "skipped", "pass_rate")
    schema = "engine string, total_rows long, total_validations long, passed long, failed long, errors long, skipped long, pass_rate double, validations long"
    return spark.createDataFrame([(*(found[n] for n in names), len(found["validations"]))], schema)


def report_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's lists by status, its length and text."""
    r = _counted(spark, sf_dir)
    views = {"passed": r.passed, "failed": r.failed, "errors": r.errors, "skipped": r.skipped}
    return spark.createDataFrame([(k, x.check_type, x.field, str(len(r))) for k, v in views.items() for x in v], "view string, check_type string, field string, size string")


def analyzed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single rules through their analyzer, and the metric through their constraint."""
    df = table(spark, sf_dir, "customer")
    rules = [Rule.of("c_custkey", "is_complete"), Rule.of("c_custkey", "is_primary_key"), Rule.of("c_acctbal", "is_positive", threshold=0.5), Rule.of("c_acctbal", "has_min", 0.0), Rule.of("c_mktsegment", "has_cardinality", 5), Rule.of("*", "validate_schema", '{"c_custkey":"integer"}')]
    out = []
    for r in rules:
        metric = analyze(df, r)
        verdict = check(metric, r)
        out.append((r.check_type, metric.kind, round(metric.value, 6), verdict.status, constraint(r.check_type) is not None))
    return spark.createDataFrame(out, "check_type string, kind string, value double, status string, judged boolean")


def implemented_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks that batches run, by category, level and the number of their aliases; all of them have a constraint."""
    rows = [(catalog.CHECKS[n].category, catalog.CHECKS[n].level, sum(c.alias_of == n for c in catalog.CHECKS.values())) for n in implemented() if constraint(n)]
    return spark.createDataFrame(rows, "category string, level string, aliases int").groupBy("category", "level").agg(F.count(F.lit(1)).alias("checks"), F.sum("aliases").alias("aliases"))


def rule_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as they are made, with and without checks, and what they say of themselves."""
    rules = [Rule("a", "no_such_check", 5), Rule.of(("a", "b"), "is_composite_key", metadata={"team": "x"}), Rule.of("a", "has_min", 1, level="row"), Rule.of("a", "is_in", ["x"], category="own")]
    try:
        Rule.of("a", "no_such_check")
        refused = False
    except RuleError:
        refused = True
    rows = [(k, str(r), r.canonical, r.applies_to("ROW"), r.applies_to("TABLE_LEVEL"), r.skip_reason("ROW", "spark"), refused) for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, "n int, text string, canonical string, row boolean, table boolean, skipped string, refused boolean")


def empty_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on no rows: rates are 1, aggregates of nothing are errors."""
    rules = [Rule.of("c_custkey", "is_complete"), Rule.of("c_custkey", "is_unique"), Rule.of("c_acctbal", "is_positive"), Rule.of("c_acctbal", "has_mean", 1.0), Rule.of("c_name", "has_cardinality", 0.0), Rule.of("c_name", "has_entropy", 0.0)]
    report = validate(table(spark, sf_dir, "customer").where("c_custkey < 0"), rules)
    return report.to_frame(spark).select("check_type", "status", "pass_rate", "actual", "fail_count")


def no_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without rules every row is good, and the dataset's accessors are those of its frame."""
    report = validate(table(spark, sf_dir, "nation"), [])
    good, bad = report.split()
    return spark.createDataFrame([(report.validated.count(), len(report.validated.columns), good.count(), bad.count(), report.pass_rate)], "n_rows long, n_columns long, good long, bad long, pass_rate double")


def profile_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile's JSON form, read by Spark."""
    text = profile(table(spark, sf_dir, "nation")).to_json()
    kind = "struct<table_stats:struct<total_rows:long,columns_count:long>,column_profiles:map<string,struct<type:string,row_count:long,completeness:double,distinct_count:long,null_count:long>>>"
    whole = spark.createDataFrame([(text,)], "j string").select(F.from_json("j", kind).alias("p"))
    return whole.select("p.table_stats.total_rows", "p.table_stats.columns_count", F.explode("p.column_profiles").alias("column", "c")).select("total_rows", "columns_count", "column", "c.*")


def profile_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile of a tenth of the orders, by Spark's sampling with a fixed seed: no SQL has the same rows."""
    return profile(table(spark, sf_dir, "orders"), 0.1).to_frame(spark).select("column", "type", "row_count", "distinct_count", "null_count")


def extracted_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = extract_schema(table(spark, sf_dir, "orders"))
    return spark.createDataFrame([(n, f["raw_type"], f["canonical_type"], f["nullable"], f["comment"]) for n, f in facts.items() if n in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")], "name string, raw_type string, canonical_type string, nullable boolean, comment string")


def _streamed(spark: SparkSession, sf_dir: str, annotate) -> DataFrame:
    """Events as a stream to a Parquet sink, all that is there now, and what the sink then holds.

    The path is a pattern so that the table may be a file or a folder.
    """
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("dt", _odd_dates(F.col("event_id"), F.col("ts")))
    out = annotate(stream)
    sink = scratch(spark, "stream")
    query = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", scratch(spark, "stream-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


STREAM_RULES = [Rule.of("dt", "all_date_checks"), Rule.of("value", "is_greater_than", 50), Rule.of("event_id", "is_unique"), Rule.of("value", "has_mean", 1.0), Rule.of("value", "satisfies", "value > 0")]


def stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _streamed(spark, sf_dir, lambda s: validate(s, STREAM_RULES).validated.df)
    return out.where(F.size("_dq_errors") > 0).select("event_id", F.array_join(F.col("_dq_errors.check_type"), ",").alias("checks"), "_dq_skipped")


def stream_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of a stream from one read of it: each micro-batch is written to a good and a bad folder."""
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("dt", _odd_dates(F.col("event_id"), F.col("ts")))
    good, bad = scratch(spark, "stream-good"), scratch(spark, "stream-bad")
    to = lambda path: lambda half, number: half.write.mode("append").parquet(path)
    writer = write_split(validate(stream, STREAM_RULES), to(good), to(bad))
    writer.option("checkpointLocation", scratch(spark, "stream-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    halves = [spark.read.parquet(path).select("event_id", F.lit(name).alias("half")) for name, path in (("good", good), ("bad", bad))]
    return halves[0].unionByName(halves[1])


def stream_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [Rule.of("dt", "is_date_after", "2024-01-10"), Rule.of("event_type", "is_in", ["click", "view"]), Rule.of("value", "has_mean", 1.0)]
    out = _streamed(spark, sf_dir, lambda s: validate_records(s, rules).split()[1])
    fields = ("check_type", "field", "category", "message")
    e = out.select("event_id", "_dq_skipped", F.explode(F.from_json("_dq_errors", "array<struct<rule_id:string,check_type:string,field:string,category:string,expected:string,actual:string,message:string,timestamp:string>>")).alias("e"))
    known = F.col("e.rule_id").isNotNull() & F.col("e.timestamp").isNotNull() & F.col("e.expected").isNotNull() & F.col("e.actual").isNull()
    return e.select("event_id", *[f"e.{f}" for f in fields], known.alias("marked"), "_dq_skipped")


def strict_construction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict dialect refuses rules that can't run before anything runs."""
    df = table(spark, sf_dir, "events")
    cases = {
        "reserved": (df.withColumn("_dq_errors", F.lit("x")), [Rule.of("value", "is_positive")]),
        "missing": (df, [Rule.of("VALUE", "is_positive")]),
        "pattern": (df, [Rule.of("event_type", "has_pattern", "[x")]),
        "between": (df, [Rule.of("value", "is_between", [1])]),
        "unknown": (df, [Rule("value", "no_such_check")]),
        "number": (df, [Rule.of("value", "is_greater_than", "x")]),
        "fine": (df, [Rule.of("value", "is_positive"), Rule.of("value", "has_mean", 1.0), Rule.of("value", "is_unique")]),
    }
    rows = []
    for name, (frame, rules) in cases.items():
        try:
            report = validate_records(frame, rules)
            rows.append((name, False, len(report.skipped)))
        except RuleError:
            rows.append((name, True, 0))
    return spark.createDataFrame(rows, "name string, refused boolean, skipped int")


_VALUES = "SELECT * FROM (VALUES {}) AS t({})"
OTHERS: dict[str, tuple[Query, str]] = {
    "split_bad": (split_bad, f"SELECT * FROM (SELECT {', '.join(_KEYS)}, ({_FLAGS})::BIGINT AS n_errors FROM lineitem) AS t WHERE n_errors > 0"),
    "split_good": (split_good, f"SELECT {', '.join(_KEYS)}, '' AS _dq_skipped FROM lineitem WHERE ({_FLAGS}) = 0"),
    "errors_per_row": (errors_per_row, f"SELECT n_errors, count(*) AS n_rows FROM (SELECT ({_FLAGS} + CASE WHEN {_dup('l_orderkey', 'l_linenumber')} THEN 1 ELSE 0 END)::BIGINT AS n_errors FROM lineitem) AS t GROUP BY n_errors"),
    "skipped_rules": (skipped_rules, "SELECT 'is_legit:execute=false|is_positive:Wrong level: expected ''ROW'', got ''COLUMN''' AS _dq_skipped, count(*) AS n_rows FROM customer"),
    "broken_rules": (broken_rules, _VALUES.format("('is_complete', 'nope', 'ERROR'), ('is_positive', 'c_name', 'ERROR'), ('has_pattern', 'c_name', 'ERROR'), ('has_min', 'c_name', 'ERROR'), ('is_complete', 'c_custkey', 'PASS'), ('is_between', 'c_acctbal', 'ERROR')", "check_type, field, status")),
    "profile_part": _profiled("part"),
    "profile_customer": _profiled("customer"),
    "schema_contract": (schema_contract, _VALUES.format("('missing', 'o_comment', ''), ('type', 'o_orderstatus', 'Expected integer, got string (string)'), ('metadata', 'o_totalprice', 'Schema violation: contract requires NOT NULL but column allows nulls'), ('extra', 'o_custkey', ''), ('extra', 'o_orderpriority', '')", "kind, path, message")),
    "validate_schema": (schema_rule, _VALUES.format("('validate_schema', '*', 'TABLE', 'PASS', 1.0::DOUBLE), ('validate_schema', '*', 'TABLE', 'FAIL', 0.0::DOUBLE)", "check_type, field, level, status, actual")),
    "loader_roundtrip": (loader_roundtrip, _VALUES.format("('a', 'is_between', '[1, 2.5]', 1.0::DOUBLE, 'ROW', 'comparison'), ('a,b', 'are_unique', 'None', 0.5::DOUBLE, 'ROW', 'uniqueness'), ('c', 'has_pattern', '[0-9]+, x', 1.0::DOUBLE, 'ROW', 'pattern'), ('d', 'is_equal', 'one' || chr(8232) || 'two', 1.0::DOUBLE, 'ROW', 'comparison')", "field, check_type, value, threshold, level, category")),
    "field_texts": (field_texts, _VALUES.format("(0, 'a'), (1, 'a|b'), (2, 'a|b'), (3, 'a|b'), (4, 'a,b|c'), (5, 'a'), (6, ''), (7, ''), (8, 'a')", "n, names")),
    "rules_from_frame": (rules_from_frame, _RULE_SQL),
    "rules_from_json_column": (rules_from_json_column, _RULE_SQL),
    "rules_from_rows": (rules_from_rows, _RULE_SQL),
    "summary": (
        summary,
        "SELECT 'spark' AS engine, n AS total_rows, 6::BIGINT AS total_validations, (1 + a + l + h)::BIGINT AS passed, (3 - a - l - h)::BIGINT AS failed, 1::BIGINT AS errors, 1::BIGINT AS skipped, (1 + a + l + h) / 5::DOUBLE AS pass_rate, 6::BIGINT AS validations "
        "FROM (SELECT count(*) AS n, (count(*) FILTER (WHERE c_acctbal <= 0) = 0)::INT AS a, (count(*) FILTER (WHERE c_name IS NULL OR trim(c_name) = '') = 0)::INT AS l, (count(*) FILTER (WHERE c_acctbal >= 5000) <= 0.7 * count(*))::INT AS h FROM customer) AS t",
    ),
    "report_views": (
        report_views,
        "SELECT CASE WHEN ok THEN 'passed' ELSE 'failed' END AS \"view\", c AS check_type, f AS field, '6' AS size FROM (SELECT 'is_complete' AS c, 'c_custkey' AS f, count(*) = count(c_custkey) AS ok FROM customer UNION ALL SELECT 'is_positive', 'c_acctbal', count(*) FILTER (WHERE c_acctbal <= 0) = 0 FROM customer "
        "UNION ALL SELECT 'is_legit', 'c_name', count(*) FILTER (WHERE c_name IS NULL OR trim(c_name) = '') = 0 FROM customer UNION ALL SELECT 'is_less_than', 'c_acctbal', count(*) FILTER (WHERE c_acctbal >= 5000) <= 0.7 * count(*) FROM customer) AS t "
        "UNION ALL SELECT 'errors', 'is_complete', 'nope', '6' UNION ALL SELECT 'skipped', 'is_legit', 'c_name', '6'",
    ),
    "analyzed_rules": (
        analyzed_rules,
        "SELECT 'is_complete' AS check_type, 'completeness' AS kind, round(count(c_custkey)::DOUBLE / count(*), 6) AS value, CASE WHEN count(c_custkey) = count(*) THEN 'PASS' ELSE 'FAIL' END AS status, true AS judged FROM customer "
        "UNION ALL SELECT 'is_primary_key', 'uniqueness', round(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END)::DOUBLE / sum(n), 6), CASE WHEN max(n) = 1 THEN 'PASS' ELSE 'FAIL' END, true FROM (SELECT count(*) AS n FROM customer GROUP BY c_custkey) AS t "
        "UNION ALL SELECT 'is_positive', 'comparison', round((count(*) - count(*) FILTER (WHERE c_acctbal <= 0))::DOUBLE / count(*), 6), CASE WHEN (count(*) - count(*) FILTER (WHERE c_acctbal <= 0)) >= 0.5 * count(*) THEN 'PASS' ELSE 'FAIL' END, true FROM customer "
        "UNION ALL SELECT 'has_min', 'aggregation', round(min(c_acctbal), 6), CASE WHEN abs(min(c_acctbal)) <= 1e-9 THEN 'PASS' ELSE 'FAIL' END, true FROM customer "
        "UNION ALL SELECT 'has_cardinality', 'aggregation', count(DISTINCT c_mktsegment)::DOUBLE, CASE WHEN count(DISTINCT c_mktsegment) = 5 THEN 'PASS' ELSE 'FAIL' END, true FROM customer UNION ALL SELECT 'validate_schema', 'schema', 1.0, 'PASS', true",
    ),
    "implemented_checks": (implemented_checks, _VALUES.format("('completeness', 'ROW', 2::BIGINT, 0::BIGINT), ('uniqueness', 'ROW', 2, 2), ('comparison', 'ROW', 11, 0), ('membership', 'ROW', 2, 2), ('pattern', 'ROW', 2, 0), ('date', 'ROW', 20, 1), ('sql', 'ROW', 1, 0), ('aggregation', 'TABLE', 8, 0), ('schema', 'TABLE', 1, 0)", "category, level, checks, aliases")),
    "rule_model": (
        rule_model,
        _VALUES.format(
            "(0, 'RuleDef(field=a, check=no_such_check, level=ROW, category=unknown)', 'no_such_check', true, false, 'Engine ''spark'' not supported for rule ''no_such_check''', true), "
            "(1, 'RuleDef(field=a,b, check=is_composite_key, level=ROW, category=uniqueness, +1 meta)', 'are_unique', true, false, NULL, true), "
            "(2, 'RuleDef(field=a, check=has_min, level=row, category=aggregation)', 'has_min', true, false, NULL, true), (3, 'RuleDef(field=a, check=is_in, level=ROW, category=own)', 'is_contained_in', true, false, NULL, true)",
            "n, text, canonical, \"row\", \"table\", skipped, refused",
        ),
    ),
    "empty_input": (empty_input, _VALUES.format("('is_complete', 'PASS', 1.0::DOUBLE, 1.0::DOUBLE, 0::BIGINT), ('is_unique', 'PASS', 1.0, 1.0, 0), ('is_positive', 'PASS', 1.0, 1.0, 0), ('has_mean', 'ERROR', NULL, NULL, 0), ('has_cardinality', 'PASS', NULL, 0.0, 0), ('has_entropy', 'PASS', NULL, 0.0, 0)", "check_type, status, pass_rate, actual, fail_count")),
    "no_rules": (no_rules, "SELECT count(*) AS n_rows, (SELECT count(*) + 2 FROM (DESCRIBE nation)) AS n_columns, count(*) AS good, 0::BIGINT AS bad, 1.0::DOUBLE AS pass_rate FROM nation"),
    "profile_json": (
        profile_json,
        " UNION ALL ".join(f"SELECT count(*) AS total_rows, 3::BIGINT AS columns_count, '{c}' AS \"column\", '{k}' AS type, count(*) AS row_count, count({c})::DOUBLE / count(*) AS completeness, count(DISTINCT {c}) AS distinct_count, count(*) - count({c}) AS null_count FROM nation" for c, k in (("n_nationkey", "integer"), ("n_name", "string"), ("n_regionkey", "integer"))),
    ),
    "extracted_schema": (extracted_schema, _VALUES.format("('o_orderkey', 'bigint', 'integer', true, ''), ('o_custkey', 'bigint', 'integer', true, ''), ('o_orderstatus', 'string', 'string', true, ''), ('o_totalprice', 'double', 'float', true, ''), ('o_orderpriority', 'string', 'string', true, '')", "name, raw_type, canonical_type, nullable, comment")),
    "strict_construction": (strict_construction, _VALUES.format("('reserved', true, 0), ('missing', true, 0), ('pattern', true, 0), ('between', true, 0), ('unknown', true, 0), ('number', true, 0), ('fine', false, 2)", "name, refused, skipped")),
    "stream_split": (stream_split, f"SELECT event_id, CASE WHEN (dt IS NOT NULL AND {_D} IS NULL) OR coalesce(value <= 50, false) THEN 'bad' ELSE 'good' END AS half FROM {INPUTS['events'][1]} AS t"),
    "stream_rows": (
        stream_rows,
        f"SELECT * FROM (SELECT event_id, concat_ws(',', CASE WHEN dt IS NOT NULL AND {_D} IS NULL THEN 'all_date_checks' END, CASE WHEN value <= 50 THEN 'is_greater_than' END) AS checks, "
        "'is_unique:Engine ''spark-streaming'' not supported for rule ''is_unique''|satisfies:Engine ''spark-streaming'' not supported for rule ''satisfies''|has_mean:Engine ''spark-streaming'' not supported for rule ''has_mean''' AS _dq_skipped "
        f"FROM {INPUTS['events'][1]} AS t) AS q WHERE checks <> ''",
    ),
    "stream_records": (
        stream_records,
        f"SELECT event_id, check_type, field, category, message, true AS marked, 'has_mean:TABLE-level rules are not supported in streaming' AS _dq_skipped FROM ("
        f"SELECT event_id, 'is_date_after' AS check_type, 'dt' AS field, 'date' AS category, CASE WHEN dt IS NOT NULL AND {_D} IS NULL THEN 'ERROR[is_date_after]: the value can''t be read' WHEN {_D} <= DATE '2024-01-10' THEN 'is_date_after:dt' END AS message FROM {INPUTS['events'][1]} AS t "
        f"UNION ALL SELECT event_id, 'is_in', 'event_type', 'membership', CASE WHEN event_type NOT IN ('click', 'view') THEN 'is_in:event_type' END FROM events) AS q WHERE message IS NOT NULL",
    ),
}


def _all() -> dict[str, tuple[Query, str]]:
    out = {f"row_{c.check}": _row(c) for c in CASES}
    out |= {f"report_{g}": _report(g) for g in dict.fromkeys(CHECKS[c.check].category for c in CASES)}
    out |= {f"table_{c}": _tables([c]) for c in TABLE_CASES}
    out["report_aggregation"] = _tables(list(TABLE_CASES))
    out["table_tolerance"] = _tables(list(TABLE_CASES), TOLERANT)
    return out | OTHERS


ALL = _all()


def queries() -> dict[str, Query]:
    return {k: v[0] for k, v in ALL.items()} | {"profile_sample": profile_sample}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in ALL.items()}
