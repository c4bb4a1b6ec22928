import math
import uuid
from datetime import date, timedelta

import pytest

from plumbline import CHECKS, Rule, RuleError, SchemaContract, check_schema, extract_schema, profile, validate, validate_records
from plumbline.functions.predicates import violation
from plumbline.sources import rule_frames

TODAY = date.today()


@pytest.fixture(scope="module")
def basic(spark):
    rows = [(1, "alice", 30, "active", 1500000.0), (2, "bob", 25, "inactive", 500.0), (3, None, 40, "active", 2000000.0), (4, "diana", 17, "pending", 3000000000.0), (5, "eve", 35, "active", 800000.0)]
    return spark.createDataFrame(rows, "id int, name string, age int, status string, revenue double")


def one(df, *rule, **more):
    return validate(df, [Rule.of(*rule, **more)]).results[0]


@pytest.mark.parametrize(
    "rule,actual",
    [
        (("id", "is_complete"), 1.0), (("name", "is_complete"), 0.8), (("name", "is_legit"), 0.8), (("age", "is_greater_than", 18), 0.8), (("age", "is_between", [0, 150]), 1.0),
        (("age", "is_less_than", 30), 0.4), (("age", "is_less_or_equal_than", 40), 1.0), (("age", "is_greater_or_equal_than", 17), 1.0), (("status", "not_in", ["active"]), 0.4),
        (("revenue", "is_in_millions"), 0.6), (("revenue", "is_in_billions"), 0.2), (("name", "has_pattern", "^[a-z]+$"), 1.0), (("id", "is_primary_key"), 1.0), (("status", "is_unique"), 0.4), (("age", "satisfies", "age > id * 10"), 0.6),
    ],
)
def test_row_rates(basic, rule, actual):
    r = one(basic, *rule)
    assert r.actual == actual and r.status == ("PASS" if actual == 1 else "FAIL") and r.check_type == rule[1]


def test_thresholds(basic):
    assert one(basic, "name", "is_complete", threshold=0.8).status == "PASS"
    assert one(basic, "name", "is_complete", threshold=0.8001).message == "Completeness 80.00% below threshold 80.01%"


@pytest.mark.parametrize("rule,status", [(("age", "has_mean", 29.4), "PASS"), (("age", "has_min", 17), "PASS"), (("age", "has_max", 40), "PASS"), (("age", "has_sum", 147), "PASS"), (("age", "has_sum", 999), "FAIL"), (("status", "has_cardinality", 3), "PASS"), (("age", "has_min"), "ERROR"), (("name", "has_min", 0), "ERROR"), (("*", "validate_schema"), "ERROR")])
def test_table_rules(basic, rule, status):
    assert one(basic, *rule).status == status


def test_spread(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0)], "c string, x double")
    report = validate(df, [Rule.of("c", "has_entropy", 1.0), Rule.of("c", "has_infogain", 1.0), Rule.of("x", "has_std", math.sqrt(5 / 3))])
    assert [r.status for r in report.results] == ["PASS"] * 3
    same = spark.createDataFrame([("x",)] * 4, "c string")
    assert one(same, "c", "has_infogain", 0.0, tolerance=0).status == "PASS"


def test_tolerance(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "x double")
    assert one(df, "x", "has_sum", 0.6).status == "PASS" and one(df, "x", "has_sum", 0.6, tolerance=0).status == "FAIL"


@pytest.fixture(scope="module")
def days(spark):
    text = [*(str(TODAY - timedelta(n)) for n in range(4)), "2024-02-30", "not-a-date", None, "2099-12-31"]
    return spark.createDataFrame([(t,) for t in text], "dt string")


@pytest.mark.parametrize("check,bad", [("is_today", 4), ("is_yesterday", 4), ("is_past_date", 2), ("is_future_date", 4), ("all_date_checks", 2), ("is_t_minus_2", 4), ("is_t_minus_3", 4)])
def test_relative_dates(days, check, bad):
    assert one(days, "dt", check).fail_count == bad


def test_weekdays(spark):
    df = spark.createDataFrame([(f"2025-06-0{d}",) for d in range(2, 9)], "dt string")
    assert one(df, "dt", "is_on_weekday").actual == 5 / 7 and one(df, "dt", "is_on_weekend").actual == 2 / 7
    for day in "monday tuesday wednesday thursday friday saturday sunday".split():
        assert one(df, "dt", f"is_on_{day}").actual == 1 / 7
    assert one(df, "dt", "is_date_between", ["2025-06-03", date(2025, 6, 4)]).actual == 2 / 7
    assert one(df, "dt", "is_date_after", "2025-06-07").actual == 1 / 7 and one(df, "dt", "is_date_before", "2025-06-03").actual == 1 / 7
    assert one(df, "dt", "validate_date_format", "yyyy/MM/dd").actual == 0.0


def test_errors_stay_apart(basic):
    report = validate(basic, [Rule.of("nope", "is_complete"), Rule.of("name", "is_positive"), Rule.of("name", "has_pattern", "[x"), Rule.of("age", "satisfies", "no_such > 1"), Rule.of("status", "is_contained_in", "active"), Rule.of("id", "is_complete")])
    assert [r.status for r in report.results] == ["ERROR"] * 5 + ["PASS"]
    assert report.pass_rate == 1 / 6
    assert validate(basic, [Rule.of("id", "is_complete", execute=False)]).pass_rate == 1.0
    assert validate(basic, [Rule.of("id", "is_complete", level="FOO")]).results[0].status == "SKIPPED"


def test_split_and_errors(basic):
    report = validate(basic, [Rule.of("name", "is_complete", threshold=0.5), Rule.of("age", "is_greater_than", 20), Rule.of("status", "is_unique")])
    good, bad = report.split()
    assert report.results[0].status == "PASS" and bad.count() == 4 and good.count() == 1
    assert "_dq_errors" not in good.columns and "_dq_skipped" in good.columns
    errors = {r.id: r["_dq_errors"] for r in bad.collect()}
    assert [e.check_type for e in errors[3]] == ["is_complete", "is_unique"] and errors[3][0].actual == "0.8" and errors[3][0].message is None
    assert errors[3][0].rule_id == report.results[0].id and errors[4][0].expected == "1.0"
    assert report.summary()["validations"][0]["fail_count"] == 1 and str(report).startswith("ValidationReport(3 rules, 2 failed")
    with pytest.raises(RuleError):
        report.validated.split("none")
    with pytest.raises(RuleError):
        validate(report.validated.df, [])


def test_null_keys_are_one_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    report = validate(df, [Rule.of("k", "is_unique")])
    assert report.results[0].fail_count == 2 and report.bad.count() == 2


def test_odd_names_and_empty(spark):
    df = spark.createDataFrame([(1, None)], "`a.b` int, `x``y` string")
    assert one(df, "a.b", "is_complete").status == "PASS" and one(df, "x`y", "is_complete").status == "FAIL"
    empty = spark.createDataFrame([], "id int, name string")
    report = validate(empty, [Rule.of("id", "is_complete"), Rule.of("id", "is_unique"), Rule.of("id", "has_min", 1)])
    assert [r.status for r in report.results] == ["PASS", "PASS", "ERROR"] and report.total_rows == 0


def jobs(spark, work):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    work()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_grow(spark, basic):
    rules = lambda n: [Rule.of("age", "is_greater_than", k) for k in range(n)]
    assert jobs(spark, lambda: validate(basic, rules(5))) == jobs(spark, lambda: validate(basic, rules(20)))
    wide = basic.selectExpr("*", *[f"age + {k} AS c{k}" for k in range(15)])
    assert jobs(spark, lambda: profile(basic)) == jobs(spark, lambda: profile(wide))


@pytest.mark.parametrize("check", [c for c, e in CHECKS.items() if e.level == "ROW" and e.category not in ("uniqueness",)])
def test_every_row_check_has_a_predicate(spark, check):
    value = {"is_between": [1, 2], "is_date_between": ["2024-01-01", "2024-01-02"], "is_contained_in": ["a"], "not_contained_in": ["a"], "is_in": ["a"], "not_in": ["a"], "satisfies": "true", "is_equal_than": "x", "validate_date_format": "yyyy"}.get(check, "2024-01-01")
    assert violation(Rule.of("x", check, value)) is not None


def test_profile(spark):
    df = spark.createDataFrame([(1, "alice", 30.0, "active"), (2, "bob", 25.5, "active"), (3, None, 40.0, "inactive"), (4, "diana", 17.0, None)], "id int, name string, age double, status string")
    p = profile(df)
    name, age = p.column_profiles["name"], p.column_profiles["age"]
    assert (name.completeness, name.distinct_count, name.null_count, name.uniqueness, name.min) == (0.75, 3, 1, 0.75, None)
    assert (age.min, age.max, age.mean, age.sum) == (17.0, 40.0, 28.125, 112.5) and p.table_stats["total_rows"] == 4
    assert profile(df.limit(0)).column_profiles["age"].completeness == 1.0 and '"column_profiles"' in p.to_json()


def test_contracts(spark):
    df = spark.createDataFrame([], "id bigint NOT NULL, price decimal(10,2), tags array<string>, address struct<street:string,zip:int>")
    assert extract_schema(df)["tags"]["element_type"] == "string"
    ok = SchemaContract.of({"id": {"type": "long", "nullable": False}, "price": "decimal(10,2)", "tags": {"type": "array", "element_type": "string"}, "address": {"type": "struct", "fields": {"zip": "int"}}})
    assert check_schema(df, ok).passed
    bad = check_schema(df, SchemaContract.of({"id": "inteiro", "address": {"type": "struct", "fields": [{"name": "zip", "type": "string"}]}, "gone": "string", "maybe": {"type": "string", "is_optional": True}}, strict=True))
    assert bad.missing_columns == ["gone"] and set(bad.type_errors) == {"id", "address.zip"} and bad.extra_columns == ["price", "tags"]
    with pytest.raises(RuleError):
        SchemaContract.of({"a": {"type": "struct", "fields": [{"type": "int"}]}})


def test_rule_tables(spark):
    df = spark.createDataFrame([("email", "is_complete", None, "0", "prod"), ("age", "is_greater_than", "18", None, None)], "field string, check_type string, value string, execute string, env string")
    rules = rule_frames.from_frame(df)
    assert rules[0].execute is False and rules[0].metadata["env"] == "prod" and rules[1].value == 18
    cells = spark.createDataFrame([('{"field":"a","check_type":"is_complete"}',), ('[{"field":"b","check_type":"is_positive"}]',), ("",), ("{",), (None,)], "config string")
    assert [r.field for r in rule_frames.from_json_column(cells)] == ["a", "b"]
    assert rule_frames.from_rows([("a", "is_complete")], ["field", "check_type"])[0].field == "a"
    with pytest.raises(RuleError):
        rule_frames.from_frame(spark.createDataFrame([("a",)], "field string"))


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id":1,"name":"alice","age":30,"dt":"2024-05-06"}\n{"id":2,"name":null,"age":25,"dt":"2024-05-06"}\n{"id":3,"name":"bob","age":-5,"dt":"2024/05/06"}\n')
    stream = spark.readStream.schema("id int, name string, age int, dt string").json(str(tmp_path / "in"))
    rules = [Rule.of("name", "is_complete"), Rule.of("age", "is_positive"), Rule.of("dt", "validate_date_format", "yyyy-MM-dd"), Rule.of("id", "is_unique"), Rule.of("age", "has_mean", 1.0), Rule.of("name", "satisfies", "name = 'x'"), Rule.of("gone", "is_complete")]
    report = validate(stream, rules)
    assert report.engine == "spark-streaming" and report.total_rows == -1
    assert [r.status for r in report.results] == ["PASS", "PASS", "PASS", "SKIPPED", "SKIPPED", "ERROR", "SKIPPED"]

    def rows(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    good, bad = report.split()
    assert [r.id for r in rows(good, "g1")] == [1] and sorted(r.id for r in rows(bad, "b1")) == [2, 3]
    strict = validate_records(stream, [Rule.of("name", "is_complete"), Rule.of("dt", "is_past_date"), Rule.of("age", "has_mean", 1)])
    out = {r.id: r for r in rows(strict.validated.df, "r1")}
    assert out[1]["_dq_errors"] == "[]" and '"actual":null' in out[2]["_dq_errors"] and "ERROR[is_past_date]" in out[3]["_dq_errors"]
    assert out[1]["_dq_skipped"] == "has_mean:TABLE-level rules are not supported in streaming"
    for bad_rule in (Rule.of("gone", "is_complete"), Rule.of("name", "has_pattern", "[x"), Rule.of("age", "is_greater_than", "x")):
        with pytest.raises(RuleError):
            validate_records(stream, [bad_rule])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    checked = {k.removeprefix("row_").removeprefix("table_") for k in e.queries()} | {"validate_schema"}
    assert set(CHECKS) <= checked and set(e.oracle_sql()) <= set(e.queries())


def test_single_rules(basic):
    import plumbline

    metric = plumbline.analyze(basic, Rule.of("name", "is_complete", threshold=0.8, execute=False))
    assert (metric.kind, metric.value, metric.metadata) == ("completeness", 0.8, {"null_count": 1, "total_count": 5})
    assert plumbline.check(metric, Rule.of("name", "is_complete", threshold=0.8)).status == "PASS" and plumbline.check(metric, Rule.of("name", "is_complete")).status == "FAIL"
    for check in CHECKS:
        assert plumbline.analyzer(check) and plumbline.constraint(check)
    assert plumbline.implemented() == sorted({c.alias_of or c.name for c in CHECKS.values()})
    for make in (plumbline.analyzer, plumbline.constraint):
        with pytest.raises(RuleError, match="is_complete"):
            make("no_such_check")
    with pytest.raises(RuleError):
        plumbline.analyze(basic, Rule.of("nope", "is_unique"))
    assert plumbline.analyze(basic, Rule.of("age", "has_sum", 1)).value == 147.0 and plumbline.analyze(basic, Rule.of(["status", "id"], "are_unique")).value == 1.0


def test_single_rules_agree_with_reports(basic):
    import plumbline

    rules = [Rule.of("age", "is_between", [20, 36]), Rule.of("status", "is_unique"), Rule.of("age", "has_std", 1.0), Rule.of("status", "has_entropy", 1.0), Rule.of("*", "validate_schema", '{"id":"integer","name":"integer"}')]
    for rule, result in zip(rules, validate(basic, rules).results):
        alone = plumbline.check(plumbline.analyze(basic, rule), rule)
        assert (alone.status, alone.actual, alone.message, alone.metadata) == (result.status, result.actual, result.message, result.metadata)


def test_rules_that_break_at_run_time_harm_no_other(spark):
    df = spark.createDataFrame([(1, "x"), (2, "3")], "id int, s string")
    good = [Rule.of("id", "is_greater_than", k) for k in range(6)]
    bad = Rule.of("s", "satisfies", "CAST(s AS INT) > 0 OR raise_error('no') IS NULL")
    out = validate(df, [*good[:3], bad, *good[3:]]).results
    assert [r.status for r in out] == ["PASS", "FAIL", "FAIL", "ERROR", "FAIL", "FAIL", "FAIL"]


def test_sampled_profiles(spark):
    df = spark.range(2000).selectExpr("id", "id % 7 AS k")
    first, second = profile(df, 0.25).to_map()["column_profiles"], profile(df, 0.25).to_map()["column_profiles"]
    assert first == second and 400 < first["id"]["row_count"] < 600 and first["k"]["distinct_count"] == 7
    for fraction in (None, 0.0, 1.0, 1.5):
        assert profile(df, fraction).table_stats["total_rows"] == 2000


def test_distinct_values_of_profiles(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0.0, "a", [1], {"x": 1}, None), (-0.0, "a", [1], {"x": 1}, None), (nan, "", [1, None], {"x": 2}, None), (nan, None, None, None, None)], "d double, s string, a array<int>, m map<string,int>, n int")
    assert {k: v.distinct_count for k, v in profile(df).column_profiles.items()} == {"d": 2, "s": 2, "a": 2, "m": 2, "n": 0}
    assert profile(spark.createDataFrame([], "x int")).column_profiles["x"].distinct_count == 0


def test_key_sets_are_counted_once(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "a int, b int")
    report = validate(df, [Rule.of(["a", "b"], "are_unique"), Rule.of(["B", "a"], "is_composite_key")])
    assert [r.fail_count for r in report.results] == [2, 2] and len(report.validated._held) == 1
    assert report.bad.count() == 2
    report.validated.release()
    assert report.bad.count() == 2


def test_contract_verdicts(spark):
    df = spark.createDataFrame([], "a array<int>, s struct<x:int,y:string>, c string COMMENT 'note'")
    contract = SchemaContract.of(
        {
            "a": {"type": "array", "element_type": "string", "nullable": False},
            "s": {"type": "struct", "fields": [{"name": "x", "type": "string"}, {"name": "z", "type": "string"}, {"name": "o", "is_optional": True}], "require_comment": True},
            "c": {"type": "string", "expected_comment": "other", "nullable": False},
            "t": "no_such_type",
        }
    )
    report = check_schema(df.withColumn("t", df.c), contract)
    assert set(report.type_errors) == {"a", "s.x", "t"} and set(report.metadata_errors) == {"a", "s", "c"} and report.missing_columns == ["s.z"]
    assert report.metadata_errors["c"].startswith("Schema violation") and report.total_issues == 7
