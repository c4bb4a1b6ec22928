from datetime import date, datetime

import pytest

from plumbline import CHECKS, Rule, RuleError
from plumbline import catalog
from plumbline.rules import decimal_text, from_map, parse_field, parse_value, tagged
from plumbline.sources import rule_text


def test_catalog_counts():
    assert len(CHECKS) == 54
    assert sum(c.level == "ROW" for c in CHECKS.values()) == 45
    sizes = {g: len(catalog.by_category(g)) for g in {c.category for c in CHECKS.values()}}
    assert sizes == {"completeness": 2, "uniqueness": 4, "comparison": 11, "membership": 4, "pattern": 2, "date": 21, "sql": 1, "aggregation": 8, "schema": 1}
    assert all(c.alias_of is None or c.alias_of in CHECKS for c in CHECKS.values())
    assert catalog.canonical("is_yesterday") == "is_t_minus_1"
    assert not catalog.is_supported("is_unique", "spark-streaming") and catalog.is_supported("is_positive", "flink-streaming")
    assert not catalog.is_supported("nope", "spark")


@pytest.mark.parametrize("text,value", [("NULL", None), ("", None), ("2024-01-02", date(2024, 1, 2)), ("2024-01-02T03:04:05", datetime(2024, 1, 2, 3, 4, 5)), ("42", 42), ("1.5", 1.5), ("5d", 5.0), ("1_0", "1_0"), ("true", True), ("x", "x"), ("[1, 'a,b', 2.5]", [1, "a,b", 2.5]), ("LongValue(7)", 7)])
def test_values(text, value):
    got = parse_value(text)
    assert got == value and type(got) is type(value)


@pytest.mark.parametrize("value", [42, 1.5, 1e-9, True, date(2024, 1, 2), datetime(2024, 1, 2, 3, 4, 5), ["a", "b"], [[1, 2], "x"], "plain"])
def test_tags_round_trip(value):
    assert parse_value(tagged(value)) == value


def test_malformed_tag():
    with pytest.raises(RuleError):
        parse_value("LongValue(x)")


def test_doubles_print_as_on_the_jvm():
    assert [decimal_text(x) for x in (1.0, 0.8, 1e-9, 1e7, 123456.789, 0.0)] == ["1.0", "0.8", "1.0E-9", "1.0E7", "123456.789", "0.0"]


def test_from_map():
    r = from_map({"field": "[a,b]", "check_type": "are_unique", "threshold": "x", "execute": "0", "level": "row_level", "env": "prod"})
    assert (r.columns, r.threshold, r.execute, r.level, r.metadata) == (("a", "b"), 1.0, False, "ROW", {"env": "prod"})
    assert parse_field("a") == "a"
    assert from_map({"field": "x", "check_type": "has_pattern", "value": "[0-9]"}).value == "[0-9]"
    with pytest.raises(RuleError):
        from_map({"field": "x"})
    with pytest.raises(RuleError):
        Rule.of("x", "nope")


def test_csv_and_json():
    rules = [Rule.of("a", "is_between", [1, 2.5]), Rule.of(("a", "b"), "are_unique", threshold=0.5), Rule.of("c", "is_in", ['say "x"', "y,z"])]
    assert rule_text.from_csv(rule_text.to_csv(rules)) == rules
    assert rule_text.from_json(rule_text.to_json(rules))[:2] == rules[:2]
    assert rule_text.from_json("not json") == [] and rule_text.from_json(None) == []
    with pytest.raises(RuleError):
        rule_text.from_csv('field,check_type\n"a,is_complete')


def test_skip_reasons():
    assert Rule.of("a", "is_complete", execute=False).skip_reason("ROW", "spark") == "execute=false"
    assert Rule.of("a", "has_min", 1).skip_reason("ROW", "spark") == "Wrong level: expected 'ROW', got 'TABLE'"
    assert Rule.of("a", "is_unique").skip_reason("ROW", "spark-streaming") == "Engine 'spark-streaming' not supported for rule 'is_unique'"


@pytest.mark.parametrize("text,names", [("a", "a"), (" a , b ", ("a", "b")), ("[a,b]", ("a", "b")), ('"[a,b]"', ("a", "b")), ('["a,b",c]', ("a,b", "c")), ("'a'", "a"), ("[]", ""), ("", ""), ("a,", "a"), (["x", " y "], ("x", "y"))])
def test_fields(text, names):
    assert parse_field(text) == names


def test_csv_lines_end_at_line_feeds_only():
    cell = "one two\x85three\x0bfour"
    rules = rule_text.from_csv(f'field,check_type,value\r\na,is_equal,"{cell}"\r\n\r\nb,is_complete,')
    assert [r.field for r in rules] == ["a", "b"] and rules[0].value == cell
