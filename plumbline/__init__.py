"""Plumbline: declarative data quality on Spark DataFrames, batch and streaming."""

from .catalog import CHECKS, RuleError
from .operators.contract import SchemaContract, check_schema, extract_schema
from .operators.profile import profile
from .operators.validate import analyze, analyzer, check, constraint, implemented, validate
from .results import Metric, Report, Result
from .rules import Rule
from .streaming.records import validate_records

__all__ = ["CHECKS", "Metric", "Report", "Result", "Rule", "RuleError", "SchemaContract", "analyze", "analyzer", "check", "check_schema", "constraint", "extract_schema", "implemented", "profile", "validate", "validate_records"]
