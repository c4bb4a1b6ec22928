"""Schema contracts: what columns a dataset should have, compared with its schema. No job is run."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .. import messages
from ..catalog import RuleError
from ..rules import truthy

# The spellings of types that a contract may use, by canonical class.
_SPELLINGS = {
    "integer": ("byte", "tinyint", "short", "smallint", "integer", "int", "long", "bigint"),
    "float": ("float", "double", "decimal"),
    "string": ("string", "varchar", "char"),
    "binary": ("binary",),
    "boolean": ("boolean",),
    "datetime": ("date", "timestamp", "timestamp_ntz", "datetime"),
    "array": ("array",),
    "complex": ("struct", "map", "complex"),
}
TYPE_NAMES = {name: kind for kind, names in _SPELLINGS.items() for name in names}


@dataclass(frozen=True)
class ColumnContract:
    name: str
    type: str
    is_optional: bool = False
    nullable: bool = True
    element_type: str | None = None
    require_comment: bool = False
    expected_comment: str | None = None
    fields: tuple[ColumnContract, ...] | None = None

    @classmethod
    def of(cls, name: str, props: Any) -> ColumnContract:
        """From a type name, or a map of properties with nested ``fields`` as a map or a list of named maps."""
        if not isinstance(props, dict):
            return cls(name, props if isinstance(props, str) else "string")
        text = lambda k: None if props.get(k) is None else str(props[k])
        return cls(
            name,
            str(props.get("type", "string")),
            truthy(props.get("is_optional", False)),
            truthy(props.get("nullable", True)),
            text("element_type"),
            truthy(props.get("require_comment", False)),
            text("expected_comment"),
            cls._nested(props.get("fields")),
        )

    @classmethod
    def _nested(cls, fields: Any) -> tuple[ColumnContract, ...] | None:
        if isinstance(fields, dict):
            return tuple(cls.of(str(k), v) for k, v in fields.items())
        if not isinstance(fields, (list, tuple)):
            return None
        out = []
        for item in fields:
            name = str(item.get("name", "")).strip() if isinstance(item, dict) else ""
            if not name:
                raise RuleError(f"Invalid nested field entry: {item!r} (a map with 'name' is needed)")
            out.append(cls.of(name, {k: v for k, v in item.items() if k != "name"}))
        return tuple(out)


@dataclass(frozen=True)
class SchemaContract:
    columns: tuple[ColumnContract, ...]
    strict_columns: bool = False

    @classmethod
    def of(cls, data: dict[str, Any] | str, strict: bool = False) -> SchemaContract:
        if isinstance(data, str):
            try:
                data = json.loads(data)
            except ValueError as e:
                raise RuleError(f"the contract isn't JSON: {e}") from e
        if not isinstance(data, dict):
            raise RuleError("a contract is a JSON object of columns")
        return cls(tuple(ColumnContract.of(str(k), v) for k, v in data.items()), strict)


@dataclass
class SchemaReport:
    missing_columns: list[str] = field(default_factory=list)
    type_errors: dict[str, str] = field(default_factory=dict)
    metadata_errors: dict[str, str] = field(default_factory=dict)
    extra_columns: list[str] = field(default_factory=list)

    @property
    def total_issues(self) -> int:
        return len(self.missing_columns) + len(self.type_errors) + len(self.metadata_errors) + len(self.extra_columns)

    @property
    def passed(self) -> bool:
        return not self.total_issues

    def to_map(self) -> dict[str, Any]:
        names = ("passed", "missing_columns", "type_errors", "metadata_errors", "extra_columns", "total_issues")
        return {n: getattr(self, n) for n in names}

    def __str__(self) -> str:
        return f"SchemaReport({'PASSED' if self.passed else 'FAILED'}, {self.total_issues} issues)"


def type_class(kind: T.DataType | str) -> str:
    """The canonical class of a Spark type or of a contract's spelling; parameters don't count."""
    name = kind if isinstance(kind, str) else kind.typeName()
    return TYPE_NAMES.get(name.strip().lower().split("(")[0].split("<")[0].strip(), "unknown")


def _facts(f: T.StructField) -> dict[str, Any]:
    out = {"raw_type": f.dataType.simpleString(), "canonical_type": type_class(f.dataType), "nullable": f.nullable, "comment": str(f.metadata.get("comment", ""))}
    inner = f.dataType
    if isinstance(inner, T.ArrayType):
        out["element_type"] = type_class(inner.elementType)
        inner = inner.elementType
    if isinstance(inner, T.StructType):
        out["nested_fields"] = {g.name: _facts(g) for g in inner.fields}
    return out


def extract_schema(df: DataFrame) -> dict[str, dict[str, Any]]:
    """Name -> raw_type, canonical_type, nullable, comment and, of nested types, element_type and nested_fields."""
    return {f.name: _facts(f) for f in df.schema.fields}


def check_schema(df: DataFrame, contract: SchemaContract) -> SchemaReport:
    """The contract's columns, nested ones by their paths, each against what the schema says of it."""
    actual = extract_schema(df)
    report = SchemaReport()
    for path, wanted, facts in _pairs(contract.columns, actual):
        if facts is None:
            if not wanted.is_optional:
                report.missing_columns.append(path)
            continue
        for kind, verdicts in ((report.type_errors, TYPE_CHECKS), (report.metadata_errors, METADATA_CHECKS)):
            if kind is report.metadata_errors and verdict_of(TYPE_CHECKS[:1], wanted, facts):
                continue  # what has the wrong type has no other verdict
            if note := verdict_of(verdicts, wanted, facts):
                kind[path] = note
    if contract.strict_columns:
        named = {c.name for c in contract.columns}
        report.extra_columns += [c for c in actual if c not in named]
    return report


def _pairs(contracts, actual: dict[str, dict[str, Any]], above: str = ""):
    """(path, contract, facts or None) of columns, and of the fields of those whose type fits."""
    for c in contracts:
        facts = actual.get(c.name)
        yield above + c.name, c, facts
        if facts and c.fields is not None and "nested_fields" in facts and not class_differs(c, facts):
            yield from _pairs(c.fields, facts["nested_fields"], f"{above}{c.name}.")


def verdict_of(checks, wanted: ColumnContract, facts: dict[str, Any]) -> str | None:
    """What the first of ``checks`` that is violated says."""
    return next(filter(None, (check(wanted, facts) for check in checks)), None)


def class_differs(wanted: ColumnContract, facts: dict[str, Any]) -> str | None:
    want, got, raw = type_class(wanted.type), facts["canonical_type"], facts["raw_type"]
    if "unknown" in (want, got):
        return messages.CONTRACT_UNMAPPED.format(raw=raw) if want != "unknown" else messages.CONTRACT_UNKNOWN.format(type=wanted.type, known=", ".join(sorted(TYPE_NAMES)))
    return None if want == got else messages.CONTRACT_TYPE.format(want=want, got=got, raw=raw)


def element_differs(wanted: ColumnContract, facts: dict[str, Any]) -> str | None:
    want, got = wanted.element_type, facts.get("element_type")
    return None if want is None or got is None or want.lower() == got else messages.CONTRACT_ELEMENT.format(want=want, got=got)


def nulls_allowed(wanted: ColumnContract, facts: dict[str, Any]) -> str | None:
    return messages.CONTRACT_NULLS if facts["nullable"] and not wanted.nullable else None


def comment_differs(wanted: ColumnContract, facts: dict[str, Any]) -> str | None:
    want = wanted.expected_comment
    return None if want in (None, facts["comment"].strip()) else messages.CONTRACT_COMMENT.format(want=want)


def comment_missing(wanted: ColumnContract, facts: dict[str, Any]) -> str | None:
    return messages.CONTRACT_NO_COMMENT if wanted.require_comment and not facts["comment"].strip() else None


#: In order of weight: the first one that is violated is reported.
TYPE_CHECKS = (class_differs, element_differs)
METADATA_CHECKS = (nulls_allowed, comment_differs, comment_missing)
