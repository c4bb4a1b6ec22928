"""Rules: what is expected of which column, and how rules and their values are read from plain data."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, datetime
from typing import Any

from . import catalog
from .catalog import RuleError

TRUTHY = {"true", "1", "yes", "y", "t"}
#: Checks whose value is text, whatever it looks like.
TEXT_VALUED = {"has_pattern", "satisfies", "validate_date_format", "is_equal_than"}
_KNOWN = ("field", "check_type", "value", "threshold", "tolerance", "level", "category", "execute", "updated_at")
_TAGS = (("StringValue", str), ("LongValue", int), ("DoubleValue", float), ("BoolValue", bool), ("DateValue", date), ("DateTimeValue", datetime), ("ListValue", list))
_DOUBLE = re.compile(r"[+-]?(NaN|Infinity|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)[fFdD]?", re.ASCII)


def truthy(v: Any) -> bool:
    if isinstance(v, str):
        return v.strip().lower() in TRUTHY
    return bool(v) if isinstance(v, (bool, int, float)) else False


def level_name(level: Any) -> str:
    return str(level).strip().upper().removesuffix("_LEVEL")


def decimal_text(x: float) -> str:
    """A double as the JVM prints it."""
    if x != x or x in (float("inf"), float("-inf")):
        return "NaN" if x != x else "Infinity" if x > 0 else "-Infinity"
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        return repr(float(x)) if "e" not in repr(float(x)) else f"{x:.1f}"
    digits, _, power = f"{x!r}".lower().partition("e")
    if not power:
        digits, _, power = f"{x:.17e}".partition("e")
        digits = next(d for d in (f"{x:.{n}e}".partition("e")[0] for n in range(18)) if float(f"{d}e{power}") == x)
    return f"{digits if '.' in digits else digits + '.0'}E{int(power)}"


@dataclass(frozen=True)
class Rule:
    """One expectation. This constructor checks nothing; ``Rule.of`` does."""

    field: str | tuple[str, ...]
    check_type: str
    value: Any = None
    threshold: float = 1.0
    tolerance: float = 1e-9
    execute: bool = True
    level: str = catalog.ROW
    category: str = "unknown"
    updated_at: datetime | None = None
    metadata: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, field, check_type: str, value=None, *, threshold: float = 1.0, tolerance: float = 1e-9, execute: bool = True, level=None, category=None, updated_at=None, metadata=None) -> Rule:
        check = catalog.get(check_type)
        if check is None:
            raise RuleError(f"Unknown check type '{check_type}'; the first known ones: {', '.join(catalog.names()[:10])}")
        columns = field if isinstance(field, str) else tuple(field)
        return cls(columns, check_type, value, float(threshold), float(tolerance), execute, level or check.level, category or check.category, updated_at, dict(metadata or {}))

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.field,) if isinstance(self.field, str) else tuple(self.field)

    @property
    def field_name(self) -> str:
        return ",".join(self.columns)

    @property
    def canonical(self) -> str:
        return catalog.canonical(self.check_type)

    def applies_to(self, level: str) -> bool:
        return level_name(self.level) == level_name(level)

    def skip_reason(self, level: str, engine: str) -> str | None:
        if not self.execute:
            return "execute=false"
        if not self.applies_to(level):
            return f"Wrong level: expected '{level}', got '{self.level}'"
        if not catalog.is_supported(self.check_type, engine):
            return f"Engine '{engine}' not supported for rule '{self.check_type}'"
        return None

    def __str__(self) -> str:
        more = f", +{len(self.metadata)} meta" if self.metadata else ""
        return f"RuleDef(field={self.field_name}, check={self.check_type}, level={self.level}, category={self.category}{more})"


def _unquoted(text: str) -> str:
    """Without one quote of either kind at each end."""
    for quote in "\"'":
        text = text.removeprefix(quote).removesuffix(quote)
    return text


def parse_field(v: Any) -> str | tuple[str, ...]:
    """A list, ``[a,b]``, ``a,b`` or a bare name, quoted as a whole or not; a single element is a plain name. In brackets
    names may be quoted, and commas within quotes are theirs."""
    if isinstance(v, (list, tuple)):
        parts = [str(x).strip() for x in v]
    else:
        text = _unquoted(str(v).strip()).strip()
        if text.startswith("[") and text.endswith("]"):
            parts = [_unquoted(p.strip()) for p in split_top_level(text[1:-1].strip())]
        else:
            parts = [p.strip() for p in text.split(",")]
            while len(parts) > 1 and not parts[-1]:  # a comma at the end begins nothing
                parts.pop()
    parts = parts or [""]
    return parts[0] if len(parts) == 1 else tuple(parts)


def split_top_level(text: str) -> list[str]:
    """Parts between the commas that no bracket and no quote encloses."""
    parts, depth, quote, last = [], 0, "", 0
    for i, ch in enumerate(text):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch in "[(":
            depth += 1
        elif ch in "])":
            depth -= 1
        elif ch == "," and depth == 0:
            parts.append(text[last:i])
            last = i + 1
    return [*parts, text[last:]] if text.strip() else []


def _plain(text: str) -> Any:
    """Untagged text: date, date and time, whole number, double, truth value, else the text."""
    for attempt in (_as_date, _as_datetime, _as_long, _as_double):
        if (found := attempt(text)) is not None:
            return found
    return text == "true" if text in ("true", "false") else text


def _as_date(t: str):
    try:
        return date.fromisoformat(t) if re.fullmatch(r"\d{4}-\d\d-\d\d", t) else None
    except ValueError:
        return None


def _as_datetime(t: str):
    try:
        return datetime.fromisoformat(t) if re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d{1,9})?)?", t) else None
    except ValueError:
        return None


def _as_long(t: str):
    return v if re.fullmatch(r"[+-]?\d+", t, re.ASCII) and -(1 << 63) <= (v := int(t)) < 1 << 63 else None


def _as_double(t: str):
    if not _DOUBLE.fullmatch(t):
        return None
    return float(t if t.lstrip("+-").startswith(("NaN", "Inf")) and t[-1] not in "fFdD" else t.rstrip("fFdD"))


def parse_value(v: Any) -> Any:
    """Anything to a rule value: None, str, int, float, bool, date, datetime or a list of these."""
    if v is None or isinstance(v, (bool, int, float, date, dict)):
        return v
    if isinstance(v, (list, tuple)):
        return [x for x in map(parse_value, v) if x is not None]
    text = str(v)
    if not text or text.upper() == "NULL":
        return None
    for tag, kind in _TAGS:
        if text.startswith(tag + "(") and text.endswith(")"):
            inner = text[len(tag) + 1 : -1]
            if kind is str:
                return inner
            found = parse_value(inner)
            if type(found) is not kind:
                raise RuleError(f"Malformed tagged rule value: '{text}'")
            return found
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        items = (p.strip() for p in split_top_level(text[1:-1]))
        items = (p[1:-1] if len(p) > 1 and p[0] == p[-1] and p[0] in "\"'" else p for p in items)
        return [x for x in map(parse_value, items) if x is not None]
    return _plain(text)


def tagged(v: Any) -> str:
    """The inverse of ``parse_value``, with no doubt about types."""
    if v is None:
        return ""
    tag = next(t for t, kind in _TAGS if type(v) is kind or (kind is list and isinstance(v, (list, tuple))))
    if tag == "ListValue":
        body = "[" + ",".join(map(tagged, v)) + "]"
    elif tag == "BoolValue":
        body = str(v).lower()
    elif tag == "DoubleValue":
        body = decimal_text(v)
    else:
        body = v.isoformat() if isinstance(v, date) else str(v)
    return f"{tag}({body})"


def from_map(data: dict[str, Any]) -> Rule:
    """A rule from loose keys; unknown keys become metadata."""
    check = str(data.get("check_type") or "").strip()
    if not check:
        raise RuleError("A rule needs a check_type")

    def number(key: str, default: float) -> float:
        v = data.get(key)
        try:
            return default if v is None or isinstance(v, str) and not v.strip() else float(v)
        except (TypeError, ValueError):
            return default

    raw = data.get("value")
    if catalog.canonical(check) in TEXT_VALUED and isinstance(raw, str) and raw and raw.upper() != "NULL" and not re.match(r"\w+Value\(", raw):
        value: Any = raw
    else:
        value = parse_value(raw)
    when = data.get("updated_at")
    if isinstance(when, str):
        when = _as_datetime(when.strip())
    execute = data.get("execute", True)
    level, category = data.get("level"), data.get("category")
    return Rule.of(
        parse_field(data.get("field") or ""),
        check,
        value,
        threshold=number("threshold", 1.0),
        tolerance=number("tolerance", 1e-9),
        execute=True if execute in (None, "") else truthy(execute),
        level=level_name(level) if level else None,
        category=str(category) if category else None,
        updated_at=when if isinstance(when, datetime) else None,
        metadata={k: v for k, v in data.items() if k not in _KNOWN},
    )
