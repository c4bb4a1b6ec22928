"""Rules as CSV and JSON text, both ways. No files are opened here."""

from __future__ import annotations

import json
import logging
import re
from datetime import date
from typing import Any

from ..catalog import RuleError
from ..rules import Rule, decimal_text, from_map, tagged

# Fixed value: the columns of the CSV form.
HEADER = ("field", "check_type", "value", "threshold", "tolerance", "execute", "level", "category")
log = logging.getLogger(__name__)


def csv_cells(line: str) -> list[str]:
    """Cells of one physical line, trimmed; a quote that doesn't end is an error (cells can't span lines)."""
    parts = line.split('"')
    if len(parts) % 2 == 0:
        raise RuleError(f"Unterminated quoted field in CSV line: {line}")
    cells, quoted = [""], False
    for k, part in enumerate(parts):
        if k % 2:  # inside quotes
            cells[-1] += part
            quoted = True
            continue
        if part == "" and quoted and 0 < k < len(parts) - 1:
            cells[-1] += '"'  # a doubled quote
            continue
        first, *rest = part.split(",")
        cells[-1] += first
        cells += rest
    return [c.strip() for c in cells]


def from_csv(text: str) -> list[Rule]:
    """A header, then one rule on each line that isn't blank; empty cells are left out, extra columns are metadata."""
    lines = [x for x in re.split(r"\r?\n", text) if x.strip()]  # other separators may stand in cells
    if not lines:
        return []
    names = csv_cells(lines[0])
    out = []
    for line in lines[1:]:
        cells = csv_cells(line)
        out.append(from_map({n: c for n, c in zip(names, cells + [""] * len(names)) if c != ""}))
    return out


def _cell(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(ch in text for ch in ',"\n') else text


def to_csv(rules: list[Rule]) -> str:
    rows = [(r.field_name, r.check_type, tagged(r.value), decimal_text(r.threshold), decimal_text(r.tolerance), str(r.execute).lower(), r.level, r.category) for r in rules]
    return "\n".join(",".join(map(_cell, row)) for row in [HEADER, *rows])


def _flat(v: Any) -> Any:
    """JSON values as the text that rules are read from; objects stay, for contracts."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(v)
    if isinstance(v, list):
        return "[" + ",".join(str(_flat(x)) for x in v) + "]"
    return v if isinstance(v, dict) else str(v)


def from_json(text: str | None) -> list[Rule]:
    """An object or an array of objects; text that isn't JSON gives no rules, with a warning."""
    try:
        data = json.loads(text) if text and text.strip() else []
    except ValueError as e:
        log.warning("rules aren't JSON: %s", e)
        data = []
    items = data if isinstance(data, list) else [data]
    return [from_map({k: _flat(v) for k, v in item.items()}) for item in items if isinstance(item, dict)]


def _native(v: Any) -> Any:
    if isinstance(v, date):
        return v.isoformat()
    return [_native(x) for x in v] if isinstance(v, (list, tuple)) else v


def to_json(rules: list[Rule]) -> str:
    out = []
    for r in rules:
        item = {"field": r.field_name, "check_type": r.check_type, "threshold": r.threshold, "tolerance": r.tolerance, "execute": r.execute, "level": r.level, "category": r.category}
        item |= {} if r.value is None else {"value": _native(r.value)}
        item |= {} if r.updated_at is None else {"updated_at": r.updated_at.isoformat()}
        out.append(item | {k: str(v) for k, v in r.metadata.items()})
    return json.dumps(out)
