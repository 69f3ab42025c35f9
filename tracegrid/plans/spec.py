"""The frozen reading of a workbook: where headers, labels, values, notes and totals are."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

import yaml

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
WHOLE_WORDS = ("all", "all products", "total")


def column_number(letters: str) -> int:
    n = 0
    for ch in letters.upper():
        if not "A" <= ch <= "Z":
            raise ValueError(f"{letters!r} is no column")
        n = n * 26 + ord(ch) - 64
    return n


def letters_of(n: int) -> str:
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


@dataclass
class SheetSpec:
    """Where things are on one sheet. A record sheet has ``id_columns`` and ``value_columns``; a cross-tab a label column."""

    sheet: str
    header_rows: list[int]
    first_data_row: int
    last_data_row: int
    value_columns: list[str]
    label_column: str | None = None
    id_columns: list[str] = field(default_factory=list)
    note_rows: list[int] = field(default_factory=list)
    row_kinds: dict[str, str] = field(default_factory=dict)
    constants: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.first_data_row > self.last_data_row:
            raise ValueError(f"{self.sheet}: the data ends before it begins")
        for pattern in self.row_kinds.values():
            re.compile(pattern)

    @property
    def value_numbers(self) -> list[int]:
        return [column_number(c) for c in self.value_columns]


@dataclass
class Spec:
    file: str
    table: str
    layout: str
    entity: str
    measure: str
    period: str | None
    sheets: list[SheetSpec]
    section_dimension: str | None = None
    unit: str | None = None
    defaults: dict[str, str] = field(default_factory=dict)
    aliases: dict[str, dict[str, str]] = field(default_factory=dict)
    absent: list[str] = field(default_factory=list)
    confidence: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.sheets = [s if isinstance(s, SheetSpec) else SheetSpec(**s) for s in self.sheets]
        if not IDENTIFIER.fullmatch(self.table):
            raise ValueError(f"table must be a plain identifier, not {self.table!r}")
        if Path(self.file).name != self.file or self.file in ("", ".", ".."):
            raise ValueError(f"file must be a bare file name, not {self.file!r}")
        if self.layout not in ("crosstab", "record"):
            raise ValueError(f"layout must be crosstab or record, not {self.layout!r}")
        if any("section_header" in s.row_kinds for s in self.sheets) and not self.section_dimension:
            self.section_dimension = "section"  # repeated subtotals need it to differ

    def save(self, path: str | Path) -> None:
        kept = {k: v for k, v in asdict(self).items() if v not in (None, [], {})}
        kept["sheets"] = [{k: v for k, v in s.items() if v not in (None, [], {})} for s in kept["sheets"]]
        Path(path).write_text(yaml.safe_dump(kept, sort_keys=False, allow_unicode=True), encoding="utf-8")

    @classmethod
    def load(cls, path: str | Path) -> Spec:
        raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
        known = {f.name for f in fields(cls)}
        return cls(**{"period": None} | {k: v for k, v in raw.items() if k in known})


def confirmed(spec: Spec) -> Spec:
    """What a person confirmed, tidied: constants trimmed, and a whole among parts made the default."""
    values: dict[str, set[str]] = {}
    for s in spec.sheets:
        s.constants = {k: v.strip() for k, v in s.constants.items()}
        for k, v in s.constants.items():
            values.setdefault(k, set()).add(v)
    for k, own in values.items():
        whole = sorted(v for v in own if v.lower() in WHOLE_WORDS)
        if len(own) > 1 and whole and k not in spec.defaults:
            spec.defaults[k] = whole[0]
    return spec
