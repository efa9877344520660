"""Tables: named columns of two kinds and an ordered primary key. No column is null."""

from __future__ import annotations

import json
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

from ..errors import EngineError, quoted

INT_MIN, INT_MAX = -(2**63), 2**63 - 1


class Kind(Enum):
    INT = "int64"
    TEXT = "string"

    @property
    def spark(self) -> T.DataType:
        return T.LongType() if self is Kind.INT else T.StringType()

    @property
    def zero(self):
        """What a literal of the other kind becomes in a column of this one."""
        return 0 if self is Kind.INT else ""


def kind_of(value) -> Kind:
    return Kind.TEXT if isinstance(value, str) else Kind.INT


def retyped(value, kind: Kind):
    return value if kind_of(value) is kind else kind.zero


@dataclass(frozen=True)
class Column:
    name: str
    kind: Kind


@dataclass(frozen=True)
class TableSchema:
    name: str
    columns: tuple[Column, ...]
    key: tuple[str, ...]

    def __post_init__(self):
        names = [c.name for c in self.columns]
        for some in (names, self.key):
            if len(set(some)) < len(some):
                raise EngineError(f"table {quoted(self.name)} names a column twice")
        for name in self.key:
            if name not in names:
                raise EngineError(f"primary key column {quoted(name)} is not a column")

    @classmethod
    def of(cls, name: str, columns: str, key: str) -> TableSchema:
        """A schema from texts such as "a int64, b string" and "a"."""
        split = [c.split() for c in columns.split(",")]
        return cls(name, tuple(Column(n, Kind(k)) for n, k in split), tuple(k.strip() for k in key.split(",")))

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    def is_key(self, name: str) -> bool:
        return name in self.key

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def key_kinds(self) -> list[Kind]:
        return [self.column(k).kind for k in self.key]

    def struct(self, nullable: bool = False) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.kind.spark, nullable) for c in self.columns])

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "columns": [[c.name, c.kind.value] for c in self.columns], "key": list(self.key)})

    @classmethod
    def from_json(cls, text: str) -> TableSchema:
        x = json.loads(text)
        return cls(x["name"], tuple(Column(n, Kind(k)) for n, k in x["columns"]), tuple(x["key"]))
