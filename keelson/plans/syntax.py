"""Syntax trees."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Literal:
    value: int | str


@dataclass(frozen=True)
class Unary:
    op: str  # "not" or "-"
    operand: Node


@dataclass(frozen=True)
class Binary:
    op: str  # "or", "and", "=", "!=", "<", "<=", ">", ">=", "+", "-", "*", "/"
    left: Node
    right: Node


@dataclass(frozen=True)
class Listed:
    """Several expressions in parentheses; only comparisons with a key take them."""

    items: tuple[Node, ...]


Node = Name | Literal | Unary | Binary | Listed


@dataclass(frozen=True)
class Select:
    table: str
    outputs: tuple[Node, ...]
    where: Node | None = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[tuple[str, str], ...]
    key: tuple[str, ...]


@dataclass(frozen=True)
class Insert:
    table: str
    values: tuple[int | str, ...]


@dataclass(frozen=True)
class Update:
    table: str
    changes: tuple[tuple[str, Node], ...]
    where: Node | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Node | None = None


Statement = Select | CreateTable | Insert | Update | Delete
