"""Parsed commands and filter expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from docloom.functions.types import FieldDef


class CommandError(ValueError):
    """A command that cannot be parsed or run."""


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: object


@dataclass(frozen=True)
class And:
    items: tuple


@dataclass(frozen=True)
class Or:
    items: tuple


@dataclass(frozen=True)
class SelectDatabases:
    name: str | None = None


@dataclass(frozen=True)
class SelectDocuments:
    bundle: str
    fields: tuple[str, ...] = ()
    include: str | None = None
    where: object = None


@dataclass(frozen=True)
class CreateDatabase:
    name: str


@dataclass(frozen=True)
class UpdateDatabase:
    name: str


@dataclass(frozen=True)
class DeleteDatabase:
    name: str


@dataclass(frozen=True)
class CreateBundle:
    name: str
    fields: tuple[FieldDef, ...]


@dataclass(frozen=True)
class ChangeField:
    old: str
    new: FieldDef


@dataclass(frozen=True)
class AddField:
    new: FieldDef


@dataclass(frozen=True)
class RemoveField:
    old: str


@dataclass(frozen=True)
class CreateRelationship:
    name: str
    source: str
    target: str
    pairs: tuple[tuple[str, str], ...]
    types: tuple[tuple[str, str], ...] = ()  # of each pair, where they are declared


@dataclass(frozen=True)
class UpdateRelationship:
    """The relationship of that name, as it shall be."""

    made: CreateRelationship


@dataclass(frozen=True)
class DeleteRelationship:
    name: str


@dataclass(frozen=True)
class UpdateBundle:
    name: str
    changes: tuple


@dataclass(frozen=True)
class DeleteBundle:
    name: str


@dataclass(frozen=True)
class CreateIndex:
    kind: str
    name: str
    bundle: str
    fields: tuple[str, ...]
    unique: bool = False
    ignore_case: bool = False


@dataclass(frozen=True)
class AddDocument:
    bundle: str
    values: dict = field(default_factory=dict)


@dataclass(frozen=True)
class UpdateDocuments:
    bundle: str
    values: dict
    where: object
    raw: dict = field(default_factory=dict)  # the values as written, quotes included


@dataclass(frozen=True)
class DeleteDocuments:
    bundle: str
    where: object
