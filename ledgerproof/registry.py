"""Document types: which fields a record has and how it is checked."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ledgerproof.config import ALL_FIELDS, REQUIRED_FIELDS
from ledgerproof.operators.cross import cross_issues
from ledgerproof.operators.record import build_records
from ledgerproof.operators.rules import validate_records


@dataclass(frozen=True)
class DocType:
    name: str
    all_fields: tuple[str, ...]
    required_fields: tuple[str, ...]
    grounded_fields: tuple[str, ...]
    build: Callable[[DataFrame], DataFrame]
    validate: Callable[[DataFrame], DataFrame]
    cross_check: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


_TYPES: dict[str, DocType] = {}


def register(doc_type: DocType) -> None:
    _TYPES[doc_type.name] = doc_type


def get(name: str) -> DocType | None:
    return _TYPES.get(name)


def names() -> tuple[str, ...]:
    return tuple(sorted(_TYPES))


register(
    DocType(
        name="invoice",
        all_fields=ALL_FIELDS,
        required_fields=REQUIRED_FIELDS,
        grounded_fields=ALL_FIELDS,
        build=build_records,
        validate=validate_records,
        cross_check=cross_issues,
    )
)
