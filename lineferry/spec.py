"""Declarative descriptions of a load (file to table) and an extract (table to file).

A spec holds no Spark state apart from the dimension DataFrames its lookups read; the plan
builders in :mod:`lineferry.plans` turn it into one lazy DataFrame.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIXED, DELIMITED, KEY_VALUE, XML = "fixed", "delimited", "key_value", "xml"
INSERT, UPDATE, MIXED = "insert", "update", "mixed"


class SpecError(ValueError):
    """A spec that cannot be run, whatever the data."""


@dataclass(frozen=True)
class InsertRule:
    """What a missing dimension row looks like: its key column and columns filled from the spec."""

    key: str
    constants: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Lookup:
    """Resolve a field by joining a dimension.

    ``on`` maps a parameter (the field's own name, or another field) to a dimension column.
    ``unique`` states that ``on`` is a key of the dimension, which saves the ambiguity check.
    ``full_cache`` compares null-safe on text, the last row by ``order`` winning.
    ``deferred`` leaves the raw text for the staging step to resolve.
    """

    dim: DataFrame
    on: Mapping[str, str]
    value: str
    optional: bool = False
    unique: bool = False
    full_cache: bool = False
    order: str | None = None
    insert: InsertRule | None = None
    deferred: bool = False


@dataclass(frozen=True)
class GlobalFilter:
    """Reject rows whose parameters hit a dimension row with a true ``flag``."""

    name: str
    dim: DataFrame
    on: Mapping[str, str]
    flag: str


@dataclass(frozen=True)
class Field:
    name: str
    start: int = 0
    end: int = 0
    tag: str | None = None
    key: bool = False
    default: str | None = None
    convert: str | None = None
    args: Mapping[str, Any] = field(default_factory=dict)
    filter_values: Sequence[str] = ()
    filter_fields: Sequence[str] = ()
    nulls: Sequence[str] = ()
    external: bool = False
    optional: bool = True
    lookup: Lookup | None = None
    size: int = 0

    @property
    def conversion(self) -> str:
        if self.convert is not None:
            return self.convert
        return "long" if self.lookup is not None else "text"

    @property
    def width(self) -> int:
        """Text width of a fixed-width field, else its stated ``size``, -1 where it has none."""
        return self.end - self.start + 1 if self.end > 0 else self.size or -1


def run_clock(run_ts: dt.datetime | None) -> Column:
    """The load's clock: a constant when given, so that a rerun gives the same rows."""
    return F.current_timestamp() if run_ts is None else F.lit(run_ts.isoformat(sep=" ")).cast("timestamp")


@dataclass(frozen=True)
class LoadSpec:
    table: str
    fields: Sequence[Field]
    kind: str = FIXED
    mode: str = MIXED
    delimiter: str | None = None
    headers: Sequence[str] = ()
    trailers: Sequence[str] = ()
    pad: bool = True
    row_tag: str | None = None
    filters: Sequence[GlobalFilter] = ()
    generated_key: str | None = None
    run_ts: dt.datetime | None = None

    def __post_init__(self) -> None:
        validate_load(self)

    def field(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    @property
    def keys(self) -> list[str]:
        return [f.name for f in self.fields if f.key]

    @property
    def written(self) -> list[str]:
        """Columns that reach the target; external fields only take part in the load."""
        return [f.name for f in self.fields if not f.external]

    @property
    def clock(self) -> Column:
        return run_clock(self.run_ts)

    def with_fields(self, *fields: Field) -> LoadSpec:
        return replace(self, fields=fields)


@dataclass(frozen=True)
class ExtractSpec:
    """``header`` and ``footer`` are templates over {start}, {name}, {definition} and {count}."""

    name: str
    fields: Sequence[Field]
    kind: str = FIXED
    delimiter: str = "|"
    root_tag: str = "records"
    record_tag: str = "record"
    header: str = ""
    footer: str = ""
    definition: str = ""
    run_ts: dt.datetime | None = None

    def __post_init__(self) -> None:
        if self.kind not in (FIXED, DELIMITED, KEY_VALUE, XML):
            raise SpecError(f"unknown output type {self.kind!r}")
        _check_fields(self.fields)

    @property
    def clock(self) -> Column:
        return run_clock(self.run_ts)

    @property
    def layout_fields(self) -> list[Field]:
        """Fields in output order: by tag for XML, by start otherwise; external ones are left out."""
        shown = [f for f in self.fields if not f.external]
        if self.kind == XML:
            return sorted(shown, key=lambda f: f.tag or f.name)
        return sorted(shown, key=lambda f: f.start)

    def width(self, f: Field) -> int:
        return f.width if self.kind == FIXED else -1


# Parameter names that stand for the field's own text unless a field is called so.
OWN_TEXT = ("VALUE", "CODE")


def is_own_text(param: str, names) -> bool:
    return param.upper() in OWN_TEXT and param not in names


def lookup_order(fields: Sequence[Field]) -> list[Field]:
    """Lookup fields so that every field comes after the lookups it takes parameters from."""
    by_name = {f.name: f for f in fields}
    done: list[Field] = []

    def visit(f: Field, path: tuple[str, ...]) -> None:
        if f.name in path:
            raise SpecError("circular lookup reference: " + " -> ".join((*path, f.name)))
        if f in done or f.lookup is None:
            return
        for param in f.lookup.on:
            if param != f.name and not is_own_text(param, by_name):
                if param not in by_name:
                    raise SpecError(f"lookup of {f.name!r} uses undefined field {param!r}")
                visit(by_name[param], (*path, f.name))
        done.append(f)

    for f in fields:
        visit(f, ())
    return done


def _check_fields(fields: Sequence[Field]) -> None:
    names = [f.name for f in fields]
    if any(not n or not n.strip() for n in names):
        raise SpecError("field name cannot be blank")
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise SpecError(f"duplicated field {', '.join(twice)}")


def validate_load(spec: LoadSpec) -> None:
    """Refuse specs that no file could satisfy."""
    from lineferry.functions.convert import conversion

    if spec.kind not in (FIXED, DELIMITED, XML):
        raise SpecError(f"unknown load type {spec.kind!r}")
    if spec.mode not in (INSERT, UPDATE, MIXED):
        raise SpecError(f"unknown update mode {spec.mode!r}")
    if not spec.table or not spec.table.strip():
        raise SpecError("destination table not specified")
    if spec.kind == DELIMITED and not spec.delimiter:
        raise SpecError("delimited load without a delimiter")
    if spec.kind == XML and not spec.row_tag:
        raise SpecError("XML load without a record tag")
    _check_fields(spec.fields)
    names = {f.name for f in spec.fields}
    lookup_order(spec.fields)
    for f in spec.fields:
        conversion(f.conversion)
        for other in f.filter_fields:
            if other == f.name:
                raise SpecError(f"field {f.name!r} cannot filter on itself")
            if other not in names:
                raise SpecError(f"field {f.name!r} cannot filter on unknown field {other!r}")
        if f.start < 0 or f.end < 0:
            raise SpecError(f"{f.name}: location must not be negative")
        if spec.kind == FIXED and f.start > f.end:
            raise SpecError(f"{f.name}: end must not be before start")


def dated_path(directory: str, name: str, day: dt.date, pattern: str = "%Y%m%d") -> str:
    """Path of a dated hand-off file; call with the previous day for the delta's other side."""
    return f"{directory.rstrip('/')}/{name}{day.strftime(pattern)}"


def previous_dated_path(directory: str, name: str, day: dt.date, pattern: str = "%Y%m%d") -> str | None:
    """The day before's path, or None when the pattern gives both days the same name."""
    before = dated_path(directory, name, day - dt.timedelta(days=1), pattern)
    return None if before == dated_path(directory, name, day, pattern) else before
