"""Report definitions: frozen values on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


class UnresolvedReference(ValueError):
    """A definition names something it does not define."""


@dataclass(frozen=True)
class Param:
    name: str
    datatype: str = "character"
    default: object = None
    values: tuple[str, ...] = ()
    hidden: bool = False

    @property
    def is_date(self) -> bool:
        return self.datatype.lower().startswith(("date", "timestamp"))


@dataclass(frozen=True)
class Item:
    """A declared column of a dataset."""

    name: str
    datatype: str = "vchar2"
    label: str = ""
    precision: int = 0
    scale: int = 0
    break_order: str = "ascending"

    @property
    def spark_type(self) -> T.DataType:
        kind = self.datatype.lower()
        if kind.startswith(("date", "timestamp", "datetime")):
            return T.TimestampNTZType()
        if kind in ("float", "real", "double") or kind.startswith("binary_"):
            return T.DoubleType()
        if kind in ("currency", "money"):
            return T.DecimalType(18, 4)
        if kind in ("integer", "int"):
            return T.IntegerType()
        if kind in ("long raw", "blob", "raw"):
            return T.BinaryType()
        if kind == "number":
            if self.scale > 0:
                return T.DecimalType(max(self.precision, self.scale), self.scale)
            return T.IntegerType() if 0 < self.precision <= 9 else T.DecimalType(38, 10)
        return T.StringType()

    @property
    def kind(self) -> str:
        t = self.spark_type
        return "date" if isinstance(t, T.TimestampNTZType) else "string" if isinstance(t, (T.StringType, T.BinaryType)) else "number"


@dataclass(frozen=True)
class Group:
    """A break level: its columns, the first of which sorts and breaks it."""

    name: str
    columns: tuple[str, ...]
    dataset: str = ""


@dataclass(frozen=True)
class Summary:
    name: str
    source: str
    function: str = "sum"
    reset: str = "report"
    compute: str = "report"


@dataclass(frozen=True)
class Link:
    """Child rows belong to the parent row whose columns equal theirs."""

    parent: str
    child: str
    pairs: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Formula:
    name: str
    body: str
    dataset: str = ""


@dataclass(frozen=True)
class Matrix:
    name: str
    rows: tuple[str, ...]
    column: str
    values: tuple[object, ...]
    measure: str
    function: str = "sum"
    margins: bool = False
    band: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    cells: tuple[tuple[str, str], ...] = ()

    @property
    def across(self) -> tuple[str, ...]:
        """All column fields, the outermost first."""
        return self.columns or (self.column,)

    @property
    def measures(self) -> tuple[tuple[str, str], ...]:
        """(measure, function) of each cell."""
        return self.cells or ((self.measure, self.function),)


@dataclass(frozen=True)
class Chart:
    name: str
    category: str
    value: str
    title: str = ""


@dataclass(frozen=True)
class Trigger:
    name: str
    body: str
    kind: str = "format"


@dataclass(frozen=True)
class Field:
    """A placed column: its mask, trigger, the group whose frame repeats it, and its conditional formats in order."""

    name: str
    source: str
    mask: str = ""
    trigger: str = ""
    visible: bool = True
    group: str = ""
    formats: tuple[tuple[str, tuple[tuple[str, str], ...]], ...] = ()


@dataclass(frozen=True)
class Dataset:
    name: str
    sql: str
    items: tuple[Item, ...] = ()
    groups: tuple[Group, ...] = ()


@dataclass(frozen=True)
class ReportDef:
    name: str
    params: tuple[Param, ...] = ()
    datasets: tuple[Dataset, ...] = ()
    links: tuple[Link, ...] = ()
    formulas: tuple[Formula, ...] = ()
    summaries: tuple[Summary, ...] = ()
    matrices: tuple[Matrix, ...] = ()
    charts: tuple[Chart, ...] = ()
    triggers: tuple[Trigger, ...] = ()
    fields: tuple[Field, ...] = ()
    max_records: int = 0
    notes: tuple[str, ...] = field(default=())
    texts: tuple[tuple[str, str], ...] = ()
    layout: str = ""

    def dataset(self, name: str) -> Dataset:
        for d in self.datasets:
            if d.name.upper() == name.upper():
                return d
        raise UnresolvedReference(f"no dataset {name}")

    def level(self, reset: str) -> tuple[str, ...]:
        """The keys of a summary's scope: all break columns down to the group it resets at."""
        if reset.lower() in ("report", "page", ""):
            return ()
        for d in self.datasets:
            keys: tuple[str, ...] = ()
            for g in d.groups:
                keys += g.columns[:1]
                if g.name.upper() == reset.upper():
                    return keys
        raise UnresolvedReference(f"no group {reset}")

    def owner(self, group: str) -> str:
        """The dataset of a group, '' if there is none."""
        return next((d.name for d in self.datasets for g in d.groups if g.name.upper() == group.upper()), "")

    def shape(self) -> str:
        """How the body repeats: matrix, chart, labels, form (a page a record), grouped, master-detail or table."""
        if self.matrices:
            return "matrix"
        if self.charts and not self.fields:
            return "chart"
        if self.layout in ("labels", "form"):
            return self.layout
        if len(self.datasets) > 1 and self.links:
            return "master-detail"
        return "grouped" if self.datasets and len(self.main().groups) > 1 else "table"

    def main(self) -> Dataset:
        """The dataset the report repeats: a linked parent if there is one, else the one with most columns and groups."""
        if not self.datasets:
            raise UnresolvedReference("the report has no dataset")
        children = {link.child.upper() for link in self.links}
        parents = {link.parent.upper() for link in self.links}
        roots = [d for d in self.datasets if d.name.upper() not in children]
        pool = [d for d in roots if d.name.upper() in parents] or roots or list(self.datasets)
        return max(pool, key=lambda d: (len(d.groups), len(d.items), -self.datasets.index(d)))
