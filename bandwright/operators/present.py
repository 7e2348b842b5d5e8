"""What the layout decides about data: bands, pages, tiles, visibility, styles and token text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Order = Sequence[Column | str]


_held: list[DataFrame] = []


def fixed(ordered: DataFrame) -> DataFrame:
    """A sorted frame with ``_p`` and ``_i``, the partition and the place of each row, that stays as it is.

    A range partitioning is sampled anew each time a plan runs; so the frame is
    checkpointed where the session has a folder for that, and persisted until
    ``let_go`` where it has none.
    """
    ordered = ordered.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    if ordered.sparkSession.sparkContext.getCheckpointDir():
        return ordered.checkpoint()
    _held.append(ordered.persist(StorageLevel.MEMORY_AND_DISK))
    return _held[-1]


def let_go() -> None:
    """Releases the frames that ``fixed`` persisted; results that use them are computed anew after that."""
    while _held:
        _held.pop().unpersist()


def numbered(df: DataFrame, order: Order, name: str = "row_no", within: Sequence[str] = ()) -> DataFrame:
    """Rows numbered from 1 in an order, of the report or of each group.

    A report-wide number is made from per-partition counts of a range-sorted
    frame, so no single task gets all rows.
    """
    if within:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
    ordered = fixed(df.orderBy(*order))
    first = ordered.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_f"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = ordered.join(F.broadcast(first.select("_p", "_f", "_before")), "_p")  # a row for each partition
    return joined.withColumn(name, (F.col("_i") - F.col("_f") + F.col("_before") + 1).cast("int")).drop("_p", "_i", "_f", "_before")


def with_totals(df: DataFrame, keys: Sequence[str], total: Column) -> DataFrame:
    """Each row with an aggregate of its group, NULL keys being a group too."""
    totals = df.groupBy(*(F.col(k).alias(f"_g{i}") for i, k in enumerate(keys))).agg(total)
    on = [df[k].eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
    return df.join(totals, on).drop(*(f"_g{i}" for i in range(len(keys))))


def banded(df: DataFrame, row_no: str = "row_no", name: str = "is_tinted") -> DataFrame:
    return df.withColumn(name, F.col(row_no) % 2 == 0)


def paged(df: DataFrame, per_page: int, row_no: str = "row_no", name: str = "page_no") -> DataFrame:
    return df.withColumn(name, (F.floor((F.col(row_no) - 1) / per_page) + 1).cast("int"))


def continued(df: DataFrame, group: Sequence[str], page: str = "page_no", name: str = "is_continued") -> DataFrame:
    """Whether a row's page is after the first page of its group; the first pages come from one aggregation, so a large group is no large task."""
    return with_totals(df, group, F.min(page).alias("_first")).withColumn(name, F.col(page) > F.col("_first")).drop("_first")


def print_on(df: DataFrame, rule: str, page: str = "page_no", last: str = "total_pages", name: str = "is_printed") -> DataFrame:
    """Page-scoped printing rules of an object."""
    tests = {"allpage": F.lit(True), "firstpage": F.col(page) == 1, "allbutfirstpage": F.col(page) > 1, "allbutlastpage": F.col(page) < F.col(last), "lastpage": F.col(page) == F.col(last)}
    return df.withColumn(name, tests[rule.lower()])


def tiled(df: DataFrame, columns: int, row_no: str = "row_no") -> DataFrame:
    """Labels across, then down."""
    at = F.col(row_no) - 1
    return df.withColumn("tile_column", (at % columns + 1).cast("int")).withColumn("tile_row", (F.floor(at / columns) + 1).cast("int"))


def token_text(template: str, columns: Sequence[str]) -> Column:
    """Boilerplate with &COLUMN or &<COLUMN> tokens as one text; unknown tokens stay as they are."""
    known = {c.lower(): c for c in columns}
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"&<?([A-Za-z_][\w$#]*)>?", template):
        column = known.get(m[1].lower())
        if column:
            parts += [F.lit(template[at : m.start()]), F.coalesce(F.col(column).cast("string"), F.lit(""))]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


_LABEL = re.compile(r"\s*(?:(?P<paren>[()])|(?P<word>AND|OR|NOT|LIKE|BETWEEN|IS|NULL)\b|(?P<op><=|>=|<>|!=|=|<|>)|(?P<text>'(?:[^']|'')*')|(?P<number>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][\w$#]*))", re.I)


class BadCondition(ValueError):
    """A condition label outside the grammar."""


def condition(label: str, numeric: Sequence[str] = ()) -> Column:
    """A conditional-format label as a boolean; unknown is false. Order comparisons read texts as numbers."""
    tokens: list[tuple[str, str]] = []
    at = 0
    while at < len(label.rstrip()):
        m = _LABEL.match(label, at)
        if not m:
            raise BadCondition(f"{label!r} at {at}")
        tokens.append((m.lastgroup, m[m.lastgroup].upper() if m.lastgroup == "word" else m[m.lastgroup]))
        at = m.end()

    def peek(k: int = 0) -> tuple[str, str]:
        return tokens[k] if len(tokens) > k else ("", "")

    def take(value: str | None = None) -> str:
        if not tokens or value is not None and tokens[0][1] != value:
            raise BadCondition(f"{label!r}: {value or 'more'} expected")
        return tokens.pop(0)[1]

    def value() -> tuple[Column, bool]:
        kind, text = tokens.pop(0) if tokens else ("", "")
        if kind == "text":
            return F.lit(text[1:-1].replace("''", "'")), False
        if kind == "number":
            return F.lit(float(text)), True
        if kind == "name":
            return F.col(text), False
        raise BadCondition(f"{label!r}: a value expected")

    def number(c: Column) -> Column:
        return c.try_cast("double")

    def compare() -> Column:
        if peek()[1] == "(":
            take("(")
            out = either()
            take(")")
            return out
        if peek()[1] == "NOT":
            take("NOT")
            return ~F.coalesce(compare(), F.lit(False))
        left, _ = value()
        negated = peek()[1] == "NOT"
        if negated:
            take("NOT")
        word = peek()[1]
        if word == "LIKE":
            take()
            pattern = take()
            out = left.cast("string").like(pattern[1:-1])
        elif word == "BETWEEN":
            take()
            low, _ = value()
            take("AND")
            high, _ = value()
            out = number(left).between(number(low), number(high))
        elif word == "IS":
            take()
            no = peek()[1] == "NOT"
            if no:
                take("NOT")
            take("NULL")
            return left.isNotNull() if no else left.isNull()
        else:
            op = take()
            right, is_number = value()
            a, b = (number(left), number(right)) if is_number or op in ("<", ">", "<=", ">=") else (left.cast("string"), right.cast("string"))
            out = {"=": a == b, "<>": a != b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
        return ~out if negated else out

    def both() -> Column:
        out = F.coalesce(compare(), F.lit(False))
        while peek()[1] == "AND":
            take()
            out = out & F.coalesce(compare(), F.lit(False))
        return out

    def either() -> Column:
        out = both()
        while peek()[1] == "OR":
            take()
            out = out | both()
        return out

    done = either()
    if tokens:
        raise BadCondition(f"{label!r}: {tokens[0][1]} left over")
    return done


def styled(rules: Sequence[tuple[str, dict[str, str]]]) -> Column:
    """Conditional formats in document order, first match wins: a map of style properties, or NULL."""
    out = F.lit(None).cast("map<string,string>")
    for label, style in reversed(rules):
        props = F.create_map(*[F.lit(x) for kv in sorted(style.items()) for x in kv])
        out = F.when(condition(label), props).otherwise(out)
    return out
