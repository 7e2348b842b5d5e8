"""CONNECT BY queries as frontier joins: LEVEL, PRIOR, CONNECT_BY_ROOT, _ISLEAF, _ISCYCLE, SYS_CONNECT_BY_PATH, NOCYCLE, ORDER SIBLINGS BY."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.operators import hierarchy
from bandwright.plans import lex
from bandwright.plans.dialect import Dialect, Unsupported
from bandwright.plans.lex import Group, Token, is_word

Run = Callable[[str], DataFrame]


def is_hierarchy(text: str) -> bool:
    """Whether a statement's outermost block is a CONNECT BY query over one row source."""
    items = lex.tree(lex.tokens(lex.statement(text)))
    return bool(items) and is_word(items[0], "SELECT") and any(is_word(t, "CONNECT") for t in items) and not any(is_word(t, "UNION", "INTERSECT", "MINUS", "EXCEPT") for t in items)


class _Select:
    """The pseudo columns of the outer clauses, as columns of the walked rows."""

    def __init__(self) -> None:
        self.paths: list[tuple[list, str]] = []
        self.root = self.prior = self.leaf = self.cycle = False

    def rewritten(self, items: list, top: bool = True) -> list:
        out, i = [], 0
        while i < len(items):
            t = items[i]
            if is_word(t, "SYS_CONNECT_BY_PATH"):
                value, separator = lex.split(items[i + 1].items, ",")
                self.paths.append((value, separator[0].text))
                out.append(Token("word", f"_path_{len(self.paths) - 1}"))
                i += 1
            elif is_word(t, "CONNECT_BY_ROOT", "PRIOR"):
                self.root |= t.upper == "CONNECT_BY_ROOT"
                self.prior |= t.upper == "PRIOR"
                name = items[i + 1 :][:3]
                column = name[2] if len(name) == 3 and getattr(name[1], "text", "") == "." else name[0]
                i += 3 if column is not name[0] else 1
                out.append(Token("word", f"{'_root' if t.upper == 'CONNECT_BY_ROOT' else '_prior'}.{column.text}"))
                if top and (i + 1 == len(items) or getattr(items[i + 1], "text", "") == ","):
                    out += [Token("word", "AS"), Token("word", column.text)]
            elif is_word(t, "LEVEL", "CONNECT_BY_ISLEAF", "CONNECT_BY_ISCYCLE"):
                self.leaf |= t.upper == "CONNECT_BY_ISLEAF"
                self.cycle |= t.upper == "CONNECT_BY_ISCYCLE"
                out.append(Token("word", f"_{t.upper.lower()}"))
                if top and (not out[:-1] or getattr(out[-2], "text", "") == ",") and (i + 1 == len(items) or getattr(items[i + 1], "text", "") == ","):
                    out += [Token("word", "AS"), Token("word", t.upper.lower())]
            elif isinstance(t, Group):
                out.append(Group(self.rewritten(t.items, False)))
            else:
                out.append(t)
            i += 1
        return out


def run(spark: SparkSession, text: str, dialect: Dialect, execute: Run, value: Callable[[str], object]) -> DataFrame:
    """The rows of a CONNECT BY query. ``execute`` runs source text, ``value`` gives a bind's value."""
    parts = dialect._clauses(lex.tree(lex.tokens(lex.statement(text))))
    source = parts["FROM"]
    if any(getattr(t, "text", "") == "," or is_word(t, "JOIN") for t in source):
        raise Unsupported("CONNECT BY over more than one table: make it a derived table")
    table = execute(f"SELECT * FROM {lex.text_of(source)}")
    alias = source[-1].upper if len(source) > 1 else source[0].upper if isinstance(source[0], Token) else ""
    nocycle = any(is_word(t, "NOCYCLE") for t in parts["CONNECT"])
    tied, most = [], None
    for part in dialect._between(lex.split([t for t in parts["CONNECT"] if not is_word(t, "NOCYCLE")], "AND")):
        if any(is_word(t, "LEVEL") for t in part):
            op, n = (part[1].text, part[2]) if len(part) == 3 and is_word(part[0], "LEVEL") else ("", None)
            if op not in ("<", "<="):
                raise Unsupported(f"CONNECT BY {lex.text_of(part)}")
            n = int(value(n.text[1:]) if n.kind == "bind" else n.text) - (op == "<")
            most = n if most is None else min(most, n)
        else:
            tied.append(_sided(part, alias))
    if not tied:
        raise Unsupported("CONNECT BY without a condition on PRIOR")
    plain = Dialect(types=dialect.types, registry=dialect.registry, now=dialect.now, resolve=lambda name: _literal(value(name)))
    condition = F.expr(" AND ".join(plain.expression(p) for p in tied))
    start = F.expr(plain.expression(_unaliased(parts["START"], alias))) if "START" in parts else F.lit(True)
    picked = _Select()
    select, where, order = (picked.rewritten(_unaliased(parts.get(k, []), alias), k == "SELECT") for k in ("SELECT", "WHERE", "ORDER"))
    columns, walked = table.columns, None
    if not (nocycle or picked.cycle or picked.paths or "SIBLINGS" in parts):  # no way is shown or looked at
        walked = hierarchy.one_way(table, start, condition, most, picked.root, picked.prior, picked.leaf)
    if walked is not None:
        made = [F.col(f"row.{c}").alias(c) for c in columns] + [F.col("level").alias("_level")]
        made += [F.col(name).alias(alias) for name, alias, is_used in (("is_leaf", "_connect_by_isleaf", picked.leaf), ("root", "_root", picked.root), ("prior", "_prior", picked.prior)) if is_used]
    else:
        walked, made = _with_ways(table, start, condition, nocycle, most, picked, parts, plain, alias)
    view = f"bandwright_{uuid.uuid4().hex}"
    walked.select(*made).createOrReplaceTempView(view)
    try:
        tail = f" WHERE {lex.text_of(where)}" if where else ""
        tail += " ORDER BY _place" if "SIBLINGS" in parts else f" ORDER BY {lex.text_of(order)}" if order else ""
        return execute(f"SELECT {lex.text_of(select)} FROM {view}{tail}")
    finally:
        spark.catalog.dropTempView(view)


def _with_ways(table: DataFrame, start: Column, condition: Column, nocycle: bool, most: int | None, picked: _Select, parts: dict[str, list], plain: Dialect, alias: str) -> tuple[DataFrame, list[Column]]:
    """The rows with their ways, and the columns that the query's outer clauses see."""
    columns = table.columns
    fields = {f"s{k}": F.coalesce(F.expr(plain.expression(v)).cast("string"), F.lit("")) for k, (v, _) in enumerate(picked.paths)}
    if "SIBLINGS" in parts:
        table = hierarchy.siblings(table, _order(plain, _unaliased(parts["SIBLINGS"], alias)), "_place")
        fields["place"] = F.col("_place")
    if picked.root or picked.prior:
        fields["whole"] = F.struct(*columns)
    walked = hierarchy.connect_by(table, start, condition, nocycle, fields, most)
    walked = hierarchy.leaves(walked) if picked.leaf else walked
    walked = hierarchy.cycles(walked, table, condition) if picked.cycle else walked
    made = [F.col(f"row.{c}").alias(c) for c in columns] + [F.size("trail").alias("_level")]
    made += [F.col("is_leaf").alias("_connect_by_isleaf")] if picked.leaf else []
    made += [F.col("is_cycle").alias("_connect_by_iscycle")] if picked.cycle else []
    for k, (_, separator) in enumerate(picked.paths):
        made.append(F.concat(F.expr(separator), F.array_join(F.col("trail").getField(f"s{k}"), separator[1:-1])).alias(f"_path_{k}"))
    if picked.root or picked.prior:
        whole = F.col("trail").getField("whole")
        made += [F.element_at(whole, 1).alias("_root"), F.when(F.size("trail") > 1, F.element_at(whole, F.greatest(F.size("trail") - 1, F.lit(1)))).alias("_prior")]
    if "SIBLINGS" in parts:
        made.append(F.col("trail").getField("place").alias("_place"))
    return walked, made


def _literal(value: object) -> str:
    from bandwright.functions import masks

    return "NULL" if value is None else str(value) if isinstance(value, (int, float)) else masks.quote(str(value))


def _unaliased(items: list, alias: str) -> list:
    """Items without the table's name before its columns."""
    out, i = [], 0
    while i < len(items):
        t = items[i]
        if getattr(t, "kind", "") == "word" and t.upper == alias and i + 1 < len(items) and getattr(items[i + 1], "text", "") == ".":
            i += 2
            continue
        out.append(Group(_unaliased(t.items, alias)) if isinstance(t, Group) else t)
        i += 1
    return out


def _sided(items: list, alias: str) -> list:
    """A condition with PRIOR columns as those of p and the others as those of c."""
    out, side = [], "c"
    items = _unaliased(items, alias)
    for i, t in enumerate(items):
        follows = items[i + 1] if i + 1 < len(items) else None
        if is_word(t, "PRIOR"):
            side = "p"
        elif isinstance(t, Group):
            out.append(Group(_sided(t.items, alias)))
        elif getattr(t, "kind", "") in ("word", "quoted") and not isinstance(follows, Group) and not is_word(t, "AND", "OR", "NOT", "IS", "NULL", "LIKE", "IN", "BETWEEN", "CASE", "WHEN", "THEN", "ELSE", "END"):
            out.append(Token("word", f"{side}.{t.text}"))
            side = "c"
        else:
            out.append(t)
    return out


def _order(plain: Dialect, items: list) -> list:
    """The columns of ORDER SIBLINGS BY, nulls last when ascending and first when descending."""
    out = []
    for part in lex.split(items, ","):
        down = is_word(part[-1], "DESC")
        value = F.expr(plain.expression(part[:-1] if is_word(part[-1], "ASC", "DESC") else part))
        out.append(value.desc_nulls_first() if down else value.asc_nulls_last())
    return out
