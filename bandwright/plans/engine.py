"""A report definition and its tables as DataFrames: one lazy plan for each part of the report."""

from __future__ import annotations

import graphlib
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.functions import masks
from bandwright.functions.registry import Registry, standard
from bandwright.operators import breaks, drill, links, matrix, present
from bandwright.plans import binds, connect, detail, lex, plsql
from bandwright.plans.dialect import Dialect
from bandwright.plans.lex import Token
from bandwright.plans.model import Dataset, Formula, ReportDef, Summary

MATRIX_VALUES = 1000


@dataclass
class Result:
    """datasets: rows by dataset; main: the repeated rows; order: their break order; the rest by name."""

    main: DataFrame
    datasets: dict[str, DataFrame]
    breaks: DataFrame | None = None
    totals: dict[str, DataFrame] = field(default_factory=dict)
    matrices: dict[str, DataFrame] = field(default_factory=dict)
    charts: dict[str, DataFrame] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)
    order: list[Column] = field(default_factory=list)


def _types(report: ReportDef) -> dict[str, str]:
    out = {i.name.lower(): i.kind for d in report.datasets for i in d.items}
    return out | {p.name.lower(): "date" if p.is_date else "number" if p.datatype == "number" else "string" for p in report.params}


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, (int, float)) else masks.quote(str(value))


def _link_keys(d: Dataset, report: ReportDef) -> dict[str, str]:
    """Child column by parent column of the links into a dataset."""
    return {p.upper(): c for link in report.links if link.child.upper() == d.name.upper() for p, c in link.pairs}


def without_link(d: Dataset, report: ReportDef) -> str:
    """The dataset's SQL without the predicates that tie it to a parent row: they become the join."""
    keys = _link_keys(d, report)
    if not keys:
        return d.sql
    flat = lex.tokens(d.sql)
    out: list[Token] = []
    at = 0
    for start, end, _, _ in detail.conjuncts(flat, set(keys)):
        out += [*flat[at:start], Token("number", "1"), Token("op", "="), Token("number", "1")]
        at = end
    return lex.text_of(out + flat[at:])


SET_WORDS = ("UNION", "INTERSECT", "MINUS", "EXCEPT")


def with_keys(d: Dataset, report: ReportDef) -> str:
    """The dataset's SQL with the join columns of its link predicates among its columns, in every branch of a set operation.

    A branch that groups gets them as keys of its groups, one that only
    aggregates becomes a group for each key; a branch without the predicate
    gets NULL. A branch with ROLLUP or CUBE stays as it is.
    """
    keys = _link_keys(d, report)
    branches: list[list[Token]] = [[]]
    between: list[list[Token]] = []
    depth = 0
    for t in lex.tokens(d.sql):
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and lex.is_word(t, *SET_WORDS):
            between.append([t])
            branches.append([])
        elif between and not branches[-1] and lex.is_word(t, "ALL"):
            between[-1].append(t)
        else:
            branches[-1].append(t)
    found = [{column.rpartition(".")[2].upper(): column for _, _, _, column in detail.conjuncts(b, set(keys))} for b in branches]
    have = {c.upper() for c in _selected(branches[0])}
    missing = [c for c in dict.fromkeys(k.upper() for k in keys.values()) if c not in have and "*" not in have and any(c in f for f in found)]
    if not missing or any(lex.is_word(t, "ROLLUP", "CUBE", "SETS") for b in branches for t in b):
        return d.sql
    out: list[Token] = []
    for k, branch in enumerate(branches):
        out += [*(between[k - 1] if k else []), *_with_columns(branch, [(found[k].get(c), c) for c in missing])]
    return lex.text_of(out)


def _top(flat: list[Token], *words: str) -> int | None:
    """Where the first of some words stands outside of parentheses."""
    depth = 0
    for i, t in enumerate(flat):
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and lex.is_word(t, *words):
            return i
    return None


def _selected(branch: list[Token]) -> list[str]:
    """The names of the columns that a SELECT gives."""
    source = _top(branch, "FROM")
    parts = lex.split(lex.tree(branch[: source if source is not None else len(branch)])[1:], ",")
    return [p[-1].text.strip('"') for p in parts if p and hasattr(p[-1], "text")]


def _with_columns(branch: list[Token], columns: list[tuple[str | None, str]]) -> list[Token]:
    source = _top(branch, "FROM")
    if source is None:
        return branch
    added = [x for expr, name in columns for x in (Token("op", ","), Token("word", expr or "NULL"), Token("word", "AS"), Token("word", name))]
    exprs = [expr for expr, _ in columns if expr]
    group, after = _top(branch, "GROUP"), _top(branch, "HAVING", "ORDER")
    end = after if after is not None else len(branch)
    listed = [x for e in exprs for x in (Token("op", ","), Token("word", e))]
    if group is not None and exprs:
        tail = [*branch[source:end], *listed, *branch[end:]]
    elif exprs and any(lex.is_word(t, *detail.AGGREGATES) and branch[i + 1].text == "(" for i, t in enumerate(branch[:source])):
        tail = [*branch[source:end], Token("word", "GROUP"), Token("word", "BY"), *listed[1:], *branch[end:]]
    else:
        tail = branch[source:]
    return [*branch[:source], *added, *tail]


class _Run:
    """One run of a report: its frames, deepest detail first, and notes on what could not be done."""

    def __init__(self, report: ReportDef, spark: SparkSession, registry: Registry, lexicals: dict[str, str], now: str, values: dict[str, object], sources: dict[str, DataFrame] | None = None):
        self.report, self.spark, self.lexicals = report, spark, lexicals
        self.types, self.notes = _types(report), list(report.notes)
        self.known = {p.name.upper(): values.get(p.name, values.get(p.name.lower(), p.default)) for p in report.params}
        self.given = self.known | {k.upper(): v for k, v in values.items()}
        self.options = {"types": self.types, "registry": registry, "now": now}
        self.frames: dict[str, DataFrame] = {}
        self.sources = {k.upper(): v for k, v in (sources or {}).items()}
        self.lateral: dict[str, tuple[tuple[str, str], ...]] = {}  # by detail: (parent column, key column)
        self.spanned: dict[str, tuple[DataFrame, DataFrame, detail.Interval]] = {}  # by detail: its parent's keys, its rows, their intervals
        self.waiting: dict[str, list[Formula]] = {}
        self.broken: set[str] = set()
        main = report.main().name if report.datasets else ""
        homes = {d.name for d in report.datasets if d.sql or d.name.upper() in self.sources}
        for f in report.formulas:
            self.waiting.setdefault(f.dataset if f.dataset in homes else main, []).append(f)

    def sql(self, text: str, around: str = "{}", **options: object) -> DataFrame:
        dialect = Dialect(**options, **self.options)
        if around == "{}" and connect.is_hierarchy(text):
            return connect.run(self.spark, text, dialect, lambda t: self.sql(t, **options), lambda name: self.given.get(name.upper()))
        sql = around.format(dialect.query(text))
        self.notes += dialect.notes
        return self.spark.sql(sql, args=binds.arguments(sql, self.given, self.report.params))

    def names(self, df: DataFrame) -> Callable[[str], str]:
        columns = {c.upper(): c for c in df.columns}

        def resolve(name: str) -> str:
            key = name.upper()
            if key in columns:
                return f"`{columns[key]}`"
            if key in self.known:
                return _literal(self.known[key])
            raise plsql.UntranslatableFormula(f"{name} is neither a column nor a parameter")

        return resolve

    def load(self, d: Dataset, parent: str = "") -> None:
        """The rows of a dataset; of a detail, with what ties them to the rows of ``parent``."""
        if d.name.upper() in self.sources:  # rows that come from elsewhere than SQL
            self.frames[d.name] = self.sources[d.name.upper()]
            return
        if not d.sql:
            self.notes.append(f"{d.name}: no SQL")
            return
        link = next((k for k in self.report.links if k.child.upper() == d.name.upper() and k.parent.upper() == parent.upper()), None)
        if link is None:
            self.frames[d.name] = self.sql(d.sql, lexicals=self.lexicals)
            return
        above = {c.upper(): c for c in self.frames[parent].columns}
        used = [b for b in lex.binds(d.sql) if b in above and (b in _link_keys(d, self.report) or b not in self.given)]
        unseen = [b for b in lex.binds(d.sql) if b in {p.upper() for p, _ in link.pairs} and b not in above and b not in self.given]
        self.notes += [f"{d.name}: {parent} has no column {b}, its rows are not tied to their parent" for b in unseen]
        declared = [(p, c) for p, c in link.pairs if c and p.upper() in above]
        limited = detail.is_limited(lex.tokens(d.sql))
        if detail.is_plain(d.sql, set(used)) and all(c for _, c in link.pairs) or not (used or limited and declared):
            self.frames[d.name] = self.sql(without_link(replace(d, sql=with_keys(d, self.report)), self.report), lexicals=self.lexicals)
            return
        text = d.sql
        if not used:  # a declared link is one more predicate of the detail
            text, used = detail.with_predicates(d.sql, declared), [p.upper() for p, _ in declared]
        keys = self.frames[parent].select(*(F.col(above[k]).alias(detail.key_column(k)) for k in used)).distinct()
        frame, spans = None, detail.interval(text, used[0]) if len(used) == 1 else None
        if spans is not None:  # no equality: bins make one
            rows = self.sql(spans.sql, lexicals=self.lexicals).dropna(subset=list(spans.bounded)) if spans.bounded else self.sql(spans.sql, lexicals=self.lexicals)
            frame = links.interval_join(keys, rows, detail.key_column(used[0]), spans.low, spans.high, high_is_open=spans.is_open).drop(spans.low, spans.high)
            self.spanned[d.name.upper()] = (keys, rows, spans)
        for null, branch in detail.optional_filters(text, set(used)) if frame is None else ():
            some = keys
            for k, is_null in null.items():
                key = F.col(detail.key_column(k))
                some = some.where(key.isNull() if is_null else key.isNotNull())
            part = self.for_each(some, branch, set(used))
            frame = part if frame is None else frame.unionByName(part)
        self.frames[d.name] = frame
        self.lateral[d.name.upper()] = tuple((above[k], detail.key_column(k)) for k in used)

    def for_each(self, keys: DataFrame, text: str, used: set[str]) -> DataFrame:
        """The rows of a detail for each row of its parent's keys, with these keys."""
        view = f"bandwright_{uuid.uuid4().hex}"
        keys.createOrReplaceTempView(view)
        try:
            return self.sql(detail.lateral(text, used), lexicals=self.lexicals, around=f"SELECT {detail.KEYS}.*, bw_x.* FROM {view} {detail.KEYS} JOIN LATERAL ({{}}) bw_x", nested=True)
        finally:
            self.spark.catalog.dropTempView(view)

    def fetched(self, df: DataFrame, name: str, body: str) -> DataFrame:
        """``df`` with the value of a cursor formula, as a correlated subquery that Spark makes a join."""
        columns = {c.upper(): c for c in df.columns}
        flat = [Token("word", f"O.{columns[t.text[1:].upper()]}") if t.kind == "bind" and t.text[1:].upper() in columns else t for t in lex.tokens(plsql.single_fetch(body))]
        unknown = [t.text for t in flat if t.kind == "bind" and t.text[1:].upper() not in self.given]
        if unknown:
            raise plsql.UntranslatableFormula(f"{', '.join(unknown)}: neither a column nor a parameter")
        view = f"bandwright_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view)
        try:
            return self.sql(f"SELECT O.*, ({lex.text_of(flat)}) AS {name} FROM {view} O")
        finally:
            self.spark.catalog.dropTempView(view)

    # ---- the order of evaluation
    def evaluate(self, name: str, parent: str = "", above: tuple[str, ...] = ()) -> None:
        """A dataset's rows, the formulas that need no detail, its details, then all that is made from these."""
        d = self.report.dataset(name)
        self.load(d, parent)
        if d.name not in self.frames:
            return
        self.settle(d.name, early=True)
        for link in self.report.links:
            if link.parent.upper() == d.name.upper() and link.child.upper() not in {x.upper() for x in (d.name, *above)}:
                child = self.report.dataset(link.child).name
                if child not in self.frames:
                    self.evaluate(child, d.name, (*above, d.name))
                if child in self.frames:
                    self.attach(d.name, child, link.pairs)
        self.settle(d.name, early=False)

    def needs(self, f: Formula) -> set[str]:
        """The names that a formula reads, but for the placeholders that it sets itself."""
        flat = lex.tokens(f.body)
        read = {t.text[1:].upper() for t in flat if t.kind == "bind"}
        return read - self.sets(f) - {f.name.upper()} | ({f.name.upper()} if self._reads_itself(f, flat) else set())

    @staticmethod
    def _reads_itself(f: Formula, flat: list[Token]) -> bool:
        return any(t.kind == "bind" and t.text[1:].upper() == f.name.upper() and (i + 1 == len(flat) or flat[i + 1].text != ":=") for i, t in enumerate(flat))

    @staticmethod
    def sets(f: Formula) -> set[str]:
        flat = lex.tokens(f.body)
        return {t.text[1:].upper() for t, n in zip(flat, flat[1:], strict=False) if t.kind == "bind" and n.text == ":="}

    def settle(self, name: str, early: bool) -> None:
        """Computes what waits for a dataset's columns, in the order of who needs whom.

        The graph has the formulas, the placeholders that they set and the
        summaries of the dataset's own rows; a summary is brought to the rows
        only for a formula that reads it. Early, what needs a detail goes on
        waiting; later it is noted and NULL, and so are cycles.
        """
        waiting = self.waiting.get(name, [])
        by_name = {f.name.upper(): f for f in waiting} | {p: f for f in waiting for p in self.sets(f)}
        own = {s.name.upper(): s for s in self.report.summaries}
        graph: dict[str, set[str]] = {f.name.upper(): self.needs(f) for f in waiting}
        graph |= {p: {f.name.upper()} for f in waiting for p in self.sets(f)}
        for s in self.report.summaries:
            graph.setdefault(s.name.upper(), {s.source.upper()})
        while True:
            try:
                order = list(graphlib.TopologicalSorter(graph).static_order())
                break
            except graphlib.CycleError as e:
                cycle = e.args[1]
                self.notes.append(f"{' needs '.join(reversed(cycle))}: a cycle, all of them are NULL")
                self.broken |= set(cycle)
                for c in cycle:
                    graph[c] = set()
        done: set[str] = set()
        for node in order:
            columns = {c.upper() for c in self.frames[name].columns}
            f = by_name.get(node)
            if f is not None and f.name.upper() == node and f not in done:
                missing = {n for n in self.needs(f) if n not in columns and n not in self.given}
                for n in list(missing):
                    s = own.get(n)
                    if s is not None and self.bring(name, s):
                        missing.discard(n)
                if early and (missing or node in self.broken):
                    continue
                self.compute(name, f)
                done.add(f)
        self.waiting[name] = [f for f in waiting if f not in done]

    def bring(self, name: str, s: Summary) -> bool:
        """Gives each row of a dataset the value that a summary over these rows has at its level."""
        df = self.frames[name]
        columns = {c.upper(): c for c in df.columns}
        groups = {g.name.upper() for g in self.report.dataset(name).groups}
        if s.function.lower() in breaks.PERCENT or s.reset.lower() not in ("report", "page", "") and s.reset.upper() not in groups:
            return False
        inner = next((x for x in self.report.summaries if x.name.upper() == s.source.upper() and x is not s), None)
        if s.source.upper() not in columns and inner is None:
            return False
        order = F.struct(*self.ordered(df, self.report.dataset(name))) if s.function.lower() in ("first", "last") else None
        try:
            total = self.total(df, s, order)
        except (ValueError, KeyError, RecursionError):
            return False
        keys = [columns[k.upper()] for k in self.report.level(s.reset) if k.upper() in columns]
        self.frames[name] = breaks.brought(df, total, keys)
        return True

    def compute(self, name: str, f: Formula) -> None:
        df = self.frames[name]
        try:
            if f.name.upper() in self.broken:
                raise plsql.UntranslatableFormula("part of a cycle")
            if any(lex.is_word(t, "CURSOR") for t in lex.tokens(f.body)):
                df = self.fetched(df, f.name, f.body)
            else:
                done = plsql.Compiler(Dialect(**self.options), self.names(df)).compile(f.body)
                for placeholder, value in done.placeholders.items():
                    df = df.withColumn(placeholder, F.expr(value))
                df = df.withColumn(f.name, F.expr(done.value or "NULL"))
        except plsql.UntranslatableFormula as e:
            self.notes.append(f"{f.name}: {e}")
            df = df.withColumn(f.name, F.lit(None).cast("string"))
        self.frames[name] = df

    def ordered(self, df: DataFrame, d: Dataset) -> list[str]:
        """Columns that fix the order of a dataset's rows: those of its ORDER BY that it has, then all others."""
        columns = {c.upper(): c for c in df.columns}
        flat = lex.tokens(d.sql)
        at = _top(flat, "ORDER")
        named = [columns[p[-1].upper] for p in lex.split(lex.tree(flat[at + 2 :]), ",") if p and getattr(p[-1], "upper", "") in columns] if at is not None else []
        return list(dict.fromkeys([*named, *df.columns]))

    def attach(self, parent: str, name: str, declared: Iterable[tuple[str, str]]) -> None:
        """Adds to a dataset what its rows show of one detail: all of it from one aggregation and one join."""
        child, d = self.frames[name], self.report.dataset(name)
        tied = self.lateral.get(name.upper())
        pairs = list(tied or declared)
        if not pairs:
            self.notes.append(f"{parent} to {name}: no columns to join on")
            return
        gone = [c for _, c in pairs if c.upper() not in {x.upper() for x in child.columns}]
        if gone:
            self.notes.append(f"{parent} to {name}: {name} has no column {', '.join(gone) or 'for it'}")
            return
        order = self.ordered(child.drop(*(c for _, c in tied or ())), d)
        own = {c.lower() for c in self.frames[parent].columns}
        theirs = {c.lower(): c for c in child.columns}
        n = f"n_{name.lower()}"
        aggregates, shown = {n: F.count("*")}, {n: F.coalesce(F.col(f"_v_{n}"), F.lit(0))}
        summed = {n: ("count", "")}
        for s in self.report.summaries:
            if s.source.lower() in theirs and s.source.lower() not in own and s.name.lower() not in own and s.function.lower() not in breaks.PERCENT:
                by = F.struct(*order) if s.function.lower() in ("first", "last") else None
                aggregates[s.name] = breaks.aggregate(s.function, F.col(s.source), by)
                shown[s.name] = F.col(f"_v_{s.name}")
                summed[s.name] = (s.function.lower(), theirs[s.source.lower()])
        placed = {f.source.lower(): f for f in self.report.fields if f.source.lower() in theirs and f.source.lower() not in own}
        read = {b.lower() for f in self.waiting.get(parent, []) for b in self.needs(f)}
        lists = [theirs[c] for c, f in placed.items() if f.group and self.report.owner(f.group).upper() == name.upper()]
        firsts = [theirs[c] for c in theirs if c not in own and theirs[c] not in lists and theirs[c] not in shown and (c in placed or c in read) and not c.startswith("_link_")]
        if firsts:
            aggregates["first"] = F.min(F.struct(*order, *(c for c in firsts if c not in order)))
            shown |= {c: F.col(f"_v_first.{c}") for c in firsts}
        if lists:
            aggregates["rows"] = F.array_sort(F.collect_list(F.struct(*order, *(F.col(c).cast("string").alias(f"_t{i}") for i, c in enumerate(lists)))))
            shown |= {c: F.nullif(F.array_join(F.col("_v_rows").getField(f"_t{i}"), "\n"), F.lit("")) for i, c in enumerate(lists)}
        totals = None if firsts or lists else self.span_totals(name, summed)
        if totals is not None:
            self.frames[parent] = links.shows(self.frames[parent], totals, pairs, shown, null_safe=True)
        else:
            self.frames[parent] = links.merged(self.frames[parent], child, pairs, aggregates, shown, null_safe=tied is not None)

    def span_totals(self, name: str, summed: dict[str, tuple[str, str]]) -> DataFrame | None:
        """Counts and sums of a detail's rows whose interval holds a key, by key and without pairs; None where only the pairs tell them."""
        if name.upper() not in self.spanned:
            return None
        keys, rows, spans = self.spanned[name.upper()]
        at = keys.columns[0]
        kinds = dict(rows.dtypes)
        computed = {x.upper() for f in self.report.formulas for x in (f.name, *self.sets(f))}
        columns = list(dict.fromkeys(c for _, c in summed.values() if c))
        exact = all(f == "count" or f == "sum" and c in kinds and links.adds_up(rows, c) for f, c in summed.values())
        alike = all(links.are_ordered_alike(dict(keys.dtypes)[at], kinds[bound]) for bound in (spans.low, spans.high)) and links.are_ordered_alike(kinds[spans.low], kinds[spans.high])
        if not exact or not alike or any(c not in kinds or c.upper() in computed for c in columns):
            return None
        made = {"": "_n"} | {c: {"count": f"_count{i}", "sum": f"_sum{i}"} for i, c in enumerate(columns)}
        totals = links.totals_at_points(keys, rows, at, spans.low, spans.high, columns, high_is_open=spans.is_open)
        return totals.select(at, *(F.col(made[c][f] if c else made[c]).alias(f"_v_{n}") for n, (f, c) in summed.items()))

    def summaries(self, out: Result, d: Dataset) -> None:
        main = out.main
        have = {c.lower() for c in main.columns}
        keys = [g.columns[0] for g in d.groups[:-1]]
        own = [s for s in self.report.summaries if s.source.lower() in have]
        made = {s.name.lower() for s in own}
        while more := [s for s in self.report.summaries if s not in own and s.source.lower() in made]:  # summaries of summaries
            own += more
            made |= {s.name.lower() for s in more}
        order = F.struct(*self.ordered(main, d)) if any(s.function.lower() in ("first", "last") for s in own) else None
        if any(lex.is_word(t, "ROLLUP", "CUBE", "SETS") for t in lex.tokens(d.sql)):
            self.notes.append(f"{d.name}: has subtotal rows of its own, none are added")
        elif own:
            plain = [s for s in own if s.source.lower() in have and s.function.lower() in breaks.FUNCTIONS or s.function.lower() in ("first", "last")]
            if keys and plain:
                out.breaks = breaks.levels(main, keys, [breaks.aggregate(s.function, F.col(s.source), order).alias(s.name) for s in plain])
            for s in own:
                try:
                    out.totals[s.name] = self.total(main, s, order)
                except (ValueError, KeyError) as e:
                    self.notes.append(f"{s.name}: {e}")
        self.notes += [f"{s.name}: nothing to sum for {s.source}" for s in self.report.summaries if s not in own and s.name not in main.columns and not any(s.name in f.columns for f in self.frames.values())]

    def total(self, main: DataFrame, s: Summary, order: Column | None) -> DataFrame:
        level = self.report.level(s.reset)
        inner = next((x for x in self.report.summaries if x.name.lower() == s.source.lower() and x is not s), None)
        if s.source.lower() not in {c.lower() for c in main.columns} and inner is not None:
            below = self.report.level(inner.reset)
            if len(level) >= len(below) and below[: len(level)] != level or not set(level) <= set(below):
                raise ValueError(f"its level is not above that of {inner.name}")
            main = self.total(main, inner, order)
            if s.function.lower() in ("first", "last"):
                order = F.struct(*(F.col(k) for k in below))
        if s.function.lower() in breaks.PERCENT:
            return breaks.percent(main, s.source, level, self.report.level(s.compute), s.name)
        return breaks.summary(main, s.function, s.source, level, s.name, order)

    def matrices(self, out: Result) -> None:
        have = {c.lower() for c in out.main.columns}
        for m in self.report.matrices:
            gone = [c for c in (*m.band, *m.rows, *m.across, *(c for c, _ in m.measures)) if c.lower() not in have]
            if gone:
                self.notes.append(f"{m.name}: no column {', '.join(gone)}")
                continue
            values = [(v,) for v in m.values]
            if not values:  # the columns of a matrix are data: one small query finds them
                across = [F.col(c) for c in m.across]
                found = [tuple(r) for r in out.main.select(*across).distinct().orderBy(*(c.asc_nulls_last() for c in across)).limit(MATRIX_VALUES + 1).collect()]
                if len(found) > MATRIX_VALUES:
                    self.notes.append(f"{m.name}: {', '.join(m.across)} have more than {MATRIX_VALUES} values, give those to show")
                    continue
                values = found
                self.notes.append(f"{m.name}: {len(values)} columns from the values of {', '.join(m.across)}")
            cells = [(c, f, f"{f} {c}") for c, f in m.measures]
            out.matrices[m.name] = matrix.crosstab(out.main, list(m.band) + list(m.rows), m.across, values, cells, margins=m.margins)

    def placed(self, out: Result) -> None:
        """What the layout shows: masked texts, visibility, styles, links and boilerplate."""
        bodies = {t.name.upper(): t.body for t in self.report.triggers}
        columns = {c.upper(): c for c in out.main.columns}
        names = self.names(out.main)
        for f in self.report.fields:
            column = columns.get(f.source.upper())
            if column and f.mask:
                typed = self.types.get(column.lower(), "")
                text = masks.date_text(f"`{column}`", f.mask) if masks.is_date_mask(f.mask) and typed != "number" else masks.number_text(f"`{column}`", f.mask)
                out.main = out.main.withColumn(f"{f.name}_text", F.expr(text))
            rules = []
            for label, style in f.formats:
                try:
                    out.main.select(present.condition(label))  # analysed, not run
                    rules.append((label, dict(style)))
                except Exception as e:
                    self.notes.append(f"{f.name}: {str(e).splitlines()[0]}")
            if rules:
                out.main = out.main.withColumn(f"_format_{f.name}", present.styled(rules))
            body = bodies.get(f.trigger.upper())
            if not body:
                continue
            link = plsql.hyperlink(body)
            if link:
                known = {p: columns[c.upper()] for p, c in link[1].items() if c.upper() in columns}
                out.main = out.main.withColumn(f"_link_{f.name}", drill.link(link[0], known))
            try:
                done = plsql.Compiler(Dialect(**self.options), names).compile(body)
                if done.value is not None:
                    out.main = out.main.withColumn(f"_visible_{f.name}", F.expr(f"coalesce({done.value}, TRUE)"))
                styles = {k: v for k, v in done.styles.items() if k not in ("hyperlink", "field_char")}
                if styles:
                    pairs = ", ".join(f"'{k}', cast({v} as string)" for k, v in sorted(styles.items()))
                    out.main = out.main.withColumn(f"_style_{f.name}", F.expr(f"map_filter(map({pairs}), (k, v) -> v is not null)"))
            except plsql.UntranslatableFormula as e:
                self.notes.append(f"{f.trigger}: {e}")
        for name, template in self.report.texts:
            out.main = out.main.withColumn(f"{name}_text", present.token_text(template, list(columns.values())))


def run(report: ReportDef, spark: SparkSession, registry: Registry | None = None, lexicals: dict[str, str] | None = None, now: str = "current_timestamp()", sources: dict[str, DataFrame] | None = None, **values: object) -> Result:
    """The report's data. Tables are views of the session; ``sources`` are the rows of datasets without SQL; ``values`` are the parameters."""
    at = _Run(report, spark, registry or standard(), lexicals or {}, now, values, sources)
    for p in report.params:
        value = at.known[p.name.upper()]
        if p.values and value is not None and str(value) not in p.values:
            at.notes.append(f"{p.name}: {value} is not in its list of values")
    main_set = report.main()
    children = {link.child.upper() for link in report.links}
    for d in (main_set, *report.datasets):
        if d.name not in at.frames and (d is main_set or d.name.upper() not in children):
            at.evaluate(d.name)
    for d in report.datasets:  # details of no evaluated parent
        if d.name not in at.frames:
            at.evaluate(d.name)
    out = Result(at.frames[main_set.name], at.frames, notes=at.notes)
    down = {i.name.upper() for i in main_set.items if i.break_order == "descending"}
    out.order = [F.col(c).desc_nulls_last() if c.upper() in down else F.col(c).asc_nulls_last() for c in dict.fromkeys([*(g.columns[0] for g in main_set.groups), *at.ordered(out.main, main_set)]) if c in out.main.columns or c.upper() in {x.upper() for x in out.main.columns}]
    at.summaries(out, main_set)
    at.matrices(out)
    for c in report.charts:
        series = matrix.chart(out.main, c.category, c.value)
        if series is None:
            at.notes.append(f"{c.name}: its columns are not in the data")
        else:
            out.charts[c.name] = series
    at.placed(out)
    return out


def pages(result: Result, report: ReportDef, order: list[str] | None = None) -> DataFrame:
    """The main rows with numbers and pages, in break order unless another is given."""
    numbered = present.numbered(result.main, order or result.order)
    return present.paged(numbered, report.max_records) if report.max_records else numbered
