"""Checks of a definition and its translation, before and after it runs."""

from __future__ import annotations

import difflib
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from bandwright.plans import lex, plsql
from bandwright.plans.dialect import Dialect, Unsupported
from bandwright.plans.model import ReportDef

# Words of the source dialect that must not be left in translated SQL.
LEFTOVERS = "NVL DECODE SYSDATE SYSTIMESTAMP ROWNUM DUAL CONNECT PRIOR MINUS TO_CHAR TO_NUMBER ADD_MONTHS INSTR LENGTHB KEEP RATIO_TO_REPORT NVL2".split()
_RANK = ("READY", "AMBER", "RED", "BLOCKER")


def lint(sql: str) -> list[str]:
    """What is left of the source dialect in a statement."""
    flat = lex.tokens(sql)
    found = [t.upper for t in flat if t.kind == "word" and t.upper in LEFTOVERS and t.upper not in ("DECODE", "NVL2", "INSTR")]
    found += ["(+)" for t in flat if t.kind == "outer"] + [t.text for t in flat if t.kind == "lexical"]
    found += ["SELECT *" for a, b in zip(flat, flat[1:], strict=False) if a.upper == "SELECT" and b.text == "*"]
    found += [f"long name {t.text}" for t in flat if t.kind == "word" and len(t.text) > 128]
    return list(dict.fromkeys(found))


def audit(before: str, after: str) -> list[str]:
    """Functions and marks of a source statement that its translation no longer has."""
    kept = {t.upper for t in lex.tokens(after)}
    flat = lex.tokens(before)
    calls = [t.upper for t, n in zip(flat, flat[1:], strict=False) if t.kind == "word" and n.text == "("] + [t.upper for t in flat if t.kind == "word" and t.upper in ("SYSDATE", "ROWNUM", "DUAL", "MINUS")]
    return list(dict.fromkeys([c for c in calls if c not in kept and c.lower() not in {k.lower() for k in kept}] + ["(+)" for t in flat if t.kind == "outer"] + ["||" for t in flat if t.text == "||"]))


def complexity(report: ReportDef) -> int:
    """5 a query, 3 a formula, 10 a lexical reference, 2 an outer join."""
    lexicals = sum(len(lex.lexicals(d.sql)) for d in report.datasets)
    outer = sum(sum(t.kind == "outer" for t in lex.tokens(d.sql)) for d in report.datasets)
    return 5 * len(report.datasets) + 3 * len(report.formulas) + 10 * lexicals + 2 * outer


def coverage(report: ReportDef, output: Iterable[str]) -> list[str]:
    """Visible fields that the output lacks."""
    have = {c.lower() for c in output} | {p.name.lower() for p in report.params}
    return [f.source for f in report.fields if f.visible and f.source and f.source.lower() not in have]


def fidelity(report: ReportDef, output: Iterable[str]) -> float:
    """Kept parts of parameters, columns and placed fields, 0 to 1."""
    have = {c.lower() for c in output}
    columns = [i.name for d in report.datasets for i in d.items]
    fields = [f.source for f in report.fields if f.visible and f.source]
    kept = len(report.params) + sum(c.lower() in have for c in columns) + sum(f.lower() in have or f.upper() in {p.name.upper() for p in report.params} for f in fields)
    total = len(report.params) + len(columns) + len(fields)
    return round(kept / total, 4) if total else 1.0


def diff(old: ReportDef, new: ReportDef) -> list[tuple[str, str, str]]:
    """(part, name, added, removed or changed) of two definitions."""
    out = []
    for part, of in (("parameter", lambda r: {p.name: repr(p) for p in r.params}), ("query", lambda r: {d.name: d.sql for d in r.datasets}), ("formula", lambda r: {f.name: f.body for f in r.formulas})):
        a, b = of(old), of(new)
        for name in sorted(a.keys() | b.keys()):
            if a.get(name) != b.get(name):
                out.append((part, name, "added" if name not in a else "removed" if name not in b else "changed"))
    return out


def unified(old: str, new: str) -> str:
    return "\n".join(difflib.unified_diff(old.splitlines(), new.splitlines(), lineterm=""))


def drift(documented: Iterable[str], parsed: Iterable[str]) -> float:
    """The share of documented columns that a parsed query lacks; over 0.3 the two describe different queries."""
    want = {c.upper() for c in documented}
    return round(len(want - {c.upper() for c in parsed}) / len(want), 4) if want else 0.0


def preflight(report: ReportDef, spark: SparkSession | None = None) -> tuple[str, list[tuple[str, str]]]:
    """(verdict, findings). With a session, Spark's analyzer reads every translated statement."""
    findings: list[tuple[str, str]] = [("AMBER", n) for n in report.notes]
    if not report.datasets:
        findings.append(("BLOCKER", "no dataset"))
    for d in report.datasets:
        if not d.sql:
            findings.append(("RED", f"{d.name}: no SQL"))
            continue
        dialect = Dialect()
        try:
            sql = dialect.query(d.sql)
        except (Unsupported, ValueError) as e:
            findings.append(("BLOCKER", f"{d.name}: {e}"))
            continue
        findings += [("RED", n) for n in dialect.notes]
        if spark is not None:
            try:
                spark.sql(sql, args=dict.fromkeys(lex.binds(sql)))
            except AnalysisException as e:
                findings.append(("BLOCKER" if "NUM_COLUMNS_MISMATCH" in str(e) else "RED", f"{d.name}: {str(e).splitlines()[0]}"))
    for f in report.formulas:
        try:
            plsql.Compiler().compile(f.body)
        except ValueError as e:
            findings.append(("AMBER", f"{f.name}: {e}"))
    have = {i.name.upper() for d in report.datasets for i in d.items}
    for s in report.summaries:
        if have and s.source.upper() not in have | {f.name.upper() for f in report.formulas} | {x.name.upper() for x in report.summaries}:
            findings.append(("AMBER", f"{s.name}: no column {s.source}"))
    used = {link.parent.upper() for link in report.links} | {link.child.upper() for link in report.links}
    for d in report.datasets[1:]:
        if d.name.upper() not in used:
            findings.append(("AMBER", f"{d.name}: never linked"))
    return max((v for v, _ in findings), key=_RANK.index, default="READY"), findings


def hollow(df: DataFrame) -> bool:
    """Whether a part of the report has no rows (a one-row probe)."""
    return df.limit(1).isEmpty()


def field_values(report: ReportDef, df: DataFrame) -> DataFrame:
    """(field, status, n_values) of each visible field: shown, hollow if its column has no value in any row, missing without a column. One aggregation."""
    have = {c.lower(): c for c in df.columns}
    params = {p.name.lower() for p in report.params}
    wanted = list(dict.fromkeys(f.source for f in report.fields if f.visible and f.source and f.source.lower() not in params))
    counts = [F.count(F.col(f"`{have[w.lower()]}`")) if w.lower() in have else F.lit(None).cast("long") for w in wanted]
    one = df.agg(F.array(*(F.struct(F.lit(w).alias("field"), c.alias("n")) for w, c in zip(wanted, counts, strict=True))).alias("f")) if wanted else df.sparkSession.createDataFrame([], "f array<struct<field string, n long>>")
    status = F.when(F.col("x.n").isNull(), "missing").when(F.col("x.n") == 0, "hollow").otherwise("shown")
    return one.select(F.explode("f").alias("x")).select("x.field", status.alias("status"), F.coalesce("x.n", F.lit(0)).cast("long").alias("n_values"))


def changed_rows(spark: SparkSession, old: ReportDef, new: ReportDef) -> DataFrame:
    """(part, name, change, rows_gone, rows_new): what changed from one definition to another, and for a query the rows, with their copies, that only one form gives.

    Both forms are translated and run, so a changed text with equal rows shows as changed with zeros.
    """
    def rows(report: ReportDef, name: str) -> DataFrame | None:
        sql = next((d.sql for d in report.datasets if d.name == name), "")
        return spark.sql(text := Dialect().query(sql), args=dict.fromkeys(lex.binds(text))) if sql else None

    out = []
    for part, name, change in diff(old, new):
        a, b = (rows(r, name) if part == "query" else None for r in (old, new))
        if a is not None and b is not None and len(a.columns) == len(b.columns):
            gone, made = a.exceptAll(b), b.exceptAll(a)
        else:
            gone, made = a, b
        one = spark.range(1).select(F.lit(part).alias("part"), F.lit(name).alias("name"), F.lit(change).alias("change"))
        for column, df in (("rows_gone", gone), ("rows_new", made)):
            one = one.crossJoin(df.agg(F.count("*").alias(column))) if df is not None else one.withColumn(column, F.lit(0).cast("long"))
        out.append(one)
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], "part string, name string, change string, rows_gone long, rows_new long")


def effort(verdict: str, score: float) -> str:
    return "automatic" if verdict == "READY" and score >= 0.9 else "assisted" if verdict in ("READY", "AMBER") else "manual"


def referenced(report: ReportDef) -> list[tuple[str, int]]:
    """(table, references) over all datasets, most referenced first, ties in the order of first use; schema names do not count."""
    counts: dict[str, int] = {}
    for d in report.datasets:
        flat = lex.tokens(d.sql)
        for i, t in enumerate(flat[:-1]):
            if lex.is_word(t, "FROM", "JOIN") and flat[i + 1].kind in ("word", "quoted"):
                end = i + 1
                while end + 2 < len(flat) and flat[end + 1].text == ".":
                    end += 2
                name = flat[end].text.strip('"').lower()
                if name != "dual":
                    counts[name] = counts.get(name, 0) + 1
    return sorted(counts.items(), key=lambda x: -x[1])
