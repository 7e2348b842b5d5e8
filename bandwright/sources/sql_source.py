"""Report definitions from bare SQL text."""

from __future__ import annotations

import re

from bandwright.plans import lex
from bandwright.plans.model import Dataset, Item, Link, Param, ReportDef
from bandwright.sources.xml_source import bind_pairs, columns_of


def looks_like_sql(text: str) -> bool:
    flat = lex.tokens(text[:2000])
    return bool(flat) and flat[0].upper in ("SELECT", "WITH")


def named(text: str) -> dict[str, str]:
    """Queries under headings ``Q_NAME`` on lines of their own."""
    parts = re.split(r"(?m)^\s*#*\s*(Q_\w+)\s*:?\s*$", text)
    return {name: lex.statement(sql) for name, sql in zip(parts[1::2], parts[2::2], strict=True) if looks_like_sql(sql)}


def report(name: str, queries: dict[str, str]) -> ReportDef:
    """A report of named statements; a statement that binds another's column is its detail."""
    datasets = [Dataset(n, lex.statement(s), tuple(Item(c) for c in columns_of(s))) for n, s in queries.items()]
    links = []
    for child in datasets:
        for parent in datasets:
            if parent is not child and (pairs := bind_pairs(datasets, parent.name, child.name)):
                links.append(Link(parent.name, child.name, pairs))
                break
    linked = {b.upper() for link in links for b, _ in link.pairs}
    params = dict.fromkeys(b for d in datasets for b in lex.binds(d.sql) if b not in linked)
    return ReportDef(name, tuple(Param(p) for p in params), tuple(datasets), tuple(links))


def better(a: Dataset, b: Dataset) -> Dataset:
    """Of two versions of a dataset, the one with more columns, then the longer."""
    return max(a, b, key=lambda d: (len(columns_of(d.sql)), len(d.sql)))
