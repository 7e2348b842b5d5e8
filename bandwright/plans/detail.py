"""How a detail query is tied to its parent's rows.

A detail's SQL names its parent's columns as binds and is meant to run once for
each parent row. Where every such bind is a plain equality among the conjuncts of an
outermost WHERE, the predicate can go and become the join. Otherwise (a limit, a
row number or another analytic function for each parent; a bind under OR or NOT,
in a function, a derived table, EXISTS or the SELECT list) the query becomes the
right side of a lateral join with the distinct keys of the parent, which Spark
turns into joins, windows and limits by key: still one run for all parents.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from bandwright.plans import lex
from bandwright.plans.lex import Group, Token, is_word

KEYS, INNER = "bw_k", "bw_l"
SET_WORDS = ("UNION", "INTERSECT", "MINUS", "EXCEPT")
CLAUSES = ("SELECT", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "FETCH", "OFFSET", "START", "CONNECT")
AGGREGATES = ("SUM", "AVG", "COUNT", "MIN", "MAX", "STDDEV", "VARIANCE", "MEDIAN", "LISTAGG")
ARITHMETIC = ("+", "-", "*", "/", "||")


def key_column(name: str) -> str:
    """What a parent's key is called among the columns of a lateral detail."""
    return f"_link_{name.lower()}"


def _column_at(flat: list[Token], i: int) -> int:
    """The end of the column name that starts at i, or i if none does."""
    if i >= len(flat) or flat[i].kind not in ("word", "quoted"):
        return i
    end = i + 1
    while end + 1 < len(flat) and flat[end].text == "." and flat[end + 1].kind in ("word", "quoted"):
        end += 2
    return i if end < len(flat) and flat[end].text in ("(", *ARITHMETIC) else end


def link_predicates(flat: list[Token], keys: set[str]) -> list[tuple[int, int, str, str]]:
    """(start, end, bind, column) of each ``column = :KEY`` or ``:KEY = column`` among the tokens."""
    out = []
    for i, t in enumerate(flat):
        if t.kind in ("word", "quoted") and (i == 0 or flat[i - 1].text not in (".", *ARITHMETIC)):
            end = _column_at(flat, i)
            if end > i and end + 1 < len(flat) and flat[end].text == "=" and flat[end + 1].kind == "bind" and flat[end + 1].text[1:].upper() in keys and (end + 2 == len(flat) or flat[end + 2].text not in ARITHMETIC):
                out.append((i, end + 2, flat[end + 1].text[1:].upper(), "".join(x.text for x in flat[i:end])))
        elif t.kind == "bind" and t.text[1:].upper() in keys and i + 2 < len(flat) and flat[i + 1].text == "=" and (i == 0 or flat[i - 1].text not in ARITHMETIC):
            end = _column_at(flat, i + 2)
            if end > i + 2:
                out.append((i, end, t.text[1:].upper(), "".join(x.text for x in flat[i + 2 : end])))
    return out


def is_limited(flat: list[Token]) -> bool:
    """Whether a query keeps or numbers rows by their place among all its rows."""
    follows = [*flat[1:], Token("op", "")]
    return any(is_word(t, "ROWNUM", "OFFSET") or is_word(t, "FETCH") and is_word(n, "FIRST", "NEXT") or is_word(t, "OVER") and n.text == "(" for t, n in zip(flat, follows, strict=True))


def conjuncts(flat: list[Token], keys: set[str]) -> list[tuple[int, int, str, str]]:
    """The link predicates that stand as conjuncts of the outermost WHERE of their branch."""
    depth, where, has_or, out = 0, False, set(), []
    branch = 0
    place: dict[int, tuple[int, bool]] = {}
    for i, t in enumerate(flat):
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and is_word(t, *SET_WORDS):
            branch, where = branch + 1, False
        elif depth == 0 and is_word(t, *CLAUSES):
            where = t.upper == "WHERE"
        elif depth == 0 and where and is_word(t, "OR"):
            has_or.add(branch)
        place[i] = (branch, depth == 0 and where)
    for p in link_predicates(flat, keys):
        before, after = flat[p[0] - 1] if p[0] else None, flat[p[1]] if p[1] < len(flat) else None
        between = any(is_word(flat[j], "BETWEEN") for j in range(max(0, p[0] - 4), p[0]))
        if place[p[0]][1] and place[p[0]][0] not in has_or and is_word(before, "WHERE", "AND") and not between and (after is None or is_word(after, "AND", *CLAUSES, *SET_WORDS)):
            out.append(p)
    return out


def is_plain(sql: str, keys: set[str]) -> bool:
    """Whether the join alone says what the query's binds of its parent say."""
    flat = lex.tokens(sql)
    binds = sum(t.kind == "bind" and t.text[1:].upper() in keys for t in flat)
    return binds == len(conjuncts(flat, keys)) and not is_limited(flat)


def optional_filters(sql: str, keys: set[str]) -> list[tuple[dict[str, bool], str]]:
    """The query for each choice of keys that are NULL, where it has ``(:KEY IS NULL OR column = :KEY)`` among its conjuncts.

    Such a filter takes all rows for a NULL key and equal ones for another, so
    that the keys that are not NULL are left with an equality. One entry
    without choices if there is no such filter.
    """
    flat = lex.tokens(sql)
    found: list[tuple[int, int, str, list[Token]]] = []
    depth = 0
    for i, t in enumerate(flat):
        if t.text == "(" and depth == 0 and i and is_word(flat[i - 1], "WHERE", "AND"):
            end = next((j for j in range(i + 1, len(flat)) if flat[j].text == ")"), len(flat))
            inner = flat[i + 1 : end]
            at = next((j for j, x in enumerate(inner) if is_word(x, "OR")), -1)
            for first, second in ((inner[:at], inner[at + 1 :]), (inner[at + 1 :], inner[:at])) if at > 0 else ():
                is_null = len(first) == 3 and first[0].kind == "bind" and is_word(first[1], "IS") and is_word(first[2], "NULL")
                key = first[0].text[1:].upper() if is_null else ""
                if key in keys and [p[:3] for p in link_predicates(second, {key})] == [(0, len(second), key)]:
                    found.append((i, end + 1, key, second))
                    break
        depth += (t.text == "(") - (t.text == ")")
    names = sorted({f[2] for f in found})
    if not names or len(names) > 3:
        return [({}, sql)]
    out = []
    for choice in range(1 << len(names)):
        null = {k: bool(choice >> i & 1) for i, k in enumerate(names)}
        parts, at = [], 0
        for start, end, key, equal in found:
            parts += [*flat[at:start], *([Token("number", "1"), Token("op", "="), Token("number", "1")] if null[key] else equal)]
            at = end
        out.append((null, lex.text_of([*parts, *flat[at:]])))
    return out


@dataclass(frozen=True)
class Interval:
    """A detail of the rows whose interval holds the key: its SQL without that, but with the bounds as columns."""

    sql: str
    low: str = "_low_bound"
    high: str = "_high_bound"
    is_open: bool = False
    bounded: tuple[str, ...] = ()  # the bounds whose NULL takes no row


FLIPPED = {"<=": ">=", "<": ">", ">=": "<=", ">": "<"}


def interval(sql: str, key: str) -> Interval | None:
    """A query whose only use of the key is ``low <= :KEY AND :KEY <= high`` (or BETWEEN, or ``<`` above) among its conjuncts.

    ``NVL(bound, :KEY)`` is a bound that has no end where it is NULL.
    """
    items = lex.tree(lex.tokens(sql))
    if any(is_word(t, *SET_WORDS, "GROUP", "HAVING", "DISTINCT", "CONNECT", "WITH") for t in items) or is_limited(lex.tokens(sql)):
        return None
    places = {w: next((i for i, t in enumerate(items) if is_word(t, w)), None) for w in ("FROM", "WHERE", "ORDER")}
    start, where = places["FROM"], places["WHERE"]
    if start is None or where is None or any(is_word(t, *AGGREGATES) and isinstance(items[i + 1], Group) for i, t in enumerate(items[:start])):
        return None
    end = places["ORDER"] if places["ORDER"] is not None else len(items)
    if any(is_word(t, "OR") for t in items[where:end]):
        return None
    parts: list[list] = []
    for part in lex.split(items[where + 1 : end], "AND"):
        if parts and any(is_word(t, "BETWEEN") for t in parts[-1]) and not any(is_word(t, "AND") for t in parts[-1]):
            parts[-1] += [Token("word", "AND"), *part]
        else:
            parts.append(list(part))
    low = high = None
    is_open, rest = False, []
    for part in parts:
        is_key = [t.kind == "bind" and t.text[1:].upper() == key for t in part]
        ops = [i for i, t in enumerate(part) if getattr(t, "text", "") in FLIPPED]
        if is_key[0] and len(part) > 4 and is_word(part[1], "BETWEEN") and low is None and high is None:
            cut = next(i for i, t in enumerate(part) if is_word(t, "AND"))
            low, high = _bound_of(part[2:cut], key), _bound_of(part[cut + 1 :], key)
        elif len(ops) == 1 and (is_key[0] and ops[0] == 1 or is_key[-1] and ops[0] == len(part) - 2):
            op = part[ops[0]].text
            op, bound = (op, part[2:]) if is_key[0] and ops[0] == 1 else (FLIPPED[op], part[: ops[0]])
            if op == ">=" and low is None:
                low = _bound_of(bound, key)
            elif op in ("<", "<=") and high is None:
                high, is_open = _bound_of(bound, key), op == "<"
            else:
                return None
        else:
            rest.append(part)
    if not low or not high or any(t.kind == "bind" and t.text[1:].upper() == key for t in lex.tokens(lex.text_of([*items[:where], *low, *high, *(t for p in rest for t in p), *items[end:]]))):
        return None
    kept = [x for k, p in enumerate(rest) for x in ([Token("word", "AND")] if k else []) + p]
    added = [Token("op", ","), *low, Token("word", "AS"), Token("word", Interval.low), Token("op", ","), *high, Token("word", "AS"), Token("word", Interval.high)]
    text = [*items[:start], *added, *items[start:where], *([Token("word", "WHERE"), *kept] if kept else []), *items[end:]]
    ends = [t for t in items[where:end] if isinstance(t, Group) and any(x.kind == "bind" and x.text[1:].upper() == key for x in t.items)]
    endless = [lex.text_of(lex.split(t.items, ",")[0]) for t in ends]
    bounded = tuple(name for name, bound in ((Interval.low, low), (Interval.high, high)) if lex.text_of(bound) not in endless)
    return Interval(lex.text_of(text), is_open=is_open, bounded=bounded)


def _bound_of(items: list, key: str) -> list:
    if len(items) == 2 and is_word(items[0], "NVL", "COALESCE") and isinstance(items[1], Group):
        parts = lex.split(items[1].items, ",")
        if len(parts) == 2 and len(parts[1]) == 1 and parts[1][0].kind == "bind" and parts[1][0].text[1:].upper() == key:
            return parts[0]
    return items


def with_predicates(sql: str, pairs: Iterable[tuple[str, str]]) -> str:
    """The query with ``column = :PARENT`` for each pair in its outermost WHERE, as a declared link has it."""
    flat = lex.tokens(sql)
    depth, where, end = 0, None, len(flat)
    for i, t in enumerate(flat):
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and is_word(t, "WHERE"):
            where = i
        elif depth == 0 and is_word(t, "GROUP", "HAVING", "ORDER", "FETCH", "OFFSET", "START", "CONNECT", *SET_WORDS):
            end = i
            break
    added = [x for parent, column in pairs for x in (Token("word", "AND"), Token("word", column), Token("op", "="), Token("bind", f":{parent}"))]
    if not added:
        return sql
    if where is None:
        middle = [*flat[:end], Token("word", "WHERE"), *added[1:]]
    else:
        middle = [*flat[: where + 1], Token("op", "("), *flat[where + 1 : end], Token("op", ")"), *added]
    return lex.text_of([*middle, *flat[end:]])


def lateral(sql: str, keys: set[str]) -> str:
    """The query with its parent's binds as columns of the keys that it is laterally joined to.

    A subquery in an expression cannot see the keys from within: the query
    around it then has them as one more row source.
    """
    return lex.text_of(_query(lex.tree(lex.tokens(sql)), keys)[0])


def _query(items: list, keys: set[str]) -> tuple[list, bool]:
    out: list = []
    block: list = []
    clause, needs, from_end = "", False, None

    def close() -> None:
        nonlocal block, needs, from_end
        if needs:
            columns = ", ".join(f"{KEYS}.{key_column(k)} AS {key_column(k)}" for k in sorted(keys))
            source = [Token("op", ","), Token("word", f"(SELECT {columns})"), Token("word", INNER)]
            at = from_end if from_end is not None else len(block)
            block = [*block[:at], *source, *block[at:]]
        out.extend(block)
        block, needs, from_end = [], False, None

    for t in items:
        if is_word(t, *SET_WORDS):
            close()
            out.append(t)
            clause = ""
            continue
        if is_word(t, *CLAUSES):
            if clause == "FROM":
                from_end = len(block)
            clause = t.upper
        if isinstance(t, Group):
            if _is_query(t):
                if clause in ("FROM", "") and not (block and is_word(block[-1], "IN", "EXISTS", "=", "ON")):
                    t = Group(_query(t.items, keys)[0])
                else:
                    inner, found = _bound(t.items, keys, INNER)
                    needs |= found
                    t = Group(inner)
            else:
                inner, found = _expression(t.items, keys)
                needs |= found
                t = Group(inner)
        elif t.kind == "bind" and t.text[1:].upper() in keys:
            t = Token("word", f"{KEYS}.{key_column(t.text[1:])}")
        block.append(t)
    if clause == "FROM":
        from_end = len(block)
    close()
    return out, False


def _is_query(group: Group) -> bool:
    return bool(group.items) and (is_word(group.items[0], "SELECT", "WITH") or isinstance(group.items[0], Group) and _is_query(group.items[0]))


def _expression(items: list, keys: set[str]) -> tuple[list, bool]:
    """An expression's items with binds as columns; whether a subquery in it needs the keys as a row source."""
    out, needs = [], False
    for t in items:
        if isinstance(t, Group):
            inner, found = _bound(t.items, keys, INNER) if _is_query(t) else _expression(t.items, keys)
            needs |= found
            t = Group(inner)
        elif t.kind == "bind" and t.text[1:].upper() in keys:
            t = Token("word", f"{KEYS}.{key_column(t.text[1:])}")
        out.append(t)
    return out, needs


def _bound(items: list, keys: set[str], source: str) -> tuple[list, bool]:
    """Items with all binds, at any depth, as columns of a row source; whether there was one."""
    out, found = [], False
    for t in items:
        if isinstance(t, Group):
            inner, some = _bound(t.items, keys, source)
            found |= some
            t = Group(inner)
        elif t.kind == "bind" and t.text[1:].upper() in keys:
            t, found = Token("word", f"{source}.{key_column(t.text[1:])}"), True
        out.append(t)
    return out, found
