"""Legacy SQL as Spark SQL, on token trees.

Whatever is not known stays as it is written; Spark's analyzer is the judge of
the rest. Literals are never rewritten. Where the dialects differ, the source
dialect's meaning is kept: NULL-safe DECODE, NULL as empty text in ``||``,
greatest and least with NULL, month ends, nulls last in ascending order, and
ROWNUM before ORDER BY.

A limit within another query may be one for each row of the query around it.
Spark makes that a row number by key, in the order of the sort right below the
limit, and in none at all if the SELECT list stands between the two, as it does
where a sort key is not selected. So such keys are selected under names of
their own (``HIDDEN``), and taken away above the limit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from bandwright.functions import masks
from bandwright.functions.registry import Registry, standard
from bandwright.plans import lex
from bandwright.plans.lex import Group, Token, is_word

CLAUSES = ("SELECT", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "START", "CONNECT", "FETCH", "OFFSET")
SET_WORDS = ("UNION", "INTERSECT", "MINUS", "EXCEPT")
HIDDEN = "bw_o"
OPERATORS = ("+", "-", "*", "/", "=", "<", ">", "<=", ">=", "<>", "!=", "^=", "||")


class Unsupported(ValueError):
    """A construct with no faithful translation."""


class UnresolvedLexical(Unsupported):
    """A lexical reference that stands for a table or a name, without a value."""


@dataclass
class Dialect:
    """types: 'date', 'number' or 'string' by column name, for TRUNC, ROUND and TO_CHAR."""

    types: dict[str, str] = field(default_factory=dict)
    registry: Registry = field(default_factory=standard)
    now: str = "current_timestamp()"
    lexicals: dict[str, str] = field(default_factory=dict)
    resolve: Callable[[str], str] | None = None  # how a bind is written; ':NAME' by default
    notes: list[str] = field(default_factory=list)
    nested: bool = False  # whether the statement becomes a subquery

    # ---- queries
    def query(self, text: str) -> str:
        """A whole statement in Spark SQL."""
        source = self._spliced(lex.statement(text))
        return self._query(lex.tree(lex.tokens(source)), self.nested)

    def _spliced(self, text: str) -> str:
        """Lexical references replaced by their values; without one, an AND or WHERE reference goes with a note."""
        for name in lex.lexicals(text):
            value = self.lexicals.get(name)
            out, flat = [], lex.tokens(text)
            for i, t in enumerate(flat):
                if t.kind == "lexical" and t.text.strip("&<>").upper() == name:
                    if value is None:
                        before = flat[i - 1].upper if i else ""
                        if before in ("FROM", "JOIN", ",", "SELECT", "."):
                            raise UnresolvedLexical(f"&{name} stands for a name and has no value")
                        self.notes.append(f"RED: &{name} has no value, its rows are not filtered")
                        if before in ("AND", "OR", "WHERE"):
                            out.append("1 = 1")
                        continue
                    out.append(value)
                else:
                    out.append(t.text)
            text = " ".join(out)
        return text

    def _query(self, items: list, nested: bool = True) -> str:
        if items and is_word(items[0], "WITH"):
            return self._with(items, nested)
        blocks, seps = [[]], []
        i = 0
        while i < len(items):
            t = items[i]
            if is_word(t, *SET_WORDS):
                sep = {"MINUS": "EXCEPT"}.get(t.upper, t.upper)
                if i + 1 < len(items) and is_word(items[i + 1], "ALL"):
                    sep, i = sep + " ALL", i + 1
                seps.append(sep)
                blocks.append([])
            else:
                blocks[-1].append(t)
            i += 1
        tail: list = []
        if seps:
            last = blocks[-1]
            at = next((k for k, t in enumerate(last) if is_word(t, "ORDER")), None)
            if at is not None:
                blocks[-1], tail = last[:at], last[at:]
        # a limit is of its own branch
        texts = [f"({self._block(b, nested)})" if seps and any(is_word(t, "ROWNUM", "FETCH", "OFFSET") for t in b) else self._block(b, nested) for b in blocks]
        out = texts[0]
        for sep, text in zip(seps, texts[1:], strict=True):
            out = f"{out} {sep} {text}"
        return f"{out} {self._order(tail[2:])}" if tail else out

    def _with(self, items: list, nested: bool) -> str:
        out, i = [], 1
        while i < len(items):
            name = items[i].text
            i += 1
            columns = ""
            if isinstance(items[i], Group):
                columns, i = f"({lex.text_of(items[i].items)})", i + 1
            i += 1  # AS
            out.append(f"{name}{columns} AS ({self._query(items[i].items)})")
            i += 1
            if i < len(items) and getattr(items[i], "text", "") == ",":
                i += 1
                continue
            break
        recursive = "RECURSIVE " if is_word(items[1], "RECURSIVE") else ""
        return f"WITH {recursive}{', '.join(out)} {self._query(items[i:], nested)}"

    def _clauses(self, items: list) -> dict[str, list]:
        parts: dict[str, list] = {}
        name = ""
        i = 0
        while i < len(items):
            t = items[i]
            follows = items[i + 1] if i + 1 < len(items) else None
            opens = {"GROUP": "BY", "ORDER": "BY", "CONNECT": "BY", "START": "WITH"}.get(getattr(t, "upper", ""))
            if is_word(t, "ORDER") and is_word(follows, "SIBLINGS") and i + 2 < len(items) and is_word(items[i + 2], "BY"):
                name = "SIBLINGS"
                i += 2  # SIBLINGS BY
                parts[name] = []
            elif is_word(t, *CLAUSES) and (opens is None or is_word(follows, opens)) and (t.upper != "FETCH" or is_word(follows, "FIRST", "NEXT")):
                name = t.upper
                if name in ("GROUP", "ORDER", "START", "CONNECT"):
                    i += 1  # BY or WITH
                parts[name] = []
            elif name:
                parts[name].append(t)
            else:
                raise Unsupported(f"not a query: {lex.text_of(items)[:60]}")
            i += 1
        return parts

    def _block(self, items: list, nested: bool = True) -> str:
        if len(items) == 1 and isinstance(items[0], Group):
            return f"({self._query(items[0].items, nested)})"
        parts = self._clauses(items)
        if "CONNECT" in parts:
            return self._hierarchy(parts)
        source = parts.get("FROM", [])
        limit, where = self._rownum(self._conditions(parts))
        tail = self._tail(parts, limit)
        fetched = "FETCH" in parts or "OFFSET" in parts
        whole = len(parts["SELECT"]) == 1 and parts["SELECT"][0].kind == "op" and "ORDER" not in parts
        if nested and (whole if fetched else limit is not None):
            ordered = self._ordered_source(source)
            if ordered is not None:  # the first rows of a sorted table, then what is selected from them
                inner, terms, hidden, name = ordered
                first = f"SELECT * FROM {inner}{self._where(where)} ORDER BY {', '.join(terms)}{tail}"
                order = f" {self._order(parts['ORDER'])}" if "ORDER" in parts else ""
                return f"SELECT {self._items(parts['SELECT'])} FROM ({self._without(first, hidden)}) {name}".rstrip() + self._grouped(parts) + order
        from_text, where = self._from(source, where)
        if limit is not None and "ORDER" in parts:  # rows are numbered before they are sorted
            inner = f"SELECT * FROM (SELECT {self._items(parts['SELECT'])}{from_text}{self._where(where)} LIMIT {limit})"
            return f"{inner} {self._order(parts['ORDER'])}"
        if nested and tail and "ORDER" in parts:
            text, terms, hidden = self._sorted(parts, from_text, where)
            return self._without(f"{text} ORDER BY {', '.join(terms)}{tail}", hidden)
        out = f"SELECT {self._items(parts['SELECT'])}{from_text}{self._where(where)}{self._grouped(parts)}"
        if "ORDER" in parts:
            out += f" {self._order(parts['ORDER'])}"
        return out + tail

    def _conditions(self, parts: dict[str, list]) -> list[list]:
        """The AND-parts of WHERE; one part if there is an OR."""
        if "WHERE" not in parts:
            return []
        return self._between([parts["WHERE"]] if self._has_or(parts["WHERE"]) else lex.split(parts["WHERE"], "AND"))

    def _grouped(self, parts: dict[str, list]) -> str:
        out = f" GROUP BY {self._list(parts['GROUP'])}" if "GROUP" in parts else ""
        return out + (f" HAVING {self.expression(parts['HAVING'])}" if "HAVING" in parts else "")

    @staticmethod
    def _tail(parts: dict[str, list], limit: str | None) -> str:
        """LIMIT and OFFSET; ``limit`` is that of ROWNUM."""
        if "FETCH" in parts:
            limit = next((t.text for t in parts["FETCH"] if t.kind in ("number", "bind")), "1")
        offset = f" OFFSET {parts['OFFSET'][0].text}" if "OFFSET" in parts else ""
        return (f" LIMIT {limit}" if limit is not None else "") + offset

    @staticmethod
    def _without(text: str, hidden: list[str]) -> str:
        return f"SELECT * EXCEPT ({', '.join(hidden)}) FROM ({text})" if hidden else text

    def _sorted(self, parts: dict[str, list], from_text: str, where: list[list]) -> tuple[str, list[str], list[str]]:
        """A block with its sort keys among its columns, the terms that sort it, and the names of the columns added."""
        names = {n.upper() for item in lex.split(parts["SELECT"], ",") if (n := self._output_name(item))}
        terms, added = [], {}
        for part in lex.split(parts["ORDER"], ","):
            key, direction = self._directed(part)
            if len(key) == 1 and (key[0].kind == "number" or getattr(key[0], "text", "").strip('"`').upper() in names):
                terms.append(self.expression(key) + direction)
            else:
                name = f"{HIDDEN}{len(added)}"
                added[name] = self.expression(key)
                terms.append(name + direction)
        columns = "".join(f", {v} AS {n}" for n, v in added.items())
        return f"SELECT {self._items(parts['SELECT'])}{columns}{from_text}{self._where(where)}{self._grouped(parts)}", terms, list(added)

    @staticmethod
    def _output_name(item: list) -> str:
        """The name that an item of a SELECT list states or, being a column, has; else an empty text."""
        last, before = (item[-1] if item else None), (item[-2] if len(item) > 1 else None)
        if getattr(last, "kind", "") not in ("word", "quoted"):
            return ""
        named = before is None or isinstance(before, Group) or before.kind != "op" or before.text == "." and len(item) == 3
        return last.text.strip('"`') if named else ""

    def _ordered_source(self, source: list) -> tuple[str, list[str], list[str], str] | None:
        """A FROM of one sorted query: its text, the terms that sort it, the columns added for them, its name; else None."""
        if not source or not isinstance(source[0], Group) or not source[0].items or not is_word(source[0].items[0], "SELECT") or any(getattr(t, "kind", "") not in ("word", "quoted") for t in source[1:]) or len(source) > 3 or any(is_word(t, "JOIN") for t in source):
            return None
        items, name = source[0].items, lex.text_of(source[1:])
        if any(is_word(t, *SET_WORDS) for t in items):
            return None
        parts = self._clauses(items)
        if any(k in parts for k in ("CONNECT", "SIBLINGS", "FETCH", "OFFSET")):
            return None
        limit, where = self._rownum(self._conditions(parts))
        if limit is not None:
            return None
        if "ORDER" in parts:
            text, terms, hidden = self._sorted(parts, *self._from(parts.get("FROM", []), where))
        else:  # all columns of a sorted query, some of its rows
            below = self._ordered_source(parts.get("FROM", [])) if len(parts["SELECT"]) == 1 and parts["SELECT"][0].text == "*" and "GROUP" not in parts else None
            if below is None:
                return None
            text, terms, hidden = f"SELECT * FROM {below[0]}{self._where(where)}", below[1], below[2]
        return f"({text}) {name}".rstrip(), terms, hidden, name

    @staticmethod
    def _has_or(items: list) -> bool:
        return any(is_word(t, "OR") for t in items)

    @staticmethod
    def _between(parts: list[list]) -> list[list]:
        """AND-parts, with the two halves of a BETWEEN put together again."""
        out: list[list] = []
        for part in parts:
            if out and any(is_word(t, "BETWEEN") for t in out[-1]) and not any(is_word(t, "AND") for t in out[-1]):
                out[-1] += [Token("word", "AND"), *part]
            else:
                out.append(list(part))
        return out

    @staticmethod
    def _rownum(where: list[list]) -> tuple[str | None, list[list]]:
        """The limit that the conditions on ROWNUM set, and the other conditions. Row 1 must pass for any row to do so."""
        limits: list[str] = []
        rest = []
        flipped = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}
        for part in where:
            if not any(is_word(t, "ROWNUM") for t in part):
                rest.append(part)
                continue
            if len(part) == 3 and is_word(part[2], "ROWNUM") and part[1].text in flipped:
                part = [part[2], Token("op", flipped[part[1].text]), part[0]]
            if len(part) == 5 and is_word(part[0], "ROWNUM") and is_word(part[1], "BETWEEN") and part[2].text.isdigit():
                limits.append(part[4].text if int(part[2].text) <= 1 else "0")
                continue
            op, n = (part[1].text, part[2].text) if len(part) == 3 and is_word(part[0], "ROWNUM") else ("", "")
            if op == "<=" or op == "<" and n.isdigit():
                limits.append(n if op == "<=" else str(max(0, int(n) - 1)))
            elif op == "<" and part[2].kind == "bind":
                limits.append(f"{n} - 1")
            elif op == "=" and n.isdigit():
                limits.append("1" if n == "1" else "0")
            elif op in (">", ">=") and n.isdigit():
                limits += [] if int(n) < (1 if op == ">" else 2) else ["0"]
            else:
                raise Unsupported(f"a condition on ROWNUM: {lex.text_of(part)}")
        return (limits[0] if len(limits) == 1 else f"least({', '.join(limits)})" if limits else None), rest

    def _where(self, where: list[list]) -> str:
        return " WHERE " + " AND ".join(self.expression(p) for p in where) if where else ""

    def _from(self, source: list, where: list[list]) -> tuple[str, list[list]]:
        """The FROM clause; predicates with (+) become left joins, all of one optional table in its ON."""
        if not source or (len(source) == 1 and is_word(source[0], "DUAL")):
            return "", where
        tables = [self._table(t) for t in lex.split(source, ",")]
        for part in where:
            inner = any(t.kind == "outer" for g in part if isinstance(g, Group) for t in self._flat(g))
            if inner or any(getattr(t, "kind", "") == "outer" for t in part) and any(is_word(t, "OR", "IN") for t in part):
                raise Unsupported(f"(+) under OR, IN or in an expression: {lex.text_of(part)}")
        marked = [p for p in where if any(getattr(t, "kind", "") == "outer" for t in p)]
        if not marked:
            return " FROM " + ", ".join(text for _, text in tables), where
        rest = [p for p in where if p not in marked]
        optional: dict[str, list[str]] = {}
        needs: dict[str, set[str]] = {}
        for part in marked:
            owners = {part[i - 3].upper for i, t in enumerate(part) if t.kind == "outer" and i >= 3}
            if len(owners) != 1 or not all(part[i - 2].text == "." for i, t in enumerate(part) if t.kind == "outer"):
                raise Unsupported(f"outer join needs qualified columns of one table: {lex.text_of(part)}")
            owner = owners.pop()
            optional.setdefault(owner, []).append(self.expression([t for t in part if t.kind != "outer"]))
            needs.setdefault(owner, set()).update(part[i].upper for i in range(len(part) - 1) if part[i].kind == "word" and getattr(part[i + 1], "text", "") == "." and part[i].upper != owner)
        known = {name: text for name, text in tables}
        if missing := set(optional) - set(known):
            raise Unsupported(f"outer join of unknown tables: {sorted(missing)}")
        placed = [name for name, _ in tables if name not in optional]
        if not placed:
            raise Unsupported("every table is optional")
        out = " FROM " + " CROSS JOIN ".join(known[n] for n in placed)
        # inner joins between the required tables stay in WHERE; Catalyst turns them into equi-joins
        waiting = [n for n, _ in tables if n in optional]
        while waiting:
            ready = next((n for n in waiting if needs[n] <= set(placed)), None)
            if ready is None:
                raise Unsupported(f"outer joins form a cycle: {waiting}")
            out += f" LEFT JOIN {known[ready]} ON {' AND '.join(optional[ready])}"
            placed.append(ready)
            waiting.remove(ready)
        return out, rest

    @staticmethod
    def _flat(group: Group) -> list:
        """The tokens of a group, but those of queries in it."""
        if Dialect._is_query(group):
            return []
        return [x for t in group.items for x in (Dialect._flat(t) if isinstance(t, Group) else [t])]

    def _table(self, items: list) -> tuple[str, str]:
        if isinstance(items[0], Group):
            text = f"({self._query(items[0].items)})" if self._is_query(items[0]) else self.expression(items[:1])
            rest = lex.text_of(items[1:])
            return (items[-1].upper if len(items) > 1 else ""), f"{text} {rest}".strip()
        if any(is_word(t, "JOIN", "LATERAL") for t in items):
            return "", self.expression(items)
        return items[-1].upper, lex.text_of(items)

    def _hierarchy(self, parts: dict[str, list]) -> str:
        """CONNECT BY within another query, as a recursive query with LEVEL as a counter; ``plans.connect`` runs the others."""
        every = [t for p in parts.values() for t in p]
        if any(is_word(t, "NOCYCLE", "CONNECT_BY_ROOT", "CONNECT_BY_ISLEAF", "CONNECT_BY_ISCYCLE", "SYS_CONNECT_BY_PATH") for t in every):
            raise Unsupported("NOCYCLE and the columns of a CONNECT BY way need plans.connect: run the hierarchy as a query of its own")
        table = lex.text_of(parts["FROM"])
        if any(getattr(t, "text", "") == "," or isinstance(t, Group) for t in parts["FROM"]):
            raise Unsupported("CONNECT BY over more than one table")
        links = []
        for part in lex.split(parts["CONNECT"], "AND"):
            sides = lex.split([t for t in part if not is_word(t, "NOCYCLE")], "=")
            if len(sides) != 2 or sum(is_word(s[0], "PRIOR") for s in sides) != 1:
                raise Unsupported(f"CONNECT BY {lex.text_of(part)}")
            parent, child = sides if is_word(sides[0][0], "PRIOR") else sides[::-1]
            links.append(f"c.{lex.text_of(child)} = h.{lex.text_of(parent[1:])}")
        start = f" WHERE {self.expression(parts['START'])}" if "START" in parts else ""
        select = self._items([Token("word", "tree_level") if is_word(t, "LEVEL") else t for t in self._renamed_level(parts["SELECT"])])
        where = self._where([parts["WHERE"]]) if "WHERE" in parts else ""
        order = f" {self._order(parts['ORDER'])}" if "ORDER" in parts else ""
        first = then = ""
        if "SIBLINGS" in parts:  # depth first: each row carries the sort keys on its way from the root
            step = self._sibling_keys(parts["SIBLINGS"])
            first, then = f", array({step.format('')}) AS tree_path", f", concat(h.tree_path, array({step.format('c.')}))"
            order = " ORDER BY tree_path"
        return f"WITH RECURSIVE walked AS (SELECT *, 1 AS tree_level{first} FROM {table}{start} UNION ALL SELECT c.*, h.tree_level + 1{then} FROM {table} c JOIN walked h ON {' AND '.join(links)}) SELECT {select} FROM walked{where}{order}"

    @staticmethod
    def _sibling_keys(items: list) -> str:
        """The sort keys of one row as a struct, nulls last, equal rows apart by a hash; {} stands for the table."""
        keys = []
        for k, part in enumerate(lex.split(items, ",")):
            part = part[:-1] if is_word(part[-1], "ASC") else part
            if len(part) != 1 or part[0].kind not in ("word", "quoted") or is_word(part[0], "DESC"):
                raise Unsupported(f"ORDER SIBLINGS BY {lex.text_of(part)}")
            keys += [f"{{0}}{part[0].text} IS NULL AS n{k}", f"{{0}}{part[0].text} AS k{k}"]
        return f"named_struct({', '.join(x for key in keys for x in reversed_pair(key))}, 'row', xxhash64({{0}}*))"

    @staticmethod
    def _renamed_level(items: list) -> list:
        out = []
        for i, t in enumerate(items):
            out.append(t)
            if is_word(t, "LEVEL") and (i + 1 == len(items) or getattr(items[i + 1], "text", "") == ","):
                out += [Token("word", "AS"), Token("quoted", "`level`")]
        return out

    @staticmethod
    def _is_query(group: Group) -> bool:
        return bool(group.items) and (is_word(group.items[0], "SELECT", "WITH") or (isinstance(group.items[0], Group) and Dialect._is_query(group.items[0])))

    def _items(self, items: list) -> str:
        prefix = ""
        if items and is_word(items[0], "DISTINCT", "UNIQUE"):
            prefix, items = "DISTINCT ", items[1:]
        return prefix + self._list(items)

    def _list(self, items: list) -> str:
        return ", ".join(self.expression(p) for p in lex.split(items, ","))

    def _order(self, items: list) -> str:
        keys = map(self._directed, lex.split(items, ","))
        return "ORDER BY " + ", ".join(self.expression(key) + direction for key, direction in keys)

    @staticmethod
    def _directed(part: list) -> tuple[list, str]:
        """A sort key, and its direction and place of nulls in words."""
        stated = next((i for i, t in enumerate(part) if is_word(t, "NULLS")), None)
        nulls = f" NULLS {part[stated + 1].upper}" if stated is not None else None
        part = part[:stated] if stated is not None else part
        down = bool(part) and is_word(part[-1], "DESC")
        part = part[:-1] if part and is_word(part[-1], "DESC", "ASC") else part
        return part, f"{' DESC' if down else ' ASC'}{nulls or (' NULLS FIRST' if down else ' NULLS LAST')}"

    # ---- expressions
    def expression(self, items: list) -> str:
        return lex_join(self._pieces(self._concatenated(items)))

    def expression_text(self, text: str) -> str:
        return self.expression(lex.tree(lex.tokens(text)))

    def _concatenated(self, items: list) -> list:
        """a || b || c as one call in which NULL is empty text and all NULL is NULL."""
        if not any(getattr(t, "text", "") == "||" for t in items):
            return items
        start, out = 0, []
        i = 0
        while i <= len(items):
            t = items[i] if i < len(items) else None
            stop = t is None or (t.kind == "op" and t.text != "||" and t.text not in (".", "*", "/")) or is_word(t, "AND", "OR", "NOT", "LIKE", "IN", "IS", "BETWEEN", "AS", "THEN", "WHEN", "ELSE", "END", "CASE", "FROM", "OVER")
            if stop:
                run = items[start:i]
                if any(getattr(x, "text", "") == "||" for x in run):
                    alias = []
                    if len(run) > 1 and run[-1].kind in ("word", "quoted") and getattr(run[-2], "text", "") not in ("||", "."):
                        run, alias = run[:-1], [run[-1]]
                    parts = [self.expression(p) for p in lex.split(run, "||")]
                    guard = " AND ".join(f"{p} IS NULL" for p in parts)
                    literal = any(p.startswith("'") and p != "''" for p in parts)
                    text = f"concat_ws('', {', '.join(parts)})"
                    out.append(Token("sql", text if literal else f"CASE WHEN {guard} THEN NULL ELSE {text} END"))
                    out += alias
                else:
                    out += run
                if t is not None:
                    out.append(t)
                start = i + 1
            i += 1
        return out

    def _pieces(self, items: list) -> list[str]:
        out: list[str] = []
        i = begin = 0
        while i < len(items):
            used = self._moved(items, begin, i, out) if out else 0
            if used:
                begin = begin if items[i + 1].kind == "number" else i + used  # a date stays one, a difference is a number
                i += used
                continue
            t, begin = items[i], i
            if isinstance(t, Group):
                out.append(f"({self._query(t.items) if self._is_query(t) else self._list(t.items)})")
                i += 1
                continue
            if t.kind == "word":
                name, j = t.text, i + 1
                while j + 1 < len(items) and getattr(items[j], "text", "") == "." and items[j + 1].kind in ("word", "quoted"):
                    name, j = f"{name}.{items[j + 1].text}", j + 2
                if j < len(items) and isinstance(items[j], Group) and name.upper() not in ("IN", "EXISTS", "AND", "OR", "NOT", "ON", "WHEN", "THEN", "ELSE", "FROM", "USING", "OVER", "BY", "AS", "LATERAL", "JOIN", "ANY", "ALL", "SOME", "GROUP", "VALUES", "ROLLUP", "CUBE", "SETS"):
                    text, used = self._call(name, items[j], items[j + 1 :])
                    out.append(text)
                    i = j + 1 + used
                    continue
                upper = name.upper()
                out.append(self.now if upper in ("SYSDATE", "SYSTIMESTAMP") else "''" if upper == "EMPTY" else name)
                i = j
                continue
            if t.kind == "bind":
                out.append(self.resolve(t.text[1:]) if self.resolve else t.text.upper())
            elif t.kind == "string":
                out.append(masks.quote(t.text.lstrip("nN")[1:-1].replace("''", "'")))
            elif t.kind == "quoted":
                out.append(t.text if t.text.startswith("`") else "`" + t.text[1:-1] + "`")
            elif t.text in ("!=", "^="):
                out.append("<>")
            else:
                out.append(t.text)
            i += 1
        return out

    def _primary(self, items: list, i: int) -> int:
        """The end of the name, call or group that starts at i."""
        j = i + 1
        while j + 1 < len(items) and getattr(items[j], "text", "") == "." and items[j + 1].kind in ("word", "quoted"):
            j += 2
        return j + 1 if is_word(items[i], items[i].upper) and j < len(items) and isinstance(items[j], Group) else j

    def _moved(self, items: list, begin: int, i: int, out: list[str]) -> int:
        """How many items a number of days added to the date before them, or a date subtracted from it, takes; the last of ``out`` is then the result."""
        if getattr(items[i], "text", "") not in ("+", "-") or i + 1 >= len(items) or begin and getattr(items[begin - 1], "text", "") in ("+", "-", "*", "/", "||") or self._kind_of(items[begin:i]) != "date":
            return 0
        if getattr(items[i + 1], "kind", "") == "number":
            end = i + 2
            while end + 1 < len(items) and getattr(items[end], "text", "") in ("*", "/") and getattr(items[end + 1], "kind", "") == "number":
                end += 2
            days = lex.text_of(items[i + 1 : end])
            out[-1] = f"({out[-1]} {items[i].text} make_dt_interval(0, 0, 0, cast(({days}) * 86400 as decimal(18,6))))"
            return end - i
        end = self._primary(items, i + 1)
        if items[i].text == "-" and getattr(items[i + 1], "kind", "") != "bind" and self._kind_of(items[i + 1 : end]) == "date":
            other = lex_join(self._pieces(items[i + 1 : end]))
            out[-1] = f"((unix_micros(cast({out[-1]} as timestamp)) - unix_micros(cast({other} as timestamp))) / 86400000000)"
            return end - i
        return 0

    def _kind_of(self, items: list) -> str:
        """'date', 'number', 'string' or ''."""
        if not items:
            return ""
        first = items[0]
        if is_word(first, "ROUND", "TRUNC") and len(items) > 1 and isinstance(items[1], Group):
            args = lex.split(items[1].items, ",")
            unit = self._literal(args[1]) if len(args) > 1 else None
            return "date" if unit is not None or self._kind_of(args[0]) == "date" else "number"
        if is_word(first, "SYSDATE", "SYSTIMESTAMP", "TO_DATE", "ADD_MONTHS", "LAST_DAY", "NEXT_DAY", "TO_TIMESTAMP", "DATE", "TIMESTAMP"):
            return "date"
        if getattr(first, "kind", "") == "number" or is_word(first, "ROUND", "TO_NUMBER", "SUM", "COUNT", "AVG", "MOD", "ABS", "POWER", "LENGTH"):
            return "number"
        if any(getattr(t, "text", "") in ("*", "/") for t in items):
            return "number"
        names = [t for t in items if getattr(t, "kind", "") in ("word", "bind")]
        return self.types.get(names[-1].text.lstrip(":").lower(), "") if names else self._kind_of(first.items) if isinstance(first, Group) else ""

    def _literal(self, items: list) -> str | None:
        return items[0].text[1:-1].replace("''", "'") if len(items) == 1 and getattr(items[0], "kind", "") == "string" else None

    def _call(self, name: str, group: Group, after: list) -> tuple[str, int]:
        """(SQL of a call, how many items after it belong to it)."""
        upper = name.upper()
        if upper == "MAX" and after and is_word(after[0], "KEEP"):
            return self._keep("max", group, after[1]), 2
        if upper == "MIN" and after and is_word(after[0], "KEEP"):
            return self._keep("min", group, after[1]), 2
        if upper == "RATIO_TO_REPORT" and after and is_word(after[0], "OVER"):
            x = self._list(group.items)
            return f"({x} / sum({x}) over {self._pieces([after[1]])[0]})", 2
        if upper == "LISTAGG":
            parts = lex.split(group.items, ",")
            sep = self.expression(parts[1]) if len(parts) > 1 else "','"
            if after and is_word(after[0], "WITHIN"):
                order = after[2].items
                return f"listagg({self.expression(parts[0])}, {sep}) WITHIN GROUP ({self._order(order[2:])})", 3
            return f"listagg({self.expression(parts[0])}, {sep})", 0
        if is_word(group.items[0], "DISTINCT") if group.items else False:
            return f"{name}(DISTINCT {self._list(group.items[1:])})", 0
        if upper in ("EXTRACT", "CAST", "TRIM"):
            return f"{name}({lex_join(self._pieces(group.items))})", 0
        args = lex.split(group.items, ",") if group.items else []
        args = [a[2:] if len(a) > 2 and getattr(a[1], "text", "") == "=>" else a for a in args]
        text = [self.expression(a) for a in args]
        done = self._function(upper, args, text)
        if done is not None:
            return done, 0
        if "." in name or upper.startswith("F_") or self.registry.knows(name):
            return self.registry.call(name, text), 0
        if after and is_word(after[0], "OVER") and len(after) > 1 and isinstance(after[1], Group):
            return f"{name}({', '.join(text)}) OVER ({self._window(after[1].items)})", 2
        return f"{name}({', '.join(text)})", 0

    def _window(self, items: list) -> str:
        at = next((i for i, t in enumerate(items) if is_word(t, "ORDER")), None)
        if at is None:
            return lex_join(self._pieces(items))
        end = next((i for i, t in enumerate(items) if is_word(t, "ROWS", "RANGE")), len(items))
        return f"{lex_join(self._pieces(items[:at]))} {self._order(items[at + 2 : end])} {lex_join(self._pieces(items[end:]))}".strip()

    def _keep(self, function: str, group: Group, keep: Group) -> str:
        """max(e) KEEP (DENSE_RANK FIRST ORDER BY o): the extreme e among the rows of the first o, nulls last."""
        words = keep.items
        order = words[next(i for i, t in enumerate(words) if is_word(t, "ORDER")) + 2 :]
        down = any(is_word(t, "DESC") for t in order)
        first = is_word(words[1], "FIRST")
        key = [t for t in order if not is_word(t, "DESC", "ASC", "NULLS", "LAST", "FIRST")]
        o, e = self.expression(key), self.expression(group.items)
        if (down == first) != (function == "max"):
            raise Unsupported("KEEP over several keys or against the aggregate's direction: use links.first_fetch")
        return f"{function}(struct({o} as o, {e} as e)) FILTER (WHERE {o} IS NOT NULL).e"

    def _function(self, f: str, args: list[list], text: list[str]) -> str | None:
        n = len(args)
        if f == "NVL":
            return f"coalesce({text[0]}, {text[1]})"
        if f in ("GREATEST", "LEAST"):
            return f"CASE WHEN {' OR '.join(f'{x} IS NULL' for x in text)} THEN NULL ELSE {f.lower()}({', '.join(text)}) END"
        if f == "SUBSTR":
            return f"substr({', '.join(text)})"
        if f == "INSTR":
            if n == 2:
                return f"instr({text[0]}, {text[1]})"
            if n == 3:
                return f"locate({text[1]}, {text[0]}, {text[2]})"
            return f"aggregate(sequence(1, {text[3]}), cast({text[2]} - 1 as int), (p, k) -> if(k > 1 and p = 0, 0, locate({text[1]}, {text[0]}, p + 1)))"
        if f == "LENGTHB":
            return f"octet_length({text[0]})"
        if f in ("LTRIM", "RTRIM") and n == 2:
            return f"trim({'LEADING' if f == 'LTRIM' else 'TRAILING'} {text[1]} FROM {text[0]})"
        if f in ("LPAD", "RPAD"):
            return f"{f.lower()}({text[0]}, cast({text[1]} as int), {text[2] if n > 2 else chr(39) + ' ' + chr(39)})"
        if f == "REPLACE":
            return f"replace({', '.join(text)})"
        if f == "REGEXP_REPLACE":
            return f"regexp_replace({text[0]}, {text[1]}, {text[2] if n > 2 else chr(39) * 2})"
        if f == "TO_CHAR":
            mask = self._literal(args[1]) if n > 1 else None
            if mask is None:
                return self._plain_number(text[0]) if self._kind_of(args[0]) == "number" else f"cast({text[0]} as string)"
            if masks.is_date_mask(mask) and self._kind_of(args[0]) != "number":
                return masks.date_text(text[0], mask)
            if self._kind_of(args[0]) == "date":
                raise Unsupported(f"date mask {mask}")
            return masks.number_text(text[0], mask)
        if f in ("TO_DATE", "TO_TIMESTAMP"):
            mask = self._literal(args[1]) if n > 1 else None
            if mask is None:
                return f"to_date({text[0]})"
            pattern, _ = masks.date_pattern(mask)
            return f"to_date({text[0]}, {masks.quote(pattern)})" if not any(c in pattern for c in "Hhms") else f"to_timestamp({text[0]}, {masks.quote(pattern)})"
        if f == "TRUNC":
            unit = self._literal(args[1]) if n > 1 else None
            if unit is not None and unit.upper() in masks.TRUNC_UNITS:
                return f"date_trunc('{masks.TRUNC_UNITS[unit.upper()]}', {text[0]})"
            if n == 1 and self._kind_of(args[0]) == "date":
                return f"date_trunc('DAY', {text[0]})"
            scale = f"power(10, {text[1]})" if n > 1 else "1"
            return f"(sign({text[0]}) * floor(abs({text[0]}) * {scale}) / {scale})" if n > 1 else f"(sign({text[0]}) * floor(abs({text[0]})))"
        if f == "ROUND":
            unit = self._literal(args[1]) if n > 1 else None
            if unit is not None or self._kind_of(args[0]) == "date":
                return self._round_date(text[0], masks.TRUNC_UNITS[(unit or "DD").upper()])
            return None
        if f == "ADD_MONTHS":
            return f"CASE WHEN cast({text[0]} as date) = last_day({text[0]}) THEN last_day(add_months({text[0]}, {text[1]})) ELSE add_months({text[0]}, {text[1]}) END"
        if f == "TO_NUMBER":
            return f"try_cast({text[0]} as decimal(38, 10))" if n == 1 else f"try_to_number({text[0]}, {text[1]})"
        if f == "MOD":
            return f"CASE WHEN {text[1]} = 0 THEN {text[0]} ELSE {text[0]} % {text[1]} END"
        return None

    @staticmethod
    def _plain_number(x: str) -> str:
        """A number as text without trailing zeros."""
        return f"regexp_replace(regexp_replace(cast({x} as string), '([.][0-9]*?)0+$', '$1'), '[.]$', '')"

    @staticmethod
    def _round_date(d: str, unit: str) -> str:
        start = f"date_trunc('{unit}', {d})"
        if unit == "YEAR":
            return f"CASE WHEN month({d}) >= 7 THEN {start} + INTERVAL 1 YEAR ELSE {start} END"
        if unit == "MONTH":
            return f"CASE WHEN day({d}) >= 16 THEN {start} + INTERVAL 1 MONTH ELSE {start} END"
        if unit == "QUARTER":
            return f"CASE WHEN month({d}) % 3 = 0 OR (month({d}) % 3 = 2 AND day({d}) >= 16) THEN {start} + INTERVAL 3 MONTH ELSE {start} END"
        if unit == "DAY":
            return f"CASE WHEN hour({d}) >= 12 THEN {start} + INTERVAL 1 DAY ELSE {start} END"
        raise Unsupported(f"ROUND to {unit}")


def reversed_pair(key: str) -> tuple[str, str]:
    """'name' and value of ``value AS name``."""
    value, _, name = key.rpartition(" AS ")
    return f"'{name}'", value


def lex_join(pieces: list[str]) -> str:
    """SQL pieces with spaces, but none around a dot."""
    out = ""
    for p in pieces:
        if p == "." or out.endswith(".") or not out:
            out += p
        elif p == ",":
            out += p
        else:
            out += " " + p
    return out


def to_spark_sql(text: str, **options: object) -> str:
    return Dialect(**options).query(text)
