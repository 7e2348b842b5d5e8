"""PL/SQL bodies as Spark SQL expressions.

A body is run symbolically: variables and placeholders hold expressions, an IF
merges the two worlds with CASE, and RETURN ends a path. The result is one
expression for the value and one for each placeholder that the body sets.
Anything that cannot be resolved raises; nothing is guessed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from bandwright.functions.registry import UnknownFunction
from bandwright.plans import lex
from bandwright.plans.dialect import Dialect, Unsupported
from bandwright.plans.lex import Group, Token, is_word


class UntranslatableFormula(ValueError):
    """A body with no faithful expression."""


@dataclass
class Compiled:
    value: str | None
    placeholders: dict[str, str]
    styles: dict[str, str] = field(default_factory=dict)


@dataclass
class _World:
    env: dict[str, str]
    returned: list[tuple[str, str]] = field(default_factory=list)  # (condition, value), first match wins
    path: str = "TRUE"


def _and(a: str, b: str) -> str:
    return b if a == "TRUE" else a if b == "TRUE" else f"({a}) AND ({b})"


class Compiler:
    """names: how a bind or bare name of the report is written in SQL (column or parameter)."""

    def __init__(self, dialect: Dialect | None = None, names: Callable[[str], str] | None = None):
        self.dialect = dialect or Dialect()
        self.names = names or (lambda n: n)
        self.locals: dict[str, str] = {}

    def expression(self, items: list, env: dict[str, str]) -> str:
        def put(node: object) -> object:
            if isinstance(node, Group):
                return Group([put(x) for x in node.items])
            name = node.text.lstrip(":").upper()
            if node.kind == "bind" or node.kind == "word" and name in env:
                if name in env:
                    return Token("sql", f"({env[name]})" if not env[name].replace("_", "").isalnum() else env[name])
                return Token("sql", self.names(name))
            return node

        try:
            return self.dialect.expression([put(x) for x in self._power(items)])
        except (Unsupported, UnknownFunction) as e:
            raise UntranslatableFormula(str(e)) from e

    @staticmethod
    def _power(items: list) -> list:
        """a ** b as power(a, b)."""
        out: list = []
        i = 0
        while i < len(items):
            if getattr(items[i], "text", "") == "**":
                base = out.pop()
                out += [Token("word", "power"), Group([base, Token("op", ","), items[i + 1]])]
                i += 2
                continue
            out.append(items[i])
            i += 1
        return out

    def compile(self, body: str) -> Compiled:
        items = lex.tree(lex.tokens(body))
        declared, statements = self._body(items)
        world = _World(dict(declared))
        styles: dict[str, str] = {}
        self._run(statements, world, styles)
        value = None
        if world.returned:
            last = world.returned[-1]
            arms = [f"WHEN {c} THEN {v}" for c, v in world.returned if c != "TRUE"]
            default = last[1] if last[0] == "TRUE" else "NULL"
            value = f"CASE {' '.join(arms)} ELSE {default} END" if arms else default
        placeholders = {k: v for k, v in world.env.items() if k not in declared}
        return Compiled(value, placeholders, styles)

    def _body(self, items: list) -> tuple[dict[str, str], list]:
        """(declared locals with their first values, the statements between BEGIN and its END)."""
        at = next((i for i, t in enumerate(items) if is_word(t, "BEGIN")), None)
        if at is None:
            return {}, items
        head = items[:at]
        if is_word(head[0], "FUNCTION", "PROCEDURE") if head else False:
            cut = next((i for i, t in enumerate(head) if is_word(t, "IS", "AS")), len(head) - 1)
            head = head[cut + 1 :]
        declared: dict[str, str] = {}
        for line in lex.split([t for t in head if not is_word(t, "DECLARE")], ";"):
            if line and line[0].kind == "word":
                first = next((i for i, t in enumerate(line) if getattr(t, "text", "") == ":=" or is_word(t, "DEFAULT")), None)
                declared[line[0].upper] = self.expression(line[first + 1 :], declared) if first else "NULL"
        depth, end = 0, len(items)
        for i in range(at + 1, len(items)):
            t = items[i]
            if is_word(t, "IF", "LOOP", "CASE") and not is_word(items[i - 1], "END"):
                depth += 1
            elif is_word(t, "END"):
                follows = items[i + 1] if i + 1 < len(items) else None
                if depth and (is_word(follows, "IF", "LOOP", "CASE") or depth):
                    depth -= 1
                else:
                    end = i
                    break
            elif is_word(t, "EXCEPTION") and depth == 0:
                end = i
                break
        return declared, items[at + 1 : end]

    def _run(self, items: list, world: _World, styles: dict[str, str]) -> None:
        i = 0
        while i < len(items):
            t = items[i]
            if getattr(t, "text", "") == ";" or is_word(t, "NULL"):
                i += 1
            elif is_word(t, "IF"):
                i = self._if(items, i, world, styles)
            elif is_word(t, "RETURN"):
                end = self._until(items, i, ";")
                value = items[i + 1 : end]
                if value:
                    world.returned.append((world.path, self.expression(value, world.env)))
                i = end + 1
            elif is_word(t, "LOOP", "WHILE", "FOR", "OPEN", "FETCH", "EXECUTE", "SELECT", "INSERT", "UPDATE", "DELETE"):
                raise UntranslatableFormula(f"{t.upper} in a formula")
            else:
                end = self._until(items, i, ";")
                line = items[i:end]
                if len(line) >= 3 and getattr(line[1], "text", "") == ":=":
                    name = line[0].text.lstrip(":").upper()
                    value = self.expression(line[2:], world.env)
                    old = world.env.get(name, "NULL")
                    if world.returned:  # only rows that have not returned yet
                        gone = " OR ".join(f"({c})" for c, _ in world.returned)
                        value = f"CASE WHEN {gone} THEN {old} ELSE {value} END"
                    world.env[name] = value
                elif len(line) >= 4 and is_word(line[0], "SRW") and isinstance(line[3], Group):
                    self._style(line[2].text.lower(), line[3], world, styles)
                elif line:
                    raise UntranslatableFormula(f"statement {lex.text_of(line)[:60]}")
                i = end + 1

    def _style(self, call: str, args: Group, world: _World, styles: dict[str, str]) -> None:
        if call.startswith("set_"):
            value = self.expression(args.items, world.env)
            old = styles.get(call[4:], "NULL")
            styles[call[4:]] = value if world.path == "TRUE" else f"CASE WHEN {world.path} THEN {value} ELSE {old} END"
        elif call not in ("message", "run_report", "do_sql"):
            raise UntranslatableFormula(f"srw.{call}")

    @staticmethod
    def _until(items: list, i: int, mark: str) -> int:
        while i < len(items) and getattr(items[i], "text", "") != mark:
            i += 1
        return i

    def _if(self, items: list, i: int, world: _World, styles: dict[str, str]) -> int:
        """Runs an IF from items[i]; returns the place after its END IF."""
        arms: list[tuple[list | None, list]] = []
        at, condition, depth = i + 1, None, 0
        start = at
        while at < len(items):
            t = items[at]
            if is_word(t, "IF") and not is_word(items[at - 1], "END"):
                depth += 1
            elif is_word(t, "CASE") and not is_word(items[at - 1], "END"):
                depth += 1
            elif is_word(t, "END") and depth:
                depth -= 1
            elif depth == 0 and is_word(t, "THEN"):
                condition, start = items[start:at], at + 1
            elif depth == 0 and is_word(t, "ELSIF", "ELSEIF"):
                arms.append((condition, items[start:at]))
                start = at + 1
            elif depth == 0 and is_word(t, "ELSE"):
                arms.append((condition, items[start:at]))
                condition, start = None, at + 1
            elif depth == 0 and is_word(t, "END"):
                if not is_word(items[at + 1] if at + 1 < len(items) else None, "IF"):
                    raise UntranslatableFormula("IF without END IF")
                arms.append((condition, items[start:at]))
                break
            at += 1
        else:
            raise UntranslatableFormula("IF without END IF")
        before = dict(world.env)
        outcome: list[tuple[str | None, dict[str, str]]] = []
        passed = world.path
        for test, body in arms:
            text = None if test is None else self.expression(test, before)
            inner = _World(dict(before), world.returned, passed if text is None else _and(passed, text))
            self._run(body, inner, styles)
            outcome.append((text, inner.env))
            if text is not None:
                passed = _and(passed, f"NOT coalesce({text}, FALSE)")
        for name in dict.fromkeys(k for _, env in outcome for k in env):
            arms_text = " ".join(f"WHEN {text} THEN {env.get(name, 'NULL')}" for text, env in outcome if text is not None)
            default = next((env.get(name, "NULL") for text, env in outcome if text is None), before.get(name, "NULL"))
            if any(env.get(name) != before.get(name) for _, env in outcome):
                world.env[name] = f"CASE {arms_text} ELSE {default} END"
        end = at + 1
        if end < len(items) and is_word(items[end], "IF"):
            end += 1
        return end


def formula(body: str, names: Callable[[str], str] | None = None, **options: object) -> str:
    """The value of a formula body as one SQL expression."""
    done = Compiler(Dialect(**options), names).compile(body)
    if done.value is None:
        raise UntranslatableFormula("the body returns nothing")
    return done.value


def visibility(body: str, names: Callable[[str], str] | None = None, **options: object) -> str:
    """Whether an object is shown: what the trigger returns, shown when that is unknown."""
    return f"coalesce({formula(body, names, **options)}, TRUE)"


def single_fetch(body: str) -> str:
    """The scalar subquery of a cursor formula that fetches once: the largest value among the rows that come first in its order."""
    items = lex.tree(lex.tokens(body))
    at = [i for i, t in enumerate(items) if is_word(t, "CURSOR")]
    if len(at) != 1 or any(is_word(t, "LOOP", "FOR", "WHILE") for t in items):
        raise UntranslatableFormula("not a single fetch of one cursor")
    parts = lex.split(items, ";")
    select = next(p for p in parts if any(is_word(t, "CURSOR") for t in p))
    select = select[next(i for i, t in enumerate(select) if is_word(t, "SELECT")) :] if any(is_word(t, "SELECT") for t in select) else []
    fetch = next((p for p in parts if any(is_word(t, "FETCH") for t in p)), [])
    into = next((i for i, t in enumerate(fetch) if is_word(t, "INTO")), None)
    answer = next((p[1:] for p in reversed(parts) if p and is_word(p[0], "RETURN")), [])
    if len(answer) == 1 and isinstance(answer[0], Group):
        answer = answer[0].items
    source = next((i for i, t in enumerate(select) if is_word(t, "FROM")), None)
    if not select or into is None or source is None or not answer:
        raise UntranslatableFormula("the cursor is not read into what the body returns")
    names = [t.upper for t in answer if getattr(t, "kind", "") in ("word", "bind")]
    targets = [p[0].upper for p in lex.split(fetch[into + 1 :], ",")]
    columns = lex.split(select[1:source], ",")
    if len(names) == 2 and names[0] == targets[0]:  # a field of the record
        chosen = [c for c in columns if getattr(c[-1], "upper", "") == names[1]]
    else:
        chosen = [c for c, t in zip(columns, targets) if names == [t]]
    if len(chosen) != 1:
        raise UntranslatableFormula("the body returns something else than a fetched column")
    value = chosen[0]
    if len(value) > 2 and is_word(value[-2], "AS"):
        value = value[:-2]
    elif len(value) > 1 and getattr(value[-2], "text", ".") not in (".", "+", "-", "*", "/", "||"):
        value = value[:-1]  # an alias
    order = next((i for i in range(source, len(select) - 1) if is_word(select[i], "ORDER") and is_word(select[i + 1], "BY")), len(select))
    keep = f" KEEP (DENSE_RANK FIRST {lex.text_of(select[order:])})" if order < len(select) else ""
    return f"SELECT MAX({lex.text_of(value)}){keep} {lex.text_of(select[source:order])}"


def hyperlink(body: str) -> tuple[str, dict[str, str]] | None:
    """(report, {parameter: column}) of a trigger that sets a link to a report, from the literals and binds of its address."""
    items = lex.tree(lex.tokens(body))
    for i, t in enumerate(items):
        if getattr(t, "upper", "") in ("SET_HYPERLINK", "SET_FIELD_CHAR") and i + 1 < len(items) and isinstance(items[i + 1], Group):
            text = ""
            for part in (x for x in items[i + 1].items if isinstance(x, Token)):
                text += part.text[1:-1].replace("''", "'") if part.text.startswith("'") else f"\0{part.text[1:]}\0" if part.kind == "bind" else ""
            pairs = [p.partition("=") for p in text.partition("?")[2].replace("+", "&").split("&") if "=" in p]
            found = {k: v for k, _, v in pairs}
            report = next((v for k, v in found.items() if k.lower() == "report"), "")
            if report:
                return report.rpartition("/")[2].rpartition(".")[0] or report, {k: v.strip("\0") for k, v in found.items() if v.startswith("\0")}
    return None
