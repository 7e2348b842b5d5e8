"""One tokenizer for report SQL and for PL/SQL bodies, and trees of parentheses."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""
    (?P<space>\s+)
  | (?P<comment>--[^\n]*|/\*.*?\*/)
  | (?P<string>[nN]?'(?:[^']|'')*')
  | (?P<quoted>"[^"]*")
  | (?P<outer>\(\s*\+\s*\))
  | (?P<bind>:(?=[A-Za-z"])[A-Za-z_][\w$\#]*)
  | (?P<lexical>&<?[A-Za-z_][\w$\#]*>?)
  | (?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+)
  | (?P<word>[^\W\d][\w$\#]*)
  | (?P<op>:=|=>|\|\||<>|!=|\^=|<=|>=|\*\*|\.\.|[^\s])
    """,
    re.X | re.S,
)


@dataclass
class Token:
    kind: str
    text: str

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text


@dataclass
class Group:
    """What stands between a pair of parentheses."""

    items: list = field(default_factory=list)
    kind: str = "group"
    upper: str = "("


def tokens(text: str) -> list[Token]:
    """All tokens but white space and comments; text inside literals is never looked at."""
    return [Token(m.lastgroup, m[0]) for m in _TOKEN.finditer(text) if m.lastgroup not in ("space", "comment")]


def tree(flat: Iterable[Token]) -> list:
    """Tokens with parentheses folded into groups."""
    stack: list[list] = [[]]
    for t in flat:
        if t.kind == "op" and t.text == "(":
            group = Group()
            stack[-1].append(group)
            stack.append(group.items)
        elif t.kind == "op" and t.text == ")":
            if len(stack) == 1:
                raise ValueError("unbalanced parenthesis")
            stack.pop()
        else:
            stack[-1].append(t)
    if len(stack) > 1:
        raise ValueError("unbalanced parenthesis")
    return stack[0]


def split(items: list, *words: str) -> list[list]:
    """Items cut at every top-level token among ``words``."""
    out: list[list] = [[]]
    for t in items:
        if t.upper in words and t.kind in ("word", "op"):
            out.append([])
        else:
            out[-1].append(t)
    return out


def is_word(item: object, *words: str) -> bool:
    return getattr(item, "kind", "") == "word" and item.upper in words


def text_of(items: Iterable) -> str:
    """Items as text again."""
    out: list[str] = []
    for t in items:
        piece = f"({text_of(t.items)})" if isinstance(t, Group) else t.text
        if out and (piece in ".,)" or out[-1].endswith(".")):
            out[-1] += piece
        else:
            out.append(piece)
    return " ".join(out)


def statement(text: str) -> str:
    """The first statement: up to a top-level semicolon, a line with a lone slash, or a PL/SQL block."""
    depth = 0
    for m in _TOKEN.finditer(text):
        if m[0] == "(":
            depth += 1
        elif m[0] == ")":
            depth -= 1
        elif depth == 0 and m[0] == ";":
            return text[: m.start()].strip()
        elif depth == 0 and m[0] == "/" and re.search(r"(?:^|\n)[ \t]*$", text[: m.start()]) and re.match(r"[ \t]*(?:\n|$)", text[m.end() :]):
            return text[: m.start()].strip()
        elif depth == 0 and m.lastgroup == "word" and m[0].upper() in ("DECLARE", "BEGIN") and m.start() > 0:
            return text[: m.start()].strip()
    return text.strip()


def binds(text: str) -> list[str]:
    """Names of the bind variables, in the order of first use."""
    return list(dict.fromkeys(t.text[1:].upper() for t in tokens(text) if t.kind == "bind"))


def lexicals(text: str) -> list[str]:
    return list(dict.fromkeys(t.text.strip("&<>").upper() for t in tokens(text) if t.kind == "lexical"))
