"""User functions of reports: names to SQL builders, with arity checks.

A report calls helpers of its own database (``Pkg.F_Phone(x)``). The easy ones
have a builder here; a hard one must be supplied, or the call is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field


class UnknownFunction(ValueError):
    """A call of a function nobody supplied."""


def _address(street1: str, street2: str, city: str, state: str, zip_code: str) -> str:
    line = f"concat_ws(', ', nullif({street1}, ''), nullif({street2}, ''), nullif({city}, ''))"
    return f"concat_ws(' ', concat_ws(', ', nullif({line}, ''), nullif({state}, '')), nullif({zip_code}, ''))"


def _phone(x: str) -> str:
    digits = f"regexp_replace({x}, '[^0-9]', '')"
    return f"case when length({digits}) = 10 then concat('(', substr({digits}, 1, 3), ') ', substr({digits}, 4, 3), '-', substr({digits}, 7, 4)) else {x} end"


def _delimited(x: str, mark: str) -> str:
    return f"case when length({x}) > 0 then concat({x}, {mark}) else '' end"


def _url(x: str) -> str:
    return f"replace(url_encode({x}), '+', '%20')"


def _long_date(d: str) -> str:
    return f"date_format({d}, 'MMMM dd, yyyy')"


def _trimmed(x: str) -> str:
    return f"nullif(trim({x}), '')"


def _format_address(street1: str, street2: str, city: str, state: str, zip_code: str, zip4: str) -> str:
    lines = [f"nullif(concat_ws(', ', {_trimmed(a)}, {_trimmed(b)}), '')" for a, b in ((street1, street2), (city, state))]
    return f"concat_ws(' ', {lines[0]}, {lines[1]}, concat_ws('-', {_trimmed(zip_code)}, {_trimmed(zip4)}))"


def _organisation(business: str, first: str, middle: str, last: str, style: str) -> str:
    own = f"concat_ws(' ', {_trimmed(first)}, concat({_trimmed(middle)}, '.'))"
    return f"coalesce({_trimmed(business)}, nullif(concat_ws(', ', {_trimmed(last)}, nullif({own}, '')), ''))"


@dataclass
class Registry:
    builders: dict[str, tuple[int, Callable[..., str]]] = field(default_factory=dict)
    constants: dict[str, object] = field(default_factory=dict)

    def add(self, name: str, arity: int, builder: Callable[..., str]) -> None:
        self.builders[name.upper()] = (arity, builder)

    def add_lookup(self, name: str, table: str, key: str, value: str, default: Callable[[str], str] | None = None) -> None:
        """A function that reads one value of a table by its key; ``default`` makes SQL from the argument where there is none.

        A correlated subquery with one aggregate, which Spark runs as one aggregation of the table and one join.
        """

        def builder(x: str) -> str:
            found = f"(SELECT max(_t.{value}) FROM {table} _t WHERE _t.{key} = {x})"
            return f"coalesce({found}, {default(x)})" if default else found

        self.add(name, 1, builder)

    def add_list(self, name: str, table: str, keys: Sequence[str], value: str) -> None:
        """A function of the keys and a delimiter that joins a table's values for these keys, in order."""

        def builder(*args: str) -> str:
            same = " AND ".join(f"_t.{k} = {x}" for k, x in zip(keys, args, strict=False))
            return f"(SELECT array_join(array_sort(collect_list(cast(_t.{value} AS string))), {args[-1]}) FROM {table} _t WHERE {same})"

        self.add(name, len(keys) + 1, builder)

    def knows(self, name: str) -> bool:
        return name.upper().rpartition(".")[2] in self.builders

    def call(self, name: str, args: list[str]) -> str:
        short = name.upper().rpartition(".")[2]
        if short == "F_VAL" and args and args[0].strip("'").upper() in self.constants:
            value = self.constants[args[0].strip("'").upper()]
            return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"
        if short not in self.builders:
            raise UnknownFunction(f"function {name} is not supplied")
        arity, builder = self.builders[short]
        if arity != len(args):
            raise UnknownFunction(f"function {name} takes {arity} arguments, not {len(args)}")
        return builder(*args)


def standard() -> Registry:
    out = Registry()
    out.add("F_ADDRESS", 5, _address)
    out.add("F_PHONE", 1, _phone)
    out.add("F_ADD_DELIMITER", 2, _delimited)
    out.add("F_URL_ESCAPE", 1, _url)
    out.add("F_LONG_DATE", 1, _long_date)
    out.add("F_FORMAT_ADDRESS", 6, _format_address)
    out.add("F_FORMAT_ORG_NAME", 5, _organisation)
    out.add("F_TO_PHONE", 1, _phone)
    out.add("ESCAPE", 1, _url)
    out.add("F_ORG_NAME", 1, lambda x: f"initcap(trim({x}))")
    return out
