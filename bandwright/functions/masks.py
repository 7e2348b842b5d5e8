"""Format masks of the source dialect as Spark SQL expressions."""

from __future__ import annotations

import re

# Elements of a date mask and their Java patterns, padded and unpadded (after FM).
DATE_ELEMENTS = {
    "YYYY": ("yyyy", "yyyy"),
    "RRRR": ("yyyy", "yyyy"),
    "YY": ("yy", "yy"),
    "RR": ("yy", "yy"),
    "MONTH": ("MMMM", "MMMM"),
    "MON": ("MMM", "MMM"),
    "MM": ("MM", "M"),
    "DDD": ("DDD", "D"),
    "DAY": ("EEEE", "EEEE"),
    "DY": ("EEE", "EEE"),
    "DD": ("dd", "d"),
    "HH24": ("HH", "H"),
    "HH12": ("hh", "h"),
    "HH": ("hh", "h"),
    "MI": ("mm", "m"),
    "SS": ("ss", "s"),
    "AM": ("a", "a"),
    "PM": ("a", "a"),
    "A.M.": ("a", "a"),
    "P.M.": ("a", "a"),
    "Q": ("q", "q"),
}
# Elements that no pattern letter gives, as SQL of the date {0}.
DATE_EXPRESSIONS = {
    "IYYY": "lpad(extract(YEAROFWEEK FROM {0}), 4, '0')",
    "IW": "lpad(weekofyear({0}), 2, '0')",
    "WW": "lpad((dayofyear({0}) - 1) div 7 + 1, 2, '0')",
    "W": "cast((day({0}) - 1) div 7 + 1 as string)",
    "J": "cast(datediff({0}, date'1970-01-01') + 2440588 as string)",
    "D": "cast(dayofweek({0}) as string)",
    "CC": "lpad((year({0}) + 99) div 100, 2, '0')",
    "SSSSS": "lpad(hour({0}) * 3600 + minute({0}) * 60 + second({0}), 5, '0')",
}
_ELEMENT = re.compile("|".join(sorted(map(re.escape, {**DATE_ELEMENTS, **DATE_EXPRESSIONS}), key=len, reverse=True)), re.I)


class UnknownMask(ValueError):
    """A mask with an element that has no meaning here."""


TRUNC_UNITS = {"YYYY": "YEAR", "YEAR": "YEAR", "YY": "YEAR", "Y": "YEAR", "Q": "QUARTER", "MM": "MONTH", "MONTH": "MONTH", "MON": "MONTH", "DD": "DAY", "DDD": "DAY", "J": "DAY", "IW": "WEEK", "HH": "HOUR", "HH24": "HOUR", "MI": "MINUTE"}


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def date_parts(mask: str) -> tuple[list[tuple[str, str]], str]:
    """([('pattern', Java pattern) or ('sql', expression of {0})], 'upper', 'lower' or '') of a date mask. Each FM flips the padding of what follows."""
    out: list[tuple[str, str]] = []
    at, bare, case, clock = 0, False, "", False

    def put(pattern: str) -> None:
        if out and out[-1][0] == "pattern":
            out[-1] = ("pattern", out[-1][1] + pattern)
        else:
            out.append(("pattern", pattern))

    while at < len(mask):
        if mask[at : at + 2].upper() == "FM":
            bare, at = not bare, at + 2
            continue
        if mask[at] == '"':
            end = mask.find('"', at + 1)
            end = len(mask) if end < 0 else end
            put("'" + mask[at + 1 : end].replace("'", "''") + "'")
            at = end + 1
            continue
        m = _ELEMENT.match(mask, at)
        if m:
            name = m[0].upper()
            if name in DATE_EXPRESSIONS:
                out.append(("sql", DATE_EXPRESSIONS[name]))
            else:
                put(DATE_ELEMENTS[name][bare])
            clock = clock or name[:2] in ("HH", "MI", "SS", "AM", "PM", "A.", "P.")
            if name in ("MONTH", "MON", "DAY", "DY"):
                case = "upper" if m[0].isupper() else "lower" if m[0].islower() else ""
            at = m.end()
            continue
        c = mask[at]
        if c.isalnum():
            raise UnknownMask(f"date mask {mask}: {mask[at:]}")
        put("''" if c == "'" else c)
        at += 1
    return out, "" if clock else case


def date_pattern(mask: str) -> tuple[str, str]:
    """(Java pattern, case) of a date mask that is all pattern."""
    parts, case = date_parts(mask)
    if any(kind == "sql" for kind, _ in parts):
        raise UnknownMask(f"date mask {mask} has elements beside a pattern")
    return "".join(p for _, p in parts), case


def is_date_mask(mask: str) -> bool:
    rest = _ELEMENT.sub("", re.sub(r'"[^"]*"|FM', "", mask, flags=re.I))
    return bool(_ELEMENT.search(mask)) and not re.search(r"[A-Za-z0-9$]", rest)


def date_text(expr: str, mask: str) -> str:
    """SQL text of a date in a mask, with the case that a spelled-out name asks for."""
    parts, case = date_parts(mask)
    texts = [f"date_format({expr}, {quote(p)})" if kind == "pattern" else p.format(expr) for kind, p in parts]
    shown = texts[0] if len(texts) == 1 else f"concat({', '.join(texts)})"
    return f"{case}({shown})" if case else shown


def number_pattern(mask: str) -> tuple[str, int] | None:
    """(Java pattern, decimals) of a number mask, or None if it isn't one."""
    body = re.sub("^FM", "", mask.strip(), flags=re.I).upper()
    if not body or not re.fullmatch(r"[$LB]?[N90G,D.]*[90N][N90G,D.V]*(?:%|MI|PR|S|EEEE)?|S[90G,D.]+", body):
        return None
    sign = next((s for s in ("MI", "PR", "EEEE", "%") if body.endswith(s)), "S" if body.startswith("S") or body.endswith("S") else "")
    body = body.removesuffix(sign).removeprefix("S") if sign else body
    money = body.startswith(("$", "L"))
    body = body.lstrip("$LB").replace("G", ",").replace("D", ".").replace("N", "9")
    whole, _, part = body.partition(".")
    first_zero = whole.find("0")
    grouped = "," in whole
    digits = whole.replace(",", "")
    zeros = len(digits) - len(whole[:first_zero].replace(",", "")) if first_zero >= 0 else 0
    zeros = zeros if zeros or part else 1  # 999.99 shows no 0 before the point
    shown = "0" * zeros or "#"
    if grouped:
        size = len(whole) - whole.rfind(",") - 1
        shown = "#" * max(0, size + 1 - len(shown)) + shown if len(shown) <= size else shown
        shown = shown[:-size] + "," + shown[-size:]
    if sign == "EEEE":
        return f"0.{'0' * len(part)}E00" if part else "0E00", -1
    java = ("$" if money else "") + shown + ("." + "0" * len(part) if part else "")
    if sign == "MI":
        java = f"{java};{java}-"
    elif sign == "PR":
        java = f"{java};<{java}>"
    elif sign == "S":
        java = f"+{java};-{java}"
    elif sign == "%":
        java += "'%'"
    return java, len(part)


def number_text(expr: str, mask: str) -> str:
    """SQL text of a number in a mask, rounded half up first; an unknown mask leaves the value as text."""
    found = number_pattern(mask)
    if found is None:
        return f"cast({expr} as string)"
    java, places = found
    if places < 0:
        return f"format_number({expr}, {quote(java)})"
    value = f"round(cast({expr} as decimal(38, 10)), {places})"
    body = re.sub("^FM", "", mask.strip(), flags=re.I)
    digits = len(re.findall("[90N]", re.split(r"[.D]", body.upper().removesuffix("PR").removesuffix("MI"))[0]))
    width = len(body) + (0 if re.search(r"^S|(?:S|MI|PR)$", body, re.I) else 1)
    return f"CASE WHEN abs({value}) >= 1e{digits} THEN '{'#' * width}' ELSE format_number({value}, {quote(java)}) END"
