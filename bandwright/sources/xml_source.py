"""Report definitions from legacy XML.

Never raises: what cannot be read becomes a note. Document types and entities
are cut off before parsing, so nothing outside the text is expanded or read.
"""

from __future__ import annotations

import re
from xml.etree import ElementTree as ET

from bandwright.plans import lex
from bandwright.plans.model import Chart, Dataset, Field, Formula, Group, Item, Link, Matrix, Param, ReportDef, Summary, Trigger

ENCODINGS = ("utf-8", "cp1252", "latin-1")


def decode(data: bytes) -> str:
    """Bytes as text: the declared encoding, else the first that fits."""
    declared = re.match(rb"\s*<\?xml[^>]*encoding=[\"']([\w.-]+)", data)
    for name in (*([declared[1].decode("ascii")] if declared else ()), *ENCODINGS):
        try:
            return data.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    return data.decode("latin-1")


def _root(text: str) -> ET.Element | None:
    """The report element of a document or of the web page around it, without document types; else the document's root."""
    text = re.sub(r"<!DOCTYPE[^>\[]*(\[.*?\])?\s*>", "", text, flags=re.S | re.I)
    bare = re.sub(r"^\s*<\?xml.*?\?>", "", text, flags=re.S)
    no_comments = re.sub(r"<!--.*?-->", "", bare, flags=re.S)
    other = None
    for tried in (bare, no_comments, *(m[0] for t in (bare, no_comments) for m in re.finditer(r"<report\b.*?</report\s*>", t, re.S | re.I))):
        try:
            root = ET.fromstring(tried)
        except ET.ParseError:
            continue
        if root.tag == "report":
            return root
        inner = root.find(".//report")
        if inner is not None:
            return inner
        other = root if other is None else other
    return other


def kind(data: bytes) -> str:
    """'report', 'data model', 'other xml' or 'not xml'."""
    root = _root(decode(data))
    if root is None:
        return "not xml"
    if root.tag != "report":
        return "other xml"
    return "report" if root.find(".//layout") is not None else "data model"


def _number(value: str | None) -> int:
    return int(float(value)) if value and re.fullmatch(r"-?\d+(\.\d+)?", value) else 0


def _item(node: ET.Element) -> Item:
    inner = node.find("dataDescriptor")
    precision = node.get("precision") or (inner.get("precision") if inner is not None else None)
    scale = node.get("scale") or (inner.get("scale") if inner is not None else None)
    return Item(node.get("name", ""), node.get("datatype") or node.get("oracleDatatype") or "vchar2", node.get("defaultLabel", ""), _number(precision), _number(scale), (node.get("breakOrder") or "ascending").lower())


def _sources(matrix: ET.Element, part: str) -> list[str]:
    return [f.get("source", "") for p in matrix.iter(part) for f in p.iter("field")]


def _frame_matrix(m: ET.Element, frames: dict[str, str], datasets: list[Dataset], groups: dict[str, list[Item]]) -> Matrix | None:
    """A matrix that names its frames: columns go across the horizontal one, rows down the vertical one, and the first number of the other groups fills the cells."""
    across, down = (frames.get((m.get(k) or "").upper(), "").upper() for k in ("horizontalFrame", "verticalFrame"))
    if not groups.get(across) or not groups.get(down):
        return None
    home = next(d for d in datasets if any(g.name.upper() == across for g in d.groups))
    cells = [i.name for g in home.groups if g.name.upper() not in (across, down) for i in groups[g.name.upper()] if i.kind == "number"]
    return Matrix(m.get("name", ""), (groups[down][0].name,), groups[across][0].name, (), cells[0]) if cells else None


def _bands(root: ET.Element, groups: dict[str, list[Item]]) -> dict[ET.Element, tuple[str, ...]]:
    """For each matrix, the first columns of the groups whose frames stand around it."""
    out: dict[ET.Element, tuple[str, ...]] = {}

    def walk(node: ET.Element, keys: tuple[str, ...]) -> None:
        if node.tag == "repeatingFrame":
            keys += tuple(i.name for i in groups.get(node.get("source", "").upper(), [])[:1])
        if node.tag == "matrix":
            out[node] = keys
        for child in node:
            walk(child, keys)

    walk(root, ())
    return out


def _formats(node: ET.Element) -> tuple[tuple[str, tuple[tuple[str, str], ...]], ...]:
    """(condition label, style properties) of the format exceptions of a field, in document order."""
    out = []
    for e in node.iter("formatException"):
        style = {k: v for inner in (*e.iter("formatVisualSettings"), *e.iter("font")) for k, v in inner.attrib.items()}
        if e.get("label") and style:
            out.append((e.get("label", ""), tuple(sorted(style.items()))))
    return tuple(out)


def _fields(root: ET.Element) -> tuple[Field, ...]:
    """All placed columns, each with the group of the innermost frame around it; short-hand lists of fields too."""
    out: list[Field] = []

    def walk(node: ET.Element, group: str) -> None:
        if node.tag == "repeatingFrame":
            group = node.get("source", "")
        if node.tag == "field" and node.get("source"):
            out.append(Field(node.get("name") or f"F_{node.get('source')}", node.get("source", ""), node.get("formatMask", ""), node.get("formatTrigger", ""), node.get("visible", "yes") != "no", group, _formats(node)))
        for child in node:
            walk(child, group)

    walk(root, "")
    return tuple(out)


def _layout(root: ET.Element) -> str:
    if root.find(".//mailing") is not None or any(r.get("printDirection", "").lower() in ("acrossdown", "downacross") for r in root.iter("repeatingFrame")):
        return "labels"
    return "form" if root.find(".//formlike") is not None or any(r.get("maxRecordsPerPage") == "1" for r in root.iter("repeatingFrame")) else ""


def parse(data: bytes) -> ReportDef:
    notes: list[str] = []
    root = _root(decode(data))
    if root is None:
        return ReportDef("", notes=("not readable as XML",))
    if root.tag != "report":
        return ReportDef("", notes=(f"not a report: <{root.tag}>",))

    params = tuple(
        Param(
            p.get("name", ""),
            p.get("datatype", "character"),
            p.get("initialValue"),
            tuple(v.get("value", v.text or "") for v in p.iter("listOfValues") for v in v.iter("value")),
            p.get("display") == "no",
        )
        for p in root.iter("userParameter")
    )
    bodies = {f.get("name", "").upper(): (f.findtext("textSource") or f.findtext(".//textSource") or "") for f in root.iter("function")}
    datasets, formulas, summaries = [], [], []
    owner: dict[str, str] = {}
    own_items: dict[str, list[Item]] = {}
    for source in root.iter("dataSource"):
        name = source.get("name", "")
        sql = (source.findtext("select") or "").strip()
        items: dict[str, Item] = {}
        groups = []
        for group in source.iter("group"):
            own = [_item(i) for i in group.findall("dataItem")]
            for i in own:
                items.setdefault(i.name.upper(), i)
            owner[group.get("name", "").upper()] = name
            own_items[group.get("name", "").upper()] = own
            if own:
                groups.append(Group(group.get("name", ""), tuple(i.name for i in own), name))
        if not items and sql:
            items = {c.upper(): Item(c) for c in columns_of(sql)}
            notes.append(f"{name}: columns read from the SELECT list")
        if not sql:
            notes.append(f"{name}: no SQL, bind a table to it")
        datasets.append(Dataset(name, lex.statement(sql), tuple(items.values()), tuple(groups)))
        for f in source.iter("formula"):
            formulas.append(Formula(f.get("name", ""), bodies.get(f.get("source", "").upper(), f.findtext("textSource") or ""), name))
    for s in root.iter("summary"):
        reset = s.get("reset", "report")
        summaries.append(Summary(s.get("name", ""), s.get("source", ""), s.get("function", "sum"), reset, s.get("compute", "report")))
    links = []
    for link in root.iter("link"):
        parent = owner.get(link.get("parentGroup", "").upper(), link.get("parentGroup", ""))
        child = link.get("childQuery", "")
        pair = (link.get("parentColumn"), link.get("childColumn"))
        pairs: tuple[tuple[str, str], ...] = (pair,) if all(pair) else ()
        if not pairs:
            pairs = bind_pairs(datasets, parent, child)
        links.append(Link(parent, child, pairs))
        if not pairs:
            notes.append(f"link {parent} to {child}: no columns found")
    matrices = []
    bands = _bands(root, own_items)
    for m in root.iter("matrix"):
        rows, cols, cells = (_sources(m, p) for p in ("matrixRow", "matrixCol", "matrixCell"))
        if rows and cols and cells:
            by = {s.name.upper(): s for s in summaries}
            filled = tuple((s.source, s.function) if (s := by.get(c.upper())) else (c, "sum") for c in cells)
            band = tuple(k for k in bands.get(m, ()) if k not in (*rows, *cols))
            matrices.append(Matrix(m.get("name", ""), tuple(rows), cols[0], (), *filled[0], band=band, columns=tuple(cols), cells=filled))
        elif framed := _frame_matrix(m, {r.get("name", "").upper(): r.get("source", "") for r in root.iter("repeatingFrame")}, datasets, own_items):
            matrices.append(framed)
        else:
            notes.append(f"{m.get('name', 'matrix')}: rows, columns or cells not found")
    charts = [Chart(g.get("name", "chart"), g.get("groups", ""), g.get("dataValues", ""), g.get("title", "")) for g in root.iter("graph")]
    for c in re.finditer(r"<rw:graph\b([^>]*)", decode(data)):
        at = dict(re.findall(r"(\w+)=\"([^\"]*)\"", c[1]))
        charts.append(Chart(at.get("id", "chart"), at.get("groups", ""), at.get("dataValues", ""), at.get("title", "")))
    texts = tuple((t.get("name", ""), "".join(x.text or "" for x in t.iter("string"))) for t in root.iter("text"))
    triggers = tuple(Trigger(n, b) for n, b in bodies.items() if b and n.lower() not in {f.name.lower() for f in formulas})
    records = max((_number(r.get("maxRecordsPerPage")) for r in root.iter("repeatingFrame")), default=0)
    return ReportDef(root.get("name", ""), params, tuple(datasets), tuple(links), tuple(formulas), tuple(summaries), tuple(matrices), tuple(charts), triggers, _fields(root), records, tuple(notes), tuple(t for t in texts if "&" in t[1]), _layout(root))


def columns_of(sql: str) -> list[str]:
    """Names of the items of a SELECT list."""
    items = lex.tree(lex.tokens(lex.statement(sql)))
    if not items or not lex.is_word(items[0], "SELECT"):
        return []
    end = next((i for i, t in enumerate(items) if lex.is_word(t, "FROM")), len(items))
    out = []
    for part in lex.split(items[1:end], ","):
        part = [t for t in part if not lex.is_word(t, "DISTINCT")]
        if part and getattr(part[-1], "kind", "") in ("word", "quoted") and part[-1].text.upper() not in ("END", "NULL"):
            out.append(part[-1].text.strip('"'))
    return out


def bind_pairs(datasets: list[Dataset], parent: str, child: str) -> tuple[tuple[str, str], ...]:
    """(parent column, child column) for each bind of the child's SQL that names a parent column."""
    by = {d.name.upper(): d for d in datasets}
    if parent.upper() not in by or child.upper() not in by:
        return ()
    have = {i.name.upper(): i.name for i in by[parent.upper()].items}
    out, flat = [], lex.tokens(by[child.upper()].sql)
    name = lambda i: flat[i].text if 0 <= i < len(flat) and flat[i].kind in ("word", "quoted") else ""
    for i, t in enumerate(flat):
        if t.kind == "bind" and t.text[1:].upper() in have:
            key = have[t.text[1:].upper()]
            if i >= 2 and flat[i - 1].text == "=" and name(i - 2):
                out.append((key, name(i - 2)))
            elif name(i + 2) and flat[i + 1].text == "=":
                out.append((key, name(i + 4) if i + 4 < len(flat) and flat[i + 3].text == "." else name(i + 2)))
            else:  # no column of the child equals it: the engine joins each parent row laterally
                out.append((key, ""))
    tied = {key for key, column in out if column}
    return tuple(dict.fromkeys(p for p in out if p[1] or p[0] not in tied))
