"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: tags in their path of open elements, and block
texts in theirs. Tokens of one host that occur in the same pages, once in each,
share an occurrence vector and form an equivalence class, over all pages of the
host or over some of them (a second layout, a series, an optional box). A class
needs MIN_PAGES pages and MIN_TOKENS tokens, and its tokens must come in the
same order on all of its pages.

Classes nest by their sets of pages: the parent of a class is the smallest class
that spans all of its pages and more. The tokens of the parent cut each page
into slots; a token of the class is template only where it stands in the same
slot of the parent on every page (tokens of one class may stand in several
slots, as the parts of a layout do). Texts that are template go, wherever they
stand: menus, notices and footers that a host repeats need no word list. What
stands between the tokens are the slots. Pages of a host of less than MIN_PAGES
pages, and slots whose menus and adverts change from page to page, need more
evidence: slots in elements that are menus, headers, footers, sidebars, forms
and so on by the element's name or role, or by a class name or id that says
nothing else (``ad``, ``share-bar``, not ``social-history``), are left out. The
texts of the other slots are the main text, on pages with an article or main
element those inside it. An article in a left-out part (a teaser in a sidebar)
is left out too, unless it alone has LONG_TEXT code points: then what looked
like a sidebar is a wrapper.

Pages are read in one pass from tag to tag; a tag whose quotes never close ends
at its first ``>``, and after QUOTE_FAILURES of these a page's quotes are not
followed any more, so a broken page costs no more than a sound one.

Vectors are never gathered: two sums of hashed page numbers stand for a vector,
so classes come from one aggregation over tokens. Orders and page sets come from
the classes that meet on a page, aggregated by pair. Tables of tokens are
broadcast only when counted and at most ``BROADCAST_TEXTS``.

Texts of a class stay if they and those of the classes around it are half or
more of the text in the other slots of its pages, so pages that are copies of each other lose
nothing.

Defined results: a null or empty html gives an empty text; a page without a
host (null or odd url) has no template; repeated rows count as pages of their
own and give equal texts; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwright.llm.store import small_batches, written

MIN_PAGES = 5
MIN_TOKENS = 3
BROADCAST_TEXTS = 200_000
LONG_TEXT = 140
QUOTE_FAILURES = 16

# Element names of HTML, and words of class names, roles and ids.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre
    section summary table tbody td tfoot th thead tr ul video xmp""".split()
)
RAW = frozenset("script style textarea title noscript template iframe noembed svg select".split())
LEFT_OUT = frozenset("head nav header footer aside form menu button dialog fieldset label object video audio canvas map".split())
LEFT_OUT_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice
    notices notification alert newsletter subscribe subscription popup modal overlay sidebar sidenav widget widgets menu nav navbar
    navigation breadcrumb breadcrumbs masthead header footer related recommended share sharing social toolbar login signup search
    pagination pager skip""".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion reactions".split())
# words beside these in a class name or id that leave its meaning as it is
NEUTRAL_WORDS = frozenset(
    """area bar bars block bottom box button buttons col column container desktop entry fixed form global group icon icons inline inner item
    items js left link links list main mobile outer page panel post posts primary reader readers right row secondary section signup site slot
    sticky sub text top unit user users wrap wrapper""".split()
)
ROLES_LEFT_OUT = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
QUOTE_OR_END = re.compile("['\">]")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
NAME_WORD = re.compile(r"[a-z]+")
HEADING = re.compile(r"^header\s*$|^(?:header|div|section)\s[^>]*\bclass=[\"']?(?:article|post|entry|story|content|page)[-_]?(?:header|heading|title)\b", re.I)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)} if raw else {}


def _says(names: list[set[str]], words: frozenset[str]) -> bool:
    """Whether some name consists of one of ``words`` and neutral words."""
    return any(n & words and n <= words | NEUTRAL_WORDS for n in names)


def _reason(tag: str, raw: str) -> str:
    """Why an element is left out: '', 'part' or 'comments'."""
    names: list[set[str]] = []
    role = ""
    if raw and "=" in raw:
        found = _attributes(raw)
        names = [set(NAME_WORD.findall(name)) for name in f"{found.get('class', '')} {found.get('id', '')}".lower().split()]
        role = found.get("role", "").lower()
        if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
            return "part"
    if _says(names, COMMENT_WORDS):
        return "comments"
    if tag in ("html", "body", "main", "article", "h1", "h2", "h3", "h4", "h5", "h6", "p"):
        return "part" if tag == "p" and _says(names, LEFT_OUT_WORDS) else ""
    if tag in LEFT_OUT or role in ROLES_LEFT_OUT or _says(names, LEFT_OUT_WORDS):
        return "part"
    return ""


class Tags:
    """The tags of a page, found one after the other in time linear in the page."""

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.cdata = page.rfind("]]>")
        self.failures = 0

    def end(self, at: int) -> int:
        """Where the tag with attributes from ``at`` ends: at a > outside of quotes."""
        start = at
        while self.failures < QUOTE_FAILURES:
            m = QUOTE_OR_END.search(self.page, at)
            if m and m[0] == ">":
                return m.start()
            at = self.page.find(m[0], m.end()) + 1 if m else 0
            if not at:
                self.failures += 1
                break
        return self.page.find(">", start)

    def next(self, at: int) -> tuple[int, int, re.Match | None, str]:
        """(start, end, tag or None, attributes of a tag or text of a CDATA section) of the next mark-up from ``at``."""
        page = self.page
        while (at := page.find("<", at)) >= 0 and at < self.last:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(page), None, ""
            if page.startswith("<![CDATA[", at) and at < self.cdata:
                end = page.find("]]>", at)
                return at, end + 3, None, page[at + 9 : end]
            if page.startswith(("<!", "<?"), at):
                return at, page.find(">", at) + 1, None, ""
            m = TAG.match(page, at)
            if m and m.end() <= self.last:
                end = self.end(m.end())
                return at, end + 1, m, page[m.end() : end]
            at += 1
        return len(page), len(page), None, ""


def parse(page: str, by_names: bool = True) -> list[tuple[int, str | None, bool]]:
    """(path, text or None for a tag, whether it can be main text) of the tags and block texts of a page, in page order; without ``by_names`` every text can."""
    stack: list[tuple[str, str, bool, int]] = []  # tag, reason inherited ('nested': in an article of a left-out part), inside an article, path
    open_: dict[str, int] = {}
    found: list[tuple[int, str | None, str]] = []  # the last is '', 'inside', 'out' or 'nested'
    pieces: list[str] = []
    reason, inside, article, at, path = "", False, False, 0, 0
    tags = Tags(page)

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                found.append((path, text, "nested" if reason == "nested" else "out" if reason else "inside" if inside else ""))

    def pop_to(depth: int) -> None:
        nonlocal reason, inside, path
        if any(t in BLOCK for t, _, _, _ in stack[depth:]):
            flush()
        for t, _, _, _ in stack[depth:]:
            open_[t] -= 1
        del stack[depth:]
        reason, inside, path = stack[-1][1:] if stack else ("", False, 0)

    while at < len(page):
        start, end, m, raw = tags.next(at)
        if start > at:
            pieces.append(page[at:start])
        at = end
        if m is None:
            if raw:
                pieces.append(raw)
            continue
        tag = m[2].lower()
        if m[1]:
            if open_.get(tag):
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == tag:
                        pop_to(depth)
                        break
                    if tag not in BLOCK and stack[depth][0] in BLOCK:
                        break
            continue
        if tag in RAW and not raw.endswith("/"):
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            if tag in BLOCK:
                flush()
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCK:
            flush()
            closes = ("p",) if tag not in ("li", "dd", "dt", "td", "th", "tr", "option") else ("p", tag)
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in closes:
                    pop_to(depth)
                if depth < len(stack) and stack[depth][0] in BLOCK:
                    break
        if tag in VOID or raw.endswith("/"):
            continue
        own = _reason(tag, raw) if by_names else ""
        if tag in ("article", "main") and not own and reason == "part":
            reason = "nested"
        if own == "part" and (inside or reason == "nested") and HEADING.search(f"{tag} {raw}"):
            own = ""  # the article's own heading
        if by_names and tag in ("article", "main") and not (own or reason):
            inside = article = True
        reason = "comments" if "comments" in (own, reason) else own or reason
        if tag in BLOCK:
            path = xxhash.xxh64_intdigest(f"{path}/{tag}")
        stack.append((tag, reason, inside, path))
        open_[tag] = open_.get(tag, 0) + 1
        if tag in BLOCK:
            found.append((path, None, ""))
    flush()
    here = {"inside"} if article else {""}
    if sum(len(t or "") for _, t, place in found if place == "nested") >= LONG_TEXT > sum(len(t or "") for _, t, place in found if place in here):
        here = {"nested"} if not article else {"inside", "nested"}
    return [(path, text, text is not None and place in here) for path, text, place in found]


def _token(host: str, path: int, text: str | None) -> int:
    return xxhash.xxh64_intdigest(f"{host}\0{path}" if text is None else f"{host}\0{path}\0{text}") - (1 << 63)


def _tokens(batches: Iterator[pa.RecordBatch], by_names: bool = True) -> Iterator[pa.RecordBatch]:
    """(page, key, token, at, count, is_text, size, page_size) for the tokens of (page, key, host, html): first position, occurrences, code points of what can be main text."""
    for batch in batches:
        rows: list[tuple[int, ...]] = []
        for page, key, host, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            seen: dict[int, list[int]] = {}
            for at, (path, text, kept) in enumerate(parse(value, by_names)):
                seen.setdefault(_token(host, path, text), [at, 0, int(text is not None), len(text) if kept else 0])[1] += 1
            whole = sum(count * size for _, count, _, size in seen.values())
            rows += [(page, key, token, at, count, is_text, size, whole) for token, (at, count, is_text, size) in seen.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["page", "key", "token", "at", "count", "is_text", "size", "page_size"])


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(inner, outer, page_size, sequence) for the classes of (found, page_size): each with itself and with those of more pages."""
    for batch in batches:
        rows: list[tuple[int, int, int, int]] = []
        for tokens, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            classes: dict[int, list[int]] = {}
            pages: dict[int, int] = {}
            for t in tokens:
                classes.setdefault(t["class"], []).append(t["token"])
                pages[t["class"]] = t["pages"]
            for c, own in classes.items():
                rows.append((c, c, whole, xxhash.xxh64_intdigest(",".join(map(str, own))) - (1 << 63)))
                rows += [(c, other, whole, 0) for other in classes if pages[other] > pages[c]]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["inner", "outer", "page_size", "sequence"])


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, slot) for the texts of (found): the slot is the number of tokens of the parent class before."""
    for batch in batches:
        rows: list[tuple[int, int]] = []
        for tokens in batch.column(0).to_pylist():
            before: dict[int, int] = {}
            for t in tokens:
                if t["is_text"]:
                    rows.append((t["token"], before.get(t["parent"], 0)))
                before[t["class"]] = before.get(t["class"], 0) + 1
        columns = list(zip(*rows, strict=True)) or [[]] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["token", "slot"])


def _template(found: DataFrame, broadcast_texts: int) -> DataFrame:
    """(token) of the template texts."""
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_texts else df
    mark = F.xxhash64("page")
    vectors = found.groupBy("token").agg(F.sum(F.shiftrightunsigned(mark, 33)).alias("high"), F.sum(mark.bitwiseAND(0x7FFFFFFF)).alias("low"), F.count("*").alias("pages"), F.sum("count").alias("count"), F.max("is_text").alias("is_text"), F.max("size").alias("size"))
    vectors = written(vectors.where(f"count = pages and pages >= {MIN_PAGES}").select("token", "pages", "is_text", "size", F.xxhash64("high", "low").alias("class")), "vectors")
    classes = vectors.groupBy("class").agg(F.count("*").alias("tokens"), F.max("pages").alias("pages"), F.sum("size").alias("size")).where(f"tokens >= {MIN_TOKENS}")
    classes = small(written(classes.drop("tokens"), "classes"))
    members = small(written(vectors.join(classes.select("class"), "class"), "members"))

    placed = written(found.select("page", "token", "at", "page_size").join(members, "token"), "placed")
    by_page = placed.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("at", "class", "token", "pages"))).alias("found"), F.first("page_size").alias("page_size"))
    met = by_page.select("found", "page_size").mapInArrow(_meetings, "inner long, outer long, page_size long, sequence long")
    met = written(met.groupBy("inner", "outer").agg(F.count("*").alias("n"), F.sum("page_size").alias("whole"), (F.min("sequence") == F.max("sequence")).alias("ordered")), "meetings")
    ordered = met.where("inner = outer and ordered").select(F.col("inner").alias("class"), "whole").join(classes, "class")
    outer = ordered.select(F.col("class").alias("outer"), F.col("pages").alias("outer_pages"), F.col("size").alias("outer_size"))
    above = met.where("inner <> outer").join(outer, "outer").join(classes.select(F.col("class").alias("inner"), "pages"), "inner").where("n = pages")
    above = above.groupBy(F.col("inner").alias("class")).agg(F.min(F.struct("outer_pages", "outer")).alias("parent"), F.sum("outer_size").alias("outer_size"))
    nested = ordered.join(above, "class", "left").withColumn("little", F.expr("2 * pages * (size + coalesce(outer_size, 0)) < whole"))
    nested = small(written(nested.select("class", "parent.outer", "little"), "nested"))

    standing = placed.join(nested, "class").select("page", F.struct("at", "class", "token", F.when(F.col("little"), F.col("is_text")).otherwise(0).alias("is_text"), F.col("outer").alias("parent")).alias("found"))
    slots = standing.groupBy("page").agg(F.sort_array(F.collect_list("found")).alias("found")).select("found").mapInArrow(_slots, "token long, slot long")
    return written(slots.groupBy("token").agg(F.min("slot").alias("low"), F.max("slot").alias("high")).where("low = high").select("token"), "template")


def extract(df: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", broadcast_texts: int = BROADCAST_TEXTS, by_names: bool = True) -> DataFrame:
    """(id, url, text, n_chars) for every page; without ``by_names`` the templates alone decide."""
    small_batches(df.sparkSession)
    host = F.nullif(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    pages = df.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))

    key = F.xxhash64("host", "html")
    hosted = pages.where("host is not null and html is not null").select(F.monotonically_increasing_id().alias("page"), key.alias("key"), "host", "html")
    found = written(hosted.mapInArrow(lambda batches: _tokens(batches, by_names), "page long, key long, token long, at long, count long, is_text long, size long, page_size long"), "tokens")
    template = _template(found, broadcast_texts)
    few = template.count() <= broadcast_texts
    known = frozenset(r.token for r in template.collect()) if few else frozenset()
    if few:
        joined = pages.withColumn("template", F.lit(None).cast("array<long>"))
    else:
        of_page = found.select("key", "token").join(template, "token").groupBy("key").agg(F.collect_set("token").alias("template"))
        joined = pages.withColumn("key", key).join(of_page, "key", "left")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, value, template in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                gone = known if template is None else set(template)
                out.append("\n".join(text for path, text, kept in parse(value or "", by_names) if kept and not (gone and name and _token(name, path, text) in gone)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["id", "url", "text"])

    kind = dict(pages.dtypes)["id"]
    done = joined.select("id", F.col("url").cast("string"), "host", "html", "template").mapInArrow(texts, f"id {kind}, url string, text string")
    return done.select(F.col("id").alias(id_col), "url", "text", F.length("text").cast("long").alias("n_chars"))
