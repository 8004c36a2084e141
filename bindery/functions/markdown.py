"""HTML clean-up and Markdown rendering as Arrow-batched column functions.

Spark distributes the pages; the Python side is a small per-page helper: balance the
tags, pick the main region, skip boilerplate subtrees, render what is left.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements and class patterns removed by default.
STRIP_TAGS = ("nav", "footer", "header", "aside", "script", "style", "noscript", "iframe")
STRIP_CLASSES = ("sidebar", "navigation", "nav", "menu", "toc", "breadcrumb")

CONVERTED = "markdown string, region string, status string, error string"
#: Bytes of pages that a worker holds as Python objects at a time.
_SLICE = 1 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>script|style|textarea|title|iframe|xmp)(?P<rawattrs>(?:[\s/][^>]*)?)>(?P<body>.*?)(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_STYLING = re.compile(r"(?<!\s)\s++(?:class|style)\s*(?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/>]|\Z)", re.I)
_BLANKS = re.compile(r"[ \t\r\n\f]{2,}|[\t\r\n\f]")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
# A start tag (left) ends an open tag of the listed kinds, looking no further out than `stop`.
_ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_SCOPES = frozenset("table td th li blockquote button object".split())


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTR.findall(text):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        found.setdefault(name.lower(), html.unescape(value))
    return found


def balanced(page: str) -> list[list]:
    """Events ``[kind, tag, attribute text or text, index of the matching end]``.

    Linear in the page: behind the last ``>`` all is text, and once a quote has been followed to the end of the page
    in vain, later tags end at their first ``>``.
    """
    events: list[list] = []
    stack: list[int] = []
    n_open = Counter()

    def close_down_to(depth: int) -> None:
        while len(stack) > depth:
            start = stack.pop()
            events[start][3] = len(events)
            events.append(["end", events[start][1], "", 0])
            n_open[events[start][1]] -= 1

    def close_nearest(kinds: set[str], stop: frozenset | set) -> None:
        if not any(n_open[k] for k in kinds):
            return None
        for depth in range(len(stack) - 1, -1, -1):
            name = events[stack[depth]][1]
            if name in kinds:
                return close_down_to(depth)
            if name in stop:
                return None
        return None

    def open_tag(tag: str, attrs: str, empty: bool) -> None:
        if tag in _BLOCK:
            close_nearest({"p"}, _SCOPES)
        if tag in _ENDS:
            close_nearest(*_ENDS[tag])
        at = len(events)
        events.append(["start", tag, attrs, at + 1])
        if empty:
            events.append(["end", tag, "", 0])
        else:
            stack.append(at)
            n_open[tag] += 1

    at, last, quotes = 0, page.rfind(">"), True
    while at < len(page):
        if at > last:
            events.append(["text", "", html.unescape(page[at:].partition("<!--")[0]), 0])
            break
        m = _TOKEN.match(page, at)
        at = m.end()
        if m["tag"]:
            quoted = _QUOTED.match(page, at) if quotes else None
            quotes = quoted is not None
            stop = quoted.end() if quotes else page.index(">", at)
            attrs, at = page[at:stop], stop + 1
        if m["text"] is not None:
            events.append(["text", "", html.unescape(m["text"]), 0])
        elif m["raw"]:
            open_tag(m["raw"].lower(), m["rawattrs"], False)
            events.append(["text", "", m["body"], 0])
            close_down_to(len(stack) - 1)
        elif m["close"]:
            close_nearest({m["tag"].lower()}, frozenset())
        elif m["tag"]:
            tag = m["tag"].lower()
            open_tag(tag, attrs, tag in _VOID or (tag not in _BLOCK and attrs.endswith("/")))
    close_down_to(0)
    return events


def main_content(events: list[list]) -> tuple[str, int, int]:
    """Region name and event range: first main, else first article, else first role=main."""
    starts = [i for i, e in enumerate(events) if e[0] == "start"]
    for name in ("main", "article"):
        for i in starts:
            if events[i][1] == name:
                return name, i, events[i][3] + 1
    for i in starts:
        if "role" in events[i][2].lower() and _attributes(events[i][2]).get("role") == "main":
            return "role", i, events[i][3] + 1
    return "document", 0, len(events)


def without_boilerplate(
    events: list[list], begin: int, end: int, strip_tags: frozenset[str], classes: Sequence[re.Pattern]
) -> Iterator[list]:
    """Events of the range minus whole subtrees of unwanted elements."""
    i = begin
    while i < end:
        kind, tag, attrs, match = events[i]
        if kind == "start":
            unwanted = tag in strip_tags or tag == "svg"
            if not unwanted and "class" in attrs.lower():
                names = _attributes(attrs).get("class", "").split()
                values = [*names, " ".join(names)]
                unwanted = any(rx.search(v) for rx in classes for v in values)
            if unwanted:
                i = match + 1
                continue
        yield events[i]
        i += 1


def serialize(events: Iterator[list]) -> str:
    """Cleaned HTML without ``class`` and ``style`` attributes."""
    out = []
    for kind, tag, payload, _ in events:
        if kind == "text":
            out.append(html.escape(payload, quote=False))
        elif kind == "start":
            out.append(f"<{tag}{_STYLING.sub('', payload)}>")
        elif tag not in _VOID:
            out.append(f"</{tag}>")
    return "".join(out)


_MARKS = {"b": "**", "strong": "**", "em": "*", "i": "*", "code": "`", "kbd": "`", "samp": "`"}
_HEADINGS = {f"h{n}": "#" * n for n in range(1, 7)}
_BULLETS = "*+-"
_COUNTED = {"pre": "pre", "ul": "list", "ol": "list", "td": "tight", "th": "tight"}
_COUNTED |= dict.fromkeys(_HEADINGS, "tight") | dict.fromkeys(("code", "kbd", "samp"), "code")


def _wrap(text: str, before: str, after: str) -> str:
    """Mark the text itself, leaving one outer blank where there was white space."""
    inner = text.strip()
    if not inner:
        return text
    return " " * (text[0] == " ") + before + inner + after + " " * (text[-1] == " ")


def _indent(text: str, bullet: str) -> str:
    return bullet + re.sub(r"\n(?=[^\n])", "\n" + " " * len(bullet), text)


def render(events: Iterator[list]) -> str:
    """Markdown with ATX headings and no images; blocks are separated by blank lines."""
    frames: list[list] = [["", []]]  # attribute text, rendered pieces of every open element
    inside = Counter()
    numbers: list[int] = []  # next item number of every open list, -1 when unordered
    tables: list[list[list[str]]] = []

    def emit(piece: str, block: bool = False) -> None:
        pieces = frames[-1][1]
        if not inside["pre"]:
            last = pieces[-1] if pieces else "\n"
            if block and pieces and not last.isspace():
                pieces[-1] = last.rstrip(" ")
            elif not block and last.endswith(("\n", " ")):
                piece = piece.lstrip(" ")
        if piece:
            pieces.append(piece)

    def block(body: str) -> None:
        emit(f"\n\n{body}\n\n" if body.strip() else "", True)

    def finish(tag: str, attrs: str, text: str) -> None:
        body = text.strip(" \n")
        if "\n\n\n" in body:
            body = re.sub(r"\n{3,}", "\n\n", body)
        if tag == "pre":
            block(f"```\n{text.strip(chr(10))}\n```" if body else "")
        elif inside["pre"]:
            emit(text)
        elif tag in _MARKS:
            nested = inside["code"] and _COUNTED.get(tag) == "code"
            emit(text if nested else _wrap(text, _MARKS[tag], _MARKS[tag]))
        elif tag == "a":
            href = _attributes(attrs).get("href")
            same = body.replace("\\_", "_").replace("\\*", "*") == href
            emit(text if href is None else f"<{href}>" if same else _wrap(text, "[", f"]({href})"))
        elif tag == "br":
            emit(" " if inside["tight"] else "  \n", True)
        elif tag == "hr":
            block("---")
        elif tag in _HEADINGS:
            block(f"{_HEADINGS[tag]} {' '.join(body.split())}" if body else "")
        elif tag == "blockquote":
            block("\n".join(f"> {line}".rstrip() for line in body.split("\n")) if body else "")
        elif tag == "li":
            bullet = _BULLETS[max(len(numbers) - 1, 0) % 3] + " "
            if numbers and numbers[-1] >= 0:
                bullet = f"{numbers[-1]}. "
                numbers[-1] += 1
            emit(f"\n{_indent(body, bullet)}\n", True)
        elif tag in ("ul", "ol"):
            items = re.sub(r"\n{2,}(?=(?:[*+-]|\d+\.) )", "\n", body)
            emit(f"\n{items}\n", True) if inside["list"] else block(items)
        elif tag in ("td", "th") and tables:
            tables[-1][-1].append(" ".join(body.split()).replace("|", "\\|"))
        elif tag == "table":
            lines = ["| " + " | ".join(cells) + " |" for cells in tables.pop() if cells]
            if lines:
                lines.insert(1, "|" + " --- |" * (lines[0].replace("\\|", "").count("|") - 1))
            block("\n".join([*([body] if body else []), *lines]))
        elif tag in _BLOCK:
            emit(f" {body} ", True) if inside["tight"] else block(body)
        else:
            emit(text)

    for kind, tag, payload, _ in events:
        if kind == "text":
            text = payload if inside["pre"] else _BLANKS.sub(" ", payload)
            literal = inside["pre"] or inside["code"]
            emit(text if literal else text.replace("*", "\\*").replace("_", "\\_"))
        elif kind == "start":
            inside[_COUNTED.get(tag)] += 1
            if tag in ("ul", "ol"):
                start = _attributes(payload).get("start", "")
                numbers.append(-1 if tag == "ul" else int(start) if start.isdigit() else 1)
            elif tag == "table":
                tables.append([[]])
            elif tag == "tr" and tables:
                tables[-1].append([])
            frames.append([payload, []])
        else:
            attrs, pieces = frames.pop()
            inside[_COUNTED.get(tag)] -= 1
            if tag in ("ul", "ol"):
                numbers.pop()
            if tag != "img":
                finish(tag, attrs, "".join(pieces))
    return "".join(frames[0][1])


def _cleaner(strip_tags: Sequence[str], strip_classes: Sequence[str]):
    tags = frozenset(t.lower() for t in strip_tags)
    patterns = [re.compile(c, re.I) for c in strip_classes]

    def clean(page: str) -> tuple[str, list[list]]:
        events = balanced(page)
        region, begin, end = main_content(events)
        return region, list(without_boilerplate(events, begin, end, tags, patterns))

    return clean


def _by_slices(pages: pa.Array, convert: Callable[[list[str | None]], pa.Array]) -> pa.Array:
    """``convert`` over about ``_SLICE`` bytes of pages after another; a larger page is one slice.

    A batch holds ten thousand pages, and as Python text a page takes up to four times its bytes.
    """
    parts, sizes = [], pc.fill_null(pc.binary_length(pages), 0).to_pylist()
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > _SLICE:
            parts.append(convert(pages.slice(begin, i - begin).to_pylist()))
            begin, held = i, 0
        held += size
    parts.append(convert(pages.slice(begin).to_pylist()))
    return pa.concat_arrays(parts)


def html_to_markdown(
    html_col: Column | str,
    strip_tags: Sequence[str] = STRIP_TAGS,
    strip_classes: Sequence[str] = STRIP_CLASSES,
) -> Column:
    """Struct ``markdown, region, status, error``; a page that fails never fails the job."""

    clean = _cleaner(strip_tags, strip_classes)

    def some(pages: list[str | None]) -> pa.Array:
        rows = []
        for page in pages:
            try:
                if page is None:
                    raise ValueError("no text: missing or not valid UTF-8")
                region, events = clean(page)
                rows.append((render(iter(events)), region, "ok", None))
            except Exception as exc:  # one bad page is a failed row
                rows.append((None, None, "failed", f"{type(exc).__name__}: {exc}"))
        columns = zip(*rows) if rows else [[]] * 4
        return pa.StructArray.from_arrays(
            [pa.array(c, pa.string()) for c in columns], ["markdown", "region", "status", "error"]
        )

    @F.arrow_udf(CONVERTED)
    def convert(pages: pa.Array) -> pa.Array:
        return _by_slices(pages, some)

    # a filter on the outcome would otherwise be pushed below and convert every page twice
    return convert.asNondeterministic()(html_col)


def clean_html(
    html_col: Column | str,
    strip_tags: Sequence[str] = STRIP_TAGS,
    strip_classes: Sequence[str] = STRIP_CLASSES,
) -> Column:
    """Main region as well-formed HTML without boilerplate, ``class`` and ``style``."""

    clean = _cleaner(strip_tags, strip_classes)

    def some(pages: list[str | None]) -> pa.Array:
        return pa.array([None if page is None else serialize(iter(clean(page)[1])) for page in pages], pa.string())

    @F.arrow_udf("string")
    def cleaned(pages: pa.Array) -> pa.Array:
        return _by_slices(pages, some)

    return cleaned.asNondeterministic()(html_col)
