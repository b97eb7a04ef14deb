"""HTML to visible text and to Markdown, by the standard library's parser in Arrow batches.

Markdown is written from a tree of elements: headings, nested lists, quotes, links and emphasis, preformatted text, and tables with a head line, spans laid
out as empty cells, and bars in cells escaped. Images are left out. Elements nested deeper than `DEEPEST` count as their ancestor's
at that depth, and end tags that nothing opened are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

HIDDEN = {"script", "style", "noscript", "template", "title"}
BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "section", "article", "header", "footer", "nav", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "blockquote", "pre"}


VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: What a start tag ends, and up to which open element.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}), "thead": ({"thead", "tbody", "tfoot", "tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
} | {t: ({"p"}, {"div", "td", "th", "li", "blockquote", "body", "article", "section"}) for t in BLOCKS - {"br", "li", "tr"}}
DEEPEST, WIDEST = 150, 1000


class _Reader(HTMLParser):
    """Visible text, with a line break around every block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)


class Node:
    """An element with its attributes and what is in it: elements and text."""

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs = tag, attrs
        self.kids: list[Node | str] = []

    def number(self, name: str, most: int) -> int:
        given = self.attrs.get(name, "").strip()
        return min(max(int(given), 1), most) if given.isascii() and given.isdigit() else 1


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ended, bounds = ENDS.get(tag, (set(), set()))
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in bounds:
                break
            if self.open[k].tag in ended:
                del self.open[k:]
                if tag not in ("thead", "tbody", "tfoot"):
                    break
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(node)
        if tag not in VOID and len(self.open) < DEEPEST:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag == "table" and tag in ("td", "th", "tr", "p", "li", "ul", "ol"):
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].kids.append(data)


def _squeezed(text: str) -> str:
    return re.sub(r"[^\S\n]+", " ", text).strip()


def _inline(node: Node) -> str:
    """What stands in a line: text, emphasis and links; blocks within are parted by spaces, line breaks are kept."""
    out = []
    for kid in node.kids:
        if isinstance(kid, str):
            out.append(re.sub(r"\s+", " ", kid))
        elif kid.tag in HIDDEN or kid.tag == "img":
            continue
        elif kid.tag == "br":
            out.append("\n")
        elif kid.tag in ("b", "strong"):
            out.append(_marked(_inline(kid), "**"))
        elif kid.tag in ("i", "em"):
            out.append(_marked(_inline(kid), "_"))
        elif kid.tag == "a":
            said = _squeezed(_inline(kid).replace("\n", " "))
            out.append(f"[{said}]({kid.attrs['href']})" if said and kid.attrs.get("href") else said)
        else:
            out.append(f" {_inline(kid)} " if kid.tag in BLOCKS | {"td", "th"} else _inline(kid))
    return "".join(out)


def _marked(text: str, mark: str) -> str:
    inside = text.strip()
    return text.replace(inside, f"{mark}{inside}{mark}", 1) if inside else text


def _blocks(node: Node) -> list[str]:
    """The lines of an element's content."""
    out: list[str] = []
    line = Node("", {})

    def flush() -> None:
        out.extend(x for x in map(_squeezed, _inline(line).split("\n")) if x)
        line.kids.clear()

    for kid in node.kids:
        if isinstance(kid, str) or kid.tag == "br" or not (kid.tag in BLOCKS or kid.tag in ("html", "body", "main", "figure", "form", "dl", "dt", "dd", "td", "th", "thead", "tbody", "center")):
            line.kids.append(kid)
            continue
        flush()
        out.extend(_block(kid))
    flush()
    return out


def _block(node: Node) -> list[str]:
    if re.fullmatch("h[1-6]", node.tag):
        said = _squeezed(_inline(node).replace("\n", " "))
        return ["#" * int(node.tag[1]) + " " + said] if said else []
    if node.tag in ("ul", "ol"):
        return _list(node)
    if node.tag == "table":
        return _table(node)
    if node.tag == "blockquote":
        return [f"> {x}" for x in _blocks(node)]
    if node.tag == "hr":
        return ["* * *"]
    if node.tag == "pre":
        return ["```", *(x.rstrip() for x in _raw(node).strip("\n").split("\n")), "```"] if _raw(node).strip() else []
    return _blocks(node)


def _raw(node: Node) -> str:
    return "".join(k if isinstance(k, str) else "\n" if k.tag == "br" else "" if k.tag in HIDDEN else _raw(k) for k in node.kids)


def _list(node: Node) -> list[str]:
    """Items, each with what is nested in it indented under its mark."""
    out, place = [], node.number("start", 10**9) - 1
    for kid in node.kids:
        if isinstance(kid, str) or kid.tag in HIDDEN:
            continue
        lines = _blocks(kid) if kid.tag == "li" else _block(kid)
        if kid.tag != "li":
            out.extend("  " + x for x in lines)
            continue
        place += 1
        mark = f"{place}. " if node.tag == "ol" else "* "
        out.extend((mark if k == 0 else " " * len(mark)) + x for k, x in enumerate(lines))
    return out


def _rows(node: Node) -> Iterator[tuple[Node, bool]]:
    """The rows of a table, and whether they stand in its head; those of tables within are not its own."""
    for kid in node.kids:
        if isinstance(kid, Node):
            if kid.tag == "tr":
                yield kid, node.tag == "thead"
            elif kid.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(kid)


def _table(node: Node) -> list[str]:
    """A head line, the line below it, and the rows. The head is the first row, whether or not it says so, as Markdown has no table without."""
    grid: list[list[str]] = []
    below: dict[int, int] = {}  # rows for which a column is still taken by a cell above
    for row, _ in _rows(node):
        line: list[str] = []

        def taken(line: list[str] = line) -> None:
            while below.get(len(line), 0) > 0:
                below[len(line)] -= 1
                line.append("")

        for cell in row.kids:
            if isinstance(cell, str) or cell.tag not in ("td", "th"):
                continue
            taken()
            said = _squeezed(_inline(cell).replace("\n", " ")).replace("|", "\\|")
            for k in range(min(cell.number("colspan", WIDEST), WIDEST - len(line))):
                below[len(line)] = cell.number("rowspan", 1 << 16) - 1
                line.append("" if k else said)
        taken()
        grid.append(line)
    width = max(map(len, grid), default=0)
    if not width or not any(any(line) for line in grid):
        return []
    shown = ["| " + " | ".join([*line, *[""] * (width - len(line))]) + " |" for line in grid]
    captions = [_squeezed(_inline(k).replace("\n", " ")) for k in node.kids if isinstance(k, Node) and k.tag == "caption"]
    return [*filter(None, captions), shown[0], "| " + " | ".join(["---"] * width) + " |", *shown[1:]]


def to_markdown(html: str) -> str:
    """A page as Markdown, a line a block."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return "\n".join(_blocks(tree.root))


def to_text(html: str | None, markdown: bool = False) -> str | None:
    """What a reader sees, one line a block; null stays null. Scripts are not run."""
    if html is None:
        return None
    if markdown:
        return to_markdown(html)
    reader = _Reader()
    reader.feed(html)
    reader.close()
    lines = (re.sub(r"[^\S\n]+", " ", x).strip() for x in "".join(reader.out).split("\n"))
    return "\n".join(x for x in lines if x)


#: Pages that a task reads before it hands on what it made, and bytes of an Arrow batch of pages, unless the session has a size of its own.
PAGES, BATCH = 64, "1m"


def visible_text(df: DataFrame, key: str, html: str = "html", markdown: bool = False) -> DataFrame:
    """key, text, error: a page that can't be read has a null text and says why (A22). A worker holds a MB of pages, or one page, not 10,000 of them."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, PAGES) for whole in batches for at in range(0, whole.num_rows, PAGES)):
            texts, errors = [], []
            for h in batch[html].to_pylist():
                try:
                    texts.append(to_text(h, markdown))
                    errors.append(None)
                except Exception as e:  # one bad page does not end the job
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(texts, pa.string()), pa.array(errors, pa.string())], [key, "text", "error"])

    bytes_per_batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(bytes_per_batch, None) is None:
        df.sparkSession.conf.set(bytes_per_batch, BATCH)
    return df.select(key, html).mapInArrow(run, f"{key} {kind}, text string, error string")
