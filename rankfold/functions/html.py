"""HTML operators.  Spark has no HTML parser, so these run as Arrow UDFs."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold import fixed_values as fv

VOID_ELEMENTS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen "
    "link menuitem meta nextid param source spacer track wbr".split()
)
# Both lists are fixed values: they follow the conventions of HTML parsers.
# Text inside these is not part of an element's visible text.
TEXTLESS_ELEMENTS = frozenset("script style template rt rp".split())


class _Walker(HTMLParser):
    """Tracks open elements; subclasses get whole text nodes and element events.

    No tree repair: an end tag closes everything up to its start tag and is
    ignored when no such tag is open.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.open: list[str] = []
        self.failed = False
        self._opened: Counter[str] = Counter()
        self._closed_void: Counter[str] = Counter()
        self._pending: list[str] = []

    def walk(self, markup: str) -> None:
        """Walks all of the markup; where the parser gives up, what came so far counts."""
        try:
            self.feed(markup)
            self.close()
        except (AssertionError, ValueError, IndexError):
            self.failed = True
        self.flush()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        # only CDATA is known in pages; others are comments that end at the next '>'
        if self.rawdata.startswith("<![CDATA[", i):
            return super().parse_marked_section(i, report)
        end = self.rawdata.find(">", i)
        if end < 0:
            return -1
        self.handle_comment(self.rawdata[i + 2:end])
        return end + 1

    # hooks
    def on_text(self, text: str) -> None: ...

    def on_start(self, tag: str, attrs: list) -> None: ...

    def on_end(self, tag: str) -> None: ...

    def on_hidden(self, text: str) -> None: ...

    # text nodes: adjacent data and entities form one node
    def flush(self) -> None:
        if self._pending:
            text = "".join(self._pending)
            self._pending = []
            self.on_text(text)

    def handle_data(self, data: str) -> None:
        self._pending.append(data)

    def handle_charref(self, name: str) -> None:
        self._pending.append(unescape(f"&#{name};"))

    def handle_entityref(self, name: str) -> None:
        self._pending.append(html5.get(name + ";") or f"&{name}")

    # elements
    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.flush()
        self.on_start(tag, attrs)
        if tag in VOID_ELEMENTS:
            self.on_end(tag)
            self._closed_void[tag] += 1
        else:
            self.open.append(tag)
            self._opened[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.flush()
        self.on_start(tag, attrs)
        self.on_end(tag)

    def handle_endtag(self, tag: str) -> None:
        if self._closed_void[tag]:
            self._closed_void[tag] -= 1
            return
        self.flush()
        if self._opened[tag]:
            while True:
                closed = self.open.pop()
                self._opened[closed] -= 1
                self.on_end(closed)
                if closed == tag:
                    return

    # parts that split text nodes without being visible
    def handle_comment(self, data: str) -> None:
        self.flush()
        self.on_hidden(f"<!--{data}-->")

    def handle_decl(self, decl: str) -> None:
        self.flush()

    def handle_pi(self, data: str) -> None:
        self.flush()

    def unknown_decl(self, data: str) -> None:
        self.flush()
        if data.upper().startswith("CDATA["):
            self.on_text(data[6:])


class _VisibleText(_Walker):
    def __init__(self) -> None:
        super().__init__()
        self.hidden_depth = 0
        self.texts: list[str] = []

    def on_start(self, tag, attrs):
        self.hidden_depth += tag in _NOT_SHOWN

    def on_end(self, tag):
        self.hidden_depth -= tag in _NOT_SHOWN

    def on_text(self, text):
        if not self.hidden_depth:
            self.texts.append(text)


_NOT_SHOWN = TEXTLESS_ELEMENTS | frozenset(fv.HIDDEN_ELEMENTS)


def visible_text(markup: str) -> str:
    """Visible text: one stripped, non-blank line per line of every text node."""
    walker = _VisibleText()
    walker.walk(markup)
    lines = (line.strip() for line in "\n".join(walker.texts).splitlines())
    return "\n".join(line for line in lines if line)


# The start tags that end an open element of the first column's kind,
# and the elements beyond which nothing is ended, as HTML defines them.
_ENDED_BY = {
    "td": frozenset("td th tr tbody thead tfoot".split()),
    "th": frozenset("td th tr tbody thead tfoot".split()),
    "tr": frozenset("tr tbody thead tfoot".split()),
    "tbody": frozenset("tbody thead tfoot".split()), "thead": frozenset("tbody thead tfoot".split()),
    "tfoot": frozenset("tbody thead tfoot".split()),
    "li": frozenset(["li"]), "option": frozenset("option optgroup".split()), "optgroup": frozenset(["optgroup"]),
    "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()),
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
        "nav ol p pre section table ul li dt dd td th tr tbody thead tfoot".split()),
}
_BORDERS = {"li": frozenset("ul ol menu table".split()), "dt": frozenset("dl table".split()), "dd": frozenset("dl table".split()),
            "option": frozenset(["select"]), "optgroup": frozenset(["select"]), "p": frozenset("table button".split())}
_ENDS = {tag: tuple(own for own, ending in _ENDED_BY.items() if tag in ending) for tag in frozenset().union(*_ENDED_BY.values())}
_TABLE = frozenset(["table"])
_OF_TABLE = frozenset("td th tr tbody thead tfoot".split())


class _TableRows(_Walker):
    """Collects every ``tr``: the text of each ``td`` below it, and its markup.

    Texts and markup are kept once, in buffers; cells and rows are spans of them.
    ``implied``: omitted end tags of cells, rows, items and paragraphs are supplied,
    and an end tag of a table's part ends nothing outside the innermost table.
    Otherwise an element without an end tag holds all that follows.
    """

    def __init__(self, implied: bool = False) -> None:
        super().__init__()
        self.implied = implied
        self.pieces: list[str] = []          # markup of the whole document
        self.texts: list[str] = []           # its text nodes
        self.cells: list[list[int]] = []     # first and end text of each td
        self.rows: list[list[int]] = []      # first piece, first cell, end piece, end cell
        self.open_rows: list[int] = []
        self.open_cells: list[int] = []
        self.textless_depth = 0

    def _close(self, depth: int) -> None:
        """Ends all elements from a depth of the stack on."""
        while len(self.open) > depth:
            closed = self.open.pop()
            self._opened[closed] -= 1
            self.on_end(closed)

    def _imply(self, tag: str) -> None:
        """Ends what a start tag ends; looks no further than the last element that it could end."""
        depth = at = len(self.open)
        possible = sum(self._opened[own] for own in _ENDS.get(tag, ()))
        while possible and at:
            at -= 1
            own = self.open[at]
            if own in _TABLE or tag == "table" and own in _OF_TABLE:
                break
            if tag in _ENDED_BY.get(own, ()):
                depth, possible = at, possible - 1
            elif own not in _ENDED_BY and tag not in _OF_TABLE or own in _BORDERS.get(tag, ()):
                break
        self._close(depth)

    def handle_starttag(self, tag, attrs):
        if self.implied and tag in _ENDS and self.open:
            self.flush()
            self._imply(tag)
        super().handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.implied and tag in _OF_TABLE and self._opened[tag]:
            for own in reversed(self.open):
                if own == tag:
                    break
                if own in _TABLE:
                    return
        super().handle_endtag(tag)

    def on_start(self, tag, attrs):
        if tag == "tr":
            self.open_rows.append(len(self.rows))
            self.rows.append([len(self.pieces), len(self.cells), -1, -1])
        elif tag == "td":
            self.open_cells.append(len(self.cells))
            self.cells.append([len(self.texts), -1])
        self.textless_depth += tag in TEXTLESS_ELEMENTS
        if self.open_rows:
            parts = "".join(f' {name}="{value or ""}"' for name, value in attrs)
            self.pieces.append(f"<{tag}{parts}>")

    def on_end(self, tag):
        self.textless_depth -= tag in TEXTLESS_ELEMENTS
        if tag == "tr":
            self.rows[self.open_rows.pop()][2:] = len(self.pieces), len(self.cells)
        elif tag == "td":
            self.cells[self.open_cells.pop()][1] = len(self.texts)
        if self.open_rows:
            self.pieces.append(f"</{tag}>")

    def on_text(self, text):
        if self.open_rows:
            self.pieces.append(text)
        if self.open_cells and not self.textless_depth:
            self.texts.append(text)

    def on_hidden(self, text):
        if self.open_rows:
            self.pieces.append(text)


def table_rows(markup: str, implied: bool = False) -> Iterator[tuple[int, list[str], str]]:
    """(position, cell texts, row markup) of every table row with at least 3 cells.

    Every element that is still open at the end of the markup ends there.  See
    ``_TableRows`` for ``implied``; where no end tag is omitted, both give the same.
    """
    walker = _TableRows(implied)
    walker.walk(markup)
    for position, (piece, cell, end_piece, end_cell) in enumerate(walker.rows):
        if end_piece < 0:                    # never closed: runs to the end
            end_piece, end_cell = len(walker.pieces), len(walker.cells)
        if end_cell - cell >= 3:
            texts = ["".join(walker.texts[first:end if end >= 0 else None]) for first, end in walker.cells[cell:end_cell]]
            yield position, texts, "".join(walker.pieces[piece:end_piece])


def _to_text(markup: pd.Series) -> pd.Series:
    return markup.map(visible_text, na_action="ignore")


def _escaped_to_text(markup: pd.Series) -> pd.Series:
    return markup.map(lambda m: visible_text(unescape(m)), na_action="ignore")


def html_to_text(markup: Column, escaped: bool = False) -> Column:
    """Visible text of HTML; ``escaped`` markup has its entities resolved first.

    Marked nondeterministic so that a filter on the result does not make the
    plan parse every page a second time.
    """
    func = _escaped_to_text if escaped else _to_text
    return F.pandas_udf(func, "string").asNondeterministic()(markup)


def html_rows(documents: DataFrame, content: str = "content", keep: tuple[str, ...] = (),
              chunk_rows: int = 2000, chunk_chars: int = 16_000_000, implied: bool = True) -> DataFrame:
    """One output row per HTML table row: kept columns, item_pos, cells, markup.

    Rows leave in chunks bounded by number and by text, whatever a document holds.
    Omitted end tags are supplied, so a page of open rows takes linear time; with
    ``implied`` off, open rows and cells hold all that follows, which multiplies it.
    """
    kept = list(keep)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*kept, "item_pos", "cells", "markup"]
        for batch in batches:
            rows: list[tuple] = []
            chars = 0
            for record in batch.itertuples(index=False, name=None):
                *values, text = record
                for position, cells, markup in table_rows(text or "", implied):
                    rows.append((*values, position, cells, markup))
                    chars += len(markup)
                    if len(rows) >= chunk_rows or chars >= chunk_chars:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, chars = [], 0
            yield pd.DataFrame(rows, columns=columns)

    selected = documents.select(*kept, content)
    schema = [f"{c} {selected.schema[c].dataType.simpleString()}" for c in kept]
    schema += ["item_pos BIGINT", "cells ARRAY<STRING>", "markup STRING"]
    return selected.mapInPandas(parse, ", ".join(schema))


# Ship this module's classes with the tasks, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
