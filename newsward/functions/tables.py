"""The rows of the tables on a page, one page at a time: the part of ``extract_table_rows``
that runs in Python. Texts and links come out as the column functions of ``html`` give them."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark import cloudpickle

from newsward.functions.html import ATTRIBUTE, TAG, _windows_page

# Executors get this module's functions by value and need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows, and characters of their pages, that are gathered before they leave as a batch.
BATCH_ROWS = 20_000
BATCH_CHARS = 4 << 20

TAGS = re.compile(TAG, re.A)
# Every tag, with groups for its slash and for what makes up tables.
NAMED = re.compile(r"<(/)?(?:(?:(table)|(tr)|(td)|(th))(?=[\s/>])|[a-z])" + TAG[len("</?[a-zA-Z]") :], re.A | re.I)
TABLE, TR, TD, TH = 2, 3, 4, 5
HAS_ANCHOR = re.compile(r"<a[\s>]", re.A | re.I)
# In Java a letter of any script stands inside a word.
ANCHOR = re.compile(r"<a(?u:\b)[^>]*>", re.A | re.I)
HREF = re.compile(r"(?u:\b)href" + ATTRIBUTE, re.A | re.I)
REFERENCE = re.compile(r"&((?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);?)")
DECIMAL = re.compile(r"#([0-9]{1,9});?")
HEXADECIMAL = re.compile(r"#[xX]([0-9a-fA-F]{1,7});?")
WINDOWS = _windows_page()


def _decoded(reference: re.Match) -> str:
    name = reference[1]
    if name[0] != "#":
        return html5.get(name, reference[0])
    digits = DECIMAL.fullmatch(name)
    if digits:
        code = int(digits[1])
    else:
        digits = HEXADECIMAL.fullmatch(name)
        if not digits:
            return reference[0]
        code = int(digits[1], 16)
    if 128 <= code <= 159:
        return WINDOWS[code - 128]
    if not 1 <= code <= 0x10FFFF or 0xD800 <= code <= 0xDFFF:
        return "\ufffd"
    return "" if code == 0xFEFF else chr(code)  # Java drops this one, a byte order mark


def unescape(text: str) -> str:
    return REFERENCE.sub(_decoded, text) if "&" in text else text


def stripped_text(fragment: str) -> str:
    """Each text node stripped, then joined without a separator."""
    if "<" not in fragment and "\u0001" not in fragment:
        return unescape(fragment).strip()
    return "".join([unescape(node).strip() for node in TAGS.sub("\u0001", fragment).split("\u0001")])


def href(content: str) -> str | None:
    anchor = ANCHOR.search(content)
    found = HREF.search(anchor[0]) if anchor else None
    return unescape("".join([group or "" for group in found.groups()])).strip() if found else None


def _value(content: str) -> tuple[bool, str | None]:
    """Whether a cell holds an anchor, and its link or text."""
    if "<" in content and HAS_ANCHOR.search(content):
        return True, href(content)
    return False, stripped_text(content)


def table_rows(source: str) -> list[tuple[int, int, list, list]]:
    """``table_no, index, links, texts`` of each row but a table's first, in page order.

    One pass; a stack holds the row and cell that are open in each of the tables around. A table
    has the rows ``first`` to ``last`` (the latter left out) by their numbers, nested ones included,
    a row the cells, a cell the characters. A new row or cell ends the one before it in its
    table; the page's end ends all.
    """
    # Of each kind a [first, last] per element, numbered as they open.
    tables, rows, cells = [], [], []
    around = []
    table = row = cell = None

    for tag in NAMED.finditer(source):
        kind = tag.lastindex
        if kind is None or kind < TABLE:
            continue
        closing = tag[1]
        if kind == TABLE:
            if not closing:
                around.append((table, row, cell))
                table, row, cell = [len(rows)], None, None
                tables.append(table)
                continue
            if table is None:
                continue
        elif kind == TH and closing:
            continue  # It opened nothing.
        if cell is not None:
            cell.append(tag.start())
            cell = None
        if kind == TD:
            if not closing:
                cell = [tag.end()]
                cells.append(cell)
        elif kind != TH:
            if row is not None:
                row.append(len(cells))
                row = None
            if kind == TABLE:
                table.append(len(rows))
                table, row, cell = around.pop()
            elif not closing:
                row = [len(cells)]
                rows.append(row)
    around.append((table, row, cell))
    for table, row, cell in around:
        for element, end in ((table, len(rows)), (row, len(cells)), (cell, len(source))):
            if element is not None:
                element.append(end)

    values = [_value(source[first:last]) for first, last in cells]
    made = []
    for table_no, (first, last) in enumerate(tables):
        for index, (start, end) in enumerate(rows[first + 1 : last]):
            own = values[start:end]
            made.append((table_no, index, [v for link, v in own if link], [v for link, v in own if not link]))
    return made


def rows_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of pages ``(key, source)``, in batches of bounded size."""
    cells = pa.list_(pa.string())

    def made(batch: pa.RecordBatch, of: list, rows: list) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(of), BATCH_ROWS):
            numbers, places, links, texts = zip(*rows[k : k + BATCH_ROWS])
            keys = batch.column(0).take(pa.array(of[k : k + BATCH_ROWS]))
            arrays = [keys, pa.array(numbers, pa.int32()), pa.array(places, pa.int32()), pa.array(links, cells), pa.array(texts, cells)]
            yield pa.RecordBatch.from_arrays(arrays, names=[batch.schema.names[0], "table_no", "index", "links", "texts"])

    for batch in batches:
        of, rows, chars = [], [], 0
        for place, source in enumerate(batch.column(1)):
            text = source.as_py()
            own = table_rows(text)
            of += [place] * len(own)
            rows += own
            chars += len(text)
            if len(of) >= BATCH_ROWS or chars >= BATCH_CHARS:
                yield from made(batch, of, rows)
                of, rows, chars = [], [], 0
        yield from made(batch, of, rows)
