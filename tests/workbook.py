"""Minimal workbooks for tests, written with the standard library."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def _letters(index: int) -> str:
    text = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        text = chr(65 + rest) + text
    return text


def write_workbook(path, rows, dates=()) -> None:
    """``rows`` of str, number or None; cells at the positions in ``dates`` get a date format."""
    shared: dict[str, int] = {}
    lines = []
    for r, row in enumerate(rows):
        cells = []
        for c, value in enumerate(row):
            if value is None:
                continue
            at = f"{_letters(c)}{r + 1}"
            if isinstance(value, str):
                cells.append(f'<c r="{at}" t="s"><v>{shared.setdefault(value, len(shared))}</v></c>')
            else:
                style = ' s="1"' if (r, c) in dates else ""
                cells.append(f'<c r="{at}"{style}><v>{value}</v></c>')
        if cells:
            lines.append(f'<row r="{r + 1}">{"".join(cells)}</row>')
    strings = "".join(f"<si><t>{escape(s)}</t></si>" for s in shared)
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}"/>')
        archive.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_MAIN}">{strings}</sst>')
        archive.writestr(
            "xl/styles.xml", f'<styleSheet xmlns="{_MAIN}"><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>'
        )
        archive.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
