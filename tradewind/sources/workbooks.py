"""Excel exports: every workbook is decoded by one task into rows of text cells."""

from __future__ import annotations

import io
import re
import sys
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import datetime, timedelta
from functools import partial
from xml.etree import ElementTree
from xml.sax.saxutils import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.functions import parsing
from tradewind.operators.versions import of_newest_file
from tradewind.sources import layouts
from tradewind.sources.delimited import filled
from tradewind.session import stage

# The functions run by tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ROWS = "File_Path string, Row int, Cells array<string>, Modified_Micros bigint"
_ROWS_PER_BATCH = 10_000
# Bytes of a sheet that are parsed at a time.
_PIECE_BYTES = 1 << 18
# Bytes without the end of an element after which a sheet is left to the XML parser alone.
_LONGEST_ELEMENT = 1 << 23
# Cells and strings in the form most programs write; all others go through the XML parser.
_PLAIN_CELL = re.compile(rb'<c r="([A-Z]{1,3})[0-9]+"(?: s="([0-9]+)")?(?: t="([a-z]+)")?(?:/>|>(?:<v>([\x20-\x25\x27-\x3b\x3d\x3f-\x7e]*)</v>)?</c>)')
_PLAIN_STRING = re.compile('<si><t(?: xml:space="preserve")?>([^<>&\x00-\x1f\ufffe\uffff]*(?:&(?:amp|lt|gt);[^<>&\x00-\x1f\ufffe\uffff]*)*)</t></si>')
# What above the elements leaves it open where they begin or what their bytes mean.
_UNSURE = re.compile(rb"""<!|<\?(?!xml )|encoding=["'](?!utf-8["'])""", re.IGNORECASE)
# Number formats of the workbook standard that show a date or a time.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(element) -> str:
    return "".join(t.text or "" for t in element.iter() if _local(t.tag) == "t")


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]*", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in archive.namelist():
        return set()
    root = ElementTree.fromstring(archive.read("xl/styles.xml"))
    dates = set(_DATE_FORMATS)
    for element in root.iter():
        if _local(element.tag) == "numFmt" and re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", element.get("formatCode", "").lower())):
            dates.add(int(element.get("numFmtId")))
    formats = next((e for e in root if _local(e.tag) == "cellXfs"), [])
    return {i for i, xf in enumerate(formats) if int(xf.get("numFmtId", 0)) in dates}


def _first_sheet(archive: zipfile.ZipFile) -> tuple[str, datetime]:
    """Name of the sheet that the workbook lists first, and the day its dates count from."""
    epoch, target = datetime(1899, 12, 30), None
    if "xl/workbook.xml" in archive.namelist():
        root = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        elements = {_local(e.tag): e for e in reversed(list(root.iter()))}
        if "workbookPr" in elements and elements["workbookPr"].get("date1904") in ("1", "true"):
            epoch = datetime(1904, 1, 1)
        number = next((v for k, v in elements["sheet"].items() if _local(k) == "id"), None) if "sheet" in elements else None
        if number and "xl/_rels/workbook.xml.rels" in archive.namelist():
            relations = ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
            target = next((e.get("Target") for e in relations if e.get("Id") == number), None)
    if target:
        target = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    if target not in archive.namelist():
        sheets = [n for n in archive.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
        target = min(sheets, key=lambda n: int(re.findall(r"\d+", n)[-1]))
    return target, epoch


def _value(cell, shared: list[str], dates: set[int], epoch: datetime) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return _text(cell)
    raw = None
    for child in cell:
        if child.tag.endswith("}v") or child.tag == "v":
            raw = child.text
            break
    return _converted(kind, cell.get("s", 0), raw, shared, dates, epoch)


def _converted(kind: str | None, style, raw: str | None, shared: list[str], dates: set[int], epoch: datetime) -> str | None:
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind is None or kind == "n":
        if int(style) in dates:
            moment = epoch + timedelta(days=float(raw))
            return (moment + timedelta(microseconds=500)).strftime("%Y-%m-%d %H:%M:%S")
        return raw[:-2] if raw.endswith(".0") else raw
    return raw


def _plain_strings(piece: bytes) -> tuple[bytes, Callable] | None:
    """Shared strings of a piece as one list, if all are plain; nothing is left for the XML parser."""
    try:
        parts = _PLAIN_STRING.split(piece.decode())
    except UnicodeDecodeError:
        return None
    if any(parts[::2]):
        return None
    texts = parts[1::2]
    if b"&" in piece:
        texts = [unescape(t) for t in texts]
    return b"", lambda elements: [texts]


def _plain_rows(shared: list[str], dates: set[int], epoch: datetime, places: dict[bytes, int], piece: bytes) -> tuple[bytes, Callable] | None:
    """Rows of a piece, if all cells are plain and no row is empty: the rows without their cells, for the XML parser, and what makes
    pairs of these rows and their values."""
    parts = _PLAIN_CELL.split(piece)
    between, letters, styles, kinds, raws = (parts[i::5] for i in range(5))
    starts = [i for i, text in enumerate(between) if text]
    rows = [between[i] for i in starts]
    bare = b"".join(rows)
    if not rows or starts[0] or rows[-1] != b"</row>" or len(rows) - 1 != bare.count(b"<row") or not all(r.startswith(b"</row><row") for r in rows[1:-1]):
        return None
    if len(rows) - 1 != bare.count(b">") - bare.count(b"</row>") or bare.count(b"<") != 2 * bare.count(b"</row>"):
        return None

    def pairs(elements: list) -> Iterator[tuple]:
        if len(elements) != len(rows) - 1:
            raise ValueError("rows inside other elements")
        if {*kinds} == {b"s"} and all(raws):
            values = [*map(shared.__getitem__, map(int, raws))]
        else:
            values = [_converted(t and t.decode(), s or 0, v.decode() if v else None, shared, dates, epoch) for s, t, v in zip(styles, kinds, raws)]
        for letter in {*letters} - places.keys():
            places[letter] = _column_number(letter.decode())
        at = [*map(places.__getitem__, letters)]
        for element, start, end in zip(elements, starts, starts[1:]):
            columns = at[start:end]
            if columns == list(range(end - start)):
                yield element, values[start:end]
            else:
                cells: list = [None] * (max(columns) + 1)
                for place, value in zip(columns, values[start:end]):
                    cells[place] = value
                yield element, cells

    return bare, pairs


def _elements(stream, name: str, *above: str, plain: Callable[[bytes], tuple[bytes, Callable] | None]) -> Iterator:
    """Elements called ``name`` below the elements ``above``, the outermost first, as soon as they are complete.

    The stream is parsed a piece at a time into a tree, of which the finished elements are taken off; calling Python for every cell
    would take most of the time. Whole elements are first shown to ``plain``: it returns what is left of them for the parser, and a function
    of the elements that come of it whose results are given instead; or None, and the parser gets all."""
    builder = ElementTree.TreeBuilder()
    top = builder.start("top", {})
    parser = ElementTree.XMLParser(target=builder)
    start, end = re.compile(f"<{name}[ >]".encode()), f"</{name}>".encode()
    problem, ended, inside, rest = None, False, False, b""

    def holder():
        parent = top
        for tag in above:
            parent = next((e for e in parent if _local(e.tag) == tag), None)
            if parent is None:
                break
        return parent

    while not ended:
        piece, results = stream.read(_PIECE_BYTES), None
        try:
            ended = not piece
            piece, rest = rest + piece, b""
            if plain and not ended:
                cut = piece.rfind(end) + len(end) if end in piece else 0
                if not inside and (found := start.search(piece)):
                    head, piece, cut = piece[: found.start()], piece[found.start() :], max(0, cut - found.start())
                    parser.feed(head)
                    inside = holder() is not None and not _UNSURE.search(head)
                if inside and cut:
                    piece, rest = piece[:cut], piece[cut:]
                    whole = plain(piece)
                    if whole:
                        piece, results = whole
                    elif b"<!" in piece or b"<?" in piece:  # whether elements end where they seem to is not known any more
                        plain, inside, piece, rest = None, False, piece + rest, b""
                elif (inside or not found) and len(piece) < _LONGEST_ELEMENT:
                    rest = piece
                    continue
                else:
                    plain, inside = None, False
            parser.feed(piece)
            if results:
                parser.flush()
            if ended:
                parser.close()
        except Exception as error:  # what came before it is complete
            problem, ended = error, True
        parent = holder()
        if parent is None:
            continue
        # Until the end the last element may go on, if the piece was not cut behind it.
        finished = parent[:] if (ended or inside) and problem is None else parent[:-1]
        if results and problem is None:
            yield from results(finished)
        else:
            yield from (e for e in finished if _local(e.tag) == name)
        del parent[: len(finished)]
    if problem is not None:
        raise problem


def _sheet_rows(content: bytes) -> Iterator[tuple[int, list]]:
    """Rows of the first sheet, streamed; blank rows keep their number."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            strings = _elements(archive.open("xl/sharedStrings.xml"), "si", "sst", plain=_plain_strings)
            for found in strings:
                shared.extend(found if isinstance(found, list) else [_text(found)])
        dates = _date_styles(archive)
        first, epoch = _first_sheet(archive)
        position, places = -1, {}
        plain = partial(_plain_rows, shared, dates, epoch, places)
        for row in _elements(archive.open(first), "row", "worksheet", "sheetData", plain=plain):
            element, cells = row if isinstance(row, tuple) else (row, None)
            position = int(element.get("r", position + 2)) - 1
            if cells is None:
                cells = []
                for cell in element:
                    reference = cell.get("r")
                    if reference:
                        letters = reference.rstrip("0123456789").encode()
                        place = places.get(letters)
                        if place is None:
                            place = places[letters] = _column_number(letters.decode())
                    else:
                        place = len(cells)
                    cells.extend([None] * (place + 1 - len(cells)))
                    cells[place] = _value(cell, shared, dates, epoch)
            yield position, cells


def _batch(path: str, modified: int, numbers: list[int], cells: list[list]) -> pa.RecordBatch:
    columns = [
        pa.array([path] * len(numbers), pa.string()),
        pa.array(numbers, pa.int32()),
        pa.array(cells, pa.list_(pa.string())),
        pa.array([modified] * len(numbers), pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["File_Path", "Row", "Cells", "Modified_Micros"])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, modified, contents = (batch.column(n) for n in ("path", "modified", "content"))
        for i in range(batch.num_rows):
            path, time = paths[i].as_py(), modified[i].as_py()
            numbers, rows = [], []
            try:
                for position, cells in _sheet_rows(contents[i].as_py()):
                    numbers.append(position)
                    rows.append(cells)
                    if len(rows) == _ROWS_PER_BATCH:
                        yield _batch(path, time, numbers, rows)
                        numbers, rows = [], []
            except Exception as problem:  # whatever is wrong with one file is reported as row -1, the others go on
                numbers.append(-1)
                rows.append([f"{type(problem).__name__}: {problem}"])
            if rows:
                yield _batch(path, time, numbers, rows)


def workbook_rows(spark: SparkSession, folder: str, glob: str = "*.xlsx") -> DataFrame:
    """Cells of all workbooks of a folder, decoded once and staged.

    A sheet has at most 1 048 576 rows by its format, so one file is a bounded amount of work; many files
    are spread over tasks.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    wanted = files.filter(~F.lower("path").endswith("desktop.ini")).select(
        "path", F.unix_micros("modificationTime").alias("modified"), "content"
    )
    rows = stage(wanted.mapInArrow(_decode, _ROWS), "workbooks")
    name = F.element_at(F.split("File_Path", "/"), -1)
    return rows.select("File_Path", "Row", "Cells", name.alias("File_Source"), F.timestamp_micros("Modified_Micros").alias("File_Modified"))


def damaged(rows: DataFrame) -> DataFrame:
    """Files that could not be read to the end, with the reason."""
    return rows.filter(F.col("Row") == -1).select("File_Source", F.col("Cells")[0].alias("Reason"))


def sheet(rows: DataFrame, names: Mapping[str, str], header_row: int = 0, extra: Sequence[Column] = ()) -> DataFrame:
    """Rows below the header as columns named by ``names``; damaged files and blank rows are left out."""

    def cells_of(row: int) -> Column:
        return F.first(F.when(F.col("Row") == row, F.col("Cells")), ignorenulls=True)

    # One row per file, staged, so that Spark knows how few they are and the rows below the headers need not be shuffled.
    files = rows.filter(F.col("Row").isin(-1, 0, header_row)).groupBy("File_Path").agg(
        F.transform(cells_of(header_row), lambda c: F.trim(c)).alias("_header"),
        F.get(cells_of(0), F.lit(0)).alias("First_Cell"),
        F.count_if(F.col("Row") == -1).alias("_problems"),
    )
    # Where the names stand is looked up once per file.
    places = F.array(*[(F.array_position("_header", source) - 1).cast("int") for source in names])
    whole = files.filter("_header IS NOT NULL AND _problems = 0").withColumn("_places", places).drop("_problems", "_header")
    whole = stage(whole, "workbook-headers")
    body = rows.filter(F.col("Row") > header_row).filter(F.exists("Cells", lambda c: F.trim(c) != "")).join(whole, "File_Path")
    return body.select(
        *[filled(F.get("Cells", F.get("_places", F.lit(i)))).alias(name) for i, name in enumerate(names.values())],
        "File_Source",
        "File_Modified",
        F.col("Row").alias("File_Row"),
        *extra,
    )


def _with_range(rows: DataFrame, names: Mapping[str, str], header_row: int) -> DataFrame:
    start, end = parsing.report_range("First_Cell", "File_Source")
    return sheet(rows, names, header_row, [start.alias("Report_Start"), end.alias("Report_Date")])


def read_marketplace_orders(spark: SparkSession, folder: str, dedupe: bool = False) -> DataFrame:
    """Marketplace orders; with ``dedupe`` an order that overlapping exports hold is read from the newest of them only."""
    start, end = parsing.file_dates("File_Source", "orders")
    period = F.when(start.isNotNull(), F.concat_ws(" - ", start.cast("string"), end.cast("string")))
    found = sheet(workbook_rows(spark, folder), layouts.MARKETPLACE_ORDERS, 0, [period.alias("File_Date_Range")])
    return of_newest_file(found, "Order_ID") if dedupe else found


def read_direct_sales(spark: SparkSession, folder: str) -> DataFrame:
    return sheet(workbook_rows(spark, folder), layouts.DIRECT_SALES)


def read_social_live(spark: SparkSession, folder: str) -> DataFrame:
    """Live sessions: header in the third row, report range in the first cell."""
    return _with_range(workbook_rows(spark, folder), layouts.SOCIAL_LIVE, 2)


def is_video_list(first_cell: Column) -> Column:
    """True for the list layout, whose header is the first row."""
    cell = F.coalesce(first_cell, F.lit(""))
    return F.contains(cell, F.lit(layouts.VIDEO_LIST_MARK)) | (
        F.contains(cell, F.lit(layouts.VIDEO_WORD)) & ~F.contains(cell, F.lit(layouts.DATE_RANGE_WORD))
    )


def read_social_video(spark: SparkSession, folder: str) -> DataFrame:
    """Videos of both layouts, each mapped to the canonical names before they are put together."""
    rows = workbook_rows(spark, folder)
    lists = rows.filter((F.col("Row") == 0) & is_video_list(F.col("Cells")[0])).select("File_Path")
    standard = _with_range(rows.join(lists, "File_Path", "left_anti"), layouts.SOCIAL_VIDEO, 2)
    no_date = F.lit(None).cast("date")
    listed = sheet(
        rows.join(lists, "File_Path", "left_semi"),
        layouts.SOCIAL_VIDEO_LIST,
        0,
        [no_date.alias("Report_Start"), no_date.alias("Report_Date")],
    )
    return standard.unionByName(listed, allowMissingColumns=True)
