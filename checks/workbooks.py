"""Sources that are workbooks, written from the benchmark tables, one of them damaged; exports that overlap."""

from __future__ import annotations

import io
import sys
import uuid
import zipfile
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import exports
from checks.adapters import ALL, LINES, RAW_LINES, order_lines, table
from checks.base import Check
from checks.jobs import _ORDER, _order_sql
from tradewind.operators import channels, versions
from tradewind.session import staging_path
from tradewind.sources import delimited, workbooks
from tradewind.sources.files import file_system

# The functions run by tasks travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS_PER_WORKBOOK = 200_000
_ROWS_AT_ONCE = 20_000
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def _letters(index: int) -> str:
    text, index = "", index + 1
    while index:
        index, rest = divmod(index - 1, 26)
        text = chr(65 + rest) + text
    return text


def _joined(*parts) -> pa.Array:
    """Texts put together row by row; a null part makes a null."""
    return pc.binary_join_element_wise(*parts, "")


def _workbook(names: list[str], columns: list[pa.Array]) -> bytes:
    """A workbook of text cells, of columns of text, put together by column, since a workbook has millions of cells."""
    heads = [pa.array([name], pa.string()) for name in names]
    columns = [pa.concat_arrays([head, *pa.chunked_array([column]).cast(pa.string()).chunks]) for head, column in zip(heads, columns)]
    count, total = len(columns[0]), sum(len(c) - c.null_count for c in columns)
    shared = pa.chunked_array(columns).combine_chunks().dictionary_encode()
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as archive:
        archive.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}"/>')
        archive.writestr("xl/styles.xml", f'<styleSheet xmlns="{_MAIN}"><cellXfs><xf numFmtId="0"/></cellXfs></styleSheet>')
        with archive.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
            for start in range(0, count, _ROWS_AT_ONCE):
                size = min(_ROWS_AT_ONCE, count - start)
                numbers = pa.array(np.arange(start + 1, start + size + 1)).cast(pa.string())
                cells = []
                for c in range(len(columns)):
                    places = shared.indices.slice(c * count + start, size).cast(pa.string())
                    cell = _joined(f'<c r="{_letters(c)}', numbers, '" t="s"><v>', places, "</v></c>")
                    cells.append(pc.fill_null(cell, ""))
                sheet.write(_bytes(_joined('<row r="', numbers, '">', *cells, "</row>")))
            sheet.write(b"</sheetData></worksheet>")
        with archive.open("xl/sharedStrings.xml", "w") as strings:
            strings.write(f'<sst xmlns="{_MAIN}" count="{total}" uniqueCount="{len(shared.dictionary)}">'.encode())
            texts = shared.dictionary
            for mark, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
                texts = pc.replace_substring(texts, mark, written)
            strings.write(_bytes(_joined('<si><t xml:space="preserve">', texts, "</t></si>")))
            strings.write(b"</sst>")
    return content.getvalue()


def _bytes(texts: pa.Array) -> memoryview:
    """All texts one after the other."""
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)
    return memoryview(data)[ends[texts.offset] : ends[texts.offset + len(texts)]]


def _write(path: str, content: bytes) -> None:
    """The file is there whole or not at all, however often its task runs."""
    store, where = file_system(path)
    parent, _, name = where.rpartition("/")
    store.create_dir(parent, recursive=True)
    unfinished = f"{parent}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(unfinished) as stream:
        stream.write(content)
    store.move(unfinished, where)


def write_workbooks(df: DataFrame, folder: str) -> None:
    """Rows of text in workbooks of a bounded size that tasks make and write to the shared folder, and a damaged one."""
    names = df.columns
    number = 4 + df.count() // ROWS_PER_WORKBOOK

    def pack(rows: pa.Table) -> pa.Table:
        name = rows["_file"][0].as_py()
        _write(f"{folder}/{name}", _workbook(names, [rows[c].combine_chunks() for c in rows.column_names if c != "_file"]))
        return pa.table({"name": [name]})

    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    dealt = plain.withColumn("_file", F.format_string("export-%05d.xlsx", F.pmod(F.xxhash64(*plain.columns), F.lit(number))))
    dealt.groupBy("_file").applyInArrow(pack, "name string").agg(F.count("*")).collect()
    _write(f"{folder}/broken.xlsx", b"PK this is no workbook")


def _exported(spark, folder: str) -> DataFrame:
    return spark.read.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)


def _orders(spark, folder):
    target = staging_path(spark, "workbook-orders")
    exports.marketplace_orders(order_lines(spark, folder, *ALL, valid=False), f"{target}/csv")
    write_workbooks(_exported(spark, f"{target}/csv"), f"{target}/xlsx")
    return channels.clean_marketplace_orders(workbooks.read_marketplace_orders(spark, f"{target}/xlsx"), keywords=["ring"])


def _direct(spark, folder):
    target = staging_path(spark, "workbook-direct")
    exports.direct_sales(table(spark, folder, "orders"), f"{target}/csv")
    write_workbooks(_exported(spark, f"{target}/csv"), f"{target}/xlsx")
    return channels.clean_direct_sales(workbooks.read_direct_sales(spark, f"{target}/xlsx"))


def _damaged(spark, folder):
    target = staging_path(spark, "workbook-damaged")
    exports.direct_sales(table(spark, folder, "orders"), f"{target}/csv")
    write_workbooks(_exported(spark, f"{target}/csv"), f"{target}/xlsx")
    rows = workbooks.workbook_rows(spark, f"{target}/xlsx")
    # The orders and the total row at the end of the export.
    kept = rows.filter("Row > 0").agg(F.count("*")).scalar()
    return workbooks.damaged(rows).select("File_Source", kept.alias("Rows"))


def _overlapping(spark, folder):
    """The second export holds the orders from 1999 on once more, with their final values."""
    target = staging_path(spark, "overlapping")
    late = F.col("Order_Date") >= F.lit("1999-01-01").cast("timestamp")
    # An export is in several files, each with all lines of its orders. What the first join shuffled is gone before the second.
    lines = order_lines(spark, folder, *ALL, valid=False)
    old = lines.withColumn("Net_Sales", F.when(late, F.col("Net_Sales") + 1).otherwise(F.col("Net_Sales")))
    for export in (old, lines.filter(late)):
        exports.marketplace_orders(export.repartition("Order_ID"), target)
    raw = delimited.read_csv(spark, target, exports.FILES)
    clean = partial(channels.clean_marketplace_orders, keywords=["ring"])
    return versions.of_newest_file(raw, exports._source_name(exports.layouts.MARKETPLACE_ORDERS, "Order_ID"), clean=clean, cleaned_key="Order_ID")


_STATUSES = {"F": "สำเร็จแล้ว", "O": "กำลังจัดส่ง"}
_DIRECT_SQL = """SELECT o_orderkey AS "Order_ID", o_orderdate AS "Order_Date", o_orderpriority AS "Customer_Type", round(o_totalprice, 2) AS "Net_Sales",
  round(o_totalprice, 2) AS "Total_Amount", 1 AS "Quantity", 'direct' AS "Platform" FROM orders"""

CHECKS = [
    Check("workbook_orders", _ORDER, _orders, _order_sql("marketplace", _STATUSES, True), (RAW_LINES, LINES)),
    Check("workbook_direct", "Order_ID:s Order_Date:t Customer_Type:s Net_Sales:f4 Total_Amount:f4 Quantity:f4 Platform:s", _direct, _DIRECT_SQL),
    Check("workbook_damaged", "File_Source:s Rows:l", _damaged, "SELECT 'broken.xlsx' AS \"File_Source\", count(*) + 1 AS \"Rows\" FROM orders"),
    Check("overlapping_exports", _ORDER, _overlapping, _order_sql("marketplace", _STATUSES, True), (RAW_LINES, LINES)),
]
