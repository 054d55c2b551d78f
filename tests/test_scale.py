"""Work that has to stay with the tasks, whatever the size of the tables."""

from __future__ import annotations

import io
import zipfile
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import adapters, exports, jobs, workbooks as written
from checks.base import Check
from tradewind import session
from tradewind.functions import parsing
from tradewind.operators import versions
from tradewind.plans import months, sinks
from tradewind.sources import delimited, workbooks

LINE = """Order_ID bigint, Line_Key string, Order_Status string, Order_Date timestamp, Product_Name string, SKU string, Original_Price double,
  Net_Sales double, Platform_Discount double, Seller_Discount double, Commission double, Transaction_Fee double, Service_Fee double,
  Quantity double, Province string, Buyer_Username string"""


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def order_lines(spark, orders: int = 40, year: int = 2024):
    """Two lines an order, on two days of neighbouring months for every fifth."""
    rows = spark.range(orders).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    day = F.date_add(F.lit(f"{year}-01-30").cast("date"), (F.col("id") % 3 * 20 + F.when(F.col("id") % 5 == 0, F.col("n") * 3).otherwise(0)).cast("int"))
    return rows.select(
        F.col("id").alias("Order_ID"), F.concat_ws("-", "id", "n").alias("Line_Key"), F.lit("F").alias("Order_Status"), day.cast("timestamp").alias("Order_Date"),
        F.lit("shirt").alias("Product_Name"), F.lit("S").alias("SKU"), F.lit(5.0).alias("Original_Price"), (F.col("id") + 0.5).alias("Net_Sales"),
        *[F.lit(0.0).alias(c) for c in ("Platform_Discount", "Seller_Discount", "Commission", "Transaction_Fee", "Service_Fee")],
        F.lit(1.0).alias("Quantity"), F.lit("P").alias("Province"), F.concat(F.lit("b"), F.col("id") % 7).alias("Buyer_Username"),
    )


def test_workbooks_are_written_by_tasks(spark, tmp_path, monkeypatch):
    """No content passes the driver, and nulls, quotes and marks come back as they were."""
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *_, **__: pytest.fail("contents go through the driver"))
    monkeypatch.setattr(written, "ROWS_PER_WORKBOOK", 50)
    rows = [(str(i), "a & <b>" if i % 2 else None, f"{i % 3}฿") for i in range(300)]
    written.write_workbooks(spark.createDataFrame(rows, "A string, B string, C string"), f"{tmp_path}/books")
    found = workbooks.sheet(workbooks.workbook_rows(spark, f"{tmp_path}/books"), {"A": "A", "B": "B", "C": "C"})
    assert sorted((r["A"], r["B"], r["C"]) for r in found.collect()) == sorted(rows)
    assert found.select("File_Source").distinct().count() > 4
    assert not [p.name for p in (tmp_path / "books").iterdir() if p.name.startswith(".export")]


def test_rows_of_workbooks_are_not_shuffled_for_their_headers(spark, tmp_path):
    written.write_workbooks(spark.createDataFrame([("1",)], "A string"), f"{tmp_path}/books")
    rows = workbooks.workbook_rows(spark, f"{tmp_path}/books")
    assert "SortMergeJoin" not in plan_of(workbooks.sheet(rows, {"A": "A"}))
    assert [r["File_Source"] for r in workbooks.damaged(rows).collect()] == ["broken.xlsx"]


def _sheet(xml: str) -> bytes:
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as archive:
        archive.writestr("xl/worksheets/sheet1.xml", xml)
    return content.getvalue()


@pytest.mark.parametrize("piece", [7, 64, 1 << 18])
def test_sheet_in_pieces(monkeypatch, piece):
    """Whatever the pieces, all rows come; of a damaged sheet those before the damage, then the error."""
    monkeypatch.setattr(workbooks, "_PIECE_BYTES", piece)
    row = '<row r="{0}"><c r="B{0}"><v>{0}.0</v></c><c r="AA{0}" t="inlineStr"><is><t>x</t><t>y</t></is></c></row>'
    body = "".join(row.format(i) for i in (1, 2, 5, 9))
    expected = [(i - 1, [None, str(i), *[None] * 24, "xy"]) for i in (1, 2, 5, 9)]
    assert list(workbooks._sheet_rows(_sheet(f'<w:worksheet xmlns:w="u" xmlns="u"><sheetData>{body}</sheetData></w:worksheet>'))) == expected
    assert list(workbooks._sheet_rows(_sheet("<worksheet><sheetData/></worksheet>"))) == []
    found = []
    with pytest.raises(SyntaxError):
        found.extend(r for r in _kept(found, workbooks._sheet_rows(_sheet(f'<worksheet><sheetData>{body}<row r="10"><c></row>'))))
    assert found[:4] == expected


def _kept(found: list, rows):
    for row in rows:
        found.append(row)
    return ()


def test_overlapping_exports_are_not_written_by_one_task(spark, monkeypatch, tmp_path):
    """All lines of an order are in one file of an export, which has several."""
    plans = []
    monkeypatch.setattr(written, "order_lines", lambda *_, **__: order_lines(spark, year=1999))
    monkeypatch.setattr(exports, "_write_csv", lambda df, folder: (plans.append(plan_of(df)), df.write.mode("append").option("header", True).csv(folder)))
    assert written._overlapping(spark, "").count() == 80
    assert len(plans) == 2 and not any("Coalesce " in p for p in plans)


def test_line_breaks_are_found_without_a_pattern(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h\n"x\ny"\n')
    (tmp_path / "b.csv").write_text('h\n"x ""y"""\n฿"z"\n')
    found = delimited.with_line_breaks(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv")])
    assert [p.rsplit("/", 1)[-1] for p in found] == ["a.csv"]


def test_currency_without_a_pattern(spark):
    values = ["฿1,234.5678", '"฿ 1 0\t,\n0\x0b\f\r"', "", None, "x1", "1e3", "-฿2", " 5"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(parsing.currency("v").alias("v"))
    assert "regexp_replace" not in plan_of(df)
    assert [r["v"] for r in df.collect()] == [1234.5678, 100.0, 0.0, 0.0, 0.0, 1000.0, -2.0, 0.0]


def test_rows_of_a_merge_are_shuffled_once(spark, tmp_path, monkeypatch):
    """The rows are joined with the few orders that are late, have several versions or lie in several months, and the result is that
    of all of them: an order is in its first month, in its newest version, with or without dates."""
    plans = []

    def spied(df, *args):
        if args[0] == "rebalance":
            plans.append(plan_of(df))
        return hint(df, *args)

    hint = type(spark.range(1)).hint
    monkeypatch.setattr(type(spark.range(1)), "hint", spied)
    schema = "`Order ID` string, v int, day date, File_Modified timestamp, File_Source string"
    store = months.MonthlyStore(spark, f"{tmp_path}/store", lambda df: df, date=F.col("day"), parts=lambda lines: {})
    first, second, third = (datetime(2024, 5, n) for n in (1, 2, 3))
    jan, feb, mar = date(2024, 1, 31), date(2024, 2, 1), date(2024, 3, 1)
    rows = [("a", 1, feb, second, "f"), ("a", 2, jan, second, "f"), ("b", 1, jan, first, "e"), ("b", 2, feb, second, "f"), ("b", 3, None, second, "f"),
            ("c", 1, None, first, "e"), (None, 1, mar, first, "e"), ("d", 1, jan, second, "f"), ("d", 1, jan, second, "f")]
    store.merge(spark.createDataFrame(rows, schema), 0)

    def held():
        return sorted((r["Order ID"] or "", r["v"], r["Month"]) for r in store.rows().collect())

    kept = [("", 1, "2024-03"), ("a", 1, "2024-01"), ("a", 2, "2024-01"), ("b", 2, "2024-02"), ("b", 3, "2024-02"), ("c", 1, "undated"), ("d", 1, "2024-01"), ("d", 1, "2024-01")]
    assert held() == kept
    late = [("b", 9, mar, first, "e"), ("c", 5, mar, third, "g"), ("e", 1, feb, first, "e")]
    store.merge(spark.createDataFrame(late, schema), 1, stored_rows=True)
    assert held() == sorted([k for k in kept if k[0] != "c"] + [("c", 5, "2024-03"), ("e", 1, "2024-02")])
    assert "SortMergeJoin" not in plans[0] and "BroadcastHashJoin" in plans[0]


def test_newest_row_is_chosen_before_the_shuffle(spark):
    rows = [(k, o, f"{k}{o}") for k in (None, "a", "b") for o in (None, 1, 2)]
    found = versions.newest(spark.createDataFrame(rows, "k string, o int, v string"), ["k"], ["o"])
    assert sorted(r["v"] for r in found.collect()) == ["None2", "a2", "b2"]
    plan = plan_of(found)
    assert "SortAggregate" not in plan and plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")


def test_stream_files_are_not_written_by_one_task(spark, monkeypatch, tmp_path):
    """No query on exports or streams has its rows written by one task."""
    monkeypatch.setattr(DataFrame, "coalesce", lambda self, n: pytest.fail("one task writes all") if "o_orderkey" in self.columns else self.repartition(n))
    monkeypatch.setattr(type(spark.range(1)), "coalesce", DataFrame.coalesce)
    orders = spark.range(30).selectExpr("id AS o_orderkey", "1.0D AS o_totalprice", "timestamp'2024-01-01' AS o_orderdate")
    monkeypatch.setattr(jobs, "table", lambda *_: orders)
    found = jobs._stream_months(spark, "")
    assert sorted(r["o_orderkey"] for r in found.collect()) == list(range(30))


def test_lines_of_the_channels_are_joined_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(jobs.refresh, "full_refresh", lambda sources, _: plans.extend(plan_of(sources[c]) for c in ("marketplace", "social", "direct")) or [])
    monkeypatch.setattr(jobs.refresh, "table_sizes", lambda tables: None)
    jobs._full_refresh(spark, "/root/testdata/sf0.001")
    assert len(plans) == 3 and not any("Join" in p for p in plans)


def test_a_monthly_query_reads_the_tables_of_its_own_run(spark, monkeypatch):
    """A store that an earlier query built of the same folder is not used again."""
    built = []
    monkeypatch.setattr(jobs, "_monthly_store", lambda *_: built.append(1) or type("Store", (), {"tables": lambda self: {"products": len(built)}})())
    assert [jobs._monthly(spark, "folder", "products") for _ in range(2)] == [1, 2]


@pytest.mark.parametrize("job", [jobs._incremental, jobs._monthly_store])
def test_lines_of_two_exports_are_joined_once(spark, monkeypatch, job):
    """Both exports read the stored lines; the join that gives these is not repeated."""
    plans = []
    write = exports.social_orders
    monkeypatch.setattr(jobs, "order_lines", lambda *_, **__: order_lines(spark, year=1999))
    monkeypatch.setattr(exports, "social_orders", lambda lines, folder: (plans.append(plan_of(lines)), write(lines, folder)))
    job(spark, "")
    assert len(plans) == 2 and not any("Range" in p for p in plans)


def test_rows_are_not_sorted_for_their_newest_file(spark):
    """Only the keys are in the hash table; a key without a value is one key, and all rows it has in its newest file stay."""
    rows = [(1, "a", 1, "x"), (1, "a", 2, "y"), (2, "b", 1, "x"), (1, None, 1, "x"), (2, None, 1, "x"), (2, None, 1, "x")]
    df = spark.createDataFrame(rows, "File_Modified int, key string, n int, File_Source string")
    found = versions.of_newest_file(df, "key")
    assert "ShuffledHashJoin" in plan_of(found) and "SortMergeJoin" not in plan_of(found)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([rows[1], rows[2], rows[4], rows[5]], key=str)


def test_plain_cells_and_strings_are_not_parsed_one_by_one(spark, tmp_path, monkeypatch):
    """The XML parser sees the rows, not their cells; names are looked up once per file, not for every row."""
    rows = [(str(i), "a & <b>" if i % 2 else None, f"{i % 3}฿") for i in range(300)]
    written.write_workbooks(spark.createDataFrame(rows, "A string, B string, C string"), f"{tmp_path}/books")
    for helper in ("_value", "_text"):
        monkeypatch.setattr(workbooks, helper, lambda *_: pytest.fail("a cell was parsed by itself"))
    found = []
    for path in sorted((tmp_path / "books").glob("export-*.xlsx")):
        head, *body = [cells for _, cells in workbooks._sheet_rows(path.read_bytes())]
        found += [tuple(cells) for cells in body]
        assert head == ["A", "B", "C"]
    assert sorted(found) == sorted(rows)
    monkeypatch.undo()
    sheet = workbooks.sheet(workbooks.workbook_rows(spark, f"{tmp_path}/books"), {"C": "C", "no": "no"})
    assert "array_position" not in plan_of(sheet)
    assert sorted((r["C"], r["no"]) for r in sheet.collect()) == sorted((r[2], None) for r in rows)


@pytest.mark.parametrize("piece", [5, 90, 1 << 18])
def test_plain_and_other_cells_in_one_sheet(monkeypatch, piece):
    """Numbers, styles, gaps and blank cells are plain; what is not goes through the XML parser, wherever it stands."""
    monkeypatch.setattr(workbooks, "_PIECE_BYTES", piece)
    plain = [
        ('<row r="1"><c r="A1"><v>1.0</v></c><c r="C1" s="1"><v>1.5</v></c></row>', (0, ["1", None, "1899-12-31 12:00:00"])),
        ('<row r="3" spans="1:3"><c r="B3" t="str"><v>a&amp;b</v></c></row>', (2, [None, "a&b"])),
        ('<row><c r="A4"/><c r="B4" t="n"><v></v></c><c r="C4" t="s"><v>1</v></c></row>', (3, [None, None, "x & y"])),
    ]
    other = [
        ("<row r='7'><c><v>5</v></c><c t='inlineStr'><is><t>i</t></is></c></row>", (6, ["5", "i"])),
        ('<row r="8"/>', (7, [])),
        ('<row r="9"><!-- </row><row r="1"> --><c r="A9" t="s"><v>0</v></c></row>\n', (8, ["s"])),
        ('<row r="10"><c r="A10"><v>2</v></c><c r="B10"><v>3</v></c></row>', (9, ["2", "3"])),
    ]
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as archive:
        archive.writestr("xl/styles.xml", '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        archive.writestr("xl/sharedStrings.xml", "<sst><si><t>s</t></si><si><t>x &amp; </t><t>y</t></si></sst>")
        archive.writestr("xl/worksheets/sheet1.xml", "<worksheet><sheetData>" + "".join(x for x, _ in (*plain, *other)) + '</sheetData><rowBreaks count="0"/></worksheet>')
    assert list(workbooks._sheet_rows(content.getvalue())) == [row for _, row in (*plain, *other)]


def test_a_missing_end_is_damage(monkeypatch):
    """Whatever is plain of a sheet that breaks off comes before the error."""
    rows = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c></row>' for i in range(1, 200))
    for end in ("", "</sheetData>", "</row></sheetData></worksheet>", '<row r="200"><c r="A200"><v>1</v></row></sheetData></worksheet>'):
        found = []
        with pytest.raises(SyntaxError):
            _kept(found, workbooks._sheet_rows(_sheet(f"<worksheet><sheetData>{rows}{end}")))
        assert [p for p, _ in found][:198] == list(range(198))


def test_lines_are_joined_before_anything_is_computed_of_them(spark):
    """Only stored columns are shuffled for the joins."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(adapters.order_lines(spark, "/root/testdata/sf0.001", *adapters.ALL, valid=False))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.rindex("concat_ws") < plan.index("SortMergeJoin")


def test_exports_are_compressed_and_plain_ones_are_read_beside_them(spark, tmp_path):
    """A compressed file has its header, its line breaks and all its rows; without the pattern it is no export."""
    exports._write_csv(spark.createDataFrame([("1", "x\ny"), ("2", 'a "b",')], "k string, v string").coalesce(1), f"{tmp_path}/e")
    (tmp_path / "e" / "plain.csv").write_text("v,k\nz,3\n")
    assert [p.suffix for p in (tmp_path / "e").glob("part-*")] == [".gz"]
    found = delimited.read_csv(spark, f"{tmp_path}/e", exports.FILES)
    assert sorted((r["k"], r["v"]) for r in found.collect()) == [("1", "x\ny"), ("2", 'a "b",'), ("3", "z")]
    assert [r["k"] for r in delimited.read_csv(spark, f"{tmp_path}/e").collect()] == ["3"]
    (tmp_path / "e" / "damaged.csv.gz").write_bytes(b"not compressed")
    paths = [str(p) for p in (tmp_path / "e").glob("damaged*")]
    assert delimited.headers(spark, paths) == {}


def test_staged_rows_stay_together_and_go_after_their_use(spark, tmp_path):
    """However small the pieces in which files are read, one task has all rows of a value; odd values come back as they were."""
    odd = [(None, None, None, None), (1, "", float("nan"), datetime(2024, 1, 2, 3, 4, 5, 6)), (2, 'a\n"b"\\ ฿', -0.1, datetime(1899, 1, 1)), (3, "null", float("inf"), None)]
    df = spark.createDataFrame(odd, "k int, s string, d double, t timestamp")
    many = spark.range(20_000).selectExpr("CAST(id % 7 AS INT) + 10 k", "uuid() s", "rand() d", "timestamp_micros(id) t").unionByName(df)
    expected = sorted(map(str, many.filter("k < 10 OR k IS NULL").collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        with session.staged(many, "odd", together="k") as rows:
            assert sorted(map(str, rows.filter("k < 10 OR k IS NULL").collect())) == expected
            tasks = rows.withColumn("task", F.spark_partition_id()).groupBy("k").agg(F.count_distinct("task").alias("tasks"), F.count("*").alias("n")).collect()
            paths = rows.inputFiles()
        with session.staged(many, "odd") as rows:
            assert rows.count() == 20_004
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["tasks"] for r in tasks} == {1} and sum(r["n"] for r in tasks) == 20_004
    assert paths and not any(Path(p.removeprefix("file:")).exists() for p in paths)


def test_rows_are_cleaned_before_they_meet_their_newest_file(spark):
    """A row that cleaning drops hides older versions all the same; fewer columns are shuffled."""
    rows = [(1, "x", "a", "ok", "1"), (2, "y", "a", "bad", "2"), (1, "x", "b", "ok", "3"), (2, "y", None, "ok", "4"), (1, "x", None, "ok", "5")]
    df = spark.createDataFrame(rows, "File_Modified int, File_Source string, key string, status string, n string")
    clean = lambda raw: raw.filter("status = 'ok'").selectExpr("File_Modified", "File_Source", "key AS k", "CAST(n AS INT) AS n")
    found = versions.of_newest_file(df, "key", clean=clean, cleaned_key="k")
    assert found.columns == ["File_Modified", "File_Source", "k", "n"]
    assert sorted(r["n"] for r in found.collect()) == [3, 4]


@pytest.mark.parametrize("few", [0, 1, 100])
def test_single_rows_are_not_ranked(spark, monkeypatch, few):
    """Whether the repeated keys are looked up or all rows are ranked, the newest row of every key is found."""
    monkeypatch.setattr(versions, "FEW_REPEATED", few)
    rows = [("a", None, 1), ("a", None, 2), (None, "a", 1), (None, None, 1), ("b", "b", 1), ("c", "d", 2), ("c", "d", 3), ("c", "d", None)]
    df = spark.createDataFrame(rows, "k string, l string, o int")
    found = versions.newest_of_files(df, ["k", "l"], ["o"])
    assert sorted(map(str, found.collect())) == sorted(map(str, versions.newest(df, ["k", "l"], ["o"]).collect()))
    single = versions.newest_of_files(df.filter("o = 1"), ["k", "l"], ["o"])
    assert "Window" not in plan_of(single) and single.count() == 4


def test_shuffles_of_a_query_go_with_its_steps(spark):
    Check("x", "id:l", lambda s, _: s.range(3)).run(spark, "").collect()
    assert all(spark.conf.get(key) == value for key, value in session.RELEASE_SHUFFLES.items())


def test_order_and_version_are_not_shuffled_with_the_rows(spark, tmp_path, monkeypatch):
    shuffled = []
    hint = type(spark.range(1)).hint
    monkeypatch.setattr(type(spark.range(1)), "hint", lambda df, *args: (shuffled.append(df.columns), hint(df, *args))[1])
    store = months.MonthlyStore(spark, f"{tmp_path}/store", lambda df: df, date=F.col("day"), parts=lambda lines: {})
    rows = [("a", date(2024, 1, 1), datetime(2024, 5, 1), "f"), (None, None, datetime(2024, 5, 1), "f")]
    for number in range(2):
        store.merge(spark.createDataFrame(rows, "`Order ID` string, day date, File_Modified timestamp, File_Source string"), number)
    assert shuffled and all("Month" in columns and "_version" not in columns for columns in shuffled if "day" in columns)
    assert store.rows().count() == 2 and store.snapshot() == {"2024-01": 1, "undated": 1}


def test_exports_of_a_run_are_compressed_if_asked_for(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "a int, `GMV_Contribution_Pct` double")
    sinks.export_csv(df, str(tmp_path), "plain")
    sinks.export_csv(df, str(tmp_path), "small", "gzip")
    ends = {name: {p.suffix for p in (tmp_path / name).glob("part-*")} for name in ("plain", "small")}
    assert ends == {"plain": {".csv"}, "small": {".gz"}}
    assert delimited.read_csv(spark, f"{tmp_path}/small", exports.FILES).first()["GMV_Contribution_%"] == "2.0"
