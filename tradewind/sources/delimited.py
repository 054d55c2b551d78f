"""CSV exports with a plain header, and the two kinds of reports with irregular headers."""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.functions import parsing
from tradewind.functions.numbers import first_match
from tradewind.sources import layouts
from tradewind.sources.files import decoded, first_lines, listing, literal_path

# Columns every reader adds: the file, and what is needed to put rows in the order they were written.
FILE_COLUMNS = ["File_Source", "File_Modified", "File_Block", "File_Row"]


def _file_columns() -> dict[str, Column]:
    return {
        "File_Source": decoded("_metadata.file_name"),
        "File_Modified": F.col("_metadata.file_modification_time"),
        "File_Block": F.col("_metadata.file_block_start"),
        "File_Row": F.monotonically_increasing_id(),
    }


def _lines(spark: SparkSession, paths, glob: str) -> DataFrame:
    """Lines with their file; only the order inside one block of a file is meaningful."""
    text = spark.read.option("pathGlobFilter", glob).text(paths)
    return text.select(
        "value",
        decoded("_metadata.file_path").alias("File_Path"),
        *[column.alias(name) for name, column in _file_columns().items()],
    )


def with_line_breaks(spark: SparkSession, paths: Sequence[str]) -> set[str]:
    """Files in which a quoted cell goes over several lines: some line has an odd number of quotes."""
    if not paths:
        return set()
    odd = (F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    found = spark.read.text([literal_path(p) for p in paths]).filter(odd).select(decoded("_metadata.file_path").alias("path")).distinct()
    return {row["path"] for row in found.collect()}


def read_csv(spark: SparkSession, paths: str | Sequence[str], glob: str = "*.csv", multi_line: bool | None = None) -> DataFrame:
    """All CSV files of a folder as text columns, joined by column name.

    Files may have their columns in different order. Files with the same header line are read together
    with an explicit schema; there are as many reads as there are different header lines. Blank lines above the
    header are skipped. Files with line breaks inside quotes are found by a scan and read as a whole, the others
    are split among tasks; ``multi_line`` says so for all files instead.
    """
    found = [row["path"] for row in listing(spark, paths, glob).select("path").collect()]
    result = read_files(spark, found, headers(spark, found), multi_line)
    if result is None:
        raise FileNotFoundError(f"no CSV file with a header in {paths}")
    return result


def headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """Column names per file that has a header."""
    found = {}
    for path, line in first_lines(spark, paths).items():
        names = tuple(n.strip() for n in next(csv.reader([(line or "").lstrip("\ufeff")]), []))
        if names:
            found[path] = names
    return found


def read_files(spark: SparkSession, paths: Sequence[str], names_of: Mapping[str, tuple[str, ...]], multi_line: bool | None = None) -> DataFrame | None:
    """The given files, by their headers; None if no file has one."""
    readable = [p for p in paths if p in names_of]
    if multi_line is None:
        plain = {p.split(":", 1)[-1].lstrip("/") for p in with_line_breaks(spark, readable)}
        broken = {p for p in readable if p.split(":", 1)[-1].lstrip("/") in plain}
    else:
        broken = set(readable) if multi_line else set()
    groups: dict[tuple, list[str]] = defaultdict(list)
    for path in readable:
        groups[names_of[path], path in broken].append(literal_path(path))
    result = None
    for (names, whole), files in sorted(groups.items()):
        seen: dict[str, int] = {}
        unique = []
        for name in names:  # a repeated header gets a running number
            seen[name] = seen.get(name, -1) + 1
            unique.append(f"{name}.{seen[name]}" if seen[name] else name)
        schema = ", ".join(f"`{n}` string" for n in unique)
        part = (
            spark.read.schema(schema)
            .options(header=True, quote='"', escape='"', multiLine=whole)
            .csv(files)
            .withColumns(_file_columns())
        )
        result = part if result is None else result.unionByName(part, allowMissingColumns=True)
    return result


def csv_cells(line: Column) -> Column:
    """Cells of one CSV line, honouring quotes, in time proportional to its length.

    Between quotes commas are text. A quote that is doubled inside a quoted cell leaves nothing between the two.
    """
    separator, end = "\u0001", "\u0002"
    marked = F.transform(
        F.split(F.concat(line, F.lit(end)), '"', -1),
        lambda s, i: F.when(i % 2 == 1, s).when((s == "") & (i > 0), F.lit('"')).otherwise(F.replace(s, F.lit(","), F.lit(separator))),
    )
    return F.split(F.translate(F.array_join(marked, ""), end, ""), separator, -1)


def pick(cells: Column, header: Column, name: str) -> Column:
    """The cell below the first header called ``name``; null when there is none or it is blank."""
    return filled(F.get(cells, (F.array_position(header, name) - 1).cast("int")))


def filled(cell: Column) -> Column:
    """A cell, null when it is blank."""
    return F.when(F.trim(cell) != "", cell)


def read_ads_reports(spark: SparkSession, paths: str | Sequence[str], glob: str = "*.csv", names: Mapping[str, str] = layouts.ADS) -> DataFrame:
    """Ads reports with free text above the header line; a file without such a header gives no rows.

    Files are read line by line, so a large one is split among tasks. The header is in a file's first
    block; every line of a later block is data.
    """
    start = layouts.ADS_HEADER_START
    lines = _lines(spark, paths, glob).withColumn("value", F.regexp_replace("value", "^\ufeff|\r$", ""))
    is_header = F.startswith("value", F.lit(start)) | F.contains("value", F.lit(start + ","))
    headers = (
        lines.filter((F.col("File_Block") == 0) & is_header)
        .groupBy("File_Path")
        .agg(F.min_by("value", "File_Row").alias("_line"), F.min("File_Row").alias("_at"))
        .withColumn("_header", F.transform(csv_cells(F.col("_line")), lambda c: F.trim(c)))
        .select("File_Path", "_header", "_at")
    )
    below = (F.col("File_Block") > 0) | (F.col("File_Row") > F.col("_at"))
    rows = (
        lines.join(headers, "File_Path")
        .filter(below & (F.trim("value") != ""))
        .withColumn("_cells", csv_cells(F.col("value")))
    )
    period_start, period_end = parsing.file_dates("File_Source", "ads")
    return rows.select(
        *[pick(F.col("_cells"), F.col("_header"), source).alias(name) for source, name in names.items()],
        "File_Source",
        period_start.alias("Period_Start"),
        period_end.alias("Period_End"),
    )


def _combined_header(upper: Column, lower: Column) -> Column:
    """Two header rows as one: blanks of the upper row take the text to their left."""
    filled = F.aggregate(
        F.zip_with(upper, lower, lambda u, l: F.named_struct(F.lit("u"), u, F.lit("l"), l)),
        F.struct(F.lit("").alias("current"), F.array().cast("array<string>").alias("out")),
        lambda acc, pair: _next_header(acc, pair),
    )
    return filled.getField("out")


def _next_header(acc: Column, pair: Column) -> Column:
    upper, lower = pair.getField("u"), F.coalesce(pair.getField("l"), F.lit(""))
    current = F.when(F.coalesce(upper, F.lit("")) != "", upper).otherwise(acc.getField("current"))
    name = F.when(lower != "", F.concat(current, F.lit("_"), lower)).otherwise(current)
    return F.struct(current.alias("current"), F.concat(acc.getField("out"), F.array(name)).alias("out"))


def map_header(header: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Canonical name of a header by the first text it contains; null when none fits."""
    return first_match([(F.contains(header, F.lit(text)), name) for text, name in rules], None)


def read_overview_reports(
    spark: SparkSession, paths: str | Sequence[str], rules: Sequence[tuple[str, str]], glob: str = "*.csv", first_row_only: bool = False
) -> DataFrame:
    """Overview reports: two header rows and the data rows below them; shorter files give no rows.

    These reports hold few rows of figures by their format, so a whole file is one small value. The report
    date stands in the file name, or else in the name of the folder. ``first_row_only`` leaves out all data rows but
    the first of each file.
    """
    text = spark.read.option("pathGlobFilter", glob).text(paths, wholetext=True)
    lines = F.filter(F.split(F.regexp_replace("value", "^\ufeff", ""), "\r?\n"), lambda x: F.trim(x) != "")
    path = F.split(decoded("_metadata.file_path"), "/")
    reports = text.select(F.element_at(path, -1).alias("File_Source"), F.element_at(path, -2).alias("Folder"), lines.alias("lines"))
    reports = reports.filter(F.size("lines") >= 3)
    header = _combined_header(csv_cells(F.col("lines")[0]), csv_cells(F.col("lines")[1]))
    data = F.slice("lines", 3, 1) if first_row_only else F.slice("lines", F.lit(3), F.size("lines"))
    reports = reports.select(
        "File_Source", "Folder", F.transform(header, lambda h: map_header(h, rules)).alias("names"), F.explode(data).alias("line")
    ).withColumn("cells", csv_cells(F.col("line")))
    _, in_name = parsing.file_dates("File_Source", "live")
    _, in_folder = parsing.file_dates("Folder", "live")
    canonical = list(dict.fromkeys(name for _, name in rules))
    return reports.select(
        *[pick(F.col("cells"), F.col("names"), name).alias(name) for name in canonical],
        "File_Source",
        F.coalesce(in_name, in_folder).alias("Report_Date"),
    )
