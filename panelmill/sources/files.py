"""Readers for the messy text inputs: charset fallback, preambles, header detection, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.constants import SHEET_BLOCKLIST
from panelmill.functions.headers import drop_unnamed, has_table_shape, normalise_headers
from panelmill.functions.text import match_key, named_like

BOM = r"\x{feff}"


def file_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, line, value): the text lines of all files, read in splits.

    `line` counts from 0 within each file, and `block` is where its split begins. The scan keeps the
    bytes as they are; a file with any line that is not valid UTF-8 is read as latin-1 as a whole.
    Ids run on within a split, so its first id and the lines of the splits before it number its lines.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )
    splits = raw.groupBy("file", "block").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("lines"), F.bool_or(~F.is_valid_utf8("value")).alias("broken")
    )
    of_file = Window.partitionBy("file")
    before = F.sum("lines").over(of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select(
        "file", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.bool_or("broken").over(of_file).alias("latin")
    )
    decoded = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    text = F.when(F.col("latin"), decoded).otherwise(F.col("value"))
    return raw.join(splits, ["file", "block"]).select(
        "file", "block", (F.col("id") + F.col("shift")).alias("line"),
        F.regexp_replace(F.rtrim(text, F.lit("\r")), f"^{BOM}", "").alias("value"),
    )


def files_by_charset(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """Names of the files that are valid UTF-8 and of those to be read as latin-1."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    flagged = lines.groupBy("file").agg(F.bool_or(~F.is_valid_utf8("value")).alias("latin")).collect()
    return {
        "UTF-8": [r.file for r in flagged if not r.latin],
        "ISO-8859-1": [r.file for r in flagged if r.latin],
    }


def read_csv_with_fallback(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, **options
) -> DataFrame:
    """CSV scan as UTF-8 (with or without BOM); files that are not valid UTF-8 as latin-1.

    Without a schema all columns are read as text, to be cast by the cleaning operators.
    """
    parts = []
    for charset, names in files_by_charset(spark, path).items():
        if names:
            reader = spark.read.options(header=True, encoding=charset, **options)
            parts.append((reader.schema(schema) if schema else reader).csv(names))
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part, allowMissingColumns=True)
    return combined


def read_text_with_fallback(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, value) lines of the files after the same charset decision."""
    return file_lines(spark, path).select("file", "value")


def csv_fields(line: Column) -> Column:
    return F.split(line, ",", -1)


def header_by_prefix(lines: DataFrame, prefix: str) -> DataFrame:
    """First line of each file whose match key starts with `prefix`."""
    matching = lines.where(F.startswith(match_key(F.col("value")), F.lit(prefix)))
    return _first_line(matching)


def header_by_width(lines: DataFrame, cells: int = 3, preview: int = 20) -> DataFrame:
    """First of the leading lines of each file with at least `cells` filled cells; else line one.

    `line` must count from 0 within each file.
    """
    filled = F.size(F.filter(csv_fields(F.col("value")), lambda c: F.trim(c) != ""))
    lead = lines.where(F.col("line") < preview).withColumn("wide", filled >= cells)
    pick = F.min(F.struct((~F.col("wide")).alias("narrow"), F.col("block"), F.col("line"), F.col("value")))
    return lead.groupBy("file").agg(pick.alias("h")).select(
        "file", F.col("h.block").alias("header_block"), F.col("h.line").alias("header_line"), F.col("h.value").alias("header")
    )


def _first_line(lines: DataFrame) -> DataFrame:
    first = F.min(F.struct("block", "line", "value")).alias("h")
    return lines.groupBy("file").agg(first).select(
        "file", F.col("h.block").alias("header_block"), F.col("h.line").alias("header_line"), F.col("h.value").alias("header")
    )


def body_lines(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines after the header of their file."""
    place = F.struct("block", "line")
    start = F.struct(F.col("header_block").alias("block"), F.col("header_line").alias("line"))
    return lines.join(headers, "file").where((place > start) & (F.trim("value") != ""))


def read_csv_after_preamble(spark: SparkSession, path: str | list[str], prefix: str) -> DataFrame:
    """CSV scan that skips what precedes the header line; all files share that header."""
    lines = file_lines(spark, path)
    headers = header_by_prefix(lines, prefix)
    names = [r.header for r in headers.select("header").distinct().limit(2).collect()]
    if len(names) != 1:
        raise ValueError(f"expected one header starting with {prefix!r}, found {len(names)}")
    columns = [c.strip() or f"unnamed_{i}" for i, c in enumerate(names[0].split(","))]
    parsed = F.from_csv("value", ", ".join(f"`{c}` string" for c in columns))
    return body_lines(lines, headers).select(parsed.alias("row")).select("row.*")


def load_sector_index(spark: SparkSession, path: str, value: str, prefix: str | None = None) -> DataFrame:
    """Monthly index series from a CSV that may start with a preamble."""
    from panelmill.functions.dates import add_month_date
    from panelmill.functions.numbers import locale_number

    raw = read_csv_after_preamble(spark, path, prefix) if prefix else read_csv_with_fallback(spark, path)
    dated = add_month_date(drop_unnamed(normalise_headers(raw)))
    return dated.select("fecha", locale_number(F.col(value)).alias(value))


def valid_source_name(name: Column) -> Column:
    """False for summaries, dashboards, charts, pivots and index sheets."""
    return ~named_like(name, SHEET_BLOCKLIST)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_profile(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows and columns of each file with an accepted name that holds a table."""
    body = body_lines(lines, headers)
    width = F.size(csv_fields(F.col("header")))
    counted = body.groupBy("file").agg(F.count(F.lit(1)).alias("filas"), F.max(width).alias("columnas"))
    return counted.where(valid_source_name(file_name(F.col("file"))) & (F.col("columnas") >= 2))


def load_tables(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Named catalog of sources as temporary views; inputs without a table are left out."""
    tables = {}
    for name, path in paths.items():
        df = spark.read.parquet(path) if path.endswith(".parquet") else read_csv_with_fallback(spark, path)
        df = normalise_headers(df, "dotless")
        if has_table_shape(df):
            df.createOrReplaceTempView(name)
            tables[name] = df
    return tables
