"""Spreadsheet cells in long form to summary and row-block nodes.

``cells``: doc_id, workbook, sheet_name, sheet_index, sheet_hidden, row_idx, col_idx (from 1), value.
Nothing is cut unless the caller asks for it. The only lists are the cells of a row, the rows of a block and the
columns of a sheet.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardstone import vocab as V
from wardstone.functions.ids import column_letter
from wardstone.functions.text import collapse_ws, col
from wardstone.operators.skew import broadcast_measured, kept_table, let, number_rows, settle, topk_per_key

SHEET = ["doc_id", "sheet_index"]
SHEET_FACTS = ["workbook", "sheet_name", "sheet_hidden"]


@dataclass(frozen=True)
class TabularCaps:
    """Sizes; a cap that is None is off. ``SERVICE_CAPS`` holds the service's own caps for callers who want them."""

    rows_per_block: int = V.TABULAR_ROWS_PER_BLOCK
    max_columns: int | None = None
    max_cell_chars: int | None = None
    max_blocks: int | None = None
    max_sheets: int | None = None
    header_scan: int = V.TABULAR_HEADER_SCAN_ROWS

    @property
    def max_rows(self) -> int | None:
        return None if self.max_blocks is None else self.rows_per_block * self.max_blocks + self.header_scan


SERVICE_CAPS = TabularCaps(
    max_columns=V.TABULAR_MAX_COLUMNS, max_cell_chars=V.TABULAR_MAX_CELL_CHARS, max_blocks=V.TABULAR_MAX_BLOCKS, max_sheets=V.TABULAR_MAX_SHEETS
)


def clean_cell(value, max_chars: int | None = V.TABULAR_MAX_CELL_CHARS) -> Column:
    """Collapsed cell text; longer text ends in an ellipsis within the limit, if there is one."""
    flat = collapse_ws(value)
    if max_chars is None:
        return flat
    return F.when(
        F.length(flat) > max_chars, F.concat(F.rtrim(F.left(flat, F.lit(max_chars - 1))), F.lit("…"))
    ).otherwise(flat)


def cell_text(value, kind: str | None = None) -> Column:
    """Typed scalars as text: timestamps to the second, dates and times in ISO form."""
    c = col(value)
    if kind == "timestamp":
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if kind == "date":
        return F.date_format(c, "yyyy-MM-dd")
    return c.cast("string")


def sheet_rows(cells: DataFrame, caps: TabularCaps = TabularCaps()) -> DataFrame:
    """Non-blank rows per sheet as sorted (col, value) lists, numbered, and cut to the row cap if there is one."""
    within = cells if caps.max_columns is None else cells.filter(F.col("col_idx") <= caps.max_columns)
    kept = within.withColumn("value", clean_cell("value", caps.max_cell_chars)).filter(F.col("value") != "")
    rows = kept.groupBy(*SHEET, "row_idx").agg(
        *[F.first(c).alias(c) for c in SHEET_FACTS],
        F.array_sort(F.collect_list(F.struct(F.col("col_idx").alias("c"), F.col("value").alias("v")))).alias("vals"),
    )
    if caps.max_rows is None:
        return number_rows(rows, SHEET, "row_idx", "row_no")
    return topk_per_key(rows, SHEET, [F.col("row_idx").asc()], caps.max_rows, rank_col="row_no")


def sheet_limits(rows: DataFrame, cells: DataFrame, caps: TabularCaps = TabularCaps()) -> tuple[DataFrame, DataFrame]:
    """(sheets kept with a truncated flag, warnings). Sheets past the workbook cap are named in a warning."""
    sheets = rows.groupBy(*SHEET).agg(F.first("sheet_name").alias("sheet_name"), F.count("*").alias("_n"))
    seq = Window.partitionBy("doc_id").orderBy("sheet_index")
    numbered = sheets.withColumn("_no", F.row_number().over(seq))
    full_rows = F.lit(False) if caps.max_rows is None else F.col("_n") >= caps.max_rows
    within = F.lit(True) if caps.max_sheets is None else F.col("_no") <= caps.max_sheets
    kept = numbered.filter(within).select(*SHEET, "sheet_name", full_rows.alias("truncated"))
    last = F.lit(False) if caps.max_sheets is None else F.col("_no") == caps.max_sheets
    full = numbered.filter(last).select("doc_id", F.col("sheet_index").alias("_last"))
    beyond = (
        cells.select("doc_id", "sheet_index", "sheet_name")
        .distinct()
        .join(full, "doc_id")
        .filter(F.col("sheet_index") > F.col("_last"))
        .groupBy("doc_id")
        .agg(F.min_by("sheet_name", "sheet_index").alias("_name"))
    )
    warnings = (
        kept.filter("truncated")
        .select("doc_id", F.concat(F.lit("sheet_truncated:"), "sheet_name").alias("warning"))
        .unionByName(beyond.select("doc_id", F.concat(F.lit("workbook_truncated:max_sheets:"), "_name").alias("warning")))
    )
    return kept, warnings


def _textual(vals: Column) -> Column:
    """A header-like row: two or more values, at least half with letters and half of three characters."""
    n = F.size(vals)
    half = F.greatest(F.lit(1), F.floor(n / 2))
    letters = F.size(F.filter(vals, lambda x: x["v"].rlike("[A-Za-zÀ-ÿ]")))
    long_ones = F.size(F.filter(vals, lambda x: F.length(x["v"]) >= 3))
    return (n >= 2) & (letters >= half) & (long_ones >= half)


def infer_headers(rows: DataFrame, caps: TabularCaps = TabularCaps()) -> DataFrame:
    """First header-like row among the first ten non-blank rows of each sheet; null when none is."""
    candidate = F.when((F.col("row_no") <= caps.header_scan) & _textual(F.col("vals")), F.struct("row_idx", "vals"))
    return rows.groupBy(*SHEET).agg(F.min(candidate).alias("_h"), F.max("row_idx").alias("last_row")).select(
        *SHEET, F.col("_h.row_idx").alias("header_row"), F.col("_h.vals").alias("header_vals"), "last_row"
    )


def data_rows(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows below the header; all rows when there is no header or nothing below it."""
    joined = rows.join(broadcast_measured(headers), SHEET)
    below = F.col("header_row").isNull() | (F.col("row_idx") > F.col("header_row"))
    return joined.filter(below | (F.col("last_row") <= F.col("header_row")))


def active_columns(data: DataFrame) -> DataFrame:
    """Columns with any value in the data rows, in sheet order, with their real positions."""
    return (
        data.select(*SHEET, F.explode("vals").alias("x"))
        .groupBy(*SHEET)
        .agg(F.array_sort(F.collect_set("x.c")).alias("columns"))
    )


def unique_headers(columns: Column, header_vals: Column) -> Column:
    """Header per active column: blank becomes col_<letter>, repeats get a running suffix."""
    found = F.transform(
        columns,
        lambda c: F.coalesce(
            F.try_element_at(F.filter(header_vals, lambda h: h["c"] == c), F.lit(1))["v"],
            F.concat(F.lit("col_"), column_letter(c)),
        ),
    )
    def suffix(names):
        def one(name, i):
            earlier = F.size(F.filter(F.slice(names, F.lit(1), i), lambda o: o == name))
            return F.when(earlier > 0, F.concat(name, F.lit("_"), (earlier + 1).cast("string"))).otherwise(name)

        return F.transform(names, one)

    return let(found, suffix)


def sheet_table(cells: DataFrame, caps: TabularCaps = TabularCaps()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sheets with headers, their data rows, warnings).

    Rows are made once. What is one row a sheet is settled and sent to the rows where its bytes allow: a join by sheet would bring a
    whole sheet, and everything grouped after it, to one task.
    """
    rows = kept_table(sheet_rows(cells, caps))
    kept, warnings = sheet_limits(rows, cells, caps)
    flags = settle(kept.select(*SHEET, "truncated"))
    data = data_rows(rows, settle(infer_headers(rows, caps))).join(broadcast_measured(flags), SHEET)
    facts = data.groupBy(*SHEET).agg(
        *[F.first(c).alias(c) for c in SHEET_FACTS],
        F.first("truncated").alias("truncated"),
        F.first("header_vals").alias("header_vals"),
        F.count("*").alias("row_count"),
        F.min("row_idx").alias("row_start"),
        F.max("row_idx").alias("row_end"),
    )
    sheets = settle(
        facts.join(active_columns(data), SHEET)
        .withColumn("column_headers", unique_headers(F.col("columns"), F.coalesce("header_vals", F.array().cast("array<struct<c:int,v:string>>"))))
        .withColumn("column_count", F.size("columns"))
        .drop("header_vals")
    )
    numbered = (
        number_rows(data.select(*SHEET, "row_idx", "vals"), SHEET, "row_idx", "data_no")
        .join(broadcast_measured(sheets.select(*SHEET, "columns", "column_headers")), SHEET)
    )
    return sheets, numbered, warnings


def row_line(row_idx, vals, columns, headers) -> Column:
    """``Row n: header=value | ...`` over the filled active cells."""
    shown = F.transform(
        vals, lambda x: F.concat(F.get(headers, (F.array_position(columns, x["c"]) - 1).cast("int")), F.lit("="), x["v"])
    )
    return F.concat(F.lit("Row "), col(row_idx).cast("string"), F.lit(": "), F.array_join(shown, " | "))


def cell_range(columns: Column, row_start, row_end) -> Column:
    return F.concat(
        column_letter(F.get(columns, F.lit(0))),
        col(row_start).cast("string"),
        F.lit(":"),
        column_letter(F.element_at(columns, F.lit(-1))),
        col(row_end).cast("string"),
    )


def _lines(data: DataFrame) -> DataFrame:
    return data.withColumn("line", row_line("row_idx", F.col("vals"), F.col("columns"), F.col("column_headers")))


def _ordered_lines(name: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "line"))), lambda x: x["line"]).alias(name)


def _truncation(caps: TabularCaps) -> Column:
    return F.when(
        F.col("truncated"),
        F.concat(
            F.lit("sheet '"), "sheet_name", F.lit(f"' truncated at {caps.max_blocks} blocks of {caps.rows_per_block} rows")
        ),
    )


def row_blocks(sheets: DataFrame, data: DataFrame, caps: TabularCaps = TabularCaps()) -> DataFrame:
    """Blocks of 25 data rows with the headers that are filled inside the block."""
    rows = data if caps.max_blocks is None else data.filter(F.col("data_no") <= caps.rows_per_block * caps.max_blocks)
    placed = _lines(rows).withColumn("block", F.floor((F.col("data_no") - 1) / caps.rows_per_block))
    blocks = placed.groupBy(*SHEET, "block").agg(
        F.min("row_idx").alias("row_start"),
        F.max("row_idx").alias("row_end"),
        _ordered_lines("lines"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("vals", lambda x: x["c"]))))).alias("used"),
    )
    facts = sheets.select(*SHEET, *SHEET_FACTS, "truncated", F.col("columns").alias("_all"), F.col("column_headers").alias("_names"))
    full = blocks.join(broadcast_measured(facts), SHEET)
    names = F.transform("used", lambda c: F.get("_names", (F.array_position("_all", c) - 1).cast("int")))
    full = full.withColumn("column_headers", names)
    body = F.concat(
        F.lit("Workbook: "), "workbook", F.lit("\nSheet: "), "sheet_name", F.lit("\nRows: "),
        F.col("row_start").cast("string"), F.lit("-"), F.col("row_end").cast("string"),
        F.lit("\nHeaders: "), F.array_join("column_headers", ", "), F.lit("\n"), F.array_join("lines", "\n"),
    )
    return full.select(
        "doc_id",
        F.lit("row_block").alias("tabular_node_type"),
        "sheet_name", "sheet_index", "sheet_hidden", "row_start", "row_end",
        cell_range(F.col("used"), "row_start", "row_end").alias("cell_range"),
        "column_headers",
        F.array_join(F.slice("lines", 1, V.TABULAR_PREVIEW_ROWS), "\n").alias("table_preview"),
        "truncated", _truncation(caps).alias("truncated_reason"), body.alias("text"),
    )


def sheet_summaries(sheets: DataFrame, data: DataFrame, caps: TabularCaps = TabularCaps()) -> DataFrame:
    head = _lines(data.filter(F.col("data_no") <= V.TABULAR_PREVIEW_ROWS)).groupBy(*SHEET).agg(
        F.array_join(_ordered_lines("l"), "\n").alias("table_preview")
    )
    full = sheets.join(head, SHEET)
    body = F.concat(
        F.lit("Workbook: "), "workbook", F.lit("\nSheet: "), "sheet_name",
        F.lit("\nHidden: "), F.when(F.col("sheet_hidden"), "yes").otherwise("no"),
        F.lit("\nRows: "), F.col("row_count").cast("string"),
        F.lit("\nColumns: "), F.col("column_count").cast("string"),
        F.lit("\nHeaders: "), F.array_join(F.slice("column_headers", 1, 8), ", "),
        F.lit("\nPreview:\n"), F.coalesce(F.nullif("table_preview", F.lit("")), F.lit("No preview available.")),
    )
    return full.select(
        "doc_id",
        F.lit("sheet_summary").alias("tabular_node_type"),
        "sheet_name", "sheet_index", "sheet_hidden", "row_start", "row_end",
        cell_range(F.col("columns"), "row_start", "row_end").alias("cell_range"),
        "column_headers", "table_preview", "truncated", _truncation(caps).alias("truncated_reason"), body.alias("text"),
    )


def workbook_summaries(sheets: DataFrame) -> DataFrame:
    """One node per workbook: the sheet count and a line for each of the first twelve sheets."""
    line = F.concat(
        F.lit("- "), "sheet_name", F.when(F.col("sheet_hidden"), " hidden").otherwise(""),
        F.lit(": rows="), F.col("row_count").cast("string"), F.lit(", cols="), F.col("column_count").cast("string"),
        F.lit(", headers="), F.array_join(F.slice("column_headers", 1, 4), ", "),
    )
    books = sheets.withColumn("line", line).groupBy("doc_id").agg(
        F.first("workbook").alias("workbook"),
        F.count("*").alias("n"),
        F.transform(
            F.slice(F.array_sort(F.collect_list(F.struct("sheet_index", "line"))), 1, 12), lambda x: x["line"]
        ).alias("lines"),
    )
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("Workbook: "), "workbook"),
        F.concat(F.lit("Non-empty sheets: "), F.col("n").cast("string")),
        F.array_join("lines", "\n"),
    )
    none = F.lit(None)
    return books.select(
        "doc_id",
        F.lit("workbook_summary").alias("tabular_node_type"),
        none.cast("string").alias("sheet_name"), none.cast("int").alias("sheet_index"), F.lit(False).alias("sheet_hidden"),
        none.cast("int").alias("row_start"), none.cast("int").alias("row_end"), none.cast("string").alias("cell_range"),
        F.array().cast("array<string>").alias("column_headers"),
        F.left(body, F.lit(V.PAGE_TEXT_MAX_CHARS)).alias("table_preview"),
        F.lit(False).alias("truncated"), none.cast("string").alias("truncated_reason"), body.alias("text"),
    )


def tabular_nodes(cells: DataFrame, caps: TabularCaps = TabularCaps()) -> tuple[DataFrame, DataFrame]:
    """(workbook, sheet and row-block nodes; warnings)."""
    sheets, data, warnings = sheet_table(cells, caps)
    nodes = (
        workbook_summaries(sheets)
        .unionByName(sheet_summaries(sheets, data, caps))
        .unionByName(row_blocks(sheets, data, caps))
        .withColumn("source_kind", F.lit("tabular"))
    )
    return nodes, warnings


def workbook_documents(books: DataFrame, nodes: DataFrame) -> DataFrame:
    """Document text per workbook: its summary, or a fixed line when no sheet had content."""
    summary = nodes.filter(F.col("tabular_node_type") == "workbook_summary").select("doc_id", F.col("text").alias("_t"))
    empty = F.concat(F.lit("Workbook: "), "workbook", F.lit("\nNo non-empty sheets were indexed."))
    return books.join(summary, "doc_id", "left").select("doc_id", "workbook", F.coalesce("_t", empty).alias("text"))
