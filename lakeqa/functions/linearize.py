"""Table shaping: header paths, row limits, cell cuts, CSV and JSON text.

Every function works on the normalized table relation
``(dataset, table_id, table_name, column_header, row_header, data)`` and stays inside one row.
"""

from pyspark.sql import Column, DataFrame, functions as F

from lakeqa.functions import text as text_functions

CRLF = "\r\n"
LINEARIZATIONS = ("csv", "json")


def header_text(path: Column) -> Column:
    """The first two levels of a header path, joined by a blank."""
    first = F.coalesce(F.get(path, F.lit(0)), F.lit(""))
    return F.when(F.size(path) > 1, F.concat_ws(" ", first, F.get(path, F.lit(1)))).otherwise(first)


def limit_rows(tables: DataFrame, num_rows) -> DataFrame:
    """Keep the first rows and row headers; ``num_rows`` may be an int, a column or None."""
    if num_rows is None:
        return tables
    n = num_rows if isinstance(num_rows, Column) else F.lit(num_rows)
    return tables.withColumns(
        {name: F.slice(F.col(name), F.lit(1), n) for name in ("row_header", "data")}
    )


def cut_cells(tables: DataFrame, num_tokens, first_tokens=text_functions.first_tokens) -> DataFrame:
    """Cut every body cell to its first tokens; headers and titles stay whole."""
    if num_tokens is None:
        return tables
    return tables.withColumn(
        "data",
        F.transform("data", lambda row: F.transform(row, lambda c: first_tokens(c, num_tokens))),
    )


def _quoted(cell: Column) -> Column:
    cell = F.coalesce(cell, F.lit(""))
    return F.when(
        cell.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))
    ).otherwise(cell)


def _csv_line(cells: Column) -> Column:
    """Minimal quoting; a line of one empty cell is written as an empty quoted string."""
    lone_empty = (F.size(cells) == 1) & (F.coalesce(F.get(cells, F.lit(0)), F.lit("")) == "")
    joined = F.array_join(F.transform(cells, _quoted), ",")
    return F.concat(F.when(lone_empty, F.lit('""')).otherwise(joined), F.lit(CRLF))


def csv_text() -> Column:
    """Id and title, then the header line, then the rows, each ended by CRLF."""
    has_row_headers = F.size("row_header") > 0
    headers = F.transform("column_header", header_text)
    header_line = F.when(
        has_row_headers, _csv_line(F.concat(F.array(F.lit("")), headers))
    ).otherwise(_csv_line(headers))
    num_rows = F.least(F.size("row_header"), F.size("data"))
    headed = F.zip_with(
        F.slice("row_header", F.lit(1), num_rows),
        F.slice("data", F.lit(1), num_rows),
        lambda h, row: _csv_line(F.concat(F.array(header_text(h)), row)),
    )
    body = F.when(has_row_headers, headed).otherwise(F.transform("data", _csv_line))
    return F.concat(
        _csv_line(F.array(F.col("table_id"), F.col("table_name"))), header_line, F.array_join(body, "")
    )


def json_text() -> Column:
    """Compact JSON with the keys of the table's own form; missing lists are written as []."""
    options = {"ignoreNullFields": "false"}
    with_paths = F.struct(
        F.col("table_id").alias("id"),
        F.col("table_name").alias("title"),
        "column_header",
        "row_header",
        "data",
    )

    def text_object(cell):
        return F.struct(cell.alias("text"))

    with_objects = F.struct(
        F.col("table_id").alias("id"),
        F.col("table_name").alias("title"),
        F.transform("column_header", lambda path: text_object(F.get(path, F.lit(0)))).alias("columns"),
        F.transform(
            "data", lambda row: F.struct(F.transform(row, text_object).alias("cells"))
        ).alias("rows"),
    )
    return F.when(F.col("dataset") == "aitqa", F.to_json(with_paths, options)).otherwise(
        F.to_json(with_objects, options)
    )


def linearize(
    tables: DataFrame, linearization: str, num_rows=None, cell_tokens=None,
    first_tokens=text_functions.first_tokens,
) -> DataFrame:
    """Tables to ``(…, table_id, table_name, table_content)``; rows are cut before any text is built."""
    if linearization not in LINEARIZATIONS:
        raise ValueError(f"linearization must be one of {LINEARIZATIONS}")
    shaped = cut_cells(limit_rows(tables, num_rows), cell_tokens, first_tokens)
    content = csv_text() if linearization == "csv" else json_text()
    kept = [c for c in tables.columns if c not in ("column_header", "row_header", "data")]
    return shaped.select(*kept, content.alias("table_content"))


# The first two cells of a CSV text, quoted or bare.
_FIRST_CSV_CELLS = (
    r'^(?:"((?:[^"]|"")*)"|([^,"\r\n]*)),(?:"((?:[^"]|"")*)"|([^,"\r\n]*))\r\n'
)


def title_of_text(content: Column, linearization: str) -> Column:
    """The title of an already linearized table."""
    if linearization == "json":
        return F.get_json_object(content, "$.title")

    def title(line: Column) -> Column:
        quoted = F.regexp_extract(line, _FIRST_CSV_CELLS, 3)
        bare = F.regexp_extract(line, _FIRST_CSV_CELLS, 4)
        return F.when(quoted != "", F.replace(quoted, F.lit('""'), F.lit('"'))).otherwise(bare)

    # The text may be long to make; it is only asked for its first line, once.
    return text_functions.let(F.regexp_extract(content, _FIRST_CSV_CELLS, 0), title)
