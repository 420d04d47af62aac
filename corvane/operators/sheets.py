"""Sheets and pages as relations: rows of cells to headers, tables, row groups and texts, and pages to units, without a workbook in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: columns and rows read of a sheet, cells exported of one, rows of a chunk and of a table as shown, characters of a unit's text and of a document's, and
#: cells of a sheet that is a table of its own.
COLUMNS, ROWS, CELLS, GROUP, SHOWN, UNIT, DOCUMENT, SMALL = 80, 10_000, 500, 50, 200, 30_000, 200_000, 2_000
SHEET = ["book", "sheet"]
#: Rows of a bucket in which cells meet ranges.
BUCKET = 64


def letters(number: Column) -> Column:
    """A column's letters, up to two."""
    first, last = F.floor((number - 1) / 26), (number - 1) % 26
    one = lambda x: F.char(x + 65)
    return F.when(first > 0, F.concat(one(first - 1), one(last))).otherwise(one(last))


def cell_range(row: Column, last: Column, end: Column, start: Column | None = None) -> Column:
    """A1:B2 of rows and columns; from the first column on without a start."""
    return F.concat(letters(F.lit(1) if start is None else start), row.cast("string"), F.lit(":"), letters(end), last.cast("string"))


def limited(text: Column, most: int = UNIT) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 20)), F.lit("\n[truncated]")))


def rows_of(cells: DataFrame, columns: int = COLUMNS, most: int = ROWS) -> DataFrame:
    """book, sheet, place, row, values, more of cells (book, sheet, row, col, value, hidden, and row_hidden where rows are): the first rows that hold
    anything, numbered. values has a place for each column up to the last filled one; a hidden cell's is empty. more: whether the sheet has rows beyond."""
    cells = cells if "row_hidden" in cells.columns else cells.withColumn("row_hidden", F.lit(False))
    shown = cells.where(~F.col("row_hidden") & ~F.col("hidden") & (F.col("col") <= columns) & (F.col("value") != ""))
    held = F.map_from_entries(F.collect_list(F.struct("col", "value")))  # as many as columns at most
    rows = shown.groupBy(*SHEET, "row").agg(held.alias("held"), F.max("col").alias("width"))
    values = F.transform(F.sequence(F.lit(1), F.col("width")), lambda c: F.coalesce(F.try_element_at(F.col("held"), c), F.lit("")))
    rows = rows.select(*SHEET, "row", values.alias("values"))
    # Of a sheet no more than the first rows take part, so that a long one is cut before it is shuffled.
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*SHEET).orderBy("row"))).where(F.col("place") <= most + 1)
    more = F.max("place").over(Window.partitionBy(*SHEET)) > most
    return rows.withColumn("more", more).where(F.col("place") <= most).select(*SHEET, "place", "row", "values", "more")


def exported(cells: DataFrame, rows: DataFrame, most: int = CELLS) -> DataFrame:
    """The first filled cells of a sheet's `rows_of` in order, as many as are exported, with cut: whether there are more."""
    own = rows.select(*SHEET, "row", F.posexplode("values").alias("at", "value")).where("value <> ''").select(*SHEET, "row", (F.col("at") + 1).alias("col"), "value")
    own = own.withColumn("n", F.row_number().over(Window.partitionBy(*SHEET).orderBy("row", "col"))).where(F.col("n") <= most + 1)
    cut = F.max("n").over(Window.partitionBy(*SHEET)) > most
    return own.withColumn("cut", cut).where(F.col("n") <= most).drop("n")


def in_ranges(cells: DataFrame, ranges: DataFrame, name: str, column: str) -> DataFrame:
    """cells (book, sheet, row, col, ...) with `column`: `name` of the last range (book, sheet, at, r0, r1, c0, c1, name) that a cell is in; null in none.

    Cells meet ranges by buckets of rows, so that a sheet with very many of either is spread.
    """
    each = F.explode(F.sequence(F.floor(F.col("r0") / BUCKET), F.floor(F.col("r1") / BUCKET)))
    spans = ranges.select(*SHEET, "at", "r0", "r1", "c0", "c1", F.col(name).alias("_name"), each.alias("_bucket"))
    own = cells.withColumn("_bucket", F.floor(F.col("row") / BUCKET))
    met = own.select(*SHEET, "row", "col", "_bucket").join(spans, [*SHEET, "_bucket"]).where(F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1")))
    found = met.groupBy(*SHEET, "row", "col").agg(F.max_by("_name", "at").alias(column))
    return cells.join(found, [*SHEET, "row", "col"], "left")


def _filled(values: Column) -> Column:
    return F.size(F.filter(values, lambda x: x != ""))


def named(values: Column) -> Column:
    """Header names of a row: blanks take their column's letters, and what was there before takes a number."""
    plain = F.transform(values, lambda x, i: F.when(F.trim(x) != "", F.trim(x)).otherwise(letters(i + 1)))
    before = lambda x, i: F.size(F.filter(F.slice(plain, 1, i + 1), lambda y: y == x))
    return F.transform(plain, lambda x, i: F.when(before(x, i) > 1, F.concat(x, F.lit("_"), before(x, i).cast("string"))).otherwise(x))


def headed(rows: DataFrame, by: list[str] = SHEET) -> DataFrame:
    """rows with headers (null without): the names of the first of ten rows with two values or more; head: the place of the first row that says the
    same as far as it goes, else the first; total and width of the sheet."""
    early = (F.col("place") <= 10) & (_filled(F.col("values")) >= 2)
    found = rows.groupBy(*by).agg(F.min_by(F.when(early, F.col("values")), F.when(early, F.col("place"))).alias("first"), F.count("*").alias("total"), F.max(F.size("values")).alias("width"))
    own = rows.join(found.withColumn("headers", named(F.col("first"))).drop("first"), by)
    said = F.transform(F.slice("values", 1, F.size("headers")), lambda x: F.trim(x))
    same = F.col("headers").isNotNull() & (said == F.slice("headers", 1, F.size(said)))
    head = F.min(F.when(F.col("same"), F.col("place"))).over(Window.partitionBy(*by))
    return own.withColumn("same", same).withColumn("head", F.when(F.col("headers").isNotNull(), F.coalesce(head, F.lit(1))))


def _line(headers: Column, values: Column) -> Column:
    """`name: value` of the filled cells; beyond the headers a cell's column is its name."""
    part = lambda v, i: F.when(v != "", F.concat(F.coalesce(F.get(headers, i), letters(i + 1)), F.lit(": "), v))
    return F.array_join(F.array_compact(F.transform(values, part)), " | ")


def _text(sheet: Column, cells: Column, rows: Column, headers: Column) -> Column:
    """A text of rows (an array of place, values, same): sheet, range, and a line for each row after that of the headers."""
    named_at = F.coalesce(F.array_min(F.transform(F.filter(rows, lambda r: r.same), lambda r: r.place)), F.array_min(F.transform(rows, lambda r: r.place)))
    body = F.when(headers.isNotNull(), F.filter(rows, lambda r: r.place > named_at)).otherwise(rows)
    lines = F.filter(F.transform(body, lambda r: _line(headers, r["values"])), lambda x: x != "")
    top = F.array(F.concat(F.lit("[Sheet: "), sheet, F.lit("]")), F.concat(F.lit("[Range: "), cells, F.lit("]")))
    return limited(F.trim(F.array_join(F.concat(top, lines), "\n")))


def row_groups(rows: DataFrame, size: int = GROUP) -> DataFrame:
    """book, sheet, part, cells, row_start, row_end, text: groups of a sheet's rows after its headers, none of a sheet that one group and its headers hold."""
    own = headed(rows).where(F.col("total") > size + 1)
    first = own.where("place = head").select(*SHEET, F.struct("place", "values", "same").alias("top"))
    body = own.where(F.col("head").isNull() | (F.col("place") > F.col("head")))
    body = body.withColumn("part", F.floor((F.col("place") - F.coalesce("head", F.lit(0)) - 1) / size))
    held = F.array_sort(F.collect_list(F.struct("place", "values", "same")))  # size rows
    groups = body.groupBy(*SHEET, "part").agg(F.first("headers").alias("headers"), F.min("row").alias("row_start"), F.max("row").alias("row_end"), held.alias("held"))
    groups = groups.join(first, SHEET, "left")
    shown = F.when(F.col("top").isNotNull(), F.concat(F.array("top"), F.col("held"))).otherwise(F.col("held"))
    end = F.greatest(F.lit(1), F.array_max(F.transform("shown", lambda r: F.size(r["values"]))))
    groups = groups.withColumn("shown", shown).withColumn("cells", cell_range(F.col("row_start"), F.col("row_end"), end))
    return groups.select(*SHEET, "part", "cells", "row_start", "row_end", _text(F.col("sheet"), F.col("cells"), F.col("shown"), F.col("headers")).alias("text"))


def _bar(values: Column) -> Column:
    clean = F.transform(values, lambda x: F.replace(x, F.lit("|"), F.lit("\\|")))
    return F.concat(F.lit("| "), F.array_join(clean, " | "), F.lit(" |"))


def _bars(rows: Column, headers: Column, width: Column, most: int) -> Column:
    """A table of bars: names, a rule, and the first rows after the headers, each as wide as the names."""
    names = F.coalesce(headers, F.transform(F.sequence(F.lit(1), width), letters))
    named_at = F.coalesce(F.array_min(F.transform(F.filter(rows, lambda r: r.same), lambda r: r.place)), F.array_min(F.transform(rows, lambda r: r.place)))
    body = F.slice(F.when(headers.isNotNull(), F.filter(rows, lambda r: r.place > named_at)).otherwise(rows), 1, most)
    padded = lambda v: F.slice(F.concat(v, F.array_repeat(F.lit(""), F.size(names))), 1, F.size(names))
    return F.array_join(F.concat(F.array(_bar(names), _bar(F.transform(names, lambda _: F.lit("---")))), F.transform(body, lambda r: _bar(padded(r["values"])))), "\n")


def markdown(rows: DataFrame, most: int = SHOWN) -> DataFrame:
    """book, sheet, table: a sheet's headers and first rows as a table of bars."""
    own = headed(rows).where((F.col("place") <= most + 1) | (F.col("place") <= F.col("head") + most))
    held = F.array_sort(F.collect_list(F.struct("place", "values", "same")))
    own = own.groupBy(*SHEET).agg(F.first("headers").alias("headers"), F.max("width").alias("width"), held.alias("held"))
    return own.select(*SHEET, limited(_bars(F.col("held"), F.col("headers"), F.col("width"), most)).alias("table"))


def tables(rows: DataFrame, ranges: DataFrame, most: int = SHOWN) -> DataFrame:
    """book, sheet, table_id, kind, cells, header_cells, data_cells, headers, table, text: a row for each range (book, sheet, at, table_id, r0, r1, c0, c1) with what it
    holds of rows_of, and one for a small sheet with headers and no range. A range without headers of its own takes the sheet's."""
    each = F.explode(F.sequence(F.floor(F.col("r0") / BUCKET), F.floor(F.col("r1") / BUCKET)))
    sheets = headed(rows)
    names = sheets.where("place = 1").select(*SHEET, F.col("headers").alias("sheet_headers"))
    spans = ranges.select(*SHEET, "at", "table_id", "r0", "r1", "c0", "c1", each.alias("_bucket"))
    part = F.slice("values", F.col("c0"), F.col("c1") - F.col("c0") + 1)
    inside = rows.withColumn("_bucket", F.floor(F.col("row") / BUCKET)).join(spans, [*SHEET, "_bucket"]).where(F.col("row").between(F.col("r0"), F.col("r1")))
    inside = inside.select(*SHEET, "at", "place", "row", part.alias("values")).where(_filled(F.col("values")) > 0)
    key = [*SHEET, "at"]
    inside = inside.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("place")))
    held = F.array_sort(F.collect_list(F.struct("place", "values", "same")))
    own = headed(inside, key).groupBy(*key).agg(F.first("headers").alias("headers"), F.max("width").alias("width"), held.alias("held"))
    given = ranges.join(own, key, "left").join(names, SHEET, "left")
    lent = F.col("headers").isNull() & F.col("sheet_headers").isNotNull()
    said = lambda r: F.transform(F.slice(r["values"], 1, F.size("sheet_headers")), lambda x: F.trim(x))
    again = F.transform("held", lambda r: F.struct(r.place, r["values"], (said(r) == F.slice("sheet_headers", 1, F.size(said(r)))).alias("same")))
    given = given.withColumn("held", F.when(lent, again).otherwise(F.col("held"))).withColumn("headers", F.coalesce("headers", "sheet_headers"))
    empty = F.array().cast("array<struct<place:int,values:array<string>,same:boolean>>")
    given = given.select(*SHEET, "table_id", F.lit("named").alias("kind"), "r0", "r1", "c0", "c1", "headers", "width", F.coalesce("held", empty).alias("held"))
    small = sheets.where(F.col("headers").isNotNull() & (F.col("total") > 1) & (F.col("total") * F.col("width") <= SMALL)).join(ranges.select(*SHEET).distinct(), SHEET, "left_anti")
    found = small.groupBy(*SHEET).agg(F.lit(1).alias("r0"), F.max("row").cast("int").alias("r1"), F.lit(1).alias("c0"), F.max("width").alias("c1"), F.first("headers").alias("headers"), F.max("width").alias("width"), held.alias("held"))
    found = found.select(*SHEET, F.lit("DetectedTable1").alias("table_id"), F.lit("detected").alias("kind"), "r0", "r1", "c0", "c1", "headers", "width", "held")
    out = given.unionByName(found)
    cells = cell_range(F.col("r0"), F.col("r1"), F.col("c1"), F.col("c0"))
    top, data = cell_range(F.col("r0"), F.col("r0"), F.col("c1"), F.col("c0")), cell_range(F.least(F.col("r0") + 1, F.col("r1")), F.col("r1"), F.col("c1"), F.col("c0"))
    bars = F.when(F.size("held") == 0, "").otherwise(limited(_bars(F.col("held"), F.col("headers"), F.col("width"), most)))
    return out.withColumn("cells", cells).select(*SHEET, "table_id", "kind", "cells", top.alias("header_cells"), data.alias("data_cells"), "headers", bars.alias("table"), _text(F.col("sheet"), F.col("cells"), F.col("held"), F.col("headers")).alias("text"))


def sheet_units(rows: DataFrame) -> DataFrame:
    """book, unit_type, unit_key, text: a document for the book, a section for each sheet, a chunk for each group of rows."""
    groups = row_groups(rows)
    chunks = groups.select("book", F.lit("CHUNK").alias("unit_type"), F.concat_ws(":", F.lit("chunk"), "sheet", F.col("part").cast("string")).alias("unit_key"), "text")
    sections = rows.groupBy("book", "sheet").agg(F.count("*").alias("n")).select("book", F.lit("SECTION").alias("unit_type"), F.concat(F.lit("sheet:"), "sheet").alias("unit_key"), F.concat("sheet", F.lit(": "), F.col("n").cast("string"), F.lit(" rows")).alias("text"))
    books = rows.groupBy("book").agg(F.count_distinct("sheet").alias("n")).select("book", F.lit("DOCUMENT").alias("unit_type"), F.lit("workbook").alias("unit_key"), F.concat(F.col("n").cast("string"), F.lit(" sheets")).alias("text"))
    return books.unionByName(sections).unionByName(chunks)


def page_units(blocks: DataFrame) -> DataFrame:
    """book, unit_type, unit_key, text from blocks (book, page, block, text): a document of its first characters, its pages, and each filled block."""
    filled = blocks.where(F.trim("text") != "")
    joined = lambda *by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, "text"))), lambda x: x.text), "\n")
    pages = filled.groupBy("book", "page").agg(joined("block").alias("text"))
    chunks = filled.select("book", F.lit("CHUNK").alias("unit_type"), F.concat_ws(":", F.lit("page"), F.col("page").cast("string"), F.lit("block"), F.col("block").cast("string")).alias("unit_key"), F.trim("text").alias("text"))
    every = pages.groupBy("book").agg(F.substring(joined("page"), 1, DOCUMENT).alias("text"))
    return every.select("book", F.lit("DOCUMENT").alias("unit_type"), F.lit("document").alias("unit_key"), "text").unionByName(pages.select("book", F.lit("PAGE").alias("unit_type"), F.concat(F.lit("page:"), F.col("page").cast("string")).alias("unit_key"), "text")).unionByName(chunks)


def needs_reading(layer: Column, chars: Column, area: Column, least: int = 20, density: float = 0.0001) -> Column:
    """Whether a page has to be recognised: no text layer, few characters, or few for its area."""
    return ~layer | (chars < least) | (F.coalesce(chars / F.nullif(area, F.lit(0.0)), F.lit(0.0)) < density)


def page_quality(pages: DataFrame) -> DataFrame:
    """book, quality of pages (book, page, blocks, chars): 0.8 of the share of pages with text and 0.2 of blocks a page, five at most."""
    share, many = F.avg((F.col("chars") > 0).cast("double")), F.least(F.sum("blocks") / F.count("*"), F.lit(5.0)) / 5
    return pages.groupBy("book").agg(F.round(0.8 * share + 0.2 * many, 4).alias("quality"))
