"""Positioned page text to lines, cells, columns and tables (L14-L18), and segments of tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docevidence.functions import labs

LINE_GAP, CELL_GAP, OVERLAP, WORD_GAP, COLUMN_SLACK = 2.0, 8.0, 2.0, 1.0, 12.0
WORDS_AT_ONCE = 1 << 17


def layout_lines(items: DataFrame, doc: str = "document_id", page: str = "page") -> DataFrame:
    """Items (str, x, y, width) with their line number on the page.

    Items go from the top (large y) down; one belongs to the line if its y is within LINE_GAP of the y of the line's first item. That
    anchor depends on the lines before, so it is carried through the page's sorted items, which are few.
    """
    full = items.filter(F.trim("str") != "")
    pages = full.groupBy(doc, page).agg(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("up"), "x", "str", "width"))).alias("items"))
    start = F.struct(F.lit(-1).alias("line"), F.lit(None).cast("double").alias("anchor"), F.array().cast("array<int>").alias("lines"))

    def step(s, i):
        new = s["anchor"].isNull() | (F.abs(i["up"] - s["anchor"]) > LINE_GAP)
        line = (s["line"] + new.cast("int")).cast("int")
        return F.struct(line.alias("line"), F.when(new, i["up"]).otherwise(s["anchor"]).alias("anchor"), F.concat(s["lines"], F.array(line)).alias("lines"))

    pages = pages.withColumn("lines", F.aggregate("items", start, step, lambda s: s["lines"]))
    return pages.select(doc, page, F.explode(F.arrays_zip("items", "lines")).alias("z")).select(doc, page, F.col("z.lines").alias("line"), F.col("z.items.str").alias("str"), F.col("z.items.x").alias("x"), F.col("z.items.width").alias("width"))


def layout_cells(lines: DataFrame, doc: str = "document_id", page: str = "page") -> DataFrame:
    """(doc, page, line, cell, x, text): neighbours in a line with a small gap form a cell, joined by a space if they are apart."""
    by_line = [doc, page, "line"]
    order = Window.partitionBy(*by_line).orderBy("x", "str")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(order)
    parts = lines.withColumn("gap", gap).withColumn("new", (~F.coalesce(F.col("gap").between(-OVERLAP, CELL_GAP), F.lit(False))).cast("int"))
    parts = parts.withColumn("cell", F.sum("new").over(order) - 1)
    pieces = F.array_sort(F.collect_list(F.struct("x", F.when((F.col("new") == 0) & (F.col("gap") > WORD_GAP), F.concat(F.lit(" "), "str")).otherwise(F.col("str")).alias("s"))))
    return parts.groupBy(*by_line, "cell").agg(F.min("x").alias("x"), F.trim(F.array_join(F.transform(pieces, lambda p: p["s"]), "")).alias("text"))


def line_cells(items: DataFrame, doc: str = "document_id", page: str = "page") -> DataFrame:
    """L14 and L15 at once: (doc, page, line, c: cells as array<struct<x, text>>), as layout_cells of layout_lines gives them where no two
    words of a line have one place and text.

    A page's words are one row, which is cut into lines and cells with those of other pages at once, so words are neither rows again nor
    sorted and grouped by line and by cell.
    """
    full = items.filter(F.trim("str") != "")
    pages = full.groupBy(doc, page).agg(F.collect_list(F.struct((-F.col("y")).cast("double").alias("up"), F.col("x").cast("double").alias("x"), "str", F.col("width").cast("double").alias("width"))).alias("items"))
    cells = F.arrow_udf(cells_of_pages, "array<array<struct<x:double,text:string>>>")
    return pages.select(doc, page, F.posexplode(cells("items")).alias("line", "c"))


def cells_of_pages(pages: pa.Array) -> pa.Array:
    """L14 and L15 of pages, each its words (up, x, str, width) in any order: lines of cells (x, text). Some pages at a time, by their words."""
    ends = np.cumsum(pc.list_value_length(pages).to_numpy(zero_copy_only=False))
    parts, at = [], 0
    while at < len(pages):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS_AT_ONCE, "right")))
        parts.append(_page_cells(pages.slice(at, stop - at)))
        at = stop
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("text", pa.string())]))))


def _page_cells(pages: pa.Array) -> pa.Array:
    words, page = pages.flatten(), np.repeat(np.arange(len(pages)), pc.list_value_length(pages).to_numpy(zero_copy_only=False))
    place = lambda v: (0, 0.0) if v is None else (1, v) if v == v else (2, 0.0)  # noqa: E731  as Spark sorts: null, numbers, NaN
    word = lambda i, *keys: (*(place(words[i][k].as_py()) for k in keys), words[i]["str"].as_py(), place(words[i]["width"].as_py()))
    number = lambda k: pc.struct_field(words, k).to_numpy(zero_copy_only=False)  # noqa: E731  null is NaN
    up, x, width = (number(k) for k in ("up", "x", "width"))
    order = _in_order(page, [up, x], lambda i: word(int(i), "up", "x"))
    up, x, width = up[order], x[order], width[order]
    with np.errstate(invalid="ignore"):  # of places that are not finite
        # A word that is too far from the one before is so from the line's first, too; a run without such gaps is a line if its ends are near.
        new = np.append(True, (page[1:] != page[:-1]) | ~(np.diff(up) <= LINE_GAP)) if len(page) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(page))[: len(first)] - 1
        for a, b in zip(first[far := up[last] - up[first] > LINE_GAP], last[far], strict=True):
            anchor = up[a]
            for i in range(a + 1, b + 1):
                if up[i] - anchor > LINE_GAP:
                    new[i], anchor = True, up[i]
        line = np.cumsum(new)
        by_x = _in_order(line, [x], lambda i: word(int(order[i]), "x"))
        order, x, width = order[by_x], x[by_x], width[by_x]
        gap = np.append(np.nan, x[1:] - (x[:-1] + width[:-1]))[: len(x)]
        own = new | ~((gap >= -OVERLAP) & (gap <= CELL_GAP))
    text, begin = pc.struct_field(words, "str").take(pa.array(order)), np.flatnonzero(own)
    if len(begin) < len(own):
        text = pc.if_else(pa.array(~own & (gap > WORD_GAP)), pc.binary_join_element_wise(pa.scalar(" ", text.type), text, pa.scalar("", text.type)), text)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(begin, len(own)), pa.int32()), text), pa.scalar("", text.type))
    text = pc.utf8_trim(text, characters=" ")
    of_line, left = line[begin], pc.struct_field(words, "x").take(pa.array(order[begin]))
    by_text = pa.array(_in_order(of_line, [x[begin]], lambda i: (place(left[int(i)].as_py()), text[int(i)].as_py())))
    cells = pa.StructArray.from_arrays([left.take(by_text), text.take(by_text)], ["x", "text"])
    lines = pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(np.diff(of_line, prepend=0)), len(of_line)), pa.int32()), cells)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(page[new], np.arange(len(pages) + 1)), pa.int32()), lines)


def _in_order(group: np.ndarray, keys: list[np.ndarray], exact: Callable[[int], tuple]) -> np.ndarray:
    """Positions of rows, which stand by ``group``, in order of ``keys`` within it; where keys tie or are not numbers, a group's rows go by ``exact``."""

    def loose(order: np.ndarray) -> np.ndarray:
        less, even = np.zeros(max(0, len(order) - 1), bool), group[1:] == group[:-1]
        for k in (k[order] for k in keys):
            less, even = less | (even & (k[1:] > k[:-1])), even & (k[1:] == k[:-1])
        return (group[1:] == group[:-1]) & ~less

    order = np.arange(len(group))
    if loose(order).any():
        order = np.lexsort((*reversed(keys), group))
        for g in np.unique(group[1:][loose(order)]):
            a, b = np.searchsorted(group, [g, g + 1])
            order[a:b] = sorted(order[a:b], key=exact)
    return order


def layout_tables(cells: DataFrame, doc: str = "document_id", page: str = "page") -> DataFrame:
    """Rows of tables found by position: doc, page, table_id, row_index and the fields of labs.map_row.

    A header is a line of three cells or more that names test and result; its body are the next lines of two cells or more; a cell
    belongs to the last column that starts no later than COLUMN_SLACK after it.
    """
    return line_tables(cells.groupBy(doc, page, "line").agg(F.sort_array(F.collect_list(F.struct("x", "text"))).alias("c")), doc, page)


def line_tables(rows: DataFrame, doc: str = "document_id", page: str = "page") -> DataFrame:
    """L16 of lines with their cells (line_cells). The roles of a header's cells are found once, in its own line."""
    by_page, run = Window.partitionBy(doc, page).orderBy("line"), Window.partitionBy(doc, page, "stop").orderBy("line")
    texts = F.col("c")["text"]
    rows = rows.withColumn("wide", F.size("c") >= 2).withColumn("head", F.when((F.size("c") >= 3) & labs.is_lab_header(texts), F.struct("line", F.col("c")["x"].alias("x"), labs.roles_of(texts).alias("roles"))))
    rows = rows.withColumn("stop", F.sum((~F.col("wide")).cast("int")).over(by_page)).filter("wide")
    rows = rows.withColumn("h", F.first("head", ignorenulls=True).over(run)).filter(F.col("h").isNotNull() & (F.col("line") > F.col("h.line")))
    column = F.transform("c", lambda c: F.struct(F.greatest(F.size(F.filter(F.col("h.x"), lambda x: x <= c["x"] + COLUMN_SLACK)) - 1, F.lit(0)).alias("k"), c["text"].alias("t")))
    row = F.transform(F.sequence(F.lit(0), F.size("h.x") - 1), lambda n: F.array_join(F.transform(F.filter("k", lambda c: c["k"] == n), lambda c: c["t"]), " "))
    plain = F.col("k")["k"] == F.sequence(F.lit(0), F.size("h.x") - 1)  # a cell for each column
    rows = rows.withColumn("k", column).withColumn("row", F.when(plain, F.col("k")["t"]).otherwise(row)).withColumn("r", labs.map_row(F.col("row"), F.col("h.roles")))
    # Before the windows, so that rows are mapped once; a run has one header, so tables count up with the runs.
    rows = rows.withColumn("row_index", F.row_number().over(run) - 1).withColumn("n", F.dense_rank().over(Window.partitionBy(doc, page).orderBy("stop")) - 1).filter("r is not null")
    return rows.select(doc, page, F.concat(F.lit("p"), F.col(page).cast("string"), F.lit("-t"), F.col("n").cast("string")).alias("table_id"), "row_index", "r.*")


# What makes a page two columns: words, width, gutters tried and the shares of words over the gutter and beside it, lines, cells.
LEAST_WORDS, LEAST_SPAN, GUTTERS, MOST_OVER, LEAST_SIDE, LEAST_LINES, MOST_CELLS = 60, 200.0, range(35, 66, 2), 0.03, 0.25, 12, 1.4


def two_column_split(items: DataFrame, doc: str = "document_id", page: str = "page") -> DataFrame:
    """(doc, page, gutter) of the pages of positioned text (str, x, y, width) that have two columns; read left before right.

    Of the gutters at 35 to 65 percent of the page's span the first that fewest words cross is taken. Each side must hold a quarter of the
    words and 12 lines with 1.4 cells or fewer on average. Blank items do not count.
    """
    words = items.filter(F.trim("str") != "").withColumn("right", F.col("x") + F.col("width"))
    spans = words.groupBy(doc, page).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("right").alias("hi")).filter((F.col("n") >= LEAST_WORDS) & (F.col("hi") - F.col("lo") >= LEAST_SPAN))
    tried = spans.withColumn("at", F.explode(F.array(*map(F.lit, GUTTERS)))).withColumn("gutter", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("at") / 100)
    met = words.join(tried, [doc, page]).groupBy(doc, page, "n", "at", "gutter").agg(F.count_if((F.col("x") < F.col("gutter")) & (F.col("right") > F.col("gutter"))).alias("over"), F.count_if(F.col("right") <= F.col("gutter")).alias("left"), F.count_if(F.col("x") >= F.col("gutter")).alias("rest"))
    best = met.groupBy(doc, page, "n").agg(F.min(F.struct("over", "at", "gutter", "left", "rest")).alias("b")).select(doc, page, "n", "b.*")
    fine = best.filter((F.col("over") <= MOST_OVER * F.col("n")) & (F.col("left") >= LEAST_SIDE * F.col("n")) & (F.col("rest") >= LEAST_SIDE * F.col("n"))).select(doc, page, "gutter")
    sides = words.join(fine, [doc, page]).withColumn("side", (F.col("x") >= F.col("gutter")).cast("int")).withColumn("column", F.concat_ws("|", F.col(page).cast("string"), F.col("side").cast("string")))
    lines = layout_cells(layout_lines(sides, doc, "column"), doc, "column").groupBy(doc, "column").agg(F.count_distinct("line").alias("lines"), F.count("*").alias("cells"))
    good = lines.filter((F.col("lines") >= LEAST_LINES) & (F.col("cells") <= MOST_CELLS * F.col("lines"))).withColumn("p", F.substring_index("column", "|", 1)).groupBy(doc, "p").agg(F.count("*").alias("sides")).filter("sides = 2")
    return fine.join(good.select(doc, "p"), (fine[doc] == good[doc]) & (F.col(page).cast("string") == F.col("p")), "left_semi")


def page_text(cells: DataFrame, doc: str = "document_id", page: str = "page") -> DataFrame:
    """Each page's text, cells of a line joined by bars if there are three or more."""
    line = cells.groupBy(doc, page, "line").agg(F.array_sort(F.collect_list(F.struct("x", "text"))).alias("c"))
    line = line.select(doc, page, "line", F.when(F.size("c") >= 3, F.array_join(F.transform("c", lambda c: c["text"]), " | ")).otherwise(F.array_join(F.transform("c", lambda c: c["text"]), " ")).alias("t"))
    return line.groupBy(doc, page).agg(F.array_sort(F.collect_list(F.struct("line", "t"))).alias("l")).select(doc, page, F.array_join(F.transform("l", lambda s: s["t"]), "\n").alias("text"))


def page_status(text, images):
    """Text or mixed from 20 characters on, else scanned or empty, by the number of images."""
    full = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")) >= 20
    return F.when(full, F.when(images > 0, "mixed").otherwise("text")).otherwise(F.when(images > 0, "scanned").otherwise("empty"))


def table_segments(rows: DataFrame, doc: str, table: str, order: str, page: str | None = None, per_chunk: int = 8) -> DataFrame:
    """Eight rows of a table to a segment under a heading, blank lines between them, with the page of its first row."""
    fields = F.struct("test", "result", "unit", "reference_range", "flag", "date")
    numbered = rows.withColumn("part", F.floor((F.row_number().over(Window.partitionBy(doc, table).orderBy(order)) - 1) / per_chunk))
    shown = labs.row_text(fields, F.col(page) if page else None)
    out = numbered.groupBy(doc, table, "part").agg(F.sort_array(F.collect_list(F.struct(order, shown.alias("t")))).alias("r"), *([F.min_by(page, order).alias("page")] if page else []))
    head = F.concat(F.lit("Lab results table ("), F.col(table).cast("string"), F.lit(")"))
    return out.select(doc, table, "part", *(["page"] if page else []), F.concat_ws("\n\n", head, F.array_join(F.col("r")["t"], "\n\n")).alias("text"))


def reference_table_segments(rows: DataFrame, tables: DataFrame, doc: str, table: str, order: str) -> DataFrame:
    """(doc, table, part, text): a segment for each mapped row; a table without any is one segment of its whole ``text``."""
    fields = F.struct("test", "result", "unit", "reference_range", "flag", "date")
    mapped = rows.select(doc, table, F.col(order).cast("bigint").alias("part"), labs.row_text(fields).alias("text"))
    whole = tables.join(rows.select(doc, table).distinct(), [doc, table], "left_anti").filter(F.trim("text") != "")
    return mapped.unionByName(whole.select(doc, table, F.lit(0).cast("bigint").alias("part"), "text"))
