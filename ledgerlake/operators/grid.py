"""Tables of a page by geometry: words into cells, and cells into rows and columns.

A range join in two dimensions: a page is laid out in square tiles, a cell stands in every
tile it touches and a point in one of them, so each point meets a cell once at most and
the work of a page is spread over its tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.plans.scratch import folder, stored

#: Width and height of a tile, in the units of the page: cells are wide and low, and each stands in every tile that it touches.
TILE = (1024.0, 64.0)


def _tile(c: Column, side: int) -> Column:
    return F.floor(c / TILE[side])


def _covering(points: DataFrame, cells: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Points (keys, x, y) joined with the cells (keys, cell, cx0, cx1, cy0, cy1) that hold them, edges included; "left" keeps points without one."""
    across, down = F.sequence(_tile(F.col("cx0"), 0), _tile(F.col("cx1"), 0)), F.sequence(_tile(F.col("cy0"), 1), _tile(F.col("cy1"), 1))
    box = cells.where("cx0 <= cx1 AND cy0 <= cy1").select(*keys, "cell", "cx0", "cx1", "cy0", "cy1")
    tiled = box.withColumn("__tx", F.explode(across)).withColumn("__ty", F.explode(down)).hint("merge").alias("c")
    placed = points.withColumns({"__tx": _tile(F.col("x"), 0), "__ty": _tile(F.col("y"), 1)}).alias("p")
    on = [F.col(f"p.{k}") == F.col(f"c.{k}") for k in (*keys, "__tx", "__ty")] + [F.expr("x BETWEEN cx0 AND cx1 AND y BETWEEN cy0 AND cy1")]
    return placed.join(tiled, on, how).select(*[f"p.{c}" for c in points.columns], "c.cell")


def words_to_cells(words: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc, page, cell, text) of words (doc, page, x0, x1, top, bottom, word) and cells (doc, page, cell, cx0, cx1, cy0, cy1).

    A word belongs to every cell that holds its centre; the words of a cell are in reading
    order (top to a tenth, then x0), with single spaces. Cells without words, words of no
    cell, null coordinates and null words are left out.
    """
    told = words.where("word IS NOT NULL").select("doc", "page", "word", F.round("top", 1).alias("top"), "x0", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("top") + F.col("bottom")) / 2).alias("y"))
    inside = _covering(told, cells, ["doc", "page"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", "word"))), lambda w: w["word"]), " ")
    return inside.groupBy("doc", "page", "cell").agg(F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"))


def table_grid(cells: DataFrame) -> DataFrame:
    """(doc, page, table_no, row, col, cell): which cell serves each place of a table; null where none does.

    cells (doc, page, table_no, cell, cx0, cx1, cy0, cy1); ``cell`` is unique on a page and in
    the order of the table. Columns start where cells start (to a tenth), the last one runs
    to the right-most edge. Rows are the cells of the left column from the top. A cell serves
    every place whose centre it covers, so a merged cell serves several; of cells that
    overlap the first one does.
    """
    keys = ["doc", "page", "table_no"]
    of_table = Window.partitionBy(*keys)
    starts = cells.groupBy(*keys, F.round("cx0", 1).alias("start")).agg(F.max("cx1").alias("edge"))
    edge = F.coalesce(F.lead("start").over(of_table.orderBy("start")), F.max("edge").over(of_table))
    columns = starts.select(*keys, F.row_number().over(of_table.orderBy("start")).alias("col"), ((F.col("start") + edge) / 2).alias("x"))
    first = starts.groupBy(*keys).agg(F.min("start").alias("start"))
    left = cells.join(first.hint("merge"), keys).where(F.round("cx0", 1) == F.col("start"))
    rows = left.select(*keys, F.row_number().over(of_table.orderBy("cy0", "cell")).alias("row"), ((F.col("cy0") + F.col("cy1")) / 2).alias("y"))
    places = rows.join(columns.hint("merge"), keys)
    return _covering(places, cells, keys, "left").groupBy(*keys, "row", "col").agg(F.min("cell").alias("cell"))


def table_rows(words: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc, page, table_no, row, col, cell, text): the table place by place, each with the text of the cell that serves it ('' where there is none).

    Both sides are written, one after the other, so the shuffle files of one are gone before the next needs room.
    """
    spark = words.sparkSession
    text = stored(words_to_cells(words, cells), folder(spark, "cell-texts"))
    grid = stored(table_grid(cells), folder(spark, "grid"))
    return grid.join(text.hint("merge"), ["doc", "page", "cell"], "left").select("doc", "page", "table_no", "row", "col", "cell", F.coalesce("text", F.lit("")).alias("text"))
