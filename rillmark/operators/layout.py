"""Lines, columns, blocks and tables of positioned text, by windows over each page.

Input are spans (path, page, width, height, kind, x0, y0, x1, y1, text), y from the top, as
``rillmark.sources.pdf`` gives them.  Every step is a window over one page, so pages spread over the
cluster and no document is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["path", "page"]
#: In heights of the text: what parts two lines, two words and two segments of one line, two blocks.
LINE_GAP, WORD_GAP, SEGMENT_GAP, BLOCK_GAP, TABLE_GAP = 0.4, 0.15, 1.2, 0.7, 2.5
#: Shares of the page's width: a full-width line, the mean line of a text column, a gutter, and how far from
#: the page's middle a centred line's middle lies.
FULL, NARROWEST, GUTTER, CENTRED = 0.5, 0.2, 0.015, 0.03
EACH_SIDE = 3


def _islands(begins: Column, w) -> Column:
    """Numbers from 0 of the runs that begin where ``begins`` holds."""
    return (F.sum(F.coalesce(begins, F.lit(True)).cast("int")).over(w) - 1).cast("int")


def segments(spans: DataFrame) -> DataFrame:
    """Pieces of lines: ``row`` numbers a page's lines from above, ``seg`` the pieces of one line that wide
    gaps part; the strings of a piece are joined, with a space where they stand apart."""
    text = spans.filter("kind = 'text'").withColumns({"size": F.col("y1") - F.col("y0"), "mid": (F.col("y0") + F.col("y1")) / 2})
    down = Window.partitionBy(*PAGE).orderBy("mid", "x0", "text")
    text = text.withColumn("row_begins", (F.col("mid") - F.lag("mid").over(down)) > LINE_GAP * F.col("size")).withColumn("row", _islands(F.col("row_begins"), down))
    along = Window.partitionBy(*PAGE, "row").orderBy("x0", "x1", "text")
    reached = F.max("x1").over(along.rowsBetween(Window.unboundedPreceding, -1))
    text = text.withColumn("gap", F.col("x0") - reached)
    text = text.withColumn("seg", _islands(F.col("gap") > SEGMENT_GAP * F.col("size"), along))
    piece = F.struct("x0", "x1", "text", (F.col("gap") > WORD_GAP * F.col("size")).alias("apart"))
    made = text.groupBy(*PAGE, "width", "row", "seg").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("size").alias("size"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    spaced = F.transform("pieces", lambda p, i: F.concat(F.when((i > 0) & F.coalesce(p["apart"], F.lit(False)), " ").otherwise(""), p["text"]))
    joined = F.trim(F.regexp_replace(F.array_join(spaced, ""), r"(?U)\s+", " "))
    return made.withColumn("text", joined).drop("pieces").filter("text <> ''")


def columns(segs: DataFrame) -> DataFrame:
    """Segments with ``region`` and ``column`` of a page of up to two text columns.

    Lines of more than FULL of the page's width, and centred ones across its middle, part it into regions.  The other lines have
    two columns if a vertical band is free of them, with EACH_SIDE lines or more on each side whose mean
    width is that of text; a page with too few lines takes the band that most lines of its file have, if it is
    free there."""
    size = F.col("x1") - F.col("x0")
    # a centred line lies across the page's middle; a column's line of one letter only lies near it
    across_middle = (F.col("x0") < F.col("width") / 2) & (F.col("x1") > F.col("width") / 2)
    centred = across_middle & (F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("width") / 2) < CENTRED * F.col("width"))
    segs = segs.withColumn("full", (size > FULL * F.col("width")) | centred)
    page, kind = Window.partitionBy(*PAGE), Window.partitionBy(*PAGE, "full")
    across = kind.orderBy("x0", "x1", "row", "seg")
    upto = across.rowsBetween(Window.unboundedPreceding, -1)
    swept = segs.withColumns({"reached": F.max("x1").over(upto), "left_n": F.count(F.lit(1)).over(upto), "left_sum": F.sum(size).over(upto), "right_n": F.count(F.lit(1)).over(kind), "right_sum": F.sum(size).over(kind)})
    swept = swept.withColumns({"right_n": F.col("right_n") - F.col("left_n"), "left_width": F.col("left_sum") / F.nullif("left_n", F.lit(0)), "right_width": (F.col("right_sum") - F.col("left_sum")) / (F.col("right_n") - F.col("left_n"))})
    band = F.col("x0") - F.col("reached")
    good = ~F.col("full") & (band >= GUTTER * F.col("width")) & (F.least("left_n", "right_n") >= EACH_SIDE) & (F.least("left_width", "right_width") >= NARROWEST * F.col("width"))
    best = F.max(F.when(good, F.struct(band.alias("gap"), ((F.col("x0") + F.col("reached")) / 2).alias("gutter")))).over(page)
    known = swept.withColumn("own", best["gutter"]).withColumn("usual", F.mode(F.round("own")).over(Window.partitionBy("path")))
    crossed = F.max(~F.col("full") & (F.col("x0") < F.col("usual")) & (F.col("x1") > F.col("usual"))).over(page)
    known = known.withColumn("gutter", F.coalesce("own", F.when(~crossed, F.col("usual"))))
    above = F.sum(F.col("full").cast("int")).over(page.orderBy("row", "seg").rowsBetween(Window.unboundedPreceding, 0))
    # a full line is its own region: twice the full lines above, one less for the line itself
    region = F.when(F.col("gutter").isNull(), 0).otherwise(2 * above - F.col("full").cast("int"))
    side = F.when(F.col("gutter").isNotNull() & ~F.col("full") & ((F.col("x0") + F.col("x1")) / 2 > F.col("gutter")), 1).otherwise(0)
    return known.withColumns({"region": region.cast("int"), "column": side}).drop("full", "gutter", "usual", "own", "reached", "left_n", "left_sum", "left_width", "right_n", "right_sum", "right_width")


def lines(spans: DataFrame) -> DataFrame:
    """(path, page, region, column, row, x0, y0, x1, y1, size, cells, grid): lines of one column in reading
    order, with their segments (seg, x0, x1, text) and the number of their table on the page, or null.

    A table is a run of lines of several segments; single segments between such lines (merged cells, rows
    with one filled cell) belong to it.  A run needs two lines."""
    segs = columns(segments(spans))
    made = segs.groupBy(*PAGE, "region", "column", "row").agg(*[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1", "size")], F.sort_array(F.collect_list(F.struct("seg", "x0", "x1", "text"))).alias("cells"))  # a line's segments
    w = Window.partitionBy(*PAGE, "region", "column").orderBy("row")
    several = lambda c: F.size(c) > 1
    near_above = F.coalesce(F.col("y0") - F.lag("y1").over(w) <= TABLE_GAP * F.col("size"), F.lit(False))
    near_below = F.coalesce(F.lead("y0").over(w) - F.col("y1") <= TABLE_GAP * F.col("size"), F.lit(False))
    between = several(F.lag("cells").over(w)) & several(F.lead("cells").over(w)) & near_above & near_below
    made = made.withColumns({"inside": several("cells") | F.coalesce(between, F.lit(False)), "near": near_above})
    begins = ~F.coalesce(F.lag("inside").over(w), F.lit(False)) | ~F.col("near") | ~F.col("inside")
    made = made.withColumn("run", _islands(begins, w)).withColumn("run_lines", F.count(F.lit(1)).over(Window.partitionBy(*PAGE, "region", "column", "run")))
    in_table = F.col("inside") & (F.col("run_lines") >= 2)
    order = Window.partitionBy(*PAGE, "in_table").orderBy("region", "column", "run")
    return made.withColumn("in_table", in_table).withColumn("grid", F.when(F.col("in_table"), F.dense_rank().over(order) - 1)).drop("inside", "near", "run", "run_lines", "in_table")


def text_blocks(spans: DataFrame) -> DataFrame:
    """(path, page, block_no, position, x0, y0, x1, y1, text): blocks of lines in reading order, tables left
    out; a block ends where the distance to the next line is larger than BLOCK_GAP of its height."""
    found = lines(spans).filter("grid IS NULL").withColumn("text", F.array_join(F.transform("cells", lambda s: s["text"]), " "))
    w = Window.partitionBy(*PAGE).orderBy("region", "column", "row")
    same = (F.lag("region").over(w) == F.col("region")) & (F.lag("column").over(w) == F.col("column"))
    begins = ~F.coalesce(same & (F.col("y0") - F.lag("y1").over(w) <= BLOCK_GAP * F.col("size")), F.lit(False))
    blocks = found.withColumn("block_no", _islands(begins, w)).groupBy(*PAGE, "block_no")
    made = blocks.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "text"))), lambda s: s["text"]), "\n").alias("text"))
    return made.withColumn("position", F.col("block_no") + 1)


def page_texts(spans: DataFrame) -> DataFrame:
    """(path, page, text) of every page, its blocks in reading order with a blank line between."""
    pages = spans.filter("kind = 'page'").select(*PAGE, F.lit(0).alias("position"), F.lit(None).cast("string").alias("text"))
    blocks = pages.unionByName(text_blocks(spans).select(*PAGE, "position", "text"))
    held = F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("position", "text"))))  # a page's blocks
    return blocks.groupBy(*PAGE).agg(F.array_join(F.transform(held, lambda s: s["text"]), "\n\n").alias("text"))


def layout_tables(spans: DataFrame) -> DataFrame:
    """(path, page, table_no, rows): tables of aligned text with two rows or more.

    Where two or more vertical lines stand beside a table's text they part its columns; else the columns are
    the stretches that the cells of its fullest rows cover.  A cell goes to the first column it
    touches, so a merged cell is in the first of its columns and the others stay empty.  Columns that are empty but
    for their head, or whose head starts with ``Unnamed``, and rows without a cell are left out."""
    found = lines(spans).filter("grid IS NOT NULL").withColumns({"cell": F.explode("cells"), "cells": F.size("cells")})
    cells = found.select(*PAGE, "grid", "row", "cells", "y0", "y1", "cell.*")
    table = [*PAGE, "grid"]
    rules = spans.filter("kind = 'rule' AND x1 - x0 <= 2").groupBy(*PAGE).agg(F.collect_set(F.struct(F.round((F.col("x0") + F.col("x1")) / 2).alias("x"), F.col("y0").alias("from"), F.col("y1").alias("to"))).alias("rules"))  # a page's lines
    own = Window.partitionBy(*table)
    placed = cells.join(rules, PAGE, "left").withColumns({"top": F.min("y0").over(own), "bottom": F.max("y1").over(own), "low": F.min("x0").over(own), "high": F.max("x1").over(own), "most": F.max("cells").over(own)})
    beside = F.filter("rules", lambda r: (r["from"] < F.col("bottom")) & (r["to"] > F.col("top")) & (r["x"] > F.col("low") - 20) & (r["x"] < F.col("high") + 20))
    upright = F.array_sort(F.array_distinct(F.transform(beside, lambda r: r["x"])))
    # the stretches that the cells of the fullest lines cover: where one begins, the one before has ended
    w = Window.partitionBy(*table, "fullest").orderBy("x0", "x1", "row")
    placed = placed.withColumns({"lines": F.when(F.size(upright) >= 2, upright), "fullest": F.col("cells") == F.col("most")})
    placed = placed.withColumn("reached", F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    ends = F.collect_set(F.when(F.col("fullest") & (F.col("x0") > F.col("reached")), F.col("reached"))).over(own)
    placed = placed.withColumn("ends", F.array_append(F.sort_array(ends), F.max(F.when(F.col("fullest"), F.col("x1"))).over(own)))
    by_lines = F.greatest(F.lit(0), F.size(F.filter("lines", lambda x: x <= F.col("x0") + 1)) - 1)
    by_text = F.least(F.size("ends") - 1, F.size(F.filter("ends", lambda x: x <= F.col("x0"))))
    placed = placed.withColumn("col", F.when(F.col("lines").isNotNull(), by_lines).otherwise(by_text)).withColumn("n_cols", F.when(F.col("lines").isNotNull(), F.greatest(F.size("lines") - 1, F.lit(1))).otherwise(F.size("ends")))
    joined = placed.groupBy(*table, "row", "col").agg(F.max("n_cols").alias("n_cols"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "text"))), lambda s: s["text"]), " ").alias("text"))
    rows = joined.groupBy(*table, "row").agg(F.max("n_cols").alias("n_cols"), F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("at"))
    wide = rows.withColumn("n_cols", F.greatest("n_cols", F.array_max(F.map_keys("at")) + 1)).withColumn("n_cols", F.max("n_cols").over(Window.partitionBy(*table)))
    filled = wide.withColumn("cells", F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda i: F.coalesce(F.col("at")[i], F.lit(""))))
    grids = filled.groupBy(*table).agg(F.max("n_cols").alias("n_cols"), F.transform(F.sort_array(F.collect_list(F.struct("row", "cells"))), lambda r: r["cells"]).alias("rows"))
    body = F.slice("rows", 2, F.size("rows"))
    keep = F.filter(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda i: F.exists(body, lambda r: r[i] != "") & ~F.lower(F.col("rows")[0][i]).startswith("unnamed"))
    kept = grids.withColumn("keep", keep).withColumn("rows", F.transform("rows", lambda r: F.transform("keep", lambda i: r[i])))
    kept = kept.withColumn("rows", F.filter("rows", lambda r: F.exists(r, lambda c: c != ""))).filter(F.size("rows") >= 2)
    return kept.select(*PAGE, F.col("grid").alias("table_no"), "rows")
