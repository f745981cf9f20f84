"""Tables of cells as Markdown, and rectangles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeleaf.functions.text import let


def clean_row(row: Column, width: Column) -> Column:
    """Cells as single lines, filled up or cut to a width."""
    cells = F.transform(row, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " ")))
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), F.lit(1), width)


def table_markdown(rows: Column) -> Column:
    """Header, rule and rows with ' | ' between cells; a blank header is numbered, blank rows go, one blank row if none is left."""
    blank = lambda r: ~F.exists(r, lambda c: c != "")

    def build(width: Column) -> Column:
        clean = F.transform(rows, lambda r: clean_row(r, width))
        head = let(F.element_at(clean, 1), lambda h: F.when(blank(h), F.transform(F.sequence(F.lit(1), width), lambda i: F.concat(F.lit("Columna "), i.cast("string")))).otherwise(h))
        body = F.filter(F.slice(clean, 2, F.size(clean)), lambda r: ~blank(r))
        body = F.when(F.size(body) == 0, F.array(F.array_repeat(F.lit(""), width))).otherwise(body)
        rule = F.array_repeat(F.lit("---"), width)
        return F.array_join(F.transform(F.concat(F.array(head, rule), body), lambda r: F.array_join(r, " | ")), "\n")

    width = F.array_max(F.transform(rows, F.size))
    return F.when(F.coalesce(width, F.lit(0)) == 0, F.lit("")).otherwise(let(width, build))


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Common length of two intervals over that of the shorter one."""
    common = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))
    shorter = F.least(a1 - a0, b1 - b0)
    return F.when(shorter > 0, common / shorter).otherwise(0.0)


def merged_boxes(boxes: Column, gap: float, overlap: float) -> Column:
    """Sorted boxes (y0, x0, y1, x1) with vertical neighbours joined: a fold whose state is the running union."""
    kind = "array<struct<y0:double,x0:double,y1:double,x1:double>>"

    def step(done: Column, box: Column) -> Column:
        last = F.element_at(done, -1)
        near = (box["y0"] - last["y1"] <= gap) & (overlap_ratio(last["x0"], last["x1"], box["x0"], box["x1"]) >= overlap)
        union = F.struct(F.least(last["y0"], box["y0"]).alias("y0"), F.least(last["x0"], box["x0"]).alias("x0"), F.greatest(last["y1"], box["y1"]).alias("y1"), F.greatest(last["x1"], box["x1"]).alias("x1"))
        return F.when(F.size(done) == 0, F.array(box)).when(near, F.array_append(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), union)).otherwise(F.array_append(done, box))

    return F.aggregate(F.array_sort(boxes), F.array().cast(kind), step)
