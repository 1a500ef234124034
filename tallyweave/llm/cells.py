"""Rows that share grid cells: how the near-duplicate operators get from cells to the pairs worth a look.

Rows (cell, fp), no row twice, first give links along each cell: of every row to the cell's head and to its
predecessor, which is linear in a dense cell. What holds of them gives labels; a second try goes to each cell's hub, the
row with most links. Only rows of a cell with unlike labels still have to be compared, and one of two such rows is
outside the cell's largest label, so just those rows meet their cell again. No pair of a cell with unlike labels is left
out but those that a bound excludes, so a cell needs no cap.

Cells are only ever aggregated (combined before the shuffle) and joined (which adaptive execution splits); the ordered
pass runs over pieces of PIECE rows at most, give or take, of a cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.llm.common import cut

#: Rows of a cell that are put in order together.
PIECE = 4096


def in_company(cells: DataFrame, apart: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(cell, fp, head, n): the rows of cells (cell, fp) that hold several; head is one of them, n how many.

    Most cells with company hold two strangers. Where `apart` says of these two that they are no pair, the cell goes: its
    least and its largest row are known when its rows are counted, so no join has to make the pair.
    """
    counted = cells.groupBy("cell").agg(F.min("fp").alias("head"), F.max("fp").alias("last"), F.count("*").alias("n")).where("n > 1")
    if apart is not None:
        counted = counted.where(~((F.col("n") == 2) & apart(F.col("head"), F.col("last"))))
    return cut(cells.join(counted.drop("last"), "cell").select("cell", "fp", "head", "n"))


def along(shared: DataFrame, order: Column) -> DataFrame:
    """Pairs (u, v) of each row with its cell's head and with the row before it in order; repeats are left in."""
    piece = F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / PIECE))
    in_order = Window.partitionBy("cell", "piece").orderBy(order, "fp")
    ordered = shared.withColumn("piece", piece).select("fp", "head", F.lag("fp").over(in_order).alias("before"))
    return ordered.select(F.col("fp").alias("u"), F.explode(F.array_distinct(F.array("head", "before"))).alias("v")).where("u <> v")


def to_heads(shared: DataFrame) -> DataFrame:
    """Pairs (u, v) of each row with its cell's head; repeats are left in."""
    return shared.where("fp <> head").select(F.col("fp").alias("u"), F.col("head").alias("v"))


def in_turn(rows: DataFrame, order: Column) -> DataFrame:
    """Pairs (u, v) of each of the rows (cell, fp, label) with the row before it in order, where their labels are unlike."""
    pieces = rows.groupBy("cell").agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
    placed = rows.join(pieces, "cell").withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")))
    before = F.lag(F.struct("fp", "label")).over(Window.partitionBy("cell", "piece").orderBy(order, "fp"))
    return placed.withColumn("_before", before).where(F.col("_before.label") != F.col("label")).select(
        F.col("fp").alias("u"), F.col("_before.fp").alias("v"),
    )


def labelled(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(cell, fp, label) of shared; roots are (node, root) of the fps that have links."""
    return shared.select("cell", "fp").join(roots, F.col("fp") == F.col("node"), "left").select(
        "cell", "fp", F.coalesce("root", "fp").alias("label"),
    )


def to_hubs(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs (u, v) of each row (cell, fp, label) with its cell's hub v, where their labels are unlike."""
    degree = links.select(F.explode(F.array("u", "v")).alias("hub")).groupBy("hub").agg(F.count("*").alias("n"))
    known = rows.join(degree, F.col("fp") == F.col("hub"))
    hubs = known.groupBy("cell").agg(F.max_by(F.struct("hub", "label"), F.struct("n", "hub")).alias("_hub"))
    return rows.join(hubs, "cell").where(F.col("label") != F.col("_hub.label")).select(
        F.col("fp").alias("u"), F.col("_hub.hub").alias("v"),
    ).distinct()


def mixed(rows: DataFrame) -> DataFrame:
    """(cell, fp, label, major): the rows (cell, fp, label) of cells with several labels; major has the most rows."""
    sizes = rows.groupBy("cell", "label").agg(F.count("*").alias("n"))
    unlike = sizes.groupBy("cell").agg(
        F.max_by("label", F.struct("n", "label")).alias("major"), F.count("*").alias("labels"),
    ).where("labels > 1")
    return cut(rows.join(unlike, "cell").select("cell", "fp", "label", "major"))


def across(rows: DataFrame) -> DataFrame:
    """Pairs (u, v) of mixed rows in one cell with unlike labels."""
    other = rows.select("cell", F.col("fp").alias("v"), F.col("label").alias("v_label"))
    once = F.col("v_label").eqNullSafe(F.col("major")) | (F.col("fp") > F.col("v"))
    met = rows.where("label <> major").join(other, "cell")
    return met.where((F.col("label") != F.col("v_label")) & once).select(F.col("fp").alias("u"), "v")
