"""Spatial joins of diagram boxes whose work does not grow with the pairs of boxes that lie over each other.

A coordinate that must lie in a range is cut into nodes: halves of halves of its ranks, or the
multiples of a power of two. A box goes to the few nodes that make up its range, a point or an
inner box to the nodes it is in, and what is left of the test is an order: a running minimum or
maximum over the rows of a node. Boxes of one shape at one place count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmosaic.session import materialize, small_side

CONTAINER_WIDTH, CONTAINER_HEIGHT = 100, 40


def is_container(w: Column, h: Column) -> Column:
    """Subgroup boxes are wider than 100 and higher than 40; everything else is a leaf."""
    return (w > CONTAINER_WIDTH) & (h > CONTAINER_HEIGHT)


def _cell(v: Column, level: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), level))


# The grid is for boxes whose id is that of several shapes: a power of two at least as large as the box.


def _on_grid(boxes: DataFrame) -> DataFrame:
    """Boxes (group, box_id, x, y, w, h, ...) once per covered cell."""
    level = F.ceil(F.log2(F.greatest("w", "h", F.lit(1.0)))).cast("int")
    leveled = boxes.withColumn("level", level)
    span = lambda lo, size: F.sequence(_cell(F.col(lo), F.col("level")), _cell(F.col(lo) + F.col(size), F.col("level")))
    return leveled.withColumn("cx", F.explode(span("x", "w"))).withColumn("cy", F.explode(span("y", "h")))


def _levels(boxes: DataFrame) -> list[int]:
    """Levels in use: exponents of a double, so a short list whatever the number of boxes."""
    level = F.ceil(F.log2(F.greatest("w", "h", F.lit(1.0)))).cast("int")
    found = boxes.agg(F.sort_array(F.collect_set(level)).alias("l")).first().l
    return found or [0]


def _probe(points: DataFrame, levels: list[int], x: str, y: str) -> DataFrame:
    rows = points.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
    return rows.withColumn("cx", _cell(F.col(x), F.col("level"))).withColumn("cy", _cell(F.col(y), F.col("level")))


_SO_FAR = (Window.unboundedPreceding, Window.currentRow)
#: The level of y ranges without any length: no power of two.
_FLAT = -2000


def _shifted(c: Column, by: Column) -> Column:
    return F.call_function("shiftright", c, by)


def _bits(most: Column) -> Column:
    """Levels 0, 1, ... of the ranks up to ``most``."""
    return F.sequence(F.lit(0), F.length(F.bin(most)).cast("int"))


def _node(level: Column, node: Column) -> Column:
    return F.struct(level.alias("level"), node.alias("node"))


def _nodes_of(rank: Column, most: Column) -> Column:
    """The nodes that a rank lies in."""
    return F.transform(_bits(most), lambda k: _node(k, _shifted(rank, k)))


def _nodes_of_range(first: Column, last: Column) -> Column:
    """The nodes that together are the ranks ``first`` (1 or more) to ``last``: two of a level at most."""

    def of(k: Column) -> Column:
        a, b = _shifted(first - 1, k) + 1, _shifted(last + 1, k)
        return F.array(F.when((a < b) & (a % 2 == 1), _node(k, a)), F.when((a < b) & (b % 2 == 1), _node(k, b - 1)))

    return F.filter(F.flatten(F.transform(_bits(last + 1), of)), lambda x: x.isNotNull())


def _nodes_upto(rank: Column) -> Column:
    """The nodes that together are the ranks 0 to ``rank``, one of a level at most; their numbers are even."""
    listed = F.transform(_bits(rank + 1), lambda k: F.when(_shifted(rank + 1, k) % 2 == 1, _node(k, _shifted(rank + 1, k) - 1)))
    return F.filter(listed, lambda x: x.isNotNull())


def _shapes(boxes: DataFrame, *values: Column) -> DataFrame:
    """(group, x1, x2, y1, y2, values...) of each shape at its place."""
    edges = [F.col("x"), F.col("x") + F.col("w"), F.col("y"), F.col("y") + F.col("h")]
    named = [e.cast("double").alias(n) for e, n in zip(edges, ("x1", "x2", "y1", "y2"))]
    return boxes.where("group is not null").groupBy("group", *named).agg(*values).na.drop(subset=["x1", "x2", "y1", "y2"])


def point_in_box(points: DataFrame, boxes: DataFrame, last_wins: bool = False) -> DataFrame:
    """(group, point_id, box_id): the first (or last) box by ``ord`` that holds a point, border included.

    ``points`` has (group, point_id, px, py); ``boxes`` (group, box_id, ord, x, y, w, h). The x range
    of a box is nodes of the ranks of x edges. Its y range holds some lines, multiples of a power of
    two: a point between two lines is in the box if that has the lower one and ends behind the
    point, or has the upper one and starts before it.
    """
    rank = -F.col("ord") if last_wins else F.col("ord")
    held = _shapes(boxes, F.min(F.struct(rank.alias("rank"), "box_id")).alias("best")).where("x1 <= x2 and y1 <= y2")
    tall = F.col("y2") - F.col("y1")
    held = materialize(held.withColumn(
        "y_level", F.when(tall > 0, F.floor(F.log2(tall)).cast("int") - 1).otherwise(F.lit(_FLAT))), "boxes")
    asked = points.select("group", "point_id", F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py"))
    places = asked.na.drop(subset=["group", "px", "py"]).select("group", "px", "py").distinct()

    # edges have odd ranks, a point has that of its edge, or the even one behind it
    edges = held.select("group", "x1").union(held.select("group", "x2")).toDF("group", "px").distinct()
    edges = materialize(edges.withColumn("n", 2 * F.dense_rank().over(Window.partitionBy("group").orderBy("px")) - 1), "edges")
    rank_of = lambda x: edges.select("group", F.col("px").alias(x), F.col("n").alias(f"{x}_rank"))
    spans = held.join(rank_of("x1"), ["group", "x1"]).join(rank_of("x2"), ["group", "x2"])
    spans = spans.withColumn("x_node", F.explode(_nodes_of_range(F.col("x1_rank"), F.col("x2_rank"))))
    flat, per = F.col("y_level") == _FLAT, F.pow(F.lit(2.0), -F.col("y_level"))
    first, last = F.ceil(F.col("y1") * per), F.floor(F.col("y2") * per)
    lines = F.when(flat, F.array("y1")).otherwise(F.sequence(first, F.greatest(first, last)).cast("array<double>"))
    spans = spans.select("group", "x_node", "y_level", "y1", "y2", "best", F.posexplode(lines).alias("i", "line"))
    key = ["group", "x_node", "y_level", "line", "side"]
    none = F.lit(None).cast("double")
    ends = spans.select(*key[:-1], F.lit(1).alias("side"), (-F.col("y2")).alias("at"), "best", none.alias("px"), none.alias("py"))
    starts = spans.where("i = 0").select(*key[:-1], F.lit(-1).alias("side"), F.col("y1").alias("at"), "best", none.alias("px"), none.alias("py"))

    both = places.withColumn("n", F.lit(None).cast("int")).unionByName(edges.withColumn("py", none))
    edge = F.when(F.col("n").isNotNull(), F.struct("n", "px"))
    both = both.withColumn("edge", F.max(edge).over(Window.partitionBy("group").orderBy("px", F.col("n").isNull()).rowsBetween(*_SO_FAR)))
    placed = both.where("n is null and edge is not null").withColumn(
        "n", F.col("edge.n") + F.when(F.col("edge.px") == F.col("px"), 0).otherwise(1))
    tops = edges.groupBy("group").agg(F.max("n").alias("top"))
    placed = placed.join(small_side(tops), "group").where("n <= top").select(
        "group", "px", "py", F.explode(_nodes_of(F.col("n"), F.col("top") + 1)).alias("x_node"))
    # a point goes to nodes and levels that have boxes
    placed = placed.join(small_side(spans.select("group", "x_node", "y_level").distinct()), ["group", "x_node"])
    below = F.when(flat, F.col("py")).otherwise(F.floor(F.col("py") * per).cast("double"))
    side = lambda s, line: F.struct(F.lit(s).alias("side"), line.alias("line"))
    sides = F.when(flat, F.array(side(1, below))).otherwise(F.array(side(1, below), side(-1, below + 1)))
    queries = placed.select("group", "x_node", "y_level", "px", "py", F.explode(sides).alias("s")).select(
        "group", "x_node", "y_level", "s.line", "s.side", (F.col("py") * -F.col("s.side")).alias("at"),
        F.lit(None).cast(held.schema["best"].dataType).alias("best"), "px", "py")
    # boxes that end or start at a point come before it
    order = Window.partitionBy(*key).orderBy("at", F.col("px").isNotNull()).rowsBetween(*_SO_FAR)
    found = ends.unionByName(starts).unionByName(queries).withColumn("best", F.min("best").over(order))
    found = found.where("px is not null and best is not null").groupBy("group", "px", "py").agg(F.min("best").alias("best"))
    held_by = asked.join(found, ["group", "px", "py"]).groupBy("group", "point_id").agg(F.min("best").alias("best"))
    return held_by.select("group", "point_id", "best.box_id")


def _enclosed_shapes(shapes: DataFrame) -> DataFrame:
    """(group, x1, x2, y1, y2) of shapes inside another shape of their group.

    Outer shapes start no later and end no earlier on both axes. The x edges are nodes of ranks;
    in a node rows go by y1, and the largest y2 so far tells. Of shapes with one y1 the outer
    ones come first, and a shape is asked before it counts.
    """
    by = lambda *order: F.dense_rank().over(Window.partitionBy("group").orderBy(*order)) - 1
    ranked = shapes.withColumn("r1", by("x1")).withColumn("r2", by(F.col("x2").desc()))
    whole = Window.partitionBy("group")
    ranked = materialize(ranked.withColumn("m1", F.max("r1").over(whole)).withColumn("m2", F.max("r2").over(whole)), "shapes")
    edges = ["group", "x1", "x2", "y1", "y2"]
    even = lambda nodes: F.filter(nodes, lambda x: x["node"] % 2 == 0)
    dealt = lambda a, b: ranked.withColumn("a", F.explode(a)).withColumn("b", F.explode(b)).select(*edges, "a", "b")
    outer = dealt(even(_nodes_of(F.col("r1"), F.col("m1") + 1)), even(_nodes_of(F.col("r2"), F.col("m2") + 1))).withColumn("asks", F.lit(0))
    inner = dealt(_nodes_upto(F.col("r1")), _nodes_upto(F.col("r2"))).withColumn("asks", F.lit(1))
    order = ["y1", F.col("y2").desc(), "x1", F.col("x2").desc(), F.col("asks").desc()]
    furthest = F.max(F.when(F.col("asks") == 0, F.col("y2"))).over(Window.partitionBy("group", "a", "b").orderBy(*order).rowsBetween(*_SO_FAR))
    return outer.unionByName(inner).withColumn("furthest", furthest).where("asks = 1 and furthest >= y2").select(*edges).distinct()


def enclosed(boxes: DataFrame) -> DataFrame:
    """(group, box_id) of boxes that lie fully inside another box of their group.

    Boxes of one shape are inside each other. An id that several shapes of a group have does not
    lie in itself: such boxes are compared one by one, on a grid.
    """
    edges = ["group", "x1", "x2", "y1", "y2"]
    named = boxes.where("box_id is not null")
    shapes = materialize(_shapes(named, F.min("box_id").alias("least"), F.max("box_id").alias("most")), "shapes")
    inside = materialize(_enclosed_shapes(shapes).withColumn("inside", F.lit(True)), "inside")
    of = named.select(
        "group", "box_id", F.col("x").cast("double").alias("x1"), (F.col("x") + F.col("w")).cast("double").alias("x2"),
        F.col("y").cast("double").alias("y1"), (F.col("y") + F.col("h")).cast("double").alias("y2")).distinct()
    of = of.join(shapes, edges).join(inside, edges, "left")
    told = of.groupBy("group", "box_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.coalesce("inside", F.lit(False)) | (F.col("least") != F.col("most"))).alias("inside"))
    told = materialize(told, "told")
    several = told.where("n > 1").select("group", "box_id")
    alone = told.where("n = 1 and inside").select("group", "box_id")
    if several.isEmpty():
        return alone
    return alone.unionByName(_enclosed_one_by_one(boxes.join(several, ["group", "box_id"], "left_semi"), boxes))


def _enclosed_one_by_one(inner: DataFrame, boxes: DataFrame) -> DataFrame:
    """(group, box_id) of those ``inner`` boxes that lie in a box of another id.

    The corner of an inner box lies in a cell of the outer one, at a level not
    below its own. A semi join stops at the first enclosing box.
    """
    grid = _on_grid(boxes).select(
        F.col("group").alias("_group"), F.col("box_id").alias("_id"), F.col("level").alias("_level"),
        F.col("cx").alias("_cx"), F.col("cy").alias("_cy"),
        F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("w").alias("ow"), F.col("h").alias("oh"),
    )
    probes = _probe(inner, _levels(boxes), "x", "y")
    within = (
        (F.col("ox") <= F.col("x")) & (F.col("x") + F.col("w") <= F.col("ox") + F.col("ow"))
        & (F.col("oy") <= F.col("y")) & (F.col("y") + F.col("h") <= F.col("oy") + F.col("oh"))
    )
    same_cell = (
        (F.col("group") == F.col("_group"))
        & (F.col("level") == F.col("_level"))
        & (F.col("cx") == F.col("_cx"))
        & (F.col("cy") == F.col("_cy"))
    )
    return probes.join(grid, same_cell & within & (F.col("box_id") != F.col("_id")), "left_semi").select(
        "group", "box_id"
    ).distinct()


def roots(boxes: DataFrame) -> DataFrame:
    """Boxes not fully inside any other box of their group."""
    return boxes.join(enclosed(boxes), ["group", "box_id"], "left_anti")


def assign_to_roots(boxes: DataFrame) -> DataFrame:
    """(group, point_id, box_id): root box that holds the centre of each other box; the last root by ``ord`` wins."""
    top = roots(boxes)
    rest = boxes.join(top.select("group", "box_id"), ["group", "box_id"], "left_anti")
    centres = rest.select(
        "group",
        F.col("box_id").alias("point_id"),
        (F.col("x") + F.col("w") / 2).alias("px"),
        (F.col("y") + F.col("h") / 2).alias("py"),
    )
    return point_in_box(centres, top, last_wins=True)
