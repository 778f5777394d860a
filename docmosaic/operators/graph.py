"""Relationship graph: build, neighbours, bounded and unbounded traversal.

Traversal is breadth-first by joins. Each round's frontier is written to the
shared folder, so plans stay short and a lost executor does not undo the walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmosaic.functions.text import first_nonblank
from docmosaic.session import materialize, small_side


def normalize_relationships(rows: DataFrame) -> DataFrame:
    """Rows of either spelling (source_entity/source/entity_a ...) to one; rows without both ends are dropped."""
    have = lambda *names: first_nonblank(*[F.col(n) for n in names if n in rows.columns] or [F.lit(None).cast("string")])
    kind = F.coalesce(have("relationship_type"), F.lit("related"))
    return rows.select(
        "ord",
        have("source_entity", "source", "entity_a").alias("src"),
        have("target_entity", "target", "entity_b").alias("dst"),
        kind.alias("relationship_type"),
        F.coalesce(have("cardinality"), F.lit("")).alias("cardinality"),
        F.coalesce(have("inverse_type"), F.concat(F.lit("inverse_"), kind)).alias("inverse_type"),
    ).where("src is not null and dst is not null")


def build(relationships: DataFrame, directed: bool = False) -> DataFrame:
    """(src, dst, relationship_type, cardinality): every edge and its inverse; a repeated pair keeps the last.

    ``relationships`` has (ord, src, dst, relationship_type, cardinality, inverse_type).
    """
    step = lambda inverse: F.struct(F.col("ord"), F.lit(inverse).alias("inverse"))
    forward = relationships.select("src", "dst", "relationship_type", "cardinality", step(0).alias("at"))
    edges = forward
    if not directed:
        backward = relationships.select(
            F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("inverse_type").alias("relationship_type"),
            "cardinality", step(1).alias("at"),
        )
        edges = forward.unionByName(backward)
    last = F.max(F.struct("at", "relationship_type", "cardinality"))
    return edges.groupBy("src", "dst").agg(last.alias("e")).select("src", "dst", "e.relationship_type", "e.cardinality")


def of_type(edges: DataFrame, fragment: str) -> DataFrame:
    """Edges whose type contains the fragment, case ignored."""
    return edges.where(F.contains(F.lower("relationship_type"), F.lit(fragment.lower())))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def suggest(edges: DataFrame, name: str, n: int = 5) -> DataFrame:
    """First ``n`` nodes (by name) that contain the text."""
    hits = nodes(edges).where(F.contains(F.lower("node"), F.lit(name.lower())))
    return hits.orderBy("node").limit(n)


def neighbors(edges: DataFrame, name: str) -> DataFrame:
    return edges.where(F.col("src") == name).select(F.col("dst").alias("node"), "relationship_type", "cardinality")


def reachable(edges: DataFrame, start: str, max_depth: int | None = None) -> DataFrame:
    """(node, hops) for every node reached from ``start``, itself at 0 hops."""
    spark = edges.sparkSession
    links = materialize(edges.select("src", "dst").distinct(), "links")
    frontier = spark.createDataFrame([(start, 0)], "node string, hops int")
    visited = frontier
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = (
            links.join(small_side(frontier.select(F.col("node").alias("src"))), "src")
            .select(F.col("dst").alias("node"))
            .distinct()
            .join(visited.select("node"), "node", "left_anti")
            .withColumn("hops", F.lit(depth))
        )
        frontier = materialize(step, "frontier")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def descendants(edges: DataFrame, start: str) -> DataFrame:
    return reachable(edges, start).where(F.col("node") != start)


def ancestors(edges: DataFrame, start: str) -> DataFrame:
    return descendants(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start)


def ego_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among the members."""
    m = small_side(members.select("node"))
    return edges.join(m, F.col("src") == F.col("node"), "left_semi").join(m, F.col("dst") == F.col("node"), "left_semi")


def shortest_paths(edges: DataFrame, start: str, max_depth: int) -> DataFrame:
    """(node, hops, path): one shortest path per node within ``max_depth`` hops, the first by node names."""
    spark = edges.sparkSession
    links = materialize(edges.select("src", "dst").distinct(), "links")
    frontier = spark.createDataFrame([(start, 0, [start])], "node string, hops int, path array<string>")
    found = frontier
    for depth in range(1, max_depth + 1):
        step = (
            links.join(small_side(frontier.select(F.col("node").alias("src"), "path")), "src")
            .groupBy(F.col("dst").alias("node"))
            .agg(F.min("path").alias("path"))
            .join(found.select("node"), "node", "left_anti")
            .select("node", F.lit(depth).alias("hops"), F.concat("path", F.array("node")).alias("path"))
        )
        frontier = materialize(step, "paths")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found.where(F.col("node") != start)


OPERATIONS = ("neighbors", "ego_graph", "ancestors", "descendants", "all_shortest_paths")


def traversal(edges: DataFrame, name: str, operation: str = "neighbors", relationship_type: str | None = None, max_depth: int = 2) -> DataFrame:
    """All rows of a traversal: (node, relationship_type, cardinality), (src, dst, relationship_type, ...), (node, hops) or (node, hops, path)."""
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation {operation!r}; valid: {', '.join(OPERATIONS)}")
    if relationship_type:
        edges = of_type(edges, relationship_type)
    if operation == "neighbors":
        return neighbors(edges, name)
    if operation == "ego_graph":
        return ego_edges(edges, reachable(edges, name, max_depth))
    if operation == "all_shortest_paths":
        return shortest_paths(edges, name, max_depth)
    return ancestors(edges, name) if operation == "ancestors" else descendants(edges, name)


def traverse(
    edges: DataFrame, name: str, operation: str = "neighbors", relationship_type: str | None = None, max_depth: int = 2, most: int | None = None
) -> DataFrame:
    """One-row result (json) of a traversal, for display: lists of up to ``most`` entries, or whole. ``traversal`` has the rows."""
    spark = edges.sparkSession
    touches = (F.col("src") == name) | (F.col("dst") == name)
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation {operation!r}; valid: {', '.join(OPERATIONS)}")
    if edges.where(touches).isEmpty():
        hits = [r.node for r in suggest(edges, name).collect()]
        body = {"error": f"'{name}' not found"}
        body |= {"suggestions": hits} if hits else {"total_nodes": nodes(edges).count()}
        return _json(spark, body)
    if relationship_type and of_type(edges, relationship_type).where(touches).isEmpty():
        return _json(spark, {"error": f"No '{relationship_type}' relationships for '{name}'"})
    rows = materialize(traversal(edges, name, operation, relationship_type, max_depth), "traversal")
    head = {"entity": name, "operation": operation}

    def shown(df: DataFrame, *order: str):
        df = df.orderBy(*order)
        return (df if most is None else df.limit(most)).toLocalIterator()

    if operation == "neighbors":
        listed = [{"entity": r.node, "relationship_type": r.relationship_type, "cardinality": r.cardinality} for r in shown(rows, "node")]
        return _json(spark, {**head, "neighbors": listed, "total": rows.count()})
    if operation == "ego_graph":
        kept = of_type(edges, relationship_type) if relationship_type else edges
        members = materialize(reachable(kept, name, max_depth), "members")
        return _json(spark, {
            **head, "max_depth": max_depth, "total_nodes": members.count(), "total_edges": rows.count(),
            "nodes": [r.node for r in shown(members, "hops", "node")],
            "edges": [{"source": r.src, "target": r.dst, "type": r.relationship_type} for r in shown(rows, "src", "dst")],
        })
    if operation == "all_shortest_paths":
        return _json(spark, {
            **head, "max_depth": max_depth, "total_reachable": rows.count(), "paths": {r.node: r.path for r in shown(rows, "hops", "node")}})
    return _json(spark, {**head, "total": rows.count(), operation: [r.node for r in shown(rows, "hops", "node")]})


def _json(spark, body: dict) -> DataFrame:
    import json

    return spark.createDataFrame([(json.dumps(body, ensure_ascii=False),)], "json string")
