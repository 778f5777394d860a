"""Diagrams (draw.io XML): objects, cells, groups, entities, relationships, Markdown.

Files are read with Spark's XML source, one row per element; names that repeat
across files are kept apart by the file path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmosaic.functions.markup import cardinality, cardinality_phrase, clean_label, relationship_type
from docmosaic.functions.predicates import bucket
from docmosaic.operators.matching import enrich_edges, known_endpoints
from docmosaic.operators.ranking import keep_first

GEOMETRY = "_x string, _y string, _width string, _height string"
CELL = f"_id string, _style string, _vertex string, _edge string, _parent string, _source string, _target string, mxGeometry struct<{GEOMETRY.replace(' string', ':string')}>"
OBJECT = (
    "_id string, _label string, _type string, _factSheetType string, _factSheetId string, "
    f"mxCell struct<{CELL.replace(' string', ':string').replace('mxGeometry struct', 'mxGeometry:struct')}>"
)
ROOT_PARENT = "1"


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Object elements with their cell and geometry."""
    return spark.read.format("xml").option("rowTag", "object").schema(OBJECT).load(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """All mxCell elements, those inside objects too."""
    return spark.read.format("xml").option("rowTag", "mxCell").schema(CELL).load(path)


def _asset_columns(o: str = "") -> list[Column]:
    c = lambda name: F.col(f"{o}{name}")
    number = lambda name: F.col(f"{o}mxCell.mxGeometry._{name}").try_cast("double").alias(name)
    return [
        c("_id").alias("id"),
        clean_label(c("_label")).alias("label"),
        c("_type").alias("type"),
        F.coalesce(c("_factSheetType"), F.lit("Unknown")).alias("fact_sheet_type"),
        F.coalesce(c("_factSheetId"), F.lit("")).alias("fact_sheet_id"),
        c("mxCell._parent").alias("parent_id"),
        F.coalesce(c("mxCell._style"), F.lit("")).alias("style"),
        c("mxCell._vertex").alias("vertex"),
        number("x"),
        number("y"),
        number("width"),
        number("height"),
    ]


def parse_objects(rows: DataFrame, column: str) -> DataFrame:
    """Objects given as XML strings, one per row, to asset rows."""
    parsed = rows.select("*", F.from_xml(F.col(column), OBJECT).alias("_o"))
    keep = [c for c in rows.columns if c != column]
    return parsed.select(*keep, *_asset_columns("_o."))


def assets(objects: DataFrame) -> DataFrame:
    """Fact-sheet objects (id, label, type, parent, geometry)."""
    return objects.select(*_asset_columns()).where("id is not null and type = 'factSheet' and parent_id is not null")


def group_cells(objects: DataFrame, cells: DataFrame) -> DataFrame:
    """(id, parent_id) of group containers: bare cells with a group style, then objects wrapping one."""
    grouped = lambda style, vertex: F.contains(F.coalesce(style, F.lit("")), F.lit("group")) & (vertex == "1")
    bare = cells.where(grouped(F.col("_style"), F.col("_vertex")) & F.col("_id").isNotNull()).select(
        F.col("_id").alias("id"), F.coalesce("_parent", F.lit(ROOT_PARENT)).alias("parent_id")
    )
    wrapped = objects.where(grouped(F.col("mxCell._style"), F.col("mxCell._vertex")) & F.col("_id").isNotNull()).select(
        F.col("_id").alias("id"), F.coalesce("mxCell._parent", F.lit(ROOT_PARENT)).alias("parent_id")
    )
    return bare.unionByName(wrapped.join(bare, "id", "left_anti"))


def group_labels(children: DataFrame) -> DataFrame:
    """(id, label, fact_sheet_id) of groups: those of the first fact-sheet child in document order.

    ``children`` has (parent_id, ord, type, label, fact_sheet_id).
    """
    typed = children.where("type = 'factSheet' and label <> ''").select("parent_id", "ord", "label", "fact_sheet_id")
    return keep_first(typed, ["parent_id"], ["ord"]).select(F.col("parent_id").alias("id"), "label", "fact_sheet_id")


def resolve_groups(assets: DataFrame, groups: DataFrame) -> DataFrame:
    """Assets with domain and subgroup: a nested group gives the subgroup, its parent the domain."""
    parent = groups.select(F.col("id").alias("parent_id"), F.col("label").alias("_p"), F.col("parent_id").alias("_gp_id"))
    top = groups.select(F.col("id").alias("_gp_id"), F.col("label").alias("_gp"))
    rows = assets.join(parent, "parent_id", "left").join(top, "_gp_id", "left")
    nested = F.col("_gp").isNotNull()
    return rows.select(
        *assets.columns,
        F.coalesce("_gp", "_p", F.lit("")).alias("domain"),
        F.when(nested, F.col("_p")).otherwise(F.lit("")).alias("subgroup"),
    )


def container_ids(groups: DataFrame) -> DataFrame:
    """(domain, subtype, fact_sheet_id): top-level groups are domains, nested ones subtypes of their parent."""
    parent = groups.select(F.col("id").alias("parent_id"), F.col("label").alias("_parent_label"))
    rows = groups.join(parent, "parent_id", "left").where(
        (F.col("parent_id") == ROOT_PARENT) | F.col("_parent_label").isNotNull()
    )
    top = F.col("parent_id") == ROOT_PARENT
    return rows.select(
        F.when(top, F.col("label")).otherwise(F.col("_parent_label")).alias("domain"),
        F.when(top, F.lit("")).otherwise(F.col("label")).alias("subtype"),
        "fact_sheet_id",
    )


def leaf_entities(assets: DataFrame) -> DataFrame:
    """Leaf entities, the first per label (case ignored) in the order domain, subgroup, label.

    Domain labels and labels used as a subgroup of the domain are containers.
    """
    used = assets.where("subgroup <> ''").select(
        F.col("domain").alias("_domain"), F.col("subgroup").alias("_container")
    ).distinct()
    leaf = assets.where(F.upper("label") != F.upper("domain")).join(
        used, (F.col("domain") == F.col("_domain")) & (F.col("label") == F.col("_container")), "left_anti"
    )
    return keep_first(leaf, [F.lower("label")], ["domain", "subgroup", "label", "ord"])


def relationships(cells: DataFrame, assets: DataFrame) -> DataFrame:
    """Edges between known assets with type and cardinality decoded, labels and domains added."""
    edges = cells.where("_edge = '1' and _source is not null and _target is not null").select(
        F.coalesce("_id", F.lit("")).alias("id"),
        F.col("_source").alias("source_id"),
        F.col("_target").alias("target_id"),
        F.coalesce(relationship_type(F.col("_style")), F.lit("")).alias("relationship_type"),
        F.coalesce(cardinality(F.col("_style")), F.lit("")).alias("cardinality"),
    )
    known = known_endpoints(edges.withColumnRenamed("id", "edge_id"), assets)
    return enrich_edges(known, assets)


def _bullet(label: str, c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"- **{label}:** "), c, F.lit("\n"))).otherwise(F.lit(""))


def entity_markdown() -> Column:
    """Section of one entity (columns entity_name, domain, subtype, fact_sheet_id, fact_sheet_type)."""
    code = F.when(F.col("fact_sheet_id") != "", F.concat(F.lit("`"), F.col("fact_sheet_id"), F.lit("`")))
    return F.concat(
        F.lit("## "), F.col("entity_name"), F.lit("\n\n- **Domain:** "), F.col("domain"), F.lit("\n"),
        _bullet("Subtype", F.col("subtype")), _bullet("LeanIX ID", code), _bullet("Type", F.col("fact_sheet_type")),
    )


def relationship_markdown() -> Column:
    return F.concat(
        F.lit("## "), F.col("source_entity"), F.lit(" → "), F.col("target_entity"), F.lit("\n\n"),
        _bullet("Source domain", F.col("source_domain")), _bullet("Target domain", F.col("target_domain")),
        _bullet("Cardinality", F.col("cardinality")), _bullet("Type", F.col("relationship_type")),
    )


def relationship_sentence() -> Column:
    """``A relates to (...) B`` for a narrative."""
    return F.concat_ws(" ", "source_entity", cardinality_phrase(F.col("cardinality")), "target_entity")


def narrative_sections(entities: DataFrame, samples: DataFrame) -> DataFrame:
    """(section_key, markdown): one section per domain from its member counts and samples.

    ``samples`` has (domain, subgroup, n, sample); the names listed are capped, the counts are whole.
    """
    from docmosaic.functions.text import slug

    line = F.concat(
        F.lit("- "), F.when(F.col("subgroup") == "", F.lit("General")).otherwise(F.col("subgroup")),
        F.lit(" ("), F.col("n"), F.lit("): "), F.col("sample"), F.lit("\n"),
    )
    lines = samples.groupBy("domain").agg(
        F.sum("n").alias("total"), F.array_join(F.array_sort(F.collect_list(line)), "").alias("body")
    )
    return lines.select(
        slug(F.col("domain")).alias("section_key"),
        F.concat(F.lit("# "), F.col("domain"), F.lit("\n\n"), F.col("total"), F.lit(" entities\n\n"), F.col("body")).alias("markdown"),
    )


def uncategorised(assets: DataFrame) -> DataFrame:
    """(bucket, n): assets without a domain, by the kind their label suggests."""
    return assets.where("domain = ''").groupBy(bucket(F.col("label")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def model_json(entities: DataFrame, relations: DataFrame, model_name: str, source_file: str) -> DataFrame:
    """JSON lines of the model: a metadata record, then one record per entity and relationship.

    The document is written as records, so that no task holds the whole model.
    """
    meta = (
        entities.agg(F.count(F.lit(1)).alias("entity_count"))
        .withColumn("k", F.lit(1))
        .join(relations.agg(F.count(F.lit(1)).alias("relationship_count")).withColumn("k", F.lit(1)), "k")
        .select(
            F.lit("metadata").alias("kind"),
            F.to_json(
                F.struct(
                    F.lit(model_name).alias("model_name"), F.lit(source_file).alias("source_file"), "entity_count", "relationship_count"
                )
            ).alias("json"),
        )
    )
    rows = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("json"))
    return meta.unionByName(rows(entities, "entity")).unionByName(rows(relations, "relationship"))


MODEL = (
    "metadata struct<model_name:string,source_file:string,entity_count:bigint,relationship_count:bigint>, "
    "entities array<struct<domain:string,domain_fact_sheet_id:string,subtype:string,subtype_fact_sheet_id:string,"
    "entity_name:string,fact_sheet_id:string,fact_sheet_type:string>>, "
    "relationships array<struct<source_entity:string,source_domain:string,target_entity:string,target_domain:string,"
    "cardinality:string,relationship_type:string>>"
)


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities (ord, ..., subgroup) and relationships of a model document; a missing file is an error."""
    doc = spark.read.option("multiLine", True).schema(MODEL).json(path)
    rows = doc.select(F.posexplode("entities").alias("ord", "e")).select(F.col("ord").cast("bigint").alias("ord"), "e.*")
    entities = rows.withColumn("domain", F.upper("domain")).withColumnsRenamed(
        {"subtype": "subgroup", "subtype_fact_sheet_id": "subgroup_fact_sheet_id"}
    )
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in entities.columns if c != "ord"]
    relations = doc.select(F.posexplode("relationships").alias("ord", "r")).select(F.col("ord").cast("bigint").alias("ord"), "r.*")
    return entities.select("ord", *blank), relations


def parse(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Leaf entities and relationships of a diagram: groups, assets, visual domains, edges, subgroups.

    Each step is written once: its rows are used several times, and document
    order (``ord``) must be the same in all of them.
    """
    from docmosaic.operators import spatial
    from docmosaic.session import materialize

    objects = materialize(read_objects(spark, path).withColumn("ord", F.monotonically_increasing_id()), "objects")
    cells = materialize(read_cells(spark, path), "cells")
    groups = materialize(group_cells(objects, cells), "groups")
    rows = objects.select("ord", *_asset_columns()).where("id is not null and type = 'factSheet' and parent_id is not null")
    labels = group_labels(rows)
    placed = resolve_groups(rows.join(groups.select("id"), "id", "left_anti"), groups.join(labels, "id"))
    placed = materialize(placed, "placed")
    box = [F.coalesce(c, F.lit(0.0)).alias(a) for c, a in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))]
    # boxes straight on the canvas: the outermost are domains, the rest belong to the one around them
    loose = placed.where("domain = '' and x is not null and y is not null").where(F.col("parent_id") == ROOT_PARENT)
    loose_boxes = loose.select(F.lit("").alias("group"), F.col("id").alias("box_id"), "ord", *box)
    tops = spatial.roots(loose_boxes).select(F.col("box_id").alias("id"))
    inside = spatial.assign_to_roots(loose_boxes).select(F.col("point_id").alias("id"), F.col("box_id").alias("_root"))
    names = rows.select(F.col("id").alias("_root"), F.col("label").alias("_domain"))
    joined = placed.join(tops, "id", "left_anti").join(inside.join(names, "_root"), "id", "left")
    assets_ = joined.select(
        "id", "ord", "label", "fact_sheet_id", "fact_sheet_type", "subgroup",
        F.coalesce("_domain", "domain").alias("domain"), F.coalesce("_root", "parent_id").alias("parent_id"), *box,
    )
    assets_ = materialize(assets_, "assets")
    # leaves take the subgroup of the first container box that holds their centre
    holder = spatial.is_container(F.col("w"), F.col("h"))
    held = assets_.where(F.upper("label") != F.upper("domain")).withColumn("group", F.col("parent_id"))
    points = held.where(~holder).select(
        "group", F.col("id").alias("point_id"), (F.col("x") + F.col("w") / 2).alias("px"), (F.col("y") + F.col("h") / 2).alias("py")
    )
    boxes = held.where(holder).select("group", F.col("id").alias("box_id"), "ord", "x", "y", "w", "h")
    found = spatial.point_in_box(points, boxes).select(F.col("point_id").alias("id"), F.col("box_id").alias("_box"))
    box_names = rows.select(F.col("id").alias("_box"), F.col("label").alias("_subgroup"))
    final = assets_.join(found.join(box_names, "_box"), "id", "left").withColumn(
        "subgroup", F.coalesce("_subgroup", "subgroup")
    ).select("id", "ord", "label", "domain", "subgroup", "fact_sheet_id", "fact_sheet_type")
    final = materialize(final, "final")
    return leaf_entities(final), relationships(cells, final)


def read_markdown(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, text) of diagrams: one Markdown section per leaf entity."""
    out = None
    for path in paths:
        leaf, _ = parse(spark, path)
        named = leaf.withColumnsRenamed({"label": "entity_name", "subgroup": "subtype"})
        rows = named.select(F.lit(path).alias("path"), entity_markdown().alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_relationships(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Relationships of all model documents, and of relationship lists, that the paths (globs) name."""
    docs = spark.read.option("multiLine", True).json(paths)
    if "relationships" in docs.columns:
        inside = docs.select(F.explode("relationships").alias("r")).select("r.*")
        # rows of files that are lists have the fields themselves
        own = [c for c in inside.columns if c in docs.columns]
        if own:
            lists = docs.where(F.col("relationships").isNull() & F.coalesce(*[F.col(c).cast("string") for c in own]).isNotNull())
            inside = inside.unionByName(lists.select(*own), allowMissingColumns=True)
        docs = inside
    return docs.withColumn("ord", F.monotonically_increasing_id())
