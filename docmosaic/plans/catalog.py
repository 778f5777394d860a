"""Consolidated catalog: model entities, defined terms, inventory and contexts in one table.

All steps are joins on unique keys: each side that could repeat a key is
reduced to one row per key by an aggregate first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmosaic.functions import fixed
from docmosaic.functions.predicates import real_definition, real_governance
from docmosaic.functions.text import normalize
from docmosaic.operators.matching import best_mapping, with_forced
from docmosaic.operators.ranking import keep_first, top_k
from docmosaic.session import small_side

CONTEXT = [name for _, name in fixed.CONTEXT_FIELDS]
PAGE_ROWS = 1000


def inventory_join(entities: DataFrame, inventory: DataFrame) -> DataFrame:
    """Entities with the inventory's description, level, status and type; defaults where there is none."""
    inv = inventory.select(
        F.col("id").alias("_id"), "description", "level", "status", F.col("type").alias("inventory_type")
    )
    joined = entities.join(inv, F.col("fact_sheet_id") == F.col("_id"), "left")
    found = F.col("_id").isNotNull()
    default = lambda c, v: F.when(found, F.coalesce(F.col(c), F.lit(""))).otherwise(F.lit(v)).alias(c)
    return joined.select(
        *entities.columns,
        default("description", fixed.NO_DESCRIPTION),
        default("level", ""),
        default("status", ""),
        default("inventory_type", ""),
        found.alias("in_inventory"),
    )


def canned_context(entities: DataFrame, no_coverage: DataFrame, context: DataFrame) -> DataFrame:
    """Context rows, replaced by the canned text for entities known to have no coverage."""
    # Text of an entity confirmed to be absent from the corpus.
    absent = "Not defined in FA Handbook"
    none = no_coverage.select(normalize(F.col("entity_name")).alias("entity_key")).distinct()
    canned = entities.select(normalize(F.col("entity_name")).alias("entity_key")).distinct().join(
        small_side(none), "entity_key", "left_semi"
    )
    fields = [F.lit("").alias(c) for c in CONTEXT if c not in ("formal_definition", "governance_rules")]
    canned = canned.select(
        "entity_key",
        F.lit(absent).alias("formal_definition"),
        F.lit("Not documented — outside governance scope").alias("governance_rules"),
        *fields,
    )
    return context.join(small_side(none), "entity_key", "left_anti").unionByName(canned.select(*context.columns))


def static_override(context: DataFrame, static: DataFrame) -> DataFrame:
    """Pre-curated fields win over retrieved ones; fields left NULL keep the retrieved text."""
    fields = [c for c in static.columns if c != "entity_key"]
    s = static.select("entity_key", *[F.col(c).alias(f"_s_{c}") for c in fields])
    out = context.join(small_side(s), "entity_key", "left")
    return out.select(
        *[F.coalesce(f"_s_{c}", c).alias(c) if c in fields else F.col(c) for c in context.columns]
    )


def relationships_by_source(relationships: DataFrame) -> DataFrame:
    """(entity_key, n_relationships): counted per normalised source name."""
    return relationships.groupBy(normalize(F.col("source_entity")).alias("entity_key")).agg(
        F.count(F.lit(1)).alias("n_relationships")
    )


def consolidate(
    entities: DataFrame,
    mappings: DataFrame,
    inventory: DataFrame,
    context: DataFrame,
    relationships: DataFrame,
    forced: DataFrame,
) -> DataFrame:
    """Model entities with source class, mapping, inventory text, context and relationship count.

    An entity without a mapped term is promoted to BOTH when its context holds a
    real definition or real governance text. ``context`` is keyed by entity_key.
    """
    mapping = with_forced(best_mapping(mappings), forced).drop("ord")
    keyed = inventory_join(entities, inventory).withColumn("entity_key", normalize(F.col("entity_name")))
    rows = (
        keyed.join(mapping, "entity_key", "left")
        .join(context, "entity_key", "left")
        .join(relationships_by_source(relationships), "entity_key", "left")
    )
    mapped = F.col("term").isNotNull()
    promoted = ~mapped & (real_definition(F.col("formal_definition")) | real_governance(F.col("governance_rules")))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return rows.select(
        "fact_sheet_id",
        "entity_name",
        "domain",
        "domain_fact_sheet_id",
        "subgroup",
        "subgroup_fact_sheet_id",
        F.when(mapped | promoted, F.lit("BOTH")).otherwise(F.lit("LEANIX_ONLY")).alias("source"),
        F.col("description").alias("leanix_description"),
        *[blank(c) for c in CONTEXT],
        F.col("term").alias("handbook_term"),
        F.when(promoted, F.lit("medium")).otherwise(F.coalesce("mapping_confidence", F.lit(""))).alias("mapping_confidence"),
        F.when(
            promoted,
            F.lit("Handbook content found via RAG — entity referenced but not exact-matched in Step 4"),
        )
        .otherwise(F.coalesce("mapping_rationale", F.lit("")))
        .alias("mapping_rationale"),
        F.lit("PENDING").alias("review_status"),
        F.lit("").alias("review_notes"),
        F.coalesce("n_relationships", F.lit(0)).alias("n_relationships"),
    )


def handbook_only(terms: DataFrame, entities: DataFrame, mappings: DataFrame) -> DataFrame:
    """Terms that neither name an entity nor map to one."""
    names = entities.select(normalize(F.col("entity_name")).alias("_name")).distinct()
    mapped = mappings.where(F.lower("mapped_entity") != "not mapped").where("mapped_entity <> ''")
    return (
        terms.withColumn("_key", normalize(F.col("term")))
        .join(names, F.col("_key") == F.col("_name"), "left_anti")
        .join(mapped.select(F.col("term_lower").alias("_t")).distinct(), F.lower("term") == F.col("_t"), "left_anti")
        .drop("_key")
    )


def handbook_only_records(candidates: DataFrame, inferred: DataFrame, context: DataFrame) -> DataFrame:
    """Catalog rows of HANDBOOK_ONLY terms with the inferred place in the taxonomy.

    ``inferred`` has (term_lower, entity_domain, entity_subgroup, inference_tier,
    inference_confidence, inference_reasoning, alternative_domain, review_status).
    """
    rows = candidates.withColumn("term_lower", F.lower("term")).join(inferred, "term_lower", "left")
    rows = rows.withColumn("entity_key", normalize(F.col("term"))).join(
        context.drop("formal_definition"), "entity_key", "left"
    )
    or_else = lambda c, v, name=None: F.coalesce(F.col(c), F.lit(v)).alias(name or c)
    others = [or_else(c, "") for c in CONTEXT if c != "formal_definition"]
    empty = [F.lit("").alias(c) for c in ("fact_sheet_id", "domain_fact_sheet_id", "subgroup_fact_sheet_id")]
    return rows.select(
        *empty,
        F.col("term").alias("entity_name"),
        or_else("entity_domain", "unknown", "domain"),
        or_else("entity_subgroup", "", "subgroup"),
        F.lit("HANDBOOK_ONLY").alias("source"),
        F.lit("Not documented in LeanIX — candidate for conceptual model addition").alias("leanix_description"),
        F.col("definition").alias("formal_definition"),
        *others,
        F.col("term").alias("handbook_term"),
        F.lit("low").alias("mapping_confidence"),
        F.lit("Discovered in Handbook but not mapped to conceptual model").alias("mapping_rationale"),
        F.lit(True).alias("inferred"),
        or_else("inference_tier", "unknown"),
        or_else("inference_confidence", "low"),
        or_else("inference_reasoning", "LLM inference failed"),
        or_else("alternative_domain", ""),
        or_else("review_status", "NEEDS_CLARIFICATION"),
        F.lit("Handbook term awaiting SME review for model inclusion").alias("review_notes"),
        F.lit(0).cast("bigint").alias("n_relationships"),
    )


def catalog_summary(catalog: DataFrame) -> DataFrame:
    """(metric, value, n): counts by source and review status, definitions and governance found."""
    facts = F.array(
        F.struct(F.lit("source").alias("metric"), F.col("source").alias("value")),
        F.struct(F.lit("review_status").alias("metric"), F.col("review_status").alias("value")),
        F.struct(
            F.lit("definition").alias("metric"),
            F.when(real_definition(F.col("formal_definition")), F.lit("real")).otherwise(F.lit("none")).alias("value"),
        ),
        F.struct(
            F.lit("governance").alias("metric"),
            F.when(real_governance(F.col("governance_rules")), F.lit("real")).otherwise(F.lit("none")).alias("value"),
        ),
    )
    return catalog.select(F.explode(facts).alias("f")).groupBy("f.metric", "f.value").agg(F.count(F.lit(1)).alias("n"))


def taxonomy(entities: DataFrame, names_per_group: int = 10) -> DataFrame:
    """(domain, subgroup, names): the first names of each subgroup in order, for a prompt."""
    first = top_k(
        entities.where("domain <> ''").select(
            "domain",
            F.when(F.col("subgroup") == "", F.lit("entities")).otherwise(F.col("subgroup")).alias("subgroup"),
            "entity_name",
        ),
        ["domain", "subgroup"],
        names_per_group,
        [F.col("entity_name")],
    )
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity_name"))), lambda s: s.entity_name)
    return first.groupBy("domain", "subgroup").agg(names.alias("names"))


def taxonomy_json(entities: DataFrame) -> DataFrame:
    """(domain, json): subgroup -> names. One row per domain; names are capped, subgroups are the model's."""
    per_group = taxonomy(entities)
    entries = F.array_sort(F.collect_list(F.struct("subgroup", "names")))
    return per_group.groupBy("domain").agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def hierarchy(catalog: DataFrame, entities: DataFrame, inventory: DataFrame) -> DataFrame:
    """Catalog rows placed in the tree: domain, branch, subtype, both containers' ids and descriptions.

    ``branch`` is handbook_only, subtypes or entities. Container data come from
    the first model row of the domain or subtype.
    """
    model = entities.withColumn("domain", F.upper("domain"))
    inv = inventory.select("id", F.coalesce("description", F.lit("")).alias("description"))

    def containers(keys: list[str], fsid: str, prefix: str) -> DataFrame:
        first = keep_first(model.where(F.col(keys[-1]) != "").select(*keys, "ord", fsid), keys, ["ord"]).drop("ord")
        joined = first.join(inv, F.col(fsid) == F.col("id"), "left")
        return joined.select(
            *keys, F.col(fsid).alias(f"{prefix}_id"), F.coalesce("description", F.lit("")).alias(f"{prefix}_description")
        )

    domains = containers(["domain"], "domain_fact_sheet_id", "domain")
    subtypes = containers(["domain", "subgroup"], "subgroup_fact_sheet_id", "subtype")
    branch = (
        F.when(F.col("source") == "HANDBOOK_ONLY", F.lit("handbook_only"))
        .when(F.col("subgroup") != "", F.lit("subtypes"))
        .otherwise(F.lit("entities"))
    )
    rows = catalog.drop("domain_fact_sheet_id", "subgroup_fact_sheet_id").withColumn("domain", F.upper("domain"))
    rows = rows.withColumn("branch", branch).join(small_side(domains), "domain", "left")
    rows = rows.join(small_side(subtypes), ["domain", "subgroup"], "left")
    fill = ("domain_id", "domain_description", "subtype_id", "subtype_description")
    return rows.select(
        *[c for c in rows.columns if c not in fill], *[F.coalesce(c, F.lit("")).alias(c) for c in fill]
    )


def hierarchy_counts(tree: DataFrame) -> DataFrame:
    return tree.groupBy("domain", "branch", "subgroup").agg(F.count(F.lit(1)).alias("n"))


PAGE = (
    "domain string, domain_id string, domain_description string, branch string, subgroup string, subtype_id string, "
    "subtype_description string, first string, n bigint, entities string"
)


def nested_pages(tree: DataFrame, page_rows: int | None = None) -> DataFrame:
    """(domain, its id and description, branch, subgroup, its id and description, first, n, entities): the nested document in pages.

    Rows are dealt by ranges of their place in the tree and of their own content, so a subtype of any
    size, and a name with any number of copies, lie over as many tasks as they take. A task walks its
    sorted rows and closes a page after ``page_rows`` entities or where the subtype ends; ``entities``
    is a JSON array, ``first`` the name it starts with. The pages of a subtype together hold all of it.
    """
    limit = PAGE_ROWS if page_rows is None else page_rows
    path = ["domain", "domain_id", "domain_description", "branch", "subgroup", "subtype_id", "subtype_description"]
    record = F.to_json(F.struct(*[c for c in tree.columns if c not in path]))
    rows = tree.select(*path, F.coalesce("entity_name", F.lit("")).alias("entity_name"), record.alias("record"))
    order = ["domain", "branch", "subgroup", "domain_id", "subtype_id", "domain_description", "subtype_description", "entity_name", "record"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PAGE.split(", ")]
        place, page = None, []

        def closed() -> pa.RecordBatch:
            entities = "[" + ",".join(record for _, record in page) + "]"
            values = [*place, page[0][0], len(page), entities]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], pa.int64() if n == "n" else pa.string()) for n, v in zip(names, values)], names=names)

        for batch in batches:
            for *here, name, record in zip(*(c.to_pylist() for c in batch.columns)):
                if page and (here != place or len(page) == limit):
                    yield closed()
                    page = []
                place = here
                page.append((name, record))
        if page:
            yield closed()

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(walk, PAGE)


def page_lines(pages: DataFrame) -> DataFrame:
    """(value): one JSON document a page, the entities inside it as objects."""
    head = F.to_json(F.struct(*[c for c in pages.columns if c != "entities"]))
    return pages.select(F.concat(F.regexp_replace(head, r"\}\z", ""), F.lit(',"entities":'), "entities", F.lit("}")).alias("value"))


def member_samples(entities: DataFrame, size: int = 8) -> DataFrame:
    """(domain, subgroup, n, sample): sorted member names, cut after ``size`` with an ellipsis."""
    counts = entities.groupBy("domain", "subgroup").agg(F.count(F.lit(1)).alias("n"))
    first = top_k(entities.select("domain", "subgroup", "entity_name"), ["domain", "subgroup"], size, [F.col("entity_name")])
    joined = first.groupBy("domain", "subgroup").agg(
        F.array_join(F.array_sort(F.collect_list("entity_name")), ", ").alias("names")
    )
    cut = F.when(F.col("n") > size, F.concat("names", F.lit("..."))).otherwise(F.col("names"))
    return counts.join(joined, ["domain", "subgroup"]).select("domain", "subgroup", "n", cut.alias("sample"))


def select_entities(entities: DataFrame, domain: str | None = None, names: list[str] | None = None) -> DataFrame:
    """Domain filter (case ignored) and name filter (normalised)."""
    out = entities
    if domain:
        out = out.where(F.upper("domain") == domain.upper())
    if names:
        out = out.where(normalize(F.col("entity_name")).isin([" ".join(n.lower().split()) for n in names]))
    return out


def missing_names(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted names that no entity carries."""
    key = lambda df: df.select(normalize(F.col("entity_name")).alias("name"))
    return key(wanted).subtract(key(entities))


def remaining(items: DataFrame, done: DataFrame, key: str | list[str]) -> DataFrame:
    """Items without a finished row: the resume step of every batch product."""
    keys = [key] if isinstance(key, str) else key
    return items.join(done.select(*keys).distinct(), keys, "left_anti")
