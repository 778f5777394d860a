"""Name matching between defined terms and model entities.

Every many-to-one choice ("first entity that carries this alias") is made by an
aggregate before the join, so an alias shared by a large part of the entities
adds one row to the join and no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmosaic.functions.text import normalize
from docmosaic.operators.keyword import scan_terms
from docmosaic.operators.ranking import keep_first, top_k

NOT_MAPPED = "Not mapped"

# Abbreviations tried on a normalised name.
ABBREVIATIONS = (("association", "assoc"), ("football", "fa"))


def alias_variants(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(base, variant, is_base) for distinct normalised names.

    ``names`` has (base); ``aliases`` has (canonical, alias) and is read in both
    directions. A variant found in several ways appears once.
    """
    base = names.select("base").distinct()
    forward = base.join(aliases, F.col("base") == F.col("canonical")).select("base", F.col("alias").alias("variant"))
    backward = base.join(aliases, F.col("base") == F.col("alias")).select("base", F.col("canonical").alias("variant"))
    short = [
        base.where(F.contains("base", F.lit(long))).select(
            "base", F.replace("base", F.lit(long), F.lit(brief)).alias("variant")
        )
        for long, brief in ABBREVIATIONS
    ]
    own = base.select("base", F.col("base").alias("variant"))
    every = own.unionByName(forward).unionByName(backward)
    for s in short:
        every = every.unionByName(s)
    return every.distinct().withColumn("is_base", F.col("base") == F.col("variant"))


def aliases_of(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(base, alias): aliases, canonical name and siblings of each name, itself excluded."""
    canonical = (
        names.select("base").distinct().join(aliases, F.col("base") == F.col("alias")).select("base", "canonical")
    ).unionByName(names.select("base", F.col("base").alias("canonical")).distinct())
    siblings = canonical.join(aliases, "canonical").select("base", "alias")
    heads = canonical.select("base", F.col("canonical").alias("alias"))
    return siblings.unionByName(heads).where("alias <> base").distinct()


def entity_index(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(variant, entity columns): the entity a variant stands for.

    An own name beats an alias; then the entity that comes first (``ord``).
    """
    keyed = entities.withColumn("base", normalize(F.col("entity_name")))
    variants = alias_variants(keyed, aliases)
    every = variants.join(keyed, "base").withColumn("by_alias", F.when(F.col("is_base"), 0).otherwise(1))
    first = keep_first(
        every.select("variant", "by_alias", "ord", "entity_name", "domain", "fact_sheet_id"),
        ["variant"],
        ["by_alias", "ord"],
    )
    return first.select("variant", "entity_name", "domain", "fact_sheet_id")


def match_terms(terms: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per term: mapped entity, domain, id, confidence and rationale.

    ``terms`` has (ord, term), unique by lower case; a direct match wins over an
    alias, aliases are tried in alphabetical order.
    """
    keyed = terms.select("ord", "term", normalize(F.col("term")).alias("base"))
    tried = keyed.join(alias_variants(keyed, aliases), "base")
    found = tried.join(entity_index(entities, aliases), "variant").select(
        "ord",
        F.when(F.col("is_base"), 0).otherwise(1).alias("by_alias"),
        "variant",
        "entity_name",
        "domain",
        "fact_sheet_id",
    )
    best = keep_first(found, ["ord"], ["by_alias", "variant"]).withColumnRenamed("ord", "term_ord")
    direct = F.col("by_alias") == 0
    via = F.concat(F.lit("Alias match via '"), F.col("term"), F.lit("' → '"), F.col("entity_name"), F.lit("'"))
    mapped = F.col("entity_name").isNotNull()
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return keyed.join(best, keyed.ord == best.term_ord, "left").select(
        "ord",
        "term",
        F.lower("term").alias("term_lower"),
        F.coalesce("entity_name", F.lit(NOT_MAPPED)).alias("mapped_entity"),
        blank("domain"),
        blank("fact_sheet_id"),
        F.when(direct, F.lit("high")).when(mapped, F.lit("medium")).otherwise(F.lit("low")).alias("mapping_confidence"),
        F.when(direct, F.lit("Direct name match"))
        .when(mapped, via)
        .otherwise(F.lit("No matching entity name in conceptual model"))
        .alias("mapping_rationale"),
    )


def match_terms_by_substring(terms: DataFrame, entities: DataFrame) -> DataFrame:
    """(term, mapped_entity, domain): first entity whose normalised name contains the term.

    All terms are looked for in one pass over the names, and only the first
    entity per term leaves a task.
    """
    names = entities.select("ord", "entity_name", "domain", normalize(F.col("entity_name")).alias("name"))
    hits = scan_terms(names, terms, ["ord", "entity_name", "domain"], text="name")
    first = keep_first(hits, ["term"], ["ord"])
    return first.select("term", F.col("entity_name").alias("mapped_entity"), "domain")


def best_mapping(mappings: DataFrame) -> DataFrame:
    """(entity_key, ...): the mapping kept per entity; a direct name match beats others, then term order."""
    keyed = mappings.withColumn("entity_key", normalize(F.col("mapped_entity"))).where(
        ~F.col("entity_key").isin("", "not mapped", "none")
    )
    ranked = keyed.withColumn("indirect", F.when(F.col("term_lower") == F.col("entity_key"), 0).otherwise(1))
    cols = ["entity_key", "indirect", "ord", "term", "term_lower", "mapping_confidence", "mapping_rationale"]
    return keep_first(ranked.select(*cols), ["entity_key"], ["indirect", "ord"]).drop("indirect")


def with_forced(mapping: DataFrame, forced: DataFrame) -> DataFrame:
    """Forced entries (``entity_name``) added where the entity has no mapping yet."""
    rows = forced.select(
        normalize(F.col("entity_name")).alias("entity_key"),
        F.lit(None).cast("bigint").alias("ord"),
        normalize(F.col("entity_name")).alias("term"),
        normalize(F.col("entity_name")).alias("term_lower"),
        F.lit("medium").alias("mapping_confidence"),
        F.lit("Forced handbook match — entity present in Handbook without formal definition").alias("mapping_rationale"),
    ).dropDuplicates(["entity_key"])
    return mapping.unionByName(rows.join(mapping, "entity_key", "left_anti").select(*mapping.columns))


def definition_lookup(names: DataFrame, variants: DataFrame, definitions: DataFrame) -> DataFrame:
    """(base, term, definition): first definition found for a name, then its aliases in order.

    ``variants`` has (base, variant, is_base), ``definitions`` (term_lower, definition).
    """
    found = names.select("base").distinct().join(variants, "base").join(
        definitions, F.col("variant") == F.col("term_lower")
    )
    ranked = found.select(
        "base", F.when(F.col("is_base"), 0).otherwise(1).alias("by_alias"), "variant", "term_lower", "definition"
    )
    return keep_first(ranked, ["base"], ["by_alias", "variant"]).select("base", F.col("term_lower").alias("term"), "definition")


def topic_pairs(terms: DataFrame, first_n: int = 5) -> DataFrame:
    """(topic, entity_a, entity_b): pairs among the first terms of a topic, each pair of names once.

    ``terms`` has (ord, topic, term). At most ten pairs arise per topic.
    """
    first = top_k(terms, ["topic"], first_n, [F.col("ord")])
    packed = first.groupBy("topic").agg(
        F.min("ord").alias("topic_ord"), F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t")
    )
    pairs = F.flatten(
        F.transform(
            "t",
            lambda a: F.transform(
                F.filter("t", lambda b: b.rank > a.rank),
                lambda b: F.struct(a.rank.alias("ra"), b.rank.alias("rb"), a.term.alias("entity_a"), b.term.alias("entity_b")),
            ),
        )
    )
    rows = packed.select("topic", "topic_ord", F.explode(pairs).alias("p")).select("topic", "topic_ord", "p.*")
    low = lambda c: F.lower(F.col(c))
    key = [F.least(low("entity_a"), low("entity_b")), F.greatest(low("entity_a"), low("entity_b"))]
    return keep_first(rows, key, ["topic_ord", "ra", "rb"]).select("topic", "entity_a", "entity_b")


def undirected_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """One edge per unordered pair of names (case ignored), the first by ``order``."""
    a, b = F.lower("entity_a"), F.lower("entity_b")
    return keep_first(edges, [F.least(a, b), F.greatest(a, b)], order)


def known_endpoints(edges: DataFrame, assets: DataFrame) -> DataFrame:
    """Edges whose source and target are both known assets."""
    ids = assets.select("id").distinct()
    return edges.join(ids, F.col("source_id") == F.col("id"), "left_semi").join(
        ids, F.col("target_id") == F.col("id"), "left_semi"
    )


def enrich_edges(edges: DataFrame, assets: DataFrame) -> DataFrame:
    """Labels and domains of both endpoints. ``assets`` is unique by id, so rows are not multiplied."""
    src = assets.select(
        F.col("id").alias("source_id"), F.col("label").alias("source_entity"), F.col("domain").alias("source_domain")
    )
    dst = assets.select(
        F.col("id").alias("target_id"), F.col("label").alias("target_entity"), F.col("domain").alias("target_domain")
    )
    blank = ("source_entity", "source_domain", "target_entity", "target_domain")
    out = edges.join(src, "source_id", "left").join(dst, "target_id", "left")
    return out.select(*edges.columns, *[F.coalesce(c, F.lit("")).alias(c) for c in blank])


def equals_any(c: Column, values: list[str]) -> Column:
    """Case-insensitive membership after whitespace collapse."""
    return normalize(c).isin([" ".join(v.lower().split()) for v in values])
