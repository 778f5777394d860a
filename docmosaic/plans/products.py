"""The batch products end to end, as the command line runs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmosaic.functions.embedding import Embedder, embed, hashed_words
from docmosaic.functions.parse import context_fields
from docmosaic.functions.predicates import review_status
from docmosaic.functions.text import normalize
from docmosaic.operators import chunking, keyword, matching, ranking, vector
from docmosaic.operators.inverted import InvertedIndex
from docmosaic.plans import agent, answering, catalog, coverage, retrieval
from docmosaic.session import materialize
from docmosaic.sources.progress import BATCH_ROWS, Progress

# An answering step adds ``response`` to (entity_id, entity_name, evidence). Offline it is the evidence itself.
EXTRACTIVE = lambda rows: rows.withColumn("response", F.col("evidence"))


def entity_variants(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id, pos, variant): the name first, then its variants in order. The entity's ord is its id."""
    keyed = entities.select(F.col("ord").alias("entity_id"), normalize(F.col("entity_name")).alias("base"))
    found = keyed.join(matching.alias_variants(keyed, aliases), "base")
    order = Window.partitionBy("entity_id").orderBy(F.col("is_base").desc(), "variant")
    return found.select("entity_id", (F.row_number().over(order) - 1).alias("pos"), "variant")


def contexts(
    entities: DataFrame, chunks: DataFrame, aliases: DataFrame, definitions: DataFrame, answer=EXTRACTIVE,
    depth: int | None = None, budget: int | None = agent.BUDGET,
) -> DataFrame:
    """Context fields per entity_key: evidence found, answer parsed, a verbatim definition put first.

    Retrieval and scan give their best ``depth`` chunks each as evidence, or all; the texts
    that an answer is made from keep within ``budget`` characters.
    Entities for which routing and scan find nothing get an empty context and are not asked about.
    """
    variants = materialize(entity_variants(entities, aliases), "variants")
    names = variants.where("pos = 0")
    corpus = agent.Corpus(chunks)
    looks = agent.retrieve(corpus, names, depth).withColumn("look", F.lit(0)).unionByName(
        agent.scan(corpus, variants, depth).withColumn("look", F.lit(1)))
    first = looks.groupBy("entity_id", "chunk_id").agg(F.min(F.struct("look", "place")).alias("f"))
    order = Window.partitionBy("entity_id").orderBy("f.look", "f.place")
    found = materialize(first.select("entity_id", "chunk_id", (F.row_number().over(order) - 1).alias("place")), "evidence")
    evidence = agent.texts(found, chunks, budget)
    asked = entities.select(F.col("ord").alias("entity_id"), "entity_name").join(evidence, "entity_id")
    told = answer(asked).select("entity_id", "response", *context_fields(F.col("response")))
    labelled = F.col("formal_definition") != ""
    told = told.withColumn("formal_definition", F.when(labelled, F.col("formal_definition")).otherwise(F.col("response")))
    keys = entities.select(F.col("ord").alias("entity_id"), normalize(F.col("entity_name")).alias("entity_key"))
    verbatim = matching.definition_lookup(
        keys.select(F.col("entity_key").alias("base")),
        matching.alias_variants(keys.select(F.col("entity_key").alias("base")), aliases),
        definitions.select(normalize(F.col("term")).alias("term_lower"), "definition"),
    ).select(F.col("base").alias("entity_key"), F.col("definition").alias("_verbatim"))
    rows = keys.join(told.drop("response"), "entity_id", "left").join(verbatim, "entity_key", "left")
    rows = rows.withColumn("formal_definition", F.coalesce("_verbatim", "formal_definition"))
    rows = ranking.keep_first(rows.drop("_verbatim"), ["entity_key"], ["entity_id"])
    return rows.select("entity_key", *[F.coalesce(c, F.lit("")).alias(c) for c in catalog.CONTEXT])


def agentic_contexts(
    entities: DataFrame, chunks: DataFrame, aliases: DataFrame, definitions: DataFrame, answer=EXTRACTIVE,
    policy=agent.always_done, max_iterations: int = agent.MAX_ITERATIONS, depth: int | None = None, budget: int | None = agent.BUDGET,
) -> DataFrame:
    """As ``contexts``, with the evidence gathered in rounds; ``definitions`` are left to the rounds."""
    variants = materialize(entity_variants(entities, aliases), "variants")
    names = variants.where("pos = 0").select("entity_id", F.col("variant").alias("name"))
    trace, found = agent.run(agent.Corpus(chunks), names, variants, policy, max_iterations, depth)
    evidence = agent.texts(materialize(agent.gathered(trace, found), "evidence"), chunks, budget)
    asked = entities.select(F.col("ord").alias("entity_id"), "entity_name").join(evidence, "entity_id")
    told = answer(asked).select("entity_id", *context_fields(F.col("response"), ignore_case=True))
    keys = entities.select(F.col("ord").alias("entity_id"), normalize(F.col("entity_name")).alias("entity_key"))
    rows = ranking.keep_first(keys.join(told, "entity_id", "left"), ["entity_key"], ["entity_id"])
    return rows.select("entity_key", *[F.coalesce(c, F.lit("")).alias(c) for c in catalog.CONTEXT])


def infer_domains(candidates: DataFrame, answer=None) -> DataFrame:
    """Inferred place of HANDBOOK_ONLY terms; without a model the fallback record applies.

    ``answer`` adds ``response`` (JSON somewhere in the text) to (term, definition).
    """
    from docmosaic.functions.parse import json_object

    fields = ("entity_domain", "entity_subgroup", "inference_tier", "inference_confidence", "inference_reasoning", "alternative_domain")
    schema = ", ".join(f"{f} string" for f in fields)
    rows = candidates.withColumn("response", F.lit("")) if answer is None else answer(candidates)
    parsed = rows.withColumn("j", F.from_json(json_object(F.col("response")), schema))
    status = review_status(F.coalesce("inference_tier", F.lit("unknown")), F.coalesce("inference_confidence", F.lit("low")))
    return parsed.select(F.lower("term").alias("term_lower"), "j.*").withColumn("review_status", status)


def consolidated_catalog(
    entities: DataFrame,
    inventory: DataFrame,
    chunks: DataFrame,
    relationships: DataFrame,
    aliases: DataFrame,
    forced: DataFrame,
    answer=EXTRACTIVE,
    infer=None,
    done: DataFrame | None = None,
    skip_handbook_only: bool = False,
    provider=contexts,
    progress: Progress | None = None,
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """All steps from model and corpus to catalog rows.

    Steps whose result is used more than once are written once; a resumed run
    passes the finished context rows as ``done``, or a ``progress`` that keeps the
    contexts of every ``batch_rows`` entities as they are finished. ``provider`` is where
    contexts come from: one pass (``contexts``) or rounds (``agentic_contexts``).
    """
    found = chunking.definitions(chunks, "chunk_id")
    terms = materialize(found.select(F.xxhash64(F.lower("term")).alias("ord"), "term", "definition"), "terms")
    mappings = materialize(matching.match_terms(terms, entities, aliases), "mappings")
    todo = entities
    if done is not None:
        keyed = entities.withColumn("entity_key", normalize(F.col("entity_name")))
        todo = catalog.remaining(keyed, done, "entity_key").select(*entities.columns)
    if progress is not None:
        keyed = todo.withColumn("entity_key", normalize(F.col("entity_name")))
        context = progress.run(
            keyed, "entity_key", lambda batch: provider(batch.select(*entities.columns), chunks, aliases, terms, answer), batch_rows)
    else:
        context = provider(todo, chunks, aliases, terms, answer)
    context = materialize(context if done is None else context.unionByName(done.select(*context.columns)), "contexts")
    rows = catalog.consolidate(entities, mappings, inventory, context, relationships, forced)
    if skip_handbook_only:
        return rows
    only = catalog.handbook_only(terms, entities, mappings)
    extra = catalog.handbook_only_records(only, infer_domains(only, infer), context)
    return rows.unionByName(extra, allowMissingColumns=True)


def coverage_check(entities: DataFrame, chunks: DataFrame, k: int, model: Embedder = hashed_words) -> DataFrame:
    """Coverage rows (query_id is the entity's ord): entity and domain as the question, stored vectors as the corpus."""
    # The words that complete a coverage question.
    question = F.concat_ws(
        " ", "entity_name", F.lit("FA Football Association"), "domain", F.lit("rules obligations governance handbook")
    )
    asked = entities.select(F.col("ord").alias("query_id"), embed(question, model).alias("embedding"))
    return coverage.with_verdict(coverage.scores(chunks, chunks, asked, k)).join(
        entities.select(F.col("ord").alias("query_id"), "fact_sheet_id", "entity_name", "domain"), "query_id"
    )


def ask(
    spark: SparkSession,
    question: str | list[str],
    chunks: DataFrame,
    settings: retrieval.QuerySettings = retrieval.QuerySettings(),
    model: Embedder = hashed_words,
    synthesize=retrieval.extractive_answer,
    index: InvertedIndex | None = None,
    iterative: bool = False,
) -> DataFrame:
    """The answer to one question, in one phrasing or several, over the given chunks; ``index`` is theirs if there is one."""
    listed = [question] if isinstance(question, str) else question
    asked = spark.createDataFrame([(1, k, q) for k, q in enumerate(listed)], "entity_id bigint, pos int, variant string")
    vectors = asked.select("entity_id", "pos", embed(F.col("variant"), model).alias("embedding"))
    return answering.answer(
        index or InvertedIndex(chunks), chunks, chunks, asked, vectors, settings, synthesize, iterative=iterative)


def diagnose(chunks: DataFrame, variants: DataFrame, query_vectors: DataFrame, ranker: str = "embedding", k: int = 25) -> DataFrame:
    """Ranking report of a pool by the chosen ranker: embedding, bm25 or boosted."""
    near = vector.nearest(chunks, query_vectors, retrieval.QuerySettings().retrieve_k)
    pool = near.select("query_id", "chunk_id").join(chunks.select("chunk_id", "collection", "text"), "chunk_id")
    if ranker == "bm25":
        corpus = pool.select(F.col("query_id").alias("collection"), "chunk_id", "text")
        ranked = ranking.top_k(retrieval.pool_bm25(corpus, variants), ["query_id"], 10**6, ranking.score_order())
        return ranking.report(ranked.join(pool, ["query_id", "chunk_id"]), k)
    ranked = near.join(pool, ["query_id", "chunk_id"])
    if ranker == "boosted":
        hits = keyword.entity_hits(chunks, variants).withColumnRenamed("entity_id", "query_id")
        return ranking.boosted_cutoff(ranked, ranking.keyword_flags(ranked, hits), k)
    if ranker != "embedding":
        raise ValueError(f"unknown ranker {ranker!r}")
    return ranking.report(ranked, k)
