"""Iterative retrieval in rounds: every round decides and acts for all open entities at once.

A round is a batch of joins over the entities that are not done. What an entity has seen and
tried is carried from round to round in columns: its observations, the queries it retrieved
by and the sets of terms it scanned for. A policy reads them and says what to do next.

Evidence is rows (entity, iteration, place, chunk), never a text in a row; texts are joined
where they are read, in a tree with a budget. What a round found is summed up per entity and
written before the next one starts; its rows are put in order only for a reader of evidence.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmosaic.functions import parse
from docmosaic.functions.predicates import boilerplate, quality_gate
from docmosaic.functions.text import collapse
from docmosaic.operators import keyword, ranking
from docmosaic.operators.inverted import InvertedIndex
from docmosaic.plans.answering import extract, fitted_texts, reduce_texts
from docmosaic.session import materialize, small_side

MIN_CONTENT = 100
MAX_ITERATIONS = 5
ALIASES = 3
PREVIEW = 200
#: Characters of evidence that an answering step is given: the context window of a model of the shipped size.
BUDGET = 4 * 32768

# A policy adds a column ``said`` (an action in text form) to the state: (entity_id, name, aliases,
# iteration, observations, tried_queries, tried_terms, substantive, tried_keyword).
Policy = Callable[[DataFrame], DataFrame]


@dataclass
class Corpus:
    """The chunks (collection, chunk_id, text), their index, and what rounds ask of a chunk, written once."""

    chunks: DataFrame
    given: InvertedIndex | None = None

    @cached_property
    def index(self) -> InvertedIndex:
        return self.given or InvertedIndex(self.chunks)

    @cached_property
    def facts(self) -> DataFrame:
        """(collection, chunk_id, n_chars, plain, digest, preview)"""
        body = collapse(F.coalesce("text", F.lit("")))
        return materialize(self.chunks.select(
            "collection", "chunk_id", F.length(body).cast("bigint").alias("n_chars"), (~boilerplate(body)).alias("plain"),
            F.sha2(body, 256).alias("digest"), F.left(body, F.lit(PREVIEW)).alias("preview")), "chunk-facts")


def always_done(state: DataFrame) -> DataFrame:
    """Offline policy: stop after the first look; the guard below still asks for one keyword scan."""
    return state.withColumn("said", F.lit("DONE"))


def decide(state: DataFrame, policy: Policy = always_done) -> DataFrame:
    """(entity_id, kind, query, sections, terms, fresh): what the policy says.

    DONE without content and without a keyword scan becomes KEYWORD. A scan without terms
    takes the first aliases, or the name; one whose set of terms was tried is not ``fresh``.
    """
    acts = policy(state).withColumn("act", parse.action(F.col("said")))
    guarded = (F.col("act.kind") == "DONE") & ~F.col("substantive") & ~F.col("tried_keyword")
    kind = F.when(guarded, F.lit("KEYWORD")).otherwise(F.col("act.kind"))
    own = F.when(F.size("aliases") > 0, F.slice("aliases", 1, ALIASES)).otherwise(F.array("name"))
    terms = F.when(kind == "KEYWORD", F.when(F.size("act.terms") > 0, F.col("act.terms")).otherwise(own)).otherwise(F.col("act.terms"))
    return acts.select(
        "entity_id", kind.alias("kind"), F.col("act.query").alias("query"), F.col("act.sections").alias("sections"), terms.alias("terms"),
        ((kind != "KEYWORD") | ~F.array_contains("tried_terms", _set(terms))).alias("fresh"))


def _set(terms: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(terms, F.lower)))


def _placed(rows: DataFrame, depth: int | None) -> DataFrame:
    """(entity_id, place, collection, chunk_id, score) from (entity_id, collection, chunk_id, score), best first."""
    if depth is not None:
        rows = ranking.top_k(rows, ["entity_id"], depth, ranking.score_order())
    else:
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("entity_id").orderBy(*ranking.score_order())))
    return rows.select("entity_id", (F.col("rank") - 1).alias("place"), "collection", "chunk_id", "score")


def _retrieved(corpus: Corpus, questions: DataFrame, depth: int | None, sections: DataFrame | None) -> DataFrame:
    """(entity_id, collection, chunk_id, score): what ``retrieve`` puts in order."""
    # dealt by the chunk, as the facts of chunks are when they are joined
    scored = corpus.index.scores(questions, depth).repartition("collection", "chunk_id")
    scored = scored.groupBy("entity_id", "collection", "chunk_id").agg(F.max("score").alias("score"))
    if sections is None:
        return scored
    kept = scored.join(small_side(sections.select("entity_id", "collection").distinct()), ["entity_id", "collection"], "left_semi")
    return kept.unionByName(scored.join(small_side(sections.select("entity_id").distinct()), "entity_id", "left_anti"))


def retrieve(corpus: Corpus, questions: DataFrame, depth: int | None = None, sections: DataFrame | None = None) -> DataFrame:
    """Evidence rows of each question (entity_id, pos, variant): its chunks by score, ``depth`` of them or all.

    ``sections`` (entity_id, collection) keep an entity to those collections; entities without any there look everywhere.
    """
    return _placed(_retrieved(corpus, questions, depth, sections), depth)


def _scanned(corpus: Corpus, terms: DataFrame) -> DataFrame:
    """(entity_id, collection, chunk_id, score): what ``scan`` puts in order."""
    hits = keyword.entity_hits(corpus.chunks, terms, with_text=False).select("entity_id", "collection", "chunk_id").distinct()
    hits = hits.join(corpus.facts.select("collection", "chunk_id", "digest"), ["collection", "chunk_id"])
    first = hits.groupBy("entity_id", "digest").agg(F.min(F.struct("chunk_id", "collection")).alias("f"))
    scored = corpus.index.scores(terms).groupBy("entity_id", "chunk_id").agg(F.max("score").alias("score"))
    found = first.select("entity_id", "f.collection", "f.chunk_id").join(scored, ["entity_id", "chunk_id"], "left")
    return found.withColumn("score", F.coalesce("score", F.lit(0.0)))


def scan(corpus: Corpus, terms: DataFrame, depth: int | None = None) -> DataFrame:
    """Evidence rows of chunks that hold a term (entity_id, pos, variant) verbatim: by score and then id, ``depth`` of them or all.

    Of chunks with one text the first counts. A hit inside a longer word scores 0.
    """
    return _placed(_scanned(corpus, terms), depth)


def texts(evidence: DataFrame, chunks: DataFrame, budget: int | None = BUDGET) -> DataFrame:
    """(entity_id, evidence): the texts of evidence rows (entity_id, place, chunk_id), in order, within ``budget`` characters."""
    bodies = chunks.select("chunk_id", collapse(F.coalesce("text", F.lit(""))).alias("text"))
    if budget is not None:
        return fitted_texts(evidence, bodies, ["entity_id"], budget).withColumnRenamed("text", "evidence")
    most = (evidence.agg(F.max("place")).first()[0] or 0) + 1
    return reduce_texts(evidence.join(bodies, "chunk_id"), ["entity_id"], most, extract(budget)).withColumnRenamed("text", "evidence")


def _state(entities: DataFrame, trace: DataFrame, iteration: int) -> DataFrame:
    """The state of ``entities`` (entity_id, name, aliases) after the rounds of ``trace``, whose number bounds the arrays."""
    seen = F.struct("iteration", F.col("action").alias("kind"), "query", "terms", "sections", "n_chunks", "n_chars", "has_content", "preview")
    is_ = lambda kind: F.col("action") == kind
    facts = trace.where("observed").groupBy("entity_id").agg(
        F.array_sort(F.collect_list(seen)).alias("observations"),
        F.collect_set(F.when(is_("RETRIEVE"), F.col("query"))).alias("tried_queries"),
        F.collect_set(F.when(is_("KEYWORD"), _set(F.col("terms")))).alias("tried_terms"),
        F.max("solid").alias("substantive"), F.max(is_("KEYWORD")).alias("tried_keyword"))
    return entities.join(facts, "entity_id").withColumn("iteration", F.lit(iteration))


def observations_summary(state: DataFrame) -> Column:
    """A line for every observation: what was asked and what came of it."""
    def line(o: Column, i: Column) -> Column:
        head = F.format_string("  Observation %d: ", i + 1)
        looked = F.concat(
            F.lit("RAG retrieve — query="), o["query"], F.lit(" sections=["), F.array_join(o["sections"], ", "), F.lit("] → "),
            F.when(o["has_content"], F.lit("found content")).otherwise(F.lit("sparse/empty")), F.lit("\n    Preview: "), o["preview"])
        scanned = F.concat(
            F.lit("Keyword scan — terms=["), F.array_join(o["terms"], ", "), F.lit("] → "),
            F.when(o["has_content"], F.format_string("%d chunks found", o["n_chunks"])).otherwise(F.lit("no matches")))
        return F.concat(head, F.when(o["kind"] == "RETRIEVE", looked).otherwise(scanned))

    lines = F.array_join(F.transform(state["observations"], line), "\n")
    return F.when(F.size(state["observations"]) > 0, lines).otherwise(F.lit("  (none yet)"))


def tried_summary(state: DataFrame) -> Column:
    """A line for every query and every set of terms that was tried."""
    asked = F.transform(F.array_sort(state["tried_queries"]), lambda q: F.concat(F.lit("  RAG query: "), q))
    scanned = F.transform(F.array_sort(F.transform(state["tried_terms"], lambda t: F.array_join(t, ", "))),
                          lambda t: F.concat(F.lit("  Keyword scan: ["), t, F.lit("]")))
    lines = F.concat(asked, scanned)
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit("  (none yet)"))


def run(
    corpus: Corpus,
    entities: DataFrame,
    variants: DataFrame,
    policy: Policy = always_done,
    max_iterations: int = MAX_ITERATIONS,
    depth: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(trace, evidence) of the rounds until every entity is done.

    ``entities`` has (entity_id, name); ``variants`` (entity_id, pos, variant) with the first
    question at 0 and aliases after it. The first action is always a retrieval by that
    question. The trace has (entity_id, iteration, action, query, terms, sections, n_chunks,
    n_chars, has_content, ...), the evidence (entity_id, iteration, place, collection,
    chunk_id, score). What a retrieval found counts as content beyond ``MIN_CONTENT``
    characters, any keyword hit does.
    """
    names = variants.where("pos > 0").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("pos", "variant"))).alias("a"))
    known = entities.join(names, "entity_id", "left").select(
        "entity_id", "name", F.coalesce(F.transform("a", lambda x: x["variant"]), F.array().cast("array<string>")).alias("aliases"))
    known = open_ = materialize(known, "entities")
    none = F.array().cast("array<string>")
    actions = variants.where("pos = 0").join(known.select("entity_id"), "entity_id").select(
        "entity_id", F.lit("RETRIEVE").alias("kind"), F.col("variant").alias("query"), none.alias("sections"), none.alias("terms"), F.lit(True).alias("fresh"))
    trace = evidence = None
    for iteration in range(1, max_iterations + 1):
        ask = actions.where("kind = 'RETRIEVE'")
        look = actions.where("kind = 'KEYWORD' and fresh")
        parts = []
        if iteration == 1 or not ask.isEmpty():
            chosen = ask.select("entity_id", F.explode("sections").alias("collection"))
            parts.append(_retrieved(corpus, ask.select("entity_id", F.lit(0).alias("pos"), F.col("query").alias("variant")), depth,
                                    None if iteration == 1 or chosen.isEmpty() else chosen))
        if iteration > 1 and not look.isEmpty():
            parts.append(materialize(_scanned(corpus, look.select("entity_id", F.posexplode("terms").alias("pos", "variant"))), "scanned"))
        step = actions.withColumn("iteration", F.lit(iteration))
        if parts:
            parts = [p if depth is None else materialize(_placed(p, depth), "evidence") for p in parts]
            seen = None
            for part in parts:
                # rows meet the facts of their chunks and are summed up there; their order is for those who read them
                order = F.struct((-F.round("score", 9)).alias("s"), "chunk_id")
                met = part.join(corpus.facts.drop("digest"), ["collection", "chunk_id"]).select(
                    "entity_id", "collection", "n_chars", "plain", "preview", order.alias("order"))
                seen = met if seen is None else seen.unionByName(met)
                placed = (_placed(part, depth) if depth is None else part).withColumn("iteration", F.lit(iteration))
                evidence = placed if evidence is None else evidence.unionByName(placed)
            facts = seen.groupBy("entity_id").agg(
                F.count(F.lit(1)).alias("n_chunks"), F.sum("n_chars").alias("n_chars"), F.max("plain").alias("plain"),
                F.min_by("preview", "order").alias("preview"), F.array_sort(F.collect_set("collection")).alias("found_in"))
            step = step.join(facts, "entity_id", "left")
        else:
            step = step.selectExpr("*", "0L as n_chunks", "0L as n_chars", "false as plain", "'' as preview", "cast(array() as array<string>) as found_in")
        # joined texts have a blank line between two of them
        chars = F.coalesce(F.col("n_chars") + 2 * (F.col("n_chunks") - 1), F.lit(0))
        content = F.when(F.col("kind") == "KEYWORD", F.coalesce("n_chunks", F.lit(0)) > 0).otherwise(chars > MIN_CONTENT)
        # a retrieval without chosen sections is one in those where it found something
        sections = F.when(F.size("sections") > 0, F.col("sections")).otherwise(F.coalesce("found_in", none))
        step = materialize(step.select(
            "entity_id", "iteration", F.col("kind").alias("action"), "query", "terms",
            F.when(F.col("kind") == "RETRIEVE", sections).otherwise(none).alias("sections"),
            F.coalesce("n_chunks", F.lit(0)).cast("bigint").alias("n_chunks"), F.greatest(chars, F.lit(0)).cast("bigint").alias("n_chars"),
            content.alias("has_content"), (content & ((F.col("kind") == "KEYWORD") | F.coalesce("plain", F.lit(False)))).alias("solid"),
            F.coalesce("preview", F.lit("")).alias("preview"), ((F.col("kind") != "DONE") & F.col("fresh")).alias("observed")), "observations")
        trace = step if trace is None else trace.unionByName(step)
        open_ = open_.join(step.where("action = 'DONE'").select("entity_id"), "entity_id", "left_anti")
        if iteration == max_iterations:
            break
        actions = materialize(decide(_state(open_, trace, iteration), policy), "actions")
        if actions.isEmpty():
            break
    return trace, evidence


def gathered(trace: DataFrame, evidence: DataFrame) -> DataFrame:
    """(entity_id, place, chunk_id): the evidence of all rounds that found content, a chunk where it came first."""
    solid = evidence.join(trace.where("has_content").select("entity_id", "iteration"), ["entity_id", "iteration"], "left_semi")
    first = solid.groupBy("entity_id", "chunk_id").agg(F.min(F.struct("iteration", F.col("place").alias("p"))).alias("f"))
    order = Window.partitionBy("entity_id").orderBy("f.iteration", "f.p", "chunk_id")
    return first.select("entity_id", (F.row_number().over(order) - 1).alias("place"), "chunk_id")


def gated(answers: DataFrame, fallback: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Fast answers that pass the quality gate, and the fallback's for those that do not.

    ``answers`` has (entity_id, response); the fallback gets only the failing
    ids and returns the same columns.
    """
    judged = materialize(answers.withColumn("gate", quality_gate(F.col("response"))), "gate")
    passed = judged.where("gate.passed").select("entity_id", "response", F.lit("fast").alias("path"))
    failing = judged.where("not gate.passed").select("entity_id")
    slow = fallback(failing).select("entity_id", "response", F.lit("agentic").alias("path"))
    return passed.unionByName(slow)


def average_iterations(trace: DataFrame) -> DataFrame:
    """(entities, avg_iterations): rounds used per entity, 0 without entities."""
    rounds = trace.groupBy("entity_id").agg(F.max("iteration").alias("n"))
    return rounds.agg(
        F.count(F.lit(1)).alias("entities"),
        (F.coalesce(F.sum("n"), F.lit(0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("avg_iterations"),
    )
