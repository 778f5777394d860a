"""Answers from several collections: candidates of each, then one pooled answer or one per collection.

A question comes in one or more phrasings (entity_id, pos, variant), where entity_id is the
question. In every collection each phrasing gives a list by vectors and one by words; the
lists, of whatever lengths, are fused by reciprocal rank inside the collection. A collection
small enough comes whole instead. Pooled, the candidates of all collections are reranked
together; iteratively, each collection answers on its own, and the answers are put together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmosaic.functions.text import collapse
from docmosaic.operators import cross_encoder, ranking, vector
from docmosaic.operators.inverted import InvertedIndex
from docmosaic.plans.retrieval import QuerySettings, extractive_answer, rerank
from docmosaic.session import looked_up, materialize, small_side

#: Texts put together in one step, and characters an extractive step keeps of them.
FAN = 8
BUDGET = 8000
NOT_DOCUMENTED = "not documented"

#: Texts of one step, in order, to one text.
Combine = Callable[[Column], Column]


def hybrid_per_collection(
    index: InvertedIndex, vectors: DataFrame, phrasings: DataFrame, phrasing_vectors: DataFrame | None, k: int, hybrid: bool = True
) -> DataFrame:
    """(query_id, collection, chunk_id, score, rank): the best ``k`` chunks of every collection for each question.

    ``vectors`` has (collection, chunk_id, embedding) and need not cover all chunks,
    ``phrasing_vectors`` (entity_id, pos, embedding) need not cover all phrasings; the word
    lists cover both in full.
    """
    keys = ["query_id", "collection", "chunk_id"]
    lists = []
    if phrasing_vectors is not None:
        asked = phrasing_vectors.withColumnRenamed("entity_id", "query_id").withColumn("pos", F.col("pos").cast("int"))
        lists.append(vector.nearest_in_groups(vectors, asked, k).select(*keys, "rank"))
    if hybrid or phrasing_vectors is None:
        words = index.scores(phrasings, k).withColumnRenamed("entity_id", "query_id")
        lists.append(ranking.top_k(words, ["query_id", "pos", "collection"], k, ranking.score_order()).select(*keys, "rank"))
    fused = ranking.reciprocal_rank_fusion(lists, keys)
    return ranking.top_k(fused, ["query_id", "collection"], k, ranking.score_order())


def candidates(
    index: InvertedIndex, chunks: DataFrame, vectors: DataFrame, phrasings: DataFrame, phrasing_vectors: DataFrame | None,
    settings: QuerySettings = QuerySettings(),
) -> DataFrame:
    """(query_id, collection, chunk_id, score, rank) per collection; of collections that come whole all chunks, at score 1."""
    n = index.stats.count()
    k = ranking.per_collection_k(settings.retrieve_k, n) if settings.use_reranker else max(settings.similarity_top_k, 5)
    found = hybrid_per_collection(index, vectors, phrasings, phrasing_vectors, k, settings.use_hybrid_search)
    if settings.full_context_max_chunks <= 0:
        return found
    whole = index.stats.where(F.col("n_chunks") <= settings.full_context_max_chunks).select("collection")
    # every question takes all of a small collection: one row of its chunk ids per collection, as many as the setting says
    listed = chunks.join(whole, "collection", "left_semi").groupBy("collection").agg(F.sort_array(F.collect_list("chunk_id")).alias("ids"))
    asked = phrasings.select(F.col("entity_id").alias("query_id")).distinct()
    names = whole.agg(F.collect_set("collection")).scalar()
    every = asked.select("query_id", F.explode(names).alias("collection")).join(small_side(listed), "collection")
    every = every.select("query_id", "collection", F.posexplode("ids").alias("place", "chunk_id"))
    return found.join(whole, "collection", "left_anti").unionByName(every.select(
        "query_id", "collection", "chunk_id", F.lit(1.0).alias("score"), (F.col("place") + 1).alias("rank")))


def pooled_context(
    found: DataFrame, chunks: DataFrame, vectors: DataFrame, questions: DataFrame, settings: QuerySettings = QuerySettings(),
    load=cross_encoder.offline,
) -> DataFrame:
    """(query_id, chunk_id, score, rank, position): the candidates of all collections as one context.

    ``questions`` has (query_id, question, embedding); an embedding may be null, and the
    candidates of its question keep the order of their fused scores.
    """
    pool = found.select("query_id", "chunk_id", "score")
    if not settings.use_reranker:
        best = ranking.top_k(pool, ["query_id"], settings.similarity_top_k, ranking.score_order())
        return best.withColumn("position", (F.col("rank") - 1).cast("bigint"))
    pool = materialize(pool, "found")
    pool = materialize(pool.join(looked_up(vectors.select("chunk_id", "embedding"), pool, "chunk_id"), "chunk_id", "left"), "pool")
    if settings.reranker_strategy == "cross-encoder":
        texts = pool.join(looked_up(chunks.select("chunk_id", "text"), pool, "chunk_id"), "chunk_id")
        best = cross_encoder.rerank(texts, questions, settings.rerank_k, load).drop("ranker")
    else:
        able = pool.where("embedding is not null").join(questions.where("embedding is not null").select("query_id"), "query_id", "left_semi")
        near = rerank(able, questions.select("query_id", "embedding"), QuerySettings(
            **{**settings.__dict__, "use_lost_in_middle": False})).select("query_id", "chunk_id", "score", "rank")
        # what has no vector follows, by its fused score
        seen = able.select("query_id", "chunk_id")
        rest = pool.select("query_id", "chunk_id", "score").join(seen, ["query_id", "chunk_id"], "left_anti")
        rest = ranking.top_k(rest, ["query_id"], settings.rerank_k, ranking.score_order())
        both = near.withColumn("late", F.lit(0)).unionByName(rest.withColumn("late", F.lit(1)))
        order = Window.partitionBy("query_id").orderBy("late", "rank")
        best = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.rerank_k).drop("late")
    best = best.select("query_id", "chunk_id", "score", "rank")
    if settings.use_lost_in_middle:
        return ranking.lost_in_middle(best, ["query_id"])
    return best.withColumn("position", (F.col("rank") - 1).cast("bigint"))


def extract(budget: int | None = BUDGET) -> Combine:
    """Offline step: the texts after each other. Beyond ``budget`` characters each keeps an equal share of it."""

    def run(texts: Column) -> Column:
        joined = F.array_join(texts, "\n\n")
        if budget is None:
            return joined
        share = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.size(texts))).cast("int") - 2)
        return F.when(F.length(joined) <= budget, joined).otherwise(
            F.array_join(F.transform(texts, lambda t: F.left(t, share)), "\n\n"))

    return run


def reduce_texts(rows: DataFrame, keys: list[str], most: int, combine: Combine, fan: int = FAN) -> DataFrame:
    """(keys..., text): the texts of each group, by ``place`` (from 0, below ``most``), combined in a tree.

    ``fan`` neighbours become one text, then ``fan`` of those, until one is left. A row so
    never holds more than ``fan`` texts, each a result of ``combine`` after the first step.
    """
    if fan < 2:
        raise ValueError("a step must put two texts together or more")
    rows = rows.select(*keys, "place", "text")
    steps = 0
    while steps == 0 or fan**steps < most:
        texts = F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda s: s["text"])
        rows = rows.groupBy(*keys, F.floor(F.col("place") / fan).alias("place")).agg(texts.alias("texts"))
        rows = rows.select(*keys, "place", combine(F.col("texts")).alias("text"))
        steps += 1
    return rows.select(*keys, "text")


def fitted_texts(rows: DataFrame, bodies: DataFrame, keys: list[str], budget: int = BUDGET, fan: int = FAN) -> DataFrame:
    """(keys..., text): what ``reduce_texts`` makes of the texts with ``extract(budget)``, without moving texts that it drops.

    ``rows`` has (keys..., place, chunk_id), ``bodies`` (chunk_id, text). The tree is built of
    lengths first; from its root down, each text is then told how many of its first
    characters are left in the result, and only texts with a share are read.
    """
    if fan < 2:
        raise ValueError("a step must put two texts together or more")
    marked = bodies.select("chunk_id", F.xxhash64("text").alias("mark"), F.length("text").alias("n"))
    step = rows.select(*keys, "place", "chunk_id").join(marked, "chunk_id")
    width = lambda x, n, share: F.when(n <= budget, x["n"]).otherwise(F.least(x["n"], share))
    total = lambda kids, size: F.aggregate(kids, F.lit(0), lambda a, x: a + size(x)) + 2 * (F.size(kids) - 1)
    levels = []
    while True:
        kid = F.struct("place", "mark", "n", "chunk_id") if not levels else F.struct("place", "n")
        step = step.groupBy(*keys, F.floor(F.col("place") / fan).alias("place")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        step = step.withColumn("joined", total(F.col("kids"), lambda x: x["n"]))
        step = step.withColumn("share", F.greatest(F.lit(1), F.floor(F.lit(budget) / F.size("kids")).cast("int") - 2))
        step = step.withColumn("n", total(F.col("kids"), lambda x: width(x, F.col("joined"), F.col("share"))))
        step = materialize(step, "lengths")
        levels.append(step)
        if not step.agg(F.max("place")).first()[0]:
            break
    # a child begins behind its elder ones; of those that begin within its parent's share, the last may get a part only
    wanted = levels[-1].select(*keys, "place", F.array(F.col("n").cast("int")).alias("needs"))
    for level in reversed(levels):
        own = lambda x: width(x, F.col("joined"), F.col("share"))
        placed = F.transform("kids", lambda x, i: F.struct(
            x.alias("kid"), own(x).cast("int").alias("width"),
            F.aggregate(F.slice("kids", F.lit(1), i), F.lit(0), lambda a, e: a + own(e) + 2).alias("begin")))
        open_ = level.drop("n").join(small_side(wanted), [*keys, "place"]).withColumn("need", F.element_at("needs", -1))
        open_ = open_.select(*keys, "needs", "need", F.explode(F.filter(placed, lambda x: x["begin"] - 2 < F.col("need"))).alias("k"))
        left = F.greatest(F.lit(0), F.least("k.width", F.col("need") - F.col("k.begin")))
        leaf = ["k.kid.mark", "k.kid.chunk_id"] if level is levels[0] else []
        wanted = materialize(open_.select(*keys, "k.kid.place", *leaf, F.concat("needs", F.array(left)).alias("needs")), "wanted")
    # copies of a chunk have one mark, and each has a row of its own in the tree
    names = wanted.select("chunk_id", F.col("mark").alias("_mark")).distinct()
    read = bodies.withColumn("mark", F.xxhash64("text")).join(
        small_side(names.withColumnRenamed("chunk_id", "_id")), (F.col("chunk_id") == F.col("_id")) & (F.col("mark") == F.col("_mark")))
    read = read.groupBy("chunk_id", "mark").agg(F.first("text").alias("text"))
    out = wanted.join(read, ["chunk_id", "mark"]).withColumn("text", F.left("text", F.element_at("needs", -1)))
    for _ in levels:
        kid = F.struct("place", "mark", "text") if "mark" in out.columns else F.struct("place", "text")
        texts = F.transform(F.sort_array(F.collect_list(kid)), lambda s: s["text"])
        upper = F.slice("needs", F.lit(1), F.size("needs") - 1)
        out = out.groupBy(*keys, F.floor(F.col("place") / fan).alias("place")).agg(texts.alias("texts"), F.first(upper).alias("needs"))
        out = out.select(*keys, "place", "needs", F.left(F.array_join("texts", "\n\n"), F.element_at("needs", -1)).alias("text"))
    return out.select(*keys, "text")


def collection_answers(found: DataFrame, chunks: DataFrame, most: int, combine: Combine | None = None, fan: int = FAN) -> DataFrame:
    """(query_id, collection, response): what each collection answers from all its candidates, best first.

    Candidates and answers that say they are not documented are left out; a collection
    with nothing else gives no answer.
    """
    combine = combine or extract()
    found = materialize(found.select("query_id", "collection", "chunk_id", "rank"), "found")
    read = looked_up(chunks.select("chunk_id", "text"), found, "chunk_id")
    # written, or the test below would be made of every chunk before those found are known
    read = materialize(read.select("chunk_id", collapse(F.coalesce("text", F.lit(""))).alias("text")), "told")
    told = found.join(read, "chunk_id")
    denies = lambda c: F.startswith(F.lower(c), F.lit(NOT_DOCUMENTED)) | (c == "")
    told = told.where(~denies(F.col("text"))).withColumn("place", F.col("rank") - 1)
    made = reduce_texts(told, ["query_id", "collection"], most, combine, fan)
    return made.where(~denies(F.col("text"))).withColumnRenamed("text", "response")


def polished(sections: DataFrame, questions: DataFrame, most: int, combine: Combine | None = None, fan: int = FAN) -> DataFrame:
    """(query_id, response, n_sections): the answers of a question's collections as one.

    One answer stays as it is; several are combined under their names. A question
    without answers is told so.
    """
    combine = combine or extract()
    order = Window.partitionBy("query_id").orderBy("collection")
    several = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    named = sections.select(
        "query_id", (F.row_number().over(order) - 1).alias("place"), several.alias("n"), "collection", "response")
    text = F.when(F.col("n") == 1, F.col("response")).otherwise(F.concat(F.lit("["), "collection", F.lit("]\n"), "response"))
    named = named.select("query_id", "place", "n", text.alias("text"))
    one = named.where("n = 1").select("query_id", "text")
    more = reduce_texts(named.where("n > 1"), ["query_id"], most, combine, fan)
    counts = sections.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sections"))
    told = one.unionByName(more).join(counts, "query_id")
    return questions.select("query_id").distinct().join(told, "query_id", "left").select(
        "query_id", F.coalesce("text", F.lit("Not documented.")).alias("response"), F.coalesce("n_sections", F.lit(0)).alias("n_sections"))


def answer(
    index: InvertedIndex, chunks: DataFrame, vectors: DataFrame, phrasings: DataFrame, phrasing_vectors: DataFrame,
    settings: QuerySettings = QuerySettings(), synthesize=extractive_answer, combine: Combine | None = None,
    iterative: bool = False, load=cross_encoder.offline,
) -> DataFrame:
    """(query_id, response, ...) of every question: pooled with its sources counted, or iterative with its sections counted.

    Its first phrasing (pos 0) is what a question is reranked by.
    """
    found = materialize(candidates(index, chunks, vectors, phrasings, phrasing_vectors, settings), "candidates")
    first = phrasings.where("pos = 0").select(F.col("entity_id").alias("query_id"), F.col("variant").alias("question"))
    questions = first.join(
        phrasing_vectors.where("pos = 0").select(F.col("entity_id").alias("query_id"), "embedding"), "query_id", "left")
    if not iterative:
        return synthesize(pooled_context(found, chunks, vectors, questions, settings, load), chunks)
    n = index.stats.count()
    k = max(ranking.per_collection_k(settings.retrieve_k, n), settings.similarity_top_k, 5, settings.full_context_max_chunks)
    return polished(collection_answers(found, chunks, k, combine), questions, n, combine)
