"""The answer path: inverted index, lists per collection, fallback of the pair model, trees of answers."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docmosaic.operators import bm25, cross_encoder, inverted, ranking, vector
from docmosaic.operators.inverted import InvertedIndex
from docmosaic.plans import answering
from docmosaic.plans.retrieval import QuerySettings, lexical_ranking
from docmosaic.session import looked_up


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(4)
    word = lambda: f"w{int(80 ** r.random())}"
    rows = [(f"c{k % 3 if k % 2 else 0}", k * 7919, " ".join(word() for _ in range(r.randrange(1, 60)))) for k in range(400)]
    rows += [("c0", 10**9 + k, rows[5][2]) for k in range(30)] + [("c1", 6, ""), ("c2", 7, "--"), ("lone", 8, "W3 w4 é")]
    return spark.createDataFrame(rows, "collection string, chunk_id bigint, text string")


@pytest.fixture(scope="module")
def asked(spark):
    r = random.Random(9)
    rows = [(q, p, " ".join(f"w{int(80 ** r.random())}" for _ in range(n))) for q in range(6) for p, n in enumerate((12, 4, 2))]
    rows += [(7, 0, "nowhere"), (8, 0, ""), (9, 0, None), (10, 0, "w3 W3 w3")]
    return spark.createDataFrame(rows, "entity_id bigint, pos int, variant string")


def plain(df, *names):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect())


@pytest.mark.parametrize("segment, postings, reach, step", [(8192, 10**6, 64, 8), (50, 300, 7, 1)])
def test_index_scores_as_the_scan_does(corpus, asked, monkeypatch, segment, postings, reach, step):
    for name, value in (("SEGMENT", segment), ("SEGMENT_POSTINGS", postings), ("RANGE", reach), ("STEP", step)):
        monkeypatch.setattr(inverted, name, value)
    index = InvertedIndex(corpus)
    names = ("entity_id", "pos", "collection", "chunk_id", "score")
    assert plain(index.scores(asked), *names) == plain(bm25.chunk_scores(corpus, asked), *names)
    names = ("query_id", "collection", "chunk_id", "rank")
    old = lexical_ranking(corpus, asked)
    for k in (1, 7, 1000):
        assert plain(index.ranking(asked, k), *names) == plain(ranking.top_k(old, ["query_id"], k, ranking.score_order()), *names)
    each = ranking.top_k(old, ["query_id", "collection"], 4, ranking.score_order())
    assert plain(index.ranking(asked, 4, per_collection=True), *names) == plain(each, *names)
    names = ("entity_id", "collection", "score", "winning_variant")
    assert plain(index.section_scores(asked, strict=True), *names) == plain(bm25.section_scores(corpus, asked, strict=True), *names)
    again = InvertedIndex.open(corpus.sparkSession, index.path)
    assert again.ranking(asked, 3).count() == index.ranking(asked, 3).count()


def test_index_reads_only_buckets_and_terms_asked(corpus, asked):
    index = InvertedIndex(corpus)
    found = index.postings(bm25.query_terms(asked.where("entity_id = 10")))
    assert {r.term for r in found.collect()} == {"w3"}
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [In(bucket, [" in plan or "PushedFilters: [IsNotNull(bucket), EqualTo(bucket," in plan
    counts = {(r.collection, r.term): (r.df, r.total) for r in index.terms().collect()}
    texts = [(r.collection, (r.text or "").lower()) for r in corpus.collect()]
    assert counts["c0", "w3"] == (sum("w3" in t.split() for c, t in texts if c == "c0"), sum(t.split().count("w3") for c, t in texts if c == "c0"))


def test_empty_index_and_empty_question(corpus, asked):
    nothing = corpus.sparkSession.createDataFrame([("c9", 1, None), ("c9", 2, "w3")], corpus.schema)
    assert [tuple(r)[1:3] for r in InvertedIndex(nothing).ranking(asked.where("entity_id = 10"), 5).collect()] == [("c9", 2)]
    assert InvertedIndex(corpus.where("false")).ranking(asked, 5).count() == 0
    assert InvertedIndex(corpus).ranking(asked.where("false"), 5).count() == 0
    named = corpus.selectExpr("collection", "concat('x', chunk_id) as chunk_id", "text")
    assert InvertedIndex(named).ranking(asked.where("entity_id = 10"), 5).count() == 5


def test_bounds_leave_ranges_unscored(monkeypatch):
    """The best chunk of a rare word is found without scoring what a frequent one could add elsewhere."""
    monkeypatch.setattr(inverted, "STEP", 1)
    segment = inverted._Segment()
    for k in range(2000):
        segment.add(k, "w1 w2" if k != 999 else "rareword w1")
    rows = segment.rows("c", "0-1", pa.int64()).to_pylist()
    picked = [{"asked": ["rareword", "w1"], **r} for r in rows[1:]]
    found = pa.Table.from_batches(inverted._pick(iter([pa.RecordBatch.from_pylist(picked)])))
    chunks = pa.RecordBatch.from_pylist([{**rows[0], "average": 2.0}])
    shard = inverted._Shard(chunks, found.append_column("idf", pa.array([9.0 if t == "rareword" else 0.1 for t in found.column("term").to_pylist()])))
    seen, inner = [], inverted._Shard._scored
    monkeypatch.setattr(inverted._Shard, "_scored", lambda self, at: seen.append(len(at)) or inner(self, at))
    places, _ = shard.best(["rareword", "w1"], 1)
    assert shard.chunks.take(pa.array(places)).to_pylist() == [999] and len(seen) < 4


def test_nearest_in_groups_agrees_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector, "TILE", 7)
    r = np.random.default_rng(1)
    v = [(f"c{k % 3}", k, [float(x) for x in r.integers(-2, 3, 4)]) for k in range(150)] + [("c0", 999, None)]
    q = [(k, p, [float(x) for x in r.integers(-2, 3, 4)]) for k in range(9) for p in range(2)]
    vectors = spark.createDataFrame(v, "collection string, chunk_id bigint, embedding array<float>").repartition(3)
    queries = spark.createDataFrame(q, "query_id bigint, pos int, embedding array<float>")
    unit = lambda x: np.array(x) / (np.linalg.norm(x) + 1e-9)
    want = set()
    for name, pos, e in q:
        for c in ("c0", "c1", "c2"):
            scored = sorted((-round(float(unit(e) @ unit(x)), 9), i) for d, i, x in v if d == c and x is not None)
            want |= {(name, pos, c, i, k + 1) for k, (_, i) in enumerate(scored[:6])}
    for most in (8192, 5):
        monkeypatch.setattr(vector, "GROUP_QUERIES", most)
        got = vector.nearest_in_groups(vectors, queries, 6)
        assert {(x.query_id, x.pos, x.collection, x.chunk_id, x["rank"]) for x in got.collect()} == want
    assert vector.nearest_in_groups(vectors, queries.where("false"), 6).count() == 0


def failing():
    """A model that refuses any batch with a long text, as one with a bound on its input does."""

    def model(questions, texts):
        if any(len(t) > 20 for t in texts):
            raise ValueError("too long")
        return cross_encoder.word_overlap(questions, texts)

    return model


def unloadable():
    raise OSError("no model here")


def test_failed_questions_go_to_the_embedding_ranker(spark):
    pool = [(q, q * 10 + k, f"a b{k}" if q % 2 else f"a b{k} " + "long " * (6 if k == 2 else 0), [float(k), 1.0]) for q in range(6) for k in range(4)]
    pool += [(7, 70, None, [1.0, 0.0])]
    pool = spark.createDataFrame(pool, "query_id bigint, chunk_id bigint, text string, embedding array<float>")
    questions = spark.createDataFrame([(q, "a b1", [1.0, 0.0]) for q in range(8)], "query_id bigint, question string, embedding array<float>")
    got = cross_encoder.rerank(pool, questions, 2, failing).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.ranker))
    for q in range(6):
        want = [(1, q * 10 + 1, "cross-encoder"), (2, q * 10, "cross-encoder")] if q % 2 else [
            (1, q * 10 + 3, "embedding"), (2, q * 10 + 2, "embedding")]
        assert sorted(by[q]) == want
    assert by[7] == [(1, 70, "cross-encoder")]
    assert {r.ranker for r in cross_encoder.rerank(pool, questions, 2, unloadable).collect()} == {"embedding"}
    marks = cross_encoder.score_pairs(pool.join(questions.select("query_id", "question"), "query_id"), failing, batch=3)
    assert marks.where("failed").count() == 3 and marks.where("failed and score is not null").count() == 0


def test_trees_of_texts_keep_order_and_budget(spark):
    rows = [(g, p, f"<{g}.{p}>" + "x" * 40) for g, n in (("a", 1), ("b", 23), ("c", 64)) for p in range(n)]
    rows = spark.createDataFrame(rows, "g string, place int, text string")
    whole = {r.g: r.text for r in answering.reduce_texts(rows, ["g"], 64, answering.extract(None), 4).collect()}
    assert all(whole[g] == "\n\n".join(f"<{g}.{p}>" + "x" * 40 for p in range(n)) for g, n in (("a", 1), ("b", 23), ("c", 64)))
    combine = answering.extract(100)
    short = {r.g: r.text for r in answering.reduce_texts(rows, ["g"], 64, combine, 4).collect()}
    assert set(short) == {"a", "b", "c"} and all(len(t) <= 100 for t in short.values()) and short["c"].startswith("<c.0>")
    with pytest.raises(ValueError):
        answering.reduce_texts(rows, ["g"], 64, combine, 1)


def test_answers_of_collections(spark):
    chunks = spark.createDataFrame(
        [("a", 1, "Clubs  register."), ("a", 2, "Not documented here"), ("b", 3, "not documented"), ("c", 4, None), ("d", 5, "Fees."), ("a", 6, "Late.")],
        "collection string, chunk_id bigint, text string")
    found = chunks.selectExpr("1 as query_id", "collection", "chunk_id", "1.0 as score", "cast(chunk_id as int) as rank")
    sections = answering.collection_answers(found, chunks, 8)
    assert sorted(map(tuple, sections.collect())) == [(1, "a", "Clubs register.\n\nLate."), (1, "d", "Fees.")]
    questions = spark.createDataFrame([(1,), (2,)], "query_id int")
    told = {r.query_id: (r.response, r.n_sections) for r in answering.polished(sections, questions, 9).collect()}
    assert told == {1: ("[a]\nClubs register.\n\nLate.\n\n[d]\nFees.", 2), 2: ("Not documented.", 0)}
    one = answering.polished(sections.where("collection = 'd'"), questions.where("query_id = 1"), 9).first()
    assert (one.response, one.n_sections) == ("Fees.", 1)


def test_small_collections_come_whole_and_settings_reach_the_answer(spark, corpus, asked):
    from docmosaic.functions.embedding import embed

    index = InvertedIndex(corpus)
    stored = corpus.withColumn("embedding", F.when(F.col("chunk_id") % 2 == 0, embed(F.col("text"))))
    phrased = asked.where("entity_id < 2 or entity_id = 7").withColumn("variant", F.coalesce("variant", F.lit("")))
    vectors = phrased.select("entity_id", "pos", embed(F.col("variant")).alias("embedding"))
    found = answering.candidates(index, corpus, stored, phrased, vectors, QuerySettings(full_context_max_chunks=1))
    lone = found.where("collection = 'lone'").collect()
    assert {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in lone} == {(q, 8, 1.0, 1) for q in (0, 1, 7)}
    most = found.where("collection <> 'lone'").groupBy("query_id", "collection").count().agg(F.max("count")).first()[0]
    assert most == 22  # 88 over four collections
    for settings in (QuerySettings(), QuerySettings(reranker_strategy="cross-encoder"), QuerySettings(use_reranker=False),
                     QuerySettings(use_hybrid_search=False, use_mmr=False)):
        told = answering.answer(index, corpus, stored, phrased, vectors, settings)
        assert {r.query_id for r in told.collect()} >= {0, 1}
    told = answering.answer(index, corpus, stored, phrased, vectors, iterative=True)
    assert {r.query_id: r.n_sections for r in told.collect()}[0] >= 3


def test_batches_are_bounded_by_bytes(spark):
    """A worker of the index, the splitters and the vectors gets a few megabytes at a time, however long the texts."""
    from docmosaic import session
    from docmosaic.functions.embedding import embed
    from docmosaic.operators import chunking, keyword

    def largest(rows):
        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

        return rows.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]

    docs = spark.range(0, 400, 1, 1).select(
        F.lit("s").alias("collection"), F.col("id").alias("chunk_id"), F.repeat(F.lit("harbour "), 10_000).alias("text"))
    asked = spark.createDataFrame([(1, 0, "harbour")], "entity_id bigint, pos int, variant string")
    for use in (
        lambda: InvertedIndex(docs), lambda: keyword.entity_hits(docs, asked), lambda: chunking.table_chunks(docs), lambda: embed(F.col("text")),
        lambda: vector.nearest(spark.createDataFrame([(1, [1.0])], "chunk_id bigint, embedding array<float>"),
                               spark.createDataFrame([(1, [1.0])], "query_id bigint, embedding array<float>"), 1),
        lambda: cross_encoder.score_pairs(docs.selectExpr("1 as query_id", "chunk_id", "'harbour' as question", "text")),
    ):
        for name in ("Records", "Bytes"):
            spark.conf.unset(f"spark.sql.execution.arrow.max{name}PerBatch")
        use()
        assert largest(docs) <= 1.1 * session.BATCH_BYTES


_DEALT = pa.schema([
    ("collection", pa.string()), ("segment", pa.string()), ("kind", pa.int32()), ("chunk_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
    ("average", pa.float64()), ("term", pa.string()), ("places", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("idf", pa.float64())])


def searched(segments, phrasings, k, per_collection=True, distinct=False):
    """(pos, chunk_id, score) that one task hands on, of segments [(collection, [(id, text)])]."""
    every = sorted({t for p in phrasings for t in p.split()})
    batches = []
    for n, (collection, chunks) in enumerate(segments):
        made = inverted._Segment()
        for i, text in chunks:
            made.add(i, text)
        first, *rest = made.rows(collection, f"0-{n}", pa.int64()).to_pylist()
        batches.append(pa.RecordBatch.from_pylist([{**{c: first[c] for c in ("collection", "segment", "chunk_ids", "lengths")}, "kind": 0, "average": 9.0}], _DEALT))
        picked = inverted._pick(iter([pa.RecordBatch.from_pylist([{"asked": every, **r} for r in rest])])) if rest else ()
        rows = sorted((r for x in picked for r in x.to_pylist()), key=lambda r: r["term"])
        if rows:
            batches.append(pa.RecordBatch.from_pylist([{**r, "kind": 1, "idf": 1 / (1 + every.index(r["term"]))} for r in rows], _DEALT))
    asked = inverted._Asked([SimpleNamespace(entity_id=1, pos=n, asked=sorted(set(p.split()))) for n, p in enumerate(phrasings)], pa.int64())
    found = inverted._search(iter(batches), SimpleNamespace(value=asked), k, per_collection, distinct)
    return sorted((r["pos"], r["chunk_id"], round(r["score"], 9)) for x in found for r in x.to_pylist())


def test_tasks_hand_on_their_best_and_not_that_of_each_segment(monkeypatch):
    r = random.Random(3)
    word = lambda: f"w{int(40 ** r.random())}"
    text = lambda: " ".join(word() for _ in range(r.randrange(0, 30)))
    segments = [(f"c{n // 20}", [(n * 100 + i, text()) for i in range(r.randrange(1, 40))]) for n in range(60)]
    phrasings = [" ".join(word() for _ in range(n)) for n in (9, 3, 1)] + ["nowhere"]
    every = searched(segments, phrasings, None)
    of = {i: c for c, chunks in segments for i, _ in chunks}
    for per_collection in (True, False):
        groups = {}
        for pos, i, score in every:
            groups.setdefault((pos, of[i] if per_collection else ""), []).append((-score, i))
        best = sorted((pos, i, -s) for (pos, _), hits in groups.items() for s, i in sorted(hits)[:5])
        for short, tile, waiting in ((16, 1 << 20, 50_000), (16, 1, 7), (0, 1, 7)):
            for name, value in (("SHORT", short), ("TILE", tile), ("WAITING", waiting), ("RANGE", 8), ("STEP", 1)):
                monkeypatch.setattr(inverted, name, value)
            assert searched(segments, phrasings, None) == every
            assert searched(segments, phrasings, 5, per_collection) == best


def test_a_chunk_that_lies_in_several_segments_counts_once_in_a_ranking(monkeypatch):
    monkeypatch.setattr(inverted, "WAITING", 3)
    segments = [("c", [(k // 2, "w3 " * (1 + k // 2) + "w99")]) for k in range(12)]
    assert [i for _, i, _ in searched(segments, ["w3"], 4, distinct=True)] == [2, 3, 4, 5]
    assert [i for _, i, _ in searched(segments, ["w3"], 4)] == [4, 4, 5, 5]


def test_phrasings_of_several_passes_agree(corpus, asked, monkeypatch):
    names = ("entity_id", "pos", "collection", "chunk_id", "score")
    index = InvertedIndex(corpus)
    old = plain(index.scores(asked, 3), *names)
    monkeypatch.setattr(inverted, "PHRASINGS", 9)
    assert plain(index.scores(asked, 3), *names) == old


def test_texts_that_were_not_found_stay_where_they_lie(spark, tmp_path):
    spark.range(50).selectExpr("id as chunk_id", "concat('t', id) as text").unionByName(
        spark.sql("select 3L as chunk_id, 'again' as text union all select null, 'lost'")).write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    found = spark.createDataFrame([(1, 3), (2, 3), (1, 4), (1, None)], "query_id bigint, chunk_id bigint")
    read = looked_up(texts, found, "chunk_id")
    assert sorted(r.text for r in read.collect()) == ["again", "t3", "t4"]
    assert "BroadcastHashJoin" in read._jdf.queryExecution().toString()


def test_only_texts_of_found_chunks_are_collapsed(spark, monkeypatch):
    rows = [("c", k, f"t  {k}") for k in range(40)]
    chunks = spark.createDataFrame(rows, "collection string, chunk_id bigint, text string")
    found = spark.createDataFrame([(1, "c", 7, 1), (1, "c", 9, 2)], "query_id bigint, collection string, chunk_id bigint, rank int")
    written, real = [], answering.materialize
    monkeypatch.setattr(answering, "materialize", lambda df, label="stage": written.append((label, real(df, label))) or written[-1][1])
    assert [r.response for r in answering.collection_answers(found, chunks, 8).collect()] == ["t 7\n\nt 9"]
    assert {label: df.count() for label, df in written}["told"] == 2
