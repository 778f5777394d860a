"""Evidence and state of the rounds: rows, the best first; what was seen and tried reaches the policy."""

import random

from pyspark.sql import functions as F

from docmosaic import session
from docmosaic.plans import agent, answering
from docmosaic.plans.answering import extract, fitted_texts, reduce_texts

CHUNKS = "collection string, chunk_id bigint, text string"
VARIANTS = "entity_id bigint, pos int, variant string"


def test_all_hits_are_evidence_and_the_best_come_first(spark):
    rows = [("s", k, f"chunk {k} names the harbour once among many other words of no weight here") for k in range(1, 7)]
    chunks = spark.createDataFrame([*rows, ("s", 7, "harbour harbour piers"), ("s", 8, "harbourside only"), ("t", 9, "harbourside  only")], CHUNKS)
    corpus = agent.Corpus(chunks)
    names = spark.createDataFrame([(1, 0, "harbour")], VARIANTS)
    ids = lambda rows: [r.chunk_id for r in rows.orderBy("place").collect()]
    assert len(ids(agent.retrieve(corpus, names))) == 7 and ids(agent.retrieve(corpus, names))[0] == 7
    hits = agent.scan(corpus, names)
    assert ids(hits)[0] == 7 and ids(hits)[-1] == 8 and len(ids(hits)) == 8  # the copy of 8 is the same text
    assert ids(agent.scan(corpus, names, 1)) == [7]
    chosen = spark.createDataFrame([(1, "t")], "entity_id bigint, collection string")
    assert ids(agent.retrieve(corpus, names, None, chosen)) == []
    told = agent.texts(hits, chunks).first().evidence.split("\n\n")
    assert told[0] == "harbour harbour piers" and told[-1] == "harbourside only" and len(told) == 8
    assert len(agent.texts(hits, chunks, 60).first().evidence) <= 60


def test_a_short_keyword_hit_is_content(spark):
    chunks = spark.createDataFrame([("s", 1, "prefixed-coaches")], CHUNKS)
    variants = spark.createDataFrame([(2, 0, "trainer"), (2, 1, "coaches")], VARIANTS)
    entities = spark.createDataFrame([(2, "trainer")], "entity_id bigint, name string")
    trace, found = agent.run(agent.Corpus(chunks), entities, variants)
    assert [(r.action, r.has_content) for r in trace.orderBy("iteration").collect()] == [
        ("RETRIEVE", False), ("KEYWORD", True), ("DONE", False)]
    assert agent.texts(agent.gathered(trace, found), chunks).first().evidence == "prefixed-coaches"


def test_policies_read_the_state_and_choose_sections(spark):
    long = "the club registers its players and officials before the season, and keeps a list of them that the association may read at any time"
    chunks = spark.createDataFrame([("a", 1, long), ("b", 2, long + " again"), ("b", 3, "referee")], CHUNKS)
    entities = spark.createDataFrame([(1, "club")], "entity_id bigint, name string")
    variants = spark.createDataFrame([(1, 0, "club players"), (1, 1, "referee")], VARIANTS)
    said = ['KEYWORD terms: ["Referee", "players"]', 'RETRIEVE sections: ["b"] query: "season list"', 'KEYWORD terms: ["players", "REFEREE"]', "nonsense"]
    states = []

    def policy(state):
        told = state.withColumn("seen", agent.observations_summary(state)).withColumn("tried", agent.tried_summary(state))
        states.append(told.select("iteration", "seen", "tried", "substantive", "tried_keyword").first())
        return state.withColumn("said", F.lit(said[len(states) - 1]))

    trace, found = agent.run(agent.Corpus(chunks), entities, variants, policy)
    rows = trace.orderBy("iteration").collect()
    assert [(r.action, r.n_chunks, r.sections) for r in rows] == [
        ("RETRIEVE", 2, ["a", "b"]), ("KEYWORD", 3, []), ("RETRIEVE", 1, ["b"]), ("KEYWORD", 0, []), ("DONE", 0, [])]
    assert [r.observed for r in rows] == [True, True, True, False, False]
    assert states[0].seen.startswith("  Observation 1: RAG retrieve — query=club players sections=[a, b] → found content\n    Preview: the club")
    assert states[2].seen.split("\n")[2] == "  Observation 2: Keyword scan — terms=[Referee, players] → 3 chunks found"
    assert states[2].tried == "  RAG query: club players\n  RAG query: season list\n  Keyword scan: [players, referee]"
    assert states[0].substantive and not states[0].tried_keyword and states[1].tried_keyword
    assert [r.chunk_id for r in agent.gathered(trace, found).orderBy("place").collect()] == [2, 1, 3]  # words are rarer in b


def test_summaries_of_nothing(spark):
    empty = spark.createDataFrame([(1,)], "entity_id int").selectExpr(
        "*", "cast(array() as array<struct<kind:string,query:string,terms:array<string>,sections:array<string>,n_chunks:bigint,has_content:boolean,preview:string>>) as observations",
        "cast(array() as array<string>) as tried_queries", "cast(array() as array<array<string>>) as tried_terms")
    told = empty.select(agent.observations_summary(empty), agent.tried_summary(empty)).first()
    assert tuple(told) == ("  (none yet)", "  (none yet)")


def test_fitted_texts_are_those_of_the_tree(spark):
    rng = random.Random(5)
    bodies = [(k, "".join(rng.choice("ab ") for _ in range(rng.choice([0, 1, 3, 20, 90])))) for k in range(300)]
    bodies += [(7, "a copy of seven"), (8, bodies[8][1])]  # ids may repeat, and so may texts
    rows = [(e, place, k) for e, n in ((1, 300), (2, 9), (3, 1), (4, 64)) for place, k in enumerate(rng.sample(range(300), n))]
    texts = spark.createDataFrame(bodies[:-2], "chunk_id bigint, text string")
    kept = spark.createDataFrame(rows, "entity_id int, place int, chunk_id bigint")
    for budget, fan in ((9, 8), (200, 8), (3000, 20)):
        want = reduce_texts(kept.join(texts, "chunk_id"), ["entity_id"], 300, extract(budget), fan)
        got = fitted_texts(kept, texts, ["entity_id"], budget, fan)
        assert {r.entity_id: r.text for r in got.collect()} == {r.entity_id: r.text for r in want.collect()}, (budget, fan)
    twice = fitted_texts(kept, spark.createDataFrame(bodies, texts.schema), ["entity_id"], 10**6, 300).where("entity_id = 1").first().text
    assert len(twice) == sum(len(b) for _, b in bodies) + 2 * (len(bodies) - 1)


def test_rounds_write_sums_and_no_evidence(spark, monkeypatch):
    """What is written grows with the entities, not with the chunks that share a word with them."""
    chunks = spark.createDataFrame([("s", k, f"harbour number {k}" + " and piers" * k) for k in range(300)], CHUNKS)
    names = spark.createDataFrame([(1, 0, "harbour"), (2, 0, "harbour piers")], VARIANTS)
    entities = names.selectExpr("entity_id", "variant as name")
    corpus, written = agent.Corpus(chunks), {}

    def materialize(df, label):
        out = session.materialize(df, label)
        written[label] = written.get(label, 0) + out.count()
        return out

    assert corpus.facts.count() == 300
    monkeypatch.setattr(agent, "materialize", materialize)
    trace, found = agent.run(corpus, entities, names)
    first = trace.where("iteration = 1").orderBy("entity_id").collect()
    assert [r.n_chunks for r in first] == [300, 300] and written and max(written.values()) <= 8
    assert [r.preview for r in first] == [
        chunks.where(F.col("chunk_id") == found.where(f"entity_id = {e} and place = 0").first().chunk_id).first().text[:200] for e in (1, 2)]
    # of the texts, only those are read that have a share of the result
    monkeypatch.setattr(answering, "materialize", materialize)
    told = agent.texts(agent.gathered(trace, found), chunks, 500).first().evidence
    assert len(told) <= 500 and written["wanted"] < 300
