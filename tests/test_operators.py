"""Operators against brute force and by their properties."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmosaic.operators import bm25, graph, keyword, matching, memory, mmr, ranking, spatial, vector
from docmosaic.plans import catalog, coverage, gap, retrieval, validation


def test_scan_terms_against_brute_force(spark, rows, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc ") for _ in range(40)) for _ in range(30)] + ["", "ÉCOLE"]
    terms = sorted({"".join(rng.choice("ABc") for _ in range(rng.randint(1, 4))) for _ in range(25)} | {"éco"})
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id bigint, text string")
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    want = sorted({(i, w.lower()) for i, x in enumerate(texts) for w in terms if w.lower() in x.lower()}, key=str)
    assert rows(keyword.scan_terms(df, t, ["chunk_id"])) == want
    monkeypatch.setattr(keyword, "TERM_CHARS", 20)  # several passes give the same
    assert rows(keyword.scan_terms(df, t, ["chunk_id"])) == want


def test_nearest_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(60, 8)).astype(np.float32)
    vecs[7] = vecs[3]
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vecs)], "chunk_id bigint, embedding array<float>")
    q = v.where("chunk_id < 6").withColumnRenamed("chunk_id", "query_id")
    unit = vecs.astype(float) / np.linalg.norm(vecs.astype(float), axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    want = {(i, int(j)) for i in range(6) for j in np.lexsort((np.arange(60), -sims[i]))[:5]}
    got = vector.nearest(v.repartition(4), q, 5).collect()
    assert {(r.query_id, r.chunk_id) for r in got} == want
    monkeypatch.setattr(vector, "QUERY_BYTES", 100)
    assert {(r.query_id, r.chunk_id) for r in vector.nearest(v, q, 5).collect()} == want


def _pool(spark, n=20):
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(1, i, x.tolist()) for i, x in enumerate(rng.normal(size=(n, 6)))], "query_id bigint, chunk_id bigint, embedding array<double>")
    q = spark.createDataFrame([(1, rng.normal(size=6).tolist())], "query_id bigint, embedding array<double>")
    return v, q


def test_mmr_without_diversity_is_top_k(spark):
    v, q = _pool(spark)
    a = [r.chunk_id for r in mmr.diversify(v, q, 7, 1.0).orderBy("rank").collect()]
    b = [r.chunk_id for r in vector.rerank(v, q, 7).orderBy("rank").collect()]
    assert a == b


def test_mmr_small_pool(spark):
    v, q = _pool(spark, 3)
    assert mmr.diversify(v, q, 10).count() == 3


@pytest.mark.parametrize("n", [0, 1, 2, 3, 8])
def test_lost_in_middle_is_a_permutation(spark, n):
    df = spark.createDataFrame([(1, r) for r in range(1, n + 1)], "query_id int, rank int")
    got = {r.rank: r.position for r in ranking.lost_in_middle(df, ["query_id"]).collect()}
    assert sorted(got.values()) == list(range(n))
    if n == 8:
        assert [r for r, _ in sorted(got.items(), key=lambda x: x[1])] == [1, 3, 5, 7, 8, 6, 4, 2]


def test_fusion_is_symmetric(spark, rows):
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id int, chunk_id int, rank int")
    b = spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "query_id int, chunk_id int, rank int")
    fuse = lambda x, y: ranking.reciprocal_rank_fusion([x, y], ["query_id", "chunk_id"])
    assert rows(fuse(a, b)) == rows(fuse(b, a))
    assert {r.chunk_id: round(r.score, 9) for r in fuse(a, b).collect()}[2] == round(1 / 61 + 1 / 60, 9)


def test_two_step_top_k_gives_the_same(spark, rows):
    df = spark.range(2000).select((F.col("id") % 3).alias("k"), F.col("id"), (F.col("id") * 37 % 101).alias("score"))
    order = [F.col("score").desc(), F.col("id")]
    want = rows(ranking.top_k(df, ["k"], 9, order))
    assert rows(ranking.top_k(df.repartition(7), ["k"], 9, order, salt=F.col("id") % 5)) == want


def test_keep_first(spark, rows):
    df = spark.createDataFrame([("a", 3, "x"), ("A", 1, None), ("b", 2, "z")], "k string, o int, v string")
    assert rows(ranking.keep_first(df, [F.lower("k")], ["o"])) == [("A", 1, None), ("b", 2, "z")]


def test_per_collection_k():
    assert ranking.per_collection_k(88, 44) == 5 and ranking.per_collection_k(88, 4) == 22


CHUNKS = [("s1", 1, "the club rules the club"), ("s1", 2, "players only"), ("s2", 3, "nothing here"), ("s2", 4, "Club players"), ("s3", 5, "---")]


def _chunks(spark):
    return spark.createDataFrame(CHUNKS, "collection string, chunk_id bigint, text string")


def _variants(spark, *rows):
    return spark.createDataFrame(list(rows), "entity_id bigint, pos int, variant string")


def test_bm25_against_brute_force(spark):
    import math
    import re

    tok = {i: re.findall("[a-z0-9]+", t.lower()) for _, i, t in CHUNKS}
    own = {c: [i for k, i, _ in CHUNKS if k == c] for c in ("s1", "s2", "s3")}

    def score(terms, c, i):
        n, avg = len(own[c]), sum(len(tok[j]) for j in own[c]) / len(own[c])
        total = 0
        for t in set(terms):
            df, tf = sum(t in tok[j] for j in own[c]), tok[i].count(t)
            if tf:
                total += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tok[i]) / avg))
        return total

    got = bm25.chunk_scores(_chunks(spark), _variants(spark, (1, 0, "club players"), (1, 1, "Rules"))).collect()
    want = {(v, c, i): score(v.lower().split(), c, i) for v in ("club players", "Rules") for c, i, _ in CHUNKS}
    assert {(r.variant, r.collection, r.chunk_id): round(r.score, 9) for r in got} == {k: round(s, 9) for k, s in want.items() if s}


def test_large_sides_take_the_shuffle_path_with_the_same_result(spark, rows, monkeypatch):
    from docmosaic import session

    v = _variants(spark, (1, 0, "club players"), (2, 0, "rules"))
    score = lambda: rows(bm25.chunk_scores(_chunks(spark), v).withColumn("score", F.round("score", 9)))
    want = score()
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    wide = spark.range(3).select(F.lit("x" * 50).alias("s"), F.array(F.lit(1)).alias("a"))
    assert not session.is_small(wide)  # no row count can make up for the bytes
    assert score() == want


def test_section_threshold(spark):
    v = _variants(spark, (1, 0, "rules"))
    every = bm25.section_scores(_chunks(spark), v, collections=["s1", "s2", "s3"])
    assert {(r.collection, r.score > 0) for r in every.collect()} == {("s1", True), ("s2", False), ("s3", False)}
    assert [r.collection for r in bm25.section_scores(_chunks(spark), v, strict=True).collect()] == ["s1"]


def test_section_winner_prefers_the_earlier_variant(spark):
    got = bm25.section_scores(_chunks(spark), _variants(spark, (1, 0, "rules"), (1, 1, "RULES")), strict=True).collect()
    assert [(r.collection, r.winning_variant) for r in got] == [("s1", "rules")]


def test_full_context_bypass(spark):
    v = _variants(spark, (1, 0, "club"))
    scored = retrieval.lexical_ranking(_chunks(spark), v)
    got = retrieval.full_context_or_top(scored, _chunks(spark), 1, 88, 3).collect()
    assert {(r.collection, r.chunk_id, r.score == 1.0) for r in got} == {("s1", 1, False), ("s2", 4, False), ("s3", 5, True)}
    assert all(r.score != 1.0 for r in retrieval.full_context_or_top(scored, _chunks(spark), 0, 88, 3).collect())


def test_distinct_hits_collapse_whitespace(spark):
    df = spark.createDataFrame([("s", 2, "a  club"), ("s", 1, "a club "), ("t", 3, "A club")], "collection string, chunk_id bigint, text string")
    got = keyword.distinct_hits(keyword.entity_hits(df, _variants(spark, (1, 0, "CLUB")))).collect()
    assert {(r.collection, r.chunk_id) for r in got} == {("s", 1), ("t", 3)}


def test_keyword_flags_and_cutoff(spark):
    pool = spark.createDataFrame([(1, i, i, f"text {i} " + "z" * 40) for i in range(1, 6)], "query_id bigint, chunk_id bigint, rank int, text string")
    kw = spark.createDataFrame([(1, " text 5 " + "z" * 40), (1, "z" * 31), (1, "text 1")], "query_id bigint, text string")
    flags = ranking.keyword_flags(pool, kw)
    assert {r.chunk_id for r in flags.collect()} == {1, 2, 3, 4, 5}
    only = ranking.keyword_flags(pool, kw.where("text like ' text%' or text = 'text 1'"))
    got = ranking.boosted_cutoff(pool, only, 2).orderBy("rank").collect()
    assert [r.status for r in got] == ["INCLUDED"] * 3 + ["DROPPED"] * 2


# --- matching -------------------------------------------------------------------

ALIASES = [("player", "footballer"), ("coach", "official"), ("referee", "official")]


def _match(spark, *terms):
    entities = spark.createDataFrame(
        [(1, "Referee", "P", "f1"), (2, "Coach", "P", "f2"), (3, " PLAYER ", "P", "f3"), (4, "Official", "P", "f4"), (5, "FA Club", "P", "f5")],
        "ord bigint, entity_name string, domain string, fact_sheet_id string",
    )
    aliases = spark.createDataFrame(ALIASES, "canonical string, alias string")
    t = spark.createDataFrame(list(enumerate(terms)), "ord bigint, term string")
    return {r.term: (r.mapped_entity, r.mapping_confidence) for r in matching.match_terms(t, entities, aliases).collect()}


def test_own_name_beats_alias(spark):
    got = _match(spark, "official", "Footballer", "player", "nobody", "Football Club")
    assert got["official"] == ("Official", "high")
    # found under the term's own spelling, though as an alias of the entity
    assert got["Footballer"] == (" PLAYER ", "high")
    assert got["Football Club"] == ("FA Club", "medium")
    assert got["player"] == (" PLAYER ", "high")
    assert got["nobody"] == ("Not mapped", "low")


def test_shared_alias_goes_to_the_first_entity(spark):
    aliases = spark.createDataFrame([("b", "x"), ("a", "x")], "canonical string, alias string")
    entities = spark.createDataFrame([(2, "A", "", ""), (1, "B", "", "")], "ord bigint, entity_name string, domain string, fact_sheet_id string")
    t = spark.createDataFrame([(1, "X")], "ord bigint, term string")
    assert matching.match_terms(t, entities, aliases).first().mapped_entity == "B"


def test_abbreviations(spark, rows):
    names = spark.createDataFrame([("football association",)], "base string")
    none = spark.createDataFrame([], "canonical string, alias string")
    got = {r.variant for r in matching.alias_variants(names, none).collect()}
    assert got == {"football association", "football assoc", "fa association"}


def test_forced_entries_only_fill_gaps(spark):
    m = spark.createDataFrame([("a", 1, "A", "a", "high", "r")], "entity_key string, ord bigint, term string, term_lower string, mapping_confidence string, mapping_rationale string")
    forced = spark.createDataFrame([("A",), ("B ",)], "entity_name string")
    got = {r.entity_key: r.mapping_confidence for r in matching.with_forced(m, forced).collect()}
    assert got == {"a": "high", "b": "medium"}


def test_gap_statuses_partition_the_union(spark):
    a = spark.createDataFrame([(1, "A"), (2, "b "), (3, "B")], "ord bigint, name string")
    b = spark.createDataFrame([(1, " b"), (2, "c")], "ord bigint, name string")
    got = {r.normalized_name: (r.model_name, r.handbook_name, r.status) for r in gap.gap_analysis(a, b).collect()}
    assert got == {"a": ("A", "", "MODEL_ONLY"), "b": ("B", " b", "MATCHED"), "c": ("", "c", "HANDBOOK_ONLY")}


def test_candidate_names_take_the_first_filled_field(spark):
    df = spark.createDataFrame([(1, "", "E", "T"), (2, None, "", "T2"), (3, "", "", "")], "ord bigint, entity_name string, entity string, term string")
    assert [r.name for r in gap.candidate_names(df).orderBy("ord").collect()] == ["E", "T2"]


def test_acceptance(spark):
    df = spark.createDataFrame([("x", "")], "fact_sheet_id string, subgroup string")
    got = {r.check_name: r.passed for r in validation.acceptance(df).collect()}
    assert got == {"fact_sheet_ids": True, "entity_count": False, "subtypes": True}


def test_nested_pages_hold_every_entity(spark, monkeypatch):
    monkeypatch.setattr(catalog, "PAGE_ROWS", 10)
    tree = spark.range(95).select(
        F.lit("D").alias("domain"), F.lit("subtypes").alias("branch"), F.lit("S").alias("subgroup"),
        F.concat(F.lit("e"), "id").alias("entity_name"), *[F.lit("").alias(c) for c in ("domain_id", "domain_description", "subtype_id", "subtype_description")],
    )
    pages = catalog.nested_pages(tree).collect()
    found = [json.loads(p.entities) for p in pages]
    assert sorted(e["entity_name"] for page in found for e in page) == sorted(f"e{i}" for i in range(95))
    assert all(len(page) == p.n <= 10 and page[0]["entity_name"] == p.first for p, page in zip(pages, found)) and len(pages) > 9
    lines = [json.loads(r.value) for r in catalog.page_lines(catalog.nested_pages(tree)).collect()]
    assert sum(line["n"] for line in lines) == sum(len(line["entities"]) for line in lines) == 95


def test_coverage_summary_rounds_half_to_even(spark):
    df = spark.createDataFrame([("STRONG",)] * 1 + [("THIN",)] * 7, "verdict string")
    assert {r.verdict: r.pct for r in coverage.summary(df).collect()} == {"STRONG": 12, "THIN": 88}


# --- spatial, graph, memory -------------------------------------------------------


def test_spatial_against_brute_force(spark):
    rng = random.Random(2)
    boxes = [(rng.choice("ab"), i, i, float(rng.randint(0, 60)), float(rng.randint(-20, 60)), float(rng.choice([0, 5, 10, 30, 64])), float(rng.choice([0, 4, 8, 40]))) for i in range(80)]
    points = [(rng.choice("ab"), i, float(rng.randint(0, 70)), float(rng.randint(-20, 70))) for i in range(80)]
    b = spark.createDataFrame(boxes, "group string, box_id bigint, ord bigint, x double, y double, w double, h double")
    p = spark.createDataFrame(points, "group string, point_id bigint, px double, py double")
    inside = lambda pt, bx: bx[0] == pt[0] and bx[3] <= pt[2] <= bx[3] + bx[5] and bx[4] <= pt[3] <= bx[4] + bx[6]
    for last in (False, True):
        want = {}
        for pt in points:
            hits = [bx[1] for bx in boxes if inside(pt, bx)]
            if hits:
                want[pt[1]] = hits[-1 if last else 0]
        assert {r.point_id: r.box_id for r in spatial.point_in_box(p, b, last).collect()} == want
    within = lambda c, o: o[0] == c[0] and o[1] != c[1] and o[3] <= c[3] and c[3] + c[5] <= o[3] + o[5] and o[4] <= c[4] and c[4] + c[6] <= o[4] + o[6]
    want = {c[1] for c in boxes if not any(within(c, o) for o in boxes)}
    assert {r.box_id for r in spatial.roots(b).collect()} == want


def test_boxes_over_each_other_make_no_pairs(spark):
    """Every box holds every point: pairs would be 4 million, rows of all stages stay near n log^2 n."""
    n = 2000
    boxes = spark.range(n).selectExpr(
        "'g' as group", "id as box_id", "id as ord", "double(-id) / 7 as x", "double(-(id * 37 % 2000)) / 3 as y", "double(5000 + id * 11 % 2000) as w", "double(5000 + id) as h")
    points = spark.range(n).selectExpr("'g' as group", "id as point_id", "double(id % 100) + 0.5 as px", "double(id) / 2 as py")
    rows = {r.point_id: r.box_id for r in spatial.point_in_box(points, boxes).collect()}
    assert rows == {k: 0 for k in range(n)}
    for plan in (spatial.point_in_box(points, boxes), spatial.enclosed(boxes)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in text and ">= x" not in text and "<= ox" not in text
    flat = [(r.box_id, r.x, r.y, r.x + r.w, r.y + r.h) for r in boxes.collect()]
    within = {c[0] for c in flat if any(o[0] != c[0] and o[1] <= c[1] and o[2] <= c[2] and o[3] >= c[3] and o[4] >= c[4] for o in flat)}
    assert {r.box_id for r in spatial.enclosed(boxes).collect()} == within


def test_spatial_with_copies_nulls_and_fractions(spark):
    rng = random.Random(8)
    number = lambda *of: rng.choice([None, 0.0, 0.25, 1.0, 3.5, 1e-9, 700.0, *of])
    boxes = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), i, number(-2.5), number(8.25), number(2.0), number(4.0)) for i in range(150)]
    boxes += boxes[:30]
    b = spark.createDataFrame(boxes, "group string, box_id bigint, ord bigint, x double, y double, w double, h double")
    has = lambda x: None not in x
    within = lambda c, o: has((c[0], c[1], o[0], o[1], *c[3:], *o[3:])) and c[0] == o[0] and c[1] != o[1] and (
        o[3] <= c[3] and c[3] + c[5] <= o[3] + o[5] and o[4] <= c[4] and c[4] + c[6] <= o[4] + o[6])
    want = {(c[0], c[1]) for c in boxes if any(within(c, o) for o in boxes)}
    assert {tuple(r) for r in spatial.enclosed(b).collect()} == want
    points = [(rng.choice(["a", "b", None]), i, number(2.0), number(9.0)) for i in range(150)]
    p = spark.createDataFrame(points, "group string, point_id bigint, px double, py double")
    inside = lambda q, o: has((q[0], o[0], *q[2:], *o[3:])) and q[0] == o[0] and o[3] <= q[2] <= o[3] + o[5] and o[4] <= q[3] <= o[4] + o[6]
    for last in (False, True):
        got = {r.point_id: r.box_id for r in spatial.point_in_box(p, b, last).collect()}
        hits = {q[1]: [o for o in boxes if inside(q, o)] for q in points}
        assert got == {k: sorted(v, key=lambda o: -o[2] if last else o[2])[0][1] for k, v in hits.items() if v}


@pytest.mark.parametrize("w, h, box", [(102, 40, False), (101, 41, True), (100, 50, False)])
def test_container_size(spark, w, h, box):
    assert spark.range(1).select(spatial.is_container(F.lit(w), F.lit(h)).alias("c")).first().c is box


def _graph(spark, directed=False):
    rel = [(1, "A", "B", "owns"), (2, "B", "C", "owns"), (3, "C", "A", "runs"), (4, "C", "D", "has"), (5, "X", "Y", "has"), (6, "A", "B", "leads"), (7, "", "Z", "no")]
    df = spark.createDataFrame(rel, "ord bigint, source_entity string, entity_b string, relationship_type string")
    return graph.build(graph.normalize_relationships(df), directed)


def test_graph_last_edge_wins(spark):
    e = {(r.src, r.dst): r.relationship_type for r in _graph(spark).collect()}
    assert e[("A", "B")] == "leads" and e[("B", "A")] == "inverse_leads" and ("", "Z") not in e and len(e) == 10


def test_graph_traversal(spark):
    g = _graph(spark)
    assert {(r.node, r.hops) for r in graph.reachable(g, "A").collect()} == {("A", 0), ("B", 1), ("C", 1), ("D", 2)}
    assert {r.node for r in graph.descendants(g, "A").collect()} == {r.node for r in graph.ancestors(g, "A").collect()} == {"B", "C", "D"}
    assert {tuple(r.path) for r in graph.shortest_paths(g, "D", 2).collect()} == {("D", "C"), ("D", "C", "A"), ("D", "C", "B")}
    d = _graph(spark, directed=True)
    assert {r.node for r in graph.descendants(d, "D").collect()} == set()
    assert {r.node for r in graph.ancestors(d, "D").collect()} == {"A", "B", "C"}


def test_graph_result_document(spark):
    import json

    g = _graph(spark)
    run = lambda *a, **k: json.loads(graph.traverse(g, *a, **k).first().json)
    assert run("A")["total"] == 2
    assert run("A", "ego_graph", max_depth=1)["total_nodes"] == 3
    assert run("A", "descendants")["descendants"] == ["B", "C", "D"]
    assert run("A", "all_shortest_paths")["paths"]["D"] == ["A", "C", "D"]
    assert run("ab")["total_nodes"] == 6 and run("a2"[:1])["suggestions"] == ["A"]
    assert "error" in run("X", relationship_type="owns")
    with pytest.raises(ValueError):
        graph.traverse(g, "A", "wander")


def test_frames_across_blocks(spark):
    rng = random.Random(4)
    msgs = [(c, t, rng.choice(["user", "assistant"]), f"m{t}") for c in (1, 2) for t in sorted(rng.sample(range(60), 25))]
    df = spark.createDataFrame(msgs, "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.turn): [x.text for x in r.previous] for r in memory.with_previous(df, 3, ["text"], block=4).collect()}
    for c in (1, 2):
        own = [m for m in msgs if m[0] == c]
        for i, m in enumerate(own):
            assert got[(c, m[1])] == [x[3] for x in own[max(0, i - 3) : i]]


def test_fifo_and_history(spark):
    msgs = [(1, t, "system" if t % 10 == 0 else "user", "x") for t in range(55)]
    df = spark.createDataFrame(msgs, "conv_id bigint, turn bigint, role string, text string")
    assert {r.turn for r in memory.fifo(df).collect()} == set(range(5, 55))
    assert {r.turn for r in memory.history(df).collect()} == {t for t in range(5, 55) if t % 10}


def test_cascade_asks_for_aliases_when_sections_are_few(spark):
    v = _variants(spark, (1, 0, "rules"), (2, 0, "zzz"))
    asked = []

    def expand(rows):
        asked.extend(r.entity_id for r in rows.collect())
        return rows.withColumn("response", F.lit("players, zzz, x"))

    got = {r.entity_id: (r.sections, r.status) for r in retrieval.routing_cascade(_chunks(spark), v, 1, expand).collect()}
    assert asked == [2] and got == {1: (1, "ROUTED"), 2: (2, "ROUTED")}
    plain = {r.entity_id: r.status for r in retrieval.routing_cascade(_chunks(spark), v).collect()}
    assert plain == {1: "ROUTED", 2: "SKIPPED"}
