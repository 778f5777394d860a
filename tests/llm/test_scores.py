"""Classifiers on held-out rows, fingerprints against exact similarity, and the pipeline against plain Python."""

import hashlib
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docmosaic.llm import fingerprint, quality, toxicity
from docmosaic.llm.common import table
from docmosaic.llm.queries import QUERIES
from tests.conftest import DATA
from tests.llm.test_filters import brute_components, brute_lines, brute_windows

LARGER = DATA.parent / "sf0.01"


def held_out(spark, name, label):
    rows = QUERIES[name](spark, str(LARGER)).where("held_out")
    labels = table(spark, str(LARGER), "labels").select("doc_id", label)
    got = rows.join(labels, "doc_id").toPandas()
    right = (got["predicted"] == got[label]).mean()
    ranks = got["score"].rank()
    ones = got[label] == 1
    area = (ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    return right, area


@pytest.mark.skipif(not LARGER.exists(), reason="test tables not present")
@pytest.mark.parametrize("name, label, least", [("op6_byte_cnn_quality", "quality", 0.9), ("op2_clause_grammar_toxicity", "toxic", 0.85)])
def test_accuracy_on_held_out_rows(spark, name, label, least):
    right, area = held_out(spark, name, label)
    assert right >= least and area >= 0.75


def test_network_gradients_are_those_of_the_loss():
    net = quality.fit([b"abc"], np.array([1.0], np.float32), epochs=0)
    net = {k: v.astype(np.float64) + (0.1 if k == "b1" else 0) for k, v in net.items()}
    texts, y = [random.Random(1).randbytes(600), b"###!!", b""], np.array([1.0, 0.0, 1.0])
    weight = np.ones(3)

    def loss(n):
        p = quality._pooled(n, texts)
        z = quality._head(n, p["z"], p["start"])[2]
        return float((np.log1p(np.exp(z)) - y * z).mean())

    grads = quality._gradients(net, texts, y, weight)
    for name in ("w1", "w2", "b1", "byte", "code", "bias"):
        at = np.unravel_index(np.argsort(-np.abs(grads[name]).ravel())[:2], net[name].shape)
        for k in zip(*at):
            up, down = ({**net, name: net[name].copy()} for _ in range(2))
            up[name][k] += 1e-4
            down[name][k] -= 1e-4
            assert (loss(up) - loss(down)) / 2e-4 == pytest.approx(grads[name][k], rel=0.05, abs=1e-4)


def test_whole_long_texts_are_scored():
    net = quality.fit([b"plain words here " * 9, b"### &&& $$$ " * 9] * 8, np.array([1, 0] * 8, np.float32), epochs=60)
    long = b"plain words here " * 9000
    assert quality.logits(net, [long + b"### &&& $$$ " * 3000])[0] < quality.logits(net, [long])[0]


def test_scores_do_not_depend_on_other_texts():
    """Bit for bit: alone, among others, before and after texts that fill their last block, long ones in pieces."""
    net = quality.fit([b"plain words here " * 9, b"### &&& $$$ " * 9] * 8, np.array([1, 0] * 8, np.float32), epochs=5)
    r = random.Random(3)
    texts = [b"", b"abc", b"a" * 512, b"ab" * 127 + b"a", r.randbytes(511), b"xyz " * 64, r.randbytes(90_000), b"ab" * 40_000, r.randbytes(250), b"a" * 512]
    alone = [quality.logits(net, [t])[0] for t in texts]
    for _ in range(6):
        order = list(range(len(texts)))
        r.shuffle(order)
        assert quality.logits(net, [texts[k] for k in order]).tolist() == [alone[k] for k in order]


def test_pieces_of_a_long_text_score_as_the_whole(monkeypatch):
    net = quality.fit([b"abc" * 100, b"#$%" * 100] * 4, np.array([1, 0] * 4, np.float32), epochs=2)
    text = random.Random(8).randbytes(70_000) + b"ab" * 9000
    cut = quality.logits(net, [text])[0]
    monkeypatch.setattr(quality, "PIECE_BYTES", 1 << 20)
    assert quality.logits(net, [text])[0] == cut


def test_clauses_are_walked_once():
    symbols, machine = toxicity.Symbols({"idiot": 2.0}), toxicity.grammar()
    one = toxicity.features("the idiot, you idiot. no", symbols, machine)
    assert one[0] == pytest.approx(3.0) and math.expm1(one[1]) == pytest.approx(5.0)
    start = time.perf_counter()
    many = toxicity.features("you idiot. " * 60_000, symbols, machine)
    assert time.perf_counter() - start < 20 and math.expm1(many[1]) == pytest.approx(3.0 * 60_000)


def test_classifiers_at_the_edges(spark, docs):
    rows = docs([(1, None), (2, ""), (None, "text"), (3, "x " * 50_000), (3, "x " * 50_000)])
    none = spark.createDataFrame([(7, 1)], "doc_id bigint, quality int").withColumn("toxic", F.col("quality"))
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        model = module.train(rows, none.where("false"), label)
        got = module.score(rows, model).collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
        assert module.score(docs([]), module.train(docs([]), none, label)).count() == 0
    assert quality.keep_good(rows, quality.train(rows, none.where("false"))).columns == rows.columns


def test_grammar_reads_clauses_not_words():
    symbols, machine = toxicity.Symbols({"idiot": 2.0, "nerv*": 1.0}), toxicity.grammar()
    score = lambda text: toxicity.features(text, symbols, machine)[0]
    assert score("an idiot") == 2.0 and score("you idiot") == 3.0
    assert score("he said you are an idiot") < score("you are an idiot")
    assert score("you are not an idiot") < score("you are an idiot")
    assert score("not. you are an idiot") == score("you are an idiot")
    assert score("nervensäge") == 1.0 and score("nothing here, at all") == 0.0
    assert toxicity.features("idiot, idiot. idiot", symbols, machine)[1] > toxicity.features("idiot", symbols, machine)[1]


def test_composed_machine_is_the_sum_of_its_parts():
    parts = [toxicity._memory(3, (1, 2), 1.5, None), toxicity._memory(4, (1,), 0.5, 3)]
    both = parts[0].compose(parts[1])
    r = random.Random(3)
    for _ in range(200):
        symbols = [r.randrange(6) for _ in range(8)]
        state = [0, 0, 0]
        for s in symbols:
            steps = [m.arcs[k][s] for m, k in zip((*parts, both), state)]
            assert steps[2][1] == pytest.approx(steps[0][1] + steps[1][1])
            state = [x[0] for x in steps]


# --- fingerprints --------------------------------------------------------


def test_fingerprints_estimate_similarity(docs):
    r = random.Random(8)
    base = [f"w{r.randrange(10_000)}" for _ in range(600)]
    rows = [(k, " ".join(base[: 600 - 100 * k] + [f"z{r.randrange(10_000)}" for _ in range(100 * k)])) for k in range(6)]
    rows += [(10, None), (11, ""), (12, "one"), (13, "ONE"), (14, "two words"), (15, "y " * 50_000)]
    got = fingerprint.with_fingerprint(docs(rows), "text", "p").select("doc_id", "p")
    pairs = got.alias("a").join(got.withColumnsRenamed({"doc_id": "o", "p": "q"}), F.lit(True)).select(
        "doc_id", "o", fingerprint.likeness("p", "q").alias("like"), (F.col("p") == F.col("q")).alias("same"), fingerprint.hex_of("p").alias("h")).collect()
    like = {(x["doc_id"], x["o"]): x["like"] for x in pairs}
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(596)} for k, t in rows[:6]}
    for a in sets:
        for b in sets:
            exact = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            assert like[a, b] == pytest.approx(exact, abs=0.16)
    assert like[10, 11] == 1 and like[12, 13] == 1 and like[12, 14] < 0.1
    assert all(len(x["h"]) == 256 for x in pairs) and all(x["same"] for x in pairs if x["doc_id"] == x["o"])


@pytest.mark.parametrize("per_range", [20_000, 3])
def test_next_document_by_falling_id(spark, docs, monkeypatch, per_range):
    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", per_range)
    ids = [5, 9, 1, 22, 14, 3, 8, 100, 77, 41, None]
    got = fingerprint.with_next(docs([(i, f"text {i}") for i in ids]), "doc_id", {"text": "next"}).collect()
    order = sorted((i for i in ids if i is not None), reverse=True) + [None]
    want = {i: f"text {order[(k + 1) % len(order)]}" for k, i in enumerate(order)}
    assert {r["doc_id"]: r["next"] for r in got} == want
    assert fingerprint.with_next(docs([]), "doc_id", {"text": "next"}).count() == 0
    assert fingerprint.with_next(docs([(1, "a")]), "doc_id", {"text": "next"}).first()["next"] == "a"


def test_edited_texts(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op10_one_permutation_fingerprints"](spark, str(DATA)).collect()}
    texts = {r["doc_id"]: r["text"] for r in table(spark, str(DATA), "documents").collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        t, n = texts[i], texts[order[(k + 1) % len(order)]]
        third = len(t) // 3
        assert rows[i]["n_chars"] == len(t)
        assert rows[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - third] + n[:third]).encode()).hexdigest()


# --- pipeline -------------------------------------------------------------


def test_stages_agree_with_plain_python(spark):
    folder = str(DATA)
    columns = table(spark, folder, "documents").columns
    docs = table(spark, folder, "documents")
    scores = {r["id"]: r["score"] for r in quality.score(docs, quality.train(docs, table(spark, folder, "labels"))).collect()}
    items = [(r["item_id"], r["text"]) for r in table(spark, folder, "benchmark").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, folder), name)
        if name == "sentencepiece":
            assert {r["doc_id"] for r in out.collect()} == {i for i, _ in rows} and out.where("not exact").count() == 0
            break
        if name == "quality_classifier":
            rows = [x for x in rows if scores[x[0]] >= 0.3]
        elif name == "line_dedup":
            rows = [(int(i), t) for i, t in brute_lines(rows, 10, "first")]
        elif name == "ngram_jaccard_join":
            kept = {i for i, _, c in brute_components(rows, 5, 80) if i == c}
            rows = [x for x in rows if x[0] in kept]
        else:
            rows = [x for x in rows if not brute_windows(x[1], items)[1]]
        assert out.columns == columns
        assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted(rows)
        assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        docs = out


def test_rows_are_parted_in_one_pass_whatever_the_number_of_parts():
    from docmosaic.llm.kneser_ney import _parted

    r = np.random.default_rng(2)
    for most in (1, 5, 40_000, 70_000):
        part = r.integers(0, most, 3000)
        found = dict(_parted(part))
        assert sorted(found) == np.unique(part).tolist()
        assert all((rows == np.flatnonzero(part == p)).all() for p, rows in found.items())
    assert list(_parted(np.zeros(0, np.int64))) == []
