"""Vector search by cells: exact without probes, recall with few, edges of the input."""

import numpy as np
import pytest

from docmosaic.operators import cells
from docmosaic.operators.cells import CellIndex


def brute(vectors, queries, k):
    unit = lambda m: m / (np.sqrt((m * m).sum(-1, keepdims=True)) + 1e-9)
    out = {}
    names = sorted(vectors)
    rows = unit(np.array([np.float32(vectors[n]) for n in names], np.float64))
    for q, v in queries.items():
        scores = np.round(unit(np.array(v, np.float64)) @ rows.T, 9)
        out[q] = [names[i] for i in sorted(range(len(names)), key=lambda i: (-scores[i], names[i]))[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.chunk_id)
    return out


@pytest.fixture(scope="module")
def data():
    """Clusters, one of them with a third of all vectors, copies and zero vectors."""
    r = np.random.default_rng(5)
    middles = r.normal(size=(30, 16))
    which = np.where(r.random(3000) < 1 / 3, 0, r.integers(0, 30, 3000))
    rows = (middles[which] + 0.25 * r.normal(size=(3000, 16))).round(3)
    rows[100:140] = rows[7]
    rows[200:203] = 0
    vectors = {int(i) * 3: [float(x) for x in v] for i, v in enumerate(rows)}
    queries = {f"q{i}": [float(x) for x in rows[i * 50] + 0.05 * r.normal(size=16)] for i in range(60)}
    queries |= {"copy": vectors[21], "zero": [0.0] * 16, "far": [float(x) for x in -middles[3]]}
    return vectors, queries


@pytest.fixture(scope="module")
def tables(spark, data):
    vectors, queries = data
    v = spark.createDataFrame([*vectors.items(), (-1, None), (-2, [])], "chunk_id bigint, embedding array<float>").repartition(5)
    q = spark.createDataFrame([*queries.items(), ("null", None), ("empty", [])], "query_id string, embedding array<double>")
    return v, q


def test_no_probes_is_exact(spark, data, tables, monkeypatch, tmp_path):
    want = brute(*data, 12)
    index = CellIndex(tables[0], path=str(tmp_path / "cells"))
    assert len(index.cells) > 20 and index.vectors.count() == len(data[0])
    assert found(index.search(tables[1], 12)) == want
    again = CellIndex.open(spark, str(tmp_path / "cells"))
    monkeypatch.setattr(cells, "BLOCK_QUERIES", 20)
    monkeypatch.setattr(cells, "TILE", 7)
    assert found(again.search(tables[1], 12)) == want


def test_an_exact_search_leaves_cells_closed(data, tables, monkeypatch):
    opened = []
    scan = CellIndex._scan
    monkeypatch.setattr(CellIndex, "_scan", lambda self, ids, kind, m, o, k: (opened.append(o), scan(self, ids, kind, m, o, k))[1])
    near = tables[1].where("query_id like 'q%'")
    assert found(CellIndex(tables[0]).search(near, 3)) == {q: v for q, v in brute(*data, 3).items() if q.startswith("q")}
    assert sum(o.sum() for o in opened) < 0.9 * opened[0].size


def test_recall_of_four_probes(data, tables):
    want = brute(*data, 10)
    got = found(CellIndex(tables[0]).search(tables[1].where("query_id like 'q%'"), 10, probes=4))
    hits = [len(set(got[q]) & set(want[q])) / 10 for q in want if q.startswith("q")]
    assert np.mean(hits) >= 0.9


def test_edges(spark, tables):
    v, q = tables
    empty = CellIndex(v.where("false"))
    assert empty.search(q, 3).count() == 0
    assert CellIndex(v).search(q.where("false"), 3).count() == 0
    few = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 0.0])], "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(1, [2.0, 0.0])], "query_id int, embedding array<float>")
    assert [tuple(r) for r in CellIndex(few).search(asked, 9).orderBy("rank").select("query_id", "chunk_id", "rank").collect()] == [(1, "a", 1), (1, "b", 2), (1, "c", 3)]
    zeros = few.where("chunk_id = 'c'")
    assert found(CellIndex(zeros).search(asked, 1)) == {1: ["c"]}
