"""The splitters from SQL give what the DataFrame functions give."""

import pytest
from pyspark.errors import AnalysisException

from docmosaic.functions import splitters
from docmosaic.operators import chunking


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["A first sentence. Another one! " * 60, "| a | b |\n|---|---|\n| 1 | 2 |\n\nprose after", "", None, "one", "x" * 3000, "a | b\n" * 500]
    table = spark.createDataFrame([(k, f"c{k % 2}", t, -1) for k, t in enumerate(texts)], "doc_id int, collection string, text string, pos int")
    table.createOrReplaceTempView("split_docs")
    splitters.register(spark)
    return table.drop("pos")


def plain(df):
    return sorted((tuple(r) for r in df.select("doc_id", "collection", "pos", "content_type", "text").collect()), key=str)


@pytest.mark.parametrize("call, want", [
    ("table_chunks(TABLE(split_docs))", lambda d: chunking.table_chunks(d)),
    ("table_chunks(TABLE(split_docs), 20)", lambda d: chunking.table_chunks(d, 20)),
    ("sentence_chunks(TABLE(split_docs))", lambda d: chunking.chunk(d, chunking.ChunkSettings("sentence"))),
    ("sentence_chunks(TABLE(split_docs), 50, 0)", lambda d: chunking.chunk(d, chunking.ChunkSettings("sentence", 50, 0))),
    ("document_chunks(TABLE(split_docs), 'table_aware')", lambda d: chunking.chunk(d)),
])
def test_functions_agree(spark, docs, call, want):
    assert plain(spark.sql(f"SELECT * FROM {call}")) == plain(want(docs))


def test_lateral_join(spark, docs):
    rows = spark.sql("SELECT d.doc_id, s.pos, s.text FROM split_docs d, LATERAL sentences_of(d.text, 50, 0) s").collect()
    want = chunking.chunk(docs, chunking.ChunkSettings("sentence", 50, 0)).select("doc_id", "pos", "text").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want))


def test_partitions_are_packed_in_order(spark):
    spark.createDataFrame([(k % 2, k, f"text {k}") for k in range(12)], "g int, n int, text string").repartition(5).createOrReplaceTempView("small_texts")
    splitters.register(spark)
    got = spark.sql("SELECT * FROM packed_chunks(TABLE(small_texts) PARTITION BY g ORDER BY (n), 5)")
    assert got.columns == ["g", "n", "pos", "content_type", "text"]
    rows = {}
    for r in got.collect():
        rows.setdefault(r.g, {})[r.pos] = (r.n, r.text)
    for g in (0, 1):
        texts = [rows[g][p][1] for p in sorted(rows[g])]
        assert "\n".join(texts) == "\n".join(f"text {k}" for k in range(12) if k % 2 == g)
        assert [rows[g][p][0] for p in sorted(rows[g])] == sorted(n for n, _ in rows[g].values()) and len(texts) == 2


def test_wrong_arguments_are_refused(spark, docs):
    for call in ("table_chunks(TABLE(split_docs), 0)", "sentence_chunks(TABLE(split_docs), 5, -1)", "document_chunks(TABLE(split_docs), 'none')",
                 "table_chunks(TABLE(SELECT doc_id FROM split_docs))"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM {call}").collect()
