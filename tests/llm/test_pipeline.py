"""The pipeline's stages on fixtures of their own."""

from pyspark.sql import functions as F

import corpus_pipeline
from docmosaic.llm.common import table
from tests.conftest import DATA
from tests.llm.test_filters import brute_components, brute_lines, brute_windows


def test_one_of_twelve_exact_copies_reaches_the_last_stage(spark):
    copy = "\n".join(f"In the {k}th year the harbour of town {k} was dredged and its {k} piers were built anew." for k in range(8))
    other = "\n".join(f"Nobody in valley {k} recalls who planted orchard {k} beside the old mill there." for k in range(8))
    schema = table(spark, str(DATA), "documents").schema
    rows = [(10 + k, copy) for k in range(12)] + [(50, other), (51, copy.split("\n")[0] + "\n" + other[::-1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs = docs.select(*[
        F.col(f.name).cast(f.dataType) if f.name in docs.columns
        else (F.length("text") if f.name == "n_chars" else F.lit("x")).cast(f.dataType).alias(f.name) for f in schema])
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(DATA)), name)
        if name == "line_dedup":
            got = sorted((str(r["doc_id"]), r["text"]) for r in docs.collect())
            assert got == brute_lines(rows, corpus_pipeline.LINE_DOCS, "first")
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [i for i, t in got.items() if t == copy] == [10]
    assert sum(t.count(copy.split("\n")[0]) for t in got.values()) == 1 and got[50] == other


def test_stages_agree_with_plain_python_where_first_lines_stay(spark):
    folder = str(DATA)
    docs = table(spark, folder, "documents")
    items = [(r["item_id"], r["text"]) for r in table(spark, folder, "benchmark").collect()]
    stages = dict(corpus_pipeline.STAGES)
    docs = corpus_pipeline.materialize(stages["quality_classifier"](spark, docs, folder), "quality")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for name in ("line_dedup", "ngram_jaccard_join", "benchmark_decontamination"):
        docs = corpus_pipeline.materialize(stages[name](spark, docs, folder), name)
        if name == "line_dedup":
            rows = [(int(i), t) for i, t in brute_lines(rows, 10, "first")]
        elif name == "ngram_jaccard_join":
            kept = {i for i, _, c in brute_components(rows, 5, 80) if i == c}
            rows = [x for x in rows if x[0] in kept]
        else:
            rows = [x for x in rows if not brute_windows(x[1], items)[1]]
        got = docs.collect()
        assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(rows)
        assert all(r["n_chars"] == len(r["text"]) for r in got)
