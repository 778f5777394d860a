"""From raw documents to pieces: five stages, each reading all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result
to the shared folder and reads it back for the next. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmosaic.llm import decontaminate, lines, ngram_join, pieces, quality
from docmosaic.llm.common import fresh, table
from docmosaic.session import materialize

LEAST_QUALITY = 0.3
LINE_DOCS = 10
SHINGLE_WORDS, LEAST_JACCARD = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network rejects go; a null text is judged as an empty one."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")), least=LEAST_QUALITY)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a line found in ten documents or more only the first occurrence stays; ``n_chars`` follows the text. A null text becomes empty."""
    kept = lines.dedup_lines(docs, min_docs=LINE_DOCS, keep="first", counts=(fresh(docs, "lines"), fresh(docs, "dropped")))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, by runs of five words at a Jaccard similarity of 0.8, the one with the smallest id stays."""
    return ngram_join.keep_one(docs, size=SHINGLE_WORDS, least=LEAST_JACCARD)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, sample, n_pieces, ids, log_prob, inclusion, exact) of what is left."""
    found = pieces.sample_pieces(docs)
    return found.select(
        F.col("id").alias("doc_id"), "sample", F.size("ids").alias("n_pieces"), "ids", "log_prob", "inclusion", "exact"
    )


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: A network and sampled segmentations are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``, read back from where the last one wrote it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
