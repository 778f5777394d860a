"""Products end to end through the command line, on a small corpus."""

import json

import pytest
from pyspark.sql import functions as F

from docmosaic import cli
from docmosaic.functions.text import normalize
from docmosaic.plans import catalog, products
from docmosaic.sources.progress import Progress
from docmosaic.sources.store import ChunkStore

CORPUS = """# 1 - Clubs.
Club means a club that plays in a competition and keeps to the rules of the game;
Every club shall register its players before the season starts and answer for them.

# 2 - Officials.
Match Official means a person appointed to control a match under the rules;
A match official reports to the authority after each match of the season.
"""
MODEL = {
    "metadata": {"model_name": "m"},
    "entities": [
        {"domain": "party", "subtype": "Org", "entity_name": "Club", "fact_sheet_id": "f1"},
        {"domain": "party", "subtype": "", "entity_name": "Referee", "fact_sheet_id": "f2"},
        {"domain": "asset", "subtype": "", "entity_name": "Zeppelin", "fact_sheet_id": ""},
    ],
    "relationships": [{"source_entity": "Club", "target_entity": "Referee", "relationship_type": "asks", "cardinality": "0..*-1..1"}],
}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "hb.md").write_text(CORPUS)
    (tmp_path / "ingest.yaml").write_text(f"collection_prefix: hb\nfile_paths: [{tmp_path}/hb.md]\n")
    (tmp_path / "batch.yaml").write_text("file_paths: [ingest.yaml]\n")
    (tmp_path / "model.json").write_text(json.dumps(MODEL))
    (tmp_path / "inv.json").write_text(json.dumps({"fact_sheets": {"f1": {"type": "DataObject", "name": "Club", "description": "a club"}}}))
    (tmp_path / "aliases.yaml").write_text("referee: [match official]\n")
    (tmp_path / "cfg.yaml").write_text("store: {chunks_table: p_chunks, ledger_table: p_hashes}\n")
    (tmp_path / "found.json").write_text(json.dumps([{"term": "club"}, {"term": "Season"}]))

    def run(*argv):
        cli.run(spark, cli.parser().parse_args(["--config", str(tmp_path / "cfg.yaml"), *map(str, argv)]))
        return capsys.readouterr().out

    assert run("configs", tmp_path).split() == ["aliases", "batch", "cfg", "ingest"]
    assert "2 chunks" in run("ingest", tmp_path / "batch.yaml")
    assert "0 chunks" in run("ingest", tmp_path / "batch.yaml")
    assert "hb_s01" in run("status") and "TOTAL" in run("status")
    assert "register" in run("query", "-q", "who shall register players", "--collection", "hb_s01")
    both = run("query", "-q", "who shall register players", "-q", "players registration", "--iterative")
    assert "[hb_s01]" in both and "register" in both
    model, out = ("--model-json", tmp_path / "model.json"), ("--output-dir", tmp_path / "out")
    run("catalog", *model, "--inventory-json", tmp_path / "inv.json", "--aliases", tmp_path / "aliases.yaml", *out)
    rows = {r.entity_name: r for r in spark.read.json(str(tmp_path / "out/catalog")).collect()}
    assert rows["Club"].source == "BOTH" and rows["Club"].mapping_confidence == "high" and rows["Club"].n_relationships == 1
    assert rows["Club"].formal_definition.startswith("a club that plays")
    assert rows["Referee"].source == "BOTH" and rows["Referee"].handbook_term == "Match Official"
    nested = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out/nested")).collect()]
    assert {(p["domain"], p["branch"], e["entity_name"]) for p in nested for e in p["entities"] if e["source"] != "HANDBOOK_ONLY"} == {
        ("PARTY", "subtypes", "Club"), ("PARTY", "entities", "Referee"), ("ASSET", "entities", "Zeppelin")}
    assert spark.read.json(str(tmp_path / "out/relationships")).count() == 1 and not (tmp_path / "out/_progress").exists()
    assert rows["Zeppelin"].source == "LEANIX_ONLY" and rows["Zeppelin"].leanix_description.startswith("Not documented")
    run("catalog", *model, "--inventory-json", tmp_path / "inv.json", "--agentic", "--domain", "party", "--output-dir", tmp_path / "ag")
    assert {r.entity_name for r in spark.read.json(str(tmp_path / "ag/catalog")).collect()} == {"Club", "Referee"}
    cli.chat(spark, ["who registers players", "/history", "/graph Club", "/reset", "/what", "/exit", "never"], ChunkStore(spark, "p_chunks", "p_hashes").chunks(), cli.Config().query)
    said = capsys.readouterr().out
    assert "USER: who registers players" in said and "unknown command /what" in said and "never" not in said
    assert "verdict" in run("coverage", *model, *out, "--gap-analysis", "--handbook-json", tmp_path / "found.json")
    gap = {r.normalized_name: r.status for r in spark.read.json(str(tmp_path / "out/gap")).collect()}
    assert gap == {"club": "MATCHED", "season": "HANDBOOK_ONLY", "referee": "MODEL_ONLY", "zeppelin": "MODEL_ONLY"}
    assert "TOTAL" in run("validate", *model)
    assert json.loads(run("graph", *model, "Club"))["neighbors"][0]["relationship_type"] == "asks"
    for ranker in ("embedding", "bm25", "boosted"):
        assert "INCLUDED" in run("diagnose", "--entity", "club", "--ranker", ranker)
    assert run("delete", "hb").split() == ["would", "drop", "hb", "hb_s01", "hb_s02"]
    run("delete", "hb", "--force")
    assert ChunkStore(spark, "p_chunks", "p_hashes").collections() == []


def test_resume_keeps_finished_contexts(spark):
    chunks = spark.createDataFrame([("s", 1, "the club of the town " * 10)], "collection string, chunk_id bigint, text string")
    entities = spark.createDataFrame([(1, "Club", "P"), (2, "Town", "P")], "ord bigint, entity_name string, domain string")
    for c in ("domain_fact_sheet_id", "subgroup", "subgroup_fact_sheet_id", "fact_sheet_id"):
        entities = entities.withColumn(c, F.lit(""))
    none = spark.createDataFrame([], "canonical string, alias string")
    defs = spark.createDataFrame([], "term string, definition string")
    done = products.contexts(entities.where("ord = 1"), chunks, none, defs).withColumn("domain_context", F.lit("kept"))
    asked = []

    def answer(rows):
        asked.extend(r.entity_name for r in rows.select("entity_name").collect())
        return rows.withColumn("response", F.col("evidence"))

    got = products.consolidated_catalog(
        entities, spark.createDataFrame([], "id string, type string, description string, level string, status string"), chunks,
        spark.createDataFrame([], "source_entity string"), none, spark.createDataFrame([], "entity_name string"), answer, done=done,
    )
    assert {r.entity_name: r.domain_context for r in got.collect()} == {"Club": "kept", "Town": ""}
    assert asked == ["Town"]


def test_progress_goes_on_after_a_stop(spark, tmp_path, rows):
    items = spark.range(60).select(F.concat(F.lit("k"), "id").alias("key"), "id").repartition(3)
    want = rows(items.select("key", (F.col("id") * 2).alias("twice")))
    progress = Progress(spark, str(tmp_path / "progress"))
    seen = []

    def step(batch):
        seen.append({r.key for r in batch.collect()})
        if len(seen) == 2:
            raise RuntimeError("lost")
        return batch.select("key", (F.col("id") * 2).alias("twice"))

    with pytest.raises(RuntimeError, match="lost"):
        progress.run(items, "key", step, batch_rows=15)
    assert len(seen) == 4 and len(progress.batches()) == 3  # the batch after the failing one was finished
    (tmp_path / "progress/_open-broken").mkdir()  # what a run that was killed leaves behind
    lost = seen[1]
    assert rows(progress.run(items, "key", step, batch_rows=1000)) == want and seen[4:] == [lost]
    assert rows(progress.run(items, "key", step)) == want and len(seen) == 5
    progress.clear()
    assert progress.done() is None
    assert progress.run(items.where("false"), "key", step).columns == ["key", "twice"]


def test_catalog_resumes_with_equal_output(spark, tmp_path, rows):
    text = "the club of the town and the river of the hill " * 10
    chunks = spark.createDataFrame([("s", k, text) for k in range(3)], "collection string, chunk_id bigint, text string")
    entities = spark.createDataFrame([(k, n, "P") for k, n in enumerate(("Club", "Town", "River", "Hill", "club"))], "ord bigint, entity_name string, domain string")
    for c in ("domain_fact_sheet_id", "subgroup", "subgroup_fact_sheet_id", "fact_sheet_id"):
        entities = entities.withColumn(c, F.lit(""))
    none = spark.createDataFrame([], "canonical string, alias string")
    rest = (
        spark.createDataFrame([], "id string, type string, description string, level string, status string"), chunks,
        spark.createDataFrame([], "source_entity string"), none, spark.createDataFrame([], "entity_name string"))
    calls = []

    def provider(some, *_):
        calls.append(some.count())
        if len(calls) == 2:
            raise RuntimeError("lost")
        key = normalize(F.col("entity_name")).alias("entity_key")
        return some.select(key, *[F.lit("told").alias(c) for c in catalog.CONTEXT]).distinct()

    progress = Progress(spark, str(tmp_path / "progress"))
    with pytest.raises(RuntimeError):
        products.consolidated_catalog(entities, *rest, provider=provider, progress=progress, batch_rows=2)
    kept = progress.done().count()
    assert 0 < kept < 4
    resumed = products.consolidated_catalog(entities, *rest, provider=provider, progress=progress, batch_rows=2)
    assert sum(calls) == 5 + calls[1]
    assert rows(resumed) == rows(products.consolidated_catalog(entities, *rest, provider=provider))
    assert progress.done().count() == 4  # names that are equal after normalising share a context
