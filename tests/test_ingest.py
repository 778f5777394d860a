"""Sources, store, ingestion, agent rounds, builder, streaming and configuration."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docmosaic import config
from docmosaic.functions.embedding import embed
from docmosaic.operators.chunking import ChunkSettings
from docmosaic.plans import agent, builder, ingest
from docmosaic.sources import catalog, diagram, documents, hashes, inventory, writers, xlsx
from docmosaic.sources.profiles import QueryProfile, profile_collections
from docmosaic.sources.store import ChunkStore
from docmosaic.streaming import incremental
from docmosaic.streaming import memory as stream_memory

XML = """<mxfile><diagram><mxGraphModel><root>
<mxCell id="0"/><mxCell id="1" parent="0"/>
<mxCell id="g1" style="group" vertex="1" parent="1"/>
<object id="a0" label="PARTY" type="factSheet" factSheetType="DataObject" factSheetId="f0"><mxCell style="x" vertex="1" parent="g1"><mxGeometry width="500" height="400"/></mxCell></object>
<object id="g2" label="Nested box" type="factSheet" factSheetId="n0"><mxCell style="swimlane;group;" vertex="1" parent="g1"/></object>
<object id="a1" label="&lt;b&gt;Club&lt;/b&gt;" type="factSheet" factSheetType="DataObject" factSheetId="f1"><mxCell style="x" vertex="1" parent="g2"><mxGeometry x="1.5" y="2" width="102" height="40"/></mxCell></object>
<object id="a2" label="Player" type="factSheet" factSheetId="f2"><mxCell style="x" vertex="1" parent="g1"/></object>
<object id="n1" label="note" type="text"><mxCell style="x" vertex="1" parent="g1"/></object>
<mxCell id="e1" edge="1" source="a1" target="a2" style="edgeStyle=entityRelationEdgeStyle;startArrow=ERoneToOne;endArrow=ERzeroToMany;" parent="1"/>
<mxCell id="e2" edge="1" source="a1" target="gone" style="x" parent="1"/>
</root></mxGraphModel></diagram></mxfile>"""


def test_diagram(spark, tmp_path):
    path = tmp_path / "model.xml"
    path.write_text(XML)
    objects, cells = diagram.read_objects(spark, str(path)), diagram.read_cells(spark, str(path))
    groups = diagram.group_cells(objects, cells)
    assert {tuple(r) for r in groups.collect()} == {("g1", "1"), ("g2", "g1")}
    assets = diagram.assets(objects).join(groups.select("id"), "id", "left_anti")
    by_id = {r.id: r for r in assets.collect()}
    assert set(by_id) == {"a0", "a1", "a2"}
    assert by_id["a1"].label == "Club" and by_id["a1"].x == 1.5 and by_id["a0"].x is None
    assert by_id["a2"].fact_sheet_type == "Unknown"
    children = assets.withColumn("ord", F.col("id"))
    labels = diagram.group_labels(children)
    assert {(r.id, r.label) for r in labels.collect()} == {("g1", "PARTY"), ("g2", "Club")}
    placed = diagram.resolve_groups(assets, groups.join(labels, "id"))
    assert {(r.id, r.domain, r.subgroup) for r in placed.collect()} == {("a0", "PARTY", ""), ("a1", "PARTY", "Club"), ("a2", "PARTY", "")}
    rels = diagram.relationships(cells, placed).collect()
    assert [(r.source_entity, r.target_entity, r.relationship_type, r.cardinality) for r in rels] == [("Club", "Player", "Entity Relationship", "1..1-0..*")]
    records = diagram.model_json(placed.select("id"), diagram.relationships(cells, placed).select("edge_id"), "m", "model.xml")
    meta = json.loads(records.where("kind = 'metadata'").first().json)
    assert meta["entity_count"] == 3 and meta["relationship_count"] == 1


def test_model_document(spark, tmp_path):
    doc = {"metadata": {"model_name": "m"}, "entities": [{"domain": "party", "subtype": "Org", "entity_name": "Club"}], "relationships": [{"source_entity": "Club", "target_entity": "Player"}]}
    path = tmp_path / "m_model.json"
    path.write_text(json.dumps(doc, indent=1))
    entities, relations = diagram.read_model(spark, str(path))
    row = entities.first()
    assert (row.domain, row.subgroup, row.fact_sheet_id) == ("PARTY", "Org", "")
    assert relations.first().target_entity == "Player"


def test_inventory_document(spark, tmp_path):
    path = tmp_path / "i.json"
    path.write_text(json.dumps({"metadata": {}, "fact_sheets": {"x": {"type": "Provider", "name": "N", "description": "d"}}}))
    assert tuple(inventory.read_json(spark, str(path)).select("id", "type", "name").first()) == ("x", "Provider", "N")
    assert inventory.read_json(spark, str(tmp_path / "none.json")).count() == 0


def workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = (
        f'<worksheet {ns}><sheetData><row r="1">{cell("A1", "id")}{cell("C1", "type")}</row>'
        f'<row r="2">{cell("A2", "f1")}<c r="B2"><v>7</v></c><c r="C2" t="s"><v>0</v></c></row><row r="3"></row>'
        f'<row r="4">{cell("C4", "Other")}</row></sheetData></worksheet>'
    )
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="ReadMe" r:id="r1"/><sheet name="Data" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/s2.xml", sheet)
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Provider</t></si></sst>")


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "w.xlsx")
    xlsx.register(spark)
    df = spark.read.format("workbook").load(str(tmp_path / "*.xlsx"))
    assert df.columns == ["id", "col_1", "type"]
    assert [tuple(r) for r in df.collect()] == [("f1", "7", "Provider"), (None, None, "Other")]
    assert inventory.typed(df.withColumn("name", F.col("id")), "inv").first().collection == "inv_provider"


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\ntext")
    (tmp_path / "b.html").write_text("<html><style>x</style><p>Hello&nbsp;<b>you</b></p></html>")
    (tmp_path / "c.pdf").write_bytes(b"good")
    (tmp_path / "d.pdf").write_bytes(b"bad")

    def parser(content):
        if content == b"bad":
            raise ValueError("broken file")
        return content.decode().upper()

    paths = [str(tmp_path / n) for n in ("a.md", "b.html", "c.pdf", "d.pdf")]
    got = {r.path.rsplit("/", 1)[1]: r.text for r in documents.read_documents(spark, paths, {".pdf": parser}).collect()}
    assert got == {"a.md": "# A\ntext", "b.html": "Hello you", "c.pdf": "GOOD", "d.pdf": None}
    with pytest.raises(ValueError):
        documents.read_documents(spark, [str(tmp_path / "e.docx")])


def test_missing_paths_fall_back(tmp_path):
    (tmp_path / "x.txt").write_text("x")
    found = documents.resolve_paths(["/nowhere/x.txt", "/nowhere/y.txt"], str(tmp_path))
    assert found == ([str(tmp_path / "x.txt")], ["/nowhere/y.txt"])


def test_names_that_urls_would_encode(spark, tmp_path):
    store = ChunkStore(spark, "u_chunks", "u_hashes")
    names = ["x y.md", "a%20b.md", "ü+ä.md", "p%q.md"]
    for n in names:
        (tmp_path / n).write_text(f"text of {n}")
    cfg = ingest.IngestConfig([str(tmp_path / n) for n in names], "odd")
    assert ingest.ingest(spark, cfg, store) == 4
    assert {r.text for r in store.chunks().collect()} == {f"text of {n}" for n in names}
    assert ingest.ingest(spark, cfg, store) == 0


def test_split_configs_delete_rebuild_and_empty(spark, tmp_path):
    store = ChunkStore(spark, "v_chunks", "v_hashes")
    pad = "words " * 40
    f, g = tmp_path / "f.md", tmp_path / "g.md"
    f.write_text(f"# 1 - One\n{pad}\n# 2 - Two\n{pad}\n")
    g.write_text("no headings here at all")
    cfg = ingest.IngestConfig([str(f), str(g)], collection_prefix="sp")
    other = ingest.IngestConfig([str(g)], "sp_other")
    assert ingest.ingest(spark, cfg, store) > 0 and ingest.ingest(spark, other, store) == 1
    had = store.collections()
    assert "sp" in had and len([c for c in had if c.startswith("sp_s")]) == 2  # the headless document stays whole
    # deleted, then ingested again
    store.drop_prefix("sp", confirm=True)
    assert store.collections() == [] and ingest.ingest(spark, cfg, store) > 0
    assert store.collections() == [c for c in had if c != "sp_other"]
    ingest.ingest(spark, other, store)
    # a rebuild drops a section that is gone, and nothing of another config
    f.write_text(f"# 1 - One\n{pad}\n")
    ingest.ingest(spark, ingest.IngestConfig([str(f), str(g)], collection_prefix="sp", rebuild=True), store)
    assert len([c for c in store.collections() if c.startswith("sp_s")]) == 1 and "sp_other" in store.collections()
    # a file that was emptied loses its chunks and is not asked for again
    g.write_text("")
    ingest.ingest(spark, cfg, store)
    assert "sp" not in store.collections() and ingest.ingest(spark, cfg, store) == 0


def test_relationship_lists_beside_documents(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"relationships": [{"source_entity": "a", "target_entity": "b"}], "entities": []}')
    (tmp_path / "l.json").write_text('[{"source_entity": "c", "target_entity": "d"}]')
    from docmosaic.sources import diagram

    got = diagram.read_relationships(spark, [str(tmp_path / "m.json"), str(tmp_path / "l.json")])
    assert {(r.source_entity, r.target_entity) for r in got.collect()} == {("a", "b"), ("c", "d")}


def test_ingest_and_store(spark, tmp_path):
    store = ChunkStore(spark, "t_chunks", "t_hashes")
    a, b = tmp_path / "a.md", tmp_path / "b.md"
    a.write_text("Club means a club.\n|x|y|\n|z|w|")
    b.write_text("Players play.")
    cfg = ingest.IngestConfig([str(a), str(b)], "hb_one", metadata={"domain": "game"})
    assert ingest.ingest(spark, cfg, store) == 3  # prose and table rows of one file, prose of the other
    assert ingest.ingest(spark, cfg, store) == 0  # nothing changed
    row = store.chunks(["hb_one"]).where("content_type = 'table_row'").first()
    assert row.metadata["domain"] == "game" and row.metadata["source_file"].endswith("a.md") and len(row.embedding) == 64
    b.write_text("Players play.\n\nAnd rest.")
    assert ingest.ingest(spark, cfg, store) >= 1
    assert "Players play.\n\nAnd rest." in {r.text for r in store.chunks(["hb_one"]).collect()}
    assert store.chunks(["hb_one"]).where("content_type = 'table_row'").count() == 1  # the unchanged file stayed
    pad = "words " * 40
    a.write_text(f"# 1 - Start\n{pad}\n# 2 - End\n{pad}")
    split = ingest.IngestConfig([str(a)], collection_prefix="hb")
    assert ingest.ingest(spark, split, store) > 0
    assert store.collections("hb") == ["hb_one", "hb_s01", "hb_s02"]
    a.write_text(f"# 2 - End\n{pad}")
    assert ingest.ingest(spark, split, store) > 0
    assert store.collections("hb") == ["hb_one", "hb_s02"]  # a section that is gone leaves no chunks
    a.write_text(f"# 1 - Start\n{pad}\n# 2 - End\n{pad}")
    ingest.ingest(spark, split, store)
    total = store.status().where("collection = 'TOTAL'").first()
    assert total.n_chunks == total.n_indexed == store.chunks().count() and total.missing == 0
    assert {r.collection: r.n_files for r in hashes.counts(store.ledger()).collect()}["hb_one"] == 2
    assert store.drop_prefix("hb_s01") == ["hb_s01"] and len(store.collections()) == 3
    store.drop_prefix("hb_s01", confirm=True)
    store.drop("hb_one")
    assert store.collections() == ["hb_s02"] and store.chunks(["hb_one"]).count() == 0
    assert "hb_one" not in {r.collection for r in store.ledger().collect()}
    store.drop_all(confirm=True)
    assert store.collections() == []
    with pytest.raises(ValueError):
        ingest.ingest(spark, ingest.IngestConfig([]), store)


def test_preprocessors():
    ingest.register_preprocessor("upper", lambda docs: docs)
    assert ingest.get_preprocessor("upper") and ingest.get_preprocessor(None)
    assert ingest.get_preprocessor("docmosaic.sources.catalog:list_collections") is catalog.list_collections
    with pytest.raises(ValueError):
        ingest.get_preprocessor("unknown")


def test_changed_files(spark, rows):
    files = spark.createDataFrame([("c", "a", "1"), ("c", "b", "2"), ("c", "x", None), ("d", "a", "1")], "collection string, file_path string, hash string")
    ledger = spark.createDataFrame([("c", "a", "1"), ("c", "b", "0"), ("c", "x", "9")], "collection string, file_path string, hash string")
    assert rows(hashes.changed(files, ledger).select("collection", "file_path")) == [("c", "b"), ("c", "x"), ("d", "a")]
    assert rows(hashes.upsert(ledger, files)) == [("c", "a", "1"), ("c", "b", "2"), ("c", "x", "9"), ("d", "a", "1")]


def test_emptied_files_leave_the_ledger(spark, rows):
    schema = "collection string, file_path string, hash string"
    ledger = spark.createDataFrame([("c", "a", "1"), ("c", "b", "0"), ("d", "b", "4")], schema)
    emptied = spark.createDataFrame([("c", "b")], "collection string, file_path string")
    files = spark.createDataFrame([("c", "a", None)], schema)
    assert rows(hashes.upsert(ledger, files, emptied)) == [("c", "a", "1"), ("d", "b", "4")]


def test_unreadable_files_are_tried_again(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"a first text of the club")
    (tmp_path / "b.pdf").write_bytes(b"another text of the season")
    config = ingest.IngestConfig.from_dict({"collection_name": "retry", "file_paths": [str(tmp_path / "a.pdf"), str(tmp_path / "b.pdf")]})
    store = ChunkStore(spark, "retry_chunks", "retry_hashes")

    def parser(broken):
        def parse(content):
            if broken in content:
                raise ValueError("broken file")
            return content.decode()

        return {".pdf": parse}

    texts = lambda: sorted(r.text for r in store.chunks().collect())
    assert ingest.ingest(spark, config, store, parsers=parser(b"season")) == 1
    assert store.ledger().count() == 1 and texts() == ["a first text of the club"]
    assert ingest.ingest(spark, config, store, parsers=parser(b"nothing")) == 1
    assert store.ledger().count() == 2 and len(texts()) == 2
    (tmp_path / "b.pdf").write_bytes(b"the season was changed")
    assert ingest.ingest(spark, config, store, parsers=parser(b"season")) == 0
    assert store.ledger().count() == 2 and "another text of the season" in texts()  # what was readable stays
    assert ingest.ingest(spark, config, store, parsers=parser(b"nothing")) == 1
    assert texts() == ["a first text of the club", "the season was changed"]


def test_embedding_is_deterministic(spark):
    df = spark.createDataFrame([("the Club",), ("THE club",), ("",)], "t string").select(embed(F.col("t")).alias("e"))
    a, b, c = [r.e for r in df.collect()]
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-6 and set(c) == {0.0}


def test_profiles(spark):
    chunks = spark.createDataFrame([("b_1",), ("a_1",), ("a_2",), ("c",)], "collection string")
    profile = QueryProfile.from_dict({"collections": [{"name": "c"}, "a_2", "gone"], "collection_prefixes": ["b", "a"], "query": {"similarity_top_k": 12}})
    got = [r.collection for r in profile_collections(chunks, profile).orderBy("position").collect()]
    assert got == ["c", "a_2", "b_1", "a_1"] and profile.similarity_top_k == 12


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("chunking: {strategy: sentence, table_chunk_size: 99}\nquery: {rerank_k: 3, nonsense: 1}\nstore: {output_dir: out}\n")
    c = config.Config.from_yaml(path)
    assert c.chunking == ChunkSettings("sentence", table_chunk_size=99) and c.query.rerank_k == 3
    assert c.store.output_dir == str(tmp_path / "out") and config.Config.from_dict(c.to_dict()) == c
    batch = tmp_path / "b.yml"
    batch.write_text("file_paths: [c.yaml, /x/d.yaml]\n")
    assert config.load_batch(batch) == [str(tmp_path / "c.yaml"), "/x/d.yaml"] and config.load_batch(path) is None
    (tmp_path / "todo_later.yaml").write_text("")
    assert config.list_configs(tmp_path) == ["b", "c"]
    assert config.sidecar("/x/model.xml", "_model.json") == "/x/model_model.json"


def test_writers(spark, tmp_path):
    s = spark.createDataFrame([("party", "# PARTY\n")], "section_key string, markdown string")
    writers.write_sections(s, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s"), wholetext=True).count() == 1
    with pytest.raises(ValueError):
        writers.write_model(s, str(tmp_path / "m"), "pdf")
    rank = spark.createDataFrame([(1, 1, "INCLUDED", 0.5, "c", "text")], "query_id int, rank int, status string, score double, collection string, preview string")
    assert "INCLUDED" in writers.report_lines(rank).first().line


# --- rounds, builder, streams -----------------------------------------------------


def _agent(spark, policy=agent.always_done):
    body = "the club shall keep its rules in good order and answer for them " * 3
    chunks = spark.createDataFrame([("s", 1, body), ("s", 2, "No information available about prefixed-coaches. " + "x" * 80)], "collection string, chunk_id bigint, text string")
    variants = spark.createDataFrame([(1, 0, "club"), (2, 0, "coach"), (2, 1, "coaches"), (3, 0, "ghost")], "entity_id bigint, pos int, variant string")
    entities = variants.where("pos = 0").select("entity_id", F.col("variant").alias("name"))
    trace = agent.run(agent.Corpus(chunks), entities, variants, policy)[0].orderBy("entity_id", "iteration").collect()
    out = {}
    for r in trace:
        out.setdefault(r.entity_id, []).append((r.action, r.has_content))
    return out


def test_rounds_force_one_keyword_scan(spark):
    got = _agent(spark)
    assert got[1] == [("RETRIEVE", True), ("DONE", False)]
    assert got[2] == [("RETRIEVE", False), ("KEYWORD", True), ("DONE", False)]
    assert got[3] == [("RETRIEVE", False), ("KEYWORD", False), ("DONE", False)]


def test_rounds_are_bounded(spark):
    stubborn = lambda state: state.withColumn("said", F.lit('RETRIEVE query: "club"'))
    got = _agent(spark, stubborn)
    assert all(len(v) == agent.MAX_ITERATIONS and {a for a, _ in v} == {"RETRIEVE"} for v in got.values())


def test_gate_sends_only_failures_to_the_fallback(spark):
    answers = spark.createDataFrame([(1, "Section 4 " + "x" * 200), (2, "short")], "entity_id bigint, response string")
    asked = []

    def fallback(failing):
        asked.extend(r.entity_id for r in failing.collect())
        return failing.withColumn("response", F.lit("slow"))

    got = {r.entity_id: r.path for r in agent.gated(answers, fallback).collect()}
    assert got == {1: "fast", 2: "agentic"} and asked == [2]


def test_builder(spark, rows):
    told = spark.createDataFrame([(1, "T", "TERM: A\nDEFINITION: d\nCATEGORY: c\n\nTERM: B"), (2, "U", "TERM: a\nDEFINITION: other")], "ord bigint, topic string, answer string")
    terms = builder.candidate_terms(told)
    assert rows(terms.select("topic", "term")) == [("T", "A"), ("T", "B"), ("U", "a")]
    assert rows(builder.candidate_pairs(terms)) == [("T", "A", "B")]
    answers = spark.createDataFrame([("A", "FORMAL_DEFINITION: told\nCATEGORY:")], "term string, answer string")
    ref = {r.term: (r.formal_definition, r.category) for r in builder.terms_of_reference(terms, answers).collect()}
    assert ref == {"A": ("told", "c"), "B": ("", "")}
    done = spark.createDataFrame([("T",)], "source_topic string")
    assert [r.topic for r in builder.resume(told, done).collect()] == ["U"]


def test_incremental_stream_in_two_batches(spark, tmp_path):
    schema = "collection string, doc_id bigint, text string"
    src = str(tmp_path / "in")
    spark.createDataFrame([("c", 2, "a b"), ("c", 1, "a  b"), ("c", 3, "z")], schema).coalesce(1).write.parquet(src)
    run = lambda: incremental.run(spark, spark.readStream.schema(schema).parquet(src), str(tmp_path / "out"), str(tmp_path / "progress"))
    assert sorted(r.doc_id for r in run().collect()) == [1, 3]
    spark.createDataFrame([("c", 4, " a b "), ("c", 5, "new")], schema).coalesce(1).write.mode("append").parquet(src)
    assert sorted(r.doc_id for r in run().collect()) == [1, 3, 5]
    spark.createDataFrame([("c", 6, "new"), ("c", 7, "z "), ("c", 8, "last")], schema).coalesce(1).write.mode("append").parquet(src)
    kept = run()
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 8]
    assert all(r.prefix == r.hash[:2] for r in kept.collect())
    plan = kept.where("prefix = 'ab' and batch < 2").select("hash")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan or "PartitionFilters: [isnotnull(prefix" in plan
    assert sorted(r.doc_id for r in run().collect()) == [1, 3, 5, 8]  # nothing arrived


def test_bounded_memory_stream(spark, tmp_path):
    schema = "conv_id bigint, turn bigint, role string, text string"
    src = str(tmp_path / "in")
    out = []
    spark.createDataFrame([(1, t, "user", f"m{t}") for t in range(6)] + [(2, 0, "user", "x")], schema).write.parquet(src)

    def drain():
        stream = stream_memory.bounded(spark.readStream.schema(schema).parquet(src), 4)
        q = stream.writeStream.outputMode("update").foreachBatch(lambda b, _: out.append([tuple(r) for r in b.collect()]))
        q.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()

    drain()
    assert sorted(t for b in out for c, t, *_ in b if c == 1) == [2, 3, 4, 5]
    out.clear()
    spark.createDataFrame([(1, 6, "user", "m6")], schema).write.mode("append").parquet(src)
    drain()
    assert sorted((c, t) for b in out for c, t, *_ in b) == [(1, 3), (1, 4), (1, 5), (1, 6)]


def test_diagram_and_inventory_ingestion(spark, tmp_path):
    store = ChunkStore(spark, "d_chunks", "d_hashes")
    (tmp_path / "m.xml").write_text(XML)
    # the domain's own label and a label used as a subgroup are containers
    assert ingest.ingest(spark, ingest.IngestConfig([str(tmp_path / "m.xml")], "model", preprocessor="diagram"), store) == 1
    assert store.chunks(["model"]).first().text.startswith("## Player\n\n- **Domain:** PARTY")
    workbook(tmp_path / "w.xlsx")
    cfg = ingest.IngestConfig([str(tmp_path / "w.xlsx")], collection_prefix="inv", preprocessor="inventory")
    assert ingest.ingest(spark, cfg, store) == 1
    assert store.collections("inv") == ["inv_provider"] and "`f1`" in store.chunks(["inv_provider"]).first().text


BOXES = """<root><mxCell id="1"/>
<object id="d" label="CHANNEL" type="factSheet" factSheetId="fd"><mxCell style="x" vertex="1" parent="1"><mxGeometry x="10" y="10" width="600" height="400"/></mxCell></object>
<object id="s" label="Digital" type="factSheet" factSheetId="fs"><mxCell style="x" vertex="1" parent="1"><mxGeometry x="20" y="40" width="200" height="200"/></mxCell></object>
<object id="l" label="Email" type="factSheet" factSheetId="fl"><mxCell style="x" vertex="1" parent="1"><mxGeometry x="30" y="60" width="100" height="40"/></mxCell></object>
<object id="o" label="Radio" type="factSheet" factSheetId="fo"><mxCell style="x" vertex="1" parent="1"><mxGeometry x="400" y="300" width="100" height="40"/></mxCell></object>
</root>"""


def test_visual_domains(spark, tmp_path):
    (tmp_path / "b.xml").write_text(BOXES)
    leaf, edges = diagram.parse(spark, str(tmp_path / "b.xml"))
    assert {(r.label, r.domain, r.subgroup) for r in leaf.collect()} == {("Email", "CHANNEL", "Digital"), ("Radio", "CHANNEL", "")}
    assert edges.count() == 0


def test_prompts(spark):
    from docmosaic.functions import prompts

    df = spark.createDataFrame([("Club", "known", ["a", "b"]), ("Cup", None, [])], "name string, v string, e array<string>")
    got = [r.p for r in df.select(prompts.context_prompt("Define {entity}.", "Govern {entity}.", F.col("v"), F.col("e"), entity=F.col("name")).alias("p")).collect()]
    assert got == ["Govern Club.\n\na\n---\nb", "Define Cup."]


def test_relationship_scan(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"{n}_model.json").write_text(json.dumps({"relationships": [{"source_entity": n, "target_entity": "x"}]}))
    got = diagram.read_relationships(spark, [f"{tmp_path}/*_model.json"])
    assert {r.source_entity for r in got.collect()} == {"a", "b"}
