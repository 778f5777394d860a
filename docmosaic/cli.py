"""Command line: ingest, status, delete, query, catalog, coverage, validate, graph, diagnose, chat."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docmosaic.config import Config, list_configs, load_aliases
from docmosaic.functions import fixed
from docmosaic.functions.embedding import embed
from docmosaic.operators import graph
from docmosaic.plans import catalog, coverage, gap, ingest, products, validation
from docmosaic.sources import diagram, inventory, profiles, writers
from docmosaic.sources.progress import Progress
from docmosaic.sources.store import ChunkStore

NO_ALIASES = "canonical string, alias string"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docmosaic")
    p.add_argument("--config", help="settings file")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest", help="ingest a config or batch file")
    a.add_argument("cfg")
    a.add_argument("--rebuild", action="store_true", default=None)
    a = sub.add_parser("configs", help="list the config files of a folder")
    a.add_argument("folder")
    sub.add_parser("status", help="chunks and vectors per collection")
    a = sub.add_parser("delete", help="drop collections; only listed unless --force is given")
    a.add_argument("prefix", nargs="*")
    a.add_argument("--all", action="store_true")
    a.add_argument("-f", "--force", action="store_true")
    a = sub.add_parser("query", help="ask a question of the collections of a profile")
    a.add_argument("-q", "--question", required=True, action="append", help="the question; further ones are other phrasings of it")
    a.add_argument("--iterative", action="store_true", help="let each collection answer, then put the answers together")
    a.add_argument("--profile")
    a.add_argument("--collection", action="append")
    a = sub.add_parser("catalog", help="consolidated catalog")
    a.add_argument("--model-json", required=True)
    a.add_argument("--inventory-json", required=True)
    a.add_argument("--aliases")
    a.add_argument("--domain")
    a.add_argument("--entity", action="append")
    a.add_argument("--skip-handbook", action="store_true")
    a.add_argument("--agentic", action="store_true", help="gather contexts in rounds")
    a.add_argument("--skip-relationships", action="store_true")
    a.add_argument("--output-dir", default="output")
    a = sub.add_parser("coverage", help="coverage of the model by the corpus, with gap analysis")
    a.add_argument("--model-json", required=True)
    a.add_argument("--top-k", type=int, default=5)
    a.add_argument("--gap-analysis", action="store_true")
    a.add_argument("--handbook-json")
    a.add_argument("--output-dir", default="output")
    a = sub.add_parser("validate", help="completeness of a model document")
    a.add_argument("--model-json", required=True)
    a = sub.add_parser("graph", help="traverse the relationships of a model document")
    a.add_argument("--model-json", required=True)
    a.add_argument("--limit", type=int, help="entries of a list to show; all without it")
    a.add_argument("name")
    a.add_argument("operation", nargs="?", default="neighbors", choices=graph.OPERATIONS)
    a.add_argument("--type")
    a.add_argument("--max-depth", type=int, default=2)
    a = sub.add_parser("diagnose", help="ranking report for an entity")
    a.add_argument("--entity", required=True)
    a.add_argument("--section-prefix")
    a.add_argument("--ranker", default="embedding", choices=("embedding", "bm25", "boosted"))
    a.add_argument("--no-dropped", action="store_true")
    a = sub.add_parser("chat", help="questions line by line; /reset /history /graph <name> /exit")
    a.add_argument("--collection", action="append")
    a.add_argument("--model-json")
    return p


def chat(spark: SparkSession, lines, chunks, settings, edges=None) -> None:
    """Answer lines until /exit. The last three messages go along with a question as its context."""
    said: list[tuple[str, str]] = []
    for line in (s.strip() for s in lines):
        if line == "/exit":
            return
        if line == "/reset":
            said.clear()
        elif line == "/history":
            print("\n".join(f"{role}: {text}" for role, text in said))
        elif line.startswith("/graph ") and edges is not None:
            print(graph.traverse(edges, line.removeprefix("/graph ")).first().json)
        elif line.startswith("/"):
            print("unknown command", line)
        elif line:
            before = "\n".join(f"{role}: {text}" for role, text in said[-3:])
            rows = products.ask(spark, f"{before}\n{line}" if before else line, chunks, settings).collect()
            reply = rows[0].response if rows else "nothing found"
            print(reply)
            said = [*said, ("USER", line), ("ASSISTANT", reply)][-fixed.CHAT_LIMIT :]


def _entities(spark: SparkSession, path: str):
    if not Path(path).exists() and "://" not in path:
        raise SystemExit(f"model document not found: {path}; run ingest first")
    return diagram.read_model(spark, path)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    config = Config.from_yaml(args.config) if args.config else Config()
    store = ChunkStore(spark, config.store.chunks_table, config.store.ledger_table)
    show = lambda df: print(df._show_string(max(1, df.count()), False, False))
    match args.command:
        case "ingest":
            print(ingest.ingest_from_yaml(spark, args.cfg, store, args.rebuild), "chunks")
        case "configs":
            print("\n".join(list_configs(args.folder)))
        case "status":
            show(store.status().orderBy("collection"))
        case "delete":
            names = store.drop_all(args.force) if args.all else [n for p in args.prefix for n in store.drop_prefix(p, args.force)]
            print("dropped" if args.force else "would drop", *names)
        case "query":
            names = args.collection
            if args.profile:
                chosen = profiles.profile_collections(store.chunks(), profiles.QueryProfile.from_yaml(args.profile))
                names = [r.collection for r in chosen.orderBy("position").collect()]
            show(products.ask(spark, args.question, store.chunks(names), config.query, iterative=args.iterative).select("response"))
        case "catalog":
            entities, relations = _entities(spark, args.model_json)
            picked = catalog.select_entities(entities, args.domain, args.entity)
            aliases = load_aliases(spark, args.aliases) if args.aliases else spark.createDataFrame([], NO_ALIASES)
            chunks = store.chunks([]) if args.skip_handbook else store.chunks()
            rels = relations.where("false") if args.skip_relationships else relations
            sheets = inventory.read_json(spark, args.inventory_json)
            forced = spark.createDataFrame([], "entity_name string")
            # a run that was stopped goes on from the contexts it had finished
            kept = Progress(spark, f"{args.output_dir}/_progress")
            rows = products.consolidated_catalog(
                picked, sheets, chunks, rels, aliases, forced, skip_handbook_only=bool(args.domain or args.entity),
                provider=products.agentic_contexts if args.agentic else products.contexts, progress=kept,
            )
            writers.write_json(rows, f"{args.output_dir}/catalog")
            # empty columns are not in the files, so the schema is that of the rows
            written = spark.read.schema(rows.schema).json(f"{args.output_dir}/catalog")
            tree = catalog.hierarchy(written, entities, sheets)
            writers.write_catalog(catalog.nested_pages(tree), rels, args.output_dir)
            kept.clear()
            show(catalog.catalog_summary(written).orderBy("metric", "value"))
        case "coverage":
            entities, _ = _entities(spark, args.model_json)
            rows = products.coverage_check(entities.where("fact_sheet_id <> ''"), store.chunks(), args.top_k)
            writers.write_json(rows, f"{args.output_dir}/coverage")
            show(coverage.summary(spark.read.json(f"{args.output_dir}/coverage")))
            if args.gap_analysis:
                found = spark.read.option("multiLine", True).json(args.handbook_json)
                found = gap.candidate_names(found.withColumn("ord", F.monotonically_increasing_id()))
                model = entities.select("ord", F.col("entity_name").alias("name"))
                writers.write_json(gap.gap_analysis(model, found), f"{args.output_dir}/gap")
                show(gap.gap_counts(spark.read.json(f"{args.output_dir}/gap")))
        case "validate":
            entities, _ = _entities(spark, args.model_json)
            show(validation.completeness(entities).orderBy("domain"))
            show(validation.acceptance(entities))
        case "graph":
            _, relations = _entities(spark, args.model_json)
            edges = graph.build(graph.normalize_relationships(relations))
            print(graph.traverse(edges, args.name, args.operation, args.type, args.max_depth, args.limit).first().json)
        case "chat":
            edges = None
            if args.model_json:
                edges = graph.build(graph.normalize_relationships(_entities(spark, args.model_json)[1]))
            chat(spark, sys.stdin, store.chunks(args.collection), config.query, edges)
        case "diagnose":
            chunks = store.chunks(store.collections(args.section_prefix))
            asked = spark.createDataFrame([(1, 0, args.entity)], "entity_id bigint, pos int, variant string")
            vectors = asked.select(F.col("entity_id").alias("query_id"), embed(F.col("variant")).alias("embedding"))
            rows = products.diagnose(chunks, asked, vectors, args.ranker)
            show((rows.where("status = 'INCLUDED'") if args.no_dropped else rows).orderBy("rank"))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("docmosaic").getOrCreate()
    run(spark, args)


if __name__ == "__main__":
    main()
