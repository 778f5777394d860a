"""Relationship graph and conversation memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmosaic.operators import graph, memory
from docmosaic.queries import query
from docmosaic.queries.base import table
from docmosaic.session import spread

START = "S1"

RELATIONS = """
rel as (
  select {'o': l_orderkey, 'l': l_linenumber, 's': l_shipdate, 'q': l_quantity, 'f': l_returnflag} as ord,
    'P' || l_partkey as a, 'S' || l_suppkey as b, 'supplied ' || l_returnflag as t, l_linestatus as c from lineitem),
dir as (
  select a as src, b as dst, t as relationship_type, c as cardinality, {'o': ord, 'i': 0} as step from rel
  union all select b, a, 'inverse_' || t, c, {'o': ord, 'i': 1} from rel),
edges as (
  select src, dst, arg_max(relationship_type, {'s': step, 't': relationship_type, 'c': cardinality}) as relationship_type,
         arg_max(cardinality, {'s': step, 't': relationship_type, 'c': cardinality}) as cardinality from dir group by all)"""


def _edges(spark, d):
    rows = spread(table(spark, d, "lineitem"), "l_partkey").selectExpr(
        "struct(l_orderkey, l_linenumber, l_shipdate, l_quantity, l_returnflag) as ord",
        "'P' || l_partkey as source_entity", "'S' || l_suppkey as target",
        "'supplied ' || l_returnflag as relationship_type", "l_linestatus as cardinality",
    )
    return graph.build(graph.normalize_relationships(rows))


@query(f"with {RELATIONS} select * from edges")
def graph_edges(spark, d):
    return _edges(spark, d)


@query(f"with {RELATIONS} select * from edges where contains(lower(relationship_type), 'inverse_supplied r')")
def graph_type_filter(spark, d):
    return graph.of_type(_edges(spark, d), "INVERSE_supplied R")


@query("select distinct 'S' || l_suppkey as node from lineitem where contains('s' || l_suppkey, 's9') order by 1 limit 5")
def graph_suggest(spark, d):
    return graph.suggest(_edges(spark, d), "S9")


@query(f"with {RELATIONS} select dst as node, relationship_type, cardinality from edges where src = '{START}'")
def graph_neighbors(spark, d):
    return graph.neighbors(_edges(spark, d), START)


LINKS = """
links as materialized (select distinct 'P' || l_partkey as src, 'S' || l_suppkey as dst from lineitem
  union select 'S' || l_suppkey, 'P' || l_partkey from lineitem),
h1 as materialized (select distinct dst as node from links where src = 'S1' and dst <> 'S1'),
h2 as materialized (select distinct dst as node from links where src in (select node from h1) and dst <> 'S1' and dst not in (select node from h1)),
hops as (select 'S1' as node, 0 as hops union all select node, 1 from h1 union all select node, 2 from h2)"""


@query(f"with {LINKS} select node, hops from hops")
def graph_ego(spark, d):
    return graph.reachable(_edges(spark, d), START, 2)


@query(f"with {LINKS} select src, dst from links where src in (select node from hops where hops <= 1) and dst in (select node from hops where hops <= 1)")
def graph_ego_edges(spark, d):
    edges = _edges(spark, d)
    return graph.ego_edges(edges, graph.reachable(edges, START, 1)).select("src", "dst")


REACHED = """
with recursive links as materialized (select distinct 'P' || l_partkey as src, 'S' || l_suppkey as dst from lineitem
  union select 'S' || l_suppkey, 'P' || l_partkey from lineitem),
reached(node) as (select 'S1' union select l.dst from reached r join links l on l.src = r.node)
select node from reached where node <> 'S1'"""


@query(REACHED)
def graph_descendants(spark, d):
    return graph.descendants(_edges(spark, d), START).select("node")


@query(REACHED)
def graph_ancestors(spark, d):
    return graph.ancestors(_edges(spark, d), START).select("node")


# A directed graph of several steps: supplier to part, part to the customers who ordered it, customer to nation.
DIRECTED = """
links as materialized (
  select distinct 'S' || l_suppkey as src, 'P' || l_partkey as dst from lineitem
  union select 'P' || l_partkey, 'C' || o_custkey from lineitem join orders on l_orderkey = o_orderkey
  union select 'C' || c_custkey, 'N' || c_nationkey from customer)"""


def _directed(spark, d):
    lines = table(spark, d, "lineitem")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    edge = lambda rows, a, b, kind: rows.selectExpr(f"{a} as source", f"{b} as target", f"'{kind}' as relationship_type")
    rows = edge(lines, "'S' || l_suppkey", "'P' || l_partkey", "supplies").unionByName(
        edge(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), "'P' || l_partkey", "'C' || o_custkey", "sold to")).unionByName(
        edge(table(spark, d, "customer"), "'C' || c_custkey", "'N' || c_nationkey", "lives in"))
    return graph.build(graph.normalize_relationships(rows.distinct().withColumn("ord", F.xxhash64("source", "target"))), directed=True)


@query(f"""
with {DIRECTED},
p as (select dst as node from links where src = 'S1'), c as (select distinct dst as node from links where src in (select node from p)),
n as (select distinct dst as node from links where src in (select node from c))
select node, 1 as hops from p union all select node, 2 from c union all select node, 3 from n
""")
def graph_directed_descendants(spark, d):
    """What a supplier reaches along the edges alone."""
    return graph.traversal(_directed(spark, d), START, "descendants").select("node", "hops")


@query(f"""
with {DIRECTED},
c as (select src as node from links where dst = 'N7'), p as (select distinct src as node from links where dst in (select node from c)),
s as (select distinct src as node from links where dst in (select node from p))
select node, 1 as hops from c union all select node, 2 from p union all select node, 3 from s
""")
def graph_directed_ancestors(spark, d):
    """Whatever leads to a nation, against the edges alone."""
    return graph.traversal(_directed(spark, d), "N7", "ancestors").select("node", "hops")


@query(f"""
with {LINKS},
p2 as (select l.dst as node, min(['S1', l.src, l.dst]) as path from links l where l.src in (select node from h1) and l.dst in (select node from h2) group by 1)
select node, 1 as hops, 'S1>' || node as path from h1 union all select node, 2, array_to_string(path, '>') from p2
""")
def graph_shortest_hops(spark, d):
    found = graph.shortest_paths(_edges(spark, d), START, 2)
    return found.select("node", "hops", F.array_join("path", ">").alias("path"))


# --- conversations --------------------------------------------------------------

KEPT = "kept as (select * from (select *, row_number() over (partition by conv_id order by turn desc) as age from conversations) where age <= {n})"


@query(f"with {KEPT.format(n=6)} select conv_id, turn, role from kept")
def chat_fifo(spark, d):
    return memory.fifo(table(spark, d, "conversations"), 6).select("conv_id", "turn", "role")


@query(f"with {KEPT.format(n=50)} select conv_id, turn, role, md5(text) as text_md5 from kept where role <> 'system'")
def chat_history(spark, d):
    kept = memory.history(table(spark, d, "conversations"))
    return kept.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("""
select conv_id, turn, role, coalesce(array_to_string(list(upper(role) || ': ' || text) over (
  partition by conv_id order by turn rows between 3 preceding and 1 preceding), chr(10)), '') as context from conversations
""")
def chat_context_window(spark, d):
    return memory.context_strings(table(spark, d, "conversations"))


@query(f"with {KEPT.format(n=50)} select conv_id, string_agg(upper(role) || ': ' || text, chr(10) || chr(10) order by turn) as transcript from kept group by 1")
def chat_transcript(spark, d):
    return memory.transcript(table(spark, d, "conversations"))


@query("""
select user_id, event_id, event_type from (select *, lag(event_type) over (partition by user_id order by event_id) as before from events)
where before is null or before <> event_type
""")
def run_collapse_lag(spark, d):
    runs = memory.collapse_runs(table(spark, d, "events"), "event_type", "user_id", "event_id")
    return runs.select("user_id", "event_id", "event_type")
