"""Document structure: table lines, chunk packing, sections, defined terms, diagram geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmosaic.functions import fixed, splitters
from docmosaic.operators import chunking, ranking, spatial
from docmosaic.queries import ORACLES, query
from docmosaic.queries.base import collapse_sql, documents, strip_sql, table
from docmosaic.session import spread
from docmosaic.sources import diagram


def _documents(spark, d):
    return documents(spark, d).select("doc_id", "text")


LINES = """
lines as (select doc_id, unnest(range(len(l))) as line_no, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents)),
classed as (
  select *, case when not contains(line, '|') then 'prose'
    when regexp_full_match(%s, '[-|+: ]+') then 'separator' else 'table_row' end as line_class from lines)""" % strip_sql("line")


@query(f"with {LINES} select doc_id, line_no, line_class, length(line) as n from classed")
def table_line_classify(spark, d):
    rows = chunking.classified_lines(_documents(spark, d), "doc_id")
    return rows.select("doc_id", "line_no", "line_class", F.length("line").cast("bigint").alias("n"))


# Lines are packed to 2048 characters; a longer line is cut between words by the same rule.
@query(f"""
with recursive {LINES},
kept as (select doc_id, line, line_class, row_number() over (partition by doc_id order by line_no) as j from classed where line_class <> 'separator'),
turns as (select *, (line_class <> coalesce(lag(line_class) over (partition by doc_id order by j), ''))::int as turned from kept),
runs as (select doc_id, line, line_class, j, sum(turned) over (partition by doc_id order by j) as run from turns),
numbered as materialized (select *, row_number() over (partition by doc_id, run order by j) as i from runs where line_class = 'table_row'),
packed(doc_id, run, i, used, piece) as (
  select doc_id, run, i, length(line), 0 from numbered where i = 1
  union all
  select n.doc_id, n.run, n.i, case when p.used + length(n.line) > 2048 then length(n.line) else p.used + length(n.line) end,
    p.piece + (p.used + length(n.line) > 2048)::int
  from packed p join numbered n on n.doc_id = p.doc_id and n.run = p.run and n.i = p.i + 1),
long_words as materialized (
  select doc_id, run, i, unnest(range(len(w))) + 1 as k, unnest(w) as word
  from (select doc_id, run, i, string_split(line, ' ') as w from numbered where length(line) > 2048)),
cut(doc_id, run, i, k, used, sub) as (
  select doc_id, run, i, k, length(word) + 1, 0 from long_words where k = 1
  union all
  select w.doc_id, w.run, w.i, w.k, case when c.used + length(w.word) + 1 > 2048 then length(w.word) + 1 else c.used + length(w.word) + 1 end,
    c.sub + (c.used + length(w.word) + 1 > 2048)::int
  from cut c join long_words w on w.doc_id = c.doc_id and w.run = c.run and w.i = c.i and w.k = c.k + 1),
pieces as (
  select n.doc_id, n.run, p.piece, 0 as sub, 'table_row' as content_type, string_agg(line, chr(10) order by n.j) as body
  from numbered n join packed p on n.doc_id = p.doc_id and n.run = p.run and n.i = p.i where length(n.line) <= 2048 group by all
  union all
  select w.doc_id, w.run, p.piece, c.sub, 'table_row', string_agg(w.word, ' ' order by w.k)
  from long_words w join cut c on w.doc_id = c.doc_id and w.run = c.run and w.i = c.i and w.k = c.k
  join packed p on p.doc_id = w.doc_id and p.run = w.run and p.i = w.i group by w.doc_id, w.run, p.piece, c.sub
  union all
  select doc_id, run, 0, 0, 'prose', {strip_sql("string_agg(line, chr(10) order by j)")} from runs where line_class = 'prose' group by doc_id, run),
whole as (select * from pieces where body <> '')
select doc_id, row_number() over (partition by doc_id order by run, piece, sub) - 1 as pos, content_type, md5(body) as body_md5 from whole
""")
def table_chunks(spark, d):
    pieces = chunking.table_chunks(_documents(spark, d), 512)
    return pieces.select("doc_id", "pos", "content_type", F.md5("text").alias("body_md5"))


@query(ORACLES["table_chunks"])
def table_chunks_in_sql(spark, d):
    """The same pieces from the table function."""
    splitters.register(spark)
    _documents(spark, d).createOrReplaceTempView("documents_to_split")
    return spark.sql("SELECT doc_id, pos, content_type, md5(text) AS body_md5 FROM table_chunks(TABLE(documents_to_split), 512)")


# Markdown derived from the documents: lines that open with some words become headings.
HEADINGS = (
    ("The ", "# 1 - The "), ("An", "## 2 - An"), ("Re", "## Section 3 Re"), ("In", "### 4 - In"),
    ("De ", "# 5 – De "), ("Er", "#### 12 - Er"), ("La ", "# La "),
)


def _markdown_sql() -> str:
    x = "text"
    for opening, heading in HEADINGS:
        x = f"regexp_replace({x}, '(?m)^{opening}', '{heading}', 'g')"
    return x


def _markdown(spark, d):
    c = F.col("text")
    for opening, heading in HEADINGS:
        c = F.regexp_replace(c, f"(?m)^{opening}", heading)
    return documents(spark, d).select("doc_id", c.alias("text"))


MARKDOWN = f"md as (select doc_id, {_markdown_sql()} as text from documents)"


@query(rf"""
with {MARKDOWN},
cut as (select doc_id, text, string_split(regexp_replace(text, '(?m)^(#{{1,6}}\s+.+)$', chr(1) || '\1', 'g'), chr(1)) as parts from md),
headed as (select doc_id, text, list_filter(parts, lambda p: regexp_matches(p, '\A#{{1,6}}\s+.')) as h from cut),
s as (select doc_id, case when len(h) > 1 then list_transform(h, lambda p: {strip_sql('p')}) else [text] end as sections from headed)
select doc_id, unnest(range(len(sections))) as section_no, md5(unnest(sections)) as body_md5 from s
""")
def section_split(spark, d):
    rows = _markdown(spark, d).select("doc_id", F.posexplode(chunking.markdown_sections(F.col("text"))).alias("n", "body"))
    return rows.select("doc_id", F.col("n").cast("bigint").alias("section_no"), F.md5("body").alias("body_md5"))


NUMBERED = r"""
lines as (select doc_id, unnest(range(len(l))) as i, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from md)),
placed as (select doc_id, i, line, coalesce(sum(length(line) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as pos from lines),
heads as (
  select doc_id, pos, case
      when regexp_matches(line, '^#\s+\d+\s*[-–]\s*.+$') then regexp_extract(line, '^#\s+(\d+)', 1)
      when regexp_matches(line, '(?i)^##\s+\d+\s*[-–]\s*.+$') then regexp_extract(line, '^##\s+(\d+)', 1)
      when regexp_matches(line, '(?i)^#{1,2}\s+section\s+\d+') then regexp_extract(line, '(?i)section\s+(\d+)', 1)
      when regexp_matches(line, '^#{3,4}\s+\d+\s*[-–]') then regexp_extract(line, '^#+\s+(\d+)', 1) end as number
  from placed),
cand as materialized (select doc_id, pos, number::bigint as number, row_number() over (partition by doc_id order by pos) as k from heads where number is not null),
walk(doc_id, k, last_pos, accepted) as (
  select doc_id, k, pos, true from cand where k = 1
  union all
  select c.doc_id, c.k, case when c.pos - w.last_pos < 100 then w.last_pos else c.pos end, c.pos - w.last_pos >= 100
  from walk w join cand c on c.doc_id = w.doc_id and c.k = w.k + 1),
kept as (select c.doc_id, c.pos, c.number, lag(c.number) over (partition by c.doc_id order by c.pos) as before
         from cand c join walk w using (doc_id, k) where w.accepted),
bounds as (
  select k.doc_id, number, pos as start_pos, lead(pos, 1, length(text)) over (partition by k.doc_id order by pos) as end_pos, text
  from kept k join md using (doc_id) where before is null or before <> number),
bodies as (select doc_id, number, start_pos, end_pos, %s as body from bounds),
last as (select *, row_number() over (partition by doc_id, number order by start_pos desc) as r from bodies where length(body) >= 100)""" % strip_sql(
    "substr(text, start_pos::bigint + 1, (end_pos - start_pos)::bigint)"
)


@query(rf"""
with recursive {MARKDOWN}, {NUMBERED}
select doc_id, 'hb_s' || case when number < 10 then '0' else '' end || number as collection, number, start_pos::bigint as start_pos,
  end_pos::bigint as end_pos, md5(body) as body_md5 from last where r = 1
""")
def section_bounds_lead(spark, d):
    rows = chunking.split_numbered_sections(_markdown(spark, d), "doc_id", "hb")
    return rows.select(
        "doc_id", "collection", "number", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), F.md5("text").alias("body_md5")
    )


DEFINED = r"""'Preamble.' || chr(10) || '“' || upper(left(p_name, 1)) || substr(p_name, 2) || '” means a  part of ' || p_brand || ' in type ' || p_type || ' ;' || chr(10)
 || '|' || upper(p_type) || '<br>' || replace(p_brand, '#', ' ') || '|means any item<br/>made as ' || p_type || '.|' || chr(10) || '**"Short"** means x;' || chr(10)
 || upper(left(p_brand, 1)) || replace(substr(p_brand, 2), '#', ' ') || ' means the maker of sizes up to ' || p_size || '...'"""

INLINE = fixed.DEFINITION_INLINE.replace("'", "''")
ROW = fixed.DEFINITION_ROW.replace("'", "''")


@query(f"""
with src as (select p_partkey, translate({DEFINED}, '‘’“”', '''''""') as text from part),
a as (select p_partkey, 0 as kind, regexp_extract_all(text, '{INLINE}', 1) as t, regexp_extract_all(text, '{INLINE}', 2) as d from src
      union all select p_partkey, 1, regexp_extract_all(text, '{ROW}', 1), regexp_extract_all(text, '{ROW}', 2) from src),
u as (select p_partkey, kind, unnest(range(len(t))) as place, unnest(t) as t, unnest(d) as d from a),
c as (select p_partkey, kind, place,
   trim({collapse_sql("regexp_replace(t, '<br' || chr(92) || 's*/?>', ' ', 'g')")}, '"''‘’“”*') as term,
   rtrim(rtrim({collapse_sql("regexp_replace(d, '<br' || chr(92) || 's*/?>', ' ', 'g')")}, ';'), '.') as definition from u),
k as (select *, row_number() over (partition by lower(term) order by p_partkey, kind, place) as r from c where length(definition) between 10 and 1500)
select term, definition from k where r = 1
""")
def extract_definitions(spark, d):
    chunks = spread(table(spark, d, "part"), "p_partkey").select("p_partkey", F.expr(DEFINED).alias("text"))
    return chunking.definitions(chunks, "p_partkey")


ENTITY_MD = """'## ' || c_name || chr(10) || chr(10) || '- **Domain:** ' || n_name || chr(10)
 || case when c_mktsegment = 'MACHINERY' then '' else '- **Subtype:** ' || c_mktsegment || chr(10) end
 || case when c_acctbal < 0 then '' else '- **LeanIX ID:** `' || c_custkey || '`' || chr(10) end || '- **Type:** DataObject' || chr(10)"""


@query(f"select c_custkey, {ENTITY_MD} as markdown from customer join nation on c_nationkey = n_nationkey")
def entity_markdown(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    named = rows.selectExpr(
        "c_custkey", "c_name as entity_name", "n_name as domain", "case when c_mktsegment = 'MACHINERY' then '' else c_mktsegment end as subtype",
        "case when c_acctbal < 0 then '' else cast(c_custkey as string) end as fact_sheet_id", "'DataObject' as fact_sheet_type",
    )
    return named.select("c_custkey", diagram.entity_markdown().alias("markdown"))


@query("""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, '## Part ' || l_partkey || ' → Supplier ' || l_suppkey || chr(10) || chr(10) || '- **Source domain:** PARTS' || chr(10)
  || '- **Cardinality:** 0..*-' || l_linenumber || chr(10) || '- **Type:** ' || l_returnflag || chr(10) as markdown from lineitem
""")
def relationship_markdown(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(
        "*", "'Part ' || l_partkey as source_entity", "'Supplier ' || l_suppkey as target_entity", "'PARTS' as source_domain",
        "'' as target_domain", "'0..*-' || l_linenumber as cardinality", "l_returnflag as relationship_type",
    )
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", diagram.relationship_markdown().alias("markdown"))


# --- diagram ------------------------------------------------------------------

# One diagram object per part, as XML; the oracle reads the columns it was made of.
OBJECT_XML = """'<object id="' || p_partkey || '" label="&lt;b&gt;' || p_name || '&lt;/b&gt;&amp;amp; ' || p_brand || '" type="factSheet" factSheetType="' || p_type
 || '" factSheetId="fs-' || p_partkey || '"><mxCell style="rounded=0;" vertex="1" parent="g' || p_size || '"><mxGeometry '
 || case when p_size > 10 then 'x="' || p_size || '.5" ' else '' end || 'y="7" width="102" height="40"/></mxCell></object>'"""


@query("""
select p_partkey::varchar as id, p_name || '& ' || p_brand as label, p_type as fact_sheet_type, 'fs-' || p_partkey as fact_sheet_id,
  'g' || p_size as parent_id, case when p_size > 10 then p_size + 0.5::double end as x, 7.0::double as y, 102.0::double as width, 40.0::double as height
from part
""")
def diagram_assets(spark, d):
    xml = table(spark, d, "part").select(F.expr(OBJECT_XML).alias("xml"))
    assets = diagram.parse_objects(xml, "xml")
    return assets.select("id", "label", "fact_sheet_type", "fact_sheet_id", "parent_id", "x", "y", "width", "height")


GROUPS = """
groups as (
  select 'N' || n_nationkey as id, n_name as label, case when n_regionkey <= 2 then 'R' || n_regionkey else '1' end as parent_id from nation
  union all select 'R' || r_regionkey, r_name, '1' from region)"""


def _groups(spark, d):
    n = table(spark, d, "nation").selectExpr(
        "'N' || n_nationkey as id", "n_name as label", "case when n_regionkey <= 2 then 'R' || n_regionkey else '1' end as parent_id"
    )
    return n.unionByName(table(spark, d, "region").selectExpr("'R' || r_regionkey as id", "r_name as label", "'1' as parent_id"))


@query(f"""
with {GROUPS}, assets as (select s_suppkey as id, 'N' || s_nationkey as parent_id from supplier union all select 1000000000000 + c_custkey, 'X' || c_nationkey from customer)
select a.id, coalesce(gp.label, p.label, '') as domain, case when gp.id is not null then p.label else '' end as subgroup
from assets a left join groups p on a.parent_id = p.id left join groups gp on p.parent_id = gp.id
""")
def nested_group_resolve(spark, d):
    assets = table(spark, d, "supplier").selectExpr("s_suppkey as id", "'N' || s_nationkey as parent_id").unionByName(
        table(spark, d, "customer").selectExpr("1000000000000 + c_custkey as id", "'X' || c_nationkey as parent_id")
    )
    return diagram.resolve_groups(assets, _groups(spark, d)).select("id", "domain", "subgroup")


@query("""
select 'N' || c_nationkey as id, arg_min(c_name, c_custkey) as label, arg_min(c_custkey, c_custkey) as fact_sheet_id
from customer where c_mktsegment = 'BUILDING' group by 1
""")
def group_labels(spark, d):
    children = table(spark, d, "customer").selectExpr(
        "'N' || c_nationkey as parent_id", "c_custkey as ord", "c_name as label", "c_custkey as fact_sheet_id",
        "case when c_mktsegment = 'BUILDING' then 'factSheet' else 'note' end as type",
    )
    return diagram.group_labels(children)


@query(f"""
with {GROUPS}
select case when g.parent_id = '1' then g.label else p.label end as domain, case when g.parent_id = '1' then '' else g.label end as subtype, 'f' || g.id as fact_sheet_id
from groups g left join groups p on g.parent_id = p.id
""")
def container_ids(spark, d):
    groups = _groups(spark, d).withColumn("fact_sheet_id", F.concat(F.lit("f"), F.col("id")))
    return diagram.container_ids(groups)


LEAF = """
assets as (
  select p_partkey as ord, p_brand as domain, case when p_size > 30 then p_type else '' end as subgroup,
    case when p_size = 1 then p_brand when p_size = 2 then p_type when p_size > 25 then upper(p_name) else p_name end as label,
    p_partkey::varchar as fact_sheet_id from part)"""


@query(f"""
with {LEAF}, used as (select distinct domain, subgroup from assets where subgroup <> ''),
leaf as (select a.* from assets a left join used u on a.domain = u.domain and a.label = u.subgroup where u.domain is null and upper(label) <> upper(a.domain)),
k as (select *, row_number() over (partition by lower(label) order by domain, subgroup, label, ord) as r from leaf)
select domain, subgroup, label, ord, fact_sheet_id from k where r = 1
""")
def leaf_entities(spark, d):
    assets = table(spark, d, "part").selectExpr(
        "p_partkey as ord", "p_brand as domain", "case when p_size > 30 then p_type else '' end as subgroup",
        "case when p_size = 1 then p_brand when p_size = 2 then p_type when p_size > 25 then upper(p_name) else p_name end as label",
        "cast(p_partkey as string) as fact_sheet_id",
    )
    return diagram.leaf_entities(assets).select("domain", "subgroup", "label", "ord", "fact_sheet_id")


BOX = {
    "x": "cast(p_size * 17 as double)",
    "y": "(p_retailprice - 900) * 5",
    "w": "cast(case p_type when 'LARGE' then 400 when 'PROMO' then 250 when 'MEDIUM' then 101 when 'SMALL' then 102 else 60 end as double)",
    "h": "cast(case p_type when 'LARGE' then 300 when 'PROMO' then 120 when 'MEDIUM' then 41 else 40 end as double)",
}
BOXES = f"boxes as (select p_brand as g, p_partkey as id, {', '.join(f'{v} as {k}' for k, v in BOX.items())} from part)"


def _boxes(spark, d):
    return table(spark, d, "part").select(
        F.col("p_brand").alias("group"), F.col("p_partkey").alias("box_id"), F.col("p_partkey").alias("ord"),
        *[F.expr(v).alias(k) for k, v in BOX.items()],
    )


@query(f"""
with {BOXES}
select p.g as grp, p.id as point_id, min(b.id) as box_id from boxes p join boxes b on p.g = b.g
where not (p.w > 100 and p.h > 40) and b.w > 100 and b.h > 40
  and p.x + p.w / 2 between b.x and b.x + b.w and p.y + p.h / 2 between b.y and b.y + b.h
group by all
""")
def point_in_box_join(spark, d):
    boxes = _boxes(spark, d)
    container = spatial.is_container(F.col("w"), F.col("h"))
    points = boxes.where(~container).select(
        "group", F.col("box_id").alias("point_id"), (F.col("x") + F.col("w") / 2).alias("px"), (F.col("y") + F.col("h") / 2).alias("py")
    )
    return spatial.point_in_box(points, boxes.where(container)).withColumnRenamed("group", "grp")


ROOTS = f"""
{BOXES},
roots as (select * from boxes c where not exists (
  select 1 from boxes o where o.g = c.g and o.id <> c.id and o.x <= c.x and c.x + c.w <= o.x + o.w and o.y <= c.y and c.y + c.h <= o.y + o.h))"""


@query(f"with {ROOTS} select g as grp, id as box_id, x, y, w, h from roots")
def box_containment_roots(spark, d):
    return spatial.roots(_boxes(spark, d)).select(F.col("group").alias("grp"), "box_id", "x", "y", "w", "h")


@query(f"""
with {ROOTS}
select p.g as grp, p.id as point_id, max(b.id) as box_id from boxes p join roots b on p.g = b.g
where p.id not in (select id from roots) and p.x + p.w / 2 between b.x and b.x + b.w and p.y + p.h / 2 between b.y and b.y + b.h
group by all
""")
def box_root_assignment(spark, d):
    return spatial.assign_to_roots(_boxes(spark, d)).withColumnRenamed("group", "grp")


@query("""
select s_nationkey, s_nationkey::varchar || ': ' || string_agg(s_name, ', ' order by s_name) as line from (
  select *, row_number() over (partition by s_nationkey order by s_name) as r from supplier) where r <= 12 group by 1
""")
def narrative_members(spark, d):
    first = ranking.top_k(table(spark, d, "supplier"), ["s_nationkey"], 12, [F.col("s_name")])
    names = F.array_join(F.array_sort(F.collect_list("s_name")), ", ")
    return first.groupBy("s_nationkey").agg(names.alias("n")).select(
        "s_nationkey", F.concat(F.col("s_nationkey").cast("string"), F.lit(": "), "n").alias("line")
    )


@query()
def sentence_chunks(spark, d):
    return chunking.chunk(_documents(spark, d), chunking.ChunkSettings("sentence", 256, 32))


@query()
def chunk_documents(spark, d):
    docs = documents(spark, d).select(F.col("source").alias("collection"), "doc_id", "text")
    return chunking.chunk(docs, chunking.ChunkSettings())
