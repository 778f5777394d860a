"""Catalog: matching, consolidation, gap analysis, validation, dedupes and resume."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmosaic.functions import fixed
from docmosaic.functions.text import collapse, content_hash, normalize
from docmosaic.operators import matching, ranking
from docmosaic.plans import catalog, gap, validation
from docmosaic.queries import query
from docmosaic.queries.base import collapse_sql, documents, normalize_sql, strip_sql, table
from docmosaic.queries.scalars import RESPONSE
from docmosaic.session import materialize, shared_path, spread
from docmosaic.sources import catalog as collections
from docmosaic.sources import hashes, inventory, writers
from docmosaic.sources.progress import Progress

# --- the catalog's inputs, read from the given tables ------------------------

MODEL_COLS = {
    "ord": "c_custkey",
    "entity_name": "c_name",
    "domain": "upper(r_name)",
    "domain_fact_sheet_id": "'D' || r_regionkey",
    "subgroup": "case when c_mktsegment = 'MACHINERY' then '' else n_name end",
    "subgroup_fact_sheet_id": "case when c_mktsegment = 'MACHINERY' then '' else 'S' || n_nationkey end",
    "fact_sheet_id": "case when c_mktsegment = 'HOUSEHOLD' then '' else cast(c_custkey as varchar(20)) end",
    "fact_sheet_type": "'DataObject'",
}
MODEL = (
    "model as (select "
    + ", ".join(f"{v} as {k}" for k, v in MODEL_COLS.items())
    + " from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"
)


def _model(spark, d):
    t = lambda n: table(spark, d, n)
    rows = (
        t("customer")
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return rows.select(*[F.expr(v).cast("bigint" if k == "ord" else "string").alias(k) for k, v in MODEL_COLS.items()])


ALIASES = """
aliases as (
  select lower(c_name) as canonical, 'acct ' || c_custkey as alias from customer where c_mktsegment in ('BUILDING', 'FURNITURE')
  union all select lower(c_name), 'group ' || c_nationkey from customer where c_acctbal < 0)"""


def _aliases(spark, d):
    c = table(spark, d, "customer")
    a = c.where("c_mktsegment in ('BUILDING', 'FURNITURE')").selectExpr("lower(c_name) as canonical", "'acct ' || c_custkey as alias")
    return a.unionByName(c.where("c_acctbal < 0").selectExpr("lower(c_name) as canonical", "'group ' || c_nationkey as alias"))


TERMS = """
terms as (
  select c_custkey as ord, '  ' || upper(c_name) || ' ' as term, 'any holder in segment ' || c_mktsegment as definition from customer where c_acctbal > 5000
  union all select 1000000000000 + c_custkey, 'Acct ' || c_custkey, 'an account' from customer where c_acctbal <= 5000
  union all select 2000000000000 + n_nationkey, 'Group ' || n_nationkey, 'the group of ' || n_name from nation
  union all select 3000000000000 + s_suppkey, s_name, 'a supplier' from supplier)"""


def _terms(spark, d):
    t = lambda n: table(spark, d, n)
    parts = [
        t("customer").where("c_acctbal > 5000").selectExpr("c_custkey as ord", "'  ' || upper(c_name) || ' ' as term", "'any holder in segment ' || c_mktsegment as definition"),
        t("customer").where("c_acctbal <= 5000").selectExpr("1000000000000 + c_custkey as ord", "'Acct ' || c_custkey as term", "'an account' as definition"),
        t("nation").selectExpr("2000000000000 + n_nationkey as ord", "'Group ' || n_nationkey as term", "'the group of ' || n_name as definition"),
        t("supplier").selectExpr("3000000000000 + s_suppkey as ord", "s_name as term", "'a supplier' as definition"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


INVENTORY_TYPE = "case p_type when 'ECONOMY' then 'DataObject' when 'STANDARD' then 'Interface' when 'PROMO' then 'Application' when 'SMALL' then 'Provider' when 'LARGE' then 'Objective' else 'Unlisted' end"
INVENTORY_COLS = {
    "id": "cast(p_partkey as varchar(20))",
    "type": INVENTORY_TYPE,
    "name": "case when p_type = 'STANDARD' then p_name || ' to ' || p_brand else p_name end",
    "description": "case when p_size <= 10 then '' else p_brand || ' ' || p_name || ' of size ' || p_size end",
    "level": "cast(p_size as varchar(10))",
    "status": "case when p_retailprice > 1000 then 'ACTIVE' else 'DRAFT' end",
}
INVENTORY = "inventory as (select " + ", ".join(f"{v} as {k}" for k, v in INVENTORY_COLS.items()) + " from part)"


def _inventory(spark, d):
    return table(spark, d, "part").select(*[F.expr(v).cast("string").alias(k) for k, v in INVENTORY_COLS.items()])


GOVERNED = "case lang when 'en' then 'Not documented in this part' when 'de' then '**Rule** of ' || source when 'fr' then '[Error: none]' else '' end"
CONTEXTS = f"""
contexts as (
  select {normalize_sql('c_name')} as entity_key, {RESPONSE} as formal_definition, source as domain_context, {GOVERNED} as governance_rules
  from documents join customer on doc_id = c_custkey)"""


def _contexts(spark, d):
    rows = documents(spark, d).join(
        table(spark, d, "customer"), F.col("doc_id") == F.col("c_custkey")
    )
    rest = [F.lit("").alias(c) for c in catalog.CONTEXT if c not in ("formal_definition", "domain_context", "governance_rules")]
    return rows.select(
        normalize(F.col("c_name")).alias("entity_key"),
        F.expr(RESPONSE).alias("formal_definition"),
        F.col("source").alias("domain_context"),
        F.expr(GOVERNED).alias("governance_rules"),
        *rest,
    )


RELATIONS = "relations as (select upper(c_name) as source_entity, o_orderpriority as target_entity, o_orderstatus as relationship_type from orders join customer on o_custkey = c_custkey)"


def _relations(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.selectExpr("upper(c_name) as source_entity", "o_orderpriority as target_entity", "o_orderstatus as relationship_type")


FORCED = "forced as (select c_name as entity_name from customer where c_mktsegment = 'AUTOMOBILE' and c_acctbal < 1000)"


def _forced(spark, d):
    return table(spark, d, "customer").where("c_mktsegment = 'AUTOMOBILE' and c_acctbal < 1000").selectExpr("c_name as entity_name")


# --- matching ----------------------------------------------------------------


def _variants_sql(bases: str, name: str) -> str:
    return f"""
{name} as (
  select base, base as variant from {bases}
  union select base, alias from {bases} join aliases on base = canonical
  union select base, canonical from {bases} join aliases on base = alias
  union select base, replace(base, 'association', 'assoc') from {bases} where contains(base, 'association')
  union select base, replace(base, 'football', 'fa') from {bases} where contains(base, 'football'))"""


MATCH = f"""
{MODEL}, {ALIASES}, {TERMS},
ebase as (select distinct {normalize_sql('entity_name')} as base from model),
tbase as (select distinct {normalize_sql('term')} as base from terms),
{_variants_sql('ebase', 'evar')}, {_variants_sql('tbase', 'tvar')},
eindex as (
  select * from (
    select variant, entity_name, domain, fact_sheet_id,
      row_number() over (partition by variant order by (variant <> base)::int, ord) as k
    from evar join model on base = {normalize_sql('entity_name')}) where k = 1),
found as (
  select t.ord, v.base, v.variant, e.entity_name, e.domain, e.fact_sheet_id,
    row_number() over (partition by t.ord order by (v.variant <> v.base)::int, v.variant) as k
  from terms t join tvar v on v.base = {normalize_sql('t.term')} join eindex e on e.variant = v.variant),
mapped as (
  select t.ord, t.term, lower(t.term) as term_lower, coalesce(f.entity_name, 'Not mapped') as mapped_entity,
    coalesce(f.domain, '') as domain, coalesce(f.fact_sheet_id, '') as fact_sheet_id,
    case when f.ord is null then 'low' when f.variant = f.base then 'high' else 'medium' end as mapping_confidence,
    case when f.ord is null then 'No matching entity name in conceptual model' when f.variant = f.base then 'Direct name match'
      else 'Alias match via ''' || t.term || ''' → ''' || f.entity_name || '''' end as mapping_rationale
  from terms t left join (select * from found where k = 1) f on t.ord = f.ord)"""


def _mappings(spark, d):
    return matching.match_terms(_terms(spark, d), _model(spark, d), _aliases(spark, d))


@query(f"""
with {ALIASES}, {TERMS},
bases as (select distinct {normalize_sql('term')} as base from terms
          union select 'football association ' || s_suppkey from supplier),
{_variants_sql('bases', 'v')}
select base, variant, base = variant as is_base from v
""")
def alias_variants(spark, d):
    more = table(spark, d, "supplier").selectExpr("'football association ' || s_suppkey as base")
    names = _terms(spark, d).select(normalize(F.col("term")).alias("base")).unionByName(more)
    return matching.alias_variants(names, _aliases(spark, d))


@query(f"""
with {ALIASES}, {TERMS},
b as (select distinct {normalize_sql('term')} as base from terms),
c as (select base, base as canonical from b union all select base, canonical from b join aliases on base = alias)
select base, alias from c join aliases using (canonical) where alias <> base
union select base, canonical from c where canonical <> base
""")
def alias_lookup(spark, d):
    names = _terms(spark, d).select(normalize(F.col("term")).alias("base"))
    return matching.aliases_of(names, _aliases(spark, d))


@query(f"with {MATCH} select * from mapped")
def term_entity_match(spark, d):
    return _mappings(spark, d)


@query(f"""
with t as (select distinct lower(p_type) as term from part union select distinct lower(split_part(p_name, ' ', 1)) from part
           union select lower(n_name) from nation),
e as (select c_custkey as ord, c_mktsegment || ' ' || n_name as entity_name, 'C' as domain from customer join nation on c_nationkey = n_nationkey
      union all select 1000000000000 + p_partkey, p_name || ' ' || p_type, 'P' from part)
select term, arg_min(entity_name, ord) as mapped_entity, arg_min(domain, ord) as domain
from t join e on contains({normalize_sql('entity_name')}, term) group by term
""")
def term_substring_join(spark, d):
    part, nation = table(spark, d, "part"), table(spark, d, "nation")
    terms = (
        part.selectExpr("lower(p_type) as term")
        .unionByName(part.selectExpr("lower(split_part(p_name, ' ', 1)) as term"))
        .unionByName(nation.selectExpr("lower(n_name) as term"))
    )
    people = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    entities = people.selectExpr("c_custkey as ord", "c_mktsegment || ' ' || n_name as entity_name", "'C' as domain").unionByName(
        part.selectExpr("1000000000000 + p_partkey as ord", "p_name || ' ' || p_type as entity_name", "'P' as domain")
    )
    return matching.match_terms_by_substring(terms, entities)


BEST = f"""
best as (
  select * from (
    select {normalize_sql('mapped_entity')} as entity_key, ord, term, term_lower, mapping_confidence, mapping_rationale,
      row_number() over (partition by {normalize_sql('mapped_entity')} order by (term_lower <> {normalize_sql('mapped_entity')})::int, ord) as k
    from mapped where {normalize_sql('mapped_entity')} not in ('', 'not mapped', 'none')) where k = 1)"""


@query(f"with {MATCH}, {BEST} select entity_key, ord, term, term_lower, mapping_confidence, mapping_rationale from best")
def best_mapping(spark, d):
    return matching.best_mapping(_mappings(spark, d))


FORCED_BEST = f"""
forced_best as (
  select entity_key, ord, term, term_lower, mapping_confidence, mapping_rationale from best
  union all
  select distinct {normalize_sql('entity_name')}, null::bigint, {normalize_sql('entity_name')}, {normalize_sql('entity_name')}, 'medium',
    'Forced handbook match — entity present in Handbook without formal definition'
  from forced where {normalize_sql('entity_name')} not in (select entity_key from best))"""


@query(f"with {MATCH}, {BEST}, {FORCED}, {FORCED_BEST} select * from forced_best")
def forced_entries(spark, d):
    return matching.with_forced(matching.best_mapping(_mappings(spark, d)), _forced(spark, d))


@query(f"""
with {ALIASES}, {TERMS}, {MODEL},
bases as (select distinct {normalize_sql('entity_name')} as base from model), {_variants_sql('bases', 'v')},
d as (select {normalize_sql('term')} as term_lower, definition from terms),
f as (select base, term_lower as term, definition, row_number() over (partition by base order by (variant <> base)::int, variant) as k
      from v join d on variant = term_lower)
select base, term, definition from f where k = 1
""")
def definition_lookup(spark, d):
    names = _model(spark, d).select(normalize(F.col("entity_name")).alias("base"))
    definitions = _terms(spark, d).select(normalize(F.col("term")).alias("term_lower"), "definition")
    return matching.definition_lookup(names, matching.alias_variants(names, _aliases(spark, d)), definitions)


# --- consolidation -----------------------------------------------------------


@query(f"""
with {MODEL}, {INVENTORY}
select m.ord, m.entity_name, m.fact_sheet_id, coalesce(i.description, 'Not documented in LeanIX inventory') as description,
  coalesce(i.level, '') as level, coalesce(i.status, '') as status, coalesce(i.type, '') as inventory_type, i.id is not null as in_inventory
from model m left join inventory i on m.fact_sheet_id = i.id
""")
def inventory_left_join(spark, d):
    out = catalog.inventory_join(_model(spark, d), _inventory(spark, d))
    return out.select("ord", "entity_name", "fact_sheet_id", "description", "level", "status", "inventory_type", "in_inventory")


def _real(x: str, denials) -> str:
    starts = " or ".join(f"starts_with(lower({x}), '{p}')" for p in denials)
    return f"({x} <> '' and not starts_with({x}, '[Error:') and not ({starts}))"


REAL_DEF = _real(strip_sql("coalesce(formal_definition, '')"), fixed.NO_DEFINITION)
REAL_GOV = _real(
    strip_sql(r"regexp_replace(" + strip_sql("coalesce(governance_rules, '')") + r", '\A\*+', '')"), fixed.NO_GOVERNANCE
)
CONSOLIDATED = f"""
{MATCH}, {BEST}, {FORCED}, {FORCED_BEST}, {INVENTORY}, {CONTEXTS}, {RELATIONS},
rels as (select {normalize_sql('source_entity')} as entity_key, count(*) as n_relationships from relations group by 1),
joined as (
  select m.*, coalesce(i.description, 'Not documented in LeanIX inventory') as leanix_description, f.term, f.mapping_confidence,
    f.mapping_rationale, c.formal_definition, c.domain_context, c.governance_rules, r.n_relationships,
    f.term is null and ({REAL_DEF} or {REAL_GOV}) as promoted
  from (select *, {normalize_sql('entity_name')} as entity_key from model) m
  left join inventory i on m.fact_sheet_id = i.id
  left join forced_best f on m.entity_key = f.entity_key
  left join contexts c on m.entity_key = c.entity_key
  left join rels r on m.entity_key = r.entity_key),
consolidated as (
  select fact_sheet_id, entity_name, domain, domain_fact_sheet_id, subgroup, subgroup_fact_sheet_id,
    case when term is not null or promoted then 'BOTH' else 'LEANIX_ONLY' end as source, leanix_description,
    coalesce(formal_definition, '') as formal_definition, coalesce(domain_context, '') as domain_context,
    coalesce(governance_rules, '') as governance_rules, '' as business_rules, '' as lifecycle_states, '' as data_classification,
    '' as regulatory_context, '' as associated_agreements, term as handbook_term,
    case when promoted then 'medium' else coalesce(mapping_confidence, '') end as mapping_confidence,
    case when promoted then 'Handbook content found via RAG — entity referenced but not exact-matched in Step 4'
      else coalesce(mapping_rationale, '') end as mapping_rationale,
    'PENDING' as review_status, '' as review_notes, coalesce(n_relationships, 0) as n_relationships
  from joined)"""


def _consolidated(spark, d, mappings=None, contexts=None):
    return catalog.consolidate(
        _model(spark, d), _mappings(spark, d) if mappings is None else mappings, _inventory(spark, d),
        _contexts(spark, d) if contexts is None else contexts, _relations(spark, d), _forced(spark, d),
    )


@query(f"with {CONSOLIDATED} select * from consolidated")
def consolidate_entities(spark, d):
    return _consolidated(spark, d)


LEFTOVER = f"""
leftover as (
  select * from terms where {normalize_sql('term')} not in (select {normalize_sql('entity_name')} from model)
    and lower(term) not in (select term_lower from mapped where mapped_entity <> 'Not mapped'))"""


@query(f"with {MATCH}, {LEFTOVER} select * from leftover")
def handbook_only(spark, d):
    return catalog.handbook_only(_terms(spark, d), _model(spark, d), _mappings(spark, d))


# An inferred place per term, standing for the model's JSON answer.
TIER = "case when length(term) > 10 then 'existing' else 'new_proposed' end"


def _full_catalog(spark, d, contexts=None):
    from docmosaic.functions.predicates import review_status

    # the mapping is used twice; it is written once, as the step it is
    mappings = materialize(_mappings(spark, d), "mappings")
    only = materialize(catalog.handbook_only(_terms(spark, d), _model(spark, d), mappings), "only")
    inferred = only.select(
        F.lower("term").alias("term_lower"),
        F.lit("AFRICA").alias("entity_domain"),
        F.lit("").alias("entity_subgroup"),
        F.expr(TIER).alias("inference_tier"),
        F.lit("high").alias("inference_confidence"),
        F.lit("").alias("inference_reasoning"),
        F.lit("").alias("alternative_domain"),
    ).withColumn("review_status", review_status(F.col("inference_tier"), F.col("inference_confidence")))
    records = catalog.handbook_only_records(only, inferred, _contexts(spark, d) if contexts is None else contexts)
    return _consolidated(spark, d, mappings, contexts).unionByName(records, allowMissingColumns=True)


FULL = f"""
{CONSOLIDATED}, {LEFTOVER},
catalog as (
  select entity_name, domain, subgroup, source, review_status, formal_definition, governance_rules from consolidated
  union all
  select term, 'AFRICA', '', 'HANDBOOK_ONLY', case when length(term) > 10 then 'PENDING' else 'PROPOSED_NEW_TAXONOMY' end,
    definition, coalesce(c.governance_rules, '') from leftover left join contexts c on {normalize_sql('term')} = c.entity_key)"""


@query(f"""
with {FULL}
select 'source' as metric, source as value, count(*) as n from catalog group by 2
union all select 'review_status', review_status, count(*) from catalog group by 2
union all select 'definition', case when {REAL_DEF} then 'real' else 'none' end, count(*) from catalog group by 2
union all select 'governance', case when {REAL_GOV} then 'real' else 'none' end, count(*) from catalog group by 2
""")
def catalog_summary(spark, d):
    return catalog.catalog_summary(_full_catalog(spark, d))


@query(f"""
with {FULL}
select domain, case when source = 'HANDBOOK_ONLY' then 'handbook_only' when subgroup <> '' then 'subtypes' else 'entities' end as branch,
  subgroup, count(*) as n from catalog group by all
""")
def hierarchy_counts(spark, d):
    tree = catalog.hierarchy(_full_catalog(spark, d), _model(spark, d), _inventory(spark, d))
    return catalog.hierarchy_counts(tree)


@query(f"""
with {FULL}
select entity_name, source, domain, subgroup,
  case domain when 'AFRICA' then 'D0' when 'AMERICA' then 'D1' when 'ASIA' then 'D2' when 'EUROPE' then 'D3' else 'D4' end as domain_id,
  case when subgroup = '' then '' else 'S' || replace(subgroup, 'NATION_', '') end as subtype_id, '' as domain_description
from catalog
""")
def hierarchy_metadata(spark, d):
    tree = catalog.hierarchy(_full_catalog(spark, d), _model(spark, d), _inventory(spark, d))
    return tree.select("entity_name", "source", "domain", "subgroup", "domain_id", "subtype_id", "domain_description")


@query(f"""
with {FULL}
select entity_name, source, formal_definition, domain, subgroup,
  case when source = 'HANDBOOK_ONLY' then 'handbook_only' when subgroup <> '' then 'subtypes' else 'entities' end as branch,
  case domain when 'AFRICA' then 'D0' when 'AMERICA' then 'D1' when 'ASIA' then 'D2' when 'EUROPE' then 'D3' else 'D4' end as domain_id,
  case when subgroup = '' then '' else 'S' || replace(subgroup, 'NATION_', '') end as subtype_id
from catalog
""")
def nested_catalog(spark, d):
    """The catalog from contexts of a stopped and resumed run, written as nested pages and read back from them."""
    kept = Progress(spark, shared_path(spark, "progress"))
    items = materialize(_contexts(spark, d), "items")
    # the first run stops with half of the entities; the second does the rest
    kept.run(items.where(F.pmod(F.xxhash64("entity_key"), F.lit(2)) == 0), "entity_key", lambda batch: batch)
    contexts = kept.run(items, "entity_key", lambda batch: batch).select(*items.columns)
    tree = catalog.hierarchy(_full_catalog(spark, d, contexts), _model(spark, d), _inventory(spark, d))
    out = shared_path(spark, "catalog")
    writers.write_catalog(catalog.nested_pages(tree), _relations(spark, d), out)
    entity = "entity_name string, source string, formal_definition string"
    path = "domain string, domain_id string, branch string, subgroup string, subtype_id string"
    pages = spark.read.schema(f"{path}, entities array<struct<{entity.replace(' string', ':string')}>>").json(f"{out}/nested")
    return pages.select(*[f.split()[0] for f in path.split(", ")], F.inline("entities"))


@query(f"""
with {MODEL},
g as (select domain, case when subgroup = '' then 'entities' else subgroup end as subgroup, entity_name from model),
r as (select *, row_number() over (partition by domain, subgroup order by entity_name) as k from g)
select domain, subgroup, string_agg(entity_name, '|' order by entity_name) as names from r where k <= 10 group by all
""")
def taxonomy_context(spark, d):
    return catalog.taxonomy(_model(spark, d)).select("domain", "subgroup", F.array_join("names", "|").alias("names"))


@query(f"""
with {MODEL},
r as (select *, row_number() over (partition by domain, subgroup order by entity_name) as k,
             count(*) over (partition by domain, subgroup) as n from model)
select domain, subgroup, n, string_agg(entity_name, ', ' order by entity_name) || case when max(n) > 8 then '...' else '' end as sample
from r where k <= 8 group by all
""")
def member_samples(spark, d):
    return catalog.member_samples(_model(spark, d))


@query(f"""
with {MODEL}, {CONTEXTS},
none as (select {normalize_sql('entity_name')} as entity_key from model where subgroup = '')
select entity_key, formal_definition, domain_context, governance_rules from contexts where entity_key not in (select * from none)
union all select entity_key, 'Not defined in FA Handbook', '', 'Not documented — outside governance scope' from none
""")
def no_coverage(spark, d):
    model = _model(spark, d)
    out = catalog.canned_context(model, model.where("subgroup = ''"), _contexts(spark, d))
    return out.select("entity_key", "formal_definition", "domain_context", "governance_rules")


@query(f"""
with {CONTEXTS},
s as (select lower(c_name) as entity_key, 'curated ' || c_mktsegment as domain_context,
             case when c_acctbal > 3000 then 'curated rule' end as governance_rules from customer where c_mktsegment = 'BUILDING')
select c.entity_key, c.formal_definition, coalesce(s.domain_context, c.domain_context) as domain_context,
       coalesce(s.governance_rules, c.governance_rules) as governance_rules
from contexts c left join s using (entity_key)
""")
def static_override(spark, d):
    static = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").selectExpr(
        "lower(c_name) as entity_key", "'curated ' || c_mktsegment as domain_context",
        "case when c_acctbal > 3000 then 'curated rule' end as governance_rules",
    )
    out = catalog.static_override(_contexts(spark, d), static)
    return out.select("entity_key", "formal_definition", "domain_context", "governance_rules")


@query(f"with {RELATIONS} select {normalize_sql('source_entity')} as entity_key, count(*) as n_relationships from relations group by 1")
def relationships_by_source(spark, d):
    return catalog.relationships_by_source(_relations(spark, d))


# --- gap analysis, sets, resume ----------------------------------------------

NAMES = f"""
model_names as (select c_custkey as ord, c_name as name from customer where c_acctbal > 0),
found_names as (
  select o_orderkey as ord, '  ' || upper(c_name) || '  ' as name from orders join customer on o_custkey = c_custkey
  union all select 1000000000000 + s_suppkey, s_name from supplier),
mk as (select {normalize_sql('name')} as k, arg_max(name, ord) as name from model_names group by 1),
fk as (select {normalize_sql('name')} as k, arg_max(name, ord) as name from found_names group by 1),
gap as (
  select coalesce(m.k, f.k) as normalized_name, coalesce(m.name, '') as model_name, coalesce(f.name, '') as handbook_name,
    case when m.k is not null and f.k is not null then 'MATCHED' when m.k is not null then 'MODEL_ONLY' else 'HANDBOOK_ONLY' end as status
  from mk m full outer join fk f on m.k = f.k)"""


def _names(spark, d):
    customers = table(spark, d, "customer")
    model = customers.where("c_acctbal > 0").selectExpr("c_custkey as ord", "c_name as name")
    orders = table(spark, d, "orders")
    found = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "o_orderkey as ord", "'  ' || upper(c_name) || '  ' as entity_name", "cast(null as string) as term"
    )
    more = table(spark, d, "supplier").selectExpr("1000000000000 + s_suppkey as ord", "'' as entity_name", "s_name as term")
    return model, gap.candidate_names(found.unionByName(more))


@query(f"with {NAMES} select * from gap")
def gap_analysis(spark, d):
    return gap.gap_analysis(*_names(spark, d))


@query(f"with {NAMES} select status, count(*) as n from gap group by 1")
def gap_counts(spark, d):
    return gap.gap_counts(gap.gap_analysis(*_names(spark, d)))


@query(f"with {NAMES} select {normalize_sql('name')} as name from model_names intersect select {normalize_sql('name')} from found_names")
def names_intersect(spark, d):
    model, found = (n.select(normalize(F.col("name")).alias("name")) for n in _names(spark, d))
    return model.intersect(found)


@query(f"with {NAMES} select {normalize_sql('name')} as name from found_names except select {normalize_sql('name')} from model_names")
def names_except(spark, d):
    model, found = (n.withColumnRenamed("name", "entity_name") for n in _names(spark, d))
    return catalog.missing_names(model, found)


@query(f"with {MODEL} select ord, entity_name, domain from model where domain = 'AMERICA' and {normalize_sql('entity_name')} in ('customer#000000002', 'customer#000000012')")
def entity_filter(spark, d):
    picked = catalog.select_entities(_model(spark, d), "america", [" CUSTOMER#000000002 ", "Customer#000000012"])
    return picked.select("ord", "entity_name", "domain")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P' and o_totalprice > 300000)")
def resume_anti_join(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'P' and o_totalprice > 300000").selectExpr("o_custkey as c_custkey")
    return catalog.remaining(table(spark, d, "customer").select("c_custkey", "c_name"), done, "c_custkey")


# --- validation --------------------------------------------------------------


@query(f"""
with {MODEL}
select coalesce(domain, 'TOTAL') as domain, count(*) as total, count(*) filter (fact_sheet_id <> '') as with_id,
  count(*) filter (fact_sheet_id = '') as no_id, count(*) filter (subgroup <> '') as subgroup,
  100 * count(*) filter (fact_sheet_id <> '') // count(*) as with_id_pct, 100 * count(*) filter (subgroup <> '') // count(*) as subgroup_pct
from model group by rollup (domain)
""")
def model_validation_rollup(spark, d):
    return validation.completeness(_model(spark, d))


@query(f"""
with {MODEL},
f as (select count(*) as n, count(*) filter (fact_sheet_id <> '') as ids, count(*) filter (subgroup <> '') as subs from model)
select 'fact_sheet_ids' as check_name, ids = n as passed, case when ids = n then 'complete' when ids = 0 then 'none' else 'partial' end as detail from f
union all select 'entity_count', n >= 150, n::varchar from f
union all select 'subtypes', subs >= 100 or subs = 0, subs::varchar from f
""")
def acceptance_checks(spark, d):
    return validation.acceptance(_model(spark, d))


# --- dedupes, edges, pairs ---------------------------------------------------


@query("""
select domain, subgroup, label, p_partkey from (
  select *, row_number() over (partition by lower(label) order by domain, subgroup, label, p_partkey) as k from (
    select p_brand as domain, p_type as subgroup, case when p_size > 25 then upper(p_name) else p_name end as label, p_partkey from part))
where k = 1
""")
def dedupe_keep_first(spark, d):
    rows = table(spark, d, "part").selectExpr(
        "p_brand as domain", "p_type as subgroup", "case when p_size > 25 then upper(p_name) else p_name end as label", "p_partkey"
    )
    return ranking.keep_first(rows, [F.lower("label")], ["domain", "subgroup", "label", "p_partkey"])


@query(f"select min(doc_id) as doc_id, count(*) as copies, sha256({collapse_sql('text')}) as digest from documents group by 3")
def chunk_dedupe(spark, d):
    digest = content_hash(collapse(F.col("text")))
    return (
        documents(spark, d)
        .groupBy(digest.alias("digest"))
        .agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    )


EDGES = "case when l_returnflag = 'R' then 'S' || l_suppkey else 'P' || l_partkey end as entity_a, case when l_returnflag = 'R' then 'p' || l_partkey else 's' || l_suppkey end as entity_b"


@query(f"""
select entity_a, entity_b, l_orderkey, l_linenumber, l_shipdate, l_quantity from (
  select *, row_number() over (partition by least(lower(entity_a), lower(entity_b)), greatest(lower(entity_a), lower(entity_b))
                               order by l_orderkey, l_linenumber, l_shipdate, l_quantity, entity_a, entity_b) as k
  from (select {EDGES}, l_orderkey, l_linenumber, l_shipdate, l_quantity from lineitem)) where k = 1
""")
def undirected_edge_dedupe(spark, d):
    li = spread(table(spark, d, "lineitem"), "l_partkey")
    a, b = (x.strip() for x in EDGES.split(" as entity_a,"))
    rows = li.selectExpr(f"{a} as entity_a", b, "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    order = ["l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "entity_a", "entity_b"]
    return matching.undirected_edges(rows, order)


ASSETS = """
assets as (
  select 'P' || p_partkey as id, p_name as label, p_brand as domain from part where p_size > 10
  union all select 'S' || s_suppkey, s_name, 'NATION_' || s_nationkey from supplier where s_acctbal > 0),
edges as (select l_orderkey, l_linenumber, 'P' || l_partkey as source_id, 'S' || l_suppkey as target_id from lineitem)"""


def _assets(spark, d):
    parts = table(spark, d, "part").where("p_size > 10").selectExpr("'P' || p_partkey as id", "p_name as label", "p_brand as domain")
    supp = table(spark, d, "supplier").where("s_acctbal > 0").selectExpr("'S' || s_suppkey as id", "s_name as label", "'NATION_' || s_nationkey as domain")
    edges = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "'P' || l_partkey as source_id", "'S' || l_suppkey as target_id")
    return parts.unionByName(supp), edges


@query(f"with {ASSETS} select * from edges where source_id in (select id from assets) and target_id in (select id from assets)")
def edges_known_endpoints(spark, d):
    assets, edges = _assets(spark, d)
    return matching.known_endpoints(edges, assets)


@query(f"""
with {ASSETS}
select e.*, coalesce(a.label, '') as source_entity, coalesce(a.domain, '') as source_domain,
  coalesce(b.label, '') as target_entity, coalesce(b.domain, '') as target_domain
from edges e left join assets a on e.source_id = a.id left join assets b on e.target_id = b.id
""")
def enrich_edges(spark, d):
    assets, edges = _assets(spark, d)
    return matching.enrich_edges(edges, assets)


@query("""
with t as (select c_custkey as ord, n_name as topic, c_mktsegment || ' of ' || n_name as term from customer join nation on c_nationkey = n_nationkey),
r as (select *, row_number() over (partition by topic order by ord) as rank, min(ord) over (partition by topic) as topic_ord from t),
p as (select a.topic, a.term as entity_a, b.term as entity_b,
        row_number() over (partition by least(lower(a.term), lower(b.term)), greatest(lower(a.term), lower(b.term))
                           order by a.topic_ord, a.rank, b.rank) as k
      from r a join r b on a.topic = b.topic and a.rank < b.rank and b.rank <= 5)
select topic, entity_a, entity_b from p where k = 1
""")
def topic_pairs(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return matching.topic_pairs(rows.selectExpr("c_custkey as ord", "n_name as topic", "c_mktsegment || ' of ' || n_name as term"))


# --- inventory, collections, hashes ------------------------------------------

TYPE_ROWS = ", ".join(f"('{t}', '{s}', '{label}')" for t, s, label in fixed.INVENTORY_TYPES)


@query(f"""
with {INVENTORY}, types as (select * from (values {TYPE_ROWS}) t(type, suffix, title))
select 'inv_' || suffix as collection, type, title, count(*) as n from inventory join types using (type) group by all
""")
def typed_partition(spark, d):
    typed = inventory.typed(_inventory(spark, d), "inv")
    return typed.groupBy("collection", "type", "title").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
with {INVENTORY}
select id, '## ' || name || chr(10) || chr(10) || '**LeanIX ID**: `' || id || '`  ' || chr(10) || '**Level**: ' || level || '  ' || chr(10)
  || case when type = 'Interface' then '**Data flow**: ' || regexp_extract(name, '^(.*?) to ', 1) || ' → ' || regexp_extract(name, ' to (.*)$', 1) || '  ' || chr(10) else '' end
  || chr(10) || case when description = '' then '_No description recorded in LeanIX._' else description end || chr(10) || chr(10) || '---' as markdown
from inventory where type <> 'Unlisted'
""")
def inventory_markdown(spark, d):
    typed = inventory.typed(_inventory(spark, d), "inv")
    return typed.select("id", inventory.markdown_row().alias("markdown"))


CHUNKS_BY_LANG = "chunks as (select lang || '_' || source as collection, doc_id from documents)"


def _by_language(spark, d):
    return documents(spark, d).select(F.concat_ws("_", "lang", "source").alias("collection"), "doc_id")


@query(f"""
with {CHUNKS_BY_LANG}, c as (select collection, count(*) as n_chunks, count(vec_id) as n_indexed from chunks left join embeddings on doc_id = vec_id group by 1)
select collection, n_chunks, n_indexed, (n_indexed = 0)::bigint as missing from c
union all select 'TOTAL', sum(n_chunks)::bigint, sum(n_indexed)::bigint, count(*) filter (n_indexed = 0) from c
""")
def collection_status(spark, d):
    chunks = _by_language(spark, d)
    indexed = chunks.join(table(spark, d, "embeddings").selectExpr("vec_id as doc_id"), "doc_id", "left_semi")
    return collections.status(chunks, indexed)


@query(f"""
with {CHUNKS_BY_LANG}, p as (select * from (values (0, 'fr'), (1, 'en'), (2, 'src')) t(n, prefix))
select n, prefix, collection from p join (select distinct collection from chunks) on starts_with(collection, prefix || '_')
""")
def resolve_prefixes(spark, d):
    return collections.resolve_prefixes(_by_language(spark, d), ["fr", "en", "src"])


@query(f"""
with {CHUNKS_BY_LANG}, names as (select distinct collection from chunks),
p as (select 0 as step, 0 as n, collection from names where collection = 'en_src3'
      union all select 0, 1, collection from names where collection = 'de_src1'
      union all select 1, 0, collection from names where starts_with(collection, 'en_')
      union all select 1, 1, collection from names where starts_with(collection, 'fr_')),
f as (select collection, min(step * 1000 + n) as k from p group by 1)
select collection, row_number() over (order by k, collection) - 1 as position from f
""")
def profile_collections(spark, d):
    from docmosaic.sources.profiles import QueryProfile, profile_collections

    profile = QueryProfile(collections=["en_src3", "de_src1"], collection_prefixes=["en", "fr"])
    return profile_collections(_by_language(spark, d), profile)


LEDGER = """
files as (select source as collection, 'doc/' || doc_id as file_path, case when n_chars < 100 then null else sha256(text) end as hash, lang from documents),
ledger as (select collection, file_path, case when lang = 'de' then 'stale' else hash end as hash from files where lang in ('en', 'de') and hash is not null)"""


def _files(spark, d):
    files = documents(spark, d).select(
        F.col("source").alias("collection"),
        F.concat(F.lit("doc/"), F.col("doc_id")).alias("file_path"),
        F.when(F.col("n_chars") >= 100, content_hash(F.col("text"))).alias("hash"),
        "lang",
    )
    stale = F.when(F.col("lang") == "de", F.lit("stale")).otherwise(F.col("hash"))
    ledger = files.where("lang in ('en', 'de') and hash is not null").select("collection", "file_path", stale.alias("hash"))
    return files, ledger


@query(f"""
with {LEDGER}
select f.collection, f.file_path, f.hash from files f left join ledger l on f.collection = l.collection and f.file_path = l.file_path
where f.hash is null or l.hash is null or f.hash <> l.hash
""")
def changed_files(spark, d):
    files, ledger = _files(spark, d)
    return hashes.changed(files.drop("lang"), ledger)


@query(f"""
with {LEDGER}
select coalesce(f.collection, l.collection) as collection, coalesce(f.file_path, l.file_path) as file_path, coalesce(f.hash, l.hash) as hash
from (select * from files where lang in ('de', 'fr') and hash is not null) f
full outer join ledger l on f.collection = l.collection and f.file_path = l.file_path
""")
def hash_upsert(spark, d):
    files, ledger = _files(spark, d)
    return hashes.upsert(ledger, files.where("lang in ('de', 'fr')").drop("lang"))


@query(f"with {LEDGER} select collection, count(*) as n_files from ledger where collection not in ('src1', 'src2') group by 1")
def file_hash_counts(spark, d):
    _, ledger = _files(spark, d)
    return hashes.counts(hashes.remove(ledger, ["src1", "src2"]))
