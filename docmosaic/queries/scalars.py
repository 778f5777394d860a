"""Text functions, predicates and parsers over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmosaic.functions import fixed, markup, parse, predicates, text
from docmosaic.queries import query
from docmosaic.queries.base import collapse_sql, documents, normalize_sql, strip_sql, table

# Answers to judge: documents, some opened or closed by what the predicates look for.
# One text for both engines; it only builds the input.
RESPONSE = """case source
  when 'src0' then 'Not defined in FA Handbook. ' || text
  when 'src1' then '[Error: ' || text
  when 'src2' then '  **No governance ** ' || text
  when 'src3' then 'No specific rules imposed. ' || text
  when 'src4' then '   '
  when 'src5' then text || ' as stated in Section 12'
  when 'src6' then 'I cannot find this. ' || text
  when 'src7' then 'The provided text does not say. ' || text
  when 'src8' then 'No formal definition in s' || '07'
  when 'src9' then 'Rule E1 of ' || lang
  when 'src10' then 'RULE B1, ' || text
  when 'src11' then text || ' No formal definition.'
  else text end"""


def _starts(x: str, openings) -> str:
    return " or ".join(f"starts_with({x}, '{o}')" for o in openings)


def _has(x: str, fragments) -> str:
    return " or ".join(f"contains({x}, '{f.replace(chr(39), chr(39) * 2)}')" for f in fragments)


def _responses(spark, d):
    return documents(spark, d).select("doc_id", F.expr(RESPONSE).alias("response"))


RESPONSES = f"responses as (select doc_id, {RESPONSE} as response from documents), r as (select doc_id, {strip_sql('response')} as t from responses)"


@query(f"select doc_id, md5({normalize_sql('text')}) as normalized, length({normalize_sql('text')}) as n from documents")
def normalize_name(spark, d):
    n = text.normalize(F.col("text"))
    return documents(spark, d).select(
        "doc_id", F.md5(n).alias("normalized"), F.length(n).cast("bigint").alias("n")
    )


@query(r"select page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '\A_+|_+\z', '', 'g') as slug from pages")
def slugify(spark, d):
    return table(spark, d, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))


def _decoded(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, '{a}', {'chr(10)' if b == chr(10) else repr(b)})"
    return x


LABEL_SQL = collapse_sql(_decoded("regexp_replace(html, '<[^>]+>', '', 'g')", markup.LABEL_ENTITIES))


@query(f"select page_id, md5({LABEL_SQL}) as label_md5, length({LABEL_SQL}) as n from pages")
def html_clean(spark, d):
    label = markup.clean_label(F.col("html"))
    return table(spark, d, "pages").select(
        "page_id", F.md5(label).alias("label_md5"), F.length(label).cast("bigint").alias("n")
    )


PAGE_SQL = r"""regexp_replace(regexp_replace(regexp_replace(html,
 '(?is)<(?:script|style)\b.*?</(?:script|style)\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"""
PAGE_SQL = collapse_sql(_decoded(PAGE_SQL, (*markup.LABEL_ENTITIES[1:], markup.LABEL_ENTITIES[0])))


@query(f"select page_id, url, {PAGE_SQL} as body from pages")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", "url", markup.page_text(F.col("html")).alias("body"))


@query("select doc_id, sha256(text) as hash, source || '::' || doc_id as file_key from documents")
def content_hash(spark, d):
    return documents(spark, d).select(
        "doc_id",
        text.content_hash(F.col("text")).alias("hash"),
        text.file_key(F.col("source"), F.col("doc_id").cast("string")).alias("file_key"),
    )


@query(f"""
select doc_id, left({collapse_sql('text')}, 100) as p100, left({collapse_sql('text')}, 200) as p200,
       case when length(text) > 800 then left(text, 800) || '…' else text end as cut
from documents
""")
def preview_text(spark, d):
    c = F.col("text")
    return documents(spark, d).select(
        "doc_id",
        text.preview(c, 100).alias("p100"),
        text.preview(c, 200).alias("p200"),
        text.ellipsis(c).alias("cut"),
    )


@query("""
select doc_id, coalesce(nullif(case when lang = 'en' then '' else lang end, ''),
  nullif(case when n_chars > 500 then source else null end, ''), 'unknown') as label from documents
""")
def collection_label(spark, d):
    a = F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("lang"))
    b = F.when(F.col("n_chars") > 500, F.col("source"))
    return documents(spark, d).select("doc_id", text.first_nonblank(a, b, F.lit("unknown")).alias("label"))


INTERFACE = """case when p_type = 'PROMO' then p_name else p_name || case when p_size > 25 then ' to ' else '  TO ' end
  || p_type || case when p_size > 40 then ' LI' when p_size < 5 then ' li' else '' end end"""


@query("""
select p_partkey, case when p_type <> 'PROMO' then p_name end as source_name,
       case when p_type <> 'PROMO' then p_type end as target_name from part
""")
def interface_endpoints(spark, d):
    source, target = text.interface_endpoints(F.expr(INTERFACE))
    return table(spark, d, "part").select("p_partkey", source.alias("source_name"), target.alias("target_name"))


STYLE = """'html=1;edgeStyle=' || case when p_size < 10 then 'entityRelationEdgeStyle' when p_size < 20 then 'orthogonalEdgeStyle'
  when p_size < 30 then 'elbowEdgeStyle' else 'none' end
  || ';startArrow=' || case p_type when 'PROMO' then 'ERzeroToMany' when 'SMALL' then 'ERoneToMany'
  when 'LARGE' then 'ERoneToOne' when 'MEDIUM' then 'ERzeroToOne' else 'none' end
  || ';endArrow=' || case when p_size > 40 then 'ERzeroToMany' when p_size > 30 then 'ERoneToMany'
  when p_size > 22 then 'ERoneToOne' when p_size > 15 then 'ERzeroToOne' else 'classic' end || ';'"""
DECODED = """
marks as (
  select p_partkey,
    case when p_size < 10 then 'Entity Relationship' when p_size < 20 then 'Orthogonal' when p_size < 30 then 'Elbow' end as relationship_type,
    case p_type when 'PROMO' then '0..*' when 'SMALL' then '1..*' when 'LARGE' then '1..1' when 'MEDIUM' then '0..1' else '' end as s,
    case when p_size > 40 then '0..*' when p_size > 30 then '1..*' when p_size > 22 then '1..1' when p_size > 15 then '0..1' else '' end as e
  from part),
decoded as (select p_partkey, relationship_type, case when s || e <> '' then s || '-' || e end as cardinality from marks)"""


@query(f"with {DECODED} select * from decoded")
def cardinality_decode(spark, d):
    style = F.expr(STYLE)
    return table(spark, d, "part").select(
        "p_partkey",
        markup.relationship_type(style).alias("relationship_type"),
        markup.cardinality(style).alias("cardinality"),
    )


PHRASES = " ".join(f"when '{k}' then '{v}'" for k, v in fixed.CARDINALITY_PHRASES)


@query(f"""
with {DECODED}
select p_partkey, case coalesce(cardinality, '') when '' then 'relates to' {PHRASES}
  else 'relates to (' || cardinality || ')' end as phrase from decoded
""")
def cardinality_phrase(spark, d):
    mark = markup.cardinality(F.expr(STYLE))
    return table(spark, d, "part").select("p_partkey", markup.cardinality_phrase(mark).alias("phrase"))


@query(f"""
with b as (select *, {collapse_sql('text')} as body from documents)
select doc_id, md5(body) as formal_definition, source as domain_context, lang as governance_rules,
       '' as business_rules, n_chars::varchar as lifecycle_states from b
""")
def parse_labelled_fields(spark, d):
    docs = documents(spark, d).withColumn("body", text.collapse(F.col("text")))
    answer = F.expr(
        r"'Here it is.' || chr(10) || 'FORMAL_DEFINITION: ' || body || chr(10) || chr(10) || 'DOMAIN_CONTEXT:   '"
        r" || source || chr(10) || 'GOVERNANCE:' || chr(10) || lang || chr(10) || 'LIFECYCLE_STATES: ' || n_chars"
    )
    fields = docs.select("doc_id", answer.alias("answer")).select("doc_id", *parse.context_fields(F.col("answer")))
    return fields.select(
        "doc_id",
        F.md5("formal_definition").alias("formal_definition"),
        "domain_context",
        "governance_rules",
        "business_rules",
        "lifecycle_states",
    )


@query("""
select p_partkey, 0::bigint as block, p_name as term, p_type || ' of ' || p_brand as definition, p_type as category, '' as governance from part
union all
select p_partkey, 1, p_brand, 'brand: ' || p_name, '', 'size ' || p_size from part
""")
def parse_kv_blocks(spark, d):
    answer = F.expr(
        "'  TERM: ' || p_name || chr(10) || 'DEFINITION: ' || p_type || ' of ' || p_brand || chr(10) || 'CATEGORY:' || p_type"
        " || chr(10) || chr(10) || 'GOVERNANCE: size ' || p_size || chr(10) || chr(10) || 'TERM: ' || p_brand || chr(10)"
        " || 'DEFINITION: brand: ' || p_name"
    )
    blocks = table(spark, d, "part").select("p_partkey", F.posexplode(parse.term_blocks(answer)).alias("block", "b"))
    return blocks.select("p_partkey", F.col("block").cast("bigint").alias("block"), "b.*")


@query("""
select p_partkey, p_name as formal_definition, p_type as category, '' as governance_rules, p_brand as related_terms,
       'owns ' || p_name as relationship, 'a to b' as direction, 'size ' || p_size as rules from part
""")
def parse_reference_fields(spark, d):
    tor = F.expr(
        "'FORMAL_DEFINITION: ' || p_name || chr(10) || 'noise' || chr(10) || 'CATEGORY: ' || p_type || chr(10) || ' RELATED_TERMS:' || p_brand"
    )
    rel = F.expr(
        "'RELATIONSHIP: owns ' || p_name || chr(10) || 'DIRECTION: a to b' || chr(10) || 'RULES: size ' || p_size"
    )
    return table(spark, d, "part").select(
        "p_partkey", *parse.reference_fields(tor), *parse.relation_fields(rel)
    )


@query("select event_id, (props->>'k')::bigint as k from events")
def json_extract_props(spark, d):
    answer = F.expr("'Result for ' || event_type || ': ' || props || ' (end)'")
    found = F.from_json(parse.json_object(answer), "k bigint")
    return table(spark, d, "events").select("event_id", found.k.alias("k"))


@query("""
select event_id, case when event_type = 'click' and value > 10 then 'PENDING'
  when event_type = 'view' then 'PROPOSED_NEW_TAXONOMY' else 'NEEDS_CLARIFICATION' end as review_status from events
""")
def review_status(spark, d):
    tier = F.expr("case event_type when 'click' then 'existing' when 'view' then 'new_proposed' else 'unknown' end")
    confidence = F.expr("case when value > 10 then 'high' else 'low' end")
    return table(spark, d, "events").select(
        "event_id", predicates.review_status(tier, confidence).alias("review_status")
    )


ACTION = """case role
  when 'user' then ' retrieve sections: ["s01","s02"] query: "' || body || '"'
  when 'assistant' then case when turn > 4 then 'KEYWORD terms: [alpha, beta ' || turn || ']'
                             else 'keyword terms: [''c' || conv_id || ''', ''x y'']' end
  else 'perhaps later' end"""


@query(f"""
with b as (select *, replace({collapse_sql('text')}, '"', '') as body from conversations)
select conv_id, turn, case role when 'user' then 'RETRIEVE' when 'assistant' then 'KEYWORD' else 'DONE' end as kind,
  md5(case role when 'user' then trim(body) else '' end) as query_md5,
  case role when 'user' then 's01|s02' else '' end as sections,
  case when role <> 'assistant' then '' when turn > 4 then 'alpha|beta ' || turn else 'c' || conv_id || '|x y' end as terms
from b
""")
def parse_action(spark, d):
    body = F.replace(text.collapse(F.col("text")), F.lit('"'), F.lit(""))
    told = table(spark, d, "conversations").withColumn("body", body).select("conv_id", "turn", F.expr(ACTION).alias("said"))
    acts = told.select("conv_id", "turn", parse.action(F.col("said")).alias("a"))
    return acts.select(
        "conv_id",
        "turn",
        "a.kind",
        F.md5("a.query").alias("query_md5"),
        F.array_join("a.sections", "|").alias("sections"),
        F.array_join("a.terms", "|").alias("terms"),
    )


@query("select p_partkey, lower(p_name) || '|' || lower(p_brand) || '|alt one|alt two' as aliases from part")
def alias_candidates(spark, d):
    answer = F.expr(
        "p_name || ', ' || p_type || ',x , ' || p_brand || ',' || repeat('long ', 20) || ', Alt One, Alt Two , Alt Three'"
    )
    found = parse.alias_candidates(answer, F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", F.array_join(found, "|").alias("aliases"))


BUCKET_SQL = " ".join(f"when {_has('lower(text)', fragments)} then '{name}'" for name, fragments in fixed.BUCKETS)


@query(f"select doc_id, case {BUCKET_SQL} else 'other' end as bucket from documents")
def bucket_classify(spark, d):
    return documents(spark, d).select("doc_id", predicates.bucket(F.col("text")).alias("bucket"))


@query(f"""
with {RESPONSES}
select doc_id, t <> '' and not starts_with(t, '[Error:') and not ({_starts('lower(t)', fixed.NO_DEFINITION)}) as is_real from r
""")
def real_definition(spark, d):
    return _responses(spark, d).select("doc_id", predicates.real_definition(F.col("response")).alias("is_real"))


GOVERNANCE_SQL = strip_sql(r"regexp_replace(t, '\A\*+', '')")


@query(f"""
with {RESPONSES}, g as (select doc_id, {GOVERNANCE_SQL} as t from r)
select doc_id, t <> '' and not starts_with(t, '[Error:') and not ({_starts('lower(t)', fixed.NO_GOVERNANCE)}) as is_real from g
""")
def real_governance(spark, d):
    return _responses(spark, d).select("doc_id", predicates.real_governance(F.col("response")).alias("is_real"))


@query(f"with {RESPONSES} select doc_id, {_has('left(lower(t), 400)', fixed.BOILERPLATE)} as is_boilerplate from r")
def boilerplate_flag(spark, d):
    return _responses(spark, d).select("doc_id", predicates.boilerplate(F.col("response")).alias("is_boilerplate"))


@query(rf"""
with {RESPONSES},
f as (select doc_id, t, length(t) >= 150 as long_enough,
  regexp_matches(lower(t), '\b(section\s+\d|s\d\d\b|rule\s+e\d|article\s+\d|clause\s+\d|paragraph\s+\d)') as cited,
  ({_has('left(lower(t), 300)', fixed.GENERIC)}) as generic,
  ({_has('lower(t)', fixed.DENIALS)}) and length(t) < 300 as denial from r),
s as (select *, ((3 * long_enough::int + 3 * cited::int + 2 * (not generic)::int + 2 * (not denial)::int) / 10.0)::double as points from f)
select doc_id,
  case when t = '' then 0.0::double else points end as score,
  t <> '' and points >= 0.5 and long_enough and not generic and not denial as passed,
  case when t = '' then 'empty response' else concat_ws('; ',
    case when not long_enough then 'too short (' || length(t) || ' < 150 chars)' end,
    case when cited then 'has citations' else 'no rule/section citations found' end,
    case when generic then 'starts with generic/negative phrase' end,
    case when denial then 'response is negative definition boilerplate only' end) end as reasons
from s
""")
def quality_gate(spark, d):
    gate = _responses(spark, d).select("doc_id", predicates.quality_gate(F.col("response")).alias("g"))
    return gate.select("doc_id", "g.score", "g.passed", F.array_join("g.reasons", "; ").alias("reasons"))


@query(f"""
select doc_id, concat_ws('|', 'lang=' || lang, 'n_chars=' || n_chars, 'origin=' || source, 'source_file=' || source || '/' || doc_id) as metadata
from documents
""")
def metadata_sanitize(spark, d):
    from docmosaic.sources.documents import sanitize_metadata

    raw = F.create_map(
        F.lit("lang"), F.col("lang"), F.lit("n_chars"), F.col("n_chars").cast("string"),
        F.lit("extraction_errors"), F.lit("none"), F.lit("dropped"), F.lit(None).cast("string"),
    )
    path = F.concat_ws("/", "source", "doc_id")
    clean = sanitize_metadata(raw, F.create_map(F.lit("origin"), F.col("source")), path)
    pairs = F.array_sort(F.transform(F.map_entries(clean), lambda e: F.concat_ws("=", e.key, e.value)))
    return documents(spark, d).select("doc_id", F.array_join(pairs, "|").alias("metadata"))
