"""Views of the given tables in the terms of the data model, on both engines.

documents are the chunks (``source`` = section collection), embeddings the
vector store, benchmark items the probed entities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmosaic.functions.embedding import embed
from docmosaic.functions.text import SPACE, tokens
from docmosaic.operators.inverted import InvertedIndex
from docmosaic.session import materialize, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, over all cores also where they are one small file."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(collection, chunk_id, text, domain)"""
    docs = table(spark, sf_dir, "documents")
    return spread(
        docs.select(
            F.col("source").alias("collection"), F.col("doc_id").alias("chunk_id"), "text", F.col("lang").alias("domain")
        ),
        "chunk_id",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, embedding, label)"""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").cast("bigint").alias("label")
    )


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, words): distinct tokens of a benchmark item, longest first."""
    distinct = F.array_distinct(tokens(F.col("text")))
    ranked = F.array_sort(F.transform(distinct, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return table(spark, sf_dir, "benchmark").select("item_id", F.transform(ranked, lambda s: s.w).alias("words"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, pos, variant): the longest word names an entity, two aliases follow."""
    w = lambda i: F.get("words", F.lit(i))
    variants = F.array(w(0), w(1), F.concat(w(2), F.lit(" "), w(0)))
    return (
        _words(spark, sf_dir)
        .select(F.col("item_id").alias("entity_id"), F.posexplode(variants).alias("pos", "variant"))
        .where("variant is not null")
    )


def whole_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, pos, variant): all distinct words of an item."""
    return _words(spark, sf_dir).select(
        F.col("item_id").alias("entity_id"), F.lit(0).alias("pos"), F.concat_ws(" ", "words").alias("variant")
    )


def phrasings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, pos, variant): three phrasings of an item: all its distinct words, every other one, and the rest."""
    half = lambda k: F.concat_ws(" ", F.filter("words", lambda w, i: i % 2 == k))
    listed = F.posexplode(F.array(F.concat_ws(" ", "words"), half(0), half(1))).alias("pos", "variant")
    return _words(spark, sf_dir).select(F.col("item_id").alias("entity_id"), listed)


#: What an ingestion would have written, once per application and folder of tables.
_WRITTEN: dict[tuple[str, str, str], object] = {}


def _once(kind: str, spark: SparkSession, sf_dir: str, make):
    key = (kind, spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        _WRITTEN[key] = make()
    return _WRITTEN[key]


def index(spark: SparkSession, sf_dir: str) -> InvertedIndex:
    """The inverted index of all chunks."""
    return _once("index", spark, sf_dir, lambda: InvertedIndex(chunks(spark, sf_dir)))


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(collection, chunk_id, text, embedding): all chunks with vectors made from their texts."""
    return _once("embedded", spark, sf_dir, lambda: materialize(
        chunks(spark, sf_dir).select("collection", "chunk_id", "text", embed(F.col("text")).alias("embedding")), "embedded"))


# --- the same views in SQL -------------------------------------------------

CHUNKS = "chunks as (select source as collection, doc_id as chunk_id, text, lang as domain from documents)"

WORDS = """
words as (
  select item_id, w, row_number() over (partition by item_id order by length(w) desc, w) as rn,
         count(*) over (partition by item_id) as n
  from (select item_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+'))) as w from benchmark)
  where w <> '')"""

PROBES = WORDS + """,
variants as (
  select item_id as entity_id, rn - 1 as pos, w as variant from words where rn <= 2
  union all
  select c.item_id, 2, c.w || ' ' || a.w from words a join words c on a.item_id = c.item_id
  where a.rn = 1 and c.rn = 3)"""

WHOLE = WORDS + """,
variants as (select item_id as entity_id, 0 as pos, string_agg(w, ' ' order by rn) as variant from words group by item_id)"""

PHRASINGS = WORDS + """,
phrasings as (
  select item_id as entity_id, 0 as pos, string_agg(w, ' ' order by rn) as variant from words group by item_id
  union all select item_id, 1, coalesce(string_agg(w, ' ' order by rn) filter (rn % 2 = 1), '') from words group by item_id
  union all select item_id, 2, coalesce(string_agg(w, ' ' order by rn) filter (rn % 2 = 0), '') from words group by item_id)"""


def embedded_sql(source: str, keys: str, text: str, name: str) -> str:
    """CTEs that end in ``name``(keys, embedding): vectors of hashed word counts."""
    on = " and ".join(f"{{0}}.{k} = {{1}}.{k}" for k in keys.split(", "))
    return f"""
{name}_b as (
  select {keys}, ('0x' || left(md5(w), 4))::int % 64 as b, count(*) as n
  from (select {keys}, unnest(regexp_split_to_array(lower({text}), '[^a-z0-9]+')) as w from {source}) where w <> '' group by all),
{name}_n as (select {keys}, sqrt(sum(n * n)) as norm from {name}_b group by {keys}),
{name} as (
  select {', '.join(f's.{k}' for k in keys.split(', '))}, list(coalesce(x.n / y.norm, 0)::float order by g.b) as embedding
  from {source} s cross join (select unnest(generate_series(0, 63)) as b) g
  left join {name}_b x on {on.format('x', 's')} and x.b = g.b left join {name}_n y on {on.format('y', 's')} group by all)"""


def bm25(source: str = "chunks", variants: str = "variants", name: str = "scores") -> str:
    """CTEs that end in ``name``(entity_id, pos, variant, collection, chunk_id, score)."""
    p = name
    return f"""
{p}_tok as (select collection, chunk_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) as w from {source}),
{p}_len as (select collection, chunk_id, count(*) filter (w <> '') as dl from {p}_tok group by all),
{p}_stat as (select collection, count(*) as n, avg(dl) as av from {p}_len group by all),
{p}_terms as (select distinct entity_id, pos, variant, w from
  (select entity_id, pos, variant, unnest(regexp_split_to_array(lower(variant), '[^a-z0-9]+')) as w from {variants})
  where w <> ''),
{p}_tf as (select collection, chunk_id, w, count(*) as tf from {p}_tok
  where w in (select w from {p}_terms) group by all),
{p}_df as (select collection, w, count(*) as df from {p}_tf group by all),
{name} as (
  select t.entity_id, t.pos, t.variant, f.collection, f.chunk_id,
    sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av)))::double as score
  from {p}_tf f
  join {p}_df d on f.collection = d.collection and f.w = d.w
  join {p}_len l on f.collection = l.collection and f.chunk_id = l.chunk_id
  join {p}_stat s on f.collection = s.collection
  join {p}_terms t on f.w = t.w
  group by all)"""


COSINE = (
    "(list_dot_product({a}::double[], {b}::double[]) / ((sqrt(list_dot_product({a}::double[], {a}::double[])) + 1e-9)"
    " * (sqrt(list_dot_product({b}::double[], {b}::double[])) + 1e-9)))"
)


def cosine(a: str, b: str) -> str:
    return COSINE.format(a=a, b=b)


def nearest(queries: str, source: str, k: int, name: str = "near") -> str:
    """CTE ``name``(query_id, chunk_id, score, rank)."""
    return f"""
{name} as (
  select * from (
    select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank
    from (select q.query_id, v.chunk_id, round({cosine('q.embedding', 'v.embedding')}, 9) as score
          from {queries} q, {source} v))
  where rank <= {k})"""


FIRST_VECTORS = """
vecs as (select vec_id as chunk_id, embedding, label::bigint as label from embeddings),
qv as (select label as query_id, arg_min(embedding, chunk_id) as embedding from vecs group by label)"""

CENTROIDS = """
vecs as (select vec_id as chunk_id, embedding, label::bigint as label from embeddings),
qv as (
  select label as query_id, list(x order by i) as embedding from (
    select label, i, avg(x::double) as x from (
      select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from vecs)
    group by label, i)
  group by label)"""


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '\A{SPACE}+|{SPACE}+\z', '', 'g')"


def collapse_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def normalize_sql(x: str) -> str:
    return collapse_sql(f"lower({x})")
