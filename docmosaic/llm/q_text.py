"""Queries of the operators that encode, format and score texts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from docmosaic.llm import chat, kneser_ney, pieces
from docmosaic.llm.base import query
from docmosaic.llm.common import fold, table


@query()
def op1_gumbel_sentencepiece(spark, sf_dir):
    found = pieces.sample_pieces(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "sample", F.size("ids").alias("n_pieces"), "ids", "log_prob", "inclusion", "exact"
    )


_T = chat.Template()
_CONTROL = "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in _T.all).replace("'", "''")
_MARKS = len(_T.start) + len(_T.middle) + len(_T.end)


@query(rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, len(regexp_extract_all(role, '{_CONTROL}')) + len(regexp_extract_all(text, '{_CONTROL}')) as more from t)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum({_MARKS} + length(role) + length(text) + more)::bigint as formatted_chars
from e group by conv_id
""")
def op3_offset_aligned_chat(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], talks.schema)
    made = chat.format_conversations(talks.unionByName(extra))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chat.read_back(made).select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query()
def op8_kneser_ney_perplexity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold() == 1, F.lit(False))
    model = kneser_ney.fit(docs.where(~held))
    return kneser_ney.score(docs, model).select(
        F.col("id").alias("doc_id"), F.coalesce(fold("id") == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
