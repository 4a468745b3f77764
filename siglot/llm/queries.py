"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siglot.llm.common import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siglot.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siglot.llm.url_filter import judge_urls, rules_frame

    return judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siglot.llm.pii import replace_pii

    return replace_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"), key=b"registered query")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siglot.llm.ngram_join import ngram_join

    return ngram_join(_table(spark, sf_dir, "documents"))[0].select("doc_id", "n_shingles", "component_id")


def op5_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siglot.llm.trie_bpe import bpe_round_trip

    return bpe_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siglot.llm.exact_dedup import exact_dedup

    out = exact_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siglot.llm.toxicity import held_out, learn, toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, learn(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siglot.llm.decontam import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siglot.llm.records import read_records, record_digest, write_records

    path = new_path(spark, "records")
    index = write_records(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path, end_id=2)
    return record_digest(read_records(spark, path), index)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siglot.llm.suffix_dedup import suffix_dedup

    out = suffix_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("changed", F.col("n_removed") > 0)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siglot.llm.collocations import collocations

    return collocations(_table(spark, sf_dir, "documents").select("lang", "text")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siglot.llm.language_id import held_out, language_id, learn

    docs = _table(spark, sf_dir, "documents")
    return language_id(docs.select("doc_id", "text"), learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siglot.llm.lexical_search import lexical_search

    return lexical_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_url_filter, op3_pii_surrogates, op4_ngram_join, op5_trie_bpe, op6_exact_dedup, op7_toxicity, op8_decontaminate, op9_token_records, op10_suffix_dedup, op11_collocations, op12_language_id, op13_lexical_search)}

SQL = {
    "op2_url_filter": r"""
with p as (
  select page_id, url, coalesce(instr(url, '://'), 0) as k from pages
), r as (
  select page_id, case when k > 0 then substr(url, k + 3) else '' end as rest from p
), h as (
  select page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) as raw_host from r
), u as (
  select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*', 0) as path from h
), rules(r_host, r_path, r_verdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fit as (
  select page_id, u.host, u.path, r_host || r_path as rule, r_verdict
  from u join rules on (u.host = r_host or ends_with(u.host, '.' || r_host)) and starts_with(u.path, r_path)
), best as (
  select page_id, arg_max(rule, length(rule)) as rule, arg_max(r_verdict, length(rule)) as verdict from fit group by page_id
)
select u.page_id, u.host, u.path, best.rule, coalesce(best.verdict, 'allow') as verdict from u left join best using (page_id)
""",
    "op6_exact_dedup": """
with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents)
select doc_id, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
       doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256
from d
""",
}
