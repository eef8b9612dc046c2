"""One query per operator over its whole table, with the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, html_crf, mixing, mtree, packing, simhash, token_counts, token_files, toxicity, url_filter
from .shared import cut_lineage, scratch

WORD_BPE, BYTE_BPE = map(public_tokenizers.path, ("word_bpe_49k.json", "byte_bpe_50k.json"))
#: The rules that the url query judges by.
RULES = (
    url_filter.Rule("com/en/", "block"),
    url_filter.Rule("example.com/en/7", "allow"),
    url_filter.Rule("net/de/", "allow"),
    url_filter.Rule("example.net/de/8", "block"),
    url_filter.Rule("org/es/", "block"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), scratch(spark, "tokens"), WORD_BPE, end_id=1)
    return token_files.read_documents(spark, manifest).select("doc_id", "start", "n_tokens", "ids_crc32", "shard")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source")


def op3_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.stored_and_read(spark, table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=0))


def op8_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = cut_lineage(mtree.integer_vectors(table(spark, sf_dir, "embeddings")))
    return mtree.top_k(vectors, vectors.where("vec_id % 50 = 0"), scratch(spark, "mtree"), k=5)


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_token_files, op2_source_mix, op3_audio_features, op4_html_text, op5_token_counts, op6_toxicity, op7_pattern_packing, op8_mtree_top_k, op9_url_rules, op10_simhash)
    return {f.__name__: f for f in made}


_LISTED = ", ".join(f"('{r.host}', '{r.path}', '{r.key}', '{r.verdict}')" for r in RULES)

ORACLE_SQL = {
    "op8_mtree_top_k": """
        with parts as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
            from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select q.vec_id as query_id, c.vec_id as vec_id,
                   cast(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i])) as bigint) as score
            from parts q join parts c on c.vec_id <> q.vec_id
            where q.vec_id % 50 = 0
        ), ranked as (
            select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
            from scored
        )
        select query_id, rank, vec_id, score from ranked where rank <= 5""",
    "op9_url_rules": f"""
        with listed(h, p, rule, verdict) as (values {_LISTED}),
        cut as (
            select row_number() over () as n, page_id,
                   case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
            from pages
        ), split as (
            select n, page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from cut
        ), named as (
            select n, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path
            from split
        ), fits as (
            select n, page_id, host, path, rule, verdict,
                   row_number() over (partition by n order by length(rule) desc nulls last) as k
            from named left join listed on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
        )
        select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from fits where k = 1""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
