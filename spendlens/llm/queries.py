"""One registered query per operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import ann_forest, bwt_dedup, conversations, decontam, gray_simhash, lexical, pu_quality, repair_ids, rp_forest, token_counts, tree_bpe, url_filters, warc

#: The rules that the url query judges by.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fixed value: a score from which a document is predicted to be good.
GOOD = 0.7


def op1_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings of earlier ones."""
    return bwt_dedup.dedup_passages(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the trusted positives that are not held out."""
    scored = pu_quality.quality_scores(table(spark, sf_dir, "documents"), pu_quality.trusted_rows(table(spark, sf_dir, "labels")))
    return scored.select("doc_id", pu_quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    judged = url_filters.url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url"),
                                      url_filters.rules_frame(spark, URL_RULES))
    return judged.select("page.page_id", "host", "path", "rule", "verdict")


OP3_SQL = """
with rules(rhost, rpath, verdict) as (values {values}),
rest as (
  select page_id, coalesce(case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end, '') as rest
  from pages),
parts as (
  select page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from rest),
fits as (
  select page_id, rhost || rpath as rule, verdict,
         row_number() over (partition by page_id order by length(rhost || rpath) desc, length(rhost) desc) as n
  from parts join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from parts p left join fits f on p.page_id = f.page_id and f.n = 1
""".format(values=", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES))

def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they pass 512."""
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op5_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    return tree_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return gray_simhash.simhash_components(table(spark, sf_dir, "documents"), width=3, distance=3)


def op7_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to grammar-compressed files and read back."""
    return repair_ids.read_ids(repair_ids.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2))


def op8_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return rp_forest.embedding_components(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item, with the item and the alignment's score."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back from them."""
    got = warc.read_warc(warc.write_warc(table(spark, sf_dir, "pages")))
    broken = F.raise_error(F.concat(F.lit("broken record: "), "error")).cast("long")
    return got.select(F.when(F.col("error").isNull(), F.col("page_id")).otherwise(broken).alias("page_id"),
                      "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_rp_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth one."""
    return ann_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every test item."""
    index = lexical.build_index(table(spark, sf_dir, "documents"))
    found = lexical.search(index, table(spark, sf_dir, "benchmark"), k=50)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


OP12_SQL = r"""
with words as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}')) as term
  from documents),
tfs as (select doc_id, term, count(*) as tf from words group by all),
lengths as (select doc_id, count(*) as n from words group by all),
corpus as (select count(*) as docs, sum(n)::bigint as terms from lengths),
weights as (
  select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w
  from tfs, corpus group by term),
wanted as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}')) as term
  from benchmark),
scores as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::bigint as score
  from wanted join weights using (term) join tfs using (term) join lengths using (doc_id), corpus
  group by all),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 50
""".replace("{term}", lexical.TERM)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every conversation after the damage, and the cheapest edits that repair it."""
    return conversations.damaged_and_repaired(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bwt_dedup": op1_bwt_dedup,
    "op2_quality": op2_quality,
    "op3_url_filters": op3_url_filters,
    "op4_token_counts": op4_token_counts,
    "op5_tree_bpe": op5_tree_bpe,
    "op6_gray_simhash": op6_gray_simhash,
    "op7_repair_ids": op7_repair_ids,
    "op8_rp_forest": op8_rp_forest,
    "op9_decontamination": op9_decontamination,
    "op10_warc": op10_warc,
    "op11_rp_forest_search": op11_rp_forest_search,
    "op12_lexical_search": op12_lexical_search,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op3_url_filters": OP3_SQL,
    "op12_lexical_search": OP12_SQL,
}
