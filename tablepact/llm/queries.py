"""The operators over their whole tables, with equivalent SQL where it exists."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.llm import oracles
from tablepact.llm.audit import interactions, masks
from tablepact.llm.common import table
from tablepact.llm.decontaminate import contained_items
from tablepact.llm.jaccard import linked_documents
from tablepact.llm.lmscore import scored
from tablepact.llm.passages import repeated_passages
from tablepact.llm.pii import KINDS, spans_text, with_spans
from tablepact.llm.quality import base_failed, judged_by_rules
from tablepact.llm.quotes import conversations_in_reply_order
from tablepact.llm.reputation import Rule, judged_urls
from tablepact.llm.sharding import placed, read_shards, write_shards
from tablepact.llm.spelling import variant_groups, vocabulary
from tablepact.llm.tokenfiles import read_token_files, write_token_files
from tablepact.llm.tokens import bpe_digests, encoded_by_words, tokenizer
from tablepact.session import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged, measures, kept = judged_by_rules(docs, table(spark, sf_dir, "labels"), keep_text=False)
    m = F.col(measures)
    return judged.select(
        "doc_id", m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"), m["n_dup_lines"].alias("n_dup_lines"),
        m["n_repeat_words"].alias("n_repeat_words"), base_failed(m).alias("base_failed"), F.col(kept).alias("kept"),
    )


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("doc").alias("doc_id"), F.col("start").cast("bigint").alias("start_word"), F.col("end").cast("bigint").alias("end_word"),
        F.col("shared_with").alias("shared_doc_id"), "identity")


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversations_in_reply_order(table(spark, sf_dir, "conversations"))
    return found.withColumnsRenamed({"conv": "conv_id", "parent": "parent_turn", "thread": "thread_turn"})


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("spans")

    def of(*kinds: str) -> Column:
        return F.filter(spans, lambda s: s["kind"].isin(*kinds))

    return with_spans(docs, "text", "spans").select(
        "doc_id",
        *[F.size(of(k.name)).cast("bigint").alias(f"n_{k.name}") for k in KINDS],
        F.size(F.filter(spans, lambda s: s["score"] > 0.6)).cast("bigint").alias("n_confirmed"),
        F.sha2(spans_text(of(*[k.name for k in KINDS if k.base])), 256).alias("base_sha256"),
        spans_text(spans).alias("spans"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digests(encoded_by_words(docs, tokenizer()))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contained_items(docs, table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"),
                        "n_windows", "item_windows", "n_slots", "n_changed", "copies")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer())
    return read_token_files(spark, path).select(
        F.col("key").alias("doc_id"), "start", (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = f"{scratch_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    dealt = placed(docs, "doc_id", [f"shard-{i:03d}" for i in range(256)])
    write_shards(dealt, path)
    return read_shards(spark, path, dealt.schema).select("doc_id", "slot", "shard", F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


PAGE_NUMBER = "://[^/?#]*/[^/?#]*/([0-9]{1,18})([^0-9]|$)"
#: The rules that the url query applies before reputations.
URL_RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    # A page shows the document whose number follows the language in its path.
    number = F.regexp_extract("url", PAGE_NUMBER, 1).try_cast("bigint")
    bad = labels.where("quality is not null or toxic is not null").groupBy("doc_id").agg(
        F.bool_or(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    shown = pages.withColumn("doc_id", number).join(bad, "doc_id", "left").drop("doc_id")
    judged, j = judged_urls(shown, URL_RULES)
    return judged.select("page_id", f"{j}.host", f"{j}.path", f"{j}.rule", f"{j}.verdict", f"{j}.n_labelled", f"{j}.n_bad",
                         F.round(F.col(j)["mean"], 6).alias("mean_bad"), F.round(F.col(j)["p_above"], 6).alias("p_above"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text"), altered=31))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return interactions(masks(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_substring_dedup, op2_quotation_linking, op3_lm_scoring, op4_pii, op5_quality_rules,
    op6_bpe, op7_decontamination, op8_token_output, op9_jaccard_join, op10_sharding,
    op11_url_filters, op12_spelling_variants, op13_filter_audit,
)}

ORACLES: dict[str, str] = {
    "op4_pii": oracles.pii(),
    "op5_quality_rules": oracles.quality(),
    "op7_decontamination": oracles.decontamination(),
    "op11_url_filters": oracles.url_verdicts([(r.verdict, r.text) for r in URL_RULES], PAGE_NUMBER),
    "op12_spelling_variants": oracles.spelling(),
    "op13_filter_audit": oracles.filter_audit(),
}
