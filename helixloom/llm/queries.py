"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, exact_topk, fingerprints, html_text, importance, license_scan, line_dedup, mixing, ngram_join, packing, quality_rules, secret_scan, url_filters
from .common import table
from .oracles import ORACLES  # noqa: F401


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    x = F.col("licenses")
    return found.select(
        "doc_id",
        x["n_words"].alias("n_words"),
        F.size(x["base_starts"]).cast("bigint").alias("n_base"),
        F.array_min(x["base_starts"]).cast("bigint").alias("first_word"),
        F.array_max(x["base_starts"]).cast("bigint").alias("last_word"),
        F.array_join(x["base_labels"], ",").alias("base_labels"),
        F.array_join(x["labels"], ",").alias("labels"),
        x["score"].alias("score"),
    )


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "html"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    return pages.select("page_id", F.length("text").cast("bigint").alias("n_chars"), F.size(lines).cast("bigint").alias("n_lines"), "text")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filters.judge(pages, url_filters.HOST_RULES + url_filters.KEYWORD_RULES + url_filters.PATTERN_RULES)
    host_rule = F.when(~F.col("judged.rule").startswith("~"), F.col("judged.rule"))
    return judged.select("page_id", "judged.host", "judged.path", host_rule.alias("rule"), "judged.verdict")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packing.pack(cut)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, F.array("source"))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), exact_topk.quantised(F.col("embedding")).alias("w"))
    return exact_topk.search(vectors.filter(F.col("id") % 50 == 0), vectors, k=5)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.join(docs, width=4, num=85, den=100).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dropped(table(spark, sf_dir, "documents").select("doc_id", "text"), short_repeats=True)
    return found.select(
        F.col("row.key").alias("doc_id"),
        F.col("line_no").cast("bigint").alias("line_no"),
        "kind",
        F.col("kept.row.key").alias("kept_doc_id"),
        F.col("kept.line_no").cast("bigint").alias("kept_line_no"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("secrets.base")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scan.as_text(base), 256).alias("base_sha256"),
        secret_scan.as_text(F.col("secrets.spans")).alias("spans"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.ledger(docs)
    led = F.col("ledger")
    return judged.select(
        "doc_id",
        *[led[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        (~quality_rules.kept(quality_rules.BASE)).alias("base_failed"),
        quality_rules.kept(quality_rules.STRICT).alias("kept"),
        led["fail_bits"].alias("fail_bits"),
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    return importance.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.drill(table(spark, sf_dir, "conversations"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text"))


def mix_of_overlapping_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixing.mix(docs, F.array("source", F.concat(F.lit("in "), "lang"))).select("doc_id", "mix.size", "mix.taken")


def near_copies_by_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith(("op", "near_", "mix_")) and callable(f)}
