"""The registered queries of the training-data operators: thin, whole tables, production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, decontaminate, jaccard_join, license_scan, quality_classifier, quality_rules, token_counts, url_filter, warc_audit
from .common import shared_dir, table

#: (host, path, verdict)
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas of the pages as WARC records, the second with a flipped first byte in every
    97th page; every record with its offset, digest and the audit's status."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rot = F.when((F.col("page_id") % 97 == 13) & (F.length("html") > 0) & (F.substring("html", 1, 1) == "<"), F.concat(F.lit("#"), F.substring("html", F.lit(2), F.length("html")))).otherwise(F.col("html"))
    a = warc_audit.build_tree(warc_audit.to_records(pages))
    b = warc_audit.build_tree(warc_audit.to_records(pages.withColumn("html", rot)))
    return warc_audit.audited_records(a, b)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    return jaccard_join.similarity_join(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, model, ["doc_id"])
    return scored.select("doc_id", quality_classifier.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    say = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select cast(conv_id as bigint) conv_id, cast(turn as bigint) turn, role, text from values (-7, 0, 'user', '{say}'), (-7, 1, 'assistant', '{say}') as t(conv_id, turn, role, text)")
    events = chat_format.events_from_rows(rows.unionByName(extra))
    back = chat_format.read_back(chat_format.format_chat(events))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha(F.array_join(each, "")).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), sha(F.col("loss_text")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.tiktoken", eod: int = 50256) -> DataFrame:
    """The documents as flat files of 16-bit ids, then every document's place and length by the scan."""
    import public_tokenizers as P

    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/token-files-{uuid.uuid4().hex}"
    names = token_counts.write_token_files(table(spark, sf_dir, "documents"), folder, P.path(tokenizer), P.PATTERN, eod)
    found = token_counts.token_counts(token_counts.read_token_files(spark, folder), eod)
    found = found.withColumn("file", F.regexp_extract("file", r"part-(\d+)\.bin$", 1).cast("long"))
    # hinted, as Spark takes the scan's documents for no larger than its blocks and would broadcast them
    return found.join(names.hint("merge"), ["file", "doc"]).select("doc_id", "file", "doc", "start", "n_tokens")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = license_scan.scan(docs, license_scan.train(docs), ["doc_id"])
    sure = F.filter("found", lambda x: x["confirmed"])
    return found.select("doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_named"), F.size(sure).cast("long").alias("n_confirmed"), F.array_join(F.array_sort(F.array_distinct(sure["family"])), ",").alias("families"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    import public_tokenizers as P

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), P.path(tokenizer), P.PATTERN, ["doc_id"])


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = url_filter.url_filter(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))
    return got.select("page_id", "host", "path", "rule", "verdict")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
