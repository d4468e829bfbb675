"""The registered queries of the corpus operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, conversation_repair, decontamination, fingerprints, importance, licenses, line_dedup, mixing, quality, simhash_dedup, token_files, toxicity, url_filter
from quillspark.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), "removed_words", F.sha2("text", 256).alias("kept_sha256"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have neither fetch times nor a list, so both follow from a rule: page p was fetched
    on day p mod 365 of 2024; a domain of the pages whose length is a multiple of 3 is listed on day
    7 * length mod 100, taken off 60 days later and listed again after 150 more. Parent domains count."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 365).cast("int")).alias("fetched"))
    names = pages.select(F.explode(url_filter.domains(url_filter.host(F.col("url")))).alias("domain")).filter("domain is not null").distinct().filter(F.length("domain") % 3 == 0)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (7 * F.length("domain") % 100).cast("int"))
    steps = F.array(*[F.struct(F.date_add(day, n).alias("day"), F.lit(on).alias("listed")) for n, on in ((0, True), (60, False), (210, True))])
    entries = names.select("domain", F.explode(steps).alias("e")).select("domain", "e.day", "e.listed")
    return url_filter.filter_urls(pages, entries).select("page_id", "host", "fetched", "blocked", "domain", "since")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    shown = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(shown, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations damaged by a rule (a crc32 of id and turn, modulo 20) and repaired: 0 takes a row away, 1 empties
    its text, 2 takes its full stops, exclamation and question marks, 3 doubles it, 4 makes it the user's."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.withColumn("kind", F.crc32(name.cast("binary")) % 20)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    found, turns = conversation_repair.repair(rows, F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1))
    digest = F.sha2(F.array_join(F.transform(F.coalesce("turns", F.array()), lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n"), 256)
    if turns is not None:
        long = conversation_repair.hashed(turns).withColumnRenamed("conv_id", "name")
        found, digest = found.join(long, F.col("conv_id").eqNullSafe(F.col("name")), "left"), F.coalesce("sha256", digest)
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", digest.alias("repaired_sha256"))
