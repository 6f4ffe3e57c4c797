"""The queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import common as C
from latticework.llm import langid, packing, perplexity, pii, postings, quality, secrets, simhash, substring, urlfilter


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(C.read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "fingerprint", "component_id")


def op2_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = perplexity.quality_rules(C.read(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return found.select("doc_id", *perplexity.BASE, "base_failed", "kept", "log_ppl", "q1", "mid", "q3", "band")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, placed = packing.pack(C.read(spark, sf_dir, "documents", "doc_id", "text"))
    digest = parts.select("uid", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return digest.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = langid.identify(docs, C.crc_mod(F.col("doc_id"), 5) != 0)
    return found.select("doc_id", (C.crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(C.read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urlfilter.judge(C.read(spark, sf_dir, "pages", "page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(C.read(spark, sf_dir, "documents", "doc_id", "text"))
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(pii.KINDS) for x in (k, i)])
    key = lambda s: rank[s["kind"]].cast("long") * (1 << 32) + s["start"]
    every = F.transform(F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(key(s).alias("key"), s.alias("s")))), lambda x: x["s"])
    return found.select("doc_id", *[number("base", k) for k in pii.BASE_KINDS], F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(every).alias("spans"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = postings.contamination(C.read(spark, sf_dir, "documents", "doc_id", "text"), C.read(spark, sf_dir, "benchmark", "item_id", "text"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, (F.col("n_hit") > 0).alias("contaminated"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.scan_incremental(C.read(spark, sf_dir, "documents", "doc_id", "text"), secrets.configured(spark))
    every = F.array_sort(F.concat("spans", "added"), lambda a, b: a["start"] - b["start"])
    return found.select("doc_id", *[number("spans", k) for k, *_ in secrets.BASE], F.sha2(digest(F.col("spans")), 256).alias("base_sha256"), digest(every).alias("spans"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.statistics_of(C.read(spark, sf_dir, "documents", "doc_id", "text"))
    held = C.crc_mod(F.col("doc_id"), 4) == 2
    model = quality.learn(stats.where(~held), C.read(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.score(stats, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_simhash, op2_perplexity, op3_packing, op4_langid, op5_substring, op6_urlfilter, op7_pii, op8_decontamination, op9_secrets, op10_quality, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from latticework.llm import sql

    return sql.ORACLES
