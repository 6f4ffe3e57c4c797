"""A training-data pipeline: quality classifier, near-duplicates, decontamination, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import common as C
from latticework.llm import neardup, packing, postings, quality, secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects (score under 0.7). A null text is judged as an empty one;
    rows with null or repeated ids are judged each by their own text, and null ids are never learned from."""
    labels = C.read(spark, sf_dir, "labels", "doc_id", "quality")
    some = F.broadcast(quality.candidates(labels).select("doc_id"))
    learned = docs.join(some, "doc_id", "left_semi").where(C.crc_mod(F.col("doc_id"), 4) != 2)
    model = quality.learn(quality.statistics_of(learned), labels)
    return quality.accepted(docs, model, 0.7).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of near-duplicates (Jaccard similarity of five-word shingles at least 0.8; candidates from the
    SimHash operator and, as its 3 bits find only part of them, from MinHash cells) the row with the smallest doc_id, nulls last.
    Rows are judged one by one, whatever their doc_id."""
    return neardup.survivors(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item. Texts are judged by their hash, so rows with
    null or repeated ids are too. A null text holds none and stays."""
    marked = docs.withColumn("_text", neardup.text_hash())
    found = postings.contamination(marked, C.read(spark, sf_dir, "benchmark", "item_id", "text"), id_col="_text")
    hit = C.materialize(found.where("n_hit > 0").select(F.col("doc_id").alias("_text")).distinct(), "hit-texts")
    hit = C.small(hit, 1_000_000)  # numbers of 8 bytes
    return marked.join(hit, "_text", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by [SECRET]; the documents stay. A null text stays null. Blobs that the session's ledger
    (secrets.SETTING) has already are not scanned again."""
    _, known = secrets.scan_incremental(docs, secrets.configured(spark))
    return secrets.redacted(docs, known).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens; a null text is one token."""
    parts, placed = packing.pack(docs)
    return parts.join(placed, "uid").select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack),
]

#: The classifier's fit, the connected components and the packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = C.materialize(docs, "stage")
    return docs
