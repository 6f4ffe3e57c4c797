"""Secret scans with an incremental blob ledger, in DataFrame expressions only.

Every text is a blob named by the SHA-256 of its bytes. The ledger holds the pairs (blob, rule version)
that have been scanned, with what was found; the version is a hash of the rules themselves, so changed rules scan
anew. A scan takes only pairs that the ledger lacks, each blob once however many documents or historical versions
have it, and joins the findings back to all paths and versions. A `Ledger` is a durable table in a folder that all
executors share: each scan adds its new pairs in one commit, and a scan that ran twice at once counts once.

The base rules are those of BASE; RULES adds more. Base spans always stay; an added span counts only where it
overlaps no base span and no added span that starts before it (or is listed before it). Positions are code points.

Nulls: a null text is the empty blob; null and repeated ids are paths of their own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import common as C

#: kind, pattern, group that must have `least` characters (0: the whole match).
BASE = (
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}+", 0, 16),
)
RULES = (
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,255}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,250}", 0, 15),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", 0, 30),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 30),
)
#: A text without any of these has no match of the rule and is not searched.
NEEDS = {"access": "AKIA", "github": "gh", "slack": "xox", "google": "AIza", "jwt": "eyJ", "pem": "-----BEGIN"}

SPAN = "struct<kind: string, start: int, end: int>"
LEDGER = f"blob string, version string, spans array<{SPAN}>, added array<{SPAN}>"


def version_of(base=BASE, rules=RULES) -> str:
    """The version of a set of rules: blobs scanned under another one are scanned again."""
    return "v" + hashlib.sha256(repr((tuple(map(tuple, base)), tuple(map(tuple, rules)))).encode()).hexdigest()[:16]


#: The setting of the session that names the folder of a durable ledger.
SETTING = "spark.latticework.secrets.ledger"


def configured(spark: SparkSession) -> Ledger | None:
    """The durable ledger that the session names; None where it names none, so that every blob is scanned."""
    path = spark.conf.get(SETTING, None)
    return Ledger(spark, path) if path else None


class Ledger:
    """A ledger in a folder, split by rule version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self, version: str) -> DataFrame:
        """The pairs of a version, each once."""
        try:
            found = self.spark.read.schema(LEDGER).parquet(self.path)
        except AnalysisException:  # nothing has been scanned yet
            found = self.spark.createDataFrame([], LEDGER)
        return found.where(F.col("version") == version)

    def add(self, pairs: DataFrame) -> None:
        pairs.select("blob", "spans", "added", "version").write.mode("append").partitionBy("version").option("compression", "zstd").parquet(self.path)


def blob(text: Column) -> Column:
    """The address of a text."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """The matches of a rule, leftmost and non-overlapping, that are long enough, with their places: the
    matches and the pieces between them alternate, so their lengths add up to the places."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(whole, F.length)
    judged = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else sizes
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(sizes)).alias("g"), sizes.alias("n"), judged.alias("j"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["g"]
        one = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), (begin + x["n"]).alias("end"))
        return F.struct((begin + x["n"]).alias("at"), F.when(x["j"] >= least, F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

    found = F.aggregate(rows, start, step, lambda a: a["out"])
    there = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.rlike(text, F.lit(pattern))
    return F.when(there, found).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan(blobs: DataFrame, base=BASE, rules=RULES) -> DataFrame:
    """Ledger rows of (blob, text)."""
    t = F.col("text")
    by_start = lambda c: F.array_sort(c, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(0))
    none = F.array().cast(f"array<{SPAN}>")
    found = blobs.select("blob", by_start(F.concat(none, *[spans(t, *r) for r in base])).alias("spans"), by_start(F.concat(none, *[spans(t, *r) for r in rules])).alias("more"))
    clear = lambda x, others: ~F.exists(others, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))
    added = F.aggregate("more", none, lambda a, x: F.when(clear(x, a) & clear(x, F.col("spans")), F.concat(a, F.array(x))).otherwise(a))
    return found.select("blob", F.lit(version_of(base, rules)).alias("version"), "spans", added.alias("added"))


def unseen(docs: DataFrame, done: DataFrame | None, text_col: str = "text") -> DataFrame:
    """(blob, text): each blob once that is not among those done (column blob)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    blobs = docs.select(blob(F.col(text_col)).alias("blob"), text)
    if done is not None:
        blobs = blobs.join(done.select("blob"), "blob", "left_anti")
    return blobs.dropDuplicates(["blob"])


def scan_incremental(docs: DataFrame, ledger: Ledger | None = None, base=BASE, rules=RULES, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(doc_id, *more, blob, spans, added) of every row of docs, and (blob, version, spans, added) of the rules' version. Rows may
    be historical versions of one path; `more` has the columns that name them. Without a ledger all blobs are new."""
    before = ledger and ledger.read(version_of(base, rules))
    new = scan(unseen(docs, before, text_col), base, rules)
    if ledger is None:
        known = C.materialize(new, "ledger")
    else:
        ledger.add(new)
        known = ledger.read(version_of(base, rules)).dropDuplicates(["blob"])
    paths = docs.select(F.col(id_col).alias("doc_id"), *more, blob(F.col(text_col)).alias("blob"))
    return paths.join(known.select("blob", "spans", "added"), "blob", "left").select("doc_id", *more, "blob", "spans", "added"), known


def redacted(docs: DataFrame, known: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span that is known (blob, spans, added) for their texts replaced by the mark."""
    key = f"blob_{uuid.uuid4().hex}"
    some = known.where(F.size(F.concat("spans", "added")) > 0)
    some = some.select(F.col("blob").alias(key), F.array_sort(F.concat("spans", "added"), lambda a, b: a["start"] - b["start"]).alias(f"{key}_s"))
    t = F.col(text_col)

    def step(a: Column, x: Column) -> Column:
        more = F.concat(a["out"], F.substr(t, a["done"] + 1, x["start"] - a["done"]), F.lit(mark))
        return F.struct(F.greatest(a["done"], x["end"]).alias("done"), F.when(x["start"] >= a["done"], more).otherwise(a["out"]).alias("out"))

    clean = F.aggregate(F.col(f"{key}_s"), F.struct(F.lit(0).alias("done"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substr(t, a["done"] + 1, F.length(t))))
    joined = docs.withColumn(key, blob(t)).join(some, key, "left")
    return joined.withColumn(text_col, F.when(F.col(f"{key}_s").isNull(), t).otherwise(clean)).drop(key, f"{key}_s")
