"""Key-value operators on a log (seq, op, key, value): the last operation on a key wins.

seq may be any orderable column, also a struct. `view` is one hash aggregate whose partial step runs
before the shuffle, so a key with very many versions reaches its reducer as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A stored value that reads as deleted.
DELETED = "__deleted__"


class KeyNotFound(KeyError):
    pass


def view(log: DataFrame, seq: str = "seq") -> DataFrame:
    """(key, value) of the live keys."""
    last = F.max_by(F.struct("op", "value"), F.col(seq)).alias("last")
    return log.groupBy("key").agg(last).where("last.op = 'PUT'").select("key", F.col("last.value").alias("value"))


def readable(current: DataFrame) -> DataFrame:
    """The view without the reserved value."""
    return current.where(F.col("value") != DELETED)


def get(log: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The value of one key; the filter reaches the scan."""
    return readable(view(log.where(F.col("key") == key), seq))


def get_value(log: DataFrame, key: str, seq: str = "seq") -> str:
    rows = view(log.where(F.col("key") == key), seq).collect()
    if not rows:
        raise KeyNotFound("key not found")
    if rows[0]["value"] == DELETED:
        raise KeyNotFound("key is deleted")
    return rows[0]["value"]


def multi_get(log: DataFrame, keys: DataFrame, seq: str = "seq") -> DataFrame:
    """(key, value) for each of the given keys; value is null where a key is not there."""
    wanted = keys.select("key").distinct()
    return wanted.join(readable(view(log.join(wanted, "key", "left_semi"), seq)), "key", "left")


def put(batch: DataFrame, seq: Column) -> DataFrame:
    """Log rows of a batch (key, value)."""
    return batch.select(seq.alias("seq"), F.lit("PUT").alias("op"), "key", "value")


def delete(keys: DataFrame, seq: Column) -> DataFrame:
    return keys.select(seq.alias("seq"), F.lit("DEL").alias("op"), "key", F.lit(None).cast("string").alias("value"))


def scan(log: DataFrame, prefix: str = "", seq: str = "seq") -> DataFrame:
    """Live keys of a prefix in byte order."""
    return readable(view(log.where(F.startswith("key", F.lit(prefix))) if prefix else log, seq)).orderBy("key")


def overwrites(log: DataFrame) -> DataFrame:
    return log.groupBy("key").agg(F.count_if(F.col("op") == "PUT").alias("versions"), F.count_if(F.col("op") == "DEL").alias("deletes"))


def replay(wal: DataFrame) -> DataFrame:
    """Log rows of a write-ahead log (seq, flag, key, value) that were not committed: P puts, D deletes."""
    op = F.when(F.col("flag") == "D", "DEL").otherwise("PUT").alias("op")
    return wal.where("flag <> 'C'").select("seq", op, "key", "value")


def mark_committed(wal: DataFrame, seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """The write-ahead log with the entries of the given numbers (column seq) marked as committed."""
    done = seqs.select(seq).distinct().withColumn("_done", F.lit(True))
    marked = F.when(F.col("_done"), F.lit("C")).otherwise(F.col("flag"))
    return wal.join(done, seq, "left").select(*[marked.alias(c) if c == "flag" else F.col(c) for c in wal.columns])


def recover(log: DataFrame, wal: DataFrame) -> DataFrame:
    return view(log.unionByName(replay(wal)))
