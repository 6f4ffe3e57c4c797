"""Connection limits and throughput figures."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = 100


class Limiter:
    """Slots of a server, shared by its threads. Acquiring never waits."""

    def __init__(self, most: int = 1000) -> None:
        self.most, self.active = most, 0
        self.lock = threading.RLock()  # a signal may come while its own thread holds it

    def acquire(self) -> bool:
        with self.lock:
            if self.active >= self.most:
                return False
            self.active += 1
            return True

    def release(self) -> None:
        with self.lock:
            self.active = max(0, self.active - 1)

    def update(self, most: int) -> None:
        with self.lock:
            if most <= 0:
                raise ValueError("limit must be positive")
            if most < self.active:
                raise ValueError(f"limit {most} is below the {self.active} active connections")
            self.most = most

    def increase(self, by: int = STEP) -> None:
        with self.lock:
            self.update(self.most + by)

    def decrease(self, by: int = STEP) -> None:
        with self.lock:
            self.update(self.most - by)

    def figures(self) -> dict:
        """The columns of connection_stats, of now."""
        with self.lock:
            return {"active_connections": self.active, "max_connections": self.most, "usage_percentage": self.active / self.most * 100, "available_slots": self.most - self.active}

    def stats(self, spark: SparkSession) -> DataFrame:
        return connection_stats(spark.createDataFrame([(self.active, self.most)], "active int, most int"))

    def warning(self) -> bool:
        return self.active > 0.8 * self.most

    def save(self, spark: SparkSession, path: str) -> None:
        import time

        row = [(self.most, str(int(time.time())))]
        spark.createDataFrame(row, "max_connections int, last_updated string").write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, most: int = 1000) -> Limiter:
        """The saved limit; `most` where none was saved."""
        from pyspark.errors import AnalysisException

        try:
            row = spark.read.schema("max_connections int, last_updated string").json(path).first()
        except AnalysisException:
            row = None
        return cls(row["max_connections"] if row else most)


def connection_stats(rows: DataFrame) -> DataFrame:
    """From (active, most)."""
    usage = (F.col("active") / F.col("most") * 100).alias("usage_percentage")
    return rows.select(F.col("active").alias("active_connections"), F.col("most").alias("max_connections"), usage, (F.col("most") - F.col("active")).alias("available_slots"))


def limit_fold(changes: DataFrame, start: int) -> DataFrame:
    """The limit after a sequence of increases and decreases (seq, delta, active): one that would leave it
    not positive or below the active connections is refused."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "delta", "active")))
    step = lambda limit, x: F.when((limit + x["delta"] > 0) & (limit + x["delta"] >= x["active"]), limit + x["delta"]).otherwise(limit)
    return changes.agg(F.aggregate(ordered, F.lit(start).cast("long"), step).alias("max_connections"))


def throughput(calls: DataFrame) -> DataFrame:
    """The mean of the clients' rates from (client, ops, seconds)."""
    rates = calls.groupBy("client").agg((F.sum("ops") / F.sum("seconds")).alias("rate"))
    return rates.agg(F.round(F.avg("rate"), 6).alias("ops_per_second"), F.count(F.lit(1)).alias("clients"))
