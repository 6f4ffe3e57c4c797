"""Logs and catalogues in a folder that all executors share, read and written by Spark only."""

from __future__ import annotations

import tempfile
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KV_LOG = "seq long, op string, key string, value string"
VECTOR_LOG = "seq long, op string, id long, vector array<float>"
COMMANDS = """type string, key string, value string, space string, user string, data string, engine_type string, dimension int,
    index_type string, metric string, radius float, enable_wal boolean, new_user struct<username: string, password: string, role: string,
    permissions: map<string, string>>, delete_user struct<username: string>"""
#: Buckets of a log: a read of one key opens the files of one bucket.
BUCKETS = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on one machine a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp()


class Folder:
    """The files of a folder, by Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path)) if self.fs.exists(self.path) else []

    def claim(self, name: str) -> bool:
        """Create an empty file; False if another has it already."""
        try:
            return self.fs.createNewFile(self.at(name))
        except Exception as e:  # some file systems raise where others answer
            if self.fs.exists(self.at(name)):
                return False
            raise e

    def delete(self, name: str = ".") -> None:
        self.fs.delete(self.path if name == "." else self.at(name), True)


class Log:
    """An append-only Parquet log. Appends are atomic by job. seq is (batch, row): a batch takes the next free number by
    creating its file, so no clock decides between writers, and row is the order within the batch. A compacted log is a new
    generation of it with the live rows only; readers take the last generation that is complete."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str) -> None:
        self.spark, self.path, self.schema, self.key = spark, path, schema, key

    def bucket(self, value):
        return F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")

    def generation(self) -> int:
        found = [int(x[1:-6]) for x in Folder(self.spark, self.path).names() if x.endswith(".ready")]
        return max(found, default=0)

    def rows_path(self) -> str:
        return f"{self.path}/g{self.generation():06d}"

    def batches(self) -> list[int]:
        """The numbers taken by appends since the last compaction."""
        return [int(x) for x in Folder(self.spark, f"{self.path}/_batches").names() if x.isdigit()]

    def next_batch(self) -> int:
        folder, n = Folder(self.spark, f"{self.path}/_batches"), max(self.batches(), default=0) + 1
        while not folder.claim(f"{n:012d}"):
            n += 1
        return n

    def append(self, rows: DataFrame, op: str | None = None) -> None:
        """Rows with the key column, for PUT the value column, and a column op unless one is given for all; of equal keys in
        one batch the last row wins. No shuffle: each task writes a file for each bucket that it has rows of."""
        self._write(rows, op, self.next_batch(), self.rows_path())

    def _write(self, rows: DataFrame, op: str | None, batch: int, path: str) -> None:
        types = dict(x.split(" ", 1) for x in self.schema.split(", "))
        columns, have = list(types), rows.columns
        ops = F.lit(op) if op else F.col("op")
        out = [F.lit(batch).cast("long").alias("batch"), F.monotonically_increasing_id().alias("row"), ops.alias("op"), *[(F.col(c) if c in have else F.lit(None)).cast(types[c]).alias(c) for c in columns[2:]]]
        out = rows.select(*out).withColumn("bucket", self.bucket(F.col(self.key)))
        out.sortWithinPartitions("bucket").write.mode("append").partitionBy("bucket").parquet(path)

    def read(self) -> DataFrame:
        stored = "batch long, row long, " + self.schema.split(", ", 1)[1] + ", bucket int"
        try:
            found = self.spark.read.schema(stored).parquet(self.rows_path())
        except AnalysisException:
            found = self.spark.createDataFrame([], stored)
        rest = [x.split()[0] for x in self.schema.split(", ")[1:]]
        return found.select(F.struct("batch", "row").alias("seq"), *rest, "bucket")

    def read_key(self, value) -> DataFrame:
        """The rows of one key: one bucket, and a filter that reaches the scan."""
        number = self.spark.range(1).select(self.bucket(F.lit(value).cast(dict(x.split()[:2] for x in self.schema.split(", "))[self.key])).alias("b")).first()["b"]
        return self.read().where((F.col("bucket") == number) & (F.col(self.key) == value))

    def compact(self, view) -> Log:
        """Write the live rows, view(log), as a new generation and drop the old one. Nothing may be appended meanwhile."""
        old, folder = self.generation(), Folder(self.spark, self.path)
        numbers = self.batches()
        live = view(self.read())
        self._write(live, "PUT", max(numbers, default=0), f"{self.path}/g{old + 1:06d}")
        folder.claim(f"g{old + 1:06d}.ready")
        folder.delete(f"g{old:06d}")
        for n in numbers[:-1]:
            folder.delete(f"_batches/{n:012d}")
        return self


class Document:
    """A small JSON table, written whole on each change; the last version counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def write(self, rows: list[dict]) -> None:
        table = self.spark.createDataFrame([tuple(r.get(x) for x in self.columns()) for r in rows], self.schema)
        table.coalesce(1).write.mode("overwrite").json(f"{self.path}/v{time.time_ns():020d}")

    def columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def versions(self) -> list[str]:
        folder = Folder(self.spark, self.path)
        return [x for x in folder.names() if folder.fs.exists(folder.at(f"{x}/_SUCCESS"))]

    def read(self) -> list[dict]:
        found = self.versions()
        if not found:
            return []
        return [r.asDict(recursive=True) for r in self.spark.read.schema(self.schema).json(f"{self.path}/{found[-1]}").collect()]


def commands(lines: DataFrame) -> DataFrame:
    """Commands from JSON lines (column value)."""
    return lines.select(F.from_json("value", COMMANDS).alias("c")).select("c.*")
