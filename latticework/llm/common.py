"""Shared pieces of the training-data operators: shared storage and UTF-8 buffers as numpy arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text worked on at once inside a task; bounds the temporary arrays.
CHUNK_BYTES = 2 << 20

#: True for the six ASCII white-space bytes (0x20, 0x09-0x0D).
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. spark.checkpoint.dir names it; where that is unset a temporary
    folder is made and set on one machine, and refused on a cluster, whose executors could not read it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="latticework-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """The part of the shared folder that holds this application's intermediate tables."""
    return f"{shared_dir(spark)}/latticework-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there, and a lost
    executor costs no more than its own tasks."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(table: DataFrame) -> None:
    """Delete a table that `materialize` wrote and nothing needs any more."""
    spark = table.sparkSession
    own = scratch_dir(spark).rpartition("/")[2]
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        if folder.rpartition("/")[0].endswith(own):
            delete(spark, folder)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are written."""
    delete(spark, scratch_dir(spark))


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: A key with more than 1 / HOT of all rows is hot, so there are fewer than HOT such keys; rows of a table of keys
#: that is broadcast whole.
HOT, FEW_KEYS = 1000, 100_000


def join_counted(many: DataFrame, one: DataFrame, key: str, rows: str, total: int, how: str = "inner") -> DataFrame:
    """many joined with one, a written table which has each key once and in column `rows` how many rows of many have it,
    `total` in all. A short one is broadcast. Of a longer one only the hot keys are, fewer than HOT rows, so the rows of
    many that have them, which may be a third of all, stay where they are; the others are shuffled by key."""
    if one.limit(FEW_KEYS + 1).count() <= FEW_KEYS:
        return many.join(F.broadcast(one), key, how)
    hot = F.col(rows) * HOT > total
    few = one.where(hot)
    if few.isEmpty():
        return many.join(one, key, how)
    few = F.broadcast(few)
    spared = many.join(few, key)
    rest = many.join(few.select(key), key, "left_anti").join(one.where(~hot | hot.isNull()), key, how)
    return spared.unionByName(rest)


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and the offsets of each text (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of whole texts of about limit bytes; one longer text makes a range by itself."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in raw, and for each text the index of its first word (one more at
    the end). A word never crosses from one text into the next."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[raw]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15 | 3


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n - 1), modulo 2**64."""
    out = np.empty(n, np.uint64)
    if n:
        out[0] = 1
        done = 1
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
    return out


def rolling(values: np.ndarray, width_start: np.ndarray, width_end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64, of the slices values[start:end]: from prefix sums of
    value * base**index, divided by base**start (base is odd, so it has an inverse)."""
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), base), out=prefix[1:])
    inverse = powers(int(width_start.max()) + 1 if len(width_start) else 0, pow(base, -1, 1 << 64))
    return (prefix[width_end] - prefix[width_start]) * inverse[width_start]


#: Masks of the first k bytes of a little-endian 64-bit number.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = BASE) -> np.ndarray:
    """A 64-bit hash of each word: its blocks of eight bytes are each mixed with their place in the word, and the
    sum of those is mixed again. (A polynomial modulo 2**64 would collide on some regular words of 1024 bytes.)"""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    blocks = np.ndarray(len(raw), "<u8", padded, 0, (1,))
    length = ends - starts
    h = mix((blocks[starts] & FIRST_BYTES[np.minimum(length, 8)]) + np.uint64(seed))
    long = np.flatnonzero(length > 8)
    if len(long):
        many = (length[long] - 1) // 8
        first = np.cumsum(many) - many
        place = np.arange(many.sum()) - np.repeat(first, many) + 1
        at = np.repeat(starts[long], many) + 8 * place
        rest = np.minimum(np.repeat(ends[long], many) - at, 8)
        more = mix((blocks[at] & FIRST_BYTES[rest]) + np.uint64(seed) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)))
        h[long] += np.add.reduceat(more, first)
    return mix(h + length.astype(np.uint64))
